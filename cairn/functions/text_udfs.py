"""Arrow UDFs over the kernels; only for what built-in functions can't say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from cairn.functions import kernels


TEXT, TEXTS, FLAG, NUMBER = T.StringType(), T.ArrayType(T.StringType()), T.BooleanType(), T.DoubleType()  # types, as DDL text would need a session at import


def _one(kernel, returns: T.DataType):
    @pandas_udf(returns)
    def udf(x: pd.Series) -> pd.Series:
        return x.map(lambda v: kernel(v) if v is not None else None)

    return udf


normalize_key = _one(kernels.normalize_key, TEXT)
mask_fences = _one(kernels.mask_fences, TEXT)
chunk_lines = _one(kernels.chunk_lines, TEXTS)
demote_headings = _one(kernels.demote_headings, TEXT)
source_title = _one(kernels.source_title, TEXT)
folded_text = _one(kernels.folded_text, TEXT)
line_keys = _one(kernels.line_keys, TEXTS)
extract_json = _one(kernels.extract_json, TEXT)
extract_items = _one(kernels.extract_items, TEXTS)
language = _one(kernels.language, TEXT)
refutes_sameness = _one(kernels.refutes_sameness, FLAG)


@pandas_udf(TEXT)
def evidence_line(body: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([kernels.evidence_line(a or "", b or "") for a, b in zip(body, source, strict=True)], dtype=object)


@pandas_udf(NUMBER)
def near_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kernels.near_match(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(NUMBER)
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(TEXT)
def acronym_match(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([kernels.acronym_match(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype=object)


@pandas_udf(TEXT)
def resolve_link(target: pd.Series, directory: pd.Series) -> pd.Series:
    return pd.Series([kernels.resolve_link(a or "", b or "") for a, b in zip(target, directory, strict=True)], dtype=object)


@pandas_udf(T.StructType([T.StructField("prose", TEXT), T.StructField("status", TEXT), T.StructField("used", T.ArrayType(T.IntegerType()))]))
def split_attribution(reply: pd.Series, n_blocks: pd.Series) -> pd.DataFrame:
    rows = [kernels.split_attribution(r or "", int(n)) for r, n in zip(reply, n_blocks, strict=True)]
    return pd.DataFrame(rows, columns=["prose", "status", "used"])


def nfc(column):
    """Composed form, where text isn't ASCII already."""
    import unicodedata

    compose = _one(lambda v: unicodedata.normalize("NFC", v), TEXT)
    return F.when(column.rlike(r"^[\x00-\x7F]*$"), column).otherwise(compose(column))
