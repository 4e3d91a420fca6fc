"""Column expressions that several operators share; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.vocabulary import ENGLISH, SENSITIVITIES, SPANISH


def rank(level: Column) -> Column:
    """Rank for combining: null and blank count as private, unknown names as confidential."""
    name = F.trim(level)
    known = F.when(name == SENSITIVITIES[0], 0).when(name == SENSITIVITIES[1], 1).otherwise(2)
    return F.when(level.isNull() | (name == ""), 1).otherwise(known)


def strict_rank(level: Column) -> Column:
    """Rank for merged content: null and blank are confidential."""
    return F.when(level.isNull() | (F.trim(level) == ""), 2).otherwise(rank(level))


def level_of(r: Column) -> Column:
    return F.get(F.array(*map(F.lit, SENSITIVITIES)), r)


def combine(a: Column, b: Column) -> Column:
    return level_of(F.greatest(rank(a), rank(b)))


def raise_by(level: Column, offset: int) -> Column:
    """Saturating; an offset below nought is an error."""
    if offset < 0:
        raise ValueError("a sensitivity is never lowered")
    return level_of(F.least(rank(level) + offset, F.lit(2)))


def blocks_send(level: Column, threshold: str = "confidential", readable: Column | None = None) -> Column:
    """Egress: what is unreadable, blank or at the threshold is blocked."""
    bad = level.isNull() | (F.trim(level) == "") | (rank(level) >= SENSITIVITIES.index(threshold))
    return bad if readable is None else bad | ~readable


def confidence(x: Column) -> Column:
    """Clamped to [0, 1]; null, not-a-number and infinity of either sign are 0."""
    x = x.cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0 or lengths differ."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def key_ascii(title: Column) -> Column:
    """normalize_key for ASCII titles, without Python."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def titleize(stem: Column) -> Column:
    return F.trim(F.regexp_replace(stem, "[-_]+", " "))


def words(text: Column) -> Column:
    """Runs of English and Spanish letters, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-záéíóúüñ]+)"), F.lit(1))


def query_terms(question: Column) -> Column:
    """Letter runs without function words; all of them if none is left, then the question itself."""
    found = F.regexp_extract_all(question, F.lit(r"(\p{L}+)"), F.lit(1))
    stops = F.array(*map(F.lit, [*ENGLISH, *SPANISH]))
    content = F.filter(found, lambda w: ~F.array_contains(stops, F.lower(w)))
    return F.when(F.size(content) > 0, content).otherwise(F.array(question))


def window_days(window: Column) -> Column:
    """Days of `<n>d` or `<n>w`, n above nought; null for anything else."""
    n = F.regexp_extract(window, r"^(\d+)([dw])$", 1).try_cast("int")
    days = F.when(window.endswith("w"), 7 * n).otherwise(n)
    return F.when(days > 0, days)


def short_key(*parts: Column) -> Column:
    """128 bits of SHA-256 over the parts, sorted and joined by a null character."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array(*parts)), "\0"), 256), 1, 32)
