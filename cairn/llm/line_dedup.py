"""Line dedup: repeated runs of lines, found by prefix doubling over the sequences of line ids.

Level k ranks the blocks of 2**k lines that occur twice or more. A block's rank is its place
among the sorted pairs (rank of its first half, rank of its second half), so ranks order
suffixes by their first 2**k lines: the suffix array of the repeated part, refined level by
level. All blocks of one rank form a longest-common-prefix interval of depth 2**k or more.
A block that isn't the first of its interval is a later copy. Copies that lie on one
diagonal (the same distance to the block they repeat) and touch form a maximal run.
Maximal runs may also repeat blocks whose first occurrences lie apart. A line lies in a repeated
run of min_words words or more just if a shortest such window around it, from its first line on or up
to its last, occurs earlier; two overlapping blocks of 2**k lines name a window (see whole_runs).
All steps are DataFrame expressions; rows of hot lines meet only in counts and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize

BLANKS = " \t\n\x0b\x0c\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_table(docs: DataFrame) -> DataFrame:
    """One row per line with a word: doc_id, th (digest of the text), pos among them, line (index in the text), h1, h2, n_words."""
    placed = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("line"), F.btrim(x, F.lit(BLANKS)).alias("core"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2")))
    worded = F.filter(placed, lambda x: x["core"] != "")
    slim = F.transform(worded, lambda x: F.struct(x["line"].alias("line"), x["h1"].alias("h1"), x["h2"].alias("h2"), F.size(F.split(x["core"], r"[\x20\x09-\x0D]+")).alias("n_words")))
    rows = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), slim.alias("lines"))
    return rows.select("doc_id", "th", F.posexplode("lines").alias("pos", "x")).select("doc_id", "th", "pos", "x.line", "x.h1", "x.h2", "x.n_words")


def _groups(rows: DataFrame, key: list[str]) -> DataFrame:
    """key, first of the keys that occur twice or more."""
    at = F.struct("doc_id", "th", "pos")
    return materialize(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first")).filter("n > 1").drop("n"))


def _ranked(groups: DataFrame, key: list[str], n: int, few: int = 50_000) -> DataFrame:
    """groups with rank, in the order of the keys: the running id over sorted ranges; up to `few` keys are one range."""
    ranges = groups.coalesce(1) if n <= few else groups.repartitionByRange(*key)
    return ranges.sortWithinPartitions(*key).withColumn("rank", F.monotonically_increasing_id())


def repeated_blocks(docs: DataFrame, most: int | None = None) -> list[DataFrame]:
    """Level k holds doc_id, th, pos, rank, first (and line, n_words at level 0) of the repeated blocks of 2**k lines, up to most lines."""
    rows = materialize(line_table(docs))
    key, levels = ["h1", "h2"], []
    while True:
        groups = _groups(rows, key)
        if (n := groups.count()) or not levels:
            levels.append(materialize(rows.join(_ranked(groups, key, n), key).drop(*key)))
        discard(groups)
        if len(levels) == 1:
            discard(rows)
        if not n or (most is not None and 2 ** len(levels) > most):
            return levels
        ahead, key = 2 ** (len(levels) - 1), ["r1", "r2"]
        window = W.partitionBy("doc_id", "th").orderBy("pos").rangeBetween(ahead, ahead)
        rows = levels[-1].select("doc_id", "th", "pos", F.col("rank").alias("r1"), F.first("rank").over(window).alias("r2")).filter("r2 is not null")


def later_runs(levels: list[DataFrame]) -> DataFrame:
    """One row per document with later copies: doc_id, th, lines, runs.

    lines: (pos, line, words up to and with it) of the lines that repeat earlier ones, by position. runs: the maximal runs, as
    (start, size, from_doc, from_pos, at): their first line is lines[at - 1], and all their lines follow it there. All
    steps after the first exchange keep a document's rows together.
    """
    copies = None
    own = F.struct("doc_id", "th", "pos")
    for k, level in enumerate(levels):
        info = F.struct("line", "n_words") if k == 0 else F.lit(None).cast("struct<line: int, n_words: int>")
        part = level.filter(F.col("first") != own).select("doc_id", "th", "pos", F.struct(F.lit(2**k).alias("n"), "first").alias("copy"), info.alias("info"))
        copies = part if copies is None else copies.unionByName(part)
    best = copies.repartition("doc_id", "th").groupBy("doc_id", "th", "pos").agg(F.max("copy").alias("copy"), F.max("info").alias("info"))
    by_pos = W.partitionBy("doc_id", "th").orderBy("pos")
    best = best.select(
        "doc_id",
        "th",
        "pos",
        "info.line",
        F.col("copy.first.doc_id").alias("from_doc"),
        F.col("copy.first.th").alias("from_th"),
        (F.col("copy.first.pos") - F.col("pos")).alias("shift"),
        (F.col("pos") + F.col("copy.n")).alias("end"),
        F.row_number().over(by_pos).alias("at"),
        F.sum("info.n_words").over(by_pos.rowsBetween(W.unboundedPreceding, 0)).alias("words"),
    )
    diagonal = W.partitionBy("doc_id", "th", "from_doc", "from_th", "shift").orderBy("pos")
    reached = F.max("end").over(diagonal.rowsBetween(W.unboundedPreceding, -1))
    marked = best.withColumn("opens", F.when(reached >= F.col("pos"), 0).otherwise(1))
    numbered = marked.withColumn("run", F.sum("opens").over(diagonal.rowsBetween(W.unboundedPreceding, 0)))
    grouped = numbered.groupBy("doc_id", "th", "from_doc", "from_th", "shift", "run").agg(
        F.min("pos").alias("start"), F.max("end").alias("end"), F.min("at").alias("at"), F.collect_list(F.struct("pos", "line", "words")).alias("held")
    )
    run = F.struct("start", (F.col("end") - F.col("start")).cast("int").alias("size"), "from_doc", (F.col("start") + F.col("shift")).alias("from_pos"), "at")
    whole = grouped.groupBy("doc_id", "th").agg(F.array_sort(F.flatten(F.collect_list("held"))).alias("lines"), F.collect_list(run).alias("runs"))
    return whole


def whole_runs(levels: list[DataFrame], min_words: int) -> DataFrame:
    """One row per document with later copies of windows: doc_id, th, held (sorted (pos, line) of all their lines).

    A window is a run of lines with min_words words or more that loses them without its last line, or without its
    first. If a longest earlier match of min_words words or more holds a line, so does a window within that match: the one
    from the line or from the match's start on, or the one up to the line. It has min_words lines at most, and its words
    follow from its lines, so copies of a window are windows. Two overlapping blocks of 2**k lines cover it: its
    size and their ranks are its key.
    """
    at = ["doc_id", "th", "pos"]
    rows = None
    for k, level in enumerate(levels):
        info = F.struct("line", "n_words") if k == 0 else F.lit(None).cast("struct<line: int, n_words: int>")
        part = level.select(*at, F.lit(k).alias("k"), "rank", info.alias("info"))
        rows = part if rows is None else rows.unionByName(part)
    ranks = [F.max(F.when(F.col("k") == k, F.col("rank"))) for k in range(len(levels))]
    rows = rows.repartition("doc_id", "th").groupBy(*at).agg(F.max("info").alias("info"), F.array(*ranks).alias("ranks"))
    by_pos = W.partitionBy("doc_id", "th").orderBy("pos")
    rows = rows.select(*at, "info.line", "info.n_words", "ranks", F.sum("info.n_words").over(by_pos.rowsBetween(W.unboundedPreceding, 0)).alias("words"))
    own = F.struct("pos", "line", "n_words", "words", "ranks")
    rows = rows.select(*at, "n_words", "words", F.collect_list(own).over(by_pos.rangeBetween(0, min_words - 1)).alias("on"), F.collect_list(own).over(by_pos.rangeBetween(1 - min_words, 0)).alias("up"))
    short_on = F.filter("on", lambda x: x["words"] - F.col("words") + F.col("n_words") < min_words)
    short_up = F.filter("up", lambda x: F.col("words") - x["words"] + x["n_words"] < min_words)
    on = F.slice("on", 1, F.size(short_on) + 1)
    up = F.slice("up", F.greatest(F.size("up") - F.size(short_up), F.lit(1)), F.size("up"))
    both = rows.select("doc_id", "th", F.explode(F.array(F.struct(F.lit(True).alias("forward"), on.alias("w")), F.struct(F.lit(False).alias("forward"), up.alias("w")))).alias("x")).select("doc_id", "th", "x.*")
    first, last, size = F.get("w", F.lit(0)), F.element_at("w", -1), F.size("w")
    words = last["words"] - first["words"] + first["n_words"]
    whole = (last["pos"] - first["pos"] + 1 == size) & (words >= min_words) & (F.col("forward") | (words - last["n_words"] >= min_words))
    k = sum(((size >= 2**j).cast("int") for j in range(1, min_words.bit_length())), F.lit(0))
    tail = F.get("w", size - F.pow(F.lit(2), k).cast("int"))
    keyed = both.filter(whole).select("doc_id", "th", first["pos"].alias("pos"), F.transform("w", lambda x: F.struct(x["pos"].alias("pos"), x["line"].alias("line"))).alias("w"), size.alias("size"), F.get(first["ranks"], k).alias("a"), F.get(tail["ranks"], k).alias("b"))
    keyed = materialize(keyed.filter("a is not null and b is not null"))
    groups = _groups(keyed, ["size", "a", "b"])
    again = keyed.join(groups, ["size", "a", "b"]).filter(F.col("first") != F.struct(*at))
    whole = materialize(again.groupBy("doc_id", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("held")))
    discard(keyed)
    discard(groups)
    return whole


def dedup_lines(docs: DataFrame, min_words: int = 10, whole: bool = False) -> DataFrame:
    """docs with deleted_lines (sorted indexes), n_runs and text without them.

    A line goes if it lies in a maximal run that repeats an earlier run and holds min_words words
    or more. Earlier means a smaller (doc_id, digest of the text, position); the run a block repeats is
    the first occurrence of the longest block of 2**k lines that begins there. With whole, a line goes if any run of
    min_words words or more that holds it occurs earlier, and n_runs counts the stretches of lines that go. Lines compare as
    they are; lines without a word belong to no run and stay. A null or empty text has no lines to lose; rows
    alike in doc_id and text count once and get the same result; rows with a null doc_id stay as they are
    and are no source. An empty table gives no rows. Existing columns deleted_lines and n_runs are replaced.
    """
    docs = docs.drop("deleted_lines", "n_runs")
    levels = repeated_blocks(docs, max(min_words, 1) if whole else None)
    if whole:
        gone = whole_runs(levels, max(min_words, 1))
        stretches = F.array_distinct(F.transform("held", lambda x, i: x["pos"] - i))
        gone = gone.select(F.col("doc_id").alias("_cairn_doc"), F.col("th").alias("_cairn_th"), F.col("held.line").alias("deleted_lines"), F.size(stretches).alias("n_runs"))
    else:
        before = lambda r: F.when(r["at"] > 1, F.get("lines", r["at"] - 2)["words"]).otherwise(0)
        words = lambda r: F.get("lines", r["at"] + r["size"] - 2)["words"] - before(r)
        gone = later_runs(levels).withColumn("runs", F.filter("runs", lambda r: words(r) >= min_words)).filter(F.size("runs") > 0)
        cut = F.flatten(F.transform("runs", lambda r: F.transform(F.slice("lines", r["at"], r["size"]), lambda x: x["line"])))
        gone = gone.select(F.col("doc_id").alias("_cairn_doc"), F.col("th").alias("_cairn_th"), F.array_sort(F.array_distinct(cut)).alias("deleted_lines"), F.size("runs").alias("n_runs"))
    gone = materialize(gone)
    for x in levels:
        discard(x)
    joined = docs.join(gone, (docs.doc_id.cast("long") == gone._cairn_doc) & (F.xxhash64(docs.text) == gone._cairn_th), "left")
    cut = _lines(F.col("text"))
    left = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), "deleted_lines")
    kept = F.array_join(F.get(F.transform(F.array(cut), lambda a: F.transform(left, lambda i: F.get(a, i))), F.lit(0)), "\n")
    return joined.select(
        *[F.when(F.col("deleted_lines").isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("deleted_lines", F.expr("cast(array() as array<int>)")).alias("deleted_lines"),
        F.coalesce("n_runs", F.lit(0)).cast("long").alias("n_runs"),
    )
