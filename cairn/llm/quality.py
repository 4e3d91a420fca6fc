"""Quality rules: statistics of a text, and decision lists learned over them, as Spark expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that count as symbols (fixed value of the contract).
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What rules may test: counts per mille of another count, or a mean.
FEATURES = ("n_words", "mean_chars", "symbols", "upper", "shouts", "bars", "dup_lines", "repeats", "distinct")


def _let(value: Column, use) -> Column:
    """use(value) with value worked out once, also where use needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _covered(hashes: Column) -> Column:
    """How many words stand in windows that occur twice or more; hashes: one per window."""

    def union(starts: Column) -> Column:
        begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end"))
        return F.aggregate(starts, begin, step, lambda a: a["n"])

    def few(windows: Column, twice: Column) -> Column:
        return F.filter(F.transform(windows, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull())

    def many(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        like = lambda z, x, j: F.coalesce(F.get(z, j)["h"] == x["h"], F.lit(False))
        return _let(placed, lambda z: F.array_sort(F.transform(F.filter(z, lambda x, j: ((j > 0) & like(z, x, j - 1)) | like(z, x, j + 1)), lambda x: x["i"])))

    def count(windows: Column) -> Column:
        ordered = F.sort_array(windows)
        twice = _let(ordered, lambda s: F.array_distinct(F.filter(s, lambda h, j: (j > 0) & (F.get(s, j - 1) == h))))
        return _let(
            twice,
            lambda d: F.when(F.size(d) == 0, F.lit(0)).when(F.size(d) <= 32, union(few(windows, d))).otherwise(union(many(windows))),
        )

    return _let(hashes, count)


def statistics(docs: DataFrame) -> DataFrame:
    """docs with `stats`, a struct of counts over the whole text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words as the contract has them, and
    n_chars, n_upper, n_shouts, n_bars, n_lines, n_distinct. A null text has no words. Sorting by 64-bit
    hashes of three words finds repeats; two different windows of a text share one with
    a probability below 1e-10 at 20,000 words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    less = lambda t, chars: F.length(t) - F.length(F.translate(t, chars, ""))

    def of_words(w: Column) -> Column:
        def windows(h: Column) -> Column:
            return F.when(F.size(h) < 4, F.lit(0)).otherwise(
                _covered(F.transform(F.slice(h, F.lit(1), F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
            )

        hashed = F.transform(w, lambda x: F.xxhash64(x))
        return _let(
            hashed,
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                windows(h).cast("long").alias("n_repeat_words"),
                F.size(F.array_distinct(h)).cast("long").alias("n_distinct"),
            ),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    counted = (
        docs.withColumn("_w", of_words(words))
        .withColumn("_l", _let(lines, of_lines))
        .withColumn(
            "_c",
            F.struct(
                F.length(text).cast("long").alias("n_chars"),
                less(text, BLANKS).alias("n_blank"),
                less(text, SYMBOLS).cast("long").alias("n_symbols"),
                less(text, UPPER).cast("long").alias("n_upper"),
                less(text, "!").cast("long").alias("n_shouts"),
                less(text, "|").cast("long").alias("n_bars"),
            ),
        )
    )
    stats = F.struct(
        "_w.n_words",
        (F.col("_c.n_chars") - F.col("_c.n_blank")).cast("long").alias("word_chars"),
        "_c.n_symbols",
        "_l.n_dup_lines",
        "_w.n_repeat_words",
        "_c.n_chars",
        "_c.n_upper",
        "_c.n_shouts",
        "_c.n_bars",
        "_l.n_lines",
        "_w.n_distinct",
    )
    return counted.withColumn("stats", stats).drop("_w", "_l", "_c")


def features(stats: Column) -> dict[str, Column]:
    """Whole numbers, so thresholds read well: per mille of words, characters or lines."""
    rate = lambda a, b: F.floor(1000 * stats[a] / F.greatest(stats[b], F.lit(1)))
    exprs = {
        "n_words": stats["n_words"],
        "mean_chars": rate("word_chars", "n_words"),
        "symbols": rate("n_symbols", "n_words"),
        "upper": rate("n_upper", "word_chars"),
        "shouts": rate("n_shouts", "n_words"),
        "bars": rate("n_bars", "n_words"),
        "dup_lines": rate("n_dup_lines", "n_lines"),
        "repeats": rate("n_repeat_words", "n_words"),
        "distinct": rate("n_distinct", "n_words"),
    }
    return {k: v.cast("long") for k, v in exprs.items()}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self, at: dict[str, Column]) -> Column:
        return at[self.feature] >= self.threshold if self.above else at[self.feature] <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.threshold}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a text that none covers is kept."""

    rules: tuple[tuple[Condition, ...], ...]

    def column(self, stats: Column) -> Column:
        """The first rule that covers the text, as text; null if none does."""
        at = features(stats)
        out = None
        for rule in self.rules:
            holds = rule[0].column(at)
            for c in rule[1:]:
                holds = holds & c.column(at)
            name = F.lit(" and ".join(map(str, rule)))
            out = F.when(holds, name) if out is None else out.when(holds, name)
        return F.lit(None).cast("string") if out is None else out


def learn(x: np.ndarray, bad: np.ndarray, names: tuple[str, ...] = FEATURES, precision: float = 0.97, least: int = 5, max_rules: int = 12) -> DecisionList:
    """Sequential covering: grow a conjunction by information gain, prune it on held-out rows, remove what it covers.

    x: rows by features; bad: what rules should cover. A rule enters if on the pruning third its
    precision is at least `precision` and it covers `least` bad rows of all left. Ties go to the
    first feature, the smaller threshold and the upper side.
    """
    third = np.arange(len(bad)) % 3 == 2
    left = np.ones(len(bad), bool)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65), method="nearest")) if len(bad) else [] for j in range(x.shape[1])]
    rules: list[tuple[Condition, ...]] = []

    def holds(rule: list[tuple[int, bool, int]], rows: np.ndarray) -> np.ndarray:
        out = np.ones(len(rows), bool)
        for j, above, t in rule:
            out &= rows[:, j] >= t if above else rows[:, j] <= t
        return out

    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        gx, gy = x[grow], bad[grow]
        if gy.sum() < least:
            break
        rule: list[tuple[int, bool, int]] = []
        inside = np.ones(len(gy), bool)
        while len(rule) < 4 and (~gy[inside]).any():
            p0, n0 = gy[inside].sum(), inside.sum()
            base, best = np.log2(p0 / n0), (1e-9, None)
            for j, ts in enumerate(cuts):
                values = gx[inside, j]
                good = values[gy[inside]]
                order, order_bad = np.sort(values), np.sort(good)
                for above in (True, False):
                    n = len(order) - np.searchsorted(order, ts, "left") if above else np.searchsorted(order, ts, "right")
                    p = len(order_bad) - np.searchsorted(order_bad, ts, "left") if above else np.searchsorted(order_bad, ts, "right")
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(p >= least, p * (np.log2(p / np.maximum(n, 1)) - base), -1.0)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0] + 1e-9:
                        best = (gain[k], (j, above, int(ts[k])))
            if best[1] is None:
                break
            rule.append(best[1])
            inside &= holds(rule[-1:], gx)
        if not rule:
            break

        def worth(r: list[tuple[int, bool, int]]) -> float:
            hit = holds(r, x[prune])
            p = bad[prune][hit].sum()
            return (2 * p - hit.sum()) / max(1, hit.sum())

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        hit = holds(rule, x[prune])
        covered = holds(rule, x) & left
        if not hit.any() or bad[prune][hit].mean() < precision or bad[covered].mean() < precision or bad[covered].sum() < least:
            break
        rules.append(tuple(Condition(names[j], above, t) for j, above, t in rule))
        left &= ~covered
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> DecisionList:
    """Rules for quality 0, from at most max_rows labelled documents (those whose md5(doc_id) comes first).

    A few whole numbers of each of these rows reach the driver. Null labels are left out; without labels there are no rules.
    """
    some = (
        labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(max_rows)
    )
    held = statistics(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))  # max_rows rows at most
    at = features(F.col("stats"))
    rows = held.select("doc_id", "_quality", *[at[f].alias(f) for f in FEATURES]).collect()
    rows.sort(key=lambda r: tuple(r))
    table = np.array([r[2:] for r in rows], np.int64).reshape(len(rows), len(FEATURES))
    return learn(table, np.array([r[1] == 0 for r in rows], bool))


def apply_rules(docs: DataFrame, rules: DecisionList, min_words: int = 50, max_repeats: int = 50) -> DataFrame:
    """docs with stats, base_failed, rule (the first that covers it, or null) and kept.

    base_failed: fewer than min_words words, or more than max_repeats per cent of them repeated.
    Every row stays, in any number; a null text fails. Existing columns of these names are replaced.
    """
    out = statistics(docs.drop("stats", "base_failed", "rule", "kept"))
    s = F.col("stats")
    failed = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > max_repeats * s["n_words"])
    out = out.withColumn("base_failed", failed).withColumn("rule", rules.column(s))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
