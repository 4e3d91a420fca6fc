"""Entity resolution: equal titles, acronyms, near matches, bridges between types, the capped report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions.text_udfs import acronym_match, near_match, normalize_key, word_ratio
from cairn.operators.fixpoint import cut


def eligible(concepts: DataFrame, deprecated: DataFrame, ascii_only: bool = False) -> DataFrame:
    """(concept_id, type, type_alternative, title, key): typed documents with a title, no sources, none deprecated."""
    from cairn.functions.expr import key_ascii

    if "type_alternative" not in concepts.columns:
        concepts = concepts.withColumn("type_alternative", F.lit(None).cast("string"))
    out = concepts.filter("type is not null and type <> 'Source' and trim(coalesce(title, '')) <> ''").join(deprecated.select("concept_id"), "concept_id", "left_anti")
    plain = F.col("title").rlike(r"^[\x00-\x7F]*$")
    key = key_ascii(F.col("title")) if ascii_only else F.when(plain, key_ascii(F.col("title"))).otherwise(normalize_key("title"))
    return out.select("concept_id", "type", "type_alternative", "title", key.alias("key"))


def same_title(docs: DataFrame) -> DataFrame:
    """(key, member_ids, member_types): titles that are one after normalising, across types; the empty key groups too."""
    held = F.array_sort(F.collect_list(F.struct("concept_id", "type")))
    groups = docs.groupBy("key").agg(held.alias("m")).filter(F.size("m") >= 2)
    return groups.select("key", F.col("m.concept_id").alias("member_ids"), F.col("m.type").alias("member_types"))


def lanes(docs: DataFrame, bridged: bool) -> DataFrame:
    """(lane, crossing, concept_id, type, key): every document in the lane of its type, and with bridged also, crossing, in that of the
    other type it might have been. Pairs are compared within a lane, one of them at most crossing."""
    own = docs.select(F.col("type").alias("lane"), F.lit(False).alias("crossing"), "concept_id", "type", "key")
    if not bridged:
        return own
    other = F.trim("type_alternative")
    return own.unionByName(docs.filter((other != "") & (other != F.col("type"))).select(other.alias("lane"), F.lit(True).alias("crossing"), "concept_id", "type", "key"))


def type_label(types: Column) -> Column:
    """The distinct types in order, joined by +."""
    return F.array_join(F.array_sort(F.array_distinct(types)), "+")


def _kinds(docs: DataFrame, *columns: str) -> DataFrame:
    """(concept_id, kinds): each document's distinct combinations of these columns; one, unless its id stands for several documents."""
    return docs.filter("concept_id is not null").groupBy("concept_id").agg(F.collect_set(F.struct(*columns)).alias("kinds"))


def _titled(docs: DataFrame) -> DataFrame:
    """The kinds that decide on acronyms and likeness: type, alternative type and key."""
    return _kinds(docs.withColumn("type_alternative", F.coalesce(F.trim("type_alternative"), F.lit(""))), "type", "type_alternative", "key")


def _kinds_as_docs(held: DataFrame) -> DataFrame:
    """One row per distinct kind, as a document whose id is the kind."""
    return held.select(F.explode("kinds").alias("concept_id")).distinct().select("concept_id", "concept_id.*")


def _lone(held: DataFrame) -> DataFrame:
    return held.filter("size(kinds) = 1").select(F.col("kinds")[0].alias("kind"), "concept_id")


def _side(members: DataFrame, k: str, c: str) -> DataFrame:
    return members.select(F.col("kind").alias(k), *[F.col(x).alias(c) for x in members.columns if x != "kind"])


def _spread(pairs: DataFrame, held: DataFrame, block: int = 1000) -> DataFrame:
    """Pairs of kinds (k1, k2, ...) as pairs of their documents (c1, c2, ...), for ids of one kind only: each such pair comes from one pair
    of kinds, so nothing is left to dedupe. Blocks of ids meet blocks of ids: no kind is bound to a task, and no pair is shuffled.
    Partitions are given by number, as their bytes don't tell how many pairs they make."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lone = _lone(held)
    sizes = lone.groupBy("kind").agg(F.ceil(F.count(F.lit(1)) / block).alias("n"))
    lone = lone.join(sizes, "kind").select("kind", F.pmod(F.xxhash64("concept_id"), "n").alias("b"), "concept_id")
    blocks = lone.groupBy("kind", "b").agg(F.collect_list("concept_id").alias("ids")).drop("b")
    met = pairs.join(_side(blocks, "k1", "ids"), "k1").join(_side(sizes, "k2", "n"), "k2").drop("k1")
    met = met.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n").repartition(n, "k2", "b")
    # A hash join: the one form that generated code runs through pair by pair; its tables are blocks of ids.
    there = lone.select(F.col("kind").alias("k2"), "b", F.col("concept_id").alias("c2")).repartition(n, "k2", "b").hint("shuffle_hash")
    return met.withColumn("c1", F.explode("ids")).drop("ids").join(there, ["k2", "b"]).drop("k2", "b")


def _spread_shared(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs that _spread leaves: those with an id of several kinds. The same pair may come from several pairs of kinds."""
    lone = _lone(held)
    shared = held.filter("size(kinds) > 1").select(F.explode("kinds").alias("kind"), "concept_id")
    one = pairs.join(_side(shared, "k1", "c1"), "k1").join(_side(shared.union(lone), "k2", "c2"), "k2")
    two = pairs.join(_side(shared, "k2", "c2"), "k2").join(_side(lone, "k1", "c1"), "k1")
    return one.unionByName(two).filter("c1 <> c2").drop("k1", "k2")


def _ids() -> list[Column]:
    return [F.least("c1", "c2").alias("id_a"), F.greatest("c1", "c2").alias("id_b")]


def acronym_pairs(docs: DataFrame, bridged: bool = False) -> DataFrame:
    """(type, id_a, id_b, acronym) within a type, or between types that alternative types bridge: found between kinds of documents, then
    spread over their members."""
    held = _titled(docs)
    kinds = _acronym_kinds(_kinds_as_docs(held), bridged)
    row = ["type", *_ids(), "acronym"]
    return _spread(kinds, held).select(*row).union(_least_acronym(_spread_shared(kinds, held).select(*row)))


def _least_acronym(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("type", "id_a", "id_b").agg(F.min("acronym").alias("acronym"))


def _acronym_kinds(docs: DataFrame, bridged: bool) -> DataFrame:
    """(type, k1, k2, acronym) with k1 < k2: blocked on the acronym, an equi-join of head words with runs of initials."""
    words = F.split("key", " ")
    from cairn.vocabulary import CONNECTIVES

    stops = F.array(*map(F.lit, CONNECTIVES))
    ends = F.array_min(F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(stops, w), i)), lambda i: i.isNotNull()))
    head = F.get(words, F.coalesce(ends, F.size(words)) - 1)
    held = lanes(docs, bridged)
    heads = held.withColumn("acronym", head).filter(F.length("acronym") >= 3)
    letters = F.transform(words, lambda w: F.substring(w, 1, 1))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.transform(F.sequence(F.lit(3), F.greatest(F.size(words) - i, F.lit(3))), lambda n: F.array_join(F.slice(letters, i + 1, n), ""))))
    spelled = held.filter(F.size(words) >= 3).select("lane", F.col("crossing").alias("crossing2"), F.col("type").alias("type2"), F.col("concept_id").alias("other"), F.col("key").alias("other_key"), F.explode(F.array_distinct(runs)).alias("acronym")).filter(F.length("acronym") >= 3)
    found = heads.join(spelled, ["lane", "acronym"]).filter("concept_id <> other and key <> other_key and not (crossing and crossing2)")
    pair = found.select(type_label(F.array("type", "type2")).alias("type"), F.least("concept_id", "other").alias("k1"), F.greatest("concept_id", "other").alias("k2"), "acronym")
    return pair.groupBy("type", "k1", "k2").agg(F.min("acronym").alias("acronym"))


def near_pairs(docs: DataFrame, bridged: bool = False) -> DataFrame:
    """(type, id_a, id_b, score) of titles alike word by word, within a type, or between types that alternative types bridge: found between
    kinds of documents, then spread over their members."""
    held = _titled(docs)
    kinds = _near_kinds(_kinds_as_docs(held), bridged)
    score = F.when(F.col("c1") < F.col("c2"), F.col("s12")).otherwise(F.col("s21"))
    row = ["type", *_ids(), score.alias("score")]
    return _spread(kinds, held).select(*row).union(_spread_shared(kinds, held).select(*row).distinct()).filter("score is not null")


def _near_kinds(docs: DataFrame, bridged: bool) -> DataFrame:
    """(type, k1, k2, s12, s21) with k1 < k2: the scores in both orders, null where one is no hit.

    Blocking loses no hit: a pair needs two words with a likeness of 0.75, so these share 3/8 of their letters taken
    together. A prefix filter over letters, the rare ones first, gives the word pairs that can; each is scored once, titles
    are joined through them, and each distinct pair of keys is scored exactly once.
    """
    held = lanes(docs, bridged)
    worded = held.select("lane", "crossing", "key").distinct().withColumn("w", F.explode(F.array_distinct(F.split("key", " ")))).filter("w <> ''")
    alike = _alike_words(worded.select("w").distinct())
    left = worded.withColumnRenamed("key", "k1").join(alike, "w")
    right = worded.filter("not crossing").select("lane", F.col("key").alias("k2"), F.col("w").alias("v"))
    pairs = left.join(right, ["lane", "v"])
    pairs = pairs.filter("k1 < k2 or (crossing and k1 <> k2)").select("lane", "crossing", "k1", "k2").distinct()
    # Scores depend on the order of the arguments: both are taken per pair of keys, before members are joined.
    keyed = pairs.select("k1", "k2").distinct().withColumn("s12", near_match("k1", "k2")).withColumn("s21", near_match("k2", "k1"))
    scored = pairs.join(keyed.filter("s12 is not null or s21 is not null"), ["k1", "k2"])
    left = scored.join(held.select("lane", "crossing", F.col("key").alias("k1"), F.col("concept_id").alias("c1"), F.col("type").alias("t1")), ["lane", "crossing", "k1"])
    both = left.join(held.filter("not crossing").select("lane", F.col("key").alias("k2"), F.col("concept_id").alias("c2"), F.col("type").alias("t2")), ["lane", "k2"])
    ahead = F.col("c1") < F.col("c2")
    s12, s21 = F.round("s12", 6), F.round("s21", 6)
    out = both.select(type_label(F.array("t1", "t2")).alias("type"), F.least("c1", "c2").alias("k1"), F.greatest("c1", "c2").alias("k2"), F.when(ahead, s12).otherwise(s21).alias("s12"), F.when(ahead, s21).otherwise(s12).alias("s21"))
    return out.distinct() if bridged else out


def _alike_words(words: DataFrame) -> DataFrame:
    """(w, v): equal words, and both orders of words whose likeness reaches 0.75 one way or the other."""
    letters = F.split("w", "")
    rare_first = F.lit("zqxjkvbpygfwmucldrhsnioate")
    gram = F.transform(letters, lambda c, i: F.struct(F.instr(rare_first, c).alias("r"), c.alias("c"), F.size(F.filter(F.slice(letters, F.lit(1), i + 1), lambda x: x == c)).alias("n")))
    least = F.ceil(0.375 * (F.length("w") + F.ceil(0.6 * F.length("w"))))
    prefix = F.slice(F.array_sort(gram), F.lit(1), (F.length("w") - least + 1).cast("int"))
    held = words.select("w", F.explode(prefix).alias("g"))
    pair = held.alias("a").join(held.alias("b"), (F.col("a.g") == F.col("b.g")) & (F.col("a.w") < F.col("b.w")))
    a, b = F.length("a.w"), F.length("b.w")
    pair = pair.filter((5 * F.least(a, b) >= 3 * F.greatest(a, b))).select(F.col("a.w").alias("w"), F.col("b.w").alias("v")).distinct()
    hit = pair.filter(F.greatest(word_ratio("w", "v"), word_ratio("v", "w")) >= 0.75)
    return hit.union(hit.select("v", "w")).union(words.select("w", F.col("w").alias("v")))


def bridge_pairs(docs: DataFrame) -> DataFrame:
    """(id_a, id_b) across types: one document's alternative type is the other's type. Found between kinds, then spread over their members."""
    held = _kinds(docs, "type", "type_alternative")
    kinds = _kinds_as_docs(held)
    a = kinds.filter("type_alternative is not null and type_alternative <> type").select(F.col("concept_id").alias("x"), "type_alternative")
    b = kinds.select(F.col("concept_id").alias("y"), F.col("type").alias("type_alternative"))
    pairs = a.join(b, "type_alternative").select(F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2")).distinct()
    return _spread(pairs, held).select(*_ids()).union(_spread_shared(pairs, held).select(*_ids()).distinct())


def _low(pairs: DataFrame, score: str, *columns: Column | str) -> DataFrame:
    return pairs.select(F.lit(2).alias("t"), F.lit("LOW").alias("tier"), F.format_number(score, 3).alias("trigger"), "type", F.round(score, 3).alias("s"), *columns)


def _acronym(pairs: DataFrame, *columns: Column | str) -> DataFrame:
    return pairs.select(F.lit(1).alias("t"), F.lit("ACRONYM").alias("tier"), F.col("acronym").alias("trigger"), "type", F.lit(0.0).alias("s"), *columns)


def report(docs: DataFrame, cap: int = 50) -> DataFrame:
    """(tier, trigger, type, member_ids, produced): HIGH groups across types, then ACRONYM and LOW pairs within types and across bridges, each
    pair once under its strongest tier. The cap best by (tier, -score, type, ids) stay, shown by (type, tier, ids); produced counts all groups.
    type joins the members' distinct types by +. LOW ranks by its score to three decimals.

    Pairs of kinds stand for their members' pairs, which are counted by products and written out only where they can be among the cap best.
    """
    held = cut(_titled(docs))
    acronyms, near = (cut(found(_kinds_as_docs(held), True)) for found in (_acronym_kinds, _near_kinds))
    below = near.join(acronyms.select("k1", "k2"), ["k1", "k2"], "left_anti")
    row = ["type", *_ids()]
    shared_acr = _least_acronym(_spread_shared(acronyms, held).select(*row, "acronym"))
    score = F.when(F.col("c1") < F.col("c2"), F.col("s12")).otherwise(F.col("s21"))
    shared_low = _spread_shared(near, held).select(*row, score.alias("score")).filter("score is not null").distinct().join(shared_acr.select("id_a", "id_b"), ["id_a", "id_b"], "left_anti")
    both = F.array("id_a", "id_b").alias("member_ids")
    groups = same_title(docs).select(F.lit(0).alias("t"), F.lit("HIGH").alias("tier"), F.col("key").alias("trigger"), type_label(F.col("member_types")).alias("type"), F.lit(0.0).alias("s"), "member_ids")
    groups = cut(groups.union(_acronym(shared_acr, both)).union(_low(shared_low, "score", both)))
    counts = groups.select(F.lit(1).cast("long").alias("n")).union(_n_pairs(acronyms, below, held))
    produced = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("produced"))
    # k1's ids stand before k2's from here on
    ways = _acronym(acronyms, "k1", "k2").union(_acronym(acronyms, "k2", "k1")).union(_low(below.filter("s12 is not null"), "s12", "k1", "k2")).union(_low(below.filter("s21 is not null"), "s21", "k2", "k1"))
    groups = groups.union(_best_pairs(ways, held, cap))
    order = ["t", F.desc("s"), "type", "member_ids"]
    top = groups.orderBy(*order).limit(cap).crossJoin(F.broadcast(produced))  # one row
    return top.orderBy("type", "t", "member_ids").select("tier", "trigger", "type", "member_ids", "produced")


def _n_pairs(acronyms: DataFrame, below: DataFrame, held: DataFrame) -> DataFrame:
    """(n,), to be summed: how many pairs of ids of one kind these pairs of kinds stand for, acronyms and scores in either order."""
    lone = _lone(held)
    sizes = lone.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    whole = acronyms.select("k1", "k2").union(below.filter("s12 is not null and s21 is not null").select("k1", "k2"))
    whole = whole.join(_side(sizes, "k1", "n1"), "k1").join(_side(sizes, "k2", "n2"), "k2").select((F.col("n1") * F.col("n2")).alias("n"))
    half = below.filter("s12 is not null and s21 is null").select("k1", "k2").union(below.filter("s12 is null and s21 is not null").select("k2", "k1"))
    sides = half.join(_side(lone, "k1", "c"), "k1").select("k1", "k2", "c", F.lit(1).alias("first")).unionByName(half.join(_side(lone, "k2", "c"), "k2").select("k1", "k2", "c", F.lit(0).alias("first")))
    ahead = F.sum("first").over(W.partitionBy("k1", "k2").orderBy("c").rowsBetween(W.unboundedPreceding, 0))
    return whole.union(sides.withColumn("n", ahead).filter("first = 0").select("n"))


def _best_pairs(ways: DataFrame, held: DataFrame, cap: int) -> DataFrame:
    """The cap best pairs of ids of one kind, k1's before k2's: first the pairs of kinds that can give one, by their first id, then the first
    ids, then the pairs. Each of what is kept gives a pair at least that stands before all pairs of what isn't."""
    lone = _lone(held)
    ends = lone.groupBy("kind").agg(F.min("concept_id").alias("a"), F.max("concept_id").alias("z"))
    pairs = ways.join(_side(ends.drop("z"), "k1", "a"), "k1").join(_side(ends.drop("a"), "k2", "z"), "k2").filter("a < z")
    firsts = _first(pairs, cap).drop("a").join(_side(lone, "k1", "a"), "k1").filter("a < z")
    out = _first(firsts, cap).join(_side(lone, "k2", "b"), "k2").filter("a < b").orderBy("t", F.desc("s"), "type", "a", "b").limit(cap)
    return out.select("t", "tier", "trigger", "type", "s", F.array("a", "b").alias("member_ids"))


def _first(pairs: DataFrame, cap: int) -> DataFrame:
    """The first cap by (t, -s, type, a), and all that are equal to one of them there."""
    keys = ["t", "s", "type", "a"]
    return pairs.join(pairs.orderBy("t", F.desc("s"), "type", "a").limit(cap).select(*keys).distinct(), keys, "left_semi")


def truncation_notice(produced: int, retained: int) -> str | None:
    """What to say when the cap left groups out."""
    return f"{retained} of {produced} candidate group(s) shown (cap reached)" if produced > retained else None


def acronyms_checked(docs: DataFrame) -> DataFrame:
    """acronym_pairs by the plain kernel, for pairs of one type; for small tables and tests."""
    a = docs.select("type", F.col("concept_id").alias("id_a"), F.col("key").alias("key_a"))
    b = docs.select("type", F.col("concept_id").alias("id_b"), F.col("key").alias("key_b"))
    pairs = a.join(b, "type").filter("id_a < id_b")
    return pairs.withColumn("acronym", acronym_match("key_a", "key_b")).filter("acronym is not null").select("type", "id_a", "id_b", "acronym")


def sample_by_type(concepts: DataFrame, n: int = 5, chars: int = 1000) -> DataFrame:
    """The first n documents of each type by id, bodies cut."""
    place = F.row_number().over(W.partitionBy("type").orderBy("concept_id"))
    return concepts.withColumn("place", place).filter(F.col("place") <= n).select("type", "concept_id", F.substring("body", 1, chars).alias("body"))
