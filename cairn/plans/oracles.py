"""DuckDB SQL for the registered queries, over the same adapters."""

from __future__ import annotations

from cairn.operators import replies
from cairn.plans.catalogue import QUERY_VECTOR, TODAY
from cairn.sources.adapters import with_adapters
from cairn.vocabulary import ENGLISH, SPANISH

_TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"
_VECTOR = "CAST([" + ", ".join(map(str, QUERY_VECTOR)) + "] AS DOUBLE[])"
_EN = ", ".join(f"'{w}'" for w in ENGLISH)
_ES = ", ".join(f"'{w}'" for w in SPANISH)

#: Documents and written-out conversations, and whether they have the shape of a transcript.
_SHAPES = r"""made AS (
  SELECT doc_id, 'Notes' AS title, text AS body FROM documents
  UNION ALL SELECT -1 - conv_id, CASE WHEN conv_id % 3 = 0 THEN 'Weekly standup' ELSE 'Chat' END, string_agg(concat(line, chr(10), line, chr(10), line), chr(10) ORDER BY turn, role, concat(line, chr(10), line, chr(10), line)) FROM (
    SELECT conv_id, turn, role, concat(CASE WHEN conv_id % 5 = 0 THEN upper(role) ELSE role END, ': ', regexp_replace(text, '[\r\n]+', ' ', 'g'),
      CASE WHEN conv_id % 7 = 0 THEN concat(chr(10), 'and so on, at length', chr(10), 'and more') ELSE '' END) AS line FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), lines AS (SELECT doc_id, unnest(string_split(coalesce(body, ''), chr(10))) AS line FROM made),
labels AS (SELECT doc_id, trim(regexp_extract(line, '^\s{0,4}(?:[\[(]\d{1,2}:\d{2}(?::\d{2})?[\])]\s+|\d{1,2}:\d{2}(?::\d{2})?\s+)?([^\s:#\->*+|`][^:\n]{0,39}):\s+\S', 1)) AS label
  FROM lines WHERE regexp_matches(line, '[^ \t\r\x0b\x0c]')),
named AS (SELECT doc_id, CASE WHEN label <> '' AND len(regexp_split_to_array(label, '\s+')) <= 3 AND NOT regexp_matches(label, '\d')
  AND NOT (length(label) >= 3 AND label = upper(label) AND label <> lower(label)) THEN label END AS label FROM labels),
per AS (SELECT doc_id, label, count(*) AS n FROM named GROUP BY doc_id, label),
agg AS (SELECT doc_id, count(*) FILTER (label IS NOT NULL AND n >= 3) AS speakers, CAST(coalesce(sum(n) FILTER (label IS NOT NULL AND n >= 3), 0) AS BIGINT) AS recurring, CAST(sum(n) AS BIGINT) AS lines FROM per GROUP BY doc_id),
shape AS (SELECT made.doc_id, coalesce(speakers, 0) AS speakers, coalesce(recurring, 0) AS recurring, coalesce(lines, 0) AS lines,
  coalesce(speakers >= 2 AND recurring >= 10 AND 2 * recurring >= lines, FALSE) AS is_transcript FROM made LEFT JOIN agg ON agg.doc_id = made.doc_id)"""


def _with(names: str, rest: str) -> str:
    return f"WITH RECURSIVE {with_adapters(*names.split())}{', ' if names and rest.lstrip().startswith('*') else ' '}{rest.lstrip().removeprefix('*')}"


def _bm25(source: str, text: str, phrases: list[list[str]], limit: int) -> str:
    """Rows (concept_id, score, rank) of the best documents; source: a FROM clause with concept_id and the text."""
    counts = []
    for i, p in enumerate(phrases):
        hit = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(p))
        counts.append(f"len(list_filter(range(1, len(t) + 1), lambda i: coalesce({hit}, false))) AS f{i}")
    idf = "ln((n - n{0} + 0.5) / (n{0} + 0.5))"
    parts = [f"(CASE WHEN {idf.format(i)} > 0 THEN {idf.format(i)} ELSE 1e-6 END) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(phrases))]
    return f"""SELECT concept_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9), concept_id) AS INT) AS rank FROM (
  SELECT concept_id, -({' + '.join(parts)}) AS score FROM (
    SELECT concept_id, len(t) AS dl, {', '.join(counts)} FROM (SELECT concept_id, {_TOKENS.format(text)} AS t FROM {source})
  ) c, (
    SELECT count(*) AS n, avg(len(t)) AS avgdl, {', '.join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(phrases)))} FROM (
      SELECT t, {', '.join(counts)} FROM (SELECT {_TOKENS.format(text)} AS t FROM {source}))
  ) s WHERE {' OR '.join(f'f{i} > 0' for i in range(len(phrases)))}
) ORDER BY score, concept_id LIMIT {limit}"""


_DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS concept_id, text FROM documents)"
_TERMS = [["inor"], ["heedthing"], ["erthes"], ["shea"]]
_PHRASES = [["of", "the"], ["in", "the"], ["and", "the"]]
_DIST = "round(list_distance(CAST(embedding AS DOUBLE[]), {}), 9)"
_FTS = f"fts AS ({_bm25('concepts', chr(39).join(['concat_ws(', ' ', ', title, body)']), _TERMS, 30)})"
_VEC = f"""vec AS (SELECT concept_id, row_number() OVER (ORDER BY d, concept_id) AS rank FROM (
  SELECT concat('documents/', CAST(vec_id AS VARCHAR)) AS concept_id, {_DIST.format(_VECTOR)} AS d FROM vectors) ORDER BY d, concept_id LIMIT 30)"""


def _fused(fts: str, vec: str) -> str:
    return f"""SELECT concept_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, concept_id) AS INT) AS rank FROM (
  SELECT concept_id, round(sum(1.0 / (60 + rank)), 12) * CASE WHEN starts_with(concept_id, 'insights/') THEN 0.5 ELSE 1.0 END AS score
  FROM (SELECT concept_id, min(rank) AS rank FROM {fts} GROUP BY 1 UNION ALL SELECT concept_id, min(rank) FROM {vec} GROUP BY 1) GROUP BY concept_id)"""


_TURN = "CASE WHEN CAST(regexp_extract(concept_id, '(\\d+)$', 1) AS BIGINT) % 2 = 0 THEN replace(concept_id, 'documents/', 'insights/') ELSE concept_id END"
_RANK = "CASE WHEN {0} IS NULL OR trim({0}) = '' THEN 1 WHEN trim({0}) = 'public' THEN 0 WHEN trim({0}) = 'private' THEN 1 ELSE 2 END"
_LEVEL = "CASE {} WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'confidential' END"
_DEPRECATED = """deprecated AS (SELECT concept_id FROM concepts WHERE status = 'deprecated'
  UNION SELECT target_id FROM relations WHERE relation_type = 'supersedes' AND source_id <> target_id)"""
_SENSITIVE = f"sensitive AS (SELECT concept_id FROM concepts WHERE sensitivity IS NULL OR trim(sensitivity) = '' OR {_RANK.format('sensitivity')} >= 2)"
_EDGES = """edges AS (
  SELECT DISTINCT l.source_id, l.target_id, CASE WHEN m.child IS NOT NULL THEN 'derived_from' END AS relation_type
  FROM links l LEFT JOIN mirror m ON m.child = l.source_id AND m.parent = l.target_id WHERE l.target_id IN (SELECT concept_id FROM nodes)
  UNION SELECT source_id, target_id, relation_type FROM relations WHERE relation_type <> 'supersedes' AND target_id IN (SELECT concept_id FROM nodes))"""
_BLOCKED = "blocked AS (SELECT concat('part/', CAST(p_partkey AS VARCHAR)) AS concept_id FROM part WHERE p_size > 45)"
_PAIRS = """pairs AS (SELECT DISTINCT least(source_id, target_id) AS id_a, greatest(source_id, target_id) AS id_b FROM edges
  WHERE relation_type <> 'derived_from' AND source_id <> target_id
    AND source_id NOT IN (SELECT concept_id FROM blocked) AND target_id NOT IN (SELECT concept_id FROM blocked))"""
_NEAR = f"""near AS (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY distance, neighbour_id) AS rank FROM (
  SELECT a.concept_id, b.concept_id AS neighbour_id, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance FROM vectors a, vectors b)
  QUALIFY rank <= 6)"""
_PROXIMITY = f"""{_NEAR}, proximity AS (SELECT least(concept_id, neighbour_id) AS id_a, greatest(concept_id, neighbour_id) AS id_b, min(distance) AS distance FROM (
  SELECT * FROM near WHERE concept_id <> neighbour_id AND distance <= sqrt(2 - 2 * 0.40) QUALIFY row_number() OVER (PARTITION BY concept_id ORDER BY distance, neighbour_id) <= 5) GROUP BY 1, 2)"""
_KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
_ELIGIBLE = f"""eligible AS (SELECT concat('part/', CAST(p_partkey AS VARCHAR)) AS concept_id, split_part(p_type, ' ', 1) AS type,
  CASE WHEN p_partkey % 499 = 0 THEN 'STANDARD' END AS type_alternative, {_KEY.format('p_name')} AS key FROM part WHERE p_size <> 50)"""
_STAMPED = """stamped AS (SELECT concat('orders/', CAST(o_orderkey AS VARCHAR)) AS path, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS stamp, o_orderstatus,
  CASE WHEN o_orderpriority LIKE '%URGENT' THEN 'volatile' WHEN o_orderpriority LIKE '%LOW' THEN 'static'
    ELSE CASE o_orderkey % 4 WHEN 0 THEN 'slow' WHEN 1 THEN 'volatile' WHEN 2 THEN 'static' END END AS tier FROM orders)"""
_TREE = "tree AS (SELECT * FROM provenance WHERE parent = floor(child / 2) AND (child % 10 <> 7 OR parent % 2 = 0))"
# With one parent each, ALL-closures are descendants.
_CLOSURES = """closures AS (SELECT x AS source, x AS id FROM range(2, 6) r(x) UNION SELECT c.source, t.child FROM closures c JOIN tree t ON t.parent = c.id)"""
_LEVELS = f"levels AS (SELECT doc_id AS id, {_RANK.format('s')} AS level FROM (SELECT doc_id, CASE WHEN doc_id < 6 THEN 'confidential' ELSE sensitivity END AS s FROM concepts))"
_MEMBER = "member AS (SELECT id, count(DISTINCT source) AS n, min(source) AS root FROM closures WHERE source <> id GROUP BY id)"
_RAISES = f"""leveled AS (SELECT doc_id AS id, doc_id BETWEEN 2 AND 5 AS is_source, CASE WHEN doc_id = 4 THEN 'private' WHEN doc_id < 6 THEN 'confidential' WHEN doc_id % 6 = 0 THEN 'secret' ELSE sensitivity END AS current FROM concepts),
  ranked AS (SELECT *, {_RANK.format('current')} AS level FROM leveled),
  raised AS (SELECT * FROM (SELECT c.source, o.id, o.current, {_LEVEL.format('greatest(o.level, s.level)')} AS new_level FROM closures c JOIN ranked o ON o.id = c.id JOIN ranked s ON s.id = c.source WHERE c.source <> c.id) WHERE new_level IS DISTINCT FROM current)"""
#: Every document of the tree has one parent, so the highest level it can be raised to is the highest on its way up, to a source at most.
_CITED = f"""open AS (SELECT child, parent FROM tree JOIN ranked o ON o.id = child AND NOT o.is_source WHERE parent IN (SELECT id FROM ranked)),
  way AS (SELECT child, parent FROM open UNION SELECT w.child, o.parent FROM way w JOIN open o ON o.child = w.parent),
  cited AS (SELECT * FROM (SELECT o.id, any_value(o.current) AS current, {_LEVEL.format('greatest(any_value(o.level), max(p.level))')} AS new_level FROM way JOIN ranked o ON o.id = child JOIN ranked p ON p.id = parent GROUP BY o.id) WHERE new_level IS DISTINCT FROM current)"""
_LEDGER = "ledger AS (SELECT DISTINCT l_orderkey AS survivor_id, l_linenumber AS seq, concat('a', CAST(l_linenumber AS VARCHAR)) AS absorbed_id FROM lineitem)"
_OBJECTS = f"objects AS (SELECT p_partkey % 40 AS source, split_part(p_type, ' ', 1) AS type, {_KEY.format('p_name')} AS key, p_size AS n_body, length(p_brand) AS n_desc, p_partkey AS pos FROM part)"


def _closure_all(depth: int = 24) -> str:
    """ALL-closure of 4..9 by unrolled rounds: enough for the depth of {n div 2, n div 3} up to 3 ** 24."""
    out = "r0 AS MATERIALIZED (SELECT x AS id FROM range(4, 10) t(x))"
    for i in range(1, depth + 1):
        out += f", r{i} AS MATERIALIZED (SELECT id FROM r{i - 1} UNION SELECT child FROM provenance p LEFT JOIN r{i - 1} s ON s.id = p.parent GROUP BY child HAVING count(*) = count(s.id))"
    return f"* {out} SELECT id FROM r{depth}"


def _high_water(depth: int = 20) -> str:
    """Levels rise along paths no longer than the depth of {n div 2, n div 3}."""
    out = f"""l0 AS MATERIALIZED (SELECT doc_id AS id, {_RANK.format('sensitivity')} AS level FROM concepts),
  ok AS MATERIALIZED (SELECT child FROM provenance WHERE child >= 4 GROUP BY child HAVING count(*) = count(*) FILTER (parent IN (SELECT doc_id FROM concepts)))"""
    for i in range(1, depth + 1):
        out += f""", l{i} AS MATERIALIZED (SELECT a.id, greatest(a.level, coalesce(max(b.level), 0)) AS level FROM l{i - 1} a
  LEFT JOIN (SELECT * FROM provenance WHERE child IN (SELECT child FROM ok)) p ON p.child = a.id LEFT JOIN l{i - 1} b ON b.id = p.parent GROUP BY a.id, a.level)"""
    return f"* {out} SELECT id, level FROM l{depth}"


ORACLES: dict[str, str] = {
    "bm25_topk": _bm25(_DOCS, "text", _TERMS, 20),
    "phrase_match": _bm25(_DOCS, "text", _PHRASES, 20),
    "postings_phrase": f"SELECT * FROM (SELECT concept_id, len(list_filter(range(1, len(t) + 1), lambda i: coalesce(t[i] = 'of' AND t[i + 1] = 'the', false))) AS n FROM (SELECT CAST(doc_id AS VARCHAR) AS concept_id, {_TOKENS.format('text')} AS t FROM documents)) WHERE n > 0",
    "index_statistics": f"SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS concept_id, len({_TOKENS.format('text')}) AS dl FROM documents) WHERE dl > 0",
    "fts_query_terms": rf"""SELECT doc_id, CASE WHEN len(c) > 0 THEN array_to_string(c, ' ') ELSE q END AS terms FROM (
  SELECT doc_id, q, list_filter(regexp_extract_all(q, '\p{{L}}+'), lambda w: lower(w) NOT IN ({_EN}, {_ES})) AS c FROM (SELECT doc_id, split_part(text, chr(10), 1) AS q FROM documents))""",
    "knn_l2": _with("vectors", f"SELECT concept_id, round(d, 6) AS distance, CAST(row_number() OVER (ORDER BY d, concept_id) AS INT) AS rank FROM (SELECT concept_id, {_DIST.format(_VECTOR)} AS d FROM vectors) ORDER BY d, concept_id LIMIT 20"),
    "neighbors_topk": _with("vectors", f"* {_NEAR} SELECT concept_id, neighbour_id, round(distance, 6) AS distance, CAST(rank AS INT) AS rank FROM near"),
    "proximity_pairs": _with("vectors", f"* {_PROXIMITY} SELECT id_a, id_b, round(distance, 6) AS distance FROM proximity"),
    "near_duplicate_questions": _with("vectors", f"SELECT concept_id, round(s, 6) AS similarity FROM (SELECT concept_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), {_VECTOR}), 9) AS s FROM vectors) WHERE s >= 0.2"),
    "rrf_fuse": _with("concepts vectors", f"* {_FTS}, {_VEC} {_fused('fts', 'vec')}"),
    "insight_penalty": _with("concepts vectors", f"* {_FTS}, {_VEC}, f2 AS (SELECT {_TURN} AS concept_id, rank FROM fts), v2 AS (SELECT {_TURN} AS concept_id, rank FROM vec) {_fused('f2', 'v2')}"),
    "retrieval_pool_filter_fuse": _with("concepts vectors relations", f"""* {_FTS}, {_VEC}, {_DEPRECATED}, {_SENSITIVE}, gone AS (SELECT * FROM deprecated UNION SELECT * FROM sensitive),
  f2 AS (SELECT concept_id, row_number() OVER (ORDER BY rank) AS rank FROM fts WHERE concept_id NOT IN (SELECT concept_id FROM gone)),
  v2 AS (SELECT concept_id, row_number() OVER (ORDER BY rank) AS rank FROM vec WHERE concept_id NOT IN (SELECT concept_id FROM gone))
  SELECT * FROM ({_fused('f2', 'v2')}) WHERE rank <= 10"""),
    "deprecated_set": _with("concepts relations", f"* {_DEPRECATED} SELECT concept_id FROM deprecated"),
    "egress_blocked": _with("concepts", f"* {_SENSITIVE} SELECT concept_id FROM sensitive"),
    "combine_sensitivity": _with("concepts", f"SELECT a.doc_id, {_LEVEL.format('greatest(' + _RANK.format('a.sensitivity') + ', ' + _RANK.format('b.sensitivity') + ')')} AS combined FROM concepts a JOIN concepts b ON b.doc_id + 1 = a.doc_id"),
    "merged_content_blocked": _with("concepts", f"SELECT doc_id, CASE WHEN sensitivity IS NULL THEN 2 ELSE {_RANK.format('sensitivity')} END >= 2 AS blocked FROM concepts"),
    "birth_sensitivity": _with("concepts", "SELECT concept_id, type, CASE type WHEN 'Person' THEN 'confidential' WHEN 'Decision' THEN 'private' ELSE 'public' END AS sensitivity FROM concepts"),
    "graph_edges": _with("nodes links relations mirror", f"* {_EDGES} SELECT * FROM edges"),
    "edge_summary": _with("nodes links relations mirror", f"* {_EDGES} SELECT count(*) AS total, count(relation_type) AS typed FROM edges WHERE split_part(source_id, '/', 1) IN ('nation', 'region', 'customer', 'orders', 'part') AND split_part(target_id, '/', 1) IN ('nation', 'region', 'customer', 'orders', 'part')"),
    "untyped_candidates": _with("nodes links relations mirror", f"""* {_EDGES}, {_BLOCKED} SELECT DISTINCT source_id, target_id FROM edges e WHERE relation_type IS NULL
  AND NOT EXISTS (SELECT 1 FROM edges t WHERE t.relation_type IS NOT NULL AND t.source_id = e.source_id AND t.target_id = e.target_id)
  AND source_id NOT IN (SELECT concept_id FROM blocked) AND target_id NOT IN (SELECT concept_id FROM blocked)"""),
    "candidate_edges": _with("vectors", f"""* {_PROXIMITY}, linked AS (SELECT concept_id AS a, concat('vec/', CAST(vec_id + 1 AS VARCHAR)) AS b FROM vectors WHERE vec_id % 3 = 0)
  SELECT id_a, id_b, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (ORDER BY distance, id_a, id_b) AS place FROM proximity p
    WHERE NOT EXISTS (SELECT 1 FROM linked WHERE least(a, b) = p.id_a AND greatest(a, b) = p.id_b)) WHERE place > 5 AND place <= 55"""),
    "contradiction_pairs": _with("nodes links relations mirror", f"* {_EDGES}, {_BLOCKED}, {_PAIRS} SELECT * FROM pairs"),
    "contradiction_budget": _with("nodes links relations mirror", f"""* {_EDGES}, {_BLOCKED}, {_PAIRS},
  merged AS (SELECT concat('part/', CAST(p_partkey AS VARCHAR)) AS id_a, 'merged' AS id_b FROM part WHERE p_size = 7),
  e AS (SELECT * FROM pairs QUALIFY row_number() OVER (ORDER BY id_a, id_b) <= 200 - least(50, (SELECT count(*) FROM merged)))
  SELECT 'edge' AS kind, id_a, id_b FROM e
  UNION ALL SELECT 'merged', id_a, id_b FROM (SELECT * FROM merged QUALIFY row_number() OVER (ORDER BY id_a, id_b) <= 200 - (SELECT count(*) FROM e))"""),
    "pair_relation_types": _with("nodes links relations mirror", f"""* {_EDGES} SELECT least(source_id, target_id) AS id_a, greatest(source_id, target_id) AS id_b, relation_type FROM edges
  WHERE relation_type IS NOT NULL AND source_id <> target_id
  QUALIFY row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY relation_type = 'derived_from', source_id, target_id, relation_type) = 1"""),
    "simple_digraph": _with("nodes links relations mirror", f"* {_EDGES} SELECT source_id, target_id, max(relation_type) AS relation_type FROM edges GROUP BY 1, 2"),
    "graph_adjacency": _with("nodes links relations mirror", f"* {_EDGES} SELECT target_id, relation_type FROM edges WHERE source_id = 'part/7'"),
    "inbound_references": _with("links relations", """SELECT source_id, 'link' AS how FROM links WHERE target_id = 'customer/3' UNION SELECT source_id, 'relation' FROM relations WHERE target_id = 'customer/3'
  UNION SELECT concat('part/', CAST(p_partkey AS VARCHAR)), 'unverifiable' FROM part WHERE p_partkey % 50 = 0 AND p_size % 5 = 3"""),
    "closure_any": _with("provenance", "* r AS (SELECT x AS id FROM range(4, 10) t(x) UNION SELECT child FROM r JOIN provenance ON parent = id) SELECT id FROM r"),
    "closure_all": _with("provenance", _closure_all()),
    "ancestors_sources": _with("provenance", """* r AS (SELECT x AS id FROM (VALUES (100), (151)) t(x) UNION SELECT parent FROM r JOIN provenance ON child = id)
  SELECT concat('sources/', CAST(id AS VARCHAR)) AS id FROM r WHERE id % 3 = 0"""),
    "highwater": _with("concepts provenance", _high_water()),
    "unresolvable_provenance": _with("provenance", "SELECT child, parent FROM provenance WHERE parent NOT IN (SELECT doc_id FROM documents WHERE doc_id % 7 <> 0)"),
    "best_raises": "SELECT l_orderkey AS id, CAST(max(l_linenumber % 3) AS INT) AS level, concat('p', CAST(arg_min(l_linenumber, l_linenumber - 100 * (l_linenumber % 3)) AS VARCHAR)) AS producer FROM lineitem GROUP BY 1",
    "exact_title_groups": f"WITH {_ELIGIBLE} SELECT key, string_agg(concept_id, ',' ORDER BY concept_id) AS members FROM eligible GROUP BY key HAVING count(*) >= 2",
    "bridge_pairs": f"WITH {_ELIGIBLE} SELECT DISTINCT least(a.concept_id, b.concept_id) AS id_a, greatest(a.concept_id, b.concept_id) AS id_b FROM eligible a JOIN eligible b ON b.type = a.type_alternative AND a.type_alternative <> a.type AND a.concept_id <> b.concept_id",
    "acronym_pairs": """WITH c AS (SELECT c_custkey AS n, CAST(floor(c_custkey / 2) AS BIGINT) % 26 AS k FROM customer),
  l AS (SELECT n, concat(substr('abcdefghijklmnopqrstuvwxyz', k % 26 + 1, 1), substr('abcdefghijklmnopqrstuvwxyz', k * 3 % 26 + 1, 1), substr('abcdefghijklmnopqrstuvwxyz', k * 5 % 26 + 1, 1)) AS a FROM c)
  SELECT 'Concept' AS type, least(x, y) AS id_a, greatest(x, y) AS id_b, a AS acronym FROM (
    SELECT concat('c/', CAST(p.n AS VARCHAR)) AS x, concat('c/', CAST(q.n AS VARCHAR)) AS y, p.a FROM l p JOIN l q ON p.a = q.a AND p.n % 2 = 0 AND q.n % 2 = 1)""",
    "sample_per_type": _with("concepts", "SELECT type, concept_id, substr(body, 1, 1000) AS body FROM concepts QUALIFY row_number() OVER (PARTITION BY type ORDER BY concept_id) <= 5"),
    "stale_stamps": f"""WITH {_STAMPED} SELECT 'stale-stamp' AS kind, path, concat(strftime(stamp, '%Y-%m-%d'), ' ', CAST(date_diff('day', stamp, DATE '{TODAY}') AS VARCHAR)) AS detail FROM stamped
  WHERE o_orderstatus <> 'P' AND coalesce(tier, 'fallback') <> 'static' AND date_diff('day', stamp, DATE '{TODAY}') > CASE tier WHEN 'slow' THEN 90 ELSE 7 END""",
    "orphans": _with("nodes links", "SELECT 'orphan' AS kind, concept_id AS path, '' AS detail FROM nodes WHERE concept_id NOT IN (SELECT target_id FROM links WHERE source_id <> target_id) AND concept_id NOT LIKE 'nation/%'"),
    "dangling_targets": _with("nodes links relations", """SELECT DISTINCT 'dangling-target' AS kind, source_id AS path, target_id AS detail FROM (
  SELECT source_id, target_id FROM relations WHERE relation_type <> 'supersedes' UNION SELECT source_id, target_id FROM links) WHERE source_id <> target_id AND target_id NOT IN (SELECT concept_id FROM nodes)"""),
    "dangling_provenance": _with("nodes mirror", "SELECT DISTINCT 'dangling-provenance' AS kind, child AS path, parent AS detail FROM mirror WHERE parent <> 'orders/14' AND parent NOT IN (SELECT concept_id FROM nodes)"),
    "unbacked_relations": _with("relations mirror", """SELECT DISTINCT 'unbacked-relation' AS kind, source_id AS path, target_id AS detail FROM relations r WHERE relation_type = 'derived_from'
  AND NOT EXISTS (SELECT 1 FROM mirror WHERE child = source_id AND parent = target_id)"""),
    "below_source": _with("concepts provenance", f"""* {_TREE}, {_CLOSURES}, {_LEVELS}, {_MEMBER}
  SELECT 'below-source-sensitivity' AS kind, m.id AS path, concat(CAST(m.root AS VARCHAR), ' ', {_LEVEL.format('s.level')}) AS detail
  FROM member m JOIN levels o ON o.id = m.id JOIN levels s ON s.id = m.root WHERE m.n = 1 AND o.level < s.level"""),
    "multi_source_uncovered": _with("concepts provenance", f"""* {_TREE}, {_CLOSURES}, {_LEVELS}, {_MEMBER}
  SELECT 'multi-source-uncovered' AS kind, c.child AS path, {_LEVEL.format('c.high')} AS detail FROM (
    SELECT child, max(level) AS high FROM tree LEFT JOIN levels ON id = parent GROUP BY child HAVING count(*) = count(level)) c JOIN levels o ON o.id = c.child
  WHERE o.level < c.high AND c.child NOT IN (SELECT id FROM member WHERE n = 1)"""),
    "source_raises": _with("concepts provenance", f"* {_TREE}, {_CLOSURES}, {_RAISES} SELECT source, id, current, new_level FROM raised"),
    "backfill_raises": _with("concepts provenance", f"""* {_TREE}, {_CLOSURES}, {_RAISES}, {_CITED}
  SELECT id, current, new_level, producer FROM (SELECT id, current, new_level, source, CAST(source AS VARCHAR) AS producer FROM raised UNION ALL SELECT id, current, new_level, 1000, 'cited' FROM cited)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_RANK.format('new_level')} DESC, source) = 1"""),
    "window_parse": """SELECT p_partkey, coalesce(d, 7) AS days, d IS NULL AS defaulted FROM (
  SELECT p_partkey, CASE WHEN p_size > 1 THEN CASE p_size % 3 WHEN 0 THEN 7 * (p_size - 1) WHEN 1 THEN p_size - 1 END END AS d FROM part)""",
    "manifest_hash": _with("concepts", "SELECT sha256(string_agg(concat(concept_id, chr(0), sha256(coalesce(body, '')), chr(10)), '' ORDER BY concept_id)) AS manifest FROM concepts"),
    "content_hash_cdc": _with("concepts", """SELECT concept_id, CASE WHEN doc_id % 11 = 0 THEN 'prune' WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'embed' ELSE 'hit' END AS action
  FROM concepts WHERE doc_id % 11 <> 0 OR doc_id % 5 <> 0"""),
    "finding_staleness": _with("concepts", """SELECT doc_id AS id, doc_id + 1 <= (SELECT max(doc_id) FROM concepts) AND (doc_id + 1) % 3 <> 0 AS stale FROM concepts"""),
    "adjudication_supersede": "SELECT event_id AS id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1",
    "catalogue_render": _with("concepts", """SELECT CASE type WHEN 'Concept' THEN 'Concepts' WHEN 'Person' THEN 'People' WHEN 'Decision' THEN 'Decisions' ELSE 'Sources' END AS section,
  sha256(string_agg(concat('- [', title, '](/', concept_id, '.md)'), chr(10) ORDER BY title, concept_id)) AS body_sha256 FROM concepts GROUP BY 1"""),
    "recent_log": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderkey AS pos, o_orderpriority FROM orders ORDER BY 1 DESC, 2 LIMIT 25",
    "nesting_violations": f"""WITH {_LEDGER} SELECT survivor_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY survivor_id ORDER BY seq) AS n FROM ledger) WHERE n <> seq""",
    "unwind_sequence": f"WITH {_LEDGER} SELECT seq, absorbed_id FROM ledger WHERE survivor_id = 7 AND seq >= (SELECT max(seq) FROM ledger WHERE survivor_id = 7 AND absorbed_id = 'a2')",
    "torn_writes": _with("concepts", "SELECT concept_id AS survivor_id, CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 THEN 'roll-forward' ELSE 'roll-back' END AS action FROM concepts WHERE doc_id % 9 = 0"),
    "basename_collisions": "SELECT concat(c_mktsegment, '-', CAST(c_nationkey AS VARCHAR), '.md') AS basename, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
    "slugs": """SELECT id, CASE WHEN n = 1 THEN s ELSE concat(s, '-', CAST(n AS VARCHAR)) END AS slug FROM (
  SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM (SELECT p_partkey AS id, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part))""",
    "survey_by_type": _with("concepts", "SELECT type, count(*) AS n FROM concepts GROUP BY type"),
    "list_objects": _with("concepts relations", rf"""* {_DEPRECATED} SELECT concept_id, 'documents' AS link_dir, trim(regexp_replace(title, '[ \t\r\n]+', ' ', 'g')) AS title, coalesce(sensitivity, 'unknown') AS sensitivity,
  CASE WHEN concept_id IN (SELECT concept_id FROM deprecated) THEN 'deprecated' ELSE 'active' END AS status FROM concepts ORDER BY concept_id LIMIT 50"""),
    "union_merge": f"WITH {_OBJECTS} SELECT source, type, key, pos, first_pos FROM (SELECT *, min(pos) OVER (PARTITION BY source, type, key) AS first_pos, row_number() OVER (PARTITION BY source, type, key ORDER BY n_body DESC, n_desc DESC, pos) AS rn FROM objects) WHERE rn = 1",
    "first_wins_merge": f"WITH {_OBJECTS} SELECT source, type, key, min(pos) AS pos FROM objects GROUP BY 1, 2, 3",
    "judge_admission": f"""WITH {_OBJECTS}, c AS (SELECT source, key, CASE type WHEN 'PROMO' THEN 'Procedure' WHEN 'LARGE' THEN 'Person' ELSE 'Concept' END AS type, pos, source % 2 = 0 AS meeting,
  EXISTS (SELECT 1 FROM objects s WHERE s.source = o.source AND s.key = o.key AND s.source % 4 <> 3 AND s.pos % 5 = 0) AS chosen FROM objects o),
  k AS (SELECT *, count(*) FILTER (chosen) OVER (PARTITION BY source) AS own FROM c)
  SELECT source, key, type, pos FROM k WHERE own = 0 OR chosen OR type = 'Procedure' OR (meeting AND type = 'Person') QUALIFY row_number() OVER (PARTITION BY source ORDER BY pos) <= 20""",
    "next_action_rank": _with("concepts", "SELECT CAST(3 AS INT) AS tier, 'sensitivity-gap' AS subject, count(*) AS n FROM concepts WHERE sensitivity IS NULL"),
    "transcript_shape": f"WITH {_SHAPES} SELECT * FROM shape",
    "dominant_language": rf"""SELECT doc_id, CAST(e AS INT) AS n_en, CAST(s AS INT) AS n_es, CASE WHEN e > 2 * s THEN 'en' WHEN s > 2 * e THEN 'es' END AS language FROM (
  SELECT doc_id, len(list_filter(w, lambda x: x IN ({_EN}))) AS e, len(list_filter(w, lambda x: x IN ({_ES}))) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-záéíóúüñ]+') AS w FROM documents))""",
    "extraction_cost": rf"""WITH {_SHAPES},
m AS (SELECT doc_id, body, regexp_matches(title, '(?i)\b(meeting|standup|retrospective|kickoff|huddle|reuni[oó]n(es)?)\b') OR is_transcript AS meeting FROM made JOIN shape USING (doc_id)),
l AS (SELECT *, length(body) > CASE WHEN meeting THEN 12000 ELSE 18000 END AS long FROM m),
w AS (SELECT *, CASE WHEN long THEN list_reduce(list_transform(string_split(body, chr(10)), lambda x: {{'n': CAST(1 AS BIGINT), 's': length(x) + 1}}),
  lambda a, b: CASE WHEN a.s + b.s > 4000 THEN {{'n': a.n + 1, 's': b.s}} ELSE {{'n': a.n, 's': a.s + b.s}} END).n ELSE 0 END AS windows FROM l)
SELECT concat('sources/', CAST(doc_id AS VARCHAR)) AS concept_id, CAST(windows AS BIGINT) AS windows, CAST(CASE WHEN long THEN windows ELSE 2 END + CASE WHEN meeting THEN 1 ELSE 0 END + 1 AS BIGINT) AS calls FROM w""",
    "verdict_parse": """SELECT event_id, CASE WHEN event_type = 'click' THEN CASE WHEN user_id % 3 = 0 THEN 'CONTRADICTS' ELSE 'UNCERTAIN' END WHEN event_type = 'view' THEN 'CONSISTENT' ELSE 'UNCERTAIN' END AS verdict,
  round(CASE WHEN event_id % 11 < 2 THEN 0.0 ELSE greatest(0.0, least(1.0, coalesce(value, 0) / 50)) END, 6) AS confidence FROM events""",
    "object_validation": """SELECT event_id, type, title, description, body, CASE WHEN other <> type THEN other END AS type_alternative FROM (SELECT event_id, event_id % 13 AS x, event_id % 17 AS j,
  CASE event_id % 7 WHEN 1 THEN 'Person' WHEN 4 THEN 'Concept' WHEN 5 THEN 'Concept' WHEN 6 THEN 'Concept' END AS type, CASE WHEN event_id % 11 > 1 THEN event_type END AS title,
  concat('d', CAST(event_id AS VARCHAR)) AS description, CASE event_id % 5 WHEN 0 THEN '' WHEN 3 THEN event_type WHEN 4 THEN event_type END AS body, CASE event_id % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Concept' END AS other
  FROM events) WHERE type IS NOT NULL AND title IS NOT NULL AND body IS NOT NULL AND x <> 0 AND j <> 0""",
    "relation_suggestions": f"""SELECT event_id, CASE WHEN j = 0 THEN NULL WHEN k = 0 THEN 'part_of' WHEN k > 3 THEN event_type END AS suggested_type,
  CASE WHEN j = 0 THEN '{replies.MALFORMED}' WHEN k = 1 THEN '{replies.ENGINE_OWNED.replace("'", "''")}' WHEN k IN (2, 3) AND trim(r) = '' THEN '{replies.DEGRADED}' ELSE r END AS rationale
  FROM (SELECT event_id, event_type, event_id % 19 AS j, event_id % 6 AS k, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE concat('r', CAST(user_id AS VARCHAR)) END AS r FROM events)""",
    "volatility_suggestions": f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'slow' WHEN 3 THEN 'volatile' END AS suggested_tier,
  CASE WHEN p_partkey % 3 <> 0 THEN p_brand WHEN p_partkey % 4 IN (1, 2) THEN '{replies.DEGRADED}' ELSE '' END AS rationale FROM part""",
    "high_confidence_findings": "SELECT event_id FROM events WHERE event_type = 'click' AND least(1.0, value / 50) >= 0.7",
    "type_alias": """SELECT a.asked, a.d AS link_dir, count(*) AS n FROM (VALUES ('people', 'people', 0), ('Person', 'people', 0), ('Source', 'sources', 2)) a(asked, d, k) JOIN part ON p_size % 3 = k GROUP BY 1, 2""",
    "undeclined_findings": "SELECT o_orderkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey WHERE c_custkey IS NULL OR c_custkey % 3 <> 1",
    "merged_body_candidates": f"""WITH {_LEDGER} SELECT concat('orders/', CAST(survivor_id AS VARCHAR)) AS survivor_id, seq, concat('orders/', CAST(survivor_id AS VARCHAR), ':survivor_before=', substr(sha256(concat('before ', CAST(seq AS VARCHAR))), 1, 8), ',',
  absorbed_id, ':absorbed_snapshot=', substr(sha256(concat('body of ', absorbed_id)), 1, 8)) AS digests FROM ledger JOIN orders ON o_orderkey = survivor_id WHERE survivor_id % 5 <> 0 AND o_orderstatus <> 'P'""",
    "served_verdicts": _with("concepts", """SELECT doc_id, CAST(CASE WHEN a THEN 1 ELSE 0 END + CASE WHEN b THEN 1 ELSE 0 END + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INT) AS n_inputs,
  CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 <> 0 THEN 'new' END WHEN NOT a AND NOT b AND doc_id % 2 <> 0 THEN 'old' END AS verdict
  FROM (SELECT doc_id, doc_id % 7 <> 0 AS a, (doc_id + 1) % 7 <> 0 AND doc_id + 1 IN (SELECT doc_id FROM concepts) AS b FROM concepts)"""),
    "deepest_stack": f"WITH {_LEDGER} SELECT max(n) AS max_entries FROM (SELECT count(*) AS n FROM ledger GROUP BY survivor_id)",
    "sensitivity_gaps": _with("concepts", "SELECT concept_id FROM concepts WHERE sensitivity IS NULL AND doc_id % 4 <> 0"),
    "resource_shape": "SELECT p_partkey, CASE p_size % 6 WHEN 1 THEN 'parent' WHEN 2 THEN 'backslash' WHEN 3 THEN 'missing' WHEN 4 THEN 'shape' WHEN 5 THEN 'missing' END AS reason FROM part",
    "titleize": "SELECT p_partkey, replace(p_type, ' ', ' ') AS title FROM part",
    "decision_keys": "SELECT n_nationkey, substr(sha256(concat(least(n_name, r), chr(0), greatest(n_name, r))), 1, 32) AS decision_key FROM (SELECT *, concat('region/', CAST(n_regionkey AS VARCHAR)) AS r FROM nation)",
    "merge_relations": """WITH r AS (SELECT n_nationkey AS k, unnest([[n_regionkey, 0, 0], [n_nationkey + 1, 1, 0], [n_nationkey, 2, 0], [99, 1, 0], [n_nationkey, 1, 1], [n_regionkey, 0, 1], [n_nationkey + 1, 1, 1], [99, 0, 1]]) AS t FROM nation),
  d AS (SELECT DISTINCT k, concat('n/', CAST(t[1] AS VARCHAR)) AS target, CASE t[2] WHEN 0 THEN 'part_of' WHEN 1 THEN 'references' ELSE 'depends_on' END AS type FROM r WHERE t[1] <> 99 AND (t[3] = 0 OR t[1] <> k))
  SELECT n_nationkey, coalesce(string_agg(concat(target, ':', type), ',' ORDER BY target, type), '') AS relations FROM nation LEFT JOIN d ON k = n_nationkey GROUP BY 1""",
    "union_dedup_lists": "SELECT p_partkey, concat_ws('|', p_brand, p_name, p_brand, p_type) AS merged FROM part",
    "attribution_split": """SELECT event_id, concat('Answer ', CAST(event_id AS VARCHAR)) AS prose, CASE WHEN k = 0 OR (k > 1 AND len(n) > 0) THEN 'reported' ELSE 'unparsed' END AS status, CASE WHEN k > 1 THEN array_to_string(n, ',') ELSE '' END AS used
  FROM (SELECT event_id, event_id % 13 AS k, list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda x: x BETWEEN 1 AND 4) AS n FROM (SELECT event_id, event_id % 7 AS a, user_id % 5 AS b FROM events))""",
    "chunk_windows": """WITH r AS (SELECT doc_id, list_reduce(list_transform(string_split(text, chr(10)), lambda x: {'done': CAST([] AS BIGINT[]), 's': CAST(length(x) + 1 AS BIGINT)}),
  lambda a, b: CASE WHEN a.s + b.s > 4000 THEN {'done': list_append(a.done, a.s - 1), 's': b.s} ELSE {'done': a.done, 's': a.s + b.s} END) AS r FROM documents WHERE text IS NOT NULL),
  w AS (SELECT doc_id, list_append(r.done, r.s - 1) AS w FROM r) SELECT doc_id, CAST(unnest(range(len(w))) AS INT) AS "window", CAST(unnest(w) AS INT) AS n_chars FROM w""",
    "json_replies": """SELECT event_id, concat('{"event": ', CAST(event_id AS VARCHAR), ', "props": "', event_type, '"}') AS object FROM events""",
    "streaming_latest": "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2",
}
