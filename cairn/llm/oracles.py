"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from cairn.llm.queries import PROBE

SPACE = r"[\x20\x09-\x0D]+"

#: Control strings as in chat.CONTROL.
_CONTROL = r"([\[<])(/?INST\]|/?s>|/?ROLE\]|TEXT\]|NEXT\])"


def _escaped(column: str) -> str:
    return rf"regexp_replace(replace({column}, '\', '\\'), '{_CONTROL}', '\1\\\2', 'g')"


OP10 = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), l AS (
  SELECT *, length({_escaped("text")}) AS n_body,
    CASE WHEN before IS NOT DISTINCT FROM role THEN 6 WHEN role = 'user' THEN 7 WHEN role = 'assistant' THEN 3 ELSE 12 + length({_escaped("role")}) END
    + CASE WHEN after IS NOT DISTINCT FROM role THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 4 ELSE 7 END AS n_control
  FROM o
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n_body + n_control) AS BIGINT) AS formatted_chars
FROM l GROUP BY conv_id
"""


OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


OP5 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT u, min(v) AS m FROM r GROUP BY u) m ON m.u = w.doc_id
"""

OP7 = """
WITH RECURSIVE c AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
x AS (SELECT s, (1024 - (SELECT count(*) FROM c)) * sqrt(n) / (SELECT sum(sqrt(n)) FROM c) AS e FROM c),
h AS (SELECT s, CAST(1 + floor(e) + CASE WHEN row_number() OVER (ORDER BY floor(e) - e, s) <= 1024 - (SELECT sum(1 + floor(e)) FROM x) THEN 1 ELSE 0 END AS BIGINT) AS share FROM x),
a AS (SELECT list(share ORDER BY s) AS k, list(s ORDER BY s) AS names FROM h),
t AS (
  SELECT CAST(-1 AS BIGINT) AS slot, list_transform(k, lambda y: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS pick FROM a
  UNION ALL
  SELECT slot + 1, list_transform(range(1, len(k) + 1), lambda i: done[i] + CASE WHEN i = next THEN 1 ELSE 0 END), next FROM (
    SELECT slot, done, k, list_min(list_transform(range(1, len(k) + 1), lambda i: CASE WHEN done[i] * 1024 // k[i] <= slot + 1
      THEN ((done[i] + 1) * 1024 + k[i] - 1) // k[i] * 100000 + i ELSE 900000000000000 END)) % 100000 AS next FROM t, a WHERE slot < 1023)
), z AS (SELECT a.names[pick] AS s, slot, done[pick] - 1 AS turn FROM t, a WHERE slot >= 0),
d AS (SELECT doc_id, source, coalesce(source, '') AS mix_source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS i FROM documents)
SELECT d.doc_id, d.source, d.mix_source, d.i // 16 AS mix_block, d.i // 16 // h.share * 1024 + z.slot AS mix_slot, d.i % 16 AS mix_pos
FROM d JOIN h ON h.s = d.mix_source JOIN z ON z.s = d.mix_source AND z.turn = d.i // 16 % h.share
"""


def _nibbles() -> list[int]:
    """The CRC-32 remainder of each value of four bits."""
    out = list(range(16))
    for _ in range(4):
        out = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in out]
    return out


def _crc32(text: str) -> str:
    half = lambda x: f"xor({x} >> 4, {_nibbles()}[({x} & 15) + 1])"
    step = half(half("xor(a, b)"))
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: {step}), 4294967295)"


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Histories begin with ' ' and texts end with '', neither of which is a word.
OP8 = f"""
WITH x AS (SELECT doc_id, {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 1 AS held_out, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, held_out, unnest(list_prepend(' ', w)) AS h, unnest(list_append(w, '')) AS w FROM x),
u AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
n AS (SELECT l, list_transform(range(1, 7), lambda r: CAST(len(list_filter(cs, lambda c: c = r)) AS DOUBLE)) AS n
  FROM (SELECT 1 AS l, list(c) FILTER (c <= 6) AS cs FROM u UNION ALL SELECT 2, list(c) FILTER (c <= 6) FROM b)),
g AS (SELECT l, r, list_extract(n, r) AS m FROM n, (SELECT unnest(range(1, 7)) AS r)),
f AS (SELECT l, CASE WHEN count(*) FILTER (m > 0) > 1 THEN least(-1.1, regr_slope(ln(m), ln(r)) FILTER (m > 0)) ELSE -2.0 END AS slope FROM g GROUP BY l),
y AS (SELECT l, k, list_transform(range(1, 6), lambda r: ((r + 1) * m[r + 1] / (r * m[r]) - 6 * m[6] / m[1]) / (1 - 6 * m[6] / m[1])) AS d
  FROM (SELECT l, 0 AS k, n AS m FROM n UNION ALL SELECT l, 1, list_transform(range(1, 7), lambda r: pow(r, slope)) FROM f)),
d AS (SELECT l, arg_min(d, k) AS d FROM y WHERE k = 1 OR len(list_filter(d, lambda z: z > 0 AND z < 1 AND NOT isnan(z))) = 5 GROUP BY l),
v AS (SELECT u.w, u.c, CASE WHEN c > 5 THEN c ELSE d[c] * c END AS kept FROM u, d WHERE l = 1),
s AS (SELECT sum(c) AS n, count(*) AS v, sum(c) + CAST(min(c) > 5 AS INT) AS divisor, sum(kept) AS mass FROM v),
p AS (SELECT w, c, kept / divisor AS p FROM v, s),
q AS (SELECT h, b.w, b.c, CASE WHEN b.c > 5 THEN b.c ELSE d[b.c] * b.c END AS kept, p.p FROM b JOIN p ON p.w = b.w, d WHERE l = 2),
a AS (SELECT h, sum(c) + CAST(min(c) > 5 AS INT) AS divisor, (1 - sum(kept) / (sum(c) + CAST(min(c) > 5 AS INT))) / (1 - sum(p)) AS alpha FROM q GROUP BY h)
SELECT doc_id, held_out, count(*) AS n_tokens, count(p.c) AS n_known, CAST(any_value(s.n) AS BIGINT) AS train_tokens,
  sum(log10((coalesce(p.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))) AS base_score,
  sum(log10(CASE WHEN q.c IS NOT NULL THEN q.kept / a.divisor ELSE coalesce(a.alpha, 1) * coalesce(p.p, (1 - s.mass / s.divisor) / s.v) END)) AS score
FROM t LEFT JOIN p ON p.w = t.w LEFT JOIN q ON q.h = t.h AND q.w = t.w LEFT JOIN a ON a.h = t.h, s
GROUP BY doc_id, held_out
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_top_k": OP2, "op5_jaccard_join": OP5, "op7_mix_sources": OP7, "op8_katz_scores": OP8, "op10_chat_format": OP10}
