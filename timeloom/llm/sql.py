"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

from timeloom.llm.licenses import PHRASES, TEMPLATES

LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), posted AS (SELECT doc_id, len(s) AS n, md5(unnest(s)) AS h FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM posted a JOIN posted b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(doc_id, other) AS (
  SELECT a, b FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
), least AS (SELECT doc_id, min(other) AS low FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, coalesce(low, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(low, s.doc_id)) AS kept
FROM sets s LEFT JOIN least USING (doc_id)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
    AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


FILL_IN_MIDDLE = """
WITH parts AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS p,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents
), cut AS (
  SELECT doc_id, t, list_filter(list_transform(p, lambda x, i: CASE WHEN i < len(p) THEN x || chr(10) ELSE x END),
      lambda x: x <> '') AS l,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || d[i:i + 7])::BIGINT) AS h FROM parts
), ranks AS (
  SELECT *, len(l) AS n, least(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS low,
    greatest(h[1] % (len(l) + 1), h[2] % (len(l) + 1)) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100
      THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut
), pieces AS (
  SELECT *, array_to_string(l[1:low], '') AS pre, array_to_string(l[low + 1:high], '') AS mid,
    array_to_string(l[high + 1:], '') AS suf FROM ranks
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""


def _crc32(text: str) -> str:
    """The crc32 of a short ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT)"
    bit = "CASE WHEN b & 1 = 1 THEN xor(b >> 1, 3988292384) ELSE b >> 1 END"
    byte = f"list_reduce(list_prepend(xor(a, x), range(8)), lambda b, i: {bit})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, x: {byte}), 4294967295)"


PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list({{'d': d, 'n': n}} ORDER BY turn NULLS FIRST, d) AS l FROM (
    SELECT conv_id, turn, strlen(coalesce(text, '')) AS n,
      md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
    FROM conversations WHERE conv_id IS NOT NULL) GROUP BY conv_id
), drawn AS (SELECT conv_id, l, ({_crc32('conv_id::VARCHAR')} % 9)::BIGINT AS h FROM own
), built AS (
  SELECT o.conv_id, list_concat(coalesce(b.l, [])[1:h], o.l[h + 1:]) AS p
  FROM drawn o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), prefixes AS (
  SELECT conv_id, len(p) AS whole, depth, list_transform(p[1:depth], lambda x: x.d) AS path,
    CASE WHEN depth = 0 THEN 0 ELSE p[depth].n END AS size
  FROM built, unnest(range(0, len(p) + 1)) AS u(depth)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = depth), '') AS ends
  FROM prefixes GROUP BY path, depth
), children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
), sums AS (
  SELECT n.path[1:up] AS path, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS leaves,
    sum((n_convs - 1) * size) AS saved
  FROM nodes n LEFT JOIN children c ON n.path = c.path, unnest(range(0, n.depth + 1)) AS u(up) GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n, 0)::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
  sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums ON n.path = sums.path LEFT JOIN children c ON n.path = c.path
LEFT JOIN nodes up ON n.depth > 0 AND up.path = n.path[1:n.depth - 1]
"""


def _values(rows: list[str]) -> str:
    return ", ".join(rows)


def _licenses(threshold: str = "0.8") -> str:
    def some(text: str) -> str:
        return f"{sorted(set(text.split()))!r}::VARCHAR[]"

    templates = _values([f"('{t.label}', {some(t.notice)}, {len(t.notice.split())}, {some(t.telling)}, {some(t.foreign)})"
                         for t in TEMPLATES])
    phrases = _values([f"('{label}', {words!r}, {len(words)})" for label, words in PHRASES.items()])
    cut = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
    split = "list_filter(regexp_split_to_array({0}, '" + cut + "'), lambda x: x <> '')"
    return f"""
WITH low AS (SELECT doc_id, {LOWER} AS t FROM documents),
words AS (SELECT doc_id, t, {split.format('t')} AS w FROM low),
templates(label, tokens, n, telling, foreigns) AS (VALUES {templates}),
phrases(label, p, n) AS (VALUES {phrases}),
places AS (
  SELECT doc_id, label, i - 1 AS place FROM words, phrases, unnest(range(1, len(w) + 1)) AS u(i)
  WHERE contains(t, 'license') AND w[i:i + n - 1] = p
), base AS (
  SELECT doc_id, count(DISTINCT place) AS n_base, min(place) AS first_word, max(place) AS last_word,
    list(DISTINCT label) AS labels FROM places GROUP BY doc_id
), blocks AS (
  SELECT doc_id, label, tokens, telling, foreigns, ceil({threshold} * len(tokens) - 1e-9) AS need,
    list_distinct(w[i:i + n - 1]) AS b
  FROM words JOIN templates ON list_has_all(w, telling), unnest(range(1, len(w) + 1)) AS u(i)
  WHERE list_contains(tokens, w[i])
), matches AS (
  SELECT doc_id, label, len(list_intersect(b, tokens)) / len(tokens) AS share,
    len(list_intersect(b, tokens)) AS shared, need
  FROM blocks WHERE list_has_all(b, telling) AND NOT list_has_any(b, foreigns)
), more AS (
  SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM matches WHERE shared >= need GROUP BY doc_id
)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []),
    coalesce(more.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(more.share, 0)::DOUBLE END AS score
FROM words w LEFT JOIN base ON w.doc_id = base.doc_id LEFT JOIN more ON w.doc_id = more.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_near_duplicates": NEAR_DUPLICATES, "op7_top_k": TOP_K, "op10_licenses": _licenses(),
            "op11_fill_in_middle": FILL_IN_MIDDLE, "op12_prefix_trie": PREFIX_TRIE}
