"""SQL counterparts of the registered queries, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _mixing(passes: int = 3, copies: int = 3) -> str:
    steps = []
    for k in range(passes):
        steps.append(f"""
  gap{k} AS (SELECT source, first(target) - sum(copies * size) AS gap FROM state{k} GROUP BY source),
  run{k} AS (
    SELECT doc_id, nth, sum(size) OVER (PARTITION BY s.source ORDER BY q, doc_id, nth ROWS UNBOUNDED PRECEDING) <= gap AS won
    FROM state{k} s JOIN gap{k} g ON s.source IS NOT DISTINCT FROM g.source WHERE q IS NOT NULL AND size <= gap),
  state{k + 1} AS (
    SELECT s.* REPLACE (copies + coalesce(won, false)::BIGINT AS copies, CASE WHEN coalesce(won, false) THEN NULL ELSE q END AS q)
    FROM state{k} s LEFT JOIN run{k} r ON r.doc_id IS NOT DISTINCT FROM s.doc_id AND r.nth = s.nth)""")
    return f"""
WITH read AS (
    SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0)::BIGINT AS size,
           row_number() OVER (PARTITION BY doc_id ORDER BY source NULLS LAST, text NULLS LAST) AS nth
    FROM documents),
  sized AS (
    SELECT *, (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || nth), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
           length(bin(size))::DOUBLE AS pref
    FROM read),
  sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
  weighed AS (
    SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, {copies} * source_size AS cap FROM sums),
  running AS (
    SELECT *, coalesce(sum(cap) OVER b, 0) AS caps, coalesce(sum(w) OVER b, 0) AS used, sum(source_size) OVER () AS total, sum(w) OVER () AS ws
    FROM weighed WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  stopped AS (SELECT *, cap * (ws - used) <= w * (total - caps) AS stop FROM running),
  targets AS (
    SELECT source, source_size, CASE WHEN stop THEN cap::DOUBLE ELSE
      (w * (total - sum(CASE WHEN stop THEN cap ELSE 0 END) OVER ()))::DOUBLE / greatest(sum(CASE WHEN stop THEN 0 ELSE w END) OVER (), 1)::DOUBLE
      END AS target FROM stopped),
  level AS (SELECT source, pref, sum(size)::BIGINT AS words FROM sized GROUP BY source, pref),
  rate AS (
    -- the most preferred levels stand at the limit, the others share what is left
    SELECT t.source, source_size, target, any_value(stopped_at) AS stopped_at,
           (target - {copies} * coalesce(sum(words) FILTER (pref >= stopped_at), 0)) / sum(pref * words) FILTER (pref < stopped_at AND words > 0) AS rate
    FROM targets t JOIN (
        SELECT l.*, coalesce(min(pref) FILTER (pref * (target - {copies} * above) >= {copies}.0::DOUBLE * own) OVER (PARTITION BY l.source), 'inf'::DOUBLE) AS stopped_at
        FROM (SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY pref DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
                     sum(pref * words) OVER (PARTITION BY source ORDER BY pref ROWS UNBOUNDED PRECEDING) AS own FROM level) l
        JOIN targets t ON l.source IS NOT DISTINCT FROM t.source) l ON l.source IS NOT DISTINCT FROM t.source
    GROUP BY t.source, source_size, target),
  expected AS (
    SELECT doc_id, nth, s.source, size, u, source_size, target,
           CASE WHEN source_size = 0 THEN 0.0::DOUBLE WHEN pref >= stopped_at THEN {copies}.0::DOUBLE ELSE least({copies}.0::DOUBLE, rate * pref) END AS e
    FROM sized s JOIN rate t ON s.source IS NOT DISTINCT FROM t.source),
  state0 AS (
    SELECT doc_id, nth, source, size, source_size, target, floor(e)::BIGINT AS copies,
           CASE WHEN e - floor(e) > 0 AND size > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS q
    FROM expected),{",".join(steps)}
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM state{passes}
"""


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
  d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
  f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

_CLEAN = rf"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DECONTAMINATION = f"""
WITH item AS (SELECT item_id, {_CLEAN} AS w FROM benchmark WHERE text IS NOT NULL),
  window_of AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
  size_of AS (SELECT DISTINCT n FROM window_of),
  doc AS (SELECT doc_id, coalesce({_CLEAN}, []) AS w FROM documents),
  hit AS (
    SELECT doc_id, i, d.n, item_id
    FROM (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM doc, size_of WHERE len(w) >= n) d
    JOIN window_of x ON x.n = d.n AND x.win = array_to_string(w[i : i + d.n - 1], ' ')),
  word AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
  items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_SHINGLES = f"""
doc AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER.format('text'))}, []) AS w FROM documents),
  gram AS (
    SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 3) - 1], ' ') AS g
    FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 3) + 2)) AS i FROM doc WHERE len(w) > 0)),
  size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM gram x JOIN gram y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
  link AS (
    SELECT a, b FROM shared JOIN size s ON s.doc_id = a JOIN size t ON t.doc_id = b WHERE 100 * c >= 90 * (s.n + t.n - c)),
  reach(id, r) AS (SELECT doc_id, doc_id FROM doc UNION SELECT id, b FROM reach JOIN link ON r = a)
"""
_NGRAM_JOIN = f"""
WITH RECURSIVE {_SHINGLES}
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM doc LEFT JOIN size USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = doc_id
"""

# the base patterns as given, and the two that the method adds; with score, bonus and context
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 9, 1, "true", r"e-?mail|contact|write|courriel|correo|kontakt"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 6, 3,
     "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0", "x"),
    ("card", r"[0-9]([\x20-]?[0-9])+", 8, 2,
     "length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN (length(digits) - i) % 2 = 0 "
     "THEN digits[i]::INT ELSE digits[i]::INT * 2 - CASE WHEN digits[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0", "x"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 6, 3, "length(digits) BETWEEN 9 AND 15", "x"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", 8, 2,
     "length(plain) BETWEEN 15 AND 34 AND list_reduce(list_concat([0], list_transform(string_split(plain[5:] || plain[:4], ''), "
     "lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, x: (a * CASE WHEN x >= 10 THEN 100 ELSE 10 END + x) % 97) = 1", "x"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 3, 6, "true", "ssn|social security"),
)


def _pii() -> str:
    parts = []
    for k, (name, pattern, score, bonus, valid, context) in enumerate(_PII):
        near = f"regexp_matches(lower(right(gap, 40) || ' ' || left(after, 40)), '{context}')"
        parts.append(f"""
    SELECT doc_id, {k} AS kind, '{name}' AS name, pos AS start_at, pos + length(hit) AS end_at
    FROM (
      SELECT doc_id, hits[i] AS hit, gaps[i] AS gap, gaps[i + 1] AS after, regexp_replace(hits[i], '[^0-9]', '', 'g') AS digits,
             replace(hits[i], ' ', '') AS plain,
             list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS pos
      FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all(t, '{pattern}') AS hits, string_split_regex(t, '{pattern}') AS gaps FROM doc)))
    WHERE {valid} AND {score} + CASE WHEN {near} THEN {bonus} ELSE 0 END >= 5""")
    count = ", ".join(f"count(*) FILTER (name = '{n}') AS n_{n}" for n in ("email", "ip", "card", "phone"))
    return f"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  span AS ({" UNION ALL ".join(parts)}),
  found AS (
    SELECT doc_id, {count}, string_agg(name || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, kind) AS spans,
           string_agg(name || ':' || start_at::BIGINT || ':' || end_at::BIGINT, ',' ORDER BY start_at, kind) FILTER (kind < 4) AS base
    FROM span GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0)::BIGINT AS n_email, coalesce(n_ip, 0)::BIGINT AS n_ip, coalesce(n_card, 0)::BIGINT AS n_card,
       coalesce(n_phone, 0)::BIGINT AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (doc_id)
"""


_EMBEDDING_JOIN = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
  ok AS (
    SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
      ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.norm > 0 AND b.norm > 0
     AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
  reach(id, r) AS (SELECT vec_id, vec_id FROM v UNION SELECT id, b FROM reach JOIN link ON r = a),
  low AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
  degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN low ON id = vec_id LEFT JOIN degree ON a = vec_id
"""

_HARD_NEGATIVES = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  score AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_dot_product(a.e, b.e)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND len(a.e) = len(b.e)),
  positive AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM score WHERE alike AND id <> anchor_id
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN score USING (anchor_id)
WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10"""


_PREFIX_TRIE = """
WITH RECURSIVE own AS (
    SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL),
  bits(n, i, v) AS (
    SELECT n, 0, n FROM range(256) t(n)
    UNION ALL SELECT n, i + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE i < 8),
  crc(c, s, i, v) AS (
    SELECT DISTINCT c, c::VARCHAR, 0, 4294967295::BIGINT FROM own
    UNION ALL SELECT c, s, crc.i + 1, xor(crc.v >> 8, b.v) FROM crc JOIN bits b ON b.i = 8 AND b.n = xor(crc.v & 255, ascii(s[crc.i + 1])::BIGINT) WHERE crc.i < len(s)),
  conv AS (
    SELECT c, c - c % 5 AS base, xor(v, 4294967295) % 9 AS h, (SELECT count(*) FROM own o WHERE o.c = crc.c - crc.c % 5) AS n_base
    FROM crc WHERE i = len(s)),
  rebuilt AS (
    SELECT v.c, o.pos, role, text FROM conv v JOIN own o ON o.c = v.base AND o.pos <= h
    UNION ALL SELECT v.c, least(h, n_base) + o.pos - h, role, text FROM conv v JOIN own o ON o.c = v.c AND o.pos > h),
  path(c, depth, node, parent, bytes) AS (
    SELECT c, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM conv
    UNION ALL SELECT p.c, p.depth + 1, md5(node || '/' || md5(role) || md5(text)), node, strlen(text)::BIGINT FROM path p JOIN rebuilt r ON r.c = p.c AND r.pos = p.depth + 1),
  node AS (SELECT node, depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM path GROUP BY node, depth),
  kids AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent),
  below AS (
    SELECT p.node, sum((n_convs - 1) * n.bytes) AS saved_tokens, count(*) FILTER (k.node IS NULL) AS n_leaves
    FROM node n LEFT JOIN kids k ON k.node = n.node JOIN path p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.node),
  ends AS (
    SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha
    FROM (SELECT * FROM path QUALIFY depth = max(depth) OVER (PARTITION BY c)) GROUP BY node)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0)::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM node n LEFT JOIN node u ON u.node = n.parent AND n.depth > 0 LEFT JOIN kids k ON k.node = n.node JOIN below b ON b.node = n.node LEFT JOIN ends e ON e.node = n.node"""


_SUBSTRING = f"""
WITH split AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS words FROM documents),
  windows AS (
    SELECT doc_id, p, array_to_string(words[p : p + 19], ' ') AS w
    FROM (SELECT *, unnest(range(1, len(words) - 18)) AS p FROM split WHERE len(words) >= 20)),
  repeated AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1 AS again FROM windows),
  numbered AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM split),
  marked AS (
    SELECT n.doc_id, n.p, word, coalesce(bool_or(again) OVER (PARTITION BY n.doc_id ORDER BY n.p ROWS 19 PRECEDING), false) AS gone
    FROM numbered n LEFT JOIN repeated r ON n.doc_id = r.doc_id AND n.p = r.p),
  kept AS (
    SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept
    FROM marked GROUP BY doc_id)
SELECT s.doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k USING (doc_id)"""


ORACLE: dict[str, str] = {
    "op1_mixing": _mixing(), "op2_warc": _WARC, "op3_ngram_join": _NGRAM_JOIN, "op5_pii": _pii(), "op7_decontamination": _DECONTAMINATION,
    "op10_embedding_join": _EMBEDDING_JOIN,
    "op11_hard_negatives": _HARD_NEGATIVES,
    "op12_prefix_trie": _PREFIX_TRIE,
    "op13_substring_dedup": _SUBSTRING,
}
