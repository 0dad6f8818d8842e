"""DuckDB statements for the operators that SQL can express."""

from __future__ import annotations

OP5 = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(list_zip(q.cells, d.cells), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.cells) = len(d.cells) WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""

OP6 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS hex, html FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, CAST(i AS INTEGER) + 1, 1))::INTEGER), 4, '0')), 'string_agg', '') AS bits,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM d)
SELECT page_id, n AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_aggregate(list_transform(range(5), lambda k:
    CAST(substr(bits, CAST(5 * i + k AS INTEGER) + 1, 1) AS INTEGER) * CAST(pow(2, 4 - k) AS INTEGER)), 'sum')::INTEGER, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM b
"""

OP3 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
x AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS said,
  11 + length(replace(replace(replace(role, chr(92), '..'), '<', '..'), '[', '..')) + length(replace(replace(replace(text, chr(92), '..'), '<', '..'), '[', '..')) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(length(said)) AS BIGINT) AS loss_chars, sha256(string_agg(said, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM x GROUP BY conv_id
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, hash(u.x) AS h FROM s, unnest(shingles) AS u(x)),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * k >= 75 * (n + m - k)),
near AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS label FROM near UNION SELECT near.b, reach.label FROM reach JOIN near ON near.a = reach.node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node)
SELECT s.doc_id, len(shingles) AS n_shingles, coalesce(label, s.doc_id) AS component_id, coalesce(label, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN comp ON comp.node = s.doc_id
"""

#: The checksum is CRC-32, bit by bit over the digits of the id.
OP11 = r"""
WITH o AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384::BIGINT) END), 4294967295::BIGINT) % 4 AS head FROM o),
r AS (SELECT h.conv_id, list_concat(coalesce(b.turns[1:head], []), h.turns[head + 1:]) AS t FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS MATERIALIZED (SELECT conv_id, u.d, t[1:u.d] AS prefix, len(t) = u.d AS is_end FROM r, unnest(range(0, len(t) + 1)) AS u(d)),
n AS MATERIALIZED (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN is_end THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends,
  CASE WHEN d = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(any_value(prefix)[d].text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS words FROM p GROUP BY prefix, d),
c AS MATERIALIZED (SELECT x.d, x.prefix, count(y.d) AS n_children FROM n x LEFT JOIN n y ON y.d = x.d + 1 AND y.prefix[1:x.d] = x.prefix GROUP BY x.d, x.prefix),
s AS (SELECT x.d, x.prefix, sum((y.n_convs - 1) * y.words) AS saved_tokens, sum((c.n_children = 0)::BIGINT) AS n_leaves
  FROM n x JOIN n y ON y.d >= x.d AND y.prefix[1:x.d] = x.prefix JOIN c ON c.d = y.d AND c.prefix = y.prefix GROUP BY x.d, x.prefix)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, c.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN c ON c.d = n.d AND c.prefix = n.prefix JOIN s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN n up ON up.d = n.d - 1 AND up.prefix = n.prefix[1:n.d - 1]
"""

#: Set sizes, components and numbers of links at 0.8.
OP13 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))) END AS shingles
  FROM w),
e AS MATERIALIZED (SELECT doc_id, len(shingles) AS n, u.x AS h FROM s, unnest(shingles) AS u(x)),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS k
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM both_ WHERE 100 * k >= 80 * (n + m - k)),
near AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS label FROM near UNION SELECT near.b, reach.label FROM reach JOIN near ON near.a = reach.node),
comp AS (SELECT node, min(label) AS label FROM reach GROUP BY node),
degree AS (SELECT a AS node, count(*) AS n FROM near GROUP BY a)
SELECT s.doc_id, len(shingles) AS n_shingles, coalesce(label, s.doc_id) AS component_id, coalesce(degree.n, 0) AS n_links
FROM s LEFT JOIN comp ON comp.node = s.doc_id LEFT JOIN degree ON degree.node = s.doc_id
"""

UNITS = """'mm','cm','m','km','inch','inches','foot','feet','yard','yards','mile','miles','meter','meters','metre','metres',
  'mg','g','kg','lb','lbs','pound','pounds','ounce','ounces','gram','grams','ton','tons','ml','l','liter','liters','litre','litres',
  's','sec','second','seconds','min','minute','minutes','h','hour','hours','day','days','week','weeks','month','months','year','years',
  'dollar','dollars','cent','cents','euro','euros','usd','eur','percent','degrees','mph','kmh','kb','mb','gb'"""

OP10 = r"""
WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL UNION ALL SELECT 'b', item_id, text FROM benchmark),
r AS (SELECT side, id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\x20\x09-\x0D.!?]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS raw FROM t),
c AS (SELECT side, id, rid, list_filter(list_transform(range(1, len(raw) + 1), lambda i: {
    'w': CASE WHEN regexp_matches(trim(raw[i], '.!?'), '^[0-9]') THEN '<num>'
         WHEN i > 1 AND regexp_matches(raw[i - 1], '^[.!?]*[0-9]') AND lower(trim(raw[i], '.!?')) IN (@UNITS@) AND regexp_matches(raw[i - 1], '^[0-9]') THEN '<unit>'
         WHEN i > 1 AND right(raw[i - 1], 1) NOT IN ('.', '!', '?') AND left(trim(raw[i], '.!?'), 1) <> lower(left(trim(raw[i], '.!?'), 1)) AND trim(raw[i], '.!?') <> upper(trim(raw[i], '.!?')) THEN '<name>'
         ELSE lower(trim(raw[i], '.!?')) END,
    'v': lower(trim(raw[i], '.!?'))}), lambda s: s.w <> '') AS ws FROM r),
g AS MATERIALIZED (SELECT side, id, rid, u.i AS pos, len(ws) AS size, ws[u.i : u.i + 7] AS part, array_to_string(list_transform(ws[u.i : u.i + 7], lambda s: s.w), ' ') AS key
  FROM c, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS u(i) WHERE len(ws) > 0),
b AS MATERIALIZED (SELECT *, len(list_filter(part, lambda s: s.w IN ('<num>', '<unit>', '<name>'))) AS slots FROM g WHERE side = 'b'),
usable AS MATERIALIZED (SELECT *, least(3, count(*) OVER (PARTITION BY rid)) AS needed FROM b WHERE len(part) - slots >= least(5, len(part))),
m AS MATERIALIZED (SELECT d.id AS doc_id, d.pos, d.part AS own, u.rid, u.id AS item_id, u.pos AS item_pos, u.part, u.slots, u.needed
  FROM g d JOIN usable u ON d.key = u.key AND least(d.size, 8) = least(u.size, 8) WHERE d.side = 'd'),
slot_ AS (SELECT doc_id, rid, pos - item_pos AS shift, z.k AS k, part[z.k].w AS w, part[z.k].v AS b, own[z.k].v AS d FROM m, unnest(range(1, len(part) + 1)) AS z(k) WHERE slots > 0 AND part[z.k].w IN ('<num>', '<unit>', '<name>')),
good_ AS (SELECT doc_id, rid, shift FROM slot_ GROUP BY ALL HAVING count(DISTINCT (w, b)) = count(DISTINCT (w, b, d)) AND count(DISTINCT (w, d)) = count(DISTINCT (w, b, d))),
hits AS (SELECT doc_id, rid, item_id, item_pos, needed FROM m WHERE slots = 0 OR EXISTS (SELECT 1 FROM good_ good WHERE good.doc_id = m.doc_id AND good.rid = m.rid AND good.shift = m.pos - m.item_pos))
SELECT doc_id, item_id, count(DISTINCT item_pos) AS n_windows FROM hits GROUP BY doc_id, rid, item_id, needed HAVING count(DISTINCT item_pos) >= needed
""".replace("@UNITS@", UNITS)

LLM_ORACLES: dict[str, str] = {
    "op3_chat": OP3,
    "op4_near_duplicates": OP4,
    "op5_top_k": OP5,
    "op6_warc": OP6,
    "op10_decontamination": OP10,
    "op11_prefix_trie": OP11,
    "op13_ngram_join": OP13,
}
