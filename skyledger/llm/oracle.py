"""DuckDB SQL of the corpus queries that SQL can express.

Not expressed: edit distance over embedded windows (op1), CRC-32 of texts (op3, op7), MinHash
signatures (op5), token ids (op6, op7), learned prototypes (op10) and class models (op12); ``tests/llm`` holds
them against brute force, the tokenizer library, exact round trips and held-out accuracy.
"""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BASE32 = _UPPER + "234567"

NGRAM_JOIN = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
named AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS name, s FROM sets),
grams AS (SELECT doc_id, n, name, unnest(s) AS g FROM named),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.name) <> any_value(b.name) AS other, any_value(b.name) AS name
  FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, n AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM named JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(DISTINCT name) AS n_links FROM links WHERE other GROUP BY x) USING (doc_id)"""

METRIC_SEARCH = """
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY rank <= 5"""

_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _matches(kind: int, pattern: str) -> str:
    return f"""SELECT rid, doc_id, source, {kind} AS kind, unnest(m) AS match, unnest(g[1:len(m)]) AS gap, generate_subscripts(m, 1) AS nth
  FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS g FROM docs) WHERE len(m) > 0"""


SECRETS = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
found AS ({_matches(0, _ASSIGN)} UNION ALL {_matches(1, 'AKIA[A-Z0-9]{12,}')} UNION ALL {_matches(2, '[0-9a-f]{32,}')}),
placed AS (
  SELECT *, CAST(sum(length(gap) + length(match)) OVER (PARTITION BY rid, kind ORDER BY nth) AS BIGINT) AS stop,
    CASE WHEN kind = 0 THEN regexp_extract(match, '{_ASSIGN}', 2) ELSE match END AS value FROM found),
candidates AS (
  SELECT *, regexp_matches(value, '(?i)example|sample|dummy|changeme|placeholder|your[_.-]|x{{4}}|0{{8}}|1234567')
      OR replace(lower(value), lower(value)[1:1], '') = '' AS placeholder
  FROM placed WHERE length(value) >= CASE kind WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END),
owned AS (
  SELECT value, count(DISTINCT coalesce(source, chr(0))) AS owners, CAST(count(DISTINCT (coalesce(source, chr(0)), coalesce(CAST(doc_id AS VARCHAR), chr(0)))) AS BIGINT) AS repos
  FROM candidates GROUP BY value),
judged AS (
  SELECT *, ['assign', 'access', 'hex'][kind + 1] AS name, CASE WHEN placeholder OR owners >= 3 OR repos >= 100 THEN 'example' WHEN owners <= 1 THEN 'live' ELSE 'shared' END AS verdict
  FROM candidates JOIN owned USING (value)),
spans AS (
  SELECT rid, kind, stop - length(match) AS start, stop, name FROM judged
  UNION SELECT rid, CASE verdict WHEN 'live' THEN 3 WHEN 'example' THEN 4 ELSE 5 END, stop - length(value), stop, verdict FROM judged),
texts AS (
  SELECT rid, string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans,
    coalesce(string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '') AS base
  FROM spans GROUP BY rid),
counts AS (
  SELECT rid, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
    count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'example') AS n_example,
    count(*) FILTER (WHERE verdict = 'shared') AS n_shared, max(owners) AS most_owners, max(repos) AS most_repos
  FROM judged GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_live, 0) AS n_live,
  coalesce(n_example, 0) AS n_example, coalesce(n_shared, 0) AS n_shared, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(most_owners, 0) AS most_owners, coalesce(most_repos, 0) AS most_repos
FROM docs LEFT JOIN texts USING (rid) LEFT JOIN counts USING (rid)"""

WARC = f"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS p, sha1(coalesce(html, '')) AS hexadecimal FROM pages),
bits AS (
  SELECT page_id, p, array_to_string(list_transform(range(1, 41), lambda i: 
    substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * strpos('0123456789abcdef', substr(hexadecimal, i, 1)) - 3, 4)), '') AS b,
    max(page_id) OVER (PARTITION BY p) AS kept
  FROM payloads),
digits AS (
  SELECT *, array_to_string(list_transform(range(0, 32), lambda k: substr('{_BASE32}', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: 
    CAST(substr(b, CAST(1 + 5 * k + j AS BIGINT), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER)))) AS BIGINT), 1)), '') AS digest
  FROM bits)
SELECT page_id, strlen(p) AS payload_bytes, digest AS payload_digest, CASE WHEN kept IS NULL OR kept = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN kept <> page_id OR page_id IS NULL THEN kept END AS refers_to
FROM digits"""

_PARTS, _ENTRIES, _ROUNDS = 8, 16, 6
_USABLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_NEAREST = """SELECT p.rid, p.pos, p.v, arg_min(b.e, {distance} * 16 + b.e) AS e, min({distance}) AS d
  FROM parts p JOIN b{n} b ON b.pos = p.pos GROUP BY p.rid, p.pos, p.v"""
_DISTANCE = "CAST(coalesce(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.c[i]) * (p.v[i] - b.c[i]))), 0) AS BIGINT)"


def _codes() -> str:
    """The rounds are written out, one after the other."""
    rounds = []
    for n in range(_ROUNDS + 1):
        rounds.append(f"a{n} AS MATERIALIZED ({_NEAREST.format(distance=_DISTANCE, n=n)})")
        if n < _ROUNDS:
            rounds.append(f"""m{n} AS (
  SELECT pos, e, list(CAST(floor(s / t) AS BIGINT) ORDER BY i) AS c FROM (
    SELECT pos, e, i, sum(x) AS s, count(*) AS t FROM (SELECT pos, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{n}) GROUP BY pos, e, i) GROUP BY pos, e),
b{n + 1} AS MATERIALIZED (SELECT b.pos, b.e, coalesce(m.c, b.c) AS c FROM b{n} b LEFT JOIN m{n} m ON m.pos = b.pos AND m.e = b.e)""")
    last = _ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE {_USABLE}),
cut AS (SELECT max(len(v) + {_PARTS} - 1) // {_PARTS} AS w FROM kept),
parts AS MATERIALIZED (
  SELECT rid, pos, list_transform(range(1, w + 1), lambda i: coalesce(v[CAST(pos * w + i AS BIGINT)], 0)) AS v
  FROM kept, cut, (SELECT unnest(range(0, {_PARTS})) AS pos)),
b0 AS MATERIALIZED (SELECT pos, rid - 1 AS e, v AS c FROM parts WHERE rid <= {_ENTRIES}),
{", ".join(rounds)},
numbers AS (SELECT pos, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM b{last}),
books AS (SELECT sha256(coalesce(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, e, i), '')) AS codebooks_sha256 FROM numbers),
codes AS (SELECT rid, string_agg(format('{{:02x}}', e), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (rid), books"""


VECTOR_CODES = _codes()

HARD_NEGATIVES = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_USABLE}),
scores AS MATERIALIZED (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, c.rid, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.rid <> c.rid AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor, anchor_id, rid AS positive, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.positive ORDER BY n.score DESC, n.vec_id, n.rid) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": NGRAM_JOIN, "op4_metric_tree_search": METRIC_SEARCH, "op8_secret_ownership": SECRETS, "op9_warc_archive": WARC,
            "op11_vector_codes": VECTOR_CODES, "op13_hard_negatives": HARD_NEGATIVES}
