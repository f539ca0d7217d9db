"""The results of the operators that SQL can express, as DuckDB queries."""

from __future__ import annotations

from twinframe.llm import quality_rules as q

PLAIN = r"[\x20\x09-\x0D]+"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def words(text: str, separators: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{separators}'), lambda x: x <> '')"


REPEATED_WINDOWS = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words("coalesce(text, '')", PLAIN)} AS ws FROM documents),
win AS MATERIALIZED (
  SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM (
    SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)),
gone AS MATERIALIZED (
  SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM win
  WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
tok AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT r, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS kept
  FROM tok LEFT JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (r)"""

ITEM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAMINATED = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words(LOWERED, ITEM_SEPARATORS)} AS ws FROM documents),
b AS (SELECT item_id, {words(LOWERED, ITEM_SEPARATORS)} AS ws FROM benchmark WHERE item_id IS NOT NULL),
bw AS MATERIALIZED (
  SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS s, len(ws[i:i + 9]) AS size FROM (
    SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
dw AS (
  SELECT r, i, size, array_to_string(ws[i:i + size - 1], ' ') AS s FROM (
    SELECT r, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, (SELECT DISTINCT size FROM bw) WHERE len(ws) >= size)),
hit AS MATERIALIZED (SELECT DISTINCT r, i, dw.size, item_id FROM dw JOIN bw USING (s)),
cov AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN cov USING (r) LEFT JOIN its USING (r)"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {words(LOWERED, PLAIN)} AS ws FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM (
    SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
edge AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x AS id, x AS root FROM edge UNION SELECT edge.y, reach.root FROM reach JOIN edge ON edge.x = reach.id),
comp AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  w.doc_id = coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN comp ON comp.id = w.doc_id"""

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_QUARTERS = " || ".join(
    f"array_to_string(list_transform(range(8), lambda j: substr('{BASE32}', "
    f"1 + ((('0x' || substr(sha1(h), {1 + 10 * part}, 10))::BIGINT >> (35 - 5 * j)::INT) & 31)::INT, 1)), '')"
    for part in range(4)
)
ARCHIVED = f"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_QUARTERS} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))"""

_CUTS = ", ".join(f"('{rule}', {step}, {cut}::DOUBLE)" for rule, cuts in q.CUTOFFS.items() for step, cut in enumerate(cuts))
_RATE = q.FALSE_REJECTION / len(q.CUTOFFS)
_SCORES = {
    "symbols": "n_symbols / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)", "long_words": "word_chars / greatest(n_words, 1)",
}
_LONG = " UNION ALL ".join(f"SELECT lang, good, proposes, '{rule}' AS rule, {score} AS score FROM lab" for rule, score in _SCORES.items())
_OVER = " OR ".join(
    f"coalesce({score} > (SELECT cutoff FROM cut WHERE cut.lang = coalesce(m.lang, '') AND rule = '{rule}'), false)"
    for rule, score in _SCORES.items()
)
QUALITY = rf"""
WITH w AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS text, {words("coalesce(text, '')", PLAIN)} AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (
  SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS met FROM g) WHERE met > 1) GROUP BY r),
ln AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m0 AS (
  SELECT w.r, doc_id, lang, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN rep ON rep.r = w.r LEFT JOIN ln ON ln.r = w.r),
m AS MATERIALIZED (SELECT *, n_words < {q.FEWEST_WORDS} OR 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS base_failed FROM m0),
lab AS MATERIALIZED (
  SELECT m.* REPLACE (coalesce(lang, '') AS lang), quality = 1 AS good, (((doc_id % 1000003) * 7919) % 10007) % {q.PARTS} = 0 AS proposes
  FROM m JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
cuts(rule, step, cutoff) AS (VALUES {_CUTS}),
cnt AS (
  SELECT lang, rule, step, cutoff, count(*) FILTER (score > cutoff AND good AND NOT proposes) AS k,
    count(*) FILTER (good AND NOT proposes) AS n, count(*) FILTER (score > cutoff AND good AND proposes) AS good_out,
    count(*) FILTER (score > cutoff AND NOT good AND proposes) AS bad_out
  FROM ({_LONG}) JOIN cuts USING (rule) GROUP BY ALL),
tst AS MATERIALIZED (
  SELECT *, n > 0 AND list_sum(list_transform(range(0, k + 1), lambda i: exp(
      lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RATE!r}) + (n - i) * ln(1 - {_RATE!r}))))
    <= {q.ERROR / len(q.CUTOFFS)!r} / (SELECT count(DISTINCT lang) FROM lab) AS passes FROM cnt),
stp AS (SELECT lang, rule, min(step) AS stop FROM tst WHERE NOT passes GROUP BY ALL),
cut AS MATERIALIZED (
  SELECT lang, rule, arg_max(cutoff, bad_out * 1000 - step) AS cutoff FROM tst LEFT JOIN stp USING (lang, rule)
  WHERE (stop IS NULL OR step < stop) AND bad_out > good_out GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({_OVER}) AS kept FROM m"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{TERMS}') AS ws FROM documents),
s AS MATERIALIZED (SELECT count(*) AS docs, sum(len(ws))::BIGINT AS total FROM d WHERE len(ws) > 0),
tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
i AS MATERIALIZED (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all({LOWERED}, '{TERMS}') AS ws FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT q, term, count(*) AS times FROM (SELECT q, unnest(ws) AS term FROM i) GROUP BY ALL),
w AS (
  SELECT q, term, times * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM qt JOIN df USING (term), s),
scored AS (
  SELECT q, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * len(ws) * docs) // total))))::BIGINT AS score
  FROM w JOIN tf USING (term) JOIN d USING (r), s GROUP BY q, r),
ranked AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked JOIN i USING (q) WHERE rank <= 10"""


def judged_urls(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(str(rule) for rule in rules)
    return f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {values}),
p AS (
  SELECT row_number() OVER () AS r, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
m AS (
  SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY r ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM m WHERE k = 1"""


HARD_NEGATIVES = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0),
p AS (
  SELECT a, b, anchor_id, other_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id NULLS LAST) AS k FROM s WHERE same) WHERE k <= 5)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, other_id NULLS LAST) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
WHERE rank <= 10"""
