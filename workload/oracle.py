"""The same results in plain SQL: cross joins, recursive components and windows over the given tables.

Fragments are common table expressions; :func:`with_` puts the needed ones before a final select.
"""

from __future__ import annotations

from twinframe.config import Settings
from workload.derive import SETTINGS

CHANNELS = ["aeio", "ntsr", "ldhu"]
ALTERNATING = 0x5555555555555555


def signed(value: str) -> str:
    return f"(CASE WHEN {value} >= 9223372036854775808 THEN {value} - 18446744073709551616 ELSE {value} END)::BIGINT"


def _hash_sums(name: str, first: int) -> str:
    word = f"('0x' || substr(m, {first}, 16))::UBIGINT"
    return ", ".join(f"sum(({word} >> {k}) & 1) AS {name}{k}" for k in range(64))


def _hash_value(name: str) -> str:
    total = " + ".join(f"CASE WHEN {name}{k} * 2 > n THEN {1 << k}::HUGEINT ELSE 0 END" for k in range(64))
    return f"({total})"


def _feat() -> str:
    letters = [c for ch in CHANNELS for c in ch]
    counts = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE AS n_{c}" for c in letters)
    bins = []
    for ch in CHANNELS:
        total = " + ".join(f"n_{c}" for c in ch)
        bins += [f"CASE WHEN {total} > 0 THEN n_{c} / ({total}) ELSE 0.0 END" for c in ch]
    hist = ", ".join(f"{b} AS h{i}" for i, b in enumerate(bins))
    total = " + ".join(f"h{i}" for i in range(12))
    entropy = " + ".join(f"CASE WHEN h{i} > 0 THEN -(h{i}/({total})) * ln(h{i}/({total})) ELSE 0 END" for i in range(12))
    return f"""
words AS (SELECT doc_id, md5(w) AS m FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents)),
sums AS (SELECT doc_id, count(*) AS n, {_hash_sums('p', 1)}, {_hash_sums('d', 17)} FROM words GROUP BY doc_id),
hashes AS (SELECT doc_id, {_hash_value('p')} AS pv, {_hash_value('d')} AS dv FROM sums),
feat0 AS (
  SELECT doc_id, source, lang, text, {signed('pv')} AS p0, {signed('dv')} AS dhash, length(text) AS len, n_chars, {counts},
    CASE WHEN doc_id % 10 IN (4, 8) THEN '.cr2' WHEN doc_id % 10 IN (3, 6) THEN '.png' ELSE '.jpg' END AS ext
  FROM documents JOIN hashes USING (doc_id)),
feat1 AS (
  SELECT *, '/lib/' || source || '/' || lang AS dir, 'doc_' || doc_id AS stem, 'doc_' || doc_id || ext AS name,
    '/lib/' || source || '/' || lang || '/doc_' || doc_id || ext AS image_id, ext = '.cr2' AS is_raw,
    CASE WHEN doc_id % 11 = 0 THEN xor(p0, {ALTERNATING}::BIGINT) ELSE p0 END AS phash,
    CASE WHEN doc_id % 7 = 0 THEN 1920 WHEN doc_id % 5 < 2 THEN 6000 WHEN doc_id % 5 = 2 THEN 4000
         WHEN doc_id % 5 = 3 THEN 3000 ELSE 1620 END AS width,
    CASE WHEN doc_id % 7 = 0 THEN 1080 WHEN doc_id % 5 < 2 THEN 4000 WHEN doc_id % 5 = 2 THEN 6000
         WHEN doc_id % 5 = 3 THEN 2000 ELSE 1080 END AS height,
    n_chars * 1000 + doc_id % 1000 AS file_size, 1704067200 + doc_id * 60 AS mtime_s,
    CASE WHEN doc_id % 3 <> 0 THEN 1704067200 + doc_id * 60 END AS exif_s,
    round(255.0 * (n_a + n_e + n_i) / greatest(len, 1), 6) AS brightness, {hist},
    CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'main' ELSE 'check' END AS side, '/lib/' || source AS root
  FROM feat0),
feat AS (
  SELECT *, xor(phash, {ALTERNATING}::BIGINT) AS r90, xor(phash, -1::BIGINT) AS r180,
    xor(xor(phash, {ALTERNATING}::BIGINT), -1::BIGINT) AS r270, {entropy} AS entropy,
    least(width, height) AS lo, greatest(width, height) AS hi
  FROM feat1)"""


FEAT = _feat()


def ham(x: str, y: str) -> str:
    return f"bit_count(xor({x}, {y}))::INT"


def distances(a: str, b: str, both: bool = True) -> list[str]:
    out = [ham(f"{a}.phash", f"{b}.phash")] + [ham(f"{a}.phash", f"{b}.{r}") for r in ("r90", "r180", "r270")]
    return out + ([ham(f"{a}.{r}", f"{b}.phash") for r in ("r90", "r180", "r270")] if both else [])


def pair_columns(s: Settings, a: str = "a", b: str = "b") -> str:
    """Guard values of a pair, one level of aliases at a time (DuckDB lets a select refer back to its aliases)."""
    cross = f"({a}.is_raw <> {b}.is_raw)"
    factor = f"CASE WHEN {cross} THEN {s.cross_format_threshold_factor} ELSE 1.0 END"
    ra, rb = f"({a}.width / {a}.height)", f"({b}.width / {b}.height)"
    gap = lambda x, y: f"abs({x} - {y}) / greatest({x}, {y}, 0.001)"
    tol = s.series_tolerance_pct / 100
    same = (f"(abs({a}.width - {b}.width) / greatest({a}.width, {b}.width) <= {tol}"
            f" AND abs({a}.height - {b}.height) / greatest({a}.height, {b}.height) <= {tol})")
    series = int(s.threshold * s.series_threshold_factor)
    base = f"CASE WHEN {same} THEN {series} ELSE {s.threshold} END"
    crossed = (f"least({base}, {s.embedded_cap})" if s.raw_use_embedded_thumb
               else f"greatest({base}, {int(s.cross_base * s.cross_format_threshold_factor)})")
    thr = f"(CASE WHEN {cross} THEN {crossed} ELSE {base} END)"
    if s.dark_protection:
        dark = f"({a}.brightness < {s.dark_threshold} OR {b}.brightness < {s.dark_threshold})"
        thr = f"(CASE WHEN {dark} THEN greatest(1, floor({thr} * {s.dark_tighten_factor})) ELSE {thr} END)"
    low = f"({a}.entropy < {s.low_entropy} AND {b}.entropy < {s.low_entropy})"
    sim = " + ".join(f"least({a}.h{i}, {b}.h{i})" for i in range(12))
    floor = int(s.rotation_base * s.rotation_threshold_factor)
    return f"""
    {a}.image_id AS ia, {b}.image_id AS ib, {cross} AS crossing, {low} AS low,
    least({gap(ra, rb)}, {gap(ra, f'(1.0 / {rb})')}) AS ar_diff,
    {ham(f'{a}.phash', f'{b}.phash')} AS up,
    CASE WHEN {cross} OR {low} THEN {ham(f'{a}.phash', f'{b}.phash')} ELSE least({', '.join(distances(a, b))}) END AS dist,
    {ham(f'{a}.dhash', f'{b}.dhash')} AS dd, abs({a}.brightness - {b}.brightness) AS bdiff, {factor} AS factor,
    abs({a}.exif_s - {b}.exif_s) AS apart, ({sim}) / 3.0 AS sim,
    CASE WHEN dist < up THEN greatest({thr}, {floor}) ELSE {thr} END AS thr, {same} AS same_dims"""


def guards(s: Settings) -> dict[str, str]:
    out = {
        "AR": f"ar_diff <= {s.ar_tolerance_pct / 100}",
        "date": f"(NOT crossing OR coalesce(apart <= {s.date_guard_seconds}, true))",
        "brightness": f"bdiff <= {s.brightness_max_diff} * factor",
        "pHash": "dist <= thr",
    }
    if s.use_dual_hash:
        out["dHash"] = (f"(crossing OR dist < up OR NOT ((up = 0 AND low AND dd >= {s.low_entropy_dhash})"
                        f" OR (up > 0 AND dd >= thr * {s.dhash_factor})))")
    if s.use_histogram:
        out["histogram"] = f"(crossing OR sim >= {s.hist_min_similarity})"
    return out


def similar(s: Settings) -> str:
    return " AND ".join(f"({g})" for g in guards(s).values())


def closure(name: str, verts: str, edges: str) -> str:
    """``name(id, root)``: the smallest vertex reachable from each vertex. ``edges`` yields (x, y), any direction."""
    return f"""
{name}_e AS MATERIALIZED (SELECT x, y FROM ({edges}) UNION SELECT y, x FROM ({edges})),
{name}_r AS (SELECT id, id AS root FROM ({verts}) UNION SELECT e.y, r.root FROM {name}_r r JOIN {name}_e e ON e.x = r.id),
{name} AS (SELECT id, min(root) AS root FROM {name}_r GROUP BY id)"""


def components(s: Settings) -> str:
    pairs = f"""
featm AS MATERIALIZED (SELECT * FROM feat WHERE greatest(width, height) >= {s.min_dimension}),
pairs AS MATERIALIZED (SELECT * FROM (SELECT {pair_columns(s)} FROM featm a JOIN featm b ON a.image_id < b.image_id)
  WHERE {similar(s)})"""
    return pairs + "," + closure(
        "comp", "SELECT ia AS id FROM pairs UNION SELECT ib FROM pairs", "SELECT ia AS x, ib AS y FROM pairs"
    )


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


def order_by(s: Settings) -> str:
    raw = "" if s.keep_all_formats else "CASE WHEN is_raw THEN 0 ELSE 1 END, "
    if s.keep_strategy == "oldest":
        first = "coalesce(exif_s, mtime_s)" if s.sort_by_exif_date else "mtime_s"
    else:
        first = "-(width::BIGINT * height)"
    return f"{raw}{first}, -file_size, image_id"


def roles(s: Settings) -> str:
    """From ``comp`` to ``roles(group_id, image_id, role, is_series)``."""
    tol = s.series_tolerance_pct / 100
    alone = "concat_ws('x', m.group_id, m.lo, m.hi, m.is_raw)"
    # With a tolerance, sizes of one format are linked as well; without one only formats are linked with each other.
    linked_sizes = "" if tol == 0 else f"""
near2 AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM sizes a JOIN sizes b ON a.group_id = b.group_id AND a.id < b.id
  WHERE greatest(abs(a.lo - b.lo) / greatest(a.lo, b.lo), abs(a.hi - b.hi) / greatest(a.hi, b.hi))
    <= CASE WHEN a.is_raw <> b.is_raw THEN {max(tol, s.cross_size_tolerance)} ELSE {tol} END),
{closure('sb', 'SELECT x AS id FROM near2 UNION SELECT y FROM near2', 'SELECT x, y FROM near2').lstrip()},"""
    bucket_of, bucket_join = ("cf", "") if tol == 0 else ("sb", f"LEFT JOIN sb ON sb.id = {alone}")
    key = order_by(s)
    kept = "true" if s.keep_all_formats else "is_raw"
    rot = int(s.rotation_base * s.rotation_threshold_factor)
    series = int(s.threshold * s.series_threshold_factor)
    share = 1.0 - (1.0 - s.preview_ratio)
    smaller = (f"(image_id <> best_id AND ((width = bw AND height = bh) OR (width = bh AND height = bw)"
               f" OR (width < bw * {share!r} AND height < bh * {share!r})))")
    if s.keep_all_formats:
        full = ("(abs(width - bw) / greatest(width, bw) <= tol AND abs(height - bh) / greatest(height, bh) <= tol)")
        free = (f"CASE WHEN lead_rank = 1 THEN NOT {full} AND {smaller} ELSE {smaller} AND NOT"
                f" (width = bw AND height = bh AND {ham('phash', 'lead_phash')} > {s.exact_radius}) END")
    else:
        free = smaller
    med = " + ".join([ham("a.phash", "b.phash")])
    series_on = "false" if s.disable_series_detection else "true"
    return f"""
mem AS MATERIALIZED (
  SELECT c.root AS group_id, f.*, row_number() OVER (PARTITION BY c.root ORDER BY {key}) AS rk
  FROM comp c JOIN featm f ON f.image_id = c.id),
sizes AS MATERIALIZED (SELECT DISTINCT group_id, lo, hi, is_raw, concat_ws('x', group_id, lo, hi, is_raw) AS id FROM mem),
near AS MATERIALIZED (SELECT a.id AS x, b.id AS y FROM sizes a JOIN sizes b ON a.group_id = b.group_id AND a.is_raw AND NOT b.is_raw
  WHERE abs(a.lo - b.lo) / greatest(a.lo, b.lo) <= {s.cross_size_tolerance}
    AND abs(a.hi - b.hi) / greatest(a.hi, b.hi) <= {s.cross_size_tolerance}),
{closure('cf', 'SELECT x AS id FROM near UNION SELECT y FROM near', 'SELECT x, y FROM near').lstrip()},
{linked_sizes}
mem2 AS MATERIALIZED (
  SELECT m.*, cf.root AS cfb, coalesce({bucket_of}.root, {alone}) AS bucket
  FROM mem m LEFT JOIN cf ON cf.id = {alone} {bucket_join}),
mem3 AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY group_id, cfb, ext ORDER BY rk) AS ext_rank,
    row_number() OVER (PARTITION BY bucket ORDER BY rk) AS brk, count(*) OVER (PARTITION BY bucket) AS bn,
    (bool_or(is_raw) OVER (PARTITION BY bucket)) AND NOT (bool_and(is_raw) OVER (PARTITION BY bucket)) AS bmixed
  FROM mem2),
inb AS MATERIALIZED (SELECT * FROM mem3 WHERE bn > 1 AND NOT bmixed AND {series_on}),
bp AS MATERIALIZED (
  SELECT a.bucket, max({ham('a.phash', 'b.phash')}) AS widest, max(least({', '.join(distances('a', 'b'))})) AS turned
  FROM inb a JOIN inb b ON a.bucket = b.bucket AND a.rk < b.rk GROUP BY a.bucket),
cls AS MATERIALIZED (
  SELECT i.*, CASE WHEN widest <= {s.exact_radius} OR turned <= {rot} THEN 'copy' ELSE 'burst' END AS kind
  FROM inb i JOIN bp USING (bucket)),
tot AS (SELECT a.bucket, a.image_id, a.rk, sum({med}) AS total FROM cls a JOIN cls b ON a.bucket = b.bucket
  WHERE a.kind = 'burst' GROUP BY a.bucket, a.image_id, a.rk),
medo AS MATERIALIZED (SELECT bucket, arg_min(image_id, total * 1000000 + rk) AS medoid FROM tot GROUP BY bucket),
conf AS MATERIALIZED (
  SELECT bucket, ib AS image_id FROM (SELECT {pair_columns(s)}, a.bucket, least({', '.join(distances('a', 'b', False))}) AS one_way
    FROM medo JOIN cls a ON a.image_id = medo.medoid JOIN cls b ON a.bucket = b.bucket)
  WHERE {similar(s)} AND one_way <= {series}),
ser AS MATERIALIZED (SELECT image_id FROM conf WHERE bucket IN (SELECT bucket FROM conf GROUP BY bucket HAVING count(*) >= 2)),
flg AS MATERIALIZED (
  SELECT m.*, (cfb IS NOT NULL AND NOT (ext_rank = 1 AND {kept}))
      OR image_id IN (SELECT image_id FROM cls WHERE kind = 'copy' AND brk > 1) AS dup,
    (cfb IS NOT NULL AND ext_rank = 1 AND {kept}) OR image_id IN (SELECT image_id FROM ser) AS series
  FROM mem3 m),
lead AS (
  SELECT group_id, ext, arg_min(image_id, rk) AS lead_id, arg_min(phash, rk) AS lead_phash FROM flg
  WHERE NOT dup AND NOT series GROUP BY group_id, ext),
best AS (SELECT group_id, image_id AS best_id, width AS bw, height AS bh, is_raw AS braw FROM mem WHERE rk = 1),
judged AS (
  SELECT f.*, best_id, bw, bh, lead_phash, CASE WHEN lead_id = f.image_id THEN 1 ELSE 2 END AS lead_rank,
    CASE WHEN f.is_raw <> braw THEN {max(tol, s.cross_size_tolerance)} ELSE {tol} END AS tol
  FROM flg f JOIN best USING (group_id) LEFT JOIN lead USING (group_id, ext)),
roles0 AS MATERIALIZED (
  SELECT *, CASE WHEN dup THEN 'preview' WHEN series THEN 'original' WHEN {free} THEN 'preview' ELSE 'original' END AS role
  FROM judged),
roles AS MATERIALIZED (
  SELECT r.*, g.is_series FROM roles0 r JOIN (
    SELECT group_id, bool_or(series OR cfb IS NOT NULL) AS is_series FROM roles0 GROUP BY group_id
    HAVING count(*) FILTER (role = 'preview') > 0) g USING (group_id))"""


def grouped(s: Settings = SETTINGS) -> list[str]:
    return [FEAT.lstrip(), components(s).lstrip(), roles(s).lstrip()]


def split(s: Settings) -> str:
    """From ``comp`` and ``pairs`` to ``split(image_id, group_id)``: centres one after the other, as in the reference
    order of members (total distance, then id)."""
    cap = s.max_group_size
    return f"""
big AS MATERIALIZED (SELECT root, count(*) AS n FROM comp GROUP BY root HAVING count(*) > {cap}),
bm AS MATERIALIZED (SELECT c.root, f.image_id, f.phash FROM comp c JOIN big USING (root) JOIN featm f ON f.image_id = c.id),
rk AS MATERIALIZED (
  SELECT root, image_id, row_number() OVER (PARTITION BY root ORDER BY total, image_id) AS r FROM (
    SELECT a.root, a.image_id, sum({ham('a.phash', 'b.phash')}) AS total FROM bm a JOIN bm b USING (root) GROUP BY ALL)),
blk AS MATERIALIZED (
  SELECT root, r, list(low) AS low FROM (
    SELECT x.root, greatest(x.r, y.r) AS r, least(x.r, y.r) AS low
    FROM pairs p JOIN rk x ON x.image_id = p.ia JOIN rk y ON y.image_id = p.ib WHERE x.root = y.root) GROUP BY ALL),
walk AS (
  SELECT root, 0::BIGINT AS r, []::BIGINT[] AS cs FROM big
  UNION ALL
  SELECT w.root, w.r + 1, CASE WHEN list_has_any(coalesce(b.low, []), w.cs) THEN w.cs ELSE list_append(w.cs, w.r + 1) END
  FROM walk w JOIN rk ON rk.root = w.root AND rk.r = w.r + 1 LEFT JOIN blk b ON b.root = w.root AND b.r = w.r + 1),
cen AS MATERIALIZED (SELECT w.root, w.cs FROM walk w JOIN big ON big.root = w.root AND big.n = w.r),
own AS MATERIALIZED (
  SELECT rk.root, rk.image_id, CASE WHEN list_contains(cs, rk.r) THEN rk.r
    ELSE list_min(list_intersect(b.low, cs)) END AS centre
  FROM rk JOIN cen USING (root) LEFT JOIN blk b ON b.root = rk.root AND b.r = rk.r),
cum AS MATERIALIZED (
  SELECT root, centre, coalesce(sum(k) OVER (PARTITION BY root ORDER BY centre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone
  FROM (SELECT root, centre, count(*) AS k FROM own GROUP BY ALL)),
put AS MATERIALIZED (
  SELECT own.root, own.image_id, CASE WHEN big.n - gone > {cap} THEN centre ELSE 0 END AS centre
  FROM own JOIN cum USING (root, centre) JOIN big USING (root)),
split AS MATERIALIZED (
  SELECT image_id, CASE WHEN count(*) OVER w > 1 THEN min(image_id) OVER w END AS group_id FROM put WINDOW w AS (PARTITION BY root, centre)
  UNION ALL SELECT id, root FROM comp WHERE root NOT IN (SELECT root FROM big))"""
