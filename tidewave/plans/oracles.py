"""The registered queries in SQL (DuckDB's dialect) over views of the same tables, written on their own."""

from __future__ import annotations

import math

from ..functions.scalars import config_hash
from ..sources.settings import Settings

DAY = 86400.0

SAMPLES = """samples AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id AS seq,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, event_type AS channel, value FROM events)"""
SPANS = "spans AS (SELECT record_id, 0e0 AS w0, max(t) AS w9 FROM samples GROUP BY record_id)"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0e0 AS {name}"


def windows(length: float, stride: float, most: int | None, extra: str = "") -> str:
    """Windows of spans(record_id, w0, w9), the first ``most`` of each or all."""
    more = f", {extra}" if extra else ""
    number = f"CAST(floor((w9 - w0 - {length} + 1e-6) / {stride}) AS BIGINT) + 1"
    number, free = (number, "") if most is None else (f"least({most}, {number})", f" AND n < {most}")
    return f"""windows AS (
  SELECT record_id{more}, CAST(k AS INTEGER) AS window_id,
    CASE WHEN w9 - w0 <= {length} THEN w0 WHEN k = n THEN greatest(w0, w9 - {length}) ELSE w0 + k * {stride} END AS w_start,
    CASE WHEN w9 - w0 <= {length} THEN w9 WHEN k = n THEN w9 ELSE w0 + k * {stride} + {length} END AS w_end
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN w9 - w0 <= {length} THEN 0 WHEN w0 + (n - 1) * {stride} + {length} < w9 - 0.25 * {length}{free} THEN n ELSE n - 1 END)) AS k
    FROM (SELECT *, {number} AS n FROM spans WHERE w9 > w0)))"""


BASE = f"WITH {SAMPLES}, {SPANS}, {windows(2 * DAY, DAY, 240)}"


def stats(source: str, keys: str) -> str:
    """The eleven statistics of rows (keys, seq, value)."""
    return f"""steps AS (SELECT *, CASE WHEN value IS NOT NULL THEN value - lag(value) OVER (PARTITION BY {keys}, value IS NOT NULL ORDER BY seq) END AS d FROM {source}),
features AS (SELECT {keys}, count(*) AS n_rows, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
  quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.1) AS q10, quantile_cont(value, 0.9) AS q90, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr,
  sqrt(avg(value * value)) AS rms, CASE WHEN count(value) > 0 THEN coalesce(stddev_pop(d), 0) END AS diff_std, CASE WHEN count(value) > 0 THEN coalesce(max(abs(d)), 0) END AS diff_abs_max
  FROM steps GROUP BY {keys})"""


def interpolated(samples: str, grid: str, keys: list[str]) -> str:
    """lines(keys, i, x, v): the series of ``samples`` (keys, seq, t, value) at the points of ``grid`` (keys, i, x)."""
    k = ", ".join(keys)
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)
    return f"""pts AS (SELECT {k}, t, arg_min(value, seq) AS value FROM {samples} WHERE value IS NOT NULL GROUP BY {k}, t),
cnt AS (SELECT {k}, count(*) AS n, min(t) AS t_first, max(t) AS t_last, arg_min(value, t) AS v_first, arg_max(value, t) AS v_last FROM pts GROUP BY {k}),
segs AS (SELECT {k}, t AS ta, value AS va, lead(t) OVER (PARTITION BY {k} ORDER BY t) AS tb, lead(value) OVER (PARTITION BY {k} ORDER BY t) AS vb FROM pts),
lines AS (SELECT g.*, CASE WHEN coalesce(c.n, 0) < 2 THEN 0 WHEN g.x < c.t_first THEN c.v_first WHEN g.x >= c.t_last THEN c.v_last ELSE s.va + (s.vb - s.va) * (g.x - s.ta) / (s.tb - s.ta) END AS v
  FROM {grid} g LEFT JOIN cnt c ON {on('g', 'c')} ASOF LEFT JOIN segs s ON {on('g', 's')} AND g.x >= s.ta)"""


FILES = """files AS (SELECT doc_id, lang, kind, concat_ws('_', kind, CAST(doc_id AS VARCHAR), 'class-' || lang, '16：' || CAST(doc_id % 60 AS VARCHAR)) AS stem
  FROM (SELECT doc_id, lang, unnest(CASE WHEN doc_id % 11 = 0 THEN ['IR'] WHEN doc_id % 13 = 0 THEN ['radar'] ELSE ['ir', 'Radar'] END) AS kind FROM documents)),
parsed AS (SELECT '/in/' || stem || CASE WHEN lower(kind) = 'ir' THEN '.mp4' ELSE '.mat' END AS path, lower(kind) AS kind, CAST(doc_id AS VARCHAR) AS record_id, 'class-' || lang AS label, '16:' || CAST(doc_id % 60 AS VARCHAR) AS start_time FROM files)"""

CHOICE = """variances AS (SELECT record_id, channel, var_pop(value) AS v FROM samples WHERE value IS NOT NULL GROUP BY ALL),
channels AS (SELECT channel, count(*) AS coverage, median(v) AS spread FROM variances GROUP BY channel),
fit AS (SELECT * FROM channels WHERE coverage >= (SELECT greatest(1, ceil(count(DISTINCT record_id) * 0.5)) FROM samples) OR (SELECT max(coverage) FROM channels) < (SELECT greatest(1, ceil(count(DISTINCT record_id) * 0.5)) FROM samples)),
chosen AS (SELECT *, CAST(row_number() OVER (ORDER BY coverage DESC, spread DESC, channel) AS INTEGER) AS rank FROM fit)"""


def robust(source: str, keys: str, least: float, std: bool, bound: float | None) -> str:
    """scaled: rows of ``source`` with z."""
    ladder = f"CASE WHEN s >= {least} THEN s " + (f"WHEN sd >= {least} THEN sd " if std else "") + "ELSE 1 END"
    z = f"(value - m) / ({ladder})"
    z = f"greatest(-{bound}, least({bound}, {z}))" if bound else z
    return f"""med AS (SELECT *, median(value) OVER (PARTITION BY {keys}) AS m, stddev_pop(value) OVER (PARTITION BY {keys}) AS sd FROM {source}),
mads AS (SELECT *, 1.4826 * median(abs(value - m)) OVER (PARTITION BY {keys}) AS s FROM med),
scaled AS (SELECT *, {z} AS z FROM mads)"""


def alignment() -> str:
    """found(record_id, offset, score, status) of click against view, days, rate 2, ten lags each way."""
    sides = {}
    for name, channel in (("l", "click"), ("r", "view")):
        sides[name] = interpolated(f"{name}s", "grid", ["record_id"])
        for x in ("pts", "cnt", "segs", "lines"):
            sides[name] = sides[name].replace(x + " ", f"{name}{x} ").replace(f"FROM {x}", f"FROM {name}{x}").replace(f"JOIN {x}", f"JOIN {name}{x}")
    line = lambda n: f"""{n}d AS (SELECT record_id, i, v - (avg(v) OVER w + coalesce(covar_pop(i, v) OVER w / nullif(var_pop(i) OVER w, 0), 0) * (i - avg(i) OVER w)) AS y, count(*) OVER w AS n FROM {n}lines WINDOW w AS (PARTITION BY record_id)),
{n}z AS (SELECT record_id, i, n, CASE WHEN stddev_pop(y) OVER w >= 1e-8 THEN y / stddev_pop(y) OVER w END AS y FROM {n}d WINDOW w AS (PARTITION BY record_id))"""  # noqa: E731
    return f"""WITH {SAMPLES},
ls AS (SELECT record_id, seq, t / {DAY} AS t, value FROM samples WHERE channel = 'click'), rs AS (SELECT record_id, seq, t / {DAY} AS t, value FROM samples WHERE channel = 'view'),
le AS (SELECT record_id, count(*) AS n, max(t) AS e FROM ls GROUP BY 1), re AS (SELECT record_id, count(*) AS n, max(t) AS e FROM rs GROUP BY 1),
sizes AS (SELECT record_id, le.n AS ln, re.n AS rn, le.e AS left_duration, re.e AS right_duration, least(le.e, re.e) AS duration FROM le JOIN re USING (record_id)),
grid AS (SELECT record_id, i, i * 0.5e0 AS x FROM (SELECT record_id, unnest(generate_series(0, CAST(ceil(duration / 0.5) AS BIGINT) - 1)) AS i FROM sizes WHERE ln >= 4 AND rn >= 4 AND duration > 2)),
{sides['l']}, {sides['r']}, {line('l')}, {line('r')},
lags AS (SELECT unnest(generate_series(-10, 10)) AS lag),
sums AS (SELECT a.record_id, lag, any_value(a.n) AS n, round(sum(a.y * b.y), 9) AS c FROM lz a CROSS JOIN lags JOIN rz b ON a.record_id = b.record_id AND b.i = a.i + lag GROUP BY a.record_id, lag),
best AS (SELECT record_id, c, lag, n FROM (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY c DESC NULLS LAST, lag) AS k FROM sums) WHERE k = 1),
found AS (SELECT s.record_id, left_duration, right_duration, CASE WHEN ln < 4 OR rn < 4 THEN 'insufficient_activity' WHEN duration <= 2 THEN 'insufficient_duration' WHEN c IS NULL THEN 'flat_activity' ELSE 'ok' END AS status,
  CASE WHEN c IS NULL THEN 0 ELSE lag / 2e0 END AS off, CASE WHEN c IS NULL THEN 0 ELSE greatest(-1, least(1, c / greatest(1, n - abs(lag)))) END AS score FROM sizes s LEFT JOIN best USING (record_id))"""


LABELLED = "records AS (SELECT c_custkey AS record_id, c_mktsegment AS label, c_custkey % 4 AS windows FROM customer)"
SCORES = "scores AS (SELECT user_id AS record_id, CAST(day(ts) AS INTEGER) AS window_id, event_type AS class, value / 500 AS prob FROM events)"
PREDICTIONS = """p AS (SELECT doc_id AS record_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label,
  CASE WHEN n_chars > 20000 THEN 'long' WHEN n_chars > 500 THEN 'good' ELSE 'poor' END AS prediction FROM labels JOIN documents USING (doc_id))"""
PER_CLASS = f"""{PREDICTIONS}, names AS (SELECT label AS class FROM p UNION SELECT prediction FROM p),
c AS (SELECT class, (SELECT count(*) FROM p WHERE label = class AND prediction = class) AS tp, (SELECT count(*) FROM p WHERE label <> class AND prediction = class) AS fp, (SELECT count(*) FROM p WHERE label = class AND prediction <> class) AS fn FROM names),
m AS (SELECT class, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1, tp, fp, fn, CAST(tp + fn AS BIGINT) AS support FROM c)"""

SUMMARY_OF = """aggregates AS (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings)"""
SPECTRUM = f"""WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS v, len(embedding) AS m FROM embeddings),
d AS (SELECT vec_id, i, m, v - (avg(v) OVER w + covar_pop(i, v) OVER w / nullif(var_pop(i) OVER w, 0) * (i - avg(i) OVER w)) AS x FROM e WINDOW w AS (PARTITION BY vec_id)),
f AS (SELECT vec_id, m, k, sum(x * cos(2 * {math.pi!r} * ((k * i) % m) / m)) AS c, sum(x * sin(2 * {math.pi!r} * ((k * i) % m) / m)) AS s FROM (SELECT *, unnest(generate_series(1, m // 2)) AS k FROM d) GROUP BY vec_id, m, k),
p AS (SELECT vec_id, m, k, k * 8e0 / m AS hz, (CASE WHEN 2 * k = m THEN 1 ELSE 2 END) * (c * c + s * s) / (8e0 * m) AS power FROM f),
q AS (SELECT *, sum(power) OVER (PARTITION BY vec_id) AS total, count(*) OVER (PARTITION BY vec_id) AS nk FROM p)
SELECT vec_id, {r("-sum(power / total * ln(power / total + 1e-12)) / ln(any_value(nk))", "spectral_entropy", 5)}, {r("arg_max(hz, power)", "dominant_hz", 5)},
  {", ".join(r(f"sum(CASE WHEN hz >= {b * 0.5} AND hz < {(b + 1) * 0.5} THEN power ELSE 0 END) / (any_value(total) + 1e-12)", f"band_{b}", 5) for b in range(8))} FROM q GROUP BY vec_id"""

FEATURE_ROWS = f"""WITH {SAMPLES}, {SPANS}, {windows(DAY / 4, DAY / 4, None)},
dt AS (SELECT record_id, t - lag(t) OVER (PARTITION BY record_id ORDER BY seq) AS d FROM samples), clock AS (SELECT record_id, coalesce(1 / median(d) FILTER (d > 0), 1) AS hz FROM dt GROUP BY record_id),
filled AS (SELECT * FROM samples), {robust('filled', 'record_id, channel', 1e-8, True, None)},
moves AS (SELECT record_id, seq, coalesce(z - lag(z) OVER (PARTITION BY record_id, channel ORDER BY seq), 0) AS d FROM scaled),
act AS (SELECT record_id, seq, sqrt(avg(d * d)) AS activity FROM moves GROUP BY record_id, seq),
held AS (SELECT record_id, window_id, seq, w_start, w_end FROM samples JOIN windows USING (record_id) WHERE w_start <= t AND t < w_end),
bare AS (SELECT * FROM windows w WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.record_id = w.record_id AND h.window_id = w.window_id)),
near AS (SELECT record_id, window_id, seq, w_start, w_end, row_number() OVER (PARTITION BY record_id, window_id ORDER BY abs(t - (w_start + w_end) / 2), seq) AS k FROM bare JOIN samples USING (record_id)),
chosen AS (SELECT * FROM held UNION ALL SELECT record_id, window_id, seq, w_start, w_end FROM near WHERE k = 1),
lines AS (SELECT record_id, window_id, 'col__' || channel AS series, seq, value FROM chosen JOIN samples USING (record_id, seq) UNION ALL SELECT record_id, window_id, 'activity', seq, activity FROM chosen JOIN act USING (record_id, seq)),
{stats('lines', 'record_id, window_id, series')},
e AS (SELECT record_id, window_id, series, row_number() OVER w - 1 AS i, value AS v, count(*) OVER (PARTITION BY record_id, window_id, series) AS m FROM lines WHERE value IS NOT NULL WINDOW w AS (PARTITION BY record_id, window_id, series ORDER BY seq)),
flat AS (SELECT record_id, window_id, series, i, m, v - (avg(v) OVER w + covar_pop(i, v) OVER w / nullif(var_pop(i) OVER w, 0) * (i - avg(i) OVER w)) AS x FROM e WHERE m >= 4 WINDOW w AS (PARTITION BY record_id, window_id, series)),
f AS (SELECT record_id, window_id, series, m, k, sum(x * cos(2 * {math.pi!r} * ((k * i) % m) / m)) AS c, sum(x * sin(2 * {math.pi!r} * ((k * i) % m) / m)) AS s FROM (SELECT *, unnest(generate_series(1, m // 2)) AS k FROM flat) GROUP BY ALL),
p AS (SELECT *, k * hz / m AS freq, (CASE WHEN 2 * k = m THEN 1 ELSE 2 END) * (c * c + s * s) / (hz * m) AS power FROM f JOIN clock USING (record_id)),
q AS (SELECT *, sum(power) OVER w AS total, count(*) OVER w AS nk FROM p WINDOW w AS (PARTITION BY record_id, window_id, series)),
spectra AS (SELECT record_id, window_id, series, CASE WHEN any_value(total) > 0 THEN -sum(power / total * ln(power / total + 1e-12)) / ln(any_value(nk)) ELSE 0 END AS spectral_entropy,
  CASE WHEN any_value(total) > 0 THEN arg_max(freq, power) ELSE 0 END AS dominant_hz,
  {", ".join(f"CASE WHEN any_value(total) > 0 THEN sum(CASE WHEN freq >= {b} * hz / 16 AND freq < {b + 1} * hz / 16 THEN power ELSE 0 END) / (any_value(total) + 1e-12) END AS band_{b}" for b in range(8))} FROM q GROUP BY record_id, window_id, series),
facts AS (SELECT record_id, window_id, count(*) AS rows, any_value(w_end - w_start) AS duration FROM chosen GROUP BY record_id, window_id),
valid AS (SELECT record_id, window_id, count(value) / count(*) AS valid_ratio FROM chosen JOIN samples USING (record_id, seq) GROUP BY record_id, window_id)
SELECT record_id, window_id, series, n, {", ".join(r(c, c, 5) for c in ("mean", "std", "min", "max", "median", "q10", "q90", "iqr", "rms", "diff_std", "diff_abs_max", "spectral_entropy", "dominant_hz", *(f"band_{b}" for b in range(8)), "duration", "valid_ratio"))}, rows,
  {r("least(1, rows / greatest(1, duration * hz))", "coverage", 5)} FROM features LEFT JOIN spectra USING (record_id, window_id, series) JOIN facts USING (record_id, window_id) JOIN valid USING (record_id, window_id) JOIN clock USING (record_id)"""

SQL: dict[str, str] = {
    "parsed_file_names": f"WITH {FILES} SELECT path, kind, record_id, label, start_time FROM parsed",
    "record_pairs": f"""WITH {FILES}, g AS (SELECT record_id, count(*) FILTER (kind = 'radar') AS nl, count(*) FILTER (kind = 'ir') AS nr, min(label) AS label, max(label) AS other,
  min(path) FILTER (kind = 'radar') AS left_path, min(path) FILTER (kind = 'ir') AS right_path, min(start_time) AS start_time FROM parsed GROUP BY record_id)
SELECT record_id, label, left_path, right_path, start_time, CASE WHEN nl > 1 OR nr > 1 THEN 'duplicate' WHEN label <> other THEN 'label_conflict' WHEN nr = 0 THEN 'left_only' WHEN nl = 0 THEN 'right_only' ELSE 'ok' END AS status FROM g""",
    "clean_unique_names": r"""WITH RECURSIVE h AS (SELECT page_id, url, coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(url, '://([^/]*)', 1), '[^0-9A-Za-z_\x{4e00}-\x{9fff}]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS host FROM pages),
n AS MATERIALIZED (SELECT page_id, page_id // 16 AS table_id, CASE WHEN page_id % 5 = 4 THEN host || '_2' ELSE host END AS name, row_number() OVER (PARTITION BY page_id // 16 ORDER BY page_id) AS i FROM h),
r(table_id, i, used) AS (SELECT DISTINCT table_id, 0::BIGINT, []::VARCHAR[] FROM n
 UNION ALL SELECT r.table_id, n.i, list_append(r.used, CASE WHEN list_contains(r.used, n.name) THEN list_filter(list_transform(range(2, len(r.used) + 3), lambda k: n.name || '_' || CAST(k AS VARCHAR)), lambda x: NOT list_contains(r.used, x))[1] ELSE n.name END) FROM r JOIN n ON n.table_id = r.table_id AND n.i = r.i + 1)
SELECT page_id, n.table_id, name, r.used[n.i] AS unique_name FROM n JOIN r ON r.table_id = n.table_id AND r.i = n.i""",
    "checked_files": "SELECT '/in/' || CAST(doc_id AS VARCHAR) AS path, n_chars + 1 AS size FROM documents",
    "record_keys": f"""SELECT CAST(page_id AS VARCHAR) AS record_id, substr(sha256('{{"record_id":"' || CAST(page_id AS VARCHAR) || '","left":"' || substr(sha256(url || '|' || CAST(strlen(html) AS VARCHAR) || '|1'), 1, 16)
  || '","right":"' || substr(sha256('r|' || CAST(page_id AS VARCHAR) || '|2'), 1, 16) || '","settings":"{config_hash(Settings().computed_with())}","schema":"a,b","version":3}}'), 1, 20) AS cache_key FROM pages""",
    "lenient_numbers": f"""WITH t AS (SELECT p_partkey, p_size, CASE p_partkey % 5 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) || '/' || CAST(p_partkey % 4 AS VARCHAR) WHEN 2 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END AS text FROM part)
SELECT p_partkey, {r("CASE WHEN p_partkey % 5 = 1 THEN CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size / (p_partkey % 4) END WHEN p_partkey % 5 IN (0, 2) THEN 0 ELSE p_size END", "ratio")},
  CASE WHEN p_partkey % 5 IN (3, 4) THEN CAST(p_size AS BIGINT) ELSE 0 END AS whole, {r("CASE WHEN p_partkey % 5 IN (3, 4) THEN CAST(p_size AS DOUBLE) ELSE 0 END", "number")} FROM t""",
    "derived_lengths": f"""WITH t AS (SELECT l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 0 END AS f, l_quantity AS q, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_extendedprice END AS d FROM lineitem)
SELECT l_linenumber, CAST(sum(coalesce(nullif(f, 0), CAST(round_even(nullif(d, 0) * q, 0) AS BIGINT), 0)) AS BIGINT) AS frames, {r("sum(round(coalesce(nullif(d, 0), nullif(f, 0) / nullif(q, 0), 0), 3))", "duration", 2)} FROM t GROUP BY l_linenumber""",
    "fingerprints": """SELECT page_id, substr(sha256(url || '|' || CAST(strlen(html) AS VARCHAR) || '|' || CAST(page_id AS VARCHAR)), 1, 16) AS fingerprint, substr(sha256(url || ':3'), 1, 20) AS cache_key, sha256(html) AS sha256 FROM pages""",
    "array_table_cells": f"""WITH r AS (SELECT vec_id, embedding, unnest(range(8)) AS rw FROM embeddings),
c AS (SELECT vec_id, embedding, rw, unnest(range(11)) AS c FROM r)
SELECT vec_id, CAST(c AS INTEGER) AS "column", CASE WHEN c < 8 THEN 'a_b_' || CAST(c + 1 AS VARCHAR) WHEN c < 10 THEN 'a_b_' || CAST(c - 7 AS VARCHAR) || '_2' ELSE 'a_b_1_3' END AS name, CAST(rw AS INTEGER) AS "row",
  {r('CAST(CASE WHEN c < 8 THEN embedding[rw * 8 + c + 1] WHEN c < 10 THEN embedding[(c - 8) * 8 + rw + 1] WHEN rw < 5 THEN embedding[rw + 1] END AS DOUBLE)', 'value')} FROM c""",
    "container_tables": "SELECT CAST(vec_id AS VARCHAR) AS vec_id, rw AS seq, " + ", ".join(r(f"CAST(embedding[{16 * c} + rw + 1] AS DOUBLE)", f"m_{c}") for c in range(4)) + " FROM (SELECT vec_id, embedding, unnest(range(16)) AS rw FROM embeddings WHERE vec_id IS NOT NULL)",
    "transposed_rows": "SELECT CAST(c - 1 AS INTEGER) AS \"row\", " + ", ".join(f"max(CASE WHEN r_regionkey = {k} THEN CASE WHEN c = 6 THEN CAST(length(r_name) AS DOUBLE) ELSE r_regionkey * CAST(c AS DOUBLE) END END) AS signal_{k}" for k in range(5)) + " FROM region, range(1, 7) t(c) GROUP BY c",
    "vector_summaries": f"WITH {SUMMARY_OF} SELECT vec_id, {r('list_avg(a)', 'mean')}, {r('list_stddev_pop(a)', 'std')}, {r('list_max(a)', 'max')}, {r('list_avg(list_transform(a, lambda x: x * x))', 'energy')} FROM aggregates",
    "vector_columns": "SELECT vec_id, " + ", ".join(r(f"abs(CAST(embedding[{i}] AS DOUBLE))", f"v_{i}") for i in range(1, 65)) + " FROM embeddings",
    "column_profiles": " UNION ALL ".join(f"SELECT '{c}' AS channel, count(*) AS n_rows, count({x}) AS n_finite, {r(f'count({x}) / count(*)', 'valid_ratio')} FROM lineitem" for c, x in (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_gap", "CASE WHEN l_linenumber > 2 THEN l_tax END"))),
    "numeric_frames": f"""SELECT event_id, {r('epoch_us(ts) / 1e6', 'ts')}, {r('sqrt(value * value + (value * 0.75) * (value * 0.75))', 'z_abs')}, {r('value', 'z_real')}, {r('value * 0.75', 'z_imag')},
  {r('CASE WHEN event_id % 3 = 0 THEN value END', 'z_abs_1')}, {r('CASE WHEN user_id % 2 = 0 THEN 1e0 ELSE 0e0 END', 'even')} FROM events""",
    "winsor_scaled_prices": """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS lo, quantile_cont(l_extendedprice, 0.995) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN hi > lo THEN floor((least(hi, greatest(lo, l_extendedprice)) - lo) / (hi - lo) * 255) ELSE 0 END AS BIGINT) AS scaled FROM lineitem JOIN q USING (l_returnflag)""",
    "feature_matrix": f"""{BASE}, j AS (SELECT record_id, window_id, channel, value FROM samples JOIN windows USING (record_id) WHERE w_start <= t AND t < w_end)
SELECT record_id, window_id, {", ".join(r(f"{s}(value) FILTER (channel = '{c}')", f"col__{c}__{n}") for c in ("click", "view") for n, s in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) if n in ("mean", "max"))} FROM j GROUP BY record_id, window_id""",
    "record_clock": f"""WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY record_id ORDER BY seq) AS d FROM samples),
g AS (SELECT record_id, count(*) AS n, coalesce(bool_and(d >= 0), true) AS monotonic, median(d) FILTER (d > 0) AS step, arg_max(t, seq) - arg_min(t, seq) AS length FROM d GROUP BY record_id)
SELECT record_id, n, monotonic, {r('coalesce(1 / step, 1)', 'rate_hz', 4)}, {r('length + 1 / greatest(coalesce(1 / step, 1), 1e-9)', 'duration', 4)} FROM g""",
    "inferred_clock": f"""WITH m AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id AS seq, epoch_us(ts) / 1000 AS x FROM events),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY record_id ORDER BY seq) AS d, first_value(x) OVER (PARTITION BY record_id ORDER BY seq) AS x0 FROM m),
g AS (SELECT record_id, max(x - x0) AS last, median(d) FILTER (d > 0) AS step FROM d GROUP BY record_id)
SELECT record_id, 'event_time' AS time_source, {r('last / CASE WHEN step > 1e6 THEN 1e9 ELSE 1e3 END', 'last', 4)}, {r('1 / greatest(step / CASE WHEN step > 1e6 THEN 1e9 ELSE 1e3 END, 1e-9)', 'rate_hz', 4)} FROM g""",
    "scaled_samples": f"""WITH {SAMPLES}, gaps AS (SELECT record_id, seq, channel, CASE WHEN seq % 10 = 0 THEN NULL ELSE value END AS value FROM samples),
filled AS (SELECT record_id, seq, channel, coalesce(value, median(value) OVER (PARTITION BY record_id, channel), 0) AS value FROM gaps), {robust('filled', 'record_id, channel', 1e-8, True, 8.0)}
SELECT record_id, seq, channel, {r('value', 'value')}, {r('z', 'z')} FROM scaled""",
    "row_activity": f"""WITH {SAMPLES}, filled AS (SELECT * FROM samples), {robust('filled', 'record_id, channel', 1e-8, True, None)},
steps AS (SELECT record_id, seq, coalesce(z - lag(z) OVER (PARTITION BY record_id, channel ORDER BY seq), 0) AS d FROM scaled)
SELECT record_id, seq, {r('sqrt(avg(d * d))', 'activity')} FROM steps GROUP BY record_id, seq""",
    "inspection": f"""WITH {SAMPLES}, d AS (SELECT *, t - lag(t) OVER (PARTITION BY record_id ORDER BY seq) AS d FROM samples),
g AS (SELECT record_id, count(*) AS n_rows, count(*) - count(value) AS n_missing, array_to_string(list_sort(list_distinct(list(channel))), ',') AS channels, min(value) AS least, max(value) AS greatest, coalesce(1 / median(d) FILTER (d > 0), 1) AS rate, arg_max(t, seq) - arg_min(t, seq) AS length, coalesce(bool_and(d >= 0), true) AS mono FROM d GROUP BY record_id)
SELECT record_id, n_rows, n_missing, channels, {r('least', 'least', 4)}, {r('greatest', 'greatest', 4)}, {r('rate', 'rate_hz', 4)}, {r('length + 1 / greatest(rate, 1e-9)', 'duration', 4)}, CASE WHEN n_rows = n_missing THEN 'no finite value' WHEN NOT mono THEN 'times fall' END AS error FROM g""",
    "hopping_windows": f"{BASE} SELECT record_id, window_id, {r('w_start', 'w_start', 4)}, {r('w_end', 'w_end', 4)} FROM windows",
    "window_features": f"""{BASE}, j AS (SELECT record_id, window_id, channel, seq, value, w_start, w_end FROM samples JOIN windows USING (record_id) WHERE w_start <= t AND t < w_end), {stats('j', 'record_id, window_id, channel, w_start, w_end')}
SELECT record_id, window_id, channel, n_rows, n, {", ".join(r(c, c) for c in ("mean", "std", "min", "max", "median", "q10", "q90", "iqr", "rms", "diff_std", "diff_abs_max"))}, {r(f'least(1, n_rows / greatest(1, (w_end - w_start) / {DAY}))', 'coverage')} FROM features""",
    "nearest_for_empty_windows": f"""WITH {SAMPLES}, {SPANS}, {windows(DAY / 4, DAY / 4, 200)},
j AS (SELECT record_id, window_id, seq, value FROM samples JOIN windows USING (record_id) WHERE w_start <= t AND t < w_end),
e AS (SELECT * FROM windows w WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.record_id = w.record_id AND j.window_id = w.window_id)),
k AS (SELECT record_id, window_id, seq, value, row_number() OVER (PARTITION BY record_id, window_id ORDER BY abs(t - (w_start + w_end) / 2), seq) AS k FROM e JOIN samples USING (record_id)),
b AS (SELECT *, false AS near FROM j UNION ALL SELECT record_id, window_id, seq, value, true FROM k WHERE k = 1)
SELECT record_id, window_id, count(*) AS n, min(seq) AS first_seq, bool_or(near) AS nearest, {r('avg(value)', 'mean')} FROM b GROUP BY record_id, window_id""",
    "evenly_chosen_rows": f"""WITH {SAMPLES}, n AS (SELECT record_id, seq, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n FROM samples WINDOW w AS (PARTITION BY record_id ORDER BY seq))
SELECT n.record_id, CAST(j AS INTEGER) AS place, seq FROM n, range(6) t(j) WHERE i = round_even(j * (n.n - 1) / 5, 0)""",
    "decimated_rows": f"""WITH {SAMPLES}, n AS (SELECT record_id, seq, CAST(row_number() OVER (PARTITION BY record_id ORDER BY seq) - 1 AS INTEGER) AS idx FROM samples)
SELECT record_id, idx, seq, {r('idx / 5e0', 't_idx')} FROM n WHERE idx % 2 = 0 AND idx < 24""",
    "capped_rows": f"""WITH {SAMPLES}, u AS (SELECT *, row_number() OVER (PARTITION BY record_id, channel, t ORDER BY seq) AS k FROM samples)
SELECT record_id, seq, channel FROM u WHERE k = 1 QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY seq) <= 5""",
    "vector_spectra": SPECTRUM,
    "vector_spectra_fft": SPECTRUM,
    "daily_grid": f"""WITH {SAMPLES}, ends AS (SELECT record_id, channel, max(t) AS e FROM samples GROUP BY ALL),
grid AS (SELECT record_id, channel, i, i * {DAY} AS x FROM (SELECT record_id, channel, unnest(generate_series(0, CAST(ceil(e / {DAY}) AS BIGINT) - 1)) AS i FROM ends WHERE e > 0)), {interpolated('samples', 'grid', ['record_id', 'channel'])}
SELECT record_id, channel, i, {r('v', 'value')} FROM lines""",
    "window_tensors": f"""WITH {SAMPLES}, {SPANS}, {windows(2 * DAY, DAY, 240)}, {CHOICE},
grid AS (SELECT record_id, window_id, channel, i, w_start + i * (w_end - w_start) / 16 AS x FROM windows, (SELECT channel FROM chosen WHERE rank <= 3), range(16) t(i)), {interpolated('samples', 'grid', ['record_id', 'channel'])},
flat AS (SELECT record_id, window_id, channel, i, v AS value FROM lines), {robust('flat', 'record_id, window_id, channel', 1e-6, False, 8.0)}
SELECT record_id, window_id, channel, CAST(i AS INTEGER) AS i, {r('z', 'z', 5)} FROM scaled""",
    "record_alignment": f"{alignment()} SELECT record_id, {r('off', '\"offset\"', 5)}, {r('score', 'score', 5)}, status FROM found",
    "aligned_windows": f"""{alignment()},
both_ AS (SELECT *, greatest(0, off) AS a, least(right_duration, left_duration + off) AS b FROM found),
spans AS (SELECT record_id, off, left_duration, CASE WHEN b - a < 1 THEN 0 ELSE a END AS w0, CASE WHEN b - a < 1 THEN least(right_duration, left_duration) ELSE b END AS w9 FROM both_), {windows(4.0, 2.0, 240, 'off, left_duration')}
SELECT record_id, window_id, {r('w_start', 'w_start', 5)}, {r('w_end', 'w_end', 5)}, {r('greatest(0, w_start - off)', 'l_start', 5)}, {r('least(left_duration, w_end - off)', 'l_end', 5)} FROM windows WHERE least(left_duration, w_end - off) > greatest(0, w_start - off)""",
    "channel_choice": f"WITH {SAMPLES}, {CHOICE} SELECT channel, coverage, {r('spread', 'spread', 4)}, rank FROM chosen WHERE rank <= 3",
    "channel_lookup": f"""WITH {SAMPLES}, {CHOICE}, means AS (SELECT record_id, channel, avg(value) AS value FROM samples GROUP BY ALL HAVING avg(value) > 40)
SELECT k.record_id, c.channel, {r('coalesce(m.value, 0)', 'value')} FROM (SELECT DISTINCT record_id FROM means) k CROSS JOIN (SELECT channel FROM chosen WHERE rank <= 4) c LEFT JOIN means m ON m.record_id = k.record_id AND m.channel = c.channel""",
    "class_weight_table": f"""WITH {LABELLED}, n AS (SELECT label, count(*) AS n FROM records GROUP BY label)
SELECT label, n, {r('(SELECT count(*) FROM records) / ((SELECT count(*) FROM n) * n)', 'weight')}, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM n""",
    "window_sample_weights": f"""WITH {LABELLED}, refs AS (SELECT record_id, label, windows, unnest(range(windows)) AS window_id FROM records WHERE windows > 0), c AS (SELECT label, count(DISTINCT record_id) AS k FROM refs GROUP BY label)
SELECT record_id, CAST(window_id AS INTEGER) AS window_id, label, {r('1e0 / windows / k', 'weight', 9)} FROM refs JOIN c USING (label)""",
    "record_folds": f"""WITH {LABELLED} SELECT record_id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY md5('2026:' || CAST(record_id AS VARCHAR)), record_id) - 1) % least(5, (SELECT min(n) FROM (SELECT count(*) AS n FROM records GROUP BY label))) AS INTEGER) AS fold FROM records""",
    "left_out_folds": "SELECT CAST(r_regionkey AS INTEGER) AS record_id, 'A' AS label, CAST(r_regionkey AS INTEGER) AS fold FROM region WHERE r_regionkey < 4",
    "weighted_drawing": """WITH items AS (SELECT s_suppkey, CAST(greatest(0, floor(s_acctbal)) AS DOUBLE) AS w, CAST(floor(('0x' || substr(md5('part:' || CAST(s_suppkey AS VARCHAR)), 1, 8))::BIGINT / 4294967296e0 * 64) AS INTEGER) AS part FROM supplier),
sums AS (SELECT s_suppkey, sum(w) OVER (ORDER BY part, s_suppkey) AS hi, w, sum(w) OVER () AS total FROM items WHERE w > 0),
draws AS (SELECT id, ('0x' || substr(md5('7:' || CAST(id AS VARCHAR)), 1, 8))::BIGINT / 4294967296e0 AS u FROM range(500) t(id))
SELECT id AS draw, s_suppkey FROM draws JOIN sums ON u * total >= hi - w AND u * total < hi""",
    "pooled_scores": f"""WITH {SCORES}, o AS (SELECT record_id, window_id, class, avg(prob) AS p FROM scores GROUP BY ALL), k AS (SELECT record_id, count(DISTINCT window_id) AS w FROM scores GROUP BY record_id),
a AS (SELECT record_id, class, sum(p) / any_value(w) AS p, any_value(w) AS w FROM o JOIN k USING (record_id) GROUP BY ALL), b AS (SELECT *, p / greatest(sum(p) OVER (PARTITION BY record_id), 1e-12) AS q FROM a)
SELECT record_id, (array_agg(class ORDER BY round(q, 12) DESC, class))[1] AS prediction, {r('max(q)', 'confidence')}, {r("max(q) FILTER (class = 'click')", 'p_click')}, max(w) AS windows FROM b GROUP BY record_id""",
    "confusion_matrix": f"""WITH {PREDICTIONS}, k AS (SELECT label AS class FROM p UNION SELECT prediction FROM p)
SELECT a.class AS label, b.class AS prediction, (SELECT count(*) FROM p WHERE p.label = a.class AND p.prediction = b.class) AS n FROM k a, k b""",
    "classification_report": f"""WITH {PER_CLASS}, t AS (SELECT class, precision, recall, f1, support FROM m
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT class, {r('precision', 'precision')}, {r('recall', 'recall')}, {r('f1', 'f1')}, CAST(support AS BIGINT) AS support FROM t""",
    "classification_summary": f"""WITH {PER_CLASS} SELECT {r('sum(tp) / sum(support)', 'accuracy')}, {r('avg(recall) FILTER (support > 0)', 'balanced_accuracy')}, {r('avg(f1)', 'macro_f1')}, {r('sum(f1 * support) / sum(support)', 'weighted_f1')} FROM m""",
    "aligned_log_loss": f"""WITH {SCORES}, a AS (SELECT record_id, class, avg(prob) AS p FROM scores GROUP BY ALL), b AS (SELECT *, p / greatest(sum(p) OVER (PARTITION BY record_id), 1e-12) AS q FROM a),
names AS (SELECT list_sort(list(DISTINCT class)) AS names FROM scores), t AS (SELECT DISTINCT record_id, names[record_id % len(names) + 1] AS label FROM scores, names)
SELECT {r('-avg(ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, coalesce(q, 0)))))', 'log_loss')}, count(*) AS n FROM t LEFT JOIN b ON b.record_id = t.record_id AND b.class = t.label""",
    "evaluation_validity": f"""WITH {LABELLED}, g AS (SELECT label, count(*) AS n, count(*) FILTER (record_id % 3 <> 0) AS d FROM records GROUP BY label)
SELECT CAST(sum(n) AS BIGINT) AS records, CAST(sum(d) AS BIGINT) AS evaluated, {r('sum(d) / sum(n)', 'coverage')}, CASE WHEN sum(d) = 0 THEN 'insufficient_independent_records' WHEN sum(d) = sum(n) AND bool_and(d > 0) AND min(n) >= 2 THEN 'valid' ELSE 'diagnostic_only' END AS status FROM g""",
    "detection_rate": f"""WITH {SAMPLES}, n AS (SELECT record_id, channel, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY record_id) AS n FROM samples WINDOW w AS (PARTITION BY record_id ORDER BY seq)),
c AS (SELECT n.record_id, channel FROM n, range(6) t(j) WHERE i = round_even(j * (n.n - 1) / 5, 0)) SELECT record_id, {r("avg(CASE WHEN channel = 'view' THEN 1 ELSE 0 END)", 'rate')} FROM c GROUP BY record_id""",
    "cache_totals": f"WITH {LABELLED} SELECT count(*) AS records, CAST(sum(windows) AS BIGINT) AS windows, count(*) FILTER (record_id % 7 = 0) AS cache_hits FROM records",
    "cache_misses": """SELECT DISTINCT o_custkey AS record_id, o_orderstatus AS cache_key FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_acctbal > 0 AND c_custkey = o_custkey AND CASE WHEN c_nationkey % 2 = 0 THEN 'O' ELSE 'F' END = o_orderstatus)""",
    "result_documents": f"""WITH {LABELLED} SELECT '{{"label":"' || label || '","n":' || CAST(count(*) AS VARCHAR) || '}}' AS json FROM records GROUP BY label""",
    "class_sets": """WITH r AS (SELECT concat_ws('#', p_brand, CAST(p_size AS VARCHAR)) AS label, p_retailprice > 1200 AS dear FROM part), a AS (SELECT DISTINCT label FROM r WHERE dear), b AS (SELECT DISTINCT label FROM r WHERE NOT dear)
SELECT label, 'first' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT label, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
    "window_feature_rows": FEATURE_ROWS,
    "recorded_sequences": f"""WITH base AS (SELECT CAST(user_id AS VARCHAR) AS record_id, event_id AS seq, epoch_us(ts) / 1e6 AS x, value, CASE WHEN event_id % 4 <> 0 THEN value * 2 END AS other FROM events),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY record_id ORDER BY seq) AS d, count(*) OVER (PARTITION BY record_id) AS n FROM base),
g AS (SELECT record_id, any_value(n) AS n, median(d) FILTER (d > 0) AS step, min(x) AS least, arg_max(x, seq) - arg_min(x, seq) AS length, (2 * count(*) + count(value) + count(other)) / (4 * count(*)) AS valid FROM d GROUP BY record_id),
c AS (SELECT record_id, n, n >= 3 AND step IS NOT NULL AS timed, step, length, valid FROM g),
cells AS (SELECT record_id, seq, 'event_time' AS channel, x AS value FROM base UNION ALL SELECT record_id, seq, 'value', value FROM base UNION ALL SELECT record_id, seq, 'other', other FROM base),
filled AS (SELECT record_id, seq, channel, coalesce(value, median(value) OVER (PARTITION BY record_id, channel), 0) AS value FROM cells), {robust('filled', 'record_id, channel', 1e-8, True, None)},
steps AS (SELECT record_id, seq, coalesce(z - lag(z) OVER (PARTITION BY record_id, channel ORDER BY seq), 0) AS d FROM scaled),
act AS (SELECT record_id, seq, sqrt(avg(d * d)) AS activity FROM steps GROUP BY record_id, seq), top AS (SELECT record_id, count(*) AS rows, max(activity) AS most FROM act GROUP BY record_id),
share AS (SELECT record_id, (count(x) + count(value) + count(other)) / (3 * count(*)) AS valid FROM base GROUP BY record_id)
SELECT record_id, {r('CASE WHEN timed THEN 1 / step ELSE 1 END', 'rate_hz', 4)}, CASE WHEN timed THEN 'event_time' ELSE 'row_index' END AS time_source,
  {r('CASE WHEN timed THEN length + 1 / greatest(1 / step, 1e-9) ELSE n - 1 + 1 END', 'duration', 4)}, {r('share.valid', 'valid_ratio', 4)}, rows, {r('most', 'most', 4)} FROM c JOIN top USING (record_id) JOIN share USING (record_id)""",
    "cached_records": "SELECT record_id, cache_key, arg_max(run, made) AS run, arg_max(windows, made) AS windows FROM (SELECT o_custkey AS record_id, o_orderstatus AS cache_key, o_orderkey AS made, 'run' || CAST(o_orderkey AS VARCHAR) AS run, o_orderkey % 5 AS windows FROM orders) GROUP BY ALL",
    "best_of_each": f"""WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY record_id, channel ORDER BY value DESC, seq) AS k FROM samples) SELECT record_id, channel, {r('value', 'value')}, seq, {r('t', 't')} FROM k WHERE k = 1""",
    "epoch_windows": f"""SELECT user_id AS record_id, {r('floor(epoch_us(ts) / 21600e6) * 21600', 'w_start')}, count(value) AS n, {r('avg(value)', 'mean')}, {r('min(value)', 'min')}, {r('max(value)', 'max')} FROM events GROUP BY user_id, floor(epoch_us(ts) / 21600e6)""",
}
