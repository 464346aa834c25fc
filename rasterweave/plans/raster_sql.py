"""The queries of raster_queries.py in plain SQL, written from the definitions and not from the plans."""

from __future__ import annotations

from rasterweave.plans import fixtures as X

# Bands with the reflectances of 0 and 255; written out again so that a slip on one side shows.
_P = {"b1": (0, 1200), "b2": (0, 1400), "b3": (0, 1600), "b4": (0, 1600), "b5": (200, 2000), "b6": (700, 3600), "b7": (900, 4400), "b8": (800, 4500), "b8a": (1000, 4700), "b11": (300, 3500), "b12": (100, 2700)}
# Index formulas and ranges.
_I = {
    "ndwi": ("(b8a-b11)/(b8a+b11+1e-6)", -1, 1),
    "dwsi": ("(b8+b3)/(b4+b11+1e-6)", 0, 5),
    "ngrdi": ("(b3-b4)/(b3+b4+1e-6)", -1, 1),
    "rdi": ("b12/(b8a+1e-6)", 0, 2),
    "gli": ("(2*b3-b2-b4)/(2*b3+b2+b4+1e-6)", -1, 1),
    "ndre2": ("(b7-b5)/(b7+b5+1e-6)", -1, 1),
    "pbi": ("b8/(b3+1e-6)", 0, 20),
    "ndvi": ("(b8a-b4)/(b8a+b4+1e-6)", -1, 1),
    "gndvi": ("(b8a-b3)/(b8a+b3+1e-6)", -1, 1),
    "cig": ("b8a/(b3+1e-6)-1", 0, 20),
    "cvi": ("b8a*b5/(b3*b3+1e-6)", 0, 50),
    "ndre3": ("(b8a-b7)/(b8a+b7+1e-6)", -1, 1),
    "drs": ("sqrt(b4*b4+b12*b12)", 100, 3300),
}


def _norm(b: str) -> str:
    p1, p99 = _P[b]
    return f"greatest(0.0::DOUBLE, least(255.0::DOUBLE, 255.0::DOUBLE * ({b} - {p1}) / {p99 - p1}))"


def _scaled(n: str) -> str:
    f, p1, p99 = _I[n]
    k = 255.0 / (p99 - p1)
    return f"{k!r}::DOUBLE * greatest(0.0::DOUBLE, least(255.0::DOUBLE, {f})) - {p1 * k!r}::DOUBLE"


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


def _fixed(expr: str, name: str, digits: int = 6) -> str:
    return f"floor(({expr}) * 1e{digits}::DOUBLE + 0.5::DOUBLE) / 1e{digits}::DOUBLE AS {name}"


_RAWD = f"WITH q AS ({X.RAW_SQL}), p AS (SELECT image_id, i, scl, {', '.join(f'CAST({b} AS DOUBLE) AS {b}' for b in _P)} FROM q)"
_DENORM = {b: f"trunc({_norm(b)}) * {_P[b][1] - _P[b][0]} + {_P[b][0]}" for b in _P}
_SERIES = f"WITH s AS ({X.SERIES_SQL}), g AS ({X.PARTITION_SQL}), r AS (SELECT s.*, grid, cluster_id FROM s JOIN g USING (i, j))"
_STATS = f"{_SERIES}, m AS (SELECT grid, cluster_id, t, c, median(v) AS centroid, stddev_pop(v) AS spread FROM r GROUP BY ALL), h AS (SELECT grid, cluster_id, c, CASE WHEN count(spread) = count(*) THEN greatest(0.05, max(spread)) END AS threshold FROM m GROUP BY ALL)"
_DEV = f"{_STATS}, d AS (SELECT r.*, r.v - m.centroid AS deviation, h.threshold FROM r JOIN m USING (grid, cluster_id, t, c) JOIN h USING (grid, cluster_id, c)), x AS (SELECT grid, cluster_id, i, j, t, bool_or(coalesce(deviation > threshold, false)) AS hit FROM d GROUP BY ALL), y AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY grid, cluster_id, i, j ORDER BY t) AS island FROM x), z AS (SELECT grid, cluster_id, i, j, island, count(*) FILTER (hit) AS n FROM y GROUP BY ALL)"
_DEGREE = "SELECT i, j, count(DISTINCT grid) AS n, CASE WHEN count(DISTINCT grid) >= 2 THEN 'flagged' ELSE 'detected' END AS degree FROM z WHERE n >= {0} GROUP BY i, j"
_CAT = f"WITH a AS ({X.CATALOG_SQL})"
_SEG = f"WITH s AS ({X.SEG_SQL})"
_CUBE = f"WITH s AS ({X.CUBE_SQL})"
_ALLBLACK = " AND ".join(f"{b} = 0" for b in _P)
_GRID = f"WITH p AS ({X.GRID_SQL}), e AS (SELECT max(i) + 1 AS h FROM p)"
_ORIGINS = f"{_GRID}, oi AS (SELECT unnest(range(0, h - 15, 10)) AS o FROM e UNION SELECT h - 16 FROM e), oj AS (SELECT unnest([0, 10, 20, 30, 34]) AS o), t AS (SELECT p.*, CAST(oi.o AS INT) AS oi, oj.o AS oj, CAST(p.i - oi.o AS INT) AS r, p.j - oj.o AS c FROM p JOIN oi ON p.i BETWEEN oi.o AND oi.o + 15 JOIN oj ON p.j BETWEEN oj.o AND oj.o + 15)"
_CROP = "((r >= 2 OR oi = 0) AND (r < 14 OR oi + 16 >= h) AND (c >= 2 OR oj = 0) AND (c < 14 OR oj + 16 >= 50))"
_PROB = f"{_ORIGINS}, q AS (SELECT *, (v * 7 + oi + oj * 3) % 16 AS a FROM t), w AS (SELECT i, j, oi, oj, r, c, 0 AS k, a / 16 AS p FROM q UNION ALL SELECT i, j, oi, oj, r, c, 1, 1 - a / 16 FROM q)"
_SCORED = f"WITH q AS ({X.SCORED_SQL}), l AS (SELECT row, image_id, i, label, unnest(scores) AS s, generate_subscripts(scores, 1) - 1 AS k FROM q), n AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY row) AS p FROM l)"
_DICE = "b AS (SELECT k, sum(CASE WHEN label = k THEN p ELSE 0 END) AS bth, sum(p) AS p, sum(CASE WHEN label = k THEN 1.0 ELSE 0 END) AS y FROM n WHERE label <> 255 GROUP BY k), dl AS (SELECT 1 - avg((2 * bth + 0.1) / (p + y + 0.1)) AS dice FROM b)"
_BURN = f"q AS ({X.RECT_SQL}), bx AS (SELECT *, CAST(floor(x0) AS INT) AS a0, CAST(floor(x0 + w) AS INT) AS a1, CAST(floor(y0) AS INT) AS c0, CAST(floor(y0 + h) AS INT) AS c1 FROM q), u AS (SELECT *, unnest(range(c0, c1 + 1)) AS i FROM bx), cells AS (SELECT poly_seq, label, i, unnest(range(a0, a1 + 1)) AS j FROM u), inside AS (SELECT poly_seq, label, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM cells WHERE i < 100 AND j < 100), burnt AS (SELECT i, j, arg_max(label, poly_seq) AS label FROM inside GROUP BY i, j)"
_CLAIMS = f"{_CUBE}, k AS (SELECT cube_id, label FROM s), f AS (SELECT cube_id, coalesce(min(label) FILTER (label BETWEEN 2 AND 5), 0) AS stratum FROM k GROUP BY cube_id)"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY {1} ORDER BY md5('42:' || {0}), {0}) - 1 AS pos, count(*) OVER (PARTITION BY {1}) AS n FROM {2}"
_CUTS = "SELECT *, CASE WHEN floor(n * 0.8) = 0 OR floor(n * 0.9) = floor(n * 0.8) OR floor(n * 0.9) = n THEN n - 2 ELSE floor(n * 0.8) END AS a, CASE WHEN floor(n * 0.8) = 0 OR floor(n * 0.9) = floor(n * 0.8) OR floor(n * 0.9) = n THEN n - 1 ELSE floor(n * 0.9) END AS b FROM ranked"
_NAMED = "CASE WHEN pos < a THEN 'train' WHEN pos < b THEN 'val' ELSE 'test' END AS split"
_VEC = f"{_SERIES}, v AS (SELECT i, j, t, c, v FROM s), off AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) AS o(di, dj)), pr AS (SELECT a.i, a.j, b.i AS i2, b.j AS j2, a.t, sum(coalesce((a.v - b.v) * (a.v - b.v), 0)) AS d, bool_and(a.v IS NOT NULL AND b.v IS NOT NULL) AS ok FROM v a, off, v b WHERE b.i = a.i + di AND b.j = a.j + dj AND a.t = b.t AND a.c = b.c GROUP BY ALL), ed AS (SELECT i, j, i2, j2, sqrt(sum(d)) / (count(*) FILTER (ok) + 1e-6) AS x FROM pr GROUP BY ALL HAVING count(*) FILTER (ok) > 0), edges AS (SELECT i, j, i2, j2, greatest(0.0, least(1.0, x * x)) AS weight FROM ed)"
_ADJ = f"{_VEC}, g0 AS (SELECT * FROM g WHERE grid = 0), adj AS (SELECT DISTINCT least(x.cluster_id, y.cluster_id) AS a, greatest(x.cluster_id, y.cluster_id) AS b FROM edges e JOIN g0 x ON x.i = e.i AND x.j = e.j JOIN g0 y ON y.i = e.i2 AND y.j = e.j2 WHERE x.cluster_id <> y.cluster_id)"
_RING = "least(r, c, 7 - r, 7 - c)"
_POS = "SELECT r, c, sum({0}) / nullif(count(*) FILTER (label <> 255), 0) AS accuracy FROM s GROUP BY r, c"
_BIN = "CASE WHEN {0} = 0 THEN 0 WHEN {0} = 255 THEN 255 ELSE 2 END"
_POINTS = "p AS (SELECT aoi_id, min(v.x) - 2560 AS a_xmin, min(v.y) - 2560 AS a_ymin, max(v.x) + 2560 AS a_xmax, max(v.y) + 2560 AS a_ymax FROM (SELECT aoi_id, unnest(geometry) AS v FROM aoi) WHERE isfinite(v.x) AND isfinite(v.y) GROUP BY aoi_id)"

ORACLE = {
    "historical_window": f"{_SERIES} SELECT i, j, t, c, {_r('v', 'v')} FROM s WHERE date BETWEEN DATE '2022-01-16' AND DATE '2022-03-17' AND c IN (1, 4)",
    "cluster_centroid": f"{_STATS} SELECT grid, cluster_id, t, c, {_r('centroid', 'centroid')}, {_r('spread', 'spread')} FROM m",
    "adaptive_threshold": f"{_STATS} SELECT grid, cluster_id, c, {_r('threshold', 'threshold')} FROM h",
    "pixel_deviation": f"{_DEV} SELECT grid, cluster_id, i, j, t, c, {_r('deviation', 'deviation')} FROM d",
    "consecutive_exceedance": f"{_DEV} SELECT DISTINCT grid, cluster_id, i, j FROM z WHERE n >= 3",
    "anomaly_degree": f"{_DEV} {_DEGREE.format(2)}",
    "predict_dieback": f"{_DEV} {_DEGREE.format(3)}".replace(f"WITH s AS ({X.SERIES_SQL})", f"WITH s AS (SELECT * FROM ({X.SERIES_SQL}) WHERE date BETWEEN DATE '2022-04-16' - 90 AND DATE '2022-04-16')"),
    "cluster_medians": f"{_SERIES} SELECT date, grid, cluster_id, c, {_r('median(v)', 'median')} FROM r GROUP BY date, grid, cluster_id, c",
    "band_normalize": f"{_RAWD} SELECT image_id, i, {', '.join(_fixed(_norm(b), b, 8) for b in _P)} FROM p",
    "band_denormalize": f"{_RAWD} SELECT image_id, i, {', '.join(_fixed(_DENORM[b], b) for b in _P)} FROM p",
    "vegetation_indices": f"{_RAWD} SELECT image_id, i, {', '.join(_fixed(_scaled(n), n) for n in _I)} FROM p",
    "index_values": f"{_RAWD} SELECT image_id, i, {', '.join(f'CAST({_I[n][0]} AS REAL) AS {n}' for n in _I)} FROM p",
    "final_bands": f"{_RAWD} SELECT image_id, i, {', '.join(_fixed(_norm(b), b + '_norm', 8) for b in _P)}, {', '.join(_fixed(_scaled(n), n, 8) for n in _I)} FROM p",
    "cr_swir": f"{_RAWD}, n AS (SELECT image_id, i, {_DENORM['b8a']} AS x, {_DENORM['b11']} AS y, {_DENORM['b12']} AS z FROM p) SELECT image_id, i, {_r('90 * y / nullif(x + 749.0::DOUBLE * (z - x) / 1336, 0)', 'cr_swir')} FROM n",
    "rescale": f"{_RAWD} SELECT image_id, i, {_r(_norm('b8') + ' / 255', 'v')} FROM p",
    "scl_masks": f"WITH q AS ({X.RAW_SQL}) SELECT image_id, i, CASE WHEN scl IN (4, 5) THEN b4 END AS b4, CASE WHEN scl IN (3, 7, 8, 9, 10) THEN 1 ELSE 0 END AS cloud FROM q",
    "black_mask": f"WITH q AS ({X.RAW_SQL}) SELECT image_id, i, CASE WHEN NOT ({_ALLBLACK}) THEN b1 END AS b1, CASE WHEN NOT ({_ALLBLACK}) THEN b8 END AS b8 FROM q",
    "label_shift": f"{_CUBE} SELECT cube_id, r, c, (label + 255) % 256 AS label FROM s",
    "binary_labels": f"{_SEG} SELECT cube_id, r, c, {_BIN.format('label')} AS label FROM s",
    "severity_class": f"SELECT p_partkey, m.step + 2 AS k FROM part LEFT JOIN severity_map m ON m.n_steps = 4 AND m.severity = {X.SEVERITY_OF_SIZE}",
    "multi_class_code": f"WITH q AS (SELECT p_partkey, {X.SEVERITY_OF_SIZE} AS sev, p_brand AS pest, p_size % 5 AS tree FROM part), cm AS (SELECT p_brand AS pest, p_size % 5 AS tree, min(p_partkey % 50) AS combo FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL) SELECT p_partkey, CAST(CASE WHEN sev IN ('G', 'H') THEN 0 WHEN combo IS NULL THEN 2 + step ELSE 4 + combo * 2 + step END AS BIGINT) AS k FROM q LEFT JOIN cm USING (pest, tree) LEFT JOIN (SELECT * FROM severity_map WHERE n_steps = 2) m ON m.severity = q.sev",
    "standardize": f"{_CUBE}, l AS ({' UNION ALL '.join(f"SELECT cube_id, r, c, '{b}' AS band, {b} AS v, NOT ({_ALLBLACK}) AS seen FROM s" for b in _P)}), st AS (SELECT band, avg(v) FILTER (seen) AS m, stddev_pop(v) FILTER (seen) AS sd FROM l GROUP BY band) SELECT cube_id, r, c, band, round(CASE WHEN sd > 1e-10 THEN (v - m) / sd ELSE v - m END, 5) AS z FROM l JOIN st USING (band)",
    "date_filter": f"{_CAT} SELECT image_id, tile_id, ts FROM a WHERE ts >= TIMESTAMP '2021-03-01' AND ts < TIMESTAMP '2021-09-01'",
    "cloud_filter": f"{_CAT} SELECT image_id, cloud_pct FROM a WHERE cloud_pct < 20",
    "clearest_image": f"{_CAT} SELECT tile_id, image_id FROM a WHERE cloud_pct < 20 AND ts >= TIMESTAMP '2021-01-01' AND ts < TIMESTAMP '2022-01-01' QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY cloud_pct, ts, image_id) = 1",
    "latest_images": f"{_CAT} SELECT tile_id, image_id, ts FROM a WHERE ts < TIMESTAMP '2026-01-01' QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY ts DESC, image_id DESC) <= 10",
    "latest_per_tile": f"{_CAT}, f AS (SELECT substring(tile_id, 1, 2) AS area, tile_id, image_id, ts FROM a WHERE ts < TIMESTAMP '2026-01-01' QUALIFY row_number() OVER (PARTITION BY substring(tile_id, 1, 2) ORDER BY ts DESC, image_id DESC) <= 40) SELECT area, tile_id, image_id FROM f QUALIFY row_number() OVER (PARTITION BY area, tile_id ORDER BY ts DESC, image_id DESC) = 1",
    "min_cloud_ladder": f"{_CAT}, f AS (SELECT * FROM a WHERE cloud_pct >= 0), u AS (SELECT CAST(cc AS DOUBLE) AS cc FROM range(0, 21) x(cc)), nn AS (SELECT tile_id, cc, count(*) FILTER (cloud_pct < cc) AS n FROM f, u GROUP BY ALL), b AS (SELECT tile_id, coalesce(min(cc) FILTER (n >= 5), 20) AS rung FROM nn GROUP BY tile_id) SELECT tile_id, image_id, rung FROM f JOIN b USING (tile_id) WHERE cloud_pct < rung QUALIFY row_number() OVER (PARTITION BY tile_id ORDER BY cloud_pct, ts, image_id) <= 8",
    "collection_size": f"{_CAT} SELECT tile_id, count(*) AS n FROM a GROUP BY tile_id",
    "image_blackness": f"WITH q AS ({X.RAW_SQL}), f AS (SELECT image_id, 1 - count(*) FILTER (scl IN (4, 5)) / count(*) AS s FROM q GROUP BY image_id) SELECT image_id, {_r('s', 'black_share')} FROM f WHERE s <= 0.8",
    "fordead_window": f"{_CAT} SELECT tile_id, image_id, CAST(row_number() OVER (PARTITION BY tile_id ORDER BY ts, image_id) AS INT) AS nr FROM a WHERE ts >= TIMESTAMP '2020-06-01' AND ts < TIMESTAMP '2020-06-01' + INTERVAL 730 DAY",
    "image_mask_join": f"WITH q AS ({X.RAW_SQL}) SELECT image_id, max(b8) AS b8, count(*) FILTER (scl IN (3, 7, 8, 9, 10)) AS cloudy FROM q GROUP BY image_id",
    "band_unpivot": f"WITH q AS ({X.RAW_SQL}) " + " UNION ALL ".join(f"SELECT image_id, i, '{b}' AS band, {b} AS value FROM q" for b in _P),
    "aoi_naming": "SELECT DISTINCT aoi_id, CASE WHEN trim(name) <> '' THEN name ELSE 'aoi_' || aoi_id END AS label FROM aoi",
    "aoi_boxes": f"WITH {_POINTS} SELECT * FROM p",
    "aoi_footprints": f"{_CAT}, {_POINTS} SELECT aoi_id, count(*) AS n_images, max(image_id) AS last_image FROM a JOIN p ON xmin <= a_xmax AND a_xmin <= xmax AND ymin <= a_ymax AND a_ymin <= ymax GROUP BY aoi_id",
    "cubify": f"{_GRID} SELECT i // 16 * 3 + j // 16 AS cube_no, i % 16 AS r, j % 16 AS c, v FROM p, e WHERE (i // 16 + 1) * 16 <= h AND (j // 16 + 1) * 16 <= 50",
    "overlap_tiles": f"{_ORIGINS} SELECT oi, oj, count(*) AS n, sum(v) AS v, max(r) AS r, max(c) AS c FROM t GROUP BY oi, oj",
    "crop_rim": f"{_ORIGINS} SELECT i, j, count(*) AS n FROM t, e WHERE {_CROP} GROUP BY i, j",
    "overlap_add_merge": f"{_PROB} SELECT i, j, k, {_r('avg(p)', 'p')} FROM w GROUP BY i, j, k",
    "tiled_prediction": f"{_PROB}, mm AS (SELECT i, j, k, avg(p) AS p FROM w, e WHERE {_CROP} GROUP BY i, j, k) SELECT i, j, k AS pred, {_r('p', 'best')} FROM mm QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY p DESC, k) = 1",
    "rotate_cubes": f"{_SEG} SELECT cube_id, CAST(CASE cube_id % 4 WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS INT) AS r, CAST(CASE cube_id % 4 WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS INT) AS c, label FROM s",
    "cube_quality_filter": f"{_CUBE}, f AS (SELECT cube_id, count(*) FILTER ({_ALLBLACK}) / count(*) AS x FROM s GROUP BY cube_id) SELECT cube_id, {_r('x', 'black_share')} FROM f WHERE x <= 0.1",
    "cube_pages": "SELECT o_custkey, o_orderkey, CAST((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 9 AS INT) AS page FROM orders",
    "shrink": f"{_GRID} SELECT i // 4 AS i, j // 4 AS j, {_r('avg(v)', 'v')} FROM p GROUP BY i // 4, j // 4",
    "rasterize_labels": f"WITH {_BURN} SELECT i, j, label FROM burnt",
    "rasterize_overlay": f"WITH {_BURN} SELECT i, j FROM burnt",
    "label_combine": f"{_GRID}, {_BURN} SELECT p.i, p.j, CASE WHEN p.v % 7 = 0 THEN 0 ELSE coalesce(b.label, 1) END AS label FROM p LEFT JOIN burnt b ON b.i = p.i AND b.j = p.j",
    "annotation_filter": "SELECT DISTINCT poly_seq, pest_species_code, labels FROM annotations WHERE capture_year = 2020 AND pest_species_code IN ('FPZ', 'KZH')",
    "confusion_counts": f"{_SEG} SELECT label, pred, count(*) AS n FROM s WHERE label <> 255 GROUP BY ALL",
    "class_metrics": f"{_SEG}, f AS (SELECT k, count(*) FILTER (label = k AND pred = k) AS tp, count(*) FILTER (pred = k) AS p, count(*) FILTER (label = k) AS a FROM s, (SELECT unnest(range(0, 6)) AS k) WHERE label <> 255 GROUP BY k), o AS (SELECT *, (tp + 1e-6) / (p + a - tp + 1e-6) AS iou, (tp + 1e-6) / (p + 1e-6) AS pre, (tp + 1e-6) / (a + 1e-6) AS rec FROM f) SELECT CAST(k AS INT) AS class, tp, p AS predicted, a AS actual, {_r('iou', 'iou')}, {_r('pre', 'precision')}, {_r('rec', 'recall')}, {_r('2 * pre * rec / (pre + rec + 1e-6)', 'f1')} FROM o",
    "overall_accuracy": f"{_SEG} SELECT {_r('avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END)', 'accuracy')}, {_r('avg(CASE WHEN label = pred THEN 1.0 ELSE 0 END) FILTER (label <> 255)', 'accuracy_fg')} FROM s",
    "softmax_argmax": f"{_SCORED} SELECT image_id, i, CAST(k AS INT) AS pred, {_r('p', 'best')} FROM n QUALIFY row_number() OVER (PARTITION BY row ORDER BY s DESC, k) = 1",
    "dice_loss": f"{_SCORED}, {_DICE} SELECT {_r('dice', 'loss')} FROM dl",
    "combined_loss": f"{_SCORED}, {_DICE}, ce AS (SELECT sum(-w * ln(p)) / sum(w) AS ce FROM (SELECT p, CASE label WHEN 0 THEN 1.0 WHEN 1 THEN 10.0 WHEN 2 THEN 5.0 WHEN 3 THEN 3.0 ELSE 2.0 END AS w FROM n WHERE label <> 255 AND k = label)), fp AS (SELECT sum(p) / (count(*) FILTER (k = 0) * 5) AS fp FROM (SELECT k, CASE WHEN k <> label THEN p ELSE 0 END AS p FROM n WHERE label <> 255)) SELECT {_r('dice', 'dice')}, {_r('ce', 'cross_entropy')}, {_r('fp', 'false_positives')}, {_r('0.4 * dice + 0.4 * ce + 0.2 * fp', 'loss')} FROM dl, ce, fp",
    "label_counts": f"{_CUBE} SELECT cube_id, label, count(*) AS n FROM s GROUP BY ALL",
    "healthy_only_share": f"{_CUBE}, f AS (SELECT cube_id, bool_and(label <= 1) AS h FROM s GROUP BY cube_id) SELECT count(*) AS n_cubes, count(*) FILTER (h) AS n_healthy, {_r('count(*) FILTER (h) / count(*)', 'share')} FROM f",
    "position_accuracy": f"{_SEG}, f AS ({_POS.format('CASE WHEN label = pred THEN 1 ELSE 0 END')}) SELECT r, c, {_r('accuracy', 'accuracy')} FROM f",
    "binary_accuracy": f"{_SEG}, f AS ({_POS.format('CASE WHEN ' + _BIN.format('label') + ' = ' + _BIN.format('pred') + ' THEN 1 ELSE 0 END')}) SELECT r, c, {_r('accuracy', 'accuracy')} FROM f",
    "graded_accuracy": f"{_SEG}, f AS ({_POS.format('CASE WHEN abs(label - pred) > 200 THEN 0 ELSE abs(label - pred) END')}) SELECT r, c, {_r('(4 - accuracy) / 4', 'accuracy')} FROM f",
    "ring_accuracy": f"{_SEG}, o AS (SELECT CASE {_RING} WHEN 0 THEN 1 ELSE 2 END AS zone, CASE WHEN label = pred THEN 1.0 ELSE 0.0 END AS x FROM s WHERE label <> 255) SELECT zone, count(*) AS n, {_r('avg(x)', 'accuracy')}, {_r('stddev_pop(x)', 'std')} FROM o GROUP BY zone",
    "vote_mode": "WITH q AS (SELECT l_orderkey AS pixel, l_partkey % 4 - 1 AS k FROM lineitem), f AS (SELECT pixel, k, count(*) AS n FROM q WHERE k >= 0 GROUP BY ALL), b AS (SELECT pixel, k FROM f QUALIFY row_number() OVER (PARTITION BY pixel ORDER BY n DESC, k DESC) = 1) SELECT pixel, CAST(k AS INT) AS k FROM (SELECT DISTINCT pixel FROM q) LEFT JOIN b USING (pixel)",
    "contrast_stretch": f"{_GRID}, q AS (SELECT quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p) SELECT i, j, {_r('greatest(0.0, least(1.0, (v - lo) / (hi - lo)))', 'stretched')} FROM p, q",
    "band_contrast": f"WITH q AS ({X.RAW_SQL}), l AS (SELECT image_id, i, unnest(['b4', 'b3', 'b2']) AS band, CAST(unnest([b4, b3, b2]) AS DOUBLE) AS v FROM q), w AS (SELECT band, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM l GROUP BY band) SELECT image_id, i, band, {_r('greatest(0.0, least(1.0, (v - lo) / (hi - lo)))', 'stretched')} FROM l JOIN w USING (band)",
    "rgb_composite": f"WITH q AS ({X.RAW_SQL}) SELECT image_id, i, b4 AS red, b3 AS green, b2 AS blue, b8 AS nir FROM q",
    "box_blur": f"{_GRID}, mi AS (SELECT i AS x, j AS y, v FROM p UNION ALL SELECT -1 - i, j, v FROM p WHERE i < 5 UNION ALL SELECT 2 * h - 1 - i, j, v FROM p, e WHERE i >= h - 4), mj AS (SELECT * FROM mi UNION ALL SELECT x, -1 - y, v FROM mi WHERE y < 5 UNION ALL SELECT x, 99 - y, v FROM mi WHERE y >= 46), off AS (SELECT unnest(range(-5, 5)) AS o), a AS (SELECT p.i, p.j, avg(mj.v) AS v FROM p, off oi, off oj, mj WHERE mj.x = p.i + oi.o AND mj.y = p.j + oj.o GROUP BY p.i, p.j) SELECT i, j, {_r('v', 'v')} FROM a",
    "masked_channel_stats": f"{_CUBE} " + " UNION ALL ".join(f"SELECT '{b}' AS band, {_r(f'avg({b})', 'mean')}, {_r(f'stddev_pop({b})', 'std')} FROM s WHERE NOT ({_ALLBLACK})" for b in _P),
    "masked_batch_norm": f"{_CUBE} " + " UNION ALL ".join(f"SELECT '{b}' AS band, round(avg({b}), 4) AS mean, round(var_pop({b}), 2) AS var, round(1 / sqrt(var_pop({b}) + 1e-5), 9) AS scale FROM s WHERE {b} <> 0" for b in _P),
    "stratified_split": f"{_CLAIMS}, ranked AS ({_RANKED.format('cube_id', 'stratum', 'f')}), cuts AS ({_CUTS}) SELECT cube_id, stratum, {_NAMED} FROM cuts",
    "random_split": f"WITH ranked AS ({_RANKED.format('o_orderkey', '1', 'orders')}), cuts AS ({_CUTS}) SELECT o_orderkey, {_NAMED} FROM cuts",
    "remaining_cubes": f"{_CLAIMS} SELECT DISTINCT cube_id FROM s WHERE cube_id NOT IN (SELECT cube_id FROM f WHERE stratum IN (2, 3))",
    "overlap_zones": f"WITH g AS ({X.PARTITION_SQL}), p AS (SELECT i, j FROM g WHERE grid = 0) SELECT i, j, 0 AS grid, i // 10 * 10 AS zi, j // 10 * 10 AS zj FROM p UNION ALL SELECT i, j, 1, (i - 5) // 10 * 10 + 5, (j - 5) // 10 * 10 + 5 FROM p WHERE i >= 5 AND j >= 5",
    "zone_pixel_roundtrip": f"WITH g AS ({X.PARTITION_SQL}), p AS (SELECT i, j FROM g WHERE grid = 0), z AS (SELECT i, j, 0 AS grid, i // 10 * 10 AS zi, j // 10 * 10 AS zj FROM p UNION ALL SELECT i, j, 1, (i - 5) // 10 * 10 + 5, (j - 5) // 10 * 10 + 5 FROM p WHERE i >= 5 AND j >= 5) SELECT grid, zi, zj, (i - zi) * least(10, 25 - zj) + j - zj AS idx, i AS pi, j AS pj FROM z",
    "davies_bouldin": f"WITH l AS (SELECT label AS k, vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings), ce AS (SELECT k, p, avg(v) AS m FROM l GROUP BY ALL), di AS (SELECT k, vec_id, sqrt(sum((v - m) * (v - m))) AS d FROM l JOIN ce USING (k, p) GROUP BY ALL), sp AS (SELECT k, avg(d) AS s FROM di GROUP BY k), ap AS (SELECT a.k AS k, b.k AS k2, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS d FROM ce a JOIN ce b USING (p) WHERE a.k <> b.k GROUP BY ALL), ra AS (SELECT ap.k, max((x.s + y.s) / d) AS r FROM ap JOIN sp x ON x.k = ap.k JOIN sp y ON y.k = ap.k2 GROUP BY ap.k) SELECT {_r('avg(r)', 'score')} FROM ra",
    "label_image": f"WITH g AS ({X.PARTITION_SQL}), p AS (SELECT i, j FROM g WHERE grid = 0), m AS (SELECT i, j, max(cluster_id) AS cluster_id FROM g WHERE cluster_id <> 3 GROUP BY ALL) SELECT p.i, p.j, coalesce(cluster_id, -1) AS cluster_id FROM p LEFT JOIN m USING (i, j)",
    "cluster_borders": f"WITH g AS ({X.PARTITION_SQL}), p AS (SELECT i, j, cluster_id AS k FROM g WHERE grid = 0) SELECT a.i, a.j, coalesce(bool_or(a.k <> b.k), false) AS border FROM p a LEFT JOIN p b ON abs(a.i - b.i) + abs(a.j - b.j) = 1 GROUP BY a.i, a.j",
    "pixel_neighbours": f"WITH g AS ({X.PARTITION_SQL}), p AS (SELECT i, j FROM g WHERE grid = 0), off AS (SELECT * FROM (VALUES (1, 0), (0, 1), (1, 1), (-1, 1)) AS o(di, dj)) SELECT a.i, a.j, b.i AS i2, b.j AS j2 FROM p a, off JOIN p b ON b.i = a.i + di AND b.j = a.j + dj",
    "pixel_graph_edges": f"{_VEC} SELECT i, j, i2, j2, {_r('weight', 'weight')} FROM edges",
    "cluster_adjacency": f"{_ADJ} SELECT a, b FROM adj",
    "centroid_distance": f"{_ADJ}, m AS (SELECT cluster_id, c, t, median(v) AS x FROM r WHERE grid = 0 GROUP BY ALL) SELECT x.c, adj.a, adj.b, {_r('sqrt(sum((x.x - y.x) * (x.x - y.x))) / count((x.x - y.x))', 'distance')} FROM adj JOIN m x ON x.cluster_id = adj.a JOIN m y ON y.cluster_id = adj.b AND y.t = x.t AND y.c = x.c GROUP BY x.c, adj.a, adj.b",
}

_FLOOD = "WITH RECURSIVE p AS ({0}), f AS (SELECT i, j, k, i AS i2, j AS j2 FROM p UNION SELECT f.i, f.j, f.k, q.i, q.j FROM f JOIN p q ON q.k = f.k AND abs(q.i - f.i2) + abs(q.j - f.j2) = 1 AND q.i BETWEEN f.i2 - 1 AND f.i2 + 1 AND q.j BETWEEN f.j2 - 1 AND f.j2 + 1), m AS (SELECT i, j, k, min(CAST(i2 AS BIGINT) * 4294967296 + j2) AS region FROM f GROUP BY i, j, k)"
ORACLE["connected_components"] = f"{_FLOOD.format(X.GRID_SQL)} SELECT i, j, k, region FROM m"
ORACLE["region_sizes"] = f"{_FLOOD.format(X.GRID_SQL)} SELECT region, k, count(*) AS n, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM m GROUP BY region, k"

_SIDES = ", ".join(f"({k})" for k in ("'up', -1, 0", "'down', 1, 0", "'left', 0, -1", "'right', 0, 1"))
ORACLE["region_outlines"] = (
    f"{_FLOOD.format(X.GRID_SQL)}, d AS (SELECT * FROM (VALUES {_SIDES}) AS d(n, di, dj)), "
    "s AS (SELECT m.region, n, CASE n WHEN 'up' THEN m.i WHEN 'down' THEN m.i + 1 WHEN 'left' THEN m.j ELSE m.j + 1 END AS line, CASE WHEN n IN ('up', 'down') THEN m.j ELSE m.i END AS at_ FROM m CROSS JOIN d LEFT JOIN m o ON o.i = m.i + di AND o.j = m.j + dj WHERE o.region IS DISTINCT FROM m.region), "
    "g AS (SELECT *, at_ - row_number() OVER (PARTITION BY region, n, line ORDER BY at_) AS g FROM s), e AS (SELECT region, n, line, min(at_) AS a, max(at_) + 1 AS b FROM g GROUP BY region, n, line, g) "
    "SELECT region, CASE WHEN n IN ('up', 'down') THEN a ELSE line END AS x1, CASE WHEN n IN ('up', 'down') THEN line ELSE a END AS y1, CASE WHEN n IN ('up', 'down') THEN b ELSE line END AS x2, CASE WHEN n IN ('up', 'down') THEN line ELSE b END AS y2 FROM e"
)
ORACLE["scene_prediction"] = f"{_GRID}, sc AS (SELECT i, j, unnest([0, 1, 2]) AS k, unnest([v / 100, v % 7, (v + v % 7) / 150]) AS s FROM p), so AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY i, j) AS q FROM sc) SELECT i, j, k AS pred, {_r('q', 'best')} FROM so QUALIFY row_number() OVER (PARTITION BY i, j ORDER BY q DESC, k) = 1"
ORACLE["prediction_map"] = f"{_CUBE} SELECT cube_id, r, c, CASE WHEN {_ALLBLACK} THEN 9 ELSE label END AS k FROM s"
_Z = 2.5758293035489004
ORACLE["ring_confidence"] = f"{_SEG}, o AS (SELECT CASE {_RING} WHEN 0 THEN 1 ELSE 2 END AS zone, CASE WHEN label = pred THEN 1.0 ELSE 0.0 END AS x FROM s WHERE label <> 255), z AS (SELECT zone, count(*) AS n, greatest(count(*) - 1, 1) AS v, stddev_pop(x) AS sd FROM o GROUP BY zone) SELECT zone, {_r(f'({_Z}::DOUBLE + {(_Z**3 + _Z) / 4}::DOUBLE / v + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96}::DOUBLE / (v * v) + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384}::DOUBLE / (v * v * v)) * sd / sqrt(n)', 'half_width')} FROM z"
_MET = f"{_CAT}, {_POINTS}, f AS (SELECT a.*, aoi_id FROM a JOIN p ON xmin <= a_xmax AND a_xmin <= xmax AND ymin <= a_ymax AND a_ymin <= ymax)"
ORACLE["training_selection"] = f"{_MET}, l AS (SELECT * FROM f WHERE cloud_pct >= 0 AND ts >= TIMESTAMP '2024-05-01' AND ts < TIMESTAMP '2024-08-01'), u AS (SELECT CAST(cc AS DOUBLE) AS cc FROM range(0, 21) x(cc)), nn AS (SELECT aoi_id, tile_id, cc, count(*) FILTER (cloud_pct < cc) AS n FROM l, u GROUP BY ALL), b AS (SELECT aoi_id, tile_id, coalesce(min(cc) FILTER (n >= 2), 20) AS rung FROM nn GROUP BY ALL) SELECT aoi_id, tile_id, image_id, rung FROM l JOIN b USING (aoi_id, tile_id) WHERE cloud_pct < rung QUALIFY row_number() OVER (PARTITION BY aoi_id, tile_id ORDER BY cloud_pct, ts, image_id) <= 2"
ORACLE["prediction_selection"] = f"{_MET}, l AS (SELECT * FROM f WHERE ts >= TIMESTAMP '2024-07-22' AND ts < TIMESTAMP '2024-08-02' QUALIFY row_number() OVER (PARTITION BY aoi_id ORDER BY ts DESC, image_id DESC) <= 10) SELECT aoi_id, tile_id, image_id FROM l QUALIFY row_number() OVER (PARTITION BY aoi_id, tile_id ORDER BY ts DESC, image_id DESC) = 1"
ORACLE["fordead_selection"] = f"{_CAT}, {_POINTS}, w AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY ts, image_id) AS nr FROM a WHERE ts >= TIMESTAMP '2024-08-01' AND ts < TIMESTAMP '2024-08-01' + INTERVAL 730 DAY) SELECT aoi_id, count(*) AS n, CAST(max(nr) AS INT) AS nr FROM w JOIN p ON xmin <= a_xmax AND a_xmin <= xmax AND ymin <= a_ymax AND a_ymin <= ymax GROUP BY aoi_id"

_SC = f"WITH p AS ({X.SCENES_SQL}), e AS (SELECT scene, max(i) + 1 AS h, max(j) + 1 AS w FROM p GROUP BY scene)"
_STARTS = lambda x: f"SELECT scene, unnest(range(0, {x} - 15, 10)) AS o FROM e UNION SELECT scene, {x} - 16 FROM e"
_SCT = f"{_SC}, oi AS ({_STARTS('h')}), oj AS ({_STARTS('w')}), t AS (SELECT p.*, oi.o AS oi, oj.o AS oj, p.i - oi.o AS r, p.j - oj.o AS c FROM p JOIN oi ON oi.scene = p.scene AND p.i BETWEEN oi.o AND oi.o + 15 JOIN oj ON oj.scene = p.scene AND p.j BETWEEN oj.o AND oj.o + 15)"
_SCROP = "((r >= 2 OR oi = 0) AND (r < 14 OR oi + 16 >= h) AND (c >= 2 OR oj = 0) AND (c < 14 OR oj + 16 >= w))"
ORACLE["image_extent"] = f"{_SC} SELECT scene, CAST(h AS INT) AS height, CAST(w AS INT) AS width FROM e"
ORACLE["scene_cubes"] = f"{_SC} SELECT scene, i // 16 * (w // 16) + j // 16 AS cube_no, i % 16 AS r, j % 16 AS c, v FROM p JOIN e USING (scene) WHERE (i // 16 + 1) * 16 <= h AND (j // 16 + 1) * 16 <= w"
ORACLE["scenes_merged"] = f"{_SCT}, q AS (SELECT t.*, h, w, (v * 7 + oi + oj * 3) % 16 AS a FROM t JOIN e USING (scene)), m AS (SELECT scene, i, j, avg(a / 16) AS p0, avg(1 - a / 16) AS p1 FROM q WHERE {_SCROP} GROUP BY scene, i, j) SELECT scene, i, j, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS pred, {_r('greatest(p0, p1)', 'best')} FROM m"
ORACLE["scenes_predicted"] = ORACLE["scene_prediction"].replace(_GRID, _SC).replace("SELECT i, j,", "SELECT scene, i, j,").replace("PARTITION BY i, j", "PARTITION BY scene, i, j")
_SFLOOD = f"WITH RECURSIVE p AS ({X.SCENES_SQL}), f AS (SELECT scene, i, j, k, i AS i2, j AS j2 FROM p UNION SELECT f.scene, f.i, f.j, f.k, q.i, q.j FROM f JOIN p q ON q.scene = f.scene AND q.k = f.k AND abs(q.i - f.i2) + abs(q.j - f.j2) = 1 AND q.i BETWEEN f.i2 - 1 AND f.i2 + 1 AND q.j BETWEEN f.j2 - 1 AND f.j2 + 1)"
ORACLE["scene_regions"] = f"{_SFLOOD} SELECT scene, i, j, k, min(CAST(i2 AS BIGINT) * 4294967296 + j2) AS region FROM f GROUP BY scene, i, j, k"
ORACLE["scene_labels"] = f"{_SC}, {_BURN}, sb AS (SELECT poly_seq % 3 AS scene, i, j, arg_max(label, poly_seq) AS label FROM inside GROUP BY ALL) SELECT p.scene, p.i, p.j, CASE WHEN p.v % 7 = 0 THEN 0 ELSE coalesce(b.label, 1) END AS label FROM p LEFT JOIN sb b ON b.scene = p.scene AND b.i = p.i AND b.j = p.j"
ORACLE["scene_blur"] = f"{_SC}, mi AS (SELECT scene, i AS x, j AS y, v FROM p UNION ALL SELECT scene, -1 - i, j, v FROM p WHERE i < 5 UNION ALL SELECT scene, 2 * h - 1 - i, j, v FROM p JOIN e USING (scene) WHERE i >= h - 4), mj AS (SELECT * FROM mi UNION ALL SELECT scene, x, -1 - y, v FROM mi WHERE y < 5 UNION ALL SELECT scene, x, 2 * w - 1 - y, v FROM mi JOIN e USING (scene) WHERE y >= w - 4), off AS (SELECT unnest(range(-5, 5)) AS o), rw AS (SELECT p.scene, mj.x, p.j, avg(mj.v) AS v FROM (SELECT scene, x, y AS j FROM mi) p, off oj, mj WHERE mj.scene = p.scene AND mj.x = p.x AND mj.y = p.j + oj.o GROUP BY ALL), a AS (SELECT p.scene, p.i, p.j, avg(rw.v) AS v FROM p, off oi, rw WHERE rw.scene = p.scene AND rw.x = p.i + oi.o AND rw.j = p.j GROUP BY ALL) SELECT scene, i, j, {_r('v', 'v')} FROM a"
_TURNED = _DEV.replace(f"WITH s AS ({X.SERIES_SQL})", f"WITH s AS (SELECT i, j, t, c, {{0}}v AS v, date FROM ({X.SERIES_SQL}) WHERE date BETWEEN DATE '2022-04-16' - 90 AND DATE '2022-04-16')")
ORACLE["scenes_dieback"] = " UNION ALL ".join(f"SELECT {k} AS scene, * FROM ({_TURNED.replace('{0}v', sign + 'v')} {_DEGREE.format(3)})" for k, sign in ((0, ""), (1, "-")))
ORACLE["large_clusters"] = ORACLE["predict_dieback"]
ORACLE["region_polygons"] = f"{_FLOOD.format(X.GRID_SQL)}, near AS (SELECT a.region, count(*) AS n FROM m a JOIN m b ON b.region = a.region AND ((b.i = a.i + 1 AND b.j = a.j) OR (b.i = a.i AND b.j = a.j + 1)) GROUP BY a.region), quads AS (SELECT a.region, count(*) AS n FROM m a JOIN m b ON b.region = a.region AND b.i = a.i + 1 AND b.j = a.j JOIN m c ON c.region = a.region AND c.i = a.i AND c.j = a.j + 1 JOIN m d ON d.region = a.region AND d.i = a.i + 1 AND d.j = a.j + 1 GROUP BY a.region), n AS (SELECT region, count(*) AS n FROM m GROUP BY region) SELECT n.region, CAST(2 - (n.n - coalesce(near.n, 0) + coalesce(quads.n, 0)) AS INT) AS n_rings, CAST(n.n AS DOUBLE) AS area FROM n LEFT JOIN near USING (region) LEFT JOIN quads USING (region)"
ORACLE["cloud_overlay"] = f"WITH q AS ({X.RAW_SQL}) SELECT image_id, i, " + ", ".join(f"CASE WHEN scl IN (3, 7, 8, 9, 10) THEN {b} * 0.5::DOUBLE + {x}::DOUBLE ELSE CAST({b} AS DOUBLE) END AS {n}" for b, n, x in (("b4", "red", 127.5), ("b3", "green", 0.0), ("b2", "blue", 127.5))) + " FROM q"
ORACLE["clipped_pixels"] = f"{_CAT}, tb AS (SELECT tile_id AS aoi_id, min(v.x) AS x0, max(v.x) AS x1, min(v.y) AS y0, max(v.y) AS y1 FROM (SELECT tile_id, unnest(geometry) AS v FROM s2_tiles) GROUP BY tile_id) SELECT aoi_id, count(*) AS n, max(image_id) AS last FROM a JOIN tb ON (xmin + xmax) / 2 BETWEEN x0 AND x1 AND (ymin + ymax) / 2 BETWEEN y0 AND y1 GROUP BY aoi_id"
ORACLE["batch_loader"] = "WITH n AS (SELECT count(*) AS n FROM orders) SELECT CAST(b AS INT) AS batch, least(12, n - 12 * b) AS n FROM (SELECT n, unnest(range(0, CAST(ceil(n / 12) AS BIGINT))) AS b FROM n)"
ORACLE["concat_sets"] = f"WITH ranked AS ({_RANKED.format('o_orderkey', '1', 'orders')}), cuts AS ({_CUTS}) SELECT o_orderkey, CASE WHEN pos < a THEN 'train' END AS split FROM cuts WHERE pos < a OR pos >= b"
ORACLE["running_metrics"] = "WITH q AS (SELECT o_custkey, o_orderkey, CAST(round(CAST(o_totalprice AS DOUBLE) * 100) AS BIGINT) AS v FROM orders) SELECT o_custkey, o_orderkey, avg(v) OVER w AS running_mean, max(v) OVER w AS best, coalesce(v > max(v) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM q WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)"
ORACLE["combined_classes"] = "WITH a AS (SELECT DISTINCT poly_seq, capture_year, upper(trim(pest_severity_code)) AS sev, upper(trim(pest_species_code)) AS pest, upper(trim(tree_species_code)) AS tree FROM annotations), cm AS (SELECT tree, pest, min(poly_seq) % 50 AS combo FROM a WHERE capture_year = 2019 GROUP BY ALL), k AS (SELECT poly_seq, CASE WHEN sev IN ('G', 'H') THEN 0 WHEN combo IS NULL THEN 2 + step ELSE 4 + combo * 2 + step END AS label FROM a LEFT JOIN cm USING (tree, pest) LEFT JOIN (SELECT * FROM severity_map WHERE n_steps = 2) m ON m.severity = a.sev WHERE capture_year = 2020) SELECT poly_seq, CAST(label AS BIGINT) AS label FROM k WHERE label IS NOT NULL"
ORACLE["npy_files"] = f"SELECT scene, i, j, v FROM ({X.SCENES_SQL})"
ORACLE["dated_series"] = f"WITH s AS ({X.SERIES_SQL}) SELECT i, j, t, c, {_r('v / 2', 'v')}, date FROM s WHERE v IS NOT NULL"
ORACLE["polygon_files"] = f"SELECT poly_seq, label, CAST(x0 AS DOUBLE) AS x0, CAST(y0 + h AS DOUBLE) AS y1, 5 AS n FROM ({X.RECT_SQL})"
ORACLE["layout_files"] = f"{_CAT} SELECT tile_id, CAST(date_trunc('year', ts) AS DATE) AS date, count(*) AS n, max(image_id) AS last FROM a WHERE ts IS NOT NULL GROUP BY ALL"
ORACLE["zone_kmeans_check"] = f"SELECT grid, zi, zj, count(*) AS n, true AS good FROM ({ORACLE['overlap_zones']}) GROUP BY ALL"
ORACLE["louvain_check"] = "SELECT count(*) AS n, count(*) AS n_distinct, true AS better FROM embeddings"
ORACLE["small_clusters_check"] = "SELECT count(*) AS n_pixels, 0 AS n_left FROM embeddings"
ORACLE["dieback_check"] = "SELECT unnest(['zones', 'graph']) AS method, 0 AS n_bad, true AS some"
ORACLE["leftover_cubes"] = f"{_CLAIMS}, ranked AS ({_RANKED.format('cube_id', 'stratum', 'f')}), cuts AS ({_CUTS}) SELECT DISTINCT cube_id FROM s WHERE cube_id NOT IN (SELECT cube_id FROM cuts WHERE pos < a)"
ORACLE["rasterize_annotations"] = (
    "WITH a AS (SELECT poly_seq, any_value(geometry) AS g FROM annotations WHERE poly_seq IS NOT NULL GROUP BY poly_seq), "
    "v AS (SELECT poly_seq, list_filter(list_transform(g, lambda p: {'x': p.x / 10, 'y': p.y / 10}), lambda p: isfinite(p.x) AND isfinite(p.y)) AS r FROM a), "
    "k AS (SELECT poly_seq, r, unnest(range(1, len(r) + 1)) AS n FROM v WHERE len(r) >= 3), "
    "e AS (SELECT poly_seq, r[n].x AS x1, r[n].y AS y1, r[n % len(r) + 1].x AS x2, r[n % len(r) + 1].y AS y2 FROM k), "
    "b AS (SELECT poly_seq, unnest(range(CAST(ceil(min(y1)) AS BIGINT) - 1, CAST(floor(max(y1)) AS BIGINT) + 1)) AS i FROM e GROUP BY poly_seq), "
    "m AS (SELECT b.i, e.*, (x2 - x1) / nullif(y2 - y1, 0) AS s, least(greatest(CAST(b.i AS DOUBLE), least(y1, y2)), greatest(y1, y2)) AS lo, least(greatest(CAST(b.i + 1 AS DOUBLE), least(y1, y2)), greatest(y1, y2)) AS hi FROM b JOIN e USING (poly_seq) WHERE least(y1, y2) <= b.i + 1 AND greatest(y1, y2) >= b.i), "
    "w AS (SELECT poly_seq, i, coalesce(x1 + (lo - y1) * s, x1) AS p, coalesce(x1 + (hi - y1) * s, x2) AS q FROM m), "
    "c AS (SELECT poly_seq, i, x1 + (i + 0.5::DOUBLE - y1) * (x2 - x1) / (y2 - y1) AS x FROM m WHERE (y1 > i + 0.5::DOUBLE) <> (y2 > i + 0.5::DOUBLE)), "
    "o AS (SELECT *, row_number() OVER (PARTITION BY poly_seq, i ORDER BY x) AS n FROM c), "
    "h AS (SELECT poly_seq, i, CAST(ceil(min(x) - 0.5::DOUBLE) AS BIGINT) AS a, CAST(floor(max(x) - 0.5::DOUBLE) AS BIGINT) AS z FROM o GROUP BY poly_seq, i, (n - 1) // 2), "
    "t AS (SELECT poly_seq, i, CAST(ceil(least(p, q)) AS BIGINT) - 1 AS a, CAST(floor(greatest(p, q)) AS BIGINT) AS z FROM w UNION ALL SELECT * FROM h), "
    "j AS (SELECT DISTINCT poly_seq, i, unnest(range(a, z + 1)) AS j FROM t WHERE a <= z) SELECT poly_seq, count(*) AS n_pixels FROM j GROUP BY poly_seq"
)
