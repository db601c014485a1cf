"""DuckDB SQL for the registered queries, written independently of the plans; doubles rounded to six places."""

from __future__ import annotations

import re

from ..sources.tables import with_tables

_NORMAL = ", n AS (SELECT *, list_transform(embedding, lambda x: x::DOUBLE / (sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))) + 1e-8)) AS v FROM patches)"
_DIST = "1 - list_inner_product(q.v, b.v)"
_KNN = _NORMAL + ", dist AS (SELECT q.vec_id, q.image_id, q.patch_id, {d} AS d FROM n q, n b WHERE q.label >= 5 AND b.label < 5), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM dist), knn AS (SELECT vec_id, image_id, patch_id, avg(d) AS score FROM ranked WHERE r <= {k} GROUP BY ALL)".replace("{d}", _DIST)
_LOO = _NORMAL + ", dist AS (SELECT q.vec_id, q.image_id, {d} AS d FROM n q, n b WHERE q.category = b.category AND q.image_id <> b.image_id), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r, greatest(1, floor(count(*) OVER (PARTITION BY vec_id) * 0.02)) AS k FROM dist), loo AS (SELECT vec_id, image_id, avg(d) AS score FROM ranked WHERE r <= k GROUP BY ALL)".replace("{d}", _DIST)


def tail(source: str, share: float, score: str = "score") -> str:
    return f"(SELECT image_id, avg(s) AS image_score FROM (SELECT image_id, {score} AS s, row_number() OVER (PARTITION BY image_id ORDER BY {score} DESC) AS r, greatest(1, floor(count(*) OVER (PARTITION BY image_id) * {share})) AS k FROM {source}) WHERE r <= k GROUP BY image_id)"


def patches(sql: str) -> str:
    return with_tables(sql, "patches")


def pixels(sql: str) -> str:
    return with_tables(sql, "pixels")


def scores(sql: str) -> str:
    return with_tables(sql, "scores")


def results(sql: str) -> str:
    return with_tables(sql, "results")


def catalog(sql: str) -> str:
    return with_tables(sql, "catalog")


def knn(k: int, sql: str) -> str:
    return patches(_KNN.replace("{k}", str(k)) + sql)


SQL: dict[str, str] = {
    "image_scores": knn(3, " SELECT image_id, round(image_score, 6) AS image_score FROM " + tail("knn", 0.01)),
    "l2_normalize": patches(_NORMAL + " SELECT vec_id, (pos - 1)::INT AS pos, round(v[pos], 6) AS value FROM n, range(1, 65) t(pos)"),
    "cosine_distance_pairs": patches(_NORMAL + " SELECT q.vec_id, round(" + _DIST + ", 6) AS distance FROM n q JOIN n b ON b.vec_id = q.vec_id + 1"),
    "component_aggregate": patches(", h AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM patches) SELECT vec_id, round(v[1], 6) AS first, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS l2, round(list_sum(list_transform(v, lambda x: abs(x))) / len(v), 6) AS mean_abs, round(list_max(list_transform(v, lambda x: abs(x))), 6) AS max_abs FROM h"),
    "drop_prefix_tokens": patches(" SELECT vec_id, (pos - 1)::INT AS pos, round(embedding[5 + pos]::DOUBLE, 6) AS value FROM patches, range(1, len(embedding) - 4) t(pos)"),
    "patch_grid_geometry": "WITH p AS (SELECT p_partkey, p_size * 13 + 200 AS h, p_partkey % 400 + 300 AS w FROM part), r AS (SELECT p_partkey, (h * 640 // least(h, w))::INT AS resized_h, (w * 640 // least(h, w))::INT AS resized_w FROM p) SELECT p_partkey, resized_h, resized_w, (resized_h // 16)::INT AS grid_h, (resized_w // 16)::INT AS grid_w FROM r",
    "rotation_fanout": patches(" SELECT vec_id, (45 * k)::INT AS angle, round(2.0 - (gx - 2.0) * sin(radians(45 * k)) + (gy - 2.0) * cos(radians(45 * k)), 6) + 0.0 AS ry, round(2.0 + (gx - 2.0) * cos(radians(45 * k)) + (gy - 2.0) * sin(radians(45 * k)), 6) + 0.0 AS rx FROM patches, range(0, 8) t(k)"),
    "knn_score_k1": knn(1, " SELECT vec_id, round(score, 6) AS score FROM knn"),
    "knn_score_k3": knn(3, " SELECT vec_id, round(score, 6) AS score FROM knn"),
    "index_knn_scores": knn(3, " SELECT vec_id, round(score, 6) AS score, true AS bounded FROM knn"),
    "tile_plan": patches(", t AS (SELECT CASE WHEN image_id % 3 > 0 THEN 0 ELSE category END AS category, label FROM patches), c AS (SELECT category, count(*) AS n_query, count(*) FILTER (label < 5) AS n_bank FROM t GROUP BY category HAVING n_bank > 0) SELECT *, ceil(n_query / 64)::INT AS q_blocks, ceil(n_bank / 64)::INT AS b_blocks, n_query * ceil(n_bank / 64)::BIGINT + n_bank * ceil(n_query / 64)::BIGINT AS moved FROM c"),
    "zero_shot_loo_scores": patches(_LOO + " SELECT vec_id, round(score, 6) AS score FROM loo"),
    "blocked_topk_merge": patches(_LOO + " SELECT vec_id, round(score, 6) AS score FROM loo"),
    "image_score_cvar": pixels(" SELECT image_id, round(image_score, 6) AS image_score FROM " + tail("pixels", 0.01)),
    "memory_bank": patches(_NORMAL + " SELECT image_id, count(*) AS n_patches, round(sum(list_sum(v)), 6) AS total FROM n WHERE label < 5 GROUP BY image_id"),
    "memory_bank_stats": patches(" SELECT count(*) AS n_vectors, max(len(embedding))::INT AS dim, round(count(*) / count(DISTINCT image_id), 6) AS per_image, round(count(*) * max(len(embedding)) * 4 / 1048576, 6) AS megabytes FROM patches WHERE label < 5"),
    "k_sweep": " UNION ALL ".join("SELECT * FROM (" + knn(k, f" SELECT {k}::INT AS k, round(avg(score), 6) AS mean_score FROM knn") + ")" for k in (1, 2, 4, 8)),
    "gaussian_smooth": pixels(
        ", k AS (SELECT e AS d, exp(-0.5 * e * e / 16.0) / (SELECT sum(exp(-0.5 * f * f / 16.0)) FROM range(-16, 17) t(f)) AS w FROM range(-16, 17) t(e))"
        ", v AS (SELECT p.image_id, p.y, p.x, sum(q.score * w) AS s FROM pixels p, k JOIN pixels q ON q.image_id = p.image_id AND q.x = p.x AND q.y = CASE WHEN p.y + d < 0 THEN -(p.y + d) - 1 WHEN p.y + d > 19 THEN 39 - p.y - d ELSE p.y + d END GROUP BY ALL)"
        " SELECT p.image_id, p.y, p.x, round(sum(q.s * w), 6) AS value FROM v p, k JOIN v q ON q.image_id = p.image_id AND q.y = p.y AND q.x = CASE WHEN p.x + d < 0 THEN -(p.x + d) - 1 WHEN p.x + d > 19 THEN 39 - p.x - d ELSE p.x + d END GROUP BY ALL"
    ),
    "bilinear_upsample": pixels((_UP := ", t AS (SELECT i::INT AS i, least(greatest((i + 0.5) * 0.5 - 0.5, 0.0), 19.0)::DOUBLE AS s FROM range(0, 40) r(i)), c AS (SELECT i, floor(s)::INT AS a, least(floor(s)::INT + 1, 19) AS b, s - floor(s) AS f FROM t), up AS (SELECT p.image_id, ty.i AS y, tx.i AS x, (p.score * (1 - tx.f) + q.score * tx.f) * (1 - ty.f) + (r.score * (1 - tx.f) + u.score * tx.f) * ty.f AS value FROM c ty, c tx JOIN pixels p ON p.y = ty.a AND p.x = tx.a JOIN pixels q ON q.image_id = p.image_id AND q.y = ty.a AND q.x = tx.b JOIN pixels r ON r.image_id = p.image_id AND r.y = ty.b AND r.x = tx.a JOIN pixels u ON u.image_id = p.image_id AND u.y = ty.b AND u.x = tx.b)") + " SELECT image_id, y, x, round(value, 6) AS value FROM up"),
    "nearest_upsample": pixels(" SELECT image_id, a::INT AS y, b::INT AS x, round(score, 6) AS value FROM range(0, 30) s(a), range(0, 30) t(b) JOIN pixels ON y = a * 20 // 30 AND x = b * 20 // 30"),
    "block_repeat": pixels(" SELECT image_id, a::INT AS y, b::INT AS x, round(score, 6) AS value FROM range(0, 40) s(a), range(0, 40) t(b) JOIN pixels ON y = a // 2 AND x = b // 2"),
    "dists_to_map": pixels(
        _UP + ", k AS (SELECT e AS d, exp(-0.5 * e * e / 16.0) / (SELECT sum(exp(-0.5 * f * f / 16.0)) FROM range(-16, 17) t(f)) AS w FROM range(-16, 17) t(e))"
        ", v AS (SELECT p.image_id, p.y, p.x, sum(q.value * w) AS s FROM up p, k JOIN up q ON q.image_id = p.image_id AND q.x = p.x AND q.y = CASE WHEN p.y + d < 0 THEN -(p.y + d) - 1 WHEN p.y + d > 39 THEN 79 - p.y - d ELSE p.y + d END GROUP BY ALL)"
        " SELECT p.image_id, p.y, p.x, round(sum(q.s * w), 6) AS value FROM v p, k JOIN v q ON q.image_id = p.image_id AND q.y = p.y AND q.x = CASE WHEN p.x + d < 0 THEN -(p.x + d) - 1 WHEN p.x + d > 39 THEN 79 - p.x - d ELSE p.x + d END GROUP BY ALL"
    ),
    "morph_dilate": pixels(" SELECT p.image_id, p.y, p.x, max((q.score > 100)::INT) AS mask FROM pixels p JOIN pixels q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL"),
    "morph_close": pixels(", d AS (SELECT p.image_id, p.y, p.x, max((q.score > 120)::INT) AS m FROM pixels p JOIN pixels q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY ALL) SELECT p.image_id, p.y, p.x, min(q.m) AS mask FROM d p JOIN d q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 2 AND abs(q.x - p.x) <= 2 GROUP BY ALL"),
    "morph_open": pixels(", d AS (SELECT p.image_id, p.y, p.x, min((q.score > 10)::INT) AS m FROM pixels p JOIN pixels q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL) SELECT p.image_id, p.y, p.x, max(q.m) AS mask FROM d p JOIN d q ON q.image_id = p.image_id AND abs(q.y - p.y) <= 1 AND abs(q.x - p.x) <= 1 GROUP BY ALL"),
    "binarize": pixels(" SELECT image_id, y, x, (score > 127)::INT AS mask FROM pixels"),
    "zscore_minmax": pixels(" SELECT image_id, y, x, round((score - avg(score) OVER w) / (stddev_pop(score) OVER w + 1e-8), 6) AS z, round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8), 6) AS unit FROM pixels WINDOW w AS (PARTITION BY image_id)"),
    "percentile_threshold": pixels(" SELECT image_id, round(quantile_cont(score, 0.95), 6) AS threshold FROM pixels GROUP BY image_id"),
    "otsu_threshold": pixels(
        ", l AS (SELECT image_id, floor(255 * ((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w + 1e-8)))::INT AS level FROM pixels WINDOW w AS (PARTITION BY image_id))"
        ", g AS (SELECT image_id, t.k::INT AS level, count(*) FILTER (l.level <= k)::BIGINT AS w, coalesce(sum(l.level) FILTER (l.level <= k), 0)::BIGINT AS s, count(*)::BIGINT AS n, sum(l.level)::BIGINT AS total FROM l, range(0, 256) t(k) GROUP BY ALL)"
        ", b AS (SELECT image_id, level, CASE WHEN w > 0 AND w < n THEN (total * w - s * n)::DOUBLE * (total * w - s * n)::DOUBLE / (w * (n - w))::DOUBLE ELSE -1 END AS between_classes FROM g)"
        " SELECT image_id, level AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY between_classes DESC, level) = 1"
    ),
    "planar_ratio": pixels(", f AS (SELECT image_id, regr_slope(score, x) AS sx, regr_slope(score, y) AS sy, avg(score) AS mz FROM pixels GROUP BY image_id) SELECT image_id, round(stddev_pop(score - mz - sx * (x - 9.5) - sy * (y - 9.5)) / stddev_pop(score), 6) AS ratio FROM pixels JOIN f USING (image_id) GROUP BY image_id"),
    "mask_span": pixels(" SELECT image_id, max(y) - min(y) + 1 AS span_y, max(x) - min(x) + 1 AS span_x FROM pixels WHERE score > 140 GROUP BY image_id"),
    "image_auroc": scores(" SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM scores a, scores b WHERE a.label = 1 AND b.label = 0"),
    "roc_curve": scores(", t AS (SELECT DISTINCT score AS threshold FROM scores UNION ALL SELECT NULL) SELECT t.threshold, round(CASE WHEN threshold IS NULL THEN 0.0 ELSE (count(*) FILTER (score >= threshold AND label = 0))::DOUBLE / count(*) FILTER (label = 0) END, 6) AS fpr, round(CASE WHEN threshold IS NULL THEN 0.0 ELSE (count(*) FILTER (score >= threshold AND label = 1))::DOUBLE / count(*) FILTER (label = 1) END, 6) AS tpr FROM t, scores GROUP BY t.threshold"),
    "confusion_counts": scores(" SELECT count(*) FILTER (label = 1 AND score > 2000) AS tp, count(*) FILTER (label = 0 AND score > 2000) AS fp, count(*) FILTER (label = 1 AND score <= 2000) AS fn, count(*) FILTER (label = 0 AND score <= 2000) AS tn FROM scores"),
    "classification_metrics": scores(", c AS (SELECT count(*) FILTER (label = 1 AND score > 2000) AS tp, count(*) FILTER (label = 0 AND score > 2000) AS fp, count(*) FILTER (label = 1 AND score <= 2000) AS fn, count(*) FILTER (label = 0 AND score <= 2000) AS tn FROM scores) SELECT *, round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c"),
}

_COMPONENTS = (
    ", reach(image_id, root, y, x) AS (SELECT image_id, y * 20 + x, y, x FROM pixels WHERE {m} UNION SELECT r.image_id, r.root, q.y, q.x FROM reach r JOIN pixels q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1 AND ({qm}))"
    ", regions AS (SELECT image_id, y, x, min(root)::BIGINT AS region FROM reach GROUP BY ALL)"
)


def regions(sql: str, mask: str = "gt_mask = 1") -> str:
    return pixels(_COMPONENTS.replace("{m}", mask).replace("{qm}", re.sub(r"\b(x|y|score|gt_mask)\b", r"q.\1", mask)) + sql).replace("WITH ", "WITH RECURSIVE ", 1)


_SIZED = ", sized AS (SELECT *, count(*) OVER (PARTITION BY image_id, region) AS n FROM regions), nr AS (SELECT count(*) AS n_regions FROM (SELECT DISTINCT image_id, region FROM regions))"
_PRO = _SIZED + (
    ", s AS (SELECT score, sum((gt_mask = 0)::INT) AS ok, sum(CASE WHEN gt_mask = 1 THEN 1.0::DOUBLE / sized.n ELSE 0 END) AS hit FROM pixels LEFT JOIN sized USING (image_id, y, x) GROUP BY score)"
    ", curve AS (SELECT score AS threshold, least(1.0, sum(ok) OVER w / (SELECT sum(ok) FROM s))::DOUBLE AS fpr, least(1.0, sum(hit) OVER w / (SELECT n_regions FROM nr))::DOUBLE AS pro FROM s WINDOW w AS (ORDER BY score DESC))"
)
_AREA = "(SELECT sum(CASE WHEN x > 0.3 THEN (0.3 - x0) * (y0 + y0 + (y - y0) * (0.3 - x0) / (x - x0)) / 2 ELSE (x - x0) * (y + y0) / 2 END) AS area FROM (SELECT {x} AS x, {y} AS y, lag({x}) OVER o AS x0, lag({y}) OVER o AS y0 FROM {c} WINDOW o AS (ORDER BY threshold DESC)) WHERE x0 < 0.3)"
_PRO0 = ", c0 AS (SELECT * FROM curve UNION ALL SELECT 'infinity'::DOUBLE, 0, 0)"
_BEST = ", a AS ({src}), t AS (SELECT score AS s, sum(label) OVER w AS tp, count(*) OVER w AS pp, sum(label) OVER () AS p FROM a WINDOW w AS (ORDER BY score DESC)), v AS (SELECT DISTINCT s, round({f}, 9) AS value FROM t) SELECT round(s, 6) AS threshold, round(value, 6) AS value FROM v ORDER BY v.value DESC, s LIMIT 1"
_F1 = "2 * (tp / pp) * (tp / p) / (tp / pp + tp / p + {e})"
_ANOMALOUS = "SELECT score, gt_mask AS label FROM pixels WHERE image_id IN (SELECT image_id FROM pixels WHERE gt_mask = 1)"
_PAIRS_AUROC = "avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END)"
_CLASSIFY = ", cc AS (SELECT image_id, region, count(*) AS area FROM regions GROUP BY ALL), f AS (SELECT image_id, count(*) FILTER (x >= 2 AND y >= 2)::BIGINT AS n_fg, count(*) FILTER (x >= 2 AND y >= 2 AND score > 60)::BIGINT AS n_hit FROM pixels GROUP BY image_id), classified AS (SELECT f.image_id, n_fg, n_hit, CASE WHEN n_fg = 0 OR n_hit = 0 OR n_hit / n_fg >= 0.7 OR largest < 0.005 * n_fg OR largest < 10 THEN 0 ELSE 1 END AS predicted FROM f LEFT JOIN (SELECT image_id, max(area) AS largest FROM cc GROUP BY ALL) USING (image_id))"
_HIT = "score > 60 AND x >= 2 AND y >= 2"

SQL |= {
    "connected_components": regions(" SELECT image_id, y, x, region FROM regions"),
    "tiled_components": regions(" SELECT image_id, y, x, region FROM regions", "score > 40"),
    "largest_component": regions(", c AS (SELECT image_id, region, count(*) AS n FROM regions GROUP BY image_id, region QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, region) = 1) SELECT image_id, y, x FROM regions JOIN c USING (image_id, region)"),
    "component_stats": regions(", c AS (SELECT image_id, region, count(*) AS area FROM regions GROUP BY ALL) SELECT image_id, count(*) AS n_regions, max(area) AS largest_area, sum(area)::BIGINT AS total_area FROM c GROUP BY image_id"),
    "classify_images": regions(_CLASSIFY + " SELECT * FROM classified", _HIT),
    "pixel_auroc": pixels(f", a AS ({_ANOMALOUS}), c AS (SELECT score, sum(label) AS p, count(*) - sum(label) AS n FROM a GROUP BY score), b AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c) SELECT round(sum(p * (below + n / 2))::DOUBLE / (sum(p) * sum(n))::DOUBLE, 6) AS auroc FROM b"),
    "pixel_best_f1": pixels(_BEST.format(src=_ANOMALOUS, f=_F1.format(e="1e-10"))),
    "pro_curve_exact": regions(_PRO + " SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(pro, 6) AS pro FROM curve"),
    "au_pro_exact": regions(_PRO + _PRO0 + " SELECT round(area / 0.3, 6) AS au_pro FROM " + _AREA.format(x="fpr", y="pro", c="c0")),
    "official_eval": regions(_PRO + _PRO0 + f", i AS (SELECT image_id, max(score) AS score, max(gt_mask) AS label FROM pixels GROUP BY image_id) SELECT round(area / 0.3, 6) AS au_pro, (SELECT round({_PAIRS_AUROC}, 6) FROM i a, i b WHERE a.label = 1 AND b.label = 0) AS auroc FROM " + _AREA.format(x="fpr", y="pro", c="c0")),
    "trapezoid_limit": scores(", t AS (SELECT DISTINCT score AS threshold FROM scores UNION ALL SELECT 'infinity'::DOUBLE), r AS (SELECT threshold, count(*) FILTER (score >= threshold AND label = 0)::DOUBLE / count(*) FILTER (label = 0) AS fpr, count(*) FILTER (score >= threshold AND label = 1)::DOUBLE / count(*) FILTER (label = 1) AS tpr FROM t, scores GROUP BY threshold) SELECT round(area, 6) AS area FROM " + _AREA.format(x="fpr", y="tpr", c="r")),
    "au_pro_200": regions(
        _SIZED + ", u AS (SELECT p.*, coalesce(1.0::DOUBLE / sized.n, 0) AS part FROM pixels p LEFT JOIN sized USING (image_id, y, x) WHERE p.image_id IN (SELECT image_id FROM regions))"
        ", e AS (SELECT min(score) AS lo, max(score) AS hi FROM u)"
        ", c AS (SELECT k, count(*) FILTER (gt_mask = 0 AND score >= lo + (hi - lo) * k / 199.0::DOUBLE)::DOUBLE / count(*) FILTER (gt_mask = 0) AS fpr, coalesce(sum(part) FILTER (gt_mask = 1 AND score >= lo + (hi - lo) * k / 199.0::DOUBLE), 0) / (SELECT n_regions FROM nr) AS pro FROM range(0, 200) t(k), u, e GROUP BY k)"
        ", f AS (SELECT fpr, pro, coalesce(lag(fpr) OVER o, 0.0) AS x0, coalesce(lag(pro) OVER o, pro) AS y0 FROM c WHERE fpr <= 0.3 WINDOW o AS (ORDER BY fpr, k))"
        " SELECT round(greatest(0.0, least(1.0, sum((fpr - x0) * (pro + y0) / 2) / 0.3::DOUBLE)), 6) AS au_pro FROM f"
    ),
    "iou_pooled": pixels(" SELECT round(sum((score > 100 AND gt_mask = 1)::INT) / sum((score > 100 OR gt_mask = 1)::INT), 6) AS iou FROM pixels"),
    "iou_per_image": pixels(" SELECT image_id, round(coalesce(sum((score > 100 AND gt_mask = 1)::INT) / nullif(sum((score > 100 OR gt_mask = 1)::INT), 0), 1), 6) AS iou FROM pixels GROUP BY image_id"),
    "segment_percentile": SQL["gaussian_smooth"].replace(" SELECT p.image_id, p.y, p.x, round(sum(q.s * w), 6) AS value FROM v p", ", g AS (SELECT p.image_id, p.y, p.x, sum(q.s * w) AS value FROM v p").replace("39 - p.x - d ELSE p.x + d END GROUP BY ALL", "39 - p.x - d ELSE p.x + d END GROUP BY ALL), r AS (SELECT g.*, score <> 0 AS roi FROM g JOIN pixels USING (image_id, y, x)), q AS (SELECT image_id, quantile_cont(value, 0.95) AS cut FROM r WHERE roi GROUP BY image_id) SELECT image_id, y, x, (roi AND value > cut)::INT AS mask FROM r JOIN q USING (image_id)"),
    "compare_methods": results((_CMP := ", c AS (SELECT a.object_name, a.auroc AS value_a, b.auroc AS value_b, b.auroc - a.auroc AS diff FROM results a JOIN results b USING (object_name) WHERE a.method_name = 'BUILDING' AND b.method_name = 'MACHINERY')") + " SELECT object_name, round(value_a, 6) AS value_a, round(value_b, 6) AS value_b, round(diff, 6) AS diff, round(diff * 100 / nullif(value_a, 0), 6) AS improvement FROM c"),
    "paired_t_stat": results(_CMP + " SELECT count(*) AS n, round(avg(diff), 6) AS mean_diff, round(stddev_samp(diff), 6) AS std_diff, round(avg(diff) / (stddev_samp(diff) / sqrt(count(*))), 6) AS t_stat FROM c"),
    "object_method_pivot": results(" SELECT object_name, " + ", ".join(f"round(avg(auroc) FILTER (method_name = '{m}'), 6) AS \"{m}\"" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM results GROUP BY object_name"),
    "metrics_table": results(" SELECT object_name, " + ", ".join(f"coalesce(printf('%.3f', round(avg(auroc) FILTER (method_name = '{m}'), 3)), '-') AS \"{m}\"" for m in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM results GROUP BY object_name"),
    "merge_results": results((_TWO := ", l AS (SELECT object_name, method_name, auroc, tp FROM results WHERE method_name <> 'MACHINERY'), r AS (SELECT object_name, method_name, auroc + 1 AS auroc, tp + 1 AS tp FROM results WHERE object_name < 'obj15' AND method_name <> 'BUILDING')") + " SELECT object_name, method_name, round(coalesce(r.auroc, l.auroc), 6) AS auroc, coalesce(r.tp, l.tp) AS tp FROM l FULL JOIN r USING (object_name, method_name)"),
    "difference_table": results(_TWO + " SELECT object_name, method_name, round(r.auroc - l.auroc, 6) AS diff FROM l FULL JOIN r USING (object_name, method_name)"),
    "list_methods": results(" SELECT DISTINCT method_name FROM results"),
    "common_objects": results(_TWO + " SELECT object_name FROM l INTERSECT SELECT object_name FROM r"),
    "shot_count_analysis": results(", k AS (SELECT (2 ** (length(method_name) % 4))::INT AS k, avg(auroc) AS m FROM results GROUP BY 1) SELECT k, round(m, 6) AS mean_metric, round((last_value(m) OVER w - first_value(m) OVER w) * 100 / first_value(m) OVER w, 6) AS improvement FROM k WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    "results_to_json": results(" SELECT object_name, '{\"method_name\":\"' || method_name || '\",\"tp\":' || tp || ',\"fp\":' || fp || '}' AS record FROM results"),
    "export_format_4dp": results(" SELECT object_name, method_name, printf('%.4f', round(auroc, 4)) AS auroc_text FROM results"),
    "diverse_examples": scores(", m AS (SELECT min(score) AS vmin, max(score) AS vmax FROM scores) SELECT * FROM ((SELECT * FROM scores WHERE label = 0 ORDER BY score, image_id LIMIT 2) UNION ALL (SELECT * FROM scores WHERE label = 1 ORDER BY score DESC, image_id LIMIT 2)), m"),
    "timing_summary": "WITH t AS (SELECT event_type AS stage, sum(value) AS total, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT stage, round(total, 3) AS total, round(total * 100 / sum(total) OVER (), 6) AS percent, round(total / n, 6) AS per_image FROM t",
    "few_shot_reference_select": catalog(" SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY name)::INT AS rank FROM catalog WHERE split = 'train' AND regexp_extract(name, '[.][^.]+$') IN ('.png', '.jpg', '.jpeg') QUALIFY rank <= 8"),
    "path_extension_filter": catalog(" SELECT path, 'exact' AS mode FROM catalog WHERE regexp_matches(name, '[.](png|jpg|jpeg)$') UNION ALL SELECT path, 'any_case' FROM catalog WHERE regexp_matches(lower(name), '[.](png|jpg|jpeg)$')"),
    "stratified_sample_k": catalog(" SELECT category, name, row_number() OVER (PARTITION BY category ORDER BY defect, md5('42/' || name), name)::INT AS rank FROM catalog WHERE split = 'test' QUALIFY rank <= 5"),
    "sample_filter": catalog(" SELECT category, defect, name FROM catalog WHERE category IN ('src1', 'src2') AND split = 'test' AND label = 1"),
    "mask_left_join": catalog(" SELECT path, label, CASE WHEN label = 1 AND left(name, 8)::INT % 3 <> 0 THEN right(left(name, 8), 4)::INT + 1 ELSE 0 END::INT AS mask_area FROM catalog WHERE split = 'test'"),
    "distinct_categories": "SELECT DISTINCT coalesce(source, 'unnamed') AS category FROM documents",
    "unique_match_guard": catalog(", f AS (SELECT substring(name, 6, 3) AS stem FROM catalog) SELECT w.stem, count(f.stem) AS matches, CASE count(f.stem) WHEN 1 THEN 'ok' WHEN 0 THEN 'missing' ELSE 'ambiguous' END AS status FROM (SELECT lpad(k::VARCHAR, 3, '0') AS stem FROM range(0, 1000, 7) t(k)) w LEFT JOIN f USING (stem) GROUP BY w.stem"),
    "eval_pairing": catalog(" SELECT path, CASE WHEN defect <> 'good' THEN category || '/ground_truth/' || defect || '/' || regexp_replace(name, '[.][^.]+$', '_mask.png') END AS gt_path, CASE WHEN left(name, 8)::INT % 4 <> 3 THEN 'maps/' || path END AS prediction_path FROM catalog WHERE split = 'test' AND regexp_matches(replace(defect, '_', ''), '^[A-Za-z]+$')"),
    "label_from_name": catalog(" SELECT path, label FROM catalog"),
    "config_lookup": catalog(" SELECT category, count(*) AS n_files, category IN ('src0', 'src2', 'src4', 'src6', 'src8') AS rotate FROM catalog GROUP BY category"),
}

# principal components, by squaring the matrix of inner products until only the largest axis is left


def _axis(k: int) -> str:
    """CTEs gram<k>, ..., comp<k>(image_id, v): projections on the k-th axis; earlier axes are taken off."""
    off = "".join(f" - v{i}[i] * v{i}[j]" for i in range(k))
    source = "cen" + "".join(f" JOIN (SELECT image_id, v AS v{i} FROM comp{i}) USING (image_id)" for i in range(k))
    return (
        f", gram{k}(image_id, k, g) AS (SELECT image_id, 0, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: list_inner_product(c[i], c[j]){off})) FROM {source}"
        f" UNION ALL SELECT image_id, k + 1, list_transform(h, lambda a: list_transform(h, lambda b: list_inner_product(a, b))) FROM (SELECT image_id, k, list_transform(g, lambda a: list_transform(a, lambda x: x / t)) AS h FROM (SELECT *, list_sum(list_transform(range(1, len(g) + 1), lambda i: g[i][i])) AS t FROM gram{k} WHERE k < 34)))"
        f", top{k} AS (SELECT image_id, g[list_position(d, list_max(d))] AS u FROM (SELECT image_id, g, list_transform(range(1, len(g) + 1), lambda i: g[i][i]) AS d FROM gram{k} WHERE k = 34))"
        f", load{k} AS (SELECT image_id, c, list_transform(range(1, 65), lambda j: list_inner_product(u, list_transform(c, lambda r: r[j]))) AS a FROM top{k} JOIN cen USING (image_id))"
        f", sign{k} AS (SELECT image_id, c, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) * sign(a[list_position(list_transform(a, lambda x: abs(x)), list_max(list_transform(a, lambda x: abs(x))))]) AS l FROM load{k})"
        f", comp{k} AS (SELECT image_id, list_transform(c, lambda r: list_inner_product(r, a) / l) AS v FROM sign{k})"
    )


_CENTRED = (
    ", p AS (SELECT image_id, list(vec_id ORDER BY patch_id) AS ids, list(list_transform(embedding, lambda x: x::DOUBLE) ORDER BY patch_id) AS m, count(*) AS n FROM patches GROUP BY image_id)"
    ", mid AS (SELECT *, list_transform(range(1, 65), lambda j: list_avg(list_transform(m, lambda t: t[j]))) AS mu FROM p)"
    ", cen AS (SELECT image_id, ids, n, list_transform(m, lambda r: list_transform(range(1, 65), lambda j: r[j] - mu[j])) AS c FROM mid)"
)


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _near(source: str, to: str, pick: str, reach: int) -> str:
    """A 0/1 column f of cells widened (max) or narrowed (min) by `reach` cells."""
    return f", {to} AS (SELECT p.image_id, p.y, p.x, {pick}(q.f) AS f FROM {source} p JOIN {source} q ON q.image_id = p.image_id AND abs(q.y - p.y) <= {reach} AND abs(q.x - p.x) <= {reach} GROUP BY ALL)"


#: The first component on the 4 x 5 grid, standardised and between 0 and 1; Otsu's mask of it, and the numbers behind it.
_PC = ", pc AS (SELECT image_id, ((k - 1) // 5)::INT AS y, ((k - 1) % 5)::INT AS x, ids[k] AS vec_id, v[k] AS v FROM comp0 JOIN p USING (image_id), range(1, 21) t(k))"
_FG = (
    _CENTRED + _axis(0) + _PC + ", st AS (SELECT image_id, y, x, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-8) AS z FROM pc WINDOW w AS (PARTITION BY image_id))"
    ", un AS (SELECT *, (z - min(z) OVER w) / (max(z) OVER w - min(z) OVER w + 1e-8) AS u FROM st WINDOW w AS (PARTITION BY image_id))"
    ", lv AS (SELECT image_id, floor(255 * u)::INT AS level FROM un)"
    ", og AS (SELECT image_id, t.k::INT AS level, count(*) FILTER (lv.level <= k)::BIGINT AS w, coalesce(sum(lv.level) FILTER (lv.level <= k), 0)::BIGINT AS s, count(*)::BIGINT AS n, sum(lv.level)::BIGINT AS total FROM lv, range(0, 256) t(k) GROUP BY ALL)"
    ", ob AS (SELECT image_id, level, CASE WHEN w > 0 AND w < n THEN (total * w - s * n)::DOUBLE * (total * w - s * n)::DOUBLE / (w * (n - w))::DOUBLE ELSE -1 END AS between_classes FROM og)"
    ", ot AS (SELECT image_id, level / 255.0::DOUBLE AS threshold FROM ob QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY between_classes DESC, level) = 1)"
    ", m0 AS (SELECT un.*, threshold, u >= threshold AS m FROM un JOIN ot USING (image_id))"
    ", ce AS (SELECT image_id, avg(m::INT) AS centre_share FROM m0 WHERE y >= 1 AND y < 3 AND x >= 1 AND x < 3 GROUP BY image_id)"
    ", m1 AS (SELECT m0.*, centre_share, CASE WHEN centre_share < 0.35 THEN NOT m ELSE m END AS turned FROM m0 JOIN ce USING (image_id))"
    ", sh AS (SELECT image_id, avg(turned::INT) AS share, quantile_cont(z, 0.8) AS top FROM m1 GROUP BY image_id)"
    ", m2 AS (SELECT image_id, y, x, CASE WHEN share < 0.03 OR share > 0.7 THEN z >= top ELSE turned END::INT AS f FROM m1 JOIN sh USING (image_id))"
    + _near("m2", "m3", "max", 2) + _near("m3", "m4", "min", 2) + _near("m4", "m5", "min", 1) + _near("m5", "m6", "max", 1) +
    ", fr(image_id, root, y, x) AS (SELECT image_id, y * 5 + x, y, x FROM m6 WHERE f = 1 UNION SELECT r.image_id, r.root, q.y, q.x FROM fr r JOIN m6 q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1 AND q.f = 1)"
    ", fl AS (SELECT image_id, y, x, min(root) AS region FROM fr GROUP BY ALL)"
    ", fb AS (SELECT image_id, region FROM (SELECT image_id, region, count(*) AS n FROM fl GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, region) = 1)"
    ", fk AS (SELECT fl.* FROM fl JOIN fb USING (image_id, region))"
    ", sp AS (SELECT image_id, (max(y) - min(y) + 1) / 4.0::DOUBLE AS span_y, (max(x) - min(x) + 1) / 5.0::DOUBLE AS span_x FROM fk GROUP BY image_id)"
    ", sl AS (SELECT image_id, regr_slope(z, x) AS a, regr_slope(z, y) AS b, avg(z) AS mz FROM st GROUP BY image_id)"
    ", pr AS (SELECT image_id, stddev_pop(z - mz - a * (x - 2) - b * (y - 1.5)) / (stddev_pop(z) + 1e-8) AS planar_ratio FROM st JOIN sl USING (image_id) GROUP BY image_id)"
    ", fd AS (SELECT image_id, threshold, centre_share, share, coalesce(span_y, 0) AS span_y, coalesce(span_x, 0) AS span_x, planar_ratio, planar_ratio < 0.4 OR least(coalesce(span_y, 0), coalesce(span_x, 0)) < 0.35 AS whole FROM ot JOIN ce USING (image_id) JOIN sh USING (image_id) JOIN pr USING (image_id) LEFT JOIN sp USING (image_id))"
    ", fgm AS (SELECT pc.image_id, pc.vec_id, pc.y, pc.x, CASE WHEN whole THEN 1 ELSE (fk.image_id IS NOT NULL)::INT END AS fg FROM pc JOIN fd USING (image_id) LEFT JOIN fk USING (image_id, y, x))"
)


def mirrored(i: str, n: int) -> str:
    """A place beyond the edges mirrored about them, for any distance."""
    m = f"((({i}) % {2 * n} + {2 * n}) % {2 * n})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 1} - {m} END"


def smoothed(source: str, to: str, h: int, w: int, column: str = "score", sigma: float = 4) -> str:
    """CTEs ending in `to`(image_id, y, x, value): a column of whole h x w grids smoothed with a normal weight."""
    r, var = int(4 * sigma + 0.5), sigma * sigma
    k = f"(SELECT e AS d, exp(-0.5 * e * e / {var}::DOUBLE) / (SELECT sum(exp(-0.5 * f * f / {var}::DOUBLE)) FROM range({-r}, {r + 1}) t(f)) AS w FROM range({-r}, {r + 1}) t(e))"
    return (
        f", {to}_v AS (SELECT p.image_id, p.y, p.x, sum(q.{column} * k.w) AS s FROM {source} p, {k} k JOIN {source} q ON q.image_id = p.image_id AND q.x = p.x AND q.y = {mirrored('p.y + k.d', h)} GROUP BY ALL)"
        f", {to} AS (SELECT p.image_id, p.y, p.x, sum(q.s * k.w) AS value FROM {to}_v p, {k} k JOIN {to}_v q ON q.image_id = p.image_id AND q.y = p.y AND q.x = {mirrored('p.x + k.d', w)} GROUP BY ALL)"
    )


def resized(source: str, to: str, h: int, w: int, out_h: int, out_w: int, column: str) -> str:
    """CTEs ending in `to`(image_id, y, x, score): a column of whole h x w grids brought to another size, bilinear."""

    def axis(n_out: int, n_in: int) -> str:
        return f"(SELECT i, floor(s)::INT AS a, least(floor(s)::INT + 1, {n_in - 1}) AS b, s - floor(s) AS f FROM (SELECT i::INT AS i, least(greatest((i + 0.5) * {n_in} / {n_out} - 0.5, 0.0), {n_in - 1}.0)::DOUBLE AS s FROM range(0, {n_out}) r(i)))"

    c = column
    return (
        f", {to} AS (SELECT p.image_id, ty.i AS y, tx.i AS x, (p.{c} * (1 - tx.f) + q.{c} * tx.f) * (1 - ty.f) + (r.{c} * (1 - tx.f) + u.{c} * tx.f) * ty.f AS score FROM {axis(out_h, h)} ty, {axis(out_w, w)} tx"
        f" JOIN {source} p ON p.y = ty.a AND p.x = tx.a JOIN {source} q ON q.image_id = p.image_id AND q.y = ty.a AND q.x = tx.b JOIN {source} r ON r.image_id = p.image_id AND r.y = ty.b AND r.x = tx.a JOIN {source} u ON u.image_id = p.image_id AND u.y = ty.b AND u.x = tx.b)"
    )


def background(source: str, to: str, h: int, w: int) -> str:
    """CTEs ending in `to`(image_id, y, x, f): the percentile mask of a smoothed map, turned over by its centre, dilated and closed."""
    inside = f"y >= {int(h * 0.2)} AND y < {int(h * 0.8)} AND x >= {int(w * 0.2)} AND x < {int(w * 0.8)}"
    return (
        smoothed(source, f"{to}_s", h, w) + f", {to}_q AS (SELECT image_id, quantile_cont(value, 0.7) AS cut FROM {to}_s GROUP BY image_id)"
        f", {to}_c AS (SELECT image_id, avg((value > cut)::INT) AS centre FROM {to}_s JOIN {to}_q USING (image_id) WHERE {inside} GROUP BY image_id)"
        f", {to}_0 AS (SELECT image_id, y, x, CASE WHEN centre <= 0.35 THEN value < cut ELSE value > cut END::INT AS f FROM {to}_s JOIN {to}_q USING (image_id) JOIN {to}_c USING (image_id))"
        + _near(f"{to}_0", f"{to}_1", "max", 1) + _near(f"{to}_1", f"{to}_2", "max", 2) + _near(f"{to}_2", to, "min", 2)
    )


# detectors

_TEST_KNN = _NORMAL + f", dist AS (SELECT q.vec_id, {_DIST} AS d FROM n q, n b WHERE q.image_id % 2 = 1 AND b.image_id % 2 = 0), ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d) AS r FROM dist), knn AS (SELECT vec_id, avg(d) AS score FROM ranked WHERE r <= 3 GROUP BY ALL)"
_MAP = ", map AS (SELECT vec_id, image_id, fg, CASE WHEN fg = 1 THEN score ELSE 0.0 END AS score FROM fgm JOIN {s} USING (vec_id{also}))"
_BACK = _CENTRED + _axis(0) + _PC + ", sal AS (SELECT image_id, y, x, v AS score FROM pc)" + background("sal", "bg", 4, 5)


def detector(sql: str) -> str:
    return recursive(patches(sql))


_TEST_MAP = _TEST_KNN + _FG + _MAP.format(s="knn", also="")
_LOO_MAP = _LOO + _FG + _MAP.format(s="loo", also=", image_id")
_MASKED = "(SELECT * FROM map WHERE fg = 1)"
SQL |= {
    "l2_normalize_small_eps": patches(", e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 1e-9) AS v FROM patches), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) + 1e-10 AS l FROM e) SELECT vec_id, (pos - 1)::INT AS pos, round(v[pos] / l, 6) AS value FROM n, range(1, 65) t(pos)"),
    "pca_first_component": detector(_CENTRED + _axis(0) + _PC + " SELECT vec_id, round(v, 6) AS component FROM pc"),
    "pca_rgb": detector(_CENTRED + _axis(0) + _axis(1) + _axis(2) + ", b AS (SELECT p.ids, c0.v AS r, c1.v AS g, c2.v AS b, list_min(list_concat(c0.v, list_concat(c1.v, c2.v))) AS lo, list_max(list_concat(c0.v, list_concat(c1.v, c2.v))) AS hi FROM p JOIN comp0 c0 USING (image_id) JOIN comp1 c1 USING (image_id) JOIN comp2 c2 USING (image_id)) SELECT ids[k] AS vec_id, round((r[k] - lo) / (hi - lo + 1e-8), 6) AS red, round((g[k] - lo) / (hi - lo + 1e-8), 6) AS green, round((b[k] - lo) / (hi - lo + 1e-8), 6) AS blue FROM b, range(1, 21) t(k)"),
    "foreground_mask": detector(_FG + " SELECT image_id, vec_id, fg FROM fgm"),
    "foreground_details": detector(_FG + " SELECT image_id, round(threshold, 6) AS threshold, round(centre_share, 6) AS centre_share, round(share, 6) AS share, round(span_y, 6) AS span_y, round(span_x, 6) AS span_x, round(planar_ratio, 6) AS planar_ratio, whole FROM fd"),
    "masked_features": detector(_BACK + " SELECT image_id, vec_id FROM pc JOIN bg USING (image_id, y, x) WHERE f = 1"),
    "masked_scatter": detector(_TEST_MAP + " SELECT vec_id, fg, round(score, 6) AS score FROM map"),
    "masked_zero_out": detector(_TEST_MAP + " SELECT image_id, round(image_score, 6) AS image_score FROM " + tail("map", 0.25)),
    "few_shot_detect": detector(_TEST_MAP + " SELECT image_id, round(image_score, 6) AS image_score FROM " + tail(_MASKED, 0.25)),
    "zero_shot_detect": detector(_LOO_MAP + " SELECT image_id, round(image_score, 6) AS image_score FROM " + tail(_MASKED, 0.25)),
    "zero_shot_detect_unmasked": patches(_LOO + " SELECT image_id, round(image_score, 6) AS image_score FROM " + tail("loo", 0.25)),
    "batched_zero_shot_auroc": detector(_LOO + _BACK + ", map AS (SELECT loo.image_id, CASE WHEN image_id % 5 IN (0, 2) AND f = 0 THEN 0.0 ELSE loo.score END AS score FROM loo JOIN pc USING (image_id, vec_id) JOIN bg USING (image_id, y, x)), i AS (SELECT (image_id % 5)::INT AS category, round(image_score, 9) AS score, image_id % 2 AS label FROM " + tail("map", 0.25) + ") SELECT a.category, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 6) AS auroc FROM i a JOIN i b ON a.category = b.category AND a.label = 1 AND b.label = 0 GROUP BY a.category"),
    "background_mask_threshold": pixels(background("pixels", "bg", 20, 20) + " SELECT image_id, y, x, f AS fg FROM bg"),
    "masked_image": recursive(with_tables(_CENTRED + _axis(0) + _PC + resized("pc", "up", 4, 5, 20, 20, "v") + smoothed("up", "sm", 20, 20) + ", q AS (SELECT image_id, quantile_cont(value, 0.7) AS cut FROM sm GROUP BY image_id) SELECT image_id, y, x, round(score * (value > cut)::INT, 6) AS value FROM pixels JOIN sm USING (image_id, y, x) JOIN q USING (image_id)", "patches", "pixels")),
    "optimal_threshold_without_defects": "SELECT 0.0::DOUBLE AS threshold, 0.0::DOUBLE AS value",
    "segment_resized": SQL["segment_percentile"].replace(" SELECT image_id, y, x, (roi AND value > cut)::INT AS mask FROM r JOIN q USING (image_id)", ", m AS (SELECT image_id, y, x, (roi AND value > cut)::INT AS mask FROM r JOIN q USING (image_id)) SELECT image_id, a::INT AS y, b::INT AS x, mask FROM range(0, 30) s(a), range(0, 50) t(b) JOIN m ON y = a * 20 // 30 AND x = b * 20 // 50"),
    "segment_threshold": SQL["segment_percentile"].replace("value > cut)::INT AS mask FROM r JOIN q USING (image_id)", "value > 75.0)::INT AS mask FROM r"),
}

_TRUTH = smoothed("up", "sm", 40, 40) + ", mt AS (SELECT round(value, 9) AS score, gt_mask AS label FROM sm JOIN pixels p ON p.image_id = sm.image_id AND p.y = sm.y // 2 AND p.x = sm.x // 2)"
for _name, _f in (("f1", _F1.format(e="1e-8")), ("iou", "tp / (p + pp - tp + 1e-8)")):
    SQL[f"optimal_threshold_{_name}"] = pixels(resized("pixels", "up", 20, 20, 40, 40, "score") + _TRUTH + _BEST.format(src="SELECT score, label FROM mt", f=_f))

# two normal components, by expectation and maximisation over lists


def mixture(sigma: float) -> str:
    """CTEs ending in gmm(image_id, y, x, mask) of the pixels smoothed with a deviation of sigma."""
    norm = lambda i: f"ln(s{i} + 1e-300) - 0.5 * ln(2 * pi() * v{i}) - 0.5 * (x - m{i}) * (x - m{i}) / v{i}"
    share = f"CASE WHEN ({norm(1)}) - ({norm(0)}) > 700 THEN 0.0 ELSE 1 / (1 + exp(({norm(1)}) - ({norm(0)}))) END"  # of component 0
    dot = lambda a, f: f"list_sum(list_transform(range(1, len(xs) + 1), lambda i: {a} * {f}))"
    return (
        smoothed("pixels", "sm", 20, 20, sigma=sigma) + ", va AS (SELECT image_id, list(value ORDER BY y, x) AS xs, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b, var_pop(value) + 1e-6 AS v FROM sm JOIN pixels USING (image_id, y, x) WHERE score <> 0 GROUP BY image_id)"
        ", em(image_id, k, xs, m0, m1, v0, v1, s0, s1) AS (SELECT image_id, 0, xs, a, b, v, v, 0.5::DOUBLE, 0.5::DOUBLE FROM va UNION ALL SELECT image_id, k + 1, xs, c0, c1"
        f", {dot('p[i]', '(xs[i] - c0) * (xs[i] - c0)')} / n0 + 1e-6, {dot('(1 - p[i])', '(xs[i] - c1) * (xs[i] - c1)')} / n1 + 1e-6, n0 / len(xs), n1 / len(xs)"
        f" FROM (SELECT *, {dot('p[i]', 'xs[i]')} / n0 AS c0, {dot('(1 - p[i])', 'xs[i]')} / n1 AS c1 FROM (SELECT *, list_sum(p) + 1e-12 AS n0, len(xs) - list_sum(p) + 1e-12 AS n1 FROM (SELECT *, list_transform(xs, lambda x: {share}) AS p FROM em WHERE k < 100))))"
        f", gmm AS (SELECT image_id, y, x, CASE WHEN score <> 0 THEN CASE WHEN first THEN (p >= 0.5)::INT ELSE (p < 0.5)::INT END ELSE 0 END AS mask FROM (SELECT q.image_id, q.y, q.x, q.score, first, {share.replace('(x - m', '(value - m')} AS p FROM pixels q JOIN sm USING (image_id, y, x) JOIN em ON em.image_id = q.image_id AND em.k = 99 JOIN (SELECT image_id, m0 >= m1 AS first FROM em WHERE k = 100) e ON e.image_id = q.image_id))"
    )


SQL |= {
    "segment_gmm": recursive(pixels(mixture(4) + " SELECT * FROM gmm")),
    "gmm_mask": recursive(pixels(mixture(0.5) + " SELECT image_id, sum(mask)::BIGINT AS n_anomalous FROM gmm GROUP BY image_id")),
    "paired_t_p_value": results(_CMP + ", t AS (SELECT count(*) - 1 AS df, abs(avg(diff) / (stddev_samp(diff) / sqrt(count(*)))) AS t FROM c), u AS (SELECT df, k, atan(t / sqrt(df)) AS u FROM t, range(0, 50000) r(k)) SELECT round(1 - (sum(cos(u * (k + 0.5) / 50000) ** (df - 1)) * any_value(u)) / (sum(cos(pi() / 2 * (k + 0.5) / 50000) ** (df - 1)) * pi() / 2), 6) AS p_value FROM u"),
    "stream_scores": SQL["knn_score_k3"].replace("SELECT vec_id, round(score, 6)", "SELECT vec_id AS query_id, round(score, 6)"),
}

# turned images


def turned(angles: tuple[int, ...], centre: str, at) -> str:
    """CTE turned(image_id, angle, y, x, value) of the 20 x 20 images; `at` gives the place inside of any place."""
    places = f"(SELECT angle, y, x, round({centre} + cos(radians(angle)) * (x - {centre}) - sin(radians(angle)) * (y - {centre}), 9) AS sx, round({centre} + sin(radians(angle)) * (x - {centre}) + cos(radians(angle)) * (y - {centre}), 9) AS sy FROM (SELECT unnest({list(angles)}) AS angle), range(0, 20) a(y), range(0, 20) b(x))"
    corner = lambda name, dy, dx: f" JOIN pixels {name} ON {name}.image_id = i.image_id AND {name}.y = {at(f'floor(sy)::INT + {dy}')} AND {name}.x = {at(f'floor(sx)::INT + {dx}')}"
    value = "CASE WHEN angle = 0 THEN (SELECT score FROM pixels o WHERE o.image_id = i.image_id AND o.y = t.y AND o.x = t.x) ELSE (p.score * (1 - (sx - floor(sx))) + q.score * (sx - floor(sx))) * (1 - (sy - floor(sy))) + (r.score * (1 - (sx - floor(sx))) + u.score * (sx - floor(sx))) * (sy - floor(sy)) END"
    return f", ids AS (SELECT DISTINCT image_id FROM pixels), turned AS (SELECT i.image_id, angle::INT AS angle, t.y::INT AS y, t.x::INT AS x, {value} AS value FROM ids i, {places} t" + corner("p", 0, 0) + corner("q", 0, 1) + corner("r", 1, 0) + corner("u", 1, 1) + ")"


_EIGHT = turned(tuple(range(0, 360, 45)), "10", lambda i: f"least(greatest({i}, 0), 19)")
_mirror101 = lambda i: f"CASE WHEN ((({i}) % 38 + 38) % 38) < 20 THEN ((({i}) % 38 + 38) % 38) ELSE 38 - ((({i}) % 38 + 38) % 38) END"
SQL |= {
    "rotate_images": pixels(_EIGHT + " SELECT image_id, angle, y, x, round(value, 6) AS value FROM turned"),
    "rotate_reflect": pixels(turned((30, 45, 200), "10.0", _mirror101) + " SELECT image_id, angle, y, x, round(value, 6) AS value FROM turned"),
    "memory_bank_rotated": pixels(_EIGHT + ", pt AS (SELECT image_id, angle, y // 5 * 4 + x // 5 AS patch_id, sum(value) AS s, sqrt(sum(value * value)) + 1e-8 AS l FROM turned GROUP BY ALL) SELECT image_id, angle, count(*) AS n_vectors, round(sum(s / l), 5) AS total FROM pt GROUP BY ALL"),
}

# the metrics of runs


def percentile_masks(h: int, w: int) -> str:
    """CTE seg(image_id, y, x, gt_mask, mask) of cells(image_id, y, x, score, gt_mask)."""
    return (
        smoothed("cells", "sm", h, w) + ", rq AS (SELECT sm.image_id, quantile_cont(value, 0.95) AS cut FROM sm JOIN cells USING (image_id, y, x) WHERE score <> 0 GROUP BY ALL)"
        ", seg AS (SELECT c.image_id, c.y, c.x, gt_mask, (score <> 0 AND value > cut)::INT AS mask FROM cells c JOIN sm USING (image_id, y, x) LEFT JOIN rq USING (image_id))"
    )


def assembly(h: int, w: int, masks: str | None = None) -> str:
    """CTEs ending in metrics(obj, ...), from cells(image_id, y, x, score, gt_mask), runs(image_id, obj, score, label) and fgs(image_id, y, x, fg); masks: CTEs ending in seg."""
    flood = lambda name, cond: f", {name}_r(image_id, root, y, x) AS (SELECT image_id, y * {w} + x, y, x FROM {name}_c UNION SELECT r.image_id, r.root, q.y, q.x FROM {name}_r r JOIN {name}_c q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1), {name} AS (SELECT image_id, y, x, min(root) AS region FROM {name}_r GROUP BY ALL)"  # noqa: E731, ARG005
    return (
        (masks or percentile_masks(h, w)) + ", segs AS (SELECT s.* REPLACE (coalesce(mask, 0) AS mask), obj, label, coalesce(fg, 1) AS fg FROM seg s JOIN runs USING (image_id) LEFT JOIN fgs USING (image_id, y, x))"
        ", iou AS (SELECT obj, coalesce(sum(mask * gt_mask) / nullif(sum(greatest(mask, gt_mask)), 0), 1)::DOUBLE AS mean_iou FROM segs WHERE label = 1 GROUP BY obj)"
        ", hit_c AS (SELECT image_id, y, x FROM segs WHERE mask = 1 AND fg = 1)" + flood("hit", "") +
        ", hs AS (SELECT image_id, max(n) AS largest FROM (SELECT image_id, region, count(*) AS n FROM hit GROUP BY ALL) GROUP BY image_id)"
        ", fs AS (SELECT image_id, obj, label, sum(fg) AS n_fg, sum(fg * mask) AS n_hit FROM segs GROUP BY ALL)"
        ", gs AS (SELECT obj, label, CASE WHEN n_fg = 0 OR n_hit = 0 OR n_hit / n_fg >= 0.7 OR largest < 0.005 * n_fg OR largest < 10 THEN 0 ELSE 1 END AS predicted FROM fs LEFT JOIN hs USING (image_id))"
        ", cf AS (SELECT obj, min(label) < max(label) AS two, count(*) FILTER (label = 1 AND predicted = 1) AS tp, count(*) FILTER (label = 0 AND predicted = 1) AS fp, count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 0 AND predicted = 0) AS tn FROM gs GROUP BY obj)"
        f", ia AS (SELECT a.obj, {_PAIRS_AUROC} AS auroc FROM runs a JOIN runs b ON a.obj = b.obj AND a.label = 1 AND b.label = 0 GROUP BY a.obj)"
        ", odd AS (SELECT cells.*, obj FROM cells JOIN runs r USING (image_id) WHERE label = 1)"
        ", pv AS (SELECT obj, score, sum(gt_mask) AS pos, count(*) - sum(gt_mask) AS neg FROM odd GROUP BY ALL)"
        ", pb AS (SELECT *, sum(neg) OVER (PARTITION BY obj ORDER BY score) - neg AS below, sum(pos) OVER d AS tp, sum(pos + neg) OVER d AS pp, sum(pos) OVER (PARTITION BY obj) AS p, sum(neg) OVER (PARTITION BY obj) AS n FROM pv WINDOW d AS (PARTITION BY obj ORDER BY score DESC))"
        f", pa AS (SELECT obj, CASE WHEN max(n) > 0 AND max(p) > 0 THEN sum(pos * (below + neg / 2))::DOUBLE / (max(p) * max(n))::DOUBLE END AS pixel_auroc, CASE WHEN max(n) > 0 AND max(p) > 0 THEN max(round({_F1.format(e='1e-10')}, 9)) END AS pixel_f1 FROM pb GROUP BY obj)"
        ", gt_c AS (SELECT image_id, y, x FROM odd WHERE gt_mask = 1)" + flood("gt", "") +
        ", gz AS (SELECT *, count(*) OVER (PARTITION BY image_id, region) AS n FROM gt), gn AS (SELECT obj, count(*) AS n_regions FROM (SELECT DISTINCT image_id, region FROM gt) JOIN runs USING (image_id) GROUP BY obj)"
        ", us AS (SELECT odd.*, coalesce(1.0::DOUBLE / gz.n, 0) AS part FROM odd LEFT JOIN gz USING (image_id, y, x)), en AS (SELECT obj, min(score) AS lo, max(score) AS hi FROM us GROUP BY obj)"
        ", cv AS (SELECT obj, k, count(*) FILTER (gt_mask = 0 AND score >= lo + (hi - lo) * k / 199.0::DOUBLE)::DOUBLE / count(*) FILTER (gt_mask = 0) AS fpr, coalesce(sum(part) FILTER (gt_mask = 1 AND score >= lo + (hi - lo) * k / 199.0::DOUBLE), 0) / any_value(n_regions) AS pro FROM us JOIN en USING (obj) JOIN gn USING (obj), range(0, 200) t(k) GROUP BY obj, k)"
        ", cl AS (SELECT obj, fpr, pro, coalesce(lag(fpr) OVER o, 0.0) AS x0, coalesce(lag(pro) OVER o, pro) AS y0 FROM cv WHERE fpr <= 0.3 WINDOW o AS (PARTITION BY obj ORDER BY fpr, k))"
        ", ap AS (SELECT obj, greatest(0.0, least(1.0, sum((fpr - x0) * (pro + y0) / 2) / 0.3::DOUBLE)) AS aupro FROM cl GROUP BY obj)"
        ", metrics AS (SELECT obj, round(auroc, 6) AS auroc, round(aupro, 6) AS aupro, round(pixel_auroc, 6) AS pixel_auroc, round(pixel_f1, 6) AS pixel_f1, round(mean_iou, 6) AS mean_iou"
        ", CASE WHEN two THEN round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) END AS cls_accuracy, CASE WHEN two THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 6) END AS cls_precision, CASE WHEN two THEN round(coalesce(tp / nullif(tp + fn, 0), 0), 6) END AS cls_recall, CASE WHEN two THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) END AS cls_f1"
        ", CASE WHEN two THEN tp ELSE 0 END::BIGINT AS cls_tp, CASE WHEN two THEN fp ELSE 0 END::BIGINT AS cls_fp, CASE WHEN two THEN fn ELSE 0 END::BIGINT AS cls_fn, CASE WHEN two THEN tn ELSE 0 END::BIGINT AS cls_tn FROM cf LEFT JOIN ia USING (obj) LEFT JOIN ap USING (obj) LEFT JOIN pa USING (obj) LEFT JOIN iou USING (obj))"
    )


_NINE = ("auroc", "aupro", "pixel_auroc", "pixel_f1", "mean_iou", "cls_accuracy", "cls_precision", "cls_recall", "cls_f1")
_TRUE_PATCHES = ", tp AS (SELECT vec_id, image_id, category, gy AS y, gx AS x, (label >= 8 AND image_id % 2 = 1)::INT AS gt_mask FROM patches), im AS (SELECT image_id, category, max(gt_mask) AS label FROM tp GROUP BY ALL)"


def grid_sql(shots: tuple[int, ...], where: str = "true") -> str:
    """The metrics of few-shot runs of every category and number of shots."""
    most = max(shots)
    return detector(
        _NORMAL + _FG + _TRUE_PATCHES + f", rf AS (SELECT image_id, category, row_number() OVER (PARTITION BY category ORDER BY image_id) AS rank FROM im WHERE label = 0 AND {where} QUALIFY rank <= {most})"
        ", te AS (SELECT im.* FROM im WHERE image_id NOT IN (SELECT image_id FROM rf) AND category IN (SELECT category FROM rf))"
        f", ks AS (SELECT unnest({list(shots)}) AS k)"
        f", dist AS (SELECT q.vec_id, ks.k, {_DIST} AS d FROM n q JOIN te ON te.image_id = q.image_id JOIN n b ON b.category = q.category JOIN rf ON rf.image_id = b.image_id JOIN ks ON rf.rank <= ks.k)"
        ", ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id, k ORDER BY d) AS r FROM dist), near AS (SELECT vec_id, k, avg(d) AS score FROM ranked WHERE r <= 3 GROUP BY ALL)"
        ", map AS (SELECT tp.image_id * 1000 + k AS image_id, te.category, te.label, k, tp.y, tp.x, fg, gt_mask, CASE WHEN fg = 1 THEN score ELSE 0.0 END AS score FROM tp JOIN te USING (image_id) JOIN near USING (vec_id) JOIN fgm USING (vec_id))"
        ", cells AS (SELECT image_id, y, x, score, gt_mask FROM map), fgs AS (SELECT image_id, y, x, fg FROM map)"
        ", runs AS (SELECT image_id, category || '/' || k || '_shot' AS obj, image_score AS score, label FROM " + tail(_MASKED, 0.25) + " JOIN (SELECT DISTINCT image_id, category, k, label FROM map) USING (image_id))"
        + assembly(4, 5) + " SELECT split_part(obj, '/', 1)::INT AS category, split_part(obj, '/', 2) AS method_name, metrics.* EXCLUDE (obj) FROM metrics"
    )


SQL |= {
    "experiment_metrics": recursive(with_tables(
        _FG + ", cells AS (SELECT image_id, y, x, score, gt_mask FROM pixels), fgs AS (SELECT image_id, a::INT AS y, b::INT AS x, fg FROM range(0, 20) s(a), range(0, 20) t(b) JOIN fgm ON y = a * 4 // 20 AND x = b * 5 // 20)"
        ", runs AS (SELECT image_id, CASE WHEN image_id % 12 = 0 THEN 2 ELSE (image_id // 3 % 2)::INT END AS obj, image_score AS score, label FROM " + tail("pixels", 0.01) + " JOIN (SELECT image_id, max(gt_mask) AS label FROM pixels GROUP BY ALL) USING (image_id))"
        + assembly(20, 20) + " SELECT obj AS object, metrics.* EXCLUDE (obj) FROM metrics", "patches", "pixels")),
    "grid_run": grid_sql((1, 2)),
    "grid_run_errors": patches(", i AS (SELECT DISTINCT category, image_id FROM patches), f AS (SELECT category, 'patches' AS stage, CASE category WHEN 1 THEN 'ValueError: vectors with components that are not finite' ELSE 'ValueError: images with vectors of 63 and 64 components' END AS error, CASE category WHEN 1 THEN 1 ELSE (SELECT count(*) FROM i n WHERE n.category = 3) END AS n_images FROM i WHERE image_id IN (6, 13) UNION ALL SELECT category, 'references', 'no image without a defect', count(*) FROM i WHERE category = 4 GROUP BY category) SELECT category, method_name, stage, error, n_images FROM f, (SELECT unnest(['1_shot', '2_shot']) AS method_name)"),
    "run_timings": detector(
        _FG + _TRUE_PATCHES + ", rf AS (SELECT image_id, category FROM im WHERE label = 0 QUALIFY row_number() OVER (PARTITION BY category ORDER BY image_id) <= 2), te AS (SELECT * FROM im WHERE image_id NOT IN (SELECT image_id FROM rf))"
        ", w AS (SELECT te.category, 'masks' AS stage, count(DISTINCT image_id) AS n_images, count(*) AS n_items FROM tp JOIN te USING (image_id) GROUP BY te.category UNION ALL SELECT te.category, 'distances', count(DISTINCT image_id), count(*) FROM fgm JOIN te USING (image_id) WHERE fg = 1 AND te.category IN (SELECT category FROM rf) GROUP BY te.category)"
        " SELECT category, stage, 'workers' AS clock, n_images, n_items, true AS measured, true AS adds_up FROM w UNION ALL SELECT NULL, s, 'driver', (SELECT count(*) FROM te), NULL, true, true FROM (SELECT unnest(['masks', 'distances', 'maps', 'auroc', 'total']) AS s)"),
    "grid_run_survivors": grid_sql((1, 2), "category IN (0, 2)"),
    "single_object_run": grid_sql((2,), "category = 0"),
    "zero_shot_run": detector(
        _LOO + _FG + _TRUE_PATCHES + ", map AS (SELECT tp.image_id, tp.category, im.label, tp.y, tp.x, fg, gt_mask, CASE WHEN fg = 1 THEN loo.score ELSE 0.0 END AS score FROM tp JOIN im USING (image_id) JOIN loo ON loo.vec_id = tp.vec_id JOIN fgm ON fgm.vec_id = tp.vec_id)"
        ", cells AS (SELECT image_id, y, x, score, gt_mask FROM map), fgs AS (SELECT image_id, y, x, fg FROM map)"
        ", runs AS (SELECT image_id, category AS obj, image_score AS score, label FROM " + tail(_MASKED, 0.25) + " JOIN im USING (image_id))"
        + assembly(4, 5) + " SELECT obj AS category, 'zero_shot' AS method_name, metrics.* EXCLUDE (obj) FROM metrics"),
    "summary_table": results((_KNOWN := ", k AS (SELECT object_name, method_name, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in ("auroc", "aupro", "pixel_auroc", "pixel_f1", "mean_iou")) + ", coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0) AS cls_accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS cls_precision, coalesce(tp / nullif(tp + fn, 0), 0) AS cls_recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS cls_f1, tp, fp, fn, tn FROM results)") + " SELECT method_name, round(stddev_pop(auroc), 6) AS std_auroc, round(stddev_pop(aupro), 6) AS std_aupro, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in _NINE) + ", sum(tp)::BIGINT AS total_tp, sum(fp)::BIGINT AS total_fp, sum(fn)::BIGINT AS total_fn, sum(tn)::BIGINT AS total_tn, count(*) AS n_objects FROM k GROUP BY method_name"),
    "summary_with_undefined": results(" SELECT method_name, bool_or(object_name = 'obj03') AS undefined, round(avg(aupro) FILTER (NOT isnan(aupro)), 6) AS mean_aupro FROM results GROUP BY method_name"),
    "per_object_table": results(_KNOWN + " SELECT object_name, method_name, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NINE) + ", tp AS cls_tp, fp AS cls_fp, fn AS cls_fn, tn AS cls_tn FROM k"),
    "method_records": results(" SELECT object_name, round(auroc, 6) AS auroc FROM results WHERE method_name = 'BUILDING'"),
    "object_records": results(" SELECT method_name, round(auroc, 6) AS auroc FROM results WHERE object_name = 'obj07'"),
    "list_objects": results(" SELECT DISTINCT object_name FROM results"),
    "results_to_nested_json": results(", m AS (SELECT object_name, method_name, '\"' || method_name || '\":{\"tp\":' || tp || ',\"fp\":' || fp || ',\"fn\":' || fn || ',\"tn\":' || tn || '}' AS one FROM results) SELECT object_name, '{' || string_agg(one, ',' ORDER BY method_name) || '}' AS record FROM m GROUP BY object_name"),
    "results_scan": with_tables(", ms AS (SELECT 'obj' || lpad((image_id % 25)::VARCHAR, 2, '0') AS object_name, 'BUILDING' AS method_name, image_id // 25 * 20 + y AS nth, sum(score) AS s FROM pixels GROUP BY ALL), mm AS (SELECT object_name, method_name, string_agg('map_' || nth, ',' ORDER BY nth) AS map_names, sum(s) AS total FROM ms GROUP BY ALL) SELECT object_name, method_name, round(auroc, 6) AS auroc, CASE WHEN NOT isnan(aupro) THEN round(aupro, 6) END AS aupro, tp AS cls_tp, 3::BIGINT AS k_neighbors, 1600::BIGINT AS num_features, coalesce(map_names, '') AS map_names, round(coalesce(total, 0.0), 4) AS total FROM results LEFT JOIN mm USING (object_name, method_name)", "results", "pixels"),
    "few_shot_dataset": catalog(", f AS (SELECT * FROM catalog WHERE regexp_matches(name, '[.](png|jpg|jpeg)$')) SELECT category, 'reference' AS role, path, 0 AS label, 0 AS mask_area FROM (SELECT * FROM f WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY category ORDER BY name) <= 8) UNION ALL SELECT category, 'test', path, label, CASE WHEN label = 1 AND left(name, 8)::INT % 3 <> 0 THEN right(left(name, 8), 4)::INT + 1 ELSE 0 END FROM f WHERE split = 'test'"),
}

_SIZES = "(SELECT a::INT AS a, b::INT AS b, n FROM range(0, 20) s(a), range(0, 20) t(b), (SELECT unnest([10, 20]) AS n) WHERE a < n)"
SQL["experiment_metrics_gmm"] = recursive(pixels(
    ", cells AS (SELECT image_id, y, x, score, gt_mask FROM pixels), fgs AS (SELECT image_id, y, x, 1 AS fg FROM pixels)"
    ", runs AS (SELECT image_id, (image_id // 3 % 2)::INT AS obj, image_score AS score, label FROM " + tail("pixels", 0.01) + " JOIN (SELECT image_id, max(gt_mask) AS label FROM pixels GROUP BY ALL) USING (image_id))"
    + assembly(20, 20, mixture(4) + ", seg AS (SELECT image_id, y, x, gt_mask, mask FROM pixels JOIN gmm USING (image_id, y, x))") + " SELECT obj AS object, metrics.* EXCLUDE (obj) FROM metrics"))
SQL["mixed_grid_run"] = recursive(with_tables(
    _LOO + _FG + ", map AS (SELECT fgm.image_id, fgm.vec_id, y, x, fg, CASE WHEN fg = 1 THEN loo.score ELSE 0.0 END AS score FROM fgm JOIN loo USING (vec_id))"
    ", tr AS (SELECT image_id, y, x, gt_mask, CASE WHEN image_id % 2 = 0 THEN 20 ELSE 10 END AS h FROM pixels WHERE image_id % 2 = 0 OR y < 10)"
    + resized("map", "ua", 4, 5, 20, 20, "score") + resized("map", "ub", 4, 5, 10, 20, "score") +
    ", cells AS (SELECT image_id, y, x, u.score, gt_mask FROM tr JOIN (SELECT * FROM ua WHERE image_id % 2 = 0 UNION ALL SELECT * FROM ub WHERE image_id % 2 = 1) u USING (image_id, y, x))"
    f", fgs AS (SELECT image_id, a AS y, b AS x, fg FROM map JOIN {_SIZES} z ON map.y = a * 4 // n AND map.x = b * 5 // 20 AND n = CASE WHEN image_id % 2 = 0 THEN 20 ELSE 10 END)"
    ", runs AS (SELECT image_id, (image_id // 2 % 2)::INT AS obj, image_score AS score, label FROM " + tail(_MASKED, 0.25) + " JOIN (SELECT image_id, max(gt_mask) AS label FROM tr GROUP BY ALL) USING (image_id))"
    + assembly(20, 20, smoothed("map", "sm", 4, 5) + ", rq AS (SELECT sm.image_id, quantile_cont(value, 0.95) AS cut FROM sm JOIN map USING (image_id, y, x) WHERE score <> 0 GROUP BY ALL)"
               ", ms AS (SELECT image_id, map.y, map.x, (score <> 0 AND value > cut)::INT AS mask FROM map JOIN sm USING (image_id, y, x) LEFT JOIN rq USING (image_id))"
               ", seg AS (SELECT tr.image_id, tr.y, tr.x, gt_mask, mask FROM tr JOIN ms ON ms.image_id = tr.image_id AND ms.y = tr.y * 4 // h AND ms.x = tr.x * 5 // 20)")
    + " SELECT obj AS object, metrics.* EXCLUDE (obj) FROM metrics", "patches", "pixels"))


def cubic_axis(n_out: int, n_in: int) -> str:
    """(i, k, w): the weight of place k of an axis in place i of the axis resampled by cubic convolution."""
    scale = f"{n_in / n_out!r}::DOUBLE"
    return (
        f"(SELECT i, k, v / sum(v) OVER (PARTITION BY i) AS w FROM (SELECT i, k, CASE WHEN d < 1 THEN 1.5 * d * d * d - 2.5 * d * d + 1 WHEN d < 2 THEN -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2 ELSE 0 END::DOUBLE AS v"
        f" FROM (SELECT i::INT AS i, k::INT AS k, abs((k + 0.5 - (i + 0.5) * {scale}) / greatest({scale}, 1))::DOUBLE AS d FROM range(0, {n_out}) a(i), range(0, {n_in}) b(k))))"
    )


SQL["image_prep"] = pixels(
    ", p AS (SELECT image_id, y, x, score AS red, score / 2 + x AS green, gt_mask * 255.0::DOUBLE AS blue FROM pixels WHERE y < 14)"
    f", v AS (SELECT image_id, a.i AS y, b.i AS x, sum(a.w * b.w * red) AS red, sum(a.w * b.w * green) AS green, sum(a.w * b.w * blue) AS blue FROM p JOIN {cubic_axis(9, 14)} a ON a.k = y JOIN {cubic_axis(12, 20)} b ON b.k = x WHERE a.i < 8 GROUP BY ALL)"
    " SELECT image_id, 2 AS grid_h, 3 AS grid_w, (y // 4 * 3 + x // 4)::INT AS patch_id, (y % 4)::INT AS y, (x % 4)::INT AS x, round((red / 255 - 0.485) / 0.229, 6) AS red, round((green / 255 - 0.456) / 0.224, 6) AS green, round((blue / 255 - 0.406) / 0.225, 6) AS blue FROM v"
)


def official(of: str, columns: str) -> str:
    """The exact curve's area and the images' AUROC for each value of the key `of`, from the pixels as they are and turned over."""
    return recursive(pixels(
        ", gr(image_id, root, y, x) AS (SELECT image_id, y * 20 + x, y, x FROM pixels WHERE gt_mask = 1 UNION SELECT r.image_id, r.root, q.y, q.x FROM gr r JOIN pixels q ON q.image_id = r.image_id AND q.gt_mask = 1 AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1)"
        ", gg AS (SELECT image_id, y, x, min(root) AS region FROM gr GROUP BY ALL), gs AS (SELECT *, count(*) OVER (PARTITION BY image_id, region) AS n FROM gg)"
        f", ex AS (SELECT {of} AS k, p.*, t.experiment, t.experiment_score AS s FROM pixels p, LATERAL (SELECT 'plain' AS experiment, p.score AS experiment_score UNION ALL SELECT 'turned', -p.score) t)"
        ", v AS (SELECT k, s, sum((gt_mask = 0)::INT) AS ok, sum(CASE WHEN gt_mask = 1 THEN 1.0::DOUBLE / gs.n ELSE 0 END) AS hit FROM ex LEFT JOIN gs USING (image_id, y, x) GROUP BY k, s)"
        ", nr AS (SELECT k, count(*) AS n_regions FROM (SELECT DISTINCT k, image_id, region FROM ex JOIN gs USING (image_id, y, x)) GROUP BY k)"
        ", cu AS (SELECT k, s AS threshold, least(1.0, sum(ok) OVER w / sum(ok) OVER (PARTITION BY k))::DOUBLE AS x, least(1.0, sum(hit) OVER w / n_regions)::DOUBLE AS y FROM v JOIN nr USING (k) WINDOW w AS (PARTITION BY k ORDER BY s DESC) UNION ALL SELECT k, 'infinity'::DOUBLE, 0, 0 FROM nr)"
        ", ar AS (SELECT k, sum(CASE WHEN x > 0.3 THEN (0.3 - x0) * (y0 + y0 + (y - y0) * (0.3 - x0) / (x - x0)) / 2 ELSE (x - x0) * (y + y0) / 2 END) / 0.3 AS au_pro FROM (SELECT k, x, y, lag(x) OVER o AS x0, lag(y) OVER o AS y0 FROM cu WINDOW o AS (PARTITION BY k ORDER BY threshold DESC)) WHERE x0 < 0.3 GROUP BY k)"
        ", im AS (SELECT k, image_id, max(s) AS score, max(gt_mask) AS label FROM ex GROUP BY k, image_id), ks AS (SELECT DISTINCT k FROM im)"
        f", au AS (SELECT a.k, {_PAIRS_AUROC} AS auroc FROM im a JOIN im b ON a.k = b.k AND a.label = 1 AND b.label = 0 GROUP BY a.k)"
        f" SELECT {columns}, round(au_pro, 6) AS au_pro, round(auroc, 6) AS auroc FROM ks LEFT JOIN ar USING (k) LEFT JOIN au USING (k)"
    ))


SQL["multi_experiment"] = official("t.experiment", "k AS experiment")
SQL["object_experiment"] = official("t.experiment || '/' || p.image_id % 7", "split_part(k, '/', 1) AS experiment, split_part(k, '/', 2)::INT AS object")

_TOY = "WITH t AS (SELECT i // 100 AS image_id, (i % 100 // 10)::INT AS y, (i % 10)::INT AS x, ('0x' || left(md5('0/' || i), 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM range(0, 2000) r(i)), toy AS (SELECT *, (y < 3 AND x < 3)::INT AS gt_mask FROM t)"
SQL["toy_dataset"] = _TOY + " SELECT image_id, y, x, round(score, 6) AS score, gt_mask FROM toy"
SQL["toy_curve_areas"] = (
    _TOY + ", s AS (SELECT score, sum(1 - gt_mask) AS ok, sum(gt_mask / 9.0::DOUBLE) AS hit FROM toy GROUP BY score)"
    ", c0 AS (SELECT score AS threshold, (sum(ok) OVER w / (SELECT sum(ok) FROM s))::DOUBLE AS fpr, (sum(hit) OVER w / 20)::DOUBLE AS pro FROM s WINDOW w AS (ORDER BY score DESC) UNION ALL SELECT 'infinity'::DOUBLE, 0, 0)"
    f" SELECT round(area / 0.3, 6) AS au_pro, (SELECT round({_PAIRS_AUROC}, 6) FROM toy a, toy b WHERE a.gt_mask = 1 AND b.gt_mask = 0) AS auroc FROM " + _AREA.format(x="fpr", y="pro", c="c0")
)
