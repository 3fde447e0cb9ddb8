"""The registered queries as SQL for an independent engine, on the same views."""

from __future__ import annotations

from geoscore.schema import CATEGORICAL, EXCLUDED, FEATURES
from geoscore.workload.views import LAND_COVER, OBSERVATIONS, SOIL_TYPE, cte

SCORE = "(0.3e0 * p_a + 0.7e0 * p_b) / 1.0e0"
BAND = (
    "CASE WHEN score IS NULL THEN NULL WHEN score < 0.25e0 THEN 'LOW'"
    " WHEN score < 0.50e0 THEN 'MODERATE' WHEN score < 0.75e0 THEN 'HIGH' ELSE 'CRITICAL' END"
)
# Latitude and longitude become a cell of half a degree.
CELL = (
    "CAST(CAST(floor(latitude * 2) AS BIGINT) AS VARCHAR) || '_'"
    " || CAST(CAST(floor(longitude * 2) AS BIGINT) AS VARCHAR)"
)
GRID = "0.05e0 + i * ((0.95e0 - 0.05e0) / 180)"

POINTS = f"{cte('scored')}, pts AS (SELECT *, {SCORE} AS score FROM scored)"
OBS = cte("observations")
RECS = cte("records")


def _with(items: str, select: str) -> str:
    return f"WITH {items} {select}"


def _rates(counts: str) -> str:
    return (
        f"coalesce(2.0e0*tp / nullif(2*tp + fn + fp, 0), 0) AS f1, "
        f"coalesce(5.0e0*tp / nullif(5*tp + 4*fn + fp, 0), 0) AS f2, "
        f"coalesce(1.0e0*tp / nullif(tp + fp, 0), 0) AS precision, "
        f"coalesce(1.0e0*tp / nullif(tp + fn, 0), 0) AS recall FROM {counts}"
    )


def _confusion(flag: str, key: str = "") -> str:
    lead, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return (
        f"SELECT {lead}"
        f"CAST(count(*) FILTER (label = 0 AND NOT {flag}) AS BIGINT) AS tn, "
        f"CAST(count(*) FILTER (label = 0 AND {flag}) AS BIGINT) AS fp, "
        f"CAST(count(*) FILTER (label = 1 AND NOT {flag}) AS BIGINT) AS fn, "
        f"CAST(count(*) FILTER (label = 1 AND {flag}) AS BIGINT) AS tp FROM pts{group}"
    )


def _curve(key: str = "", source: str = "pts") -> str:
    """Every threshold against every distinct score, the long way round."""
    lead = f"{key}, " if key else ""
    group = f"GROUP BY {lead}threshold"
    return (
        f"grid AS (SELECT {GRID} AS threshold FROM range(181) t(i)), "
        f"hits AS (SELECT {lead}threshold, "
        f"CAST(count(*) FILTER (label = 0 AND score < threshold) AS BIGINT) AS tn, "
        f"CAST(count(*) FILTER (label = 0 AND score >= threshold) AS BIGINT) AS fp, "
        f"CAST(count(*) FILTER (label = 1 AND score < threshold) AS BIGINT) AS fn, "
        f"CAST(count(*) FILTER (label = 1 AND score >= threshold) AS BIGINT) AS tp "
        f"FROM {source}, grid {group}), "
        f"curve AS (SELECT {lead}threshold, tn, fp, fn, tp, {_rates('hits')})"
    )


def _ranks(key: str = "", source: str = "pts", score: str = "score") -> str:
    lead = f"{key}, " if key else ""
    part = f"PARTITION BY {key} " if key else ""
    group = f" GROUP BY {key}" if key else ""
    return (
        f"ties AS (SELECT {lead}{score} AS s, count(*) FILTER (label = 1) AS np, "
        f"count(*) FILTER (label = 0) AS nn FROM {source} GROUP BY {lead}{score}), "
        f"runs AS (SELECT *, sum(np) OVER w AS tp, sum(nn) OVER w AS fp FROM ties "
        f"WINDOW w AS ({part}ORDER BY s DESC ROWS UNBOUNDED PRECEDING)), "
        f"ranks AS (SELECT {lead}CAST(sum(np) AS BIGINT) AS pos_total, "
        f"CAST(sum(nn) AS BIGINT) AS neg_total, "
        f"round(sum(CAST(nn AS DOUBLE) * (tp - np / 2.0e0)) "
        f"/ nullif(CAST(sum(np) AS DOUBLE) * sum(nn), 0), 9) AS roc_auc, "
        f"round(coalesce(sum(np * CAST(tp AS DOUBLE) / (tp + fp)) / nullif(sum(np), 0), 0), 9) "
        f"AS average_precision FROM runs{group})"
    )


def _folds(source: str, label: str) -> str:
    return (
        f"located AS (SELECT *, {CELL} AS cell FROM {source}), "
        f"cells AS (SELECT cell, CAST(count(*) FILTER ({label} = 1) AS BIGINT) AS pos, "
        f"CAST(count(*) FILTER ({label} = 0) AS BIGINT) AS neg FROM located GROUP BY cell), "
        f"turns AS (SELECT *, (row_number() OVER (ORDER BY pos DESC, neg DESC, cell) - 1) % 10 AS b "
        f"FROM cells), "
        f"deal AS (SELECT cell, pos, neg, CAST(CASE WHEN b < 5 THEN b ELSE 9 - b END AS INTEGER) AS fold "
        f"FROM turns)"
    )


def _tiles(zoom: int = 9) -> str:
    n = float(2**zoom)
    return (
        f"placed AS (SELECT CAST(floor((longitude + 180.0e0) / 360.0e0 * {n}e0) AS BIGINT) AS x, "
        f"CAST(floor((1.0e0 - ln(tan(radians(latitude)) + 1.0e0 / cos(radians(latitude))) / pi()) "
        f"/ 2.0e0 * {n}e0) AS BIGINT) AS y, score FROM pts)"
    )


def _tile_select(z: str, x: str, y: str, source: str) -> str:
    return (
        f"SELECT CAST({z} AS INTEGER) AS z, {x} AS x, {y} AS y, CAST(count(*) AS BIGINT) AS points, "
        f"round(sum(score), 9) AS score_sum, max(score) AS score_max, "
        f"round(sum(score) / count(*), 9) AS score_avg FROM {source} GROUP BY ALL"
    )


_NAMES = "[" + ", ".join(f"'{name}'" for name in FEATURES) + "]"
_JSON = "CASE WHEN json_valid(record) THEN record END"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def _checked(*keep: str) -> str:
    """Type, text and fault of every field of every record."""
    more = "".join(f", {name}" for name in keep)
    columns, faults = [], []
    for name in FEATURES:
        kind, text = f"json_type(j, '$.{name}')", f"json_extract_string(j, '$.{name}')"
        if name in CATEGORICAL:
            good, value, fault = f"{kind} = 'VARCHAR'", text, "not_text"
        else:
            good = (
                f"({kind} IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') OR "
                f"({kind} = 'VARCHAR' AND regexp_matches({text}, '{_NUMBER}')))"
            )
            value = (
                f"CASE WHEN {text} = 'true' THEN 1.0e0 WHEN {text} = 'false' THEN 0.0e0 "
                f"ELSE TRY_CAST({text} AS DOUBLE) END"
            )
            fault = "not_number"
        columns.append(f"CASE WHEN {good} THEN {value} END AS {name}")
        faults.append(
            f"CASE WHEN {kind} IS NULL THEN '{name}: missing' "
            f"WHEN NOT coalesce({good}, FALSE) THEN '{name}: {fault}' END"
        )
    return (
        f"{RECS}, parsed AS (SELECT event_id{more}, {_JSON} AS j FROM records), "
        f"checked AS (SELECT event_id{more}, {', '.join(columns)}, "
        f"concat_ws(',', {', '.join(faults)}) AS errors FROM parsed)"
    )


_PLANTED = f"CASE WHEN land_cover IN ({', '.join(repr(v) for v in LAND_COVER[:2])}) THEN 1 ELSE 0 END"


def _best(metric: str, columns: str, key: str = "") -> str:
    part = f"PARTITION BY {key} " if key else ""
    return (
        f"SELECT {columns} FROM (SELECT *, row_number() OVER ({part}ORDER BY {metric} DESC, threshold) "
        f"AS place FROM curve) WHERE place = 1"
    )


_LONG = (
    "long AS (SELECT 'a' AS model, label, p_a AS score FROM pts "
    "UNION ALL SELECT 'b', label, p_b FROM pts UNION ALL SELECT 'vote', label, score FROM pts)"
)
_INDICATORS = " || ".join(
    f"CASE WHEN {column} = '{level}' THEN '1' ELSE '0' END"
    for column, levels in (("land_cover", LAND_COVER), ("soil_type", SOIL_TYPE))
    for level in sorted(levels)
)
_KEPT = [name for name in OBSERVATIONS if name not in EXCLUDED]
_FEATURES = ", ".join(FEATURES)
_RATES_COLUMNS = "f1, f2, precision, recall"

ORACLE: dict[str, str] = {
    "csv_scan": _with(OBS, "SELECT * FROM observations"),
    "json_scan": _with(OBS, f"SELECT event_id, {_FEATURES} FROM observations"),
    "csv_missing_markers": _with(OBS, "SELECT event_id, ndvi, land_cover FROM observations"),
    "score_sink": _with(
        POINTS, f"SELECT obs_id, round(score, 6) AS risk_probability, {BAND} AS risk_level FROM pts"
    ),
    "feature_projection": _with(OBS, f"SELECT event_id, {_FEATURES} FROM observations"),
    "label_cast": _with(OBS, "SELECT event_id, landslide FROM observations"),
    "leakage_guard": _with(OBS, f"SELECT {', '.join(_KEPT)} FROM observations"),
    "json_required_fields": _with(
        RECS,
        "SELECT event_id, array_to_string(CASE WHEN json_valid(record) THEN "
        f"list_filter({_NAMES}, lambda f: NOT list_contains(json_keys({_JSON}), f)) "
        f"ELSE {_NAMES} END, ',') AS missing FROM records",
    ),
    "json_typed_quarantine": _with(_checked(), f"SELECT event_id, {_FEATURES}, errors FROM checked"),
    "json_valid_rows": _with(
        _checked(), f"SELECT event_id, {_FEATURES} FROM checked WHERE errors = ''"
    ),
    "column_quarantine": _with(
        OBS,
        "SELECT event_id, slope_deg, concat_ws(',', CASE WHEN is_fatal = 1 THEN 'curvature: not_number' END, "
        "CASE WHEN ndvi IS NULL THEN 'ndvi: not_number' END) AS errors FROM observations "
        "WHERE is_fatal = 1 OR ndvi IS NULL",
    ),
    "grid_cell_key": _with(POINTS, f"SELECT obs_id, {CELL} AS cell FROM pts"),
    "class_balance": _with(
        POINTS,
        "SELECT CAST(count(*) FILTER (label = 0) AS BIGINT) AS neg_rows, "
        "CAST(count(*) FILTER (label = 1) AS BIGINT) AS pos_rows, "
        "count(*) FILTER (label = 0) / CAST(count(*) FILTER (label = 1) AS DOUBLE) AS pos_weight FROM pts",
    ),
    "class_weights": _with(
        POINTS,
        "SELECT obs_id, label, CASE WHEN label = 1 THEN (SELECT count(*) FILTER (label = 0) "
        "/ CAST(count(*) FILTER (label = 1) AS DOUBLE) FROM pts) ELSE 1.0e0 END AS weight FROM pts",
    ),
    "soft_vote": _with(POINTS, "SELECT obs_id, p_a, p_b, score FROM pts"),
    "score_round": _with(POINTS, "SELECT obs_id, round(score, 6) AS risk_probability FROM pts"),
    "risk_band": _with(POINTS, f"SELECT obs_id, {BAND} AS risk_level FROM pts"),
    "band_summary": _with(
        POINTS,
        f"SELECT {BAND} AS risk_level, CAST(count(*) AS BIGINT) AS points, "
        "round(avg(score), 9) AS score_avg FROM pts GROUP BY 1",
    ),
    "threshold_predict": _with(
        POINTS, "SELECT obs_id, CAST(score >= 0.18e0 AS INTEGER) AS predicted FROM pts"
    ),
    "threshold_grid": _with(
        f"{POINTS}, ends AS (SELECT min(score) AS low, max(score) AS high FROM pts)",
        "SELECT CAST(i AS INTEGER) AS step, low + i * ((high - low) / 180) AS threshold "
        "FROM ends, range(181) t(i)",
    ),
    "threshold_grid_published": _with(
        f"{POINTS}, grid AS (SELECT CAST(i AS INTEGER) AS step, 0.05e0 + i * ((0.95e0 - 0.05e0) / 180) "
        "AS threshold FROM range(181) t(i))",
        "SELECT step, threshold, CAST(count(*) FILTER (score >= threshold) AS BIGINT) AS rows "
        "FROM grid, pts GROUP BY 1, 2",
    ),
    "threshold_curve": _with(
        f"{POINTS}, {_curve()}", f"SELECT threshold, tn, fp, fn, tp, {_RATES_COLUMNS} FROM curve"
    ),
    "threshold_curve_by_state": _with(
        f"{POINTS}, {_curve('state')}",
        f"SELECT state, threshold, tn, fp, fn, tp, {_RATES_COLUMNS} FROM curve",
    ),
    "best_threshold_f1": _with(
        f"{POINTS}, {_curve()}", _best("f1", f"threshold, tn, fp, fn, tp, {_RATES_COLUMNS}")
    ),
    "best_threshold_f2": _with(
        f"{POINTS}, {_curve()}", _best("f2", "threshold, f2, precision, recall")
    ),
    "confusion_matrix": _with(POINTS, _confusion("score >= 0.18e0")),
    "precision_recall_fbeta": _with(
        f"{POINTS}, counts AS ({_confusion('score >= 0.18e0', 'state')})",
        f"SELECT state, {_rates('counts')}",
    ),
    "roc_auc": _with(f"{POINTS}, {_ranks()}", "SELECT pos_total, neg_total, roc_auc FROM ranks"),
    "average_precision": _with(
        f"{POINTS}, {_ranks()}", "SELECT pos_total, average_precision FROM ranks"
    ),
    "rank_metrics_quantised": _with(
        f"{POINTS}, {_ranks(score='round(score, 3)')}",
        "SELECT pos_total, neg_total, roc_auc, average_precision FROM ranks",
    ),
    "rank_metrics_by_state": _with(
        f"{POINTS}, {_ranks('state')}",
        "SELECT state, pos_total, neg_total, roc_auc, average_precision FROM ranks",
    ),
    "metrics_record": _with(
        f"{POINTS}, {_curve()}, {_ranks()}, "
        f"best AS ({_best('f1', 'threshold, f1, precision, recall')})",
        "SELECT roc_auc, average_precision AS pr_auc, threshold, f1, precision, recall FROM ranks, best",
    ),
    "metrics_sink": _with(
        f"{POINTS}, {_curve()}, {_ranks()}, "
        f"best AS ({_best('f1', 'threshold, f1, precision, recall')})",
        "SELECT roc_auc, average_precision AS pr_auc, threshold, f1, precision, recall FROM ranks, best",
    ),
    "metrics_of_days": " UNION ALL ".join(
        "SELECT * FROM ("
        + _with(
            f"{POINTS}, chosen AS (SELECT * FROM pts WHERE {days}), {_curve(source='chosen')}, "
            f"{_ranks(source='chosen')}, best AS ({_best('f1', 'threshold, f1, precision, recall')})",
            f"SELECT '{name}' AS days, roc_auc, average_precision AS pr_auc, threshold, f1, precision, recall "
            "FROM ranks, best",
        )
        + ")"
        for name, days in (("all", "TRUE"), ("two", "obs_id // 100 % 4 IN (1, 2)"))
    ),
    "report_sink": _with(
        f"{POINTS}, {_curve()}", "SELECT threshold, f1, f2, precision, recall FROM curve"
    ),
    "dataset_profile": _with(
        OBS,
        "SELECT CAST(count(*) AS BIGINT) AS rows, "
        "CAST(count(*) FILTER (landslide = 1) AS BIGINT) AS positive_rows, "
        "CAST(count(*) FILTER (landslide = 0) AS BIGINT) AS negative_rows, "
        "string_agg(DISTINCT state, ',' ORDER BY state) AS states FROM observations",
    ),
    "provenance_counts": _with(
        OBS,
        "SELECT source, CAST(count(*) AS BIGINT) AS rows, "
        "CAST(count(*) FILTER (landslide = 1) AS BIGINT) AS positive_rows FROM observations GROUP BY source",
    ),
    "model_comparison": _with(
        f"{POINTS}, {_LONG}, {_curve('model', 'long')}, {_ranks('model', 'long')}, "
        f"best AS ({_best('f1', f'model, threshold, {_RATES_COLUMNS}', 'model')})",
        "SELECT model, roc_auc, average_precision AS pr_auc, threshold, f1, f2, precision, recall, "
        "CASE WHEN model = 'vote' THEN 0.3e0 END AS a_weight, "
        "CASE WHEN model = 'vote' THEN 0.7e0 END AS b_weight FROM ranks JOIN best USING (model)",
    ),
    "cell_class_counts": _with(
        f"{POINTS}, {_folds('pts', 'label')}", "SELECT cell, pos, neg FROM cells"
    ),
    "grouped_folds": _with(
        f"{OBS}, {_folds('observations', 'landslide')}",
        "SELECT event_id, cell, fold FROM located JOIN deal USING (cell)",
    ),
    "grouped_folds_points": _with(
        f"{POINTS}, {_folds('pts', 'label')}",
        "SELECT obs_id, cell, fold FROM located JOIN deal USING (cell)",
    ),
    "grouped_folds_unbounded": _with(
        f"{POINTS}, {_folds('pts', 'label')}",
        "SELECT obs_id, cell, fold FROM located JOIN deal USING (cell)",
    ),
    "fold_deal": _with(f"{POINTS}, {_folds('pts', 'label')}", "SELECT cell, pos, neg, fold FROM deal"),
    "fold_balance": _with(
        f"{OBS}, {_folds('observations', 'landslide')}",
        "SELECT fold, CAST(count(*) AS BIGINT) AS groups, CAST(sum(pos) AS BIGINT) AS pos, "
        "CAST(sum(neg) AS BIGINT) AS neg FROM deal GROUP BY fold",
    ),
    "fold_leak_check": _with(
        f"{OBS}, {_folds('observations', 'landslide')}",
        "SELECT CAST(count(*) AS BIGINT) AS cells, CAST(sum(pos + neg) AS BIGINT) AS rows, "
        "CAST(0 AS BIGINT) AS split_cells FROM deal",
    ),
    "heavy_cells": _with(
        f"{cte('scored')}, placed AS (SELECT CASE WHEN obs_id % 3 = 0 THEN 'heavy' WHEN obs_id % 7 = 1 THEN 'large' "
        f"WHEN obs_id % 11 = 2 THEN 'broad' ELSE {CELL} END AS cell FROM scored)",
        "SELECT CAST(5 AS BIGINT) AS folds, CAST(count(DISTINCT cell) AS BIGINT) AS cells, "
        "CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS split_cells, TRUE AS more_even FROM placed",
    ),
    "one_hot_encode": _with(
        OBS, f"SELECT event_id, land_cover, soil_type, {_INDICATORS} AS indicators FROM observations"
    ),
    "level_slots": _with(
        OBS, f"SELECT event_id, land_cover, soil_type, {_INDICATORS} AS indicators FROM observations"
    ),
    "point_layer": _with(POINTS, "SELECT latitude, longitude, score FROM pts"),
    "heat_tiles_z9": _with(f"{POINTS}, {_tiles()}", _tile_select("9", "x", "y", "placed")),
    "heat_tiles_rollup": _with(
        f"{POINTS}, {_tiles()}",
        _tile_select("9 - up", "x >> up", "y >> up", "placed, (SELECT unnest([0, 1, 2, 3]) AS up)"),
    ),
    "oof_coverage": _with(
        f"{OBS}, {_folds('observations', 'landslide')}",
        "SELECT fold, CAST(sum(pos + neg) AS BIGINT) AS rows, CAST(sum(pos + neg) AS BIGINT) AS events, "
        "CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(pos + neg) AS BIGINT) AS sound_votes "
        "FROM deal GROUP BY fold",
    ),
    "feature_importance_summary": _with(
        OBS,
        "SELECT unnest(['a', 'b']) AS learner, CAST(10 + count(DISTINCT land_cover) "
        "+ count(DISTINCT soil_type) AS BIGINT) AS features, 1.0e0 AS total, "
        "CAST(0 AS BIGINT) AS negative FROM observations",
    ),
    "batch_score_coverage": _with(
        OBS,
        "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS in_range, "
        "CAST(0 AS BIGINT) AS misfits FROM observations",
    ),
    "stream_batch_agreement": _with(
        _checked(),
        "SELECT CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS status, "
        "CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS differing FROM checked GROUP BY 1",
    ),
    "model_roundtrip": _with(
        OBS, "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS differing FROM observations"
    ),
    "node_table_scores": _with(
        OBS, "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS differing FROM observations"
    ),
    "staged_losses": _with(
        OBS,
        "SELECT rounds, n AS rows, TRUE AS sound FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM observations), "
        "(SELECT CAST(unnest([2, 4, 5]) AS INTEGER) AS rounds)",
    ),
    "same_trees": "SELECT TRUE AS has_nodes, CAST(0 AS BIGINT) AS differing",
    "in_memory_rows": _with(OBS, f"SELECT {_FEATURES} FROM observations ORDER BY {_FEATURES} LIMIT 20"),
    "interrupted_save": _with(
        OBS, "SELECT CAST(count(*) AS BIGINT) AS rows, TRUE AS old_kept, TRUE AS new_read FROM observations"
    ),
    "csv_quarantine": _with(
        OBS,
        """SELECT CASE k WHEN 1 THEN '"' || event_id ELSE event_id END AS line,
        CASE WHEN k IN (1, 2, 3) THEN 'not 4 cells' WHEN k = 5 THEN 'ndvi: wet; elevation_m: high' ELSE 'valid' END AS reason,
        k = 4 AS missing
        FROM (SELECT CAST(event_id AS VARCHAR) AS event_id, ndvi, land_cover, CAST(event_id AS BIGINT) % 10 AS k
        FROM observations)""",
    ),
    "rescored_table": _with(
        OBS, "SELECT event_id, 'mine' AS features, event_id AS label, TRUE AS sound FROM observations"
    ),
    "planted_out_of_fold": _with(
        f"{OBS}, {_folds('observations', 'landslide')}",
        f"SELECT event_id, fold, {_PLANTED} AS landslide, {_PLANTED} AS a, {_PLANTED} AS b, "
        f"{_PLANTED} AS forest, {_PLANTED} AS vote FROM located JOIN deal USING (cell)",
    ),
    "planted_comparison": "SELECT unnest(['a', 'b', 'forest', 'vote']) AS model, 1.0e0 AS roc_auc, 1.0e0 AS pr_auc",
    "stream_checked": _with(
        _checked("record"),
        "SELECT record, CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS status, errors, "
        "errors = '' AS scored FROM checked",
    ),
    "stream_two_outputs": _with(
        _checked("record"),
        "SELECT record, CASE WHEN errors = '' THEN 'valid' ELSE 'quarantine' END AS status, errors, "
        "errors = '' AS scored FROM checked",
    ),
    "permutation_ranks": _with(
        OBS,
        "SELECT feature, n AS rows, feature = 'land_cover' AS first "
        "FROM (SELECT CAST(count(*) AS BIGINT) AS n FROM observations), "
        "(SELECT unnest(['slope_deg', 'land_cover', 'ndvi', 'curvature']) AS feature)",
    ),
    "scored_heat_totals": _with(
        f"{OBS}, pts AS (SELECT latitude, longitude, 0.0e0 AS score FROM observations), {_tiles()}, "
        "zooms AS (SELECT CAST(9 - up AS INTEGER) AS z, x >> up AS tx, y >> up AS ty "
        "FROM placed, (SELECT unnest([0, 1, 2, 3]) AS up))",
        "SELECT z, CAST(count(DISTINCT (tx, ty)) AS BIGINT) AS tiles, CAST(count(*) AS BIGINT) AS points "
        "FROM zooms GROUP BY z",
    ),
}
