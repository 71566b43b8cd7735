"""Ranking, evaluation and bootstrap queries over a scored fleet.

The scored fleet has one row per customer and order quarter, with a score, a calibrated
probability, a label and the days to the next event derived from the orders.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs
from tidemark.operators import metrics as m
from tidemark.plans.registry import query, round_sql, rounded

_BASE = {
    "lo": "min(o_totalprice)", "k": "max(o_orderkey)", "n": "count(*)",
}
_COLUMNS = {
    "raw_score": "floor(lo / 500) / 1000e0",
    "calibrated_probability": "(floor(lo / 500) / 1000e0) * (floor(lo / 500) / 1000e0) * 0.9e0 + 0.01e0",
    "true_label": "case when k % 10 < 1 + 6 * (floor(lo / 500) / 1000e0) then 1 else 0 end",
    "days_to_event": "case when k % 10 < 1 + 6 * (floor(lo / 500) / 1000e0) then k % 90 when k % 3 = 0 then null else 90 + k % 300 end",
    "fold": "case when year(anchor_date) < 1998 then 'F1' when year(anchor_date) < 2000 then 'F2' else 'F3' end",
    "anchor_id": "cast(anchor_date as string)",
    "split": "case when machine_key % 3 = 0 then 'validation' else 'test' end",
}
SCORED_SQL = f"""SELECT machine_key, anchor_date, {', '.join(f'{e} AS {n}' for n, e in _COLUMNS.items())} FROM (
SELECT o_custkey AS machine_key, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS anchor_date, {', '.join(f'{e} AS {n}' for n, e in _BASE.items())} FROM orders GROUP BY 1, 2) AS g"""


def scored(t):
    base = t("orders").groupBy(
        F.col("o_custkey").alias("machine_key"), F.trunc(F.to_date("o_orderdate"), "quarter").alias("anchor_date")
    ).agg(*[F.expr(e).alias(n) for n, e in _BASE.items()])
    return base.selectExpr("machine_key", "anchor_date", *[f"{e} as {n}" for n, e in _COLUMNS.items()])


RANKED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY raw_score DESC, machine_key) AS rank_within_anchor,
 count(*) OVER (PARTITION BY anchor_id) AS eligible_machines_at_anchor FROM ({SCORED_SQL}) AS s"""


def ranked(t, **kw):
    return m.ranked_fleet(scored(t), ["anchor_id"], "raw_score", **kw)


@query(
    "ranked_fleet", "W1 W2 W3 W4",
    round_sql(f"""SELECT *, rank_within_anchor / eligible_machines_at_anchor AS score_top_fraction,
 100.0 * (eligible_machines_at_anchor - rank_within_anchor) / greatest(eligible_machines_at_anchor - 1, 1) AS rank_scale_0_100,
 CAST(least(floor((rank_within_anchor - 1) * 10.0 / eligible_machines_at_anchor) + 1, 10) AS INT) AS score_decile_from_top,
 CAST(rank_within_anchor <= greatest(ceil(eligible_machines_at_anchor * CAST(0.01 AS DOUBLE)), 1) AS INT) AS selected_top_1pct,
 CAST(rank_within_anchor <= greatest(ceil(eligible_machines_at_anchor * CAST(0.1 AS DOUBLE)), 1) AS INT) AS selected_top_10pct,
 CAST(rank_within_anchor <= 25 AS INT) AS selected_top_n_25 FROM ({RANKED_SQL}) AS r""",
              ["machine_key", "anchor_id", "rank_within_anchor", "eligible_machines_at_anchor", "score_decile_from_top",
               "selected_top_1pct", "selected_top_10pct", "selected_top_n_25"], ["score_top_fraction", "rank_scale_0_100"]),
)
def _(t):
    out = ranked(t, rates=(0.01, 0.10), counts=(25,))
    return rounded(out.drop("anchor_date", "raw_score", "calibrated_probability", "true_label", "days_to_event", "fold", "split"))


_AUC_SQL = """SELECT {g}, max(all_n) AS rows, max(all_p) AS positive_count, max(all_p) / max(all_n) AS positive_rate,
 CASE WHEN max(all_p) BETWEEN 1 AND max(all_n) - 1 THEN sum((n - p) * (tp - p / 2)) / (max(all_p) * (max(all_n) - max(all_p))) END AS roc_auc,
 CASE WHEN max(all_p) BETWEEN 1 AND max(all_n) - 1 THEN sum(p * tp / seen) / max(all_p) END AS average_precision FROM (
SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER (PARTITION BY {g}) AS all_p, sum(n) OVER (PARTITION BY {g}) AS all_n FROM (
 SELECT {g}, {s} AS sc, sum({wt} * {y}) AS p, sum({wt}) AS n FROM ({src}) AS x GROUP BY {g}, {s}) AS c WINDOW w AS (PARTITION BY {g} ORDER BY sc DESC)) AS z GROUP BY {g}"""


def auc_sql(src: str, g: str, s: str = "raw_score", y: str = "true_label", wt: str = "1") -> str:
    return _AUC_SQL.format(g=g, s=s, y=y, wt=wt, src=src)


@query(
    "auc_and_average_precision", "M1 W8",
    round_sql(auc_sql(SCORED_SQL, "anchor_id"), ["anchor_id", "CAST(rows AS BIGINT) AS rows", "CAST(positive_count AS BIGINT) AS positive_count"],
              ["positive_rate", "roc_auc", "average_precision"]),
)
def _(t):
    return rounded(m.auc_ap(scored(t), ["anchor_id"], "raw_score", "true_label"))


def _confusion(where: str) -> str:
    return f"""count(*) FILTER (WHERE {where} AND true_label = 1) AS tp, count(*) FILTER (WHERE {where} AND true_label = 0) AS fp,
 count(*) FILTER (WHERE NOT ({where}) AND true_label = 1) AS fn, count(*) FILTER (WHERE NOT ({where}) AND true_label = 0) AS tn"""


_RATES = """coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fn + fp, 0), 0) AS f1,
 coalesce(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 0) AS f2, coalesce((tp + fp) / nullif(tp + fp + fn + tn, 0), 0) AS flagged_rate"""
_RATE_NAMES = ["precision", "recall", "f1", "f2", "flagged_rate"]


@query(
    "threshold_metrics", "M2",
    round_sql(f"""SELECT anchor_id, tp + fp + fn + tn AS rows, tp + fn AS positive_count, tp AS true_positive, fp AS false_positive, tn AS true_negative, fn AS false_negative, tp + fp AS flagged_count, {_RATES}
FROM (SELECT anchor_id, {_confusion('calibrated_probability >= 0.5')} FROM ({SCORED_SQL}) AS s GROUP BY 1) AS c""",
              ["anchor_id", "rows", "positive_count", "true_positive", "false_positive", "true_negative", "false_negative", "flagged_count"], _RATE_NAMES),
)
def _(t):
    return rounded(m.threshold_metrics(scored(t), ["anchor_id"], "calibrated_probability", "true_label", 0.5))


_RULES = m.selections((0.01, 0.05, 0.10), (5, 25, 1000))
_RULE_VALUES = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in _RULES)
_MEMBERS_SQL = f"""SELECT r.*, q.selection_type, q.selection_value, rank_within_anchor <= CASE WHEN selection_type = 'top_k_fraction'
 THEN greatest(ceil(eligible_machines_at_anchor * selection_value), 1) ELSE least(selection_value, eligible_machines_at_anchor) END AS inside
FROM ({RANKED_SQL}) AS r, (VALUES {_RULE_VALUES}) AS q(selection_type, selection_value)"""
_SELECTION_SQL = f"""SELECT *, selected_machines - true_positive_machines AS false_positive_machines, true_positive_machines / selected_machines AS precision,
 true_positive_machines / nullif(positive_machines, 0) AS recall, positive_machines / eligible_machines AS fleet_positive_rate,
 (true_positive_machines / selected_machines) / nullif(positive_machines / eligible_machines, 0) AS lift_vs_fleet FROM (
SELECT fold, anchor_id, selection_type, selection_value, count(*) AS eligible_machines, sum(true_label) AS positive_machines, count(*) FILTER (WHERE inside) AS selected_machines,
 coalesce(sum(true_label) FILTER (WHERE inside), 0) AS true_positive_machines, min(raw_score) FILTER (WHERE inside) AS minimum_score_selected,
 avg(calibrated_probability) FILTER (WHERE inside) AS mean_calibrated_probability_selected, quantile_cont(calibrated_probability, 0.5) FILTER (WHERE inside) AS median_calibrated_probability_selected,
 quantile_cont(days_to_event, 0.5) FILTER (WHERE inside AND true_label = 1) AS median_days_to_failure_selected_positives FROM ({_MEMBERS_SQL}) AS x GROUP BY 1, 2, 3, 4) AS y"""
_WZ = "1.959963984540054"


def wilson_sql(p: str, n: str, low: str, high: str) -> str:
    c = f"({p} / {n} + {_WZ} * {_WZ} / (2.0 * {n}))"
    mg = f"{_WZ} * sqrt({p} / {n} * (1 - {p} / {n}) / {n} + {_WZ} * {_WZ} / (4.0 * {n} * {n}))"
    d = f"(1 + {_WZ} * {_WZ} / {n})"
    return (f"CASE WHEN {n} > 0 THEN greatest(0, ({c} - {mg}) / {d}) END AS {low}, "
            f"CASE WHEN {n} > 0 THEN least(1, ({c} + {mg}) / {d}) END AS {high}")


_SEL_EXACT = ["fold", "anchor_id", "selection_type", "selection_value", "eligible_machines", "CAST(positive_machines AS BIGINT) AS positive_machines", "selected_machines",
              "CAST(true_positive_machines AS BIGINT) AS true_positive_machines", "CAST(false_positive_machines AS BIGINT) AS false_positive_machines"]
_SEL_DOUBLE = ["precision", "recall", "fleet_positive_rate", "lift_vs_fleet", "minimum_score_selected"]


@query("top_selections", "M3 M4", round_sql(_SELECTION_SQL, _SEL_EXACT, _SEL_DOUBLE))
def _(t):
    return rounded(m.selection_metrics(ranked(t), ["fold", "anchor_id"], _RULES, "true_label", "raw_score"))


@query(
    "anchor_selection_rows", "M11 M7",
    round_sql(f"""SELECT *, {wilson_sql('true_positive_machines', 'selected_machines', 'precision_ci95_low', 'precision_ci95_high')},
 {wilson_sql('true_positive_machines', 'positive_machines', 'recall_ci95_low', 'recall_ci95_high')} FROM ({_SELECTION_SQL}) AS w""",
              _SEL_EXACT, [*_SEL_DOUBLE, "mean_calibrated_probability_selected", "median_calibrated_probability_selected",
                           "median_days_to_failure_selected_positives", "precision_ci95_low", "precision_ci95_high", "recall_ci95_low", "recall_ci95_high"]),
)
def _(t):
    return rounded(m.anchor_selection_rows(
        ranked(t), ["fold", "anchor_id"], _RULES, "true_label", "raw_score", "calibrated_probability", "days_to_event"
    ))


_LOSS = "-(true_label * ln(least(greatest(calibrated_probability, 1e-15), 1 - 1e-15)) + (1 - true_label) * ln(1 - least(greatest(calibrated_probability, 1e-15), 1 - 1e-15)))"


@query(
    "anchor_evaluation", "M11",
    round_sql(f"""SELECT a.*, a.rows - a.positive_count AS negative_count, q.brier_score, q.log_loss, q.mean_calibrated_probability, t.* EXCLUDE (anchor_id) FROM ({auc_sql(SCORED_SQL, 'anchor_id')}) AS a
JOIN (SELECT anchor_id, avg((calibrated_probability - true_label) ** 2) AS brier_score, avg({_LOSS}) AS log_loss, avg(calibrated_probability) AS mean_calibrated_probability FROM ({SCORED_SQL}) AS s GROUP BY 1) AS q USING (anchor_id)
JOIN (SELECT anchor_id, tp + fp AS threshold_flagged_machines, {_RATES.replace(' AS ', ' AS threshold_')} FROM (SELECT anchor_id, {_confusion('calibrated_probability >= 0.4')} FROM ({SCORED_SQL}) AS s GROUP BY 1) AS c) AS t USING (anchor_id)""",
              ["anchor_id", "CAST(rows AS BIGINT) AS rows", "CAST(positive_count AS BIGINT) AS positive_count", "CAST(negative_count AS BIGINT) AS negative_count", "threshold_flagged_machines"],
              ["positive_rate", "roc_auc", "average_precision", "brier_score", "log_loss", "mean_calibrated_probability", *[f"threshold_{r}" for r in _RATE_NAMES]]),
)
def _(t):
    return rounded(m.anchor_evaluation(scored(t), ["anchor_id"], "raw_score", "calibrated_probability", "true_label", 0.4))


_POOLED_SQL = f"""SELECT *, {wilson_sql('total_true_positive', 'total_selected', 'micro_precision_ci95_low', 'micro_precision_ci95_high')}, total_true_positive / total_selected AS micro_precision,
 total_true_positive / nullif(total_positive, 0) AS micro_recall, total_positive / total_eligible AS natural_positive_rate, (total_true_positive / total_selected) / nullif(total_positive / total_eligible, 0) AS micro_lift_vs_fleet FROM (
SELECT fold, selection_type, selection_value, count(DISTINCT anchor_id) AS anchor_count, sum(eligible_machines) AS total_eligible, sum(positive_machines) AS total_positive, sum(selected_machines) AS total_selected,
 sum(true_positive_machines) AS total_true_positive, avg(precision) AS mean_anchor_precision, quantile_cont(precision, 0.5) AS median_anchor_precision, min(precision) AS minimum_anchor_precision,
 max(precision) AS maximum_anchor_precision, coalesce(stddev_samp(precision), 0) AS std_anchor_precision, avg(recall) AS mean_anchor_recall, avg(lift_vs_fleet) AS mean_anchor_lift
FROM ({_SELECTION_SQL}) AS s GROUP BY 1, 2, 3) AS p"""


@query(
    "pooled_selections", "M12",
    round_sql(_POOLED_SQL, ["fold", "selection_type", "selection_value", "anchor_count", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("total_eligible", "total_positive", "total_selected", "total_true_positive")]],
              ["mean_anchor_precision", "median_anchor_precision", "minimum_anchor_precision", "maximum_anchor_precision", "std_anchor_precision", "mean_anchor_recall", "mean_anchor_lift",
               "micro_precision", "micro_precision_ci95_low", "micro_precision_ci95_high", "micro_recall", "natural_positive_rate", "micro_lift_vs_fleet"]),
)
def _(t):
    rows = m.selection_metrics(ranked(t), ["fold", "anchor_id"], _RULES, "true_label", "raw_score")
    return rounded(m.pooled_selection(rows, ["fold", "selection_type", "selection_value"]))


def _decile_sql(name: str, expr: str, src: str) -> str:
    return round_sql(f"""SELECT *, positive_rate / nullif(overall_rate, 0) AS lift FROM (SELECT *, sum(positive_rows) OVER (PARTITION BY fold) / sum(rows) OVER (PARTITION BY fold) AS overall_rate FROM (
SELECT fold, {expr} AS {name}, count(*) AS rows, sum(true_label) AS positive_rows, avg(true_label) AS positive_rate, min(raw_score) AS min_score, max(raw_score) AS max_score FROM ({src}) AS r GROUP BY 1, 2) AS g) AS h""",
                     ["fold", name, "rows", "CAST(positive_rows AS BIGINT) AS positive_rows"], ["positive_rate", "overall_rate", "lift", "min_score", "max_score"])


@query(
    "decile_table", "M10 W4",
    _decile_sql("score_decile_from_top", "CAST(least(floor((rn - 1) * 10.0 / n) + 1, 10) AS INT)",
                f"SELECT *, row_number() OVER (PARTITION BY fold ORDER BY raw_score DESC, anchor_id, machine_key) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM ({SCORED_SQL}) AS s"),
)
def _(t):
    from tidemark.operators.ordering import rank_within

    rows = rank_within(scored(t), ["fold"], "raw_score", ["anchor_id", "machine_key"], "r", "n")
    return rounded(m.decile_table(rows, ["fold"], "true_label", "raw_score", "r", "n"))


@query(
    "risk_decile_table", "M10 W9",
    _decile_sql("risk_decile", "CAST(least(greatest(ceil(rn / n * 10.0), 1), 10) AS INT)",
                f"SELECT *, row_number() OVER (PARTITION BY fold ORDER BY raw_score, k2) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM (SELECT *, anchor_id || '-' || cast(machine_key as string) AS k2 FROM ({SCORED_SQL}) AS s) AS u"),
)
def _(t):
    rows = scored(t).withColumn("k2", F.concat_ws("-", "anchor_id", "machine_key"))
    return rounded(m.risk_decile_table(rows, ["fold"], "raw_score", "true_label", "k2"))


# ------------------------------------------------------------------ calibration and thresholds
_EDGES = m.bin_edges(10)
_BIN = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INT)" for e in _EDGES[1:-1])
_EDGE_VALUES = ", ".join(f"({i + 1}, {_EDGES[i]!r}::DOUBLE, {_EDGES[i + 1]!r}::DOUBLE)" for i in range(10))
_BINS_SQL = f"""SELECT f.fold, e.bin_number, e.bin_lower, e.bin_upper, coalesce(b.rows, 0) AS rows, b.mp AS mean_probability, b.mr AS observed_positive_rate, abs(b.mp - b.mr) AS absolute_calibration_gap
FROM (SELECT DISTINCT fold FROM ({SCORED_SQL}) AS s) AS f CROSS JOIN (VALUES {_EDGE_VALUES}) AS e(bin_number, bin_lower, bin_upper)
LEFT JOIN (SELECT fold, 1 + {_BIN} AS bin_number, count(*) AS rows, avg(p) AS mp, avg(true_label) AS mr FROM (SELECT *, calibrated_probability AS p FROM ({SCORED_SQL}) AS s) AS q GROUP BY 1, 2) AS b USING (fold, bin_number)"""


@query("calibration_bins", "M8", round_sql(_BINS_SQL, ["fold", "bin_number", "rows"], ["bin_lower", "bin_upper", "mean_probability", "observed_positive_rate", "absolute_calibration_gap"]))
def _(t):
    return rounded(m.calibration_bins(scored(t), ["fold"], "true_label", "calibrated_probability"))


@query(
    "calibration_quality", "M8",
    round_sql(f"""SELECT q.*, e.ece FROM (SELECT fold, count(*) AS rows, avg((calibrated_probability - true_label) ** 2) AS brier, avg({_LOSS}) AS log_loss, avg(calibrated_probability) AS mean_probability,
 avg(true_label) AS observed_positive_rate FROM ({SCORED_SQL}) AS s GROUP BY 1) AS q JOIN (SELECT fold, sum(rows * absolute_calibration_gap) / sum(rows) AS ece FROM ({_BINS_SQL}) AS b GROUP BY 1) AS e USING (fold)""",
              ["fold", "rows"], ["brier", "log_loss", "mean_probability", "observed_positive_rate", "ece"]),
)
def _(t):
    return rounded(m.calibration_quality(scored(t), ["fold"], "true_label", "calibrated_probability"))


_GRID = 41
_CAND_SQL = f"""SELECT DISTINCT fold, round(t, 11) AS threshold FROM (SELECT fold, unnest(quantile_cont(calibrated_probability, [{', '.join(repr(i / (_GRID - 1)) for i in range(_GRID))}])) AS t FROM ({SCORED_SQL}) AS s GROUP BY 1
 UNION ALL SELECT DISTINCT fold, unnest([0.0, 1.0]) FROM ({SCORED_SQL}) AS s) AS c"""
_CURVE_SQL = f"""SELECT fold, threshold, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, tp + fp AS flagged_rows, {_RATES} FROM (
SELECT c.fold, c.threshold, {_confusion('s.calibrated_probability >= c.threshold')} FROM ({_CAND_SQL}) AS c JOIN ({SCORED_SQL}) AS s ON s.fold = c.fold GROUP BY 1, 2) AS x"""
_CURVE_EXACT = ["fold", "true_positive", "false_positive", "false_negative", "true_negative", "flagged_rows"]


def _candidates(t):
    # rounding keeps both engines on the same interpolated candidate values
    return m.candidate_thresholds(scored(t), ["fold"], "calibrated_probability", _GRID).select(
        "fold", F.round("threshold", 11).alias("threshold")
    ).distinct()


@query("threshold_curve", "M9", round_sql(_CURVE_SQL, _CURVE_EXACT, ["threshold", *_RATE_NAMES], 11))
def _(t):
    return rounded(m.threshold_curve(scored(t), ["fold"], "calibrated_probability", "true_label", _candidates(t)), 11)


@query(
    "operating_threshold", "M9",
    round_sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, precision DESC, recall DESC, threshold DESC) AS rn FROM ({_CURVE_SQL}) AS c) AS d WHERE rn = 1",
              _CURVE_EXACT, ["threshold", *_RATE_NAMES], 11),
)
def _(t):
    curve = m.threshold_curve(scored(t), ["fold"], "calibrated_probability", "true_label", _candidates(t))
    return rounded(m.best_threshold(curve, ["fold"], "f1"), 11)


@query(
    "capped_threshold", "M9",
    round_sql(f"""SELECT *, TRUE AS within_max_flagged_rate FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY f2 DESC, recall DESC, precision DESC, flagged_rate, threshold) AS rn FROM (
SELECT fold, threshold, tp AS true_positive, fp AS false_positive, fn AS false_negative, tn AS true_negative, tp + fp AS flagged_rows, {_RATES} FROM (
 SELECT s.fold, g.i / 50e0 AS threshold, {_confusion('s.calibrated_probability >= g.i / 50e0')} FROM ({SCORED_SQL}) AS s, range(51) AS g(i) GROUP BY 1, 2) AS x) AS c WHERE flagged_rate <= 0.2) AS d WHERE rn = 1""",
              [*_CURVE_EXACT, "within_max_flagged_rate"], ["threshold", *_RATE_NAMES]),
)
def _(t):
    rows = scored(t)
    steps = m.uniform_thresholds(rows, ["fold"], 0.0, 1.0, 51).withColumn("threshold", F.round(F.col("threshold") * 50) / 50)
    curve = m.threshold_curve(rows, ["fold"], "calibrated_probability", "true_label", steps)
    return rounded(m.best_capped_threshold(curve, ["fold"], 0.2))


_TARGETS = (0.01, 0.05, 0.10)
_FPR_SQL = f"""SELECT fold, t AS target_max_negative_fpr, min(v) FILTER (WHERE seen / alln <= t + 1e-12) AS threshold, max(v) AS largest_negative_score,
 CAST(min(v) FILTER (WHERE seen / alln <= t + 1e-12) IS NULL AS INT) AS above_all FROM (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY v DESC) AS seen, sum(n) OVER (PARTITION BY fold) AS alln FROM (
 SELECT fold, raw_score AS v, count(*) AS n FROM ({SCORED_SQL}) AS s WHERE true_label = 0 {{w}} GROUP BY 1, 2) AS c) AS d, (VALUES (0.01::DOUBLE), (0.05::DOUBLE), (0.1::DOUBLE)) AS q(t) GROUP BY 1, 2"""


@query("max_fpr_thresholds", "M21", round_sql(_FPR_SQL.format(w=""), ["fold", "target_max_negative_fpr", "above_all"], ["threshold", "largest_negative_score"]))
def _(t):
    return rounded(m.max_fpr_threshold(scored(t).where("true_label = 0"), ["fold"], "raw_score", _TARGETS))


_SEP = """count(*) FILTER (WHERE true_label = 1) AS positive_rows, count(*) FILTER (WHERE true_label = 0) AS negative_rows,
 count(*) FILTER (WHERE true_label = 1 AND raw_score >= threshold) AS captured_positive_rows, count(*) FILTER (WHERE true_label = 0 AND raw_score >= threshold) AS false_positive_rows"""
_SEP_RATES = """captured_positive_rows / nullif(positive_rows, 0) AS tpr, false_positive_rows / nullif(negative_rows, 0) AS fpr, captured_positive_rows / nullif(captured_positive_rows + false_positive_rows, 0) AS sample_precision"""
_SEP_MORE = "*, tpr / nullif(fpr, 0) AS likelihood_ratio, " + ", ".join(
    f"{p} * tpr / nullif({p} * tpr + {1 - p} * fpr, 0) AS precision_at_prevalence_{str(p).replace('.', 'p')}" for p in (0.01, 0.05))
_SEP_DOUBLE = ["threshold", "tpr", "fpr", "sample_precision", "likelihood_ratio", "precision_at_prevalence_0p01", "precision_at_prevalence_0p05"]


@query(
    "validation_thresholds", "M21",
    round_sql(f"""SELECT {_SEP_MORE} FROM (SELECT *, {_SEP_RATES} FROM (SELECT f.fold, f.target_max_negative_fpr, f.threshold, s.split, {_SEP}
FROM ({_FPR_SQL.format(w="AND split = 'validation'")}) AS f JOIN ({SCORED_SQL}) AS s ON s.fold = f.fold WHERE f.threshold IS NOT NULL GROUP BY 1, 2, 3, 4) AS a) AS b""",
              ["fold", "target_max_negative_fpr", "split", "positive_rows", "negative_rows", "captured_positive_rows", "false_positive_rows"], _SEP_DOUBLE),
)
def _(t):
    return rounded(m.validation_thresholds_on_splits(scored(t), ["fold"], "raw_score", "true_label", _TARGETS))


# ------------------------------------------------------------------ bootstrap
#: Replicates of every bootstrap.
_B = 1000
_HASH = "('0x' || substr(md5({text}), 1, 16))::UBIGINT"


def _keyed(t):
    return scored(t).withColumn("k2", F.concat_ws("-", "anchor_id", "machine_key"))


@query("ranking_bootstrap", "M5 B18")
def _(t):
    return rounded(bs.ranking_intervals(
        _keyed(t), "raw_score", "true_label", "k2", _B, rates=(0.1,), counts=(50,)
    ), 8)


_ANCHOR_ROWS_SQL = f"SELECT * FROM ({_SELECTION_SQL}) AS s WHERE selection_type = 'top_n' AND selection_value = 25"


def _anchor_rows(t):
    rows = m.selection_metrics(ranked(t), ["fold", "anchor_id"], m.selections(counts=(25,)), "true_label", "raw_score")
    return rows


def _anchor_boot_sql(tag: str, value: str, columns: str) -> str:
    return f"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY anchor_id) AS rn, count(*) OVER (PARTITION BY fold) AS size FROM ({_ANCHOR_ROWS_SQL}) AS s),
p AS (SELECT fold, b, CAST({_HASH.format(text=f"'42|{tag}|' || fold || '|' || cast(b as string) || '|' || cast(rn as string)")} % size::UBIGINT AS BIGINT) + 1 AS pick FROM a, range(1, {_B + 1}) AS g(b)),
v AS (SELECT p.fold, p.b, {value} AS value FROM p JOIN a ON a.fold = p.fold AND a.rn = p.pick GROUP BY 1, 2)
SELECT fold, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high FROM v GROUP BY 1"""


@query(
    "anchor_precision_bootstrap", "M6",
    round_sql(_anchor_boot_sql("precision", "sum(true_positive_machines) / sum(selected_machines)", ""), ["fold"], ["ci_low", "ci_high"]),
)
def _(t):
    return rounded(bs.anchor_precision_interval(_anchor_rows(t), ["fold"], ["anchor_id"], _B))


@query(
    "anchor_value_bootstrap", "M6",
    round_sql(_anchor_boot_sql("value|minimum_score_selected|quantile", "quantile_cont(minimum_score_selected, 0.1)", ""), ["fold"], ["ci_low", "ci_high"]),
)
def _(t):
    return rounded(bs.anchor_value_interval(
        _anchor_rows(t), ["fold"], ["anchor_id"], "minimum_score_selected", "quantile", 0.1, _B
    ))


# ------------------------------------------------------------------ entities, groups and reports
@query(
    "entity_top_k", "M13",
    round_sql(f"""WITH e AS (SELECT machine_key, max(raw_score) AS p, max(true_label) AS y FROM ({SCORED_SQL}) AS s GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY p DESC, machine_key) AS rn, count(*) OVER () AS n FROM e)
SELECT *, selected_machines - true_positive_machines AS false_positive_machines, true_positive_machines / selected_machines AS precision, true_positive_machines / nullif(positive_machines, 0) AS recall,
 positive_machines / eligible_machines AS fleet_positive_rate, (true_positive_machines / selected_machines) / (positive_machines / eligible_machines) AS lift_vs_fleet FROM (
SELECT 'top_k_fraction' AS selection_type, v AS selection_value, count(*) AS eligible_machines, sum(y) AS positive_machines, count(*) FILTER (WHERE rn <= greatest(ceil(n * v), 1)) AS selected_machines,
 sum(y) FILTER (WHERE rn <= greatest(ceil(n * v), 1)) AS true_positive_machines, min(p) FILTER (WHERE rn <= greatest(ceil(n * v), 1)) AS minimum_score_selected FROM r, (VALUES (0.05::DOUBLE), (0.2::DOUBLE)) AS q(v) GROUP BY 2) AS z""",
              ["selection_type", "selection_value", "eligible_machines", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("positive_machines", "selected_machines", "true_positive_machines", "false_positive_machines")]], _SEL_DOUBLE),
)
def _(t):
    return rounded(m.entity_top_k(scored(t), "machine_key", "raw_score", "true_label", "anchor_date", (0.05, 0.2)))


@query(
    "entity_summary", "M14 W7",
    round_sql(f"""SELECT fold, machine_key, count(*) AS window_rows, sum(true_label) AS positive_window_rows, max(raw_score) AS max_score, avg(raw_score) AS mean_score, min(raw_score) AS min_score, max(anchor_date) AS latest_window_end,
 arg_max(raw_score, anchor_date) AS latest_window_score, max(struct_pack(s := raw_score, e := anchor_date, y := true_label)).e AS top_score_window_end, max(struct_pack(s := raw_score, e := anchor_date, y := true_label)).y AS top_score_target FROM ({SCORED_SQL}) AS s GROUP BY 1, 2""",
              ["fold", "machine_key", "window_rows", "CAST(positive_window_rows AS BIGINT) AS positive_window_rows", "latest_window_end", "top_score_window_end", "top_score_target"], ["max_score", "mean_score", "min_score", "latest_window_score"]),
)
def _(t):
    return rounded(m.entity_summary(scored(t), ["fold"], "machine_key", "raw_score", "true_label", "anchor_date"))


_GROUPED = f"SELECT *, anchor_id || '/' || cast(machine_key % 60 as string) AS g FROM ({SCORED_SQL}) AS s"
_GROUP_RANKS_SQL = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY raw_score DESC, machine_key) AS rn FROM ({_GROUPED}) AS x)
SELECT g, count(*) AS group_size, sum(true_label) AS case_count, count(*) - sum(true_label) AS control_count, arg_min(machine_key, rn) FILTER (WHERE true_label = 1) AS case_machine_key,
 max(raw_score) FILTER (WHERE true_label = 1) AS case_score, min(rn) FILTER (WHERE true_label = 1) AS case_rank_within_group, CAST(coalesce(min(rn) FILTER (WHERE true_label = 1) = 1, FALSE) AS INT) AS case_is_top_score,
 CAST(coalesce(min(rn) FILTER (WHERE true_label = 1) <= 2, FALSE) AS INT) AS case_is_top_2, max(raw_score) FILTER (WHERE true_label = 0) AS max_control_score,
 max(raw_score) FILTER (WHERE true_label = 1) - max(raw_score) FILTER (WHERE true_label = 0) AS case_score_minus_max_control_score FROM r GROUP BY g"""


def _grouped(t):
    return scored(t).withColumn("g", F.expr("concat(anchor_id, '/', machine_key % 60)"))


@query(
    "group_case_ranks", "M15",
    round_sql(_GROUP_RANKS_SQL, ["g", "group_size", "CAST(case_count AS BIGINT) AS case_count", "CAST(control_count AS BIGINT) AS control_count", "case_machine_key", "case_rank_within_group", "case_is_top_score", "case_is_top_2"],
              ["case_score", "max_control_score", "case_score_minus_max_control_score"]),
)
def _(t):
    return rounded(m.group_ranks(_grouped(t), "g", "raw_score", "true_label", "machine_key"))


@query(
    "group_rank_metrics", "M15",
    round_sql(f"""SELECT count(*) AS case_control_groups, avg(case_rank_within_group) AS mean_case_rank_within_group, quantile_cont(case_rank_within_group, 0.5) AS median_case_rank_within_group, avg(case_is_top_score) AS case_top_score_rate,
 avg(case_is_top_2) AS case_top_2_rate, avg(1.0 / case_rank_within_group) AS mean_reciprocal_case_rank, avg(case_score_minus_max_control_score) AS mean_case_score_minus_max_control_score FROM ({_GROUP_RANKS_SQL}) AS q WHERE case_count > 0""",
              ["case_control_groups"], ["mean_case_rank_within_group", "median_case_rank_within_group", "case_top_score_rate", "case_top_2_rate", "mean_reciprocal_case_rank", "mean_case_score_minus_max_control_score"]),
)
def _(t):
    return rounded(m.group_rank_metrics(m.group_ranks(_grouped(t), "g", "raw_score", "true_label", "machine_key")))


@query(
    "review_table", "M16",
    round_sql(f"""SELECT fold, {', '.join(f"max({v}) FILTER (WHERE cutoff = '{c}') AS {v}_{c}" for c in ('n5', 'n25') for v in ('precision', 'recall'))} FROM (SELECT *, 'n' || cast(cast(selection_value as int) as string) AS cutoff FROM ({_SELECTION_SQL}) AS s WHERE selection_type = 'top_n') AS l GROUP BY 1""",
              ["fold"], ["precision_n5", "recall_n5", "precision_n25", "recall_n25"]),
)
def _(t):
    rows = m.selection_metrics(ranked(t), ["fold", "anchor_id"], m.selections(counts=(5, 25)), "true_label", "raw_score")
    rows = rows.withColumn("cutoff", F.concat(F.lit("n"), F.col("selection_value").cast("int").cast("string")))
    return rounded(m.review_table(rows, ["fold"], "cutoff", ["n5", "n25"], ["precision", "recall"]))


_HORIZONS = (30, 90, 180)
_LONG_SQL = " UNION ALL ".join(
    f"SELECT *, {h} AS horizon, CAST(coalesce(days_to_event BETWEEN 0 AND {h}, FALSE) AS INT) AS y FROM ({SCORED_SQL}) AS s{h}" for h in _HORIZONS)


def _long(t):
    rows = scored(t).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in _HORIZONS])))
    return rows.withColumn("y", F.coalesce(F.col("days_to_event").between(0, F.col("horizon")).cast("int"), F.lit(0)))


@query(
    "cohort_verification", "M17",
    f"""SELECT fold, count(DISTINCT machine_key) AS machine_rows, 3 AS horizons, 1 AS same_machine_ids_across_horizons, 1 AS same_feature_windows_across_horizons, 0.0 AS maximum_absolute_score_difference,
 1 AS same_scores_across_horizons, CAST(sum(y) FILTER (WHERE horizon = 90) >= sum(y) FILTER (WHERE horizon = 30) AND sum(y) FILTER (WHERE horizon = 180) >= sum(y) FILTER (WHERE horizon = 90) AS INT) AS positive_counts_nondecreasing
FROM (SELECT * FROM ({_LONG_SQL}) AS l QUALIFY row_number() OVER (PARTITION BY fold, machine_key, horizon ORDER BY anchor_date DESC) = 1) AS v GROUP BY fold""",
)
def _(t):
    from tidemark.operators.ordering import first_per_group

    latest = first_per_group(_long(t), ["fold", "machine_key", "horizon"], [F.col("anchor_date").desc()])
    return m.cohort_verification(latest, ["fold"], "machine_key", "horizon", "raw_score", "y", ["anchor_date"])


@query(
    "horizon_trends", "W5 M22",
    round_sql(f"""SELECT fold, horizon, rate, lag(horizon) OVER w AS previous_horizon, lag(rate) OVER w AS previous_rate, rate - lag(rate) OVER w AS change_from_previous_horizon_rate, rate - first_value(rate) OVER w AS rate_change_vs_shortest_horizon
FROM (SELECT fold, horizon, avg(y) AS rate FROM ({_LONG_SQL}) AS l GROUP BY 1, 2) AS g WINDOW w AS (PARTITION BY fold ORDER BY horizon)""",
              ["fold", "horizon", "previous_horizon"], ["rate", "previous_rate", "change_from_previous_horizon_rate", "rate_change_vs_shortest_horizon"]),
)
def _(t):
    rows = _long(t).groupBy("fold", "horizon").agg(F.avg("y").alias("rate"))
    return rounded(m.horizon_trends(rows, ["fold"], "horizon", ["rate"]))


@query(
    "claim_timing", "M18",
    round_sql(f"""SELECT anchor_id, count(*) AS flagged_count, count(days_to_event) AS future_claim_observed_count,
 {', '.join(f'count(*) FILTER (WHERE days_to_event BETWEEN 0 AND {h}) AS claim_count_within_{h}d, count(*) FILTER (WHERE days_to_event BETWEEN 0 AND {h}) / count(*) AS claim_rate_within_{h}d' for h in _HORIZONS)},
 quantile_cont(days_to_event, 0.5) AS median_days_to_next_claim_all_observed, quantile_cont(days_to_event, 0.5) FILTER (WHERE days_to_event BETWEEN 0 AND 90) AS median_days_to_next_claim_within_horizon
FROM ({RANKED_SQL}) AS r WHERE rank_within_anchor <= 50 GROUP BY 1""",
              ["anchor_id", "flagged_count", "future_claim_observed_count", *[f"claim_count_within_{h}d" for h in _HORIZONS]],
              [*[f"claim_rate_within_{h}d" for h in _HORIZONS], "median_days_to_next_claim_all_observed", "median_days_to_next_claim_within_horizon"]),
)
def _(t):
    top = ranked(t).where("rank_within_anchor <= 50")
    return rounded(m.claim_timing(top, ["anchor_id"], "days_to_event", _HORIZONS, 90))


_LEVELS = {"p01_score": 0.01, "p05_score": 0.05, "p10_score": 0.1, "p25_score": 0.25, "median_score": 0.5, "p75_score": 0.75, "p90_score": 0.9, "p95_score": 0.95, "p99_score": 0.99}


@query(
    "score_distribution", "M19",
    round_sql(f"""SELECT fold, count(*) AS rows, count(DISTINCT machine_key) AS unique_machines, avg(raw_score) AS mean_score, stddev_samp(raw_score) AS std_score, min(raw_score) AS minimum_score, max(raw_score) AS maximum_score,
 avg(raw_score * raw_score) AS mean_squared_score_against_zero, count(*) FILTER (WHERE raw_score >= 0.5) AS rows_score_ge_0p5, {', '.join(f'quantile_cont(raw_score, {q}) AS {n}' for n, q in _LEVELS.items())} FROM ({SCORED_SQL}) AS s GROUP BY 1""",
              ["fold", "rows", "unique_machines", "rows_score_ge_0p5"], ["mean_score", "std_score", "minimum_score", "maximum_score", "mean_squared_score_against_zero", *_LEVELS]),
)
def _(t):
    return rounded(m.score_distribution(scored(t), ["fold"], "raw_score", "machine_key", (0.5,)))


_E20 = m.bin_edges(20)
_BIN20 = " + ".join(f"CAST(raw_score >= {e!r}::DOUBLE AS INT)" for e in _E20[1:-1])


@query(
    "score_histogram", "M19",
    round_sql(f"""SELECT f.fold, e.bin_number, e.lo AS score_bin_lower, e.hi AS score_bin_upper, coalesce(b.n, 0) AS rows, coalesce(b.n, 0) / f.alln AS fraction_within_group FROM (SELECT fold, count(*) AS alln FROM ({SCORED_SQL}) AS s GROUP BY 1) AS f
CROSS JOIN (VALUES {', '.join(f'({i + 1}, {_E20[i]!r}::DOUBLE, {_E20[i + 1]!r}::DOUBLE)' for i in range(20))}) AS e(bin_number, lo, hi) LEFT JOIN (SELECT fold, 1 + {_BIN20} AS bin_number, count(*) AS n FROM ({SCORED_SQL}) AS s GROUP BY 1, 2) AS b USING (fold, bin_number)""",
              ["fold", "bin_number", "rows"], ["score_bin_lower", "score_bin_upper", "fraction_within_group"]),
)
def _(t):
    return rounded(m.score_histogram(scored(t), ["fold"], "raw_score"))


@query(
    "capture_by_threshold", "M20",
    round_sql(f"""SELECT fold, t AS score_threshold, count(*) AS positive_rows, count(*) FILTER (WHERE raw_score >= t) AS captured_positive_rows, count(*) FILTER (WHERE raw_score < t) AS missed_positive_rows, avg(CAST(raw_score >= t AS INT)) AS positive_capture_rate,
 avg(days_to_event) FILTER (WHERE raw_score >= t) AS mean_days_to_claim_captured, avg(days_to_event) FILTER (WHERE raw_score < t) AS mean_days_to_claim_missed,
 quantile_cont(days_to_event, 0.5) FILTER (WHERE raw_score >= t) AS median_days_to_claim_captured, quantile_cont(days_to_event, 0.5) FILTER (WHERE raw_score < t) AS median_days_to_claim_missed
FROM ({SCORED_SQL}) AS s, (VALUES (0.3::DOUBLE), (0.6::DOUBLE)) AS q(t) WHERE true_label = 1 GROUP BY 1, 2""",
              ["fold", "score_threshold", "positive_rows", "captured_positive_rows", "missed_positive_rows"],
              ["positive_capture_rate", "mean_days_to_claim_captured", "mean_days_to_claim_missed", "median_days_to_claim_captured", "median_days_to_claim_missed"]),
)
def _(t):
    return rounded(m.capture_by_threshold(scored(t).where("true_label = 1"), ["fold"], "raw_score", "days_to_event", (0.3, 0.6)))


@query(
    "horizon_outcomes", "M22",
    round_sql(f"""SELECT fold, horizon AS evaluation_horizon_days, count(*) AS rows, sum(y) AS future_claim_positive_rows, avg(y) AS future_claim_positive_rate, avg(raw_score) FILTER (WHERE y = 1) AS mean_score_future_claim_positive,
 quantile_cont(raw_score, 0.5) FILTER (WHERE y = 1) AS median_score_future_claim_positive, avg(raw_score) FILTER (WHERE y = 0) AS mean_score_still_negative, quantile_cont(raw_score, 0.5) FILTER (WHERE y = 0) AS median_score_still_negative FROM ({_LONG_SQL}) AS l GROUP BY 1, 2""",
              ["fold", "evaluation_horizon_days", "rows", "CAST(future_claim_positive_rows AS BIGINT) AS future_claim_positive_rows"],
              ["future_claim_positive_rate", "mean_score_future_claim_positive", "median_score_future_claim_positive", "mean_score_still_negative", "median_score_still_negative"]),
)
def _(t):
    return rounded(m.horizon_outcomes(scored(t), ["fold"], "days_to_event", "raw_score", _HORIZONS))


_DEFECT_SQL = f"""SELECT anchor_id, CASE WHEN machine_key % 401 = 0 THEN 1 ELSE machine_key END AS machine_key, rank_within_anchor AS r, CASE WHEN machine_key % 89 = 0 THEN raw_score - 2 ELSE raw_score END AS s,
 CASE WHEN machine_key % 97 = 0 THEN calibrated_probability + 1 ELSE calibrated_probability END AS p, CASE WHEN machine_key % 53 = 0 THEN NULL ELSE true_label END AS y FROM ({RANKED_SQL}) AS q WHERE NOT (anchor_id LIKE '1997%' AND rank_within_anchor = 7)"""


@query(
    "output_checks", "M23",
    f"""WITH d AS ({_DEFECT_SQL}) SELECT (SELECT count(*) FROM d WHERE NOT (p BETWEEN 0 AND 1)) AS probability_out_of_range, (SELECT count(*) FROM d WHERE y IS NULL) AS label_not_binary,
 (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY anchor_id, machine_key HAVING count(*) > 1) AS k) AS duplicate_keys, (SELECT count(*) FROM (SELECT 1 FROM d GROUP BY anchor_id HAVING min(r) <> 1 OR max(r) <> count(*)) AS k) AS ranks_not_contiguous,
 (SELECT count(*) FROM d a JOIN d b ON b.anchor_id = a.anchor_id AND b.r = a.r + 1 WHERE b.s > a.s) AS scores_not_descending""",
)
def _(t):
    broken = ranked(t).where("not (anchor_id like '1997%' and rank_within_anchor = 7)").withColumns(
        {
            "s": F.expr("if(machine_key % 89 = 0, raw_score - 2, raw_score)"),
            "p": F.expr("if(machine_key % 97 = 0, calibrated_probability + 1, calibrated_probability)"),
            "y": F.expr("if(machine_key % 53 = 0, null, true_label)"),
        }
    ).withColumn("machine_key", F.expr("if(machine_key % 401 = 0, 1, machine_key)"))
    return m.output_checks(broken, ["anchor_id"], "machine_key", "s", "p", "y", "rank_within_anchor")


@query(
    "first_positive_horizon", "M22 W2",
    f"""SELECT machine_key, anchor_id, CASE WHEN days_to_event BETWEEN 0 AND 30 THEN 30 WHEN days_to_event BETWEEN 0 AND 90 THEN 90 WHEN days_to_event BETWEEN 0 AND 180 THEN 180 END AS first_horizon,
 CASE WHEN true_label = 1 AND raw_score >= 0.5 THEN 'TP' WHEN raw_score >= 0.5 THEN 'FP' WHEN true_label = 1 THEN 'FN' ELSE 'TN' END AS prediction_outcome FROM ({SCORED_SQL}) AS s""",
)
def _(t):
    return scored(t).select(
        "machine_key", "anchor_id", m.first_positive_horizon(F.col("days_to_event"), _HORIZONS).alias("first_horizon"),
        m.prediction_outcome(F.col("true_label"), (F.col("raw_score") >= 0.5).cast("int")).alias("prediction_outcome"),
    )
