"""Scoring, top-n grids, bands, boundary selection and tier policy queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.stats import platt, risk_index, risk_index_to_probability
from tidemark.operators import metrics as m
from tidemark.operators import tiers as tr
from tidemark.plans.metric_queries import _HASH, SCORED_SQL, scored, wilson_sql
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.session import cut_lineage

_GRID = (2, 5, 10, 20, 40)
_TARGETS = {"CRITICAL": 0.62, "HIGH": 0.58, "MEDIUM": 0.5}
_B = 1000


@query(
    "platt_and_risk_index", "T1 T3",
    round_sql(f"""SELECT *, 100.0 * least(greatest(p, 1e-6), 1 - 1e-6) AS risk_index, 100.0 * least(greatest(p, 1e-6), 1 - 1e-6) / 100.0 AS back FROM (
SELECT machine_key, anchor_id, 1 / (1 + exp(-least(greatest(1.7 * ln(q / (1 - q)) - 0.4, -40), 40))) AS p FROM (SELECT *, least(greatest(raw_score, 1e-6), 1 - 1e-6) AS q FROM ({SCORED_SQL}) AS s) AS c) AS d""",
              ["machine_key", "anchor_id"], ["p", "risk_index", "back"]),
)
def _(t):
    p = platt(F.col("raw_score"), 1.7, -0.4)
    rows = scored(t).select("machine_key", "anchor_id", p.alias("p")).withColumn("risk_index", risk_index(F.col("p")))
    return rounded(rows.withColumn("back", risk_index_to_probability(F.col("risk_index"))))


# two score orders play the two models
def predictions(t):
    rows = scored(t).withColumn("variant", F.explode(F.array(F.lit("base"), F.lit("mixed")))).withColumns(
        {
            "algorithm": F.lit("m"),
            "score": F.expr("case when variant = 'base' then raw_score else raw_score * 0.5e0 + (machine_key % 97) / 300e0 end"),
        }
    )
    return m.ranked_fleet(rows, ["algorithm", "variant", "fold", "anchor_id"], "score")


_PRED_SQL = f"""SELECT *, row_number() OVER (PARTITION BY variant, anchor_id ORDER BY score DESC, machine_key) AS rn FROM (
SELECT s.*, v.variant, 'm' AS algorithm, CASE WHEN v.variant = 'base' THEN raw_score ELSE raw_score * 0.5e0 + (machine_key % 97) / 300e0 END AS score FROM ({SCORED_SQL}) AS s, (VALUES ('base'), ('mixed')) AS v(variant)) AS q"""
_GRID_SQL = f"""WITH pred AS ({_PRED_SQL}), tot AS (SELECT algorithm, variant, fold, anchor_id, count(*) AS eligible_machines, sum(true_label) AS positive_machines FROM pred GROUP BY 1, 2, 3, 4),
grid AS (SELECT p.algorithm, p.variant, p.fold, p.anchor_id, g.n AS requested_top_n, count(*) AS selected_machines, sum(true_label) AS true_positive_machines, arg_max(machine_key, rn) AS boundary_machine_key,
 arg_max(score, rn) AS boundary_score, arg_max(calibrated_probability, rn) AS boundary_calibrated_probability, quantile_cont(score, 0.1) AS selected_score_q10, quantile_cont(score, 0.5) AS selected_score_median, coalesce(stddev_samp(score), 0) AS selected_score_std
 FROM pred p JOIN (VALUES {', '.join(f'({n})' for n in _GRID)}) AS g(n) ON p.rn <= g.n GROUP BY 1, 2, 3, 4, 5),
per AS (SELECT grid.*, eligible_machines, positive_machines, true_positive_machines / selected_machines AS precision, true_positive_machines / nullif(positive_machines, 0) AS recall FROM grid JOIN tot USING (algorithm, variant, fold, anchor_id))"""


def per_anchor(t, distributions=False):
    # a few rows per anchor that every later step reads: a stage table
    return cut_lineage(tr.top_n_grid(
        predictions(t), ["algorithm", "variant", "fold", "anchor_id"], _GRID, "true_label",
        ["score", "calibrated_probability"], distributions=distributions,
    ))


@query(
    "top_n_grid", "T4",
    round_sql(f"""{_GRID_SQL} SELECT *, {wilson_sql('true_positive_machines', 'selected_machines', 'precision_ci95_low', 'precision_ci95_high')}, precision / nullif(positive_machines / eligible_machines, 0) AS lift_vs_fleet FROM per""",
              ["algorithm", "variant", "fold", "anchor_id", "requested_top_n", "boundary_machine_key", "selected_machines", "eligible_machines", "CAST(true_positive_machines AS BIGINT) AS true_positive_machines", "CAST(positive_machines AS BIGINT) AS positive_machines"],
              ["boundary_score", "boundary_calibrated_probability", "precision", "recall", "precision_ci95_low", "precision_ci95_high", "lift_vs_fleet", "selected_score_q10", "selected_score_median", "selected_score_std"]),
)
def _(t):
    return rounded(per_anchor(t, True).select(
        "algorithm", "variant", "fold", "anchor_id", "requested_top_n", "boundary_machine_key", "selected_machines", "eligible_machines", "true_positive_machines",
        "positive_machines", "boundary_score", "boundary_calibrated_probability", "precision", "recall", "precision_ci95_low", "precision_ci95_high", "lift_vs_fleet",
        "selected_score_q10", "selected_score_median", "selected_score_std",
    ))


def _boot_cte(name: str, rows: str, keys: list[str], order: str, tag: str, value: str, low: str, high: str) -> str:
    by = ", ".join(keys)
    text = f"'42|{tag}|'" + "".join(f" || cast({k} as string) || '|'" for k in keys) + " || cast(b as string) || '|' || cast(rn as string)"
    match = " AND ".join(f"a.{k} = p.{k}" for k in keys)
    return f"""{name}_a AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn, count(*) OVER (PARTITION BY {by}) AS size FROM {rows}),
{name}_p AS (SELECT {by}, b, CAST({_HASH.format(text=text)} % size::UBIGINT AS BIGINT) + 1 AS pick FROM {name}_a, range(1, {_B + 1}) AS g(b)),
{name} AS (SELECT {by}, quantile_cont(value, 0.025) AS {low}, quantile_cont(value, 0.975) AS {high} FROM (SELECT {', '.join(f'p.{k}' for k in keys)}, p.b, {value} AS value FROM {name}_p p JOIN {name}_a a ON {match} AND a.rn = p.pick GROUP BY ALL) AS v GROUP BY ALL)"""


_POOL = "sum(true_positive_machines) / nullif(sum(selected_machines), 0)"
_MODEL = ["algorithm", "variant"]
_SUMMARY_CTE = f"""{_GRID_SQL}, {_boot_cte('sboot', 'per', [*_MODEL, 'requested_top_n'], 'fold, anchor_id', 'top_n_summary', _POOL, 'blow', 'bhigh')},
sums AS (SELECT algorithm, variant, requested_top_n, count(DISTINCT anchor_id) AS anchor_count, sum(selected_machines) AS total_selected, sum(true_positive_machines) AS total_true_positive, sum(positive_machines) AS total_positive,
 sum(eligible_machines) AS total_eligible, avg(precision) AS mean_anchor_precision, quantile_cont(precision, 0.5) AS median_anchor_precision, avg(recall) AS mean_anchor_recall, quantile_cont(boundary_score, 0.1) AS boundary_score_q10,
 {', '.join(f'avg(CAST(precision >= {v} AS INT)) AS pass_{k}' for k, v in _TARGETS.items())} FROM per GROUP BY 1, 2, 3),
summary AS (SELECT *, total_true_positive / total_selected AS micro_precision FROM sums JOIN sboot USING (algorithm, variant, requested_top_n))"""


def summary(t, rows):
    return tr.grid_summary(rows, [*_MODEL, "requested_top_n"], ["score"], replicates=_B, value_intervals=False)


@query(
    "top_n_summary", "T5",
    round_sql(f"""{_SUMMARY_CTE} SELECT *, blow AS micro_precision_anchor_bootstrap_ci95_low, bhigh AS micro_precision_anchor_bootstrap_ci95_high, total_true_positive / total_positive AS micro_recall,
 micro_precision / (total_positive / total_eligible) AS micro_lift_vs_fleet, {wilson_sql('total_true_positive', 'total_selected', 'micro_precision_wilson_ci95_low', 'micro_precision_wilson_ci95_high')} FROM summary""",
              [*_MODEL, "requested_top_n", "anchor_count", *[f"CAST({c} AS BIGINT) AS {c}" for c in ("total_selected", "total_true_positive", "total_positive", "total_eligible")]],
              ["mean_anchor_precision", "median_anchor_precision", "mean_anchor_recall", "boundary_score_q10", "micro_precision", "micro_precision_anchor_bootstrap_ci95_low", "micro_precision_anchor_bootstrap_ci95_high",
               "micro_recall", "micro_lift_vs_fleet", "micro_precision_wilson_ci95_low", "micro_precision_wilson_ci95_high"]),
)
def _(t):
    out = summary(t, per_anchor(t))
    return rounded(out.select(
        *_MODEL, "requested_top_n", "anchor_count", "total_selected", "total_true_positive", "total_positive", "total_eligible", "mean_anchor_precision", "median_anchor_precision", "mean_anchor_recall",
        "boundary_score_q10", "micro_precision", "micro_precision_anchor_bootstrap_ci95_low", "micro_precision_anchor_bootstrap_ci95_high", "micro_recall", "micro_lift_vs_fleet",
        "micro_precision_wilson_ci95_low", "micro_precision_wilson_ci95_high",
    ))


_TIER_VALUES = ", ".join(f"('{t}', {_TARGETS[t]}::DOUBLE, {i + 1})" for i, t in enumerate(tr.ACTIVE_TIERS))
_PASS = "CASE tier " + " ".join(f"WHEN '{t}' THEN pass_{t}" for t in _TARGETS) + " END"
_CAND_CTE = f"""{_SUMMARY_CTE}, cand AS (SELECT *, micro_precision >= req AND anchor_count >= 5 AND pr >= 0.5 AS point_qualified, micro_precision >= req AND anchor_count >= 5 AND pr >= 0.5 AND blow >= req AS confidence_qualified
 FROM (SELECT s.*, q.tier, q.req, q.tier_order, {_PASS} AS pr FROM summary s, (VALUES {_TIER_VALUES}) AS q(tier, req, tier_order)) AS z)"""


@query(
    "tier_boundary_candidates", "T6",
    round_sql(f"{_CAND_CTE} SELECT *, req AS required_precision, pr AS anchor_precision_pass_rate FROM cand",
              [*_MODEL, "tier", "tier_order", "requested_top_n", "point_qualified", "confidence_qualified"], ["required_precision", "micro_precision", "anchor_precision_pass_rate"]),
)
def _(t):
    rows = per_anchor(t)
    out = tr.boundary_candidates(rows, summary(t, rows), _MODEL, _TARGETS)
    return rounded(out.select(*_MODEL, "tier", "tier_order", "requested_top_n", "point_qualified", "confidence_qualified", "required_precision", "micro_precision", "anchor_precision_pass_rate"))


_BAND_CTE = f"""bandrows AS (SELECT u.algorithm, u.variant, u.fold, u.anchor_id, z.n AS lower_top_n, u.requested_top_n AS upper_top_n, u.selected_machines - coalesce(l.selected_machines, 0) AS selected_machines,
 u.true_positive_machines - coalesce(l.true_positive_machines, 0) AS true_positive_machines, (u.true_positive_machines - coalesce(l.true_positive_machines, 0)) / nullif(u.selected_machines - coalesce(l.selected_machines, 0), 0) AS precision
 FROM per u JOIN (VALUES (0), {', '.join(f'({n})' for n in _GRID)}) AS z(n) ON z.n < u.requested_top_n
 LEFT JOIN per l ON l.algorithm = u.algorithm AND l.variant = u.variant AND l.anchor_id = u.anchor_id AND l.requested_top_n = z.n),
{_boot_cte('bboot', 'bandrows', [*_MODEL, 'lower_top_n', 'upper_top_n'], 'fold, anchor_id', 'non_overlapping_band', _POOL, 'bblow', 'bbhigh')},
bsum AS (SELECT algorithm, variant, lower_top_n, upper_top_n, count(DISTINCT anchor_id) AS band_anchor_count, sum(selected_machines) AS band_selected, sum(true_positive_machines) AS band_true_positive, avg(precision) AS band_mean_anchor_precision,
 {', '.join(f'avg(CAST(coalesce(precision >= {v}, FALSE) AS INT)) AS a_{k}' for k, v in _TARGETS.items())} FROM bandrows GROUP BY 1, 2, 3, 4),
bfold AS (SELECT algorithm, variant, lower_top_n, upper_top_n, count(*) AS band_fold_count, avg(p) AS band_mean_fold_precision, {', '.join(f'avg(CAST(coalesce(p >= {v}, FALSE) AS INT)) AS f_{k}' for k, v in _TARGETS.items())}
 FROM (SELECT algorithm, variant, lower_top_n, upper_top_n, fold, {_POOL} AS p FROM bandrows GROUP BY 1, 2, 3, 4, 5) AS f GROUP BY 1, 2, 3, 4),
bands AS (SELECT *, band_precision >= req AND band_anchor_count >= 5 AND apass >= 0.5 AS bp, band_precision >= req AND band_anchor_count >= 5 AND apass >= 0.5 AND bblow >= req AS bc FROM (
 SELECT b.*, f.* EXCLUDE (algorithm, variant, lower_top_n, upper_top_n), o.bblow, q.tier, q.req, band_true_positive / nullif(band_selected, 0) AS band_precision, CASE q.tier {' '.join(f"WHEN '{t}' THEN a_{t}" for t in _TARGETS)} END AS apass,
 CASE q.tier {' '.join(f"WHEN '{t}' THEN f_{t}" for t in _TARGETS)} END AS fpass FROM bsum b JOIN bfold f USING (algorithm, variant, lower_top_n, upper_top_n) JOIN bboot o USING (algorithm, variant, lower_top_n, upper_top_n), (VALUES {_TIER_VALUES}) AS q(tier, req, tier_order)) AS z)"""


@query(
    "tier_band_statistics", "T7 J9",
    round_sql(f"{_GRID_SQL}, {_BAND_CTE} SELECT *, bp AS band_point_qualified, bc AS band_confidence_qualified, bblow AS band_precision_anchor_bootstrap_ci95_low, apass AS band_anchor_precision_pass_rate, fpass AS band_fold_precision_pass_rate FROM bands",
              [*_MODEL, "tier", "lower_top_n", "upper_top_n", "band_anchor_count", "band_fold_count", "band_point_qualified", "band_confidence_qualified", "CAST(band_selected AS BIGINT) AS band_selected", "CAST(band_true_positive AS BIGINT) AS band_true_positive"],
              ["band_precision", "band_precision_anchor_bootstrap_ci95_low", "band_mean_anchor_precision", "band_mean_fold_precision", "band_anchor_precision_pass_rate", "band_fold_precision_pass_rate"]),
)
def _(t):
    out = tr.band_statistics(per_anchor(t), _MODEL, targets=_TARGETS, replicates=_B)
    return rounded(out.select(
        *_MODEL, "tier", "lower_top_n", "upper_top_n", "band_anchor_count", "band_fold_count", "band_point_qualified", "band_confidence_qualified", "band_selected", "band_true_positive", "band_precision",
        "band_precision_anchor_bootstrap_ci95_low", "band_mean_anchor_precision", "band_mean_fold_precision", "band_anchor_precision_pass_rate", "band_fold_precision_pass_rate",
    ))


def _tables(t):
    rows = per_anchor(t)
    cands = tr.boundary_candidates(rows, summary(t, rows), _MODEL, _TARGETS)
    return rows, cands, tr.band_statistics(rows, _MODEL, targets=_TARGETS, replicates=_B)


_COARSE, _FINE = (5, 10, 20, 40), (2,)
_OPT_CTE = f"""{_CAND_CTE}, {_BAND_CTE}, opt AS (SELECT c.algorithm, c.variant, c.tier, b.lower_top_n, c.requested_top_n AS n, c.micro_precision, c.blow, b.band_precision, c.point_qualified AND b.bp AS point, c.confidence_qualified AND b.bc AS sure
 FROM cand c JOIN bands b ON b.algorithm = c.algorithm AND b.variant = c.variant AND b.tier = c.tier AND b.upper_top_n = c.requested_top_n)"""
# kept as tables: the engine now and then fails where it joins them in one go
_OPT_CTE = re.sub(r"\b(cand|bands|opt) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", _OPT_CTE)
_COARSE_IN = "(" + ", ".join(map(str, _COARSE)) + ")"


@query(
    "tier_boundary_combinations", "T8",
    # one row per model with the tiers' options as lists, so that the options are read once
    f"""{_OPT_CTE}, packs AS (SELECT algorithm, variant, {', '.join(f"list({{'lower': lower_top_n, 'n': n, 'point': point, 'sure': sure}}) FILTER (WHERE tier = '{tier}') AS {name}" for tier, name in (('CRITICAL', 'cs'), ('HIGH', 'hs'), ('MEDIUM', 'ms')))} FROM opt GROUP BY 1, 2),
high AS (SELECT algorithm, variant, cs, ms, unnest(list_filter(hs, lambda x: x.n IN {_COARSE_IN})) AS h FROM packs),
medium AS (SELECT algorithm, variant, h, list_filter(cs, lambda x: x.lower = 0 AND x.n = h.lower)[1] AS c, unnest(list_filter(ms, lambda x: x.lower = h.n AND x.n IN {_COARSE_IN})) AS m FROM high)
SELECT algorithm, variant, h.lower AS critical_top_n, h.n AS high_top_n, m.n AS medium_top_n, coalesce(c.point, TRUE) AND h.point AND m.point AS all_enabled_tiers_point_qualified,
 coalesce(c.sure, TRUE) AND h.sure AND m.sure AS all_enabled_tiers_confidence_qualified, CAST(coalesce(c.sure, FALSE) AS INT) + CAST(h.sure AS INT) + CAST(m.sure AS INT) AS confidence_qualified_tier_count, 2 + CAST(h.lower > 0 AS INT) AS enabled_tier_count FROM medium""",
)
def _(t):
    _, cands, bands = _tables(t)
    return tr.boundary_combinations(cands, bands, _COARSE, _FINE, _MODEL).select(
        *_MODEL, "critical_top_n", "high_top_n", "medium_top_n", "all_enabled_tiers_point_qualified", "all_enabled_tiers_confidence_qualified",
        "confidence_qualified_tier_count", "enabled_tier_count",
    )


_PICK = """SELECT p.algorithm, p.variant, '{tier}' AS tier, {order} AS tier_order, coalesce(o.n, 0) AS selected_top_n, p.prev + 1 AS band_start_rank, {status} AS selection_status, greatest(coalesce(o.n, 0), p.prev) AS nxt
 FROM {prev} p LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY algorithm, variant ORDER BY {rank}) AS rk FROM (SELECT opt.*, {cls} AS cls FROM opt JOIN {prev} USING (algorithm, variant) WHERE tier = '{tier}' AND lower_top_n = prev) AS z WHERE cls > 0) AS o
 ON o.algorithm = p.algorithm AND o.variant = p.variant AND o.rk = 1"""
_RANK = "cls DESC, CASE WHEN cls >= 2 THEN n END DESC, micro_precision DESC, blow DESC, n"
_CRIT_PICK = _PICK.format(tier="CRITICAL", order=1, prev="p0", rank=_RANK, cls=f"CASE WHEN n IN {_COARSE_IN} AND sure THEN 3 WHEN n = 2 AND sure THEN 2 WHEN n <= 5 THEN 1 ELSE 0 END",
                          status="CASE o.cls WHEN 3 THEN 'confidence_qualified_coarse_grid' WHEN 2 THEN 'confidence_qualified_fine_scan' WHEN 1 THEN 'maximum_precision_fallback_n_1_to_5' ELSE 'disabled_no_confidence_qualified_boundary' END")
_NEXT_STATUS = "CASE WHEN o.n IS NOT NULL THEN 'confidence_qualified' ELSE 'disabled_no_confidence_qualified_boundary' END"
_NEXT_CLS = f"CASE WHEN n IN {_COARSE_IN} AND sure THEN 3 ELSE 0 END"


@query(
    "selected_tier_boundaries", "T9",
    # the engine fails now and then on this statement unless its steps are kept as tables
    re.sub(r"(\w+) AS \(SELECT", r"\1 AS MATERIALIZED (SELECT", f"""{_OPT_CTE}, p0 AS (SELECT DISTINCT algorithm, variant, 0 AS prev FROM opt), s1 AS ({_CRIT_PICK}), p1 AS (SELECT algorithm, variant, nxt AS prev FROM s1),
s2 AS ({_PICK.format(tier='HIGH', order=2, prev='p1', rank=_RANK, cls=_NEXT_CLS, status=_NEXT_STATUS)}), p2 AS (SELECT algorithm, variant, nxt AS prev FROM s2),
s3 AS ({_PICK.format(tier='MEDIUM', order=3, prev='p2', rank=_RANK, cls=_NEXT_CLS, status=_NEXT_STATUS)})
SELECT * EXCLUDE (nxt) FROM s1 UNION ALL SELECT * EXCLUDE (nxt) FROM s2 UNION ALL SELECT * EXCLUDE (nxt) FROM s3"""),
)
def _(t):
    _, cands, bands = _tables(t)
    return tr.select_boundaries(cands, bands, _COARSE, _FINE, _MODEL).select(
        *_MODEL, "tier", "tier_order", "selected_top_n", "band_start_rank", "selection_status"
    )


_LIMITS = {"CRITICAL": 5, "HIGH": 25, "MEDIUM": 120}
_TIER_CASE = "CASE " + " ".join(f"WHEN rn <= {n} THEN '{t}'" for t, n in _LIMITS.items()) + " ELSE 'LOW' END"


@query(
    "tier_score_bands", "T10",
    round_sql(f"""SELECT variant, tier AS validation_candidate_tier, CASE tier WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END AS tier_order, count(*) AS tier_machine_snapshots, sum(true_label) AS tier_positive_machine_snapshots,
 count(DISTINCT anchor_id) AS anchor_count, count(DISTINCT machine_key) AS unique_machines, avg(true_label) AS tier_precision, avg(score) AS score_mean, quantile_cont(score, 0.5) AS score_median, quantile_cont(score, 0.1) AS score_q10, quantile_cont(score, 0.975) AS score_q975
FROM (SELECT *, {_TIER_CASE} AS tier FROM ({_PRED_SQL}) AS p) AS q GROUP BY 1, 2""",
              ["variant", "validation_candidate_tier", "tier_order", "tier_machine_snapshots", "CAST(tier_positive_machine_snapshots AS BIGINT) AS tier_positive_machine_snapshots", "anchor_count", "unique_machines"],
              ["tier_precision", "score_mean", "score_median", "score_q10", "score_q975"]),
)
def _(t):
    out = tr.tier_bands(tr.assign_tiers(predictions(t), _LIMITS), ["variant"], "true_label", ["score"])
    return rounded(out.select("variant", "validation_candidate_tier", "tier_order", "tier_machine_snapshots", "tier_positive_machine_snapshots", "anchor_count", "unique_machines",
                              "tier_precision", "score_mean", "score_median", "score_q10", "score_q975"))


_GATE_N = {"CRITICAL": 5, "HIGH": 20, "MEDIUM": 40}
_GATE_ROWS = "(SELECT per.*, q.tier, q.tier_order FROM per JOIN (VALUES ('CRITICAL', 1, 5), ('HIGH', 2, 20), ('MEDIUM', 3, 40)) AS q(tier, tier_order, n) ON per.requested_top_n = q.n)"
_GATE_KEYS = [*_MODEL, "tier", "tier_order", "requested_top_n"]


@query(
    "tier_score_gates", "T11",
    round_sql(f"""{_GRID_SQL}, gr AS {_GATE_ROWS}, {_boot_cte('gboot', 'gr', _GATE_KEYS, 'fold, anchor_id', 'gate|boundary_calibrated_probability|quantile', 'quantile_cont(boundary_calibrated_probability, 0.1)', 'glow', 'ghigh')}
SELECT {', '.join(f'g.{k}' for k in _GATE_KEYS)}, g.n AS anchor_count, g.gate AS boundary_calibrated_probability_gate, b.glow AS boundary_calibrated_probability_gate_ci95_low, b.ghigh AS boundary_calibrated_probability_gate_ci95_high, g.p AS cumulative_precision,
 greatest(b.ghigh, 0.2) AS final_calibrated_probability_gate, 100 * greatest(b.ghigh, 0.2) AS final_risk_index_gate
FROM (SELECT {', '.join(_GATE_KEYS)}, count(DISTINCT anchor_id) AS n, quantile_cont(boundary_calibrated_probability, 0.1) AS gate, sum(true_positive_machines) / sum(selected_machines) AS p FROM gr GROUP BY ALL) AS g JOIN gboot b USING ({', '.join(_GATE_KEYS)})""",
              [*_GATE_KEYS, "anchor_count"], ["boundary_calibrated_probability_gate", "boundary_calibrated_probability_gate_ci95_low", "boundary_calibrated_probability_gate_ci95_high", "cumulative_precision",
                                              "final_calibrated_probability_gate", "final_risk_index_gate"]),
)
def _(t):
    rows = per_anchor(t)
    chosen = rows.select(*_MODEL).distinct().withColumn(
        "__t", F.explode(F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(i + 1).alias("tier_order"), F.lit(n).alias("selected_top_n")) for i, (k, n) in enumerate(_GATE_N.items())]))
    ).select(*_MODEL, "__t.*")
    gates = tr.score_gates(rows, chosen, ["score", "calibrated_probability"], _MODEL, replicates=_B)
    # a fixed floor plays the validation gate of another run
    floor = gates.select(*_GATE_KEYS, F.lit(0.2).alias("boundary_calibrated_probability_gate_ci95_high"), F.lit(0.2).alias("boundary_calibrated_probability_gate"))
    final = tr.final_gates(gates, floor, _GATE_KEYS, "calibrated_probability", "score")
    return rounded(gates.join(final, _GATE_KEYS).select(
        *_GATE_KEYS, "anchor_count", "boundary_calibrated_probability_gate", "boundary_calibrated_probability_gate_ci95_low", "boundary_calibrated_probability_gate_ci95_high",
        "cumulative_precision", "final_calibrated_probability_gate", "final_risk_index_gate",
    ))


_POLICY = {
    "confirmation_rule": "both_calibrated_and_risk_index",
    "tiers": {
        "CRITICAL": {"enabled": True, "selected_top_n": 5, "final_calibrated_probability_gate": 0.70, "final_risk_index_gate": 71.0},
        "HIGH": {"enabled": True, "selected_top_n": 25, "final_calibrated_probability_gate": 0.6, "final_risk_index_gate": 40.0},
        "MEDIUM": {"enabled": True, "selected_top_n": 120, "final_calibrated_probability_gate": 0.3},
    },
}
_OK = {"CRITICAL": "p >= 0.70 AND 100 * p >= 71.0", "HIGH": "p >= 0.6 AND 100 * p >= 40.0", "MEDIUM": "p >= 0.3"}
_POLICY_SQL = f"""SELECT *, CASE cand WHEN 'CRITICAL' THEN CASE WHEN {_OK['CRITICAL']} THEN 'CRITICAL' WHEN {_OK['HIGH']} THEN 'HIGH' WHEN {_OK['MEDIUM']} THEN 'MEDIUM' ELSE 'LOW' END
 WHEN 'HIGH' THEN CASE WHEN {_OK['HIGH']} THEN 'HIGH' WHEN {_OK['MEDIUM']} THEN 'MEDIUM' ELSE 'LOW' END WHEN 'MEDIUM' THEN CASE WHEN {_OK['MEDIUM']} THEN 'MEDIUM' ELSE 'LOW' END ELSE 'LOW' END AS tier FROM (
SELECT machine_key, anchor_date AS snapshot_date, calibrated_probability AS p, raw_score, rn, {_TIER_CASE} AS cand FROM (SELECT *, row_number() OVER (PARTITION BY anchor_date ORDER BY calibrated_probability DESC, raw_score DESC, machine_key) AS rn FROM ({SCORED_SQL}) AS s) AS r) AS c"""
_PLACE = lambda c: f"CASE {c} WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"


def _scores(t):
    rows = scored(t).select(
        "machine_key", F.col("anchor_date").alias("snapshot_date"), F.col("raw_score").alias("raw_model_score"),
        F.col("calibrated_probability").alias("failure_probability"),
    )
    return tr.score_table(rows, 0.2329)


@query(
    "tier_policy", "T12 T14",
    f"""SELECT machine_key, snapshot_date, rn AS risk_rank_within_score_date, cand AS candidate_risk_tier, tier AS risk_tier, CAST(cand = tier AS INT) AS candidate_tier_confirmed, {_PLACE('tier')} - {_PLACE('cand')} AS tier_demotion_steps,
 CASE WHEN cand = 'LOW' THEN 'outside_all_selected_top_n_boundaries' WHEN cand = tier THEN lower(cand) || '_candidate_passed_score_confirmation' WHEN tier = 'LOW' THEN lower(cand) || '_candidate_failed_all_lower_score_gates'
  ELSE lower(cand) || '_candidate_demoted_to_' || lower(tier) || '_after_score_gate' END AS tier_decision_reason, CAST(p >= 0.2329 AS INT) AS model_flag_at_threshold FROM ({_POLICY_SQL}) AS x""",
)
def _(t):
    return tr.apply_policy(_scores(t), _POLICY).select(
        "machine_key", "snapshot_date", "risk_rank_within_score_date", "candidate_risk_tier", "risk_tier", "candidate_tier_confirmed",
        "tier_demotion_steps", "tier_decision_reason", "model_flag_at_threshold",
    )


@query(
    "scoring_summary", "T15",
    round_sql(f"""SELECT snapshot_date, count(*) AS scored_machines, count(*) FILTER (WHERE p >= 0.2329) AS flagged_machines, avg(p) AS mean_probability, max(p) AS max_probability,
 {', '.join(f"count(*) FILTER (WHERE tier = '{x}') AS {x.lower()}_machines" for x in tr.TIERS)} FROM ({_POLICY_SQL}) AS x GROUP BY 1""",
              ["snapshot_date", "scored_machines", "flagged_machines", *[f"{x.lower()}_machines" for x in tr.TIERS]], ["mean_probability", "max_probability"]),
)
def _(t):
    return rounded(tr.scoring_summary(tr.apply_policy(_scores(t), _POLICY)))


@query(
    "consumer_table", "T15 T16",
    f"""SELECT {_PLACE('tier')} AS tier_order, machine_key, snapshot_date, tier AS risk_tier, round(p, 4) AS failure_probability, round(100 * p, 4) AS risk_index FROM ({_POLICY_SQL}) AS x
WHERE snapshot_date = (SELECT max(anchor_date) FROM ({SCORED_SQL}) AS s)""",
)
def _(t):
    latest = tr.latest_period(_scores(t), "snapshot_date")
    return tr.consumer_table(
        tr.apply_policy(latest, _POLICY), ["machine_key", "snapshot_date", "risk_tier", "failure_probability", "risk_index"]
    )


_EV = {
    "fault_l04_count_90d": "cast(machine_key % 5 as int) - 1", "fault_serious_30d": "machine_key % 4", "fluid_current_severity": "machine_key % 3", "pm_overdue_count_90d": "case when machine_key % 11 = 0 then 1 else 0 end",
    "prior_target_event_count_365d": "machine_key % 2", "has_accelerating_faults": "machine_key % 2", "operation_history_days": "machine_key % 60", "days_since_last_sensor_reading": "machine_key % 40", "smr_delta_30d": "machine_key % 9",
    "fault_l03_count_90d": "machine_key % 6", "fault_single_system_concentration": "(machine_key % 10) / 10e0",
}
_EV_SQL = f"SELECT machine_key, anchor_id, 100 * calibrated_probability AS risk_index, {', '.join(f'{e} AS {n}' for n, e in _EV.items())} FROM ({SCORED_SQL}) AS s"
_FLAGS = """fault_l04_count_90d >= 1 OR fault_serious_30d >= 3 AS sf, fluid_current_severity >= 2 AS sl, pm_overdue_count_90d >= 1 AS od, prior_target_event_count_365d >= 1 AS h"""


@query(
    "evidence_tiers", "T13",
    f"""SELECT machine_key, anchor_id, CAST(sf OR sl OR od AS INT) AS has_current_condition_evidence, CAST(co AS INT) AS corroborated_evidence, CASE WHEN down THEN 'DOWN' ELSE 'ACTIVE' END AS operating_status_reconstructed,
 CASE WHEN down THEN 'CRITICAL' WHEN fault_l04_count_90d >= 3 OR (fault_l03_count_90d >= 3 AND fault_single_system_concentration >= 0.7) OR (risk_index >= 90 AND co) THEN 'HIGH' WHEN (risk_index >= 55 AND co) OR sf OR sl OR od THEN 'MEDIUM' ELSE 'LOW' END AS risk_level_reconstructed
FROM (SELECT *, CAST(sf AS INT) + CAST(sl AS INT) + CAST(od AS INT) + CAST(h AS INT) >= 2 AS co, operation_history_days >= 30 AND days_since_last_sensor_reading <= 21 AND smr_delta_30d < 5 AND (fault_l04_count_90d >= 3 OR (fault_l04_count_90d >= 1 AND fault_serious_30d >= 3 AND has_accelerating_faults >= 1)) AS down
FROM (SELECT *, {_FLAGS} FROM ({_EV_SQL}) AS e) AS f) AS g""",
)
def _(t):
    rows = scored(t).selectExpr("machine_key", "anchor_id", "100 * calibrated_probability as risk_index", *[f"{e} as {n}" for n, e in _EV.items()])
    return tr.evidence_tiers(rows).select(
        "machine_key", "anchor_id", "has_current_condition_evidence", "corroborated_evidence", "operating_status_reconstructed", "risk_level_reconstructed"
    )
