"""Feature screening and model queries over line items and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import modeling as ml
from tidemark.operators import screening as sc
from tidemark.operators.metrics import auc_ap
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.session import cut_lineage

_FEATURES = {
    "quantity": "l_quantity", "price": "l_extendedprice / 1000e0", "discount": "case when l_partkey % 7 = 0 then null else l_discount end",
    "tax": "l_tax", "double_quantity": "l_quantity * 2 + l_tax", "flat": "3e0", "shade": "l_quantity - (l_partkey % 13)",
}
_ROWS = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_returnflag = 'R' AND l_quantity > 10 THEN 1 ELSE 0 END AS target, CASE WHEN l_linestatus = 'F' THEN 'train' ELSE 'test' END AS split, {', '.join(f'{e} AS {n}' for n, e in _FEATURES.items())} FROM lineitem"
_NAMES = list(_FEATURES)


def _rows(t):
    return t("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_shipdate as date) as day", "case when l_returnflag = 'R' and l_quantity > 10 then 1 else 0 end as target",
        "case when l_linestatus = 'F' then 'train' else 'test' end as split", *[f"{e} as {n}" for n, e in _FEATURES.items()],
    )


def _union(parts) -> str:
    return " UNION ALL ".join(parts)


_MISSING = _union(f"SELECT split, '{f}' AS feature, count(*) AS rows, count(*) - count({f}) AS missing_count, (count(*) - count({f})) / count(*) AS missing_rate FROM ({_ROWS}) AS r GROUP BY 1" for f in _NAMES)


@query("missing_report", "S1", round_sql(_MISSING, ["split", "feature", "rows", "missing_count"], ["missing_rate"]))
def _(t):
    return rounded(sc.missing_report(_rows(t), _NAMES))


@query("high_missing", "S3", round_sql(f"SELECT * FROM ({_MISSING}) AS m WHERE split = 'train' AND missing_rate > 0.1", ["split", "feature", "rows", "missing_count"], ["missing_rate"]))
def _(t):
    return rounded(sc.high_missing(sc.missing_report(_rows(t), _NAMES), "train", 0.1))


_INVENTORY = _union(
    f"""SELECT '{f}' AS feature, count(*) AS rows, count({f}) AS non_missing, count(DISTINCT {f}) AS "unique", avg({f}) AS mean, var_samp({f}) AS "var", stddev_samp({f}) AS "std", min({f}) AS "min", max({f}) AS "max", avg({f}) FILTER (WHERE target = 1) AS mean_target_1,
 avg({f}) FILTER (WHERE target = 0) AS mean_target_0, quantile_cont({f}, 0.25) AS p25, quantile_cont({f}, 0.5) AS median, quantile_cont({f}, 0.75) AS p75, count(*) FILTER (WHERE {f} = 0) / count({f}) AS zero_rate, count(*) FILTER (WHERE {f} < 0) / count({f}) AS negative_rate FROM ({_ROWS}) AS r"""
    for f in _NAMES)
_INV_DOUBLE = ["mean", "var", "std", "min", "max", "mean_target_1", "mean_target_0", "p25", "median", "p75", "zero_rate", "negative_rate"]


@query("feature_inventory", "S2", round_sql(_INVENTORY, ["feature", "rows", "non_missing", '"unique"'], [f'"{c}"' for c in _INV_DOUBLE], 8))
def _(t):
    return rounded(sc.feature_inventory(_rows(t), _NAMES, "target"), 8)


@query("zero_variance", "S3 S12", f"""SELECT feature, "unique" FROM ({_INVENTORY}) AS i WHERE "unique" <= 1""")
def _(t):
    return sc.zero_variance(sc.feature_inventory(_rows(t), _NAMES, "target")).select("feature", "unique")


@query("usable_features", "S12", _union(f"SELECT '{f}' AS feature, CAST(count({f}) > 0 AND min({f}) < max({f}) AS INT) AS usable FROM ({_ROWS}) AS r" for f in _NAMES))
def _(t):
    return sc.usable_features(_rows(t), _NAMES)


@query(
    "feature_groups", "S4",
    "SELECT DISTINCT p_type, CASE WHEN regexp_matches(p_type, '^PROMO') THEN 'promo' WHEN regexp_matches(p_type, 'STEEL$') THEN 'steel' ELSE 'other' END AS feature_group FROM part",
)
def _(t):
    return t("part").select("p_type").distinct().withColumn("feature_group", sc.feature_group(F.col("p_type"), [("^PROMO", "promo"), ("STEEL$", "steel")]))


_GROUPS = {"amounts": ["quantity", "double_quantity", "price", "shade"], "rates": ["discount", "tax"]}
_PAIR_LIST = [(g, a, b) for g, n in _GROUPS.items() for i, a in enumerate(sorted(n)) for b in sorted(n)[i + 1:]]
_PAIRS = _union(f"SELECT '{g}' AS feature_group, '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS correlation, abs(corr({a}, {b})) AS abs_correlation FROM ({_ROWS}) AS r" for g, a, b in _PAIR_LIST)


@query("correlation_pairs", "S5", round_sql(_PAIRS, ["feature_group", "feature_a", "feature_b"], ["correlation", "abs_correlation"], 8))
def _(t):
    return rounded(sc.correlation_pairs(_rows(t), _GROUPS), 8)


_NAME_SQL = " + ".join(f"CASE WHEN contains(lower(feature), '{part}') THEN {value} ELSE 0 END" for part, value in sc.NAME_SCORES.items())
_QUALITY = f"""SELECT feature, -100.0 * (1 - non_missing / rows) + 2 * ln(1 + "unique") + ln(1 + "unique") + 0.01 * ln(1 + greatest(coalesce("var", 0), 0))
+ 1.25 * ({_NAME_SQL}) AS quality_score FROM ({_INVENTORY}) AS i"""


def _prune_sql(threshold: float) -> str:
    return f"""WITH RECURSIVE q AS MATERIALIZED ({_QUALITY}), e AS MATERIALIZED (SELECT feature_a AS a, feature_b AS b FROM ({_PAIRS}) AS p WHERE abs_correlation >= {threshold}), b AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT feature AS f, feature AS g FROM q UNION SELECT r.f, b.b FROM reach r JOIN b ON b.a = r.g), c AS (SELECT f AS feature, min(g) AS component FROM reach GROUP BY 1),
j AS (SELECT c.*, q.quality_score, count(*) OVER (PARTITION BY component) AS component_size, row_number() OVER (PARTITION BY component ORDER BY quality_score DESC, c.feature) AS rn FROM c JOIN q ON q.feature = c.feature),
k AS (SELECT component, feature AS kept_feature FROM j WHERE rn = 1)
SELECT j.component, component_size, feature, quality_score, kept_feature, CASE WHEN feature = kept_feature THEN 'keep' ELSE 'drop' END AS action FROM j JOIN k ON k.component = j.component WHERE component_size > 1"""


@query(
    "correlation_prune", "S6",
    round_sql(_prune_sql(0.9), ["component", "component_size", "feature", "kept_feature", "action"], ["quality_score"], 6),
)
def _(t):
    rows = _rows(t)
    quality = sc.quality_table(sc.feature_inventory(rows, _NAMES, "target"))
    return rounded(sc.correlation_prune(sc.correlation_pairs(rows, _GROUPS), quality, 0.9), 6)


@query(
    "drop_template", "S6",
    f"""WITH pruned AS MATERIALIZED ({_prune_sql(0.95)}), gone AS (SELECT feature FROM pruned WHERE action = 'drop')
SELECT feature, kept_feature AS related_feature, 'auto_drop' AS source, 1 AS confirmed_drop FROM pruned WHERE action = 'drop'
UNION ALL SELECT feature_b, feature_a, 'manual_review', 0 FROM ({_PAIRS}) AS p
WHERE abs_correlation >= 0.9 AND abs_correlation < 0.98 AND feature_a NOT IN (SELECT feature FROM gone) AND feature_b NOT IN (SELECT feature FROM gone)""",
)
def _(t):
    rows = _rows(t)
    pairs = sc.correlation_pairs(rows, _GROUPS)
    pruned = sc.correlation_prune(pairs, sc.quality_table(sc.feature_inventory(rows, _NAMES, "target")), 0.95)
    return sc.drop_template(pruned, sc.review_pairs(pairs, pruned, 0.9, 0.98))


_TESTED = _NAMES
_LONG = _union(f"SELECT '{f}' AS feature, target, l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce({f}, 0) AS v FROM ({_ROWS}) AS r" for f in _TESTED)
_ANOVA = f"""SELECT feature, ((q - t * t / nn) / (k - 1)) / nullif(w / (nn - k), 0) AS f_score FROM (SELECT feature, sum(n) AS nn, count(*) AS k, sum(n * m) AS t, sum(n * m * m) AS q, sum(ss) AS w FROM (
SELECT feature, target, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM ({_LONG}) AS l GROUP BY 1, 2) AS p GROUP BY 1) AS s"""


@query("anova_f", "S7", round_sql(_ANOVA, ["feature"], ["f_score"], 4))
def _(t):
    return rounded(sc.anova_f(_rows(t), _TESTED, "target"), 4)


_MI = f"""SELECT feature, sum((c / n) * ln((c / n) / ((cb / n) * (cc / n)))) AS mutual_information FROM (SELECT *, sum(c) OVER (PARTITION BY feature, bin) AS cb, sum(c) OVER (PARTITION BY feature, target) AS cc FROM (
SELECT feature, CASE WHEN kinds <= 2 THEN CAST(v > low AS INT) ELSE greatest(CAST(((r - 1) * least(10, kinds) + n - 2) // (n - 1) AS INT), 1) - 1 END AS bin, target, count(*) AS c, max(n) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY v, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS r, count(*) OVER (PARTITION BY feature) AS n FROM ({_LONG}) AS l) AS b
JOIN (SELECT feature, count(DISTINCT v) AS kinds, min(v) AS low FROM ({_LONG}) AS l GROUP BY 1) AS k USING (feature) GROUP BY 1, 2, 3) AS g) AS h GROUP BY 1"""


@query("mutual_information", "S8", round_sql(_MI, ["feature"], ["mutual_information"], 8))
def _(t):
    return rounded(sc.mutual_information(_rows(t), _TESTED, "target", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]), 8)


_CHI = f"""SELECT feature, sum(coalesce((o - e) * (o - e) / nullif(e, 0), 0)) AS chi2_score FROM (SELECT *, sum(o) OVER (PARTITION BY feature) * n / sum(n) OVER (PARTITION BY feature) AS e FROM (
SELECT feature, target, n, coalesce((s - n * min(lo) OVER (PARTITION BY feature)) / nullif(max(hi) OVER (PARTITION BY feature) - min(lo) OVER (PARTITION BY feature), 0), 0) AS o FROM (
SELECT feature, target, count(*) AS n, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM ({_LONG}) AS l GROUP BY 1, 2) AS p) AS x) AS y GROUP BY 1"""


@query("chi2_scores", "S9", round_sql(_CHI, ["feature"], ["chi2_score"], 6))
def _(t):
    return rounded(sc.chi2_minmax(_rows(t), _TESTED, "target"), 6)


# the twin has the scores only; the chances are tested against known values
@query("target_tests", "S7 S9")
def _(t):
    return sc.target_tests(_rows(t), _TESTED, "target")


@query(
    "feature_consensus", "S10 W9",
    round_sql(f"""WITH a AS (SELECT feature, rank() OVER (ORDER BY f_score DESC NULLS LAST) AS rank_anova FROM ({_ANOVA}) AS x), c AS (SELECT feature, rank() OVER (ORDER BY chi2_score DESC NULLS LAST) AS rank_chi2 FROM ({_CHI}) AS x)
SELECT *, rank() OVER (ORDER BY mean_rank) AS consensus_rank FROM (SELECT a.feature, rank_anova, rank_chi2, (rank_anova + coalesce(rank_chi2, 0)) / (1 + CAST(rank_chi2 IS NOT NULL AS INT)) AS mean_rank FROM a LEFT JOIN c ON c.feature = a.feature) AS m""",
              ["feature", "rank_anova", "rank_chi2", "consensus_rank"], ["mean_rank"]),
)
def _(t):
    rows = _rows(t)
    anova = sc.anova_f(rows, _TESTED, "target").withColumnRenamed("f_score", "score")
    chi2 = sc.chi2_minmax(rows, _TESTED, "target").withColumnRenamed("chi2_score", "score")
    return rounded(sc.consensus(anova.select("feature"), {"anova": anova, "chi2": chi2}))


_CODES = {f"code_{i}": f"case when l_partkey % 17 = {i} then 1 + l_linenumber else 0 end" for i in range(6)}


@query(
    "ranked_codes", "S11",
    round_sql("SELECT feature, support, p AS rate_present, a AS rate_absent, (p - a) * sqrt(support) AS score FROM (SELECT * FROM (" + _union(
        f"SELECT '{n}' AS feature, count(*) FILTER (WHERE {e} > 0) AS support, count(*) FILTER (WHERE {e} <= 0) AS others, avg(target) FILTER (WHERE {e} > 0) AS p, avg(target) FILTER (WHERE {e} <= 0) AS a FROM ({_ROWS}) AS r" for n, e in _CODES.items()) + ") AS u WHERE support >= 30 AND others >= 30) AS v ORDER BY score DESC, p - a DESC, support DESC, feature DESC LIMIT 4",
              ["feature", "support"], ["rate_present", "rate_absent", "score"]),
)
def _(t):
    rows = _rows(t).selectExpr("target", *[f"{e} as {n}" for n, e in _CODES.items()])
    return rounded(sc.ranked_codes(rows, list(_CODES), "target", 30, 4))


@query(
    "class_weight", "S14",
    round_sql(f"SELECT count(*) FILTER (WHERE target = 1) AS positives, count(*) FILTER (WHERE target = 0) AS negatives, sqrt(count(*) FILTER (WHERE target = 0) / count(*) FILTER (WHERE target = 1)) AS scale_pos_weight FROM ({_ROWS}) AS r",
              ["positives", "negatives"], ["scale_pos_weight"]),
)
def _(t):
    return rounded(sc.class_weight(_rows(t), "target", root=True))


# ------------------------------------------------------------------ models (rows only)
_MODEL_FEATURES, _MODEL_CATEGORIES = [n for n in _NAMES if n != "flat"], ["mode", "size"]
_FOLDS = [("F1", "1998-06-01", "1999-03-01"), ("F2", "2000-01-01", "2000-09-01")]


def _model_rows(t):
    rows = t("lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "case when l_suppkey % 5 = 0 then null else 'M' || cast(l_suppkey % 4 as string) end as mode", "case when l_quantity > 25 then 'large' else 'small' end as size")
    return _rows(t).join(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])


def _out_of_fold(t):
    return ml.out_of_fold(_model_rows(t), "day", _FOLDS, _MODEL_FEATURES, "target", tuple(ml.CLASSIFIERS), categorical=_MODEL_CATEGORIES, weight=True, options=_SMALL_TREES)


#: Sizes of the tree models in the queries.
_SMALL_TREES = {"boosted_trees": {"maxIter": 10, "maxDepth": 4}, "random_forest": {"numTrees": 20, "maxDepth": 5}}


def _fold_scores(t):
    """The scores alone, stored: every metric reads them and no model scores its rows twice."""
    return cut_lineage(_out_of_fold(t).select("algorithm", "fold", "target", "raw_score", "calibrated_probability"))


@query("out_of_fold_metrics", "S13 S14 S15 S18 T2")
def _(t):
    return ml.fold_metrics(_fold_scores(t), "target")


@query("out_of_fold_summary", "S18")
def _(t):
    scores = _fold_scores(t)
    pooled = auc_ap(scores, ["algorithm"], "raw_score", "target")
    return ml.fold_summary(ml.fold_metrics(scores, "target"), pooled)


@query("tuned_candidates", "S16")
def _(t):
    grids = {"logistic": {"regParam": [0.0, 0.01]}, "boosted_trees": {"maxDepth": [2, 4], "maxIter": [10]}, "random_forest": {"maxDepth": [3, 5], "numTrees": [20]}}
    return ml.tune(_model_rows(t), "day", _FOLDS, _MODEL_FEATURES, "target", grids, categorical=_MODEL_CATEGORIES, weight=True)


@query("permutation_importance", "S17")
def _(t):
    rows = _rows(t)
    model = ml.fit(rows.where("split = 'train'"), _MODEL_FEATURES, "target")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return ml.permutation_importance(model, rows.where("split = 'test'"), _MODEL_FEATURES, "target", keys, repeats=10)
