"""Split, fold, filter and cohort queries over customers, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import cohorts as ch
from tidemark.operators import labels as lb
from tidemark.operators import splits as sp
from tidemark.operators.spine import label_end, source_coverage
from tidemark.plans.metric_queries import _HASH, SCORED_SQL, scored
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.plans.spine_queries import NEXT_SQL, with_next
from tidemark.plans import roles
from tidemark.session import cut_lineage
from tidemark.sources import standardize as std

_H = lambda text: f"substr(md5('42|' || {text}), 1, 16)"

# ------------------------------------------------------------------ splits
_MASTER = """SELECT 'K' || cast(c_custkey as string) AS machine_key, CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS full_model,
 CAST(c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 470000) AS INT) AS has_eligible_claim_history FROM customer"""


def _master(t):
    hot = t("orders").where("o_totalprice > 470000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("__h", F.lit(1))
    return t("customer").join(hot, "c_custkey", "left").selectExpr(
        "concat('K', c_custkey) as machine_key", "if(c_mktsegment = 'BUILDING', '', c_mktsegment) as full_model", "coalesce(__h, 0) as has_eligible_claim_history"
    )


# strata here are large and no split lacks positives, so the twin needs plain largest remainders
_SPLIT_SQL = f"""WITH m AS (SELECT *, coalesce(nullif(full_model, ''), 'UNKNOWN') || '|claim=' || cast(has_eligible_claim_history as string) AS stratum, {_H('machine_key')} AS h FROM ({_MASTER}) AS x),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, machine_key) AS rn, count(*) OVER (PARTITION BY stratum) AS n FROM m),
q AS (SELECT DISTINCT stratum, n, floor(n * CAST(0.7 AS DOUBLE)) AS a, floor(n * CAST(0.15 AS DOUBLE)) AS b, floor(n * CAST(0.15 AS DOUBLE)) AS c, n * CAST(0.7 AS DOUBLE) - floor(n * CAST(0.7 AS DOUBLE)) AS fa, n * CAST(0.15 AS DOUBLE) - floor(n * CAST(0.15 AS DOUBLE)) AS fb,
 {_H("stratum || 'validation'")} < {_H("stratum || 'test'")} AS vfirst FROM r),
o AS (SELECT *, n - a - b - c AS spare, CAST(fb > fa AS INT) * 2 AS before_train, CAST(fa >= fb AS INT) + CAST(NOT vfirst AS INT) AS before_val, CAST(fa >= fb AS INT) + CAST(vfirst AS INT) AS before_test FROM q),
z AS (SELECT *, a + CAST(before_train < spare AS INT) AS n_train, b + CAST(before_val < spare AS INT) AS n_val FROM o)
SELECT r.machine_key, r.stratum AS split_stratum, r.has_eligible_claim_history, CASE WHEN rn <= n_train THEN 'train' WHEN rn <= n_train + n_val THEN 'validation' ELSE 'test' END AS split, r.full_model FROM r JOIN z USING (stratum)"""
_RATIOS = {"train": 0.7, "validation": 0.15, "test": 0.15}


@query("stratified_entity_split", "G1 B18", f"SELECT machine_key, split_stratum, split FROM ({_SPLIT_SQL}) AS s")
def _(t):
    return sp.stratified_entity_split(_master(t), _RATIOS).select("machine_key", "split_stratum", "split")


@query(
    "split_summary", "G2 G12",
    round_sql(f"""SELECT split, count(*) AS machines, sum(has_eligible_claim_history) AS machines_with_eligible_claim_history, count(*) - sum(has_eligible_claim_history) AS machines_without_eligible_claim_history,
 count(DISTINCT full_model) AS full_models, CASE split WHEN 'train' THEN 0.7 ELSE 0.15 END AS configured_ratio, count(*) / (SELECT count(*) FROM customer) AS actual_machine_ratio FROM ({_SPLIT_SQL}) AS s GROUP BY 1""",
              ["split", "machines", "CAST(machines_with_eligible_claim_history AS BIGINT) AS machines_with_eligible_claim_history",
               "CAST(machines_without_eligible_claim_history AS BIGINT) AS machines_without_eligible_claim_history", "full_models"], ["configured_ratio", "actual_machine_ratio"]),
)
def _(t):
    return rounded(sp.split_summary(sp.stratified_entity_split(_master(t), _RATIOS), _RATIOS))


@query(
    "split_leaks", "G2",
    f"SELECT machine_key, count(DISTINCT split) AS splits FROM (SELECT machine_key, CASE WHEN year(anchor_date) < 1998 AND machine_key % 7 = 0 THEN 'train' ELSE split END AS split FROM ({SCORED_SQL}) AS s) AS q GROUP BY 1 HAVING count(DISTINCT split) > 1",
)
def _(t):
    return sp.split_leaks(scored(t).withColumn("split", F.expr("if(year(anchor_date) < 1998 and machine_key % 7 = 0, 'train', split)")))


@query(
    "population_fingerprint", "G3",
    "SELECT count(*) AS rows, cast(sum(('0x' || substr(md5(cast(c_custkey as string) || '|' || c_mktsegment), 1, 15))::HUGEINT) as string) AS hash_sum FROM customer",
)
def _(t):
    return sp.fingerprint(t("customer"), ["c_custkey", "c_mktsegment"])


@query(
    "chronological_rows", "G4",
    """SELECT o_orderkey, rn - 1 AS row_position_chronological, CASE WHEN rn <= floor(n * (CAST(0.75 AS DOUBLE) / 1.05::DOUBLE)) THEN 'training_main' WHEN rn <= floor(n * (0.75::DOUBLE / 1.05::DOUBLE + 0.15::DOUBLE / 1.05::DOUBLE)) THEN 'validation_holdout' ELSE 'test_holdout' END AS split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) AS q""",
)
def _(t):
    rows = t("orders").select("o_orderkey", "o_orderdate")
    return sp.chronological_rows(rows, "o_orderdate", (0.75, 0.15, 0.15), ["o_orderkey"]).drop("o_orderdate")


@query(
    "inner_split", "G4",
    """SELECT o_orderkey, rn - 1 AS row_position_within_training, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'feature_train' ELSE 'feature_selection_holdout' END AS inner_split
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER () AS n FROM orders) AS q""",
)
def _(t):
    rows = t("orders").select("o_orderkey", "o_orderdate")
    return sp.inner_split(rows, "o_orderdate", 0.8, ["o_orderkey"]).drop("o_orderdate")


@query(
    "chronological_dates", "G5",
    f"""WITH d AS (SELECT anchor_date, count(*) AS n FROM ({SCORED_SQL}) AS s GROUP BY 1), c AS (SELECT *, sum(n) OVER (ORDER BY anchor_date) AS thru, row_number() OVER (ORDER BY anchor_date) AS turn, sum(n) OVER () AS alln, count(*) OVER () AS k FROM d),
a AS (SELECT arg_min(turn, struct_pack(x := abs(thru - alln * 0.6::DOUBLE), y := turn)) AS a FROM c WHERE turn <= k - 2),
b AS (SELECT a, (SELECT arg_min(turn, struct_pack(x := abs(thru - alln * (0.6::DOUBLE + 0.2::DOUBLE)), y := turn)) FROM c WHERE turn > a AND turn <= k - 1) AS b FROM a)
SELECT s.machine_key, s.anchor_date, CASE WHEN turn <= b.a THEN 'training_main' WHEN turn <= b.b THEN 'validation_holdout' ELSE 'test_holdout' END AS split FROM ({SCORED_SQL}) AS s JOIN c USING (anchor_date), b""",
)
def _(t):
    return sp.chronological_dates(scored(t).select("machine_key", "anchor_date"), "anchor_date", (0.6, 0.2, 0.2))


@query(
    "expanding_folds", "G6",
    f"""WITH s AS ({SCORED_SQL}), l AS (SELECT max(anchor_date) AS last FROM s), f AS (SELECT i AS fold_id, CAST(last - (4 - i) * 300 AS DATE) AS ve FROM l, range(1, 5) AS g(i)), g AS (SELECT fold_id, CAST(ve - 299 AS DATE) AS vs, ve, CAST(ve - 299 - 90 AS DATE) AS gs FROM (SELECT CAST(fold_id AS INT) AS fold_id, CAST(ve AS DATE) AS ve FROM f) AS y),
c AS (SELECT fold_id, gs, vs, ve, min(anchor_date) FILTER (WHERE anchor_date < gs) AS ts, max(anchor_date) FILTER (WHERE anchor_date < gs) AS te, count(*) FILTER (WHERE anchor_date < gs) AS tr, count(*) FILTER (WHERE anchor_date BETWEEN vs AND ve) AS vr,
 count(*) FILTER (WHERE anchor_date < gs AND true_label = 1) AS tp, count(*) FILTER (WHERE anchor_date BETWEEN vs AND ve AND true_label = 1) AS vp FROM g, s GROUP BY 1, 2, 3, 4)
SELECT fold_id, gs AS gap_start_date, vs AS validation_start_date, ve AS validation_end_date, ts AS train_start_date, te AS train_end_date, tr AS train_rows, vr AS validation_rows, tp AS train_positive_count, vp AS validation_positive_count,
 concat_ws(';', CASE WHEN tr < 5000 THEN 'train_rows_lt_5000' END, CASE WHEN vr < 10 THEN 'validation_rows_lt_10' END, CASE WHEN tp < 3000 THEN 'train_positives_lt_3000' END, CASE WHEN vp < 5 THEN 'validation_positives_lt_5' END) AS skip_reasons,
 CASE WHEN tr < 5000 OR vr < 10 OR tp < 3000 OR vp < 5 THEN 'skipped' ELSE 'used' END AS status FROM c""".replace("(4 - i) * 300", "CAST((4 - i) * 300 AS INT)"),
)
def _(t):
    return sp.expanding_folds(scored(t), "anchor_date", "true_label", 4, 300, 90, 5000, 10, 3000, 5)


@query(
    "rolling_origin_split", "G7",
    f"""WITH s AS ({SCORED_SQL}), cal AS (SELECT DISTINCT anchor_date FROM s WHERE anchor_date < DATE '1999-01-01' - 90 ORDER BY 1 DESC LIMIT 3)
SELECT machine_key, anchor_date, CASE WHEN anchor_date >= DATE '1999-01-01' THEN 'validation' WHEN anchor_date IN (SELECT anchor_date FROM cal) THEN 'calibration' ELSE 'fit' END AS role FROM s
WHERE anchor_date < DATE '1999-01-01' - 90 OR (anchor_date >= DATE '1999-01-01' AND anchor_date < DATE '2000-01-01')""",
)
def _(t):
    return sp.rolling_origin(scored(t).select("machine_key", "anchor_date"), "anchor_date", "1999-01-01", "2000-01-01")


@query(
    "period_split", "G8",
    f"""WITH e AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), p AS (SELECT DISTINCT snapshot_date AS ps, CAST(snapshot_date + 89 AS DATE) AS pe, CAST(snapshot_date + 89 + 90 AS DATE) AS te FROM ({roles.ORDER_SPINE_SQL}) AS s),
c AS (SELECT p.*, te <= last AS ok FROM p, e), l AS (SELECT min(ps) AS ls FROM (SELECT ps FROM c WHERE ok ORDER BY ps DESC LIMIT 2) AS x), v AS (SELECT ps FROM c, l WHERE ok AND te < ls ORDER BY ps DESC LIMIT 2), vs AS (SELECT min(ps) AS vs FROM v)
SELECT ps AS period_start, pe AS period_end, CASE WHEN NOT ok THEN 'label_incomplete' WHEN ps >= ls THEN 'locked_test' WHEN ps IN (SELECT ps FROM v) THEN 'validation' WHEN te < vs THEN 'training' ELSE 'purged_gap' END AS split FROM c, l, vs""",
)
def _(t):
    periods = roles.order_spine(t).select(F.col("snapshot_date").alias("period_start"), F.date_add("snapshot_date", 89).alias("period_end"))
    return sp.period_split(periods, label_end([(t("orders"), "o_orderdate")]))


@query(
    "grouped_folds", "G9",
    f"""WITH e AS (SELECT machine_key, max(true_label) AS y, {_H('cast(machine_key as string)')} AS h FROM ({SCORED_SQL}) AS s GROUP BY 1), f AS (SELECT machine_key, CAST((row_number() OVER (PARTITION BY y ORDER BY h, machine_key) - 1) % 5 AS INT) AS fold FROM e)
SELECT s.machine_key, s.anchor_date, f.fold FROM ({SCORED_SQL}) AS s JOIN f USING (machine_key)""",
)
def _(t):
    rows = scored(t).select("machine_key", "anchor_date", "true_label")
    return sp.grouped_folds(rows, "machine_key", "true_label", 5).drop("true_label")


_FILTER_ROWS = f"SELECT *, CASE WHEN machine_key % 5 = 0 THEN 0 ELSE k1 END AS act, CASE WHEN machine_key % 3 = 0 THEN 0 ELSE 1 END AS f1, CASE WHEN machine_key % 4 = 0 THEN NULL ELSE 2 END AS f2, raw_score AS f3 FROM (SELECT *, CASE WHEN true_label = 1 THEN 3 ELSE 1 END AS k1 FROM ({SCORED_SQL}) AS s) AS q"
_KEEP = "(anchor_date <= DATE '2001-03-01' - 90)", "act <> 0", "CAST(f1 <> 0 AS INT) + CAST(coalesce(f2, 0) <> 0 AS INT) + CAST(abs(f3) > 1e-12 AS INT) >= 2"


def _filtered(t):
    rows = scored(t).selectExpr(
        "*", "case when machine_key % 5 = 0 then 0 when true_label = 1 then 3 else 1 end as act", "case when machine_key % 3 = 0 then 0 else 1 end as f1",
        "case when machine_key % 4 = 0 then null else 2 end as f2", "raw_score as f3",
    )
    return sp.training_filters(rows, "anchor_date", ["f1", "f2", "f3"], ["act"], "2001-03-01", 90, 2)


@query("training_rows", "G10", f"SELECT machine_key, anchor_date FROM ({_FILTER_ROWS}) AS r WHERE {' AND '.join(_KEEP)}")
def _(t):
    return _filtered(t)[0].select("machine_key", "anchor_date")


@query(
    "training_filter_report", "G10",
    f"""WITH c AS (SELECT count(*) AS a, count(*) FILTER (WHERE {_KEEP[0]}) AS b, count(*) FILTER (WHERE {_KEEP[0]} AND {_KEEP[1]}) AS c, count(*) FILTER (WHERE {' AND '.join(_KEEP)}) AS d FROM ({_FILTER_ROWS}) AS r)
SELECT 0 AS step_number, 'input' AS step, a AS rows_before, a AS rows_after, 0 AS rows_dropped FROM c UNION ALL SELECT 1, 'target_window_cutoff', a, b, a - b FROM c UNION ALL SELECT 2, 'all_zero_feature_rows', b, c, b - c FROM c
UNION ALL SELECT 3, 'extreme_sparse_feature_rows', c, d, c - d FROM c""",
)
def _(t):
    return _filtered(t)[1]


_SENT = f"SELECT machine_key, anchor_date, coalesce(days_to_event, 9999) AS days, CASE WHEN machine_key % 11 = 0 THEN 1 WHEN machine_key % 13 = 0 THEN NULL ELSE CAST(days_to_event IS NOT NULL AS INT) END AS has_event FROM ({SCORED_SQL}) AS s"


def _sentinel(t):
    rows = scored(t).selectExpr(
        "machine_key", "anchor_date", "coalesce(days_to_event, 9999) as days",
        "case when machine_key % 11 = 0 then 1 when machine_key % 13 = 0 then null else cast(days_to_event is not null as int) end as has_event",
    )
    return sp.sentinel_to_null(rows, {"days": "has_event"})


@query("sentinel_cleaning", "G11", f"SELECT machine_key, anchor_date, nullif(days, 9999) AS days, coalesce(has_event, CAST(days <> 9999 AS INT)) AS has_event FROM ({_SENT}) AS s")
def _(t):
    return _sentinel(t)[0]


@query(
    "sentinel_report", "G11",
    f"""SELECT 'days' AS source_column, 'has_event' AS indicator_column, count(*) AS rows, count(*) FILTER (WHERE days = 9999) AS sentinel_count, count(*) FILTER (WHERE has_event <> CAST(days <> 9999 AS INT)) AS indicator_mismatch_count,
 CAST(sum(coalesce(has_event, CAST(days <> 9999 AS INT))) AS BIGINT) AS indicator_positive_count FROM ({_SENT}) AS s""",
)
def _(t):
    return _sentinel(t)[1]


@query(
    "target_summary", "G12",
    round_sql(f"SELECT fold, count(*) AS rows, min(anchor_date) AS date_min, max(anchor_date) AS date_max, sum(true_label) AS target_positive_count, avg(true_label) AS target_positive_rate, count(DISTINCT machine_key) AS unique_machine_key FROM ({SCORED_SQL}) AS s GROUP BY 1",
              ["fold", "rows", "date_min", "date_max", "CAST(target_positive_count AS BIGINT) AS target_positive_count", "unique_machine_key"], ["target_positive_rate"]),
)
def _(t):
    return rounded(sp.target_summary(scored(t), ["fold"], "anchor_date", "true_label", ["machine_key"]))


@query("reduced_export", "G13", f"SELECT machine_key, anchor_date, raw_score, 0.0::DOUBLE AS not_there FROM ({SCORED_SQL}) AS s")
def _(t):
    names = sp.source_columns(["a", "b"], {"a": "raw_score", "b": "not_there"})
    return sp.with_columns_or_zero(scored(t), ["machine_key", "anchor_date"], names)


# ------------------------------------------------------------------ cohorts
_LEAD_MAX, _LEAD_MIN, _DAYS = 75, 15, 60
# one case per customer and year: the last order of the year as claim
_EPISODES = "SELECT 'E' || cast(max(o_orderkey) as string) AS claim_episode_id, o_custkey AS machine_key, CAST(max(o_orderdate) AS DATE) AS claim_date FROM orders GROUP BY o_custkey, year(o_orderdate)"
_CLAIMS = "SELECT DISTINCT o_custkey AS machine_key, CAST(o_orderdate AS DATE) AS claim_date FROM orders"
_COVER = """SELECT o_custkey AS machine_key, min(CAST(l_shipdate AS DATE)) AS first_source_date, max(CAST(l_shipdate AS DATE)) AS last_source_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
_FLEET = f"""SELECT c_custkey AS machine_key, c_mktsegment AS full_model, CASE c_custkey % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' WHEN 2 THEN NULL ELSE 'train' END AS split, first_source_date, last_source_date FROM customer LEFT JOIN ({_COVER}) AS v ON v.machine_key = c_custkey"""
_DATES = "SELECT DISTINCT o_custkey AS machine_key, CAST(l_shipdate AS DATE) AS window_end FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_END = "(SELECT CAST(max(o_orderdate) AS DATE) FROM orders)"


def _episodes(t):
    return t("orders").groupBy("o_custkey", F.year("o_orderdate")).agg(
        F.concat(F.lit("E"), F.max("o_orderkey").cast("string")).alias("claim_episode_id"), F.to_date(F.max("o_orderdate")).alias("claim_date")
    ).select("claim_episode_id", F.col("o_custkey").alias("machine_key"), "claim_date")


def _claims(t):
    return t("orders").select(F.col("o_custkey").alias("machine_key"), F.to_date("o_orderdate").alias("claim_date")).distinct()


def _operation(t):
    keys = t("orders").select("o_orderkey", F.col("o_custkey").alias("machine_key"))
    return t("lineitem").join(keys, F.col("l_orderkey") == F.col("o_orderkey")).select("machine_key", F.to_date("l_shipdate").alias("event_day"))


def _once(t, name, build):
    """Input that several steps of a query read: computed and stored once for each run."""
    kept = t.__dict__.setdefault("kept", {})
    if name not in kept:
        kept[name] = cut_lineage(build(t))
    return kept[name]


def _fleet(t):
    return _once(t, "fleet", _covered_fleet)


def _covered_fleet(t):
    cover = source_coverage({"operation": (_operation(t), "event_day")}).select("machine_key", "first_source_date", "last_source_date")
    return t("customer").selectExpr(
        "c_custkey as machine_key", "c_mktsegment as full_model", "case c_custkey % 5 when 0 then 'test' when 1 then 'validation' when 2 then null else 'train' end as split"
    ).join(cover, "machine_key", "left")


def _end(t):
    return label_end([(t("orders"), "o_orderdate")])


_CASES = f"""SELECT e.*, f.full_model, f.split, CAST(claim_date - {_LEAD_MAX} AS DATE) AS window_start, CAST(claim_date - {_LEAD_MIN} AS DATE) AS window_end, 'w__' || claim_episode_id AS case_control_group_id,
 CASE WHEN f.split IS NULL THEN 'machine_missing_fixed_split_assignment' WHEN NOT coalesce(first_source_date <= claim_date - {_LEAD_MIN} AND last_source_date >= claim_date - {_LEAD_MAX}, FALSE) THEN 'positive_no_source_coverage_overlap_window' ELSE 'eligible' END AS reason
FROM ({_EPISODES}) AS e LEFT JOIN ({_FLEET}) AS f ON f.machine_key = e.machine_key"""
_GOOD = f"SELECT * FROM ({_CASES}) AS c WHERE reason = 'eligible'"


def _cases(t):
    fleet = _fleet(t)
    return ch.case_windows(_episodes(t), fleet, _LEAD_MAX, _LEAD_MIN, "w").join(fleet.select("machine_key", "full_model"), "machine_key", "left")


def _good(t):
    return _once(t, "good", _selected_cases)


def _selected_cases(t):
    return _cases(t).where("status = 'selected'").drop("first_source_date", "last_source_date")


@query("case_windows", "H1", f"SELECT claim_episode_id, machine_key, split, window_start, window_end, reason FROM ({_CASES}) AS c")
def _(t):
    return _cases(t).select("claim_episode_id", "machine_key", "split", "window_start", "window_end", "reason")


@query(
    "capped_cases", "H2",
    f"""WITH n AS (SELECT split, count(*) AS n FROM ({_GOOD}) AS g GROUP BY 1), r AS (SELECT *, 500 * n / sum(n) OVER () AS raw, count(*) OVER () AS splits, sum(n) OVER () AS total FROM n),
b AS (SELECT *, greatest(floor(raw), CASE WHEN 500 >= splits THEN 1 ELSE 0 END) AS base FROM r), s AS (SELECT *, 500 - sum(base) OVER () AS spare FROM b),
q AS (SELECT split, CASE WHEN total <= 500 THEN n ELSE base + CAST(row_number() OVER (ORDER BY raw - base DESC, n DESC, split) <= spare AS INT)
 - CAST(row_number() OVER (ORDER BY base DESC, raw DESC, split) <= -spare AS INT) END AS quota FROM s),
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY {_H("case_control_group_id")}, case_control_group_id) AS rn FROM ({_GOOD}) AS g)
SELECT case_control_group_id, machine_key, split FROM o JOIN q USING (split) WHERE rn <= quota""",
)
def _(t):
    return ch.capped_cases(_good(t), 500).select("case_control_group_id", "machine_key", "split")


_RING = "SELECT machine_key, full_model, split, first_source_date, last_source_date, row_number() OVER (PARTITION BY full_model, split ORDER BY {h}, machine_key) - 1 AS place, count(*) OVER (PARTITION BY full_model, split) AS size FROM ({src}) AS f WHERE split IS NOT NULL"
_PICK = lambda text: f"CAST(('0x' || {_H(text)})::UBIGINT % size::UBIGINT AS BIGINT)"
_DAY = lambda d: f"({d} - DATE '1970-01-01')"
_NUMBER = lambda text, count: f"CAST(('0x' || {_H(text)})::UBIGINT % ({count})::UBIGINT AS BIGINT)"


def _matched_sql(count: int) -> str:
    """The first ``count`` eligible candidates of every case on its walk through its day bin."""
    return f"""WITH seen AS (SELECT *, {_DAY('window_start')} - 30 AS lo, {_DAY('window_end')} + 180 AS hi, window_end - window_start AS width FROM ({_GOOD}) AS c WHERE window_end + 180 <= {_END}),
spans AS (SELECT min(lo) AS low, max(lo) AS high, min(width) AS short, max(width) AS long FROM seen), days AS (SELECT machine_key, {_DAY('claim_date')} AS day FROM ({_CLAIMS}) AS k),
gaps AS (SELECT machine_key, NULL AS a, min(day) - 1 AS z FROM days GROUP BY 1 UNION ALL SELECT machine_key, day + 1, lead(day) OVER (PARTITION BY machine_key ORDER BY day) - 1 FROM days),
free AS (SELECT f.full_model, f.split, f.machine_key, a, z, {_DAY('first_source_date')} AS first, {_DAY('last_source_date')} AS last, low, high, short, long
 FROM (SELECT * FROM ({_FLEET}) AS f WHERE split IS NOT NULL AND first_source_date IS NOT NULL) AS f LEFT JOIN gaps g ON g.machine_key = f.machine_key, spans),
fits AS (SELECT *, greatest(a, first - long - 30, low) AS b, least(z - short - 210, last - 30, high) AS e FROM free),
listed AS (SELECT *, unnest(range(b // 30, e // 30 + 1)) AS bin FROM fits WHERE b <= e),
placed AS (SELECT *, row_number() OVER (PARTITION BY full_model, split, bin ORDER BY {_H("'controlled|' || cast(machine_key as string)")}, machine_key) - 1 AS place, count(*) OVER (PARTITION BY full_model, split, bin) AS size FROM listed),
sizes AS (SELECT full_model, split, bin, any_value(size) AS size, CAST(1 << length(bin(any_value(size) - 1)) AS BIGINT) AS span FROM placed GROUP BY 1, 2, 3),
walks AS (SELECT c.*, s.bin, span, 2 * {_NUMBER("c.case_control_group_id || '|controlled|stride'", "span // 2")} + 1 AS stride, {_NUMBER("c.case_control_group_id || '|controlled|shift'", "span")} AS shift FROM seen c JOIN sizes s ON s.full_model = c.full_model AND s.split = c.split AND s.bin = c.lo // 30),
steps AS (SELECT *, (stride * step + shift) % span AS place FROM (SELECT *, unnest(range(0, span)) AS step FROM walks) AS w)
SELECT w.case_control_group_id, w.machine_key AS case_machine_key, p.machine_key, window_start, window_end, row_number() OVER (PARTITION BY w.case_control_group_id ORDER BY step) AS control_number
FROM steps w JOIN placed p ON p.full_model = w.full_model AND p.split = w.split AND p.bin = w.bin AND p.place = w.place
WHERE p.machine_key <> w.machine_key AND coalesce(a <= lo, TRUE) AND coalesce(hi <= z, TRUE) AND first <= {_DAY('window_end')} AND last >= {_DAY('window_start')} QUALIFY control_number <= {count}"""


_MATCHED = _matched_sql(3)


def _matched(t, count=3):
    return ch.matched_controls(_good(t), _fleet(t).where("split is not null"), _claims(t), _end(t), count)


@query("matched_controls", "H3 J6", _MATCHED)
def _(t):
    return _matched(t).select("case_control_group_id", "case_machine_key", "machine_key", "window_start", "window_end", "control_number")


@query(
    "control_audit", "H3 H6",
    f"""SELECT c.case_control_group_id, c.machine_key, c.split, coalesce(n, 0) AS selected_negative_count, 3 AS requested_negative_count,
 CASE WHEN coalesce(n, 0) = 0 THEN 'case_excluded_no_eligible_negatives' ELSE 'selected' END AS status
FROM ({_GOOD}) AS c LEFT JOIN (SELECT case_control_group_id, count(*) AS n FROM ({_MATCHED}) AS m GROUP BY 1) AS m USING (case_control_group_id)""",
)
def _(t):
    return ch.control_audit(_good(t), _matched(t), 3)


_ELIGIBLE = f"""SELECT d.machine_key, CAST(d.window_end - {_DAYS} AS DATE) AS window_start, d.window_end, f.full_model, f.split FROM ({_DATES}) AS d JOIN ({_FLEET}) AS f ON f.machine_key = d.machine_key
WHERE f.first_source_date <= d.window_end AND f.last_source_date >= d.window_end - {_DAYS} AND d.window_end + 180 <= {_END}
AND NOT EXISTS (SELECT 1 FROM ({_CLAIMS}) AS k WHERE k.machine_key = d.machine_key AND k.claim_date BETWEEN d.window_end - {_DAYS} - 30 AND d.window_end + 180)"""


def _eligible(t):
    return ch.eligible_windows(ch.activity_dates(_operation(t), []), _fleet(t), _claims(t), _DAYS, _end(t))


@query("eligible_windows", "H4", f"SELECT machine_key, window_start, window_end FROM ({_ELIGIBLE}) AS e")
def _(t):
    return _eligible(t).select("machine_key", "window_start", "window_end")


_random_sql = lambda count: f"""SELECT s.case_control_group_id, s.case_machine_key, s.machine_key, e.window_start, e.window_end, s.control_number FROM (
SELECT *, row_number() OVER (PARTITION BY case_control_group_id ORDER BY step) AS control_number FROM (SELECT c.case_control_group_id, c.machine_key AS case_machine_key, r.machine_key, (r.place - {_PICK("c.case_control_group_id || '|random'")} + size) % size AS step
FROM ({_GOOD}) AS c JOIN ({_RING.format(h=_H("'random|' || cast(machine_key as string)"), src=f"SELECT * FROM ({_FLEET}) AS f WHERE machine_key IN (SELECT machine_key FROM ({_ELIGIBLE}) AS e)")}) AS r ON r.full_model = c.full_model AND r.split = c.split AND r.machine_key <> c.machine_key) AS x QUALIFY control_number <= {count}) AS s
JOIN (SELECT *, row_number() OVER (PARTITION BY machine_key ORDER BY window_end) - 1 AS turn, count(*) OVER (PARTITION BY machine_key) AS n FROM ({_ELIGIBLE}) AS e) AS e
 ON e.machine_key = s.machine_key AND e.turn = CAST(('0x' || {_H("s.case_control_group_id || '|' || cast(s.machine_key as string) || '|window'")})::UBIGINT % e.n::UBIGINT AS BIGINT)"""


@query("random_controls", "H5 B18", _random_sql(2))
def _(t):
    return ch.random_controls(_good(t), _fleet(t).where("split is not null"), _eligible(t), 2).select(
        "case_control_group_id", "case_machine_key", "machine_key", "window_start", "window_end", "control_number"
    )


@query(
    "mixed_controls", "H6",
    f"""WITH c AS ({_MATCHED}), r AS ({_random_sql(6)}), both_kinds AS (
SELECT case_control_group_id, machine_key, window_start, window_end, 'controlled' AS negative_sampling_type, CASE WHEN control_number <= 2 THEN 0 ELSE 2 END AS class, control_number FROM c
UNION ALL SELECT case_control_group_id, machine_key, window_start, window_end, 'random', 1, control_number FROM r),
once AS (SELECT * FROM both_kinds QUALIFY row_number() OVER (PARTITION BY case_control_group_id, machine_key ORDER BY class, control_number) = 1)
SELECT case_control_group_id, machine_key, window_start, window_end, negative_sampling_type, row_number() OVER (PARTITION BY case_control_group_id ORDER BY class, control_number, machine_key) AS control_number_within_group
FROM once QUALIFY control_number_within_group <= 3""",
)
def _(t):
    fleet = _fleet(t).where("split is not null")
    random = ch.random_controls(_good(t), fleet, _eligible(t), 3, spare=3)
    return ch.mixed_controls(_matched(t), random, 3).select(
        "case_control_group_id", "machine_key", "window_start", "window_end", "negative_sampling_type", "control_number_within_group"
    )


@query(
    "fixed_horizon_windows", "H7",
    f"""WITH b AS (SELECT *, CAST(first_source_date + {_DAYS} AS DATE) AS lo, least(last_source_date, CAST({_END} - 365 AS DATE)) AS hi FROM ({_FLEET}) AS f WHERE split IN ('validation', 'test')), d AS ({_DATES}),
i AS (SELECT d.machine_key, d.window_end, row_number() OVER (PARTITION BY d.machine_key ORDER BY d.window_end) - 1 AS turn, count(*) OVER (PARTITION BY d.machine_key) AS n, b.split FROM d JOIN b ON b.machine_key = d.machine_key AND d.window_end BETWEEN b.lo AND b.hi),
p AS (SELECT * FROM i WHERE turn = CAST(('0x' || {_H("'w|' || split || '|' || cast(machine_key as string) || '|fixed_horizon_window'")})::UBIGINT % n::UBIGINT AS BIGINT)), r AS (SELECT machine_key, count(*) AS raw FROM d GROUP BY 1)
SELECT b.machine_key, b.split, CASE WHEN b.first_source_date IS NULL THEN 'missing_source_coverage' WHEN r.raw IS NULL THEN 'no_activity_dates' WHEN b.hi < b.lo THEN 'insufficient_history_or_future_followup' WHEN p.window_end IS NULL THEN 'no_activity_date_in_eligible_range' ELSE 'eligible' END AS reason,
 coalesce(r.raw, 0) AS candidate_activity_dates, coalesce(p.n, 0) AS eligible_activity_dates, CAST(p.window_end - {_DAYS} AS DATE) AS window_start, p.window_end FROM b LEFT JOIN r USING (machine_key) LEFT JOIN p ON p.machine_key = b.machine_key""",
)
def _(t):
    holdout = _fleet(t).where("split in ('validation', 'test')").drop("full_model")
    return ch.fixed_horizon_windows(holdout, ch.activity_dates(_operation(t), []), _end(t), _DAYS, 365, name="w")


_POSC = f"""SELECT * FROM (SELECT *, {_H("'s|' || split || '|' || cast(machine_key as string) || '|' || claim_episode_id || '|positive_claim_window'")} AS h FROM ({_GOOD}) AS g WHERE split IN ('validation', 'test')) AS q QUALIFY row_number() OVER (PARTITION BY split, machine_key ORDER BY h, claim_date, claim_episode_id) = 1"""
_NEGC = f"""SELECT split, machine_key, window_start, window_end, {_H("'s|' || split || '|' || cast(machine_key as string) || '|order'")} AS h FROM (SELECT *, row_number() OVER (PARTITION BY machine_key ORDER BY window_end) - 1 AS turn, count(*) OVER (PARTITION BY machine_key) AS n FROM ({_ELIGIBLE}) AS e WHERE split IN ('validation', 'test')) AS w
WHERE turn = CAST(('0x' || {_H("'s|' || split || '|' || cast(machine_key as string) || '|random_holdout_negative_window'")})::UBIGINT % n::UBIGINT AS BIGINT)"""


def _pool(t, ratio=2):
    pos = ch.one_case_per_entity(_good(t).where("split in ('validation', 'test')"), 42, "s")
    windows = _eligible(t).join(_fleet(t).where("split in ('validation', 'test')").select("machine_key", "split"), "machine_key")
    text = lambda end: ch.stable_hash(42, F.lit("s|"), F.col("split"), F.lit("|"), F.col("machine_key"), F.lit(end))
    neg = ch.chosen_window(windows, text("|random_holdout_negative_window")).withColumn("__hash", text("|order"))
    return ch.joint_ratio_pool(pos, neg, ratio)


_POOL = f"""WITH pos AS ({_POSC}), neg AS ({_NEGC}), pr AS (SELECT p.split, p.machine_key, p.window_start, p.window_end, row_number() OVER (PARTITION BY p.split ORDER BY p.h, p.machine_key) AS rk, count(n.machine_key) OVER (PARTITION BY p.split ORDER BY p.h, p.machine_key ROWS UNBOUNDED PRECEDING) AS taken,
 count(*) OVER (PARTITION BY p.split) AS np, count(n.machine_key) OVER (PARTITION BY p.split) AS ov FROM pos p LEFT JOIN neg n ON n.machine_key = p.machine_key AND n.split = p.split), nn AS (SELECT split, count(*) AS n FROM neg GROUP BY 1),
best AS (SELECT pr.split, max(rk) AS best FROM pr JOIN nn ON nn.split = pr.split WHERE nn.n - taken >= rk * 2 AND rk <= floor((np + nn.n - ov) / 3.0) GROUP BY 1), ch AS (SELECT pr.* FROM pr JOIN best b ON b.split = pr.split WHERE rk <= best),
ng AS (SELECT n.*, row_number() OVER (PARTITION BY n.split ORDER BY n.h, n.machine_key) AS nr FROM neg n WHERE n.machine_key NOT IN (SELECT machine_key FROM ch))
SELECT split, machine_key, window_start, window_end, 1 AS target, rk AS positive_rank, NULL AS negative_rank FROM ch UNION ALL SELECT ng.split, machine_key, window_start, window_end, 0, NULL, nr FROM ng JOIN best b ON b.split = ng.split WHERE nr <= best * 2"""


@query("random_ratio_pool", "H8", _POOL)
def _(t):
    return _pool(t)


@query("nested_ratio_cohorts", "H12", f"""WITH pool AS ({_POOL}), s AS (SELECT split, count(*) AS p FROM pool WHERE target = 1 GROUP BY 1) SELECT pool.split, machine_key, target, r AS ratio FROM pool JOIN s ON s.split = pool.split, (VALUES (1), (2)) AS q(r) WHERE target = 1 OR negative_rank <= r * p""")
def _(t):
    return ch.nested_ratios(_pool(t), (1, 2)).select("split", "machine_key", "target", "ratio")


@query("controlled_ratio_pool", "H9")
def _(t):
    cases = ch.one_case_per_entity(_good(t).where("split in ('validation', 'test')"), 42, "s")
    fleet = _fleet(t).where("split in ('validation', 'test')")
    return ch.controlled_ratio_pool(cases, fleet, _claims(t), _end(t), 2).select("case_control_group_id", "machine_key", "split", "target", "control_rank")


_HROWS = f"SELECT model_id AS machine_key, CASE WHEN CAST(right(model_id, 1) AS INT) % 2 = 0 THEN 'validation' ELSE 'test' END AS split, days_to_next_claim_on_or_after_window_end AS d, snapshot_date FROM ({NEXT_SQL}) AS n"


@query(
    "horizon_ratio_cohorts", "H13",
    f"""WITH r AS (SELECT snapshot_date, machine_key, split, h AS horizon, CAST(coalesce(d BETWEEN 0 AND h, FALSE) AS INT) AS target FROM ({_HROWS}) AS x, (VALUES (30), (90)) AS q(h)),
k AS (SELECT *, row_number() OVER (PARTITION BY snapshot_date, split, horizon, target ORDER BY {_H("'horizon_specific_random|' || split || '|' || cast(horizon as string) || '|' || machine_key")}, machine_key) AS rank FROM r),
c AS (SELECT snapshot_date, split, horizon, least(sum(target), floor(sum(1 - target) / 3.0)) AS take FROM r GROUP BY 1, 2, 3)
SELECT k.snapshot_date, k.machine_key, k.split, k.horizon, ratio, target, rank FROM k JOIN c ON c.snapshot_date = k.snapshot_date AND c.split = k.split AND c.horizon = k.horizon, (VALUES (1), (3)) AS z(ratio) WHERE (target = 1 AND rank <= take) OR (target = 0 AND rank <= take * ratio)""",
)
def _(t):
    rows = with_next(t).selectExpr(
        "snapshot_date", "model_id as machine_key", "if(cast(right(model_id, 1) as int) % 2 = 0, 'validation', 'test') as split", f"{lb.LEAD_DAYS} as d"
    )
    return ch.horizon_ratio_cohorts(rows, "d", (30, 90), (1, 3), group=["snapshot_date"])


_FEAS = f"""WITH cand AS (SELECT DISTINCT CAST(claim_date - CAST(i AS INT) AS DATE) AS a FROM ({_CLAIMS}) AS k, range(0, {_LEAD_MIN + 1}) AS g(i) WHERE claim_date - CAST(i AS INT) BETWEEN DATE '1995-01-01' + {_DAYS} AND {_END} - 180),
f AS (SELECT * FROM ({_FLEET}) AS x WHERE split IS NOT NULL), hits AS (SELECT DISTINCT machine_key, CAST(claim_date - CAST(i AS INT) AS DATE) AS a FROM ({_CLAIMS}) AS k, range(0, {_LEAD_MIN + 1}) AS g(i)),
e AS (SELECT a, f.split, count(*) AS eligible_machines FROM cand JOIN f ON f.first_source_date <= a AND f.last_source_date >= a - {_DAYS} GROUP BY 1, 2),
p AS (SELECT h.a, f.split, count(*) AS positive_machines FROM hits h JOIN f ON f.machine_key = h.machine_key AND f.first_source_date <= h.a AND f.last_source_date >= h.a - {_DAYS} GROUP BY 1, 2)
SELECT cand.a AS anchor_date, s.split, coalesce(e.eligible_machines, 0) AS eligible_machines, coalesce(p.positive_machines, 0) AS positive_machines FROM cand CROSS JOIN (SELECT DISTINCT split FROM f) AS s LEFT JOIN e ON e.a = cand.a AND e.split = s.split LEFT JOIN p ON p.a = cand.a AND p.split = s.split"""


def _feasibility(t, ratio=2):
    return ch.anchor_feasibility(_fleet(t), _claims(t), _LEAD_MIN, _DAYS, "1995-01-01", _end(t), 180, ratio)


@query("anchor_feasibility", "H10 H14", f"SELECT *, eligible_machines - positive_machines AS negative_machines, least(positive_machines, floor((eligible_machines - positive_machines) / 2.0)) AS capacity FROM ({_FEAS}) AS q")
def _(t):
    return _feasibility(t)


_CHOSEN = f"""WITH q AS (SELECT *, least(positive_machines, floor((eligible_machines - positive_machines) / 2.0)) AS cap FROM ({_FEAS}) AS z WHERE split IN ('validation', 'test')), m AS (SELECT anchor_date, min(cap) AS c FROM q GROUP BY 1)
SELECT anchor_date, c AS common_capacity FROM m ORDER BY CASE WHEN c >= 9 THEN 0 ELSE 1 END, CASE WHEN c >= 9 THEN 0 ELSE -c END, {_H("'s|' || cast(anchor_date as string) || '|as_of_anchor_date'")} LIMIT 1"""


def _chosen(t):
    return cut_lineage(ch.pick_anchor(_feasibility(t), ["validation", "test"], 9, 42, "s"))


@query("chosen_anchor", "H11", _CHOSEN)
def _(t):
    return _chosen(t)


def _spaced_sql(name: str, pool: str, count: int, gap: int) -> str:
    """CTEs ``name_0`` ...: one date after the other, nearest to even positions, then the first others that fit."""
    picks = [f"{name}_{k}" for k in range(2 * count)]
    parts = [f"{name}_p AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i, count(*) OVER () AS n FROM ({pool}) AS x)"]
    for k, pick in enumerate(picks):
        far = "".join(f" AND NOT EXISTS (SELECT 1 FROM {p} AS q WHERE abs(p.d - q.d) < {gap})" for p in picks[:k])
        if k < count:
            parts.append(f"{pick} AS (SELECT d FROM {name}_p AS p WHERE {k} < n{far} ORDER BY abs(i - (n - 1) * {k} / greatest(least({count}, n) - 1, 1)), d LIMIT 1)")
        else:
            have = " + ".join(f"(SELECT count(*) FROM {p})" for p in picks[:k])
            parts.append(f"{pick} AS (SELECT d FROM {name}_p AS p WHERE {have} < {count}{far} ORDER BY d LIMIT 1)")
    return ",\n".join([*parts, f"{name} AS ({' UNION ALL '.join(f'SELECT d FROM {p}' for p in picks)})"])


_GAP, _LEAST_FLEET, _LEAST_POSITIVES = 60, 50, 3
_ANCHORS = f"""WITH ok AS (SELECT split, anchor_date AS d FROM ({_FEAS}) AS z WHERE split IN ('validation', 'test') AND eligible_machines >= {_LEAST_FLEET} AND positive_machines >= {_LEAST_POSITIVES} AND eligible_machines - positive_machines >= 1),
border AS (SELECT list_sort(list(DISTINCT d))[CAST(floor((count(DISTINCT d) - 1) * 0.7::DOUBLE) AS INT) + 1] AS b FROM ok),
{_spaced_sql("v", "SELECT d FROM ok, border WHERE split = 'validation' AND (d <= b OR NOT EXISTS (SELECT 1 FROM ok, border WHERE split = 'validation' AND d <= b))", 3, _GAP)},
latest AS (SELECT coalesce((SELECT max(d) FROM v), b) AS l, b FROM border),
late AS (SELECT d, CASE WHEN d - l >= 30 AND d > b THEN 1 WHEN d > l THEN 2 ELSE 3 END AS class FROM ok, latest WHERE split = 'test'),
{_spaced_sql("w", "SELECT d FROM late WHERE class = 1 OR NOT EXISTS (SELECT 1 FROM late WHERE class = 1) AND (class = 2 OR NOT EXISTS (SELECT 1 FROM late WHERE class = 2))", 2, _GAP)}
SELECT 'validation' AS split, d FROM v UNION ALL SELECT 'test', d FROM w"""
_FLEET_AT_SQL = lambda anchors: f"""SELECT f.machine_key, f.split, a.d AS anchor_date, CAST(a.d - {_DAYS} AS DATE) AS window_start, (SELECT min(claim_date) FROM ({_CLAIMS}) AS k WHERE k.machine_key = f.machine_key AND k.claim_date >= a.d) AS next_claim_date
FROM ({_FLEET}) AS f JOIN ({anchors}) AS a ON a.split = f.split WHERE f.split IN ('validation', 'test') AND f.first_source_date <= a.d AND f.last_source_date >= a.d - {_DAYS}"""
_FLEET_AT = _FLEET_AT_SQL(_ANCHORS)


def _anchors(t):
    return cut_lineage(ch.fleet_anchor_dates(_feasibility(t), {"validation": 3, "test": 2}, _GAP, _LEAST_FLEET, _LEAST_POSITIVES))


def _holdout_fleet(t):
    return _fleet(t).where("split in ('validation', 'test')").drop("full_model")


def _fleet_at(t):
    return ch.fleet_at_anchors(_holdout_fleet(t), _claims(t), _anchors(t), _DAYS, 90)


@query(
    "fleet_at_anchors", "H15 H10 J4",
    f"SELECT machine_key, split, anchor_date, window_start, next_claim_date, date_diff('day', anchor_date, next_claim_date) AS days_to_next_claim, CAST(coalesce(next_claim_date <= anchor_date + 90, FALSE) AS INT) AS target FROM ({_FLEET_AT}) AS x",
)
def _(t):
    return _fleet_at(t).select("machine_key", "split", "anchor_date", "window_start", "next_claim_date", "days_to_next_claim", "target")


@query(
    "anchor_ratio_pool", "H11",
    f"""WITH x AS (SELECT *, CAST(coalesce(next_claim_date <= anchor_date + 90, FALSE) AS INT) AS target FROM ({_FLEET_AT_SQL(f"SELECT split, anchor_date AS d FROM ({_CHOSEN}) AS c, (VALUES ('validation'), ('test')) AS s(split)")}) AS y),
k AS (SELECT *, row_number() OVER (PARTITION BY split, target ORDER BY {_H("'s|' || cast(anchor_date as string) || '|' || split || '|' || cast(machine_key as string) || '|' || CASE target WHEN 1 THEN 'as_of_positive' ELSE 'as_of_negative' END")}, machine_key) AS rk FROM x),
c AS (SELECT split, least(sum(target), floor(sum(1 - target) / 2.0)) AS take FROM x GROUP BY 1)
SELECT k.split, machine_key, anchor_date, target, CASE WHEN target = 1 THEN rk END AS positive_rank, CASE WHEN target = 0 THEN rk END AS negative_rank FROM k JOIN c ON c.split = k.split WHERE rk <= CASE WHEN target = 1 THEN take ELSE take * 2 END""",
)
def _(t):
    anchors = _chosen(t).select("anchor_date", F.explode(F.array(F.lit("validation"), F.lit("test"))).alias("split"))
    fleet = ch.fleet_at_anchors(_holdout_fleet(t), _claims(t), anchors, _DAYS, 90)
    return ch.anchor_ratio_pool(fleet, 2, 42, "s").select("split", "machine_key", "anchor_date", "target", "positive_rank", "negative_rank")


@query(
    "capped_fleet", "H15",
    f"""WITH x AS (SELECT *, CAST(coalesce(next_claim_date <= anchor_date + 90, FALSE) AS INT) AS target FROM ({_FLEET_AT}) AS y)
SELECT machine_key, split, anchor_date, target FROM x QUALIFY row_number() OVER (PARTITION BY split, anchor_date ORDER BY target DESC, {_H("cast(anchor_date as string) || '|' || cast(machine_key as string) || '|fleet_cap'")}, machine_key) <= 150 OR target = 1""",
)
def _(t):
    return ch.capped_fleet(_fleet_at(t), 150).select("machine_key", "split", "anchor_date", "target")


@query(
    "multi_anchor_fleet", "H14 C20",
    f"SELECT split, anchor_date, count(*) AS machines, CAST(sum(CAST(coalesce(next_claim_date <= anchor_date + 90, FALSE) AS INT)) AS BIGINT) AS positives FROM ({_FLEET_AT}) AS x GROUP BY 1, 2",
)
def _(t):
    return _fleet_at(t).groupBy("split", "anchor_date").agg(F.count(F.lit(1)).alias("machines"), F.sum("target").alias("positives"))


_NEGATIVES = f"""WITH w AS (SELECT d.machine_key, f.split, d.window_end, CAST(d.window_end - {_DAYS} AS DATE) AS window_start, (SELECT min(claim_date) FROM ({_CLAIMS}) AS k WHERE k.machine_key = d.machine_key AND k.claim_date >= d.window_end) AS nx
 FROM ({_DATES}) AS d JOIN ({_FLEET}) AS f ON f.machine_key = d.machine_key WHERE f.split IN ('validation', 'test') AND f.first_source_date <= d.window_end AND f.last_source_date >= d.window_end - {_DAYS}
 AND NOT EXISTS (SELECT 1 FROM ({_CLAIMS}) AS k WHERE k.machine_key = d.machine_key AND k.claim_date BETWEEN d.window_end - {_DAYS} - 30 AND d.window_end + {_LEAD_MIN})),
t AS (SELECT *, date_diff('day', window_end, nx) AS away FROM w), y AS (SELECT *, 'delayed_claim_negative' AS negative_case_type, CASE {' '.join(f"WHEN away <= {hi} THEN '{lo + 1}-{hi}d'" for lo, hi in ch.lead_bins(_LEAD_MIN, 180, 60))} END AS lead_bin FROM t WHERE away <= 180
 UNION ALL SELECT *, 'strict_negative', 'no_claim_within_strict_window' FROM t WHERE window_end + 180 <= {_END} AND (away IS NULL OR away > 180))
SELECT machine_key, split, window_start, window_end, negative_case_type, lead_bin FROM y QUALIFY row_number() OVER (PARTITION BY split, negative_case_type, lead_bin, machine_key ORDER BY {_H("'42|' || cast(machine_key as string) || '|' || negative_case_type || '|' || lead_bin || '|' || cast(window_end as string)")}) = 1"""


@query("negative_candidates", "H16", _NEGATIVES)
def _(t):
    return _negatives(t).select("machine_key", "split", "window_start", "window_end", "negative_case_type", "lead_bin")


def _negatives(t):
    fleet = _fleet(t).where("split in ('validation', 'test')")
    return ch.negative_candidates(ch.activity_dates(_operation(t), []), fleet, _claims(t), _end(t), _DAYS, _LEAD_MIN, 180, 60)


def _balanced_sql(requested: int) -> str:
    """CTEs that take one lead bin after the other, then the fill and the strict ones, each without the entities before."""
    bins = sorted(f"{lo + 1}-{hi}d" for lo, hi in ch.lead_bins(_LEAD_MIN, 180, 60))
    steps = [(f"negative_case_type = 'delayed_claim_negative' AND lead_bin = '{name}'", f"delayed|{name}", str(requested // len(bins) + (i < requested % len(bins)))) for i, name in enumerate(bins)]
    steps.append(("negative_case_type = 'delayed_claim_negative'", "delayed_fill", None))
    steps.append(("negative_case_type = 'strict_negative'", "strict", str(requested)))
    parts, taken = [f"cand AS ({_NEGATIVES})"], []
    for i, (where, tag, quota) in enumerate(steps):
        before = "".join(f" AND NOT EXISTS (SELECT 1 FROM s{k} WHERE s{k}.split = c.split AND s{k}.machine_key = c.machine_key)" for k in taken)
        digest = _H(f"'42|{tag}|' || cast(machine_key as string) || '|' || cast(window_end as string)")
        have = " + ".join(f"(SELECT count(*) FROM s{k} WHERE s{k}.split = o.split)" for k in taken)
        parts.append(f"""s{i} AS (SELECT * EXCLUDE (h) FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY h, machine_key) AS rk FROM (
SELECT *, {digest} AS h FROM cand c WHERE {where}{before} QUALIFY row_number() OVER (PARTITION BY split, machine_key ORDER BY h, lead_bin) = 1) AS one) AS o WHERE rk <= {quota or f'{requested} - ({have})'})""")
        taken.append(i)
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT machine_key, split, negative_case_type, lead_bin FROM s{k}" for k in taken)


@query("balanced_negatives", "H16", _balanced_sql(40))
def _(t):
    return ch.balanced_negatives(_negatives(t), 40).select("machine_key", "split", "negative_case_type", "lead_bin")
