"""Spines, calendars, rosters, coverage, joins on time and label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels as lb
from tidemark.operators import spine as sp
from tidemark.operators.segments import segment_of
from tidemark.operators.temporal import anti_range, asof_join, range_join, session_starts
from tidemark.plans import roles
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.plans.snapshot_queries import CLAIM_SQL
from tidemark.sources import standardize as std

# order days as a backbone: several rows per customer and day are possible
_BACK_SQL = """SELECT 'K' || cast(o_custkey as string) AS model_id, CAST(o_orderdate AS DATE) AS snapshot_date, o_orderpriority AS full_model,
 o_orderkey AS orderkey, o_totalprice AS price FROM orders"""


def _back(t):
    return t("orders").selectExpr(
        "concat('K', o_custkey) as model_id", "cast(o_orderdate as date) as snapshot_date",
        "o_orderpriority as full_model", "o_orderkey as orderkey", "o_totalprice as price",
    )


_FAMILY = r"regexp_matches(full_model, '\b(?:1-URGENT|2-HIGH|5-LOW)')"


@query(
    "unique_backbone", "C1 B17",
    f"""SELECT model_id, snapshot_date, full_model, orderkey AS machine_orderkey, price AS machine_price FROM (
SELECT *, row_number() OVER (PARTITION BY model_id, snapshot_date ORDER BY orderkey DESC) AS rn FROM ({_BACK_SQL}) AS b WHERE {_FAMILY}) AS r WHERE rn = 1""",
)
def _(t):
    from tidemark.functions.keys import family_filter

    keep = family_filter(["1-URGENT", "2-HIGH", "5-LOW"], F.col("full_model"))
    return sp.unique_backbone(_back(t), "model_id", "snapshot_date", ["orderkey"], keep)


@query(
    "exact_calendar", "C2",
    """WITH b AS (SELECT o_custkey, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders GROUP BY 1),
g AS (SELECT CAST(d AS DATE) AS day FROM generate_series(TIMESTAMP '1994-12-20', TIMESTAMP '2002-01-01', INTERVAL 45 DAY) AS s(d))
SELECT o_custkey, day FROM b JOIN g ON day BETWEEN f AND l""",
)
def _(t):
    bounds = t("orders").groupBy("o_custkey").agg(
        F.min(F.to_date("o_orderdate")).alias("f"), F.max(F.to_date("o_orderdate")).alias("l")
    )
    return bounds.select("o_custkey", F.explode(sp.calendar(F.col("f"), F.col("l"), 45, "1994-12-20")).alias("day"))


_REBUILD_SQL = f"""WITH b AS ({_BACK_SQL}), k AS (SELECT model_id, min(snapshot_date) AS f, max(snapshot_date) AS l FROM b GROUP BY 1),
g AS (SELECT CAST(d AS DATE) AS day FROM (SELECT min(snapshot_date) AS o, max(snapshot_date) AS e FROM b) AS x, generate_series(CAST(o AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 45 DAY) AS s(d))"""


@query("rebuilt_spine", "C3 C6", f"{_REBUILD_SQL} SELECT model_id, day AS snapshot_date FROM k JOIN g ON day BETWEEN f AND l")
def _(t):
    return sp.rebuild_spine(_back(t), "model_id", "snapshot_date", 45)


@query(
    "spine_with_latest_attributes", "C4 J4",
    f"""{_REBUILD_SQL}, s AS (SELECT model_id, CAST(d AS DATE) AS snapshot_date FROM k, generate_series(CAST(f AS TIMESTAMP), CAST(l AS TIMESTAMP), INTERVAL 60 DAY) AS q(d)),
daily AS (SELECT model_id, snapshot_date AS seen, max(orderkey) AS orderkey FROM b GROUP BY 1, 2)
SELECT s.model_id, s.snapshot_date, d.orderkey FROM s ASOF JOIN daily d ON s.model_id = d.model_id AND s.snapshot_date >= d.seen""",
)
def _(t):
    return sp.rebuild_spine(_back(t), "model_id", "snapshot_date", 60, "per_key", columns=["orderkey"])


@query(
    "greedy_dates", "C5",
    f"""WITH RECURSIVE d AS (SELECT DISTINCT model_id, snapshot_date FROM ({_BACK_SQL}) AS b),
pick AS (SELECT model_id, min(snapshot_date) AS snapshot_date FROM d GROUP BY 1
 UNION ALL SELECT p.model_id, (SELECT min(x.snapshot_date) FROM d x WHERE x.model_id = p.model_id AND x.snapshot_date >= p.snapshot_date + 200) FROM pick p
 WHERE EXISTS (SELECT 1 FROM d x WHERE x.model_id = p.model_id AND x.snapshot_date >= p.snapshot_date + 200))
SELECT model_id, snapshot_date FROM pick""",
)
def _(t):
    return sp.greedy_dates(_back(t), "model_id", "snapshot_date", 200)


@query(
    "limited_spine", "C6",
    f"""SELECT model_id, snapshot_date, orderkey FROM ({_BACK_SQL}) AS b WHERE snapshot_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'
AND model_id IN (SELECT DISTINCT model_id FROM ({_BACK_SQL}) AS c WHERE snapshot_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' ORDER BY 1 LIMIT 300)""",
)
def _(t):
    inside = sp.bounded_spine(_back(t), "snapshot_date", "1996-01-01", "1998-12-31")
    return sp.first_entities(inside, "model_id", 300).select("model_id", "snapshot_date", "orderkey")


@query(
    "complete_horizon_spine", "C7 C8",
    f"""WITH e AS (SELECT max(d) AS e FROM (SELECT CAST(max(o_orderdate) AS DATE) AS d FROM orders UNION ALL SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem) AS u)
SELECT s.model_id, s.snapshot_date FROM ({roles.ORDER_SPINE_SQL}) AS s, e WHERE s.snapshot_date <= e - 179""",
)
def _(t):
    end = sp.label_end([(t("orders"), "o_orderdate"), (t("lineitem"), "l_shipdate")])
    return sp.complete_horizon(roles.order_spine(t), end, 180).select("model_id", "snapshot_date")


@query(
    "spine_problems", "C9",
    f"""WITH b AS (SELECT CASE WHEN orderkey % 97 = 0 THEN NULL ELSE model_id END AS model_id, CASE WHEN orderkey % 101 = 0 THEN NULL ELSE snapshot_date END AS d FROM ({_BACK_SQL}) AS x)
SELECT count(*) FILTER (WHERE model_id IS NULL) AS missing_key_rows, count(*) FILTER (WHERE d IS NULL) AS missing_day_rows,
 count(*) - (SELECT count(*) FROM (SELECT DISTINCT model_id, d FROM b) AS q) AS duplicate_rows FROM b""",
)
def _(t):
    rows = _back(t).withColumns(
        {"model_id": F.expr("if(orderkey % 97 = 0, null, model_id)"),
         "snapshot_date": F.expr("if(orderkey % 101 = 0, null, snapshot_date)")}
    )
    return sp.spine_problems(rows, "model_id", "snapshot_date")


@query(
    "alignment_report", "C10 J8",
    f"""WITH a AS ({_BACK_SQL}), l AS (SELECT DISTINCT model_id, snapshot_date FROM a WHERE orderkey % 5 <> 0), r AS (SELECT model_id, snapshot_date FROM a WHERE orderkey % 7 <> 0),
rd AS (SELECT DISTINCT * FROM r)
SELECT 'orders' AS source, (SELECT count(*) FROM l) AS spine_rows, (SELECT count(*) FROM r) AS snapshot_rows,
 (SELECT count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM rd) AS x) AS missing_keys, (SELECT count(*) FROM (SELECT * FROM rd EXCEPT SELECT * FROM l) AS x) AS extra_keys,
 (SELECT count(*) FROM r) - (SELECT count(*) FROM rd) AS duplicate_rows""",
)
def _(t):
    rows = _back(t)
    spine = rows.where("orderkey % 5 <> 0").select("model_id", "snapshot_date").distinct()
    return sp.alignment_report(spine, rows.where("orderkey % 7 <> 0"), ["model_id", "snapshot_date"], "orders")


@query(
    "validated_join", "J1 J2",
    "SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    customers = sp.require_unique(t("customer"), ["c_custkey"])
    return t("orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query(
    "fleet_roster", "C12",
    """SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 400000 UNION SELECT c_custkey FROM customer WHERE c_acctbal < 1000 UNION SELECT user_id FROM events) AS u WHERE k IS NOT NULL""",
)
def _(t):
    return sp.fleet_roster(
        [t("orders").where("o_totalprice > 400000").selectExpr("o_custkey as k"),
         t("customer").where("c_acctbal < 1000").selectExpr("c_custkey as k"), t("events").selectExpr("user_id as k")], "k"
    )


@query(
    "model_roster", "C13",
    """SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderpriority) AS rn
FROM orders GROUP BY 1, 2) AS q WHERE rn = 1""",
)
def _(t):
    return sp.model_roster(t("orders"), "o_custkey", "o_orderpriority")


@query(
    "machine_master", "C14",
    """WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS m, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE cast(c_custkey as string) || '.0' END AS s FROM customer),
b AS (SELECT o_custkey AS k, min(o_orderstatus) AS m, min(cast(o_orderkey as string)) AS s FROM orders GROUP BY 1), keys AS (SELECT k FROM a UNION SELECT k FROM b)
SELECT keys.k AS machine_key, coalesce(nullif(a.m, ''), b.m, '') AS full_model, coalesce(regexp_replace(a.s, '\\.0$', ''), b.s, '') AS serial
FROM keys LEFT JOIN a USING (k) LEFT JOIN b USING (k)""",
)
def _(t):
    first = t("customer").selectExpr(
        "c_custkey as machine_key", "if(c_custkey % 3 = 0, '', c_mktsegment) as m",
        "if(c_custkey % 4 = 0, null, concat(c_custkey, '.0')) as s",
    )
    second = t("orders").selectExpr("o_custkey as machine_key", "o_orderstatus as m", "cast(o_orderkey as string) as s")
    second = second.groupBy("machine_key").agg(F.min("m").alias("m"), F.min("s").alias("s"))
    return sp.machine_master([(first, "m", "s"), (second, "m", "s")])


@query(
    "source_coverage", "C15",
    f"""WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders), l AS (SELECT o_custkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
u AS (SELECT *, 'claims' AS src FROM o UNION ALL SELECT *, 'operation' FROM l)
SELECT k AS machine_key, min(d) AS first_source_date, max(d) AS last_source_date, count(*) AS source_record_count_total,
 count(*) FILTER (WHERE src = 'claims') AS source_count_total_claims, count(*) FILTER (WHERE src = 'operation') AS source_count_total_operation FROM u GROUP BY k""",
)
def _(t):
    orders = t("orders").selectExpr("o_custkey as machine_key", "cast(o_orderdate as date) as d", "o_orderkey")
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr("machine_key", "cast(l_shipdate as date) as d")
    return sp.source_coverage({"claims": (orders, "d"), "operation": (lines, "d")})


@query(
    "dense_grid", "C16 J7",
    "SELECT c_custkey, CAST(d AS DATE) AS snapshot_date FROM customer, generate_series(TIMESTAMP '2000-01-01', TIMESTAMP '2000-01-22', INTERVAL 7 DAY) AS g(d)",
)
def _(t):
    return sp.dense_grid(t("customer").select("c_custkey"), ["2000-01-01", "2000-01-08", "2000-01-15", "2000-01-22"])


@query(
    "tumbling_periods", "C17",
    """SELECT o_orderkey, CASE WHEN o_orderdate >= TIMESTAMP '1996-02-10' THEN CAST(DATE '1996-02-10' + CAST(floor(date_diff('day', DATE '1996-02-10', CAST(o_orderdate AS DATE)) / 90.0) AS INT) * 90 AS DATE) END AS period_start FROM orders""",
)
def _(t):
    return t("orders").select("o_orderkey", segment_of(F.to_date("o_orderdate"), "1996-02-10").alias("period_start"))


_FOLD_VALUES = "(VALUES ('F1', DATE '1998-01-01', DATE '1999-01-01'), ('F2', DATE '2000-03-01', DATE '2000-12-01'), ('F3', DATE '2001-02-01', DATE '2001-12-01')) AS f(fold, a, b)"
_FOLDS = [("F1", "1998-01-01", "1999-01-01"), ("F2", "2000-03-01", "2000-12-01"), ("F3", "2001-02-01", "2001-12-01")]
_MANIFEST_TAIL = """SELECT fold, fold || '_A' || lpad(cast(row_number() OVER (PARTITION BY fold ORDER BY anchor_date) as string), 2, '0') AS anchor_id, anchor_date,
 CAST(anchor_date - 90 AS DATE) AS feature_window_start, CAST(anchor_date + 90 AS DATE) AS outcome_window_end_exclusive, CAST(anchor_date < m AS INT) AS outcome_window_complete, last AS label_data_through"""


@query(
    "anchor_manifest_even", "C19 C18",
    f"""WITH x AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), r AS (SELECT fold, a, b, last, least(b, last + 2 - 90) AS m FROM x, {_FOLD_VALUES}),
p AS (SELECT *, CAST(a + CAST(round_even((date_diff('day', a, m) - 1) * i / 4.0, 0) AS INT) AS DATE) AS anchor_date FROM r, range(5) AS g(i)) {_MANIFEST_TAIL} FROM p""",
)
def _(t):
    return sp.anchor_manifest(t("orders"), "o_orderdate", _FOLDS, "even", count=5, gap=5)


@query(
    "anchor_manifest_random", "C19 B18",
    f"""WITH x AS (SELECT CAST(max(o_orderdate) AS DATE) AS last FROM orders), r AS (SELECT fold, a, b, last, least(b, last + 2 - 90) AS m, date_diff('day', a, least(b, last + 2 - 90)) AS n FROM x, {_FOLD_VALUES}),
d AS (SELECT *, floor(n * i / 5.0) AS lo, greatest(floor(n * (i + 1) / 5.0), floor(n * i / 5.0) + 1) AS hi,
  ('0x' || substr(md5('42|' || fold || '|' || cast(tr as string) || '|' || cast(i as string)), 1, 16))::UBIGINT AS h FROM r, range(501) AS q(tr), range(5) AS g(i)),
p AS (SELECT *, CAST(a + CAST(CASE WHEN tr < 500 THEN lo + h % CAST(hi - lo AS UBIGINT) ELSE floor((n - 1) * i / 4.0) END AS INT) AS DATE) AS anchor_date FROM d),
gp AS (SELECT *, date_diff('day', lag(anchor_date) OVER (PARTITION BY fold, tr ORDER BY i), anchor_date) AS gap FROM p),
ok AS (SELECT fold, min(tr) AS use FROM (SELECT fold, tr FROM gp GROUP BY 1, 2 HAVING coalesce(min(gap) >= 12, TRUE)) AS z GROUP BY 1)
{_MANIFEST_TAIL} FROM gp JOIN ok USING (fold) WHERE tr = use""",
)
def _(t):
    return sp.anchor_manifest(t("orders"), "o_orderdate", _FOLDS, "random", count=5, gap=12)


# ------------------------------------------------------------------ joins on time
@query(
    "range_join_counts", "J3",
    f"""SELECT s.model_id, s.snapshot_date, count(*) AS pairs, round(sum(c.claim_amount), 2) AS amount, min(date_diff('day', c.event_day, s.snapshot_date)) AS newest
FROM ({roles.ORDER_SPINE_SQL}) AS s JOIN ({CLAIM_SQL}) AS c ON c.model_id = s.model_id AND c.event_day BETWEEN s.snapshot_date - 120 AND s.snapshot_date GROUP BY 1, 2""",
)
def _(t):
    claims = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day", "claim_amount")
    pairs = range_join(roles.order_spine(t).drop("full_model"), claims, "model_id", "snapshot_date", "event_day", 120, 0)
    return rounded(pairs.groupBy("model_id", "snapshot_date").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum("claim_amount").alias("amount"), F.min("age_days").alias("newest")
    ), 2)


@query(
    "asof_backward_and_forward", "J4",
    f"""WITH c AS (SELECT model_id, event_day, max(claim_number) AS hi, min(claim_number) AS lo FROM ({CLAIM_SQL}) AS x GROUP BY 1, 2), s AS ({roles.ORDER_SPINE_SQL})
SELECT s.model_id, s.snapshot_date, b.hi AS before_number, CASE WHEN date_diff('day', b.event_day, s.snapshot_date) <= 200 THEN b.event_day END AS before_day, a.event_day AS after_day
FROM s ASOF LEFT JOIN c b ON s.model_id = b.model_id AND s.snapshot_date > b.event_day
 ASOF LEFT JOIN c a ON s.model_id = a.model_id AND s.snapshot_date <= a.event_day""",
)
def _(t):
    claims = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day", "claim_number")
    spine = roles.order_spine(t).select("model_id", "snapshot_date")
    out = asof_join(spine, claims, "model_id", "snapshot_date", "event_day", ["claim_number"], inclusive=False, order=["claim_number"])
    dated = claims.withColumn("hit", F.col("event_day"))
    out = asof_join(out, dated, "model_id", "snapshot_date", "event_day", ["hit"], inclusive=False, expiry_days=200, prefix="b_")
    out = asof_join(out, dated, "model_id", "snapshot_date", "event_day", ["hit"], "forward", prefix="a_")
    return out.select(
        "model_id", "snapshot_date", F.col("claim_number").alias("before_number"), F.col("b_hit").alias("before_day"), F.col("a_hit").alias("after_day")
    )


@query(
    "anti_range_windows", "J6",
    f"""SELECT s.model_id, s.snapshot_date FROM ({roles.ORDER_SPINE_SQL}) AS s WHERE NOT EXISTS (SELECT 1 FROM ({CLAIM_SQL}) AS c
 WHERE c.model_id = s.model_id AND c.event_day BETWEEN s.snapshot_date - 30 AND s.snapshot_date + 180)""",
)
def _(t):
    spine = roles.order_spine(t).withColumn("a", F.date_sub("snapshot_date", 30)).withColumn("b", F.date_add("snapshot_date", 180))
    claims = std.standard_claims(roles.raw_claim(t))
    return anti_range(spine, claims, "model_id", "a", "b", "event_day").select("model_id", "snapshot_date")


@query(
    "common_entities", "J10",
    """WITH a AS (SELECT o_custkey AS k, CAST(max(o_totalprice) > 400000 AS INT) AS y FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, CAST(max(o_totalprice) > 400000 AS INT) AS y FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT a.k, a.y FROM a JOIN b ON a.k = b.k AND a.y = b.y""",
)
def _(t):
    from tidemark.operators.metrics import common_labeled

    frame = lambda w: t("orders").where(w).groupBy(F.col("o_custkey").alias("k")).agg(
        (F.max("o_totalprice") > 400000).cast("int").alias("y")
    )
    return common_labeled([frame("o_orderdate < '1998-01-01'"), frame("o_orderdate >= '1998-01-01'")], "k", "y")


# ------------------------------------------------------------------ labels and episodes
@query(
    "target_events", "F1",
    f"""SELECT model_id, event_day, min(claim_type) AS claim_type FROM ({CLAIM_SQL}) AS c GROUP BY 1, 2""",
)
def _(t):
    return lb.event_days(std.standard_claims(roles.raw_claim(t)), "model_id", "event_day", ["claim_type"])


@query(
    "target_profile", "F1",
    f"""SELECT count(*) AS raw_rows, count(*) AS usable_rows, count(DISTINCT model_id || cast(event_day as string)) AS entity_days, count(DISTINCT model_id) AS entities,
 min(event_day) AS first_day, max(event_day) AS last_day FROM ({CLAIM_SQL}) AS c""",
)
def _(t):
    return lb.target_profile(std.standard_claims(roles.raw_claim(t)), "model_id", "event_day")


_PART_OK = "critical_fail_part_number IS NOT NULL AND critical_fail_part_number <> '0000'"


@query(
    "claim_filter_audit", "F2",
    f"""SELECT claim_number, CAST(lower(claim_type) NOT IN ('5-low', '3-medium') AND ({_PART_OK}) AS INT) AS claim_keep,
 CASE WHEN lower(claim_type) = '5-low' THEN 'low' WHEN lower(claim_type) = '3-medium' THEN 'medium' WHEN NOT ({_PART_OK}) THEN 'missing_or_invalid_critical_part' ELSE 'kept' END AS claim_filter_reason
FROM ({CLAIM_SQL}) AS c""",
)
def _(t):
    out = lb.claim_filter(
        std.standard_claims(roles.raw_claim(t)), excluded={"5-LOW": "low", "3-Medium": "medium"}, valid_part=F.expr(_PART_OK)
    )
    return out.select("claim_number", "claim_keep", "claim_filter_reason")


@query(
    "strict_claims", "F3",
    f"""SELECT claim_number FROM ({CLAIM_SQL}) AS c WHERE claim_type IN ('1-URGENT', '2-HIGH') AND failure_smr >= 250
 AND NOT regexp_matches(coalesce(critical_fail_part_number, ''), '^0+$') AND coalesce(critical_fail_part_number, '') NOT IN ('P3', '')""",
)
def _(t):
    claims = std.standard_claims(roles.raw_claim(t))
    return lb.strict_claims(claims, ["1-URGENT", "2-HIGH"], ["P3", ""], 250).select("claim_number")


EPISODE_SQL = f"""SELECT 'E' || lpad(cast(row_number() OVER (ORDER BY machine_key, claim_date) as string), 7, '0') AS claim_episode_id, * FROM (
SELECT model_id AS machine_key, sess, min(event_day) AS claim_date, max(event_day) AS episode_end_date, count(*) AS claim_count_in_episode,
 string_agg(DISTINCT claim_number, ';' ORDER BY claim_number) AS claim_numbers, string_agg(DISTINCT claim_type, ';' ORDER BY claim_type) AS claim_type_descriptions,
 coalesce(string_agg(DISTINCT critical_fail_part_number, ';' ORDER BY critical_fail_part_number), '') AS critical_fail_part_numbers,
 min(failure_smr) AS min_failure_smr, max(failure_smr) AS max_failure_smr, first(full_model ORDER BY event_day, claim_number) AS full_model, coalesce(bool_or({_PART_OK}), FALSE) AS has_valid_critical_part_episode
FROM (SELECT *, sum(o) OVER (PARTITION BY model_id ORDER BY event_day, claim_number ROWS UNBOUNDED PRECEDING) AS sess FROM (
 SELECT *, CASE WHEN date_diff('day', lag(event_day) OVER (PARTITION BY model_id ORDER BY event_day, claim_number), event_day) <= 30 THEN 0 ELSE 1 END AS o FROM ({CLAIM_SQL}) AS c) AS g) AS h
GROUP BY model_id, sess) AS e"""


def episodes(t, gap: int = 30):
    claims = std.standard_claims(roles.raw_claim(t)).withColumnsRenamed({"model_id": "machine_key", "event_day": "claim_date"})
    return lb.claim_episodes(claims, gap, attributes=["full_model"], valid_part=F.expr(_PART_OK))


@query(
    "claim_episodes", "F4 D4 J10",
    round_sql(EPISODE_SQL, ["claim_episode_id", "machine_key", "claim_date", "episode_end_date", "claim_count_in_episode", "claim_numbers",
                            "claim_type_descriptions", "critical_fail_part_numbers", "full_model", "has_valid_critical_part_episode"], ["min_failure_smr", "max_failure_smr"]),
)
def _(t):
    return rounded(episodes(t))


@query(
    "claim_sessions", "F4",
    f"""SELECT machine_key AS model_id, CAST(sess AS BIGINT) AS session_number, claim_date AS session_start, episode_end_date AS session_end FROM ({EPISODE_SQL}) AS e""",
)
def _(t):
    days = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day").distinct()
    return session_starts(days, "model_id", "event_day", 30)


_POSITIVE_COLS = """claim_episode_id, machine_key, claim_date, row_number() OVER w AS claim_sequence_number, count(*) OVER (PARTITION BY machine_key) AS machine_claim_event_count,
 date_diff('day', lag(claim_date) OVER w, claim_date) AS gap"""


@query(
    "positive_claims_multiple", "F5 W6",
    f"""SELECT claim_episode_id, machine_key, claim_date, claim_sequence_number, machine_claim_event_count, gap AS days_since_previous_claim_same_machine,
 claim_sequence_number = 1 OR coalesce(gap >= 90, FALSE) AS selected_as_positive_claim,
 CASE WHEN claim_sequence_number = 1 THEN 'first_claim_for_machine' WHEN gap >= 90 THEN 'included_gap_from_previous_claim_ge_lead_max_days' ELSE 'excluded_gap_from_previous_claim_lt_lead_max_days' END AS claim_selection_reason
FROM (SELECT {_POSITIVE_COLS} FROM ({EPISODE_SQL}) AS e WINDOW w AS (PARTITION BY machine_key ORDER BY claim_date, claim_episode_id)) AS p""",
)
def _(t):
    return lb.select_positives(episodes(t), "multiple", 90).select(
        "claim_episode_id", "machine_key", "claim_date", "claim_sequence_number", "machine_claim_event_count",
        "days_since_previous_claim_same_machine", "selected_as_positive_claim", "claim_selection_reason",
    )


@query(
    "future_labels", "F6",
    f"""WITH s AS ({roles.ORDER_SPINE_SQL}), c AS ({CLAIM_SQL}), a AS (SELECT s.model_id, s.snapshot_date, count(*) AS n, count(*) FILTER (WHERE claim_type = '1-URGENT') AS u
 FROM s JOIN c ON c.model_id = s.model_id AND c.event_day >= s.snapshot_date AND c.event_day < s.snapshot_date + 90 GROUP BY 1, 2)
SELECT s.model_id, s.snapshot_date, coalesce(n, 0) AS future_event_count, CAST(coalesce(n, 0) > 0 AS INT) AS claim_next_90d, CAST(coalesce(u, 0) > 0 AS INT) AS target_urgent_0_90
FROM s LEFT JOIN a USING (model_id, snapshot_date)""",
)
def _(t):
    claims = std.standard_claims(roles.raw_claim(t))
    return lb.future_label(
        roles.order_spine(t).drop("full_model"), claims, sources={"target_urgent_0_90": "claim_type = '1-URGENT'"}
    )


NEXT_SQL = f"""SELECT model_id, snapshot_date, nd AS next_claim_date_on_or_after_window_end, date_diff('day', snapshot_date, nd) AS days_to_next_claim_on_or_after_window_end
FROM (SELECT s.model_id, s.snapshot_date, min(c.event_day) AS nd FROM ({roles.ORDER_SPINE_SQL}) AS s LEFT JOIN ({CLAIM_SQL}) AS c ON c.model_id = s.model_id AND c.event_day >= s.snapshot_date GROUP BY 1, 2) AS q"""
_D = "days_to_next_claim_on_or_after_window_end"


@query(
    "next_events", "F7 F8 B20",
    f"""SELECT n.*, CAST(next_claim_date_on_or_after_window_end IS NOT NULL AS INT) AS has_future_claim_on_or_after_window_end,
 CASE WHEN {_D} IS NULL THEN 'no_future_claim_observed' WHEN {_D} <= 0 THEN '0d' WHEN {_D} <= 30 THEN '1-30d' WHEN {_D} <= 60 THEN '31-60d' WHEN {_D} <= 90 THEN '61-90d'
  WHEN {_D} <= 120 THEN '91-120d' WHEN {_D} <= 180 THEN '121-180d' WHEN {_D} <= 365 THEN '181-365d' ELSE '365d+' END AS future_claim_lead_time_bucket,
 {', '.join(f'CAST(coalesce({_D} <= {h}, FALSE) AS INT) AS eval_target_claim_within_next_{h}d' for h in (90, 180, 365))},
 (SELECT min(claim_type) FROM ({CLAIM_SQL}) AS c WHERE c.model_id = n.model_id AND c.event_day = n.next_claim_date_on_or_after_window_end) AS next_claim_type
FROM ({NEXT_SQL}) AS n""",
)
def _(t):
    claims = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day", "claim_type")
    days = lb.event_days(claims, "model_id", "event_day", ["claim_type"])
    return lb.next_event(
        roles.order_spine(t).drop("full_model"), days, "model_id", "snapshot_date", "event_day", horizons=(90, 180, 365), columns=["claim_type"]
    )


def with_next(t):
    days = std.standard_claims(roles.raw_claim(t)).select("model_id", "event_day").distinct()
    return lb.next_event(roles.order_spine(t).drop("full_model"), days, "model_id", "snapshot_date", "event_day")


@query(
    "lead_time_summary", "F12 F11",
    round_sql(f"""SELECT count({_D}) AS future_claim_observed_rows, count(*) - count({_D}) AS future_claim_never_observed_rows, min({_D}) AS future_claim_days_min,
 avg({_D}) AS future_claim_days_mean, quantile_cont({_D}, 0.5) AS future_claim_days_median, quantile_cont({_D}, 0.9) AS future_claim_days_p90 FROM ({NEXT_SQL}) AS n""",
              ["future_claim_observed_rows", "future_claim_never_observed_rows", "future_claim_days_min"],
              ["future_claim_days_mean", "future_claim_days_median", "future_claim_days_p90"], 6),
)
def _(t):
    return rounded(lb.lead_time_summary(with_next(t)), 6)


@query(
    "horizon_label_summary", "F11 F12 M22",
    round_sql(" UNION ALL ".join(
        f"SELECT year(snapshot_date) AS yr, {h} AS horizon_days, count(*) AS rows, count(*) FILTER (WHERE {_D} BETWEEN 0 AND {h}) AS positives, "
        f"count(*) - count(*) FILTER (WHERE {_D} BETWEEN 0 AND {h}) AS negatives, count(*) FILTER (WHERE {_D} BETWEEN 0 AND {h}) / count(*) AS positive_rate, 1 AS not_below_shorter_horizon FROM ({NEXT_SQL}) AS n GROUP BY 1"
        for h in (30, 90, 365)), ["yr", "horizon_days", "rows", "positives", "negatives", "not_below_shorter_horizon"], ["positive_rate"]),
)
def _(t):
    rows = with_next(t).withColumn("yr", F.year("snapshot_date"))
    return rounded(lb.horizon_label_summary(rows, (30, 90, 365), group=["yr"]))


@query(
    "outcome_history", "F9 F10",
    f"""WITH r AS (SELECT model_id AS machine_key, CAST(snapshot_date AS DATE) AS period_end FROM ({roles.ORDER_SPINE_SQL}) AS s), c AS (SELECT DISTINCT model_id, event_day FROM ({CLAIM_SQL}) AS x),
o AS (SELECT max(event_day) AS last FROM c), j AS (SELECT r.*, c.event_day AS d, date_diff('day', c.event_day, r.period_end) AS age FROM r LEFT JOIN c ON c.model_id = r.machine_key),
a AS (SELECT machine_key, period_end, {', '.join(f'count(*) FILTER (WHERE age BETWEEN 0 AND {n - 1}) AS prior_claim_count_{n}d' for n in (30, 90, 180, 365))}, count(*) FILTER (WHERE age >= 0) AS prior_claim_count_ever,
 min(age) FILTER (WHERE age >= 0) AS days_since_prior_claim, count(*) FILTER (WHERE age BETWEEN -90 AND -1) AS target_claim_count_90d, min(d) FILTER (WHERE age BETWEEN -90 AND -1) AS target_first_claim_date_90d,
 min(d) FILTER (WHERE age < 0) AS next_target_event_date FROM j GROUP BY 1, 2)
SELECT a.*, CAST(target_claim_count_90d > 0 AS INT) AS target_90d, date_diff('day', CAST(period_end + 1 AS DATE), next_target_event_date) AS days_to_next_target_event,
 last AS target_observation_end, CAST(period_end + 1 AS DATE) AS target_window_start, CAST(period_end + 90 AS DATE) AS target_window_end, CAST(period_end + 90 <= last AS INT) AS label_complete_90d FROM a, o""",
)
def _(t):
    rows = roles.order_spine(t).selectExpr("model_id as machine_key", "snapshot_date as period_end")
    days = std.standard_claims(roles.raw_claim(t)).selectExpr("model_id as machine_key", "event_day").distinct()
    return lb.outcome_history(rows, days)
