"""Small hand-checked cases of the operators."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions.keys import unique_token
from tidemark.functions.stats import wilson_high, wilson_low
from tidemark.operators import cohorts as ch
from tidemark.operators import labels as lb
from tidemark.operators import metrics as m
from tidemark.operators import modeling as ml
from tidemark.operators import ordering
from tidemark.operators import screening as sc
from tidemark.operators import source_features as sf
from tidemark.operators import tiers as tr
from tidemark.operators.assembly import finalize
from tidemark.operators.features import Feature, latest_item_states, window_features
from tidemark.operators.ordering import exact_quantiles, ordered_scan
from tidemark.operators.spine import anchor_manifest, complete_horizon, greedy_dates, require_unique, spaced_dates
from tidemark.operators.splits import rolling_origin, split_quotas
from tidemark.plans.catalog import QUERIES
from tidemark.session import cut_lineage, measured_joins
from tidemark.sources.cleaning import unique_column_names
from tidemark.sources.readers import parsed_day, require_columns
from tidemark.sources.refresh import merge_refresh

T = dt.date(2023, 6, 1)


def day(offset):
    return T + dt.timedelta(days=offset)


def spine(spark):
    return spark.createDataFrame([("a", T)], "model_id string, snapshot_date date")


def events(spark, rows, extra=""):
    return spark.createDataFrame([("a", *r) for r in rows], f"model_id string, event_day date{extra}")


def one(df):
    return df.collect()[0].asDict()


def test_window_edges(spark):
    ev = events(spark, [(day(-91),), (day(-90),), (day(-1),), (day(0),)])
    out = one(window_features(spine(spark), ev, [
        Feature("left", "count", oldest=90), Feature("both", "count", oldest=90, newest=0),
        Feature("ever", "count", oldest=None), Feature("old", "count", oldest=None, newest=91),
    ]))
    assert (out["left"], out["both"], out["ever"], out["old"]) == (2, 3, 3, 1)


def test_label_edges(spark):
    out = one(lb.future_label(spine(spark), events(spark, [(day(0),), (day(89),), (day(90),)])))
    assert out["future_event_count"] == 2 and out["claim_next_90d"] == 1


def test_floor_days(spark):
    row = spark.createDataFrame([(dt.datetime(2023, 5, 25, 19, 28, 6), dt.datetime(2023, 6, 1))], "e timestamp_ntz, t timestamp_ntz")
    out = row.select(
        s.floor_days(F.col("t"), F.col("e")).alias("d"),
        F.datediff(F.lit(T), s.first_midnight_at_or_after(F.col("e"))).alias("c"),
    ).first()
    assert out["d"] == 6 and out["c"] == 6


def test_empty_window_fills(spark):
    ev = events(spark, [(day(-400), 2.0)], ", v double")
    out = one(window_features(spine(spark), ev, [
        Feature("n", "count"), Feature("s", "sum", "v"), Feature("mx", "max", "v"), Feature("mean", "mean", "v"),
        Feature("sd", "stddev", "v"), Feature("dc", "distinct", "v"), Feature("any", "any"),
    ]))
    assert (out["n"], out["s"], out["dc"], out["any"]) == (0, 0.0, 0, 0)
    assert out["mx"] is None and out["mean"] is None and out["sd"] is None


def test_distinct_drops_blank_and_null(spark):
    ev = events(spark, [(day(-1), c) for c in ("A", "A", "", None)], ", code string")
    assert one(window_features(spine(spark), ev, [Feature("n", "distinct", "code")]))["n"] == 1


def test_moments_match_plain_aggregates(spark):
    values = [1.5, 2.0, 7.25, 7.25, 0.5]
    ev = events(spark, [(day(-1 - i // 2), v) for i, v in enumerate(values)], ", v double")
    out = one(window_features(spine(spark), ev, [
        Feature("mean", "mean", "v"), Feature("sd", "stddev", "v"), Feature("lo", "min", "v"), Feature("last", "latest", "v"),
        Feature("first", "first", "v"), Feature("days", "days"),
    ]))
    mean = sum(values) / 5
    sd = (sum((v - mean) ** 2 for v in values) / 4) ** 0.5
    assert out["mean"] == pytest.approx(mean) and out["sd"] == pytest.approx(sd)
    assert (out["lo"], out["last"], out["first"], out["days"]) == (0.5, 2.0, 0.5, 3)


def test_same_day_max_and_later_null(spark):
    ev = events(spark, [(day(-5), 3.0), (day(-5), 5.0), (day(-2), None)], ", v double")
    assert one(window_features(spine(spark), ev, [Feature("v", "latest", "v", oldest=365)]))["v"] == 5.0


@pytest.mark.parametrize("age, severity, staleness", [(365, 3.0, 365), (366, 0.0, 366)])
def test_carried_value_expires(spark, age, severity, staleness):
    rows = events(spark, [(day(-age), 3.0, 1, 0, 1)], ", severity_known double, is_abnormal int, contaminant_flag int, sample int")
    out = one(sf.carried_fluid_features(spine(spark), rows, "sample", measures=()))
    assert out["fluid_current_severity"] == severity and out["fluid_sample_staleness_days"] == staleness


def test_latest_item_state(spark):
    ev = events(spark, [(day(-10), "X", 1), (day(-2), "X", 0), (day(1), "X", 1)], ", item string, overdue int")
    out = latest_item_states(spine(spark), ev, "item", ["overdue"], ["overdue"]).collect()
    assert [(r["overdue"], r["state_day"]) for r in out] == [(0, day(-2))]


def test_velocity_ratio(spark):
    columns = ", fault_code string, severity double, log_occ double, is_serious int, system string, is_hst int, is_l03 int, is_l04 int, serious_log_occ double, severity_weight double, evidence_weight double"
    row = lambda d: (day(d), "C", 3.0, 1.0, 1, "ENG", 0, 1, 0, 1.0, 3.0, 0.0)
    ev = events(spark, [row(-1), row(-2), row(-3)], columns).withColumnRenamed("model_id", "machine_key")
    sp = spark.createDataFrame([("a", T), ("b", T)], "machine_key string, snapshot_date date")
    out = {r["machine_key"]: r for r in sf.serious_fault_features(sp, ev).collect()}
    assert out["a"]["fault_velocity_ratio"] == 4.0 and out["b"]["fault_velocity_ratio"] == 0.0
    assert out["a"]["has_accelerating_faults"] == 1 and out["b"]["fault_days_since_last"] == 91
    decayed = sum(3.0 * 0.5 ** (a / 30) for a in (1, 2, 3))
    assert out["a"]["fault_severity_recency_90d"] == pytest.approx(decayed)


def test_no_leakage(spark):
    """Changing events on or after the snapshot changes no feature."""
    past = [(day(-3), 1.0), (day(-40), 2.0)]
    specs = [Feature("n", "count"), Feature("r", "recency", "event_day", oldest=None), Feature("s", "sum", "v", oldest=None),
             Feature("l", "latest", "v", oldest=None), Feature("d", "distinct", "v")]
    results = [
        one(window_features(spine(spark), events(spark, past + future, ", v double"), specs))
        for future in ([], [(day(0), 9.0), (day(1), 50.0)])
    ]
    assert results[0] == results[1]


def claims(spark, offsets):
    return spark.createDataFrame(
        [("a", day(o), f"n{o}", "t", None, 1.0) for o in offsets],
        "machine_key string, claim_date date, claim_number string, claim_type string, critical_fail_part_number string, failure_smr double",
    )


def test_episodes(spark):
    out = lb.claim_episodes(claims(spark, [0, 30, 61, 62]), 30).orderBy("claim_date").collect()
    assert [(r["claim_date"], r["episode_end_date"], r["claim_episode_id"]) for r in out] == [
        (day(0), day(30), "E0000001"), (day(61), day(62), "E0000002")]
    assert out[0]["claim_numbers"] == "n0;n30"


def test_positive_selection(spark):
    eps = spark.createDataFrame([("a", f"E{i}", day(o)) for i, o in enumerate((0, 89, 179))], "machine_key string, claim_episode_id string, claim_date date")
    multiple = lb.select_positives(eps, "multiple", 90).orderBy("claim_date").collect()
    assert [r["selected_as_positive_claim"] for r in multiple] == [True, False, True]
    first = lb.select_positives(eps, "first").orderBy("claim_date").collect()
    assert [r["selected_as_positive_claim"] for r in first] == [True, False, False]


def test_incremental_merge(spark):
    schema = "k string, v int"
    history, incoming = spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], schema), spark.createDataFrame([("k", 4), ("j", 5), (None, 6)], schema)
    assert sorted(r["v"] for r in merge_refresh(history, incoming, ["k"]).collect()) == [1, 2, 3, 5]


def test_top_count_and_decile(spark):
    out = spark.range(1).select(
        m.top_count(F.lit(11), 0.10).alias("a"), m.top_count(F.lit(11), 0.01).alias("b"), m.top_count(F.lit(100), 0.07).alias("c"),
        m.decile_from_top(F.lit(3), F.lit(25)).alias("d"), m.decile_from_top(F.lit(25), F.lit(25)).alias("e"),
    ).first()
    assert tuple(out) == (2, 1, 8, 1, 10)
    assert m.bin_edges(10)[3] == 0.30000000000000004


def test_auc_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([("x", 0.5, 1), ("x", 0.5, 0), ("y", 0.1, 1)], "g string, s double, y int")
    out = {r["g"]: r for r in m.auc_ap(rows, ["g"], "s", "y").collect()}
    assert out["x"]["roc_auc"] == 0.5 and out["x"]["average_precision"] == 0.5 and out["y"]["roc_auc"] is None


def test_wilson(spark):
    out = spark.range(1).select(wilson_low(F.lit(5), F.lit(5)).alias("lo"), wilson_high(F.lit(5), F.lit(5)).alias("hi"), wilson_low(F.lit(0), F.lit(0)).alias("none")).first()
    assert out["lo"] == pytest.approx(0.5655, abs=1e-4) and out["hi"] == pytest.approx(1.0) and out["none"] is None


def test_calibration_bins_edges(spark):
    rows = spark.createDataFrame([(0.1, 1), (1.0, 0)], "p double, y int")
    filled = m.calibration_bins(rows, [], "y", "p").where("rows > 0").orderBy("bin_number").collect()
    assert [r["bin_number"] for r in filled] == [2, 10]


def test_ordered_scan_matches_window(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 101).alias("v"), "id")
    out = ordered_scan(rows, ["g"], [F.col("v").asc(), F.col("id").asc()], "n", "size", {"run": F.col("v")}, {"tot": F.col("v")}).collect()
    for g in range(3):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: (r["v"], r["id"]))
        total = 0
        for i, r in enumerate(mine, 1):
            total += r["v"]
            assert r["n"] == i and r["run"] == total and r["size"] == len(mine)
        assert all(r["tot"] == total for r in mine)


def test_exact_quantiles(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 1, 1, 4, 10, 20)], "v double")
    out = exact_quantiles(rows, [], "v", {"p50": 0.5, "p90": 0.9, "p0": 0.0}).first()
    assert (out["p50"], out["p90"], out["p0"]) == (2.5, 15.0, 1.0)


def test_tier_demotion(spark):
    policy = {"confirmation_rule": "risk_index_only", "tiers": {
        "CRITICAL": {"enabled": False}, "HIGH": {"enabled": True, "selected_top_n": 1, "final_risk_index_gate": 90},
        "MEDIUM": {"enabled": True, "selected_top_n": 2, "final_risk_index_gate": 50}}}
    rows = spark.createDataFrame([("a", T, 0.7, 0.7), ("b", T, 0.2, 0.2), ("c", T, 0.1, 0.1)], "machine_key string, snapshot_date date, raw_model_score double, failure_probability double")
    out = {r["machine_key"]: r for r in tr.apply_policy(tr.score_table(rows, 0.5), policy).collect()}
    assert out["a"]["candidate_risk_tier"] == "HIGH" and out["a"]["risk_tier"] == "MEDIUM" and out["a"]["tier_demotion_steps"] == 1
    assert out["b"]["risk_tier"] == "LOW" and out["b"]["tier_decision_reason"] == "medium_candidate_failed_all_lower_score_gates"
    assert out["c"]["tier_decision_reason"] == "outside_all_selected_top_n_boundaries"


def test_follow_up_cutoff(spark):
    rows = spark.createDataFrame([("a", day(-89)), ("a", day(-88))], "model_id string, snapshot_date date")
    end = spark.createDataFrame([(T,)], "label_end date")
    assert [r["snapshot_date"] for r in complete_horizon(rows, end, 90).collect()] == [day(-89)]


def test_greedy_and_spaced_dates(spark):
    rows = spark.createDataFrame([("a", day(o)) for o in (0, 14, 28, 42, 56, 70)], "k string, d date")
    assert sorted(r["d"] for r in greedy_dates(rows, "k", "d", 45).collect()) == [day(0), day(56)]
    dates = spark.createDataFrame([([day(o) for o in range(0, 100, 10)],), ([],)], "d array<date>")
    picked = lambda count, gap: [r[0] for r in dates.select(spaced_dates(F.col("d"), count, gap)).collect()]
    assert picked(3, 30) == [[day(0), day(40), day(90)], []] and picked(1, 30) == [[day(50)], []]
    assert picked(4, 25) == [[day(0), day(30), day(60), day(90)], []] and picked(5, 45) == [[day(0), day(50)], []]


def test_split_quotas_small_strata(spark):
    strata = spark.createDataFrame([("s1", 1), ("s2", 2), ("s3", 3), ("s10", 10)], "stratum string, n long")
    out = {r["stratum"]: (r["n_train"], r["n_validation"], r["n_test"]) for r in split_quotas(strata, {"train": 0.7, "validation": 0.15, "test": 0.15}, 42).collect()}
    assert sum(out["s1"]) == 1 and out["s2"][0] == 1 and sum(out["s2"]) == 2
    assert out["s3"] == (1, 1, 1) and sum(out["s10"]) == 10 and out["s10"][0] == 7


def test_checks_raise(spark):
    doubled = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="duplicate keys"):
        require_unique(doubled, ["k"]).collect()
    with pytest.raises(ValueError, match="missing"):
        require_columns(doubled, ["nope"])
    with pytest.raises(Exception, match="unreadable date"):
        parsed_day(spark.createDataFrame([("no date",)], "d string"), "d").collect()
    with pytest.raises(ValueError, match="frozen"):
        finalize(spine(spark), [], {}, "y", contract=["f"])


def test_names():
    assert unique_column_names([" a", "a", "", "a"]) == ["a", "a_duplicate_2", "unnamed_column", "a_duplicate_3"]
    taken = set()
    assert [unique_token(x, taken) for x in ("a b", "a-b", "9")] == ["a_b", "a_b_2", "f_9"]


def test_nested_ratios(spark):
    rows = [("s", f"p{i}", 1, i, None) for i in (1, 2)] + [("s", f"n{i}", 0, None, i) for i in range(1, 7)]
    pool = spark.createDataFrame(rows, "split string, machine_key string, target int, positive_rank long, negative_rank long")
    out = ch.nested_ratios(pool, (1, 2, 3)).collect()
    keys = lambda r, y: {x["machine_key"] for x in out if x["ratio"] == r and x["target"] == y}
    assert keys(1, 1) == keys(3, 1) == {"p1", "p2"}
    assert keys(1, 0) < keys(2, 0) < keys(3, 0) and [len(keys(r, 0)) for r in (1, 2, 3)] == [2, 4, 6]


def test_mutual_information_of_few_values(spark):
    # 100 rows: a feature equal to a target with 12 ones gives the target's entropy; ten bins else
    rows = spark.range(100).selectExpr("id", "int(id < 12) as y", "double(id < 12) as same", "1.0D as constant", "double(id) as spread")
    found = {r.feature: r.mutual_information for r in sc.mutual_information(rows, ["same", "constant", "spread"], "y", ["id"]).collect()}
    entropy = -(0.12 * math.log(0.12) + 0.88 * math.log(0.88))
    assert found["same"] == pytest.approx(entropy) and found["constant"] == pytest.approx(0)
    # right-closed cuts of the ranks 1..100 into 10: bins of 10; the second holds 2 ones of 10
    joint = [(0.10, 0.10, 0.12), (0.02, 0.10, 0.12), (0.08, 0.10, 0.88), (0.80, 0.80, 0.88)]
    assert found["spread"] == pytest.approx(sum(p * math.log(p / (a * b)) for p, a, b in joint[:3]) + 0.80 * math.log(1 / 0.88))


def test_ranked_codes_need_rows_with_and_without(spark):
    rows = spark.range(100).selectExpr("id", "int(id % 4 = 0) as y", "1 as everywhere", "int(id < 50) as half", "int(id >= 50) as other", "int(id < 5) as seldom")
    found = sc.ranked_codes(rows, ["everywhere", "half", "other", "seldom"], "y", 30, 4).collect()
    assert [r.feature for r in found] == ["half", "other"] and found[0].support == 50


def test_consensus_ranks_a_missing_score_last(spark):
    report = spark.createDataFrame([("a", 2.0), ("b", None), ("c", 1.0), ("d", None)], "feature string, score double")
    found = {r.feature: r.rank_x for r in sc.consensus(report.select("feature"), {"x": report}).collect()}
    assert found == {"a": 1, "c": 2, "b": 3, "d": 3}


def test_quality_prefers_known_and_named_features(spark):
    inventory = spark.createDataFrame(
        [("fault_count", 100, 100, 10, 4.0), ("plain", 100, 100, 10, 4.0), ("max_gap", 50, 100, 10, 4.0)],
        "feature string, non_missing long, rows long, unique long, var double",
    )
    found = {r.feature: r.quality_score for r in sc.quality_table(inventory).collect()}
    base = 3 * math.log(11) + 0.01 * math.log(5)
    assert found["plain"] == pytest.approx(base)
    assert found["fault_count"] == pytest.approx(base + 1.25 * 34) and found["max_gap"] == pytest.approx(base - 50 + 1.25 * 8)


def test_short_folds_stay_visible(spark):
    ev = spark.createDataFrame([(dt.date(2024, 12, 31),)], "d date")
    folds = [("long", "2023-01-01", "2023-12-31"), ("short", "2023-01-01", "2023-01-20")]
    found = anchor_manifest(ev, "d", folds, mode="random", count=3, gap=25, attempts=5).collect()
    assert {(r.fold, r.anchor_date is None) for r in found} == {("long", False), ("short", True)}
    with pytest.raises(ValueError):
        rolling_origin(ev, "d", "2023-06-01", "2023-09-01")


def test_no_join_broadcasts_a_side_by_its_estimate(spark, tmp_path, capsys):
    days = "timestamp'1996-03-01' + make_dt_interval(cast(id % 400 as int))"
    spark.range(300).selectExpr(
        "id as o_orderkey", "id % 40 as o_custkey", "'O' as o_orderstatus", "id * 1.5D as o_totalprice", f"{days} as o_orderdate", "'1-URGENT' as o_orderpriority"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = QUERIES["claim_history_basic"].build(spark, str(tmp_path))
    found.explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    # 28 dates for each of the 40 machines; small sides are still broadcast once they are measured
    assert found.count() == 40 * 28
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == threshold


def test_query_session_keeps_the_callers_settings(spark):
    names = ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled")
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "7")
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session = measured_joins(other)
    assert [session.conf.get(n) for n in names] == [other.conf.get(n) for n in names]
    assert session.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == "-1"


def test_permutation_importance_scans_do_not_grow_with_repeats(spark, monkeypatch):
    rows = spark.range(200).selectExpr("id", "cast(id % 2 as int) as target", "id % 2 + (id * 7 % 5) / 10D as useful", "(id * 13 % 11) / 11D as idle")
    model = ml.fit(rows, ["useful", "idle"], "target")
    stored, counts = [], []
    for module in (ml, ordering):
        monkeypatch.setattr(module, "cut_lineage", lambda df: stored.append(1) or cut_lineage(df))
    for repeats in (2, 3):
        found = {r.feature: r for r in ml.permutation_importance(model, rows, ["useful", "idle"], "target", ["id"], repeats).collect()}
        counts.append(len(stored))
        stored.clear()
        assert found["useful"].importance_mean > 0.2 and abs(found["idle"].importance_mean) < 0.05
    assert counts[0] == counts[1]
    empty = ml.permutation_importance(model, rows.where("id < 0"), ["useful", "idle"], "target", ["id"], 2).collect()
    assert sorted(tuple(r) for r in empty) == [("idle", None, None), ("useful", None, None)]
