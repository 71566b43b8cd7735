"""Operators without an SQL twin, against plain Python on small fixtures."""

import datetime as dt
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bootstrap as bs
from tidemark.functions import stats
from tidemark.operators import cohorts as ch
from tidemark.operators import metrics as m
from tidemark.operators import modeling as ml
from tidemark.operators import screening as sc
from tidemark.operators import segments as sg
from tidemark.operators import splits as sp
from tidemark.operators.ordering import column_quantiles, values_at_ranks
from tidemark.operators.features import Feature, interval_features, window_features
from tidemark.plans import cohort_queries
from tidemark.plans.catalog import QUERIES
from tidemark.sources import readers
from tidemark.sources.refresh import key_digest
from tidemark.streaming.refresh import known_rows, refresh_batch, start_refresh

BASE = dt.date(2020, 1, 1)


def day(offset):
    return BASE + dt.timedelta(days=offset)


@pytest.fixture(scope="module")
def world(spark):
    master = [(f"m{i}", "A" if i % 3 else "B", "test" if i % 2 else "validation", day(0), day(700)) for i in range(40)]
    claims = [(f"m{i}", day(60 + (i * 53) % 400)) for i in range(0, 40, 3)]
    cases = [(f"g{k}", k, f"h{i:03d}", "A" if i % 3 else "B", "test" if i % 2 else "validation", c - dt.timedelta(days=40), c - dt.timedelta(days=10))
             for i, (k, c) in enumerate(claims)]
    split = {m[0]: m for m in master}
    cases = [(g, k, h, split[k][1], split[k][2], a, b) for g, k, h, _, _, a, b in cases]
    return {
        "master": spark.createDataFrame(master, "machine_key string, full_model string, split string, first_source_date date, last_source_date date"),
        "claims": spark.createDataFrame(claims, "machine_key string, claim_date date"),
        "cases": spark.createDataFrame(cases, "case_control_group_id string, machine_key string, `__hash` string, full_model string, split string, window_start date, window_end date"),
        "end": spark.createDataFrame([(day(700),)], "label_end date"), "raw": (master, claims, cases),
    }


def free(claims, key, case):
    return not any(k == key and case[5] - dt.timedelta(days=30) <= c <= case[6] + dt.timedelta(days=180) for k, c in claims)


def test_controlled_pool_is_exclusive_and_complete(world):
    master, claims, cases = world["raw"]
    out = ch.controlled_ratio_pool(world["cases"], world["master"], world["claims"], world["end"], 2).collect()
    keys = [r["machine_key"] for r in out]
    assert len(keys) == len(set(keys))
    model = {m[0]: (m[1], m[2]) for m in master}
    by_case = {c[0]: c for c in cases}
    groups = {}
    for r in out:
        groups.setdefault(r["case_control_group_id"], []).append(r)
    assert groups
    for g, rows in groups.items():
        case = by_case[g]
        assert sorted(r["control_rank"] for r in rows) == [0, 1, 2]
        for r in rows:
            if r["target"] == 0:
                assert model[r["machine_key"]] == (case[3], case[4]) and free(claims, r["machine_key"], case)
    # a dropped case has too few unused controls left, or serves as a control itself
    used = set(keys)
    for g, case in by_case.items():
        if g not in groups and case[1] not in used:
            left = [m[0] for m in master if m[0] not in used and m[0] != case[1] and (m[1], m[2]) == (case[3], case[4]) and free(claims, m[0], case)]
            assert len(left) < 2


@pytest.mark.parametrize("block", [1, 7])
def test_matched_controls_do_not_depend_on_blocks(world, block):
    run = lambda b: {tuple(r) for r in ch.matched_controls(world["cases"], world["master"], world["claims"], world["end"], 3, block=b).select("case_control_group_id", "machine_key", "control_number").collect()}
    assert run(block) == run(50)


def test_cases_that_nothing_fits_cost_linear_rows(spark):
    """Every entity has a claim every 100 days, so no 30 + 30 + 180 days are free; nothing is listed or visited."""
    master = spark.createDataFrame([(f"m{i}", "A", "test", day(0), day(2000)) for i in range(300)], "machine_key string, full_model string, split string, first_source_date date, last_source_date date")
    claims = spark.createDataFrame([(f"m{i}", day(o)) for i in range(300) for o in range(i % 100 - 100, 2300, 100)], "machine_key string, claim_date date")
    cases = spark.createDataFrame([(f"g{i}", f"m{i}", "A", "test", day(500 + i), day(530 + i)) for i in range(300)], "case_control_group_id string, machine_key string, full_model string, split string, window_start date, window_end date")
    end = spark.createDataFrame([(day(2500),)], "label_end date")
    index = ch.ControlIndex(cases, master, claims, ["full_model", "split"], 42, "controlled")
    assert index.rows.count() == 0 and index.walks(cases).count() == 0
    assert ch.matched_controls(cases, master, claims, end, 3).count() == 0
    rounds = []
    assert ch.controlled_ratio_pool(cases.withColumn("__hash", F.lit("x")), master, claims, end, 2, rounds=rounds).count() == 0 and rounds == [0]


def test_controls_equal_a_plain_walk_and_show_no_neighbour_bias(spark, world):
    master, claims, cases = world["raw"]
    found = ch.matched_controls(world["cases"], world["master"], world["claims"], world["end"], 40).collect()
    got = {}
    for r in found:
        got.setdefault(r["case_control_group_id"], set()).add(r["machine_key"])
    last = day(700)
    for g, k, _, model, split, a, b in cases:
        fits = set() if b + dt.timedelta(days=180) > last else {m[0] for m in master if m[0] != k and (m[1], m[2]) == (model, split) and free(claims, m[0], (g, k, "", model, split, a, b))}
        assert got.get(g, set()) == fits
    # only every fourth of 64 entities fits; on a ring those behind long gaps would be drawn more often
    entities = [(f"e{i:02d}", "A", "test", day(0), day(2000)) for i in range(64)]
    fleet = spark.createDataFrame(entities, "machine_key string, full_model string, split string, first_source_date date, last_source_date date")
    busy = spark.createDataFrame([(f"e{i:02d}", day(o)) for i in range(64) if i % 4 for o in range(0, 2300, 300)], "machine_key string, claim_date date")
    many = spark.createDataFrame([(f"g{i}", "none", "A", "test", day(610), day(640)) for i in range(1600)], "case_control_group_id string, machine_key string, full_model string, split string, window_start date, window_end date")
    drawn = ch.matched_controls(many, fleet, busy, spark.createDataFrame([(day(2500),)], "label_end date"), 1).groupBy("machine_key").count().collect()
    counts = {r["machine_key"]: r["count"] for r in drawn}
    assert set(counts) == {f"e{i:02d}" for i in range(0, 64, 4)} and sum(counts.values()) == 1600
    # 100 draws each on average; the chi-square of 15 degrees of freedom stays below its 99.9 % point
    assert sum((n - 100) ** 2 / 100 for n in counts.values()) < 37.7


def test_exclusive_pool_needs_few_rounds(spark):
    master = spark.createDataFrame([(f"m{i}", "A", "test", day(0), day(2000)) for i in range(900)], "machine_key string, full_model string, split string, first_source_date date, last_source_date date")
    claims = spark.createDataFrame([(f"m{i}", day(900)) for i in range(250)], "machine_key string, claim_date date")
    cases = spark.createDataFrame([(f"g{i}", f"m{i}", "A", "test", day(820), day(880)) for i in range(250)], "case_control_group_id string, machine_key string, full_model string, split string, window_start date, window_end date")
    rounds = []
    out = ch.controlled_ratio_pool(cases, master, claims, spark.createDataFrame([(day(2500),)], "label_end date"), 2, rounds=rounds).collect()
    keys = [r["machine_key"] for r in out]
    # 650 free entities serve all 250 cases, which are not free themselves
    assert len(keys) == len(set(keys)) == 750 and rounds[0] == 250 and rounds[-1] == 0 and len(rounds) <= 14


def test_mixed_controls(spark):
    schema = "case_control_group_id string, machine_key string, window_start date, control_number int"
    controlled = spark.createDataFrame([("g", "a", BASE, 1), ("g", "b", BASE, 2), ("g", "c", BASE, 3), ("h", "a", BASE, 1)], schema)
    random = spark.createDataFrame([("g", "a", BASE, 1), ("g", "x", BASE, 2), ("h", "y", BASE, 1), ("h", "z", BASE, 2), ("h", "w", BASE, 3)], schema)
    out = ch.mixed_controls(controlled, random, 4).collect()
    pick = lambda g: [r["machine_key"] for r in sorted((r for r in out if r["case_control_group_id"] == g), key=lambda r: r["control_number_within_group"])]
    assert pick("g") == ["a", "b", "x", "c"] and pick("h") == ["a", "y", "z", "w"]


def test_capped_cases(spark):
    rows = [(f"g{i}", "k", "train" if i < 70 else "validation" if i < 90 else "test") for i in range(100)]
    df = spark.createDataFrame(rows, "case_control_group_id string, machine_key string, split string")
    sizes = lambda n: {r["split"]: r["count"] for r in ch.capped_cases(df, n).groupBy("split").count().collect()}
    assert sizes(10) == {"train": 7, "validation": 2, "test": 1} and sum(sizes(13).values()) == 13
    assert sum(sizes(500).values()) == 100


def test_balanced_negatives(spark):
    rows = [(f"m{i}", "test", day(i), "delayed_claim_negative", f"b{i % 2}") for i in range(10)]
    rows += [(f"m{i}", "test", day(i + 100), "strict_negative", "none") for i in range(14)]
    df = spark.createDataFrame(rows, "machine_key string, split string, window_end date, negative_case_type string, lead_bin string")
    out = ch.balanced_negatives(df, 4).collect()
    assert len({r["machine_key"] for r in out}) == len(out) == 8
    assert sorted(r["lead_bin"] for r in out) == ["b0", "b0", "b1", "b1"] + ["none"] * 4


def test_fleet_dates(spark):
    rows = [(day(o), s, 100, 10, 90, 5) for o in range(0, 400, 5) for s in ("validation", "test")]
    df = spark.createDataFrame(rows, "anchor_date date, split string, eligible_machines long, positive_machines long, negative_machines long, capacity long")
    found = ch.fleet_anchor_dates(df, {"validation": 3, "test": 2}, 60, 50, 5).collect()
    out = {s: [r["anchor_date"] for r in found if r["split"] == s] for s in ("validation", "test")}
    assert ch.fleet_anchor_dates(df, {"validation": 3, "test": 2}, 60, 500, 5).collect() == []
    assert len(out["validation"]) == 3 and len(out["test"]) == 2
    assert max(out["validation"]) < min(out["test"])


def test_drop_template(spark):
    pairs = spark.createDataFrame([("g", "a", "b", 0.99, 0.99), ("g", "c", "d", 0.92, 0.92), ("g", "b", "c", 0.91, 0.91)], "feature_group string, feature_a string, feature_b string, correlation double, abs_correlation double")
    quality = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 1.0), ("d", 1.0)], "feature string, quality_score double")
    pruned = sc.correlation_prune(pairs, quality)
    assert {(r["feature"], r["action"]) for r in pruned.collect()} == {("a", "keep"), ("b", "drop")}
    out = {(r["feature"], r["source"]) for r in sc.drop_template(pruned, sc.review_pairs(pairs, pruned)).collect()}
    assert out == {("b", "auto_drop"), ("d", "manual_review")}


def test_models_learn_and_importance_finds_the_signal(spark):
    rows = spark.range(600).select(
        "id", ((F.col("id") * 7919) % 100 / 100).alias("x"), ((F.col("id") * 104729) % 97 / 97).alias("noise"), F.date_add(F.lit(BASE), (F.col("id") % 300).cast("int")).alias("day")
    ).withColumn("y", (F.col("x") + F.col("noise") * 0.1 > 0.7).cast("int"))
    model = ml.fit(rows, ["x", "noise"], "y")
    drops = {r["feature"]: r["importance_mean"] for r in ml.permutation_importance(model, rows, ["x", "noise"], "y", ["id"], repeats=2).collect()}
    assert drops["x"] > drops["noise"] + 0.1
    slope, offset = ml.fit_platt(ml.score(model, rows, ["x", "noise"]), "raw_score", "y")
    assert slope > 0
    assert ml.fit_platt(rows.where("y = 1"), "x", "y") == (1.0, 0.0)
    scores = ml.out_of_fold(rows, "day", [("F", day(250).isoformat(), day(300).isoformat())], ["x", "noise"], "y", purge_days=20)
    assert ml.fold_metrics(scores, "y").first()["roc_auc"] > 0.9
    assert len(ml.expand_grid({"a": [1, 2], "b": [3]})) == 2


def test_folds_are_prepared_once_for_all_models(spark, monkeypatch):
    rows = spark.createDataFrame(
        [(i, day(i % 300), None if i % 11 == 0 else float(i % 17), f"c{i % 3}", int(i % 17 > 8) if i % 5 else i % 2) for i in range(1200)],
        "id int, day date, x double, kind string, y int",
    )
    folds = [("F1", day(200).isoformat(), day(240).isoformat()), ("F2", day(250).isoformat(), day(300).isoformat())]
    calls, plain = [], ml.preprocessing
    monkeypatch.setattr(ml, "preprocessing", lambda *a, **k: calls.append(a) or plain(*a, **k))
    options = {"boosted_trees": {"maxIter": 2, "maxDepth": 2}, "random_forest": {"numTrees": 3, "maxDepth": 2}}
    got = ml.out_of_fold(rows, "day", folds, ["x"], "y", tuple(ml.CLASSIFIERS), 20, categorical=["kind"], weight=True, options=options).collect()
    assert len(calls) == len(folds)
    assert Counter((r.algorithm, r.fold) for r in got) == Counter({(a, f): n for a in ml.CLASSIFIERS for f, n in (("F1", 160), ("F2", 200))})
    # the same scores as one pipeline fitted by itself
    split = sp.rolling_origin(rows, "day", *folds[0][1:], 20, 3)
    alone = ml.fit(ml.weighted(split.where("role = 'fit'"), "y"), ["x"], "y", categorical=["kind"], weight="class_weight")
    expected = {r.id: r.raw_score for r in ml.score(alone, split.where("role = 'validation'"), ["x"], ["kind"]).collect()}
    mine = {r.id: r.raw_score for r in got if r.algorithm == "logistic" and r.fold == "F1"}
    assert mine == pytest.approx(expected, abs=1e-6)
    calls.clear()
    tuned = ml.tune(rows, "day", folds, ["x"], "y", {"logistic": {"regParam": [0.0, 0.1]}, "random_forest": {"numTrees": [2, 3]}}, categorical=["kind"], weight=True, purge_days=20)
    assert len(calls) == len(folds) and tuned.count() == 8


def counted(spark, df):
    """``df`` and the number of its rows that have been computed."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInArrow(run, df.schema), seen


def test_random_controls_compute_the_windows_once(spark):
    cases = spark.createDataFrame([(f"g{i}", f"m{i}", "A", "test") for i in range(6)], "case_control_group_id string, machine_key string, full_model string, split string")
    fleet = spark.createDataFrame([(f"m{i}", "A", "test") for i in range(12)], "machine_key string, full_model string, split string")
    windows, seen = counted(spark, spark.createDataFrame([(f"m{i}", day(k), day(k + 60)) for i in range(12) for k in range(3)], "machine_key string, window_start date, window_end date"))
    out = ch.random_controls(cases, fleet, windows, 2).collect()
    assert len(out) == 12 and all(r.machine_key != r.case_machine_key for r in out) and seen.value == 36


def test_ratio_pools_compute_their_rows_once(spark):
    schema = "split string, machine_key string, window_start date, window_end date, `__hash` string"
    rows = lambda n: spark.createDataFrame([("test", f"m{i:02d}", BASE, day(60), f"h{i:02d}") for i in range(n)], schema)
    negatives, seen = counted(spark, rows(12))
    pool = ch.joint_ratio_pool(rows(6), negatives, 2).collect()
    # four positives leave eight of the twelve entities
    assert Counter(r.target for r in pool) == {1: 4, 0: 8} and seen.value == 12
    pool, seen = counted(spark, spark.createDataFrame([(r.split, r.machine_key, r.target, r.negative_rank) for r in pool], "split string, machine_key string, target int, negative_rank long"))
    assert Counter((r.ratio, r.target) for r in ch.nested_ratios(pool, (1, 2)).collect()) == {(1, 1): 4, (1, 0): 4, (2, 1): 4, (2, 0): 8}
    assert seen.value == 12
    fleet, seen = counted(spark, spark.createDataFrame([("test", f"m{i}", BASE, day(-60), BASE, int(i < 3), i) for i in range(10)], "split string, machine_key string, anchor_date date, window_start date, window_end date, target int, days_to_next_claim int"))
    assert Counter(r.target for r in ch.anchor_ratio_pool(fleet, 2).collect()) == {1: 3, 0: 6} and seen.value == 10


def test_balanced_negatives_compute_the_candidates_once(spark):
    rows = [(f"m{i}", "test", day(i), "delayed_claim_negative", f"b{i % 3}") for i in range(12)] + [(f"m{i}", "test", day(i + 100), "strict_negative", "none") for i in range(16)]
    df, seen = counted(spark, spark.createDataFrame(rows, "machine_key string, split string, window_end date, negative_case_type string, lead_bin string"))
    assert len(ch.balanced_negatives(df, 4).collect()) == 8 and seen.value == 28


def test_fleet_and_cases_are_stored_once_for_a_query(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "A") for i in range(10)], "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(i, i % 10, day(i * 9)) for i in range(60)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(k, d + dt.timedelta(days=20)) for k, _, d in orders], "l_orderkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    calls, plain = [], cohort_queries._operation
    monkeypatch.setattr(cohort_queries, "_operation", lambda t: calls.append(1) or plain(t))
    out = QUERIES["mixed_controls"].build(spark, str(tmp_path))
    # once for the coverage of the fleet, once for the activity dates
    assert len(calls) == 2 and "machine_key" in out.columns
    QUERIES["control_audit"].build(spark, str(tmp_path))
    assert len(calls) == 3


def test_segment_and_anchor_features_shuffle_events_once_and_only_those_inside(spark):
    rows = [(f"k{i % 4}", day(i), float(i), i % 2) for i in range(300)] + [("far", day(280), 1.0, 1)]
    raw = spark.createDataFrame(rows, "key string, d date, working_hours_clean double, travel_day_flag int")
    first, last = BASE.isoformat(), day(299).isoformat()
    prepared = sg.prepare_events(raw, F.col("key"), F.col("d"), first, last)
    out = sg.segment_features(prepared, "operation")
    assert {(r.machine_key, r.period_start): (r.operation_day_count, r.operation_working_hours_clean_sum) for r in out.collect()} == {
        (f"k{k}", day(s)): (len(x), sum(x)) for k in range(4) for s in (0, 90, 180) if (x := [i for i in range(s, s + 90) if i % 4 == k])}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1
    seen_rows, seen = [], sg.interval_features
    def spy(windows, events, *a):
        seen_rows.append(events.count())
        return seen(windows, events, *a)
    sg.interval_features = spy
    try:
        grid = sg.anchor_grid(raw.select(F.col("key").alias("machine_key")).distinct(), sg.anchor_plan([("F", first, last, [day(100).isoformat(), day(120).isoformat()])]))
        found = {(r.machine_key, r.anchor_date): r.operation_day_count for r in sg.anchor_features(grid, prepared, "operation").collect()}
    finally:
        sg.interval_features = seen
    assert found == {(f"k{k}", day(a)): len([i for i in range(a - 90, a) if i % 4 == k]) for k in range(4) for a in (100, 120)}
    assert seen_rows == [110]


def test_readers_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2020-01-02", "train"), ("2", "2020-02-03", "test")], "id string, d string, split string")
    for kind, ending in (("csv", "csv"), ("parquet", "parquet"), ("json", "json")):
        path = f"{tmp_path}/t.{ending}"
        readers.write_table(df, path, kind)
        back = readers.read_snapshot(spark, path, "d")
        assert back.select(F.max("d")).first()[0] == dt.date(2020, 2, 3)
    readers.write_table(df, f"{tmp_path}/z.gz", "csv.gz")
    assert readers.read_any(spark, f"{tmp_path}/z.gz").count() == 2
    readers.write_table(df, f"{tmp_path}/by", by=["split"])
    assert spark.read.parquet(f"{tmp_path}/by/split=train").count() == 1
    assert readers.first_existing_path(spark, str(tmp_path), ["nope.csv", "t.csv"]).endswith("t.csv")
    with pytest.raises(FileNotFoundError):
        readers.first_existing_path(spark, str(tmp_path), ["nope.csv"])
    scan = readers.dated_scan(spark.read.parquet(f"{tmp_path}/t.parquet"), "d", "2020-01-01", "2020-02-01")
    assert [r["id"] for r in scan.collect()] == ["1"]


def test_streamed_refresh(spark, tmp_path):
    schema = "k string, v int"
    arrive = lambda rows, turn: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    history = f"{tmp_path}/history"
    for turn, rows in enumerate([[("a", 1), ("a", 2)], [("a", 3), ("b", 4)]]):
        arrive(rows, turn)
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        start_refresh(stream, history, ["k"], f"{tmp_path}/cp").awaitTermination()
    assert sorted(r["v"] for r in spark.read.parquet(history).collect()) == [1, 2, 4]


def test_refresh_batches_read_only_their_folders(spark, tmp_path):
    """Late and repeated batches: a rerun changes nothing, and only folders of the batch's keys are read."""
    schema = "k string, v int"
    history = f"{tmp_path}/history"
    run = refresh_batch(history, ["k"], 16)
    batches = [[(f"k{i}", i) for i in range(40)] + [(None, 7), (None, 8)], [("k3", 100), ("new", 101), ("new", 102), (None, 9)], [("k39", 103), ("late", 104)]]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    for number in (0, 1, 1, 0, 2, 1):
        run(frame(batches[number]), number)
    stored = sorted(r["v"] for r in spark.read.parquet(history).collect())
    assert stored == sorted([*range(40), 7, 8, 101, 102, 104])
    placed = frame([("k3", 1), ("k4", 2)]).withColumn("key_folder", F.pmod(F.xxhash64(key_digest(["k"])), F.lit(16)).cast("int"))
    folders = {r["key_folder"] for r in placed.collect()}
    read = known_rows(placed, history, 9).inputFiles()
    assert read and {int(f.split("key_folder=")[1].split("/")[0]) for f in read} == folders and len(folders) < 16


def test_resample_draws_agree_between_tasks():
    draws = bs.Draws(7, 1, 5000, 40)
    weights = np.diff(draws.before(np.arange(5001)), axis=0)
    assert (weights >= 0).all() and (weights.sum(axis=0) == 5000).all()
    # one multinomial resample: mean 1, variance 1 - 1/n, no dependence on the tree
    assert abs(weights.mean() - 1) < 1e-9 and abs(weights.var() - 1) < 0.02
    edges = np.array([0, 3, 256, 1250, 2500, 2501, 4999, 5000])
    assert (draws.before(edges) == np.concatenate([np.zeros((1, 40), int), weights.cumsum(axis=0)])[edges]).all()
    assert (bs.Draws(7, 1, 0, 3).before(np.array([0])) == 0).all()


def weighted_metrics(rows, weights, sizes):
    """AUC, average precision and hits of selections of weighted rows (score, label, key)."""
    order = sorted(range(len(rows)), key=lambda i: (-rows[i][0], rows[i][2]))
    pos = sum(weights[i] for i in order if rows[i][1])
    neg = sum(weights[i] for i in order if not rows[i][1])
    auc = ap = tp = fp = 0.0
    for score in sorted({r[0] for r in rows}, reverse=True):
        p = sum(weights[i] for i in order if rows[i][0] == score and rows[i][1])
        n = sum(weights[i] for i in order if rows[i][0] == score and not rows[i][1])
        tp, fp = tp + p, fp + n
        auc += n * (tp - p / 2)
        ap += p * tp / (tp + fp) if tp + fp else 0
    hits = []
    for k in sizes:
        left, h = k, 0
        for i in order:
            take = min(left, weights[i])
            left, h = left - take, h + take * rows[i][1]
        hits.append(h)
    return auc / (pos * neg), ap / pos, hits


@pytest.mark.parametrize("chunk", [3, 256])
def test_ranking_replicates_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(bs, "CHUNK", chunk)
    r = np.random.default_rng(1)
    rows = [(float(s) / 10, int(y), f"k{i:04d}") for i, (s, y) in enumerate(zip(r.integers(0, 12, 400), r.random(400) < 0.3, strict=True))]
    rows += [(9.5, 1, "a"), (9.4, 0, "b"), (0.5, 0, "k0000")]
    df = spark.createDataFrame(rows + [(None, 1, "none")], "score double, label int, key string").repartition(5)
    free, top = bs.ranking_replicates(df, "score", "label", "key", 25, 3, rates=(0.1, 0.5), counts=(7, 1000))
    free = {x["replicate"]: x for x in free.collect()}
    top = {(x["replicate"], x["selection_type"], x["selection_value"]): x for x in top.collect()}
    order = sorted(rows, key=lambda x: (-x[0], x[2]))
    by_class = {y: [x for x in order if x[1] == y] for y in (0, 1)}
    weights = {y: np.diff(bs.Draws(3, y, len(x), 25).before(np.arange(len(x) + 1)), axis=0) for y, x in by_class.items()}
    rules = [("top_k_fraction", 0.1, 41), ("top_k_fraction", 0.5, 202), ("top_n", 7.0, 7), ("top_n", 1000.0, 403)]
    for b in range(25):
        drawn = [(x, int(w)) for y in (0, 1) for x, w in zip(by_class[y], weights[y][:, b], strict=True)]
        auc, ap, hits = weighted_metrics([x for x, _ in drawn], [w for _, w in drawn], [k for *_, k in rules])
        assert free[b + 1]["roc_auc"] == pytest.approx(auc) and free[b + 1]["average_precision"] == pytest.approx(ap)
        for (kind, value, k), h in zip(rules, hits, strict=True):
            found = top[b + 1, kind, value]
            assert found["precision"] == pytest.approx(h / k) and found["recall"] == pytest.approx(h / len(by_class[1]))


def test_ranking_intervals_of_one_class_and_no_rows(spark):
    schema = "score double, label int, key string"
    one = bs.ranking_intervals(spark.createDataFrame([(0.1, 1, "a"), (0.2, 1, "b")], schema), "score", "label", "key", 20, counts=(1,)).collect()
    assert {x["metric"] for x in one} == {"precision", "recall", "lift"} and all(x["ci_lower"] in (0.5, 1.0) for x in one)
    assert bs.ranking_intervals(spark.createDataFrame([], schema), "score", "label", "key", 20, counts=(1,)).collect() == []


def test_correlations_of_many_features(spark):
    """300 features in blocks of 128: one plan node per block pair, values as numpy has them over the rows that know both."""
    r = np.random.default_rng(2)
    base = r.normal(size=(200, 300)) + r.normal(size=(200, 1)) + 1e6
    base[:, 7] = 5.0
    holes = r.random(base.shape) < 0.1
    names = [f"f{i:03d}" for i in range(300)]
    data = [[None if h else float(v) for v, h in zip(row, gone, strict=True)] for row, gone in zip(base, holes, strict=True)]
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(3)
    out = sc.correlation_pairs(df, {"all": names, "few": names[:2]}, block=128)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 7
    found = {(x["feature_group"], x["feature_a"], x["feature_b"]): x["correlation"] for x in out.collect()}
    assert len(found) == 300 * 299 // 2 + 1 and found["few", "f000", "f001"] == found["all", "f000", "f001"]
    for a, b in [(0, 1), (3, 250), (127, 128), (298, 299), (7, 9)]:
        both = ~holes[:, a] & ~holes[:, b]
        got = found["all", names[a], names[b]]
        if 7 in (a, b):
            assert got is None
        else:
            assert got == pytest.approx(np.corrcoef(base[both, a], base[both, b])[0, 1], abs=1e-9)


def test_quantiles_of_many_columns(spark):
    r = np.random.default_rng(4)
    columns = {
        "a": [float(x) for x in r.normal(size=700)], "b": [float(x) for x in r.integers(0, 4, 700)], "c": [float(10.0 ** x) for x in r.integers(-300, 300, 700)],
        "d": [None] * 700, "e": [2.5] * 700, "f": [None if i % 3 else float(i) for i in range(700)],
    }
    df = spark.createDataFrame(list(zip(*columns.values(), strict=True)), ", ".join(f"{n} double" for n in columns)).repartition(5)
    places = {"low": 0.0, "p25": 0.25, "mid": 0.5, "odd": 0.777, "top": 1.0}
    for cells in (64, 2048):
        ranks = values_at_ranks(df, {"a": [0, 5, 699], "b": [0, 300, 699], "c": [350], "d": []}, cells)
        for (c, k), (value, before) in ranks.items():
            assert value == sorted(columns[c])[k] and before == sum(x < value for x in columns[c])
    found = {x["feature"]: x for x in column_quantiles(df, list(columns), places).collect()}
    for c, values in columns.items():
        known = [x for x in values if x is not None]
        for name, p in places.items():
            assert (found[c][name] is None) if not known else found[c][name] == pytest.approx(np.quantile(known, p), rel=1e-9)


@pytest.mark.parametrize("kinds", [1, 2, 3, 7, 10, 11, 500])
def test_mutual_information_equals_ranked_bins(spark, kinds):
    r = np.random.default_rng(kinds)
    rows = [(i, float(v), int(y)) for i, (v, y) in enumerate(zip(r.integers(0, kinds, 300), r.random(300) < 0.4, strict=True))]
    df = spark.createDataFrame(rows, "id long, x double, y int").withColumn("z", F.when(F.col("id") % 5 > 0, F.col("x"))).repartition(4)
    out = {x["feature"]: x["mutual_information"] for x in sc.mutual_information(df, ["x", "z"], "y", ["id"]).collect()}
    for name in ("x", "z"):
        values = [(v if name == "x" or i % 5 else 0.0, i, y) for i, v, y in rows]
        different = len({v for v, *_ in values})
        n, b = len(values), min(10, different)
        low = min(v for v, *_ in values)
        cells = {}
        for rank, (v, _, y) in enumerate(sorted(values), 1):
            bin_ = int(v > low) if different <= 2 else max(((rank - 1) * b + n - 2) // (n - 1), 1) - 1
            cells[bin_, y] = cells.get((bin_, y), 0) + 1
        total = lambda k, j: sum(c for key, c in cells.items() if key[j] == k)
        expected = sum(c / n * np.log((c / n) / (total(i, 0) / n * total(y, 1) / n)) for (i, y), c in cells.items())
        assert out[name] == pytest.approx(expected, abs=1e-12)


def test_tail_chances():
    assert stats.f_tail(3.841458820694124, 1, 1e9) == pytest.approx(0.05, abs=1e-7) and stats.f_tail(4.964602744, 1, 10) == pytest.approx(0.05, abs=1e-8)
    assert stats.f_tail(0, 2, 3) == 1 and stats.f_tail(3.098391224, 3, 20) == pytest.approx(0.05, abs=1e-8)
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-12) and stats.chi2_tail(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-12)
    assert stats.chi2_tail(0, 1) == 1 and stats.chi2_tail(400, 2) == pytest.approx(np.exp(-200.0))


def test_thresholds_equal_counts(spark):
    r = np.random.default_rng(8)
    rows = [(f"g{i % 2}", None if i % 17 == 0 else float(s) / 20, int(y)) for i, (s, y) in enumerate(zip(r.integers(0, 20, 300), r.random(300) < 0.5, strict=True))]
    df = spark.createDataFrame(rows, "g string, s double, y int")
    at = spark.createDataFrame([("g0", 0.3), ("g0", 0.35), ("g1", 2.0), ("g1", 0.0)], "g string, threshold double")
    out = m.separation_at_thresholds(df, ["g"], "s", "y", at, on=["g"]).collect()
    assert len(out) == 4
    for x in out:
        mine = [(s, y) for g, s, y in rows if g == x["g"]]
        hit = [y for s, y in mine if s is not None and s >= x["threshold"]]
        assert (x["positive_rows"], x["negative_rows"]) == (sum(y for _, y in mine), sum(1 - y for _, y in mine))
        assert (x["captured_positive_rows"], x["false_positive_rows"]) == (sum(hit), len(hit) - sum(hit))
    curve = {(x["g"], x["point"]): x["quantile"] for x in m.quantile_curve(df, ["g"], "s", 41).collect()}
    for g in ("g0", "g1"):
        known = [s for k, s, _ in rows if k == g and s is not None]
        assert [curve[g, p] for p in range(41)] == pytest.approx([np.quantile(known, p / 40) for p in range(41)])


def test_standard_deviation_of_large_meters(spark):
    """Values of 1e9 with a spread of 1 over several days."""
    values = [(i, 1e9 + (i * 37 % 11) / 5 + k) for i in range(30) for k in (0, 1)]
    events = spark.createDataFrame([("a", day(i), v) for i, v in values], "model_id string, event_day date, v double")
    spine = spark.createDataFrame([("a", day(20)), ("a", day(35)), ("b", day(5))], "model_id string, snapshot_date date")
    specs = [Feature("sd", "stddev", "v", oldest=10), Feature("low", "stddev", "v", "v < 1e9 + 1", oldest=10), Feature("n", "count", oldest=10), Feature("u", "distinct", "cast(v as string)", oldest=10)]
    out = {(x["model_id"], x["snapshot_date"]): x for x in window_features(spine, events, specs).collect()}
    for at in (20, 35):
        mine = [v for i, v in values if at - 10 <= i < at]
        got = out["a", day(at)]
        assert got["sd"] == pytest.approx(np.std(mine, ddof=1), rel=1e-6) and got["n"] == len(mine) and got["u"] == len(set(mine))
        assert got["low"] == pytest.approx(np.std([v for v in mine if v < 1e9 + 1], ddof=1), rel=1e-6)
    assert out["b", day(5)]["sd"] is None and out["b", day(5)]["n"] == 0
    spans = spark.createDataFrame([("a", day(3), day(9))], "model_id string, a date, z date")
    one = interval_features(spans, events, [Feature("sd", "stddev", "v")], "model_id", "a", "z").collect()[0]
    assert one["sd"] == pytest.approx(np.std([v for i, v in values if 3 <= i <= 9], ddof=1), rel=1e-6)
