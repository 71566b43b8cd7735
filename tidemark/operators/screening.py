"""Feature screening: inventories, correlation groups, target tests and consensus.

Wide tables are turned into long (feature, value) rows where a statistic needs it; counts,
moments and cross products come from one wide aggregate pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import chi2_tail, f_tail
from tidemark.operators.ordering import column_quantiles, ordered_scan, values_at_ranks
from tidemark.session import cut_lineage


def _number(c: str) -> Column:
    value = F.col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def long_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per input row and feature: ``feature`` and double ``value``."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), _number(f).alias("value")) for f in features])
    return df.select(*keep, F.explode(pairs).alias("__p")).select(*keep, "__p.*")


def _unpivot(row: DataFrame, features: Sequence[str], columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{c}").alias(c) for c in columns]) for f in features
    ])
    return row.select(*keep, F.explode(entries).alias("__e")).select(*keep, "__e.*")


def missing_report(df: DataFrame, features: Sequence[str], split: str = "split") -> DataFrame:
    """Missing count and rate per split and feature, from one aggregate pass."""
    wide = df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(F.col(f).isNull(), 1)).alias(f"{f}__missing_count") for f in features],
    )
    return _unpivot(wide, features, ["missing_count"], [split, "rows"]).withColumn(
        "missing_rate", F.col("missing_count") / F.col("rows")
    )


def feature_inventory(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Moments, quartiles, zero and negative rates and class means of every feature."""
    parts = []
    for f in features:
        v, y = _number(f), F.col(target)
        stats = {
            "rows": F.count(F.lit(1)), "non_missing": F.count(v), "mean": F.avg(v),
            "var": F.var_samp(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v),
            "zeros": F.count(F.when(v == 0, 1)), "negatives": F.count(F.when(v < 0, 1)),
            "mean_target_1": F.avg(F.when(y == 1, v)), "mean_target_0": F.avg(F.when(y == 0, v)),
        }
        parts += [c.alias(f"{f}__{n}") for n, c in stats.items()]
        names = list(stats)
    base = _unpivot(df.agg(*parts), features, names)
    # many exact distinct counts in one aggregate would copy every row once per feature
    long = long_features(df, features).where("value is not null")
    unique = long.distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("unique"))
    numbers = df.select(*[_number(f).alias(f) for f in features])
    quartiles = column_quantiles(numbers, features, {"p25": 0.25, "median": 0.5, "p75": 0.75})
    out = base.join(unique, "feature", "left").join(quartiles, "feature", "left")
    return out.withColumn("unique", F.coalesce("unique", F.lit(0))).withColumns(
        {
            "zero_rate": F.try_divide(F.col("zeros").cast("double"), F.col("non_missing").cast("double")),
            "negative_rate": F.try_divide(F.col("negatives").cast("double"), F.col("non_missing").cast("double")),
        }
    ).drop("zeros", "negatives")


def high_missing(report: DataFrame, split_name: str, threshold: float, split: str = "split") -> DataFrame:
    """Features whose missing rate in one split exceeds the threshold."""
    return report.where((F.col(split) == split_name) & (F.col("missing_rate") > threshold))


def zero_variance(inventory: DataFrame) -> DataFrame:
    """Features with at most one distinct known value."""
    return inventory.where(F.col("unique") <= 1)


def usable_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with a known value and more than one distinct one."""
    wide = df.agg(*[c for f in features for c in (
        F.count(_number(f)).alias(f"{f}__known"), F.min(_number(f)).alias(f"{f}__lo"), F.max(_number(f)).alias(f"{f}__hi"))])
    return _unpivot(wide, features, ["known", "lo", "hi"]).select(
        "feature", ((F.col("known") > 0) & (F.col("lo") < F.col("hi"))).cast("int").alias("usable")
    )


def feature_group(feature: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """Group of a feature name: the first regular expression that matches wins."""
    group = F.lit(default)
    for pattern, name in reversed(list(rules)):
        group = F.when(feature.rlike(pattern), F.lit(name)).otherwise(group)
    return group


#: Features of one block of the product matrices: a task holds four square matrices of this width.
GRAM_BLOCK = 500


def _products(df: DataFrame, left: Sequence[str], right: Sequence[str], shift: Mapping[str, float]) -> DataFrame:
    """For every pair (left i, right j): rows that know both, and the sums of both, their squares and their product.

    Each task adds up matrix products of its rows; the tasks' matrices are added up by pair. Values are taken less
    ``shift``, so that large means do not cancel.
    """
    names = list(dict.fromkeys([*left, *right]))
    at = {n: i for i, n in enumerate(names)}
    one, two = [at[n] for n in left], [at[n] for n in right]
    fields = ["i", "j", "n", "a", "b", "aa", "bb", "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, len(one), len(two)))
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(len(names))])
            known = ~np.isnan(x)
            x, m = np.where(known, x, 0.0), known.astype(np.float64)
            u, v, mu, mv = x[:, one], x[:, two], m[:, one], m[:, two]
            total += np.stack([mu.T @ mv, u.T @ mv, mu.T @ v, (u * u).T @ mv, mu.T @ (v * v), u.T @ v])
        i, j = np.meshgrid(np.arange(len(one)), np.arange(len(two)), indexing="ij")
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()) for c in (i, j, *total)], fields)

    values = df.select(*[(_number(n) - F.lit(float(shift.get(n) or 0.0))).alias(f"__x{k}") for k, n in enumerate(names)])
    partial = values.mapInArrow(run, "i long, j long, n double, a double, b double, aa double, bb double, ab double")
    return partial.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in fields[2:]])


def correlation_pairs(df: DataFrame, groups: Mapping[str, Sequence[str]], block: int = GRAM_BLOCK) -> DataFrame:
    """Pearson correlation of every feature pair inside each group, over the rows that know both features.

    A group is cut into blocks of features; the sums of every pair of blocks come from matrix products over
    one pass, so plans and rows grow with the blocks and not with the pairs' expressions.
    """
    every = sorted({n for names in groups.values() for n in names})
    means = df.agg(*[F.avg(_number(n)).alias(f"m{k}") for k, n in enumerate(every)]).first() if every else []
    shift = {n: means[k] for k, n in enumerate(every)}
    spark, found = df.sparkSession, []
    for g, names in groups.items():
        ordered = sorted(names)
        blocks = [ordered[k : k + block] for k in range(0, len(ordered), block)]
        for p, left in enumerate(blocks):
            for right in blocks[p:]:
                label = lambda side: F.array(*map(F.lit, side))
                sums = _products(df, left, right, shift).select(
                    F.lit(g).alias("feature_group"), F.get(label(left), F.col("i").cast("int")).alias("feature_a"), F.get(label(right), F.col("j").cast("int")).alias("feature_b"),
                    "n", "a", "b", "aa", "bb", "ab",
                )
                found.append(sums.where("feature_a < feature_b"))
    schema = "feature_group string, feature_a string, feature_b string, n double, a double, b double, aa double, bb double, ab double"
    table = reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
    c = F.col
    spread = lambda x, xx: F.greatest(c("n") * c(xx) - c(x) * c(x), F.lit(0.0))
    # a spread below rounding is that of a constant
    flat = lambda x, xx: spread(x, xx) <= F.lit(1e-12) * c("n") * c(xx)
    r = (c("n") * c("ab") - c("a") * c("b")) / F.sqrt(spread("a", "aa") * spread("b", "bb"))
    value = F.when((c("n") > 1) & ~flat("a", "aa") & ~flat("b", "bb"), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))
    return table.select("feature_group", "feature_a", "feature_b", value.alias("correlation")).withColumn("abs_correlation", F.abs("correlation"))


def correlated_components(pairs: DataFrame, features: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Connected groups of features joined by strong correlations: ``feature``, ``component``.

    Each turn gives a feature the smallest label among its neighbours and itself until no
    label changes. The graph has one node per feature.
    """
    strong = pairs.where(F.col("abs_correlation") >= threshold)
    edges = strong.select("feature_a", "feature_b").unionByName(
        strong.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"))
    )
    edges = cut_lineage(edges)
    labels = cut_lineage(features.select("feature", F.col("feature").alias("component")))
    while True:
        near = edges.join(labels, F.col("feature_b") == F.col("feature")).groupBy("feature_a").agg(F.min("component").alias("__m"))
        moved = labels.join(near, F.col("feature") == F.col("feature_a"), "left").select(
            "feature", F.least("component", F.coalesce("__m", F.col("component"))).alias("component"),
            F.coalesce(F.col("__m") < F.col("component"), F.lit(False)).alias("__changed"),
        )
        moved = cut_lineage(moved)
        labels = moved.select("feature", "component")
        if moved.where("__changed").isEmpty():
            return labels


def correlation_prune(pairs: DataFrame, quality: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Best feature of every component is kept, the others are dropped.

    ``quality`` has ``feature`` and ``quality_score``; ties keep the smaller name.
    """
    labels = correlated_components(pairs, quality, threshold).join(quality, "feature")
    sizes = labels.groupBy("component").agg(
        F.count(F.lit(1)).alias("component_size"),
        F.max_by(F.col("feature"), F.struct("quality_score")).alias("__any"),
        F.max("quality_score").alias("__top"),
    )
    best = labels.join(sizes, "component").where(F.col("quality_score") == F.col("__top")).groupBy("component").agg(
        F.min("feature").alias("kept_feature"), F.max("component_size").alias("component_size")
    )
    return labels.join(best.where("component_size > 1"), "component").select(
        "component", "component_size", "feature", "quality_score", "kept_feature",
        F.when(F.col("feature") == F.col("kept_feature"), "keep").otherwise("drop").alias("action"),
    )


def review_pairs(pairs: DataFrame, dropped: DataFrame, low: float = 0.90, high: float = 0.95) -> DataFrame:
    """Pairs for manual review: correlation in [low, high), neither feature dropped already."""
    gone = dropped.where("action = 'drop'").select("feature")
    near = pairs.where((F.col("abs_correlation") >= low) & (F.col("abs_correlation") < high))
    return near.join(gone, F.col("feature_a") == F.col("feature"), "left_anti").join(
        gone, F.col("feature_b") == F.col("feature"), "left_anti"
    )


def drop_template(pruned: DataFrame, review: DataFrame) -> DataFrame:
    """One list of proposed drops: automatic ones, and open ones from the review pairs."""
    auto = pruned.where("action = 'drop'").select(
        "feature", F.col("kept_feature").alias("related_feature"), F.lit("auto_drop").alias("source"), F.lit(1).alias("confirmed_drop")
    )
    manual = review.select(
        F.col("feature_b").alias("feature"), F.col("feature_a").alias("related_feature"),
        F.lit("manual_review").alias("source"), F.lit(0).alias("confirmed_drop"),
    )
    return auto.unionByName(manual)


#: What a part of a feature's name adds to its score.
NAME_SCORES = {
    "severity_score": 30.0, "fault_count": 24.0, "occurrence": 18.0, "working_hours": 16.0, "engine_running": 15.0,
    "actual_work": 14.0, "remaining_hours": 13.0, "days_since": 12.0, "count": 10.0, "sum_": 8.0, "max_": 8.0, "mean_": 6.0,
    "smr": 5.0, "has_": -8.0, "flag": -8.0, "valid": -8.0, "observed_day_count": -6.0, "missing": -6.0, "unknown": -4.0,
}


def name_priority(feature: Column) -> Column:
    """Sum of the scores of all name parts that stand in a feature's name."""
    name, total = F.lower(feature), F.lit(0.0)
    for part, value in NAME_SCORES.items():
        total += F.when(F.contains(name, F.lit(part)), value).otherwise(0.0)
    return total


def quality_table(inventory: DataFrame, prepared: DataFrame | None = None) -> DataFrame:
    """Score by which a correlated group keeps a feature; the target has no part in it.

    Few missing values, many different ones, spread and a telling name count. ``prepared`` is the
    inventory after preparation (feature, source_feature, unique, var); without it features are used as they are.
    """
    if prepared is None:
        prepared = inventory.select("feature", F.col("feature").alias("source_feature"), "unique", "var")
    raw = inventory.select(
        F.col("feature").alias("source_feature"), F.col("unique").alias("__raw_unique"),
        (F.lit(1.0) - F.try_divide(F.col("non_missing").cast("double"), F.col("rows").cast("double"))).alias("__missing"),
    )
    known = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    score = (
        known("__missing") * -100.0 + F.log1p(known("__raw_unique")) * 2.0 + F.log1p(known("unique"))
        + F.log1p(F.greatest(known("var"), F.lit(0.0))) * 0.01
        + name_priority(F.col("source_feature")) + name_priority(F.col("feature")) * 0.25
    )
    return prepared.join(raw, "source_feature", "left").select("feature", score.alias("quality_score"))


# ------------------------------------------------------------------ target tests
def anova_f(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-way ANOVA F of every feature over the two classes; missing values count as 0."""
    filled = [F.coalesce(_number(f), F.lit(0.0)).alias(f) for f in features]
    rows = long_features(df.select(target, *filled), features, [target])
    per = rows.groupBy("feature", target).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss")
    )
    sums = per.groupBy("feature").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.col("m")).alias("t"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum("ss").alias("within"),
    )
    between = F.col("q") - F.col("t") * F.col("t") / F.col("N")
    f_value = F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("N") - F.col("k")))
    return sums.select("feature", f_value.alias("f_score"))


def mutual_information(
    df: DataFrame, features: Sequence[str], target: str, order: Sequence[str], bins: int = 10
) -> DataFrame:
    """Mutual information between the target and every feature; missing values count as 0.

    A feature of one or two values is used as it is. Others are cut into ``bins`` bins, or as many as
    they have values, of nearly equal count: rows are ranked with ties broken by ``order``, and the
    cuts are right-closed quantiles of the ranks.
    """
    filled = df.select(target, *order, *[(F.coalesce(_number(f), F.lit(0.0)) + F.lit(0.0)).alias(f"__f{i}") for i, f in enumerate(features)])
    names = {f"__f{i}": f for i, f in enumerate(features)}
    n = filled.count()
    # distinct values up to the number of bins decide how many bins there are; more need not be told apart
    low, kinds = {}, {}
    ends = filled.agg(*[f(c).alias(f"{x}{c}") for c in names for x, f in (("lo", F.min), ("hi", F.max))]).first()
    few = _few_values(filled, list(names), bins)
    for c in names:
        low[c], kinds[c] = ends[f"lo{c}"], few[c]
    # the ranks (from 0) at which the bins 2, 3, ... begin
    starts = {c: [-(-((j - 1) * (n - 1) + 1) // kinds[c]) for j in range(2, kinds[c] + 1)] if kinds[c] > 2 else [] for c in names}
    at = values_at_ranks(filled.select(*names), starts)
    plain, tied = [], []
    for c, f in names.items():
        value = F.col(c)
        if kinds[c] <= 2:
            plain.append(F.struct(F.lit(f).alias("feature"), value.alias("value"), (value > F.lit(low[c])).cast("int").alias("bin")))
            continue
        cuts = [at[c, r] for r in starts[c]]
        values = F.array(*[F.lit(v) for v, _ in cuts])
        # below and above the values at the cuts the value alone tells the bin; rows of those values are ranked
        bin_of = F.size(F.filter(values, lambda v: v < value))
        plain.append(F.when(~F.array_contains(values, value), F.struct(F.lit(f).alias("feature"), value.alias("value"), bin_of.cast("int").alias("bin"))))
        before = F.create_map(*[F.lit(x) for v, b in dict(cuts).items() for x in (float(v), int(b))])
        tied.append(F.when(F.array_contains(values, value), F.struct(F.lit(f).alias("feature"), value.alias("value"), F.lit(kinds[c]).alias("kinds"), F.element_at(before, value).alias("before"))))
    keep = [target, *order]
    listed = lambda parts: filled.select(*keep, F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("__x")).select(*keep, "__x.*")
    binned = listed(plain).select("feature", "bin", target)
    if tied:
        ranked = ordered_scan(listed(tied), ["feature", "value"], [F.col(c).asc() for c in order], number="__turn", few_groups=True)
        place = F.expr(f"((before + __turn - 1) * kinds + {n} - 2) div ({n} - 1)")
        binned = binned.unionByName(ranked.select("feature", (F.greatest(place, F.lit(1)) - 1).cast("int").alias("bin"), target))
    cells = binned.groupBy("feature", "bin", target).agg(F.count(F.lit(1)).alias("c")).withColumn("n", F.lit(n))
    # bins x classes rows per feature from here on
    by_bin = F.sum("c").over(Window.partitionBy("feature", "bin"))
    by_class = F.sum("c").over(Window.partitionBy("feature", target))
    p = F.col("c") / F.col("n")
    info = p * F.log(p / ((by_bin / F.col("n")) * (by_class / F.col("n"))))
    return cells.withColumn("__i", info).groupBy("feature").agg(F.sum("__i").alias("mutual_information"))


def _few_values(df: DataFrame, columns: Sequence[str], most: int) -> dict[str, int]:
    """Number of different values of every column, at most ``most``: a task only keeps so many of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray] = [np.zeros(0)] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                if len(seen[i]) < most:
                    x = batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64)
                    seen[i] = np.unique(np.concatenate([seen[i], x]))[:most]
        rows = [(c, float(v)) for c, values in zip(columns, seen, strict=True) for v in values]
        if rows:
            names, values = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values)], ["name", "value"])

    found = df.select(*columns).mapInArrow(run, "name string, value double").distinct().groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["name"]: min(r["n"], most) for r in found.collect()}
    return {c: counts.get(c, 0) for c in columns}


def chi2_minmax(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """Chi-square of the min-max scaled feature sums per class; missing values count as 0."""
    filled = df.select(target, *[F.coalesce(_number(f), F.lit(0.0)).alias(f) for f in features])
    rows = long_features(filled, features, [target])
    per = rows.groupBy("feature", target).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    over = Window.partitionBy("feature")
    low, high = F.min("lo").over(over), F.max("hi").over(over)
    observed = F.coalesce(F.try_divide(F.col("s") - F.col("n") * low, high - low), F.lit(0.0))
    table = per.withColumn("o", observed).withColumn("e", F.sum("o").over(over) * F.col("n") / F.sum("n").over(over))
    return table.groupBy("feature").agg(
        F.sum(F.coalesce(F.try_divide((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")), F.col("e")), F.lit(0.0))).alias("chi2_score")
    )


def with_p_value(report: DataFrame, score: str, tail: Callable[..., float], *degrees: Column) -> DataFrame:
    """``report`` (one row per feature) with ``p_value``: the tail chance of its score; NULL without a score."""

    @F.pandas_udf("double")
    def chance(value: pd.Series, *given: pd.Series) -> pd.Series:
        rows = zip(value, *given, strict=True)
        return pd.Series([None if pd.isna(v) else tail(float(v), *map(float, d)) for v, *d in rows], dtype="float64")

    return report.withColumn("p_value", chance(F.col(score), *degrees))


def target_tests(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """F of the ANOVA and chi-square of every feature with their p-values; two classes have one degree of freedom."""
    rows = df.where(F.col(target).isNotNull()).agg(F.count(F.lit(1)).cast("double").alias("__n"), (F.count_distinct(target) - 1).cast("double").alias("__k"))
    both = anova_f(df, features, target).join(chi2_minmax(df, features, target), "feature").join(F.broadcast(rows))
    tested = with_p_value(both, "f_score", f_tail, F.col("__k"), F.col("__n") - F.col("__k") - 1).withColumnRenamed("p_value", "f_p_value")
    return with_p_value(tested, "chi2_score", chi2_tail, F.col("__k")).withColumnRenamed("p_value", "chi2_p_value").drop("__n", "__k")


def consensus(features: DataFrame, reports: Mapping[str, DataFrame]) -> DataFrame:
    """Mean of the ranks a feature has in the reports that know it, and the rank of that mean.

    ``reports`` maps a name to a table of ``feature`` and ``score``. A feature without a score in a report
    shares its last rank; one row per feature.
    """
    out = features.select("feature")
    whole = Window.partitionBy(F.lit(0))
    for name, table in reports.items():
        ranked = table.select("feature", F.rank().over(whole.orderBy(F.desc_nulls_last("score"))).alias(f"rank_{name}"))
        out = out.join(ranked, "feature", "left")
    ranks = [F.col(f"rank_{n}") for n in reports]
    known = sum((r.isNotNull().cast("int") for r in ranks), F.lit(0))
    total = sum((F.coalesce(r, F.lit(0)) for r in ranks), F.lit(0))
    out = out.withColumn("mean_rank", F.try_divide(total.cast("double"), known.cast("double")))
    return out.withColumn("consensus_rank", F.rank().over(whole.orderBy(F.col("mean_rank").asc_nulls_last())))


def ranked_codes(
    df: DataFrame, codes: Sequence[str], target: str, minimum_support: int = 30, count: int = 10
) -> DataFrame:
    """Code columns by (rate present - rate absent) * sqrt(support).

    A code needs ``minimum_support`` rows with it and as many without. Ties go by rate difference,
    support and name, each descending.
    """
    y = F.col(target).cast("double")
    wide = df.agg(*[c for f in codes for c in (
        F.count(F.when(_number(f) > 0, 1)).alias(f"{f}__support"), F.avg(F.when(_number(f) > 0, y)).alias(f"{f}__with"),
        F.count(F.when(F.coalesce(_number(f) <= 0, F.lit(True)), 1)).alias(f"{f}__others"),
        F.avg(F.when(F.coalesce(_number(f) <= 0, F.lit(True)), y)).alias(f"{f}__without"))])
    long = _unpivot(wide, codes, ["support", "others", "with", "without"]).where(
        (F.col("support") >= minimum_support) & (F.col("others") >= minimum_support)
    )
    lift = F.col("with") - F.col("without")
    scored = long.select(
        "feature", "support", F.col("with").alias("rate_present"), F.col("without").alias("rate_absent"), (lift * F.sqrt("support")).alias("score")
    )
    return scored.orderBy(F.desc("score"), F.desc(F.col("rate_present") - F.col("rate_absent")), F.desc("support"), F.desc("feature")).limit(count)


def class_weight(df: DataFrame, target: str, root: bool = False) -> DataFrame:
    """Negatives over positives (or its square root); 1 without positives."""
    pos, neg = F.sum((F.col(target) == 1).cast("long")), F.sum((F.col(target) == 0).cast("long"))
    value = F.coalesce(F.try_divide(neg.cast("double"), pos.cast("double")), F.lit(1.0))
    return df.agg(pos.alias("positives"), neg.alias("negatives"), (F.sqrt(value) if root else value).alias("scale_pos_weight"))
