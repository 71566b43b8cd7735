"""Bootstrap intervals: resamples of rows by repeated splitting, resamples of anchors by hash draws."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_choice, stable_hash
from tidemark.operators.metrics import score_counts
from tidemark.operators.ordering import ordered_scan
from tidemark.session import cut_lineage


class Draws:
    """Resample sizes of row intervals: how many draws of each replicate fall into any stretch of rows.

    A class of ``rows`` rows is resampled with as many draws, all replicates at once. The draws of an interval are
    split at its middle by a binomial draw, down to ``LEAF`` rows, where every draw picks its row. Each split has a
    generator of its own, seeded by its interval, so any task gets the same weights for the same rows without
    seeing the others, and a row's weights are those of one multinomial resample.
    """

    LEAF = 256

    def __init__(self, seed: int, name: int, rows: int, replicates: int):
        self.seed, self.name, self.rows, self.replicates = seed, name, rows, replicates

    def before(self, edges: np.ndarray) -> np.ndarray:
        """Draws among the rows before each edge (ascending row numbers): edges x replicates."""
        out = np.zeros((len(edges), self.replicates), dtype=np.int64)
        pending = [(0, self.rows, np.full(self.replicates, self.rows), np.zeros(self.replicates, dtype=np.int64))]
        while pending:
            low, high, count, seen = pending.pop()
            first, last = np.searchsorted(edges, low, side="right"), np.searchsorted(edges, high, side="left")
            # edges strictly inside still need a split; those at the upper end are settled here
            out[last : np.searchsorted(edges, high, side="right")] = seen + count
            if first == last:
                continue
            random = np.random.default_rng([self.seed, self.name, low, high])
            if high - low <= self.LEAF:
                width = high - low
                place = np.repeat(np.arange(self.replicates) * width, count) + random.integers(0, width, int(count.sum()))
                picked = np.bincount(place, minlength=self.replicates * width).reshape(self.replicates, width).cumsum(axis=1)
                out[first:last] = seen + picked[:, edges[first:last] - low - 1].T
                continue
            middle = (low + high) // 2
            left = random.binomial(count, (middle - low) / (high - low))
            pending.append((low, middle, left, seen))
            pending.append((middle, high, count - left, seen + left))
        return out


#: Distinct scores whose weights a task holds at once, all replicates side by side.
CHUNK = 256


def _rule_sizes(rules: Sequence[tuple[str, float]], size: int) -> list[int]:
    return [max(math.ceil(size * v), 1) if kind == "top_k_fraction" else min(int(v), size) for kind, v in rules]


def _resampled_scores(groups: DataFrame, draws: tuple[Draws, Draws], sizes: Sequence[int]) -> DataFrame:
    """Sums of every replicate over the distinct scores, highest first.

    ``groups`` has the score, its positives and rows and those of higher scores. A score where a selection ends
    between rows of both classes is named with the draws still wanted, as its rows stand in key order.
    """
    replicates = draws[0].replicates
    fields = ["replicate", "auc", "ap"] + [f"{x}{i}" for i in range(len(sizes)) for x in ("tp", "cut", "need")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = np.argsort(batch.column("number").to_numpy())
            score, pos, n, pos_end, n_end = (batch.column(c).to_numpy()[order] for c in ("score", "pos", "n", "pos_end", "n_end"))
            for a in range(0, len(score), CHUNK):
                part = slice(a, a + CHUNK)
                ends = []
                for d, width, end in ((draws[1], pos[part], pos_end[part]), (draws[0], (n - pos)[part], (n_end - pos_end)[part])):
                    edges = np.unique(np.concatenate([end - width, end]))
                    seen = d.before(edges)
                    ends.append((seen[np.searchsorted(edges, end - width)], seen[np.searchsorted(edges, end)]))
                (tp_low, tp), (fp_low, fp) = ends
                hits, misses = tp - tp_low, fp - fp_low
                out = {
                    "replicate": np.arange(1, replicates + 1), "auc": (misses * (tp - hits / 2)).sum(axis=0),
                    "ap": (hits * tp / np.maximum(tp + fp, 1)).sum(axis=0),
                }
                mixed = ((pos[part] > 0) & (pos[part] < n[part]))[:, None]
                for i, k in enumerate(sizes):
                    left = np.clip(k - tp_low - fp_low, 0, hits + misses)
                    cut = (left > 0) & (left < hits + misses) & mixed
                    out[f"tp{i}"] = np.where(cut, 0, np.minimum(left, hits)).sum(axis=0)
                    at = cut.argmax(axis=0)
                    any_cut = cut.any(axis=0)
                    out[f"cut{i}"] = pa.array(score[part][at], mask=~any_cut)
                    out[f"need{i}"] = pa.array(left[at, np.arange(replicates)], mask=~any_cut)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := out[f], pa.Array) else pa.array(x) for f in fields], fields)

    schema = "replicate long, auc double, ap double" + "".join(f", tp{i} long, cut{i} double, need{i} long" for i in range(len(sizes)))
    # neighbours travel together; a piece of them is one task's work
    spread = groups.withColumn("piece", F.floor((F.col("number") - 1) / CHUNK)).repartition("piece").drop("piece")
    return spread.mapInArrow(run, schema).groupBy("replicate").agg(
        F.sum("auc").alias("auc"), F.sum("ap").alias("ap"),
        *[f(f"{x}{i}").alias(f"{x}{i}") for i in range(len(sizes)) for f, x in ((F.sum, "tp"), (F.max, "cut"), (F.max, "need"))],
    )


def _cut_hits(rows: DataFrame, groups: DataFrame, cuts: list, draws: tuple[Draws, Draws], key: str) -> DataFrame:
    """Hits of selections inside the scores that they cut, whose rows count in key order: replicate, rule, hits.

    ``cuts`` holds (replicate, rule, score, draws wanted), one entry for each replicate and rule at most.
    """
    wanted: dict[float, tuple[np.ndarray, ...]] = {}
    for s in {c[2] for c in cuts}:
        mine = [c for c in cuts if c[2] == s]
        wanted[s] = tuple(np.array([c[k] for c in mine]) for k in (0, 1, 3))
    spark = rows.sparkSession
    names = spark.createDataFrame([(float(s),) for s in wanted], "score double")
    inside = rows.join(F.broadcast(names), "score")
    scanned = ordered_scan(inside, ["score"], [F.col(key).asc()], running={"pos_seen": F.col("label"), "seen": F.lit(1)})
    placed = scanned.join(groups.select("score", (F.col("pos_end") - F.col("pos")).alias("pos_start"), (F.col("n_end") - F.col("n")).alias("start")), "score").select(
        "score", "label", F.col("pos_seen").cast("long"), F.col("seen").cast("long"), F.col("pos_start").cast("long"), F.col("start").cast("long")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            for s in np.unique(columns["score"]):
                at = np.flatnonzero(columns["score"] == s)
                at = at[np.argsort(columns["seen"][at])]
                for a in range(0, len(at), CHUNK):
                    x = at[a : a + CHUNK]
                    label, pos, seen = (columns[c][x] for c in ("label", "pos_seen", "seen"))
                    start = int(columns["start"][x[0]]), int(columns["pos_start"][x[0]])
                    sums = []
                    for d, first, end, mine in ((draws[1], start[1], pos, label), (draws[0], start[0] - start[1], seen - pos, 1 - label)):
                        edges = np.unique(np.concatenate([[first], first + end - mine, first + end]))
                        drawn = d.before(edges) - d.before(np.array([first]))
                        sums.append((drawn[np.searchsorted(edges, first + end - mine)], drawn[np.searchsorted(edges, first + end)]))
                    replicate, rule, need = wanted[float(s)]
                    (tp_low, tp), (fp_low, fp) = ((x[0][:, replicate - 1], x[1][:, replicate - 1]) for x in sums)
                    left = np.clip(need - tp_low - fp_low, 0, None)
                    hits = np.minimum(left, tp - tp_low).sum(axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(replicate), pa.array(rule), pa.array(hits)], ["replicate", "rule", "hits"])

    return placed.mapInArrow(run, "replicate long, rule long, hits long").groupBy("replicate", "rule").agg(F.sum("hits").alias("hits"))


def interval(values: DataFrame, group: Sequence[str], columns: Sequence[str], level: float = 0.95) -> DataFrame:
    """Mean, standard error and percentile interval of replicate values, in long form.

    A group holds one value per replicate, so the built-in exact percentile is bounded.
    """
    long = values.select(
        *group,
        F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("__m"),
    ).select(*group, "__m.*").where("value is not null")
    low, high = (1.0 - level) / 2.0, 1.0 - (1.0 - level) / 2.0
    return long.groupBy(*group, "metric").agg(
        F.count("value").alias("valid_resamples"), F.avg("value").alias("bootstrap_mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("bootstrap_standard_error"),
        F.expr(f"percentile(value, {low!r}D)").alias("ci_lower"),
        F.expr(f"percentile(value, {high!r}D)").alias("ci_upper"),
    )


def ranking_replicates(
    df: DataFrame, score: str, label: str, key: str, replicates: int = 1000, seed: int = 42,
    rates: Sequence[float] = (), counts: Sequence[int] = (),
) -> tuple[DataFrame, DataFrame]:
    """(replicate, roc_auc, average_precision) and (replicate, selection, precision, recall, lift) of every replicate.

    Both classes are resampled separately, each to its own size. Equal scores are counted before anything is
    shuffled, so a task handles distinct scores and the weights of all replicates; only selections that end
    between equal scores look at rows again. Rows without a score are left out.
    """
    rows = df.where(F.col(score).isNotNull()).select(F.col(key), F.col(label).cast("int").alias("label"), F.col(score).cast("double").alias("score"))
    groups = ordered_scan(
        score_counts(rows, [], "score", "label"), [], [F.col("score").desc()], "number",
        running={"pos_end": F.col("pos"), "n_end": F.col("n")},
    ).select("number", "score", *[F.col(c).cast("long") for c in ("pos", "n", "pos_end", "n_end")])
    groups = cut_lineage(groups)
    total = groups.agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).first()
    pos, size = int(total["pos"] or 0), int(total["n"] or 0)
    draws = Draws(seed, 0, size - pos, replicates), Draws(seed, 1, pos, replicates)
    rules = [("top_k_fraction", float(r)) for r in rates] + [("top_n", float(c)) for c in counts]
    sizes = _rule_sizes(rules, size)
    per = cut_lineage(_resampled_scores(groups, draws, sizes))
    both = F.lit(pos > 0 and size > pos)
    free = per.select(
        "replicate", F.when(both, F.col("auc") / F.lit(float(max(pos * (size - pos), 1)))).alias("roc_auc"),
        F.when(both, F.col("ap") / F.lit(float(max(pos, 1)))).alias("average_precision"),
    )
    long = per.select("replicate", F.posexplode(F.array(*[
        F.struct(F.lit(kind).alias("selection_type"), F.lit(v).alias("selection_value"), F.lit(float(sizes[i])).alias("k"),
                 F.col(f"tp{i}").alias("tp"), F.col(f"cut{i}").alias("cut"), F.col(f"need{i}").alias("need"))
        for i, (kind, v) in enumerate(rules)
    ])).alias("rule", "r")).select("replicate", F.col("rule").cast("long").alias("rule"), "r.*") if rules else None
    if long is None:
        return free, free.limit(0)
    # one entry for each replicate and rule at most
    cuts = [tuple(r) for r in long.where("need > 0").select("replicate", "rule", "cut", "need").collect()]
    if cuts:
        more = _cut_hits(rows, groups, cuts, draws, key)
        long = long.join(more, ["replicate", "rule"], "left").withColumn("tp", F.col("tp") + F.coalesce("hits", F.lit(0)))
    precision = F.try_divide(F.col("tp"), F.col("k"))
    return free, long.select(
        "replicate", "selection_type", "selection_value", precision.alias("precision"),
        F.try_divide(F.col("tp"), F.lit(float(pos))).alias("recall"),
        F.try_divide(precision, F.lit(pos / size if size else 0.0)).alias("lift"),
    )


def ranking_intervals(
    df: DataFrame, score: str, label: str, key: str, replicates: int = 1000, level: float = 0.95,
    seed: int = 42, rates: Sequence[float] = (), counts: Sequence[int] = (),
) -> DataFrame:
    """Bootstrap intervals of AUC, average precision and every top selection."""
    free, top = ranking_replicates(df, score, label, key, replicates, seed, rates, counts)
    out = interval(free, [], ["roc_auc", "average_precision"], level).select(
        F.lit("all").alias("selection_type"), F.lit(0.0).alias("selection_value"), "*"
    )
    if rates or counts:
        out = out.unionByName(interval(top, ["selection_type", "selection_value"], ["precision", "recall", "lift"], level))
    return out


# ------------------------------------------------------------------ anchors as clusters
def anchor_resamples(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], replicates: int, seed: int, tag: str,
    columns: Sequence[str],
) -> DataFrame:
    """Resampled anchor rows per group and replicate.

    A group holds one row per anchor, a number that the evaluation plan fixes, so a plain
    window may number it.
    """
    window = Window.partitionBy(*group)
    numbered = rows.select(*group, *order, *columns).withColumns(
        {"__row": F.row_number().over(window.orderBy(*order)), "__size": F.count(F.lit(1)).over(window)}
    )
    parts = [F.lit(f"{tag}|"), *[x for c in group for x in (F.col(c).cast("string"), F.lit("|"))]]
    drawn = numbered.select(*group, "__row", "__size").withColumn(
        "replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))
    ).withColumn(
        "__row",
        (hash_choice(stable_hash(seed, *parts, F.col("replicate"), F.lit("|"), F.col("__row")), F.col("__size")) + 1).cast("int"),
    ).drop("__size")
    return drawn.join(numbered.select(*group, "__row", *columns), [*group, "__row"])


def anchor_precision_interval(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], replicates: int = 1000, level: float = 0.95,
    seed: int = 42, tag: str = "precision", low: str = "ci_low", high: str = "ci_high",
) -> DataFrame:
    """Interval of the pooled precision when whole anchors are resampled."""
    drawn = anchor_resamples(
        rows, group, order, replicates, seed, tag, ["selected_machines", "true_positive_machines"]
    )
    per = drawn.groupBy(*group, "replicate").agg(
        F.try_divide(F.sum("true_positive_machines").cast("double"), F.sum("selected_machines").cast("double")).alias("value")
    )
    return _ends(per, group, level, low, high)


def anchor_value_interval(
    rows: DataFrame, group: Sequence[str], order: Sequence[str], column: str, statistic: str = "mean",
    q: float = 0.1, replicates: int = 1000, level: float = 0.95, seed: int = 42, tag: str = "value",
    low: str = "ci_low", high: str = "ci_high",
) -> DataFrame:
    """Interval of the mean, median or a quantile of an anchor-level value."""
    known = rows.where(F.col(column).isNotNull())
    drawn = anchor_resamples(known, group, order, replicates, seed, f"{tag}|{column}|{statistic}", [column])
    level_of = {"median": 0.5, "quantile": q}
    value = F.avg(column) if statistic == "mean" else F.expr(f"percentile({column}, {level_of[statistic]!r}D)")
    per = drawn.groupBy(*group, "replicate").agg(value.alias("value"))
    return _ends(per, group, level, low, high)


def _ends(per: DataFrame, group: Sequence[str], level: float, low: str, high: str) -> DataFrame:
    a = (1.0 - level) / 2.0
    return per.where("value is not null").groupBy(*group).agg(
        F.expr(f"percentile(value, {a!r}D)").alias(low), F.expr(f"percentile(value, {1.0 - a!r}D)").alias(high)
    )
