"""Case-control cohorts and holdouts with deterministic hash sampling.

Matched controls come from an index of claim-free stretches: an entity is listed under
(stratum, day bin) where a claim-free span of a case could begin, so a case meets only
candidates of its own bin, and visits those in an order of its own until it has enough.
Random controls are looked up on a ring of the stratum's entities with an eligible window.
Positions come from ``ordered_scan`` and are spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.keys import hash_choice, stable_hash
from tidemark.operators.labels import horizon_target
from tidemark.operators.ordering import first_per_group, ordered_scan
from tidemark.operators.spine import spaced_dates
from tidemark.operators.temporal import anti_range, asof_join
from tidemark.session import cut_lineage

KEY = "machine_key"
PRIOR_FREE_DAYS = 30
FUTURE_FREE_DAYS = 180


def covered(start: Column, end: Column) -> Column:
    """Whether the source coverage of an entity overlaps a window."""
    return F.coalesce(
        (F.col("first_source_date") <= end) & (F.col("last_source_date") >= start), F.lit(False)
    )


# ------------------------------------------------------------------ cases
def case_windows(
    episodes: DataFrame, master: DataFrame, lead_max: int, lead_min: int, name: str = "window"
) -> DataFrame:
    """Window ``[claim-lead_max, claim-lead_min]`` of every episode with its status and reason.

    ``master`` gives split and source coverage. Rows with status ``selected`` are the cases.
    """
    joined = episodes.join(
        master.select(KEY, F.col("split"), "first_source_date", "last_source_date"), KEY, "left"
    )
    start, end = F.date_sub("claim_date", lead_max), F.date_sub("claim_date", lead_min)
    reason = (
        F.when(F.col("split").isNull(), "machine_missing_fixed_split_assignment")
        .when(~covered(start, end), "positive_no_source_coverage_overlap_window")
        .otherwise("eligible")
    )
    return joined.withColumns(
        {
            "window_start": start, "window_end": end,
            "case_control_group_id": F.concat(F.lit(f"{name}__"), F.col("claim_episode_id")),
            "status": F.when(reason == "eligible", "selected").otherwise("positive_excluded"), "reason": reason,
        }
    )


def capped_cases(cases: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` cases, shared over the splits in proportion, in hash order.

    Largest remainders take the spare places; every split keeps one case while the limit
    allows. The quotas come from a table with one row per split.
    """
    sizes = cases.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(F.lit(0))
    table = sizes.select(
        "split", "n", (F.lit(limit) * F.col("n") / F.sum("n").over(whole)).alias("__raw"),
        F.count(F.lit(1)).over(whole).alias("__splits"), F.sum("n").over(whole).alias("__all"),
    ).withColumn("__base", F.greatest(F.floor("__raw"), F.when(F.lit(limit) >= F.col("__splits"), 1).otherwise(0)))
    table = table.withColumn("__spare", F.lit(limit) - F.sum("__base").over(whole))
    up = F.row_number().over(whole.orderBy((F.col("__raw") - F.col("__base")).desc(), F.col("n").desc(), "split"))
    down = F.row_number().over(whole.orderBy(F.col("__base").desc(), F.col("__raw").desc(), "split"))
    quota = F.col("__base") + (up <= F.col("__spare")).cast("int") - (down <= -F.col("__spare")).cast("int")
    quotas = table.select("split", F.when(F.col("__all") <= limit, F.col("n")).otherwise(quota).alias("__quota"))
    ranked = ordered_scan(
        cases.withColumn("__hash", stable_hash(seed, F.col("case_control_group_id"))), ["split"],
        [F.col("__hash").asc(), F.col("case_control_group_id").asc()], number="__rank",
    )
    return ranked.join(F.broadcast(quotas), "split").where("__rank <= __quota").select(*cases.columns)


# ------------------------------------------------------------------ eligible windows
def activity_dates(operation: DataFrame, others: Sequence[tuple[DataFrame, str]], day: str = "event_day") -> DataFrame:
    """Distinct operation days per entity; days of the other sources only without any."""
    main = operation.select(KEY, F.to_date(day).alias("window_end")).where(f"{KEY} is not null and window_end is not null").distinct()
    union = None
    for df, name in others:
        part = df.select(KEY, F.to_date(name).alias("window_end"))
        union = part if union is None else union.unionByName(part)
    if union is None:
        return main
    spare = union.where("window_end is not null").join(main.select(KEY).distinct(), KEY, "left_anti").distinct()
    return main.unionByName(spare)


def eligible_windows(
    dates: DataFrame, master: DataFrame, claims: DataFrame, days: int, last_observed: DataFrame,
    prior: int = PRIOR_FREE_DAYS, future: int = FUTURE_FREE_DAYS,
) -> DataFrame:
    """Windows of ``days`` ending on activity days, covered, followed up and free of claims.

    ``claims`` has (key, claim_date); ``last_observed`` is one row with ``label_end``.
    """
    rows = (
        dates.join(master.select(KEY, "first_source_date", "last_source_date"), KEY)
        .withColumn("window_start", F.date_sub("window_end", days))
        .where(covered(F.col("window_start"), F.col("window_end")))
        .join(F.broadcast(last_observed.select("label_end").limit(1)))
        .where(F.date_add("window_end", future) <= F.col("label_end"))
        .withColumns({"control_no_claim_start": F.date_sub("window_start", prior), "control_no_claim_end": F.date_add("window_end", future)})
    )
    free = anti_range(rows, claims, KEY, "control_no_claim_start", "control_no_claim_end", "claim_date")
    return free.select(KEY, "window_start", "window_end", "control_no_claim_start", "control_no_claim_end")


def chosen_window(windows: DataFrame, digest: Column) -> DataFrame:
    """One window per entity: number ``digest mod count`` in date order.

    An entity has at most one window per calendar day, so the plain window is bounded.
    ``digest`` is a hash over entity columns.
    """
    over = Window.partitionBy(KEY)
    numbered = windows.withColumns(
        {"__turn": F.row_number().over(over.orderBy("window_end")) - 1, "eligible_window_count": F.count(F.lit(1)).over(over)}
    )
    return numbered.where(F.col("__turn") == hash_choice(digest, F.col("eligible_window_count"))).drop("__turn")


# ------------------------------------------------------------------ rings
def ring(candidates: DataFrame, stratum: Sequence[str], seed: int, tag: str) -> DataFrame:
    """Candidates with their place (0-based) and the size of their stratum."""
    hashed = candidates.withColumn("__hash", stable_hash(seed, F.lit(f"{tag}|"), F.col(KEY)))
    placed = ordered_scan(
        hashed, stratum, [F.col("__hash").asc(), F.col(KEY).asc()], number="__n", size="ring_size"
    )
    return placed.select(*candidates.columns, (F.col("__n") - 1).alias("ring_place"), "ring_size")


def _starts(cases: DataFrame, placed: DataFrame, stratum: Sequence[str], seed: int, tag: str) -> DataFrame:
    sizes = placed.groupBy(*stratum).agg(F.max("ring_size").alias("__size"))
    digest = stable_hash(seed, F.col("case_control_group_id"), F.lit(f"|{tag}"))
    return cases.join(sizes, list(stratum)).withColumn("__start", hash_choice(digest, F.col("__size")))


def _visit(cases: DataFrame, placed: DataFrame, stratum: Sequence[str], first: int, count: int) -> DataFrame:
    """Ring places ``first`` to ``first+count-1`` after each case's start."""
    steps = F.sequence(F.lit(first), F.least(F.lit(first + count), F.col("__size")) - 1)
    spread = cases.where(F.col("__size") > first).withColumn("__step", F.explode(steps)).withColumn(
        "__place", (F.col("__start") + F.col("__step")) % F.col("__size")
    )
    others = placed.select(
        *[F.col(c).alias(f"__s_{c}") for c in stratum], F.col("ring_place").alias("__place"),
        F.struct(*[F.col(c) for c in placed.columns if c not in stratum]).alias("__candidate"),
    )
    match = spread["__place"] == others["__place"]
    for c in stratum:
        match = match & (spread[c] == others[f"__s_{c}"])
    return spread.join(others, match).drop(others["__place"]).drop("__place", *[f"__s_{c}" for c in stratum])


#: Days of one bin of the index; a free span is longer, so an entity is listed once in a bin.
BIN_DAYS = 30


class ControlIndex:
    """Candidates of every (stratum, day bin), each with the claim-free stretch that a case's span must lie in.

    A stretch reaches from one claim of an entity to the next. It is listed in the bins where a span can begin that
    lies inside it and whose window the entity's coverage meets, for the spans that the cases have: entities times
    bins rows at most, none where no span fits. Places of a bin follow a hash order.
    """

    def __init__(
        self, cases: DataFrame, candidates: DataFrame, claims: DataFrame, stratum: Sequence[str], seed: int, tag: str,
        prior: int = PRIOR_FREE_DAYS, future: int = FUTURE_FREE_DAYS,
    ):
        self.stratum, self.seed, self.tag, self.prior, self.future = list(stratum), seed, tag, prior, future
        self.bin_days = max(1, min(BIN_DAYS, prior + future))
        width = F.datediff("window_end", "window_start")
        low = F.unix_date(F.date_sub("window_start", prior))
        spans = cases.agg(
            F.min(low).alias("__low"), F.max(low).alias("__high"), F.min(width).alias("__short"), F.max(width).alias("__long")
        )
        known = candidates.where("first_source_date is not null and last_source_date is not null")
        days = claims.select(KEY, F.unix_date("claim_date").alias("__day")).where("__day is not null").distinct()
        # one row per entity and claim day: the calendar bounds the window
        after = F.lead("__day").over(Window.partitionBy(KEY).orderBy("__day"))
        behind = days.withColumn("__until", after).select(KEY, (F.col("__day") + 1).alias("__from"), (F.col("__until") - 1).alias("__until"))
        before = days.groupBy(KEY).agg((F.min("__day") - 1).alias("__until")).select(KEY, F.lit(None).cast("int").alias("__from"), "__until")
        free = known.join(before.unionByName(behind), KEY, "left").join(F.broadcast(spans))
        first, last = F.unix_date("first_source_date"), F.unix_date("last_source_date")
        begin = F.greatest("__from", first - F.col("__long") - prior, F.col("__low"))
        end = F.least(F.col("__until") - F.col("__short") - prior - future, last - prior, F.col("__high"))
        step = lambda day: F.floor(day / F.lit(self.bin_days)).cast("int")
        listed = free.withColumns({"__begin": begin, "__end": end}).where("__begin <= __end").select(
            *self.stratum, KEY, "__from", "__until", first.alias("__first"), last.alias("__last"),
            F.explode(F.sequence(step(F.col("__begin")), step(F.col("__end")))).alias("__bin"),
            stable_hash(seed, F.lit(f"{tag}|"), F.col(KEY)).alias("__hash"),
        )
        placed = ordered_scan(listed, [*self.stratum, "__bin"], [F.col("__hash").asc(), F.col(KEY).asc()], "__place", "__size")
        self.rows = cut_lineage(placed.drop("__hash").withColumn("__place", F.col("__place") - 1))

    def walks(self, cases: DataFrame) -> DataFrame:
        """Cases with a candidate in their bin, and the order in which they visit the bin's places.

        Step j of a case is place (stride * j + shift) modulo ``__span``, the power of two above the bin's size: an odd
        stride meets every place once, and stride and shift are hashes of the case, so draws of different cases are
        independent and no place follows another more often.
        """
        sizes = self.rows.groupBy(*self.stratum, "__bin").agg(F.max("__size").alias("__size"))
        span = F.expr("shiftleft(1L, length(bin(__size - 1)))")
        number = lambda name, count: hash_choice(stable_hash(self.seed, F.col("case_control_group_id"), F.lit(f"|{self.tag}|{name}")), count)
        low = F.unix_date(F.date_sub("window_start", self.prior))
        return cases.select("case_control_group_id", KEY, *self.stratum, "window_start", "window_end").withColumns(
            {"__lo": low, "__hi": F.unix_date(F.date_add("window_end", self.future)), "__bin": F.floor(low / F.lit(self.bin_days)).cast("int")}
        ).join(sizes, [*self.stratum, "__bin"]).withColumn("__span", span).withColumns(
            {"__stride": 2 * number("stride", (F.col("__span") / 2).cast("long")) + 1, "__shift": number("shift", F.col("__span"))}
        )

    def eligible(self, walks: DataFrame, first: Column, count: Column) -> DataFrame:
        """case_control_group_id, control_key, __step: eligible candidates at the steps ``first`` to ``first + count - 1``."""
        steps = F.sequence(first.cast("long"), F.least(first + count, F.col("__span")).cast("long") - 1)
        visits = walks.where(first < F.col("__span")).withColumn("__step", F.explode(steps)).withColumn(
            "__place", F.pmod(F.col("__stride") * F.col("__step") + F.col("__shift"), F.col("__span"))
        ).where(F.col("__place") < F.col("__size")).drop("__size")
        met = visits.join(self.rows.withColumnRenamed(KEY, "control_key").drop("__size"), [*self.stratum, "__bin", "__place"])
        c = F.col
        return met.where(
            (c("control_key") != c(KEY))
            & F.coalesce(c("__from") <= c("__lo"), F.lit(True)) & F.coalesce(c("__hi") <= c("__until"), F.lit(True))
            & (c("__first") <= F.unix_date("window_end")) & (c("__last") >= F.unix_date("window_start"))
        ).select("case_control_group_id", "control_key", "__step")


def followed_up(cases: DataFrame, last_observed: DataFrame, future: int) -> DataFrame:
    """Cases whose claim-free span after the window is observed to its end."""
    return cases.join(F.broadcast(last_observed.select("label_end").limit(1))).where(
        F.date_add("window_end", future) <= F.col("label_end")
    ).drop("label_end")


def matched_controls(
    cases: DataFrame, candidates: DataFrame, claims: DataFrame, last_observed: DataFrame, count: int,
    stratum: Sequence[str] = ("full_model", "split"), seed: int = 42,
    prior: int = PRIOR_FREE_DAYS, future: int = FUTURE_FREE_DAYS, block: int | None = None,
) -> DataFrame:
    """Up to ``count`` controls per case: same stratum, same window, no claim around it.

    ``cases`` need group id, key, stratum, window_start and window_end. A case visits the
    candidates of its day bin in its own order, a block of steps at a time; blocks grow
    fourfold for cases that still lack controls and end with the bin, so the result does not
    depend on the block size and a case that nothing fits costs its bin only.
    """
    observed = followed_up(cases, last_observed, future)
    index = ControlIndex(observed, candidates, claims, stratum, seed, "controlled", prior, future)
    open_cases = cut_lineage(index.walks(observed).withColumn("__have", F.lit(0).cast("long")))
    columns = open_cases.columns
    first, size, found = 0, block or 4 * count, None
    while True:
        free = index.eligible(open_cases, F.lit(first), F.lit(size)).join(open_cases.select("case_control_group_id", "__have"), "case_control_group_id")
        # a case visits at most one block per round, so its window is bounded
        turn = F.row_number().over(Window.partitionBy("case_control_group_id").orderBy("__step")) + F.col("__have")
        fresh = cut_lineage(free.withColumn("control_number", turn).where(F.col("control_number") <= count).select(
            "case_control_group_id", "control_key", "control_number"
        ))
        found = fresh if found is None else found.unionByName(fresh)
        got = fresh.groupBy("case_control_group_id").agg(F.count(F.lit(1)).alias("__new"))
        first += size
        open_cases = cut_lineage(
            open_cases.join(got, "case_control_group_id", "left")
            .withColumn("__have", F.col("__have") + F.coalesce(F.col("__new"), F.lit(0)))
            .where((F.col("__have") < count) & (F.col("__span") > first)).select(*columns)
        )
        if open_cases.isEmpty():
            break
        size *= 4
    windows = cases.select("case_control_group_id", F.col(KEY).alias("case_machine_key"), *stratum, "window_start", "window_end")
    return found.join(windows, "case_control_group_id").select(
        "case_control_group_id", "case_machine_key", F.col("control_key").alias(KEY), *stratum,
        "window_start", "window_end", "control_number",
    )


def random_controls(
    cases: DataFrame, candidates: DataFrame, windows: DataFrame, count: int, spare: int = 0,
    stratum: Sequence[str] = ("full_model", "split"), seed: int = 42,
) -> DataFrame:
    """Up to ``count + spare`` controls per case with a hash-chosen eligible window each.

    The ring holds only entities with an eligible window, so one visit of
    ``count + spare + 1`` places is always enough (one of them may be the case itself).
    The windows are read three times and stored once.
    """
    windows = cut_lineage(windows.select(KEY, "window_start", "window_end"))
    with_window = candidates.join(windows.select(KEY).distinct(), KEY, "left_semi")
    placed = cut_lineage(ring(with_window, stratum, seed, "random"))
    start = _starts(cases.select("case_control_group_id", KEY, *stratum), placed, stratum, seed, "random")
    seen = _visit(start, placed, stratum, 0, count + spare + 1).where(F.col(f"__candidate.{KEY}") != F.col(KEY))
    turn = F.row_number().over(Window.partitionBy("case_control_group_id").orderBy("__step"))
    picked = seen.withColumn("control_number", turn).where(F.col("control_number") <= count + spare).select(
        "case_control_group_id", F.col(KEY).alias("case_machine_key"), F.col(f"__candidate.{KEY}").alias(KEY), *stratum, "control_number"
    )
    over = Window.partitionBy(KEY)
    numbered = windows.select(
        F.col(KEY).alias("__key"), "window_start", "window_end",
        (F.row_number().over(over.orderBy("window_end")) - 1).alias("__turn"),
    )
    sizes = windows.groupBy(F.col(KEY).alias("__k")).agg(F.count(F.lit(1)).alias("__count"))
    digest = stable_hash(seed, F.col("case_control_group_id"), F.lit("|"), F.col(KEY), F.lit("|window"))
    drawn = picked.join(sizes, F.col(KEY) == F.col("__k")).withColumn("__pick", hash_choice(digest, F.col("__count")))
    return drawn.join(numbered, (F.col(KEY) == F.col("__key")) & (F.col("__pick") == F.col("__turn"))).select(
        "case_control_group_id", "case_machine_key", KEY, *stratum, "window_start", "window_end", "control_number"
    )


def mixed_controls(controlled: DataFrame, random: DataFrame, count: int) -> DataFrame:
    """Half controlled (rounded up), then random, then further controlled, ``count`` in all.

    ``controlled`` and ``random`` list up to ``count`` and ``2 * count`` controls per case;
    an entity counts once per case. A case has at most ``3 * count`` rows here.
    """
    half = (count + 1) // 2
    first = controlled.withColumns(
        {"negative_sampling_type": F.lit("controlled"), "__class": F.when(F.col("control_number") <= half, 0).otherwise(2)}
    )
    second = random.withColumns({"negative_sampling_type": F.lit("random"), "__class": F.lit(1)})
    both = first.unionByName(second)
    once = first_per_group(both, ["case_control_group_id", KEY], [F.col("__class").asc(), F.col("control_number").asc()])
    turn = F.row_number().over(Window.partitionBy("case_control_group_id").orderBy("__class", "control_number", KEY))
    return once.withColumn("control_number_within_group", turn).where(
        F.col("control_number_within_group") <= count
    ).drop("__class", "control_number")


def control_audit(cases: DataFrame, controls: DataFrame, requested: int) -> DataFrame:
    """Selected number of controls per case; cases without any are excluded."""
    got = controls.groupBy("case_control_group_id").agg(F.count(F.lit(1)).alias("selected_negative_count"))
    n = F.coalesce(F.col("selected_negative_count"), F.lit(0).cast("long"))
    return cases.select("case_control_group_id", KEY, "split").join(got, "case_control_group_id", "left").withColumns(
        {
            "selected_negative_count": n, "requested_negative_count": F.lit(requested),
            "status": F.when(n == 0, "case_excluded_no_eligible_negatives").otherwise("selected"),
        }
    )


# ------------------------------------------------------------------ holdouts
def fixed_horizon_windows(
    master: DataFrame, dates: DataFrame, last_observed: DataFrame, days: int, followup: int,
    seed: int = 42, name: str = "window",
) -> DataFrame:
    """One outcome-independent window per entity, or the reason why there is none."""
    bounds = master.join(F.broadcast(last_observed.select("label_end").limit(1))).withColumns(
        {"__from": F.date_add("first_source_date", days), "__to": F.least("last_source_date", F.date_sub("label_end", followup))}
    )
    raw = dates.groupBy(KEY).agg(F.count(F.lit(1)).alias("__raw"))
    inside = dates.join(bounds.select(KEY, "split", "__from", "__to"), KEY).where(
        F.col("window_end").between(F.col("__from"), F.col("__to"))
    )
    digest = stable_hash(seed, F.lit(f"{name}|"), F.col("split"), F.lit("|"), F.col(KEY), F.lit("|fixed_horizon_window"))
    picked = chosen_window(inside, digest).select(KEY, "window_end", "eligible_window_count")
    out = bounds.join(raw, KEY, "left").join(picked, KEY, "left")
    reason = (
        F.when(F.col("first_source_date").isNull() | F.col("last_source_date").isNull(), "missing_source_coverage")
        .when(F.col("__raw").isNull(), "no_activity_dates")
        .when(F.col("__to") < F.col("__from"), "insufficient_history_or_future_followup")
        .when(F.col("window_end").isNull(), "no_activity_date_in_eligible_range")
        .otherwise("eligible")
    )
    return out.select(
        KEY, "split", reason.alias("reason"), F.coalesce("__raw", F.lit(0)).alias("candidate_activity_dates"),
        F.coalesce("eligible_window_count", F.lit(0)).alias("eligible_activity_dates"),
        F.date_sub("window_end", days).alias("window_start"), "window_end",
    )


def one_case_per_entity(cases: DataFrame, seed: int, scope: str) -> DataFrame:
    """The hash-first case window of every (split, entity), with its hash."""
    digest = stable_hash(
        seed, F.lit(f"{scope}|"), F.col("split"), F.lit("|"), F.col(KEY), F.lit("|"), F.col("claim_episode_id"), F.lit("|positive_claim_window")
    )
    hashed = cases.withColumn("__hash", digest)
    row = F.min_by(F.struct("*"), F.struct("__hash", "claim_date", "claim_episode_id"))
    return hashed.groupBy(F.col("split").alias("__s"), F.col(KEY).alias("__k")).agg(row.alias("__row")).select("__row.*")


def joint_ratio_pool(positives: DataFrame, negatives: DataFrame, ratio: int) -> DataFrame:
    """The largest pool where every entity has one class and negatives reach ``ratio`` to one.

    Both inputs have one row per (split, entity) and a ``__hash`` order. With the first p
    positives taken, the negatives left are all negatives minus those already positive; a
    running count of that overlap gives every feasible p in one scan. The negatives are read
    three times and stored once.
    """
    negatives = cut_lineage(negatives.select("split", KEY, "window_start", "window_end", "__hash"))
    overlap = positives.join(negatives.select("split", KEY, F.lit(1).alias("__both")), ["split", KEY], "left")
    ranked = ordered_scan(
        overlap, ["split"], [F.col("__hash").asc(), F.col(KEY).asc()], number="positive_rank", size="__p",
        running={"__taken": F.col("__both")}, totals={"__overlap": F.col("__both")},
    )
    sizes = negatives.groupBy("split").agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked.join(sizes, "split").withColumn(
        "__fits",
        (F.col("__n") - F.col("__taken") >= F.col("positive_rank") * ratio)
        & (F.col("positive_rank") <= F.floor((F.col("__p") + F.col("__n") - F.col("__overlap")) / F.lit(ratio + 1))),
    )
    ranked = cut_lineage(ranked)
    best = ranked.where("__fits").groupBy("split").agg(F.max("positive_rank").alias("__best"))
    chosen = ranked.join(best, "split").where("positive_rank <= __best")
    left = negatives.join(chosen.select("split", KEY), ["split", KEY], "left_anti")
    placed = ordered_scan(left, ["split"], [F.col("__hash").asc(), F.col(KEY).asc()], number="negative_rank")
    taken = placed.join(best, "split").where(F.col("negative_rank") <= F.col("__best") * ratio)
    pos = chosen.select("split", KEY, "window_start", "window_end", F.lit(1).alias("target"), "positive_rank", F.lit(None).cast("long").alias("negative_rank"))
    neg = taken.select("split", KEY, "window_start", "window_end", F.lit(0).alias("target"), F.lit(None).cast("long").alias("positive_rank"), "negative_rank")
    return pos.unionByName(neg)


#: Open cases and unused index rows up to which one task plays the remaining rounds of an exclusive pool.
LOCAL_ROWS = 2_000_000
#: Cells of the arrays of one step of that task.
LOCAL_CELLS = 1 << 20


def _codes(*columns: pa.ChunkedArray) -> np.ndarray:
    """Whole numbers that are equal where the values of the columns, one behind the other, are equal."""
    whole = pa.concat_arrays([chunk for column in columns for chunk in column.chunks])
    return whole.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _numbers(column: pa.ChunkedArray, missing: int = 0) -> np.ndarray:
    return pc.fill_null(column, missing).to_numpy().astype(np.int64)


def _play_rounds(cases: pa.Table, rows: pa.Table, stratum: Sequence[str], seed: int, ratio: int, turn: int):
    """The rounds of ``controlled_ratio_pool`` from number ``turn`` on, in arrays.

    ``cases`` are walks of open cases, ``rows`` the unused rows of the index. Gives the places in ``cases`` of the
    settled ones, the places in ``rows`` of their controls in asking order, and the open cases of every round.
    """
    n = cases.num_rows
    entity = _codes(cases[KEY], rows["control_key"])
    me, entities = entity[:n], int(entity.max(initial=0)) + 1
    bins = np.zeros(len(entity), dtype=np.int64)
    for c in (*stratum, "__bin"):
        code = _codes(cases[c], rows[c])
        bins = np.unique(bins * (int(code.max(initial=0)) + 1) + code, return_inverse=True)[1]
    span, stride, shift, size, low, high = (_numbers(cases[c]) for c in ("__span", "__stride", "__shift", "__size", "__lo", "__hi"))
    opens, ends = (_numbers(cases[c]) for c in ("__opens", "__ends"))
    wide = int(span.max(initial=1))
    at = bins[n:] * wide + _numbers(rows["__place"])
    order = np.argsort(at)
    at, control = at[order], entity[n:][order]
    day = np.iinfo(np.int32)
    since, until, first, last = (
        _numbers(rows[c], missing)[order] for c, missing in (("__from", day.min), ("__until", day.max), ("__first", 0), ("__last", 0))
    )
    names = pc.cast(cases["case_control_group_id"], pa.string()).to_pylist()
    used = np.zeros(entities, dtype=bool)
    begin, held = np.zeros(n, dtype=np.int64), np.full((n, ratio), -1, dtype=np.int64)
    alive, settled, log = np.arange(n if len(at) else 0), [], []
    while True:
        # a case keeps the unused of its controls and walks on until it has enough or its walk ends
        mine = held[alive]
        good = (mine >= 0) & ~used[control[mine]] if len(alive) else mine >= 0
        mine = np.take_along_axis(np.where(good, mine, -1), np.argsort(~good, axis=1, kind="stable"), 1)
        have, steps = good.sum(axis=1), 2 * ratio
        while True:
            short = np.flatnonzero((have < ratio) & (begin[alive] < span[alive]))
            if not len(short):
                break
            rows_at_once = max(1, LOCAL_CELLS // steps)
            for part in (short[i : i + rows_at_once] for i in range(0, len(short), rows_at_once)):
                i = alive[part][:, None]
                step = begin[i] + np.arange(steps)
                place = (stride[i] * step + shift[i]) & (span[i] - 1)
                spot = bins[i] * wide + place
                met = np.minimum(np.searchsorted(at, spot), len(at) - 1)
                fits = (
                    (step < span[i]) & (place < size[i]) & (at[met] == spot) & (control[met] != me[i]) & ~used[control[met]]
                    & (since[met] <= low[i]) & (high[i] <= until[met]) & (first[met] <= ends[i]) & (last[met] >= opens[i])
                )
                number, want = fits.cumsum(axis=1), (ratio - have[part])[:, None]
                case, place_in_row = np.nonzero(fits & (number <= want))
                mine[part[case], have[part][case] + number[case, place_in_row] - 1] = met[case, place_in_row]
                enough = number >= want
                begin[i[:, 0]] += np.where(enough.any(axis=1), enough.argmax(axis=1) + 1, steps)
                have[part] += np.minimum(number[:, -1], want[:, 0])
            steps = min(4 * steps, 4096)
        held[alive] = mine
        alive, mine = alive[have == ratio], mine[have == ratio]
        log.append(len(alive))
        if not len(alive):
            return settled, order, log
        digest = [(hashlib.md5(f"{seed}|round {turn + len(log) - 1}|{names[i]}".encode()).hexdigest()[:16], names[i]) for i in alive]
        rank = np.empty(len(alive), dtype=np.int64)
        rank[sorted(range(len(alive)), key=digest.__getitem__)] = np.arange(len(alive))
        wishes = np.column_stack([me[alive], control[mine]])
        best = np.full(entities, len(alive), dtype=np.int64)
        np.minimum.at(best, wishes.ravel(), np.repeat(rank, ratio + 1))
        won = (best[wishes] == rank[:, None]).all(axis=1)
        settled.append((alive[won], mine[won]))
        used[wishes[won].ravel()] = True
        alive = alive[~used[me[alive]]]


def _rounds_in_one_task(walks: DataFrame, rows: DataFrame, stratum: Sequence[str], seed: int, ratio: int, turn: int) -> DataFrame:
    """Settled (group, case_key, control_key, rank) of bounded inputs; rows without a group tell a round's open cases."""
    group, names = "case_control_group_id", list(stratum)
    left = walks.select(
        F.lit(0).alias("__one"), group, KEY, *names, "__bin", "__span", "__stride", "__shift", "__size", "__lo", "__hi",
        F.unix_date("window_start").alias("__opens"), F.unix_date("window_end").alias("__ends"),
    )
    right = rows.select(F.lit(0).alias("__one"), F.col(KEY).alias("control_key"), *names, "__bin", "__place", "__from", "__until", "__first", "__last")
    kind = {f.name: f.dataType.simpleString() for f in (*left.schema, *right.schema)}

    def run(cases: pa.Table, spare: pa.Table) -> pa.Table:
        settled, order, log = _play_rounds(cases, spare, names, seed, ratio, turn)
        who = np.concatenate([np.repeat(c, ratio) for c, _ in settled]) if settled else np.zeros(0, dtype=np.int64)
        whom = order[np.concatenate([m.ravel() for _, m in settled])] if settled else who
        blank, rounds = [None] * len(log), list(range(turn, turn + len(log)))
        told = lambda column, taken: pa.concat_arrays([column.take(pa.array(taken)).combine_chunks(), pa.array(blank, column.type)])
        return pa.table({
            group: told(cases[group], who), "case_key": told(cases[KEY], who), "control_key": told(spare["control_key"], whom),
            "rank": pa.array([*np.tile(np.arange(1, ratio + 1), len(who) // ratio), *rounds], pa.int32()),
            "open": pa.array([None] * len(who) + log, pa.int64()),
        })

    paired = left.groupBy("__one").cogroup(right.groupBy("__one"))
    return cut_lineage(paired.applyInArrow(
        run, f"{group} {kind[group]}, case_key {kind[KEY]}, control_key {kind['control_key']}, rank int, open long"
    ))


def controlled_ratio_pool(
    cases: DataFrame, candidates: DataFrame, claims: DataFrame, last_observed: DataFrame, ratio: int,
    stratum: Sequence[str] = ("full_model", "split"), seed: int = 42,
    prior: int = PRIOR_FREE_DAYS, future: int = FUTURE_FREE_DAYS, rounds: list[int] | None = None,
) -> DataFrame:
    """Cases with exactly ``ratio`` matched controls; every entity appears once at most.

    ``cases`` hold one row per (split, entity). A case keeps a cursor on its walk through its
    bin and the unused controls that it holds. Each round, cases that hold too few fetch only
    their next steps; every case with enough asks for its first ``ratio`` controls, and an
    entity goes to the asking case with the smallest priority. A case that wins itself and all
    its controls is settled, one whose walk has ended with too few is dropped. Priorities are
    drawn anew each round, so a settled case in every neighbourhood of conflicts is likely and
    the rounds grow with the logarithm of the cases. As soon as the open cases and the unused rows
    of the index number ``LOCAL_ROWS`` at most, one task plays the remaining rounds in arrays, with
    the same steps and priorities. ``rounds`` collects the open cases of every round.
    """
    observed = followed_up(cases, last_observed, future)
    index = ControlIndex(observed, candidates, claims, stratum, seed, "controlled", prior, future)
    group = "case_control_group_id"
    walks = cut_lineage(index.walks(observed).where(F.col(group).isNotNull()))
    open_cases = cut_lineage(walks.select(group, F.col(KEY).alias("case_key"), "__span", F.lit(0).cast("long").alias("__next"), F.lit(2 * ratio).cast("long").alias("__fetch")))
    held = used = settled = None
    turn = 0
    while True:
        spare, still = index.rows, walks
        if used is not None:
            spare = spare.join(used.withColumnRenamed("used_key", KEY), KEY, "left_anti")
            still = walks.join(open_cases.select(group), group, "left_semi")
        if max(open_cases.count(), spare.count()) <= LOCAL_ROWS:
            ended = _rounds_in_one_task(still, spare, stratum, seed, ratio, turn)
            if rounds is not None:
                told = ended.where("open is not null").orderBy("rank").select("open").collect()
                rounds.extend([r["open"] for r in told] or [0])
            new = ended.where("open is null").drop("open")
            settled = new if settled is None else settled.unionByName(new)
            break
        # fetch the next steps of cases that hold too few, until they have enough or their walk ends
        while True:
            have = held.groupBy(group).agg(F.count(F.lit(1)).alias("__have")) if held is not None else None
            counted = open_cases.join(have, group, "left") if have is not None else open_cases.withColumn("__have", F.lit(0).cast("long"))
            short = cut_lineage(counted.where((F.coalesce("__have", F.lit(0)) < ratio) & (F.col("__next") < F.col("__span"))).select(group, "__next", "__fetch"))
            if short.isEmpty():
                break
            fresh = index.eligible(walks.join(short, group), F.col("__next"), F.col("__fetch"))
            if used is not None:
                fresh = fresh.join(used.withColumnRenamed("used_key", "control_key"), "control_key", "left_anti")
            fresh = fresh.select(group, "control_key", "__step")
            held = cut_lineage(fresh if held is None else held.unionByName(fresh))
            moved = short.select(group, F.lit(True).alias("__moved"))
            open_cases = cut_lineage(open_cases.join(moved, group, "left").select(
                group, "case_key", "__span",
                F.when(F.col("__moved"), F.col("__next") + F.col("__fetch")).otherwise(F.col("__next")).alias("__next"),
                F.when(F.col("__moved"), F.col("__fetch") * 4).otherwise(F.col("__fetch")).alias("__fetch"),
            ))
        if held is None:
            # no bin of any case has a candidate
            if rounds is not None:
                rounds.append(0)
            break
        # a case holds the unused ones of the steps it fetched
        order = F.row_number().over(Window.partitionBy(group).orderBy("__step"))
        asked = held.withColumn("rank", order).where(F.col("rank") <= ratio)
        full = asked.groupBy(group).agg(F.count(F.lit(1)).alias("__got")).where(F.col("__got") == ratio).select(group)
        open_cases = cut_lineage(open_cases.join(full, group))
        if rounds is not None:
            rounds.append(open_cases.count())
        if open_cases.isEmpty():
            break
        priority = stable_hash(seed, F.lit(f"round {turn}|"), F.col(group))
        asked = cut_lineage(asked.join(open_cases.select(group, "case_key"), group).withColumn("__priority", priority))
        wishes = asked.select(group, "__priority", F.col("control_key").alias("entity")).unionByName(
            asked.where("rank = 1").select(group, "__priority", F.col("case_key").alias("entity"))
        )
        winner = wishes.groupBy("entity").agg(F.min(F.struct("__priority", group)).alias("__w"))
        won = wishes.join(winner, "entity").groupBy(group).agg(F.min((F.col(f"__w.{group}") == F.col(group)).cast("int")).alias("__all")).where("__all = 1").select(group)
        new = cut_lineage(asked.join(won, group).select(group, "case_key", "control_key", "rank"))
        settled = new if settled is None else settled.unionByName(new)
        taken = new.select(F.col("control_key").alias("used_key")).unionByName(new.where("rank = 1").select(F.col("case_key").alias("used_key")))
        used = cut_lineage(taken if used is None else used.unionByName(taken))
        open_cases = cut_lineage(open_cases.join(used.withColumnRenamed("used_key", "case_key"), "case_key", "left_anti"))
        held = cut_lineage(held.join(open_cases.select(group), group, "left_semi").join(used.withColumnRenamed("used_key", "control_key"), "control_key", "left_anti"))
        turn += 1
    columns = [group, *stratum, "window_start", "window_end"]
    if settled is None:
        return cases.select(*columns, KEY, F.lit(1).alias("target"), F.lit(0).alias("control_rank")).limit(0)
    pairs = settled.join(cases.select(*columns), group)
    pos = pairs.where("rank = 1").select(*columns, F.col("case_key").alias(KEY), F.lit(1).alias("target"), F.lit(0).alias("control_rank"))
    neg = pairs.select(*columns, F.col("control_key").alias(KEY), F.lit(0).alias("target"), F.col("rank").alias("control_rank"))
    return pos.unionByName(neg)


def nested_ratios(pool: DataFrame, ratios: Sequence[int], group: Sequence[str] = ("split",)) -> DataFrame:
    """Cohorts of 1:1, 2:1 and so on from one pool, stored once: same positives, nested negatives."""
    pool = cut_lineage(pool)
    sizes = pool.where("target = 1").groupBy(*group).agg(F.count(F.lit(1)).alias("__pos"))
    return (
        pool.join(sizes, list(group))
        .withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in ratios])))
        .where((F.col("target") == 1) | (F.col("negative_rank") <= F.col("ratio") * F.col("__pos")))
        .drop("__pos")
    )


def horizon_ratio_cohorts(
    rows: DataFrame, days: str, horizons: Sequence[int], ratios: Sequence[int], seed: int = 42, group: Sequence[str] = (),
) -> DataFrame:
    """Exact ratios for each horizon with that horizon's own labels, ranked by hash within ``group``, as snapshot days."""
    spread = rows.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    target = F.lit(0)
    for h in horizons:
        target = F.when(F.col("horizon") == h, horizon_target(F.col(days), h)).otherwise(target)
    digest = stable_hash(
        seed, F.lit("horizon_specific_random|"), F.col("split"), F.lit("|"), F.col("horizon"), F.lit("|"), F.col(KEY)
    )
    labeled = spread.withColumns({"target": target, "__hash": digest})
    ranked = ordered_scan(
        labeled, [*group, "split", "horizon", "target"], [F.col("__hash").asc(), F.col(KEY).asc()], number="__rank"
    )
    counts = ranked.groupBy(*group, "split", "horizon").agg(
        F.sum("target").alias("__p"), F.sum(1 - F.col("target")).alias("__n")
    ).withColumn("__take", F.least(F.col("__p"), F.floor(F.col("__n") / F.lit(max(ratios)))))
    return (
        ranked.join(counts, [*group, "split", "horizon"])
        .withColumn("ratio", F.explode(F.array(*[F.lit(int(r)) for r in sorted(ratios)])))
        .where(
            ((F.col("target") == 1) & (F.col("__rank") <= F.col("__take")))
            | ((F.col("target") == 0) & (F.col("__rank") <= F.col("__take") * F.col("ratio")))
        )
        .select(*group, KEY, "split", "horizon", "ratio", "target", F.col("__rank").alias("rank"))
    )


# ------------------------------------------------------------------ anchors
def anchor_feasibility(
    master: DataFrame, claims: DataFrame, lead_min: int, days: int, first: str | date, last: DataFrame,
    followup: int, ratio: int = 1, inclusive: bool = True,
) -> DataFrame:
    """Eligible, positive and negative entities per candidate anchor date and split.

    Candidate dates lie at most ``lead_min`` days before a claim, inside the observable
    range. Coverage is counted by adding entries and exits per day, and positives by
    spreading each claim over the days it labels, so dates never meet the whole fleet.
    """
    low = 0 if inclusive else 1
    near = claims.select(KEY, F.explode(F.sequence(F.date_sub("claim_date", lead_min), F.date_sub("claim_date", low))).alias("anchor_date")).distinct()
    bounds = last.select(F.date_sub("label_end", followup).alias("__hi")).limit(1)
    begin = F.date_add(F.lit(str(first)).cast("date"), days)
    near = near.join(F.broadcast(bounds)).where((F.col("anchor_date") >= begin) & (F.col("anchor_date") <= F.col("__hi"))).drop("__hi")
    known = master.where("split is not null and first_source_date is not null and last_source_date is not null")
    hit = near.join(known.select(KEY, "split", "first_source_date", "last_source_date"), KEY).where(
        (F.col("first_source_date") <= F.col("anchor_date")) & (F.col("last_source_date") >= F.date_sub("anchor_date", days))
    )
    positives = hit.groupBy("anchor_date", "split").agg(F.count(F.lit(1)).alias("positive_machines"))
    steps = known.select("split", F.col("first_source_date").alias("__day"), F.lit(1).alias("__d")).unionByName(
        known.select("split", F.date_add("last_source_date", days + 1).alias("__day"), F.lit(-1).alias("__d"))
    ).groupBy("split", "__day").agg(F.sum("__d").alias("__d"))
    wanted = near.select("anchor_date").distinct().join(F.broadcast(known.select("split").distinct()))
    timeline = steps.select("split", F.col("__day").alias("day"), "__d", F.lit(False).alias("__mark")).unionByName(
        wanted.select("split", F.col("anchor_date").alias("day"), F.lit(0).cast("long").alias("__d"), F.lit(True).alias("__mark"))
    )
    # one row per split and calendar day
    over = Window.partitionBy("split").orderBy("day", "__mark").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    eligible = timeline.withColumn("eligible_machines", F.sum("__d").over(over)).where("__mark").select(
        F.col("day").alias("anchor_date"), "split", "eligible_machines"
    )
    out = eligible.join(positives, ["anchor_date", "split"], "left").withColumn(
        "positive_machines", F.coalesce(F.col("positive_machines"), F.lit(0))
    )
    negative = F.col("eligible_machines") - F.col("positive_machines")
    return out.withColumns(
        {"negative_machines": negative, "capacity": F.least(F.col("positive_machines"), F.floor(negative / F.lit(ratio)))}
    )


def pick_anchor(feasibility: DataFrame, splits: Sequence[str], minimum: int, seed: int = 42, scope: str = "holdout") -> DataFrame:
    """The hash-first date with enough positives in every split, else the one with most."""
    per = feasibility.where(F.col("split").isin(*splits)).groupBy("anchor_date").agg(
        F.min("capacity").alias("common_capacity"), F.count(F.lit(1)).alias("__splits")
    ).withColumn("common_capacity", F.when(F.col("__splits") == len(splits), F.col("common_capacity")).otherwise(F.lit(0)))
    digest = stable_hash(seed, F.lit(f"{scope}|"), F.col("anchor_date"), F.lit("|as_of_anchor_date"))
    enough = F.col("common_capacity") >= minimum
    order = F.struct((~enough).alias("a"), F.when(enough, F.lit(0)).otherwise(-F.col("common_capacity")).alias("b"), digest.alias("c"))
    return per.agg(F.min_by(F.struct("anchor_date", "common_capacity"), order).alias("__p")).select("__p.*")


def fleet_at_anchors(
    master: DataFrame, claims: DataFrame, anchors: DataFrame, days: int, lead_min: int, inclusive: bool = True
) -> DataFrame:
    """All covered entities at each anchor with their next claim and label.

    ``anchors`` is a short table of (split, anchor_date); it travels as one array per split.
    """
    listed = anchors.groupBy("split").agg(F.collect_set("anchor_date").alias("__all"))
    rows = (
        master.join(F.broadcast(listed), "split").withColumn("anchor_date", F.explode("__all")).drop("__all")
        .where(covered(F.date_sub("anchor_date", days), F.col("anchor_date")))
    )
    found = asof_join(
        rows, claims.select(KEY, "claim_date").withColumn("__next", F.col("claim_date")), KEY, "anchor_date", "claim_date",
        ["__next"], direction="forward", inclusive=inclusive,
    )
    away = F.datediff("__next", "anchor_date")
    return found.withColumns(
        {
            "window_start": F.date_sub("anchor_date", days), "window_end": F.col("anchor_date"),
            "next_claim_date": F.col("__next"), "days_to_next_claim": away,
            "target": horizon_target(away, lead_min, inclusive),
        }
    ).drop("__next")


def anchor_ratio_pool(fleet: DataFrame, ratio: int, seed: int = 42, scope: str = "holdout") -> DataFrame:
    """Hash-ranked positives and negatives of a fleet, stored once, at the largest common ratio."""
    fleet = cut_lineage(fleet)
    kind = F.when(F.col("target") == 1, "as_of_positive").otherwise("as_of_negative")
    digest = stable_hash(
        seed, F.lit(f"{scope}|"), F.col("anchor_date"), F.lit("|"), F.col("split"), F.lit("|"), F.col(KEY), F.lit("|"), kind
    )
    ranked = ordered_scan(
        fleet.withColumn("__hash", digest), ["split", "target"], [F.col("__hash").asc(), F.col(KEY).asc()], number="__rank"
    )
    sizes = fleet.groupBy("split").agg(F.sum("target").alias("__p"), F.sum(1 - F.col("target")).alias("__n")).withColumn(
        "__take", F.least(F.col("__p"), F.floor(F.col("__n") / F.lit(ratio)))
    )
    return ranked.join(sizes, "split").where(
        F.col("__rank") <= F.when(F.col("target") == 1, F.col("__take")).otherwise(F.col("__take") * ratio)
    ).select(
        "split", KEY, "anchor_date", "window_start", "window_end", "target", "days_to_next_claim",
        F.when(F.col("target") == 1, F.col("__rank")).alias("positive_rank"),
        F.when(F.col("target") == 0, F.col("__rank")).alias("negative_rank"),
    )


def fleet_anchor_dates(
    feasibility: DataFrame, counts: Mapping[str, int], gap: int, min_eligible: int, min_positive: int,
    validation_share: float = 0.7, test_gap: int = 30,
) -> DataFrame:
    """split, anchor_date: spaced validation dates up to the border of the feasible days, later spaced test dates.

    The border is the feasible day at ``validation_share`` of all of them. Test dates lie behind it and ``test_gap``
    days behind the last validation date; where no such day exists, behind that date, or else anywhere. Each list
    holds feasible calendar days, so all of it is one row of short arrays. No feasible day gives no dates.
    """
    ok = (F.col("eligible_machines") >= min_eligible) & (F.col("positive_machines") >= min_positive) & (F.col("negative_machines") >= 1)
    listed = lambda *splits: F.array_sort(F.collect_set(F.when(F.col("split").isin(*splits), F.col("anchor_date"))))
    first_filled = lambda *lists: F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], lists[-1])
    c = F.col
    days = feasibility.where(ok).agg(listed("validation").alias("early"), listed("test").alias("late"), listed("validation", "test").alias("every"))
    days = days.where(F.size("every") > 0).withColumn("border", F.get("every", F.floor((F.size("every") - 1) * F.lit(validation_share)).cast("int")))
    chosen = days.withColumn(
        "validation", spaced_dates(first_filled(F.filter("early", lambda d: d <= c("border")), c("early")), counts["validation"], gap)
    ).withColumn("latest", F.coalesce(F.array_max("validation"), "border"))
    behind = F.filter("late", lambda d: (F.datediff(d, c("latest")) >= test_gap) & (d > c("border")))
    chosen = chosen.withColumn("test", spaced_dates(first_filled(behind, F.filter("late", lambda d: d > c("latest")), c("late")), counts["test"], gap))
    both = F.array(*[F.struct(F.lit(s).alias("split"), c(s).alias("days")) for s in ("validation", "test")])
    return chosen.select(F.explode(both).alias("x")).select("x.split", F.explode("x.days").alias("anchor_date"))


def capped_fleet(fleet: DataFrame, limit: int, seed: int = 42) -> DataFrame:
    """At most ``limit`` entities per anchor: all positives, then negatives in hash order.

    More positives than the limit are all kept.
    """
    digest = stable_hash(seed, F.col("anchor_date"), F.lit("|"), F.col(KEY), F.lit("|fleet_cap"))
    ranked = ordered_scan(
        fleet.withColumn("__hash", digest), ["split", "anchor_date"],
        [F.col("target").desc(), F.col("__hash").asc(), F.col(KEY).asc()], number="__rank",
    )
    return ranked.where((F.col("__rank") <= limit) | (F.col("target") == 1)).select(*fleet.columns)


# ------------------------------------------------------------------ negative-only cohorts
def lead_bins(lead_min: int, strict_days: int, width: int = 30) -> list[tuple[int, int]]:
    """(lower, upper] lead-time bins between the case lead and the strict limit."""
    edges = [*range(lead_min, strict_days, width), strict_days]
    return list(zip(edges, edges[1:]))


def negative_candidates(
    dates: DataFrame, master: DataFrame, claims: DataFrame, last_observed: DataFrame, days: int,
    lead_min: int, strict_days: int = FUTURE_FREE_DAYS, width: int = 30, seed: int = 42,
    prior: int = PRIOR_FREE_DAYS,
) -> DataFrame:
    """Strict and delayed negative windows: one per entity, type and lead bin.

    Both have source coverage and no claim from ``prior`` days before the window to
    ``lead_min`` days after it. Delayed windows see their next claim within
    ``strict_days``, strict ones do not and have that span fully observed.
    """
    rows = (
        dates.join(master.select(KEY, "split", "first_source_date", "last_source_date"), KEY)
        .withColumn("window_start", F.date_sub("window_end", days))
        .where(covered(F.col("window_start"), F.col("window_end")))
        .withColumns({"__lo": F.date_sub("window_start", prior), "__hi": F.date_add("window_end", lead_min)})
    )
    clear = anti_range(rows, claims, KEY, "__lo", "__hi", "claim_date")
    found = asof_join(
        clear, claims.select(KEY, "claim_date").withColumn("__next", F.col("claim_date")), KEY, "window_end", "claim_date",
        ["__next"], direction="forward",
    ).join(F.broadcast(last_observed.select("label_end").limit(1)))
    away = F.datediff("__next", "window_end")
    label = F.lit(None).cast("string")
    for lower, upper in lead_bins(lead_min, strict_days, width):
        label = F.when((away > lower) & (away <= upper), F.lit(f"{lower + 1}-{upper}d")).otherwise(label)
    strict = (F.date_add("window_end", strict_days) <= F.col("label_end")) & (F.col("__next").isNull() | (away > strict_days))
    kinds = F.array(
        F.when(label.isNotNull(), F.struct(F.lit("delayed_claim_negative").alias("t"), label.alias("b"))),
        F.when(strict, F.struct(F.lit("strict_negative").alias("t"), F.lit("no_claim_within_strict_window").alias("b"))),
    )
    typed = found.withColumn("__kind", F.explode(F.filter(kinds, lambda x: x.isNotNull()))).select(
        KEY, "split", "window_start", "window_end", F.col("__next").alias("future_claim_date"), away.alias("days_to_claim"),
        F.col("__kind.t").alias("negative_case_type"), F.col("__kind.b").alias("lead_bin"),
    )
    digest = stable_hash(
        seed, F.lit(f"{seed}|"), F.col(KEY), F.lit("|"), F.col("negative_case_type"), F.lit("|"), F.col("lead_bin"), F.lit("|"), F.col("window_end")
    )
    return first_per_group(
        typed.withColumn("__hash", digest), ["split", "negative_case_type", "lead_bin", KEY], [F.col("__hash").asc()]
    ).drop("__hash")


def balanced_negatives(candidates: DataFrame, requested: int, seed: int = 42) -> DataFrame:
    """``requested`` delayed negatives per split: equal bin quotas in turn, then a fill; then
    as many strict ones; an entity is used once.

    Each step is an anti join on the entities used so far and a hash-ordered limit. The
    candidates are read in every step and stored once.
    """
    candidates = cut_lineage(candidates)
    delayed = candidates.where("negative_case_type = 'delayed_claim_negative'")
    bins = sorted(r[0] for r in delayed.select("lead_bin").distinct().collect())
    used, chosen = None, None

    def take(pool: DataFrame, quota: Column | int, tag: str) -> DataFrame:
        nonlocal used, chosen
        if used is not None:
            pool = pool.join(used, ["split", KEY], "left_anti")
        digest = stable_hash(seed, F.lit(f"{seed}|{tag}|"), F.col(KEY), F.lit("|"), F.col("window_end"))
        pool = first_per_group(pool.withColumn("__hash", digest), ["split", KEY], [F.col("__hash").asc(), F.col("lead_bin").asc()])
        ranked = ordered_scan(pool, ["split"], [F.col("__hash").asc(), F.col(KEY).asc()], number="__rank")
        got = ranked.where(F.col("__rank") <= quota) if isinstance(quota, int) else ranked.join(quota, "split").where("__rank <= __quota").drop("__quota")
        got = cut_lineage(got.select(*candidates.columns))
        chosen = got if chosen is None else chosen.unionByName(got)
        used = cut_lineage(chosen.select("split", KEY))
        return got

    for i, name in enumerate(bins):
        quota = requested // len(bins) + (1 if i < requested % len(bins) else 0)
        take(delayed.where(F.col("lead_bin") == name), quota, f"delayed|{name}")
    if chosen is not None:
        have = chosen.groupBy("split").agg(F.count(F.lit(1)).alias("__n"))
        missing = candidates.select("split").distinct().join(have, "split", "left").select(
            "split", (F.lit(requested) - F.coalesce("__n", F.lit(0))).alias("__quota")
        )
        take(delayed, missing, "delayed_fill")
    take(candidates.where("negative_case_type = 'strict_negative'"), requested, "strict")
    return chosen
