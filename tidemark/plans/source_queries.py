"""Scans, cleaning, refresh, keys and scalar functions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions import keys as k
from tidemark.functions import scalars as s
from tidemark.functions.stats import wilson_high, wilson_low
from tidemark.plans import roles
from tidemark.plans.registry import query, round_sql, rounded
from tidemark.session import ensure_checkpoint_dir
from tidemark.sources import cleaning, readers, refresh
from tidemark.sources import standardize as std

# raw text with null-like spellings, an empty column and rows without any value
_DIRTY = {
    "doc": "case when doc_id % 10 = 0 then null else cast(doc_id as string) end",
    "lang": "case when doc_id % 10 = 0 then 'NaN ' when doc_id % 4 = 1 then ' N/A' when doc_id % 4 = 2 then lang || '  ' else lang end",
    "origin": "case when doc_id % 10 = 0 then 'unknown' when doc_id % 6 = 0 then '' else source end",
    "nothing": "case when doc_id % 2 = 0 then 'none' else '' end",
    "size": "case when doc_id % 10 = 0 then null else n_chars end",
}
_DIRTY_SQL = f"SELECT {', '.join(f'{e} AS {n}' for n, e in _DIRTY.items())} FROM documents"
_NULLS = ", ".join(f"'{v}'" for v in k.NULL_LIKE)


def _dirty(t):
    return t("documents").selectExpr(*[f"{e} as {n}" for n, e in _DIRTY.items()])


def _clean_sql(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN ({_NULLS}) THEN NULL ELSE trim({c}) END"


_CLEANED_SQL = f"""SELECT {', '.join(f'{_clean_sql(c)} AS {c}' for c in ('doc', 'lang', 'origin'))}, size FROM ({_DIRTY_SQL}) AS d"""


@query("light_cleaning", "A7 B7", f"SELECT * FROM ({_CLEANED_SQL}) AS c WHERE doc IS NOT NULL OR lang IS NOT NULL OR origin IS NOT NULL OR size IS NOT NULL")
def _(t):
    return cleaning.clean(_dirty(t))


@query(
    "cleaning_summary", "A10",
    f"""WITH d AS ({_DIRTY_SQL}), c AS ({_CLEANED_SQL}), kept AS (SELECT * FROM c WHERE NOT (doc IS NULL AND lang IS NULL AND origin IS NULL AND size IS NULL))
SELECT 'documents' AS dataset, (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM kept) AS rows_after,
 (SELECT count(*) FROM d) - (SELECT count(*) FROM kept) AS rows_dropped, 5 AS columns_before, 4 AS columns_after, 1 AS columns_dropped,
 (SELECT 5 * count(*) - count(doc) - count(lang) - count(origin) - count(nothing) - count(size) FROM d) AS missing_cells_raw,
 (SELECT 4 * count(*) - count(doc) - count(lang) - count(origin) - count(size) FROM kept) AS missing_cells_cleaned""",
)
def _(t):
    return cleaning.cleaning_summary(_dirty(t), "documents")


def _profile_sql() -> str:
    kinds = {"doc": "string", "lang": "string", "origin": "string", "nothing": "string", "size": "bigint"}
    parts = [
        f"""SELECT '{c}' AS "column", '{kind}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS missing_count,
 {f"count(*) FILTER (WHERE lower(trim({c})) IN ({_NULLS}))" if kind == 'string' else '0'} AS blank_or_null_string_count, count({c}) AS non_missing_count,
 count(DISTINCT {c}) AS unique_non_missing_count, min(CAST({c} AS VARCHAR)) AS smallest_value, max(CAST({c} AS VARCHAR)) AS largest_value,
 coalesce((SELECT string_agg(v, ' | ' ORDER BY v) FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS v FROM d WHERE {c} IS NOT NULL ORDER BY v LIMIT 3) AS e), '') AS example_values FROM d"""
        for c, kind in kinds.items()
    ]
    return f"""WITH d AS ({_DIRTY_SQL}) SELECT *, 'documents' AS dataset, 'raw' AS stage, round(missing_count / row_count * 100, 4) AS missing_pct
FROM ({' UNION ALL '.join(parts)}) AS u"""


@query("column_profile", "A9", _profile_sql())
def _(t):
    return cleaning.profile(_dirty(t), "documents", "raw")


@query("pruned_scan", "A1 A5", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(t):
    wanted = ["o_orderkey", "o_custkey", "o_totalprice", "o_not_there"]
    return readers.require_columns(t("orders"), wanted[:2], wanted[2:], "orders")


@query(
    "dated_scan", "A3 A6",
    """SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders
WHERE o_orderdate >= TIMESTAMP '1999-01-01' AND o_orderdate < TIMESTAMP '2000-07-01'""",
)
def _(t):
    orders = readers.select_existing(t("orders"), ["o_orderkey", "o_custkey", "o_orderdate"])
    return readers.parsed_day(readers.dated_scan(orders, "o_orderdate", "1999-01-01", "2000-07-01"), "o_orderdate")


@query(
    "distinct_roster_scan", "A11",
    f"SELECT DISTINCT machine_id FROM ({roles.RAW_OPERATION_SQL}) AS r WHERE LOCAL_DATE IS NOT NULL",
)
def _(t):
    rows = readers.drop_blank_dates(roles.raw_operation(t).select("machine_id", "LOCAL_DATE"), "LOCAL_DATE")
    return rows.select("machine_id").distinct()


_SCORE = "2001-01-01"
_HIST = "o_orderdate < TIMESTAMP '2000-10-01'"
_INC = "o_orderdate >= TIMESTAMP '2000-08-01' AND o_orderdate < TIMESTAMP '2001-01-01'"
_MERGE_SOURCE = """SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey % 400 END AS cust, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price, o_orderdate FROM orders"""


@query(
    "incremental_merge", "A12 J5",
    f"""WITH src AS ({_MERGE_SOURCE}), h AS (SELECT cust, day, price FROM src WHERE {_HIST}), i AS (SELECT cust, day, price FROM src WHERE {_INC})
SELECT * FROM h UNION ALL SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.cust IS NOT DISTINCT FROM i.cust AND h.day = i.day)""",
)
def _(t):
    src = t("orders").selectExpr(
        "case when o_orderkey % 50 = 0 then null else o_custkey % 400 end as cust",
        "cast(o_orderdate as date) as day", "o_totalprice as price",
    )
    history = src.where("day < date'2000-10-01'")
    incoming = src.where("day >= date'2000-08-01' and day < date'2001-01-01'")
    return refresh.merge_refresh(history, incoming, ["cust", "day"])


@query(
    "replay_manifest", "A4 A13",
    f"""SELECT 'orders' AS source, count(*) AS rows, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
FROM orders WHERE o_orderdate >= TIMESTAMP '{_SCORE}' - INTERVAL 90 DAY AND o_orderdate < TIMESTAMP '{_SCORE}'
UNION ALL SELECT 'lineitem', count(*), min(CAST(l_shipdate AS DATE)), max(CAST(l_shipdate AS DATE)) FROM lineitem
WHERE l_shipdate >= TIMESTAMP '{_SCORE}' - INTERVAL 1096 DAY AND l_shipdate < TIMESTAMP '{_SCORE}'""",
)
def _(t):
    orders = refresh.replay_window(t("orders").select("o_orderdate"), "o_orderdate", _SCORE, refresh.HISTORY_DAYS["fault"])
    lines = refresh.retained_history(t("lineitem").select("l_shipdate"), "l_shipdate", _SCORE, refresh.HISTORY_DAYS["maintenance"])
    return refresh.replay_manifest({"orders": (orders, "o_orderdate"), "lineitem": (lines, "l_shipdate")})


@query(
    "refresh_gate", "A14",
    f"""WITH op AS (SELECT machine_id, LOCAL_DATE FROM ({roles.RAW_OPERATION_SQL}) AS r), c AS (SELECT DISTINCT machine_id FROM ({roles.RAW_CLAIM_SQL}) AS r)
SELECT min(LOCAL_DATE) AS first_day, max(LOCAL_DATE) AS last_day,
 (SELECT count(*) FROM c WHERE machine_id NOT IN (SELECT machine_id FROM op)) AS entities_missing_in_operation,
 CAST(min(LOCAL_DATE) <= DATE '{_SCORE}' - 90 AS INT) AS history_long_enough, CAST(max(LOCAL_DATE) >= DATE '{_SCORE}' - 1 AS INT) AS history_fresh_enough,
 CAST((SELECT count(*) FROM c WHERE machine_id NOT IN (SELECT machine_id FROM op)) = 0 AS INT) AS entities_complete FROM op""",
)
def _(t):
    op = roles.raw_operation(t).select("machine_id", "LOCAL_DATE")
    return refresh.refresh_gate(op, [roles.raw_claim(t)], "machine_id", "LOCAL_DATE", _SCORE)


@query(
    "source_profile", "A15",
    f"""WITH c AS (SELECT machine_id, local_date AS d FROM ({roles.RAW_CLAIM_SQL}) AS r), o AS (SELECT machine_id, LOCAL_DATE AS d FROM ({roles.RAW_OPERATION_SQL}) AS r)
SELECT 'operation' AS source, count(*) AS rows, count(DISTINCT machine_id) AS entities, min(d) AS first_day, max(d) AS last_day,
 count(DISTINCT machine_id) FILTER (WHERE machine_id IN (SELECT machine_id FROM c)) AS entities_shared_with_target FROM o
UNION ALL SELECT 'claims', count(*), count(DISTINCT machine_id), min(d), max(d), count(DISTINCT machine_id) FROM c""",
)
def _(t):
    claims = roles.raw_claim(t)
    return refresh.source_profile(
        {"operation": (roles.raw_operation(t), "LOCAL_DATE"), "claims": (claims, "local_date")}, "machine_id", "claims"
    )


@query("score_date", "A17", "SELECT CAST(max(l_shipdate) AS DATE) AS score_date FROM lineitem")
def _(t):
    return refresh.score_date(t("lineitem"), "l_shipdate")


# ------------------------------------------------------------------ keys
_KEY_SOURCE = """SELECT c_custkey, ' ' || lower(c_mktsegment) || CASE WHEN c_custkey % 3 = 0 THEN ' x' ELSE '' END AS model,
 CASE c_custkey % 4 WHEN 0 THEN cast(c_custkey as string) || '.0' WHEN 1 THEN 'S ' || cast(c_custkey as string) WHEN 2 THEN '' ELSE cast(c_custkey as string) END AS serial,
 lower(c_mktsegment) || CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '_' END || cast(10000 + c_custkey as string) AS combined FROM customer"""


def _key_rows(t):
    return t("customer").selectExpr(
        "c_custkey", "concat(' ', lower(c_mktsegment), case when c_custkey % 3 = 0 then ' x' else '' end) as model",
        "case c_custkey % 4 when 0 then concat(c_custkey, '.0') when 1 then concat('S ', c_custkey) when 2 then '' else cast(c_custkey as string) end as serial",
        "concat(lower(c_mktsegment), case when c_custkey % 2 = 0 then ' ' else '_' end, cast(10000 + c_custkey as string)) as combined",
    )


_MODEL_SQL = r"regexp_replace(upper(trim(model)), '\s+', '-', 'g')"
_SERIAL_SQL = r"regexp_replace(regexp_replace(trim(serial), '\.0$', ''), '\s+', '', 'g')"


@query(
    "entity_keys", "B1 B2 B3 B4",
    rf"""SELECT c_custkey, upper(trim(model)) || '-' || nullif(regexp_extract(serial, '(\d+)', 1), '') AS dash_key,
 regexp_replace(upper(trim(combined)), '\s+(\d+)$', '-\1') AS text_key,
 CASE WHEN {_SERIAL_SQL} = '' THEN upper(split_part(replace(combined, '_', ' '), ' ', 1)) || '-' || cast(10000 + c_custkey as string)
      ELSE {_MODEL_SQL} || '-' || {_SERIAL_SQL} END AS full_key,
 CASE WHEN upper(trim(model)) <> '' AND regexp_replace(trim(serial), '\.0$', '') <> '' THEN upper(trim(model)) || '|' || upper(regexp_replace(trim(serial), '\.0$', '')) END AS pipe_key
FROM ({_KEY_SOURCE}) AS src""",
)
def _(t):
    rows = _key_rows(t)
    model, serial, combined = F.col("model"), F.col("serial"), F.col("combined")
    return rows.select(
        "c_custkey", k.dash_key(model, serial).alias("dash_key"), k.dash_key_from_text(combined).alias("text_key"),
        k.model_serial_key(model, serial, combined)[2].alias("full_key"), k.pipe_key(model, serial).alias("pipe_key"),
    )


@query(
    "reconciled_keys", "B5 J5",
    f"""WITH raw AS ({roles.RAW_FAULT_SQL}), spine AS (SELECT DISTINCT model_id FROM ({roles.EVENT_SPINE_SQL}) AS s WHERE model_id NOT LIKE '%3')
SELECT CASE WHEN machine_id IN (SELECT model_id FROM spine) THEN machine_id
  WHEN full_model || ' ' || serial_number IN (SELECT model_id FROM spine) THEN full_model || ' ' || serial_number ELSE machine_id END AS machine_id,
 CAST(machine_id NOT IN (SELECT model_id FROM spine) AND full_model || ' ' || serial_number IN (SELECT model_id FROM spine) AS INT) AS key_reconciled, event_time FROM raw""",
)
def _(t):
    spine = roles.event_spine(t).where("model_id not like '%3'")
    raw = roles.raw_fault(t).select("machine_id", "full_model", "serial_number", "event_time")
    out = k.reconcile_key(raw, spine, "machine_id", F.concat_ws(" ", "full_model", "serial_number"), "model_id")
    return out.select("machine_id", "key_reconciled", "event_time")


@query(
    "stable_hashes", "B18",
    """SELECT c_custkey, substr(md5('42|' || cast(c_custkey as varchar)), 1, 16) AS digest,
 CAST(('0x' || substr(md5('42|' || cast(c_custkey as varchar)), 1, 16))::UBIGINT % 7 AS BIGINT) AS choice FROM customer""",
)
def _(t):
    digest = k.stable_hash(42, F.col("c_custkey"))
    return t("customer").select("c_custkey", digest.alias("digest"), k.hash_choice(digest, F.lit(7)).alias("choice"))


@query(
    "family_filter", "B17",
    r"SELECT p_partkey, p_type FROM part WHERE regexp_matches(upper(p_type), '\b(?:PRO|STE)') OR regexp_matches(upper(p_name), '\b(?:PRO|STE)')",
)
def _(t):
    return t("part").where(k.family_filter(["pro", "ste"], F.col("p_type"), F.col("p_name"))).select("p_partkey", "p_type")


# ------------------------------------------------------------------ scalar functions
_WORDS = "case event_id % 8 when 0 then ' TRUE' when 1 then 'y' when 2 then '0' when 3 then 'No' when 4 then '2.5' when 5 then 'maybe' when 6 then null else '1' end"


@query(
    "mixed_flags", "B8",
    f"""WITH e AS (SELECT event_id, {_WORDS} AS w, lower(trim({_WORDS})) AS x FROM events)
SELECT event_id, coalesce(CASE WHEN x IN ('true','1','yes','y','t') THEN TRUE WHEN x IN ('false','0','no','n','f') THEN FALSE END, FALSE) AS as_boolean,
 coalesce(x IN ('true', '1'), FALSE) AS as_strict, CASE WHEN x IN ('true','1','yes','y','t') THEN 1.0 WHEN x IN ('false','0','no','n','f') THEN 0.0 ELSE coalesce(TRY_CAST(x AS DOUBLE), 0.0) END AS as_flag FROM e""",
)
def _(t):
    w = F.expr(_WORDS)
    return t("events").select(
        "event_id", s.mixed_boolean(w).alias("as_boolean"), s.strict_boolean(w).alias("as_strict"), s.flag(w).alias("as_flag")
    )


@query(
    "safe_times", "B9 B14",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR ELSE date_trunc('second', ts) END AS at,
 CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(epoch(TIMESTAMP '2024-02-01' - CASE WHEN event_id % 5 = 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR ELSE date_trunc('second', ts) END) / 86400) AS INT) END AS age FROM events""",
)
def _(t):
    text = F.expr(
        "case event_id % 5 when 0 then 'not a date' when 1 then concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '+03:00') else date_format(ts, 'yyyy-MM-dd HH:mm:ss') end"
    )
    at = s.timestamp(text)
    return t("events").select(
        "event_id", at.alias("at"), s.floor_days(F.lit("2024-02-01").cast("timestamp_ntz"), at).alias("age")
    )


@query(
    "level_and_occurrence", "B10 B11 D1",
    round_sql(
        f"""SELECT event_time, machine_id, fault_code, coalesce(CAST(action_level_num AS DOUBLE), CAST(nullif(regexp_extract(event_action_level, '([0-9]+)', 1), '') AS DOUBLE)) AS level,
 least(greatest(coalesce(log_occurrence_count, ln(1 + coalesce(occurrence_count, 1))), 0), 10) AS log_occ, CASE WHEN failure_code_evidence_score IS NOT NULL THEN least(greatest(failure_code_evidence_score, 0), 2) END AS evidence
FROM ({roles.RAW_FAULT_SQL}) AS r""", ["event_time", "machine_id", "fault_code"], ["level", "log_occ", "evidence"]),
)
def _(t):
    c = F.col
    return rounded(roles.raw_fault(t).select(
        "event_time", "machine_id", "fault_code", s.level_number(c("event_action_level"), c("action_level_num")).alias("level"),
        s.clip(s.log_occurrence(c("log_occurrence_count"), c("occurrence_count")), 0.0, 10.0).alias("log_occ"),
        s.clip(s.number(c("failure_code_evidence_score")), 0.0, 2.0).alias("evidence"),
    ))


def _any_sql(words) -> str:
    return "CAST(" + " OR ".join(f"contains(lower(coalesce(applicable_component, '')), '{w}')" for w in words) + " AS INT)"


@query(
    "component_flags", "B12",
    f"SELECT event_time, machine_id, {', '.join(f'{_any_sql(w)} AS is_{n}' for n, w in s.COMPONENT_WORDS.items())} FROM ({roles.RAW_FAULT_SQL}) AS r",
)
def _(t):
    return roles.raw_fault(t).select(
        "event_time", "machine_id",
        *[s.contains_any(F.col("applicable_component"), w).cast("int").alias(f"is_{n}") for n, w in s.COMPONENT_WORDS.items()],
    )


@query(
    "safe_ratios", "B13",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(coalesce(l_quantity / nullif(CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE l_discount END, 0), 0), 6) AS zero_ratio,
 round(l_quantity / nullif(l_tax, 0), 6) AS null_ratio FROM lineitem""",
)
def _(t):
    den = F.expr("case when l_partkey % 3 = 0 then null else l_discount end")
    return rounded(t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", s.ratio(F.col("l_quantity"), den).alias("zero_ratio"),
        s.ratio_or_null(F.col("l_quantity"), F.col("l_tax")).alias("null_ratio"),
    ), 6)


@query(
    "category_indicators", "B15",
    """SELECT o_orderkey, CAST(o_orderpriority = '1-URGENT' AS INT) AS prio_1_urgent_count, CAST(o_orderpriority = '5-LOW' AS INT) AS prio_5_low_count,
 CAST(o_orderpriority = 'NONE' AS INT) AS prio_none_count FROM orders""",
)
def _(t):
    return t("orders").select(
        "o_orderkey", *s.category_indicators(F.lower("o_orderpriority"), "prio", ["1-URGENT", "5-LOW", "none"])
    )


@query(
    "calendar_labels", "B16 B20",
    """SELECT o_orderkey, 'Q' || quarter(o_orderdate) AS season, make_date(year(o_orderdate), CAST(floor((month(o_orderdate) - 1) / 4.0) AS BIGINT) * 4 + 1, 1) AS block,
 CASE WHEN d IS NULL THEN 'no_future_claim_observed' WHEN d <= 0 THEN '0d' WHEN d <= 30 THEN '1-30d' WHEN d <= 60 THEN '31-60d' WHEN d <= 90 THEN '61-90d'
  WHEN d <= 120 THEN '91-120d' WHEN d <= 180 THEN '121-180d' WHEN d <= 365 THEN '181-365d' ELSE '365d+' END AS bucket
FROM (SELECT *, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 500 END AS d FROM orders) AS o""",
)
def _(t):
    days = F.expr("case when o_orderkey % 9 = 0 then null else o_orderkey % 500 end")
    return t("orders").select(
        "o_orderkey", s.season_label(F.col("o_orderdate")).alias("season"),
        s.four_month_start(F.col("o_orderdate")).alias("block"), s.lead_time_bucket(days).alias("bucket"),
    )


@query(
    "wilson_intervals", "M7",
    round_sql("""WITH g AS (SELECT source, count(*) AS n, sum(quality) AS p FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT source, n, p, greatest(0, ((p / n + 1.959963984540054 ** 2 / (2.0 * n)) - 1.959963984540054 * sqrt(p / n * (1 - p / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ** 2 / n)) AS low,
 least(1, ((p / n + 1.959963984540054 ** 2 / (2.0 * n)) + 1.959963984540054 * sqrt(p / n * (1 - p / n) / n + 1.959963984540054 ** 2 / (4.0 * n * n))) / (1 + 1.959963984540054 ** 2 / n)) AS high FROM g""",
        ["source", "n", "CAST(p AS BIGINT) AS p"], ["low", "high"]),
)
def _(t):
    rows = t("documents").join(t("labels"), "doc_id").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quality").alias("p")
    )
    return rounded(rows.select("source", "n", "p", wilson_low(F.col("p"), F.col("n")).alias("low"), wilson_high(F.col("p"), F.col("n")).alias("high")))


@query(
    "fault_standardization_audit", "D7 C11",
    f"""WITH raw AS (SELECT CASE WHEN serial_number IN ('70001', '70008') THEN 'unknown' ELSE full_model || ' ' || serial_number END AS key, machine_id, * FROM ({roles.RAW_FAULT_SQL}) AS r),
spine AS (SELECT DISTINCT model_id FROM ({roles.EVENT_SPINE_SQL}) AS s WHERE model_id NOT LIKE '%3')
SELECT 'fault' AS source, count(*) AS input_rows,
 count(*) FILTER (WHERE contains(machine_id, '-7') AND full_model || ' ' || serial_number IN (SELECT model_id FROM spine)) AS reconciled_rows,
 0 AS missing_key_rows, 0 AS missing_day_rows, count(*) FILTER (WHERE full_model || ' ' || serial_number NOT IN (SELECT model_id FROM spine)) AS not_in_roster_rows,
 count(*) FILTER (WHERE full_model || ' ' || serial_number IN (SELECT model_id FROM spine)) AS kept_rows,
 count(DISTINCT full_model || ' ' || serial_number) FILTER (WHERE full_model || ' ' || serial_number IN (SELECT model_id FROM spine)) AS kept_entities FROM raw""",
)
def _(t):
    spine = roles.event_spine(t).where("model_id not like '%3'")
    return std.standardization_audit(std.standard_faults(roles.raw_fault(t), spine), spine, "fault")


@query(
    "dated_rows", "D8",
    f"SELECT machine_id, local_date, claim_number FROM ({roles.RAW_CLAIM_SQL}) AS r WHERE local_date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' AND machine_id <> ''",
)
def _(t):
    return std.dated_rows(roles.raw_claim(t), "machine_id", "local_date", "1997-01-01", "1997-12-31").select("machine_id", "local_date", "claim_number")


@query("first_existing_table", "A2", "SELECT o_orderkey, o_custkey FROM orders")
def _(t):
    # the first alias that the folder has
    path = readers.first_existing_path(t.spark, t.folder, ["orders_current.parquet", "orders.parquet", "lineitem.parquet"])
    return readers.read_any(t.spark, path).select("o_orderkey", "o_custkey")


@query("unique_names", "A8", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS name_duplicate_2, n_nationkey + 1 AS unnamed_column FROM nation")
def _(t):
    raw = t("nation").selectExpr("n_nationkey", "n_name", "n_regionkey", "n_nationkey + 1").toDF("key ", " name", "name", " ")
    return raw.toDF(*cleaning.unique_column_names(raw.columns))


@query("alias_columns", "B6", "SELECT o_orderkey, o_totalprice AS amount, o_orderpriority AS kind, CAST(NULL AS VARCHAR) AS part FROM orders")
def _(t):
    orders = t("orders")
    pick = lambda *names: k.first_existing(orders, names)
    return orders.select(
        "o_orderkey", pick("claim_amount", "o_totalprice", "o_shippriority").alias("amount"), pick("o_orderpriority", "o_orderstatus").alias("kind"),
        pick("part_number", "part").cast("string").alias("part"),
    )


_STATUSES = ("O", "F", "P", "f / p", "1 st", "1-st")


def _token_sql() -> str:
    taken: set[str] = set()
    return ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{v}') AS {k.unique_token(v, taken)}" for v in _STATUSES)


@query("token_columns", "B19", f"SELECT o_orderpriority, {_token_sql()} FROM orders GROUP BY 1")
def _(t):
    taken: set[str] = set()
    counted = [F.count(F.when(F.col("o_orderstatus") == v, 1)).alias(k.unique_token(v, taken)) for v in _STATUSES]
    return t("orders").groupBy("o_orderpriority").agg(*counted)


@query("written_splits", "A16", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 = 0 THEN 'test' ELSE 'train' END AS split FROM orders")
def _(t):
    rows = t("orders").selectExpr("o_orderkey", "cast(o_orderdate as date) as day", "case when o_orderkey % 4 = 0 then 'test' else 'train' end as split")
    path = f"{ensure_checkpoint_dir(t.spark).rstrip('/')}/written-splits-{uuid.uuid4().hex}"
    readers.write_table(rows, path, "csv.gz", by=["split"])
    return t.spark.read.option("header", True).schema("o_orderkey bigint, day date, split string").csv(path)
