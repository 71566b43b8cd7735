"""Entity keys, stable hashes and column-name helpers."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that stand for a missing value (compared lower case, trimmed).
NULL_LIKE = (
    "", "nan", "none", "null", "n/a", "na", "#n/a", "#na",
    "not available", "unknown", "undefined", "<na>",
)

# Columns that may carry the model and the serial, first match wins.
MODEL_COLUMNS = ("full_model", "FULL_MODEL", "MODEL", "model", "ZZMATNR")
SERIAL_COLUMNS = ("serial_number", "SERIAL", "Serial", "serial", "ZZSERNR")


def null_like_to_null(value: Column) -> Column:
    """Trimmed text, or NULL where the text only stands for a missing value."""
    text = F.trim(value.cast("string"))
    return F.when(F.lower(text).isin(*NULL_LIKE), None).otherwise(text)


def dash_key(model: Column, serial: Column) -> Column:
    """``MODEL-123``: upper-case model and the first run of digits of the serial."""
    digits = F.regexp_extract(serial.cast("string"), r"(\d+)", 1)
    return F.concat(
        F.upper(F.trim(model.cast("string"))),
        F.lit("-"),
        F.when(digits != "", digits),
    )


def dash_key_from_text(value: Column) -> Column:
    """Upper-case key whose trailing blank-separated number is joined by a dash."""
    return F.regexp_replace(F.upper(F.trim(value.cast("string"))), r"\s+(\d+)$", "-$1")


def clean_model(model: Column) -> Column:
    """Upper-case model with inner blanks turned into dashes; '' when missing."""
    return F.coalesce(
        F.regexp_replace(F.upper(F.trim(model.cast("string"))), r"\s+", "-"), F.lit("")
    )


def clean_serial(serial: Column) -> Column:
    """Serial text without a float tail and without blanks; '' when missing."""
    text = F.regexp_replace(F.trim(serial.cast("string")), r"\.0$", "")
    return F.coalesce(F.regexp_replace(text, r"\s+", ""), F.lit(""))


def model_serial_key(
    model: Column, serial: Column, combined: Column | None = None
) -> tuple[Column, Column, Column]:
    """Model, serial and ``MODEL-SERIAL`` key, read from ``combined`` where a part is blank."""
    model_part, serial_part = clean_model(model), clean_serial(serial)
    if combined is not None:
        text = F.regexp_replace(
            F.translate(F.upper(F.trim(combined.cast("string"))), "_", " "), r"\s+", " "
        )
        pattern = r"^(.+?)[\s-]+(\d{4,})$"
        blank = (model_part == "") | (serial_part == "")
        parsed_model = F.coalesce(clean_model(F.regexp_extract(text, pattern, 1)), F.lit(""))
        parsed_serial = F.coalesce(F.regexp_extract(text, pattern, 2), F.lit(""))
        model_part, serial_part = (
            F.when(blank, parsed_model).otherwise(model_part),
            F.when(blank, parsed_serial).otherwise(serial_part),
        )
    key = F.when(
        (model_part != "") & (serial_part != ""), F.concat(model_part, F.lit("-"), serial_part)
    ).otherwise(F.lit(""))
    return model_part, serial_part, key


def pipe_key(model: Column, serial: Column) -> Column:
    """``MODEL|SERIAL``; NULL when either part is blank."""
    left = F.upper(F.trim(model.cast("string")))
    right = F.upper(F.regexp_replace(F.trim(serial.cast("string")), r"\.0$", ""))
    return F.when((left != "") & (right != ""), F.concat(left, F.lit("|"), right))


def first_existing(df: DataFrame, names: Sequence[str], default: object = None) -> Column:
    """First of ``names`` that ``df`` has, else the default as a literal."""
    for name in names:
        if name in df.columns:
            return F.col(f"`{name}`")
    return default if isinstance(default, Column) else F.lit(default)


def reconcile_key(
    df: DataFrame, roster: DataFrame, key: str, fallback: Column, roster_key: str | None = None
) -> DataFrame:
    """Keep ``key`` where the roster knows it, else use a known ``fallback``.

    Adds ``key_reconciled`` (1 where the fallback replaced the key). The roster is probed with
    the distinct (key, fallback) pairs, about one row per entity, so the wide rows take part
    in a single join with that short mapping.
    """
    name = roster_key or key
    known = roster.select(F.col(name).alias("__known")).where("__known is not null").distinct()
    marked = df.withColumns(
        {"__key": null_like_to_null(F.col(key)), "__fallback": null_like_to_null(fallback)}
    )
    pairs = marked.select(F.col("__key").alias("__k"), F.col("__fallback").alias("__f")).distinct()
    probed = pairs.join(known.select(F.col("__known").alias("__a")), F.col("__k") == F.col("__a"), "left").join(
        known.select(F.col("__known").alias("__b")), F.col("__f") == F.col("__b"), "left"
    )
    use = F.col("__a").isNull() & F.col("__b").isNotNull()
    mapping = probed.select(
        "__k", "__f", use.cast("int").alias("key_reconciled"),
        F.when(use, F.col("__f")).otherwise(F.col("__k")).alias("__resolved"),
    )
    return (
        marked.join(mapping, F.col("__key").eqNullSafe(F.col("__k")) & F.col("__fallback").eqNullSafe(F.col("__f")))
        .withColumn(key, F.col("__resolved"))
        .drop("__key", "__fallback", "__k", "__f", "__resolved")
    )


def sql_text(value: str) -> str:
    """A value as a string literal of a SQL expression, whatever quotes it holds."""
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def stable_hash(seed: int | Column, *parts: Column) -> Column:
    """First 16 hex digits of ``md5(seed|parts)``; text order equals number order."""
    lead = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.substring(
        F.md5(F.concat(lead, F.lit("|"), *[p.cast("string") for p in parts])), 1, 16
    )


def hash_choice(hex_digest: Column, count: Column) -> Column:
    """Number in ``[0, count)`` chosen by a 16-digit hex hash."""
    number = F.conv(hex_digest, 16, 10).cast("decimal(20,0)")
    return (number % count.cast("decimal(20,0)")).cast("long")


def family_filter(families: Iterable[str], *texts: Column) -> Column:
    """True where any text holds one of the families at the start of a word."""
    names = [re.escape(f.upper()) for f in families]
    if not names:
        return F.lit(True)
    pattern = r"\b(?:" + "|".join(names) + ")"
    hit = F.lit(False)
    for text in texts:
        hit = hit | F.coalesce(F.upper(text.cast("string")).rlike(pattern), F.lit(False))
    return hit


def safe_token(value: object) -> str:
    """Letters, digits and single underscores only."""
    return re.sub(r"[^A-Za-z0-9]+", "_", str(value)).strip("_")


def unique_token(name: object, taken: set[str]) -> str:
    """A safe column token that is not in ``taken`` yet; adds it there."""
    base = re.sub(r"[^0-9A-Za-z_]+", "_", str(name)).strip("_") or "feature"
    base = f"f_{base}" if base[0].isdigit() else base
    token, turn = base, 1
    while token in taken:
        turn += 1
        token = f"{base}_{turn}"
    taken.add(token)
    return token
