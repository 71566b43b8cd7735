"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Pieces (documents, cut at the largest length) are placed
longest first: into the open bin with the least room that still holds the piece, else into a new bin of
the length whose cost a token is least if the pieces still to come fill it. At the end every bin is
downsized to the cheapest permitted length that holds its contents.

Pieces are dealt to shards of about ``shard_pieces`` by a hash of id and piece number; a shard is packed
in one task, so its memory is bounded however large the input is, and only ids and lengths travel.

Defined results: a document of length 0 or null takes no room and gets no row; repeated rows are packed
each; an empty table gives an empty result; the input's other columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cascade import words_of
from tidemark.llm.stage import stored

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Fixed values of the cost model: tokens that a sequence costs besides its own, and the length at which attention doubles a token's cost.
OVERHEAD, QUADRATIC = 64, 16384
SHARD_PIECES = 20_000


def cost(length: int) -> float:
    return OVERHEAD + length + length * length / QUADRATIC


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> list[tuple[int, int, int]]:
    """(bin, offset, final bin length) of each piece; every size is 1 to max(lengths)."""
    lengths = sorted(lengths)
    remaining = sum(sizes)
    room: list[tuple[int, int]] = []
    filled: list[int] = []
    placed: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:
            opened = min((x for x in lengths if x >= size), key=lambda x: (cost(x) / min(x, remaining), x))
            left, number = opened, len(filled)
            filled.append(0)
        placed[i] = (number, filled[number])
        filled[number] += size
        remaining -= size
        if left > size:
            insort(room, (left - size, number))
    final = [min((x for x in lengths if x >= n), key=lambda x: (cost(x), x)) for n in filled]
    return [(number, offset, final[number]) for number, offset in placed]


def word_length(text: str = "text") -> Column:
    """Words of a text and one separator; 0 for a text without words."""
    n = F.size(words_of(F.col(text)))
    return F.when(n > 0, n + 1).otherwise(0).cast("long")


PACKED = "shard long, bin long, capacity long, offset long, doc_id long, piece long, start long, length long"


def pack(docs: DataFrame, length: Column, lengths: Sequence[int] = LENGTHS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row for each piece: its bin (shard, bin), the bin's capacity, the offset there, and the part of the document."""
    most = max(lengths)
    sized = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), length.cast("long").alias("total")).where("total > 0"), "lengths")
    pieces = sized.select("doc_id", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / most))).alias("piece")).select(
        "doc_id",
        F.col("piece").cast("long").alias("piece"),
        (F.col("piece") * most).cast("long").alias("start"),
        F.least(F.lit(most), F.col("total") - F.col("piece") * most).cast("long").alias("length"),
    )
    count = sized.agg(F.sum(F.ceil(F.col("total") / most))).first()[0] or 0
    shards = max(1, -(-int(count) // shard_pieces))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # an order that does not depend on how rows arrived
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        found = best_fit(rows["length"].tolist(), lengths)
        rows["bin"], rows["offset"], rows["capacity"] = (pd.Series(x, dtype="int64") for x in zip(*found, strict=True))
        return rows[["shard", "bin", "capacity", "offset", "doc_id", "piece", "start", "length"]]

    return pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards))).groupBy("shard").applyInPandas(run, PACKED)
