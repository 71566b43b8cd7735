"""Substring dedup by relative Lempel-Ziv parsing against every earlier document.

A document is factored against the texts of all documents with a smaller id. The reference is cut
into content-defined blocks: consecutive ``window``-word windows with the same smallest
``anchor``-word hash form a block, so equal text gives equal blocks wherever it stands. Every block of
every document is in the index, under (anchor hash, block hash), with the smallest id that has it.

1. A block found under a smaller id is a phrase: all its windows are repeats.
2. At a factor's boundary a block is only partly repeated, so its hash differs. Wherever one anchor has
   several block versions, the windows of one document per version are compared one by one.
3. The parse walks each document from left to right: a factor starts at the first repeated window and
   goes on as long as the next windows are repeats from the same source. Factors have ``window`` words
   or more; their union is the set of duplicate words.

Sizes: about one index row per 18 words; windows are written only where versions of an anchor differ,
and only for one document per version, so thousands of copies cost no more than their index rows. Hot
anchors are aggregated in the map tasks first; joins back are plain equi-joins that adaptive execution
can split. Keys combine two 64-bit hashes.

Defined results: a null text has no words; texts under ``window`` words have no repeats; rows that share
an id are never each other's source; rows with a null id are neither sources nor repeats; extra columns
stay, those with a result's name are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.stage import stored
from tidemark.llm.words import Prefix, U, Words, mix, pieces, text_buffer, window_minimum

WINDOW, ANCHOR = 50, 16


class Blocks:
    """Windows of the texts of a piece and the runs of windows that form blocks."""

    def __init__(self, words: Words, window: int, anchor: int):
        self.window = window
        n = len(words.hash)
        self.prefix = Prefix(words.hash)
        text = words.text_of()
        if n < window:
            self.at = np.zeros(0, dtype=np.int64)
        else:
            places = np.arange(n - window + 1)
            self.at = places[text[: n - window + 1] == text[window - 1 :]]
        self.text = text[self.at]
        if len(self.at):
            grams = np.arange(n - anchor + 1)
            smallest = window_minimum(self.prefix.span(grams, grams + anchor), window - anchor + 1)
            self.key = smallest[self.at]
            new = np.ones(len(self.at), dtype=bool)
            new[1:] = (self.key[1:] != self.key[:-1]) | (self.text[1:] != self.text[:-1])
            self.run = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(self.at)) - 1
            self.run_first, self.run_last = first, last
            self.run_key, self.run_text = self.key[first], self.text[first]
            self.run_hash = self.prefix.span(self.at[first], self.at[last] + window)
        else:
            self.key = self.run_key = self.run_hash = np.zeros(0, dtype=np.uint64)
            self.run = self.run_text = self.run_first = self.run_last = np.zeros(0, dtype=np.int64)

    def window_hash(self, which: np.ndarray) -> np.ndarray:
        return self.prefix.span(self.at[which], self.at[which] + self.window)


def name_of(anchor_hash: np.ndarray, content_hash: np.ndarray) -> np.ndarray:
    """One 64-bit name for (anchor, block or window) inside one document."""
    return mix(anchor_hash * U(0x9E3779B97F4A7C15) + content_hash)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _cut(piece: pa.RecordBatch, window: int, anchor: int) -> tuple[Words, Blocks]:
    words = Words(*text_buffer(piece.column("text")))
    return words, Blocks(words, window, anchor)


def block_index(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, block, doc_id: one row for each block of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, blocks = _cut(piece, window, anchor)
            ids = piece.column("doc_id").take(pa.array(blocks.run_text))
            yield pa.RecordBatch.from_arrays([signed(blocks.run_key), signed(blocks.run_hash), ids], ["anchor", "block", "doc_id"])

    return docs.mapInArrow(run, "anchor long, block long, doc_id long")


def boundary_windows(asked: DataFrame, window: int, anchor: int) -> DataFrame:
    """anchor, content, doc_id: the windows of the asked blocks (columns doc_id, text, asked)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            _, blocks = _cut(piece, window, anchor)
            lists = piece.column("asked")
            names = _names(lists)
            owner = np.repeat(np.arange(len(piece)), np.diff(lists.offsets.to_numpy()))
            wanted = np.unique(mix(names ^ mix(owner.astype(np.uint64))))
            mine = mix(name_of(blocks.run_key, blocks.run_hash) ^ mix(blocks.run_text.astype(np.uint64)))
            which = np.flatnonzero(_among(mine, wanted)[blocks.run]) if len(blocks.run) else np.zeros(0, dtype=np.int64)
            ids = piece.column("doc_id").take(pa.array(blocks.text[which]))
            yield pa.RecordBatch.from_arrays(
                [signed(blocks.key[which]), signed(blocks.window_hash(which)), ids], ["anchor", "content", "doc_id"]
            )

    return asked.mapInArrow(run, "anchor long, content long, doc_id long")


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values stand in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def _names(lists: pa.Array) -> np.ndarray:
    """Names of the (anchor, content) structs of a list column without null entries."""
    flat = lists.flatten()
    field = lambda k: flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return name_of(field("anchor"), field("content"))


def repeated_content(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, anchor, content, source: blocks and windows of a document that stand in a smaller id.

    Writes its index, the shared anchors and blocks, the block versions and the boundary windows to the shared folder.
    """
    text = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    index = stored(block_index(text, window, anchor), "rlz-index")
    # aggregates are stored before they are joined back: adaptive execution splits a hot key only where both sides of a join are plain shuffles
    anchors = stored(index.groupBy("anchor").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.min("block").alias("low"), F.max("block").alias("high"),
    ).where("first_id < last_id"), "rlz-anchors")
    shared = stored(
        index.join(anchors, "anchor").selectExpr("anchor", "block", "doc_id", "first_id", "low = high as one_version"), "rlz-shared"
    )
    whole = shared.where("one_version and doc_id > first_id").selectExpr("doc_id", "anchor", "block as content", "first_id as source")
    several = shared.where("not one_version")
    versions = stored(several.groupBy("anchor", "block").agg(F.min("doc_id").alias("first_id")), "rlz-versions")
    copied = (
        several.drop("first_id").join(versions, ["anchor", "block"]).where("doc_id > first_id")
        .selectExpr("doc_id", "anchor", "block as content", "first_id as source")
    )
    asked = versions.groupBy(F.col("first_id").alias("doc_id")).agg(F.collect_list(F.struct("anchor", F.col("block").alias("content"))).alias("asked"))
    windows = stored(boundary_windows(text.join(asked, "doc_id"), window, anchor), "rlz-windows")
    earliest = windows.groupBy("anchor", "content").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last_id")).where("source < last_id")
    partly = windows.join(stored(earliest.drop("last_id"), "rlz-earliest"), ["anchor", "content"]).where("doc_id > source").select("doc_id", "anchor", "content", "source")
    return whole.unionByName(copied).unionByName(partly)


def factors(sources: np.ndarray, found: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """Greedy factors (start, end, source) of one text from its repeated windows.

    ``found`` marks the windows, ``sources`` their earliest document, ``at`` their first words.
    """
    out: list[tuple[int, int, int]] = []
    which = np.flatnonzero(found)
    if not len(which):
        return out
    breaks = np.flatnonzero((np.diff(at[which]) != 1) | (np.diff(sources[which]) != 0)) + 1
    reached = 0
    for a, b in zip(np.append(0, breaks), np.append(breaks, len(which)), strict=True):
        start, end = max(int(at[which[a]]), reached), int(at[which[b - 1]]) + window
        if end > start:
            out.append((start, end, int(sources[which[a]])))
            reached = end
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("source", T.LongType())]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, layout: bool = False) -> DataFrame:
    """``docs`` with ``text`` less its duplicate words, n_words, n_removed and the ``spans`` removed.

    Spans count words of the input text and name the earliest document of their factor. With
    ``layout`` the bytes between kept words stay as they are; else kept words are joined by one space.
    """
    results = {"n_words": "long", "n_removed": "long", "spans": None}
    docs = docs.drop(*results, "_repeats")
    repeats = repeated_content(docs, window, anchor).groupBy("doc_id").agg(
        F.collect_list(F.struct("anchor", "content", "source")).alias("_repeats")
    ).withColumnRenamed("doc_id", "_id")
    plain = docs.withColumn("text", F.coalesce("text", F.lit("")))
    joined = plain.join(repeats, plain["doc_id"].cast("long") == F.col("_id"), "left").drop("_id")
    schema = T.StructType([
        *plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", SPANS),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            yield _without_repeats(piece, window, anchor, layout)

    return joined.mapInArrow(run, schema)


def _without_repeats(piece: pa.RecordBatch, window: int, anchor: int, layout: bool) -> pa.RecordBatch:
    lists = piece.column("_repeats")
    touched = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    kept: list[str] = []
    texts = piece.column("text").to_pylist()
    counts, removed, spans = [0] * len(texts), [0] * len(texts), [[] for _ in texts]
    hit = set(touched.tolist())
    for i, text in enumerate(texts):
        if i in hit:
            kept.append("")
            continue
        split = text.encode().split()
        counts[i] = len(split)
        kept.append(text if layout else b" ".join(split).decode())
    del texts
    if len(touched):
        part = piece.take(pa.array(touched))
        words, blocks = _cut(part, window, anchor)
        entries = part.column("_repeats")
        names, source = _names(entries), entries.flatten().field("source").to_numpy(zero_copy_only=False)
        places = entries.offsets.to_numpy() - entries.offsets[0].as_py()
        edges = np.searchsorted(blocks.text, np.arange(len(touched) + 1))
        run_name = name_of(blocks.run_key, blocks.run_hash)
        raw = words.data.tobytes()
        window_name = name_of(blocks.key, blocks.window_hash(np.arange(len(blocks.at))))
        for j, i in enumerate(touched):
            # the smallest source of a name first, so that a lookup finds it
            order = np.lexsort((source[places[j] : places[j + 1]], names[places[j] : places[j + 1]]))
            mine, from_ids = names[places[j] : places[j + 1]][order], source[places[j] : places[j + 1]][order]
            a, b = edges[j], edges[j + 1]
            found, origin = np.zeros(b - a, dtype=bool), np.zeros(b - a, dtype=np.int64)
            for name in (window_name[a:b], run_name[blocks.run[a:b]]):
                at = np.minimum(np.searchsorted(mine, name), len(mine) - 1)
                same = mine[at] == name
                origin[same], found = from_ids[at[same]], found | same
            low, high = words.first[j], words.first[j + 1]
            spans[i] = factors(origin, found, blocks.at[a:b] - low, window)
            gone = np.zeros(high - low, dtype=bool)
            for start, end, _ in spans[i]:
                gone[start:end] = True
            counts[i], removed[i] = int(high - low), int(gone.sum())
            kept[i] = _kept_text(raw, words, low, gone, int(words.offsets[j]), int(words.offsets[j + 1]), layout)
    columns = {n: piece.column(n) for n in piece.schema.names if n != "_repeats"}
    columns["text"] = pa.array(kept, pa.string())
    columns |= {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source", pa.int64())]))
    columns["spans"] = pa.array([[{"start": a, "end": b, "source": s} for a, b, s in x] for x in spans], kind)
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _kept_text(raw: bytes, words: Words, low: int, gone: np.ndarray, begin: int, stop: int, layout: bool) -> str:
    if layout:
        out, at = [], begin
        change = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
        for a, b in change.reshape(-1, 2):
            out.append(raw[at : words.start[low + a]])
            at = int(words.end[low + b - 1])
        out.append(raw[at:stop])
        return b"".join(out).decode()
    left = low + np.flatnonzero(~gone)
    return b" ".join([raw[a:b] for a, b in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)]).decode()
