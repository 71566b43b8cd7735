"""Ranked lexical search by dual-tree traversal: the k best documents of every item, exactly.

A document's value for a term is an integer that grows with the term's count and falls with the document's
length; a term's weight falls with the number of documents that hold it. A score is the sum of weight times value
over an item's terms, so documents and items are vectors and scores are their products.

1. Items are taken in blocks of bounded size. Every document is cut once for a block and leaves its length and
   the counts of the block's terms; shards of a few hundred documents are stored with their document counts by term.
2. Sums over the shards give the corpus statistics, hence weights and values.
3. Items form a hierarchy and so do the documents of a shard; like vectors stand side by side. A node holds
   the maximum of its members in every coordinate, so the product of a document node and an item node
   bounds every score between them. Starting with the roots, a pair is dropped when its bound is below the
   weakest kth score of the node's items; other pairs are split into their children. Pairs of leaves are scored, the
   highest bounds first, so kth scores rise early.
4. A few shards are searched before the others, only to start with good kth scores: these are lower bounds
   whichever shards they come from, so no result depends on the choice.

All values are integers below 2**53 in doubles, so bounds and scores are exact and equal bounds are never dropped:
ties go to the smaller doc_id.

Sizes: a block has some ``BLOCK_BYTES`` of item text, or one longer item, and is what executors are sent; a
shard's matrix has at most ``CELLS`` cells. Every shard returns at most k rows an item, and Spark keeps k an item
and partition before the final ranking.

Defined results: a null or empty text has no terms, so such a document is not counted and such an item has no rows;
rows that share an item_id are one item with all their terms; rows that share a doc_id are documents of their own;
a null doc_id ranks behind equal scores, a null item_id is an item; other columns are ignored; very long texts make a
piece of their own; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.stage import stored
from tidemark.llm.words import U, Words, pieces, text_buffer

#: Bytes between terms: ASCII other than digits and letters.
APART = np.zeros(256, dtype=bool)
APART[:0x80] = True
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    APART[_low : _high + 1] = False

BEST = 10
BLOCK_BYTES, SHARD_DOCS, CELLS, SEED_SHARDS = 150_000, 1024, 6_000_000, 8
DOC_LEAF, ITEM_LEAF, BRANCH = 16, 4, 4
#: Share of length in a document's value, in hundredths.
LENGTH_SHARE = 90


@dataclass
class ItemBlock:
    """The items of a block: their ids, the sorted hashes of their terms and the terms' numbers for each item."""

    ids: list
    hashes: np.ndarray
    lengths: np.ndarray
    terms: list[np.ndarray]


def item_block(rows: list) -> ItemBlock:
    """A block from collected (item_id, text) rows; items without a term are left out."""
    words = Words(*text_buffer(pa.array([r["text"] or "" for r in rows], pa.string())), lower=True, apart=APART)
    hashes, first = np.unique(words.hash, return_index=True)
    number = np.searchsorted(hashes, words.hash)
    terms: dict[object, set] = {}
    for i, r in enumerate(rows):
        found = number[words.first[i] : words.first[i + 1]]
        if len(found):
            terms.setdefault(r["item_id"], set()).update(found.tolist())
    return ItemBlock(list(terms), hashes, (words.end - words.start)[first], [np.array(sorted(t), dtype=np.int64) for t in terms.values()])


SHARDS = "ids array<long>, sizes binary, place binary, term binary, times binary, terms array<long>, docs array<long>, n long, total long"


def document_shards(docs: DataFrame, block: ItemBlock) -> DataFrame:
    """Shards of documents: lengths and the counts of the block's terms, with sums for the corpus statistics."""

    def shard(parts: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts])
        shift = np.cumsum([0] + [len(p[1]) for p in parts[:-1]])
        place = np.concatenate([p[2] + s for p, s in zip(parts, shift, strict=True)]).astype(np.int32)
        term, times = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (3, 4))
        terms, held = np.unique(term, return_counts=True)
        lists = lambda x: pa.array([x], pa.list_(pa.int64()))
        cells = [lists(ids.to_pylist()), *(pa.array([x.tobytes()], pa.binary()) for x in (sizes, place, term, times)), lists(terms), lists(held)]
        cells += [pa.array([int((sizes > 0).sum())]), pa.array([int(sizes.sum())])]
        return pa.RecordBatch.from_arrays(cells, [x.split()[0] for x in SHARDS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for piece in pieces(batches, "text"):
            words = Words(*text_buffer(piece.column("text")), lower=True, apart=APART)
            at = np.minimum(np.searchsorted(block.hashes, words.hash), len(block.hashes) - 1)
            known = np.flatnonzero((block.hashes[at] == words.hash) & (block.lengths[at] == words.end - words.start))
            cell, times = np.unique(words.text_of()[known] * len(block.hashes) + at[known], return_counts=True)
            part = (piece.column("doc_id"), words.count.astype(np.int64), cell // len(block.hashes), cell % len(block.hashes), times)
            if parts and size + len(piece) > SHARD_DOCS:
                yield shard(parts)
                parts, size = [], 0
            parts.append(part)
            size += len(piece)
        if parts:
            yield shard(parts)

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(text.mapInArrow(run, SHARDS), "search-shards")


@dataclass
class Hierarchy:
    """Coordinate maxima of the nodes of every level, the leaves first; ``order`` has the members leaf by leaf."""

    order: np.ndarray
    leaf: int
    levels: list[np.ndarray]

    def members(self, leaf: int) -> np.ndarray:
        return self.order[leaf * self.leaf : (leaf + 1) * self.leaf]


def hierarchy(vectors: np.ndarray, order: np.ndarray, leaf: int) -> Hierarchy:
    levels = [np.maximum.reduceat(vectors[order], np.arange(0, len(order), leaf), axis=0)]
    while len(levels[-1]) > BRANCH:
        levels.append(np.maximum.reduceat(levels[-1], np.arange(0, len(levels[-1]), BRANCH), axis=0))
    return Hierarchy(order, leaf, levels)


def by_strongest(vectors: np.ndarray) -> np.ndarray:
    """Members in the order of their strongest coordinate and its size: like vectors side by side."""
    top = vectors.argmax(axis=1)
    return np.lexsort((-vectors[np.arange(len(vectors)), top], top))


class Search:
    """The best documents of a block's items among some documents, starting from known lower bounds of kth scores."""

    def __init__(self, block: ItemBlock, weight: np.ndarray, kth: np.ndarray, best: int):
        self.weight, self.best = weight, best
        vectors = np.zeros((len(block.ids), len(weight)))
        for i, t in enumerate(block.terms):
            vectors[i, t] = weight[t]
        self.items = hierarchy(vectors, by_strongest(vectors), ITEM_LEAF)
        # an item node's bound only needs the terms of its items
        self.columns = [[np.flatnonzero(row) for row in level] for level in self.items.levels]
        self.vectors, self.kth = vectors, kth.astype(np.float64)
        self.lists: list[list[tuple]] = [[] for _ in block.ids]

    def weakest(self) -> list[np.ndarray]:
        """The smallest kth score below every item node, level by level."""
        low = [np.minimum.reduceat(self.kth[self.items.order], np.arange(0, len(self.kth), ITEM_LEAF))]
        for level in self.items.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], np.arange(0, len(low[-1]), BRANCH))[: len(level)])
        return low

    def run(self, ids: list, values: np.ndarray) -> None:
        """Search documents with these ids and term values (documents x terms)."""
        docs = hierarchy(values, by_strongest(values * self.weight.astype(np.float32)), DOC_LEAF)
        i, d = len(self.items.levels) - 1, len(docs.levels) - 1
        # for every item node of the level the document nodes that are still open
        open_docs = [np.arange(len(docs.levels[d]))] * len(self.items.levels[i])
        while True:
            low = self.weakest()[i]
            bounds = []
            for node, nodes in enumerate(open_docs):
                columns = self.columns[i][node]
                bound = docs.levels[d][np.ix_(nodes, columns)].astype(np.float64) @ self.items.levels[i][node, columns]
                kept = (bound >= low[node]) & (bound > 0)
                open_docs[node] = nodes[kept]
                bounds.append(bound[kept])
            if i == d == 0:
                break
            if d:
                d -= 1
                last = len(docs.levels[d])
                open_docs = [(x[:, None] * BRANCH + np.arange(BRANCH)).ravel() for x in open_docs]
                open_docs = [x[x < last] for x in open_docs]
            if i:
                i -= 1
                open_docs = [open_docs[node // BRANCH] for node in range(len(self.items.levels[i]))]
        for node, (nodes, bound) in enumerate(zip(open_docs, bounds, strict=True)):
            members, columns = self.items.members(node), self.columns[0][node]
            weights = self.vectors[np.ix_(members, columns)].T
            for k in np.argsort(-bound, kind="stable"):
                if bound[k] < self.kth[members].min():
                    break
                inside = docs.members(int(nodes[k]))
                scores = values[np.ix_(inside, columns)].astype(np.float64) @ weights
                for column, item in enumerate(members):
                    good = np.flatnonzero((scores[:, column] >= self.kth[item]) & (scores[:, column] > 0))
                    if len(good):
                        self._keep(int(item), [(-int(scores[g, column]), ids[inside[g]] is None, ids[inside[g]] or 0) for g in good])

    def _keep(self, item: int, found: list[tuple]) -> None:
        self.lists[item] = sorted(self.lists[item] + found)[: self.best]
        if len(self.lists[item]) == self.best:
            self.kth[item] = max(self.kth[item], -self.lists[item][-1][0])


def searched(shards: DataFrame, block: ItemBlock, n: int, total: int, held: dict[int, int], kth: np.ndarray, best: int) -> DataFrame:
    """item (its number in the block), doc_id, score: the best documents of every item in each task's shards."""
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * held.get(t, 0) + 1))) for t in range(len(block.hashes))], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(block, weight, kth, best)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], dtype=np.int64)
                place, term, times = (np.frombuffer(row[c], dtype=np.int32).astype(np.int64) for c in ("place", "term", "times"))
                length = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * s * n // total for s in sizes.tolist()], dtype=np.int64)
                value = (10**9 * times) // (1000 * times + 8 * length[place])
                step = max(DOC_LEAF, CELLS // len(weight))
                for a in range(0, len(sizes), step):
                    low, high = np.searchsorted(place, [a, a + step])
                    # values are below 10**6, which 32-bit floats hold exactly
                    values = np.zeros((min(step, len(sizes) - a), len(weight)), dtype=np.float32)
                    values[place[low:high] - a, term[low:high]] = value[low:high]
                    search.run(row["ids"][a : a + step], values)
        found = [(i, None if null else doc, -score) for i, x in enumerate(search.lists) for score, null, doc in x]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["item", "doc_id", "score"])

    return shards.select("ids", "sizes", "place", "term", "times").mapInArrow(run, "item long, doc_id long, score long")


def ranked(found: DataFrame, best: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def block_results(docs: DataFrame, block: ItemBlock, best: int) -> DataFrame:
    """item, rank, doc_id, score of one block."""
    shards = document_shards(docs, block)
    totals = shards.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    n, total = int(totals["n"] or 0), int(totals["total"] or 0)
    counts = shards.select(F.explode(F.arrays_zip("terms", "docs")).alias("x")).groupBy("x.terms").agg(F.sum("x.docs").alias("docs"))
    held = {r["terms"]: r["docs"] for r in counts.collect()}  # one row for each term of the block
    kth = np.zeros(len(block.ids), dtype=np.int64)
    seeds = searched(shards.limit(SEED_SHARDS), block, n, total, held, kth, best)
    for r in ranked(seeds, best).where(F.col("rank") == best).select("item", "score").collect():
        kth[r["item"]] = r["score"]
    return ranked(searched(shards, block, n, total, held, kth, best), best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of every item with a score above 0."""
    spark = docs.sparkSession
    items = items.select("item_id", "text")
    bytes_of_text = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(bytes_of_text / block_bytes))
    item_type = items.schema["item_id"].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for number in range(blocks):
        # one block of items at a time reaches the driver
        block = item_block(items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect())
        if not block.ids:
            continue
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item long, item_id {item_type}")
        found = block_results(docs, block, best)
        out = out.unionByName(stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "search-block"))
    return out
