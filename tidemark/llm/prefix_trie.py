"""Prefix trie of conversations on double arrays, one for each shard of sorted turn sequences.

1. A turn is named by the 128-bit hash of its role and text; a conversation is the sequence of its
   turns' names. Equal sequences are counted first, so copies cost one row.
2. Different sequences are range-partitioned and sorted. Any stretch of them is a prefix shard: turns get
   dense ids, and BASE and CHECK arrays hold the trie (the child of slot s by turn id t is slot
   BASE[s] + t if CHECK there is s). Walking all sequences through the arrays gives each slot its
   members; CHECK carries the sums of subtrees upwards.
3. A node that reaches beyond its shard lies on the first or last sequence of the shard, so only these
   upper nodes are merged over all shards. Their subtree sums double their reach every round, so the rounds
   number log2 of the depth.
4. The conversations that end at a node are sorted over all partitions, written as chunks of ids, and
   hashed chunk after chunk.

Sizes: a shard holds ``shard_turns`` turns or one conversation; upper nodes are two sequences a shard; a
frequent first turn or sequence is split by what follows it and counted before the shuffle. The turns of one
conversation meet in one task, at some 40 bytes a turn; texts are not carried there.

Defined results: a null role or text is empty; a null turn sorts first, equal turns by the hash of their content;
rows without a conversation id belong to no conversation; repeated rows are turns of their own; other columns
are ignored, whatever their names; very long texts only cost their hash; an empty table gives no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import stored

SHARD_TURNS, CHUNK_IDS = 200_000, 4096
#: Free places tried for the children of one node before they go behind the end of the arrays.
TRIES = 32


class DoubleArray:
    """BASE and CHECK of the trie of sorted, different sequences of dense ids."""

    def __init__(self, sequences: list[np.ndarray]):
        self.sequences = sequences
        nodes = sum(map(len, sequences)) + 1
        self.base = np.zeros(2 * nodes + 8, dtype=np.int64)
        self.check = np.full(2 * nodes + 8, -1, dtype=np.int64)
        self.free, self.end = 1, 1
        #: Slots of every depth, and the slot of each sequence that reaches it.
        self.levels: list[np.ndarray] = [np.zeros(1, dtype=np.int64)]
        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        flat = np.concatenate(sequences) if sequences else np.zeros(0, dtype=np.int64)
        begin = np.cumsum(lengths) - lengths
        active, slot = np.flatnonzero(lengths > 0), np.zeros(len(sequences), dtype=np.int64)
        depth = 0
        while len(active):
            ids = flat[begin[active] + depth]
            parents = slot[active]
            new = np.ones(len(active), dtype=bool)
            # children of one node stand side by side, as the sequences are sorted
            new[1:] = (parents[1:] != parents[:-1]) | (ids[1:] != ids[:-1])
            heads = np.flatnonzero(new)
            edges = np.append(np.flatnonzero(np.append(True, parents[heads][1:] != parents[heads][:-1])), len(heads))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                self._place(int(parents[heads[a]]), ids[heads[a:b]])
            slot[active] = self.base[parents] + ids
            self.levels.append(slot[active[heads]])
            depth += 1
            active = active[lengths[active] > depth]
        #: The slot where each sequence ends.
        self.ends = slot

    def _place(self, parent: int, ids: np.ndarray) -> None:
        if len(ids) == 1:
            while self.check[self.free] >= 0:
                self.free += 1
            base = self.free - int(ids[0])
        else:
            low, place = int(ids.min()), self.free
            for _ in range(TRIES):
                while place < self.end and self.check[place] >= 0:
                    place += 1
                base = place - low
                self._reach(base + int(ids.max()))
                if place >= self.end or (self.check[base + ids] < 0).all():
                    break
                place += 1
            else:
                base = self.end - low
                self._reach(base + int(ids.max()))
        self.base[parent] = base
        self.check[base + ids] = parent
        self.end = max(self.end, base + int(ids.max()) + 1)
        self._reach(self.end + 1)

    def _reach(self, size: int) -> None:
        if size >= len(self.check):
            more = size + len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def walk(self, ids: np.ndarray) -> np.ndarray:
        """The slots that a sequence passes, the root first; ends early at the first unknown turn."""
        slots = [0]
        for t in ids.tolist():
            to = int(self.base[slots[-1]]) + t
            if not 0 < to < len(self.check) or self.check[to] != slots[-1]:
                break
            slots.append(to)
        return np.array(slots)

    def down(self, counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members and smallest member of every slot: sums and minima carried from the ends to the root."""
        members = np.zeros(len(self.check), dtype=np.int64)
        smallest = np.full(len(self.check), np.iinfo(np.int64).max)
        members[self.ends], smallest[self.ends] = counts, firsts
        for slots in self.levels[:0:-1]:
            np.add.at(members, self.check[slots], members[slots])
            np.minimum.at(smallest, self.check[slots], smallest[slots])
        return members, smallest


NODES = (
    "shared boolean, key string, depth long, conv_id long, parent_key string, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, words long, end_key string"
)
_KINDS = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64()}


def _prefix_keys(turns: list[bytes]) -> list[str]:
    """The key of every prefix of a sequence, the empty one first: the hash of its turns' names."""
    state, keys = hashlib.md5(), []
    for t in (b"", *turns):
        state.update(t.hex().encode())
        keys.append(state.copy().hexdigest())
    return keys


def _shard(keys: list[str], turns: list[list[bytes]], words: list[list[int]], firsts: list[int], counts: list[int]) -> pa.RecordBatch:
    """The nodes of one shard of sorted sequences."""
    dense: dict[bytes, int] = {}
    depth = max(map(len, turns))
    reached = list(range(len(turns)))
    for d in range(depth):
        reached = [i for i in reached if len(turns[i]) > d]
        for i in reached:
            dense.setdefault(turns[i][d], len(dense))
    trie = DoubleArray([np.array([dense[t] for t in x], dtype=np.int64) for x in turns])
    members, smallest = trie.down(np.array(counts), np.array(firsts))
    size = len(trie.check)
    spoken = np.zeros(len(dense), dtype=np.int64)
    for x, w in zip(turns, words, strict=True):
        spoken[[dense[t] for t in x]] = w
    shared_key: dict[int, str] = {}
    for i in (0, len(turns) - 1):
        shared_key |= zip(trie.walk(trie.sequences[i]).tolist(), _prefix_keys(turns[i]), strict=True)
    shared = np.zeros(size, dtype=bool)
    shared[list(shared_key)] = True
    level = np.zeros(size, dtype=np.int64)
    tokens, leaves, saved, children = (np.zeros(size, dtype=np.int64) for _ in range(4))
    for d, slots in enumerate(trie.levels):
        level[slots] = d
        if d:
            tokens[slots] = spoken[slots - trie.base[trie.check[slots]]]
    for slots in trie.levels[::-1]:
        # shared nodes get their own part when all shards are merged
        mine = slots[~shared[slots]]
        leaves[mine] += children[mine] == 0
        saved[mine] += (members[mine] - 1) * tokens[mine]
        if slots[0] != 0:
            up = trie.check[mine]
            for sums in (leaves, saved):
                np.add.at(sums, up, sums[mine])
            np.add.at(children, up, 1)
    slots = np.concatenate(trie.levels)
    up = trie.check[slots]
    end_key = dict(zip(trie.ends.tolist(), keys, strict=True))
    shared_up = [u >= 0 and bool(shared[u]) for u in up.tolist()]
    values = {
        "shared": shared[slots].tolist(),
        "key": [shared_key.get(s) for s in slots.tolist()],
        "depth": level[slots],
        "conv_id": smallest[slots],
        "parent_key": [shared_key[u] if s else None for u, s in zip(up.tolist(), shared_up, strict=True)],
        "parent_conv_id": [None if s or u < 0 else int(smallest[u]) for u, s in zip(up.tolist(), shared_up, strict=True)],
        "n_convs": members[slots],
        "n_children": children[slots],
        "n_leaves": leaves[slots],
        "saved_tokens": saved[slots],
        "words": tokens[slots],
        "end_key": [end_key.get(s) for s in slots.tolist()],
    }
    kinds = dict(x.split() for x in NODES.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[kinds[n]]) for n, v in values.items()], list(values))


def shard_nodes(sequences: DataFrame, shard_turns: int) -> DataFrame:
    """The nodes of the shards of ``sequences`` (key, turns, words, first_id, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], []]
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("key", "turns", "words", "first_id", "n")), strict=True):
                if rows[0] and size + len(row[1]) > shard_turns:
                    yield _shard(*rows)
                    rows, size = [[], [], [], [], []], 0
                for cells, cell in zip(rows, row, strict=True):
                    cells.append(cell)
                size += len(row[1])
        if rows[0]:
            yield _shard(*rows)

    # range partitions, sorted: every shard is a stretch of the sorted sequences
    return sequences.repartitionByRange("turns").sortWithinPartitions("turns").mapInArrow(run, NODES)


def end_digests(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """key, digest: SHA-256 of the conversations (key, conv_id) with this sequence, ascending, comma-joined.

    Sorting is spread over all partitions whatever the size of one sequence's group; the last pass only reads
    the chunks of ids and keeps one running hash.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()
            out, at = [], 0
            while at < len(ids):
                to = at + 1
                while to < len(ids) and to - at < chunk_ids and keys[to] == keys[at]:
                    to += 1
                out.append((keys[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            if out:
                k, i, t = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i, pa.int64()), pa.array(t)], ["key", "first_id", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        row = lambda: pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["key", "digest"])
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k != key:
                    if state:
                        yield row()
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state:
            yield row()

    cut = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(chunks, "key string, first_id long, ids string")
    return cut.repartition("key").sortWithinPartitions("key", "first_id").mapInArrow(digests, "key string, digest string")


def merged_upper_nodes(nodes: DataFrame) -> DataFrame:
    """The upper nodes of all shards, one row for each prefix, with the sums of their whole subtrees."""
    partial = nodes.where("shared").groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.sum("n_convs").alias("n_convs"),
        F.sum("n_children").alias("inner"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.max("words").alias("words"), F.max("end_key").alias("end_key"),
    )
    upper = stored(partial, "trie-upper")
    below = upper.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("outer"), F.lit(1).alias("one"))
    counted = upper.join(below, "key", "left").selectExpr(
        "*", "inner + coalesce(outer, 0) as n_children", "parent_key as far",
    ).selectExpr(
        "key", "depth", "conv_id", "parent_key", "far", "n_convs", "n_children", "end_key",
        "leaves + if(n_children = 0, 1, 0) as n_leaves", "saved + (n_convs - 1) * words as saved_tokens",
    )
    state = stored(counted, "trie-sums")
    # far is the 2^k-th ancestor; sums cover descendants less than 2^k steps below
    while state.where("far is not null").limit(1).count():
        lifted = state.where("far is not null").groupBy(F.col("far").alias("key")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        ancestor = state.selectExpr("key as far", "far as farther")
        kept = [c for c in state.columns if c not in {"far", "n_leaves", "saved_tokens"}]
        summed = state.join(lifted, "key", "left").selectExpr(
            *kept, "far", "n_leaves + coalesce(more_leaves, 0) as n_leaves", "saved_tokens + coalesce(more_saved, 0) as saved_tokens"
        )
        moved = summed.where("far is not null").join(ancestor, "far").drop("far").withColumnRenamed("farther", "far")
        state = stored(moved.unionByName(summed.where("far is null")), "trie-sums")
    return state.drop("far")


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_key"]


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row for each node of the trie of ``sequences`` (conv_id, turns, words).

    ``turns`` are names of turns, ``words`` their token counts. Returns conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    """
    keyed = stored(
        sequences.select("conv_id", "turns", "words", F.md5(F.array_join(F.transform("turns", lambda t: F.lower(F.hex(t))), "")).alias("key")),
        "trie-sequences",
    )
    different = keyed.groupBy("key").agg(F.min("conv_id").alias("first_id"), F.count("*").alias("n"), F.first("turns").alias("turns"), F.first("words").alias("words"))
    nodes = stored(shard_nodes(different, shard_turns), "trie-nodes")
    upper = stored(merged_upper_nodes(nodes), "trie-merged")
    parents = upper.selectExpr("key as parent_key", "conv_id as parent_conv_id")
    inner = nodes.where("not shared").drop("shared", "key", "words")
    found = (
        inner.where("parent_key is null").select(*RESULT)
        .unionByName(inner.where("parent_key is not null").drop("parent_conv_id").join(parents, "parent_key").select(*RESULT))
        .unionByName(upper.where("parent_key is not null").join(parents, "parent_key").select(*RESULT))
        .unionByName(upper.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*RESULT))
    )
    digests = end_digests(keyed.select("key", "conv_id"), chunk_ids).withColumnRenamed("key", "end_key")
    return (
        found.where("end_key is not null").join(digests, "end_key").drop("end_key").withColumnRenamed("digest", "ends_sha256")
        .unionByName(found.where("end_key is null").drop("end_key").withColumn("ends_sha256", F.sha2(F.lit(b""), 256)))
    )


def turn_name(role: Column, text: Column) -> Column:
    """128-bit name of a turn; the length of the role keeps role and text apart."""
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns, words: the names and word counts of every conversation's turns, in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_name(role, text).alias("name"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ordered = named.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "name", "words"))).alias("t"))
    return ordered.select("conv_id", F.col("t.name").alias("turns"), F.col("t.words").alias("words"))


def grafted(sequences: DataFrame, every: int, length: Column, longest: int) -> DataFrame:
    """Every conversation with its first ``length`` turns replaced by those of the conversation ``conv_id - conv_id % every``."""
    own = stored(sequences, "trie-turns")
    heads = own.where(F.col("conv_id") % every == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("head_turns"), F.slice("words", 1, longest).alias("head_words"),
    )
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", length).join(heads, "base", "left")

    def rebuilt(head: str, rest: str) -> Column:
        return F.concat(F.coalesce(F.slice(head, F.lit(1), F.col("h")), F.slice(rest, 1, 0)), F.slice(rest, F.col("h") + 1, F.size(rest)))

    return joined.select("conv_id", rebuilt("head_turns", "turns").alias("turns"), rebuilt("head_words", "words").alias("words"))
