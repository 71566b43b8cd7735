"""Near-duplicates by probability Jaccard of weighted word shingles (ProbMinHash).

A shingle that stands n times in a document weighs 1 + ln n, so a line repeated many times doesn't
outweigh the rest. Every element sends arrivals of a Poisson process with its weight as rate to random
registers; a register keeps its earliest arrival. An element stops as soon as its next arrival is later
than every register's (early termination), so most elements draw once. Two registers agree with the
probability Jaccard similarity of the documents.

1. Texts with equal word sequences are one node, the smallest id. Signatures are made once a document.
2. Bands of registers are hashed; nodes with an equal band share a bucket.
3. Hub rounds: every member is compared with one hub of its bucket, first the smallest node, then the
   node with most links that is in another component. A group of n copies makes n pairs a band and
   round, not n * n / 2. Candidates whose signatures agree in too few registers are left out (five
   standard deviations); the rest are verified on their whole texts, exactly.
4. Whatever still shares a bucket without being linked is compared too: in small buckets as pairs, in
   large ones in blocks of bounded size, the members outside the bucket's largest component against
   all, by long signatures made for them. Only pairs that may reach the similarity leave a
   block, and they are verified. So no two nodes of a bucket stay uncompared unless they are linked.

With 24 bands of 4 registers a pair at similarity 0.8 shares no bucket with a probability of 3e-6.

Defined results: texts of 1 to 4 words have one shingle, all their words; texts without words (null,
empty) are alone; rows that share an id are one node; rows with a null id are left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.stage import stored
from tidemark.llm.words import SECOND_FACTOR, Prefix, U, Words, mix, pieces, text_buffer

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
#: Agreeing registers below which a pair is not verified: 0.8 less five standard deviations.
LEAST_AGREEING = int(REGISTERS * SIMILARITY - 5 * (REGISTERS * SIMILARITY * (1 - SIMILARITY)) ** 0.5)
#: Rounds in which members are compared with one hub of their bucket.
HUB_ROUNDS = 3
#: Members of an open bucket beyond which it is compared in blocks; members outside and inside a block; registers of a long signature.
MANY, OUTSIDE, INSIDE, LONG = 8, 2048, 8192, 1024
#: Share of agreeing long registers below which a pair is not verified: five standard deviations less; one byte of each is kept.
LEAST_LONG = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / LONG) ** 0.5


def weighted_shingles(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash, 1 + ln of its count) of every different shingle of every text, by text."""
    prefix, text = Prefix(words.hash), words.text_of()
    n = len(text)
    grams = np.arange(max(0, n - size + 1))
    grams = grams[text[: len(grams)] == text[size - 1 :]] if len(grams) else grams
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    owner = np.concatenate((text[grams], short))
    value = np.concatenate((prefix.span(grams, grams + size), prefix.span(words.first[short], words.first[short + 1])))
    name = mix(value ^ mix(owner.astype(np.uint64) + U(1)))
    order = np.argsort(name)
    ordered = name[order]
    new = np.ones(len(ordered), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.flatnonzero(new)
    picked, weight = order[at], np.diff(np.append(at, len(ordered)))
    by_text = np.argsort(owner[picked], kind="stable")
    picked = picked[by_text]
    return owner[picked], value[picked], 1 + np.log(weight[by_text])


def signatures(text: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """Winner of each register: a (texts, registers) array of 32-bit element names, 0 where a text has none."""
    earliest = np.full(texts * registers, np.inf)
    winner = np.zeros(texts * registers, dtype=np.uint32)
    clock = np.zeros(len(value))
    active, turn = np.arange(len(value)), 0
    rate, base = weight.astype(np.float64), text * registers
    while len(active):
        turn += 1
        drawn = mix(value[active] + U(turn * 0x9E3779B97F4A7C15 % 2**64))
        time = clock[active] - np.log(((drawn >> U(11)).astype(np.float64) + 1.0) * 2.0**-53) / rate[active]
        place = base[active] + (((mix(drawn + U(0x632BE59BD9B4E019)) >> U(32)) * U(registers)) >> U(32)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        won = earliest[place] == time
        winner[place[won]] = (value[active[won]] >> U(32)).astype(np.uint32)
        clock[active] = time
        here = text[active]
        latest = np.zeros(texts)
        some = np.unique(here)
        latest[some] = earliest.reshape(texts, registers)[some].max(axis=1)
        active = active[time < latest[here]]
    return winner.reshape(texts, registers)


def signature_table(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes of the word sequence, the signature (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            words = Words(*text_buffer(piece.column("text")))
            signed = signatures(*weighted_shingles(words), len(piece))
            low, high = words.first[:-1], words.first[1:]
            parts = [Prefix(words.hash, f).span(low, high).view(np.int64) for f in (SECOND_FACTOR, SECOND_FACTOR + 2)]
            raw = signed.tobytes()
            width = signed.shape[1] * 4
            kept = [raw[i * width : (i + 1) * width] if n else None for i, n in enumerate(words.count)]
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), *map(pa.array, parts), pa.array(kept, pa.binary())], ["doc_id", "s1", "s2", "signature"]
            )

    return docs.mapInArrow(run, "doc_id long, s1 long, s2 long, signature binary")


def agreeing(a: Column, b: Column) -> Column:
    """Registers in which two signatures agree."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(REGISTERS - 1)), F.lit(0),
        lambda n, i: n + F.when(F.substring(a, i * 4 + 1, F.lit(4)) == F.substring(b, i * 4 + 1, F.lit(4)), 1).otherwise(0),
    )


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P of two weighted sets given as (sorted names, weights)."""
    names = np.union1d(a[0], b[0])
    if not len(names):
        return 0.0
    x, y = np.zeros(len(names)), np.zeros(len(names))
    x[np.searchsorted(names, a[0])], y[np.searchsorted(names, b[0])] = a[1], b[1]
    both = (x > 0) & (y > 0)
    pairs, times = np.unique(np.stack((x[both], y[both])), axis=1, return_counts=True)
    return float(sum(n / np.maximum(x / p, y / q).sum() for (p, q), n in zip(pairs.T, times, strict=True)))


def verified(pairs: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose whole texts have the similarity or more, and that similarity."""
    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(pieces(iter([batch]), "text_a"), "text_b"):
                sets = []
                for name in ("text_a", "text_b"):
                    text, value, weight = weighted_shingles(Words(*text_buffer(piece.column(name))))
                    edges = np.searchsorted(text, np.arange(len(piece) + 1))
                    cut = []
                    for i in range(len(piece)):
                        v, w = value[edges[i] : edges[i + 1]], weight[edges[i] : edges[i + 1]]
                        order = np.argsort(v)
                        cut.append((v[order], w[order]))
                    sets.append(cut)
                found = np.array([probability_jaccard(x, y) for x, y in zip(*sets, strict=True)])
                keep = pa.array(np.flatnonzero(found >= similarity - 1e-9))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a").take(keep), piece.column("b").take(keep), pa.array(found).take(keep)], ["a", "b", "similarity"]
                )

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long, similarity double")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct()


def _alike(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    a, b = signed.selectExpr("doc_id as a", "signature as sa"), signed.selectExpr("doc_id as b", "signature as sb")
    near = pairs.join(a, "a").join(b, "b").where(agreeing(F.col("sa"), F.col("sb")) >= LEAST_AGREEING)
    return near.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id for every row with an id: the smallest id of the component of its links.

    Writes signatures, candidates, verified links and the rounds of the components to the shared folder.
    """
    return near_duplicate_classes(docs, similarity)[0]


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(doc_id and class_id of every row with an id, verified links a, b, similarity between different texts)."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = stored(signature_table(docs), "signatures")
    filled = table.where("signature is not null")
    nodes = stored(filled.groupBy("s1", "s2").agg(F.min("doc_id").alias("node")), "nodes")
    member = table.select("doc_id", "s1", "s2").join(nodes, ["s1", "s2"], "left").selectExpr("doc_id", "coalesce(node, doc_id) as node")
    signed = filled.join(nodes, ["s1", "s2"]).where("doc_id = node").dropDuplicates(["s1", "s2"]).select("doc_id", "signature")
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(i, F.substring("signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS))),
    )
    buckets = signed.select(F.col("doc_id").alias("node"), F.posexplode(band).alias("band", "bucket"))
    shared = stored(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").drop("last"), "hubs")
    crowded = stored(buckets.join(shared, "bucket"), "buckets")
    some = stored(crowded.select(F.col("node").alias("doc_id")).distinct(), "crowded")
    texts, signed = stored(docs.join(some, "doc_id"), "crowded-texts"), stored(signed.join(some, "doc_id"), "crowded-signatures")
    tested: DataFrame | None = None
    links: DataFrame | None = None
    rows = crowded.selectExpr("node as a", "hub as b")
    for turn in range(HUB_ROUNDS + 1):
        if turn:
            members = _open_members(crowded.select("bucket", "band", "node"), links)
            rows = _hub_pairs(members, links) if turn < HUB_ROUNDS else _pairs_left(members, texts, signed)
        pairs = _ordered(rows)
        pairs = stored(_alike(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), signed), "pairs")
        found = stored(verified(pairs, texts, similarity), "verified")
        tested, links = (pairs, found) if tested is None else (tested.unionByName(pairs), links.unionByName(found))
    identical = member.where("doc_id <> node").selectExpr("doc_id as a", "node as b")
    found = components(links.select("a", "b").unionByName(identical))
    classes = table.select("doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return classes.selectExpr("doc_id", "coalesce(component, doc_id) as class_id"), links


def _open_members(crowded: DataFrame, links: DataFrame) -> DataFrame:
    """bucket, node, component, size of all buckets that hold several components."""
    found = components(links.select("a", "b"))
    named = crowded.join(found, "node", "left").selectExpr("bucket", "band", "node", "coalesce(component, node) as component")
    several = named.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size"))
    return stored(named.join(several.where("low < high").select("bucket", "size"), "bucket"), "open-buckets")


def _hub_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every open member with the node of its bucket that has most links, unless they are linked already."""
    degree = links.selectExpr("a as node").unionByName(links.selectExpr("b as node")).groupBy("node").agg(F.count("*").alias("degree"))
    rated = members.join(degree, "node", "left").fillna(0, ["degree"])
    hubs = rated.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("node"), "component")).alias("hub"))
    hubs = stored(hubs.select("bucket", (-F.col("hub.node")).alias("b"), F.col("hub.component").alias("other")), "hubs")
    return members.join(hubs, "bucket").where("component <> other").selectExpr("node as a", "b")


def _pairs_left(members: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs of open buckets in different components: all of small buckets, the likely ones of large buckets."""
    small = members.where(F.col("size") <= MANY)
    other = small.selectExpr("bucket", "node as b", "component as other")
    close = small.join(other, "bucket").where("component <> other and node < b").selectExpr("node as a", "b")
    return close.unionByName(_block_pairs(members.where(F.col("size") > MANY), texts, signed))


def long_signatures(texts: DataFrame) -> DataFrame:
    """doc_id and one byte of each of the long signature's registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            made = signatures(*weighted_shingles(Words(*text_buffer(piece.column("text")))), len(piece), LONG).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([x.tobytes() for x in made], pa.binary())], ["node", "long"])

    return texts.mapInArrow(run, "node long, long binary")


def _block_pairs(members: DataFrame, texts: DataFrame, signed: DataFrame) -> DataFrame:
    """Pairs of large buckets that may reach the similarity by their long signatures.

    The members outside a bucket's largest component meet all members, in blocks of about OUTSIDE by
    INSIDE rows that are groups of their own. A pair that shares several bands is given for the first only.
    """
    sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    plan = stored(largest.selectExpr(
        "bucket", "top.component as main",
        f"cast(ceil((all - top.n) / {OUTSIDE}) as int) as across", f"cast(ceil(all / {INSIDE}) as int) as down",
    ), "block-plan")
    nodes = stored(members.select(F.col("node").alias("doc_id")).distinct(), "open-nodes")
    long = long_signatures(texts.join(nodes, "doc_id").dropDuplicates(["doc_id"]))
    long = stored(long.join(signed.dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "node"), "node"), "long-signatures")
    rows = members.join(plan, "bucket").join(long, "node")
    inner = rows.select(
        "bucket", "band", "node", "component", "long", "signature", F.lit(False).alias("outside"),
        F.pmod(F.xxhash64("node"), F.col("down")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("across") - 1)).alias("j"),
    )
    outer = rows.where("component <> main").select(
        "bucket", "band", "node", "component", "long", "signature", F.lit(True).alias("outside"),
        F.explode(F.sequence(F.lit(0), F.col("down") - 1)).alias("i"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("across")).cast("int").alias("j"),
    )

    def run(group: pa.Table) -> pa.Table:
        node, component = (group.column(n).to_numpy() for n in ("node", "component"))
        outside = group.column("outside").to_numpy(zero_copy_only=False)
        made = np.frombuffer(b"".join(group.column("long").to_pylist()), dtype=np.uint8).reshape(-1, LONG)
        bands = np.frombuffer(b"".join(group.column("signature").to_pylist()), dtype=f"V{4 * ROWS}").reshape(-1, BANDS)
        band, inside = group.column("band")[0].as_py(), ~outside
        node_in, component_in, made_in, bands_in = node[inside], component[inside], made[inside], bands[inside]
        a, b = [], []
        for k in np.flatnonzero(outside):
            agree = (made_in == made[k]).sum(axis=1)
            hit = np.flatnonzero((agree >= LONG * LEAST_LONG) & (component_in != component[k]))
            hit = hit[(bands_in[hit] == bands[k]).argmax(axis=1) == band]
            a.append(np.full(len(hit), node[k]))
            b.append(node_in[hit])
        none = [np.zeros(0, dtype=np.int64)]
        return pa.table({"a": np.concatenate(a or none), "b": np.concatenate(b or none)})

    return inner.unionByName(outer).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
