"""Katz backoff language model: counts, Good-Turing discounts, exactly normalised backoff, scores.

    P(w | h) = d(c(hw)) c(hw) / c(h)      if the n-gram hw was seen
             = a(h) P(w | h')             else, h' being h less its first word
    a(h)     = (1 - sum of P over seen w) / (1 - sum of P(w | h') over the same w)

so the probabilities of all V training tokens and one unknown token add up to 1 after every history.

Texts are cut once into blocks of about ``block_tokens`` tokens, a stored table: words become numbers of
the block's own vocabulary. Then, order by order:

1. Every block asks for its different n-grams: one row for each (bucket, block) holds histories and words
   and the block's training counts. Of order 1 these are word hashes; a bucket answers with corpus-wide word
   numbers, frequent words first, and from then on n-grams are named exactly, by the numbers of their words.
   Higher orders also send c(h'w), which gives P(w | h') but for the divisor of h'; the block knows that.
2. A bucket merges its n-grams: total counts, and for each history how many words were seen 1 to 5
   times and the sum of d c(h'w) over them. It writes the model's tables (counts by bucket) and one
   answer for each block that asked: counts of its n-grams, and what backing off needs only for
   histories before a word that was not seen after them.
3. The next order, or the final scoring, joins the blocks with their answers. The tokens after a history number
   as many as the history itself, so its count comes from the order below. Every token is scored by recursion
   from the longest history down.

Sizes: a block and a bucket hold a bounded number of n-grams; their numbers grow with the corpus.
Histories that hold more than a thousandth of all tokens, at most a thousand of them, are dealt over all
buckets by history and word; only their few totals reach the driver, along with counts of counts. The
block table is bucketed by block, so its rows are not shuffled again. Shuffled rows are removed when the job that
wrote them ends. Word numbers and counts have 32 bits; a corpus beyond that is refused.

Defined results: a null text is empty and has one token, the end; an empty training set gives the
unknown token all the mass; a null id counts as training; repeated rows are counted and scored each; very
long texts make a block of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.stage import stored
from tidemark.llm.words import U, Words, mix, pieces, text_buffer
from tidemark.session import brief_shuffles, ensure_checkpoint_dir

ORDER, DISCOUNTED = 3, 5
BLOCK_TOKENS, BUCKET_TOKENS = 1_800_000, 1_250_000
#: Histories with more than this share of the training tokens are dealt over all buckets.
HOT_SHARE = 1000
END, ROOT = (U(0x1B873593CC9E2D51 * k % 2**64) for k in (1, 5))
#: Number of the mark that stands before a text; words have higher ones.
START = 0


_ZSTD = pa.Codec("zstd", compression_level=3)


def different(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each different value, number of each place's value), in 32-bit numbers."""
    order = np.argsort(names, kind="stable").astype(np.int32)
    names = names[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = names[1:] != names[:-1]
    number = np.empty(len(names), dtype=np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - 1
    return order[new], number


def packed(values: np.ndarray) -> bytes:
    """Bytes of an array, like bytes next to each other, compressed."""
    width = values.itemsize
    bits = values.view(f"u{width}")
    planes = np.empty((width, len(bits)), dtype=np.uint8)
    for i in range(width):
        np.copyto(planes[i], bits >> bits.dtype.type(8 * i) if i else bits, casting="unsafe")
    return planes.nbytes.to_bytes(8, "little") + (_ZSTD.compress(planes, asbytes=True) if planes.nbytes else b"")


def unpacked(data: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not size:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(_ZSTD.decompress(data[8:], decompressed_size=size, asbytes=True), dtype=np.uint8).reshape(width, -1)
    bits = planes[0].astype(f"u{width}")
    for i in range(1, width):
        if planes[i].any():
            bits |= planes[i].astype(bits.dtype) << bits.dtype.type(8 * i)
    return bits.view(kind)


def packed_steps(ordered: np.ndarray) -> bytes:
    """Numbers in ascending runs as their differences, whose upper bytes are nearly all zero; they wrap between runs."""
    return packed(np.diff(ordered, prepend=ordered.dtype.type(0)))


def unpacked_steps(data: bytes, kind=np.uint64) -> np.ndarray:
    return np.cumsum(unpacked(data, kind), dtype=kind)


def named(columns: list[np.ndarray]) -> np.ndarray:
    """64-bit names of n-grams from the numbers of their words, one column a place."""
    out = np.full(len(columns[0]), ROOT, dtype=np.uint64)
    for column in columns:
        out = extended(out, column)
    return out


def extended(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix(names * U(0x9E3779B97F4A7C15) + words + U(1))


BLOCKS = "block long, size long, trained long, ids array<long>, held array<boolean>, words binary, vocabulary binary, tokens binary"


def block_table(docs: DataFrame, block_tokens: int) -> DataFrame:
    """The stored blocks of documents (doc_id, held, text), bucketed by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        ids, held, counts, hashes, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words = np.concatenate(hashes)
            trained = sum(len(x) - x.true_count for x in held)
            vocabulary, code = np.unique(words, return_inverse=True)
            # frequent words get small numbers, which compress better; equally frequent ones stand by hash
            order = np.argsort(-np.bincount(code, minlength=len(vocabulary)), kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            cells = [number, size, trained, pa.concat_arrays(ids), pa.concat_arrays(held), packed(np.concatenate(counts)), packed_steps(vocabulary[order]), packed(rank[code])]
            lists = {3: pa.list_(pa.int64()), 4: pa.list_(pa.bool_())}
            arrays = [pa.array([x.to_pylist()], lists[i]) if i in lists else pa.array([x], pa.int64() if i < 3 else pa.binary()) for i, x in enumerate(cells)]
            return pa.RecordBatch.from_arrays(arrays, ["block", "size", "trained", "ids", "held", "words", "vocabulary", "tokens"])

        for piece in pieces(batches, "text"):
            words = Words(*text_buffer(piece.column("text")), lower=True)
            ids.append(piece.column("doc_id"))
            held.append(piece.column("held"))
            counts.append(words.count.astype(np.uint32))
            hashes.append(words.hash)
            size += len(words.hash) + len(piece)
            if size >= block_tokens:
                yield block()
                ids, held, counts, hashes, size = [], [], [], [], 0
                number += 1
        if ids:
            yield block()

    spark = docs.sparkSession
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    docs.mapInArrow(run, BLOCKS).write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return brief_shuffles(spark).table(name)


@dataclass
class Level:
    """What the driver knows of one order.

    ``tokens`` and ``types`` are training totals, ``divisor`` and ``leftover`` those of the empty history. ``frequent`` names the
    n-grams that are hot as histories of the next order, ``hot`` has a row for each of the order below: words seen 1 to 5
    times after it, and the sum of d c(h'w) over the seen ones.
    """

    discount: np.ndarray
    tokens: int
    types: int
    divisor: float
    leftover: float
    hot: np.ndarray
    frequent: np.ndarray


@dataclass
class Corpus:
    """Numbers that all blocks share: buckets, training texts, and the count above which a history is hot."""

    buckets: int
    texts: int
    hot_from: int


def discounts(times: list[int]) -> np.ndarray:
    """d(1) ... d(5) from the numbers of n-grams seen 1 to 6 times.

    Good-Turing with the discounted mass equal to that of the n-grams seen once; half a count is taken
    off instead where the counts of counts are too few or uneven for it.
    """
    k = DISCOUNTED
    n = [0, *times]
    d = []
    common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    for c in range(1, k + 1):
        good = (((c + 1) * n[c + 1] / n[c] / c) - common) / (1 - common) if n[c] and common < 1 else 0.0
        d.append(good if 0 < good < 1 else (c - 0.5) / c)
    return np.array(d)


class Vocabulary:
    """The different words of a block: order 1 of its n-grams. ``number`` has each token's word."""

    def __init__(self, block: Block):
        order = np.argsort(block.vocabulary)
        buckets = block.corpus.buckets
        bucket = in_few_bytes(mix(block.vocabulary[order]) % U(buckets), buckets)
        # by bucket and hash, so an answer needs no keys
        place = np.argsort(bucket, kind="stable")
        self.order, self.edges = order[place], np.searchsorted(bucket[place], np.arange(buckets + 1))
        self.number = places(self.order)[block.code]

    def learn(self, known: Level, answers: dict[int, dict]) -> None:
        """Words stand by their corpus-wide numbers from here on."""
        ids, count = (answered(self.edges, answers, name, np.uint32) for name in ("ids", "counts"))
        order = np.argsort(ids)
        self.number = places(order)[self.number]
        self.columns, self.count = [ids[order]], count[order]
        self.divisor = np.full(len(order), known.divisor)
        # one history; the unknown token has what the discounts left
        self.chance = np.where(self.count > 0, discounted(self.count, known) / known.divisor, known.leftover)


class Grams:
    """The different n-grams of one order in a block, by the numbers of their words.

    ``number`` has each token's n-gram and ``at`` a token of each n-gram. Histories are runs of n-grams: ``run`` has the
    run of each n-gram, ``heads`` the first n-gram, ``histories`` the words and ``total`` the training tokens of each run.
    Requests and answers take the n-grams in ``order``, by bucket and number; there ``parts`` numbers the runs
    (a hot one has a part in many buckets) and ``part_run`` has the run of each part.
    """

    def __init__(self, block: Block):
        corpus, words, below = block.corpus, block.orders[0], block.orders[-1]
        key = (block.before(below.number.astype(np.uint64) + U(1), U(0)) << U(32)) | words.number.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        self.number = np.empty(len(key), dtype=np.int32)
        self.number[order] = np.cumsum(new, dtype=np.int32) - 1
        self.at, key = order[new].astype(np.int32), key[new]
        del order
        self.words = words.columns[0][key.astype(np.uint32)]
        history = (key >> U(32)).astype(np.int64) - 1
        new = np.ones(len(key), dtype=bool)
        new[1:] = history[1:] != history[:-1]
        self.heads, self.run = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
        history = history[self.heads]
        self.histories = [np.where(history < 0, np.uint32(START), x[history]) for x in below.columns]
        self.total = np.where(history < 0, corpus.texts, below.count[history].astype(np.int64))
        self.hot = self.total > corpus.hot_from
        names = named(self.histories)
        bucket = in_few_bytes(mix(names) % U(corpus.buckets), corpus.buckets)[self.run]
        spread = np.flatnonzero(self.hot[self.run]) if self.hot.any() else np.zeros(0, dtype=np.int64)
        bucket[spread] = mix(extended(names[self.run[spread]], self.words[spread])) % U(corpus.buckets)
        self.order = np.argsort(bucket, kind="stable").astype(np.int32)
        bucket, run = bucket[self.order], self.run[self.order]
        self.edges = np.searchsorted(bucket, np.arange(corpus.buckets + 1))
        new = np.ones(len(key), dtype=bool)
        new[1:] = (run[1:] != run[:-1]) | (bucket[1:] != bucket[:-1])
        self.parts, self.part_heads = np.cumsum(new, dtype=np.int32) - 1, np.flatnonzero(new)
        self.part_run = run[self.part_heads]

    @property
    def columns(self) -> list[np.ndarray]:
        """Numbers of the words of each n-gram, one column a place."""
        return [*[x[self.run] for x in self.histories], self.words]

    def learn(self, known: Level, answers: dict[int, dict], below: Vocabulary | Grams, frequent: np.ndarray) -> None:
        """``count``, ``divisor`` and ``chance`` of each n-gram; ``frequent`` names the hot histories."""
        take = lambda name, kind: answered(self.edges, answers, name, kind)
        count = take("counts", np.uint32)
        self.count = np.empty_like(count)
        self.count[self.order] = count
        divisor, backoff = self.total.astype(np.float64), np.ones(len(self.total))
        divisor[self.part_run] += take("whole", np.bool_)
        asked = self.part_run[unseen(count, self.parts, self.total[self.part_run]) & ~self.hot[self.part_run]]
        # the divisor of a history less its first word is that of the shorter n-gram which ends at the same token
        shorter = lambda runs: below.divisor[below.number[self.at[self.heads[runs]]]]
        lower = take("lower", np.float64) / shorter(asked)
        backoff[asked] = backoff_weight(self.total[asked], take("seen", np.uint32).reshape(-1, DISCOUNTED), lower, known.discount)
        hot = np.flatnonzero(self.hot)
        if len(hot):
            # hot histories lie in many buckets; their totals stand for the parts
            row = known.hot[np.searchsorted(frequent, named([x[hot] for x in self.histories]))]
            seen = row[:, :-1]
            backoff[hot] = backoff_weight(self.total[hot], seen, row[:, -1] / shorter(hot), known.discount)
            divisor[hot] = self.total[hot] + (seen.sum(axis=1) == 0)
        self.divisor = np.maximum(divisor, 1)[self.run]
        self.chance = discounted(self.count, known) / self.divisor
        new = np.flatnonzero(self.count == 0)
        self.chance[new] = backoff[self.run[new]] * below.chance[below.number[self.at[new]]]
        del self.order, self.parts, self.part_heads, self.part_run, self.total, self.hot


class Block:
    """One block's tokens and its n-grams of the answered orders."""

    def __init__(self, row: dict, levels: list[Level], corpus: Corpus):
        self.corpus = corpus
        self.ids, self.held = row["ids"], np.array([bool(x) for x in row["held"]], dtype=bool)
        self.words = unpacked(row["words"], np.uint32).astype(np.int64)
        self.vocabulary = np.append(unpacked_steps(row["vocabulary"]), END)
        ends = np.cumsum(self.words + 1) - 1
        self.first = ends - self.words
        self.code = np.full(int(ends[-1]) + 1 if len(ends) else 0, len(self.vocabulary) - 1, dtype=np.uint32)
        inside = np.ones(len(self.code), dtype=bool)
        inside[ends] = False
        self.code[inside] = unpacked(row["tokens"], np.uint32)
        self.trained = np.repeat(~self.held, self.words + 1)
        self.orders: list[Vocabulary | Grams] = []
        # popped, so that an order's answers are let go with it
        answers = {(a["level"], a["bucket"]): a for a in row.pop("answers", None) or []}
        for level, known in enumerate(levels, 1):
            mine = {b: answers.pop((of, b)) for of, b in list(answers) if of == level}
            grams = self.grams()
            if level == 1:
                grams.learn(known, mine)
                del self.code, self.vocabulary
            else:
                grams.learn(known, mine, self.orders[-1], levels[level - 2].frequent)
            self.orders.append(grams)

    def before(self, values: np.ndarray, at_start) -> np.ndarray:
        """The value of the token before each token; ``at_start`` before a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = at_start
        return out

    def grams(self) -> Vocabulary | Grams:
        """The n-grams of the next order."""
        return Grams(self) if self.orders else Vocabulary(self)

    def requests(self) -> Iterator[dict]:
        """One request of the next order for each bucket, see ``_PARTS``."""
        grams = self.grams()
        counts = np.bincount(grams.number, weights=self.trained).astype(np.uint32)
        if not self.orders:
            words = self.vocabulary[grams.order]
            for b, a, z in slices(grams.edges):
                yield {"bucket": b, "words": packed_steps(words[a:z]), "counts": packed(np.ascontiguousarray(counts[a:z]))}
            return
        below = self.orders[-1]
        shorter = below.count[below.number[grams.at[grams.order]]]
        words, counts = grams.words[grams.order], counts[grams.order]
        sizes = np.diff(np.append(grams.part_heads, len(words))).astype(np.uint32)
        hot = grams.hot[grams.part_run]
        first, *rest = [x[grams.part_run] for x in grams.histories]
        for b, a, z in slices(grams.edges):
            runs = slice(int(grams.parts[a]), int(grams.parts[z - 1]) + 1)
            yield {
                "bucket": b, "words": packed(words[a:z]), "counts": packed(counts[a:z]), "sizes": packed(sizes[runs]), "flags": packed(hot[runs]),
                "histories": [packed_steps(first[runs]), *[packed(x[runs]) for x in rest]], "shorter": packed(shorter[a:z]),
            }


def places(order: np.ndarray) -> np.ndarray:
    out = np.empty(len(order), dtype=np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def in_few_bytes(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket numbers in a type that sorts by radix where they fit."""
    return bucket.astype(np.uint16 if buckets < 2**16 else np.int64)


def slices(edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, its first place, the place after its last) of the buckets that hold any."""
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), int(edges[b]), int(edges[b + 1])


def answered(edges: np.ndarray, answers: dict[int, dict], name: str, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=kind), *[unpacked(answers[b][name], kind) for b, *_ in slices(edges)]])


def discounted(count: np.ndarray, known: Level) -> np.ndarray:
    return count * np.append(known.discount, 1.0)[np.clip(count.astype(np.int64), 1, DISCOUNTED + 1) - 1]


def unseen(count: np.ndarray, run: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Which histories with training tokens stand before an n-gram that was not seen."""
    out = np.zeros(len(total), dtype=bool)
    out[run[count == 0]] = True
    return out & (total > 0)


def backoff_weight(tokens: np.ndarray, seen: np.ndarray, lower: np.ndarray, discount: np.ndarray) -> np.ndarray:
    _, kept = history_mass(np.column_stack([tokens, seen]).astype(np.float64), discount)
    return (1 - kept) / np.maximum(1 - lower, 1e-300)


def history_mass(seen: np.ndarray, discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(divisor, mass of the seen words) of histories from (tokens, words seen 1 to 5 times).

    A history of which nothing is taken off would leave no mass for unseen words; its divisor is one more.
    """
    tokens = seen[:, 0]
    off = (seen[:, 1:] * (np.arange(1, DISCOUNTED + 1) * (1 - discount))).sum(axis=1)
    total = np.where((tokens > 0) & (off <= 0), tokens + 1, tokens)
    return total, np.where(total > 0, (tokens - off) / np.maximum(total, 1), 0.0)


#: Words and training counts of n-grams; sizes, hot flags and words of their histories; counts of the order below.
_PARTS = ["words", "counts", "sizes", "flags", "shorter"]
_REQUESTS_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("histories", pa.list_(pa.binary())), *[(n, pa.binary()) for n in _PARTS]])
REQUESTS = "bucket long, block long, histories array<binary>, " + ", ".join(f"{n} binary" for n in _PARTS)
MERGED = (
    "kind string, level int, bucket long, block long, sizes binary, histories array<binary>, words binary, counts binary, ids binary, "
    "whole binary, seen binary, lower binary, times array<long>, hot array<struct<history: long, seen: array<double>>>, frequent array<long>"
)
_MERGED_ARROW = pa.schema([
    ("kind", pa.string()), ("level", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("sizes", pa.binary()), ("histories", pa.list_(pa.binary())),
    *[(n, pa.binary()) for n in ("words", "counts", "ids", "whole", "seen", "lower")],
    ("times", pa.list_(pa.int64())), ("hot", pa.list_(pa.struct([("history", pa.int64()), ("seen", pa.list_(pa.float64()))]))),
    ("frequent", pa.list_(pa.int64())),
])
_ANSWER = ["level", "bucket", "counts", "ids", "whole", "seen", "lower"]


def times_seen(c: np.ndarray) -> list[int]:
    """Numbers of n-grams seen 1 to 6 times, of tokens and of different n-grams."""
    return [*np.bincount(c[c <= DISCOUNTED + 1], minlength=DISCOUNTED + 2)[1:].tolist(), int(c.sum()), int((c > 0).sum())]


def merge_words(asked: list[dict], corpus: Corpus) -> list[dict]:
    """Counts and numbers of one bucket's words."""
    words = [unpacked_steps(x["words"]) for x in asked]
    edges = np.cumsum([0, *map(len, words)])
    words = np.concatenate(words)
    at, of = different(words)
    c = np.bincount(of, weights=np.concatenate([unpacked(x["counts"], np.uint32) for x in asked]), minlength=len(at)).astype(np.int64)
    number = np.empty(len(c), dtype=np.uint64)
    number[np.argsort(-c, kind="stable")] = np.arange(len(c), dtype=np.uint64)
    number = number * U(corpus.buckets) + U(asked[0]["bucket"]) + U(START + 1)
    if max(number.max(), c.max()) >= 2**32:
        raise ValueError("a word's number or count does not fit 32 bits")
    ids, c32, kept = number.astype(np.uint32), c.astype(np.uint32), c > 0
    out = [{
        "kind": "model", "words": packed_steps(words[at][kept]), "counts": packed(c32[kept]), "ids": packed(ids[kept]),
        "times": times_seen(c), "hot": [], "frequent": named([number[c > corpus.hot_from]]).view(np.int64).tolist(),
    }]
    for i, x in enumerate(asked):
        mine = of[edges[i] : edges[i + 1]]
        out.append({"kind": "answer", "block": x["block"], "counts": packed(c32[mine]), "ids": packed(ids[mine])})
    return out


def merge_grams(asked: list[dict], level: int, below: Level, corpus: Corpus) -> list[dict]:
    """Counts of one bucket's n-grams of two or more words."""
    sizes = [unpacked(x["sizes"], np.uint32) for x in asked]
    heads = np.cumsum([0, *map(len, sizes)])
    edges = np.cumsum([0, *(int(n.sum()) for n in sizes)])
    every = lambda name, kind: np.concatenate([unpacked(x[name], kind) for x in asked])
    columns = [np.concatenate([unpacked_steps(x["histories"][0], np.uint32) for x in asked]).astype(np.uint64)]
    columns += [np.concatenate([unpacked(x["histories"][i], np.uint32) for x in asked]).astype(np.uint64) for i in range(1, level - 1)]
    first, number = different(columns[0])
    for column in columns[1:]:
        first, number = different((number.astype(np.uint64) << U(32)) | column)
    columns = [x[first] for x in columns]
    size = np.concatenate(sizes)
    words = every("words", np.uint32)
    at, of = different((np.repeat(number, size).astype(np.uint64) << U(32)) | words)
    owner, words = np.repeat(number, size)[at], words[at]
    c = np.bincount(of, weights=every("counts", np.uint32), minlength=len(at)).astype(np.int64)
    q = discounted(every("shorter", np.uint32)[at], below)
    sums = lambda weights: np.bincount(owner, weights=weights, minlength=len(first))
    seen = np.stack([sums(c == r) for r in range(1, DISCOUNTED + 1)], axis=1).astype(np.uint32)
    total, lower = sums(c), sums(q * (c > 0))
    whole = (total > 0) & (seen.sum(axis=1) == 0)
    kept = np.flatnonzero(c > 0)
    own = np.bincount(owner[kept], minlength=len(first)).astype(np.uint32)
    flags = every("flags", np.bool_)
    hot = np.unique(number[flags])
    frequent = c > corpus.hot_from
    names = lambda x: named([column[x] for column in columns])
    out = [{
        "kind": "model", "sizes": packed(own[own > 0]), "histories": [packed_steps(columns[0][own > 0].astype(np.uint32)), *[packed(x[own > 0].astype(np.uint32)) for x in columns[1:]]],
        "words": packed(words[kept]), "counts": packed(c[kept].astype(np.uint32)), "times": times_seen(c),
        "hot": [{"history": int(n), "seen": [*seen[i].tolist(), float(lower[i])]} for i, n in zip(hot, names(hot).view(np.int64), strict=True)],
        "frequent": extended(names(owner[frequent]), words[frequent].astype(np.uint64)).view(np.int64).tolist(),
    }]
    c32 = c.astype(np.uint32)
    for i, x in enumerate(asked):
        counts, mine = c32[of[edges[i] : edges[i + 1]]], number[heads[i] : heads[i + 1]]
        needed = unseen(counts, np.repeat(np.arange(len(mine)), sizes[i]), total[mine]) & ~flags[heads[i] : heads[i + 1]]
        out.append({
            "kind": "answer", "block": x["block"], "counts": packed(counts), "whole": packed(whole[mine]),
            "seen": packed(seen[mine[needed]].reshape(-1)), "lower": packed(lower[mine[needed]]),
        })
    return out


def merge_bucket(level: int, below: Level | None, corpus: Corpus):
    """Merges one bucket's n-grams of all blocks: a model row with its counts of counts, and an answer for each block."""

    def run(rows: pa.Table) -> pa.Table:
        asked = rows.sort_by("block").to_pylist()
        out = merge_words(asked, corpus) if level == 1 else merge_grams(asked, level, below, corpus)
        blank = dict.fromkeys(_MERGED_ARROW.names) | {"level": level, "bucket": asked[0]["bucket"]}
        return pa.Table.from_pylist([blank | x for x in out], schema=_MERGED_ARROW)

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(len(batch)):
            yield batch.slice(i, 1).to_pylist()[0]


class Model:
    """The stored count tables of all orders (``tables``), what the driver knows of each, and the blocks they came from."""

    def __init__(self, docs: DataFrame, held: Column, order: int = ORDER, block_tokens: int = BLOCK_TOKENS, bucket_tokens: int = BUCKET_TOKENS):
        text = F.coalesce("text", F.lit("")).alias("text")
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), text)
        self.blocks = block_table(rows, block_tokens)
        total, texts = (int(x or 0) for x in self.blocks.agg(F.sum("size"), F.sum("trained")).first())
        self.buckets = max(1, -(-total // bucket_tokens))
        # more than this share of the tokens have at most HOT_SHARE n-grams of an order
        self.corpus = Corpus(self.buckets, texts, max(bucket_tokens // 4, total // HOT_SHARE))
        self.tables: list[DataFrame] = []
        self.levels: list[Level] = []
        for _ in range(order):
            self._count_next()

    def answered(self) -> DataFrame:
        """Blocks with the answers of all orders so far."""
        if not self.tables:
            return self.blocks
        parts = [t.where("kind = 'answer'").select("block", *_ANSWER) for t in self.tables]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        answers = rows.groupBy("block").agg(F.collect_list(F.struct(*_ANSWER)).alias("answers"))
        return self.blocks.join(answers, "block")

    def _count_next(self) -> None:
        level, corpus, levels = len(self.levels) + 1, self.corpus, list(self.levels)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in _rows(batches):
                for request in Block(row, levels, corpus).requests():
                    cells = dict.fromkeys(_REQUESTS_ARROW.names) | {"block": row["block"]} | request
                    yield pa.RecordBatch.from_pylist([cells], schema=_REQUESTS_ARROW)

        asked = self.answered().mapInArrow(ask, REQUESTS)
        below = levels[-1] if levels else None
        merged = stored(asked.groupBy("bucket").applyInArrow(merge_bucket(level, below, corpus), MERGED), f"katz-{level}", partition="kind")
        model = merged.where("kind = 'model'")
        sums = dict(model.select(F.posexplode("times")).groupBy("pos").agg(F.sum("col")).collect())
        times = [int(sums.get(i, 0)) for i in range(DISCOUNTED + 3)]
        discount = discounts(times[: DISCOUNTED + 1])
        total, kept = history_mass(np.array([[times[-2], *times[:DISCOUNTED]]], dtype=np.float64), discount)
        hot = model.select(F.explode("hot").alias("h")).select("h.history", F.posexplode("h.seen")).groupBy("history", "pos").agg(F.sum("col").alias("n"))
        totals: dict[int, list[float]] = {}
        for history, _, n in hot.orderBy("history", "pos").collect():
            totals.setdefault(history % 2**64, []).append(n)
        held_by = [totals.get(int(n), [0.0] * (DISCOUNTED + 1)) for n in below.frequent] if below else []
        frequent = np.array([r[0] for r in model.select(F.explode("frequent")).collect()], dtype=np.int64).view(np.uint64)
        if corpus.texts > corpus.hot_from:
            frequent = np.append(frequent, named([np.full(1, START, dtype=np.uint64)] * level))
        frequent = np.sort(frequent)
        self.tables.append(merged)
        self.levels.append(Level(discount, times[-2], times[-1], max(float(total[0]), 1.0), float(1 - kept[0]), np.array(held_by), frequent))

    def scores(self) -> DataFrame:
        """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
        levels, corpus = self.levels, self.corpus

        def scored(block: Block) -> pa.RecordBatch:
            chance = np.log10(block.orders[-1].chance)[block.orders[-1].number]
            count = block.orders[0].count[block.orders[0].number]
            base = np.log10((count + 0.1) / (levels[0].tokens + 0.1 * (levels[0].types + 1)))
            sums = lambda x: np.add.reduceat(x, block.first)
            cells = [
                pa.array(block.ids, pa.int64()), pa.array(block.held), pa.array(block.words + 1), pa.array(sums((count > 0).astype(np.int64))),
                pa.array(np.full(len(block.held), levels[0].tokens, dtype=np.int64)), pa.array(sums(base)), pa.array(sums(chance)),
            ]
            return pa.RecordBatch.from_arrays(cells, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # no name holds a block while the next one is made
            for row in _rows(batches):
                yield scored(Block(row, levels, corpus))

        return self.answered().mapInArrow(
            run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )
