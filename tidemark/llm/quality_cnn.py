"""Quality score of whole documents by a byte-level convolutional network in numpy.

The bytes of a document are embedded; a first layer of learned filters sees 16 bytes every 8 bytes, and
next to them two channels say how well the last bytes repeat at one short or one long distance. A second layer
sees four neighbouring places. Its outputs are max-pooled over overlapping chunks of 512 bytes, every
256 bytes, that cover the whole document; the largest and the mean chunk values give one probability.

``fit`` trains on at most ``sample_rows`` labelled rows of each class, taken in hash order of the id, of
at most ``sample_bytes`` bytes each; only these reach the driver. Scoring runs over all rows in Arrow
batches with the weights (some 60 KB) in the task.

Defined results: a null text counts as empty and gets the score of an empty text; repeated rows are
scored each; null ids are scored too; rows whose label is null or neither 0 nor 1 teach nothing; with
labels of one class or none every score is that class's share (0.5 without labels); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import pieces, text_buffer

STEP, BLOCK = 8, 32
DIMENSIONS, FIRST, SECOND, REACH = 8, 24, 32, 4
SHORT_LAGS, LONG_LAGS = range(2, 33), range(33, 129)
CHANNELS = FIRST + 2
SAMPLE_ROWS, SAMPLE_BYTES, STEPS, BATCH = 1500, 32_768, 600, 24


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with zeros behind each text, first block of each text and the end, places that belong to a text)."""
    size = np.diff(offsets)
    places = np.maximum(1, -(-size // STEP))
    # at least 128 zero bytes between texts, so that no lag and no filter reaches another text
    blocks = -(-(places + 16) // BLOCK)
    first = np.concatenate(([0], np.cumsum(blocks)))
    out = np.zeros(first[-1] * BLOCK * STEP, dtype=np.uint8)
    shift = np.repeat(first[:-1] * BLOCK * STEP - offsets[:-1], size)
    out[np.arange(len(data)) + shift] = data
    inside = np.arange(first[-1] * BLOCK) - np.repeat(first[:-1] * BLOCK, blocks * BLOCK) < np.repeat(places, blocks * BLOCK)
    return out, first, inside


def repetition(data: np.ndarray, lags: range, width: int) -> np.ndarray:
    """Per place: the largest share of the ``width`` x 8 bytes from there that equal the byte one lag before."""
    places = len(data) // STEP
    best = np.zeros(places, dtype=np.float32)
    filled = data != 0
    same = np.zeros(len(data), dtype=np.uint8)
    for lag in lags:
        same[:lag] = 0
        np.logical_and(data[lag:] == data[:-lag], filled[lag:], out=same[lag:].view(bool))
        counts = (same.view(np.uint64) * np.uint64(0x0101010101010101)) >> np.uint64(56)
        total = np.concatenate(([0], np.cumsum(counts.astype(np.int32))))
        share = (total[width:] - total[:-width]).astype(np.float32) / (width * STEP)
        np.maximum(best[: len(share)], share, out=best[: len(share)])
    return best


def inputs(data: np.ndarray) -> np.ndarray:
    return np.stack((repetition(data, SHORT_LAGS, 8), repetition(data, LONG_LAGS, 16)), axis=1) * 4 - 2


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "byte": draw(256, DIMENSIONS, scale=0.5),
            "near": draw(STEP * DIMENSIONS, FIRST, scale=0.1), "far": draw(STEP * DIMENSIONS, FIRST, scale=0.1), "b1": np.zeros(FIRST, np.float32),
            "w2": draw(REACH, CHANNELS, SECOND, scale=0.15), "b2": np.zeros(SECOND, np.float32),
            "w": draw(2 * SECOND, scale=0.1), "b": np.zeros(1, np.float32),
        }
        self.p["byte"][0] = 0
        self.prior = np.float32(0)

    def forward(self, data: np.ndarray, first: np.ndarray, inside: np.ndarray, keep: bool = False):
        p, n = self.p, len(inside)
        rows = p["byte"][data].reshape(n, STEP * DIMENSIONS)
        h1 = np.zeros((n + REACH, CHANNELS), dtype=np.float32)
        far = rows @ p["far"]
        z1 = rows @ p["near"] + p["b1"]
        z1[:-1] += far[1:]
        np.maximum(z1, 0, out=h1[:n, :FIRST])
        h1[:n, FIRST:] = inputs(data)
        z2 = sum(h1[k : n + k] @ p["w2"][k] for k in range(REACH)) + p["b2"]
        h2 = np.maximum(z2, 0) * inside[:, None]
        block = h2.reshape(-1, BLOCK, SECOND).max(axis=1)
        follows = np.ones(len(block), dtype=bool)
        follows[first[1:] - 1] = False
        after = np.zeros_like(block)
        after[:-1] = block[1:]
        chunk = np.where(follows[:, None], np.maximum(block, after), block)
        size = np.diff(first).astype(np.float32)[:, None]
        features = np.concatenate((np.maximum.reduceat(chunk, first[:-1]), np.add.reduceat(chunk, first[:-1]) / size), axis=1)
        logit = features @ p["w"] + p["b"][0]
        return (logit, features, rows, h1, h2, block, after, chunk, follows, size) if keep else logit

    def gradients(self, data, first, inside, target):
        p, n = self.p, len(inside)
        logit, features, rows, h1, h2, block, after, chunk, follows, size = self.forward(data, first, inside, keep=True)
        d = (1 / (1 + np.exp(-logit)) - target) / len(target)
        g = {"w": features.T @ d, "b": np.array([d.sum()], np.float32)}
        df = np.outer(d, p["w"]).astype(np.float32)
        owner = np.repeat(np.arange(len(target)), np.diff(first))
        top = chunk == features[owner, :SECOND]
        share = np.maximum(np.add.reduceat(top.astype(np.float32), first[:-1]), 1)
        dc = top * (df[:, :SECOND] / share)[owner] + (df[:, SECOND:] / size)[owner]
        here = ~follows[:, None] | (block >= after)
        db = dc * here
        db[1:] += (dc * ~here)[:-1]
        cube = h2.reshape(-1, BLOCK, SECOND)
        at = cube.argmax(axis=1)
        dz2 = np.zeros_like(cube)
        i, j = np.indices(at.shape)
        dz2[i, at, j] = db * (block > 0)
        dz2 = dz2.reshape(n, SECOND)
        g["b2"] = dz2.sum(axis=0)
        g["w2"] = np.stack([h1[k : n + k].T @ dz2 for k in range(REACH)])
        dh1 = np.zeros_like(h1)
        for k in range(REACH):
            dh1[k : n + k] += dz2 @ p["w2"][k].T
        dz1 = dh1[:n, :FIRST] * (h1[:n, :FIRST] > 0)
        g["b1"], g["near"] = dz1.sum(axis=0), rows.T @ dz1
        g["far"] = rows[1:].T @ dz1[:-1]
        dr = dz1 @ p["near"].T
        dr[1:] += dz1[:-1] @ p["far"].T
        flat = dr.reshape(-1, DIMENSIONS)
        g["byte"] = np.stack([np.bincount(data, weights=flat[:, k], minlength=256) for k in range(DIMENSIONS)], axis=1).astype(np.float32)
        g["byte"][0] = 0
        return g

    def train(self, texts: list[bytes], target: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on random batches with as many rows of either class."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        queues: list[list[int]] = [[], []]
        classes = [np.flatnonzero(target == c) for c in (0, 1)]
        for turn in range(1, steps + 1):
            for c, queue in enumerate(queues):
                while len(queue) < batch // 2:
                    queue += r.permutation(classes[c]).tolist()
            picked = np.array([queue.pop() for queue in queues for _ in range(batch // 2)])
            part = [texts[i] for i in picked]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int64)
            g = self.gradients(*padded(np.frombuffer(b"".join(part), dtype=np.uint8), offsets), target[picked])
            step = rate * (1 - turn / (steps + 1))
            for k in self.p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                self.p[k] -= (step * (m[k] / (1 - 0.9**turn)) / (np.sqrt(v[k] / (1 - 0.99**turn)) + 1e-6)).astype(np.float32)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        logit = self.forward(*padded(data, offsets)).astype(np.float64) + float(self.prior)
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, steps: int = STEPS) -> Network:
    """A network trained on ``labels`` (doc_id, label) whose texts stand in ``docs``."""
    taught = labels.where("label in (0, 1) and doc_id is not null").select("doc_id", "label").distinct()
    counts = dict(taught.groupBy("label").count().collect())
    network = Network()
    texts: list[bytes] = []
    target: list[int] = []
    short = docs.where(F.octet_length(F.coalesce("text", F.lit(""))) <= sample_bytes).select("doc_id", "text")
    for label in (0, 1):
        # half as many again, since some of them have no text or too long a one; at most a few thousand ids
        ids = taught.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows * 3 // 2)
        rows = short.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample_rows).collect()
        texts += [(x.text or "").encode() for x in rows]
        target += [label] * len(rows)
    got = np.array(target, dtype=np.float32)
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    if not ones or not zeros or not 0 < got.sum() < len(got):
        for k in network.p:
            network.p[k][...] = 0
        network.prior = np.float32(0 if ones == zeros else 6 if ones else -6)
        return network
    network.train(texts, got, steps)
    # batches have as many rows of either class; the scores are for the mix of all labels
    network.prior = np.float32(np.log(ones / zeros))
    return network


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with a column ``score``: the probability that the label is 1."""
    schema = T.StructType([f for f in docs.schema.fields if f.name != "score"] + [T.StructField("score", T.DoubleType())])
    plain = docs.drop("score").withColumn("_text", F.coalesce("text", F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "_text", 500_000):
            found = pa.array(network.scores(*text_buffer(piece.column("_text"))))
            kept = [n for n in piece.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in kept], found], [*kept, "score"])

    return plain.mapInArrow(run, schema)
