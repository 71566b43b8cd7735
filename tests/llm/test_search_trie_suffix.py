"""Ranked search, prefix tries and byte dedup beside brute force, over nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import lexical_search, prefix_trie, queries, suffix_array

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text) -> list[bytes]:
    return [w.lower() for w in TERM.findall((text or "").encode())]


def best_documents(docs, items, best=10):
    cut = [(i, terms(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in cut), sum(len(w) for _, w in cut)
    held = Counter(t for _, w in cut for t in set(w))
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(terms(t))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc_id, w in cut:
            times = Counter(w)
            m = 10 + (90 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * held[t] + 1))) * (10**9 * times[t] // (1000 * times[t] + 8 * m)) for t in asked if times[t])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item, r, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(scores)[:best], 1)]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("small", [False, True])
def test_search_equals_brute_force(spark, monkeypatch, small):
    r = random.Random(7)
    vocabulary = [f"t{i}" for i in range(60)] + ["Été", "ÉTÉ", "x9"]
    texts = [" ".join(r.choices(vocabulary, weights=[1 / (1 + i) for i in range(63)], k=r.randint(1, 40))) for _ in range(400)]
    texts += [None, "", " .,; ", "T1 t1-T1", texts[0], texts[0], "t59 " * 3000]
    docs = [(i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[2])]
    items = [(k, " ".join(r.sample(vocabulary, r.randint(1, 9)))) for k in range(30)]
    items += [(40, None), (41, ""), (42, "nowhere at all"), (1, "t7 extra"), (None, "t2 t3"), (43, "T1, t1; t1")]
    if small:
        for name, value in (("SHARD_DOCS", 50), ("CELLS", 900), ("SEED_SHARDS", 2)):
            monkeypatch.setattr(lexical_search, name, value)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item", F.lit(1)).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    found = lexical_search.search(d, i, block_bytes=300 if small else 150_000).collect()
    assert sorted(map(tuple, found), key=key) == sorted(best_documents(docs, items), key=key)


def test_search_on_empty_tables(spark):
    docs, items = (spark.createDataFrame([], s) for s in ("doc_id long, text string", "item_id string, text string"))
    assert lexical_search.search(docs, items).collect() == []
    assert lexical_search.search(docs, spark.createDataFrame([("a", "some words")], "item_id string, text string")).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, "x")], "doc_id long, text string"), items).collect() == []


def test_double_array_holds_exactly_its_sequences():
    r = random.Random(3)
    sequences = sorted({tuple(r.randrange(9) for _ in range(r.randint(0, 6))) for _ in range(300)})
    trie = prefix_trie.DoubleArray([np.array(s, dtype=np.int64) for s in sequences])
    prefixes = {s[:d] for s in sequences for d in range(len(s) + 1)}
    assert sum(map(len, trie.levels)) == len(prefixes)
    for _ in range(500):
        s = tuple(r.randrange(9) for _ in range(r.randint(0, 6)))
        assert len(trie.walk(np.array(s, dtype=np.int64))) - 1 == max(d for d in range(len(s) + 1) if s[:d] in prefixes)


def rebuilt(rows):
    """Turns of every conversation after the openings are shared."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    order = lambda x: (x[0], x[1], hashlib.md5(f"{len(x[2])}:{x[2]}{x[3]}".encode()).digest())
    turns = {c: [t[2:] for t in sorted(x, key=order)] for c, x in own.items()}
    out = {}
    for c, x in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + x[h:]
    return out


def trie_rows(conversations):
    members = defaultdict(list)
    for c, x in conversations.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        words = len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * words
    ends = defaultdict(list)
    for c, x in conversations.items():
        ends[tuple(x)].append(c)
    return [
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items()
    ]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("shard_turns,chunk_ids", [(200_000, 4096), (6, 2), (1, 1)])
def test_trie_equals_brute_force(spark, shard_turns, chunk_ids):
    r = random.Random(5)
    rows = []
    for c in range(130):
        n = r.choice([1, 2, 3, 3, 4, 5, 6, 40 if c == 77 else 2])
        same = c % 3 == 0
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"hi there {0 if same or t == 0 else r.randrange(3)}" * (1 + t % 2)) for t in range(n)]
    rows += [(-5, 0, "user", "x"), (-5, 1, None, None), (200, None, "user", "late"), (200, 0, "user", "a"), (200, 0, "user", "a"), (200, 0, "user", "b"), (None, 0, "user", "x"), (201, 0, "", "  wide\tspace"), (202, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit("clash")).repartition(4)
    length = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    sequences = prefix_trie.grafted(prefix_trie.turn_sequences(df), 20, length, 3)
    found = prefix_trie.trie_nodes(sequences, shard_turns, chunk_ids).select(*COLUMNS).collect()
    assert sorted(map(tuple, found), key=key) == sorted(trie_rows(rebuilt(rows)), key=key)


def test_trie_without_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_nodes(prefix_trie.turn_sequences(empty)).collect() == []


def repeated_bytes(rows, window=50):
    first = {}
    for doc_id, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - window + 1):
            if doc_id is not None:
                first[b[i : i + window]] = min(doc_id, first.get(b[i : i + window], doc_id))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if doc_id is not None and first[b[i : i + window]] < doc_id:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc_id, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), kept))
    return out


@pytest.mark.parametrize("block_bytes", [2_000_000, 3000])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, block_bytes):
    r = random.Random(11)
    base = [H.invented(60, k, 50) for k in range(5)]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 400, "a" * 300 + "b" + "a" * 60, "ñandú é " * 30, "andú é " * 30, *base]
    for _ in range(50):
        parts = []
        for _ in range(r.randint(1, 5)):
            t = r.choice(texts) or ""
            a = r.randrange(max(1, len(t) - 40))
            parts.append(t[a : a + r.randint(20, 160)])
        texts.append("".join(parts))
    # many versions of one text
    for k in range(40):
        at = r.randrange(len(base[0]))
        texts.append(base[0][:at] + chr(0x4E00 + k) + base[0][at:])
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, base[1]), (None, base[2]), (-4, base[3] + "z"), (len(texts), base[0] + base[0])]
    if block_bytes < 10_000:
        monkeypatch.setattr(suffix_array, "BUCKET_KEYS", 700)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).withColumn("at", F.lit(1)).repartition(3)
    found = suffix_array.remove_repeated_bytes(df, block_bytes)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found.collect()]
    assert sorted(got, key=key) == sorted(repeated_bytes(rows), key=key)
    assert all(sum(s.end - s.start for s in x.spans) == x.n_removed for x in found.collect())


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_array.remove_repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_registered_queries_have_twins():
    assert {"op11_ranked_search", "op12_prefix_trie", "op13_suffix_array"} <= set(queries.BUILDERS) & set(queries.SQL)


@pytest.mark.parametrize("block_bytes", [2_000_000, 900])
def test_suffix_dedup_of_passages_twice_under_one_id(spark, block_bytes):
    # the passages of document 2 and 3 stand twice there, with more around them than the smaller document has
    r = random.Random(3)
    texts = [H.invented(30, k, 10**6) for k in range(12)]
    rows = [(1, "".join(texts))]
    for doc_id in (2, 3):
        for k, t in enumerate(texts):
            part = f"{r.random()} {t[r.randrange(20) : len(t) - r.randrange(20)]} {r.random()}"
            rows.append((10 * k + doc_id, f"{part}{k}" * 2))
            rows += [(10 * k + doc_id + 4, part)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = suffix_array.remove_repeated_bytes(df, block_bytes)
    got = [(x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in found.collect()]
    assert sorted(got, key=key) == sorted(repeated_bytes(rows), key=key)
