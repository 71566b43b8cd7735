"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, beside brute force."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import helpers as H
from tidemark.llm import (
    cascade, chat, components, decontaminate, katz, licences, packing, probminhash, quality_cnn, queries, stage, substring_dedup, token_counts,
)

LONG = H.invented(4000, 3, 900)


def odd_texts():
    passage = H.invented(70, 5)
    return [
        None, "", " \n\t ", "one", H.invented(49, 8), H.invented(50, 8), H.invented(50, 8), passage, H.invented(30, 9) + " " + passage + "\nend é " + H.invented(9, 9),
        passage[:-3] + " z", "a " * 3000, "a " * 700, LONG, LONG + " more", "x\x1fy z " + passage, passage.upper(), "Été à la",
    ]


@pytest.fixture(scope="module")
def odd(spark):
    rows = H.documents(spark, odd_texts())
    again = H.documents(spark, [LONG], start=12)
    return rows.unionByName(again).unionByName(H.documents(spark, [LONG]).withColumn("doc_id", F.lit(None).cast("long"))).repartition(3)


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(row):
    return tuple((x is None, x) for x in row)


def test_substring_dedup_equals_brute_force(spark, odd):
    found = substring_dedup.remove_repeats(odd.withColumn("n_words", F.lit("clash")).withColumn("spans", F.lit(1)))
    mine = [(r.doc_id, r.n_words, r.n_removed, r.s) for r in found.withColumn("s", F.sha2("text", 256)).collect()]
    assert sorted(mine, key=key) == sorted(H.repeats(pairs(odd)), key=key)
    for r in found.collect():
        assert sum(s.end - s.start for s in r.spans) == r.n_removed and all(s.source < r.doc_id for s in r.spans)


def test_substring_dedup_of_shifted_and_mixed_copies(spark):
    r = random.Random(1)
    sources = [H.invented(200, k) for k in range(6)]
    texts = list(sources)
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 5)):
            w, a = r.choice(texts).split(), r.randrange(150)
            parts += w[a : a + r.randint(20, 140)]
            parts += [f"n{r.random()}"] * r.randint(0, 2)
        texts.append(" ".join(parts))
    docs = H.documents(spark, texts).repartition(4)
    found = substring_dedup.remove_repeats(docs)
    mine = [(x.doc_id, x.n_words, x.n_removed, x.s) for x in found.withColumn("s", F.sha2("text", 256)).collect()]
    assert sorted(mine) == sorted(H.repeats(pairs(docs)))


def test_substring_dedup_keeps_the_layout(spark):
    passage = H.invented(55, 2)
    docs = H.documents(spark, [passage, f"first\n\n{passage}\n last  word"])
    texts = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs, layout=True).collect()}
    assert texts == {0: passage, 1: "first\n\n\n last  word"}


@pytest.mark.parametrize("order", [1, 2, 3])
@pytest.mark.parametrize("size", [2_000_000, 400])
def test_katz_equals_dictionaries(spark, order, size):
    r = random.Random(order)
    words = [f"W{int(r.paretovariate(0.8))}" for _ in range(3000)]
    rows = [(i, i % 4 == 0, " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(150)] + [(500, False, None), (501, False, "A b " * 400)]
    model = katz.Model(spark.createDataFrame(rows, "doc_id long, h boolean, text string").repartition(3), F.col("h"), order, size, size)
    mine = {x.doc_id: (x.score, x.base_score) for x in model.scores().collect()}
    for (doc_id, _, _), expected in zip(rows, H.katz_scores([(h, t) for _, h, t in rows], order, katz.discounts), strict=True):
        assert np.allclose(mine[doc_id], expected, atol=1e-8)
    if size < 1000 and order > 1:
        assert model.buckets > 5 and len(model.levels[0].frequent)


def test_katz_odd_rows(spark, odd):
    scored = katz.Model(odd, F.col("doc_id") % 2 == 0).scores().collect()
    assert len(scored) == odd.count() and all(np.isfinite([r.score, r.base_score]).all() for r in scored)
    assert {r.n_tokens for r in scored if r.doc_id == 0} == {1}
    assert all(r.score == 0 for r in katz.Model(odd, F.lit(True)).scores().collect())


def test_registered_katz_query_uses_trigrams(spark, tmp_path):
    texts = [H.invented(60, k, kinds=12) for k in range(30)]
    H.documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    mine = {x.doc_id: (x.score, x.base_score) for x in queries.op2_katz_scores(spark, str(tmp_path)).collect()}
    rows = [(zlib.crc32(str(i).encode()) % 10 == 0, t) for i, t in enumerate(texts)]
    for i, expected in enumerate(H.katz_scores(rows, 3, katz.discounts)):
        assert np.allclose(mine[i], expected, atol=1e-8)


def test_decontamination_equals_brute_force(spark, odd):
    items = [(1, " ".join(H.invented(70, 5).split()[3:20])), (2, "One"), (3, None), (4, "..."), (10, "Été à"), (11, LONG[:200]), (12, LONG[:200])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contamination(odd.withColumn("version", F.lit(1)), bench).collect()
    mine = [(r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in found]
    assert sorted(mine, key=key) == sorted([(a, b, c, tuple(d), e) for a, b, c, d, e in H.contaminated(pairs(odd), items)], key=key)


def test_proximity_matches(spark):
    docs = decontaminate.keyed(H.documents(spark, ["zz b c rare a", "rare " + "q " * 30 + "a b c", "c b a x rare", "a b c"]))
    bench = spark.createDataFrame([(1, "a b c rare")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.proximity_matches(docs, bench, slop=4).collect()} == {0, 2}


def test_licence_scan(spark, odd):
    texts = [
        "Intro\nReleased under the MIT License.\nend", "Licensed under the Apache License, Version 2.0.", "He lost the driving test.", "All rights reserved.",
        "This work is licensed under the GNU General Public License, version 3.", "   ", None,
    ]
    docs = H.documents(spark, texts + [H.invented(30, k) for k in range(40)])
    classifier = licences.fit(docs)
    found = {(r.doc_id, r.paragraph): (r.family, r.confirmed) for r in licences.scan(docs, classifier).collect()}
    assert found == {(0, 1): ("mit", True), (1, 0): ("apache-2.0", True), (3, 0): ("reserved", True), (4, 0): ("gpl-3.0", True)}
    assert licences.scan(odd, classifier).count() == 0


MIT_HEADER = """/*
 * Permission is hereby granted, free of charge, to any person obtaining a copy
 * of this software and associated documentation files (the "Software"), to deal
 * in the Software without restriction, including without limitation the rights
 * to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
 * copies of the Software.
 */"""
BSD_HEADER = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are
# met:"""
GPL_HEADER = """REM This program is free software: you can redistribute it and/or modify
REM it under the terms of the GNU General Public License as published by
REM the Free Software Foundation, either version 3 of the License, or
REM (at your option) any later version."""


def test_wrapped_licence_headers(spark):
    code = "\n".join(H.invented(9, k) for k in range(300))
    texts = [
        MIT_HEADER, "int a;\n\n" + BSD_HEADER.replace("\n", "\r\n"), GPL_HEADER, f"{code}\n{MIT_HEADER}\n{code}", f"{code}\n{BSD_HEADER} {code}",
        f"{code}\nReleased under the MIT License.\n{code}", code,
    ]
    docs = H.documents(spark, texts + [H.invented(30, k) for k in range(40)])
    found = licences.scan(docs).collect()
    sure = sorted((r.doc_id, r.family, r.paragraph) for r in found if r.confirmed)
    assert sure == [(0, "mit", 1), (1, "bsd", 2), (2, "gpl-3.0", 0), (3, "mit", 301), (4, "bsd", 300), (5, "mit", 300)]
    assert not [r for r in found if not r.confirmed and r.doc_id > 4]


def test_spans_hold_a_needed_gram():
    for confirmed in (0.3, licences.CONFIRMED, 1.0):
        needed, pairs = licences.needed_grams(confirmed)
        pattern = licences.gate_pattern(needed, pairs).replace(r"[^\p{L}\p{N}]", "[^a-z0-9]").replace(r"[\p{L}\p{N}]", "[a-z0-9]")
        for line in (x for v in licences.TEMPLATES.values() for x in v):
            words = "".join(c if c.isalnum() else " " for c in line.lower()).split()
            grams = {*((w,) for w in words), *zip(words, words[1:])}
            assert sum(not {*needed} & {*g} and g not in pairs for g in grams) < confirmed * len(grams)
            assert re.search(pattern, "\n# ".join(words))
        assert confirmed != licences.CONFIRMED or not re.search(pattern, "the of and mit with this that")


def test_licence_probabilities_equal_plain_python(spark):
    docs = H.documents(spark, ["Released under the MIT License.\nfoo", "x\nLicensed under the Apache License, Version 2.0. Or not.", "All rights of the public are reserved", *[H.invented(30, k) for k in range(40)]])
    model = licences.fit(docs)
    number = {r.feature: r.number for r in model.numbers.collect()}
    found = licences.scan(docs, model).collect()
    assert len(found) >= 2
    for r in found:
        words = re.findall(r"[a-z0-9]+", r.line.lower())
        grams = {*words, *map(" ".join, zip(words, words[1:]))}
        sums = np.array(model.intercepts) + sum(np.array(model.weights[number[g]]) for g in grams if g in number)
        p = np.exp((sums - sums.max()) / model.temperature)
        p /= p.sum()
        assert model.classes[int(p[:-1].argmax())] == r.family and r.probability == pytest.approx(p[:-1].max())
        shares = {f"{r.family}/{i}": _template_share(x, grams) for i, x in enumerate(licences.TEMPLATES[r.family])}
        assert r.similarity == pytest.approx(max(shares.values())) and shares[r.template] == pytest.approx(r.similarity)


def _template_share(line, grams):
    words = re.findall(r"[a-z0-9]+", line.lower())
    own = {*words, *map(" ".join, zip(words, words[1:]))}
    return len(own & grams) / len(own)


def test_notices_in_the_sample_do_not_hide_notices(spark):
    notices = ["Distributed under the MIT License.", "This file is distributed under the MIT License."]
    docs = H.documents(spark, [*notices * 20, "\n".join(H.invented(8, k) for k in range(300)), *[H.invented(30, k) for k in range(40)]])
    taught = [r.line for r in licences.sample_lines(docs, 100).collect()]
    assert len(taught) == len(set(taught)) and sum(x in H.invented(8, k) for x in taught for k in range(300)) <= licences.LINES_A_DOCUMENT
    assert licences.examples(spark, docs, 100).where("family = 'unknown' and array_contains(grams, 'mit license')").count() == 0
    model = licences.fit(docs)
    model.least = 1.1
    assert {(r.family, r.confirmed) for r in licences.scan(docs, model).collect()} == {("mit", True)}


def test_token_counts_equal_the_library(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    strange = ["<|endoftext|>a<|END", "don't 'LL İẞ", "é \x1c \x85 ½ ٣٤", "\U0001f600中文", "Åﬁ x", "a" * 5000]
    rows = odd.unionByName(H.documents(spark, strange, start=100))
    mine = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(rows, path).collect())
    given = pairs(rows)
    counts = token_counts.plain_count(path, [t or "" for _, t in given])
    assert mine == sorted((i if i is not None else -1, len((t or "").encode()), n) for (i, t), n in zip(given, counts, strict=True))


def test_quality_network_learns_and_covers_the_whole_text(spark):
    r = random.Random(0)
    clean = [H.invented(r.randint(30, 120), k) for k in range(120)]
    junk = [" | ".join(H.invented(r.randint(30, 120), k).split()) + "!!" for k in range(120)]
    texts = [t for x in zip(clean, junk) for t in x]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(160)] + [(999, None), (1, 0)], "doc_id long, label int")
    network = quality_cnn.fit(H.documents(spark, texts), labels, steps=150)
    tried = H.documents(spark, texts[160:] + [clean[0] + " " + clean[1] * 5 + junk[0] * 30, None, ""]).withColumn("score", F.lit("clash"))
    scores = {x.doc_id: x.score for x in quality_cnn.score(tried, network).collect()}
    right = [(scores[i] >= 0.5) == (i % 2 == 0) for i in range(80)]
    assert sum(right) >= 76 and scores[80] < 0.5 and 0 <= scores[81] <= 1 and scores[81] == pytest.approx(scores[82])
    alone = quality_cnn.fit(H.documents(spark, texts), labels.where("label = 1"))
    assert all(x.score > 0.9 for x in quality_cnn.score(tried, alone).collect())


def test_network_score_does_not_depend_on_its_batch():
    network = quality_cnn.Network()
    texts = [b"", b"a", b"x" * 255, H.invented(900, 1).encode(), b"y" * 4096]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    together = network.scores(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    alone = [network.scores(np.frombuffer(t, dtype=np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def near_texts():
    base = H.invented(300, 1, 5000).split()
    texts = [" ".join(base)]
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[17 * j + 3] = f"changed{k}"
        texts.append(" ".join(w))
    short = H.invented(80, 21, 5000).split()
    r = random.Random(9)
    for k in range(45):  # one group of many sizes of change, beyond a small bucket
        w = list(short)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(80)] = f"other{k}"
        texts.append(" ".join(w))
    other = H.invented(200, 2, 5000)
    return [*texts, other, other, other + "  ", None, "", "one two", "one two", "one", "line of a text " * 40, "line of a text " * 40 + "end", H.invented(90, 6)]


def test_near_duplicates_equal_brute_force(spark):
    docs = H.documents(spark, near_texts()).repartition(3)
    docs = docs.unionByName(docs.where("doc_id = 3")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("class_id", F.lit("clash"))
    found = probminhash.near_duplicates(docs).collect()
    assert len(found) == docs.where("doc_id is not null").count()
    assert {r.doc_id: r.class_id for r in found} == H.classes(pairs(docs))


def test_signatures_estimate_probability_jaccard():
    texts = [t for t in near_texts() if t]
    words = probminhash.Words(*_buffer(texts))
    text, value, weight = probminhash.weighted_shingles(words)
    many = probminhash.signatures(text, value, weight, len(texts), registers=4096)
    for a in range(0, len(texts), 3):
        for b in range(a):
            assert abs((many[a] == many[b]).mean() - H.probability_jaccard(H.shingles(texts[a]), H.shingles(texts[b]))) < 0.05


def _buffer(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))).astype(np.int64)


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (3, 2)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(30)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chat_round_trip(spark):
    texts = ["hi", "a\\b # <x> </turn>\n### assistant: no", "", None, "<sep>", "\\", "\\\\#", "é\n\n"]
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(texts)] + [(1, 20, "assistant", "one"), (1, 21, "assistant", "two")]
    rows += [(2, 0, "odd: role\\#", "x"), (2, 0, None, "y"), (None, None, "user", "z"), (3, 5, "user", "same"), (3, 5, "user", "same")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    formatted = chat.format_conversations(table)
    read = formatted.select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("l"))
    got = {r.conv_id: ([(x.role, x.text) for x in r.t], r.l) for r in read.collect()}
    first = [(r or "unknown", t or "") for c, _, r, t in rows if c == 1]
    assert got[1] == (first, "".join(t for r, t in first if r == "assistant"))
    assert sorted(got[2][0]) == [("odd: role\\#", "x"), ("unknown", "y")] and got[None] == ([("user", "z")], "") and len(got[3][0]) == 2
    assert "one<sep>two" in {r.conv_id: r.formatted for r in formatted.collect()}[1]


def test_packing_places_every_piece_once(spark, odd):
    r = random.Random(4)
    docs = spark.createDataFrame([(i, r.choice([0, 1, 3, 500, 512, 513, 1500, 8192, 8193, 40000, r.randint(1, 3000)])) for i in range(900)] + [(5, 7), (5, 7), (None, 9), (9999, None)], "doc_id long, n long")
    packed = packing.pack(docs, F.col("n"), shard_pieces=200).collect()
    bins = {}
    for p in packed:
        bins.setdefault((p.shard, p.bin), []).append(p)
    for members in bins.values():
        members.sort(key=lambda p: p.offset)
        assert [p.offset for p in members] == [sum(q.length for q in members[:k]) for k in range(len(members))]
        used, capacity = sum(p.length for p in members), members[0].capacity
        assert capacity == min(x for x in packing.LENGTHS if x >= used) and {p.capacity for p in members} == {capacity}
    total = docs.agg(F.sum("n")).first()[0]
    assert sum(p.length for p in packed) == total and len({(p.doc_id, p.piece) for p in packed if p.doc_id not in (5, None)}) == len([p for p in packed if p.doc_id not in (5, None)])
    assert total / sum(m[0].capacity for m in bins.values()) > 0.9
    assert packing.pack(odd, packing.word_length()).where("doc_id in (0, 1, 2)").count() == 0


def test_best_fit_takes_the_fullest_bin():
    placed = packing.best_fit([600, 400, 500, 500, 24], lengths=[1024])
    assert placed[0][0] == placed[1][0] == placed[4][0] and placed[2][0] == placed[3][0]


def test_cascade_counts_and_verdict(spark, odd):
    rows = {r.doc_id: r for r in cascade.quality_verdicts(odd.withColumn("n_words", F.lit("clash")).where("doc_id is not null")).collect()}
    for doc_id, text in pairs(odd.where("doc_id is not null")):
        w = [x.decode() for x in H.cut(text)]
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        inside = {i + k for i, g in enumerate(grams) if g in _twice(grams) for k in range(8)}
        r = rows[doc_id]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(inside))
        assert r.base_failed == (len(w) < 20 or 100 * len(inside) > 30 * len(w)) and not (r.base_failed and r.kept)


def _twice(grams):
    seen, twice = set(), set()
    for g in grams:
        (twice if g in seen else seen).add(g)
    return twice


def test_cascade_order_goes_by_rejection_per_cost(spark):
    a, b, c = (cascade.Rule(n, lambda: F.lit(False)) for n in "abc")
    assert [r.name for r in cascade.best_order([(a, 1.0, 0.1), (b, 1.0, 0.5), (c, 0.01, 0.1)])] == ["c", "b", "a"]
    rules = [cascade.Rule("odd", lambda: F.col("id") % 2 == 1), cascade.Rule("fails", lambda: F.raise_error(F.lit("asked")).isNotNull() & (F.col("id") % 2 == 1))]
    kept = spark.range(6).where("id % 2 = 1").select(cascade.cascade(rules).alias("k")).collect()
    assert not any(r.k for r in kept)  # the second rule would raise if it were asked


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    import public_tokenizers

    assert substring_dedup.remove_repeats(none).count() == 0 and probminhash.near_duplicates(none).count() == 0
    assert katz.Model(none, F.lit(False)).scores().count() == 0 and packing.pack(none, packing.word_length()).count() == 0
    assert cascade.quality_verdicts(none).count() == 0 and licences.scan(none).count() == 0
    assert token_counts.token_counts(none, public_tokenizers.path(queries.WORD_TOKENIZER)).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(odd, bench).where("contaminated or n_hit > 0").count() == 0
    assert quality_cnn.score(none, quality_cnn.Network()).count() == 0
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_pipeline_stages_take_effect(spark, tmp_path):
    passage, item = H.invented(60, 11), H.invented(40, 12)
    good = [H.invented(120, 100 + k, 5000) for k in range(60)]
    junk = [" | ".join(H.invented(60, 200 + k).split()) for k in range(60)]
    texts = [*good, *junk, good[0] + " tail", "own start " + H.invented(80, 13, 5000) + "\n" + passage, H.invented(80, 14, 5000) + " " + passage, H.invented(50, 15) + " " + item]
    docs = H.documents(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    folder, kept = str(tmp_path), []
    for name, step in corpus_pipeline.STAGES:
        docs = stage.stored(step(spark, docs, folder), name)
        kept.append({r.doc_id for r in docs.collect()})
        if name != "best_fit_packing":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "substring_dedup":
            assert passage in docs.where("doc_id = 121").first().text and passage not in docs.where("doc_id = 122").first().text
    assert len(kept[0] & set(range(60))) >= 57 and len(kept[0] & set(range(60, 120))) <= 3
    assert kept[1] == kept[0] - {120} and kept[2] == kept[1] and kept[3] == kept[2] - {123} and kept[4] == kept[3]
