"""Columns of the input that are named like working columns or results change nothing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.llm import helpers as H
from tidemark.llm import katz, licences, packing, queries, token_counts

NAMES = (
    "version", "block", "paragraph", "last", "start", "size", "line", "words", "numbers", "family", "probability", "n_tokens", "n_bytes", "n_known", "score",
    "base_score", "train_tokens", "held_out", "held", "length", "bin", "piece", "position", "phrase", "term",
)


def rows(df, names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_clashing_columns(spark):
    import public_tokenizers

    docs = H.documents(spark, ["Released under the MIT License.\nfoo", None, "", H.invented(40, 1), H.invented(700, 2), *[H.invented(30, k) for k in range(20)]])
    clash = docs.withColumns({n: F.lit("clash") for n in NAMES})
    model = licences.fit(docs)
    names = ["doc_id", "paragraph", "family", "probability", "template", "similarity", "confirmed"]
    assert rows(licences.scan(clash, model), names) == rows(licences.scan(docs, model), names) != []
    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    names = ["doc_id", "n_bytes", "n_tokens"]
    assert rows(token_counts.token_counts(clash, path), names) == rows(token_counts.token_counts(docs, path), names) != []
    plain = packing.pack(docs, packing.word_length())
    assert sorted(map(str, packing.pack(clash, packing.word_length()).select(*plain.columns).collect())) == sorted(map(str, plain.collect())) != []
    held = F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    mine, theirs = (rows(katz.Model(d, held).scores(), names) for d in (clash, docs))
    assert [r[:4] for r in mine] == [r[:4] for r in theirs] and all(abs(a[5] - b[5]) < 1e-9 for a, b in zip(mine, theirs, strict=True))
