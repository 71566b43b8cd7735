"""Token counts with a whole-token shortcut.

``whole_tokens`` proves, once per vocabulary, which strings encode alone as exactly one token: the
library itself encodes every vocabulary string that is a single pre-token. A text is cut into the
library's own pre-tokens; those in the proved set count as one token, every other pre-token is given
to the library, once for each distinct string of a batch.

Defined results: a null text counts as empty (0 tokens, 0 bytes); texts of any length are counted
whole; rows keep their number and order within a partition, repeated ids included; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long"
#: Distinct chunks whose counts a worker remembers before it starts anew.
MEMORY = 400_000


class ShortcutCounter:
    """Exact counts for a tokenizer file whose pre-tokenizer is one removing split over normalized text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        split = described["pre_tokenizer"]["pretokenizers"][0]
        if split["type"] != "Split" or not split["invert"] or split["behavior"] != "Removed":
            raise ValueError("the shortcut needs a tokenizer that keeps only what its split pattern finds")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in described["added_tokens"]):
            raise ValueError("the shortcut needs added tokens that are matched as they stand")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        added = [t["content"] for t in described["added_tokens"]]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.plain_vocabulary = list(described["model"]["vocab"])
        self.suffix = described["model"].get("end_of_word_suffix") or ""
        self.normalizer = self.tokenizer.normalizer
        self.known = frozenset(self.whole_tokens())
        self.proved = len(self.known)
        self.chunks: dict[bytes, int] = {}

    def whole_tokens(self) -> list[str]:
        """Vocabulary strings that are one pre-token and encode alone as one token, proved by encoding each."""
        ended = [v.removesuffix(self.suffix) for v in self.plain_vocabulary if v.endswith(self.suffix)]
        tried = [v for v in dict.fromkeys(ended) if self.pattern.findall(v) == [v] and self.normalizer.normalize_str(v) == v]
        encoded = self.tokenizer.encode_batch(tried, add_special_tokens=False)
        return [v for v, e in zip(tried, encoded, strict=True) if len(e.ids) == 1]

    def normalized(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return self.normalizer.normalize_str(text)

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """(added tokens in the text, its pre-tokens)."""
        if self.added is None or not self.added.search(text):
            return 0, self.pattern.findall(self.normalized(text))
        parts = self.added.split(text)
        return len(parts) - 1, [p for part in parts for p in self.pattern.findall(self.normalized(part))]

    def count_pieces(self, chunks: list[str]) -> list[int]:
        """Tokens of each chunk: proved pre-tokens count one, the library merges the other distinct ones."""
        cut = [self.pieces(t) for t in chunks]
        rest = sorted({p for _, pieces in cut for p in pieces if p not in self.known})
        merged = dict(zip(rest, (len(e.ids) for e in self.tokenizer.encode_batch(rest, add_special_tokens=False)), strict=True))
        return [added + sum(1 if p in self.known else merged[p] for p in pieces) for added, pieces in cut]

    def count_batch(self, texts: list[str]) -> list[int]:
        """Tokens of each text. No pre-token and no added token spans ASCII space, so a text is counted by
        its space-separated chunks, and a chunk that stood in an earlier text is not cut again."""
        split = [t.encode().split() for t in texts]
        if len(self.chunks) > MEMORY:
            self.chunks = {}
        chunks = self.chunks
        unseen = list({c for words in split for c in words if c not in chunks})
        for at in range(0, len(unseen), 20_000):
            part = unseen[at : at + 20_000]
            chunks.update(zip(part, self.count_pieces([c.decode() for c in part]), strict=True))
        get = chunks.__getitem__
        return [sum(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def counter(path: str) -> ShortcutCounter:
    return ShortcutCounter(path)


def token_counts(docs: DataFrame, path: str, batch_chars: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every row; ``path`` names a tokenizer file present on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortcut = counter(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            counts: list[int] = []
            held, chars = [], 0
            for t in texts:
                held.append(t)
                chars += len(t)
                if chars >= batch_chars:
                    counts += shortcut.count_batch(held)
                    held, chars = [], 0
            counts += shortcut.count_batch(held)
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return read.mapInArrow(run, COUNT_SCHEMA)


def plain_count(path: str, texts: list[str]) -> list[int]:
    """What the library alone gives; used to check the shortcut."""
    return [len(e.ids) for e in counter(path).tokenizer.encode_batch(texts, add_special_tokens=False)]
