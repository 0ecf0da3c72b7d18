"""Operator 1, token counts: byte-pair merging with a heap over a linked list.

Words come from the tokenizer's own split pattern. In each word the adjacent pair of lowest rank is
popped again and again, and the count is the number of initial symbols less the number of merges; no
identifiers are made. A word's count is kept in a bounded cache, so a frequent word is merged once.

Null and empty texts count 0 tokens and 0 bytes. Texts of any length are processed whole. Each input
row gives one row, repeated rows included. Further columns are not read; a column named like one of
the results is left out.
"""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, text_bytes

#: The split of byte-level BPE; a fixed value of the vocabulary.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words in the cache of a Python worker.
CACHE_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = {b: chr(b) for b in plain}, 0x100
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class HeapMerger:
    """Counts what is left of a word's symbols after all merges."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks = ranks

    def count(self, symbols: list[str]) -> int:
        size = left = len(symbols)
        rank = self.ranks.get
        heap = [(r, i) for i in range(size - 1) if (r := rank((symbols[i], symbols[i + 1]))) is not None]
        if not heap:
            return size
        heapq.heapify(heap)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        while heap:
            r, i = heapq.heappop(heap)
            if symbols[i] is None or (j := after[i]) >= size or rank((symbols[i], symbols[j])) != r:
                continue  # one of the two has been merged meanwhile
            symbols[i] += symbols[j]
            symbols[j] = None
            after[i] = k = after[j]
            left -= 1
            if k < size:
                before[k] = i
                if (r := rank((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := rank((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return left


class WordCounts(dict):
    """The number of tokens of each word, found when first asked for."""

    def __init__(self, merger: HeapMerger):
        self.merger = merger

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        n = self[word] = self.merger.count(list(word.encode().decode("latin-1")))
        return n


class TokenCounter:
    """n_tokens of a text as the tokenizers library counts them for a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        to_byte = {letter: chr(b) for b, letter in enumerate(byte_letters())}
        merges = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        ranks = {(a.translate(t), b.translate(t)): i for t in [str.maketrans(to_byte)] for i, (a, b) in enumerate(merges)}
        special = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.markers = special
        self.words = WordCounts(HeapMerger(ranks))
        self.split = regex.compile(SPLIT)

    def __call__(self, text: str) -> int:
        if self.special is not None and any(m in text for m in self.markers):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split.findall(text)))


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row of ``docs``; ``tokenizer`` is a file's path."""

    def make():
        count = counter(tokenizer)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = text_bytes(batch.column(1))
            tokens = [count(t.decode()) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

        return each

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, F.col(text).cast("string")), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", make)
