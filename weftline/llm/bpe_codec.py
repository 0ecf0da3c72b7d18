"""Operator 2, BPE encoding and decoding: merge rounds over one flat numpy array.

All new words of a batch are laid out as symbols in one array. In each round the ranks of all
adjacent pairs are found by binary search over the sorted pair keys, every word merges the occurrences
of its lowest-ranked pair, and finished words leave the array. Decoding looks each id up and joins as
the library does for a file without a decoder.

Null and empty texts have no ids; the hashes are then those of the empty string. Texts are encoded
whole. Each input row gives one row, repeated rows included. Further columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import pieces, release, text_bytes
from weftline.llm.token_counts import byte_letters

#: Words in the cache of a Python worker, and symbols in one round's array.
CACHE_WORDS = 300_000
FLAT_SYMBOLS = 500_000
_NONE = np.int64(2**62)


class FlatMerger:
    """Encodes many words at once. ``symbols``: id of each byte inside a word, then of each byte that ends one."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, symbols: np.ndarray):
        order = np.argsort(pairs)
        self.keys, self.ranks, self.merged, self.symbols = pairs[order], order.astype(np.int64), merged, symbols

    def encode(self, words: list[bytes]) -> list[np.ndarray]:
        out: list = [None] * len(words)
        at = 0
        while at < len(words):
            upto, size = at, 0
            while upto < len(words) and (upto == at or size + len(words[upto]) <= FLAT_SYMBOLS):
                size += len(words[upto])
                upto += 1
            out[at:upto] = self._rounds(words[at:upto])
            at = upto
        return out

    def _rounds(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words)), lengths)
        last = np.concatenate([word[1:] != word[:-1], [True]]) if len(word) else np.zeros(0, bool)
        flat = self.symbols[last.astype(np.int64), np.frombuffer(b"".join(words), np.uint8)]
        out: list = [np.zeros(0, np.int64)] * len(words)
        while len(flat):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            keys = (flat << 20)[:-1] | flat[1:] if len(flat) > 1 else np.zeros(0, np.int64)
            rank = np.full(len(flat), _NONE)
            if len(keys):
                found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                hit = (self.keys[found] == keys) & (word[1:] == word[:-1])
                rank[:-1][hit] = self.ranks[found[hit]]
            best = np.minimum.reduceat(rank, starts)
            size = np.diff(np.concatenate([starts, [len(flat)]]))
            done = best == _NONE
            for k in np.flatnonzero(done):
                out[word[starts[k]]] = flat[starts[k]: starts[k] + size[k]]
            if done.all():
                break
            keep = np.repeat(~done, size)
            low = (rank == np.repeat(best, size)) & keep
            if (low[1:] & low[:-1]).any():  # a run of one symbol: every other pair of it
                index = np.arange(len(low))
                begins = low & ~np.concatenate([[False], low[:-1]])
                low &= (index - np.maximum.accumulate(np.where(begins, index, 0))) % 2 == 0
            at = np.flatnonzero(low)
            flat[at] = self.merged[rank[at]]
            keep[at + 1] = False
            flat, word = flat[keep], word[keep]
        return out


class Codec:
    """Encodes and decodes as the tokenizers library with a word-end BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ids = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64)
        letters = byte_letters()
        symbols = np.array([[vocab[c] for c in letters], [vocab[c + end] for c in letters]], np.int64)
        self.merger = FlatMerger(ids[:, 0] << 20 | ids[:, 1], np.array([vocab[a + b] for a, b in merges], np.int64), symbols)
        split = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.words = regex.compile(split).findall
        self.spaces = regex.compile(r"\s+")
        self.known: dict[str, tuple[int, str, str]] = {}

    def normalise(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.spaces.sub(" ", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves."""
        if not any(s in text for s in self.special):
            return self.words(self.normalise(text))
        parts = self.at_special.split(text)
        return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self.words(self.normalise(p)))]

    def learn(self, words: set[str]) -> None:
        """Puts words that are not known yet through the merge rounds."""
        new = sorted(w for w in words if w not in self.known)
        for w in [w for w in new if w in self.special]:
            self.known[w] = (1, str(self.special[w]), w)
        new = [w for w in new if w not in self.special]
        for w, ids in zip(new, self.merger.encode([w.encode() for w in new]), strict=True):
            ids = ids.tolist()
            self.known[w] = (len(ids), " ".join(map(str, ids)), self.decode(ids))

    def forget(self) -> None:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w][1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) and, if asked for, token_ids of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(tokenizer)
        for batch in batches:
            for piece in pieces(batch):
                yield _encoded(code, piece.column(0), text_bytes(piece.column(1)), key, with_ids)
        code.known.clear()
        release()

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, schema)


def _encoded(code: Codec, keys: pa.Array, texts: list[bytes], key: str, with_ids: bool) -> pa.RecordBatch:
    code.forget()
    split = [code.split(t.decode()) for t in texts]
    code.learn(set().union(*split))
    counts, hashes, decoded, ids = [], [], [], []
    for words in split:
        found = [code.known[w] for w in words]
        joined = " ".join([f[1] for f in found])
        counts.append(sum([f[0] for f in found]))
        hashes.append(sha256(joined.encode()).hexdigest())
        decoded.append(sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
        if with_ids:
            ids.append(np.array(joined.split(), np.int32))
    arrays = [keys, pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
    if with_ids:
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))))
    return pa.RecordBatch.from_arrays(arrays, names=[key, "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 + with_ids])
