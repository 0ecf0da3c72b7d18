"""Operator 4, quality classifier: compression with dictionaries of good and of bad text.

Two zstandard dictionaries are trained on labelled texts. A text is compressed with either, block by
block so that the dictionary counts throughout; the difference of the two sizes over the text's size,
and a logistic curve fitted on labelled texts that trained no dictionary, give the score.

The fit uses a bounded sample: at most ``PER_LABEL`` texts of each label and ``MAX_BYTES`` bytes a text.
Rows are held out where crc32 of the id as text leaves ``held_remainder``; they are never learned from.
All texts are scored whole. Null and empty texts have no difference and get the curve's value at 0. If
the sample lacks a label, the score is the sample's share of label 1 (one half without any sample). A
null id counts as the empty text in the split; each input row gives one row; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import crc_remainder, map_batches, text_bytes
from weftline.llm.labelled import fit_logistic, labelled_sample, sigmoid

PER_LABEL, MAX_BYTES = 1200, 32_768
BLOCK, DICTIONARY_BYTES, LEVEL = 1024, 65_536, 3


def dictionary(texts: list[bytes]) -> bytes:
    """A zstandard dictionary; where training has too little text, the text itself is one."""
    pieces = [t[i: i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\n" * 8


@lru_cache(maxsize=1)
def compressors(*contents: bytes) -> list[zstandard.ZstdCompressor]:
    """A compressor for each dictionary: native memory, so a Python worker holds one set over all its tasks."""
    out = []
    for content in contents:
        held = zstandard.ZstdCompressionDict(content)
        held.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False))
    return out


@dataclass
class CompressionClassifier:
    good: bytes
    bad: bytes
    slope: float = 0.0
    bias: float = 0.0

    def difference(self, text: bytes) -> float:
        """Bytes that the bad dictionary needs beyond the good one, over the text's bytes."""
        if not text:
            return 0.0
        bad, good = compressors(self.bad, self.good)
        return sum(len(bad.compress(part)) - len(good.compress(part)) for part in (text[i: i + BLOCK] for i in range(0, len(text), BLOCK))) / len(text)

    def score(self, text: bytes) -> float:
        return float(sigmoid(self.slope * self.difference(text) + self.bias))


def fit(sample: list[tuple[str, int]]) -> CompressionClassifier:
    """Dictionaries from two thirds of the sample, the curve from the rest."""
    texts = {v: [t.encode() for t, label in sample if label == v and t] for v in (0, 1)}
    if not texts[0] or not texts[1]:
        share = len(texts[1]) / max(1, len(texts[0]) + len(texts[1])) if sample else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return CompressionClassifier(b"\n" * 8, b"\n" * 8, 0.0, float(np.log(share / (1 - share))))
    learn = {v: t[: max(1, len(t) * 2 // 3)] for v, t in texts.items()}
    rest = {v: t[len(learn[v]):] or t for v, t in texts.items()}
    model = CompressionClassifier(dictionary(learn[1]), dictionary(learn[0]))
    x = np.array([[model.difference(t)] for v in (0, 1) for t in rest[v]])
    y = np.array([v for v in (0, 1) for _ in rest[v]])
    model.slope, model.bias = map(float, fit_logistic(x * 100, y) * [100, 1])
    return model


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", modulus: int = 3, held_remainder: int = 1) -> DataFrame:
    """(key, held_out, score, predicted) of every row."""
    model = fit(labelled_sample(docs, labels, label, modulus, held_remainder, {0: PER_LABEL, 1: PER_LABEL}, MAX_BYTES, key, text))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = [model.score(t) for t in text_bytes(batch.column(2))]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], names=[key, "held_out", "score", "predicted"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(key, (crc_remainder(F.col(key), modulus) == held_remainder).alias("held_out"), F.col(text).cast("string"))
    return map_batches(rows, f"`{key}` {kind}, held_out boolean, score double, predicted int", make)
