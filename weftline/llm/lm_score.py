"""Operator 9, LM scoring: logistic context mixing over exact byte contexts, beside a unigram base.

Model. A byte is eight binary decisions. For each of four orders, a context of the last 1 to 4 bytes and
the bits so far has its own numbers of zeros and ones seen, whatever the corpus' size. They come from
codes, a byte with the four before it, and how often each occurs in all training texts: a table of rows
that grows with the corpus, dealt to parts by the last three context bytes, so a part has all that orders
3 and 4 need. Orders 1 and 2 have at most 2^16 and 2^24 codes; they are summed up and travel with the plan.
The predictors' log-odds are mixed by weights that the bits so far select. They are learned from all parts
of the table: each part teaches a mixer online, a context seeing its counts without its own occurrence, the
parts' weights are averaged by their bytes, and the next round starts from the average. The map that refines
the mixed probability by the last byte adapts alongside, as sums that are added up. How many parts there are
follows from the training texts' bytes, and what a part teaches from its codes alone, so a score doesn't
depend on how rows are dealt to tasks. For scoring the model is frozen, so a score depends on no other text
scored before: blocks of texts ask the parts for the costs of their distinct codes.

Base. Tokens (words, then one end) are counted over all training texts. Words that a bounded sample
finds in many documents are counted in the first pass and travel with the plan; all other (document,
word) pairs are shuffled by the word's 64-bit hash as packed blocks, and each document's partial sums
come back. No word's documents are gathered in one task, and no vocabulary goes to the driver.

Ids are integers; other types are refused. Null and empty texts have one token, the end, and a model score of 0. A null id counts as the empty
text in the split. Each input row gives one row, repeated rows included; further columns are not read.
With no training rows all counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordHasher, crc_remainder, integer_key, mix, pack, random_table, release, released, released_pair, shuffle_partitions, text_bytes, unpack

ORDERS = 4
#: Parts in the shuffle of counts of low orders.
PARTS = 64
#: Training bytes for a part of the table of codes, parts at most (then they grow), and rounds of learning.
PART_BYTES, MOST_PARTS, ROUNDS = 8 << 20, 1 << 16, 3
#: Sums that one task adds up; distinct contexts that a task holds before it works them off.
FAN, HELD = 64, 1 << 20
#: Sampled documents for frequent words, and the share of them that makes a word frequent.
SAMPLE_DOCS, FREQUENT_SHARE = 3000, 0.005
#: Words that travel with the plan at most; those beyond go the other, as exact way.
FREQUENT_WORDS = 200_000
#: Bytes of text handled at once, and gathered to a block that asks for costs.
BLOCK, GATHER = 1 << 21, 8 << 20
CACHE_BITS = 22
_SPREAD = random_table(92, 1)[0]
_NO_CODES = np.zeros(0, np.uint64), np.zeros(0, np.int64)


def contexts(texts: list[bytes], orders: int = ORDERS) -> np.ndarray:
    """For each byte of the texts laid end to end: it and the four bytes before it, in a number of 40 bits."""
    data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    position = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = data.copy()
    for k in range(1, orders + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[:-k] if k <= len(data) else data[:0]
        before[position < k] = 0
        out |= before << np.uint64(8 * k)
    return out


def bit_of(code: np.ndarray, bit: int) -> np.ndarray:
    return ((code >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


class DistinctContexts:
    """Contexts of texts and how often each occurs, worked off by ``use(codes, times)`` whenever many are held."""

    def __init__(self, use: Callable[[np.ndarray, np.ndarray], None]):
        self.use, self.held, self.size = use, [], 0

    def add(self, texts: list[bytes]) -> None:
        self.held.append(np.unique(contexts(texts), return_counts=True))
        self.size += len(self.held[-1][0])
        if self.size >= HELD:
            self._merge()
            if self.size >= HELD // 2:
                self.close()

    def _merge(self) -> None:
        codes, back = np.unique(np.concatenate([c for c, _ in self.held]), return_inverse=True)
        times = np.zeros(len(codes), np.int64)
        np.add.at(times, back, np.concatenate([t for _, t in self.held]))
        self.held, self.size = [(codes, times)], len(codes)

    def close(self) -> None:
        if self.held:
            self._merge()
            self.use(*self.held[0])
        self.held, self.size = [], 0


class BitCounts:
    """Zeros and ones seen after each last byte and the bits so far: order 1, a place for every one."""

    def __init__(self):
        self.seen = np.zeros((2, 1 << 16), np.int64)

    def add(self, codes: np.ndarray, times: np.ndarray) -> None:
        for bit in range(8):
            value, at = bit_of(codes, bit), _first(codes, bit)
            for v in (0, 1):
                np.add.at(self.seen[v], at[value == v], times[value == v])


def _first(codes: np.ndarray, bit: int) -> np.ndarray:
    node = (np.uint64(1) << np.uint64(bit)) | ((codes & np.uint64(0xFF)) >> np.uint64(8 - bit))
    return ((codes & np.uint64(0xFF00)) | node).astype(np.int64)


def summed_codes(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their times."""
    if not len(codes):
        return _NO_CODES
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[heads], np.add.reduceat(times[order].astype(np.int64), heads)


def low_codes(codes: np.ndarray, times: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a lower order."""
    return summed_codes(codes & np.uint64((1 << 8 * (order + 1)) - 1), times)


class ContextCounts:
    """Exact zeros and ones of contexts: order 1 from ``BitCounts``, order 2 from ``grams``, the others from a part's codes.

    The bytes that follow a context and start with some bits are neighbours among sorted codes, so their number is a difference of running sums.
    """

    def __init__(self, seen: np.ndarray, grams: tuple[np.ndarray, np.ndarray] = _NO_CODES, codes: tuple[np.ndarray, np.ndarray] = _NO_CODES):
        self.seen = seen
        tables = [grams, low_codes(*codes, 3), codes]
        self.tables = [(k, keys, np.concatenate([[0], np.cumsum(times)])) for k, (keys, times) in enumerate(tables, 2)]

    def each_bit(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each bit the zeros and the ones of each code and order."""
        spans = []
        for k, keys, sums in self.tables:
            start = codes & np.uint64((1 << 8 * (k + 1)) - 256)
            spans.append([start, *(sums[np.searchsorted(keys, x)] for x in (start, start + np.uint64(256)))])
        for bit in range(8):
            at, value = _first(codes, bit), bit_of(codes, bit) == 1
            zeros, ones = [self.seen[0][at]], [self.seen[1][at]]
            for (_, keys, sums), span in zip(self.tables, spans, strict=True):
                start, low, high = span
                half = start + np.uint64(128 >> bit)
                middle = sums[np.searchsorted(keys, half)]
                zeros.append(middle - low)
                ones.append(high - middle)
                span[:] = np.where(value, half, start), np.where(value, middle, low), np.where(value, high, middle)
            yield np.stack(zeros, axis=1), np.stack(ones, axis=1)


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Mixer:
    """Weights gated by the bits so far, and a map that refines the result by the last byte."""

    STEPS, PRIOR = 33, 20

    def __init__(self, counts: ContextCounts | None):
        self.counts = counts
        self.weights = np.full((256, ORDERS), 0.35)
        self.map = np.tile(_squash(np.linspace(-8, 8, self.STEPS)), (256, 1))

    @classmethod
    def from_counts(cls, seen: np.ndarray) -> Mixer:
        return cls(ContextCounts(seen))

    def learned(self, state: np.ndarray) -> Mixer:
        """This mixer with the summed states of its learners."""
        if len(state) and state[-1] > 0:
            cut = self.weights.size
            self.weights = (state[:cut] / state[-1]).reshape(self.weights.shape)
            ones, all_ = state[cut: -1].reshape(2, *self.map.shape)
            self.map = (self.map * self.PRIOR + ones) / (self.PRIOR + all_)
        return self

    def mix(self, inputs: np.ndarray, codes: np.ndarray, bit: int):
        """Mixed log-odds, their gates, and the place in the map: last byte, lower cell, share of the upper one."""
        gate = ((1 << bit) | ((codes & np.uint64(0xFF)) >> np.uint64(8 - bit)).astype(np.int64)).astype(np.int64)
        mixed = (inputs * self.weights[gate]).sum(axis=1)
        at = (np.clip(mixed, -7.999, 7.999) + 8) * (self.STEPS - 1) / 16
        low = at.astype(np.int64)
        return mixed, gate, ((codes >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64), low, at - low

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """The cost in bits of each code's byte in its context."""
        out = np.zeros(len(codes))
        for bit, (zeros, ones) in enumerate(self.counts.each_bit(codes)):
            inputs = np.log((ones + 0.4) / (zeros + 0.4))
            mixed, _, last, low, share = self.mix(inputs, codes, bit)
            refined = self.map[last, low] * (1 - share) + self.map[last, low + 1] * share
            p = np.clip((_squash(mixed) + refined) / 2, 1e-5, 1 - 1e-5)
            out -= np.log2(np.where(bit_of(codes, bit) == 1, p, 1 - p))
        return out


class Learner:
    """A mixer that one part of the table teaches online, from given weights; ``state`` can be added to those of other parts.

    The order of learning follows from the codes alone, so a part always teaches the same.
    """

    RATE, BATCH, CHUNK = 0.03, 256, 1 << 16

    def __init__(self, counts: ContextCounts, weights: np.ndarray | None = None):
        self.counts, self.mixer, self.bytes = counts, Mixer(None), 0
        if weights is not None:
            self.mixer.weights = weights.copy()
        self.sums = np.zeros((2, *self.mixer.map.shape))  # ones and all, in each cell of the map
        self.moved = np.zeros_like(self.mixer.weights)

    def add(self, codes: np.ndarray, times: np.ndarray) -> None:
        order = np.argsort(mix(codes), kind="stable")
        for a in range(0, len(codes), self.CHUNK):
            rows = order[a: a + self.CHUNK]
            self._learn(codes[rows], times[rows])
        self.bytes += int(times.sum())

    def _learn(self, codes: np.ndarray, times: np.ndarray) -> None:
        sorted_ = np.argsort(codes)  # lookups of neighbours are cheap
        back = np.empty(len(codes), np.int64)
        back[sorted_] = np.arange(len(codes))
        for bit, (zeros, ones) in enumerate(self.counts.each_bit(codes[sorted_])):
            value = bit_of(codes, bit)
            # the counts without this occurrence
            inputs = np.log((np.maximum(ones[back] - value[:, None], 0) + 0.4) / (np.maximum(zeros[back] - 1 + value[:, None], 0) + 0.4))
            # the gates of a bit are its own, so bits can be worked off one after the other
            for a in range(0, len(codes), self.BATCH):
                rows = slice(a, a + self.BATCH)
                self._step(inputs[rows], codes[rows], times[rows], value[rows], bit)

    def _step(self, inputs: np.ndarray, codes: np.ndarray, times: np.ndarray, value: np.ndarray, bit: int) -> None:
        mixed, gate, last, low, share = self.mixer.mix(inputs, codes, bit)
        first, n = 1 << bit, 1 << bit
        error = times * (value - _squash(mixed))
        step = np.stack([np.bincount(gate - first, weights=error * inputs[:, k], minlength=n) for k in range(ORDERS)], axis=1)
        step /= np.maximum(np.bincount(gate - first, weights=times, minlength=n), 1)[:, None]
        self.moved[first: first + n] += step * step
        self.mixer.weights[first: first + n] += self.RATE * step / np.sqrt(self.moved[first: first + n] + 1e-6)  # smaller steps where many were made
        cell = last * self.mixer.STEPS + low
        for at, weight in ((cell, times * (1 - share)), (cell + 1, times * share)):
            np.add.at(self.sums[0].reshape(-1), at, weight * value)
            np.add.at(self.sums[1].reshape(-1), at, weight)

    @property
    def state(self) -> np.ndarray:
        return np.concatenate([self.mixer.weights.ravel() * self.bytes, self.sums.ravel(), [self.bytes]])


class Costs:
    """The costs that the table's parts gave for a block's codes."""

    def __init__(self, codes: np.ndarray, costs: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.costs = codes[order], costs[order]

    def bits(self, codes: np.ndarray) -> np.ndarray:
        return self.costs[np.searchsorted(self.codes, codes)]


class CachedScorer:
    """Bits of whole texts; the costs of contexts seen lately are kept in a direct-mapped table."""

    def __init__(self, mixer: Mixer | Costs):
        self.mixer = mixer
        self.keys = np.full(1 << CACHE_BITS, np.uint64(2**64 - 1))
        self.costs = np.zeros(1 << CACHE_BITS, np.float32)

    def __call__(self, texts: list[bytes]) -> np.ndarray:
        codes = contexts(texts)
        slot = ((codes * _SPREAD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        cost = self.costs[slot].astype(np.float64)
        missed = np.flatnonzero(self.keys[slot] != codes)
        if len(missed):
            new, back = np.unique(codes[missed], return_inverse=True)
            bits = self.mixer.bits(new).astype(np.float32)
            cost[missed] = bits[back]
            at = ((new * _SPREAD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[at], self.costs[at] = new, bits
            lost = self.keys[at] != new  # of two codes in one slot the later one stays
            self.costs[at[~lost]] = bits[~lost]
        sizes = np.array([len(t) for t in texts], np.int64)
        total = np.concatenate([[0.0], np.cumsum(cost)])
        ends = np.cumsum(sizes)
        return total[ends] - total[ends - sizes]


def _blocks(texts: list[bytes]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BLOCK):
            size += len(texts[upto])
            upto += 1
        yield slice(at, upto)
        at = upto


class BlockWords:
    """Word hashes of a block of texts and the text that each is in."""

    def __init__(self):
        self.hash = WordHasher(seed=31)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\n".join(texts)
        data = np.frombuffer(joined, np.uint8)
        starts, _ = self.hash.spans(data)
        ends = np.cumsum([len(t) + 1 for t in texts])
        return self.hash(joined), np.searchsorted(ends, starts, side="right")


def _distinct(texts: list[bytes], words: BlockWords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs in order, and how often each occurs."""
    hashes, owner = words(texts)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return owner[heads], hashes[heads], np.diff(np.append(heads, len(hashes)))


def _frequent(docs: DataFrame, total: int) -> np.ndarray:
    sample = docs if total <= SAMPLE_DOCS else docs.where(F.pmod(F.xxhash64("seq"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_DOCS / total) + 1)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = BlockWords()
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for part in _blocks(texts):
                yield pa.RecordBatch.from_arrays([pa.array(_distinct(texts[part], of)[1].view(np.int64))], names=["word"])

    least = max(8, int(min(total, SAMPLE_DOCS) * FREQUENT_SHARE))
    top = sample.select("text").mapInArrow(words, "word long").groupBy("word").count().where(F.col("count") >= least).orderBy(F.desc("count"), "word").limit(FREQUENT_WORDS).collect()
    return np.sort(np.array([r["word"] for r in top], np.int64).view(np.uint64))


def _is_in(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
    return at, (known[at] == values if len(known) else np.zeros(len(values), bool))


# First pass: counts over all training texts


def _count_map(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = BlockWords(), BitCounts()
        pairs = np.zeros(1 << 16, np.int64)
        seen, tokens, rows = np.zeros(len(frequent), np.int64), 0, 0
        for batch in batches:
            texts = text_bytes(batch.column(0))
            rows += len(texts)
            for part in _blocks(texts):
                hashes, _ = of(texts[part])
                tokens += len(hashes)
                at, hit = _is_in(hashes, frequent)
                seen += np.bincount(at[hit], minlength=len(frequent))
                pairs += np.bincount(contexts(texts[part], 1).astype(np.int64), minlength=1 << 16)
        if not rows:
            return
        met = np.flatnonzero(pairs)
        counts.add(met.astype(np.uint64), pairs[met])
        flat = counts.seen.reshape(PARTS, -1)
        blobs = [(-1, pack(np.concatenate([[tokens, rows], seen]).astype(np.int64)))]
        blobs += [(i, _sparse(flat[i])) for i in range(PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int32()), pa.array([b[1] for b in blobs], pa.binary())], names=["part", "blob"])
        del counts, blobs, flat
        release()

    return run


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return pack(np.diff(at, prepend=0).astype(np.uint32), counts[at])


def _dense(blob: bytes) -> np.ndarray:
    gaps, counts = unpack(blob)
    out = np.zeros((2 << 16) // PARTS, np.int64)
    out[np.cumsum(gaps.astype(np.int64))] = counts
    return out


def _sum_blobs(table: pa.Table) -> pa.Table:
    """One blob for those of a part: plain arrays (part below 0) or sparse counts."""
    part, task, total = table.column("part")[0].as_py(), table.column("task")[0].as_py(), 0
    for blob in table.column("blob").to_pylist():
        total = total + (unpack(blob)[0] if part < 0 else _dense(blob))
    return pa.table({"part": pa.array([part], pa.int32()), "task": pa.array([task], pa.int64()), "blob": pa.array([pack(total) if part < 0 else _sparse(total)], pa.binary())})


def _summed(texts: DataFrame, run) -> dict[int, np.ndarray]:
    """The sums of what each task of ``run`` sends, added up in rounds, so no task reads more than ``FAN`` blobs of a part."""
    sent = texts.mapInArrow(run, "part int, blob binary").withColumn("task", F.spark_partition_id().cast("long"))
    tasks = texts.rdd.getNumPartitions()
    while True:
        sent = sent.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("part", "task").applyInArrow(released(_sum_blobs), "part int, task long, blob binary")
        tasks = -(-tasks // FAN)
        if tasks <= 1:
            break
    sums: dict[int, np.ndarray] = {}
    for r in sent.collect():  # one row of a part, or a few if the plan changed its partitions
        sums[r["part"]] = sums.get(r["part"], 0) + (unpack(r["blob"])[0] if r["part"] < 0 else _dense(r["blob"]))
    return sums


# Second pass: the table of codes of all training texts, and weights and map from its parts


def _routed(codes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by parts, which the last three context bytes choose, and each part's end in it; codes stay in order in a part."""
    part = ((((codes >> np.uint64(8)) & np.uint64(0xFFFFFF)) * _SPREAD >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.cumsum(np.bincount(part, minlength=buckets))


def _pack_codes(codes: np.ndarray, *rest: np.ndarray) -> bytes:
    return pack(np.diff(codes, prepend=np.uint64(0)), *rest)


def _unpack_codes(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpack(b) for b in blobs]
    return (np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts]), np.concatenate([p[1] for p in parts])) if parts else _NO_CODES


def _code_map(buckets: int):
    """Rows (part, blob): codes of training texts and their times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: list[tuple[int, bytes]] = []

        def send(codes: np.ndarray, times: np.ndarray) -> None:
            order, ends = _routed(codes, buckets)
            codes, times = codes[order], times[order]
            ready.extend((i, _pack_codes(codes[a:b], times[a:b])) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a)

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in ready], pa.int32()), pa.array([x[1] for x in ready], pa.binary())], names=["part", "blob"])
            ready.clear()
            return out

        met = DistinctContexts(send)
        for batch in batches:
            texts = text_bytes(batch.column(0))
            for part in _blocks(texts):
                met.add(texts[part])
                if ready:
                    yield sent()
        met.close()
        if ready:
            yield sent()
        del met
        release()

    return run


def _sum_codes(table: pa.Table) -> pa.Table:
    codes, times = summed_codes(*_unpack_codes(table.column("blob").to_pylist()))
    return pa.table({"part": table.column("part")[:1], "blob": pa.array([_pack_codes(codes, times)], pa.binary())})


def _gram_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table's codes of order 2, dealt anew."""
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            codes, times = low_codes(*_unpack_codes([blob]), 2)
            group = (mix(codes) % np.uint64(PARTS)).astype(np.int64)
            out = [(g, _pack_codes(codes[group == g], times[group == g])) for g in np.unique(group).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["part", "blob"])


def _learn_map(low, weights: np.ndarray | None):
    """The sum of what the parts teach, each from the same weights and on its own, so it doesn't matter which task has which part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, grams = low.value
        total = None
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                codes, times = _unpack_codes([blob])
                learner = Learner(ContextCounts(seen, grams, (codes, times)), weights)
                learner.add(codes, times)
                total = learner.state + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pack(total)], pa.binary())], names=["part", "blob"])
        release()

    return run


# Third pass: every text


def _block_map(buckets: int):
    """Rows (block, part, blob): a block of texts at -1, and its distinct codes by the parts that have their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            seqs, train, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False), text_bytes(batch.column(2))
            ids, flags = batch.column(3).fill_null(0).to_numpy(), ~train + 2 * batch.column(3).is_null().to_numpy(zero_copy_only=False)
            for part in _blocks(texts):
                held.append((seqs[part], train[part], ids[part], flags[part], texts[part]))
                size += sum(map(len, texts[part]))
                if size >= GATHER:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)
        del held
        release()

    def send(held: list) -> pa.RecordBatch:
        seqs, train, ids, flags = (np.concatenate([h[i] for h in held]) for i in range(4))
        texts = [t for h in held for t in h[4]]
        text = pack(seqs, train.astype(np.uint8), ids, flags, np.array([len(t) for t in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8))
        codes = np.unique(np.concatenate([np.unique(contexts(h[4])) for h in held]))
        order, ends = _routed(codes, buckets)
        codes = codes[order]
        out = [(-1, text), *((i, _pack_codes(codes[a:b])) for i, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if b > a)]
        return pa.RecordBatch.from_arrays([pa.array([int(seqs[0])] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["block", "part", "blob"])

    return run


def _price(low, state: np.ndarray):
    """Rows (block, blob): the costs of the codes that each block asked a part for."""

    def run(asked: pa.Table, counted: pa.Table) -> pa.Table:
        wanted = [np.cumsum(unpack(b)[0], dtype=np.uint64) for b in asked.column("blob").to_pylist()]
        codes = np.unique(np.concatenate(wanted)) if wanted else _NO_CODES[0]
        seen, grams = low.value
        mixer = Mixer(ContextCounts(seen, grams, _unpack_codes(counted.column("blob").to_pylist()))).learned(state)
        costs = np.concatenate([np.zeros(0, np.float32), *(mixer.bits(codes[a: a + HELD // 8]).astype(np.float32) for a in range(0, len(codes), HELD // 8))])
        blobs = [_pack_codes(w, costs[np.searchsorted(codes, w)]) for w in wanted]
        return pa.table({"block": asked.column("block").cast(pa.int64()), "blob": pa.array(blobs, pa.binary())})

    return run


def _score_block(frequent: np.ndarray, weight: np.ndarray, end_weight: float, end_known: bool, known: np.ndarray, buckets: int):
    """Rows (bucket, blob). A blob: documents' rows and flags, then their pairs of word and times, then the documents whose sums it carries."""

    def send(docs: list, pairs: list) -> pa.Table:
        seq, train, tokens, known_, base, score, ids, flags = (np.array([d[i] for d in docs]) for i in range(8))
        owner, hashes, times = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        bucket = hashes % np.uint64(buckets)
        order = np.lexsort((owner, bucket))
        owner, hashes, times, bucket = owner[order], hashes[order], times[order], bucket[order]
        cuts, home = np.searchsorted(bucket, np.arange(buckets + 1)), seq % buckets
        out = []
        for b in range(buckets):
            o = owner[cuts[b]: cuts[b + 1]]
            own, count = np.unique(o, return_counts=True)
            here = np.flatnonzero(home == b)
            if len(own) or len(here):
                out.append((b, pack(np.diff(seq[own], prepend=0), train[own].astype(np.uint8), count.astype(np.uint32), hashes[cuts[b]: cuts[b + 1]], times[cuts[b]: cuts[b + 1]].astype(np.uint32), seq[here], tokens[here], known_[here], base[here], score[here], ids[here], flags[here])))
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int32()), "blob": pa.array([x[1] for x in out], pa.binary())})

    def run(block: pa.Table, priced: pa.Table) -> pa.Table:
        of, scorer = BlockWords(), CachedScorer(Costs(*_unpack_codes(priced.column("blob").to_pylist())))
        docs, pairs = [], []
        for blob in block.column("blob").to_pylist():
            seqs, train, ids, flags, sizes, data = unpack(blob)
            ends, data = np.cumsum(sizes).tolist(), data.tobytes()
            texts = [data[b - n: b] for b, n in zip(ends, sizes.tolist(), strict=True)]
            for part in _blocks(texts):
                n = len(texts[part])
                owner, hashes, times = _distinct(texts[part], of)
                at, hit = _is_in(hashes, frequent)
                base = np.bincount(owner[hit], weights=times[hit] * weight[at[hit]], minlength=n) + end_weight
                sure = np.bincount(owner[hit], weights=times[hit] * known[at[hit]], minlength=n).astype(np.int64) + int(end_known)
                tokens = np.bincount(owner, weights=times, minlength=n).astype(np.int64) + 1
                score = scorer(texts[part]) * -math.log10(2)
                pairs.append((owner[~hit] + len(docs), hashes[~hit], times[~hit]))
                docs += zip(seqs[part].tolist(), train[part].astype(bool).tolist(), tokens.tolist(), sure.tolist(), base.tolist(), score.tolist(), ids[part].tolist(), flags[part].tolist(), strict=True)
        return send(docs, pairs)

    return run


def _score_bucket(groups: int):
    """Rows (group, blob): partial sums of the documents of each group, and at -1 the number of words seen in training."""

    def run(table: pa.Table) -> pa.Table:
        return _bucket_sums(table, groups)

    return run


def _bucket_sums(table: pa.Table, groups: int) -> pa.Table:
    blobs = [unpack(b) for b in table.column("blob").to_pylist()]
    seq = np.concatenate([np.repeat(np.cumsum(b[0]), b[2]) for b in blobs]).astype(np.int64)
    train = np.concatenate([np.repeat(b[1], b[2]) for b in blobs])
    hashes, times = (np.concatenate([b[i] for b in blobs]) for i in (3, 4))
    order = np.argsort(hashes, kind="quicksort")
    same = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
    count = np.add.reduceat((times * train)[order].astype(np.int64), starts) if len(same) else np.zeros(0, np.int64)
    per = np.empty(len(hashes), np.int64)
    per[order] = np.repeat(count, np.diff(np.append(starts, len(same))))
    by = np.argsort(seq, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], seq[by][1:] != seq[by][:-1]])) if len(by) else np.zeros(0, np.int64)
    base = np.add.reduceat((times * np.log10(per + 0.1))[by], heads) if len(by) else np.zeros(0)
    sure = np.add.reduceat((times * (per > 0))[by].astype(np.int64), heads) if len(by) else np.zeros(0, np.int64)
    docs = seq[by][heads]
    h_seq, h_tokens, h_known, h_base, h_score, h_ids, h_flags = (np.concatenate([b[i] for b in blobs]) for i in range(5, 12))
    none = np.zeros(len(docs), np.int64)
    all_seq = np.concatenate([docs, h_seq])
    columns = [all_seq, np.concatenate([none, h_tokens]), np.concatenate([sure, h_known]), np.concatenate([base, h_base]), np.concatenate([np.zeros(len(docs)), h_score]), np.concatenate([none, h_ids]), np.concatenate([none, h_flags])]
    group = (mix(all_seq.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((all_seq, group))
    group, columns = group[order], [c[order] for c in columns]
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.zeros(0, np.int64)
    cuts = [*heads, len(group)]
    out = [pack(np.diff(columns[0][a:b], prepend=0), *[c[a:b] for c in columns[1:]]) for a, b in zip(cuts, cuts[1:], strict=False)]
    words = pack(np.array([(count > 0).sum()], np.int64))
    return pa.table({"group": pa.array([*group[heads].tolist(), -1], pa.int32()), "blob": pa.array([*out, words], pa.binary())})


def _sum_group(table: pa.Table) -> pa.Table:
    """(seq, n_tokens, n_known, base, score, id, flags) of each document of a group; the row -1 has the number of distinct words.

    One block carries a document's id, flags (1 held out, 2 no id) and score; in the others they are 0.
    """
    blobs = [unpack(b) for b in table.column("blob").to_pylist()]
    if table.column("group")[0].as_py() < 0:
        total = sum(int(b[0][0]) for b in blobs)
        return pa.table({"seq": pa.array([-1], pa.int64()), "n_tokens": pa.array([0], pa.int64()), "n_known": pa.array([total], pa.int64()), "base": pa.array([0.0]), "score": pa.array([0.0]), "id": pa.array([0], pa.int64()), "flags": pa.array([0], pa.int64())})
    seq = np.concatenate([np.cumsum(b[0]) for b in blobs])
    rest = [np.concatenate([b[i] for b in blobs]) for i in range(1, 7)]
    order = np.argsort(seq, kind="stable")
    seq = seq[order]
    heads = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
    return pa.table({"seq": pa.array(seq[heads], pa.int64()), **{n: pa.array(np.add.reduceat(c[order], heads)) for n, c in zip(("n_tokens", "n_known", "base", "score", "id", "flags"), rest, strict=True)}})


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; scores are log10 probabilities."""
    integer_key(docs, key)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    buckets = shuffle_partitions(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.monotonically_increasing_id().alias("seq"), (crc_remainder(F.col(key), modulus) == 0).alias("held_out"), body.alias("text"))
    size = rows.agg(F.count("*").alias("rows"), F.sum(F.when(~F.col("held_out"), F.octet_length("text"))).alias("bytes")).first()
    parts = min(MOST_PARTS, max(1, -(-(size["bytes"] or 0) // PART_BYTES)))
    frequent = _frequent(rows, size["rows"])

    training = rows.where(~F.col("held_out"))
    sums = _summed(training.select("text"), _count_map(frequent))
    head = sums.get(-1, np.zeros(2 + len(frequent), np.int64))
    words, train_rows, counted = int(head[0]), int(head[1]), head[2:]
    empty = np.zeros((2 << 16) // PARTS, np.int64)
    seen = np.concatenate([sums.get(i, empty) for i in range(PARTS)]).reshape(2, -1)
    del sums
    codes = scratch.keep(training.select("text").mapInArrow(_code_map(parts), "part int, blob binary").groupBy("part").applyInArrow(released(_sum_codes), "part int, blob binary"))
    grams = codes.mapInArrow(_gram_map, "part int, blob binary").groupBy("part").applyInArrow(released(_sum_codes), "part int, blob binary").collect()
    low = spark.sparkContext.broadcast((seen, summed_codes(*_unpack_codes([r["blob"] for r in grams]))))
    del grams
    state = np.zeros(0)
    for k in range(ROUNDS):
        state = _summed(codes, _learn_map(low, Mixer(None).learned(state).weights if k else None)).get(-1, np.zeros(0))

    blocks = scratch.keep(rows.select("seq", (~F.col("held_out")).alias("train"), "text", "id").mapInArrow(_block_map(parts), "block long, part int, blob binary"))
    priced = blocks.where("part >= 0").groupBy("part").cogroup(codes.groupBy("part")).applyInArrow(released_pair(_price(low, state)), "block long, blob binary")
    score = _score_block(frequent, np.log10(counted + 0.1), math.log10(train_rows + 0.1), train_rows > 0, counted > 0, buckets)
    sent = blocks.where("part < 0").select("block", "blob").groupBy("block").cogroup(priced.groupBy("block")).applyInArrow(released_pair(score), "bucket int, blob binary")
    sums_of = sent.groupBy("bucket").applyInArrow(released(_score_bucket(buckets)), "group int, blob binary")
    done = scratch.keep(sums_of.groupBy("group").applyInArrow(released(_sum_group), "seq long, n_tokens long, n_known long, base double, score double, id long, flags long"))
    scratch.drop(codes, blocks)
    rare = done.where("seq = -1").agg(F.sum("n_known")).first()[0] or 0
    total, distinct = words + train_rows, rare + int((counted > 0).sum()) + (train_rows > 0)
    scale = math.log10(total + 0.1 * (distinct + 1))
    bit = F.col("flags").bitwiseAND
    found = F.when(bit(F.lit(2)) == 0, F.col("id")).cast(docs.schema[key].dataType).alias(key)
    return done.where("seq >= 0").select(found, (bit(F.lit(1)) == 1).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
