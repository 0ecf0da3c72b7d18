"""Operator 7, suffix-array dedup: bytes of 50-byte strings that a document of a smaller id holds too.

Sorting a suffix for every byte would shuffle fifty times the text. Suffixes are taken at anchors
instead: of the 25 26-byte leads inside a 50-byte string the least by hash is its anchor. Equal strings
have equal anchors at equal offsets, so comparing strings with the same anchor misses none.

1. Screen. The leads of all anchors are spread by hash and sorted; a document learns which of its leads
   another document has too. Leads that a bounded sample finds in many documents skip this step.
2. Suffixes. Splitters from the sample range-partition the shared suffixes by their leading bytes. A
   suffix carries the bytes that any 50-byte string around its anchor can cover. Buckets sort the suffixes
   by multikey quicksort over 8-byte characters, and the bytes before the anchors, read backwards, likewise.
   Each suffix is compared with its neighbour in both orders, byte by byte. A string that starts o bytes before
   its anchor stands where neighbours share 50 - o bytes onwards and o bytes backwards; all but those of
   the least document are marked. Equal leads are never parted by a splitter, so no string crosses a boundary.
   Strings around hot leads would make one run too long: they are spread by a 64-bit hash of their own, by which they are compared too,
   the least document of each batch goes ahead, and its rest is marked at once; so equal strings of all buckets meet.
3. Marks go back to the documents, which drop the covered bytes.

How many buckets and groups of documents there are follows from the texts' bytes, so one holds ``BUCKET_BYTES`` on
average at any size. Ids are integers; other types are refused. Null and empty texts, and texts under 50
bytes, keep all bytes. A text repeated in rows of one doc_id does not count against itself. Rows without
an id lose nothing and count for no other. Each input row gives one row; ties cannot occur, as only a
smaller id counts. Further columns are not read, and ``remove_repeats`` carries them along.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import integer_key, mix, pack, random_table, release, released, released_pair, shuffle_partitions, unpack

LENGTH, LEAD = 50, 26
_SPREAD = LENGTH - LEAD  # furthest that an anchor stands from its string's start
#: Bytes of text that are searched for anchors at once, and that a task gathers before it sends records.
BLOCK, GATHER = 1 << 17, 8 << 20
#: Suffixes whose strings are compared at once, as far as a run of equal leads allows.
COMPARED = 40_000
#: Bytes of text for a bucket, and for two groups of documents, on average.
BUCKET_BYTES = 32 << 20
#: Longest piece of one text whose positions fit the sort key.
PIECE = 1 << 22
#: Documents in the sample; share of them that makes a lead hot; leads kept for splitters.
SAMPLE_DOCS, HOT_SHARE, SPLITTER_LEADS = 3000, 0.01, 20_000
#: Leads that are treated as hot at most; those beyond go the other, as exact way.
HOT_LEADS = 200_000
_CODES = random_table(71, 256)
_BASE = int(random_table(72, 1)[0])


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 2**64))


def _doubled(data: np.ndarray, upto: int) -> dict[int, np.ndarray]:
    """Rolling hashes of lengths 1, 2, 4 ... ``upto``."""
    out = {1: _CODES[data]}
    n = 1
    while n < upto:
        h = out[n]
        out[2 * n] = h[:-n] * _power(n) + h[n:] if len(h) > n else h[:0]
        n *= 2
    return out


def _combined(by: dict[int, np.ndarray], length: int) -> np.ndarray:
    """Rolling hashes of any length from those of powers of two."""
    total, n, out = len(by[1]) - length + 1, 0, None
    for size in sorted(by, reverse=True):
        while length - n >= size:
            part = by[size][n: n + total]
            out = part.copy() if out is None else out * _power(size) + part
            n += size
    return out


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        v = np.minimum(v[:-n], v[n:])
        n *= 2
    rest = width - n
    return np.minimum(v[:-rest], v[rest:]) if rest else v


class Anchors:
    """Anchors of a block of texts laid end to end: position, first and last string, owner, hash of the lead."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(sizes) - sizes
        ends, found = self.start + sizes, []
        owner = np.repeat(np.arange(len(texts)), sizes)
        for a in range(0, max(1, len(self.data) - LENGTH + 1), PIECE):
            part = self.data[a: a + PIECE + LENGTH - 1]
            if len(part) < LENGTH:
                break
            by = _doubled(part, 32)
            lead = mix(_combined(by, LEAD))
            at = _sliding_min((lead >> np.uint64(24) << np.uint64(24)) | np.arange(len(lead), dtype=np.uint64), _SPREAD + 1)
            at = (at & np.uint64(0xFFFFFF)).astype(np.int64)
            p = np.arange(a, a + len(at))
            inside = p + LENGTH <= ends[owner[p]]
            p, at = p[inside], at[inside]
            if len(p):
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (owner[p[1:]] != owner[p[:-1]])]))
                last = np.concatenate([first[1:], [len(p)]]) - 1
                found.append((at[first] + a, p[first], p[last], owner[p[first]], lead[at[first]]))
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64)
        self.at, self.lo, self.hi, self.owner, self.lead = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, k) for i, k in enumerate(kinds))
        count = np.bincount(self.owner, minlength=len(texts))
        self.ordinal = np.arange(len(self.at)) - np.repeat(np.cumsum(count) - count, count)

    def string_hashes(self) -> np.ndarray:
        return mix(_combined(_doubled(self.data, 32), LENGTH)) if len(self.data) >= LENGTH else np.zeros(0, np.uint64)


def _blocks(sizes: list[int], limit: int) -> Iterator[slice]:
    at = 0
    while at < len(sizes):
        upto, total = at, 0
        while upto < len(sizes) and (upto == at or total + sizes[upto] <= limit):
            total += sizes[upto]
            upto += 1
        yield slice(at, upto)
        at = upto


def _is_in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    if n:
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def multikey_order(words: list[np.ndarray]) -> np.ndarray:
    """Order of rows whose characters are in ``words``: each character sorts the rows that are still equal."""
    order = np.argsort(words[0], kind="quicksort")
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = words[0][order[1:]] == words[0][order[:-1]]
    for word in words[1:]:
        if not same.any():
            break
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        group = np.cumsum(~same)[rows]
        order[rows] = order[rows][np.lexsort((word[order[rows]], group))]
        same[1:] &= word[order[1:]] == word[order[:-1]]
    return order


def _group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """The group of documents that an id belongs to; _group_column is its twin in Spark."""
    h = ids ^ (ids << 13)
    h = h ^ (h.view(np.uint64) >> np.uint64(7)).view(np.int64)
    return (h ^ (h << 17)) % groups


def _group_column(key: Column, groups: int) -> Column:
    h = key.bitwiseXOR(F.shiftleft(key, 13))
    h = h.bitwiseXOR(F.shiftrightunsigned(h, 7))
    return F.pmod(h.bitwiseXOR(F.shiftleft(h, 17)), F.lit(groups)).cast("int")


def _by_group(ids: np.ndarray, groups: int, *columns: np.ndarray) -> pa.Table:
    """Rows (group, blob): the columns, sorted by group and id, as one block for each group that occurs."""
    group = _group_of(ids, groups)
    order = np.lexsort((ids, group))
    group, ids, columns = group[order], ids[order], [c[order] for c in columns]
    heads = _runs(group)
    cuts = [*heads, len(group)]
    blobs = [pack(np.diff(ids[a:b], prepend=0), *[c[a:b] for c in columns]) for a, b in zip(cuts, cuts[1:], strict=False)]
    return pa.table({"group": pa.array(group[heads], pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _from_blobs(table: pa.Table, kinds: tuple) -> list[np.ndarray]:
    """What _by_group packed for one group, sorted by id."""
    blobs = [unpack(b) for b in table.column("blob").to_pylist()]
    if not blobs:
        return [np.zeros(0, k) for k in (np.int64, *kinds)]
    out = [np.concatenate([np.cumsum(b[0]) for b in blobs]), *[np.concatenate([b[i + 1] for b in blobs]) for i in range(len(kinds))]]
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


# Step 1: which leads stand in several documents


def _screen_map(hot: np.ndarray, buckets: int):
    def send(ids: list, leads: list, ordinals: list) -> pa.RecordBatch | None:
        if not ids:
            return None
        lead, ordinal = np.concatenate(leads), np.concatenate(ordinals)
        doc = np.repeat(np.array(ids, np.int64), [len(x) for x in leads])
        bucket = (lead >> np.uint64(40)) % np.uint64(buckets)
        order = np.lexsort((ordinal, doc, bucket))
        lead, ordinal, doc, bucket = lead[order], ordinal[order], doc[order], bucket[order]
        cuts = [*_runs(bucket), len(bucket)]
        blobs = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            heads = _runs(doc[a:b])
            own = doc[a:b][heads]
            low = lead[a:b].view(np.uint8).reshape(-1, 8)[:, :5]
            blobs.append(pack(np.diff(own, prepend=0), np.diff(np.append(heads, b - a)).astype(np.uint32), low.ravel(), np.diff(ordinal[a:b], prepend=0).astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, leads, ordinals, size = [], [], [], 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            for part in _blocks([len(t) for t in texts], BLOCK):
                found = Anchors(texts[part])
                cool = ~_is_in(found.lead, hot)
                lead, owner, ordinal = found.lead[cool], found.owner[cool], found.ordinal[cool]
                bounds = np.searchsorted(owner, np.arange(len(texts[part]) + 1))
                for i, key in enumerate(keys[part]):
                    if bounds[i + 1] > bounds[i]:
                        own, first = np.unique(lead[bounds[i]: bounds[i + 1]], return_index=True)
                        ids.append(key)
                        leads.append(own)
                        ordinals.append(ordinal[bounds[i]: bounds[i + 1]][first])
                size += sum(map(len, texts[part]))
                if size >= GATHER:
                    if out := send(ids, leads, ordinals):
                        yield out
                    ids, leads, ordinals, size = [], [], [], 0
        if out := send(ids, leads, ordinals):
            yield out
        del ids, leads, ordinals
        release()

    return run


def _screen_bucket(groups: int):
    def run(table: pa.Table) -> pa.Table:
        docs, leads, ordinals = [], [], []
        for blob in table.column("blob").to_pylist():
            own, count, low, ordinal = unpack(blob)
            wide = np.zeros((len(low) // 5, 8), np.uint8)
            wide[:, :5] = low.reshape(-1, 5)
            docs.append(np.repeat(np.cumsum(own), count))
            leads.append(wide.view(np.uint64).ravel())
            ordinals.append(np.cumsum(ordinal.astype(np.int64)).astype(np.uint32))
        doc, lead, ordinal = np.concatenate(docs), np.concatenate(leads), np.concatenate(ordinals)
        del docs, leads, ordinals
        order = np.argsort(lead, kind="quicksort")
        starts = _runs(lead[order])
        size = np.diff(np.append(starts, len(lead)))
        shared = order[np.repeat(size > 1, size)]
        return _by_group(doc[shared], groups, ordinal[shared])

    return run


# Step 2: shared suffixes


def _contents(found: Anchors, rows: np.ndarray) -> np.ndarray:
    """For each anchor the bytes from 24 before it to 50 after its start; those outside its own strings are 0."""
    padded = np.concatenate([np.zeros(_SPREAD, np.uint8), found.data, np.zeros(LENGTH, np.uint8)])
    width = _SPREAD + LENGTH
    at = found.at[rows]
    out = padded[at[:, None] + np.arange(width)]
    columns = np.arange(width)
    lo, hi = (found.lo[rows] - at + _SPREAD)[:, None], (found.hi[rows] - at + _SPREAD + LENGTH)[:, None]
    out[(columns < lo) | (columns >= hi)] = 0
    return out


def _keep_least(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Whether a record is from the least document that has its key here."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys, kind="quicksort")
    starts = _runs(keys[order])
    least = np.minimum.reduceat(docs[order], starts)
    out = np.empty(len(keys), bool)
    out[order] = docs[order] == np.repeat(least, np.diff(np.append(starts, len(keys))))
    return out


_WEIGHTS = random_table(73, _SPREAD + LENGTH + 2)


def _suffix_map(hot: np.ndarray, splitters: np.ndarray, buckets: int):
    """Sends suffixes to ranges of leads and hot strings to hashes, with marks that are certain already."""

    def send(parts: list[tuple]) -> pa.RecordBatch | None:
        if not parts:
            return None
        docs, rows_, contents, ats, los, his, h_docs, h_rows, hashes, h_ats = (np.concatenate([p[i] for p in parts]) for i in range(10))
        span = np.zeros(len(docs), np.uint64) + los.astype(np.uint64) * _WEIGHTS[-1] + his.astype(np.uint64) * _WEIGHTS[-2]
        for c in range(contents.shape[1]):
            span += _CODES[contents[:, c]] * _WEIGHTS[c]
        first, h_first = _keep_least(mix(span), docs), _keep_least(hashes, h_docs)
        leads = np.ascontiguousarray(contents[:, _SPREAD: _SPREAD + LEAD]).view(f"S{LEAD}").ravel()
        bucket = np.searchsorted(splitters, leads, side="right") % buckets
        h_bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        # a string at anchor - o is bit o of a mask, counted from the last string of the anchor
        span_mask = (np.uint32(1) << (los - his + 1).astype(np.uint32)) - np.uint32(1)
        out = []
        by, h_by = np.argsort(bucket, kind="stable"), np.argsort(h_bucket, kind="stable")
        cuts, h_cuts = np.searchsorted(bucket[by], np.arange(buckets + 1)), np.searchsorted(h_bucket[h_by], np.arange(buckets + 1))
        for b in range(buckets):
            i, j = by[cuts[b]: cuts[b + 1]], h_by[h_cuts[b]: h_cuts[b + 1]]
            if not len(i) + len(j):
                continue
            k, done, q, h_done = i[first[i]], i[~first[i]], j[h_first[j]], j[~h_first[j]]
            marks = (np.concatenate([docs[done], h_docs[h_done]]), np.concatenate([rows_[done], h_rows[h_done]]), np.concatenate([ats[done] - his[done], h_ats[h_done]]).astype(np.int64), np.concatenate([span_mask[done], np.ones(len(h_done), np.uint32)]))
            out.append((b, pack(docs[k], rows_[k], contents[k].ravel(), ats[k], los[k].astype(np.uint8), his[k].astype(np.uint8), h_docs[q], h_rows[q], hashes[q], h_ats[q], *marks)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["bucket", "blob"])

    def run(docs: pa.Table, screened: pa.Table) -> pa.Table:
        told_id, told_ordinal = _from_blobs(screened, (np.uint32,))
        parts, size, out = [], 0, []
        for batch in docs.to_batches():
            valid = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            lengths = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32)[batch.column("text").offset:][: batch.num_rows + 1])
            here = np.flatnonzero(valid & (lengths >= LENGTH))
            keys, rows = batch.column("id").fill_null(0).to_numpy()[here], batch.column("row").to_numpy()[here]
            for part in _blocks(lengths[here].tolist(), BLOCK):
                k, r = keys[part], rows[part]
                found = Anchors(batch.column("text").take(pa.array(here[part])).to_pylist())
                is_hot = _is_in(found.lead, hot)
                shared = np.zeros(len(found.at), bool)
                bounds = np.searchsorted(found.owner, np.arange(len(k) + 1))
                lo, hi = np.searchsorted(told_id, k), np.searchsorted(told_id, k, side="right")
                for i in np.flatnonzero(hi > lo):
                    own = found.lead[bounds[i]: bounds[i + 1]]
                    ordinals = told_ordinal[lo[i]: hi[i]]
                    shared[bounds[i]: bounds[i + 1]] = _is_in(own, np.unique(own[ordinals[ordinals < len(own)]]))
                cool = np.flatnonzero(shared & ~is_hot)
                at = found.at[cool]
                start = found.start[found.owner[cool]]
                hot_rows = np.flatnonzero(is_hot)
                if len(hot_rows):
                    count = found.hi[hot_rows] - found.lo[hot_rows] + 1
                    p = np.repeat(found.lo[hot_rows] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    h_owner, hashes = np.repeat(found.owner[hot_rows], count), found.string_hashes()[p]
                else:
                    p, h_owner, hashes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
                parts.append((k[found.owner[cool]], r[found.owner[cool]], _contents(found, cool), at - start, at - found.lo[cool], at - found.hi[cool], k[h_owner], r[h_owner], hashes, p - found.start[h_owner]))
                size += 74 * len(cool) + 16 * len(p)
                if size >= GATHER:
                    out.append(send(parts))
                    parts, size = [], 0
        out.append(send(parts))
        out = [x for x in out if x is not None]
        return pa.Table.from_batches(out) if out else pa.table({"bucket": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})

    return run


def _characters(columns: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as characters of eight."""
    width = -(-columns.shape[1] // 8) * 8
    padded = np.zeros((len(columns), width), np.uint8)
    padded[:, : columns.shape[1]] = columns
    return [padded.view(">u8")[:, i].astype(np.uint64) for i in range(width // 8)]


def shared_with_neighbour(columns: np.ndarray, order: np.ndarray) -> np.ndarray:
    """How many leading bytes each row of ``order`` shares with the row before it; the first has none."""
    out = np.zeros(len(order), np.int64)
    if len(order) > 1:
        rows = columns[order]
        same = rows[1:] == rows[:-1]
        out[1:] = np.where(same.all(axis=1), columns.shape[1], same.argmin(axis=1))
    return out


def _compare(docs: np.ndarray, contents: np.ndarray, los: np.ndarray, his: np.ndarray) -> np.ndarray:
    """For each suffix a mask of its strings that a smaller document's suffix holds too."""
    order = multikey_order(_characters(contents[:, _SPREAD: _SPREAD + LEAD]))
    run = np.cumsum(shared_with_neighbour(contents[:, _SPREAD: _SPREAD + LEAD], order) < LEAD)
    size = np.bincount(run)
    many = size[run] > 1
    order, run = order[many], run[many]
    out = np.zeros(len(docs), np.uint32)
    at = 0
    while at < len(order):  # whole runs, some ten thousand suffixes at a time
        upto = int(np.searchsorted(run, run[min(at + COMPARED, len(order)) - 1], side="right"))
        out[order[at:upto]] = _compare_runs(docs[order[at:upto]], contents[order[at:upto]], los[order[at:upto]], his[order[at:upto]])
        at = upto
    return out


def _compare_runs(docs: np.ndarray, contents: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The masks of some suffixes, from the neighbours in suffix order and in the order of the bytes before, read backwards."""
    sides = []
    for columns in (contents[:, _SPREAD:], contents[:, :_SPREAD][:, ::-1]):
        order = multikey_order(_characters(columns))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sides.append((place, shared_with_neighbour(columns, order)))
    (ahead, shared_ahead), (back, shared_back) = sides
    masks = np.zeros(len(docs), np.uint32)
    for o in range(_SPREAD + 1):
        here = np.flatnonzero((lo >= o) & (hi <= o))
        if len(here) > 1:
            # neighbours that share enough bytes are of one kind
            kinds = np.cumsum(shared_ahead < LENGTH - o)[ahead[here]] * np.int64(len(docs) + 1) + np.cumsum(shared_back < o)[back[here]]
            late = here[~_keep_least(kinds, docs[here])]
            masks[late] |= np.uint32(1) << (o - hi[late]).astype(np.uint32)
    return masks


def _suffix_bucket(groups: int):
    def run(table: pa.Table) -> pa.Table:
        blobs = [unpack(b) for b in table.column("blob").to_pylist()]
        docs, rows, contents, ats, los, his, h_docs, h_rows, hashes, h_ats, m_docs, m_rows, m_ats, m_masks = (np.concatenate([b[i] for b in blobs]) for i in range(14))
        del blobs
        out = [(m_docs, m_rows, m_ats, m_masks)]
        if len(hashes):
            late = ~_keep_least(hashes, h_docs)
            out.append((h_docs[late], h_rows[late], h_ats[late], np.ones(int(late.sum()), np.uint32)))
        if len(docs):
            masks = _compare(docs, contents.reshape(len(docs), -1), los, his)
            hit = masks > 0
            out.append((docs[hit], rows[hit], ats[hit].astype(np.int64) - his[hit].astype(np.int64), masks[hit]))
        docs, rows, ats, masks = (np.concatenate([x[i] for x in out]) for i in range(4))
        return _by_group(docs, groups, rows, ats.astype(np.uint32), masks)

    return run


# Step 3: what is left


def removed_spans(size: int, ats: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal removed runs of a text of ``size`` bytes; bit o of a mask is the string at its place less o."""
    bits = np.unpackbits(masks.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    row, o = np.nonzero(bits)
    p = ats[row].astype(np.int64) - o
    edges = np.bincount(p, minlength=size + 1) - np.bincount(p + LENGTH, minlength=size + 1)
    gone = np.concatenate([[False], np.cumsum(edges[:-1]) > 0, [False]])
    return np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)


_NO_SPANS = np.zeros((0, 2), np.int64)


def _spans(docs: pa.Table, marks: pa.Table) -> Iterator[tuple[int, bytes, np.ndarray]]:
    """Row number, text and removed spans of each document of a group."""
    ids, rows, ats, masks = _from_blobs(marks, (np.int64, np.uint32, np.uint32))
    keys = docs.column("id").to_pylist()
    for i, (key, row) in enumerate(zip(keys, docs.column("row").to_pylist(), strict=True)):
        text = docs.column("text")[i].as_py()
        a, b = (0, 0) if key is None else np.searchsorted(ids, [key, key + 1])
        own = np.flatnonzero(rows[a:b] == row) + a
        yield i, text, removed_spans(len(text), ats[own], masks[own]) if len(own) else _NO_SPANS


def _kept(text: bytes, spans: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in spans.tolist():
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    return b"".join(out)


def _finish(docs: pa.Table, marks: pa.Table) -> pa.Table:
    sums = []
    for _, text, spans in _spans(docs, marks):
        sums.append((len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), sha256(_kept(text, spans)).hexdigest(), spans.ravel().tolist() if len(spans) else None))
    kinds = {"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.int64())}
    return pa.table({"id": docs.column("id"), **{n: pa.array([s[i] for s in sums], k) for i, (n, k) in enumerate(kinds.items())}})


def _sampled(texts: DataFrame, total: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hot leads and splitters, from a sample of bounded size."""
    sample = texts if total <= SAMPLE_DOCS else texts.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * SAMPLE_DOCS / total) + 1)

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            for part in _blocks([len(t) for t in found], BLOCK):
                a = Anchors(found[part])
                _, rows = np.unique(a.lead + mix(a.owner.astype(np.uint64)), return_index=True)
                text = np.lib.stride_tricks.sliding_window_view(a.data, LEAD)[a.at[rows]] if len(rows) else np.zeros((0, LEAD), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(a.lead[rows].view(np.int64)), pa.array([x.tobytes() for x in text], pa.binary())], names=["lead", "text"])

    seen = sample.select("text").mapInArrow(leads, "lead long, text binary").groupBy("lead").agg(F.count("*").alias("c"), F.first("text").alias("text"))
    least = max(8, int(min(total, SAMPLE_DOCS) * HOT_SHARE))
    top = seen.where(F.col("c") >= least).orderBy(F.desc("c"), "lead").limit(HOT_LEADS).select("lead").collect()
    hot = np.sort(np.array([r["lead"] for r in top], np.int64).view(np.uint64))
    texts_ = [r["text"] for r in seen.where(F.col("c") < least).orderBy(F.xxhash64("lead")).limit(SPLITTER_LEADS).select("text").collect()]
    ordered = np.sort(np.array(texts_, f"S{LEAD}")) if texts_ else np.zeros(0, f"S{LEAD}")
    return hot, ordered[[len(ordered) * i // buckets for i in range(1, buckets)]] if len(ordered) else ordered


def _marked(docs: DataFrame, key: str, text: str, buckets: int | None, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """(group, id, row, text) of every row of ``docs``, with the columns ``carry`` as a struct, and the groups' marks."""
    integer_key(docs, key)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    carried = [F.struct(*[F.col(c) for c in carry]).alias("carried")] * bool(carry)
    whole = docs.select(F.col(key).cast("long").alias("id"), body.alias("text"), *carried)
    texts = whole.where(F.col("id").isNotNull() & (F.octet_length("text") >= LENGTH))
    total = whole.agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = buckets or max(shuffle_partitions(docs.sparkSession), -(-(total["bytes"] or 0) // BUCKET_BYTES))
    groups = 2 * buckets
    hot, splitters = _sampled(texts, total["rows"], buckets)
    sent = texts.select("id", "text").mapInArrow(_screen_map(hot, buckets), "bucket int, blob binary").repartition(buckets, "bucket")
    told = sent.groupBy("bucket").applyInArrow(released(_screen_bucket(groups)), "group int, blob binary").repartition(buckets, "group")
    dealt = whole.select(F.coalesce(_group_column(F.col("id"), groups), F.pmod(F.hash("text"), F.lit(groups))).alias("group"), "id", F.xxhash64("id", "text").alias("row"), "text", *["carried"] * bool(carry)).repartition(buckets, "group")
    suffixes = dealt.groupBy("group").cogroup(told.groupBy("group")).applyInArrow(released_pair(_suffix_map(hot, splitters, buckets)), "bucket int, blob binary").repartition(buckets, "bucket")
    return dealt, suffixes.groupBy("bucket").applyInArrow(released(_suffix_bucket(groups)), "group int, blob binary").repartition(buckets, "group")


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row; spans: start, end, start, end ... in bytes."""
    dealt, marks = _marked(docs, key, text, buckets, [])
    out = dealt.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(released_pair(_finish), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>")
    return out.withColumnRenamed("id", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """``docs`` with repeated bytes cut out of the texts; rows that lose their whole text go.

    A removed run that begins or ends inside a character is shortened to whole characters, so the text
    stays valid UTF-8. A column n_chars, if there is one, is set anew.
    """
    names = docs.columns
    dealt, marks = _marked(docs, key, text, buckets, [c for c in names if c != text])
    carried = dealt.schema["carried"].dataType.simpleString()

    def cut_out(rows: pa.Table, blobs: pa.Table) -> pa.Table:
        texts, gone = [], []
        for _, body, spans in _spans(rows, blobs):
            left = _kept(body, _whole_characters(body, spans))
            texts.append(left)
            gone.append(bool(body) and not left)
        return pa.table({"left": pa.array(texts, pa.binary()).cast(pa.string()), "gone": pa.array(gone, pa.bool_()), "carried": rows.column("carried")})

    cleaned = dealt.groupBy("group").cogroup(marks.groupBy("group")).applyInArrow(released_pair(cut_out), f"left string, gone boolean, carried {carried}").where(~F.col("gone"))
    new = {text: F.col("left")} | ({"n_chars": F.char_length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    return cleaned.select(*[new.get(c, F.col("carried")[c]).alias(c) for c in names])


def _whole_characters(text: bytes, spans: np.ndarray) -> np.ndarray:
    """The spans without characters that they hold in part."""
    out = []
    for a, b in spans.tolist():
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return np.array(out, np.int64).reshape(-1, 2)
