"""Operator 3, MinHash near-dedup: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Each document's distinct word shingles get a SuperMinHash signature. In step j every element puts the
   value j + random at the j-th place of its own random permutation; a document stops once all places
   are filled, as later steps could only add greater values.
2. Documents with the same set are one class, and its least id stands for it.
3. Signatures are cut into bands. All members of a bucket are compared with the bucket's least member:
   a star, not all pairs. Sizes are compared first, then the full sets of both whole texts.
4. Members of buckets that still hold several components are compared further. Sets that share 0.8 of
   their union share one of the first n // 5 + 1 shingles in any common order, so documents meet only at
   those, the rarest first by a bounded sample. Shingles whose documents are all in one component are left
   out. The others go to clusters, named after the document of least hash, so shingles of much the same
   documents share one. A cluster is compared in blocks, whose full sets meet as incidence matrices, and
   no pair is emitted. So any two members of a bucket are compared or in one component.
5. Components of the confirmed links come from union-find on the cluster; step 4 links whole components.

Hot keys (a class of copies, a bucket, a hub, a shingle) meet in joins whose hot partitions Spark can
split. Documents with fewer words than a shingle are one shingle; without words (null and empty texts
too) the set is empty and nothing is linked. Ids are integers; other types are refused. Rows that share a
doc_id are one document and share its fate. Rows without an id are never linked: component_id is null,
and they are kept. Ties do not arise, as the least id wins. Further columns are carried by
``deduplicate`` and not read.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, WordHasher, integer_key, map_batches, mix, random_table, released, split_join, text_bytes
from weftline.llm.components import UnionFind, connected_components

#: A pair at 0.8 shares a band with probability 1 - (1 - 0.8 ** 5) ** 28, all but 1.5 in 100,000.
BANDS, ROWS = 28, 5
#: Documents and bytes of sets in a block; shingles in a matrix.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 4 << 20, 4096
#: For the order of shingles only: sampled documents, the longest of them in shingles, the documents that make a shingle frequent, and frequent shingles that are known at most.
SAMPLE_DOCS, SAMPLE_SIZE, FREQUENT, KNOWN = 2000, 5000, 8, 100_000
#: Bytes of sets that block comparisons copy at once: about so many, or this multiple of the sets' own bytes. The rest is copied once those copies are gone.
WAVE_BYTES, WAVE_SHARE = 256 << 20, 3
#: 64-bit words of the map by which most texts that no bucket holds are told.
MAP_WORDS = 1 << 19
#: Shingles whose signatures are made at once.
CHUNK = 60_000
_EMPTY = np.uint64(2**64 - 1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """The sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, size: int):
        self.size, self.words, self.weights = size, WordHasher(), random_table(5, size)

    def __call__(self, text: bytes) -> np.ndarray:
        words = self.words(text)
        if not len(words):
            return words
        n = min(self.size, len(words))
        count = len(words) - n + 1
        out = np.full(count, np.uint64(n))
        for i in range(n):
            out += words[i: i + count] * self.weights[i]
        return np.unique(mix(out))


@lru_cache(maxsize=4)
def shingler(size: int) -> Shingler:
    return Shingler(size)


def super_minhash(sets: list[np.ndarray], places: int = BANDS * ROWS) -> np.ndarray:
    """A row of ``places`` values for each set; step and random part in the upper and lower 32 bits. Sets must not be empty."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), places), _EMPTY)
    flat = out.ravel()
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = None  # of each element: its permutation so far
    for j in range(places):
        drawn = mix(elements + np.uint64(int(_STEP) * (j + 1) % 2**64))
        k = j + ((drawn & np.uint64(0xFFFFFFFF)) % np.uint64(places - j)).astype(np.int64)
        if order is None:
            place = k
        else:
            rows = np.arange(len(elements))
            place = order[rows, k].astype(np.int64)
            order[rows, k] = order[:, j]
        np.minimum.at(flat, owner * places + place, np.uint64(j) << np.uint64(32) | drawn >> np.uint64(32))
        open_ = (out == _EMPTY).any(axis=1)
        if not open_.any():
            break
        stay = open_[owner]
        if order is None:
            order = np.tile(np.arange(places, dtype=np.uint16), (int(stay.sum()), 1))
            order[np.arange(len(order)), k[stay]] = 0
        elif not stay.all():
            order = order[stay]
        elements, owner = elements[stay], owner[stay]
    return out


def bands_of(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band, different for different bands."""
    n, places = signatures.shape
    parts = signatures.reshape(n, places // rows, rows)
    keys = np.arange(places // rows, dtype=np.uint64)[None, :] * _STEP + np.zeros((n, 1), np.uint64)
    for i in range(rows):
        keys = mix(keys ^ mix(parts[:, :, i] + np.uint64(i + 1)))
    return keys.view(np.int64)


def _signed(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(id, n, f1, f2, bands): the set's size, two checksums of it, and its band keys."""

    def make():
        shingle = shingler(size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle(t) for t in text_bytes(batch.column(1))]
            bands: list = [None] * len(sets)
            todo = [i for i, s in enumerate(sets) if len(s)]
            at = 0
            while at < len(todo):
                upto, n = at, 0
                while upto < len(todo) and (upto == at or n + len(sets[todo[upto]]) <= CHUNK):
                    n += len(sets[todo[upto]])
                    upto += 1
                for i, b in zip(todo[at:upto], bands_of(super_minhash([sets[i] for i in todo[at:upto]])), strict=True):
                    bands[i] = b
                at = upto
            f1 = [int(mix(s).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            f2 = [int(np.bitwise_xor.reduce(mix(s + _STEP)).view(np.int64)) if len(s) else 0 for s in sets]
            arrays = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "f1", "f2", "bands"])

        return each

    return map_batches(docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string")), "id long, n long, f1 long, f2 long, bands array<long>", make)


def _alike(small, large) -> F.Column:
    """Two set sizes at which 0.8 of the union can be shared."""
    return 100 * F.least(small, large) >= 80 * F.greatest(small, large)


def _perhaps_among(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key ``known`` holds and few others, by a broadcast bitmap of hashes: what no join needs is not shuffled. The map's size is bounded, so with very many keys more rows stay."""
    word, bit = F.expr(f"pmod(shiftright(xxhash64({key}), 6), {MAP_WORDS})").alias("__word"), F.expr(f"shiftleft(1L, int(pmod(xxhash64({key}), 64)))")
    bits = known.groupBy(word).agg(F.bit_or(bit).alias("__bits"))
    return rows.withColumn("__word", word).join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(bit) != 0).drop("__word", "__bits")


def _sets_of(reps: DataFrame, docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(rep, body): the sorted shingle hashes of the documents that ``reps`` names, one for each text where rows share an id."""
    texts = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).cast("string").alias("t"))

    def make():
        shingle = shingler(size)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle(t).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], names=["rep", "body"])

        return each

    return map_batches(reps.join(_perhaps_among(texts, reps, "rep"), "rep"), "rep long, body binary", make)


def _share(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two sorted sets share 0.8 of their union."""
    shared = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * shared >= 80 * (len(s) + len(t) - shared)


def _confirmed(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """Of the pairs (a, b, ...) those whose full sets share 0.8 of their union."""
    both = split_join(pairs, bodies.toDF("a", "sa"), ["a"])
    both = split_join(both, bodies.toDF("b", "sb"), ["b"])
    kept = list(range(len(pairs.columns)))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)
            keep = [i for i, (x, y) in enumerate(sets) if _share(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            return batch.select(kept).take(pa.array(keep, pa.int64()))

        return each

    return map_batches(both.select(*pairs.columns, "sa", "sb"), ", ".join(f"{c} long" for c in pairs.columns), make)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """(i, j) of all sets of the two lists that share 0.8 of their union, from products of incidence matrices."""
    sizes = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
    values, owner = np.concatenate([*left, *right]), np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column, count = np.cumsum(new) - 1, np.diff(np.append(np.flatnonzero(new), len(values)))
    often = count[column] > 1  # a shingle of one document is shared by no pair
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    shared = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        x, y = np.searchsorted(column, [a, a + COLUMNS])
        block = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        block[owner[x:y], column[x:y] - a] = 1
        shared += block[: len(left)] @ block[len(left):].T
    union = sizes[0][:, None] + sizes[1][None, :] - shared
    return np.argwhere(100 * shared >= 80 * union)


def _block_links(table: pa.Table) -> pa.Table:
    """Links between components that the two blocks of a task give, as a forest."""
    sides, labels = table.column("side").to_numpy(), table.column("label").to_numpy()
    bodies = [np.frombuffer(b, np.uint64) for b in table.column("body").to_pylist()]
    left, right = np.flatnonzero(sides <= 0), np.flatnonzero(sides >= 0)  # side 0: both
    sets = UnionFind()
    if len(left) and len(right):
        for i, j in linked_pairs([bodies[k] for k in left], [bodies[k] for k in right]):
            sets.join(int(labels[left[i]]), int(labels[right[j]]))
    links = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
    return pa.table({"la": pa.array([x for x, _ in links], pa.int64()), "lb": pa.array([r for _, r in links], pa.int64())})


def _compare_in_blocks(clusters: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (la, lb) between components whose members (cluster, rep, n, label) are in one cluster. ``sets``: (rep, n, body).

    A cluster's largest component and the rest are cut into blocks of bounded size; each block of the rest
    meets each other block in a task of its own, so no task grows with the cluster and no pair is emitted.
    A cluster that fits a block is one: all its members count as the rest. A block is copied to each of its
    tasks, in a large cluster many times; so tasks are dealt to waves by their hash, and a wave's copies go
    before the next wave's are made.
    """
    counts = clusters.groupBy("cluster", "label").agg(F.count("*").alias("c"), F.sum("n").alias("size"))
    top = counts.groupBy("cluster").agg(F.max(F.struct("c", "label", "size")).alias("top"), F.sum("c").alias("c"), F.sum("size").alias("size")).where("c > top.c")
    mains, minors = (F.ceil(F.greatest(c / BLOCK, 8 * n / BLOCK_BYTES)).cast("int") for c, n in ((F.col("top.c"), F.col("top.size")), (F.col("c") - F.col("top.c"), F.col("size") - F.col("top.size"))))
    one = (F.col("c") <= BLOCK) & (8 * F.col("size") <= BLOCK_BYTES)
    top = top.select("cluster", F.when(~one, F.col("top.label")).alias("main"), F.when(one, 0).otherwise(mains).alias("mains"), F.when(one, 1).otherwise(minors).alias("minors"), F.when(one, F.col("size")).otherwise(F.col("top.size") * minors + (F.col("size") - F.col("top.size")) * (minors + mains)).alias("copies"))
    copies = 8 * (top.agg(F.sum(F.col("copies").cast("double"))).first()[0] or 0)
    top = top.drop("copies")
    dealt = split_join(clusters, top, ["cluster"]).withColumn("is_main", F.col("label").eqNullSafe(F.col("main")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("minors"))).cast("int"))

    def task(i, j, is_main: bool, side):  # rows of the rest are -1, of the largest component 1; within one block 0
        return F.struct(i.alias("i"), j.alias("j"), F.lit(is_main).alias("main"), side.alias("side"))

    of_minors = F.sequence(F.lit(0), F.col("minors") - 1)
    of_mains = F.when(F.col("mains") > 0, F.sequence(F.lit(0), F.col("mains") - 1)).otherwise(F.array().cast("array<int>"))
    of_main = F.transform(of_minors, lambda m: task(m, F.col("own"), True, F.lit(1)))
    of_rest = F.concat(
        F.transform(of_minors, lambda m: task(F.least("own", m), F.greatest("own", m), False, F.signum(F.col("own") - m).cast("int"))),
        F.transform(of_mains, lambda m: task(F.col("own"), m, True, F.lit(-1))),
    )
    spread = dealt.select("cluster", "rep", "label", F.explode(F.when(F.col("is_main"), of_main).otherwise(of_rest)).alias("t"))
    own = 8 * (sets.agg(F.sum("n")).first()[0] or 0)
    waves = max(1, math.ceil(copies / max(WAVE_BYTES, WAVE_SHARE * own)))

    def wave(k: int) -> DataFrame:
        some = spread.where(F.pmod(F.xxhash64("cluster", "t.i", "t.j", "t.main"), F.lit(waves)) == k)
        full = split_join(some, sets.select("rep", "body"), ["rep"]).select("cluster", "t.i", "t.j", "t.main", "t.side", "label", "body")
        return full.groupBy("cluster", "i", "j", "main").applyInArrow(released(_block_links), "la long, lb long")

    # written here, so no task runs the comparison and the union-find side by side
    return scratch.keep_in_turn(wave(k) for k in range(waves))


def prefix(body: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of a sorted set, those that aren't frequent first: two sets that share 0.8 of their union share one."""
    at = np.minimum(np.searchsorted(frequent, body), max(0, len(frequent) - 1))
    order = np.where(frequent[at] == body, rank[at], -1) if len(frequent) else np.zeros(len(body), np.int64)
    return body[np.argsort(order, kind="stable")[: len(body) // 5 + 1]]


def _frequent(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many sampled sets hold, and their ranks. They only order the shingles; any order gives the same links."""
    few = sets.where(F.col("n") <= SAMPLE_SIZE).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_DOCS)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64))], names=["s"])

    seen = map_batches(few.select("body"), "s long", lambda: each).groupBy("s").count().where(F.col("count") >= FREQUENT)
    top = seen.orderBy(F.desc("count"), "s").limit(KNOWN).collect()
    known, rank = np.array([r["s"] for r in top], np.int64).view(np.uint64), np.arange(len(top), 0, -1)
    order = np.argsort(known)
    return known[order], rank[order]


def _prefixes(sets: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(shingle, rep, n, label): a row for each shingle by which a set can meet another."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            parts = [prefix(np.frombuffer(b, np.uint64), frequent, rank) for b in batch.column(3).to_pylist()]
            sizes = [len(p) for p in parts]
            rows = [pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in range(3)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)), *rows], names=["shingle", "rep", "n", "label"])

        return each

    return map_batches(sets.select("rep", "n", "label", "body"), "shingle long, rep long, n long, label long", make)


def _further_links(inside: DataFrame, bodies: DataFrame, scratch: Scratch) -> DataFrame:
    """(la, lb): links between components of the members (rep, n, label) of mixed buckets. ``bodies`` is removed once their sets are taken from it."""
    sets = scratch.keep(inside.join(bodies, "rep"))
    scratch.drop(bodies)
    spots = scratch.keep(_prefixes(sets, *_frequent(sets)))
    least = F.min(F.struct(F.xxhash64("rep").alias("h"), "rep"))["rep"].alias("cluster")
    mixed = spots.groupBy("shingle").agg(least, F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("shingle", "cluster")
    clusters = scratch.keep(split_join(spots, mixed, ["shingle"]).select("cluster", "rep", "n", "label").distinct())
    scratch.drop(spots)
    out = _compare_in_blocks(clusters, sets, scratch)
    scratch.drop(sets, clusters)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row."""
    integer_key(docs, key)
    scratch = Scratch(docs.sparkSession)
    signed = scratch.keep(_signed(docs, key, text, shingle_words))
    known = signed.where((F.col("n") > 0) & F.col("id").isNotNull())
    classes = scratch.keep(known.groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")))
    spread = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    leaders = spread.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("l"), F.count("*").alias("c")).where("c > 1")
    members = scratch.keep(split_join(spread, leaders, ["bucket"]).select("bucket", "rep", "n", F.col("l.rep").alias("leader"), F.col("l.n").alias("ln")))
    bodies = scratch.keep(_sets_of(members.select("rep").distinct(), docs, key, text, shingle_words))

    stars = members.where((F.col("rep") != F.col("leader")) & _alike(F.col("n"), F.col("ln"))).select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    groups = connected_components(_confirmed(stars, bodies), scratch)

    labelled = split_join(members.select("bucket", "rep", "n"), groups.withColumnRenamed("node", "rep"), ["rep"], "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("label"))
    labelled = scratch.keep(labelled)
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l != h").select("bucket")
    inside = split_join(labelled, mixed, ["bucket"], "left_semi").select("rep", "n", "label").distinct()
    wider = connected_components(_further_links(inside, bodies, scratch), scratch)
    scratch.drop(members, labelled)

    of = classes.select("f1", "f2", "n", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("component", "rep"))
    of = split_join(of.drop("component"), wider.withColumnRenamed("node", "label"), ["label"], "left").select("f1", "f2", "n", F.coalesce("component", "label").alias("found"))
    done = split_join(signed.drop("bands"), scratch.keep(of), ["f1", "f2", "n"], "left")
    component = F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("found")).otherwise(F.col("id"))
    return done.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5) -> DataFrame:
    """The rows of ``docs`` without those that near-copy a document of a smaller id, all columns as they are."""
    gone = near_duplicates(docs, key, text, shingle_words).where(~F.col("kept")).select(F.col(key).alias("__gone")).distinct()
    return docs.join(gone, docs[key].cast("long") == gone["__gone"], "left_anti")
