"""Operator 10, benchmark decontamination: a hash set of normalised n-grams of the test items, carried to every task.

The windows of the test items (13 words; a shorter item is one window) are put into a hash table whose
buckets name an item's segment and a place in it. The table is the value of a subquery, so it goes to the
tasks with the plan; each document looks up its windows there, compares the words themselves at a hit, and
sums up in the same projection, without a shuffle. A table holds at most ``TABLE_WINDOWS`` windows: items
are cut into segments, the segments are dealt to as many tables as that takes, and each table has a pass
of its own over the documents, which adds to their hits. The steps are the same at any size, and only
built-in functions are used.

Null and empty texts have no words and no hits. Items without words are ignored, and so are rows of
the test table without an id. An id that occurs twice is listed once. Each input row gives one row,
repeated rows included; texts are scanned whole; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch
from weftline.llm.quality_rules import let

WINDOW = 13
#: Windows in a segment of an item; windows in a table on average, which bounds what a task holds to some 100 MB.
SEGMENT, TABLE_WINDOWS = 4096, 1 << 20
_HITS = "array<struct<s:int,e:int,items:array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lowered, ASCII letters, digits and all non-ASCII characters. None for null."""
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lowered, _BREAK), lambda w: w != "")


def segments(benchmark: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, n, at, w): the items' words, cut so that each window of n words lies in one segment of bounded length."""
    items = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("item"), words_of(F.col(text)).alias("w"))
    items = items.where(F.size("w") > 0).withColumn("n", F.least(F.size("w"), F.lit(size)))
    cuts = items.withColumn("at", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"), F.lit(SEGMENT))))
    return cuts.select("item", "n", "at", F.slice("w", F.col("at") + 1, F.col("n") + (SEGMENT - 1)).alias("w")).distinct()


def _key(hashed: Column, i: Column, n: Column | int) -> Column:
    """The key of the window of n words at i (from 0): three of its words' hashes."""
    return F.xxhash64(F.get(hashed, i), F.get(hashed, i + F.floor(n / F.lit(2)).cast("int")), F.get(hashed, i + n - 1))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _table(parts: DataFrame, places: int) -> DataFrame:
    """One row: the segments, for each place the windows whose key falls there, and for each place the lengths of windows whose first word does."""
    spark = parts.sparkSession
    one = parts.agg(F.array_sort(F.collect_list(F.struct("item", "at", "n", "w"))).alias("s"))
    each = one.select(F.posexplode("s").alias("no", "x")).select("no", "x.item", "x.n", "x.w", _hashes(F.col("x.w")).alias("h"))
    at = each.withColumn("i", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))))
    windows = at.select("no", "i", "n", F.pmod(_key(F.col("h"), F.col("i"), F.col("n")), F.lit(places)).alias("place"), F.pmod(F.get("h", F.col("i")), F.lit(places)).alias("first"), "item", F.array_join(F.slice("w", F.col("i") + 1, F.col("n")), " ").alias("text"))
    windows = windows.dropDuplicates(["item", "n", "text"])
    found = windows.groupBy("place").agg(F.collect_list(F.struct("no", "i", "n")).alias("x")).select("place", F.lit(0).alias("lengths"), "x")
    starts = windows.groupBy("first").agg(F.bit_or(F.expr("shiftleft(1, n)")).alias("lengths")).select(F.col("first").alias("place"), "lengths", F.lit(None).cast(found.schema["x"].dataType).alias("x"))
    all_places = spark.range(places).select(F.col("id").alias("place"), F.lit(0).alias("lengths"), F.lit(None).cast(found.schema["x"].dataType).alias("x"))
    dense = all_places.union(found).union(starts).groupBy("place").agg(F.max("lengths").alias("lengths"), F.first("x", ignorenulls=True).alias("x"))
    dense = dense.agg(F.array_sort(F.collect_list(F.struct("place", "lengths", "x"))).alias("d"))
    table = F.struct(F.col("s"), F.transform("d", lambda p: p["x"]).alias("windows"), F.transform("d", lambda p: p["lengths"]).alias("lengths"))
    return one.crossJoin(dense).select(table.alias("table"))  # one row each


def _summary(hits: Column) -> Column:
    """n_hit and the item ids of an array of (s, e, items)."""

    def joined(found: Column) -> Column:
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        union = F.aggregate(
            F.array_sort(F.transform(found, lambda h: F.struct(h["s"], h["e"]))),
            start,
            lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
            lambda a: a["n"],
        )
        items = F.array_sort(F.array_distinct(F.flatten(F.transform(found, lambda h: h["items"]))))
        return F.struct(union.cast("long").alias("n_hit"), items.alias("items"))

    return let(hits, joined)


def _hits(words: Column, table: Column, places: int, sizes: list[int]) -> Column:
    """The places (s, e, items) of a text where windows of the table stand; each lookup takes the same time at any size of the table."""

    def of(hashed: Column, held: Column) -> Column:
        def starts(n: int) -> Callable[[Column], Column]:
            bit = F.lit(1 << n)
            return lambda i: (F.get(held["lengths"], F.pmod(F.get(hashed, i), F.lit(places)).cast("int")).bitwiseAND(bit) > 0) & (i + n <= F.size(hashed))

        def found(n: int) -> Callable[[Column], Column]:
            def at(i: Column) -> Column:
                near = F.get(held["windows"], F.pmod(_key(hashed, i, n), F.lit(places)).cast("int"))

                def is_here(x: Column) -> Column:
                    return (x["n"] == n) & (F.slice(F.get(held["s"], x["no"])["w"], x["i"] + 1, F.lit(n)) == F.slice(words, i + 1, F.lit(n)))

                return F.struct(i.alias("s"), (i + n).alias("e"), F.transform(F.filter(near, is_here), lambda x: F.get(held["s"], x["no"])["item"]).alias("items"))

            return at

        all_ = F.when(F.size(hashed) > 0, F.sequence(F.lit(0), F.size(hashed) - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(*[F.filter(F.transform(F.filter(all_, starts(n)), found(n)), lambda h: F.size(h["items"]) > 0) for n in sizes])

    return let(_hashes(words), lambda hashed: let(table, lambda held: of(hashed, held))) if sizes else F.array().cast(_HITS)


def scan_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = WINDOW, table_windows: int = TABLE_WINDOWS) -> DataFrame:
    """The columns ``keep`` of every row with n_words, n_hit, items (sorted ids) and contaminated."""
    keep = ["doc_id"] if keep is None else keep
    parts = segments(benchmark, size=size)
    counts = {r["n"]: r["c"] for r in parts.groupBy("n").agg(F.sum(F.size("w") - F.col("n") + 1).alias("c")).collect()}  # 13 rows at most
    tables = max(1, -(-sum(counts.values()) // table_windows))
    places = 1 << (2 * min(sum(counts.values()), 2 * table_windows)).bit_length()
    rows, scratch = docs.select(*keep, F.col(text).alias("__text"), F.array().cast(_HITS).alias("__hits")), Scratch(docs.sparkSession)
    for k in range(tables):
        rows = scratch.keep(rows.select(*keep, "__text", "__hits")) if k else rows
        table = _table(parts.where(F.pmod(F.xxhash64("item", "at"), F.lit(tables)) == k), places).scalar()
        # a column of its own, as functions over arrays don't take subqueries; it is used once, so the projections become one
        met = rows.withColumn("__table", table)
        both = let(words_of(F.col("__text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _hits(w, F.col("__table"), places, sorted(counts)).alias("hits")))
        rows = met.select(*keep, "__text", "__hits", both.alias("__found")).select(*keep, "__text", F.col("__found.n").alias("n_words"), F.concat("__hits", "__found.hits").alias("__hits"))
    out = rows.select(*keep, "n_words", _summary(F.col("__hits")).alias("__s"))
    out = out.select(*keep, "n_words", F.col("__s.n_hit").alias("n_hit"), F.col("__s.items").alias("items"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def filter_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, all columns as they are."""
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), F.col(text).alias("__text"))
    return scan_documents(whole, benchmark, "__text", keep=["__doc"]).where(~F.col("contaminated")).select("__doc.*")
