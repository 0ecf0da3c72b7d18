"""Inputs, literals, alignment by row number, slices and their ordered merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def literal(spark: SparkSession, values: Sequence[str]) -> DataFrame:
    """(row_id, value) of an inline list of strings."""
    if any(not isinstance(v, str) for v in values):
        raise TypeError("workflow values are strings")
    return spark.createDataFrame(list(enumerate(values)), "row_id long, value string")


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with row_id 0, 1, 2 ... by a total order.

    Ranges are sorted in parallel; each partition counts its rows and starts where the ones before it
    end, so no task sees all rows. Only one count per partition comes to the driver.
    """
    from weftline.plans.shared import cut

    ordered = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    base, start = {}, 0
    for r in ordered.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("first")).orderBy("__part").collect():
        base[r["__part"]] = (start, r["first"])
        start += r["n"]
    if not base:
        return ordered.drop("__part", "__at").withColumn("row_id", F.lit(None).cast("long"))
    offsets = df.sparkSession.createDataFrame([(p, s - f) for p, (s, f) in base.items()], "__part int, __shift long")
    return ordered.join(F.broadcast(offsets), "__part").withColumn("row_id", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def align(frames: dict[str, DataFrame], counts: dict[str, int | None]) -> DataFrame:
    """Columns side by side: frames (row_id, value) of length 1 or of one shared length."""
    sizes = {n for n in counts.values() if n not in (None, 1)}
    if len(sizes) > 1:
        raise ValueError(f"inputs differ in length: { {k: v for k, v in counts.items() if v != 1} }")
    many = [k for k in frames if counts[k] != 1]
    single = [k for k in frames if counts[k] == 1]
    if not many:
        many, single = single[:1], single[1:]
    out = frames[many[0]].withColumnRenamed("value", many[0])
    for k in many[1:]:
        out = out.join(frames[k].withColumnRenamed("value", k), "row_id")
    for k in single:  # one row, known from the plan
        out = out.join(F.broadcast(frames[k].select(F.col("value").alias(k)).limit(1)))
    return out


def sliced(df: DataFrame, batch: int) -> DataFrame:
    """slice_id and place of each row in contiguous slices of ``batch`` rows."""
    if batch < 1:
        raise ValueError("a slice has a row at least")
    return df.withColumn("slice_id", F.floor(F.col("row_id") / batch).cast("long")).withColumn("slice_pos", F.col("row_id") % batch)


def merged(df: DataFrame, batch: int) -> DataFrame:
    """Slices back in one column of rows."""
    return df.withColumn("row_id", F.col("slice_id") * batch + F.col("slice_pos")).drop("slice_id", "slice_pos")


def merge_report(df: DataFrame, expected: int) -> DataFrame:
    """One row: how many rows there are, are missing, doubled, or out of range."""
    valid = (F.col("row_id") >= 0) & (F.col("row_id") < expected)
    per = df.groupBy("row_id").agg(F.count("*").alias("n"))
    out = per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"),
        (F.lit(expected) - F.count(F.when(valid, 1))).cast("long").alias("n_missing"),
        F.count(F.when(F.col("n") > 1, 1)).alias("n_doubled"),
        F.count(F.when(~valid, 1)).alias("n_out_of_range"),
    )
    return out


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def match_queries(df: DataFrame, queries: dict[str, list[str]]) -> DataFrame:
    """Rows that match every key's values in any way: equality, list or comma-tag membership, yes/no words; unknown keys are ignored."""
    yes, no = ["true", "1", "yes", "on"], ["false", "0", "no", "off"]
    where = F.lit(True)
    for key, values in queries.items():
        head = key.split(".")[0]
        if head not in df.columns:
            continue
        column, kind = F.col(key), df.select(key).dtypes[0][1]
        tests = []
        for v in values:
            if v.lower() in ("", "null", "none"):
                tests.append(column.isNull())
            elif kind.startswith("array"):
                tests.append(F.array_contains(column.cast("array<string>"), v))
            elif kind == "boolean":
                tests.append(column == F.lit(v.lower() in yes) if v.lower() in yes + no else F.lit(False))
            else:
                text = column.cast("string")
                tests.append((text == v) | F.array_contains(F.split(text, r"\s*,\s*"), v))
        any_ = tests[0]
        for t in tests[1:]:
            any_ = any_ | t
        where = where & F.coalesce(any_, F.lit(False))
    return df.where(where)
