"""Grouped columns and back, tables as prompt text, statistics over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.text import template_text


def flatten(df: DataFrame, column: str, out: str = "value") -> DataFrame:
    """A row for each element of a grouped column, with its place ``pos``; other columns repeat. Empty groups give none."""
    carried = [c for c in df.columns if c != column]
    return df.select(*carried, F.posexplode(column).alias("pos", out)).withColumn("pos", F.col("pos").cast("long"))


def flatten_together(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each place of several grouped columns; groups of unequal size are an error."""
    sizes = [F.size(c) for c in columns]
    same = sizes[0] == sizes[0]
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit(f"the groups of {columns} differ in size")).cast(df.select(F.arrays_zip(*columns).alias("z")).schema["z"].dataType))
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.posexplode(zipped).alias("pos", "__z")).select(*rest, F.col("pos").cast("long").alias("pos"), *[F.col(f"__z.{c}").alias(c) for c in columns])


def regroup(spine: DataFrame, rows: DataFrame, value: str = "value", out: str = "value") -> DataFrame:
    """(row_id, out): the values of each row of ``spine`` in order of ``pos``; rows without values have an empty list."""
    grouped = rows.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col(value).alias("v")))).alias("g"))
    kind = T.ArrayType(rows.schema[value].dataType)
    joined = spine.select("row_id").join(grouped, "row_id", "left")
    return joined.select("row_id", F.coalesce(F.transform("g", lambda x: x["v"]), F.array().cast(kind)).alias(out))


def table_text(rows: DataFrame, labels: list[str], out: str = "df") -> DataFrame:
    """(row_id, out): each row's table as text, one line per element, fields parted by `` | ``, below a line of labels."""
    cells = F.concat_ws(" | ", *[template_text(F.col(c), rows.schema[c].dataType) for c in labels])
    lines = rows.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", cells.alias("line")))).alias("g"))
    body = F.array_join(F.transform("g", lambda x: x["line"]), "\n")
    return lines.select("row_id", F.concat(F.lit(" | ".join(labels) + "\n"), body).alias(out))


def element_count(df: DataFrame, column: str) -> Column:
    """Elements of a list value, or 1; to be summed."""
    return F.coalesce(F.size(column), F.lit(1)) if isinstance(df.schema[column].dataType, T.ArrayType) else F.lit(1)


def observe(df: DataFrame) -> DataFrame:
    """(place, column, n, sum, min, max, avg) of each numeric or boolean column, in order, from one pass."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))]

    def cell(c: str) -> Column:
        return F.col(c).cast("int").cast("double") if isinstance(df.schema[c].dataType, T.BooleanType) else F.col(c).cast("double")

    stats = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.count(c).alias("n"), F.sum(cell(c)).alias("sum"), F.min(cell(c)).alias("min"), F.max(cell(c)).alias("max"), F.avg(cell(c)).alias("avg")) for i, c in enumerate(numeric)]
    if not stats:
        return df.sparkSession.createDataFrame([], "place int, column string, n long, sum double, min double, max double, avg double")
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def observation_text(df: DataFrame, preview_width: int = 400) -> str:
    """The statistics and the first three rows as the text that a planner reads."""
    lines = [f"rows={df.count()}"]
    for r in observe(df).orderBy("place").collect():
        if r["n"]:
            lines.append(f"{r['column']}: n={r['n']} sum={r['sum']:.4g} min={r['min']:.4g} max={r['max']:.4g} avg={r['avg']:.4g}")
    preview = "[" + ", ".join(df.limit(3).toJSON().collect()) + "]"
    return "\n".join([*lines, "preview=" + (preview if len(preview) <= preview_width else preview[:preview_width] + "...")])
