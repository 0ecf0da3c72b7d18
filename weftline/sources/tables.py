"""Tables in, results out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import coerce_text

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """Views of the tables for SQL retrieval."""
    for n in names or NAMES:
        table(spark, folder, n).createOrReplaceTempView(n)


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """Parquet, ORC, CSV, JSON lines (bad lines dropped), text or whole files."""
    reader = spark.read.options(**options)
    reader = reader.schema(schema) if schema else reader
    if kind == "jsonl":
        return reader.option("mode", "DROPMALFORMED").json(path)
    return reader.format("binaryFile" if kind == "files" else kind).load(path)


def write_values(df: DataFrame, location: str, column: str = "value") -> None:
    """Values in row order as text, as they are: below a folder (a name that ends in /) item-000001.txt and so on, a file per value, else one folder of lines.

    Executors write the values; the driver only gives the files their names.
    """
    text = df.select("row_id", coerce_text(F.col(column), df.schema[column].dataType).alias("value"))
    if not location.endswith("/"):
        text.orderBy("row_id").select("value").write.mode("overwrite").text(location)
        return
    named = text.select(F.format_string("item-%06d", F.col("row_id") + 1).alias("item"), "value")
    named.write.mode("overwrite").partitionBy("item").option("lineSep", "\u0000").text(location)
    files = _folder(df.sparkSession, location)
    for part in files.listStatus():
        if part.isDirectory() and part.getPath().getName().startswith("item="):
            for f in files.fs.listStatus(part.getPath()):
                target = files.path(f"{location}{part.getPath().getName()[5:]}.txt")
                files.fs.rename(f.getPath(), target)
            files.fs.delete(part.getPath(), True)


class _folder:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, location: str):
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.here = self.path(location)
        self.fs = self.here.getFileSystem(spark._jsc.hadoopConfiguration())

    def listStatus(self) -> list:
        return list(self.fs.listStatus(self.here))


def write_outputs(outputs: dict[str, DataFrame], location: str, all_outputs: bool = True) -> list[str]:
    """Each output of a run in a folder of its own below ``location``, or only the first; the folders that were written."""
    out = []
    for name, df in list(outputs.items())[: None if all_outputs else 1]:
        write_values(df, f"{location.rstrip('/')}/{name}")
        out.append(f"{location.rstrip('/')}/{name}")
    return out


def sample_rows(spark: SparkSession, lines: DataFrame, schema: str, column: str = "value", most: int = 100) -> DataFrame:
    """Records of JSON lines, for a look at a source: blank and bad lines and lines that hold no object are skipped, ``most`` rows stay."""
    text = F.trim(F.col(column))
    objects = lines.where(text.startswith("{") & F.from_json(text, "map<string,string>").isNotNull())
    return objects.select(F.from_json(F.col(column), schema).alias("r")).where("r IS NOT NULL").limit(most).select("r.*")


def write(df: DataFrame, location: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).format(kind).save(location)
