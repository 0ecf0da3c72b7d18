"""Retrieval: one set-oriented query for all parameter rows, object contents, and planned queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PLACE = re.compile(r"\{(\w+)\}")
#: A text literal (quotes inside are doubled), a line comment or a block comment.
_OPAQUE = re.compile(r"'(?:[^']|'')*'|--[^\n]*|/\*.*?\*/", re.S)
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _veiled(text: str) -> tuple[str, list[str]]:
    """A query whose literals hold only their numbers and whose comments are gone, and what the literals hold."""
    held: list[str] = []

    def veil(m: re.Match) -> str:
        if not m[0].startswith("'"):
            return " "
        held.append(m[0][1:-1])
        return f"'\x01{len(held) - 1}\x01'"

    return _OPAQUE.sub(veil, text), held


def _unveiled(text: str, held: list[str]) -> str:
    return re.sub("\x01(\\d+)\x01", lambda m: held[int(m[1])], text)


def to_spark_sql(text: str) -> str:
    """The PostgreSQL forms that templates use, in Spark's dialect. Literals stay as they are, a backslash in them is one too."""
    out, held = _veiled(text)
    out = out.strip().rstrip(";").strip()
    out = re.sub(r'"([A-Za-z_][^"]*)"', r"`\1`", out)
    out = re.sub(r"(?is)string_agg\s*\(\s*([^,()]+?)\s*,\s*('[^']*')\s+order\s+by\s+([^()]+?)\)", r"string_agg(\1, \2) WITHIN GROUP (ORDER BY \3)", out)
    out = re.sub(r"(?i)([\w.`]+)\s*(?:::jsonb?)?\s*->>\s*'([^']+)'", r"get_json_object(\1, '$.\2')", out)
    out = re.sub(r"(?i)::jsonb?\b", "", out)
    out = re.sub(r"(?i)::text\b", "::string", out)
    out = re.sub(r"(?i)::(?:double precision|float8)\b", "::double", out)
    return _unveiled(out, [h.replace("\\", "\\\\") for h in held])


def bound(template: str, column: Callable[[str], str]) -> str:
    """A template whose placeholders are columns: one in a longer literal becomes part of a concatenation, so no value is spliced into the text."""
    out, held = _veiled(template)

    def literal(m: re.Match) -> str:
        parts = _PLACE.split(held[int(m[1])])  # text, name, text, name, ... text
        if len(parts) == 1:
            return m[0]
        if len(parts) == 3 and not parts[0] and not parts[2]:
            return column(parts[1])
        return "concat(" + ", ".join(f"CAST({column(x)} AS STRING)" if i % 2 else f"'{x}'" for i, x in enumerate(parts) if x) + ")"

    return _unveiled(_PLACE.sub(lambda m: column(m[1]), re.sub("'\x01(\\d+)\x01'", literal, out)), held)


def read_only(spark: SparkSession, query: str) -> str:
    """The query, if it is one statement that only reads; else an error."""
    text = query.strip().rstrip(";").strip()
    if not re.match(r"(?is)^\s*(select|with|values|table|\()", text) or re.search(r"(?is)\bfor\s+(update|share)\b", text):
        raise ValueError("only one reading statement is allowed")
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        plan = parser.parsePlan(text)
    except Exception as bad:
        raise ValueError(f"not one reading statement: {str(bad).splitlines()[0]}") from bad
    names = plan.getClass().getSimpleName()
    if re.search(r"Insert|Delete|Update|Merge|Drop|Create|Alter|Truncate|Command", names):
        raise ValueError("only one reading statement is allowed")
    return text


def limited(spark: SparkSession, query: str, rows: int) -> DataFrame:
    """At most ``rows`` rows of a reading query."""
    return spark.sql(read_only(spark, to_spark_sql(query))).limit(rows)


def relations(spark: SparkSession, query: str) -> list[str]:
    """Tables that a query reads, from its parsed plan; names of its CTEs are left out."""
    tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(to_spark_sql(query)).toString()
    ctes = {n.strip() for m in re.findall(r"CTE \[([^\]]*)\]", tree) for n in m.split(",")}
    found = re.findall(r"UnresolvedRelation \[([^\]]+)\]", tree)
    return sorted({f.replace(", ", ".") for f in found} - ctes)


def per_row(params: DataFrame, template: str, order: str | None = None, view: str = "__params", most: int | None = None) -> DataFrame:
    """(row_id, pos, ...) of a query template for every row of ``params`` (row_id and a column per placeholder).

    The template runs once as a lateral join, which Catalyst turns into joins and grouped aggregates, not
    once per row. Placeholders become column references, also inside longer literals. Rows without a result
    are absent; ``as_tables`` brings them back. ``pos`` follows ``order`` (by default the template's last ORDER
    BY, else all columns). ``most`` bounds the rows of each parameter row. A
    parameter row's rows are sorted together, as its table is one value.
    """
    spark = params.sparkSession
    names = set(params.columns) - {"row_id"}
    unknown = set(_PLACE.findall(template)) - names
    if unknown:
        raise ValueError(f"no parameters for {sorted(unknown)}; there are {sorted(names)}")
    body = read_only(spark, to_spark_sql(bound(template, lambda name: f"{view}.`{name}`")))
    params.createOrReplaceTempView(view)
    found = spark.sql(f"SELECT {view}.row_id AS row_id, __r.* FROM {view} JOIN LATERAL ({body}) AS __r")
    if order is None:
        last = re.search(r"(?is)\border\s+by\s+((?:(?!\border\s+by\b|\blimit\b|[()]).)+?)(?:\s+limit\s+\d+)?\s*$", body)
        order = ", ".join(re.sub(r"^\w+\.", "", x.strip()) for x in last[1].split(",")) if last else None
    rest = [f"`{c}`" for c in found.columns if c != "row_id"]
    keys = [*([o.strip() for o in order.split(",")] if order else []), *rest]
    placed = found.withColumn("pos", F.expr(f"row_number() OVER (PARTITION BY row_id ORDER BY {', '.join(keys)})").cast("long") - 1)
    return placed if most is None else placed.where(F.col("pos") < most)


def as_tables(spine: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, table): every row of ``spine`` with its rows in order; an empty list where there are none."""
    fields = [c for c in rows.columns if c not in ("row_id", "pos")]
    grouped = rows.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("r")))).alias("t"))
    out = spine.select("row_id").join(grouped, "row_id", "left")
    return out.select("row_id", F.coalesce(F.transform("t", lambda x: x["r"]), F.array().cast(grouped.select(F.transform("t", lambda x: x["r"]).alias("x")).schema["x"].dataType)).alias("table"))


def top_per_row(params: DataFrame, base: DataFrame, on: list[str], order: list, k: int) -> DataFrame:
    """(row_id, pos, ...) of the first k matches of each parameter row, as one join and a ranked window."""
    joined = params.join(base, on)
    w = Window.partitionBy("row_id").orderBy(*order)
    return joined.withColumn("pos", F.row_number().over(w).cast("long") - 1).where(F.col("pos") < k)


def objects(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length", "content")


def object_contents(keys: DataFrame, store: DataFrame, key: str = "value", encoding: str = "utf-8") -> DataFrame:
    """(row_id, content) of the object that each row names, text unless ``encoding`` is binary; missing objects are null."""
    content = F.col("content") if encoding == "binary" else F.decode("content", encoding.upper())
    return keys.join(store.select(F.col("path").alias(key), content.alias("content")), key, "left").select("row_id", "content")


def encoding_of(name: str) -> str:
    """binary for image and document names, else utf-8."""
    return "binary" if re.search(r"(?i)\.(png|jpe?g|gif|webp|bmp|tiff|pdf)$", name) else "utf-8"


def expand_prefix(spark: SparkSession, folder: str) -> DataFrame:
    """(row_id, value) of all object paths below a folder, by name; an empty folder is an error."""
    from weftline.operators.rows import numbered

    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("value"))
    if found.isEmpty():
        raise ValueError(f"no objects below {folder}")
    return numbered(found, "value").select("row_id", "value")


def folder_sizes(store: DataFrame) -> DataFrame:
    """(folder, files, bytes, mean_bytes) of a listing with path and length."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return store.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.avg("length").alias("mean_bytes"))


def mean_of_folder_means(store: DataFrame) -> DataFrame:
    return folder_sizes(store).agg(F.avg("mean_bytes").alias("mean_bytes"))


def column_exists(spark: SparkSession, table: str, column: str) -> bool:
    """Whether a table of the catalog has a column; names must be plain identifiers."""
    if any(not _IDENTIFIER.fullmatch(x) for x in [*table.split("."), column]):
        raise ValueError("table and column must be plain identifiers")
    return spark.catalog.tableExists(table) and column in spark.table(table).columns


def planned(spark: SparkSession, description: str, planner: Callable[[str, dict[str, list[str]]], str], scope: list[str]) -> DataFrame:
    """Rows of the query that a planner writes for a description, restricted to the tables in ``scope``."""
    query = planner(description, {t: spark.table(t).columns for t in scope})
    outside = set(relations(spark, query)) - set(scope)
    if outside:
        raise ValueError(f"the planned query reads {sorted(outside)}, which is out of scope")
    return spark.sql(read_only(spark, to_spark_sql(query)))


#: Words of a description and the aggregates that they ask for.
_ASKED = {"total": "sum", "sum": "sum", "average": "avg", "mean": "avg", "highest": "max", "maximum": "max", "lowest": "min", "minimum": "min"}


def keyword_planner(description: str, schema: dict[str, list[str]]) -> str:
    """A query by the description's words: of the first table that it names, the rows' count, or what an aggregate word
    before a column asks for, by the first column after "by", where a column "is" a quoted text."""
    words = re.findall(r"\w+", description.lower())
    table = next((t for t in schema if t.lower() in words), None)
    if table is None:
        raise ValueError(f"the description names none of {sorted(schema)}")
    columns = {c.lower(): c for c in schema[table]}
    group = next((columns[b] for a, b in zip(words, words[1:], strict=False) if a == "by" and b in columns), None)
    shown = [f"{_ASKED[a]}({columns[b]}) AS {_ASKED[a]}_{columns[b]}" for a, b in zip(words, words[1:], strict=False) if a in _ASKED and b in columns] or ["count(*) AS n"]
    tests = [f"{columns[c.lower()]} = '{v}'" for c, v in re.findall(r"(\w+) is '((?:[^']|'')*)'", description) if c.lower() in columns]
    where = f" WHERE {' AND '.join(tests)}" if tests else ""
    return f"SELECT {', '.join([*([group] if group else []), *shown])} FROM {table}{where}" + (f" GROUP BY {group}" if group else "")
