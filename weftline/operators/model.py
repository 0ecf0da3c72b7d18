"""Model steps over aligned columns. The backend decides what answers; these operators decide order, arity and transcripts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.backends import DIGEST, Backend, sigmoid
from weftline.functions.text import frame_columns, render
from weftline.operators.reshape import regroup, table_text

ROLES = ("system", "user", "assistant")
MESSAGE = "array<struct<role:string,content:string>>"


def messages(*turns: tuple[str, Column]) -> Column:
    """A transcript of (role, content) turns."""
    if any(r not in ROLES for r, _ in turns):
        raise ValueError(f"roles are {ROLES}")
    return F.array(*[F.struct(F.lit(r).alias("role"), c.cast("string").alias("content")) for r, c in turns])


def prompt_text(transcript: Column) -> Column:
    """A transcript as the text a backend gets: ``role: content`` lines."""
    return F.array_join(F.transform(transcript, lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["content"], F.lit("None")))), "\n")


def chat(df: DataFrame, transcript: Column, backend: Backend = DIGEST, return_history: bool = False, seed: str | None = None) -> DataFrame:
    """``df`` with ``output`` and, if asked for, ``history``: the transcript and the answer's turn."""
    asked = df.withColumn("__t", transcript).withColumn("__p", prompt_text(F.col("__t")))
    done = backend.generate(asked, "__p", "output", seed)
    if return_history:
        done = done.withColumn("history", F.concat(F.col("__t"), messages(("assistant", F.col("output")))))
    return done.drop("__t", "__p")


def completion(df: DataFrame, prompt: Column, backend: Backend = DIGEST) -> DataFrame:
    """``df`` with ``output`` for a raw prompt."""
    return backend.generate(df.withColumn("__p", prompt), "__p", "output").drop("__p")


def chat_rowwise(rows: DataFrame, template: str, columns: list[str], system: str | None = None, backend: Backend = DIGEST, seed: str | None = None) -> DataFrame:
    """(row_id, pos, output): one prompt for each row of a grouped table. ``regroup`` gives a list per row."""
    text = render(template, frame_columns(rows, columns))
    turns = ([("system", F.lit(system))] if system else []) + [("user", text)]
    # only what the prompt needs goes to the backend
    needed = rows.select("row_id", "pos", messages(*turns).alias("__m"), *([F.col(seed).cast("long").alias("__seed")] if seed else []))
    return chat(needed, F.col("__m"), backend, seed="__seed" if seed else None).select("row_id", "pos", "output")


def chat_table(spine: DataFrame, rows: DataFrame, labels: list[str], template: str, columns: list[str], system: str | None = None, backend: Backend = DIGEST) -> DataFrame:
    """``spine`` with ``output``: one prompt per row in which {df} is the row's whole table."""
    joined = spine.join(table_text(rows, labels), "row_id", "left").withColumn("df", F.coalesce("df", F.lit(" | ".join(labels) + "\n")))
    text = render(template, frame_columns(joined, [*columns, "df"]))
    turns = ([("system", F.lit(system))] if system else []) + [("user", text)]
    return chat(joined, messages(*turns), backend).drop("df")


def conversations(df: DataFrame, column: str) -> Column:
    """A transcript from a column of JSON text."""
    return F.from_json(F.col(column), MESSAGE)


def row_seed(column: Column) -> Column:
    """An integer or null; empty text and ``null`` are null, other text is an error."""
    text = F.nullif(F.nullif(F.trim(column.cast("string")), F.lit("")), F.lit("null"))
    number = text.try_cast("bigint")
    return F.when(text.isNotNull() & number.isNull(), F.raise_error(F.concat(F.lit("no integer seed: "), text)).cast("bigint")).otherwise(number)


@dataclass(frozen=True)
class Field:
    """A typed field of a structured answer."""

    name: str
    type: str = "string"
    min: float | None = None
    max: float | None = None
    candidates: tuple = ()

    def sql_type(self) -> str:
        return {"string": "string", "str": "string", "text": "string", "integer": "bigint", "int": "bigint", "number": "double", "float": "double", "boolean": "boolean", "bool": "boolean", "date": "date", "datetime": "timestamp", "array": "array<string>", "object": "map<string,string>"}[self.type]


def structured(df: DataFrame, fields: list[Field], column: str = "output") -> DataFrame:
    """``df`` with ``parsed`` (a struct of the fields) and ``valid`` (all there and in bounds)."""
    schema = "struct<" + ",".join(f"`{f.name}`:{f.sql_type()}" for f in fields) + ">"
    out = df.withColumn("parsed", F.from_json(F.col(column), schema))
    valid = F.col("parsed").isNotNull()
    for f in fields:
        c = F.col("parsed").getField(f.name)
        valid = valid & c.isNotNull()
        if f.min is not None:
            valid = valid & (c >= f.min)
        if f.max is not None:
            valid = valid & (c <= f.max)
        if f.candidates:
            valid = valid & c.isin(*f.candidates)
    return out.withColumn("valid", F.coalesce(valid, F.lit(False)))


#: JSON schema types and the SQL types that read them.
_JSON_TYPES = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean", "array": "array<string>", "object": "map<string,string>"}


def conforms(text: Column, schema: dict) -> Column:
    """Whether a text is JSON of a flat schema: an object with its required properties, of the named types, within minimum, maximum, enum and pattern."""
    kinds = schema.get("properties") or {}
    fields = "struct<" + ",".join(f"`{k}`:{_JSON_TYPES[v.get('type', 'string')]}" for k, v in kinds.items()) + ">"
    keys = F.json_object_keys(text)
    good = keys.isNotNull()
    parsed = F.from_json(text, fields) if kinds else None
    for k in schema.get("required") or []:
        good = good & F.array_contains(keys, k)
    if schema.get("additionalProperties") is False:
        good = good & (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in kinds]).cast("array<string>"))) == 0)
    for k, rule in kinds.items():
        value = parsed.getField(k)
        tests = F.lit(True)
        for name, test in (("minimum", lambda v, x: v >= x), ("maximum", lambda v, x: v <= x), ("enum", lambda v, x: v.isin(*x)), ("pattern", lambda v, x: v.rlike(x))):
            if name in rule:
                tests = tests & test(value, rule[name])
        good = good & (~F.array_contains(keys, k) | (value.isNotNull() & tests))
    return F.coalesce(good, F.lit(False))


def enforced(df: DataFrame, prompt: str, pattern: str | None, attempts: int, backend: Backend = DIGEST, json_schema: dict | None = None) -> DataFrame:
    """``df`` with output, attempts and valid: rows whose answer doesn't match ``pattern`` or ``json_schema`` are asked again, others not. A null prompt is the text None."""
    if not 1 <= attempts <= 10:
        raise ValueError("1 to 10 attempts")
    if (pattern is None) == (json_schema is None):
        raise ValueError("a pattern or a JSON schema is needed")
    from weftline.plans.shared import cut

    done, open_ = None, df.withColumn("__p", F.coalesce(F.col(prompt), F.lit("None")))
    for k in range(1, attempts + 1):
        asked = cut(backend.generate(open_.drop("output"), "__p", "output"))
        good = F.coalesce(F.col("output").rlike(pattern), F.lit(False)) if pattern is not None else conforms(F.col("output"), json_schema)
        keep = asked if k == attempts else asked.where(good)
        part = keep.withColumn("attempts", F.lit(k)).withColumn("valid", good)
        done = part if done is None else done.unionByName(part)
        open_ = asked.where(~good).withColumn("__p", F.concat(F.col("__p"), F.lit(f"\n(attempt {k + 1})")))
    return done.drop("__p")


def fanned_out(embedded: DataFrame, expected: DataFrame) -> DataFrame:
    """(row_id, row, embedding): ``embedded`` (row_id, embeddings) with an entry for each of a request's vectors; ``expected`` (row_id, n) says how many it must have, another number is an error."""
    met = embedded.join(expected, "row_id")
    wrong = F.size("embeddings") != F.col("n")
    text = F.concat(F.lit("row "), F.col("row_id").cast("string"), F.lit(": "), F.size("embeddings").cast("string"), F.lit(" vectors, not "), F.col("n").cast("string"))
    checked = F.when(wrong, F.raise_error(text).cast(embedded.schema["embeddings"].dataType)).otherwise(F.col("embeddings"))
    return met.select("row_id", F.posexplode(checked).alias("row", "embedding"))


def embed(df: DataFrame, column: str, backend: Backend = DIGEST) -> DataFrame:
    """``df`` with ``embedding``; blank texts are an error."""
    blank = F.trim(F.coalesce(F.col(column), F.lit(""))) == ""
    checked = df.withColumn(column, F.when(blank, F.raise_error(F.lit("a text to embed is blank"))).otherwise(F.col(column)))
    return backend.embed(checked, column, "embedding")


def classify(queries: DataFrame, candidates: DataFrame, apply_sigmoid: bool = True, single_query: bool = False, backend: Backend = DIGEST) -> DataFrame:
    """(row_id, index, output) of each pair. Frames have (row_id, value); one query may meet all candidates."""
    if single_query:
        pairs = candidates.select("row_id", F.col("value").alias("candidate")).join(F.broadcast(queries.select(F.col("value").alias("query")).limit(1)))
    else:
        pairs = queries.select("row_id", F.col("value").alias("query")).join(candidates.select("row_id", F.col("value").alias("candidate")), "row_id")
    scored = backend.classify(pairs, "query", "candidate", "__s")
    return scored.select("row_id", F.col("row_id").alias("index"), (sigmoid(F.col("__s")) if apply_sigmoid else F.col("__s")).alias("output"))


def blocks(rows: DataFrame, asked: DataFrame, key: str, size: int = 256) -> DataFrame:
    """Every row with every row of a stated query set ``asked``: the set is cut into blocks by ``key``, and a block and all rows meet by its number."""
    count = max(1, -(-asked.count() // size))
    cut = asked.withColumn("__block", F.pmod(F.xxhash64(key), F.lit(count)))
    return rows.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))).join(cut, "__block").drop("__block")


def vision(spine: DataFrame, images: DataFrame, template: str, columns: list[str], backend: Backend = DIGEST) -> DataFrame:
    """(row_id, value): for each row the answers to its images, in order. ``images`` has row_id, pos, content and ``columns``."""
    text = render(template, frame_columns(images, columns))
    tagged = images.withColumn("__p", F.concat(text, F.lit("\nimage "), F.md5(F.col("content").cast("binary"))))
    answered = backend.generate(tagged.select("row_id", "pos", "__p"), "__p", "value")
    return regroup(spine, answered)


def render_image(df: DataFrame, prompt: str, width: int = 8, height: int = 8) -> DataFrame:
    """``df`` with ``image``: a small grey bitmap (PGM) drawn from the prompt's digest, in place of a diffusion model."""
    digest = F.md5(F.col(prompt).cast("binary"))
    pixels = F.substring(F.repeat(digest, -(-2 * width * height // 32)), 1, 2 * width * height)
    return df.withColumn("image", F.concat(F.lit(f"P5 {width} {height} 255\n").cast("binary"), F.unhex(pixels)))


def gated(df: DataFrame, condition: Column) -> DataFrame:
    """All rows if a condition that holds one value is true, else none."""
    return df.where(condition)
