"""Text coercions and templates as column expressions; no user functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def coerce_text(column: Column, kind: T.DataType) -> Column:
    """Output text: strings as they are, null as ``null``, everything else as JSON text."""
    if isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, _NESTED):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("null"))


def template_text(column: Column, kind: T.DataType) -> Column:
    """Prompt text: as ``coerce_text``, but null, true and false as None, True and False."""
    if isinstance(kind, T.BooleanType):
        text = F.when(column, F.lit("True")).when(~column, F.lit("False"))
    elif isinstance(kind, T.StringType):
        text = column
    elif isinstance(kind, _NESTED):
        text = F.to_json(column, {"ignoreNullFields": "false"})
    else:
        text = column.cast("string")
    return F.coalesce(text, F.lit("None"))


def _spec(column: Column, kind: T.DataType, conversion: str | None, spec: str) -> Column:
    if conversion not in (None, "s"):
        raise ValueError(f"conversion !{conversion} isn't supported; use a LambdaOp")
    if not spec:
        return template_text(column, kind)
    if spec[-1] in "dfxXeE" or spec[-1] == "s":
        body = spec[:-1].replace("<", "-").replace(">", "")
        return F.format_string(f"%{body}{spec[-1]}", template_text(column, kind) if spec[-1] == "s" else column)
    raise ValueError(f"format spec :{spec} isn't supported; use a LambdaOp")


def render(template: str, columns: dict[str, tuple[Column, T.DataType]]) -> Column:
    """``str.format`` over columns. Doubled braces are literal; unknown names raise."""
    parts: list[Column] = []
    for literal, name, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            head, _, rest = name.partition(".")
            if head not in columns:
                raise ValueError(f"template names {{{name}}}, but the inputs are {sorted(columns)}")
            column, kind = columns[head]
            for field in filter(None, rest.split(".")):
                kind = kind[field].dataType  # type: ignore[index]
                column = column[field]
            parts.append(_spec(column, kind, conversion, spec or ""))
    return F.concat(*parts) if parts else F.lit("")


def frame_columns(df: DataFrame, names: list[str]) -> dict[str, tuple[Column, T.DataType]]:
    return {n: (F.col(f"`{n}`"), df.schema[n].dataType) for n in names}


def token_set(text: Column) -> Column:
    """Distinct lower-case words of letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two sets' union that both hold; 0 if either is empty."""
    shared, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / union)


def weighted_jaccard(a: DataFrame, b: DataFrame, key: str, weight: str) -> DataFrame:
    """One row ``similarity``: the sum of lesser over that of greater weights; 0 without weights."""
    both = a.select(key, F.col(weight).alias("x")).join(b.select(key, F.col(weight).alias("y")), key, "full")
    x, y = F.coalesce("x", F.lit(0.0)), F.coalesce("y", F.lit(0.0))
    return both.agg(F.sum(F.least(x, y)).alias("l"), F.sum(F.greatest(x, y)).alias("g")).select(F.when(F.col("g") > 0, F.col("l") / F.col("g")).otherwise(0.0).alias("similarity"))


#: Names whose values are hidden; fixed values.
SECRET_NAMES = ("api_key", "apikey", "password", "secret", "token", "access_key")
#: Headers whose value is hidden up to the end of the line or a semicolon; fixed values.
SECRET_HEADERS = ("authorization", "proxy-authorization", "x-api-key", "api-key", "ocp-apim-subscription-key", "x-auth-token", "cookie", "set-cookie")


def redact(text: Column) -> Column:
    """Values of secret headers and names, and bearer tokens anywhere, replaced by ``[REDACTED]``; the scheme of an authorization is kept."""
    headers, names = "|".join(SECRET_HEADERS), "|".join(SECRET_NAMES)
    out = F.regexp_replace(text, rf'(?i)("(?:{headers})"\s*:\s*)"[^"]*"', '$1"[REDACTED]"')
    out = F.regexp_replace(out, rf"(?i)(?<![\w-])((?:proxy-)?authorization\s*[:=]\s*(?:[A-Za-z][\w-]*[ \t]+)?)[^\s;][^\n;]*", "$1[REDACTED]")
    out = F.regexp_replace(out, rf"(?i)(?<![\w-])((?!(?:proxy-)?authorization)(?:{headers})\s*[:=]\s*)[^\s;][^\n;]*", "$1[REDACTED]")
    out = F.regexp_replace(out, r"(?i)\bbearer\s+(?!\[REDACTED)[^\s;,\"]+", "Bearer [REDACTED]")
    return F.regexp_replace(out, rf'(?i)("?\b(?:{names})"?\s*[:=]\s*)("[^"]*"|(?!\[REDACTED)[^\s,;}}]+)', "$1[REDACTED]")
