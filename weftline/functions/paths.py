"""Dotted paths over values: ``a.b[0].c`` as a column of a typed frame, and over plain JSON values."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PART = re.compile(r"^([^\[\]]*)((?:\[\d+\])*)$")


class PathError(ValueError):
    """A path that is malformed or leads nowhere."""


def parse(path: str) -> list[str | int]:
    """Fields and indices; an empty path has no steps."""
    if not path:
        return []
    steps: list[str | int] = []
    for part in path.split("."):
        match = _PART.match(part)
        if not part or not match:
            raise PathError(f"malformed path part {part!r} in {path!r}")
        if match[1]:
            steps.append(match[1])
        steps += [int(i) for i in re.findall(r"\d+", match[2])]
    return steps


def column_at(column: Column, kind: T.DataType, path: str) -> tuple[Column, T.DataType]:
    """The column a path leads to. Fields of arrays of structs map over their elements; text is read as JSON."""
    for i, step in enumerate(steps := parse(path)):
        if isinstance(kind, T.StringType):
            rest = "$" + "".join(f"[{s}]" if isinstance(s, int) else f".{s}" for s in steps[i:])
            return F.get_json_object(column, rest), T.StringType()
        if isinstance(step, int):
            if not isinstance(kind, T.ArrayType):
                raise PathError(f"[{step}] needs a list in {path!r}")
            column, kind = F.get(column, F.lit(step)), kind.elementType
        elif isinstance(kind, T.ArrayType):
            inner = kind.elementType
            if not isinstance(inner, T.StructType) or step not in inner.names:
                raise PathError(f"no field {step!r} in the elements in {path!r}")
            column, kind = column.getField(step), T.ArrayType(inner[step].dataType)
        elif isinstance(kind, T.MapType):
            column, kind = F.try_element_at(column, F.lit(step)), kind.valueType
        elif isinstance(kind, T.StructType) and step in kind.names:
            column, kind = column.getField(step), kind[step].dataType
        else:
            raise PathError(f"no field {step!r} in {path!r}")
    return column, kind


def error_as_null(column: Column, error: Column) -> Column:
    """An item with an error has no value."""
    return F.when(F.coalesce(error, F.lit("")) == "", column)


def walk(value: Any, path: str) -> Any:
    """The value a path leads to in a JSON value. A failed item (a true ``error``) has None; anything else missing raises."""
    if not path:
        return value
    current = value
    for step in parse(path):
        if isinstance(current, str):
            try:
                current = json.loads(current)
            except ValueError as bad:
                raise PathError(f"{path!r} leads into text that is no JSON") from bad
        if isinstance(step, int):
            if not isinstance(current, list) or step >= len(current):
                raise PathError(f"no element [{step}] in {path!r}")
            current = current[step]
        elif isinstance(current, list):
            current = [walk(x, step) for x in current]
        elif isinstance(current, dict):
            if step in current:
                current = current[step]
            elif current.get("error"):
                return None
            else:
                raise PathError(f"no field {step!r} in {path!r}")
        else:
            raise PathError(f"{path!r} leads into {type(current).__name__}")
    return current


def as_text(value: Any) -> str:
    """Strings as they are, everything else as JSON text."""
    return value if isinstance(value, str) else json.dumps(value)


def label_of(path: str) -> str:
    """The name a structural path gives a column: its last field, or ``output`` for a whole item."""
    fields = [s for s in parse(path) if isinstance(s, str) and s not in ("item", "items", "json", "output")]
    return fields[-1] if fields else "output"
