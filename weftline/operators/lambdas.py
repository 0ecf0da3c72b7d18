"""Python functions as steps: checked as source on the driver, run on executors only."""

from __future__ import annotations

import ast
import builtins
import json
import math
import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weftline.functions.paths import as_text

#: Names a function body may use; fixed values.
BUILTINS = "abs all any bool dict enumerate filter float int isinstance len list map max min range reversed round set sorted str sum tuple zip".split()
EXCEPTIONS = "ArithmeticError AssertionError AttributeError Exception IndexError KeyError LookupError NotImplementedError OverflowError RuntimeError StopIteration TypeError ValueError ZeroDivisionError".split()
MODULES = {"json": json, "re": re, "math": math, "np": np, "pd": pd}


class LambdaError(ValueError):
    """A function source that breaks the contract."""


def _function(code: str, name: str | None) -> ast.Lambda | ast.FunctionDef:
    try:
        tree = ast.parse(code.strip())
    except SyntaxError as bad:
        raise LambdaError(f"no Python source: {bad.msg}") from bad
    if name is None:
        if len(tree.body) == 1 and isinstance(tree.body[0], ast.Expr) and isinstance(tree.body[0].value, ast.Lambda):
            return tree.body[0].value
        raise LambdaError("a lambda expression is needed, or a function's name")
    for node in tree.body:
        if isinstance(node, ast.AsyncFunctionDef) and node.name == name:
            raise LambdaError(f"{name} must not be async")
        if isinstance(node, ast.FunctionDef) and node.name == name:
            return node
    raise LambdaError(f"no top-level function {name}")


def validate(code: str, name: str | None = None) -> None:
    """One-parameter function; parsed, not run. Free names must be known; imports must be absolute and of known modules."""
    target = _function(code, name)
    args = target.args
    if len(args.args) + len(args.posonlyargs) != 1 or args.vararg or args.kwarg or args.kwonlyargs:
        raise LambdaError("the function takes one parameter")
    tree = ast.parse(code.strip())
    bound = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
    bound |= {a.arg for n in ast.walk(tree) if isinstance(n, ast.arguments) for a in [*n.args, *n.posonlyargs, *n.kwonlyargs, *([n.vararg] if n.vararg else []), *([n.kwarg] if n.kwarg else [])]}
    bound |= {n.name for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.ExceptHandler)) and n.name}
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom) and n.level:
            raise LambdaError("relative imports aren't allowed")
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            bound |= {(a.asname or a.name).split(".")[0] for a in n.names}
    known = bound | set(BUILTINS) | set(EXCEPTIONS) | set(MODULES) | {"True", "False", "None"}
    free = {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - known
    if free:
        raise LambdaError(f"unknown names: {sorted(free)}")


def materialise(code: str, name: str | None = None):
    """The function. The namespace is a convenience, not a security boundary."""
    space: dict[str, Any] = {"__builtins__": {n: getattr(builtins, n) for n in [*BUILTINS, *EXCEPTIONS, "__import__"]}, **MODULES}
    if name is None:
        return eval(code.strip(), space)  # noqa: S307
    exec(code, space)  # noqa: S102
    return space[name]


def _plain(value: Any) -> Any:
    if isinstance(value, np.generic):
        return value.item()
    return list(map(_plain, value)) if isinstance(value, (np.ndarray, list)) else value


def apply_row(df: DataFrame, columns: list[str], code: str, name: str | None = None) -> DataFrame:
    """``df`` with ``output``: the function of each row's tuple of values, as text. Arrow batches; built once per task."""
    validate(code, name)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = materialise(code, name)
        for frame in frames:
            yield frame.assign(output=[as_text(f(tuple(map(_plain, row)))) for row in frame[columns].itertuples(index=False, name=None)])

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, output string")


def apply_columns(df: DataFrame, columns: list[str], code: str, name: str | None = None, aligned: bool = False, max_rows: int = 1_000_000, group: str | None = None) -> DataFrame:
    """(row_id, output): the function of whole columns in row order, one result row per element.

    A whole column is one group in one task by definition, so more than ``max_rows`` rows are refused;
    ``group`` runs the function once per group instead. ``aligned`` asks for as many elements as rows.
    """
    validate(code, name)
    if group is None and df.limit(max_rows + 1).count() > max_rows:
        raise LambdaError(f"a list function would gather more than {max_rows} rows in one task; use mode row, or group by a column")
    key = [group] if group else []

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_id")
        result = list(materialise(code, name)(tuple(list(map(_plain, frame[c])) for c in columns)))
        if aligned and len(result) != len(frame):
            raise LambdaError(f"the function gave {len(result)} values for {len(frame)} rows")
        ids = frame["row_id"].tolist() if aligned else range(len(result))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(result) for k in key}, "row_id": pd.Series(list(ids), dtype="int64"), "output": pd.Series([as_text(x) for x in result], dtype=object)})

    kinds = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in key)
    return df.select(*key, "row_id", *columns).groupBy(*key).applyInPandas(run, f"{kinds}row_id long, output string")
