"""First-match routing of rows into named branches: one CASE column, then a filter per branch."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.paths import column_at


@dataclass(frozen=True)
class RouteRule:
    branch: str
    match: str
    value: str


@dataclass(frozen=True)
class Router:
    rules: tuple[RouteRule, ...]
    default_branch: str
    path: str | None = None

    def __post_init__(self):
        names = [r.branch for r in self.rules] + [self.default_branch]
        if not self.rules:
            raise ValueError("a router needs a rule")
        for name in names:
            if not re.fullmatch(r"\w+", name):
                raise ValueError(f"branch name {name!r} must be a word")
        if self.default_branch in names[:-1]:
            raise ValueError("the default branch can't have a rule")
        if len(set(names)) != len(names):
            raise ValueError("branch names must be unique")
        for r in self.rules:
            if r.match not in ("contains", "equals") or not r.value:
                raise ValueError(f"rule for {r.branch!r} must say contains or equals with a value")

    def branch_of(self, text: Column) -> Column:
        out = None
        for r in self.rules:
            hit = text.contains(r.value) if r.match == "contains" else text == r.value
            out = F.when(hit, r.branch) if out is None else out.when(hit, r.branch)
        return out.otherwise(self.default_branch)

    def tag(self, df: DataFrame, value: str = "value") -> DataFrame:
        """``df`` with a column branch. Without a path a row's text is its compact JSON."""
        kind = df.schema[value].dataType
        if self.path:
            column, found = column_at(F.col(value), kind, self.path)
            text = column.cast("string") if found.simpleString() == "string" else F.to_json(column) if found.simpleString().startswith(("struct", "array", "map")) else column.cast("string")
        else:
            text = F.col(value) if kind.simpleString() == "string" else F.to_json(F.col(value))
        return df.withColumn("branch", self.branch_of(F.coalesce(text, F.lit("null"))))

    def branches(self, df: DataFrame, value: str = "value") -> dict[str, DataFrame]:
        tagged = self.tag(df, value)
        return {b: tagged.where(F.col("branch") == b).drop("branch") for b in [self.default_branch, *[r.branch for r in self.rules]]}
