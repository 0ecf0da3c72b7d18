"""A workflow as a graph of steps: checks, rewrites, and compilation to lazy DataFrames."""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.backends import DIGEST, ApiBackend, Backend, posted
from weftline.functions.generation import Generation
from weftline.functions.paths import column_at, error_as_null, walk
from weftline.functions.text import coerce_text, frame_columns, render
from weftline.operators import http, lambdas, model, reshape, retrieval, rows
from weftline.operators.router import Router, RouteRule


class WorkflowError(ValueError):
    """A workflow that cannot be built; the message names the step and what to change."""


@dataclass(frozen=True)
class Step:
    """A node: its kind, the nodes it reads, and its settings."""

    id: str
    op: str
    inputs: tuple[str, ...] = ()
    settings: dict[str, Any] = field(default_factory=dict)

    def references(self) -> list[str]:
        """All nodes that the step reads, in order, once each."""
        found = list(self.inputs)

        def look(x: Any) -> None:
            if isinstance(x, dict):
                found.extend([x["node"]] if isinstance(x.get("node"), str) else [])
                for v in x.values():
                    look(v)
            elif isinstance(x, list):
                for v in x:
                    look(v)

        look(self.settings)
        return list(dict.fromkeys(found))


@dataclass(frozen=True)
class Output:
    name: str
    ref: str
    path: str | None = None


KINDS = "InputOp DataOp MessageOp DataRetrievalOp FormatOp LambdaOp RouterOp LLMChatOp LLMCompletionOp LLMVisionOp ImageGenerationOp EmbeddingOp ClassificationOp HttpFetchOp".split()
#: Settings that name a step.
REFERENCES = ("node", "query", "candidates", "content", "image_source", "history", "prompt")
#: The column that an output without a path shows.
DEFAULT_COLUMN = {"InputOp": "value", "DataOp": "value", "HttpFetchOp": "json", "EmbeddingOp": "embedding", "ImageGenerationOp": "image", "MessageOp": "messages"}


@dataclass(frozen=True)
class Workflow:
    name: str
    steps: dict[str, Step]
    outputs: tuple[Output, ...]
    inputs: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self):
        for s in self.steps.values():
            if s.op not in KINDS:
                raise WorkflowError(f"{s.id}: unknown op {s.op}")
            for r in s.references():
                if r.split(".")[0] not in self.steps and r not in self.steps:
                    raise WorkflowError(f"{s.id}: reads {r}, which is no step")
        names = [o.name for o in self.outputs]
        if len(set(names)) != len(names):
            raise WorkflowError("output names must be unique")
        for o in self.outputs:
            if o.ref not in self.steps:
                raise WorkflowError(f"output {o.name}: {o.ref} is no step")
        self.order()

    def order(self) -> list[str]:
        """A topological order with ties by name; a cycle is an error."""
        waits = {i: {self._step_of(r) for r in s.references()} for i, s in self.steps.items()}
        ready = [i for i, w in waits.items() if not w]
        heapq.heapify(ready)
        out: list[str] = []
        while ready:
            i = heapq.heappop(ready)
            out.append(i)
            for j, w in waits.items():
                if i in w:
                    w.discard(i)
                    if not w:
                        heapq.heappush(ready, j)
        if len(out) < len(self.steps):
            raise WorkflowError(f"steps wait for each other: {sorted(set(self.steps) - set(out))}")
        return out

    def _step_of(self, ref: str) -> str:
        return ref if ref in self.steps else ref.split(".")[0]

    def deduplicated(self) -> Workflow:
        """Steps that say the same of the same steps become one; output steps stay, and so do inputs."""
        shown, seen, to = {o.ref for o in self.outputs}, {}, {}

        def moved(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: renamed(k, v) for k, v in x.items()}
            return [moved(v) for v in x] if isinstance(x, list) else x

        def renamed(k: str, v: Any) -> Any:
            if k in REFERENCES and isinstance(v, str):
                return to.get(v, v)
            if k == "format_kwargs" and v:
                return {label: to.get(r, r) for label, r in v.items()}
            return [to.get(r, r) for r in v] if k == "format_args" and v else moved(v)

        kept: dict[str, Step] = {}
        for i in self.order():
            s = self.steps[i]
            s = replace(s, inputs=tuple(to.get(r, r) for r in s.inputs), settings=moved(s.settings))
            key = json.dumps([s.op, s.inputs, s.settings], sort_keys=True, default=str)
            if s.op != "InputOp" and i not in shown and key in seen:
                to[i] = seen[key]
            else:
                if i not in shown:
                    seen.setdefault(key, i)
                kept[i] = s
        return replace(self, steps=kept)

    def unread(self) -> list[str]:
        """Steps that no output needs."""
        need, todo = set(), [o.ref for o in self.outputs]
        while todo:
            i = self._step_of(todo.pop())
            if i not in need:
                need.add(i)
                todo += self.steps[i].references()
        return sorted(set(self.steps) - need)

    def template_hash(self) -> str:
        """A digest of the workflow without its inputs and secrets."""
        def masked(x: Any) -> Any:
            if isinstance(x, dict):
                return {k: "***" if any(w in k.lower() for w in ("key", "token", "secret", "password")) else masked(v) for k, v in x.items()}
            return [masked(v) for v in x] if isinstance(x, list) else x

        return hashlib.sha256(json.dumps([[s.id, s.op, s.inputs, masked(s.settings)] for s in self.steps.values()] + [[o.name, o.ref, o.path] for o in self.outputs], sort_keys=True, default=str).encode()).hexdigest()

    def to_native(self) -> dict:
        """The graph as plain JSON; ``from_native`` reads it back."""
        return {i: {"_id": i, "_op": s.op, "_inputs": list(s.inputs), **s.settings} for i in self.order() for s in [self.steps[i]]} | {f"_out_{o.name}": {"_id": f"_out_{o.name}", "_op": "OutputOp", "_inputs": [o.ref], "name": o.name, "path": o.path} for o in self.outputs}


@dataclass
class Frame:
    """A built step: its rows by row_id, the column that it shows, and its number of rows if the plan knows it."""

    df: DataFrame
    column: str
    count: int | None
    grouped: DataFrame | None = None  # (row_id, pos, ...) if each row holds a table

    def value(self, path: str | None = None) -> DataFrame:
        """(row_id, value) at a path of the step's columns."""
        if path in ("items", "item"):  # the whole item
            fields = [c for c in self.df.columns if c != "row_id"]
            return self.df.select("row_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
        if not path:
            return self.df.select("row_id", F.col(self.column).alias("value"))
        steps = [p for p in path.split(".") if p not in ("item", "items")]
        if not steps:
            return self.df.select("row_id", F.col(self.column).alias("value"))
        head = steps[0].split("[")[0]
        if head in self.df.columns:
            column, kind, rest = F.col(head), self.df.schema[head].dataType, ".".join([steps[0][len(head):].lstrip("."), *steps[1:]]).strip(".")
        else:
            column, kind, rest = F.col(self.column), self.df.schema[self.column].dataType, ".".join(steps)
        found = column_at(column, kind, rest)[0] if rest else column
        if "error" in self.df.columns:
            found = error_as_null(found, F.col("error"))
        return self.df.select("row_id", found.alias("value"))


@dataclass
class Engine:
    """Builds workflows over a session. ``fetcher(method, url, body)`` or, offline, ``pages`` answers HTTP steps, ``post`` chat services, ``objects`` (path, content) object retrieval, ``planner`` planned queries."""

    spark: SparkSession
    backend: Backend = DIGEST
    pages: DataFrame | None = None
    objects: DataFrame | None = None
    planner: Callable[[str, dict[str, list[str]]], str] = retrieval.keyword_planner
    scope: tuple[str, ...] = ()
    fetcher: Callable[[str, str, str | None], tuple[int, str]] | None = None
    post: Callable[[str, dict, dict, float], dict] = posted

    def _model(self, s: Step) -> tuple[Backend, Generation]:
        """What answers a step: the service that its config names, or the engine's backend with the config's settings."""
        config = Generation.of(s.settings.get("config"))
        if config.api:
            return ApiBackend(config, self.post), config
        made = getattr(self.backend, "configured", None)
        return (made(config) if made and config.request else self.backend), config

    def build(self, flow: Workflow, given_frames: dict[str, Frame] | None = None, **inputs: list[str]) -> dict[str, Frame]:
        """All steps as lazy frames, in order. Steps that ``given_frames`` has are taken from there."""
        given = {**{k: list(v) for k, v in flow.inputs.items()}, **inputs}
        wanted = {i for i, s in flow.steps.items() if s.op == "InputOp"}
        if missing := wanted - set(given):
            raise WorkflowError(f"inputs without values: {sorted(missing)}")
        if extra := set(given) - wanted:
            raise WorkflowError(f"values for what is no input: {sorted(extra)}")
        sizes = {len(given[i]) for i in wanted} - {1}
        if len(sizes) > 1:
            raise WorkflowError(f"inputs differ in length: { {i: len(given[i]) for i in sorted(wanted)} }; give 1 or the same number of values")
        done: dict[str, Frame] = {}
        for i in flow.order():
            step = flow.steps[i]
            if given_frames and i in given_frames:
                done[i] = given_frames[i]
                continue
            try:
                if step.op == "RouterOp":
                    done |= self._route(step, done)
                else:
                    done[i] = self._input(given[i]) if step.op == "InputOp" else getattr(self, f"_{step.op}")(step, done)
            except WorkflowError:
                raise
            except (KeyError, ValueError, TypeError) as bad:
                raise WorkflowError(f"{i}: {bad}") from bad
        return done

    def run(self, flow: Workflow, **inputs: list[str]) -> dict[str, DataFrame]:
        """(row_id, value) of each output, values as text."""
        built = self.build(flow.deduplicated(), **inputs)
        out = {}
        for o in flow.outputs:
            found = built[o.ref].value(o.path)
            out[o.name] = found.select("row_id", coerce_text(F.col("value"), found.schema["value"].dataType).alias("value"))
        return out

    def preview(self, flow: Workflow, **inputs: list[str]) -> dict[str, str]:
        """The optimised plan of each output, with statistics; nothing runs."""
        return {n: df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("cost")) for n, df in self.run(flow, **inputs).items()}

    # Steps

    def _input(self, values: list[str]) -> Frame:
        return Frame(rows.literal(self.spark, values), "value", len(values))

    def _DataOp(self, s: Step, _done: dict) -> Frame:
        return self._input(s.settings["data"])

    def _columns(self, refs: dict[str, tuple[Frame, str | None]]) -> tuple[DataFrame, int | None]:
        frames = {k: f.value(p) for k, (f, p) in refs.items()}
        counts = {k: f.count for k, (f, _) in refs.items()}
        known = [c for c in counts.values() if c is not None]
        return rows.align(frames, counts), (max(known) if len(known) == len(counts) else None)

    def _FormatOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        kwargs, paths = s.settings.get("format_kwargs") or {}, s.settings.get("format_paths") or {}
        args = s.settings.get("format_args") or []
        named = dict(kwargs) | {str(i): a for i, a in enumerate(args)}
        return self._rendered(s.settings["template"], named, paths, done)

    def _rendered(self, template: str, named: dict[str, str], paths: dict[str, str], done: dict[str, Frame]) -> Frame:
        if not named:
            return Frame(rows.literal(self.spark, [template.replace("{{", "{").replace("}}", "}")]).withColumnRenamed("value", "output"), "output", 1)
        df, count = self._columns({k: (done[r], paths.get(k)) for k, r in named.items()})
        auto = template
        while "{}" in auto:  # positional places count up
            auto = auto.replace("{}", "{" + str(auto.count("{}") and template.count("{}") - auto.count("{}")) + "}", 1)
        return Frame(df.select("row_id", render(auto, frame_columns(df, list(named))).alias("output")), "output", count)

    def _MessageOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        turns = s.settings["messages"]
        refs = {f"m{i}": (done[m["node"]], m.get("path")) for i, m in enumerate(turns) if "node" in m}
        df, count = self._columns(refs) if refs else (rows.literal(self.spark, [""]), 1)
        kinds = {c: df.schema[c].dataType for c in df.columns}
        parts = [(m["role"], coerce_text(F.col(f"m{i}"), kinds[f"m{i}"]) if "node" in m else F.lit(m["content"])) for i, m in enumerate(turns)]
        return Frame(df.select("row_id", model.messages(*parts).alias("messages")), "messages", count)

    def _DataRetrievalOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        spec = s.settings["data_spec"]
        params = {p["label"]: (self._input(p["data"]) if "data" in p else done[p["node"]], p.get("path")) for p in spec.get("params") or []}
        mode = spec.get("mode", "sql")
        if mode == "agent":
            description = spec["description"]
            if params:  # one description for the step, so one row
                df, _ = self._columns(params)
                asked = df.select(render(description, frame_columns(df, list(params))).alias("d")).limit(2).collect()
                if len(asked) != 1:
                    raise WorkflowError(f"{s.id}: a planned query takes parameters of one row")
                description = asked[0]["d"]
            found = retrieval.planned(self.spark, description, self.planner, list(spec.get("schema_scope") or self.scope))
            # numbered by a parallel sort; only a prompt over the whole table gathers it
            grouped = rows.numbered(found, *found.columns).withColumnRenamed("row_id", "pos").withColumn("row_id", F.lit(0).cast("long"))
            spine = rows.literal(self.spark, [""])
            return Frame(retrieval.as_tables(spine, grouped), "table", 1, grouped)
        df, count = self._columns(params) if params else (rows.literal(self.spark, [""]).select("row_id"), 1)
        if mode == "s3":
            if self.objects is None:
                raise WorkflowError(f"{s.id}: the engine has no objects")
            keys = df.select("row_id", render(spec["template"], frame_columns(df, list(params))).alias("value"))
            encoding = spec.get("encoding") or retrieval.encoding_of(spec["template"])
            return Frame(retrieval.object_contents(keys, self.objects, encoding=encoding), "content", count)
        grouped = retrieval.per_row(df, spec["template"], spec.get("order_by"), view=f"__params_{hashlib.md5(s.id.encode()).hexdigest()[:12]}", most=spec.get("max_rows"))
        return Frame(retrieval.as_tables(df, grouped), "table", count, grouped)

    def _LambdaOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        named = {f"c{i}": (done[r], None) for i, r in enumerate(s.inputs)}
        df, count = self._columns(named)
        code, name, mode = s.settings["code"], s.settings.get("fn_name"), s.settings.get("mode", "row")
        if mode == "row":
            return Frame(lambdas.apply_row(df, list(named), code, name).select("row_id", "output"), "output", count)
        out = lambdas.apply_columns(df, list(named), code, name, aligned=mode == "aligned")
        return Frame(out, "output", count if mode == "aligned" else None)

    def _route(self, s: Step, done: dict[str, Frame]) -> dict[str, Frame]:
        source = done[s.inputs[0]]
        if len(s.inputs) != 1:
            raise WorkflowError(f"{s.id}: a router has one input")
        router = Router(tuple(RouteRule(**r) for r in s.settings["rules"]), s.settings["default_branch"], s.settings.get("path"))
        return {f"{s.id}.{b}": Frame(df, source.column, None) for b, df in router.branches(source.df, source.column).items()} | {s.id: Frame(router.tag(source.df, source.column), "branch", source.count)}

    def _parts(self, s: Step, done: dict[str, Frame]) -> tuple[str, dict[str, str], dict[str, str], str | None, list[dict]]:
        prompt = s.settings.get("prompt") or {}
        turns = s.settings.get("messages") or []
        system = "\n".join(m["content"] for m in turns if m["role"] == "system" and m.get("content")) or None
        return prompt.get("template", ""), prompt.get("format_kwargs") or {}, prompt.get("format_paths") or {}, system, turns

    def _LLMChatOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        template, kwargs, paths, system, turns = self._parts(s, done)
        backend, config = self._model(s)
        if s.settings.get("rowwise_template"):
            columns = s.settings["rowwise_columns"]
            source = next(done[c["node"]] for c in columns if done[c["node"]].grouped is not None)
            table = source.grouped
            for c in columns:
                frame = done[c["node"]]
                if frame is not source:  # one value for the whole table
                    table = table.join(frame.value(c.get("path")).withColumnRenamed("value", c["label"]), "row_id")
                else:
                    field_ = (c.get("path") or c["label"]).split(".")[-1]
                    table = table.withColumn(c["label"], F.col(field_))
            if seed := s.settings.get("rowwise_seed"):
                table = table.withColumn("__row_seed", model.row_seed(F.col(seed["path"].split(".")[-1])))
            answered = model.chat_rowwise(table, s.settings["rowwise_template"], [c["label"] for c in columns], system, backend, seed="__row_seed" if seed else None)
            return Frame(reshape.regroup(source.df, answered, "output", "output"), "output", source.count, answered)
        if s.settings.get("aggregate_table"):
            parts = s.settings["aggregate_table"]
            table = None
            for p in parts:
                one = done[p["node"]].grouped
                if one is None:
                    raise WorkflowError(f"{s.id}: {p['node']} has no table to aggregate")
                name = (p.get("path") or p["label"]).split(".")[-1]
                one = one.select("row_id", "pos", F.col(name).alias(p["label"]))
                table = one if table is None else table.join(one, ["row_id", "pos"])
            if kwargs:
                spine, count = self._columns({k: (done[r], paths.get(k)) for k, r in kwargs.items()})
            else:
                spine, count = done[parts[0]["node"]].df.select("row_id"), done[parts[0]["node"]].count
            answered = model.chat_table(spine, table, [p["label"] for p in parts], template, list(kwargs), system, backend)
            return Frame(answered.select("row_id", "output"), "output", count)
        if source := s.settings.get("rowwise_messages"):
            frame = done[source["node"]].value(source.get("path"))
            asked = frame.select("row_id", F.col("value").alias("__j"))
            return Frame(model.chat(asked, model.conversations(asked, "__j"), backend).select("row_id", "output"), "output", done[source["node"]].count)
        refs, turn_columns = {}, []
        for i, m in enumerate(turns):
            if "node" in m:
                refs[f"t{i}"] = (done[m["node"]], m.get("path"))
        if template:
            text = self._rendered(template, kwargs, paths, done)
            refs["__prompt"] = (text, None)
        if earlier := s.settings.get("history"):  # an upstream step's transcript goes ahead
            refs["__h"] = (done[earlier], "history")
        if not set(refs) - {"__h"}:
            refs["__prompt"] = (self._input(["\n".join(m.get("content", "") for m in turns if m["role"] == "user")]), None)
        df, count = self._columns(refs)
        if condition := s.settings.get("condition"):  # before the model: a false condition asks nothing
            gate = done[condition["node"]]
            if gate.count != 1:
                raise WorkflowError(f"{s.id}: a condition needs a step of one row")
            truth = gate.value(condition.get("path")).select(F.lower(F.col("value").cast("string")).isin("true", "1", "yes").alias("__go"))
            df = df.join(F.broadcast(truth.where("__go").limit(1))).drop("__go")
        for i, m in enumerate(turns):
            if "node" in m:
                turn_columns.append((m["role"], coerce_text(F.col(f"t{i}"), df.schema[f"t{i}"].dataType)))
            elif m["role"] == "user" and not m.get("content") and "__prompt" in refs:
                turn_columns.append(("user", F.col("__prompt")))
            elif m.get("content"):
                turn_columns.append((m["role"], F.lit(m["content"])))
        if "__prompt" in refs and not any(r == "user" for r, _ in turn_columns):
            turn_columns.append(("user", F.col("__prompt")))
        transcript = model.messages(*turn_columns)
        if earlier:
            transcript = F.concat(F.col("__h"), transcript)
        if rule := config.output_enforcement:
            asked = df.withColumn("__t", transcript)
            asked = asked.withColumn("__q", model.prompt_text(F.col("__t")))
            answered = model.enforced(asked, "__q", rule.text_regex, rule.max_attempts, backend, rule.json_schema)
            answered = answered.withColumn("history", F.concat(F.col("__t"), model.messages(("assistant", F.col("output")))))
        else:
            answered = model.chat(df, transcript, backend, return_history=bool(s.settings.get("return_history")))
        keep = [c for c in ("row_id", "output", "history", "attempts", "valid") if c in answered.columns]
        answered = answered.select(*keep)
        if fields := s.settings.get("structural_outputs"):
            answered = model.structured(answered, [model.Field(**{k: tuple(v) if k == "candidates" else v for k, v in f.items()}) for f in fields])
        return Frame(answered, "output", count)

    def _LLMCompletionOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        backend, _ = self._model(s)
        source = done[s.settings.get("prompt") or s.inputs[0]]
        df = source.value()
        return Frame(model.completion(df, coerce_text(F.col("value"), df.schema["value"].dataType), backend).select("row_id", "output"), "output", source.count)

    def _LLMVisionOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        backend, _ = self._model(s)
        source = done[s.settings["image_source"]]
        template, kwargs, paths, _, _ = self._parts(s, done)
        images = reshape.flatten(source.value(s.settings.get("image_path")), "value", "content") if isinstance(source.value(s.settings.get("image_path")).schema["value"].dataType, T.ArrayType) else source.value(s.settings.get("image_path")).select("row_id", F.lit(0).cast("long").alias("pos"), F.col("value").alias("content"))
        for k, r in kwargs.items():
            images = images.join(done[r].value(paths.get(k)).withColumnRenamed("value", k), "row_id")
        out = model.vision(source.df, images, template or "describe", list(kwargs), backend)
        return Frame(out.withColumnRenamed("value", "output"), "output", source.count)

    def _ImageGenerationOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        source = done[s.settings.get("content") or s.inputs[0]]
        return Frame(model.render_image(source.value(), "value").select("row_id", "image"), "image", source.count)

    def _EmbeddingOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        source = done[s.settings.get("content") or s.inputs[0]]
        return Frame(model.embed(source.value(), "value", self.backend).select("row_id", "embedding"), "embedding", source.count)

    def _ClassificationOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        query, candidates = done[s.settings["query"]], done[s.settings["candidates"]]
        config = s.settings.get("config") or {}
        out = model.classify(query.value(), candidates.value(), config.get("apply_sigmoid", True), query.count == 1, self.backend)
        return Frame(out, "output", candidates.count)

    def _HttpFetchOp(self, s: Step, done: dict[str, Frame]) -> Frame:
        if self.pages is None and self.fetcher is None:
            raise WorkflowError(f"{s.id}: the engine has neither a fetcher nor pages")
        config = {k: v for k, v in (s.settings.get("config") or {}).items() if k in ("retries", "concurrency", "delay_s", "fail_open")}
        request = http.HttpRequest(s.settings["url"], s.settings.get("method", "GET"), s.settings.get("params") or {}, s.settings.get("body"), **config)
        source = done[s.settings.get("query") or s.inputs[0]]
        got = http.fetch(source.value(), request, self.fetcher) if self.fetcher else http.fetch_from_pages(source.value(), request, self.pages)
        return Frame(got.withColumn("json", F.col("body")), "json", source.count)


def output_value(result: Any, path: str) -> Any:
    """A value of a plain result, by path."""
    return walk(result, path)


def merged(*flows: Workflow, name: str = "merged") -> Workflow:
    """One workflow of several; a step, input or output that two of them name is an error."""
    steps: dict[str, Step] = {}
    inputs: dict[str, tuple[str, ...]] = {}
    outputs: list[Output] = []
    for flow in flows:
        if both := set(steps) & set(flow.steps):
            raise WorkflowError(f"steps of two workflows: {sorted(both)}")
        steps |= flow.steps
        inputs |= flow.inputs
        outputs += flow.outputs
    return Workflow(name, steps, tuple(outputs), inputs)


def step_id(scope: str, name: str) -> str:
    """A stable id of a step: its scope, its name and a digest of both."""
    return f"{scope}_{name}_{hashlib.blake2b(f'{scope}/{name}'.encode(), digest_size=8).hexdigest()}"


def data(id_: str, values: Any) -> Step:
    """A source step from a string, a list of strings, or a list of turns."""
    if isinstance(values, str):
        values = [values]
    if isinstance(values, list) and values and all(isinstance(v, dict) and {"role", "content"} == set(v) for v in values):
        return Step(id_, "MessageOp", (), {"messages": values})
    if isinstance(values, list) and all(isinstance(v, str) for v in values):
        return Step(id_, "DataOp", (), {"data": values})
    raise WorkflowError(f"{id_}: data is a string, a list of strings, or a list of turns")
