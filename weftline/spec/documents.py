"""Workflow documents: YAML, native JSON and n8n JSON, all read into the same ``Workflow``."""

from __future__ import annotations

import json
import re
from typing import Any

import yaml

from weftline.operators.lambdas import validate
from weftline.plans.graph import Output, Step, Workflow, WorkflowError

#: Settings that an op may have besides id, op, inputs and max_iter.
SETTINGS = {
    "InputOp": set(), "DataOp": {"data"}, "MessageOp": {"messages"}, "DataRetrievalOp": {"data_spec"},
    "FormatOp": {"template", "format_kwargs", "format_args", "format_paths"},
    "LambdaOp": {"code", "fn_name", "mode", "timeout_s", "memory_mb", "image", "expected_runtime_s", "cache", "sample_value"},
    "RouterOp": {"rules", "default_branch", "path"},
    "LLMChatOp": {"prompt", "messages", "config", "return_history", "history", "structural_outputs", "aggregate_table", "rowwise_template", "rowwise_columns", "rowwise_messages", "rowwise_seed", "cacheable", "condition"},
    "LLMCompletionOp": {"prompt", "config", "cacheable"},
    "LLMVisionOp": {"prompt", "messages", "image_source", "image_path", "config", "cacheable"},
    "ImageGenerationOp": {"content", "config"}, "EmbeddingOp": {"content", "config"},
    "ClassificationOp": {"query", "candidates", "config"},
    "HttpFetchOp": {"url", "query", "config", "method", "params", "body"},
}


def _step(entry: dict) -> Step:
    if not isinstance(entry.get("id"), str) or entry.get("op") not in SETTINGS:
        raise WorkflowError(f"{entry.get('id')}: op {entry.get('op')!r} is unknown")
    settings = {k: v for k, v in entry.items() if k not in ("id", "op", "inputs", "max_iter")}
    if unknown := set(settings) - SETTINGS[entry["op"]]:
        raise WorkflowError(f"{entry['id']}: unknown settings {sorted(unknown)}")
    inputs = tuple(entry.get("inputs") or ())
    for name in ("query", "candidates", "content", "image_source", "history"):
        if isinstance(settings.get(name), str):
            inputs = (*inputs, settings[name])
    if entry["op"] == "LLMCompletionOp" and isinstance(settings.get("prompt"), str):
        inputs = (*inputs, settings["prompt"])
    prompt = settings.get("prompt") if isinstance(settings.get("prompt"), dict) else settings
    inputs = (*inputs, *(prompt.get("format_kwargs") or {}).values(), *(prompt.get("format_args") or []))
    if entry["op"] == "LambdaOp":
        validate(settings["code"], settings.get("fn_name"))
    return Step(entry["id"], entry["op"], tuple(dict.fromkeys(inputs)), settings)


def _bare_references(entry: dict, ids: set[str]) -> dict:
    """A message whose content is a step's id reads that step."""
    turns = [{"role": m["role"], "node": m["content"]} if isinstance(m.get("content"), str) and m["content"] in ids else m for m in entry.get("messages") or []]
    return entry | {"messages": turns} if "messages" in entry else entry


def from_yaml(text: str) -> Workflow:
    """A workflow from YAML (or JSON): name, inputs, ops, outputs. Steps may stand in any order."""
    doc = yaml.safe_load(text)
    if not isinstance(doc, dict) or not doc.get("ops"):
        raise WorkflowError("a workflow needs ops")
    name = doc.get("name", "workflow")
    if not str(name).strip():
        raise WorkflowError("the name is blank")
    given = doc.get("inputs") or {}
    for k, v in given.items():
        if not isinstance(v, list) or any(not isinstance(x, str) for x in v):
            raise WorkflowError(f"input {k}: values must be a list of strings")
    ids = [e.get("id") for e in doc["ops"]]
    if len(set(ids + list(given))) != len(ids) + len(given):
        raise WorkflowError("step ids must be unique")
    known = set(ids) | set(given)
    steps = {k: Step(k, "InputOp") for k in given} | {e["id"]: _step(_bare_references(e, known)) for e in doc["ops"]}
    outputs = tuple(Output(o["name"], o["ref"], o.get("path")) for o in doc.get("outputs") or [])
    branches = {f"{s.id}.{b}": s.id for s in steps.values() if s.op == "RouterOp" for b in [s.settings["default_branch"], *[r["branch"] for r in s.settings["rules"]]]}
    for s in steps.values():
        if bad := [r for r in s.references() if r not in steps and r not in branches]:
            raise WorkflowError(f"{s.id}: reads {bad}, which are no steps")
    return Workflow(str(name), steps, outputs, {k: tuple(v) for k, v in given.items()})


def from_native(graph: dict[str, dict]) -> Workflow:
    """A workflow from its JSON graph; a step may read only steps before it."""
    steps: dict[str, Step] = {}
    outputs = []
    for i, node in graph.items():
        for r in node["_inputs"]:
            if r not in steps:
                raise WorkflowError(f"{i}: reads {r}, which isn't built yet")
        if node["_op"] == "OutputOp":
            outputs.append(Output(node["name"], node["_inputs"][0], node.get("path")))
        else:
            steps[node["_id"]] = Step(node["_id"], node["_op"], tuple(node["_inputs"]), {k: v for k, v in node.items() if not k.startswith("_")})
    return Workflow("graph", steps, tuple(outputs))


_EXPRESSION = re.compile(r"\{\{\s*\$\('([^']+)'\)\.(?:first\(\)\.|last\(\)\.)?item((?:\.\w+)*)\s*\}\}")


def expressions(text: str) -> tuple[str, list[dict]]:
    """A text with n8n references as a template with labels, and the labels' parameters. Labels that repeat are numbered; other braces are literal."""
    params: list[dict] = []
    out, at = [], 0
    for m in _EXPRESSION.finditer(text):
        path = m[2].strip(".").removeprefix("json").strip(".")
        node, base = m[1], re.sub(r"\W+", "_", path.split(".")[-1] if path else m[1]).lower()
        same = next((p for p in params if p["node"] == node and p.get("path", "") == path), None)
        if same is None:
            used = {p["label"] for p in params}
            label = base if base not in used else next(f"{base}_{k}" for k in range(2, 1000) if f"{base}_{k}" not in used)
            same = {"label": label, "node": node, **({"path": path} if path else {})}
            params.append(same)
        out += [text[at: m.start()].replace("{", "{{").replace("}", "}}"), "{" + same["label"] + "}"]
        at = m.end()
    return "".join([*out, text[at:].replace("{", "{{").replace("}", "}}")]), params


def _select(p: dict) -> tuple[str, list[dict]]:
    """The query of a select node; columns of its filter are part of the projection."""
    def quoted(name: str) -> str:
        return name if re.fullmatch(r"[a-z_][a-z0-9_]*", name) else f"`{name}`"

    wheres = (p.get("where") or {}).get("values") or []
    columns = list(dict.fromkeys([*(p.get("outputColumns") or []), *[w["column"] for w in wheres if p.get("outputColumns")]]))
    params: list[dict] = []
    tests = []
    for w in wheres:
        value, found = expressions(str(w.get("value", "")))
        params += [x for x in found if x not in params]
        operator = {"equal": "=", "notEqual": "<>", ">": ">", "<": "<", ">=": ">=", "<=": "<=", "LIKE": "LIKE", "IS NULL": "IS NULL"}[w.get("condition", "equal")]
        literal = value if found else "'" + value.replace("'", "''") + "'"
        tests.append(f"{quoted(w['column'])} {operator}" + ("" if operator == "IS NULL" else f" {literal}"))
    table = quoted(p["table"]["value"] if isinstance(p["table"], dict) else p["table"])
    text = f"SELECT {', '.join(map(quoted, columns)) or '*'} FROM {table}" + (f" WHERE {' AND '.join(tests)}" if tests else "")
    return text + (f" LIMIT {int(p['limit'])}" if p.get("limit") else ""), params


def from_n8n(text: str) -> Workflow:
    """A workflow from n8n JSON: triggers, code, Postgres, S3 and chain nodes. Model nodes only set the chain's config."""
    doc = json.loads(text)
    steps: dict[str, Step] = {}
    models: dict[str, dict] = {}
    for source, links in (doc.get("connections") or {}).items():
        for target in (t["node"] for group in links.get("ai_languageModel", []) for t in group):
            models[target] = next((n.get("parameters") or {} for n in doc["nodes"] if n["name"] == source), {})
    sources_of_models = {source for source, links in (doc.get("connections") or {}).items() if links.get("ai_languageModel")}
    feeds: dict[str, list[str]] = {}
    for source, links in (doc.get("connections") or {}).items():
        for t in (t["node"] for group in links.get("main", []) for t in group):
            feeds.setdefault(t, []).append(source)
    for node in doc["nodes"]:
        kind, name, p = node["type"].split(".")[-1], node["name"], node.get("parameters") or {}
        if kind in ("chatTrigger", "manualChatTrigger"):
            entry: dict[str, Any] = {"id": name, "op": "InputOp"}
        elif kind == "code":
            entry = {"id": name, "op": "LambdaOp", "inputs": feeds.get(name, []), "code": p["pythonCode"], "fn_name": p.get("functionName"), "mode": p.get("mode", "row")}
        elif kind == "postgres":
            query, params = expressions(p["query"]) if p.get("operation") == "executeQuery" else _select(p)
            entry = {"id": name, "op": "DataRetrievalOp", "data_spec": {"mode": "sql", "template": query, "params": params}}
        elif kind in ("s3", "awsS3"):
            template, params = expressions("/".join(x for x in (p.get("bucketName"), p.get("fileKey")) if x))
            entry = {"id": name, "op": "DataRetrievalOp", "data_spec": {"mode": "s3", "template": template, "params": params}}
        elif kind == "agent":
            entry = {"id": name, "op": "DataRetrievalOp", "data_spec": {"mode": "agent", "description": p["text"], "schema_scope": p.get("schemaScope") or []}}
        elif kind == "chainLlm":
            text_, tables = p.get("text", ""), None
            if block := re.search(r"```table\n(.*?)```", text_, re.S):
                tables = []
                for line in filter(None, map(str.strip, block[1].splitlines())):
                    label, _, ref = line.partition(":")
                    found = expressions(ref.strip())[1][0]
                    tables.append({"label": label.strip(), "node": found["node"], "path": found.get("path", "output")})
                text_ = text_.replace(block[0], "\u0001")
            template, params = expressions(text_)
            template = template.replace("\u0001", "{df}")
            entry = {"id": name, "op": "LLMChatOp", "prompt": {"template": template, "format_kwargs": {x["label"]: x["node"] for x in params}, "format_paths": {x["label"]: x["path"] for x in params if "path" in x}}, "config": models.get(name, {})}
            if system := [m["message"] for m in (p.get("messages") or {}).get("messageValues", [])]:
                entry["messages"] = [{"role": "system", "content": "\n".join(system)}]
            if tables:
                entry["aggregate_table"] = tables
        elif kind in ("embeddings", "embeddingsOpenAi"):
            entry = {"id": name, "op": "EmbeddingOp", "content": feeds[name][0], "config": {"model": p["model"]} if p.get("model") else {}}
        elif kind == "httpRequest":
            url, found = expressions(p["url"])
            entry = {"id": name, "op": "HttpFetchOp", "url": re.sub(r"\{\w+\}", "{query}", url), "query": found[0]["node"] if found else feeds[name][0], "method": p.get("method", "GET")}
        elif kind == "textClassifier":
            query, candidates = (expressions(p[k])[1][0]["node"] for k in ("query", "candidates"))
            entry = {"id": name, "op": "ClassificationOp", "query": query, "candidates": candidates}
        elif kind == "imageGeneration":
            entry = {"id": name, "op": "ImageGenerationOp", "content": feeds[name][0]}
        elif name in sources_of_models or kind in ("stickyNote", "noOp"):
            continue
        else:
            raise WorkflowError(f"{name}: a node of type {node['type']} can't be read")
        entry = {k: v for k, v in entry.items() if v is not None}
        steps[name] = _step(entry)
    ends = [s for s in steps if not any(s in t.references() for t in steps.values())]
    return Workflow(doc.get("name", "workflow"), steps, tuple(Output(e, e) for e in ends))
