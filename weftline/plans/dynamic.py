"""Rounds: template rounds until a list is empty, and rounds that a planner writes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from weftline.operators.reshape import observation_text
from weftline.plans.graph import Engine, Frame, Output, Step, Workflow, WorkflowError
from weftline.plans.shared import cut
from weftline.spec.documents import _step

MAX_ROUNDS, MAX_STEPS = 10, 8


def rounds_until_empty(first: DataFrame, body: Callable[[DataFrame, int], DataFrame], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """All rounds' rows with a column ``round``: each round works on the last one's rows, until there are none.

    A round is written to the shared folder before the next, so plans don't grow and a lost executor
    costs one round at most.
    """
    now = cut(first)
    out = now.selectExpr("*", "0 AS round")
    for k in range(1, max_rounds):
        if now.isEmpty():
            break
        now = cut(body(now, k))
        out = out.unionByName(now.selectExpr("*", f"{k} AS round"))
    return out


def _payload(answer: str) -> str:
    """An answer without a leading block of thoughts and without a first and last line that only fence it."""
    body = answer.strip()
    if body.startswith("<think>") and "</think>" in body:
        body = body.split("</think>", 1)[1].strip()
    lines = body.splitlines()
    if len(lines) >= 2 and lines[0].startswith("```") and lines[-1].strip() == "```":
        lines = lines[1:-1]
    return "\n".join(lines)


def parse_decision(text: str, max_steps: int = MAX_STEPS) -> dict | None:
    """A planner's answer: None to stop, else its ops and exports. Thoughts ahead and fences around are dropped."""
    body = _payload(text)
    try:
        found = json.loads(body)
    except ValueError as bad:
        raise WorkflowError("the planner's answer is no JSON") from bad
    if found == {"next": "STOP"}:
        return None
    if not isinstance(found, dict) or found.get("next") != "subgraph" or set(found) - {"next", "ops", "export"}:
        raise WorkflowError('the planner must answer {"next": "STOP"} or next, ops and export')
    if not found.get("ops") or len(found["ops"]) > max_steps:
        raise WorkflowError(f"a round has 1 to {max_steps} ops")
    return found


@dataclass
class Library:
    """Step templates that a planner may refer to."""

    templates: dict[str, dict] = field(default_factory=dict)

    def expand(self, op: dict) -> dict:
        if "ref" not in op:
            return op
        if set(op) - {"ref", "id", "inputs"}:
            raise WorkflowError("a reference sets id and inputs only")
        if op["ref"] not in self.templates:
            raise WorkflowError(f"the library has no {op['ref']}")
        made = json.loads(json.dumps(self.templates[op["ref"]]))
        bindings = made.pop("param_bindings", [])
        if len(bindings) != len(op.get("inputs", [])):
            raise WorkflowError(f"{op['ref']} takes {len(bindings)} inputs")
        for label, node in zip(bindings, op.get("inputs", []), strict=True):
            for p in made.get("data_spec", {}).get("params", []):
                if p["label"] == label:
                    p["node"] = node
        return made | {"id": op["id"], "inputs": list(op.get("inputs", []))}


def run_rounds(engine: Engine, inputs: dict[str, list[str]], planner: Callable[[str, int], str], library: Library | None = None, max_rounds: int = MAX_ROUNDS, watch: Callable[[dict[str, DataFrame]], None] | None = None) -> dict[str, DataFrame]:
    """Results of all exported steps. Later rounds may read inputs and what earlier rounds exported or ended in; nothing is computed twice."""
    library = library or Library()
    kept: dict[str, Frame] = {}
    used: set[str] = set(inputs)
    seen, built = "start", {}
    for k in range(max_rounds):
        decision = parse_decision(planner(seen, k))
        if decision is None:
            break
        ops = [_step(library.expand(o)) for o in decision["ops"]]
        for s in ops:
            if s.id in used:
                raise WorkflowError(f"{s.id}: the id is taken")
            used.add(s.id)
        own = {s.id for s in ops}
        for s in ops:
            if bad := [r for r in s.references() if r not in own and r not in inputs and r not in kept]:
                raise WorkflowError(f"{s.id}: reads {bad}, which were neither exported nor ends of an earlier round")
        steps = {i: Step(i, "InputOp") for i in inputs} | {s.id: s for s in ops}
        ends = [s.id for s in ops if not any(s.id in t.references() for t in ops)]
        exports = list(dict.fromkeys([*ends, *decision.get("export", [])]))
        earlier = {i: Step(i, "DataOp", (), {"data": []}) for i in kept}  # stand-ins: their frames are given
        flow = Workflow(f"round {k}", earlier | steps, tuple(Output(e, e) for e in exports), {i: tuple(v) for i, v in inputs.items()})
        built = engine.build(flow, kept)
        for e in exports:
            frame = built[e]
            frame.df = cut(frame.df)
            kept[e] = frame
        if watch:
            watch({i: f.df for i, f in kept.items()})
        seen = "\n\n".join(f"{e}\n{observation_text(kept[e].df)}" for e in ends)
    return {i: f.df for i, f in kept.items()}


#: What a round's body may write for its number, counted from 0, and the number before it; fixed values.
ROUND, PREVIOUS = "{{round}}", "{{prev}}"


@dataclass(frozen=True)
class RoundTemplate:
    """Fixed bodies for the first and for all later rounds, and the export whose emptiness ends the run."""

    first: dict
    next: dict
    stop_when_empty: str

    def __post_init__(self):
        for body in (self.first, self.next):
            if set(body) - {"ops", "export"} or not body.get("ops"):
                raise WorkflowError("a round's body has ops and export")
        for k in range(3):  # what can't be written for early rounds is refused before anything runs
            body = self.body(k)
            ops = {o.get("id"): o for o in body["ops"]}
            stop = self.stop_name(k)
            if stop not in ops or stop not in body.get("export", [stop]):
                raise WorkflowError(f"round {k} doesn't export {stop}")
            if ops[stop].get("op") != "LambdaOp" or ops[stop].get("mode", "row") != "list":
                raise WorkflowError(f"{stop}: a list function must decide whether another round follows")

    def stop_name(self, k: int) -> str:
        return _numbered(self.stop_when_empty, k)

    def body(self, k: int) -> dict:
        """The body of round k; functions' code stays as it is."""
        body = self.first if k == 0 else self.next
        ops = [{key: v if o.get("op") == "LambdaOp" and key == "code" else _numbered(v, k) for key, v in o.items()} for o in body["ops"]]
        return {"next": "subgraph", "ops": ops, "export": _numbered(body.get("export", []), k)}


def _numbered(value, k: int):
    if isinstance(value, str):
        return value.replace(ROUND, str(k)).replace(PREVIOUS, str(k - 1))
    if isinstance(value, list):
        return [_numbered(v, k) for v in value]
    return {key: _numbered(v, k) for key, v in value.items()} if isinstance(value, dict) else value


def run_template(engine: Engine, inputs: dict[str, list[str]], template: RoundTemplate, max_rounds: int = MAX_ROUNDS) -> dict[str, DataFrame]:
    """Rounds of a template until a round's stop export has no rows."""
    last: dict[str, DataFrame] = {}

    def plan(_seen: str, k: int) -> str:
        if k and last[template.stop_name(k - 1)].isEmpty():
            return json.dumps({"next": "STOP"})
        return json.dumps(template.body(k))

    return run_rounds(engine, inputs, plan, max_rounds=max_rounds, watch=last.update)


def posted_planner(post: Callable[[dict], dict], model: str, goal: str, retries: int = 3, wait: Callable[[float], None] = time.sleep) -> Callable[[str, int], str]:
    """A planner behind a chat service: ``post`` sends a request's body and gives the answer's. It is asked again after failures, with doubling waits."""

    def plan(seen: str, k: int) -> str:
        turns = [{"role": "system", "content": goal}, {"role": "user", "content": f"Round {k}.\n{seen}"}]
        for attempt in range(retries + 1):
            try:
                return post({"model": model, "messages": turns})["choices"][0]["message"]["content"]
            except (OSError, KeyError, IndexError, TypeError) as bad:
                if attempt == retries:
                    raise WorkflowError(f"the planner gave no answer: {bad}") from bad
                wait(2.0**attempt)
        raise AssertionError("unreachable")

    return plan
