"""Settings of a model step: what goes with each request, what sets up an engine, and where requests go."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from typing import Any

#: Most requests at once; fixed value.
MOST_AT_ONCE = 8
#: Sampling settings that a chat service knows, those that only an engine's sampler knows, and those that set up an engine; fixed names.
SERVICE = "frequency_penalty logit_bias logprobs max_tokens n presence_penalty seed stop stream stream_options temperature top_p".split()
SAMPLER = "num_beams ignore_eos chat_template_kwargs min_tokens repetition_penalty top_k min_p".split()
ENGINE = "max_model_len gpu_memory_utilization tensor_parallel_size dtype".split()


@dataclass(frozen=True)
class Api:
    """A chat service. ``authorization`` names the variable that holds the credential on the executors, so no secret is in a plan."""

    url: str | None = None
    model: str | None = None
    authorization: str | None = None
    timeout_sec: float = 60.0
    retries: int = 2
    concurrency: int = 4

    def __post_init__(self):
        if isinstance(self.concurrency, bool) or not isinstance(self.concurrency, int) or not 1 <= self.concurrency <= MOST_AT_ONCE:
            raise ValueError(f"api.concurrency is 1 to {MOST_AT_ONCE}")
        if not 0 <= self.retries <= 10:
            raise ValueError("api.retries is 0 to 10")


@dataclass(frozen=True)
class Enforcement:
    """What an answer must be: text that matches a pattern, or JSON of a schema; asked again up to ``max_attempts`` times."""

    mode: str = "retry"
    max_attempts: int = 1
    json_schema: dict | None = None
    text_regex: str | None = None

    def __post_init__(self):
        if self.mode not in ("retry", "constrained"):
            raise ValueError("output_enforcement.mode is retry or constrained")
        if isinstance(self.max_attempts, bool) or not isinstance(self.max_attempts, int) or not 1 <= self.max_attempts <= 10:
            raise ValueError("output_enforcement.max_attempts is 1 to 10")
        if (self.json_schema is None) == (self.text_regex is None):
            raise ValueError("output_enforcement has a json_schema or a text_regex")


@dataclass(frozen=True)
class Generation:
    """A step's config, split into what each request, an engine and a service get."""

    model: str = ""
    request: dict[str, Any] = field(default_factory=dict)
    engine: dict[str, Any] = field(default_factory=dict)
    api: Api | None = None
    output_enforcement: Enforcement | None = None

    @classmethod
    def of(cls, config: dict[str, Any] | None) -> Generation:
        """From a document; unknown settings and the same setting said twice are errors."""
        given = dict(config or {})
        more, engine = given.pop("extra_sampling_params", None) or {}, given.pop("extra_engine_kwargs", None) or {}
        parts = {k: given.pop(k) for k in ("model", "api", "output_enforcement") if given.get(k) is not None}
        if unknown := set(given) - {*SERVICE, *SAMPLER, *ENGINE, "model", "api", "output_enforcement", "apply_sigmoid"}:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        request = {k: given[k] for k in (*SERVICE, *SAMPLER) if given.get(k) is not None}
        built = {k: given[k] for k in ENGINE if given.get(k) is not None}
        if twice := (set(request) & set(more)) | (set(built) & set(engine)):
            raise ValueError(f"said twice: {sorted(twice)}")
        if wrong := (set(more) & set(ENGINE)) | (set(engine) & {*SERVICE, *SAMPLER}):
            raise ValueError(f"{sorted(wrong)} stand among the wrong extras")

        def made(kind, value):
            if isinstance(value, kind):
                return value
            if bad := set(value) - {f.name for f in fields(kind)}:
                raise ValueError(f"unknown settings {sorted(bad)}")
            return kind(**value)

        out = cls(parts.get("model", ""), request | more, built | engine, made(Api, parts["api"]) if "api" in parts else None, made(Enforcement, parts["output_enforcement"]) if "output_enforcement" in parts else None)
        if out.api and out.engine:
            raise ValueError("a service has no engine settings")
        if out.api and not (out.api.model or out.model):
            raise ValueError("a service needs a model")
        return out

    def signature(self) -> str:
        """The request's settings as one JSON text, empty if there are none."""
        return json.dumps(self.request, sort_keys=True, separators=(",", ":")) if self.request else ""

    def body(self, turns: list[dict]) -> dict:
        """A service's request: its model goes before the step's, settings that a service doesn't know stay out."""
        return {"model": (self.api.model if self.api else None) or self.model, "messages": turns, **{k: v for k, v in self.request.items() if k in SERVICE}}
