"""What runs a model step: a deterministic digest by default, any Python callable otherwise."""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.generation import Generation


class Backend(Protocol):
    """Adds a column ``out`` to a frame that has a column ``prompt``."""

    def generate(self, df: DataFrame, prompt: str, out: str, seed: str | None = None) -> DataFrame: ...

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame: ...

    def classify(self, df: DataFrame, query: str, candidate: str, out: str) -> DataFrame: ...


def _byte(digest: Column, i: int) -> Column:
    return F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("float")


@dataclass(frozen=True)
class DigestBackend:
    """Offline stand-in for a model: md5 of the prompt and of the settings that go with it, so order, arity and settings can be checked in any engine. It says nothing of quality."""

    settings: str = ""
    DIMENSIONS = 8

    def configured(self, config: Generation) -> DigestBackend:
        return DigestBackend(config.signature())

    def generate(self, df: DataFrame, prompt: str, out: str, seed: str | None = None) -> DataFrame:
        prompted = F.concat(F.col(prompt), F.lit("\n" + self.settings)) if self.settings else F.col(prompt)
        salted = prompted if seed is None else F.concat(prompted, F.lit("#"), F.coalesce(F.col(seed).cast("string"), F.lit("null")))
        return df.withColumn(out, F.md5(salted.cast("binary")))

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        digest = F.md5(F.col(text).cast("binary"))
        return df.withColumn(out, F.array(*[_byte(digest, i) / F.lit(255.0).cast("float") for i in range(self.DIMENSIONS)]).cast("array<float>"))

    def classify(self, df: DataFrame, query: str, candidate: str, out: str) -> DataFrame:
        from weftline.functions.text import jaccard, token_set

        return df.withColumn(out, 8 * jaccard(token_set(F.col(query)), token_set(F.col(candidate))) - 4)


@dataclass
class CallableBackend:
    """A Python model: ``make()`` is called once per task and gives a function from a list of prompts to a list of results."""

    make: Callable[[], Callable[[list], list]]
    threads: int = 1
    batch: int = 64

    def _run(self, df: DataFrame, columns: list[str], out: str, kind: str) -> DataFrame:
        make, threads, size = self.make, max(1, min(8, self.threads)), self.batch

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = make()
            with ThreadPoolExecutor(threads) as pool:
                for frame in frames:
                    rows = list(frame[columns].itertuples(index=False, name=None)) if len(columns) > 1 else frame[columns[0]].tolist()
                    parts = pool.map(model, [rows[i: i + size] for i in range(0, len(rows), size)])
                    yield frame.assign(**{out: [x for part in parts for x in part]})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(each, f"{schema}, `{out}` {kind}")

    def generate(self, df: DataFrame, prompt: str, out: str, seed: str | None = None) -> DataFrame:
        return self._run(df, [prompt] if seed is None else [prompt, seed], out, "string")

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        return self._run(df, [text], out, "array<float>")

    def classify(self, df: DataFrame, query: str, candidate: str, out: str) -> DataFrame:
        return self._run(df, [query, candidate], out, "double")


def posted(url: str, headers: dict[str, str], body: dict, timeout: float) -> dict:
    """The JSON answer to a JSON request."""
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


@dataclass(frozen=True)
class ApiBackend:
    """A chat service behind ``post(url, headers, body, timeout)``: bounded requests at once in each task, asked again after failures with doubling waits.

    A prompt's lines ``role: text`` are its turns. The credential is read on the executor, from the variable that the config names.
    """

    config: Generation
    post: Callable[[str, dict, dict, float], dict] = posted
    wait: float = 0.5

    def generate(self, df: DataFrame, prompt: str, out: str, seed: str | None = None) -> DataFrame:
        config, post, pause = self.config, self.post, self.wait
        api = config.api
        if api is None or not api.url:
            raise ValueError("config.api needs a url")

        def one(text: str, own) -> str:
            headers = {"Authorization": os.environ[api.authorization]} if api.authorization else {}
            body = config.body(turns_of(text)) | ({} if own is None or own != own else {"seed": int(own)})
            for attempt in range(api.retries + 1):
                try:
                    return post(api.url, headers, body, api.timeout_sec)["choices"][0]["message"]["content"]
                except OSError:
                    if attempt == api.retries:
                        raise
                    time.sleep(pause * 2**attempt)
            raise AssertionError("unreachable")

        def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(api.concurrency) as pool:
                for frame in frames:
                    owns = frame[seed].tolist() if seed else [None] * len(frame)
                    yield frame.assign(**{out: list(pool.map(one, frame[prompt].tolist(), owns))})

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        return df.mapInPandas(each, f"{schema}, `{out}` string")

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        raise ValueError("a chat service doesn't embed")

    def classify(self, df: DataFrame, query: str, candidate: str, out: str) -> DataFrame:
        raise ValueError("a chat service doesn't classify")


_TURN = re.compile(r"^(system|user|assistant): ", re.M)


def turns_of(text: str) -> list[dict]:
    """The turns of a prompt text; text without roles is one turn of the user."""
    parts = _TURN.split(text)
    if len(parts) < 3 or parts[0]:
        return [{"role": "user", "content": text}]
    turns = [{"role": r, "content": c.removesuffix("\n")} for r, c in zip(parts[1::2], parts[2::2], strict=True)]
    turns[-1]["content"] = parts[-1]
    return turns


DIGEST = DigestBackend()


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
