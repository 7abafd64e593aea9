"""Language models as functions from text to text, run over the partitions of a table of prompts."""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Model(Protocol):
    """Anything that can be sent to executors and answers prompts in order."""

    name: str

    def generate_batch(self, prompts: list[str], max_tokens: int | None = None) -> list[str]: ...


@dataclass
class StubModel:
    """Answers the same prompt the same way without any network: names that stand capitalized become entities."""

    name: str = "stub"

    def generate_batch(self, prompts: list[str], max_tokens: int | None = None) -> list[str]:
        return [self._one(p) for p in prompts]

    def _one(self, prompt: str) -> str:
        if re.search(r"\nAnswer:?\s*$", prompt):
            return f";{'ABCD'[hashlib.sha256(prompt.encode()).digest()[0] % 4]};"
        target = prompt.rsplit("TARGET:", 1)[-1]
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{2,}\b", target)))[:5]
        return json.dumps({"context_summary": f"{len(target.split())} words", "entities": [{"name": n, "type": "concept"} for n in names]})


@dataclass
class EndpointModel:
    """An OpenAI-compatible chat service. Requests of a partition run in threads; an empty or cut answer counts as a failure.

    Endpoints take turns by prompt; the key is read from the named environment variable on the executor.
    """

    name: str
    urls: tuple[str, ...]
    key_variable: str = ""
    concurrency: int = 8
    retries: int = 3
    timeout: float = 600.0
    temperature: float = 0.2

    def _call(self, prompt: str, max_tokens: int | None) -> str:
        url = self.urls[int.from_bytes(hashlib.sha256(prompt.encode()).digest()[:4], "big") % len(self.urls)]
        body = {"model": self.name, "temperature": self.temperature, "messages": [{"role": "user", "content": prompt}]} | ({"max_tokens": max_tokens} if max_tokens else {})
        headers = {"Content-Type": "application/json"}
        if self.key_variable:
            headers["Authorization"] = f"Bearer {os.environ[self.key_variable]}"
        for attempt in range(self.retries + 1):
            try:
                request = urllib.request.Request(url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    choice = json.load(answer)["choices"][0]
                if not choice["message"]["content"] or choice.get("finish_reason") == "length":
                    raise ValueError("empty or cut answer")
                return choice["message"]["content"]
            except Exception:
                if attempt == self.retries:
                    raise
                time.sleep(2**attempt)
        raise AssertionError

    def generate_batch(self, prompts: list[str], max_tokens: int | None = None) -> list[str]:
        with ThreadPoolExecutor(self.concurrency) as pool:
            return list(pool.map(lambda p: self._call(p, max_tokens), prompts))


def answer(prompts: DataFrame, model: Model, prompt: str = "prompt", max_tokens: int | None = None, attempts: int = 3) -> DataFrame:
    """``prompts`` with ``response`` and ``error``: a prompt that fails alone ``attempts`` times gets an error, its neighbours don't."""
    names = [c for c in prompts.columns if c not in ("response", "error")]

    def safe(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(r, None) for r in model.generate_batch(texts, max_tokens)]
        except Exception:
            out: list[tuple[str | None, str | None]] = []
            for t in texts:
                said = ""
                for _ in range(attempts):
                    try:
                        out.append((model.generate_batch([t], max_tokens)[0], None))
                        break
                    except Exception as e:
                        said = f"{type(e).__name__}: {e}"
                else:
                    out.append((None, said))
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = safe(part.column(prompt).to_pylist())
                said = [pa.array([m[i] for m in made], pa.string()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *said], names=[*names, "response", "error"])

    schema = T.StructType([*(prompts.schema[n] for n in names), T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])
    return prompts.mapInArrow(run, schema)


def ordinal(key: str, n: int):
    """Which of n workers or endpoints a row falls to."""
    return F.pmod(F.xxhash64(key), F.lit(n))
