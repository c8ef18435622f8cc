"""Models behind protocols: completions and embeddings, with deterministic offline ones.

A provider is a plain object that is sent to the workers with the query; one object serves a
partition. Prompts and replies are text, and usage comes back as columns.
"""

from __future__ import annotations

import hashlib
import json
import re
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.errors import ProviderError
from fieldloom.functions.plain import tokens

Message = dict[str, str]
Json = dict[str, Any]

ROUTES = {
    "openai": ("https://api.openai.com/v1", "OPENAI_API_KEY"),
    "ollama": ("http://localhost:11434/v1", ""),
    "mistral": ("https://api.mistral.ai/v1", "MISTRAL_API_KEY"),
}


@dataclass(frozen=True)
class Reply:
    content: str
    input_tokens: int
    output_tokens: int
    model: str


class LLMClient(Protocol):
    def complete(self, messages: Sequence[Message], *, schema: Json | None = None, temperature: float = 0.0) -> Reply: ...


class EmbeddingClient(Protocol):
    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]: ...


def resolve_provider(model: str, base_url: str | None = None, key_name: str | None = None) -> tuple[str, str, str]:
    """Model, base address and the environment variable of its key; a known ``provider/`` prefix fills in the rest."""
    head, sep, rest = model.partition("/")
    if sep and head in ROUTES:
        url, name = ROUTES[head]
        return rest, base_url or url, name if key_name is None else key_name
    return model, base_url or ROUTES["openai"][0], ROUTES["openai"][1] if key_name is None else key_name


def _said(message: Json, schema: Json | None) -> str:
    """The text of a reply, or the arguments of the function that it calls."""
    if not message.get("tool_calls"):
        return message.get("content") or ""
    text = message["tool_calls"][0]["function"]["arguments"]
    if (schema or {}).get("type") != "object":  # a list travels as the one argument of a function
        try:
            return json.dumps(json.loads(text)["items"])
        except (ValueError, TypeError, KeyError):
            pass
    return text


@dataclass
class HttpClient:
    """A server that speaks the common chat-completions protocol.

    Structured replies are asked for as a JSON schema, then as a JSON object, then as the arguments
    of a function, then as plain text, whichever the server takes first. Rate limits and server errors are tried again
    after 1, 2, 4 … seconds; other errors aren't.
    """

    model: str
    base_url: str | None = None
    api_key: str = ""
    max_retries: int = 3
    timeout: float = 120.0
    sleep: Callable[[float], None] = time.sleep
    #: Tokens of the last ``embed``, as the server counts them.
    embedded_tokens: int | None = field(default=None, repr=False, compare=False)

    def _post(self, path: str, body: Json) -> Json:
        model, url, _ = resolve_provider(self.model, self.base_url)
        data = json.dumps({"model": model, **body}).encode()
        headers = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})}
        for attempt in range(self.max_retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url + path, data, headers), timeout=self.timeout) as r:
                    return json.loads(r.read())
            except urllib.error.HTTPError as e:
                text = e.read().decode(errors="replace")
                again = e.code == 429 or e.code >= 500 or re.search("rate.?limit", text, re.I) is not None
                if not again or attempt == self.max_retries:
                    raise ProviderError(f"HTTP {e.code}: {text[:200]}", again) from e
            except (urllib.error.URLError, TimeoutError) as e:
                if attempt == self.max_retries:
                    raise ProviderError(str(e), True) from e
            self.sleep(2.0**attempt)
        raise AssertionError

    def complete(self, messages: Sequence[Message], *, schema: Json | None = None, temperature: float = 0.0) -> Reply:
        base = {"messages": list(messages), "temperature": temperature}
        ways: list[Json] = [{}]
        if schema is not None:
            tool = {"type": "function", "function": {"name": "reply", "parameters": schema if schema.get("type") == "object" else {"type": "object", "properties": {"items": schema}}}}
            ways = [
                {"response_format": dict(type="json_schema", json_schema=dict(schema=schema, name="reply"))},
                {"response_format": {"type": "json_object"}},
                {"tools": [tool], "tool_choice": {"type": "function", "function": {"name": "reply"}}}, {},
            ]
        for k, way in enumerate(ways):
            try:
                got = self._post("/chat/completions", base | way)
            except ProviderError as e:
                if e.retryable or k == len(ways) - 1:
                    raise
                continue
            used = got.get("usage") or {}
            return Reply(_said(got["choices"][0]["message"], schema), int(used.get("prompt_tokens", 0)), int(used.get("completion_tokens", 0)), self.model)
        raise AssertionError

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out: list[list[float]] = []
        used: list[int | None] = []
        for a in range(0, len(texts), 2048):
            got = self._post("/embeddings", {"input": list(texts[a : a + 2048])})
            out += [d["embedding"] for d in sorted(got["data"], key=lambda d: d["index"])]
            used.append((got.get("usage") or {}).get("prompt_tokens"))
        self.embedded_tokens = None if None in used else sum(used)
        return out


def in_flight(call: Callable[[Any], Any], items: Sequence[Any], at_once: int) -> list[Any]:
    """``call`` of each item, up to ``at_once`` of them at a time, in their order."""
    if at_once <= 1 or len(items) <= 1:
        return [call(x) for x in items]
    with ThreadPoolExecutor(min(at_once, len(items))) as pool:
        return list(pool.map(call, items))


class _Sums(AccumulatorParam):
    """Sums of tuples by key: as many as there are stages and models, whatever the number of calls."""

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            a[k] = tuple(x + y for x, y in zip(a[k], v)) if k in a else v
        return a


class Meter:
    """What calls of any stage cost, on the driver and in tasks: an accumulator of calls, tokens and milliseconds.

    A task that is run again makes its calls again, and they count again.
    """

    SCHEMA = "call_ord bigint, stage string, model string, calls int, input_tokens bigint, output_tokens bigint, latency_ms double"

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.sums = spark.sparkContext.accumulator({}, _Sums())

    def client(self, client: LLMClient, stage: str) -> MeteredClient:
        return MeteredClient(client, stage, self.sums)

    def embeddings(self, client: EmbeddingClient, stage: str) -> MeteredEmbeddings:
        return MeteredEmbeddings(client, stage, self.sums)

    def rows(self) -> list[tuple]:
        found = sorted(self.sums.value.items())
        return [(k, stage, model, int(n), int(i), int(o), float(ms)) for k, ((stage, model), (n, i, o, ms)) in enumerate(found)]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows(), self.SCHEMA)


@dataclass
class MeteredClient:
    """A client whose calls a meter counts, also those that fail."""

    client: LLMClient
    stage: str
    sums: Any

    def complete(self, messages: Sequence[Message], *, schema: Json | None = None, temperature: float = 0.0) -> Reply:
        began, reply = time.perf_counter(), None
        try:
            reply = self.client.complete(messages, schema=schema, temperature=temperature)
            return reply
        finally:
            used = (reply.input_tokens, reply.output_tokens) if reply else (0, 0)
            with _METERED:
                self.sums.add({(self.stage, reply.model if reply else "failed"): (1, *used, 1000 * (time.perf_counter() - began))})


_METERED = threading.Lock()


@dataclass
class MeteredEmbeddings:
    """Embeddings whose calls a meter counts: the tokens that the server names, else four characters each."""

    client: EmbeddingClient
    stage: str
    sums: Any

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        began = time.perf_counter()
        out = self.client.embed(texts)
        used = getattr(self.client, "embedded_tokens", None)
        used = sum(map(tokens, texts)) if used is None else used
        with _METERED:
            self.sums.add({(self.stage, getattr(self.client, "model", type(self.client).__name__)): (1, used, 0, 1000 * (time.perf_counter() - began))})
        return out


@dataclass
class LocalEmbeddings:
    """Embeddings by a model on the workers' own machines; needs the sentence-transformers library there."""

    model: str = "all-MiniLM-L6-v2"
    batch_size: int = 64
    _loaded: Any = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> Json:
        return {**self.__dict__, "_loaded": None}  # each worker loads its own

    def embed(self, texts: Sequence[str]) -> Sequence[Sequence[float]]:
        if self._loaded is None:
            try:
                from sentence_transformers import SentenceTransformer
            except ImportError as e:
                raise ProviderError("local embeddings need the sentence-transformers library") from e
            self._loaded = SentenceTransformer(self.model)
        return self._loaded.encode(list(texts), batch_size=self.batch_size, show_progress_bar=False)


@dataclass
class CannedClient:
    """Replies from a list, over and over; the same prompt always gets the same one."""

    replies: Sequence[str]
    input_tokens: int = 100
    output_tokens: int = 50
    by_order: bool = False
    calls: list[list[Message]] = field(default_factory=list)

    def complete(self, messages: Sequence[Message], *, schema: Json | None = None, temperature: float = 0.0) -> Reply:
        k = len(self.calls) if self.by_order else int.from_bytes(hashlib.sha256(messages[-1]["content"].encode()).digest()[:4], "big")
        self.calls.append(list(messages))
        return Reply(self.replies[k % len(self.replies)], self.input_tokens, self.output_tokens, "canned")


@dataclass
class RuleClient:
    """An offline model: a function from the last message to the reply."""

    rule: Callable[[str], str]
    model: str = "rules"

    def complete(self, messages: Sequence[Message], *, schema: Json | None = None, temperature: float = 0.0) -> Reply:
        prompt = messages[-1]["content"]
        text = self.rule(prompt)
        return Reply(text, sum(tokens(m["content"]) + 4 for m in messages), tokens(text), self.model)


@dataclass
class HashEmbeddings:
    """Offline embeddings: hashed character trigrams, so that similar spellings are close; the same on every machine."""

    dim: int = 64

    def embed(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            s = f"  {(t or '').lower()} "
            for k in range(len(s) - 2):
                h = int.from_bytes(hashlib.blake2b(s[k : k + 3].encode(), digest_size=8).digest(), "big")
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        return out


def embed_column(client: EmbeddingClient) -> Callable[[Column], Column]:
    """Text to ``array<float>``, in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            vectors = client.embed([t or "" for t in s])
            yield pd.Series([[float(x) for x in v] for v in vectors])

    return run


def embed_distinct(texts: DataFrame, client: EmbeddingClient, text_col: str = "text", out: str = "embedding") -> DataFrame:
    """``(text, embedding)``: each distinct text is embedded once."""
    return texts.where(F.col(text_col).isNotNull()).select(text_col).distinct().withColumn(out, embed_column(client)(F.col(text_col)))


def complete_rows(prompts: DataFrame, client: LLMClient, key_cols: Sequence[str], prompt_col: str = "prompt", schema: Json | None = None) -> DataFrame:
    """``key_cols`` with ``reply, input_tokens, output_tokens, model, error``: one call a row; a failed call is an error text."""
    kinds = {f.name: f.dataType.simpleString() for f in prompts.schema.fields}
    out_schema = ", ".join(f"`{c}` {kinds[c]}" for c in key_cols) + ", reply string, input_tokens bigint, output_tokens bigint, model string, error string"
    keys = list(key_cols)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for prompt in pdf[prompt_col]:
                try:
                    r = client.complete([{"role": "user", "content": prompt or ""}], schema=schema)
                    rows.append((r.content, r.input_tokens, r.output_tokens, r.model, None))
                except ProviderError as e:
                    rows.append((None, 0, 0, None, str(e)))
            got = pd.DataFrame(rows, columns=["reply", "input_tokens", "output_tokens", "model", "error"], index=pdf.index)
            yield pd.concat([pdf[keys], got], axis=1)

    return prompts.select(*keys, prompt_col).mapInPandas(run, out_schema)
