"""Language-model clients, made where they are used: inside a partition, never shipped."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prompts import read_config

# Models that are known by name, and their interfaces.
API_CONFIGS = {"google": {"url": "https://generativelanguage.googleapis.com/v1beta/openai/", "key": "YOUR-API-KEY"}}
MODELS = {
    "llama3.1:8b": {"api": "ollama"},
    "qwen3:4b": {"api": "ollama"},
    "qwen3:8b": {"api": "ollama"},
    "gemma-3-27b-it": {"api": "openai", "api_config": "google"},
    "gemma-3-12b-it": {"api": "openai", "api_config": "google"},
    "gemma-3-4b-it": {"api": "openai", "api_config": "google"},
}
LABELS_SCHEMA = {
    "type": "object",
    "properties": {"labels": {"type": "array", "items": {"type": "object", "properties": {"row_id": {"type": "integer"}, "is_error": {"type": "boolean"}}, "required": ["row_id", "is_error"]}}},
    "required": ["labels"],
}


def post(url: str, body: dict | None, headers: dict | None = None, timeout: float = 30) -> dict:
    data = None if body is None else json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json"} | (headers or {}))  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


class Client:
    """chat(messages) and generate(prompt); the constructor raises ValueError if the model isn't there."""

    def __init__(self, model: str):
        self.model, self.total_tokens, self.total_time = model, 0, 0.0
        if not self.available():
            raise ValueError(f"model {model} is not available")

    def available(self) -> bool:
        return True

    def chat(self, messages: list[dict], **how) -> str:
        raise NotImplementedError

    def generate(self, prompt: str, **how) -> str:
        return self.chat([{"role": "user", "content": prompt}], **how)

    def model_name(self) -> str:
        return self.model

    def usage(self) -> dict:
        return {"total_tokens": self.total_tokens, "total_time": self.total_time}


class OllamaClient(Client):
    def __init__(self, model: str = "llama3.1:8b", url: str = "http://localhost:11434"):
        self.url = url
        super().__init__(model)

    def available(self) -> bool:
        try:
            return self.model in [m["name"] for m in post(f"{self.url}/api/tags", None)["models"]]
        except OSError:
            return False

    def chat(self, messages: list[dict], **how) -> str:
        return post(f"{self.url}/api/chat", {"model": self.model, "messages": messages, "stream": False, **how})["message"]["content"]

    def generate(self, prompt: str, **how) -> str:
        return post(f"{self.url}/api/generate", {"model": self.model, "prompt": prompt, "stream": False, **how})["response"]


class OpenAIClient(Client):
    def __init__(self, model: str, url: str, key: str, measure: bool = False):
        self.url, self.key, self.measure = url, key, measure
        super().__init__(model)

    def _ask(self, path: str, body: dict | None = None) -> dict:
        return post(f"{self.url.rstrip('/')}/{path}", body, {"Authorization": f"Bearer {self.key}"})

    def available(self) -> bool:
        try:
            return bool(self._ask(f"models/{urllib.parse.quote(self.model, safe='')}"))
        except (OSError, ValueError):  # unreachable, refused, or not JSON
            return False

    def chat(self, messages: list[dict], response_format: dict | None = None, **how) -> str:
        """response_format: a JSON schema that the answer must follow."""
        start = time.time()
        if response_format:
            how |= {"response_format": {"type": "json_schema", "json_schema": {"name": response_format.get("title", "answer"), "schema": response_format, "strict": True}}}
        answer = self._ask("chat/completions", {"model": self.model, "messages": messages, **how})
        if self.measure:
            self.total_tokens += answer.get("usage", {}).get("total_tokens", 0)
            self.total_time += time.time() - start
        return answer["choices"][0]["message"]["content"]


REGISTRY: dict[str, Callable[..., Client]] = {"ollama": OllamaClient, "openai": OpenAIClient}


def create(api: str, model: str, **how) -> Client:
    if api not in REGISTRY:
        raise ValueError(f"unknown api {api}")
    if api == "openai" and not (how.get("url") and how.get("key")):
        raise ValueError("an openai client needs url and key")
    return REGISTRY[api](model, **how)


class Factory:
    """Clients from a table of models; arguments given here win over the table, which wins over its api_config.

    config: the table, or the path of a YAML or JSON file that holds it; without it, the models known by name.
    """

    def __init__(self, config: dict | str | None = None):
        self.config = config
        self.reload_config()

    def reload_config(self) -> None:
        """Read the file again. A missing file is a FileNotFoundError, one that can't be read a ValueError."""
        table = read_config(self.config) if isinstance(self.config, str) else self.config or {}
        self.apis, self.models = table.get("api_configs", API_CONFIGS), table.get("models", MODELS)

    def settings(self, model: str, **override) -> dict:
        if model not in self.models:
            raise KeyError(model)
        own = dict(self.models[model])
        shared = self.apis.get(own.pop("api_config", None), {})
        return {k: v for k, v in shared.items() if k in ("url", "key")} | own | override

    def create(self, model: str, **override) -> Client:
        return create(model=model, **self.settings(model, **override))

    def api_config(self, name: str) -> dict:
        return self.apis.get(name, {})

    def available_models(self) -> dict[str, str]:
        """The interface of each model."""
        return {m: c["api"] for m, c in self.models.items()}

    def models_by_api(self, api: str) -> list[str]:
        return [m for m, c in self.models.items() if c["api"] == api]


def call_policy(api: str) -> tuple[dict, float]:
    """Arguments of a call, and seconds to wait after it."""
    if api == "ollama":
        return {"think": False, "format": LABELS_SCHEMA, "options": {"temperature": 0, "seed": 42}}, 0.0
    if api == "openai":
        return {"temperature": 0}, 10.0
    return {}, 0.0


def respond(prompts: DataFrame, make: Callable[[], Client], how: dict | None = None, wait: float = 0.0) -> DataFrame:
    """``prompts`` (with a column prompt) plus response, tokens and seconds. One client a partition.

    A metered interface allows one call at a time: its prompts go to one partition, few as they are
    (k / batch size a column), so give it those of all columns together. The result is lazy: each action
    on it sends the prompts again, so write it before use.
    """
    how = how or {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for frame in frames:
            out = []
            for p in frame["prompt"]:
                start, before = time.time(), client.total_tokens
                text = client.generate(p, **how)
                out.append((text, client.total_tokens - before, time.time() - start))
                time.sleep(wait)
            yield frame.assign(response=[o[0] for o in out], tokens=[o[1] for o in out], seconds=[o[2] for o in out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)
    return (prompts.repartition(1) if wait else prompts).mapInPandas(run, f"{fields}, response string, tokens long, seconds double")


def usage(responses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., n_prompts, total_tokens, total_time) of responses."""
    totals = [F.count("*").alias("n_prompts"), F.sum("tokens").alias("total_tokens"), F.sum("seconds").alias("total_time")]
    return responses.groupBy(*by).agg(*totals) if by else responses.agg(*totals)
