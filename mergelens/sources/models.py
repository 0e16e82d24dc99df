"""Model providers that the configuration names: chat endpoints over HTTP, and recorded answers."""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from mergelens.operators.agent import Provider, fixture_provider
from mergelens.schemas import FIXTURES
from mergelens.sources.config import ConfigError, is_local

TIMEOUT_S = 60
ANSWER_BYTES = 8 << 20
# Names in the configuration, and where such a server listens if no address is given.
LOCAL_SERVERS = {"ollama": "http://localhost:11434", "llamacpp": "http://localhost:8080", "llama.cpp": "http://localhost:8080", "llama_cpp": "http://localhost:8080"}
REMOTE_NAMES = ("openai", "openai-compatible", "remote")

#: What opens a request: (request, timeout) to a response with ``status`` and ``read(n)``.
Opener = Callable[..., Any]


class ModelError(RuntimeError):
    """An endpoint gave no usable answer."""


@dataclass(frozen=True)
class Request:
    prompt: str
    system: str = ""
    model: str = ""
    max_tokens: int = 0
    temperature: float = 0.0


@dataclass(frozen=True)
class Answer:
    text: str
    model: str
    usage: Mapping[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class ChatEndpoint:
    """A server that speaks the chat-completions protocol."""

    base_url: str
    model: str
    key: str = ""
    opener: Opener = urllib.request.urlopen

    def _call(self, path: str, body: dict | None = None) -> tuple[int, bytes]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.base_url.rstrip("/") + path, data, headers)
        try:
            with self.opener(request, timeout=TIMEOUT_S) as got:
                return got.status, got.read(ANSWER_BYTES)
        except urllib.error.HTTPError as e:
            return e.code, e.read(ANSWER_BYTES)

    def available(self) -> bool:
        """Whether the server answers at all, be it that it wants a key."""
        try:
            return self._call("/v1/models")[0] < 500
        except (OSError, ValueError):
            return False

    def complete(self, request: Request) -> Answer:
        """Raises ModelError, or OSError where there is no connection."""
        said = [("system", request.system)] * bool(request.system) + [("user", request.prompt)]
        body: dict[str, Any] = {"model": request.model or self.model, "messages": [{"role": r, "content": c} for r, c in said]}
        body |= {k: v for k, v in (("max_tokens", request.max_tokens), ("temperature", request.temperature)) if v > 0}
        status, data = self._call("/v1/chat/completions", body)
        if status >= 400:
            raise ModelError(f"the endpoint answered {status}: {data.decode('utf-8', 'replace').strip()}")
        try:
            doc = json.loads(data)
            text = doc["choices"][0]["message"]["content"]
        except (ValueError, LookupError, TypeError) as e:
            raise ModelError(f"the answer is no completion: {e!r}") from e
        if not text:
            raise ModelError("the answer is empty")
        return Answer(text, body["model"], {k: v for k, v in (doc.get("usage") or {}).items() if isinstance(v, int)})


def load_fixtures(path: str) -> list[tuple[str, str, str]]:
    """(system, prompt, response) of a JSON array of recorded answers, in order. Raises OSError or ValueError."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if not isinstance(doc, list) or not all(isinstance(x, dict) for x in doc):
        raise ValueError(f"{path} holds no JSON array of objects")
    return [(x.get("system") or "", x.get("prompt") or "", x.get("response") or "") for x in doc]


def fixtures_frame(spark: SparkSession, path: str) -> DataFrame:
    """The same as a relation, for ``agent.lookup_fixtures``: model, system, prompt, response, ord."""
    return spark.createDataFrame([("", *x, k) for k, x in enumerate(load_fixtures(path))], FIXTURES)


def provider(settings: Mapping[str, Any], fixtures: Sequence[tuple[str, str, str]] = (), opener: Opener = urllib.request.urlopen) -> Provider:
    """The provider of one entry of ``providers``. Raises ConfigError for a name that stands for none."""
    name, model = str(settings.get("name") or "").strip().lower(), str(settings.get("model") or "")
    if name == "fixture":
        return fixture_provider(fixtures, name, model, is_local(dict(settings)))
    if name not in LOCAL_SERVERS and name not in REMOTE_NAMES:
        raise ConfigError(f"no such provider: {name!r}")
    key = os.environ.get(settings.get("api_key_env") or "", "") if name in REMOTE_NAMES else ""
    end = ChatEndpoint(str(settings.get("base_url") or "") or LOCAL_SERVERS.get(name, ""), model, key, opener)
    local = name in LOCAL_SERVERS or is_local(dict(settings))
    return Provider(name, model, local, lambda system, prompt: end.complete(Request(prompt, system)).text, end.available)


def providers(config: Mapping[str, Any]) -> list[Provider]:
    """All that the configuration names, in order; none is no error."""
    return [provider(p) for p in config["providers"] or []]
