"""Clients of model servers over HTTP, made in each task from a configuration.

``completions`` speaks the widespread chat-completions protocol (local servers), ``messages`` the one
where the system prompt is a field of its own.  Both use the standard library alone.
"""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from medloom.config import ModelConfig, ServerConfig
from medloom.operators.extraction import Breaker, RoundRobin, strip_reasoning

TIMEOUT_SECONDS = 600


def _post(url: str, headers: dict[str, str], body: dict[str, Any], seconds: float = TIMEOUT_SECONDS) -> dict[str, Any]:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=seconds) as answer:  # noqa: S310  the address is the project's own setting
        return json.load(answer)


@dataclass
class _Client:
    model: str
    base_url: str
    api_key: str = "none"
    max_tokens: int = 8000
    temperature: float = 0.0
    usage: dict[str, int] = field(default_factory=dict)
    seconds: float = TIMEOUT_SECONDS

    def generate(self, prompt: str, system: str = "", max_tokens: int | None = None, temperature: float | None = None) -> str:
        chosen = (self.max_tokens if max_tokens is None else max_tokens, self.temperature if temperature is None else temperature)
        text, used = self._ask(prompt, system, *chosen)
        for name, n in used.items():
            if isinstance(n, int):
                self.usage[name] = self.usage.get(name, 0) + n
        return text

    def _ask(self, prompt: str, system: str, max_tokens: int, temperature: float) -> tuple[str, dict[str, Any]]:
        raise NotImplementedError


class Completions(_Client):
    """``POST {base_url}/chat/completions``; reasoning before the final answer is cut off."""

    def _ask(self, prompt: str, system: str, max_tokens: int, temperature: float) -> tuple[str, dict[str, Any]]:
        turns = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
        answer = _post(f"{self.base_url.rstrip('/')}/chat/completions", {"authorization": f"Bearer {self.api_key}"}, {"model": self.model, "messages": turns, "max_tokens": max_tokens, "temperature": temperature}, self.seconds)
        return strip_reasoning(answer["choices"][0]["message"]["content"] or ""), answer.get("usage") or {}


class Messages(_Client):
    """``POST {base_url}/v1/messages``; the answer's text blocks are joined."""

    def _ask(self, prompt: str, system: str, max_tokens: int, temperature: float) -> tuple[str, dict[str, Any]]:
        body: dict[str, Any] = {"model": self.model, "max_tokens": max_tokens, "messages": [{"role": "user", "content": prompt}]}
        if system:
            body["system"] = system
        if temperature > 0:
            body["temperature"] = temperature
        answer = _post(f"{self.base_url.rstrip('/')}/v1/messages", {"x-api-key": self.api_key, "anthropic-version": "2023-06-01"}, body, self.seconds)
        return "".join(x["text"] for x in answer["content"] if x["type"] == "text"), answer.get("usage") or {}


def server_addresses(servers: ServerConfig) -> list[str]:
    """One address for each group of devices, on ports from ``base_port`` on."""
    return [f"http://localhost:{servers.base_port + k}/v1" for k in range(len(servers.gpus) // max(1, servers.gpus_per_server))]


def client(config: ModelConfig, addresses: Sequence[str] = ()) -> Any:
    """A client for the configured provider; several addresses take turns."""
    options = {"model": config.model, "api_key": config.key(), "max_tokens": config.max_tokens, "temperature": config.temperature}
    if config.provider == "anthropic":
        return Messages(base_url=config.base_url or "https://api.anthropic.com", **options)
    if config.provider != "openai":
        raise ValueError(f"no client for the provider {config.provider!r}")
    if addresses:
        return RoundRobin([Breaker(Completions(base_url=x, **options)) for x in addresses])
    return Completions(base_url=config.base_url or "http://localhost:8000/v1", **options)


def factory(config: ModelConfig, servers: ServerConfig | None = None) -> Callable[[int], Any] | None:
    """What makes a client in each task, which begins with the server of its number; None if no model is named."""
    if not config.model:
        return None
    found = server_addresses(servers) if servers and servers.gpus and config.provider == "openai" else []

    def make(task: int) -> Any:
        at = task % len(found) if found else 0
        return client(config, found[at:] + found[:at])

    return make
