"""Models behind an HTTP interface, as callables of a prompt. What posts is given by the caller, so that tests need no network.

post(url, headers, body) gives (status, lines of the response); a client is pickled into tasks with it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

Post = Callable[[str, dict[str, str], bytes], tuple[int, Iterable[bytes]]]


def over_http(url: str, headers: dict[str, str], body: bytes) -> tuple[int, Iterable[bytes]]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, body, {"Content-Type": "application/json", **headers}), timeout=300) as r:
            return r.status, r.read().splitlines()
    except HTTPError as e:
        return e.code, e.read().splitlines()


@dataclass
class _Client:
    base: str
    model: str
    key: str = ""
    most: int = 4096
    post: Post = over_http

    def __call__(self, prompt: str) -> str:
        return "".join(self.stream("", [{"role": "user", "content": prompt}]))

    def stream(self, system: str, messages: list[dict]) -> Iterator[str]:
        """The answer's pieces, as they come."""
        status, lines = self.post(self.base.rstrip("/") + self.path, self.headers(), json.dumps(self.body(system, messages)).encode())
        if status != 200:
            raise RuntimeError(f"status {status}: {b' '.join(lines)[:500].decode(errors='replace')}")
        for line in lines:
            text = line.decode().strip()
            text = text.removeprefix("data:").strip() if text.startswith("data:") else "" if self.events else text
            if text and text != "[DONE]":
                piece = self.piece(json.loads(text))
                if piece:
                    yield piece

    path, events = "", True

    def headers(self) -> dict[str, str]:
        return {"Authorization": f"Bearer {self.key}"} if self.key else {}


class Messages(_Client):
    """Servers of a messages interface: the system text beside the messages, events with deltas of text."""

    path = "/v1/messages"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key, "anthropic-version": "2023-06-01"}

    def body(self, system: str, messages: list[dict]) -> dict:
        return {"model": self.model, "max_tokens": self.most, "stream": True, "messages": messages} | ({"system": system} if system else {})

    def piece(self, event: dict) -> str:
        if event.get("type") == "error":
            raise RuntimeError(str(event.get("error")))
        return event.get("delta", {}).get("text", "") if event.get("type") == "content_block_delta" else ""


class Completions(_Client):
    """Servers of a chat completions interface: the system text is the first message, events with choices."""

    path = "/v1/chat/completions"

    def body(self, system: str, messages: list[dict]) -> dict:
        return {"model": self.model, "stream": True, "messages": ([{"role": "system", "content": system}] if system else []) + messages}

    def piece(self, event: dict) -> str:
        return "".join((c.get("delta") or {}).get("content") or "" for c in event.get("choices", ()))


class Local(_Client):
    """A server on the same machine that answers in lines of JSON."""

    path, events = "/api/chat", False

    def body(self, system: str, messages: list[dict]) -> dict:
        return {"model": self.model, "stream": True, "messages": ([{"role": "system", "content": system}] if system else []) + messages}

    def piece(self, event: dict) -> str:
        if event.get("error"):
            raise RuntimeError(event["error"])
        return (event.get("message") or {}).get("content", "")
