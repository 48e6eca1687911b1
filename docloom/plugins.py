"""What a deployment plugs in, and deterministic stand-ins that need no model and no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from functools import cache
from typing import NamedTuple, Protocol

import numpy as np


class Embedder(Protocol):
    """Made once in each Python worker; must pickle."""

    dimension: int

    def embed(self, texts: list[str], task: str) -> np.ndarray: ...


class Reranker(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class LLMClient(Protocol):
    """Deterministic at temperature 0; retries are the client's, not Spark's."""

    def complete(self, prompt: str) -> str: ...


class Fetched(NamedTuple):
    content_type: str | None
    body: bytes | None
    error: str | None


class Fetcher(Protocol):
    def fetch(self, url: str) -> Fetched: ...


class PageTextExtractor(Protocol):
    """Text of each page of a document; None where only OCR could tell."""

    def pages(self, content: bytes) -> Iterable[str | None]: ...

    def ocr(self, content: bytes, page: int) -> str: ...


@cache
def _made(make: Callable, args: tuple):
    return make(*args)


class PerWorker:
    """A plug-in that isn't sent to the tasks: each worker makes its own on first use and keeps it, as a loaded model.

    `make` is a class or function that a worker can import, `args` are hashable.
    """

    def __init__(self, make: Callable, *args):
        self.make, self.args = make, args

    def __getattr__(self, name: str):
        if name.startswith("__") or name in ("make", "args"):
            raise AttributeError(name)
        return getattr(_made(self.make, self.args), name)


class HashingEmbedder:
    """Signed feature hashing of words, unit length; queries and passages alike."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def embed(self, texts: list[str], task: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for row, text in zip(out, texts):
            for word in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimension] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


class OverlapReranker:
    """Share of the query's distinct words that the document has."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        words = lambda t: set(re.findall(r"\w+", t.lower()))
        return [len(q & words(d)) / max(1, len(q)) for q, d in ((words(a), b) for a, b in pairs)]


class FirstContextLLM:
    """Answers with the first context's first words and its citation."""

    def complete(self, prompt: str) -> str:
        found = re.search(r"^\[(\d+)\] (.{0,200})", prompt, re.M)
        return f"{found[2].strip()} [{found[1]}]" if found else "؟"


class FixedJudge:
    """A verdict that is the same for every prompt."""

    def complete(self, prompt: str) -> str:
        return json.dumps({"faithfulness": {"score": 5, "passed": True, "unsupported_claims": [], "notes": ""}, "relevance": {"score": 4, "notes": ""}, "correctness": {"score": 5, "critical_error": False, "notes": ""}, "fluency": {"score": 5, "notes": ""}})


class TableFetcher:
    """Pages from a mapping address -> (content type, body)."""

    def __init__(self, pages: dict[str, tuple[str, bytes]]):
        self.pages = pages

    def fetch(self, url: str) -> Fetched:
        got = self.pages.get(url)
        return Fetched(*got, None) if got else Fetched(None, None, "not found")


class HttpFetcher:
    """HTTP GET with a browser-like agent; anything that fails is an error in the row, not an exception."""

    def __init__(self, timeout: float = 12.0, strict: bool = False, agent: str = "Mozilla/5.0 (compatible; collection builder)"):
        self.timeout, self.strict, self.agent = timeout, strict, agent

    def fetch(self, url: str) -> Fetched:
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as r:
                return Fetched(r.headers.get("Content-Type"), r.read(), None)
        except urllib.error.HTTPError as e:
            return Fetched(None, None, f"HTTP {e.code}") if self.strict else Fetched(e.headers.get("Content-Type"), e.read(), None)
        except (OSError, ValueError) as e:
            return Fetched(None, None, str(e))


class FormFeedText:
    """UTF-8 text whose pages are divided by form feeds: stands in for a document reader; blank pages ask for OCR."""

    def pages(self, content: bytes) -> Iterable[str | None]:
        return [p if re.search("(?:[ء-ي][^ء-ي]*){6}", p) else None for p in content.decode("utf-8", "replace").split("\f")]

    def ocr(self, content: bytes, page: int) -> str:
        return content.decode("utf-8", "replace").split("\f")[page]
