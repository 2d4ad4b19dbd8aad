"""External models behind small interfaces, with deterministic offline stand-ins.

A provider object is shipped to the executors and used there for one partition at
a time. ``Resilient`` adds retries, a circuit breaker and a rate limit to any call.
What is wrong with a row itself is a ``ContentError``, which says nothing of the provider.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from .functions.text import EMPHASIS, FENCE
from .schemas import BETWEEN, CANDIDATE_CHARS, LEAD


class ProviderError(RuntimeError):
    """A provider could not answer."""


class ContentError(ProviderError):
    """A row that no provider can answer, or an answer of another form: asking again would not help."""


class CircuitOpen(ProviderError):
    """Too many failures in a row; calls are refused for a while."""


class Embedder(Protocol):
    dims: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Enricher(Protocol):
    def enrich(self, text: str) -> str:
        """JSON text with synthetic_title and hypothetical_questions."""


class Expander(Protocol):
    def expand(self, query: str) -> str:
        """JSON text with variants of sub_question and rephrasings."""


class Reranker(Protocol):
    def rerank(self, query: str, candidates: list[str], top: int) -> list[int]:
        """Numbers, from 1, of the relevant candidates, best first."""


@dataclass
class CircuitBreaker:
    """Opens after ``threshold`` failures in a row; after ``recovery`` seconds one call is tried."""

    threshold: int = 5
    recovery: float = 30.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None
    lock: threading.Lock = field(default_factory=threading.Lock)

    def rest(self) -> float:
        """Seconds until a call is let through again; 0 where the circuit is not open."""
        return 0.0 if self.opened is None else max(0.0, self.opened + self.recovery - self.clock())

    def before(self) -> None:
        if self.rest():
            raise CircuitOpen("the circuit is open")

    def after(self, ok: bool) -> None:
        with self.lock:
            if ok:
                self.failures, self.opened = 0, None
                return
            self.failures += 1
            if self.failures >= self.threshold:
                self.opened = self.clock()


@dataclass
class RateLimiter:
    """Spaces calls evenly. A job of n tasks gives each task ``rate / n``."""

    rate: float
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    next_at: float = field(default=-math.inf)
    lock: threading.Lock = field(default_factory=threading.Lock)

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next_at)
            self.next_at = at + 1.0 / self.rate
        if at > now:
            self.sleep(at - now)


def backoff(attempt: int, base: float = 0.5, most: float = 10.0, jitter: float = 0.1, rng: Callable[[], float] = random.random) -> float:
    """Seconds before attempt + 1: doubling from ``base`` up to ``most``, plus up to a tenth."""
    pause = min(most, base * 2 ** (attempt - 1))
    return pause * (1 + jitter * rng())


@dataclass
class Resilient:
    """Runs a call with retries, within a circuit breaker and a rate limit; the check is part of an attempt.

    The breaker counts one failure per call, after its last attempt. An open circuit is
    waited for, so that no call is refused for the failures of others. A ``ContentError``
    is raised at once: it isn't tried again and the breaker doesn't count it.
    """

    retries: int = 3
    breaker: CircuitBreaker = field(default_factory=CircuitBreaker)
    limiter: RateLimiter | None = None
    sleep: Callable[[float], None] = time.sleep

    def call(self, fn: Callable, *args, check: Callable | None = None):
        if rest := self.breaker.rest():
            self.sleep(rest)
        for attempt in range(1, self.retries + 1):
            if self.limiter:
                self.limiter.wait()
            try:
                answer = fn(*args)
                answer = check(answer) if check else answer
            except (ContentError, CircuitOpen):
                raise
            except Exception as e:
                if attempt == self.retries:
                    self.breaker.after(False)
                    raise ProviderError(str(e)) from e
                self.sleep(backoff(attempt))
            else:
                self.breaker.after(True)
                return answer


class Model(Protocol):
    def answer(self, prompt: str) -> str:
        """A text model's answer, JSON."""


@dataclass
class ModelReranker:
    """A text model that ranks: it is shown the query and the numbered candidates, each cut, and answers with ranked_indices."""

    model: Model

    def rerank(self, query: str, candidates: list[str], top: int) -> list[int]:
        numbered = BETWEEN.join(f'<candidate id="{i}">{c[:CANDIDATE_CHARS]}</candidate>' for i, c in enumerate(candidates, 1))
        found = parsed(self.model.answer(f"{LEAD[0]}{query}{LEAD[1]}{numbered}")).get("ranked_indices")
        if not isinstance(found, list) or not all(isinstance(i, int) and not isinstance(i, bool) for i in found):
            raise ValueError("no indices")
        return found


def parsed(answer: str) -> dict:
    """A model's JSON answer, an object, without code fence and emphasis; ValueError where it is none."""
    found = json.loads(re.sub(EMPHASIS, "", re.sub(FENCE, "", answer.strip()).strip()))
    if not isinstance(found, dict):
        raise ValueError("no object")
    return found


_WORD = re.compile(r"\w+")


@dataclass
class HashEmbedder:
    """Signed hashed word counts, scaled to length 1 (plain counts where the signed ones cancel out); a text without words is an error, as an empty vector."""

    dims: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v, plain = [0.0] * self.dims, [0.0] * self.dims
            for word in _WORD.findall(text.lower()):
                h = int.from_bytes(hashlib.md5(word.encode()).digest()[:8], "big")
                v[h % self.dims] += 1.0 if h >> 63 else -1.0
                plain[h % self.dims] += 1.0
            v = v if any(v) else plain
            size = math.sqrt(sum(x * x for x in v))
            if not size:
                raise ContentError("empty vector")
            out.append([x / size for x in v])
        return out


class LeadEnricher:
    """The first words as title, without emphasis around them, and questions that quote the following ones.

    What else looks like emphasis is the text's own and written as escapes, which no reader of answers strips.
    """

    def enrich(self, text: str) -> str:
        words = text.split()
        lead = " ".join(words[:8])
        questions = [f"{' '.join(words[i * 5 : i * 5 + 5]) or text.strip()}?" for i in range(3)]
        made = json.dumps({"synthetic_title": lead.strip("_*") or lead, "hypothetical_questions": questions}, ensure_ascii=False)
        return made.replace("_", "\\u005f").replace("*", "\\u002a")


class SameQuery:
    """No expansion: the query itself."""

    def expand(self, query: str) -> str:
        return json.dumps({"variants": [{"sub_question": query, "rephrasings": []}]}, ensure_ascii=False)


class OverlapReranker:
    """Candidates by the number of distinct words that they share with the query; ties keep their order."""

    def rerank(self, query: str, candidates: list[str], top: int) -> list[int]:
        wanted = set(_WORD.findall(query.lower()))
        shared = [len(wanted & set(_WORD.findall(c.lower()))) for c in candidates]
        return sorted((i + 1 for i, n in enumerate(shared) if n), key=lambda i: (-shared[i - 1], i))[:top]


@dataclass
class LetterEmbedder:
    """Counts of the first ``dims`` letters of the Latin alphabet; a text without any is an error."""

    dims: int = 26

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = [[float(t.lower().count(chr(97 + i))) for i in range(self.dims)] for t in texts]
        if not all(map(any, out)):
            raise ContentError("empty vector")
        return out


class QuoteEnricher:
    """A title and three questions that quote the text's beginning."""

    def enrich(self, text: str) -> str:
        questions = [f"Q {text[i * 20 : i * 20 + 30]}?" for i in range(3)]
        return json.dumps({"synthetic_title": f"T {text[:40]}.", "hypothetical_questions": questions}, ensure_ascii=False)


class HalfQuery:
    """The query itself, and its first half as a rephrasing."""

    def expand(self, query: str) -> str:
        return json.dumps({"variants": [{"sub_question": query, "rephrasings": [query[: len(query) // 2]]}]}, ensure_ascii=False)


class LongestReranker:
    """The longest candidates first; ties keep their order."""

    def rerank(self, query: str, candidates: list[str], top: int) -> list[int]:
        return sorted(range(1, len(candidates) + 1), key=lambda i: (-len(candidates[i - 1]), i))[:top]
