"""Model calls as injected functions: schema mapping, search translation, retries. Offline there are none; the fallbacks hold."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Sequence

from rollcall.operators import search
from rollcall.schemas import FIELDS

#: Tries of a call and first wait.
TRIES, WAIT = 3, 0.4
# Codes and states worth another try, as whole words in any case.
AGAIN = re.compile(r"(?<![\w.])(?:429|500|502|503|504|unavailable|resource[_ ]exhausted|deadline(?:[_ ]exceeded)?|overloaded|timeout|timed out)(?![\w.]*\d)(?!\w)", re.I)


class EmptyAnswer(ValueError):
    """The model answered nothing; worth another try."""


def strip_fence(text: str) -> str:
    """JSON out of a fenced block."""
    return re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text)


def _passing(e: Exception) -> bool:
    """Whether a failure is a state or code that may pass: a code counts as an attribute or in front of the text, not as part of a number in it."""
    code = getattr(e, "code", None) or getattr(e, "status_code", None)
    if isinstance(code, int):
        return code in (429, 500, 502, 503, 504)
    found = AGAIN.search(str(e))
    return bool(found) and not (found[0].isdigit() and re.search(rf"\b{found[0]} (?:rows|records|tokens|characters|bytes)\b", str(e)))


def call_json(ask: Callable[[], str], tries: int = TRIES, wait: float = WAIT, sleep: Callable[[float], None] = time.sleep) -> object:
    """The parsed answer of a call; passing failures are tried again after growing waits."""
    for n in range(tries):
        try:
            text = strip_fence(ask() or "").strip()
            if not text:
                raise EmptyAnswer("empty answer")
            return json.loads(text)
        except Exception as e:  # noqa: BLE001 - the caller's client decides the type
            if n == tries - 1 or not (isinstance(e, EmptyAnswer) or _passing(e)):
                raise
            sleep(wait * 2**n)
    raise AssertionError


def find_loosely(header: str, answers: dict[str, dict]) -> dict | None:
    """The answer for a header, whatever case and white space it was echoed with."""
    key = lambda s: " ".join(s.lower().split())
    return answers.get(header) or next((v for k, v in answers.items() if key(k) == key(header)), None)


def infer_mapping(headers: Sequence[str], rows: Sequence[Sequence[str]], propose: Callable[[Sequence[str], Sequence[Sequence[str]]], dict[str, dict]] | None) -> dict[str, dict]:
    """{header: {field, confidence, reasoning}}: unknown fields become notes, unanswered headers are ignored; without a model everything is ignored."""
    try:
        answers = propose(headers, rows[:5]) if propose else {}
    except Exception:  # noqa: BLE001 - a failing model leaves the choice to the user
        answers = {}
    out = {}
    for h in headers:
        a = find_loosely(h, answers)
        if a is None:
            out[h] = {"field": "ignore", "confidence": 0.0, "reasoning": ""}
        else:
            field = a.get("field", "ignore")
            out[h] = {"field": field if field in (*FIELDS, "ignore") else "notes", "confidence": min(max(float(a.get("confidence", 0)), 0.0), 1.0), "reasoning": str(a.get("reasoning", ""))}
    return out


def translate(text: str, translator: Callable[[str], dict] | None) -> search.Predicate:
    """A search text as predicate: the model's filters, or the keyword search if there is no model or it fails."""
    try:
        plan = translator(text) if translator else None
    except Exception:  # noqa: BLE001 - a failing model leaves the keyword search
        plan = None
    return search.keyword(text) if plan is None else search.build(plan.get("filters", []), plan.get("logic", "AND"))
