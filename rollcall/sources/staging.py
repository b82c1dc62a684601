"""Grids that wait between preview and confirmation."""

from __future__ import annotations

import secrets
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from rollcall.sources.grid import MAX_ROWS, within_limits

#: Seconds a staged grid is kept.
TTL = 30 * 60


@dataclass(frozen=True)
class Staged:
    tenant: str
    title: str
    headers: list[str]
    rows: DataFrame
    mapping: dict[str, dict]
    at: float


class Staging:
    """Staged grids by token. Only plans are held here, never rows; a grid belongs to its tenant and lapses after TTL."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self._items: dict[str, Staged] = {}
        self._clock = clock

    def put(self, tenant: str, title: str, headers: list[str], rows: DataFrame, mapping: dict[str, dict]) -> str:
        if not within_limits(rows):
            raise ValueError(f"more than {MAX_ROWS} rows")
        self.reap()
        token = secrets.token_hex(16)
        self._items[token] = Staged(tenant, title, headers, rows, mapping, self._clock())
        return token

    def get(self, token: str, tenant: str) -> Staged | None:
        """The staged grid, if it is the tenant's and hasn't lapsed."""
        item = self._items.get(token)
        if item is None or item.tenant != tenant or self._clock() - item.at > TTL:
            return None
        return item

    def drop(self, token: str) -> None:
        self._items.pop(token, None)

    def reap(self) -> int:
        """Forgets lapsed grids; how many."""
        old = [t for t, i in self._items.items() if self._clock() - i.at > TTL]
        for t in old:
            self.drop(t)
        return len(old)
