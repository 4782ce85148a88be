"""Helpers for tests of code that uses the log."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from typing import Any

from strandlog.functions.registry import NewEvent, Recorded
from strandlog.operators.context import Command, Outcome, Rejected
from strandlog.sources.store import Appended, FileStore

_sequence = itertools.count(1)


def reset_sequence() -> None:
    global _sequence
    _sequence = itertools.count(1)


def make_event(type_: str, data: dict | None = None, scopes: dict[str, str] | None = None, **more: Any) -> Recorded:
    n = next(_sequence)
    base = {"sequence": n, "transaction_id": n, "id": f"id{n}", "metadata": None, "recorded_at": "1970-01-01T00:00:00+00:00"}
    return Recorded(type=type_, data=data or {}, scopes=scopes or {}, **(base | more))


class Spec:
    """given(events).when(command).then(events): the decision of a command over a history, without a store."""

    def __init__(self, events: list[Recorded]):
        self.events, self.decided = events, None
        self.error: BaseException | None = None

    def when(self, command: Command) -> Spec:
        try:
            state = command.fold(self.events, command.initial() if callable(command.initial) else command.initial) if callable(command.fold) else command.fold.run(self.events, command.initial)
            self.decided = command.decide(state)
        except Exception as e:
            self.error = e
        return self

    def then(self, *expected: tuple[str, dict]) -> Spec:
        assert self.error is None, self.error
        assert isinstance(self.decided, list), self.decided
        assert [(e.type, e.data) for e in self.decided] == list(expected)
        return self

    def then_rejects(self, code: str) -> Spec:
        assert isinstance(self.decided, Rejected) and self.decided.code == code, self.decided
        return self

    def then_nothing_happened(self) -> Spec:
        assert self.error is None and self.decided == []
        return self

    def then_throws(self, kind: type[BaseException]) -> Spec:
        assert isinstance(self.error, kind), self.error
        return self


def given(*events: Recorded) -> Spec:
    return Spec(list(events))


class Interfering:
    """A store on which something else happens before each of the next appends."""

    def __init__(self, store: FileStore, before: Callable[[], None], times: int = 1):
        self._store, self._before, self._left = store, before, times

    def __getattr__(self, name: str) -> Any:
        return getattr(self._store, name)

    def append_if(self, events: list[NewEvent], ctx: tuple) -> Appended:
        if self._left:
            self._left -= 1
            self._before()
        return self._store.append_if(events, ctx)


class Slow:
    """A store whose calls take so many seconds more, each."""

    def __init__(self, store: FileStore, seconds: float):
        self._store, self._seconds = store, seconds

    def __getattr__(self, name: str) -> Any:
        found = getattr(self._store, name)
        if not callable(found):
            return found

        def call(*a: Any, **k: Any) -> Any:
            time.sleep(self._seconds)
            return found(*a, **k)

        return call


class Recording:
    """A store that keeps the names and arguments of its calls."""

    def __init__(self, store: FileStore):
        self._store, self.calls = store, []

    def __getattr__(self, name: str) -> Any:
        found = getattr(self._store, name)
        if not callable(found):
            return found

        def call(*a: Any, **k: Any) -> Any:
            self.calls.append((name, a, k))
            return found(*a, **k)

        return call


__all__ = ["Interfering", "Outcome", "Recording", "Slow", "Spec", "given", "make_event", "reset_sequence"]
