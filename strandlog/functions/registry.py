"""Event declarations: what types there are, what they carry, and how they fold."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from strandlog.functions.errors import UsageError, ValidationError
from strandlog.functions.filters import IDENTIFIER, UNDEFINED, Filter, scope, scope_value_of
from strandlog.functions.ids import default_id_key, uuid7

TYPE_NAME = re.compile(r"[A-Za-z][A-Za-z0-9_.]*\Z")
Validator = Callable[[dict], list[str] | None]


@dataclass(frozen=True)
class EventSpec:
    """data: returns problems, if any. upcast: from what is stored to what handlers see; upcast_column: the same over a column
    of payloads (JSON text), for frames. Without it, frames run upcast in Arrow batches."""

    data: Validator | None = None
    scopes: tuple[str, ...] = ()
    optional_scopes: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    id_key: str | None = None
    upcast: Callable[[dict], dict] | None = None
    upcast_column: Callable[[Any], Any] | None = None


@dataclass(frozen=True)
class NewEvent:
    type: str
    data: dict
    scopes: dict[str, str] = field(default_factory=dict)
    id: str | None = None
    metadata: dict | None = None


@dataclass(frozen=True)
class Recorded:
    sequence: int
    transaction_id: int
    type: str
    id: str
    data: dict
    scopes: dict[str, str]
    metadata: dict | None
    recorded_at: str
    settled: bool = True


def to_payload(event: NewEvent, id_key: str) -> dict:
    """What is written: the data, the own id (which wins) and the scopes, if any."""
    payload = {k: v for k, v in event.data.items() if k != "scopes"} | {id_key: event.id}
    return payload | ({"scopes": dict(event.scopes)} if event.scopes else {})


def from_payload(payload: dict, id_key: str) -> tuple[str | None, dict, dict[str, str]]:
    own, raw = payload.get(id_key), payload.get("scopes")
    scopes = {k: v for k, v in raw.items() if isinstance(v, str)} if isinstance(raw, dict) else {}
    return own if isinstance(own, str) else None, {k: v for k, v in payload.items() if k not in (id_key, "scopes")}, scopes


def upcast_payload(payload: str, upcast: Callable[[dict], dict], id_key: str) -> str:
    """A stored payload with its data upcast; the own id and the scopes stay."""
    raw = json.loads(payload)
    kept = {k: raw[k] for k in (id_key, "scopes") if k in raw}
    return json.dumps(upcast({k: v for k, v in raw.items() if k not in kept}) | kept, separators=(",", ":"), ensure_ascii=False)


class Registry:
    def __init__(self, specs: dict[str, EventSpec]):
        for name, spec in specs.items():
            if not TYPE_NAME.match(name):
                raise UsageError(f"invalid event type {name!r}")
            if bad := [k for k in (*spec.scopes, *spec.optional_scopes) if not IDENTIFIER.match(k)]:
                raise UsageError(f"invalid scope keys {bad} of {name}")
        self.specs = dict(specs)

    def id_key(self, type_: str) -> str:
        spec = self.specs.get(type_)
        return spec.id_key if spec and spec.id_key else default_id_key(type_)

    def new(self, type_: str, data: dict, scopes: dict[str, str] | None = None, id: str | None = None, metadata: dict | None = None) -> NewEvent:
        if type_ not in self.specs:
            raise UsageError(f"{type_} is not declared")
        event = NewEvent(type_, data, scopes or {}, id or uuid7(), metadata)
        self.validate(event)
        return event

    def validate(self, event: NewEvent) -> None:
        spec = self.specs.get(event.type)
        if spec is None:
            return
        issues = list(spec.data(event.data) or []) if spec.data else []
        issues += [f"scope {k} is missing" for k in spec.scopes if k not in event.scopes]
        if issues:
            raise ValidationError(event.type, issues)

    def is_valid(self, event: NewEvent) -> bool:
        try:
            self.validate(event)
        except ValidationError:
            return False
        return True

    def filter(self, **narrow: Any) -> Filter:
        return {"types": sorted(self.specs)} | narrow

    def scope(self, type_: str, id: str | list[str]) -> Filter:
        """The event of that id and everything that names it."""
        return scope(self.id_key(type_), id)

    def parse(self, record: Recorded) -> Recorded:
        """The record with its data as the current version of its type, checked again."""
        if record.type not in self.specs:
            raise UsageError(f"{record.type} is not declared")
        self.validate(NewEvent(record.type, record.data, record.scopes, record.id))
        return record

    def fold(self, handlers: dict[str, Callable[[Any, Recorded], Any]]) -> Callable[[Iterable[Recorded], Any], Any]:
        """(events, state) -> state. Types without a handler are skipped; a handler must not return UNDEFINED."""
        if unknown := set(handlers) - set(self.specs):
            raise UsageError(f"these handlers name no declared type: {sorted(unknown)}")

        def run(events: Iterable[Recorded], state: Any) -> Any:
            for e in events:
                if (h := handlers.get(e.type)) is not None:
                    state = h(state, e)
                    if state is UNDEFINED:
                        raise UsageError(f"the handler of {e.type} returned nothing")
            return state

        return run

    def fold_by(self, key_of: Callable[[Recorded], str | None], handlers: dict[str, Callable[[Any, Recorded], Any]]) -> Callable[[Iterable[Recorded], dict], dict]:
        """State by key; None from a handler deletes a key, events without a key are skipped."""

        def run(events: Iterable[Recorded], states: dict) -> dict:
            states = dict(states)
            for e in events:
                key, h = key_of(e), handlers.get(e.type)
                if key is None or h is None:
                    continue
                state = h(states.get(key), e)
                if state is None:
                    states.pop(key, None)
                else:
                    states[key] = state
            return states

        return run

    def fold_all(self, handlers: dict, initial: Any) -> Callable[[Iterable[Recorded]], Any]:
        run = self.fold(handlers)
        return lambda events: run(events, initial() if callable(initial) else initial)


@dataclass(frozen=True)
class Schema:
    """What a store enforces: merged from registries."""

    scope_keys: tuple[str, ...] = ()
    uniques: dict[str, tuple[str, ...]] = field(default_factory=dict)
    id_keys: dict[str, str] = field(default_factory=dict)
    upcasts: dict[str, Callable[[dict], dict]] = field(default_factory=dict)
    upcast_columns: dict[str, Callable[[Any], Any]] = field(default_factory=dict)
    tenant_key: str | None = None
    strict: bool = True
    lock_salt: str | None = None

    def id_key(self, type_: str) -> str:
        return self.id_keys.get(type_, default_id_key(type_))


EMPTY_SCHEMA = Schema(strict=False)


def build_schema(registries: list[Registry], scope_keys: Iterable[str] = (), tenant_key: str | None = None, lock_salt: str | None = None, strict: bool = True) -> Schema:
    keys, uniques, ids, upcasts, columns = set(scope_keys), {}, {}, {}, {}
    if tenant_key:
        keys.add(tenant_key)
    for r in registries:
        for name, spec in r.specs.items():
            if name in ids:
                raise UsageError(f"{name} is declared twice")
            ids[name] = r.id_key(name)
            keys.update(spec.scopes, spec.optional_scopes)
            if spec.unique:
                uniques[name] = spec.unique
            if spec.upcast:
                upcasts[name] = spec.upcast
            if spec.upcast_column:
                columns[name] = spec.upcast_column
    return Schema(tuple(sorted(keys)), uniques, ids, upcasts, columns, tenant_key, strict, lock_salt)


def check_envelope(event: NewEvent, schema: Schema) -> None:
    """The rules that hold for every event, declared or not."""
    own = schema.id_key(event.type)
    if not isinstance(event.data, dict):
        raise ValidationError(event.type, ["data must be an object"])
    issues = []
    if own in event.data:
        issues.append(f"data must not contain the own id key {own}")
    if "scopes" in event.data:
        issues.append("data must not contain scopes; pass them beside it")
    issues += [f"{k} is a declared scope key: a string or null" for k in schema.scope_keys if event.data.get(k) is not None and event.data.get(k) is not UNDEFINED and not isinstance(event.data[k], str)]
    for k, v in event.scopes.items():
        if not IDENTIFIER.match(k):
            issues.append(f"invalid scope key {k!r}")
        if not isinstance(v, str) or not v:
            issues.append(f"scope {k} must be a string that is not empty")
    if event.id is not None and (not isinstance(event.id, str) or not event.id):
        issues.append("id must be a string that is not empty")
    if issues:
        raise ValidationError(event.type, issues)


def value_at(payload: dict, dotted: str) -> Any:
    at: Any = payload
    for part in dotted.split("."):
        at = at.get(part) if isinstance(at, dict) else None
    return at


def key_of(record_payload: dict, key: str) -> str | None:
    return scope_value_of(record_payload, key)
