"""Stored states: a tagged JSON form for what folds may keep, and refusal of anything else with its path."""

from __future__ import annotations

import hashlib
import inspect
import json
import math
from collections.abc import Callable
from datetime import UTC, datetime
from typing import Any

from strandlog.functions.errors import UsageError

MOST_NODES, MOST_DEPTH = 10_000_000, 64


def encode(value: Any, path: str = "$", depth: int = 0) -> Any:
    if depth > MOST_DEPTH:
        raise UsageError(f"a state is nested too deeply at {path}")
    if value is None or isinstance(value, bool | str):
        return value
    if isinstance(value, int):
        return value if abs(value) < 2**53 else {"$int": str(value)}
    if isinstance(value, float):
        return value if math.isfinite(value) else {"$float": repr(value)}
    if isinstance(value, datetime):
        return {"$date": value.astimezone(UTC).isoformat()}
    if isinstance(value, list | tuple):
        items = [encode(v, f"{path}[{k}]", depth + 1) for k, v in enumerate(value)]
        return {"$tuple": items} if isinstance(value, tuple) else items
    if isinstance(value, set | frozenset):
        return {"$set": sorted((encode(v, f"{path}{{}}", depth + 1) for v in value), key=json.dumps)}
    if isinstance(value, dict):
        if all(isinstance(k, str) and not k.startswith("$") for k in value):
            return {k: encode(v, f"{path}.{k}", depth + 1) for k, v in value.items()}
        return {"$map": [[encode(k, f"{path}<key>", depth + 1), encode(v, f"{path}.{k}", depth + 1)] for k, v in value.items()]}
    raise UsageError(f"a state cannot hold a {type(value).__name__} at {path}")


_PLAIN = frozenset({int, str, bool, float, type(None)})


def check(value: Any) -> None:
    """Raises what encode would; quick for flat states of plain values."""
    if type(value) in _PLAIN or type(value) is dict and all(type(k) is str and type(v) in _PLAIN for k, v in value.items()):
        return
    encode(value)


def decode(value: Any) -> Any:
    if isinstance(value, list):
        return [decode(v) for v in value]
    if not isinstance(value, dict):
        return value
    if len(value) == 1:
        (tag, inner), = value.items()
        if tag == "$int":
            return int(inner)
        if tag == "$float":
            return float(inner)
        if tag == "$date":
            return datetime.fromisoformat(inner)
        if tag == "$tuple":
            return tuple(decode(v) for v in inner)
        if tag == "$set":
            return {_hashable(decode(v)) for v in inner}
        if tag == "$map":
            return {_hashable(decode(k)): decode(v) for k, v in inner}
    return {k: decode(v) for k, v in value.items()}


def _hashable(v: Any) -> Any:
    return tuple(map(_hashable, v)) if isinstance(v, list) else v


def dumps(state: Any) -> str:
    return json.dumps(encode(state), sort_keys=True, separators=(",", ":"))


def loads(text: str) -> Any:
    return decode(json.loads(text))


def fingerprint(*functions: Callable) -> str:
    """A hash of the functions' source, to warn when a fold changed under an old version number; it decides nothing."""
    def text(f: Callable) -> str:
        try:
            return inspect.getsource(f)
        except (OSError, TypeError):
            return repr(getattr(f, "__qualname__", f))

    return hashlib.sha256("\0".join(map(text, functions)).encode()).hexdigest()


def estimate_size(value: Any, most: int = 200_000) -> int:
    """Rough bytes of a state, over `most` nodes at most."""
    size, todo, seen = 0, [value], 0
    while todo and seen < most:
        v = todo.pop()
        seen += 1
        size += 16 + (2 * len(v) if isinstance(v, str) else 0)
        if isinstance(v, dict):
            todo.extend(v.keys())
            todo.extend(v.values())
        elif isinstance(v, list | tuple | set | frozenset):
            todo.extend(v)
    return size
