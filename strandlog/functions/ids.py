"""Identifiers and hashes of the log."""

from __future__ import annotations

import hashlib
import hmac
import secrets
import time
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid7() -> str:
    """A time-ordered UUID. Made at append, never inside a plan that may be evaluated again."""
    ms = time.time_ns() // 1_000_000
    value = (ms & (1 << 48) - 1) << 80 | secrets.randbits(80)
    value = value & ~(0xF << 76) | 0x7 << 76
    value = value & ~(0x3 << 62) | 0x2 << 62
    return str(uuid.UUID(int=value))


def default_id_key(type_: str) -> str:
    return type_[:1].lower() + type_[1:] + "Id"


def default_id_key_column(type_: Column) -> Column:
    return F.concat(F.lower(F.substring(type_, 1, 1)), F.substring(type_, 2, 1 << 30), F.lit("Id"))


def signed64(value: int) -> int:
    value &= (1 << 64) - 1
    return value - (1 << 64) if value >= 1 << 63 else value


def fnv1a64(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return signed64(h)


def lock_key(text: str, salt: str | None = None) -> int:
    """A 64-bit key of a scope value; with a salt, the head of an HMAC, so keys cannot be guessed."""
    if not salt:
        return fnv1a64(text)
    return signed64(int.from_bytes(hmac.new(salt.encode(), text.encode(), hashlib.sha256).digest()[:8], "big"))
