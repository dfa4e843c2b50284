"""The value types, their canonical text, equality, and limits."""

from __future__ import annotations

import base64
import json
import math

from tessera.errors import InvalidInput
from tessera.functions.jsonpath import canonical

#: The limits of keys and values.
MAX_KEY, MAX_TEXT, MAX_ITEMS, MAX_DEPTH, MAX_DIMENSION = 1024, 16 << 20, 1_000_000, 128, 8192


def kind(value) -> str:
    names = {type(None): "null", bool: "bool", int: "int", float: "float", str: "string", bytes: "bytes", list: "array", tuple: "array", dict: "object"}
    if type(value) not in names:
        raise InvalidInput(f"a {type(value).__name__} is no value")
    return names[type(value)]


def check(value, depth: int = 0) -> None:
    k = kind(value)
    if depth > MAX_DEPTH:
        raise InvalidInput("the value is nested too deeply")
    if k == "string" and len(value.encode()) > MAX_TEXT or k == "bytes" and len(value) > MAX_TEXT:
        raise InvalidInput("the text or bytes are too long")
    if k == "int" and not -(1 << 63) <= value < 1 << 63:
        raise InvalidInput("the integer has more than 64 bits")
    if k in ("array", "object"):
        if len(value) > MAX_ITEMS:
            raise InvalidInput("the value has too many items")
        for v in value.values() if k == "object" else value:
            check(v, depth + 1)


def encode(value) -> tuple[str, str]:
    """(type, canonical text). Equal texts of one type are equal values, so 1 and 1.0 differ."""
    check(value)

    def plain(v):
        if isinstance(v, bytes):
            return base64.b64encode(v).decode()
        if isinstance(v, list | tuple):
            return [plain(x) for x in v]
        return {str(a): plain(b) for a, b in v.items()} if isinstance(v, dict) else v

    return kind(value), canonical(plain(value))


def decode(value_type: str, text: str | None):
    if text is None:
        return None
    value = json.loads(text)
    return base64.b64decode(value) if value_type == "bytes" else value


def equal(a, b) -> bool:
    """Equality by type and value; null equals null, and no NaN equals any."""
    if isinstance(a, float) and isinstance(b, float):
        return a == b and not math.isnan(a)
    if kind(a) != kind(b):
        return False
    if isinstance(a, list | tuple):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def check_key(key: str) -> str:
    if not key or "\0" in key or key.startswith("_tessera/") or len(key.encode()) > MAX_KEY:
        raise InvalidInput(f"not a key: {key[:40]!r}")
    return key


def check_name(name: str, longest: int = 256) -> str:
    """Names of collections, graphs and branches."""
    if not name or "/" in name or "\0" in name or name.startswith("_") or len(name.encode()) > longest:
        raise InvalidInput(f"not a name: {name[:40]!r}")
    return name
