"""Canonical JSON and its hashes: keys sorted, lists kept, numbers as ECMAScript prints them."""

from __future__ import annotations

import hashlib
import json
import math
from decimal import Decimal


def number(x: float) -> str:
    """A double as ECMAScript's shortest text for it."""
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    text = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    minus = "-" if sign else ""
    if -6 < point <= 0:
        return f"{minus}0.{'0' * -point}{text}"
    if 0 < point <= 21:
        return f"{minus}{text[:point]}.{text[point:]}" if len(text) > point else minus + text.ljust(point, "0")
    e = point - 1
    return f"{minus}{text[0]}{'.' + text[1:] if len(text) > 1 else ''}e{'+' if e >= 0 else '-'}{abs(e)}"


def _order(key: str) -> tuple:
    """Keys that read as array indices come first, by value; the others by UTF-16 units."""
    if key.isascii() and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < 2**32 - 1:
        return (0, int(key), b"")
    return (1, 0, key.encode("utf-16-be", "surrogatepass"))


def canonical(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(str(k), ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: _order(str(k)))) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, bool) or value is None:
        return json.dumps(value)
    if isinstance(value, (int, float)):
        return number(float(value)) if isinstance(value, float) or abs(value) >= 2**53 else str(value)
    return json.dumps(str(value), ensure_ascii=False)


def hash_bytes(data: bytes | str) -> str:
    return "sha256:" + hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def hash_canonical(value) -> str:
    return hash_bytes(canonical(value))


def shorten(digest: str, n: int = 12) -> str:
    kind, _, rest = digest.rpartition(":")
    return f"{kind}:{rest[:n]}" if kind else digest[:n]


def shell_quote(argument: str) -> str:
    """An argument as a POSIX shell reads it back."""
    import shlex

    return shlex.quote(argument)
