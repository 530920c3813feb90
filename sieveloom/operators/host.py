"""What is done beside the tables, on the driver: settings, flags, names, the pace of outside calls and their memory."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable


def read_env(path: str, into: dict | None = None) -> dict[str, str]:
    """The settings of a file of NAME=value lines, put into ``into`` (the environment) where a name isn't set yet.

    Blank lines and comments don't count; quotes around a value go, and so does ``export``. No file, no settings.
    """
    into = os.environ if into is None else into
    found = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in f:
                m = re.match(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", line)
                if m:
                    value = m[2]
                    found[m[1]] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    for name, value in found.items():
        into.setdefault(name, value)
    return found


def find_root(start: str, marks: tuple[str, ...], levels: int = 8) -> str | None:
    """The nearest folder from ``start`` upward, ``levels`` at most, that holds all of ``marks``."""
    folder = os.path.abspath(start)
    for _ in range(levels):
        if all(os.path.exists(os.path.join(folder, m)) for m in marks):
            return folder
        above = os.path.dirname(folder)
        if above == folder:
            return None
        folder = above
    return None


def whole(text: str | None, default: int, least: int | None = None, most: int | None = None) -> int:
    """A whole number of a flag, within bounds; ``default`` if it isn't given."""
    if text is None:
        return default
    if not re.fullmatch(r"[+-]?\d+", text.strip()):
        raise ValueError(f"not a whole number: {text}")
    n = int(text)
    if least is not None and n < least or most is not None and n > most:
        raise ValueError(f"{n} isn't from {least} to {most}")
    return n


def slug(text: str, at: float | None = None, most: int = 40) -> str:
    """A name for files: the time, in UTC, and the words of a text."""
    words = re.sub(r"[^a-z0-9]+", "-", text.lower()).strip("-")[:most].strip("-")
    return time.strftime("%Y%m%d-%H%M%S", time.gmtime(time.time() if at is None else at)) + (f"-{words}" if words else "")


class Refusals:
    """Hosts that were refused, for ``ttl`` seconds. What was allowed is never kept: a name may come to stand for another address."""

    def __init__(self, ttl: float = 60, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.clock, self._until = ttl, clock, {}

    def check(self, host: str, reason: Callable[[str], str | None]) -> str | None:
        """Why ``host`` is refused, or null; ``reason`` is asked unless a refusal is fresh."""
        known = self._until.get(host)
        if known and known[1] > self.clock():
            return known[0]
        self._until.pop(host, None)
        why = reason(host)
        if why is not None:
            self._until[host] = (why, self.clock() + self.ttl)
        return why


class Pace:
    """At least ``seconds`` between the beginnings of calls under one name."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self._last = seconds, clock, sleep, {}

    def wait(self, name: str) -> None:
        if name in self._last:
            left = self._last[name] + self.seconds - self.clock()
            if left > 0:
                self.sleep(left)
        self._last[name] = self.clock()


def first_models(models: list[str], named: list[str] | None = None, n: int = 2) -> list[str]:
    """The models that are named, or the first ``n`` of all."""
    return list(named) if named else models[:n]
