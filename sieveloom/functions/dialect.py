"""Text functions as SQL, for Spark and for the SQL that checks it.

Patterns follow the ECMAScript reading of ``\\s`` (all Unicode spaces) and ``\\b``
(ASCII word characters); ``\\x27`` stands for an apostrophe. Patterns may not
match the empty string, and have no capturing group unless one is asked for.
"""

from __future__ import annotations

import re

_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def _spaces(pattern: str) -> str:
    """``\\s`` widened, within classes and outside; ``[\\s\\S]`` stays."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(rf"\s{_SPACES}" if inside else rf"[\s{_SPACES}]")
            i += 2
        elif pattern.startswith((r"[\s\S]", r"[\S\s]"), i):
            out.append(r"[\s\S]")
            i += 6
        elif two[:1] == "\\":
            out.append(two)
            i += 2
        else:
            inside = two[:1] == "[" or inside and two[:1] != "]"
            out.append(two[:1])
            i += 1
    return "".join(out)


def _boundaries(pattern: str) -> str:
    """``\\b`` spelled out. Beside a word character that stands for itself, one look to the other side says the same in far less time."""
    pattern = re.sub(rf"\\b(?={_WORD}(?![*?{{]))", lambda _: f"(?<!{_WORD})", pattern)
    pattern = re.sub(rf"(?<!\\)(?<!\\x)(?<!\\x[0-9A-F])({_WORD})\\b", lambda m: f"{m[1]}(?!{_WORD})", pattern)
    return pattern.replace(r"\b", _BOUNDARY)


class Dialect:
    """SQL text of one engine. ``i`` patterns are read without case."""

    def pattern(self, p: str, i: bool = True) -> str:
        raise NotImplementedError

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def any_of(self, s: str, words: tuple[str, ...]) -> str:
        return "(" + " or ".join(f"{s} = {self.text(w)}" for w in words) + ")"

    def n_of(self, s: str, patterns: list[str], i: bool = True) -> str:
        """How many of the patterns are found."""
        return "(" + " + ".join(f"cast({self.has(s, p, i)} as int)" for p in patterns) + ")"

    def newlines(self, s: str) -> str:
        return f"(length({s}) - length(replace({s}, chr(10), '')))"

    def trim(self, s: str) -> str:
        return self.sub(s, r"^\s+|\s+$", "", False)

    def left(self, s: str, n: int) -> str:
        return f"left({s}, {n})"

    def bodies(self, css: str) -> str:
        """The bodies of a style sheet's innermost blocks."""
        return self.all(css, r"[^}{]+\{([^}{]*)\}", 1)

    def style(self, html: str) -> str:
        return self.join(self.all(html, r"<style[^>]*>([\S\s]*?)</style>", 1), "chr(10)")


class Spark(Dialect):
    def pattern(self, p: str, i: bool = True) -> str:
        p = _boundaries(_spaces(p))
        return "r'" + ("(?i)" if i else "") + p + "'"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def has(self, s, p, i=True):
        return f"regexp_like({s}, {self.pattern(p, i)})"

    def all(self, s, p, g=0, i=True):
        return f"regexp_extract_all({s}, {self.pattern(p, i)}, {g})"

    def one(self, s, p, g=0, i=True):
        """The first match, empty if there is none."""
        return f"regexp_extract({s}, {self.pattern(p, i)}, {g})"

    def sub(self, s, p, r, i=True):
        return f"regexp_replace({s}, {self.pattern(p, i)}, {self.text(r)})"

    def size(self, a):
        return f"size({a})"

    def distinct(self, a):
        return f"array_distinct({a})"

    def each(self, a, f):
        return f"transform({a}, x -> {f('x')})"

    def keep(self, a, f):
        return f"filter({a}, x -> {f('x')})"

    def exists(self, a, f):
        return f"exists({a}, x -> {f('x')})"

    def both(self, a, b):
        return f"concat({a}, {b})"

    def at(self, a, n):
        return f"get({a}, {n - 1})"

    def join(self, a, sep):
        return f"array_join({a}, {sep})"

    def double(self, s):
        return f"try_cast({s} as double)"

    def split(self, s, p):
        return f"split({s}, {self.pattern(p)}, -1)"

    def contains(self, s, word):
        return f"contains({s}, {self.text(word)})"

    def matches(self, s, p, i=True):
        """Array of (line, text) of the matches. Each is marked where it begins; a line then has as many matches as marks."""
        p = self.pattern(p, i)
        marked = f"regexp_replace(translate({s}, chr(1), chr(2)), {p}, concat(chr(1), '$0'))"  # to a pattern, both control characters are alike
        lines = f"flatten(transform(split({marked}, '\\n', -1), (l, k) -> array_repeat(k + 1, length(l) - length(replace(l, chr(1), '')))))"
        return f"zip_with({lines}, regexp_extract_all({s}, {p}, 0), (n, t) -> named_struct('line', n, 'text', t))"

    def pairs(self, a, f):
        """Filter of an array by each element and the one before it."""
        return f"transform(filter(zip_with({a}, concat(array(null), {a}), (x, y) -> named_struct('x', x, 'y', y)), z -> z.x is not null and z.y is not null and {f('z.x', 'z.y')}), z -> z.x)"

    def none(self):
        return "cast(array() as array<struct<line: int, text: string>>)"

    def item(self, line, text):
        return f"named_struct('line', cast({line} as int), 'text', cast({text} as string))"

    def row(self, line, text):
        return f"array({self.item(line, text)})"


class Duck(Dialect):
    def pattern(self, p: str, i: bool = True) -> str:
        return "'" + ("(?i)" if i else "") + _spaces(p) + "'"

    def has(self, s, p, i=True):
        return f"regexp_matches({s}, {self.pattern(p, i)})"

    def all(self, s, p, g=0, i=True):
        return f"regexp_extract_all({s}, {self.pattern(p, i)}, {g})"

    def one(self, s, p, g=0, i=True):
        return f"regexp_extract({s}, {self.pattern(p, i)}, {g})"

    def sub(self, s, p, r, i=True):
        return f"regexp_replace({s}, {self.pattern(p, i)}, {self.text(r)}, 'g')"

    def size(self, a):
        return f"len({a})"

    def distinct(self, a):
        return f"list_distinct({a})"

    def each(self, a, f):
        return f"list_transform({a}, lambda x: {f('x')})"

    def keep(self, a, f):
        return f"list_filter({a}, lambda x: {f('x')})"

    def exists(self, a, f):
        return f"(len(list_filter({a}, lambda x: {f('x')})) > 0)"

    def both(self, a, b):
        return f"list_concat({a}, {b})"

    def at(self, a, n):
        return f"({a})[{n}]"

    def join(self, a, sep):
        return f"coalesce(array_to_string({a}, {sep}), '')"

    def double(self, s):
        return f"try_cast({s} as double)"

    def split(self, s, p):
        return f"string_split_regex({s}, {self.pattern(p)})"

    def contains(self, s, word):
        return f"contains({s}, {self.text(word)})"

    def matches(self, s, p, i=True):
        pieces, found = f"string_split_regex({s}, {self.pattern(p, i)})", self.all(s, p, 0, i)
        before = f"{self.join(f'({pieces})[1:k]', chr(39) * 2)} || {self.join(f'({found})[1:k-1]', chr(39) * 2)}"
        return f"list_transform(range(1, len({found}) + 1), lambda k: {{'line': cast(1 + {self.newlines(f'({before})')} as int), 'text': ({found})[k]}})"

    def pairs(self, a, f):
        return f"list_transform(list_filter(list_zip({a}, list_concat([null], {a})), lambda z: z[1] is not null and z[2] is not null and {f('z[1]', 'z[2]')}), lambda z: z[1])"

    def none(self):
        return "cast([] as struct(line int, text varchar)[])"

    def item(self, line, text):
        return f"{{'line': cast({line} as int), 'text': cast({text} as varchar)}}"

    def row(self, line, text):
        return f"[{self.item(line, text)}]"


SPARK, DUCK = Spark(), Duck()


def python_pattern(p: str, i: bool = True) -> re.Pattern:
    """The same pattern for ``re``."""
    p = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", _spaces(p))
    return re.compile(p, (re.IGNORECASE if i else 0) | re.ASCII)
