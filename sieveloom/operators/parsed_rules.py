"""Rules that need a parsed document, a join within the page or variables: each gives (line, text) findings of one page."""

from __future__ import annotations

import re

from sieveloom.functions.markup import prose

PHRASES = ("ai-native", "best-in-class", "build the future of", "cutting-edge", "empower your", "game-changing", "next-generation", "revolutionize", "seamless", "ship faster", "unleash")
_BAIT = re.compile(r"\b(?:AI|future|intelligence|tomorrow)\b", re.I | re.A)
_STYLE = re.compile(r"<style[^>]*>([\S\s]*?)</style>", re.I)
_BLOCK = re.compile(r"([^}{]+)\{([^}{]*)\}")
_SHELLS = {"__next", "__nuxt", "app", "app-root", "main", "root", "svelte"}
Finding = tuple[int | None, str | None]


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def styles(html: str, css: str) -> str:
    return css + "\n" + "\n".join(_STYLE.findall(html))


def slop_copy(html: str, css: str) -> list[Finding]:
    out, seen = [], set()
    for _, line, text in prose(html):
        low = text.lower()
        for phrase in PHRASES:
            at = low.find(phrase)
            if at >= 0 and (line, phrase) not in seen:
                seen.add((line, phrase))
                out.append((line, text[max(0, at - 20) : at + 60].strip()[:140]))
    return out


def em_dashes(html: str, css: str) -> list[Finding]:
    out, seen = [], set()
    for _, line, text in prose(html) if "—" in html or "&" in html else ():
        at = text.find("—")
        if at >= 0:
            shown = text[max(0, at - 30) : at + 40].strip()[:140]
            if (line, shown[:80]) not in seen:
                seen.add((line, shown[:80]))
                out.append((line, shown))
    return out


def gradient_text(html: str, css: str) -> list[Finding]:
    out = []

    def baited(pattern: str) -> None:
        for m in re.finditer(pattern, html, re.I | re.A):
            if _BAIT.search(m[2]):
                out.append((line_of(html, m.start()), m[0][:120]))

    baited(r'<(div|span|h1|h2)[^>]*class\s*=\s*\x22[^\x22]*(?:text-transparent|bg-clip-text)[^\x22]*bg-gradient-[^\x22]*\x22[^>]*>([\S\s]*?)</\1>')
    for name in re.findall(r"\.([-\w]+)\s*\{[^}]*background-clip[\s]*:\s*text[^}]*\}", styles(html, css), re.I | re.A):
        baited(rf'<(div|span|p|h1|h2|h3)[^>]*class\s*=\s*\x22[^\x22]*\b{re.escape(name)}\b[^\x22]*\x22[^>]*>([\S\s]*?)</\1>')
    return out


def root_variables(blocks: list[tuple[str, str]]) -> dict[str, str]:
    """Custom properties of the root; the last one counts."""
    found = {}
    for selector, body in blocks:
        if re.search(r"(?:^|[\s,])(?::root|html)(?=[{\s,:]|$)", selector.strip()):
            found |= {k: v.strip() for k, v in re.findall(r"--([-\w]+)\s*:([^;]+);", body, re.A)}
    return found


def resolve(body: str, variables: dict[str, str]) -> str:
    """Each use of a variable replaced once; an unknown one stays, without its fallback."""
    return re.sub(r"var\(\s*--([-\w]+)\s*(?:,[^)]*)?\)", lambda m: variables.get(m[1], f"var(--{m[1]})"), body, flags=re.A)


def tracking(html: str, css: str) -> list[Finding]:
    blocks = _BLOCK.findall(styles(html, css))
    variables = root_variables(blocks)
    large = tight = capitals = opened = False
    for _, body in blocks:
        body = resolve(body, variables)
        size = re.search(r"font-size\s*:\s*([0-9]+(?:[.][0-9]+)?)(rem|em|px)", body, re.I)
        spacing = re.search(r"letter-spacing\s*:\s*(-?[0-9.]+)", body, re.I)
        number = re.match(r"-?(?:\d+\.?\d*|\.\d+)", spacing[1]) if spacing else None
        value = float(number[0]) if number else None
        if size and float(size[1]) * (1 if size[2] == "px" else 16) >= 48:
            large = True
            tight |= value is not None and value < 0
        if re.search(r"text-transform\s*:\s*uppercase", body, re.I):
            capitals = True
            opened |= value is not None and value > 0.01
    return [(None, "large type")] * (large and not tight) + [(None, "all capitals")] * (capitals and not opened)


def spa_shell(html: str, css: str) -> list[Finding]:
    body = re.search(r"<body\b[^>]*>([\S\s]*?)</body>", html, re.I)
    if not body or not re.search(r"<script\b[^>]*\bsrc\s*[=]\s*[\x22\x27][^\x22\x27]*(?:/(?:_next|assets|build|dist|static/js)/|\.(?:chunk|bundle)\.js)[^\x22\x27]*[\x22\x27][^>]*>", html, re.I):
        return []
    rest = re.sub(r"<!--[\S\s]*?-->", "", body[1])
    for tag in ("script", "style", "noscript"):
        rest = re.sub(rf"<{tag}\b[\S\s]*?</{tag}>", "", rest, flags=re.I)
    rest = rest.strip()
    if not rest or re.sub(r"<[^>]+>", "", rest).strip() or re.search(r"<(?:article|footer|h[1-6]|header|main|nav|section)\b", rest, re.I):
        return []
    children = [(m[0], m[2]) for m in re.finditer(r"<([A-Za-z][A-Za-z0-9-]*)\b[^>]*>([\S\s]*?)</\1>", rest)]
    if not 1 <= len(children) <= 2:
        return []
    for tag, inner in children:
        name = re.search(r"\bid\s*=\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]", tag, re.I)
        if not re.match(r"<div\b", tag, re.I) or not name or name[1].strip() not in _SHELLS or inner.strip():
            return []
    return [(line_of(html, body.start()), body[0][:140])]


PARSED = {"no-gradient-text": gradient_text, "no-slop-copy": slop_copy, "tracking-per-size": tracking, "no-em-dashes-in-prose": em_dashes, "spa-shell-detected": spa_shell}
