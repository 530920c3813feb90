"""The engine as named tools with checked arguments, and as lines of requests and responses (JSON-RPC 2.0)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession

from sieveloom.operators import briefs
from sieveloom.operators.critique import VISION_RULES
from sieveloom.operators.lint import lint
from sieveloom.sources import readers

LEAST = {"list_styles": (), "style": ("id",), "brief": ("intent", "token", "surfaces"), "palette": ("token",), "type_system": ("token",), "reference": ("token",), "lint": ("html",), "vision_rules": ()}
MORE = {"brief": ("audience", "mustInclude", "mustAvoid"), "lint": ("css", "file")}


class BadArguments(ValueError):
    pass


def tools(spark: SparkSession, folder: str) -> dict[str, Callable[[dict], object]]:
    """The tools by name, over the styles in ``folder``."""

    def checked(name: str, f: Callable[[dict], object]) -> Callable[[dict], object]:
        def call(given: dict) -> object:
            missing = [k for k in LEAST[name] if k not in given]
            unknown = sorted(set(given) - {*LEAST[name], *MORE.get(name, ())})
            if missing or unknown:
                raise BadArguments(f"{name}: missing {missing}, unknown {unknown}")
            return f(given)

        return call

    def style(name: object) -> dict:
        try:
            return readers.style(folder, name)
        except (OSError, TypeError, ValueError) as e:
            raise BadArguments(str(e)) from e

    def brief(given: dict) -> dict:
        problems = briefs.brief_problems(given)
        if problems:
            raise BadArguments(f"brief: {', '.join(problems)}")
        return briefs.compiled(given, style(given["token"]))

    def found(given: dict) -> dict:
        page = readers.inline(spark, [(given.get("file", "inline.html"), given["html"], given.get("css", ""))])
        rows = lint(page).orderBy("rule_ord", "match_ord").collect()  # of one page
        return {"violations": [{k: r[k] for k in ("rule_id", "severity", "line", "message", "snippet") if r[k] is not None} for r in rows]}

    def reference(given: dict) -> dict:
        s = style(given["token"])
        return {"provenance": s.get("provenance"), "mood": s.get("mood"), "forbidden": s.get("forbidden"), "required": s.get("required-quirks")}

    def palette(given: dict) -> dict:
        colour = style(given["token"]).get("colour") or {}
        return {"palette": colour.get("palette"), "roles": colour.get("roles")}

    made = {
        "list_styles": lambda g: {"styles": readers.styles(folder)},
        "style": lambda g: style(g["id"]),
        "brief": brief,
        "palette": palette,
        "type_system": lambda g: style(g["token"]).get("type"),
        "reference": reference,
        "lint": found,
        "vision_rules": lambda g: {"rules": [{"rule_id": k, "description": v} for k, v in VISION_RULES.items()]},
    }
    return {k: checked(k, f) for k, f in made.items()}


def answer(request: object, of: dict[str, Callable[[dict], object]]) -> dict | None:
    """The response to one request; none to a notification."""
    ok = isinstance(request, dict) and isinstance(request.get("method"), str)
    key = request.get("id") if isinstance(request, dict) else None
    wrong = lambda code, text: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": text}}
    right = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    if not ok:
        return wrong(-32600, "not a request")
    if "id" not in request:
        return None
    method, params = request["method"], request.get("params") or {}
    if method == "initialize":
        return right({"serverInfo": {"name": "sieveloom"}, "capabilities": {"tools": {}}})
    if method == "tools/list":
        return right({"tools": [{"name": k, "inputSchema": {"type": "object", "required": list(LEAST[k])}} for k in of]})
    if method != "tools/call":
        return wrong(-32601, f"unknown method: {method}")
    name = params.get("name") if isinstance(params, dict) else None
    if name not in of:
        return wrong(-32602, f"unknown tool: {name}")
    try:
        return right({"content": [{"type": "text", "text": json.dumps(of[name](params.get("arguments") or {}), ensure_ascii=False)}]})
    except BadArguments as e:
        return wrong(-32602, str(e))
    except Exception as e:  # one request's failure is its answer; the next is served
        return wrong(-32603, f"{type(e).__name__}: {e}")


def served(chunks: Iterable[str], of: dict[str, Callable[[dict], object]]) -> Iterator[str]:
    """A line of response for each line of request; ``chunks`` may end anywhere within a line."""
    rest = ""
    for chunk in chunks:
        *lines, rest = (rest + chunk).split("\n")
        for line in filter(str.strip, lines):
            yield from _line(line, of)
    if rest.strip():
        yield from _line(rest, of)


def _line(line: str, of: dict[str, Callable[[dict], object]]) -> Iterator[str]:
    try:
        said = answer(json.loads(line), of)
    except json.JSONDecodeError:
        said = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
    if said is not None:
        yield json.dumps(said, ensure_ascii=False) + "\n"
