"""What happens to model specs and responses around an external call, as expressions of either engine."""

from __future__ import annotations

from sieveloom.functions.dialect import SPARK, Dialect

ROUTES = (("mock-slop", "mock", True), ("mock-swiss", "mock", True), ("claude-code:", "claude-code-cli", False), ("codex-cli:", "codex-cli", False), ("gemini-cli:", "gemini-cli", False), ("claude", "anthropic", False), ("ollama:", "ollama", False), ("hf:", "huggingface", False), ("cf:", "workers-ai", False))
REQUEST_ID_HEADERS = ("request-id", "x-request-id", "cf-ray", "x-goog-request-id")
GATEWAY_HOST = "gateway.ai.cloudflare.com"
_TAGS = r"<(?:body|div|h1|h2|head|html|p|section|style|!doctype)\b"


def _starts(d: Dialect, s: str, word: str) -> str:
    return f"{'startswith' if d is SPARK else 'starts_with'}({s}, {d.text(word)})"


def provider(d: Dialect, spec: str) -> str:
    """The provider of a model spec, by the first prefix that fits; null if none does."""
    fixed = " ".join(f"when {spec} = {d.text(w)} then '{p}'" if whole else f"when {_starts(d, spec, w)} then '{p}'" for w, p, whole in ROUTES)
    return f"case {fixed} when {_starts(d, spec, 'gpt')} or {d.has(spec, '^o[1-9]', False)} then 'openai' when {_starts(d, spec, 'gemini')} then 'gemini' end"


def sanitized(d: Dialect, s: str) -> str:
    return d.sub(s, "[^a-zA-Z0-9._-]", "_", False)


def request_id(d: Dialect, headers: str) -> str:
    """The first header with a value that is not empty."""
    one = (lambda h: f"nullif({headers}[{d.text(h)}], '')") if d is SPARK else (lambda h: f"nullif({headers}[{d.text(h)}], '')")
    return "coalesce(" + ", ".join(map(one, REQUEST_ID_HEADERS)) + ")"


def without_reasoning(d: Dialect, s: str) -> str:
    for tag in ("think", "reasoning", "scratchpad"):
        s = d.sub(s, rf"<{tag}>[\s\S]*?</{tag}>", "")
    return s


def html_of(d: Dialect, cleaned: str) -> str:
    """The page in a response (without reasoning): fenced, a document, an html element, or all of it; empty if none."""
    fenced = d.trim(d.one(cleaned, r"```(?:html|HTML)?\s*([\s\S]*?)```", 1, False))
    return (
        f"case when {d.has(fenced, _TAGS)} then {fenced} when {d.has(cleaned, r'<!doctype[\s\S]*?</html>')} then {d.one(cleaned, r'<!doctype[\s\S]*?</html>')} "
        f"when {d.has(cleaned, r'<html[\s\S]*?</html>')} then {d.one(cleaned, r'<html[\s\S]*?</html>')} when {d.has(cleaned, _TAGS)} then {d.trim(cleaned)} else '' end"
    )


def gateway_base(d: Dialect, raw: str) -> str:
    """The base address of a gateway given as account/gateway or as an https address of the gateway's host; null if it is neither."""
    host = f"lower({d.one(raw, r'^https?://(?:[^/?#@]*@)?([^/:?#]*)', 1)})"
    return f"case when {d.has(raw, '^https://', False)} and {host} = '{GATEWAY_HOST}' then {d.sub(raw, '/+$', '')} when {d.has(raw, '^[A-Za-z0-9_-]+/[A-Za-z0-9_-]+$', False)} then 'https://{GATEWAY_HOST}/v1/' || {raw} end"


_HF_HOST = r"^(?:(?:router\.|api-inference\.)?huggingface\.co|[^/]*\.endpoints\.huggingface\.cloud)$"


def hf_endpoint_ok(d: Dialect, raw: str) -> str:
    host = f"lower({d.one(raw, r'^https://(?:[^/?#@]*@)?([^/:?#]*)', 1)})"
    return d.has(host, _HF_HOST)


def blocked_reason(d: Dialect, url: str) -> str:
    """Why an address isn't one of a public page, the first reason that holds; null if it is public. Names aren't resolved."""
    scheme, authority = f"lower({d.one(url, r'^([A-Za-z][A-Za-z0-9+.-]*):', 1)})", d.one(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = f"lower({d.one(d.sub(authority, r'^[\s\S]*@', ''), r'^(\[[^\]]*\]|[^:]*)', 1)})"
    bare = f"replace(replace({host}, '[', ''), ']', '')"
    v4 = r"^(?:10\.|172\.(?:3[01]|2\d|1[6-9])\.|192\.168\.|127\.|169\.254\.|0\.|100\.(?:12[0-7]|1[01]\d|6[4-9]|[7-9]\d)\.|22[4-9]\.|23\d\.|24\d\.|25[0-5]\.)"
    v6 = r"^(?:::1$|::$|0:0:0:0:0:0:0:[01]$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|::ffff:)"
    suffixes = r"(?:^|\.)(?:nip\.io|sslip\.io|xip\.io|localtest\.me|lvh\.me|cluster\.local)$"
    return (
        f"case when {scheme} = '' then 'url-parse' when not ({d.any_of(scheme, ('http', 'https'))}) then 'bad-scheme' when {d.has(authority, '@')} then 'embedded-credentials' "
        f"when {host} = '' then 'no-hostname' when {d.any_of(host, ('localhost', 'ip6-localhost', 'ip6-loopback', 'broadcasthost'))} then 'localhost' when {d.has(host, r'\.local$')} then 'mdns' when {d.has(host, suffixes)} then 'rebinding-suffix' "
        f"when {d.has(host, r'^(?:\d+[.]){3}\d+$')} and {d.has(host, v4)} then 'private-v4' when {d.has(host, r'^\[')} and {d.has(bare, v6)} then 'private-v6' end"
    )


def body_knobs(d: Dialect, model: str) -> str:
    """Extra request fields that some hosted models need, as JSON."""
    return f"case when {d.has(model, r'^@cf/moonshotai/kimi-k2\.(?:6|[7-9]|\d{2,})', False)} then '{{\"chat_template_kwargs\":{{\"thinking\":false}}}}' else '{{}}' end"
