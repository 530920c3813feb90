"""The rule catalogue, and the rules that SQL expressions can say.

A rule is a function from a dialect to an array of (line, text): a row for each
finding. Sources are ``html``; ``cs``, the style sheet and the inline styles;
and ``csh``, these and the HTML again, so that inline styles count twice there. Lines count
within the source. ``gate`` names literals (any of them, in small letters) without which a page can't
have a finding, so that most rules end after one search for a word.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from sieveloom.functions.dialect import Dialect


@dataclass(frozen=True)
class Rule:
    rule_id: str
    severity: str
    description: str
    gate: tuple[str, ...] = ()
    find: Callable[[Dialect], str] | None = None  #: none: the rule is evaluated on a parsed document
    status: str = "stable"

    @property
    def name(self) -> str:
        return self.rule_id.replace("/", "_").replace("-", "_")


def _each(source: str, pattern: str, size: int | None, where: Callable[[Dialect, str], str] | None = None, i: bool = True):
    def find(d: Dialect) -> str:
        found = d.matches(source, pattern, i)
        if where:
            found = d.keep(found, lambda x: where(d, f"{x}.text"))
        return d.each(found, lambda x: d.item(f"{x}.line", d.left(f"{x}.text", size) if size else "null"))

    return find


def _all(*finders):
    def find(d: Dialect) -> str:
        out = finders[0](d)
        for f in finders[1:]:
            out = d.both(out, f(d))
        return out

    return find


def _once(test: Callable[[Dialect], str], line: str = "null", text: str = "null"):
    return lambda d: f"case when {test(d)} then {d.row(line, text)} else {d.none()} end"


HUES = ["blue", "cyan", "fuchsia", "indigo", "pink", "purple", "violet"]
GROTESQUES = ("Plus Jakarta Sans", "Open Sans", "Inter", "Lato", "Manrope", "Nunito", "Poppins", "Roboto")
GENERIC = ("", "serif", "sans-serif", "monospace", "inherit", "system-ui")
AVATARS = ("api.dicebear.com", "dicebear.com", "i.pravatar.cc", "randomuser.me", "ui-faces.com", "uifaces.co")
ICONS = ("BookOpen", "Brain", "Cpu", "Gauge", "Lock", "Rocket", "Shield", "Sparkles", "Wand", "Wand2", "Zap")
_FAMILY = r"font-family\s*:\s*([^};]+)"
_RADIUS_WORD = r"\brounded(?:-(?:full|none|3xl|2xl|xl|lg|md|sm))?\b"
_NAMED = [rf"\b{a}\s*=\s*[\x22\x27]\s*\S" for a in ("aria-label", "aria-labelledby", "title")]
_CLASS = r"class\s*=\s*\x22"


def _element(tags: tuple[str, ...], opening: str, inner: str = "") -> str:
    """Whole elements of the tags; an alternative for each, as RE2 has no references back."""
    return "|".join(rf"<{t}{opening}>{inner}[\s\S]*?</{t}>" for t in tags)


def _default_grotesque(d: Dialect) -> str:
    stacks = d.all("cs", _FAMILY, 1)
    only = d.size(d.keep(stacks, lambda x: "not " + d.has(x, "|".join(rf"\b{f}\b" for f in GROTESQUES))))
    first = d.at(d.matches("cs", r"font-family\s*:\s*[^};]+"), 1)
    return f"case when {d.size(stacks)} > 0 and {only} = 0 then {d.row(f'({first}).line', d.left(d.trim(d.at(stacks, 1)), 80))} else {d.none()} end"


def _radii(d: Dialect) -> str:
    classes = d.join(d.all("html", r"class\s*=\s*\x22([^\x22]*)\x22", 1), "' '")
    return d.both(d.each(d.all("cs", r"border-radius\s*:\s*([^};]+)", 1), d.trim), d.all(classes, _RADIUS_WORD))


def _uniform_radius(d: Dialect) -> str:
    r = _radii(d)
    kinds, first = d.distinct(r), d.at(r, 1)
    n, n_first = d.size(r), d.size(d.keep(r, lambda x: f"{x} = {first}"))
    other = d.at(d.keep(r, lambda x: f"{x} <> {first}"), 1)
    top = f"(case when 2 * {n_first} >= {n} then {first} else {other} end)"
    share = f"(greatest({n_first}, {n} - {n_first}) / cast({n} as double))"
    usual = " or ".join((d.has(top, "rounded-(?:xl|2xl|3xl)", False), d.has(top, "^1[2-6]px$", False), d.has(top, r"^0?\.?(?:75|1|1\.5)rem$", False)))
    return f"case when {n} >= 3 and {d.size(kinds)} <= 2 and {share} >= 0.7 and ({usual}) then {d.row('null', top)} else {d.none()} end"


def _radius_hierarchy(d: Dialect) -> str:
    kinds = d.distinct(_radii(d))
    plain = d.has(d.trim(d.at(kinds, 1)), r"^(?:50%|0|0px|999px|9999px|rounded-full|rounded-none)$")
    return f"case when {d.size(kinds)} = 1 and not {plain} then {d.row('null', d.at(kinds, 1))} else {d.none()} end"


def _weights(d: Dialect) -> str:
    css = d.each(d.all("cs", r"font-weight\s*:\s*(black|bold|extrabold|light|medium|normal|semibold|thin|\d{3})", 1), lambda x: f"lower({x})")
    words = d.each(d.all("html", r"\bfont-(black|bold|extrabold|extralight|light|medium|normal|semibold|thin)\b", 1), lambda x: f"lower({x})")
    return d.size(d.distinct(d.both(css, words)))


def _families(d: Dialect) -> str:
    first = d.each(d.all("cs", _FAMILY, 1), lambda x: f"lower({d.sub(d.trim(d.one(x, '^[^,]*')), r'[\x22\x27]', '')})")
    return d.size(d.distinct(d.keep(first, lambda x: "not " + d.any_of(x, GENERIC))))


def _shadows(d: Dialect) -> str:
    found = d.both(d.each(d.all("cs", r"box-shadow\s*:\s*([^};]+)", 1), d.trim), d.all("html", r"\bshadow(?:-(?:soft|inner|none|2xl|xl|lg|md|sm))?\b"))
    return f"{d.size(found)} >= 3 and {d.size(d.distinct(found))} = 1"


def _flat_dark(d: Dialect) -> str:
    found = d.keep(d.matches("cs", r"background(?:-color)?\s*:\s*#(?:[a-f0-9]{6}|[a-f0-9]{3})"), lambda x: d.has(f"{x}.text", r"#(?:000000|09090b|0a0a0a|0f0f0f|0f172a|111111)$"))
    return f"case when {d.size(found)} > 0 then {d.row(f'({d.at(found, 1)}).line', f'({d.at(found, 1)}).text')} else {d.none()} end"


def _emoji_bullets(d: Dialect) -> str:
    # what follows an opening tag, up to the next tag or the end, if it has at most 20 units (a character beyond the basic plane has two)
    rest = lambda x: d.sub(f"{x}.text", r"^<li[^>]*>\s*", "")
    units = lambda x: f"(length({rest(x)}) + {d.size(d.all(rest(x), r'[\x{10000}-\x{10FFFF}]'))})"
    text = lambda x: d.trim(rest(x))
    first = r"^[\x{2600}-\x{27BF}\x{1F300}-\x{1FAFF}]"
    second = r"^[^\x{10000}-\x{10FFFF}][\x{2600}-\x{27BF}]"
    hit = lambda x: f"({units(x)} <= 20 and ({d.has(text(x), first, False)} or {d.has(text(x), second, False)}))"
    return d.each(d.keep(d.matches("html", r"<li[^>]*>[^<]*"), hit), lambda x: d.item(f"{x}.line", d.left(f"{x}.text", 80)))


def _cards(d: Dialect, m: str) -> str:
    inner = d.sub(m, r"^<[^>]*>", "")
    return "(" + " or ".join(f"{d.size(d.all(inner, rf'<{t}(?:[ \s][^>]*)?>'))} = 3" for t in ("div", "article", "li", "section")) + ")"


def _no_name(d: Dialect, m: str) -> str:
    tag, inner = d.one(m, r"^<[^>]*>"), d.sub(d.sub(m, r"^<[^>]*>", ""), r"</(?:a|button)>$", "")
    named = " or ".join(d.has(tag, p) for p in _NAMED)
    drawn = f"{d.has(inner, r'<svg[^>]*' + _NAMED[0])} or {d.has(inner, r'<img[^>]*\balt\s*[=]\s*[\x22\x27]\s*\S')}"
    return f"not ({named}) and {d.trim(d.sub(inner, '<[^>]+>', ''))} = '' and not ({drawn})"


def _heading_skips(d: Dialect) -> str:
    found = d.matches("html", "|".join(rf"<h{k}\b[^>]*>[\s\S]*?</h{k}>" for k in range(1, 7)))
    level = lambda x: f"cast(substring({x}.text, 3, 1) as int)"
    return d.each(d.pairs(found, lambda x, y: f"{level(x)} > {level(y)} + 1"), lambda x: d.item(f"{x}.line", d.left(f"{x}.text", 140)))


def _body_measure(d: Dialect) -> str:
    blocks = d.all("cs", r"[^{}]+\{[^{}]*\}")
    like = r"(?:^|[\s,])(?:\[data-content\]|\.(?:article|body|content|copy|lede|main|post|prose|rich-text|text)|article|body|html|main)\b"
    width = r"(?:max-)?width\s*:\s*\d+(?:\.\d+)?(?:ch|rem|em|px)"
    selector = lambda x: d.trim(d.one(x, r"^[^{]*"))
    body = lambda x: d.one(d.one(x, r"\{[\s\S]*"), width)
    n = lambda x: d.double(d.one(body(x), r"(\d+(?:\.\d+)?)ch$", 1, False))
    return d.size(d.keep(blocks, lambda x: f"{d.has(selector(x), like)} and coalesce({n(x)} < 45 or {n(x)} > 85, false)")) + " > 0"


def _symmetry(d: Dialect) -> str:
    box = d.split(d.one("html", r"<svg[^>]*viewBox\s*[=]\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]", 1, False), r"\s+")
    mid = f"({d.double(d.at(box, 3))} / 2)"
    number = lambda x: d.double(d.one(x, r"^-?(?:\d+\.?\d*|\.\d+)"))
    xs = d.keep(d.each(d.all("html", r"(?:x|cx)\s*=\s*[\x22\x27]([-\d.]+)[\x22\x27]", 1), number), lambda x: f"{x} is not null")
    left, right = d.size(d.keep(xs, lambda x: f"{x} < {mid}")), d.size(d.keep(xs, lambda x: f"{x} > {mid}"))
    return f"{d.contains('html', '<svg')} and {d.size(box)} >= 4 and {d.size(xs)} >= 6 and abs({left} - {right}) / cast(greatest(1, {d.size(xs)}) as double) < 0.05"


def _strokes(d: Dialect) -> str:
    found = d.both(d.all("html", r"stroke-width\s*=\s*[\x22\x27]?([\d.]+)[\x22\x27]?", 1), d.all("html", r"stroke-width\s*:\s*([0-9.]+)", 1))
    return f"{d.contains('html', '<svg')} and {d.size(found)} >= 4 and {d.size(d.distinct(found))} = 1 and {d.any_of(d.at(found, 1), ('1', '1.5', '2'))}"


RULES = [
    Rule("no-default-grotesque", "error", "Every font stack is one of eight usual sans faces.", ("font-family",), _default_grotesque),
    Rule("no-purple-blue-gradient", "error", "A gradient of two or more of the usual violet to blue hues.", ("linear-gradient", "radial-gradient", "bg-gradient-to-"), _all(_each("csh", r"(?:linear|radial)-gradient\s*\([^)]*\)", 80, lambda d, m: f"{d.n_of(m, HUES)} >= 2"), _each("csh", _CLASS + r"[^\x22]*bg-gradient-to-[^\x22]*\x22", 120, lambda d, m: f"{d.n_of(m, [f'(?:from|via|to)-{h}-' for h in HUES])} >= 2"))),
    Rule("no-emoji-bullets", "error", "A list item that starts with an emoji.", ("<li",), _emoji_bullets),
    Rule("no-gradient-text", "error", "Gradient text on words that promise the future.", ("class",)),
    Rule("no-slop-copy", "warn", "Worn marketing phrases in running text."),
    Rule("weight-variety", "warn", "Fewer than three font weights.", ("font-",), _once(lambda d: f"{_weights(d)} between 1 and 2")),
    Rule("require-type-pairing", "error", "One font family alone.", ("font-family",), _once(lambda d: f"{_families(d)} = 1")),
    Rule("no-fake-testimonials", "warn", "Portraits from a stock avatar service.", ("dicebear", "ui-faces", "uifaces", "randomuser", "pravatar"), _all(*(_each("html", h.replace(".", r"\."), None) for h in AVATARS))),
    Rule("no-flat-dark-mode", "warn", "A flat near-black background.", ("background",), _flat_dark),
    Rule("no-shimmer-decoration", "warn", "A shimmer effect.", ("shimmer", "shine", "sparkle-sweep"), _each("csh", r"\b(?:ai-shimmer|animate-shimmer|shimmer|shine|sparkle-sweep)\b", 80)),
    Rule("no-uniform-radius", "warn", "One usual corner radius nearly everywhere.", ("radius", "rounded"), _uniform_radius),
    Rule("no-three-equal-cards", "warn", "A container with three children of one kind.", ("grid", "flex"), _each("html", _element(("section", "div", "ul"), r"[^>]*" + _CLASS + r"[^\x22]*(?:grid\s+cols-3|flex[^\x22]*(?:space|gap)-[^\x22]*|grid-cols-3)[^\x22]*\x22[^>]*"), 120, _cards)),
    Rule("no-lucide-in-rounded-square", "warn", "A stock icon in a rounded tile.", ("rounded-",), _all(*(_each("html", rf"<(?:div|span)[^>]*{_CLASS}[^\x22]*\brounded-(?:full|2xl|xl|lg|md)\b[^\x22]*(?:bg-blue-|bg-gradient|bg-indigo-|bg-purple-|bg-violet-)[^\x22]*\x22[^>]*>[\s\S]{{0,200}}?<{n}\b", 120) for n in ICONS))),
    Rule("no-indiscriminate-glass", "warn", "Blurred backdrops in several places.", ("backdrop-",), _once(lambda d: f"{d.size(d.all('csh', r'backdrop-filter\s*:\s*blur[(][^)]+[)]'))} + {d.size(d.all('csh', r'\bbackdrop-blur(?:-[0-9a-z]+)?\b'))} >= 2")),
    Rule("single-shadow-style", "info", "The same shadow on everything.", ("shadow",), _once(_shadows)),
    Rule("no-centered-hero", "warn", "A centred container around the first heading.", ("text-center", "items-center", "max-w-"), _each("html", rf"<(?:div|header|main|section)[^>]*{_CLASS}[^\x22]*(?:mx-auto[^\x22]*max-w-|items-center[^\x22]*justify-center|text-center)[^\x22]*\x22[^>]*>[\s\S]{{0,1000}}?[\s\S]{{0,1000}}?<h1\b[\s\S]{{0,500}}?</h1>", 140)),
    Rule("respect-reduced-motion", "error", "Motion without a reduced-motion variant.", ("@keyframes", "animation", "transition"), _once(lambda d: f"({d.has('cs', r'@keyframes\s+')} or {d.has('cs', r'\banimation\s*:')} or {d.has('cs', r'\btransition\s*:[^};]*\d{2,}ms')}) and not {d.has('cs', r'@media\s*[(][^)]*prefers-reduced-motion[^)]*[)]')}")),
    Rule("line-height-per-size", "warn", "One line height for all sizes.", ("line-height",), _once(lambda d: d.size(d.distinct(d.each(d.all("cs", r"line-height\s*:\s*([^};]+)", 1), lambda x: f"lower({d.trim(x)})"))) + " = 1")),
    Rule("body-measure", "warn", "Body text set too narrow or too wide.", ("width",), _once(_body_measure)),
    Rule("require-named-grid", "warn", "Stacked layout without any grid.", ("flex", "container", "section"), _once(lambda d: f"not ({d.has('csh', r'display\s*:\s*grid')} or {d.has('csh', r'grid-template(?:-columns)?\s*:')} or {d.has('csh', r'\bgrid-cols-\d+\b', False)}) and {d.has('html', _CLASS + r'[^\x22]*(?:flex|container|section)')}")),
    Rule("no-default-spline", "warn", "A stock three-dimensional scene.", ("spline", "iridescent"), _all(*(_each("html", p, 80) for p in (r"spline\.design/[^\x22\x27]+default", r"prod\.spline\.design/\w+/scene\.splinecode", r"iridescent-?blob", r"orb\.splinecode")))),
    Rule("pricing-not-three", "info", "Three price tiers with a favourite.", ("pricing",), _each("html", _element(("section", "div"), r"[^>]*(?:class|id)\s*=\s*\x22[^\x22]*pricing[^\x22]*\x22[^>]*"), None, lambda d, m: f"{d.has(d.sub(m, '^<[^>]*>', ''), r'recommended|best[\s-]?value|most[\s-]?popular')} and {d.size(d.all(d.sub(m, '^<[^>]*>', ''), r'\bplan\b|\btier\b'))} >= 3")),
    Rule("footer-not-four-col", "info", "A footer of the usual four columns.", ("<footer",), _each("html", r"<footer\b[\s\S]*?</footer>", None, lambda d, m: f"{d.n_of(m, [rf'\b{w}\b' for w in ('Product', 'Company', 'Resources', 'Legal')])} >= 3")),
    Rule("motion-has-intent", "warn", "Much motion without a declared reason.", ("animate", "data-aos", "motion", "initial"), _once(lambda d: f"{d.size(d.all('csh', r'\b(?:data-aos|framer-motion|(?:animate|motion)-(?:slide|fade)-up|(?:animate|initial)=\{)\b'))} >= 4 and not {d.has('csh', 'delayChildren|stagger-|data-(?:aos-delay|motion)')}")),
    Rule("no-fake-trust-bar", "info", "A strip of logos under a claim of trust.", ("trusted by", "backed by", "as seen in", "featured in"), _each("html", r"(?:as seen in|backed by|featured in|trusted by)[\s\S]{0,400}", None, lambda d, m: f"{d.size(d.all(m, r'<img\b|<svg\b'))} >= 3")),
    Rule("cta-not-canonical", "info", "A gradient button with an arrow.", ("bg-gradient-", "from-"), _each("html", _element(("a", "button"), rf"[^>]*{_CLASS}[^\x22]*(?:from-\w+-\d+|bg-gradient-)[^\x22]*\x22[^>]*", r"[\s\S]{0,300}?(?:\x{2192}|&rarr;|<svg[^>]*(?:chevron|arrow)[^>]*>)"), 120)),
    Rule("tracking-per-size", "warn", "Large or all-caps type without its own tracking.", ("font-size", "text-transform")),
    Rule("radius-hierarchy", "warn", "One corner radius for all kinds of parts.", ("radius", "rounded"), _radius_hierarchy),
    Rule("no-inline-style-animation", "error", "Motion declared in a style attribute.", ("animation", "transition"), _each("html", r"\bstyle\s*=\s*(?:\x22[^\x22]*\b(?:animation|transition)\s*:[^\x22]*\x22|\x27[^\x27]*\b(?:animation|transition)\s*:[^\x27]*\x27)", 140)),
    Rule("no-em-dashes-in-prose", "warn", "A long dash in running text.", ("—", "&")),
    Rule("a11y/img-without-alt", "error", "An image without alternative text.", ("<img",), _each("html", r"<img\b[^>]*>", 140, lambda d, m: "not " + d.has(m, r"\balt\s*="))),
    Rule("a11y/button-without-label", "error", "A button without a name.", ("<button",), _each("html", r"<button\b[^>]*>[\s\S]*?</button>", 140, _no_name)),
    Rule("a11y/link-without-text", "error", "A link without a name.", ("<a",), _each("html", r"<a\b[^>]*>[\s\S]*?</a>", 140, lambda d, m: f"{d.has(d.one(m, '^<[^>]*>'), r'\bhref\s*=')} and {_no_name(d, m)}")),
    Rule("a11y/heading-skip", "warn", "A heading that skips a level.", ("<h3", "<h4", "<h5", "<h6"), _heading_skips),
    Rule("spa-shell-detected", "info", "An empty shell that a script fills.", ("<script",)),
    Rule("svg/no-uniform-stroke", "warn", "All strokes of one usual width.", ("<svg",), _once(_strokes)),
    Rule("svg/palette-bounds", "info", "More than six colours.", ("<svg",), _once(lambda d: f"{d.contains('html', '<svg')} and {d.size(d.distinct(d.each(d.all('html', r'#(?:[a-f0-9]{6}|[a-f0-9]{3})\b'), lambda x: f'lower({x})')))} > 6")),
    Rule("svg/no-perfect-symmetry", "info", "A drawing mirrored about its middle.", ("<svg",), _once(_symmetry)),
]

NATIVE = [r for r in RULES if r.find]
BY_ID = {r.rule_id: r for r in RULES}
