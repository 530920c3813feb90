"""Pairs of pages that set a rule off and don't, for every rule."""

import pytest

from sieveloom.operators.lint import lint
from sieveloom.operators.rules import RULES, Rule
from sieveloom.operators.overrides import applied

CASES = {
    "no-default-grotesque": ("<style>a{font-family:Inter}</style>", "<style>a{font-family:Inter}b{font-family:Fraunces}</style>"),
    "no-purple-blue-gradient": ("<style>a{background:linear-gradient(indigo, pink)}</style>", "<style>a{background:linear-gradient(indigo, white)}</style>"),
    "no-emoji-bullets": ("<ul><li>\U0001f680 go</li></ul>", "<ul><li>go \U0001f680 now</li></ul>"),
    "no-gradient-text": ('<h1 class="text-transparent bg-gradient-to-r">Your AI</h1>', '<h1 class="text-transparent bg-gradient-to-r">Your tea</h1>'),
    "no-slop-copy": ("<p>Unleash it</p>", "<p><code>unleash</code> it</p>"),
    "weight-variety": ("<style>a{font-weight:400}</style>", "<p>no weights</p>"),
    "require-type-pairing": ("<style>a{font-family:'Soehne', serif}</style>", "<style>a{font-family:serif}</style>"),
    "no-fake-testimonials": ("<img src='https://randomuser.me/1' alt=''>", "<img src='/me.jpg' alt=''>"),
    "no-flat-dark-mode": ("<style>a{background:#0a0a0a}</style>", "<style>a{background:#0a0a1a}</style>"),
    "no-shimmer-decoration": ("<i class='shimmer'></i>", "<i class='glimmer'></i>"),
    "no-uniform-radius": ("<style>a{border-radius:12px}b{border-radius:12px}i{border-radius:12px}</style>", "<style>a{border-radius:12px}b{border-radius:0}i{border-radius:3px}</style>"),
    "no-three-equal-cards": ('<ul class="grid-cols-3"><li>1<li>2<li>3</ul>', '<ul class="grid-cols-3"><li>1<li>2</ul>'),
    "no-lucide-in-rounded-square": ('<div class="rounded-lg bg-blue-500"><Zap/></div>', '<div class="rounded-lg bg-red-500"><Zap/></div>'),
    "no-indiscriminate-glass": ("<i class='backdrop-blur-sm'></i><i class='backdrop-blur'></i>", "<i class='backdrop-blur'></i>"),
    "single-shadow-style": ("<i class='shadow'></i><i class='shadow'></i><i class='shadow'></i>", "<i class='shadow'></i><i class='shadow-lg'></i><i class='shadow'></i>"),
    "no-centered-hero": ('<header class="text-center"><h1>a</h1></header>', '<header class="text-left"><h1>a</h1></header>'),
    "respect-reduced-motion": ("<style>a{animation: x 1s}</style>", "<style>a{animation: x 1s}@media (prefers-reduced-motion: reduce){a{animation:none}}</style>"),
    "line-height-per-size": ("<style>a{line-height:1.5}</style>", "<style>a{line-height:1.5}b{line-height:1.1}</style>"),
    "body-measure": ("<style>body{max-width:95ch}</style>", "<style>body{max-width:65ch}</style>"),
    "require-named-grid": ('<div class="flex"></div>', '<div class="flex grid-cols-2"></div>'),
    "no-default-spline": ("<i data-x='orb.splinecode'></i>", "<i data-x='orb.code'></i>"),
    "pricing-not-three": ('<div class="pricing">best value plan plan plan</div>', '<div class="pricing">plan plan plan</div>'),
    "footer-not-four-col": ("<footer>Product Company Legal</footer>", "<footer>Products Company Legal</footer>"),
    "motion-has-intent": ("<i data-aos=1></i>" * 4, "<i data-aos=1></i>" * 4 + "<i data-motion=1></i>"),
    "no-fake-trust-bar": ("Trusted by <svg></svg><svg></svg><svg></svg>", "Trusted by <svg></svg><svg></svg>"),
    "cta-not-canonical": ('<a class="from-blue-500">Go &rarr;</a>', '<a class="blue">Go &rarr;</a>'),
    "tracking-per-size": ("<style>:root{--s:60px;}h1{font-size:var(--s)}</style>", "<style>:root{--s:60px;}h1{font-size:var(--s);letter-spacing:-1px}</style>"),
    "radius-hierarchy": ("<style>a{border-radius:4px}</style>", "<style>a{border-radius:50%}</style>"),
    "no-inline-style-animation": ('<i style="animation: x"></i>', '<i style="color: red"></i>'),
    "no-em-dashes-in-prose": ("<p>a — b</p>", "<pre>a — b</pre>"),
    "a11y/img-without-alt": ("<img src=a>", "<img src=a alt=''>"),
    "a11y/button-without-label": ("<button><i></i></button>", "<button title='x'></button>"),
    "a11y/link-without-text": ("<a href='/'> </a>", "<a name='x'> </a>"),
    "a11y/heading-skip": ("<h1>a</h1><h3>b</h3>", "<h1>a</h1><h2>b</h2>"),
    "spa-shell-detected": ('<body><div id=\'root\'></div><script src="/assets/x.js"></script></body>', '<body><div id=\'root\'>hi</div><script src="/assets/x.js"></script></body>'),
    "svg/no-uniform-stroke": ("<svg>" + "<p stroke-width='2'/>" * 4, "<svg>" + "<p stroke-width='2'/>" * 3),
    "svg/palette-bounds": ("<svg>" + "".join(f"#a{k}b " for k in range(7)), "<svg>" + "".join(f"#a{k}b " for k in range(6))),
    "svg/no-perfect-symmetry": ('<svg viewBox="0 0 10 10">' + '<c x="1"/><c x="9"/>' * 3, '<svg viewBox="0 0 10 10">' + '<c x="1"/>' * 6),
}


@pytest.fixture(scope="module")
def fired(spark):
    pages = [(f"{rule}:{k}", html) for rule, pair in CASES.items() for k, html in enumerate(pair)] + [("null", None), ("empty", "")]
    found = lint(spark.createDataFrame(pages, "file string, html string"))
    return {(r["file"], r["rule_id"]) for r in found.collect()}


@pytest.mark.parametrize("rule", [r.rule_id for r in RULES])
def test_rule(fired, rule):
    assert (f"{rule}:0", rule) in fired
    assert (f"{rule}:1", rule) not in fired


def test_null_and_empty_pages_have_no_findings(fired):
    assert not {f for f, _ in fired} & {"null", "empty"}


def test_lines_count_from_one(spark):
    found = lint(spark.createDataFrame([("a", "x\n<img>\n\n<img>")], "file string, html string"), [r for r in RULES if r.rule_id == "a11y/img-without-alt"])
    assert sorted(r["line"] for r in found.collect()) == [2, 4]


def test_a_rule_that_raises_is_a_finding(spark):
    own = Rule("own/rule", "warn", "mine")

    def broken(html, css):
        raise ValueError("no")

    row = lint(spark.createDataFrame([("a", "x")], "file string, html string"), [own], {"own/rule": "error"}, functions={"own/rule": broken}).first()
    assert (row["rule_id"], row["severity"], row["message"]) == ("own/rule", "error", "rule threw: no")


def test_overrides(spark):
    rules = applied(RULES, {"no-slop-copy": "off", "a11y/heading-skip": "error"})
    assert len(rules) == len(RULES) - 1
    assert next(r for r in rules if r.rule_id == "a11y/heading-skip").severity == "error"
    none = lint(spark.createDataFrame([("a", "<img>")], "file string, html string"), [])
    assert none.count() == 0 and "rule_id" in none.columns
