"""The corpus that the queries read: the page table, each page with one of our fragments at its end.

The pages alone have no images, buttons or styles to speak of. Fragments are
chosen by page number, in the same way in Spark and in the SQL that checks it, so that
each rule has hits and misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAGMENTS = [
    "",
    '<style>body{font-family:Inter, sans-serif}\n.a{font-family:"Roboto"}</style>',
    '<style>body{font-family:Inter}h1{font-family:"Fraunces", serif}\np{line-height:1.5}</style>',
    '<style>.hero{background:linear-gradient(90deg, indigo, purple 40%)}</style>\n<div class="bg-gradient-to-r from-indigo-500 to-pink-500">x</div>',
    '<style>.hero{background:radial-gradient(red, blue)}</style>\n<div class="bg-gradient-to-r from-indigo-500 to-red-500">x</div>',
    "<ul><li>\U0001f680 Fast</li>\n<li> ✨ Bright</li><li>Plain</li><li>a\U0001f680</li><li>x✨</li></ul>",
    '<h1 class="bg-clip-text bg-gradient-to-r">The future of work</h1><style>.g{background-clip:text}</style><p class="g big">AI for all</p>',
    "<p>We ship faster — and seamless</p>\n<p>code <code>a — b</code> here</p>",
    '<style>b{font-weight:400}i{font-weight:BOLD}</style><b class="font-bold">x</b>',
    '<style>b{font-weight:400}i{font-weight:bold}</style><b class="font-thin font-black">x</b>',
    '<img id=q src="https://api.dicebear.com/9/x.svg">\n<img src="https://i.pravatar.cc/3" alt="">\n<img data-alt="q">',
    "<style>body{background:#0A0A0A;color:red}\np{background-color:#000000}</style>",
    "<style>body{background:#fff}\np{background-color: #111111}</style>",
    '<style>@keyframes shimmer{from{left:0}}\n.x{animation: shine 2s}</style><i class="animate-shimmer"></i>',
    '<i class="rounded-xl"></i><i class="a rounded-xl"></i><i class="rounded-xl b"></i><i class="rounded-full"></i>',
    "<style>a{border-radius:12px}b{border-radius: 12px }i{border-radius:12px}</style>",
    "<style>a{border-radius:9999px}b{border-radius: 9999px }</style>",
    '<section class="grid grid-cols-3 gap-4"><article>1</article>\n<article>2</article><article>3</article></section>',
    '<div class="flex gap-2"><p>1</p><li>2</li></div><ul class="flex space-x-2"><li>1</li><li>2</li><li>3</li></ul>',
    '<div class="p-2 rounded-xl bg-indigo-100"><Zap size=3 /></div>\n<span class="rounded-lg bg-gradient-to-r"> <Wand2/></span>',
    '<style>a{backdrop-filter: blur(4px)}</style><i class="backdrop-blur-md"></i>',
    '<i class="backdrop-blur"></i>',
    '<i class="shadow-md"></i><i class="shadow-md"></i><i class="shadow-md"></i>',
    "<style>a{box-shadow:0 1px 2px #000}b{box-shadow:0 1px 3px #000}i{box-shadow:none}</style>",
    '<section class="py-8 text-center">\n<p>x</p><h1>Big</h1></section>',
    '<header class="mx-auto px-2 max-w-3xl"><h2>no</h2></header>',
    "<style>.a{transition: all 300ms}</style>",
    "<style>.a{transition: all 0.3s}.b{animation: x 1s}\n@media (prefers-reduced-motion: reduce){.b{animation:none}}</style>",
    "<style>p{line-height:1.5}h1{line-height: 1.5 }</style>",
    "<style>main p{max-width:30ch}\n.content{max-width:65ch}body{width:20ch}</style>",
    "<style>.content{max-width:65ch;width:10ch}article{width:600px}</style>",
    '<div class="container mx-auto">x</div>',
    '<div class="container grid-cols-2">x</div><style>.q{display:grid}</style>',
    '<iframe src="https://my.spline.design/x-default"></iframe><img src="iridescentblob.png" alt="b"><i data-x="orb.splinecode"></i>',
    '<section id="pricing-x"><p>Most popular</p>tier one, plan two, tier three</section>\n<div class="pricing">plan</div>',
    "<footer><a href=\"/product\">Product</a> Company\nLegal</footer>",
    "<footer>Product only</footer><footer>company resources LEGAL product</footer>",
    '<i class="animate-fade-up" ></i><i class="animate-slide-up"></i><i data-aos="x"></i><i class="animate-fade-up"></i>',
    '<i class="animate-fade-up" data-motion="x"></i><i class="animate-slide-up"></i><i data-aos="x"></i><i class="animate-fade-up"></i>',
    '<p>Trusted by</p><img src="a" alt="a"><svg></svg>\n<img src="b" alt="b">',
    '<a class="bg-gradient-to-r p-2" href="/go">Start now →</a>\n<button class="from-indigo-500">Go <svg class="arrow"></svg></button>',
    "<style>:root{--big:64px}h1{font-size:var(--big)}.k{text-transform:uppercase;letter-spacing:0}</style>",
    "<style>h1{font-size:4rem;letter-spacing:-0.02em}.k{text-transform:uppercase;letter-spacing:.08em}</style>",
    "<p style=\"color:red; animation: x 1s\">a</p>\n<p style='transition: all 1s'>b</p><p style=\"color:blue\">c</p>",
    '<button></button><button aria-label="x"></button>\n<button><svg aria-label="y"></svg></button><button> <i></i> </button><button>ok</button>',
    '<a href="/x"></a><a name="y"></a>\n<a href="/z"><img src="q" alt="Q"></a><a href="/t" title="T"></a><a href="/u"><svg></svg></a>',
    "<h1>a</h1>\n<h3>b</h3><h4>c</h4>\n<h2>d</h2><h5>e</h5>",
    '<svg viewBox="0 0 100 100"><g stroke-width="2"/><g stroke-width="2"/><g stroke-width=\'2\'/><g style="stroke-width:2"/></svg>',
    '<svg viewBox="0 0 100 100"><c x="10" cx="90"/><c x="20" cx="80"/><c x="30" cx="70"/></svg>',
    '<svg viewBox="0 0 100 100"><c x="10" fill="#aaa"/><c fill="#BBB"/><c fill="#ccc"/><c fill="#ddd"/><c fill="#eee111"/><c fill="#fff"/><c fill="#123456"/></svg>',
    '<meta name="style-token" content="swiss-editorial"><a href="/de/825?x=1">t</a>',
    "<!-- style-token: post-digital-green --><a href='/nowhere/#a'>t</a><a href=\"/assets/x.png\">u</a>",
    "<ul><li>\u2728 this item is far too long for it</li><li>\u2728 last</li></ul><style>body{font-family: 'Soehne', sans-serif}</style>",
]


def fragment(number) -> F.Column:
    return F.element_at(F.array(*map(F.lit, FRAGMENTS)), (number % len(FRAGMENTS) + 1).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, html)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", "url", F.concat("html", F.lit("\n"), fragment(F.col("page_id"))).alias("html"))


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CORPUS_SQL = f"(select page_id, url, html || chr(10) || ([{', '.join(map(_text, FRAGMENTS))}])[page_id % {len(FRAGMENTS)} + 1] as html from pages)"
