import html
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import wrappers as W

LINE = "Some words that only this page has, number"


def fits(content):
    """The expression as a pattern over a page's stream."""

    def item(m):
        body = f"<{re.escape(m[0])}>(?:{fits(m[3])})</>"
        return f"(?:{body})" + (("*" if m[1] else "+") if m[2] else "?" if m[1] else "")

    return "".join(f"(?:{''.join(map(item, ms))})+" if repeated else "".join(map(item, ms)) for repeated, ms in content)


def stream(node):
    return "".join(f"<{x.label}>{stream(x)}</>" if isinstance(x, W.Node) else "<#></>" for x in node.items if isinstance(x, W.Node) or x.strip())


def tree(rng, depth=0):
    if depth == 3 or rng.random() < 0.2:
        return "text "
    tags = ["div", "p", "section", "ul", "h2", 'div class="a"', "table"]
    return "".join(f"<{t}>{tree(rng, depth + 1)}</{t.split()[0]}>" for t in rng.choices(tags, k=rng.randint(0, 4))) + rng.choice(["", "tail"])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 5))
def test_wrappers_fit_every_page_they_came_from(seed, n):
    rng = random.Random(seed)
    roots = [W.parse(tree(rng)) for _ in range(n)]
    whole = W.content_of(roots[0])
    for r in roots[1:]:
        whole = W.align(whole, W.content_of(r))
    for r in roots:
        assert re.fullmatch(fits(whole), stream(r))
    again = W.content_of(roots[0])
    assert W.align(whole, whole) == whole and re.fullmatch(fits(W.align(again, whole)), stream(roots[0]))

    def labels(content):
        for _, ms in content:
            for m in ms:
                yield m[0]

    def unique(content):
        found = list(labels(content))
        assert len(found) == len(set(found))
        for _, ms in content:
            for m in ms:
                unique(m[3])

    unique(whole)


def test_optional_and_repeated():
    page = lambda *x: W.content_of(W.parse("".join(f"<{t}>x</{t}>" for t in x)))
    assert W.expression(page("p", "p", "p")) == "(p [#])+"
    assert W.expression(W.align(page("h1", "p"), page("h1", "ul", "p", "p"))) == "h1 [#] (ul [#])? (p [#])+"
    assert W.expression(page("h2", "p", "h2", "p")) == "((h2 [#])? (p [#])?)+"
    assert W.expression(W.align(page("p", "ul"), page("ul", "p"))) == "((p [#])? (ul [#])?)+"


SEMANTIC = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>H</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<!-- a --><div class="ad">Buy</div><article><h1>Head {i}</h1><p><b>{line} {i} &amp;amp; caf&eacute;<br>next<p>Two&nbsp;<i>s</i>ix &lt;b&gt;</p><div class="share">Share</div><aside>aside</aside><section id="comments"><article class="comment">Nice</article></section></article><footer>F</footer>"""
SEMANTIC_TEXT = "Head {i} {line} {i} &amp; café next Two six <b>"
NAMED = """<div id="page"><div class="main-menu"><a>x</a></div><div class="post-body"><p>{line} {i}</p>tail<ul><li>one<li>two</ul></div><form>f<input></form><div class="cookie-notice">Cookies</div><ol class="commentlist"><li>c</li></ol></div>"""
NAMED_TEXT = "{line} {i} tail one two"
BARE = """<html><body><div class="x1"><a href="/1">Home page and more</a> <a href="/2">All other things</a></div><div class="x2"><div class="x3">{line} {i}<p>More of {i}</p><div class="x5">We are a company of many good people, since always.</div></div></div><div class="x4">All of this is ours.</div></body></html>"""
BARE_TEXT = "{line} {i} More of {i}"
LAYOUTS = {"http://a.x/": (SEMANTIC, SEMANTIC_TEXT), "http://b.x/": (NAMED, NAMED_TEXT), "http://c.x/": (BARE, BARE_TEXT)}


def rows():
    out = [(f"{u}{i}", page.format(i=i * 7919, line=LINE), text.format(i=i * 7919, line=LINE)) for u, (page, text) in LAYOUTS.items() for i in range(6)]
    out.append(("http://a.x/odd", "<main><p>Only main here</p></main>", "Only main here"))
    out += [(None, None, ""), ("no scheme", "", ""), (None, "<p>plain", "plain"), ("http://d.x/", "just text &amp; more", "just text & more"), ("http://d.x/", "just text &amp; more", "just text & more")]
    out.append(("http://e.x/", "<article>" + "<div>" * 500 + "deep" + "</div>" * 500 + " end</article> outside <a", "deep end"))
    out.append(("http://f.x/", "<article><p>" + "word " * 300_000 + "</article>", ("word " * 300_000).strip()))
    out.append(("http://g.x/", '<article><a title="a > b">1 < 2</a> and <x-y>custom</x-y><table><tr><td>p<td>q<tr><td>r</table></article>', "1 < 2 and custom p q r"))
    return out


def test_query_on_layouts(spark, tmp_path):
    data = [(i, u, h) for i, (u, h, _) in enumerate(rows())]
    spark.createDataFrame(data, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r for r in W.op12_html_wrappers(spark, str(tmp_path)).collect()}
    assert len(got) == len(data)
    for i, (u, _, text) in enumerate(rows()):
        assert (got[i]["url"], got[i]["text"], got[i]["n_chars"]) == (u, text, len(text)), u


def test_wrappers_do_not_depend_on_how_pages_are_dealt(spark):
    data = [(u, h) for u, h, _ in rows()]
    tables = [W.infer_wrappers(spark.createDataFrame(d, "url string, html string").repartition(n)).orderBy("host").collect() for d, n in ((data, 1), (data[::-1], 7))]
    assert tables[0] == tables[1]
    of = {r["host"]: r for r in tables[0]}
    assert re.sub(r"\.[0-9a-f]{2}", "", of["b.x"]["pattern"]) == "div [div! div* [p [#] # ul [(li [#])+]] form! div! ol!]"
    assert of["c.x"]["dropped"] and all(p.startswith(of["c.x"]["main"]) for p in of["c.x"]["dropped"])


def test_empty_tables_and_extra_columns(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op12_html_wrappers(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([("1", "http://a/", "<p>x", "m", "h", "t")], "page_id string, url string, html string, main string, host string, text string")
    wrappers = W.infer_wrappers(df)
    assert [tuple(r) for r in W.extract(df, wrappers).collect()] == [("1", "http://a/", "x", "")]


def test_given_pages_hold_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in W.op12_html_wrappers(spark, "/root/testdata/sf0.001").collect()}
    for p in pages:
        body = re.search(r"<article>(.*?)(?:</article>|$)", p["html"], re.S)[1]
        assert got[p["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", body))).split())
