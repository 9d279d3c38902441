"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of a host.

A page becomes a stream of block elements and text slots (elements that only mark up a line are part of its text). Its content model
is a union-free expression: items in order, each one once, optional (?) or repeated (+), and repeated groups of items. Within a
page, items that follow one another are folded into one; an item that comes back after others makes a repeated group of all from
its first place on. Two expressions are aligned by a longest common sequence of items: items that meet are merged, mismatches
become optional, and again what comes back becomes a repeated group. So an item stands once below its parent, an expression is bounded
by the labels there are, and a page's elements are told apart by their path of labels alone.

Expressions of a host's pages, as far as they differ, are aligned one by one in the order of their text, first within buckets by
hash, then bucket by bucket; a task holds one expression, and only distinct ones are shuffled, however many pages a host has. Text
slots gather pages, characters, linked characters and least and greatest hash of text by sums and extremes; a slot whose text is the
same on at least SAME pages belongs to the template.

The host's main part is, by the expression and its slots: the article with most text; else the main element; else the part
named as content that has most text, as far down as one holds SHARE of it; else the way down from the root while one part holds SHARE of the
varying unlinked text, without template slots and link lists. Parts that are menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles or comments, by element or by the words of class, id and role, never count. A page that lacks
its host's main part, or has no text there, is judged by itself, in the same way.

Defined results: null or empty html has the empty text; urls that are null or have no `://` are one host; elements that are not closed end
as HTML says, or with what holds them; an unfinished tag at the end is dropped; below DEEPEST open elements, further ones count
as parts of the last; repeated rows stay; an empty table gives an empty result; extra columns are ignored. Texts are whole.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table
from .urls import split_url

SAME, SHARE, BUCKETS, DEEPEST, HELD = 3, 0.7, 256, 100, 20_000

# Elements of HTML by what they do, and words of class, id and role by what they say.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
DROPPED = set("head nav header footer aside form script style noscript template iframe svg object audio video canvas map select button textarea option dialog menu title xmp noembed noframes".split())
HEAD = set("base link meta noscript script style template title".split())
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES |= {t: ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
NAMED = re.compile(
    r"(nav|navbar|navigation|menus?|header|masthead|topbar|foot|footer|sidebar|side|aside|ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|notification|popup|modal|overlay|newsletter|subscri\w*"
    r"|signup|login|register|share|sharing|social|related|recommend\w*|breadcrumbs?|pagination|pager|comment\w*|repl(?:y|ies)|respond|disqus|widgets?|search\w*|copyright|legal|toolbar|skip|hidden|alert|disclaimer|contentinfo|complementary)"
)
CONTENT = re.compile(r"(article\w*|content|maincontent|main|post|entry|story|body|text)")
KEPT = {"html", "body", "main", "article"}  # what such a class says of them, says it of a part of theirs, but for articles of comments
ASIDE = re.compile(r"(comment\w*|repl(?:y|ies)|related|recommend\w*|promo\w*|sponsor\w*|ads?|advert\w*)")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[/!?A-Za-z][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|\Z", re.I) for t in RAW}

Content = list  # of groups [repeated, [[label, optional, repeated, content], ...]]


def label_of(tag: str, attributes: str) -> tuple[str, bool]:
    """An element's label, and whether it is left out: element, role mark, and a bucket of its class name, so that labels are bounded."""
    at = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)} if attributes.strip(" /") else {}
    names = at.get("class", "").lower().split() + at.get("role", "").lower().split()
    if tag != "p" and not re.fullmatch("h[1-6]", tag):
        names += at.get("id", "").lower().split()
    if "main" in at.get("role", "").lower().split():
        tag = "main"
    words = [re.findall("[a-z]+", n) for n in names]
    telling = [w for w in words if not {"with", "has", "no", "without"} & set(w)]
    pattern = ASIDE if tag in ("article", "main") else NAMED
    out = tag in DROPPED or tag not in ("html", "body") and any(pattern.fullmatch(x) for w in telling for x in w)
    out |= "hidden" in at or at.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I))
    mark = "!" if out else "*" if any(CONTENT.fullmatch(x) for w in words for x in w) else ""
    first = next((n for n in at.get("class", "").lower().split()), re.sub("[^a-z]", "", at.get("id", "").lower()))  # ids count pages up
    known = tag if re.fullmatch("[a-z][a-z0-9]{0,14}", tag) else "div"
    return known + mark + (f".{zlib.crc32(first.encode()) & 255:02x}" if first and tag not in KEPT else ""), out


class Node:
    __slots__ = ("items", "label", "linked", "out", "tag")

    def __init__(self, tag: str, label: str, out: bool):
        self.tag, self.label, self.out, self.items, self.linked = tag, label, out, [], 0

    def add(self, text: str, link: bool) -> None:
        if not self.out:
            self.linked += len(text) if link else 0
            if self.items and isinstance(self.items[-1], str):
                self.items[-1] += text
            else:
                self.items.append(text)


def parse(page: str) -> Node:
    """The page's tree of block elements; inside what is left out nothing is kept."""
    root = Node("", "", False)
    stack, at, link, texts = [root], 0, 0, len(page)
    deeper: dict[str, int] = {}  # open elements that are parts of the deepest one

    def close(k: int) -> None:
        nonlocal link
        del stack[k:]
        link = min(link, len(stack)) if link else 0

    while at < texts:
        m = TOKEN.search(page, at)
        until = m.start() if m else texts
        if until > at:
            stack[-1].add(html.unescape(page[at:until]), link > 0)
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                link = 0
            elif tag == "br":
                stack[-1].add(" ", False)
            elif deeper.get(tag):
                deeper[tag] -= 1
            else:
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0)
                if k:
                    close(k)
            continue
        if tag in RAW:
            at = END[tag].search(page, at).end()
            if tag != "title" and not stack[-1].out:
                stack[-1].items.append(Node(tag, tag + "!", True))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].add(" ", False)
            continue
        label, out = label_of(tag, m[3])
        if tag in INLINE and not out:
            link = len(stack) if tag == "a" else link
            continue
        if tag not in HEAD and stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag not in INLINE:
            if tag in CLOSES:
                these, within = CLOSES[tag]
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in within), 0)
                k = next((j for j in range(k + 1, len(stack)) if stack[j].tag in these), 0)
                if k:
                    close(k)
            k = len(stack) - 1
            while k and stack[k].tag in INLINE:
                k -= 1
            if stack[k].tag == "p":
                close(k)
        if len(stack) == DEEPEST:
            deeper[tag] = deeper.get(tag, 0) + 1
            continue
        node = Node(tag, label, out or stack[-1].out)
        if not stack[-1].out:
            stack[-1].items.append(node)
        stack.append(node)
    return root


def label_tag(label: str) -> str:
    return re.match("[a-z0-9]*", label)[0]


# --- expressions


def join_members(into: list, more: list) -> None:
    for label, optional, repeated, content in more:
        same = next((m for m in into if m[0] == label), None)
        if same:
            same[1:] = [same[1] or optional, same[2] or repeated, align(same[3], content)]
        else:
            into.append([label, optional, repeated, content])


def once(groups: Content) -> Content:
    """Groups whose labels stand once: from the first place of a label that comes back on, all is one repeated group of optional items; neighbours of one label fold."""
    out: Content = []
    for repeated, members in groups:
        labels = {m[0] for m in members}
        k = next((k for k, (_, ms) in enumerate(out) if any(m[0] in labels for m in ms)), None)
        if k is None:
            out.append([repeated, [list(m) for m in members]])
            continue
        met = [m for _, ms in out[k:] for m in ms]
        one = len(met) == len(members) == 1
        join_members(met, members)
        if one:
            met[0][2] = True
        out[k:] = [[not one, [[m[0], m[1] if one else True, m[2], m[3]] for m in met]]]
    return out


def align(a: Content, b: Content) -> Content:
    """The expression that both fit: a longest common sequence of groups is merged, the rest becomes optional."""
    if a == b:
        return a
    la, lb = [{m[0] for m in g[1]} for g in a], [{m[0] for m in g[1]} for g in b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if la[i] & lb[j] else max(best[i + 1][j], best[i][j + 1])
    free = lambda g: [g[0], [[x[0], True, x[2], x[3]] for x in g[1]]]
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and la[i] & lb[j]:
            members = [list(x) for x in a[i][1]]
            join_members(members, b[j][1])
            both = la[i] & lb[j]
            out.append([a[i][0] or b[j][0] or len(members) > 1, [[x[0], x[1] or x[0] not in both, x[2], x[3]] for x in members]])
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(free(a[i]))
            i += 1
        else:
            out.append(free(b[j]))
            j += 1
    return once(out)


def content_of(node: Node) -> Content:
    items = [(x.label, content_of(x)) if isinstance(x, Node) else ("#", []) for x in node.items if isinstance(x, Node) or x.strip()]
    return once([[False, [[label, False, False, content]]] for label, content in items])


def expression(content: Content) -> str:
    """The content as a regular expression over labels; # is a text slot."""

    def item(m: list) -> str:
        body = m[0] + (f" [{expression(m[3])}]" if m[3] else "")
        mark = ("*" if m[1] else "+") if m[2] else "?" if m[1] else ""
        return f"({body}){mark}" if mark and m[3] else body + mark

    return " ".join(f"({' '.join(map(item, ms))})+" if repeated else " ".join(map(item, ms)) for repeated, ms in content)


# --- slots and decisions

Slots = dict[str, tuple[int, int, int, int, int]]  # path -> pages, characters, linked, least and greatest hash of text


def slots_of(root: Node) -> Slots:
    texts: dict[str, list] = {}

    def walk(node: Node, path: str) -> None:
        for x in node.items:
            if isinstance(x, Node):
                if not x.out:
                    walk(x, f"{path}/{x.label}")
            elif x.strip():
                texts.setdefault(path, [[], 0])[0].append(" ".join(x.split()))
        if path in texts:
            texts[path][1] += node.linked

    walk(root, "")
    out = {}
    for path, (parts, linked) in texts.items():
        text = " ".join(parts)
        out[path] = (1, len(text), min(linked, len(text)), h := zlib.crc32(text.encode("utf-8", "surrogatepass")), h)
    return out


def add_slots(into: Slots, more: Slots) -> None:
    for path, (n, c, k, lo, hi) in more.items():
        o = into.get(path)
        into[path] = (n, c, k, lo, hi) if o is None else (o[0] + n, o[1] + c, o[2] + k, min(o[3], lo), max(o[4], hi))


def decide(content: Content, slots: Slots) -> tuple[str, list[str]]:
    """Path of the main part and the slots below it that are left out."""
    template = {p for p, (n, c, k, lo, hi) in slots.items() if n >= SAME and lo == hi or 2 * k > c}
    nodes: list[tuple[str, str, str]] = []  # path, label, path of the parent

    def walk(groups: Content, path: str) -> None:
        for _, members in groups:
            for label, _, _, inner in members:
                if label != "#" and "!" not in label:
                    nodes.append((f"{path}/{label}", label, path))
                    walk(inner, f"{path}/{label}")

    walk(content, "")
    text, varying = {"": 0}, {"": 0}
    for path, _, _ in nodes:
        text[path] = varying[path] = 0
    for path, s in slots.items():
        up = path
        while True:
            text[up] = text.get(up, 0) + s[1]
            varying[up] = varying.get(up, 0) + (0 if path in template else s[1])
            if not up:
                break
            up = up.rpartition("/")[0]
    for wanted in ("article", "main"):
        found = [p for p, label, _ in nodes if label_tag(label) == wanted]
        found = [p for p in found if not any(p.startswith(q + "/") for q in found)]
        if found:
            return max(found, key=lambda p: (text[p], -len(p), p)), []
    named = [p for p, label, _ in nodes if "*" in label and text[p] and label_tag(label) not in ("html", "body")]
    if named:
        main = max(named, key=lambda p: (text[p], -len(p), p))
        while deeper := [p for p in named if p.startswith(main + "/") and text[p] >= SHARE * text[main]]:
            main = min(deeper, key=lambda p: (len(p), p))
        return main, []
    main = ""
    while deeper := [p for p, _, parent in nodes if parent == main and varying[p] and varying[p] >= SHARE * varying[main]]:
        if label_tag(deeper[0].rpartition("/")[2]) in ("p", "ul", "ol", "dl", "table", "blockquote", "pre"):
            break
        main = deeper[0]
    return main, sorted(p for p in template if p == main or p.startswith(main + "/")) if varying[main] else []


def text_below(root: Node, main: str, dropped: set[str]) -> str:
    """The text of all elements at the path main, in page order."""
    parts: list[str] = []

    def walk(node: Node, path: str, inside: bool) -> None:
        inside = inside or path == main
        for x in node.items:
            if isinstance(x, Node):
                if not x.out:
                    walk(x, f"{path}/{x.label}", inside)
            elif inside and path not in dropped:
                parts.extend(x.split())

    walk(root, "", False)
    return " ".join(parts)


def main_text(page: str | None, plan: tuple[str, list[str]] | None) -> tuple[str, str]:
    """The page's main text and the path it stands at."""
    root = parse(page or "")
    if plan is not None and (text := text_below(root, plan[0], set(plan[1]))):
        return text, plan[0]
    own = decide(content_of(root), slots_of(root))
    return text_below(root, own[0], {*own[1], *(plan[1] if plan else [])}) or text_below(root, own[0], set()), own[0]


# --- jobs


def host_of(url) -> F.Column:
    return F.coalesce(split_url(url)[0], F.lit(""))


def outlines(pages: DataFrame) -> DataFrame:
    """host with expression (distinct in a task), or with path and its slot's figures."""
    kind = "host string, expression string, path string, pages long, chars long, linked long, lo long, hi long"
    schema = pa.schema([("host", pa.string()), ("expression", pa.string()), ("path", pa.string()), *[(c, pa.int64()) for c in ("pages", "chars", "linked", "lo", "hi")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        slots: dict[str, Slots] = {}
        held = 0

        def made() -> pa.RecordBatch:
            rows = [(h, e, None, None, None, None, None, None) for h, e in sorted(seen)] + [(h, None, p, *s) for h, ss in slots.items() for p, s in ss.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                root = parse(page.as_py() or "")
                seen.add((host, json.dumps(content_of(root), separators=(",", ":"))))
                own = slots_of(root)
                add_slots(slots.setdefault(host, {}), own)
                held += len(own) + 1
                if held > HELD:
                    yield made()
                    seen, slots, held = set(), {}, 0
        if seen:
            yield made()

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, kind)


def _aligned(expressions: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, expression: those of equal by are aligned in the order given; a task streams over them and holds one."""
    schema = pa.schema([*[(c, pa.string() if c == "host" else pa.int32()) for c in by], ("expression", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, content = None, None

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([*now, json.dumps(content, separators=(",", ":"))], schema, strict=True)], schema=schema)

        for b in batches:
            for row in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in [*by, "expression"]], strict=True):
                if row[:-1] != now:
                    if now is not None:
                        yield made()
                    now, content = row[:-1], json.loads(row[-1])
                else:
                    content = align(content, json.loads(row[-1]))
        if now is not None:
            yield made()

    dealt = expressions.repartition(*by).sortWithinPartitions(*by, order)
    return dealt.mapInArrow(run, ", ".join(f"{c} {'string' if c == 'host' else 'int'}" for c in [*by]) + ", expression string")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """pages(url, html) -> a written table of a row a host: host, expression (as nested lists in JSON), pattern (the same to read), main and dropped (see decide)."""
    found = materialize(outlines(pages), "outlines")
    distinct = found.filter("expression IS NOT NULL").select("host", "expression").distinct()
    bucketed = _aligned(distinct.withColumn("bucket", F.pmod(F.hash("expression"), F.lit(BUCKETS))), ["host", "bucket"], "expression")
    whole = _aligned(bucketed, ["host"], "bucket")
    sums = [F.sum(c).alias(c) for c in ("pages", "chars", "linked")]
    slots = found.filter("path IS NOT NULL").groupBy("host", "path").agg(*sums, F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    listed = slots.groupBy("host").agg(F.collect_list(F.struct("path", "pages", "chars", "linked", "lo", "hi")).alias("slots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                content = json.loads(r["expression"])
                main, dropped = decide(content, {s["path"]: (s["pages"], s["chars"], s["linked"], s["lo"], s["hi"]) for s in r["slots"] or []})
                out.append({"host": r["host"], "expression": r["expression"], "pattern": expression(content), "main": main, "dropped": dropped})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("host", pa.string()), ("expression", pa.string()), ("pattern", pa.string()), ("main", pa.string()), ("dropped", pa.list_(pa.string()))]))

    made = whole.join(listed, "host", "left").mapInArrow(run, "host string, expression string, pattern string, main string, dropped array<string>")
    wrappers = materialize(made, "wrappers")
    discard(found)
    return wrappers


def extract(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages(page_id, url, html) and wrappers(host, main, dropped) -> page_id, url, text, main."""
    plans = wrappers.select(F.col("host").alias("_host"), "main", "dropped")
    rows = pages.select("page_id", "url", "html").join(plans, host_of(F.col("url")) == F.col("_host"), "left").select("page_id", "url", "html", "main", "dropped")
    types = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, mains = [], []
            for page, main, dropped in zip(b.column(2), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                text, at = main_text(page.as_py(), None if main is None else (main, dropped or []))
                texts.append(text)
                mains.append(at)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(mains, pa.string())], names=["page_id", "url", "text", "main"])

    return rows.mapInArrow(run, f"page_id {types['page_id']}, url string, text string, main string")


def op12_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, infer_wrappers(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "main")
