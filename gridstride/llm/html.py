"""Main text of web pages by wrappers inferred from pages of the same host (operator 6).

A wrapper is a union-free regular expression over a page's token stream: elements
in order, each plain, optional or repeated, and text that is either constant or a
slot. Streams are aligned element by element, by label and by how many runs of that label came
before it among its siblings; where they mismatch, text becomes a slot, an element that one of
them lacks becomes optional, and runs of equal siblings become a repeated group. Aligning two expressions
adds counts and keeps what both say, so it does not matter in which order, or in which tasks, a
host's pages are aligned: within tasks first, then within a few groups of a host, then for the host.

A wrapper tells a host's pages apart into template and content. Every item of it
knows on how many pages it stands, how much text it holds, and how much of that is
in links. The content region is the deepest element that holds most of the text
that is no template. Template is what is constant over different pages of the host, what is
nearly all links on most of them, and what its tag, role, class or id hints at
unless it holds most of the host's text. A name that only contains a hinting word, beside others, counts
where the wrapper agrees: where links or constants are most of the element. Every page is then matched with its host's
wrapper, and the region's remaining blocks are its main text. A page that the
wrapper does not match is taken as the only one of its host.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import durable

#: Elements without an end tag, without text of interest, whose text has no markup, inside lines of text, and that end an open sibling.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas", "annotation", "annotation-xml"}
PLAIN = {"script", "style", "textarea", "title", "iframe"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
INLINE |= {"math", "menclose", "mfenced", "mfrac", "mi", "mn", "mo", "mover", "mpadded", "mphantom", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "semantics"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "dl", "table", "body", "html", "article", "section", "main", "div", "nav", "aside", "footer", "header", "form"}
#: Elements, roles and words of class or id that hint at what is no article text.
SKIP_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head"}
SKIP_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}
SKIP_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "copyright", "discussion", "disqus", "footer", "login",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
}
OUTER_WORDS = {"banner", "header", "masthead", "topbar"}
#: Words that say nothing of an element's content; beside others than these a hinting word is no sure hint.
PART_WORDS = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "container", "content", "desktop", "form", "global", "grid", "group", "holder", "icon", "icons", "inner", "item", "items",
    "left", "link", "links", "list", "main", "mobile", "module", "outer", "overlay", "page", "panel", "post", "posts", "primary", "reader", "right", "row", "section", "secondary", "site", "slot", "top", "unit", "user", "users", "wrap", "wrapper",
}
#: Elements that are blocks of text, not parts of a page.
BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "ul", "ol", "dl", "li", "table", "tbody", "tr", "td", "figure", "figcaption"}
#: A name of more words than these is a sentence, not a hint.
NAME_WORDS = 3
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s>/]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>|[^<]+|<""", re.S)
#: For pages of which a tag does not end as quotes would have it.
PLAIN_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|</?([a-zA-Z][^\s>/]*)([^>]*)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([\w:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORD = re.compile(r"[A-Za-z]+")
#: Elements nested deeper than this are read as children of the last one that is not.
DEPTH = 120
#: A constant is template if so many different pages or more have it; longer than so many characters, it is kept in wrappers as its hash.
SEEN, CONSTANT = 3, 200
#: Shares: of a host's text from which on a hint does not count, of links in a menu, of links or constants in what is hinted at in part, of the text that a deeper region keeps, and that a further article has of the largest.
DOMINANT, LINKED, AGREED, REGION, FURTHER = 0.8, 0.9, 0.5, 0.6, 0.2
#: Runs of one label among siblings that are told apart; later ones are a repeated group with the last.
RANKS = 8
#: Items that a task holds before it passes its wrappers on.
HELD = 300_000
GROUPS = 16
#: All rules together are broadcast up to this size.
BROADCAST_BYTES = 4 << 20


class Element:
    """An element with its children, elements and texts (and whether these are in a link), in order. Without a label it only parts lines."""

    __slots__ = ("tag", "label", "children")

    def __init__(self, tag: str, label: str):
        self.tag, self.label, self.children = tag, label, []


def hinted(tag: str, role: str, names: str, inner: bool, whole: bool) -> str:
    """``!`` if an element's tag, role or a name hints at template, ``~`` if a name does in part, else nothing. ``inner``: within an article; ``whole``: it holds the page or its article, so its names do not count."""
    if tag in SKIP_TAGS or role in SKIP_ROLES or tag == "header" and not inner:
        return "!"
    found = ""
    for name in () if whole else names.split():
        words = [w.lower() for w in WORD.findall(name)]
        hints = [w in SKIP_WORDS or w in OUTER_WORDS and not inner for w in words]
        if any(hints) and len(words) <= NAME_WORDS:
            if all(h or w in PART_WORDS for h, w in zip(hints, words, strict=True)):
                return "!"
            found = "~"
    return found


def _element(tag: str, attributes: str, inner: bool, whole: bool) -> Element:
    """Labelled by tag, classes (numbers in them alike) and role, and by its hint."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    role = found.get("role", "").lower()
    label = ".".join([tag, *re.sub(r"\d+", "0", found.get("class", "")).split()]) if tag not in ("html", "body") else tag
    return Element(tag, label + f"[{role}]" * bool(role) + hinted(tag, role, f"{found.get('class', '')} {found.get('id', '')}", inner, whole))


def parse(page: str | None) -> Element:
    """A page's tree. Inline markup is text; unclosed and stray tags are borne with. The time is that of the page's length.

    A tag without an end makes all later ones end at the next ``>``; after the last ``>`` all is text.
    """
    root = Element("", "")
    stack, at, page = [root], 0, page or ""
    article = link = 0
    last, token, endless = page.rfind(">"), TOKEN, set()

    def close(depth: int) -> None:
        nonlocal article
        article -= sum(e.tag in ("article", "main") for e in stack[depth:])
        if len(stack) > DEPTH:
            stack[-1].children.append(Element("", ""))
        del stack[depth:]

    while at < len(page):
        if at > last and not page.startswith(("<!--", "<![CDATA["), at):
            stack[-1].children.append((unescape(page[at:]), link > 0))
            break
        m = token.match(page, at)
        if m[0] == "<" and token is TOKEN and re.match(r"/?[a-zA-Z]", page[at + 1 : at + 3]):
            token = PLAIN_TOKEN
            continue
        at = m.end()
        whole, tag = m[0], (m[1] or "").lower()
        if not tag:
            if not whole.startswith(("<!", "<?")):
                stack[-1].children.append((unescape(whole), link > 0))
            continue
        if whole[1] == "/":
            link -= tag == "a" and link > 0
            if tag not in INLINE:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
            continue
        if tag in RAW:
            end = None if m[2].endswith("/") or tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            if end is None and not m[2].endswith("/"):
                endless.add(tag)
            at = end.end() if end else len(page) if tag in PLAIN and not m[2].endswith("/") else at
            continue
        if tag in INLINE:
            link = 1 if tag == "a" else link  # links do not nest
            if tag == "br":
                stack[-1].children.append((" ", False))
            continue
        whole_page = tag in ("html", "body", "main") or tag == "article" and not any(e.tag == "article" for e in stack)
        new = _element(tag, m[2], article > 0, whole_page)
        closes = ENDS.get(tag, {"p"})
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in closes:
                close(depth)
                break
            if stack[depth].tag in SCOPE:
                break
        if len(stack) >= DEPTH:
            stack[-1].children.append(Element("", ""))
            new.children = stack[-1].children
        else:
            stack[-1].children.append(new)
        link = 0
        if tag not in VOID and not m[2].endswith("/"):
            stack.append(new)
            article += tag in ("article", "main")
    return root


def _texts(element: Element) -> Iterator[Element | tuple[str, int]]:
    """Child elements, and runs of text, their white space made one space, with how many of their characters are in links; empty ones left out."""
    run: list[tuple[str, bool]] = []
    for child in [*element.children, None]:
        if isinstance(child, tuple):
            run.append(child)
            continue
        if run and (text := " ".join("".join(t for t, _ in run).split())):
            yield text, min(len(text), sum(len(t.strip()) for t, linked in run if linked))
        run = []
        if child is not None and child.label:
            yield child


# An expression maps a label and a rank to an item [pages, repeated, characters, linked, content]. The content of an
# element is an expression; that of text, whose label is "#", is [constant or None for a slot, hashes of pages].
def _key(label: str, rank: int) -> str:
    return f"{label}\t{rank}"


def align(a: dict, b: dict, same_page: bool = False, side_by_side: bool = False) -> dict:
    """The expression that covers both, of different pages or (``same_page``) of parts of one; the items of ``side_by_side`` ones are siblings. It is the same whichever comes first; ``a`` is changed."""
    for key, other in b.items():
        item = a.get(key)
        if item is None:
            a[key] = other
            continue
        if key[0] == "#":
            constant = item[4][0] if item[4][0] == other[4][0] else None
            content = [constant, sorted({*item[4][1], *other[4][1]})[:SEEN] if constant is not None else []]
        else:
            content = align(item[4], other[4], same_page)
        pages = max(item[0], other[0]) if same_page else item[0] + other[0]
        a[key] = [pages, item[1] or other[1] or side_by_side, item[2] + other[2], item[3] + other[3], content]
    return a


def _constant(text: str) -> str:
    """What stands for a text in wrappers: itself, or the hash of a long one."""
    return text if len(text) <= CONSTANT else f"\0{xxhash.xxh3_128_hexdigest(text.encode())}"


def expression(element: Element, page: int = 0) -> dict:
    """A page's own expression: every text constant, repeated siblings one group. ``page`` tells different pages apart."""
    out: dict[str, list] = {}
    runs: dict[str, int] = {}
    before = None
    for child in _texts(element):
        if isinstance(child, tuple):
            label, item = "#", [1, False, len(child[0]), child[1], [_constant(child[0]), [page]]]
        else:
            content = expression(child, page)
            label, item = child.label, [1, False, sum(x[2] for x in content.values()), sum(x[3] for x in content.values()), content]
        if label != before:
            runs[label] = runs.get(label, -1) + 1
        before = label
        align(out, {_key(label, min(runs[label], RANKS - 1)): item}, True, True)
    return out


def regular(wrapper: dict, pages: int | None = None) -> str:
    """The expression as text: labels with ?, + or *, text in quotes, slots as dots."""
    pages = max((x[0] for x in wrapper.values()), default=0) if pages is None else pages
    out = []
    for key, (seen, repeated, _, _, content) in sorted(wrapper.items()):
        label = key.split("\t")[0]
        inner = ("..." if content[0] is None else repr(content[0])) if label == "#" else f"{label}({regular(content, seen)})"
        out.append(inner + ("*" if repeated and seen < pages else "+" if repeated else "?" if seen < pages else ""))
    return " ".join(out)


def _template(item: list) -> bool:
    return item[4][0] is not None and len(item[4][1]) >= SEEN


def _fixed(content: dict) -> int:
    """Characters of constants that are template."""
    return sum((x[2] if _template(x) else 0) if key[0] == "#" else _fixed(x[4]) for key, x in content.items())


def _children(contents: list[dict]) -> tuple[list[list], dict[str, list[list]]]:
    """The texts of elements of one path, and their child elements by label, in order of labels."""
    texts, inner = [], {}
    for content in contents:
        for key, item in content.items():
            if key[0] == "#":
                texts.append(item)
            else:
                inner.setdefault(key.split("\t")[0], []).append(item)
    return texts, dict(sorted(inner.items()))


def rules(wrapper: dict) -> dict:
    """What a host's wrapper says: the paths of its content region, and paths and constant texts that are template."""
    whole, pages = sum(x[2] for x in wrapper.values()), max((x[0] for x in wrapper.values()), default=0)
    drop: list[tuple] = []
    sizes: dict[tuple, int] = {}

    def measure(contents: list[dict], path: tuple) -> int:
        """Characters that are no template; paths of template elements go to ``drop``."""
        texts, inner = _children(contents)
        total = sum(0 if _template(x) else x[2] for x in texts)
        for label, items in inner.items():
            here, seen = (*path, label), max(x[0] for x in items)
            chars, linked, fixed = (sum(f(x) for x in items) for f in (lambda x: x[2], lambda x: x[3], lambda x: _fixed(x[4])))
            hint = label.endswith("!") or label.endswith("~") and seen >= SEEN and max(linked, fixed) >= AGREED * chars
            menu = seen >= max(SEEN, 0.5 * pages) and chars > 0 and linked >= LINKED * chars
            if (hint or menu) and chars < DOMINANT * whole:
                drop.append(here)
            else:
                sizes[here] = measure([x[4] for x in items], here)
                total += sizes[here]
        return total

    everything = measure([wrapper], ())
    contents, path, further = [wrapper], (), []
    tag = lambda label: re.split(r"[.\[!~]", label)[0]
    while everything and not (path and tag(path[-1]) in ("article", "main")):
        # the deepest element that still holds most of the text; text and paragraphs beside it are of the same text
        texts, inner = _children(contents)
        size = {label: sizes.get((*path, label), 0) for label in inner}
        beside = bool(texts) or any(tag(x) in BLOCKS and size[x] for x in inner)
        articles = sorted((x for x in inner if tag(x) == "article" and size[x]), key=lambda x: (-size[x], x))
        if sum(size[x] for x in articles) >= REGION * everything:
            further = [(*path, x) for x in articles if size[x] >= FURTHER * size[articles[0]]]
            break
        deeper = sorted((x for x in inner if size[x] >= REGION * everything and tag(x) not in BLOCKS), key=lambda x: (-size[x], x))
        deeper = [x for x in deeper if tag(x) == "main"] or ([] if beside else deeper)
        if not deeper:
            break
        contents, path = [x[4] for x in inner[deeper[0]]], (*path, deeper[0])
    constants: set[str] = set()

    def gather(contents: list[dict], path: tuple) -> None:
        texts, inner = _children(contents)
        constants.update(x[4][0] for x in texts if _template(x) and not x[1])
        for label, items in inner.items():
            if (*path, label) in sizes and (len(path) >= depth or any(p[: len(path) + 1] == (*path, label) for p in regions)):
                gather([x[4] for x in items], (*path, label))

    regions = further or [path]
    depth = len(regions[0])
    gather([wrapper], ())
    return {"paths": [list(p) for p in regions], "drop": [list(d) for d in drop], "constants": sorted(constants), "known": [list(p) for p in sizes if p[-1].endswith("!")]}


def main_text(page: str | None, rule: dict | None) -> str:
    """The blocks of a page's content region, joined by line feeds."""
    root = parse(page)

    def find(element: Element, paths: list[list]) -> list[tuple[Element, tuple]]:
        """The elements at the paths, in page order; each path is one tail of labels and the whole."""
        here = [whole for tail, whole in paths if not tail]
        if here:
            return [(element, tuple(here[0]))]
        found = []
        for child in element.children:
            if isinstance(child, Element):
                on = [(tail[1:], whole) for tail, whole in paths if tail[0] == child.label]
                found += find(child, on) if on else []
        return found

    regions = find(root, [(p, p) for p in rule["paths"]]) if rule and rule["paths"] != [[]] else []
    if not regions:  # a page unlike its host's others, or the host has no region deeper than the page
        rule = rules(expression(root)) if not rule or rule["paths"] != [[]] else rule
        regions = find(root, [(p, p) for p in rule["paths"]])
    constants, drop, known = set(rule["constants"]), {tuple(d) for d in rule["drop"]}, {tuple(k) for k in rule["known"]}
    out: list[str] = []

    def blocks(element: Element, path: tuple) -> None:
        for child in _texts(element):
            if isinstance(child, tuple):
                if not constants or _constant(child[0]) not in constants:
                    out.append(child[0])
                continue
            here = (*path, child.label)
            if here not in drop and (not child.label.endswith("!") or here in known):
                blocks(child, here)

    for region, path in regions:
        blocks(region, path)
    return "\n".join(out)


def host_of(url_col: str) -> F.Column:
    return F.coalesce(F.regexp_extract(F.lower(url_col), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, rule) from (host, html): each host's expression, aligned over all its pages."""

    def packed(held: dict[str, dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(v) for v in held.values()], pa.string())], names=["host", "wrapper"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        size = 0
        for batch in batches:
            for host, page in zip(batch.column(0), batch.column(1), strict=True):
                text = page.as_py()
                own = expression(parse(text), xxhash.xxh3_64_intdigest(text.encode()) >> 1)
                held[host.as_py()] = align(held.get(host.as_py(), {}), own)
                size += len(text) // 100 + 1
                if size > HELD:  # about as many items
                    yield packed(held)
                    held, size = {}, 0
        yield packed(held)

    def together(group: pa.Table) -> pa.Table:
        merged: dict = {}
        for other in group.column("wrapper"):
            align(merged, json.loads(other.as_py()))
        return pa.table({"host": group.column("host")[:1], "wrapper": pa.array([json.dumps(merged)], pa.string())})

    def settle(group: pa.Table) -> pa.Table:
        merged = together(group)
        return pa.table({"host": merged.column("host"), "rule": pa.array([json.dumps(rules(json.loads(merged.column("wrapper")[0].as_py())))], pa.string())})

    parts = pages.mapInArrow(within, "host string, wrapper string").withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(GROUPS)))
    some = parts.groupBy("host", "salt").applyInArrow(together, "host string, wrapper string")
    return some.groupBy("host").applyInArrow(settle, "host string, rule string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row.

    Null html is empty and gives an empty text. Pages with a null url, or one
    without a host, share a wrapper. Repeated rows give repeated results; other
    columns are not read; an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host_of(url_col).alias("host"))
    known = wrappers(rows.select("host", "html"))

    @F.pandas_udf("string")
    def text(html, rule):  # noqa: ANN001, ANN202
        import pandas as pd

        parsed: dict[str, dict] = {}
        out = []
        for page, r in zip(html, rule, strict=True):
            if r is not None and r not in parsed:
                parsed[r] = json.loads(r)
            out.append(main_text(page, parsed.get(r)))
        return pd.Series(out, dtype=object)

    # the rules' size is checked: small ones go to the pages, else the pages are dealt by host
    known = durable(known)
    size = known.agg(F.sum(F.octet_length("host") + F.octet_length("rule"))).first()[0] or 0
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known
    done = rows.join(known, "host", "left").select("id", "url", text("html", "rule").alias("text"))
    return done.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
