"""Main text of web pages, with site templates removed.

Each page is read into a tree once. Subtrees are hashed over their tags, attributes and text; Spark counts on how many
pages of a host each hash occurs, and subtrees that recur on many pages of their host are deleted. Pages are told apart by
the blocks that aren't frequent on their host; those with next to none are copies and count as one, so that what copies
share isn't taken for a template.

What is marked as furniture by tag, role or the words of its class names (menus, headers, footers, sidebars, notices, adverts
and the like) is known by its marks alone, since its text may change from page to page: the marks are hashed and counted as
well, and what carries them goes if another page of the host has them too. A marked subtree that is the only one of its host
stays. Only on hosts of fewer than MIN_PAGES pages, where nothing can be told by counting, marks alone decide. What is no text
(scripts, styles, forms, hidden elements) and reader comments go anywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

#: A subtree is a template when this many pages of its host hold it, and this power of their number: 32 of 1,000, 1,000 of a million.
MIN_PAGES = 10
GROWTH = 0.5
#: Marks are furniture when this many pages of a host have them.
MARKED_PAGES = 2
#: Words from which a block is known by least hashes, and characters of its own from which a page is an article.
LONG_BLOCK = 20
MIN_OWN = 20
#: Into how many parts the pages of a host are dealt for the join with its frequent blocks.
SALTS = 32
#: The share of a page's text that an article has to hold to stand for it, and what other articles may hold beside it.
MOST = 0.5
OTHERS = 0.1
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: A token of a tag, tried from its first character only, so that long ones aren't tried again from each of theirs.
_ATTR = re.compile(r"(?<![^\s\"'>/=])([^\s=\"'>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_LONG_NUMBER = re.compile(r"&#\d{8,};?")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_GONE = {
    "script", "style", "noscript", "template", "iframe", "object", "embed", "svg", "canvas", "audio", "video", "map", "head", "title", "form", "button",
    "select", "option", "textarea", "input", "label", "fieldset", "dialog", "menu", "noembed", "noframes", "xmp",
}
_MARKS = {"nav", "header", "footer", "aside"}
_BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr",
    "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "header", "footer",
    "aside", "nav", "form", "fieldset", "hgroup", "search", "dir", "menu",
}
#: What a start tag closes, when the nearest open element of a kind is still open.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
_BARS = _BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
_P_ENDS = _BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_SCOPE = {"table", "td", "th", "caption", "button", "html", "body", "article", "section", "main", "div", "li", "aside", "nav", "header", "footer", "form", "blockquote"}
_ALWAYS = re.compile(
    r"(?:^|[\s_-])(?:comments?|commentlist|comment-?list|disqus|replies|reply|respond|discussion)(?=$|[\s_-])", re.I
)
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|promo\w*|sponsor\w*|banner|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|toolbar|pagination|pager|skip|search|tags?)(?=$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:masthead|header)(?=$|[\s\"'_-])", re.I)
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar", "note", "status"}
_KEPT = {"html", "body", "article", "main"}
_NEVER = {"#root", *_KEPT}

#: What becomes of an element: it is text, goes anywhere, or goes where its marks recur.
TEXT, GONE, MARKED = 0, 1, 2

Node = list  # [tag, what becomes of it, attributes, children: Node or str, key, key of its marks]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _unescape(text: str) -> str:
    """Character references decoded; numbers of eight digits or more are no character."""
    return unescape(_LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def _attrs(raw: str) -> dict[str, str]:
    return {m[0].lower(): _unescape(m[1] or m[2] or m[3]) for m in _ATTR.findall(raw)}


def _furniture(tag: str, raw: str) -> int:
    if tag in _GONE:
        return GONE
    mark = MARKED if tag in _MARKS else TEXT
    if not raw or tag in ("html", "body"):
        return mark
    a = _attrs(raw)
    low = raw.lower()
    if "hidden" in low and (re.search(r"(?:^|\s)hidden(?:[\s=/]|$)", low) and tag not in _KEPT) or "none" in low and re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return GONE
    if a.get("aria-hidden", "").lower() == "true":
        return GONE
    names = (a.get("class", ""), a.get("id", ""))
    if tag not in _KEPT and any(map(_ALWAYS.search, names)):
        return GONE
    if a.get("role", "").lower() in _ROLES or tag not in _KEPT and any(map(_MARKED.search, names)):
        return MARKED
    return mark


def _heading(tag: str, raw: str) -> bool:
    """Furniture only for being a header: inside an article that is its own heading."""
    if tag == "header":
        return not (raw and _furniture("div", _HEADER.sub("", raw)))
    return bool(_HEADER.search(raw)) and tag not in _GONE and not _furniture(tag, _HEADER.sub("", raw))


def _marks_of(tag: str, raw: str) -> int:
    """The key of an element's marks: its tag, role and the words that mark it in its class names and id, whatever else is in these."""
    import xxhash

    a = _attrs(raw)
    words = sorted({m.strip(" \t\n\r\f_-").lower() for k in ("class", "id") for m in _MARKED.findall(a.get(k, ""))})
    return _signed(xxhash.xxh64_intdigest("\x01".join([tag, a.get("role", "").lower(), *words]).encode("utf-8", "surrogatepass"), 1))


class _Open:
    """The open elements, and where in their stack each tag is: nothing below walks through them."""

    def __init__(self, root: Node):
        self.stack, self.at, self.scopes, self.bars = [root], {}, [], []

    def top(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def push(self, node: Node) -> None:
        tag, k = node[0], len(self.stack)
        self.stack.append(node)
        self.at.setdefault(tag, []).append(k)
        if tag in _SCOPE:
            self.scopes.append(k)
        if tag in _BARS:
            self.bars.append(k)

    def cut(self, k: int) -> None:
        while len(self.stack) > k:
            self.at[self.stack.pop()[0]].pop()
        for places in (self.scopes, self.bars):
            while places and places[-1] >= k:
                places.pop()


def parse(html: str) -> Node:
    """The page as a tree; end tags may be missing or crossed. Takes time in proportion to the page, whatever is in it."""
    root: Node = ["#root", TEXT, "", [], 0, 0]
    o, at, text, end = _Open(root), 0, 0, len(html)
    last = {c: html.rfind(c) for c in ">\"'"}
    quotes = True

    def close_of(at: int) -> int:
        """The place of the sign that ends a tag: not within quotes, unless that leaves none."""
        nonlocal quotes
        k = at
        while quotes:
            m = _STOP.search(html, k)
            if m is None:
                quotes = False  # from here on every quoted one is the last: read on to the end once only
                break
            k = m.end()
            if m[0] == ">":
                return m.start()
            if k <= last[m[0]]:
                k = html.index(m[0], k) + 1
        return html.find(">", at)

    def say(a: int, b: int) -> None:
        if b > a:
            o.stack[-1][3].append(html[a:b])

    while True:
        lt = html.find("<", at)
        if lt < 0 or lt + 1 >= end:
            break
        c = html[lt + 1]
        if c in "!?":
            say(text, lt)
            if html.startswith("<!--", lt):
                k = html.find("-->", lt + 4)
                at = k + 3 if k >= 0 else end
            elif html.startswith("<![CDATA[", lt):
                k = html.find("]]>", lt + 9)
                say(lt + 9, k if k >= 0 else end)
                at = k + 3 if k >= 0 else end
            else:
                k = html.find(">", lt) if lt < last[">"] else -1
                at = k + 1 if k >= 0 else end
            text = at
            continue
        closing = c == "/"
        m = _NAME.match(html, lt + 1 + closing)
        if m is None or m.end() > last[">"]:
            at = lt + 1
            continue
        k = close_of(m.end())
        say(text, lt)
        raw = html[m.end() : k]
        at = text = k + 1
        tag = m[0].lower()
        if closing:
            if (k := o.top((tag,))) and (tag in _BLOCK or not o.bars or o.bars[-1] < k):
                o.cut(k)
            continue
        if tag in _P_ENDS and (k := o.top("p")) and (not o.scopes or o.scopes[-1] < k):
            o.cut(k)
        if tag in _CLOSES:
            shut, scope = _CLOSES[tag]
            while (k := o.top(shut)) > o.top(scope):
                o.cut(k)
                if tag not in ("tr", "tbody"):
                    break
        gone = _furniture(tag, raw)
        if gone and o.top(("article", "main")) and _heading(tag, raw):
            gone = TEXT
        node: Node = [tag, gone, raw.strip(), [], 0, _marks_of(tag, raw) if gone == MARKED else 0]
        o.stack[-1][3].append(node)
        if tag in _RAW and not raw.endswith("/"):
            close = re.compile(rf"</{tag}\s*+>", re.I).search(html, at)
            at = text = close.end() if close else end
        elif tag not in _VOID and not raw.rstrip().endswith("/"):
            o.push(node)
    say(text, end)
    return root


def _clean(text: str) -> str:
    return " ".join(_unescape(text).split())


def subtrees(root: Node) -> list[tuple[int, Node, bool]]:
    """(hash, node, whether it is or lies in a marked one) of each element with text that doesn't go anywhere; the hash covers tags, attributes and text."""
    import xxhash

    out, order, stack = [], [], [(root, False)]
    while stack:
        node, within = stack.pop()
        order.append((node, within))
        stack.extend((c, within or c[1] == MARKED) for c in node[3] if not isinstance(c, str) and c[1] != GONE)
    for node, within in reversed(order):
        parts = [node[0], node[2]]
        for c in node[3]:
            if isinstance(c, str):
                if t := _clean(c):
                    parts.append(t)
            elif c[4] and c[1] != GONE:
                parts.append(str(c[4]))
        if len(parts) > 2:
            node[4] = _signed(xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")))
            if node[0] not in _NEVER:
                out.append((node[4], node, within))
    return out


def marked(root: Node) -> set[int]:
    """The keys of the marks on the page."""
    out, stack = set(), [root]
    while stack:
        for c in stack.pop()[3]:
            if not isinstance(c, str) and c[1] != GONE:
                out.add(c[5])
                stack.append(c)
    return out - {0}


def _goes(node: Node, templates: frozenset[int] | set[int] | None) -> bool:
    """Whether an element is deleted: by its marks alone where there are no templates, else if its hash or that of its marks is one."""
    if node[1] == TEXT:
        return bool(templates and node[4] and node[4] in templates)
    return node[1] == GONE or templates is None or node[5] in templates or node[4] in templates


def _content(root: Node, templates: frozenset[int] | set[int] | None = None) -> Node:
    """The article or main element with the most text, if it holds half of the page's and other such elements little; else the whole."""

    def size(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            n = stack.pop()
            for c in n[3]:
                if isinstance(c, str):
                    total += len(c.strip())
                elif not _goes(c, templates):
                    stack.append(c)
        return total

    found, stack = [], [root]
    while stack:
        node = stack.pop()
        for c in node[3]:
            if not isinstance(c, str) and not _goes(c, templates):
                if c[0] in ("article", "main") or "main" in c[2] and re.search(r"role\s*=\s*[\"']?main", c[2]):
                    found.append(c)
                else:
                    stack.append(c)
    sized = [(size(c), c) for c in found]
    best = max(sized, key=lambda x: x[0], default=(0, root))
    if not best[0] or best[0] < MOST * size(root) or sum(s for s, _ in sized) - best[0] > OTHERS * best[0]:
        return root  # a page around a teaser, or a list of articles
    return best[1]


def blocks(root: Node, templates: frozenset[int] | set[int] | None = None) -> list[str]:
    """The texts of the blocks in page order, without subtrees whose hash or marks are among ``templates``; without these, without all that is marked."""
    out, run = [], []

    def flush() -> None:
        if run:
            if t := _clean("".join(run)):
                out.append(t)
            run.clear()

    start = _content(root, templates)
    stack: list = [(start, False)]
    while stack:
        item, closing = stack.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if closing:
            flush()
            continue
        if item is not start and _goes(item, templates):
            if item[0] in _BLOCK:
                flush()
            continue
        if item[0] == "br":
            run.append(" ")
            continue
        block = item[0] in _BLOCK
        if block:
            flush()
            stack.append((item, True))
        stack.extend((c, False) for c in reversed(item[3]))
    flush()
    return out


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without port; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


_POWERS = np.cumprod(np.full(4096, _MIX[0], np.uint64))


def _word_hashes(words: list[str]) -> np.ndarray:
    """A hash of each word: a polynomial of its bytes, all words at once."""
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    start = np.r_[0, np.flatnonzero(raw == 32)[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(start, np.diff(np.r_[start, len(raw)]))
    h = np.add.reduceat((raw + np.uint64(1)) * _POWERS[place & 4095], start)
    return (h ^ (h >> np.uint64(29))) * np.uint64(_MIX[2])


def block_marks(texts: list[str]) -> list[list[int]]:
    """What each block is known by: a hash of its text, for a long one three least hashes of its runs of three words, so that edits of a few words leave one."""
    import xxhash

    out: list[list[int]] = [[]] * len(texts)
    long, words, sizes = [], [], []
    for i, text in enumerate(texts):
        w = text.lower().split()
        if len(w) < LONG_BLOCK:
            out[i] = [_signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))]
        else:
            long.append(i)
            words += w
            sizes.append(len(w))
    if long:
        w = _word_hashes(words)
        h = (w[:-2] * np.uint64(_MIX[0]) + w[1:-1]) * np.uint64(_MIX[1]) + w[2:]
        end = np.cumsum(sizes)
        cuts = np.stack([end - sizes, end - 2], axis=1).ravel()[:-1]  # the runs of each block, and those that go on into the next
        least = [np.minimum.reduceat(h * np.uint64(m) + np.uint64(m >> 7), cuts)[::2].view(np.int64).tolist() for m in _MIX]
        for i, *found in zip(long, *least, strict=True):
            out[i] = sorted(set(found))
    return out


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    kind, names = pa.list_(pa.struct([("m", pa.list_(pa.int64())), ("n", pa.int64())])), ["host", "page", "keys", "within", "marks", "blocks"]
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part, page, keys, within, seen, found = b.slice(at, 256), [], [], [], [], []
            for html in part.column(1).to_pylist():
                root = parse(html or "")
                texts = blocks(root)
                trees = subtrees(root)
                keys.append(sorted({h for h, _, inside in trees if not inside}))
                within.append(sorted({h for h, _, inside in trees if inside}.difference(keys[-1])))
                seen.append(sorted(marked(root)))
                page.append(_signed(xxhash.xxh64_intdigest("\x00".join([*texts, *map(str, keys[-1]), *map(str, within[-1])]).encode("utf-8", "surrogatepass"))))
                once = list(dict.fromkeys(texts))
                found.append([{"m": m, "n": len(t)} for m, t in zip(block_marks(once), once, strict=True)])
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(page, pa.int64()), pa.array(keys, longs), pa.array(within, longs), pa.array(seen, longs), pa.array(found, kind)], names)


def articles(found: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, article, keys, within, marks): pages that differ, with the hash of the blocks that aren't frequent on their host.

    Pages with fewer than MIN_OWN characters of such blocks are copies of others, or empty, and share the article 0.
    """
    often = found.select("host", F.explode(F.array_distinct(F.flatten("blocks.m"))).alias("m")).groupBy("host", "m").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    often = scratch.put(often.groupBy("host").agg(F.collect_list("m").alias("often")), "often").withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = F.filter("blocks", lambda b: ~F.coalesce(F.arrays_overlap(b["m"], F.col("often")), F.lit(False)))
    got = found.withColumn("z", F.pmod("page", F.lit(SALTS)).cast("int")).join(often, ["host", "z"], "left").select("host", "keys", "within", "marks", own.alias("own"))
    size = F.aggregate("own", F.lit(0).cast("long"), lambda total, b: total + b["n"])
    return got.select("host", F.when(size >= MIN_OWN, F.xxhash64(F.array_sort(F.flatten("own.m")))).otherwise(F.lit(0)).alias("article"), "keys", "within", "marks")


def templates(pages: DataFrame, scratch: Scratch, min_pages: int = MIN_PAGES, growth: float = GROWTH, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, keys, plain): for each host of ``min_pages`` pages or more the hashes of subtrees that occur on ``min_pages`` of them and the
    ``growth`` power of their number, and the marks that occur on MARKED_PAGES; ``plain`` if some of these subtrees aren't within marked ones.

    Pages are told apart by their articles. The bound grows slowly, so that what recurs in one section of a large host is found.
    A host has at most its elements a page times the root of its pages, and the marks that its pages share.
    """
    found = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html")).mapInArrow(_hashes, "host string, page long, keys array<long>, within array<long>, marks array<long>, blocks array<struct<m: array<long>, n: long>>")
    found = scratch.put(found.dropDuplicates(["host", "page"]), "subtrees")
    found = scratch.put(articles(found, scratch, min_pages), "articles")
    n = found.select("host", "article").distinct().groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    counts = recurrences(found, min_pages)
    often = n.join(counts, "host", "left").where(F.col("marked") | F.col("key").isNull() | (F.col("n") >= F.pow("pages", F.lit(growth))))
    plain = F.coalesce(F.max(F.col("plain")), F.lit(False))
    return scratch.put(often.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("keys"), plain.alias("plain")), "templates")


def recurrences(found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, key, marked, plain, n): the articles of each host that hold a subtree's hash or a mark, if there are ``min_pages`` or MARKED_PAGES of them.

    ``plain`` tells whether a subtree is anywhere outside of marked ones.
    """

    def tagged(column: str, marked: bool, plain: bool) -> Column:
        return F.transform(column, lambda k: F.struct(k.alias("key"), F.lit(marked).alias("marked"), F.lit(plain).alias("plain")))

    each = F.explode(F.concat(tagged("keys", False, True), tagged("within", False, False), tagged("marks", True, False)))
    flat = found.select("host", "article", each.alias("e")).select("host", "article", "e.*").groupBy("host", "article", "key", "marked").agg(F.max("plain").alias("plain"))
    return flat.groupBy("host", "key", "marked").agg(F.max("plain").alias("plain"), F.count("*").alias("n")).where(F.col("n") >= F.when(F.col("marked"), MARKED_PAGES).otherwise(min_pages))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part, out = b.slice(at, 256), []
            for html, keys, plain in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                root = parse(html or "")
                drop = None if keys is None else frozenset(keys)
                if drop and (plain or not drop.issuperset(marked(root))):  # else what is marked goes whole, and nothing else does
                    subtrees(root)
                out.append("\n\n".join(blocks(root, drop)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, growth: float = GROWTH, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A null or empty page has an empty text. A null URL, or one without host, counts as the host of the empty name.
    Repeated rows count as one page, and each gets its row. Other columns are not looked at. An empty table gives no
    rows. Broken markup is read as far as it goes; unclosed quotes, comments and raw elements end with the page.
    """
    scratch = Scratch(pages.sparkSession, "html")
    often = templates(pages, scratch, min_pages, growth, url_col, html_col)
    keyed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    schema = keyed.select("page_id", "url").schema.add("text", "string")
    got = keyed.join(often, "host", "left").select("page_id", "url", "html", "keys", "plain").mapInArrow(_texts, schema)
    return got.withColumn("n_chars", F.char_length("text").cast("long"))
