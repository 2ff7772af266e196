"""Main text of web pages, after removal of what a site repeats on its pages.

Every page is parsed to elements once in a task; structural elements are hashed with all
they contain. Spark counts each subtree's pages per host, and subtrees on ``MIN_PAGES``
pages or more of a host, however many pages it has, are deleted from its pages.
A page with the same html counts once. Elements that hold the article are never deleted,
nor are paragraphs inside it. What remains loses elements that are no main text by their
tag or by a word of their class, id or role.

Counting is by partial aggregates over (host, subtree, page), so a host with a third of all
pages is spread out. A page is joined only with the numbers of its own deleted elements.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import id_type, store

MIN_PAGES = 4

#: Elements by their role in HTML, and words that name what is no main text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ENDS_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", "li", "dt", "dd"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "tr", "dt", "dd", "blockquote", "pre", "figcaption"}
NO_TEXT = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "form", "button", "select", "textarea", "input", "iframe", "svg",
    "canvas", "object", "audio", "video", "dialog", "menu", "title", "xmp", "noembed", "noframes", "math", "datalist"}
NO_TEXT_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "reply", "search", "share", "sharing", "sidebar", "signup",
    "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "widgets"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_MARK = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")


class Page:
    """Elements of a page in order (tag, marks, parent), and the stream of openings, texts and closings."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.marks: list[str] = [""]
        self.parent: list[int] = [-1]
        self.hidden: set[int] = set()
        self.stream: list[tuple[int, str | None]] = []  # (element, text), (element, None) opens it, (~element, None) closes it
        stack = [0]

        def close(down_to: int) -> None:
            while len(stack) > down_to:
                self.stream.append((~stack.pop(), None))

        at, end = 0, len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            start = m.start() if m else end
            if start > at:
                self.stream.append((stack[-1], entities.unescape(source[at:start])))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        close(k)
                        break
                continue
            rest = m[3] or m[6] or ""
            if tag in ENDS_P:
                self._end(stack, close, {"p"}, {"td", "th", "button", "table"})
            if tag in SIBLINGS:
                self._end(stack, close, *SIBLINGS[tag])
            node = len(self.tags)
            self.tags.append(tag)
            self.parent.append(stack[-1])
            self.marks.append(" ".join(a or b or c for _, a, b, c in _MARK.findall(rest)) if "=" in rest else "")
            if rest and _HIDDEN.search(rest):
                self.hidden.add(node)
            self.stream.append((node, None))
            if tag in RAW:
                stop = re.compile(f"</{re.escape(tag)}", re.I).search(source, at)
                raw = source[at:stop.start() if stop else end]
                at = end if not stop else (source.find(">", stop.end()) + 1 or end)
                self.stream += [(node, raw), (~node, None)]
            elif tag in VOID or rest.endswith("/") and tag not in ENDS_P:
                self.stream.append((~node, None))
            else:
                stack.append(node)
        close(1)

    def _end(self, stack: list[int], close, tags: set[str], scope: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in tags:
                close(k)
                return
            if tag in scope:
                return

    def no_text(self, node: int, inside: bool) -> bool:
        """Whether an element is no main text; ``inside`` the article, a header may hold its title."""
        tag = self.tags[node]
        if tag in NO_TEXT or node in self.hidden or (tag == "header" and not inside):
            return True
        return tag not in {"html", "body", "#page"} and any(w.lower() in NO_TEXT_WORDS for w in _WORD.findall(self.marks[node]))

    def mains(self) -> set[int]:
        """The outermost articles, or main elements, that are no comments; empty if there are none."""
        dropped: set[int] = set()
        found: dict[str, set[int]] = {"article": set(), "main": set()}
        covered: dict[str, set[int]] = {"article": set(), "main": set()}
        for node in range(1, len(self.tags)):
            up, tag = self.parent[node], self.tags[node]
            if up in dropped or self.no_text(node, True):
                dropped.add(node)
                continue
            kind = "main" if tag == "main" or self.marks[node] == "main" else tag
            for name in found:
                if up in covered[name]:
                    covered[name].add(node)
                elif kind == name:
                    covered[name].add(node)
                    found[name].add(node)
        return found["article"] or found["main"]

    def holders(self, mains: set[int]) -> tuple[set[int], set[int]]:
        """Elements around the mains, and elements inside them (mains included)."""
        around, inside = {0}, set(mains)
        for node in mains:
            while (node := self.parent[node]) > 0:
                around.add(node)
        for node in range(1, len(self.tags)):
            if self.parent[node] in inside:
                inside.add(node)
        return around, inside

    def subtrees(self) -> list[tuple[int, int]]:
        """(element, hash of all it contains) of elements that a site may repeat."""
        parts: list[list[bytes]] = [[t.encode(), m.encode()] for t, m in zip(self.tags, self.marks, strict=True)]
        hashes, out = {}, []
        mains = self.mains()
        around, inside = self.holders(mains)
        full: set[int] = set()
        for node, text in self.stream:
            if text is not None:
                if words := text.split():
                    parts[node].append(" ".join(words).encode("utf-8", "surrogatepass"))
                    full.add(node)
            elif node < 0:
                digest = xxhash.xxh3_64_intdigest(b"\0".join(parts[~node]))
                parts[~node] = []
                hashes[~node] = digest - (1 << 63)
                up = self.parent[~node]
                if up >= 0:
                    parts[up].append(digest.to_bytes(8, "little"))
                    if ~node in full:
                        full.add(up)
        for node in hashes:
            tag = self.tags[node]
            if node in full and tag not in INLINE and tag not in NO_TEXT and tag not in {"html", "body"} and node not in around and node not in mains and not (tag in FLOW and node in inside):
                out.append((node, hashes[node]))
        return out

    def text(self, deleted: set[int]) -> str:
        """Blocks of the main text, one to a line."""
        mains = self.mains()
        blocks: list[str] = []
        line: list[str] = []
        off = open_mains = 0
        for node, text in self.stream:
            if text is not None:
                if not off and (open_mains or not mains):
                    line.append(text)
                continue
            closing = node < 0
            node = ~node if closing else node
            tag = self.tags[node]
            if tag not in INLINE:
                blocks.append("".join(line))
                line = []
            elif tag == "br":
                line.append(" ")
            if not mains or node in mains or open_mains:
                gone = node in deleted or self.no_text(node, bool(open_mains) or node in mains)
                off += (-1 if closing else 1) if gone else 0
            if node in mains:
                open_mains += -1 if closing else 1
        blocks.append("".join(line))
        return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _keyed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    url, source = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1)
    return pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.xxhash64(url, source).alias("key"), host.alias("host"), F.xxhash64(source).alias("page"), source.alias("html"))


def site_templates(nodes: DataFrame) -> DataFrame:
    """(host, subtree) that recur: ``nodes`` has host, subtree and page."""
    counts = nodes.select("host", "subtree", "page").distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
    return counts.where(F.col("pages") >= MIN_PAGES).select("host", "subtree")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, ``text``, ``n_chars`` and ``n_deleted`` (template subtrees removed).

    Null and empty html give an empty text. Pages without a host form one site. Repeated rows
    give repeated results. Unclosed and crossing elements are closed as browsers do.
    """
    rows = _keyed(pages, id_col, url_col, html_col)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, str, int, int, int]] = []
            for key, host, page, source in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                out += [(key, host, page, node, subtree) for node, subtree in Page(source).subtrees()]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "host", "page", "node", "subtree"])

    nodes = store(rows.select("key", "host", "page", "html").mapInArrow(hashed, "key long, host string, page long, node int, subtree long"), "subtrees")
    deleted = nodes.join(site_templates(nodes), ["host", "subtree"], "left_semi").groupBy("key").agg(F.collect_set("node").alias("deleted"))
    joined = rows.select("key", "id", "url", "html").join(deleted, "key", "left").select("id", "url", "html", "deleted")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [x or [] for x in batch.column(3).to_pylist()]
            texts = [Page(source).text(set(x)) for source, x in zip(batch.column(2).to_pylist(), gone, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string()),
                pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in gone], pa.int64())], [id_col, url_col, "text", "n_chars", "n_deleted"])

    return joined.mapInArrow(cleaned, f"`{id_col}` {id_type(pages, id_col)}, `{url_col}` {id_type(pages, url_col)}, text string, n_chars long, n_deleted long")
