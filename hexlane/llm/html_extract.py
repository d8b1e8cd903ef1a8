"""Main text of pages by consensus of a host's pages.

Each page's containers are scored by the paragraphs below them; the best one votes for its generalised tag-class path. Votes
are summed a host and path in Spark, and every page is extracted again from its host's winning path, or from that of its own
best container where it has none such. An article may be split: the text is that of all containers on the path (where no name
marks the path as an article, of those with FAIR of the best one's score), and of likely siblings with FAIR of it, in page order.

What is left out is decided piece by piece: text below a menu, footer, sidebar, button and the like, or below a name of UNLIKELY,
counts little for the score and isn't part of the text, but only where the element stands inside the chosen container: a name on
an element round the whole article (a form, `has-sidebar`) drops nothing. An inline element with such a name ends with the next
block. A container that is itself below such a name is only taken if it has LEAST_RESCUED characters, and below a name of comments
only if it is an article by its own tag or name.

Nulls and edges: null or empty html gives an empty text; a null or odd url is a host of its own name ("" if none); tags left
open end with their parent; unfinished character references stay as they are; equal rows are extracted each; an empty table
gives an empty result. Only page_id, url and html are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, written

BROADCAST_HOSTS = 200_000
FAIR = 0.2
SOFT, REMARKS, LEAST_RESCUED = 0.05, 0.01, 200
# a quote opens a quoted value only right after "="; elsewhere, as in an unquoted value, it is an ordinary character
ATTRIBUTES = r"(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
WHOLE = "script|style|noscript|template|svg|math|iframe|object|textarea|select|title|canvas|audio|video"  # fixed values: elements left out with all in them
TAG = re.compile(rf"<!--.*?(?:-->|\Z)|<({WHOLE})\b{ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})>|<[!?][^>]*>", re.S | re.I)
NAMES = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: elements by kind
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HOLDER = frozenset("article body div main section td blockquote".split())
DROPPED = frozenset("nav footer aside button head dialog menu input label".split())
WRAPPERS = frozenset("form fieldset".split())
SPEECH = frozenset("comment comments disqus replies".split())
LIKELY = frozenset("article body content entry main post story text".split())
UNLIKELY = frozenset("ad ads advert advertisement adverts alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar widget".split())


class Node:
    __slots__ = ("tag", "words", "path", "parent", "start", "end", "score", "weight", "drops", "inline")

    def __init__(self, tag: str, words: list[str], parent: Node | None, start: int):
        self.tag, self.words, self.parent, self.start, self.end, self.score = tag, words, parent, start, -1, 0.0
        step = tag + "".join(f".{w}" for w in words[:2])
        self.path = f"{parent.path}/{step}" if parent else step
        self.weight = self.worth()
        # elements left out that this one is in, itself included; inline ones of a bad name apart, as a block ends them
        self.drops: tuple[Node, ...] = parent.drops if parent else ()
        self.inline: tuple[Node, ...] = parent.inline if parent and tag not in BLOCK else ()
        if self.weight < 1:
            if self.weight and tag not in BLOCK:
                self.inline += (self,)
            else:
                self.drops += (self,)

    def bits(self) -> set[str]:
        return {b for w in self.words for b in re.split(r"[^a-z]+", w)}

    def likely(self) -> bool:
        return self.tag in ("article", "main") or bool(LIKELY & self.bits())

    def within_article(self) -> bool:
        node = self.parent
        while node is not None:
            if node.likely():
                return True
            node = node.parent
        return False

    def worth(self) -> float:
        """What text below counts: 1, or less for an element left out, 0 for one that never holds an article."""
        if self.tag in DROPPED or self.tag == "header" and not self.within_article():
            return 0.0
        bits = self.bits() if self.words else set()
        if bits & SPEECH:
            return REMARKS
        return SOFT if self.tag in WRAPPERS or bits & UNLIKELY and not bits & LIKELY else 1.0


def words_of(attributes: str) -> list[str]:
    """Class names, ids and roles, digits generalised."""
    out = []
    for m in NAMES.finditer(attributes):
        out += re.sub(r"\d+", "#", m[2] or m[3] or m[4] or "").lower().split()
    return out


class Page:
    """Blocks of text in page order, each with the innermost container, and the containers."""

    def __init__(self, html: str):
        root = Node("html", [], None, 0)
        # blocks: (pieces, container, in a link); a piece is a text and the elements left out that it is in
        self.nodes, self.blocks = [root], []
        stack, links, parts, linked, at = [root], 0, [], 0, 0

        def flush() -> None:
            nonlocal parts
            if parts:
                if any(not text.isspace() for text, _ in parts):
                    self.blocks.append((parts, stack[-1], linked))
                parts = []

        def add(piece: str) -> None:
            nonlocal linked
            parts.append((unescape(piece) if "&" in piece else piece, stack[-1].drops + stack[-1].inline))
            linked += links > 0 and not piece.isspace()

        def close(depth: int) -> None:
            nonlocal links
            while len(stack) > depth:
                node = stack.pop()
                node.end = len(self.blocks)
                links -= node.tag == "a"

        for m in TAG.finditer(html):
            if m.start() > at:
                add(html[at : m.start()])
            at = m.end()
            tag = m[3]
            if tag is None:
                continue
            tag = tag.lower()
            if tag in BLOCK:
                flush()
                linked = 0
            if m[2]:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                continue
            if tag in VOID or tag in ("html", "body"):
                continue
            if tag in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p" or stack[depth].tag == tag and tag in ("li", "td", "tr", "dt", "dd"):
                        close(depth)
                        break
                    if stack[depth].tag in HOLDER or stack[depth].tag in ("ul", "ol", "table", "dl", "nav"):
                        break
            node = Node(tag, words_of(m[4]) if m[4] else [], stack[-1], len(self.blocks))
            if not m[4].endswith("/"):
                stack.append(node)
                links += tag == "a"
                if tag in HOLDER and all(d.weight for d in node.drops):
                    self.nodes.append(node)
        if at < len(html):
            add(html[at:])
        flush()
        close(1)
        root.end = len(self.blocks)

    def scored(self) -> Node:
        """The container with the highest score: paragraphs count for the nearest holder, half for the next."""
        for pieces, node, linked in self.blocks:
            weights: dict[float, list[str]] = {}
            for text, drops in pieces:
                weights.setdefault(min((d.weight for d in drops), default=1.0), []).append(text)
            worth = 0.0
            for weight, texts in weights.items():
                text = " ".join("".join(texts).split()) if weight else ""
                if text:
                    worth += (len(text) / 100 + text.count(",") + (len(text) >= 25)) * (0.2 if linked else 1) * weight
            share = 1.0
            while worth and node is not None and share > 0.2:
                if node.tag in HOLDER or node.parent is None:
                    node.score += worth * share
                    share /= 2
                node = node.parent
        for node in self.nodes:
            if node.tag in ("article", "main") and node.score:
                node.score = node.score * 1.5 + 10
            elif LIKELY & node.bits():
                node.score *= 1.25
        return max(self.nodes, key=lambda n: n.score)

    def parts(self, best: Node) -> list[Node]:
        """The containers of a split article, in page order."""
        out, parents = [], set()
        for n in self.nodes:
            if n is best or n.path == best.path and n.end > n.start and (n.likely() or n.score >= FAIR * best.score):
                out.append(n)
                parents.add(id(n.parent))
        chosen = {id(n) for n in out}
        if best.parent is not None:
            out += [n for n in self.nodes if id(n) not in chosen and id(n.parent) in parents and n.end > n.start and n.likely() and n.score >= FAIR * best.score]
        return sorted(out, key=lambda n: n.start)

    def text(self, nodes: list[Node]) -> str:
        """The text of containers without what is left out inside of them."""
        out = []
        for node in nodes:
            around, found = {id(d) for d in node.drops + node.inline}, []
            for pieces, _, _ in self.blocks[node.start : node.end]:
                text = " ".join("".join(t for t, drops in pieces if not drops or all(id(d) in around for d in drops)).split())
                if text:
                    found.append(text)
            if around and sum(map(len, found)) < LEAST_RESCUED or any(d.weight == REMARKS for d in node.drops + node.inline) and not node.likely():
                continue
            out += found
        return " ".join(out)


def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        best = [Page(h).scored() if h else None for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b and b.path for b in best], pa.string()), pa.array([b.score if b else 0.0 for b in best], pa.float64())], ["host", "path", "score"])


def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for html, path in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if not html:
                out.append("")
                continue
            page = Page(html)
            best = page.scored()
            out.append(page.text(page.parts(max((n for n in page.nodes if n.path == path and n.end > n.start), key=lambda n: n.score, default=best))))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text."""
    small_batches(pages.sparkSession)
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    cast = pages.select("host", "html").mapInArrow(votes, "host string, path string, score double").where("path is not null and score > 0")
    tally = cast.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    winners = written(tally.groupBy("host").agg(F.max_by("path", F.struct("n", F.round("score", 3), "path")).alias("path")), "host-paths")
    if winners.count() <= BROADCAST_HOSTS:
        winners = F.broadcast(winners)
    return pages.join(winners, "host", "left").select("page_id", "url", "html", "path").mapInArrow(extract, "page_id long, url string, text string")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
