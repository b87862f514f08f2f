"""Operator 10, main text of web pages by site style trees (Yi, Liu and Li 2003).

One scan parses each page and emits every node of its element tree, keyed by the labels from the root down: its
presentation (the sequence of its children, in all its places on the page), its content (digests of its
blocks), and its share of the page's words. Grouped sums merge the pages of a host to its style tree:

- presentation importance is the entropy of a node's presentations over the distinct pages that have it, to the
  base of their number; content importance 1 less the mean entropy of its contents;
- a branch is noise where its presentations hardly differ and it holds few of its pages' words (a slot of the
  layout), or where its contents are the same from page to page.

A host's figures are smoothed by those of the same path on all hosts, and these by what markup suggests, with
PRIOR_PAGES pages of weight each, so there is no number of pages at which the method sets in. Names of classes
and elements beside an article only raise the importance a branch must reach; alone they remove nothing that
holds an article or most of its page's words. A second scan extracts each page without the noise of its host,
and without the elements that are no text by their tag (navigation, forms, scripts, styles and the like).

Nodes are numbers made of their parent's number and their own label, so depth costs nothing. The noise of a host
reaches its pages by a join on the host, broadcast only after its size is known.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagstream.llm.common import Stages, read_table

#: Weight, in pages, of all hosts' figures for a path beside those of one host, and of markup beside these.
PRIOR_PAGES = 2.0
#: Importance that a branch must reach: any container, one with a name of something else than text, and one beside an
#: article of its page.
LEAST, LEAST_NAMED, LEAST_BESIDE = 0.03, 0.5, 0.8
#: Importance that contents must reach, and inside an article.
LEAST_CONTENT, LEAST_CONTENT_INSIDE = 0.25, 0.1
#: Paths that are broadcast at most (about 40 bytes each); more are joined by a shuffle.
BROADCAST_PATHS = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_RAW = frozenset({"script", "style", "textarea", "title", "noscript", "xmp", "iframe", "noembed", "noframes"})
_VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"})
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_CONTAINER = frozenset("aside center details dialog dir div dl fieldset figure footer form header menu nav ol search section table ul".split())
#: What is no text of an article by its tag.
_NOT_TEXT = frozenset("head nav footer aside form select option datalist menu template svg script style noscript iframe textarea title".split())
#: Names of what a branch may be instead of text, whole or between hyphens.
_NOT_TEXT_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion promoted sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer header masthead topbar cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus replies reply respond share sharing social related recommended recommendations pagination pager toc widget widgets skip contentinfo "
    "search complementary".split())
_MAIN = frozenset({"article", "main"})
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
           "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = frozenset({"ul", "ol", "dl", "table", "select", "article", "main", "body", "html", "div", "section"})
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"[0-9]+")
_MASK = (1 << 64) - 1
#: Bits of a node: has a name of something else than text, stands beside an article, is inside one, is a container.
NAMED, BESIDE, INSIDE, CONTAINER = 1, 2, 4, 8


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _mix(a: int, b: int) -> int:
    """A number of an ordered pair, in 64 bits."""
    a = ((a ^ (b + 0x9E3779B97F4A7C15 + (a << 6) + (a >> 2))) * 0xBF58476D1CE4E5B9) & _MASK
    return a ^ (a >> 29)


class Page:
    """One page's blocks and its element tree.

    Nodes are block elements in page order, 0 the page itself: path, parent, bits, style (the sequence of their
    children's paths), words below them, and whether they hold an article or main element. blocks: (node,
    text) in page order, without what is no text by its tag.
    """

    def __init__(self, source: str, labels: dict[tuple[int, str], int] | None = None):
        self.blocks: list[tuple[int, str]] = []
        self.path, self.parent, self.bits, self.style, self.holds = [0], [-1], [0], [1], [False]
        self._labels = {} if labels is None else labels
        self._read(source)
        self.words = [0] * len(self.path)
        for node, text in self.blocks:
            self.words[node] += text.count(" ") + 1
        for node in range(len(self.path) - 1, 0, -1):
            self.words[self.parent[node]] += self.words[node]
            self.holds[self.parent[node]] |= self.holds[node]
        if self.holds[0]:
            for node in range(1, len(self.path)):
                if not self.bits[node] & INSIDE and not self.holds[node]:
                    self.bits[node] |= BESIDE

    def _node(self, parent: int, label: str, bits: int) -> int:
        key = self.path[parent], label
        path = self._labels.get(key)
        if path is None:
            path = self._labels[key] = _mix(key[0], digest(label) & _MASK)
        self.path.append(path)
        self.parent.append(parent)
        self.bits.append(bits)
        self.style.append(1)
        self.holds.append(False)
        self.style[parent] = _mix(self.style[parent], path)
        return len(self.path) - 1

    def _read(self, source: str) -> None:
        # tag, node, whether it is no text
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        open_tags: Counter[str] = Counter()
        pieces: list[str] = []
        owner = stack[0]

        def flush() -> None:
            nonlocal pieces
            if pieces:
                text = _SPACE.sub(" ", "".join(pieces)).strip()
                pieces = []
                if text and not owner[2]:
                    self.blocks.append((owner[1], text))

        def text_at(text: str) -> None:
            nonlocal owner
            if text and not stack[-1][2]:
                if not pieces:
                    owner = stack[-1]
                pieces.append(text)

        def cut(at: int) -> None:
            for item in stack[at:]:
                open_tags[item[0]] -= 1
            del stack[at:]

        at, end = 0, len(source)
        while at < end:
            found = _TOKEN.search(source, at)
            if not found:
                text_at(_html.unescape(source[at:]))
                break
            if found.start() > at:
                text_at(_html.unescape(source[at:found.start()]))
            at = found.end()
            name = found[2] or found[5]
            if not name:
                if found[0].startswith("<![CDATA["):
                    text_at(found[0][9:-3] if found[0].endswith("]]>") else found[0][9:])
                continue
            tag, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
            if closing:
                if tag in _BLOCK:
                    flush()
                if tag == "br":
                    text_at(" ")
                if open_tags[tag] > 0:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == tag:
                            cut(i)
                            break
                        if tag not in _BLOCK and stack[i][0] in _BLOCK:
                            break
                continue
            if tag in _BLOCK:
                flush()
                # an open paragraph ends where another block begins, with what is open in it
                if open_tags["p"] > 0:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == "p":
                            cut(i)
                            break
                        if stack[i][0] in _BLOCK:
                            break
                ends = _CLOSES.get(tag)
                if ends and any(open_tags[t] > 0 for t in ends):
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] in ends:
                            cut(i)
                            if not any(open_tags[t] > 0 for t in ends):
                                break
                        elif stack[i][0] in _SCOPE:
                            break
            elif tag == "br" or tag in ("img", "input", "hr"):
                text_at(" ")
            if tag in _VOID:
                continue
            _, node, out = stack[-1]
            if tag in _BLOCK:
                tokens = set()
                if attributes:
                    tokens = {_DIGITS.sub("0", t) for m in _NAMES.finditer(attributes) for t in next((x for x in m.groups() if x), "").lower().split()}
                inside = self.bits[node] & INSIDE
                bits = (INSIDE if inside or tag in _MAIN else 0) | (CONTAINER if tag in _CONTAINER else 0)
                if tokens and tag not in ("html", "body", "main", "article") and not _NOT_TEXT_NAMES.isdisjoint(w for t in tokens for w in (t, *t.replace("_", "-").split("-"))):
                    bits |= NAMED
                out = out or tag in _NOT_TEXT or (tag == "header" and not inside)
                label = tag if not tokens or tag in ("html", "body") else f"{tag}.{'.'.join(sorted(tokens))}"
                node = self._node(node, label, bits)
                if tag in _MAIN and not out:
                    self.holds[node] = True
            else:
                out = out or tag in _NOT_TEXT
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                at = close.end() if close else end
                continue
            if not attributes.rstrip().endswith("/") or tag in _BLOCK:
                stack.append((tag, node, out))
                open_tags[tag] += 1
        flush()

    def text(self, slots: frozenset[int] = frozenset(), repeats: frozenset[int] = frozenset()) -> str:
        """Text without branches that are slots of the layout or repeat themselves. A branch with an article or main
        element stays, and one with most of the page's words where the page has no such element or it is inside. Text that
        lies loosely beside such an element goes."""
        total, gone = self.words[0], [False] * len(self.path)
        for node in range(1, len(self.path)):
            path, bits = self.path[node], self.bits[node]
            most = self.words[node] * 2 > total and not bits & BESIDE
            noise = (path in slots and not most) or (path in repeats and not (most and bits & INSIDE))
            gone[node] = gone[self.parent[node]] or (noise and not self.holds[node])
        loose = self.holds[0]
        return "\n".join(t for node, t in self.blocks if not gone[node] and not (loose and self.holds[node] and not self.bits[node] & INSIDE))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def site_nodes(pages: DataFrame) -> DataFrame:
    """(host, path, kind, value, page, words, total, bits) of (host, html), distinct for each distinct page: kind 0 is
    a presentation, with the words below the path and of the page; kind 1 a content."""
    names = ["host", "path", "kind", "value", "page", "words", "total", "bits"]
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("page", pa.int64()), ("words", pa.int64()), ("total", pa.int64()), ("bits", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, None] = {}
            labels: dict[tuple[int, str], int] = {}
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1)):
                source = source.as_py() or ""
                page, own = Page(source, labels), digest(source)
                styles: dict[int, list[int]] = {}
                for path, style, words, bits in zip(page.path, page.style, page.words, page.bits):
                    at = styles.setdefault(path, [1, 0, bits])
                    at[0], at[1] = _mix(at[0], style), at[1] + words
                for path, (style, words, bits) in styles.items():
                    rows[host, _signed(path), 0, _signed(style), own, words, page.words[0], bits] = None
                for node, text in page.blocks:
                    rows[host, _signed(page.path[node]), 1, digest(text), own, 0, 0, 0] = None
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], names=names)

    return pages.mapInArrow(scan, "host string, path long, kind int, value long, page long, words long, total long, bits int").distinct()


def importance(nodes: DataFrame) -> DataFrame:
    """Style trees of site_nodes: (host, path, pages, style, content, share, bits...), one row for each host and path.

    style: entropy of its presentations over its distinct pages, to the base of their number; content: 1 less the
    mean of log_m of the pages that a content is on; null where one page says nothing. share: its words among those
    of its pages."""
    values = nodes.groupBy("host", "path", "kind", "value").agg(
        F.count("*").alias("c"), F.sum("words").alias("words"), F.sum("total").alias("total"),
        *(F.sum(F.col("bits").bitwiseAND(bit).cast("boolean").cast("long")).alias(name) for bit, name in ((NAMED, "named"), (BESIDE, "beside"), (INSIDE, "inside"), (CONTAINER, "container"))))
    n, shown = F.col("c"), F.col("kind") == 0
    trees = values.groupBy("host", "path").agg(
        F.sum(F.when(shown, n)).alias("pages"), F.sum(F.when(shown, n * F.log(n))).alias("h"), F.avg(F.when(~shown, F.log(n))).alias("r"),
        F.sum("words").alias("words"), F.sum("total").alias("total"), *(F.sum(c).alias(c) for c in ("named", "beside", "inside", "container")))
    m = F.col("pages")
    most = lambda c: 2 * F.col(c) > m
    return trees.select("host", "path", "pages", F.when(m > 1, F.greatest(F.lit(0.0), 1 - F.col("h") / (m * F.log(m)))).alias("style"),
                        F.when((m > 1) & F.col("r").isNotNull(), 1 - F.least(F.col("r") / F.log(m), F.lit(1.0))).alias("content"), F.when(F.col("total") > 0, F.col("words") / F.col("total")).otherwise(0.0).alias("share"),
                        *(most(c).alias(c) for c in ("named", "beside", "inside", "container")))


def unimportant(trees: DataFrame) -> DataFrame:
    """(host, path, slot, repeat) of noise: slots of the layout, and contents that repeat themselves.

    A branch's importance is 1 - (1 - style) (1 - share), smoothed by that of its path on all hosts, and that by what
    markup suggests: its share for named branches and those beside an article, 1 for others."""
    k, others = PRIOR_PAGES, F.col("pages") - 1
    own = 1 - (1 - F.coalesce("style", F.lit(0.0))) * (1 - F.col("share"))
    pool = trees.groupBy(F.col("path").alias("p")).agg(F.sum(others).alias("weight"), F.sum(others * own).alias("mass"))
    weak = F.col("named") | F.col("beside")
    prior = F.when(weak, F.col("share")).otherwise(1.0)
    shared: Column = (F.coalesce("mass", F.lit(0.0)) + k * prior) / (F.coalesce("weight", F.lit(0)) + k)
    found = trees.join(pool, (F.xxhash64("path") == F.xxhash64("p")) & (F.col("path") == F.col("p")), "left")
    least = F.when(F.col("beside"), LEAST_BESIDE).when(F.col("named"), LEAST_NAMED).when(F.col("inside"), 0.0).otherwise(LEAST)
    slot = (F.col("container") | F.col("beside")) & ((others * own + k * shared) / (others + k) < least)
    repeat = (F.col("pages") * F.col("content") + k) / (F.col("pages") + k) < F.when(F.col("inside"), LEAST_CONTENT_INSIDE).otherwise(LEAST_CONTENT)
    return found.select("host", "path", slot.alias("slot"), F.coalesce(repeat, F.lit(False)).alias("repeat")).where("slot or repeat")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of every page: id, url, text, n_chars (code points).

    Blocks in page order, joined by a newline; white space inside a block is one space; character references
    are decoded. Null and empty pages have empty text; pages without an address share one host. Markup may be broken
    anywhere and nested to any depth. Repeated rows each return, and count as one page; an empty table gives no
    rows; other columns are ignored.
    """
    spark = pages.sparkSession
    stages = Stages(spark, "styletree")
    host = F.regexp_extract(F.lower(F.coalesce(F.col(url_col), F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.col(html_col).cast("string").alias("html"))
    trees = stages.put(importance(site_nodes(rows.select("host", "html"))), "trees")
    noise = stages.put(unimportant(trees), "noise")
    stages.drop(trees)
    few = noise.count() <= BROADCAST_PATHS
    # a host's distinct noisy paths, as many as its layouts have
    noise = noise.groupBy("host").agg(F.collect_set(F.when(F.col("slot"), F.col("path"))).alias("slots"), F.collect_set(F.when(F.col("repeat"), F.col("path"))).alias("repeats"))
    rows = rows.join(F.broadcast(noise) if few else noise, "host", "left").select("id", "url", "html", "slots", "repeats")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels: dict[tuple[int, str], int] = {}
            text = []
            for source, *noisy in zip(*batch.columns[2:]):
                slots, repeats = (frozenset(x & _MASK for x in paths.as_py() or ()) for paths in noisy)
                text.append(Page(source.as_py() or "", labels).text(slots, repeats).encode("utf-8", "replace").decode())
            if text:
                yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], schema=schema)

    return stages.finish(rows.mapInArrow(scan, "id long, url string, text string, n_chars long"))


def op10_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Whole `pages`: page_id, url, text, n_chars."""
    return extract(read_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")
