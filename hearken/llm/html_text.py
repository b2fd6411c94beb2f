"""Main text of web pages: templates by recurrence over a site's pages, page furniture by element.

Pages are read once from start to end into a light element tree; no page is ever an error,
and the work is linear in its length whatever is unclosed or nested. Every element below the
inline ones is a subtree with a hash over its tag, its own text and the hashes of its
children, so a page has one hash per element, not one per element and ancestor.

All subtrees are hashed and counted, furniture too. For every host, every registered domain
and all hosts together Spark counts on how many *different* pages a subtree occurs; those on
at least ``share`` of a level's pages, ``least`` pages or more, are its template and are
deleted wherever they stand on its pages; a host with few pages thus still has the templates
of its domain. Subtrees that hold an ``article`` or ``main`` element are never a template.
Copies of a page count once per host, so a much copied article is not mistaken for a template.

What need not recur goes by what it is: scripts, navigation, forms, asides, hidden elements
by tag, role and attribute; and containers by a class or id word (``MARKS``), which is a
prior only: it never counts for paragraphs and headings, inside ``article`` and ``main`` only
a whole class name counts, and it drops no element that holds all ``article`` and ``main``
elements of the page or, on a page without any, more than half of its text. ``report`` tells
how many blocks each rule deletes.

Counts are combined map-side, so a host with a third of all pages is no hot spot there. A
host's pages meet its list of templates (at most 1/``share`` times the subtrees of an average
page) by host and a salt, of which a host has one for each ``chunk`` of its pages.

Edge cases: null or empty html gives an empty text; a null url has the empty host, which is
a host like any other; repeated rows are extracted each; unclosed, stray and misnested tags
are closed by their parents; a tag that never ends reaches to the end of the page; an empty
table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import ascii_lower, stored

#: Attributes up to the end of a tag; a quote counts only behind ``=`` and only if it is closed.
_REST = r"""(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+"""
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|svg|iframe|object|select)\b{_REST}>.*?(?:</\1\s*+>|\Z)"
    rf"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*+)({_REST})(?:>|\Z)|([^<]+|<)",
    re.I | re.S,
)
#: One attribute after the other, each with its whole value, so that words of values are never taken for names.
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?|\"[^\"]*\"|'[^']*'")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that another opening tag of the same group closes; ``p`` closes an open ``p``.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements whose class and id words count.
CONTAINERS = frozenset("div section span ul ol dl table header figure details fieldset center iframe".split())
FURNITURE = frozenset("head nav footer aside form button menu dialog input select textarea".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class and id names that mark page furniture.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar aside widget widgets footer masthead toolbar pagination pager cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe"
    " subscription signup login comment comments disqus reply replies respond share sharing social related recommended recommendations trending copyright legal".split()
)
BLANK = re.compile(r"\s+")
WORD = re.compile(r"[a-z0-9]+")


KEEP, MARKED, DROP = range(3)


class Node:
    """An open element. ``block`` is the nearest element that is not inline, ``scope`` the depth of the nearest that is
    neither inline nor ``p``, ``p`` the depth of an open ``p`` inside that scope."""

    __slots__ = ("number", "tag", "state", "whole", "block", "depth", "scope", "p", "hash", "main", "inside", "chars", "mains")

    def __init__(self, number: int, tag: str, state: int, parent: "Node | None"):
        self.number, self.tag, self.state = number, tag, state
        self.whole = state if parent is None else max(parent.whole, state)
        self.depth = 0 if parent is None else parent.depth + 1
        inline = tag in INLINE
        self.block = parent.block if inline else self
        self.scope, self.p = (parent.scope, parent.p) if inline or tag == "p" else (self.depth, 0)
        if tag == "p":
            self.p = self.depth
        self.main = tag in ("article", "main")
        self.inside = self.main or (parent is not None and parent.inside)
        self.hash, self.chars, self.mains = None if inline else xxhash.xxh3_64(tag), 0, int(self.main)


def _state(tag: str, attributes: str, inside: bool) -> int:
    """Is the element page furniture (``DROP``), or only by a class word (``MARKED``)? ``inside`` an article, less is."""
    if tag in FURNITURE or (tag == "header" and not inside):
        return DROP
    if not attributes or tag in ("html", "body", "article", "main"):
        return KEEP
    found = KEEP
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in ROLES):
            return DROP
        if tag in CONTAINERS and name in ("class", "id") and not MARKS.isdisjoint(value.split() if inside else WORD.findall(value)):
            found = MARKED
    return found


class Page:
    """Blocks of text in page order, and the elements as arrays; parents come before their children.

    ``owner`` is the element of a block. Of an element: ``parent``, ``digest`` (0 for inline
    elements and those that hold an article), and ``gone``, if a rule deletes it with all below.
    """

    def __init__(self, page: str | None):
        self.texts: list[str] = []
        self.owner: list[int] = []
        self.parent, self.digest, self.state = [0], [0], [KEEP]
        self.sums: list[tuple[int, int]] = [(0, 0)]
        top = Node(0, "", KEEP, None)
        self.stack, self.open, self.parts = [top], {}, []
        for m in TOKEN.finditer(page or ""):
            raw, end, name, attributes, text = m.groups()
            if text:
                above = self.stack[-1]
                if above.whole == above.block.whole:
                    self.parts.append(html.unescape(text))
                if above.whole < DROP:
                    above.chars += sum(map(len, text.split()))
            elif name is None:
                if raw and raw.lower() != "title":
                    self.parts.append(" ")
            elif end:
                self._end(name.lower())
            else:
                self._start(name.lower(), attributes)
        while len(self.stack) > 1:
            self._close()
        self._flush()
        self.sums[0] = (top.chars, top.mains)
        self.gone = self._decide()

    def _flush(self) -> None:
        text = BLANK.sub(" ", "".join(self.parts)).strip()
        self.parts.clear()
        if text:
            block = self.stack[-1].block
            self.texts.append(text)
            self.owner.append(block.number)
            block.hash.update(b"t" + text.encode("utf-8", "surrogatepass"))

    def _start(self, tag: str, attributes: str) -> None:
        above = self.stack[-1]
        at = above.p if tag == "p" else above.scope if self.stack[above.scope].tag in CLOSES.get(tag, ()) else 0
        while at and len(self.stack) > at:
            self._close()
        if tag in VOID:
            if tag in ("br", "wbr", "hr"):
                self.parts.append("" if tag == "wbr" else " ")
            return
        if tag not in INLINE:
            self._flush()
        above = self.stack[-1]
        state = _state(tag, attributes, above.inside)
        node = Node(len(self.parent), tag, state, above)
        self.parent.append(above.number)
        self.digest.append(0)
        self.state.append(state)
        self.sums.append((0, 0))
        self.stack.append(node)
        self.open.setdefault(tag, []).append(node.depth)

    def _end(self, tag: str) -> None:
        if self.open.get(tag):
            at = self.open[tag][-1]
            while len(self.stack) > at:
                self._close()
        elif tag not in INLINE:
            self._flush()

    def _close(self) -> None:
        node = self.stack[-1]
        if node.hash is not None:
            self._flush()
        self.stack.pop()
        self.open[node.tag].pop()
        up = self.stack[-1]
        up.main |= node.main
        up.chars += node.chars
        up.mains += node.mains if node.whole < DROP else 0
        self.sums[node.number] = (node.chars, node.mains)
        if node.hash is not None:
            digest = node.hash.intdigest()
            up.block.hash.update(digest.to_bytes(8, "big"))
            if not node.main:
                self.digest[node.number] = (digest or 1) - (1 << 63)

    def _decide(self) -> list[bool]:
        chars, mains = self.sums[0]
        gone = [False] * len(self.parent)
        for k in range(1, len(gone)):
            own, state = self.sums[k], self.state[k]
            spared = own[1] == mains if mains else 2 * own[0] > chars
            gone[k] = gone[self.parent[k]] or state == DROP or (state == MARKED and not spared)
        return gone

    def kept(self, template: frozenset[int] | set[int] = frozenset()) -> list[str]:
        """The texts that neither a rule nor the template deletes."""
        gone = self.gone
        if template:
            gone = list(gone)
            for k in range(1, len(gone)):
                gone[k] = gone[k] or gone[self.parent[k]] or self.digest[k] in template
        return [t for t, o in zip(self.texts, self.owner) if not gone[o]]

    def subtrees(self) -> list[int]:
        """The distinct hashes of subtrees with text that may be templates."""
        held = {0}
        for o in self.owner:
            while o not in held:
                held.add(o)
                o = self.parent[o]
        return sorted({self.digest[k] for k in held} - {0})


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [" ".join(Page(h.as_py()).kept(set(t.as_py() or ()))) for h, t in zip(batch.column("html"), batch.column("template"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, page, trees): the distinct subtrees of each page, with a fingerprint of the page's text."""
    for batch in batches:
        prints, trees = [], []
        for page in batch.column("html"):
            found = Page(page.as_py())
            prints.append(xxhash.xxh3_64_intdigest("\n".join(found.kept()).encode("utf-8", "surrogatepass")) - (1 << 63))
            trees.append(found.subtrees())
        yield pa.RecordBatch.from_arrays(
            [batch.column("host"), pa.array(prints, pa.int64()), pa.array(trees, pa.list_(pa.int64()))], names=["host", "page", "trees"]
        )


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rule, blocks): who deletes a block: the template of its site, else the element or class word of an element around it."""
    for batch in batches:
        n = dict.fromkeys(("kept", "template", "element", "class word"), 0)
        for h, t in zip(batch.column("html"), batch.column("template")):
            page, template = Page(h.as_py()), set(t.as_py() or ())
            rule = ["kept"] * len(page.parent)
            for k in range(1, len(rule)):
                own = "template" if page.digest[k] in template else "element" if page.state[k] == DROP else "class word" if page.gone[k] and page.state[k] == MARKED else "kept"
                above = rule[page.parent[k]]
                rule[k] = own if above == "kept" or own == "template" else above
            for o in page.owner:
                n[rule[o]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["rule", "blocks"])


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if there is none."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two names of a host."""
    return F.substring_index(host, ".", -2)


def templates(pages: DataFrame, share: float = 0.5, least: int = 8) -> DataFrame:
    """(host, pages, template): every host with its number of different pages and the subtree hashes that recur over
    them, over those of its domain, or over all."""
    own = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "html")
    found = own.mapInArrow(_subtrees, "host string, page long, trees array<long>")
    once = stored(found.groupBy("host", "page").agg(F.min("trees").alias("trees")))
    sizes = once.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).withColumn("domain", domain_of(F.col("host")))
    counts = stored(once.select("host", F.explode("trees").alias("tree")).groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n")))

    def common(level: list[str], counted: DataFrame, whole: DataFrame) -> DataFrame:
        n = counted.groupBy(*level, "tree").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        met = n.join(whole.groupBy(*level).agg(F.sum("pages").alias("pages")), level)
        return met.filter(F.col("n") >= F.ceil(F.col("pages") * F.lit(share))).groupBy(*level).agg(F.collect_set("tree").alias("found"))

    counts = counts.withColumn("domain", domain_of(F.col("host"))).withColumn("site", F.lit("all"))
    sizes = sizes.withColumn("site", F.lit("all"))
    none = F.array().cast("array<long>")
    met = sizes
    for level, name in (("host", "of_host"), ("domain", "of_domain"), ("site", "of_all")):
        met = met.join(common([level], counts, sizes).withColumnRenamed("found", name), level, "left")
    lists = [F.coalesce(c, none) for c in ("of_host", "of_domain", "of_all")]
    return met.select("host", "pages", F.array_distinct(F.concat(*lists)).alias("template"))


def _with_templates(pages: DataFrame, share: float, least: int, chunk: int) -> DataFrame:
    """page_id, url, html and the template of the page's host (null where there is none)."""
    found = stored(templates(pages, share, least))
    some = found.filter(F.size("template") > 0).withColumn("salts", F.ceil(F.col("pages") / F.lit(chunk)).cast("int"))
    salted = some.select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "template")
    # hosts with more than one salt: at most one for each chunk of all pages
    large = some.filter("salts > 1").select("host", "salts")
    rows = pages.select(F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), "url", F.col("page_id").cast("long").alias("page_id"), "html")
    rows = rows.join(large, "host", "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    return rows.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "template")


def extract(pages: DataFrame, share: float = 0.5, least: int = 8, chunk: int = 20_000) -> DataFrame:
    """page_id, url, text and n_chars per page."""
    out = _with_templates(pages, share, least, chunk).mapInArrow(_render, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def report(pages: DataFrame, share: float = 0.5, least: int = 8, chunk: int = 20_000) -> DataFrame:
    """(rule, blocks): how many blocks of text each rule deletes, and how many are kept. A template is named first."""
    found = _with_templates(pages, share, least, chunk).mapInArrow(_deletions, "rule string, blocks long")
    return found.groupBy("rule").agg(F.sum("blocks").alias("blocks"))
