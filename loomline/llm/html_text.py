"""Main text of web pages by consensus paths of their host.

Every page is parsed once to score its containers: a container's score is the share
of the page's running text that it holds, times the purity of what it holds (running
text against links and page furniture).  Scores are votes for the container's
generalised tag-class path, summed by host in Spark.  A second pass extracts each page
by its host's winning path, or by the page's own best container where the path doesn't
occur.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, broadcast_if, cut, lean

#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg canvas object math".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - {"br", "body", "html", "head", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "optgroup"}
CONTAINERS = frozenset("article body div main section td".split())
#: Furniture by element name, role, and word of a class or id.
DROP_TAGS = frozenset("nav footer aside button select option dialog menu search head".split())
#: Elements of an article, by which a form is told that wraps a page from one to be filled in.
PROSE = frozenset("article main p h1".split())
#: A form that holds so much of a page's text, and elements of an article, wraps the page.
WRAPS = 0.5
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
DROP_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments disqus reply replies respond related recommended recommendations skip".split()
)
ABOUT_LAYOUT = frozenset("with has no without".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<![^<>]*>|<\?[^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>"']|"[^"]*"|'[^']*')*+|[^<>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")
#: Levels of a path that are spelled out; above these stands a digest, so that paths stay short and differ.
_SPELLED = 60
_DEPTH = re.compile(r"(\d+)~")
#: Least share of a page's running text for a vote; a path below it everywhere can't be the article's.
LEAST_SHARE = 0.25


class Page:
    """Blocks of text with the elements they stand in.

    ``parent``, ``path``, ``dropped``: by element, parents first.  ``blocks``: (element,
    text, characters of it in links), in page order.
    """

    def __init__(self, source: str | None):
        self.parent, self.path, self.tag, self.dropped = [-1], [""], [""], [False]
        self.block, self.open, self.forms = [0], Counter(), []
        self.blocks: list[tuple[int, str, int]] = []
        self._parse(source or "")
        if self.forms:
            self._drop_forms()

    def _parse(self, source: str) -> None:
        stack, text, links, link_depth, at = [0], [], 0, 0, 0

        def flush() -> None:
            nonlocal links
            if text:
                if words := " ".join(html.unescape("".join(text)).split()):
                    self.blocks.append((self.block[stack[-1]], words, min(links, len(words))))
                text.clear()
            links = 0

        def add(data: str) -> None:
            nonlocal links
            if data:
                text.append(data)
                if link_depth:
                    links += len(data)

        while m := _TAG.search(source, at):
            add(source[at : m.start()])
            at, name = m.end(), m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name in BLOCK:
                    flush()
                if name == "a":
                    link_depth = max(0, link_depth - 1)
                if self.open[name]:
                    self._close(stack, name)
                continue
            if name in BLOCK:
                flush()
                open_tag = self.tag[self.block[stack[-1]]]
                if (name in ENDS_P and open_tag == "p") or (name == open_tag and name in ("li", "option", "tr", "td", "th", "dt", "dd")):
                    self._close(stack, open_tag)
            if name in VOID:
                continue
            if name in RAW:
                if name in ("svg", "math") and m[3].endswith("/"):
                    continue  # self-closed: empty
                end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(source, at)
                at = end.end() if end else len(source)
                continue
            if m[3].endswith("/") and name not in BLOCK and name != "a":
                continue
            stack.append(self._element(stack[-1], name, m[3]))
            link_depth += name == "a"
        add(source[at:])
        flush()

    def _close(self, stack: list[int], tag: str) -> None:
        """Close the innermost open ``tag`` and all inside it."""
        while (inner := self.tag[stack.pop()]) != tag:
            self.open[inner] -= 1
        self.open[tag] -= 1

    def _element(self, parent: int, tag: str, attributes: str) -> int:
        given = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        name = tag
        if kinds := given.get("class", "").split():
            name += "." + ".".join(sorted({re.sub(r"\d+", "N", k.lower()) for k in kinds}))
        above = self.path[parent]
        if tag not in BLOCK:
            path = above
        else:
            if above.count(">") >= _SPELLED:
                above = f"{depth(above)}~{hashlib.md5(above.encode('utf-8', 'replace')).hexdigest()}"
            path = f"{above}>{name}"
        self.parent.append(parent)
        self.path.append(path)
        self.tag.append(tag)
        self.open[tag] += 1
        self.block.append(len(self.parent) - 1 if tag in BLOCK else self.block[parent])
        self.dropped.append(self.dropped[parent] or self._furniture(parent, tag, given))
        if tag == "form" and not self.dropped[-1]:
            self.forms.append(len(self.parent) - 1)
        return len(self.parent) - 1

    def _drop_forms(self) -> None:
        """Forms are furniture, but for one that wraps the article: it holds most of the text, and elements of an article."""
        size, prose = [0] * len(self.parent), [0] * len(self.parent)
        for k, text, _ in self.blocks:
            if not self.dropped[k]:
                size[k] += len(text)
        for k in range(len(self.parent) - 1, 0, -1):
            prose[k] += self.tag[k] in PROSE and size[k] > 0
            size[self.parent[k]] += size[k]
            prose[self.parent[k]] += prose[k]
        for k in self.forms:
            self.dropped[k] = not (prose[k] and size[k] >= WRAPS * size[0])
        for k in range(1, len(self.parent)):
            self.dropped[k] = self.dropped[k] or self.dropped[self.parent[k]]

    def _furniture(self, parent: int, tag: str, given: dict[str, str]) -> bool:
        if tag in DROP_TAGS or given.get("role", "").lower() in DROP_ROLES:
            return True
        if "hidden" in given or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
            return True
        if tag == "header":
            return not self._inside(parent, ("article", "main"))
        if tag in ("html", "body", "main", "article"):
            return False
        for kind in [*given.get("class", "").split(), given.get("id", "")]:
            words = {w.lower() for w in _NAME.split(kind)}
            if words & ABOUT_LAYOUT:
                continue
            if words & DROP_WORDS or ("header" in words and not self._inside(parent, ("article", "main"))):
                return True
        return False

    def _inside(self, k: int, tags: tuple[str, ...]) -> bool:
        while k > 0:
            if self.tag[k] in tags:
                return True
            k = self.parent[k]
        return False

    def scores(self) -> dict[str, float]:
        """Path -> score of its containers on this page."""
        good, other = [0] * len(self.parent), [0] * len(self.parent)
        for k, text, links in self.blocks:
            if self.dropped[k]:
                other[k] += len(text)
            else:
                good[k] += len(text) - links
                other[k] += links
        for k in range(len(self.parent) - 1, 0, -1):
            good[self.parent[k]] += good[k]
            other[self.parent[k]] += other[k]
        total: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        top: set[int] = set()
        for k in range(1, len(self.parent)):
            if self.tag[k] in CONTAINERS and not self.dropped[k] and good[k]:
                # A container inside one of the same path counts with it.
                if not any(self.path[j] == self.path[k] for j in (self.parent[k],) if j in top):
                    total[self.path[k]][0] += good[k]
                    total[self.path[k]][1] += other[k]
                top.add(k)
        return {p: (g / good[0]) * (g / (g + o)) for p, (g, o) in total.items() if g >= LEAST_SHARE * good[0]}

    def extract(self, path: str | None) -> str:
        """Text of the blocks in containers of the path that aren't furniture; of all blocks without a path."""
        inside = [path is None] * len(self.parent)
        for k in range(1, len(self.parent)):
            inside[k] = inside[self.parent[k]] or (self.path[k] == path and self.tag[k] in CONTAINERS)
        return " ".join(text for k, text, _ in self.blocks if inside[k] and not self.dropped[k])


def depth(path: str) -> int:
    """Levels of a path."""
    digest = _DEPTH.match(path)
    return path.count(">") + (int(digest[1]) if digest else 0)


def best(scores: dict[str, float]) -> str | None:
    """The winning path: the highest score, then the deepest, then the first by name."""
    return min(scores, key=lambda p: (-round(scores[p], 9), -depth(p), p)) if scores else None


def host_of(url):
    """Lower-case host of a url column, without user, port and ``www.``; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)", 1)


@lean
def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        votes: dict[tuple[str, str], float] = defaultdict(float)
        for host, source in zip(b.column("host"), b.column("html"), strict=True):
            for path, score in Page(source.as_py()).scores().items():
                votes[host.as_py(), path] += score
        if votes:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes]), pa.array([k[1] for k in votes]), pa.array(list(votes.values()), pa.float64())], names=["host", "path", "votes"])


@lean
def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = []
        for path, source in zip(b.column("path"), b.column("html"), strict=True):
            page = Page(source.as_py())
            text = page.extract(path.as_py()) if path.is_valid else ""
            texts.append(text or page.extract(best(page.scores())))
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def winners(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winning path, of ``pages(host, html)``."""
    votes = pages.select("host", "html").mapInArrow(_votes, "host string, path string, votes double")
    total = votes.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"))
    above = F.coalesce(F.regexp_extract("path", r"^(\d+)~", 1).try_cast("int"), F.lit(0))
    depth = F.length(F.regexp_replace("path", "[^>]", "")) + above
    return total.groupBy("host").agg(F.max_by("path", F.struct("votes", depth.alias("depth"), "path")).alias("path"))


def main_text(pages: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html)``.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined in page order by one space.  A null or empty page has the empty
    text; pages without a host vote together; repeated rows each vote and get a row;
    pages are read whole, however long or deep; of paths with equal votes the deepest,
    then the last by name wins; other columns are ignored; an empty table gives no rows.
    Winning paths beyond ``limit`` bytes are joined by a shuffle instead of a broadcast.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("host", host_of(F.col("url")))
    won = cut(winners(pages), few=True)
    hosts = won.agg(F.count("*"), F.coalesce(F.max(F.length("path") + F.length("host")), F.lit(0))).first()
    # One path for each host: broadcast only while their counted size is small.
    joined = pages.join(broadcast_if(won, hosts[0], hosts[1] + 64, limit), "host", "left")
    return joined.select("page_id", "url", "html", "path").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
