"""Main text of web pages with a site style tree.

The distinct pages of a host are merged into one tree: an element is known by its path (tags and class names from the
root, chained into one number), and for each element the tree counts in which styles (orders of child tags) and with which
contents (block texts) it occurs. Presentation importance of an element is the entropy of its styles over the log of their
number of occurrences, content importance of a block's path the same over its texts; 1 where the host shows it once. A
branch's importance weighs its parent's presentation with (1 - GAMMA) and its content with GAMMA, and is drawn to 1 by a
prior: OUTSIDE occurrences' worth, or INSIDE where the markup puts the block into an article or main element. Branches
under NOISE go: what a host repeats on page after page is not the article, wherever it stands. The prior also keeps hosts
of few pages from deciding much.

The markup decides what repetition can't show: elements that are menus, headers, footers, asides, notices, adverts, forms or
comments by tag, role or class name go (their texts may differ from page to page), and if a page has an article, only its
blocks are text; else main, else elements named as content, else all the body.

Defined cases: null html is an empty page with empty text; the host is what host_of() cuts from the url, and "" where
there is none; a page that breaks off is closed at its end; repeated pages give repeated rows and count once in the tree;
a deep nesting or a long page costs in proportion. Columns of the input other than page_id, url and html are not returned.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.shared import small_side, write_shared

GAMMA, NOISE = 0.9, 0.3
OUTSIDE, INSIDE = 3.0, 12.0

#: Elements and names that say what a part of a page is.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe object svg xmp".split())
GONE = frozenset("nav footer aside form menu dialog button select datalist".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle aside banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus discussion footer form login menu modal nav "
    "navbar navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription toolbar widget complementary contentinfo search alert".split()
)
#: Words of a name that say nothing of what a part is, and names of parts in which articles aren't the page's own.
NEUTRAL = frozenset(
    "area bar bars block bottom box button buttons center container fixed global group holder home inner item items left link links list lists outer overlay page panel primary region right row secondary section site slot "
    "sticky top unit wrap wrapper zone".split()
)
OTHERS = frozenset("comment comments discussion disqus recommended related replies reply respond promo promoted sponsored".split())
HEADS = frozenset("header masthead topbar".split())
BODIES = frozenset("article content post entry story maintext articlebody".split())
#: An open element that ends when one of the others begins or its parent ends.
CLOSED_BY = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+")


def host_of(url: Column) -> Column:
    """The host of a url in lower case, without user and port; "" where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/]*\]|[^\[:/?#]*)", 1), F.lit(""))


def _key(text: str, parent: int = 0) -> int:
    """A number for a text, or for an element by its name and its parent's number."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), parent % 2**64) - (1 << 63)


def boilerplate(names: list[str]) -> set[str]:
    """The words of NAMES in class names, ids or roles that consist of such words only, but for neutral ones and numbers (`ad-slot-2`, not `with-sidebar`)."""
    found: set[str] = set()
    for name in names:
        words = set(_SPLIT.split(name)) - {""}
        if words & NAMES and all(w in NAMES or w in NEUTRAL or w.isdigit() for w in words):
            found |= words & NAMES
    return found


def parse(html: str | None) -> tuple[list[tuple[int, int, str, int]], list[tuple[int, str]]]:
    """Blocks (path, parent's path, text, place) in page order and elements (path, order of child tags).

    place: -1 where markup names boilerplate by tag or as a part with articles of others, -2 where a name does otherwise (a main
    element or article inside counts again), 3 in an article, 2 in main, 1 in an element named as content, 0 elsewhere.
    """
    html = html or ""
    blocks: list[tuple[int, int, str, int]] = []
    elements: list[tuple[int, str]] = []
    stack: list[tuple[str, int, int, list[str]]] = [("", 0, 0, [])]  # tag, path, place, child tags
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append((stack[-1][1], stack[-2][1] if len(stack) > 1 else 0, text, stack[-1][2]))

    def close(k: int) -> None:
        while len(stack) > k:
            _, path, place, kids = stack.pop()
            if kids and place >= 0:
                elements.append((path, ",".join(kids)))

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() < at:  # inside raw text that was skipped
            continue
        if m.start() > at:
            pieces.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag in INLINE:
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in RAW:
            flush()
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in INLINE:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        top = stack[-1][0]
        if top in CLOSED_BY and (top == "p" or tag in (CLOSED_BY[top] or ())):
            close(len(stack) - 1)
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(m[3])} if m[3] else {}
        named = " ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop")).lower()
        names = set(_SPLIT.split(named)) if named.strip() else frozenset()
        place = stack[-1][2]
        if place != -1 and tag not in ("html", "body"):
            head = tag == "header" or names & HEADS
            gone = boilerplate(named.split()) if named.strip() else frozenset()
            if tag in GONE or gone & OTHERS:
                place = -1
            elif gone or (head and 0 <= place < 1 and not names & BODIES):
                place = -2 if tag not in ("article", "main") or not gone else -1
            elif place == -2 and tag not in ("article", "main"):
                pass
            elif tag == "article":
                place = 3
            elif tag == "main" or "main" in named.split():
                place = max(place, 2)
            elif names & BODIES:
                place = max(place, 1)
        stack[-1][3].append(tag)
        path = _key(f"{tag}.{'.'.join(sorted(found['class'].lower().split()))}" if found.get("class") else tag, stack[-1][1])
        stack.append((tag, path, place, []))
    if at < len(html):
        pieces.append(unescape(html[at:]))
    flush()
    close(0)
    return blocks, elements


def _nodes(batches):
    """One row for each distinct showing of a path on a page: host, path, parent, shown (block text, or child tags where parent is null), page, sure."""
    for batch in batches:
        found: dict[tuple, None] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = _key(html or "")
            blocks, elements = parse(html)
            for path, parent, text, place in blocks:
                if place >= 0:
                    found[host, path, parent, _key(text), page, place >= 2] = None
            for path, kids in elements:
                found[host, path, None, _key(kids), page, False] = None
        columns = list(zip(*found, strict=True)) or [()] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["host", "path", "parent", "shown", "page", "sure"])


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, parent (null for an element's presentation), n, importance, sure: the merged trees of all hosts of pages(host, html)."""
    shown = pages.select("host", "html").mapInArrow(_nodes, "host string, path long, parent long, shown long, page long, sure boolean")
    once = shown.groupBy("host", "path", "parent", "shown", "page").agg(F.bool_or("sure").alias("sure"))
    each = once.groupBy("host", "path", "parent", "shown").agg(F.count("*").alias("n"), F.bool_or("sure").alias("sure"))
    sums = each.groupBy("host", "path", "parent").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.bool_or("sure").alias("sure"))
    entropy = F.log("n") - F.col("nlogn") / F.col("n")
    return sums.select("host", "path", "parent", "n", F.when(F.col("n") > 1, entropy / F.log("n")).otherwise(1.0).alias("importance"), "sure")


def branches(tree: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """host, path, n, sure, importance of the branches that end in blocks, prior included. tree should be a written table."""
    look = tree.where("parent is null").select("host", F.col("path").alias("parent"), F.col("importance").alias("look"))
    leaves = tree.where("parent is not null")
    prior = F.when(F.col("sure"), INSIDE).otherwise(OUTSIDE)
    importance = (1 - gamma) * F.coalesce("look", F.lit(1.0)) + gamma * F.col("importance")
    return leaves.join(look, ["host", "parent"], "left").select("host", "path", "n", "sure", ((F.col("n") * importance + prior) / (F.col("n") + prior)).alias("importance"))


def noise_paths(tree: DataFrame, gamma: float = GAMMA, noise: float = NOISE) -> DataFrame:
    """host, paths: the block paths of each host whose branches are to be removed."""
    return branches(tree, gamma).where(F.col("importance") < noise).groupBy("host").agg(F.collect_set("path").alias("paths"))


def _extract(batches):
    for batch in batches:
        texts, removed = [], []
        for html, noise in zip(batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True):
            blocks, _ = parse(html)
            drop = set(noise or ())
            left = [b for b in blocks if b[3] >= 0 and b[0] not in drop]
            best = max((b[3] for b in left), default=0)
            texts.append(" ".join(text for _, _, text, place in left if place >= best))
            removed.append(sum(b[3] >= 0 and b[0] in drop for b in blocks))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_removed"]
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_removed (blocks that only the tree takes away) of pages(page_id, url, html)."""
    plain = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", host_of(F.col("url").cast("string")).alias("host"))
    noise = write_shared(noise_paths(write_shared(style_tree(plain), "pages-tree")), "pages-noise")
    joined = plain.join(small_side(noise, 20_000), "host", "left").select("page_id", "url", "html", "paths")
    return joined.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, n_removed long")
