"""Main text of web pages, with a suffix array for each host.

Markup is the prior: what lies inside the article or main element is content;
menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles are template.  Blocks that markup leaves open (on pages without an
article, or inside it under a name that may mean either) are decided by their
host: the token streams of all open and template blocks of a host are put
together, substrings of RUN tokens or more that occur on two or more pages are
boilerplate, and the unique runs in between stay.

The suffix array is dealt out by the first RUN tokens of each suffix: suffixes
that agree in those are neighbours in the array, so an interval of common
prefix RUN is one group, and the union of its first RUN tokens over all
suffixes is exactly what long repeated substrings cover.  Groups are reduced to
their smallest and largest page before the shuffle, so a host with a third of
all pages is no burden.  Text that markup calls content is never judged by
repetition, as copies of an article are still articles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbara.llm.common import Words, rolling, shielded, slices, table

RUN = 6  #: tokens of the shortest substring that counts as repeated

#: DOUBT is OPEN inside an article.
CONTENT, OPEN, TEMPLATE, DOUBT = 0, 1, 2, 3

#: Attributes up to the closing bracket outside quotes; a tag whose quotes do
#: not balance ends at its first bracket.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
NEVER = set("head nav aside footer form button select dialog menu svg math canvas object audio video map fieldset label input datalist".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar tablist toolbar".split())
#: Words that name template wherever they stand in a class or id.
NAMES = set(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs topbar masthead footer sidebar "
    "ad ads advert adverts advertisement advertising adslot adsense adbox sponsored "
    "cookie cookies consent gdpr popup newsletter signup signin login "
    "comments commentlist disqus pagination pager toolbar".split()
)
#: Words that name template alone; as part of a longer name they leave the block open.
MAYBE = set(
    "banner aside widget widgets sponsor promo promotion notice notices notification modal overlay subscribe subscription "
    "form search comment respond reply replies discussion share sharing social related recommended recommendations skip".split()
)
HEADER_NAMES = {"header", "hdr"}
PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")
CLOSES_P = BLOCK - {"li", "dd", "dt", "td", "th", "tr", "option", "optgroup", "legend", "summary", "body", "html", "head"}


def _judged(tag: str, attrs: dict[str, str], inside: bool) -> int:
    """State of an element by its tag, role, class or id: TEMPLATE, DOUBT or CONTENT.  inside: within article or main."""
    if tag in NEVER or (tag == "header" and not inside):
        return TEMPLATE
    if not attrs or tag in ("html", "body", "main"):
        return CONTENT
    if attrs.get("role", "").strip().lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return TEMPLATE
    if re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return TEMPLATE
    doubt = CONTENT
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).split():
        parts = {x.lower() for x in PARTS.findall(name)}
        if parts & NAMES or name.lower() in MAYBE or (not inside and parts & HEADER_NAMES):
            return TEMPLATE
        if parts & MAYBE:
            doubt = DOUBT
    return doubt


def page_blocks(html: str | None) -> list[tuple[int, str]]:
    """(state, text) of every block with text, in page order.

    Text takes the state of the element it stands in, so template inside a
    paragraph leaves the paragraph alone; its words make a block of their own.
    """
    out: list[tuple[int, str]] = []
    if not html:
        return out
    # tag, state from here on, inside article or main, place of the p that a block would close (-1: none)
    stack: list[tuple[str, int, bool, int]] = []
    open_tags: dict[str, int] = {}
    text: list[str] = []
    dropped: list[str] = []
    state = OPEN
    seen_main = False
    at = 0
    n = len(html)

    def cut(to: int) -> None:
        for tag, *_ in stack[to:]:
            open_tags[tag] -= 1
        del stack[to:]

    def add(t: str) -> None:
        nonlocal state
        if stack and stack[-1][1] == TEMPLATE:
            dropped.append(t)
        else:
            state = OPEN if not stack else stack[-1][1]
            text.append(t)

    def flush() -> None:
        for parts, s in ((text, state), (dropped, TEMPLATE)):
            words = " ".join(unescape("".join(parts)).split())
            parts.clear()
            if words:
                out.append((s, words))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            add(html[at:])
            break
        if lt > at:
            add(html[at:lt])
        m = TAG.match(html, lt) or LOOSE.match(html, lt)
        if not m:  # a bare "<" is text
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        block = tag in BLOCK or tag in NEVER
        if m[1]:  # an end tag
            if block:
                flush()
            if open_tags.get(tag):
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*+(?:>|/|\Z)", re.I).search(html, at)
            at = n if end is None else max(at, html.find(">", end.start()) + 1 or n)
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
            continue
        if block:
            flush()
        if tag in CLOSES_P and stack and stack[-1][3] >= 0:
            cut(stack[-1][3])
        _, above, main, p = stack[-1] if stack else ("", OPEN, False, -1)
        attrs = {x[1].lower(): x[2] or x[3] or x[4] or "" for x in ATTR.finditer(m[3])} if m[3].strip() else {}
        inside = main or tag in ("article", "main") or attrs.get("role", "").strip().lower() == "main"
        here = _judged(tag, attrs, inside)
        if above == TEMPLATE or here == TEMPLATE:
            here = TEMPLATE
        elif above == DOUBT or (here == DOUBT and inside and block):
            here = DOUBT
        else:
            here = CONTENT if inside else OPEN
        seen_main |= inside and here == CONTENT
        stack.append((tag, here, inside, len(stack) if tag == "p" else -1 if block else p))
        open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    if seen_main and any(s == CONTENT for s, _ in out):
        return [(TEMPLATE if s == OPEN else s, t) for s, t in out]
    return out


def _host(url: str | None) -> str:
    m = re.match(r"(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return m[1].rpartition("@")[2].lower() if m else ""


def _windows(pages: DataFrame) -> DataFrame:
    """host, _key, block, hs (hash of each suffix's first RUN tokens) of all blocks that are not content."""
    schema = "host string, _key long, block int, hs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                host, key, block, texts = [], [], [], []
                for k, url, html in zip(part.column("_key").to_pylist(), part.column("_url").to_pylist(), part.column("_html").to_pylist()):
                    for i, (state, text) in enumerate(page_blocks(html)):
                        if state != CONTENT:
                            host.append(_host(url))
                            key.append(k)
                            block.append(i)
                            texts.append(text)
                w = Words(pa.array(texts, pa.string()))
                h = rolling(w.hash, RUN).astype(np.int64)
                hs = [h[a : max(a, b - RUN + 1)] for a, b in zip(w.first[:-1], w.first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(host, pa.string()), pa.array(key, pa.int64()), pa.array(block, pa.int32()), pa.array(hs, pa.list_(pa.int64()))],
                    names=["host", "_key", "block", "hs"])

    return pages.mapInArrow(run, schema)


def covered(starts: list[int]) -> list[tuple[int, int]]:
    """Disjoint spans that windows of RUN tokens beginning at sorted ``starts`` cover."""
    out: list[tuple[int, int]] = []
    for at in starts:
        if out and at <= out[-1][1]:
            out[-1] = (out[-1][0], at + RUN)
        else:
            out.append((at, at + RUN))
    return out


def unique_runs(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` (tokens joined by a space) without the tokens inside ``spans``."""
    words, at, left = text.split(" "), 0, []
    for a, b in spans:
        left += words[at:a]
        at = b
    return " ".join(left + words[at:])


@shielded
def extract(pages: DataFrame, page: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of ``pages``: page, url, text, n_chars, n_template (tokens of template blocks), n_repeated (tokens of
    template and open blocks that the host repeats on other pages) and n_judged (tokens of open blocks).

    Null or empty html gives an empty text, an empty table an empty result.
    Rows equal in all three columns are one page, so copies of a page repeat
    nothing, and each of them gets the page's row.  Pages without a host share
    the empty host.  Other columns do not matter.
    """
    keyed = pages.select(F.col(page).alias("_page"), F.col(url).alias("_url"), F.col(html).alias("_html"), F.xxhash64(page, url, html).alias("_key"))
    blocks = _windows(keyed.select("_key", "_url", F.coalesce("_html", F.lit("")).alias("_html")))
    suffixes = blocks.select("host", "_key", "block", F.posexplode_outer("hs").alias("at", "h")).filter(F.col("h").isNotNull())
    repeated = suffixes.groupBy("host", "h").agg(F.min("_key").alias("a"), F.max("_key").alias("b")).filter(F.col("a") != F.col("b")).select("host", "h")
    runs = suffixes.join(repeated, ["host", "h"]).groupBy("_key").agg(
        F.array_sort(F.collect_set(F.struct("block", "at"))).alias("runs")).withColumnRenamed("_key", "_k")
    kind = keyed.schema["_page"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_html"):
                found = [page_blocks(h) for h in part.column("_html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("_page"), part.column("_url"), part.column("_key"),
                     pa.array([sum(t.count(" ") + 1 for s, t in f if s == TEMPLATE) for f in found], pa.int64()),
                     pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int32())),
                     pa.array([[t if s != TEMPLATE else "" for s, t in f] for f in found], pa.list_(pa.string()))],
                    names=["_page", "_url", "_key", "n_template", "states", "parts"])

    parsed = keyed.withColumn("_html", F.coalesce("_html", F.lit(""))).mapInArrow(
        parse, f"_page {kind}, _url string, _key long, n_template long, states array<int>, parts array<string>")
    both = parsed.join(runs, F.col("_key") == F.col("_k"), "left").drop("_k", "_key")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, repeats, judged = [], [], []
            for states, parts, found in zip(*(batch.column(c).to_pylist() for c in ("states", "parts", "runs"))):
                starts: dict[int, list[int]] = {}
                for r in found or ():
                    starts.setdefault(r["block"], []).append(r["at"])
                spans = {i: covered(x) for i, x in starts.items()}
                own = [unique_runs(t, spans.get(i, [])) if s in (OPEN, DOUBT) else t for i, (s, t) in enumerate(zip(states, parts))]
                texts.append("\n\n".join(t for t in own if t))
                repeats.append(sum(b - a for x in spans.values() for a, b in x))
                judged.append(sum(t.count(" ") + 1 for s, t in zip(states, parts) if s in (OPEN, DOUBT)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_page"), batch.column("_url"), pa.array(texts, pa.string()), batch.column("n_template"), pa.array(repeats, pa.int64()), pa.array(judged, pa.int64())],
                names=["_page", "_url", "text", "n_template", "n_repeated", "n_judged"])

    out = both.mapInArrow(joined, f"_page {kind}, _url string, text string, n_template long, n_repeated long, n_judged long")
    return out.select(F.col("_page").alias(page), F.col("_url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"), "n_template", "n_repeated", "n_judged")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
