"""Main text of web pages by consensus host paths.

1. Each page is parsed once and its containers are scored by their text outside links and
   boilerplate; going down from the body, the page ends at the smallest container that
   still holds nearly all of its parent's text and votes for that container's generalised tag-class path.
2. Votes are counted per (host, path) in Spark; a host's winning paths hold at least
   ``min_share`` of its votes.
3. Each page is extracted again with the first winning path of its host whose text in it
   is at least ``page_share`` of that of the page's own best container, else with the latter.

Blocks inside boilerplate are left out everywhere.  A part is boilerplate by its tag, by its
role, or by a class or id that is made of boilerplate words only.  Where other words stand
beside them ("share-price", "header-fixed") the part must also look like it: be full of
links, hold form fields, or be a short advert.  Neither a form nor such a name condemns a
part that holds the page's heading or most of its text.

Cases: null or empty html gives an empty text; a null or odd url belongs to no host and
the page's own container is used; unclosed tags, comments, scripts, styles, titles and text areas
end with the page, of other unclosed hidden tags only the tag is left out;
ties between paths go to the longer, then the first in order; repeated pages vote each;
very long pages are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm import shared as sh

SCHEMA = "page_id bigint, url string, text string, n_chars bigint, path string"

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title)(?![\w-]).*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"\d+")

# Left out with all inside when closed; without a close tag only the tag itself goes.
HIDDEN_TAGS = frozenset("noscript template iframe svg math object canvas select button".split())
EMPTY_BY_SLASH = frozenset("svg math".split())
BLOCK_TAGS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr "
    "blockquote pre figure figcaption address details summary fieldset header footer nav aside form hr center "
    "dialog menu search".split()
)
VOID_TAGS = frozenset("hr".split())
SPACE_TAGS = frozenset("br td th wbr img input option".split())
CONTAINERS = frozenset("html body article main section div center".split())
CLOSES_ITSELF = {"li": "ul ol menu".split(), "dt": ["dl"], "dd": ["dl"], "tr": ["table"]}
BOILER_TAGS = frozenset("head nav header footer aside dialog menu search".split())
FIELD_TAGS = frozenset("input textarea select".split())
BOILER_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus footer header menu modal nav navbar navigation newsletter notice notices pagination paywall popup "
    "promo promotion recommended related replies reply respond share sharing sidebar skip social sponsor sponsored "
    "subscribe teaser toolbar widget widgets".split()
)
# Words that say nothing beside a boilerplate word: "main-nav" is a nav, "share-price" is no share button.
PLAIN_WORDS = frozenset(
    "a about all area articles bar bars big block blocks body bottom box boxes btn button buttons center col column "
    "container content count desktop entries entry fixed footer form forms global group head heading holder icon icons "
    "id image inline inner item items js label large layout left line link links list lists main message messages meta "
    "middle mini mobile more news nested outer page pages panel part policy popular post posts primary right row second "
    "secondary section signup site small slot slots stories sub tabs text thread title toggle top unit units view wrap "
    "wrapper zone".split()
)
ADVERT_WORDS = frozenset(
    "ad ads advert advertisement adverts advertising consent cookie cookies disqus newsletter paywall popup promo "
    "promotion sponsor sponsored subscribe".split()
)
NOT_WORDS = frozenset("has with no without".split())
# How sure a part's marks are.
CLEAN, HINT, NAMED, SURE = range(4)
# Tags that are taken for what they are, whatever their classes say.
WHATEVER_CLASS = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


@dataclass(frozen=True)
class HostRules:
    min_share: float = 0.2
    page_share: float = 0.25  # of the text of the page's own best container, for a host's path to count on the page
    hold: float = 0.9  # a container goes on being the page's best while it holds this share of its parent's text


@dataclass
class Page:
    """Containers in page order; a container's descendants follow it up to ``last``."""

    tags: list[str] = field(default_factory=list)
    paths: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)  # CLEAN to SURE
    adverts: list[bool] = field(default_factory=list)
    fields: list[int] = field(default_factory=list)  # form fields inside, below as well once judged
    bad: list[bool] = field(default_factory=list)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)  # container, text, characters in links


SHORT_ADVERT = 200  # characters
MANY_LINKS = 0.5  # share of the characters


def _attributes(raw: str) -> tuple[str, list[list[str]], str]:
    """Generalised class, words of each class and of the id, role."""
    name, words, role = "", [], ""
    for kind, a, b, c in ATTRIBUTE.findall(raw):
        value = (a or b or c).lower()
        if kind.lower() == "role":
            role = value.strip()
        else:
            words += [WORDS.findall(v) for v in value.split()]
            if kind.lower() == "class":
                name = ".".join(sorted({DIGITS.sub("N", v) for v in value.split()}))
    return name, words, role


def named_mark(tag: str, names: list[list[str]], role: str) -> tuple[int, bool]:
    """How sure tag, classes, id and role make it that a part is boilerplate, and whether by an advert's name."""
    if tag in WHATEVER_CLASS:
        return CLEAN, False
    if role in BOILER_ROLES and role != "form":
        return SURE, False
    mark, advert = CLEAN, False
    for words in names:
        hits = BOILER_WORDS.intersection(words)
        if hits and NOT_WORDS.isdisjoint(words):
            pure = all(w in BOILER_WORDS or w in PLAIN_WORDS or len(w) == 1 for w in words)
            mark = max(mark, NAMED if pure else HINT)
            advert |= not ADVERT_WORDS.isdisjoint(hits)
    return mark, advert


def judge(page: Page) -> None:
    """Decides which parts are boilerplate, once all of the page is known.

    Tags and roles decide by themselves.  A form, or a part with a boilerplate name, is
    kept if it holds the page's only top heading, or nine tenths of the text that no surer
    mark condemns.  A form without fields is kept.  A part whose name only hints is left out if half of it is
    links, if it holds fields, or if it is a short advert; a paragraph is not.
    """
    n = len(page.tags)
    chars, linked, heads = [0] * n, [0] * n, [0] * n
    sure = [False] * n
    for i in range(1, n):
        sure[i] = sure[page.parents[i]] or page.marks[i] == SURE
    for node, text, links in page.blocks:
        if not sure[node]:
            chars[node] += len(text)
            linked[node] += min(links, len(text))
            heads[node] += page.tags[node] == "h1"
    for i in range(n - 1, 0, -1):
        for sums in (chars, linked, heads, page.fields):
            sums[page.parents[i]] += sums[i]
    own = [c - k for c, k in zip(chars, linked, strict=True)]
    page.bad[:] = [False] * n
    for i in range(1, n):
        mark, tag = page.marks[i], page.tags[i]
        whole = heads[i] == heads[0] > 0 or own[i] >= 0.9 * own[0] > 0 and (tag == "form" or mark == HINT)
        if mark == SURE:
            bad = True
        elif whole:
            bad = False
        elif tag == "form":
            bad = bool(page.fields[i]) or mark == NAMED or own[i] < SHORT_ADVERT
        elif mark == HINT and tag != "p":
            bad = linked[i] > MANY_LINKS * chars[i] or bool(page.fields[i]) or page.adverts[i] and chars[i] < SHORT_ADVERT
        else:
            bad = mark == NAMED
        page.bad[i] = bad or page.bad[page.parents[i]]


def visible_marks(source: str) -> Iterator[tuple[int, int, re.Match[str]]]:
    """Start, end and match of every mark; a closed hidden tag is one mark up to its close tag."""
    marks = list(MARKUP.finditer(source))
    opened: dict[str, list[int]] = {}
    closed = {}
    for i, m in enumerate(marks):
        tag = (m[3] or "").lower()
        if tag not in HIDDEN_TAGS:
            continue
        if not m[2]:
            if not (tag in EMPTY_BY_SLASH and m[4].endswith("/")):
                opened.setdefault(tag, []).append(i)
        elif opened.get(tag):
            closed[opened[tag].pop()] = i
    i = 0
    while i < len(marks):
        last = closed.get(i, i)
        yield marks[i].start(), marks[last].end(), marks[i]
        i = last + 1


def parse(source: str) -> Page:
    page = Page()
    page.tags.append("")
    page.paths.append("")
    page.parents.append(-1)
    page.marks.append(CLEAN)
    page.adverts.append(False)
    page.fields.append(0)
    page.bad.append(False)
    stack, parts = [0], []
    skipped: tuple[str, int, int] | None = None  # inline boilerplate: its tag, depth of blocks, open tags of that name
    linked = 0  # characters inside links of the open block
    in_link = False

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                page.blocks.append((stack[-1], text, linked))
            parts.clear()
        linked = 0

    def close(tag: str, within: list[str] | None = None) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = page.tags[stack[depth]]
            if name == tag:
                del stack[depth:]
                return
            if within and name in within:
                return

    at = 0
    for start, end, m in visible_marks(source):
        if start > at and skipped is None:
            parts.append(source[at:start])
            if in_link:
                linked += start - at
        at = end
        tag = m[3]
        if (m[1] or tag or "").lower() in FIELD_TAGS and not m[2]:
            page.fields[stack[-1]] += 1
        if tag is None:
            continue
        if tag.lower() in HIDDEN_TAGS:
            continue
        tag, closing, raw = tag.lower(), bool(m[2]), m[4]
        if tag == "a":
            in_link = not closing
            continue
        if tag in SPACE_TAGS:
            parts.append(" ")
            continue
        # Classes of html and body change from page to page and say nothing about the place.
        name, words, role = _attributes(raw) if raw and not closing and tag not in ("html", "body") else ("", [], "")
        block = tag in BLOCK_TAGS
        if skipped and tag == skipped[0]:
            left = skipped[2] + (-1 if closing else 1)
            skipped = (tag, skipped[1], left) if left else None
            continue
        if closing:
            if block:
                flush()
                close(tag)
                if skipped and len(stack) < skipped[1]:
                    skipped = None
            continue
        mark, advert = named_mark(tag, words, role) if words or role else (CLEAN, False)
        if not block:
            # Inline boilerplate goes, the block around it goes on.
            if mark >= NAMED and skipped is None and not raw.endswith("/"):
                skipped = (tag, len(stack), 1)
            continue
        flush()
        in_link = False if block else in_link
        if tag in VOID_TAGS:
            continue
        if block and page.tags[stack[-1]] == "p":
            stack.pop()
        if tag in CLOSES_ITSELF:
            close(tag, CLOSES_ITSELF[tag])
        parent = stack[-1]
        page.tags.append(tag)
        page.paths.append(f"{page.paths[parent]}/{tag}{'.' + name if name else ''}")
        page.parents.append(parent)
        page.marks.append(SURE if tag in BOILER_TAGS else mark)
        page.adverts.append(advert)
        page.fields.append(0)
        page.bad.append(False)
        stack.append(len(page.tags) - 1)
    if at < len(source) and skipped is None:
        parts.append(source[at:])
    flush()
    judge(page)
    return page


def best_container(page: Page, rules: HostRules = HostRules()) -> int:
    """The smallest container that holds nearly all clean text at every step down, with its top heading.

    Where siblings share the text, their parent is taken; an article is no exception.
    """
    n = len(page.tags)
    clean, heads = [0] * n, [0] * n
    for node, text, linked in page.blocks:
        if not page.bad[node]:
            clean[node] += max(0, len(text) - linked)
            heads[node] += page.tags[node] == "h1"
    for i in range(n - 1, 0, -1):
        clean[page.parents[i]] += clean[i]
        heads[page.parents[i]] += heads[i]
    children: dict[int, list[int]] = {}
    nearest = [0] * n  # container that stands for a node's children
    for i in range(1, n):
        up = nearest[page.parents[i]]
        nearest[i] = i if page.tags[i] in CONTAINERS else up
        if page.tags[i] in CONTAINERS and not page.bad[i]:
            children.setdefault(up, []).append(i)
    at = 0
    while page.tags[at] != "article":
        below = children.get(at, [])
        if not below:
            break
        top = max(below, key=lambda i: (clean[i], -i))
        outer = page.tags[at] in ("", "html", "body")
        if clean[top] < rules.hold * clean[at]:
            break
        if not outer and heads[top] < heads[at]:
            break
        at = top
    return at


def text_of(page: Page, roots: set[int]) -> str:
    """Clean blocks at or below the given containers, in page order."""
    inside = [False] * len(page.tags)
    for i in range(len(page.tags)):
        inside[i] = i in roots or (i > 0 and inside[page.parents[i]])
    return "\n".join(text for node, text, _ in page.blocks if inside[node] and not page.bad[node])


def extract(source: str, winners: list[str], rules: HostRules = HostRules()) -> tuple[str, str]:
    """(text, path) of one page under its host's winning paths."""
    page = parse(source)
    own = best_container(page, rules)
    best = text_of(page, {own})
    for path in winners:
        roots = {i for i, p in enumerate(page.paths) if p == path and not page.bad[i]}
        if roots and (text := text_of(page, roots)) and len(text) >= rules.page_share * len(best):
            return text, path
    return best, page.paths[own]


def with_host(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.when(host != "", host).alias("host"),
    )


def host_paths(pages: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """(host, paths): winning paths of every host, most votes first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for source in batch.column("html").to_pylist():
                page = parse(source)
                at = best_container(page, rules)
                paths.append(page.paths[at] if page.blocks else None)
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string())], ["host", "path"])

    votes = (
        pages.filter("host is not null and html is not null").select("host", "html")
        .mapInArrow(run, "host string, path string").filter("path is not null and path != ''")
        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"))
    )
    share = F.col("votes") / F.sum("votes").over(Window.partitionBy("host"))
    # At most 1 / min_share paths of a host can win.
    winners = votes.withColumn("_share", share).filter(F.col("_share") >= rules.min_share)
    ranked = F.sort_array(F.collect_list(F.struct(-F.col("votes"), -F.length("path"), F.col("path").alias("path"))))
    return winners.groupBy("host").agg(F.transform(ranked, lambda r: r["path"]).alias("paths"))


def main_texts(pages: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """One row per page: page_id, url, text, n_chars and the path it was taken from."""
    hosted = with_host(pages)
    # Written first, so that its real size decides: small, it is sent to all tasks and the
    # pages are not shuffled; large, both sides are.
    winners = sh.written(host_paths(hosted, rules), "host-paths")
    chosen = hosted.join(winners, "host", "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                extract(source or "", winners or [], rules)
                for source, winners in zip(
                    batch.column("html").to_pylist(), batch.column("paths").to_pylist(), strict=True)
            ]
            texts = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), pa.array([p for _, p in found], pa.string())],
                ["page_id", "url", "text", "n_chars", "path"],
            )

    return chosen.mapInArrow(run, SCHEMA)
