"""Main text of web pages by a site style tree.

The pages of a host share templates. Each element is named by its style, the tags
and class names from the body down to it, so that the pages of a host merge into
one tree. For each style node the texts that pages show there are counted, and
the entropy of that distribution, over its largest possible value, is the
importance of the node: 1 where each page says something else, 0 where all say
the same. A text that most pages of a host show in one place has none either.
Branches of low importance are removed from each page. What HTML itself names as
no main text (navigation, footers, forms, scripts and the like, by element or by
class name) has importance 0 from the start, and the contents of ``article`` or
``main``, where a page has them, come before the rest.

Only hashes of styles and texts are counted, with partial counts before the
shuffle, so a host with a third of all pages is no hot group. Pages meet their
host's removed branches in a join whose small side is broadcast only if its
measured size allows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clusterloom.lineage import cut_lineage
from clusterloom.llm.url_filters import url_host

#: A style node is judged from this many different pages of a host.
LEAST_PAGES = 8
#: Importance up to which a branch is removed.
LOW_IMPORTANCE = 0.2
#: Share of a host's different pages from which one text in one place is template.
COMMON_SHARE = 0.5
#: Removed branches, in all, up to which they are broadcast: about 16 MB.
MOST_BROADCAST = 1_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(?:!|\?)[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes svg math".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
    "span strike strong sub sup time tt u var wbr img".split()
)
_NO_TEXT = frozenset(
    "nav footer aside form button select option input textarea script style head title noscript iframe "
    "template dialog menu object embed canvas audio video svg math datalist".split()
)
_NO_TEXT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising banner banners breadcrumb breadcrumbs "
    "comment comments consent contentinfo cookie cookies copyright disqus footer gdpr login masthead menu "
    "menubar nav navbar navigation newsletter notice notices pager pagination popup promo promos promotion "
    "related search share sharing sidebar sidebars signup social sponsor sponsored sponsors subscribe "
    "toolbar topbar widget widgets alert complementary header disclaimer".split()
)
_COMMENTS = frozenset("comment comments disqus reply replies".split())
#: Open elements that a start tag ends.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
}
_SCOPES = frozenset("ul ol dl table select article main section div body aside nav footer header".split())
_PLAIN, _MAIN, _NONE = 0, 1, 2
#: Stands for the page itself where styles and places are counted.
_WHOLE = (0, 0)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


@dataclass(slots=True)
class _Open:
    tag: str
    style: int
    zone: int
    hard: bool  # no element inside can be main text
    linked: bool
    wrap: int = -1  # the innermost form or named wrapper


@dataclass(slots=True)
class Block:
    """A run of text without a block boundary; ``style`` is odd in ``article`` or ``main``."""

    style: int
    zone: int
    text: str
    linked: bool  # all of it is link text
    wrap: int = -1


@dataclass(slots=True)
class _Buffer:
    parts: list[str] = field(default_factory=list)
    style: int = 0
    zone: int = _PLAIN
    linked: bool = True
    wrap: int = -1


def blocks(page: str | None) -> list[Block]:
    """The blocks of a page in order, those of no importance by nature left out."""
    source = page or ""
    out: list[Block] = []
    stack = [_Open("", 0, _PLAIN, False, False)]
    buffer = _Buffer()
    around: list[int] = []  # of each wrapper the one around it

    def flush() -> None:
        if buffer.parts:
            text = " ".join("".join(buffer.parts).split())
            if text:
                style = buffer.style & ~1 | (buffer.zone == _MAIN)
                out.append(Block(style, buffer.zone, text, buffer.linked, buffer.wrap))
            buffer.parts.clear()
            buffer.linked = True

    def say(raw: str) -> None:
        top = stack[-1]
        if top.zone == _NONE or not raw:
            return
        if not buffer.parts:
            if raw.isspace():
                return
            block = next((o for o in reversed(stack) if o.tag not in _INLINE), stack[0])
            buffer.style, buffer.zone, buffer.wrap = block.style, block.zone, block.wrap
        buffer.parts.append(html.unescape(raw) if "&" in raw else raw)
        if not top.linked and not raw.isspace():
            buffer.linked = False

    def close(count: int) -> None:
        for _ in range(count):
            if stack.pop().tag not in _INLINE:
                flush()

    at = 0
    while True:
        lt = source.find("<", at)
        if lt < 0:
            say(source[at:])
            break
        m = _TOKEN.match(source, lt)
        if m is None:  # a bare "<" is text
            say(source[at : lt + 1])
            at = lt + 1
            continue
        say(source[at:lt])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i, o in enumerate(reversed(stack)) if o.tag == tag), -1)
            if 0 <= depth < len(stack) - 1:
                inner = stack[-depth:] if depth else []
                if tag in _INLINE and any(o.tag not in _INLINE for o in inner):
                    continue  # misnested: an inline end tag ends no block
                close(depth + 1)
            elif tag not in _INLINE:
                flush()
            continue
        if tag not in _INLINE:
            flush()
        if tag in _VOID:
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        ends = _ENDS.get(tag, {"p"} if tag not in _INLINE else ())
        for depth, o in enumerate(reversed(stack)):
            if o.tag in ends:
                close(depth + 1)
                break
            if o.tag in _SCOPES and o.tag not in ends:
                break
        parent = stack[-1]
        given = [(k.lower(), (a or b or c).lower()) for k, a, b, c in _NAMES.findall(m[3])] if m[3] else []
        names = " ".join(value for _, value in given)
        parts = set(_PART.findall(names)) if names else frozenset()
        zone, hard, wrap = parent.zone, parent.hard, parent.wrap
        named = not _NO_TEXT_NAMES.isdisjoint(parts)
        comments = not _COMMENTS.isdisjoint(parts)
        if zone == _MAIN:  # in main text only a whole class or role value says what an element is
            whole = {value.strip() for key, value in given if key != "id"}
            named, comments = not _NO_TEXT_NAMES.isdisjoint(whole), not _COMMENTS.isdisjoint(whole)
        if tag in _NO_TEXT and tag != "form" or comments:
            zone, hard = (zone, hard) if tag == "head" and zone == _NONE else (_NONE, True)
        elif tag in ("article", "main") or "main" == names.strip():
            if named and tag == "article":
                zone = _NONE
            elif not hard:
                if zone != _MAIN:
                    wrap = -1
                zone = _MAIN
        elif tag == "form" or named and tag not in ("html", "body"):
            around.append(wrap)
            wrap = len(around) - 1
        elif tag == "header" and zone != _MAIN:
            zone, hard = _NONE, True
        style = parent.style if tag in _INLINE else _hash(f"{parent.style}/{tag} {' '.join(sorted(parts))}")
        stack.append(_Open(tag, style, zone, hard, parent.linked or tag == "a", wrap))
        if tag == "body":  # a head that was never closed ends here
            stack[-1].zone, stack[-1].hard = _PLAIN, False
    flush()
    # a form or named wrapper is left out unless it holds most of the page's text
    held = [0] * len(around)
    for b in out:
        at = b.wrap
        while at >= 0:
            held[at] += len(b.text)
            at = around[at]
    total = sum(len(b.text) for b in out)
    stays = []
    for at, outer in enumerate(around):  # a wrapper comes after the one around it
        stays.append(2 * held[at] > total and (outer < 0 or stays[outer]))
    return [b for b in out if b.zone != _NONE and (b.wrap < 0 or stays[b.wrap])]


def _place(block: Block) -> int:
    """The text in its place, as one hash."""
    return _hash(f"{block.style}\n{block.text}")


def main_text(page: str | None, removed: frozenset[int] = frozenset()) -> str:
    """The blocks of the page that are left, joined by single spaces.

    Where a page has text in ``article`` or ``main``, that is all; otherwise
    blocks that are nothing but links are left out as navigation.
    """
    left = [b for b in blocks(page) if b.style not in removed and _place(b) not in removed]
    main = [b.text for b in left if b.zone == _MAIN]
    return " ".join(main or [b.text for b in left if not b.linked])


def site_branches(pages: DataFrame, html_col: str = "html", url_col: str = "url",
                  least_pages: int = LEAST_PAGES, low: float = LOW_IMPORTANCE,
                  common: float = COMMON_SHARE) -> DataFrame:
    """``(host, branch)``: hashes of the style nodes, and of texts in their place, to remove."""
    rows = pages.select(url_host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    rows = rows.filter("host <> '' AND html IS NOT NULL")

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, pages_, styles, places = [], [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = blocks(page.as_py())
                own = _hash("\n".join(b.text for b in found))  # copies of a page count once
                for style, place in {(b.style, _place(b)) for b in found} | {_WHOLE}:
                    hosts.append(host)
                    pages_.append(own)
                    styles.append(style)
                    places.append(place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), *(pa.array(c, pa.int64()) for c in (pages_, styles, places))],
                names=["host", "page", "style", "place"],
            )

    seen = rows.mapInArrow(shown, "host string, page long, style long, place long")
    texts = seen.groupBy("host", "style", "place").agg(F.countDistinct("page").alias("n"))
    whole = F.col("style") == _WHOLE[0]
    n_pages = texts.filter(whole).select("host", F.col("n").alias("pages")).filter(F.col("pages") >= least_pages)
    texts = texts.filter(~whole)
    n = F.col("n")
    nodes = texts.groupBy("host", "style").agg(F.sum("n").alias("n"), F.sum(n * F.log("n")).alias("nlogn"))
    importance = 1 - F.col("nlogn") / (n * F.log(n))  # entropy over its largest value
    # what HTML names as main text goes only if all pages say just the same there
    main = F.col("style").bitwiseAND(F.lit(1)) == 1
    low_nodes = nodes.filter((n >= least_pages) & (importance <= F.when(main, 1e-9).otherwise(low)))
    low_nodes = low_nodes.select("host", F.col("style").alias("branch"))
    # elsewhere a text that most pages show is template, even in a node that matters
    repeated = texts.filter(~main & (n >= least_pages * common)).join(n_pages, "host").filter(n >= common * F.col("pages"))
    return low_nodes.unionByName(repeated.select("host", F.col("place").alias("branch")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least_pages: int = LEAST_PAGES, low: float = LOW_IMPORTANCE, common: float = COMMON_SHARE,
            most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``(id, url, text, n_chars)``, one row for each row of ``pages``.

    Null and empty pages, and pages without main text, have an empty text. Pages
    whose url has no host are not held against others. Unclosed and misnested
    elements end where HTML ends them; a comment or script that never ends goes
    to the end of the page. Repeated rows have equal texts; an empty table gives
    none.
    """
    branches = cut_lineage(
        site_branches(pages, html_col, url_col, least_pages, low, common)
        .groupBy("host").agg(F.collect_set("branch").alias("removed"))
    )
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        url_host(F.col(url_col)).alias("host"),
    )
    kinds = dict(rows.dtypes)
    size = branches.agg(F.sum(F.size("removed"))).first()[0] or 0
    if size:
        side = F.broadcast(branches) if size <= most_broadcast else branches
        rows = rows.join(side, "host", "left").select("id", "url", "html", "removed")
    else:
        rows = rows.select("id", "url", "html", F.lit(None).cast("array<bigint>").alias("removed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            texts = []
            for page, removed in zip(batch.column(2), batch.column(3)):
                key = tuple(removed.as_py() or ())
                if key not in sets:
                    if len(sets) > 1000:
                        sets.clear()
                    sets[key] = frozenset(key)
                texts.append(main_text(page.as_py(), sets[key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())],
                names=[id_col, url_col, "text", "n_chars"],
            )

    return rows.mapInArrow(
        run, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars long"
    )
