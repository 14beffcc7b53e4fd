"""Main text of pages by nearest-URL differencing.

Pages are put in the order of (host, URL path); the pages just before and after
on the same host are a page's nearest ones.  The text lines (blocks) of the two
are aligned by longest common subsequence, and a line that a neighbour shares
is site furniture and goes, unless it stands in the article element: an article
may be published at two addresses.  Of the other lines those of menus, headers,
footers, sidebars, notices, adverts, forms and reader comments go by their
element, role or class, since such furniture can differ from page to page.
Where a page has an article (or main) element, its lines are the text.

Order and neighbours do not depend on how Spark deals the rows: exact ranks
of the (key, page_id) pairs give at most ``MOST_RANGES`` range bounds
(broadcast) and the pages move once. A range also gets the page just before and
the one just after it, to compare with only.

Defined results: null or empty html has an empty text; null urls have no
neighbour; very long pages are read whole; repeated rows are neighbours of each
other; page ids may be null and of any type (their order is that of their text if
they are no numbers); an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satspan.llm.common import global_rank
from satspan.llm.lcs import lcs_pairs

RANGE_PAGES = 256
MOST_RANGES = 100_000

#: Names of elements.
_RAW = "script|style|textarea|title|template|noscript|iframe|svg|math|select|object"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot"
    " th thead tr ul".split()
)
_CHROME = frozenset("nav footer aside form menu dialog button head label".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAMES = re.compile(
    r"^(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice|notification|alert|popup|modal"
    r"|overlay|comment\w*|disqus\w*|replies|reply|respond|sidebar|sidebars|aside|menu|menus|nav|navbar|navigation|breadcrumb\w*|footer"
    r"|header|masthead|topbar|toolbar|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|widget\w*"
    r"|pagination|pager)$"
)
_CLOSES_P = _BLOCKS - {"body", "html", "head"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    rf"|<(?P<raw>{_RAW})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|$)"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)",
    re.DOTALL | re.IGNORECASE,
)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    zone: str  # "article", "chrome" or "plain"


def _is_chrome(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in _CHROME or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style":
            if "display:none" in value.replace(" ", ""):
                return True
        elif name == "role":
            if value in _ROLES:
                return True
        elif tag not in ("article", "main") or "comment" in value:
            if any(_NAMES.match(x) for x in re.split(r"[\s_-]+", value)):
                return True
    return False


def lines_of(page: str) -> list[Line]:
    """The visible blocks of a page in order, each with its zone."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, chrome, article
    chrome = article = False

    def flush() -> None:
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append(Line(text, "chrome" if chrome else "article" if article else "plain"))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["cdata"]:
                parts.append(html.escape(m["cdata"]))
            continue
        tag = tag.lower()
        if tag in _BLOCKS:
            flush()
        elif tag == "br":
            parts.append(" ")
        if tag in _VOID:
            continue
        if not m["end"]:
            if tag in _CLOSES_P and stack and stack[-1][0] == "p":
                stack.pop()
            elif tag == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            if tag not in _BLOCKS and tag not in _CHROME and not m["attrs"].strip():
                continue  # plain inline elements change nothing
            before = stack[-1][1:] if stack else (False, False)
            inside = before[1] or tag in ("article", "main")
            stack.append((tag, before[0] or _is_chrome(tag, m["attrs"], before[1]), inside))
        else:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "nav", "footer", "aside", "form") and tag in ("p", "b", "i", "span", "a", "li", "em", "strong"):
                    break  # a stray end tag closes nothing outside its section
        now = stack[-1][1:] if stack else (False, False)
        if now != (chrome, article):
            flush()
            chrome, article = now
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def main_text(lines: list[Line], near: list[list[Line]]) -> tuple[str, int]:
    """The text of a page, and how many of its lines its neighbours share."""
    shared: set[int] = set()
    for other in near:
        shared.update(i for i, _ in lcs_pairs([x.text for x in lines], [x.text for x in other]))
    has_article = any(x.zone == "article" for x in lines)
    kept = [
        x.text
        for i, x in enumerate(lines)
        if x.zone == "article" or (not has_article and x.zone == "plain" and i not in shared)
    ]
    return "\n".join(kept), len(shared)


def url_key(url: Column) -> Column:
    """Host and path as one sort key (empty for a null url)."""
    bare = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/]*", 0))
    return F.when(host == "", F.lit("")).otherwise(F.concat(host, F.lit("\u0001"), F.regexp_extract(bare, r"/.*$", 0)))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages in order; each waits until the next one is known. Those with an odd
    ``dealt`` are there for their neighbours."""
    before = now = None

    def row(before, now, after):
        near = [x[3] for x in (before, after) if x and now[1] and x[0] == now[0] and x[1] == now[1]]
        text, n = main_text(now[3], near)
        return (*now[2], text, len(text), n)

    schema = None
    for batch in batches:
        schema = schema or pa.schema([
            ("page_id", batch.schema.field("page_id").type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_shared_lines", pa.int64()),
        ])
        cols = [batch.column(batch.schema.get_field_index(c)) for c in ("dealt", "key", "page_id", "url", "html")]
        rows, size = [], 0
        for i in range(batch.num_rows):
            r, key, page_id, url, page = (c[i].as_py() for c in cols)
            after = (r // 2, key.split("\u0001")[0], (page_id, url), lines_of(page or ""), r % 2)
            if now and not now[4]:
                rows.append(row(before, now, after))
                size += rows[-1][3]
            before, now = now, after
            if size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    if now and not now[4]:
        last = [row(before, now, None)]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*last), schema)], schema=schema)


def dealt_out(pages: DataFrame) -> DataFrame:
    """The pages with their range, in order within it, and those to compare with."""
    number = dict(pages.dtypes)["page_id"] in ("tinyint", "smallint", "int", "bigint")
    # Where a null id stands in the order.
    own = F.coalesce(F.col("page_id").cast("long"), F.lit(-(1 << 63))) if number else F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    keys = global_rank(pages.select(url_key(F.col("url")).alias("key"), own.alias("id")).distinct(), ["key", "id"], "html-keys")
    n = keys.agg(F.max("n_rows")).first()[0] or 0
    every = max(RANGE_PAGES, -(-n // MOST_RANGES))
    # The first pages of MOST_RANGES ranges at most, and the last ones before them.
    ends = keys.where(((F.col("rank") % every == 0) & (F.col("rank") > 0)) | (F.col("rank") % every == every - 1))
    firsts, lasts = [], []
    for r in ends.select("key", "id", "rank").orderBy("rank").collect():
        if r["rank"] % every == 0 and r["rank"]:
            firsts.append((r["key"], r["id"]))
        if r["rank"] % every == every - 1:
            lasts.append((r["key"], r["id"]))
    shared = pages.sparkSession.sparkContext.broadcast((firsts, set(firsts), set(lasts[: len(firsts)])))

    @F.pandas_udf("array<int>")
    def dealt_to(key: pd.Series, page_id: pd.Series) -> pd.Series:
        """Twice the range, and twice a neighbouring range and one."""
        firsts, first, last = shared.value

        def of(page: tuple[str, int]) -> list[int]:
            k = bisect_right(firsts, page)
            return [2 * k, *([2 * k - 1] if page in first else []), *([2 * k + 3] if page in last else [])]

        return pd.Series([of(page) for page in zip(key, page_id)])

    return (
        pages.select("page_id", "url", "html", url_key(F.col("url")).alias("key"))
        .withColumn("dealt", F.explode(dealt_to("key", own)))
        .withColumn("range", F.floor(F.col("dealt") / 2))
        .repartition("range")
        .sortWithinPartitions("range", "key", own)
    )


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and n_shared_lines of every page."""
    return dealt_out(pages).mapInArrow(
        _extracted, f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long, n_shared_lines long"
    )
