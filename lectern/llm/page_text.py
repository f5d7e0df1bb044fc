"""Main text of web pages, with site templates removed by subtree counts.

A page becomes a tree of elements; each element with text has a hash of its tag and of all that is below it. Spark
counts, for each host, with how many different articles each hash of the whole page occurs, and subtrees that recur
across many pages of their host are deleted before the article is chosen, as are elements that say what they are: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments. The rest of the article element
(of the whole body if there is none) is decoded, its white space folded, and its blocks joined by line feeds.

Prose elements of an article (paragraphs, headings, list items) stay even where they recur, since articles quote each
other; a section or div of an article that recurs as a whole goes. A name in a class or id counts on blocks alone, not on
words inside a sentence. On pages without an article element every element may be a template. Copies of one article count once, so that a syndicated or repeated article is not taken for a template. A hash needs
``MANY`` different articles and the share ``SHARE`` of the host's articles.

Defined results: null html gives an empty text; a null or unreadable url is a host of its own name ''; repeated rows
are extracted each, and rows that share a page_id by their own hosts; of articles with equally much text the one nearer to
the end of the page stays; a page of any length is read whole; markup that is cut off ends with the page; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lectern.llm.common import cut, restrict, slices

MANY, SHARE = 3, 0.05
DEALS = 16  # parts that the pages of a host are dealt over when they meet its templates

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|math|textarea|select|object|canvas|audio|video|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|([^<]+|<)",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROP = frozenset("head nav footer aside form menu dialog button fieldset header input label".split())
CLOSED_BY = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLD = frozenset("ul ol dl table td th div article section main aside body html blockquote".split())
# Words in class, id or role that name what is not the article.
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer header masthead "
    "comment comments commentlist disqus respond reply replies discussion notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations widget toolbar pagination pager skip search form complementary contentinfo".split()
)


# Elements that hold prose. Inside an article these are never taken for a template: texts quote each other.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th a abbr b cite code em i mark q s small span strong sub sup u".split())


#: Of these such as stand inside a sentence.
INLINE = PROSE - BLOCK - {"td", "th"}


class Element:
    __slots__ = ("tag", "drop", "below", "text", "hash")

    def __init__(self, tag: str, drop: bool = False):
        self.tag, self.drop, self.below, self.text, self.hash = tag, drop, [], 0, 0


def _names(attributes: str) -> bool:
    return any(not NOT_ARTICLE.isdisjoint(_SPLIT.split((a or b or c).lower())) for _, a, b, c in _NAMED.findall(attributes))


def parse(page: str) -> Element:
    """The page's tree; texts are strings among the children, not decoded yet."""
    root = Element("")
    stack = [root]

    def close() -> None:
        e = stack.pop()
        digest = hashlib.blake2b(e.tag.encode(), digest_size=8)
        for x in e.below:
            digest.update(b"<%d" % x.hash if isinstance(x, Element) else " ".join(x.split()).encode("utf-8", "replace"))
        e.hash = int.from_bytes(digest.digest(), "little", signed=True)
        stack[-1].text += e.text

    for m in _TOKEN.finditer(page):
        text = m[5]
        if text is not None:
            if text.strip():
                stack[-1].below.append(text)
                stack[-1].text += len(text)
            elif text:
                stack[-1].below.append(" ")
            continue
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        close()
                    break
                if tag not in BLOCK and stack[depth].tag in BLOCK:
                    break
            continue
        for depth in range(len(stack) - 1, 0, -1):
            if tag in CLOSED_BY.get(stack[depth].tag, ()):
                while len(stack) > depth:
                    close()
                break
            if stack[depth].tag in HOLD:
                break
        e = Element(tag, tag in DROP or bool(m[4]) and tag not in ("html", "body", "article", "main") and tag not in INLINE and _names(m[4]))
        stack[-1].below.append(e)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(e)
    while len(stack) > 1:
        close()
    return root


def article(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> Element:
    """The article element with most text, else the main one, else the page; not one within a template."""
    best = {"article": root, "main": root}
    todo = [root]
    while todo:
        e = todo.pop()
        if e.drop or e.text and e.hash in templates:
            continue
        if e.tag in best and (best[e.tag] is root or e.text > best[e.tag].text):
            best[e.tag] = e
        todo += [x for x in e.below if isinstance(x, Element)]
    return best["article"] if best["article"] is not root else best["main"]


#: Counted once for each article, so that its count is the number of the host's articles; no element's hash, but for chance.
ALL = 0


def hashes(root: Element, main: Element) -> set[int]:
    """ALL and the hashes of the page's elements with text, those that are dropped by name too; not of main and what holds
    it, and in an article not of prose.

    What holds main differs as main does, so it never recurs with different articles."""
    holds, todo = {id(main)}, [(root, ())]
    while todo:
        e, above = todo.pop()
        if e is main:
            holds.update(map(id, above))
            break
        todo += [(x, (*above, e)) for x in e.below if isinstance(x, Element) and x.text]
    out, todo = {ALL}, [(root, False)]
    while todo:
        e, inside = todo.pop()
        inside = inside or e is main and bool(main.tag)
        for x in e.below:
            if isinstance(x, Element) and x.text:
                if id(x) not in holds and not (inside and x.tag in PROSE):
                    out.add(x.hash)
                todo.append((x, inside))
    return out


def text_of(e: Element, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The text below e without dropped elements and templates, a line for each block."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if line:
            text = " ".join(entities.unescape("".join(line)).split())
            if text:
                blocks.append(text)
            line.clear()

    inside = bool(e.tag)
    todo: list = [e]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif x.tag == "br":
            line.append(" ")
        elif x is e or not (x.drop or x.text and x.hash in templates and not (inside and x.tag in PROSE)):
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo += reversed(x.below)
        elif x.tag in BLOCK:
            flush()
    flush()
    return "\n".join(blocks)


_HOST = re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


@F.pandas_udf(StringType())
def _host(url: pd.Series) -> pd.Series:
    return url.map(host_of)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        hosts, found, whole = [], [], []
        for url, page in zip(*(batch.column(c).to_pylist() for c in ("url", "html")), strict=True):
            root = parse(page or "")
            main = article(root)
            hosts.append(host_of(url))
            found.append(sorted(hashes(root, main)))
            whole.append(main.hash if main.tag else int.from_bytes(hashlib.blake2b(text_of(main).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(whole, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "whole", "hashes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "html"):
        texts = []
        for page, own in zip(batch.column("html").to_pylist(), batch.column("templates").to_pylist(), strict=True):
            root, templates = parse(page or ""), set(own or ())
            texts.append(text_of(article(root, templates), templates))
        yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def templates_of(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(host, templates): the hashes that recur on each host, at most 1 / share times those of a mean article."""
    seen = pages.select("url", "html").mapInArrow(_survey, "host string, whole long, hashes array<long>")
    # distinct articles first, so that hot hosts are spread over their hashes and copies count once
    each = seen.select("host", "whole", F.explode("hashes").alias("hash")).distinct()
    counted = cut(each.groupBy("host", "hash").agg(F.count("*").alias("n")).where((F.col("n") >= many) | (F.col("hash") == ALL)))
    size = counted.where(F.col("hash") == ALL).select("host", F.col("n").alias("articles"))
    return counted.where(F.col("hash") != ALL).join(size, "host").where(F.col("n") >= share * F.col("articles")).groupBy("host").agg(F.collect_list("hash").alias("templates"))


def main_texts(pages: DataFrame, many: int = MANY, share: float = SHARE) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of ``pages`` (page_id, url, html)."""
    pages = restrict(pages, "page_id", "url", "html")
    templates = templates_of(pages, many, share)
    dealt = templates.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    hosted = pages.withColumn("host", _host("url")).withColumn("deal", F.pmod(F.xxhash64("page_id", "url"), F.lit(DEALS)).cast("int"))
    return hosted.join(dealt, ["host", "deal"], "left").select("page_id", "url", "html", "templates").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
