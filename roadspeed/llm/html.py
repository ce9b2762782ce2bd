"""Main text of web pages by removal of site templates.

Each page is parsed into a tree. Every element subtree that holds text is hashed; Spark counts, for each host and for each
section of a host (the first step of the path), on how many pages of different text each hash occurs. Subtrees that recur on
many pages are the site's template and are deleted. Elements that are never article text (scripts, menus, forms and so on,
by tag, role or class) go as well, for pages and hosts that are too few to count.

Counting is keyed by host and hash, so a host with a third of all pages is summed in parts before it is shuffled. What a
host's pages are joined with is its list of template hashes, each of which is on a fixed share of its pages or more, so the
list is at most 1 / share times as long as a page has subtrees. Pages are parsed again to delete them: cheaper than to store
or to shuffle the trees.

Defined cases: null or empty html, and pages of nothing but boilerplate, give an empty text; a page without a host belongs
to the host ""; pages of equal text count once, so copies of an article do not make it a template; inside an article or main
element a template needs half of the pages, since passages may recur there; tags left open end with their parent; repeated
rows are returned as often as they occur. If a page has article or main elements, only text inside them counts, but for
teasers: they hold less than a third of what is left, and the rest is long enough for a story. Other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Article and main elements are teasers if they hold less than this part of what is left of a page, and the rest has STORY characters.
MAIN_SHARE, STORY = 1 / 3, 200
#: Most template hashes that are broadcast; beyond them the pages are joined by host.
BROADCAST_HASHES = 2_000_000

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea title select noframes xmp".split())
DROPPED = RAW | frozenset("head nav footer aside form button dialog menu label fieldset".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# A class or id is cut into words. It names boilerplate if its last word does, after general words for boxes.
_BOILERPLATE_WORD = re.compile(
    r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|banner|notices?|popup|modal|overlay|newsletter|subscribe\w*|sidebar|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|header|masthead|comments?|disqus|reply|replies|share|sharing|social|related|recommend\w*|widgets?|login|signup|toolbar|pagination|pager|skiplink)\Z", re.I,
)
_BOXES = frozenset("area bar block body box button buttons container content form group inner item items link links list outer panel post posts section side slot text thread unit wrap wrapper".split())
_STATES = frozenset("has is hide no show with without".split())  # "has-sidebar" speaks of something else on the page
_COMMENTS = frozenset(("comment", "comments"))
# Inside an article these name its own parts (the head of a story, a restaurant's menu) unless another word tells of boilerplate ("cookie-notice").
_OUTSIDE = frozenset("banner header masthead menu notice notices".split())
_ARTICLE_WORDS = frozenset("article blog card chapter content entry post section story table title".split())
_WORDS_OF_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: What an opening tag ends: (its name, names that it ends, names that it does not look past).
_ITEMS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_ENDS_P = BLOCKS - {"html", "body", "tr", "td", "th", "tbody", "thead", "tfoot", "caption"}
_SCOPE = frozenset("table td th caption article main section aside nav header footer form div blockquote li body html".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'<]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_HOST = r"(?i)^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?/?([^/?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1))


def section_of(url: Column) -> Column:
    """The first step of the path."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 2)


class _Element:
    __slots__ = ("name", "drop", "main", "order", "named", "parts", "digest", "parent", "holds", "gone")

    def __init__(self, name: str, parent: _Element | None, drop: bool, main: bool, order: int = 0, named: bool = False):
        self.name, self.parent, self.drop, self.main, self.order, self.named = name, parent, drop, main, order, named
        self.parts: list[str] = []
        self.digest = 0
        self.holds = self.gone = False  # whether there is text in it; whether a template holds it


def _last_words(own: str) -> Iterator[list[str]]:
    """Words of each class and id up to the one that counts: general words for boxes do not."""
    for name in own.split():
        words = [w.lower() for w in _WORDS_OF_NAME.findall(name)]
        while words and (words[-1] in _BOXES or words[-1].isdigit()):
            words.pop()
        if words and _STATES.isdisjoint(words):
            yield words


def _names_boilerplate(own: str, inside: bool) -> bool:
    """Whether a class list or id names boilerplate."""
    for words in _last_words(own):
        if not _BOILERPLATE_WORD.match(words[-1]):
            continue
        if inside and words[-1] in _OUTSIDE and not any(map(_BOILERPLATE_WORD.match, words[:-1])):
            continue
        if words[-1] != "header" or inside or _ARTICLE_WORDS.isdisjoint(words):
            return True
    return False


def _boilerplate(name: str, attributes: str, parent: _Element, titled: bool) -> str:
    """Why an element is boilerplate: by what it is ("kind") or by its names ("name"), else "". ``titled``: it holds the page's only h1."""
    if name in DROPPED or name == "header" and not parent.main:
        return "kind"
    if not attributes or name in ("html", "body"):
        return ""
    found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN_STYLE.search(found.get("style", "")):
        return "kind"
    if found.get("role", "").lower() in DROPPED_ROLES:
        return "kind"
    own = f"{found.get('class', '')} {found.get('id', '')}"
    outermost = name in MAIN and not parent.main
    if titled and (outermost or parent.main):
        return ""
    if outermost:  # it keeps names such as "related", and "has-comments"; a comment is no article
        return "name" if any(words[-1] in _COMMENTS for words in _last_words(own)) else ""
    return "name" if _names_boilerplate(own, parent.main) else ""


def parse(html: str, titled: frozenset[int] = frozenset()) -> tuple[list[tuple[str, _Element]], list[_Element]]:
    """Blocks that are no boilerplate, in page order, with their elements; all elements that hold text, inner ones first.

    ``titled``: elements, by the order of their tags, that hold the only h1. Names do not make these boilerplate inside an article; a page where they
    did is parsed again.
    """
    order, titles, around = 0, 0, []
    root = _Element("", None, False, False)
    stack = [root]
    blocks: list[tuple[str, _Element]] = []
    elements: list[_Element] = []
    held: list[str] = []
    owner = root

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                blocks.append((text, owner))
            held.clear()

    def close(to: int) -> None:
        """Pop the stack down to a length of ``to``."""
        while len(stack) > to:
            e = stack.pop()
            if e.name in BLOCKS:
                flush()
            e.digest = xxhash.xxh64_intdigest("\x00".join([e.name, *e.parts]))
            stack[-1].parts.append(f"<{e.digest:x}")
            if e.holds:
                stack[-1].holds = True
                if e.name not in ("html", "body"):
                    elements.append(e)

    def find(names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in names:
                return i
            if stack[i].name in stop:
                return 0
        return 0

    def text(raw: str) -> None:
        nonlocal owner
        if not raw:
            return
        top = stack[-1]
        clean = unescape(raw) if "&" in raw else raw
        blank = clean.isspace()
        if not blank or not top.drop and not held:
            base = next((e for e in reversed(stack) if e.name in BLOCKS), root)
            base.holds |= not blank
            if base is not owner and not top.drop:
                flush()
                owner = base
        if not top.drop:
            held.append(clean)
        if not blank:
            top.parts.append(" ".join(clean.split()))

    at, n = 0, len(html)
    while at < n:
        m = _TAG.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name == "br" or name == "p" and not find({"p"}, _SCOPE):
                flush() if name == "p" else text(" ")
            elif i := find({name}, frozenset() if name in BLOCKS or name in RAW else BLOCKS):
                close(i)
            continue
        attributes = m[3] if m[2] else m[6]
        if name in VOID:
            if name == "br":
                text(" ")
            elif name == "hr":
                flush()
            continue
        if name in MAIN:  # an article does not stand inside a menu that was left open
            i = min((k for k, e in enumerate(stack) if k and e.drop and e.name in ("nav", "aside", "header", "footer", "form")), default=0)
            if i and not any(e.main for e in stack[:i]):
                close(i)
        if name in _ENDS_P and (i := find({"p"}, _SCOPE)):
            close(i)
        if name in _ITEMS and (i := find(*_ITEMS[name])):
            close(i)
        parent = stack[-1]
        if name in BLOCKS:
            flush()
        order += 1
        why = "" if parent.drop else _boilerplate(name, attributes, parent, order in titled)
        drop = parent.drop or bool(why)
        stack.append(_Element(name, parent, drop, parent.main or name in MAIN and not drop, order, why == "name" and (parent.main or name in MAIN)))
        if name == "h1":
            titles += 1
            around = [e.order for e in stack] if any(e.named for e in stack) else []
        if attributes.endswith("/") and name in ("svg", "math", "path"):
            close(len(stack) - 1)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else n
    close(1)
    flush()
    return parse(html, frozenset(around)) if titles == 1 and around and not titled else (blocks, elements)


def _key(e: _Element) -> int:
    """The hash that is counted, as a signed long: that of the subtree; its last bit says whether it is inside an article."""
    h = e.digest & ~1 | e.main
    return h - (1 << 64) if h >> 63 else h


def main_text(html: str, templates: set[int]) -> tuple[str, int]:
    """Text of a page without the subtrees in ``templates``, and the number of the outermost ones that went."""
    blocks, elements = parse(html)
    n = 0
    if templates:
        for e in reversed(elements):  # a parent comes before its children
            above = e.parent is not None and e.parent.gone
            e.gone = above or _key(e) in templates
            n += e.gone and not above
    left = [(t, e.main) for t, e in blocks if not e.gone]
    inside, outside = (sum(len(t) for t, main in left if main is side) for side in (True, False))
    only = inside and (outside < STORY or inside >= MAIN_SHARE * (inside + outside))
    return "\n\n".join(t for t, main in left if main or not only), n


_SCHEMA = "host string, section string, text_hash long, hashes array<long>"


def subtrees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, section, text_hash (of the page's text), hashes of the different subtrees, for each page row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hashes = [], []
            for html in batch.column(2):
                blocks, elements = parse(html.as_py() or "")
                texts.append(xxhash.xxh64_intdigest("\n\n".join(t for t, _ in blocks)) - (1 << 63))
                hashes.append(list({_key(e) for e in elements}))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SCHEMA.split(", ")])

    return pages.select(host_of(F.col(url_col)).alias("_h"), section_of(F.col(url_col)).alias("_s"), html_col).mapInArrow(run, _SCHEMA)


def templates(trees: DataFrame, min_pages: int = 10, share: float = 0.2, inside_share: float = 0.5) -> DataFrame:
    """host, hashes: the subtrees on ``min_pages`` pages or more that are on ``share`` of the pages of the host, or on ``inside_share`` of a section.

    Inside an article the share is ``inside_share`` for both. Pages of equal text count once.
    """
    pages = trees.select("host", "section", "text_hash").distinct()
    by_section = pages.groupBy("host", "section").agg(F.count("*").alias("_ps"))
    by_host = by_section.groupBy("host").agg(F.sum("_ps").alias("_ph"))
    rows = trees.select("host", "section", "text_hash", F.explode("hashes").alias("hash")).distinct()
    counts = rows.groupBy("host", "section", "hash").agg(F.count("*").alias("n"))
    often = counts.groupBy("host", "hash").agg(F.sum("n").alias("n"), F.max_by("section", F.struct("n", "section")).alias("section"), F.max("n").alias("ns"))
    often = often.filter(F.col("n") >= min_pages).join(by_host, "host").join(by_section, ["host", "section"])
    inside = F.col("hash").bitwiseAND(F.lit(1)) == 1
    of_host = F.col("n") >= F.col("_ph") * F.when(inside, inside_share).otherwise(share)
    of_section = (F.col("ns") >= min_pages) & (F.col("ns") >= F.col("_ps") * inside_share)
    return often.filter(of_host | of_section).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 10, share: float = 0.2, inside_share: float = 0.5
) -> DataFrame:
    """One row per page row: id, url, text, n_chars, n_templates (outermost subtrees that went with the site's template)."""
    trees = cut(subtrees(pages, url_col, html_col))  # read twice
    found = cut(templates(trees, min_pages, share, inside_share).withColumnRenamed("host", "_host"))
    found = F.broadcast(found) if (found.agg(F.sum(F.size("hashes") + 8)).first()[0] or 0) <= BROADCAST_HASHES else found
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    met = rows.join(found, host_of(F.col("_url")) == F.col("_host"), "left").select("_id", "_url", "_html", "hashes")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [main_text(html.as_py() or "", set(known or ())) for html, known in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            texts, counts = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], ["_id", "_url", "text", "n_templates"])

    done = met.mapInArrow(run, f"_id {kind}, _url string, text string, n_templates long")
    return done.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"), "n_templates")
