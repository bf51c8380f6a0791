"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. Pass one decides each block by
itself: by its link density, its length and the density of stop words. Elements
and class words that name what surrounds articles make a block bad; an article
or main element around it only lowers the thresholds. Short blocks and those of
middling density stay undecided, and so do those of few stop words and no links.
In pass two they take the label of the nearest decided blocks: where the
neighbours on both sides agree, theirs; where they don't, the nearer one's, but
inside an article or main element the good one's. A neighbour is the nearer, the
deeper the element that holds both, and then the fewer blocks stand between;
a block without stop words only follows one of its own element.
Where pass one finds nothing good, what is undecided inside an article or main
element is, and without such an element, what is undecided if it is not very little.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Stop words of English, French, German and Spanish, elements by role, and class and id words of what surrounds articles.
STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could do for from had has have he her his if in into is it its
    more no not of on one or other our out she so some than that the their them then there these they this to up was we were
    what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et eux il ils je la le les leur lui mais même ne nous on ou par
    pas plus pour qu que qui sa sans se ses son sont sur tout un une vous été être
    aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich
    im ist kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wird
    wir zu zum zur
    al como con de del el ella en entre era es esta este fue ha han hay la las lo los más me mi muy no nos o para pero por que
    se sin sobre su sus también un una uno unos y ya
    """.split()
)
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset
    figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li link main menu meta
    nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul
    """.split()
)
VOID_TAGS = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("iframe math noembed noframes noscript object script style svg template textarea title xmp".split())
OUTSIDE_TAGS = frozenset("aside button dialog fieldset footer form head label menu nav option search select".split())
OUTSIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
OUTSIDE_WORDS = frozenset(
    """
    ad ads adsense advert advertisement advertising adverts alert banner breadcrumb breadcrumbs captcha comment commentary
    comments consent cookie cookies copyright disclaimer discussion disqus dropdown footer gdpr login masthead menu modal
    nav navbar navigation newsletter notice notification overlay pager pagination paywall popup promo promotion
    recommended related replies reply respond responses search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription toolbar topbar widget widgets
    """.split()
)
MAIN_TAGS = frozenset(["article", "main"])

#: Blocks of fewer characters are short; a block of a stop-word density is good from HIGH on, bad below LOW if it has links, odd below NONE.
SHORT, LONG, NONE, LOW, HIGH, LINKED = 70, 200, 0.03, 0.12, 0.22, 0.35
#: Inside an article or main element: what is short, what is good, and the links of a block of fewer stop words that make it bad.
MAIN_SHORT, MAIN_HIGH, MAIN_LINKED = 30, 0.12, 0.1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>\"']*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>", re.S)
_ATTR = re.compile(r"([a-zA-Z:_-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[^\W\d_]+")
GOOD, BAD, OPEN, NEAR, ODD = 1, 0, -1, -2, -3


@dataclass
class Block:
    text: str
    linked: int
    outside: bool
    main: bool
    heading: bool
    #: How many elements hold it, and how many of them the block before it too.
    depth: int = 0
    shared: int = 0

    def decided(self) -> int:
        """Pass one; NEAR is undecided inside an article or main element, ODD without stop words and links outside one."""
        size = len(self.text)
        if self.outside or self.linked > LINKED * size:
            return BAD
        if self.heading or size < (MAIN_SHORT if self.main else SHORT):
            return NEAR if self.main else OPEN
        words = _WORD.findall(self.text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if self.main:
            return GOOD if density >= MAIN_HIGH else BAD if self.linked > MAIN_LINKED * size else NEAR
        if density >= HIGH:
            return GOOD
        if density < LOW:
            return BAD if self.linked else ODD if density < NONE else OPEN
        return GOOD if size >= LONG else OPEN


def _outside(tag: str, attrs: str, in_main: bool) -> bool:
    """Whether an element holds what surrounds an article."""
    if tag in OUTSIDE_TAGS or (tag == "header" and not in_main):
        return True
    if "=" not in attrs and "hidden" not in attrs:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attrs)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        return True
    if found.get("role", "").lower() in OUTSIDE_ROLES:
        return True
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower()))
    return bool(words & OUTSIDE_WORDS) or (not in_main and "header" in words)


def blocks(page: str) -> list[Block]:
    """The blocks of a page, in order, with what pass one looks at.

    Two blocks share the elements that stay open from one to the other, so the least number of open elements on
    the way tells how many; no block holds a list of them.
    """
    out: list[Block] = []
    text: list[str] = []
    state = {"linked": 0, "heading": False, "least": 1}
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    closed = {t.lower() for t in re.findall(r"</([a-zA-Z]+)", page)}
    links = 0

    def flush() -> None:
        whole = " ".join(html.unescape("".join(text)).split())
        if whole:
            _, outside, main = stack[-1]
            out.append(Block(whole, state["linked"], outside, main, state["heading"], len(stack), state["least"]))
            state["least"] = len(stack)
        text.clear()
        state["linked"] = 0

    def push(tag: str, outside: bool, main: bool) -> None:
        stack.append((tag, outside, main))
        opened[tag] += 1

    def add(piece: str) -> None:
        if piece:
            text.append(piece)
            if links:
                state["linked"] += len(piece.strip())

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            add(html.escape(m["cdata"]))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                flush()
                if tag[0] == "h" and tag[1:].isdigit():
                    state["heading"] = False
            if opened[tag]:
                flush()
                while opened[tag] and stack[-1][0] != tag:
                    opened[stack.pop()[0]] -= 1
                opened[stack.pop()[0]] -= 1
                state["least"] = min(state["least"], len(stack))
            continue
        if tag in RAW_TAGS:
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            if not end:
                unclosed.add(tag)
            at = end.end() if end else len(page) if tag in ("script", "style") else at
            continue
        if tag == "a":
            links += 1
        if tag in BLOCK_TAGS:
            flush()
            if tag[0] == "h" and tag[1:].isdigit():
                state["heading"] = True
        if tag in VOID_TAGS or m["attrs"].rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        _, outside, main = stack[-1]
        if tag in MAIN_TAGS and not any(opened[t] for t in OUTSIDE_TAGS):
            # a wrapper's class can name what stands beside the article in it
            flush()
            push(tag, _outside(tag, m["attrs"], True), True)
        elif tag in closed and _outside(tag, m["attrs"], main):
            flush()
            push(tag, True, main)
        elif tag in closed and tag not in ("p", "a", "b", "i", "br"):
            push(tag, outside, main)
    add(page[at:])
    flush()
    return out


def extract(page: str) -> str:
    """The main text of one page."""
    found = blocks(page)
    labels = [b.decided() for b in found]
    if GOOD not in labels:
        # an article of nothing but short or odd blocks
        left_open = (NEAR,) if NEAR in labels else (OPEN, ODD)
        if NEAR in labels or sum(len(b.text) for b, x in zip(found, labels, strict=True) if x in left_open) >= MAIN_SHORT:
            labels = [GOOD if x in left_open else x for x in labels]
    # label and place of the nearest decided block, and how many elements it shares with this one
    before: list[tuple[int, int, int]] = []
    last = (BAD, -1, -1)
    for i, label in enumerate(labels):
        last = (last[0], last[1], min(last[2], found[i].shared))
        before.append(last)
        last = (label, i, found[i].depth) if label in (GOOD, BAD) else last
    last = (BAD, len(labels), -1)
    kept = []
    for i in range(len(labels) - 1, -1, -1):
        left, right = before[i], last
        if labels[i] == NEAR:
            good = GOOD in (left[0], right[0])
        elif labels[i] in (OPEN, ODD):
            # a heading belongs to what follows it
            shared, _, label = min((-common, 0 if found[i].heading and k > i else abs(k - i), label) for label, k, common in (left, right))
            good = label == GOOD and (labels[i] == OPEN or -shared == found[i].depth)
        else:
            good = labels[i] == GOOD
            last = (labels[i], i, found[i].depth)
        last = (last[0], last[1], min(last[2], found[i].shared))
        if good:
            kept.append(found[i].text)
    return " ".join(reversed(kept))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of each row of pages.

    Character references are decoded, white space inside a block becomes one
    space, blocks are joined by one space; n_chars counts code points. Null,
    empty and textless pages give the empty string. Repeated rows give repeated
    results; null ids and urls stay null; an empty table gives an empty one;
    other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts = [extract(p) if p else "" for p in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
