"""Main text of web pages by line-block distribution.

Markup is stripped into lines (block elements), and each line gets a length. Lines of an
article element have their text's length and SURGE more; where a page has such an element
with text, lines outside of it have none. Without one a line has its text's length, or none
where most of it is links. Lengths are summed over sliding windows of WINDOW lines. Text begins
at a surge, where a window reaches SURGE, and ends at the dive that follows, where a window is
empty. Short lines after a text thus belong to it; those before the surge do too, as far back
as each stands in the same container as its neighbour, or one's container holds the other's. A
page whose windows never surge is short, and keeps every line with a length.

Furniture has no length: elements that HTML keeps for navigation, forms, scripts and what
stands beside a text, and adverts and readers' comments by their class, id or role. Other
class words only lower lengths: halved where a word such as ``related`` is part of a longer
name, and none where a whole name says that the element is a menu, banner or the like; should
less than SURGE characters be left so, these lines have half their length as well. So a page
keeps its text whatever its wrappers are called.

Defined results: a null or empty page has the empty text and length 0; repeated rows are
each extracted; texts of any length are read whole, in linear time; unclosed tags, comments and
cut-off pages end at the end of the page; extra columns pass through unless they are named
``text`` or ``n_chars``, or as the html is, which goes. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded_batches, lean, read

#: Lines in a window.
WINDOW = 3
#: Window sum that starts a region, and what an article's lines count beyond their text.
SURGE = 86

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("nav header footer aside form button select dialog menu head title template".split())
OPAQUE = frozenset("script style noscript template iframe object svg math canvas textarea".split())
#: Of these, only elements of other vocabularies can be closed by their own tag.
FOREIGN = frozenset("svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
MAIN = frozenset("article main".split())
#: Elements that begin where the one before ends, and what ends them besides.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr option".split())
ENDS = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}

# Words of class names, ids and roles.
#: What is never part of an article.
NEVER = frozenset("ad ads adsbygoogle advert adverts advertisement advertisements advertising sponsor sponsors sponsored cookie cookies consent newsletter subscribe popup modal comment comments respond reply replies disqus login".split())
#: What furniture is called, and articles sometimes too.
LAYOUT = frozenset("banner sidebar widget nav navbar navigation menu breadcrumb breadcrumbs header footer notice alert promo promos promotion related recommended share sharing social search pagination pager toolbar complementary contentinfo dialog".split())
#: Words that say no more about what an element holds.
PLAIN = frozenset(
    "site page top bottom left right upper lower side inner outer box block list area container wrapper wrap section slot item items unit bar body content text title "
    "link links button icon form thread view panel card group holder zone region row col column primary secondary global mobile desktop sticky fixed bg the main "
    "post posts article articles entry story user reader blog".split()
)
ARTICLE = frozenset("post article entry story content main text body".split())
MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
TOKEN = re.compile(
    r"""(<!--(?:>|->|.*?(?:-->|$)|.*)|<(?:[!?]|/(?![A-Za-z]))[^>]*(?:>|$))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(>|$)|([^<]+|<(?![A-Za-z/!?]))""",
    re.S,
)
#: The same groups for a tag with an unbalanced quote.
LOOSE = re.compile(r"()<(/?)([A-Za-z][^\s/>]*)([^>]*)(>|$)(?:(?!)())?", re.S)


@lru_cache(maxsize=4096)
def mark(names: str) -> int:
    """What names of an element say: 0 nothing, 1 something, 2 that it is furniture, 3 that it is no text for certain."""
    most, article = 0, False
    for name in names.lower().split():
        words = [w for w in re.split(r"[-_:]+", name) if w]
        if "side" in words and "bar" in words:
            words.append("sidebar")
        never, layout = any(w in NEVER for w in words), any(w in LAYOUT for w in words)
        article |= len(words) == 1 and words[0] in ARTICLE
        if not never and not layout:
            continue
        rest = [w for w in words if w not in NEVER and w not in LAYOUT]
        own_header = "header" in words and any(w in ARTICLE for w in rest) and not never
        whole = all(w in PLAIN or w.isdigit() for w in rest) and not own_header
        most = max(most, (3 if never else 2) if whole else 1)
    return 1 if most == 2 and article else most


@dataclass(frozen=True, slots=True)
class Line:
    """A line of text, how many of its characters are links, and where it stands."""

    text: str
    linked: int
    furniture: bool
    mark: int
    inside: bool  # of an article
    box: int  # the innermost container


@dataclass(slots=True)
class _Open:
    name: str
    furniture: bool
    mark: int
    main: bool
    mute: bool
    box: int


def lines(page: str) -> tuple[list[Line], list[int]]:
    """The lines of a page that hold text, in order, and the container that holds each container."""
    out: list[Line] = []
    stack: list[_Open] = []  # paragraphs only where they are marked
    open_: Counter[str] = Counter()  # their names
    marks = [0, 0, 0, 0]  # how many open elements have each mark
    boxes = [-1]
    parts: list[str] = []
    linked = bad = inside = anchors = muted = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Line(text, linked, bad > 0, 3 if marks[3] else 2 if marks[2] else 1 if marks[1] else 0, inside > 0, stack[-1].box if stack else 0))
        linked = 0

    def close() -> str:
        nonlocal bad, inside, muted
        x = stack.pop()
        open_[x.name] -= 1
        bad -= x.furniture
        marks[x.mark] -= 1
        inside -= x.main
        muted -= x.mute
        return x.name

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        if m is None:  # a quote that never closes: the tag ends at the next >
            m = LOOSE.match(page, at)
        at = m.end()
        if m[6] is not None:
            if not muted:
                parts.append(m[6])
                if anchors:
                    linked += len(entities.unescape(m[6]).strip())
            continue
        if not m[3]:
            continue
        name = m[3].lower()
        if name == "a":
            anchors = 0 if m[2] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if m[2]:
            if name in BLOCKS:
                flush()
                anchors = 0
            if name in PARAGRAPHS:
                if stack and stack[-1].name == name:
                    close()
            elif open_[name]:
                while close() != name:
                    pass
            continue
        if name in OPAQUE and not (name in FOREIGN and m[4].endswith("/")):
            shut = re.compile(rf"</{name}\s*[^>]*(?:>|$)", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        block = name in BLOCKS
        if block:
            flush()
            anchors = 0
            while stack and stack[-1].name in PARAGRAPHS and (name in ENDS.get(stack[-1].name, BLOCKS)):
                close()
        if name in VOID or m[4].endswith("/"):
            continue
        names = " ".join(x.strip("\"'") for x in MARKED.findall(m[4])) if m[4] else ""
        said = mark(names) if names and name not in ("body", "html") else 0
        main = name in MAIN and said < 3
        if main:
            said = 0
        hidden = bool(m[4] and HIDDEN.search(m[4]))
        # A header inside an article holds its heading; other furniture stays furniture there.
        furniture = name in FURNITURE and not (name == "header" and inside) or hidden
        if name in PARAGRAPHS and not (said or furniture):
            continue
        box = stack[-1].box if stack else 0
        if block and name not in PARAGRAPHS and name not in ("html", "body"):
            boxes.append(box)
            box = len(boxes) - 1
        # Furniture within a line is left out of it.
        mute = not block and (furniture or said == 3)
        stack.append(_Open(name, furniture and block, said if block else 0, main, mute, box))
        open_[name] += 1
        bad += furniture and block
        marks[said if block else 0] += 1
        inside += main
        muted += mute
    flush()
    return out, boxes


def lengths(found: list[Line], layout: bool = False) -> list[int]:
    """What each line counts in the distribution, and -1 for lines that are no text.

    With ``layout`` lines whose element has the name of furniture count as those do that only
    have such a word in theirs.
    """
    article = any(x.inside and not x.furniture and x.mark < 3 for x in found)
    out = []
    for x in found:
        if x.furniture or x.mark == 3 or x.mark == 2 and not layout or article and not x.inside:
            out.append(-1)
            continue
        links = 2 * x.linked > len(x.text)
        if links and not article:
            out.append(-1)
        else:
            own = max(0, len(x.text) - x.linked) if links else len(x.text)
            out.append((own // 2 if x.mark else own) + (SURGE if article else 0) or 1)
    return out


def regions(size: list[int], found: list[Line], boxes: list[int]) -> tuple[list[tuple[int, int]], bool]:
    """From each surge of the window sums, and what leads up to it, to the dive after it: first
    line, and the one after the last; and whether there was a surge."""
    def holds(a: int, b: int) -> bool:
        """Whether a container (not the page) is or holds another."""
        while b > a > 0:  # containers are numbered from outside in
            b = boxes[b]
        return a == b

    def touch(k: int, j: int) -> bool:
        return size[k] > 0 and (holds(found[k].box, found[j].box) or holds(found[j].box, found[k].box))

    sums = [sum(max(0, x) for x in size[i : i + WINDOW]) for i in range(len(size))]
    out: list[tuple[int, int]] = []
    i = done = 0
    while i < len(size):
        if size[i] > 0 and sums[i] >= SURGE:
            j = i
            while j < len(size) and sums[j]:
                j += 1
            while i > done and touch(i - 1, i):
                i -= 1
            out.append((i, j))
            i = done = j
        else:
            i += 1
    # A short page that never surges: all it has is its text.
    return (out, True) if out else ([(0, len(size))], False)


def main_text(page: str | None) -> str:
    """Text between surge and dive points of ``page``, lines joined by a blank line."""
    if not page:
        return ""
    found, boxes = lines(page)

    def kept(layout: bool) -> tuple[list[str], bool]:
        size = lengths(found, layout)
        spans, surged = regions(size, found, boxes)
        return [found[k].text for i, j in spans for k in range(i, j) if size[k] >= 0], surged

    texts, _ = kept(False)
    if sum(map(len, texts)) < SURGE and any(x.mark == 2 for x in found):
        more, surged = kept(True)
        if surged and sum(map(len, more)) >= SURGE or not texts:
            texts = more
    return "\n\n".join(texts)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` instead of the html."""

    bounded_batches(pages.sparkSession)

    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: main_text(x if isinstance(x, str) else None))

    out = pages.withColumn("text", F.pandas_udf(lean(text_of), "string")(F.col(html)))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop(html)


def op1_html_extract(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
