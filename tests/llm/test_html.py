import random
import re
from html.parser import HTMLParser

import pytest

from quillgraph.llm.common import read
from quillgraph.llm.html_extract import extract, main_text, op1_html_extract

LONG = "This paragraph says quite a lot of things about nothing at all, and goes on for more than one hundred characters. "


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article><h1>A &amp; B</h1><p>x\n  y<br>z</p></article>", "A & B\n\nx y z"),
        ("<nav><a href='/'>home</a></nav><div class=\"ad\">buy</div><article><p>One.</p><div class='ad'>buy</div><p>Two.</p></article><footer>end</footer>", "One.\n\nTwo."),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>text</p><script>var p='</p>';</script><p>more</p><a href='/unfinis", "text\n\nmore"),
        ("<article><p title=\"5>open</p><p>two</p></article>", "open\n\ntwo"),
        ("<article><p>a < b &lt; c</p></article><section id='comments'><p>me too</p></section>", "a < b < c"),
        ("<article><p>x<!-- no --> y</p><form><label>mail</label></form><aside>also</aside></article>", "x y"),
        ("<article><p>&nbsp; &#233;&#x41; </p></article>", "éA"),
        (f"<div class=header>Top</div><div><p>{LONG}</p><p>Short.</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG.strip()}\n\nShort."),
        (f"<body><ul><li><a href=/>one</a></li></ul><p>{LONG}</p><div id='comments'><p>{LONG}</p></div></body>", LONG.strip()),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_self_closed_icons_end_at_their_tag():
    page = "<article><p>a<svg class='i'/>b<math/></p><p>c</p><svg><path/></svg><p>d<svg>x</svg></p><script src='x'/>y</script><p>e</p></article>"
    assert main_text(page) == "ab\n\nc\n\nd\n\ne"


def test_tail_after_an_interruption_is_kept():
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(4))
    page = f"<div><p>{LONG * 100}</p><ul>{links}</ul><p>{LONG}</p></div>"
    assert main_text(page) == f"{(LONG * 100).strip()}\n\n{LONG.strip()}"


def test_long_pages_take_linear_time():
    n = 200_000
    assert len(main_text("<article><p>" + "word " * n + "</p></article>")) == 5 * n - 1
    main_text("<" * n)
    main_text("<div>" * 5000 + "x")


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>é</p></article>", 7), (1, "u", "<article><p>é</p></article>", 7), (2, None, None, None)], "page_id long, url string, html string, extra int")
    assert sorted((r.page_id, r.text, r.n_chars) for r in extract(df).collect()) == [(1, "é", 1), (1, "é", 1), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0


#: What the names in the made-up pages say.
SAID = {"ad": 3, "comment": 3, "advert": 3, "sidebar": 2, "widget": 2, "related-work": 1, "post": 0, None: 0}


class Plain(HTMLParser):
    """Lines of a well-formed page by the standard parser: text, linked, furniture, mark, inside, containers."""

    PARAGRAPH = set("p li h1 h2 figcaption".split())
    BLOCK = PARAGRAPH | set("html head title body nav ul div article footer aside section".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.parts, self.out, self.n = [], [], [], 0

    def line(self):
        text = re.sub(r"\s+", " ", "".join(t for t, _ in self.parts)).strip()
        if text:
            names = [n for n, _, _ in self.stack]
            bad = any(n in ("nav", "footer", "aside", "head", "title") for n in names)
            box = [k for n, _, k in self.stack if n not in ("p", "li", "h1", "h2", "b", "a", "span", "html", "body")]
            self.out.append((text, sum(len(t.strip()) for t, link in self.parts if link), bad, max((SAID[c] for _, c, _ in self.stack), default=0), "article" in names, box))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCK:
            self.line()
        if tag == "br":
            self.parts.append((" ", False))
        elif tag != "meta":
            self.n += 1
            self.stack.append((tag, dict(attrs).get("class"), self.n))

    def handle_endtag(self, tag):
        if tag in self.BLOCK:
            self.line()
        if any(n == tag for n, _, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(n in ("script", "style") or n == "span" and c == "ad" for n, c, _ in self.stack):
            self.parts.append((data, any(n == "a" for n, _, _ in self.stack)))

    def close(self):
        super().close()
        self.line()


def slow(page):
    """The text by the method the long way, and the text of what is no furniture, whatever its lengths."""
    p = Plain()
    p.feed(page)
    p.close()
    found = p.out
    article = any(x[4] and not x[2] and x[3] < 3 for x in found)

    def sizes(layout):
        for text, linked, bad, said, inside, _ in found:
            links = 2 * linked > len(text)
            if bad or said == 3 or said == 2 and not layout or article and not inside or links and not article:
                yield -1
            else:
                own = max(0, len(text) - linked) if links else len(text)
                yield max(1, own // (2 if said else 1) + 86 * article)

    def chosen(layout):
        size = list(sizes(layout))
        window = [sum(n for n in size[i : i + 3] if n > 0) for i in range(len(size))]
        on, keep = False, []
        for i, n in enumerate(size):
            on = window[i] > 0 if on else n > 0 and window[i] >= 86
            keep.append(on)
        surged = any(keep)
        for i in reversed(range(len(size) - 1)):
            a, b = found[i][5], found[i + 1][5]
            short = min(len(a), len(b))
            related = a == b or short > 0 and a[:short] == b[:short]
            keep[i] = keep[i] or keep[i + 1] and size[i] > 0 and size[i + 1] > 0 and related
        return [x[0] for x, k, n in zip(found, keep if surged else [True] * len(size), size, strict=True) if k and n >= 0], surged

    texts, _ = chosen(False)
    if sum(map(len, texts)) < 86 and any(x[3] == 2 for x in found):
        more, surged = chosen(True)
        if not texts or surged and sum(map(len, more)) >= 86:
            texts = more
    return "\n\n".join(texts), "\n\n".join(x[0] for x in found if not x[2] and x[3] < 2 and (x[4] or not article))


def random_page(rng):
    words = "some words of a page that go on, and then &amp; stop é".split()
    some = lambda k: " ".join(rng.choice(words) for _ in range(k))
    link = lambda: f"<a href='/{rng.randint(0, 9)}'>{some(rng.randint(1, 4))}</a>"
    named = lambda: rng.choice(["", "", "", *[f' class="{c}"' for c in SAID if c]])

    def block():
        kind = rng.randrange(9)
        if kind < 3:
            return f"<p{named()}>{some(rng.choice((1, 3, 30)))}<b>{some(2)}</b><span class='ad'>{some(2)}</span><br>{some(2)}</p>"
        if kind == 3:
            return f"<p>{some(2)} {link()}</p>"
        if kind == 4:
            return "<ul>" + "".join(f"<li{named()}>{link()}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind == 5:
            return f"<div{named()}>{some(8)}</div>" * rng.randint(1, 4)
        if kind == 6:
            return f"<div{named()}>{''.join(block() for _ in range(rng.randint(0, 2)))}</div>"
        if kind == 7:
            return f"<h2>{some(2)}</h2>"
        return f"<aside>{some(20)}</aside><script>var x = '<p>';</script>"

    body = "".join(block() for _ in range(rng.randint(0, 9)))
    if rng.random() < 0.4:
        body = f"<article><h1>{some(3)}</h1>{body}</article>{block()}"
    return f"<html><head><title>{some(3)}</title></head><body><nav><ul><li>{link()}</li></ul></nav>{body}<footer>{some(9)}</footer></body></html>"


def test_windows_decide_as_in_a_slow_version():
    rng = random.Random(11)
    differ = 0
    for _ in range(1500):
        page = random_page(rng)
        want, elements = slow(page)
        assert main_text(page) == want, page
        differ += want != elements
    assert differ > 300  # lengths decide, not elements and names alone


P = "P" * 105 + "."
SIX = "".join(f"<p>short {k}.</p>" for k in range(6))
THREE = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(3))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<div class="post category-social"><p>P</p></div>', "P"),
        ('<div class="entry has-header"><h1>T</h1><p>P</p></div>', "T P"),
        ('<div class="widget"><h1>T</h1><p>P</p></div>', "T P"),
        ('<article><h1>T</h1><div class="social"><p>P</p></div></article>', "T P"),
        ('<div class="entry-header"><h1>T</h1></div><div class="content"><p>P</p></div>', "T P"),
        ('<article><section id="related-work"><h2>Related</h2><p>P</p></section></article>', "Related P"),
        (f"<article>{SIX}<p>P</p></article>", "short0. short1. short2. short3. short4. short5. P"),
        (f"<div>{SIX}<p>P</p></div>", "short0. short1. short2. short3. short4. short5. P"),
        (f"<article><h1>T</h1><p>P</p><p>P</p><ul>{THREE}</ul><p>tail.</p><p>bye.</p></article>", "T P P link0 link1 link2 tail. bye."),
        ('<p class="advert">buy P</p><article><p>P</p><p class="advert">buy</p><p>x<span class="ad">buy</span></p></article>', "P x"),
        ('<div><p>P</p><ul><li class="comment">P P</li><li>P</li></ul></div><ol><li class="comment"><p>P</p><p>P</p></ol>', "P P"),
        ('<div><p>P</p><p class="ad">no<p>tail</div><article class="comment"><p>P</p></article>', "P tail"),
        ("<div><p>one.</p></div><div class='comments'><p>P P P</p></div>", "one."),
        ("<table><tr><td class='ad'>buy<td>P<tr><td>x</table>", "P x"),
    ],
)
def test_lengths_decide_and_names_only_lower_them(page, text):
    spaced = lambda x: re.sub(r"\b(short|link) (\d)", r"\1\2", x)
    assert spaced(main_text(re.sub(r"\bP\b", P, page))).replace(P, "P").split() == text.split()


def test_articles_come_out_without_names(spark, sf):
    for r in read(spark, sf, "pages").collect():
        bare = re.sub(r"\s(?:class|id|role)\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", "", r.html)
        text = main_text(r.html).split("\n\n")
        assert set(text) <= set(main_text(bare).split("\n\n"))
        # Nor do they need an article element.
        plain = main_text(re.sub(r"(</?)article\b", r"\1div", r.html)).split("\n\n")
        assert set(text) <= set(plain) and len(plain) <= len(text) + 2


def test_query_on_all_pages(spark, sf):
    got = {r.page_id: r for r in op1_html_extract(spark, sf).collect()}
    pages = read(spark, sf, "pages").collect()
    assert len(got) == len(pages)
    for r in pages:
        x = got[r.page_id]
        assert x.n_chars == len(x.text) and x.url == r.url and x.text == slow(r.html)[0]


def test_nested_and_unopened_elements_take_linear_time():
    n = 30_000
    assert main_text("<div>" * n + "</section>" * n + "x" + "</div>" * n) == "x"
    assert main_text("<article><p>one</p>" + "</aside>" * n + "<figure><figcaption>two</figcaption></figure></article>") == "one\n\ntwo"
