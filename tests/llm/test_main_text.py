import math
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stratavox.llm.main_text import Lines, extract_main_text, main_text, measured, named_as, repaired, smoothed, threshold, _OTHER_PARTS

PAGES = [
    (
        "<body><div id=menu><a href=x>a</a></div><div class='post-content'><h1>T</h1><p>Long text here that is nice.</p><p>Short.</p>"
        "<div class='share-buttons'>share</div></div><div id='comments'><article class='comment'><p>reader says a very long comment that is "
        "really very long indeed</p></article></div><footer>f</footer>",
        "T Long text here that is nice. Short.",
    ),
    ("<p>just one</p>", "just one"),
    ("plain text &amp; more &lt;b&gt;", "plain text & more <b>"),
    ("", ""),
    (None, ""),
    ("<nav>x</nav>", ""),
    (
        "<main><header><h1>Head</h1></header><p>A<br>B <i>c</i>d</p><ul><li>one<li>two</ul><aside>no</aside><form>no</form></main>"
        "<div class='cookie-notice'>we use cookies</div>",
        "Head A B cd one two",
    ),
    ("<header>Site</header><article><p>x</p></article>", "x"),
    ("<p>a<script>if (a<b) '</p>'</script>b</p>", "ab"),
    ("<div class=ad>buy</div><div><p>para one is here and it is long enough</p></div>", "para one is here and it is long enough"),
    ("<article><p><b>open<br><p>never &#233; closed&nbsp; x", "open never é closed x"),
    ("<nav><ul><li><a href=/>home</a></ul><article><p>left open before</p></article>", "left open before"),
]


@pytest.mark.parametrize("html,text", PAGES)
def test_page(html, text):
    assert main_text(html) == text


def test_long_and_deep_pages():
    body = "word " * 50_000
    assert main_text(f"<article><p>{body}</p></article>") == body.strip()
    assert main_text("<div>" * 20_000 + "deep text" + "</div>" * 20_000) == "deep text"


def test_smoothing_and_threshold():
    assert np.allclose(smoothed(np.ones(9)), 1)
    assert 2 < threshold(np.array([1.0, 1.1, 0.9, 5.0, 5.2])) < 4
    assert threshold(np.ones(4)) == -np.inf


def test_rows(spark):
    pages = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)] + [(None, None, None, "x")], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(pages).collect()}
    assert got == {**{i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}, None: ("", 0)}
    assert extract_main_text(pages.limit(0)).collect() == []


LONG = "This paragraph has quite a lot of words in it, so that its line stands well above the short ones around it. " * 3


def test_threshold_drops_unlinked_boilerplate_of_unmarked_pages():
    body = "".join(f"<p>{LONG}{k}</p>" for k in range(5))
    tail = "".join(f"<div><span>{x}</span></div>" for x in "Imprint Terms Jobs Press Contact Help Status About".split())
    text = main_text(f"<body><h2>Part</h2>{body}<p>Short.</p>{body}<div>{tail}</div></body>")
    assert "Status" not in text and "About" not in text and text.count("0 This") == 2 and "Short." in text


def test_sibling_articles_are_joined():
    a, b = ("".join(f"<p>{LONG}{x}{k}</p>" for k in range(n)) for x, n in (("a", 6), ("b", 4)))
    text = main_text(f"<body><article>{a}</article><article>{b}</article></body>")
    assert all(f"a{k}" in text for k in range(6)) and all(f"b{k}" in text for k in range(4))
    marked = main_text(f"<body><div class=entry>{a}</div><div class=entry>{b}</div></body>")
    assert marked == text


def test_lines_on_one_level_are_all_content():
    assert threshold(np.log1p(np.array([80.0, 100, 120, 90, 130]))) == -np.inf


@pytest.mark.parametrize(
    "part",
    [
        f"<section id='discussion'><p>{LONG}</p></section>",
        f"<section id='related-work'><p>{LONG}</p></section>",
        "<h2 id='side-effects'>Inner part</h2>",
        "<h2 id='search-engines'>Inner part</h2>",
        f"<div class='alert alert-info'><p>{LONG}</p></div>",
        f"<p class='notice-period'>{LONG}</p>",
    ],
)
def test_names_inside_an_article_do_not_drop_its_text(part):
    inner = part.split(">", 1)[1].rsplit("<", 1)[0].replace("<p>", "").replace("</p>", "").strip()
    assert main_text(f"<article><h1>Head</h1><p>{LONG}</p>{part}<p>{LONG}</p></article>").split(LONG.strip(), 1)[1].startswith(f" {inner}")
    count = LONG.count("This") * (2 + ("This" in part))
    assert main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>").count("This") == count


def test_links_adverts_and_comments_inside_an_article_go():
    links = "".join(f"<li><a href=/{k}>Another story to read {k}</a></li>" for k in range(9))
    rest = f"<div class='related'><ul>{links}</ul></div><div class='ad'><p>advert {LONG}</p></div>"
    text = main_text(f"<main><article><p>{LONG}</p><p>{LONG}</p>{rest}</article><section id='comments'><p>reader {LONG}</p></section></main>")
    assert text == f"{LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize(
    "html,text",
    [
        ("<p>a<![foo[x]]>b</p>", "ab"),
        ("<p>a<![ ]>b<![CDATA[c]]>d</p>", "abd"),
        ("<p>a<!DOCTYPE x>b<?php echo 1 ?>c</ >d</\u00e9>e</p>", "abcde"),
        ("<p>a<!-- b -- > c --!>d<!-->e<!--->f</p>", "adef"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("<p>a</p><p title='b", "a"),
        ("<p>5 < 6 and 7 <8</p>", "5 < 6 and 7 <8"),
        ("<p title=\"x > y\" class=ok>a</p>", "a"),
        ("<p title=\"open>a</p>", "a"),
        ("<p>a<script>1 < 2; '</p>'", "a"),
        ("<a\"b c>x</a\"b><p>y", "x y"),
        ("<p>Tom &amp Jerry &#65;&#x42; &notaname; &", "Tom & Jerry AB \u00acaname; &"),
    ],
)
def test_broken_markup(html, text):
    assert main_text(html) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", ">", "!", "[", "]", "-", "/", "?", "=", '"', "'", "&", "#", "p", "a", "script", "style", " ", "\x00", "\n", "<!--", "-->", "<![", "]]>", "<p>", "</p>", "<article>", "\u00e9", "x"]), max_size=60).map("".join))
def test_nothing_stops_the_parser(html):
    assert isinstance(main_text(html), str)
    assert main_text(f"<article><p>kept</p></article>{html}").startswith("kept") or "article" in html or "script" in html or "style" in html


@pytest.mark.parametrize("bad", ["<a ", "<!--", "<![x[", '<a b="', "<a b='", "<script>", "</x", "<a =", "<p/", "<!-- >", "&#", "<b x='1\" "])
def test_a_megabyte_of_unclosed_markup(bad):
    start = time.time()
    for end in ("", ">", "\"'>"):
        main_text("<article><p>x</p></article>" + bad * (1_000_000 // len(bad)) + end)
    assert time.time() - start < 20


@pytest.mark.parametrize("name", ["share-price", "comment-policy", "related-work", "search-engines", "notice-period", "side-effects", "hidden-figures"])
@pytest.mark.parametrize("frame", ["<article><p>{long}</p>{part}<p>{long}</p></article>", "<body><div><p>{long}</p>{part}<p>{long}</p></div></body>"])
@pytest.mark.parametrize("part", ["<div class='{name}'><p>{long}</p></div>", "<div id='{name}'><p>{long}</p></div>", "<p class='{name}'>{long}</p>"])
def test_names_that_only_begin_like_a_box(name, frame, part):
    html = frame.format(long=LONG, part=part.format(name=name, long=LONG))
    assert main_text(html).count("stands well above") == 9


@pytest.mark.parametrize("name", ["ad", "ad-slot-1", "share-bar", "shareButtons", "comment-list", "comments_area", "site-header", "cookie-notice", "related-posts", "sr-only", "post sidebar"])
def test_names_of_boxes(name):
    assert named_as(name if name != "shareButtons" else "share-Buttons", _OTHER_PARTS)
    box = f"<div class='{name}'><ul><li><a href=/>one link</a></li><li><a href=/>two links</a></li></ul></div>"
    assert "link" not in main_text(f"<body><div><p>{LONG}</p><p>{LONG}</p></div>{box}</body>")


def plain_selection(lines):
    """Ratio, Gaussian smoothing and threshold as sums over all lines."""
    ratio = [math.log1p((len(t) - linked) / max(tags, 1)) for _, t, tags, linked in lines]
    reach = 5
    level = []
    for i in range(len(ratio)):
        near = [(math.exp(-((i - j) ** 2) / (2 * 1.5**2)), ratio[j]) for j in range(len(ratio)) if abs(i - j) <= reach]
        level.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    at = sum(level) / len(level)
    for _ in range(50):
        low, high = [x for x in level if x <= at], [x for x in level if x > at]
        if not low or not high:
            return [True] * len(level)
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if new == at:
            break
        at = new
    return [x > at for x in level] if sum(high) / len(high) - sum(low) / len(low) >= 1 else [True] * len(level)


def test_selection_equals_plain_sums():
    rng = random.Random(5)
    for _ in range(40):
        html = "".join(rng.choice([f"<p>{'word ' * rng.randint(1, 80)}</p>", "<div><a href=/>short link</a></div>", "<li><b><i>x</i></b></li>"]) for _ in range(rng.randint(1, 40)))
        page = Lines()
        for piece in repaired(html):
            page.feed(piece)
        page.end()
        assert measured(page.lines)[1].tolist() == plain_selection(page.lines)
