"""Attributes that hide, and markup left open, in pages."""

import pytest

from sextant.llm import pages
from sextant.llm.dom import HIDDEN, WORD_BITS, blocks_of

INNER = "<h1>A title</h1><p>First words of it, and some more of them.</p><p>Second paragraph, with words in it.</p>"
TEXT = "A title First words of it, and some more of them. Second paragraph, with words in it."


@pytest.mark.parametrize(
    "attributes,hidden",
    [
        ('class="overflow-hidden"', False), ('class="md:overflow-hidden"', False), ('data-title="The hidden valley"', False), ('aria-label="Hidden gems"', False),
        ('data-hidden="false"', False), ("aria-hidden=false", False), ("title='x style=\"display:none\"'", False), ("id=hidden-gems", False), ('style="--x:no display:none"', False),
        ("hidden", True), ("HIDDEN=''", True), ('aria-hidden="true"', True), ('style="color:red; display : none"', True), ('class="sr-only"', True), ('class="a visually-hidden"', True), ("class=hidden", True),
        ('data-x="' + "y" * 3000 + '" hidden', True),
    ],
)
def test_hiding_attributes(attributes, hidden):
    page = f"<body><article {attributes}>{INNER}</article></body>"
    assert {bool(b.ancestors & HIDDEN) for b in blocks_of(page)} == {hidden}
    if not hidden:
        assert pages.main_text(page, pages.default_model()) == TEXT


def test_hidden_is_a_feature():
    model = pages.default_model()
    part = "<div hidden>Words that nobody sees, and more of them.</div>"
    assert pages.main_text(f"<body><nav><a href=x>Menu</a></nav><article>{INNER}{part}</article></body>", model) == TEXT
    assert pages.main_text(f'<body><nav><a href=x>Menu</a></nav><div style="display:none"><article>{INNER}</article></div></body>', model) == TEXT


@pytest.mark.parametrize(
    "start",
    [
        "<html><head><title>T</title><body>", "<head><title>T</title><meta charset=utf-8><link rel=x>", "<head><title>T</title><style>p{}</style><head>", "<head><noscript><p>x</p></noscript><body>",
        "<body><select><option>a<option>b", "<body><svg><path d=x>", "<body><svg><foreignObject><b>x</b>", "<body><video src=x>", "<body><audio><source src=x>", "<body><canvas>", "<body><object><param name=x>",
        "<body><object><object><p>in</p></object></object>", "<body><video><p>in</p></video>", "<body><svg><foreignObject><p>in</p></foreignObject></svg>", "<body><svg><text>in</text></svg>", "<body><select><option>in</select>", "<body><svg></svg><head>",
    ],
)
def test_dropped_elements_left_open(start):
    assert [b.text for b in blocks_of(f"{start}<article>{INNER}</article><p>End")] == [*TEXT.replace("title ", "title|").replace(". ", ".|").split("|"), "End"]


def test_words_end_a_head():
    assert [b.text for b in blocks_of("<head><title>T</title>\n Words <b>of</b> it")] == ["Words of it"]


def test_page_without_an_end_of_head():
    page = f"<html><head><title>T</title><body><nav><a href=x>Menu</a></nav><article>{INNER}</article><footer>&copy; rights</footer>"
    assert pages.main_text(page, pages.default_model()) == TEXT


def test_elements_left_open_are_linear():
    blocks_of("<video><foreignobject>" * 50_000 + "<select><div>" * 50_000)


def test_paragraphs_end_with_what_they_hold():
    deep = "<b>" * 40
    assert [b.text for b in blocks_of(f"<p>One {deep}two<p>Three<div>Four</div>five")] == ["One two", "Three", "Four", "five"]
    cells = f"<p>A<table><tr><td>{'<i>' * 9}cell<p>in<td>next</table>after"
    assert [b.text for b in blocks_of(cells)] == ["A", "cell", "in", "next", "after"]
    assert [b.text for b in blocks_of("a<![CDATA[hello")] == ["ahello"] and [b.text for b in blocks_of("<![CDATA[x]]>y")] == ["xy"]
    blocks_of("<p><button>" + "<b>" * 50_000 + "<div></div>" * 50_000)  # in linear time


#: Pages written by hand, in layouts that the generator of the training pages does not write, and their article.
BY_HAND = [
    ("<article><p>Yes.</p></article>", "Yes."),
    ("<!doctype html><title>T</title><body><article><p>" + "Long words of one paragraph, one after another. " * 4000 + "</p></article>", ("Long words of one paragraph, one after another. " * 4000).strip()),
    ("<html><body><a class='sr-only' href='#m'>Skip to the main content</a><nav><a href=a>Home</a> <a href=b>About</a></nav><main id=m><article><h1>Rain over the hills</h1><p>It rained for three days, and the river rose.</p><p>On the fourth day the sun came out.</p></article></main><footer>Printed by hand. All rights reserved.</footer></body></html>", "Rain over the hills It rained for three days, and the river rose. On the fourth day the sun came out."),
    ("<body><header><a href=/>Daily</a></header><div class='overflow-hidden'><article><h2>Markets</h2><p>Prices fell on Monday, traders said, after a quiet week.</p><ul><li>Wheat fell by a tenth, the most in a year.</li><li>Rice held its price.</li></ul></article></div><aside><h3>Most read</h3><a href=1>One</a><a href=2>Two</a></aside><form><label>Mail</label><input><button>Join</button></form></body>", "Markets Prices fell on Monday, traders said, after a quiet week. Wheat fell by a tenth, the most in a year. Rice held its price."),
    ("<body><div role=navigation><a href=x>Start</a><a href=y>Archive</a></div><article><p>First, the dough has to rest.<p>Then it is baked, slowly, for an hour.</article><section class=comments><h3>2 comments</h3><p>I tried it and it was very good, thank you.</p></section>", "First, the dough has to rest. Then it is baked, slowly, for an hour."),
]


@pytest.mark.parametrize("page,text", BY_HAND)
def test_pages_by_hand(page, text):
    assert pages.main_text(page, pages.default_model()) == text


#: Ordinary pages, written by hand: names of bodies, wrappers and articles that tell of other parts, text without paragraphs, headings of
#: columns.  Most of these names and layouts the generator doesn't write.
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li><li><a href=/c>About us</a></li></ul></nav>"
END = "<footer>&copy; 2020 The Daily. All rights reserved.</footer>"
ONE = "One good sentence stands here, and nothing else."
BARE = "Bare text, with a comma. Second sentence."


def page(middle, body=""):
    return f"<html><head><title>T</title></head><body {body}>{MENU}{middle}{END}</body></html>"


BODIES = ["has-sidebar", "post comments-open", "single right-sidebar", "has-header has-footer", "page-template-default with-banner", "no-sidebar ads-enabled", "layout-sidebar-left", "menu-open overlay-active", "tag-news search-on", "newsletter-popup-closed"]
WRAPPERS = ["main-with-sidebar", "wide banner", "site-header-fixed", "l-rail-right", "hasSidebar", "topbar-visible", "page comments", "widget-area-left main", "footer-sticky", "promo-2020"]
ARTICLES = ["promo", "reviews", "popular", "related", "sponsored", "widget", "footer-news", "share"]
ORDINARY = {
    **{f"body {c}": (page(f"<article>{INNER}</article>", f"class='{c}'"), TEXT) for c in BODIES},
    **{f"main in body {c}": (page(f"<main>{INNER}</main>", f"class='{c}'"), TEXT) for c in BODIES[:4]},
    **{f"wrapper {c}": (page(f"<div class='{c}'><article>{INNER}</article></div>"), TEXT) for c in WRAPPERS},
    **{f"article {c}": (page(f"<article class='{c}'>{INNER}</article>"), TEXT) for c in ARTICLES},
    **{f"article alone {c}": (f"<article class='{c}'>{INNER}</article>", TEXT) for c in ARTICLES[:3]},
    "form around the page": (f"<body><form action=x>{MENU}<div id=content>{INNER}</div>{END}</form></body>", TEXT),
    "form around all but the footer": (f"<body><form id=aspnetForm method=post>{MENU}<main>{INNER}</main></form>{END}</body>", TEXT),
    "one sentence in main": (page(f"<main class='legal'><p>{ONE}</p></main>"), ONE),
    "one sentence": (f"<main class='legal'><p>{ONE}</p></main>", ONE),
    "bare text": (f"<article>{BARE}</article>", BARE),
    "bare text in a page": (page(f"<article>{BARE}</article>"), BARE),
    "bare lines": (page("<article>First line, and more.<br><br>Second line of it.<br>Third.</article>"), "First line, and more. Second line of it. Third."),
    "no tags": (BARE, BARE),
    "no tags, no stops": ("Just some words without anything else around them", "Just some words without anything else around them"),
    "heading in a header": (page(f"<article><header><h1>Title</h1></header><p>{ONE}</p><p>{ONE}</p></article>"), f"Title {ONE} {ONE}"),
    "column with a list": (page(f"<article>{INNER}</article><div class=column><h3>Most read</h3><ul><li><a href=1>One of them</a></li><li><a href=2>Two of them here</a></li></ul></div>"), TEXT),
    "column with links": (page(f"<article>{INNER}</article><div><h3>Most read</h3><a href=1>One of them</a><br><a href=2>Two of them here</a></div>"), TEXT),
    "comments are left out of a long page": (page(f"<article class=comments-open>{INNER}</article><section class=comments>{'<div class=comment><p>I liked this a lot, thank you for it.</p></div>' * 9}</section>"), TEXT),
    "sidebar beside a short article": (page(f"<div class=row><article><p>{ONE}</p></article><div class=sidebar><h4>About</h4><p>We write about rain, and rivers.</p><ul><li><a href=1>More</a></li></ul></div></div>"), ONE),
}


@pytest.mark.parametrize("name", ORDINARY)
def test_ordinary_pages(name):
    html, text = ORDINARY[name]
    assert pages.main_text(html, pages.default_model()) == text


def test_wrappers_are_kept_apart():
    blocks = blocks_of("<body class=sidebar><div class=ad><p>Some words that make up nearly all of the page, by far.</p><div class=ad>Buy.</div></div></body>")
    ad, side = (WORD_BITS[n][0] for n in ("ad", "side"))
    assert [(bool(b.ancestors & ad), bool(b.wide & ad), bool(b.wide & side)) for b in blocks] == [(False, True, True), (True, True, True)]
    assert len(ORDINARY) >= 40
