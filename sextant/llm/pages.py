"""Main text of web pages by a conditional random field over leaf blocks.

Blocks are labelled article or not from their ancestors' tags, classes and ids, from their own
text, and from their neighbours' labels.  The model learns from labelled pages when the plan is
made: `labelled_pages` writes them in many layouts with articles, menus, headers, footers,
sidebars, notices, adverts, forms, reader comments and parts out of sight, `TRAIN_PAGES` of them.

Defined results: a null or empty page, or one without an article, has the empty text; broken
markup is read as far as it goes; repeated pages are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Chain, train
from .dom import ARTICLE, HIDDEN, N_ANCESTOR_BITS, Block, blocks_of
from .words import slices

#: Labelled pages that the model learns from.
TRAIN_PAGES = 500
_TEXT_FEATURES = 21
N_FEATURES = 2 * N_ANCESTOR_BITS + _TEXT_FEATURES + 4
_MARKS = ("©", "all rights reserved", "cookie", "subscribe", "sign in", "log in", "read more", "click here", "share")


def features(blocks: list[Block]) -> np.ndarray:
    """Binary features of a page's blocks, one row each."""
    n = len(blocks)
    bits, wide = (np.array([getattr(b, name) for b in blocks], np.int64) for name in ("ancestors", "wide"))
    out = np.zeros((n, N_FEATURES), np.float32)
    if not n:
        return out
    for at, own in ((0, bits), (N_ANCESTOR_BITS, wide)):
        out[:, at : at + N_ANCESTOR_BITS] = (own[:, None] >> np.arange(N_ANCESTOR_BITS)) & 1
    chars = np.array([len(b.text) for b in blocks])
    words = np.array([b.text.count(" ") + 1 for b in blocks])
    linked = np.array([b.linked for b in blocks]) / chars
    stops = np.array([b.text.count(".") + b.text.count(",") for b in blocks])
    closed = np.array([b.text[-1] in ".!?\"”»…" for b in blocks])
    marked = np.array([len(b.text) < 300 and any(m in b.text.lower() for m in _MARKS) for b in blocks])
    links = linked > 0.9
    long = (words > 15) & ~links
    before, after = lambda x: np.concatenate([[False], x[:-1]]), lambda x: np.concatenate([x[1:], [False]])
    k = 2 * N_ANCESTOR_BITS
    cols = [words <= 2, (words > 2) & (words <= 6), (words > 6) & (words <= 15), (words > 15) & (words <= 40), words > 40, links, (linked > 0.3) & (linked <= 0.9), linked <= 0.05, stops == 0, stops >= 3, closed, marked, np.arange(n) == 0, np.arange(n) == n - 1]
    # A heading over links, a short line beside long ones, and a page of one block are known by their neighbours.
    cols += [before(links), after(links), after(links) & after(after(links)), before(long), after(long), (words <= 15) & ~links & after(links), np.full(n, n == 1)]
    out[:, k : k + _TEXT_FEATURES] = np.stack(cols, 1)
    inside = (bits & ARTICLE) > 0
    hidden = (bits & HIDDEN) > 0
    out[:, -4] = hidden & ~hidden[inside | ~inside.any()].all()  # out of sight, and what may be the article is not
    out[:, -3] = inside.any() & ~inside  # the page names its article, and the block is elsewhere
    out[:, -2] = ~inside.any()
    out[:, -1] = 1
    return out


def labelled_pages(seed: int = 11, n: int = TRAIN_PAGES) -> Iterator[tuple[str, list[str]]]:
    """Pages with the texts of their article's blocks."""
    rng = random.Random(seed)
    syllables = "an ou er tion la re de un ble ing th ha ver ei zu lich ción do ar mente eau que ment".split()

    def words(lo: int, hi: int, stop: str = ".") -> str:
        w = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(lo, hi))]
        w = [x + ("," if rng.random() < 0.1 else "." if rng.random() < 0.07 else "") for x in w]
        return (w[0].capitalize() + " " + " ".join(w[1:])).strip().rstrip(".,") + stop

    def links(lo: int, hi: int) -> str:
        return "".join(f'<li><a href="/{i}">{words(1, 3, "")}</a></li>' for i in range(rng.randint(lo, hi)))

    def pick(*options: str) -> str:
        return rng.choice(options)

    def maybe(p: float, text: str) -> str:
        return text if rng.random() < p else ""

    for _ in range(n):
        kept: list[str] = []

        def keep(text: str) -> str:
            kept.append(text)
            return text

        def paragraph() -> str:
            kind = rng.random()
            if kind < 0.14:  # articles are not all prose: bare words, one word over and over, signs, capitals
                one = words(1, 2, "")
                odd = pick(words(1, 3, ""), words(10, 80, ""), " ".join([one] * rng.randint(2, 90)), words(5, 60).replace(" ", " | "), words(5, 40).replace(" ", pick("!! ", "### ", "%% ")), words(3, 40).upper())
                return f"<p>{keep(odd)}</p>"
            if kind < 0.72:
                return f"<p>{keep(words(*pick((1, 3), (4, 20), (15, 90), (40, 200))))}" + pick("</p>", "</p>", "</p>", "")
            if kind < 0.79:
                return f"<h2>{keep(words(2, 7, ''))}</h2>"
            if kind < 0.85:
                return "<ul>" + "".join(f"<li>{keep(words(2, 15))}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
            if kind < 0.9:
                return f"<blockquote><p>{keep(words(8, 40))}</p></blockquote>"
            if kind < 0.93:
                return f"<pre>{keep(words(3, 12))}</pre>"
            if kind < 0.96:
                return "<table>" + "".join(f"<tr><td>{keep(words(1, 3, ''))}</td><td>{keep(words(1, 5, ''))}</td></tr>" for _ in range(2)) + "</table>"
            return f'<figure><img src="x.png"><figcaption>{keep(words(3, 12))}</figcaption></figure>'

        def unseen() -> str:
            tag, how = pick("div", "p", "span", "section"), pick("hidden", 'aria-hidden="true"', 'style="display:none"', 'class="sr-only"', 'class="visually-hidden"', 'class="hidden"')
            return f"<{tag} {how}>{words(1, 60, pick('', '.'))}</{tag}>" if tag != "span" else f"<div><span {how}>{words(1, 8, pick('', '.'))}</span></div>"

        def bare() -> str:
            """Text that stands in the article itself, lines divided by breaks."""
            lines = [words(4, 60, pick("", ".", ".")) for _ in range(rng.randint(1, 4))]
            keep(" ".join(lines))
            return pick("<br>", "<br/><br>", " ").join(lines)

        def odd_names() -> str:
            """Names of wrappers, that say of the page what other names say of a part."""
            part = lambda: pick("sidebar", "header", "footer", "nav", "banner", "comments", "ads", "search", "widget", "popup", "social")
            return pick("", "page", "home", "wrapper", "container", "row", "no-js", f"has-{part()}", f"with-{part()}", f"{part()}-{pick('open', 'fixed', 'left', 'right', 'enabled', 'active')}", f"main-with-{part()}", f"no-{part()}", f"{pick('right', 'left', 'wide', 'full')}-{part()}", f"site-{part()}", part(), f"{part()} {part()}")

        ad = lambda: f'<div class="{pick("ad", "ads", "advert", "sponsored-box", "promo", "banner-ad")}">{pick("", "<p>")}{words(3, 14)}</div>'
        aside = lambda: pick(
            f'<aside><h3>{words(1, 3, "")}</h3><ul>{links(2, 5)}</ul></aside>',
            f'<div class="{pick("sidebar", "widget", "related-posts", "side rail")}"><h4>{words(1, 3, "")}</h4><p>{words(5, 30)}</p><ul>{links(1, 4)}</ul></div>',
            f'<aside class="related"><p>{words(5, 40)}</p></aside>',
            f"<div><{pick('h2', 'h3', 'h4', 'p', 'b')}>{words(1, 4, '')}</{pick('h2', 'h3')}><ul>{links(2, 6)}</ul></div>",
            f'<div class="{pick("column", "col", "box", "panel")}"><h3>{words(1, 3, "")}</h3>' + "".join(f'<a href="/{i}">{words(2, 8, "")}</a>' + pick("", "<br>") for i in range(rng.randint(2, 5))) + "</div>",
        )
        notice = lambda: pick(
            f'<div class="{pick("cookie-banner", "notice", "consent", "popup", "newsletter")}"><p>{pick("We use cookies. ", "")}{words(6, 30)}</p><button>{words(1, 2, "")}</button></div>',
            f'<div role="alert" class="alert">{words(5, 20)}</div>',
            f'<dialog><p>{words(5, 20)}</p></dialog>',
        )
        form = lambda: f'<form action="/x" class="{pick("", "search", "subscribe", "login")}"><label>{words(1, 4, "")}</label><input name="q"><textarea>{words(2, 5)}</textarea><button>{words(1, 2, "")}</button>{maybe(0.4, "<p>" + words(5, 25) + "</p>")}</form>'

        def comments() -> str:
            each = "".join(pick(f'<div class="comment"><b>{words(1, 2, "")}</b><p>{words(3, 60)}</p></div>', f"<li><p>{words(3, 60)}</p></li>", f"<article class='comment'><p>{words(3, 60)}</p></article>") for _ in range(rng.randint(1, 5)))
            return pick('<section id="comments">', '<div class="comments">', '<ol class="commentlist">', '<div id="respond" class="discussion">') + f"<h3>{words(1, 3, '')}</h3>{each}" + maybe(0.4, form())

        share = lambda: f'<div class="{pick("share", "social-buttons", "byline", "post-meta", "tags")}">{pick(words(1, 5, ""), "<a href=x>" + words(1, 2, "") + "</a> <a href=y>" + words(1, 2, "") + "</a>")}</div>'
        nav = pick(f"<nav><ul>{links(3, 9)}</ul></nav>", f'<div class="{pick("menu", "navbar", "nav-main", "topbar")}"><ul>{links(3, 9)}</ul></div>', f'<ul id="navigation">{links(3, 8)}</ul>')
        header = pick("", f'<header><a href="/">{words(1, 2, "")}</a><p>{words(2, 8, "")}</p></header>', f'<div id="header"><h1>{words(1, 3, "")}</h1><p class="tagline">{words(3, 9)}</p></div>', f"<header><h1>{words(1, 4, '')}</h1>{nav}</header>")
        footer = pick(f"<footer>&copy; {words(2, 12)}</footer>", f'<footer><p>{words(3, 25)}</p><ul>{links(1, 5)}</ul></footer>', f'<div class="footer"><p>&copy; 2020 {words(2, 10)}</p></div>', f'<div id="footer">{words(3, 20)}</div>')
        title = pick(f"<h1>{keep(words(2, 12, pick('', '.')))}</h1>", f"<h1>{keep(words(3, 10, ''))}</h1>", "")
        body = ""
        for _ in range(rng.randint(1, 14)):
            body += paragraph() + maybe(0.1, ad()) + maybe(0.08, notice()) + maybe(0.06, aside()) + maybe(0.06, unseen())
        if rng.random() < 0.12:
            body = bare() + maybe(0.5, body)
        if title and rng.random() < 0.25:
            title = f"<header>{maybe(0.2, share())}{title}{maybe(0.3, share())}</header>"
        inner = title + maybe(0.2, share()) + body + maybe(0.2, share()) + maybe(0.1, form())
        around = maybe(0.25, comments() + "</div>")
        middle = pick(
            f"<article>{inner}</article>{around}",
            f"<article>{inner}</article>{around}",
            f"<article class='{odd_names()} {pick('', 'promo', 'reviews', 'popular', 'related', 'legal', 'post', 'hentry')}'>{inner}</article>{around}",
            f"<main class='{pick('legal', 'popular', 'widget', odd_names())}'>{inner}</main>{around}",
            f"<article class='post'>{inner}{maybe(0.3, comments() + '</div></ol></section>')}</article>",
            f"<main>{inner}</main>{around}",
            f"<main><article>{inner}</article>{around}</main>",
            f'<div id="{pick("content", "main-content", "story")}" class="{pick("", "entry", "post-body")}">{inner}</div>{around}',
            f'<div class="{pick("entry-content", "article-body", "text", "prose")}">{inner}</div>{around}',
            f"<div>{inner}</div>{around}",
        )
        if rng.random() < 0.1:  # names that only look hidden, or an article that a script brings to sight
            middle = f'<div {pick("class=overflow-hidden", "class=hidden", "data-hidden=false", "style=display:none", "hidden")}>{middle}</div>'
        if rng.random() < 0.1:  # a part of a page
            if rng.random() < 0.7:
                kept.clear()
                middle = f"<article>{bare() if rng.random() < 0.5 else paragraph()}</article>"
                if rng.random() < 0.3:
                    kept.clear()
                    middle = bare()  # text alone
            yield middle, kept
            continue
        if rng.random() < 0.3:
            middle = f"<div class='{odd_names()}'>{middle}</div>"
        left_open = lambda: pick(f"<select><option>{words(1, 3, '')}<option>{words(1, 3, '')}", "<svg viewBox='0 0 9 9'><path d='M0 0'>", "<video src=x>", "<canvas>", "<object data=x>")
        yield (
            f"<!DOCTYPE html><html><head><title>{words(2, 6, '')}</title><style>p{{}}</style><script>var t='</p>';</script>" + pick("</head>", "</head>", "</head>", "") + f"<body class='{odd_names()} {odd_names()}'>" + (whole := pick("", "", "", "", "", "", "<form action=x>", f"<div class='{odd_names()}'>", f"<div id='{odd_names()}'>"))
            + maybe(0.15, notice()) + maybe(0.1, unseen()) + header + maybe(0.85, nav) + maybe(0.05, left_open()) + maybe(0.4, ad()) + maybe(0.2, aside()) + middle + maybe(0.3, aside()) + maybe(0.2, form()) + maybe(0.15, notice()) + footer + ("</form>" if whole.startswith("<form") else "</div>" if whole else "")
            + pick("</body></html>", "</body></html>", "")
        ), kept


def training_set(seed: int = 11, n: int = TRAIN_PAGES) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and labels of the blocks of labelled pages."""
    out = []
    for page, kept in labelled_pages(seed, n):
        blocks = blocks_of(page)
        rest = [" ".join(k.split()) for k in kept]
        labels = np.zeros(len(blocks), np.int64)
        for i, b in enumerate(blocks):
            if b.text in rest:
                labels[i] = 1
                rest.remove(b.text)
        out.append((features(blocks), labels))
    return out


@lru_cache(maxsize=2)
def default_model() -> Chain:
    return train(training_set())


def main_text(page: str | None, model: Chain, known: dict[str, int] | None = None) -> str:
    blocks = blocks_of(page, known)
    if not blocks:
        return ""
    return " ".join(b.text for b, keep in zip(blocks, model.decode(features(blocks)).tolist()) if keep)


def extract_main_text(pages: DataFrame, model: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars; one row per page."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())  # a few hundred numbers

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = sent.value, {}
        for batch in slices(batches, "html"):
            texts = [main_text(x, model, known) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(extract, "page_id bigint, url string, text string, n_chars bigint")
