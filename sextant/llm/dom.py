"""Leaf blocks of a page, with what their ancestors and their own text say about them.

A tolerant reader of HTML in one pass: tags, comments and the contents of scripts, styles and
the like are taken off, character references are decoded, and text between block boundaries is
a leaf block.  Ancestors are kept as bit sets that grow down the tree, so a block costs the
same at any depth, and every construct is read in linear time however broken the page is.

What an element's tag and class say is kept apart by how much of the page it holds: an element with half of the page's text or more is a
wrapper, and its names (`has-sidebar`, a form around everything) say little about a block in it.  Whole names that only tell of a state
(`has-...`, `with-...`, `...-open`) say nothing.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']|"[^"<]*+"|'[^'<]*+'|["'])*+)>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'<>]++))?""")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
DROPPED = frozenset("script style noscript template svg math iframe object canvas audio video textarea select title head option datalist".split())
_RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that a head can hold; any other ends it.
_IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head".split())
#: Block start tags that end dropped elements left open, and drawings unless inside a part of them that holds markup.
_ENDS_DROPPED = BLOCK - {"button", "label", "legend", "optgroup"}
_DRAWING, _HOLDS_MARKUP = frozenset({"svg", "math"}), frozenset({"foreignobject", "desc", "annotation-xml"})
_NEXT = {n: tuple(re.compile(rf"<{slash}{n}(?=[\s/>])", re.I) for slash in ("", "/")) for n in DROPPED - _RAW.keys()}
#: A start tag in the second set ends an open element named in the first.
_ENDS = {"p": BLOCK - {"button", "label", "legend", "body", "html", "head"}, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"})}

#: Bits of ancestors, by tag.
TAG_BITS = {
    name: 1 << i
    for i, name in enumerate("nav header footer aside form article main section li table p heading blockquote pre figure a button address label dialog inner-header inner-footer".split())
}
_HEADINGS = dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), TAG_BITS["heading"])
_SAME = {"td": "table", "th": "table", "tr": "table", "figcaption": "figure", "dd": "li", "dt": "li", "input": "form", "fieldset": "form", "legend": "label"}
#: Bits of ancestors, by words in their class, id and role; "hidden" by whole names of classes, attributes and styles.
WORD_BITS = {
    name: (1 << (len(TAG_BITS) + i), frozenset(words.split()))
    for i, (name, words) in enumerate(
        {
            "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip topbar",
            "ad": "ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored adsense adbox dfp",
            "comment": "comment comments commentlist reply replies respond discussion disqus reviews responses",
            "side": "sidebar side aside widget widgets related recommended popular trending more complementary rail",
            "notice": "cookie cookies notice consent gdpr popup modal overlay alert newsletter subscribe subscription signup login message toast",
            "foot": "footer foot copyright legal contentinfo colophon bottom",
            "head": "header masthead banner logo branding top",
            "share": "share sharing social follow tags meta byline author buttons toolbar",
            "body": "article content post entry story main text body copy prose maincontent document",
            "hidden": "hidden sr-only visually-hidden invisible",
            "form": "search searchform form contact survey poll",
        }.items()
    )
}
HIDDEN = WORD_BITS["hidden"][0]
N_ANCESTOR_BITS = len(TAG_BITS) + len(WORD_BITS)
ARTICLE = TAG_BITS["article"] | TAG_BITS["main"]
_COMMENT = WORD_BITS["comment"][0]
#: Tags that wrap other blocks, and may wrap all of them.
_CONTAINERS = sum(TAG_BITS[n] for n in "nav header footer aside form section table address dialog".split())
#: Names that tell of a state of the page or of what stands beside it.
_STATE = re.compile(r"^(?:has|with|without|no|is|not|show|hide|page|template|layout)[-_]|[-_](?:open|closed|enabled|disabled|active|fixed|sticky|visible|left|right|on|off|with)(?:[-_]|$)|[-_](?:with|has|no)[-_]")
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


def _tag_bits(name: str) -> int:
    return TAG_BITS.get(_SAME.get(name, name), 0) | _HEADINGS.get(name, 0)


def _word_bits(attributes: str, known: dict[str, int]) -> int:
    """What class, id, role and hiding attributes say."""
    if not attributes.strip():
        return 0
    found = known.get(attributes)
    if found is None:
        found, given = 0, {}
        for key, value in _ATTRIBUTE.findall(attributes):
            given.setdefault(key.lower(), html.unescape(value.strip("\"'")))  # the first of a name counts
        if "hidden" in given or given.get("aria-hidden", "").strip().lower() == "true" or _HIDING.search(given.get("style", "")) or not WORD_BITS["hidden"][1].isdisjoint(given.get("class", "").lower().split()):
            found |= HIDDEN
        for value in (given.get("class", ""), given.get("id", ""), given.get("role", "")):
            names = [x for x in value.split() if not _STATE.search(x.lower())]
            words = {w for n in names for x in (n, n.lower()) for w in _SPLIT.split(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower()) if w}
            for bit, names in WORD_BITS.values():
                found |= bit if bit != HIDDEN and words & names else 0
        if len(known) < 5000 and len(attributes) <= 2000:
            known[attributes] = found
    return found


@dataclass
class Block:
    """Text, bits of near ancestors and of wrappers, and code points of links."""

    text: str
    ancestors: int
    linked: int
    wide: int = 0


def _spread(blocks: list[Block], of: list[int], parent: list[int], tags: list[int], words: list[int]) -> None:
    """Gives blocks their ancestors' bits; `of` has each block's innermost element, an element's parent comes before it."""
    mass = [0] * len(parent)
    for b, i in zip(blocks, of):
        if i >= 0:
            mass[i] += len(b.text) - min(b.linked, len(b.text))
    total = sum(len(b.text) - min(b.linked, len(b.text)) for b in blocks)
    for i in range(len(parent) - 1, 0, -1):
        if parent[i] >= 0:
            mass[parent[i]] += mass[i]
    near, wide = [0] * len(parent), [0] * len(parent)
    header, footer = TAG_BITS["header"], TAG_BITS["footer"]
    for i, p in enumerate(parent):
        n, w = (near[p], wide[p]) if p >= 0 else (0, 0)
        t, hiding, said = tags[i], words[i] & HIDDEN, words[i] & ~HIDDEN
        if t & (header | footer) and (n | w) & ARTICLE:
            t = TAG_BITS["inner-header"] if t & header else TAG_BITS["inner-footer"]
        wraps = 2 * mass[i] >= total > 0
        if t & ARTICLE:
            aside = 0 if wraps else said & _COMMENT and said
            near[i], wide[i] = n | t | hiding | aside, w | (said & ~aside)
        elif wraps:
            near[i], wide[i] = n | (t & ~_CONTAINERS) | hiding | (said & _COMMENT), w | (t & _CONTAINERS) | (said & ~_COMMENT)
        else:
            near[i], wide[i] = n | t | hiding | said, w
    for b, i in zip(blocks, of):
        if i >= 0:
            b.ancestors, b.wide = near[i], wide[i]


def blocks_of(page: str | None, known: dict[str, int] | None = None) -> list[Block]:
    """Leaf blocks in page order; `known` keeps what attributes mean, from page to page."""
    if not page:
        return []
    known = {} if known is None else known
    out: list[Block] = []
    of: list[int] = []
    stack: list[tuple[str, int]] = []  # names and numbers of open elements
    parent: list[int] = []
    tags: list[int] = []
    said: list[int] = []
    open_: dict[str, int] = {}
    block_at: list[int] = []  # places of open block elements in the stack
    parts: list[str] = []
    linked = 0
    dropped: list[tuple[str, bool]] = []  # open elements without text; whether the end tag comes before another of its name begins
    ahead: dict[re.Pattern, int] = {}

    def next_of(pattern: re.Pattern, at: int) -> int:
        if ahead.get(pattern, -1) < at:
            m = pattern.search(page, at)
            ahead[pattern] = m.start() if m else end
        return ahead[pattern]

    def ends_dropped(tag: str) -> bool:
        """Whether the innermost dropped element cannot hold this start tag."""
        name, shut = dropped[-1]
        if name == "head":
            return tag not in _IN_HEAD
        return tag in _ENDS_DROPPED and (name in _DRAWING or not shut)

    def close() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, 0, linked))
                of.append(stack[-1][1] if stack else -1)
            parts.clear()
        linked = 0

    def pop() -> None:
        name, _ = stack.pop()
        open_[name] -= 1
        if block_at and block_at[-1] == len(stack):
            block_at.pop()
        if dropped and dropped[-1][0] == name:
            dropped.pop()

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        upto = m.start() if m else end
        if upto > at and dropped and stack[-1][0] == "head" and not page[at:upto].isspace():
            pop()  # words do not stand in a head
        if upto > at and not dropped:
            text = page[at:upto]
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if open_.get("a"):
                linked += len(text)
        if not m:
            break
        at = m.end()
        name = m[2]
        if name is None:
            if m[0].startswith("<![CDATA[") and not dropped:
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m[1]:
            if open_.get(name):
                if name in BLOCK:
                    close()
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in BLOCK:
            close()
        while dropped and ends_dropped(name):
            left = len(dropped)
            while len(dropped) == left:
                pop()
        if name == "head" and (out or stack and stack[-1][0] != "html"):
            continue
        if name in ("br", "wbr", "img", "input", "hr"):
            parts.append(" " * (name != "wbr"))
        if name in VOID or m[3].endswith("/") and name not in BLOCK:
            continue
        if name in DROPPED and name in _RAW:
            tail = _RAW[name].search(page, at)
            at = tail.end() if tail else end
            continue
        if name in BLOCK or name == "option":
            while stack and name in _ENDS.get(stack[-1][0], ()):
                pop()
            if name in _ENDS["p"] and block_at and stack[block_at[-1]][0] == "p":
                # Inline elements left open inside the paragraph, however many, end with it.
                depth = block_at[-1]
                while len(stack) > depth:
                    pop()
        if name in BLOCK:
            block_at.append(len(stack))
        parent.append(stack[-1][1] if stack else -1)
        tags.append(_tag_bits(name))
        said.append(_word_bits(m[3], known))
        stack.append((name, len(parent) - 1))
        open_[name] = open_.get(name, 0) + 1
        if name in DROPPED:
            opens, closes = _NEXT[name]
            dropped.append((name, next_of(closes, at) < next_of(opens, at)))
        elif dropped and name in _HOLDS_MARKUP:
            dropped.append((name, dropped[-1][1]))
    close()
    _spread(out, of, parent, tags, said)
    return out
