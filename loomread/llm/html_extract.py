"""Main text of web pages: flat text blocks, classified by a decision tree over block features.

A page is cut at block tags into text blocks. A block's features are its words and link density and those of the blocks
before and after it, and what it stands in (boilerplate elements, the article, a heading, a list). The tree is grown
when the module is first used, from small labelled pages; its root splits by words or links.

Defined results: a null or empty page, and one without main text, gives the empty string; ends of the page inside a tag,
comment or script end it there; elements left open end with their parent; repeated rows give equal rows; other columns
are ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements whose content is never text of the page.
RAW = "script style title textarea iframe noembed noframes noscript xmp template svg annotation object select button".split()
#: Elements that end a text block.
BLOCK = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that others stand in; a closing tag ends those that are open within.
CONTAINER = BLOCK - {"p", "br", "hr", "html", "head", "body", "h1", "h2", "h3", "h4", "h5", "h6", "option"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
LIST = {"li", "dt", "dd", "td", "th", "menu", "ul", "ol", "dir", "dl", "table", "tr"}
NOISE_TAG = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "dir"}
NOISE_ROLE = set("navigation banner contentinfo complementary dialog alertdialog alert search form menu menubar toolbar".split())
#: Words for boilerplate in class and id values, and words that say nothing beside them. A value counts only if all of
#: its words are among these and one is of the first kind: "cookie-notice", "left-sidebar", not "side-effects".
NOISE_NAME = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice notices notification newsletter subscribe subscription signup"
    " popup modal overlay comment comments disqus respond replies reply sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer masthead topbar related recommended recommendations teaser teasers share sharing toolbar widget widgets"
    " pagination pager login register copyright".split()
)
NEUTRAL_NAME = set("left right top bottom upper lower main site page box list bar area block section inner outer container wrap wrapper item items group row col column panel text thread form primary secondary global social links posts articles stories header head".split())
MAIN_NAME = {"article", "entry", "post", "story", "articlebody"}

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>(?P<in>.*?)(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTR = re.compile(r"(?P<name>class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s\"'>]+)))?(?=[\s/>]|\Z|\"|')", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass(slots=True)
class Block:
    text: str
    words: int
    linked: int
    noise: bool  # by its elements and roles
    named: bool  # by a class or id
    hidden: bool
    main: int  # 2 in an article, 1 in a main element
    heading: bool
    listed: bool


def _names(value: str) -> tuple[bool, bool]:
    """Whether one of the class or id values names boilerplate; or the main text."""
    noise = main = False
    for one in value.split():
        parts = {p.lower() for p in _NAME.findall(one)}
        noise = noise or bool(parts & NOISE_NAME) and parts <= NOISE_NAME | NEUTRAL_NAME
        main = main or bool(parts & MAIN_NAME)
    return noise, main


def _marks(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool, int]:
    """Whether an element is boilerplate by its kind or role, by its name, or isn't shown; what main part of the page it is."""
    noise = tag in NOISE_TAG or tag == "header" and not in_article
    named = hidden = False
    main = 2 if tag == "article" else 1 if tag == "main" else 0
    if "=" in attrs or "hidden" in attrs.lower():
        for m in _ATTR.finditer(attrs):
            name, value = m["name"].lower(), m["a"] or m["b"] or m["c"] or ""
            if name in ("class", "id"):
                own, part = _names(value)
                named, main = named or own, max(main, 2 * (part and not own))
            elif name == "role":
                noise, main = noise or value.lower() in NOISE_ROLE, max(main, 1 * (value.lower() == "main"))
            elif name == "itemprop":
                main = max(main, 2 * (value.lower() == "articlebody"))
            elif name == "style":
                hidden = hidden or "display:none" in value.replace(" ", "").lower()
            else:
                hidden = hidden or name == "hidden" or value.lower() == "true"
    return noise, named, hidden, main


def blocks(page: str | None) -> list[Block]:
    """The text blocks of a page, in its order; white space within them is one space."""
    page = page or ""
    out: list[Block] = []
    # tag; boilerplate by kind, by name; not shown; main part; in a list
    open_: list[tuple[str, bool, bool, bool, int, bool]] = [("", False, False, False, 0, False)]
    now: list[tuple[str, bool]] = []  # pieces, and whether they stand in a link
    link, heading = False, False
    own = (False, False, False)

    def close() -> None:
        if now:
            # character references end where tags begin, so pieces are decoded one by one
            pieces = [(html.unescape(t) if "&" in t else t, k) for t, k in now]
            text = " ".join("".join(t for t, _ in pieces).split())
            if text:
                _, noise, named, hidden, main, listed = open_[-1]
                linked = sum(len(t.split()) for t, k in pieces if k)
                out.append(Block(text, text.count(" ") + 1, linked, noise or own[0], named or own[1], hidden or own[2], main, heading, listed))
            now.clear()

    def read(tag: str, ends: bool, attrs: str) -> None:
        nonlocal link, heading, own
        if tag == "a":
            link = not ends
        if tag not in BLOCK:
            return
        close()
        if tag == "br":
            return
        heading = tag in HEADING and not ends
        own = (False, False, False)
        if tag not in CONTAINER:
            if not ends and attrs:
                own = _marks(tag, attrs, True)[:3]
            return
        link = False
        if ends:
            at = next((i for i in range(len(open_) - 1, 0, -1) if open_[i][0] == tag), 0)
            if at:
                del open_[at:]
            return
        if tag in ("li", "dt", "dd", "tr", "td", "th") and open_[-1][0] == tag:
            open_.pop()  # its closing tag may be left out
        _, noise, named, hidden, main, listed = open_[-1]
        mine = _marks(tag, attrs, main == 2)
        # an article within what looks like boilerplate begins anew
        fresh = mine[3] == 2 and main < 2 and tag in ("article", "main")
        open_.append((tag, mine[0] or noise and not fresh, mine[1] or named and not fresh, hidden or mine[2], max(main, mine[3]), listed or tag in LIST))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            now.append((page[at : m.start()], link))
        at = m.end()
        if m["tag"]:
            read(m["tag"].lower(), bool(m["end"]), m["attrs"])
        elif m["tag2"]:
            read(m["tag2"].lower(), bool(m["end2"]), "")
    if at < len(page):
        now.append((page[at:], link))
    close()
    return out


def features(found: list[Block]) -> np.ndarray:
    """A row for each block: words and link density of it, the one before and the one after; what it stands in."""
    n = len(found)
    best = max((b.main for b in found if not b.noise and not b.named), default=0)
    words = np.array([0, *(b.words for b in found), 0], float)
    linked = np.array([0, *(b.linked for b in found), 0], float) / np.maximum(words, 1)
    flags = np.array([(b.noise, 0 if not best else 1 if b.main >= best else -1, b.heading, b.listed, b.named) for b in found], float).reshape(n, 5)
    return np.c_[words[1:-1], linked[1:-1], words[:-2], linked[:-2], words[2:], linked[2:], flags]


#: Pages whose blocks are labelled by their first character: + main text, - boilerplate.
WRITTEN = (
    "<html><head><title>x</title></head><body><nav><ul><li><a href=/>-Home</a></li><li><a href=/n>-News of the day</a></li></ul></nav><div class=ad>-Buy the new thing today, now half the price for all of you.</div>"
    "<article><h1>+A headline of the story</h1><p>+Short.</p><p>+It was late when the train came in, and nobody on the platform had been told of it.</p><p>+Two words<br>+and so on</p><p>+<a href=/q>One link alone</a></p></article>"
    "<footer>-All rights reserved, the publisher of this page, in a long line of words that fills the footer</footer></body></html>",
    "<div id=menu><a href=/a>-Start</a> <a href=/b>About us</a></div><h1>+The river in spring</h1><p>+Water had risen over the lower meadows by the middle of March, and the ferry could no longer land on the eastern side.</p>"
    "<p>+For a week the village was an island; bread came by boat, and letters did not come at all until the wind had turned.</p><p>+No one complained.</p><p>+When the road came out of the water again it had moved, they said, by the width of a cart, which no map has ever shown.</p>"
    "<div class=comments><p>-I read this twice, what a lovely piece of writing, thank you for sharing it with all of us here.</p><p>-Same here</p></div><form>-Your name and a few words for the editor of this page please</form>",
    "<header>-The Daily Page, since the year of its founding the best paper in town</header><main><h2>+Council votes on bridge</h2><p>+The vote was close, and it came after a debate of nine hours in which the mayor left the room twice.</p><ul><li>+Cost: 4 million</li><li>+Work starts in May of next year if weather allows it</li></ul><p>+Ends.</p></main>"
    "<aside>-More news from the region that you may like to read after this one, picked for you</aside><div class='cookie-notice'>-We use cookies to give you the best experience on this site; by going on you accept them.</div>",
    "<div><a href=1>-One</a></div><div><a href=2>-Two of these</a></div><div><a href=3>-Three more links to follow here</a></div><p>-Log in</p><div>+There is a kind of stone that sweats before rain, and masons of the old sort would not set it in a wall that faced the weather.</div>"
    "<div>+My grandfather kept a piece of it on the sill and would look at it each morning before he decided on a coat or a hat.</div><div>-Page 2 of 9</div><div><a href=4>-Imprint</a> <a href=5>Privacy</a> <a href=6>Terms of use</a></div>",
    "<div class=sidebar>-Popular this week in all of our sections, as read by the people of the town and around it</div><article><header><h1>+On keeping bees</h1></header><p>+Bees dislike haste.</p><p>+A hive that is opened slowly on a warm day will hardly notice; the same hive in wind or shade will empty itself on your veil.</p>"
    "<aside>-Read also: our long guide to honey and wax and what to do with both of them</aside><ul><li><a href=1>-See the list of hives</a></li><li><a href=2>-More on bees</a></li></ul><p>+So wait.</p><blockquote>+Wait for the sun, and then wait a little longer.</blockquote><div class=share>-Share this</div></article><div class=newsletter>-Get a letter from us once a week with all that is new on bees and hives and honey</div>",
    "<p>-Search</p><p><a href=/l>-Archive of all the years</a></p><p>-Menu</p><h3>-Links</h3><p><a href=/k>-Contact and other ways to write to us</a></p><p>-2019</p>",
    "<article><p>+One.</p></article><p>-Text that stands outside of the article, although it is long and has no links in it at all, is not part of it.</p><article class=comment><p>-I don't think so, and I have said why in a longer letter to the editor last week.</p></article>",
    "<div>+Rain fell on the slates all night and in the morning the gutters still ran, though the sky was as blue as a plate.</div><div class=cookie>-This page keeps cookies on your device so that it can show you what it thinks you want to see, more of it every day.</div><div>+He went out.</div>"
    "<div>+By noon the lane was dry again and the hens had come back to the middle of it, where they had always been.</div><div class=sidebar>-The ten most read pieces of the last week, the month and the year, in the order in which our readers chose to open them</div>",
    "<nav>-All sections of this paper from the first to the last, with those that were closed and those that are to come soon</nav><p>+The harbour master keeps two books, one for the ships that came and one, much thicker, for those that were only expected.</p><p>+It is the second that people ask to see.</p>"
    "<section id=comments><p>-I knew him, and he kept three books, but nobody has ever been shown the third, so it may as well not have been there.</p><p>-Is that so? I should like to hear more about it from someone who was in town at that time.</p></section><footer>-This paper is printed on the harbour road and may not be copied in whole or in part without leave of those who print it</footer>",
    "<div class=post><p>+Be.</p><p>+Er in.</p><p>+A</p><table><tr><td>+Cell with text in it</td><td>+12</td></tr></table></div><p>-Outside</p><p>-Also outside the post, in a long line that has more than twelve words in it</p>",
)

#: Further labelled pages, made by rule.
MADE = 600


def _made(rng: random.Random) -> str:
    """A labelled page of random sizes: parts around and within a story, with or without an element that marks it."""
    text = lambda low, high: "word " * rng.randint(low, high)
    link = lambda n: f"<a href=/>{text(1, n)}</a>"
    size = lambda: rng.choice(((1, 4), (5, 25), (10, 40), (25, 90)))
    name = lambda: rng.choice(("", f" class=x{rng.randint(1, 99)}", f" class='{rng.choice(('legal', 'side', 'page', 'box'))}-{rng.choice(('history', 'effects', 'facts'))}'"))
    marker = rng.choice(("article", "main", "div class=post", "", ""))
    bare = not marker  # then nothing but words, links, kinds and names tells blocks apart
    links = lambda: rng.choice((
        "<nav><ul>" + "".join(f"<li><a href=/>-{text(1, 4)}</a></li>" for _ in range(rng.randint(1, 8))) + "</ul></nav>",
        "".join(f"<div{name()}><a href=/>-{text(1, 8)}</a></div>" for _ in range(rng.randint(1, 5))),
        f"<div>-{link(3)} | {link(3)} {link(3)}</div>",
        f"<table><tr><td>-{link(3)}</td><td>-{link(6)}</td></tr></table>",
        f"<form>-{text(1, 12)}<input></form>",
        f"<aside>-{text(3, 40)}</aside>",
    ))
    named = lambda: rng.choice((
        f"<div class={rng.choice(('ad', 'cookie-notice', 'newsletter', 'sidebar', 'promo-box'))}>-{text(4, 40)}</div>",
        f"<div id=comments><p>-{text(1, 60)}</p><p>-{text(1, 60)}</p></div>",
        f"<section class=comments><article class=comment><p>-{text(3, 60)}</p></article></section>",
        f"<div class=share-bar>-{link(2)} {link(2)}</div>",
    ))
    loose = lambda: f"<div{name()}>-{text(1, 4)}</div>" if bare else rng.choice((f"<div{name()}>-{text(1, 50)}</div>", f"<p>-{text(1, 60)}</p>", f"<h3>-{text(1, 6)}</h3><p>-{text(3, 40)}</p>"))
    story = [f"<h1>+{text(2, 9)}</h1>"] * (rng.random() < 0.8)
    for k in range(rng.randint(1, 7)):
        kind = rng.random()
        if kind < 0.6:
            story.append(f"<p>+{text(*(size() if k or not bare else (12, 60)))}{link(3) + text(1, 5) if rng.random() < 0.2 else ''}</p>")
        elif kind < 0.7:
            story.append(f"<blockquote{name()}>+{text(6, 40)}</blockquote>")
        elif kind < 0.8:
            story.append("<ul>" + "".join(f"<li>+{text(1, 12)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
        elif kind < 0.9:
            story.append(f"<div{name()}><p>+{text(8, 60)}</p></div>")
        elif bare:
            story.append(f"<p>+{text(10, 60)}</p>")
        else:
            story.append(rng.choice((f"<p><a href=/>+{text(1, 6)}</a></p>", named())))
    if bare:
        story.append(f"<p>+{text(10, 60)}</p>")
    body = "".join(story)
    around = lambda: "".join(rng.choice((links, links, named, loose))() for _ in range(rng.randint(0, 3)))
    foot = rng.choice(("", f"<footer>-{text(1, 30)}</footer>", f"<footer><p>-{text(2, 9)}</p><p>-{link(3)}</p></footer>"))
    return around() + (f"<{marker}>{body}</{marker.split()[0]}>" if marker else body) + around() + foot


@cache
def labelled() -> tuple[str, ...]:
    """The labelled pages: those written out and those made by rule."""
    rng = random.Random(7)
    return (*WRITTEN, *(_made(rng) for _ in range(MADE)))


@dataclass(slots=True)
class Node:
    feature: int = -1
    limit: float = 0.0
    left: Node | None = None
    right: Node | None = None
    main: bool = False


#: Blocks that a side of a split has at least.
LEAF = 10


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, of: int = 2) -> Node:
    """A tree by Gini impurity; ties go to the first feature and the lowest limit. The root splits by one of the first
    ``of`` features, a block's own words and links; names come last."""
    node = Node(main=bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.all() or not y.any():
        return node
    gini = lambda v: len(v) * 2 * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = gini(y) - 1e-9
    for f in range(of):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= LEAF and (g := gini(y[low]) + gini(y[~low])) < best - 1e-9:
                best, node.feature, node.limit = g, f, float(limit)
    if node.feature >= 0:
        low, every = x[:, node.feature] <= node.limit, x.shape[1]
        node.left, node.right = grow(x[low], y[low], depth - 1, every), grow(x[~low], y[~low], depth - 1, every)
    return node


@cache
def tree() -> Node:
    """The tree grown from the labelled pages."""
    x, y = [], []
    for page in labelled():
        found = blocks(page)
        y += [b.text[0] == "+" for b in found]
        x.append(features(found))
    return grow(np.concatenate(x), np.array(y, float))


def _is_main(row: list[float], node: Node) -> bool:
    while node.feature >= 0:
        node = node.left if row[node.feature] <= node.limit else node.right
    return node.main


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page; its blocks, and those that were kept."""
    found = [b for b in blocks(page) if not b.hidden]
    if not found:
        return "", 0, 0
    root = tree()
    kept = [b.text for b, row in zip(found, features(found).tolist(), strict=True) if _is_main(row, root)]
    return " ".join(kept), len(found), len(kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars, n_blocks, n_kept`` of each page."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [main_text(h) for h in b.column("html").to_pylist()]
            cols = [b.column("page_id"), b.column("url"), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, n_blocks long, n_kept long")
