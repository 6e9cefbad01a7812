"""Main-text extraction from HTML as a maximum-scoring subsequence.

A page becomes a sequence of words and tags in page order. A word scores the log-odds that it belongs
to the main text, positive in prose and negative in what looks like a menu, footer or advert; a tag
scores negative, more so where its block is mostly links. One scan from left to right finds the
contiguous region with the greatest sum (the earliest of equals), which is widened to whole blocks; of
its blocks those whose words score negative are left out, such as a share bar or the readers' comments
within an article. Outside an article or main element nothing else decides on the region; inside one, the negative
scores are bounded for the scan, so that a long table or a menu does not cut the article in two. The element
(div, section and the like, not the body) that directly holds most of the region's words gives its other
blocks with positive words too, such as a short title before a box, around which the scan goes.

The weights are learned from labelled pages (``labelled_pages``) by two logistic regressions, of
words and of tags. Features of a word: the element it is in (article or main, menu, header, footer,
aside, form), whether its block is a heading or mostly links, and the parts of the class and id names
around it, each by what the labelled pages show of it, once for a container and once for the block
itself. Names are no features where their element is a wrapper (has-sidebar, search-page): it holds the
page's main element; an article, unless it stands beside a main; or, with no article or main beside it,
at least half of the words outside links of the article, main or page that it is in (not if it is named as
comments, of which there may be more than of the article).

Hard rules are left for what is never text: scripts, styles, the head, form controls, embedded objects
and hidden elements. A header inside an article or main contributes its headings only.

Character references are decoded, white space inside a block becomes one space, blocks are
trimmed, empty ones left out, and the rest joined by one newline. ``<br>`` counts as white space.

Null and empty html give the empty text; so does a page without words in its body. Broken
markup is read as far as it goes: an unclosed element ends with its parent, a tag with an unclosed
quote at the next >. Very long pages are read whole. Repeated rows and rows without an id give repeated
results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by what they mean for the text.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video xmp noframes".split())
HARD = frozenset("button select option input textarea frameset noframes".split()) | RAW
#: Elements, and roles that mean the same, as a feature of their words.
ZONES = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "aside"}
ROLES = {"navigation": "nav", "menu": "nav", "menubar": "nav", "tablist": "nav", "toolbar": "nav", "banner": "header", "contentinfo": "footer", "complementary": "aside", "search": "form", "form": "form", "dialog": "aside", "alertdialog": "aside"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Parts of class and id names by which pages tell what is not the main text; the labelled pages use them.
BESIDE_NAMES = {
    "advert": "ad ads adv advert adverts advertisement advertising adslot adbox adsense sponsor sponsored sponsors promo promos promotion promoted".split(),
    "menu": "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pager pagination paging toc tabs toolbar topbar".split(),
    "links": "sidebar sidebars aside rail widget widgets related recommended recommendations trending popular share sharing social follow".split(),
    "comments": "comment comments commentlist respond reply replies disqus discussion reactions".split(),
    "notice": "notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login signin paywall disclaimer copyright footer masthead".split(),
    "form": "form searchbox search register".split(),
}
#: Names that occur on the main text's own elements just as well.
OWN_NAMES = "content post entry story article body text lead intro summary main page section legal header alert banner skip foot hidden popular".split()
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())  # any other tag ends the head
#: Block elements that hold other blocks; a name on one of the others is the block's own.
CONTAINERS = frozenset("aside body center details dialog div dl fieldset figure footer form header html main nav ol section table tbody tfoot thead tr ul article hgroup menu".split())
HOMES = frozenset("div section article main center td".split())  # elements that hold an article's blocks
COMMENT_NAMES = frozenset("comment comments commentlist reply replies respond".split())  # an article named so is a reader's
KIND_OF = {name: kind for kind, names in BESIDE_NAMES.items() for name in names}
_CLOSED_BY = {"p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_QUOTED = r"""(?>(?:[^>"']|"[^"]*"(?=[\s/>])|'[^']*'(?=[\s/>]))*)(?=>|\Z)"""
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)(" + _QUOTED + r"|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")


def _names(attributes: str) -> set[str]:
    """Parts of the class and id names."""
    return {part for key, value in _ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id") for part in _NAME.findall(value.lower())}


def _zone_of(name: str, attributes: str) -> str | None:
    """The feature that an element gives its words; "hard" if they are no text at all."""
    if name in HARD:
        return "hard"
    zone = ZONES.get(name)
    for key, value in _ATTRIBUTE.findall(attributes) if "=" in attributes or "hidden" in attributes else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return "hard"
        if key == "role" and value in ROLES:
            zone = ROLES[value]
    return zone


class _Part:
    """A named or form element, or a scope (the page, a main, an article), while the page is read."""

    __slots__ = ("up", "scope", "names", "in_main", "words", "mains", "articles", "features")

    def __init__(self, up: _Part | None, scope: _Part | None = None, names: frozenset[str] = frozenset(), in_main: bool = False):
        self.up, self.scope, self.names, self.in_main = up, scope, names, in_main  # up: the next one of its kind around it
        self.words = self.mains = self.articles = 0
        self.features: frozenset[str] = frozenset()

    def add(self, words: int = 0, mains: int = 0, articles: int = 0) -> None:
        part: _Part | None = self
        while part is not None:
            part.words, part.mains, part.articles = part.words + words, part.mains + mains, part.articles + articles
            part = part.up

    def is_wrapper(self, page: _Part) -> bool:
        if self.mains or self.articles:
            return bool(self.mains or self.in_main or not page.mains)
        if any(KIND_OF.get(n) == "comments" for n in self.names):
            return False  # readers may well write more than the article has
        return not (self.scope.mains or self.scope.articles) and 0 < self.scope.words <= 2 * self.words


@dataclass(slots=True)
class _Open:
    """An open element with what holds for all that is in it."""

    name: str = ""
    hard: bool = False
    zones: frozenset[str] = frozenset()
    inside: bool = False  # in an article or main
    in_main: bool = False
    link: bool = False
    heading: bool = False
    own_header: bool = False  # in the header of an article, of which the headings alone are text
    part: _Part | None = None
    scope: _Part | None = None
    home: int = 0


@dataclass(slots=True)
class Event:
    """A tag, or a run of text, with its features and the number of its block."""

    tag: str  # empty for text
    text: str
    block: int
    features: frozenset[str]
    inside: bool
    link: bool = False
    home: int = 0  # the number of the innermost element of ``HOMES`` around it; 0: none


def events(html: str) -> list[Event]:
    """Tags and runs of text in page order, without what is never text."""
    out: list[tuple[Event, _Part | None]] = []
    page = _Part(None)
    bottom = _Open(scope=page)
    stack: list[_Open] = []
    parts: list[_Part] = []  # outer ones first
    own_names: dict[int, frozenset[str]] = {}  # names of the innermost block element of a block
    block = at = homes = 0

    def text(run: str) -> None:
        if not run:
            return
        blank = run.isspace()
        if stack and stack[-1].name == "head" and not blank:
            stack.pop()
        top = stack[-1] if stack else bottom
        if top.hard:
            return
        if top.own_header and not top.heading and not blank:
            return
        features = top.zones | {"heading"} if top.heading else top.zones
        out.append((Event("", " " if blank else unescape(run), block, features, top.inside, top.link, top.home), top.part))
        if not blank and not top.link:
            n = len(run.split())
            top.scope.add(n)
            if top.part is not None:
                top.part.add(n)

    while (found := _TOKEN.search(html, at)) is not None:
        text(html[at : found.start()])
        at = found.end()
        name = (found[2] or "").lower()
        if not name:
            continue
        top = stack[-1] if stack else bottom
        if name in BLOCKS:
            block += 1
        elif name == "br" and not top.hard:
            out.append((Event("", " ", block, top.zones, top.inside, home=top.home), top.part))
        if found[1]:
            if any(o.name == name for o in stack):
                while stack.pop().name != name:
                    pass
        else:
            while stack and (name in _CLOSED_BY.get(stack[-1].name, ()) or stack[-1].name == "head" and name not in IN_HEAD):
                stack.pop()
            top = stack[-1] if stack else bottom
            zone = _zone_of(name, found[3])
            if name in RAW and not found[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                if end is not None:
                    at = end.end()
                elif name in ("script", "style", "title", "textarea"):
                    at = len(html)
            elif name not in VOID and not (found[3].endswith("/") and name not in BLOCKS):
                hard = top.hard or zone == "hard" or name == "head"
                opened = _Open(name, hard, top.zones, top.inside, top.in_main or name == "main", top.link or name == "a", top.heading or name in HEADINGS, top.own_header or name == "header" and top.inside, top.part, top.scope, top.home)
                if name in HOMES:
                    homes += 1
                    opened.home = homes
                if name in ("article", "main") and not hard:
                    if name == "main" or COMMENT_NAMES.isdisjoint(_names(found[3])):
                        for part in filter(None, (top.scope, top.part)):
                            part.add(mains=name == "main", articles=name == "article")
                        opened.scope = _Part(top.scope)
                        opened.inside = True
                    else:
                        opened.zones = top.zones | {"name comments"}
                elif not hard:
                    names = frozenset(_names(found[3])) if "=" in found[3] and name not in ("html", "body") else frozenset()
                    if name in BLOCKS and name not in CONTAINERS:
                        own_names[block] = names
                    elif names or zone == "form":
                        opened.part = _Part(top.part, top.scope, names | ({"<form>"} if zone == "form" else frozenset()), top.in_main)
                        parts.append(opened.part)
                    if zone and zone != "form" and not (name == "header" and top.inside):
                        opened.zones = top.zones | {zone}
                stack.append(opened)
        if not top.hard:
            out.append((Event(name, "", block, top.zones, top.inside), top.part))
    text(html[at:])
    for part in parts:
        inherited = part.up.features if part.up is not None else frozenset()
        if part.is_wrapper(page):
            part.features = inherited
        else:
            part.features = inherited | {"form" if n == "<form>" else f"name {n}" for n in part.names} | {f"kind {KIND_OF[n]}" for n in part.names if n in KIND_OF}
    words, linked = Counter(), Counter()
    for event, _ in out:
        if event.text:
            n = len(event.text.split())
            words[event.block] += n
            linked[event.block] += n * event.link
    for event, part in out:
        if part is not None:
            event.features |= part.features
        if own := own_names.get(event.block):
            event.features |= {f"own {n}" for n in own} | {f"own kind {KIND_OF[n]}" for n in own if n in KIND_OF}
        if 2 * linked[event.block] > words[event.block]:
            event.features |= {"links inside" if event.inside else "links"}
        if event.inside:
            event.features |= {"inside"}
    return [event for event, _ in out]


def best_region(scores: Iterable[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest positive sum; (0, 0) if there is none."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i + 1)
    return region


@dataclass
class Weights:
    """Log-odds of words and tags, by feature."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)

    def word(self, event: Event) -> float:
        return self.words.get("", 0.0) + sum(self.words.get(f, 0.0) for f in event.features)

    def tag(self, event: Event) -> float:
        return min(self.tags.get("", 0.0) + self.tags.get(f"<{event.tag}>", 0.0) + sum(self.tags.get(f, 0.0) for f in event.features & _OF_TAGS), -0.05)


_OF_TAGS = frozenset(("inside", "links", "links inside", "nav", "header", "footer", "aside"))


def _logistic(rows: Counter[tuple[frozenset[str], bool]], l2: float = 0.5, steps: int = 600) -> dict[str, float]:
    """Weights of a ridge regression on counted (features, is main text), by accelerated gradient steps."""
    names = sorted({f for features, _ in rows for f in features})
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for k, (features, _) in enumerate(rows):
        x[k, [place[f] for f in features]] = 1
    y = np.array([good for _, good in rows], float)
    n = np.array(list(rows.values()), float)
    rate = 4 / (np.linalg.norm(x * np.sqrt(n)[:, None], 2) ** 2 + 4 * l2)
    w = ahead = np.zeros(len(names))
    for step in range(steps):
        gradient = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ ahead, -50, 50))) - y)) + l2 * ahead
        new = ahead - rate * gradient
        ahead = new + step / (step + 3) * (new - w)
        w = new
    return {f: round(float(w[k]), 4) for f, k in place.items()}


def learn(pages: Iterable[tuple[str, list[str]]]) -> Weights:
    """Weights from html with its main blocks."""
    words: Counter[tuple[frozenset[str], bool]] = Counter()
    tags: Counter[tuple[frozenset[str], bool]] = Counter()
    for html, blocks in pages:
        wanted = set(blocks)
        stream = events(html)
        texts: dict[int, str] = {}
        for event in stream:
            texts[event.block] = texts.get(event.block, "") + event.text
        chosen = {b for b, t in texts.items() if " ".join(t.split()) in wanted}
        first, last = (min(chosen), max(chosen)) if chosen else (0, -1)
        for event in stream:
            if event.tag:
                tags[(event.features & _OF_TAGS) | {"", f"<{event.tag}>"}, first <= event.block <= last] += 1
            elif not event.text.isspace():
                words[event.features | {""}, event.block in chosen] += len(event.text.split())
    return Weights(_logistic(words), _logistic(tags))


def extract(html: str | None, weights: Weights) -> str:
    """The main text of one page."""
    if not html:
        return ""
    stream = events(html)
    scores, total, blocks, home_of = [], Counter(), {}, {}
    for event in stream:
        if event.tag:
            score = max(weights.tag(event), -0.05 if event.inside else -2.0)
        else:
            blocks.setdefault(event.block, []).append(event.text)
            home_of.setdefault(event.block, event.home)
            n = len(event.text.split())
            each = min(max(weights.word(event), -3.0), 3.0)
            total[event.block] += each * n
            score = n * (max(each, -0.05) if event.inside else each)
        scores.append(score)
    start, end = best_region(scores)
    if start == end:
        return ""
    first, last = stream[start].block, stream[end - 1].block
    # What stands in the region's own element belongs to it, though an advert or a box cuts it off: the scan goes
    # around a short title, or a last paragraph, that costs less than what lies between.
    words_in = Counter()
    for block in blocks:
        if first <= block <= last and total[block] > 0:
            words_in[home_of[block]] += sum(len(run.split()) for run in blocks[block])
    home = max(words_in, key=lambda h: (words_in[h], -h), default=0)
    if home:
        own = [block for block in blocks if home_of[block] == home and total[block] > 0]
        first, last = min(first, *own), max(last, *own)
    return "\n".join(filter(None, (" ".join("".join(runs).split()) for block, runs in blocks.items() if first <= block <= last and total[block] > 0)))


# ---- labelled pages -----------------------------------------------------------------------

_NOUNS = "river mill path ridge harbour ferry baker oven bread engine station winter garden market teacher bridge letter window engineer doctor forest valley captain museum orchard".split()
_VERBS = "follows crosses opens reaches leaves builds repairs carries remembers watches describes measures".split()
_MORE = "slowly before noon in spring after the storm beside the old wall for thirty years with great care without any help".split()


def labelled_pages(n: int = 400, seed: int = 1) -> Iterator[tuple[str, list[str]]]:
    """Pages composed by rule, with the blocks of their main text.

    Each has an article in one of the usual containers, of headings, paragraphs, lists, tables, quotes
    and lists of sources, and around it (of some also inside) menus, adverts, link boxes, notices, forms
    and comments, under the names that such parts commonly have.
    """
    for k in range(n):
        dice = random.Random(seed * 10_007 + k)

        def words(low: int, high: int, dice: random.Random = dice) -> str:
            out: list[str] = []
            while len(out) < high:
                out += ["the", dice.choice(_NOUNS), dice.choice(_VERBS), "the", dice.choice(_NOUNS), *dice.sample(_MORE, 3)]
            return " ".join(out[: dice.randint(low, high)]).capitalize()

        def links(low: int, high: int, dice: random.Random = dice, words=words) -> str:
            return "<ul>" + "".join(f"<li><a href='/{i}'>{words(1, 4)}</a></li>" for i in range(dice.randint(low, high))) + "</ul>"

        main: list[str] = []

        def own(tag: str, text: str, inner: str | None = None, main: list[str] = main, dice: random.Random = dice) -> str:
            main.append(" ".join(re.sub("<[^>]*>", "", text).split()))
            name = f" class='{dice.choice(OWN_NAMES)}'" if dice.random() < 0.15 else ""
            return f"<{tag}{name}>{text}</{tag}>"

        def beside(kind: str | None = None, dice: random.Random = dice, words=words, links=links) -> str:
            kind = kind or dice.choice([*BESIDE_NAMES, "nav", "header", "footer", "aside"])
            body = {"advert": words(4, 16), "notice": f"<p>{words(6, 25)}</p>", "comments": "".join(f"<p>{words(5, 30)}</p>" for _ in range(dice.randint(1, 6))), "header": f"<h1>{words(2, 4)}</h1><p>{words(3, 8)}</p>", "footer": words(4, 14), "form": f"<label>{words(1, 3)}</label><input><p>{words(2, 6)}</p>"}.get(kind) or links(2, 12)
            if kind in ("aside", "links") and dice.random() < 0.5:
                body = f"<h3>{words(1, 4)}</h3><p>{words(6, 30)}</p>"
            if kind in ("nav", "header", "footer", "aside"):
                return f"<{kind}>{body}</{kind}>"
            name = dice.choice(BESIDE_NAMES[kind])
            mark = dice.choice((f"class='{name}'", f"id='{name}'", f"class='box {name}-{dice.randint(1, 9)}'"))
            return f"<form {mark}>{body}</form>" if kind == "form" and dice.random() < 0.5 else f"<p {mark}>{words(4, 12)}</p>" if kind == "advert" and dice.random() < 0.2 else f"<div {mark}>{body}</div>"

        container = dice.choice(("article", "main", "div", "div class='content'", "div id='story'", "section class='post'", "article class='entry'"))
        inner = []
        if dice.random() < 0.8:
            inner.append(own("h1", words(2, 8)))
        for _ in range(dice.randint(2, 7)):
            shape = dice.random()
            if shape < 0.62:
                text = words(15, 80)
                inner.append(own("p", text.replace("the river", "the <a href='/r'>river</a>").replace("spring", "<b>spring</b>")))
            elif shape < 0.72:
                inner.append(own("h2", words(2, 6)))
            elif shape < 0.8:
                inner.append("<ul>" + "".join(own("li", words(3, 14)) for _ in range(dice.randint(2, 8))) + "</ul>")
            elif shape < 0.86:
                inner.append("<table>" + "".join("<tr>" + "".join(own("td", words(1, 4)) for _ in range(3)) + "</tr>" for _ in range(dice.randint(2, 12))) + "</table>")
            elif shape < 0.9:
                inner.append(own("blockquote", words(8, 30)))
            elif shape < 0.93 and container.startswith(("article", "main")):
                inner.append("<ul>" + "".join(own("li", f"<a href='/s{i}'>{words(2, 6)}</a>") for i in range(dice.randint(2, 6))) + "</ul>")
            else:
                inner.append(beside(dice.choice(("advert", "links", "comments", "notice"))))
        body = f"<{container}>{''.join(inner)}</{container.split()[0]}>"
        above = "".join(beside(kind) for kind in dice.sample(("nav", "menu", "header", "advert", "notice", "form", "links"), dice.randint(1, 4)))
        below = "".join(beside(kind) for kind in dice.sample(("footer", "links", "comments", "advert", "aside", "notice", "menu"), dice.randint(1, 4)))
        if dice.random() < 0.3:
            above += f"<div>{links(3, 9)}</div>"
        yield f"<html><head><title>{words(2, 6)}</title></head><body>{above}{body}{below}</body></html>", main


_WEIGHTS: list[Weights] = []


def default_weights() -> Weights:
    if not _WEIGHTS:
        _WEIGHTS.append(learn(labelled_pages()))
    return _WEIGHTS[0]


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages(page_id, url, html)``."""
    chosen = weights or default_weights()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                texts = [extract(html.as_py(), chosen) for html in batch.column(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
