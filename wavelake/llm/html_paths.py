"""Main text of web pages by tag-path ratios.

A page is read once into text blocks; each block has the path of tags from the root to it. Text length,
punctuation, blocks and linked text are summed for each path. The ratio of text to blocks and the ratio of
punctuation to blocks are spread back over the blocks in page order, smoothed over neighbours, fused by their
product and compared with a threshold. Paths whose blocks lie above it are content; they also choose the
region of the page: its article or main part, if they lie in one, or else the smallest container that holds all
of them. All blocks of that region belong to it, short ones and those at its ends too, unless they are mostly
links; so do headings right above it. What tags, roles and `hidden` declare as page furniture never counts. What
names of classes and ids say, or a form, only lowers the standing of an element:
* an id on a heading, a paragraph or another part of a text is the slug of its words and says nothing; on a list or table a sure one counts;
* what readers have written ("comments", "discussion-thread", an article of class "comment") is never part of the article;
* parts of a line that are hidden, or adverts by their class, are left out of it;
* an element that holds half of the page's plain text is no furniture, whatever its name (a page is often wrapped
  in "has-sidebar" or in a form); one with a name that is sure ("comments", "sidebar"), unless nearly all text;
* inside an article or main part only whole furniture names count ("related-posts", not "related-work"); there, and
  for ids everywhere, most only presume furniture: the element is content if its own ratio of text and punctuation is
  high enough. An article's own header ("entry-header") is none.

Defined results. A null or empty page has an empty text. Character references are decoded as HTML does; white
space inside a block becomes one space; blocks are trimmed, empty ones left out, and the rest joined by one
line feed in page order. Broken markup (missing ends, cut pages) is read to its end. Long pages are read whole.
Repeated rows each give a row. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import map_texts

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(class|id|href|role|hidden|style|aria-hidden|aria-label|itemprop|itemtype)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: Elements whose content is not text of the page; those of the first kind reach to the end of a page that doesn't end them.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
EMBEDDED = {"noscript", "template", "svg", "math", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements inside a line; all others begin and end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "ruby", "rt", "rp"}
#: Elements that don't bound an article; a region is never smaller than the container around them.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "blockquote", "pre", "table", "thead", "tbody", "tfoot", "tr", "th", "caption", "figure", "figcaption", "details", "summary", "address", "hgroup"}
#: Elements that the start of a block ends, if they are open.
ENDED_BY_BLOCK = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "li", "option"}
FURNITURE = {"nav", "header", "footer", "aside", "button", "select", "menu", "dialog", "fieldset", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "alert", "alertdialog", "dialog", "toolbar"}
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumb\w*|sidebar\w*|side|footer|foot|masthead|site-?header|page-?header|topbar|header|cookie\w*|consent\w*|gdpr|notice\w*|alert\w*|popup\w*|modal\w*|overlay\w*|comment\w*|disqus\w*|respond|reply|replies|reader-?comments|share\w*|social\w*|related\w*|recommend\w*|newsletter\w*|subscri\w*|signup|login|search\w*|widget\w*|pagination|pager|toolbar|copyright|legal|disclaimer|skip-?link\w*|hidden|tags|toc)(?=$|[\s_-])",
    re.I,
)
_PREFIXES = r"(?:(?:site|page|post|article|entry|main|top|bottom|left|right|global|primary|secondary|mobile|sticky|wp|wp-block|block|js|my|the|google|inline)[\s_-])*"
_SUFFIXES = r"(?:[_-](?:box|block|area|bar|lists?|links?|buttons?|btns?|icons?|container|wrapper|wrap|inner|outer|section|panel|widgets?|module|items?|posts?|articles?|stories|news|content|top|bottom|left|right|header|footer|heading|title|forms?|slot|unit|banner|menu|nav|media|tools|count|meta|cloud|input|text|message|thread|\d+))*"
#: Whole names that stand whatever the text, and those that inside a region the text's own ratio overrules.
_SURE = re.compile(rf"{_PREFIXES}(?:ads?|adv|adverts?|advertisements?|advertising|adsense|sponsor(?:s|ed)?|promos?|promotions?|promoted|sidebars?|masthead|breadcrumbs?|pagination|pager|comments?|commentlist|comment-?respond|disqus|respond|reader-?comments|newsletter|popups?|modals?|overlays?|skip-?links?|hidden){_SUFFIXES}")
_SURE_ID = re.compile(rf"{_PREFIXES}(?:ads?|adsense|comments?|commentlist|disqus|respond|reader-?comments|sidebars?){_SUFFIXES}|disqus_thread")
_PRESUMED = re.compile(rf"{_PREFIXES}(?:adverts?|advertisements?|advertising|sponsor(?:s|ed)?|promos?|promotions?|promoted|masthead|breadcrumbs?|pagination|pager|newsletter|popups?|modals?|overlays?|skip-?links?|hidden|banners?|nav|navbar|navigation|menus?|side|footer|foot|header|topbar|cookies?|consent|gdpr|notices?|alerts?|reply|replies|share|shares|sharing|sharedaddy|share(?:buttons?|bar|links)|socials?|related|related(?:posts?|links?|articles?)|recommend(?:s|ed|ations?)?|subscri(?:be|ption|ptions)|signup|login|search|search(?:form|box|bar)|widgets?|toolbar|copyright|legal|disclaimer|tags|toc){_SUFFIXES}")
#: Names of what readers have written: never the article, whatever else is there. "discussion" alone is a section of a paper.
_COMMENTS = re.compile(rf"{_PREFIXES}(?:(?:user|users|reader|readers|visitor|visitors|customer|public|fb|facebook|old|new|all|recent|nested|child|view|show)[_-])*(?:comments?|commentlist|commentary-list|comment-?respond|disqus|livefyre|talkback|guestbook|discussions|discussion[_-](?:threads?|lists?|board|area|box|forum|items?|posts?|wrapper|container)|(?:user|reader|visitor)s?[_-](?:responses?|replies|reply|feedback|discussions?|opinions?|posts?)|reader-?comments){_SUFFIXES}|(?:disqus|comment|comments)_thread")
_COMMENT_LABEL = re.compile(r"(?:(?:reader|user|visitor)s?'? )?comments?(?: section| list)?")
#: Class names of parts of a line that aren't the article's or aren't shown.
_INLINE_OUT = re.compile(rf"{_PREFIXES}(?:ads?|adv|adverts?|advertisements?|advertising|adsense|sponsored|promoted|promos?|promotions?|hidden|visually-hidden|visuallyhidden|sr-only|screen-reader-text){_SUFFIXES}")
#: Parts of a text that hold others; a name that is sure counts on them as on any container.
LISTS = {"ul", "ol", "dl", "table", "details", "blockquote", "figure"}
#: An article's own header, which holds its title.
_OWN_HEADER = re.compile(r"(?:post|entry|article|story|content|blog|news)[_-]?(?:header|head|heading|title)s?")
#: What names say of an element: nothing; furniture unless its own text says otherwise; unless it holds half of the page; surely, unless
#: there is hardly anything else; whatever else there is.
NOTHING, PRESUMED, LOOSE, SURE, NEVER = range(5)
CONTENT = {"article", "main"}
_MARKS = re.compile(r"[.,;:!?…。，；：！？、]")
SMOOTH = 2
THRESHOLD = 0.6
#: Shares of the page's plain text that overrule a name; with a sure name, other text may be no longer than REST.
HALF, NEARLY_ALL, REST = 0.5, 0.95, 200
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


@dataclass
class Flag:
    """A name that speaks against an element; up is the next one around it."""

    level: int
    up: Flag | None
    plain: int = 0
    void: bool = False


@dataclass
class Block:
    node: _Open
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def key(self) -> tuple[int, int]:
        return self.node.path, self.node.region

    @property
    def plain(self) -> int:
        return max(0, len(self.text) - self.linked)

    def flags(self) -> Iterator[Flag]:
        flag = self.node.flag
        while flag:
            yield flag
            flag = flag.up


@dataclass(eq=False)
class _Open:
    """An element: path is the number of its tag path; all elements inside it have starts from its own to `last`."""

    tag: str
    furniture: bool
    region: int
    path: int
    start: int
    up: _Open | None = None
    flag: Flag | None = None
    last: int = 0

    def holds(self, other: _Open) -> bool:
        return self.start <= other.start <= self.last


@lru_cache(1 << 14)
def _named(tag: str, classes: str, id_: str, inside: bool) -> int:
    """What the names of an element say."""
    if any(_COMMENTS.fullmatch(t) for t in classes.split()) or (tag not in TEXTUAL or tag in LISTS) and _COMMENTS.fullmatch(id_):
        return NEVER
    if tag in CONTENT and not inside:
        return NOTHING
    if tag in LISTS and _SURE_ID.fullmatch(id_):
        return SURE
    id_ = "" if tag in TEXTUAL else id_
    tokens = [t for t in classes.split() if not _OWN_HEADER.fullmatch(t)]
    if any(_SURE.fullmatch(t) for t in tokens) or _SURE_ID.fullmatch(id_):
        return SURE
    if not inside and _NAMES.search(" ".join(tokens)):
        return LOOSE
    if any(_PRESUMED.fullmatch(t) for t in tokens) or id_ and (_PRESUMED.fullmatch(id_) or not inside and _NAMES.search(id_)):
        return PRESUMED
    return NOTHING


def _attributes(written: str) -> dict[str, str]:
    return {a[0].lower(): a[1].strip("\"' ").lower() for a in _ATTRIBUTE.findall(written)}


def _hidden(names: dict[str, str]) -> bool:
    style = names.get("style", "").replace(" ", "")
    return "hidden" in names or names.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def _left_out(written: str) -> bool:
    """Whether a part of a line, by its attributes, isn't shown or is an advert."""
    names = _attributes(written)
    return bool(names) and (_hidden(names) or any(_INLINE_OUT.fullmatch(t) for t in names.get("class", "").split()))


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order, with trimmed text; in time proportional to the page, whatever its tags."""
    stack = [_Open("", False, 0, 0, 0)]
    found: list[Block] = []
    block: Block | None = None
    paths: dict[tuple[int, str], int] = {}
    depth_of: dict[str, list[int]] = {}
    never_ended: set[str] = set()
    regions, linked, at, n, made = 0, False, 0, len(page), 0
    #: The inline element that is left out: its tag, how many of that tag are open in it, and the element around it.
    muted, mutes, around = "", 0, None

    def end() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(unescape("".join(block.parts)).split())
            if block.text:
                found.append(block)
            block = None

    def close(depth: int) -> None:
        while len(stack) > depth:
            top = stack.pop()
            top.last = made
            depth_of[top.tag].pop()

    while at < n:
        token = _TOKEN.match(page, at)
        at = token.end()
        tag = token[2]
        if tag is None:
            text = token[0]
            if muted and around.last:
                muted = ""  # its end is missing, but what it stood in has ended
            if (text[0] != "<" or text == "<") and not muted:
                if block is None:
                    block = Block(stack[-1])
                block.parts.append(text)
                if linked:
                    block.linked += len(text)
            continue
        tag = tag.lower()
        if token[1]:
            if tag == "a":
                linked = False
            if tag == "br":
                end()
            if tag in INLINE:
                if tag == muted:
                    mutes -= 1
                    muted = muted if mutes else ""
                continue
            if depth_of.get(tag):
                end()
                close(depth_of[tag][-1])
            continue
        if tag in RAW or tag in EMBEDDED:
            if not token[3].rstrip().endswith("/"):
                stop = None if tag in never_ended else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in RAW:
                    at = n
                else:
                    never_ended.add(tag)
            continue
        if tag in INLINE:
            if tag not in VOID and not token[3].rstrip().endswith("/"):
                if tag == muted:
                    mutes += 1
                elif not muted and token[3] and _left_out(token[3]):
                    muted, mutes, around = tag, 1, stack[-1]
            if tag == "a":
                linked = any(a[0].lower() == "href" for a in _ATTRIBUTE.findall(token[3]))
            continue
        end()
        if tag in VOID:
            continue
        if stack[-1].tag == "head":
            close(len(stack) - 1)
        if tag in ENDED_BY_BLOCK or tag not in ("tr", "td", "th", "tbody", "thead"):
            ends = {"li"} if tag == "li" else {"dt", "dd"} if tag in ("dt", "dd") else {"p", *HEADINGS}
            while len(stack) > 1 and stack[-1].tag in ends:
                close(len(stack) - 1)
        top, names = stack[-1], _attributes(token[3])
        region = top.region
        if tag in CONTENT or names.get("role") in ("main", "article") or names.get("itemprop") == "articlebody":
            region = regions = regions + 1
        said = NOTHING if tag in ("html", "body") else _named(tag, names.get("class", ""), names.get("id", ""), bool(top.region if tag in CONTENT else region))
        if names.get("itemprop") == "comment" or names.get("role") == "comment" or names.get("itemtype", "").endswith("schema.org/comment") or _COMMENT_LABEL.fullmatch(names.get("aria-label", "")):
            said = NEVER
        hides = _hidden(names)
        own = tag in FURNITURE or names.get("role") in ROLES or hides
        if tag == "header" and region and not said:
            own = False  # an article's own header holds its title
        if tag == "form" or names.get("role") == "form":
            said = max(said, LOOSE)
        made += 1
        depth_of.setdefault(tag, []).append(len(stack))
        stack.append(_Open(tag, top.furniture or own, region, paths.setdefault((top.path, tag), len(paths) + 1), made, top, Flag(said, top.flag) if said else top.flag))
    end()
    close(1)
    stack[0].last = made
    return found


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-SMOOTH, SMOOTH + 1) / 1.0) ** 2)
    return np.convolve(x, kernel, "full")[SMOOTH : SMOOTH + len(x)] / np.convolve(np.ones(len(x)), kernel, "full")[SMOOTH : SMOOTH + len(x)]


def _container(nodes: list[_Open]) -> _Open:
    """The smallest element that holds all nodes and isn't itself a part of a text."""
    top = nodes[0]
    for node in nodes[1:]:
        while not top.holds(node):
            top = top.up
    while top.tag in TEXTUAL:
        top = top.up
    return top


def _weigh(b: Block) -> tuple[int, float]:
    return b.plain, len(_MARKS.findall(b.text)) * (b.plain / max(1, len(b.text)))


def _ratios(open_: list[Block]) -> tuple[np.ndarray, float]:
    """The fused ratio of each block and the threshold."""
    of_path: dict[tuple[int, int], list[float]] = {}
    for b in open_:
        sums = of_path.setdefault(b.key, [0.0, 0.0, 0.0])
        plain, marks = _weigh(b)
        sums[0] += plain
        sums[1] += marks
        sums[2] += 1
    length = np.array([of_path[b.key][0] / of_path[b.key][2] for b in open_])
    marks = np.array([of_path[b.key][1] / of_path[b.key][2] for b in open_])
    fused = np.sqrt(_smooth(length) * (_smooth(marks) + 0.1))
    weight = np.array([len(b.text) for b in open_], float)
    return fused, THRESHOLD * float((fused * weight).sum() / weight.sum())


def _void_large(shown: list[Block]) -> None:
    """Takes back names of elements that hold too much of the page's plain text to be its furniture."""
    total = sum(b.plain for b in shown)
    for b in shown:
        for flag in b.flags():
            flag.plain += b.plain
    for b in shown:
        for flag in b.flags():
            flag.void = flag.plain >= HALF * total if flag.level < SURE else flag.level == SURE and flag.plain >= NEARLY_ALL * total and total - flag.plain <= REST


def _void_rich(shown: list[Block]) -> None:
    """Takes back names that only presume furniture where the element's own ratio says content."""
    standing = [b for b in shown if all(f.void for f in b.flags())]
    least = _ratios(standing)[1] if standing else 0.0
    doubtful: dict[int, tuple[Flag, list[float]]] = {}
    for b in shown:
        for flag in b.flags():
            if not flag.void and flag.level == PRESUMED:
                sums = doubtful.setdefault(id(flag), (flag, [0.0, 0.0, 0.0, 0.0]))[1]
                plain, marks = _weigh(b)
                for i, x in enumerate((plain, marks, 1, len(b.text))):
                    sums[i] += x
    for flag, (plain, marks, n, size) in doubtful.values():
        flag.void = bool(plain >= 0.5 * size and np.sqrt(plain / n * (marks / n + 0.1)) >= least)


def content(found: list[Block]) -> list[Block]:
    """The blocks that are the page's main text."""
    shown = [b for b in found if not b.node.furniture]
    _void_large(shown)
    _void_rich(shown)
    open_ = [b for b in shown if all(f.void for f in b.flags())]
    if not open_:
        return []
    fused, least = _ratios(open_)
    good = {b.key for b, f in zip(open_, fused, strict=True) if f >= least}
    text_in: dict[int, float] = {}
    for b in open_:
        if b.key in good:
            text_in[b.node.region] = text_in.get(b.node.region, 0.0) + b.plain
    inside = {r: t for r, t in text_in.items() if r}
    if not inside and any(b.node.region for b in open_):
        inside = {b.node.region: 0.0 for b in open_ if b.node.region}
    if inside and sum(inside.values()) >= 0.2 * sum(text_in.values()):
        most = max(inside.values())
        return [b for b in open_ if b.node.region in inside and (inside[b.node.region] >= 0.3 * most or b.key in good)]
    at = [i for i, b in enumerate(open_) if b.key in good]
    around = _container([open_[i].node for i in at])
    kept = {i for i, b in enumerate(open_) if around.holds(b.node) and (b.key in good or b.linked <= 0.5 * len(b.text))}
    parent, first = {open_[i].node.up.path for i in at if open_[i].node.up}, min(kept)
    while first > 0 and (node := open_[first - 1].node).tag in HEADINGS and (node.up.path in parent or node.up.holds(around)):
        first -= 1
        kept.add(first)
    return [b for i, b in enumerate(open_) if i in kept]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks(page or "")))


def extract(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars of every page; nothing is shuffled."""
    name = "wavelake_key"
    keyed = pages.select(F.struct(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url")).alias(name), F.col(html))

    def run(keys: list, texts: list[str]) -> dict[str, list]:
        out = [main_text(t) for t in texts]
        return {"page_id": [k["page_id"] for k in keys], "url": [k["url"] for k in keys], "text": out, "n_chars": [len(t) for t in out]}

    return map_texts(keyed, "page_id bigint, url string, text string, n_chars bigint", run)
