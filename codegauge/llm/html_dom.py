"""HTML to a tree of block elements and text blocks, as far as telling content from the rest needs it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

TAG_GROUPS = {name: n for n, names in enumerate((
    ("#text",), ("html", "body"), ("article",), ("main",), ("section",), ("div", "center"), ("p",), ("h1",),
    ("h2", "h3", "h4", "h5", "h6", "hgroup"), ("ul", "ol", "dl", "dir"), ("li", "dt", "dd"), ("nav", "menu"), ("header",),
    ("footer",), ("aside",), ("form", "fieldset", "legend", "label", "button", "select", "option", "output"),
    ("table", "thead", "tbody", "tfoot", "caption"), ("tr",), ("td", "th"), ("blockquote", "pre"), ("figure", "figcaption"),
    ("dialog",), ("details", "summary", "address", "hr"))) for name in names}
GROUPS = max(TAG_GROUPS.values()) + 1
_BLOCK = set(TAG_GROUPS) - {"#text"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "title", "textarea", "iframe", "template", "svg", "xmp", "noframes"}
_IN_HEAD = {"html", "head", "base", "basefont", "bgsound", "link", "meta", "title", "noscript", "noframes", "style", "script", "template"}
_HTML_SPACE = " \t\n\f\r"
# an opening tag closes these, up to the nearest of those
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr",)), "th": (("td", "th"), ("tr",)),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot"), ("table",)), "option": (("option",), ("select",)),
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # a quote opens a value only right behind an equals sign; an unquoted value ends at white space or the tag's end
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+)?)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_NAMES = {"class", "id", "role", "aria-label", "itemprop", "data-testid", "data-component", "data-role"}

#: Words of class, id, role and label attributes, by what they usually name.
CUES = (
    ("ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adslot", "adbox", "sponsor", "sponsored", "sponsors",
     "promo", "promoted", "promotion", "promotions", "dfp", "adsbygoogle", "commercial", "affiliate"),
    ("nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs", "crumbs", "pagination", "pager", "tabs", "toc", "sitemap", "skip"),
    ("header", "masthead", "topbar", "top", "branding", "banner", "logo", "hero"),
    ("footer", "foot", "bottom", "copyright", "colophon", "legal", "contentinfo", "imprint"),
    ("sidebar", "side", "aside", "rail", "widget", "widgets", "complementary", "secondary", "sidebox"),
    ("cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert", "modal", "popup", "overlay", "toast",
     "paywall", "warning", "announcement", "dialog", "privacy", "message", "disclaimer", "interstitial"),
    ("form", "subscribe", "subscription", "newsletter", "signup", "login", "register", "search", "searchbox", "contact", "survey", "poll", "signin"),
    ("comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reviews", "responses", "feedback", "thread", "reader"),
    ("share", "sharing", "social", "follow", "like", "buttons", "toolbar", "actions", "tools", "print"),
    ("related", "recommended", "recommendations", "recirc", "popular", "trending", "more", "latest", "readmore", "teaser", "suggested", "also"),
    ("article", "content", "post", "entry", "main", "story", "text", "prose", "articlebody", "body", "page", "maincontent"),
    ("meta", "byline", "author", "date", "tags", "tag", "categories", "bio", "timestamp", "info"),
)
NOTICE_CUE, CONTENT_CUE = 5, 10
_CUE_OF = {word: n for n, words in enumerate(CUES) for word in words}


@dataclass
class Tree:
    """Nodes in page order, so a parent comes before its children; text blocks are leaves of group 0."""
    parent: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    cues: list[int] = field(default_factory=list)       # bits of CUES, and one above them for hidden elements
    text: list[str] = field(default_factory=list)
    links: list[int] = field(default_factory=list)      # characters inside links

    def add(self, parent: int, group: int, cues: int, text: str = "", links: int = 0) -> int:
        self.parent.append(parent)
        self.group.append(group)
        self.cues.append(cues)
        self.text.append(text)
        self.links.append(links)
        return len(self.parent) - 1


def attribute_cues(raw: str, known: dict[str, int]) -> int:
    """Bits of the cues that an element's attributes hold; ``known`` remembers strings seen before."""
    bits = known.get(raw)
    if bits is None:
        bits = 0
        for m in _ATTRIBUTE.finditer(raw):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name in _NAMES:
                for word in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower()):
                    if word in _CUE_OF:
                        bits |= 1 << _CUE_OF[word]
            elif name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true":
                bits |= 1 << len(CUES)
        if re.search(r"(?:^|\s)hidden(?:\s|$|/)", re.sub(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)", " ", raw)):
            bits |= 1 << len(CUES)
        if len(known) < 10_000:     # a memory, not a limit: more strings are worked out each time
            known[raw] = bits
    return bits


def parse(page: str, known: dict[str, int]) -> Tree:
    """The tree of one page; never fails, whatever the markup."""
    tree = Tree()
    root = tree.add(-1, TAG_GROUPS["body"], 0)
    stack: list[tuple[str, int]] = []      # open elements: tag, node (-1: inline)
    owner, anchors, link_chars, in_head = root, 0, 0, False
    pieces: list[str] = []

    def flush() -> None:
        nonlocal link_chars
        if pieces:
            words = "".join(pieces).split()
            if words:
                tree.add(owner, 0, 0, " ".join(words), link_chars)
            pieces.clear()
        link_chars = 0

    def say(raw: str) -> None:
        nonlocal link_chars, in_head
        if raw and (not in_head or raw.strip(_HTML_SPACE)):
            in_head = False
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if anchors:
                link_chars += len(text.strip())

    def pop_to(k: int) -> None:
        nonlocal owner, anchors
        flush()
        for tag, _ in stack[k:]:
            anchors -= tag == "a"
        del stack[k:]
        owner = next((node for _, node in reversed(stack) if node >= 0), root)

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>"))
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "head":
                if in_head:
                    pieces.clear()
                in_head = False
            elif tag in _BLOCK or (tag, owner) in stack:
                flush()
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        pop_to(k)
                        break
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][1] >= 0:
                        break
                    if stack[k][0] == tag:
                        anchors -= tag == "a"
                        del stack[k]
                        break
            continue
        if in_head and tag not in _IN_HEAD:     # both the end of the head and the body tag may be left out
            in_head = False
            pieces.clear()
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "head":
            in_head = not stack and len(tree.parent) == 1 and not "".join(pieces).strip()
            continue
        if tag in ("br", "wbr", "img", "input") or tag in _VOID and tag != "hr":
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in _BLOCK:
            flush()
            if tag not in ("option", "button", "label", "select"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        pop_to(k)
                        break
                    if stack[k][1] >= 0:
                        break
            if tag in _CLOSES:
                ended, stop = _CLOSES[tag]
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in ended:
                        pop_to(k)
                        break
                    if stack[k][0] in stop:
                        break
            if tag in ("html", "body", "hr"):
                if tag != "hr":
                    tree.cues[root] |= attribute_cues(m[3], known) & ~(1 << CONTENT_CUE)
                continue
            owner = tree.add(owner, TAG_GROUPS[tag], attribute_cues(m[3], known))
            stack.append((tag, owner))
        elif tag == "noscript" and owner == root and not in_head:      # what a whole page says to those without scripts
            flush()
            owner = tree.add(owner, TAG_GROUPS["details"], attribute_cues(m[3], known) | 1 << NOTICE_CUE)
            stack.append((tag, owner))
        else:
            anchors += tag == "a"
            stack.append((tag, -1))
    flush()
    return tree
