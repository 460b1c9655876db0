"""A web page as blocks of text, each in a node of a tree of its block elements."""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Elements of HTML by what they do to a page's structure.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Their content is not markup; none of it is shown as text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote button canvas caption center colgroup datalist dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript object ol optgroup option p "
    "pre search section select summary svg table tbody td template tfoot th thead tr ul audio video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Siblings of these names are repetitions of one another.
REPEATED = HEADINGS | frozenset("p li dd dt tr td th pre blockquote figure option hr".split())
# What a start tag ends, if it is open, and the elements beyond which it does not reach.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])),
    "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
P = frozenset(["p"])
P_ENDS_AT = frozenset("td th table caption button object template".split())
NOT_IN_TREE = frozenset(["html", "head", "body"])
# Words in classes, ids and roles that tell what is not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu "
    "menubar breadcrumb breadcrumbs sidebar widget widgets masthead footer header cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login search share sharing social related recommended recommendations pagination pager toolbar "
    "skip copyright disclaimer contentinfo complementary alertdialog dialog form".split()
)
COMMENT_WORDS = frozenset("comment comments disqus respond replies reply discussion".split())

# Deeper elements count as parts of the one at this depth, later siblings of one label as one node; no text is lost.
DEPTH, SIBLINGS = 200, 64
# Inline elements that are open at once beyond this number are not remembered.
INLINE = 500

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|\b(hidden)\b""")
_MARKED = re.compile("class|id|role|hidden|style", re.I)
_DIGITS = re.compile(r"\d+")
_WORDS = re.compile(r"[a-z]+")


def is_aside(label: str) -> bool:
    return not ASIDE_WORDS.isdisjoint(_WORDS.findall(label.partition(".")[2]))


def is_comment(label: str) -> bool:
    return not COMMENT_WORDS.isdisjoint(_WORDS.findall(label.partition(".")[2]))


def _label(name: str, rest: str) -> str:
    """The name, a dot, then class, id and role; digits count alike.  A hidden element ends in an exclamation mark."""
    if not rest or not _MARKED.search(rest):
        return f"{name}."
    found = {k.lower() or "hidden": v.strip("\"'").lower() for k, v, _ in _ATTRIBUTE.findall(rest)}
    style = found.get("style", "").replace(" ", "")
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style
    marks = " ".join(" ".join(found.get(k, "").split()) for k in ("class", "id", "role")).strip()
    return f"{name}.{_DIGITS.sub('0', marks)}{'!' * hidden}"


class Page:
    """The blocks of a page in order, and the tree of their elements as ``parents`` and ``labels``; node 0 is the page."""

    def __init__(self, source: str):
        self.parents, self.labels = [-1], ["page."]
        self.blocks: list[tuple[int, str]] = []
        self._children: list[dict[str, int]] = [{}]
        self._found: list[dict[str, int]] = [{}]
        self._last = [-1]
        self._stack: list[tuple[str, int, bool]] = [("page", 0, True)]
        self._open: defaultdict[str, int] = defaultdict(int)
        self._depth = 0
        self._text: list[str] = []
        self._read(source)
        self._flush()

    def _read(self, s: str) -> None:
        at, n = 0, len(s)
        unclosed: set[str] = set()
        while at < n:
            lt = s.find("<", at)
            if lt < 0 or lt == n - 1:
                self._text.append(html.unescape(s[at:]))
                return
            if lt > at:
                self._text.append(html.unescape(s[at:lt]))
            nxt = s[lt + 1]
            if nxt in "!?":
                comment = s.startswith("<!--", lt)
                # "<!-->" is a whole comment too.
                end = s.find("-->", lt + 2) if comment else s.find(">", lt)
                at = n if end < 0 else end + (3 if comment else 1)
                continue
            closing = nxt == "/"
            name = _NAME.match(s, lt + 1 + closing)
            if not name:
                if closing:
                    end = s.find(">", lt)
                    at = n if end < 0 else end + 1
                else:
                    self._text.append("<")
                    at = lt + 1
                continue
            at = end = name.end()
            at_end = at + 1
            while s[at : at + 1] != ">":
                stop = _STOP.search(s, end)
                if not stop:
                    end = at_end = n
                    break
                end = stop.start()
                if s[end] == ">":
                    at_end = end + 1
                    break
                quote, end = s[end], end + 1
                if quote not in unclosed and s[at : end - 1].rstrip()[-1:] == "=":
                    close = s.find(quote, end)
                    if close < 0:
                        unclosed.add(quote)
                    else:
                        end = close + 1
            tag, rest, at = name[0].lower(), s[at:end], at_end
            if closing:
                self._end(tag)
                continue
            self._start(tag, rest)
            if tag in RAW:
                found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(s, at)
                at = found.start() if found else n

    def _flush(self) -> None:
        if not self._text:
            return
        text = " ".join("".join(self._text).split())
        if text:
            self.blocks.append((self._stack[-1][1], text))
        self._text = []

    def _pop_to(self, i: int) -> None:
        for name, node, block in self._stack[i:]:
            self._open[name] -= 1
            self._depth -= block
        del self._stack[i:]

    def _close(self, names: frozenset, barrier: frozenset) -> None:
        """End what is open of ``names``, up to the barrier."""
        last = None
        for i in range(len(self._stack) - 1, 0, -1):
            name = self._stack[i][0]
            if name in barrier:
                break
            if name in names:
                last = i
        if last is not None:
            self._flush()
            self._pop_to(last)

    def _node(self, label: str) -> int:
        parent = self._stack[-1][1]
        if self._depth >= DEPTH:
            return parent
        name, _, marks = label.partition(".")
        known = self._found[parent].get(label)
        if known is not None and (name in REPEATED or marks and self._last[parent] == known or self._children[parent].get(label, 0) >= SIBLINGS):
            self._last[parent] = known
            return known
        node = len(self.parents)
        self.parents.append(parent)
        self.labels.append(label)
        self._children.append({})
        self._found.append({})
        self._last.append(-1)
        self._children[parent][label] = self._children[parent].get(label, 0) + 1
        self._found[parent][label] = self._last[parent] = node
        return node

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._text.append("\n")
        if tag in NOT_IN_TREE or tag in RAW or tag in VOID and tag != "hr":
            return
        label = _label(tag, rest)
        if tag in BLOCK:
            if tag in IMPLIED and len(self._stack) > 1:
                self._close(*IMPLIED[tag])
            if self._open["p"]:
                self._close(P, P_ENDS_AT)
            if tag in HEADINGS and self._stack[-1][0] in HEADINGS:
                self._flush()
                self._pop_to(len(self._stack) - 1)
            self._flush()
            if tag == "hr":
                return
            self._stack.append((tag, self._node(label), True))
            self._open[tag] += 1
            self._depth += 1
        elif not rest.endswith("/") and len(self._stack) - self._depth < INLINE:
            apart = bool(rest) and (label.endswith("!") or is_aside(label) or is_comment(label))
            if apart:
                self._flush()
            self._stack.append((tag, self._node(label) if apart else self._stack[-1][1], False))
            self._open[tag] += 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK:
            self._flush()
        if self._open[tag] <= 0:
            return
        for i in range(len(self._stack) - 1, 0, -1):
            name, node, block = self._stack[i]
            if name == tag:
                if node != self._stack[i - 1][1]:
                    self._flush()
                self._pop_to(i)
                return
            if block and tag not in BLOCK:
                return
