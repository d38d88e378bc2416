"""Main text of web pages by scoring the element tree.

Every paragraph passes points for its length and its commas to its ancestors, in full to the nearest
container and less to those further out; a container's points are discounted by the share of its text
that stands in links.  The best container is kept with those of its siblings that score alike.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                           "header hgroup hr main menu nav ol p pre section table ul".split())
SIBLING_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
                "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
                "tfoot": {"thead", "tbody", "tr", "td", "th"}}
LIST_LIMITS = frozenset("ul ol menu dl table select html body article main section div".split())
DROPPED = frozenset("nav footer aside form script style noscript template iframe noframes xmp svg math canvas object embed audio video "
                    "button input select textarea fieldset dialog menu head title".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
DROPPED_WORDS = frozenset("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies "
                          "consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription share sharing "
                          "social sidebar menu nav navbar navigation breadcrumb breadcrumbs header masthead footer comment comments "
                          "commentlist disqus replies respond related recommended widget toolbar pagination pager login signup".split())
#: Words that join a listed one in a name without giving it another sense.
JOINED_WORDS = frozenset("area article articles bar block body bottom box btn button buttons container content fixed form group icon icons inline "
                         "inner item items left link links list main module outer page panel post posts right row section site slot small "
                         "sticky stories story text title top unit wrap wrapper zone".split())
#: Elements that hold the article's own text: only a class says that one of them is none of it.
OWN_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote li dt dd td th tr figure figcaption".split())
ALWAYS_OPEN = frozenset("html body article main".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKEN = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _dropped(tag: str, attributes: str, in_article: bool) -> bool:
    """Is the element by its name, role or names no part of the main text?

    Inside an article a name counts only if all its words are of that kind: "related-posts" does, "related-work"
    does not; and headings, paragraphs and the like may have any id.  The header of an article stays.
    """
    if tag in DROPPED or tag == "header" and not in_article:
        return True
    if not attributes or attributes.isspace():
        return False
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if tag in ALWAYS_OPEN:
        return False
    if found.get("role") in DROPPED_ROLES:
        return True
    names = found.get("class", "") if in_article and tag in OWN_TEXT else f"{found.get('class', '')} {found.get('id', '')}"
    for name in names.split():
        words = [w for w in _TOKEN.findall(name) if not w.isdigit()]
        if not DROPPED_WORDS.isdisjoint(words) and (not in_article or all(w in DROPPED_WORDS or w in JOINED_WORDS for w in words)):
            return True
    return False


class _Tree:
    """Elements by number in page order, and the page's text runs and block ends."""

    def __init__(self) -> None:
        self.tag, self.parent, self.off = ["#root"], [-1], [False]
        self.runs: list[tuple[int, str | None, bool]] = []  # element, text (None: a block ends), in a link
        self.stack = [0]
        self.links = 0
        self.articles = 0
        self.opened: dict[str, int] = {}

    def open(self, tag: str, attributes: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self.end_within("p", ENDS_PARAGRAPH - {"p"})
        ends = SIBLING_ENDS.get(tag)
        if ends:
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[k]]
                if name in ends:
                    self.cut(k)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif name in LIST_LIMITS:
                    break
        if tag not in INLINE:
            self.runs.append((self.stack[-1], None, False))
        elif tag == "br":
            self.runs.append((self.stack[-1], " ", False))
        if tag in VOID:
            return
        top = self.stack[-1]
        self.tag.append(tag)
        self.parent.append(top)
        self.off.append(self.off[top] or _dropped(tag, attributes, self.articles > 0))
        self.stack.append(len(self.tag) - 1)
        self.opened[tag] = self.opened.get(tag, 0) + 1
        self.links += tag == "a"
        self.articles += tag in ("article", "main")

    def cut(self, k: int) -> None:
        """Close the elements from depth k on."""
        for e in self.stack[k:]:
            self.opened[self.tag[e]] -= 1
            self.links -= self.tag[e] == "a"
            self.articles -= self.tag[e] in ("article", "main")
            if self.tag[e] not in INLINE:
                self.runs.append((self.parent[e], None, False))
        del self.stack[k:]

    def end_within(self, tag: str, limits: frozenset) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.tag[self.stack[k]]
            if name == tag:
                return self.cut(k)
            if name in limits or name in ("td", "th", "li", "body", "html"):
                return None
        return None

    def close(self, tag: str) -> None:
        if tag in INLINE:  # an inline end never closes a block
            for k in range(len(self.stack) - 1, 0, -1):
                name = self.tag[self.stack[k]]
                if name == tag:
                    return self.cut(k)
                if name not in INLINE:
                    return None
            return None
        if tag in ("body", "html"):  # what follows still belongs to the page
            return None
        if self.opened.get(tag):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.tag[self.stack[k]] == tag:
                    return self.cut(k)
        if tag == "p":
            self.runs.append((self.stack[-1], None, False))
        return None

    def text(self, s: str) -> None:
        if s:
            self.runs.append((self.stack[-1], s, self.links > 0))


def _parsed(page: str) -> _Tree:
    tree, at, n = _Tree(), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            tree.text(page[at:])
            break
        tree.text(page[at:lt])
        tag = _TAG.match(page, lt)
        if tag:
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                tree.close(name)
                continue
            tree.open(name, tag[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|$)", re.I).search(page, at)
                if name not in DROPPED:
                    tree.text(page[at:end.start() if end else n])
                at = end.start() if end else n
            elif tag[3].endswith("/") and name in ("svg", "math", "path", "use"):
                tree.close(name)
            continue
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4) if not page.startswith(("<!-->", "<!--->"), lt) else page.find(">", lt) - 2
            at = end + 3 if end >= 0 else n
        elif page.startswith(("<!", "<?", "</"), lt):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else n
        elif lt + 1 < n and page[lt + 1].isascii() and page[lt + 1].isalpha():  # a tag with an open quote
            end = page.find(">", lt)
            if end < 0:
                break
            m = re.match(r"[^\s/>]*", page[lt + 1:end])
            tree.open(m[0].lower(), "")
            at = end + 1
        else:
            tree.text("<")
            at = lt + 1
    return tree


def main_text(page: str | None) -> str:
    """The main text of one page, its blocks joined by a line feed; '' if there is none."""
    if not page:
        return ""
    tree = _parsed(page)
    blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
    parts: list[str] = []
    linked, owner = 0, -1

    def flush() -> None:
        nonlocal linked, owner
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                blocks.append((owner, text, min(linked, len(text))))
            parts.clear()
        linked, owner = 0, -1

    for element, text, in_link in tree.runs:
        if text is None:
            flush()
        elif not tree.off[element]:
            if owner < 0 and not text.isspace():
                owner = element
            parts.append(text)
            linked += len(text) * in_link
    flush()
    if not blocks:
        return ""

    n = len(tree.tag)
    points, size, links = [0.0] * n, [0] * n, [0] * n
    for element, text, in_links in blocks:
        while tree.tag[element] in INLINE:
            element = tree.parent[element]
        worth = text.count(",") + min(3.0, len(text) / 100) + (len(text) >= 25)
        container = tree.parent[element] if tree.tag[element] not in ("div", "article", "section", "main", "body", "td", "#root") else element
        level = 0
        while container > 0:
            points[container] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            container, level = tree.parent[container], level + 1
        size[element] += len(text)
        links[element] += in_links
    for e in range(n - 1, 0, -1):  # children come after their parents
        size[tree.parent[e]] += size[e]
        links[tree.parent[e]] += links[e]
    score = [p * (1 - links[e] / size[e]) if size[e] else 0.0 for e, p in enumerate(points)]
    best = max(range(n), key=lambda e: (score[e], -e))
    above = best
    while above > 0 and tree.tag[above] not in ("article", "main"):
        above = tree.parent[above]
    if above > 0:
        best = above
    kept = {best}
    if best > 0 and tree.tag[best] != "body":
        for e in range(1, n):
            if tree.parent[e] == tree.parent[best] and e != best and not tree.off[e] and size[e]:
                density = links[e] / size[e]
                if score[e] >= max(10.0, 0.2 * score[best]) or tree.tag[e] == "p" and size[e] > 80 and density < 0.25:
                    kept.add(e)
    inside = [False] * n
    for e in range(n):
        inside[e] = e in kept or e > 0 and inside[tree.parent[e]]
    return "\n".join(text for element, text, _ in blocks if inside[element])


def extracted(pages: DataFrame, page: str = "html") -> DataFrame:
    """The rows without their ``page`` column, with ``main_text`` and ``main_chars`` (code points).

    Works row by row: a null or empty page gives an empty text, repeated rows are each extracted, an empty
    table gives an empty result, other columns are passed on (a clashing name is replaced).
    """
    kept = [c for c in pages.columns if c not in (page, "main_text", "main_chars")]
    rows = pages.select(*kept, F.col(page).alias("main_text"))

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py()) for p in batch.column("main_text")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*kept, "main_text", "main_chars"])

    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("main_text", T.StringType()),
                                              T.StructField("main_chars", T.LongType())]))
