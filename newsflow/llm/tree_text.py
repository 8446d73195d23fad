"""Main text of an HTML page by scoring its element tree.

Paragraphs give points for their length and commas to the elements around them, less to those further up; an element's
points are discounted by the share of its text that lies in links. The best container and those of its siblings
that read like part of the article are kept, without the parts that are marked as something else.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

# Elements by their meaning in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
NOT_TEXT = frozenset(
    "script style textarea title noscript template iframe svg math noembed noframes xmp head nav footer aside form button select option input label "
    "object embed canvas audio video menu dialog fieldset datalist map".split())
CONTAINERS = frozenset("article main section div td body blockquote details center".split())
# A start tag of the first kind ends an open element of the second.
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt", "summary", "figcaption"}
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "p": ("p",)}
# A whole class token, id or role of such words says that a part is not the article. Words beside them may only say where or as what a part stands,
# so that "has-sidebar", "section-header" or "social-impact" say nothing.
_OTHER = (
    r"(?:ads?|advert[a-z]*|sponsor[a-z]*|promo[a-z]*|banner|nav[a-z]*|menu[a-z]*|breadcrumbs?|toolbar|sidebar|aside|rail|widget|footer|foot|masthead|"
    r"header|comments?|commentlist|disqus|replies|respond|readercomments?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|"
    r"subscription|signup|sign[_-]up|login|paywall|share|sharing|social|related|recommended|recommendations|more[_-]?stories|teasers?|pagination|pager|tags|"
    r"copyright|legal|disclaimer|search[a-z]*|form|contentinfo|complementary|skip[a-z]*|outbrain|taboola)\d*")
_BESIDE = (
    r"(?:site|page|main|primary|secondary|global|top|bottom|left|right|post|posts|entry|article|articles|story|stories|reader|links?|list|buttons?|bar|box|"
    r"area|block|container|wrapper|wrap|inner|items?|icons|widgets|\d+)")
OTHER = re.compile(rf"(?:{_BESIDE}[_-]+)*{_OTHER}(?:[_-]+(?:{_OTHER}|{_BESIDE}))*", re.I)
COMMENTS = re.compile(r"comments?|commentlist|disqus|replies|respond", re.I)
# As the id of a section these are rather its subject.
SUBJECTS = frozenset("ads advertising sponsors navigation cookies consent gdpr notice notices alert social sharing legal copyright disclaimer search form tags subscription login".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAST = 25  # characters of text that count
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post|entry|content|story\w*|main|body|text|page)(?:$|[\s_-])", re.I)

_TAG = re.compile(r"<(?:!--(?:>|->|.*?(?:--!?>|\Z))|!\[CDATA\[(?P<cdata>.*?)\]\]>|[!?][^>]*>|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>)", re.S)
_LOOSE = re.compile(r"</?[a-zA-Z][^>]*(?:>|\Z)")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_BLANKS = re.compile(r"\s+")


class Element:
    __slots__ = ("name", "attrs", "parts", "parent", "points", "size", "linked")

    def __init__(self, name: str, attrs: str, parent: Element | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.parts: list = []
        self.points, self.size, self.linked = 0.0, 0, 0

    def told(self) -> dict[str, str]:
        return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)} if self.attrs else {}


def parse(page: str) -> Element:
    """Element tree of any string; unclosed and misnested tags are put right as browsers mostly do, nothing raises."""
    root = Element("#root", "", None)
    at, now, end = 0, root, len(page)
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            now.parts.append(page[at:])
            break
        if begin > at:
            now.parts.append(page[at:begin])
        found = _TAG.match(page, begin) or _LOOSE.match(page, begin)
        if not found:
            now.parts.append("<")
            at = begin + 1
            continue
        at = found.end()
        groups = found.groupdict() if found.re is _TAG else {}
        if groups.get("cdata"):
            now.parts.append(groups["cdata"])
        name = (groups.get("name") or "").lower()
        if not name:
            continue
        if groups["end"]:
            place = now
            while place is not root and place.name != name:
                # An inline end tag doesn't end the blocks around it.
                if place.name in BLOCK and name not in BLOCK:
                    place = root
                    break
                place = place.parent
            if place is not root:
                now = place.parent
            continue
        if name in CLOSES_P or name == "p":
            now = _close(now, ("p",), root, {"li", "td", "th", "div", "article", "section", "button", "blockquote", "body", "main", "aside", "form"})
        if name in CLOSES_SAME and name != "p":
            now = _close(now, CLOSES_SAME[name], root, {"ul", "ol", "dl", "table", "tbody", "select", "menu"} | ({"tr"} if name in ("td", "th") else set()))
        element = Element(name, groups["attrs"], now)
        now.parts.append(element)
        if name in VOID or groups["attrs"].rstrip().endswith("/") and name in ("svg", "path"):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        now = element
    return root


def _close(now: Element, names: tuple[str, ...], root: Element, within: set[str]) -> Element:
    """The parent of the innermost open element of these names, if none of ``within`` is open inside it."""
    place = now
    while place is not root:
        if place.name in names:
            return place.parent
        if place.name in within:
            return now
        place = place.parent
    return now


def _within(element: Element, names: tuple[str, ...]) -> bool:
    place = element.parent
    while place is not None and place.name not in names:
        place = place.parent
    return place is not None


def _apart(element: Element, by_role: bool = True) -> bool:
    """Whether element, visibility or role say that this is no part of the article."""
    if element.name in NOT_TEXT:
        return True
    if element.name == "header" and not _within(element, ("article", "main")):  # a heading inside an article belongs to it
        return True
    if not element.attrs:
        return False
    told = element.told()
    if "hidden" in told or told.get("aria-hidden") == "true":
        return True
    if element.name in ("html", "body", "article", "main", "p", "h1"):
        return False
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", told.get("style", ""), re.I):
        return True
    return by_role and told.get("role", "").lower() in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "alertdialog", "menubar", "toolbar")


def _named_apart(element: Element) -> str | None:
    """The class token or id that as a whole says that this is no part of the article."""
    if not element.attrs or element.name in ("html", "body", "article", "main", "h1"):
        return None
    told = element.told()
    tokens, own = told.get("class", "").split(), told.get("id", "").strip()
    if element.name in HEADINGS:  # only by one word, and not by one that says it is a heading
        return next((t for t in tokens if re.fullmatch(_OTHER, t, re.I) and t.lower() not in ("header", "banner", "masthead")), None)
    if element.name == "section" and own.lower() in SUBJECTS or element.name == "p":
        own = ""
    said = " ".join([*tokens, own])
    if element.name in ("section", "div") and ARTICLE.search(said) and not re.search(r"comment|\bads?\b|sidebar|footer|nav|menu|share|related", said, re.I):
        return None
    found = next((t for t in (*tokens, own) if t and OTHER.fullmatch(t)), None)
    return None if found and "header" in found.lower() and _within(element, ("article", "main")) else found


def _measure(element: Element) -> None:
    """Text and link text of an element and of all in it."""
    stack = [(element, False)]
    while stack:
        now, measured = stack.pop()
        if measured:
            now.size = now.linked = 0
            for part in now.parts:
                if isinstance(part, str):
                    size = len(part.strip())
                    now.size += size
                    now.linked += size if now.name == "a" else 0
                else:
                    now.size += part.size
                    now.linked += part.size if now.name == "a" else part.linked
            continue
        stack.append((now, True))
        stack.extend((p, False) for p in now.parts if not isinstance(p, str))


def _prune(element: Element, by_name: bool = True) -> None:
    """Take out what is set apart; measure text and link text of the rest.

    What only its name sets apart stays if it holds the article: a main or h1, an article outside of others, or most of the page's
    text outside of links while no article or main has text elsewhere. Comments stay if there is no other text.
    """
    for now in _elements(element):
        now.parts = [p for p in now.parts if isinstance(p, str) or not _apart(p, by_name)]
    _measure(element)
    if not by_name:
        return
    everything = list(_elements(element))
    named = {id(e): token for e in everything if (token := _named_apart(e))}
    if not named:
        return
    whole = element.size - element.linked
    held: dict[int, tuple[bool, int]] = {}  # whether it holds a main or h1, and how many articles and mains
    for now in reversed(everything):
        below = [held[id(p)] for p in now.parts if not isinstance(p, str)]
        mark = now.name in ("article", "main") and now.size - now.linked >= LEAST and id(now) not in named
        held[id(now)] = (now.size > 0 and now.name in ("main", "h1") or any(x for x, _ in below), mark + sum(n for _, n in below))
    gone = set()
    stack = [(element, 0, 0, False)]  # with the number of articles and mains around, their text, and whether one is an article
    while stack:
        now, around, text, inner = stack.pop()
        own, (title, marks) = now.size - now.linked, held[id(now)]
        if id(now) in named and not title and not (marks and not inner):
            elsewhere = held[id(element)][1] > marks + around or text - own >= LEAST
            if COMMENTS.search(named[id(now)]):
                most = own == whole
            else:
                most = 2 * own > whole and not elsewhere
            if not most:
                gone.add(id(now))
                continue
        if now.name in ("article", "main") and own >= LEAST and id(now) not in named:
            around, text = around + 1, max(text, own)
        inner = inner or now.name == "article"
        stack.extend((p, around, text, inner) for p in now.parts if not isinstance(p, str))
    for now in everything:
        if any(not isinstance(p, str) and id(p) in gone for p in now.parts):
            now.parts = [p for p in now.parts if isinstance(p, str) or id(p) not in gone]
    _measure(element)


def _elements(element: Element) -> Iterator[Element]:
    stack = [element]
    while stack:
        now = stack.pop()
        yield now
        stack.extend(p for p in reversed(now.parts) if not isinstance(p, str))


def _own_text(element: Element) -> str:
    """Text of an element outside of the blocks in it."""
    out, stack = [], [element]
    while stack:
        now = stack.pop()
        if isinstance(now, str):
            out.append(now)
        elif now is element or now.name not in BLOCK:
            stack.extend(reversed(now.parts))
    return "".join(out)


def _score(root: Element) -> list[Element]:
    scored: dict[int, Element] = {}
    for element in _elements(root):
        if element.name in CONTAINERS or element.name in ("p", "pre", "li", "dd", "h2", "h3"):
            text = html.unescape(_own_text(element)).strip()
            if len(text) < LEAST:
                continue
            points = 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) / 100, 3) + len(text) / 1000
            place, share = (element if element.name in CONTAINERS else element.parent), 1.0
            while place is not None and share > 0.1:
                if place.name in CONTAINERS or place.parent is None:
                    place.points += points * share
                    scored[id(place)] = place
                    share *= 0.5
                place = place.parent
    for element in scored.values():
        said = " ".join(element.told().get(k, "") for k in ("class", "id")) if element.attrs else ""
        bonus = 1.25 if element.name in ("article", "main") or ARTICLE.search(said) else 1.0
        element.points *= bonus * (1 - min(1.0, element.linked / max(element.size, 1)))
    return list(scored.values())


def _climbed(root: Element, best: Element) -> Element:
    """The outermost article around the best container, or the main if it has no text in other articles; else the container itself."""
    article = main = None
    place: Element | None = best
    while place is not None:
        article = place if place.name == "article" else article
        main = place if place.name == "main" else main
        place = place.parent
    if article is None or main is None:
        return article or main or best
    own = {id(e) for e in _elements(article)}
    return article if any(e.name == "article" and e.size and id(e) not in own for e in _elements(main)) else main


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, white space inside a block as one space, blocks joined by two line feeds.

    Null and empty pages, and pages without text outside of set-apart parts, give an empty string. Parts that are set apart by
    class, id or role only are kept where nothing else is left.
    """
    if not page:
        return ""
    return _article(page, True) or _article(page, False)


def _article(page: str, by_name: bool) -> str:
    root = parse(page)
    _prune(root, by_name)
    scored = _score(root)
    if not scored:
        return _joined([root])
    best = max(scored, key=lambda e: e.points)
    # A container whose only worth is in one child adds what stands beside it; a page of several like parts is taken whole.
    while best.parent is not None and best.parent.points >= 0.75 * best.points and best.parent.name in CONTAINERS - {"body"}:
        best = best.parent
    best = _climbed(root, best)
    parent = best.parent
    if parent is None:
        return _joined([best])
    least = max(10.0, best.points * 0.2)
    kept = []
    for part in parent.parts:
        if part is best:
            kept.append(part)
        elif not isinstance(part, str):
            density = part.linked / max(part.size, 1)
            if part.points >= least or part.name == "p" and (part.size > 80 and density < 0.25 or 0 < part.size <= 80 and part.linked == 0 and "." in _own_text(part)):
                kept.append(part)
            elif part.name in ("h1", "h2") and part.linked == 0 and part.size:
                kept.append(part)
            elif part.name in ("ul", "ol", "blockquote", "pre", "table", "figure", "dl") and part.size > 80 and density < 0.2:
                kept.append(part)
    return _joined(kept)


def _joined(elements: list[Element]) -> str:
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        text = _BLANKS.sub(" ", html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()

    stack: list = list(reversed(elements))
    while stack:
        now = stack.pop()
        if now is None:
            flush()
        elif isinstance(now, str):
            run.append(now)
        elif now.name in BLOCK or now.parent is None:
            flush()
            stack.append(None)
            stack.extend(reversed(now.parts))
        elif now.name == "br":
            run.append("\n")
        else:
            stack.extend(reversed(now.parts))
    flush()
    return "\n\n".join(blocks)


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page. Each page is read alone, whole: no shuffle; other columns are not read."""
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.fieldNames())

    keys = [StructField(c, pages.schema[c].dataType) for c in ("page_id", "url")]
    schema = StructType([*keys, *StructType.fromDDL("text string, n_chars long").fields])
    return pages.select(F.col("page_id"), "url", "html").mapInArrow(extract, schema)
