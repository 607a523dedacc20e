"""Main text of web pages by tree scoring.

Each paragraph gives points (one, its commas, and its length up to a bound) to its ancestors, less
with distance; a container's points are discounted by its link density, and by SUSPECT if its class or
id merely mentions what articles seldom are.  The best container is kept with those siblings that score
alike and the headings right before it, widened to the article element around it.  Taken out of the tree
before scoring are scripts, styles, forms, page headers and footers, menus, asides, hidden elements and
elements that a whole class or id names a sidebar, notice, advert or comment list.  A heading or
paragraph that it names an advert or notice goes unless it reads like prose.  Within the article a
container whose names merely mention readers' comments or newsletters goes if it comes after the last strong
paragraph or holds a small share of the points; one that mentions other such things goes if much of it is
links.  What stands between two kept siblings stays with them.  Outside an article, containers mostly of
links go too.

Rules for odd input: a null or empty page gives an empty text; unclosed tags are closed as browsers
do, an unclosed last tag, comment or script ends the page; a page without a scored paragraph falls back
to its article, main or body element; of containers that score the same the deeper one is best, then
the first; a page is read in one pass, whatever its quotes, and costs memory of its own size; rows
that repeat stay; a null page_id or url is passed on; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgraph.llm.shared import small_batches, table

#: Points.
MIN_PARAGRAPH = 25
LENGTH_UNIT, LENGTH_MAX = 100, 3
LEVELS = 5
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
LINK_HEAVY, LINK_SOME = 0.5, 0.25
#: A container with such a share of the points is the article, whatever its names say.
MOST = 0.5
#: Characters of a strong paragraph; characters and commas of prose.
STRONG = 80
PROSE, PROSE_COMMAS = 120, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea svg iframe xmp title".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option optgroup textarea input iframe svg object canvas dialog menu audio video map datalist label annotation annotation-xml".split())
ENDS_P = BLOCKS - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "legend", "summary", "caption"}
#: A start tag closes the nearest open one of these, unless a boundary lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
PARAGRAPHS = frozenset("p pre td blockquote".split())
START_POINTS = {"article": 10.0, "main": 8.0, "section": 3.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}
#: Words of class and id attributes, and roles, of what is not the article.
NOTICES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promoted cookie cookies consent gdpr notice notices newsletter disclaimer paywall".split())
ASIDES = frozenset("notification notifications modal overlay subscription sidebar aside menubar nav navbar navigation navigational breadcrumb breadcrumbs footer masthead topbar comment comments commentlist disqus respond replies reply share sharing social related recommended recommendations pagination pager widget widgets toolbar".split())
#: Words that may also be an article's own subject: inside an article they name nothing.
SUBJECTS = frozenset("alert popup banner header menu subscribe login signin signup register search skip".split())
#: Words that go with those above in a name of the whole element.
COMPANIONS = frozenset("main site page left right top bottom box block area list links link posts post articles article stories section container wrapper wrap bar inner outer content contents items item icons buttons button slot unit label title thread form panel group row col primary secondary media".split())
#: Factor of a container's score if its names hold such a word among others.
SUSPECT = 0.25
#: Words of containers in which readers speak or are asked to subscribe.
READERS = frozenset("comment comments commentlist disqus respond replies reply newsletter".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
ROOTS = frozenset(("html", "body", "article", "main"))

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_TEXTS = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6".split())


def _tags(source: str) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, name, closing) of each piece of markup in one forward pass; no name: nothing to open or close."""
    at, size, quoted = 0, len(source), True
    while (start := source.find("<", at)) >= 0:
        if source.startswith("<!--", start):
            end = source.find("-->", start + 4)
            at = size if end < 0 else end + 3
            yield start, at, "", False
            continue
        closing = source.startswith("/", start + 1)
        named = _NAME.match(source, start + 1 + closing)
        if not named:
            if source[start + 1 : start + 2] in ("!", "?", "/"):
                end = source.find(">", start)
                at = size if end < 0 else end + 1
                yield start, at, "", False
            else:
                at = start + 1  # a bare < is text
            continue
        end = named.end()
        while quoted:  # a > between quotes does not end a tag
            stop = _STOP.search(source, end)
            if stop and stop.group() == ">":
                end = stop.end()
                break
            end = source.find(stop.group(), stop.end()) + 1 if stop else 0
            if not end:
                quoted = False  # quotes do not pair up to the end of this page: they count no more
        if not quoted:
            end = source.find(">", named.end()) + 1 or size
        name, at = named.group().lower(), end
        if not source.endswith(">", start, end):
            yield start, size, "", False
            return
        if name in RAW and not closing:
            last = _RAW_END[name].search(source, end)
            at = last.end() if last else size
            name = ""
        yield start, at, name, closing


def _names_only(words: list[str], kinds: frozenset[str]) -> bool:
    return any(w in kinds for w in words) and all(w in kinds or w in COMPANIONS for w in words)


def _judged(tag: str, token: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element goes, and what its names say of it: nothing, suspect, readers (suspect, of READERS) or notice (a text element)."""
    if tag in DROPPED or tag == "header" and not in_article:
        return True, ""
    if tag in ROOTS or "=" not in token and "hidden" not in token:
        return False, ""
    kinds = NOTICES if tag in _TEXTS else NOTICES | ASIDES if in_article else NOTICES | ASIDES | SUBJECTS
    said = ""
    for name, *values in _ATTR.findall(token):
        name, value = name.lower(), next((v for v in values if v), "")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, ""
        if name == "style" and _HIDDEN.search(value) or name == "role" and value.lower() in ROLES:
            return True, ""
        if name in ("class", "id"):
            for whole in value.split():
                words = [x.lower() for x in _PART.findall(whole)]
                if _names_only(words, kinds):
                    if tag not in _TEXTS:
                        return True, ""
                    said = "notice"
                elif tag not in _TEXTS and any(w in kinds for w in words):
                    said = "readers" if said == "readers" or any(w in READERS for w in words) else "suspect"
    return False, said


def _is_prose(text: str) -> bool:
    return len(text) >= PROSE and text.count(",") + text.count("，") >= PROSE_COMMAS


class _Page:
    """Nodes in page order, with the blocks of text each holds."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.gone, self.link = ["#"], [-1], [False], [False]
        self.article, self.said = [False], [""]
        self.up = [-1]  # innermost block element around each node
        self.blocks: list[tuple[int, str]] = []  # owning node, text
        self.sizes: list[tuple[int, int, int]] = []  # owning node, characters, characters in links
        self._text: list[tuple[str, bool]] = []
        self._owner = 0
        self._parse(source)

    def _flush(self) -> None:
        if self._text:
            whole = " ".join(html.unescape("".join(x for x, _ in self._text)).split())
            if whole and (self.said[self._owner] != "notice" or _is_prose(whole)):
                linked = "".join(x for x, in_link in self._text if in_link)
                self.blocks.append((self._owner, whole))
                self.sizes.append((self._owner, len(whole), len(" ".join(html.unescape(linked).split())) if linked else 0))
            self._text = []

    def _parse(self, source: str) -> None:
        stack, open_tags, at = [0], {}, 0
        block = [0]  # innermost block element for each stack entry

        def pop_to(size: int) -> None:
            while len(stack) > size:
                name = self.tag[stack.pop()]
                block.pop()
                open_tags[name] -= 1
                if name in BLOCKS:
                    self._flush()

        def text(piece: str) -> None:
            node = stack[-1]
            if piece and not self.gone[node]:
                if self._text and self._owner != block[-1]:
                    self._flush()
                self._owner = block[-1]
                self._text.append((piece, self.link[node]))

        for begin, end, tag, closing in _tags(source):
            text(source[at:begin])
            at = end
            if not tag:
                continue
            if closing:
                if open_tags.get(tag):
                    k = len(stack) - 1
                    while self.tag[stack[k]] != tag:
                        k -= 1
                    pop_to(k)
                continue
            token = source[begin:end]
            if tag == "br":
                text(" ")
                continue
            if tag in VOID:
                if tag in BLOCKS:
                    self._flush()
                continue
            if tag in ENDS_P and open_tags.get("p"):
                k = len(stack) - 1
                while self.tag[stack[k]] != "p":
                    k -= 1
                pop_to(k)
            if tag in CLOSES:
                names, bounds = CLOSES[tag]
                if any(open_tags.get(x) for x in names):
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[k]] in bounds:
                            break
                        if self.tag[stack[k]] in names:
                            pop_to(k)
                            break
            top, node = stack[-1], len(self.tag)
            if tag in BLOCKS:
                self._flush()
            in_article = self.article[top]
            self.tag.append(tag)
            self.parent.append(top)
            self.article.append(in_article or tag in ("article", "main"))
            gone, said = (True, "") if self.gone[top] else _judged(tag, token, in_article)
            self.gone.append(gone)
            self.said.append(said)
            self.up.append(block[-1])
            self.link.append(self.link[top] or tag == "a")
            if token.endswith("/>") and tag not in BLOCKS:
                continue
            stack.append(node)
            block.append(node if tag in BLOCKS else block[-1])
            open_tags[tag] = open_tags.get(tag, 0) + 1
        text(source[at:])
        self._flush()


def _headings_before(page: _Page, best: int, size: list[int]) -> list[int]:
    """Headings among the siblings right before the best container."""
    found: list[int] = []
    for node in range(1, best):
        if page.parent[node] == page.parent[best] and not page.gone[node]:
            if page.tag[node] in ("h1", "h2", "h3", "hgroup"):
                found.append(node)
            elif size[node]:
                found = []
    return found


def _readers(page: _Page, kept: set[int], best: int) -> set[int]:
    """Containers that said something of themselves, within what is kept, that go after all: not the best one nor what it lies in."""
    if not any(page.said):
        return set()
    n, spine = len(page.tag), set()
    while best > 0:
        spine.add(best)
        best = page.parent[best]
    inside, apart = [False] * n, [False] * n
    for node in range(1, n):
        up = page.parent[node]
        inside[node] = node in kept or inside[up]
        apart[node] = apart[up] or bool(page.said[node]) and page.tag[node] not in _TEXTS and node not in spine
    worth, size, linked = [0.0] * n, [0] * n, [0] * n
    last = total = 0
    for (owner, body), (_, length, in_links) in zip(page.blocks, page.sizes, strict=True):
        if inside[owner]:
            size[owner] += length
            linked[owner] += in_links
            if length >= MIN_PARAGRAPH:
                worth[owner] += _worth(body)
                total += _worth(body)
            if length >= STRONG and not apart[owner]:
                last = max(last, owner)
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        worth[up], size[up], linked[up] = worth[up] + worth[node], size[up] + size[node], linked[up] + linked[node]
    out = set()
    for node in range(1, n):
        if page.said[node] and page.tag[node] not in _TEXTS and node not in spine and node not in kept and size[node]:
            late, small = node > last and worth[node] < MOST * total, worth[node] < SIBLING_SHARE * total
            if page.said[node] == "readers" and (late or small) or linked[node] > LINK_SOME * size[node]:
                out.add(node)
    return out


def _worth(body: str) -> float:
    return 1 + body.count(",") + body.count("，") + min(len(body) / LENGTH_UNIT, LENGTH_MAX)


def main_text(source: str | None) -> str:
    """The article of one page: its blocks in page order, joined by newlines."""
    if not source:
        return ""
    page = _Page(source)
    n = len(page.tag)
    size, linked = [0] * n, [0] * n
    points: dict[int, float] = {}
    for (owner, body), (_, length, in_links) in zip(page.blocks, page.sizes, strict=True):
        size[owner] += length
        linked[owner] += in_links
        if length >= MIN_PARAGRAPH and (page.tag[owner] in PARAGRAPHS or page.tag[owner] in ("div", "section", "article", "main", "li")):
            worth = _worth(body)
            node, level = (page.up[owner] if page.tag[owner] in PARAGRAPHS else owner), 0
            while node > 0 and level < LEVELS:
                points[node] = points.get(node, START_POINTS.get(page.tag[node], 0.0)) + worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
                node, level = page.up[node], level + 1
    depth = [0] * n
    for node in range(1, n):
        depth[node] = depth[page.parent[node]] + 1
    for node in range(n - 1, 0, -1):
        size[page.parent[node]] += size[node]
        linked[page.parent[node]] += linked[node]
    share = [linked[i] / size[i] if size[i] else 0.0 for i in range(n)]
    score = {node: got * (1 - share[node]) * (SUSPECT if page.said[node] else 1) for node, got in points.items() if page.tag[node] != "html"}
    kept: set[int] = set()
    own = 0  # the container that scored best
    if score:
        best = max(score, key=lambda i: (score[i], depth[i], -i))
        node, wide = best, best
        while node > 0:
            if page.tag[node] == "article" or page.tag[node] == "main" and page.tag[wide] != "article":
                wide = node
            node = page.parent[node]
        best_score, own, best = score[best], best, wide
        kept.add(best)
        bar = max(SIBLING_LEAST, SIBLING_SHARE * best_score)
        if page.tag[best] not in ("body", "main"):
            kept.update(_headings_before(page, best, size))
            for node in range(1, n):
                if page.parent[node] == page.parent[best] and node != best and not page.gone[node]:
                    if score.get(node, 0.0) >= bar or page.tag[node] == "p" and size[node] > STRONG and share[node] < LINK_SOME:
                        kept.add(node)
            low, high = min(kept), max(kept)
            kept.update(i for i in range(low, high) if page.parent[i] == page.parent[best] and size[i] and not page.gone[i] and not page.said[i] and share[i] < LINK_HEAVY)
    else:
        for tag in ("article", "main", "body"):
            kept = {i for i in range(1, n) if page.tag[i] == tag and not page.gone[i]}
            if kept:
                break
        kept = kept or {0}
    inside = [False] * n
    out = _readers(page, kept, own)
    for node in range(n):
        up = page.parent[node]
        loose = page.said[node] or not page.article[node]
        heavy = loose and page.tag[node] in ("ul", "ol", "div", "table", "section", "dl") and share[node] > LINK_HEAVY and node not in kept
        inside[node] = node in kept or up >= 0 and inside[up] and not heavy and node not in out
    return "\n".join(body for owner, body in page.blocks if inside[owner])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a narrow map without shuffle."""
    small_batches(pages.sparkSession)
    html_rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return html_rows.mapInArrow(_run, "page_id long, url string, text string, n_chars long")


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
