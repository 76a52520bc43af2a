"""Main text of HTML pages by tag-path ratios.

Every block of text has the path of block elements from the root to it. Per path the lengths and the punctuation of its
blocks are added up and divided by their number, so a short paragraph counts like the long ones of its kind. The two
ratios are smoothed along the page and fused; paths above a threshold are content. The content region is the least
element that holds nearly all of the content, or the page's own article or main element; its blocks are the text, except
those inside navigation, adverts, forms, notices and comments, which are known by element or by the words of class, id
and role. Pages are independent of each other: no shuffle.
"""

from __future__ import annotations

import re
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import bounded_batches, query, table

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
VALUE_OR_END = re.compile(r"""=\s*(["'])|>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template textarea title iframe object svg canvas nav aside button "
                    "select input dialog menu footer audio video map xmp noembed noframes datalist fieldset".split())
CLOSES = {name: frozenset(ends.split()) for name, ends in {
    "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option",
    "thead": "tr td th tbody thead", "tbody": "tr td th tbody thead", "body": "head"}.items()}
SCOPES = frozenset("ul ol dl table div article section main body html td th".split())
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                     "h5 h6 header hr main menu nav ol p pre section table ul".split())
HINTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
                  "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
                  "subscription signup login sidebar aside widget widgets menu nav navbar navigation breadcrumb "
                  "breadcrumbs toolbar footer copyright share sharing social related recommended recommendations "
                  "comment comments disqus replies respond form search pagination pager complementary contentinfo "
                  "hidden".split())
FIRM_HINTS = frozenset("comment comments disqus replies respond".split())
TOP_HINTS = frozenset("header masthead topbar".split())
LAYOUT = frozenset("no not has with without".split())  # before a hint: of what an element has beside it, or lacks
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MARKS = re.compile("[.,;:!?…。、，；：！？]")


class Element:
    """One element; what depends on its ancestors is known when it opens, sums over its inside when the page is read."""

    __slots__ = ("tag", "parent", "block", "path", "hard", "soft", "holds", "in_article", "linked", "known", "apart",
                 "depth", "size", "weight", "content", "dropped", "chosen", "heading")

    def __init__(self, tag, parent, paths, hard=False, soft=0):
        inline = tag in INLINE
        self.tag, self.parent, self.hard, self.soft = tag, parent, hard, soft
        self.block = parent.block if inline and parent else self
        up = parent.path if parent else 0
        self.path = up if inline else paths.setdefault((up, tag), len(paths) + 1)
        self.in_article = bool(parent) and (parent.in_article or parent.tag in ("article", "main"))
        self.linked = bool(parent) and parent.linked or tag == "a"
        self.heading = bool(parent) and parent.heading or tag in HEADINGS
        self.known = hard or bool(parent) and parent.known
        self.apart = hard or soft > 0 or bool(parent) and parent.apart  # known or hinted at
        self.depth = parent.depth + 1 if parent else 0
        self.holds = self.dropped = self.content = self.chosen = False
        self.size = self.weight = 0


def marks(html: str):
    """("text", text), ("open", name, attributes) and ("close", name) in page order, in one pass over the page.

    Comments, declarations and the insides of scripts and the like are left out. A tag ends at the first > outside
    quoted values; from the first quote that is never closed on, quotes do not count. What never ends is text.
    """
    at = begin = 0
    quotes, last = True, html.rfind(">")
    while (start := html.find("<", at)) >= 0:
        at = start + 1
        if html.startswith("!--", at):
            end = html.find("-->", at + 3)
            stop = len(html) if end < 0 else end + 3
            mark = None
        elif html.startswith("![CDATA[", at):
            end = html.find("]]>", at)
            stop = len(html) if end < 0 else end + 3
            mark = ("text", html[at + 8:end if end >= 0 else len(html)])
        elif html.startswith(("!", "?"), at):
            end = html.find(">", at)
            stop, mark = len(html) if end < 0 else end + 1, None
        elif start < last and (name := NAME.match(html, at)):
            end = name.end()
            while quotes and (m := VALUE_OR_END.search(html, end)):
                if not m[1]:
                    end = m.start()
                    break
                end = html.find(m[1], m.end()) + 1
                quotes = end > 0
            else:
                quotes, end = False, html.find(">", name.end())
            if end < 0:
                continue
            stop, tag = end + 1, name[2].lower()
            mark = ("close", tag) if name[1] else ("open", tag, html[name.end():end])
            if tag in RAW and not name[1]:
                ending = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(html, stop)
                close = html.find(">", ending.end()) if ending else -1
                stop, mark = len(html) if close < 0 else close + 1, None
        else:
            continue
        if begin < start:
            yield "text", html[begin:start]
        if mark:
            yield mark
        at = begin = stop
    if begin < len(html):
        yield "text", html[begin:]


def hints(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """(known by name or state, hinted at by class, id, role or as a form: 1, or 2 for comments)"""
    hard, soft, words = tag in DROPPED or tag == "header" and not in_article, 0, set()
    if attributes.strip():
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), unescape(value.strip("\"'")).lower()
            if name in ("class", "id", "role"):
                for token in value.split():
                    if token == "hidden":
                        words.add(token)
                    for word in re.split(r"[^a-z]+", token):
                        if word in LAYOUT:
                            break
                        if word != "hidden":
                            words.add(word)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                hard = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                hard = True
        if tag not in ("html", "body", "article", "main"):
            soft = 2 if words & FIRM_HINTS else int(bool(words & HINTS or not in_article and words & TOP_HINTS))
    if "main" in words and soft == 1:
        soft = 0
    if tag == "form":
        soft = max(soft, 1)
    return hard, soft


def blocks(html: str) -> tuple[list[tuple[Element, str, int]], list[Element]]:
    """(element, text, characters inside links) of each block of text, and all elements, both in page order.

    ``where`` has the places of the open elements by name, so that no end tag searches the whole stack.
    """
    paths: dict[tuple[int, str], int] = {}
    root = Element("", None, paths)
    stack, made, found, parts, linked = [root], [root], [], [], 0
    where: dict[str, list[int]] = {}
    scopes, firm = [0], [0]  # places of open scopes, and of those that are no table cell
    owner = root

    def close():
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                found.append((owner, text, linked))
                owner.size += len(text)
            parts, linked = [], 0

    def say(text):
        nonlocal owner, linked
        top = stack[-1]
        if not parts or owner.apart != top.apart:
            close()
            owner = top if top.apart and not top.block.apart else top.block
        parts.append(unescape(text) if "&" in text else text)
        linked += len(text) if top.linked else 0

    def pop_to(k):
        if any(e.tag not in INLINE for e in stack[k:]):
            close()
        for e in stack[k:]:
            where[e.tag].pop()
        del stack[k:]
        for places in (scopes, firm):
            while places[-1] >= k:
                places.pop()

    def place(tag):
        return where[tag][-1] if where.get(tag) else 0

    for kind, tag, *rest in marks(html):
        if kind == "text":
            if tag:
                say(tag)
            continue
        if kind == "close":
            k = place(tag)
            if k and not (tag in INLINE and scopes[-1] >= k):
                pop_to(k)
            elif tag not in INLINE:
                close()
            continue
        if tag in BREAKS_P and (k := place("p")) > scopes[-1]:
            pop_to(k)
        if ends := CLOSES.get(tag):
            k = max(map(place, ends))
            if k > firm[-1]:
                while stack[k - 1].tag in ends:
                    k -= 1
                pop_to(k)
        if tag not in INLINE:
            close()
        elif tag == "br":
            say(" ")
        if tag in VOID:
            continue
        parent = stack[-1]
        element = Element(tag, parent, paths, *hints(tag, rest[0], parent.in_article or parent.tag in ("article", "main")))
        if tag in ("article", "main"):
            up = parent
            while up and not up.holds:
                up.holds, up = True, up.parent
        where.setdefault(tag, []).append(len(stack))
        if tag in SCOPES:
            scopes.append(len(stack))
            if tag not in ("td", "th"):
                firm.append(len(stack))
        stack.append(element)
        made.append(element)
    close()
    for e in reversed(made[1:]):
        e.parent.size += e.size
    return found, made


def drop(made: list[Element], total: int) -> None:
    """Drop what is known, or hinted at unless it holds the article or, for hints about layout, most of the page's text."""
    for e in made:
        own = e.hard or e.soft > 0 and not e.holds and (e.soft > 1 or 2 * e.size <= total)
        e.dropped = own or bool(e.parent) and e.parent.dropped


def regions(made: list[Element], whole: int, cover: float) -> list[Element]:
    """The page's own main or article elements if they hold enough of the content, else the least element that does.

    Several articles with less than half of the content are teasers or remarks beside it, and are dropped.
    """
    named = [e for e in made if e.tag in ("article", "main") and e.weight and not e.in_article]
    # One article, or a main element, says more than several articles; of content, a fifth is enough for it.
    sure = [e for e in named if e.tag == "main" or len(named) == 1]
    if named and (2 * sum(e.weight for e in named) >= whole or sure and 5 * sum(e.weight for e in sure) >= whole):
        return named
    aside = sum(e.weight for e in named)
    for e in named:
        e.dropped = True
        up = e.parent
        while up is not None:
            up.weight, up = up.weight - e.weight, up.parent
    for e in made:
        e.dropped = e.dropped or bool(e.parent) and e.parent.dropped
    least = [e for e in made if e.content and not e.dropped and e.weight >= cover * (whole - aside) and e.tag not in INLINE]
    region = max(least, key=lambda e: e.depth)
    while region.parent is not None and (region.tag in ("p", "li") or region.tag in HEADINGS):
        region = region.parent
    return [region]


def main_text(html: str | None, cover: float = 0.9, threshold: float = 0.3) -> str:
    """``threshold``: content is above this share of the mean score by length; ``cover``: the region's share of it."""
    all_blocks, made = blocks(html or "")
    drop(made, sum(len(t) for e, t, _ in all_blocks if not e.known))
    all_blocks = [b for b in all_blocks if not b[0].dropped]
    if not all_blocks:
        return ""
    sums: dict[int, list[float]] = {}
    for element, text, linked in all_blocks:
        own = sums.setdefault(element.path, [0, 0, 0])
        plain = max(0, len(text) - linked)
        own[0] += plain
        own[1] += len(MARKS.findall(text)) if plain else 0
        own[2] += 1
    ratios = [(sums[e.path][0] / sums[e.path][2], sums[e.path][1] / sums[e.path][2]) for e, _, _ in all_blocks]

    def smooth(values):
        padded = [values[0], *values, values[-1]]
        return [(a + 2 * b + c) / 4 for a, b, c in zip(padded, padded[1:], padded[2:])]

    fused = [(a * (1 + b)) ** 0.5 for a, b in zip(smooth([r[0] for r in ratios]), smooth([r[1] for r in ratios]))]
    paths: dict[int, list[float]] = {}
    for (element, _, _), score in zip(all_blocks, fused):
        paths.setdefault(element.path, []).append(score)
    score = {p: sum(v) / len(v) for p, v in paths.items()}
    total = sum(len(t) for _, t, _ in all_blocks)
    mean = sum(score[e.path] * len(t) for e, t, _ in all_blocks) / total
    content = {p for p, s in score.items() if s >= threshold * mean}
    whole = 0
    for element, text, linked in all_blocks:
        if element.path in content:
            own = max(0, len(text) - linked)
            whole += own
            element.weight += own
            element.content = True
    for e in reversed(made[1:]):
        e.parent.weight += e.weight
        e.parent.content = e.parent.content or e.content
    own_regions = regions(made, whole, cover)
    for e in own_regions:
        e.chosen = True
    for e in made[1:]:
        e.chosen = e.chosen or e.parent.chosen
    named = own_regions[0].tag in ("article", "main")
    return "\n".join(t for e, t, linked in all_blocks if e.chosen and not e.dropped and (
        named or e.heading or e.path in content or linked * 2 <= len(t)))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",),
                 cover: float = 0.9, threshold: float = 0.3) -> DataFrame:
    """(id, kept columns, text, n_chars) per row; blocks are joined by line ends, white space in a block is one space.

    A null or empty page, and one without text, has an empty text. Pages are read whole whatever their length; broken
    and unclosed markup is repaired as far as the rules above go. Repeated rows are extracted alike; an empty table gives
    no rows; other columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_col}`"), *[F.col(f"`{k}`") for k in keep],
                        F.col(f"`{html_col}`").cast("string").alias("_html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "text string"])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(h.as_py(), cover, threshold) for h in batch.columns[-1]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())],
                                             [*batch.schema.names[:-1], "text"])

    return bounded_batches(rows).mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))


@query("op7_html_extraction")
def op7(spark, sf_dir):
    """Checked on planted pages and against the driver's template in ``tests/llm/test_html.py``."""
    return extract_text(table(spark, sf_dir, "pages"))
