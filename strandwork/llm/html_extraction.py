"""HTML extraction: paragraphs give points to their ancestors, discounted by link density; all of the article around the container of nearly all points stays."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements without an end tag; elements that start a block; those whose content is never text of the page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
HIDDEN = set("script style noscript template head title svg math iframe object canvas audio video select button input textarea".split())
#: Hidden elements that end where a block begins; elements whose content is no markup, and those of them that run to the page's end without an end tag.
BROKEN_OUT, RAW, TO_END = "svg math head select".split(), set("script style title textarea iframe xmp noembed noframes".split()), set("script style".split())
#: Elements and class or id words of what is around an article: menus, headers, footers, sidebars, notices, adverts, forms, comments.
ASIDE = set("nav header footer aside dialog menu".split())
PLAIN_WORDS = r"ad|ads|advert\w*|breadcrumbs?|comments?|commentlist|cookie|consent|disqus|footer|menu|nav|navbar|navigation|navlist|navmenu|newsletter|notices?|pagination|popup|repl(?:y|ies)|sidebar|signup|sponsor\w*|subscribe"
VAGUE_WORDS = r"banner|cookies|header|masthead|promo\w*|related|share|sharing|skip|social|toolbar|widget"
PLAINLY, BOILERPLATE = (re.compile(rf"(?:^|[\s_-])(?:{words})(?:$|[\s_-])", re.I) for words in (PLAIN_WORDS, f"{PLAIN_WORDS}|{VAGUE_WORDS}"))
#: Class words of this kind name what a page has or lacks; those of the second are of texts that can be longer than the article.
HAS, REMARKS = re.compile(r"(?:^|[_-])(?:no|has|with|without)[_-]", re.I), re.compile(r"comment|disqus|repl(?:y|ies)|related|cookie|consent|notice", re.I)
#: Class words of what holds an article's own title, if it has a heading.
TITLE = re.compile(r"^(?:post|entry|article|story|content)[_-]+(?:header|title|heading)$", re.I)
#: A link over several blocks with more text than this is no link: it wasn't closed, or holds an article.
WIDE = 300
#: Vague words also name what an article is about: they drop only what is made of links (their share of its text) or short (its length).
LINKED, SHORT = 0.3, 200
#: Elements that class words never drop; shares of a page's points that save an element from its class words (REMARKS: the second); share that the container holds.
WHOLE, MOST, ALL, NEARLY = set("html body main article".split()), 0.5, 0.98, 0.9
#: Blocks that belong to the text beside them.
PLAIN = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: Elements that an opening tag closes, up to the elements named; other blocks close an open paragraph.
CLOSES = {"li": ("li p", "ul ol"), "dt": ("dt dd p", "dl"), "dd": ("dt dd p", "dl"), "tr": ("tr td th p", "table"), "td": ("td th p", "tr table"), "th": ("td th p", "tr table")}
CLOSES = {tag: (closed.split(), upto.split()) for tag, (closed, upto) in CLOSES.items()}


GAP, NAME, ATTRIBUTE, EQUALS, VALUE = (re.compile(x) for x in (r"[\s/]*", r"[a-zA-Z][^\s/>]*", r"[^\s/>][^\s/>=]*", r"\s*=\s*", r"[^\s>]*"))
COMMENT_END = re.compile(r"--!?>")


class Source:
    """A page's text as tags and data: events() reads it once from start to end, roughly as browsers do, whatever it holds.

    What is looked for and not found (an end of a comment, a quote, an end tag) is remembered as missing, so that time is linear.
    """

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def find(self, what: str | re.Pattern, at: int) -> int:
        """Place of the next `what` from at on; -1 if there is none, nor was one asked for further on."""
        if what in self.missing:
            return -1
        if isinstance(what, str):
            place = self.html.find(what, at)
        else:
            m = what.search(self.html, at)
            place = m.start() if m else -1
        if place < 0:
            self.missing.add(what)
        return place

    def start(self, at: int) -> tuple[str, dict[str, str], int]:
        """Name and attributes (the first of a name counts) of the tag at a place, and where it ends; -1 for a tag that is not ended."""
        html, m, attributes = self.html, NAME.match(self.html, at), {}
        tag, i = m[0].lower(), m.end()
        while True:
            i = GAP.match(html, i).end()
            if i >= len(html):
                return tag, attributes, -1
            if html[i] == ">":
                return tag, attributes, i + 1
            m = ATTRIBUTE.match(html, i)
            name, i, value = m[0].lower(), m.end(), ""
            m = EQUALS.match(html, i)
            if m:
                i = m.end()
                quote = html[i : i + 1]
                if quote in ('"', "'") and quote and (end := self.find(quote, i + 1)) >= 0:
                    value, i = html[i + 1 : end], end + 1
                else:
                    m = VALUE.match(html, i)
                    value, i = m[0], m.end()
            attributes.setdefault(name, unescape(value))

    def events(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """("start", tag, attributes), ("end", tag, {}) and ("text", data, {})."""
        html, i = self.html, 0
        while i < len(html):
            at = html.find("<", i)
            if at < 0:
                at = len(html)
            if at > i:
                yield "text", unescape(html[i:at]), {}
            after = html[at + 1 : at + 2]
            if after.isascii() and after.isalpha():
                tag, attributes, i = self.start(at + 1)
                if i < 0:
                    return
                yield "start", tag, attributes
                if tag in RAW:
                    end = self.find(END_OF[tag], i)
                    if end >= 0:
                        i = end
                    elif tag in TO_END:
                        return
                    else:
                        yield "end", tag, {}
            elif after == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
                tag, _, i = self.start(at + 2)
                if i < 0:
                    return
                yield "end", tag, {}
            elif after and after in "!?/":
                end = -1
                if html.startswith("<!--", at):
                    if html.startswith((">", "->"), at + 4):
                        end = html.index(">", at)
                    elif (end := self.find(COMMENT_END, at + 4)) >= 0:
                        end = html.index(">", end)
                if end < 0 and (end := self.find(">", at + 2 if after == "/" else at + 1)) < 0:
                    return
                i = end + 1
            else:
                if at < len(html):
                    yield "text", "<", {}
                i = at + 1


END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in RAW}


class Node:
    """An element; `holder` is the block that it is in (or is), `owner` the article or main above it, `header` the header element, `link` the link."""

    __slots__ = ("tag", "parent", "holder", "owner", "header", "link", "spread", "dropped", "named", "titled", "text", "links", "points", "gone", "mark")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.named, self.titled, self.dropped, self.link, self.spread = tag, parent, "", False, False, None, None
        self.owner = self if tag in ("article", "main") else None
        self.header = self if tag == "header" else None
        self.holder = self
        if parent is not None:
            self.dropped, self.link = parent.dropped, parent.link
            self.owner, self.header = self.owner or parent.owner, self.header or parent.header
            self.holder = self if tag in BLOCK else parent.holder
        self.text, self.links, self.points, self.gone, self.mark = 0, 0, 0.0, False, False


class Page:
    """Elements of a page, parents before children, and its blocks in order: (node of the block, its text, length of its text within links).

    Where each kind of element is open is kept in `places`, so that no tag walks over the open elements: time is linear in the page.
    """

    def __init__(self, html: str):
        self.root = Node("html", None)
        self.stack, self.places = [self.root], {"html": [0]}
        self.parts, self.linked, self.found, self.nodes = [], {}, [], [self.root]
        for kind, what, attributes in Source(html).events():
            if kind == "text":
                self.data(what)
            elif kind == "start":
                self.open(what, attributes)
            else:
                self.close(what)
        self.flush()
        for n in reversed(self.nodes[1:]):
            n.parent.titled = n.parent.titled or n.titled or n.tag in HEADINGS
        # A link that holds much text in several blocks is none.
        self.blocks = []
        for node, text, linked in self.found:
            n = sum(k for link, k in linked.items() if link.spread[0] < 2 or link.spread[1] <= WIDE)
            self.blocks.append((node, text, min(n, len(text))))

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.found.append((self.stack[-1].holder, text, self.linked))
            for link, n in self.linked.items():
                blocks, total = link.spread or (0, 0)
                link.spread = (blocks + 1, total + n)
        self.parts, self.linked = [], {}

    def last(self, tags: list[str]) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def leave(self, place: int) -> None:
        for n in self.stack[place:]:
            self.places[n.tag].pop()
        del self.stack[place:]

    def open(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in BLOCK:
            self.flush()
            while place := self.last(BROKEN_OUT):
                self.leave(place)
            if tag in CLOSES:
                closed, upto = CLOSES[tag]
                while (place := self.last(closed)) > self.last(upto):
                    self.leave(place)
            elif self.stack[-1].holder.tag == "p":
                self.leave(self.last(["p"]))
        elif tag == "br":
            self.parts.append(" ")
        elif tag == "a" and (place := self.last(["a"])) and self.stack[place].holder is self.stack[-1].holder:
            self.leave(place)  # no link lies in a link
        if tag in VOID:
            return
        node = Node(tag, self.stack[-1])
        if tag == "a":
            node.link = node if "href" in attributes else node.link
        # An article's own header is judged later, like what class words say: by what it holds.
        own = tag == "header" and node.owner is not None
        node.dropped = node.dropped or tag in HIDDEN or tag in ASIDE and not own or "hidden" in attributes
        if tag in BLOCK - WHOLE:
            words = " ".join(attributes[k] for k in ("class", "id", "role") if attributes.get(k))
            node.named = " ".join(w for w in words.split() if BOILERPLATE.search(w) and not HAS.search(w))
            if tag in ("form", "header"):
                node.named = f"{node.named} {tag}".lstrip()
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(node)
        self.nodes.append(node)

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        place = self.last([tag])
        # The end of an inline element closes no block.
        if place and (tag in BLOCK or self.stack[place].holder is self.stack[-1].holder):
            self.leave(place)

    def data(self, data: str) -> None:
        if not self.stack[-1].dropped:
            self.parts.append(data)
            link = self.stack[-1].link
            if link is not None:
                self.linked[link] = self.linked.get(link, 0) + len(" ".join(data.split()))


def weigh(page: Page) -> None:
    """Points, text and linked text of the blocks that are not gone, for each element above them (not for the block itself), added up from the leaves."""
    for n in page.nodes:
        n.points, n.text, n.links = 0.0, 0, 0
    own: dict[Node, float] = {}
    for node, text, linked in page.blocks:
        if not node.gone:
            own[node] = own.get(node, 0.0) + (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            node.text, node.links = node.text + len(text), node.links + linked
    for n in reversed(page.nodes):
        above = n.parent
        if above is not None:
            above.points, above.text, above.links = above.points + n.points + own.get(n, 0.0), above.text + n.text, above.links + n.links
    page.root.points += own.get(page.root, 0.0)


def boilerplate(n: Node, total: float, own: float) -> bool:
    """Whether what its class words, or its being a form or header, say of an element holds, given its points and the page's."""
    if own > total * (ALL if REMARKS.search(n.named) else MOST):
        return False
    words = n.named.split()
    if words == ["header"] and n.tag == "header" or n.titled and all(TITLE.search(w) for w in words):
        return not n.titled or n.links > n.text * LINKED
    if n.tag != "form" and not any(PLAINLY.search(w) for w in words):
        return n.links > n.text * LINKED or n.text < SHORT
    return True


def extract(html: str | None) -> str:
    """Main text of one page; empty if there is none."""
    if not html:
        return ""
    page = Page(html)
    weigh(page)
    if any(n.named for n in page.nodes):
        own = {}
        for node, text, linked in page.blocks:
            own[node] = own.get(node, 0.0) + (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        for n in page.nodes[1:]:
            n.gone = n.parent.gone or bool(n.named) and boilerplate(n, page.root.points, n.points + own.get(n, 0.0))
        weigh(page)
    total = page.root.points
    if total <= 0:
        return ""
    # The lowest container of nearly all points; those that hold so much lie within each other.
    best = [n for n in page.nodes if n.points >= NEARLY * total][-1]
    tops = {best.owner} if best.owner is not None else set()
    if not tops:
        parts = [n for n in page.nodes if n.owner is n and n.points > 0]
        most = max((n.points for n in parts), default=0.0)
        if most >= MOST * total:
            tops = {n for n in parts if n.points >= most / 5}
    # Under a top; in best; and, beside best, the branch of their parent that an element is in.
    branch: dict[Node, Node] = {}
    inside: set[Node] = set()
    for n in page.nodes:
        n.mark = n in tops or n.parent is not None and n.parent.mark
        if n is best or n.parent in inside:
            inside.add(n)
        if n.parent is best.parent:
            branch[n] = n
        elif n.parent in branch:
            branch[n] = branch[n.parent]
    wide, kept = best.tag in ("body", "html"), []
    for node, text, linked in page.blocks:
        if node.gone:
            continue
        if tops:
            # Lists of links beside the container are no text of the article.
            good = node.mark and (linked < len(text) / 2 or node in inside and not wide)
        elif wide:
            good = linked < len(text) / 2
        else:
            at = branch.get(node)
            good = at is best or at is not None and at.links < at.text / 4 and (at.tag in PLAIN or at.tag == best.tag)
        if good:
            kept.append(text)
    return "\n\n".join(kept)


def extract_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages: the page's main text, blocks joined by an empty line.

    Character references are decoded, white space inside a block is one space; nothing is cut off. A null or empty
    html, or one without text outside of boilerplate, gives an empty text. Class words never drop html, body, main or
    article, nor what holds most of the page's points, and vague ones only what is short or made of links; an article's
    own header stays if it has a heading; within an article or main every other block stays. Broken markup is read as
    browsers read it, roughly, and never raises: unclosed paragraphs, drawings and heads end where a block begins, marked
    sections are comments, a tag that the page's end cuts off is no text; a link over several blocks with much text counts as none. Repeated rows
    give equal rows; extra columns are not read. Row by row in Arrow batches, no shuffle; time is linear in a page's length,
    however deep it nests and whatever is left unfinished.
    """
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(texts, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page."""
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
