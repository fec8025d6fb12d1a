"""Main text of web pages: subtrees that recur across the pages of a host are its template and go."""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm._store import save
from strandlake.llm._text import record_batch

#: A subtree is a host's template if it is on this share of the host's different pages, and on as many pages at least.
SHARE, PAGES = 0.2, 3
#: Template hashes of all hosts that are broadcast; beyond, they are joined to pages by a shuffle.
BROADCAST = 500_000

# Elements by what HTML makes of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style noscript template iframe object embed svg math canvas audio video select datalist button textarea input map".split())
FURNITURE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split())
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select datalist optgroup"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table")}
# Words in class, id and role that name a page's furniture.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs header masthead footer sidebar aside complementary contentinfo notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login form comment comments disqus replies respond share sharing social related recommended recommendations toolbar pagination pager".split())
_NOT = frozenset("has with no without is not".split())
_CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
_CELLS = frozenset(("br", "td", "th"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_P, _P_WITHIN = frozenset(("p",)), frozenset(("table", "td", "th", "button", "object"))


# A comment, a tag with its attributes, or another declaration; quotes may hold >, and what never ends reaches to the end.
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TELLING = re.compile(r"\b(?:class|id|role|hidden|style|itemprop)\b", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe")}


def named(attributes: dict[str, str]) -> bool:
    """Whether class, id or role say that the element is furniture: a whole name, or the first or last part of one (site-footer, ad_slot)."""
    for a in ("class", "id", "role"):
        for name in attributes.get(a, "").lower().split():
            parts = re.split(r"[-_]+", name.strip("-_"))
            if name in NAMES or parts[0] not in _NOT and (parts[0] in NAMES or parts[-1] in NAMES):
                return True
    return False


def hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()


@lru_cache(maxsize=4096)
def element(tag: str, given: str) -> tuple[str, bool, bool]:
    """The label of an element (tag, class and id without digits), whether it is furniture by tag or name, and whether it is a page's content."""
    a: dict[str, str] = {}
    for name, *value in _ATTRIBUTE.findall(given):
        a.setdefault(name.lower(), unescape("".join(value)))
    names = " ".join(re.sub(r"\d+", "", x) for k in ("class", "id") for x in sorted(a.get(k, "").split()))
    furniture = tag not in ("html", "body") and (tag in FURNITURE or tag != "main" and named(a) or hidden(a))
    return f"{tag} {names}", furniture, tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop") == "articleBody"


def digest(*parts: str) -> int:
    return int.from_bytes(blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


#: Paths and shapes recur within a page and from page to page.
recurring = lru_cache(maxsize=1 << 16)(digest)


class Tree:
    """A page's elements in order of their starts, and its text in pieces; elements that HTML closes silently are closed.

    Of each element: parent, tag, label, whether it is furniture, and whether it is the page's content (article, main).
    A piece is (element, text), or (element, None) where a block begins or ends.
    """

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.label, self.furniture, self.content = [-1], [""], [""], [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.open, self.counts, self.unseen = [0], {}, 0
        at = 0
        while token := _TOKEN.search(html, at):
            start, end = token.span()
            if start > at:
                self.data(html[at:start])
            at = end
            if tag := token[2]:
                tag = tag.lower()
                if token[1]:
                    self.end(tag)
                elif token[4]:  # a tag that the page's end cuts off is none
                    self.start(tag, token[3])
                    if tag in _RAW:
                        close = _RAW[tag].search(html, at)
                        at = close.start() if close else len(html)
        if at < len(html):
            self.data(html[at:])

    def data(self, text: str) -> None:
        if not self.unseen:
            self.pieces.append((self.open[-1], unescape(text) if "&" in text else text))

    def start(self, tag: str, given: str) -> None:
        here = self.open[-1]
        if tag in _CELLS:
            self.pieces.append((here, " "))
        if tag in VOID:
            if tag in BLOCKS:
                self.pieces.append((here, None))
            return
        block = tag in BLOCKS
        if block and self.counts.get("p"):
            self.leave(_P, _P_WITHIN)
        if tag in _CLOSES:
            self.leave(*_CLOSES[tag])
        label, furniture, content = element(tag, given if given and _TELLING.search(given) else "")
        i = len(self.tag)
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.label.append(label)
        self.furniture.append(furniture)
        self.content.append(content)
        self.open.append(i)
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.unseen += tag in UNSEEN
        if block:
            self.pieces.append((i, None))

    def pop(self) -> None:
        tag = self.tag[self.open.pop()]
        self.counts[tag] -= 1
        self.unseen -= tag in UNSEEN
        if tag in BLOCKS:
            self.pieces.append((self.open[-1], None))

    def leave(self, tags: frozenset, within: frozenset) -> None:
        """Close the outermost open one of `tags` that no open one of `within` holds, and all in it."""
        left, last = sum(self.counts.get(t, 0) for t in tags), 0
        if not left:
            return
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tag[self.open[depth]]
            if tag in within:
                break
            if tag in tags:
                last, left = depth, left - 1
                if not left:
                    break
        while last and len(self.open) > last:
            self.pop()

    def end(self, tag: str) -> None:
        if self.counts.get(tag):
            while self.tag[self.open[-1]] != tag:
                self.pop()
            self.pop()
        elif tag in _CELLS:
            self.pieces.append((self.open[-1], " "))


class Page:
    """What is known of a page by itself: its furniture, its content elements, and two hashes of each subtree outside these.

    exact: labels, text and children. frame, only where the page has a content element: labels on the way from the root and labels below, without text, equal
    neighbours once. Only block elements count as subtrees, so that no words go out of a sentence. Elements that hold a content element, or a heading outside furniture, have no frame.
    """

    def __init__(self, html: str | None) -> None:
        t = self.tree = Tree(html or "")
        n = len(t.tag)
        self.inside, self.holds, apart = [False] * n, [False] * n, [False] * n
        roots = []
        for i in range(1, n):
            up = t.parent[i]
            # A form may be around a whole page; it is furniture only if no content is in it.
            apart[i] = apart[up] or t.furniture[i] and t.tag[i] != "form"
            self.inside[i] = self.inside[up] or t.content[up] and not apart[up] and up > 0
            if t.content[i] and not apart[i]:
                roots.append(i)
        for i in roots:
            while i and not self.holds[i]:
                self.holds[i] = True
                i = t.parent[i]
        self.whole = bool(roots)
        heading = [False] * n
        for i in range(n - 1, 0, -1):
            heading[i] = heading[i] or t.tag[i] in _HEADINGS
            heading[t.parent[i]] = heading[t.parent[i]] or heading[i] and not t.furniture[i]
        # An article's own header is kept where it has the headline.
        self.gone = [t.furniture[i] and not self.holds[i] and not (t.tag[i] == "header" and self.inside[i] and heading[i]) for i in range(n)]
        self.exact, self.frame = self.hashes(heading)

    def hashes(self, heading: list[bool]) -> tuple[list[int | None], list[int | None]]:
        t, n = self.tree, len(self.tree.tag)
        text: list[list[str]] = [[] for _ in range(n)]
        for i, piece in t.pieces:
            if piece is not None and not self.inside[i] and (piece := " ".join(piece.split())):
                text[i].append(piece)
        path = [0] * n
        if self.whole:
            for i in range(1, n):
                if not self.inside[i]:
                    path[i] = recurring(str(path[t.parent[i]]), t.label[i])
        said, below = [bool(x) for x in text], [[] for _ in range(n)]
        exact, frame, content, shape = [None] * n, [None] * n, [0] * n, [0] * n
        for i in range(n - 1, 0, -1):  # children begin after their parents
            if self.inside[i] or self.holds[i]:
                continue
            kids = below[i][::-1]
            if self.whole:
                shapes = [shape[k] for k in kids]
                shape[i] = recurring(t.label[i], *(str(s) for j, s in enumerate(shapes) if not j or s != shapes[j - 1]))
            below[t.parent[i]].append(i)
            if said[i]:
                said[t.parent[i]] = True
                content[i] = digest(t.label[i], *text[i], "", *(str(content[k]) for k in kids))
                if t.tag[i] in BLOCKS:
                    exact[i] = content[i]
                if self.whole and not heading[i] and t.tag[i] in BLOCKS:
                    frame[i] = recurring("frame", str(path[i]), str(shape[i]))
        return exact, frame

    def candidates(self) -> set[int]:
        return {x for of in (self.exact, self.frame) for x in of if x is not None}

    def text(self, template: frozenset | set) -> tuple[str, int]:
        """The page's blocks without furniture and template, and how many subtrees were deleted as template.

        A page of which templates would leave nothing keeps all that is no furniture.
        """
        t, n = self.tree, len(self.tree.tag)
        furniture, removed, deleted = [False] * n, [False] * n, 0
        for i in range(1, n):
            up = t.parent[i]
            furniture[i] = furniture[up] or self.gone[i]
            here = not removed[up] and (self.exact[i] in template or self.frame[i] in template)
            deleted += here and not furniture[up]
            removed[i] = removed[up] or here
        kept = self.blocks([a or b for a, b in zip(furniture, removed, strict=True)])
        if not kept and deleted:
            kept, deleted = self.blocks(furniture), 0
        return "\n\n".join(kept), deleted

    def blocks(self, gone: list[bool]) -> list[str]:
        made, now = [], []
        for i, piece in [*self.tree.pieces, (0, None)]:
            if piece is None:
                if text := " ".join("".join(now).split()):
                    made.append(text)
                now = []
            elif not gone[i]:
                now.append(piece)
        return made


def host(url: Column) -> Column:
    """The host in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(url, r"^\s*(?i:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.when(found != "", found)


def templates(spark: SparkSession, pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(host, hashes): the subtrees of each host that are on `share` of its different pages, and on `least` or more.

    Equal texts of a host count as one page. A host has at most 1 / share times as many hashes as its pages have on average, so
    that its array is bounded by pages, not by their number. Pages without a host take no part.
    """
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("hash", pa.int64())])

    def run(batches):
        for b in batches:
            hosts, page, hashes = [], [], []
            for h, p, text in zip(b.column("host").to_pylist(), b.column("page").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = [None, *Page(text).candidates()]  # null: the page itself
                hosts += [h] * len(found)
                page += [p] * len(found)
                hashes += found
            yield record_batch(schema, [hosts, page, hashes])

    seen = pages.select(host(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").where("host IS NOT NULL").mapInArrow(run, "host string, page long, hash long")
    counts = seen.distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    counts = save(spark, counts.where(F.col("hash").isNull() | (F.col("n") >= least)), "subtrees")
    all_pages = counts.where("hash IS NULL").select("host", F.col("n").alias("pages"))
    many = counts.where("hash IS NOT NULL").join(all_pages, "host").where(F.col("n") >= F.ceil(F.col("pages") * share))
    return save(spark, many.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "templates")


def extract(spark: SparkSession, pages: DataFrame, share: float = SHARE, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars, n_template) for each row, repeated rows included.

    Furniture goes by its tag or name, and what recurs on the host's pages goes outside article and main elements; inside these only furniture
    goes, since passages may be shared. A null or empty html has an empty text. A page without a host, or on a host with
    fewer than `least` different pages, loses furniture only. Null ids and urls stay null; other columns are not read.
    """
    found = templates(spark, pages, share, least)
    size = found.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0)).alias("n")).first()["n"]
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_template", pa.int64())])

    def run(batches):
        known: dict[tuple, frozenset] = {}
        for b in batches:
            made = []
            for i, url, text, hashes in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "hashes")), strict=True):
                text, deleted = Page(text).text(frozenset(hashes or ()))
                made.append((i, url, text, len(text), deleted))
            yield record_batch(schema, list(zip(*made, strict=True)) if made else [[]] * 5)

    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    joined = rows.join(F.broadcast(found) if size <= BROADCAST else found, "host", "left")
    return joined.select("page_id", "url", "html", "hashes").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_template long")
