"""Main text of web pages: what the markup says of a block, and a suffix array over each host's pages for what it leaves open.

A page becomes blocks of text in page order. The markup decides two kinds: blocks of menus, headers, footers, sidebars,
notices, adverts, forms, scripts and reader comments are `out`; blocks of an article (or of what holds the content where there
is no article element) are `in`. All others are `open`: they belong to the text unless the host repeats them.

For these, the blocks of a host's pages that aren't `in` are token streams, a token for each word and for each block's start.
Streams are concatenated slice by slice (what a task reads at a time) into a suffix array by prefix doubling. An interval of
suffixes that share WINDOW tokens is one substring; it is counted once per page, and slices add their counts up by the
substring's hash, so a host of any size is shared by many tasks and a menu of a million pages is one row for a slice. A
substring of PAGES distinct pages or more is a repeat; an open block whose tokens are covered by repeats to COVER goes.

Copies of whole pages repeat each other without being boilerplate. A page whose open tokens are mostly covered by repeats
is such a copy unless its article is marked: it doesn't count as a witness, and repeats are counted a second time over
witnesses only.

Defined results: a null or empty html has no text; a null url, or one without a host, belongs to one host without a name;
rows that repeat a page_id are pages of their own; an element that never ends reaches to the end of what holds it; text
without markup is one open block. Further columns play no part.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, stored

WINDOW = 5
PAGES = 3
COVER = 0.8
#: Pages and characters of html of a slice.
SLICE_PAGES, SLICE_CHARS = 2000, 16_000_000

IN, OPEN, OUT = 0, 1, 2

#: Elements whose content is text up to their end tag.
RAW = {tag: re.compile(f"</{tag}", re.I) for tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msub msup nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
#: Elements whose content is never main text, whatever they hold; and those that may hold a whole page, or an article's title.
NEVER = frozenset(
    "script style template noscript iframe object svg canvas audio video map head title textarea select button datalist dialog menu nav footer aside xmp noembed noframes".split()
)
DOUBTFUL = frozenset("form fieldset header".split())
#: An element of the second kind ends an open one of the first, inside what bounds it.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead"), "tfoot": ("tr", "td", "th", "tbody")}
BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NEVER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
#: Words of class and id that name what is no main text; in an article a header and a copyright line may hold some.
NEVER_NAMES = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget widgets toolbar pagination pager skip copyright"
    " ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay"
    " newsletter subscribe signup login share sharing social related recommended comment comments disqus respond replies".split()
)
IN_ARTICLE = frozenset("header masthead copyright".split())
COMMENT_NAMES = frozenset("comment comments reply replies respond disqus".split())
CONTENT_NAMES = re.compile(r"(article|post|entry|story|page|main|body)[_-]?(body|content|text)|content|article|post|story|main", re.I)

_TAG = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTED = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style|itemprop)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NOT_ITS_OWN = frozenset("no has with without".split())


class Element:
    """An element that is no mere format of text; `depth` counts formats of its name within a hidden format."""

    __slots__ = ("tag", "parent", "children", "attrs", "names", "content", "strict", "named", "within", "kind", "depth")

    def __init__(self, tag: str, parent: Element | None, attrs: dict[str, str]):
        self.tag, self.parent, self.children, self.attrs, self.depth = tag, parent, [], attrs, 0
        self.names, self.content = frozenset(), False
        if not attrs:
            return
        words = [x.lower() for key in ("class", "id") if key in attrs for x in _NAMES.findall(attrs[key])]
        self.names = frozenset(w for w, last in zip(words, ["", *words], strict=False) if last not in _NOT_ITS_OWN)
        self.content = any(CONTENT_NAMES.fullmatch(x) for key in ("class", "id") for x in attrs.get(key, "").split()) or attrs.get("itemprop", "").lower() == "articlebody"

    @property
    def role(self) -> str:
        return self.attrs.get("role", "").lower()


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()


def tree(page: str) -> Element:
    """Elements of a page; their children are elements and strings with character references decoded. Linear in the page."""
    root = at = Element("", None, {})
    opened: dict[str, int] = {}

    def leave(element: Element) -> None:
        """Ends the element and all that is open in it."""
        nonlocal at
        while at is not element:
            opened[at.tag] -= 1
            at = at.parent
        opened[element.tag] -= 1
        at = element.parent

    i, n, quotes = 0, len(page), True
    while i < n:
        j = page.find("<", i)
        j = n if j < 0 else j
        if j > i:
            at.children.append(html.unescape(page[i:j]))
        if j == n:
            break
        if page.startswith("<!--", j):
            end = page.find("-->", j + 2)
            i = n if end < 0 else end + 3
            continue
        closing = page.startswith("/", j + 1)
        name = _TAG.match(page, j + 1 + closing)
        if not name:
            end = page.find(">", j) if page[j + 1 : j + 2] in ("!", "?", "/") else -1
            if end < 0:
                at.children.append("<")
            i = end + 1 if end >= 0 else j + 1
            continue
        tag, end = name.group().lower(), page.find(">", name.end())
        if end < 0:  # a tag cut off by the page's end
            break
        inside = page[name.end() : end]
        if quotes and ('"' in inside or "'" in inside):
            if whole := _QUOTED.match(page, name.end()):
                end, inside = whole.end() - 1, page[name.end() : whole.end() - 1]
            else:  # a quote that never ends: from here on tags end at the next bracket
                quotes = False
        i = end + 1
        if tag in INLINE and at.tag in INLINE and tag == at.tag:
            at.depth += -1 if closing else 1
            if at.depth < 0:
                leave(at)
            continue
        if closing:
            if tag not in INLINE and opened.get(tag):
                up = at
                while up.tag != tag:
                    up = up.parent
                leave(up)
            continue
        attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(inside)} if inside else {}
        if tag in INLINE:
            if not hidden(attrs):
                continue
        elif tag not in VOID:
            if at.tag == "p":  # a paragraph ends where the next block begins
                leave(at)
            if any(opened.get(x) for x in ENDS.get(tag, ())):
                up, last = at, None
                while up.parent is not None and up.tag not in BOUNDS[tag]:
                    last = up if up.tag in ENDS[tag] else last
                    up = up.parent
                if last is not None:
                    leave(last)
        element = Element(tag, at, attrs)
        at.children.append(element)
        if tag in RAW:
            stop = RAW[tag].search(page, i)
            end = page.find(">", stop.end()) if stop else -1
            i = n if end < 0 else end + 1
        elif tag not in VOID:
            opened[tag] = opened.get(tag, 0) + 1
            at = element
    return root


def walk(root: Element) -> list[Element]:
    """All elements in page order."""
    out, stack = [], [root]
    while stack:
        element = stack.pop()
        out.append(element)
        stack += [c for c in reversed(element.children) if isinstance(c, Element)]
    return out


def mark(root: Element) -> None:
    """Gives every element its kind: what the markup says of the text directly in it.

    Names are judged twice: first to find what holds the article, then again with all that holds it exempt.
    """
    elements = walk(root)
    root.strict = root.named = root.within = False
    for e in elements[1:]:
        up = e.parent
        e.within = up.within or up.tag == "article"
        comment = e.tag == "article" and bool(e.names & COMMENT_NAMES)
        e.strict = up.strict or e.tag in NEVER or comment or (e.tag == "article" and e.within)
        if e.attrs:
            e.strict = e.strict or hidden(e.attrs) or e.role in NEVER_ROLES
        free = e.tag in ("html", "body", "main", "article") or e.tag in HEADINGS
        own = e.tag == "header" and not e.within
        e.named = up.named or own or (e.tag in DOUBTFUL and e.tag != "header") or (not free and bool(e.names & (NEVER_NAMES - IN_ARTICLE if e.within else NEVER_NAMES)))

    def chosen(found: list[Element]) -> list[Element]:
        """Those outside of elements with names that speak against them; all, if there are no others."""
        found = [e for e in found if not e.strict]
        return [e for e in found if not e.named] or found

    articles = chosen([e for e in elements if e.tag == "article"])
    mains = chosen([e for e in elements if e.tag == "main" or e.role == "main"])
    roots = articles or mains or chosen([e for e in elements if e.content and e.tag not in ("html", "body")])
    titles = [] if roots else [e for e in elements if e.tag == "h1"]
    holders: set[int] = set()
    for e in roots + titles:
        up = e.parent
        while up is not None and id(up) not in holders and (roots or up.tag != "header"):
            if roots or up.tag == "form":
                holders.add(id(up))
            up = up.parent
    inner, outer = {id(e) for e in roots}, {id(e) for e in mains} if articles else set()
    root.kind, root.named = OUT if roots else OPEN, False
    for e in elements[1:]:
        up = e.parent
        if id(e) in holders or id(e) in inner:
            e.named = False
        elif up.named is False and e.named:
            free = e.tag in ("html", "body", "main", "article") or e.tag in HEADINGS
            names = NEVER_NAMES - IN_ARTICLE if up.kind == IN else NEVER_NAMES
            e.named = (e.tag == "header" and up.kind != IN) or e.tag in ("form", "fieldset") or (not free and bool(e.names & names))
        else:
            e.named = up.named
        if e.strict or e.named:
            e.kind = OUT
        else:
            e.kind = IN if id(e) in inner else OPEN if id(e) in outer else up.kind
        if up.kind == OUT and (up.strict or up.named):
            e.kind = OUT


def blocks(page: str) -> list[tuple[int, str, str]]:
    """(kind, tag, text) of a page's blocks in page order, white space folded; blocks without text are left out."""
    root = tree(page)
    mark(root)
    out: list[tuple[int, str, str]] = []
    parts: list[str] = []

    def flush(e: Element) -> None:
        if not parts:
            return
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((e.kind, e.tag, text))

    stack: list[tuple[Element, int]] = [(root, 0)]
    while stack:
        e, i = stack.pop()
        while i < len(e.children):
            child = e.children[i]
            i += 1
            if isinstance(child, str):
                parts.append(child)
            elif child.tag in INLINE:
                continue  # a hidden format
            elif child.tag == "br":
                parts.append(" ")
            elif child.tag not in VOID or child.tag == "hr":
                flush(e)
                stack += [(e, i), (child, 0)]
                break
        else:
            flush(e)
    return out


_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found.group(1).lower() if found else ""


PAGE = "page_id long, url string, host string, slice string, kinds array<tinyint>, tags array<string>, texts array<string>"


def _parser(most_pages: int, most_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pages as blocks, a batch for each slice."""
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int8()), pa.list_(pa.string()), pa.list_(pa.string()))
    names = [x.split()[0] for x in PAGE.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, size = TaskContext.get().partitionId(), 0, 0
        rows: list[tuple] = []
        full = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for page_id, url, page in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html"), strict=True):
                page = page.as_py() or ""
                if rows and (len(rows) >= most_pages or size + len(page) > most_chars):
                    yield full()
                    rows, size, number = [], 0, number + 1
                found = blocks(page)
                size += len(page)
                rows.append((page_id, url, host(url), f"{task}-{number}", [b[0] for b in found], [b[1] for b in found], [b[2] for b in found]))
        if rows:
            yield full()

    return parse


class Streams:
    """The token streams of a slice's pages: numbers of tokens, where blocks begin, and a suffix array down to WINDOW."""

    def __init__(self, pages: list[tuple[str, list[int], list[str], list[str]]]):
        number: dict[str, int] = {}
        tokens: list[int] = []
        owner: list[int] = []
        self.blocks: list[tuple[int, int, int, int]] = []  # page, block, first token, end
        for p, (_, kinds, tags, texts) in enumerate(pages):
            for b, (kind, tag, text) in enumerate(zip(kinds, tags, texts, strict=True)):
                if kind == IN:
                    continue
                first = len(tokens)
                tokens.append(number.setdefault(f"<{tag}", len(number)))
                tokens += [number.setdefault(w, len(number)) for w in text.split(" ")]
                owner += [p] * (len(tokens) - first)
                self.blocks.append((p, b, first, len(tokens)))
        self.words, self.owner = list(number), np.array(owner, np.int64)
        self.tokens, self.hosts = np.array(tokens, np.int64), [p[0] for p in pages]
        self._sort()

    def _sort(self) -> None:
        """Ranks of all suffixes by their first WINDOW tokens, by prefix doubling; -1 where the page ends before."""
        n = len(self.tokens)
        names = {h: i for i, h in enumerate(dict.fromkeys(self.hosts))}
        host_of = np.array([names[h] for h in self.hosts], np.int64)[self.owner] if n else np.zeros(0, np.int64)
        _, rank = np.unique(host_of * (len(self.words) + 1) + self.tokens, return_inverse=True) if n else (None, np.zeros(0, np.int64))
        have = 1
        while have < WINDOW:
            step = min(have, WINDOW - have)
            next_ = np.full(n, -1, np.int64)
            same = np.flatnonzero(self.owner[step:] == self.owner[:-step]) if n > step else np.zeros(0, np.int64)
            next_[same] = rank[same + step]
            usable = (rank >= 0) & (next_ >= 0)
            pairs = rank[usable] * (rank.max(initial=0) + 1) + next_[usable]
            _, new = np.unique(pairs, return_inverse=True)
            rank = np.full(n, -1, np.int64)
            rank[usable] = new
            have += step
        self.rank = rank
        self.order = np.argsort(rank, kind="stable")
        self.order = self.order[int((rank < 0).sum()) :]

    def intervals(self) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Of each interval of the suffix array: its substring's hash, its number of distinct pages, and its rank."""
        order = self.order
        if not len(order):
            return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        ranks, owners = self.rank[order], self.owner[order]
        starts = np.flatnonzero(np.concatenate([[True], ranks[1:] != ranks[:-1]]))
        fresh = np.concatenate([[True], (ranks[1:] != ranks[:-1]) | (owners[1:] != owners[:-1])])  # order is stable, so pages ascend
        pages = np.add.reduceat(fresh.astype(np.int64), starts)
        return [self._hash(int(order[s])) for s in starts], pages, ranks[starts]

    def _hash(self, at: int) -> bytes:
        text = "\x00".join([self.hosts[self.owner[at]], *(self.words[t] for t in self.tokens[at : at + WINDOW])])
        return xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))

    def covered(self, repeats: set[bytes]) -> np.ndarray:
        """Tokens that lie in a repeat."""
        hashes, _, ranks = self.intervals()
        hit = np.zeros(int(self.rank.max(initial=-1)) + 2, bool)
        hit[ranks[[h in repeats for h in hashes]]] = True
        starts = np.flatnonzero(hit[self.rank] & (self.rank >= 0))
        edge = np.zeros(len(self.tokens) + WINDOW + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + WINDOW, -1)
        return np.cumsum(edge)[: len(self.tokens)] > 0


def _rows(table: pa.Table | pa.RecordBatch) -> list[tuple]:
    return list(zip(*(table.column(c).to_pylist() for c in ("host", "kinds", "tags", "texts")), strict=True))


def _intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Substrings of each batch's pages with the number of pages that hold them; pages of a batch are nobody else's."""
    for batch in batches:
        hashes, pages, _ = Streams(_rows(batch)).intervals()
        yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array(pages)], names=["hash", "pages"])


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The substrings of pages with open blocks, once for each slice of the batch."""
    for batch in batches:
        rows, slices = _rows(batch), batch.column("slice").to_pylist()
        for s in dict.fromkeys(slices):
            hashes, _, _ = Streams([r for r, x in zip(rows, slices, strict=True) if x == s and OPEN in r[1]]).intervals()
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([s] * len(hashes), pa.string())], names=["hash", "slice"])


def _judged(decide: Callable[[Streams, np.ndarray, list[tuple]], Iterator], name: str, kind: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A slice's pages and its repeats, with a column of what is decided of each page."""

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows(left)
        streams = Streams(rows)
        found = list(decide(streams, streams.covered(set(right.column("hash").to_pylist())), rows))
        return left.append_column(name, pa.array(found, pa.bool_() if kind == "boolean" else pa.string()))

    return judge


def _shares(streams: Streams, covered: np.ndarray, rows: list[tuple]) -> Iterator[bool]:
    """Whether a page is a witness: its article is marked, or half of its open tokens at least are its own."""
    total, own = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for p, b, first, end in streams.blocks:
        if rows[p][1][b] == OPEN:
            total[p] += end - first
            own[p] += end - first - int(covered[first:end].sum())
    for p, row in enumerate(rows):
        yield IN in row[1] or 2 * int(own[p]) >= int(total[p])


def _kept(streams: Streams, covered: np.ndarray, rows: list[tuple]) -> Iterator[str]:
    gone = {(p, b) for p, b, first, end in streams.blocks if rows[p][1][b] == OPEN and covered[first:end].sum() >= COVER * (end - first)}
    for p, (_, kinds, _, texts) in enumerate(rows):
        yield " ".join(t for b, (k, t) in enumerate(zip(kinds, texts, strict=True)) if k == IN or (k == OPEN and (p, b) not in gone))


def main_text(pages: DataFrame, slice_pages: int = SLICE_PAGES, slice_chars: int = SLICE_CHARS) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html)."""
    parsed = stored(spread(pages.select("page_id", "url", "html")).mapInArrow(_parser(slice_pages, slice_chars), PAGE), "html-blocks")
    has_open = F.array_contains("kinds", F.lit(OPEN).cast("tinyint"))
    texts = F.filter(F.arrays_zip("kinds", "texts"), lambda b: b["kinds"] == IN)
    marked = parsed.where(~has_open).select("page_id", "url", F.array_join(F.transform(texts, lambda b: b["texts"]), " ").alias("text"))

    opened = parsed.where(has_open)
    counts = lambda df: df.mapInArrow(_intervals, "hash binary, pages long").groupBy("hash").agg(F.sum("pages").alias("pages"))
    asked = opened.mapInArrow(_asked, "hash binary, slice string").distinct()
    repeats = stored(asked.join(counts(parsed).where(F.col("pages") >= PAGES), "hash"), "html-repeats")

    def judged(left: DataFrame, right: DataFrame, decide: Callable, name: str, kind: str) -> DataFrame:
        return left.groupBy("slice").cogroup(right.select("slice", "hash").groupBy("slice")).applyInArrow(_judged(decide, name, kind), f"{PAGE}, {name} {kind}")

    seen = stored(judged(opened, repeats, _shares, "witness", "boolean"), "html-witnesses")
    copies = counts(seen.where(~F.col("witness")).drop("witness")).withColumnRenamed("pages", "copies")
    left = repeats.join(copies, "hash", "left").where(F.col("pages") - F.coalesce("copies", F.lit(0)) >= PAGES)
    decided = judged(seen.drop("witness"), left, _kept, "text", "string").select("page_id", "url", "text")
    return marked.unionByName(decided).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
