"""Main text of web pages by wrappers: union-free regular expressions that align all token streams of a host.

A page's token stream holds its block elements (tag, and the words of class, id and
role without digits) and text slots; inline markup belongs to the slot it stands in.
A host's wrapper is inferred by aligning one page after another with it
(``Wrapper``): a token that the wrapper has at this place goes one level down; one
that it lacks there becomes an optional group, as does one that a page leaves out; tokens that
come again side by side become a repeated item, and tokens that come in several orders a
repeated group of optional items; text that differs between pages becomes a slot, text that
doesn't stays a constant. What is kept for this are counts, neighbours and digests, all of
which merge, so wrappers of parts of a host, aligned in different tasks, align with
each other, and the result doesn't depend on the order of pages. ``expression`` writes it down.

Each slot of a wrapper gets a level from its place: 0 in elements that aren't the article (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments and so on, by tag or
name), else 4 inside ``article``, 3 inside ``main``, 2 inside elements named as content, and 1
outside of these unless the slot is a constant of at least two different pages or mostly
links. A page's text is all of its slots of the highest level at which it has text.

On Spark: every task aligns its own pages by host, so a host of any size leaves a
task as one row; those are merged in two steps, the first over (host, share of tasks). The
finished wrappers, a few KB a host, are joined to the pages by host: Spark
broadcasts them while their table is below its threshold, beyond that it is a
shuffle join whose hot hosts are split. Pages are read twice and parsed twice.

Cases: null or empty html has an empty text; a page without a host is aligned with the others
that have none; broken markup (tags unclosed, cut off or stray) is closed as its next
enclosing element closes; elements more than ``DEEPEST`` levels down count as part of the one
above; an element with over ``KINDS`` kinds of children tells them apart by tag and level only;
repeated rows and page_ids, also null ones, are kept; further columns are ignored,
whatever their names; pages are taken whole; an empty table gives an empty table.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, prepare

#: Elements of HTML that stand as blocks, that hold no markup, that have no end, that aren't main text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th
thead tr ul""".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("""aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noembed noframes
noscript object option script select style svg template textarea title video xmp""".split())
#: Names of what isn't main text, and of what is.
OTHER_NAMES = frozenset("""ad ads adsense advert advertisement advertising advertorial alert aside banner breadcrumb breadcrumbs comment
comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr hidden login masthead menu modal nav navbar
navigation newsletter notice overlay pager pagination popup promo promotion recommendations recommended related replies reply
respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget""".split())
MAIN_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
             "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
HOLDS = frozenset("ul ol dl table menu article section div body html main td th".split())

DEEPEST, KINDS, HOSTS = 64, 256, 2000
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
                   r"""|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMING = re.compile(r"""\b(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
UNSEEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none""", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SLOT = "#"
ALIGNED = "host string, share int, pages long, wrapper string"
WRAPPERS = "host string, pages long, expression string, levels string"
TEXTS = "page_id long, url string, text string"

_kinds: dict[tuple[str, str], tuple[str, str, int]] = {}


def kind_of(tag: str, attributes: str) -> tuple[str, str, int]:
    """The token of an element, its short form, and its level: 4 to 2 as main text, 0 if it says nothing, -1 as other, -2 as a header."""
    found = _kinds.get((tag, attributes))
    if found is None:
        given = [a or b or c for a, b, c in NAMING.findall(attributes)] if attributes else []
        names = {n.lower() for word in " ".join(given).split() if not re.match("(?:has|with|no)[-_A-Z]", word) for n in NAME_PART.findall(word)}
        if tag not in BLOCKS and "-" in tag:
            names |= set(tag.split("-"))
        other, main = names & OTHER_NAMES, names & MAIN_NAMES or {"article", "body"} <= names
        if tag in ("html", "body"):
            level = 0
        elif tag in NO_TEXT or (other and tag != "main") or UNSEEN.search(attributes):
            level = -1
        elif tag == "article":
            level = 4
        elif tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes, re.I):
            level = 3
        elif (tag == "header" or "header" in names) and not main:
            level = -2
        else:
            level = 2 if main and tag in ("div", "section", "td") else 0
        if len(_kinds) > 100_000:
            _kinds.clear()
        short = f"{tag}!{level}"
        found = _kinds[tag, attributes] = (".".join([tag, *sorted(names)]) + short[len(tag):] * (level != 0), short, level)
    return found


def tokens(page: str):
    """(kind, value) of a page in order: "open" (tag, attributes), "close" tag, "text" text, "break"; raw elements come without content."""
    at, end = 0, len(page)
    for_raw = None
    while at < end:
        if for_raw:
            m = re.compile(f"</{for_raw}(?=[\\s/>])", re.I).search(page, at)
            at, for_raw = m.start() if m else end, None
            continue
        m = TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            return
        if m.start() > at:
            yield "text", page[at:m.start()]
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            yield "close", tag
        elif tag in VOID:
            if tag in ("br", "hr"):
                yield "break", tag
        else:
            yield "open", (tag, attributes)
            if tag in RAW:
                for_raw = tag


class _Open:
    """An open element: where it stands in the wrapper, its last child token and those it has had."""

    __slots__ = ("tag", "at", "last", "had", "link")

    def __init__(self, tag: str, at, link: bool):
        self.tag, self.at, self.last, self.had, self.link = tag, at, "", set(), link


def walk(page: str, root, down, text) -> None:
    """Go through a page: ``down(open element, kind)`` gives a child's place in the wrapper, ``text(open element, text, link, begins)`` takes its text.

    ``begins``: whether the text begins a block.
    """
    stack, link, begins = [_Open("", root, False)], False, True

    def pop_to(k: int) -> None:
        nonlocal link
        link = stack[k].link
        del stack[k:]

    for kind, value in tokens(page):
        if kind == "text":
            text(stack[-1], entities.unescape(value) if "&" in value else value, link, begins)
            begins = begins and not value.strip()
        elif kind == "break":
            begins = True
        elif kind == "close":
            begins = begins or value in BLOCKS
            if value == "a":
                link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == value:
                    pop_to(k)
                    break
        else:
            tag, attributes = value
            block = tag in BLOCKS
            begins = begins or block
            if block:
                shut = ("p", "head", *CLOSED_BY.get(tag, ()))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in shut:
                        pop_to(k)
                    elif stack[k].tag in HOLDS and not (tag in ("tr", "tbody", "tfoot") and stack[k].tag in ("td", "th")):
                        break
            named = kind_of(tag, attributes)
            if (block or tag in NO_TEXT or named[2]) and len(stack) <= DEEPEST:
                stack.append(_Open(tag, down(stack[-1], named), link))
            if tag == "a":
                link = True


class Wrapper:
    """An element of a wrapper with all that was aligned with it.

    held: elements above that have it; times: how often it came; kids: by token; order: pairs of
    neighbours; again: tokens that came side by side; slot: [letters, letters in links, digest of the
    text or -1 if it differs, digest of the page or -1 if there are several].
    """

    __slots__ = ("held", "times", "kids", "order", "again", "slot", "short")

    def __init__(self):
        self.held = self.times = 0
        self.kids: dict[str, Wrapper] = {}
        self.order: set[tuple[str, str]] = set()
        self.again: set[str] = set()
        self.slot, self.short = None, False

    def child(self, above: _Open, kind: tuple[str, str, int]) -> Wrapper:
        """Align the next token of an open element with this one."""
        token = kind[1] if self.short else kind[0]
        kid = self.kids.get(token)
        if kid is None:
            kid = self.kids[token] = Wrapper()
            if len(self.kids) > KINDS and not self.short:
                self.shorten()
                above.last, above.had = above.last and short_token(above.last), set(map(short_token, above.had))
                return self.child(above, kind)
        if above.last == token:
            self.again.add(token)
        elif above.last:
            self.order.add((above.last, token))
        if token not in above.had:
            above.had.add(token)
            kid.held += 1
        above.last = token
        kid.times += 1
        return kid

    def shorten(self) -> None:
        """Tell children apart by tag and level only."""
        old, self.kids, self.short = self.kids, {}, True
        for token, kid in old.items():
            self.kids.setdefault(short_token(token), Wrapper()).add(kid)
        pairs = {(short_token(a), short_token(b)) for a, b in self.order}
        self.again = set(map(short_token, self.again)) | {a for a, b in pairs if a == b}
        self.order = {(a, b) for a, b in pairs if a != b}

    def take(self, letters: int, linked: int, text: int, page: int) -> None:
        if self.slot is None:
            self.slot = [letters, linked, text, page]
        else:
            s = self.slot
            self.slot = [s[0] + letters, s[1] + linked, s[2] if s[2] == text else -1, s[3] if s[3] == page else -1]

    def add(self, other: Wrapper) -> None:
        """Align another wrapper of the same host with this one."""
        if other.short and not self.short:
            self.shorten()
        elif self.short and not other.short:
            other.shorten()
        self.held += other.held
        self.times += other.times
        self.order |= other.order
        self.again |= other.again
        if other.slot:
            self.take(*other.slot)
        for token, kid in other.kids.items():
            self.kids.setdefault(token, Wrapper()).add(kid)
        if len(self.kids) > KINDS and not self.short:
            self.shorten()

    def dump(self) -> list:
        return [self.held, self.times, int(self.short), self.slot, sorted(self.order), sorted(self.again),
                {t: k.dump() for t, k in sorted(self.kids.items())}]

    @classmethod
    def load(cls, x: list) -> Wrapper:
        w = cls()
        w.held, w.times, w.short, w.slot = x[0], x[1], bool(x[2]), x[3]
        w.order, w.again = {tuple(p) for p in x[4]}, set(x[5])
        w.kids = {t: cls.load(k) for t, k in x[6].items()}
        return w

    def _groups(self) -> list[list[str]]:
        """Child tokens in order of the streams; those that come in several orders share a group (strongly connected)."""
        after: dict[str, set[str]] = {t: set() for t in self.kids}
        for a, b in self.order:
            after[a].add(b)
        reach: dict[str, set[str]] = {}
        for t in after:
            seen, todo = set(), [t]
            while todo:
                for b in after[todo.pop()] - seen:
                    seen.add(b)
                    todo.append(b)
            reach[t] = seen
        groups: dict[tuple[str, ...], list[str]] = {}
        for t in sorted(after):
            same = tuple(sorted(u for u in reach[t] if t in reach[u])) or (t,)
            groups.setdefault(same, []).append(t)
        # who is reached from more groups comes later
        return sorted(groups.values(), key=lambda g: (sum(g[0] in reach[t] for t in after if t not in g), g))

    def expression(self) -> str:
        """The children as a union-free regular expression: () element, ? optional, + repeated, # slot, = constant text."""
        out = []
        for group in self._groups():
            items = []
            for t in group:
                kid = self.kids[t]
                if t == SLOT:
                    body = "=" if kid.slot and kid.slot[2] != -1 and kid.slot[3] == -1 else SLOT
                else:
                    body = f"{t}({kid.expression()})"
                rep = "+" if t in self.again else ""
                opt = "?" if len(group) > 1 or kid.held < self.times else ""
                items.append(f"({body}){rep}{opt}" if rep and opt else body + rep + opt)
            out.append(f"({' '.join(items)})+" if len(group) > 1 else items[0])
        return " ".join(out)

    def levels(self, level: int = 1, shut: bool = False) -> list:
        """[short form or not, level of the element's slot, children]: what extraction needs."""
        kids, own = {}, 0
        for t, kid in self.kids.items():
            if t == SLOT:
                s = kid.slot
                plain = s is None or (2 * s[1] <= s[0] and not (s[2] != -1 and s[3] == -1))
                own = 0 if shut else level if level > 1 else int(plain)
            else:
                named = level_of(t)
                kids[t] = kid.levels(max(level, named), shut or named == -1 or named == -2 and level < 2)
        return [int(self.short), own, kids]


def level_of(token: str) -> int:
    """The level at the end of a token (see ``kind_of``)."""
    return int(token.partition("!")[2] or 0)


def short_token(token: str) -> str:
    return token if token == SLOT else f"{re.match('[^.!]*', token)[0]}!{level_of(token)}"


def align(wrapper: Wrapper, page: str) -> None:
    """Align a page with the wrapper of its host."""
    digest = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) >> 1
    wrapper.held += 1
    wrapper.times += 1

    def text(above: _Open, value: str, link: bool, begins: bool) -> None:
        words = value.split()
        if words:
            letters = sum(map(len, words))
            if begins or above.last != SLOT:
                kid = above.at.child(above, (SLOT, SLOT, 0))
            else:
                kid = above.at.kids[SLOT]
            kid.take(letters, letters * link, xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) >> 1, digest)

    walk(page, wrapper, lambda above, kind: above.at.child(above, kind), text)


def extract(levels: list, page: str) -> str:
    """The main text of a page under its host's wrapper."""
    blocks: list[list[tuple[int, str]]] = []

    def down(above: _Open, kind: tuple[str, str, int]):
        return above.at[2].get(kind[1] if above.at[0] else kind[0], [0, 0, {}])

    def text(above: _Open, value: str, link: bool, begins: bool) -> None:
        if begins or not blocks:
            blocks.append([])
        blocks[-1].append((above.at[1], value))

    walk(page, levels, down, text)
    best = max((level for block in blocks for level, value in block if value.strip()), default=0)
    if not best:
        return ""
    lines = (" ".join("".join([value for level, value in block if level == best]).split()) for block in blocks)
    return "\n".join(line for line in lines if line)


def _hosted(pages: DataFrame) -> DataFrame:
    """host, page_id, url, html: empty host or html for null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return rows.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")


def host_of(url: Column) -> Column:
    """The lower-cased host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _merge(batches):
    """Rows (host, share, pages, wrapper) sorted by host and share: one row for each."""
    key, pages, held = None, 0, None
    for batch in batches:
        for host, share, n, x in zip(*(batch.column(c).to_pylist() for c in ("host", "share", "pages", "wrapper")), strict=True):
            if key != (host, share):
                if held is not None:
                    yield key, pages, held
                key, pages, held = (host, share), 0, Wrapper()
            pages += n
            held.add(Wrapper.load(json.loads(x)))
    if held is not None:
        yield key, pages, held


def wrappers(pages: DataFrame, shares: int = 32) -> DataFrame:
    """host, pages, expression, levels (JSON): the wrapper of every host, from all of its pages."""
    prepare(pages.sparkSession)

    def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
        names = [f.strip().split(" ")[0] for f in schema.split(",")]
        types = {"share": pa.int32(), "pages": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types.get(n, pa.string())) for k, n in enumerate(names)], names)

    def align_all(batches):
        share, found = TaskContext.get().partitionId() % shares, {}

        def rows():
            return batch_of([(h, share, w.times, json.dumps(w.dump())) for h, w in found.items()], ALIGNED)

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                align(found.setdefault(host, Wrapper()), page)
                if len(found) > HOSTS:
                    yield rows()
                    found = {}
        yield rows()

    def merge_shares(batches):
        for (host, share), n, w in _merge(batches):
            yield batch_of([(host, 0, n, json.dumps(w.dump()))], ALIGNED)

    def finish(batches):
        for (host, _), n, w in _merge(batches):
            yield batch_of([(host, n, w.expression(), json.dumps(w.levels()))], WRAPPERS)

    parts = _hosted(pages).select("host", "html").mapInArrow(align_all, ALIGNED)
    merged = parts.repartition("host", "share").sortWithinPartitions("host", "share").mapInArrow(merge_shares, ALIGNED)
    return merged.repartition("host").sortWithinPartitions("host").mapInArrow(finish, WRAPPERS)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every row of ``pages`` (page_id, url, html)."""
    levels = kept(wrappers(pages), "wrappers").select("host", "levels")

    def read(batches):
        known: dict[str, list] = {}
        for batch in batches:
            out = []
            for levels, page in zip(batch.column("levels").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if levels not in known:
                    if len(known) >= HOSTS:
                        known.clear()
                    known[levels] = json.loads(levels)
                out.append(extract(known[levels], page))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())],
                                             ["page_id", "url", "text"])

    rows = _hosted(pages).join(levels, "host")
    return (rows.select("page_id", "url", "html", "levels").mapInArrow(read, TEXTS)
            .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars")))
