"""Main text of web pages: markup first, nearest-URL differencing where markup is silent.

Every page is cut into text lines, one a block. What stands in menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles (by element,
role, class or identifier) goes. If the markup names the article, its lines are
the text: all outermost <article> elements, else <main>, else those named by
class; a <main> whose text mostly stands outside its articles is taken whole.

If not, the page is paired by URL path with the nearest pages of its host before
and after it that are no copies of it: other pages in the order of (path, URL,
identifier) whose longest line is another one, or, where there is none such,
whose lines differ. The lines are aligned by their longest common subsequence
and the shared ones are deleted: with two neighbours that share any, those that
both share, as a template is on all pages and a quotation or a near copy on some. Where that
would leave nothing, the page stays whole, as does one alone on its host.

Differencing an article that the markup names would delete what articles
rightly share (quotations, licences, reprints), so it isn't done there.

Pages are parsed once, into a table in the shared folder. Hosts that have a page
to difference are sorted by host and path as light rows (no texts); each
partition's last and first rows go to the next ones, so that results don't
depend on partitions and no host is gathered. Null and empty pages, and null
URLs (host ""), are allowed; repeated rows are copies of each other and get the
same text. Extra columns are ignored. Open elements end with the page.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, durable, fields, shared_table, texts

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements whose content is no markup, up to their end tag.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "xmp", "noembed", "noframes"}
#: Elements that part blocks.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul video audio".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are tracked; the others neither hide nor name anything.
HIDDEN = set("head nav footer aside form button select datalist template svg math canvas object audio video dialog menu map search".split())
WORDS = re.compile(r"[a-z]+")
HIDING = set("nav navbar navigation menu menubar footer foot sidebar sidebars aside ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion promotions cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup signin login register comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations trending breadcrumb breadcrumbs pagination pager skip toolbar widget widgets disclaimer copyright legal hidden".split())
HEADS = {"header", "masthead", "topbar", "head"}
HIDING_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NAMING = set("article post entry story content main".split())


class Element:
    __slots__ = ("tag", "hidden", "named", "blocks")

    def __init__(self, tag: str, hidden: bool, named: int, blocks: list[int] | None) -> None:
        self.tag, self.hidden, self.named, self.blocks = tag, hidden, named, blocks


def _kind(tag: str, attributes: str, inside: bool) -> tuple[bool, int]:
    """(hidden, rank of naming the article: 3 article, 2 main, 1 by class, 0 no) of a start tag."""
    a = {}
    if attributes and attributes != "/":
        a = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if tag in HIDDEN or tag == "header" and not inside:
        return True, 0
    if not a:
        return False, 3 if tag == "article" else 2 if tag == "main" else 0
    role = a.get("role", "").lower()
    if role in HIDING_ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True, 0
    names = set(WORDS.findall((a.get("class", "") + " " + a.get("id", "")).lower()))
    if names & HIDING or not inside and names & HEADS and tag not in ("body", "main", "article"):
        return tag not in ("body", "html", "main"), 0
    if tag == "article":
        return False, 3
    if tag == "main" or role == "main":
        return False, 2
    return False, int(tag in ("div", "section", "td") and bool(names & NAMING))


def blocks(page: str) -> tuple[list[str], list[int]]:
    """Blocks that a page shows, in order, and which of them the markup names as the article; none if it doesn't."""
    named: list[tuple[int, int, list[int]]] = []  # rank, the named one around it (-1: none), blocks; in page order
    within = [-1]
    every: list[str] = []
    stack: list[Element] = []
    open_: list[list[int]] = []  # what gets each block's number
    held: list[str] = []
    hidden = articles = 0
    at, size = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                for x in open_:
                    x.append(len(every))
                every.append(text)

    def close(e: Element) -> None:
        nonlocal hidden, articles
        hidden -= e.hidden
        if e.blocks is not None:
            articles -= 1
            open_.pop()  # elements close from the inside out
            within.pop()

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            if not hidden and m[0][:2] not in ("<!", "<?"):
                held.append(m[0])
            continue
        tag = tag.lower()
        if tag in BLOCKS or tag in RAW:
            flush() if not hidden else held.clear()
        if m[1]:
            if any(e.tag == tag for e in stack):
                while True:
                    e = stack.pop()
                    close(e)
                    if e.tag == tag:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in VOID or m[3].endswith("/") or tag not in BLOCKS and tag not in HIDDEN or tag in ("p", "li", "br", "hr", "tr", "dd", "dt", "option"):
            continue
        if hidden:
            stack.append(Element(tag, False, 0, None))
            continue
        hide, rank = _kind(tag, m[3], articles > 0)
        e = Element(tag, hide, rank, [] if rank else None)
        hidden += hide
        if rank:
            articles += 1
            open_.append(e.blocks)
            named.append((rank, within[-1], e.blocks))
            within.append(len(named) - 1)
        stack.append(e)
    flush() if not hidden else held.clear()
    for e in reversed(stack):
        close(e)
    return every, _article(named, [len(x) for x in every])


def _article(named: list[tuple[int, int, list[int]]], sizes: list[int]) -> list[int]:
    """Blocks of all outermost elements of the highest rank that has text, in page order.

    A <main> with more text outside the articles in it than in them is taken whole.
    """
    top = max((rank for rank, _, own in named if own), default=0)
    inner: dict[int, int] = {}  # characters of articles in each <main>

    def outermost(fits: list[bool]) -> list[int]:
        inside = [False] * len(named)
        for k, (_, around, _) in enumerate(named):
            inside[k] = around >= 0 and (inside[around] or fits[around])
        return [k for k in range(len(named)) if fits[k] and not inside[k]]

    fits = [rank == top and bool(own) for rank, _, own in named]
    if top == 3:
        for k in outermost(fits):
            size, around = sum(sizes[x] for x in named[k][2]), named[k][1]
            while around >= 0:
                if named[around][0] == 2:
                    inner[around] = inner.get(around, 0) + size
                around = named[around][1]
        for k, size in inner.items():
            fits[k] = sum(sizes[x] for x in named[k][2]) > 2 * size
    return [x for k in outermost(fits) for x in named[k][2]]


def _prefix_lengths(a: list[int], b: list[int]) -> list[int]:
    """Lengths of the longest common subsequences of ``a`` with each prefix of ``b``, in one big integer."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = bin(v)[:1:-1].ljust(len(b), "0")[: len(b)] if b else ""
    return [0, *itertools.accumulate(int(x == "0") for x in bits)]


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of the lines of ``a`` in a longest common subsequence with ``b``.

    Halves ``a`` where the two halves' lengths add up best, so that memory grows
    with the lines and not with their square.
    """
    ids: dict[str, int] = {}
    own, other = [ids.setdefault(x, len(ids)) for x in a], [ids.setdefault(x, len(ids)) for x in b]
    out: set[int] = set()
    todo = [(0, len(own), 0, len(other))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and own[i] == other[j]:
            out.add(i)
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and own[i2 - 1] == other[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.add(i2)
        if i >= i2 or j >= j2:
            continue
        if i2 - i == 1:
            if own[i] in other[j:j2]:
                out.add(i)
            continue
        middle = (i + i2) // 2
        before = _prefix_lengths(own[i:middle], other[j:j2])
        after = _prefix_lengths(own[middle:i2][::-1], other[j:j2][::-1])[::-1]
        k = max(range(j2 - j + 1), key=lambda k: before[k] + after[k])
        todo += [(i, middle, j, j + k), (middle, i2, j + k, j2)]
    return out


def difference(page: list[str], neighbours: list[list[str]]) -> list[str]:
    """The page's lines without those shared with all of the neighbours that share any."""
    sets = [x for x in (shared_lines(page, x) for x in neighbours) if x]
    if not sets:
        return page
    shared = set.intersection(*sets)
    return [x for i, x in enumerate(page) if i not in shared] or page


URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)([^?#]*)")
#: A page in the order of its host: row, longest line and all lines (hashes).
LIGHT = fields(r=T.LongType(), host=T.StringType(), path=T.StringType(), url=T.StringType(), named=T.BooleanType(), longest=T.LongType(), lines_hash=T.LongType())
#: What rows before tell: (row, longest, lines) of the last one, the last with another longest line, the last with other lines.
Told = list[tuple[int, int, int] | None]


def _tell(told: Told, row: tuple[int, int, int]) -> Told:
    """What is told after one row more."""
    last, longest, lines = told
    if last is not None and last[1] != row[1]:
        longest = last
    if last is not None and last[2] != row[2]:
        lines = last
    return [row, longest, lines]


def _nearest(told: Told, row: tuple[int, int, int]) -> set[int]:
    """The nearest row told of with other lines, and the nearest with another longest line."""
    last, longest, lines = told
    if last is None:
        return set()
    found = (last if last[1] != row[1] else longest, last if last[2] != row[2] else lines)
    return {x[0] for x in found if x is not None}


def _scan(rows: DataFrame, back: bool) -> DataFrame:
    """(r, near) of each row to difference: its nearest neighbours before it, or after it with ``back``.

    ``rows`` are checkpointed, range-partitioned and sorted, with their partition. A first pass has one
    row a partition: the rows that the next one needs of its last host. These
    are folded on the driver, a few numbers a partition.
    """

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        cols = ("part", "r", "host", "named", "longest", "lines_hash")
        if back:
            batches = reversed([b.select(cols) for b in batches])  # light rows of one partition
        for b in batches:
            own = list(zip(*(b.column(c).to_pylist() for c in cols)))
            yield from reversed(own) if back else own

    def edge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = host = part = None
        told: Told = [None] * 3
        n = 0
        for part, r, h, _, longest, lines in ordered(batches):
            if h != host:
                first, host, told = (h if n == 0 else first), h, [None] * 3
            told = _tell(told, (r, longest, lines))
            n += 1
        if n:
            flat = [x for t in told for x in (t or (-1, 0, 0))]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([first]), pa.array([host]), pa.array([flat], pa.list_(pa.int64()))], names=["k", "first", "host", "told"])

    edges = sorted(rows.mapInArrow(edge, fields(k=T.IntegerType(), first=T.StringType(), host=T.StringType(), told=T.ArrayType(T.LongType()))).collect(), key=lambda e: -e.k if back else e.k)
    carried: dict[int, tuple[str, Told]] = {}
    host, told = None, [None] * 3
    for e in edges:
        carried[e.k] = (host, told)
        own = [tuple(e.told[3 * i : 3 * i + 3]) if e.told[3 * i] >= 0 else None for i in range(3)]
        if e.host == host and e.first == host:
            # One host all through: what its rows don't tell is told by those before.
            last, longest, lines = told
            own = [own[0], own[1] or (last if last[1] != own[0][1] else longest), own[2] or (last if last[2] != own[0][2] else lines)]
        host, told = e.host, own

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, told, begun = None, [None] * 3, False
        out: list[tuple[int, int]] = []
        for part, r, h, named, longest, lines in ordered(batches):
            if not begun:
                (host, told), begun = carried[part], True
            if h != host:
                host, told = h, [None] * 3
            row = (r, longest, lines)
            if not named:
                out += [(r, x) for x in _nearest(told, row)]
            told = _tell(told, row)
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["r", "near"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["r", "near"])

    return rows.mapInArrow(find, fields(r=T.LongType(), near=T.LongType()))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: identifier, url, text, n_chars, named (whether markup named the article)."""
    pages = pages.select(id_col, url_col, html_col)
    more = fields(lines=T.ArrayType(T.StringType()), own=T.ArrayType(T.IntegerType()), named=T.BooleanType(), host=T.StringType(), path=T.StringType(), longest=T.LongType(), lines_hash=T.LongType())
    cut = T.StructType([T.StructField("key", pages.schema[0].dataType), T.StructField("url", T.StringType()), *more.fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, html_col):
            rows = []
            for key, u, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                m = URL.match(u or "")
                lines, own = blocks(raw.decode("utf-8", "replace"))
                longest = xxhash.xxh64_intdigest(max(lines, key=lambda x: (len(x), x), default="")) >> 1
                rows.append((key, u, lines, own, bool(own), m[1].lower() if m else "", m[2] if m else (u or ""), longest, xxhash.xxh64_intdigest("\n".join(lines)) >> 1))
            kinds = (key_kind, pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.int64())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=cut.names)

    key_kind = to_arrow_type(pages.schema[0].dataType)
    parsed = shared_table(pages.mapInArrow(parse, cut).withColumn("r", F.monotonically_increasing_id()), "pages")
    silent = parsed.where("not named and size(lines) > 0")
    rest = parsed.where("named or size(lines) = 0").select("key", "url", F.array_join(F.expr("transform(own, k -> element_at(lines, k + 1))"), " ").alias("text"), "named")
    if not silent.isEmpty():
        rest = rest.unionByName(_differenced(parsed, silent))
    return rest.select(F.col("key").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"), "named")


def _differenced(parsed: DataFrame, silent: DataFrame) -> DataFrame:
    """(key, url, text, named) of the pages whose markup is silent."""
    hosts = silent.select("host").distinct()
    light = parsed.join(hosts, "host", "left_semi").select([f.name for f in LIGHT])
    ordered = durable(light.repartitionByRange("host", "path", "url", "lines_hash", "r").sortWithinPartitions("host", "path", "url", "lines_hash", "r").withColumn("part", F.spark_partition_id()))
    near = durable(_scan(ordered, False).unionByName(_scan(ordered, True)))
    lines = parsed.select(F.col("r").alias("near"), F.col("lines").alias("other"))
    others = near.join(lines, "near").groupBy("r").agg(F.collect_list("other").alias("others"))  # four at most
    both = silent.join(others, "r", "left").select("key", "url", "lines", "others")
    out = T.StructType([*both.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("named", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 16):
                s = b.slice(at, 16)
                text = [" ".join(difference(x, n or [])) for x, n in zip(s.column(2).to_pylist(), s.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([s.column(0), s.column(1), pa.array(text, pa.string()), pa.array([False] * len(text))], names=out.names)

    return both.mapInArrow(run, out)
