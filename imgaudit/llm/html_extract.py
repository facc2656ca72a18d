"""Main text of web pages by wrapper induction.

The pages of a host share a wrapper. Each page becomes a tree of blocks. A few pages of each host,
taken by hash, are merged into a skeleton by simple tree matching: nodes that match are one slot,
nodes that only one of the pages has go. Then every page of the host is aligned with the skeleton,
and sums over all pages tell how often a slot holds its constant text, how much of its text is
links and how much varies. Constant texts become template. From the root, the child that holds most of
the varying text is followed while it holds blocks itself; where that ends is the content slot.

Pages whose host has too few pages, or whose content is spread, are judged by their elements: the
heaviest of all article or main elements is the content, and what names mark as menus, adverts,
forms or comments goes.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

# Names of elements and name parts that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr center nobr".split()
)
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg math head title textarea select button dialog menu object canvas audio video".split())
MARKS = frozenset(
    "ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs"
    " footer masthead cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments respond replies discussion disqus"
    " related recommended share sharing social toolbar pagination pager widget skip".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Name parts that say nothing: a name of marks and these alone is a mark, "share-price" is none.
GENERIC = frozenset("box list bar button buttons wrapper wrap container inner outer section block area item items content site page global main top bottom left right links link form posts post articles article unit slot text message section group panel row col column".split())
#: Elements that a start tag of the same family closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NO_CLOSE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: A text is template if it is on this share of the (at least so many) pages that have its path.
SAME_SHARE, LEAST_PAGES = 0.9, 5
#: Pages of a host that are merged into its skeleton, and kids of one label that are slots below a parent;
#: texts of further kids are counted by what they say, wherever they stand below that parent.
REFERENCES, SKELETON_KIDS = 5, 32
#: Numbers in place of a slot: a text without one, and the page itself.
_NO_SLOT, _PAGE = -1, -2
#: The content slot is followed into a child that holds this share of the varying text.
DOMINANT = 0.7
#: A slot outside the article is a menu if links make up this share of its text.
LINK_SHARE = 0.6
#: Templates are broadcast up to so many bytes; beyond, they are joined by host.
BROADCAST_BYTES = 32 << 20
#: Keys to which the join deals the pages of a host.
SALTS = 64

# A tag ends at the first ">" outside quoted values; a quote that is never closed does not count.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*+)[^>]*>?|</[^a-zA-Z][^>]*>?"
    r"|<([a-zA-Z][^\s/>]*+)((?>[\s/]++|[^\s/>=][^\s/>=]*+(?>\s*+=\s*+(?>\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+))?+|=)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass(slots=True, eq=False)
class Block:
    """One element, with its texts (and how much of each is links) and blocks in page order."""

    tag: str
    label: str
    number: int
    boilerplate: bool
    items: list = field(default_factory=list)
    kids: dict[int, Block] = field(default_factory=dict)  # by number, in page order
    inside: bool = False  # in an article or main element, or one itself
    parent: str = ""  # labels of the blocks around it

    @property
    def text(self) -> int:
        """Hash of the block's own texts; 0 if it has none."""
        return _hash(*own) if (own := [t for t in self.items if isinstance(t, tuple)]) else 0

    @property
    def placed_text(self) -> int:
        """Hash of the block's own texts and the labels down to it; 0 if it has none."""
        return _hash((_path(self.parent, self.label), 0), *own) if (own := [t for t in self.items if isinstance(t, tuple)]) else 0


class Page:
    """The block tree of a page, and its blocks in page order."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.root = Block("html", "html", 0, False)
        self.nodes = [self.root]
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack: list[Block] = [self.root]
        inline: list[str] = []  # open inline elements
        run: list[str] = []  # text of the block at hand
        linked = 0

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                stack[-1].items.append((text, min(linked, len(text))))
            linked = 0

        def say(raw: str) -> None:
            nonlocal linked
            text = html_lib.unescape(raw)
            run.append(text)
            if "a" in inline:
                linked += len(text.strip())

        def close(depth: int) -> None:
            flush()
            del stack[depth:]
            inline.clear()

        at = 0
        while True:
            m = _TOKEN.search(html, at)
            if m is None:
                say(html[at:])
                break
            if m.start() > at:
                say(html[at : m.start()])
            at = max(m.end(), at + 1)
            end, tag = m.group(1), m.group(2)
            if end:
                end = end.lower()
                if end in INLINE:
                    if end in inline:
                        del inline[len(inline) - 1 - inline[::-1].index(end) :]
                    continue
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == end:
                        close(depth)
                        break
                continue
            if not tag:
                continue
            tag = tag.lower()
            if tag == "br" or tag == "hr":
                run.append(" ")
                continue
            if tag in VOID:
                continue
            if tag in INLINE:
                inline.append(tag)
                continue
            if tag in RAW:
                stop = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = stop.end() if stop else len(html)
                continue
            if tag in ("html", "body"):
                continue
            if tag in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag in CLOSES[tag]:
                        close(depth)
                        break
                    if stack[depth].tag in NO_CLOSE[tag]:
                        break
            else:
                for depth in range(len(stack) - 1, 0, -1):  # any block ends an open paragraph
                    if stack[depth].tag == "p":
                        close(depth)
                        break
                    if stack[depth].tag not in ("b", "i"):
                        break
            flush()
            inline.clear()
            label, boilerplate = self._label(tag, m.group(3) or "", stack[-1].inside)
            around = stack[-1]
            block = Block(tag, label, len(self.nodes), boilerplate, inside=around.inside or tag in ("article", "main"), parent=_path(around.parent, around.label))
            self.nodes.append(block)
            around.kids[block.number] = block
            stack[-1].items.append(block)
            stack.append(block)
        close(1)

    @staticmethod
    def _label(tag: str, attributes: str, inside: bool) -> tuple[str, bool]:
        """Tag with the letters of its classes, and whether it is marked as no article."""
        drop = tag in DROPPED or (tag == "header" and not inside)
        if not attributes or "=" not in attributes:
            return tag, drop
        names: list[str] = []
        marked: set[str] = set()
        for key, *values in _ATTRIBUTE.findall(attributes):
            value = "".join(values).lower()
            if key.lower() == "role":
                drop = drop or bool(ROLES & set(_NAME.findall(value)))
                continue
            for name in value.split():
                parts = _NAME.findall(name)
                names += parts
                if MARKS.intersection(parts) and not set(parts) - MARKS - GENERIC:
                    marked.update(MARKS.intersection(parts))
        if tag in ("article", "main"):
            marked &= {"comment", "comments", "related", "ad", "ads", "advert", "promo", "sponsored"}
        elif tag == "header" and inside:
            marked -= {"banner", "masthead"}
        return f"{tag}.{'.'.join(sorted(set(names)))}" if names else tag, drop or bool(marked)


def _path(parent: str, label: str) -> str:
    """The labels down to a block; long ones as a hash, so that deep pages stay small."""
    path = f"{parent}/{label}"
    return path if len(path) <= 200 else str(_hash((path, 0)))


_SAME_TEXT = 1 << 40


def tree_matching(reference: Block, page: Block, constant: dict[int, int] | None = None) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping match of equal labels; page number -> reference number.

    Among the largest matches, one with most equal texts is taken, where ``constant`` has the text
    of a reference block. Pairs of equal labels are scored from the leaves up, without recursion,
    so any depth will do.
    """
    constant = constant or {}
    pairs, seen = [(reference, page)], {(reference.number, page.number)}
    for a, b in pairs:  # grows: every pair of children that may match
        if a.kids and b.kids:
            by_label: dict[str, list[Block]] = {}
            for x in a.kids.values():
                by_label.setdefault(x.label, []).append(x)
            for y in b.kids.values():
                for x in by_label.get(y.label, ()):
                    seen.add((x.number, y.number))
                    pairs.append((x, y))
    scores: dict[tuple[int, int], int] = {}
    texts = {k: page_block.text for k, page_block in {b.number: b for _, b in pairs}.items()} if constant else {}

    def table(a: Block, b: Block) -> list[list[int]]:
        rows = [[0] * (len(b.kids) + 1)]
        ys = list(b.kids)
        for x in a.kids:
            last, row, left = rows[-1], [0], 0
            for j, y in enumerate(ys):
                best = last[j + 1] if last[j + 1] > left else left
                own = scores.get((x, y))
                if own is not None and last[j] + own > best:
                    best = last[j] + own
                row.append(best)
                left = best
            rows.append(row)
        return rows

    for a, b in reversed(pairs):
        same = constant.get(a.number, 0)
        scores[a.number, b.number] = _SAME_TEXT + (1 if same and same == texts[b.number] else 0) + (table(a, b)[-1][-1] if a.kids and b.kids else 0)
    found: dict[int, int] = {}
    open_ = [(reference, page)]
    while open_:
        a, b = open_.pop()
        found[b.number] = a.number
        if not a.kids or not b.kids:
            continue
        rows, xs, ys = table(a, b), list(a.kids.values()), list(b.kids.values())
        i, j = len(xs), len(ys)
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                open_.append((xs[i], ys[j]))
    return found


class Skeleton:
    """The slots of a host: a tree of blocks without texts, and the texts that more than one page has."""

    def __init__(self, rows: list[list]) -> None:
        """rows: parent, label, hash of the constant text or 0, of each slot, parents first."""
        self.rows = rows
        self.nodes: list[Block] = []
        for number, (parent, label, _) in enumerate(rows):
            self.nodes.append(Block(label.split(".")[0], label, number, False))
            if number:
                self.nodes[parent].kids[number] = self.nodes[-1]
        self.constant = {number: text for number, (_, _, text) in enumerate(rows) if text}

    def align(self, page: Page) -> dict[int, int]:
        """Slot of each block of a page that has one."""
        return tree_matching(self.nodes[0], page.root, self.constant)


def merged(htmls: list[str]) -> Skeleton:
    """The skeleton of some pages of a host: what at least two of them have, or all of a single one."""
    root = Block("html", "html", 0, False)
    nodes, texts = [root], [Counter()]
    held = [0]
    for html in htmls:
        page = Page(html)
        often = {k: t.most_common(1)[0][0] for k, t in enumerate(texts) if t}
        found = tree_matching(root, page.root, often)
        for block in page.nodes:  # parents first
            if block.number not in found:
                continue
            slot = nodes[found[block.number]]
            held[slot.number] += 1
            if block.text:
                texts[slot.number][block.text] += 1
            order, fresh = list(slot.kids.values()), False
            counts = Counter(k.label for k in order)
            at = 0
            for kid in block.kids.values():
                if kid.number in found:
                    at = next(i for i, k in enumerate(order) if k.number == found[kid.number]) + 1
                elif counts[kid.label] < SKELETON_KIDS:
                    new = Block(kid.tag, kid.label, len(nodes), False)
                    nodes.append(new)
                    texts.append(Counter())
                    held.append(0)
                    order.insert(at, new)
                    counts[kid.label] += 1
                    found[kid.number] = new.number
                    at, fresh = at + 1, True
            if fresh:
                slot.kids = {k.number: k for k in order}
    least = min(2, len(htmls))
    rows: list[list] = []
    open_ = [(root, 0)]
    while open_:
        block, parent = open_.pop()
        number = len(rows)
        common = texts[block.number].most_common(1)
        rows.append([parent, block.label, common[0][0] if common and common[0][1] >= least else 0])
        open_ += [(k, number) for k in reversed(block.kids.values()) if held[k.number] >= least]
    return Skeleton(rows)


@dataclass(frozen=True)
class Wrapper:
    """What a host's pages have in common: skeleton, slots of template texts and menus, content slot (0: none), template texts without a slot."""

    skeleton: Skeleton
    out: frozenset[int]
    menus: frozenset[int]
    content: int
    loose: frozenset[int] = frozenset()


def wrapper(rows: list[list], sums: list[tuple[int, int, int, int, int]], loose: list[int] | None = None) -> Wrapper:
    """Judge a host's slots by sums over its pages: (slot, pages, pages with the constant text, characters, linked ones).

    ``loose`` are the texts without a slot that nearly all pages have.
    """
    skeleton = Skeleton(rows)
    out, menus, varying = set(), set(), [0] * len(rows)
    for slot, pages, same, chars, linked in sums:
        if pages >= LEAST_PAGES and same >= pages * SAME_SHARE:
            out.add(slot)
        elif pages >= LEAST_PAGES and linked >= chars * LINK_SHARE:
            menus.add(slot)
        else:
            varying[slot] += chars - linked
    own = list(varying)
    for number in range(len(rows) - 1, 0, -1):
        varying[rows[number][0]] += varying[number]
    content, enough = 0, max((pages for _, pages, *_ in sums), default=0) >= LEAST_PAGES
    while enough and varying[content]:
        best = max(skeleton.nodes[content].kids, key=lambda k: varying[k], default=0)
        if not best or varying[best] < DOMINANT * varying[content] or own[best] >= varying[best] / 2:
            break
        content = best
    return Wrapper(skeleton, frozenset(out), frozenset(menus), content, frozenset(loose or ()))


def _hash(*texts: tuple[str, int]) -> int:
    return int.from_bytes(blake2b("\0".join(t for t, _ in texts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Aligned:
    """A page, the slots of its blocks and what the host's wrapper says of them."""

    def __init__(self, page: Page, host: Wrapper | None) -> None:
        self.page, self.host = page, host
        self.slots = host.skeleton.align(page) if host else {}

    def is_template(self, block: Block) -> bool:
        slot = self.slots.get(block.number)
        if slot is None:
            return bool(self.host and self.host.loose) and block.placed_text in self.host.loose
        return slot in self.host.out and block.text == self.host.skeleton.constant.get(slot)

    def is_menu(self, block: Block, text: str, linked: int) -> bool:
        return linked >= len(text) * LINK_SHARE and self.slots.get(block.number, -1) in (self.host.menus if self.host else ())

    def texts(self, block: Block, template: bool = False, menus: bool = True) -> list[str]:
        """Texts of a block in page order, but for those marked as boilerplate; with template texts or without, with menus or without."""
        found: list[str] = []
        open_: list[tuple] = [(block, block, False)]
        while open_:
            item, around, out = open_.pop()
            if isinstance(item, tuple):
                if not out and (menus or not self.is_menu(around, *item)):
                    found.append(item[0])
            elif item is block or not item.boilerplate:
                out = not template and self.is_template(item)
                open_ += [(x, item, out) for x in reversed(item.items)]
        return found


def _content(at: Aligned) -> list[Block]:
    """The article or main elements that hold the content, in page order; none if all are empty.

    Outermost articles below one slot (parents of one label path) count as one text, so do main
    elements. The heaviest text is the content; articles inside the heaviest main are it if they
    hold at least three quarters of its text.
    """
    groups: dict[tuple[str, str], list[Block]] = {}
    holds: dict[int, Block] = {}  # the main element around an article
    open_: list[tuple[Block, Block | None]] = [(at.page.root, None)]
    while open_:
        block, main = open_.pop()
        if block.tag in ("article", "main") and not (block.tag == "main" and main):
            groups.setdefault((block.tag, block.parent), []).append(block)
            if block.tag == "article":
                if main:
                    holds[id(block)] = main
                continue
            main = block
        open_ += [(x, main) for x in reversed(block.items) if isinstance(x, Block) and not x.boilerplate]
    best: dict[str, tuple[int, list[Block]]] = {"article": (0, []), "main": (0, [])}
    for (tag, _), blocks in groups.items():
        weight = sum(len(t) for b in blocks for t in at.texts(b, template=True))
        if weight > best[tag][0]:
            best[tag] = (weight, blocks)
    (light, articles), (heavy, mains) = best["article"], best["main"]
    inside = bool(articles) and all(holds.get(id(a)) in mains for a in articles)
    return articles if light >= (0.75 * heavy if inside else heavy) else mains


def main_text(at: Aligned) -> str:
    """Text of the content without template, else of all that is left of the page.

    The content is that of the article or main elements, unless the host's content slot holds more
    than twice their text. Content that is nothing but template (a host repeats it) is kept as it
    is. Menus are left out only where neither elements nor the host tell what the content is.
    """
    content = _content(at)
    slot = at.host.content if at.host else 0
    induced = [b for b in at.page.nodes if slot and at.slots.get(b.number) == slot and not b.boilerplate]
    size = lambda blocks: sum(len(t) for b in blocks for t in at.texts(b))
    if induced and size(induced) > 2 * sum(len(t) for b in content for t in at.texts(b, template=True)):
        content = induced
    if not content:
        return " ".join(at.texts(at.page.root, menus=False))
    texts = [t for block in content for t in at.texts(block)]
    return " ".join(texts or [t for block in content for t in at.texts(block, template=True)])


def _host(url: str = "url"):  # noqa: ANN202
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit(""))


def _with_hosts(pages: DataFrame, hosts: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """Pages with their host's row: a broadcast if all rows are small, else by a join.

    The join deals a host's pages to SALTS keys and repeats its row for each, so no host is in one task.
    """
    columns = [c for c in hosts.columns if c != "host"]
    bytes_ = hosts.agg(F.sum(sum((F.length(c) for c in columns), F.lit(200)))).first()[0] or 0
    if bytes_ <= BROADCAST_BYTES:
        known = {r["host"]: tuple(r[c] for c in columns) for r in hosts.toLocalIterator()}
        return pages.select("*", *[F.lit(None).cast("string").alias(c) for c in columns]), pages.sparkSession.sparkContext.broadcast(known)
    dealt = pages.withColumn("deal", F.xxhash64("host", F.pmod(F.xxhash64("html", "page_id"), F.lit(SALTS))))
    repeated = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).withColumn("deal", F.xxhash64("host", "salt"))
    named = repeated.select("deal", F.col("host").alias("_host"), *columns)
    return dealt.join(named, (dealt["deal"] == named["deal"]) & (F.col("host") == F.col("_host")), "left").select(*pages.columns, *columns), None


def _rows_of(batch: pa.RecordBatch, known: Broadcast | None, columns: list[str]) -> Iterator[tuple[str, str, tuple]]:
    """(host, html, the host's columns) of each page."""
    for row in range(batch.num_rows):
        host = batch.column("host")[row].as_py()
        own = known.value.get(host, (None,) * len(columns)) if known else tuple(batch.column(c)[row].as_py() for c in columns)
        yield host, batch.column("html")[row].as_py() or "", own


class _Cache(dict):
    """Hosts that a task has read already; a few at a time."""

    def of(self, key: tuple, make):  # noqa: ANN001, ANN202
        if key not in self:
            if len(self) >= 64:
                self.clear()
            self[key] = make()
        return self[key]


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, rows) of ``pages(host, html)``: the skeleton of REFERENCES pages of each host, as JSON; written."""
    full = pages.where("html is not null and html <> ''").withColumn("key", F.xxhash64("html"))
    some = full.groupBy("host", F.pmod("key", F.lit(REFERENCES)).alias("nth")).agg(F.min_by("html", "key").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(merged(htmls).rows) for htmls in batch.column("htmls").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(made, pa.string())], names=["host", "rows"])

    lists = some.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "html"))), lambda x: x["html"]).alias("htmls"))
    return materialize(lists.mapInArrow(run, "host string, rows string"), "skeletons")


def induce(pages: DataFrame) -> DataFrame:
    """(host, rows, sums, loose) of ``pages(host, page_id, html)``, written: skeletons, sums over their slots, template texts without one.

    Pages of equal html count as one.
    """
    hosts = skeletons(pages)
    ready, known = _with_hosts(pages, hosts)

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for batch in batches:
            out: list[tuple[str, int, int, int, int, int, int]] = []
            for host, html, (rows,) in _rows_of(batch, known, ["rows"]):
                if not rows:
                    continue
                skeleton = cache.of((host,), lambda rows=rows: Skeleton(json.loads(rows)))
                page = Page(html)
                key = _hash((html, 0))
                slots = skeleton.align(page)
                out.append((host, key, _PAGE, 0, 0, 1, 0))
                for block in page.nodes:
                    own = [t for t in block.items if isinstance(t, tuple)]
                    if not own:
                        continue
                    slot = slots.get(block.number, _NO_SLOT)
                    loose = block.placed_text if slot == _NO_SLOT else 0
                    same = slot != _NO_SLOT and block.text == skeleton.constant.get(slot)
                    out.append((host, key, slot, loose, int(same), sum(len(t) for t, _ in own), sum(n for _, n in own)))
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["host", "page", "slot", "loose", "same", "chars", "linked"])

    found = ready.select("host", "html", "rows").mapInArrow(slots, "host string, page long, slot long, loose long, same long, chars long, linked long")
    once = found.groupBy("host", "page", "slot", "loose").agg(*[F.first(c).alias(c) for c in ("same", "chars", "linked")])
    sums = once.groupBy("host", "slot", "loose").agg(F.count("*").alias("pages"), *[F.sum(c).alias(c) for c in ("same", "chars", "linked")])
    kept = materialize(sums.where(f"slot <> {_NO_SLOT} or pages >= {LEAST_PAGES}"), "slots")
    per_host = kept.where("slot >= 0").groupBy("host").agg(F.to_json(F.array_sort(F.collect_list(F.array("slot", "pages", "same", "chars", "linked")))).alias("sums"))
    # of the texts without a slot only those of nearly all pages are collected: no more than a page holds
    totals = kept.where(f"slot = {_PAGE}").select("host", F.col("pages").alias("total"))
    loose = kept.where(f"slot = {_NO_SLOT}").join(totals, "host").where(f"pages >= total * {SAME_SHARE}").groupBy("host").agg(F.to_json(F.array_sort(F.collect_list("loose"))).alias("loose"))
    out = materialize(hosts.join(per_host, "host", "left").join(loose, "host", "left"), "wrappers")
    if known:
        known.destroy()
    return out


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    text is the main text with character references decoded, white space inside a block as one
    space, blocks in page order joined by one space; empty if there is none, also for null html.
    Pages without a host (null or odd url) form a host of their own. Repeated and null page_ids
    keep their rows; other columns are ignored; an empty table gives no rows.
    """
    named = pages.select(F.col("page_id").cast("long"), "url", _host().alias("host"), "html")
    ready, known = _with_hosts(named, induce(named))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Cache()
        for batch in batches:
            texts = []
            for host, html, (rows, sums, loose) in _rows_of(batch, known, ["rows", "sums", "loose"]):
                judged = cache.of((host,), lambda rows=rows, sums=sums, loose=loose: wrapper(json.loads(rows), json.loads(sums or "[]"), json.loads(loose or "[]")) if rows else None)
                texts.append(main_text(Aligned(Page(html), judged)))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return ready.mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
