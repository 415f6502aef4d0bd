"""Main text of web pages, by deducing the template of each host from equivalence classes of tokens.

A token is an element in its place (its tag and class names below those of its ancestors) or a block of text in its element.
Its occurrence vector says how often it occurs on each page of the host. Tokens with one vector form an equivalence class.
Classes with several tokens that occur on enough pages are valid if they are ordered, that is their tokens come in one
cycle on all pages, and nested, that is no cycle of one is torn by tokens of another. Valid classes make up the template, a
tree in which a class stands in a gap between two tokens of the class around it. What is between template tokens are slots,
whose contents vary. The region of the main text is the template token that holds the article: one that says so, or else
the innermost that holds most of the text. Slots outside the region are left out, and so are slots inside that are menus by
their share of link text, and elements and blocks that say the same while the region varies. Where slots vary, nothing but
names tells an advert or a comment from the article, so elements named as a menu, footer, sidebar, notice, advert, form or
comment are left out as well, unless they hold the article or most of the text. The rest is the main text.

A vector is kept as the exclusive-or of a hash of (page, count) over all pages, so classes over any number of pages come
from one aggregation with partial sums, and a host with a third of all pages costs no more than others. Order and nesting
are checked page by page against the classes, in a second pass, whose findings are combined in the same way. Template
tokens are those on MIN_SHARE of a host's pages, hence a bounded number; hosts' classes are broadcast if there are few
hosts, and are else joined to pages that are salted, as one host may have very many.

Nulls: a null html is empty and gives an empty text; a null url is a host of its own, and so are all urls without a host.
Hosts with too few pages for a template, and pages without the host's region, are judged by the same rules on the page
alone. Broken markup: unclosed elements end with their parents, an unfinished tag or comment reaches to the end of the
page. Copies of a page have one text of the region, so they don't make it constant; each is extracted as it would be alone in
the host's layout. Columns other than page_id, url and html are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.llm.common import bounded_batches, small_batches, stored, texts

#: A token belongs to the template if it is on this many pages of its host, and on this share of them.
MIN_PAGES, MIN_SHARE = 3, 0.05
#: Innermost element with this share of the text is the region where none says that it is.
REGION_SHARE = 0.6
#: Slots with more link text than this are menus.
LINK_SHARE = 0.6
#: What says the same on this many pages at least, with so many different texts of the region (of 64 buckets of their hashes),
#: is constant; a block of text also has to be on this share of the pages with its element.
CONSTANT_PAGES, CONSTANT_TEXTS, CONSTANT_SHARE = 8, 6, 0.9
#: An element on this many pages may say two things and be constant.
MANY_PAGES = 100
#: In place of a block's element, for tokens of elements.
NO_ELEMENT = -1
#: Parts that each host's pages are dealt into where hosts' classes are not broadcast.
SALTS = 32
#: An element with more than this share of the text is not judged by its names, nor is it a constant slot of the region.
MOST = 0.5
#: Hosts whose templates are broadcast at most; a template has a few dozen numbers.
BROADCAST_HOSTS = 10_000
#: Elements and names of what is not main text: fixed values.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe head title object canvas math".split())
BOILER = frozenset("nav footer aside form button select textarea menu dialog".split())
BLOCK = frozenset("html body div section article main nav header footer aside form ul ol li dl dt dd p h1 h2 h3 h4 h5 h6 table thead tbody tfoot tr td th caption blockquote pre figure figcaption address fieldset details summary center hgroup dialog menu".split())
CONTAINER = frozenset("div section ul ol dl table blockquote center details article main".split())
BOILER_NAMES = frozenset("nav navbar navigation menu menubar header masthead footer sidebar side aside ad ads adv advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login form search comment comments commentlist reply replies respond disqus discussion share sharing social related recommended recommendations breadcrumb breadcrumbs pagination pager widget widgets toolbar copyright legal disclaimer skip".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Of these, what readers add or what leads elsewhere, of any length.
BULK_NAMES = frozenset("comment comments commentlist reply replies respond disqus discussion related recommended recommendations".split())
MAIN_NAMES = frozenset("article content post entry story maincontent mainbody articlebody postbody".split())
#: An opening element ends these open ones, if they are its nearest of the kind: fixed values.
ENDS = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    token: int
    name: str
    parent: int
    depth: int
    boiler: bool
    #: 3 article, 2 main, 1 named as the content, 0 neither.
    main: int
    #: Boilerplate names, where nothing else says that it is not main text.
    named: frozenset[str] = frozenset()
    mass: int = 0
    links: int = 0
    texts: list[str] = field(default_factory=list)


@dataclass
class Page:
    nodes: list[Node]
    #: (node, text, how many nodes start before it) in page order, text with its white space made single spaces.
    blocks: list[tuple[int, str, int]]


def parse(source: str) -> Page:
    """The page's elements, plain inline ones apart, and its visible text by blocks."""
    nodes, blocks, stack = [Node(0, "", -1, 0, False, 0)], [], [0]
    shares: list[int] = []
    pieces: list[str] = []
    linked = at = 0
    in_link = False

    def flush() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        if text:
            blocks.append((stack[-1], text, len(nodes)))
            shares.append(min(linked, len(text)))
        pieces.clear()
        linked = 0

    def close(names: str, within: str = "") -> None:
        names, within = names.split(), within.split()
        for k in range(len(stack) - 1, 0, -1):
            own = nodes[stack[k]].name
            if own in names:
                flush()
                del stack[k:]
                return
            if own in within:
                return

    while at < len(source):
        m = _MARKUP.search(source, at)
        run = source[at : m.start() if m else len(source)]
        if run:
            pieces.append(run)
            if in_link:
                linked += len(run.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                in_link = False
            elif name in ("br", "p") and name not in (nodes[i].name for i in stack):
                flush()
            else:
                close(name)
            continue
        if name in HIDDEN:
            if name != "head" and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                at = end.end() if end else (len(source) if name in ("script", "style") else at)
            elif name == "head":
                end = re.compile(r"</head\b[^>]*>|<body\b", re.I).search(source, at)
                at = (end.start() if end[0][1] != "/" else end.end()) if end else at
            continue
        if name in ("br", "hr"):
            flush()
        if name == "a":
            in_link = True
        if name in VOID:
            continue
        given = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])} if m[3] else {}
        words = {w.lower() for k in ("class", "id") for w in _NAME.findall(given.get(k, ""))}
        if name not in BLOCK and not words & BOILER_NAMES and name not in BOILER:
            continue
        if name in BLOCK:
            flush()
            close("p")
            if name in ENDS:
                close(*ENDS[name])
        up = nodes[stack[-1]]
        inside = any(nodes[i].main >= 2 for i in stack)
        boiler = up.boiler or name in BOILER or (name == "header" and not inside) or given.get("role", "").lower() in BOILER_ROLES
        # The whole page, its main part and what is named as an article as well are not judged by a word in their names.
        whole = name in ("html", "body", "main") or name == "article" and words & MAIN_NAMES and not any(nodes[i].name == "article" for i in stack)
        named = frozenset() if boiler or whole else frozenset(words & BOILER_NAMES - ({"header"} if inside else set()))
        main = 0 if boiler else 3 if name == "article" else 2 if name == "main" or given.get("role", "").lower() == "main" else int(bool(words & MAIN_NAMES) and name in CONTAINER)
        signature = f"{up.token}/{name}.{re.sub(r'[0-9]+', '', ' '.join(sorted(given.get('class', '').split())))}"
        nodes.append(Node(xxhash.xxh64_intdigest(signature) >> 1, name, stack[-1], up.depth + 1, boiler, main, named))
        stack.append(len(nodes) - 1)
        if m[3].rstrip().endswith("/") and name not in BLOCK:
            stack.pop()
    flush()
    judge_names(nodes, blocks)
    for (i, text, _), share in zip(blocks, shares, strict=True):
        while i >= 0 and not nodes[i].boiler:
            nodes[i].mass += len(text)
            nodes[i].links += share
            nodes[i].texts.append(text)
            i = nodes[i].parent
    return Page(nodes, blocks)


def judge_names(nodes: list[Node], blocks: list[tuple[int, str, int]]) -> None:
    """Makes elements with boilerplate names, and all below them, boilerplate, unless they hold the article or most of the
    text that is left without them."""
    if not any(n.named for n in nodes):
        return
    raw, under = [0] * len(nodes), [False] * len(nodes)
    for k, n in enumerate(nodes[1:], 1):
        under[k] = bool(n.named) or under[n.parent]
    clean = 0
    for i, text, _ in blocks:
        if nodes[i].boiler:
            continue
        clean += 0 if under[i] else len(text)
        while i >= 0:
            raw[i] += len(text)
            i = nodes[i].parent
    # Text of an element that says it is the content, outside all those with boilerplate names.
    told = any(n.main and raw[k] and not under[k] for k, n in enumerate(nodes))
    free = set()
    for k, n in enumerate(nodes):
        if n.named and raw[k] > MOST * raw[0] and not (told and n.named & BULK_NAMES):
            free.add(k)
        if not told and n.name == "article" and not n.named and not n.boiler and raw[k] > clean:
            i = n.parent
            while i >= 0:
                free.add(i)
                i = nodes[i].parent
    for k, n in enumerate(nodes[1:], 1):
        n.boiler = n.boiler or nodes[n.parent].boiler or bool(n.named) and k not in free
        n.main = 0 if n.boiler else n.main


def page_tokens(page: Page) -> dict[int, tuple]:
    """Elements' tokens, without what is named as not main text: (count, text, link text, hash of the text, depth, main, whether
    it holds elements, NO_ELEMENT)."""
    out: dict[int, list] = {}
    for n in page.nodes:
        if n.boiler:
            continue
        row = out.setdefault(n.token, [0, 0, 0, 0, n.depth, n.main, n.name in CONTAINER or n.name == "body", NO_ELEMENT])
        row[0] += 1
        row[1] += n.mass
        row[2] += n.links
        row[3] = xxhash.xxh64_intdigest("\n".join(n.texts), row[3]) >> 1
        row[5] = max(row[5], n.main)
    return {k: tuple(v) for k, v in out.items()}


def block_token(element: int, text: str) -> int:
    return xxhash.xxh64_intdigest(text, element) >> 1


def block_tokens(page: Page) -> dict[int, tuple]:
    """Tokens of blocks of text: (count, text, 0, 0, 0, 0, False, token of the element)."""
    out: dict[int, list] = {}
    for i, text, _ in page.blocks:
        n = page.nodes[i]
        if not n.boiler:
            row = out.setdefault(block_token(n.token, text), [0, 0, 0, 0, 0, 0, False, n.token])
            row[0] += 1
            row[1] += len(text)
    return {k: tuple(v) for k, v in out.items()}


def in_page_order(page: Page) -> list[int]:
    """All tokens of the page as they start, elements and blocks."""
    out, blocks = [], iter([*page.blocks, (0, "", len(page.nodes) + 1)])
    i, text, at = next(blocks)
    for k, n in enumerate(page.nodes):
        while at <= k:
            if not page.nodes[i].boiler:
                out.append(block_token(page.nodes[i].token, text))
            i, text, at = next(blocks)
        if not n.boiler:
            out.append(n.token)
    while at == len(page.nodes):
        if not page.nodes[i].boiler:
            out.append(block_token(page.nodes[i].token, text))
        i, text, at = next(blocks)
    return out


def checked_classes(tokens: list[int], class_of: dict[int, int], sizes: dict[int, int]) -> dict[int, tuple[bool, int]]:
    """For each class with a token on the page: whether it is ordered and nested there, and a hash of its cycle. It is ordered if
    its tokens come in one cycle, and nested if no cycle of it overlaps one of another ordered class: of two cycles one lies
    in a gap of the other."""
    own: dict[int, list[int]] = {}
    for t in tokens:
        if t in class_of:
            own.setdefault(class_of[t], []).append(t)
    fine = {c: len(set(x[: sizes[c]])) == sizes[c] and x == x[: sizes[c]] * (len(x) // sizes[c]) for c, x in own.items()}
    open_: list[list[int]] = []  # class and tokens of its cycle so far
    for t in tokens:
        c = class_of.get(t)
        if c is None or not fine.get(c, False) and all(entry[0] != c for entry in open_):
            continue
        if t == own[c][0]:
            open_.append([c, 1])
            continue
        at = next(k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == c)
        if at < len(open_) - 1:
            # What opened inside the cycle's gap is still open as the gap ends.
            fine[c] = False
            fine |= dict.fromkeys((entry[0] for entry in open_[at + 1 :]), False)
        open_[at][1] += 1
        if open_[at][1] == sizes[c]:
            del open_[at]
    return {c: (ok, xxhash.xxh64_intdigest(repr(own[c][: sizes[c]])) >> 1) for c, ok in fine.items()}


def own_template(page: Page) -> tuple[set[int], set[int]]:
    """Region and left-out tokens by the page alone."""
    total, found = page.nodes[0].mass, page_tokens(page)
    best, region = (-1, -1, -1), set()
    for token, (_, mass, _, _, depth, main, holds, _) in found.items():
        key = (main, mass, depth) if main and mass else (0, depth, mass) if holds and mass >= REGION_SHARE * total and mass else None
        if key and key > best:
            best, region = key, {token}
    menus = {t for t, (_, mass, links, _, _, _, holds, _) in found.items() if holds and mass and links > LINK_SHARE * mass and t not in region}
    return region, menus


def extract(page: Page, region: set[int], left_out: set[int]) -> str:
    """Blocks inside the region and outside what is left out, joined by spaces."""
    present = {n.token for n in page.nodes if not n.boiler}
    if not region & present:
        region, left_out = own_template(page)
    state = []  # per node: inside the region, left out
    for n in page.nodes:
        inside, out = state[n.parent] if n.parent >= 0 else (not region, False)
        state.append((inside or n.token in region, n.boiler or out or n.token in left_out))
    return " ".join(text for i, text, _ in page.blocks if state[i][0] and not state[i][1] and not (left_out and block_token(page.nodes[i].token, text) in left_out))


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


TOKEN = "host string, token long, page long, n long, mass long, links long, body long, depth int, main int, holds boolean, element long"


def joined_by_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """The pages (host, html, ...) with the columns of ``hosts``, null without: broadcast if there are few hosts, else joined over
    salted pages, so that a host with very many of them is not one key."""
    if hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        return pages.join(F.broadcast(hosts), "host", "left")
    salted = hosts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def frequent_tokens(pages: DataFrame) -> DataFrame:
    """(host, token, pages, vector, ...) of the tokens of each host that are on enough of its pages, and whose class has several
    tokens: one token alone carries no structure."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *[pa.int64()] * 6, pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
        for batch in small_batches(batches, "html"):
            rows = []
            for host, number, source in zip(batch.column("host").to_pylist(), batch.column("page").to_pylist(), texts(batch, "html"), strict=True):
                page = parse(source)
                rows += [(host, token, number, *found) for each in (page_tokens(page), block_tokens(page)) for token, found in each.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in TOKEN.split(", ")])

    seen = pages.select("host", "html", F.xxhash64("page_id", "url", "html").alias("page")).mapInArrow(tokens, TOKEN)
    # Bodies of an element are told apart by 64 buckets of their hashes.
    tallied = stored(seen.groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.sum("n").alias("n"), F.sum("mass").alias("mass"), F.sum("links").alias("links"),
        F.bit_count(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("body", F.lit(64)).cast("int")))).alias("bodies"), F.max("depth").alias("depth"), F.max("main").alias("main"), F.max("holds").alias("holds"), F.max("element").alias("element"))
        .where((F.col("pages") >= MIN_PAGES) | (F.col("token") == 0)), "page-tokens")
    hosts = tallied.where("token = 0").select("host", F.col("pages").alias("of"), F.col("mass").alias("total"))
    frequent = tallied.join(hosts, "host").where((F.col("pages") >= MIN_PAGES) & (F.col("pages") >= MIN_SHARE * F.col("of")))
    return stored(frequent, "frequent-tokens")


FOUND = "host string, id long, is_class boolean, ok boolean, cycle long, mass long, total long, around long"


def class_checks(pages: DataFrame, frequent: DataFrame) -> DataFrame:
    """(host, id, is_class, ok, constant): of each class whether it is ordered and nested on all pages, and of each token that may
    be constant whether it is, that is whether the region around it varies."""
    several = frequent.groupBy("host", "vector", "pages").agg(F.count("*").alias("size")).where("size > 1")
    classed = frequent.join(several, ["host", "vector", "pages"])
    best = classed.groupBy("host").agg(F.max(_region_key())["token"].alias("region"))
    classes = classed.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list("vector").alias("classes"))
    parents = frequent.where(F.col("element") == NO_ELEMENT).select("host", F.col("token").alias("element"), F.col("pages").alias("element_pages"))
    once = (F.col("n") == F.col("pages")) & (F.col("pages") >= CONSTANT_PAGES) & (F.col("mass") > 0) & (F.col("main") == 0) & (F.col("token") != 0)
    elements = frequent.where((F.col("element") == NO_ELEMENT) & once & (F.col("bodies") <= F.when(F.col("pages") >= MANY_PAGES, 2).otherwise(1))).select("host", "token")
    blocks = frequent.where((F.col("element") != NO_ELEMENT) & once).join(parents, ["host", "element"]).where(F.col("pages") >= CONSTANT_SHARE * F.col("element_pages")).select("host", "token")
    maybe = elements.union(blocks).groupBy("host").agg(F.collect_list("token").alias("maybe"))
    known = stored(classes.join(best, "host", "left").join(maybe, "host", "left"), "host-classes")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}
        for batch in small_batches(batches, "html"):
            rows = []
            columns = [batch.column(c) for c in ("tokens", "classes", "maybe", "region")]
            for k, (host, source) in enumerate(zip(batch.column("host").to_pylist(), texts(batch, "html"), strict=True)):
                if not columns[0][k].is_valid:
                    continue
                if host not in held:
                    held = held if len(held) < 1000 else {}
                    class_of = dict(zip(columns[0][k].as_py(), columns[1][k].as_py(), strict=True))
                    held[host] = class_of, Counter(class_of.values()), set(columns[2][k].as_py() or ()), columns[3][k].as_py()
                class_of, sizes, maybe, region = held[host]
                page = parse(source)
                rows += [(host, c, True, ok, cycle, 0, 0, 0) for c, (ok, cycle) in checked_classes(in_page_order(page), class_of, sizes).items()]
                own = page_tokens(page)
                if maybe and region in own:
                    around = 1 << own[region][3] % 64
                    own |= block_tokens(page)
                    rows += [(host, t, False, True, 0, own[t][1], own[region][1], around - (1 << 64) if around >> 63 else around) for t in maybe & own.keys()]
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in FOUND.split(", ")])

    seen = joined_by_host(pages.select("host", "html"), known).mapInArrow(found, FOUND)
    held = seen.groupBy("host", "id", "is_class").agg(F.bool_and("ok").alias("ok"), F.min("cycle").alias("least"), F.max("cycle").alias("most"), F.sum("mass").alias("mass"), F.sum("total").alias("total"), F.bit_count(F.bit_or("around")).alias("around"))
    constant = ~F.col("is_class") & (F.col("around") >= CONSTANT_TEXTS) & (F.col("mass") <= MOST * F.col("total"))
    return stored(held.select("host", "id", "is_class", (F.col("ok") & (F.col("least") == F.col("most"))).alias("ok"), constant.alias("constant")), "class-checks")


def _region_key() -> Column:
    """Orders the tokens that may be the region; null for others. One that says so, with the most text; else the innermost that
    holds most of the text."""
    named = (F.col("main") > 0) & (F.col("mass") > 0)
    holding = F.col("holds") & (F.col("mass") >= REGION_SHARE * F.col("total")) & (F.col("mass") > 0)
    return (F.when(named, F.struct(F.col("main").cast("long").alias("a"), F.col("mass").alias("b"), F.col("depth").cast("long").alias("c"), "token"))
            .when(holding, F.struct(F.lit(0).cast("long").alias("a"), F.col("depth").cast("long").alias("b"), F.col("mass").alias("c"), "token")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, region, left_out): the tokens of each host that hold the main text, and those that are left out of it."""
    frequent = frequent_tokens(pages)
    checks = class_checks(pages, frequent)
    valid = frequent.join(checks.where("is_class and ok").select("host", F.col("id").alias("vector")), ["host", "vector"])
    menu = F.col("holds") & (F.col("mass") > 0) & (F.col("links") > LINK_SHARE * F.col("mass"))
    found = valid.groupBy("host").agg(F.max(_region_key())["token"].alias("region"), F.collect_list(F.when(menu, F.col("token"))).alias("menus"))
    constant = checks.where("constant").groupBy("host").agg(F.collect_list("id").alias("constant"))
    none = F.array().cast("array<bigint>")
    left_out = F.filter(F.concat(F.coalesce("menus", none), F.coalesce("constant", none)), lambda x: ~x.eqNullSafe(F.col("region")))
    both = found.join(constant, "host", "full").withColumn("left_out", left_out)
    return both.select("host", F.when(F.col("region").isNotNull(), F.array("region")).otherwise(none).alias("region"), "left_out")


def main_text(pages: DataFrame) -> DataFrame:
    """One row for each row of ``pages``: page_id, url, text, n_chars."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    deduced = stored(templates(pages), "templates")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            found = [extract(parse(source), set(region or ()), set(out or ()))
                     for source, region, out in zip(texts(batch, "html"), batch.column("region").to_pylist(), batch.column("left_out").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = joined_by_host(pages, deduced).select("page_id", "url", "html", "region", "left_out")
    return joined.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
