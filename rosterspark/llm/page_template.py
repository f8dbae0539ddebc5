"""Main text of web pages by equivalence classes of tokens.

A page is a stream of tokens: its tags, each with the elements above it and its
own class and id, and its texts. Tokens of one host that occur equally often on
each of its pages share an occurrence vector and form an equivalence class.
Vectors are compared by sums of hashes of (page, count), which add up in any
order, so a host may hold any number of pages. Classes of ``MIN_CLASS`` tokens or
more that occur on at least ``SUPPORT`` of the pages are the host's candidates.

On each page a class is valid if its tokens come in one order, over and over, and
if it nests: a class that begins inside another ends before that one goes on; of
two that cross, the larger stays. Valid classes nested in each other are the
template, and what stands between two neighbouring tokens of a class is a slot,
named by the class and the place within it. Texts in slots are what the template
leaves over; texts that are themselves tokens of a class are fixed.

Which slots are the article is decided for the host as a whole, from all pages. The
slot with most characters that are neither links nor fixed is the main one. The element
with most free characters of its own, or the ``article`` or ``main`` about it, is a page's
home; pages vote with these characters for their host's. Other slots belong to the article where they stand in its home, or
hold a good share (``LARGE``) of what the main slot holds, or are first headings, if
their characters are not mostly links or fixed and their texts vary as much from page
to page. What stands elsewhere and is short, such as adverts and footers, does not.

Names only break ties. Elements that are no text by their kind (``nav``, ``footer``,
``form``) are left out; classes and ids speak where one of them is, as a whole, a name
of something else (``sidebar``, but not ``has-sidebar``), and never against the main
slot, or against most of a page that has no template. A text that one page repeats
counts once for it. A block of which one text is kept stays whole, but for what names
rule out. Kept texts follow each other block by block.

Cases: null or empty html gives an empty text; a page without a host, or of a
host with fewer than ``MIN_PAGES`` pages, has no template and is read by names
alone; tags that are never closed end with what holds them; repeated rows each
give a row, and their texts are counted once for how much a slot varies; of equal
slots the one with the smallest id is the main one; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterspark.llm.common import materialise

#: Pages from which on a host has a template, the share of them a token must occur
#: on, and tokens from which on a class is one.
MIN_PAGES, SUPPORT, MIN_CLASS = 4, 0.3, 3
#: Share of a slot's characters from which on links, fixed texts or names decide, and
#: how much less than the main slot's texts those of another slot may vary.
MOSTLY, VARIES = 0.5, 0.5
#: Share of the main slot's free characters from which on a slot outside the article's home
#: belongs to it, what a slot with another name counts for as the main one, and how many
#: elements about a block are told.
LARGE, NAMED, DEPTH = 0.25, 0.25, 12
#: Parts that a host's rows are dealt to where they meet its other rows.
SALTS = 16

# Elements by how their texts are used.
RAW = frozenset(("script", "style", "noscript", "template", "iframe", "svg", "textarea", "title"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
SKIPPED = frozenset(("nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "audio", "video"))
BLOCKS = frozenset(("address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "hr", "html", "legend", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
CLOSED_BY_NEXT = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WHOLE = frozenset(("html", "body", "main", "article"))
# Boxes are elements that may hold an article as a whole.
BOXES = frozenset(("article", "body", "div", "main", "section"))
# Whole class tokens and ids of what is no article; WEAK ones may also stand in one.
STRONG = re.compile(
    r"(?:(?:site|page|main|global|post|blog|article|top|bottom|left|right|primary|secondary)[-_]*)?(?:ads?|adverts?|advertisements?|breadcrumbs?|comments?|copyright|disqus|footer|login|masthead|menu|modal|nav|navbar|navigation|newsletter|pager|pagination|popup|promos?|recommended|recommendations|related|replies|respond|sidebar|signup|sponsors?|sponsored|subscribe|widgets?)(?:[-_]*(?:area|bar|block|box|container|form|inner|links?|list|menu|posts?|section|slot|threads?|unit|wrap|wrapper))?"
    r"|(?:cookies?|gdpr|consent)(?:[-_]*(?:banner|bar|box|consent|message|notice|popup))?|[a-z]+[-_]ads?[-_]slot",
    re.I,
)
WEAK = re.compile(r"banner|byline|header|meta|notice|share|sharing|social|tags?|teaser|toc|toolbar|tracking", re.I)
ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_BLANKS = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
#: Of a text: in a link; in something with another name, surely or perhaps; in an article; in an element that is no text by its kind.
LINK, OUT, DOUBTED, ARTICLE, KIND = 1, 2, 4, 8, 16
MASK = (1 << 64) - 1


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _signed_all(hashes: list[int]) -> list[int]:
    return [_signed(h) for h in hashes]


_TAGS: dict[tuple[str, str], tuple[int, int]] = {}


def _tag(tag: str, attributes: str) -> tuple[int, int]:
    """The hash of a tag with its class and id, without digits, and its flags."""
    if (known := _TAGS.get((tag, attributes))) is not None:
        return known
    name, flags = tag, KIND if tag in SKIPPED else LINK if tag == "a" else ARTICLE if tag in ("article", "main") else 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), entities.unescape(a or b or c)
        if key in ("class", "id"):
            name += f" {key}={_DIGITS.sub('', value)}"
            if tag not in WHOLE:
                flags |= OUT if any(map(STRONG.fullmatch, value.split())) else DOUBTED if any(map(WEAK.fullmatch, value.split())) else 0
        elif key == "role" and value.lower() in ROLES and tag not in WHOLE:
            flags |= KIND
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            flags |= KIND
    if len(_TAGS) > 50_000:
        _TAGS.clear()
    found = _TAGS[tag, attributes] = _hash(name), flags
    return found


Boxes = tuple[tuple[int, ...], int, bool, bool]  # the boxes about a text from the outside, its home, whether it is a first heading, whether in an article


def tokens_of(html: str | None) -> Iterator[tuple[int, str | None, int, bool, Boxes]]:
    """(token, text, flags, begins or ends a block, boxes) of each token of a page; token is
    0 for blanks, text is None for tags that say nothing. Linear in the length of the page."""
    source = html or ""
    # Open elements: tag, hash of the path, flags, where the paragraph that a block would end is open, and boxes.
    stack: list[tuple[str, int, int, int, Boxes]] = [("", 0, 0, -1, ((), 0, False, False))]
    open_tags: defaultdict[str, int] = defaultdict(int)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            open_tags[stack.pop()[0]] -= 1

    at, n = 0, len(source)
    while at < n:
        m = _TOKEN.match(source, at)
        at = m.end()
        piece, tag = m[0], m[2]
        if not tag:
            if piece[0] != "<" or piece == "<":
                said = " ".join(piece.split())
                yield (_hash(f"text {said}") if said else 0), piece, stack[-1][2], False, stack[-1][4]
            continue
        tag = tag.lower()
        if m[1]:
            if open_tags[tag]:
                flags = stack[-1][2]
                depth = len(stack) - 1
                while stack[depth][0] != tag:
                    depth -= 1
                own = stack[depth][1]
                close_to(depth)
                yield own ^ 0x5555555555555555, None, flags, tag in BLOCKS or tag in SKIPPED, stack[-1][4]
            elif tag in BLOCKS:
                yield 0, None, stack[-1][2], True, stack[-1][4]
            continue
        name, flags = _tag(tag, m[3])
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>?", re.I).search(source, at)
            at = close.end() if close else n
            yield (stack[-1][1] * 31 + name) & MASK, None, KIND, tag != "svg", stack[-1][4]
            continue
        if tag in BLOCKS and stack[-1][3] >= 0:
            close_to(stack[-1][3])
        for closes in CLOSED_BY_NEXT.get(tag, ()):
            if stack[-1][0] == closes:
                close_to(len(stack) - 1)
        above = stack[-1]
        if tag == "header" and above[2] & ARTICLE:
            flags &= ~KIND  # an article's own head
        path = (above[1] * 0x9E3779B97F4A7C15 + name) & MASK
        flags |= above[2]
        chain, home, heading, inside = boxes = above[4]
        if tag in BOXES:
            chain = (*chain, path) if len(chain) < DEPTH else chain
            boxes = chain, home if inside else chain[-1], heading, bool(flags & ARTICLE)
        elif tag == "h1":
            boxes = chain, home, True, inside
        yield path, " " if tag == "br" else None, flags, tag in BLOCKS or tag in SKIPPED, boxes
        if tag not in VOID and not piece.endswith("/>"):
            paragraph = len(stack) if tag == "p" else -1 if tag in BLOCKS or tag in SKIPPED else above[3]
            stack.append((tag, path, flags, paragraph, boxes))
            open_tags[tag] += 1


def nested(tokens: list[int], classes: list[list[int]]) -> list[int]:
    """The slot after each token of a page: 0 outside every class, else a hash of the
    innermost class that is open and of how many of its tokens have come."""
    place = {t: (c, j) for c, own in enumerate(classes) for j, t in enumerate(own)}
    met = [(i, *place[t]) for i, t in enumerate(tokens) if t in place]
    dropped: set[int] = set()
    expected: defaultdict[int, int] = defaultdict(int)
    for _, c, j in met:  # in one order, over and over
        if expected[c] != j:
            dropped.add(c)
        expected[c] = (j + 1) % len(classes[c])
    dropped |= {c for c, j in expected.items() if j}
    while True:
        stack: list[tuple[int, int]] = []
        slots, done, crossed = [0] * len(tokens), 0, None
        at = 0
        for i, c, j in met:
            if c in dropped:
                continue
            if j == 0:
                after = [*stack, (c, 0)]
            elif stack[-1][0] == c:
                after = [*stack[:-1], (c, j)]
            else:
                crossed = min((len(classes[x]), -x) for x in (c, stack[-1][0]))
                break
            slots[done:i] = [at] * (i - done)
            done, stack = i, after
            if j == len(classes[c]) - 1:
                stack = stack[:-1]
            at = _hash(f"{classes[stack[-1][0]][0]} {stack[-1][1]}") if stack else 0
        if crossed is None:
            slots[done:] = [at] * (len(tokens) - done)
            return slots
        dropped.add(-crossed[1])


def pieces_of(html: str | None, classes: list[list[int]]) -> list[tuple[Boxes, list[tuple[int, str, int, bool]]]]:
    """The blocks of a page: the boxes about each, and a list of (slot, text, flags, fixed)
    with blanks folded."""
    page = list(tokens_of(html))
    slots = nested([t for t, *_ in page], classes) if classes else [0] * len(page)
    fixed = {t for own in classes for t in own}
    blocks: list[tuple[Boxes, list[tuple[int, str, int, bool]]]] = []
    fresh = True
    for (token, text, flags, edge, boxes), slot in zip(page, slots, strict=True):
        fresh |= edge
        if text is not None:
            if fresh:
                blocks.append((boxes, []))
                fresh = False
            block = blocks[-1][1]
            own = (_signed(slot), flags & (LINK | OUT | DOUBTED | KIND), token in fixed and token != 0)
            last = block[-1] if block else None
            if last and (last[0], last[2], last[3]) == own:
                block[-1] = (own[0], last[1] + text, *own[1:])
            else:
                block.append((own[0], text, *own[1:]))
    folded = [(x, [(s, _BLANKS.sub(" ", entities.unescape(t)), f, k) for s, t, f, k in b]) for x, b in blocks]
    return [(x, b) for x, b in folded if any(t.strip() for _, t, _, _ in b)]


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def meet(rows: DataFrame, hosts: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with the one row of their host in ``hosts``; a host's rows are
    dealt to ``SALTS`` parts by ``spread``, so that a large host is no single task."""
    salted = hosts.withColumnRenamed("host", "_host").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_part", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return rows.join(salted, (F.col("host") == F.col("_host")) & (F.col("_part") == F.col("_salt")), how).drop("_host", "_salt", "_part")


def host_classes(pages: DataFrame, min_pages: int = MIN_PAGES, support: float = SUPPORT, min_class: int = MIN_CLASS) -> DataFrame:
    """(host, classes): of each host the token lists of its equivalence classes, each in
    the order of their mean places, which is their order wherever they have one."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # Of each host and token: sums of both halves of the marks, pages and first places.
            held: dict[tuple[str, int], list[int]] = {}
            for host, html in zip(b["host"], b["html"], strict=True):
                seen: dict[int, list[int]] = {}
                for place, (token, *_) in enumerate(tokens_of(html)):
                    if token:
                        if (own := seen.get(token)) is None:
                            seen[token] = [1, place]
                        else:
                            own[0] += 1
                page = _hash(html or "")
                for token, (n, place) in seen.items():
                    mark = (page ^ n * 0xC2B2AE3D27D4EB4F) * 0x9E3779B97F4A7C15 & MASK
                    own = held.setdefault((host, token), [0, 0, 0, 0])
                    own[0] += mark >> 33
                    own[1] += mark & 0x7FFFFFFF
                    own[2] += 1
                    own[3] += place
            rows = [(h, _signed(t), *own) for (h, t), own in held.items()]
            yield pd.DataFrame(rows, columns=["host", "token", "high", "low", "pages", "place"])

    met = pages.where("host <> ''").select("host", "html").mapInPandas(count, "host string, token long, high long, low long, pages long, place long")
    # 31 bits a page: the sums of two thousand million pages fit.
    vectors = met.groupBy("host", "token").agg(*[F.sum(c).alias(c) for c in ("high", "low", "pages", "place")]).where(F.col("pages") >= min_pages)
    sizes = pages.where("host <> ''").groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    vectors = meet(vectors, sizes, F.col("token")).where(F.col("pages") >= support * F.col("n"))
    # A host has at most 1 / support times as many such tokens as a page of its has on average.
    classes = vectors.groupBy("host", "high", "low").agg(F.array_sort(F.collect_list(F.struct((F.col("place") / F.col("pages")).alias("place"), "token"))).alias("own"))
    classes = classes.where(F.size("own") >= min_class).select("host", F.transform("own", lambda x: x["token"]).alias("tokens"))
    return classes.groupBy("host").agg(F.array_sort(F.collect_list("tokens")).alias("classes"))


BLOCKS_OF = "array<struct<box:int,pieces:array<struct<slot:bigint,text:string,flags:int,fixed:boolean>>>>"
PIECES = f"page_id long, url string, host string, templated boolean, page_home array<bigint>, page_free long, page_large array<bigint>, boxes array<struct<chain:array<bigint>,home:bigint,heading:boolean>>, blocks {BLOCKS_OF}"


def page_home(blocks: list[tuple[Boxes, list[tuple[int, str, int, bool]]]], names: bool) -> tuple[list[int], int, list[int]]:
    """The home with most free characters on a page, behind the boxes about it unless it is
    an ``article``; how many characters; and all homes that hold a good share of them."""
    free: defaultdict[int, int] = defaultdict(int)
    named: defaultdict[int, int] = defaultdict(int)
    about: dict[int, list[int]] = {}
    for (chain, home, _, inside), block in blocks:
        about[home] = [home] if inside or home not in chain else [*chain[: chain.index(home) + 1]]
        for _, text, flags, fixed in block:
            if not flags & (LINK | KIND if names else LINK) and not fixed:
                free[home] += len(text)
                named[home] += len(text) if names and flags & (OUT | DOUBTED) else 0
    if not free:
        return [], 0, []
    best = max(free, key=lambda h: (free[h] - (1 - NAMED) * named[h], free[h], -h))
    return about[best], free[best], [h for h in free if free[h] >= LARGE * free[best] and named[h] <= MOSTLY * free[h]]


def page_pieces(pages: DataFrame, classes: DataFrame, names: bool = True) -> DataFrame:
    """Each page's blocks, with the slots that its host's template puts their texts in."""

    def told(page: list) -> tuple[list, list]:
        """The kinds of boxes on a page, and its blocks with the number of theirs."""
        known: dict[Boxes, int] = {}
        blocks = [(known.setdefault(boxes, len(known)), block) for boxes, block in page]
        return [(_signed_all(chain), _signed(home), heading) for chain, home, heading, _ in known], blocks

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known = [[[int(t) & MASK for t in own] for own in c] if c is not None else [] for c in b["classes"]]
            pages_of = [pieces_of(h, c) for h, c in zip(b["html"], known, strict=True)]
            homes, parts = [page_home(x, names) for x in pages_of], [told(x) for x in pages_of]
            own = {"page_home": [_signed_all(h) for h, _, _ in homes], "page_free": [n for _, n, _ in homes], "page_large": [_signed_all(large) for _, _, large in homes]}
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "host": b["host"], "templated": b["classes"].notna()} | own | {"boxes": [x for x, _ in parts], "blocks": [x for _, x in parts]})

    kind = PIECES.replace("page_id long", f"page_id {pages.schema['page_id'].dataType.simpleString()}")
    joined = meet(pages, classes, F.struct("page_id", F.xxhash64("html")), "left")
    return materialise(joined.mapInPandas(read, kind), "pieces")


def _has(flags: Column, some: int) -> Column:
    return flags.bitwiseAND(F.lit(some)) != 0


def article_slots(pieces: DataFrame, names: bool = True) -> DataFrame:
    """(host, slots, home, large, fixed_too, named_too): of each host with a template the
    slots that may be its articles', the article's home, the slots that belong to it
    elsewhere too, and whether the main one consists of fixed texts, as with copies, or of
    texts in elements with other names."""
    kinds = KIND if names else 0
    flat = pieces.where("templated").select("host", "page_id", F.explode("blocks").alias("b")).select("host", "page_id", F.explode("b.pieces").alias("p")).select("host", "page_id", "p.*")
    n = F.char_length("text")
    of = {"link": _has(F.col("flags"), LINK), "kind": _has(F.col("flags"), kinds), "named": _has(F.col("flags"), OUT | DOUBTED if names else 0), "fixed": F.col("fixed")}
    mine = ~of["link"] & ~of["kind"]
    sums = [F.sum(n).alias("chars"), *[F.sum(F.when(is_it, n).otherwise(0)).alias(k) for k, is_it in of.items()], F.sum(F.when(mine, n).otherwise(0)).alias("own"), F.sum(F.when(mine & of["named"], n).otherwise(0)).alias("own_named")]
    sums.append(F.sum(F.when(mine & ~of["fixed"], n).otherwise(0)).alias("free"))
    varies = (F.approx_count_distinct("text", 0.02) / F.approx_count_distinct(F.struct("page_id", "text"), 0.02)).alias("varies")
    votes = pieces.where("templated").groupBy("host", "page_home").agg(F.sum("page_free").alias("free"))
    homes = votes.groupBy("host").agg(F.max_by("page_home", F.struct("free", "page_home")).alias("home"))
    stats = flat.groupBy("host", "slot").agg(*sums, varies)
    # What a slot counts for as the main one: less if names speak against it.
    worth = F.when(F.col("own_named") > MOSTLY * F.col("own"), NAMED).otherwise(1.0)
    rank = F.struct((F.col("free") * worth).alias("free"), (F.col("own") * worth).alias("own"), -F.col("slot"))
    # A host has as many slots as its template has gaps.
    per = stats.groupBy("host").agg(F.max_by(F.struct("slot", "free", "own", "own_named", "varies"), rank).alias("main"), F.collect_list(F.struct("slot", "chars", "link", "kind", "named", "fixed", "free", "varies")).alias("all"))

    def is_article(x: Column) -> Column:
        rather = (x["link"] <= MOSTLY * x["chars"]) & (x["kind"] <= MOSTLY * x["chars"]) & (x["named"] <= MOSTLY * x["chars"]) & (x["fixed"] <= MOSTLY * x["chars"])
        return (x["slot"] == F.col("main.slot")) | (rather & (x["varies"] >= VARIES * F.col("main.varies")))

    per = per.withColumn("all", F.filter("all", is_article))
    large = F.filter("all", lambda x: x["free"] >= LARGE * F.col("main.free"))
    return per.join(homes, "host").select(
        "host", F.transform("all", lambda x: x["slot"]).alias("slots"), "home", F.transform(large, lambda x: x["slot"]).alias("large"), F.col("main.slot").alias("main"),
        (F.col("main.free") < (1 - MOSTLY) * F.col("main.own")).alias("fixed_too"), (F.col("main.own_named") > MOSTLY * F.col("main.own")).alias("named_too"),
    )


def extract(pages: DataFrame, names: bool = True, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; without ``names`` a host's template alone decides."""
    pages = pages.select("page_id", "url", "html").withColumn("host", host_of(F.col("url")))
    pieces = page_pieces(pages, materialise(host_classes(pages, min_pages), "classes"), names)
    # Written first, so that Spark knows its size and sends it to all tasks only where it is small.
    joined = meet(pieces, materialise(article_slots(pieces, names), "article-slots"), F.struct("page_id"), "left")
    kinds, surely, perhaps = (KIND, OUT, OUT | DOUBTED) if names else (0, 0, 0)

    def free_of_names(p: Column) -> Column:
        return ~_has(p["flags"], surely) | (F.col("named_too") & (p["slot"] == F.col("main")))

    def chosen(p: Column) -> Column:
        free = F.coalesce(F.array_contains("slots", p["slot"]), F.lit(False)) & (F.col("fixed_too") | ~p["fixed"])
        return free & ~_has(p["flags"], kinds) & free_of_names(p) & (F.trim(p["text"]) != "")

    def box_of(b: Column) -> Column:
        return F.get("boxes", b["box"])

    def in_home(b: Column, home: Column) -> Column:
        # In the home, or straight in a box about it.
        return F.array_contains(box_of(b)["chain"], F.element_at(home, -1)) | F.array_contains(home, box_of(b)["home"])

    def by_template(b: Column) -> Column:
        # One chosen text brings the words about it along: a block is no patchwork.
        placed = in_home(b, F.col("home")) | box_of(b)["heading"]
        of_article = F.exists(b["pieces"], lambda p: chosen(p) & (placed | F.array_contains("large", p["slot"])))
        return F.filter(b["pieces"], lambda p: of_article & ~_has(p["flags"], kinds) & free_of_names(p))

    def length(some: Column) -> Column:
        return F.aggregate("blocks", F.lit(0), lambda s, b: s + F.aggregate(F.filter(b["pieces"], lambda p: ~_has(p["flags"], kinds | LINK) & some(p)), F.lit(0), lambda t, p: t + F.char_length(p["text"])))

    def lines(pieces_of_block) -> Column:
        found = F.transform("blocks", lambda b: F.trim(F.regexp_replace(F.array_join(F.transform(pieces_of_block(b), lambda p: p["text"]), ""), " +", " ")))
        return F.array_join(F.filter(found, lambda x: x != ""), "\n")

    # Of a page without a template, names that would leave less than half of it say nothing.
    trusted = 2 * length(lambda p: ~_has(p["flags"], perhaps)) >= length(lambda p: F.lit(True))

    def by_page(b: Column) -> Column:
        placed = in_home(b, F.col("page_home")) | F.array_contains("page_large", box_of(b)["home"]) | box_of(b)["heading"]
        return F.filter(b["pieces"], lambda p: placed & ~_has(p["flags"], kinds) & (~_has(p["flags"], perhaps) | ~F.col("trusted")))

    out = joined.withColumn("found", F.when(F.col("templated"), lines(by_template)).otherwise("")).withColumn("trusted", trusted)
    text = F.when(F.col("found") != "", F.col("found")).otherwise(lines(by_page))
    out = out.select("page_id", "url", text.alias("text"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
