"""Main text of web pages by wrapper induction over pages of the same host."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forumlens.llm.batches import refuse_clash
from forumlens.llm.dom import TEXT, Node, from_skeleton, match, parse, skeleton

REFERENCES = 8  # pages of a layout of a host that every page of it is aligned with
CANDIDATES = 16  # pages of a layout that these are chosen from, near copies left out
FEWEST = 4  # references of a layout, itself counted, below which other layouts of the host are used too
CONSTANT = 0.7  # share of the references in which a template's text is the same
MANY = 4  # references that are needed to call a line of an article template
SALTS = 16
# Start tags of elements that hold blocks, with their class: what a layout consists of.
LAYOUT = r"<((?:body|div|section|article|main|nav|aside|header|footer|form)\b(?:[^>]{0,300}?\sclass\s*=\s*[\"']?[a-z _-]*)?)"
# Elements beside the text of a page, and words in the names of such elements (fixed values).
BESIDE = frozenset("head nav footer aside form button menu dialog fieldset".split())
BESIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments "
    "consent cookie cookies copyright disclaimer disqus feedback foot footer form gdpr header legal login masthead menu "
    "menus modal nav navbar navigation newsletter notice notices notification outbrain pager pagination paywall popup "
    "promo promoted promotion recommended register related replies reply respond search share sharing sidebar signup "
    "skip social sponsor sponsored subscribe subscription taboola tags toolbar topbar widget widgets".split()
)
# Of these, the words for readers' comments.
READER_WORDS = frozenset("comment comments disqus replies reply respond".split())
# Words of names that tell of a part rather than name it, as in no-comments.
WRAPPER_WORDS = frozenset("content free has layout no non page with without wrap wrapper".split())
# Elements that hold the text of a page; their own names say nothing against them.
HOLDERS = frozenset("html body main article".split())
MAIN_WORDS = frozenset("main".split())


def host(url: Column) -> Column:
    """The host of an address, lower-cased; empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def text_key(text: str) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    return f"{zlib.crc32(raw):08x}{zlib.adler32(raw):08x}{len(raw):x}"


def _beside(node: Node, inside: bool) -> bool:
    """The element is of a kind that is no part of an article. `inside`: an element that holds one is around it."""
    return node.hidden or node.label in BESIDE or node.label == "header" and not inside


def _named_beside(node: Node, inside: bool) -> bool:
    """The element's names speak against it."""
    return node.label not in HOLDERS and any(
        w in BESIDE_WORDS and not (inside and w == "header") for w in node.names
    )


class Block:
    """A run of text with what holds it (`main`, `article` or nothing) and the elements around it whose names speak against it."""

    def __init__(self, node: Node, held: str, named: tuple[Node, ...]):
        self.node, self.held, self.named = node, held, named


def blocks(root: Node) -> tuple[list[Block], set[int]]:
    """Runs of text in page order that may be content, and the named elements (by `id`) that hold a `main` or `article`."""
    out, holding = [], set()
    todo: list[tuple[Node, str, tuple[Node, ...]]] = [(root, "", ())]
    while todo:
        node, held, named = todo.pop()
        if node.label == TEXT:
            out.append(Block(node, held, named))
            continue
        if _beside(node, bool(held)):
            continue
        if _named_beside(node, bool(held)):
            named = (*named, node)
        elif node.label == "main" or MAIN_WORDS & set(node.names) and node.label != "body":
            held = held or "main"
            holding |= {id(n) for n in named}
        if node.label == "article":
            held = "article"
            holding |= {id(n) for n in named}
        todo += [(c, held, named) for c in reversed(node.children)]
    return out, holding


def not_beside(found: list[Block], holding: set[int]) -> list[Block]:
    """The blocks that no name speaks against.

    Names are a weak sign: an element around an article or main element is no
    part beside it, whatever it is called. On a page without such an element,
    one that holds most of the text that varies counts as its article; readers'
    comments, however long, are left out of this.
    """
    size: Counter = Counter()
    total = 0
    for b in found:
        if not any(READER_WORDS & set(n.names) and not WRAPPER_WORDS & set(n.names) and id(n) not in holding for n in b.named):
            total += len(b.node.text)
            for n in b.named:
                size[id(n)] += len(b.node.text)
    some_holder = holding or any(b.held for b in found)

    def against(n: Node) -> bool:
        if id(n) in holding:
            return False
        return bool(some_holder) or 2 * size[id(n)] <= total

    return [b for b in found if not any(against(n) for n in b.named)]


def layout(page: Column) -> Column:
    """A number for the kinds of block-holding elements in a page, whatever their number and order."""
    return F.xxhash64(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(page), F.lit(LAYOUT), F.lit(1)))))


def main_text(page: str, references: list[Node]) -> str:
    """Text blocks of the page that vary between pages of its host; names and elements decide between these."""
    root = parse(page)
    found, holding = blocks(root)
    sames = [
        {id(x) for x, y in match(root, other) if x.label == TEXT and text_key(x.text) == y.text} for other in references
    ]
    common = {k for k, n in Counter(k for same in sames for k in same).items() if n >= max(2, CONSTANT * len(sames))}
    # a near copy of this page (beside what the pages of the host share) shows nothing about the host's template
    varying = [b for b in found if id(b.node) not in common]
    own = [(id(b.node), len(b.node.text)) for b in not_beside(varying, holding)]
    total = sum(size for _, size in own)
    sames = [same for same in sames if 2 * sum(size for k, size in own if k in same) <= total]
    seen, compared = Counter(k for same in sames for k in same), len(sames)
    if compared > 1:
        found = [b for b in found if seen[id(b.node)] < CONSTANT * compared or b.held and compared < MANY]
    found = [(b.node, b.held) for b in not_beside(found, holding)]
    for holder in ("article", "main"):
        inside = [n for n, h in found if h == holder]
        if inside:
            outside = sum(len(n.text) for n, h in found if not h and n.linked * 2 < len(n.text))
            if compared >= MANY and sum(len(n.text) for n in inside) < outside:
                break  # most of the text that varies is in other slots
            return " ".join(n.text for n in inside)
    # no element says where the text is: lists of links are not in it
    return " ".join(n.text for n, _ in found if n.linked * 2 < len(n.text) or len(n.text) > 200)


def _least(rows: pa.Table) -> pa.Table:
    """The rows with the least distinct keys."""
    rows = rows.sort_by("key")
    keys = rows.column("key").to_pylist()
    some = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1]][:CANDIDATES]
    return rows.take(pa.array(some, pa.int64()))


def distinct_trees(trees: list[str]) -> list[int]:
    """Positions of the first `REFERENCES` trees of which none is a near copy of another.

    Text that most trees have is no sign of a copy, unless a page has hardly any
    other: pages that share nearly everything are copies of each other.
    """
    texts = []
    for tree in trees:
        keys = (line.split(" ")[2] for line in tree.split("\n"))
        texts.append({k: int(k[16:], 16) for k in keys if k})
    held = Counter(k for t in texts for k in t)
    common = {k for k, n in held.items() if n >= max(2, CONSTANT * len(texts))}
    kept: list[int] = []
    for i, own in enumerate(texts):
        rest = {k: n for k, n in own.items() if k not in common}
        bare = 10 * sum(rest.values()) < sum(own.values())
        for j in kept:
            if bare:
                shared, total = sum(n for k, n in own.items() if k in texts[j]), sum(own.values())
            else:
                shared, total = sum(n for k, n in rest.items() if k in texts[j]), sum(rest.values())
            if 2 * shared > total:
                break
        else:
            kept.append(i)
    return kept[:REFERENCES]


def references(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(host, layout, keys, trees): skeletons of pages of each layout of a host, those with the least hashes of their text.

    Each task keeps the least of each layout it meets; these are put together by
    host, layout and salt and then by host and layout, so a host with a third of
    all pages is no more work for any task than the few pages each has kept.
    Near copies are left out at the end. The layout null stands for all pages of
    the host.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int | None], dict[int, str]] = {}
        for batch in batches:
            for at, kind, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "layout", "key", "page"))):
                for group in ((at, kind), (at, None)):
                    own = kept.setdefault(group, {})
                    if key not in own and (len(own) < CANDIDATES or key < max(own)):
                        own[key] = page
                        if len(own) > CANDIDATES:
                            del own[max(own)]
        made: dict[int, str] = {}
        for (at, kind), own in kept.items():
            for k, p in own.items():
                if k not in made:
                    made[k] = skeleton(parse(p), text_key)
            n = len(own)
            columns = [pa.array([at] * n, pa.string()), pa.array([kind] * n, pa.int64()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([made[k] for k in own], pa.string())], names)

    def chosen(rows: pa.Table) -> pa.Table:
        rows = _least(rows)
        return rows.take(pa.array(distinct_trees(rows.column("tree").to_pylist()), pa.int64()))

    names = ["host", "layout", "key", "tree"]
    kind = "host string, layout long, key long, tree string"
    page = F.col(html_col)
    rows = pages.select(host(F.col(url_col)).alias("host"), layout(page).alias("layout"), F.xxhash64(page).alias("key"), page.alias("page"))
    some = rows.where("host <> '' and page is not null").mapInArrow(run, kind)
    salted = some.withColumn("salt", F.spark_partition_id() % SALTS).groupBy("host", "layout", "salt").applyInArrow(
        lambda rows: _least(rows).select(names), kind
    )
    least = salted.groupBy("host", "layout").applyInArrow(chosen, kind)
    ordered = F.sort_array(F.collect_list(F.struct("key", "tree")))
    return least.groupBy("host", "layout").agg(F.transform(ordered, lambda x: x["tree"]).alias("trees"), F.transform(ordered, lambda x: x["key"]).alias("keys"))


def extract(pages: DataFrame, url_col: str, html_col: str, prefix: str = "main_") -> DataFrame:
    """Add `<prefix>text`: the article of each page.

    Every page is aligned by simple tree matching with up to `REFERENCES` other
    pages of its host that have its layout (the same kinds of block-holding
    elements); where these are fewer than `FEWEST`, pages of other layouts of the
    host are used too. Near copies of each other are left out of these, and near
    copies of the page. Text that is the same in nearly all of them is template, inside an
    `article` or `main` element too if at least `MANY` were compared. Slots that
    vary are content, unless they stand in elements beside the article (menus,
    headers, footers, sidebars, notices, adverts, forms, comments): elements of
    such a kind, or named so and not around the article (`not_beside`; names
    decide after the comparison only). Where text varies inside an `article` or `main` element and
    outside, the text inside counts, unless it is the smaller part.

    Character references are decoded, white space in a block is one space, and
    blocks are joined by one space; nothing is shortened. Null or empty html
    gives an empty text; a null or odd url has no host and no template. Repeated
    rows stay and are not references of each other. All columns stay; one named
    like the result is refused. An empty table stays empty.
    """
    refuse_clash(pages, [f"{prefix}text"])
    page_columns = [f"`{c}`" for c in pages.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    made = references(pages, url_col, html_col)
    page = F.col(html_col)
    rows = pages.select(
        F.struct(*(F.col(c) for c in page_columns)).alias("page"), host(F.col(url_col)).alias("host"),
        layout(page).alias("layout"), F.xxhash64(page).alias("key"),
    )
    same = made.where("layout is not null").select(F.col("host").alias("h"), F.col("layout").alias("l"), F.struct("keys", "trees").alias("same"))
    others = made.where("layout is null").select(F.col("host").alias("o"), F.struct("keys", "trees").alias("others"))
    known = same.join(others, F.col("h") == F.col("o")).select("h", "l", "same", "others")
    joined = rows.join(known, (F.col("host") == F.col("h")) & F.col("layout").eqNullSafe(F.col("l")), "left").select(
        "page", "host", "layout", "key", "same", "others"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, near = None, []
        for batch in batches:
            page = batch.column("page")
            hosts, kinds, own = (batch.column(c).to_pylist() for c in ("host", "layout", "key"))
            texts = []
            for i, (key, raw) in enumerate(zip(own, page.field(html_col).to_pylist())):
                if (hosts[i], kinds[i]) != at:
                    at = (hosts[i], kinds[i])
                    same, others = (batch.column(c)[i].as_py() or {"keys": [], "trees": []} for c in ("same", "others"))
                    found = dict(zip(same["keys"], same["trees"]))
                    if len(found) < FEWEST:
                        found |= dict(zip(others["keys"], others["trees"]))
                    near = [(k, from_skeleton(t)) for k, t in found.items()]
                texts.append(main_text(raw or "", [t for k, t in near if k != key]))
            yield pa.RecordBatch.from_arrays(
                [*(page.field(k) for k in range(page.type.num_fields)), pa.array(texts, pa.string())],
                [*(page.type.field(k).name for k in range(page.type.num_fields)), f"{prefix}text"],
            )

    return joined.mapInArrow(run, f"{schema}, `{prefix}text` string")
