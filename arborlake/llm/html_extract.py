"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree, held as rows: a node is a path of tags and class
names, its presentation is the sequence of child tags that it shows on a page, its content the text
blocks that stand in it. A node's importance is high if its presentation and content vary from page to
page, low if they recur: with m pages, presentations of shares p have importance -sum p log_m p, and a
block on k pages has entropy log_m k; content importance is one minus the mean entropy of the node's
blocks (Yi, Liu and Li 2003). The composite of both decides whether a branch is removed. Hosts of few
pages say little, so the tree merged over all hosts decides beside the host's own. Exact copies of a
page count once in the trees.

What HTML declares is no text of the page to begin with: scripts, forms, navigation, footers, asides and the
like. Of the rest the trees judge, on every page, (1) branches whose class, id or role is made of words for
what isn't the article, wherever they stand, and (2) each holder of text outside an article or main
element. Varied text alone doesn't save a branch of the first kind, as adverts vary too: its
presentation counts as much. What stands in an article under no such name stays, as a heading may recur on
all pages of a site. Branches on too few pages for a tree go by their name. Reader comments vary
like the article in both respects, so no style tree can tell them: they go by their name alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.common import bit_map, in_bit_map, map_arrow, written

#: HTML's elements by what they are for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table caption tbody td tfoot th thead tr ul".split())
NOISE = frozenset("head title script style noscript template iframe object svg canvas audio video nav menu footer aside form button select option textarea input label fieldset dialog".split())
ENDS_P = BLOCK - {"html", "body"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which a start tag ends no paragraph, and an end tag inside what is skipped or suspect closes nothing.
SCOPE = frozenset({"button", "object", "template"})
END_SCOPE = {"p": ENDS_P - {"p"}, "li": {"ul", "ol", "menu"}, **dict.fromkeys(("tr", "td", "th", "tbody", "thead", "tfoot"), {"table"})}
#: Words in class, id and role that name what isn't the article; those that name what readers
#: wrote; words that stand beside them without saying more.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion promotions banner nav navbar navigation menu menus breadcrumb breadcrumbs footer header contentinfo sidebar sidebars aside complementary cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending widget widgets toolbar pagination pager search skip masthead".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies respond disqus".split())
BESIDE = frozenset("area article bar block blog body bottom box btn button cell col column container content count desktop entry feed fixed form global group heading icon inline inner item items large layer left link links list main mobile outer page panel post primary reader region right row secondary section site slot small sticky story text thread title top unit user view wrap wrapper zone".split())
PART = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=\d)")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WHITE = re.compile(r"\s+")
#: Where a block stands.
ARTICLE, OPEN, SUSPECT = 0, 1, 2
#: Weight of content beside presentation, and the least importance that stays.
GAMMA, THRESHOLD = {OPEN: 0.9, SUSPECT: 0.5}, 0.6
#: Nodes on fewer pages aren't judged by the trees.
LEAST_PAGES = 8
#: Bits of the map of exceptions; fixed, so that it may be broadcast.
MAP_BITS = 1 << 20


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _named(attrs: list) -> tuple[bool, bool]:
    """Whether a class, id or role is made of words for what isn't the article, or for comments: every
    word must be such a word or say nothing beside it, so "ad-box" is, "share-price" and "has-sidebar" aren't."""
    suspect = comments = False
    for key, value in attrs:
        if key in ("class", "id", "role") and value:
            for token in value.split():
                words = {w for w in PART.split(CAMEL.sub("-", token).lower()) if w}
                own = words & (NAMES | COMMENTS)
                if own and all(w in own or w in BESIDE or w.isdigit() or len(w) == 1 for w in words):
                    suspect = True
                    comments |= bool(words & COMMENTS)
    return suspect, comments


class _Node:
    """An open element: its path as a hash, the outermost suspect branch that it is in (0 if none), the
    block that holds its text."""

    __slots__ = ("article", "branch", "holder", "holds", "path", "shown", "skipped", "tag")

    def __init__(self, tag: str, path: int, article: bool, branch: int, holder: _Node | None, skipped: bool = False) -> None:
        self.tag, self.path, self.article, self.branch, self.skipped = tag, path, article, branch, skipped
        self.holder = holder or self
        self.holds = False
        self.shown: list[str] = []


class PageParser(HTMLParser):
    """One page as blocks ``(zone, path hash, text)`` and tree rows ``(path hash, kind, feature)``.

    Zones are ARTICLE, OPEN (text outside of it, by the path of its holder) and SUSPECT (by the path of the
    suspect branch); tree rows are of what the trees judge. Unclosed and misnested elements are closed as
    browsers do for the common cases: a block element ends an open paragraph, items end items of their kind,
    and an end tag closes what is open inside it. Skipped elements lie on the same stack and are closed by
    the same rules. Paths are hashes of the parent's hash, so that deep pages cost no more.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = [_Node("", 0, False, 0, None)]
        self.tags: dict[str, int] = {}  # how many of each are open
        self.skips: list[int] = []  # depth of the outermost skipped element
        self.blocks: list[tuple[int, int, str]] = []
        self.rows: set[tuple[int, int, int]] = set()
        self.text: list[str] = []
        self.in_article = False

    def _flush(self) -> None:
        if self.text:
            text = WHITE.sub(" ", "".join(self.text)).strip()
            self.text.clear()
            if text:
                holder = self.open[-1].holder
                zone = SUSPECT if holder.branch else ARTICLE if holder.article else OPEN
                path = holder.branch or holder.path
                self.blocks.append((zone, path, text))
                if zone == ARTICLE:
                    self.in_article = True
                else:
                    holder.holds = True
                    self.rows.add((path, 1, _hash(text)))

    def _close(self, depth: int) -> None:
        while len(self.open) > depth:
            node = self.open[-1]
            if not node.skipped and node.tag in BLOCK:
                self._flush()
                if node.branch == node.path or node.holds and not node.branch:
                    self.rows.add((node.path, 0, _hash(" ".join(node.shown))))
            self.open.pop()
            self.tags[node.tag] -= 1
        if self.skips and self.skips[0] >= depth:
            self.skips.clear()

    def _push(self, node: _Node) -> None:
        if node.skipped and not self.skips:
            self.skips.append(len(self.open))
        self.open.append(node)
        self.tags[node.tag] = self.tags.get(node.tag, 0) + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.skips and self.open[self.skips[0]].tag == "head" and tag in ("body", "article", "main", "div", "p", "h1"):
            self._close(self.skips[0])  # a head that was never closed
        if tag in ENDS_P:
            self._end_open("p", ENDS_P - {"p"} | SCOPE)
        if tag in SIBLINGS:
            for other in SIBLINGS[tag]:
                self._end_open(other, {"ul", "ol", "menu", "dl", "table", "select"} if other != "tr" else {"table"})
        parent = self.open[-1]
        if parent.skipped:
            if tag not in VOID:
                self._push(_Node(tag, parent.path, parent.article, parent.branch, parent.holder, True))
            return
        parent.shown.append(tag)
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                self._flush()
            return
        suspect, comments = _named(attrs) if tag not in ("html", "body", "main") else (False, False)
        # What is smaller than a block has no presentation of its own: there a name decides, too.
        if tag in NOISE or comments or (suspect and tag not in BLOCK) or (tag == "header" and not parent.article):
            if tag in BLOCK:
                self._flush()
            self._push(_Node(tag, parent.path, parent.article, parent.branch, parent.holder, True))
            return
        if tag in BLOCK:
            self._flush()
        kind = ".".join([tag, *sorted(w for k, v in attrs if k == "class" and v for w in v.lower().split())])
        path = _hash(f"{parent.path}/{kind}") or 1
        main = tag in ("article", "main") or "main" in [v for k, v in attrs if k == "role"]
        branch = parent.branch
        if main and not suspect and not self.in_article:
            branch = 0  # a wrapper that is named after what it also holds
        elif suspect and not branch:
            branch = path
        self._push(_Node(tag, path, parent.article or main, branch, None if tag in BLOCK else parent.holder))

    def _end_open(self, tag: str, barrier: frozenset | set) -> None:
        if not self.tags.get(tag):
            return
        for depth in range(len(self.open) - 1, 0, -1):
            if self.open[depth].tag == tag:
                self._close(depth)
                return
            if self.open[depth].tag in barrier:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # browsers ignore the slash

    def handle_endtag(self, tag: str) -> None:
        if not self.tags.get(tag):
            return
        barrier = END_SCOPE.get(tag, () if tag in BLOCK or tag in NOISE else BLOCK)
        for depth in range(len(self.open) - 1, 0, -1):
            node = self.open[depth]
            if node.tag == tag:
                self._close(depth)
                return
            if (node.skipped or node.branch) and (node.tag in barrier or node.tag in SCOPE):
                return

    def handle_data(self, data: str) -> None:
        if not self.skips:
            if not self.text and data.strip():
                self.open[-1].shown.append("#")
            self.text.append(data)

    def finish(self) -> None:
        self.close()
        self._flush()
        self._close(1)
        if self.open[0].holds:
            self.rows.add((0, 0, _hash(" ".join(self.open[0].shown))))


def parse(html: str | None) -> PageParser:
    page = PageParser()
    page.feed(html or "")
    page.finish()
    return page


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    return (m[1].rpartition("@")[2] if m else "").lower()


def style_tree(rows: DataFrame, *, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, path, pages, presentation, content) from distinct (host, path, kind, feature, page): kind 0 is
    a presentation, 1 a text block. Where fewer than ``least_pages`` pages of the host show a node, its
    importances are those of the tree over all hosts; null if that has too few, too. Where both have
    enough, the lesser importance counts."""
    per = rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("k"))
    own = _importance(per, ["host", "path"], least_pages)
    whole = per.groupBy("path", "kind", "feature").agg(F.sum("k").alias("k"))
    whole = _importance(whole, ["path"], least_pages).select("path", F.col("presentation").alias("whole_p"), F.col("content").alias("whole_c"))
    return own.join(whole, "path").select("host", "path", "pages", F.least("presentation", "whole_p").alias("presentation"), F.least("content", "whole_c").alias("content"))


def _importance(per: DataFrame, keys: list[str], least_pages: int) -> DataFrame:
    k = F.col("k").cast("double")
    shown, text = F.col("kind") == 0, F.col("kind") == 1
    sums = per.groupBy(*keys).agg(
        F.sum(F.when(shown, F.col("k")).otherwise(0)).alias("pages"),
        F.sum(F.when(shown, k * F.log(k)).otherwise(0.0)).alias("shown_sum"),
        F.sum(F.when(text, F.log(k)).otherwise(0.0)).alias("text_sum"),
        F.count(F.when(text, True)).alias("texts"),
    )
    enough, base = F.col("pages") >= max(2, least_pages), F.log(F.col("pages").cast("double"))
    presentation = (base - F.col("shown_sum") / F.col("pages")) / base
    content = F.when(F.col("texts") > 0, F.greatest(F.lit(0.0), 1 - F.col("text_sum") / F.col("texts") / base)).otherwise(presentation)
    return sums.select(*keys, "pages", F.when(enough, presentation).alias("presentation"), F.when(enough, content).alias("content"))


def judged(tree: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, path, zone): the branches that are treated other than their kind is by default: open ones that
    are of low importance and go, suspect ones of high importance that stay."""
    score = {z: g * F.col("content") + (1 - g) * F.col("presentation") for z, g in GAMMA.items()}
    low_open = tree.where(score[OPEN] < threshold).select("host", "path", F.lit(OPEN).alias("zone"))
    return low_open.unionByName(tree.where(score[SUSPECT] >= threshold).select("host", "path", F.lit(SUSPECT).alias("zone")))


def extract_main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """(id, url, text, n_chars, removed) per row of ``pages``: blocks in page order, one to a line.

    ``removed`` counts blocks that were taken out as branches of low importance (or, on too few pages for a
    tree, by name). Null or empty html has an empty text, as have pages of nothing but markup. Null urls
    form a host of their own. Repeated rows are extracted each. A page is parsed whole, however long or
    deep; an empty table gives no rows; other columns don't count.

    A branch on enough pages goes or stays as its importance says. By default suspect branches go and others
    stay; a map of fixed size tells which pages may hold an exception, and only those are shuffled to meet it.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(html_col).alias("page"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.list_(pa.struct([("zone", pa.int32()), ("path", pa.int64()), ("text", pa.string())]))
        row = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("feature", pa.int64())]))
        for batch in batches:
            hosts, blocks, tree = [], [], []
            for url, html in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                page = parse(html)
                hosts.append(host_of(url))
                blocks.append([{"zone": z, "path": p, "text": t} for z, p, t in page.blocks])
                tree.append([{"path": p, "kind": k, "feature": f} for p, k, f in sorted(page.rows)])
            columns = [*batch.columns[:4], pa.array(hosts, pa.string()), pa.array(blocks, block), pa.array(tree, row)]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "id", "url", "page", "host", "blocks", "tree"])

    parsed = written(map_arrow(rows, run, f"rid bigint, id {kind}, url string, page bigint, host string, blocks array<struct<zone:int,path:bigint,text:string>>, tree array<struct<path:bigint,kind:int,feature:bigint>>"), "html-blocks")

    nodes = parsed.select("host", "page", F.inline("tree")).distinct()
    other = written(judged(style_tree(nodes), threshold), "html-exceptions")
    map_ = bit_map(other.select(F.xxhash64("host", "path", "zone")), MAP_BITS)
    own = F.transform(F.filter("blocks", lambda b: b["zone"] > 0), lambda b: F.xxhash64(F.col("host"), b["path"], b["zone"]))
    hit = F.exists(own, lambda h: in_bit_map(map_, h, MAP_BITS))
    mapped = parsed.select("rid", "id", "url", "host", "blocks").withColumn("hit", hit)

    none = F.array().cast("array<struct<path:bigint,zone:int>>")
    some = mapped.where("hit")
    asked = some.select("rid", "host", F.explode(F.array_distinct(F.transform(F.filter("blocks", lambda b: b["zone"] > 0), lambda b: F.struct(b["path"], b["zone"])))).alias("n"))
    met = asked.select("rid", "host", F.col("n.path").alias("path"), F.col("n.zone").alias("zone")).join(other, ["host", "path", "zone"])
    met = met.groupBy("rid").agg(F.collect_list(F.struct("path", "zone")).alias("other"))
    some = some.drop("hit").join(met, "rid", "left").withColumn("other", F.coalesce("other", none))
    both = mapped.where(~F.col("hit")).drop("hit").withColumn("other", none).unionByName(some)
    stays = lambda b: (b["zone"] == ARTICLE) | ((b["zone"] == SUSPECT) == F.array_contains("other", F.struct(b["path"], b["zone"])))
    kept = F.filter("blocks", stays)
    out = both.select("id", "url", F.size("blocks").alias("n"), F.transform(kept, lambda b: b["text"]).alias("kept"))
    text = F.array_join("kept", "\n")
    out = out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), text.alias("text"), (F.col("n") - F.size("kept")).cast("long").alias("removed"))
    return out.select(id_col, url_col, "text", F.char_length("text").cast("long").alias("n_chars"), "removed")
