"""HTML extraction with removal of site templates.

Each page is parsed into elements, and each block element's subtree (its tag, its text, its
children's hashes) is hashed. Spark counts in how many pages of a host each hash is found. Subtrees
that recur on at least ``SHARE`` of a host's different pages, and on ``LEAST`` at least, are the host's
template and go. So do page-level blocks found on ``MANY`` different pages of the host, however many it has, as a section's
or layout's menus are on its own pages only; a block is page-level if what it stands in holds all of the page's text that tags
and names leave. Pages are different if their
texts are, before templates go: copies of a page don't make its text a template. So do elements whose
tag, role, class or id says that they are no content (menus, scripts, forms, notices, adverts,
comments ...), which is all there is to go by on a host of few pages. What remains of the page's articles (else its main element, else its body) is the text.

Headings, paragraphs, list items, cells and labels are text that pages of a site do share, so no such block is taken for
template by itself, however often it recurs: it goes only with a recurring element around it (a list, a table, a section). The same holds
for any other block without blocks in it, unless it is page-level. Of an article or a main element, what holds half
of its text or more never goes, as sites do publish an article on several pages, and nothing goes for ``MANY`` pages.

Scale: two passes over the pages. The counts are summed map-side, so a host with a third of all
pages is no problem. Of template hashes only those are kept that tags and names alone would leave in the text
on some page. Up to ``BROADCAST_ROWS`` of them in all are broadcast, by host. Beyond, each different page's own
hashes meet the host's in a join on both, and a page gets those of its own that are template, in
a join by its hash that is salted ``SALTS`` ways; so no row carries a host's hashes.

Defined cases: null or empty html has no text; a null url, or one without a host, belongs to the
host "", repeated rows are one page to the counts; other columns pass unread. Unclosed elements end
with their parent; a comment or script without an end runs to the end of the page. Parsing takes time
in proportion to the page, however its tags are nested or left open; very long pages are read whole; an empty table gives an empty one;
ties don't arise.
"""

from __future__ import annotations

import html as entities
import re

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHARE, LEAST, MANY = 0.5, 4, 8
BROADCAST_ROWS, SALTS = 50_000, 32

_TAG = re.compile(r"""<!--(?:.*?(?:-->|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th tr tbody thead caption figcaption address".split())
#: A new block of these ends an open paragraph.
_ENDS_P = frozenset("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
_SIBLING = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_DROPPED = frozenset("head script style textarea title noscript template iframe xmp noembed noframes nav aside footer form button select dialog svg canvas object menu".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookies?|consent|gdpr|notices?|notification\w*|alert\w*|popup|modal|overlay"
    r"|sidebars?|menus?|nav\w*|breadcrumbs?|footers?|comments?|commentlist|disqus|repl(?:y|ies)|respond|shar(?:e|ing)|social\w*|related|recommend\w*"
    r"|newsletter|subscri\w*|login|signup|search\w*|widgets?|toolbar|pagination|pager|skip|masthead)(?:$|[\s_-])",
    re.I,
)
_HEADER = re.compile(r"(?:^|[\s_-])(?:headers?|topbar|site-?title)(?:$|[\s_-])", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """Elements of a page in the order they begin, its texts, and the hashes of its subtrees."""

    def __init__(self, source: str):
        self.tag: list[str] = [""]
        self.parent: list[int] = [-1]
        self.drop: list[bool] = [False]
        self.article: list[bool] = [False]
        self.hash: list[int] = [0]
        #: Characters of the texts in an element, and the article around it.
        self.size: list[int] = [0]
        self.around: list[int] = [0]
        #: The same without what tag or name drops; whether blocks with text are in an element.
        self.live: list[int] = [0]
        self.holds: list[bool] = [False]
        self._inside: list[list[str]] = [[]]
        #: (element, text); None for a break between blocks.
        self.flow: list[tuple[int, str] | None] = []
        self._stack = [0]
        #: Places in the stack of the open elements of a tag.
        self._open: dict[str, list[int]] = {}
        self._read(source)
        while self._stack:
            self._end()

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw)
            self.flow.append((self._stack[-1], text))
            if packed := " ".join(text.split()):
                self._inside[self._stack[-1]].append(packed)
                self.size[self._stack[-1]] += len(packed)
                self.live[self._stack[-1]] += 0 if self.drop[self._stack[-1]] else len(packed)

    def _start(self, tag: str, attributes: str) -> None:
        if tag in _ENDS_P:
            self._close("p", stop=("table", "button", "td", "th", "article", "div", "section"))
        if tag in _SIBLING:
            for other in _SIBLING[tag]:
                self._close(other, stop=("ul", "ol", "dl", "table", "select"))
        up = self._stack[-1]
        own: dict[str, str] = {}
        for k, v in _ATTRIBUTE.findall(attributes):
            own.setdefault(k.lower(), v.strip("\"'"))
        article = self.article[up] or tag == "article"
        name = f"{own.get('class', '')} {own.get('id', '')}".strip()
        drop = (
            self.drop[up]
            or tag in _DROPPED
            or own.get("role", "").lower() in _ROLES
            or "hidden" in own
            or own.get("aria-hidden", "").lower() == "true"
            or bool(own.get("style") and _HIDDEN.search(own["style"]))
            or bool(name and tag not in ("html", "body", "article", "main") and _NAMES.search(name))
            or bool(tag == "article" and name and re.search(r"(?:^|[\s_-])comment", name, re.I))
            or not article and (tag == "header" or bool(name and _HEADER.search(name) and tag not in ("html", "body")))
        )
        self.tag.append(tag)
        self.parent.append(up)
        self.drop.append(drop)
        self.article.append(article)
        self.hash.append(0)
        self.size.append(0)
        self.around.append(self.around[up] or (len(self.tag) - 1 if tag in ("article", "main") else 0))
        self.live.append(0)
        self.holds.append(False)
        self._inside.append([])
        if tag not in _INLINE:
            self.flow.append(None)
        elif tag == "br":
            self.flow.append((up, " "))
        if tag in _VOID:
            return
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(len(self.tag) - 1)

    def _end(self) -> None:
        """Close the innermost element and hash its subtree."""
        k = self._stack.pop()
        if k:
            self._open[self.tag[k]].pop()
            up = self.parent[k]
            self.size[up] += self.size[k]
            self.live[up] += self.live[k]
            self.holds[up] = self.holds[up] or self.holds[k] or self.size[k] > 0 and self.tag[k] not in _INLINE
        if self._inside[k]:
            self.hash[k] = xxhash.xxh3_64_intdigest("\x1f".join([self.tag[k], *self._inside[k]]))
            if k:
                self._inside[self.parent[k]].append(f"\x1e{self.hash[k]:x}")
        self._inside[k] = []
        if self.tag[k] not in _INLINE:
            self.flow.append(None)

    def _close(self, tag: str, stop: tuple[str, ...] = ()) -> None:
        """Close up to the innermost open ``tag``, if there is one below any of ``stop``."""
        places = self._open.get(tag)
        if places and not any(self._open.get(x) and self._open[x][-1] > places[-1] for x in stop):
            at = places[-1]
            while len(self._stack) > at:
                self._end()

    def _read(self, source: str) -> None:
        at, find, last = 0, _TAG.search, source.rfind(">")
        while at <= last and (m := find(source, at)):
            self._text(source[at : m.start()])
            at = m.end()
            if tag := (m[2] or m[5]):
                tag = tag.lower()
                if m[1] or m[4]:
                    self._close(tag)
                elif tag in _RAW:
                    self._start(tag, "")
                    end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(tag)
                else:
                    self._start(tag, m[3] or m[6] or "")
            elif m[0].startswith("<![CDATA["):
                self._text(m[0][9:-3])
        # Past the last > only a comment or declaration without an end is no text.
        self._text(re.split("<[!?]", source[at:], maxsplit=1)[0])

    def _top(self, k: int) -> bool:
        """Whether an element is page-level: in nothing that holds less than all of the page's text."""
        return not self.around[k] and self.live[self.parent[k]] == self.live[0]

    def _may_go(self, k: int) -> bool:
        """Whether an element can be template by itself."""
        tag = self.tag[k]
        if tag in _INLINE or tag in _TEXT or tag in ("", "html", "body", "head", "article", "main"):
            return False
        if self.around[k]:
            return self.holds[k] and 2 * self.size[k] < self.size[self.around[k]]
        return self.holds[k] or self._top(k)

    def candidates(self) -> tuple[list[int], list[int]]:
        """Codes of the subtrees that may be template, each once: even ones as any element, odd ones as page-level ones; and those not dropped by tag or name."""
        own, live = set(), set()
        for k, h in enumerate(self.hash):
            if h and self._may_go(k):
                codes = (h & ~1, h | 1) if self._top(k) else (h & ~1,)
                own.update(codes)
                if not self.drop[k]:
                    live.update(codes)
        return sorted(own), sorted(live)

    def text(self, template: frozenset[int] | set[int] = frozenset()) -> str:
        """Blocks of the content, without the template."""
        gone = list(self.drop)
        roots: dict[str, list[int]] = {"article": [], "main": []}
        for k in range(1, len(self.tag)):
            up = self.parent[k]
            tag = self.tag[k]
            h = self.hash[k]
            gone[k] = gone[k] or gone[up] or bool(template) and h > 0 and (h & ~1 in template or h | 1 in template and self._top(k)) and self._may_go(k)
            if tag in roots and not gone[k] and self.hash[k]:
                roots[tag].append(k)
        chosen = {*(roots["article"] or roots["main"])}
        inside = [not chosen] * len(self.tag)
        for k in range(1, len(self.tag)):
            inside[k] = k in chosen or inside[self.parent[k]]
        blocks, now = [], []
        for x in [*self.flow, None]:
            if x is None:
                if now and (block := " ".join("".join(now).split())):
                    blocks.append(block)
                now = []
            elif inside[x[0]] and not gone[x[0]]:
                now.append(x[1])
        return "\n\n".join(blocks)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, hash) of the subtrees that recur on many pages of their host; hashes are the codes of ``Page.candidates``."""
    common.small_batches(pages.sparkSession)
    @F.pandas_udf("h array<long>, live array<long>, content long")
    def hashes(source: pd.Series) -> pd.DataFrame:
        out = []
        for s in source:
            page = Page(s or "")
            own, live = page.candidates()
            out.append((_signed(own), _signed(live), *_signed([xxhash.xxh3_64_intdigest(page.text().encode("utf-8", "surrogatepass"))])))
        return pd.DataFrame(out, columns=["h", "live", "content"])

    found = pages.select(host().alias("host"), hashes.asNondeterministic()("html").alias("x"))
    # A row with a null hash counts the host's pages.
    rows = found.select("host", "x.content", "x.live", F.explode(F.concat(F.array(F.lit(None).cast("long")), "x.h")).alias("hash"))
    apart = rows.groupBy("host", "hash", "content").agg(F.max(F.array_contains("live", F.col("hash"))).alias("live"))
    counts = apart.groupBy("host", "hash").agg(F.count("*").alias("n"), F.max("live").alias("live"))
    total = counts.where("hash is null").select("host", F.col("n").alias("pages"))
    often = counts.where("live").where(F.col("n") >= LEAST)
    share = (F.col("hash").bitwiseAND(F.lit(1)) == 0) & (F.col("n") >= F.greatest(F.lit(LEAST), F.col("pages") * SHARE))
    many = (F.col("hash").bitwiseAND(F.lit(1)) == 1) & (F.col("n") >= MANY)
    return often.join(total, "host").where(share | many).select("host", "hash")


def _signed(codes: list[int]) -> list[int]:
    return [h - (1 << 64) if h >> 63 else h for h in codes]


@common.shielded
def extract(pages: DataFrame, name: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``pages`` with a column ``name``, their main text."""
    spark = pages.sparkSession
    found = common.cut(templates(pages))
    dealt = pages.withColumn("__host", host())
    if found.count() <= broadcast_rows:
        by_host: dict[str, set[int]] = {}
        for h, code in zip(*(found.toArrow()[c].to_pylist() for c in ("host", "hash")), strict=True):
            by_host.setdefault(h, set()).add(code % (1 << 64))
        held = spark.sparkContext.broadcast(by_host)

        @F.pandas_udf("string")
        def text(source: pd.Series, site: pd.Series) -> pd.Series:
            return pd.Series([Page(s or "").text(held.value.get(h, frozenset())) for s, h in zip(source, site, strict=True)], dtype=object)

        return dealt.withColumn(name, text.asNondeterministic()("html", "__host")).drop("__host")

    @F.pandas_udf("array<long>")
    def codes(source: pd.Series) -> pd.Series:
        return pd.Series([_signed(Page(s or "").candidates()[0]) for s in source], dtype=object)

    @F.pandas_udf("string")
    def without(source: pd.Series, gone: pd.Series) -> pd.Series:
        return pd.Series([Page(s or "").text(frozenset() if g is None else {int(h) % (1 << 64) for h in g}) for s, g in zip(source, gone, strict=True)], dtype=object)

    dealt = dealt.withColumn("__page", F.md5(F.concat_ws("\n", "__host", F.coalesce("html", F.lit(""))).cast("binary")))
    own = dealt.select("__page", F.col("__host").alias("host"), F.explode(codes.asNondeterministic()("html")).alias("hash")).distinct()
    gone = own.join(found, ["host", "hash"]).groupBy("__page").agg(F.collect_list("hash").alias("__gone"))  # of a page's own blocks
    salted = gone.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = dealt.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["__page", "__salt"], "left")
    return met.withColumn(name, without.asNondeterministic()("html", "__gone")).drop("__host", "__page", "__salt", "__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
