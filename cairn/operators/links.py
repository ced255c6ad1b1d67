"""Links between pages: references resolved against their page's own URL, and those that lead nowhere.

A reference is read by the generic syntax of RFC 3986, its path merged with the page's, percent escapes undone, dot
segments removed. A site is a host with the pages that there are of it; a folder stands for its index.html. All of it is
columns and one equi-join on (host, path), so a hot host is split by its paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEX = "index.html"
_REFERENCE = r"""(?i)\b(?:href|src)\s*=\s*["']([^"']+)["']"""
#: Scheme, authority (with its slashes) and path.
_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)"


def unquoted(x: Column) -> Column:
    """Percent escapes undone; a text with broken ones stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def place(path: Column) -> Column:
    """struct(path, outside): a rooted path without empty and dot segments, a folder's with its index; ``outside`` if it climbs over the root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("outside"))

    def step(state: Column, part: Column) -> Column:
        up = F.struct(F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"), (state["outside"] | (F.size(state["at"]) == 0)).alias("outside"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(F.struct(F.concat(state["at"], F.array(part)).alias("at"), state["outside"].alias("outside")))

    folder = path.rlike(r"(?:^|/)\.{0,2}$")
    done = F.aggregate(F.split(path, "/"), start, step)
    return F.transform(F.array(done), lambda s: F.struct(F.concat(F.lit("/"), F.array_join(F.when(folder, F.concat(s["at"], F.array(F.lit(INDEX)))).otherwise(s["at"]), "/")).alias("path"), s["outside"].alias("outside")))[0]


def _parts(url: Column) -> tuple[Column, Column, Column]:
    own = F.trim(F.coalesce(url, F.lit("")))
    return tuple(F.regexp_extract(own, _URL, g) for g in (1, 2, 3))


def site_pages(pages: DataFrame) -> DataFrame:
    """(host, path) of each page (url) there is."""
    _, host, path = _parts(F.col("url"))
    return pages.select(F.lower(F.substring(host, 3, F.length(host))).alias("host"), place(unquoted(path))["path"].alias("path")).distinct()


def link_graph(pages: DataFrame) -> DataFrame:
    """(seq, host, link, target, outside) of each different local reference of pages (seq, url, html): its path on the page's host.

    References with a scheme or a host of their own, or without a path, are left out.
    """
    _, host, base = _parts(F.col("url"))
    own = pages.select("seq", F.lower(F.substring(host, 3, F.length(host))).alias("host"), F.regexp_replace(base, "[^/]*$", "").alias("folder"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_REFERENCE), F.lit(1)), lambda v: F.trim(v)))).alias("link"))
    scheme, other, path = _parts(F.col("link"))
    local = own.withColumn("__path", path).where((scheme == "") & (other == "") & (path != ""))
    merged = F.when(F.col("__path").startswith("/"), F.col("__path")).otherwise(F.concat(F.lit("/"), "folder", F.col("__path")))
    return local.withColumn("to", place(unquoted(merged))).select("seq", "host", "link", F.col("to.path").alias("target"), F.col("to.outside").alias("outside"))


def broken_links(pages: DataFrame, there: DataFrame | None = None) -> DataFrame:
    """(seq, link, target, problem): links that climb out of their site ("outside") or that no page, nor a folder's index, answers ("missing").

    ``there``: (host, path) of what else can be linked to, such as images.
    """
    known = site_pages(pages)
    known = known.unionByName(there.select("host", "path")).distinct() if there is not None else known
    # A folder answers for itself without a slash too.
    known = known.unionByName(known.where(F.col("path").endswith(f"/{INDEX}")).select("host", F.left("path", F.length("path") - len(INDEX) - 1).alias("path"))).distinct()
    graph = link_graph(pages).withColumn("path", F.when(~F.col("outside"), F.col("target")))
    lost = graph.where("not outside").join(known, ["host", "path"], "left_anti").select("seq", "link", "target", F.lit("missing").alias("problem"))
    return lost.unionByName(graph.where("outside").select("seq", "link", "target", F.lit("outside").alias("problem")))
