"""Files with metadata lines, captured API pages, polygons, gazetteers, caches, atomic and guarded writes."""

from __future__ import annotations

import csv
import io
import math
import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import match, score
from cairn.sources import tabular


def csv_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value of the leading lines that begin with #, however many; only those are read."""
    out: dict[str, str] = {}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        while (line := lines.readLine()) is not None:
            line = line.removeprefix("\ufeff").strip()
            if not line.startswith("#"):
                break
            key, found, value = line[1:].partition("=")
            if found:
                out[key.strip()] = value.strip()
    finally:
        stream.close()
    return out


def csv_of_ref(spark: SparkSession, repository: str, ref: str, path: str) -> tuple[dict[str, str], DataFrame]:
    """Metadata and rows of a CSV file as a git ref has it; ValueError if it hasn't."""
    done = subprocess.run(["git", "-C", repository, "show", f"{ref}:{path}"], capture_output=True, text=True, check=False)
    if done.returncode:
        raise ValueError(f"git show {ref}:{path}: {done.stderr.strip()}")
    return csv_of_text(spark, done.stdout)


def csv_of_text(spark: SparkSession, text: str) -> tuple[dict[str, str], DataFrame]:
    """Metadata and rows of a small CSV text. All columns are trimmed strings; a row that is too long, or has no name, is an error."""
    metadata: dict[str, str] = {}
    lines = text.removeprefix("\ufeff").splitlines(keepends=True)
    while lines and lines[0].startswith("#"):
        key, found, value = lines.pop(0)[1:].partition("=")
        if found:
            metadata[key.strip()] = value.strip()
    reader = csv.reader(io.StringIO("".join(lines), newline=""))
    names = [c.strip() for c in next(reader, [])]
    rows = []
    for k, own in enumerate(r for r in reader if r):
        if len(own) > len(names):
            raise ValueError(f"row {k + 1} has more values than columns")
        if "name" in names and not (own + [""] * len(names))[names.index("name")].strip():
            raise ValueError(f"row {k + 1} has no name")
        rows.append([v.strip() for v in own] + [""] * (len(names) - len(own)))
    return metadata, spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in names))


def repair_header(text: str, header: str) -> str:
    """A line break after a header that the first row follows without one."""
    return f"{header}\n{text[len(header):]}" if text.startswith(header) and not text.startswith((header + "\n", header + "\r\n")) else text


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = (), strict: bool = True) -> DataFrame:
    """All columns as trimmed strings, missing ones empty. Unless ``strict``, lines that begin with # are passed over wherever they are, and long records are cut."""
    if strict:
        return tabular.read_strict(spark, path, required)
    found = spark.read.csv(path, header=True, comment="#", multiLine=True, enforceSchema=False, escape='"')
    names = [c.removeprefix("\ufeff").strip() for c in found.columns]
    if missing := [c for c in required if c not in names]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return found.select(*(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))).alias(n) for c, n in zip(found.columns, names, strict=True)))


def write_atomic(path: str, text: str) -> None:
    """K4: a temporary file in the same folder, synced, with the old file's mode, then moved."""
    mode = os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644
    handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, mode)
        os.replace(temporary, path)
    except BaseException:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise


def publish(rows: DataFrame, path: str, metadata: dict[str, str], check: Callable[[DataFrame], DataFrame]) -> None:
    """K9: write only if ``check`` finds no violation; the old file stays otherwise."""
    if bad := check(rows).limit(5).collect():
        raise ValueError(f"not published: {[tuple(r) for r in bad]}")
    tabular.write(rows, path, metadata)


_SHOP = "struct<sub_genre:string,id:string,name:string,address:string,tel:string,lat:string,lng:string,catch:string,access:string,genre:struct<name:string>,budget:struct<name:string,average:string>,urls:struct<pc:string,sp:string>>"


def _shop() -> list[Column]:
    """A store's raw columns from a record ``s``."""
    filled = lambda *c: F.coalesce(*(F.nullif(F.col(x), F.lit("")) for x in c))
    zero = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    return [F.lit("hotpepper").alias("source"), F.col("s.id").alias("external_id"), F.col("s.name").alias("name"), filled("s.address").alias("address"), filled("s.tel").alias("phone"), zero("s.lat").alias("lat"), zero("s.lng").alias("lng"), F.concat(F.array_compact(F.array(filled("s.genre.name"))), X.sub_genres(F.col("s.sub_genre"))).alias("genres"), filled("s.catch", "s.access").alias("description"), N.safe_budget(F.col("s.budget.name"), F.col("s.budget.average")).alias("budget_dinner"), filled("s.urls.pc", "s.urls.sp").alias("url")]


def shop_pages(spark: SparkSession, path: str) -> DataFrame:
    """Records of captured API pages, each file a page, with their order."""
    pages = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("page"), F.from_json("value", f"results struct<shop:array<{_SHOP}>>").alias("v"))
    return pages.select("page", F.posexplode("v.results.shop").alias("seq", "s")).select("page", "seq", *_shop())


def union_scans(scans: DataFrame, rank: str, seq: str, key: str, drop: Column | None = None) -> DataFrame:
    """One row a key: the last of the first scan (rank 0) that has it, else the first of the others. Rows that ``drop`` holds for count nowhere."""
    kept = F.coalesce(F.col(key), F.lit("")) != ""
    rows = scans.where(kept if drop is None else kept & ~F.coalesce(drop, F.lit(False)))
    whole, first = F.struct(*[c for c in scans.columns if c != key]), F.col(rank) == 0
    leading = F.max_by(F.when(first, whole), F.when(first, F.col(seq)))
    other = F.min_by(F.when(~first, whole), F.when(~first, F.struct(rank, seq)))
    return rows.groupBy(key).agg(F.coalesce(leading, other).alias("r")).select(key, "r.*")


def fetched_shops(scans: DataFrame) -> DataFrame:
    """Raw stores of scans (rank, seq, id, shop as JSON), one an id, without those of excluded kinds."""
    shops = scans.select("rank", "seq", F.from_json("shop", _SHOP).alias("s")).select("rank", "seq", *_shop())
    return union_scans(shops, "rank", "seq", "external_id", score.excluded(F.col("name"), F.col("description"), F.array_join("genres", " ")))


def polygons(spark: SparkSession, path: str) -> DataFrame:
    """(seq, name, parts) of the features of GeoJSON files; a Polygon is one part, a MultiPolygon as many as it has, others none."""
    one = "struct<type:string,coordinates:string>"
    f = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", f"features array<struct<properties:struct<name:string>,geometry:{one}>>").alias("v"))
    f = f.select("file", F.posexplode("v.features").alias("at", "f")).select("file", "at", F.col("f.properties.name").alias("name"), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"))
    ring = "array<array<array<double>>>"
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("c", f"array<{ring}>")).when(F.col("type") == "Polygon", F.array(F.from_json("c", ring)))
    parts = F.transform(F.coalesce(many, F.array().cast(f"array<{ring}>")), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v[0].alias("x"), v[1].alias("y")))))
    return f.select(F.struct("file", "at").alias("seq"), F.coalesce("name", F.lit("")).alias("name"), parts.alias("parts"))


def lattice(spark: SparkSession, box: tuple[float, float, float, float] = (35.4, 138.9, 36.2, 140.1), spacing_m: float = 800, radius_m: int = 800) -> DataFrame:
    """Hexagonal grid of (seq, lat, lng, radius_m); steps add up as repeated sums do.

    The sums of one row and one column are made once, their product is Spark's.
    """
    lat0, lng0, lat1, lng1 = box
    dy = spacing_m / N.DEGREE_M
    dx = spacing_m / (N.DEGREE_M * math.cos(math.radians((lat0 + lat1) / 2)))

    def steps(at: float, end: float, by: float) -> DataFrame:
        out = []
        while at <= end:
            out.append((len(out), at))
            at += by
        return spark.createDataFrame(out, "k long, at double")

    rows, cells = steps(lat0, lat1, dy), steps(lng0, lng1, dx)
    wide = cells.count()
    both = rows.select(F.col("k").alias("row"), F.col("at").alias("lat")).crossJoin(F.broadcast(cells.select(F.col("k").alias("cell"), F.col("at").alias("g"))))
    lng: Column = F.least(F.when(F.col("row") % 2 == 1, F.col("g") + dx / 2).otherwise(F.col("g")), F.lit(lng1))
    return both.select(F.round("lat", 6).alias("lat"), F.round(lng, 6).alias("lng"), F.lit(radius_m).alias("radius_m"), (F.col("row") * wide + F.col("cell")).alias("seq"))


def nearest_circle(places: DataFrame, circles: DataFrame) -> DataFrame:
    """(id, seq, metres) of the nearest circle (seq, lat, lng, radius_m: one radius) that holds each place (id, lat, lng), the first on ties; places in none drop out."""
    radius = circles.agg(F.max("radius_m")).first()[0]
    if radius is None:
        return places.select("id", F.lit(None).cast("long").alias("seq"), F.lit(None).cast("double").alias("metres")).limit(0)
    named = lambda d, i: d.select(F.col(i).alias("id"), F.lit("").alias("key"), "lat", "lng")
    # The circles are the smaller side, which is copied to the cells around.
    met = match.near_pairs(named(circles, "seq"), named(places, "id"), float(radius))
    best = F.min(F.struct("metres", "l_id")).alias("b")
    return met.groupBy(F.col("r_id").alias("id")).agg(best).select("id", F.col("b.l_id").alias("seq"), F.col("b.metres").alias("metres"))


def chunked(points: DataFrame, size: int) -> DataFrame:
    """``points`` (seq) with a column ``chunk``: consecutive runs of ``size``; ``seq`` counts from 0."""
    return points.withColumn("chunk", F.floor(F.col("seq") / size).cast("bigint"))


def read_pages(spark: SparkSession, folder: str, pattern: str = "*_map.html") -> DataFrame:
    """(seq, html) of the HTML files of a folder, in the order of their names."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("seq"), F.col("value").alias("html"))


def read_cache(spark: SparkSession, path: str, fields: tuple[str, ...] = ()) -> DataFrame:
    """(key, ``fields`` or text) of a JSON object; a missing or unreadable file is an empty cache."""
    schema = "map<string,struct<" + ",".join(f"{f}:string" for f in fields) + ">>" if fields else "map<string,string>"
    names = [f"value.{f}" for f in fields] if fields else [F.col("value").alias("text")]
    empty = spark.createDataFrame([], "key string, " + ", ".join(f"{f} string" for f in (fields or ("text",))))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return empty
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("m"))
    return whole.select(F.explode("m").alias("key", "value")).select("key", *names)


#: Columns of gazetteers, and the names they may have.
DISTRICTS = {"city": ("市区町村名",), "chome": ("大字町丁目名",)}
BLOCKS = {"city": ("市区町村名", "市区町村名・漢字"), "chome": ("大字_丁目名", "大字・町丁目名"), "gaiku": ("街区符号_地番", "街区符号・地番")}


def gazetteer(spark: SparkSession, archive: str, member: str, columns: dict[str, tuple[str, ...]], encoding: str = "shift_jis") -> DataFrame:
    """(seq, ``columns``, lat, lng, raw_...) of the CSV members of ZIP archives, a task each; no archive gives no rows.

    A column is the first of its names that has a value. Names lose their white space in NFKC; rows with a blank one drop out; a
    blank coordinate is null. ``seq``: the record's place, by archive and member.
    """
    found = tabular.records(spark, archive, encoding, member, errors="ignore").where("at > 0")
    cell = lambda *own: F.coalesce(*(F.nullif(F.try_element_at("cells", F.lit(n)), F.lit("")) for n in own), F.lit(""))
    raw = found.select(F.struct("file", "member", "at").alias("seq"), *(cell(*own).alias(f"raw_{c}") for c, own in columns.items()), cell("緯度").try_cast("double").alias("lat"), cell("経度").try_cast("double").alias("lng"))
    whole = raw.withColumns({c: F.trim(F.col(f"raw_{c}")) if c == "gaiku" else X.geo_key(F.col(f"raw_{c}")) for c in columns})
    for c in columns:
        whole = whole.where(F.col(c) != "")
    return whole


# Sinks.

EXPORT_COLUMNS = ["name", "address", "lat", "lng", "carnivore_rank", "carnivore_score", "genre", "rating", "review_count", "sources", "url", "notes", "budget_lunch", "budget_dinner", "avg_dinner_budget"]


def export_rows(stores: DataFrame, ranks: list[str] | None = None) -> DataFrame:
    """K2, F1: scored stores as rows of an export, of the given ranks or of all."""
    own = stores.where(F.col("carnivore_rank").isin(ranks)) if ranks else stores
    made = {"genre": F.array_join("genres", ", "), "sources": F.array_join(F.array_sort("sources"), ", "), "avg_dinner_budget": F.coalesce("budget_dinner", "budget_lunch")}
    return own.select(*(made.get(c, F.col(c)).alias(c) for c in EXPORT_COLUMNS))


def export(stores: DataFrame, path: str, generated_at: str, ranks: list[str] | None = None) -> dict[str, int]:
    """K1, A3, A4: write an export with its three metadata lines, of which scope and number are found while it is written; the numbers of exported and of all stores."""
    kept = F.col("carnivore_rank").isin(ranks) if ranks else F.lit(True)
    seen = stores.agg(F.count("*").alias("total"), F.count_if(kept).alias("exported")).first()
    tabular.write(export_rows(stores, ranks), path, {"generated_at_utc": generated_at, "source_scope": None, "total_records": None})
    return {"exported": seen["exported"], "total": seen["total"]}


def rewrite(path: str, rows: DataFrame, metadata: dict[str, str]) -> None:
    """K5: replace a file; its first version stays beside it as .bak."""
    backup = f"{path}.bak"
    if os.path.exists(path) and not os.path.exists(backup):
        shutil.copy2(path, backup)
    tabular.write(rows, path, metadata)


def write_list(path: str, rows: DataFrame, condition: str) -> None:
    """K6: a list of rows with the condition that they meet."""
    tabular.write(rows, path, {"condition": condition})


def summary(stats: DataFrame) -> str:
    """K8: key=value lines of one row of counters."""
    row = stats.first()
    return "".join(f"{c}={row[c]}\n" for c in stats.columns)


def publish_in_steps(path: str, steps: list[Callable[[], None]]) -> None:
    """K9: run the steps, which write ``path`` and check it; if one fails, the file is as it was before the first."""
    before = None
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            before = f.read()
    try:
        for step in steps:
            step()
    except BaseException:
        if before is not None:
            write_atomic(path, before)
        elif os.path.exists(path):
            os.unlink(path)
        raise
