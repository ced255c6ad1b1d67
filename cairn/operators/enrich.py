"""Filling and correcting records from captured pages, caches and gazetteers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import match, needles, regions, score

# Distances in metres that count as far, and as right, and a difference that is none.
FAR_M, RIGHT_M, SAME_DEGREES = 700.0, 200.0, 1e-6
# Genres whose records are classified again by texts found about them.
VAGUE_GENRES, VAGUE_RANKS = ["シュラスコ", "韓国", "その他"], ["C", ""]

# Markup that the captured pages have.
_SCRIPT = r"""(?is)<script[^>]+type="application/ld\+json"[^>]*>(.*?)</script>"""
_RESTAURANT = r'(?s)\{"@context":"https?://schema\.org","@type":"Restaurant","@id":"([^"]+)"'
_GEO = _RESTAURANT + r'.*?"geo":\{"@type":"GeoCoordinates","latitude":([0-9.+\-eE]+),"longitude":([0-9.+\-eE]+)\}'
_GENRE_CELL = r"(?s)<th>\s*ジャンル\s*</th>.*?<td[^>]*>.*?<span[^>]*>([^<]+)</span>"


def _budget(meal: str) -> str:
    return rf'(?s)c-rating-v3__time[^"]*c-rating-v3__time--{meal}"[^>]*>.*?(?:<a[^>]*class="rdheader-budget__price-target"|<em)>([^<]+)(?:</a>|</em>)'


def _part(x: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def number(x: str) -> Column:
    """A finite number, or null."""
    v = F.col(x).try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


# Filters.


def has_source(sources: Column, token: str, exact_case: bool = False) -> Column:
    """the sources contain the token, in any case unless ``exact_case``."""
    own = F.coalesce(sources, F.lit(""))
    return F.contains(own, F.lit(token)) if exact_case else F.contains(F.lower(own), F.lit(token.lower()))


def lacks_point(include_existing: bool = False, source: str | None = None) -> Column:
    """rows to geocode: without finite coordinates (or all), of a source if one is given."""
    wanted = F.lit(True) if include_existing else number("lat").isNull() | number("lng").isNull()
    return wanted & has_source(F.col("sources"), source) if source else wanted


def is_vague(rank: Column, genre: Column) -> Column:
    """F6."""
    return F.trim(F.coalesce(rank, F.lit(""))).isin(VAGUE_RANKS) & F.trim(F.coalesce(genre, F.lit(""))).isin(VAGUE_GENRES)


def shown(genre: Column, price: Column, status: Column, genres: list[str] | None = None, band: str = "", current_only: bool = False) -> Column:
    """what all chosen filters let through; no genres, or an empty band, choose all."""
    out = F.lit(True)
    if genres:
        out = out & genre.isin(genres)
    if band:
        out = out & (score.band(price) == band)
    return out & (status == "current") if current_only else out


def west_outliers(rows: DataFrame, threshold: float = 136.9, targets: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Rows whose finite longitude is below the threshold, of the targets' keys if targets are given."""
    west = rows.where(number("lng") < threshold)
    return match.matched(west, targets, key) if targets is not None else west


# Captured pages.


def page_features(pages: DataFrame) -> DataFrame:
    """(seq, url_key, features) of pages (seq, html) that describe a restaurant in JSON-LD.

    The first such object, alone or the only one of an array, gives URL and cuisines; the genre cell and
    the RC codes follow. Pages without a URL or a feature drop out.
    """
    one = F.transform(F.regexp_extract_all("html", F.lit(_SCRIPT), F.lit(1)), lambda v: F.trim(v))
    bare = F.transform(one, lambda s: F.when(s.rlike(r"(?s)^\[.*\]$"), F.regexp_replace(s, r"(?s)^\[(.*)\]$", "$1")).otherwise(s))
    found = F.try_element_at(F.filter(bare, lambda s: F.get_json_object(s, "$['@type']") == "Restaurant"), F.lit(1))
    own = pages.select("seq", "html", found.alias("ld"))
    url = F.coalesce(F.nullif(F.get_json_object("ld", "$['@id']"), F.lit("")), F.get_json_object("ld", "$.url"), F.lit(""))
    cuisine = F.get_json_object("ld", "$.servesCuisine")
    serves = F.when(cuisine.startswith("["), F.array_join(F.from_json(cuisine, "array<string>"), "、")).otherwise(cuisine)
    cell = F.trim(_part(F.col("html"), _GENRE_CELL))
    codes = F.concat_ws(",", *(F.filter(F.transform(F.split(F.regexp_extract("html", rf"setTargeting\('t_category{n}', \"([^\"]*)\"", 1), ","), lambda v: F.trim(v)), lambda c: c != "") for n in (2, 3)))
    text = F.concat_ws(" ", F.nullif(serves, F.lit("")), F.when(~cell.eqNullSafe(serves), F.nullif(cell, F.lit(""))), F.nullif(codes, F.lit("")))
    return own.select("seq", X.url_key(url).alias("url_key"), F.trim(text).alias("features")).where("url_key <> '' and features <> ''")


def page_points(pages: DataFrame) -> DataFrame:
    """(seq, url_key, lat, lng) of pages whose JSON-LD has finite coordinates."""
    own = pages.select("seq", X.url_key(_part(F.col("html"), _GEO)).alias("url_key"), *(F.regexp_extract("html", _GEO, g).alias(n) for g, n in ((2, "lat"), (3, "lng"))))
    return own.select("seq", "url_key", number("lat").alias("lat"), number("lng").alias("lng")).where("url_key <> '' and lat is not null and lng is not null")


def page_budgets(pages: DataFrame) -> DataFrame:
    """(seq, url_key, dinner, lunch) price ranges of pages that have one."""
    price = lambda meal: N.budget_range(F.trim(_part(F.col("html"), _budget(meal))))
    own = pages.select("seq", X.url_key(_part(F.col("html"), _RESTAURANT)).alias("url_key"), price("dinner").alias("dinner"), price("lunch").alias("lunch"))
    return own.where("url_key <> '' and coalesce(dinner.low, dinner.high, lunch.low, lunch.high) is not null")


def genre_of_pages(rows: DataFrame, features: DataFrame, url: str, name: str, genre: str) -> DataFrame:
    """``rows`` whose URL has features get the genre of name and features; the first page of a URL counts."""
    met = match.lookup(rows.withColumn("url_key", X.url_key(F.col(url))), features, "url_key", "features", "seq")
    new = score.stored_genre(X.lower_key(F.col(name)), X.lower_key(F.col("features")))
    return met.withColumn(genre, F.when(F.col("features").isNotNull(), new).otherwise(F.col(genre))).drop("url_key", "features")


def fill_average(rows: DataFrame, quotes: DataFrame | None = None) -> DataFrame:
    """Blank ``avg_dinner_budget`` of tabelog rows from their range, then of listed rows from ``quotes`` (id, name, average)."""
    own = F.col("avg_dinner_budget")
    has = lambda s: has_source(F.col("sources"), s)
    unset = F.coalesce(own, F.lit("")) == ""
    ranged = F.when(unset & has("tabelog"), N.range_mean(F.col("dinner_budget_min"), F.col("dinner_budget_max")).cast("string"))
    out = rows.withColumn("avg_dinner_budget", F.coalesce(ranged, own))
    if quotes is None:
        return out
    mean = quotes.groupBy(F.col("id").alias("__id")).agg(F.first(F.coalesce(N.free_text_mean(F.col("name")), N.free_text_mean(F.col("average"))).cast("string"), True).alias("__mean"))
    asked = unset & has("hotpepper") & ~has("tabelog")
    met = out.withColumn("__id", F.when(asked, X.loose_listing_id(F.col("url")))).join(mean, "__id", "left")
    return met.withColumn("avg_dinner_budget", F.coalesce("__mean", "avg_dinner_budget")).drop("__id", "__mean")


def genre_of_texts(rows: DataFrame, cache: DataFrame, prefer_url: bool = False, only: str | None = None) -> DataFrame:
    """Vague rows get the genre of the text that ``cache`` (key, text) has of their URL, if preferred, or name.

    An empty text counts as none; without a text the genre stays; a text without a rule's word gives その他.
    ``only``: what a URL must contain to be looked up.
    """
    texts = cache.where("text <> ''").groupBy("key").agg(F.first("text").alias("text"))
    named = texts.select(F.col("key").alias("__name"), F.col("text").alias("__by_name"))
    met = rows.withColumn("__name", F.trim("name")).join(named, "__name", "left").drop("__name")
    text = F.col("__by_name")
    if prefer_url:
        url = F.trim(F.coalesce(F.col("url"), F.lit("")))
        usable = url != "" if only is None else F.contains(url, F.lit(only))
        linked = texts.select(F.col("key").alias("__url"), F.col("text").alias("__by_url"))
        met = met.withColumn("__url", F.when(usable, F.concat(F.lit("url:"), url))).join(linked, "__url", "left").drop("__url")
        text = F.coalesce("__by_url", "__by_name")
    new = F.coalesce(score.first_rule(F.lower(text), score.TEXT_RULES), F.lit(score.OTHER))
    vague = is_vague(F.col("carnivore_rank"), F.col("genre")) & text.isNotNull()
    return met.withColumn("genre", F.when(vague, new).otherwise(F.col("genre"))).drop("__by_name", "__by_url")


# Geocoding.


def address_groups(rows: DataFrame, wanted: Column) -> DataFrame:
    """A5: (key, address, query_address, name, ids) of the wanted rows (id, name, address) by simplified address; the least name stands for a group."""
    own = rows.where(wanted).select("id", F.trim(F.coalesce("name", F.lit(""))).alias("name"), F.trim(F.coalesce("address", F.lit(""))).alias("address"))
    own = own.where("address <> ''").withColumn("query_address", X.simple_address(F.col("address"))).withColumn("key", X.light_key(F.col("query_address"))).where("key <> ''")
    first = F.min(F.struct("id", "address", "query_address"))
    return own.groupBy("key").agg(first.alias("f"), F.min(F.nullif("name", F.lit(""))).alias("name"), F.array_sort(F.collect_list("id")).alias("ids")).select("key", "f.address", "f.query_address", "name", "ids")


def pick_candidate(found: DataFrame) -> DataFrame:
    """(key, lat, lng) of a geocoder's answers (key, prefecture, at, title, lat, lng): the first whose title has the prefecture, else the first."""
    other = ~F.coalesce(F.contains("title", F.col("prefecture")), F.lit(False))
    return found.groupBy("key").agg(F.min_by(F.struct("lat", "lng"), F.struct(other, "at")).alias("p")).select("key", "p.*")


def fill_points(rows: DataFrame, cache: DataFrame, wanted: Column | None = None) -> DataFrame:
    """``rows`` (id, name, address, lat, lng as strings) with coordinates of seven places from ``cache`` (key, lat, lng), and ``geocoded``.

    A group of equal simplified addresses asks for its candidates in order; the first that the cache has
    finite coordinates of counts. ``geocoded``: updated, unchanged (less than a millionth of a degree apart),
    failed, or null for rows that weren't wanted or have no address.
    """
    groups = address_groups(rows, lacks_point() if wanted is None else wanted)
    asked = groups.select("key", F.posexplode(X.geocode_queries(F.col("name"), F.col("query_address"))).alias("at", "q")).select("key", "at", X.light_key(F.col("q")).alias("q"))
    points = cache.select(F.col("key").alias("q"), number("lat").alias("new_lat"), number("lng").alias("new_lng")).where("new_lat is not null and new_lng is not null").dropDuplicates(["q"])
    hits = asked.join(points, "q").groupBy("key").agg(F.min_by(F.struct("new_lat", "new_lng"), "at").alias("p"))
    each = groups.select("key", F.explode("ids").alias("id")).join(hits, "key", "left").select("id", "p", F.lit(True).alias("__asked"))
    near = lambda c: F.abs(number(c) - F.col(f"p.new_{c}")) < SAME_DEGREES
    same = F.coalesce(near("lat") & near("lng"), F.lit(False))
    state = F.when(F.col("__asked").isNull(), F.lit(None)).when(F.col("p").isNull(), "failed").when(same, "unchanged").otherwise("updated")
    met = rows.join(each, "id", "left").withColumn("geocoded", state)
    fixed = {c: F.when(F.col("geocoded") == "updated", F.format_string("%.7f", F.col(f"p.new_{c}"))).otherwise(F.col(c)) for c in ("lat", "lng")}
    return met.withColumns(fixed).drop("p", "__asked")


# Audits of coordinates. Tables of as many rows as there are points are joined by "merge": by the bytes of a compressed file they seem
# small enough to be broadcast, and aren't.


def _of_city(points: DataFrame, targets: DataFrame) -> DataFrame:
    """Points (seq, city, ...) of each wanted city (column ``target``): those whose city ends with it.

    A city is exploded into its endings, so that this is an equi-join.
    """
    endings = F.transform(F.sequence(F.lit(1), F.length("city")), lambda i: F.substring("city", i, F.length("city")))
    return points.where("length(city) > 0").withColumn("target", F.explode(endings)).join(F.broadcast(targets.select("target").distinct()), "target")


def nearest_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, point) of the first block whose city ends with the row's target, whose district contains the row's number in kanji, with the row's block number.

    ``rows``: (id, target, address); ``blocks``: (seq, city, chome, gaiku, lat, lng). The town's name is not compared (Q6).
    """
    n = X.address_numbers(F.col("address"))
    own = rows.select("id", "target", n["first"].alias("a"), n["second"].alias("b")).where("a <> 0 and b <> 0")
    own = own.select("id", "target", F.concat(X.kanji(F.col("a").cast("int")), F.lit("丁目")).alias("chome_part"), F.col("b").cast("string").alias("gaiku"))
    met = own.hint("merge").join(_of_city(blocks, own), ["target", "gaiku"]).where(F.contains("chome", F.col("chome_part")))
    return met.groupBy("id").agg(F.min_by(F.struct("lat", "lng", F.col("chome").alias("chome"), "gaiku"), "seq").alias("point"))


def nearest_district(rows: DataFrame, districts: DataFrame) -> DataFrame:
    """(id, point) of the longest district name in the row's address, among districts whose city ends with its target; the first on ties.

    The names in an address are found in one reading, whatever their number; then cities and names join.
    """
    own = rows.select("id", "target", X.geo_key(X.district_address(F.col("address"))).alias("text"))
    named = needles.contained(own, districts.select(F.col("chome").alias("word")).distinct(), "text").select("id", "target", F.col("word").alias("chome"))
    met = named.hint("merge").join(_of_city(districts, own), ["target", "chome"])
    return met.groupBy("id").agg(F.max_by(F.struct("lat", "lng", F.col("chome").alias("chome"), F.lit(None).cast("string").alias("gaiku")), F.struct(F.length("chome"), -F.col("seq"))).alias("point"))


def located(rows: DataFrame, polygons: DataFrame) -> DataFrame:
    """``rows`` (id, lat, lng, address) with x, y, the polygon they are in and ``reason``: what is wrong, or null.

    ``polygons``: (seq, name, parts).
    """
    own = rows.withColumns({"y": number("lat"), "x": number("lng")})
    inside = regions.regions_of(own.where("x is not null and y is not null").select("id", F.col("y").alias("lat"), F.col("x").alias("lng")), polygons)
    met = own.join(inside.hint("merge"), "id", "left").withColumn("__a", X.geo_key(F.coalesce("address", F.lit(""))))
    name = X.geo_key(F.col("polygon"))
    plain = F.replace(name, F.lit("東京都"), F.lit(""))
    reason = (
        F.when(F.col("x").isNull() | F.col("y").isNull(), "invalid_coords")
        .when(F.col("polygon").isNull(), "outside_tokyo_polygon")
        .when(~F.contains("__a", name) & ~F.contains("__a", plain), "address_mismatch")
    )
    return met.withColumn("reason", reason).withColumn("target", F.coalesce(F.nullif(plain, F.lit("")), name)).drop("__a")


def suspicious(rows: DataFrame, polygons: DataFrame, districts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows with a reason: (id, address, lat, lng, detected, reasons, target_city, target_chome, target_gaiku, distance_m, level)."""
    found = located(rows, polygons)
    asked = found.where("polygon is not null").select("id", "target", "address")
    exact = nearest_block(asked, blocks).withColumnRenamed("point", "block")
    met = found.join(exact.hint("merge"), "id", "left").join(nearest_district(asked, districts).withColumnRenamed("point", "district").hint("merge"), "id", "left")
    point = F.coalesce("block", "district")
    level = F.when(F.col("block").isNotNull(), "gaiku").when(F.col("district").isNotNull(), "chome")
    metres = N.haversine(F.col("y"), F.col("x"), point["lat"], point["lng"])
    out = met.withColumns({"level": level, "metres": metres, "point": point})
    reasons = F.array_compact(F.array(F.col("reason"), F.when(F.col("metres") > FAR_M, F.concat(F.lit("far_from_"), "level"))))
    out = out.withColumn("reasons", F.array_join(reasons, "|")).where("reasons <> ''")
    return out.select("id", "address", "lat", "lng", F.coalesce("polygon", F.lit("")).alias("detected"), "reasons", F.when(F.col("polygon").isNotNull(), F.col("target")).otherwise("").alias("target_city"), F.coalesce("point.chome", F.lit("")).alias("target_chome"), F.coalesce("point.gaiku", F.lit("")).alias("target_gaiku"), F.coalesce(F.format_string("%.1f", F.when(~F.isnan("metres"), F.col("metres"))), F.lit("")).alias("distance_m"), F.coalesce("level", F.lit("")).alias("level"))


def corrected(rows: DataFrame, polygons: DataFrame, districts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows whose point is wrong, with the polygon of their address (J10), the corrected point and how it was found.

    First the block's point, then the district's, then the own point moved towards the polygon's centre
    (M13), or the centre. ``chome_match`` compares the correction with the gazetteer's point it is (Q7), so it
    is "ok" where one was used and empty elsewhere.
    """
    wrong = located(rows, polygons).where("reason is not null")
    name = X.geo_key(F.col("name"))
    names = polygons.groupBy("name").agg(F.min("seq").alias("seq"), F.min_by("parts", "seq").alias("parts"))
    # Whole names count before names without the prefecture, as they are longer.
    words = names.select(F.explode(F.array_distinct(F.array(name, F.replace(name, F.lit("東京都"), F.lit(""))))).alias("word"), F.col("name").alias("target_name"), F.length(name).alias("size"), "seq").where("word <> ''")
    asked = wrong.select("id", X.geo_key(F.coalesce("address", F.lit(""))).alias("text"))
    best = needles.first_contained(asked, words.withColumn("size", -F.col("size")), "text", ["size", "seq"], ["target_name"])
    met = wrong.drop("target").join(best.hint("merge"), "id", "left").withColumn("target", F.replace(X.geo_key(F.col("target_name")), F.lit("東京都"), F.lit("")))
    targets = met.where("target is not null").select("id", "target", "address")
    met = met.join(nearest_block(targets, blocks).withColumnRenamed("point", "block").hint("merge"), "id", "left").join(nearest_district(targets, districts).withColumnRenamed("point", "district").hint("merge"), "id", "left")
    met = met.join(names.select(F.col("name").alias("target_name"), "parts"), "target_name", "left")
    box = N.box(F.col("parts"))
    centre = F.struct(box["cx"].alias("x"), box["cy"].alias("y"), F.lit("set_centroid").alias("status"))
    moved = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), N.snap(F.col("x"), F.col("y"), F.col("parts"))).otherwise(centre)
    met = met.withColumn("moved", F.when(F.col("target_name").isNotNull(), moved)).withColumn("point", F.coalesce("block", "district"))
    status = (
        F.when(F.col("target_name").isNull(), "unresolved_no_target")
        .when(F.col("block").isNotNull(), "fixed_gaiku_point")
        .when(F.col("district").isNotNull(), "fixed_chome_point")
        .otherwise(F.concat(F.when(N.in_parts(F.col("moved.x"), F.col("moved.y"), F.col("parts")), "fixed_").otherwise("unresolved_after_"), "moved.status"))
    )
    own = lambda g, m: F.when(F.col("target_name").isNotNull(), F.coalesce(F.col(f"point.{g}"), F.when(F.col("point").isNull(), F.col(f"moved.{m}"))))
    fixed = met.withColumns({"correction_status": status, "new_lat": own("lat", "y"), "new_lng": own("lng", "x")})
    metres = N.haversine(F.col("new_lat"), F.col("new_lng"), F.col("point.lat"), F.col("point.lng"))
    return fixed.select("id", "address", "lat", "lng", F.coalesce("polygon", F.lit("")).alias("detected"), F.col("reason").alias("reasons"), F.coalesce("target_name", F.lit("")).alias("target"), F.col("new_lat").alias("corrected_lat"), F.col("new_lng").alias("corrected_lng"), "correction_status", F.coalesce("point.chome", F.lit("")).alias("gt_chome"), F.when(F.col("point").isNull(), "").when(metres <= RIGHT_M, "ok").otherwise("far").alias("chome_match"))
