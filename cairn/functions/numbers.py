
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import text as X

EARTH_M, DEGREE_M = 6_371_000.0, 111_000.0
LAT_RANGE, LNG_RANGE, MAX_BUDGET = (24.0, 36.0), (138.0, 154.0), 100_000


def _numbers(x: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)), lambda v: F.replace(v, F.lit(","), F.lit("")).try_cast("bigint"))


def budget_midpoint(x: Column) -> Column:
    """M2: half-even mean of the first two positive numbers, or the only one. ``x`` is in NFKC."""
    v = F.filter(_numbers(x, r"[0-9][0-9,]*"), lambda n: n > 0)
    return F.when(F.size(v) >= 2, F.bround((F.try_element_at(v, F.lit(1)) + F.try_element_at(v, F.lit(2))) / 2)).otherwise(F.try_element_at(v, F.lit(1))).cast("bigint")


def safe_budget(name: Column, average: Column) -> Column:
    """M1: the label's midpoint if there is a label; else the average's, if it is a price, or a range of prices, and no more. Both are taken in NFKC."""
    money = r"[¥￥]?\s*[0-9][0-9,]*\s*円?"
    label, quoted = X.nfkc(name), F.trim(X.nfkc(average))
    price = quoted.rlike(rf"(?U)^{money}(?:\s*[~～〜-]\s*{money})?\s*(?:程度|前後|以下|以上)?$")
    return F.when(F.coalesce(name, F.lit("")) != "", budget_midpoint(label)).when(price, budget_midpoint(quoted))


def free_text_mean(x: Column) -> Column:
    """M3: half-even mean of all numbers, zeros too."""
    v = _numbers(x, r"[0-9][0-9,]*")
    return F.when(F.size(v) > 0, F.bround(F.aggregate(v, F.lit(0).cast("bigint"), lambda a, n: a + n) / F.size(v))).cast("bigint")


def range_mean(low: Column, high: Column) -> Column:
    """M4: half-even mean of two strings of digits, or the one there is."""
    n = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("bigint"))
    return F.coalesce(F.bround((n(low) + n(high)) / 2).cast("bigint"), n(low), n(high))


def budget_range(x: Column) -> Column:
    """M5: struct of low and high of a price range; a single price is both."""
    v = F.regexp_replace(F.trim(x), "[円,￥¥ ]", "")
    v = F.when(v.isin("-", "－", ""), F.lit(None)).otherwise(v)
    part = F.split(v, "[～~]", 2)
    low, high = F.try_element_at(part, F.lit(1)).try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    return F.struct(low.alias("low"), F.when(F.size(part) >= 2, high).otherwise(low).alias("high"))


def public_budget(x: Column) -> Column:
    """M6: whole positive yen up to the limit as a string, else the empty string."""
    d = x.try_cast("double")
    return F.when(d.isNotNull() & ~F.isnan(d) & (d >= 1) & (d < MAX_BUDGET + 1), F.floor(d).cast("int").cast("string")).otherwise("")


def valid_point(lat: Column, lng: Column) -> Column:
    """M7: finite and inside the range."""
    return F.coalesce(lat.try_cast("double").between(*LAT_RANGE) & lng.try_cast("double").between(*LNG_RANGE), F.lit(False))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """M8: metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def edges(rings: Column) -> Column:
    """Edges struct(a, b) of all rings, each of which is closed; ``rings``: arrays of struct(x, y)."""
    closed = lambda r: F.zip_with(r, F.concat(F.slice(r, F.size(r), 1), F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0)))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r) > 0), closed))


def crossed(x: Column, y: Column, edges: Column) -> Column:
    """Whether a ray to the east crosses an odd number of edges."""
    hit = F.filter(edges, lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"] + 1e-15) + e["a"]["x"]))
    return F.size(hit) % 2 == 1


def in_parts(x: Column, y: Column, parts: Column) -> Column:
    """In any part; inside of an odd number of a part's rings, so that holes count as outside."""
    return F.exists(parts, lambda rings: crossed(x, y, edges(rings)))


def box(parts: Column) -> Column:
    """Bounding box of all parts, and mean of all their vertices, closing ones too; (0, 0) if there are none."""
    p = F.flatten(F.flatten(parts))
    xs, ys = F.transform(p, lambda v: v["x"]), F.transform(p, lambda v: v["y"])
    mean = lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, n: a + n) / F.size(v)).otherwise(0.0)
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"), mean(xs).alias("cx"), mean(ys).alias("cy"))


def snap(x: Column, y: Column, parts: Column, steps: int = 10) -> Column:
    """struct(x, y, status): as it is, or moved half-way to the centre until inside, or the centre."""
    b = box(parts)
    start = F.struct(x.alias("x"), y.alias("y"), in_parts(x, y, parts).alias("inside"), F.lit(0).alias("n"))

    def half(s: Column, _: Column) -> Column:
        nx, ny = (s["x"] + b["cx"]) / 2, (s["y"] + b["cy"]) / 2
        return F.when(s["inside"], s).otherwise(F.struct(nx.alias("x"), ny.alias("y"), in_parts(nx, ny, parts).alias("inside"), (s["n"] + 1).alias("n")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half)
    return F.transform(F.array(end), lambda s: F.when(s["inside"], F.struct(s["x"].alias("x"), s["y"].alias("y"), F.when(s["n"] == 0, F.lit("already_inside")).otherwise(F.lit("snapped_midpoint")).alias("status"))).otherwise(F.struct(b["cx"].alias("x"), b["cy"].alias("y"), F.lit("set_centroid").alias("status"))))[0]


def past_date(x: Column, as_of: Column) -> Column:
    """An ISO date that isn't after ``as_of``, else null."""
    d = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(x, "yyyy-MM-dd"))
    return F.when(d <= as_of, d)


def degrees(metres: float, lat: float) -> tuple[float, float]:
    """M9: a distance in degrees of latitude and, at ``lat``, of longitude."""
    import math

    return metres / DEGREE_M, metres / (DEGREE_M * math.cos(math.radians(lat)))


def fixed(x: Column, places: int = 7) -> Column:
    """A number with so many places; null stays null."""
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", x.cast("double")))


def age_days(made: Column, now: Column) -> Column:
    """Whole days between two times."""
    return F.floor((F.unix_micros(now) - F.unix_micros(made)) / 86_400_000_000).cast("int")
