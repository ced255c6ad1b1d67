from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import match


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ", ".join(f"{k} {'double' if isinstance(v, float) else 'string'}" for k, v in values.items()) or "x int")
    return df.select(column.alias("r")).first()["r"]


def test_text(spark):
    t = lambda f, v, *a: one(spark, f(F.col("v"), *a), v=v)
    assert t(X.strong_key, "Ｃａｆé・Straße 1") == "cafestrasse1".replace("cafe", "café")
    assert t(X.light_key, " Ａ　b C ") == "abc" and t(X.geo_key, "東京　都 A") == "東京都A"
    assert t(X.name_key, "A　b\tC") == "abc" and t(X.name_key, " ") is None
    assert t(X.phone_key, "03-１２(34)") == "03１２34" and t(X.phone_key, "-") is None
    assert t(X.strip_branch, "牛角 新宿店", False) == "牛角" and t(X.strip_branch, "牛角 新宿", False) == "牛角 新宿"
    assert t(X.match_key, "炭火焼肉・牛角本店", False) == "炭火牛角" and t(X.match_key, "炭火 牛角店", False) == "炭火"
    assert t(X.address_block, "東京都新宿区西新宿1丁目2-3") == "東京都新宿区西新宿1丁目" and t(X.address_block, "新宿区西新宿1-2-3") == "新宿区西新宿1-" and t(X.address_block, "新宿") is None
    assert t(X.url_key, " http://a.b/c//?q=1#x ") == "http://a.b/c"
    hosts = ["hotpepper.jp", "www.hotpepper.jp"]
    assert t(X.listing_id, "https://www.HotPepper.jp/strj0012/?a", hosts) == "J0012"
    assert t(X.listing_id, "http://www.hotpepper.jp/strJ1/", hosts) is None and t(X.listing_id, "https://x.jp/strJ1/", hosts) is None
    assert t(X.tokens, "b, A,,a ") == ["b", "a"] and t(X.valid_legacy_id, " LEGACY_" + "a" * 20) == "legacy_" + "a" * 20 and t(X.valid_legacy_id, "legacy_1") == ""
    assert t(X.simple_address, "東京都 新宿区 1-2-3 ビル 4F", False) == "東京都 新宿区 1-2-3"
    assert t(X.prefecture, "東京都港区") == "東京都" and t(X.prefecture, "x") is None
    assert t(X.district_address, "新宿区西新宿2丁目8") == "新宿区西新宿二丁目8" and t(X.district_address, "新宿区西新宿２-8-1") == "新宿区西新宿二丁目8-1"
    assert tuple(t(X.address_numbers, "西新宿2丁目8-1")) == (2, 8)
    assert [one(spark, X.kanji(F.lit(n))) for n in (0, 9, 10, 21, 30, 100)] == ["〇", "九", "十", "二十一", "三十", "100"]
    assert t(X.lineage, "x", F.lit("")) == "hotpepper" and t(X.lineage, "x", F.lit("y")) == "hotpepper,legacy_local" and t(X.lineage, "", F.lit(None)) is None


def test_common_runs(spark):
    pairs = [("abcdef", "xxcdexx", 3), ("ab", "cd", 0), ("", "a", 0), ("同じ名前の店", "名前の", 3), ("aaaa", "aa", 2)]
    df = spark.createDataFrame(pairs, "a string, b string, n int")
    for r in df.select("n", "a", "b", X.shares_run(F.col("a"), F.col("b"), 3).alias("s")).collect():
        assert match._Runs(r["a"]).longest(r["b"]) == match._Runs(r["b"]).longest(r["a"]) == r["n"] and r["s"] == (r["n"] >= 3)


def test_numbers(spark):
    t = lambda f, v: one(spark, f(F.col("v")), v=v)
    assert [t(N.budget_midpoint, v) for v in ("4000円", "1,000～2,000円", "3001～4000円", "0円", "料金未定")] == [4000, 1500, 3500, None, None]
    assert t(N.budget_midpoint, "2～3") == 2 and t(N.free_text_mean, "昼1000 夜0") == 500
    assert [tuple(t(N.budget_range, v)) for v in ("￥1,000～￥1,999", "-", "900円", "～2000")] == [(1000, 1999), (None, None), (900, 900), (None, 2000)]
    assert [t(N.public_budget, v) for v in ("3000.0", "0", "100001", "x", "NaN", "inf", "0.5")] == ["3000", "", "", "", "", "", ""]
    assert one(spark, N.safe_budget(F.col("a"), F.col("b")), a="", b="3000円") == 3000 and one(spark, N.safe_budget(F.col("a"), F.col("b")), a="", b="2名で3000円") is None
    quoted = ["３０００円", "￥3,000", "3000円前後", "¥4,000程度", "４０００円", "3001～4000円", "￥1,000 ~ 2,000円以下", "約3000円", "0円", "", None]
    assert [one(spark, N.safe_budget(F.col("a"), F.col("b")), a=None, b=v) for v in quoted[:-1]] == [3000, 3000, 3000, 4000, 4000, 3500, 1500, None, None, None]
    assert one(spark, N.safe_budget(F.col("a"), F.col("b")), a="３００１～４０００円", b="9円") == 3500 and one(spark, N.safe_budget(F.col("a"), F.col("b")), a="未定", b="9円") is None
    assert abs(one(spark, N.haversine(F.lit(35.0), F.lit(139.0), F.lit(36.0), F.lit(139.0))) - 111194.9) < 0.1
    assert one(spark, N.range_mean(F.col("a"), F.col("b")), a="1", b="2") == 2 and one(spark, N.range_mean(F.col("a"), F.col("b")), a="", b="7") == 7


def test_polygons(spark):
    ring = lambda *p: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p))
    donut = F.array(ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((4, 4), (6, 4), (6, 6), (4, 6), (4, 4)))
    inside = lambda x, y: one(spark, N.in_parts(F.lit(float(x)), F.lit(float(y)), F.array(donut)))
    assert inside(1, 1) and not inside(5, 5) and not inside(11, 5) and inside(7, 9)
    square = F.array(ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)))
    assert one(spark, N.snap(F.lit(1.0), F.lit(1.0), F.array(square)))["status"] == "already_inside"
    assert one(spark, N.snap(F.lit(9.0), F.lit(1.0), F.array(square)))["status"] == "snapped_midpoint"


def test_keys_and_queries(spark):
    two = lambda f, a, b: one(spark, f(F.col("a"), F.col("b")), a=a, b=b)
    assert two(X.entity_key, "Ａ b　C", "東京 都") == "abc||東京都" and two(X.entity_key, "a", "") == "a||"
    assert [one(spark, X.overlap_name(F.col("v")), v=v) for v in ("Café本店", "焼肉・ＡＢＣ店", "が")] == ["cafe", "焼肉・abc", "か"]
    assert one(spark, X.overlap_name(F.col("v"), compat=False), v="焼肉・ A-B 店") == "焼肉ab"
    assert two(X.search_query, "店", "東京都港区") == "店 東京都" and two(X.search_query, "店", "大阪府") == "店"
    assert two(X.joined_text, "a", "b") == "a b" and two(X.joined_text, "a", "") == "a" and two(X.joined_text, "", "") == ""
