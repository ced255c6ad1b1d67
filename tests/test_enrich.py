from pyspark.sql import functions as F

from cairn.functions import numbers as N
from cairn.functions import text as X
from cairn.operators import enrich

LD = '{"@context":"https://schema.org","@type":"Restaurant","@id":"%s","servesCuisine":%s,"geo":{"@type":"GeoCoordinates","latitude":35.5,"longitude":139.5}}'
PAGE = """<html><script type="application/ld+json">%s</script><table><tr><th>ジャンル</th><td><p><span>もつ焼き、居酒屋</span></p></td></table>
<script>setTargeting('t_category2', "RC01, RC02"); setTargeting('t_category3', "")</script>
<i class="c-rating-v3__time c-rating-v3__time--dinner" aria="x"></i><a class="rdheader-budget__price-target">￥3,000～￥3,999</a>
<i class="c-rating-v3__time c-rating-v3__time--lunch"></i><em>-</em></html>"""


def pages(spark):
    rows = [(1, PAGE % ("[" + LD % ("https://t.jp/a/?x#y", '["おでん","鍋"]') + "]")), (2, PAGE % (LD % ("https://t.jp/a", '"焼肉"'))), (3, PAGE % "{broken"), (4, "<p>no</p>"), (5, None)]
    return spark.createDataFrame(rows, "seq long, html string")


def test_pages(spark):
    got = {r["seq"]: (r["url_key"], r["features"]) for r in enrich.page_features(pages(spark)).collect()}
    assert got == {1: ("https://t.jp/a", "おでん、鍋 もつ焼き、居酒屋 RC01,RC02"), 2: ("https://t.jp/a", "焼肉 もつ焼き、居酒屋 RC01,RC02")}
    assert {(r["seq"], r["lat"], r["lng"]) for r in enrich.page_points(pages(spark)).collect()} == {(1, 35.5, 139.5), (2, 35.5, 139.5)}
    budgets = enrich.page_budgets(pages(spark)).collect()
    assert {(r["seq"], r["dinner"]["low"], r["dinner"]["high"], r["lunch"]["low"]) for r in budgets} == {(1, 3000, 3999, None), (2, 3000, 3999, None)}
    rows = spark.createDataFrame([("https://t.jp/a/", "x", "old"), ("https://t.jp/b", "y", "old")], "url string, name string, genre string")
    got = {r["name"]: r["genre"] for r in enrich.genre_of_pages(rows, enrich.page_features(pages(spark)), "url", "name", "genre").collect()}
    assert got == {"x": "もつ焼き", "y": "old"}


def test_averages_and_texts(spark):
    rows = spark.createDataFrame([("tabelog", "", "3000", "3999", ""), ("hotpepper", "https://h/strJ1/", "", "", ""), ("hotpepper,tabelog", "https://h/strJ1/", "", "", ""), ("hotpepper", "https://h/strJ2", "", "", "7")], "sources string, url string, dinner_budget_min string, dinner_budget_max string, avg_dinner_budget string")
    quotes = spark.createDataFrame([("J1", "", "フリー2500円 宴会3500円"), ("J2", "1000", "")], "id string, name string, average string")
    got = sorted((r["sources"], r["url"], r["avg_dinner_budget"]) for r in enrich.fill_average(rows, quotes).collect())
    assert got == [("hotpepper", "https://h/strJ1/", "3000"), ("hotpepper", "https://h/strJ2", "7"), ("hotpepper,tabelog", "https://h/strJ1/", ""), ("tabelog", "", "3500")]
    assert {r["avg_dinner_budget"] for r in enrich.fill_average(rows).collect()} == {"3500", "", "7"}
    rows = spark.createDataFrame([("a", "u", "C", "韓国"), ("b", "", "", "その他"), ("c", "", "C", "韓国"), ("d", "", "S", "韓国"), ("e", "u2", "C", "その他")], "name string, url string, carnivore_rank string, genre string")
    cache = spark.createDataFrame([("a", "churrasco"), ("b", "none of it"), ("c", ""), ("url:u", "キムチ"), ("d", "churrasco")], "key string, text string")
    genres = lambda **o: [r["genre"] for r in sorted(enrich.genre_of_texts(rows, cache, **o).collect())]
    assert genres() == ["シュラスコ", "その他", "韓国", "韓国", "その他"]
    assert genres(prefer_url=True)[0] == "韓国" and genres(prefer_url=True, only="t.jp")[0] == "シュラスコ"


def test_filters(spark):
    rows = spark.createDataFrame([("1", "2", "Hotpepper", "a", 2000, "current"), ("x", "2", "tabelog", "b", None, "old"), (None, "nan", None, "a", 6000, "current")], "lat string, lng string, sources string, genre string, price int, status string")
    keep = lambda c: [bool(r[0]) for r in rows.select(c).collect()]
    assert keep(enrich.has_source(F.col("sources"), "hotpepper")) == [True, False, False] and keep(enrich.has_source(F.col("sources"), "hotpepper", True)) == [False, False, False]
    assert keep(enrich.lacks_point()) == [False, True, True] and keep(enrich.lacks_point(True, "Tabelog")) == [False, True, False]
    show = lambda *a, **o: keep(enrich.shown(F.col("genre"), F.col("price"), F.col("status"), *a, **o))
    assert show() == [True] * 3 and show(["a"], "p10k") == [False, False, True] and show(band="unknown") == [False, True, False] and show(current_only=True) == [True, False, True]
    assert [r[0] for r in rows.select(N.fixed(F.col("price"), 1)).collect()] == ["2000.0", None, "6000.0"]
    subs = ['{"name":"a"}', '"b"', '[{"name":"a"},"c",{"name":""},{"x":1}]', "plain", "", None, "[]"]
    got = spark.createDataFrame([(s,) for s in subs], "s string").select(X.sub_genres(F.col("s"))).collect()
    assert [r[0] for r in got] == [["a"], ['"b"'], ["a", "c"], ["plain"], [], [], []]
    lat, lng = N.degrees(111_000, 60)
    assert lat == 1.0 and abs(lng - 2.0) < 1e-9
    age = spark.sql("select timestamp'2026-01-01 00:00:00' a, timestamp'2026-02-01 23:00:00' b").select(N.age_days(F.col("a"), F.col("b"))).first()[0]
    assert age == 31


def test_geocoding(spark):
    rows = spark.createDataFrame([(1, "a", "東京都港区 1-2 ビル", "", ""), (2, "b", "東京都港区 1-2 塔", "x", "1"), (3, "c", "東京都北区9", "", ""), (4, "d", "", "", ""), (5, "e", "東京都港区1-2", "35.0000001", "139.0"), (6, "f", "どこか", None, None)], "id int, name string, address string, lat string, lng string")
    groups = {r["key"]: (r["name"], r["ids"]) for r in enrich.address_groups(rows, F.lit(True)).collect()}
    assert groups["東京都港区1-2"] == ("a", [1, 2, 5]) and len(groups) == 3
    cache = spark.createDataFrame([("東京都港区1-2", "35.0", "139.0"), ("東京都北区9", "nan", "1"), ("f", "36", "140.5")], "key string, lat string, lng string")
    got = {r["id"]: (r["lat"], r["lng"], r["geocoded"]) for r in enrich.fill_points(rows, cache, F.lit(True)).collect()}
    assert got == {1: ("35.0000000", "139.0000000", "updated"), 2: ("35.0000000", "139.0000000", "updated"), 3: ("", "", "failed"), 4: ("", "", None), 5: ("35.0000001", "139.0", "unchanged"), 6: ("36.0000000", "140.5000000", "updated")}
    assert {r["id"] for r in enrich.fill_points(rows, cache).where("geocoded is not null").collect()} == {1, 2, 3, 6}
    found = spark.createDataFrame([("k", "東京都", 0, "大阪府x", 1.0, 2.0), ("k", "東京都", 1, "東京都y", 3.0, 4.0), ("m", None, 1, "b", 7.0, 8.0), ("m", None, 0, "a", 5.0, 6.0)], "key string, prefecture string, at int, title string, lat double, lng double")
    assert {(r["key"], r["lat"]) for r in enrich.pick_candidate(found).collect()} == {("k", 3.0), ("m", 5.0)}


def test_audits(spark):
    ring = lambda x, y: [[[(x, y), (x + 0.1, y), (x + 0.1, y + 0.1), (x, y + 0.1), (x, y)]]]
    polygons = spark.createDataFrame([(0, "東京都港区", ring(139.0, 35.0)), (1, "東京都北区", ring(139.2, 35.0))], "seq int, name string, parts array<array<array<struct<x:double,y:double>>>>")
    districts = spark.createDataFrame([(0, "東京都港区", "芝一丁目", 35.05, 139.05), (1, "東京都港区", "芝", 35.01, 139.01), (2, "東京都北区", "芝一丁目", 0.0, 0.0)], "seq int, city string, chome string, lat double, lng double")
    blocks = spark.createDataFrame([(0, "東京都港区", "芝二丁目", "7", 35.06, 139.06), (1, "東京都港区", "浜二丁目", "7", 35.02, 139.02)], "seq int, city string, chome string, gaiku string, lat double, lng double")
    rows = spark.createDataFrame([
        (1, "東京都港区芝1-3", "35.05", "139.05"),  # right: its district's point
        (2, "東京都港区芝2-7", "35.06", "139.0601"),  # right: its block's point
        (3, "東京都港区芝2-7", "35.02", "139.02"),  # far from its block
        (4, "東京都港区芝1", "35.001", "139.001"),  # far from its district
        (5, "東京都北区王子", "35.05", "139.05"),  # in another polygon
        (6, "東京都港区芝2-7", "10", "10"),
        (7, "東京都港区浜松町", "x", ""),
        (8, "大阪府", "0", "0"),
        (9, "東京都北区王子", "35.05", "139.35"),
    ], "id int, address string, lat string, lng string")
    got = {r["id"]: (r["reasons"], r["level"]) for r in enrich.suspicious(rows, polygons, districts, blocks).collect()}
    assert got == {3: ("far_from_gaiku", "gaiku"), 4: ("far_from_chome", "chome"), 5: ("address_mismatch", ""), 6: ("outside_tokyo_polygon", ""), 7: ("invalid_coords", ""), 8: ("outside_tokyo_polygon", ""), 9: ("outside_tokyo_polygon", "")}
    fixed = {r["id"]: r for r in enrich.corrected(rows, polygons, districts, blocks).collect()}
    assert {k: (r["correction_status"], r["target"], r["chome_match"]) for k, r in fixed.items()} == {5: ("fixed_snapped_midpoint", "東京都北区", ""), 6: ("fixed_gaiku_point", "東京都港区", "ok"), 7: ("fixed_set_centroid", "東京都港区", ""), 8: ("unresolved_no_target", "", ""), 9: ("fixed_snapped_midpoint", "東京都北区", "")}
    assert (fixed[6]["corrected_lat"], fixed[6]["corrected_lng"]) == (35.06, 139.06) and 139.2 < fixed[5]["corrected_lng"] < 139.3 and fixed[8]["corrected_lat"] is None


def test_districts_of_several_parts(spark):
    square = lambda x, y: [[(x, y), (x + 0.08, y), (x + 0.08, y + 0.08), (x, y + 0.08)]]
    parts = [square(139.0, 35.0), square(139.5, 35.0)]
    polygons = spark.createDataFrame([(0, "港区", parts), (1, "北区", [square(139.2, 35.0)])], "seq int, name string, parts array<array<array<struct<x:double,y:double>>>>")
    none = spark.createDataFrame([], "seq int, city string, chome string, gaiku string, lat double, lng double")
    rows = spark.createDataFrame([(1, "港区", "35.04", "139.04"), (2, "港区", "35.04", "139.54"), (3, "港区", "x", ""), (4, "北区", "35.04", "139.54"), (5, "港区", "35.04", "139.3")], "id int, address string, lat string, lng string")
    assert {r["id"]: r["reasons"] for r in enrich.suspicious(rows, polygons, none.drop("gaiku"), none).collect()} == {3: "invalid_coords", 4: "address_mismatch", 5: "outside_tokyo_polygon"}
    fixed = {r["id"]: r for r in enrich.corrected(rows, polygons, none.drop("gaiku"), none).collect()}
    # The centre of both parts is in neither.
    assert abs(fixed[3]["corrected_lng"] - 139.29) < 1e-9 and abs(fixed[3]["corrected_lat"] - 35.04) < 1e-9
    assert fixed[3]["correction_status"] == "unresolved_after_set_centroid" and fixed[4]["correction_status"] == "fixed_snapped_midpoint" and fixed[5]["correction_status"] == "unresolved_after_set_centroid"


def test_audits_join_points_by_shuffles(spark, tmp_path):
    from cairn import registry

    spark.range(60).selectExpr("id as p_partkey", "'n' as p_name", "'b' as p_brand", "'t' as p_type", "1 as p_size", "1D as p_retailprice").write.parquet(f"{tmp_path}/part.parquet")
    for name in ("suspicious_coordinates", "corrected_coordinates"):
        plan = registry.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        joins = [x for x in plan.splitlines() if "HashJoin [id#" in x or "HashJoin [target#" in x and "BuildLeft" in x]
        assert "SortMergeJoin [id#" in plan and not joins
