import random

from cairn import registry
from cairn.operators import search


def test_against_a_scan(spark):
    rng = random.Random(8)
    names = [(i, "".join(rng.choices("aAbé 焼İ", k=rng.randint(0, 14)))) for i in range(400)] + [(900, None), (901, "aab" * 400)]
    rows = spark.createDataFrame(names, "id long, name string").repartition(3)
    index = search.build(rows, "name")
    for needle in ["", "a", "ab", "aab", "AaB", "bé ", "焼焼", "zzz", "aabaab", "a" * 20, *(n[2:7] for _, n in names[:12])]:
        got = search.containing(spark, index, needle)
        assert got.columns == ["id", "name"]
        assert sorted(r["id"] for r in got.collect()) == [i for i, n in names if n is not None and needle.lower() in n.lower()], needle
        assert sorted(r["id"] for r in search.beginning(spark, index, needle).collect()) == [i for i, n in names if n is not None and n.lower().startswith(needle.lower())], needle
    assert [r["id"] for r in search.first(search.containing(spark, index, "aab"), ["id"], 3).collect()] == [i for i, n in names if n and "aab" in n.lower()][:3]
    none = search.build(rows.limit(0), "name")
    assert search.containing(spark, none, "aab").count() == search.beginning(spark, none, "a").count() == 0


def test_plans_read_one_bucket_and_a_range(spark):
    index = search.build(spark.range(2000).selectExpr("id", "concat('shop ', id) as name"), "name")
    plan = search.containing(spark, index, "shop 77")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(__bucket" in plan and "EqualTo(__run," in plan and "Join" not in plan
    plan = search.beginning(spark, index, "shop 77")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(__key,shop 77)" in plan and "GreaterThanOrEqual(__key,shop 77)" in plan


def test_every_blog_is_searched(spark, tmp_path):
    pages = [(i, f"https://{host}/p{i}") for i, host in enumerate(["blog.th.example", "Blog.example", "my-blog.de", "news.example"] * 3)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [r["page_id"] for r in registry.QUERIES["name_search_topk"](spark, str(tmp_path)).collect()] == [i for i in range(12) if i % 4 < 3]
