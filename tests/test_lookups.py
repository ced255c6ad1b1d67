import json
import os
import tempfile

from cairn.operators import enrich, lookups
from pyspark.sql import functions as F

#: Calls of all tasks' workers, which have the environment that Spark began with.
SEEN = os.path.join(tempfile.gettempdir(), f"cairn-lookups-{os.getuid()}")


def counting(parameters):
    """Answers of a made-up geocoder; each call leaves a line in a file that all tasks share."""
    with open(SEEN, "a") as f:
        f.write(parameters["q"] + "\n")
    q = parameters["q"]
    if "broken" in q:
        raise OSError("https://api/?key=SECRET")
    if "busy" in q:
        return 503, ""
    if "known" not in q:
        return 200, "[]"
    return 200, json.dumps([{"geometry": {"coordinates": [1.0, 2.0]}, "properties": {"title": "大阪府"}}, {"geometry": {"coordinates": [139.0, 35.0]}, "properties": {"title": "東京都"}}])


def rows_of(spark, n):
    kind = F.when(F.col("id") % 3 == 0, "known").when(F.col("id") % 11 == 1, "busy").when(F.col("id") % 11 == 2, "broken").otherwise("void")
    return spark.range(n).select("id", F.concat(F.lit("shop "), "id").alias("name"), F.concat(F.lit("東京都"), kind, F.col("id").cast("string"), F.lit(" 1-2 x")).alias("address"), F.lit("").alias("lat"), F.lit("").alias("lng"))


def test_a_budget_for_all_tasks(spark, tmp_path):
    seen = SEEN
    open(seen, "w").close()
    groups = enrich.address_groups(rows_of(spark, 60), F.lit(True))
    wanted = lookups.address_queries(groups)
    path, sent, told = str(tmp_path / "cache"), 0, []
    for limit in (0, 1, 30, 1000, 1000, 1000):
        cache = lookups.fill(wanted, path, "tests.test_lookups.counting", "q", lookups.point_of, limit, tasks=4)
        lines = open(seen).read().splitlines() if os.path.exists(seen) else []
        told.append(len(lines) - sent)
        assert told[-1] <= limit
        sent = len(lines)
    assert told[:3] == [0, 1, told[2]] and told[2] > 10
    # What failed is asked again, what was answered, if with nothing, is not.
    answered = {k for k in lines if "busy" not in k and "broken" not in k}
    assert len([k for k in lines if k in answered]) == len(answered) and told[4] == told[5] == len({k for k in lines} - answered)
    filled = enrich.fill_points(rows_of(spark, 60), lookups.points(cache), F.lit(True)).collect()
    assert {r["geocoded"] for r in filled if r["id"] % 3 == 0} == {"updated"} and {r["lat"] for r in filled if r["id"] % 3 == 0} == {"35.0000000"}
    assert {r["geocoded"] for r in filled if r["id"] % 3} == {"failed"}


def test_texts(spark, tmp_path):
    open(SEEN, "w").close()
    wanted = spark.createDataFrame([("a", 0, None, [(0, "known a", "a")]), ("b", 1, None, [(0, "void", "b")]), ("c", 2, None, [(0, "known a", "a"), (1, "known c", "c")])], "group string, rank int, hint string, queries array<struct<at:int,query:string,key:string>>")
    cache = lookups.fill(wanted, str(tmp_path / "c"), "tests.test_lookups.counting", "q", lookups.text_of, 10)
    # The query that a and c have in common is asked once, for a.
    assert sorted(open(SEEN).read().split("\n")) == ["", "known a", "known c", "void"]
    assert {r["key"] for r in lookups.texts(cache).collect()} == {"a", "b", "c"} and lookups.read(spark, str(tmp_path / "none")).count() == 0
