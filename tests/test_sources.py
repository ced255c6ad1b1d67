import json
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn.sources import files, remote


def captured(parameters):
    """Answers of a made-up service: six records of a genre, two to a page; one of a keyword."""
    start, count = int(parameters["start"]), int(parameters["count"])
    own = [{"id": f"J{k}", "name": f"{parameters.get('genre') or parameters.get('keyword')} {k}"} for k in (range(1, 7) if "genre" in parameters else [3, 9])]
    return 200, json.dumps({"results": {"results_available": len(own), "shop": own[start - 1 : start - 1 + count]}})


def test_paging_and_retries():
    assert [len(p) for p in remote.pages(captured, {"genre": "g"}, 4)] == [4, 2]
    assert [len(p) for p in remote.pages(captured, {"genre": "g"}, 3)] == [3, 3]
    slept, calls = [], []

    def failing(parameters):
        calls.append(parameters)
        raise OSError("https://api/?key=SECRET")

    with pytest.raises(remote.RequestError) as caught:
        remote.request(failing, {"key": "SECRET"}, slept.append)
    assert "SECRET" not in str(caught.value) and len(calls) == 3 and slept == [2.0, 4.0]
    for text, said in (("{", "JSON"), ("{}", "results"), ('{"results":{"error":[{"message":"a"},{"message":"b"}]}}', "a; b")):
        with pytest.raises(remote.RequestError, match=said):
            remote.request(lambda p, text=text: (200, text), {}, slept.append)
    call = remote.throttled(lambda p: (200, "x"), 2, 0.5, slept.append)
    assert [call({})[0] for _ in range(3)] == [200, 200, 429] and slept[-1] == 0.5
    assert remote.geocoder_answers('[{"geometry":{"coordinates":[139.5,35.5]},"properties":{"title":"t"}},{"geometry":{}}]') == [(35.5, 139.5, "t")]


def test_api_source(spark):
    remote.register(spark)
    found = spark.read.format("poi_api").option("transport", "tests.test_sources.captured").option("areas", "Z1").option("genres", "g1,,g2").option("keywords", "k").option("genre_count", 4).option("wait", "false").load()
    assert found.count() == 14
    merged = files.union_scans(found, "rank", "seq", "id")
    got = {r["id"]: json.loads(r["shop"])["name"] for r in merged.collect()}
    assert got == {**{f"J{k}": f"g2 {k}" for k in range(1, 7)}, "J9": "k 9"}


def standard(parameters):
    """One shop of each genre code, of which one is of an excluded kind; a keyword finds the genres' first again."""
    kind = parameters.get("genre") or "K"
    shops = [{"id": kind, "name": "もんじゃ x" if kind == "G029" else kind, "lat": "35.5", "genre": {"name": "g"}}] + ([{"id": "G008", "name": "later"}, {"id": "", "name": "none"}] if kind == "K" else [])
    return 200, json.dumps({"results": {"results_available": len(shops), "shop": shops}})


def test_standard_scans_and_excluded_shops(spark):
    remote.register(spark)
    scans = spark.read.format("poi_api").option("transport", "tests.test_sources.standard").option("wait", "false").load()
    assert scans.where("rank = 0").count() == 5 and scans.where("rank = 1").count() == 75
    assert scans.select("seq").distinct().count() == 80
    got = {r["external_id"]: r for r in files.fetched_shops(scans).collect()}
    assert {*got} == {"G008", "G016", "G017", "G048", "K"} and got["G008"]["name"] == "G008" and got["G008"]["genres"] == ["g"] and got["G008"]["lat"] == 35.5


def test_more_files(spark, tmp_path):
    many = tmp_path / "m.csv"
    many.write_text("".join(f"# k{i}={i}\n" for i in range(500)) + "name\nx\n", encoding="utf-8")
    assert len(files.csv_metadata(spark, str(many))) == 500
    repository = tmp_path / "r"
    repository.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repository), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    (repository / "a.csv").write_text('﻿# v=1\nname,url\n"a, b", u\nc\n', encoding="utf-8")
    git("add", "."), git("commit", "-qm", "x")
    metadata, rows = files.csv_of_ref(spark, str(repository), "HEAD", "a.csv")
    assert metadata == {"v": "1"} and [tuple(r) for r in rows.collect()] == [("a, b", "u"), ("c", "")]
    with pytest.raises(ValueError, match="git show"):
        files.csv_of_ref(spark, str(repository), "HEAD", "b.csv")
    for text, said in (("name\na,b\n", "more values"), ("name,x\n ,b\n", "no name")):
        with pytest.raises(ValueError, match=said):
            files.csv_of_text(spark, text)
    assert files.repair_header("name,urlx,y\n", "name,url") == "name,url\nx,y\n" and files.repair_header("name,url\nx\n", "name,url") == "name,url\nx\n"
    (tmp_path / "b_map.html").write_text("two")
    (tmp_path / "a_map.html").write_text("one")
    (tmp_path / "other.html").write_text("no")
    assert [r["html"] for r in files.read_pages(spark, str(tmp_path)).orderBy("seq").collect()] == ["one", "two"]
    (tmp_path / "c.json").write_text('{"q1":{"lat":35.5,"lng":139},"q2":{"lat":null}}')
    assert {(r["key"], r["lat"]) for r in files.read_cache(spark, str(tmp_path / "c.json"), ("lat", "lng")).collect()} == {("q1", "35.5"), ("q2", None)}
    (tmp_path / "t.json").write_text('{"name":"text"}')
    (tmp_path / "bad.json").write_text("{")
    assert [tuple(r) for r in files.read_cache(spark, str(tmp_path / "t.json")).collect()] == [("name", "text")]
    assert files.read_cache(spark, str(tmp_path / "none.json")).count() == 0 and files.read_cache(spark, str(tmp_path / "bad.json")).count() == 0
    archive = tmp_path / "g.zip"
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("g.csv", "市区町村名・漢字,大字・町丁目名,街区符号・地番,緯度,経度\n港 区,芝一丁目, 7 ,35.5,139.5\n港区,,1,1,1\n北区,王子,2,,\n".encode("shift_jis"))
    got = [(r["seq"], r["city"], r["chome"], r["gaiku"], r["lat"]) for r in files.gazetteer(spark, str(archive), "g.csv", files.BLOCKS).orderBy("seq").collect()]
    assert [(r[0]["at"], *r[1:]) for r in got] == [(1, "港区", "芝一丁目", "7", 35.5), (3, "北区", "王子", "2", None)]
    assert files.gazetteer(spark, str(tmp_path / "no.zip"), "g.csv", files.DISTRICTS).count() == 0


def test_grid(spark):
    grid = files.lattice(spark, (35.0, 139.0, 35.02, 139.02), 800, 500)
    rows = grid.orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(len(rows))) and all(35.0 <= r["lat"] <= 35.02 and 139.0 <= r["lng"] <= 139.02 and r["radius_m"] == 500 for r in rows)
    chunks = files.chunked(grid, 4).groupBy("chunk").count().orderBy("chunk").collect()
    assert sum(r["count"] for r in chunks) == len(rows) and all(r["count"] == 4 for r in chunks[:-1])


def test_sinks(spark, tmp_path):
    stores = spark.createDataFrame([("a", 80.0, "S", ["焼肉", "x"], ["b", "a"], None, 3000), ("b", 1.0, "C", [], ["c"], 900, None)], "name string, carnivore_score double, carnivore_rank string, genres array<string>, sources array<string>, budget_lunch int, budget_dinner int")
    for c in ("address", "lat", "lng", "rating", "review_count", "url", "notes"):
        stores = stores.withColumn(c, F.lit(None).cast("string"))
    path = str(tmp_path / "e.csv")
    assert files.export(stores, path, "now", ["S", "A"]) == {"exported": 1, "total": 2}
    text = open(path, encoding="utf-8").read()
    assert text.startswith('# generated_at_utc=now\n# source_scope=a,b\n# total_records=1\nname,') and '"焼肉, x"' in text and '"a, b"' in text and text.endswith(",,3000,3000\n")
    assert {r["avg_dinner_budget"] for r in files.export_rows(stores).collect()} == {3000, 900}
    files.rewrite(path, stores.select("name"), {"v": "2"})
    files.rewrite(path, stores.select("name").limit(0), {"v": "3"})
    assert open(path + ".bak", encoding="utf-8").read() == text and open(path, encoding="utf-8").read() == "# v=3\nname\n"
    files.write_list(path, stores.select("name").where("name = 'a'"), "lng < 136.9")
    assert open(path, encoding="utf-8").read() == "# condition=lng < 136.9\nname\na\n"
    assert files.summary(spark.createDataFrame([(1, 2)], "a int, b int")) == "a=1\nb=2\n"

    def step():
        files.write_atomic(path, "new")
        raise RuntimeError("check failed")

    with pytest.raises(RuntimeError):
        files.publish_in_steps(path, [step])
    assert open(path, encoding="utf-8").read() == "# condition=lng < 136.9\nname\na\n"
    files.publish_in_steps(path, [lambda: files.write_atomic(path, "new")])
    assert open(path, encoding="utf-8").read() == "new"
