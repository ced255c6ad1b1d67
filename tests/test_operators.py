import random

import pytest
from pyspark.sql import functions as F

from cairn import registry
from cairn.operators import match, score, snapshot
from cairn.sources import files


def plain_fold(rows):
    stores = []
    for seq, _, _, name, phone, lat, lng, _, _ in rows:
        p = "".join(c for c in phone or "" if c.isdigit()) or None
        n = "".join((name or "").split()).lower() or None
        for s in stores:
            if p and p == s["p"] or n and n == s["n"] and match._metres({"lat": lat, "lng": lng}, s) <= 150:
                s["seqs"].append(seq)
                s["p"] = s["p"] or p
                if (s["lat"] == 0 or s["lng"] == 0) and lat and lng:
                    s["lat"], s["lng"] = lat, lng
                break
        else:
            stores.append({"p": p, "n": n, "lat": lat, "lng": lng, "seqs": [seq]})
    return sorted(s["seqs"] for s in stores)


def test_greedy_merge_equals_a_plain_fold(spark):
    schema = "seq long, source string, external_id string, name string, phone string, lat double, lng double, url string, genres array<string>"
    for seed, steps, zeros in ((4, 4, 0.0), (5, 40, 0.15), (6, 400, 0.3)):
        rng = random.Random(seed)
        at = lambda: (0.0, 0.0) if rng.random() < zeros else (None, 139.0) if rng.random() < 0.05 else (35 + rng.randrange(steps) / 1000, 139.0 + rng.randrange(3) / 1000)  # noqa: B023, E731
        phones = [None, None, "03-1", "03-2", "0 3 1", *(f"9{k}" for k in range(steps // 4))]
        rows = [(i, "api", str(i), rng.choice(["a b", "AB", "c", "d", None]), rng.choice(phones), *at(), rng.choice([None, "u"]), [rng.choice("xyz")]) for i in range(150)]
        got = match.greedy_merge(spark.createDataFrame(rows, schema))
        assert sorted(r["seqs"] for r in got.collect()) == plain_fold(rows)


def test_stores_of_a_chain_are_apart(spark):
    rows = [(i, None if i % 9 else f"0{i}", "chain", 30 + i / 100, 139.0) for i in range(400)] + [(1000, None, "chain", 0.0, 0.0), (1001, "7", "other", 0.0, 0.0), (1002, "7", "other", 35.0, 139.0), (1003, None, "other", 35.0, 139.0)]
    bound = match._bound(spark.createDataFrame(rows, "seq long, p string, n string, lat double, lng double"), 150)
    sizes = sorted(r["count"] for r in match.components(bound).groupBy("label").count().collect())
    assert sizes == [1] * 401 + [3]


def test_fusion_of_records(spark):
    schema = "seq long, source string, external_id string, name string, phone string, lat double, lng double, url string, genres array<string>, address string, description string, rating double, review_count long, budget_lunch long, budget_dinner long"
    rows = [
        (1, "a", "1", "Shop", None, 0.0, 139.0, "", ["x", "y"], None, "", None, None, None, 900),
        (2, "a", "2", "Other", "03-1", 35.0, 139.0, "u", ["y", "z"], "here", "told", 4.0, 7, 800, 1000),
        (3, "b", "3", "s hop", "03-1", 0.0, 139.0, None, None, None, None, None, None, None, None),
        (4, "b", "4", "New", "-", 35.0, 139.0, None, ["x"], None, None, None, None, None, None),
        (5, "b", "5", "new", "03-9", 35.0, 139.0, None, ["x"], None, None, None, None, None, None),
        (6, "c", "6", "Fresh", "03-9", 36.0, 140.0, None, ["x"], None, None, None, None, None, None),
    ]
    got = {r["store_id"]: r for r in match.greedy_merge(spark.createDataFrame(rows, schema)).collect()}
    # 3 has the name of 1 and the phone of 2: the first store counts, and takes the phone. A phone without digits stays.
    assert {k: r["seqs"] for k, r in got.items()} == {"a:1": [1, 3], "a:2": [2], "b:4": [4, 5], "c:6": [6]}
    one = got["a:1"]
    assert (one["name"], one["phone"], one["description"], one["budget_dinner"], one["sources"], one["external_ids"], one["genres"]) == ("Shop", "03-1", "", 900, ["a", "b"], {"a": "1", "b": "3"}, ["x", "y"])
    assert got["b:4"]["phone"] == "-" and got["a:2"]["rating"] == 4.0 and got["a:2"]["review_count"] == 7
    more = match.greedy_merge(spark.createDataFrame([rows[1], (7, "b", "7", "Third", "031", 36.0, 140.0, "v", ["q"], "there", "x", 1.0, 1, 1, 1), (8, "a", "8", "Zero", "03 1", 0.0, 0.0, None, [], None, None, None, None, None, None)], schema)).collect()
    assert [(r["seqs"], r["genres"], r["url"], r["lat"], r["external_ids"]) for r in more] == [([2, 7, 8], ["y", "z", "q"], "u", 35.0, {"a": "2", "b": "7"})]
    assert "rating" in match.greedy_merge(spark.createDataFrame(rows, schema).select("seq", "source", "external_id", "name", "lat", "lng", "genres")).columns


def test_distance_pairs_against_all(spark):
    rng = random.Random(2)
    pts = [(i, 35 + rng.random() / 100, 139 + rng.random() / 100) for i in range(120)] + [(200, None, 139.0), (201, float("nan"), 139.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lng double")
    want = {(a[0], b[0]) for a in pts[:120] for b in pts[:120] if a[0] < b[0] and match._metres({"lat": a[1], "lng": a[2]}, {"lat": b[1], "lng": b[2]}) <= 90}
    assert {(r["a"], r["b"]) for r in match.distance_pairs(df, 90).collect()} == want and want


def test_distance_pairs_all_over_the_globe(spark):
    rng = random.Random(5)
    pts = []
    for lat, lng in ((70, 20), (-80, 179.99), (89.9, 0), (0, 180), (45, -179.995)):
        pts += [(len(pts) + i, max(-90.0, min(90.0, lat + rng.uniform(-0.02, 0.02))), (lng + rng.uniform(-0.05, 0.05) + 180) % 360 - 180) for i in range(40)]
    pts += [(len(pts) + i, 90.0 - i / 1000, lng) for i, lng in enumerate((-170.0, 10.0, 100.0))]
    df = spark.createDataFrame(pts, "id long, lat double, lng double")
    for radius in (1000, 60):
        want = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and match._metres({"lat": a[1], "lng": a[2]}, {"lat": b[1], "lng": b[2]}) <= radius}
        got = [(r["a"], r["b"]) for r in match.distance_pairs(df, radius).collect()]
        assert len(got) == len({*got}) and {*got} == want and want
    named = df.selectExpr("id", "id % 3 as key", "lat", "lng")
    got = {(r["l_id"], r["r_id"]) for r in match.near_pairs(named.where("id % 2 = 0"), named.where("id % 2 = 1"), 1000).collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if a[0] % 2 == 0 and b[0] % 2 == 1 and a[0] % 3 == b[0] % 3 and match._metres({"lat": a[1], "lng": a[2]}, {"lat": b[1], "lng": b[2]}) <= 1000}


def test_clusters_against_pairs(spark):
    rng = random.Random(8)
    pts = [(i, "".join(rng.choices("abcd", k=rng.randint(1, 6))), 35 + rng.random() / 200, 139 + rng.random() / 200) for i in range(80)]

    def merge(pairs):
        label = {p[0]: p[0] for p in pts}
        while True:
            old = dict(label)
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
            if old == label:
                return label

    near = merge([(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and match._metres({"lat": a[2], "lng": a[3]}, {"lat": b[2], "lng": b[3]}) <= 60])
    grams = {p[0]: {p[1][i : i + 3] for i in range(len(p[1]) - 2)} for p in pts}
    alike = [(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and near[a[0]] == near[b[0]] and grams[a[0]] & grams[b[0]]]
    label = merge(alike)
    want = {(i, label[i]) for pair in alike for i in pair}
    df = spark.createDataFrame(pts, "id long, name_key string, lat double, lng double")
    found = match.duplicate_clusters(df, 60, 3)
    assert {(r["id"], r["cluster"]) for r in found.collect()} == want and want
    report = match.cluster_report(df, found, ["name_key"]).collect()
    assert sum(r["size"] for r in report) == len(want) and all(r["name_keys"].count(" | ") == r["size"] - 1 for r in report)


def test_one_to_one_leaves_ambiguous_pairs(spark):
    side = lambda rows: spark.createDataFrame(rows, "id long, key string, lat double, lng double")
    left, right = side([(1, "a", 35.0, 139.0), (2, "b", 35.0, 139.0), (3, None, 35.0, 139.0)]), side([(11, "a", 35.00001, 139.0), (12, "b", 35.0, 139.0), (13, "b", 35.00002, 139.0), (14, None, 35.0, 139.0)])
    assert [(r["l_id"], r["r_id"]) for r in match.one_to_one(left, right, 50).collect()] == [(1, 11)]


def test_scores(spark):
    df = spark.createDataFrame([(["焼肉", "ホルモン"], "食べ放題 アメリカンBBQ", 4.0, 1000), (None, None, None, None)], "g array<string>, t string, r double, n int")
    got = [r["s"] for r in df.select(score.score(F.col("g"), F.col("t"), F.col("r"), F.col("n")).alias("s")).collect()]
    assert got == [100.0, 0.0]
    ranks = spark.createDataFrame([(80.0,), (60.0,), (45.0,), (44.9,)], "s double").select(score.rank(F.col("s")).alias("r")).collect()
    assert [r["r"] for r in ranks] == ["S", "A", "B", "C"]
    assert [bool(r[0]) for r in spark.createDataFrame([("お好み焼 x", ""), ("a", None), (None, "もんじゃ")], "a string, b string").select(score.excluded(F.col("a"), F.col("b"))).collect()] == [True, False, True]
    noted = spark.createDataFrame([("t", ["a"]), ("", ["a", "b", "c"]), (None, ["a"]), (None, []), (None, None)], "t string, g array<string>").select(score.notes(F.col("t"), F.col("g"))).collect()
    assert [r[0] for r in noted] == ["t", "主ジャンル: a, b", "主ジャンル: a", None, None]


def test_files(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('# total_records=2\n# note = a=b\nname,url\n"x, ""y""\nz", u \nq,\n', encoding="utf-8")
    assert files.csv_metadata(spark, str(path)) == {"total_records": "2", "note": "a=b"}
    rows = files.read_csv(spark, str(path), ("name",))
    assert [tuple(r) for r in rows.collect()] == [('x, "y"\nz', "u"), ("q", "")]
    with pytest.raises(ValueError, match="missing"):
        files.read_csv(spark, str(path), ("nope",))
    out = tmp_path / "b.csv"
    files.publish(rows, str(out), {"k": "v"}, lambda d: d.where("name = ''"))
    assert out.read_text().startswith("# k=v\nname,url\n")
    with pytest.raises(ValueError, match="not published"):
        files.publish(rows.limit(1), str(out), {}, lambda d: d)
    assert out.read_text().startswith("# k=v\n")
    geo = tmp_path / "g.json"
    geo.write_text('{"features":[{"properties":{"name":"p"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}},{"properties":{"name":"m"},"geometry":{"type":"MultiPolygon","coordinates":[[[[5,5],[6,5],[6,6],[5,5]]],[[[8,8],[9,8],[9,9],[8,8]]]]}}]}')
    assert [(r["name"], [len(p[0]) for p in r["parts"]]) for r in files.polygons(spark, str(geo)).orderBy("seq").collect()] == [("p", [4]), ("m", [4, 4])]
    page = tmp_path / "p.json"
    page.write_text('{"results":{"shop":[{"id":"J1","name":"n","lat":"35.1","genre":{"name":"焼肉"},"budget":{"name":"3001～4000円"},"urls":{"pc":"","sp":"s"},"access":"near"}]}}')
    r = files.shop_pages(spark, str(page)).first()
    assert (r["external_id"], r["lat"], r["lng"], r["genres"], r["budget_dinner"], r["url"], r["description"]) == ("J1", 35.1, 0.0, ["焼肉"], 3500, "s", "near")


def test_union_of_scans(spark):
    scans = spark.createDataFrame([(0, 0, "a", "x"), (0, 1, "a", "y"), (1, 0, "a", "z"), (1, 1, "b", "p"), (1, 2, "b", "q"), (1, 3, "", "r")], "rank int, seq int, id string, v string")
    assert {(r["id"], r["v"]) for r in files.union_scans(scans, "rank", "seq", "id").collect()} == {("a", "y"), ("b", "p")}


def test_public_rules(spark):
    good = {"name": "n", "sources": "hotpepper", "lat": "35.6", "lng": "139.7", "url": "https://hotpepper.jp/strJ1/", "listing_url": "https://hotpepper.jp/strJ1/", "legacy_id": "", "data_status": "current", "last_verified_at": "2026-01-01", "budget_lunch": "", "budget_dinner": "3000", "avg_dinner_budget": ""}
    bad = [({}, set()), ({"name": " "}, {"V2"}), ({"sources": "x"}, {"V3", "V9", "V15"}), ({"lat": "x"}, {"V4"}), ({"lat": "50"}, {"V5"}), ({"listing_url": ""}, {"V6", "V12", "V13"}), ({"legacy_id": "l"}, {"V11", "V12"}), ({"data_status": "?"}, {"V14"}), ({"last_verified_at": "2030-01-01"}, {"V16"}), ({"budget_dinner": "0"}, {"V17"})]
    df = spark.createDataFrame([{"row": i, **good, **b} for i, (b, _) in enumerate(bad)])
    got = {}
    for r in snapshot.violations(df, snapshot.public_rules(F.lit("2026-07-01").cast("date")), "row").collect():
        got.setdefault(r["row"], set()).add(r["rule"])
    assert [got.get(i, set()) for i in range(len(bad))] == [w for _, w in bad]


def test_best_overlaps_against_all_pairs(spark):
    rng = random.Random(12)
    name = lambda: "".join(rng.choices("aab", k=rng.randint(0, 14)))
    rows = [(rng.choice("xyz"), i, name()) for i in range(120)] + [("x", 200, None), ("y", 201, "a" * 40)]
    left, right = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 3 == 0]

    def longest(a, b):
        return max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)

    for compat in (True, False):
        every = sorted(((-longest(a or "", c or ""), x, i, j) for x, i, a in left for y, j, c in right if x == y and (compat or i != j)))
        want = [(x, -s, i, j) for s, x, i, j in every if -s > 3]
        d = [spark.createDataFrame(v, "block string, seq long, name string") for v in (left, right)]
        got = match.block_overlap(*d, 3, None, compat).collect()
        assert sorted((r["block"], r["score"], r["l_seq"], r["r_seq"]) for r in got) == sorted(want)
        for k in (1, 7, 10_000):
            assert [(r["block"], r["score"], r["l_seq"], r["r_seq"]) for r in match.block_overlap(*d, 3, k, compat).collect()] == want[:k]


def test_overlap_of_all_blocks(spark, tmp_path):
    rows = [(k, f"name {k // 2} of {size}", "Brand#1", size) for k, size in enumerate((1, 1, 25, 25, 26, 26, 50, 50))]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = lambda name: sorted(tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).collect())
    assert got("address_block_overlap") == [(0, 1), (2, 3), (4, 5), (6, 7)]


def test_components_of_any_shape(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(45)] + [(400, 400), (500, 500), (500, 501)]
    rng.shuffle(edges)
    label = {n: n for e in edges for n in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    assert {r["node"]: r["label"] for r in match.components(df).collect()} == label
    assert match.components(df.limit(0)).count() == 0


def test_degrees_count_without_pairs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b", None]), 35 + rng.randrange(12) / 500, 139 + rng.randrange(3) / 500) for i in range(160)] + [(900, "a", None, 139.0), (901, "b", 36.0, 139.0), (902, "b", 36.0, 139.0)]
    left, right = [r for r in rows if r[0] % 2 == 0], [r for r in rows if r[0] % 2]
    near = [(a[0], b[0]) for a in left for b in right if a[1] and a[1] == b[1] and match._metres({"lat": a[2], "lng": a[3]}, {"lat": b[2], "lng": b[3]}) <= 230]
    l_n, r_n = ({i: sum(p[k] == i for p in near) for i in {p[k] for p in near}} for k in (0, 1))
    d = [spark.createDataFrame(v, "id long, key string, lat double, lng double") for v in (left, right)]
    assert {r["id"]: r["n"] for r in match.degrees(*d, 230).collect()} == l_n and max(l_n.values()) > 3
    alone = sorted(p for p in near if l_n[p[0]] == r_n[p[1]] == 1)
    assert sorted((r["l_id"], r["r_id"]) for r in match.one_to_one(*d, 230).collect()) == alone and alone
    assert [tuple(r) for r in match.pair_counts(*d, 230).collect()] == [(len(near) - len(alone), len(near))]
    assert [tuple(r) for r in match.pair_counts(d[0].limit(0), d[1], 230).collect()] == [(0, 0)]


def test_pairs_of_crowded_places(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 3)
    rng = random.Random(21)
    pts = [(i, "".join(rng.choices("abc", k=rng.randint(2, 4))), 35 + rng.randrange(6) / 500, 139 + rng.randrange(3) / 500) for i in range(120)] + [(500, "abc", 36.0, 139.0), (501, "abc", 36.5, 139.0), (502, "abc", 36.5, 139.0), (503, "abc", None, 139.0)]
    df = spark.createDataFrame(pts, "id long, name_key string, lat double, lng double")
    near = {(a[0], b[0]) for a in pts for b in pts if a[0] < b[0] and None not in (a[2], b[2]) and match._metres({"lat": a[2], "lng": a[3]}, {"lat": b[2], "lng": b[3]}) <= 230}
    pairs = match.distance_pairs(df, 230)
    got = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(got) == len({*got}) and {*got} == near
    assert "collect_list" in pairs._jdf.queryExecution().executedPlan().toString()  # distances by places, not by pairs of points
    assert {(r["id"], r["cluster"]) for r in match.duplicate_clusters(df, 230, 3).where("id >= 500").collect()} == {(501, 501), (502, 501)}


def test_overlaps_of_equal_names(spark, monkeypatch):
    monkeypatch.setattr(match, "CHUNK", 3)
    rng = random.Random(31)
    rows = [(rng.choice("xy"), i, rng.choice(["abcde", "zabcd", "abcdefg", "bcde", "qqqq", "cd"])) for i in range(90)]
    left, right = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 3 == 0]
    run = lambda a, b: max((n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b), default=0)
    d = [spark.createDataFrame(v, "block string, seq long, name string") for v in (left, right)]
    for compat in (True, False):
        every = [x for x in sorted((-run(a, c), x, i, j) for x, i, a in left for y, j, c in right if x == y and (compat or i != j)) if x[0] < -3]
        got = lambda k: [(-r["score"], r["block"], r["l_seq"], r["r_seq"]) for r in match.block_overlap(*d, 3, k, compat).collect()]  # noqa: B023, E731
        assert sorted(got(None)) == every and all(got(k) == every[:k] for k in (3, 40))
    every = [(x, i, j) for x, i, a in left for y, j, c in right if x == y and run(a, c) > 3]
    names = match.name_pairs(*d, 3)
    assert names.count() <= 2 * 25 < len(every)
    assert [tuple(r)[2:] for r in match.overlap_summary(*d, names).collect()] == [(len({x for x, _, _ in every}), len(every))]


def test_greedy_merge_streams_its_records(spark):
    rows = [(i, "api", str(i), f"n{i % 3}", f"{i % 7}", 35.0, 139.0, ["x"]) for i in range(60)]
    got = match.greedy_merge(spark.createDataFrame(rows, "seq long, source string, external_id string, name string, phone string, lat double, lng double, genres array<string>"))
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()  # which holds a whole component
    assert sorted(r["seqs"] for r in got.collect()) == plain_fold([(i, None, None, n, p, y, x, None, None) for i, _, _, n, p, y, x, _ in rows])


def test_texts_go_to_python_in_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    registry.QUERIES["text_key_strong"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1024
