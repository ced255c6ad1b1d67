from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from cairn.operators import publish

U = "https://www.hotpepper.jp/strJ{:03d}/"
L = "legacy_{:020x}"
POINT = {"lat": "35.680000", "lng": "139.760000"}


def table(spark, rows, extra=()):
    columns = ["row", *publish.OUTPUT_COLUMNS, "tabelog_url", *extra]
    return spark.createDataFrame([tuple({"row": i, **POINT, "address": "somewhere 1", **r}.get(c, "") for c in columns) for i, r in enumerate(rows)], "row int, " + ", ".join(f"{c} string" for c in columns[1:]))


def fresh(n, **more):
    return {"name": f"shop {n}", "sources": "hotpepper", "url": U.format(n), **more}


def old(n, **more):
    return {"name": f"shop {n}", "sources": "legacy_local", "legacy_id": L.format(n), **more}


def merged(spark, current, legacy, radius=50.0):
    return publish.merge(table(spark, current), table(spark, legacy), "2026-07-16", "2026-01-02", radius)


def rows_of(m):
    return [r.asDict() for r in m.rows.collect()]


def test_same_id_and_retained_rows(spark):
    m = merged(spark, [fresh(1, genre="new", budget_dinner="4000.7")], [fresh(1, genre="old", notes="kept", dinner_budget_min="3000", last_verified_at="2025-05-05"), fresh(2, name="gone")])
    got = {r["name"]: r for r in rows_of(m)}
    one, gone = got["shop 1"], got["gone"]
    assert (one["genre"], one["notes"], one["dinner_budget_min"], one["budget_dinner"], one["how"], one["data_status"], one["last_verified_at"]) == ("new", "kept", "3000", "4000", "exact", "current", "2026-07-16")
    assert (gone["how"], gone["data_status"], gone["last_verified_at"], gone["url"], gone["sources"]) == ("retained", "legacy_unverified", "2026-01-02", U.format(2), "hotpepper")
    stats = m.stats.first().asDict()
    assert (stats["current_input"], stats["legacy_input"], stats["hotpepper_id_updates"], stats["output_rows"]) == (1, 2, 1, 2)
    assert m.problems.count() == 0


def test_migration_and_mixed_lineage(spark):
    legacy = [{"name": "a b", "address": "x 1", "sources": "tabelog", "url": "https://tabelog.com/x/1/"}, old(7, sources="hotpepper,legacy_local", url=U.format(7))]
    got = {r["name"]: r for r in rows_of(merged(spark, [], legacy))}
    assert got["a b"]["legacy_id"].startswith("legacy_") and got["a b"]["url"] == "" and got["a b"]["sources"] == "legacy_local"
    assert got["shop 7"]["sources"] == "hotpepper,legacy_local" and got["shop 7"]["legacy_id"] == L.format(7)
    again = rows_of(merged(spark, [], [{k: v for k, v in r.items() if k in publish.OUTPUT_COLUMNS} for r in got.values()]))
    assert sorted((r["name"], r["legacy_id"]) for r in again) == sorted((r["name"], r["legacy_id"]) for r in got.values())


def test_proximity(spark):
    near = {"lat": "35.680010"}
    m = merged(spark, [fresh(1)], [old(5, name="Shop 1", **near)])
    assert [(r["how"], r["legacy_id"], r["sources"]) for r in rows_of(m)] == [("cross", L.format(5), "hotpepper,legacy_local")]
    m = merged(spark, [fresh(1)], [old(5, name="Shop 1", **near), old(6, name="shop  1", lat="35.680020")])
    assert len(rows_of(m)) == 3 and m.stats.first()["ambiguous_cross_source_candidates"] == 2
    # A reissued id, and no second old id for a row that has one.
    m = merged(spark, [fresh(1), fresh(9, name="shop 2", **near)], [fresh(1), fresh(2), old(3, name="shop 1", lat="35.680030")])
    assert sorted((r["how"], r["url"]) for r in rows_of(m)) == [("cross", U.format(1)), ("reissued", U.format(9))]
    m = merged(spark, [fresh(1)], [fresh(1, legacy_id=L.format(1), sources="hotpepper,legacy_local"), old(2, name="shop 1")])
    assert sorted(r["legacy_id"] for r in rows_of(m)) == [L.format(1), L.format(2)]


def test_budgets_and_order(spark):
    m = merged(spark, [fresh(1, name="b", budget_lunch="30004000", budget_dinner="x", avg_dinner_budget="2000"), fresh(2, name="A")], [])
    assert [(r["name"], r["budget_lunch"], r["budget_dinner"], r["avg_dinner_budget"]) for r in rows_of(m)] == [("A", "", "", ""), ("b", "", "", "2000")]
    assert m.stats.first()["sanitized_budget_values"] == 2


def test_problems_are_rows(spark):
    current = [fresh(1, url="http://www.hotpepper.jp/strJ001/"), fresh(2), fresh(3, url=U.format(2)), fresh(4, lat="x"), fresh(5, lng="10")]
    legacy = [old(1, sources="elsewhere"), old(2, legacy_id="bad"), {"name": "n", "sources": "legacy_local"}, {"name": "", "sources": "tabelog"}, {"name": "n", "sources": "hotpepper"}, old(6), old(6, name="again"), fresh(8), fresh(8)]
    m = merged(spark, current, legacy)
    got = sorted((r["side"], r["row"], r["rule"]) for r in m.problems.collect())
    assert [x for x in got if x[0] == "current"] == [("current", 0, "E3.url"), ("current", 2, "W10.id"), ("current", 3, "W2"), ("current", 4, "W2")]
    assert {x[1:] for x in got if x[0] == "legacy"} == {(0, "E3.sources"), (1, "E3.legacy_id"), (1, "E3.lineage"), (2, "E3.legacy_id"), (2, "E3.lineage"), (3, "E3.attributes"), (4, "E3.url"), (4, "E3.lineage"), (6, "W10.legacy_id"), (8, "W10.id")}
    assert sorted(r["name"] for r in rows_of(m)) == ["shop 2", "shop 6", "shop 8"]
    with pytest.raises(ValueError, match="radius"):
        merged(spark, [], [], 0)


def test_merge_is_idempotent(spark):
    legacy = [fresh(1), old(5, name="shop 1", lat="35.680010"), old(6), fresh(3, name="gone")]
    keep = lambda m: [{k: v for k, v in r.items() if k in publish.OUTPUT_COLUMNS} for r in rows_of(m)]
    once = keep(merged(spark, [fresh(1), fresh(2)], legacy))
    assert keep(merged(spark, [fresh(1), fresh(2)], once)) == once and len(once) == 4


def test_checks_of_merged_rows(spark):
    good = {**fresh(1), "hotpepper_url": U.format(1), "data_status": "current", "last_verified_at": "2026-01-01"}
    lone = {**old(2), "data_status": "legacy_unverified", "last_verified_at": "2026-01-01"}
    bad = [(good, set()), (lone, set()), ({**lone, "legacy_id": L.format(3), "notes": "from Tabelog"}, {"W1"}), ({**lone, "legacy_id": L.format(4), "lat": "nan"}, {"W2"}), ({**lone, "legacy_id": L.format(5), "sources": "hotpepper"}, {"W3"}), ({**lone, "legacy_id": L.format(6), "url": "u"}, {"W4"}), ({**good}, {"W5"}), ({**lone}, {"W6"}), ({**lone, "legacy_id": L.format(7), "data_status": "?"}, {"W7"}), ({**lone, "legacy_id": L.format(8), "data_status": "current"}, {"W8"}), ({**lone, "legacy_id": L.format(9), "last_verified_at": "2026"}, {"W9"})]
    got = {}
    for r in publish.merged_problems(table(spark, [b for b, _ in bad])).collect():
        got.setdefault(r["row"], set()).add(r["rule"])
    assert [got.get(i, set()) for i in range(len(bad))] == [w for _, w in bad]
    published = {}
    for r in publish.row_problems(table(spark, [b for b, _ in bad]), F.lit("2026-07-01").cast("date")).collect():
        published.setdefault(r["row"], set()).add(r["rule"])
    assert published == {3: {"V5"}, 4: {"V6", "V11", "V12"}, 5: {"V13"}, 6: {"V8"}, 7: {"V10.repeated"}, 8: {"V14"}, 9: {"V15"}, 10: {"V16"}}


def test_checks_of_a_whole_set(spark):
    good = {**fresh(1), "hotpepper_url": U.format(1), "data_status": "current", "last_verified_at": "2026-01-01"}
    lone = {**old(2), "data_status": "legacy_unverified", "last_verified_at": "2026-01-01"}
    now = datetime(2026, 7, 1, tzinfo=timezone.utc)
    meta = publish.output_metadata(2, "2026-06-20T00:00:00+00:00", "2026-06-20", "2026-01-01")
    assert [*meta] == ["generated_at_utc", "source_scope", "current_snapshot_at", "legacy_snapshot_at", "match_radius_meters", "total_records"] and meta["match_radius_meters"] == "50"
    broken = lambda rows, m, **o: {r["rule"] for r in publish.dataset_problems(table(spark, rows), m, now, **o).collect() if r["broken"]}
    assert broken([good, lone], meta, minimum=2, minimum_legacy=1) == set()
    assert broken([good, lone], meta) == {"V19", "V20"}
    assert broken([good, {**good, "notes": "食べログ"}], {}, size_bytes=6 << 20, minimum=2, minimum_legacy=0) == {"V18", "V21.legacy_local", "V21.legacy_unverified", "V22", "V23.current_snapshot_at", "V23.legacy_snapshot_at", "V24", "V25.size", "V25.token"}
    assert broken([good, lone], meta | {"generated_at_utc": "2026-05-01T00:00:00Z", "total_records": "3", "current_snapshot_at": "2026-12-01"}, minimum=0, minimum_legacy=0) == {"V18", "V23.current_snapshot_at", "V24.age"}
    assert publish.missing_columns(table(spark, [good])) == [] and publish.missing_columns(table(spark, [good]).drop("url")) == ["url"]


def test_options_and_dates():
    assert publish.check_options(50, 0, "2026-01-01T00:00:00Z", "a", "b") == []
    assert len(publish.check_options(0, -1, "2026-01-01T00:00:00", "a", "a")) == 4 and len(publish.check_options(1, 0, "soon")) == 1
    assert publish.metadata_date({"generated_at_utc": "2026-07-16"}) == "2026-07-16" and publish.metadata_date({"k": "2026-07-16T23:00:00Z"}, "k") == "2026-07-16"
    with pytest.raises(ValueError):
        publish.metadata_date({})
    assert publish.count_problem(5, 4, 3) == [] and publish.count_problem(5, 6, 3)


def test_candidates_are_counted_not_paired(spark, monkeypatch):
    made, pairs = [], publish.match.near_pairs

    def counted(*sides):
        made.append(pairs(*sides).count())
        return pairs(*sides)

    monkeypatch.setattr(publish.match, "near_pairs", counted)
    many = lambda first, n, make: [make(first + k, name="Chain", lat=f"35.68{k % 3}") for k in range(n)]
    lone = {"name": "lone", "lat": "35.7"}
    m = merged(spark, [*many(0, 30, fresh), fresh(900, **lone), fresh(902, name="other")], [*many(100, 40, fresh), *many(200, 20, old), fresh(901, **lone), old(302, name="other")])
    how = [r["how"] for r in rows_of(m)]
    assert {h: how.count(h) for h in how} == {"new": 30, "retained": 40, "legacy_only": 20, "reissued": 1, "cross": 1}
    # Places of a third of the rows each are 111 m apart.
    stats = m.stats.first()
    third = lambda n, k: len(range(k, n, 3))
    assert stats["ambiguous_reissue_candidates"] == sum(third(30, k) * third(40, k) for k in range(3))
    assert stats["ambiguous_cross_source_candidates"] == sum((third(30, k) + third(40, k)) * third(20, k) for k in range(3))
    assert made == [1, 1]


def test_repeats_are_merged(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "")], "row int, v string")
    got = publish.later_repeats(rows, "v", "x")
    assert [tuple(r) for r in got.collect()] == [(2, "x")]
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
