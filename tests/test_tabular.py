import csv
import os
import random
import zipfile

import pytest
from cairn.sources import files, tabular


def test_round_trip_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choices('a,"\n#é ', k=rng.randint(0, 6))).strip() or "#x", rng.choice(["b", "a, c", ""]), rng.choice([None, 1.5, 2.0])) for i in range(500)]
    df = spark.createDataFrame(rows, "i long, name string, sources string, v double").repartitionByRange(5, "i").sortWithinPartitions("i")
    path = str(tmp_path / "out.csv")
    tabular.write(df, path, {"made": "now", "total_records": None, "source_scope": None})
    text = open(path, encoding="utf-8", newline="").read()
    assert text.startswith("# made=now\n# total_records=500\n# source_scope=a,b,c\ni,name,sources,v\n")
    assert list(csv.reader(text.split("\n", 3)[3].splitlines(keepends=True)))[1:] == [[str(i), n, s, "" if v is None else str(v)] for i, n, s, v in rows]
    back = files.read_csv(spark, path, ("name", "v"))
    assert back.columns == df.columns and sorted((int(r["i"]), r["name"]) for r in back.collect()) == [(i, n) for i, n, *_ in rows]
    assert os.listdir(tmp_path) == ["out.csv"] and files.csv_metadata(spark, path)["total_records"] == "500"


def test_abort_leaves_the_old_file(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    tabular.write(spark.createDataFrame([("old",)], "name string"), path, {})
    os.chmod(path, 0o600)
    bad = spark.createDataFrame([(f"n{i}",) for i in range(50)] + [("seen on TABELOG",)], "name string").repartition(4)
    with pytest.raises(Exception, match="must not be published"):
        tabular.write(bad, path, {}, never=("tabelog",))
    assert open(path).read() == "name\nold\n" and os.listdir(tmp_path) == ["out.csv"]
    tabular.write(bad, path, {"k": "v"})
    assert open(path).read().startswith("# k=v\nname\n") and os.stat(path).st_mode & 0o777 == 0o600
    tabular.write(bad.limit(0), path, {"total_records": None})
    assert open(path).read() == "# total_records=0\nname\n" and files.read_csv(spark, path).count() == 0


def test_strict_and_lax(spark, tmp_path):
    def read(text, **options):
        path = tmp_path / f"{len(os.listdir(tmp_path))}.csv"
        path.write_text(text, encoding="utf-8")
        return [tuple(r) for r in files.read_csv(spark, str(path), **options).collect()]

    head = "﻿# a=1\n#b\n"
    assert read(head + 'name,url\n#1 shop,u\n\n"x, ""y""\n#z", 　u \nq\n') == [("#1 shop", "u"), ('x, "y"\n#z', "u"), ("q", "")]
    assert read(head + "name,url\n#1 shop,u\nq,r,s\n", strict=False) == [("q", "r")]
    for text, said in (("name,url\nq,r,s\n", "more values"), ("name,url\n ,r\n", "no name")):
        with pytest.raises(Exception, match=said):
            read(head + text)
    with pytest.raises(ValueError, match="missing columns: lat"):
        read("name\nx\n", required=("name", "lat"))
    with pytest.raises(ValueError, match="no header"):
        read("# only\n")


def test_members_are_read_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "g.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"d/{k}.csv", "市区町村名,大字町丁目名,緯度,経度\n" + "".join(f"区{k},町{i},35.{i},139\n" for i in range(40)))
        z.writestr("d/readme.txt", "no")
    got = files.gazetteer(spark, str(tmp_path / "g.zip"), ".csv", files.DISTRICTS, "utf-8")
    assert got.count() == 120 and got.select("seq.member").distinct().count() == 3
    assert tabular.records(spark, str(tmp_path / "none.zip")).count() == 0
