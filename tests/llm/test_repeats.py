import hashlib
import random

import pytest
from pyspark.sql import functions as F

from cairn.llm import repeats


def data():
    rng = random.Random(9)
    say = lambda n: "".join(rng.choices("abcdefgh é\n", k=n))
    passage, other = say(900), say(420)
    rows = [say(rng.randint(0, 700)) + passage[rng.randint(0, 200) : rng.randint(650, 900)] + say(rng.randint(0, 500)) for _ in range(15)]
    rows += [other, "x" + other, say(300), "a" * 1500, "ab" * 700 + say(500), say(50) + "a" * 420, None, "", "short"]
    near = list(say(1800))
    for _ in range(8):
        near[rng.randrange(len(near))] = "Z"
        rows.append("".join(near))
    return [*rows, rows[0], rows[3], say(600) * 2]


@pytest.mark.parametrize(("crowded", "rows_"), [(20_000, 4096), (20_000, 4), (3, 4096)])
def test_against_brute_force(spark, monkeypatch, crowded, rows_):
    monkeypatch.setattr(repeats, "ROWS", rows_)
    monkeypatch.setattr(repeats, "HOT", rows_ // 4)
    texts = data()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, key string")
    import hashlib

    got = {r["doc_id"]: r["repeats"] for r in repeats.remove(docs, crowded).collect()}
    for i, want in enumerate(repeats.brute_force(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], hashlib.sha256(bytes(got[i]["kept"])).hexdigest()) == want, i


def test_chunks_and_empty(spark, monkeypatch):
    data_ = bytes(random.Random(1).choices(b"abcd", k=9000)) + b"q" * 900
    whole = repeats.anchors(data_)
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    for a, b in zip(whole, repeats.anchors(data_), strict=True):
        assert len(a) == len(b)
    assert (whole[0] == repeats.anchors(data_)[0]).all()
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "t" * 900, "a", "b", "c"), (None, None, None, None, None)], "doc_id long, text string, __key string, __more string, __r string")
    got = {r["doc_id"]: r for r in repeats.remove(docs).collect()}
    assert (got[1]["__key"], got[1]["__more"], got[1]["__r"], got[1]["repeats"]["n_removed"]) == ("a", "b", "c", 900) and got[None]["repeats"]["n_bytes"] == 0


def test_crowds_are_dealt(spark, monkeypatch):
    """Segments of one gram meet in no task, those of crowded grams lie in several parts, hot strings meet in several tasks."""
    rng = random.Random(4)
    say = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = say(420)
    texts = [say(390) + passage + say(390) for _ in range(60)]
    for name, value in (("DEALT", 10), ("HOT", 5)):
        monkeypatch.setattr(repeats, name, value, raising=False)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {name: spark.conf.get(name) for name in settings}
    most, parts, real_cut, real_strings = [], [], repeats.common.cut, repeats.strings

    def cut(df, held=None):
        if "k" in df.columns and "key" in df.columns:
            counts = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
            most.append((max(counts), sum(counts)))
        return real_cut(df, held)

    def strings(found, asked=None):
        parts.append(len(found.inputFiles()))
        return real_strings(found, asked)

    monkeypatch.setattr(repeats.common, "cut", cut)
    monkeypatch.setattr(repeats, "strings", strings)
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        got = {r["doc_id"]: r["repeats"] for r in repeats.remove(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 20).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    for i, want in enumerate(repeats.brute_force(texts)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], hashlib.sha256(bytes(got[i]["kept"])).hexdigest()) == want, i
    (largest, total), = most
    assert total >= 60 and 2 * largest < total
    assert len(parts) == 2 and min(parts) >= 3
