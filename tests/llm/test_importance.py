import random

import numpy as np
from cairn.llm import importance


def data():
    rng = random.Random(11)
    vocabulary = ["aa", "Bb", "cc", "é1", "dd", "ee", "ff", "Über", "x" * 70]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    docs = [(i, say(rng.choice([0, 1, 2, 19, 20, 21, 60]))) for i in range(120)] + [(200, None), (201, ""), (202, ".,!"), (203, "aa " * 30000), (None, say(40)), (5, say(30))]
    docs.append(docs[5])
    return docs, [say(25), None, "", "aa bb"]


def compared(spark, docs, target):
    d = spark.createDataFrame([(*r, "kept", 1) for r in docs], "doc_id long, text string, importance_ string, __at int").repartition(3)
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.ranked(importance.scored(d, t), "importance.n_words >= 20")
    assert set(d.columns) < set(got.columns)
    rows = [(r["doc_id"], r["importance"]["n_features"], r["importance"]["weight"], r["score"], r["rank"]) for r in got.collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(rows, key=key) == sorted(importance.brute_force(docs, target), key=key)
    return rows


def test_against_brute_force(spark):
    docs, target = data()
    rows = compared(spark, docs, target)
    n = sum(r["n"] for r in [{"n": 1} for i, t in docs if len((t or "").replace(".,!", "").split()) >= 20])
    assert sorted(r[4] for r in rows if r[4]) == [*range(1, 25 * n // 100 + 1)]
    compared(spark, docs[:7], [])
    assert compared(spark, [], target) == []


def test_resample_keeps_rows(spark):
    docs, target = data()
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string")).collect()
    assert got and {(r["doc_id"], r["text"]) for r in got} <= {*docs}


def test_runs_of_the_suffix_array():
    rng = np.random.default_rng(2)
    for depth in (1, 2, 3, 4):
        ids = np.append(rng.integers(0, 4, 300), 0)
        order, words, shared = importance.suffixes(ids, depth)
        said = lambda i: tuple(int(w[i]) for w in words)
        whole = [said(i) for i in order]
        assert whole == sorted(whole) and sorted(order.tolist()) == [*range(len(ids))]
        for a, b, n in zip(whole, whole[1:], shared[1:], strict=False):
            assert n == next((k for k in range(depth) if a[k] != b[k] or a[k] == 0), depth)
