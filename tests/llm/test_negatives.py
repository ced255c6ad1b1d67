import math
import random

import pytest
from cairn.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, qid string, cell int"


def rows_of(rng, n, width, labels, spread):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(9)]
    out = []
    for i in range(n):
        v = rng.choice(out)[2] if out and rng.random() < 0.15 else [c + rng.gauss(0, spread) for c in rng.choice(centres)]
        out.append((i * 3 - 40, rng.randrange(labels), v))
    return out


def compared(spark, rows, anchors, **kwargs):
    d = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA).repartition(3)
    whole = negatives.usable(d, "embedding")
    got = sorted(map(tuple, negatives.mine(whole, f"vec_id in ({','.join(map(str, anchors))})", **kwargs).collect()))
    plain = {(r["vec_id"], r["label"], tuple(r["vector"])) for r in whole.collect()}
    assert got == negatives.brute_force([(i, x, list(v)) for i, x, v in sorted(plain)], {*anchors})
    return got


@pytest.mark.parametrize(("n", "width", "labels", "spread", "first"), [(1500, 6, 3, 0.2, 4), (600, 3, 10, 0.05, 32), (300, 40, 2, 1.0, 4), (40, 2, 9, 0.1, 1024)])
def test_against_every_product(spark, n, width, labels, spread, first):
    rng = random.Random(n)
    rows = rows_of(rng, n, width, labels, spread)
    rows += [rows[3], rows[3], (9001, None, rows[0][2]), (9002, 1, None), (None, 1, rows[0][2]), (9003, 1, [*rows[0][2][1:], math.nan]), (9004, 1, [*rows[0][2][1:], None]), (9005, 1, [*rows[0][2][1:], math.inf]), (9006, 1, [0.0] * width), (9007, 0, [0.0] * width), (9008, 1, rows[0][2][:1]), (9009, 0, [])]
    anchors = [r[0] for r in rng.sample(rows[:n], min(25, n))] + [9001, 9002, 9006, 9008, 9009]
    assert compared(spark, rows, anchors, first_rows=first)


def test_many_copies_and_ties(spark):
    rows = [(i, i % 3, [1.0, 0.0] if i % 2 else [0.6, 0.1]) for i in range(400)] + [(1000 + i, 7, [0.1 * (i % 4), 0.5]) for i in range(30)]
    got = compared(spark, rows, [0, 1, 399, 1000], first_rows=2)
    assert {r[0] for r in got} >= {0, 1, 399}


def test_nothing(spark):
    assert compared(spark, [], [1]) == [] and compared(spark, [(1, 1, [1.0])], [1]) == [] and compared(spark, [(1, 1, [1.0]), (2, 1, [1.0])], [1]) == []
    with pytest.raises(ValueError, match="exact"):
        compared(spark, [(1, 1, [1e9]), (2, 1, [1.0])], [1])


def test_packs_are_not_broadcast(spark, monkeypatch):
    plans, cut = [], negatives.common.cut

    def noted(df, *args):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df, *args)

    monkeypatch.setattr(negatives.common, "cut", noted)
    rng = random.Random(5)
    assert compared(spark, rows_of(rng, 200, 4, 3, 0.2), range(-40, 560, 60))
    scans = [p for p in plans if "MapInPandas scan" in p]
    assert scans and not any("BroadcastExchange" in p for p in scans)
