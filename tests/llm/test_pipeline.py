import random

import corpus_pipeline
from cairn.llm import bpe, common, decontaminate, quality
from tests.llm.test_jaccard import expected
from tests.llm.test_lines import brute_force


def test_run_against_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "pe", "di", "vu", "xo", "ga", "ly")]
    say = lambda n: " ".join(rng.choices(words, k=n)) + "."
    bench = [(i, say(20)) for i in range(4)]
    rows = []
    for i in range(40):
        parts = [say(18) for _ in range(5)]
        if i % 6 == 1:
            parts[2] = bench[i % 4][1]
        if i % 5 == 2:
            parts = [" ".join(w + "###" for w in p.split()) for p in parts]
        if i % 9 == 3:
            parts.append("All rights are kept by us alone and nobody else here.")
        rows.append((i, "\n".join(parts), "en", "s", 1))
    rows += [(60, rows[4][1], "en", "s", 1), (61, rows[5][1].replace("kana", "zzz", 1) + "\n" + say(60), "en", "s", 1), (62, None, None, None, None), (63, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int(i % 5 != 2), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(bench, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    model = quality.fit(docs, labels)
    left = [(d, t) for d, t, *_ in rows if quality.judge(t, model)[-1]]
    assert {d for d, _ in left} >= {i for i in range(40) if i % 5 != 2} and not {d for d, _ in left} & {2, 7, 62, 63}
    rest = brute_force(left)
    left = [(d, rest[d, t]) for d, t in left]
    _, group = expected([(d, t, "") for d, t in left])
    left = [x for k, x in enumerate(left) if not common.words(x[1]) or min(d for (d, _), g in zip(left, group, strict=True) if g == group[k]) == x[0]]
    items = [(str(i), t) for i, t in bench]
    left = [(d, t) for d, t in left if not decontaminate.brute_force(t, items)[4]]
    codec = bpe.codec(*bpe.public())
    want = sorted((d, len(codec.encode_batch([t])[0])) for d, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["n_tokens"]) for r in got.collect()) == want and 0 < len(want) < 40
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns


def test_odd_tables(spark, tmp_path):
    """Empty tables; nulls, repeated rows, a long text, and extra columns whose names the stages use too."""
    rng = random.Random(4)
    say = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    text, long = say(80), "\n".join(say(30) for _ in range(3000))
    rows = [(1, text), (1, text), (2, text), (None, say(90)), (3, None), (4, ""), (5, long), (6, say(70))]
    extra = ["key", "line", "lines", "c", "n", "found", "verdict", "__r", "k"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    docs = spark.createDataFrame([(d, t, None, None, None, *extra) for d, t in rows], schema)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for name, df in (("labels", labels), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now = common.cut(now)
    got = {(r["doc_id"], r["text"], r["lang"], r["key"], r["__r"]) for r in now.collect()}
    assert got == {(d, t, None, "key", "__r") for d, t in {rows[0], (2, ""), rows[3], rows[6], rows[7]}}  # document 2 loses its line, which is document 1's
    assert now.count() == 5 and corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == 5
    now = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
    assert now.count() == 0
