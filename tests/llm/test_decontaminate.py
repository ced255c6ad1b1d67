import random

from cairn.llm import decontaminate


def data():
    rng = random.Random(5)
    vocabulary = ["aa", "Bb", "cc", "é1", "dd", "ee", "ff"]
    say = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(str(i), say(rng.choice([1, 3, 12, 13, 14, 20, 30]))) for i in range(14)] + [("x", None), ("y", ""), ("0", say(15))]
    items = [(k, t) for k, t in items if t is None or len(t.split()) != 1] + [("one", "zz")]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(items)[1] or "", say(rng.randint(0, 40))]
        docs.append((i, "! ".join(parts), "other"))
    return items, [*docs, (100, None, ""), (101, "", ""), (102, "..", ""), (0, docs[0][1], ""), (None, "zz", "")]


def test_against_brute_force(spark):
    items, docs = data()
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string")
    b = spark.createDataFrame(items, "item_id string, text string")
    for threshold in ("10MB", "-1"):  # few windows are broadcast, many are not
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        done = decontaminate.scan(d, b).select("doc_id", "text", "found", decontaminate.n_hit().alias("n"), decontaminate.contaminated().alias("c")).collect()
        assert len(done) == len(docs)
        for r in done:
            n_words, n_hit, n_items, _, bad = decontaminate.brute_force(r["text"], items)
            assert (r["found"]["n_words"], r["n"], len(r["found"]["items"]), r["c"]) == (n_words, n_hit, n_items, bad)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    clean = decontaminate.decontaminate(d, b)
    assert clean.columns == d.columns and clean.count() == sum(not decontaminate.brute_force(t, items)[4] for _, t, _ in docs)
    assert decontaminate.decontaminate(d.limit(0), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(docs)


def test_shared_windows_long_texts_and_clashing_names(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    items = [(k, f"{passage} own{k}", "x") for k in range(40)] + [(99, passage, "y"), (None, passage.upper(), "z")]
    filler = " ".join(f"f{k % 977}" for k in range(60_000))
    docs = [(1, f"a b {passage} c", 1, 2, "k"), (2, f"{filler} {passage} {filler}", 1, 2, "k"), (3, filler, None, 2, "k"), (1, f"a b {passage} c", 1, 2, "k")]
    d = spark.createDataFrame(docs, "doc_id int, text string, __k int, __f int, items string")
    b = spark.createDataFrame(items, "item_id int, text string, found string")
    done = decontaminate.scan(d, b)
    assert done.columns == [*d.columns, "found"]
    said = [("" if k is None else str(k), t) for k, t, _ in items]
    for r in done.withColumn("hit", decontaminate.n_hit()).collect():
        n_words, n_hit, n_items, _, _ = decontaminate.brute_force(r["text"], said) if r["doc_id"] == 1 else (60_000 * (2 if r["doc_id"] == 2 else 1) + (20 if r["doc_id"] == 2 else 0), 20 if r["doc_id"] == 2 else 0, 42 if r["doc_id"] == 2 else 0, None, None)
        assert (r["found"]["n_words"], r["hit"], len(r["found"]["items"]), r["__f"], r["items"]) == (n_words, n_hit, n_items, 2, "k")
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(d, b).collect()) == [2, 3]
    assert decontaminate.decontaminate(d, b).columns == d.columns
