import itertools
import random

import numpy as np

from cairn.llm import quality


def texts():
    rng = random.Random(3)
    for _ in range(150):
        yield "".join(rng.choice(["a ", "bb ", "c#\n", "d|e ", "\n", "\t", "é ", "a bb c ", "\x0b", "x　y "]) for _ in range(rng.randint(0, 90)))


def test_base_against_brute_force():
    for text in [None, "", "\n\n", "a", *texts()]:
        assert quality.judge(text, quality.Field())[:6] == quality.brute_force(text), text


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        f = quality.Field(rng.normal(size=(quality.N_FEATURES, 2)), rng.normal(size=(2, 2)))
        x = rng.normal(size=(n, quality.N_FEATURES))
        s = x @ f.emit
        value = lambda p: sum(s[t, p[t]] for t in range(n)) + sum(f.move[a, b] for a, b in itertools.pairwise(p))
        assert tuple(f.viterbi(x)) == max(itertools.product((0, 1), repeat=n), key=value)


def test_learns_from_labels(spark):
    good = "The river runs by the old town and over the hills. " * 3
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    def doc(i, bad):
        rng = random.Random(i)
        lines = [" ".join(rng.choices(words, k=12)) + "." for _ in range(9)]
        return "\n".join(" ".join(w + "###" for w in x.split()) if bad else x for x in lines)
    rows = [(i, doc(i, i % 3 == 0), "extra") for i in range(60)] + [(100, None, ""), (101, "", ""), (None, good, ""), (0, doc(0, True), "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i in range(60) if i % 3}
    assert quality.keep_good(docs, labels).columns == docs.columns
    assert quality.keep_good(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).where("doc_id < 60").count() == 61


def test_learns_from_whole_texts(spark):
    """Labelled documents that differ in their endings only."""
    line = lambda i, k, mark="": " ".join(f"word{(i * 7 + k * 5 + j * j) % 97}{mark}" for j in range(12))
    rows = [(i, "\n".join(line(i, k, "###" if i % 2 and k >= 70 else "") for k in range(140))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int"))
    # Feature 1 is the share of symbols, which only the endings have.
    assert model.emit[1, 0] > 0 > model.emit[1, 1]


def test_spread_lines():
    assert all(sorted({*quality.spread(n).tolist()}) == quality.spread(n).tolist() and len(quality.spread(n)) == min(n, quality.TRAIN_LINES) for n in range(300))
    assert quality.spread(1000)[0] == 0 and quality.spread(1000)[-1] == 999
