import zlib

import numpy as np
import pytest

from cairn.llm import language

ROOTS = {"en": ["the", "ing", "wh", "er", "th"], "de": ["sch", "ung", "ein", "ß", "ich"], "fr": ["eau", "ou", "é", "que", "le"]}


def test_gradient_through_time():
    net = language.Network(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    ids, mask = language.padded([b" abc", b" a", b" ca"])
    y = np.array([0, 1, 1])
    _, g = net.gradient(ids, mask, y)
    rng = np.random.default_rng(0)
    for k in net.w:
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in net.w[k].shape)
            if k in ("xf", "xb"):
                at = (int(rng.choice([32, 97, 98, 99])), at[1])
            old, e = net.w[k][at], 1e-3
            net.w[k][at] = old + e
            up = net.gradient(ids, mask, y)[0]
            net.w[k][at] = old - e
            down = net.gradient(ids, mask, y)[0]
            net.w[k][at] = old
            assert g[k][at] == pytest.approx((up - down) / 2 / e, abs=2e-3)


def test_held_out_accuracy(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join("".join(rng.choice(ROOTS[c], 2)) for _ in range(30)), c, "x") for i, c in enumerate(list(ROOTS) * 60)]
    rows += [(900, None, "en", ""), (901, "12 !!", "fr", ""), (None, "the thing", "en", ""), (903, "einung", None, ""), (904, "", "de", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = language.fit(docs)
    assert net.languages == ["de", "en", "fr"]
    done = language.predict(docs, net, "p").withColumn("h", language.held_out()).collect()
    assert len(done) == len(rows)
    by = {r["doc_id"]: r for r in done}
    held = [r for r in done if r["h"] and r["doc_id"] < 900]
    assert held and all(r["p"]["lang_pred"] == r["lang"] and 0 <= r["p"]["score"] <= 1 for r in held)
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in done if r["doc_id"] is not None)
    assert [by[i]["p"]["lang_pred"] for i in (900, 901, 904)] == ["und"] * 3 and not by[None]["h"]
    assert language.predict(docs, language.fit(docs.limit(0)), "p").where("p.lang_pred <> 'und'").count() == 0
    assert language.predict(docs.limit(0), net, "p").count() == 0


def test_long_text_and_memo(monkeypatch):
    net = language.Network(["a", "b"], hidden=4)
    whole = language.Predictor(net).predict(["x" * 100_000, "ab cd " * 50, "ab"])
    monkeypatch.setattr(language, "MEMO", 2)
    small = language.Predictor(net)
    assert [x[0] for x in whole] == [small.predict([t])[0][0] for t in ("x" * 100_000, "ab cd " * 50, "ab")]


def test_no_language_goes_by_name(spark, monkeypatch):
    monkeypatch.setattr(language, "TRAIN_DOCS", 6)
    monkeypatch.setattr(language, "MAX_LANGUAGES", 1)
    rows = [(i, " ".join(ROOTS[c]), c) for i, c in enumerate(list(ROOTS) * 20)]
    assert language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["de", "en", "fr"]


def test_segments_keep_characters_whole():
    text = "short " + "ж" * 40 + " " + "漢字" * 20 + " " + "a" * 50
    parts = language.segments(text)
    assert b"".join(p[1:] for p in parts) == text.replace(" ", "").encode()
    assert all(len(p) <= language.SEGMENT + 1 and p[1:].decode() for p in parts)
