import random
import re

from cairn.operators import needles, publish, score
from pyspark.sql import functions as F


def test_against_plain_contains(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choices("abc", k=rng.randint(0, 12)))) for i in range(80)] + [(90, None), (91, ""), (92, "abcabc" * 3000)]
    words = [(i, "".join(rng.choices("abc", k=rng.randint(1, 5))), f"v{i}") for i in range(40)] + [(50, "", "empty"), (51, "ab", "again"), (52, "ab", "again")]
    rows, table = spark.createDataFrame(texts, "id long, t string").repartition(3), spark.createDataFrame(words, "seq int, word string, v string")
    want = sorted((i, w, v) for i, t in texts for _, w, v in words if t and w and w in t)
    best = {i: min(((-len(w), k), w) for k, w, _ in words if t and w and w in t)[1] for i, t in texts if t and any(w and w in t for _, w, _ in words)}
    for bound in (needles.MOST_WORDS, 0):
        got = needles.contained(rows, table, "t", bound)
        assert sorted((r["id"], r["word"], r["v"]) for r in got.collect()) == want
        assert {r["id"]: r["word"] for r in needles.longest_contained(rows, table, "t", bound).collect()} == best
        assert needles.contained(rows, table.limit(0), "t", bound).count() == needles.longest_contained(rows, table.limit(0), "t", bound).count() == 0
        assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_pinned_display_genres(spark):
    cases = [
        ("ステーキ銀座", "焼肉", "ステーキ"), ("ホルモン新宿", "焼肉・ホルモン", "ホルモン"), ("通常店", "焼肉・ホルモン", "焼肉"), ("やきとん太郎", "居酒屋", "もつ焼き"), ("焼き鳥花子", "居酒屋", "焼き鳥"), ("生ラム専門店", "居酒屋", "ジンギスカン"),
        ("トラジ 国際フォーラム横店", "焼肉・ホルモン", "焼肉"), ("タイ東北モーラム酒店", "その他", "その他"), ("すき焼き本舗", "しゃぶしゃぶ", "すき焼き"), ("不明", "", "その他"),
        ("ホルモン焼肉", "", "ホルモン"), ("フォーラムのラム", "居酒屋", "ジンギスカン"), (None, None, "その他"), ("しゃぶしゃぶ", "", "しゃぶしゃぶ"),
    ]
    got = spark.createDataFrame(cases, "n string, g string, w string").select("n", "w", score.display_genre(F.col("n"), F.col("g")).alias("d")).collect()
    assert [r["d"] for r in got] == [r["w"] for r in got] and len(score.DISPLAY) == 12


def test_findings_against_plain_search(spark):
    rng = random.Random(5)
    bits = ["AIza" + "x" * 30, "ghp_" + "a" * 30, "sk-" + "b" * 20, "AIza", "TABELOG.com", "assets/pins", "assets/new_pins", "İ", " ", "é", "googletagmanager.com/gtag/js", "ss"]
    texts = [(i, "".join(rng.choices(bits, k=rng.randint(0, 12)))) for i in range(60)] + [(90, None), (91, ""), (92, "İİtabelog.com")]
    literals = {**publish.FORBIDDEN_TEXTS, "com": "part"}
    got = sorted((r["id"], r["rule"], r["start"], r["value"]) for r in needles.findings(spark.createDataFrame(texts, "id long, t string"), "t", publish.SECRETS, literals).collect())
    want = [(i, rule, m.start(), m[0]) for i, t in texts for rule, p in publish.SECRETS.items() for m in re.finditer(p, t or "")]
    want += [(i, rule, k, t[k : k + len(w)]) for i, t in texts for w, rule in literals.items() for k in range(len(t or "")) if t[k : k + len(w)].lower() == w]
    assert got == sorted(want) and any(r[1] == "validation service" and r[0] == 92 for r in got)
