import random

import numpy as np

from cairn.llm import common, lines


def brute_force(rows):
    """Rest of each (doc_id, text), rows in any order; equal rows are one document."""
    import hashlib

    order = sorted({((d is not None, d or 0), hashlib.md5((t or "").encode()).digest(), t, d) for d, t in rows if t is not None}, key=lambda x: x[:2])
    seen, out = [], {}
    for _, _, t, d in order:
        left = []
        for line in t.split("\n"):
            s = frozenset(common.words(line))
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    seen.append(s)
                    continue
                seen.append(s)
            left.append(line)
        out[d, t] = "\n".join(left)
    return out


def data():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)]
    lines_ = [" ".join(rng.choices(words[: rng.choice([6, 12, 40])], k=rng.randint(1, 14))) for _ in range(60)]
    rows = []
    for i in range(50):
        text = []
        for _ in range(rng.randint(0, 8)):
            w = rng.choice(lines_).split()
            w = w * rng.choice([1, 1, 1, 0]) or [f"x{k}" for k in range(rng.choice([0, 400]), 900, 7)]
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = rng.choice(words)
            text.append(rng.choice(["", "- "]) + " ".join(w) + rng.choice([".", "", "!"]))
        rows.append((i, "\n".join([*text, *[""] * rng.randint(0, 2)])))
    return [*rows, (100, None), (101, ""), (0, rows[0][1]), (None, rows[1][1]), (2, rows[5][1])]


def test_against_brute_force(spark, monkeypatch):
    rows = data()
    docs = spark.createDataFrame([(d, t, "x", 7) for d, t in rows], "doc_id long, text string, key string, n_chars int")
    want = brute_force(rows)
    # Single words as keys; pairs and triples; each run dense; parts in pieces.
    for name, value in (("HOT_LEAST", 2000), ("HOT_LEAST", 3), ("RUN", 1), ("DENSE", 0), ("PART_BYTES", 900)):
        monkeypatch.setattr(lines, name, value)
        got = lines.deduplicate(docs)
        assert got.columns == docs.columns
        ids = sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
        assert ids == sorted((str(d), str(want.get((d, t)))) for d, t in rows)
    assert lines.deduplicate(docs.limit(0)).count() == 0


def test_no_texts():
    assert [len(x) for x in lines.line_words([])] == [0, 0, 0, 0]
    assert [len(x) for x in lines.line_words([b"", b"\n -", None])] == [0, 0, 0, 0]
    line, h, text, number = lines.line_words([None, b"a\n\nB a", "é ".encode() + b"w" * 3000])
    assert line.tolist() == [0, 1, 1, 2, 2] and text.tolist() == [1, 1, 2] and number.tolist() == [0, 2, 0] and h[0] == h[2]


def test_run_pairs():
    rng = np.random.default_rng(1)
    sets = [set(rng.choice(60, rng.integers(4, 30), replace=False).tolist()) for _ in range(300)]
    sets += [s ^ {int(rng.integers(60))} for s in sets]
    sets = [s for s in {frozenset(s) for s in sets} if len(s) >= lines.LEAST]
    key, rows = [], []
    for c, s in enumerate(sets):
        own = sorted(s)
        odd = 0
        for w in own:
            odd ^= 1 << w % 64
        rows += [(0, len(own), k, c % 7, c, odd) for k in range(len(own))]
        key += own
    similar = {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y])}
    key, rows = np.array(key, np.uint64), np.array(rows, lines.PREFIX)
    pairs, _, dense = lines.run_pairs(key, rows, True, 10**6, 10**6)
    got = {*pairs.tolist()}
    assert not len(dense) and similar and similar <= got and len(got) < len(sets) ** 2 / 8
    # In dense runs: pairs with the first of the run, and all rows.
    pairs, runs, dense = lines.run_pairs(key, rows, True, 0, 0)
    assert len(dense) == len(rows) and len(pairs) < 120 * len(sets)
    pairs, runs, dense = lines.run_pairs(key[:1], rows[:1], True, 0, 0)
    assert not len(pairs) and not len(dense)
    assert len(lines.run_pairs(key[:1], rows[:1], False, 0, 0)[2]) == 1
