import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest

from cairn.llm import common, graph, jaccard


def near_copies():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(70)]
    rows = []
    for i in range(45):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(w), "x"))
    rows += [(100 + i, " ".join(f"y{rng.randrange(500)}" for _ in range(40)), "x") for i in range(20)]
    rows += [(200, "Short text", ""), (201, "short TEXT!", ""), (202, None, ""), (203, "", ""), (204, "..", ""), (3, rows[3][1], ""), (None, rows[4][1], ""), (300, rows[5][1] + " one", "")]
    return rows


def expected(rows):
    def grams(t):
        w = common.words(t)
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [grams(t) for _, t, _ in rows]
    link = [{j for j, b in enumerate(sets) if j != i and a and b and 5 * len(a & b) >= 4 * len(a | b)} for i, a in enumerate(sets)]
    group = list(range(len(rows)))
    while True:
        new = [min([group[i], *(group[j] for j in link[i])]) for i in range(len(rows))]
        if new == group:
            return link, group
        group = new


@pytest.mark.parametrize(("small", "block"), [(16, 200_000), (2, 200_000), (2, 300)])
def test_against_brute_force(spark, monkeypatch, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    link, group = expected(rows)
    ids = {}
    for (d, _, _), g in zip(rows, group, strict=True):
        if d is not None:
            ids[g] = min(ids.get(g, d), d)
    want = sorted(((d if d is not None else -1), ids[g], len(x)) for (d, _, _), g, x in zip(rows, group, link, strict=True))
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"], r["n_links"]) for r in jaccard.report(docs).collect())
    assert got == want


def test_deduplicate(spark):
    rows = near_copies()
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string")
    _, group = expected(rows)
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    least = {}
    for (d, t, _), g in zip(rows, group, strict=True):
        if common.words(t) and d is not None:
            least[g] = min(least.get(g, d), d)
    assert sorted(ids) == sorted([*least.values(), 202, 203, 204])
    assert jaccard.deduplicate(docs.limit(0)).count() == 0 and jaccard.report(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 12)] + [(30, 20), (20, 25), (40, 40), (None, 3)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(13)}, 20: 20, 25: 20, 30: 20, 40: 40}


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(0, k) for k in range(1, 300)] + [(999, k) for k in range(700, 900)] + [(k, k + 1) for k in range(400, 520)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    label = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()} == label


def blocks_of(rng, n, size, pool):
    base = [rng.choice(10**12, size, replace=False) for _ in range(pool)]
    sets = []
    for k in range(n):
        s = base[k % pool].copy()
        s[: rng.integers(0, 3)] = rng.choice(10**12, 1)
        sets.append(np.unique(s))
    return sets


def test_blocks_against_all_pairs():
    rng = np.random.default_rng(5)
    sets = blocks_of(rng, 90, 12, 7)
    block = np.where(rng.random(90) < 0.5, "1:0", "1:1")
    parts = pd.DataFrame({"c": [f"{k:03}".encode() for k in range(90)], "block": block, "s": sets, "m": rng.integers(1, 5, 90)})
    own = lambda k: {*sets[k].tolist()}
    for i, j in (("1:0", "1:0"), ("1:0", "1:1")):
        part = parts if i != j else parts[parts["block"] == i]
        linked = {(a, b) for a in part.index for b in part.index if a != b and {block[a], block[b]} == {i, j} and (i == j or block[a] != block[b]) and 5 * len(own(a) & own(b)) >= 4 * len(own(a) | own(b))}
        for cells in (1 << 22, 64):
            jaccard.CELLS, old = cells, jaccard.CELLS
            got = jaccard.count_block(part, i, j)
            jaccard.CELLS = old
            n = {int(c): m for c, m in zip(got["c"], got["n"], strict=True)}
            assert n == {a: sum(int(parts["m"][y]) for x, y in linked if x == a) for a in {x for x, _ in linked}} and linked
            label = {a: a for a in n}
            for _ in n:
                for a, b in linked:
                    label[a] = label[b] = min(label[a], label[b])
            root = {int(c): int(r) for c, r in zip(got["c"], got["root"], strict=True)}
            assert all((root[a] == root[b]) == (label[a] == label[b]) for a in n for b in n)


def test_full_block_is_bounded():
    """A block of 10,000 sets of 20 shingles, more than a block takes, needs a few hundred MB."""
    rng = np.random.default_rng(6)
    sets = blocks_of(rng, 10_000, 20, 300)
    parts = pd.DataFrame({"c": [f"{k:05}".encode() for k in range(len(sets))], "block": "1:0", "s": sets, "m": 1})
    tracemalloc.start()
    got = jaccard.count_block(parts, "1:0", "1:0")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) and peak < 400 << 20


def tries(sets):
    """``LABEL`` rows of sets of 64-bit hashes, and each one's labels."""
    labels = np.array([jaccard.signature(s) for s in sets]).view(np.uint32).astype(np.uint64).reshape(-1, jaccard.TREES, jaccard.DEPTH)
    rows = np.empty((len(sets), jaccard.TREES), jaccard.LABEL)
    head = np.broadcast_to(np.arange(1, jaccard.TREES + 1, dtype=np.uint64), labels.shape[:2])
    for k in range(jaccard.SHORTEST):
        head = jaccard.mix(head * jaccard._M3 + labels[:, :, k])
    rows["head"], rows["tail"] = head, sum((labels[:, :, k] & np.uint64(0xFFFF)) << np.uint64(16 * (jaccard.DEPTH - 1 - k)) for k in range(jaccard.SHORTEST, jaccard.DEPTH))
    rows["hi"], rows["lo"] = 0, np.arange(len(sets))[:, None]
    return rows.ravel(), labels


def pairs_of(rows, small):
    out = {False: {}, True: {}}
    for batch in jaccard.trie_pairs(rows, small):
        for r in batch.to_pylist():
            key = int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")
            out[r["crowd"]][key] = max(r["at"], out[r["crowd"]].get(key, 0))
    return out


def test_forest_finds_the_longest_shared_prefix():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    sets = [np.concatenate((base[rng.permutation(400)[: rng.integers(300, 400)]], rng.integers(0, 1 << 63, 20, np.uint64))) for _ in range(40)]
    rows, labels = tries(sets)
    short = np.concatenate((labels[:, :, : jaccard.SHORTEST], labels[:, :, jaccard.SHORTEST :] & np.uint64(0xFFFF)), axis=2)
    want = {}
    for x in range(40):
        for y in range(x + 1, 40):
            same = np.cumprod(short[x] == short[y], axis=1).sum(axis=1).max()
            if same >= jaccard.SHORTEST:
                want[x, y] = same
    got = pairs_of(rows, 10**6)
    assert got[False] == want and want and not got[True]
    # Large nodes: every such pair is given or linked.
    for small in (1, 3, 8):
        got = pairs_of(rows, small)
        assert set(got[True]) <= set(want) and set(got[False]) <= set(want) and got[True]
        group = list(range(40))
        for _ in range(40):
            for a, b in got[True]:
                group[a] = group[b] = min(group[a], group[b])
        assert all(p in got[False] or group[p[0]] == group[p[1]] for p in want)
    assert not list(jaccard.trie_pairs(rows[:0], 4)) and not list(jaccard.trie_pairs(rows[:1], 4))


def test_recall_against_exact_pairs():
    """Pairs at the threshold and above, among others: the share that the shortened prefixes find."""
    rng = np.random.default_rng(7)
    sets, similar = [], []
    for k in range(400):
        a = rng.integers(0, 1 << 63, 180, np.uint64)
        change = int(rng.integers(0, 21)) if k % 2 else 20  # 160 of 200 in common: 0.8
        similar.append((len(sets), len(sets) + 1))
        sets += [a, np.concatenate((a[change:], rng.integers(0, 1 << 63, change, np.uint64)))]
    rows, labels = tries(sets)
    at = pairs_of(rows, jaccard.SMALL)[False]
    flat = labels.reshape(len(sets), -1)
    found = [(n, int((flat[a] == flat[b]).sum()), 1) for (a, b), n in at.items()]
    length = jaccard.shortened(found)
    recall = sum(at.get(p, 0) >= length for p in similar) / len(similar)
    print("prefix", length, "estimated", jaccard.recall_at(length, found), "measured", recall)
    assert length < jaccard.DEPTH and recall >= 0.999
    # Only close copies: the longest prefixes do.
    close = [(jaccard.DEPTH, int(0.97 * jaccard.TREES * jaccard.DEPTH), 500)]
    assert jaccard.shortened(close) == jaccard.DEPTH and jaccard.shortened([]) == jaccard.SHORTEST
    assert jaccard.found_at(jaccard.SHORTEST, 0.8) >= jaccard.RECALL
