"""N-gram Jaccard join: a MinHash LSH forest proposes pairs, exact shingle sets verify them.

A text's set holds the 64-bit hashes of its runs of five words (one of all its words, if fewer).
Texts of equal sets form a class, so copies are one row from there on. Each class has a label of
``DEPTH`` MinHash values in each of ``TREES`` trees. A tree is a sorted prefix trie: labels are dealt by
their first ``SHORTEST`` values, sorted, and the length of the prefix that neighbours share (8 to 5
values) gives its nodes. Classes match at the longest prefix that they share in any tree.

The matched prefixes are shortened from ``DEPTH`` on, value by value, until the pairs that similar
classes (by agreement of their labels) are found with reach the target: a pair of similarity s is found at
length d with probability 1 - (1 - s^d)^TREES, so the mean of its inverse over what was found tells what
wasn't. At ``SHORTEST`` even a pair at the threshold is found with 0.999997, so there it ends.

* Nodes (of ``SHORTEST`` values) of at most ``SMALL`` classes give their pairs, each at its longest common prefix,
  which are bounded by SMALL a row. Pairs whose labels agree too rarely for the threshold (six standard
  deviations) go; the rest are verified.
* Larger nodes give no pairs but links to their least class. What is linked is a crowd, of which all pairs
  are looked at; it is cut by size, as similar sets are at most five to four, and into blocks of about
  ``BLOCK`` shingles or ``CLASSES`` classes. Pairs of blocks of near sizes meet in a task each, which counts exact intersections
  by matrix products and gives only numbers of links and a spanning forest.

Links are therefore complete, up to the forest's recall, without a row for each pair of a group.
Only classes in a node of two or more have their texts read a second time.

Defined cases: a null, empty or wordless text has no shingles, links or partners and is a class of
its own; equal rows are copies of each other; a class's id is its least doc_id, null if all are
null; very long texts give all of their shingles; an empty table gives empty ones; other columns are passed over by ``links`` and kept by ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components

SHINGLE, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of 4/5 or more
TREES, DEPTH, SHORTEST, RECALL = 32, 8, 5, 0.99999
SMALL, BLOCK, CLASSES = 16, 200_000, 4096
#: Pairs of a block that are counted at once.
CELLS = 1 << 22

#: A class in a tree: what its label begins with, the rest of it (16 bits a value), the class.
LABEL = np.dtype([("head", "<u8"), ("tail", "<u8"), ("hi", ">u8"), ("lo", ">u8")])

_RNG = np.random.default_rng(20)
_A = _RNG.integers(1, 1 << 31, TREES * DEPTH, np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, np.uint32)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingles(text: str | None, memo: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    found = common.words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(memo) > 500_000:
        memo.clear()
    for w in found:
        if w not in memo:
            memo[w] = word_hash(w)
    h = np.fromiter(map(memo.__getitem__, found), np.uint64, len(found))
    size = min(SHINGLE, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = mix(out * _M3 + h[k : len(h) - size + 1 + k])
    return np.unique(out + np.uint64(size))


def found_at(length: int, similarity: float | np.ndarray) -> float | np.ndarray:
    """The probability that a pair shares a prefix of the length in a tree or more."""
    return 1 - (1 - similarity**length) ** TREES


def recall_at(length: int, found: list[tuple[int, int, int]]) -> float:
    """The share of similar pairs that prefixes of the length find, estimated from those they did.

    ``found``: (longest shared prefix, agreeing values of the labels, pairs).
    """
    seen = [(agree / (TREES * DEPTH), n) for at, agree, n in found if at >= length]
    whole = sum(n / found_at(length, s) for s, n in seen)
    return sum(n for _, n in seen) / whole if whole else 1.0


def shortened(found: list[tuple[int, int, int]], recall: float = RECALL) -> int:
    """The longest prefix with the target recall; no pairs to tell by, the shortest."""
    threshold = NUMERATOR / DENOMINATOR * TREES * DEPTH
    similar = [x for x in found if x[1] >= threshold]
    for length in range(DEPTH, SHORTEST, -1):
        if any(at >= length for at, _, _ in similar) and recall_at(length, similar) >= recall:
            return length
    return SHORTEST


def signature(s: np.ndarray) -> np.ndarray:
    """TREES * DEPTH labels of 32 bits."""
    out = np.full(len(_A), ~np.uint32(0))
    short = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(s), 2048):
        out = np.minimum(out, (short[None, at : at + 2048] * _A[:, None] + _B[:, None]).min(axis=1))
    return out.view(np.int32)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, c, n, labels) of each row; c identifies the shingle set, null for none."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingles(t, memo) for t in batch["text"]]
            c = [(int(mix(s).sum()).to_bytes(8, "big") + int(mix(s ^ _M3).sum()).to_bytes(8, "big")) if len(s) else None for s in sets]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "key": batch["key"], "c": c, "n": [len(s) for s in sets], "labels": [signature(s) if len(s) else None for s in sets]})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), common.text_key().alias("key"), "text")
    return rows.mapInPandas(run, "doc_id long, key string, c binary, n int, labels array<int>")


def sets_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(c, s): shingles of the classes in ``keys`` (key, c), read from a text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo: dict[bytes, int] = {}
        for batch in batches:
            yield pd.DataFrame({"c": batch["c"], "s": [shingles(t, memo).view(np.int64) for t in batch["text"]]})

    met = docs.select(common.text_key().alias("key"), "text").join(keys.hint("shuffle_hash"), "key").select("key", "c", "text")
    return met.mapInPandas(run, "c binary, s array<long>").groupBy("c").agg(F.first("s").alias("s"))


def count_block(parts: pd.DataFrame, i: str, j: str) -> pd.DataFrame:
    """Links between the blocks i and j of a crowd (or inside one block): numbers and a spanning forest.

    Intersections are counted in strips of ``CELLS`` pairs; of a strip only bits are kept, one a pair.
    """
    parts = parts.drop_duplicates(["block", "c"]).sort_values("c").reset_index(drop=True)
    size = parts["s"].map(len).to_numpy()
    every = np.concatenate(parts["s"].to_list())
    row = np.repeat(np.arange(len(parts)), size)
    _, column, df = np.unique(every, return_inverse=True, return_counts=True)
    shared = df[column] > 1  # others are in no intersection
    row, column = row[shared], column[shared]
    left, right = np.flatnonzero(parts["block"] == i), np.flatnonzero(parts["block"] == j)
    weight = parts["m"].to_numpy()
    n = np.zeros(len(parts), np.int64)

    def entries(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(len(parts), -1)
        place[own] = np.arange(len(own))
        at = place[row]
        return at[at >= 0], column[at >= 0]

    (left_at, left_column), (right_at, right_column) = entries(left), entries(right)
    bits = np.zeros((len(left), (len(right) + 7) // 8), np.uint8)
    back = np.zeros((len(right), (len(left) + 7) // 8), np.uint8)
    strip = max(8, CELLS // max(len(right), 1) // 8 * 8)
    for lo in range(0, len(left), strip):
        rows = left[lo : lo + strip]
        own = (left_at >= lo) & (left_at < lo + strip)
        columns, x_column = np.unique(left_column[own], return_inverse=True)
        x_at = left_at[own] - lo
        slot = np.minimum(np.searchsorted(columns, right_column), max(len(columns) - 1, 0))
        met = columns[slot] == right_column if len(columns) else np.zeros(len(slot), bool)
        y_at, y_column = right_at[met], slot[met]
        both = np.zeros((len(rows), len(right)), np.float32)
        wide = max(1, CELLS // max(len(rows), len(right), 1))
        for at in range(0, len(columns), wide):
            a, b = np.zeros((len(rows), wide), np.float32), np.zeros((len(right), wide), np.float32)
            x, y = (x_column >= at) & (x_column < at + wide), (y_column >= at) & (y_column < at + wide)
            a[x_at[x], x_column[x] - at] = 1
            b[y_at[y], y_column[y] - at] = 1
            both += a @ b.T
        linked = DENOMINATOR * both >= NUMERATOR * (size[rows][:, None] + size[right][None, :] - both)
        if i == j:
            linked[np.arange(len(rows)), lo + np.arange(len(rows))] = False
        n[rows] += linked @ weight[right]
        if i != j:
            n[right] += linked.T @ weight[rows]
        bits[lo : lo + strip] = np.packbits(linked, axis=1)
        back[:, lo // 8 : lo // 8 + (len(rows) + 7) // 8] = np.packbits(linked.T, axis=1)

    # Spanning forest: breadth first, by the rows of the bits and back.
    root = np.full(len(parts), -1)
    seen_l, seen_r = np.zeros(len(left), bool), np.zeros(len(right), bool)
    some = bits.any(axis=1)
    ahead = lambda own, table, count: np.unpackbits(np.bitwise_or.reduce(table[own], axis=0), count=count).astype(bool)
    for k in range(len(left)):
        if seen_l[k] or not some[k]:
            continue
        fresh = np.array([k])
        while len(fresh):
            seen_l[fresh] = True
            root[left[fresh]] = left[k]
            reached = np.flatnonzero(ahead(fresh, bits, len(right)) & ~seen_r)
            seen_r[reached] = True
            root[right[reached]] = np.where(root[right[reached]] < 0, left[k], root[right[reached]])
            if not len(reached):
                break
            new = ahead(reached, back, len(left))
            if i == j:
                new[reached] = True
            fresh = np.flatnonzero(new & ~seen_l)
    own = np.flatnonzero(root >= 0)
    return pd.DataFrame({"c": parts["c"][own].to_numpy(), "n": n[own], "root": parts["c"].to_numpy()[root[own]]})


def forest(classes: DataFrame) -> DataFrame:
    """(a, b, at, crowd): pairs of classes that share a prefix of length ``at`` and no longer one in a tree, and links to the least class of large nodes (``crowd``)."""
    spark = classes.sparkSession
    deal = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = 4 * deal

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            labels = np.asarray(batch["labels"].flatten()).view(np.uint32).astype(np.uint64).reshape(-1, TREES, DEPTH)
            c = np.frombuffer(b"".join(batch["c"].to_pylist()), ">u8").reshape(-1, 2)
            head = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), labels.shape[:2])
            for k in range(SHORTEST):
                head = mix(head * _M3 + labels[:, :, k])
            tail = np.zeros(labels.shape[:2], np.uint64)
            for k in range(SHORTEST, DEPTH):
                tail = (tail << np.uint64(16)) | (labels[:, :, k] & np.uint64(0xFFFF))
            rows = np.empty(head.size, LABEL)
            rows["head"], rows["tail"] = head.ravel(), tail.ravel()
            rows["hi"], rows["lo"] = np.repeat(c[:, 0], TREES), np.repeat(c[:, 1], TREES)
            part = (rows["head"] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            rows, part = rows[order], part[order]
            edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            ends = (np.append(edge, len(part)) * LABEL.itemsize).astype(np.int32)
            yield pa.record_batch({"part": pa.array(part[edge]), "data": pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])})

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [np.frombuffer(b"".join(x["data"].to_pylist()), LABEL) for x in batches]
        if own:
            yield from trie_pairs(np.concatenate(own), SMALL)

    sent = classes.select("c", "labels").mapInArrow(emit, "part int, data binary")
    return sent.repartition(deal, "part").mapInArrow(meet, "a binary, b binary, at byte, crowd boolean")


def trie_pairs(rows: np.ndarray, small: int) -> Iterator[pa.RecordBatch]:
    """``forest``'s rows of whole tries, given as ``LABEL`` rows in any order; nodes of more than ``small`` classes are large."""
    order = np.argsort(rows["head"])
    new = np.concatenate(([True], rows["head"][order[1:]] != rows["head"][order[:-1]], [True])) if len(rows) else np.ones(1, bool)
    rows = rows[order[~(new[1:] & new[:-1])]]
    rows = rows[np.lexsort((rows["lo"], rows["hi"], rows["tail"], rows["head"]))]
    if not len(rows):
        return
    # Values that each row's label shares with the one before, 0 for another trie.
    differ = rows["tail"][1:] ^ rows["tail"][:-1]
    shared = np.full(len(rows), SHORTEST)
    for k in range(1, DEPTH - SHORTEST + 1):
        shared[1:] += differ >> np.uint64(16 * (DEPTH - SHORTEST - k)) == 0
    shared[1:][rows["head"][1:] != rows["head"][:-1]] = 0
    shared[0] = 0
    ids = np.column_stack((rows["hi"], rows["lo"])).astype(">u8").tobytes()

    def batch(x: np.ndarray, y: np.ndarray, at: int, crowd: bool) -> pa.RecordBatch:
        whole = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * 16).astype(np.int32)), pa.py_buffer(ids)])
        # The lesser class first.
        turn = (rows["hi"][x] > rows["hi"][y]) | (rows["hi"][x] == rows["hi"][y]) & (rows["lo"][x] > rows["lo"][y])
        x, y = np.where(turn, y, x), np.where(turn, x, y)
        return pa.record_batch({"a": whole.take(pa.array(x)), "b": whole.take(pa.array(y)), "at": pa.array(np.full(len(x), at, np.int8)), "crowd": pa.array(np.full(len(x), crowd))})

    node = np.cumsum(shared == 0) - 1
    large = (np.bincount(node) > small)[node]
    # A large node's classes are linked to its least, which is often the same in many tries.
    order = np.lexsort((rows["lo"], rows["hi"]))
    rank = np.empty(len(rows), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (rows["hi"][order[1:]] != rows["hi"][order[:-1]]) | (rows["lo"][order[1:]] != rows["lo"][order[:-1]]))))
    head = np.flatnonzero(rank == np.minimum.reduceat(rank, np.flatnonzero(shared == 0))[node])[node]
    link = np.flatnonzero((head != np.arange(len(rows))) & large)
    if len(link):
        yield batch(head[link], link, SHORTEST, True)
    child = np.arange(len(rows))  # nodes one value longer
    for at in range(DEPTH, SHORTEST - 1, -1):
        node = np.cumsum(shared < at) - 1
        end = np.cumsum(np.bincount(node))[node]
        # Pairs of different children of a node: from a row to all behind its own child.
        last = np.searchsorted(child, child, "right")
        many = np.where(large, 0, end - last)
        for lo in range(0, len(rows), 1 << 16):
            n = many[lo : lo + (1 << 16)]
            x = np.repeat(np.arange(lo, lo + len(n)), n)
            y = last[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            if len(x):
                yield batch(x, y, at, False)
        child = node


def links(docs: DataFrame, recall: float = RECALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, key, c); classes (c, m, doc_id); linked classes (c, n, root): n linked documents of other classes, and edges to roots."""
    rows = common.cut(signed(docs))
    members = rows.select("doc_id", "key", "c")
    classes = common.cut(rows.where("c is not null").groupBy("c").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("labels").alias("labels")))
    met = common.cut(forest(classes).groupBy("a", "b").agg(F.max("at").alias("at"), F.bool_or("crowd").alias("crowd")))

    # Crowds: what large nodes link.
    crowd = common.cut(components(met.where("crowd").select("a", "b")).select(F.col("node").alias("c"), F.col("label").alias("crowd")))
    own = lambda x: crowd.select(F.col("c").alias(x), F.col("crowd").alias(f"c{x}"))
    apart = met.where("not crowd").select("a", "b", "at").join(own("a"), "a", "left").join(own("b"), "b", "left").where("ca is null or cb is null or ca <> cb")

    # Pairs of small nodes whose labels and sizes allow the threshold.
    about = lambda x: classes.select(F.col("c").alias(x), F.struct("n", "labels", "m").alias(f"{x}_"))
    agree = F.size(F.filter(F.zip_with("a_.labels", "b_.labels", lambda x, y: x == y), lambda x: x))
    s, total = NUMERATOR / DENOMINATOR, TREES * DEPTH
    least = int(total * s - 6 * (total * s * (1 - s)) ** 0.5)
    sizes = (F.col("a_.n") * DENOMINATOR >= F.col("b_.n") * NUMERATOR) & (F.col("b_.n") * DENOMINATOR >= F.col("a_.n") * NUMERATOR)
    near = apart.select("a", "b", "at").join(about("a"), "a").join(about("b"), "b").where(sizes).withColumn("agree", agree).where(F.col("agree") >= least)
    near = common.cut(near.select("a", "b", "at", "agree", F.col("a_.m").alias("ma"), F.col("b_.m").alias("mb")))
    # At most (DEPTH - SHORTEST + 1) * TREES * DEPTH numbers reach the driver.
    length = shortened([(r["at"], r["agree"], r["count"]) for r in near.groupBy("at", "agree").count().collect()], recall)

    pairs = near.where(F.col("at") >= length).select("a", "b", "ma", "mb")

    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).unionByName(crowd.select("c")).distinct()
    sets = common.cut(sets_of(docs, wanted.join(classes, "c").select("key", "c")))
    met = pairs.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    found = met.where(DENOMINATOR * both >= NUMERATOR * (F.size("sa") + F.size("sb") - both)).select("a", "b", "ma", "mb")
    by_pair = found.select(F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("mb").alias("n"), F.col("a").alias("root")), F.struct(F.col("b").alias("c"), F.col("ma").alias("n"), F.col("a").alias("root")))).alias("x")).select("x.*")

    # Blocks of crowds: by size, in steps of five to four, then by hash.
    step = F.floor(F.log(F.col("n")) / np.log(DENOMINATOR / NUMERATOR)).cast("int")
    sized = crowd.join(classes.select("c", "m", step.alias("step"), "n"), "c")
    lasts = sized.groupBy("crowd", "step").agg((F.sum(F.greatest("n", F.lit(BLOCK // CLASSES))) / BLOCK).cast("int").alias("last"))
    blocks = lasts.groupBy("crowd").agg(F.map_from_entries(F.collect_list(F.struct("step", "last"))).alias("last"))  # a crowd has a hundred steps at most
    inside = sized.join(blocks, "crowd").withColumn("block", F.struct("step", F.pmod(F.xxhash64("c"), F.col("last")[F.col("step")] + 1).cast("int").alias("k")))
    beside = lambda d: F.transform(F.when(F.array_contains(F.map_keys("last"), F.col("step") + d), F.sequence(F.lit(0), F.try_element_at("last", F.col("step") + d))).otherwise(F.array().cast("array<int>")), lambda k: F.struct((F.col("step") + d).alias("step"), k.alias("k")))
    dealt = inside.withColumn("other", F.explode(F.concat(beside(-1), beside(0), beside(1)))).join(sets, "c")
    name = lambda x: F.concat_ws(":", x["step"], x["k"])
    i, j = F.least("block", "other"), F.greatest("block", "other")
    dealt = dealt.select("crowd", name(i).alias("i"), name(j).alias("j"), name(F.col("block")).alias("block"), "c", "s", "m")

    def count(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        return count_block(parts, key[1], key[2])

    by_block = dealt.groupBy("crowd", "i", "j").applyInPandas(count, "c binary, n long, root binary")
    return members, classes.select("c", "m", "doc_id", F.col("key").alias("first_key")), common.cut(by_pair.unionByName(by_block))


def groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, c); of each class its number of links and its group's label."""
    members, classes, linked = links(docs)
    labels = components(linked.select(F.col("c").alias("a"), F.col("root").alias("b")))
    counts = linked.groupBy("c").agg(F.sum("n").alias("n"))
    own = classes.join(counts, "c", "left").join(labels.withColumnRenamed("node", "c"), "c", "left")
    return members, common.cut(own.select("c", "m", "doc_id", "first_key", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "c").alias("label")))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its group) and n_links (other documents at the threshold)."""
    members, own = groups(docs)
    ids = own.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = own.join(ids, "label").select("c", "class_id", "n_links")
    met = members.join(named, "c", "left")
    return met.select("doc_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


@common.shielded
def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: that of the least doc_id, then of the least text hash.

    Rows without words all stay. Of equal rows one stays.
    """
    members, own = groups(docs)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = members.where("c is not null").groupBy("c").agg(F.min(order).alias("f")).join(own.select("c", "label"), "c").groupBy("label").agg(F.min("f").alias("f")).select(F.col("f.doc_id").alias("__id"), F.col("f.key").alias("__key"))
    keyed = docs.withColumn("__key", common.text_key())
    has_words = F.expr(r"coalesce(text, '') rlike '[0-9A-Za-z\\x{80}-\\x{10FFFF}]'")
    kept = keyed.where(has_words).join(first.hint("shuffle_hash"), (keyed["__key"] == first["__key"]) & keyed["doc_id"].cast("bigint").eqNullSafe(first["__id"])).drop("__id").drop(first["__key"])
    return kept.dropDuplicates(["__key"]).drop("__key").unionByName(docs.where(~has_words))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: class and number of links of every document."""
    return report(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def classes_sql(relation: str) -> str:
    """Relations ``sim_*`` ending in ``sim_class(doc_id, class_id, n_links)`` over (doc_id, text)."""
    return rf"""
sim_w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from {relation}),
sim_s as (select distinct doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') as s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) as i from sim_w where len(w) > 0)),
sim_n as (select doc_id, count(*) as n from sim_s group by doc_id),
sim_p as (select a.doc_id as a, b.doc_id as b, count(*) as o from sim_s a join sim_s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
sim_l as (select a, b from sim_p join sim_n x on x.doc_id = a join sim_n y on y.doc_id = b where 5 * o >= 4 * (x.n + y.n - o)),
sim_r as (select a, b from sim_l union select r.a, l.b from sim_r r join sim_l l on r.b = l.a),
sim_class as (
  select cast(d.doc_id as bigint) as doc_id, cast(least(d.doc_id, coalesce((select min(b) from sim_r where a = d.doc_id), d.doc_id)) as bigint) as class_id,
    (select count(*) from sim_l where a = d.doc_id) as n_links
  from {relation} d)"""


SQL = f"with recursive {classes_sql('documents')} select * from sim_class"
