"""Hard-negative mining by inner products, exact, through one-dimensional distance keys.

A vector gets one more component, the root of the largest squared norm less its own, so that all have one norm and the
largest inner product with a query is the least distance from it. Each vector belongs to its nearest pivot, and its key is
(pivot, distance from the pivot). Vectors are stored sorted by that key, in blocks, which belong to rings: intervals of a
pivot's keys. By the triangle inequality a ring's vectors are at least as far from a query as the query's own
distance from the pivot is from the ring's interval. A search scans rings in rounds: within a first radius, then, if fewer
than k were found, within one that holds ``GROW`` times the vectors, else within the distance of the k-th that was found. What
a ring can't hold any more certifies the k. A search may be for scores in a band: then it is an annulus, whose inner radius
spares the rings that lie inside of it whole, and whose outer one ends the search.

Positives of an anchor are the best rows of its label; negatives the best rows of other labels whose score lies in a
band below the positive's. Rows of equal vector and label are one class with its least ids, as many as any answer can
take; anchors of a class, and positives of equal score, ask once.

Scale: pivots and intervals come from a sample of ``SAMPLE`` classes; the rest is shuffled by range once and
written. Each round deals packs of queries to the rings they need: an equi-join of (pack, ring) and (block, ring), whose
tasks multiply matrices and keep k rows a query. Driver and broadcasts hold ``PIVOTS`` vectors and ``PIVOTS`` x ``RINGS``
intervals with counts, whatever the input. Nothing is approximate; what the data's dimension takes from the bounds costs scans, not answers.

Defined cases: rows with a null id, label or vector, or a null or non-finite component take no part; vectors of
different lengths count as padded with zeros; rows that repeat an id, label and vector are one row, rows
that share an id only are different rows, but none is a positive of the other, whose place it may take; ties go to the smaller id; an anchor without others of its label has no positives; without scores in the band
a positive has no rows; scores are exact up to squared norms of 2^53, larger ones raise an error; empty tables give an
empty result; other columns pass unread.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
#: A negative's score is at least and at most so many hundredths of the positive's.
BAND = (30, 90)
#: Of the index: classes that pivots come from, most pivots, most rings of each, rows of a block; how a search without k results grows.
SAMPLE, PIVOTS, RINGS, BLOCK_ROWS, GROW, FIRST = 4096, 64, 64, 2048, 8, 1024
_ANY = (-(1 << 62), 1 << 62)

ROWS = "cell int, lo double, hi double, n long, labels binary, sizes binary, ids binary, vecs binary"
PACK = "cell int, qids binary, lows binary, highs binary, leasts binary, own binary, at binary, queries binary"
FOUND = "qid long, low long, high long, score long, id long"


class Shape(NamedTuple):
    """What all tasks know of the vectors: how they are packed, the largest squared norm, pivots and their rings' bounds."""

    kind: str
    width: int
    top: float
    pivots: np.ndarray
    bounds: np.ndarray

    @property
    def slack(self) -> float:
        """More than distances can be wrong by."""
        return 1e-5 * (self.top**0.5 + 1)

    def matrix(self, vecs: bytes | list[bytes]) -> np.ndarray:
        return np.frombuffer(vecs if isinstance(vecs, bytes) else b"".join(vecs), self.kind).reshape(-1, self.width).astype(np.float64)

    def from_pivots(self, m: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Distances of rows from pivots, given the rows' last components."""
        square = ((m * m).sum(1) + last * last)[:, None] + (self.pivots * self.pivots).sum(1) - 2 * (m @ self.pivots[:, :-1].T + last[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(square, 0))

    def stored(self, m: np.ndarray) -> np.ndarray:
        """Distances of stored rows, all of one norm."""
        return self.from_pivots(m, np.sqrt(np.maximum(self.top - (m * m).sum(1), 0)))

    def radius(self, norms: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distance at which a query of such a squared norm has such a score."""
        return np.sqrt(np.maximum(norms + self.top - 2 * scores.astype(np.float64), 0))


def usable(rows: DataFrame, vector: str, scale: int = SCALE) -> DataFrame:
    """Rows that take part, with whole numbers as ``vector``."""
    whole = F.transform(vector, lambda x: F.floor(scale * x.cast("double")))
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), whole.alias("vector"))


def packed(rows: DataFrame) -> tuple[DataFrame, Shape | None]:
    """(vec_id, label, vec) with vectors as bytes, and how they are packed; nothing if there are no rows."""
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    seen = rows.agg(F.max(F.size("vector")).alias("width"), F.max(F.aggregate("vector", F.lit(0).cast("bigint"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most"), F.max(square).alias("top")).first()
    if seen["width"] is None:
        return rows.select("vec_id", "label", F.lit(b"").alias("vec")), None
    if seen["top"] >= 1 << 53:
        raise ValueError("squared norms must be below 2^53, or scores would not be exact")
    kind, width = "<i2" if seen["most"] < 1 << 15 else "<i4" if seen["most"] < 1 << 31 else "<i8", max(1, seen["width"])

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: np.pad(np.asarray(v, kind), (0, width - len(v))).tobytes())

    return rows.select("vec_id", "label", pack("vector").alias("vec")), Shape(kind, width, float(seen["top"]), np.zeros((0, width + 1)), np.zeros((0, 0)))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """(vec, label, ids): rows of equal vector and label with their ``keep`` least ids. Ranks limit a group before it is shuffled."""
    first = Window.partitionBy("vec", "label").orderBy("vec_id")
    return rows.withColumn("r", F.dense_rank().over(first)).where(F.col("r") <= keep).groupBy("vec", "label").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))


def with_pivots(every: DataFrame, shape: Shape) -> Shape:
    """Pivots by k-means over the sample, and bounds of rings by the sample's distances, so that rings hold alike many."""
    n = every.count()
    sample = every.select("vec").orderBy(F.xxhash64("vec", F.lit(1)), "vec").limit(SAMPLE).toArrow()["vec"].to_pylist()
    m = shape.matrix(sample)
    a = np.hstack((m, np.sqrt(np.maximum(shape.top - (m * m).sum(1), 0))[:, None]))
    count = int(min(PIVOTS, max(1, n // 128), len(a)))
    pivots = a[np.random.default_rng(0).choice(len(a), count, replace=False)]
    for _ in range(8):
        near = shape._replace(pivots=pivots).stored(m).argmin(1)
        pivots = np.array([a[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(count)])
    own = shape._replace(pivots=pivots).stored(m)
    rings = int(min(RINGS, max(4, n // (count * 2 * BLOCK_ROWS))))
    share = np.arange(1, rings) / rings
    near = own.argmin(1)
    bounds = np.array([np.quantile(own[near == k, k], share) if (near == k).any() else np.quantile(own[:, k], share) for k in range(count)]).reshape(count, rings - 1)
    return shape._replace(pivots=pivots, bounds=bounds)


def stored(every: DataFrame, shape: Shape) -> DataFrame:
    """The index: blocks of classes (``ROWS``), sorted by (pivot, distance) and written."""
    held = every.sparkSession.sparkContext.broadcast(shape)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        for b in batches:
            d = s.stored(s.matrix(b["vec"].tolist()))
            pivot = d.argmin(1) if len(b) else np.zeros(0, int)
            yield b.assign(pivot=pivot, dist=d[np.arange(len(b)), pivot])

    def block(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, rings = held.value, held.value.bounds.shape[1] + 1
        waiting, at = [], None

        def flush() -> pd.DataFrame:
            b = pd.concat(waiting)
            sizes = b["ids"].map(len).to_numpy(np.int32)
            return pd.DataFrame([[at, b["dist"].min(), b["dist"].max(), len(b), b["label"].to_numpy(np.int64).tobytes(), sizes.tobytes(), np.concatenate(b["ids"].to_list()).astype(np.int64).tobytes(), b"".join(b["vec"])]], columns=common.names(ROWS))

        for b in batches:
            pivot = b["pivot"].to_numpy()
            cell = pivot * rings + (s.bounds[pivot] < b["dist"].to_numpy()[:, None]).sum(1)
            for _, part in b.groupby(np.cumsum(np.diff(cell, prepend=-1) != 0), sort=True):
                own = int(cell[b.index.get_loc(part.index[0])])
                if waiting and (own != at or sum(map(len, waiting)) >= BLOCK_ROWS):
                    yield flush()
                    waiting = []
                at = own
                waiting.append(part)
        if waiting:
            yield flush()

    keyed = every.mapInPandas(key, "vec binary, label long, ids array<long>, pivot int, dist double")
    order = ["pivot", "dist", "label", "vec"]
    return common.cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(block, ROWS))


class Rings(NamedTuple):
    """Every ring that holds something: number, interval, rows."""

    cell: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    n: np.ndarray


def rings_of(index: DataFrame) -> Rings:
    got = index.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).toArrow()  # PIVOTS x RINGS at most
    return Rings(*(got[c].to_numpy() for c in ("cell", "lo", "hi", "n")))


def reaches(shape: Shape, rings: Rings, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest distance from each query that rings' vectors can have."""
    own = shape.from_pivots(q, np.zeros(len(q)))[:, rings.cell // (shape.bounds.shape[1] + 1)]
    return np.maximum(np.maximum(rings.lo - own, own - rings.hi), 0) - shape.slack, own + rings.hi + shape.slack


def search(queries: DataFrame, index: DataFrame, shape: Shape, k: int, same: bool, first_rows: int = FIRST) -> DataFrame:
    """``FOUND``: of each query (qid, label, vec, low, high) the ``k`` best ids of its label, or of the others, with scores from low to high."""
    spark = queries.sparkSession
    held = spark.sparkContext.broadcast((shape, rings_of(index)))

    def widen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The next radius of each query; it stays where the answer is certain."""
        s, rings = held.value
        for b in batches:
            q = s.matrix(b["vec"].tolist())
            norms, done = (q * q).sum(1), b["radius"].to_numpy()
            near, far = reaches(s, rings, q)
            inner, outer = s.radius(norms, b["high"].to_numpy()) - s.slack, s.radius(norms, b["low"].to_numpy()) + s.slack
            live = far >= inner[:, None]
            order = np.argsort(near, 1)
            sorted_near, held_n = np.take_along_axis(near, order, 1), np.cumsum(np.take_along_axis(np.where(live, rings.n, 0), order, 1), 1)
            scanned = np.where(live & (near <= done[:, None]), rings.n, 0).sum(1)
            want = np.maximum(scanned * GROW, first_rows)
            at = np.minimum((held_n < want[:, None]).sum(1), near.shape[1] - 1)
            grown = np.maximum(np.maximum(sorted_near[np.arange(len(b)), at], inner), 0)
            sure = s.radius(norms, b["least"].to_numpy()) + s.slack
            goal = np.minimum(np.where(b["n"].to_numpy() >= k, sure, grown), outer)
            last = near.max(1)  # beyond it there is nothing
            yield b.assign(goal=np.where((done >= goal) | (done >= last), done, goal))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries of a batch by the rings that they scan now; a query's vector goes once for all its bands."""
        s, rings = held.value
        for b in batches:
            qid = b["qid"].to_numpy()
            _, first, at = np.unique(qid, return_index=True, return_inverse=True)
            q = s.matrix(b["vec"].iloc[first].tolist())
            near, far = reaches(s, rings, q)
            inner = s.radius((q * q).sum(1)[at], b["high"].to_numpy()) - s.slack
            need = (near[at] > b["radius"].to_numpy()[:, None]) & (near[at] <= b["goal"].to_numpy()[:, None]) & (far[at] >= inner[:, None])
            raw = np.array(b["vec"].iloc[first].tolist(), object)
            own, low, high, least = (b[c].to_numpy(np.int64) for c in ("label", "low", "high", "least"))
            out = []
            for c in np.flatnonzero(need.any(0)):
                rows = np.flatnonzero(need[:, c])
                used, to = np.unique(at[rows], return_inverse=True)
                out.append([int(rings.cell[c]), *(x[rows].tobytes() for x in (qid.astype(np.int64), low, high, least, own)), to.astype(np.int32).tobytes(), b"".join(raw[used])])
            if out:
                yield pd.DataFrame(out, columns=common.names(PACK))

    def best(qid, low, high, score, own_id) -> np.ndarray:
        order = np.lexsort((own_id, -score, high, low, qid))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(qid[order]) != 0) | (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0)
        starts = np.flatnonzero(new)
        return order[np.arange(len(order)) - starts[np.cumsum(new) - 1] < k] if len(order) else order

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value[0]
        kept, waiting = np.zeros((5, 0), np.int64), []

        def settle(kept: np.ndarray) -> np.ndarray:
            both = np.hstack([kept, *waiting])
            waiting.clear()
            return both[:, best(*both)]

        for batch in batches:
            for r in batch.itertuples(index=False):
                qid, low, high, least, own = (np.frombuffer(x, np.int64) for x in (r.qids, r.lows, r.highs, r.leasts, r.own))
                labels, sizes, ids = np.frombuffer(r.labels, np.int64), np.frombuffer(r.sizes, np.int32), np.frombuffer(r.ids, np.int64)
                score = (s.matrix(r.queries) @ s.matrix(r.vecs).T)[np.frombuffer(r.at, np.int32)]
                fits = ((own[:, None] == labels) == same) & (score >= np.maximum(low, least)[:, None]) & (score <= high[:, None])
                if score.shape[1] > k:
                    score = np.where(fits, score, -np.inf)
                    fits &= score >= np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k, None]
                row, col = np.nonzero(fits)
                if not len(row):
                    continue
                begin, many = np.cumsum(sizes) - sizes, sizes[col]
                inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                got = np.repeat(np.array([qid[row], low[row], high[row], score[row, col].astype(np.int64)]), many, 1)
                waiting.append(np.vstack((got, ids[np.repeat(begin[col], many) + inside])))
                if sum(w.shape[1] for w in waiting) > 1 << 20:
                    kept = settle(kept)
        kept = settle(kept)
        if kept.shape[1]:
            yield pd.DataFrame(dict(zip(common.names(FOUND), kept, strict=True)))

    key = ["qid", "low", "high"]
    state = "qid long, low long, high long, label long, vec binary, radius double, n int, least long"
    live = queries.select(*key, "label", "vec", F.lit(-1.0).alias("radius"), F.lit(0).alias("n"), F.lit(_ANY[0]).cast("long").alias("least"))
    found, spread = None, Window.partitionBy(*key).orderBy(F.desc("score"), "id")
    while True:
        asked = common.cut(live.repartition("qid").sortWithinPartitions("qid").mapInPandas(widen, f"{state}, goal double").where("goal > radius"))
        if asked.isEmpty():
            return found if found is not None else spark.createDataFrame([], FOUND)
        # Merged, as packs seem no larger than the few bytes of the table that they are made from, and would be broadcast.
        pairs = asked.mapInPandas(deal, PACK).join(index.drop("lo", "hi", "n").hint("merge"), "cell")
        new = pairs.mapInPandas(scan, FOUND)
        every = new if found is None else found.unionByName(new)
        found = common.cut(every.withColumn("r", F.row_number().over(spread)).where(F.col("r") <= k).drop("r"))
        reached = found.groupBy(*key).agg(F.count("*").cast("int").alias("n"), F.min("score").alias("least"))
        live = asked.drop("n", "least", "radius").withColumnRenamed("goal", "radius").join(reached.hint("merge"), key, "left")
        full = F.coalesce("n", F.lit(0)) >= k
        live = live.select(*key, "label", "vec", "radius", F.coalesce("n", F.lit(0)).alias("n"), F.when(full, F.col("least")).otherwise(_ANY[0]).cast("long").alias("least"))


OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(rows: DataFrame, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND, first_rows: int = FIRST) -> DataFrame:
    """``OUT``: hard negatives of each row for which ``anchor`` holds and of each of its positives. ``rows``: vec_id, label, vector of whole numbers."""
    spark = rows.sparkSession
    common.small_batches(spark)
    own, shape = packed(rows)
    if shape is None:
        return spark.createDataFrame([], OUT)
    own = common.cut(own)
    every = common.cut(classes(own, max(positives + 1, negatives)))
    shape = with_pivots(every, shape)
    index = stored(every, shape)
    anchors = own.where(anchor).distinct()
    queries = common.cut(anchors.select("vec", "label").distinct().withColumn("qid", F.monotonically_increasing_id()))
    anchors = common.cut(anchors.join(queries.hint("merge"), ["vec", "label"]).select("qid", F.col("vec_id").alias("anchor_id")))
    alike = search(queries.withColumns({"low": F.lit(_ANY[0]), "high": F.lit(_ANY[1])}), index, shape, positives + 1, True, first_rows)
    # A query's rows are positives + 1 at most, so an anchor that is among them still has its positives.
    best = alike.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x.id != F.col("anchor_id")), 1, positives)
    pairs = common.cut(anchors.join(best.hint("merge"), "qid").select("qid", "anchor_id", F.explode(others).alias("x")).select("qid", "anchor_id", F.col("x.id").alias("positive_id"), (-F.col("x.s")).alias("positive_score")))
    low, high = F.ceil(F.col("positive_score") * band[0] / F.lit(100).cast("decimal(3,0)")), F.floor(F.col("positive_score") * band[1] / F.lit(100).cast("decimal(3,0)"))
    bands = pairs.select("qid", "positive_score").distinct().select("qid", "positive_score", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low <= high")
    bands = common.cut(bands)
    unlike = search(bands.select("qid", "low", "high").distinct().join(queries.hint("merge"), "qid"), index, shape, negatives, False, first_rows)
    hard = unlike.groupBy("qid", "low", "high").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("hard"))
    met = pairs.join(bands.join(hard.hint("merge"), ["qid", "low", "high"]).hint("merge"), ["qid", "positive_score"])
    return met.select("anchor_id", "positive_id", "positive_score", F.posexplode("hard").alias("at", "x")).select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", (-F.col("x.s")).alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: hard negatives of every hundredth id of ``embeddings``; labels of every seventh id are off by one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(common.table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"), "embedding")
    return mine(rows, "vec_id % 100 = 0")


SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (select * from (select a, b, score, row_number() over (partition by a order by score desc, b) as r from s where same) where r <= 5),
neg as (select p.a, p.b, p.score as ps, n.b as n, n.score as ns, row_number() over (partition by p.a, p.b order by n.score desc, n.b) as r from pos p join s n on n.a = p.a and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score)
select a::bigint as anchor_id, b::bigint as positive_id, r::int as rank, n::bigint as negative_id, ps as positive_score, ns as negative_score from neg where r <= 10
"""


def brute_force(rows: list[tuple[int, int, list[int]]], anchors: set[int]) -> list[tuple]:
    """The same by every product. ``rows``: (vec_id, label, whole numbers), different ones."""
    width, out = max((len(v) for _, _, v in rows), default=0), []
    m = np.array([[*v, *[0] * (width - len(v))] for _, _, v in rows], object)
    for i, (a, own, _) in enumerate(rows):
        if a not in anchors:
            continue
        score = m @ m[i]
        order = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-score[j], rows[j][0]))
        for p in [j for j in order if rows[j][1] == own][:POSITIVES]:
            fit = [j for j in order if rows[j][1] != own and BAND[0] * score[p] <= 100 * score[j] <= BAND[1] * score[p]]
            out += [(a, rows[p][0], r + 1, rows[j][0], score[p], score[j]) for r, j in enumerate(fit[:NEGATIVES])]
    return sorted(out)
