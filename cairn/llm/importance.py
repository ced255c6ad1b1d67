"""Target-distribution importance resampling with hashed n-grams.

Features of a text are its runs of 1 to ``DEPTH`` words, repeats counted, in ``BUCKETS`` buckets by CRC-32. A bucket's
gain is the log of how much more often, with add-one smoothing, the target holds it than the corpus; a
document's weight is the mean gain of its features. Gumbel noise from the document's id turns the highest scores
into a draw without replacement in proportion to the weights' exponentials.

Words become ids, batch by batch in each partition, and a suffix array of the batch's ids, to the depth
of ``DEPTH`` words, brings equal n-grams together: suffixes whose longest common prefix with the one before has d words or more
continue the run of an n-gram of d words. Each run is hashed once, going on from the hash of its first d - 1 words,
and its bucket is scattered back to the run's places in the texts.

Scale: two map-only passes read the texts (corpus counts, scores). Counts leave a partition as ``BUCKETS`` rows at most and
are summed by Spark, so the driver and each task get ``BUCKETS`` numbers, whatever the input. Ranks come from a range
sort that is written once: each row's place in its partition plus the sizes of the partitions before,
so no task sees all rows. Memory is bounded by a batch or by the longest text.

Defined cases: a null, empty or wordless text has no features and weight 0; so has every text if there are
no documents with words; an empty target leaves T and all t at 0; repeated rows count and are drawn each; a null doc_id
hashes as the empty text and is last among ties, of which rows alike in score and id go by features and weight; very long
texts are read whole; other columns pass, but importance, score and rank, which are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DEPTH, BUCKETS, SEED = 2, 10_000, 7
#: Documents of fewer words aren't drawn; so many in a hundred of the others are.
LEAST_WORDS, DRAW = 20, 25
#: Gains and scores are whole thousandths.
UNIT = 1000


def suffixes(ids: np.ndarray, depth: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Suffix array of word ids to so many words, the words of each place (0 from a text's end on), and common prefixes of neighbours.

    ``ids`` has a 0 after each text. The prefix of the first suffix counts as 0.
    """
    words = [ids]
    for d in range(1, depth):
        ahead = np.zeros_like(ids)
        ahead[:-d] = ids[d:] if len(ids) > d else 0
        words.append(np.where(words[-1] == 0, 0, ahead))
    key, base = ids.astype(np.int64), int(ids.max(initial=0)) + 1
    for w in words[1:]:
        if len(key) and int(key.max()) >= (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + w
    order = np.argsort(key, kind="stable")
    shared, same = np.zeros(len(ids), np.int64), np.ones(max(len(ids) - 1, 0), bool)
    for w in words:
        own = w[order]
        same &= (own[1:] == own[:-1]) & (own[1:] != 0)
        shared[1:] += same
    return order, words, shared


def hashed(texts, depth: int = DEPTH, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each depth the bucket at each place, or -1 where a text has no such n-gram any more; and where each text begins."""
    found = [common.words(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)))
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    vocabulary[b""]  # the end of a text; no word is empty
    flat: list[bytes] = []
    for x in found:
        flat += x
        flat.append(b"")
    ids = np.fromiter(map(vocabulary.__getitem__, flat), np.int64, len(flat))
    order, words, shared = suffixes(ids, depth)
    plain = list(vocabulary)
    joined = [b" " + w for w in plain]
    out, before = [], np.zeros(len(ids), np.int64)
    for d, w in enumerate(words):
        first = np.flatnonzero((shared <= d) & (w[order] != 0))  # where a run of n-grams of d + 1 words begins
        run = np.cumsum((shared <= d) & (w[order] != 0)) - 1
        at = order[first]
        said = joined if d else plain
        crc = np.fromiter((zlib.crc32(said[i], c) for i, c in zip(w[at].tolist(), before[at].tolist(), strict=True)), np.int64, len(at))
        state = np.full(len(ids), -1, np.int64)
        live = w[order] != 0
        state[order[live]] = crc[run[live]]
        before = state
        out.append(np.where(state < 0, -1, state % buckets))
    return out, begins


def counts(texts: DataFrame, depth: int = DEPTH, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (column ``text``) each bucket holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in hashed(batch["text"], depth, buckets)[0]:
                total += np.bincount(b[b >= 0], minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    common.small_batches(texts.sparkSession)
    summed = texts.select("text").mapInPandas(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[summed["bucket"].to_numpy()] = summed["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, by bucket."""
    n, far, near = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(UNIT * math.log((t + 1.0) * (far + n) / ((s + 1.0) * (near + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


@common.shielded
def weighed(docs: DataFrame, target: DataFrame, depth: int = DEPTH, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` and a column ``importance``: n_words, n_features and weight of the text."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(gains(counts(docs, depth, buckets), counts(target, depth, buckets)))  # ``buckets`` numbers

    @F.pandas_udf("n_words long, n_features long, weight long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        gain = np.append(held.value, 0)  # the last is for -1
        for batch in batches:
            found, begins = hashed(batch, depth, buckets)
            total = sum(np.concatenate(([0], np.cumsum(gain[b]))) for b in found)
            n = sum(np.concatenate(([0], np.cumsum(b >= 0))) for b in found)
            features, sums = np.diff(n[begins]), np.diff(total[begins])
            yield pd.DataFrame({"n_words": np.diff(begins) - 1, "n_features": features, "weight": np.where(features > 0, sums // np.maximum(features, 1), 0)})

    return docs.withColumn("importance", run(F.col("text")))


def scored(docs: DataFrame, target: DataFrame, seed: int = SEED) -> DataFrame:
    """``weighed`` with a column ``score``: the weight and the id's Gumbel noise, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-UNIT * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed(docs, target).withColumn("score", F.col("importance.weight") + noise)


@common.shielded
def ranked(rows: DataFrame, among: str, draw: int = DRAW) -> DataFrame:
    """``rows`` (doc_id, importance, score) and ``rank``: 1, 2, ... of the ``draw`` in a hundred highest scores of those that ``among`` holds for, else null.

    The rows are sorted by ranges and written once; a row's rank is its place in its partition and the
    rows of those before, of which the driver gets a number each.
    """
    rows = common.cut(rows.withColumn("__in", F.expr(among)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("importance.n_features"), F.col("importance.weight")]
    at = F.monotonically_increasing_id()
    dealt = common.cut(rows.where("__in").repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at))
    sizes = dealt.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    total, first = sum(r["n"] for r in sizes), 0
    base = {}
    for r in sizes:
        base[r["part"]], first = first, first + r["n"]
    spark = rows.sparkSession
    begin = F.broadcast(spark.createDataFrame(list(base.items()), "__part long, __begin long"))  # a row for each partition
    placed = dealt.withColumn("__part", F.shiftright("__at", 33)).join(begin, "__part")
    rank = F.col("__begin") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    inside = placed.withColumn("rank", F.when(rank <= draw * total // 100, rank)).drop("__part", "__begin", "__at", "__in")
    outside = rows.where("not coalesce(__in, false)").withColumn("rank", F.lit(None).cast("long")).drop("__in")
    return inside.unionByName(outside)


def resample(docs: DataFrame, target: DataFrame, draw: int = DRAW) -> DataFrame:
    """The rows of ``docs`` that are drawn, with what ``scored`` and ``ranked`` add."""
    return ranked(scored(docs, target), f"importance.n_words >= {LEAST_WORDS}", draw).where("rank is not null")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: features, weight, score and rank of every document, ``benchmark`` being the target."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = scored(docs, common.table(spark, sf_dir, "benchmark")).drop("text")
    done = ranked(rows, f"importance.n_words >= {LEAST_WORDS}")
    return done.select("doc_id", "importance.n_features", "importance.weight", "score", "rank")


def brute_force(docs: list[tuple[int | None, str | None]], target: list[str | None]) -> list[tuple]:
    """The same from dictionaries of whole n-grams."""
    import hashlib

    def features(text: str | None) -> list[int]:
        w = common.words(text)
        return [zlib.crc32(b" ".join(w[i : i + d])) % BUCKETS for d in range(1, DEPTH + 1) for i in range(len(w) - d + 1)]

    s, t = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for _, x in docs:
        np.add.at(s, features(x), 1)
    for x in target:
        np.add.at(t, features(x), 1)
    gain, rows = gains(s, t), []
    for i, x in docs:
        f = features(x)
        weight = int(gain[f].sum()) // len(f) if f else 0
        h = int(hashlib.sha256(f"{SEED}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(common.words(x)) >= LEAST_WORDS])
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    place = {id(r): k + 1 for k, r in enumerate(order) if k < DRAW * len(order) // 100}
    return [(*r[:4], place.get(id(r))) for r in rows]


#: Each step of a CRC-32 takes eight shifts of a byte; ``crc`` sums up the bytes of a text that comes as hexadecimal digits.
SQL = r"""
with recursive eight(i, k, c) as (select i, 0, i::bigint from range(256) r(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from eight where k < 8),
steps as (select list(c order by i) as tab from eight where k = 8),
dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
df as (select doc_id, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) as f from dw),
bf as (select unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]))) as f from bw),
both_f as (select f, sum(s) as s, sum(t) as t from (select f, count(*) as s, 0 as t from df group by f union all select f, 0, count(*) from bf group by f) group by f),
crc as (select f, s, t, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(generate_series(1, length(hex(encode(f))) // 2), lambda i: ('0x' || substr(hex(encode(f)), 2 * i - 1, 2))::bigint)),
  lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket from both_f, steps),
held as (select bucket, sum(s) as s, sum(t) as t from crc group by bucket), whole as (select sum(s)::double as s, sum(t)::double as t from held),
gain as (select bucket, floor(1000 * ln((h.t + 1.0::double) * (w.s + 10000) / ((h.s + 1.0::double) * (w.t + 10000))))::bigint as g from held h, whole w),
sums as (select doc_id, count(*) as n, sum(g) as g from df join crc using (f) join gain using (bucket) group by doc_id),
noise as (select doc_id, len(w) as n_words, ('0x' || left(sha256('7:' || doc_id), 8))::bigint as h from dw),
scored as (select cast(doc_id as bigint) as doc_id, n_words, coalesce(n, 0) as n_features, coalesce(floor(g / n::double), 0)::bigint as weight, coalesce(floor(g / n::double), 0)::bigint + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from noise left join sums using (doc_id)),
placed as (select doc_id, row_number() over (order by score desc, doc_id) as r, count(*) over () as n from scored where n_words >= 20)
select s.doc_id, s.n_features::bigint as n_features, s.weight, s.score, case when r <= 25 * p.n // 100 then r end as rank from scored s left join placed p using (doc_id)
"""
