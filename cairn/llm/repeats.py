"""Suffix-array dedup: bytes inside a 400-byte string that starts anywhere else are removed.

Two equal 400-byte strings have the same least 24-byte gram (by hash, leftmost) at the same place. So
each text is cut into anchors, the grams that are least in some 400-byte string (two in 377 bytes on
average), and an anchor's segment, the up to 776 bytes that 400-byte strings around it can cover.
Every match is found among the segments of one gram, with the grams in line:

* Segments that are equal (by 128-bit hash) are one row with a number; twice or more, all of it goes.
* A gram with several different segments gets a run-length index: the Burrows-Wheeler transform of
  its segments, in line, so that a suffix is ranked among those of the same gram and column (a text's
  own overlapping segments then never match themselves). It is built from the last column to the
  first. Inside a run of equal symbols, neighbours stay neighbours and their match grows by one; only
  at run ends is it sampled from the matches between them. The longer match with either neighbour is a
  position's matching statistic, streamed column by column; from 400 on it marks its bytes.
* A gram of more than ``CROWDED`` different segments is no index's load: its 400-byte strings are
  hashed (128 bits) and counted by Spark instead, which is exact and has no large group. There are few
  such grams; they are broadcast, and their segments are never brought together.

Scale: anchors of equal texts collapse map-side, so copies cost one row. The bytes of segments move
only where a gram has several. A segment that very many texts have meets its marks in several tasks,
and so does a 400-byte string that very many segments have.
Texts meet their spans by hash; a text's spans are bounded by its length.

Defined cases: an empty table gives an empty one; a null text is empty; texts under 400 bytes lose nothing; very long ones are read whole; equal rows are copies of each
other and lose every byte a 400-byte string covers; other columns pass, but ``repeats``,
which is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MATCH, GRAM = 400, 24
LEFT = MATCH - GRAM
WIDTH = LEFT + MATCH
CHUNK, ROWS, CROWDED = 1 << 19, 4096, 20_000
#: A segment of more anchors than this, and than a thousandth of all, meets its marks in several tasks; strings likewise.
HOT = 10_000
#: Segments of crowded grams in one part; fixed, as the engine sizes parts by their few bytes, not by their many strings.
DEALT = 1_000

_RNG = np.random.default_rng(5)
_VALUE = _RNG.integers(1, 1 << 63, (2, 256), np.uint64)
_BASE = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers() -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2**64, for a chunk."""
    if not _POWERS:
        n = CHUNK + 4 * WIDTH
        for base in _BASE:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                step = np.full(n, b, np.uint64)
                step[0] = 1
                both.append(np.multiply.accumulate(step))
            _POWERS.append(tuple(both))
    return _POWERS


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Polynomial hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        self.sums = []
        for k, (up, _) in enumerate(powers()):
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_VALUE[k][data] * up[: len(data)], out=total[1:])
            self.sums.append(total)

    def of(self, k: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[k][end] - self.sums[k][start]) * powers()[k][1][start] + (end - start).astype(np.uint64))


def sliding_least(values: np.ndarray, wide: int) -> np.ndarray:
    """The least value of each window of ``wide``: prefix and suffix minima of blocks."""
    n = -(-len(values) // wide) * wide
    x = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    x[: len(values)] = values
    x = x.reshape(-1, wide)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    behind = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: len(values) - wide + 1], ahead[wide - 1 : len(values)])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's anchors, the hashes of their grams, two hashes of their segments."""
    n, out, seen = len(data), [], np.empty(0, np.int64)
    every = np.frombuffer(data, np.uint8)
    for at in range(0, n - MATCH + 1, CHUNK):
        lo, hi = max(0, at - LEFT), min(n, at + CHUNK + WIDTH)
        h = Hashes(every[lo:hi])
        last = min(at + CHUNK, n - MATCH + 1)  # strings start before
        begin = np.arange(at - lo, last - lo + LEFT)
        grams = h.of(0, begin, begin + GRAM)
        # The position stands below the hash, so the leftmost of equal ones is least.
        place = np.unique(sliding_least((grams >> np.uint64(24) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64), LEFT + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
        p = place + at
        new = ~np.isin(p, seen)
        seen, place, p = p[-2 * WIDTH :], place[new], p[new]
        start, end = np.maximum(0, p - LEFT) - lo, np.minimum(n, p + MATCH) - lo
        shape = mix(((p - lo - start) * 4096).astype(np.uint64))
        out.append((p, grams[place], h.of(0, start, end) ^ shape, h.of(1, start, end) + shape))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 3)


def marked(symbols: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last marked column (end exclusive; equal if none) of each segment.

    ``symbols``: a row for each segment, the gram at column LEFT, 256 where the text has no byte;
    ``group``: ascending numbers of their grams.
    """
    n = len(symbols)
    order, length = np.arange(n), np.zeros(n + 1, np.int32)  # length: of the match with the one before
    lo, hi = np.full(n, WIDTH), np.zeros(n, np.int64)
    wide = group.astype(np.int64) * 257
    for column in range(WIDTH - 1, -1, -1):
        own = symbols[order, column]
        turn = np.argsort(wide[order] + own, kind="stable")  # the next column's order, by symbol
        order, own, old = order[turn], own[turn], length
        same = np.zeros(n, bool)
        same[1:] = (own[1:] == own[:-1]) & (group[order[1:]] == group[order[:-1]]) & (own[1:] < 256)
        length = np.zeros(n + 1, np.int32)
        inside = same.copy()
        inside[1:] &= turn[1:] == turn[:-1] + 1
        length[:-1][inside] = old[turn[inside]] + 1
        head = np.flatnonzero(same & ~inside)  # a run's end is next to another run's: sample
        if len(head):
            ends = np.column_stack((turn[head - 1] + 1, turn[head] + 1)).ravel()
            length[head] = np.minimum.reduceat(old, ends)[::2] + 1
        if column <= LEFT:
            best = np.maximum(length[:-1], length[1:])
            found = np.flatnonzero(best >= MATCH)
            rows = order[found]
            lo[rows] = column
            hi[rows] = np.maximum(hi[rows], column + best[found])
    return np.minimum(lo, hi), hi


def anchor_rows(docs: DataFrame) -> DataFrame:
    """(g, c1, c2, key, at, m): each anchor of each different text, and the number of texts' rows.

    ``at`` holds 32 more bits of the text's hash above the anchor's position.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for text, key, more in zip(batch["text"], batch["key"], batch["more"], strict=True):
                p, g, a, b = anchors(common.encode(text))
                if len(p):
                    parts.append((g.view(np.int64), a.view(np.int64), b.view(np.int64), np.full(len(p), key, np.int64), (np.int64(more) << np.int64(32)) | p))
            if parts:
                yield pd.DataFrame(dict(zip(("g", "c1", "c2", "key", "at"), map(np.concatenate, zip(*parts, strict=True)), strict=True)))

    rows = docs.select("text", "key", "more").where(F.octet_length("text") >= MATCH)
    return rows.mapInPandas(run, "g long, c1 long, c2 long, key long, at long").groupBy("g", "c1", "c2", "key", "at").agg(F.count("*").alias("m"))


def meet(rows: DataFrame, marks: DataFrame, keys: list[str], sizes: DataFrame, total: int) -> DataFrame:
    """``rows`` with the ``marks`` of their keys. ``sizes``: keys and n, their rows, of ``total``.

    The rows of a hot key meet copies of its marks in several tasks. At most a thousand keys are hot.
    """
    least = max(HOT, total // 1000)
    hot = F.broadcast(sizes.where(F.col("n") > least).select(*keys, (F.col("n") / least).cast("int").alias("salts")))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("salts") + 1).cast("int"), F.lit(0))
    dealt = rows.join(hot, keys, "left").withColumn("salt", salt).drop("salts")
    copied = marks.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(0))))).drop("salts")
    return dealt.join(copied, [*keys, "salt"]).drop("salt")


def segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(g, c1, c2, skip, bytes, k) of the anchors in ``wanted`` (g, c1, c2, key, at, k); skip: missing bytes to the left."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, own in zip(batch["text"], batch["own"], strict=True):
                data = common.encode(text)
                for x in own:
                    p = x["at"] & 0xFFFFFFFF
                    rows.append((x["g"], x["c1"], x["c2"], max(0, LEFT - p), data[max(0, p - LEFT) : p + MATCH], x["k"]))
            yield pd.DataFrame(rows, columns=["g", "c1", "c2", "skip", "bytes", "k"])

    by_text = wanted.groupBy("key", F.shiftright("at", 32).cast("int").alias("more")).agg(F.collect_list(F.struct("g", "c1", "c2", "at", "k")).alias("own"))
    met = docs.select("text", "key", "more").join(by_text.hint("shuffle_hash"), ["key", "more"]).select("text", "own")
    # Equal rows give equal segments; one is enough.
    return met.mapInPandas(run, "g long, c1 long, c2 long, skip int, bytes binary, k long").groupBy("g", "c1", "c2", "skip").agg(F.first("bytes").alias("bytes"), F.first("k").alias("k"))


def index_marks(found: DataFrame) -> DataFrame:
    """(c1, c2, lo, hi): marked columns of segments, by indexes over whole grams."""

    def marks(rows: list[tuple]) -> pd.DataFrame:
        symbols = np.full((len(rows), WIDTH), 256, np.int16)
        for k, (_, _, _, skip, data) in enumerate(rows):
            symbols[k, skip : skip + len(data)] = np.frombuffer(data, np.uint8)
        group = np.unique([r[0] for r in rows], return_inverse=True)[1]
        lo, hi = marked(symbols, group)
        own = np.flatnonzero(hi > lo)
        return pd.DataFrame({"c1": [rows[k][1] for k in own], "c2": [rows[k][2] for k in own], "lo": lo[own], "hi": hi[own]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                if len(held) >= ROWS and row[0] != held[-1][0]:
                    yield marks(held)
                    held = []
                held.append(row)
        if held:
            yield marks(held)

    # Grams are dealt whole and in order; CROWDED bounds the rows of one.
    return found.select("g", "c1", "c2", "skip", "bytes").repartition("g").sortWithinPartitions("g").mapInPandas(run, "c1 long, c2 long, lo int, hi int")


def strings(found: DataFrame, asked=None) -> DataFrame:
    """(w1, w2, c1, c2, lo): hashes and columns of all 400-byte strings of segments, or of those in the table ``asked``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for g, c1, c2, skip, data in batch[["g", "c1", "c2", "skip", "bytes"]].itertuples(index=False, name=None):
                h = Hashes(np.frombuffer(data, np.uint8))
                s = np.arange(len(data) - MATCH + 1)
                at = mix((s + skip + 1).astype(np.uint64))
                w1, w2 = (h.of(0, s, s + MATCH) ^ at).view(np.int64) ^ g, (h.of(1, s, s + MATCH) + at).view(np.int64)
                if asked is not None:
                    hit = common.held_in(asked.value, w1 & (common.SLOTS - 1))
                    s, w1, w2 = s[hit], w1[hit], w2[hit]
                if len(s):
                    rows.append(pd.DataFrame({"w1": w1, "w2": w2, "c1": c1, "c2": c2, "lo": (s + skip).astype(np.int32)}))
            if rows:
                yield pd.concat(rows)

    return found.mapInPandas(run, "w1 long, w2 long, c1 long, c2 long, lo int")


def counted_marks(found: DataFrame, cut) -> DataFrame:
    """The same by counting hashes of all 400-byte strings of the segments.

    A bitmap of fixed size, of strings that are found twice, spares most others the second look.
    """
    n, total = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("bytes") - (MATCH - 1)), F.lit(0))).first()
    found = cut(found.repartition(max(1, n // DEALT), "c1", "c2"))
    often = cut(strings(found).groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1"))
    asked = found.sparkSession.sparkContext.broadcast(common.bitmap(often.select(F.col("w1").bitwiseAND(common.SLOTS - 1).alias("slot"))))
    return cut(meet(strings(found, asked), often.select("w1", "w2"), ["w1", "w2"], often, total).groupBy("c1", "c2").agg(F.min("lo").alias("lo"), (F.max("lo") + MATCH).alias("hi")))


def spans(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """(key, more, spans): [start, end) of the bytes to remove. ``docs``: (text, key, more)."""
    held: list[str] = []
    cut = lambda df: common.cut(df, held)
    rows = cut(anchor_rows(docs))
    different = cut(rows.groupBy("g", "c1", "c2").agg(F.sum("m").alias("m"), F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")))
    several = different.groupBy("g").agg(F.count("*").alias("k")).where("k > 1")
    crowds = F.broadcast(several.where(F.col("k") > crowded))
    others = different.join(crowds, "g", "left_anti").join(several.where(F.col("k") <= crowded), "g")
    wanted = cut(different.join(crowds, "g").unionByName(others).select("g", "c1", "c2", "one.key", "one.at", "k"))
    found = cut(segments(docs, wanted))
    marks = cut(index_marks(found.where(F.col("k") <= crowded))).unionByName(counted_marks(found.where(F.col("k") > crowded), cut))
    twice = different.where("m > 1").select("c1", "c2", F.lit(0).alias("lo"), F.lit(WIDTH).alias("hi"))
    all_marks = marks.unionByName(twice).groupBy("c1", "c2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    place = F.col("at").bitwiseAND(0xFFFFFFFF) - LEFT
    hit = meet(rows, all_marks, ["c1", "c2"], different, rows.count()).select("key", F.shiftright("at", 32).cast("int").alias("more"), F.struct((place + F.col("lo")).alias("s"), (place + F.col("hi")).alias("e")).alias("x"))
    done = common.cut(hit.groupBy("key", "more").agg(F.collect_list("x").alias("spans")))
    common.discard(docs.sparkSession, held)
    return done


@common.shielded
def remove(docs: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """``docs`` with a column repeats: n_bytes, n_removed, n_spans, kept (the remaining bytes)."""
    common.small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("__key", F.xxhash64(text)).withColumn("__more", F.hash(text))
    found = spans(keyed.select("text", F.col("__key").alias("key"), F.col("__more").alias("more")), crowded)
    found = found.select(F.col("key").alias("__key"), F.col("more").alias("__more"), F.col("spans").alias("__spans"))

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut_out(texts: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for t, x in zip(texts, own, strict=True):
            data = common.encode(t)
            if x is None or not len(x):
                rows.append((len(data), 0, 0, data))
                continue
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, np.clip([s["s"] for s in x], 0, len(data)), 1)
            np.add.at(edge, np.clip([s["e"] for s in x], 0, len(data)), -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((len(data), len(data) - len(kept), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    met = keyed.join(found.hint("shuffle_hash"), ["__key", "__more"], "left")
    return met.withColumn("repeats", cut_out.asNondeterministic()("text", "__spans")).drop("__key", "__more", "__spans")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: removed bytes and a hash of the rest of every document, and whether it had a repeated passage."""
    done = remove(common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"))
    return done.select("doc_id", "repeats.n_bytes", "repeats.n_removed", "repeats.n_spans", F.sha2("repeats.kept", 256).alias("kept_sha256"), (F.col("repeats.n_removed") > 0).alias("repeated"))


def brute_force(texts: list[str | None]) -> list[tuple[int, int, int, str]]:
    """The same from a dictionary of all 400-byte strings."""
    data = [common.encode(t) for t in texts]
    times: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - MATCH + 1):
            times[d[i : i + MATCH]] = times.get(d[i : i + MATCH], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - MATCH + 1):
            if times[d[i : i + MATCH]] > 1:
                gone[i : i + MATCH] = True
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
