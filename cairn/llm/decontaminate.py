"""Benchmark decontamination: a prefix-filtered containment join of item windows and documents.

A window is a run of 13 consecutive words of an item; an item of fewer words, but not none, is one
window. A window counts as a set of positioned shingles (five words, or the whole of a window of
fewer). As a document must contain all of them, a prefix of one shingle is enough: the rarest in all
documents. Windows and documents are joined on that shingle; then the positional bound (the window
starts at the shingle's place less its place in the window, not before the text) and the length bound
(it ends within the text) apply, and the words before, in and after the shingle are compared. Words
inside any occurrence are hit.

Scale: two passes read the documents' texts. One counts their shingles that may be an item's, with
map-side sums; the counts go back to the items' texts, and windows with a shingle that no document has
go. The other gives each place of a chosen shingle with the eight words on both sides, once a different
text. A bitmap of fixed size says which shingles are asked for; what it lets through in vain finds
nothing in the join. Both sides are tables, so items may be of any number; Spark broadcasts the windows
if they are few and shuffles by shingle if not. Windows that the same item texts have are one kind, and a
text meets each kind's items once. Documents meet what was found by the text's hash.

Defined cases: a null or empty text has no words and is clean; null items have no windows; equal
windows of several items count for each; items of one id count once; a null item_id is an id of its
own, the empty string; repeated documents give repeated rows; very long texts
are read whole; no documents give none, and no items leave all clean; other columns pass unread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, SHINGLE = 13, 5
#: Words on each side of a shingle that a window may have.
REACH = WINDOW - SHINGLE
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Words whose hashes a task remembers.
MEMO = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words by word, made when asked for; 0 stands for the end of a text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = found = (xxhash.xxh3_64_intdigest(word) or 1) if word else 0
        return found


def shingle_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` word hashes."""
    out = np.full(len(ids) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ ids[k : len(ids) - size + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(common.SLOTS - 1)).astype(np.int64)


def shingles(texts, sizes: list[int], known: WordHashes) -> tuple[list[bytes], np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Words of all texts, an empty one after each; where each text begins; places and hashes of the shingles by size."""
    flat: list[bytes] = []
    begins = [0]
    for text in texts:
        flat += common.words(text)
        flat.append(b"")
        begins.append(len(flat))
    ids = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    ends = np.concatenate(([0], np.cumsum(ids == 0)))
    out = []
    for size in sizes:
        if len(ids) >= size:
            at = np.flatnonzero(ends[size:] == ends[:-size])
            out.append((size, at, shingle_hashes(ids, size)[at]))
    return flat, np.array(begins), out


def framed(words: list[bytes]) -> bytes:
    """The words with a blank before each and after the last."""
    return b" ".join([b"", *words, b""])


def item_shingles(texts: DataFrame) -> DataFrame:
    """(key, size, at, h) of each shingle of the items' texts (key, text); a text has shingles of one size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for key, text in zip(batch["key"], batch["text"], strict=True):
                size = min(SHINGLE, len(common.words(text)))
                if size:
                    _, at, h = shingles([text], [size], known)[2][0]
                    yield pd.DataFrame({"key": key, "size": size, "at": at, "h": h.view(np.int64)})

    return texts.mapInPandas(run, "key string, size int, at int, h long")


def document_counts(docs: DataFrame, sizes: list[int], asked) -> DataFrame:
    """(h, n): how often the shingles in the bitmap ``asked``, and some others, are found in all documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for _, _, h in shingles(batch["text"], sizes, known)[2]:
                own, n = np.unique(h[common.held_in(asked.value, slots(h))], return_counts=True)
                if len(own):
                    yield pd.DataFrame({"h": own.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixed_windows(counted: DataFrame) -> DataFrame:
    """Windows of the items' texts (key, text, own: array of (at, n)) with their rarest shingle.

    Ties go by hash, then by place. ``before``, ``middle`` and ``after`` are the words about the shingle. Windows
    with a shingle that is nowhere in the documents are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            for key, text, own in zip(batch["key"], batch["text"], batch["own"], strict=True):
                words = common.words(text)
                size, wide = min(SHINGLE, len(words)), min(WINDOW, len(words))
                _, _, h = shingles([text], [size], known)[2][0]
                n = np.zeros(len(h), np.int64)
                n[[x["at"] for x in own]] = [x["n"] for x in own]
                rank = np.empty(len(h), np.int64)
                rank[np.lexsort((h, n))] = np.arange(len(h))
                held = np.lib.stride_tricks.sliding_window_view(n, wide - size + 1).min(axis=1) > 0
                first = np.lib.stride_tricks.sliding_window_view(rank, wide - size + 1).argmin(axis=1)
                starts = np.flatnonzero(held)
                for lo in range(0, len(starts), 50_000):
                    rows = []
                    for i in starts[lo : lo + 50_000].tolist():
                        at = i + int(first[i])
                        rows.append((key, int(h.view(np.int64)[at]), wide, at - i, framed(words[i:at]), b" ".join(words[at : at + size]), framed(words[at + size : i + wide])))
                    yield pd.DataFrame(rows, columns=["key", "h", "n", "at", "before", "middle", "after"])

    return counted.mapInPandas(run, "key string, h long, n int, at int, before binary, middle binary, after binary")


def document_places(docs: DataFrame, sizes: list[int], asked) -> DataFrame:
    """Each place ``q`` of the shingles in the bitmap ``asked``, and of some others, with the words about it.

    A shingle of fewer than five words is a whole window, so it needs no words about it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        for batch in batches:
            keys = batch["key"].tolist()
            flat, begins, found = shingles(batch["text"], sizes, known)
            for size, at, h in found:
                hit = common.held_in(asked.value, slots(h))
                at, h = at[hit], h[hit].view(np.int64)
                reach = REACH if size == SHINGLE else 0
                doc = np.searchsorted(begins, at, "right") - 1
                for some in range(0, len(at), 50_000):
                    rows = []
                    for q, hash_, d in zip(*(x[some : some + 50_000].tolist() for x in (at, h, doc)), strict=True):
                        lo, hi = int(begins[d]), int(begins[d + 1]) - 1
                        rows.append((keys[d], hash_, q - lo, hi - lo, framed(flat[max(lo, q - reach) : q]), b" ".join(flat[q : q + size]), framed(flat[q + size : min(hi, q + size + reach)])))
                    yield pd.DataFrame(rows, columns=["key", "h", "q", "words", "left", "said", "right"])

    return docs.select(common.text_key().alias("key"), "text").mapInPandas(run, "key string, h long, q int, words int, left binary, said binary, right binary")


def occurrences(docs: DataFrame, texts: DataFrame, cut) -> tuple[DataFrame, DataFrame]:
    """(key, id, start, end) of all windows in all texts of ``docs``, and (id, item_key): the items' texts a window is of."""
    sc = docs.sparkSession.sparkContext
    own = cut(item_shingles(texts))
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())  # five at most
    asked = sc.broadcast(common.bitmap(own.select(F.col("h").bitwiseAND(common.SLOTS - 1).alias("slot"))))
    counted = own.join(document_counts(docs, sizes, asked), "h").groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("own"))
    prefixed = prefixed_windows(texts.join(counted, "key").select("key", "text", "own"))
    prefixed = cut(prefixed.withColumn("id", F.md5(F.concat("before", "middle", "after"))))
    asked.destroy()
    windows = cut(prefixed.drop("key").dropDuplicates(["id"]))
    asked = sc.broadcast(common.bitmap(windows.select(F.col("h").bitwiseAND(common.SLOTS - 1).alias("slot"))))
    places = document_places(docs, sizes, asked).dropDuplicates(["key", "q", "h"])
    bounds = (F.col("q") >= F.col("at")) & (F.col("q") - F.col("at") + F.col("n") <= F.col("words"))
    same = (F.col("said") == F.col("middle")) & F.endswith("left", "before") & F.startswith("right", "after")
    met = places.join(windows, "h").where(bounds & same)
    met = met.select("key", "id", (F.col("q") - F.col("at")).alias("start"), (F.col("q") - F.col("at") + F.col("n")).alias("end"))
    met = cut(met)
    asked.destroy()
    return met, prefixed.select("id", F.col("key").alias("item_key")).distinct()


def found_items(met: DataFrame, claims: DataFrame, items: DataFrame) -> DataFrame:
    """(key, items): sorted ids of the items whose windows a text has."""
    # Windows of the same item texts are one kind, named by its least window.
    kinds = claims.groupBy("id").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("item_key")).alias("x"), F.bit_xor(F.xxhash64("item_key", F.lit(1))).alias("y"))
    least = kinds.groupBy("n", "x", "y").agg(F.min("id").alias("kind"))
    kind = kinds.join(least, ["n", "x", "y"]).select("id", "kind")
    owners = claims.join(kind.where("id = kind"), "id").join(items, "item_key").select("kind", "item").distinct()
    of_text = met.select("key", "id").distinct().join(kind, "id").select("key", "kind").distinct()
    return of_text.join(owners, "kind").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))


def word_counts(texts: pd.Series) -> pd.Series:
    return pd.Series([len(common.words(t)) for t in texts], dtype="int64")


def merged(spans: pd.Series) -> pd.DataFrame:
    """Spans of one text, merged where they meet."""
    rows = []
    for own in spans:
        starts, ends = [], []
        for start, end in sorted((x["start"], x["end"]) for x in own):
            if ends and start <= ends[-1]:
                ends[-1] = max(ends[-1], end)
            else:
                starts.append(start)
                ends.append(end)
        rows.append((starts, ends))
    return pd.DataFrame(rows, columns=["starts", "ends"])


@common.shielded
def scan(docs: DataFrame, benchmark: DataFrame, name: str = "found") -> DataFrame:
    """``docs`` with a column ``name``: struct of n_words, merged hit spans (starts, ends), item ids."""
    common.small_batches(docs.sparkSession)
    held: list[str] = []
    cut = lambda df: common.cut(df, held)
    said = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    said = said.withColumn("item_key", common.text_key())
    texts = said.groupBy(F.col("item_key").alias("key")).agg(F.first("text").alias("text"))
    met, claims = occurrences(docs, texts, cut)
    items = found_items(met, claims, said.select("item", "item_key").distinct())
    spans = met.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("spans")).withColumn("x", F.pandas_udf(merged, "starts array<int>, ends array<int>")("spans"))
    found = common.cut(spans.join(items, "key").select(F.col("key").alias("__k"), F.struct("x.starts", "x.ends", "items").alias("__f")))
    common.discard(docs.sparkSession, held)
    both = docs.withColumn("__k", common.text_key()).join(found, "__k", "left")
    none = lambda c, kind: F.coalesce(F.col("__f")[c], F.array().cast(f"array<{kind}>")).alias(c)
    n_words = F.pandas_udf(word_counts, "long")("text").alias("n_words")
    return both.select(*[F.col(f"`{c}`") for c in docs.columns if c != name], F.struct(n_words, none("starts", "int"), none("ends", "int"), none("items", "string")).alias(name))


def n_hit(found="found"):
    c = F.col(found)
    return F.aggregate(F.zip_with(c["starts"], c["ends"], lambda a, b: (b - a).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contaminated(found="found"):
    return (n_hit(found) > 0) & (SHARE * n_hit(found) >= F.col(found)["n_words"])


@common.shielded
def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones."""
    return scan(docs, benchmark, name="__found").where(~contaminated("__found")).drop("__found")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: hit words and items of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = scan(docs, common.table(spark, sf_dir, "benchmark"))
    items = F.array_join("found.items", ",")
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), "found.n_words", n_hit().alias("n_hit"), F.size("found.items").cast("bigint").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), contaminated().alias("contaminated"))


def brute_force(text: str | None, items: list[tuple[str, str | None]]) -> tuple[int, int, int, str, bool]:
    """The same by comparing every window with every place."""
    own, hit, ids = common.words(text), set(), set()
    for item, said in items:
        it = common.words(said)
        for at in range(max(0, len(it) - WINDOW) + 1) if it else ():
            w = it[at : at + WINDOW]
            for q in range(len(own) - len(w) + 1):
                if own[q : q + len(w)] == w:
                    hit |= {*range(q, q + len(w))}
                    ids.add(item)
    return len(own), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and SHARE * len(hit) >= len(own)


#: Words, windows and hits of documents in DuckDB; ``documents`` may be another relation.
SQL = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), bw as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select distinct item, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as s
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 12, 1))) as i from bw where len(w) > 0)
), places as (
  select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as s
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from dw, (select distinct n from win) where len(w) >= n)
), hits as (select p.doc_id, p.i, p.n, v.item from places p join win v on p.s = v.s and p.n = v.n),
words as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as k from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hits) group by doc_id)
select cast(d.doc_id as bigint) as doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(d.w) as contaminated
from dw d left join words using (doc_id) left join items using (doc_id)
"""
