"""Byte-level BPE: distinct pieces are merged in length-bucketed padded numpy matrices.

A text is cut by the pattern, whose matches are encoded one by one. Pieces that a worker hasn't met
are put in matrices of rows of similar length; in each round every row merges its leftmost pair of
minimum rank, found through a hash table of pairs with linear probing, and is compacted. Rows without
a pair left leave the matrix. Pieces over ``LONGEST`` bytes, whose rounds would cost the square of
their length, go through a heap of pairs that merges in the same order.

The vocabulary's path is a parameter; each worker reads the file once. Encoded pieces are kept in a
worker's dictionary, which is emptied at ``MEMO`` entries. Row by row otherwise: no shuffle.

Defined cases: null and empty texts have no ids; repeated rows give repeated rows; very long texts are encoded whole; an empty table gives an empty one; text outside any
match of the pattern (none for the public pattern) is not encoded; other columns pass unread.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LONGEST, ROWS, MEMO = 512, 4096, 400_000
NONE = np.int64(1) << 40
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Pairs:
    """Open-addressing hash table from a pair of ids to the merged id, which is its rank."""

    def __init__(self, tokens: dict[bytes, int]):
        left, right, merged = [], [], []
        for token, rank in tokens.items():
            for k in range(1, len(token)):
                a, b = tokens.get(token[:k]), tokens.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys = np.full(1 << self.bits, ~np.uint64(0))
        self.ranks = np.full(1 << self.bits, NONE)
        values, slot, self.probes = np.array(merged, np.int64), self._slot(keys), 1
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == ~np.uint64(0))
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.ranks[slot[won]] = keys[won], values[won]
            rest = np.ones(len(keys), bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + 1) & (len(self.keys) - 1)
            self.probes += bool(len(keys))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NONE for those that don't merge or hold padding (-1)."""
        shape = a.shape
        keys = ((a.ravel().astype(np.uint64) << np.uint64(32)) | (b.ravel().astype(np.uint64) & np.uint64(0xFFFFFFFF)))
        out = np.full(keys.shape, NONE)
        open_ = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot = self._slot(keys[open_])
        for _ in range(self.probes):
            if not len(open_):
                break
            held = self.keys[slot]
            found = held == keys[open_]
            out[open_[found]] = self.ranks[slot[found]]
            more = ~found & (held != ~np.uint64(0))
            open_, slot = open_[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out.reshape(shape)


class Codec:
    """Encodes and decodes by the ranks of one file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
        self.bytes = {rank: token for token, rank in self.tokens.items()}
        self.pairs = Pairs(self.tokens)
        self.single = np.array([self.tokens[bytes([b])] for b in range(256)], np.int64)
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, tuple[int, ...]] = {}

    def _rounds(self, pieces: list[bytes]) -> list[list[int]]:
        """Merge pieces of similar length, all rows in each round."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        wide = int(size.max())
        ids = np.full((len(pieces), wide), -1, np.int64)
        here = np.arange(wide) < size[:, None]
        ids[here] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        row, out = np.arange(len(pieces)), [[]] * len(pieces)
        ranks = self.pairs.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(row), np.int64)
            best = ranks[np.arange(len(row)), at] if ranks.shape[1] else np.full(len(row), NONE)
            done = best >= NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k, : size[k]].tolist()
                go = ~done
                row, ids, ranks, size, at, best = row[go], ids[go], ranks[go], size[go], at[go], best[go]
                if not len(row):
                    break
            # Compaction: what stands right of the merged pair moves one place to the left.
            n = np.arange(len(row))
            column = np.arange(ids.shape[1] - 1)
            moved = column > at[:, None]
            ids = np.where(moved, ids[:, 1:], ids[:, :-1])
            ids[n, at] = best
            size = size - 1
            ranks = np.where(column[: ranks.shape[1] - 1] > at[:, None], ranks[:, 1:], ranks[:, :-1]) if ranks.shape[1] > 1 else ranks[:, :0]
            # Only the two pairs that the new id is in have changed.
            if ranks.shape[1]:
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.pairs.rank(ids[left, at[left] - 1], ids[left, at[left]])
                right = np.flatnonzero(at < ranks.shape[1])
                ranks[right, at[right]] = self.pairs.rank(ids[right, at[right]], ids[right, at[right] + 1])
            if size.max() < ids.shape[1]:
                ids, ranks = ids[:, : size.max()], ranks[:, : max(0, size.max() - 1)]
        return out

    def _long(self, piece: bytes) -> list[int]:
        """The same order of merges through a heap: (rank, place) of each live pair."""
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        parts = [piece[i : i + 1] for i in range(len(piece))]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        get = self.tokens.get
        heap = [(r, i) for i in range(len(ids) - 1) if (r := get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(parts[i] + parts[j]) != rank:
                continue
            ids[i], parts[i], ids[j] = rank, parts[i] + parts[j], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [x for x in ids if x >= 0]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        out: list[list[int]] = [[]] * len(pieces)
        short = []
        for k, p in enumerate(pieces):
            if (rank := self.tokens.get(p)) is not None:
                out[k] = [rank]
            elif len(p) > LONGEST:
                out[k] = self._long(p)
            elif p:
                short.append(k)
        short.sort(key=lambda k: len(pieces[k]))
        while short:
            # A bucket: rows of up to a quarter more than the shortest's length, in matrices of bounded size.
            least = len(pieces[short[0]])
            most = max(least + 1, least * 5 // 4)
            end = 0
            while end < min(len(short), max(1, ROWS * 32 // most)) and len(pieces[short[end]]) <= most:
                end += 1
            for k, ids in zip(short[:end], self._rounds([pieces[k] for k in short[:end]]), strict=True):
                out[k] = ids
            short = short[end:]
        return out

    def encode_batch(self, texts) -> list[list[int]]:
        """Ids of each text."""
        found = [self.find(t) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = list({p for pieces in found for p in pieces if p not in self.memo})
        for p, ids in zip(new, self.merge([common.encode(p) for p in new]), strict=True):
            self.memo[p] = tuple(ids)
        get = self.memo.__getitem__
        out = []
        for pieces in found:
            ids: list[int] = []
            for x in map(get, pieces):
                ids += x
            out.append(ids)
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec for each worker process and file."""
    return Codec(path, pattern)


def public(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[str, str]:
    """Path and pattern of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str, pattern: str, name: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text``."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf("array<int>")
    def ids(text: pd.Series) -> pd.Series:
        return pd.Series([np.array(x, np.int32) for x in codec(path, pattern).encode_batch(text)], dtype=object)

    return docs.withColumn(name, ids.asNondeterministic()("text"))


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes of ``ids``; null ids are empty."""

    @F.pandas_udf("binary")
    def text(found: pd.Series) -> pd.Series:
        c = codec(path, pattern)
        return pd.Series([b"" if x is None else c.decode(x.tolist()) for x in found])

    return tokens.withColumn(name, text(ids))


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, number of ids, hashes of the ids and of the bytes decoded from them."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf(DIGEST)
    def digest(text: pd.Series) -> pd.DataFrame:
        c = codec(path, pattern)
        rows = []
        for ids in c.encode_batch(text):
            packed = np.array(ids, "<u4").tobytes()
            back = c.decode(np.frombuffer(packed, "<u4").tolist())
            rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()))
        return pd.DataFrame(rows, columns=common.names(DIGEST))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest.asNondeterministic()("text").alias("d")).select("doc_id", "d.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: ids and round trip of every document."""
    return digests(common.table(spark, sf_dir, "documents"), *public())
