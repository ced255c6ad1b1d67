"""Line dedup: an exact set-similarity join of lines; later matches go.

A line's set holds the distinct words of a \\n-split line; lines without a word stay. Lines stand in
the order of doc_id (null first), text hash, line number. A line goes if an earlier one has a set of
Jaccard similarity 4/5 or more. So a line stays if it is the first of its set and no other set that is
similar enough begins earlier; that is decided on distinct sets, so copies are one row.

The join orders a set's words by rarity (counts over all lines in ``BUCKETS`` hash buckets, a table of
fixed size: any order is right, a rarer first is faster) and keeps the prefix that any partner must
share a word of. Words that no other line has are left out of it. A prefix word of more than
``HOT_LEAST`` lines (or ``HOT`` times the mean bucket count) is no key by itself: sets that share such a
word as their first common one share a second (and third) in a prefix longer by one (or two), so the
pair or triple of words is the key: the pair where its words' counts make it rare enough, else the
triple. Prefix rows are dealt by key once, packed: a task sorts its rows in numpy and tests the pairs
of each key's run by length, by position, and by a 64-bit odd sketch (the parity of a set's words by
hash), which similar sets always pass; pairs of long sets by a sketch of 512 bits too. What passes is
verified on whole sets, which are read again from the lines that candidates name.

A run in which more than ``DENSE`` pairs a row pass (a group of near copies), or which is larger than
``RUN``, gives no pairs of its own at first: each of its sets meets the run's first set only; what is
similar to it goes and needs no other partner. The run's rows are kept, and those sets that are left
meet all others of the run in a join. So a group of copies makes rows in proportion to its size, and
no link that decides is lost.

Scale: word counts and prefixes are two map-only passes. A line is dealt by set once a batch, so a line
that a third of all texts have is no hot group. Keys are dealt over as many parts as their bytes need;
a part of more than ``PART_BYTES``, as one key's run may make it, is taken in pieces, whose rows all
meet in the join, so memory is bounded. The lines that stay meet their texts by text hash.

Defined cases: a null text stays null and has no lines; empty lines stay; equal rows (doc_id and
text) are one document, treated alike; a document that loses all lines has an empty text; an empty
table gives an empty one; other columns are kept, whatever their names, and n_chars, where there is
one, counts the new text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .jaccard import word_hash

NUMERATOR, DENOMINATOR = 4, 5
BUCKETS, SLICE = 1 << 22, 1 << 16
HOT, HOT_LEAST = 1, 800
#: Smaller sets have no similar sets but equal ones.
LEAST = 4
#: Rows of a run whose pairs are tested at once; passing pairs a row from which a run counts as dense.
RUN, DENSE = 2000, 4
#: Bytes of prefix rows that a task sorts at once, and that a part should have.
PART_BYTES, PART_WANTED = 192 << 20, 64 << 20
#: Pairs that are tested at once.
TESTED = 1 << 18
#: Bytes of texts in one Arrow batch: words, places and keys take about fifty times that.
BATCH_BYTES = 1 << 20
#: Hashes of texts that are broadcast.
BROADCAST_KEYS = 100_000
#: Words of more bytes are hashed one by one.
LONG = 1024

#: Bits of a position: a prefix is about a fifth of fewer than 2^31 words.
_PLACE = 29
_MASK = np.uint64(BUCKETS - 1)
_SEED = np.uint64(0x5851F42D4C957F2D)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_WORDY = re.compile("[0-9A-Za-z\x80-\U0010FFFF]")

#: Long sets, of more than ``LONG_SET`` words, have a second sketch of so many times 64 bits.
LONG_SET, WIDE = 48, 8
#: Counts by their place on the scale of ``coarse``.
_COUNT = np.exp2(np.arange(1 << 16) / 1000.0) - 1
#: A set's first line: its two hashes, the text's doc_id and hash, the line's number, words, sketch of a long set.
FIRST = np.dtype([("c1", "<u8"), ("c2", "<u8"), ("known", "u1"), ("doc_id", "<i8"), ("k1", ">u8"), ("k2", ">u8"), ("line", "<i4"), ("n", "<u4"), ("wide", "<u8", (WIDE,))])
#: A prefix row: 32 bits of the key (its part has the rest), the set's words, words before the key's
#: that no partner has if they are the first common ones, place in the order of doc_id, hash and sketch.
PREFIX = np.dtype([("k", "<u4"), ("n", "<u4"), ("lost", "<u2"), ("at", "<u4"), ("c", "<u8"), ("odd", "<u8")])
#: Two sets.
PAIR = np.dtype([("x", "<u8"), ("y", "<u8")])
#: What the dealt rows give: 0 first lines, 1 pairs (a, b), 2 rows of dense runs (a run, b set, c sketch).
FOUND = "kind byte, a long, b long, c long, doc_id long, key binary, line int, n long, " + ", ".join(f"w{k} long" for k in range(WIDE))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def hash_words(lined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words of some bytes, eight bytes of all words at a time."""
    data = b" " + lined.translate(common._WORD_TABLE) + b" " * 8
    inside = np.frombuffer(data, np.uint8) != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    h = mix((size.astype(np.uint64) * _SEED) ^ (eight[start + 1] & _LOW[np.minimum(size, 8)]))
    at, more = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(more):
        h[more] = mix((h[more] * _SEED) ^ (eight[start[more] + 1 + at] & _LOW[np.minimum(size[more] - at, 8)]))
        at += 8
        more = more[size[more] > at]
    for k in np.flatnonzero(size > LONG):
        h[k] = word_hash(data[start[k] + 1 : start[k] + 1 + size[k]])
    return start, h


def line_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(line, word hash) of all texts' words in order, lines with a word only; of each line: its text and number."""
    if not texts:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    texts = [t or b"" for t in texts]
    joined = b"\n".join(texts)
    begin = np.concatenate(([0], np.flatnonzero(np.frombuffer(joined, np.uint8) == 10) + 1))
    text_begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    text_of = np.searchsorted(text_begin, begin, "right") - 1
    number = np.arange(len(begin)) - np.searchsorted(begin, text_begin)[text_of]
    start, h = hash_words(joined)
    n = np.diff(np.append(np.searchsorted(start, begin), len(start)))
    some = np.flatnonzero(n)
    return np.repeat(np.arange(len(some)), n[some]), h, text_of[some], number[some]


def ahead(at: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(k, place) for all places after at[k] and before until[k]."""
    many = np.maximum(until - at - 1, 0)
    own = np.repeat(np.arange(len(at)), many)
    return own, at[own] + 1 + np.arange(len(own)) - (np.cumsum(many) - many)[own]


def prefix_keys(h: np.ndarray, count: np.ndarray, line: np.ndarray, begin: np.ndarray, n: np.ndarray, hot: int, lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, position of the key's last word with its words - 1 above ``_PLACE`` bits) of sets, ordered by line.

    ``h``, ``count``, ``line``: of all sets' words, each set's in order of rarity.
    """
    p = n - -(-NUMERATOR * n // DENOMINATOR) + 1
    at = np.flatnonzero((np.arange(len(h)) - begin[line] < p[line]) & (n[line] >= LEAST) & (count > 1))
    one, first = at[count[at] <= hot], at[count[at] > hot]
    found = [(line[one], h[one], one)]
    of = line[first]
    k, second = ahead(first, begin[of] + np.minimum(n[of], p[of] + 1))
    first, of = first[k], of[k]
    pair = mix(h[first] * _SEED + h[second])
    # Both sets of a pair see the same counts, so they choose the same kind of key.
    rare = count[first].astype(float) * count[second] <= float(hot) * lines
    found.append((of[rare], pair[rare], second[rare]))
    of, pair, second = of[~rare], pair[~rare], second[~rare]
    k, third = ahead(second, begin[of] + np.minimum(n[of], p[of] + 2))
    found.append((of[k], mix(pair[k] * _SEED + h[third]), third))
    beyond = np.repeat(np.arange(3), [len(x) for x, _, _ in found]) << _PLACE
    of, key, last = map(np.concatenate, zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], key[order], (last - begin[of] + beyond)[order]


def count_words(docs: DataFrame) -> tuple[np.ndarray, int, int, int, int]:
    """Words by hash bucket, over all lines (a bound of the lines that have them); lines; least and greatest doc_id; bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lines, size, pending, ids = np.zeros(BUCKETS, np.int64), 0, 0, [], []
        for batch in batches:
            texts = batch["text"].to_pylist()
            joined = b"\n".join(t for t in texts if t)
            pending.append((hash_words(joined)[1] & _MASK).astype(np.int32))
            lines += joined.count(b"\n") + 1
            size += len(joined)
            own = batch["doc_id"].drop_null().to_numpy()
            ids += [int(own.min()), int(own.max())] if len(own) else []
            if sum(map(len, pending)) > BUCKETS // 2:
                total += np.bincount(np.concatenate(pending), minlength=BUCKETS)
                pending = []
        if pending:
            total += np.bincount(np.concatenate(pending), minlength=BUCKETS)
        rows = [(-1, b"", b"", lines, min(ids, default=None), max(ids, default=None), size)]
        for k in range(BUCKETS // SLICE):
            part = total[k * SLICE : (k + 1) * SLICE]
            at = np.flatnonzero(part)
            if len(at):
                rows.append((k, at.astype("<u2").tobytes(), part[at].astype("<i8").tobytes(), None, None, None, None))
        yield pa.RecordBatch.from_pydict(dict(zip(("slice", "at", "n", "lines", "lo", "hi", "size"), map(list, zip(*rows, strict=True)), strict=True)), schema=_COUNTED)

    def add(key: tuple, parts: pa.Table) -> pa.Table:
        slice_ = key[0].as_py()
        if slice_ < 0:
            one = {c: [f(parts[c]).as_py()] for c, f in (("lines", pc.sum), ("lo", pc.min), ("hi", pc.max), ("size", pc.sum))}
            return pa.Table.from_pydict({"slice": [-1], "at": [b""], "n": [b""]} | one, schema=_COUNTED)
        total = np.zeros(SLICE, np.int64)
        for at, n in zip(parts["at"].to_pylist(), parts["n"].to_pylist(), strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, "<i8")
        return pa.Table.from_pydict({"slice": [slice_], "at": [b""], "n": [total.tobytes()], "lines": [None], "lo": [None], "hi": [None], "size": [None]}, schema=_COUNTED)

    with common.swept(docs.sparkSession):
        # A slice's counts are one row of each task, of at most SLICE numbers.
        summed = docs.select("doc_id", "text").mapInArrow(run, COUNTED).groupBy("slice").applyInArrow(add, COUNTED).toArrow().to_pylist()
    out, rest = np.zeros(BUCKETS, np.int64), {"lines": 0, "lo": None, "hi": None, "size": 0}
    for row in summed:
        if row["slice"] < 0:
            rest = row
        else:
            out[row["slice"] * SLICE : (row["slice"] + 1) * SLICE] = np.frombuffer(row["n"], np.int64)
    return out, rest["lines"] or 0, rest["lo"] or 0, rest["hi"] or 0, rest["size"] or 0


COUNTED = "slice int, at binary, n binary, lines long, lo long, hi long, size long"
_COUNTED = pa.schema([("slice", pa.int32()), ("at", pa.binary()), ("n", pa.binary()), *((c, pa.int64()) for c in ("lines", "lo", "hi", "size"))])


def coarse(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 16 bits, 1000 steps to a doubling; 0 and 1 keep a step of their own."""
    return np.minimum(np.log2(counts + 1.0) * 1000, 65535).astype(np.uint16)


def packed(rows: np.ndarray, part: np.ndarray, kind: int) -> pa.RecordBatch:
    """(part, kind, data): the rows of each part, as bytes."""
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    ends = (np.append(edge, len(part)) * rows.dtype.itemsize).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
    return pa.record_batch({"part": pa.array(part[edge].astype(np.int32)), "kind": pa.array(np.full(len(edge), kind, np.int8)), "data": data})


def prefix_rows(texts: list[bytes | None], first: np.ndarray, scale: np.ndarray, hot: int, lines: int, place_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``FIRST`` rows of the sets of some texts, ``PREFIX`` rows, and the rows' whole keys. ``first``: known, doc_id, k1, k2 of each text."""
    line, h, text_of, number = line_words(texts)
    if not len(h):
        return np.empty(0, FIRST), np.empty(0, PREFIX), np.empty(0, np.uint64)
    # One number sorts by line, rarity and hash.
    bits = len(text_of).bit_length()
    rarity = scale[(h & _MASK).astype(np.int64)]
    one = (line.astype(np.uint64) << np.uint64(64 - bits)) | (rarity.astype(np.uint64) << np.uint64(48 - bits)) | (h >> np.uint64(16 + bits))
    order = np.argsort(one)
    one, by = one[order], h[order]
    same = one[1:] == one[:-1]
    if (same & (by[1:] != by[:-1])).any():
        order = np.lexsort((h, rarity, line))
        by = h[order]
        same = (by[1:] == by[:-1]) & (line[order[1:]] == line[order[:-1]])
    order = order[np.concatenate(([True], ~same))]
    line, h, rarity = line[order], h[order], rarity[order]
    begin = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    rows = np.empty(len(begin), FIRST)
    rows["c1"], rows["c2"] = np.add.reduceat(mix(h), begin), np.add.reduceat(mix(h ^ _SEED), begin)
    for c in ("known", "doc_id", "k1", "k2"):
        rows[c] = first[c][text_of]
    rows["line"] = number
    own = np.sort(firsts(rows, True))
    # Prefixes of each set of the batch once.
    taken = np.zeros(len(rows), bool)
    taken[own] = True
    kept = taken[line]
    line, h, rarity = (np.cumsum(taken) - 1)[line[kept]], h[kept], rarity[kept]
    rows = rows[own]
    n = np.bincount(line, minlength=len(rows))
    begin = np.cumsum(n) - n
    rows["n"], rows["wide"] = n, 0
    long = n > LONG_SET
    if long.any():
        at, w = (np.cumsum(n[long]) - n[long]), h[long[line]]
        bit, word = np.uint64(1) << ((w >> np.uint64(52)) & np.uint64(63)), (w >> np.uint64(49)) & np.uint64(WIDE - 1)
        rows["wide"][long] = np.column_stack([np.bitwise_xor.reduceat(np.where(word == k, bit, np.uint64(0)), at) for k in range(WIDE)])
    of, key, place = prefix_keys(h, _COUNT[rarity], line, begin, n, hot, lines)
    out = np.empty(len(of), PREFIX)
    out["k"], out["n"], out["at"], out["c"] = key & np.uint64(0xFFFFFFFF), n[of], place_of(rows["known"][of], rows["doc_id"][of]), rows["c1"][of]
    out["lost"] = np.clip((place & ((1 << _PLACE) - 1)) - (place >> _PLACE), 0, 65535)
    out["odd"] = np.bitwise_xor.reduceat(np.uint64(1) << (h >> np.uint64(58)), begin)[of]
    return rows, out, key


def firsts(rows: np.ndarray, places: bool = False) -> np.ndarray:
    """The first of the rows of each set (or their places)."""
    order = np.lexsort((rows["line"], rows["k2"], rows["k1"], rows["doc_id"], rows["known"], rows["c2"], rows["c1"]))
    c1, c2 = rows["c1"][order], rows["c2"][order]
    own = order[np.concatenate(([True], (c1[1:] != c1[:-1]) | (c2[1:] != c2[:-1])))] if len(rows) else order
    return own if places else rows[own]


def passing(x: np.ndarray, y: np.ndarray, n: np.ndarray, left: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (x, y) of places of prefix rows of equal keys that can be similar: by sketch, length and position.

    ``n``, ``odd``: the rows' words and sketches. ``left``: words from the key on; the positional filter takes the
    key for the pair's first common words, and one of a similar pair's keys is that.
    """
    both = n[x] + n[y]
    # Words in one set alone each turn at most one bit of the odd sketches' difference; a similar
    # pair has a ninth of four times both in common, rounded up.
    ok = np.flatnonzero(np.bitwise_count(odd[x] ^ odd[y]) <= both - 2 * ((4 * both + 8) // 9))
    x, y = x[ok], y[ok]
    nx, ny = n[x], n[y]
    ok = (NUMERATOR * ny <= DENOMINATOR * nx) & (NUMERATOR * nx <= DENOMINATOR * ny) & (np.minimum(left[x], left[y]) >= (4 * (nx + ny) + 8) // 9)
    return x[ok], y[ok]


def run_pairs(key: np.ndarray, rows: np.ndarray, whole: bool, longest: int, crowded: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``PAIR`` rows of sets to verify, and the keys and rows of dense runs; all rows count as such unless ``whole``.

    A run is dense if it has more than ``longest`` rows, or more than ``crowded`` pairs a row that pass.
    """
    def shared(key: np.ndarray) -> np.ndarray:
        """Places of the rows whose key another row has (all unless ``whole``), by key."""
        order = np.argsort(key)
        if not whole:
            return order
        new = np.concatenate(([True], key[order[1:]] != key[order[:-1]], [True]))
        return order[~(new[1:] & new[:-1])]

    order = shared(key)
    key, rows = key[order], rows[order]
    # A set's rows of a key become one, with the first place.
    both = mix(key * _SEED ^ rows["c"])
    order = np.argsort(both)
    new = np.ones(len(key), bool)
    new[1:] = (both[order[1:]] != both[order[:-1]]) | (key[order[1:]] != key[order[:-1]]) | (rows["c"][order[1:]] != rows["c"][order[:-1]])
    if not new.all():
        begin = np.flatnonzero(new)
        at = np.minimum.reduceat(rows["at"][order], begin)
        key, rows = key[order[begin]], rows[order[begin]]
        rows["at"] = at
        order = shared(key)
        key, rows = key[order], rows[order]
    if not len(key):
        return np.empty(0, PAIR), key, rows
    run = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
    order = np.argsort(run << 32 | rows["n"])
    key, rows = key[order], rows[order]
    head = np.concatenate(([True], key[1:] != key[:-1]))
    run = np.cumsum(head) - 1
    size = np.bincount(run)
    end = np.cumsum(size)
    n, odd = rows["n"].astype(np.int64), rows["odd"].astype(np.uint64)
    left = n - rows["lost"]
    # Partners of a row are behind it in its run, as long as lengths allow.
    by = run.astype(np.int64) << 32
    last = np.searchsorted(by + n, by + np.minimum(n * DENOMINATOR // NUMERATOR, (1 << 32) - 1), "right")
    dense = (size > longest) | (not whole)
    last[dense[run]] = 0
    many = np.maximum(last - np.arange(len(run)) - 1, 0)
    of_run = np.bincount(run, many, len(size)).astype(np.int64)
    xs, ys, at = [], [], 0
    total = np.cumsum(of_run)
    while at < len(size):  # whole runs, up to TESTED pairs or one run
        done = total[at - 1] if at else 0
        until = max(at + 1, int(np.searchsorted(total, done + TESTED, "right")))
        a, b = end[at] - size[at], end[until - 1]
        if total[until - 1] > done:
            k, y = ahead(np.arange(a, b), last[a:b])
            x, y = passing(k + a, y, n, left, odd)
            crowd = np.bincount(run[x] - at, minlength=until - at) > crowded * size[at:until]
            dense[at:until] |= crowd
            ok = ~crowd[run[x] - at]
            xs.append(x[ok])
            ys.append(y[ok])
        at = until
    inside = np.flatnonzero(dense[run])
    if len(inside):  # each row with its run's first
        order = inside[np.lexsort((rows["c"][inside], rows["at"][inside], run[inside]))]
        top = np.full(len(size), -1)
        edge = np.concatenate(([True], run[order][1:] != run[order][:-1]))
        top[run[order[edge]]] = order[edge]
        rest = inside[top[run[inside]] != inside]
        x, y = passing(top[run[rest]], rest, n, left, odd)
        xs.append(x)
        ys.append(y)
    x, y = (np.concatenate(z) if z else np.empty(0, np.int64) for z in (xs, ys))
    x, y = rows["c"][x], rows["c"][y]
    return np.unique(np.rec.fromarrays((np.minimum(x, y), np.maximum(x, y)), dtype=PAIR)), key[inside], rows[inside]


def found(kind: int, **columns) -> pa.RecordBatch:
    """A batch of ``FOUND``."""
    size = len(next(iter(columns.values())))
    types = {"kind": pa.int8(), "key": pa.binary(), "line": pa.int32()}
    whole = {"kind": np.full(size, kind, np.int8)} | columns
    return pa.record_batch({c: pa.array(whole[c], types.get(c, pa.int64())) if c in whole else pa.nulls(size, types.get(c, pa.int64())) for c in common.names(FOUND)})


def dealt(docs: DataFrame) -> DataFrame:
    """``FOUND``: first lines of sets, pairs of sets to verify, rows of dense runs."""
    spark = docs.sparkSession
    counts, lines, lo, hi, size = count_words(docs)
    hot = int(max(HOT_LEAST, HOT * counts.sum() / BUCKETS))
    held = spark.sparkContext.broadcast(coarse(counts))
    deal = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * size // PART_WANTED + 1)
    parts, step = 4 * deal, (hi - lo) // ((1 << 32) - 2) + 1

    def place_of(known: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        return np.where(known > 0, (doc_id.astype(np.uint64) - np.uint64(lo % (1 << 64))) // np.uint64(step) + np.uint64(1), np.uint64(0))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u8").reshape(-1, 2)
            ids = batch["doc_id"]
            first = {"known": ids.is_valid().to_numpy(zero_copy_only=False), "doc_id": ids.fill_null(0).to_numpy(), "k1": key[:, 0], "k2": key[:, 1]}
            rows, prefix, whole = prefix_rows(batch["text"].to_pylist(), first, held.value, hot, lines, place_of)
            yield packed(rows, (rows["c1"] % np.uint64(parts)).astype(np.int64), 0)
            yield packed(prefix, ((whole >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), 1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[np.ndarray] = []
        pending: list[tuple[int, np.ndarray]] = []
        now, whole, many, most = 0, True, 0, PART_BYTES // FIRST.itemsize

        def match() -> Iterator[pa.RecordBatch]:
            if not pending:
                return
            rows = np.concatenate([x for _, x in pending])
            key = np.repeat(np.array([p for p, _ in pending], np.uint64), [len(x) for _, x in pending]) << np.uint64(32) | rows["k"]
            pairs, runs, dense = run_pairs(key, rows, whole, RUN, DENSE)
            yield found(1, a=pairs["x"].astype(np.uint64).view(np.int64), b=pairs["y"].astype(np.uint64).view(np.int64))
            yield found(2, a=runs.view(np.int64), b=dense["c"].view(np.int64), c=dense["odd"].view(np.int64), doc_id=dense["at"].astype(np.int64), line=dense["lost"].astype(np.int32), n=dense["n"].astype(np.int64))

        def first() -> Iterator[pa.RecordBatch]:
            rows = firsts(np.concatenate(own))
            key = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * 16).astype(np.int32)), pa.py_buffer(np.column_stack((rows["k1"], rows["k2"])).astype(">u8").tobytes())])
            yield found(0, a=rows["c1"].astype(np.uint64).view(np.int64), b=rows["c2"].astype(np.uint64).view(np.int64), doc_id=pa.array(rows["doc_id"].astype(np.int64), mask=rows["known"] == 0), key=key, line=rows["line"].astype(np.int32), n=rows["n"].astype(np.int64), **{f"w{k}": pa.array(rows["wide"][:, k].copy().view(np.int64), mask=rows["n"] <= LONG_SET) for k in range(WIDE)})

        for batch in batches:
            for part, kind, data in zip(batch["part"].to_pylist(), batch["kind"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if kind:
                    pending.append((part, np.frombuffer(data, PREFIX)))
                    now += len(data)
                    if now > PART_BYTES:
                        whole = False
                        yield from match()
                        pending, now = [], 0
                else:
                    own.append(np.frombuffer(data, FIRST))
                    many += len(own[-1])
                    if many > most:
                        own = [firsts(np.concatenate(own))]
                        many = len(own[0])
                        most = max(most, 2 * many)
        yield from match()
        if own:
            yield from first()

    sent = docs.select("doc_id", "key", "text").mapInArrow(emit, "part int, kind byte, data binary")
    return sent.repartition(deal, "part").mapInArrow(meet, FOUND)


def words_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(o, s): words of the sets in ``wanted`` (o, key, line), read from that line.

    Texts are not shuffled: up to ``BROADCAST_KEYS`` hashes of wanted texts are broadcast, and a bitmap of
    fixed size, of slots that wanted lines fall in, spares most other lines.
    """
    keys = wanted.select("key").distinct()
    if keys.count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(keys), "key", "left_semi")
    slot = (F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("bigint").bitwiseAND(common.SLOTS - 1) + F.col("line")).bitwiseAND(common.SLOTS - 1)
    held = docs.sparkSession.sparkContext.broadcast(common.bitmap(wanted.select(slot.alias("slot"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch["text"].to_pylist()]
            head = np.frombuffer(b"".join(batch["key"].to_pylist()), ">u8")[::2].astype(np.int64)
            split = [t.split(b"\n") for t in texts]
            n = np.array([len(x) for x in split])
            of = np.repeat(np.arange(len(n)), n)
            number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            slot = ((head[of] & (common.SLOTS - 1)) + number) & (common.SLOTS - 1)
            hit = np.flatnonzero(common.held_in(held.value, slot))
            line, h, at, _ = line_words([split[of[k]][number[k]] for k in hit])
            if not len(h):
                continue
            order = np.lexsort((h, line))
            line, h, hit = line[order], h[order], hit[at]
            new = np.concatenate(([True], (line[1:] != line[:-1]) | (h[1:] != h[:-1])))
            ends = np.concatenate(([0], np.cumsum(np.bincount(line[new], minlength=len(hit))))).astype(np.int32)
            yield pa.record_batch({"key": batch["key"].take(pa.array(of[hit])), "line": number[hit].astype(np.int32), "s": pa.ListArray.from_arrays(pa.array(ends), pa.array(h[new].view(np.int64)))})

    # Equal texts give equal lines; one is enough.
    found = docs.select("key", "text").mapInArrow(run, "key binary, line int, s array<long>").groupBy("key", "line").agg(F.first("s").alias("s"))
    return wanted.join(found, ["key", "line"]).select("o", "s")


def apart(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (x, y) without those of long sets that their second sketches tell apart. ``own``: (a, n, w0, w1, ...) of the sets in them."""
    side = lambda z: own.select(F.col("a").alias(z), F.col("n").alias(f"n{z}"), *(F.col(f"w{k}").alias(f"w{k}{z}") for k in range(WIDE)))
    differ = sum((F.bit_count(F.col(f"w{k}x").bitwiseXOR(F.col(f"w{k}y"))) for k in range(1, WIDE)), F.bit_count(F.col("w0x").bitwiseXOR(F.col("w0y"))))
    both = F.col("nx") + F.col("ny")
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    return met.where(F.coalesce(differ <= both - 2 * F.floor((4 * both + 8) / 9), F.lit(True))).select("x", "y")


def similar(docs: DataFrame, own: DataFrame, pairs: DataFrame, cut) -> DataFrame:
    """(a, b): the later set of each pair (x, y) that is similar enough. ``own``: (a, b, doc_id, key, line) of the sets in them."""
    ends = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).distinct()
    wanted = cut(own.join(ends, "a").select(F.struct("a", "b", F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key", "line").alias("first")).alias("o"), "key", "line"))
    words = cut(words_of(docs, wanted))
    side = lambda z: words.select(F.col("o.a").alias(z), F.col("o").alias(f"o{z}"), F.col("s").alias(f"s{z}"))
    met = pairs.join(side("x"), "x").join(side("y"), "y")
    enough = (DENOMINATOR + NUMERATOR) * F.size(F.array_intersect("sx", "sy")) >= NUMERATOR * (F.size("sx") + F.size("sy"))
    later = F.when(F.col("ox.first") < F.col("oy.first"), F.col("oy")).otherwise(F.col("ox"))
    return cut(met.where(enough).select(later.alias("o")).select("o.a", "o.b").distinct())


def left_pairs(dense: DataFrame, left: DataFrame) -> DataFrame:
    """Distinct pairs (x, y) of the rows of dense runs that pass the filters, where one is in ``left`` and the other doesn't begin after it."""
    x, y = (d.select("a", *(F.col(c).alias(f"{c}{z}") for c in ("b", "c", "doc_id", "line", "n"))) for d, z in ((dense, "x"), (left, "y")))
    need = F.floor((4 * (F.col("nx") + F.col("ny")) + 8) / 9)
    fits = (NUMERATOR * F.col("ny") <= DENOMINATOR * F.col("nx")) & (NUMERATOR * F.col("nx") <= DENOMINATOR * F.col("ny"))
    near = F.least(F.col("nx") - F.col("linex"), F.col("ny") - F.col("liney")) >= need
    alike = F.bit_count(F.col("cx").bitwiseXOR(F.col("cy"))) <= F.col("nx") + F.col("ny") - 2 * need
    met = x.join(y, "a").where((F.col("bx") != F.col("by")) & (F.col("doc_idx") <= F.col("doc_idy")) & fits & near & alike)
    return met.select(F.least("bx", "by").alias("x"), F.greatest("bx", "by").alias("y")).distinct()


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lines): numbers of the lines with words that stay. ``docs``: (doc_id, key, text as bytes)."""
    held: list[str] = []
    cut = lambda df: common.cut(df, held)
    whole = cut(dealt(docs))
    own = whole.where("kind = 0").select("a", "b", "doc_id", "key", "line")
    dense = whole.where("kind = 2").select("a", "b", "c", "doc_id", "line", "n")
    pairs = whole.where("kind = 1").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    ends = pairs.select(F.col("x").alias("a")).unionByName(pairs.select(F.col("y").alias("a"))).unionByName(dense.select(F.col("b").alias("a"))).distinct()
    met = cut(whole.where("kind = 0").drop("kind", "c").join(ends, "a"))
    settled = similar(docs, met, cut(apart(met, pairs)), cut)
    more = cut(apart(met, left_pairs(dense, dense.join(settled.select(F.col("a").alias("b")).distinct(), "b", "left_anti"))))
    if not more.isEmpty():
        settled = settled.unionByName(similar(docs, met, more, cut))
    stays = own.join(settled, ["a", "b"], "left_anti").select("doc_id", "key", "line")
    kept = common.cut(stays.groupBy("doc_id", "key").agg(F.collect_list("line").alias("lines")))
    common.discard(docs.sparkSession, held)
    return kept


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` without later matches, with columns __n_lines and __n_removed beside its own."""
    common.small_batches(docs.sparkSession, BATCH_BYTES)
    keyed = docs.withColumn("__key", F.unhex(common.text_key())).withColumn("__id", F.col("doc_id").cast("bigint"))
    plain = keyed.select(F.col("__id").alias("doc_id"), F.col("__key").alias("key"), F.col("text").cast("binary").alias("text"))
    lines = kept_lines(plain).select(F.col("doc_id").alias("__id2"), F.col("key").alias("__key"), F.col("lines").alias("__lines"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def rest(text: pd.Series, stay: pd.Series) -> pd.DataFrame:
        rows = []
        for t, own in zip(text, stay, strict=True):
            if t is None:
                rows.append((None, 0, 0))
                continue
            held = set(own.tolist()) if own is not None else set()
            split = t.split("\n")
            has = [_WORDY.search(x) is not None for x in split]
            left = [x for k, x in enumerate(split) if not has[k] or k in held]
            rows.append(("\n".join(left), sum(has), len(split) - len(left)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_removed"])

    on = (keyed["__key"] == lines["__key"]) & keyed["__id"].eqNullSafe(lines["__id2"])
    met = keyed.join(lines.hint("shuffle_hash"), on, "left").drop(lines["__key"]).drop("__id2")
    return met.withColumn("__r", rest.asNondeterministic()("text", "__lines")).drop("__key", "__id", "__lines")


@common.shielded
def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with their columns and the lines that stay."""
    done = remove(docs).withColumn("text", F.col("__r.text"))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("__r.n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: lines with words, lines removed, and a hash of the rest of every document."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    done = remove(docs)
    return done.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("__r.n_lines").alias("n_lines"), F.col("__r.n_removed").alias("n_removed"), F.sha2(F.coalesce("__r.text", F.lit("")), 256).alias("kept_sha256"))


def lines_sql(relation: str) -> str:
    """Relations ending in ``line_kept(doc_id, i, line, has, removed)`` over (doc_id, text), of distinct doc_id."""
    return rf"""
line_all as (select doc_id, i, s[i] as line from (select doc_id, s, unnest(generate_series(1, len(s))) as i from (select doc_id, string_split(coalesce(text, ''), chr(10)) as s from {relation}))),
line_w as (select doc_id, i, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))) as w from line_all),
line_set as (select row_number() over (order by min((doc_id, i))) as c, w, len(w) as n, min((doc_id, i)) as f from line_w where len(w) > 0 group by w),
line_df as (select t, count(*) as df from (select unnest(w) as t from line_set) group by t),
line_tok as (select c, n, t, row_number() over (partition by c order by df, t) as r from (select c, n, unnest(w) as t from line_set) join line_df using (t)),
line_pair as (select distinct x.c as a, y.c as b from (select * from line_tok where r <= n - ceil(0.8 * n) + 1) x join line_tok y on x.t = y.t and x.c <> y.c and 5 * x.n >= 4 * y.n and 5 * y.n >= 4 * x.n),
line_later as (select distinct y.c from line_pair join line_set x on x.c = a join line_set y on y.c = b where x.f < y.f and 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
line_kept as (
  select a.doc_id, a.i, a.line, w.w <> [] as has, w.w <> [] and (s.f <> (a.doc_id, a.i) or s.c in (select c from line_later)) as removed
  from line_all a join line_w w on a.doc_id = w.doc_id and a.i = w.i left join line_set s on s.w = w.w)"""


SQL = f"""with {lines_sql('documents')}
select cast(doc_id as bigint) as doc_id, count(*) filter (has) as n_lines, count(*) filter (removed) as n_removed,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not removed), '')) as kept_sha256
from line_kept group by doc_id"""
