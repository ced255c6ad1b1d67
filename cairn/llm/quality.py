"""Quality rules: a linear-chain conditional random field labels lines; content share decides.

Each line with a word has features of its own (shares of symbols, capitals, digits, pipes and
function-like short words, its length, repetition). A two-state chain (0 boilerplate, 1 content) is
decoded by Viterbi over the whole text. A document is kept if its base rules pass and at least half
of the characters in its words lie in content lines.

The field is trained in numpy, by maximum conditional likelihood, on a bounded sample of labelled
documents (``TRAIN_DOCS`` documents by hash of doc_id, ``TRAIN_LINES`` lines of each, in runs spread evenly over it);
every line of a document takes the document's quality as its label. Only the sample's feature rows
reach the driver. Everything else is row by row: no shuffle, nothing that grows but the output.

Defined cases: null and empty texts have no words and fail the base rules; without usable labels
every line counts as content, so that the base rules decide alone; labels of null quality or doc_id
are passed over; of repeated labels of a document the lowest quality counts; repeated documents
give repeated rows; very long texts are read whole; an empty table gives an empty one; other columns of ``docs`` pass unread.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS, TRAIN_LINES, TRAIN_RUN = 1500, 64, 8
CONTENT_SHARE = 0.5
MIN_WORDS, REPEAT_WORDS, REPEAT_PERCENT = 50, 3, 50

VERDICT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, content_share double, kept boolean"
)
_SYMBOLS = b"#*$%&|<>"
#: Classes of bytes that features count: 1 symbol, 2 capital, 3 digit, 4 sentence mark, 5 other mark, 6 blank, 7 follows in UTF-8.
_CLASS = np.zeros(256, np.uint8)
for _set, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 2), (b"0123456789", 3), (b".,;:?", 4), (b"\"'()[]{}=+/\\@^_`~!-", 5), (_SYMBOLS, 1), (b" \t\r\x0b\x0c", 6), (bytes(range(0x80, 0xC0)), 7)):
    _CLASS[np.frombuffer(_set, np.uint8)] = _k
N_FEATURES = 12


def line_features(lines: list[bytes], counts: list[int], duplicate: list[bool]) -> np.ndarray:
    """A row for each line that has a word; ``counts``: its words."""
    text = np.frombuffer(b"\n".join(lines), np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines))
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    kind = _CLASS[text]
    share = np.empty((len(lines), 8))
    for k in range(1, 8):
        total = np.concatenate(([0], np.cumsum(kind == k)))
        share[:, k] = total[begins + sizes] - total[begins]
    chars = np.maximum(sizes - share[:, 7] - share[:, 6], 1)
    n = np.array(counts, float)
    out = np.empty((len(lines), N_FEATURES))
    out[:, 0] = 1
    out[:, 1:6] = np.minimum(share[:, 1:6] / chars[:, None] * 4, 4)
    out[:, 6] = np.minimum(share[:, 1] / n, 3)
    out[:, 7] = np.log1p(n) / 4
    out[:, 8] = np.minimum(chars / n, 20) / 10
    out[:, 9] = duplicate
    out[:, 10] = [x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines]
    out[:, 11] = n <= 3
    return out


def split_lines(text: str | None) -> tuple[list[bytes], list[list[bytes]], list[bool]]:
    """The lines that have a word, their words, and whether each equals an earlier line."""
    lines, found, duplicate, seen = [], [], [], set()
    for line in common.encode(text).split(b"\n"):
        if own := line.split():
            lines.append(line)
            found.append(own)
            duplicate.append(line in seen)
            seen.add(line)
    return lines, found, duplicate


def repeated_words(found: list[bytes]) -> int:
    """Words in windows of three words that the text has twice or more."""
    if len(found) <= REPEAT_WORDS:
        return 0
    ids: dict[bytes, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in found], np.int64)
    n = len(ids) + 1
    if n < 2_000_000:  # the product of three ids fits in 63 bits
        keys = (x[:-2] * n + x[1:-1]) * n + x[2:]
    else:
        pairs = np.unique(x[:-1] * n + x[1:], return_inverse=True)[1]
        keys = pairs[:-1] * n + x[2:]
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    twice = times[back] > 1
    cover = np.zeros(len(x), bool)
    for k in range(REPEAT_WORDS):
        cover[k : len(twice) + k] |= twice
    return int(cover.sum())


class Field:
    """Linear-chain conditional random field with two states."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move
        if emit is None:
            self.emit[0, 1] = 1.0  # untrained: content

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The likeliest states; ties go to content."""
        score, n = (x @ self.emit).tolist(), len(x)
        (m00, m01), (m10, m11) = self.move.tolist()
        back0, back1 = [0] * n, [0] * n
        a, b = score[0]
        for t in range(1, n):
            s0, s1 = score[t]
            back0[t], back1[t] = int(b + m10 >= a + m00), int(b + m11 >= a + m01)
            a, b = max(a + m00, b + m10) + s0, max(a + m01, b + m11) + s1
        out, state = np.empty(n, np.int8), int(b >= a)
        for t in range(n - 1, -1, -1):
            out[t] = state
            state = (back1 if state else back0)[t]
        return out

    @classmethod
    def train(cls, sequences: list[np.ndarray], labels: list[int], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> Field:
        """Adam on the conditional log-likelihood; forward and backward sums over padded sequences."""
        if len({*labels}) < 2:
            return cls()
        n, length = len(sequences), max(map(len, sequences))
        x, mask = np.zeros((n, length, N_FEATURES)), np.zeros((n, length))
        for k, s in enumerate(sequences):
            x[k, : len(s)], mask[k, : len(s)] = s, 1
        y = np.array(labels)
        # Each class weighs the same.
        weight = (len(y) / 2 / np.bincount(y, minlength=2))[y]
        gold = np.zeros((n, length, 2))
        gold[np.arange(n), :, y] = 1
        gold *= mask[:, :, None]
        pairs = mask[:, 1:] * mask[:, :-1]
        gold_move = np.einsum("n,nt,nti,ntj->ij", weight, pairs, gold[:, :-1], gold[:, 1:])
        total = (weight[:, None] * mask).sum()
        emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
        m, v = np.zeros(emit.size + 4), np.zeros(emit.size + 4)
        for step in range(1, steps + 1):
            s = x @ emit
            fwd, bwd = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            fwd[:, 0] = s[:, 0]
            for t in range(1, length):
                z = np.logaddexp(fwd[:, t - 1, 0, None] + move[0], fwd[:, t - 1, 1, None] + move[1]) + s[:, t]
                fwd[:, t] = np.where(mask[:, t, None] > 0, z, fwd[:, t - 1])
            for t in range(length - 2, -1, -1):
                u = s[:, t + 1] + bwd[:, t + 1]
                z = np.logaddexp(u[:, 0, None] + move[:, 0], u[:, 1, None] + move[:, 1])
                bwd[:, t] = np.where(mask[:, t + 1, None] > 0, z, 0)
            whole = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + bwd - whole[:, None, None]) * mask[:, :, None]
            joint = np.exp(fwd[:, :-1, :, None] + move + (s + bwd)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[:, :, None, None]
            grad = np.concatenate((np.einsum("n,ntf,nti->fi", weight, x, gold - p).ravel(), (gold_move - np.einsum("n,ntij->ij", weight, joint)).ravel())) / total
            grad -= decay * np.concatenate((emit.ravel(), move.ravel()))
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            emit, move = emit + change[:-4].reshape(emit.shape), move + change[-4:].reshape(2, 2)
        # Training lines carry their document's label, so moves between states look impossible.
        return cls(emit, np.clip(move, -2.0, 2.0))


def judge(text: str | None, model: Field) -> tuple:
    """``VERDICT`` of a text."""
    lines, found, duplicate = split_lines(text)
    flat = [w for x in found for w in x]
    n = len(flat)
    raw = b"".join(flat)
    chars = len(raw) - len(raw.translate(None, _NOT_FOLLOWING))
    symbols = len(common.encode(text)) - len(common.encode(text).translate(None, _SYMBOLS))
    repeats = repeated_words(flat)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    share = 0.0
    if lines:
        size = np.array([sum(map(len, x)) for x in found], float)
        state = model.viterbi(line_features(lines, list(map(len, found)), duplicate))
        share = float(size[state == 1].sum() / size.sum())
    return n, chars, symbols, sum(duplicate), repeats, failed, share, not failed and share >= CONTENT_SHARE


#: Bytes that begin a code point.
_NOT_FOLLOWING = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def spread(n: int) -> np.ndarray:
    """Numbers of at most ``TRAIN_LINES`` of ``n`` lines: all, or runs of ``TRAIN_RUN`` spread evenly from the first line to the last."""
    if n <= TRAIN_LINES:
        return np.arange(n)
    starts = np.linspace(0, n - TRAIN_RUN, TRAIN_LINES // TRAIN_RUN).astype(int)
    return (starts[:, None] + np.arange(TRAIN_RUN)).ravel()


def fit(docs: DataFrame, labels: DataFrame) -> Field:
    """Train on the bounded sample."""
    sample = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)

    @F.pandas_udf("array<array<double>>")
    def features(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            whole = split_lines(t)
            own = spread(len(whole[0])).tolist()
            lines, found, duplicate = ([x[i] for i in own] for x in whole)
            out.append(line_features(lines, list(map(len, found)), duplicate).tolist() if lines else [])
        return pd.Series(out)

    # At most TRAIN_DOCS pairs of numbers are broadcast.
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = [r for r in joined.select("doc_id", "quality", features.asNondeterministic()("text").alias("x")).collect() if r["x"]]
    rows = sorted({(r["doc_id"], int(r["quality"] > 0), str(r["x"])): r for r in rows}.items())
    return Field.train([np.array(r["x"]) for _, r in rows], [k[1] for k, _ in rows])


def verdicts(docs: DataFrame, model: Field, name: str = "verdict") -> DataFrame:
    """``docs`` with a column ``name`` of ``VERDICT``."""
    common.small_batches(docs.sparkSession)

    @F.pandas_udf(VERDICT)
    def verdict(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([judge(t, model) for t in text], columns=common.names(VERDICT))

    return docs.withColumn(name, verdict.asNondeterministic()("text"))


@common.shielded
def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that pass, with their columns."""
    return verdicts(docs, fit(docs, labels), "__verdict").where("__verdict.kept").drop("__verdict")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: base figures and verdict of every document."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), "text")
    model = fit(docs, common.table(spark, sf_dir, "labels"))
    return verdicts(docs, model).select("doc_id", "verdict.n_words", "verdict.word_chars", "verdict.n_symbols", "verdict.n_dup_lines", "verdict.n_repeat_words", "verdict.base_failed", "verdict.kept")


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base figures by plain definitions."""
    text = text or ""
    own = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    n = len(own)
    return n, sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n
