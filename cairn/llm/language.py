"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy.

A text is cut at blanks into segments (a leading blank byte, then at most ``SEGMENT`` bytes); two
gated recurrent layers read each segment forwards and backwards, and a softmax labels every byte
position with a language. A document's probabilities are pooled over all its positions: the language
is that of the largest sum of log-probabilities, the score its mean probability. States start anew
in each segment, so equal segments get equal labels: those that a batch repeats are read once, and a
worker remembers up to ``MEMO`` of them.

Training is backpropagation through time with Adam on the driver, on a bounded sample: of each
language the ``TRAIN_DOCS`` documents first by hash of doc_id, of each at most ``TRAIN_SEGMENTS``
segments spread evenly over its text. Prediction is row by row: no shuffle.

Defined cases: a null text, or one without a letter, is ``und`` with score 0, as is every text where
there is nothing to learn from; documents of null lang or doc_id aren't learned from; ties go to the
language first by name; repeated documents give repeated rows; very long texts are read whole;
an empty table gives an empty one; other columns pass unread.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TRAIN_DOCS, TRAIN_SEGMENTS, MAX_LANGUAGES = 250, 60, 256
SEGMENT, HIDDEN, MEMO, ROWS = 24, 20, 200_000, 2048
UNKNOWN = "und"
PREDICTED = "lang_pred string, score double"
_LETTER = regex.compile(r"\p{L}")


def segments(text: str | None) -> list[bytes]:
    """The text's bytes but for blanks, in pieces of at most ``SEGMENT`` bytes, cut between characters, with a blank before each."""
    out = []
    for w in common.encode(text).split():
        if len(w) <= SEGMENT:
            out.append(b" " + w)
            continue
        at = 0
        while at < len(w):
            end = min(at + SEGMENT, len(w))
            while end < len(w) and w[end] & 0xC0 == 0x80:  # inside a character
                end -= 1
            out.append(b" " + w[at:end])
            at = end
    return out


def padded(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte ids (256 is padding) by position, and which are there."""
    size = np.fromiter(map(len, batch), np.int64, len(batch))
    mask = np.arange(size.max()) < size[:, None]
    ids = np.full(mask.shape, 256, np.int64)
    ids[mask] = np.frombuffer(b"".join(batch), np.uint8)
    return ids, mask


class Network:
    """Two gated recurrent layers, one in each direction, and a softmax."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w[f"x{d}"] = rng.normal(0, 0.3, (257, 3 * hidden)).astype(np.float32)
            self.w[f"x{d}"][256] = 0
            self.w[f"h{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.zeros(3 * hidden, np.float32)
        self.w["o"] = rng.normal(0, 0.1, (2 * hidden, len(languages))).astype(np.float32)
        self.w["p"] = np.zeros(len(languages), np.float32)

    def _layer(self, d: str, ids: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States at each position. Gates: update z, reset r, candidate n."""
        b, steps, h = *ids.shape, self.hidden
        table, wh = self.w[f"x{d}"] + self.w[f"c{d}"], self.w[f"h{d}"]
        # One product for gates and one for candidates; gates are halved here for the tanh of their sigmoid.
        gate_table, gate_w, rest_w = table[:, : 2 * h] * np.float32(0.5), wh[:, : 2 * h] * np.float32(0.5), np.ascontiguousarray(wh[:, 2 * h :])
        rest_table = np.ascontiguousarray(table[:, 2 * h :])
        state, out, tape = np.zeros((b, h), np.float32), np.zeros((b, steps, h), np.float32), []
        whole = mask.all(axis=0)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            at = ids[:, t]
            gates = gate_table[at]
            gates += state @ gate_w
            np.tanh(gates, out=gates)
            gates += 1
            gates *= np.float32(0.5)
            z, r = gates[:, :h], gates[:, h:]
            rs = r * state
            n = rest_table[at]
            n += rs @ rest_w
            np.tanh(n, out=n)
            new = n - state
            new *= z
            new += state
            here = mask[:, t, None]
            if not whole[t]:
                new = np.where(here, new, state)
            if keep:
                tape.append((t, state, z, r, rs, n, here))
            state = new
            out[:, t] = state
        return out, tape

    def log_probabilities(self, ids: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Of each language at each position."""
        f, tape_f = self._layer("f", ids, mask, keep)
        b, tape_b = self._layer("b", ids, mask, keep)
        both = np.concatenate((f, b), axis=2)
        s = both @ self.w["o"] + self.w["p"]
        s -= s.max(axis=2, keepdims=True)
        s -= np.log(np.exp(s).sum(axis=2, keepdims=True))
        return (s, both, {"f": tape_f, "b": tape_b}) if keep else s

    def gradient(self, ids: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradient through time."""
        s, both, tapes = self.log_probabilities(ids, mask, True)
        total, h = mask.sum(), self.hidden
        n = np.arange(len(y))
        loss = -(s[n, :, y] * mask).sum() / total
        d = np.exp(s)
        d[n, :, y] -= 1
        d *= (mask / np.float32(total))[:, :, None]
        g = {k: np.zeros_like(v) for k, v in self.w.items()}
        g["o"] = np.einsum("bth,btk->hk", both, d)
        g["p"] = d.sum(axis=(0, 1))
        back = d @ self.w["o"].T
        for k, at in (("f", 0), ("b", h)):
            wh, carry = self.w[f"h{k}"], np.zeros((len(y), h), np.float32)
            for t, state, z, r, rs, cand, here in reversed(tapes[k]):
                whole = carry + back[:, t, at : at + h]
                ds = np.where(here, whole, 0)
                dn = ds * z * (1 - cand * cand)
                drs = dn @ wh[:, 2 * h :].T
                dzr = np.concatenate((ds * (cand - state) * z * (1 - z), drs * state * r * (1 - r)), axis=1)
                dx = np.concatenate((dzr, dn), axis=1)
                np.add.at(g[f"x{k}"], ids[:, t], dx)
                g[f"c{k}"] += dx.sum(axis=0)
                g[f"h{k}"][:, : 2 * h] += state.T @ dzr
                g[f"h{k}"][:, 2 * h :] += rs.T @ dn
                carry = np.where(here, ds * (1 - z) + drs * r + dzr @ wh[:, : 2 * h].T, whole)
        return float(loss), g

    def train(self, examples: list[tuple[bytes, int]], epochs: int = 4, size: int = 256, rate: float = 0.01) -> Network:
        """Adam over batches of segments of similar length; languages weigh the same."""
        rng = np.random.default_rng(11)
        by = [[s for s, k in examples if k == c] for c in range(len(self.languages))]
        most = min(max(map(len, by), default=0), 4 * min((len(x) for x in by if x), default=0))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        step = 0
        for epoch in range(epochs):
            drawn = [(x[i], c) for c, x in enumerate(by) if x for i in rng.choice(len(x), most, replace=len(x) < most)]
            drawn = [drawn[i] for i in rng.permutation(len(drawn))]
            drawn.sort(key=lambda e: len(e[0]))
            batches = [drawn[i : i + size] for i in range(0, len(drawn), size)]
            for i in rng.permutation(len(batches)):
                ids, mask = padded([s for s, _ in batches[i]])
                _, g = self.gradient(ids, mask, np.array([c for _, c in batches[i]]))
                step += 1
                now = rate * (0.3 if epoch == epochs - 1 else 1)
                for k in self.w:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.w[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def label(self, batch: list[bytes]) -> np.ndarray:
        """Of each segment: sums over its positions of log-probabilities, then of probabilities, then their number."""
        k = len(self.languages)
        out = np.empty((len(batch), 2 * k + 1), np.float32)
        order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
        for at in range(0, len(order), ROWS):
            own = order[at : at + ROWS]
            ids, mask = padded([batch[i] for i in own])
            s = self.log_probabilities(ids, mask)
            here = mask[:, :, None].astype(np.float32)
            out[own, :k] = (s * here).sum(axis=1)
            out[own, k : 2 * k] = (np.exp(s, out=s) * here).sum(axis=1)
            out[own, 2 * k] = mask.sum(axis=1)
        return out


class Predictor:
    """Pools a network's labels over documents, remembering segments."""

    def __init__(self, network: Network):
        self.network, self.memo = network, {}
        self.rows = np.empty((0, 2 * len(network.languages) + 1), np.float32)

    def predict(self, texts) -> list[tuple[str, float]]:
        k = len(self.network.languages)
        found = [segments(t) if k and t is not None and _LETTER.search(t) else [] for t in texts]
        new = list({s for x in found for s in x if s not in self.memo})
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            self.rows = self.rows[:0]
            new = list({s for x in found for s in x})
        if new:
            self.memo.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.rows = np.concatenate((self.rows, self.network.label(new)))
        out = []
        get = self.memo.__getitem__
        for x in found:
            if not x:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.rows[np.fromiter(map(get, x), np.int64, len(x))].sum(axis=0, dtype=np.float64)
            best = int(total[:k].argmax())
            out.append((self.network.languages[best], float(min(1.0, total[k + best] / total[2 * k]))))
        return out


def held_out(doc_id: str = "doc_id"):
    """True for the quarter of documents that nothing is learned from; a null doc_id isn't in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> Network:
    """Train on the bounded sample of documents outside the held-out quarter."""
    own = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text")
    # Row numbers up to a limit: each task keeps so many rows of a language before the shuffle.
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = own.select("doc_id", "lang").withColumn("k", F.row_number().over(first)).where(F.col("k") <= TRAIN_DOCS).groupBy("doc_id", "lang").agg(F.min("k").alias("k"))
    # Where there are more, languages have fewer documents each, and none goes before each has one.
    chosen = chosen.orderBy("k", F.xxhash64("lang"), "lang", "doc_id").limit(TRAIN_DOCS * MAX_LANGUAGES).drop("k")

    @F.pandas_udf("array<binary>")
    def spread(text: pd.Series) -> pd.Series:
        out = []
        for t in text:
            s = segments(t)
            out.append([s[i] for i in np.unique(np.linspace(0, len(s) - 1, min(len(s), TRAIN_SEGMENTS)).astype(int))] if s else [])
        return pd.Series(out)

    # At most TRAIN_DOCS * MAX_LANGUAGES ids are broadcast.
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "lang", spread("text").alias("s")).collect()
    rows = sorted((r["lang"], r["doc_id"], [bytes(x) for x in r["s"]]) for r in rows)
    languages = sorted({lang for lang, _, _ in rows})
    return Network(languages).train([(s, languages.index(lang)) for lang, _, x in rows for s in x]) if languages else Network([])


def predict(docs: DataFrame, network: Network, name: str = "lang") -> DataFrame:
    """``docs`` with a column ``name``: struct of lang_pred and score."""
    common.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(network)
    own: list[Predictor] = []

    @F.pandas_udf(PREDICTED)
    def predicted(text: pd.Series) -> pd.DataFrame:
        if not own:
            own.append(Predictor(held.value))
        return pd.DataFrame(own[0].predict(text), columns=common.names(PREDICTED))

    return docs.withColumn(name, predicted.asNondeterministic()("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the language of every document."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    done = predict(docs.drop("lang"), fit(docs), "p")
    return done.select("doc_id", held_out().alias("held_out"), "p.lang_pred", "p.score")
