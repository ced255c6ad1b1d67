"""Many words in many texts: an automaton that reads each text once.

The words become an Aho-Corasick automaton, built once on the driver and broadcast, if their number and their characters are
within bounds; a task reads each text once, whatever the number of words. More words meet the texts on
their first three characters, in an equi-join with the texts' distinct runs of up to three.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as X

#: Words and characters that an automaton is built of; its nodes are at most as many as the characters.
MOST_WORDS, MOST_CHARS = 100_000, 500_000


def automaton(words: Iterable[tuple[str, object]]) -> ahocorasick.Automaton:
    """An automaton of different words with a value each; empty ones are left out."""
    made = ahocorasick.Automaton()
    for word, value in words:
        if word:
            made.add_word(word, value)
    if len(made):
        made.make_automaton()
    return made


def fits(words: DataFrame, most_words: int = MOST_WORDS, most_chars: int = MOST_CHARS) -> bool:
    """Whether the different ``word``s are few enough for an automaton."""
    seen = words.select("word").distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("chars")).first()
    return seen["n"] <= most_words and seen["chars"] <= most_chars


def _by_heads(rows: DataFrame, words: DataFrame, text: str) -> DataFrame:
    heads = words.withColumn("__head", F.left("word", F.lit(3)))
    runs = F.array_union(F.array_union(X.grams(F.col(text), 1), X.grams(F.col(text), 2)), X.grams(F.col(text), 3))
    return rows.withColumn("__head", F.explode(runs)).join(heads, "__head").where(F.contains(F.col(text), F.col("word"))).drop("__head")


def contained(rows: DataFrame, words: DataFrame, text: str, most_words: int = MOST_WORDS) -> DataFrame:
    """``rows`` with each row of ``words`` (column ``word``, and what else there is) whose word their text contains.

    Null texts contain nothing, and empty words are in none.
    """
    words = words.where("length(word) > 0")
    if not fits(words, most_words):
        return _by_heads(rows, words, text)
    own = words.groupBy("word").agg(F.count("*").alias("n")).collect()
    held = rows.sparkSession.sparkContext.broadcast(automaton((r["word"], r["word"]) for r in own))
    words = words.hint("broadcast" if sum(r["n"] for r in own) <= most_words else "merge")  # never the rows

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        own = held.value
        return pd.Series([sorted({w for _, w in own.iter(t)}) if t and len(own) else [] for t in texts], dtype=object)

    return rows.withColumn("word", F.explode(found.asNondeterministic()(text))).join(words, "word").select(*rows.columns, *words.columns)


def first_contained(rows: DataFrame, words: DataFrame, text: str, order: list[str], values: list[str], most_words: int = MOST_WORDS) -> DataFrame:
    """(id, ``values``) of each row (id, ``text``) whose text contains a word: those of the least row of ``words`` by ``order``, whole numbers."""
    words = words.where("length(word) > 0")
    best = words.groupBy("word").agg(F.min(F.struct(*order, *values)).alias("b"))
    if not fits(words, most_words):
        met = _by_heads(rows, best, text)
        return met.groupBy("id").agg(F.min("b").alias("b")).select("id", *(f"b.{v}" for v in values))
    held = rows.sparkSession.sparkContext.broadcast(automaton((r["word"], tuple(r["b"])) for r in best.collect()))
    n, kinds = len(order), dict(words.select(*values).dtypes)

    @F.pandas_udf(", ".join(f"{v} {kinds[v]}" for v in values))
    def least(texts: pd.Series) -> pd.DataFrame:
        own = held.value
        won = [min((b for _, b in own.iter(t)), default=None) if t and len(own) else None for t in texts]
        return pd.DataFrame([b[n:] if b else [None] * len(values) for b in won], columns=values, dtype=object)

    met = rows.select("id", least.asNondeterministic()(text).alias("b"), F.col(text).alias("__t"))
    return met.where(F.coalesce(*(F.col(f"b.{v}").isNotNull() for v in values), F.lit(False))).select("id", *(f"b.{v}" for v in values))


def longest_contained(rows: DataFrame, words: DataFrame, text: str, most_words: int = MOST_WORDS) -> DataFrame:
    """(id, word) with the longest word in each row's (id, ``text``), the first on ties. ``words``: (seq, word)."""
    ranked = words.select("word", (-F.length("word")).alias("__size"), F.col("seq").alias("__seq"))
    return first_contained(rows, ranked, text, ["__size", "__seq"], ["word"], most_words)


def token_class(text: Column, classes: list[tuple[str, list[str]]], blocked: Iterable[str] = ()) -> Column:
    """The first of the classes, in order, of which the text has a token; else null.

    Tokens are read from the left, the longest at a place, and don't overlap, so a blocked word hides the tokens in it.
    """
    own = automaton([*((w, k) for k, (_, words) in reversed([*enumerate(classes)]) for w in words), *((w, None) for w in blocked)])
    names = [name for name, _ in classes]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        found = (min((k for _, k in own.iter_long(t) if k is not None), default=None) if t and len(own) else None for t in texts)
        return pd.Series([None if k is None else names[k] for k in found], dtype=object)

    return run(text)


def findings(rows: DataFrame, text: str, patterns: dict[str, str], literals: dict[str, str] | None = None) -> DataFrame:
    """(id, rule, start, value) of every match of ``patterns`` (rule to expression) and of every literal (word to rule), in any case, in rows (id, ``text``).

    Each text is read once for each pattern and once for all literals. Matches of a pattern don't overlap each other; literals may.
    ``start`` counts code points from 0.
    """
    compiled = [(rule, re.compile(p)) for rule, p in patterns.items()]
    own = automaton((w.lower(), (len(w.lower()), rule)) for w, rule in (literals or {}).items())

    @F.pandas_udf("array<struct<rule:string,start:int,value:string>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            found = [(rule, m.start(), m[0]) for rule, p in compiled for m in p.finditer(t or "")]
            if t and len(own):
                low = t.lower()
                # A few characters get longer in lower case; then places are counted by characters of the text.
                place = range(len(low)) if len(low) == len(t) else [i for i, c in enumerate(t) for _ in c.lower()]
                found += [(rule, place[end + 1 - n], t[place[end + 1 - n] : place[end] + 1]) for end, (n, rule) in own.iter(low)]
            out.append(found)
        return pd.Series(out, dtype=object)

    return rows.select("id", F.explode(run.asNondeterministic()(text)).alias("f")).select("id", "f.rule", "f.start", "f.value")
