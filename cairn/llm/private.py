"""PII: base patterns and bootstrapped contextual extraction, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. They are the seeds: the two
words before a span, other identifiers and bare marks passed over, are its lexical pattern, its value
is an instance. Other tokens that look like an
identifier (an at sign, or ``DIGITS`` digits or more) are unlabelled instances of their patterns.
Spark scores the graph of patterns and instances in ``ROUNDS`` rounds: a pattern's confidence in a kind
is the sum of its different instances' scores over their number plus one; an instance that is no seed
scores the confidence of its best pattern. Tokens whose pattern has a confidence of ``ACCEPT`` or more
and ``SUPPORT`` different seeds or more become spans of that kind, and support and score further patterns
as seeds do, with their pattern's confidence, until no pattern is accepted any more.

Scale: one pass over the texts gives compact rows of spans, which are written; texts are not shuffled.
The graph has a row for each identifier-like token, distinct (pattern, instance) pairs are counted
map-side, and new spans meet their rows by text hash.

The patterns below match what the plain ones in the contract do, but never scan a run of characters
again from its middle: where a start inside a run can't succeed unless its beginning does, only the
beginning (or the end of the match before) is tried, and repetitions are possessive. Texts of one
long run thus take linear time.

Defined cases: a null or empty text has no spans; equal texts have equal spans; equal identifiers
count once for a pattern; a token before which there are fewer than two words (in ``CONTEXT``
characters, identifiers not counted) has no pattern; very long texts are scanned whole, in time in proportion to them; an empty table gives an empty one; ties between kinds go in the order email, ip, card, phone; other columns
pass unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a pattern to match at all; quick to test.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "phone": r"\+[0-9]"}
DIGITS, CONTEXT, ROUNDS, ACCEPT, SUPPORT = 6, 60, 2, 0.6, 3
TOKEN = rf"(?<!\S)(?=[^\s@]*+@|(?:[^\s0-9]*+[0-9]){{{DIGITS}}})\S++"
#: What a pattern passes over: identifiers of any kind, also in parts.
KNOWN = r"\+[0-9][\x20().0-9-]+[0-9]|(?<![0-9])[0-9]++(?:\.[0-9]++){3}|[0-9](?:[\x20-]?+[0-9]){5,}+|(?<!\S)[^\s@]*+@\S++|(?<!\S)(?:[^\s0-9]*+[0-9]){6}\S*+"
#: Blanks, and marks between them.
BARE = r"\s[^\p{L}\p{N}]*\s"
#: Matches that are placed together; code points in which tokens and spans meet.
BLOCK, CELL = 256, 256

SPANS = "array<struct<s:int,e:int,v:string,l:string>>"


def named(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def matches(text: Column, pattern: str, needs: str) -> Column:
    """Start, end (exclusive, code points), value and text on the left of each match, without earlier identifiers."""
    both = F.zip_with(
        F.split(text, pattern, -1),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("v"), F.substring(p, -CONTEXT, CONTEXT).alias("l")),
    )
    found = F.filter(both, lambda x: x.v.isNotNull())
    state = lambda at, left, out: F.struct(at.alias("at"), left.alias("left"), out.alias("out"))

    def add(done: Column, x: Column) -> Column:
        s = done.at + x.gap
        left = F.regexp_replace(F.regexp_replace(F.when(x.gap >= CONTEXT, x.l).otherwise(F.concat(done.left, x.l)), KNOWN, " "), BARE, " ")
        after = F.when(x.v.rlike(KNOWN), " ").otherwise(F.substring(x.v, -CONTEXT, CONTEXT))
        return named(F.substring(left, -CONTEXT, CONTEXT), lambda l: state(s + x["size"], F.concat(l, after), F.concat(done.out, F.array(F.struct(s.alias("s"), (s + x["size"]).alias("e"), x.v.alias("v"), l.alias("l"))))))

    def add_block(done: Column, block: Column) -> Column:
        return named(F.aggregate(block, state(done.at, done.left, F.array().cast(SPANS)), add), lambda b: state(b.at, b.left, F.concat(done.out, F.array(b.out))))

    # Matches are placed block by block: appending to one long array would copy it each time. The
    # outer transform gives the matches a name, so that they are found once.
    def place(f: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), ((F.size(f) - 1) / F.lit(BLOCK)).cast("int")), lambda i: F.slice(f, i * BLOCK + 1, BLOCK))
        return F.flatten(F.aggregate(cut, state(F.lit(0), F.lit(""), F.array().cast(f"array<{SPANS}>")), add_block, lambda x: x.out))

    return F.when(text.rlike(needs), named(found, place)).otherwise(F.array().cast(SPANS))


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes."""
    one = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(one, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(999)) <= 255))
    if kind == "card":
        return F.length(digits(value)).between(12, 19) & luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def pattern_of(left: Column) -> Column:
    """The last two words before a token, lower-cased, without marks at their ends; null if there are fewer."""
    word = F.filter(F.transform(F.split(F.lower(left), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")), lambda w: w != "")
    return named(word, lambda w: F.when(F.size(w) >= 2, F.array_join(F.slice(w, F.greatest(F.size(w) - 1, F.lit(1)), 2), " ")))


def instance(value: Column) -> Column:
    """A value as the graph knows it."""
    return F.when(value.contains("@"), F.lower(value)).otherwise(digits(value))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, token): base spans with their kinds, and tokens that look like identifiers."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), *(matches(text, PATTERNS[k], NEEDS[k]).alias(k) for k in KINDS), matches(text, TOKEN, r"[0-9@]").alias("token"))
    kind = lambda k, n: F.transform(F.filter(k, lambda x: passes(k, x.v)), lambda x: F.struct(x.s.alias("s"), F.lit(n).alias("k"), x.e.alias("e"), instance(x.v).alias("v"), pattern_of(x.l).alias("p")))
    base = found.withColumn("base", F.array_sort(F.concat(*(kind(k, n) for n, k in enumerate(KINDS)))))
    # Marks around a token aren't part of it.
    lead, own = (lambda v: F.length(F.regexp_extract(v, r"^[^\p{L}\p{N}@+]*+", 0))), (lambda v: F.regexp_replace(v, r"^[^\p{L}\p{N}@+]++|(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$", ""))
    token = F.transform("token", lambda x: F.struct((x.s + lead(x.v)).alias("s"), (x.s + lead(x.v) + F.length(own(x.v))).alias("e"), own(x.v).alias("v"), x.l.alias("l")))
    token = F.filter(token, lambda x: (x.v.rlike(r"[^@]@[^@]")) | (F.length(digits(x.v)) >= DIGITS))
    return base.withColumn("token", token).select("doc_id", "key", "base", F.transform("token", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), instance(x.v).alias("v"), pattern_of(x.l).alias("p"))).alias("token"))


def free_tokens(found: DataFrame) -> DataFrame:
    """(key, s, e, v, p): tokens of each different text that no base span overlaps.

    Tokens and spans meet in cells of ``CELL`` code points, of which each holds a few, whatever a text holds.
    """
    one = found.where("size(token) > 0").select("key", "base", "token").dropDuplicates(["key"])
    tokens = common.cut(one.select("key", F.explode("token").alias("x")).select("key", "x.*"))
    cells = F.explode(F.sequence((F.col("s") / CELL).cast("int"), ((F.col("e") - 1) / CELL).cast("int"))).alias("cell")
    spans = one.select("key", F.explode("base").alias("x")).select("key", F.col("x.s").alias("bs"), F.col("x.e").alias("be"), "x.s", "x.e").select("key", "bs", "be", cells)
    hit = tokens.select("key", "s", "e", cells).join(spans, ["key", "cell"]).where("bs < e and s < be").select("key", "s").distinct()
    return tokens.join(hit, ["key", "s"], "left_anti")


def accepted(found: DataFrame, tokens: DataFrame) -> DataFrame:
    """(p, k): patterns that say of what kind a token is."""
    seeds = found.select(F.explode("base").alias("x")).select("x.p", "x.v", "x.k").distinct()
    others = tokens.select("p", "v")
    edges = common.cut(seeds.select("p", "v").unionByName(others).where("p is not null").distinct())
    sizes = edges.groupBy("p").agg(F.count("*").alias("size"))
    fixed = common.cut(seeds.select("v", "k").distinct().withColumn("score", F.lit(1.0)))
    scores = fixed
    own = seeds.where("p is not null").groupBy("p", "k").agg(F.count("*").alias("support"))

    def confident(scores: DataFrame) -> DataFrame:
        return common.cut(edges.join(scores, "v").groupBy("p", "k").agg(F.sum("score").alias("total")).join(sizes, "p").select("p", "k", (F.col("total") / (F.col("size") + 1)).alias("confidence")))

    def unseen(patterns: DataFrame) -> DataFrame:
        """Instances that are no seeds, with the confidence of the best of the patterns."""
        new = edges.join(patterns, "p").groupBy("v", "k").agg(F.max("confidence").alias("score"))
        return common.cut(new.join(fixed.select("v").distinct(), "v", "left_anti"))

    def chosen(confidence: DataFrame, support: DataFrame) -> DataFrame:
        best = confidence.join(support, ["p", "k"]).where((F.col("confidence") >= ACCEPT) & (F.col("support") >= SUPPORT))
        return best.groupBy("p").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "k")).alias("b")).select("p", "b.k", (-F.col("b.c")).alias("confidence"))

    for at in range(ROUNDS):
        confidence = confident(scores)
        if at < ROUNDS - 1:
            scores = fixed.unionByName(unseen(confidence))
    taken = common.cut(chosen(confidence, own))
    # What is accepted counts as the seeds do; an instance under no accepted pattern keeps its score,
    # as patterns would raise themselves through their own instances otherwise.
    while True:
        known = fixed.unionByName(unseen(taken))
        support = edges.join(known.select("v", "k"), "v").groupBy("p", "k").agg(F.count("*").alias("support"))
        confidence = confident(known.unionByName(scores).groupBy("v", "k").agg(F.max("score").alias("score")))
        more = common.cut(chosen(confidence, support).join(taken, "p", "left_anti"))
        if more.isEmpty():
            return taken.select("p", "k")
        taken = common.cut(taken.unionByName(more))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, new): base spans and those that patterns add, as arrays of (s, k, e)."""
    found = common.cut(scan(docs))
    tokens = common.cut(free_tokens(found))
    patterns = accepted(found, tokens)
    new = tokens.where("p is not null").join(patterns, "p").groupBy("key").agg(F.collect_list(F.struct("s", "k", "e")).alias("new"))
    plain = found.select("doc_id", "key", F.transform("base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"))).alias("base"))
    return plain.join(new, "key", "left").select("doc_id", "base", F.coalesce("new", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("new"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s, x.e)), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: personal data in every document."""
    found = detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("base", lambda x: x.k == n)).cast("bigint")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "new")).alias("spans"))
