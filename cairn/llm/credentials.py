"""Secret scan: base patterns, and weak parts of credentials that complementary parts beside them confirm, in DataFrame functions only.

Base spans (assign, access, hex) come from fixed patterns and stay as they are. A second scan finds the parts a
credential can have: identifiers (AKIA keys, or values called user, client id ...), secrets (base assignments and
hex runs, values called pwd, pass ..., runs of ``RUN`` characters or more with upper case, lower case and digits), and endpoints (URLs, values
called host, server ...). Alone the weak ones of these mean little, so each is reported only if parts that complete it co-occur:
a secret with an identifier or an endpoint, an identifier with a secret, an endpoint with both. Parts co-occur if they are in the same
scope, which a blank line ends, and begin at most ``REACH`` code points apart. Reported parts are the kinds id, key and endpoint.

The interval join is an equi-join: starts fall into cells of ``REACH`` code points, of which each keeps the least and the
largest start of a role, and a weak part looks into its own cell and the two beside it. What is in its own cell
is near enough, the cell before counts if its largest start is, the one after if its least is. So no pairs
of parts are made, whatever a scope holds.

Scale: one pass over the texts, whose compact spans are written; texts are not shuffled. Only texts with a weak part and parts
of two roles are looked at further, equal texts once. A long text's parts are dealt by (text, scope, cell).

Defined cases: a null or empty text has no spans; equal texts have equal spans; a match that fails its check is dropped without a
retry; parts of the second scan never overlap each other, but may overlap base spans; ties of start go in the order of ``KINDS``; repeated
rows give repeated rows; very long texts are scanned whole, matches being placed block by block; an empty table gives an empty
result; other columns pass unread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .private import named

BASE = ("assign", "access", "hex")
WEAK = ("id", "key", "endpoint")
KINDS = BASE + WEAK
REACH, RUN = 200, 20
#: Matches that are placed together: appending to one long array would copy it each time.
BLOCK = 256

_LINK = r"[\"']?\x20*[:=]\x20*[\"']?"
_SECRET = r"(?i:password|passwd|secret|token|api_?key)"
_ID = r"(?i:user(?:name)?|login|account|client[_-]?id|app[_-]?id|access[_-]?key(?:[_-]?id)?|tenant(?:[_-]?id)?)"
_PASS = r"(?i:pwd|passphrase|pass|credentials?|auth)"
_HOST = r"(?i:host(?:name)?|endpoint|server|base_?url|domain)"
_URL = r"(?:https?|ftps?|ssh|amqps?|mongodb|postgres(?:ql)?|mysql|redis|jdbc:[a-z0-9]+)://"
_BREAK = r"\n[\x20\t\r]*\n"
PATTERNS = {"assign": rf"{_SECRET}{_LINK}[A-Za-z0-9+/_.=-]+", "access": "AKIA[A-Z0-9]+", "hex": "{start}[0-9a-f]{{24,}}"}
#: Parts and ends of scopes. A place in {} is where runs may begin: there they are tried once, not from each character on.
PARTS = "|".join((
    PATTERNS["assign"], "AKIA[A-Z0-9]{{16,}}", PATTERNS["hex"], rf"{_URL}[^\x20\t\r\n\"'<>]+", rf"{_HOST}{_LINK}[A-Za-z0-9._:/-]+", rf"{_ID}{_LINK}[A-Za-z0-9+/_.@-]+",
    rf"{_PASS}{_LINK}[A-Za-z0-9+/_.=-]+", f"{{run}}[A-Za-z0-9+/_-]{{{{{RUN},}}}}={{{{0,2}}}}", _BREAK,
))
#: What a text must have for a pattern to match at all; quick to test.
NEEDS = {"assign": r"[:=]", "access": "AKIA", "hex": "[0-9a-f]{24}"}
#: A weak part needs one role of each of these.
NEEDED = {"key": [("id", "endpoint")], "id": [("secret",)], "endpoint": [("secret",), ("id",)]}

PLACED = "array<struct<s:int,e:int,v:string,scope:int>>"


def java(pattern: str) -> str:
    """A pattern whose runs are tried from their beginning, or the end of the match before, only."""
    return pattern.format(start=r"(?:\G|(?<![0-9a-f]))", run=r"(?:\G|(?<![A-Za-z0-9+/_-]))")


def re2(pattern: str) -> str:
    """The same for an engine that takes linear time anyway."""
    return pattern.format(start="", run="").replace("'", "''")


def placed(text: Column, pattern: str, needs: str) -> Column:
    """Start, end (exclusive, code points), value and scope of each match; a scope is the number of blank lines among the matches before."""
    found = F.filter(
        F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("v"))),
        lambda x: x.v.isNotNull(),
    )
    state = lambda at, scope, out: F.struct(at.alias("at"), scope.alias("scope"), out.alias("out"))

    def add(done: Column, x: Column) -> Column:
        s = done.at + x.gap
        one = F.struct(s.alias("s"), (s + x["size"]).alias("e"), x.v.alias("v"), done.scope.alias("scope"))
        return state(s + x["size"], done.scope + x.v.startswith("\n").cast("int"), F.concat(done.out, F.array(one)))

    def add_block(done: Column, block: Column) -> Column:
        return named(F.aggregate(block, state(done.at, done.scope, F.array().cast(PLACED)), add), lambda b: state(b.at, b.scope, F.concat(done.out, F.array(b.out))))

    def all_of(f: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(f) - 1) / F.lit(BLOCK)).cast("int")), lambda i: F.slice(f, i * BLOCK + 1, BLOCK))
        return F.flatten(F.aggregate(blocks, state(F.lit(0), F.lit(0), F.array().cast(f"array<{PLACED}>")), add_block, lambda x: x.out))

    return F.when(text.rlike(needs), named(found, all_of)).otherwise(F.array().cast(PLACED))


def value(v: Column) -> Column:
    """What is assigned."""
    return F.regexp_extract(v, r"^[^:=]*[:=]\x20*[\"']?(.*)$", 1)


def passes(kind: str, v: Column) -> Column:
    """The check of a base match."""
    return {"assign": F.length(value(v)) >= 6, "access": F.length(v) >= 20}.get(kind, F.lit(True))


def kind_of(v: Column) -> Column:
    """The kind of a part; null if it fails its check, or is the end of a scope."""
    begins = lambda head: v.rlike(f"^{head}{_LINK}")
    long = lambda least: F.length(value(v)) >= least
    mixed = v.rlike("[A-Z]") & v.rlike("[a-z]") & v.rlike("[0-9]")
    return (
        F.when(v.startswith("\n"), None)
        .when(begins(_SECRET), F.when(long(6), "assign"))
        .when(v.startswith("AKIA"), "access")
        .when(v.rlike("^[0-9a-f]{24,}$"), "hex")
        .when(v.rlike(f"^{_URL}"), "endpoint")
        .when(begins(_HOST), F.when(long(4), "endpoint"))
        .when(begins(_ID), F.when(long(3), "id"))
        .when(begins(_PASS), F.when(long(6), "key"))
        .otherwise(F.when(mixed, "key"))
    )


def role(kind: Column) -> Column:
    return F.when(kind.isin("access", "id"), "id").when(kind == "endpoint", "endpoint").otherwise("secret")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, parts): base spans with the numbers of their kinds, and the parts of texts that have weak ones."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text.cast("binary")).alias("key"), *(placed(text, java(PATTERNS[k]), NEEDS[k]).alias(k) for k in BASE), placed(text, java(PARTS), rf"[:=]|AKIA|[A-Za-z0-9+/_-]{{{RUN}}}").alias("parts"))
    own = lambda k, n: F.transform(F.filter(k, lambda x: passes(k, x.v)), lambda x: F.struct(x.s.alias("s"), F.lit(n).alias("k"), x.e.alias("e")))
    parts = F.filter(F.transform("parts", lambda x: F.struct(x.s.alias("s"), x.e.alias("e"), x.scope.alias("scope"), kind_of(x.v).alias("kind"))), lambda x: x.kind.isNotNull())
    return found.select("doc_id", "key", F.array_sort(F.concat(*(own(k, n) for n, k in enumerate(BASE)))).alias("base"), parts.alias("parts"))


def linked(parts: DataFrame) -> DataFrame:
    """Weak parts that are complete: (key, s, e, kind). ``parts``: (key, scope, s, e, kind), each once."""
    each = parts.withColumn("role", role(F.col("kind"))).withColumn("cell", F.floor(F.col("s") / REACH))
    held = each.groupBy("key", "scope", "cell", F.col("role").alias("other")).agg(F.min("s").alias("least"), F.max("s").alias("most"))
    weak = each.where(F.col("kind").isin(*WEAK)).select("key", "scope", "s", "e", "kind", "role", F.col("cell").alias("at"), F.explode(F.array(*(F.col("cell") + d for d in (-1, 0, 1)))).alias("cell"))
    near = F.when(F.col("cell") < F.col("at"), F.col("most") >= F.col("s") - REACH).when(F.col("cell") > F.col("at"), F.col("least") <= F.col("s") + REACH).otherwise(True)
    met = weak.join(held, ["key", "scope", "cell"]).where((F.col("other") != F.col("role")) & near)
    seen = met.groupBy("key", "s", "e", "kind").agg(F.collect_set("other").alias("others"))  # of three roles
    complete = lambda kind: reduce(lambda a, b: a & b, (F.arrays_overlap("others", F.array(*map(F.lit, any_of))) for any_of in NEEDED[kind]))
    return seen.where(reduce(lambda a, b: a | b, ((F.col("kind") == k) & complete(k) for k in WEAK))).drop("others")


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, base, new): base spans and the weak parts that are complete, as arrays of (s, k, e)."""
    found = common.cut(scan(docs))
    roles = F.array_distinct(F.transform("parts", lambda x: role(x.kind)))
    asked = found.where((F.size(roles) > 1) & F.exists("parts", lambda x: x.kind.isin(*WEAK))).select("key", "parts").dropDuplicates(["key"])
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    new = linked(asked.select("key", F.explode("parts").alias("x")).select("key", "x.*")).groupBy("key").agg(F.collect_list(F.struct("s", number.alias("k"), "e")).alias("new"))
    return found.select("doc_id", "key", "base").join(new, "key", "left").select("doc_id", "base", F.coalesce("new", F.array().cast("array<struct<s:int,k:int,e:int>>")).alias("new"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(kinds, x.k + 1), x.s, x.e)), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: secrets in every document."""
    found = detect(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda n: F.size(F.filter("base", lambda x: x.k == n)).cast("bigint")
    counts = [count(n).alias(f"n_{k}") for n, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "new")).alias("spans"))


def _sql() -> str:
    def hits(name: str, pattern: str) -> str:
        return f"""{name}_m as (select rid, unnest(string_split_regex(t, '{pattern}')) as gap, unnest(regexp_extract_all(t, '{pattern}')) as v, unnest(generate_series(1, len(regexp_extract_all(t, '{pattern}')) + 1)) as i from d),
{name} as (select rid, v, i, sum(length(gap) + coalesce(length(v), 0)) over (partition by rid order by i) - coalesce(length(v), 0) as s, sum(case when v like e'\\n%' then 1 else 0 end) over (partition by rid order by i) as scope from {name}_m)"""

    begins = lambda head: f"regexp_matches(v, '^{re2(head + _LINK)}')"
    val = f"regexp_extract(v, '^[^:=]*[:=] *[\"'']?(.*)$', 1)"  # noqa: F541
    kind = f"""case when v like e'\\n%' then null when {begins(_SECRET)} then case when length({val}) >= 6 then 'assign' end when v like 'AKIA%' then 'access' when regexp_full_match(v, '[0-9a-f]{{24,}}') then 'hex'
  when regexp_matches(v, '^{re2(_URL)}') then 'endpoint' when {begins(_HOST)} then case when length({val}) >= 4 then 'endpoint' end when {begins(_ID)} then case when length({val}) >= 3 then 'id' end
  when {begins(_PASS)} then case when length({val}) >= 6 then 'key' end when regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[0-9]') then 'key' end"""
    checks = {"assign": f"length({val}) >= 6", "access": "length(v) >= 20", "hex": "true"}
    base = " union all ".join(f"select rid, '{k}' as kind, {n} as k, s, s + length(v) as e from {k} where v is not null and {checks[k]}" for n, k in enumerate(BASE))
    has = lambda other: f"exists (select 1 from parts q where q.rid = p.rid and q.scope = p.scope and q.role in ({other}) and abs(q.s - p.s) <= {REACH})"
    text = lambda of: f"string_agg(kind || ':' || s || ':' || e, ',' order by s, k, e) as {of}"
    return f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
{hits('assign', re2(PATTERNS['assign']))}, {hits('access', re2(PATTERNS['access']))}, {hits('hex', re2(PATTERNS['hex']))}, {hits('part', re2(PARTS))},
base as ({base}),
parts as (select *, case when kind in ('access', 'id') then 'id' when kind = 'endpoint' then 'endpoint' else 'secret' end as role from (select rid, scope, s, s + length(v) as e, {kind} as kind from part where v is not null) where kind is not null),
new as (select rid, kind, case kind when 'id' then 3 when 'key' then 4 else 5 end as k, s, e from parts p where kind = 'key' and {has("'id', 'endpoint'")} or kind = 'id' and {has("'secret'")} or kind = 'endpoint' and {has("'id'")} and {has("'secret'")}),
bs as (select rid, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)}, {text('b')} from base group by rid),
ws as (select rid, {text('w')} from (select * from base union all select * from new) group by rid)
select cast(doc_id as bigint) as doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE)}, sha256(coalesce(b, '')) as base_sha256, coalesce(w, '') as spans from d left join bs using (rid) left join ws using (rid)"""


SQL = _sql()
