"""Lineage, and the rules a published set must pass (A3, A8, U2, V, W). The merge of snapshots is in ``publish``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import numbers as N


def lost(before: DataFrame, after: DataFrame, column: str = "legacy_id") -> DataFrame:
    """Ids of one side only; none when lineage is conserved."""
    ids = lambda d: d.where(F.col(column).isNotNull()).select(column).distinct()
    return ids(before).exceptAll(ids(after)).withColumn("missing_in", F.lit("after")).unionByName(ids(after).exceptAll(ids(before)).withColumn("missing_in", F.lit("before")))


def violations(rows: DataFrame, rules: dict[str, Column], row: str) -> DataFrame:
    """V, W: (row, rule) for each rule, a condition of what is wrong, that a row breaks; null conditions count as kept."""
    broken = F.array_compact(F.array(*(F.when(wrong, F.lit(name)) for name, wrong in rules.items())))
    return rows.select(F.col(row).alias("row"), F.explode(broken).alias("rule"))


def public_rules(as_of: Column, allowed=("hotpepper", "legacy_local"), statuses=("current", "legacy_unverified")) -> dict[str, Column]:
    """The row rules V2-V17 over name, sources, lat, lng, url, listing_url, legacy_id, data_status, last_verified_at and budgets."""
    from cairn.functions import text as X

    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    own = X.tokens(F.col("sources"))
    listed = F.array_contains(own, allowed[0])
    old = F.array_contains(own, allowed[1])
    number = lambda c: F.col(c).try_cast("double")
    budget = lambda c: ~blank(c) & (N.public_budget(F.col(c)) == "")
    return {
        "V2": blank("name"),
        "V3": (F.size(own) == 0) | (F.size(F.array_except(own, F.array(*map(F.lit, allowed)))) > 0),
        "V4": number("lat").isNull() | number("lng").isNull(),
        "V5": number("lat").isNotNull() & number("lng").isNotNull() & ~N.valid_point(F.col("lat"), F.col("lng")),
        "V6": listed & blank("listing_url"),
        "V7": ~blank("listing_url") & X.listing_id(F.col("listing_url"), ["hotpepper.jp", "www.hotpepper.jp"]).isNull(),
        "V9": ~listed & ~blank("listing_url"),
        "V10": old & (X.valid_legacy_id(F.col("legacy_id")) == ""),
        "V11": ~old & ~blank("legacy_id"),
        "V12": (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, allowed)))) == 0) & ((listed == blank("listing_url")) | (old == blank("legacy_id"))),
        "V13": F.when(~blank("listing_url"), F.trim(F.coalesce(F.col("url"), F.lit(""))) != F.trim(F.col("listing_url"))).otherwise(~blank("url")),
        "V14": ~F.coalesce(F.col("data_status").isin(list(statuses)), F.lit(False)),
        "V15": (F.col("data_status") == statuses[0]) & ~listed,
        "V16": N.past_date(F.col("last_verified_at"), as_of).isNull(),
        "V17": budget("budget_lunch") | budget("budget_dinner") | budget("avg_dinner_budget"),
    }


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, and how often."""
    return rows.where(F.col(column).isNotNull() & (F.col(column) != "")).groupBy(column).agg(F.count("*").alias("n")).where("n > 1")


def scope(rows: DataFrame, column: str = "sources") -> DataFrame:
    """A3: one row, ``source_scope``: the distinct sources of all rows, sorted and joined. ``column``: an array."""
    return rows.select(F.explode(column).alias("s")).agg(F.array_join(F.array_sort(F.collect_set("s")), ",").alias("source_scope"))


def domain_counts(rows: DataFrame, column: str, domain: list[str]) -> DataFrame:
    """(value, n) of each value of the domain, zero where no row has it. One aggregate, whatever the keys' skew."""
    one = rows.agg(*(F.count_if(F.col(column) == v).alias(f"c{k}") for k, v in enumerate(domain)))
    return one.select(F.inline(F.array(*(F.struct(F.lit(v).alias("value"), F.col(f"c{k}").alias("n")) for k, v in enumerate(domain)))))
