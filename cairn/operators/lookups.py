"""Lookups at a service under one budget, with a cache that grows.

What isn't in the cache is ranked once; the budget is dealt to groups by rank, and groups to tasks, so that all tasks
together never send more requests than there are. A group asks its queries in order until one is answered. Answers, and
that there was none, are appended to the cache table, so that a second run asks nothing that was asked.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.sources import remote

CACHE = "key string, found boolean, value string"
#: Requests of a run and seconds between those of a task, for points and for texts.
POINTS, TEXTS = (250, 0.2), (80, 1.0)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, found, value) of a cache table; none yet gives no rows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(CACHE).parquet(path) if there else spark.createDataFrame([], CACHE)


def points(cache: DataFrame) -> DataFrame:
    """(key, lat, lng) as ``enrich.fill_points`` takes them."""
    got = F.from_json("value", "lat double, lng double")
    return cache.where("found").select("key", got.alias("v")).select("key", "v.lat", "v.lng")


def texts(cache: DataFrame) -> DataFrame:
    """(key, text) as ``enrich.genre_of_texts`` takes them."""
    return cache.where("found").select("key", F.col("value").alias("text"))


def point_of(answer: str, hint: str | None) -> str | None:
    """The first place whose title has the prefecture, else the first, as JSON; none if there is no place."""
    found = remote.geocoder_answers(answer)
    best = next((p for p in found if hint and hint in p[2]), found[0] if found else None)
    return json.dumps({"lat": best[0], "lng": best[1]}) if best else None


def text_of(answer: str, hint: str | None) -> str | None:
    """A text that isn't empty."""
    return answer or None


def address_queries(groups: DataFrame) -> DataFrame:
    """(group, rank, hint, queries) of ``enrich.address_groups``: candidates in order, by the groups' first ids."""
    asked = F.transform(X.geocode_queries(F.col("name"), F.col("query_address")), lambda q: q)
    own = groups.select("key", F.col("ids")[0].alias("rank"), X.prefecture(F.col("address")).alias("hint"), F.posexplode(asked).alias("at", "query"))
    keyed = own.withColumn("q", F.struct("at", "query", X.light_key(F.col("query")).alias("key")))
    return keyed.groupBy(F.col("key").alias("group")).agg(F.min("rank").alias("rank"), F.first("hint").alias("hint"), F.array_sort(F.collect_list("q")).alias("queries"))  # four at most


def fill(wanted: DataFrame, path: str, transport: str, parameter: str, parse: Callable[[str, str | None], str | None], limit: int, delay: float = 0.0, tasks: int = 4) -> DataFrame:
    """Ask for what the cache at ``path`` hasn't, with ``limit`` requests at most, and return the cache with the answers.

    ``wanted``: (group, rank, hint, queries: array of struct(at, query, key)); ``transport``: a function's module and name, of
    parameters to (status, text), as executors import it. A query of several groups is the first one's. A failed request
    counts, and is asked again in the next run.
    """
    spark = wanted.sparkSession
    cache = read(spark, path)
    each = wanted.select("group", "rank", "hint", F.explode("queries").alias("q")).select("*", F.col("q.key").alias("key"))
    met = each.join(cache.select("key", "found").dropDuplicates(["key"]), "key", "left")
    first = F.min(F.struct("rank", "group")).over(Window.partitionBy("key"))
    own = F.when(F.col("found").isNotNull(), F.col("found")).when(first != F.struct("rank", "group"), False)
    state = met.withColumn("found", own).groupBy("group").agg(F.min("rank").alias("rank"), F.first("hint").alias("hint"), F.array_sort(F.collect_list(F.struct("q.at", "q.query", "q.key", "found"))).alias("queries"))
    # Up to the first that is known to be found.
    at = F.array_position(F.transform("queries", lambda q: F.coalesce(q.found, F.lit(False))), True).cast("int")
    open_ = F.filter(F.when(at > 0, F.slice("queries", 1, F.greatest(at - 1, F.lit(0)))).otherwise(F.col("queries")), lambda q: q.found.isNull())
    # Each needs a request at least, so no more groups than requests can have one; the window is over these.
    next_ = state.withColumn("queries", open_).where("size(queries) > 0").orderBy("rank", "group").limit(limit)
    before = F.sum(F.size("queries")).over(Window.orderBy("rank", "group").rowsBetween(Window.unboundedPreceding, -1))
    dealt = next_.withColumn("share", F.least(F.size("queries"), F.lit(limit) - F.coalesce(before, F.lit(0))).cast("int")).where("share > 0")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = transport.rpartition(".")
        send = getattr(importlib.import_module(module), name)
        for batch in batches:
            rows = []
            for hint, queries, share in zip(batch["hint"], batch["queries"], batch["share"], strict=True):
                for q in queries[:share]:
                    try:
                        status, answer = send({parameter: q["query"]})
                    except Exception:  # noqa: S112 - the request counts, its URL must not be shown
                        continue
                    finally:
                        if delay:
                            time.sleep(delay)
                    if status >= 400:
                        continue
                    value = parse(answer, hint)
                    rows.append((q["key"], value is not None, value))
                    if value is not None:
                        break
            yield pd.DataFrame(rows, columns=["key", "found", "value"])

    # Written at once: a request is not sent again when the answers are read again.
    dealt.select("hint", "queries", "share").repartition(tasks).mapInPandas(ask, CACHE).write.mode("append").parquet(path)
    return read(spark, path)
