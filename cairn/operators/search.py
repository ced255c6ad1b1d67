"""Name search and completion over tables that are written once.

A text's runs of ``GRAM`` characters, in lower case, become postings that carry the text's row. They lie in a folder for each bucket of runs, sorted by
run, so that a search reads one bucket, and of it the row groups that can hold its run: that of the needle's runs with the
fewest rows. What is read is checked against the whole needle. For completion the rows lie sorted by their texts in lower case,
so that a prefix is a range of row groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from cairn.functions import text as X

GRAM, BUCKETS = 3, 64


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that driver and executors share: spark.checkpoint.dir, or the warehouse on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"
    return f"{shared}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def _bucket(run: Column) -> Column:
    return F.pmod(F.xxhash64(run), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    """Where the tables of an index are, and which column it is of."""

    path: str
    column: str
    columns: StructType

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        run = StructType([StructField("__run", StringType()), *([StructField("n", LongType())] if name == "counts" else []), StructField("__bucket", IntegerType())])
        own = {"sorted": self.columns.fields, "postings": self.columns.fields + run.fields, "counts": run.fields}[name]
        return spark.read.schema(StructType(own)).parquet(f"{self.path}/{name}")


def build(rows: DataFrame, column: str, path: str | None = None) -> Index:
    """Write the index of ``rows`` by a text column, which must not be named __run, __bucket or __key. Rows with a null text are in none."""
    path = path or scratch(rows.sparkSession)
    own = rows.where(F.col(column).isNotNull()).withColumn("__key", F.lower(F.col(column)))
    own.repartitionByRange("__key").sortWithinPartitions("__key").write.parquet(f"{path}/sorted")
    posted = own.withColumn("__run", F.explode(X.grams(F.col("__key"), GRAM))).withColumn("__bucket", _bucket(F.col("__run")))
    order = ["__bucket", "__run", "__key"]
    posted.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("__bucket").parquet(f"{path}/postings")
    counts = posted.groupBy("__bucket", "__run").agg(F.count("*").alias("n"))
    counts.repartitionByRange("__bucket", "__run").sortWithinPartitions("__bucket", "__run").write.partitionBy("__bucket").parquet(f"{path}/counts")
    return Index(path, column, own.schema)


def containing(spark: SparkSession, index: Index, needle: str) -> DataFrame:
    """Rows whose text contains the needle, in any case. A needle shorter than ``GRAM`` reads the sorted table, a longer one a bucket."""
    low = needle.lower()
    hit = F.contains("__key", F.lit(low))
    if len(low) < GRAM:
        return index.table(spark, "sorted").where(hit).drop("__key")
    runs = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
    bucket = {r[0]: r[1] for r in spark.createDataFrame([(r,) for r in runs], "run string").select("run", _bucket(F.col("run"))).collect()}
    seen = index.table(spark, "counts").where(F.col("__bucket").isin(sorted({*bucket.values()})) & F.col("__run").isin(runs))
    rows = {r["__run"]: r["n"] for r in seen.select("__run", "n").collect()}  # one a run of the needle
    rarest = min(runs, key=lambda r: (rows.get(r, 0), r))
    return index.table(spark, "postings").where((F.col("__bucket") == bucket[rarest]) & (F.col("__run") == rarest) & hit).drop("__key", "__run", "__bucket")


def beginning(spark: SparkSession, index: Index, prefix: str) -> DataFrame:
    """Rows whose text begins with the prefix, in any case."""
    low = prefix.lower()
    return index.table(spark, "sorted").where(F.col("__key").startswith(low) & (F.col("__key") >= low)).drop("__key")


def first(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """O2: the first ``k`` rows in order."""
    return rows.orderBy(*order).limit(k)
