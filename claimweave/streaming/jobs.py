"""Incremental forms as Structured Streaming jobs; each has a batch twin in the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import claims, graph
from ..sources.papers import CLAIM


def claim_stream(spark: SparkSession, path: str) -> DataFrame:
    """Claims of extract files as they land; the checkpoint knows which were read."""
    return spark.readStream.schema(CLAIM).option("multiLine", True).option("pathGlobFilter", "*_triples.json").json(path)


def validate_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Normalise and validate; valid and rejected claims are two partitions of one sink."""
    checked = claims.validate(claims.normalize_claims(stream)).withColumn("part", F.when(F.col("reject_rule").isNull(), "valid").otherwise("rejected"))
    return checked.writeStream.format("parquet").partitionBy("part").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


#: Buckets of an edge table; all of them together are the rows of a manifest.
BUCKETS = 64


def _bucket(edges: DataFrame, buckets: int) -> DataFrame:
    return edges.withColumn("bucket", F.pmod(F.xxhash64(*graph.EDGE_KEY), F.lit(buckets)).cast("int"))


def _versions(spark: SparkSession, table: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket in the latest manifest, or in the latest before a batch."""
    listed = spark.read.schema("bucket int, version long, batch long").option("recursiveFileLookup", True).parquet(f"{table}/manifest")
    listed = listed if before is None else listed.where(F.col("batch") < before)
    return {r["bucket"]: r["version"] for r in listed.groupBy("bucket").agg(F.max_by("version", "batch").alias("version")).collect()}  # a row a bucket


def read_edges(spark: SparkSession, table: str, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
    """The edges of a table that upsert_stream keeps: all of it, or some buckets, now or as before a batch."""
    paths = [f"{table}/v={v}/bucket={b}" for b, v in sorted(_versions(spark, table, before).items()) if buckets is None or b in buckets]
    some = spark.read.parquet(*paths) if paths else spark.read.parquet(f"{table}/empty")
    return some


def upsert_stream(stream: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Merge claims into a bucketed edge table, which belongs to this checkpoint.

    Edges are dealt to buckets by a hash of their key.  Batch n reads and writes the buckets it touches, as v=n, and then its
    manifest, which names the version of each touched bucket; other buckets keep their files.  A batch that is run again finds
    the table as before it, so it changes nothing.  Files of versions that no bucket uses any more stay until they are removed.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        edges = _bucket(graph.build_edges(claims.valid_claims(claims.validate(claims.normalize_claims(batch)))), buckets)
        if n == 0:
            edges.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{table}/empty")
            spark.createDataFrame([], "bucket int, version long, batch long").write.mode("overwrite").parquet(f"{table}/manifest/start")
        edges = edges.persist()
        touched = sorted(r["bucket"] for r in edges.select("bucket").distinct().collect())  # at most `buckets` rows
        if touched:
            known = read_edges(spark, table, touched, n)
            merged = _bucket(graph.upsert_edges(known, edges.drop("bucket")), buckets)
            merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={n}")
            rows = spark.createDataFrame([(b, n, n) for b in touched], "bucket int, version long, batch long")
            rows.coalesce(1).write.mode("overwrite").parquet(f"{table}/manifest/n{n}")
        edges.unpersist()

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def demand_stream(events: DataFrame) -> DataFrame:
    """entity, kind, ts to counts per day; events over a day late are dropped."""
    return events.where(F.trim("entity") != "").withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "entity", "kind").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "entity", "kind", "n")


def visit_stream(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Visits of a user, apart by more than `gap`."""
    return events.withWatermark("ts", "1 day").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("ended"), "n")


def context_expiry(contexts: DataFrame, now, days: int = 30) -> DataFrame:
    """Saved contexts (ts) that are not yet out of date."""
    return contexts.where(F.col("ts") + F.expr(f"INTERVAL {days} DAYS") > F.lit(now).cast("timestamp"))
