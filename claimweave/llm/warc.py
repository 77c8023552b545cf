"""WARC records and a Merkle fixity audit of their replicas.

``records`` turns pages into WARC/1.0 resource records, ``layout`` gives each record its archive and
byte offset there (the manifest), ``write_archives`` and ``read_archives`` move them to and from
files.  ``tree`` hashes each record (leaf), then ordered ranges of offsets, ``FANOUT`` times wider
from level to level up to whole archives, then ranges of archives up to one root; each level is a
stored table.  Each replica builds its tree from its own records alone: the manifest publishes the
first key of each range, and a record belongs to the last range that begins at or before its key, so
a lost or added record does not move those behind it.  ``audit`` compares the two roots and reads,
level by level, only the children of nodes that differ; records meet only within ranges that differ.

Defined results: null url and html count as empty; repeated rows are records of their own (copy 0,
1, ...); null page ids are kept; a record that the replica lacks is ``lost``, one whose hash differs
``altered``, one that the manifest does not know ``extra`` (no offset); equal replicas give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

ARCHIVE_BYTES = 8 << 20
RANGE_BYTES = 64 << 10
FANOUT = 16
KEY = ["page_id", "url", "copy"]
END = "\r\n\r\n"


def records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """page_id, url, record (the record's text up to, not with, its closing blank lines)."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    h = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Date: ", date, "\r\nWARC-Record-ID: <urn:uuid:", uuid, ">\r\nWARC-Target-URI: ", url, "\r\nContent-Type: text/html\r\nContent-Length: ", F.octet_length(html).cast("string"), END, html]
    return pages.select("page_id", url.alias("url"), F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in head]).alias("record"))


def leaves(recs: DataFrame) -> DataFrame:
    """page_id, url, copy, length (with the closing blank lines), hash of every record."""
    hashed = recs.select("page_id", "url", (F.octet_length("record") + len(END)).cast("bigint").alias("length"), F.sha2("record", 256).alias("hash"))
    # Repeated rows are counted before they are told apart, so they meet in no task.
    counted = hashed.groupBy("page_id", "url", "length", "hash").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("page_id", "url").orderBy("hash", "length").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counted.withColumn("before", before).select("page_id", "url", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)).alias("copy"), "length", "hash")


def _archive(n: int | Column) -> Column:
    """The archive of a record among n, by a hash of its key."""
    key = F.md5(F.concat_ws(" ", F.coalesce(F.col("page_id").cast("string"), F.lit("")), "url", "copy"))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") % n


def layout(own: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """leaves with archive and offset: the manifest.  Archives are dealt by a hash, and so are about equal."""
    total = own.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    order = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "url", "copy").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("n_archives", F.lit(total // archive_bytes + 1)).withColumn("archive", _archive(F.col("n_archives")))
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(order), F.lit(0)))


def write_archives(recs: DataFrame, manifest: DataFrame, path: str) -> None:
    """One WARC file per archive, its records in the manifest's order.  A copy's record equals the others of its hash."""
    whole = recs.withColumn("hash", F.sha2("record", 256)).dropDuplicates(["page_id", "url", "hash"])
    placed = manifest.join(whole.select(F.col("page_id").alias("__p"), F.col("url").alias("__u"), F.col("hash").alias("__h"), "record"), F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("url") == F.col("__u")) & (F.col("hash") == F.col("__h")))
    ordered = placed.select("archive", "offset", "record").repartition("archive").sortWithinPartitions("archive", "offset")
    ordered.select(F.col("record").alias("value"), "archive").write.partitionBy("archive").option("lineSep", END).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """archive, offset, length, url, record from WARC files; lengths come from the records' own headers."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data, at = raw.as_py(), 0
                while at < len(data):
                    body = data.index(b"\r\n\r\n", at) + 4
                    fields = dict(x.split(b": ", 1) for x in data[at:body].strip().split(b"\r\n")[1:])
                    end = body + int(fields[b"Content-Length"])
                    one = ([archive], [at], [end + 4 - at], [fields.get(b"WARC-Target-URI", b"").decode()], [data[at:end].decode("utf-8", "replace")])
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["archive", "offset", "length", "url", "record"])
                    at = end + 4

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.regexp_extract("path", r"archive=(\d+)", 1).cast("bigint").alias("archive"), "content").mapInArrow(parse, "archive bigint, offset bigint, length bigint, url string, record string")


def _levels(n_archives: int, archive_bytes: int) -> list[tuple[Column, Column]]:
    """(archive, range) of the parents of each level of nodes, from ranges of RANGE_BYTES up to one root."""
    archive, number, width, step, keys = F.col("archive"), F.col("range"), RANGE_BYTES, 1, []
    while width < archive_bytes:
        width *= FANOUT
        keys.append((archive, F.floor(number / FANOUT)))
    keys.append((archive, F.lit(0).cast("bigint")))
    while step < n_archives:
        step *= FANOUT
        keys.append((F.floor(archive / FANOUT), F.lit(0).cast("bigint")))
    return keys


def range_starts(manifest: DataFrame) -> DataFrame:
    """archive, starts: the first key of each of an archive's ranges, in order; all that a replica needs to know of the manifest."""
    first = manifest.groupBy("archive", F.floor(F.col("offset") / RANGE_BYTES).alias("range")).agg(F.min(F.struct(*KEY)).alias("key"))
    return first.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("range", "key"))).alias("starts"))


def place(own: DataFrame, starts: DataFrame, n_archives: int) -> DataFrame:
    """leaves with the archive and range that their keys fall into."""
    at = own.withColumn("archive", _archive(n_archives)).join(starts, "archive", "left").withColumn("key", F.struct(*KEY))
    before = F.size(F.filter("starts", lambda s: s["key"] <= F.col("key")))
    number = F.when(F.col("starts").isNull(), F.lit(0)).otherwise(F.element_at("starts", F.greatest(before, F.lit(1)))["range"])
    return at.select(*KEY, "length", "hash", "archive", number.cast("bigint").alias("range"))


def tree(placed: DataFrame, levels: list[tuple[Column, Column]]) -> list[DataFrame]:
    """Stored nodes (archive, range, hash) of each level; the last is the root alone.

    A node hashes its children's hashes in order; ranges hold a bounded number of bytes, hence of children.
    """
    hashes = lambda order: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "hash"))), lambda x: x["hash"]), ""), 256)
    nodes = [materialize(placed.groupBy("archive", "range").agg(hashes(KEY).alias("hash")), "tree")]
    for archive, number in levels:
        up = nodes[-1].groupBy(archive.alias("a"), number.alias("r")).agg(hashes(["archive", "range"]).alias("hash"))
        nodes.append(materialize(up.select(F.col("a").alias("archive"), F.col("r").alias("range"), "hash"), "tree"))
    return nodes


def audit(manifest: DataFrame, replica: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """page_id, url, copy, archive, offset, length, kind, expected, found for each record that differs.

    manifest: from layout(); replica: leaves() of the other replica.
    """
    manifest = materialize(manifest, "manifest")
    n_archives = (manifest.agg(F.max("n_archives").alias("n")).first()["n"]) or 1
    levels = _levels(n_archives, archive_bytes)
    own = manifest.select(*KEY, "length", "hash", "archive", F.floor(F.col("offset") / RANGE_BYTES).alias("range"))
    other = materialize(place(replica, range_starts(manifest), n_archives), "replica")
    expected, seen = tree(own, levels), tree(other, levels)
    bad = None  # from the root down: nodes that differ, read among the children of nodes that differ
    for k in range(len(levels), -1, -1):
        ours, theirs = expected[k], seen[k]
        if bad is not None:
            archive, number = levels[k]
            under = lambda nodes, bad=bad, a=archive, r=number: nodes.withColumns({"up_a": a, "up_r": r}).join(bad, ["up_a", "up_r"], "left_semi").select("archive", "range", "hash")
            ours, theirs = under(ours), under(theirs)
        differ = ours.join(theirs.withColumnRenamed("hash", "other"), ["archive", "range"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "range")
        if k and differ.isEmpty():
            return _differing(manifest.limit(0), other.limit(0))
        bad = differ.select(F.col("archive").alias("up_a"), F.col("range").alias("up_r"))
    ranges = materialize(bad.withColumnsRenamed({"up_a": "archive", "up_r": "range"}), "ranges")
    ours = manifest.withColumn("range", F.floor(F.col("offset") / RANGE_BYTES)).join(ranges, ["archive", "range"], "left_semi")
    return _differing(ours, other.join(ranges, ["archive", "range"], "left_semi"))


def _differing(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Records that are lost, altered or extra among those of the ranges that differ."""
    found = theirs.select(*[F.col(c).alias(f"f_{c}") for c in KEY], F.col("hash").alias("found"))
    same_key = F.col("page_id").eqNullSafe(F.col("f_page_id")) & (F.col("url") == F.col("f_url")) & (F.col("copy") == F.col("f_copy"))
    both = ours.select(*KEY, "archive", "offset", "length", F.col("hash").alias("expected")).join(found, same_key, "full_outer").where(~F.col("expected").eqNullSafe(F.col("found")))
    known = F.col("expected").isNotNull()
    kind = F.when(~known, "extra").when(F.col("found").isNull(), "lost").otherwise("altered")
    return both.select(*[F.when(known, F.col(c)).otherwise(F.col(f"f_{c}")).alias(c) for c in KEY], "archive", "offset", "length", kind.alias("kind"), "expected", "found")
