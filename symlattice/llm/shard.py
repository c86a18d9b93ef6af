"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters whole records into buckets by a seeded hash of the record; there
are enough buckets that one holds about `bucket_rows` records and about
`bucket_bytes` bytes at most, so it fits in memory at any table size, and copies of
a text spread since their ids differ.  A partition takes a run of neighbouring
buckets.  Pass two applies Fisher-Yates to each bucket (Spark's `shuffle` of an
array, seeded).  A prefix sum over the bucket counts turns places in buckets into
places in the whole order, which is cut into shards whose counts differ by one at
most; since partitions follow that order, shards are written without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import Scratch

SEED = 20240611
BUCKET_ROWS = 4_096
BUCKET_BYTES = 4 << 20
PARTITION_BYTES = 32 << 20
SHARDS = 40


def record_size(text: Column) -> Column:
    """UTF-8 bytes plus 16; null counts none."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("bigint")


def assign(records: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """records with shard int and slot long, gapless from 0 in each shard; counts of shards differ by one at most.

    Columns of records may hold nulls and need an order.  Repeated rows are kept
    and numbered each.  Fewer rows than shards leave the last ones of some shards
    empty; an empty table gives no rows.  Buckets are put in order before they are
    shuffled, so a task that runs again after a lost executor gives the same rows.
    """
    names = records.columns
    bulk = sum((record_size(F.col(f"`{c}`").cast("string")) for c in names), F.lit(0))
    total, size = records.agg(F.count("*"), F.coalesce(F.sum(bulk), F.lit(0))).first()
    buckets = max(1, -(-total // bucket_rows), -(-size // bucket_bytes))
    parts = min(buckets, max(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES)))
    bucket = F.pmod(F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in names]), F.lit(buckets))
    # One row for each bucket, 16 bytes each.
    counts = records.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    bases = F.broadcast(counts.select("_bucket", F.coalesce(before, F.lit(0)).alias("_base")))
    scattered = records.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_record"), bucket.alias("_bucket"))
    dealt = scattered.withColumn("_part", F.expr(f"cast(_bucket * {parts} div {buckets} as int)")).repartitionById(parts, "_part")
    # Both keys: a bucket lies in one partition, so the rows are not exchanged again.
    shuffled = dealt.groupBy("_part", "_bucket").agg(F.array_sort(F.collect_list("_record")).alias("_rows")).sortWithinPartitions("_bucket")
    shuffled = shuffled.select("_bucket", F.shuffle("_rows", F.lit(seed)).alias("_rows"))
    placed = shuffled.join(bases, "_bucket").select("_base", F.posexplode("_rows").alias("_at", "_record"))
    place, n = F.col("_base") + F.col("_at"), F.lit(max(1, total))
    shard = F.floor(place * n_shards / n) if total * n_shards < 1 << 52 else F.expr(f"cast(cast(_base + _at as decimal(38,0)) * {n_shards} div {total} as bigint)")
    first = lambda s: F.expr(f"({s} * {total} + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("_shard", shard.cast("bigint")).withColumn("_slot", place - first("_shard")).select(*[F.col(f"_record.`{c}`").alias(c) for c in names], F.col("_shard").cast("int").alias("shard"), F.col("_slot").cast("bigint").alias("slot"))


def write(docs: DataFrame, path: str, n_shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Writes whole records, each shard in a folder of its own, in the order of slots over its files by name."""
    out = assign(docs, n_shards, seed, bucket_rows, bucket_bytes)
    out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)


def _apart(docs: DataFrame) -> DataFrame:
    """docs with other names for columns that clash with the stored shard and slot."""
    taken = {c.lower() for c in docs.columns} | {"shard", "slot"}
    for c in docs.columns:
        if c.lower() in ("shard", "slot"):
            new = f"_{c}"
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
            docs = docs.withColumnRenamed(c, new)
    return docs


def report(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the written shards of whole records.

    Null text has no bytes: size 16, checksum 0.
    """
    records, scratch = _apart(docs), Scratch(docs.sparkSession, "shards")
    with scratch.tidy():
        write(records, scratch.path("shards"), n_shards)
    stored = docs.sparkSession.read.schema(T.StructType([*records.schema, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(scratch.path("shards"))
    checksum = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return stored.select("doc_id", record_size(F.col("text")).alias("size"), checksum.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
