"""Address to source file: an interval lookup by buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 1024  # addresses in a bucket
LONG = 64  # ranges over more buckets than this are cut into wider ones


def first_line(symbols: DataFrame, lines: DataFrame, width: int = WIDTH) -> DataFrame:
    """sym_id, file_id, line: for each symbol with an address, the first line record whose range holds it.

    Section and bucket are equi keys.  A range lies in as many buckets as it covers;
    long ranges go into buckets of their own, wider level (widths grow by LONG), so a
    range never gives more than LONG + 1 rows.
    """
    at = symbols.where("addr_section is not null and addr_offset is not null").select("sym_id", F.col("addr_section").alias("section"), F.col("addr_offset").alias("at"))
    ranges = lines.where("length > 0").select("section", F.col("offset").alias("low"), (F.col("offset") + F.col("length")).alias("high"), "file_id", "line", "ordinal")
    levels = 4
    size = lambda k: width * LONG**k
    level = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        level = F.when(F.col("high") - F.col("low") <= size(k) * LONG, k).otherwise(level)
    ranges = ranges.withColumn("level", level)
    wide = F.element_at(F.array(*[F.lit(size(k)).cast("bigint") for k in range(levels)]), F.col("level") + 1)
    ranges = ranges.withColumn("_w", wide).withColumn("bucket", F.explode(F.sequence(F.expr("low div _w"), F.expr("(high - 1) div _w")))).drop("_w")
    probes = at.select("sym_id", "section", "at", F.posexplode(F.array(*[F.expr(f"at div {size(k)}") for k in range(levels)])).alias("level", "bucket"))
    hit = probes.join(ranges, ["section", "level", "bucket"]).where("low <= at and at < high")
    return hit.groupBy("sym_id").agg(F.min_by(F.struct("file_id", "line"), F.struct("ordinal", "low")).alias("r")).select("sym_id", "r.file_id", "r.line")


def sources_of(functions: DataFrame, lines: DataFrame, source_files: DataFrame) -> DataFrame:
    """sym_id, file_name of the functions that have a line record with a file."""
    names = source_files.where("file_name is not null").select("file_id", "file_name")
    return first_line(functions, lines).join(names, "file_id").select("sym_id", "file_name")
