"""Benchmark decontamination with DataFrame functions only.

Every window of eight consecutive benchmark words is hashed; the set of hashes is
broadcast and each document's windows are probed in the scan.  Hits are verified
word by word.  Each document also sends one marker row, so that one scan and one
aggregation by document return all documents, hit or not.

Broadcast bound: at most `block` windows are sent at once.  A larger benchmark is
probed in several blocks, each with its own bounded broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
BLOCK = 400_000  # windows in one broadcast; about 300 bytes each
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of lower-cased texts
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # in texts as they are, with their capitals
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z alone; pure ASCII takes the quicker built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lower_ascii(text), F.lit("")), SEPARATORS), "")


def windows_at(words: Column, n: Column, size: int) -> Column:
    """Hashes of all windows of size words."""
    many = F.transform(F.sequence(F.lit(1), n - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, F.lit(size))))
    return F.when(n >= size, many).otherwise(F.array().cast("array<bigint>"))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """key long, size int, window array<string>, items array<string>: one row for each distinct window."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    items = items.select("item", "w", F.size("w").alias("n")).where("n > 0 and item is not null")
    size = F.least(F.col("n"), F.lit(window))
    each = items.select("item", "w", size.alias("size"), F.explode(F.sequence(F.lit(1), F.col("n") - size + 1)).alias("i"))
    each = each.select("item", "size", F.slice("w", F.col("i"), F.col("size")).alias("window"))
    return each.groupBy("window", "size").agg(F.collect_set("item").alias("items")).withColumn("key", F.xxhash64("window"))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, hits array<struct<at,size>>, items array<string>, kept struct of the columns in keep, for every row of docs.

    Null text has no words.  Repeated rows each give a row.  An item without words
    is not looked for; equal items are looked for once each.  Empty tables give
    no rows, or rows without hits.
    """
    known = benchmark_windows(benchmark, window).withColumn("block", F.pmod(F.xxhash64("window", F.lit(1)), F.lit(1 << 30)))
    about = known.groupBy("size").count().collect()  # one row for each window size, eight at most
    sizes, total = sorted(r["size"] for r in about), sum(r["count"] for r in about)
    blocks = max(1, -(-total // block))

    # A row is known by its id and two hashes of its text, which are the same in every scan of the table.
    row = F.struct(F.xxhash64("text"), F.xxhash64("text", F.lit(1)), F.col("text").isNull())
    base = docs.select("doc_id", F.struct(F.lit(0).alias("_"), *[F.col(c) for c in keep]).alias("_kept"), row.alias("_row"), words_of(F.col("text")).alias("_w"))
    base = base.withColumn("_n", F.size("_w"))
    found = None
    for size in sizes or [window]:
        for b in range(blocks):
            marker = found is None
            hashes = windows_at(F.col("_w"), F.col("_n"), size)
            each = base.select(
                "doc_id", "_row", "_n", "_w", (F.col("_kept") if marker else F.lit(None).cast(base.schema["_kept"].dataType)).alias("_kept"),
                (F.concat(F.array(F.lit(0).cast("bigint")), hashes) if marker else hashes).alias("_h"),
            )
            # The outer form keeps the optimizer from testing the array's size in the scan, where it would make the words anew for each window.
            each = each.select("doc_id", "_row", "_n", "_w", "_kept", F.posexplode_outer("_h").alias("_at", "_key"))
            if not marker:
                each = each.withColumn("_at", F.col("_at") + 1)
            part = known.where((F.col("size") == size) & (F.pmod(F.col("block"), F.lit(blocks)) == b)).select("key", "window", "items")
            same = F.slice(F.col("_w"), F.greatest(F.col("_at"), F.lit(1)), F.lit(size)) == F.col("window")
            probed = each.join(F.broadcast(part), (F.col("_key") == F.col("key")) & (F.col("_at") > 0), "left" if marker else "inner")
            hit = F.col("window").isNotNull() & same
            mark = F.col("_at") == 0
            probed = probed.where(mark | hit).select(
                "doc_id", "_row", "_n", F.when(mark, F.col("_kept")).alias("_kept"),
                F.when(hit, F.struct(F.col("_at").alias("at"), F.lit(size).alias("size"))).alias("_hit"), F.when(hit, F.col("items")).alias("items"),
            )
            found = probed if found is None else found.unionByName(probed)
    by_row = found.groupBy("_row", "doc_id").agg(
        F.max("_n").cast("bigint").alias("n_words"), F.array_distinct(F.collect_list("_hit")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.collect_list("_kept").alias("_all"),
    )
    return by_row.select("doc_id", "n_words", "hits", "items", F.explode("_all").alias("kept"))


def covered(hits: Column) -> Column:
    """Positions, from 1, of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


def report(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; see scan() for the special cases."""
    return scan(docs, benchmark).select(
        "doc_id", "n_words", F.size(covered(F.col("hits"))).cast("bigint").alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("items") >= min_items).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, min_items: int = 2) -> DataFrame:
    """docs without contaminated documents; in the others the words of any hit are cut from the text.

    Columns are those of docs; n_chars, where there is one, follows the text.
    """
    keep = tuple(c for c in docs.columns if c != "doc_id")
    rows = scan(docs, benchmark, keep=keep).where(F.size("items") < min_items)
    old, hit = F.col("kept.text"), F.size("hits") > 0
    said = F.regexp_extract_all(old, F.lit(f"({WORD})"), F.lit(1))
    left = F.array_except(F.sequence(F.lit(1), F.size(said)), covered(F.col("hits")))
    # Exploded, so that the parts are made once for a row and not again for each word; the work follows the length of the text.
    parts = F.explode(F.array(F.when(hit, F.struct(F.split(old, WORD, -1).alias("gaps"), said.alias("said"), left.alias("left")))))
    rows = rows.select("doc_id", "kept", hit.alias("hit"), parts.alias("x"))
    gaps = lambda at, n: F.array_join(F.slice("x.gaps", at, n), "")
    before = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("x.left", k - 1))
    words = F.transform("x.left", lambda p, k: F.concat(gaps(before(k) + 1, p - before(k)), F.get("x.said", p - 1)))
    last = before(F.size("x.left"))
    cut, old, hit = F.concat(F.array_join(words, ""), gaps(last + 1, F.size("x.gaps") - last)), F.col("kept.text"), F.col("hit")
    new = {"doc_id": F.col("doc_id"), "text": F.when(hit, cut).otherwise(old)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(hit, F.length(cut)).otherwise(F.col("kept.n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new.get(c, F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
