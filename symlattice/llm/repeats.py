"""Substring dedup by a log-structured fingerprint index.

The index is a list of sorted immutable runs.  A run holds window hashes of past
batches, bucketed and sorted by hash, with a second hash to verify by and the
first document of each window; the two come from word hashes of different seeds,
so nothing that deceives the one deceives the other.  A new batch's windows are merge-joined with every
run, verified, and what is new becomes a run of its own; runs are compacted into
one when there are too many.  Batches are ranges of rising doc_id, so whatever the
history holds comes from a smaller doc_id.  An index can be saved, and opened again
to take in batches that nobody knew of when it was made (`take`).

Where the whole corpus is known beforehand, a filter keeps windows out of the index
that cannot repeat: each window of 13 words has an anchor, the five words of least
hash in it, and equal windows have equal anchors.  Only windows whose anchor occurs
in two documents are indexed.  Anchors change every few words, so the filter moves
about a fifth of what the windows would.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .store import Scratch

WINDOW = 13
ANCHOR = 5
BATCHES = 4
MOST_RUNS = 2
BUCKET = 2_000_000  # windows in a bucket of a run, about
CHECK = 0xA24BAED4963EE407  # base of the verifying hash
SEED = 1  # of its word hashes


def _windows(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the windows that lie in one document, the document of each)."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(max(0, len(words) - window + 1))
    inside = doc[at] == doc[at + window - 1] if len(at) else np.zeros(0, bool)
    return at[inside], doc[at[inside]]


def anchors_at(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The least anchor hash in the window that starts at each word."""
    grams = W.sequences(words, anchor)
    span = window - anchor + 1
    if len(grams) < span:
        return np.zeros(0, np.uint64)
    least, have = grams, 1
    while have < span:
        step = min(have, span - have)
        least, have = np.minimum(least[: len(least) - step], least[step:]), have + step
    return least


def _parts(b: pa.RecordBatch, proof: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """(first row, word hashes, first word of each row, the verifying word hashes) of a batch's texts."""
    for at, buf, off in W.chunks(*W.column(b["text"])):
        s, e, first = W.split(buf, off)
        yield at, W.hashes(buf, s, e), first, W.hashes(buf, s, e, SEED) if proof else None


def _anchors(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            for at, words, first, _ in _parts(b):
                place, doc = _windows(words, first, window)
                key = anchors_at(words, window, anchor)[place]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(key[new].view(np.int64)), "doc_id": pa.array(ids[at + doc[new]])})

    return docs.mapInArrow(W.lean(run), "anchor long, doc_id long")


def _fingerprints(docs: DataFrame, window: int, anchor: int | None) -> DataFrame:
    """hash, proof, doc_id of the windows; with `_anchors` in docs, of those with a listed anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b["doc_id"].to_numpy(zero_copy_only=False)
            lists = b["_anchors"] if anchor else None
            for at, words, first, proof in _parts(b, proof=True):
                place, doc = _windows(words, first, window)
                if anchor:
                    part = lists.slice(at, len(first) - 1)
                    wanted, owner = part.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(part)), part.value_lengths().fill_null(0).to_numpy())
                    key = anchors_at(words, window, anchor)[place]
                    # One sorted set for the chunk: a document's anchor is told apart by mixing in its number.
                    keep = np.isin(W.mix(key ^ W.mix(doc.astype(np.uint64))), W.mix(wanted ^ W.mix(owner.astype(np.uint64))))
                    place, doc = place[keep], doc[keep]
                yield pa.RecordBatch.from_pydict({"hash": pa.array(W.sequences(words, window)[place].view(np.int64)), "proof": pa.array(W.sequences(proof, window, CHECK)[place].view(np.int64)), "doc_id": pa.array(ids[at + doc])})

    return docs.select("doc_id", "text", *(["_anchors"] if anchor else [])).mapInArrow(W.lean(run), "hash long, proof long, doc_id long")


class FingerprintIndex:
    """The runs, as bucketed tables in a folder that all machines share; drop() removes them, save() and open() keep them."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, most_runs: int = MOST_RUNS):
        self.spark, self.scratch, self.buckets, self.most_runs = spark, scratch, buckets, most_runs
        self.runs: list[str] = []

    def save(self) -> str:
        """Writes the list of runs; returns the folder to open the index from, in this session or another."""
        about = self.spark.createDataFrame([(name, self.buckets, self.most_runs, k) for k, name in enumerate(self.runs)], "name string, buckets int, most_runs int, place int")
        about.coalesce(1).write.mode("overwrite").json(self.scratch.path("index"))
        return self.scratch.root

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        """The index saved in a folder.  Runs that this session's catalog does not have are registered from their files."""
        scratch = Scratch(spark, "repeats")
        scratch.root = root
        about = spark.read.schema("name string, buckets int, most_runs int, place int").json(scratch.path("index")).orderBy("place").collect()  # a row for each run
        index = cls(spark, scratch, about[0]["buckets"] if about else 8, about[0]["most_runs"] if about else MOST_RUNS)
        for r in about:
            if not spark.catalog.tableExists(r["name"]):
                spark.sql(f"CREATE TABLE {r['name']} (hash BIGINT, proof BIGINT, first BIGINT) USING parquet CLUSTERED BY (hash, proof) SORTED BY (hash, proof) INTO {r['buckets']} BUCKETS LOCATION '{scratch.path(r['name'])}'")
            index.runs.append(r["name"])
        return index

    def _write(self, rows: DataFrame) -> None:
        name = f"fingerprint_run_{uuid.uuid4().hex}"
        rows = rows.select("hash", "proof", "first").repartition(self.buckets, "hash", "proof")
        with self.scratch.tidy():
            rows.write.bucketBy(self.buckets, "hash", "proof").sortBy("hash", "proof").option("path", self.scratch.path(name)).option("compression", "zstd").saveAsTable(name)
        self.runs.append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)

    def drop(self) -> None:
        for name in self.runs:
            self._drop(name)
        self.runs = []

    def compact(self) -> None:
        """All runs become one; their hashes differ from each other, so they are only merged."""
        old, self.runs = self.runs, []
        rows = self.spark.table(old[0])
        for name in old[1:]:
            rows = rows.unionByName(self.spark.table(name))
        self._write(rows)
        for name in old:
            self._drop(name)

    def probe(self, prints: DataFrame) -> DataFrame:
        """hash, proof, first, last, known: the batch's distinct windows, known where a run has them."""
        found = prints.groupBy("hash", "proof").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        found = found.withColumn("known", F.lit(False))
        for name in self.runs:
            run = self.spark.table(name).select("hash", "proof", F.lit(True).alias("_in"))
            found = found.join(run.hint("merge"), ["hash", "proof"], "left").withColumn("known", F.col("known") | F.coalesce(F.col("_in"), F.lit(False))).drop("_in")
        return found

    def add(self, prints: DataFrame, name: str, last: bool = False) -> DataFrame:
        """Takes in a batch; returns doc_id, hash of the windows that a smaller doc_id has too.

        doc_ids of a batch must be larger than those of all batches before it.  With
        last, no batch follows and no run is written.
        """
        found = self.scratch.write(self.probe(prints), f"{name}-found")
        again = found.where("known or first < last").select("hash", "proof", "first", "known")
        hits = prints.join(again, ["hash", "proof"]).where("known or doc_id > first").select("doc_id", "hash")
        hits = self.scratch.write(hits, f"{name}-hits")
        if not last:
            if len(self.runs) >= self.most_runs:
                self.compact()
            self._write(found.where("not known"))
        self.scratch.drop(f"{name}-found")
        return hits


def _usable(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")


def take(docs: DataFrame, index: FingerprintIndex, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<bigint>: windows of each document of a new batch that the index, or a smaller doc_id of the batch, has too.

    The index then holds all windows of the batch.  doc_ids must be larger than those
    it has seen.  Nothing is known of later batches, so no window is left out.
    """
    name = f"batch-{uuid.uuid4().hex}"
    prints = index.scratch.write(_fingerprints(_usable(docs), window, None), f"{name}-prints")
    hits = index.add(prints, name)
    index.scratch.drop(f"{name}-prints")
    return hits.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))


def repeated(docs: DataFrame, scratch: Scratch, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """doc_id, hashes array<bigint>: windows of each document that a smaller doc_id has too."""
    spark = docs.sparkSession
    docs = _usable(docs)
    anchors = scratch.write(_anchors(docs, window, anchor), "anchors")
    spread = anchors.groupBy("anchor").agg(F.min("doc_id").alias("_a"), F.max("doc_id").alias("_b")).where("_a < _b").select("anchor")
    lists = scratch.write(anchors.join(spread, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("_anchors")), "lists")
    scratch.drop("anchors")
    scratch.release()
    share = [k / batches for k in range(1, batches)] or [0.5]
    bounds, listed = lists.agg(F.percentile_approx("doc_id", share, 10_000), F.sum(F.size("_anchors"))).first()
    batch = sum((F.when(F.col("doc_id") > b, 1).otherwise(0) for b in (bounds or [])[: batches - 1]), F.lit(0))
    prints = _fingerprints(docs.join(lists.hint("merge"), "doc_id"), window, anchor).withColumn("batch", batch)
    prints = scratch.write(prints, "prints", ("batch",))
    scratch.drop("lists")
    scratch.release()
    # An anchor stands for about five windows.
    index, hits = FingerprintIndex(spark, scratch, max(8, 5 * (listed or 0) // (batches * BUCKET))), None
    try:
        for k in range(batches):
            part = index.add(prints.where(F.col("batch") == k).drop("batch"), f"batch{k}", last=k == batches - 1)
            hits = part if hits is None else hits.unionByName(part)
        out = scratch.write(hits.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes")), "hits")
    finally:
        index.drop()
    scratch.drop("prints")
    for k in range(batches):
        scratch.drop(f"batch{k}-hits")
    scratch.release()
    return out


def remove(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_words, n_removed, kept string: the words left, joined by one space, for each row of docs.

    Null text has no words.  A row without doc_id keeps its words and takes none from
    others.  Rows that share a doc_id are judged each by itself, against smaller ids.
    An empty table gives no rows.
    """
    return apply(docs, repeated(docs, Scratch(docs.sparkSession, "repeats"), window, anchor, batches), window)


def apply(docs: DataFrame, hits: DataFrame, window: int = WINDOW) -> DataFrame:
    """What remove() returns, for windows that repeated() or take() found."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in rows:
            for i in range(0, whole.num_rows, 500):
                b = whole.slice(i, 500)
                n, gone, kept = [], [], []
                for text, seen in zip(b["text"].to_pylist(), b["hashes"]):
                    data = (text or "").encode().split()
                    n.append(len(data))
                    if seen.is_valid and len(data) >= window:
                        raw = np.frombuffer(text.encode(), np.uint8)
                        s, e, _ = W.split(raw, np.array([0, len(raw)]))
                        hit = np.isin(W.sequences(W.hashes(raw, s, e), window), seen.values.to_numpy().view(np.uint64))
                        edge = np.zeros(len(data) + 1, np.int64)
                        edge[: len(hit)] += hit
                        edge[window : window + len(hit)] -= hit
                        left = np.cumsum(edge[:-1]) == 0
                        data = [w for w, k in zip(data, left.tolist()) if k]
                    gone.append(n[-1] - len(data))
                    kept.append(b" ".join(data))
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    base = docs.select("doc_id", "text")
    joined = base.join(hits.withColumnRenamed("doc_id", "_id"), F.col("doc_id").cast("bigint") == F.col("_id"), "left").drop("_id")
    return joined.select("doc_id", "text", "hashes").mapInArrow(W.lean(run), f"doc_id {kind}, n_words long, n_removed long, kept string")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
