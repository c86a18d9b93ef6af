"""N-gram Jaccard self-join by PartEnum signatures.

Sets of sizes r <= s whose Jaccard similarity is at least 3/4 differ in at most
k = (r + s) / 7 elements.  The join runs in bands of sizes; in a band the feature
domain is cut into a fixed number of partitions, more than k of which hold elements
of a set, and each subset of the set that a partition holds gives one signature.
Two similar sets differ in k partitions at most, so of the first k + 1 signatures
of each, in any one common order, one is shared.  (This is the first level of the
enumeration with one-partition subsets, its second-level size being one; in bands
of small sets each element is a partition.)

The common order is by the number of sets that have a signature, the fewest first,
counted exactly over all sets.  Signatures that one set alone has come first and
bring nothing together, so what many sets share (passages, boilerplate) makes no
candidates unless nearly everything in a set is shared.  Counting sends every
signature once; only those that two sets have go further.  A set with k signatures
or fewer gives all, and single elements besides, of which the usual prefix of a
quarter and one suffices for two such sets.

Equal sets are one class and are joined once.  The classes of a group (those that
share a signature in their prefixes) are compared with its pivot, the class most of
whose signatures are widespread: in a group of near copies that is the text they
were made from.  Links merge components.  Members that the pivot's component did
not take in are then held against the others in blocks; sizes and histograms
(elements in each of CELLS parts of the domain) rule out nearly all of those pairs
inside the block, which is exact, and only the rest become rows and are verified.
Nothing is left out, and members of one component are not compared with each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Scratch, fresh

SHINGLE = 5
TOP = 2.5  # elements a partition at the upper end of a band
SINGLE = 16  # bands below this size have single elements as partitions
CELLS = 256  # parts of the domain in a set's histogram
BUCKET = 2_000_000  # signatures in a bucket, about
FLUSH = 500_000  # signatures a task holds before it sends them
BLOCK = 2048  # members of a unit that are held against as many others at once
ITEMS = 1 << 20  # shingles that either side of a block has, about
SALTS = 64  # tasks that the rows of one main component are dealt to, at most


def shingle_sets(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, sorted distinct shingle hashes of the rows from there, first of each row and the total)."""
    buf, off = W.column(text)
    for at, part, o in W.chunks(buf, off, 1 << 21):
        part = W.LOWER[part]
        s, e, first = W.split(part, o)
        words = W.hashes(part, s, e)
        doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
        whole = W.sequences(words, SHINGLE)
        inside = doc[: len(whole)] == doc[SHINGLE - 1 :] if len(whole) else np.zeros(0, bool)
        key, owner = whole[inside], doc[: len(whole)][inside]
        few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
        if len(few):
            short = np.array([W.sequences(words[first[d] : first[d + 1]], int(first[d + 1] - first[d]))[0] for d in few], np.uint64)
            key, owner = np.concatenate([key, W.mix(short + np.uint64(1))]), np.concatenate([owner, few])
            order = np.argsort(owner, kind="stable")
            key, owner = key[order], owner[order]
        bounds = np.searchsorted(owner, np.arange(len(o)))
        sets = [np.unique(key[bounds[d] : bounds[d + 1]]) for d in range(len(o) - 1)]
        sizes = np.array([0, *map(len, sets)])
        yield at, np.concatenate(sets) if sets else key, np.cumsum(sizes)


def class_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number for each set, the same for equal ones: a polynomial over the sorted elements."""
    size = np.diff(bounds)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size > 0)
    if len(full):
        rank = np.arange(len(values)) - np.repeat(bounds[:-1], size)
        terms = W.mix(values) * W.powers(W.BASE, int(size.max()))[rank]
        out[full] = W.mix(np.add.reduceat(terms, bounds[full]) + size[full].astype(np.uint64))
    return out.view(np.int64)


def histograms(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each set, how many elements fall in each of CELLS parts of the domain, 127 at most; the sum of differences is at most the true difference."""
    n = len(bounds) - 1
    cell = (W.mix(values + np.uint64(0x71D67FFFEDA60000)) >> np.uint64(56)).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    return np.minimum(np.bincount(doc * CELLS + cell, minlength=n * CELLS), 127).astype(np.int8).reshape(n, CELLS)


def signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature, list) of all sets: every list is whole, and its first so many in a common order suffice.

    A list's number holds, from the top, how many signatures it has, how many of them
    suffice (30 bits), and its kind (2 bits): own band or the one above, partitions or
    single elements.  Lists of a set have different numbers.
    """
    size = np.diff(bounds)
    most = 4 * size // 3  # the largest set that can be similar
    own, above = (np.frexp(np.maximum(x, 1))[1].astype(np.int64) - 1 for x in (size, most))
    spread = (W.mix(values + np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.int64)
    inner = W.mix(values)
    owner = np.repeat(np.arange(len(size)), size)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(doc: np.ndarray, sig: np.ndarray, need: np.ndarray, kind: int) -> np.ndarray:
        total = np.bincount(doc, minlength=len(size))
        out.append((doc, sig, ((total << 32) | (need << 2) | kind)[doc]))
        return total

    def singles(chosen: np.ndarray, band: np.ndarray, kind: int) -> None:
        here = chosen[owner]
        doc = owner[here]
        add(doc, W.mix(values[here] ^ (np.uint64(0x5851F42D4C957F2D) + band[doc].astype(np.uint64))), size - (3 * size + 3) // 4 + 1, kind)

    for kind, (band, chosen) in enumerate(((own, size > 0), (above, (size > 0) & (above > own)))):
        small = 1 << band < SINGLE
        singles(chosen & small, band, kind)
        chosen = chosen & ~small
        k = (size + np.minimum(most, (2 << band) - 1)) // 7
        parts = np.where(chosen, np.ceil((2 << band) / TOP).astype(np.int64), 0)
        base = np.cumsum(parts) - parts
        here = chosen[owner]
        doc = owner[here]
        place = base[doc] + (spread[here] * parts[doc] >> 32)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, place, inner[here])
        held = np.flatnonzero(np.bincount(place, minlength=len(sums)))
        doc = np.repeat(np.arange(len(size)), parts)[held]
        sig = W.mix(sums[held] + (held - base[doc]).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + band[doc].astype(np.uint64))
        total = add(doc, sig, k + 1, kind)
        singles(chosen & (total <= k), band, kind + 2)
    return tuple(np.concatenate(x) for x in zip(*out))


def _describe(docs: DataFrame) -> DataFrame:
    """doc_id, n, class, cells for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, values, bounds in shingle_sets(b["text"]):
                n = np.diff(bounds)
                cells = histograms(values, bounds)
                data = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((np.arange(len(n) + 1) * CELLS).astype(np.int32)), pa.py_buffer(cells.tobytes())])
                yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].slice(at, len(n)), "n": pa.array(n), "class": pa.array(class_keys(values, bounds), mask=n == 0), "cells": data})

    return docs.mapInArrow(W.lean(run), "doc_id long, n long, class long, cells binary")


def _blobs(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, sigs (32 bits each), classes, lists, runs: signatures dealt by their top bits; a run of them has one class and list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            sig, cls, code = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = ((sig >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, sig, cls, code = bucket[order], sig[order].astype(np.uint32), cls[order], code[order]
            change = bucket[1:] != bucket[:-1]
            edge = np.flatnonzero(np.r_[True, change])
            begin = np.flatnonzero(np.r_[True, change | (cls[1:] != cls[:-1]) | (code[1:] != code[:-1])])
            reps = np.diff(np.r_[begin, len(sig)]).astype(np.uint32)
            first = np.r_[np.searchsorted(begin, edge), len(begin)]
            edge = np.r_[edge, len(sig)]
            cut = lambda x, at: pa.array([x[a:z].tobytes() for a, z in zip(at[:-1], at[1:])], pa.binary())
            return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[edge[:-1]]), "sigs": cut(sig, edge), "classes": cut(cls[begin], first), "lists": cut(code[begin], first), "runs": cut(reps, first)})

        for b in batches:
            for _, values, bounds in shingle_sets(b["text"]):
                keys = class_keys(values, bounds)
                new = np.zeros(len(keys), bool)
                for d, key in enumerate(keys.tolist()):
                    if bounds[d] < bounds[d + 1] and key not in seen:
                        seen.add(key)
                        new[d] = True
                if not new.any():
                    continue
                doc, sig, code = signatures(values[np.repeat(new, np.diff(bounds))], np.r_[0, np.cumsum(np.diff(bounds)[new])])
                held.append((sig, keys[new][doc], code))
                size += len(sig)
                if size > FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.mapInArrow(W.lean(run), "bucket long, sigs binary, classes binary, lists binary, runs binary")


def _meet(blobs: pa.Table) -> pa.Table:
    """sig, class, list, n: the signatures of one bucket that n classes have, two at least."""
    whole = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for c in blobs[name].chunks for x in c])
    sig, runs = whole("sigs", np.uint32), whole("runs", np.uint32)
    row = np.repeat(np.arange(len(runs), dtype=np.int32), runs)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    same = sig[1:] == sig[:-1]
    keep = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    sig, row = sig[keep].astype(np.int64), row[order[keep]]
    cls, code = whole("classes", np.int64)[row], whole("lists", np.int64)[row]
    order = np.lexsort((cls, sig))
    sig, cls, code = sig[order], cls[order], code[order]
    new = np.ones(len(sig), bool)  # a class that several tasks have seen counts once
    new[1:] = (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])
    sig, cls, code = sig[new], cls[new], code[new]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(sig)])
    n = np.repeat(size, size)
    keep = n > 1
    return pa.table({"sig": pa.array((blobs["bucket"][0].as_py() << 32 | sig)[keep]), "class": pa.array(cls[keep]), "list": pa.array(code[keep]), "n": pa.array(n[keep])})


def _prefixes(shared: DataFrame) -> DataFrame:
    """sig, class, score: of each list the first signatures, by how many classes have them; those of one class alone come before all that are here.

    score: how widespread a class's signatures are on the whole.
    """
    own = Window.partitionBy("class", "list")
    total, need = F.shiftright("list", 32), F.shiftright("list", 2).bitwiseAND(F.lit((1 << 30) - 1))
    ranked = shared.withColumn("_rank", F.row_number().over(own.orderBy("n", "sig"))).withColumn("_here", F.count("*").over(own)).withColumn("score", F.sum(F.log2("n")).over(own) / total)
    return ranked.where(F.col("_rank") <= F.col("_here") - (total - need)).select("sig", "class", "score")


def _groups(prefixes: DataFrame) -> DataFrame:
    """group, class, pivot: classes that share a signature of their prefixes; of equal groups one stays."""
    top = F.max(F.struct("score", "class"))["class"].alias("pivot")
    made = prefixes.groupBy("sig").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("class")).alias("_x"), F.bit_xor(F.xxhash64("class", F.lit(1))).alias("_y"), top).where("_n > 1")
    once = made.groupBy("_n", "_x", "_y").agg(F.min(F.struct("sig", "pivot")).alias("_g")).select("_g.sig", "_g.pivot")
    return prefixes.join(once, "sig").select(F.col("sig").alias("group"), "class", "pivot")


def _apart(n: np.ndarray, cells: np.ndarray, m: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Whether sizes n and m, or their histograms, rule similarity out."""
    return (100 * np.minimum(n, m) < 75 * np.maximum(n, m)) | (7 * np.abs(cells.astype(np.int16) - others).sum(-1) > n + m)


def _cells(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, CELLS)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, na, nb: the pairs that sizes and histograms leave possible; similar sets differ in (na + nb) / 7 elements at most."""
    of = lambda x: classes.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b["na"].to_numpy(), b["nb"].to_numpy()
            keep = pa.array(~_apart(na, _cells(b["ca"]), nb, _cells(b["cb"])))
            yield b.select(["a", "b", "na", "nb"]).filter(keep)

    return pairs.distinct().join(of("a"), "a").join(of("b"), "b").select("a", "b", "na", "nb", "ca", "cb").mapInArrow(W.lean(run), "a long, b long, na long, nb long")


def _units(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """main, group, class, root: members of groups that lie in several components.

    A group's main component is the one with most of its members.  Groups of one main
    component, which mostly have the same members, are one unit (group 0), so that a
    class is in it once and a pair is looked at once; they stay apart where that gives
    fewer pairs.
    """
    placed = groups.where("class <> pivot").select("group", "class").join(roots, F.col("class") == F.col("node"), "left").select("group", "class", F.coalesce("root", "class").alias("root"))
    mixed = placed.groupBy("group", "root").agg(F.count("*").alias("_n")).groupBy("group").agg(F.max(F.struct("_n", "root")).alias("_m"), F.sum("_n").alias("_all")).where("_all > _m._n")
    mixed = mixed.select("group", F.col("_m.root").alias("main"), (F.col("_all") * (F.col("_all") - F.col("_m._n"))).alias("_pairs"))
    rows = placed.join(mixed, "group").select("main", "group", "class", "root")
    together = rows.select("main", "class", "root").distinct().groupBy("main").agg((F.count("*") * F.count_if(F.col("root") != F.col("main"))).alias("_together"))
    apart = mixed.groupBy("main").agg(F.sum("_pairs").alias("_apart"))
    # A main component may have very many rows, so these are spread by a second key.
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    split = together.join(apart, "main").where(F.col("_together") > F.greatest("_apart", F.lit(BLOCK))).select("main", F.lit(True).alias("_split"), salt)
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("group", "class"), F.lit(SALTS)).cast("int"))
    return rows.join(split, ["main", "_salt"], "left").select("main", F.when(F.col("_split"), F.col("group")).otherwise(0).alias("group"), "class", "root").distinct()


def _strays(units: DataFrame, known: DataFrame) -> DataFrame:
    """a, b: links between components, as many as join all those that the links inside the units join; known: class, n, cells, items.

    The members of a unit outside its main component are its strays.  They are held
    against all members, in blocks of both.  What sizes and histograms leave possible
    is verified inside the block.  A link that joins what the block's links have joined
    already is not returned, so a block makes fewer rows than it reads.
    """
    rows = units.withColumn("stray", F.col("root") != F.col("main")).join(known, "class")
    blocks = lambda rows, items: F.greatest(F.ceil(rows / BLOCK), F.ceil(items / ITEMS), F.lit(1)).cast("int")
    strayed = F.when(F.col("stray"), F.col("n"))
    sizes = rows.groupBy("main", "group").agg(blocks(F.count("*"), F.sum("n")).alias("_mb"), blocks(F.count(strayed), F.coalesce(F.sum(strayed), F.lit(0))).alias("_sb"))
    rows = rows.join(sizes, ["main", "group"])
    place = lambda n: F.pmod(F.xxhash64("class", F.lit(3)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    key, columns = ("main", "group", "i", "j"), ("main", "group", "class", "root", "n", "cells", "items", "stray")
    members = rows.select(*columns, F.lit(False).alias("held"), place(F.col("_mb")).alias("i"), each(F.col("_sb")).alias("j"))
    strays = rows.where("stray").select(*columns, F.lit(True).alias("held"), each(F.col("_mb")).alias("i"), place(F.col("_sb")).alias("j"))
    dealt = members.unionByName(strays).repartition(*key).sortWithinPartitions(*key)

    def block(t: pa.RecordBatch) -> tuple[list[int], list[int]]:
        held = t["held"].to_numpy(zero_copy_only=False)
        cls, n, stray, cells = t["class"].to_numpy(), t["n"].to_numpy(), t["stray"].to_numpy(zero_copy_only=False), _cells(t["cells"])
        part = np.unique(t["root"].to_numpy(), return_inverse=True)[1]
        items, bounds = t["items"].flatten().to_numpy().view(np.uint64), np.r_[0, np.cumsum(n)]
        member, a, b = np.flatnonzero(~held), [], []
        for k in np.flatnonzero(held).tolist():
            other = member[(part[member] != part[k]) & (~stray[member] | (cls[member] > cls[k]))]
            other = other[~_apart(n[k], cells[k], n[other], cells[other])] if len(other) else other
            if not len(other):
                continue
            own = items[bounds[k] : bounds[k + 1]]
            theirs = np.concatenate([items[bounds[o] : bounds[o + 1]] for o in other.tolist()])
            same = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            both = np.add.reduceat(same, np.r_[0, np.cumsum(n[other])[:-1]], dtype=np.int64)
            for o in other[100 * both >= 75 * (n[k] + n[other] - both)].tolist():
                if part[o] != part[k]:
                    part[part == part[o]] = part[k]
                    a.append(min(int(cls[k]), int(cls[o])))
                    b.append(max(int(cls[k]), int(cls[o])))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        last = None
        for t in batches:
            if not t.num_rows:
                continue
            at = np.stack([t[c].to_numpy() for c in key])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
            a, b = [], []
            for x, z in zip(edges[:-1], edges[1:]):
                if rest and tuple(at[:, x]) != last:
                    found = block(pa.concat_batches(rest))
                    a, b, rest = a + found[0], b + found[1], []
                rest.append(t.slice(x, z - x))
                last = tuple(at[:, x])
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        if rest:
            a, b = block(pa.concat_batches(rest))
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.mapInArrow(W.lean(run), "a long, b long")


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, values, bounds in shingle_sets(b["text"]):
                full = np.flatnonzero(np.diff(bounds) > 0)
                ends = np.r_[bounds[full], len(values)] if len(full) else np.zeros(1, np.int64)
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"class": pa.array(class_keys(values, bounds)[full]), "items": items})

    return docs.mapInArrow(W.lean(run), "class long, items array<bigint>")


def components(edges: DataFrame, scratch: Scratch, name: str, most: int = 60) -> DataFrame:
    """node, root: the least node that each node of edges (a, b) reaches, by alternating large and small stars.

    Minima are aggregated before the shuffle, and hubs are split by the skew join.
    """
    now = scratch.write(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-0")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    for turn in range(1, most + 1):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = scratch.write(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{turn}")
        then, state = state, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}-{turn - 1}")
        if then == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def links_between(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) of classes whose sets are similar, by exact intersection."""
    left, right = sets.select(F.col("class").alias("a"), F.col("items").alias("_x")), sets.select(F.col("class").alias("b"), F.col("items").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= 75 * (F.col("na") + F.col("nb") - both)).select("a", "b")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs.

    Null and empty texts and texts without words have no shingles and are linked
    with nothing.  Fewer than five words are one shingle.  Rows without doc_id are
    linked with nothing and have no component.  Repeated rows each give a row; rows
    that share a doc_id but not a text are compared each by its own text.  An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    members = scratch.write(_describe(docs), "described").withColumn("class", F.when(F.col("doc_id").isNotNull(), F.col("class")))
    shingles = members.agg(F.sum("n")).first()[0] or 0
    classes = scratch.write(members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.first("cells").alias("cells")), "classes")
    # A shingle gives about three quarters of a signature.
    blobs = _blobs(docs.where("doc_id is not null"), max(32, int(0.75 * shingles // BUCKET)))
    shared = blobs.groupBy("bucket").applyInArrow(_meet, "sig long, class long, list long, n long")
    prefixes = scratch.write(_prefixes(shared), "prefixes")
    scratch.release()
    groups = scratch.write(_groups(prefixes), "groups")
    scratch.drop("prefixes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = wanted.select("class").distinct().join(classes, "class").select(F.col("first").alias("doc_id"))
        # A repeated row gives its set twice and a link twice; links are made distinct later.
        return _sets(docs.join(wanted, "doc_id", "left_semi"))

    stars = groups.where("class <> pivot").select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b"))
    stars = scratch.write(_possible(stars, classes), "stars")
    sets = scratch.write(sets_of(stars.select(F.explode(F.array("a", "b")).alias("class"))), "sets")
    links = scratch.write(links_between(stars, sets), "links")
    scratch.drop("sets")
    scratch.release()
    roots = components(links, scratch, "first")

    units = scratch.write(_units(groups, roots), "units")
    scratch.drop("groups")
    if units.take(1):
        more = scratch.write(sets_of(units), "more")
        known = classes.select("class", "n", "cells").join(more.groupBy("class").agg(F.first("items").alias("items")), "class")
        found = scratch.write(_strays(units, known), "found")
        scratch.drop("more")
        if found.take(1):
            links = scratch.write(links.unionByName(found), "all")
            roots = components(links, scratch, "second")
    named = roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
    scratch.release()
    named = classes.join(named, classes["class"] == named["node"], "left").select("class", "first", F.coalesce("root", "class").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = scratch.write(named.join(least, "root").select("class", "component_id"), "components")
    out = members.drop("cells").join(of, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def report(docs: DataFrame) -> DataFrame:
    return join(docs)


def clean(docs: DataFrame) -> DataFrame:
    """The document of least id of each group; documents without words or without an id all stay."""
    name = fresh(docs, "_kept")
    kept = join(docs).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    alone = docs.where("doc_id is null")
    return docs.join(kept, F.col("doc_id").cast("bigint") == F.col(name), "left_semi").select(*docs.columns).unionByName(alone)
