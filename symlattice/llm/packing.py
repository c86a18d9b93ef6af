"""Packing by concatenate-and-cut with two-pass prefix sums.

Pass one tokenises each document where it is read and stores its ids with the
task's number and the tokens that come before it in that task.  The totals of the
tasks (one row each) get a prefix sum, which makes every document's place in the
one long concatenation known.  Pass two cuts each document at multiples of the
window; it needs no shuffle of tokens.  A sequence may begin and end inside
documents, and the boundary records (start and length of each piece) say where.
Only the last sequence can be padded.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from .store import Scratch

WINDOW = 2048
END = 1  # id after each document
CACHE = 64 << 20  # bytes of words and ids that a worker keeps
WORDS = 400_000  # words that are looked up at once
TASKS = 1_000_000  # totals of more tasks than these (16 bytes each) are not broadcast
PIECES = 50_000  # pieces of words whose ids a worker keeps


def _bytes() -> list[str]:
    """The byte-level alphabet: visible Latin-1 characters stand for themselves, other bytes for those from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


BYTES = _bytes()


class Store:
    """Distinct words and their ids, by 64-bit keys; it forgets all when they take more than CACHE bytes."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.int32)
        self.keys, self.rows = np.zeros(0, np.uint64), none  # sorted by key
        self.words, self.at, self.size = np.zeros(8, np.uint8), none, none
        self.ids, self.first, self.n = np.zeros(0, np.uint32), none, none

    def full(self) -> bool:
        return self.words.nbytes + self.ids.nbytes + 28 * len(self.keys) > CACHE

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def add(self, keys: np.ndarray, words: list[bytes], ids: list[list[int]]) -> None:
        after = lambda sizes, begin: (begin + np.cumsum(sizes) - sizes).astype(np.int32)
        size, n = (np.fromiter(map(len, x), np.int32, len(x)) for x in (words, ids))
        self.at, self.first = np.r_[self.at, after(size, len(self.words) - 8)], np.r_[self.first, after(n, len(self.ids))]
        rows = len(self.size) + np.arange(len(keys), dtype=np.int32)
        self.size, self.n = np.r_[self.size, size], np.r_[self.n, n]
        self.words = np.concatenate([self.words[:-8], np.frombuffer(b"".join(words), np.uint8), np.zeros(8, np.uint8)])
        self.ids = np.concatenate([self.ids, np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(n.sum()))])
        keys, rows = np.concatenate([self.keys, keys]), np.concatenate([self.rows, rows])
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], rows[order]

    def differ(self, rows: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which words of buf are not, byte for byte, those of the rows."""
        left = ends - starts
        out = left != self.size[rows]
        # Of equal length, words of up to eight bytes differ if their keys do.
        todo = np.flatnonzero(~out & (left > 8))
        here, there = np.ndarray(max(0, len(buf) - 7), "<u8", buf, strides=(1,)), np.ndarray(len(self.words) - 7, "<u8", self.words, strides=(1,))
        at, own, left = starts[todo], self.at[rows[todo]].astype(np.int64), left[todo]
        step = np.minimum(left - 8, 8)  # the last eight bytes overlap those before
        out[todo[here[at] != there[own]]] = True
        while len(todo):
            at, own, left = at + step, own + step, left - step
            out[todo[here[at] != there[own]]] = True
            more = (left > 8) & ~out[todo]
            todo, at, own, left = todo[more], at[more], own[more], left[more]
            step = np.minimum(left - 8, 8)
            if len(todo) < 9 and len(todo) and left.max() > 4096:  # a few very long words
                for k, a, o, n in zip(todo.tolist(), at.tolist(), own.tolist(), left.tolist()):
                    out[k] = not np.array_equal(buf[a : a + n], self.words[o : o + n])
                break
        return out


class Encoder:
    """Ids by the tokenizers library, a word at a time: the tokenizer never joins across ASCII white space.

    Words are told apart by 64-bit hashes and encoded once; each is compared with the
    stored one, and a word that only shares the hash gets another key.  A word of
    Western letters with signs around them needs no normaliser and goes to the
    library's BPE model piece by piece; any other word goes to the tokenizer.
    """

    #: Signs, letters, signs: each run is one piece for the tokenizer.  Without "'" and "<", which begin longer pieces.
    _plain = re.compile(r"([!-&(-/:;=-@\[-`{-~]*)([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:;=-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.store = Store()
        self.pieces: dict[str, list[int]] = {}

    def piece(self, text: str) -> list[int]:
        ids = self.pieces.get(text)
        if ids is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            ids = self.pieces[text] = [t.id for t in self.model.tokenize(text if text.isascii() else "".join(map(BYTES.__getitem__, text.encode())))]
        return ids

    def word(self, data: bytes) -> list[int]:
        text = data.decode()
        m = self._plain.fullmatch(text)
        if m:
            if not m[2]:
                return self.piece(text)
            return (self.piece(m[1]) if m[1] else []) + self.piece(m[2].lower()) + (self.piece(m[3]) if m[3] else [])
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def places(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The store's row of each word."""
        keys, out, todo = W.hashes(buf, s, e), np.empty(len(s), np.int64), np.arange(len(s))
        while len(todo):
            some, at, back = np.unique(keys[todo], return_index=True, return_inverse=True)
            rows = self.store.find(some)
            new = np.flatnonzero(rows < 0)
            if len(new):
                words = [buf[a:b].tobytes() for a, b in zip(s[todo[at[new]]].tolist(), e[todo[at[new]]].tolist())]
                rows[new] = len(self.store.size) + np.arange(len(new))
                self.store.add(some[new], words, [self.word(w) for w in words])
            out[todo] = rows[back]
            todo = todo[self.store.differ(out[todo], buf, s[todo], e[todo])]
            keys[todo] = W.mix(keys[todo] + np.uint64(1))
        return out

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, each closed by END; first id of each document, and the total)."""
        s, e, first = W.split(buf, off)
        counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(s), WORDS):
            if self.store.full():
                self.store.clear()
            row = self.places(buf, s[i : i + WORDS], e[i : i + WORDS])
            n = self.store.n[row].astype(np.int64)
            ends = np.cumsum(n)
            counts.append(n)
            parts.append(self.store.ids[np.arange(int(ends[-1])) + np.repeat(self.store.first[row] - (ends - n), n)])
        upto = np.r_[0, np.cumsum(np.concatenate(counts))][first]  # ids before each document, without the closing ones
        return np.insert(np.concatenate(parts), upto[1:], np.uint32(END)), upto + np.arange(len(upto))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenise(docs: DataFrame, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ids binary (little-endian 32-bit), task long, before long, n long: a row for each row of docs."""
    names = ("doc_id", *(k for k in keep if k != "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before, encode = TaskContext.get().partitionId(), 0, encoder(path)
        for b in batches:
            for i, buf, off in W.chunks(*W.column(b["text"])):
                ids, first = encode(buf, off)
                n = np.diff(first)
                places = before + first[:-1]
                before += len(ids)
                data = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())
                part = b.slice(i, len(n))
                yield pa.RecordBatch.from_pydict({c: part[c] for c in names} | {"ids": data, "task": pa.array(np.full(len(n), task), pa.int64()), "before": pa.array(places, pa.int64()), "n": pa.array(n, pa.int64())})

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys((*names, "text"))).mapInArrow(W.lean(run), f"{kept}, ids binary, task long, before long, n long")


def pack(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids binary, doc_tokens, sequence_id, offset: a row for each piece.

    Null and empty texts give the one end id.  Repeated rows are packed each.  An
    empty table gives no rows.  Ids of pass one are written before the prefix sum,
    so a task that runs again cannot move the documents.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    stored = scratch.write(tokenise(docs, path), "ids")
    totals = stored.groupBy("task").agg(F.sum("n").alias("_n"))  # one row for each task of pass one
    before = F.sum("_n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select(F.col("task").alias("_task"), F.coalesce(before, F.lit(0)).alias("_base"))
    small = totals.count() <= TASKS
    placed = stored.join(F.broadcast(bases) if small else bases.hint("merge"), F.col("task") == F.col("_task")).withColumn("_at", F.col("_base") + F.col("before"))
    last = F.expr(f"(_at + n - 1) div {window}")
    cut = placed.select("doc_id", "ids", "n", "_at", F.explode(F.sequence(F.expr(f"_at div {window}"), last)).alias("sequence_id"))
    low, high = F.greatest(F.col("_at"), F.col("sequence_id") * window), F.least(F.col("_at") + F.col("n"), (F.col("sequence_id") + 1) * window)
    cut = cut.select("doc_id", "ids", "n", "sequence_id", (low - F.col("_at")).alias("start"), (high - low).alias("length"), (low - F.col("sequence_id") * window).alias("offset"))
    piece = F.col("ids").substr((F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int"))
    return cut.select("doc_id", "start", "length", piece.alias("ids"), F.col("n").alias("doc_tokens"), "sequence_id", "offset")


def default_path() -> str:
    """The vocabulary file that the packing query is set to use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return pack(docs, path or default_path()).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
