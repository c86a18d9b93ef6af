"""Language of whole texts and of the spans of mixed ones.

Script ranges (by the code points of its letters) first narrow the languages a word
can be in.  Its score for each of those is the sum of the log probabilities of its
byte n-grams over the square root of their number; any other language scores less
than all of them.  Viterbi with a switching penalty then labels the words, and the
document gets the language that covers most of it.

The model is learned from a bounded sample of labelled rows (`SAMPLE` documents,
dealt evenly to the labels; of each label those whose hashed id is smallest), with
every label; counts are summed on the executors, and only FEATURES numbers a
language reach the driver.  Repeated rows count as rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W

SAMPLE = 6_000  # labelled documents the model is learned from, at most, or one for each label if those are more
BITS = 15
FEATURES = 1 << BITS
ORDERS = (2, 3, 4)
ROWS = 1000  # texts that are labelled at once
PENALTY = 6.0  # cost, in nats, of a change of language between two words
STRANGE = -12.0  # what a language that the word's script rules out lies below the worst of the others

#: First code point of each run of scripts; 0 is Latin, and what says nothing about the language.
SCRIPT_STARTS = (
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"), (0x0800, "Samaritan"), (0x08A0, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"),
    (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"), (0x1680, "Ogham"), (0x1700, "Philippine"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x1900, "Other"), (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"), (0x2000, "Latin"), (0x2D00, "Georgian"), (0x2D30, "Other"), (0x2E80, "Han"), (0x3000, "Latin"), (0x3040, "Kana"), (0x3100, "Han"), (0x3130, "Hangul"), (0x3190, "Han"),
    (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"), (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Latin"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, "Latin"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0xFFE0, "Latin"),
    (0x10000, "Other"),
)
SCRIPTS = tuple(dict.fromkeys(name for _, name in SCRIPT_STARTS))


def _pairs() -> np.ndarray:
    """The script by a character's first two bytes (256 x 64); of three-byte characters these tell 64 code points, which go by the middle one."""
    begins, names = zip(*SCRIPT_STARTS)
    number = np.array([SCRIPTS.index(n) for n in names], np.uint8)
    lead, second = np.arange(256)[:, None], np.arange(64)[None, :]
    code = np.where(lead < 0xE0, (lead & 31) << 6 | second, (lead & 15) << 12 | second << 6 | 32)
    out = number[np.searchsorted(begins, np.where(lead < 0xF0, code, 0x10000), "right") - 1]
    out[:0xC2] = 0  # ASCII, and bytes that go on
    return out


PAIRS = _pairs()


def scripts_of(buf: np.ndarray) -> np.ndarray:
    """The script that each character's first byte tells; 0 elsewhere."""
    after = np.zeros(len(buf), np.uint8)
    after[:-1] = buf[1:]
    return PAIRS[buf, after & 63]


#: Letters are a-z and all bytes of non-ASCII characters.
OTHER = np.ones(256, bool)
OTHER[97:123] = False
OTHER[128:] = False


def lowered(texts: pa.Array) -> pa.Array:
    return pa.array([(t or "").lower() for t in texts.to_pylist()], pa.large_string())


def features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of each byte's n-gram, whether it lies in one word) for each order; a word's edges count as a space."""
    n = len(buf)
    inside = np.zeros(n + 1, np.int32)
    inside[starts] += 1
    inside[ends] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    byte = np.where(inside, buf, 32).astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    for k in range(max(ORDERS)):
        shifted = np.full(n, 32, np.uint32)
        shifted[k:] = byte[: n - k] if k else byte
        gram = gram * np.uint32(0x01000193) + shifted
        if k + 1 in ORDERS:
            yield ((gram ^ np.uint32(k)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32), inside


@dataclass
class Model:
    """table: languages x FEATURES of log probabilities; allowed: scripts x languages."""

    languages: list[str]
    table: np.ndarray
    allowed: np.ndarray

    def scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """words x languages, summed over n-grams and weighted so that long words do not drown the rest."""
        n = len(self.languages)
        out = np.zeros((len(starts), n), np.float32)
        if not len(starts):
            return out
        pairs = np.empty(2 * len(starts), np.int64)
        pairs[::2], pairs[1::2] = starts, ends
        clip = pairs[-1] == len(buf)
        script = np.maximum.reduceat(scripts_of(buf), pairs[:-1] if clip else pairs)[::2]
        may = self.allowed[script]
        index = [i for i, _ in features(buf, starts, ends)]
        for k in np.flatnonzero(may.any(0)).tolist():
            own = self.table[k]
            value = own[index[0]]
            for i in index[1:]:
                value += own[i]
            out[:, k] = np.add.reduceat(value, pairs[:-1] if clip else pairs)[::2]
        out /= np.sqrt(len(ORDERS) * (ends - starts))[:, None]
        return out if may.all() else np.where(may, out, np.where(may, out, np.inf).min(1)[:, None] + np.float32(STRANGE))


def shares(counts: dict[str, int], sample: int) -> dict[str, int]:
    """Rows to draw of each label: as even as the counts allow, one at least, sample in all unless there are more labels."""
    out, left = {}, sample
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(1, left // (len(counts) - k)))
        left -= out[lang]
    return out


def _drawn(train: DataFrame, sample: int) -> DataFrame:
    """lang, text of the training rows: each label's share, those of least hash."""
    spark = train.sparkSession
    counts = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # a row for each label
    # A first cut by hash leaves about twice the share, so the ranks are of a few rows at any size.
    cuts = [(lang, q, (2 * q + 60) / counts[lang]) for lang, q in shares(counts, sample).items()]
    table = F.broadcast(spark.createDataFrame(cuts, "lang string, _share long, _cut double"))
    row = (F.col("doc_id").cast("string"), F.col("text"))  # not the id alone, which a third of all rows may have
    near = train.select("doc_id", "lang", "text").join(table, "lang").where(F.pmod(F.xxhash64(*row, F.lit(11)), F.lit(1 << 32)) < F.col("_cut") * (1 << 32))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(*row, F.lit(7)), "doc_id"))
    return near.withColumn("_rank", rank).where("_rank <= _share").select("lang", "text")


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from rows with text and lang whose crc32(doc_id as text) mod 3 is not 1."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = _drawn(train, sample).repartition(16, F.xxhash64("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        scripts: dict[str, np.ndarray] = {}
        for b in batches:
            lang = b["lang"].to_pylist()
            buf, off = W.column(lowered(b["text"]))
            for at, part, o in W.chunks(buf, off):
                for k in range(len(o) - 1):
                    text = part[o[k] : o[k + 1]]
                    s, e, _ = W.split(text, np.array([0, len(text)]), OTHER)
                    if not len(s):
                        continue
                    total = sums.setdefault(lang[at + k], np.zeros(FEATURES, np.int64))
                    for index, inside in features(text, s, e):
                        total += np.bincount(index[inside], minlength=FEATURES)
                    seen = scripts.setdefault(lang[at + k], np.zeros(len(SCRIPTS), np.int64))
                    seen += np.bincount(np.maximum.reduceat(scripts_of(text), s), minlength=len(seen))
        for k, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k], pa.string()), "counts": pa.array([np.concatenate([v, scripts[k]])], pa.list_(pa.int64()))})

    counted = rows.mapInArrow(W.lean(count), "lang string, counts array<bigint>").select("lang", F.posexplode("counts").alias("at", "n"))
    summed = counted.where("n > 0").groupBy("lang", "at").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("at", "n")).alias("cells"))
    got = sorted(summed.collect(), key=lambda r: r["lang"])  # FEATURES cells a language at most
    table = np.zeros((FEATURES, len(got)), np.float64)
    scripts = np.zeros((len(SCRIPTS), len(got)), np.float64)
    for k, r in enumerate(got):
        for cell in r["cells"]:
            (table if cell["at"] < FEATURES else scripts)[cell["at"] % FEATURES, k] = cell["n"]
    table = np.log((table + 0.5) / (table.sum(0) + 0.5 * FEATURES)) if got else table
    share = scripts / np.maximum(scripts.sum(0), 1)
    allowed = share >= 0.002
    allowed[~allowed.any(1)] = True
    return Model([r["lang"] for r in got], np.ascontiguousarray(table.T, np.float32), allowed)


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _steady(scores: np.ndarray, first: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """(the label of greatest sum for each document, whether keeping it throughout is the best path).

    A path that leaves label A for m spans pays at least m penalties.  If for every
    other label B no run of words gains more than one penalty by B, leaving never
    pays.  The greatest gain of a run is a running sum less its running minimum.
    """
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    sums = np.stack([np.bincount(doc, scores[:, k], n) for k in range(scores.shape[1])], 1)
    best, steady = sums.argmax(1), np.ones(n, bool)
    own = scores[np.arange(len(scores)), best[doc]].astype(np.float64)
    filled = np.flatnonzero(np.diff(first) > 0)
    if not len(filled):
        return best, steady
    for k in range(scores.shape[1]):
        gain = scores[:, k] - own
        total = np.cumsum(gain)
        before = total - gain
        total -= before[first[filled]].repeat(np.diff(first)[filled])
        before -= before[first[filled]].repeat(np.diff(first)[filled])
        # Each document lies far below the one before it, so the running minimum starts anew.
        drop = doc * (float(np.abs(total).max()) * 2 + 1)
        least = np.minimum.accumulate(before - drop) + drop
        steady[filled] &= np.maximum.reduceat(total - least, first[filled]) <= penalty * 0.999
    return best, steady


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word for each document; first: first word of each document, and the total.

    Documents that one label explains best throughout are told apart beforehand; the
    others run together by length, one step for each word.
    """
    n = np.diff(first)
    label, steady = _steady(scores, first, penalty)
    labels = label.astype(np.int32).repeat(n)
    order = np.argsort(-n, kind="stable")
    order = order[(n[order] > 0) & ~steady[order]]
    i = 0
    while i < len(order):
        longest = int(n[order[i]])
        group = order[i : i + max(1, min(4096, 4_000_000 // longest))]
        i += len(group)
        at, size = first[group], n[group]
        best = scores[at].astype(np.float32)
        back = np.zeros((longest, *best.shape), np.min_scalar_type(-best.shape[1]))
        here = np.arange(best.shape[1], dtype=back.dtype)
        live = len(group)
        final = np.zeros(len(group), np.int64)
        for t in range(1, longest + 1):
            still = int(np.searchsorted(-size, -t, "left"))  # documents with more than t words come first
            if still < live:
                final[still:live] = best[still:live].argmax(1)
                live = still
            if not live:
                break
            b = best[:live]
            top = b.argmax(1)
            change = b[np.arange(live), top][:, None] - penalty
            stay = b >= change
            back[t, :live] = np.where(stay, here, top[:, None])
            best[:live] = np.where(stay, b, change) + scores[at[:live] + t]
        state = final
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-size, -t, "left"))
            labels[at[:live] + t] = state[:live]
            if t:
                state[:live] = back[t, np.arange(live), state[:live]]
    return labels


def label(m: Model, texts: pa.Array) -> tuple[list[str], list[float], list[list[dict]]]:
    """(language, score, spans) of each text."""
    k = len(m.languages)
    lang, score, spans = [], [], []
    low = lowered(texts)
    buf, off = W.column(low)
    for at, part, o in W.chunks(buf, off, 1 << 19):
        s, e, first = W.split(part, o, OTHER)
        if not k or not len(s):
            lang += ["und"] * (len(o) - 1)
            score += [0.0] * (len(o) - 1)
            spans += [[]] * (len(o) - 1)
            continue
        values = m.scores(part, s, e)
        labels = viterbi(values, first)
        weight = (e - s).astype(np.float64)
        doc = np.repeat(np.arange(len(o) - 1), np.diff(first))
        cover = np.bincount(doc * k + labels, weight, (len(o) - 1) * k).reshape(-1, k)
        total = cover.sum(1)
        pick = cover.argmax(1)
        # Confidence: how much better the chosen language explains a word than the best other one.
        mean = np.stack([np.bincount(doc, values[:, j], len(o) - 1) for j in range(k)], 1) / np.maximum(np.diff(first), 1)[:, None]
        own = mean[np.arange(len(pick)), pick]
        mean[np.arange(len(pick)), pick] = -np.inf
        margin = own - mean.max(1) if k > 1 else np.ones(len(pick))
        sure = cover[np.arange(len(pick)), pick] / np.maximum(total, 1) / (1 + np.exp(-4 * np.clip(margin, -20, 20)))
        edges = np.flatnonzero(np.r_[True, (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])])
        runs, owner = np.diff(np.r_[edges, len(labels)]), doc[edges]
        bounds = np.searchsorted(owner, np.arange(len(o)))
        text = low.slice(at, len(o) - 1).to_pylist()
        for d in range(len(o) - 1):
            known = total[d] > 0 and any(map(str.isalpha, text[d]))
            lang.append(m.languages[pick[d]] if known else "und")
            score.append(float(sure[d]) if known else 0.0)
            spans.append([{"lang": m.languages[labels[edges[x]]], "words": int(runs[x])} for x in range(bounds[d], bounds[d + 1])] if known else [])
    return lang, score, spans


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, lang_pred, score, spans array<struct<lang,words>>: a row for each row of docs, repeated ones too.

    Null text, text without a letter and an empty model give `und` with score 0.
    Of languages that cover equally much, the first by name is taken.  Other columns
    of docs play no part.  An empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages floats: bounded
    names = ("doc_id", *(k for k in keep if k != "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, spans = ([x for part in column for x in part] for column in zip(*(label(sent.value, b["text"].slice(i, ROWS)) for i in range(0, max(1, b.num_rows), ROWS))))
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_pydict({c: b[c] for c in names} | {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array(spans, kind)})

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*dict.fromkeys((*names, "text"))).mapInArrow(W.lean(run), f"{kept}, lang_pred string, score double, spans array<struct<lang:string,words:bigint>>")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans."""
    return identify(docs.select("doc_id", "text", "lang"), learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


def clean(docs: DataFrame) -> DataFrame:
    """docs without those whose language cannot be told: no letters, or nothing learned.  Any columns of docs stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([x != "und" for i in range(0, b.num_rows, ROWS) for x in label(sent.value, b["text"].slice(i, ROWS))[0]], pa.bool_()))

    return docs.mapInArrow(W.lean(run), docs.schema)
