"""The ten operators against brute force, round trips and small odd tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symlattice.llm import chat, decontaminate, jaccard, language, licences, mpeg, packing, pii, repeats, shard
from symlattice.llm import words as W

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    """(doc_id, text) rows as documents, with a clashing extra column for each operator's own names."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)
    return df.withColumn("hashes", F.lit("x")).withColumn("score", F.lit(1)).withColumn("_at", F.lit(2)).withColumn("shard", F.lit("z")).repartition(3)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


ODD = [None, "", " \t\n", "one", "a b c d", "É\xa0é ü", "x" * 3000, "\x00 \x1c \x85 a", "tie tie tie tie tie tie tie tie tie tie tie tie tie tie tie"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    texts = [prose(rng, rng.randrange(0, 120), 4000) for _ in range(40)]
    passage = prose(rng, 60, 5000)
    texts += [f"{prose(rng, 20, 5000)} {passage} {prose(rng, 20, 5000)}" for _ in range(8)]
    for _ in range(4):
        base = prose(rng, 200, 9000).split()
        texts += [" ".join(base)] * 2
        for _ in range(4):
            near = list(base)
            for k in rng.sample(range(200), rng.randrange(1, 12)):
                near[k] = f"z{rng.randrange(9000)}"
            texts.append(" ".join(near))
    texts.append(prose(rng, 9000, 100_000))
    texts += ODD + ODD
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_words(corpus):
    texts = [t for _, t in corpus]
    buf, off = W.column(pa.array(texts, pa.string()))
    for limit in (50, 1 << 22):
        seen = {}
        for at, part, o in W.chunks(buf, off, limit):
            s, e, first = W.split(part, o)
            h = W.hashes(part, s, e)
            for d in range(len(o) - 1):
                got = [part[a:b].tobytes().decode() for a, b in zip(s[first[d] : first[d + 1]], e[first[d] : first[d + 1]])]
                assert got == WHITE.findall(texts[at + d] or "")
                for w, x in zip(got, h[first[d] : first[d + 1]].tolist()):
                    assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


real_hashes = W.hashes


def thue_morse(n):
    """n letters a and b, and the same with the letters changed over: polynomials modulo a power of two take them for one."""
    bits = [bin(k).count("1") & 1 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [8, 16, 64, 72, 1024, 2048, 4096])
def test_words_that_polynomials_confuse(n):
    one, other = (t.encode() for t in thue_morse(n))
    buf = np.frombuffer(one + b" " + other + b" " + one, np.uint8)
    for seed in (0, 1):
        h = W.hashes(buf, np.array([0, n + 1, 2 * n + 2]), np.array([n, 2 * n + 1, 3 * n + 2]), seed)
        assert h[0] == h[2] != h[1]
    assert W.hashes(buf, np.array([0]), np.array([n]))[0] != W.hashes(buf, np.array([0]), np.array([n]), 1)[0]


def test_substring_dedup(spark, corpus):
    first = {}
    for i, t in corpus:
        w = WHITE.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    want = {}
    for i, t in corpus:
        w = WHITE.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert any(v[1] for v in want.values())
    for batches in (1, 3):
        got = repeats.remove(table(spark, corpus), batches=batches).withColumn("h", F.sha2("kept", 256)).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["h"]) for r in got} == want
    assert repeats.report(table(spark, corpus).limit(0)).count() == 0
    twice = repeats.report(table(spark, [(1, prose(random.Random(1), 30)), (1, prose(random.Random(1), 30)), (None, prose(random.Random(1), 30)), (2, prose(random.Random(1), 30))]))
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in twice.collect()) == [("1", 0), ("1", 0), ("2", 30), ("None", 0)]


def test_index_takes_batches_and_compacts(spark):
    from symlattice.llm.store import Scratch

    index = repeats.FingerprintIndex(spark, Scratch(spark, "t"), buckets=4, most_runs=2)
    batch = lambda rows: spark.createDataFrame([(h, h * 7, d) for h, d in rows], "hash long, proof long, doc_id long")
    got = [sorted(map(tuple, index.add(batch(b), f"b{k}").collect())) for k, b in enumerate(([(1, 1), (2, 1), (1, 2)], [(1, 3), (3, 3)], [(3, 4), (4, 5)], [(2, 6), (4, 7), (5, 8)]))]
    assert got == [[(2, 1)], [(3, 1)], [(4, 3)], [(6, 2), (7, 4)]]
    assert len(index.runs) <= 3 and sum(spark.table(r).count() for r in index.runs) == 5
    wrong = spark.createDataFrame([(1, 99, 9)], "hash long, proof long, doc_id long")  # same hash, other words
    assert index.add(wrong, "b9").count() == 0
    index.drop()
    assert not index.runs


def test_saved_index_takes_unknown_batches(spark, corpus):
    """Three batches through an index that is saved and opened from its files each time give what the whole table gives."""
    from symlattice.llm.store import Scratch

    want = {r["doc_id"]: r["n_removed"] for r in repeats.remove(table(spark, corpus)).collect()}
    root, got = repeats.FingerprintIndex(spark, Scratch(spark, "kept"), buckets=4).save(), {}
    for k in range(4):
        batch = table(spark, [r for r in corpus if r[0] * 4 // len(corpus) == k])
        index = repeats.FingerprintIndex.open(spark, root)
        got |= {r["doc_id"]: r["n_removed"] for r in repeats.apply(batch, repeats.take(batch, index)).collect()}
        assert index.save() == root and len(index.runs) <= 3
        for name in index.runs:
            spark.sql(f"DROP TABLE {name}")  # of another session's catalog; its files stay
    assert got == want and any(got.values())
    repeats.FingerprintIndex.open(spark, root).drop()


def test_substring_dedup_compacts_in_the_query(spark, corpus, monkeypatch):
    calls, compact = [], repeats.FingerprintIndex.compact
    monkeypatch.setattr(repeats.FingerprintIndex, "compact", lambda self: (calls.append(len(self.runs)), compact(self)))
    repeats.report(table(spark, corpus)).count()
    assert calls == [repeats.MOST_RUNS]


def test_substring_dedup_tells_confusing_words_apart(spark):
    one, other = thue_morse(2048)
    twelve = " ".join("abcdefghijkl")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.report(table(spark, [(1, f"{twelve} {one}"), (2, f"{twelve} {other}"), (3, f"{twelve} {one}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def plain_spans(t):
    """The contract's patterns as they are written, without any short cut."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_is_exact():
    rng = random.Random(3)
    for _ in range(20_000):
        t = "".join(rng.choice("ab.@@1023456789 -+().%é") for _ in range(rng.randrange(0, 60)))
        assert pii.base(t) == plain_spans(t), t
    card = "4111 1111-1111 1111"
    for t in (card, f"x {card} y 4111111111111112", "300.1.2.3 1.2.3.4.5.6.7.8 001.002.003.004", "a@b.c@d.e a@@b.c .@b.c a@b"):
        assert pii.base(t) == plain_spans(t)


@pytest.mark.parametrize("text,kind,want", [
    ("write to jane [at] mail (dot) example [dot] com now", "email", "jane [at] mail (dot) example [dot] com"), ("write bob at mail dot example dot com now", "email", "bob at mail dot example dot com"), ("amy@example dot org.", "email", "amy@example dot org"), ("eve at x-y dot de", "email", "eve at x-y dot de"),
    ("ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("call +４４ 20 ７946 0958 soon", "phone", "+４４ 20 ７946 0958"), ("call plus four four two zero seven nine four six zero nine five eight today", "phone", "plus four four two zero seven nine four six zero nine five eight"),
    ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"), ("host 10​.0.0.1", "ip", "10​.0.0.1"),
    ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
])
def test_pii_disguises(text, kind, want):
    plain, every = pii.detect(text)
    assert [text[s:e] for k, s, e in every if k == kind] == [want]
    assert set(plain) <= set(every)
    assert want not in pii.redact(text) and f"[{kind.upper()}]" in pii.redact(text)


@pytest.mark.parametrize("text,kind,want", [
    ("to j\u0430ne@example.com now", "email", "j\u0430ne@example.com"), ("to ja\u200bne@example.com now", "email", "ja\u200bne@example.com"), ("to jane@example.c\u043em now", "email", "jane@example.c\u043em"),
    ("call +1 415 555 013\uff12\uff13 now", "phone", "+1 415 555 013\uff12\uff13"),
])
def test_pii_half_disguised(text, kind, want):
    plain, every = pii.detect(text)
    at = text.index(want)
    assert [k for k, _, _ in plain] == [kind] and set(plain) < set(every) and (kind, at, at + len(want)) in every
    assert pii.redact(text) == text.replace(want, f"[{kind.upper()}]")


@pytest.mark.parametrize("text,kind,want", [
    *((f"ask bob at mail dot example dot {top} now", "email", f"bob at mail dot example dot {top}") for top in ("me", "tv", "xyz", "za", "kr", "ie", "cz", "online", "cloud")),
    ("ask jane dot doe at example dot com now", "email", "jane dot doe at example dot com"), ("ask a dot b dot c at d dot co dot uk, yes", "email", "a dot b dot c at d dot co dot uk"),
    ("ask bob at\tmail dot example dot com now", "email", "bob at\tmail dot example dot com"), ("ask bob at\nexample dot com dot Then", "email", "bob at\nexample dot com"), ("ask jane dot doe@example.com now", "email", "jane dot doe@example.com"), ("ask jane dot doe@example dot xyz now", "email", "jane dot doe@example dot xyz"),
    ("call +1 555 one two three 4567 now", "phone", "+1 555 one two three 4567"), ("call +44 20 seven 946 0958", "phone", "+44 20 seven 946 0958"), ("call plus 44 20 7946 0958 now", "phone", "plus 44 20 7946 0958"),
    ("card 4111 1111 11 one one 1111 now", "card", "4111 1111 11 one one 1111"), ("host 10 dot 0 dot zero dot 1 up", "ip", "10 dot 0 dot zero dot 1"), ("in 2024, 7, 10.0.zero.1 up", "ip", "10.0.zero.1"),
])
def test_pii_spoken(text, kind, want):
    assert want in [text[s:e] for k, s, e in pii.detect(text)[1] if k == kind]
    assert pii.redact(text) == text.replace(want, f"[{kind.upper()}]")


@pytest.mark.parametrize("text,want", [("call +1 415 555 0132 one more time", "call [PHONE] one more time"), ("host 10.0.0.1 one of two", "host [IP] one of two"), ("one 10.0.0.1", "one [IP]"), ("one or two, three 2024 11 22 33 44 55 66 77", None)])
def test_pii_number_words_beside_plain_ones(text, want):
    assert pii.redact(text) == (want or text)


@pytest.mark.parametrize("text", ["we met at noon and saw a dot on it", "look at this one, two of three; four were at home", "arrive at station dot blank", "look at the dot com boom", "stare at it, dot in hand", "Ärger über naïve façade", "at dot", None, ""])
def test_pii_leaves_clean_texts(text):
    assert pii.detect(text) == ([], []) and pii.redact(text) == text


@pytest.mark.parametrize("text,kind,want", [
    ("tel plus vier neun drei null eins zwei drei vier fünf sechs sieben", "phone", "plus vier neun drei null eins zwei drei vier fünf sechs sieben"), ("le +33 un deux trois quatre cinq six sept huit neuf", "phone", "+33 un deux trois quatre cinq six sept huit neuf"),
    ("al +34 seis uno dos tres cuatro cinco seis siete ocho", "phone", "+34 seis uno dos tres cuatro cinco seis siete ocho"), ("anna [arroba] correo punto es", "email", "anna [arroba] correo punto es"), ("luc arobase exemple point fr et", "email", "luc arobase exemple point fr"),
    ("host zehn, 10 punkt null punkt null punkt eins", "ip", "10 punkt null punkt null punkt eins"),
])
def test_pii_spoken_in_other_languages(text, kind, want):
    assert want in [text[s:e] for k, s, e in pii.detect(text)[1] if k == kind]


@pytest.mark.parametrize("text", ["un ou deux, trois jours à ce point jane", "acht Tage, null Bock auf neun Uhr", "dos o tres cosas, punto", "à point nommé"])
def test_pii_leaves_other_languages(text):
    assert pii.detect(text) == ([], [])


def test_pii_long_numbers_and_labels(spark):
    zeros = "0" * 5000
    for t in (f"{zeros}.1.2.3", f"{zeros}1.2.3.4 x", f"{'9' * 5000}.1.2.3", f"+{zeros}", f"{zeros} {zeros}"):
        plain, every = pii.detect(t)
        assert [s for s in plain if s[0] == "ip"] == ([] if "9" in t else [("ip", 0, len(t.split()[0]))] if "." in t else []) and plain == every
    label = "a" * 700
    assert pii.detect(f"to x@{label} dot com now")[1] == [("email", 3, 13 + 700)]
    got = pii.report(table(spark, [(1, f"{zeros}.1.2.3"), (1, f"{zeros}.1.2.3"), (2, None)])).collect()
    assert sorted((r["doc_id"], r["n_ip"]) for r in got) == [(1, 1), (1, 1), (2, 0)]
    assert pii.report(table(spark, [(1, "x")]).limit(0)).count() == 0 and pii.clean(table(spark, [(1, "x")]).limit(0)).count() == 0


def test_pii_time_follows_the_length():
    """Five megabytes of disguised addresses, numbers and look-alikes."""
    import time

    part = "".join(f"u{k} [at] mail{k} (dot) com, jаne{k}@exаmple.com tel +4{k % 10} one two three 4567{k % 100} host 10 dot 0 dot zero dot {k % 256} mail " for k in range(40_000))
    began = time.process_time()
    plain, every = pii.detect(part)
    assert len(part) > 3_800_000 and len(every) > 140_000
    assert time.process_time() - began < 40
    began = time.process_time()
    pii.detect("jane@" + "a" * 2_000_000 + " dot " * 400_000 + "one " * 500_000)
    assert time.process_time() - began < 40


def contained(text):
    """What detect() keeps, pair by pair."""
    plain, hidden, every = pii.base(text), pii.disguised(text), []
    for k, s, e in hidden:
        if not any(x[0] == k and x[1] <= s and e <= x[2] for x in plain) and not any(x[0] == k and x[1] <= s and e <= x[2] and x != (k, s, e) for x in hidden):
            every.append((k, s, e))
    return sorted({*plain, *every}, key=lambda x: (pii.KINDS.index(x[0]), x[1], -x[2]))


def test_pii_sweep_is_exact():
    rng = random.Random(9)
    for _ in range(3000):
        t = " ".join(rng.choice(("a@b.com", "one", "two", "10", ".", "dot", "at", "0.0.1", "+44", "2079460958", "а@b.com", "com", "[at]", "(dot)", "x", "４１１１", "zero")) for _ in range(rng.randrange(1, 18)))
        assert pii.detect(t)[1] == contained(t), t


def test_pii_tables(spark, corpus):
    rows = corpus + [(900, "a@b.co and 1.2.3.4"), (901, "plain")]
    got = {r["doc_id"]: r for r in pii.report(table(spark, rows)).collect()}
    assert got[900]["spans"] == "email:0:6,ip:11:18" and got[900]["base_sha256"] == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest() and got[901]["n_email"] == 0
    back = {r["doc_id"]: r for r in pii.clean(table(spark, rows)).collect()}
    assert back[900]["text"] == "[EMAIL] and [IP]" and back[900]["n_chars"] == 16 and back[901]["n_chars"] == 5 and len(back) == len(rows)


def shingles(t):
    w = WHITE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def linked(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join(spark, corpus):
    rng = random.Random(8)
    rows = [(i, (t or "").upper() if t and i % 7 == 0 else t) for i, t in corpus]
    for size in range(1, 60):  # pairs that lie about the threshold, at all small sizes and at the borders of bands
        base = [f"q{size}.{k}" for k in range(size + 4)]
        near = list(base)
        near[rng.randrange(len(near))] = "other"
        rows += [(1000 + 3 * size, " ".join(base)), (1001 + 3 * size, " ".join(base + ["x", "y"][: size // 20])), (1002 + 3 * size, " ".join(near))]
    want = linked(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, rows)).collect()}
    assert got == want
    kept = {r["doc_id"] for r in jaccard.clean(table(spark, rows)).collect()}
    assert kept == {i for i, (_, c) in want.items() if i == c}


def test_jaccard_chains_and_edges(spark):
    base = [f"c{k}" for k in range(200)]
    chain = [(i, " ".join(base[: 200 - 9 * i])) for i in range(8)]  # each is near the next one, the ends are not
    want = linked(chain)
    assert len({c for _, c in want.values()}) == 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, chain)).collect()} == want
    odd = jaccard.join(table(spark, [(5, "a b"), (5, "a b"), (None, "a b"), (7, "A B"), (8, None), (9, "")]))
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in odd.collect()) == [("5", 1, "5"), ("5", 1, "5"), ("7", 1, "5"), ("8", 0, "8"), ("9", 0, "9"), ("None", 1, "None")]
    assert jaccard.join(table(spark, chain).limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 2048])
def test_jaccard_strays(spark, monkeypatch, block):
    """Copies so far from the text they were made from that many are not linked to it, but some to each other."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, rows = random.Random(12), []
    for g in range(3):
        base = [f"g{g}.{k}" for k in range(150)]
        for c in range(40):
            own = list(base)
            for k in rng.sample(range(150), rng.randrange(1, 9)):
                own[k] = f"e{g}.{c}.{k}"
            rows.append((100 * g + c, " ".join(own)))
            if c % 8 == 0:
                own[75] = "again"
                rows.append((100 * g + 50 + c, " ".join(own)))
    want = linked(rows)
    strays = {i for i, (_, c) in want.items() if c not in (0, 100, 200)}
    assert len({c for _, c in want.values()}) > 6 and strays
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, rows)).collect()} == want


def test_jaccard_strays_make_few_rows(spark, monkeypatch):
    """Pairs of one large group of near copies lie in many groups, and the rows they make follow the members, not the pairs."""
    rng, rows, made, strays = random.Random(21), [], [], jaccard._strays

    def counted(*given):
        out = strays(*given)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "_strays", counted)
    base = [f"s{k}" for k in range(150)]
    for c in range(160):
        own = list(base)
        for k in rng.sample(range(150), rng.randrange(1, 8)):
            own[k] = f"e{c % 40}.{k}"  # some copies have changes in common
        rows.append((c, " ".join(own)))
    want = linked(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(table(spark, rows)).collect()} == want
    assert made and made[0] < len(rows)


def test_jaccard_tells_confusing_words_apart(spark):
    one, other = thue_morse(1024)
    rows = [(1, f"a b c d {one}"), (2, f"a b c d {other}"), (3, f"a b c d {one}"), (4, one), (5, other)]
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(table(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


@pytest.mark.parametrize("name", ["_kept", "_KEPT", "component_id", "class"])
def test_jaccard_clean_with_clashing_names(spark, name):
    docs = spark.createDataFrame([(1, "a b", 7), (2, "A B", 8), (3, None, 9)], f"doc_id long, text string, `{name}` long")
    assert sorted(map(tuple, jaccard.clean(docs).collect())) == [(1, "a b", 7), (3, None, 9)]
    assert jaccard.clean(docs).columns == docs.columns


def test_signatures_never_miss():
    rng = np.random.default_rng(4)
    for size in [*range(1, 90), 127, 128, 129, 171, 255, 256, 300, 511, 512, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size, np.uint64))
            n = len(a)
            drop = int(rng.integers(0, n // 4 + 1))
            add = max(0, int((n - drop) / 0.75 - n))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, add + 1)), np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both < 75 * (n + len(b) - both):
                continue
            lists = [{}, {}]
            for x, own in zip((a, b), lists):
                _, sigs, codes = jaccard.signatures(x, np.array([0, len(x)]))
                for sig, code in zip(sigs.tolist(), codes.tolist()):
                    own.setdefault(code, []).append(sig)
                assert all(len(v) == code >> 32 for code, v in own.items())
            for order in range(4):  # whatever the common order, the first so many of each list share one
                rank = lambda x: int(W.mix(np.array([x ^ order * 977], np.uint64))[0])  # noqa: E731, B023
                first = [{x for code, v in own.items() for x in sorted(v, key=rank)[: code >> 2 & (1 << 30) - 1]} for own in lists]
                assert first[0] & first[1], (n, len(b), both)


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    path = packing.default_path()
    tokenizer = Tokenizer.from_file(path)
    rows = corpus + [(800, "It's <|endoftext|> ﬁne — naïve! 3 x² don't… A'll\x1cb İstanbul ΑΣ é ́x 日本語"), (801, "word " * 5000)]
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    for window in (64, 2048):
        pieces = packing.pack(table(spark, rows), path, window).collect()
        flat, parts = {}, {}
        for p in pieces:
            got = np.frombuffer(bytes(p["ids"]), "<u4").tolist()
            assert p["length"] == len(got) > 0 and p["doc_tokens"] == len(ids[p["doc_id"]]) and got == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
            parts.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
            flat.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        assert {i: sum(n for _, n in p) for i, p in parts.items()} == {i: len(x) for i, x in ids.items()}
        for k, s in flat.items():
            assert [a for a, _ in sorted(s)] == np.r_[0, np.cumsum([n for _, n in sorted(s)])[:-1]].tolist()
            assert sum(n for _, n in s) == window or k == max(flat)
        assert sorted(flat) == list(range(len(flat)))
    row = packing.report(table(spark, [(1, None)])).collect()[0]
    assert (row["length"], row["ids_crc32"], row["sequence_id"], row["offset"]) == (1, zlib.crc32(b"\1\0\0\0"), 0, 0)
    assert packing.pack(table(spark, rows).limit(0), path).count() == 0


def test_encoder_tells_words_of_one_hash_apart(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_path()
    tokenizer = Tokenizer.from_file(path)
    texts = [*thue_morse(1024), "a b c a bb ccc dddddddddd dddddddddx xddddddddd", "éé 12345678901234567 12345678901234568 " + "z" * 9000 + " " + "z" * 8999 + "y", ""] * 2
    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    for hashes in (real_hashes, lambda buf, s, e: real_hashes(buf, s, e) % np.uint64(3), lambda buf, s, e: np.zeros(len(s), np.uint64)):
        monkeypatch.setattr(packing.W, "hashes", hashes)
        # Short words of one length are told apart by the hash itself, so poor hashes are tried on long ones only.
        rows = range(len(texts)) if hashes is real_hashes else [k for k in range(len(texts)) if k % 5 in (0, 1, 4)]
        for size in (packing.WORDS, 2):
            monkeypatch.setattr(packing, "WORDS", size)
            buf, off = W.column(pa.array([texts[k] for k in rows], pa.string()))
            encode = packing.Encoder(path)
            for _ in range(2):
                ids, first = encode(buf, off)
                assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [want[k] for k in rows]


def test_encoder_forgets(monkeypatch):
    from tokenizers import Tokenizer

    path = packing.default_path()
    monkeypatch.setattr(packing, "CACHE", 4000)
    monkeypatch.setattr(packing, "WORDS", 50)
    monkeypatch.setattr(packing, "PIECES", 5)
    rng, tokenizer, encode = random.Random(2), Tokenizer.from_file(path), packing.Encoder(path)
    for _ in range(5):
        texts = [prose(rng, 80, 5000) for _ in range(6)]
        ids, first = encode(*W.column(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert encode.store.words.nbytes + encode.store.ids.nbytes < 20_000


def test_decontamination(spark, corpus):
    rng = random.Random(9)
    items = [(k, prose(rng, 30, 500).replace(" ", ", ", 3)) for k in range(12)] + [(20, "Only, three words"), (21, None), (22, "?!"), (23, "a"), (10, "w1 w2 W3 w4 w5 w6 w7 w8 w9")]
    rows = corpus + [(700, items[2][1].upper()), (701, f"x {items[3][1]} y. {items[10][1]}"), (702, "the ONLY three... words a a"), (703, "w1-w2-w3 w4 w5 w6 w7 w8"), (704, " ".join(items[4][1].split()[:7]))]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    known = {}
    for k, t in items:
        w = words(t)
        for x in range(max(0, len(w) - min(len(w), 8) + 1)) if w else ():
            known.setdefault(tuple(w[x : x + min(len(w), 8)]), set()).add(str(k))
    want = {}
    for i, t in rows:
        w = words(t)
        hit, who = set(), set()
        for x in range(len(w)):
            for n in range(1, 9):
                if x + n <= len(w) and tuple(w[x : x + n]) in known:
                    hit |= set(range(x, x + n))
                    who |= known[tuple(w[x : x + n])]
        want[i] = (len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), len(who) >= 2)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in decontaminate.report(table(spark, rows), bench).collect()}
    assert got == want
    blocks = decontaminate.scan(table(spark, rows), bench, block=40).collect()
    assert {r["doc_id"]: len(r["items"]) for r in blocks} == {i: v[2] for i, v in want.items()}
    kept = {r["doc_id"]: r for r in decontaminate.clean(table(spark, rows), bench).collect()}
    assert set(kept) == {i for i, v in want.items() if not v[4]}
    assert kept[703]["text"] == "-- " + " " * 4 and kept[704]["text"] == rows[-1][1] and kept[703]["n_chars"] == 7
    texts = dict(rows)
    assert all(kept[i]["text"] == texts[i] for i in kept if not want[i][1])
    assert decontaminate.report(table(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.report(table(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.report(table(spark, [(1, "a"), (1, "a")]), bench).count() == 2


def test_decontamination_cuts_words_with_capitals(spark):
    """Words of capitals alone count as words where a passage is cut out, and a text of nothing else does not end the task."""
    rng = random.Random(10)
    passage = "alpha beta gamma delta epsilon zeta eta theta iota"
    rows = [(1, f"ONE TWO {passage.upper()} THREE"), (2, passage.upper()), (3, f"The USA is {passage.title()}, NATO's end"), (4, f"{passage.upper()}-ÉTÉ É"), (5, f"x {passage} Y")]
    for i in range(6, 60):
        said = [*(rng.choice(["A", "Bc", "dE", "f", "Ñ", "7", "G8"]) for _ in range(rng.randrange(6))), *passage.split(), *(rng.choice(["A", "Bc", "z"]) for _ in range(rng.randrange(6)))]
        rows.append((i, "".join(rng.choice([str, str.upper, str.title])(w) + rng.choice([" ", ", ", "-"]) for w in said)))
    want = {}
    for i, t in rows:
        found = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t))
        lower = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[0]) for m in found]
        at = next(k for k in range(len(lower)) if lower[k : k + 9] == passage.split())
        for m in reversed(found[at : at + 9]):
            t = t[: m.start()] + t[m.end() :]
        want[i] = (t, len(t))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.clean(table(spark, rows), bench).collect()} == want


def test_decontamination_is_native(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    for df in (decontaminate.report(table(spark, [(1, "x")]), bench), shard.report(table(spark, [(1, "x")]))):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


def test_mpeg(spark, corpus):
    for size in [0, 1, 100, 191, 192, 193, 1000, 5000, 200_000]:
        data = bytes(random.Random(size).randrange(256) for _ in range(size))
        media = mpeg.write(mpeg.pad(data))
        got = mpeg.parse(media)
        assert got.payload == mpeg.pad(data) and not got.problems and got.vbr_frames == len(got.offsets) and got.seconds == len(got.offsets) * 1152 / 48000
        assert got.vbr_bytes == len(media) - 128 - (10 + (media[6] << 21 | media[7] << 14 | media[8] << 7 | media[9])) and len(got.toc) == 100
        assert all(mpeg.header(media, p) for p in got.offsets) and mpeg.seek(got, 0) == got.offsets[0] and mpeg.seek(got, 1e9) == got.offsets[-1]
    media = mpeg.write(mpeg.pad(bytes(5000)))
    first = mpeg.parse(media).offsets
    broken = bytearray(media)
    broken[first[1] + 10] ^= 1
    assert any(p.startswith("checksum") for p in mpeg.parse(bytes(broken)).problems)
    junk = media[: first[1]] + b"\xff\xfb junk \xff" + media[first[1] :]
    back = mpeg.parse(junk)
    assert back.skipped == 9 and back.payload == mpeg.pad(bytes(5000)) and len(back.offsets) == len(first)
    assert mpeg.parse(media[: first[2] + 50]).problems and mpeg.parse(b"").offsets == []
    got = {r["doc_id"]: r for r in mpeg.report(table(spark, corpus)).collect()}
    for i, t in corpus:
        p = mpeg.pad((t or "").encode())
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"], got[i]["n_problems"]) == (len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), 0)


def test_mpeg_damage_and_small_tables(spark):
    """Whatever is cut or changed, the parser ends and says so."""
    media = mpeg.write(mpeg.pad(bytes(range(256)) * 12))
    rng = random.Random(1)
    for cut in [*range(0, 80), *range(80, len(media), 97)]:
        got = mpeg.parse(media[:cut])
        assert mpeg.seek(got, 1.0) in (None, *got.offsets) and (got.problems or cut < 40 or not got.tags)
    for _ in range(300):
        bad = bytearray(media)
        for _ in range(rng.randrange(1, 30)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        mpeg.parse(bytes(bad))
        mpeg.parse(bytes(rng.randrange(256) for _ in range(300)) + bytes(bad[rng.randrange(200) :]))
    rows = [(1, "a"), (1, "a"), (None, None), (2, "é" * 300_000)]
    got = mpeg.report(table(spark, rows).withColumn("media", F.lit(1)).withColumn("offsets", F.lit(1))).collect()
    assert len(got) == 4 and len({r["media_sha256"] for r in got if r["doc_id"] == 1}) == 1 and max(r["n_bytes"] for r in got) == 600_000 and not any(r["n_problems"] for r in got)
    assert len({r["feature"] for r in mpeg.report(table(spark, [(1, "a" * 192), (2, "b" * 192)])).collect()}) == 2
    assert mpeg.report(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("version,layer,bitrate,rate,size,samples", [
    (3, 1, 2, 44100, 68, 384), (3, 2, 10, 48000, 576, 1152), (3, 3, 9, 44100, 417, 1152), (2, 1, 4, 22050, 136, 384), (2, 2, 8, 24000, 384, 1152), (2, 3, 8, 22050, 208, 576), (0, 3, 4, 8000, 288, 576), (0, 2, 4, 11025, 417, 1152),
])
@pytest.mark.parametrize("mode", [0, 1, 3])
def test_mpeg_headers_of_all_kinds(version, layer, bitrate, rate, size, samples, mode):
    at = next(k for k in range(3) if mpeg.RATES[k] >> {3: 0, 2: 1, 0: 2}[version] == rate)
    head = bytes((0xFF, 0xE0 | version << 3 | (4 - layer) << 1, bitrate << 4 | at << 2, mode << 6 | (16 if mode == 1 else 0)))
    f = mpeg.header(head, 0)
    assert (f.size, f.samples, f.rate, f.layer, f.protected) == (size, samples, rate, layer, True)
    covered = {1: {0: 32, 1: 20, 3: 16}[mode], 2: 0, 3: (17 if mode == 3 else 32) if version == 3 else (9 if mode == 3 else 17)}[layer]
    body = bytes(random.Random(size).randrange(255) for _ in range(size - 6))
    crc = 0xFFFF
    for bit in "".join(f"{b:08b}" for b in head[2:] + body[:covered]):
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    frame = head + crc.to_bytes(2, "big") + body
    got = mpeg.parse(b"junk" + frame * 4)
    assert got.offsets == [4 + k * size for k in range(4)] and got.seconds == pytest.approx(4 * samples / rate) and got.problems == ["resync at 0"] and mpeg.seek(got, 2.5 * samples / rate) == 4 + 2 * size
    if layer != 2:
        wrong = bytearray(frame * 4)
        wrong[size + 7] ^= 1
        assert mpeg.parse(bytes(wrong)).problems == [f"checksum at {size}"]


def test_mpeg_tags_and_tables():
    frame = mpeg.head(9) + bytes(mpeg.ROOM[9])
    size = len(frame)
    info = bytearray(frame)
    info[36:62] = b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big") + (2).to_bytes(2, "big") + bytes(2) + (2).to_bytes(2, "big") + bytes(2)
    old = b"ID3\x02\0\0" + mpeg.synchsafe(10) + b"TT2" + (4).to_bytes(3, "big") + b"\0abc"
    three = b"ID3\x03\0\0" + mpeg.synchsafe(214) + b"TPE1" + (204).to_bytes(4, "big") + b"\0\0" + b"\0" + b"x" * 203
    ape_item = (3).to_bytes(4, "little") + bytes(4) + b"Key\0val"
    ape = ape_item + b"APETAGEX" + (2000).to_bytes(4, "little") + (32 + len(ape_item)).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(12)
    last = b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    got = mpeg.parse(old + three + bytes(info) + frame * 3 + ape + last)
    assert [n for n, _ in got.tags] == ["TT2", "TPE1", "ID3v1 title", "APE Key"] and dict(got.tags)["APE Key"] == b"val" and dict(got.tags)["ID3v1 title"] == b"title" and len(dict(got.tags)["TPE1"]) == 204
    assert (got.vbr, got.vbr_bytes, got.vbr_frames, len(got.toc)) == ("VBRI", 5000, 3, 4) and len(got.offsets) == 3 and got.offsets[0] == len(old + three) + size and not [p for p in got.problems if "checksum" not in p]


def test_viterbi():
    rng = np.random.default_rng(1)
    for k in (1, 2, 4):
        sizes = rng.integers(0, 30, 60)
        scores = (rng.normal(size=(int(sizes.sum()), k)) * 4).astype(np.float32)
        first = np.r_[0, np.cumsum(sizes)]
        labels = language.viterbi(scores, first, 6.0)
        for d in range(len(sizes)):
            part = scores[first[d] : first[d + 1]].astype(float)
            if not len(part):
                continue
            best = part[0].copy()
            for row in part[1:]:
                best = np.maximum(best, best.max() - 6.0) + row
            own = labels[first[d] : first[d + 1]]
            assert part[np.arange(len(own)), own].sum() - 6.0 * (own[1:] != own[:-1]).sum() == pytest.approx(best.max(), abs=1e-3)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) > 0.98
    model = language.learn(docs)
    text = {r["lang"]: r["text"] for r in docs.orderBy("doc_id").limit(60).collect()}
    half = lambda t: " ".join(t.split()[:60])
    odd = table(spark, [(1, half(text["en"]) + " " + half(text["fr"])), (2, None), (3, ""), (4, "123 !? — ٣"), (5, half(text["de"]))])
    got = {r["doc_id"]: r for r in language.identify(odd.drop("score"), model, keep=("source",)).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "fr"] and got[5]["lang_pred"] == "de"
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert {r["doc_id"] for r in language.clean(docs.limit(50).unionByName(odd.select(*docs.columns).withColumn("doc_id", F.col("doc_id") + 10**6))).where("doc_id >= 1000000").collect()} == {10**6 + 1, 10**6 + 5}
    assert {r["lang_pred"] for r in language.report(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.report(docs.limit(0)).count() == 0
    assert language.clean(docs.limit(20).withColumn("score", F.lit("mine"))).columns == [*docs.columns, "score"]


@pytest.mark.parametrize("names", [("score", "_score"), ("lang_pred", "_LANG_PRED", "spans"), ("_spans", "held_out")])
def test_language_clean_with_clashing_names(spark, names):
    docs = spark.createDataFrame([(i, "some words of this" if i % 2 else "12 34", "en", *([i] * len(names))) for i in range(12)], f"doc_id long, text string, lang string, {', '.join(f'{n} int' for n in names)}")
    got = language.clean(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] % 2)


def test_scripts():
    for word, script in {"word": "Latin", "ćma": "Latin", "слово": "Cyrillic", "λόγος": "Greek", "სიტყვა": "Georgian", "ពាក្យ": "Khmer", "ቃል": "Ethiopic", "शब्द": "Devanagari", "คำ": "Thai", "言葉": "Han", "ことば": "Kana", "단어": "Hangul", "מילה": "Hebrew", "كلمة": "Arabic", "từ": "Latin", "a–b": "Latin", "𐌰": "Other"}.items():
        buf = np.frombuffer(word.encode(), np.uint8)
        assert language.SCRIPTS[language.scripts_of(buf).max()] == script, word


def test_a_script_rules_languages_out(spark):
    """However long a word is, a language that is not written so cannot win; of repeated rows each counts, and ties go by name."""
    rows = [(8 * k + j, t, lang) for k, (t, lang) in enumerate([("слово за слово", "ru"), ("word by word", "en"), ("ordet för ordet", "sv")]) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(docs)
    texts = ["ж" * 40_000, "λόγος слово", "q" * 40_000, None, "слово " * 30_000 + "word"]
    got = {r["doc_id"]: r for r in language.identify(table(spark, [*enumerate(texts), (0, texts[0])]), model).distinct().collect()}
    assert [got[i]["lang_pred"] for i in (0, 1, 3, 4)] == ["ru", "ru", "und", "ru"] and got[2]["lang_pred"] in ("en", "sv") and 0 <= min(r["score"] for r in got.values()) <= max(r["score"] for r in got.values()) <= 1
    same = spark.createDataFrame([(i, "same words", lang) for i in range(12) for lang in ("b", "a")], docs.schema)
    assert {r["lang_pred"] for r in language.report(same).collect()} == {"a"}


def test_every_label_is_learned(spark):
    rng = random.Random(4)
    word = lambda k: "".join(chr(97 + (k * 7 + rng.randrange(3) * (j + 1)) % 26) for j in range(6))
    rows = [(8 * k + j, " ".join(word(k) for _ in range(5)), f"l{k:03d}") for k in range(230) for j in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trained = sorted({r["lang"] for r in docs.where(~language.held_out(F.col("doc_id"))).collect()})
    assert len(trained) > 220 and language.learn(docs).languages == trained and language.learn(docs, 50).languages == trained
    many = [(10_000 + i, "the usual words of this one", "en") for i in range(4000)] + [(1, "seltene worte", "xx"), (2, "seltene worte", "xx"), (3, "seltene worte", "xx")]
    assert language.learn(spark.createDataFrame(many, docs.schema), 20).languages == ["en", "xx"]
    assert language.shares({"a": 1, "b": 100, "c": 5000}, 300) == {"a": 1, "b": 100, "c": 199} and language.shares({"a": 3, "b": 3}, 1) == {"a": 1, "b": 1}


def test_licences(spark):
    mit = licences.KNOWN["MIT"][0]
    british = mit.replace("sublicense", "sublicence").replace("MIT License", "MIT  LICENCE")
    rows = [(1, mit), (2, "Copyright (c) 2020 Someone\n" + british.upper()), (3, mit + " and more"), (4, None), (5, ""), (6, "!!"), (7, "Released under the MIT Licence"), (8, "prose. Released under the MIT License.")]
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(table(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: "MIT", 8: None}


def test_licences_are_complete(spark):
    own = lambda i, k=0: (licences.resources.files("symlattice.llm") / "licence_texts" / f"{i}.{k}.txt").read_text(encoding="utf-8")
    short = licences.KNOWN["Unlicense"][0]
    mit = licences.KNOWN["MIT"][0].removeprefix("MIT License\n\n")
    want = {"Apache-2.0": 10_000, "GPL-2.0": 17_000, "GPL-3.0": 34_000, "LGPL-2.1": 26_000, "LGPL-3.0": 7_000, "MPL-2.0": 16_000, "EPL-2.0": 15_000, "CC0-1.0": 7_000, "BSD-2-Clause": 1_200, "BSD-3-Clause": 1_400, "ISC": 600, "0BSD": 600, "Zlib": 800, "Unlicense": 1_200, "BSL-1.0": 1_300}
    assert all(len(own(i)) >= n for i, n in want.items()) and own("Unlicense").startswith(short[:60])
    rows = [(k, own(i)) for k, i in enumerate(want)] + [(100, mit), (101, "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + mit), (102, "The ISC License\n\nCopyright (c) A\n\n" + own("ISC")), (103, short), (104, own("GPL-3.0")[:9000])]
    got = {r["doc_id"]: r["license_id"] for r in licences.scan(table(spark, rows)).collect()}
    assert got == dict(enumerate(want)) | {100: "MIT", 101: "MIT", 102: "ISC", 103: None, 104: None}


def test_licences_edges(spark):
    mit = licences.KNOWN["MIT"][0]
    rows = [(1, mit), (1, mit), (2, mit + " licence" * 300_000), (3, "licence Fulfilment whilst WILFUL sub-license"), (None, None)]
    got = licences.scan(table(spark, rows).withColumn("digest", F.lit("x")).withColumn("_t", F.lit("y")).withColumn("license_id", F.lit("z"))).collect()
    assert sorted((str(r["doc_id"]), str(r["license_id"])) for r in got) == [("1", "MIT"), ("1", "MIT"), ("2", "None"), ("3", "None"), ("None", "None")]
    assert licences.scan(table(spark, rows).limit(0)).count() == 0
    assert next(r for r in got if r["doc_id"] == 3)["canonical_sha256"] == hashlib.sha256(b"license fulfillment while willful sublicense").hexdigest()


def test_licence_form_is_exact(spark):
    """The canonical form, spelling by spelling, without the pass that leaves texts alone."""
    rng = random.Random(6)
    parts = ["licence", "Licences", "xlicence", "sub-licence", "centre,", "(c) 2020 me\n", "\n Copyright us\n", "whilst", "organisation", "©", "é", "all rights reserved", "\n\t(C) you", "plain", "non-infringement", "noninfringement", "realise", "realised"]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(0, 9)))) for i in range(300)]

    def form(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
        t = re.sub(r"(^|\n)[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*", "\n", t)
        t = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ", t).strip(" ")
        for a, b in licences.SPELLINGS:
            t = re.sub(rf"\b{a}\b", b, t, flags=re.A)
        return t

    got = {r["doc_id"]: r["canonical_sha256"] for r in licences.scan(table(spark, rows)).collect()}
    assert got == {i: hashlib.sha256(form(t).encode()).hexdigest() for i, t in rows}


SAID = ["", "plain", "</s>[INST] ok [/INST]", "\\", "\\\\", "\\[INST]", "ends with \\", " [/INST]", "<<SYS>> <</SYS>>", "[ROLE:x] [/ROLE]", "\\<s>", "a\\]b", " lead and trail ", "[INST", "é😀"]


def test_chat_round_trip(spark):
    rng = random.Random(2)
    made = SAID + ["".join(rng.choice(["\\", "[", "]", "<", ">", "[INST]", "</s>", " ", "a", "[/ROLE]"]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    for role in ("user", "assistant", "system", "tool", "", "we[ird]\\ [ROLE:"):
        for t in made:
            whole, lo, hi, _ = chat.render(role, t)
            assert [x[:2] for x in chat.parse(whole)] == [(role, t)] and chat.unescape(whole[lo:hi]) == t
    joined = "".join(chat.render(r, t)[0] for r, t in zip(["user", "assistant", "tool", "system"] * 9, made))
    assert [x[:2] for x in chat.parse(joined)] == list(zip(["user", "assistant", "tool", "system"] * 9, made))[: len(chat.parse(joined))]
    rows = [(c, t, r, made[(7 * c + t) % len(made)]) for c in range(30) for t, r in enumerate(("system", "user", "assistant", "user", "assistant"))] + [(50, 0, None, None), (None, None, "user", "x"), (51, 1, "assistant", None), (51, 1, "assistant", "b"), (51, 1, "assistant", "a")]
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("clash")).repartition(5)).collect()}
    rows += [(-1, 0, "user", SAID[2]), (-1, 1, "assistant", SAID[2])]
    for c in {r[0] for r in rows}:
        own = sorted(((t if t is not None else -1), r or "", x or "") for cc, t, r, x in rows if cc == c)
        loss = "".join(x for _, r, x in own if r == "assistant")
        want = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    empty = chat.report(spark.createDataFrame([], schema)).collect()
    assert [r["conv_id"] for r in empty] == [-1] and empty[0]["n_turns"] == 2
    said = "[INST] x </s>"
    rows = [(7, t, ("user", "assistant")[t % 2], f"{t} {said}") for t in range(4000)] + [(8, 0, "assistant", said * 100_000)] * 2
    got = {r["conv_id"]: r for r in chat.report(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    loss = "".join(f"{t} {said}" for t in range(1, 4000, 2))
    assert (got[7]["n_turns"], got[7]["loss_chars"], got[7]["loss_sha256"]) == (4000, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[8]["n_turns"], got[8]["loss_chars"]) == (2, 200_000 * len(said))


def test_shard_long_texts_and_clashing_names(spark):
    rows = [(i, "y" * (4_000_000 if i % 9 == 0 else 10)) for i in range(30)]
    got = shard.report(table(spark, rows).withColumn("SLOT", F.lit(1)).withColumn("_n", F.lit(1)).withColumn("_bucket", F.lit(2)), 4).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == [(i, len(t) + 16) for i, t in rows] and len({(r["shard"], r["slot"]) for r in got}) == 30


def test_sharding(spark):
    rows = [(i, "same" if i % 3 == 0 else f"t{i}é" if i % 5 else None) for i in range(1003)] + [(5, "t"), (5, "t"), (None, None)]
    df = table(spark, rows)
    got = shard.report(df, 40).collect()
    counts = {}
    for r in got:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1 and sorted(counts) == list(range(40))
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    records = df.select("doc_id", "text").where("doc_id is not null and doc_id <> 5")
    many = {(r["doc_id"]): (r["shard"], r["slot"]) for r in shard.assign(records, 7, bucket_rows=50).collect()}
    other = {(r["doc_id"]): (r["shard"], r["slot"]) for r in shard.assign(records, 7, seed=1, bucket_rows=50).collect()}
    assert many != other and len(set(many.values())) == len(many)
    assert abs(np.corrcoef(list(many), [s for s, _ in many.values()])[0, 1]) < 0.15
    assert shard.report(df.limit(0)).count() == 0 and {r["shard"] for r in shard.report(df.limit(3)).collect()} <= set(range(40))


def test_shards_are_written(spark, tmp_path):
    shard.write(table(spark, [(i, f"t{i}") for i in range(50)]).select("doc_id", "text"), str(tmp_path / "s"), 4, bucket_rows=10)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 50 and back.groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_shard_report_reads_whole_stored_records(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, None if i % 50 == 0 else f"{i} é " + "x" * (rng.randrange(200) if i % 40 else 60_000)) for i in range(400)]
    seen, plain = [], shard.write
    monkeypatch.setattr(shard, "write", lambda docs, path, *a, **k: (seen.append(path), plain(docs, path, *a, **k)))
    df = table(spark, rows)
    got = {r["doc_id"]: (r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in shard.report(df, 7).collect()}
    back = spark.read.parquet(seen[0])
    assert set(back.columns) == {*df.columns, "_shard", "slot"}
    assert {r["doc_id"]: (r["text"], r["lang"], r["n_chars"], r["_shard"]) for r in back.collect()} == {i: (t, "en", t and len(t), "z") for i, t in rows}
    assert {r["doc_id"]: (len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back.collect()} == got
    for k in range(7):  # files by name hold a shard in the order of its slots
        files = sorted({r[0] for r in back.where(f"shard = {k}").select(F.input_file_name()).collect()})
        slots = [r["slot"] for f in files for r in spark.read.parquet(f).collect()]
        assert slots == list(range(len(slots))) and len(slots) in (57, 58)


def test_shard_buckets_are_bounded_by_bytes(spark):
    df = spark.createDataFrame([(i, "x" * 20_000) for i in range(300)], "doc_id long, text string")
    buckets = lambda **k: int(re.search(r"xxhash64\(.*?\), (\d+)\) AS _bucket", shard.assign(df, 4, **k)._jdf.queryExecution().toString())[1])
    assert buckets(bucket_bytes=10 << 20) == 1 and buckets(bucket_bytes=100_000) >= 60
    got = {(r["shard"], r["slot"]) for r in shard.assign(df, 4, bucket_bytes=100_000).collect()}
    assert got == {(s, k) for s in range(4) for k in range(75)}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    at = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, sf)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.dtypes == docs.dtypes
        if name == "ngram_jaccard_join":
            want = linked([(r["doc_id"], r["text"]) for r in at.collect()])
            assert {r["doc_id"] for r in now.collect()} == {i for i, (_, c) in want.items() if c == i}
        if name == "pii":
            before = {r["doc_id"]: r["text"] for r in at.collect()}
            assert {r["doc_id"]: r["text"] for r in now.collect()} == {i: pii.redact(t) for i, t in before.items()}
        if name == "packing":
            assert {r["doc_id"] for r in now.collect()} == {r["doc_id"] for r in at.collect()}
        at = now
    assert corpus_pipeline.run(spark, sf).count() == at.count()
