"""Collocations, token alignment and sketched near duplicates against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import alignment, phrases, sketches

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


# Token alignment

TEXTS = [None, "", " ", "a  b\n c\n\n d <|endoftext|> <s> <0x0A>", "x \u2581y", "日本語 テスト  \u3000 é\x1c z", "  a \x85 b", "it's don't  ", "the cat, the dog. The END", "the cat, the dog. The END", "word " * 5000, "ab" * 20_000]


def told(texts):
    """Rows by both libraries over whole texts."""
    u = alignment.Units(*map(alignment.vocabulary, (alignment.FILE_A, alignment.FILE_B)))
    links, counts = [], Counter()
    for t in texts:
        a = u.a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = u.b.encode(t) if t else []
        whole = f" {t}".encode()
        if not t or b"".join(u.bytes_a[i] for i in a) != whole or b"".join(u.bytes_b[i] for i in b) != whole:
            links.append((0, 0, [], ""))
            continue
        ends = [dict(zip(np.cumsum([len(of[i]) for i in x]).tolist(), x)) for x, of in ((a, u.bytes_a), (b, u.bytes_b))]
        cuts, said, start = sorted(ends[0].keys() & ends[1].keys()), [], 0
        for c in cuts:
            said.append("|".join(",".join(str(i) for e, i in x.items() if start < e <= c) for x in ends) if len(cuts) < 100 else "")
            start = c
        pairs = [(ends[0][c], ends[1][c]) for c in cuts]
        counts.update(pairs)
        links.append((len(a), len(b), pairs, hashlib.sha256(";".join(said).encode()).hexdigest() if len(cuts) < 100 else None))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [(a, b, len(p), len(p), sum(counts[x] == top[x[1]] for x in p), sum(counts[x] for x in p), s) for a, b, p, s in links], counts, top


def test_alignment_matches_whole_texts(spark):
    rows = docs_of(spark, [(i, t, "en") for i, t in enumerate(TEXTS)]).repartition(3).withColumn("n_a", F.lit("clash")).withColumn("run", F.lit(1))
    want, counts, top = told(TEXTS)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.aligned(rows).collect()}
    assert len(got) == len(TEXTS)
    for i, w in enumerate(want):
        assert got[i][:6] == w[:6] and (w[6] is None or got[i][6] == w[6]), (i, got[i], w)
    found = alignment.pairs(rows).collect()
    assert {(r.a, r.b): (r["count"], r.best) for r in found} == {p: (n, n == top[p[1]]) for p, n in counts.items()}
    said = {r.doc_id: r.groups for r in alignment.groups(rows).collect()}
    assert all(hashlib.sha256(said[i].encode()).hexdigest() == got[i][6] if said[i] else got[i][6] == "" for i in got)


def test_alignment_of_many_small_runs(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN", 50)
    monkeypatch.setattr(alignment, "FLUSH", 7)
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["the", "cat's", "réel,", "x1", "END."]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    u = alignment.units(alignment.FILE_A, alignment.FILE_B)
    heads, sums = [], []
    for a in range(0, 60, 7):
        p, _, t = alignment._records(u, u.encoded(texts[a : a + 7]))
        n = Counter()
        for x, k in zip(p.tolist(), t.tolist()):
            n[x] += k
        heads.append(np.array(sorted(n))), sums.append(np.array([n[x] for x in sorted(n)]))
    got = {}
    for p, n, top, slices, at in alignment.merged(heads, sums, u.size_a):
        got |= {x: (c, b) for x, c, b in zip(p.tolist(), n.tolist(), top.tolist())}
        assert len(at) == sum(b - a for _, a, b in slices)
    _, counts, top = told(texts)
    assert got == {b * u.size_a + a: (n, n == top[b]) for (a, b), n in counts.items()}


def test_alignment_empty_table_and_null_ids(spark):
    assert alignment.aligned(docs_of(spark, [])).count() == 0
    got = alignment.aligned(docs_of(spark, [(None, "ab cd", None), (None, "ab cd", None)])).collect()
    assert [r.doc_id for r in got] == [None, None] and got[0].count_sum == got[1].count_sum > 0


def test_packed_columns_come_back():
    for x in (np.zeros(0, np.int64), np.array([0]), np.arange(300), np.array([1, 1 << 40, 3])):
        assert alignment._unpacked(alignment._packed(x)).tolist() == x.tolist()


# Collocations


def brute(rows, least, top=2000, share=80):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, of in f.items():
        cands = {p: a for p, a in of.items() if a >= least and " " in p}
        rows_ = []
        for p, a in cands.items():
            w = p.split(" ")
            score, k = min((2_000_000 * a // (of[" ".join(w[:k])] + of[" ".join(w[k:])]), k) for k in range(1, len(w)))
            if not any(len(q.split(" ")) > len(w) and f" {p} " in f" {q} " and 100 * b >= share * a for q, b in cands.items()):
                rows_.append((p, a, of[" ".join(w[:k])], of[" ".join(w[k:])], score))
        rows_.sort(key=lambda r: (-r[4], -r[1], r[0].encode()))
        out += [(lang, i, p, a, x, y, n[lang], s) for i, (p, a, x, y, s) in enumerate(rows_[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("bits", [26, 4])
def test_collocations_match_brute_force(spark, bits):
    """Also with a filter of 16 places, which is full and cuts nothing."""
    rng = random.Random(8)
    words = ["Of", "the", "in", "order", "to", "état", "of\u00a0x", "x\ty", "a"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", "!"]) for _ in range(n))
    boiler = "all rights reserved by the one true owner of this long passage of many words"
    rows = [(i, text(rng.randint(0, 60)) + (f" {boiler}" if i % 2 else ""), rng.choice(["en", "de", None])) for i in range(80)]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "...", "fr"), (1003, "the the the the the the", "en"), (None, "in order to", "en"), (None, "in order to", "en"), (1004, "w " * 3000, "en")]
    df = docs_of(spark, rows).repartition(3).withColumn("rank", F.lit(1)).withColumn("phrase", F.lit("clash"))
    got = sorted(tuple(r) for r in phrases.collocations(df, least=8, bits=bits).collect())
    assert got == brute(rows, 8)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=8, top=3, bits=bits).collect()) == brute(rows, 8, top=3)


def test_rare_grams_that_share_places_are_cut(spark):
    """16,000 rare grams, four times each, in 16,384 places, of which most that have any get eight; 3,568 were left before the second filter."""
    rare = " ".join(f"w{i}" for i in range(4000))
    rows = [(i, f"{rare}. in order to go" if i < 4 else "in order to go", "en") for i in range(10)]
    got = {(r.gram, r.n) for r in phrases.graph(docs_of(spark, rows).repartition(2), least=8, bits=14).collect()}
    assert {x for x in got if x[0].startswith("in ")} == {("in order to go", 10)}
    assert sum(n for g, n in got) == 4 * 4000 + 10 * 4
    assert len(got) < 1000, len(got)


def test_a_task_sends_blocks_of_grams(monkeypatch):
    """Rows between count and sum depend on the parts, not on the grams."""
    monkeypatch.setattr(phrases, "PARTS", 8)
    rng, want, blocks = random.Random(5), Counter(), []
    for _ in range(3):
        grams = Counter({f"w{rng.randrange(9000)} état\u00a0\x00".encode(): rng.randint(1, 1 << 40) for _ in range(5000)} | {b"": 7})
        want.update(grams)
        own = list(phrases._blocks("en", grams))
        assert len(own) <= 8
        blocks += own
    blocks.sort(key=lambda b: b["part"])
    cut = len(blocks) // 2
    got = list(phrases._summed(iter([pa.RecordBatch.from_pylist(x, phrases._BLOCK) for x in (blocks[:cut], blocks[cut:])])))
    told = [(r["gram"].encode(), r["n"]) for b in got for r in b.to_pylist()]
    assert len(got) == len({b["part"] for b in blocks}) and len(told) == len(dict(told)) and dict(told) == want


def test_paths_hold_each_edge_once(spark):
    rng = random.Random(9)
    grams = Counter()
    for _ in range(12):
        w = [rng.choice("abcdefgh") for _ in range(9)] if rng.random() < 0.5 else list("mnopqrstuvwx")
        grams.update(tuple(w[i : i + 4]) for i in range(len(w) - 3))
    grams.update({("r", "i", "n", "g"): 2, ("i", "n", "g", "r"): 2, ("n", "g", "r", "i"): 2, ("g", "r", "i", "n"): 2})
    edges = spark.createDataFrame([("en", " ".join(g), n) for g, n in grams.items()], "lang string, gram string, n long")
    got, longest = Counter(), 0
    for r in phrases.paths(edges).collect():
        longest = max(longest, len(r.words))
        for i in range(len(r.words) - 3):
            assert tuple(r.words[i : i + 4]) not in got
            got[tuple(r.words[i : i + 4])] = r.n
    assert got == grams and longest >= 12


def test_long_texts_are_cut_at_ends_of_pieces(monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK", 50)
    text = "some words here, and. " * 40 + "no end " * 30
    parts = list(phrases._stretches(text))
    assert "".join(parts) == text and len(parts) > 5 and all(re.search("[.,;:!?\n-\r]$", p) for p in parts[:-1])


def test_collocations_of_nothing(spark):
    assert phrases.collocations(docs_of(spark, [])).count() == 0
    assert phrases.collocations(docs_of(spark, [(1, None, None), (2, "one two", "en")])).count() == 0


# Sketched near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} - {()}


def by_brute_force(rows):
    sets = [shingles(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d if d is not None else -1, len(sets[i]), least.get(find(i), -1)) for i, (d, _, _) in enumerate(rows))


def near_rows():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("bcdfghklm") + rng.choice("aeiou") for _ in range(rng.randint(1, 3)))
    rows, common = [], " ".join(word() for _ in range(30))
    for g in range(40):
        base = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.choice([1, 1, 2, 3, 90 if g == 5 else 4])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = word().upper()
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(w) + (f"\n{common}" if g % 3 == 0 else ""), "en"))
    rows += [(2001, None, "en"), (2002, "", "en"), (2003, " \t\n", None), (2004, "One", None), (2005, "one", None), (2006, "one two", None), (2007, "x" * 100_000, None), (2007, "x" * 100_000, None), (None, rows[3][1], None), (None, "nobody else has this text", None), (2008, "long " * 40_000, None)]
    return rows


def test_sketches_match_brute_force(spark):
    rows = near_rows()
    df = docs_of(spark, rows).withColumn("node", F.lit("clash")).withColumn("n_shingles", F.lit(0))
    got = sketches.components_of(df, small=8).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in got) == by_brute_force(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sketches_fill_and_agree_like_the_sets():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 100, 5000):
        sets, shares = [], []
        for _ in range(40):
            own = np.unique(rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
            sets += [own[: -(-len(own) * 9 // 10)], own[len(own) // 10 :]]
        sketch = sketches.sketches([np.sort(s) for s in sets])
        assert (sketch != np.iinfo(np.uint64).max).all()
        for i in range(0, len(sets), 2):
            a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
            shares.append((sketch[i] == sketch[i + 1]).mean() - len(a & b) / len(a | b))
        assert abs(np.mean(shares)) < 0.05 and (n < 5 or np.abs(shares).max() < 0.25)


def test_words_hash_alike_wherever_they_stand():
    long = "z" * 9000
    one = list(sketches.shingle_sets([f"a {long} b", "x", None]))
    two = list(sketches.shingle_sets(["pad " * 100, f"A\t{long}  b", *["fill in with words"] * 100]))
    assert one[0].tolist() == two[1].tolist() and len(one[1]) == 1 and len(one[2]) == 0


def test_sketches_of_an_empty_table(spark):
    assert sketches.components_of(docs_of(spark, [])).count() == 0
