"""The training-data operators against brute force, round trips and held-out accuracy, and their edge cases."""

import itertools
import json
import os
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import decontaminate, fixity, jaccard, langid, licences, mixing, neighbours, queries, tokens, toxicity, urls
from quire.llm.shingles import components, shingle_sets

SF = "/root/testdata/sf0.001"
WORDS = {"xx": "the of and to in is that for was with".split(), "yy": "der die und das ist von mit nicht ein auf".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "ing", "er", "st"]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    return [(i, sentence(rng, lang, rng.randint(30, 80)), lang, f"s{i % 3}") for i, lang in enumerate(["xx", "yy"] * 60)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


ODD = [(900, None, "xx", "s0"), (901, "", "xx", None), (902, "1234 !!", None, "s1"), (903, "ok", "yy", "s1"), (903, "ok", "yy", "s1"), (None, "some text without any id at all here", None, None), (904, "word " * 30_000, "xx", "s2")]


# Language identification


def test_langid_held_out_and_odd_rows(spark, corpus):
    docs = frame(spark, corpus + ODD).withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit(1))
    model = langid.train(langid.train_rows(frame(spark, corpus)))
    got = {(r.doc_id, i): r for i, r in enumerate(langid.predicted(docs, model).collect())}
    assert len(got) == len(corpus) + len(ODD)
    truth = {i: lang for i, _, lang, _ in corpus}
    assert all(r.lang_pred == truth[r.doc_id] for r in got.values() if r.doc_id in truth)
    assert [r.lang_pred for r in got.values() if r.doc_id in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.where("doc_id IN (900, 901, 902)").count() == 0
    assert kept.where("doc_id < 900").count() == len(corpus)


def test_langid_hits_match_sets(corpus):
    """Popcounts of the bit-sliced filter are those of exact sets, but for false positives."""
    model = langid.Model(["a", "b"], [1, 1], 20)
    texts = [corpus[0][1], corpus[1][1]]
    pieces, owner = langid._pieces(texts)
    slots, exact = np.zeros(1 << 20, np.uint8), [set(), set()]
    for piece, h in langid._grams(pieces)[1]:
        for i in (0, 1):
            own = h[owner[piece] == i]
            exact[i].update(own.tolist())
            for s in langid._slots(own, 20):
                slots[s.astype(np.int64)] |= np.uint8(1 << i)
    model.slots = [slots]
    for piece, h in langid._grams(pieces)[1]:
        hits = langid._hits(model, owner[piece], h, 2)
        for i, lang in itertools.product((0, 1), (0, 1)):
            true = sum(x in exact[lang] for x in h[owner[piece] == i].tolist())
            assert true <= hits[i, lang] <= true + 2


def test_langid_long_text_is_judged_whole(corpus):
    model = langid.Model([], [], 20)
    assert langid.judge(model, ["x", None])[0] == ["und", "und"]
    pieces, _ = langid._pieces(["ab cd " * 200_000])
    whole = sum(len(h) for _, h in langid._grams(pieces)[1])
    one = sum(len(h) for _, h in langid._grams([" " + "ab cd " * 200_000 + langid.PAD])[1])
    assert len(pieces) > 1 and whole == one


def test_langid_empty_table(spark):
    empty = frame(spark, [])
    assert langid.predicted(empty, langid.train(empty)).count() == 0


def test_language_query_matches_exact_sets(spark):
    """The registered query against sets of n-grams in place of filters: the same rows, coverages within the filters' error."""
    got = {r.doc_id: r for r in queries.op1_language_bitmasks(spark, SF).collect()}
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert len(got) == len(docs)

    def grams(text):
        padded = [c if c.isalpha() else "" for c in f" {(text or '').lower()}  "]
        out = []
        for n in (3, 4):  # starts are those of three-grams with a fourth character behind
            for i in range(len(padded) - 3):
                g = padded[i : i + n]
                if not any(a == b == "" for a, b in zip(g, g[1:])):
                    out.append((n, *g))
        return out

    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    train = [(t, lang) for i, t, lang in docs if i not in held and t is not None and lang is not None]
    of, n_docs = defaultdict(Counter), Counter(lang for _, lang in train)
    for text, lang in train:
        of[lang].update(set(grams(text)))
    langs = sorted(n_docs, key=lambda x: (-n_docs[x], x))
    rate = {x: {g: n / n_docs[x] for g, n in of[x].items() if n >= min(2, n_docs[x])} for x in langs}
    top = Counter()
    for x in langs:
        for g, r in rate[x].items():
            top[g] = max(top[g], r)
    sets = {x: {g for g, r in rate[x].items() if r >= 0.005 and r >= 0.2 * top[g]} for x in langs}
    for i, text, _ in docs:
        r, all_grams = got[i], grams(text)
        assert r.held_out == (i in held)
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        share = {x: sum(g in sets[x] for g in all_grams) / max(1, len(all_grams)) for x in langs}
        best = max(langs, key=lambda x: share[x])
        error = 0.02 + 2 / len(all_grams)  # false positives of the filters, of which one counts in a short text
        assert abs(r.coverage - share[best]) < error and (r.lang_pred == best or share[best] - share[r.lang_pred] < error)
        assert len(all_grams) < 50 or abs(r.score - share[r.lang_pred] ** 4 / max(1e-300, sum(s**4 for s in share.values()))) < 0.1


def test_language_ties_go_to_the_larger_then_the_smaller_name(spark):
    rows = [(i, "abcde fghij klmno", lang, "s") for i, lang in enumerate(["bb", "aa", "cc", "cc"])]
    model = langid.train(frame(spark, rows))
    assert {r.lang_pred for r in langid.predicted(frame(spark, rows), model).collect()} == {"cc"}
    assert {r.lang_pred for r in langid.predicted(frame(spark, rows), langid.train(frame(spark, rows[:3]))).collect()} == {"aa"}


# Decontamination


def levenshtein_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_edit_distance_is_exact():
    rng = random.Random(1)
    for _ in range(200):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 20)))
        b = "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))
        assert decontaminate.distance(a, b, 99) == levenshtein_in(a, b)


def test_decontamination_finds_planted_items_and_only_those(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    vocabulary = [word() for _ in range(3000)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([8, 20, 45, 90])))) for i in range(60)] + [(60, None), (61, "qq zz"), (62, "")]
    docs, truth = [], set()
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(50, 300))]
        if d % 2:
            i = rng.randrange(60)
            w = items[i][1].split()
            if d % 4 == 1:  # a word in fifteen is edited
                for _ in range(max(1, len(w) // 15)):
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = w
            truth.add((d, i))
        docs.append((d, " ".join(words), None, None))
    rows = decontaminate.contaminated(frame(spark, docs + ODD), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in rows.collect()}
    exact = {(d, i) for d, i in truth if items[i][1] in docs[d][1]}
    assert exact <= got and got <= truth and len(got) >= 0.9 * len(truth)
    two = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), most_items=25).collect()}
    assert two == got
    kept = decontaminate.keep_clean(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == set(range(120)) - {d for d, _ in got}


def edited(rng, text, kind, rate, vocabulary):
    if kind == "words":
        return " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in text.split())
    out = []
    for c in text:
        k = rng.random() / rate
        out.append(c if k >= 1 else rng.choice("abcdefghijklmnopqrstuvwxyz") if k < 1 / 3 else "" if k < 2 / 3 else c + rng.choice("aeiou"))
    return "".join(out)


@pytest.mark.parametrize("n_words", [8, 20, 45, 90])
def test_decontamination_recall_at_each_edit_rate(n_words):
    """Of the passages that the exact verification would accept, the search finds nine in ten at least, at each edit rate."""
    rng = random.Random(n_words)
    vocabulary = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for kind, rate in [*(("words", 1 / n) for n in (20, 10, 7, 5)), *(("characters", x) for x in (0.05, 0.1, 0.15))]:
        items = [(i, " ".join(draw(n_words))) for i in range(60)]
        texts = [" ".join([*draw(60), edited(rng, t, kind, rate, vocabulary), *draw(60)]) for _, t in items]
        near = {(i, i) for i, t in items if decontaminate.distance(t, texts[i], 1 << 20) <= int(0.2 * len(t))}
        found = {(t, i) for t, i, *_ in decontaminate.matches(decontaminate.prepare(items, decontaminate.walks_for(0.96)), texts, 0.2)}
        assert found <= near and len(found) >= 0.9 * len(near), (kind, rate, len(found), len(near))


def test_decontamination_searches_whole_items():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, items = [], []
    for i in range(60):
        n, edited, part = ((63, 9, 32), (200, 30, 64), (63, 10, 0), (400, 64, 64))[i % 4]
        w = draw(n)
        items.append((i, " ".join(w)))
        if part:  # words of the opening are edited
            for k in rng.sample(range(part), edited):
                w[k] = rng.choice(vocabulary)
        else:  # the opening is cut off
            w = w[edited:]
        texts.append(" ".join(draw(90) + w + draw(40)))
    near = [i for i, t in items if decontaminate.distance(t, texts[i], 1 << 20) <= int(0.2 * len(t))]
    assert len(near) >= 50
    found = {(t, i) for t, i, *_ in decontaminate.matches(decontaminate.prepare(items, decontaminate.walks_for(0.96)), texts, 0.2)}
    assert found <= {(i, i) for i in near} and len(found) >= 0.99 * len(near)


def run_within(item, words, most):
    """Whether a run of whole words is at most so many character edits from a short item."""

    def edits(x, y):
        row = list(range(len(y) + 1))
        for i, a in enumerate(x, 1):
            row, old = [i], row
            for j, b in enumerate(y, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (a != b)))
        return row[-1]

    runs_ = (" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, min(len(words), i + len(item)) + 1))
    return any(abs(len(r) - len(item)) <= most and edits(item, r) <= most for r in runs_)


def test_decontamination_finds_short_items_with_edits():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for rate in (0.05, 0.1, 0.2):
        items = list(enumerate(t for t in (" ".join(draw(rng.randint(1, 3))) for _ in range(90)) if 5 <= len(t) < 20))
        texts = [" ".join([*draw(40), edited(rng, t, "characters", rate, vocabulary), *draw(40)]) for _, t in items]
        found = {(t, i) for t, i, *_ in decontaminate.matches(decontaminate.prepare(items, 5), texts, 0.2)}
        assert found == {(k, i) for k, x in enumerate(texts) for i, t in items if run_within(t, x.split(), int(0.2 * len(t)))}


def test_decontamination_of_scripts_without_spaces():
    rng = random.Random(22)
    said = {"ja": "これは日本語の評価問題です次の文章を読んで正しい答えを選びなさい", "zh": "下列关于机器学习的说法中哪一项是正确的请选择最合适的答案", "th": "กรุณาเลือกคำตอบที่ถูกต้องที่สุดจากตัวเลือกต่อไปนี้", "short": "東京都庁舎"}
    other = "".join(chr(rng.randrange(0x3042, 0x3090)) for _ in range(500))
    known = decontaminate.prepare(list(said.items()), decontaminate.walks_for(0.96))
    for name, t in said.items():
        for x in (t, t[:3] + "の" + t[4:], t[:-2] + t[-1]):
            assert [known.ids[i] for _, i, *_ in decontaminate.matches(known, [other + x + other], 0.2)] == [name]
    assert not list(decontaminate.matches(known, [other, None, "", "a b c"], 0.2))


def test_decontamination_finds_what_brute_force_finds():
    rng = random.Random(14)
    vocabulary = ["".join(rng.choice("bdgklmnrst") + rng.choice("aeiouä") for _ in range(rng.randint(1, 3))) for _ in range(300)]
    draw = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, draw(rng.choice([6, 12, 30]))) for i in range(25)] + [(25, "one, two"), (26, "漢字 " * 30), (27, "...")]
    texts = [draw(40) + " " + edited(rng, rng.choice(items)[1], "characters", 0.06, vocabulary) + " " + draw(30) for _ in range(40)] + ["x ONE  two y", "onetwo", "one", None, "", "漢字 " * 40]
    words = lambda t: " ".join(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()))
    want = {(t, i) for t, x in enumerate(texts) for i, y in items if len(words(y)) >= 20 and decontaminate.distance(words(y), words(x), 1 << 20) <= int(0.2 * len(words(y)))}
    want |= {(t, i) for t, x in enumerate(texts) for i, y in items if 0 < len(words(y)) < 20 and run_within(words(y), words(x).split(), int(0.2 * len(words(y))))}
    found = {(t, i) for t, i, *_ in decontaminate.matches(decontaminate.prepare(items, decontaminate.walks_for(0.96)), texts, 0.2)}
    assert found <= want and len(found) >= 0.95 * len(want) and {(40, 25), (45, 26)} <= found


def test_passage_distances_of_many_rows_are_exact():
    rng = random.Random(15)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 64))), "".join(rng.choice("abc") for _ in range(76))) for _ in range(300)]
    pad = lambda t, n: list(t.encode().ljust(n))
    got = decontaminate.nearest_passages(np.array([pad(a, 64) for a, _ in rows], np.uint8), np.array([len(a) for a, _ in rows]), np.array([pad(b, 76) for _, b in rows], np.uint8))
    assert got.tolist() == [levenshtein_in(a, b) for a, b in rows]


@pytest.mark.parametrize("kind", ["int", "long", "string"])
def test_decontamination_keeps_the_type_of_ids(spark, kind):
    text = "a passage of the benchmark that a document quotes, word by word, and then some more"
    items = spark.createDataFrame([(7, text), (7, text)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    rows = decontaminate.contaminated(frame(spark, [(1, "x " * 200_000 + text, None, None)] * 2), items)
    assert dict(rows.dtypes)["item_id"] == {"long": "bigint"}.get(kind, kind)
    assert [(r.doc_id, int(r.item_id), r.first_word, r.n_edits) for r in rows.collect()] == [(1, 7, 200_000, 0)] * 4


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(frame(spark, ODD), none).count() == 0
    assert decontaminate.keep_clean(frame(spark, ODD), none).count() == len(ODD)


# Licences


def test_licence_rules_are_ordered(spark):
    grant = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
    rows = [(1, f"x.\n{licences.SENTENCES['mit_short']}.\ny", None, None), (2, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", None, None), (3, "nothing", None, None), (4, "All rights reserved.\nLicensed under CC BY 4.0.", None, None)]
    got = {r.doc_id: (r.licences, r.left_over) for r in licences.scanned(frame(spark, rows + ODD)).collect()}
    assert got == {1: ("MIT", ""), 2: ("Apache-2.0,MIT", ""), 4: ("CC-BY-4.0", "reserved")}
    assert "apache" in grant.lower()


NOTICES = {
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU Lesser General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "GPL-2.0": "SPDX-License-Identifier: GPL-2.0-only",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.""",
}


def test_licence_notices_as_published(spark):
    rows, want = [], {}
    for licence, notice in NOTICES.items():
        for width, mark, end in ((72, "", "\n"), (80, " * ", "\n"), (60, "# ", "\r\n"), (10_000, "", "\n"), (33, "//" + " " * 60, "\n")):
            lines = [line for part in notice.split("\n") for line in textwrap.wrap(part, width, break_long_words=False) or [""]]
            want[len(rows)] = (licence, "")
            rows.append((len(rows), end.join(["x = 1", "Copyright 2024 The Authors", "", *lines, "", "def f():", "    pass"]).replace(end, end + mark), None, None))
    for text in ("Licensed under the Apache License. Version 2.0.", "not licensed under the MIT License", "Licensed under the MIT License 2", "unlicensed under the mit license"):
        rows.append((len(rows), text, None, None))
    rows.append((len(rows), "EB.\nLicensed under the\n\nMIT License", None, None))
    want[len(rows) - 1] = ("MIT", "")
    rows += [(len(rows), None, None, None), (len(rows) + 1, "", None, None), (len(rows) + 2, "word " * 50_000 + ".\nReleased under the MIT License.\nAll rights reserved", None, None)]
    want[len(rows) - 1] = ("MIT", "reserved")
    scanned = licences.scanned(frame(spark, rows))
    assert {r.doc_id: (r.licences, r.left_over) for r in scanned.collect()} == want
    assert licences.scanned(frame(spark, [])).count() == 0
    # The SQL finds the same, in wrapped notices too.
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})  # noqa: F841  read by name
    relation = duckdb.sql(licences.sql())
    at = [relation.columns.index(c) for c in scanned.columns]
    assert sorted(tuple(r) for r in scanned.collect()) == sorted(tuple(r[i] for i in at) for r in relation.fetchall())


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), volume=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = {}, volume * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s] + 1e-9}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix_targets_and_takings(spark, corpus):
    rows = corpus + ODD
    docs = frame(spark, rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += size(t)
    want = brute_targets(sizes)
    got = mixing.mixed(docs).collect()
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.mix_size
        assert r.mix_source_size == sizes[r.source] and abs(r.mix_target - want[r.source]) < 1e-6
    largest = max(size(t) for _, t, _, _ in rows)
    assert all(abs(by[s] - want[s]) <= largest / 2 + 1 for s in want)
    assert max(Counter(r.doc_id for r in got if r.doc_id not in (903, None)).values()) <= 2
    assert {r.mix_shard for r in got} <= set(range(16))
    digest = mixing.taken(docs).collect()
    assert sum(r.taken for r in digest) == sum(by.values()) and all(r.taken == len(r.shards) * r.size <= 2 * r.size for r in digest)
    assert sorted((r.doc_id, s) for r in digest if r.doc_id is not None for s in r.shards) == sorted((r.doc_id, r.mix_shard) for r in got if r.doc_id is not None)
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_mix_follows_the_splitting_tree(spark, corpus):
    """A shard's rows are those whose blocks' draws are in its runs: so many blocks of each source as the tree deals to it."""
    docs = frame(spark, corpus)
    rows = mixing._rows(docs, "doc_id", "text", "source", 7, ["doc_id"])
    blocks = mixing._blocks(rows, (5, 2, 1), 1.5, 2.0, 16, 7).collect()
    drawn = Counter((b._source, s) for b in blocks for s in b.shards)
    quotas = Counter()
    for b in blocks:
        quotas[b._source] += len(b.shards)
    tree = mixing._quota_tree(spark.createDataFrame(list(quotas.items()), "source string, draws long"), 16, 7)
    assert {(r.source, r.shard): r.draws for r in tree.where("draws > 0").collect()} == drawn
    assert all(sum(1 for b in blocks if b._source == s and b.cut) <= 1 for s in quotas)


def test_mix_of_clashing_columns_and_reruns(spark, corpus):
    """Reruns agree whatever the partitions, with repeated and null ids; any column names are carried."""
    rows = corpus[:60] + ODD + [(None, f"text {i} of a row without an id", None, "s1") for i in range(40)] + [(5, f"another text {i} of one id", "xx", "s0") for i in range(40)]
    docs = frame(spark, rows).withColumn("mix_copy", F.lit("a")).withColumn("_note", F.lit("b")).withColumn("size", F.lit("c"))
    results, takings = set(), set()
    for n in (1, 3, 5, 7):
        mix = mixing.mixed(docs.repartition(n))
        assert mix.columns[: len(docs.columns)] == docs.columns and len(set(mix.columns)) == len(mix.columns)
        results.add(repr(sorted(map(repr, mix.collect()))))
        takings.add(repr(sorted(map(repr, mixing.taken(docs.repartition(n)).collect()))))
    assert len(results) == len(takings) == 1


def test_takings_have_a_row_for_each_row(spark):
    rows = [(1, "a b c", None, "s0"), (1, "a b c", None, "s0"), (1, "d e f g h i", None, "s1"), (None, "a b", None, "s0"), (None, "c", None, "s0"), (None, "d", None, None)]
    rows += [(2, "x y z", None, "s2"), (2, "u v w", None, "s3")] * 2
    got = mixing.taken(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, len(t.split())) for i, t, *_ in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got)


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"a": 100, "b": 7, None: 33}
    rows = mixing._quota_tree(spark.createDataFrame(list(quotas.items()), "source string, draws long"), 6, 3).collect()
    sums, shards = Counter(), Counter()
    for r in rows:
        sums[r.source] += r.draws
        shards[r.shard] += r.draws
    assert dict(sums) == quotas and max(shards.values()) - min(shards.values()) <= 2


# Toxicity


def brute_segments(s):
    """Every segment whose proper prefixes and suffixes all sum to more than 0 and that can't be extended."""
    n, good = len(s), []
    for a, b in itertools.combinations(range(n + 1), 2):
        sums = list(itertools.accumulate(s[a:b]))
        if all(x > 0 for x in sums) and all(sums[-1] - x > 0 for x in sums[:-1]):
            good.append((a, b))
    return {(a, b) for a, b in good if not any(c <= a and b <= d and (c, d) != (a, b) for c, d in good)}


def test_segments_are_all_maximal_ones():
    rng = random.Random(3)
    for _ in range(200):
        s = [rng.choice([-3, -2, -1, 1, 2, 3]) + rng.random() / 100 for _ in range(rng.randint(0, 12))]
        assert {(a, b) for a, b, _ in toxicity.segments(np.array(s, float))} == brute_segments(s)


def test_toxicity_held_out(spark, corpus):
    rng = random.Random(4)
    rows, labels = [], []
    for i, text, lang, source in corpus * 3:
        d = len(rows)
        bad = d % 4 == 0
        rows.append((d, text + (" " + " ".join(rng.sample(["vile", "scum", "moron", "filth"], 2)) if bad else ""), lang, source))
        labels.append((d, int(bad)))
    docs = frame(spark, rows + [(x[0], *x[1:]) for x in ODD]).withColumn("predicted", F.lit("clash"))
    model = toxicity.train(docs, toxicity.train_labels(spark.createDataFrame(labels + [(900, None)], "doc_id long, toxic int")))
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + len(ODD)
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in got if r.doc_id is not None and r.doc_id < 900)
    assert all(r.predicted == 0 and 0 <= r.score < 0.7 for r in got if r.doc_id is None or r.doc_id >= 900)
    spans = next(r for r in got if r.doc_id == 0).passages
    words = toxicity.WORD.findall(rows[0][1].lower())
    assert spans and set(words[spans[-1].first_word : spans[-1].last_word + 1]) <= {"vile", "scum", "moron", "filth"}
    assert toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int")).curve is None


def test_toxicity_query_matches_plain_counting(spark):
    """The registered query against counts in plain Python: the lexicon, K, and every score."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.toxic in (0, 1)]
    train = {(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 != 1 and i in docs}
    n, words = [Counter(), Counter()], lambda t: re.findall(r"\w+", (t or "").lower())
    for i, y in train:
        n[y].update(set(words(docs[i])))
    kinds, clean, toxic = len(set(n[0]) | set(n[1])), sum(n[0].values()), sum(n[1].values())
    odds = lambda y, total: np.log((y + 0.5) / (total + 0.5 * kinds - y - 0.5))
    kept = {w for w in n[1] if n[1][w] >= 3 and (d := odds(n[1][w], toxic) - odds(n[0][w], clean)) >= 2 and d / np.sqrt(1 / (n[1][w] + 0.5) + 1 / (n[0][w] + 0.5)) >= 2.6}
    ratio = {w: float(np.log((n[1][w] + 0.5) / toxic / ((n[0][w] + 0.5) / clean))) for w in kept}
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.train_labels(spark.read.parquet(f"{SF}/labels.parquet")))
    lexicon = {w: s for w, s in ratio.items() if s > 0}
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[w] - s) < 1e-9 for w, s in lexicon.items())
    if not lexicon:
        return

    def scores(text):
        return [lexicon.get(w, model.other) for w in words(text)]

    def segment_scores(s):  # maximal segments by splitting at the best one, again and again
        sums = np.concatenate([[0], np.cumsum(s)])
        best, at = 0.0, None
        low, where = sums[0], 0
        for j in range(1, len(sums)):
            if sums[j] - low > best:
                best, at = sums[j] - low, (where, j)
            if sums[j] < low:
                low, where = sums[j], j
        return [] if at is None else [best, *segment_scores(s[: at[0]]), *segment_scores(s[at[1] :])]

    least = min(lexicon.values())
    clean_docs = [i for i, y in train if y == 0]
    above = sum(sum(x >= least - 1e-9 for x in segment_scores(scores(docs[i]))) for i in clean_docs)
    assert abs(model.k - (above + 0.5) / (max(1, sum(len(words(docs[i])) for i in clean_docs)) * np.exp(-least))) < 1e-9
    got = {r.doc_id: r for r in queries.op5_toxic_segments(spark, SF).collect()}
    for i, text in docs.items():
        s = segment_scores(scores(text))
        p = toxicity.p_value(s, len(words(text)), model.k) if s else 1.0
        want = toxicity.posterior(model, -np.log(p) if s else 0.0)
        assert abs(got[i].score - want) < 1e-6 and got[i].predicted == int(got[i].score >= 0.7) and got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_toxicity_of_nothing_and_of_long_texts(spark):
    model = toxicity.Model({"vile": 4.0}, -0.01, 0.001, (-3.0, 1.0))
    text = "plain " * 100_000 + "vile " * 5 + "plain " * 100_000
    rows = toxicity.scored(frame(spark, [(1, text, None, None), (2, None, None, None)]), model).collect()
    assert [r.predicted for r in rows] == [1, 0] and (rows[0].passages[0].first_word, rows[0].passages[0].last_word) == (100_000, 100_004)
    assert toxicity.scored(frame(spark, []), model).count() == 0


# Tokens


def test_tokens_match_the_library():
    c = tokens.Counter(tokens.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["", "a", " leading", "it's 12 apples\n\n\n  and   more ", "éüß 漢字 🙂🙂", "<|endoftext|>x<|endoftext|>", "\u3000\u00a0x"]
    texts += ["".join(rng.choice(["the ", "Zeit", " 12", "  ", "\n", "é", "!?", "漢", "<|endoftext|>", "'s"]) for _ in range(400)) for _ in range(20)]
    for t in texts:
        assert c.count(t) == c.whole(t), t
        for chunk, overlap in ((50, 16), (200, 4), (300, 100)):
            assert c.chunked(t, chunk, overlap) == c.whole(t), (chunk, overlap, t)
    for t in ("a" * 5000, " " * 5000, "ab " * 3000, "x" * 700 + " y" * 700):
        assert c.chunked(t, 256, 32) == c.whole(t) == c.count(t, huge=100)


def test_token_rows(spark):
    got = tokens.counted(frame(spark, ODD).withColumn("n_tokens", F.lit("clash"))).collect()
    assert len(got) == len(ODD) and got[0].n_tokens == got[0].n_bytes == 0 and got[-1].over_limit


def test_tokens_of_other_vocabularies():
    import sentencepiece

    path = tokens.vocabulary("piece_bpe_32k.model")
    assert tokens.Counter(path).count("some words here") == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("some words here"))
    words = tokens.Counter(tokens.vocabulary("word_bpe_49k.json"))
    assert not words.additive and words.count("Some Words") == words.whole("Some Words")


# Fixity


def audited(spark, first, second):
    """first, second: (archive, key, payload) rows."""
    frames = [spark.createDataFrame(rows, "archive long, key long, t string").withColumn("noise", F.lit(1)) for rows in (first, second)]
    records = [df.select("archive", "key", F.coalesce(F.length("t"), F.lit(0)).cast("long").alias("size"), fixity.leaf_hash(F.col("t").cast("binary")).alias("hash"), "noise") for df in frames]
    return sorted([(r.archive, r.at, r.low, r.high, r.key, r.status) for r in fixity.audit(*records).collect()], key=repr)


def brute_audit(first, second):
    of = [defaultdict(list), defaultdict(list)]
    for held, rows in zip(of, (first, second), strict=True):
        for a, k, t in rows:
            held[a, k].append(t)
    out = []
    for archive in {a for a, _ in [*of[0], *of[1]]}:
        high = 0
        keys = sorted({k for a, k in [*of[0], *of[1]] if a == archive}, key=lambda k: (k is not None, k or 0))
        for at, key in enumerate(keys):
            x, y = (sorted(t for t in held.get((archive, key), []) if t is not None) for held in of)
            low, high = high, high + sum(len(t) for t in x)
            if x != y:
                out.append((archive, at, low, high, key, "missing" if not y else "extra" if not x else "changed"))
    return sorted(out, key=repr)


def test_audit_finds_damage(spark):
    rng = random.Random(7)
    rows = [(a, i, f"record {a} {i} {rng.random()}") for a in (0, 1, None) for i in range(40 if a else 300)]
    rows += [(0, None, f"no key {i % 5}") for i in range(60)] + [(2, 5, "same")] * 3 + [(3, 1, None), (3, 2, "")]
    rng.shuffle(rows)
    other = [(a, k, t) for a, k, t in rows if k is None or (a, k) not in {(0, 299), (None, 2), (3, 2)}]
    other = [(a, k, f"{t}!" if (a, k) in {(0, 5), (1, 17)} else None if (a, k) == (0, 77) else t) for a, k, t in other]
    other += [(1, 1000, "surplus"), (None, -1, "surplus"), (8, 0, "surplus archive"), (2, 5, "same"), (0, None, "no key 9"), (3, 7, None)]
    assert audited(spark, rows, other) == brute_audit(rows, other)
    assert audited(spark, other, rows) == brute_audit(other, rows)
    assert {x[-1] for x in brute_audit(rows, other)} == {"missing", "extra", "changed"}
    assert audited(spark, rows, rows[::-1]) == audited(spark, [], []) == []
    assert [x[-1] for x in audited(spark, [], rows[:2])] == ["extra"] * 2


# Nearest neighbours


def test_neighbours_recall_and_ties(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:760] = x[10]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000, None), (2050, [0.0] * 16), (2100, [1.0] * 5), (2150, [float("nan")] * 16), (2200, [None] + [1.0] * 15), (None, [1.0] * 16), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = defaultdict(dict)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -9
        want = np.lexsort((np.arange(1500), -s.round(10)))[:5]
        assert len(found) == 5 and all(abs(s[v] - c) < 1e-9 for v, c in found.values())
        hit += len({v for v, _ in found.values()} & set(want.tolist()))
    assert hit >= 0.9 * 5 * len(got)
    assert [v for v, _ in (got[700][k] for k in range(1, 6))] == [10, 701, 702, 703, 704]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_neighbours_of_double_vectors(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(300, 8))
    x[7] *= 1e200
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id int, embedding array<double>")
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    got = neighbours.search(df, F.col("vec_id") % 50 == 0).collect()
    assert dict(neighbours.search(df, F.col("vec_id") % 50 == 0).dtypes)["vec_id"] == "int" and len(got) == 30
    assert all(abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-12 for r in got if 7 not in (r.query_id, r.vec_id))


def test_neighbours_within_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(6000, 16)).astype(np.float32)
    x[:3000] = x[0] + 1e-3 * x[:3000]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = defaultdict(set)
    for r in neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hit = 0
    for q in range(0, 3000, 100):
        s = unit @ unit[q]
        s[q] = -9
        hit += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.95 * 5 * 30


# URLs


def test_url_parts_and_rules(spark):
    rows = ["http://A.Example.ORG/es/1?x", "https://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "http://x.com/de/#a", "http://xcom/de/", "ftp://h", None, "no scheme", "http://b.org", "a://b://c/d"]
    df = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: tuple(r)[1:] for r in urls.judged(df).collect()}
    assert got[0][:4] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[1][2:] == ("example.org/en/1", "block") and got[2][2:] == ("org/", "allow")
    assert got[3][2:] == ("com/fr/", "allow") and got[4] == ("x.com", "/de/", "com/de/", "block")
    assert got[5][:3] == ("xcom", "/de/", None) and got[6][:3] == ("h", "", None) and got[7][:3] == got[8][:3] == ("", "", None)
    assert got[9][:3] == ("b.org", "", None) and got[10][:2] == ("b:", "//c/d") and {g[3] for g in got.values()} <= {"allow", "block"}
    assert urls.judged(df.limit(0)).count() == 0
    assert urls.judged(df.union(df)).count() == 2 * len(rows)


def test_urls_of_one_class_long_ones_and_lookups_by_shuffle(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    verdicts = lambda df, **k: sorted(map(tuple, urls.judged(df, **k).collect()), key=repr)
    assert verdicts(pages) == verdicts(pages, most_broadcast=20)  # frequent n-grams broadcast, the others shuffled
    one = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://b.org/y"), (3, "http://c.net/z"), (4, "http://c.net/" + "long/" * 2000), (4, "http://c.net/z")], "page_id long, url string")
    assert {r.verdict for r in urls.judged(one).collect()} == {"allow"} and urls.judged(one).count() == 5


# Jaccard join


def brute_links(rows, similarity=0.8):
    sets = [frozenset(s.tolist()) for s in shingle_sets([t for _, t, *_ in rows])]
    links, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= similarity * len(a | b):
            links[i] += 1
            links[j] += 1
            parent[find(j)] = find(i)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    least = {g: min(x for x in ids if x is not None) if any(x is not None for x in ids) else None for g, ids in groups.items()}
    return [(r[0], least[find(i)], links[i]) for i, r in enumerate(rows)]


def near_rows():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 6, 30])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy), None, None))
    return rows


def test_jaccard_matches_brute_force(spark):
    rows = near_rows() + ODD
    for small in (64, 4):  # a small limit makes the recursion go deep
        got = jaccard.linked(frame(spark, rows).withColumn("class_id", F.lit("clash")), small=small).collect()
        assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == sorted(brute_links(rows), key=repr)
    assert jaccard.linked(frame(spark, [])).count() == 0


def test_jaccard_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 8)
    rows = near_rows()
    got = jaccard.linked(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == sorted(brute_links(rows))


@pytest.mark.parametrize("most", [1024, 8])
def test_one_of_each_stays(spark, monkeypatch, most):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", most)  # of small blocks, groups have many
    rows = near_rows() + ODD
    kept = jaccard.keep_one(frame(spark, rows).withColumn("_gone", F.lit(1)).withColumn("_id", F.lit(2)))
    want = {least for i, least, _ in brute_links(rows) if i is not None}
    assert kept.columns == ["doc_id", "text", "lang", "source", "_gone", "_id"]
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(want) and kept.where("doc_id IS NULL").count() == 1


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    text = [" ".join(f"{x}{i}" for i in range(30)) for x in "abc"]
    rows = [(1, text[0], None, None), (2, text[1], None, None), (2, text[0], None, None), (None, text[2], None, None), (None, text[2], None, None), (None, text[1], None, None), (3, None, None, None), (3, None, None, None)]
    kept = jaccard.keep_one(frame(spark, rows)).collect()
    assert sorted([(r.doc_id, r.text) for r in kept], key=repr) == sorted([(1, text[0]), (2, text[1]), (None, text[2]), (3, None), (3, None)], key=repr)


def test_sets_outside_the_largest_class_are_compared_with_all(spark, monkeypatch):
    """A chain of sets in which only neighbours are linked is one class, whichever block they are in."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 4)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100]), None, None) for i in range(30)]
    links = brute_links(rows)
    assert {c for _, c, _ in links} == {0}
    assert [r.doc_id for r in jaccard.keep_one(frame(spark, rows)).collect()] == [0]
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.linked(frame(spark, rows)).collect()) == sorted(links)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 130)}


# Pipeline and queries


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == names, name
        assert docs.count() <= before
        before = docs.count()
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = [r.text for r in docs.collect()]
    assert not any(i in t for i in items for t in texts)
    assert len({s.tobytes() for s in shingle_sets(texts)}) == len(texts)
    mix = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mix.count() > 0 and set(names) <= set(mix.columns)
    assert corpus_pipeline.run(spark, SF).count() == mix.count()
    assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Null and repeated ids, nulls, and columns with the names that the stages use: all pass, none is lost by its name."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    odd = [(None, "a text that has no id at all but words enough for a set", "en", None, 5), (7, "another text under an id that is taken, which stays as it is another", "en", "src1", 5), (None, None, None, None, None), (900, "", "en", "src2", 0)]
    more = spark.createDataFrame(odd * 2, docs.schema)
    clash = {c: F.lit(c) for c in ("_row", "_id", "_th", "mix_copy", "mix_shard", "_language", "_toxicity", "_contaminated", "size", "node", "h")}
    docs.unionByName(more).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    mix = corpus_pipeline.run(spark, str(tmp_path))
    assert len(set(mix.columns)) == len(mix.columns) and set(clash) <= set(mix.columns)
    rows = mix.collect()
    assert rows and all(r[c] == c for r in rows for c in clash) and not any(r.text is None or r.text == "" for r in rows)
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, kept.where("text != ''"), str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in stage) == 1 and sum(r.text == odd[1][1] for r in stage) == 1


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.queries()] == ["pipeline", *(f"op{i}" for i in range(1, 11))]
    assert set(queries.oracle_sql()) <= set(queries.queries())
    json.dumps(queries.oracle_sql())
    assert os.path.exists(tokens.vocabulary("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    relation = con.sql(queries.oracle_sql()[name])
    at = [relation.columns.index(c) for c in df.columns]
    assert sorted(repr(tuple(r)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in relation.fetchall())


def test_named_notices_give_their_own_licence(spark):
    """Published notices with a foreign name, wrapped, against what a reader would say."""
    wrap = lambda *parts: "\n\n".join(textwrap.fill(p, 72) for p in parts)
    grant = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    source = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    binary = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    name = "3. Neither the name of Example Widgets, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    as_is = 'THIS SOFTWARE IS PROVIDED BY THE EXAMPLE FOUNDATION AND ITS FRIENDS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'
    apache_rest = 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
    notices = [
        (wrap("Copyright (c) 2020, Jo Doe", grant, source, binary, name, as_is), "BSD-3-Clause", ""),
        (wrap("Copyright (c) 2020, Jo Doe", grant, source, binary, as_is), "BSD-2-Clause", ""),
        (wrap(grant, source, binary, name.replace("3. ", "").replace("Neither the name of Example Widgets, Inc. nor the names of its contributors", "The name of the author") .replace("may be used", "may not be used"), as_is), "BSD-3-Clause", ""),
        (wrap(apache, "    https://www.apache.org/licenses/LICENSE-2.0", apache_rest), "Apache-2.0", ""),
        ("x = 1\n# SPDX-License-Identifier: MIT OR Apache-2.0\ny", "Apache-2.0,MIT", ""),
        ("SPDX-License-Identifier: (GPL-2.0-or-later WITH Classpath-exception-2.0 AND MIT)", "MIT,GPL-2.0-or-later", ""),
        ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1-or-later", ""),
        ("Hello. This code is licensed under the MIT License.", "MIT", ""),
        ("This project is released under the terms of the Apache License, Version 2.0.", "Apache-2.0", ""),
        ("This work is licensed under the GNU General Public License version 3.", "GPL-3.0", ""),
        ("Redistribution without a licence, and neither the name of anyone nor more.", None, None),
    ]
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(list(enumerate(t for t, *_ in notices)), "doc_id long, text string")).collect()}
    for i, (_, want, left) in enumerate(notices):
        assert (got[i].licences, got[i].left_over) == (want, left) if want else i not in got, (i, got.get(i))


def test_urls_of_a_megabyte_and_many_copies(spark):
    long = "http://a.net/" + "ab/%" * 250_000
    rows = [(1, "http://x.org/a", None), (2, "http://example.org/es/b", None), (3, long, None)] + [(4, "http://b.net/q", None)] * 7
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cut = urls._grams(pages.where("page_id = 3"), "page_id").groupBy("g").count().collect()
    text = urls.START * (urls.ORDER - 1) + long + urls.END
    assert {r.g: r["count"] for r in cut} == Counter(text[i : i + urls.ORDER] for i in range(len(text) - urls.ORDER + 1))
    got = urls.judged(pages).collect()
    assert Counter(r.page_id for r in got) == {1: 1, 2: 1, 3: 1, 4: 7} and len({r.verdict for r in got if r.page_id == 4}) == 1
