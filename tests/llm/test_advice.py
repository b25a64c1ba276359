"""Cases that a review found missing."""

import re
import sys
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

import corpus_pipeline
from panelkit.llm import decontaminate, licenses, neardup, pii


def lone_pairs(n):
    """(doc_id, text): 3 n pairs of random words, each pair's shingle sets just above the similarity: appended, block replaced, one word of a short text."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 10))))
    draw = lambda k: [word() for _ in range(k)]
    pairs = []
    for _ in range(n):
        a = draw(200)
        pairs.append((a, a + draw(48)))
        a = draw(300)
        pairs.append((a, a[:100] + draw(28) + a[128:]))
        a = draw(60)
        pairs.append((a, a[:30] + draw(1) + a[31:]))
    return [(2 * k + side, " ".join(pair[side])) for k, pair in enumerate(pairs) for side in (0, 1)]


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + neardup.WIDTH]) for i in range(len(w) - neardup.WIDTH + 1)}


def test_all_lone_pairs_above_the_similarity_are_found(spark):
    rows = lone_pairs(60)
    for (_, a), (_, b) in zip(rows[::2], rows[1::2], strict=True):
        x, y = shingles(a), shingles(b)
        assert 0.8 <= len(x & y) / len(x | y) < 0.86
    kept = {r.doc_id for r in neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in rows if i % 2 == 0}


def test_passages_of_the_benchmark_are_cut_out_of_long_documents(spark, monkeypatch):
    passage = " ".join(f"item{k}" for k in range(20))
    long = " ".join(f"word{k}" for k in range(600))
    rows = [(1, f"{long}. {passage}. {long}"), (2, f"{passage} and little else"), (3, long), (4, None)]
    benchmark = spark.createDataFrame([(1, passage)], "item_id long, text string")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: benchmark)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in corpus_pipeline.benchmark_decontamination(spark, docs, "").collect()}
    assert got == {1: f"{long}. . {long}", 3: long, 4: None}
    assert decontaminate.report(docs, benchmark).where("contaminated").count() == 1


def test_replaced_phone_numbers_stay_distinct_in_all_spellings(spark, monkeypatch):
    """Few digits are drawn, so that many replacements coincide at first, with each other and with numbers that exist."""
    draw = pii._draw
    monkeypatch.setattr(pii, "_draw", lambda digest, at: F.when(at < 9, F.lit(5)).otherwise(F.pmod(draw(digest, at), F.lit(10))))
    digits = [f"{17 + k:03d}555{7700 + k}" for k in range(12)] + [f"55555555{k:02d}" for k in range(12)]
    rows = [(k, f"+1 ({d[:3]}) {d[3:6]}-{d[6:]} and +1{d} and +1-{d[:3]}-{d[3:6]}-{d[6:]}") for k, d in enumerate(digits)]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    got = [[re.sub(r"\D", "", x) for x in r.text.split(" and ")] for r in pii.replace(docs, "key").collect()]
    assert all(len(x) == 3 and len(set(x)) == 1 and x[0][0] == "1" for x in got)
    made = {x[0] for x in got}
    assert len(made) == len(rows) and not made & {f"1{d}" for d in digits}


APACHE = """Copyright 2024 Somebody

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Copyright (c) 2024 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD = """Copyright (c) 2024, Somebody

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_genuine_licence_texts_are_recognised(spark):
    want = {"Apache-2.0": APACHE, "MIT": MIT, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL3.replace("version 3", "version 2"), "BSD": BSD, "MPL-2.0": MPL}
    leaders = {"": ("", ""), "# ": ("", ""), " * ": ("/*\n", "\n */"), "// ": ("", "")}
    rows = [(name, before + "\n".join(lead + x for x in text.split("\n")) + after + "\n\ncode();") for name, text in want.items() for lead, (before, after) in leaders.items()]
    # Wrapped elsewhere, after a line that is no part of the sentence.
    rows.append(("Apache-2.0", APACHE.replace("\n\nLic", "\nLic").replace('"License");\nyou', '"License"); you').replace("file except", "file\nexcept")))
    rows += [("MIT", "Released under the MIT License\nof nothing, with permission"), ("", "You may not use this file except\n\nin compliance with the License.")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(rows)], "doc_id int, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert [got[k].licenses for k in range(len(rows) - 2)] == [name for name, _ in rows[:-2]]
    assert got[4].sentence_ids == "mit-grant-whole,mit-keep,mit-warranty,mit-liability"
    assert got[len(rows) - 1].sentence_ids == ""
    assert got[len(rows) - 2].sentence_ids == "mit-notice"
