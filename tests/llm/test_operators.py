"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeats."""

import base64
import hashlib
import math
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracemill.llm import common, license_scan, tool_calls
from tracemill.llm.arc_convert import archive_pages
from tracemill.llm.best_fit import pack, sequences, sweep
from tracemill.llm.bwt_dedup import remove_repeats
from tracemill.llm.chosen_path import near_duplicates
from tracemill.llm.common import components, shared_folder
from tracemill.llm.one_bit_codes import nearest
from tracemill.llm.plane_files import read_ids, write_ids
from tracemill.llm.source_mix import mix_sources, split_quotas
from tracemill.llm.target_ratio import quality_rules
from tests.oracle import compare
from tracemill.llm.tokens import WordEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(rng, n):
    return [f"w{x}" for x in rng.integers(0, 400, n)]


def texts():
    rng = np.random.default_rng(3)
    base, passage = words(rng, 120), " ".join(words(rng, 60))
    out = [None, "", "  \n\t ", "one two", "ONE two", "a b c d e", "é ü 日本 " * 40, "x" * 5000, "line one is here\nline one is here\n" * 30]
    for k in range(12):  # near copies of one text
        copy = list(base)
        copy[(7 * k) % 120] = f"edit{k}"
        out.append(" ".join(copy))
    out += [" ".join(base)] * 3
    out += [" ".join(words(rng, 40)) + " " + passage + " " + " ".join(words(rng, 40)) for _ in range(5)]
    out += [" ".join(words(rng, int(n))) for n in rng.integers(1, 300, 20)]
    out.append(" ".join(words(rng, 30_000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, f"s{k % 4}" if k % 9 else None, "x", True) for k, t in enumerate(texts())]
    rows.append(rows[15])  # a repeated row
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words string, kept boolean").repartition(4).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r[df.columns[0]]: r for r in df.collect()}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 99), (7, 7), (50, 51), (51, 50)], "a long, b long")
    got = {r.id: r.component for r in components(edges.repartition(5)).collect()}
    assert got == {**{k: 0 for k in range(31)}, 99: 99, 100: 99, 50: 50, 51: 50}


def test_one_python_worker_a_task(spark, monkeypatch):
    """Edges that Python makes are written before Python contracts them: no task of a step holds two workers."""
    steps, write = [], common.materialize
    monkeypatch.setattr(common, "materialize", lambda df, name: steps.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    edges = spark.range(0, 40, 1, 4).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components(edges.mapInArrow(lambda batches: batches, "a long, b long"))
    assert {(r.id, r.component) for r in found.collect()} == {(k, 0) for k in range(41)}
    assert max(plan.count("MapInArrow") for plan in steps) == 1


def test_kept_powers_are_those_of_a_chunk():
    """A worker outlives its tasks, so a long text's powers must not stay with it."""
    up, down = common.powers(3 * common.CHUNK)
    assert len(up) == len(down) == 3 * common.CHUNK and (up * down == 1).all()
    assert (common.powers(1000)[0] == up[:1000]).all()
    assert max(len(kept) for kept in common._powers.values()) <= common.CHUNK + 1


@pytest.mark.parametrize("options", [{}, {"leaf": 2, "cap": 4, "depth": 1}, {"leaf": 3, "cap": 100, "depth": 0}])
def test_near_duplicates(docs, empty, options):
    sets = {}
    for r in docs.collect():
        w = WORD.findall((r.text or "").translate(LOWER))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    up = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((up[a], up[b]))
                up = {k: x if v == y else v for k, v in up.items()}
    out = near_duplicates(docs, **options)
    assert out.count() == docs.count()
    for k, r in by_id(out).items():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[k]), up[k], up[k] == k)
    assert near_duplicates(empty, **options).count() == 0


@pytest.mark.parametrize("hot", [20_000, 1])
def test_repeated_strings(docs, empty, hot):
    rows = [(r.text or "").encode() for r in docs.collect()]
    count = Counter(t[i : i + 200] for t in rows for i in range(len(t) - 199))
    want = {}
    for r, t in zip(docs.collect(), rows):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        want[r.doc_id] = (len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest())
    out = remove_repeats(docs, hot=hot)
    assert out.count() == docs.count()
    for k, r in by_id(out).items():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[k]
    assert remove_repeats(empty).count() == 0


def test_quality_rules(spark, docs, empty):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 30)] + [(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = by_id(quality_rules(docs, labels))
    for r in docs.collect():
        w, text = WORD.findall(r.text or ""), r.text or ""
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        got = out[r.doc_id]
        assert (got.n_words, got.word_chars, got.n_symbols, got.n_dup_lines, got.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        assert got.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert got.kept == (not got.base_failed and got.score >= -150_000)
    none = quality_rules(docs, labels.limit(0)).filter("n_words > 0").select("score").distinct().collect()
    assert [r.score for r in none] == [0]
    assert quality_rules(empty, labels).count() == 0


def test_quality_scores(spark):
    rows = [(k, f"a{k} b{k} a{k} c d e f g h i j", "s") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 0, 0)], "doc_id long, quality int, toxic int")
    out = by_id(quality_rules(docs, labels, buckets=1_000_003))
    grams = {k: [(w,) for w in t.split()] + list(zip(t.split(), t.split()[1:])) for k, t, _ in rows}
    raw, good = Counter(g for v in grams.values() for g in v), Counter(grams[0])
    r, t, n = sum(raw.values()), sum(good.values()), 1_000_003
    for k, v in grams.items():
        weights = [round(1e6 * (math.log((good[g] + 1) / (t + n)) - math.log((raw[g] + 1) / (r + n)))) for g in v]
        assert abs(out[k].score - sum(weights) / len(v)) < 2


def test_quality_bar(spark):
    """Documents below nearly all trusted ones go, though their scores are above the fixed bound."""
    rng = np.random.default_rng(41)
    prose = lambda n: [f"p{x}" for x in rng.integers(0, 300, n)]
    rows, labels = [], []
    for k in range(1200):
        junk = 0 if k % 4 else int(rng.integers(1, 60))
        rows.append((k, " ".join(prose(60 - junk) + [f"j{x}" for x in rng.integers(0, 10**6, junk)])))
        labels.append((k, int(not junk), 0))
    spark_docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    spark_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = by_id(quality_rules(spark_docs, spark_labels, lost=0.01))
    assert not any(r.base_failed for r in out.values())
    good = sorted(out[k].score for k, q, _ in labels if q)
    bar = good[len(good) // 100] // 1000 * 1000
    assert {k: r.kept for k, r in out.items()} == {k: r.score >= max(bar, -150_000) for k, r in out.items()}
    assert sum(-150_000 <= r.score < bar and not r.kept for r in out.values()) > 10
    assert sum(not out[k].kept for k, q, _ in labels if q) <= 9


def test_mix(docs, empty, spark):
    out = mix_sources(docs, block_words=500)
    rows = out.collect()
    assert len(rows) == docs.count()
    per = defaultdict(list)
    for r in rows:
        per[r.source].append(r)
        assert r.taken == r.size * len(r.shards) <= 2 * r.size
    names = sorted((k for k in per if k is not None)) + [None]
    total = {k: sum(r.size for r in per[k]) for k in names}
    weight, target = dict(zip(names, [5, 2, 1, 5, 2])), dict.fromkeys(names, 0.0)
    left, free = 1.5 * sum(total.values()), set(names)
    while left > 1e-6 and free:
        share = sum(weight[k] for k in free)
        for k in free:
            target[k] += left * weight[k] / share
        left = 0.0
        for k in [k for k in free if target[k] >= 2 * total[k]]:
            left += target[k] - 2 * total[k]
            target[k] = 2.0 * total[k]
            free.discard(k)
    for k in names:
        assert per[k][0].source_size == total[k] and abs(per[k][0].target - target[k]) < 1e-6
        biggest = max(r.size for r in per[k])
        assert abs(sum(r.taken for r in per[k]) - target[k]) <= biggest
    again = sorted((r.doc_id, r.taken, tuple(r.shards)) for r in mix_sources(docs.repartition(3), block_words=500).collect())
    assert again == sorted((r.doc_id, r.taken, tuple(r.shards)) for r in rows)
    assert mix_sources(empty).count() == 0
    quotas = spark.createDataFrame([(0, 700), (1, 13), (2, 0)], "sid long, k long")
    shards = split_quotas(quotas, 3, 1).toPandas()
    assert shards.groupby("sid").k.sum().to_dict() == {0: 700, 1: 13, 2: 0}
    assert shards.groupby("shard").k.sum().between(89, 90).all()


def test_sweep():
    rng = np.random.default_rng(1)
    for _ in range(100):
        cap = int(rng.integers(1, 60))
        counts = {int(x): int(rng.integers(1, 40)) for x in rng.integers(1, cap + 1, 12)}
        used, ranks = defaultdict(list), defaultdict(list)
        for length, begin, n, each, first, offset in sweep(counts, cap):
            for k in range(n):
                used[first + k // each].append((offset + k % each * length, length))
                ranks[length].append(begin + k)
        assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
        for parts in used.values():
            ends = [a + b for a, b in sorted(parts)]
            assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= cap


def test_pack(docs, empty):
    out = pack(docs, BYTES, with_ids=True).cache()
    plain = Tokenizer.from_file(BYTES)
    want = Counter()
    for r in docs.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        head = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(head, len(ids), 2048)]):
            part = ids[a : a + (2048 if k else head)]
            want[r.doc_id, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        ends = [a + b for a, b in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(seqs) <= 1 + math.ceil(sum(r.length for r in rows) / 2048)
    whole = sequences(out).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in rows)
    assert pack(empty, BYTES).count() == 0


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder(path):
    own = WordEncoder(path, most=50)
    odd = ["", " ", "a  b\n\n c'll 'S <|endoftext|> x", "日本語 テスト", "İstanbul ΣΑΣ", "é", "\x1f a\x85b", "1234 ½ ² ª º ŉ ſ", "“quoted” — x…", "tab\t\tx  \n y_z   "]
    cases = odd + [t or "" for t in texts()] + [f"{chr(c)}a {chr(c)}{chr(c)}B 1{chr(c)}" for c in [*range(9, 0x260), *range(0x2000, 0x2030)]]
    cases += ["a <|endoftext|> b", "<|startoftext|>x", "<|EndOfText|>", "x<|endoftext|>", "<|endoftext", "\n<|endoftext|>\n<|endoftext|>"]
    plain = [e.ids for e in Tokenizer.from_file(path).encode_batch_fast(cases, add_special_tokens=False)]
    assert [x.tolist() for a in range(0, len(cases), 40) for x in own.encode(cases[a : a + 40])] == plain


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_keeps_frequent_words(path):
    own, asked = WordEncoder(path, most=40), Counter()
    model = own.tokenizer.model

    class Counted:
        def tokenize(self, word):
            asked[word] += 1
            return model.tokenize(word)

    class Library:
        model = Counted()

    own.tokenizer = Library()
    for k in range(40):  # new words overflow the caches again and again, the frequent one stays
        own.encode([" the the the " + " ".join(f"{chr(97 + k % 26)}{chr(97 + j)}{chr(97 + k // 26)}" for j in range(20))])
    assert max(asked.values()) == 1


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files(spark, docs, empty, kind):
    plain, at, want = Tokenizer.from_file(WORDS), 0, []
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    got = read_ids(write_ids(docs, WORDS, 2, shared_folder(spark, "ids"), block=100, kind=kind))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert read_ids(write_ids(empty, WORDS, 2, shared_folder(spark, "ids"))).count() == 0


def test_archives(spark):
    rows = [(k, f"http://h/{k} x\té", t) for k, t in enumerate([None, "", "a", "a", "a\r\n\r\nb", "HTTP/1.1 x", "ü" * 70_000, "a"])] + [(99, None, "solo")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = by_id(archive_pages(pages))
    last = {h or "": k for k, _, h in rows}
    for k, _, h in rows:
        data = (h or "").encode()
        r, to = out[k], last[h or ""]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if to == k else ("revisit", to))
    assert Counter(r.record_type for r in archive_pages(pages, least=2).collect())["revisit"] == 0
    assert archive_pages(pages.limit(0)).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((700, 24)).astype(np.float32)
    vectors[13] = vectors[12]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [None] + [1.0] * 23), (780, [1.0, 2.0]), (781, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in nearest(frame, frame.filter("vec_id % 20 = 0"), k=20, block=64, group=8, slices=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    exact = vectors.astype(np.float64)
    hits = 0
    for q in range(0, 700, 20):
        scores = exact @ exact[q]
        order = [int(v) for v in np.lexsort((np.arange(700), -scores)) if v != q][:20]
        hits += len({v for v, _ in got[q]} & set(order))
        assert all(abs(s - scores[v]) < 1e-9 for v, s in got[q]) and len(got[q]) == 20
    assert hits >= 0.98 * 20 * 35 and set(got) == set(range(0, 700, 20))


def test_licenses(spark):
    full = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation\n"
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,\n"
            "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is\n"
            "furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be\n"
            "included in all copies or substantial portions of the Software.")
    rows = [(1, "Abc.\nReleased under the MIT License.\nXyz"), (2, None), (3, ""), (4, full), (5, "Licensed under CC BY 4.0. Licensed under CC BY 4.0."),
            (6, "no license here"), (7, "You may obtain a copy of the License at: x")]
    out = by_id(license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")))
    assert {k: (r.sentence_ids, r.licenses, r.n_unmatched) for k, r in out.items()} == {
        1: ("MitRef", "MIT", 0), 2: ("", "", 0), 3: ("", "", 0), 4: ("MitGrant MitNotice", "MIT", 0),
        5: ("CcBy4Ref CcBy4Ref", "CC-BY-4.0", 0), 6: ("", "", 0), 7: ("ApacheCopy", "", 1)}
    assert all(re.search(license_scan.CUE, s) for s in license_scan.SENTENCES)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
GPL = """This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version.
"""
GPL2, GPL3 = GPL.format(";", ";", 2), GPL.format(":", ",", 3)
NO_WARRANTY = """
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
AGPL = GPL3.replace("GNU General Public", "GNU Affero General Public")
LGPL = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version.
"""
LIBRARY_WARRANTY = NO_WARRANTY.replace("This program", "This library")
GPL2_ONLY = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License
version 2 as published by the Free Software Foundation.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{}
"""
ISC_NOTICE = ", provided\nthat the above copyright notice and this permission notice appear in all copies."
ISC_WARRANTY = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL DAMAGES.
"""
NOTICES = {  # of each rule
    "MitGrant MitNotice MitWarranty": MIT + """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM.
""",
    "MitGrant MitNotice": MIT,
    "Apache2Ref ApacheComply ApacheCopy ApacheWarranty": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language.
""",
    "Gpl3Plus GplWarranty": GPL3 + NO_WARRANTY, "Gpl2Plus GplWarranty": GPL2 + NO_WARRANTY, "Gpl3Plus": GPL3, "Gpl2Plus": GPL2,
    "BsdGrant BsdSource BsdBinary BsdEndorse": BSD + """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission.
""",
    "BsdGrant BsdSource BsdBinary": BSD,
    "Gpl3Ref": "This work is licensed under the GNU General Public License version 3.",
    "Gpl2Ref": "This work is licensed under the GNU General Public License version 2.",
    "Apache2Ref": "Licensed under the Apache License, Version 2.0.", "MitRef": "Released under the MIT License.",
    "CcByNc4Ref": "Licensed under CC BY-NC 4.0.", "CcBySa4Ref": "Licensed under CC BY-SA 4.0.", "CcBy4Ref": "Licensed under CC BY 4.0.",
    "Agpl3Plus GplWarranty": AGPL + NO_WARRANTY, "Agpl3Plus": AGPL, "Lgpl3Plus GplWarranty": GPL3.replace("GNU General", "GNU Lesser General") + NO_WARRANTY,
    "Lgpl21Plus LgplWarranty": LGPL.format("2.1") + LIBRARY_WARRANTY, "Lgpl21Plus": LGPL.format("2.1"),
    "Lgpl3Plus LgplWarranty": LGPL.format("3") + LIBRARY_WARRANTY, "Lgpl3Plus": LGPL.format("3"),
    "Gpl2Only GplWarranty": GPL2_ONLY + NO_WARRANTY, "Gpl2Only": GPL2_ONLY,
    "Mpl2Terms Mpl2Copy": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Mpl2Terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Epl2Terms": """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/""",
    "Epl1Terms": """All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public
License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html""",
    "IscGrant IscWarranty": ISC.format(ISC_NOTICE) + ISC_WARRANTY, "IscGrant": ISC.format(ISC_NOTICE),
    "Bsd0Grant IscWarranty": ISC.format(".") + ISC_WARRANTY, "Bsd0Grant": ISC.format("."),
    "BoostGrant": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so, all subject to the following:""",
    "UnlicenseRef UnlicenseGrant": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a
compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "UnlicenseRef": "This is free and unencumbered software released into the public domain.",
    "ZlibWarranty ZlibGrant": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and
redistribute it freely, subject to the following restrictions:""",
    "Cc0Dedication": """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide.""",
    "WtfplText": """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed
as long as the name is changed.""",
    "Mpl2Ref": "Licensed under the Mozilla Public License, version 2.0.", "Epl2Ref": "Licensed under the Eclipse Public License, Version 2.0.",
    "Agpl3Ref": "Licensed under the GNU Affero General Public License, version 3.", "Lgpl3Ref": "Licensed under the GNU Lesser General Public License version 3.",
    "Lgpl21Ref": "Licensed under the GNU Lesser General Public License version 2.1.", "Cc0Ref": "Licensed under CC0 1.0.",
    "BoostRef": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)",
    "IscRef": "Licensed under the ISC license.", "ZlibRef": "Licensed under the zlib License.",
    "Bsd3Ref": "Licensed under the BSD 3-Clause License.", "Bsd2Ref": "Licensed under the BSD 2-Clause License.",
    **{ids: f"SPDX-License-Identifier: {name}" for ids, name in license_scan.RULES if ids.startswith("Tag")},
}


def test_licence_notices(spark):
    """The notice of every rule: as it is, wrapped at each width, each word on a line, in comments, on one line."""
    assert set(NOTICES) == {ids for ids, _ in license_scan.RULES}
    texts = []
    for ids, notice in NOTICES.items():
        paragraphs = [" ".join(p.split()) for p in notice.split("\n\n")]
        for width in (1, 20, 40, 60, 72, 79, 100):
            wrapped = [textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs]
            texts.append((ids, "\n\n".join("\n".join(p) for p in wrapped)))
            texts.append((ids, "Prose before.\n\n" + "\n *\n".join("\n".join(f" * {x}" for x in p) for p in wrapped) + "\n\nProse behind."))
        texts += [(ids, notice), (ids, " ".join(notice.split()))]
    out = by_id(license_scan.scan_licenses(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(texts)], "doc_id long, text string")))
    names = dict(license_scan.RULES)
    for k, (ids, text) in enumerate(texts):
        assert (out[k].sentence_ids, out[k].licenses, out[k].n_unmatched) == (ids, names[ids], 0), text


def test_licence_sql_reads_sentences_over_several_pieces(spark, tmp_path):
    """The SQL gives the same for wrapped notices, tags among code, addresses and texts without a licence."""
    texts = [None, "", "http://x.y/license MIT", "// SPDX-License-Identifier: MIT\nint main;", "# SPDX-License-Identifier: GPL-2.0-only\n# copyright x"]
    for ids, notice in NOTICES.items():
        for width in (20, 60, 79):
            texts.append("Prose before.\n\n" + "\n\n".join(
                "\n".join(f"# {x}" for x in textwrap.wrap(" ".join(p.split()), width, break_on_hyphens=False)) for p in notice.split("\n\n")))
        texts += [notice, " ".join(notice.split()), notice.replace("the", "teh", 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents/*.parquet')")
    got = license_scan.scan_licenses(docs)
    assert compare(got, con, license_scan.sql()) is None
    assert got.filter("doc_id in (3, 4)").orderBy("doc_id").select("licenses").collect() == [("MIT",), ("GPL-2.0-only",)]


def test_tool_calls(spark):
    calls = spark.createDataFrame([
        (1, "a", 0, "search", '{"limit": 3, "query": "twenty characters long"}', ["zz"]), (1, "b", 1, "search", '{"query":1}', ["a"]),
        (1, "c", 2, "count", "{broken", ["a", "b"]), (1, "d", 3, "none", None, ["e"]), (1, "e", 4, "lookup", "[]", ["d"]),
        (1, "a", 0, "search", '{"limit": 3, "query": "twenty characters long"}', ["zz"]), (None, "a", 0, "x", "{}", None), (2, "b", 0, "count", '{"query":"é","limit":9}', None),
    ], "conv_id long, call_id string, turn long, name string, arguments string, after array<string>")
    results = spark.createDataFrame([(1, "a", "ok"), (1, "a", "late"), (1, "x", "lost"), (2, "b", None)], "conv_id long, call_id string, content string")
    out = {(r.conv_id, r.call_id): r for r in tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()}
    assert {k: r.level for k, r in out.items()} == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): None, (1, "e"): None, (2, "b"): 0}
    assert {k[1] for k, r in out.items() if r.valid} == {"a", "b"} and not out[1, "b"].valid
    assert out[1, "a"].json == '{"arguments":{"limit":3,"query":"twenty characters long"},"id":"a","name":"search","result":"late"}'
    assert out[1, "b"].errors == "/limit: missing; /query: not of type string" and out[2, "b"].linked and not out[1, "c"].linked
    assert tool_calls.link_calls(calls.limit(0), results, {}).count() == 0


def test_pipeline(spark):
    """Stages keep their promises on each other's output."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = corpus_pipeline.quality(spark, docs, sf).cache()
    assert {r.doc_id for r in quality_rules(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("kept").collect()} == {r.doc_id for r in good.collect()}
    single = corpus_pipeline.near_dedup(spark, good, sf).cache()
    assert near_duplicates(single).filter("not kept").count() == 0
    cut = corpus_pipeline.repeats(spark, single, sf).cache()
    assert cut.columns == docs.columns and remove_repeats(cut).agg({"n_removed": "sum"}).first()[0] <= 0.02 * sum(r.n_chars for r in cut.collect())
    mixed = corpus_pipeline.mix(spark, cut, sf).cache()
    taken = {r.doc_id: len(r.shards) for r in mix_sources(cut).collect() if r.shards}
    assert Counter(r.doc_id for r in mixed.collect()) == taken
    packed = corpus_pipeline.packing(spark, mixed, sf)
    assert packed.filter("piece = 0").count() == mixed.count()


def test_small_results_are_few_files(spark, docs):
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    stage_docs = docs.select("doc_id", "text", "source", F.lit("en").alias("lang"), F.length("text").cast("long").alias("n_chars"))
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        for step in (lambda: remove_repeats(docs), lambda: pack(docs, BYTES), lambda: corpus_pipeline.near_dedup(spark, stage_docs, "")):
            path = shared_folder(spark, "few")
            step().write.parquet(path)
            assert len(spark.read.parquet(path).inputFiles()) <= spark.sparkContext.defaultParallelism
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_near_dedup_stage(spark):
    """The stage against brute force at 0.8, with pairs on both sides of it and of 0.85."""
    rng, rows = np.random.default_rng(21), []
    for k in range(12):
        base = [f"v{k}x{i}" for i in range(104)]  # 100 shingles; a block of m changed words at the end costs m of them
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 104 - 4 - k] + [f"z{k}x{i}" for i in range(4 + k)]))]
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    near = [10 * len(sets[k] & sets[k + 1]) >= 8 * len(sets[k] | sets[k + 1]) for k in range(0, 24, 2)]
    old = [20 * len(sets[k] & sets[k + 1]) >= 17 * len(sets[k] | sets[k + 1]) for k in range(0, 24, 2)]
    assert 0 < sum(old) < sum(near) < 12
    docs = spark.createDataFrame([rows[k] for k in rng.permutation(24)], "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == [k for k in range(24) if k % 2 == 0 or not near[k // 2]]


def test_rows_without_id(spark, tmp_path):
    """Documents of no doc_id, or of one that names two texts, go through each stage as rows of their own."""
    rng = np.random.default_rng(31)
    fresh = lambda n: " ".join(f"q{x}" for x in rng.integers(0, 10**9, n))
    passage, near = fresh(40), fresh(200)
    texts = [None, "", "few words", fresh(60), fresh(60) + " " + passage + " " + fresh(60), passage + " " + fresh(50), near, near + " z", fresh(30)]
    rows = [(None, t, f"s{k % 2}", "en", -1) for k, t in enumerate(texts)]
    rows += [(5, fresh(40), "s0", "en", -1), (5, fresh(50) + " " + passage, "s1", "de", -1), (7, near, "s0", "en", -1), (8, fresh(20), "s0", "en", -1)]
    rows += [rows[3], rows[-1]]  # repeated rows
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").repartition(3).cache()
    spark.createDataFrame([(8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    many = lambda df, *names: Counter(tuple(r[n] for n in names) for r in df.collect())

    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert many(good, "doc_id", "text", "source", "lang") == Counter(r[:4] for r in rows if r[1] and len(r[1].split()) >= 10)

    single = corpus_pipeline.near_dedup(spark, docs, "")
    want = {r[:4] for r in rows if r[1] not in (near, near + " z") or r[0] == 7}
    assert many(single, "doc_id", "text", "source", "lang") == Counter(want)

    keep = docs.filter("text is not null")
    raw = [r[1].encode() for r in rows if r[1] is not None]
    count = Counter(t[i : i + 200] for t in raw for i in range(len(t) - 199))
    left = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            gone[i : i + 200] |= count[t[i : i + 200]] > 1
        left.append(bytes(b for b, g in zip(t, gone) if not g).decode())
    ids = [(r[0], r[2], r[3]) for r in rows if r[1] is not None]
    want = Counter((i[0], t, *i[1:], len(t)) for i, t in zip(ids, left) if t)
    assert many(corpus_pipeline.repeats(spark, keep, ""), "doc_id", "text", "source", "lang", "n_chars") == want
    sha = Counter((i[0], hashlib.sha256(t.encode()).hexdigest()) for i, t in zip(ids, left))
    assert many(remove_repeats(keep), "doc_id", "kept_sha256") == sha

    mixed = corpus_pipeline.mix(spark, docs, "").collect()
    assert {tuple(r) for r in mixed} <= set(rows) and any(r.doc_id is None for r in mixed)
    taken = mix_sources(docs).groupBy("source").agg({"taken": "sum"}).collect()
    size = {r[0]: r[1] for r in taken}
    for source in ("s0", "s1"):
        got = sum(len(r.text.split()) for r in mixed if r.source == source)
        assert abs(got - size[source]) <= 2 * max(len((r[1] or "").split()) for r in rows if r[2] == source)


def test_call_order(spark):
    rng, rows, level = np.random.default_rng(8), [], {}
    for conv, most in ((1, 1), (2, 3)):  # a chain of 300 calls, and calls with up to three references
        for k in range(300):
            after = [] if k == 0 else [k - 1] if most == 1 else sorted({int(x) for x in rng.integers(max(0, k - 9), k, rng.integers(0, most + 1))})
            level[conv, f"c{k}"] = 1 + max((level[conv, f"c{a}"] for a in after), default=-1)
            rows.append((conv, f"c{k}", [f"c{a}" for a in after] + ["gone"] * (k % 2), "x"))
    for a, b in (("p", "q"), ("q", "p"), ("r", "r"), ("s", "q")):  # cycles, and a call behind one
        rows.append((1, a, [b], "y"))
        level[1, a] = None
    rows.append((1, "t", ["s", "c5"], None))
    level[1, "t"] = None
    rows.append((1, "u", ["t"], None))
    level[1, "u"] = None
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, after array<string>, level string")
    found = tool_calls.order_calls(calls).collect()
    assert len(found) == len(rows) and {(r.conv_id, r.call_id): r.level for r in found} == level
