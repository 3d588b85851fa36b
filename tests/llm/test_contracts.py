"""Rows at the edge of the contracts: special tokens, numbers of any size, odd JSON, columns with names in use."""

import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tracemill.llm import tool_calls
from tracemill.llm.arc_convert import archive_pages
from tracemill.llm.best_fit import pack
from tracemill.llm.bwt_dedup import remove_repeats
from tracemill.llm.chosen_path import near_duplicates
from tracemill.llm.common import shared_folder
from tracemill.llm.one_bit_codes import nearest
from tracemill.llm.plane_files import read_ids, write_ids
from tracemill.llm.source_mix import mixed_rows

SPECIAL = ["a <|endoftext|> b", "<|startoftext|>x", "plain text", "<|endoftext|>", "x <|ENDOFTEXT|> y", None, ""]


def test_special_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string").repartition(3)
    for name, end, run in (("byte_bpe_50k.json", 0, lambda p: pack(docs, p, 2048, 0)),
                           ("word_bpe_49k.json", 2, lambda p: read_ids(write_ids(docs, p, 2, shared_folder(spark, "ids"))))):
        path = public_tokenizers.path(name)
        plain = Tokenizer.from_file(path)
        want = {k: np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4") for k, t in enumerate(SPECIAL)}
        assert {r.doc_id: r.ids_crc32 for r in run(path).collect()} == {k: zlib.crc32(v.tobytes()) for k, v in want.items()}


def test_null_ids_of_encoders(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, "c"), (1, "d")], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    assert Counter(r.doc_id for r in read_ids(write_ids(docs, path, 2, shared_folder(spark, "ids"))).collect()) == Counter([None, None, 1])
    assert Counter(r.doc_id for r in pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048, 0).collect()) == Counter([None, None, 1])


@pytest.mark.parametrize("factor", [1e200, 1e-200, 1e308])
def test_vectors_of_any_size(spark, factor):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 16))
    vectors[::9] *= factor if factor < 1e300 else 1e300
    rows = [(k, v.tolist(), 1.0, "x") for k, v in enumerate(vectors)] + [(None, vectors[0].tolist(), 2.0, "y"), (7, vectors[7].tolist(), 3.0, "z")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double, ids string")
    got = defaultdict(list)
    for r in nearest(frame, frame.filter("vec_id % 20 = 0"), k=20, block=32, group=8, slices=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 300, 20):
        with np.errstate(all="ignore"):
            scores = np.einsum("ij,j->i", vectors, vectors[q])
        scores = np.where(np.isnan(scores), -np.inf, scores)
        order = [int(v) for v in np.lexsort((np.arange(300), -scores)) if v != q][:20]
        hits += len({v for v, _ in got[q]} & set(order))
        assert [v for v, _ in got[q]][:2] == order[:2] and len(got[q]) == 20
    assert hits >= 0.98 * 20 * 15 and set(got) == set(range(0, 300, 20))
    assert nearest(frame.limit(0), frame.limit(0)).count() == 0


def test_odd_arguments(spark):
    deep = "[" * 100_000 + "]" * 100_000
    arguments = ['{"query":"\\ud800"}', '{"query":NaN}', '{"query":1e400}', '{"query":-Infinity}', f'{{"query":{deep}}}', '{"\\udfff":1}', '{"query":1.5}', ""]
    calls = spark.createDataFrame([(1, f"c{k}", k, "search", a, None, "j", True) for k, a in enumerate(arguments)],
                                  "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, json string, linked boolean")
    results = spark.createDataFrame([(1, "c0", "ok", 5)], "conv_id long, call_id string, content string, level int")
    out = {r.call_id: r for r in tool_calls.link_calls(calls, results, tool_calls.SCHEMAS).collect()}
    assert json.loads(out["c0"].json)["arguments"] == {"query": "\ud800"} and out["c0"].linked
    assert [out[f"c{k}"].errors for k in (1, 2, 3, 4, 7)] == [
        "/: not JSON", "/: number beyond double", "/: not JSON", "/: nested too deeply", "/: not JSON"]
    assert "\\udfff: unknown" in out["c5"].errors and json.loads(out["c5"].json)["arguments"] == {"\udfff": 1}
    strict = lambda x: pytest.fail(x)
    assert all(json.loads(r.json, parse_constant=strict) for r in out.values())


def clashing(spark):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    shared = text(60)
    rows = [(k, text(40) + " " + shared if k % 3 == 0 else text(60), f"s{k % 2}", "mine", 5, [k], k) for k in range(30)]
    rows.append((None, text(30), None, None, None, None, None))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, key_x string, key_y int, ranges array<int>, wanted long").repartition(3)


def test_columns_with_names_in_use(spark, tmp_path):
    rows, docs = clashing(spark)
    spark.createDataFrame([(8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    many = lambda df: Counter((r.doc_id, r.text, r.source, r.key_x, r.key_y, tuple(r.ranges or ()), r.wanted) for r in df.collect())
    want = Counter((*r[:5], tuple(r[5] or ()), r[6]) for r in rows)
    assert many(corpus_pipeline.quality(spark, docs, str(tmp_path))) == want
    assert many(corpus_pipeline.near_dedup(spark, docs, "")) == want
    cut = corpus_pipeline.repeats(spark, docs, "").collect()
    assert Counter((r.doc_id, r.key_x, r.key_y, r.wanted) for r in cut) == Counter((r[0], r[3], r[4], r[6]) for r in rows)
    assert set(many(mixed_rows(docs))) <= set(want)
    assert remove_repeats(docs, carry=("wanted", "ranges", "key_x")).count() == len(rows)
    assert near_duplicates(docs.withColumn("component_id", docs["wanted"])).count() == len(rows)


def test_pages_without_id(spark):
    rows = [(None, "http://a/", "same", "x"), (None, "http://b/", "same", "y"), (3, "http://c/", "same", "z"), (3, "http://c/", "same", "z"), (None, None, "own", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    out = archive_pages(pages).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in out) == Counter(
        [(None, "revisit", 3)] * 2 + [(3, "response", None), (3, "revisit", 3), (None, "response", None)])
