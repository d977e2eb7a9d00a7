"""Registered corpus queries over the smallest given tables, against plain versions."""

from __future__ import annotations

import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from llm import brute
from wardlake.llm import bpe, pii
from wardlake.llm.queries import PSEUDONYM_KEY, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet'").fetchall()


def table(spark, name, *columns):
    return {r[0]: tuple(r)[1:] for r in QUERIES[name](spark, SF).select(*columns).collect()}


def test_names():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


def test_op1(spark, documents):
    rows = QUERIES["op1_best_fit_packing"](spark, SF).collect()
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert {r.doc_id for r in rows} == {d for d, *_ in documents} and max(filled.values()) <= 2048
    assert len(filled) <= 1.02 * brute.best_fit_decreasing([r.length for r in rows], 2048) + 1


def test_op2(spark, documents):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    want = {}
    for d, t, _ in documents:
        ids = library.encode_ordinary(t or "")
        want[d] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert table(spark, "op2_byte_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op3(spark, documents):
    got = table(spark, "op3_quality_nbsvm", "doc_id", "held_out", "score", "predicted")
    assert set(got) == {d for d, *_ in documents}
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) and p == int(s >= 0.5) for d, (h, s, p) in got.items())


def test_op4(spark, documents):
    got = table(spark, "op4_two_pass_shards", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    assert {d: v[:2] for d, v in got.items()} == {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, _ in documents}
    counts = np.bincount([v[3] for v in got.values()], minlength=16)
    assert counts.max() - counts.min() <= 1 and {v[2] for v in got.values()} == {"rows"}
    assert sorted((v[3], v[4]) for v in got.values()) == [(s, i) for s in range(16) for i in range(counts[s])]


def test_op5(spark, documents):
    want = {d: pii.pseudonymise_text(t, PSEUDONYM_KEY.encode()) for d, t, _ in documents if t is not None}
    assert table(spark, "op5_feistel_pseudonyms", "doc_id", "text", "n_replaced") == want


def personal_numbers(text):
    """Numbers with a country code and brackets, and addresses, found without the patterns of ``pii``."""
    phones = set(re.findall(r"\+[0-9]+ \([0-9]+\) [0-9]+-[0-9]+", text))
    words = {w.strip(".,;:!?()'\"") for w in text.split()}
    plain = {w for w in words if w.count(".") == 3 and all(p.isdigit() and p == str(int(p)) and int(p) < 256 for p in w.split("."))}
    return phones | {w for w in plain if int(w.split(".")[0]) not in (0, 10, 127)}


def test_op5_leaves_no_number_of_an_independent_finder(spark, tmp_path):
    given = duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    own = [(-1, "call +1 (017) 555-7713 or +1 (139) 555-2766, +44 (20) 7946-0958"), (-2, "hosts 224.0.0.251 and 255.12.3.4."), (-3, "+1 (239) 155-1234")]
    spark.createDataFrame([*given, *own], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    new = {r.doc_id: r.text for r in QUERIES["op5_feistel_pseudonyms"](spark, str(tmp_path)).collect()}
    before = {d: personal_numbers(t) for d, t in [*given, *own]}
    assert [len(before[d]) for d, _ in own] == [3, 2, 1] and len(new) == len(before)
    assert {d: f & personal_numbers(new[d]) for d, f in before.items() if f & personal_numbers(new[d])} == {}
    assert all(len(personal_numbers(new[d])) == len(f) for d, f in before.items())
    assert all(pii.pseudonymise_text(new[d], PSEUDONYM_KEY.encode(), back=True)[0] == t for d, t in [*given, *own])


def test_op6(spark, documents):
    got = table(spark, "op6_digest_index", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute.equal_texts([r[:2] for r in documents])


def test_op7(spark, documents):
    got = table(spark, "op7_doubling_windows", "doc_id", "n_words", "n_removed", "kept_sha256")
    assert got == brute.repeats([r[:2] for r in documents])


def test_op8(spark, documents):
    assert table(spark, "op8_jaccard_tiles", "doc_id", "n_shingles", "component_id") == brute.jaccard([r[:2] for r in documents])


def repeated_rows(spark, path):
    text = "nine words make a text that is long enough"
    rows = [(None, text), (None, text), (None, text), (3, "other words stand here and they are six or more"), (4, "")]
    rows += [(3, "other words stand here and they are six or more"), (4, ""), (None, "some text without an id that is there once")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, "en", f"s{i}", len(t)) for i, (d, t) in enumerate(rows)], schema).write.parquet(path)
    return rows


def test_op8_has_a_result_for_every_row(spark, tmp_path):
    rows = repeated_rows(spark, f"{tmp_path}/documents.parquet")
    got = QUERIES["op8_jaccard_tiles"](spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    assert sorted(r.n_shingles for r in got) == sorted(max(len(t.split()) - 2, 0) for _, t in rows)


def test_one_row_of_each_document_passes_the_near_duplicate_stage(spark, tmp_path):
    import corpus_pipeline

    rows = repeated_rows(spark, f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    filled = [(d, t) for d, t, _ in got if t]
    assert sorted(filled, key=str) == sorted({(d, t) for d, t in rows if t}, key=str)
    assert [(d, t) for d, t, _ in got if not t] == [(4, ""), (4, "")]
    assert {s for _, t, s in got if t} == {"s0", "s3", "s7"}


def test_op9(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet'").fetchall()
    want = brute.nearest(rows, lambda i: i % 20 == 0, 20)
    got = {}
    for r in QUERIES["op9_hilbert_windows"](spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {i for i, _ in w}) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_op10(spark, documents):
    assert table(spark, "op10_line_spread", "doc_id", "n_lines", "n_removed", "text_sha256") == brute.line_spread(documents)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = corpus_pipeline.Scratch(spark, "test").write(stage(spark, seen, SF), name)
        assert seen.columns == docs.columns, name
    rows = seen.select("doc_id", "text").collect()
    left = brute.jaccard([tuple(r) for r in rows], 5, 80)
    groups = [c for _, c in left.values()]
    assert len(set(groups)) == len(groups)  # one document of each group is left
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in rows}
