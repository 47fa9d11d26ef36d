"""Registered queries over the whole smallest table against plain versions."""

import base64
import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import brute
from tillgrain.llm import queries


@pytest.fixture(scope="module")
def documents(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toArrow().to_pylist()]


def listed(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.toArrow().to_pylist()]


def test_op1(spark, sf, documents):
    got = {d: (n, c) for d, n, c in listed(queries.op1_ngram_join(spark, sf), "doc_id", "n_shingles", "component_id")}
    assert got == brute.jaccard(documents)


def test_op2(spark, sf, documents):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in documents:
        ids = np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((d, len(ids) // 4, hashlib.sha256(ids).hexdigest(), brute.sha((t or "").encode())))
    assert sorted(listed(queries.op2_byte_bpe(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) == sorted(want)


def test_op3(spark, sf, documents):
    got = listed(queries.op3_suffix_runs(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(got) == sorted(brute.suffixes(documents))


def test_op8(spark, sf, documents):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in listed(queries.op8_packing(spark, sf), "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        by_doc[row[0]].append(row), by_sequence[row[5]].append(row)
    assert set(by_doc) == {d for d, _ in documents}
    for d, t in documents:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        at = 0
        for _, start, length, crc, total, _, _ in sorted(by_doc[d], key=lambda r: r[1]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(np.array(ids[at:at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r[6]):
            assert r[6] == at
            at += r[2]
        assert at <= 2048
        total, padding = total + at, padding + (2048 - at if at & (at - 1) else 0)
    assert padding < 0.05 * total
