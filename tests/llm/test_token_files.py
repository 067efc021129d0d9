import zlib

import numpy as np
import public_tokenizers
import pytest
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from strata.llm import dac
from strata.llm.registry import QUERIES
from strata.llm.token_files import token_at, token_files, write

DIR = "/root/testdata/sf0.001"


def test_codes_round_trip_and_random_access():
    ids = np.random.default_rng(1).integers(0, 2**32, 3000, dtype="u4") >> np.random.default_rng(2).integers(0, 32, 3000).astype("u4")
    for x in (ids, ids[:0], ids[:1], ids[:513]):
        r = dac.Reader(dac.pack(x))
        assert (r.all() == x).all() and [r[i] for i in range(len(x))] == x.tolist()


def test_equals_direct_encoding(spark):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(pq.read_table(f"{DIR}/documents.parquet").to_pylist(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 1], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in QUERIES["op2_token_files"](spark, DIR).collect()) == want


def test_edges(spark):
    docs = spark.createDataFrame([(2, None, 0), (5, "", 0), (5, "", 0)], "doc_id long, text string, start int")
    f = public_tokenizers.path("word_bpe_49k.json")
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in token_files(docs, f).collect()) == [(2, 0, 1), (5, 1, 1), (5, 2, 1)]
    assert token_files(docs.limit(0), f).count() == 0


def test_any_token_by_its_number(spark, tmp_path):
    f = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(3, "some words, and more"), (1, "x" * 20_000), (None, "y"), (2, None)], "doc_id long, text string")
    write(docs, f, 1, f"{tmp_path}/t")
    t = Tokenizer.from_file(f)
    want = [i for text in ("y", "x" * 20_000, "", "some words, and more") for i in [*t.encode(text, add_special_tokens=False).ids, 1]]
    for at in (0, 1, 2, len(want) // 2, len(want) - 2, len(want) - 1):
        assert token_at(spark, f"{tmp_path}/t", at) == want[at]
    for at in (-1, len(want)):
        with pytest.raises(IndexError):
            token_at(spark, f"{tmp_path}/t", at)
