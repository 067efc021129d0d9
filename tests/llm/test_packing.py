import zlib
from array import array
from collections import defaultdict

import public_tokenizers
import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strata.llm.packing import pack, plan
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"


@given(st.dictionaries(st.integers(1, 20), st.integers(1, 30)))
def test_plan_places_each_piece_once_without_gaps(counts):
    bins, ranks = defaultdict(list), defaultdict(list)
    for length, a, b, each, base, at in plan(counts, 20):
        for r in range(a, b + 1):
            bins[base + (r - a) // each].append((at + (r - a) % each * length, length))
            ranks[length].append(r)
    assert {x: list(range(n)) for x, n in counts.items()} == {x: sorted(r) for x, r in ranks.items()}
    for own in bins.values():
        end = 0
        for at, length in sorted(own):
            assert at == end
            end += length
        assert end <= 20


def test_equals_direct_encoding_and_fills_sequences(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = QUERIES["op6_best_fit_packing"](spark, DIR).toPandas().sort_values(["doc_id", "piece"])
    ids = {r["doc_id"]: array("I", [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]) for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    size = {k: len(v) for k, v in ids.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length]) for r in got.itertuples())
    assert got.groupby("doc_id").length.sum().to_dict() == size
    assert (got.groupby("doc_id").length.cumsum() - got.length == got.start).all()
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()
    assert own.groupby("sequence_id").length.sum().max() <= 2048
    assert own.sequence_id.nunique() <= 1.03 * -(-sum(size.values()) // 2048)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "a " * 3000, 0), (2, "", 0), (None, "x", 0)], "doc_id long, text string, length int")
    f = public_tokenizers.path("byte_bpe_50k.json")
    got = pack(docs, f, size=64, keep_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length <= 256 for r in got) and {r.doc_id for r in got} == {1, 2, None}
    assert pack(docs.limit(0), f).count() == 0
