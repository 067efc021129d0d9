import re
import zlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import test_decontaminate
import test_near_dedup
import test_pii
from tokenizers import Tokenizer

DIR = "/root/testdata/sf0.001"


def test_pipeline_packs_kept_documents_once(spark):
    got = corpus_pipeline.run(spark, DIR).toPandas()
    ids = {r.doc_id for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    assert set(got.doc_id) <= ids and len(got) > 0 and not got.duplicated(["doc_id", "piece"]).any()
    own = got.sort_values(["sequence_id", "offset"])
    assert (own.groupby("sequence_id").length.cumsum() - own.length == own.offset).all()


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in pairs], COLUMNS)


def test_rows_without_doc_id_stay(spark):
    plain = [(None, "one two three four five six seven"), (None, "a plain text of its own"), (7, "some other plain text"), (3, "a text held twice under two ids"), (5, "a text held twice under two ids"), (None, "a text held twice under two ids")]
    own = {(None, plain[0][1]), (None, plain[1][1]), (7, plain[2][1]), (3, plain[3][1])}
    for pairs in (plain, plain[::-1]):
        got = [(r.doc_id, r.text) for r in corpus_pipeline.dedup(spark, rows(spark, pairs), DIR).collect()]
        assert len(got) == 4 and set(got) == own
    left = corpus_pipeline.decontamination(spark, rows(spark, plain), DIR).collect()
    assert len(left) == len(plain) and {r.text for r in left} == {t for _, t in plain}
    packed = corpus_pipeline.packing(spark, rows(spark, plain[:3]), DIR).collect()
    assert sorted(r.doc_id or 0 for r in packed) == [0, 0, 7]


def test_whole_short_items_remove_documents(spark, tmp_path):
    items = [(1, "who wrote Faust"), (2, "one two three four five six seven eight nine")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["so who wrote faust then", "who wrote it", "a one two three four five six seven eight b", "one two three four five six seven"]
    got = corpus_pipeline.decontamination(spark, rows(spark, list(enumerate(texts))), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def masked(text):
    """The text with its base personal data replaced by their kinds."""
    out, at = "", 0
    for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in test_pii.brute(text))):
        if a >= at:
            out += text[at:a] + f"[{kind}]"
        at = max(at, b)
    return out + text[at:]


@pytest.fixture(scope="module")
def source(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    return docs, {r.doc_id: r.text for r in docs.collect()}


def stage(spark, source, name):
    return dict(corpus_pipeline.STAGES)[name](spark, source[0], DIR).collect()


def test_language_keeps_documents_with_letters(spark, source):
    assert sorted(r.doc_id for r in stage(spark, source, "language_id")) == sorted(i for i, t in source[1].items() if re.search(r"[^\W\d_]", t or ""))


def test_dedup_equals_brute_force_components(spark, source):
    want = sorted(i for i, (_, root) in test_near_dedup.brute(list(source[1].items()), 5, 80).items() if i == root)
    assert sorted(r.doc_id for r in stage(spark, source, "near_dedup")) == want and len(want) < len(source[1])


def test_decontamination_equals_brute_force_windows(spark, source):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = sorted(r[0] for r in test_decontaminate.brute(list(source[1].items()), items) if not r[3])
    assert sorted(r.doc_id for r in stage(spark, source, "decontamination")) == want and len(want) < len(source[1])


def test_pii_equals_brute_force_masks(spark, source):
    want = {i: masked(t) for i, t in source[1].items()}
    got = stage(spark, source, "pii")
    assert {r.doc_id: r.text for r in got} == want and want != source[1]
    assert all(r.n_chars == len(r.text) for r in got)


def test_packing_equals_direct_encoding(spark, source):
    t, got = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), defaultdict(dict)
    for r in stage(spark, source, "packing"):
        got[r.doc_id][r.start] = (r.length, r.ids_crc32)
    assert got.keys() == source[1].keys()
    for i, text in source[1].items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert sum(n for n, _ in got[i].values()) == len(ids)
        assert all(zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a : a + n])) == crc for a, (n, crc) in got[i].items())


@pytest.mark.parametrize("kept", [8, 0])
def test_odd_and_empty_tables(spark, tmp_path, kept):
    spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = "".join(f"word{i} " for i in range(30_000))
    texts = [(1, None), (2, ""), (3, "123 !!"), (4, long), (5, "a text held twice"), (5, "a text held twice"), (None, "a text of no id"), (7, "and one two three four five six seven eight")]
    docs = rows(spark, [(i, t or "") for i, t in texts]).limit(0)
    if kept:
        docs = spark.createDataFrame([(i, t, None if i == 4 else "en", None, None, "x", 1) for i, t in texts], f"{COLUMNS}, row string, kept int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted({r.doc_id or 0 for r in got}) == ([0, 4, 5] if kept else [])
    assert sum(r.piece == 0 for r in got) == (3 if kept else 0)
