import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import tokens
from strata.llm.tokens import Encoder, portions

FILES = {"spaced": "byte_bpe_50k.json", "bare": "word_bpe_49k.json"}
PIECES = [*"abAZ09'  \n\t.,-!éÉßçñœ–€¡ ́²½µªº×中あ😀\x1c\x85\x01<|>", "'ll", "'s", "<|endoftext|>", "  ", "\n\n", " a", " Abc", "İ", "ſ", "Σ", "\r\n", " ́"]


@pytest.fixture(scope="module")
def encoders():
    return {k: Encoder(public_tokenizers.path(f)) for k, f in FILES.items()}


@pytest.mark.parametrize("kind", FILES)
def test_words_give_the_ids_of_whole_texts(encoders, kind):
    e = encoders[kind]
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    assert e.kind == kind and e(texts) == e._whole(texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES) | st.characters(exclude_categories=["Cs"]), max_size=25).map("".join), max_size=8))
def test_any_texts_give_the_ids_of_whole_texts(encoders, texts):
    for e in encoders.values():
        assert e(texts) == e._whole(texts)


def test_the_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MAX_KEPT", 10)
    e = Encoder(public_tokenizers.path(FILES["spaced"]))
    for k in range(20):
        texts = [f"w{k} {i}x" + "y" * 200 for i in range(12)]
        assert e(texts) == e._whole(texts)
        assert len(e.young) + len(e.old) < 150 and all(len(w) <= tokens.MAX_WORD for w in e.young)


def test_portions_hold_every_row_once():
    rows = pa.RecordBatch.from_pydict({"text": [None, "a" * 50, "", "b" * 500, "c"], "n": [0, 1, 2, 3, 4]})
    parts = list(portions(rows, 100))
    assert [x for p in parts for x in p["n"].to_pylist()] == [0, 1, 2, 3, 4] and len(parts) > 1
    assert list(portions(rows.slice(0, 0), 100)) == []


def test_released_encoders_are_made_again():
    name = public_tokenizers.path("byte_bpe_50k.json")
    first = tokens.encoder(name)
    ids = first(["a b", ""])
    tokens.release()
    tokens.release()
    assert tokens.encoder(name) is not first and tokens.encoder(name)(["a b", ""]) == ids
