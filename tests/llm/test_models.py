import math
import re
import zlib

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from strata.llm.language import SPAN, Judge, emissions, fit, held_out, language_id, learn, predict, quotas, sample
from strata.llm.quality import quality
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.01"
ROWS = [(1, None), (2, ""), (3, "123 !!"), (4, "x" * 300_000), (5, "the and of " * 40_000), (5, "the"), (None, "the")]


def test_language_accuracy_on_held_out_documents(spark):
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    got = QUERIES["op3_language_id"](spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in own) >= 0.97 * len(own)


def test_language_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "cast(null as string) as lang", "1 as score")
    assert {r.lang_pred for r in language_id(docs).collect()} == {"und"}
    model = learn(spark.read.parquet(f"{DIR}/documents.parquet"), ~held_out())
    got = [(r.doc_id, r.lang_pred) for r in predict(docs.select("doc_id", "text"), model).collect()]
    assert len(got) == len(ROWS) and {i for i, x in got if x == "und"} == {1, 2, 3} and dict(got)[5] == "en"
    assert language_id(docs.limit(0)).count() == 0


def test_quality_on_held_out_documents(spark):
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{DIR}/labels.parquet").to_pylist()}
    got = QUERIES["op10_quality"](spark, DIR).collect()
    own = [(r.score, label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    good, bad = [s for s, y in own if y == 1], [s for s, y in own if y == 0]
    assert sum((a > b) + 0.5 * (a == b) for a in good for b in bad) >= 0.85 * len(good) * len(bad)
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)


def test_quality_edges(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'z' as y", "1 as x")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(4, 1), (5, 0), (5, 0), (2, 1), (3, None), (1, 1)], "doc_id long, quality int")
    assert quality(docs, some).count() == len(ROWS) and quality(docs.limit(0), some).count() == 0


def test_language_sample_is_distinct_whole_texts_of_every_label(spark):
    assert quotas({"a": 5000, "b": 3, "c": 5000}) == {"a": 598, "b": 3, "c": 599}
    long = "first " * 1000 + "later " * 3000
    rows = [(i, "one text held many times", "en") for i in range(1500)] + [(2000 + i, f"text number {i}", "en") for i in range(1400)] + [(9000, "ein seltener text", "de"), (9001, long, "fr")]
    got = sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert 1150 <= len(got) == len(set(got)) <= 1200 and {y for _, y in got} == {"en", "de", "fr"}
    assert [t for t, y in got if y == "fr"] == [long]


def test_language_needs_a_letter_and_keeps_any_columns(spark):
    texts = ["\u00b2\u00bd\u2460", "12 34 _ !", "\u2160", "x\u00b2", "\U0001f600", "the \u00b2 of"]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string, _tag int")
    got = predict(docs, fit([("the of and", "en"), ("der die und", "de")])).toDF("doc_id", "text", "had", "tag", "lang_pred", "score").collect()
    assert [(r.text, r.lang_pred == "und", r.score > 0, r.had, r.tag) for r in got] == [(t, i not in (3, 5), i in (3, 5), "a", 1) for i, t in enumerate(texts)]


def by_brute_force(text, model):
    """Label by forward-backward in plain Python, word by word."""
    labels, weights, trans = model
    words = [w for w in re.findall(r"[^\W\d_]+", text) if any(map(str.isalpha, w))]
    total = [0.0] * len(labels)
    for a in range(0, len(words), SPAN):
        e = [[math.exp(x) for x in emissions([w], weights)[0]] for w in words[a : a + SPAN]]
        m, k = [[math.exp(x) for x in row] for row in trans], range(len(labels))
        fwd, back = [e[0]], [[1.0] * len(labels)]
        for row in e[1:]:
            fwd.append([sum(fwd[-1][i] * m[i][j] for i in k) * row[j] for j in k])
        for row in e[:0:-1]:
            back.append([sum(m[i][j] * row[j] * back[-1][j] for j in k) for i in k])
        for f, b in zip(fwd, back[::-1]):
            z = sum(f[i] * b[i] for i in k)
            total = [t + f[i] * b[i] / z for i, t in enumerate(total)]
    return [t / max(1, len(words)) for t in total]


def test_language_equals_brute_force(spark):
    docs = pq.read_table(f"{DIR}/documents.parquet").to_pylist()[:60]
    model = fit([(r["text"][:500], r["lang"]) for r in docs])
    # Runs short enough for plain products of exponentials.
    texts = [r["text"][:250] for r in docs] + ["a", "", "z" * 3000]
    named, score = Judge(*model)(texts)
    for t, y, s in zip(texts, named, score):
        want = by_brute_force(t, model)
        assert (y, s) == ("und", 0.0) if not t else abs(max(want) - s) < 1e-4 and want[model[0].index(y)] > max(want) - 1e-4
