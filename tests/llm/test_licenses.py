import random
import re

import pyarrow.parquet as pq

from strata.llm.licenses import BASE, LOWER, MIT, TEMPLATES, WORD, accepts, compile_template, covered, licenses
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.01"


def test_base_equals_brute_force(spark):
    got = {r.doc_id: r for r in QUERIES["op8_licenses"](spark, DIR).collect()}
    for d in pq.read_table(f"{DIR}/documents.parquet").to_pylist():
        w = WORD.findall(d["text"].translate(LOWER))
        at = [(i, label) for p, label in BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r, starts = got.pop(d["doc_id"]), [i for i, _ in at]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})))
    assert not got


def test_markup():
    a = compile_template("a [b c] {2} d")
    assert all(accepts(a, x.split(), 0) for x in ("a d", "a b c d", "a x y d", "a b c x y d"))
    assert not any(accepts(a, x.split(), 0) for x in ("a", "a x y z d", "b d"))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "!!"), (4, "Licensed under the GNU General Public License, version 3. cc by nc cc-by-nc")]
    got = {r.doc_id: r for r in licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].labels == "" and got[k].first_word is None for k in (1, 2, 3))
    assert (got[4].labels, got[4].n_base, got[4].last_word) == ("cc-by-nc,gpl-3", 2, 12)


def plain(template):
    """The template as a pattern over words that each end in a space."""
    out = ""
    for part in re.findall(r"\[[^\]]*\]|[^\[\]]+", template):
        own = "".join(f"(?:[^ ]+ ){{0,{x[1:-1]}}}" if x[0] == "{" else f"{x} " for x in part.strip("[]").split())
        out += f"(?:{own})?" if part[0] == "[" else own
    return re.compile(out)


def variant(rng, template):
    """A text that the template accepts, with one word changed half of the time."""
    words = []
    for part in re.findall(r"\[[^\]]*\]|[^\[\]]+", template):
        if part[0] != "[" or rng.random() < 0.5:
            for x in part.strip("[]").split():
                words += rng.choices(["the", "acme", "authors"], k=rng.randint(0, int(x[1:-1]))) if x[0] == "{" else [x]
    if rng.random() < 0.5:
        words[rng.randrange(len(words))] = "other"
    return words


def test_automata_equal_plain_patterns():
    rng = random.Random(3)
    for template, _ in TEMPLATES:
        automaton, pattern, seen = compile_template(template), plain(template), set()
        for _ in range(60):
            words = variant(rng, template)
            got = accepts(automaton, words, 0)
            assert got == bool(pattern.match("".join(w + " " for w in words))), words
            seen.add(got)
        assert seen == {True, False}


def test_scores_and_labels_of_whole_licences(spark):
    mit = re.sub(r"[\[\]]", "", MIT).replace("{4}", "this software").replace("{10}", "the authors").replace("\n", " ")
    notice = "Redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"
    rows = [(1, mit, 0), (2, mit[: len(mit) // 2], 0), (3, notice, 0), (3, notice, 0), (4, "plain words " * 50_000, 0), (5, "so " * 200_000 + mit, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long")
    got = {r.doc_id: r for r in licenses(docs).collect()}
    assert (got[1].labels, got[1].score, got[1].base_labels) == ("mit", 1.0, "") and got[2].labels == "" and 0.4 < got[2].score < 0.6
    assert (got[3].labels, got[4].labels, got[4].score, got[5].labels) == ("lgpl-2.1", "", 0.0, "mit")
    assert licenses(docs).count() == 6 and licenses(docs.limit(0)).count() == 0
    assert covered(compile_template("a b c d"), ["a", "b", "x"], 0) == 0.5
