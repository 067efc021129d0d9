import hashlib
import random
import re

import pyarrow.parquet as pq

from strata.llm.pii import BEFORE, INSIDE, pii, redact
from strata.llm.registry import QUERIES

DIR = "/root/testdata/sf0.01"
BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(?:\.[0-9]+){3}"), ("card", r"[0-9](?:[\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    own = [int(x) * (1 + i % 2) for i, x in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in own) % 10 == 0


def brute(text):
    out = []
    for kind, p in BASE:
        for m in re.finditer(p, text or ""):
            d = re.sub(r"\D", "", m[0])
            if {"email": True, "ip": all(float(x) <= 255 for x in re.findall(r"\d+", m[0])), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def same(r, text):
    want = brute(text)
    n = [sum(x.startswith(k + ":") for x in want) for k, _ in BASE]
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == n, (text[:200], want, r)
    assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest() and r.spans.startswith(",".join(want))


def test_base_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DIR}/documents.parquet").to_pylist()}
    got = QUERIES["op7_pii"](spark, DIR).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        same(r, texts[r.doc_id])


def test_edges(spark):
    rows = [None, "", "é😀 a@b.c_d@e.f x@y a@b..c", "1.2.3.4.5.6.7.8 999.1.1.1 1.1.1", "4111 1111-1111 1111  41111111111111111111111 4111111111111111-", "+1 (017) 555-7713. +12", "x" * 10_000 + "@a.b", "1" * 10_000, "a@b" + ".c" * 20_000]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").selectExpr("*", "1 as base", "2 as row")
    for r in pii(docs).collect():
        same(r, rows[r.doc_id])
    got = {r.doc_id: r.text for r in redact(docs).collect()}
    assert got[0] is None and got[2] == "é😀 [email][email] x@y a@b..c" and got[5] == "[phone]. +12"
    assert pii(docs.limit(0)).count() == 0


def test_contexts_find_more(spark):
    rows = [(i, f"so card no: {'4' + '1' * 14 + str(i)} and") for i in range(10)]
    more = [(20, "so card no: AB12345678 and"), (21, "word AB99945678 and")]
    seeds = [(100 + i, f"his contact is u{i}@a.example") for i in range(9)] + [(110, "his contact is QX44556677")]
    got = {r.doc_id: r.spans for r in pii(spark.createDataFrame(rows + more + seeds, "doc_id long, text string")).collect()}
    assert got[110] == "context:15:25" and got[21] == ""


def spans(spark, texts):
    return {r.doc_id: r.spans for r in pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_words_before_ordinary_words_are_no_contexts(spark):
    seeds = [f"by the u{i}@a.example" for i in range(5)]
    got = spans(spark, ["by the 1234567890123456 end"] + seeds + [f"and the cat{x} sat" for x in "abcdefghij"])
    assert got[0] == "" and all(got[k].startswith("email:") for k in range(1, 6))
    # Without the ordinary words the same context is sure, however often one of its instances is repeated.
    assert spans(spark, ["by the 1234567890123456 end"] + seeds + ["by the u0@a.example"] * 20)[0] == "context:7:23"


def test_found_instances_admit_patterns_without_seeds(spark):
    known = [f"ID4455667{i}" for i in range(5)]
    got = spans(spark, ["our ref: QX99887766 end"] + [f"his contact: u{i}@a.example" for i in range(20)] + [f"his contact: {x}" for x in known] + [f"our ref: {x}" for x in known])
    assert got[0] == "context:9:19"


def test_every_context_of_a_word_is_counted(spark):
    text = "one  two - three (four) a:b-c x - - y tel +49 \u00e9\u00e9 end"
    got = spark.createDataFrame([(text,)], "text string").selectExpr(f"regexp_extract_all(text, r'{BEFORE}', 1) as x", f"regexp_extract_all(text, r'{INSIDE}', 1) as y").first()
    assert got.x == ["one  ", "two - ", "- ", "three (", "(four) ", "a:b-c ", "- - ", "- ", "y ", "tel ", "+49 ", "\u00e9\u00e9 "]
    assert {"(", "a:", "a:b-"} <= set(got.y)


def test_many_matches_in_one_text(spark):
    from time import time

    text = " ".join(f"u{i}@a.example AB{i:06}-x" for i in range(16_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begun = time()
    same(pii(docs).first(), text)
    got = redact(docs).first().text
    # Everything follows an e-mail or a code here, so codes may be found as well.
    assert re.fullmatch(r"(\[email\] (AB\d{6}-x|\[context\]) ?)+", got) and time() - begun < 60


def test_keys_show_the_context_of_other_identifiers(spark):
    keys = [f"so api = '{hashlib.md5(str(i).encode()).hexdigest()}' and" for i in range(8)]
    got = spans(spark, keys + ["so api = 'QX-445-566-77-" + "z9" * 60 + "' and", "commit " + "a1" * 20])
    assert got[8] == "context:10:144" and got[9] == "" and all(got[k] == "context:10:42" for k in range(8))


def test_pieces_agree_with_plain_replacement(spark):
    rng = random.Random(5)
    parts = ["a@b.c", "1.2.3.4", "+1 (017) 555-7713", "é😀", " ", ".", "4111 1111 1111 1111", "x1.2.3.4@b.c"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found, got = {r.doc_id: r for r in pii(docs).collect()}, {r.doc_id: r.text for r in redact(docs).collect()}
    for i, text in enumerate(texts):
        same(found[i], text)
        at, out = 0, ""
        for a, b, kind in sorted((int(a), int(b), kind) for kind, a, b in (x.split(":") for x in found[i].spans.split(",") if x)):
            out, at = out + (text[at:a] + f"[{kind}]" if a >= at else ""), max(at, b)
        assert got[i] == out + text[at:]
