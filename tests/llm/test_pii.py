import hashlib
import itertools
import re

import numpy as np

from flowsieve.llm import pii

FOLDER = "/root/testdata/sf0.01"
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_equals_the_patterns():
    rng = np.random.default_rng(5)
    for _ in range(3000):
        text = "".join(rng.choice(list("aZ9012 .@+-()é,"), rng.integers(0, 60)))
        assert pii.base_spans(text) == plain(text), text


def test_whole_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    got = pii.op3_pii(spark, FOLDER).collect()
    assert len(got) == len(docs)
    extra = 0
    for r in got:
        base = plain(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {(k, int(a), int(b)) for k, a, b in spans} >= set(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.n_added == len(spans) - len(base)
        extra += r.n_added
        if not re.search("[0-9@+]", docs[r.doc_id]):
            assert not spans
    assert extra < 0.2 * sum(len(plain(t)) for t in docs.values())


def test_field_adds_what_a_pattern_swallows():
    field = pii.trained()
    text = "to anatouing +1 (314) 555-6532 46636226175123 and"
    assert pii.base_spans(text) == [] or all(k != "phone" for k, *_ in pii.base_spans(text))
    assert ("phone", 13, 30) in pii.all_spans([text], field)[0][1]
    clean = ["It was 2024-10-12, 12:30, version 1.2.3 for $15.99 (20% off).", "no digits here", "Room 12 34, page 5-7", ""]
    assert all(s == [] for _, s in pii.all_spans(clean, field))


def test_viterbi_finds_the_best_path():
    field = pii.trained()
    parts = [p[1][:4] for t, _ in pii.training_table()[:20] for p in pii.parts_of(t)]
    for feats, path in zip(parts, field.decode(parts)):
        s = field.scores(feats)
        score = lambda p: field.start[p[0]] + sum(s[t, y] for t, y in enumerate(p)) + sum(field.move[a, b] for a, b in zip(p, p[1:]))
        assert np.isclose(score(path), max(map(score, itertools.product(range(len(pii.LABELS)), repeat=len(feats)))))


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", None), (None, "ann@example.org é +49 170 1234567", None), (4, "a" * 200_000 + "1" * 50_000 + " 1.2.3.4", "x"), (4, "1.2.3.4", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {(r.doc_id, r.spans) for r in pii.find(docs).collect()}
    assert out == {(1, ""), (2, ""), (None, "email:0:15,phone:18:33"), (4, "ip:250001:250008"), (4, "ip:0:7")}
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    assert {r.text for r in redacted.where("doc_id IS NULL OR doc_id < 3").collect()} == {None, "", "<email> é <phone>"}
    assert pii.find(docs.where("false")).count() == 0
