"""Work that stays in proportion, and bounds that hold for repeated rows."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from orderloom.llm import components, secrets, toxicity, warc


def test_an_archive_of_very_many_records_is_read_in_proportion():
    took = []
    for n in (4_000, 32_000):
        records = [warc.record(i, "http://h/x", b"<p>%d</p>" % i, warc.digest(b"<p>%d</p>" % i), None, "response") for i in range(n)]
        packed = warc.archive(records, warc.train(records[:2000]))
        began = time.perf_counter()
        got = [int(h[b"x-payload-length"]) for h, _ in warc.read_archive(packed)]
        took.append(time.perf_counter() - began)
        assert got == [len(b"<p>%d</p>" % i) for i in range(n)]
    assert took[1] < 24 * took[0]  # 64 times if it went with the square


def test_records_longer_than_what_is_fed_at_first():
    rnd = random.Random(1)
    bodies = [rnd.randbytes(n) for n in (0, 1, warc.FIRST_FED - 1, warc.FIRST_FED, 5 * warc.FIRST_FED, 300_000, 2)]
    records = [warc.record(i, "u", b, warc.digest(b), None, "response") for i, b in enumerate(bodies)]
    assert [bytes(b) for _, b in warc.read_archive(warc.archive(records, None))] == bodies


def masked(text, spans, mask="[SECRET]"):
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])


def test_redaction_of_very_many_spans(spark):
    rnd = random.Random(2)
    filler = lambda: rnd.choice(["é" * rnd.randint(1, 900), "𐐀 ", "\n", ""])
    long = "".join(f"{filler()}token=abcdef{i:05d} " for i in range(6000))
    edge = ["token=abcdefgh", "x" * secrets.BLOCK + "token=abcdefgh", "x" * (secrets.BLOCK - 3) + "token=abcdefgh" + "y" * 9 + " ", "token=" + "z" * (3 * secrets.BLOCK), "a secret=token=abcdef0 b"]
    texts = dict(enumerate([long, *edge, "nothing", None, ""]))
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in texts.items()], "doc_id long, text string, source string")
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in [*r["base"], *r["added"]]] for r in secrets.scan(docs).collect()}
    began = time.time()
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert time.time() - began < 60
    assert got == {i: t if t is None else masked(t, spans[i]) for i, t in texts.items()}
    assert len(spans[0]) >= 6000


def test_the_sample_of_the_field_keeps_its_bounds(spark):
    rnd = random.Random(3)
    rows = [(7, f"vile thing {i % 900}", 1) for i in range(3000)] + [(7, "the same words", 0)] * 3000 + [(i, " ".join(rnd.choice(["a", "vile", "b"]) for _ in range(9)), i % 2) for i in range(100, 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.Model({"vile": 2.0})
    for most_docs, most_marks in ((400, 10**6), (400, 150), (10**6, 10**6)):
        marks, y = toxicity._sample(docs, model, len(rows), most_docs, most_marks)
        assert len(y) == len(marks.size) == len(marks.count) <= most_docs and len(marks.at) <= most_marks
        assert len(y) > 50
    assert len(y) == len(rows)


def test_a_long_chain_is_one_component(spark):
    n = 3000
    order = list(range(n))
    random.Random(4).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)], "a long, b long")
    got = components.components(edges)
    assert got.count() == n and got.filter(F.col("root") != 0).count() == 0
