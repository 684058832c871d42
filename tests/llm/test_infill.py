"""Fill-in-the-middle arrangements against a plain Python version, on odd rows."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import infill


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    key = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), digest(f"<S>{suffix}<P>{prefix}<M>{middle}"), digest(text)
    return doc_id, n, "psm", len(prefix), len(middle), digest(f"<P>{prefix}<S>{suffix}<M>{middle}"), digest(text)


def check(spark, data):
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in data], "doc_id long, text string, units string, n int, fim string").repartition(2)
    got = sorted((tuple(r) for r in infill.digests(docs).collect()), key=str)
    assert got == sorted((brute(i, t) for i, t in data), key=str)


def test_odd_rows(spark):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice(["word", "é", "𝒳", " ", "\n", "<", "<S", ">", "P>", "\x00", "7"]) for _ in range(n))
    data = [(i, text(rng.randint(0, 40))) for i in range(120)]
    data += [(None, None), (None, "no number here"), (500, None), (501, ""), (502, " "), (503, "a<P>b"), (504, "<S>"), (505, "x<M>"), (506, "<<"), (1, "again"), (1, "again"), (-7, "below zero"), (507, "𝒳" * 5), (508, text(60_000))]
    check(spark, data)


def test_empty_table(spark):
    assert infill.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a b c", "kept")], "doc_id long, text string, units string")
    out = infill.arranged(docs, infill.Rates(plain=0, spm=0)).first()
    assert out.units == "kept" and out.text == "a b c" and out.fim.form == "psm"
    assert out.fim.output == f"<P>{out.fim.prefix}<S>{out.fim.suffix}<M>{out.fim.middle}"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab<>PSM é\n", max_size=30), min_size=1, max_size=40))
def test_any_text_comes_back(spark, texts):
    check(spark, list(enumerate(texts)))
