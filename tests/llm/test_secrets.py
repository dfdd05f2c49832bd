import random
import re
import time

import pytest
from pyspark.sql import functions as F

from massgrid.llm import secrets


@pytest.fixture(scope="module")
def model(spark):
    return secrets.Model.trained(secrets.samples(spark, 3000))


def base(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
    for kind, pattern, least in ((1, "AKIA[A-Z0-9]+", 16), (2, "[0-9a-f]+", 32)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


TEXTS = [
    'x Token = "abcdefgh" token=short PASSWORD:"qqqqqqqqq é token: token=abcdefghij',
    "😀 AKIA" + "B" * 16 + " AKIAB AKIAKIA" + "C" * 9 + " " + "0a" * 20 + "G" + "f" * 31,
    "api_key='a.b-c_d=e/f+g' apikey=12345678 secret : zzzzzzzz\npasswd=" + "x" * 5000,
    "Zk93mXq81LpWv7Rt2YbN4cQs and fooBarBazManagerFactory2 in /en/region/update/list/2024/items",
]


def test_base_spans(table, odd_texts, model):
    texts = TEXTS + odd_texts
    for r in secrets.scan(table(texts), model).collect():
        assert [(s.start, s.kind, s.end) for s in r.base] == base(texts[r.doc_id] or "")


def test_held_out_strings(spark, model):
    """Strings and identifiers that the samples do not hold."""
    other = secrets.samples(spark, 6000).join(secrets.samples(spark, 3000), ["random", "s"], "left_anti")
    rows = {r.random: r.share for r in other.groupBy("random").agg(F.avg((model.score(F.col("s")) > model.threshold).cast("int")).alias("share")).collect()}
    assert rows[True] > 0.98 and rows[False] < 0.02


def test_random_runs_and_redaction(table, model):
    rows = {r.doc_id: r for r in secrets.scan(table(TEXTS), model).collect()}
    assert [s.s for s in rows[3].added] == ["Zk93mXq81LpWv7Rt2YbN4cQs"]
    docs = table(TEXTS + [None, ""])
    clean = secrets.cleaned(docs, model)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[3].startswith("[SECRET] and fooBar") and got[5] == ""
    assert got[0] == 'x [SECRET]" token=short [SECRET] é [SECRET]'


def test_empty_table(empty, model):
    assert secrets.scan(empty, model).count() == 0


def test_random_parts_of_ordinary_runs(table, model):
    key, tail, letters = "Zk93mXq81LpWv7Rt2YbN4cQs", "Qv8Zr2LmXw9KtY4bNc7Hd3Pj", "ZkQmXqVLpWvJRtYbNWcQsXzKgH"
    path = "hostname/configuration/of/the/document/processing/service/region/update/list/"
    texts = [path + key + "/items", "0123456789abcdef" * 2 + "-" + tail, f"a {letters} b", "-" * 40 + " " + "12345" * 6, path + "element"]
    got = {r.doc_id: [(s.start, s.end) for s in r.added] for r in secrets.scan(table(texts), model).collect()}
    assert got == {0: [(len(path), len(path) + 24)], 1: [(32, 57)], 2: [(2, 28)], 3: [], 4: []}


def added(text, spans, model):
    """Random spans by plain Python: runs of what the base spans leave, and parts of ordinary runs."""
    blank = list(text)
    for start, _, end in spans:
        blank[start:end] = " " * (end - start)
    size, sign = len(secrets.ALPHABET), secrets.ALPHABET.index

    def random(s):
        ratio = sum(model.weights[sign(a) * size + sign(b)] for a, b in zip(s, s[1:])) / (len(s) - 1)
        return re.search("[A-Za-z]", s) is not None and ratio > model.threshold

    out = []
    for run in re.finditer(secrets.RUN, "".join(blank), re.A):
        if random(run[0]):
            out.append((run.start(), run.end()))
        elif re.search("[+/_=-]", run[0]):
            out += [(run.start() + p.start(), run.start() + p.end()) for p in re.finditer(secrets.PART, run[0], re.A) if random(p[0])]
    return out


def redacted(text, spans):
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_against_plain_python(table, odd_texts, model):
    rng = random.Random(5)
    signs = "abcdefABCDEF0123456789+/_=- é😀\"':"
    pieces = ["token=", "password: ", "AKIA", "secret='", "hostname/of/the/service/region/update/list", "fooBarBazManagerFactoryIndex", " ", "\n"]

    def piece():
        return rng.choice(pieces) if rng.random() < 0.4 else "".join(rng.choices(signs if rng.random() < 0.5 else "0123456789abcdef", k=rng.randint(1, 60)))

    texts = TEXTS + odd_texts + ["".join(piece() for _ in range(rng.randint(1, 120))) for _ in range(150)] + ["x " * 1100 + "ab" * 300 + " token=abcdefghij " * 200]
    docs = table(texts)
    clean = {r.doc_id: r.text for r in secrets.cleaned(docs, model).collect()}
    for r in secrets.scan(docs, model).collect():
        text = texts[r.doc_id] or ""
        want = added(text, base(text), model)
        assert [(s.start, s.end) for s in r.added] == want
        assert (clean[r.doc_id] or "") == redacted(text, [(a, b) for a, _, b in base(text)] + want)


def test_long_texts(table, model):
    rng = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["".join(rng.choices(letters, k=1_000_000)), " ".join("".join(rng.choices(letters, k=22)) for _ in range(30_000)), "0123456789abcdef0123456789abcdef " * 20_000]
    start = time.monotonic()
    rows = sorted((r.doc_id, len(r.base), len(r.added)) for r in secrets.scan(table(texts), model).collect())
    assert [r[:2] for r in rows] == [(0, 0), (1, 0), (2, 20_000)] and rows[0][2] == 1 and rows[1][2] > 29_000
    assert {r.doc_id: r.text for r in secrets.cleaned(table(texts), model).collect()}[2] == "[SECRET] " * 20_000
    assert time.monotonic() - start < 60
