"""Fill-in-middle against a plain cut, exact restoring, and awkward rows. The SQL twin covers the test tables."""

import hashlib
import random
import re

import numpy as np

from wattfleet.llm import fill_middle


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


ODD = [None, "", "a", "A b\n\nc", "é日本 🙂 x1", "has <P> inside", "<", "<S", "a<b>c<", "<P", "P><S", "[@`{z", "\x00\x01", "word " * 9000, "x" * 70000]


def test_equals_a_plain_cut(spark):
    r = random.Random(1)
    texts = ODD * 4 + ["".join(r.choice("ab Z<>PSMé🙂\n") for _ in range(r.randrange(90))) for _ in range(500)]
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(texts)], "doc_id long, text string, form string, n int").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    real = {r["doc_id"]: tuple(r)[1:] for r in fill_middle.fill_in_middle(df).collect()}
    rows = {r["doc_id"]: r for r in fill_middle.report(df).collect()}
    assert len(rows) == len(texts) and {r["form"] for r in rows.values()} == {"plain", "psm", "spm"}
    for i, t in enumerate(texts):
        want = plain(i, t)
        assert real[i] == want
        assert (rows[i]["output_sha256"], rows[i]["restored_sha256"]) == (sha(want[-1]), sha(t or ""))


def test_every_rank_is_reached_exactly():
    for text in ("", "a", "ab cd.é" * 700, "." * 5000):
        lanes = fill_middle.Lanes()
        places = fill_middle.boundaries(text) if text else np.zeros(1, int)
        skip = fill_middle.SkipList(places, lanes)
        assert [skip.place(r) for r in range(skip.n + 1)] == places.tolist()
        for units, points, _ in skip.lanes:
            assert units.sum() <= skip.n and points.sum() <= len(text)
    assert len(skip.lanes) > 3 and len(skip.lanes[1][0]) < len(skip.lanes[0][0]) / 2


def test_null_and_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "some text"), (3, "one two three"), (3, "one two three")], "doc_id long, text string")
    rows = fill_middle.report(df).collect()
    assert len(rows) == 3 and len({tuple(r) for r in rows}) == 2
    assert fill_middle.report(df.limit(0)).count() == 0
