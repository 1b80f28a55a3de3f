"""Token alignment against a plain double loop, both ways of counting, and awkward rows."""

import hashlib
import os
from collections import Counter, defaultdict

import pytest

from wattfleet.llm import alignment

public = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    return alignment.load(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))


def brute(texts):
    """Tokens by the libraries, links and groups by comparing every two byte ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    lib_a, lib_b = Tokenizer.from_file(public.path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    lib_a.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    spell_a = lambda i: bytes(letters[c] for c in lib_a.id_to_token(i))
    spell_b = lambda i: bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode()
    out, count = [], Counter()
    for t in texts:
        a, b = (lib_a.encode(" " + t, add_special_tokens=False).ids, lib_b.encode(t)) if t else ([], [])
        x, y = [spell_a(i) for i in a], [spell_b(i) for i in b]
        if b"".join(x) != (" " + (t or "")).encode() or b"".join(y) != b"".join(x):
            a, b, x, y = [], [], [], []
        spans = []
        for parts in (x, y):
            at, s = 0, []
            for p in parts:
                s.append((at, at + len(p)))
                at += len(p)
            spans.append(s)
        links = [(i, j) for i, (s, e) in enumerate(spans[0]) for j, (p, q) in enumerate(spans[1]) if s < q and p < e]
        ends, groups, low = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}), [], 0
        for e in ends:
            part = ["," .join(str(i) for i, (_, q) in zip(ids, s, strict=True) if low < q <= e) for ids, s in zip((a, b), spans, strict=True)]
            groups.append("|".join(part))
            low = e
        ids = [(a[i], b[j]) for i, j in links]
        count.update(ids)
        out.append((len(a), len(b), len(ends), ids, ";".join(groups)))
    most = defaultdict(int)
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    return [(na, nb, ng, len(ids), sum(count[p] == most[p[1]] for p in ids), sum(count[p] for p in ids),
             hashlib.sha256(g.encode()).hexdigest() if na else "") for na, nb, ng, ids, g in out]


ODD = [None, "", " ", "  two  blanks ", "a▁b", "é日本語 <|endoftext|> <s>", "tab\tand\nline\r\n\n", "x" * 300, "🙂 smile", "it's fine. It's  fine!", "it's fine. It's  fine!"]


@pytest.mark.parametrize("known", [0, 40, 1 << 20])
def test_equals_the_double_loop(spark, known):
    texts = ODD + ([r[0][:1500] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(25).collect()] if os.path.isdir(SF) else [])
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in alignment.report(docs, known=known).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)
    assert got[0] == got[1] == (0, 0, 0, 0, 0, 0, "") and got[9] == got[10]


def test_sides_equal_the_libraries(spark, sides):
    import random

    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    r = random.Random(3)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab 'sEé\n\t1.日<|>") for _ in range(r.randrange(1, 60))) for _ in range(400)]
    assert sides[0].encode(texts) == [e.ids for e in lib.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_links_are_places_of_overlapping_tokens(spark, sides):
    docs = spark.createDataFrame([(1, "unbelievable tokenizations"), (2, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in alignment.aligned(docs, *sides, links=True).collect()}
    a, b = ([s.spelled[i] for i in s.encode(["unbelievable tokenizations"])[0]] for s in sides)
    span = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[:i + 1]))) for i in range(len(parts))]
    want = [(i, j) for i, (s, e) in enumerate(span(a)) for j, (p, q) in enumerate(span(b)) if s < q and p < e]
    assert list(zip(rows[1]["link_a"], rows[1]["link_b"], strict=True)) == want
    assert rows[2]["link_a"] == rows[2]["pairs"] == []


def test_null_and_repeated_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "same text"), (4, "same text"), (4, "same text"), (4, None)], "doc_id long, text string")
    rows = alignment.report(docs, known=1).collect()
    assert len(rows) == 4 and len({tuple(r)[1:] for r in rows if r["n_a"]}) == 1 and sorted(str(r["doc_id"]) for r in rows) == ["4", "4", "4", "None"]
    assert alignment.report(docs.limit(0)).count() == 0


def test_a_text_longer_than_a_batch(spark, sides, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 500)
    docs = spark.createDataFrame([(1, "some words in a row " * 200), (2, "short"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in alignment.report(docs).collect()}
    assert got[1]["n_a"] >= 1000 and got[1]["count_sum"] > 0 and got[3]["groups_sha256"] == ""
