"""Corpus operators against brute force, other libraries, round trips and held-out accuracy, and on awkward rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wattfleet.llm import brown_lm, decontaminate, fingerprints, langid, licenses, neardup, pieces, sharding, token_counts, toxicity
from tests.conftest import plan_text

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, words string, kept string"
LINE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a repeated id, and columns named like the operators' own."""
    rows = [(1, LINE, "en", "a"), (1, LINE, "en", "a"), (2, LINE.upper(), "en", "a"), (3, None, None, None), (4, "", "en", "b"),
            (None, LINE, "en", "b"), (5, "!!! 123 ...", "en", "b"), (6, "word " * 30000, "en", "a"), (7, "é", None, "c"), (8, "two▁ words\n", "fr", "c")]
    return spark.createDataFrame([(*r, 0, 9, "x", "y") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts(df):
    return {r[0]: r[1] for r in df.select("doc_id", "text").collect()}


def test_shards_match_the_mixture(docs):
    rows = sharding.proportional_shards(docs, 24, cell_rows=16).collect()
    assert len(rows) == docs.count()
    per = Counter(r["shard"] for r in rows)
    assert max(per.values()) - min(per.values()) <= 1
    for s, n in per.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    for source, n in Counter(r["stratum"] for r in rows).items():
        own = Counter(r["shard"] for r in rows if r["stratum"] == source)
        assert all(abs(own.get(s, 0) - n / 24) < 2 for s in per), source
    raw = texts(docs)
    assert all(r["text_crc32"] == zlib.crc32(raw[r["doc_id"]].encode()) and r["size"] == len(raw[r["doc_id"]].encode()) + 8 for r in rows)


def test_cells_do_not_change_places(docs):
    place = lambda c: {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.proportional_shards(docs, 5, cell_rows=c).collect()}
    assert place(7) == place(100_000)


def test_fingerprints_of_edited_texts(docs):
    raw = texts(docs)
    order = sorted(raw, reverse=True)
    after = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in fingerprints.report(docs).collect():
        t, k = raw[r["doc_id"]], len(raw[r["doc_id"]]) // 3
        edited = t[: len(t) - k] + raw[after[r["doc_id"]]][:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_sketches_estimate_containment(docs, spark):
    long = [(i, t) for i, t in texts(docs).items() if len(t.split()) > 400]
    rows = spark.createDataFrame([(i, t, t[: len(t) // 2]) for i, t in long], "i long, whole string, half string")
    rows = fingerprints.with_sketch(fingerprints.with_sketch(rows, "whole", "w"), "half", "h")
    got = rows.select(fingerprints.contained(F.col("h"), F.col("w")), fingerprints.contained(F.col("w"), F.col("h")),
                      fingerprints.merged(F.col("w"), F.col("h")) == F.col("w")).collect()
    assert all(r[0] > 0.9 for r in got)
    assert abs(sum(r[1] for r in got) / len(got) - 0.5) < 0.1


def test_license_matches_are_exact_containment(docs):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    wanted = [(n, grams(split(t))) for n, t in licenses.NOTICES]
    got = {r["doc_id"]: set(filter(None, r["licenses"].split(","))) for r in licenses.report(docs).collect()}
    for i, t in texts(docs).items():
        whole = {n for n, g in wanted if g <= grams(split(t))}
        assert whole <= got[i], i
        assert all(any(len(g & grams(split(t))) >= 0.75 * len(g) for m, g in wanted if m == n) for n in got[i]), i


def test_short_notices_are_found_at_every_offset(spark):
    """400 notices of five words, each planted at every offset: of 12,000 about one may be missed by the promise; 64 bands missed 38."""
    notice = lambda i: " ".join(f"n{i}x{j}" for j in range(5))
    wanted = licenses.templates(spark, [(f"L{i}", notice(i)) for i in range(400)])
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda j: F.when(j == 8 + F.col("id") % 8, F.transform(
        F.sequence(F.lit(0), F.lit(4)), lambda k: F.format_string("n%dx%d", F.floor(F.col("id") / 30), k))).otherwise(F.array(F.format_string("w%dx%d", "id", j))))
    df = spark.range(12000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.flatten(words)).alias("text"))
    assert licenses.report(df, wanted).where("n_templates <> 1").count() <= 6


def test_license_matches_of_one_window_stand_apart(spark):
    gpl, lgpl = dict(licenses.NOTICES)["GPL-3.0"], dict(licenses.NOTICES)["LGPL-3.0"]
    sa = "Creative Commons Attribution-ShareAlike 4.0 International License"
    rows = [(1, f"{gpl} that {lgpl.split(' ', 1)[1]}"), (2, gpl), (3, f"This work is licensed under a {sa}")]
    got = licenses.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["licenses"] for r in got} == {1: "GPL-3.0,LGPL-3.0", 2: "GPL-3.0", 3: "CC-BY-SA-4.0"}


def test_base_score_and_distribution(docs):
    raw = texts(docs)
    words = {i: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)), ""] for i, t in raw.items()}
    held = {i for i in raw if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    rows = brown_lm.report(docs).collect()
    for r in rows:
        ws = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(ws), sum(c[w] > 0 for w in ws), n, r["doc_id"] in held)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    model, _ = brown_lm.fit(docs)
    steps = (10 ** model.step).sum(1)
    assert abs(steps - 1).max() < 1e-9
    mass = Counter()
    for w, k in c.items():
        cls = model.of[model.units.get(w, brown_lm.ending(w))]
        mass[cls] += (k - brown_lm.DISCOUNT) / model.mass[cls]
    assert all(abs(mass[cls] + brown_lm.DISCOUNT * model.kinds[cls] / model.mass[cls] - 1) < 1e-9 for cls in mass)


def test_exchange_finds_planted_classes():
    import numpy as np

    of = brown_lm.exchange(np.kron(np.array([[0, 9], [9, 0]]), np.ones((3, 3))), classes=2)
    assert len(set(of[:3])) == 1 and len(set(of[3:])) == 1 and of[0] != of[3]


def planted(spark):
    """Two kinds of 1,500 words in turn, with endings that say nothing."""
    import random

    r = random.Random(5)
    words = [[f"{kind}{i}q{r.randrange(10)}x" for i in range(1500)] for kind in "ab"]
    rows = [(i, " ".join(words[j % 2][r.randrange(1500)] for j in range(60))) for i in range(2500)]
    return words, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_all_words_above_the_count_are_clustered(spark):
    words, df = planted(spark)
    model, _ = brown_lm.fit(df)
    a, b = ({int(model.of[model.units.get(w, brown_lm.ending(w))]) for w in ws} for ws in words)
    assert len(model.units.codes) > 2900 and not a & b


def test_units_beyond_the_table_are_joined(spark, monkeypatch):
    """Words that are units but have no room in the tasks' table get classes by context and scores by them."""
    words, df = planted(spark)
    monkeypatch.setattr(brown_lm, "KNOWN", 1500)
    model, counts = brown_lm.fit(df)
    own = {r["word"]: (r["c"], r["own"]) for r in counts.collect()}
    cls = lambda w: own[w][1] if own.get(w, (0, None))[1] is not None else int(model.of[model.units.get(w, brown_lm.ending(w))])
    assert sum(o is not None for _, o in own.values()) > 1000
    assert not {cls(w) for w in words[0]} & {cls(w) for w in words[1]}
    text, unseen = {r[0]: r[1] for r in df.collect()}, model.unseen()
    for r in brown_lm.scored(df, model, counts).collect()[:200]:
        ws = [*text[r["doc_id"]].split(), ""]
        cs = [cls(w) for w in ws]
        emit = [math.log10((own[w][0] - brown_lm.DISCOUNT) / model.mass[c]) if w in own else unseen[c] for w, c in zip(ws, cs, strict=True)]
        assert math.isclose(r["score"], sum(model.step[x, y] for x, y in zip([cs[-1], *cs], cs, strict=False)) + sum(emit), rel_tol=1e-9)


def test_language_held_out(docs):
    got = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)


def test_stage_keeps_clean_texts_without_a_model(spark):
    rows = [(1, "a clean text"), (2, None), (3, "12 !"), (None, "one more")]
    for lang in (None, "en"):
        got = langid.keep_identified(spark.createDataFrame([(i, t, lang, "a", 9, 0, "x", "y") for i, t in rows], SCHEMA)).collect()
        assert [r["text"] for r in got] == ["a clean text", "one more"]


def test_codewords_are_apart():
    for n in (2, 4, 7, 12):
        code = langid.codewords(n)
        assert min((a != b).sum() for i, a in enumerate(code) for b in code[:i]) >= max(1, code.shape[1] // 4)


def test_near_duplicates_of_odd_rows(odd):
    got = sorted({tuple(r) for r in neardup.near_duplicates(odd).collect()}, key=str)
    assert (1, 10, 1, True) in got and (2, 10, 1, False) in got and (3, 0, 3, True) in got and (4, 0, 4, True) in got
    assert (None, 10, None, True) in got and (6, 1, 6, True) in got
    assert neardup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_chain(spark):
    """A chain of edits is one component even where its ends differ, and the exhaustive step alone finds it too."""
    words, rows = [f"w{i}" for i in range(80)], []
    for k in range(12):
        rows.append((100 + k, " ".join(words)))
        words[5 * k + 2] = f"x{k}"
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {100}


def test_parity_bits_rule_out_no_link(spark):
    """At most as many bits differ as hashes, so the exhaustive step keeps every pair that its links need."""
    words, rows = [f"w{i}" for i in range(160)], []
    for k in range(24):
        rows.append((k, " ".join(words[:150 - k] + [f"y{k}"] * (k % 3))))
        words[6 * k] = f"x{k}"
    shingler = neardup.Shingler()
    sets = [shingler.set_of(t) for _, t in rows]
    bits = [{b for b in range(neardup.BITS) if (s % neardup.BITS == b).sum() % 2} for s in sets]
    stored = [set((v.view("uint8").reshape(-1)[:, None] >> range(7, -1, -1) & 1).ravel().nonzero()[0].tolist()) for v in neardup.parity(sets)]
    assert stored == bits
    frame = spark.createDataFrame([(i, len(s), v.tolist()) for i, (s, v) in enumerate(zip(sets, neardup.parity(sets)))], "id int, n long, bits array<long>")
    x, y = (frame.select(*[F.col(c).alias(f"{p}_{c}") for c in frame.columns]) for p in "xy")
    kept = {(r[0], r[1]) for r in x.join(y, neardup._may_link("x", "y")).select("x_id", "y_id").collect()}
    plain = [set(s.tolist()) for s in sets]
    links = {(i, j) for i, a in enumerate(plain) for j, b in enumerate(plain) if 100 * len(a & b) >= 75 * len(a | b)}
    assert links <= kept and len(kept) < len(sets) ** 2 and len(links) > len(sets)


def test_near_duplicates_under_one_id(spark):
    """Two texts of one id link what either of them is close to."""
    left, right = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, left), (5, right), (6, left + " end"), (7, right + " end"), (8, "something else altogether in here")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8}


def test_counts_equal_the_library(docs):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    raw = texts(docs)
    assert all(r["n_tokens"] == len(lib.encode(raw[r["doc_id"]], add_special_tokens=False).ids) for r in token_counts.report(docs).collect())
    counter = token_counts.load(public.path("byte_bpe_50k.json"))
    for s in ("it's  a\n\n test", "a<|endoftext|> b!<|end", "　 日本\r\n\n1é'll", "x" * 200, ""):
        want = [len(lib.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert counter.prefixes(s).tolist() == want
        assert len(lib.encode(counter.truncated(s, 3), add_special_tokens=False).ids) <= 3


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(docs, labels).join(labels.where("toxic is not null"), "doc_id").collect()
    clean = [r for r in got if not r["toxic"]]
    assert sum(r["predicted"] for r in clean) <= 0.02 * len(clean)
    assert sum(r["predicted"] for r in got if r["toxic"]) >= 0.5 * sum(r["toxic"] for r in got)


def test_text_stages_hold_small_batches(spark, monkeypatch):
    import pyarrow as pa

    docs = spark.createDataFrame([(i, "some plain words here" + " you idiot" * (i % 4 == 0), "en") for i in range(4000)], "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 = 0 as int) as toxic")
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for stage in (langid.keep_identified, lambda d: toxicity.drop_toxic(d, labels)):
        spark.conf.set(most, "10000")
        rows = stage(docs)
        assert int(spark.conf.get(most)) <= 1000
    assert "struct" not in plan_text(rows)              # the text travels once
    score = {r["doc_id"]: r["score"] for r in toxicity.report(docs, labels).collect()}
    assert {r["doc_id"] for r in rows.collect()} == {i for i, s in score.items() if s < 0.5}

    batch = pa.RecordBatch.from_pydict({"text": ["idiot"], "toxic": [1]})
    counted = [b.to_pydict() for b in toxicity._tally(iter([batch, batch]))]
    assert len(counted) == 1 and set(counted[0]["t"]) == {2}
    monkeypatch.setattr(toxicity, "TABLE", 1)
    assert [b.num_rows for b in toxicity._tally(iter([batch, batch]))] == [3, 3]


def test_grammar_clauses():
    g = toxicity.Grammar({"idiot": 1.0})
    plain, aimed, negated, told = (g.score(t) for t in ("an idiot.", "you idiot.", "never an idiot.", "he said an idiot."))
    assert aimed > plain > told and plain > negated and g.score("you. an idiot.") == plain
    assert g.score(None) == g.score("") < 0.5 and g.score("I will kill you") > 0.5 > g.score("some kill time. you")


def test_decontamination_of_odd_rows(spark, odd):
    items = spark.createDataFrame([(7, LINE), (7, LINE), (8, "twelve thirteen"), (9, ""), (None, "one two")], "item_id long, text string")
    for bound in (0, 10_000):
        got = {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontaminate.report(odd, items, broadcast_windows=bound).collect()}
        both = hashlib.sha256(b"7,8").hexdigest()
        assert {(1, 14, 14, 2, both), (2, 14, 14, 2, both), (None, 14, 14, 2, both), (3, 0, 0, 0, hashlib.sha256(b"").hexdigest())} <= got
    assert decontaminate.report(odd, items).count() == odd.count()
    assert decontaminate.report(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.drop_contaminated(odd, items).columns == odd.columns


def test_pieces_equal_viterbi_and_round_trip(docs, odd):
    public = pytest.importorskip("public_tokenizers")
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = public.path("piece_bpe_32k.model")
    own, lib = pieces.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    viterbi = Tokenizer(models.Unigram([(lib.id_to_piece(i), lib.get_score(i)) for i in range(lib.vocab_size())], 0, True))
    for t in list(texts(docs).values())[:60]:
        assert own.encode(t).tolist() == viterbi.encode((" " + t).replace(" ", "▁")).ids
    assert {r[0] for r in pieces.report(odd, path).select("round_trip").collect()} == {True}
    back = pieces.decoded(pieces.encoded(odd.select("doc_id", "text"), own), own)
    assert all((r["text"] or "") == r["decoded"] for r in back.collect())


def test_odd_rows_keep_their_number(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    n = odd.count()
    for rows in (langid.report(odd), toxicity.report(odd, labels), token_counts.report(odd), fingerprints.report(odd), licenses.report(odd),
                 sharding.proportional_shards(odd, 24), brown_lm.report(odd), neardup.near_duplicates(odd)):
        assert rows.count() == n
    for stage in (langid.keep_identified, lambda d: toxicity.drop_toxic(d, labels), neardup.keep_first):
        assert stage(odd).columns == odd.columns
    none = odd.limit(0)
    for rows in (langid.report(none), toxicity.report(none, labels), token_counts.report(none), fingerprints.report(none),
                 sharding.proportional_shards(none, 24), brown_lm.report(none), pieces.report(none)):
        assert rows.count() == 0


def test_pieces_replace_columns_of_their_names(spark):
    public = pytest.importorskip("public_tokenizers")
    own = pieces.load(public.path("piece_bpe_32k.model"))
    rows = pieces.encoded(spark.createDataFrame([(1, "a text", "old", False)], "doc_id long, text string, piece_ids string, round_trip boolean"), own)
    assert rows.columns == ["doc_id", "text", "piece_ids", "round_trip"] and rows.first()["piece_ids"] == own.encode("a text").tolist()
    back = pieces.decoded(rows.withColumn("decoded", F.lit(1)), own)
    assert back.columns[-1] == "decoded" and back.first()["decoded"] == "a text"


def test_generations_of_chunks_change_nothing(docs, monkeypatch):
    """With room for a few chunks only, every text gets the same ids, and what is remembered stays small."""
    public = pytest.importorskip("public_tokenizers")
    path = public.path("piece_bpe_32k.model")
    whole, small = pieces.load(path), pieces.load(path)
    raw = list(texts(docs).values())[:40]
    want = [whole.encode(t).tolist() for t in raw]
    monkeypatch.setattr(pieces, "TABLE", 5000)
    assert [small.encode(t).tolist() for t in raw] == want and len(small._new) < len(whole._new)
    assert small._lossy == set() and all(whole.encode_checked(t)[1] for t in raw)


def test_a_chunk_that_does_not_come_back_is_told(docs):
    own = pieces.Pieces({"a": (300, -1.0), " ": (301, -1.0)}, list(range(256)))
    own.spelled[300] = b"b"
    assert own.encode_checked("a")[1] is False and own.encode_checked("c")[1] is True
    assert own.encode_checked("c a")[1] is False and own.encode_checked(None)[1] is True


def test_stage_decodes_languages(docs, spark):
    """Missing languages are filled, wrong ones replaced where the model is sure; texts without letters go, all columns stay."""
    known = docs.where("lang is not null and text rlike '[A-Za-z]{3}'")
    odd = known.withColumn("lang", F.when(F.col("doc_id") % 5 == 1, None).otherwise(F.col("lang")))
    extra = spark.createDataFrame([(9001, "123 !!", "en", "x", 6), (9002, None, "en", "x", 0)], docs.schema)
    got = langid.keep_identified(odd.unionByName(extra))
    assert got.columns == docs.columns
    truth, rows = {r["doc_id"]: r["lang"] for r in known.collect()}, got.collect()
    assert {r["doc_id"] for r in rows} == set(truth)
    filled = [r for r in rows if r["doc_id"] % 5 == 1]
    assert len(filled) > 10 and sum(r["lang"] == truth[r["doc_id"]] for r in filled) >= 0.95 * len(filled)


def test_languages_do_not_depend_on_the_order_of_rows(docs, monkeypatch):
    monkeypatch.setattr(langid, "RELIABILITY_ROWS", 40)
    a, b = (langid.fit(rows) for rows in (docs.orderBy("lang").coalesce(1), docs.orderBy(F.desc("lang")).repartition(3)))
    assert a.trust.tolist() == b.trust.tolist() and (a.weights == b.weights).all()


def test_many_units_choose_as_one_does():
    import numpy as np

    rng = np.random.default_rng(0)
    for trial in range(20):
        b = rng.poisson(1.2, (15, 15)).astype(float)
        of = rng.integers(0, brown_lm.CLASSES if trial % 2 else 4, 15)
        hot = np.eye(brown_lm.CLASSES)[of]
        n, s, p, own = hot.T @ b @ hot, b @ hot, b.T @ hot, np.diag(b).copy()
        assert brown_lm.best_classes(n, of, s, p, own).tolist() == [brown_lm.best_class(n, int(of[i]), s[i], p[i], own[i]) for i in range(15)]


def test_bounded_sums_and_stored_sides_change_nothing(spark, monkeypatch):
    """Bigrams summed in small runs, units split over many partitions and chunks: the same classes."""
    words, df = planted(spark)
    want, _ = brown_lm.fit(df)
    for name, value in (("PAIRS", 3000), ("SIDE_ROWS", 5000), ("MEMO", 40_000)):
        monkeypatch.setattr(brown_lm, name, value)
    got, _ = brown_lm.fit(df)
    assert (got.of == want.of).all() and (got.step == want.step).all() and (got.units.codes == want.units.codes).all()


def test_sides_hold_their_bigrams_in_arrays(spark):
    """Bigrams are stored once, in few rows, and come back from the sides; all of a unit lies in one partition."""
    want = {(a, b): 1 + (a * b) % 5 for a in range(40) for b in range(60) if (a + b) % 3}
    sides = brown_lm.stored_sides(spark.createDataFrame([(*ab, k) for ab, k in want.items()], "a long, b long, k long").repartition(3), len(want))
    assert {(r["a"], r["b"]): r["k"] for r in brown_lm.following(sides).collect()} == want
    assert sides.count() < len(want) / 2
    before = {(o, r["unit"]): k for r in sides.where("side = 1").collect() for o, k in zip(r["other"], r["k"], strict=True)}
    own = {r["unit"]: sum(r["k"]) for r in sides.where("side = 2").collect()}
    assert before == want and own == {a: k for (a, b), k in want.items() if a == b}


def test_every_notice_at_every_offset_gives_its_license(spark):
    """Exact notices amid other words, at each place of a window, and two of them that share most of their words."""
    filler = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows, want = [], {}
    for k, (name, notice) in enumerate(licenses.NOTICES):
        for offset in range(40):
            i = k * 40 + offset
            rows.append((i, f"{filler(i, offset)} {notice} {filler(-i, 20)}"))
            want[i] = "BSD-3-Clause" if name == "BSD-2-Clause" and "2-Clause" not in notice else name
    two, three = dict(licenses.NOTICES)["GPL-2.0"], dict(licenses.NOTICES)["GPL-3.0"]
    for offset in range(40):
        rows.append((100_000 + offset, f"{filler(1, offset)} {three} {filler(2, offset % 7)} {two}"))
        want[100_000 + offset] = "GPL-2.0,GPL-3.0"
    got = {r["doc_id"]: r["licenses"] for r in licenses.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_values_of_odd_rows(spark, odd):
    """Null, empty, long and repeated rows have the values that the docstrings state."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    raw = [(r["doc_id"], r["text"]) for r in odd.collect()]
    by_id = lambda df: {i: [r for r in rows if r["doc_id"] == i] for rows in [df.collect()] for i in {r["doc_id"] for r in rows}}

    shards = sharding.proportional_shards(odd, 3).collect()
    assert sorted((str(r["doc_id"]), r["size"]) for r in shards) == sorted((str(i), len((t or "").encode()) + 8) for i, t in raw)
    for k in range(3):
        own = sorted(r["slot"] for r in shards if r["shard"] == k)
        assert own == list(range(len(own))) and len(own) in (3, 4)

    got = by_id(licenses.report(odd))
    assert [(r["n_words"], r["licenses"], r["n_templates"], r["best"]) for r in got[1]] == [(14, "", 0, 0.0)] * 2
    assert [r["n_words"] for i in (3, 4, 5, 6) for r in got[i]] == [0, 0, 1, 30000]

    got = by_id(fingerprints.report(odd))
    assert got[3][0]["fingerprint"] == got[4][0]["fingerprint"] == "" and got[3][0]["n_chars"] == 0
    assert len({r["fingerprint"] for i in (1, 2, None) for r in got[i]}) == 1 and len(got[1]) == 2
    assert got[6][0]["n_chars"] == 150000 and all(0 <= r["near_next"] <= 1 for rows in got.values() for r in rows)

    got = by_id(brown_lm.report(odd))
    assert {i: got[i][0]["n_tokens"] for i in (1, 3, 4, 6)} == {1: 15, 3: 1, 4: 1, 6: 30001}
    assert got[1][0] == got[1][1] and not got[None][0]["held_out"]

    got = by_id(langid.report(odd))
    assert all((got[i][0]["lang_pred"], got[i][0]["score"]) == ("und", 0.0) for i in (3, 4, 5))
    assert got[1][0] == got[1][1] and got[1][0]["lang_pred"] in ("en", "fr")

    got = by_id(token_counts.report(odd))
    assert [(r["n_bytes"], r["n_tokens"], r["over_limit"]) for i in (3, 4) for r in got[i]] == [(0, 0, False)] * 2
    assert got[6][0]["over_limit"] and got[7][0]["n_bytes"] == 2 and got[1][0] == got[1][1]

    got = by_id(toxicity.report(odd, labels))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for rows in got.values() for r in rows)
    assert got[3][0]["score"] == got[4][0]["score"] < 0.5 and got[1][0]["score"] == got[1][1]["score"] == got[None][0]["score"]


def test_licenses_of_an_empty_table(odd):
    assert licenses.report(odd.limit(0)).count() == 0


def test_brown_lm_many_texts_at_once_as_one_by_one(spark):
    """Batches score as single texts do; a word whose code is another word's is counted by the join."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["Alpha", "beta\t", "gamma", "délta", "x"], 30)) + f" rare{i} rare{i}" for i in range(60)] + [None, "", " ", "   never"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, counts = brown_lm.fit(df)
    own = {r["word"]: r["c"] for r in counts.collect()}
    assert model.units.whole

    def totals(sums, rare):
        n, known, base, score = sums
        for word, cls, k in rare:
            c = own.get(word, 0)
            known, base = known + k * (c > 0), base + k * math.log10(c + 1)
            score += k * (math.log10((c - brown_lm.DISCOUNT) / model.mass[cls]) if c else model.unseen()[cls])
        return n, known, base, score

    want = []
    for text in texts:
        n, known, base, score, rare, _ = model.local(text)
        want.append(totals((n, known, base, score), [(w, c, k) for (w, c), k in rare.items()]))
    for clash in (False, True):
        if clash:
            model.checks = model.checks + 1
            model.units.forget()
        n, known, base, score, at, words, cls, k = model.summed(texts)
        rare = [[(w, c, m) for t, w, c, m in zip(at, words, cls, k, strict=True) if t == i] for i in range(len(texts))]
        assert any(w == "alpha" for r in rare for w, *_ in r) == clash
        np.testing.assert_allclose([totals(x, r) for x, r in zip(zip(n, known, base, score, strict=True), rare, strict=True)], want, atol=1e-9)


def test_brown_lm_splits_and_hashes_many_texts_at_once():
    """Arrow's split gives the words of ``tokens`` with an end after each text; hashes depend on the word alone, whatever its length and place."""
    import numpy as np
    import pyarrow as pa

    texts = [None, "", " ", "\x0b\t", "a", " A  b\r\n", "x\x1cy\x85  Éa É", "　wide ", "end\x0c", "a" * 3000 + " " + "b" * 1025 + " " + "c" * 1024]
    for part in (texts, texts[:3], []):
        words, long = brown_lm.split(pa.array(part, pa.string()))
        want = [[*brown_lm.tokens(t), brown_lm.END] for t in part]
        assert words.to_pylist() == [w for ws in want for w in ws] and long.tolist() == list(map(len, want))
    words = ["", "é", "𝄞x𝄞", *("w" * i for i in range(1, 40)), *("v" * i for i in (1023, 1024, 1025, 2048)), *(f"word{i}" for i in range(30000))]
    made = pa.array(["xyz", *words])[1:]
    codes, checks = brown_lm.codes(made), brown_lm.checks(made)
    assert len(set(codes.tolist())) == len(set(checks.tolist())) == len(words)
    assert ((-1 - codes) % brown_lm.ENDINGS).tolist() == [brown_lm.ending(w) for w in words]
    for i in (0, 1, 2, 7, 20, 41, 43, 44, 45, 46, 500):
        alone = pa.array([words[i]])
        assert (brown_lm.codes(alone)[0], brown_lm.checks(alone)[0]) == (codes[i], checks[i])
    assert (codes < 0).all() and codes.dtype == checks.dtype == np.int64


def test_bigrams_reach_their_sum_in_cells(spark, monkeypatch):
    """Bigrams travel as one row for each cell and run, not one for each pair; a frequent unit lies in many cells; the sums are those of one count."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(brown_lm, "CELL_TOKENS", 300)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{i}" if j % 2 else f"the w{i}" for j, i in enumerate(rng.integers(0, 150, 40))) + " the the" * int(rng.integers(0, 3)) for _ in range(200)]
    words = sorted({w for t in texts for w in t.split()} | {brown_lm.END})
    units = brown_lm.Units(brown_lm.codes(pa.array(words)), True)
    number = dict(zip(words, units.named(pa.array(words)).tolist(), strict=True))
    seen = [[number[w] for w in [*t.split(), brown_lm.END]] for t in texts]
    want = Counter(ab for ws in seen for ab in zip([number[brown_lm.END], *ws], ws, strict=False))
    cells = brown_lm.Cells(brown_lm.ENDINGS + len(words), sum(map(len, seen)))
    assert cells.side > 4

    def pairs(batches):
        for batch in batches:
            yield from cells.packed(*brown_lm._tallied(cells.keys(batch["text"], units)))

    packed = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2).mapInArrow(pairs, "cell int, a array<int>, b array<int>, k array<long>")
    rows = packed.collect()
    assert len(rows) <= 2 * cells.side ** 2 < len(want) / 10 and len({r["cell"] for r in rows if number["the"] in r["a"]}) == cells.side
    got = Counter()
    sides = brown_lm._stored(cells.summed(packed), 1000)
    for r in brown_lm.following(sides).collect():
        got[r["a"], r["b"]] += r["k"]
    assert got == want
    monkeypatch.setattr(brown_lm, "PAIRS", 40)          # sums handed on in parts add up to the same
    parts = Counter()
    for r in brown_lm.following(brown_lm._stored(cells.summed(packed), 1000)).collect():
        parts[r["a"], r["b"]] += r["k"]
    assert parts == want
