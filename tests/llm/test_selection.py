"""Hard negatives, line removal and token alignment against plain restatements."""

from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tidewheel.llm import align, hard_negatives, line_dedup, queries  # noqa: E402
from tidewheel.llm.align import stretches  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# ------------------------------------------------------------------ op11
def mined(df):
    number = F.col("vec_id")
    label = F.when(number % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(df, number % 100 == 0, label)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(3))
def test_hard_negatives(spark, seed):
    """Ties, repeated rows, repeated ids, nulls, other lengths and scores of either sign."""
    r = random.Random(seed)
    rows = []
    for i in range(0, 900, 1 if seed else 3):
        v = [r.choice([-1.0, -0.25, 0.0, 0.1, 0.5, 1.0]) for _ in range(4)]
        rows.append((i, v, r.choice([0, 1, 2])))
    rows += rows[:40] + [(100, [0.5] * 4, 1), (300, None, 1), (301, [1.0, None, 0.0, 0.0], 0), (302, [float("nan")] * 4, 0), (303, [float("inf")] * 4, 0)]
    rows += [(None, [1.0] * 4, 1), (304, [1.0] * 4, None), (305, [1.0, 1.0], 0), (1000, [1.0, 1.0], 0), (306, [1.0, 1.0], 1), (307, [], 1), (1100, [], 1), (308, [], 0)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("x")).withColumn("anchor", F.lit("y")).repartition(5)
    assert rows_of(mined(df)) == sorted(brute.hard_negatives(rows), key=str)


def test_hard_negatives_of_one_label(spark):
    rows = [(i, [1.0, 0.5], 3 if i % 7 else 2) for i in range(0, 250, 2)]
    got = rows_of(mined(spark.createDataFrame(rows, VECTORS)))
    assert got == []
    assert mined(spark.createDataFrame([], VECTORS)).count() == 0
    assert mined(spark.createDataFrame([(1, [1.0], 1)], VECTORS)).count() == 0


def test_hard_negatives_of_a_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert rows_of(queries.op11(spark, "/root/testdata/sf0.01")) == sorted(brute.hard_negatives([tuple(r) for r in t.collect()]), key=str)


def test_large_scores_raise(spark):
    rows = [(0, [3e12, 1.0], 1), (1, [3e12, 1.0], 1)]
    with pytest.raises(Exception, match="47 bits"):
        mined(spark.createDataFrame(rows, VECTORS)).collect()


# ------------------------------------------------------------------ op12
LINES = [
    (5, "A common line here\nown\n  a COMMON line here\t\n"), (3, "a common line here\n\n\n"), (9, "short\nshort"), (2, None), (1, ""),
    (7, "x\x0bA common line here\x0c\nÄ common line here"), (8, "ä common line here\nÄ common line here"), (4, "once only, once only\nonce only, once only"),
    (9, "short\nshort"), (6, "tail kept\na common line here"), (None, "null id line is first\nz"), (11, "null id line is first\n" * 3), (5, "A common line here\nsecond row of five"),
    (12, "another row of twelve"), (12, "Another row of twelve\nx"), (13, "w " * 40_000 + "\n" + "long line\n" * 9_000),
]


def test_lines(spark):
    df = spark.createDataFrame([(i, t, "c", "p", 1) for i, t in LINES], "doc_id long, text string, id string, gone string, pos int").repartition(4)
    got = line_dedup.clean(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    assert rows_of(got) == sorted(brute.lines(LINES), key=str)
    assert line_dedup.clean(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_with_a_higher_threshold(spark):
    docs = [(i, f"in all of them, yes\nin {i % 3} of three\nonly in {min(i, 2)} {'a' * 8}") for i in range(6)]
    out = {r.doc_id: r for r in line_dedup.clean(spark.createDataFrame(docs, "doc_id long, text string"), least_docs=4).collect()}
    assert out[5].kept == "in 2 of three"
    assert [out[i].n_dropped for i in range(6)] == [0, 1, 1, 2, 2, 2]


def test_lines_beyond_the_hot_ones(spark, monkeypatch):
    """Hot keys take the broadcast, the others the equi-join; both give the same."""
    docs = [(i, "very common line indeed\n" * (i % 3) + f"pair line number {i // 2}\nalone {i} aaaaaaaaa") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute.lines(docs), key=str)
    for hot in (1, 10, 10_000):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        assert rows_of(line_dedup.clean(df).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))) == want


# ------------------------------------------------------------------ op13
TEXTS = [
    None, "", " ", "plain words only", "  two  spaces  and\ttab\n\nlines ", "é à la Straße, naïve", "日本語 テスト ｆｕｌｌ", "🙂🙂 x🙂y", "a <|endoftext|> b <s> <0x41> </s>",
    "has a ▁ mark", "x" * 3000, "1234567890 3.14159 don't we'll", " nbsp em 　ideographic", "é ́x", "\x00\x01 control\x1f x", "été " * 300, "plain words only", "𝔘𝔫𝔦 ⁂ ∑",
]


def test_alignment(spark):
    df = spark.createDataFrame([(i, t, "p", 0) for i, t in enumerate(TEXTS)], "doc_id long, text string, pairs string, block int").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in align.score(df).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute.alignment(TEXTS)
    assert got[9] == (0, 0, 0, 0, 0, 0, "")
    assert align.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_alignment_of_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: tuple(r[1:]) for r in queries.op13(spark, SMALL).collect()}
    assert [got[i] for i, _ in docs] == brute.alignment([t for _, t in docs])


def test_alignment_with_small_caches_and_stretches(spark, monkeypatch):
    known = align.Aligner(align.tokens.vocabulary_path(align.BYTE_LEVEL), align.tokens.vocabulary_path(align.PIECES))
    text = " ".join(random.Random(3).choice(["élan", "von", "the\n", "", "日本", "x, y"]) for _ in range(4000))
    whole = align.text_links(text, known)
    monkeypatch.setattr(align, "CACHE_BYTES", 1)
    assert len(list(stretches(text, 50))) > 50 and " ".join(stretches(text, 50)) == text
    monkeypatch.setattr(align, "stretches", lambda t: stretches(t, 50))
    again = align.text_links(text, known)
    assert whole[:5] == again[:5] and (whole[5] == again[5]).all() and (whole[6] == again[6]).all()


def test_alignment_needs_no_offsets_of_the_libraries():
    known = align.Aligner(align.tokens.vocabulary_path(align.BYTE_LEVEL), align.tokens.vocabulary_path(align.PIECES))
    library, asked = known.b, []

    class Plain:
        def encode(self, text, **options):
            asked.append(options.get("return_type"))
            return library.encode(text, **options)

    known.b = Plain()
    text = "naïve 日本語 🙂🙂 x🙂y 3.14"
    want = brute.alignment([text])[0]
    assert align.text_links(text, known)[:5] == (*want[:4], want[6])
    assert asked == [None]
