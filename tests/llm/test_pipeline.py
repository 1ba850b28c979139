"""The whole corpus pipeline over small tables against a plain restatement of its stages."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [w for w in """the council met again on monday because nobody could agree where a new bridge should cross the river and many people
living near old harbour feared that heavy traffic would soon pass their quiet streets while others hoped for shorter ways to work or
school since every winter storms close both ferries sometimes during several weeks""".split()]


def prose(r, n):
    out = [r.choice(WORDS) for _ in range(n)]
    return re.sub(r"(^|\. )(\w)", lambda m: m[1] + m[2].upper(), " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(out))) + "."


def restated(docs, items):
    """Rows (doc_id, text) that reach packing."""
    kept = [(i, t) for i, t in docs if not brute.quality(t)[-1]]
    first = {}
    for i, t in sorted(kept):  # the copies here are exact
        first.setdefault(t, i)
    kept = [(i, t) for i, t in kept if first[t] == i]
    windows = {tuple(w[j : j + 10]) for _, b in items for w in [brute.words(b)] for j in range(len(w) - 9)}
    out = []
    for i, t in kept:
        w = brute.words(t)
        hit = {p for j in range(len(w) - 9) if tuple(w[j : j + 10]) in windows for p in range(j, j + 10)}
        if 2 * len(hit) > len(w):
            continue
        if hit:
            pieces = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+$", t)
            t = "".join(p for k, p in enumerate(pieces) if k not in hit)
        t = re.sub(r"password: [A-Za-z0-9]{8,}", "[secret]", t)
        out.append((i, t))
    return out


def test_run(spark, tmp_path):
    """Rejected, copied, contaminated, secret and long documents, nulls and empty texts; clean documents come through as they are."""
    r = random.Random(4)
    passage, other = prose(r, 40), prose(r, 60)
    docs = [(i, prose(r, r.randint(40, 300))) for i in range(12)]
    docs += [(20, None), (21, ""), (22, "too short"), (23, ("same eight words come again and again here " * 12).strip())]
    docs += [(30, docs[3][1]), (31, docs[3][1]), (2000, docs[5][1])]
    docs += [(40, prose(r, 80) + " " + passage + " " + prose(r, 60)), (41, passage + " " + prose(r, 10)), (42, prose(r, 90) + " password: hunter2hunter2 " + prose(r, 30))]
    docs += [(50, prose(r, 3000))]
    items = [(1, passage), (2, other), (3, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = restated(docs, items)
    assert {20, 21, 22, 23, 30, 31, 2000, 41} & {i for i, _ in want} == set() and len(want) == 15
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in out) == brute.piece_rows(want)
    assert sum(1 for p in out if p.doc_id == 50) > 1


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, prose(random.Random(1), 60), "en", "s", 0)], COLUMNS)
    none = spark.createDataFrame([], COLUMNS)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "benchmark decontamination", "secret scans", "best-fit packing"]
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, none, str(tmp_path)).count() == 0
