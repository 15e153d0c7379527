"""Phrase and proximity matches of the registered uses, against brute force."""

import hashlib
import random

import corpus_pipeline as cp
from tests.llm.test_decontamination import brute
from tidemark.llm import queries


def corpus():
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(2000)}" for _ in range(n)]
    items = [(i, " ".join(make(12))) for i in range(4)]
    docs = [(0, make(80)), (1, make(80)), (2, make(80)), (3, make(80)), (4, [])]
    docs[1][1][20:20] = items[0][1].split()  # the phrase
    docs[2][1][20:20] = items[1][1].split()[::-1]  # its words in reverse
    docs[3][1][20:20] = [x for w in items[2][1].split()[:10] for x in (w, *(["put"] if w.endswith(("1", "5")) else []))] + ["in"]
    docs[3][1][25:25] = ["between"]
    return [(d, " ".join(w)) for d, w in docs], items


def test_matches_reach_query_and_stage(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, items, 10, 20)
    got = queries.QUERIES["op1_benchmark_decontamination"](spark, str(tmp_path)).collect()
    digest = lambda ids: hashlib.sha256(",".join(ids).encode()).hexdigest()
    assert sorted(map(tuple, got)) == sorted((int(d), n, len(hit), len(met), digest(met), bool(hit), len(near), digest(near)) for d, n, hit, met, near in want)
    assert [bool(near) for *_, near in want] == [False, True, True, True, False]
    kept = cp.decontaminate(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 4]
