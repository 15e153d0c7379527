"""The pipeline stage by stage against brute-force versions of what each keeps."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.test_decontamination import brute as brute_matches
from tests.llm.test_jaccard import brute_components
from tests.llm.test_quality import brute_distances, brute_stats, vector
from tests.llm.test_simhash import brute_components as brute_fingerprints
from tidemark.llm import quality as ql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(15))) for i in range(5)]
    rows = []
    for i in range(150):
        w = make(rng.choice([20, 60, 90, 150]))
        kind = rng.random()
        if kind < 0.1:
            w = [x + "%%%" for x in w]
        elif kind < 0.2:
            phrase = items[rng.randrange(5)][1].split()
            if rng.random() < 0.4:  # its words close together only
                rng.shuffle(phrase)
            w[5:5] = phrase
        elif kind < 0.4 and rows:
            w = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), rng.choice(["a", "a", "a", "b"]), 1))
    return rows + [(900, None, "en", "a", None), (901, "", None, None, 0), (3, *rows[3][1:]), (902, " ".join(make(9000)), "en", "b", 1)], items


def brute_quality(rows):
    groups = {}
    for r in rows:
        s = brute_stats(r[1])
        if not (s[0] < 50 or 100 * s[5] > 50 * s[0]):
            groups.setdefault(r[2:4], []).append((r, s))
    kept = []
    for members in groups.values():
        kept += [m[0] for m, d in zip(members, brute_distances([vector(m[1]) for m in members])) if d <= ql.CUTOFF]
    return kept


def brute_dedup(rows):
    first = {d: str(c) for d, c in brute_components([r[:2] for r in rows])}
    return list({r[0]: r for r in rows if first[str(r[0])] == str(r[0])}.values())


def brute_clean(rows, items):
    met = {d for d, _, hit, _, near in brute_matches([r[:2] for r in rows], items, 10, 20) if hit or near}
    return [r for r in rows if str(r[0]) not in met]


def test_corpus_holds_what_other_methods_miss():
    rows, items = corpus()
    rows = brute_quality(rows)
    links = {(d, str(c)) for d, c in brute_components([r[:2] for r in rows])}
    assert links != {(str(d), str(c)) for d, _, c in brute_fingerprints([r[:2] for r in rows])}
    rows = brute_dedup(rows)
    assert any(near and not hit for _, _, hit, _, near in brute_matches([r[:2] for r in rows], items, 10, 20))


def test_stages(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf_dir = str(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    want = rows
    for (name, stage), brute in zip(cp.STAGES, [brute_quality, brute_dedup, lambda x: brute_clean(x, items)]):
        got = stage(spark, docs, sf_dir)
        assert got.columns == docs.columns, name
        got.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        before, want = len(want), brute(want)
        assert Counter(map(tuple, docs.collect())) == Counter(want), name
        assert 0 < len(want) < before, name
    mixed = cp.mix(spark, docs, sf_dir)
    assert mixed.columns == docs.columns
    used = Counter(map(tuple, mixed.collect()))
    assert set(used) == set(want) and max(used.values()) <= 3
    final = cp.run(spark, sf_dir)
    assert final.columns == [*docs.columns, "shard", "slot"]
    placed = final.collect()
    assert Counter(tuple(r)[:5] for r in placed) == used
    sizes = Counter(r["shard"] for r in placed)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(n))


@pytest.mark.parametrize("name, stage", cp.STAGES)
def test_clashing_columns_pass_through(spark, tmp_path, name, stage):
    rows, items = corpus()
    more = ["_key", "_shuffle", "_text", "_id_key", "_text_key", "text_key", "_rejected_id", "node", "root", "block", "row", "key", "rank", "_row", "_source", "tokens", "hits", "items", "kept"]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias(c) for c in more])
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns + (["shard", "slot"] if name == "shard" else [])
    placed = got.collect()
    assert placed and all(r[c] == f"{c}:{r['doc_id']}" for r in placed for c in more)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
