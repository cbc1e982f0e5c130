import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from attestor.llm import queries, shingle_pairs, token_binary, toxicity


@pytest.fixture(scope="module")
def folder(spark, words, tmp_path_factory):
    """Tables with copies, near copies, toxic and benchmark texts planted among clean ones."""
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choices(words, k=n))
    path = str(tmp_path_factory.mktemp("tables"))
    items = [(k, text(30)) for k in range(3)]
    docs = [(i, text(80), "en", f"s{i % 3}", 0) for i in range(60)]
    docs += [(100 + i, docs[i][1].upper(), "en", "s0", 0) for i in range(5)]
    docs += [(200 + i, text(40) + " " + items[i][1] + " " + text(20), "en", "s1", 0) for i in range(3)]
    bad = ["scumbag", "worthless", "idiotic"]
    docs += [(300 + i, " ".join(w if k % 20 else rng.choice(bad) for k, w in enumerate(text(80).split())), "en", "s2", 0) for i in range(60)]
    labels = [(i, 1, int(i >= 300)) for i, *_ in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_do_their_work(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, folder).cache()
        seen[name] = [r.doc_id for r in docs.collect()]
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
    clean = set(range(60))
    assert sum(i >= 300 for i in seen["toxicity"]) <= 2 and clean <= set(seen["toxicity"])
    assert not {100, 101, 102, 103, 104} & set(seen["near_duplicates"]) and clean <= set(seen["near_duplicates"])
    assert not {200, 201, 202} & set(seen["decontamination"]) and clean <= set(seen["decontamination"])
    assert set(seen["mixing"]) <= set(seen["decontamination"])
    assert sorted(seen["token_output"]) == sorted(seen["mixing"])


def similar(a, b):
    x, y = set(shingle_pairs.shingles(a).tolist()), set(shingle_pairs.shingles(b).tolist())
    return 5 * len(x & y) >= 4 * len(x | y)


def test_run_equals_the_stages_worked_out_by_hand(spark, folder):
    """Every stage again without the pipeline: scores one by one, all pairs compared, all items aligned, the mix by SQL and
    the ids by the library."""
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.Scorer(toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet")))
    rows = sorted((r for r in table.collect() if scorer.logit(r.text) < 0), key=lambda r: r.doc_id)
    kept = []
    for r in rows:
        if not any(similar(r.text, k.text) for k in kept):
            kept.append(r)
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    kept = [r for r in kept if not any(t.lower() in r.text.lower() for t in items)]
    documents = pd.DataFrame([(r.doc_id, r.text, r.source) for r in kept], columns=["doc_id", "text", "source"])
    con = duckdb.connect()
    con.register("documents", documents)
    repeats = dict(con.execute(f"SELECT doc_id, repeats FROM ({queries.ORACLES['op6_mixing']})").fetchall())
    tokenizer, want, at = Tokenizer.from_file(token_binary.vocabulary_path()), [], 0
    for r in kept:
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [2]
        for _ in range(repeats[r.doc_id]):
            want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in P.run(spark, folder).collect())
    assert [(i, start, n, crc) for start, i, n, crc in got] == want and len(want) > 40


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{k}" for k in range(1, 11)]
    assert set(queries.ORACLES) <= set(queries.QUERIES)
