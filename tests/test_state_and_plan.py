import datetime as dt

import pytest

from attestor.operators import index
from attestor.plans import analyse, queries
from attestor.streaming import state


def stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").json(path)
    return spark.readStream.schema(schema).json(path)


def run(query_df, name, mode="append"):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return query_df.sparkSession.table(name)


def at(day, minute):
    return dt.datetime(2024, 1, day, 0, minute)


def test_quota_stream_equals_batch(spark, tmp_path):
    rows = [("gdelt", at(1 + k // 60, k % 60), k, 1) for k in range(100)] + [("other", at(1, k), 200 + k, 30) for k in range(4)]
    schema = "layer string, ts timestamp, event_id long, amount int"
    got = run(state.quota_stream(stream(spark, rows, schema, str(tmp_path / "q"))), "quota").collect()
    per = {}
    for r in got:
        per.setdefault((r.layer, r.day), []).append(r.granted)
    assert {k: (sum(v), len(v)) for k, v in per.items()} == {("gdelt", dt.date(2024, 1, 1)): (40, 60), ("gdelt", dt.date(2024, 1, 2)): (40, 40), ("other", dt.date(2024, 1, 1)): (2, 4)}
    batch = state.quota_batch(spark.createDataFrame(rows[:100], schema), 40).orderBy("day").collect()
    assert [(r.asked, r.granted, r.refused) for r in batch] == [(60, 40, 20), (40, 40, 0)]


def test_quota_windows(spark, tmp_path):
    rows = [("gdelt", at(1 + k // 30, k % 30)) for k in range(70)]
    df = state.quota_windows(stream(spark, rows, "layer string, ts timestamp", str(tmp_path / "w")))
    assert sorted(r.asked for r in run(df, "windows", "complete").collect()) == [10, 30, 30]


def test_breaker_stream(spark, tmp_path):
    rows = [("gdelt", at(1, m), m, f) for m, f in [(0, ""), (1, "limit"), (5, "limit"), (10, ""), (11, ""), (12, "connection"), (16, ""), (17, "")]]
    got = run(state.breaker_stream(stream(spark, rows, "layer string, ts timestamp, event_id long, failure string", str(tmp_path / "b"))), "breaker")
    assert {r.event_id for r in got.collect() if not r.allowed} == {5, 10, 16}


def test_feedback_adds_each_article_once(spark, tmp_path):
    schema = "doc_id long, url string, text string, chars int, score double, label string"
    rows = [(1, "http://a", "texto aprovado", 14, 80.0, "reliable"), (2, "http://a", "mesmo endereço", 14, 90.0, "reliable"), (3, "http://b", "x", 1, 70.0, "reliable"), (4, "", "x", 1, 90.0, "reliable")]
    path = str(tmp_path / "index")
    for turn in range(2):
        q = state.feed_index(stream(spark, rows, schema, str(tmp_path / "in")), path, checkpoint=str(tmp_path / f"check{turn}"))
        q.processAllAvailable()
        q.stop()
    held = index.load(spark, path).collect()
    assert [(r.url, r.text, r.source_type) for r in held] == [("http://a", "texto aprovado", "analyzed_news")]


def test_whole_analysis(spark):
    fact = "O ministro Ana Maria afirmou que a taxa de juros caiu para 10,5 pontos em março, segundo relatório oficial."
    docs = [(1, "https://www.bbc.com/n/1", "Juros", fact + "\n" + "Uma linha de apoio comprida o bastante para contar como bloco do texto."), (2, "http://z.com/2", "Nada", "curto"), (3, None, None, None)]
    docs = spark.createDataFrame(docs, "doc_id long, url string, title string, text string")
    stored = [("e1", fact + " A decisão foi unânime.", "s", "http://e.com/1", None, None, "news")]
    rows = spark.createDataFrame(stored, "base_doc_id string, text string, source string, url string, published_at string, metadata map<string,string>, source_type string")
    out = analyse.analyse(docs, {"vector_store": index.vector_layer(index.rows_of(rows))})
    scores = {r.doc_id: r for r in out["scores"].collect()}
    assert scores[1].claims >= 1 and scores[1].reputation == 0.9 and scores[2].label == "unverified" and scores[3].reputation == 0.0
    assert out["evidence"].count() >= 1 and {r.claim_id for r in out["stance"].collect()} == {r.claim_id for r in out["claims"].collect()}
    assert out["features"].count() == 3


def test_documents_of_pages(spark):
    page = "<article>" + "".join(f"<p>Parágrafo número {k} com texto comprido o bastante para ser um bloco.</p>" for k in range(6)) + "</article>"
    row = analyse.documents_of(spark.createDataFrame([(1, "http://a.com", page)], "page_id long, url string, html string")).first()
    assert row.text.count("\n") == 5


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("name", ["claim_types", "segments_overlap", "retrieval_ranked", "index_delete"])
def test_results_do_not_depend_on_partitions(spark, name, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    want = sorted(map(str, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect()))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        assert sorted(map(str, queries.QUERIES[name](spark, "/root/testdata/sf0.001").collect())) == want and want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_entry_without_training_operators(spark):
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    code = "import sys; sys.modules['attestor.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == [str(len(queries.QUERIES)), "False"], out.stderr
