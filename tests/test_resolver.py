import json

from pyspark.sql import functions as F

from attestor.operators import claims, resolver

ROWS = [(1, 0, k, f"Frase número {k} do texto") for k in range(10)] + [(2, 0, 0, "Outra frase"), (3, 0, 0, "Mais uma"), (4, 0, 0, "Última")]


def batched(spark):
    return claims.batches(spark.createDataFrame(ROWS, "doc_id long, block_index int, sent_index int, text string"))


def test_requests_number_sentences_from_one(spark):
    got = {(r.doc_id, r.batch): (r.n, r.message) for r in resolver.requests(batched(spark)).collect()}
    assert got.keys() == {(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)} and got[1, 0][0] == 8 and got[1, 1][0] == 2
    assert got[1, 1][1].endswith("1. Frase número 8 do texto\n2. Frase número 9 do texto")


def test_replies_are_joined_by_number(spark):
    said = [
        {"index": 2, "is_claim": True, "confidence": 0.9, "claims": [{"text": "c", "confidence": 0.7, "claim_type": "causal", "entities": ["Ana Lima"]}, {"claim_type": "odd"}]},
        {"index": 1, "is_claim": False, "confidence": 0.2, "reject_reason": "opinion"},
    ]
    attempts = [
        (1, 0, 1, None), (1, 0, 2, "```json\n" + json.dumps(said) + "\n```"), (1, 0, 3, "[]"), (1, 1, 1, json.dumps([{"is_claim": True}])),
        (2, 0, 1, None), (2, 0, 4, json.dumps(said)), (3, 0, 1, "no list"),
    ]
    rows = resolver.resolved(batched(spark), spark.createDataFrame(attempts, "doc_id long, batch int, attempt int, reply string"))
    got = {(r.doc_id, r.sent_index): (r.is_claim, r.resolver_confidence, r.reject_reason) for r in rows.collect()}
    assert len(got) == len(ROWS)
    assert got[1, 0] == (False, 0.2, "opinion") and got[1, 1] == (True, 0.9, None) and got[1, 2] == (False, 0.5, None)
    assert got[1, 8] == (True, 0.5, None)  # without a number the place counts
    assert got[2, 0] == (False, 0.4, "failed") and got[3, 0] == (False, 0.35, "unreadable") and got[4, 0] == (False, 0.5, "unasked")
    made = [(r.claim_index, r.claim_text, r.confidence, r.claim_type, r.entities) for r in resolver.claims_of(rows).orderBy("claim_index").collect()]
    assert made == [(0, "c", 0.7, "causal", ["Ana Lima"]), (1, "Frase número 1 do texto", 0.5, "ambiguous", [])]
    doc = json.loads(resolver.result_rows(rows).where("doc_id = 1 and sent_index = 1").first().document)
    assert doc["is_claim"] and doc["confidence"] == 0.9 and len(doc["claims"]) == 2 and doc["reject_reason"] is None and doc["sentence"]["sent_index"] == 1


def test_no_ambiguous_sentences(spark):
    none = batched(spark).limit(0)
    attempts = spark.createDataFrame([], "doc_id long, batch int, attempt int, reply string")
    assert resolver.resolved(none, attempts).collect() == [] and resolver.requests(none).collect() == []


def test_source_prompt_and_validation(spark):
    df = spark.createDataFrame([("c", "A frase", ["q1", "q2"], "ctx", "http://a.com/x")], "claim_id string, text string, queries array<string>, context string, article_url string")
    prompt = resolver.source_prompt(df, ("bbc.com",)).first().prompt
    assert all(part in prompt for part in ("A frase", '["q1","q2"]', "ctx", "http://a.com/x", "bbc.com", '{"found": false}'))
    cases = [("http://b.com/y", 200, True), ("http://b.com/y", 404, False), ("http://a.com/x/", 200, False), ("ftp://b.com", 200, False), (None, 200, False), ("http://b.com/y", None, False)]
    rows = spark.createDataFrame(cases, "url string, status int, want boolean")
    assert all(r.got == r.want for r in rows.withColumn("got", resolver.valid_source(F.col("url"), F.lit("http://a.com/x"), F.col("status"))).collect())
