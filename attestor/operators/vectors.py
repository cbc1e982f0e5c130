"""Vector search and rerank."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions.numbers import cosine, round_at
from ..plans.shared import written

#: Values of the query side that one pass holds in a task: rows times dimensions.
PASS_VALUES = 2_000_000


def hashed_embedding(col: Column, dims: int = 64) -> Column:
    """A unit vector of hashed word counts: the default embedder where no model is given. Empty texts are zero."""
    from ..functions import text as tx
    from ..functions.numbers import unit_vector

    places = F.transform(tx.feature_tokens(col), lambda t: F.pmod(F.xxhash64(t), F.lit(dims)).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.size(F.filter(places, lambda p: p == k)).cast("double"))
    return unit_vector(counts)


def embedding_key(text: Column, model: str) -> Column:
    """Name of a text's embedding by a model: the first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(F.concat(F.lit(f"{model}::"), F.coalesce(text, F.lit(""))).cast("binary"), 256), 1, 16)


def embed(
    texts: DataFrame, text_col: str, embedder=hashed_embedding, *, prefix: int | None = None, order: str | None = None, memo: DataFrame | None = None, model: str = "hashed"
) -> DataFrame:
    """Adds ``embedding``. Equal texts (or, with ``prefix``, texts with equal beginnings, of which the first by ``order``,
    else the smallest, stands for all) are embedded once and joined back. Texts whose key ``memo`` (``key, embedding``)
    holds are not embedded again."""
    start = F.substring(F.col(text_col), 1, prefix) if prefix else F.col(text_col)
    rows = texts.withColumn("__k", F.coalesce(start, F.lit("")))
    chosen = F.min_by(text_col, F.struct(order, text_col)) if order else F.min(text_col)
    once = rows.groupBy("__k").agg(F.trim(F.coalesce(chosen, F.lit(""))).alias("__t"))
    if memo is None:
        once = once.withColumn("embedding", embedder(F.col("__t")))
    else:
        once = once.withColumn("__h", embedding_key(F.col("__t"), model))
        held = memo.select(F.col("key").alias("__h"), "embedding")
        fresh = once.join(held, "__h", "left_anti").withColumn("embedding", embedder(F.col("__t")))
        once = once.join(held, "__h").unionByName(fresh).drop("__h")
    return rows.join(once.drop("__t"), "__k").drop("__k")


def memo_of(embedded: DataFrame, text_col: str, model: str = "hashed") -> DataFrame:
    """``key, embedding`` of embedded texts, each once, to be stored for later runs."""
    return embedded.select(embedding_key(F.trim(F.col(text_col)), model).alias("key"), "embedding").dropDuplicates(["key"])


def memo_stats(texts: DataFrame, text_col: str, memo: DataFrame | None = None, model: str = "hashed") -> DataFrame:
    """``asked, different, hits, misses, hit_rate``: how many texts need no embedding of their own because an equal one
    came before or ``memo`` holds it."""
    keys = texts.groupBy(embedding_key(F.trim(F.coalesce(F.col(text_col), F.lit(""))), model).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    held = F.lit(False)
    if memo is not None:
        keys = keys.join(memo.select("key", F.lit(True).alias("held")).dropDuplicates(["key"]), "key", "left")
        held = F.coalesce("held", F.lit(False))
    sums = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("asked"), F.count(F.lit(1)).alias("different"), F.count_if(~held).alias("misses"))
    hits = F.col("asked") - F.col("misses")
    return sums.select("asked", "different", hits.alias("hits"), "misses", F.when(F.col("asked") > 0, round_at(hits / F.col("asked"))).otherwise(F.lit(0.0)).alias("hit_rate"))


def top_hits(index: DataFrame, queries: DataFrame, k: int, least: float) -> DataFrame:
    """``query_id, vec_id, base_id, score``: the ``k`` best of the index for each query with at least ``least``.

    ``index`` has ``vec_id, base_id, embedding``, ``queries`` has ``query_id, embedding`` (unit vectors). Queries are
    collected in passes of at most PASS_VALUES values, measured first, and broadcast; each task multiplies its part of
    the index with them and returns its own best, so the shuffle carries k rows for each query and task. Where there
    are several passes each is written before the next is collected, so driver and workers hold one at a time. Ties go
    to the smaller vec_id."""
    spark = index.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    passes = max(1, -(-(size["n"] * (size["d"] or 1)) // PASS_VALUES))
    found = []
    for number in range(passes):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number) if passes > 1 else queries
        rows = part.select("query_id", "embedding").orderBy("query_id").collect()
        ids = np.array([r["query_id"] for r in rows], np.int64)
        shared = spark.sparkContext.broadcast((ids, np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)))
        hits = index.select("vec_id", "base_id", "embedding").mapInArrow(
            _searcher(shared, k, least), "query_id long, vec_id long, base_id long, score double"
        )
        if passes > 1:
            hits = written(hits, "hits")
            shared.destroy()
        found.append(hits)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, found).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k)


def _searcher(shared, k: int, least: float):
    """Keeps each query's k best (query number, vec_id, base_id, score) from batch to batch, as arrays."""

    def run(batches):
        ids, wanted = shared.value
        kinds = (np.int64, np.int64, np.int64, np.float64)
        best = [np.empty(0, t) for t in kinds]
        for batch in batches:
            if not batch.num_rows or not len(ids):
                continue
            vectors = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64)
            scores = np.floor((vectors @ wanted.T) * 1e6 + 0.5) / 1e6
            if batch.num_rows > k:  # what is below a query's k-th best of the batch is no hit
                floor = np.maximum(np.partition(scores, batch.num_rows - k, axis=0)[batch.num_rows - k], least)
            else:
                floor = least
            row, q = np.nonzero(scores >= floor)
            fresh = [q, batch.column("vec_id").to_numpy()[row], batch.column("base_id").to_numpy(zero_copy_only=False)[row].astype(np.int64), scores[row, q]]
            both = [np.concatenate(x) for x in zip(best, fresh)]
            order = np.lexsort((both[1], -both[3], both[0]))
            both = [x[order] for x in both]
            place = np.arange(len(order)) - np.searchsorted(both[0], both[0], "left")
            best = [x[place < k] for x in both]
        columns = [ids[best[0]], *best[1:]] if len(ids) else best
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "base_id", "score"])

    return run


def knn(index: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.30) -> DataFrame:
    """The ``k`` best base documents of each query: of its 3k best vectors, the best of each base document, with
    ``rank`` from 1."""
    hits = top_hits(index, queries, 3 * k, least).drop("n")
    per_base = Window.partitionBy("query_id", "base_id").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("__n", F.row_number().over(per_base)).where("__n = 1").drop("__n")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_matrix(rows: DataFrame, key: str, vector: str, block: int = 2048) -> DataFrame:
    """``key, other, cosine`` (6 digits) of all pairs with ``key`` below ``other``.

    Rows are dealt into blocks of about ``block``, and each pair of blocks is one key of an equi-join: every task holds
    two blocks, however many rows there are."""
    blocks = max(1, -(-rows.count() // block))
    own = rows.select(key, F.col(vector).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("own"))
    mates = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least("own", k).alias("low"), F.greatest("own", k).alias("high")))
    dealt = own.select(key, "v", "own", F.explode(mates).alias("pair"))
    left = dealt.where("own = pair.low").select("pair", F.col(key).alias("x"), F.col("v").alias("a"))
    right = dealt.where("own = pair.high").select("pair", F.col(key).alias("y"), F.col("v").alias("b"))
    low, high = F.col("pair.low"), F.col("pair.high")
    both = left.join(right, "pair").where((low != high) | (F.col("x") < F.col("y")))
    first = F.col("x") < F.col("y")
    value = round_at(cosine(F.col("a"), F.col("b")), 6)
    return both.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias(key), F.when(first, F.col("y")).otherwise(F.col("x")).alias("other"), value.alias("cosine"))


def rerank(pairs: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Pairs ``claim_id, evidence_id, similarity, semantic`` scored by both, weak ones dropped, the best of each claim
    with ``rank`` from 0 and ``is_sufficient``; ties in the order of ``pos`` where there is one, then of ids."""
    final = round_at(F.least(cfg.semantic_weight * F.col("semantic") + (1 - cfg.semantic_weight) * F.col("similarity"), F.lit(1.0)))
    rows = pairs.withColumn("final", final).where(F.col("final") >= cfg.rerank_min)
    ties = ["pos", "evidence_id"] if "pos" in pairs.columns else ["evidence_id"]
    order = Window.partitionBy("claim_id").orderBy(F.desc("final"), *ties)
    rows = rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < cfg.rerank_top_k)
    return rows.withColumn("is_sufficient", F.col("final") >= cfg.rerank_sufficient)


def claim_similarity(claims: DataFrame, reranked: DataFrame) -> DataFrame:
    """For every claim: ``score`` (that of its best evidence, else 0), ``has_evidence``, ``has_sufficient``, ``top``."""
    best = reranked.groupBy("claim_id").agg(
        F.max("final").alias("score"),
        F.bool_or("is_sufficient").alias("has_sufficient"),
        F.min_by("evidence_id", "rank").alias("top"),
        F.count(F.lit(1)).alias("n_evidence"),
    )
    out = claims.select("claim_id").join(best, "claim_id", "left")
    return out.select(
        "claim_id",
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("score").isNotNull().alias("has_evidence"),
        F.coalesce("has_sufficient", F.lit(False)).alias("has_sufficient"),
        "top",
        F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"),
    )
