"""The vector index as a table: append, delete, statistics, and the feedback of approved articles."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import urls
from .chunks import char_chunks
from .vectors import hashed_embedding

SCHEMA = (
    "vec_id long, doc_id string, base_doc_id string, chunk_id int, text string, source string, url string, published_at string, "
    "metadata map<string,string>, indexed_at timestamp, embedding array<double>, source_type string"
)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The index at ``path``, or an empty one where there is none or none that can be read. Files of it that are damaged
    are left out, with a warning in Spark's log, so that an index can be filled again."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    empty = spark.createDataFrame([], SCHEMA)
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        return empty
    try:
        return spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true").parquet(path)
    except AnalysisException:
        return empty


def rows_of(docs: DataFrame, cfg: EngineConfig = DEFAULT, embedder=hashed_embedding, start: int = 0) -> DataFrame:
    """Index rows of ``docs`` (``base_doc_id, text, source, url, published_at, metadata, source_type``): one for each
    chunk. Vector numbers follow from document and chunk, so appends do not renumber."""
    chunks = char_chunks(docs, id_col="base_doc_id", cfg=cfg).withColumnRenamed("doc_id", "base_doc_id").drop("start")
    meta = docs.select("base_doc_id", "source", "url", "published_at", "metadata", "source_type")
    rows = chunks.join(meta, "base_doc_id").withColumn("doc_id", F.concat_ws("_", "base_doc_id", "chunk_id"))
    rows = rows.withColumn("vec_id", F.xxhash64("base_doc_id", "chunk_id", F.lit(start)))
    return rows.withColumn("indexed_at", F.current_timestamp()).withColumn("embedding", embedder(F.col("text"))).select(
        *[c.split(" ")[0] for c in SCHEMA.replace("map<string,string>", "map").split(", ")]
    )


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("source_type").parquet(path)


def delete(index: DataFrame, base_doc_ids: DataFrame) -> DataFrame:
    """The index without the documents ``base_doc_ids`` (a table of that column)."""
    return index.join(base_doc_ids, "base_doc_id", "left_anti")


def numbered(index: DataFrame) -> DataFrame:
    """Adds ``position`` from 0 in the order of vec_id over the whole index: numbers inside ranges plus the sizes of
    the ranges before, so no task orders all rows."""
    from ..plans.numbering import number_rows

    return number_rows(index, ["vec_id"], "position")


def stats(index: DataFrame, base_col: str = "base_doc_id", source_col: str = "source") -> DataFrame:
    """Chunks and documents for each source."""
    return index.groupBy(source_col).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct(base_col).alias("documents"))


def gate(results: DataFrame, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """Adds ``approved`` and ``gate_reason`` to results with ``url, chars, score, label``: the first rule that fails
    names the reason."""
    reason = (
        F.when(F.coalesce("url", F.lit("")) == "", "no_url")
        .when(F.coalesce("chars", F.lit(0)) == 0, "no_text")
        .when(F.col("score").isNull(), "no_score")
        .when(F.col("score") < cfg.index_min_score, "low_score")
        .when(F.coalesce("label", F.lit("")) != "reliable", "label")
        .otherwise("approved")
    )
    return results.withColumn("gate_reason", reason).withColumn("approved", F.col("gate_reason") == "approved")


def new_only(results: DataFrame, index: DataFrame, url_col: str = "url") -> DataFrame:
    """Results whose exact address the index does not hold; of results with one address, the first by doc_id."""
    first = Window.partitionBy(url_col).orderBy("doc_id")
    once = results.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return once.join(index.select(F.col("url").alias(url_col)).distinct(), url_col, "left_anti")


def vector_layer(index: DataFrame, *, labelled: str = "labelled_corpus"):
    """A retrieval layer over the index: for each of a claim's ``queries`` in their order (or its one ``query``) the best
    2 * top_k chunks of at least the layer's similarity, without labelled-corpus rows and without the claim's own article
    (its ``article_url``); a chunk counts where it is met first, and the first top_k make the claim's candidates."""
    from .vectors import top_hits

    def search(claims: DataFrame, cfg: EngineConfig) -> DataFrame:
        asked = F.col("queries") if "queries" in claims.columns else F.array("query")
        rows = claims.select("claim_id", "article_url", F.posexplode(asked).alias("q", "query"))
        rows = rows.withColumn("query_id", F.xxhash64("claim_id", "q"))
        base = index.withColumn("base_id", F.xxhash64("base_doc_id"))
        queries = rows.select("query_id", hashed_embedding(F.col("query")).alias("embedding"))
        hits = top_hits(base, queries, 2 * cfg.top_k, cfg.vector_min_similarity).drop("base_id")
        hits = hits.join(index.drop("embedding"), "vec_id").join(rows.select("query_id", "claim_id", "article_url", "q"), "query_id")
        hits = hits.where((F.coalesce("source_type", F.lit("")) != labelled) & ~F.coalesce(urls.same_article(F.col("article_url"), F.col("url")), F.lit(False)))
        met = Window.partitionBy("claim_id", "vec_id").orderBy("q", "n")
        hits = hits.withColumn("__m", F.row_number().over(met)).where("__m = 1")
        first = Window.partitionBy("claim_id").orderBy("q", "n", "vec_id")
        hits = hits.withColumn("pos", F.row_number().over(first)).where(F.col("pos") <= cfg.top_k)
        return hits.select(
            "claim_id", "pos", "url", F.lit(None).cast("string").alias("title"), "text", F.col("score").alias("similarity"), "source",
            "source_type", F.lit(False).alias("trusted"), "published_at", "metadata",
        )

    return search
