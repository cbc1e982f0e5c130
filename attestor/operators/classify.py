"""Auxiliary text classifier over packed chunks, trained with Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, EngineConfig
from ..functions import text as tx
from .chunks import packed
from .score import weighted_probability


def chunk_rows(docs: DataFrame, cfg: EngineConfig = DEFAULT, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, chunk, text, weight`` of the packed chunks of a document's lines; ``weight`` is the chunk's length."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.posexplode(packed(lines, cfg)).alias("chunk", "text"))
    return rows.withColumn("weight", F.length("text"))


def fit(chunks: DataFrame, label: str, features: int = 1 << 14) -> PipelineModel:
    """Logistic regression on hashed words of chunks labelled 0 or 1."""
    rows = chunks.withColumn("words", tx.feature_tokens(F.col("text"))).withColumn("y", F.col(label).cast("double"))
    stages = [HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(labelCol="y", maxIter=20, regParam=0.01)]
    return Pipeline(stages=stages).fit(rows)


def classify(chunks: DataFrame, model: PipelineModel, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """One probability and label for each document from its chunks' predictions."""
    scored = model.transform(chunks.withColumn("words", tx.feature_tokens(F.col("text"))))
    p = vector_to_array("probability")[1]
    both = scored.select("doc_id", "weight", F.explode(F.array(F.struct(F.lit("real").alias("label"), p.alias("score")), F.struct(F.lit("fake").alias("label"), (1 - p).alias("score")))).alias("x"))
    return weighted_probability(both.select("doc_id", "weight", "x.label", "x.score"), "doc_id", cfg=cfg, first=F.col("label") == "real")


def classify_with(chunks: DataFrame, model, cfg: EngineConfig = DEFAULT) -> DataFrame:
    """:func:`classify` by a models.SequenceModel, whose labels are normalised; labels other than real and fake do not
    count."""
    scored = chunks.select("doc_id", "weight", F.posexplode(model(F.col("text"))).alias("k", "x"))
    rows = scored.select("doc_id", "weight", "k", normalise_label(F.col("x.label")).alias("label"), F.col("x.score").alias("score"))
    return weighted_probability(rows, "doc_id", cfg=cfg, first=F.col("k") == 0)


def normalise_label(col):
    """Lower case, hyphens and spaces as underscores, other characters than letters, digits and underscores dropped."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), "[- ]+", "_"), "[^a-z0-9_]", "")
