"""Command line: ``python -m attestor.jobs seed --index PATH --corpus DIR [--table CSV] [--files N] [--clear]`` and
``python -m attestor.jobs trusted --index PATH --pages PARQUET [--domains a.com,b.com]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import DEFAULT
from .operators import index
from .sources import seeds


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="attestor.jobs")
    jobs = out.add_subparsers(dest="job", required=True)
    seed = jobs.add_parser("seed", help="index a folder of texts")
    seed.add_argument("--corpus", nargs="+", required=True, help="folders; the first that holds text files is read")
    seed.add_argument("--table", help="CSV with columns about the files")
    seed.add_argument("--files", type=int, default=seeds.CORPUS_FILES)
    trusted = jobs.add_parser("trusted", help="index pages of trusted domains")
    trusted.add_argument("--pages", required=True, help="Parquet with page_id, url, html")
    trusted.add_argument("--domains", default=",".join(DEFAULT.trusted_domains))
    for job in (seed, trusted):
        job.add_argument("--index", required=True)
        job.add_argument("--clear", action="store_true", help="start from an empty index")
    return out


def documents(spark: SparkSession, args: argparse.Namespace):
    if args.job == "trusted":
        domains = spark.createDataFrame([(d.strip(),) for d in args.domains.split(",") if d.strip()], "domain string")
        return seeds.trusted_articles(spark.read.parquet(args.pages), domains)
    folder = seeds.first_existing(spark, args.corpus)
    if folder is None:
        raise SystemExit("no folder with text files")
    rows = seeds.corpus_folder(spark, folder, args.table, args.files)
    return rows.select(
        F.col("stem").alias("base_doc_id"), "text", F.lit("corpus").alias("source"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("published_at"), F.create_map(F.lit("file"), F.col("stem")).alias("metadata"), F.lit("labelled_corpus").alias("source_type"),
    )


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"attestor-{args.job}").getOrCreate()
    rows = index.rows_of(documents(spark, args))
    if args.clear:
        rows.write.mode("overwrite").partitionBy("source_type").parquet(args.index)
    else:
        index.append(rows, args.index)
    index.stats(index.load(spark, args.index)).orderBy("source").show(truncate=False)


if __name__ == "__main__":
    main()
