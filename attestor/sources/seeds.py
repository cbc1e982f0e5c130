"""Seed corpora: url lists, text folders with their tables, feeds."""

from __future__ import annotations

import html
import xml.etree.ElementTree as ET
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..operators import clean, pages
from ..plans.numbering import number_rows

MIN_TRUSTED_CHARS, MIN_FEED_CHARS, MIN_CORPUS_CHARS = 500, 200, 100
FEED_ENTRIES, SEED_LINKS, CORPUS_FILES = 15, 5, 300


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    """``url``: the lines of a text file, trimmed, without blank ones and comments, each once."""
    rows = spark.read.text(path).select(F.trim("value").alias("url"))
    return rows.where("url <> '' and not startswith(url, '#')").distinct()


def trusted_only(rows: DataFrame, domains: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows whose domain is in the table ``domains`` (``domain``)."""
    return rows.withColumn("domain", urls.domain(F.col(url_col))).join(domains.select("domain").distinct(), "domain", "left_semi")


def trusted_articles(page_rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Articles of trusted pages (``page_id, url, html``) with enough clean text, as documents for the index."""
    found = pages.articles(trusted_only(page_rows, domains))
    found = found.withColumn("text", F.array_join(clean.clean_blocks(F.col("blocks")), "\n\n"))
    return _documents(found.where(F.length("text") >= MIN_TRUSTED_CHARS), "trusted_news", F.col("page_id").cast("string"))


def _documents(rows: DataFrame, kind: str, key) -> DataFrame:
    return rows.select(
        key.alias("base_doc_id"), "text", urls.domain(F.col("url")).alias("source"), "url", F.lit(None).cast("string").alias("published_at"),
        F.create_map(F.lit("title"), F.coalesce("title", F.lit(""))).alias("metadata"), F.lit(kind).alias("source_type"),
    )


def first_existing(spark: SparkSession, folders: list[str]) -> str | None:
    """The first of ``folders`` that holds a text file."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.txt")
        found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
        if found is not None and len(found):
            return folder
    return None


def corpus_folder(spark: SparkSession, folder: str, table: str | None = None, files: int = CORPUS_FILES) -> DataFrame:
    """The first ``files`` text files of ``folder`` by name, cleaned, with enough text, and the columns of the CSV
    ``table`` that names them (by ``id``, ``ID`` or ``filename``)."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1)
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True).select(stem.alias("stem"), F.col("value").alias("raw"))
    rows = number_rows(rows, ["stem"], "n").where(F.col("n") < files).drop("n")
    rows = rows.select("stem", clean.clean(F.col("raw")).alias("text")).where(F.length("text") >= MIN_CORPUS_CHARS)
    if table is None:
        return rows
    side = spark.read.csv(table, header=True)
    keys = [F.col(c) for c in ("id", "ID", "filename") if c in side.columns]
    side = side.withColumn("stem", F.regexp_replace(F.coalesce(*keys), r"\.txt$", "")).dropDuplicates(["stem"])
    return rows.join(side, "stem", "left")


class _Links(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.href, self.words = [], None, []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.href, self.words = dict(attrs)["href"], []

    def handle_data(self, data):
        if self.href:
            self.words.append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.href:
            self.found.append((self.href, " ".join("".join(self.words).split()), ""))
            self.href = None


def feed_items(source: str | None) -> list[tuple[str, str, str]]:
    """(url, title, summary) of a feed's items or entries, or of a page's links where it is no feed."""
    try:
        root = ET.fromstring(source or "")
    except ET.ParseError:
        parser = _Links()
        parser.feed(source or "")
        return parser.found
    out = []
    for item in root.iter():
        if item.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        own = {}
        for child in item:
            name = child.tag.rpartition("}")[2]
            own.setdefault(name, child.get("href") or " ".join("".join(child.itertext()).split()))
        url = own.get("link") or own.get("guid") or ""
        out.append((url, own.get("title", ""), html.unescape(own.get("description") or own.get("summary") or "")))
    return out


ITEM = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("url", "title", "summary")]))


def feed_rows(responses: DataFrame, blocked: tuple[str, ...], per_seed: int = SEED_LINKS) -> DataFrame:
    """``query, seed, pos, url, title, summary``: of each stored response (``query, seed, body``) the first ``per_seed``
    allowed addresses, redirects unwrapped; of a query each address once, in the order of seeds."""

    @F.arrow_udf(ITEM)
    def items(bodies: pa.Array) -> pa.Array:
        names = ("url", "title", "summary")
        kind = pa.list_(pa.struct([(n, pa.string()) for n in names]))
        return pa.array([[dict(zip(names, x)) for x in feed_items(b.as_py())] for b in bodies], kind)

    rows = responses.select("query", "seed", F.posexplode(items("body")).alias("pos", "x")).select("query", "seed", "pos", "x.*")
    rows = rows.withColumn("url", urls.unwrap(F.col("url"))).where(urls.candidate_allowed(F.col("url"), blocked))
    rows = rows.withColumn("__k", F.regexp_replace(F.trim("url"), "/+$", ""))
    once = Window.partitionBy("query", "__k").orderBy("seed", "pos")
    rows = rows.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    first = Window.partitionBy("query", "seed").orderBy("pos")
    return rows.withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_seed).drop("__n", "__k")


def feed_articles(entries: DataFrame, page_rows: DataFrame, per_feed: int = FEED_ENTRIES) -> DataFrame:
    """Articles of the first ``per_feed`` entries of each feed (``feed, pos, url, title``), whose pages (``page_id, url,
    html``) have enough clean text, as documents for the index. An address that several feeds list is taken once, from the
    first feed by name."""
    first = Window.partitionBy("feed").orderBy("pos")
    rows = entries.where("trim(url) <> ''").withColumn("__n", F.row_number().over(first)).where(F.col("__n") <= per_feed)
    once = Window.partitionBy("url").orderBy("feed", "pos")
    rows = rows.withColumn("__n", F.row_number().over(once)).where("__n = 1")
    held = page_rows.dropDuplicates(["url"]).join(rows.select("url", F.col("title").alias("entry_title")), "url")
    found = pages.articles(held.select("page_id", "url", "html"))
    found = found.withColumn("text", F.array_join(clean.clean_blocks(F.col("blocks")), "\n\n"))
    found = found.drop("title").join(held.select("page_id", F.col("entry_title").alias("title")), "page_id")
    return _documents(found.where(F.length("text") >= MIN_FEED_CHARS), "rss_news", F.col("page_id").cast("string"))


def seed_addresses(queries: DataFrame, templates: list[str]) -> DataFrame:
    """``query, seed, address``: each query (``query``) with each search template, ``{query}`` url-encoded. Templates are
    a configured list, so this is an explode."""
    rows = queries.select("query", F.posexplode(F.array(*[F.lit(t) for t in dict.fromkeys(templates)])).alias("seed", "t"))
    return rows.select("query", "seed", F.replace("t", F.lit("{query}"), F.url_encode("query")).alias("address"))
