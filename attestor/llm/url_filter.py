"""URL filters: allow and block rules, spread over redirect and canonical-link aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, ascii_lower
from .components import connected_components

#: (verdict, host and path prefix); the host part ends at the first slash.
DEFAULT_RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)
#: Rule lists up to this length become one expression; longer ones belong in a table (match_rules_table).
MAX_INLINE_RULES = 512

LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    return F.when(F.instr(url, "://") > 0, F.expr("substring(__url, instr(__url, '://') + 3)")).otherwise(F.lit(""))


def split_url(df: DataFrame, url: Column) -> DataFrame:
    """Adds ``host`` and ``path`` (both empty for a null url or one without ``://``) and ``__node``, the url's name as
    a node: host, path and query without scheme and fragment, null where the host is empty."""
    df = df.withColumn("__url", url).withColumn("__rest", F.coalesce(_rest(F.col("__url")), F.lit("")))
    df = df.withColumn("__h", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    df = df.withColumn("__tail", F.expr("substring(__rest, length(__h) + 1)"))
    df = df.withColumn("host", ascii_lower(F.col("__h"))).withColumn("path", F.regexp_extract("__tail", r"^[^?#]*", 0))
    node = F.concat("host", F.regexp_extract("__tail", r"^[^#]*", 0))
    return df.withColumn("__node", F.when(F.col("host") != "", node)).drop("__url", "__rest", "__h", "__tail")


def _fits(rule: str, host: Column, path: Column) -> Column:
    own, slash, rest = rule.partition("/")
    return ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)


def match_rules(rules, host: Column, path: Column) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null where none does. Of equally long ones allow wins."""
    if len(rules) > MAX_INLINE_RULES:
        raise ValueError("put long rule lists in a table and use match_rules_table")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):
        out = F.when(_fits(rule, host, path), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def match_rules_table(df: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Like match_rules for a table of rules (``verdict, rule``) of any size; ``df`` has host, path and a unique key.

    A url meets the rules of its host and of that host's parent domains in an equi-join; the longest rule that fits
    is an aggregate, so neither side is broadcast unless Spark finds it small.
    """
    labels = F.split("host", r"\.")
    suffix = F.expr("transform(sequence(1, size(__l)), i -> array_join(slice(__l, i, size(__l) - i + 1), '.'))")
    pairs = df.select(key, "path", labels.alias("__l")).select(key, "path", F.explode(suffix).alias("__own"))
    rules = rules.select(
        "verdict", "rule", F.substring_index("rule", "/", 1).alias("__own"), F.expr("substring(rule, instr(rule, '/'))").alias("__prefix")
    )
    order = F.struct(F.length("rule"), (F.col("verdict") == "allow").alias("a"), "rule")
    found = pairs.join(rules, "__own").where(F.col("path").startswith(F.col("__prefix")))
    best = found.groupBy(key).agg(F.max_by(F.struct("rule", "verdict"), order).alias("__m"))
    return df.join(best, key, "left")


def decode_entities(col: Column) -> Column:
    """Numeric references and ``&amp; &lt; &gt; &quot; &apos;`` as characters, each once; others stay."""
    parts = F.split(col, "&")

    def one(part: Column) -> Column:
        name = F.lower(F.regexp_extract(part, r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|amp|lt|gt|quot|apos);", 1))
        digits = F.when(name.startswith("#x"), F.conv(F.substring(name, 3, 6), 16, 16)).otherwise(F.conv(F.substring(name, 2, 7), 10, 16))
        code = F.conv(digits, 16, 10).cast("int")
        number = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))
        named = F.when(name == "amp", "&").when(name == "lt", "<").when(name == "gt", ">").when(name == "quot", '"').when(name == "apos", "'")
        value = F.when(name.startswith("#"), number).otherwise(named)
        return F.coalesce(F.concat(value, F.regexp_extract(part, r"(?s)^[^;]*;(.*)$", 1)), F.concat(F.lit("&"), part))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, 100_000), one), ""))


def _without_dots(path: Column) -> Column:
    """A path that starts with a slash, its segments ``.`` and ``..`` worked off."""
    parts = F.slice(F.split(path, "/"), 2, 100_000)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    end = F.when(path.rlike(r"/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.lit("/"), F.array_join(F.concat(kept, end), "/"))


def resolve(url: Column, target: Column) -> Column:
    """The address that ``target`` names on the page ``url``; null for schemes without ``://`` and where the page has no
    address to start from."""
    origin = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*", 0)
    base = F.regexp_extract(url, r"^[^/?#]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)?", 1)
    path, rest = F.regexp_extract(target, r"^[^?#]*", 0), F.regexp_extract(target, r"^[^?#]*(.*)$", 1)
    folder = F.when(base == "", "/").otherwise(F.regexp_extract(base, r"^.*/", 0))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(origin == "", F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(origin, _without_dots(path), rest))
        .when(target.startswith("?"), F.concat(origin, base, target))
        .when(target.startswith("#"), F.concat(origin, base, query, target))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), rest))
    )


def alias_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """``a, b``: nodes of a page and of each address that its canonical links or its refresh redirects name, relative
    ones resolved against the page's url."""
    rows = pages.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).where(F.col("h").rlike("(?i)canonical|http-equiv"))
    found = lambda tag, at: F.transform(F.regexp_extract_all("h", F.lit(tag), F.lit(0)), lambda x: F.regexp_extract(x, at, 1))
    rows = rows.where("instr(u, '://') > 0").select("u", F.explode(F.concat(found(LINK, HREF), found(REFRESH, REFRESH_URL))).alias("t")).where("t <> ''")
    rows = rows.select("u", decode_entities(F.col("t")).alias("t"))
    rows = rows.select("u", resolve(F.col("u"), F.col("t")).alias("t")).where("t is not null")
    rows = split_url(rows, F.col("u")).select("t", F.col("__node").alias("a"))
    return split_url(rows, F.col("t")).select("a", F.col("__node").alias("b")).where("a <> b")


def filter_urls(
    pages: DataFrame,
    *,
    rules=DEFAULT_RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """Allow or block each page: ``page_id, host, path, rule, verdict, decided_by``.

    A page that a rule fits takes the verdict of the longest rule (``decided_by`` is ``rule``). Any other page takes
    that of its aliases, the pages and addresses joined with it by redirects and canonical links in either direction
    through any number of steps: an explicit allow on any of them wins, else a block, else it is allowed
    (``decided_by`` is ``alias`` or ``default``). ``redirects`` may add edges as a table ``from_url, to_url``.

    Null urls and urls without ``://`` have empty host and path, fit no rule and have no aliases; pages with one url
    are one node; repeated rows are returned as often as they occur; an empty table gives no rows; other columns are
    ignored. Native: DataFrame functions only. Only edges and their nodes are shuffled, not the pages.
    """
    spark = pages.sparkSession
    work = Workspace(spark, "urls")
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        more = split_url(redirects.select("from_url", "to_url"), F.col("from_url")).select("to_url", F.col("__node").alias("a"))
        more = split_url(more, F.col("to_url")).select("a", F.col("__node").alias("b")).where("a <> b")
        edges = edges.unionByName(more)
    groups = connected_components(edges, work)

    nodes = groups.withColumn("__full", F.concat(F.lit("x://"), F.col("node")))
    nodes = split_url(nodes, F.col("__full")).withColumn("__m", match_rules(rules, F.col("host"), F.col("path")))
    voted = nodes.groupBy("component").agg(
        F.max(F.when(F.col("__m.verdict") == "allow", 2).when(F.col("__m.verdict") == "block", 1)).alias("__vote")
    )
    alias = groups.join(voted.where("__vote is not null"), "component").select(
        F.col("node").alias("__node"), F.when(F.col("__vote") == 2, "allow").otherwise("block").alias("__alias")
    )
    out = split_url(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__u")), F.col("__u"))
    out = out.withColumn("__m", match_rules(rules, F.col("host"), F.col("path"))).join(alias, "__node", "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("__m.rule").alias("rule"),
        F.coalesce("__m.verdict", "__alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("__m").isNotNull(), "rule").when(F.col("__alias").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
