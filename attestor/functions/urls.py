"""URL and hash columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import safe_div
from .text import fold


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column) -> Column:
    """Host with its port and user part, lower-cased, without a leading ``www.``; empty where there is none."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def http_scheme(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike("(?i)^https?://")


def unsupported(url: Column, domains: list[str]) -> Column:
    """True where the domain ends with one of ``domains``, without regard to dots."""
    own = domain(url)
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: F.endswith(own, d))


def blocked(url: Column, domains) -> Column:
    """True for one of ``domains`` and their subdomains."""
    own = domain(url)
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (own == d) | F.endswith(own, F.concat(F.lit("."), d)))


def canonical(url: Column) -> Column:
    return F.regexp_replace(F.concat(domain(url), F.lower(path(url))), "/+$", "")


def article_slug(url: Column) -> Column:
    """The last 18 parts of three characters or more of a path without its AMP and HTML marks."""
    p = F.lower(path(url))
    for part, by in (("/google/amp/", "/"), ("/amp/", "/"), (".amp", "")):
        p = F.replace(p, F.lit(part), F.lit(by))
    p = F.regexp_replace(F.regexp_replace(p, r"\.(ghtml|html|htm)$", ""), "[^a-z0-9]+", "-")
    parts = F.filter(F.split(p, "-"), lambda x: F.length(x) >= 3)
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 17, F.lit(1)), F.lit(18)), "-")


def same_article(a: Column, b: Column) -> Column:
    """Equal addresses, or one domain and 65 % of the smaller slug's parts in common."""
    clean = lambda u: F.regexp_replace(F.trim(F.coalesce(u, F.lit(""))), "/+$", "")
    left, right = F.array_distinct(F.split(article_slug(a), "-")), F.array_distinct(F.split(article_slug(b), "-"))
    share = safe_div(F.size(F.array_intersect(left, right)), F.least(F.size(left), F.size(right)))
    known = (domain(a) != "") & (article_slug(a) != "") & (article_slug(b) != "")
    given = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return given & ((clean(a) == clean(b)) | (known & (domain(a) == domain(b)) & (share >= 0.65)))


def unwrap(url: Column) -> Column:
    """The address that a redirecting url carries in ``url``, ``u`` or ``q``, else the url itself."""
    inner = [F.regexp_extract(url, rf"[?&]{k}=([^&#]+)", 1) for k in ("url", "u", "q")]
    decoded = [F.try_url_decode(x) for x in inner]
    return F.coalesce(*[F.when(d.rlike("(?i)^https?://"), d) for d in decoded], url)


def candidate_allowed(url: Column, domains) -> Column:
    """An address with a host, not blocked and not that of a file of another kind than a page."""
    files = r"\.(pdf|jpg|jpeg|png|gif|webp|svg|mp4|mp3|zip|css|js|xml)$"
    return http_scheme(url) & (domain(url) != "") & ~blocked(url, domains) & ~F.lower(path(url)).rlike(files)


def short_hash(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, length)


def evidence_id(claim_id: Column, layer: Column, url: Column, text: Column) -> Column:
    return short_hash(claim_id, layer, url, F.substring(text, 1, 300))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(F.substring(fold(text), 1, 500), 256), 1, 16)


def claim_id(doc: Column, block: Column, sentence: Column) -> Column:
    """Ids follow from a claim's place, so reruns give the same."""
    return short_hash(doc, block, sentence, length=8)
