"""Articles from web pages: title, description, text blocks, paywall and script signals."""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions import urls

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SEMANTIC = ("articlebody", "article", "main")
MIN_BLOCK, MIN_TOTAL, CRAWL_LEAST = 40, 300, 35


class _Reader(HTMLParser):
    """One pass over a page. Open elements form a stack; text goes to every open block element, so an unclosed
    paragraph holds what follows it and inner ones are blocks of their own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, dict]] = []
        self.open: list[dict] = []
        self.blocks: list[dict] = []
        self.removed = 0
        self.titles: dict[str, list[str]] = {"headline": [], "h1": [], "title": []}
        self.meta: dict[str, str] = {}
        self.all_text: list[str] = []

    def _dropped(self, tag: str, own: dict) -> bool:
        return tag in lx.REMOVED_TAGS or any(part in own.get(name, "") for name, part in lx.REMOVED_ATTRIBUTES)

    def handle_starttag(self, tag, attrs):
        own = {k: (v or "").lower() for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(own.get("name") or own.get("property") or "", dict(attrs).get("content") or "")
        if tag in VOID:
            return
        gone = self._dropped(tag, own)
        self.removed += gone
        place = {x for t, a in self.stack for x in ([t] if t in ("article", "main") else []) + (["articlebody"] if a.get("itemprop") == "articlebody" else [])}
        classes = " ".join(a.get("class", "") for _, a in self.stack)
        self.stack.append((tag, own | {"gone": gone}))
        if tag in lx.BLOCK_TAGS + ["div"] and not self.removed:
            block = {"tag": tag, "class": own.get("class", ""), "above": classes, "place": place, "text": [], "depth": len(self.stack)}
            block["parent"] = self.stack[-2][1].get("class", "") if len(self.stack) > 1 else ""
            self.open.append(block)
            self.blocks.append(block)

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            name, own = self.stack.pop()
            self.removed -= own["gone"]
            while self.open and self.open[-1]["depth"] > len(self.stack):
                self.open.pop()
            if name == tag:
                break

    def handle_data(self, data):
        names = [t for t, _ in self.stack]
        if "title" in names:
            self.titles["title"].append(data)
        if self.removed:
            return
        if "h1" in names:
            self.titles["headline" if any(t == "h1" and a.get("itemprop") == "headline" for t, a in self.stack) else "h1"].append(data)
        self.all_text.append(data)
        for block in self.open:
            block["text"].append(data)


def _tidy(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def read_page(source: str | None) -> dict:
    """``title, description, blocks, paywall, scripted`` of a page's source; empty values for a null one."""
    source = source or ""
    reader = _Reader()
    reader.feed(source)
    reader.close()
    low = source.lower()
    title = _tidy(reader.titles["headline"]) or _tidy(reader.titles["h1"]) or " ".join(reader.meta.get("og:title", "").split())
    if not title:
        title = re.split(r"\||\s-\s", _tidy(reader.titles["title"]))[0].strip()
    description = reader.meta.get("description") or reader.meta.get("og:description") or ""
    blocks = _blocks(reader.blocks)
    return {
        "title": title,
        "description": htmllib.unescape(" ".join(description.split())),
        "blocks": blocks,
        "paywall": any(s in low for s in lx.PAYWALL_SIGNALS),
        "scripted": any(s.lower() in low for s in lx.SCRIPT_SIGNALS) and sum(map(len, blocks)) < MIN_TOTAL,
    }


def _chosen(blocks: list[dict]) -> list[str]:
    texts = [_tidy(b["text"]) for b in blocks if "paywall" not in b["parent"]]
    return list(dict.fromkeys(t for t in texts if len(t) >= MIN_BLOCK))


def _blocks(found: list[dict]) -> list[str]:
    named = [b for b in found if b["tag"] in lx.BLOCK_TAGS]
    for root in SEMANTIC:
        if any(root in b["place"] for b in found):
            chosen = _chosen([b for b in named if root in b["place"]])
            break
    else:
        chosen = []
    if sum(map(len, chosen)) >= MIN_TOTAL:
        return chosen
    for where, part in lx.PORTAL_PARAGRAPHS:
        if where == "self":
            portal = _chosen([b for b in found if part in b["class"]])
        else:
            portal = _chosen([b for b in found if b["tag"] == "p" and part in b["above"]])
        if sum(map(len, portal)) >= MIN_TOTAL:
            return portal
    return chosen or _chosen([b for b in found if b["tag"] == "p"])


ARTICLE = "title string, description string, blocks array<string>, paywall boolean, scripted boolean"


def articles(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, title, description, blocks, paywall, scripted, block_count, char_count, warnings`` for pages with
    a supported http address. The parser is Python, over batches; rows stay where they are. A page that gives neither
    title nor text has the warning ``empty``."""
    ok = urls.http_scheme(F.col(url_col)) & ~urls.unsupported(F.col(url_col), lx.UNSUPPORTED_DOMAINS)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.where(ok).select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([read_page(h) for h in batch["html"]], columns=["title", "description", "blocks", "paywall", "scripted"])
            yield pd.concat([batch[["page_id", "url"]].reset_index(drop=True), out], axis=1)

    out = rows.mapInPandas(run, f"page_id {kind}, url string, {ARTICLE}")
    chars = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.length(b))
    out = out.withColumn("block_count", F.size("blocks")).withColumn("char_count", chars)
    warnings = F.array_compact(
        F.array(F.when(F.col("paywall"), "paywall"), F.when(F.col("scripted"), "scripted"), F.when((F.col("title") == "") & (F.col("block_count") == 0), "empty"))
    )
    return out.withColumn("warnings", warnings)


class _Plain(HTMLParser):
    """Headings, paragraphs and list items of a page, each with the article and main elements around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []
        self.gone, self.rooms, self.parts, self.title, self.all = 0, 0, [], [], []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        self.gone += tag in lx.CRAWL_REMOVED_TAGS
        room = None
        if tag in ("article", "main") and not self.gone:
            room, self.rooms = self.rooms, self.rooms + 1
        self.stack.append((tag, room))
        if tag in lx.CRAWL_TEXT_TAGS and not self.gone:
            self.parts.append({"rooms": {r for _, r in self.stack if r is not None}, "depth": len(self.stack), "text": [], "open": True})

    def handle_endtag(self, tag):
        if tag not in (t for t, _ in self.stack):
            return
        while self.stack:
            name, _ = self.stack.pop()
            self.gone -= name in lx.CRAWL_REMOVED_TAGS
            for part in self.parts:
                part["open"] &= part["depth"] <= len(self.stack)
            if name == tag:
                break

    def handle_data(self, data):
        text = data.strip()
        if not text:
            return
        if any(t == "title" for t, _ in self.stack):
            self.title.append(text)
        if self.gone:
            return
        self.all.append(text)
        for part in self.parts:
            if part["open"]:
                part["text"].append(text)


def crawl_text(source: str | None) -> tuple[str, str]:
    """(title, text) of a crawled page: what its articles or main parts, else the whole of it, say in headings, paragraphs
    and list items of CRAWL_LEAST characters or more; all its text where there are none."""
    reader = _Plain()
    reader.feed(source or "")
    reader.close()
    rooms = range(reader.rooms) if reader.rooms else [None]
    squeezed = lambda parts: " ".join(" ".join(parts).split())
    texts = [squeezed(p["text"]) for r in rooms for p in reader.parts if r is None or r in p["rooms"]]
    kept = [t for t in texts if len(t) >= CRAWL_LEAST]
    return squeezed(reader.title), " ".join(kept) if kept else squeezed(reader.all)


def crawled_pages(found: DataFrame, fetched: DataFrame, blocked: tuple[str, ...] = tuple(lx.BLOCKED_DOMAINS)) -> DataFrame:
    """``url, final_url, title, body`` of the addresses that discovery gave (``url, title, summary``), each once: the text
    of the page that was fetched (``url, final_url, status, content_type, body``), where it answered below status 400 with
    text and neither address is barred; else the summary. Addresses without either are left out."""
    names = "title string, body string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([crawl_text(h) for h in batch["html"]], columns=["page_title", "page_body"])
            yield pd.concat([batch[["url", "final_url"]].reset_index(drop=True), out], axis=1)

    asked = found.where(urls.candidate_allowed(F.col("url"), blocked)).groupBy("url").agg(F.min(F.struct("title", "summary")).alias("a"))
    final = F.coalesce("final_url", "url")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    answered = fetched.where((F.col("status") < 400) & urls.candidate_allowed(final, blocked)).dropDuplicates(["url"])
    barred = fetched.where((F.col("status") < 400) & ~urls.candidate_allowed(final, blocked)).select("url").distinct()
    texts = answered.where((kind == "") | kind.contains("text") | kind.contains("html")).select("url", final.alias("final_url"), F.col("body").alias("html"))
    parsed = texts.mapInPandas(run, f"url string, final_url string, page_{names.replace(', ', ', page_')}")
    rows = asked.join(barred, "url", "left_anti").join(parsed, "url", "left")
    filled = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.trim(F.coalesce(F.col(b), F.lit(""))))
    out = rows.select("url", F.coalesce("final_url", "url").alias("final_url"), filled("page_title", "a.title").alias("title"), filled("page_body", "a.summary").alias("body"))
    return out.where("body <> ''")


def better(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Of two extractions of a page the one with more text, the static one if equal, with ``render_method``. The
    rendered one counts where the static one is scripted or short (under 1200 characters)."""
    need = static.where("scripted or char_count < 1200").select("page_id")
    both = static.withColumn("render_method", F.lit("static")).unionByName(
        rendered.join(need, "page_id", "left_semi").withColumn("render_method", F.lit("rendered"))
    )
    names = [c for c in both.columns if c != "page_id"]
    order = F.struct("char_count", (F.col("render_method") == "static").alias("s"))
    return both.groupBy("page_id").agg(F.max_by(F.struct(*names), order).alias("x")).select("page_id", "x.*")
