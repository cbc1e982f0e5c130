"""Cleaning of extracted text blocks."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Noise of user interfaces that is cut out of blocks.
NOISE = (
    r"(?iu)(aceitar?\s+(todos\s+os\s+)?cookie|política\s+de\s+privacidade|termos\s+de\s+uso|assine\s+(agora|já|o\s+[\p{L}\p{N}_]+)"
    r"|leia\s+(mais|também)|continue\s+lendo|veja\s+(também|mais)|publicidade|anúncio|patrocinado"
    r"|compartilhe\s+(esta?\s+)?(notícia|matéria|artigo)|coment[aá](r|rios?)|carregando\.\.\.|voltar\s+ao\s+topo"
    r"|ouça\s+(esta?\s+)?notícia|tempo\s+de\s+leitura|participe\s+do\s+canal|no\s+whatsapp|not[ií]cias\s+da\s+regi[aã]o"
    r"|v[ií]deos?:\s*assista|assista\s+[àa]s?\s+reportagens|minutos?\s+de\s+leitura)"
)
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
PHONE = r"(\+?55\s?)?(\(?[0-9]{2}\)?\s?)([0-9]{4,5}[-\s]?[0-9]{4})"
LONE = r"(^|[^\p{L}\p{N}_])"
REPEATED = "!?.-_*=~"


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    """HTML entities as characters; there is no built-in for the whole table of names."""
    return texts.map(html.unescape, na_action="ignore")


def drop_emoji(col: Column) -> Column:
    """Symbols as spaces, but for a few signs of ordinary text."""
    return F.regexp_replace(col, r"[\p{So}\p{Sk}&&[^©®°…]]", " ")


def squeeze_repeats(col: Column) -> Column:
    """Three or more of one mark in a row become one."""
    for c in REPEATED:
        col = F.regexp_replace(col, rf"\{c}{{3,}}", "\\" + c)
    return col


def drop_short_lines(col: Column, least: int = 15) -> Column:
    """Lines trimmed; those of 1 to ``least`` - 1 characters dropped, empty ones kept."""
    lines = F.transform(F.split(col, "\n"), lambda x: F.trim(x))  # F.trim itself would get the line's number as the characters to trim
    return F.trim(F.array_join(F.filter(lines, lambda x: (x == "") | (F.length(x) >= least)), "\n"))


def clean(col: Column, *, rendered: bool = False, decode: bool = True) -> Column:
    """The cleaning steps in their fixed order. ``rendered`` pages also lose long brace blobs and get spaces between
    words glued in camel case. ``decode`` off skips the decoding of entities, the only step in Python."""
    out = unescape(col) if decode else col
    out = F.regexp_replace(out, CONTROL, "")
    if rendered:
        out = F.regexp_replace(out, r"\{[^{}]{80,}\}", " ")
        out = F.regexp_replace(out, "([a-záàãâéêíóôõúç])([A-ZÁÀÃÂÉÊÍÓÔÕÚÇ])", "$1 $2")
    out = F.regexp_replace(out, "&[a-zA-Z]{2,6};|&#[0-9]{1,5};|&#x[0-9a-fA-F]{1,4};", " ")
    out = F.regexp_replace(out, r"(?i)https?://\S+|www\.\S+", " ")
    out = F.regexp_replace(out, r"\S+@\S+\.\S+", " ")
    out = F.regexp_replace(out, r"[@#][\p{L}\p{N}_]+", " ")
    out = F.regexp_replace(out, PHONE, " ")
    out = F.regexp_replace(out, r"(?U)\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b|\b\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}\b|\b\d{5}-?\d{3}\b", " ")
    out = F.regexp_replace(out, r"(?U)\b\d{7,}\b", " ")
    out = drop_emoji(out)
    out = F.regexp_replace(out, NOISE, " ")
    out = squeeze_repeats(out)
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return drop_short_lines(out)


def clean_blocks(blocks: Column, *, rendered: bool = False) -> Column:
    """An array of blocks (entities already decoded) cleaned; those that end up empty are dropped."""
    return F.filter(F.transform(blocks, lambda b: clean(b, rendered=rendered, decode=False)), lambda b: b != "")
