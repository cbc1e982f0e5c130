"""Pieces of the queries' SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Iterable

from .. import lexicons as lx
from ..functions import text as tx


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def pattern(java: str) -> str:
    """A pattern as an SQL literal; RE2 folds accented letters without a flag."""
    return quoted(java.replace("(?iu)", "(?i)"))


def values(terms: Iterable[str]) -> str:
    return "[" + ", ".join(quoted(t) for t in dict.fromkeys(terms)) + "]"


def fold(x: str) -> str:
    return f"trim(regexp_replace(translate(lower({x}), {quoted(tx.ACCENTED)}, {quoted(tx.BARE)}), {quoted(tx.SPACE)}, ' ', 'g'))"


def plain(x: str) -> str:
    return f"lower(translate({x}, {quoted(tx.ACCENTED)}, {quoted(tx.BARE)}))"


def expanded(x: str) -> str:
    """Abbreviations expanded; each twice, as neighbours share the character between them."""
    for short, long in lx.ABBREVIATIONS.items():
        for _ in range(2):
            x = f"regexp_replace({x}, {quoted('(?i)(^|[^\\p{L}\\p{N}_])' + short + '($|[^\\p{L}\\p{N}_])')}, {quoted('\\1' + long + '\\2')}, 'g')"
    return x


def rag(source: str, column: str, turns: int) -> str:
    """CTEs that end in ``rag_rows``: the rows of ``source`` with ``rag``, the retrieval text of ``column``."""
    steps = [f"regexp_replace(lower(trim({column})), '^(isso|este|esta|esse|essa|aquilo|aquele|aquela)\\s+', '')"]
    for unit, zeros, behind in (("bilhões?", 9, ""), ("milhões?", 6, ""), ("mil", 3, "($|[^\\p{L}\\p{N}_])")):
        number = f"(\\d+(?:[.,]\\d+)?)\\s*{unit}{behind}"
        value = f"((replace(regexp_extract(rag, '{number}', 1), ',', '.')::DECIMAL(20,9) * {10**zeros}::DECIMAL(18,0))::DECIMAL(38,0))::VARCHAR"
        again = " || '\\2'" if behind else ""
        for _ in range(turns):
            steps.append(f"CASE WHEN regexp_matches(rag, '{number}') THEN regexp_replace(rag, '{number}', {value}{again}) ELSE rag END")
    steps += ["regexp_replace(rag, 'r\\$\\s*', '', 'g')", "regexp_replace(rag, '(\\d+(?:[.,]\\d+)?)\\s*%', '\\1 por cento', 'g')"]
    adjective = quoted("(^|[^\\p{L}\\p{N}_])" + tx.alternatives(lx.EMPTY_ADJECTIVES) + "($|[^\\p{L}\\p{N}_])")
    steps += [f"regexp_replace(rag, {adjective}, '\\1\\3', 'g')"] * 2
    kept = f"list_filter(string_split_regex(rag, {quoted(tx.SPACE)}), lambda t: length(t) > 1 AND NOT list_contains({values(lx.LIGHT_STOPWORDS)}, t))"
    steps.append(f"array_to_string({kept}, ' ')")
    names = [f"rag_{k}" for k in range(len(steps) - 1)] + ["rag_rows"]
    first = f"{names[0]} AS (SELECT *, {steps[0]} AS rag FROM {source})"
    rest = [f"{name} AS (SELECT * EXCLUDE (rag), {step} AS rag FROM {before})" for name, before, step in zip(names[1:], names, steps[1:])]
    return ", ".join([first, *rest])


def stance_fold(x: str) -> str:
    inner = f"translate(lower(replace(replace(regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g'), '&quot;', ' '), '&amp;', ' ')), {quoted(tx.ACCENTED)}, {quoted(tx.BARE)})"
    return f"trim(regexp_replace(regexp_replace({inner}, '[^a-z0-9%$., ]+', ' ', 'g'), {quoted(tx.SPACE)}, ' ', 'g'))"


def words(x: str, word: str) -> str:
    return f"regexp_extract_all({x}, {pattern(word)})"


def without(tokens: str, stop: Iterable[str]) -> str:
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i AND NOT list_contains({values(stop)}, t))"


def set_without(tokens: str, stop: Iterable[str]) -> str:
    return f"list_filter(list_distinct({tokens}), lambda t: NOT list_contains({values(stop)}, t))"


def sentences(x: str) -> str:
    marked = f"regexp_replace({x}, {quoted('([.!?])' + tx.SPACE)}, '\\1' || chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"


def exploded(source: str, columns: str, items: str, position: str, item: str) -> str:
    """SELECT of ``columns`` with one row for each item of a list expression."""
    return f"SELECT {columns}, unnest(range(len(l)))::INT AS {position}, unnest(l) AS {item} FROM (SELECT *, {items} AS l FROM {source})"


def rounded(x: str, digits: int = 4) -> str:
    return f"(floor(({x}) * {10**digits}.0::DOUBLE + 0.5) / {10**digits}.0::DOUBLE)"


def clamp(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


#: Lines of at least 40 characters, and their sentences of at least 20.
BLOCKS = f"""raw_blocks AS ({exploded('documents', 'doc_id, source, lang', "string_split(text, chr(10))", 'block_index', 'raw')}),
blocks AS (SELECT doc_id, source, lang, block_index, trim(raw) AS text FROM raw_blocks WHERE length(trim(raw)) >= 40)"""
SENTENCES = f"""{BLOCKS},
raw_sentences AS ({exploded('blocks', 'doc_id, source, lang, block_index', sentences('text'), 'sent_index', 'sentence')}),
sentences AS (SELECT doc_id, source, lang, block_index, sent_index, sentence AS text,
  len(regexp_extract_all(sentence, '[\\p{{L}}\\p{{N}}_]+'))::INT AS token_count FROM raw_sentences WHERE length(sentence) >= 20)"""
SEGMENTS = f"""{SENTENCES},
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block_index ORDER BY sent_index) - 1 AS pos FROM sentences),
dealt AS (SELECT *, pos // 3 AS w FROM placed UNION ALL SELECT *, pos // 3 - 1 FROM placed WHERE pos % 3 = 0 AND pos > 0),
windows AS (SELECT doc_id, block_index, w, string_agg(text, ' ' ORDER BY pos) AS text, sum(token_count)::INT AS token_count,
  count(*)::INT AS sentence_count, list(sent_index ORDER BY pos) AS sent_indexes FROM dealt GROUP BY ALL HAVING sum(token_count) >= 15),
segments AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY block_index, w) - 1)::INT AS seg_index FROM windows)"""
