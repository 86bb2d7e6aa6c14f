"""op12: quality rules, line first.

Every line with a word is judged by itself and fails by
- punctuation: eight words or more without a closing mark at the end; over one
  symbol of `#*$%&|<>` to ten words; over one doubled `!` or `?` to five words;
- navigation: two separators of `| » › · •` or more, and one to four words or more;
- boilerplate: at most thirty words and a known phrase of page furniture.
Failing lines are taken out; a text whose lines keep less than half of the
characters in words is rejected. Rejected at once is what fails the base: too few
words, or too many words in five-word windows that the text repeats.

Lines, words and windows are worked out over byte arrays, a few MB of whole
rows at a time; a longer text is cut at line breaks, so memory follows its longest line
and one hash a word. Windows and lines are compared by 64-bit hashes. No shuffle.

Defined results: a null text, an empty one and one without words have no words
and fail the base; lines without words count for nothing. Ties do not arise: rows are judged one by
one, repeated rows and null ids keep their rows. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import runs_of, segments, table_of
from .shared import documents, lean, narrow
from .words import LOWER, SALTS, SPACE, hash_spans, mix

SYMBOLS, SEPARATORS, CLOSING = "#*$%&|<>", "|»›·•", ".!?\"')]…”’»:;"
# Phrases of page furniture.
PHRASES = [
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "forgot password", "log in", "lorem ipsum",
    "privacy policy", "read more", "share this", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use", "this site uses cookies",
]
LEAST_WORDS, REPEATED, WINDOW = 10, (20, 100), 5
LONG_LINE, SYMBOL_SHARE, DOUBLED_SHARE, SEPARATOR_SHARE, FEWEST_SEPARATORS, LONGEST_NOTICE, KEPT_SHARE = 8, (1, 10), (1, 5), (1, 4), 2, 30, (1, 2)

IS_SYMBOL, IS_MARK, IS_BREAK = table_of(SYMBOLS.encode()), table_of(b"!?"), table_of(b"\n")


def sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many flags are set between consecutive edges."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[edges])


def marks(data: np.ndarray, characters: str, last: bool = False) -> np.ndarray:
    """Bytes at which one of the characters begins, or with `last` ends."""
    found = np.zeros(len(data), bool)
    for code in (c.encode() for c in characters):
        n = len(code)
        if len(data) >= n:
            hit = np.ones(len(data) - n + 1, bool)
            for i, b in enumerate(code):
                hit &= data[i : len(data) - n + 1 + i] == b
            found[n - 1 if last else 0 : len(data) if last else len(data) - n + 1] |= hit
    return found


def lines_of(data: np.ndarray, row: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and the verdict of every line, and the hash of every word, of whole lines of rows that begin and end at `row`."""
    breaks = np.flatnonzero(data == 10)
    starts = np.unique(np.concatenate([row[:-1], breaks + 1]))
    starts = starts[starts < len(data)]
    edges = np.append(starts, len(data))
    space, mark = SPACE[data], IS_MARK[data]
    word_start, word_end = runs_of(~space, row)
    doubled = np.zeros(len(data), bool)
    doubled[1:] = mark[1:] & mark[:-1]
    doubled[starts] = False
    at = np.searchsorted(word_start, edges)
    words = np.diff(at)
    ends_well = np.zeros(len(starts), bool)
    full = words > 0
    ends_well[full] = marks(data, CLOSING, last=True)[word_end[at[1:][full] - 1] - 1]
    symbols, separators, low = sums(IS_SYMBOL[data], edges), sums(marks(data, SEPARATORS), edges), LOWER[data].tobytes()
    furniture = np.zeros(len(starts), bool)
    for phrase in PHRASES:
        code, i = phrase.encode(), -1
        while (i := low.find(code, i + 1)) >= 0:
            furniture[np.searchsorted(starts, i, "right") - 1] = True
    failed = ((words >= LONG_LINE) & ~ends_well) | (symbols * SYMBOL_SHARE[1] > words * SYMBOL_SHARE[0]) | (sums(doubled, edges) * DOUBLED_SHARE[1] > words * DOUBLED_SHARE[0])
    failed |= (separators >= FEWEST_SEPARATORS) & (separators * SEPARATOR_SHARE[1] >= words * SEPARATOR_SHARE[0])
    failed |= furniture & (words <= LONGEST_NOTICE)
    bare = edges[1:] - (data[edges[1:] - 1] == 10) if len(starts) else starts
    return {
        "row": np.searchsorted(row, starts, "right") - 1, "words": words, "chars": sums(((data & 0xC0) != 0x80) & ~space, edges), "symbols": symbols,
        "failed": failed & full, "hash": hash_spans(data, starts, bare), "word_hash": hash_spans(data, word_start, word_end),
    }


def repeated_words(hashes: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """For each row, whose words are hashes[first[i]:first[i+1]], the words that lie in a `width`-word window which the row has twice or more."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(len(first) - 1, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = owner[: n] == owner[width - 1 :]
    key = mix(owner[:n].astype(np.uint64) + np.uint64(1))
    for i in range(width):
        key += hashes[i : n + i] * SALTS[i]
    at = np.flatnonzero(whole)
    key = mix(key[at])
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    begins = np.zeros(len(hashes) + 1, np.int64)
    hit = at[order[twice]]
    begins[hit] += 1
    np.add.at(begins, hit + width, -1)
    return sums(np.cumsum(begins)[:-1] > 0, first)


def measured(column: pa.Array) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(first row, past the last row, counts of each of these rows); all segments of a long row are put together."""

    def finish(lo: int, hi: int, parts: list[dict[str, np.ndarray]]) -> tuple[int, int, dict[str, np.ndarray]]:
        line = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        n, row, full = hi - lo, line["row"], line["words"] > 0
        count = lambda values: np.bincount(row, values, n).astype(np.int64)
        same = mix(line["hash"][full] + mix(row[full].astype(np.uint64) + np.uint64(1)))
        again = np.ones(len(same), bool)
        again[np.unique(same, return_index=True)[1]] = False
        words = count(line["words"])
        first = np.concatenate([[0], np.cumsum(words)])
        return lo, hi, {
            "n_words": words, "word_chars": count(line["chars"]), "n_symbols": count(line["symbols"]), "n_dup_lines": np.bincount(row[full], again, n).astype(np.int64),
            "n_repeat_words": repeated_words(line["word_hash"], first, WINDOW), "n_lines": count(full), "n_removed_lines": count(line["failed"]), "chars_left": count(line["chars"] * ~line["failed"]),
        }

    held: list[dict[str, np.ndarray]] = []
    span = (0, 0)
    for lo, hi, data, row in segments(column, IS_BREAK):
        if held and span != (lo, hi):
            yield finish(*span, held)
            held = []
        span = (lo, hi)
        held.append(lines_of(data, row))
    if held:
        yield finish(*span, held)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_removed_lines", "chars_left"]


def line_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id_col, the counts of its text, base_failed, and kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {name: np.zeros(batch.num_rows, np.int64) for name in COUNTS}
            for lo, hi, counts in measured(batch.column(1)):
                for name in COUNTS:
                    found[name][lo:hi] = counts[name]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(found[name]) for name in COUNTS]], ["id", *COUNTS])

    plain = narrow(df, id=id_col, text=text_col)
    schema = f"id {plain.schema['id'].dataType.simpleString()}, " + ", ".join(f"{name} long" for name in COUNTS)
    base = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * REPEATED[1] > F.col("n_words") * REPEATED[0])
    kept = ~base & (F.col("chars_left") * KEPT_SHARE[1] >= F.col("word_chars") * KEPT_SHARE[0])
    return plain.mapInArrow(lean(rows), schema).select(F.col("id").alias(id_col), *COUNTS, base.alias("base_failed"), kept.alias("kept"))


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that are kept, with failing lines taken out of their texts; all other columns as they are."""

    place = df.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: list[list[str]] = [[] for _ in range(batch.num_rows)]
            kept = np.zeros(batch.num_rows, bool)
            for lo, hi, counts in measured(batch.column(place)):
                base = (counts["n_words"] < LEAST_WORDS) | (counts["n_repeat_words"] * REPEATED[1] > counts["n_words"] * REPEATED[0])
                kept[lo:hi] = ~base & (counts["chars_left"] * KEPT_SHARE[1] >= counts["word_chars"] * KEPT_SHARE[0])
            for lo, _, data, row in segments(batch.column(place), IS_BREAK):
                found = lines_of(data, row)
                starts = np.unique(np.concatenate([row[:-1], np.flatnonzero(data == 10) + 1]))
                starts = starts[starts < len(data)]
                for r, bad, a, b in zip(found["row"], found["failed"], starts, np.append(starts[1:], len(data))):
                    if kept[lo + r] and not bad:
                        texts[lo + r].append(data[a:b].tobytes().decode())
            columns = list(batch.columns)
            columns[place] = pa.array(["".join(t) for t in texts], batch.column(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(kept))

    return df.mapInArrow(lean(rows), df.schema)


def op12_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(documents(spark, sf_dir))


def _sql() -> str:
    def of(characters: str) -> str:
        return "".join("\\" + c if c in "\\^]-[" else c for c in characters).replace("'", "''")

    only = lambda characters: f"length(regexp_replace(line, '[^{of(characters)}]', '', 'g'))"
    phrases = " or ".join(f"contains(low, '{p}')" for p in PHRASES)
    return f"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from docs),
counted as (
  select *, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) as words, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) as chars,
    {only(SYMBOLS)} as symbols, {only(SEPARATORS)} as separators, {only("!?")} - len(regexp_extract_all(line, '[!?]+')) as doubled,
    regexp_matches(line, '[{of(CLOSING)}][\\x20\\x09-\\x0D]*$') as closed, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from split
), judged as (
  select *, (words >= {LONG_LINE} and not closed) or symbols * {SYMBOL_SHARE[1]} > words * {SYMBOL_SHARE[0]} or doubled * {DOUBLED_SHARE[1]} > words * {DOUBLED_SHARE[0]}
    or (separators >= {FEWEST_SEPARATORS} and separators * {SEPARATOR_SHARE[1]} >= words * {SEPARATOR_SHARE[0]}) or (words <= {LONGEST_NOTICE} and ({phrases})) as failed,
    row_number() over (partition by r, line order by i) > 1 as again from counted where words > 0
), lines as (
  select r, sum(words)::bigint as n_words, sum(chars)::bigint as word_chars, count(*) filter (where again) as n_dup_lines, count(*) as n_lines,
    count(*) filter (where failed) as n_removed_lines, coalesce(sum(chars) filter (where not failed), 0)::bigint as chars_left from judged group by r
), words as (select r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as w from docs),
windows as (select r, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) as s from words where len(w) >= {WINDOW}),
twice as (select r, i from windows qualify count(*) over (partition by r, s) > 1),
repeats as (select r, count(distinct i + j) as n_repeat_words from twice, (select unnest(range(0, {WINDOW})) as j) group by r),
texts as (
  select d.doc_id, coalesce(l.n_words, 0) as n_words, coalesce(l.word_chars, 0) as word_chars, length(regexp_replace(d.text, '[^{of(SYMBOLS)}]', '', 'g')) as n_symbols, coalesce(l.n_dup_lines, 0) as n_dup_lines,
    coalesce(p.n_repeat_words, 0) as n_repeat_words, coalesce(l.n_lines, 0) as n_lines, coalesce(l.n_removed_lines, 0) as n_removed_lines, coalesce(l.chars_left, 0) as chars_left
  from docs d left join lines l using (r) left join repeats p using (r)
), based as (select *, n_words < {LEAST_WORDS} or n_repeat_words * {REPEATED[1]} > n_words * {REPEATED[0]} as base_failed from texts)
select *, not base_failed and chars_left * {KEPT_SHARE[1]} >= word_chars * {KEPT_SHARE[0]} as kept from based
"""


SQL = _sql()
