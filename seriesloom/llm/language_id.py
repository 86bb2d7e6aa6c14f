"""op7: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public byte
vocabulary. A word (with one space before it) is scored by a forward
algorithm that sums over all ways to cut it into pieces, so no single
segmentation has to be chosen; a text's score is the sum over its words,
and the answer is the language with the highest posterior.

Piece probabilities are fitted by expectation maximisation on a bounded
sample: the `sample` training rows of each language with the smallest
hashes. Everything else reads whole texts of all rows. Words within a task
are scored once and looked up afterwards.

Defined results: `und` with score 0 for a null text or one without a letter,
and for every row if no training row has a language. Rows with a null
doc_id are scored like others (null counts as an empty id in the fold
rule). Ties go to the smallest language name. Null and repeated rows keep
their rows in the result. A text of any length is scored whole by one task. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, documents, give_back, lean, store
from .words import hash_spans, mix, powers, words_of

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LONGEST, SAMPLE, STEPS, FLOOR = 16, 2000, 3, 0.01
CACHE = 1 << 19
CHUNK = 1 << 18


def vocabulary(name: str = VOCABULARY) -> list[bytes]:
    """Pieces of at most LONGEST bytes of a public vocabulary; it has all single bytes."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as lines:
        pieces = [base64.b64decode(line.split()[0]) for line in lines]
    return [p for p in pieces if len(p) <= LONGEST]


def _hash_pieces(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    return hash_spans(data, ends - [len(p) for p in pieces], ends)


class PieceIndex:
    """Piece number by content hash (open addressing); the number of pieces stands for no piece."""

    def __init__(self, pieces: list[bytes]):
        keys, self.none = _hash_pieces(pieces), len(pieces)
        self.mask = np.uint64((1 << max(4, int(np.ceil(np.log2(len(pieces) * 4)))) - 0) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.number = np.full(int(self.mask) + 1, self.none, np.int32)
        at, left, self.probes = keys & self.mask, np.arange(len(keys)), 0
        while len(left):
            free = self.number[at[left].astype(np.int64)] == self.none
            _, first = np.unique(at[left], return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            put = left[take & free]
            self.keys[at[put].astype(np.int64)], self.number[at[put].astype(np.int64)] = keys[put], put
            left = left[~(take & free)]
            at[left] = (at[left] + np.uint64(1)) & self.mask
            self.probes += 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes & self.mask).astype(np.int64)
        out = np.where(self.keys[at] == hashes, self.number[at], self.none)
        open_ = np.flatnonzero((out == self.none) & (self.number[at] != self.none))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & int(self.mask)
            here = at[open_]
            hit = self.keys[here] == hashes[open_]
            out[open_[hit]] = self.number[here[hit]]
            open_ = open_[~hit & (self.number[here] != self.none)]
        return out


class Lattice:
    """All pieces in a set of words, each with one space before it but those in `inside`, which go on with a word. Words are ordered by falling length."""

    def __init__(self, index: PieceIndex, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, inside: np.ndarray | None = None):
        lead = np.ones(len(starts), np.int64) if inside is None else 1 - inside.astype(np.int64)
        self.index, sizes = index, ends - starts + lead
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.offset = np.cumsum(self.sizes) - self.sizes
        whole = np.full(int(self.sizes.sum()), 32, np.uint8)
        at = np.arange(len(whole)) - np.repeat(self.offset, self.sizes)
        at -= np.repeat(lead[self.order], self.sizes)
        inner = at >= 0
        whole[inner] = data[(np.repeat(starts[self.order], self.sizes) + at)[inner]]
        up, self.down = powers(len(whole) + 1)
        self.total = np.zeros(len(whole) + 1, np.uint64)
        np.cumsum((whole.astype(np.uint64) + np.uint64(1)) * up[: len(whole)], out=self.total[1:])

    def active(self, j: int) -> int:
        """How many words have at least j bytes."""
        return int(np.searchsorted(-self.sizes, -j, "right"))

    def pieces(self, j: int, length: int) -> np.ndarray:
        """For words of at least j bytes: the piece that ends at byte j and has this length."""
        end = self.offset[: self.active(j)] + j
        h = mix((self.total[end] - self.total[end - length]) * self.down[end - length] + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
        return self.index.find(h)


def forward(lattice: Lattice, chance: np.ndarray) -> np.ndarray:
    """log P(word) under each column of `chance` (pieces + 1 rows, the last of zeros), in the words' first order.

    The last LONGEST sums are kept for each word and scaled by their
    maximum, so words of any length stay within floating-point range."""
    n, width = len(lattice.sizes), chance.shape[1]
    sums = np.zeros((LONGEST, n, width))
    sums[0], scale, out = 1.0, np.zeros((n, width)), np.empty((n, width))
    for j in range(1, int(lattice.sizes[0]) + 1 if n else 0):
        m = lattice.active(j)
        now = np.zeros((m, width))
        for length in range(1, min(j, LONGEST) + 1):
            found = lattice.pieces(j, length)
            hit = np.flatnonzero(found != lattice.index.none)
            now[hit] += sums[(j - length) % LONGEST, hit] * chance[found[hit]]
        sums[j % LONGEST, :m] = now
        if j % 8 == 0:
            top = sums[:, :m].max(axis=0)
            sums[:, :m] /= top
            scale[:m] += np.log(top)
        done = np.arange(lattice.active(j + 1), m)
        out[lattice.order[done]] = np.log(sums[j % LONGEST, done]) + scale[done]
    return out


def cut(word: bytes, most: int = 48) -> list[bytes]:
    """A word in parts of at most `most` bytes, cut before a character's first byte."""
    parts = []
    while len(word) > most:
        end = next((e for e in range(most, most - 4, -1) if word[e] & 0xC0 != 0x80), most)
        parts.append(word[:end])
        word = word[end:]
    return [*parts, word]


def _in_parts(words: pd.DataFrame) -> pd.DataFrame:
    """word, n, inside: words over 48 bytes in parts, equal ones together; `inside` holds for all parts but a word's first."""
    words = words[["word", "n"]].assign(inside=False)
    long = words["word"].str.len() > 48
    if not long.any():
        return words
    parts = [(p, n, k > 0) for w, n in words.loc[long, ["word", "n"]].itertuples(index=False) for k, p in enumerate(cut(w))]
    parts = pd.DataFrame(parts, columns=["word", "n", "inside"]).groupby(["word", "inside"], as_index=False)["n"].sum()
    return pd.concat([words[~long], parts], ignore_index=True)


def fit(words: pd.DataFrame, pieces: list[bytes], steps: int = STEPS, chunk: int = 20_000, held: int = 1 << 22) -> np.ndarray:
    """Piece probabilities from words (word: bytes, n: how often), by expectation maximisation. Words over 48 bytes are fitted in parts.

    Words are taken in chunks of like length, so the tables of partial sums stay small. The pieces of the first `held`
    bytes are found once; those of the others anew in each step."""
    words = _in_parts(words)
    words = words.assign(size=words["word"].str.len()).sort_values(["size", "word", "inside"])
    index, width = PieceIndex(pieces), len(pieces) + 1

    def look(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, dict[tuple[int, int], np.ndarray]]:
        ends = np.cumsum(part["size"].to_numpy(np.int64))
        lattice = Lattice(index, np.frombuffer(b"".join(part["word"]), np.uint8), ends - part["size"].to_numpy(np.int64), ends, part["inside"].to_numpy(bool))
        longest = int(lattice.sizes[0])
        found = {(j, k): lattice.pieces(j, k).astype(np.int32) for j in range(1, longest + 1) for k in range(1, min(j, LONGEST) + 1)}
        return lattice.sizes, part["n"].to_numpy(float)[lattice.order], found

    parts = [words.iloc[lo : lo + chunk] for lo in range(0, len(words), chunk)]
    before = np.cumsum([0] + [int(part["size"].sum()) for part in parts])
    kept = [look(part) for part, b in zip(parts, before, strict=False) if b < held]
    every = lambda: (kept[i] if i < len(kept) else look(part) for i, part in enumerate(parts))
    counts = np.zeros(width)
    for _, weight, found in every():
        for x in found.values():
            counts += np.bincount(x, weight[: len(x)], width)
    for step in range(steps + 1):
        counts[-1] = 0
        chance = np.append((counts[:-1] + FLOOR) / (counts[:-1].sum() + FLOOR * len(pieces)), 0.0)
        if step < steps:
            counts = sum((_expected(*part, chance) for part in every()), np.zeros(width))
    return chance[:-1]


def _expected(sizes: np.ndarray, weight: np.ndarray, found: dict[tuple[int, int], np.ndarray], chance: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations of some words, by forward and backward sums."""
    n, every = len(sizes), np.arange(len(sizes))
    ahead, back = np.zeros((int(sizes[0]) + 1, n)), np.zeros((int(sizes[0]) + 1, n))
    ahead[0], back[sizes, every] = 1, 1
    for (j, k), x in found.items():
        ahead[j, : len(x)] += ahead[j - k, : len(x)] * chance[x]
    counts, whole = np.zeros(len(chance)), ahead[sizes, every]
    for (j, k), x in reversed(found.items()):
        m = len(x)
        then = chance[x] * back[j, :m]
        counts += np.bincount(x, weight[:m] * ahead[j - k, :m] * then / whole[:m], len(counts))
        back[j - k, :m] += then
    return counts


@dataclass
class Model:
    languages: list[str]
    pieces: list[bytes]
    chance: np.ndarray  # pieces x languages


def _sample_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages = batch.column(0).to_pylist()
        for w in words_of(batch.column(1), lower=False):
            raw = w.data.tobytes()
            for i in range(w.rows):
                a, b = int(w.first_word[i]), int(w.first_word[i + 1])
                if a < b:
                    found = pa.array([raw[s:e] for s, e in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)], pa.binary())
                    counts = found.value_counts()
                    yield pa.RecordBatch.from_arrays([pa.array([languages[w.first + i]] * len(counts), pa.string()), counts.field(0), counts.field(1)], ["lang", "word", "n"])


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, vocabulary_name: str = VOCABULARY) -> Model:
    """Fit on the `sample` labelled rows of each language with the smallest hashes; the model is as large as pieces x languages."""
    labelled = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null and id is not null")
    ids = store(labelled.select("id", "lang").distinct(), "op7-ids")
    sizes = store(ids.groupBy("lang").agg(F.count("*").alias("n")), "op7-sizes")
    # Of n hashes, the `sample` smallest lie below about sample / n: only a little more than those are ranked.
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 52))
    small = sizes.count() <= 100_000
    low = ids.join(F.broadcast(sizes) if small else sizes, "lang").where(place.cast("double") * F.col("n") < F.lit(float((1 << 52) * (sample + 8 * sample**0.5 + 64))))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(place, "id"))
    chosen = store(low.withColumn("rank", rank).where(F.col("rank") <= sample).select("id", "lang"), "op7-chosen")
    bound = F.broadcast(chosen) if small and sample * sizes.count() <= 1_000_000 else chosen
    words = labelled.join(bound, ["id", "lang"], "left_semi").select("lang", "text").mapInArrow(lean(_sample_words), "lang string, word binary, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n"))

    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [key[0]], "chance": [fit(frame, vocabulary(vocabulary_name)).tolist()]})
        give_back()
        return out

    fitted = store(words.groupBy("lang").applyInPandas(one, "lang string, chance array<double>"), "op7-model").orderBy("lang").collect()
    chance = np.array([r["chance"] for r in fitted]).T if fitted else np.zeros((0, 0))
    discard(ids, sizes, chosen)
    return Model([r["lang"] for r in fitted], vocabulary(vocabulary_name), chance)


class Scorer:
    """log P(word) for each language; words already seen are looked up."""

    def __init__(self, model: Model):
        self.index = PieceIndex(model.pieces)
        self.chance = np.vstack([model.chance, np.zeros((1, model.chance.shape[1]))])
        self.known, self.scores = np.zeros(0, np.uint64), np.zeros((0, model.chance.shape[1]))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = self.known[at] != unique if len(self.known) else np.ones(len(unique), bool)
        scores = np.empty((len(unique), self.chance.shape[1]))
        if len(self.known):
            scores[~new] = self.scores[at[~new]]
        todo = np.flatnonzero(new)
        sizes = np.cumsum((ends - starts)[first[todo]] + 1)
        for part in np.split(todo, np.searchsorted(sizes, np.arange(CHUNK, sizes[-1], CHUNK)) if len(sizes) else []):
            if len(part):
                scores[part] = forward(Lattice(self.index, data, starts[first[part]], ends[first[part]]), self.chance)
        if len(self.known) + len(todo) > CACHE:
            self.known, self.scores = unique, scores
        else:
            merged = np.concatenate([self.known, unique[new]])
            order = np.argsort(merged)
            self.known, self.scores = merged[order], np.vstack([self.scores, scores[new]])[order]
        return scores[inverse]


def score_texts(scorer: Scorer, column: pa.Array) -> np.ndarray:
    """Rows x languages: log-probability of each text."""
    out = np.zeros((len(column), scorer.chance.shape[1]))
    for w in words_of(column, lower=False):
        if len(w.starts):
            by_word = scorer.words(w.data, w.starts, w.ends, hash_spans(w.data, w.starts, w.ends))
            total = np.vstack([np.zeros((1, by_word.shape[1])), np.cumsum(by_word, axis=0)])
            out[w.first : w.first + w.rows] = total[w.first_word[1:]] - total[w.first_word[:-1]]
    return out


def predict(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (a struct of the columns `keep`, so that none can clash), lang_pred and score (the posterior of the answer)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in keep]).alias("row"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letter"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, scorer = shared.value, None
        for batch in batches:
            found, best = np.full(batch.num_rows, "und", object), np.zeros(batch.num_rows)
            letter = batch.column(2).to_numpy(zero_copy_only=False)
            if model.languages:
                scorer = scorer or Scorer(model)
                logs = score_texts(scorer, batch.column(1))
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                found = np.where(letter, np.array(model.languages, object)[odds.argmax(axis=1)], "und")
                best = np.where(letter, odds.max(axis=1) / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string()), pa.array(best)], ["row", "lang_pred", "score"])

    kind = source.select("row", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return source.mapInArrow(lean(rows, 1 << 22), kind)


def fold(id_column: Column, parts: int) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % parts


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(fold(F.col("doc_id"), 3) != 1))
    found = predict(docs, model)
    return found.select("row.doc_id", (fold(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
