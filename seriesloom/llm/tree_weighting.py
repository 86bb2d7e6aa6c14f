"""op9: language-model scores by context-tree weighting.

A text is its lower-cased words, each followed by a space, and one end
symbol. Every byte is eight binary decisions. A decision's context is the
DEPTH bytes before it, across words and spaces (end symbols stand before the
first byte of a text); at the contexts of all lengths 0 .. DEPTH stand
Krichevsky-Trofimov estimates, and the tree's weights mix the estimates of all
lengths. The weight of a node follows from the training counts alone (the
estimate's block probability against that of its children), so the model is a
table of byte contexts that Spark gathers from all training rows. Where a
context was never seen, the mixture goes on from the longest one that was.

The score is the tree's: a distribution over texts. `bits_per_byte` is its
code length over the text's bytes with one space a word and the end.

Contexts are counted in each task before they are shuffled. Whole trees below
one context of ROOT bytes are weighed in one task; what they pass on to the
levels above is at most one row per node of two bytes, 2**24 in all.

Tables that grow with the corpus (words, contexts) are never collected.
Lookups take two ways: the entries that are looked up most often, HEAVY many
at most, are broadcast; the others are joined.
Words are joined by a 64-bit hash; contexts by their bytes.

Defined results: a null or empty text has one token, the end. A null doc_id
counts as an empty id in the fold rule. Without training rows every known
count is 0, and the score is 8 binary decisions of 1/2 a byte. Repeated rows
keep their rows. A text of any length is coded by one task, in several bytes
of memory a byte. An empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import fold
from .shared import discard, documents, gathered, lean, store
from .words import Words, hash_spans, mix, words_of

DEPTH, ROOT, HEAVY, FLUSH, SPARE = 5, 3, 1 << 20, 400_000, 1 << 18
HELD = 1 << 20
END = 10
LOG10 = np.log(10.0)


# --- words of the corpus ---


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, trained, every): how often each word stands in training rows and in all rows of this task."""

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(hashes), pa.array(trained), pa.array(every)], ["word", "h", "trained", "every"])

    known, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words, hashes, trained, every = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for w in words_of(batch.column(0)):
            if not len(w.starts):
                continue
            unique, first, inverse = np.unique(hash_spans(w.data, w.starts, w.ends), return_index=True, return_inverse=True)
            row = np.repeat(train[w.first : w.first + w.rows], np.diff(w.first_word))
            of_train, of_all = np.bincount(inverse, row, len(unique)).astype(np.int64), np.bincount(inverse, minlength=len(unique))
            at = np.searchsorted(known, unique)
            old = at < len(known)
            old[old] = known[at[old]] == unique[old]
            trained[place[at[old]]] += of_train[old]
            every[place[at[old]]] += of_all[old]
            new, raw = first[~old], w.data.tobytes()
            words += [raw[a:b] for a, b in zip(w.starts[new].tolist(), w.ends[new].tolist(), strict=True)]
            hashes, trained, every = np.append(hashes, unique[~old].astype(np.int64)), np.append(trained, of_train[~old]), np.append(every, of_all[~old])
            known, place = np.append(known, unique[~old]), np.append(place, np.arange(len(place), len(words)))
            order = np.argsort(known, kind="stable")
            known, place = known[order], place[order]
            if len(words) > FLUSH:
                yield flush()
                known, place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
                words, hashes, trained, every = [], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    yield flush()


# --- contexts: a code is context << 8 | symbol; a context's latest byte is its highest ---


def stream_codes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every byte of every row: of its words, of the space after each, and of the end; and how many each row has."""
    words = np.diff(w.first_word)
    sizes = w.ends - w.starts
    whole = np.cumsum(sizes) - sizes
    at = whole + np.arange(len(sizes)) + (DEPTH + 1) * np.repeat(np.arange(w.rows), words) + DEPTH  # DEPTH ends before each row and one behind it
    text = np.full(int(sizes.sum()) + len(sizes) + (DEPTH + 1) * w.rows, END, np.uint8)
    inner = np.arange(int(sizes.sum()))
    text[inner + np.repeat(at - whole, sizes)] = w.data[inner + np.repeat(w.starts - whole, sizes)]
    text[at + sizes] = 32
    total = np.concatenate([[0], np.cumsum(sizes + 1)])
    lengths = total[w.first_word[1:]] - total[w.first_word[:-1]] + 1
    begins = np.cumsum(lengths + DEPTH) - lengths - DEPTH
    wide = text.astype(np.int64)
    codes = wide.copy()
    for back in range(1, DEPTH + 1):
        codes[back:] |= wide[:-back] << 8 * (DEPTH - back + 1)
    valid = np.ones(len(text), bool)
    valid[(begins[:, None] + np.arange(DEPTH)).ravel()] = False
    return codes[valid], lengths


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct codes of several counts, with their sums."""
    code, *counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], *(np.add.reduceat(c[order], first) if len(first) else c[:0] for c in counts)


def _count_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(code, n, uses): how often each code stands in training rows and in all rows of this task."""
    out = lambda found: pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["code", "n", "uses"])
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        train = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for w in words_of(batch.column(0)):
            codes, lengths = stream_codes(w)
            marked = codes << 1 | np.repeat(train[w.first : w.first + w.rows], lengths)
            marked.sort()
            code = marked >> 1
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            held.append((code[first], np.add.reduceat(marked & 1, first), np.diff(np.append(first, len(code)))))
            if sum(len(x[0]) for x in held) > 2 * HELD:
                held = [_merged(held)]
                if len(held[0][0]) > HELD:
                    yield out(held[0])
                    held = []
    if held:
        yield out(_merged(held))


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Block probability of a Krichevsky-Trofimov estimator."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log-gamma by Stirling's series after a shift above 8."""
    shift = np.zeros_like(x)
    x = x.astype(float).copy()
    for _ in range(8):
        low = x < 8
        shift[low] -= np.log(x[low])
        x[low] += 1
    return shift + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


class Level:
    """Binary nodes of all contexts of one length: key = context << 8 | bits so far, with a leading one."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, children: np.ndarray | None = None):
        """Sorted keys, counts, and the summed log-weights of each node's children (none at the greatest length)."""
        kt = log_kt(zeros, ones)
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.stop, self.log_w = np.ones(len(kt)), kt
        if children is not None:
            self.log_w = np.logaddexp(kt, children) - np.log(2.0)
            self.stop = np.exp(np.minimum(0.0, kt - np.log(2.0) - self.log_w))

    @classmethod
    def deepest(cls, codes: np.ndarray, counts: np.ndarray) -> Level:
        """Of sorted codes and their counts."""
        keys, zeros, ones = [], [], []
        context, symbol = codes >> 8 << 8, codes & 255
        for t in range(8):
            key, bit = context | 1 << t | symbol >> 8 - t, symbol >> 7 - t & 1
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            if len(first):
                keys.append(key[first]), zeros.append(np.add.reduceat(counts * (1 - bit), first)), ones.append(np.add.reduceat(counts * bit, first))
        if not keys:
            return cls(*(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)))
        every = np.concatenate(keys)
        order = np.argsort(every)
        return cls(every[order], np.concatenate(zeros)[order].astype(float), np.concatenate(ones)[order].astype(float))

    def above(self) -> Level:
        """The level whose contexts lack this one's earliest byte."""
        parents, where = np.unique(self.keys >> 16 << 8 | self.keys & 255, return_inverse=True)
        return Level(parents, *(np.bincount(where, x, len(parents)) for x in (self.zeros, self.ones, self.log_w)))

    def chance(self, contexts: np.ndarray, prefix: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """Mix this level's estimates with `deeper` (nan: no longer context was seen)."""
        if not len(self.keys):
            return deeper
        keys = contexts << 8 | prefix
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        seen = self.keys[at] == keys
        own = (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1.0)
        mixed = np.where(np.isnan(deeper), own, self.stop[at] * own + (1 - self.stop[at]) * deeper)
        return np.where(seen, mixed, deeper)


def _levels(codes: np.ndarray, counts: np.ndarray, lowest: int) -> dict[int, Level]:
    """Levels DEPTH .. lowest of the trees that the sorted codes make up."""
    levels = {DEPTH: Level.deepest(codes[counts > 0], counts[counts > 0])}
    for d in range(DEPTH - 1, lowest - 1, -1):
        levels[d] = levels[d + 1].above()
    return levels


def code_scores(codes: np.ndarray, levels: dict[int, Level]) -> np.ndarray:
    """log10 of the mixed probability of each code's symbol in its context."""
    context, symbol, out = codes >> 8, codes & 255, np.zeros(len(codes))
    for t in range(8):
        prefix, bit, chance = 1 << t | symbol >> 8 - t, (symbol >> 7 - t & 1).astype(bool), np.full(len(codes), np.nan)
        for d in sorted(levels, reverse=True):
            chance = levels[d].chance(context >> 8 * (DEPTH - d), prefix, bit, chance)
        out += np.log(np.where(np.isnan(chance), 0.5, chance))
    return out / LOG10


def _trees(batches: Iterator[pa.RecordBatch], spare: int = SPARE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes and counts of whole trees: rows come sorted by code, so the contexts of one root stand together."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= spare:
            codes, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            root = codes >> 8 * (DEPTH - ROOT + 1)
            cut = int(np.searchsorted(root, root[-1]))
            if cut:
                yield codes[:cut], counts[:cut]
            held, size = [(codes[cut:], counts[cut:])], 0 if cut else size - spare  # a root that is larger than that goes on whole
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for codes, counts in _trees(batches):
        level = _levels(codes, counts, ROOT)[ROOT]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (level.keys, level.zeros, level.ones, level.log_w)], ["key", "zeros", "ones", "log_w"])


def _heavy(table: DataFrame, weight: str, columns: list[str]) -> tuple[dict[str, np.ndarray], Column]:
    """The rows of the greatest weights, as many as HEAVY allows; and the condition for the others."""
    octave = F.floor(F.log2(weight) * 8)  # eight steps to a doubling: a few hundred groups
    steps = table.where(F.col(weight) > 0).groupBy(octave.alias("step")).agg(F.count("*").alias("n"), F.min(weight).alias("least")).collect()
    least, rows = 1 << 62, 0
    for one in sorted(steps, key=lambda r: -r["step"]):
        rows += one["n"]
        if rows > HEAVY:
            break
        least = one["least"]
    return gathered(table.where(F.col(weight) >= least).select(*columns)), F.col(weight) < least


class Lookup:
    """Values of whole-number keys by open addressing; missing keys have no value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, values.dtype)
        at, left, self.probes = self._place(keys), np.arange(len(keys)), 0
        while len(left):
            free = self.keys[at] == -1
            _, first = np.unique(at, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.keys[at[take]], self.values[at[take]] = keys[left[take]], values[left[take]]
            left, at = left[~take], at[~take] + 1 & (1 << self.bits) - 1
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a key is held, and its value (0 elsewhere)."""
        at = self._place(keys)
        there = self.keys[at]
        hit = there == keys
        out = np.where(hit, self.values[at], 0)
        open_ = np.flatnonzero(~hit & (there != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            at[open_] = at[open_] + 1 & (1 << self.bits) - 1
            there = self.keys[at[open_]]
            found = there == keys[open_]
            hit[open_[found]], out[open_[found]] = True, self.values[at[open_[found]]]
            open_ = open_[~found & (there != -1)]
        return hit, out


def context_scores(docs: DataFrame) -> DataFrame:
    """(code, uses, score): every byte of `docs` (text, train) in its context, how often it stands in all rows, and the log10 of its probability under the tree of the training rows."""
    spark = docs.sparkSession
    counted = docs.select("text", "train").mapInArrow(lean(_count_codes), "code long, n long, uses long")
    codes = store(counted.groupBy("code").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")), "op9-codes")
    trees = codes.withColumn("root", F.shiftright("code", 8 * (DEPTH - ROOT + 1))).repartition("root").sortWithinPartitions("code").select("code", "n")
    roots = trees.mapInArrow(lean(_roots), "key long, zeros double, ones double, log_w double")
    above = roots.groupBy(F.expr("shiftleft(shiftright(key, 16), 8) | (key & 255)").alias("key")).agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "log_w")])
    above = gathered(above)  # nodes of two bytes: 2**24 at most
    order = np.argsort(above["key"])
    levels = {ROOT - 1: Level(above["key"][order].astype(np.int64), *(above[c][order].astype(float) for c in ("zeros", "ones", "log_w")))}
    for d in range(ROOT - 2, -1, -1):
        levels[d] = levels[d + 1].above()
    shared = spark.sparkContext.broadcast(levels)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, counts in _trees(batches):
            found = code_scores(codes, _levels(codes, counts, ROOT) | shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(found)], ["code", "score"])

    scores = store(trees.mapInArrow(lean(scored), "code long, score double"), "op9-scores")
    found = store(codes.select("code", "uses").join(scores, "code"), "op9-contexts")
    discard(codes, scores)
    return found


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, c, every): the words of `docs` (text, train) by hash, their count in training rows and in all rows."""
    counted = docs.select("text", "train").mapInArrow(lean(_count_words), "word binary, h long, trained long, every long")
    words = counted.groupBy("word").agg(F.any_value("h").alias("h"), F.sum("trained").alias("c"), F.sum("every").alias("every"))
    return store(words.select("h", "c", "every"), "op9-words")


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id_col, train, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), train.alias("train"))
    words, ends = word_counts(docs), docs.where("train").count()
    sums = words.agg(F.sum("c").alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    n, v = (sums["n"] or 0) + ends, sums["v"] + (ends > 0)

    def base(c: Column) -> Column:
        return F.log10(c + 0.5) - F.log10(F.lit(n + 0.5 * (v + 1)))

    words = words.select("h", "c", "every", base(F.col("c")).alias("base"))
    heavy, other_words = _heavy(words, "every", ["h", "c"])
    contexts = context_scores(docs)
    often, other_codes = _heavy(contexts, "uses", ["code", "score"])
    tables = spark.sparkContext.broadcast((heavy["h"], heavy["c"], often["code"], often["score"]))
    del heavy, often
    floor = np.log10(n + 0.5 * (v + 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, code, value = tables.value
        known, tree = Lookup(h, c), Lookup(code, value)
        for batch in batches:
            out = {k: np.zeros(batch.num_rows, np.int64 if k in ("tokens", "bytes", "sure") else float) for k in ("tokens", "bytes", "sure", "base", "score")}
            rest = {k: ([np.zeros(0, np.int64)], np.zeros(batch.num_rows, np.int64)) for k in ("words", "codes")}
            for w in words_of(batch.column(1)):
                here = slice(w.first, w.first + w.rows)
                edge = w.first_word

                def total(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
                    sums = np.concatenate([[0], np.cumsum(values)])
                    return sums[edge[1:]] - sums[edge[:-1]]

                hashes = hash_spans(w.data, w.starts, w.ends).astype(np.int64)
                hit, count = known.find(hashes)
                out["tokens"][here], out["sure"][here] = np.diff(edge), total(count > 0, edge)
                out["base"][here] = total(np.where(hit, np.log10(count + 0.5) - floor, 0.0), edge)
                rest["words"][0].append(hashes[~hit])
                rest["words"][1][here] = total(~hit, edge)
                codes, lengths = stream_codes(w)
                ends_at = np.concatenate([[0], np.cumsum(lengths)])
                hit, logs = tree.find(codes)
                out["bytes"][here], out["score"][here] = lengths, total(logs, ends_at)
                rest["codes"][0].append(codes[~hit])
                rest["codes"][1][here] = total(~hit, ends_at)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(parts))) for parts, sizes in rest.values()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x) for x in out.values()), *lists], ["id", "train", *out, *rest])

    kind = docs.schema["id"].dataType.simpleString()
    partly = docs.mapInArrow(lean(rows), f"id {kind}, train boolean, tokens long, bytes long, sure long, base double, score double, words array<long>, codes array<long>")
    partly = store(partly.withColumn("rid", F.monotonically_increasing_id()), "op9-docs")
    rare_words = words.where(other_words).select("h", F.col("c").alias("_c"), F.col("base").alias("_base"))
    of_words = partly.select("rid", F.explode("words").alias("h")).join(rare_words, "h").groupBy("rid").agg(F.sum("_base").alias("_base"), F.count(F.when(F.col("_c") > 0, 1)).alias("_sure"))
    rare_codes = contexts.where(other_codes).select("code", F.col("score").alias("_score"))
    of_codes = partly.select("rid", F.explode("codes").alias("code")).join(rare_codes, "code").groupBy("rid").agg(F.sum("_score").alias("_score"))

    def total(name: str) -> Column:
        return F.col(name) + F.coalesce("_" + name, F.lit(0))

    return (
        partly.drop("words", "codes").join(of_words, "rid", "left").join(of_codes, "rid", "left")
        .select(
            F.col("id").alias(id_col), "train", (F.col("tokens") + 1).alias("n_tokens"), (total("sure") + int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
            (total("base") + base(F.lit(float(ends)))).alias("base_score"), total("score").alias("score"), (total("score") / F.col("bytes") * -float(np.log2(10.0))).alias("bits_per_byte"),
        )
    )


def op9_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), fold(F.col("doc_id"), 5) != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
