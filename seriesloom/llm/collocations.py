"""op11: phrase collocations by an FM-index per shard over word ids.

Texts are lower-cased (A-Z), cut into pieces and words, and dealt into shards of one language.
A shard stores its distinct words, counted, and its word sequence. Words that are
common enough over all shards get global numbers; the others break phrases, since
no phrase is more common than its words. Small shards of a language are then put together up to the size of a full one,
since what is shipped follows the different phrases of a shard, and each gets a bidirectional FM-index:
the Burrows-Wheeler transforms of its sequence and of the reversed one, with contexts sorted as deep
as phrases are long. A phrase is a pair of intervals, one in each
transform; extending it by a word on the right is a rank query in the reversed
transform and a sum of smaller followers in the forward one.

Phrases grow by one word a round: shards extend the phrases that are common over
all of them, and their counts are summed across shards. All rounds ship sorted and compressed lists, dealt by a hash of
the phrase, instead of rows, since most of what a shard finds is rare; what is common goes back to its shards as lists, too, and
what holds for a phrase wherever it is found (its parts and its count) is a row, once. In the first round a shard finds the intervals
of the pairs that are left by one rank query in either transform. The index is stored in buckets of
shards, so that later rounds move only phrases. A phrase that is as common as one of its extensions by
a word is part of a longer phrase that is just as common; that extension is common, so it is among those found.

Defined results: a null language counts as `und`, a null text as empty. Ties go to the
higher count, then to the phrase that comes first in byte order. Repeated rows count as often as they
come; ids are not read. A long text is cut inside a row at white space or a break, and its phrases go on over
such cuts; one word is held whole. An empty table gives an empty result; extra columns are
ignored. Words of a shard are told apart by 64-bit hashes, across shards by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .segments import runs_of, segments, table_of
from .shared import discard, documents, give_back, in_buckets, lean, narrow, store
from .words import LOWER, hash_spans, mix

LONGEST, LEAST, TOP = 5, 100, 2000
SHARD = 1 << 21
VOCABULARY = 1 << 26

BREAK = table_of(b".,;:!?\x0a\x0b\x0c\x0d")
GAP = BREAK | table_of(b" \x09")


class Shard:
    """Words of one language in the making: a hash and a break flag a word, and the bytes of each distinct word."""

    def __init__(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.breaks: list[np.ndarray] = []
        self.known = np.zeros(0, np.uint64)
        self.new: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.spelled: list[bytes] = []
        self.n = self.bytes = 0

    def add(self, hashes: np.ndarray, breaks: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.hashes.append(hashes)
        self.breaks.append(breaks)
        self.n += len(hashes)
        found, where = np.unique(hashes, return_index=True)
        unknown = ~np.isin(found, self.known, assume_unique=True)
        found, where = found[unknown], where[unknown]
        size = ends[where] - starts[where]
        at = np.repeat(starts[where] - np.cumsum(size) + size, size) + np.arange(size.sum())
        self.spelled.append(data[at].tobytes())
        self.new.append(found)
        self.sizes.append(size)
        self.known = np.union1d(self.known, found)
        self.bytes += int(size.sum())

    def row(self, lang: str) -> pa.RecordBatch:
        hashes, breaks, new = np.concatenate(self.hashes), np.concatenate(self.breaks), np.concatenate(self.new)
        place = np.searchsorted(self.known, hashes)
        counts = np.bincount(place, minlength=len(self.known))
        common_first = np.argsort(-counts, kind="stable")  # small numbers for common words, which pack well
        rank = np.empty(len(counts), np.int32)
        rank[common_first] = np.arange(1, len(counts) + 1)
        codes = np.insert(rank[place], np.flatnonzero(breaks), 0)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(self.sizes))]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(self.spelled))])
        words = words.take(pa.array(np.argsort(new)[common_first])).cast(pa.binary())
        one = pa.array([0, len(new)], pa.int32())
        lists = [pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, pa.array(counts[common_first], pa.int64()))]
        return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([self.n]), *lists, pa.array([packed(codes)], pa.binary()), pa.array([len(codes)], pa.int32())], ["lang", "n", "words", "counts", "codes", "n_codes"])


def shards(df: DataFrame, text_col: str, lang_col: str, most: int = SHARD) -> DataFrame:
    """Columns shard, lang, n, words, counts, codes and their number (compressed 32-bit local word numbers from 1, 0 before a word that no word of its piece precedes)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[str, Shard] = {}
        for batch in batches:
            langs = batch.column(1).fill_null("und").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            last: tuple[int, bool] | None = None  # the row that the next segment may go on, and whether a break has come since its last word
            for lo, hi, data, row in segments(batch.column(0), GAP):
                data = LOWER[data]
                starts, ends = runs_of(~GAP[data], row)
                seen = np.concatenate([[0], np.cumsum(BREAK[data])])
                owner = np.searchsorted(row, starts, "right") - 1
                broken = np.ones(len(starts), bool)
                broken[1:] = (seen[starts[1:]] > seen[starts[:-1]]) | (owner[1:] > owner[:-1])
                goes_on = last is not None and last[0] == lo and hi == lo + 1
                if len(starts) and goes_on:
                    broken[0] = last[1] or seen[starts[0]] > 0
                after = seen[-1] > (seen[ends[-1]] if len(ends) else 0)
                last = (lo, bool(after or (goes_on and not len(ends) and last[1]) or (not len(ends) and not goes_on)))
                if not len(starts):
                    continue
                hashes, lang = hash_spans(data, starts, ends), code[lo + owner]
                for c in np.unique(lang):
                    mine = lang == c
                    open_.setdefault(names[c], Shard()).add(hashes[mine], broken[mine], data, starts[mine], ends[mine])
                while open_ and (sum(s.n for s in open_.values()) > most or sum(s.bytes for s in open_.values()) > VOCABULARY):
                    name = max(open_, key=lambda k: open_[k].n)
                    yield open_.pop(name).row(name)
        while open_:
            name, shard = open_.popitem()
            yield shard.row(name)

    plain = narrow(df, text=text_col, lang=lang_col)
    return plain.mapInArrow(lean(rows), "lang string, n long, words array<binary>, counts array<long>, codes binary, n_codes int").withColumn("shard", F.monotonically_increasing_id())


def by_depth(text: np.ndarray, base: int, depth: int) -> np.ndarray:
    """Positions of a cyclic text in the order of their next `depth` symbols, ties by position; symbols are below `base`.

    As many symbols as fit into 62 bits are one key; the keys are sorted from the last to the first, each sort stable."""
    width = max(1, min(depth, int(62 // np.log2(max(base, 2)))))
    order = None
    for start in reversed(range(0, depth, width)):
        key = np.zeros(len(text), np.int64)
        for i in range(start, min(start + width, depth)):
            key *= base
            key += np.roll(text, -i)
        order = np.argsort(key, kind="stable") if order is None else order[np.argsort(key[order], kind="stable")]
    return order


def transforms(text: np.ndarray, base: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols before the sorted contexts of the text and of the reversed text."""
    found = []
    for t in (text, text[::-1].copy()):
        found.append(t[by_depth(t, base, depth) - 1].astype(np.int32))
        give_back()
    return found[0], found[1]


class Ranks:
    """Rank queries on a transform: where the contexts begin that a symbol and then a given context make."""

    def __init__(self, transform: np.ndarray) -> None:
        at = np.argsort(transform, kind="stable")
        self.n = len(transform)
        self.keys = transform[at].astype(np.int64) * self.n + at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, symbol * self.n + at)


def extended(reverse: np.ndarray, base: int, lo: np.ndarray, lo_r: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """All extensions of phrases by one word on the right: number of the phrase, symbol, both intervals' starts, count."""
    if not len(lo):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    owner = np.repeat(np.arange(len(lo)), size)
    at = np.repeat(lo_r - np.cumsum(size) + size, size) + np.arange(size.sum())
    key, count = np.unique(owner * base + reverse[at], return_counts=True)
    owner, symbol = key // base, key % base
    before = np.cumsum(count) - count
    first = np.concatenate([[0], np.cumsum(size)])[owner]
    real = symbol > 0
    owner, symbol, count = owner[real], symbol[real], count[real]
    return owner, symbol, lo[owner] + (before - first)[real], Ranks(reverse).step(symbol, lo_r[owner]), count


def packed(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values).tobytes(), "zstd", asbytes=True)


def unpacked(code: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(code, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


INDEX = "shard long, n int, n_words int, numbers binary, forward binary, reverse binary"


def together(sharded: DataFrame, most: int) -> DataFrame:
    """Columns shard and piece: shards of a language (pieces) in a row, put together until they have `most` words. A row per piece."""
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("shard")) - F.col("n")
    steps = sharded.select("lang", F.col("shard").alias("piece"), F.floor(before / most).alias("step"))
    return steps.select(F.min("piece").over(Window.partitionBy("lang", "step")).alias("shard"), "piece")


def index(sharded: DataFrame, numbered: DataFrame, depth: int) -> DataFrame:
    """One row per shard with two common words in a row: its words' global numbers and both transforms.

    `sharded` has shard, piece, codes, n_codes, `numbered` has shard, piece, local, number."""

    def build(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int64()), ("n", pa.int32()), ("n_words", pa.int32()), ("numbers", pa.binary()), ("forward", pa.binary()), ("reverse", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        piece, local = right.column("piece").to_numpy(), right.column("local").to_numpy()
        number, named = np.unique(right.column("number").to_numpy(), return_inverse=True)
        if number[-1] >> 31:
            raise ValueError("numbers of words pass 31 bits")
        order = np.argsort(piece, kind="stable")
        piece, local, named = piece[order], local[order], named[order]
        texts = []
        for r in left.to_batches(max_chunksize=1):
            mine = slice(*np.searchsorted(piece, [r.column("piece")[0].as_py(), r.column("piece")[0].as_py() + 1]))
            codes = unpacked(r.column("codes")[0].as_py(), r.column("n_codes")[0].as_py(), np.int32)
            symbol = np.zeros(max(int(codes.max()), int(local[mine].max(initial=0)) + 1) + 1, np.int32)
            symbol[local[mine] + 1] = named[mine] + 1
            texts += [symbol[codes], np.zeros(1, np.int32)]
        text = np.concatenate(texts)
        inside = text > 0
        pair = np.zeros(len(text), bool)  # words beside another common word of their piece
        pair[1:] |= inside[1:] & inside[:-1]
        pair[:-1] |= inside[1:] & inside[:-1]
        text[~pair] = 0
        text = text[pair | np.concatenate([[True], pair[:-1]])]  # one 0 after each run of words
        if not pair.any():
            return schema.empty_table()
        forward, reverse = transforms(text, len(number) + 1, depth)
        give_back()
        return pa.table([[key[0].as_py()], [len(forward)], [len(number)], [packed(number.astype(np.int64))], [packed(forward)], [packed(reverse)]], schema=schema)

    return sharded.groupBy("shard").cogroup(numbered.groupBy("shard")).applyInArrow(build, INDEX)


PAIRS = "bucket int, shard long, n int, keys binary, counts binary"
PARTS = {"parent": np.int64, "number": np.int32, "suffix": np.int64, "lo": np.int32, "lo_r": np.int32, "size": np.int32}
RISING = ("phrase", "parent")  # in order within a list, and so stored as differences
COMMON = "shard long, n int, phrase binary, parent binary, number binary, suffix binary, lo binary, lo_r binary, size binary, phrase_id long, parent_id long, suffix_id long, a long"
COMMON_SCHEMA = pa.schema([("shard", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("phrase", *PARTS)], *[(c, pa.int64()) for c in ("phrase_id", "parent_id", "suffix_id", "a")]])


def coded(part: dict[str, np.ndarray], lo: int, hi: int) -> dict[str, int | bytes]:
    return {"n": hi - lo} | {c: packed(np.diff(v[lo:hi], prepend=0) if c in RISING else v[lo:hi]) for c, v in part.items()}


def opened(table: pa.Table) -> dict[str, np.ndarray]:
    """What the lists of a table hold, one list after the other; parts that its lists do not have are left out."""
    n, part = table.column("n").to_pylist(), {}
    for c, kind in {"phrase": np.int64, **PARTS}.items():
        if c in table.column_names and not table.column(c).null_count:
            pieces = [unpacked(v, m, kind) for v, m in zip(table.column(c).to_pylist(), n)]
            part[c] = np.concatenate([np.cumsum(v) for v in pieces] if c in RISING else pieces)
    return part


def kept(group: pa.Table, here: np.ndarray, place: np.ndarray, part: dict[str, np.ndarray], once: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """The common phrases of a bucket: a row for each phrase, and a list for each shard that is to extend them.

    `here` are the places of their occurrences in the group's lists, `place` and `part` what is known of each, `once` what is known of each phrase."""
    bucket = group.column("bucket")[0].as_py()
    ends = np.searchsorted(here, np.cumsum(group.column("n").to_numpy())).tolist()
    part = {"phrase": place * buckets + bucket} | {c: v.astype(PARTS[c]) for c, v in part.items()}
    shipped = [{"shard": shard} | coded(part, lo, hi) for shard, lo, hi in zip(group.column("shard").to_pylist(), [0, *ends], ends) if hi > lo]
    phrases = pa.table({"phrase_id": np.arange(len(once["a"])) * buckets + bucket} | once)
    return pa.concat_tables([pa.Table.from_pylist(shipped, COMMON_SCHEMA), phrases], promote_options="default")


def first_round(indexed: DataFrame, buckets: int) -> DataFrame:
    """All pairs of common words of every shard, dealt by a hash of the pair: sorted keys (first number * 2**32 + second) as differences, and counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                numbers, reverse = unpacked(r["numbers"], r["n_words"], np.int64), unpacked(r["reverse"], r["n"], np.int32)
                size = np.bincount(reverse, minlength=r["n_words"] + 1)[1:]
                owner = np.repeat(np.arange(r["n_words"]), size)
                follower = reverse[len(reverse) - len(owner) :].astype(np.int64)
                pair, count = np.unique((owner * (r["n_words"] + 1) + follower)[follower > 0], return_counts=True)
                key = (numbers[pair // (r["n_words"] + 1)] << 32) + numbers[pair % (r["n_words"] + 1) - 1]
                bucket = (mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                key, count, ends = key[order], count[order].astype(np.int32), np.searchsorted(bucket[order], np.arange(buckets + 1))
                out = [(b, r["shard"], hi - lo, packed(np.diff(key[lo:hi], prepend=0)), packed(count[lo:hi])) for b, (lo, hi) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())) if hi > lo]
                kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*out), kinds)], ["bucket", "shard", "n", "keys", "counts"])
                give_back()

    return indexed.mapInArrow(lean(rows), PAIRS)


def common_pairs(pairs: DataFrame, buckets: int, least: int) -> DataFrame:
    """The pairs that are common over all shards: a row each with a number of its own (phrase_id) and the sum `a`, and a list for each shard of those that it has."""

    def rows(group: pa.Table) -> pa.Table:
        n = group.column("n").to_numpy()
        keys = np.concatenate([np.cumsum(unpacked(k, m, np.int64)) for k, m in zip(group.column("keys").to_pylist(), n.tolist())])
        counts = np.concatenate([unpacked(c, m, np.int32) for c, m in zip(group.column("counts").to_pylist(), n.tolist())])
        order = np.argsort(keys, kind="stable")
        first = np.flatnonzero(np.diff(keys[order], prepend=-1))
        total = np.add.reduceat(counts[order].astype(np.int64), first)
        enough = total >= least
        place = np.searchsorted(keys[order][first][enough], keys)
        known = keys[order][first][enough]
        here = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == keys) if len(known) else np.zeros(0, np.int64)
        place, key = place[here], keys[here]
        give_back()
        once = {"parent_id": known >> 32, "suffix_id": known & 0xFFFFFFFF, "a": total[enough]}
        return kept(group, here, place, {"parent": key >> 32, "number": key & 0xFFFFFFFF}, once, buckets)

    return pairs.groupBy("bucket").applyInArrow(rows, COMMON)


LISTS = "bucket int, shard long, n int, parent binary, number binary, suffix binary, lo binary, lo_r binary, size binary"
LISTS_SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in PARTS]])


def grown(n: int, n_words: int, codes: tuple[bytes, bytes, bytes], phrases: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Extensions of a shard's phrases.

    An extension counts only if what it is without its first word is common, too: that is one of the shard's phrases again, its `suffix`."""
    numbers, forward, reverse = unpacked(codes[0], n_words, np.int64), unpacked(codes[1], n, np.int32), unpacked(codes[2], n, np.int32)
    ids, parents, words, suffixes = (phrases[c] for c in ("phrase", "parent", "number", "suffix"))
    if "lo" in phrases:
        lo, lo_r, size = (phrases[c].astype(np.int64) for c in ("lo", "lo_r", "size"))
    else:  # pairs: each interval is one rank query
        a, b = np.searchsorted(numbers, parents) + 1, np.searchsorted(numbers, words) + 1
        ends, step = np.cumsum(np.bincount(reverse, minlength=n_words + 1)), Ranks(reverse).step
        lo, lo_r = Ranks(forward).step(a, ends[b - 1]), step(b, ends[a - 1])
        size = step(b, ends[a]) - lo_r
    order = np.argsort(lo_r)
    owner, symbol, lo, lo_r, size = extended(reverse, n_words + 1, lo[order], lo_r[order], size[order])
    owner = order[owner]
    parent_of = np.unique(parents)
    known = np.searchsorted(parent_of, parents) << 31 | words
    by_key = np.argsort(known)
    rank = np.searchsorted(parent_of, suffixes[owner])
    wanted = rank << 31 | numbers[symbol - 1]
    place = np.minimum(np.searchsorted(known[by_key], wanted), len(known) - 1)
    here = np.flatnonzero((known[by_key][place] == wanted) & (parent_of[np.minimum(rank, len(parent_of) - 1)] == suffixes[owner]))
    owner, symbol, place = owner[here], symbol[here], place[here]
    give_back()
    return {"parent": ids[owner], "number": numbers[symbol - 1], "suffix": ids[by_key[place]], "lo": lo[here], "lo_r": lo_r[here], "size": size[here]}


def lists(shard: int, found: dict[str, np.ndarray], buckets: int) -> pa.Table:
    """A shard's extensions, dealt by a hash of the phrase: a row per bucket, parents in order as differences."""
    bucket = (mix(mix(found["parent"].astype(np.uint64)) ^ found["number"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((found["number"], found["parent"], bucket))
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1)).tolist()
    part = {c: found[c][order].astype(kind) for c, kind in PARTS.items()}
    out = []
    for b, (lo, hi) in enumerate(zip(ends[:-1], ends[1:])):
        if hi > lo:
            out.append({"bucket": b, "shard": shard} | coded(part, lo, hi))
    return pa.Table.from_pylist(out, LISTS_SCHEMA)


def next_round(indexed: DataFrame, phrases: DataFrame, buckets: int) -> DataFrame:
    """Extensions of `phrases` (lists of shards: phrase, parent, number and, but for pairs, suffix and intervals)."""

    def rows(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return LISTS_SCHEMA.empty_table()
        r, known = left.to_pylist()[0], opened(right)
        known["number"] = known["number"].astype(np.int64)
        known.setdefault("suffix", known["number"])  # of a pair: its second word
        found = grown(r["n"], r["n_words"], (r["numbers"], r["forward"], r["reverse"]), known)
        return lists(r["shard"], found, buckets)

    return indexed.groupBy("shard").cogroup(phrases.groupBy("shard")).applyInArrow(rows, LISTS)


def common(extensions: DataFrame, buckets: int, least: int, grow: bool = True) -> DataFrame:
    """Extensions that are common over all shards: a row each and, if they are to `grow`, a list for each shard of those that it has."""

    def rows(group: pa.Table) -> pa.Table:
        part = opened(group)
        key = np.unique(part["parent"], return_inverse=True)[1].astype(np.int64) << 31 | part["number"]
        first, place = np.unique(key, return_index=True, return_inverse=True)[1:]
        total = np.bincount(place, weights=part["size"]).astype(np.int64)
        enough = total >= least
        once = {"parent_id": part["parent"][first][enough], "suffix_id": part["suffix"][first][enough], "a": total[enough]}
        here = np.flatnonzero(enough[place]) if grow else np.zeros(0, np.int64)
        place = (np.cumsum(enough) - 1)[place[here]]
        give_back()
        return kept(group, here, place, {c: v[here] for c, v in part.items()}, once, buckets)

    return extensions.groupBy("bucket").applyInArrow(rows, COMMON)


def phrases(df: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """All phrases of 2 to `longest` words that occur `least` times or more in their language.

    Columns lang, phrase, depth, a (its count), n (the language's words), before and after (counts of its
    first k and of its words behind them, for k = 1, 2, ..), left_word and right_word (the word that always stands before or after it, else null)."""
    sharded = store(shards(df, text_col, lang_col, shard), "op11-shards")
    n = sharded.count()
    pieces = store(together(sharded, shard), "op11-pieces")  # a row per shard
    sharded_pieces = sharded.withColumnRenamed("shard", "piece").join(F.broadcast(pieces), "piece")
    words = sharded_pieces.select("shard", "piece", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("local", "w")).select("shard", "piece", "lang", "local", F.col("w.words").alias("word"), F.col("w.counts").alias("count"))
    # All steps of a word's numbering are in one part of a hash; a part numbers its common words from 0 on, and numbers of different parts never meet.
    parts = max(64, n)
    words = words.withColumn("part", F.pmod(F.xxhash64("lang", "word"), F.lit(parts))).repartition("part")
    words = words.withColumn("a", F.sum("count").over(Window.partitionBy("part", "lang", "word"))).where(F.col("a") >= least)
    place = F.dense_rank().over(Window.partitionBy("part").orderBy("lang", "word"))
    placed = store(words.select("shard", "piece", "local", "lang", "word", "a", ((place - 1) * parts + F.col("part") + 1).cast("long").alias("phrase_id")), "op11-placed")
    vocabulary = store(placed.groupBy("phrase_id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.first("a").alias("a")), "op11-words")
    n = pieces.select("shard").distinct().count()
    shares = min(max(1, n), 20_000)
    numbers = placed.select("shard", "piece", "local", F.col("phrase_id").alias("number")).repartition(shares, "shard")
    texts = sharded_pieces.select("shard", "piece", "codes", "n_codes").repartition(shares, "shard")
    indexed, table = in_buckets(index(texts, numbers, longest), "shard", shares, "op11-index")
    sizes = store(sharded.groupBy("lang").agg(F.sum("n").alias("n")), "op11-sizes")
    discard(placed, sharded, pieces)
    none = F.array().cast("array<long>")
    spelled = F.col("word").cast("string")
    level = vocabulary.select("phrase_id", "lang", "a", spelled.alias("phrase"), spelled.alias("head"), spelled.alias("last"), none.alias("before"), none.alias("after"))
    levels, live = [], None
    buckets = max(16, n // 2)  # a group holds the lists of about two shards
    for depth in range(2, longest + 1):
        if depth == 2:
            found = common_pairs(first_round(indexed, buckets), buckets, least)
        else:
            found = common(next_round(indexed, live, buckets), buckets, least, depth < longest)
        found = store(found, "op11-common")
        discard(live)
        live = found.where("shard is not null").select("shard", "n", "phrase", *PARTS)
        ends = level.select(F.col("phrase_id").alias("suffix"), F.col("phrase").alias("tail_phrase"), "last", F.col("a").alias("tail_a"), F.col("after").alias("tail_after"))
        heads = level.select(F.col("phrase_id").alias("parent"), "lang", "head", "before", F.col("a").alias("head_a"))
        once = found.where("phrase_id is not null").select("phrase_id", F.col("parent_id").alias("parent"), F.col("suffix_id").alias("suffix"), "a")
        named = once.join(heads, "parent").join(ends, "suffix")
        level = store(
            named.select(
                "phrase_id", "parent", "suffix", "lang", "a", F.concat_ws(" ", "head", "tail_phrase").alias("phrase"), "head", "last",
                F.concat("before", F.array("head_a")).alias("before"), F.concat(F.array("tail_a"), "tail_after").alias("after"),
            ),
            "op11-phrases",
        )
        levels.append(level)
    discard(indexed, live)
    df.sparkSession.sql(f"drop table {table}")
    out = None
    for depth, part in enumerate(levels, 2):
        part = part.select("phrase_id", F.lit(depth).alias("depth"), "lang", "phrase", "a", "before", "after")
        if depth < longest:  # of a phrase's extensions on a side at most one is as common as the phrase
            longer = levels[depth - 1]
            part = part.join(longer.where(F.col("a") == F.col("after")[0]).select(F.col("suffix").alias("phrase_id"), F.col("head").alias("left_word")), "phrase_id", "left")
            part = part.join(longer.where(F.col("a") == F.element_at("before", -1)).select(F.col("parent").alias("phrase_id"), F.col("last").alias("right_word")), "phrase_id", "left")
        else:
            part = part.withColumn("left_word", F.lit(None).cast("string")).withColumn("right_word", F.lit(None).cast("string"))
        out = part if out is None else out.unionByName(part)
    return out.join(sizes, "lang").select("lang", "phrase", "depth", "a", "n", "before", "after", "left_word", "right_word")


def cut_scores() -> Column:
    """For each cut the floored score, its place and both counts. Products of counts pass 64 bits, so they are decimals without a fraction."""
    return F.expr(
        "transform(before, (l, i) -> struct((cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(l as decimal(19, 0)) * cast(after[i] as decimal(19, 0))) as score, i as k, l as l, after[i] as r))"
    )


def collocations(df: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, text_col: str = "text", lang_col: str = "lang", shard: int = SHARD) -> DataFrame:
    """Each language's `top` phrases that no longer phrase of the same count holds: lang, rank, phrase, a, l, r, n, score."""
    free = phrases(df, longest, least, text_col, lang_col, shard).where("left_word is null and right_word is null")
    worst = free.withColumn("cut", F.array_min(cut_scores())).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return worst.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("long"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents
), words as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from pieces),
sizes as (select lang, sum(len(w))::hugeint as n from words group by lang),
runs as (
  select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase from (
    select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from words, (select unnest(range(1, {LONGEST + 1})) as m)
  )
), counted as (select lang, m, phrase, count(*)::hugeint as a from runs group by all having count(*) >= {LEAST}),
candidates as (select lang, m, phrase, a, string_split(phrase, ' ') as w from counted where m > 1),
held as (
  select lang, array_to_string(w[:m - 1], ' ') as phrase, a from candidates union select lang, array_to_string(w[2:], ' '), a from candidates
), free as (select c.* from candidates c anti join held h on c.lang = h.lang and c.phrase = h.phrase and c.a = h.a),
cut as (select *, array_to_string(w[:k], ' ') as head, array_to_string(w[k + 1:], ' ') as tail from (select *, unnest(range(1, m)) as k from free)),
scored as (
  select c.lang, c.phrase, c.a, l.a as l, r.a as r, n, (1000 * c.a * n) // (l.a * r.a) as score, k
  from cut c join counted l on l.lang = c.lang and l.phrase = c.head join counted r on r.lang = c.lang and r.phrase = c.tail join sizes s on s.lang = c.lang
  qualify row_number() over (partition by c.lang, c.phrase order by (1000 * c.a * n) // (l.a * r.a), k) = 1
)
select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from scored
) where rank <= {TOP}
"""
