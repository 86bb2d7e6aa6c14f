"""op8: removing repeated spans with a logarithmic index family.

A byte goes if a 200-byte string that covers it also starts anywhere else.

The suffix arrays are sparse. Suffixes are sampled by winnowing: every
200-byte window picks the place in it whose next 40 bytes have the smallest
hash, so equal windows pick the same suffix, and no repeated window goes
without one. An array entry is a sampled suffix: its first HEAD bytes as they
are (the sort key, as two whole numbers in byte order), the hash of its first
40 bytes, and the hash of its context, that is, of all the bytes of the
neighbouring windows that picked it; `n` says how often it stands in the array.

A new batch of documents gets an array: entries dealt over partitions and in
suffix order inside each. It is merge-scanned against each level of the index
(a sort-merge join in suffix order); a long match is a suffix that shares its
first 40 bytes with one on the other side or in its own batch. Then the batch
becomes a level, and levels of equal size merge, so that there are never more
levels than a logarithm of the batches.

A context that occurs twice is repeated in full. Where only the key matches
(at the ends of repeated spans), the windows of the contexts that share it
are compared; keys with very many contexts have their windows counted by a
shuffle instead of in one task. All counts are taken on the input as it is.

Windows are compared by 64-bit hashes of all their bytes.

Defined results: a null text counts as empty; texts under 200 bytes lose
nothing. Rows that repeat id and text are two occurrences and lose the same
bytes. Null ids take part. A text over 1 MB is read in overlapping segments of one
task, which holds its bytes whole. Of contexts that tie, all count. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, gathered, lean, store, utf8
from .words import mix, powers, text_bytes

SPAN, GRAM, SEGMENT, BATCHES, CROWD, FILTER_BITS = 200, 40, 1 << 20, 4, 20_000, 22
HEAD, SUFFIX = 16, ["head", "next", "key"]
PLACE = np.uint64((1 << 21) - 1)


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return total, down


def _span_hash(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i with all of it inside."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def _leading(data: np.ndarray, at: np.ndarray, skip: int, gram: int) -> np.ndarray:
    """Bytes `skip` .. `skip` + 7 of each suffix as whole numbers that sort as the bytes do; zeros behind the first `gram` bytes."""
    out = np.zeros(len(at), np.uint64)
    for i in range(skip, skip + HEAD // 2):
        out = out << np.uint64(8) | (data[at + i].astype(np.uint64) if i < gram else np.uint64(0))
    return (out ^ np.uint64(1 << 63)).astype(np.int64)


def picks(data: np.ndarray, begin: np.ndarray, end: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """For the texts data[begin:end], none shorter than `span`: text, pick, first and last window, key, context hash of every pick."""
    total, down = _prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    keys = _span_hash(total, down, at, at + gram)
    ranked = keys & ~PLACE | at.astype(np.uint64)
    lowest = _sliding_min(ranked, span - gram + 1)
    windows = end - begin - span + 1
    starts = np.arange(int(windows.sum())) + np.repeat(begin - np.cumsum(windows) + windows, windows)
    text = np.repeat(np.arange(len(begin)), windows)
    pick = (lowest[starts] & PLACE).astype(np.int64)
    change = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (text[1:] != text[:-1])]))
    first, last = starts[change], starts[np.append(change[1:], len(starts)) - 1]
    pick, text = pick[change], text[change]
    context = mix(_span_hash(total, down, first, last + span) ^ ((pick - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return text, pick, first, last, keys[pick], context


def _segments(data: np.ndarray, at: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(rows, begin, end, base): texts and pieces of long texts of about SEGMENT bytes together; pieces overlap by span - 1 bytes."""
    rows, begin, end, base = [], [], [], 0
    for i in np.flatnonzero(np.diff(at) >= span).tolist():
        lo, hi = int(at[i]), int(at[i + 1])
        while lo + span <= hi:
            stop = min(hi, lo + SEGMENT)
            if rows and stop - base > SEGMENT:
                yield np.array(rows), np.array(begin), np.array(end), base
                rows, begin, end = [], [], []
            if not rows:
                base = lo
            rows.append(i), begin.append(lo - base), end.append(stop - base)
            lo = stop - span + 1 if stop < hi else hi
    if rows:
        yield np.array(rows), np.array(begin), np.array(end), base


def _entries(span: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            for who, begin, end, base in _segments(data, at, span):
                part = data[base : base + end[-1]]
                text, pick, first, last, key, context = picks(part, begin, end, span, gram)
                head, behind = (_leading(part, pick, skip, gram) for skip in (0, HEAD // 2))
                row = who[text]
                place = pick + base - at[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(head), pa.array(behind), pa.array(key.astype(np.int64)), pa.array(context.astype(np.int64)), pa.array(place), pa.array((pick - first).astype(np.int32)), pa.array((last - first).astype(np.int32))],
                    ["id", "th", *SUFFIX, "context", "pick", "back", "more"],
                )

    return rows


class IndexFamily:
    """Levels of sparse suffix arrays (head, next, key, context, n), merged geometrically."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, entries: DataFrame) -> DataFrame:
        """Index a batch; the keys of its long matches, inside it and with all earlier batches."""
        array = self._sorted(entries.groupBy(*SUFFIX, "context").agg(F.count("*").alias("n")))
        found = array.groupBy(*SUFFIX).agg(F.sum("n").alias("n")).where("n > 1").select("key")
        for _, level in self.levels:
            found = found.union(array.join(level.select(*SUFFIX).hint("merge"), SUFFIX, "left_semi").select("key"))
        found = store(found.distinct(), "op8-matches")
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, level = self.levels.pop()
            merged = self._sorted(level.unionByName(array).groupBy(*SUFFIX, "context").agg(F.sum("n").alias("n")))
            discard(level, array)
            array, size = merged, size * 2
        self.levels.append((size, array))
        return found

    @staticmethod
    def _sorted(array: DataFrame) -> DataFrame:
        return store(array.sortWithinPartitions(*SUFFIX, "context"), "op8-level")

    def entries(self) -> DataFrame:
        whole = self.levels[0][1]
        for _, level in self.levels[1:]:
            whole = whole.unionByName(level)
        whole = whole.select("key", "context", "n")
        return whole if len(self.levels) == 1 else whole.groupBy("key", "context").agg(F.sum("n").alias("n"))

    def drop(self) -> None:
        discard(*[level for _, level in self.levels])


def _contexts(span: int, crowded: bool):
    """Bytes of each wanted context, or, for crowded keys, the hashes of its windows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            lists = batch.column(3)
            inner, offsets = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
            key, pick, back, more, partner = (x.to_numpy(zero_copy_only=False) for x in inner.flatten())
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            start = at[row] + pick - back
            stop = start + more + span
            bytes_ = [data[a:b].tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
            what = pa.array(bytes_, pa.binary())
            if crowded:
                hashes = []
                for x in bytes_:
                    total, down = _prefix_hash(np.frombuffer(x, np.uint8))
                    i = np.arange(len(x) - span + 1)
                    hashes.append(_span_hash(total, down, i, i + span).astype(np.int64))
                what = pa.array(hashes, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(pick), pa.array(back), pa.array(partner, pa.bool_()), what], ["key", "id", "th", "pick", "back", "partner", "bytes"])

    return rows


def _compare(span: int, spare: int = 2 << 20):
    """Repeated stretches of contexts: rows come sorted by key, so contexts that share a key stand together."""

    def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        data, at = text_bytes(table.column("bytes"))
        back, pick = table.column("back").to_numpy().astype(np.int64), table.column("pick").to_numpy()
        key = table.column("key").to_numpy().astype(np.uint64)
        total, down = _prefix_hash(data)
        windows = np.diff(at) - span + 1
        first = np.cumsum(windows) - windows
        row = np.repeat(np.arange(len(windows)), windows)
        inside = np.arange(len(row)) - first[row]
        start = at[row] + inside
        named = mix(_span_hash(total, down, start, start + span) ^ mix(key[row] + (back[row] - inside).astype(np.uint64)))
        _, where, count = np.unique(named, return_inverse=True, return_counts=True)
        again = count[where] > 1
        low = np.minimum.reduceat(np.where(again, inside, 1 << 30), first)
        high = np.maximum.reduceat(np.where(again, inside, -1), first)
        keep = (high >= 0) & ~table.column("partner").to_numpy(zero_copy_only=False)
        at_text = pick - back
        hit = pa.array(np.flatnonzero(keep))
        columns = [table.column(c).combine_chunks().take(hit) for c in ("id", "th")]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns), pa.array((at_text + low)[keep]), pa.array((at_text + high + span)[keep])], ["id", "th", "lo", "hi"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if size + batch.nbytes > spare and (cut or (held and held[-1].column(0)[-1].as_py() != keys[0])):
                ready = [*held, batch.slice(0, cut)] if cut else held
                yield solve([x for x in ready if x.num_rows])
                held, size = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            size += batch.nbytes
        if held:
            yield solve(held)

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data, kept, removed, n, at = (text or "").encode(), [], 0, 0, 0
            reach = -1
            for s in sorted((s["lo"], s["hi"]) for s in spans or []):
                if s[0] > reach:
                    kept.append(data[at : s[0]])
                    n += 1
                    removed += s[1] - s[0]
                    at = reach = s[1]
                elif s[1] > reach:
                    removed += s[1] - reach
                    at = reach = s[1]
            kept.append(data[at:])
            out.append((len(data), removed, n, hashlib.sha256(b"".join(kept)).hexdigest()))
        size, removed, n, sha = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _row_filter(wanted: DataFrame) -> np.ndarray:
    """A bit set of fixed size that has every row of `wanted` (id, th); others may hit it by chance."""
    bit = F.pmod(F.xxhash64("id", "th"), F.lit(1 << FILTER_BITS)).cast("int")
    out = np.zeros(1 << FILTER_BITS, bool)
    out[gathered(wanted.select(bit.alias("bit")).distinct())["bit"]] = True
    return np.packbits(out)


def _maybe(source: DataFrame, bits: np.ndarray) -> DataFrame:
    """`source` with a column `maybe`, false where the row is surely not in the bit set; it spares shuffling those texts."""
    shared = source.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(3).to_numpy()
            hit = (shared.value[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hit.astype(bool))], ["id", "th", "text", "maybe"])

    bit = F.pmod(F.xxhash64("id", "th"), F.lit(1 << FILTER_BITS)).cast("int")
    return source.withColumn("bit", bit).mapInArrow(lean(rows), f"id {source.schema['id'].dataType.simpleString()}, th long, text string, maybe boolean")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, batches: int = BATCHES, crowd: int = CROWD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(source, spans, bits): the rows (id, th, text), the repeated stretches (id, th, lo, hi) in bytes, and the row filter of the latter."""
    source = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    entries = store(source.mapInArrow(lean(_entries(span, gram)), f"id {kind}, th long, head long, next long, key long, context long, pick long, back int, more int"), "op8-entries")
    family, matches, found_in = IndexFamily(), None, []
    batch = F.pmod(F.xxhash64("id", "th"), F.lit(batches))
    for b in range(batches):
        found = family.add(entries.where(batch == b))
        found_in.append(found)
        matches = found if matches is None else matches.union(found)
    classes = family.entries().join(matches.distinct(), "key", "left_semi")
    keys = classes.groupBy("key").agg(F.count("*").alias("contexts"))
    classes = store(classes.join(keys, "key"), "op8-classes")
    family.drop()
    discard(*found_in)
    own = store(entries.join(classes, ["key", "context"]).select("id", "th", "key", "context", "pick", "back", "more", "n", "contexts"), "op8-own")
    discard(entries, classes)
    whole = own.where("n > 1").select("id", "th", (F.col("pick") - F.col("back")).alias("lo"), (F.col("pick") - F.col("back") + F.col("more") + span).alias("hi"))
    one = F.struct("id", "th", "pick", "back", "more")
    mates = own.where("n > 1 and contexts > 1").groupBy("key", "context", "contexts").agg(F.min(one).alias("one")).select("one.*", "key", "contexts", F.lit(True).alias("partner"))
    ends = own.where("n = 1").select("id", "th", "pick", "back", "more", "key", "contexts", F.lit(False).alias("partner")).unionByName(mates)
    wanted = ends.groupBy("id", "th", (F.col("contexts") > crowd).alias("crowded")).agg(F.collect_list(F.struct("key", "pick", "back", "more", "partner")).alias("list"))
    wanted = store(wanted, "op8-wanted")
    texts = _maybe(source, _row_filter(wanted)).where("maybe").dropDuplicates(["id", "th"])

    def fetch(crowded: bool, what: str) -> DataFrame:
        w = wanted.where(F.col("crowded") == crowded).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "list")
        rows = texts.join(w, (texts.th == w._th) & texts.id.eqNullSafe(w._id)).select("id", "th", "text", "list")
        return rows.mapInArrow(lean(_contexts(span, crowded)), f"key long, id {kind}, th long, pick long, back int, partner boolean, bytes {what}")

    found = fetch(False, "binary").repartition("key").sortWithinPartitions("key").mapInArrow(lean(_compare(span)), f"id {kind}, th long, lo long, hi long")
    spans = whole.unionByName(found)
    if not wanted.where("crowded").isEmpty():
        crowd_rows = store(fetch(True, "array<long>"), "op8-crowd")
        each = crowd_rows.select("key", "id", "th", "pick", "back", "partner", F.posexplode("bytes").alias("i", "window")).withColumn("left", F.col("back") - F.col("i"))
        again = store(each.groupBy("key", "left", "window").count().where("count > 1").drop("count"), "op8-again")
        start = F.col("pick") - F.col("back")
        spans = spans.unionByName(each.where("not partner").join(again, ["key", "left", "window"]).groupBy("id", "th", "pick", "back").agg((start + F.min("i")).alias("lo"), (start + F.max("i") + span).alias("hi")).select("id", "th", "lo", "hi"))
    spans = store(spans, "op8-spans")
    discard(own, wanted)
    return source, spans, _row_filter(spans)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of `df`: id_col, n_bytes, n_removed, n_spans, kept_sha256."""
    source, spans, bits = repeated_spans(df, id_col, text_col, **options)
    kind = source.schema["id"].dataType.simpleString()
    lists = store(spans.distinct().groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "op8-lists")
    marked = _maybe(source, bits)
    maybe = marked.where("maybe")
    cut = maybe.join(lists, (maybe.th == lists._th) & maybe.id.eqNullSafe(lists._id), "left").select("id", "text", "spans")
    cut = cut.mapInArrow(lean(_cut), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    data, none = utf8(F.col("text")), F.lit(0).cast("long")
    rest = marked.where("not maybe").select("id", F.length(data).cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(data, 256).alias("kept_sha256"))
    return cut.unionByName(rest).withColumnRenamed("id", id_col)


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated(documents(spark, sf_dir))
