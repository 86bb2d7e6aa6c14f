"""op4: best-fit packing of tokenised documents by hierarchical residual packing.

Texts are tokenised with a public byte-level vocabulary; a document longer
than a sequence is cut into full pieces, of which only the first may be
shorter. Pieces are spread over partitions of about `items` rows; each packs
its pieces best-fit decreasing. Nearly full bins are final. Each partition
passes on its bins of at most half a sequence (best fit leaves one at most)
and the `hosts` emptiest others; eight partitions at a time pack those bins
as items, level by level, until one partition is left. So what a task holds
is bounded by `items` and by 8 * (hosts + 1), however large the input.

Tokenising: a pre-token never spans the place before an ASCII blank (space,
tab, line feed, form feed, carriage return) that follows a character which
is no white space, so a text is cut there and each distinct unit is encoded
once.

Defined results: a null or empty text is one piece that holds only the end
id. Repeated rows and repeated or null ids are packed row by row. Pieces of
equal length are interchangeable, so places may differ between reruns. A text
of any length is tokenised by one task, unit by unit. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, documents, give_back, lean, store
from .words import hash_spans, pieces, text_bytes

VOCABULARY, END_ID, SEQUENCE = "byte_bpe_50k.json", 2, 1024
ITEMS, FAN, HOSTS = 16384, 8, 64
CACHE, ID_ROOM, PART = 600_000, 4_000_000, 2 << 20  # units and ids that the cache holds, bytes of text at a time
BLANK, PLAIN, LEAD_2, LEAD_3 = (np.zeros(256, bool) for _ in range(4))
BLANK[[9, 10, 12, 13, 32]] = True
PLAIN[0x21:0x7F] = True  # no white space
LEAD_2[0xC3:0xE0] = True  # first bytes of two-byte characters that are no white space
LEAD_3[0xE4:0xF0] = True  # and of three-byte ones


def unit_cuts(data: np.ndarray) -> np.ndarray:
    """True where a unit may begin: at a blank that follows a character which is surely no white space."""
    cut = np.zeros(len(data) + 1, bool)
    after = PLAIN[data]
    after[1:] |= LEAD_2[data[:-1]]
    after[2:] |= LEAD_3[data[:-2]]
    cut[1:-1] = BLANK[data[1:]] & after[:-1]
    return cut


class Encoder:
    """Ids of texts; each distinct unit between blanks is encoded once while the cache holds it."""

    def __init__(self, name: str = VOCABULARY):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self._clear()

    def _clear(self) -> None:
        self.known, self.begin, self.size, self.hits = np.zeros(0, np.uint64), *(np.zeros(0, np.int32) for _ in range(3))
        self.ids, self.used = np.zeros(ID_ROOM, np.uint32), 0

    def _trim(self) -> None:
        """Keep the units that were met again, half a cache of the most frequent ones at most."""
        least = max(1, int(np.sort(self.hits)[-min(len(self.hits), CACHE // 2)]))
        keep = self.hits >= least
        known, begin, size, hits = self.known[keep], self.begin[keep], self.size[keep], self.hits[keep]
        begins = np.cumsum(size) - size
        held = self.ids[np.arange(int(size.sum())) + np.repeat(begin - begins, size)]
        self._clear()
        self.known, self.begin, self.size, self.hits = known, begins.astype(np.int32), size, hits // 2
        self.ids, self.used = np.concatenate([held, np.zeros(ID_ROOM, np.uint32)]), len(held)

    def texts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, without an end id."""
        data, at = text_bytes(column)
        for lo, hi in pieces(data, at, PART):
            part, row = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            cut = unit_cuts(part)
            cut[row] = True
            bounds = np.flatnonzero(cut)
            starts, ends = bounds[:-1], bounds[1:]
            where = self._lookup(part, starts, ends)
            size, begin = self.size[where], self.begin[where]
            total = np.concatenate([[0], np.cumsum(size)])
            flat = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], size)]
            ends_of_rows = total[np.searchsorted(starts, row)]
            for i in range(hi - lo):
                yield flat[ends_of_rows[i] : ends_of_rows[i + 1]]

    def _lookup(self, part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places of the units in the cache, after the new ones have been encoded."""
        if not len(starts):
            return np.zeros(0, np.int64)
        unique, first, inverse = np.unique(hash_spans(part, starts, ends), return_index=True, return_inverse=True)
        if len(self.known) + len(unique) > CACHE:
            self._trim()
        at = np.searchsorted(self.known, unique)
        held = at < len(self.known)
        held[held] = self.known[at[held]] == unique[held]
        todo = np.flatnonzero(~held)
        self.hits[at[held]] += 1
        if len(todo):
            raw, sizes = part.tobytes(), np.empty(len(todo), np.int32)
            for k in range(0, len(todo), 4096):
                f = first[todo[k : k + 4096]]
                for i, e in enumerate(self.encode_batch([raw[a:b].decode() for a, b in zip(starts[f].tolist(), ends[f].tolist(), strict=True)], add_special_tokens=False), k):
                    self._hold(e.ids)
                    sizes[i] = len(e.ids)
            begins = self.used - int(sizes.sum()) + np.cumsum(sizes) - sizes
            where = at[todo]
            self.known, self.begin = np.insert(self.known, where, unique[todo]), np.insert(self.begin, where, begins)
            self.size, self.hits = np.insert(self.size, where, sizes), np.insert(self.hits, where, 0)
            at = np.searchsorted(self.known, unique)
        return at[inverse]

    def _hold(self, ids: list[int]) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ID_ROOM, len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


_ENCODERS: dict[str, Encoder] = {}


def token_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, vocabulary: str = VOCABULARY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, crc (of the ids as unsigned 32-bit little-endian) and, if asked for, the ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel unit
        encoder = _ENCODERS.get(vocabulary) or _ENCODERS.setdefault(vocabulary, Encoder(vocabulary))
        for batch in batches:
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for i, ids in enumerate(encoder.texts(batch.column(1))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                head = len(ids) % sequence
                bounds = [0, *range(head or sequence, len(ids) + 1, sequence)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    row.append(i), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(ids[a:b]))
                    if with_ids:
                        kept.append(ids[a:b].tobytes())
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(kept, pa.binary())] * with_ids, ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids)

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(lean(rows), f"id {source.schema['id'].dataType.simpleString()}, piece int, start long, length long, crc long" + ", ids binary" * with_ids)


def best_fit(sizes: list[int], room: int) -> tuple[list[int], list[int], list[int]]:
    """Best fit of `sizes`, given in falling order: bin and offset of each, and the fill of each bin."""
    open_bins: list[list[int]] = [[] for _ in range(room + 1)]
    rooms, fills, bins, offsets = 0, [], [], []  # rooms: bit r is set if a bin has r left
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            one = open_bins[left].pop()
            if not open_bins[left]:
                rooms ^= 1 << left
        else:
            one, left = len(fills), room
            fills.append(0)
        bins.append(one), offsets.append(fills[one])
        fills[one] += size
        open_bins[left - size].append(one)
        rooms |= 1 << left - size
    return bins, offsets, fills


def _round(room: int, hosts: int, last: bool):
    """Pack one partition's rows (part, key, length) and say which bins are passed on."""

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key"], ascending=[False, True])
        bins, offsets, fills = best_fit(frame["length"].tolist(), room)
        fill = np.array(fills)
        passed = np.zeros(len(fill), bool)
        if not last:
            passed = fill <= room // 2
            others = np.flatnonzero(~passed & (fill < room))
            passed[others[np.argsort(fill[others], kind="stable")[:hosts]]] = True
        b = np.array(bins, np.int64)
        return pd.DataFrame({"key": frame["key"].to_numpy(), "part": key[0], "bin": frame["key"].to_numpy()[np.unique(b, return_index=True)[1]][b], "offset": np.array(offsets, np.int64), "fill": fill[b], "passed": passed[b]})

    return pack


KIND = "key long, part long, bin long, offset long, fill long, passed boolean"


def pack(items: DataFrame, room: int = SEQUENCE, per_part: int = ITEMS, hosts: int = HOSTS) -> DataFrame:
    """key -> sequence_id and offset for `items` (key: unique long, length: 1 .. room)."""
    parts = max(1, -(-items.count() // per_part))
    todo = items.select(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part"), "key", "length")
    levels = []
    while True:
        done = store(todo.groupBy("part").applyInPandas(_round(room, hosts, parts == 1), KIND), "op4-level")
        levels.append(done)
        if parts == 1:
            break
        parts = -(-parts // FAN)
        # a bin is known by the key of its first item
        todo = done.where("passed and key = bin").select(F.expr(f"part div {FAN}").alias("part"), "key", F.col("fill").alias("length"))
    placed = levels.pop().select("key", F.col("bin").alias("sequence_id"), "offset")
    for level in reversed(levels):
        upper = placed.select(F.col("key").alias("bin"), "sequence_id", F.col("offset").alias("shift"))
        placed = store(
            level.join(upper, "bin", "left").select("key", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")), "op4-placed"
        )
    return placed


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, **options) -> DataFrame:
    """One row per piece: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids, if with_ids)."""
    cut = store(token_pieces(df, id_col, text_col, sequence, **options).withColumn("key", F.monotonically_increasing_id()), "op4-pieces")
    placed = pack(cut.select("key", "length"), sequence)
    return cut.join(placed, "key").select(F.col("id").alias(id_col), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset", *(["ids"] if "ids" in cut.columns else []))


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
