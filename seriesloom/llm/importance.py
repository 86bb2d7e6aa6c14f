"""op13: importance resampling towards a target distribution.

A text's features are its runs of 1 to `width` words; each falls into one of
a fixed number of buckets. Counts over all documents and over all target
texts give every bucket a gain, and a document's weight is the sum of its
features' gains. A score is the weight plus Gumbel noise that hangs on the
document's id alone, so taking the highest scores is a draw without
replacement whose chances follow the weights.

Scores are stored once. The cutoff is then found by threshold bisection:
each job counts, exactly, the rows up to the thresholds of the next few
halvings; where scores tie at the cutoff, the same is done for ids, and for
rows that repeat an id, for row numbers. No row leaves the executors; the rows that
are drawn are range-partitioned by their order, which gives them ranks.

Defined results: a null text and one without words have no features and
weight 0; so has every text where no bucket is counted. Ids are integers; a null id
makes noise as the empty string does, and comes after all others in ties.
Rows that repeat an id have the same noise and are drawn one by one.
Texts are cut inside a row at bytes that are in no word, so memory does not follow the
longest text; one word is held whole. An empty table gives an empty result, an empty target all buckets the
gain of no target count. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .segments import runs_of, segments, table_of
from .shared import discard, documents, gathered, in_order, lean, narrow, store
from .words import LOWER

BUCKETS = 10_000
SEED = "2024"
HALVINGS = 3
LONG_WORD = 64

WORD = ~table_of(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The unsigned CRC-32 of each data[start:end], all spans byte by byte together."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    out = np.empty(len(starts), np.uint32)
    long = int(np.searchsorted(-left, -LONG_WORD, "left"))
    for i in range(long):
        out[i] = zlib.crc32(data[at[i] : at[i] + left[i]])
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for j in range(LONG_WORD):
        still = int(np.searchsorted(-left, -j, "left"))  # spans with over j bytes
        if still <= long:
            break
        now = crc[long:still]
        crc[long:still] = CRC[(now ^ data[at[long:still] + j]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
    out[long:] = ~crc[long:]
    done = np.empty_like(out)
    done[order] = out
    return done


@dataclass
class Features:
    """Buckets of the features of rows first .. first+rows; row i has those of at[i] .. at[i+1]."""

    first: int
    buckets: np.ndarray
    at: np.ndarray


def features(column: pa.Array, width: int, buckets: int) -> Iterator[Features]:
    """The buckets of all features; a long row comes in several parts."""
    held: tuple[int, list[bytes]] = (-1, [])
    for lo, hi, data, row in segments(column, ~WORD):
        data = LOWER[data]
        starts, ends = runs_of(WORD[data], row)
        if width == 1:
            yield Features(lo, crc32s(data, starts, ends) % buckets, np.searchsorted(starts, row))
            continue
        words = [data[a:b].tobytes() for a, b in zip(starts, ends)]
        first = np.searchsorted(starts, row)
        for i in range(hi - lo):
            mine = words[first[i] : first[i + 1]]
            before = held[1] if held[0] == lo + i else []
            joined, old = before + mine, len(before)
            found = [zlib.crc32(b" ".join(joined[j - k : j])) % buckets for j in range(old + 1, len(joined) + 1) for k in range(1, min(width, j) + 1)]
            held = (lo + i, joined[-(width - 1) :])
            yield Features(lo + i, np.array(found, np.int64), np.array([0, len(found)]))


def bucket_counts(df: DataFrame, text_col: str, width: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; at most one row a bucket comes to the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in features(batch.column(0), width, buckets):
                total += np.bincount(part.buckets, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = gathered(narrow(df, text=text_col).mapInArrow(lean(rows), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    total = np.zeros(buckets, np.int64)
    total[counted["bucket"].astype(np.int64)] = counted["n"].astype(np.int64)
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how many times likelier the target has a bucket), with one added to each count, in doubles."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000.0 * np.log(((t + 1.0) * (s.sum() + n)) / ((s + 1.0) * (t.sum() + n)))).astype(np.int64)


def noise(id_col: Column, seed: str) -> Column:
    """floor(-1000 * ln(-ln(u))), with u from the first eight hex digits of a SHA-256 over seed and id."""
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def scored(df: DataFrame, target: DataFrame, id_col: str, text_col: str, target_col: str, width: int, buckets: int, seed: str) -> DataFrame:
    """Columns id, n_words, n_features, weight, score: one row per row of `df`."""
    gain = gains(bucket_counts(df, text_col, width, buckets), bucket_counts(target, target_col, width, buckets))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for part in features(batch.column(1), width, buckets):
                total = np.concatenate([[0], np.cumsum(gain[part.buckets])])
                count[part.first : part.first + len(part.at) - 1] += np.diff(part.at)
                weight[part.first : part.first + len(part.at) - 1] += np.diff(total[part.at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_words(count, width)), pa.array(count), pa.array(weight)], ["id", "n_words", "n_features", "weight"])

    plain = narrow(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(lean(rows), "id long, n_words long, n_features long, weight long").withColumn("score", F.col("weight") + noise(F.col("id"), seed))


def _words(n_features: np.ndarray, width: int) -> np.ndarray:
    """How many words have so many features: m words have m + (m - 1) + .. for as many terms as `width` allows."""
    all_short = width * (width + 1) // 2
    long = (n_features + width * (width - 1) // 2) // width
    short = ((np.sqrt(8.0 * n_features + 1) - 1) / 2).astype(np.int64)
    return np.where(n_features >= all_short, long, short)


def cutoff(table: DataFrame, keys: list[str], take: int, halvings: int = HALVINGS) -> dict[str, int]:
    """Key values of the row that is number `take` when rows are ordered by the integer columns `keys`, found by bisection.

    A later key is only settled among the rows that tie in all earlier ones, and only if some of them are not taken."""
    found: dict[str, int] = {}
    tied, need = table, take
    for key in keys:
        ends = tied.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        lo, hi = ends["lo"], ends["hi"]
        while lo < hi:
            spans, marks = [(lo, hi)], []
            for _ in range(halvings):
                halves = [(a, b, a + (b - a) // 2) for a, b in spans if a < b]
                marks += [m for _, _, m in halves]
                spans = [half for a, b, m in halves for half in ((a, m), (m + 1, b))]
            counts = dict(zip(marks, tied.agg(*[F.count(F.when(F.col(key) <= m, 1)).alias(f"c{i}") for i, m in enumerate(marks)]).first()))
            for _ in range(halvings):
                if lo < hi:
                    mid = lo + (hi - lo) // 2
                    lo, hi = (lo, mid) if counts[mid] >= need else (mid + 1, hi)
        found[key] = lo
        below = tied.agg(F.count(F.when(F.col(key) < lo, 1)).alias("below"), F.count(F.when(F.col(key) == lo, 1)).alias("at")).first()
        need -= below["below"]
        if need == below["at"]:
            break
        tied = tied.where(F.col(key) == lo)
    return found


def upto(found: dict[str, int]) -> Column:
    """Rows that are not behind the cutoff."""
    taken = F.lit(True)
    for key, value in reversed(list(found.items())):
        taken = (F.col(key) < value) | ((F.col(key) == value) & taken)
    return taken


def resample(
    df: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), least_words: int = 20, width: int = 1, buckets: int = BUCKETS,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", seed: str = SEED,
) -> DataFrame:
    """One row per row of `df`: id_col, n_features, weight, score, and rank, which is null for rows that are not drawn."""
    keyed = scored(df, target, id_col, text_col, target_col, width, buckets, seed).select(
        "*", (-F.col("score")).alias("k_score"), F.coalesce("id", F.lit((1 << 63) - 1)).alias("k_id"), F.monotonically_increasing_id().alias("k_row"), (F.col("n_words") >= least_words).alias("enough")
    )
    rows = store(keyed, "op13-scores")
    able = rows.where("enough")
    take = share[0] * able.count() // share[1]
    keys = ["k_score", "k_id", "k_row"]
    drawn = F.col("enough") & (upto(cutoff(able, keys, take)) if take else F.lit(False))
    ranked = in_order(rows.where(drawn), keys, "rank", "op13-drawn")
    out = [F.col("id").alias(id_col), "n_features", "weight", "score"]
    return ranked.select(*out, "rank").unionByName(rows.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# The SQL works the checksum of each distinct word out bit by bit, eight steps a byte.
SQL = f"""
with words as (
  select doc_id, true as source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) as word from documents
  union all
  select null, false, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) from benchmark
), steps as (
  select word, list_transform(range(0, octet_length(encode(word)) * 8), lambda i: case when i % 8 = 0 then cast('0x' || substr(hex(encode(word)), 2 * (i // 8) + 1, 2) as bigint) else 0 end) as s
  from (select distinct word from words)
), hashed as (
  select word, xor(list_reduce(s, lambda c, b: case when xor(c, b) & 1 = 1 then xor(xor(c, b) >> 1, 3988292384) else xor(c, b) >> 1 end, 4294967295::bigint), 4294967295) % {BUCKETS} as bucket from steps
), placed as (select w.*, h.bucket from words w join hashed h using (word)),
counts as (
  select b.bucket, count(*) filter (where p.source) as s, count(*) filter (where not p.source) as t
  from (select unnest(range(0, {BUCKETS})) as bucket) b left join placed p on p.bucket = b.bucket group by b.bucket
), gain as (
  select bucket, cast(floor(1000 * ln((cast(t + 1 as double) * (sum(s) over () + {BUCKETS})) / (cast(s + 1 as double) * (sum(t) over () + {BUCKETS})))) as bigint) as g from counts
), summed as (
  select d.doc_id, count(g.bucket) as n_features, coalesce(sum(g.g), 0)::bigint as weight
  from documents d left join placed p on p.source and p.doc_id = d.doc_id left join gain g on g.bucket = p.bucket group by d.doc_id
), scores as (
  select *, weight + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) as bigint) + 0.5) / 4294967296.0::double))) as bigint) as score from summed
), ordered as (
  select *, row_number() over (order by (n_features < 20), score desc, doc_id) as place, count(*) filter (where n_features >= 20) over () as able from scores
)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= 10 * able // 100 then place end as rank from ordered
"""
