"""op1: exact Jaccard self-join of word n-grams by a token-group matrix.

1. Texts become sets of shingle hashes. Equal sets are one node.
2. Similar nodes are partitioned into groups: nodes that share a minimum
   hash are compared with one leader, and what links becomes one tied group;
   the other nodes that share all minimum hashes are a loose group.
3. The matrix holds, for each token, the groups whose union has it. Only a
   set's prefix under one global order (rare tokens first) is stored: sets
   that are similar enough share at least `SHARED` prefix tokens.
4. A query's prefix tokens bound its overlap with each group's union; a
   group is opened, and the query compared with its members in full, only
   if they share `SHARED` tokens or more and the sizes can match.

So every pair that may link either lies in one tied group or is compared in
full; no link is lost. Groups are opened in chunks of bounded size, and the
queries of a group are dealt over chunks of their own, so a task holds a chunk
of members and sees a chunk of queries. Of the
links found in a chunk, those between nodes that it has joined already are
not passed on, so a chunk never emits more links than it has nodes. The order uses
token counts of all rows, gathered in a sketch of fixed size; the counts
decide only the cost, not the result.

Tokens are 64-bit hashes, and a node is known by 64 bits of its set's
digest; a clash (chance about n * n / 2**65) could make one wrong link.

Defined results: a null or empty text has no shingle and links with
nothing. component_id is the smallest non-null doc_id (null only if all
are null). Repeated rows are in one class. A text of any length is read by
one task, in several bytes of memory a byte. An empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import boxed, discard, documents, gathered, lean, store, unboxed
from .words import mix, shingle_sets

SHARED, KEYS, CHUNK, QUERIES, SKETCH_BITS = 4, 3, 100_000, 2000, 18


def _sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))


def _digests(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, node, keys = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64), np.zeros((KEYS, batch.num_rows), np.int64)
            for i, x in shingle_sets(batch.column(2), width):
                n[i] = len(x)
                if len(x):
                    node[i] = int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
                    for k in range(KEYS):
                        keys[k, i] = mix(x ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).min().astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(node), *map(pa.array, keys)], ["id", "h", "n", "node", *(f"m{k}" for k in range(KEYS))])

    return rows


def _sketch(df: DataFrame, width: int) -> np.ndarray:
    """How often tokens of each of 2**SKETCH_BITS hash ranges occur in all rows."""
    size = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held, have = [], 0
            for _, x in shingle_sets(batch.column(2), width):
                held.append(x)
                have += len(x)
                if have > size:
                    total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=size)
                    held, have = [], 0
            if held:
                total += np.bincount(np.concatenate(held) >> np.uint64(64 - SKETCH_BITS), minlength=size)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total[found])], ["range", "n"])

    counts = df.mapInArrow(lean(count), "range int, n long").groupBy("range").agg(F.sum("n").alias("n"))
    counts, out = gathered(counts), np.zeros(size, np.int64)
    out[counts["range"]] = counts["n"]
    return out


def _prefixes(width: int, most: tuple[int, int], least: int, shared):
    """Rows (token, node) of every set's prefix: rare tokens first, then by hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            tokens, nodes = [], []
            for _, x in shingle_sets(batch.column(2), width):
                if len(x) < least:
                    continue
                node = int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True)
                keep = min(len(x), len(x) + (-len(x) * most[0] // most[1]) + SHARED)
                tokens.append(x[np.argsort(counts[x >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:keep]].astype(np.int64))
                nodes.append(np.full(keep, node, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], ["token", "node"])

    return rows


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (token, node) sorted by token, those of tokens that two nodes or more have.

    Of a token that goes on in the next batch, one row is held back at most."""
    last, shared, held = None, False, np.zeros(0, np.int64)
    for batch in batches:
        token, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(token):
            continue
        if last is not None and token[0] == last and len(held):
            token, node = np.append(last, token), np.append(held, node)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        differ = np.minimum.reduceat(node, starts) != np.maximum.reduceat(node, starts)
        differ[0] |= shared and token[0] == last
        keep = np.repeat(differ, np.diff(np.append(starts, len(token))))
        last, shared = token[-1], bool(differ[-1])
        held = node[-1:] if not shared else node[:0]
        yield pa.RecordBatch.from_arrays([pa.array(token[keep]), pa.array(node[keep])], ["token", "node"])


class OpenGroup:
    """Members of one chunk of a group, as one sorted token list."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.up: dict[int, int] = {}
        self.sets: list[np.ndarray] = []
        self.tokens = None

    def add(self, node: int, tokens: np.ndarray) -> None:
        self.nodes.append(node)
        self.sets.append(tokens)

    def root(self, node: int) -> int:
        while (up := self.up.get(node, node)) != node:
            self.up[node] = self.up.get(up, up)
            node = up
        return node

    def join(self, a: int, b: int) -> bool:
        """Whether a link joins two nodes that this chunk had not joined yet."""
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def linked(self, tokens: np.ndarray, most: tuple[int, int]) -> list[int]:
        """Members that share num / den of the union with a set of tokens."""
        if self.tokens is None:
            every = np.concatenate(self.sets) if self.sets else np.zeros(0, np.uint64)
            order = np.argsort(every, kind="stable")
            self.sizes = np.array([len(x) for x in self.sets], np.int64)
            self.tokens, self.member = every[order], np.repeat(np.arange(len(self.sets)), self.sizes)[order]
            self.sets = []
        lo, hi = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        both = np.bincount(self.member[at], minlength=len(self.sizes))
        found = np.flatnonzero((both * most[1] >= most[0] * (self.sizes + len(tokens) - both)) & (both > 0))
        return [self.nodes[i] for i in found.tolist()]


def _open(rows: DataFrame, width: int, most: tuple[int, int]) -> DataFrame:
    """Links (a, b) between the queries (role 1) and members (role 0) of each chunk (key, grp, chunk)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, OpenGroup()
        for batch in batches:
            key, grp, chunk, role, node = (batch.column(i).to_pylist() for i in range(5))
            a, b = [], []
            for i, tokens in shingle_sets(batch.column(5), width):
                if (here := (key[i], grp[i], chunk[i])) != now:
                    now, group = here, OpenGroup()
                if role[i] == 0:
                    group.add(node[i], tokens)
                else:
                    for x in group.linked(tokens, most):
                        if group.join(node[i], x):
                            a.append(node[i]), b.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    order = ["key", "grp", "chunk"]
    dealt = rows.select(*order, "role", "node", "text").repartition(*order).sortWithinPartitions(*order, "role", "node")
    return dealt.mapInArrow(lean(compare), "a long, b long")


def _texts(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, text for the nodes in `wanted` (node, id, h): the text of one row of each."""
    w = wanted.select("node", F.col("id").alias("_id"), F.col("h").alias("_h"))
    found = source.join(w, (source.h == w._h) & source.id.eqNullSafe(w._id)).select("node", "text")
    return found.dropDuplicates(["node"])  # repeated rows have the same text


def link_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, most: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of `df`: id, h (hash of the text), n (set size), class (a long; null without words)."""
    spark = df.sparkSession
    source = _sets(df, id_col, text_col)
    keys = ", ".join(f"m{k} long" for k in range(KEYS))
    rows = store(source.mapInArrow(lean(_digests(width)), f"id {source.schema['id'].dataType.simpleString()}, h long, n long, node long, {keys}"), "op1-rows")
    one = rows.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "h")).alias("row"), F.max("n").alias("n"), *[F.max(f"m{k}").alias(f"m{k}") for k in range(KEYS)])
    nodes = store(one.select("node", "row.id", "row.h", "n", *[f"m{k}" for k in range(KEYS)]), "op1-nodes")
    least = next(n for n in range(1, 1 << 20) if n * most[1] >= most[0] * (n + 1))  # a smaller set links only with its equals
    big = nodes.where(F.col("n") >= least)

    # groups: nodes with one minimum hash, compared with a leader
    keyed = big.select("node", "n", F.posexplode(F.array(*[f"m{k}" for k in range(KEYS)])).alias("key", "grp"))
    lead = F.when(F.col("key") % 2 == 0, F.min("node")).otherwise(F.max("node"))
    stars = keyed.groupBy("key", "grp").agg(lead.alias("leader"), F.count("*").alias("count"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks")).where("count > 1")
    stars = store(stars, "op1-stars")
    inside = store(keyed.join(stars, ["key", "grp"]).select("key", "grp", "node", "leader", "chunks"), "op1-inside")
    texts = store(_texts(source, nodes.join(inside.select("node").distinct(), "node")), "op1-texts")
    members = inside.where("node <> leader").select("key", "grp", F.pmod(F.xxhash64("node"), F.col("chunks").cast("long")).cast("int").alias("chunk"), F.lit(0).alias("role"), "node")
    leaders = stars.select("key", "grp", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("role"), F.col("leader").alias("node"))
    first = store(_open(members.unionByName(leaders).join(texts, "node"), width, most), "op1-first")
    discard(stars, inside, texts)

    # the matrix, and the groups that each query opens
    groups = components(first)
    counts = spark.sparkContext.broadcast(_sketch(source, width))
    prefix = source.mapInArrow(lean(_prefixes(width, most, least, counts)), "token long, node long").repartition("token").sortWithinPartitions("token")
    prefix = store(prefix.mapInArrow(lean(_shared), "token long, node long"), "op1-prefix")  # most tokens are met in one node only
    loose = F.xxhash64(*[f"m{k}" for k in range(KEYS)], F.lit("loose"))
    grouped = big.select("node", "id", "h", "n", *[f"m{k}" for k in range(KEYS)]).join(groups, "node", "left").select("node", "id", "h", "n", F.coalesce("comp", loose).alias("grp"), F.col("comp").isNotNull().alias("tied"))
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("count"), F.ceil(F.sum("n") / CHUNK).cast("int").alias("chunks"))
    grouped = store(grouped.join(sizes, "grp"), "op1-groups")
    ours = store(prefix.join(grouped.select("node", "n", "grp", "tied", "count"), "node"), "op1-tokens")
    discard(prefix, groups)
    matrix = store(ours.groupBy("token", "grp").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("count").alias("count")), "op1-matrix")
    own = (F.col("qgrp") == F.col("grp")) & ~F.col("tied") & (F.col("count") > 1)
    q = ours.select("token", F.col("node").alias("q"), F.col("n").alias("qn"), F.col("grp").alias("qgrp"), "tied", F.col("count").alias("qcount"))
    can = (own | (F.struct("qcount", "qgrp") < F.struct("count", "grp"))) & (F.col("qn") * most[1] >= F.col("low") * most[0]) & (F.col("high") * most[1] >= F.col("qn") * most[0])
    met = q.join(matrix, "token").where(can).groupBy("q", "grp").agg(F.count_distinct("token").alias("met"))
    opened = store(met.where(F.col("met") >= SHARED).select("q", "grp"), "op1-opened")
    discard(ours, matrix)
    second = first.limit(0)
    if not opened.isEmpty():
        asked = store(opened.groupBy("grp").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "op1-asked")
        wide = store(opened.join(asked, "grp").join(grouped.select("grp", "chunks").distinct(), "grp"), "op1-wide")
        dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n).cast("long")).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        ask = wide.withColumnRenamed("q", "node").withColumn("own", dealt("parts")).withColumn("chunk", every("chunks")).withColumn("role", F.lit(1))
        shown = grouped.join(asked, "grp").withColumn("chunk", dealt("chunks")).withColumn("own", every("parts")).withColumn("role", F.lit(0))
        ask, shown = (x.select(F.lit(0).alias("key"), "grp", (F.col("chunk") * F.col("parts") + F.col("own")).alias("chunk"), "role", "node") for x in (ask, shown))
        ask = store(ask.unionByName(shown), "op1-ask")
        texts = store(_texts(source, nodes.join(ask.select("node").distinct(), "node")), "op1-texts")
        second = store(_open(ask.join(texts, "node"), width, most), "op1-second")
        discard(asked, wide, ask, texts)
    final = components(first.unionByName(second))
    classes = rows.select("id", "h", "n", "node").join(final, "node", "left").select("id", "h", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("class"))
    classes = store(classes, "op1-classes")
    discard(rows, nodes, grouped, opened, first, final)
    return classes


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, most: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per row of `df`: id_col, n_shingles, component_id."""
    rows = link_classes(df, id_col, text_col, width, most)
    low = store(rows.where("class is not null").groupBy("class").agg(F.min("id").alias("component_id")), "op1-low")
    found = rows.join(low, "class", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, most: tuple[int, int] = (80, 100)) -> DataFrame:
    """The rows of `df` that stay, one of each class (that of the smallest id) and all without words, with all columns."""
    rows = link_classes(df, id_col, text_col, width, most)
    low = rows.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("id").isNull(), "id", "h")).alias("row"))
    kept = low.select(F.col("row.id").alias("kept_id"), F.col("row.h").alias("kept_h"), F.lit(True).alias("one"))
    wordless = rows.where("class is null").select(F.col("id").alias("kept_id"), F.col("h").alias("kept_h"), F.lit(False).alias("one")).distinct()
    kept = store(kept.unionByName(wordless), "op1-kept")  # a text with words and one without have different hashes
    found = boxed(df, id=F.col(id_col), h=F.xxhash64(text_col)).join(kept, F.col("h").eqNullSafe(F.col("kept_h")) & F.col("id").eqNullSafe(F.col("kept_id")))
    discard(rows)
    order = Window.partitionBy("kept_h", "kept_id").orderBy(F.lit(1))
    return unboxed(found.withColumn("n", F.when(F.col("one"), F.row_number().over(order)).otherwise(1)).where("n = 1"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3, most=(90, 100))
