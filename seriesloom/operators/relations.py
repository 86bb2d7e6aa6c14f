"""Pairwise measures between series, windows and classes.

Pairs come from a self-join on position inside a series set (an equi-join),
never from comparing all rows; lags are bounded and sums combine early."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order_statistics import by_keys, quantiles_of
from .scans import chunked


def aligned_pairs(long: DataFrame, series: str, pos: str, value: str, scaled: bool = False) -> DataFrame:
    """(a, b, pos, x, y) of all pairs of series at shared positions, a < b; positions with a null go."""
    rows = long.where(F.col(value).isNotNull())
    if scaled:
        w = Window.partitionBy(series)
        rows = rows.withColumn(value, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_pop(value).over(w)))
    left = rows.select(F.col(series).alias("a"), F.col(pos).alias("pos"), F.col(value).alias("x"))
    right = rows.select(F.col(series).alias("b"), F.col(pos).alias("pos"), F.col(value).alias("y"))
    return left.join(right, "pos").where("a < b")


def cross_correlation(long: DataFrame, series: str, pos: str, value: str, lags: int, both_ways: bool = False) -> DataFrame:
    """(a, b, lag, cc): centred products of a at pos with b at pos + lag, over the root of both energies."""
    w = Window.partitionBy(series)
    rows = long.withColumn("_c", F.col(value) - F.avg(value).over(w)).withColumn("_e", F.sum(F.col("_c") * F.col("_c")).over(w))
    left = rows.select(F.col(series).alias("a"), F.col(pos).alias("pos"), F.col("_c").alias("x"), F.col("_e").alias("ea"), F.explode(F.sequence(F.lit(-lags if both_ways else 1), F.lit(lags))).alias("lag"))
    right = rows.select(F.col(series).alias("b"), F.col(pos).alias("_p"), F.col("_c").alias("y"), F.col("_e").alias("eb"))
    met = left.withColumn("_p", F.col("pos") + F.col("lag")).join(right, "_p").where("a < b" if both_ways else "a <> b")
    return met.groupBy("a", "b", "lag").agg(F.try_divide(F.sum(F.col("x") * F.col("y")), F.sqrt(F.max("ea") * F.max("eb"))).alias("cc"))


def strongest_lag(cc: DataFrame) -> DataFrame:
    """The lag of greatest absolute correlation; the smallest of ties."""
    best = F.max(F.struct(F.round(F.abs("cc"), 9).alias("s"), (-F.abs("lag")).alias("n"), F.col("lag").alias("lag"), F.col("cc").alias("cc")))
    return cc.groupBy("a", "b").agg(best.alias("_m")).select("a", "b", "_m.lag", "_m.cc")


def binned(long: DataFrame, series: str, value: str, bins: int) -> Column:
    """Bin 0 .. bins - 1 of equal width over the series' range."""
    w = Window.partitionBy(series)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(value) - low) * bins, high - low), F.lit(0.0)))).cast("int")


def mutual_information(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """Per (a, b): mutual information in bits, both entropies in bits, and the share of the smaller entropy."""
    joint = pairs.groupBy("a", "b", x, y).agg(F.count("*").alias("n"))
    all_, of_x, of_y = Window.partitionBy("a", "b"), Window.partitionBy("a", "b", x), Window.partitionBy("a", "b", y)
    p = joint.withColumn("t", F.sum("n").over(all_)).withColumn("nx", F.sum("n").over(of_x)).withColumn("ny", F.sum("n").over(of_y))
    mi = F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    hx, hy = (-F.sum(F.col("n") / F.col("t") * F.log2(F.col(c) / F.col("t"))) for c in ("nx", "ny"))
    out = p.groupBy("a", "b").agg(mi.alias("mi"), hx.alias("hx"), hy.alias("hy"))
    return out.withColumn("nmi", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("mi", F.least("hx", "hy")), F.lit(0.0)))))


def transfer_entropy(rows: DataFrame, keys: list[str], x: str, y: str, order: str, lag: int = 1) -> DataFrame:
    """From binned columns: H(Y | Y before) - H(Y | Y before, X before), over H(Y)."""
    c = chunked(rows, keys, [order], before=lag)
    r = c.rows.select(*keys, "_own", F.col(y).alias("y"), F.lag(y, lag).over(c.window).alias("yp"), F.lag(x, lag).over(c.window).alias("xp")).where("_own").drop("_own").dropna()
    g = r.groupBy(*keys, "y", "yp", "xp").agg(F.count("*").alias("n"))
    sums = {"t": [], "ny": ["y"], "nyp": ["yp"], "nyyp": ["y", "yp"], "nypxp": ["yp", "xp"]}
    for name, by in sums.items():
        g = g.withColumn(name, F.sum("n").over(Window.partitionBy(*keys, *by)))
    p = F.col("n") / F.col("t")
    te = F.sum(p * F.log2(F.col("n") * F.col("nyp") / (F.col("nypxp") * F.col("nyyp"))))
    h = -F.sum(p * F.log2(F.col("ny") / F.col("t")))
    return g.groupBy(*keys).agg(te.alias("te"), h.alias("h")).withColumn("te", F.coalesce(F.try_divide("te", "h"), F.lit(0.0))).drop("h")


def quantile_binned(long: DataFrame, series: str, value: str, bins: int) -> DataFrame:
    """`long` with bin 0 .. bins - 1 between the series' exact quantiles of equal shares; a value on an edge goes up, so repeated edges leave bins empty."""
    shares = {f"_q{i}": i / bins for i in range(1, bins)}
    placed = by_keys(long, quantiles_of(long, [series], value, shares), [series])
    edges = F.array(*shares)
    return placed.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col(value)))).drop(*shares)


def bin_counts(long: DataFrame, series: str, value: str, most: int, least_rows: int = 1) -> DataFrame:
    """(series, bins): the greatest number of equal-width bins, from `most` down to 2, of which two or more have rows and none that has rows has fewer than `least_rows`.

    All numbers of bins are tried in one job: each value is counted once for each of them."""
    ends = long.groupBy(series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    each = by_keys(long.select(series, value), ends, [series]).withColumn("bins", F.explode(F.sequence(F.lit(2), F.lit(most))))
    counts = each.groupBy(series, "bins", width_bin(F.col(value), F.col("_lo"), F.col("_hi"), F.col("bins")).alias("_bin")).agg(F.count("*").alias("_n"))
    good = counts.groupBy(series, "bins").agg(F.count("*").alias("_k"), F.min("_n").alias("_least")).where((F.col("_k") > 1) & (F.col("_least") >= least_rows))
    return ends.select(series).join(good.groupBy(series).agg(F.max("bins").alias("bins")), series, "left").withColumn("bins", F.coalesce("bins", F.lit(2)))


def width_bin(value: Column, low: Column, high: Column, bins: Column) -> Column:
    return F.least(bins - 1, F.floor(F.coalesce(F.try_divide((value - low) * bins, high - low), F.lit(0.0)))).cast("int")


def transfer_tasks(long: DataFrame, series: str, pos: str, value: str, lags: list[int], bins: int, targets: list | None = None, least_rows: int = 1) -> DataFrame:
    """(source, target, lag, te, bins) of all tasks of a profile, in one plan: every ordered pair of series, or those with a target among `targets` on either side.

    Each series has the greatest number of equal-width bins that leaves no used bin under `least_rows`; a task takes the smaller number of its two series. The entropy transferred from
    the source's value `lag` positions back, given the target's one position back, is divided by the entropy of the target. A task
    uses the positions from the series' start by its larger lag on at which all three values are known. Values travel once for each number of bins, not for each pair."""
    sizes = bin_counts(long, series, value, bins, least_rows)
    ends = long.groupBy(series).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    partners = (sizes if targets is None else sizes.where(F.col(series).isin(targets))).agg(F.collect_list(F.struct(F.col(series).alias("s"), F.col("bins").alias("k"))).alias("_o"))  # the columns of one profile, in one row
    pairs = sizes.join(F.broadcast(partners)).select(F.col(series).alias("source"), F.col("bins").alias("_s"), F.explode("_o").alias("_o")).select("source", F.col("_o.s").alias("target"), "_s", F.col("_o.k").alias("_t"))
    pairs = pairs.unionByName(pairs.select(F.col("target").alias("source"), F.col("source").alias("target"), F.col("_t").alias("_s"), F.col("_s").alias("_t"))).where("source <> target").distinct()
    tasks = pairs.select("source", "target", F.least("_s", "_t").alias("bins")).withColumn("lag", F.explode(F.array(*map(F.lit, lags))))
    used = tasks.select(F.col("source").alias(series), "bins").unionByName(tasks.select(F.col("target").alias(series), "bins")).distinct()
    coded = long.select(series, pos, value).join(ends, series).join(used, series).select(series, "bins", F.col(pos).alias("_p"), width_bin(F.col(value), F.col("_lo"), F.col("_hi"), F.col("bins")).alias("_b"))
    now = coded.select(F.col(series).alias("target"), "bins", "_p", F.col("_b").alias("y"))
    before = coded.select(F.col(series).alias("target"), "bins", (F.col("_p") + 1).alias("_p"), F.col("_b").alias("yp"))
    states = tasks.join(now.join(before, ["target", "bins", "_p"]), ["target", "bins"]).withColumn("_q", F.col("_p") - F.col("lag"))
    past = coded.select(F.col(series).alias("source"), "bins", F.col("_p").alias("_q"), F.col("_b").alias("xp"))
    met = states.join(past, ["source", "bins", "_q"]).groupBy("source", "target", "lag", "bins", "y", "yp", "xp").agg(F.count("*").alias("n"))
    keys = ["source", "target", "lag", "bins"]
    for name, by in {"t": [], "ny": ["y"], "nyp": ["yp"], "nyyp": ["y", "yp"], "nypxp": ["yp", "xp"]}.items():
        met = met.withColumn(name, F.sum("n").over(Window.partitionBy(*keys, *by)))  # states of a task, at most bins ** 3
    p = F.col("n") / F.col("t")
    te, h = F.sum(p * F.log2(F.col("n") * F.col("nyp") / (F.col("nypxp") * F.col("nyyp")))), -F.sum(p * F.log2(F.col("ny") / F.col("t")))
    out = met.groupBy(*keys).agg(te.alias("te"), h.alias("_h"))
    return out.select("source", "target", "lag", F.coalesce(F.try_divide("te", "_h"), F.lit(0.0)).alias("te"), "bins")


def best_lags(tasks: DataFrame) -> DataFrame:
    """(source, target, lag, te): the lag of most transferred entropy, the smallest of ties; lag 1 and 0 where none transfers any."""
    best = tasks.groupBy("source", "target").agg(F.max(F.struct(F.round("te", 9).alias("r"), (-F.col("lag")).alias("l"), "te")).alias("_m"))
    some = F.col("_m.r") > 0
    return best.select("source", "target", F.when(some, -F.col("_m.l")).otherwise(1).alias("lag"), F.when(some, F.col("_m.te")).otherwise(0.0).alias("te"))


def granger(rows: DataFrame, keys: list[str], x: str, y: str, order: str, lags: int = 5) -> DataFrame:
    """Share of the residual sum of squares of an autoregression of y that lags of x remove, 0 .. 1.

    Lag products are summed in Spark; one small system per series is solved in a pandas UDF."""
    c = chunked(rows, keys, [order], before=lags)
    w = c.window
    names = ["1", *[f"y{k}" for k in range(1, lags + 1)], *[f"x{k}" for k in range(1, lags + 1)]]
    cols = [F.lit(1.0).alias("1"), *[F.lag(y, k).over(w).alias(f"y{k}") for k in range(1, lags + 1)], *[F.lag(x, k).over(w).alias(f"x{k}") for k in range(1, lags + 1)]]
    m = c.rows.select(*keys, "_own", F.col(y).cast("double").alias("_y"), *cols).where("_own").drop("_own").dropna()
    gram = [F.sum(F.col(f"`{a}`") * F.col(f"`{b}`")) for a in names for b in names]
    cross = [F.sum(F.col(f"`{a}`") * F.col("_y")) for a in names]
    sums = m.groupBy(*keys).agg(F.array(*gram).alias("g"), F.array(*cross).alias("c"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    n, short = len(names), lags + 1

    @F.pandas_udf("double")
    def solve(g: pd.Series, c: pd.Series, yy: pd.Series) -> pd.Series:
        out = []
        for gi, ci, t in zip(g, c, yy, strict=True):
            G, C = np.array(gi, float).reshape(n, n), np.array(ci, float)
            rss = [t - C[:k] @ np.linalg.lstsq(G[:k, :k], C[:k], rcond=None)[0] for k in (short, n)]
            out.append(min(1.0, max(0.0, 1 - rss[1] / rss[0])) if rss[0] > 0 else 0.0)
        return pd.Series(out)

    return sums.select(*keys, solve("g", "c", "yy").alias("score"))


def covariance(long: DataFrame, series: str, pos: str, value: str) -> DataFrame:
    """(a, b, covariance) of series that are each standardized over all their own positions, at the positions that both have."""
    return aligned_pairs(long, series, pos, value, scaled=True).groupBy("a", "b").agg(F.covar_pop("x", "y").alias("covariance"))


def pair_distance(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.corr("x", "y").alias("pearson"), F.sqrt(F.sum(F.pow(F.col("x") - F.col("y"), 2))).alias("euclidean"), F.count("*").alias("n"))


# --- vectors ---

ZIP = F.zip_with


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine, euclidean, cityblock, chebyshev or correlation distance of two arrays."""
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    wide = lambda arr: F.transform(arr, lambda v: v.cast("double"))
    a, b = wide(a), wide(b)
    if metric == "correlation":
        ma, mb = add(a) / F.size(a), add(b) / F.size(b)
        return distance(F.transform(a, lambda v: v - ma), F.transform(b, lambda v: v - mb), "cosine")
    if metric == "cosine":
        dot, na, nb = add(ZIP(a, b, lambda x, y: x * y)), add(F.transform(a, lambda x: x * x)), add(F.transform(b, lambda x: x * x))
        return 1 - F.coalesce(F.try_divide(dot, F.sqrt(na) * F.sqrt(nb)), F.lit(0.0))
    gap = ZIP(a, b, lambda x, y: F.abs(x - y))
    if metric == "chebyshev":
        return F.array_max(gap)
    if metric == "cityblock":
        return add(gap)
    return F.sqrt(add(F.transform(gap, lambda g: g * g)))


def nearest(vectors: DataFrame, vector: str, query: list[float], metric: str, n: int, ident: str) -> DataFrame:
    """The n rows nearest to one query vector."""
    d = distance(F.col(vector), F.array(*[F.lit(float(q)) for q in query]), metric)
    return vectors.withColumn("distance", d).orderBy("distance", ident).limit(n)


METRICS = ("cosine", "euclidean", "cityblock", "chebyshev", "correlation")


def block_distances(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Distances of each query to each vector, one query at a time."""
    if metric in ("cosine", "correlation"):
        shift = metric == "correlation"
        a, b = (x - x.mean(axis=1, keepdims=True) if shift else x for x in (queries, vectors))
        norms = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
        return 1 - np.divide(a @ b.T, norms, out=np.zeros_like(norms), where=norms > 0)
    out = np.empty((len(queries), len(vectors)))
    for i, q in enumerate(queries):
        gap = np.abs(vectors - q)
        out[i] = {"euclidean": lambda g: np.sqrt((g * g).sum(axis=1)), "cityblock": lambda g: g.sum(axis=1), "chebyshev": lambda g: g.max(axis=1)}[metric](gap)
    return out


def _squares(queries: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared Euclidean distances by one matrix product, and for each query how far they may be off."""
    a, b = (queries * queries).sum(axis=1), (vectors * vectors).sum(axis=1)
    return a[:, None] + b[None, :] - 2 * (queries @ vectors.T), 1e-12 * (a + b.max())


def _exact(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Euclidean distances of some pairs from their differences."""
    parts = [((queries[row[i : i + 65536]] - vectors[column[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(row), 65536)]
    return np.sqrt(np.concatenate(parts)) if parts else np.zeros(0)


def _least(cost: np.ndarray, slack: np.ndarray | float, ids: np.ndarray, k: int, exact=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cost) of the k least finite costs of each row, ties by id. With exact(rows, columns), `cost` is known to `slack` only and what may be among the k is looked at again."""
    k = min(k, cost.shape[1])
    edge = np.partition(cost, k - 1, axis=1)[:, k - 1] + 2 * slack
    row, column = np.nonzero((cost <= edge[:, None]) & np.isfinite(cost))
    value = cost[row, column] if exact is None else exact(row, column)
    order = np.lexsort((ids[column], value, row))
    row, column, value = row[order], column[order], value[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
    return row[kept], column[kept], value[kept]


def _blocks(rows: DataFrame, ident: str, vector: str, size: int, block: str, packed: str) -> DataFrame:
    """Blocks of up to `size` rows, by their order inside a partition."""
    dealt = rows.select(ident, vector, F.monotonically_increasing_id().alias("_n"))
    return dealt.groupBy(F.floor(F.col("_n") / size).alias(block)).agg(F.collect_list(F.struct(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))).alias(packed))


NEAR = "metric string, q long, id long, distance double"


def _solver(metrics: tuple[str, ...], k: int, apart: bool):
    """A function for mapInArrow from pairs of blocks (queries, vectors) to the k nearest of each query in each pair."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, v in zip(batch.column(0), batch.column(1), strict=True):
                (qid, qv), (vid, vv) = ((x.values.field(0).to_numpy(), np.stack(x.values.field(1).to_numpy(zero_copy_only=False))) for x in (q, v))
                out = []
                for metric in metrics:
                    euclid = metric == "euclidean"
                    d, slack = _squares(qv, vv) if euclid else (block_distances(qv, vv, metric), 0.0)
                    if apart:
                        d[qid[:, None] == vid[None, :]] = np.inf
                    row, column, value = _least(d, slack, vid, k, (lambda i, j: _exact(qv, vv, i, j)) if euclid else None)
                    out.append((np.full(len(row), metric, object), qid[row], vid[column], value))
                m, a, b, c = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(m, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["metric", "q", "id", "distance"])

    return solve


def nearest_by_metrics(queries: DataFrame, corpus: DataFrame, metrics: tuple[str, ...], k: int, size: int = 512, apart: bool = False) -> DataFrame:
    """(metric, q, id, distance, place): the k nearest corpus vectors (id, vector) of each query (q, query) by each metric, ties by id; `apart` leaves out the query itself.

    Queries and corpus are dealt into blocks of up to `size` rows. A corpus block is sent to each query block, the pair is worked out as one matrix,
    and k rows a query and metric are kept before the shuffle. Ids are whole numbers."""
    asked = _blocks(queries, "q", "query", size, "_qb", "_queries")
    asked = asked.withColumn("_qb", F.pmod(F.xxhash64("_qb"), F.lit(1 << 31)).cast("long"))
    names = asked.agg(F.collect_set("_qb").alias("_all"))  # one number a block
    held = _blocks(corpus, "id", "vector", size, "_cb", "_vectors").join(F.broadcast(names)).withColumn("_qb", F.explode("_all")).drop("_all", "_cb")  # one row

    best = held.join(asked, "_qb").select("_queries", "_vectors").mapInArrow(_solver(metrics, k, apart), NEAR)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("metric", "q").orderBy("distance", "id"))).where(F.col("place") <= k)


def nearest_of(queries: DataFrame, corpus: DataFrame, metric: str = "euclidean", k: int = 1, size: int = 512) -> DataFrame:
    """(q, id, distance, place): the k nearest corpus vectors of each query, with ties by id."""
    return nearest_by_metrics(queries, corpus, (metric,), k, size).drop("metric")


def tiled_relations(rows: DataFrame, ident: str, parts: list[tuple[str, str, float]], k: int, how: str = "sum", size: int = 4096) -> DataFrame:
    """(a, b, score, place): of each row, the k others of greatest relation; scores that agree to 12 decimals tie, ties by id. Ids are whole numbers; a row without one of the vectors takes no part.

    A relation is the sum, or the product, of weight * similarity over `parts` (column, metric, weight): 1 - distance for cosine and correlation, minus the distance
    for the others. Rows are dealt by hash into blocks of about `size`; a tile is a pair of blocks, each pair once, worked out as matrices, a slice at a time,
    in one task, which passes on k rows a row of either block: no row is made for a pair. Tiles do not depend on each other, so a lost one is worked out again by itself.
    Block i meets the blocks i, i + 1, .. up to half way round, so all have about as many tiles."""
    columns = [c for c, _, _ in parts]
    known = rows.dropna(subset=columns).select(F.col(ident).cast("long").alias("id"), *[F.col(c).cast("array<double>").alias(c) for c in dict.fromkeys(columns)])
    n = max(1, -(-known.count() // size))
    blocks = known.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias("_b")).agg(F.collect_list(F.struct("*")).alias("_rows"))
    far = F.when(F.col("_b") < n // 2, n // 2).otherwise((n - 1) // 2)  # of two blocks that face each other, one has the tile
    others = blocks.select(F.col("_rows").alias("_right"), F.col("_b").alias("_mine"), F.explode(F.sequence(F.lit(0), far)).alias("_d")).select("_right", (F.col("_d") == 0).alias("_same"), F.pmod(F.col("_mine") + F.col("_d"), F.lit(n)).alias("_b"))

    def matrix(cells: pa.StructArray, column: str) -> np.ndarray:
        return np.stack(cells.field(cells.type.get_field_index(column)).to_numpy(zero_copy_only=False))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                a, b = left.values, right.values
                ida, idb = a.field(0).to_numpy(), b.field(0).to_numpy()
                va, vb = ([matrix(x, column) for column in columns] for x in (a, b))
                out, back = [], []
                for at in range(0, len(ida), 1024):
                    ids, mine = ida[at : at + 1024], [v[at : at + 1024] for v in va]
                    terms, slack = [], 1e-11
                    for x, y, (_, metric, weight) in zip(mine, vb, parts, strict=True):
                        if metric == "euclidean" and how == "sum":  # by a product; what may be among the k is looked at again
                            d, off = _squares(x, y)
                            d, slack = np.sqrt(np.maximum(d, 0.0)), slack + abs(weight) * np.sqrt(off.max())
                        else:
                            d = block_distances(x, y, metric)
                        terms.append(weight * (1 - d if metric in ("cosine", "correlation") else -d))
                    score = sum(terms) if how == "sum" else np.prod(terms, axis=0)
                    score[ids[:, None] == idb[None, :]] = -np.inf

                    def exact(i: np.ndarray, j: np.ndarray, terms=terms, mine=mine) -> np.ndarray:
                        each = [-w * _exact(x, y, i, j) if metric == "euclidean" and how == "sum" else t[i, j] for t, x, y, (_, metric, w) in zip(terms, mine, vb, parts, strict=True)]
                        return -np.round(sum(each) if how == "sum" else np.prod(each, axis=0), 12)

                    i, j, cost = _least(-score, slack, idb, k, exact)
                    out.append((ids[i], idb[j], -cost))
                    if not same:
                        i, j, cost = _least(-score.T, slack, ids, k, lambda i, j, exact=exact: exact(j, i))
                        back.append((idb[i], ids[j], -cost))
                if back:
                    x, y, z = (np.concatenate(c) for c in zip(*back, strict=True))
                    order = np.lexsort((y, -z, x))
                    kept = order[np.arange(len(x)) - np.searchsorted(x[order], x[order], "left") < k]
                    out.append((x[kept], y[kept], z[kept]))
                x, y, z = (np.concatenate(c) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.float64())], ["a", "b", "score"])

    found = blocks.join(others, "_b").select("_rows", "_right", "_same").mapInArrow(solve, "a long, b long, score double")
    return found.withColumn("place", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))).where(F.col("place") <= k)


def series_vectors(long: DataFrame, series: str, pos: str, value: str, length: int) -> DataFrame:
    """(series, vector): the values of the positions 0 .. length - 1 as one array a series, 0 where there is none."""
    held = F.map_from_entries(F.collect_list(F.struct(F.col(pos).cast("int"), F.col(value).cast("double"))))  # `length` entries at most
    one = long.where(F.col(pos).between(0, length - 1)).groupBy(series).agg(held.alias("_m"))
    return one.select(series, F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector"))


def merged_window_relations(windows: DataFrame, window_edges: DataFrame, dataset_edges: DataFrame, how: str = "prod", weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """(a, b, window, dataset, merged) of windows (id, dataset) that an edge (a, b, share) joins and whose datasets are related by an edge (a, b, score): the product of both,
    or weights[0] * dataset + weights[1] * window. Edges of datasets hold both ways; windows of one dataset are related by 1. A pair without an edge of either kind has no row."""
    of = lambda side: windows.select(F.col("id").alias(side), F.col("dataset").alias(f"_d{side}"))
    met = window_edges.select("a", "b", F.col("share").alias("window")).join(of("a"), "a").join(of("b"), "b")
    both = dataset_edges.select(F.col("a").alias("_da"), F.col("b").alias("_db"), F.col("score").alias("dataset"))
    both = both.unionByName(both.select(F.col("_db").alias("_da"), F.col("_da").alias("_db"), "dataset"))
    own = met.where("_da = _db").withColumn("dataset", F.lit(1.0))
    found = met.where("_da <> _db").join(both, ["_da", "_db"]).unionByName(own)
    merged = F.col("dataset") * F.col("window") if how == "prod" else weights[0] * F.col("dataset") + weights[1] * F.col("window")
    return found.select("a", "b", "window", "dataset", merged.alias("merged"))


def fit_lists(corpus: DataFrame, lists: int = 64, per_list: int = 64, rounds: int = 8) -> np.ndarray:
    """Centres of an inverted file: k-means over a sample of at most lists * per_list vectors, those whose hashes of ids are smallest. Fewer vectors than lists make fewer centres."""
    sample = corpus.where(F.col("vector").isNotNull()).select("id", F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("id"), "id").limit(lists * per_list).toArrow()
    if not sample.num_rows:
        return np.zeros((0, 0))
    x = np.stack(sample.column("vector").to_numpy())
    centres = x[: min(lists, len(x))].copy()
    for _ in range(rounds):
        nearest = ((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]).argmin(1)
        for j in range(len(centres)):
            if (nearest == j).any():
                centres[j] = x[nearest == j].mean(0)
    return centres


def _listed(rows: DataFrame, ident: str, vector: str, centres: np.ndarray, choose, extra: str | None = None) -> DataFrame:
    """(_list, ident, vector, _gap): each row once for every list that choose(distances to the centres, extra) marks, with its distance to the centre."""
    kinds = f"_list int, {ident} long, {vector} array<double>, _gap double"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
            gap = np.stack([np.sqrt(((centres - v) ** 2).sum(1)) for v in x])
            row, one = np.nonzero(choose(gap, batch.column(2).to_numpy(zero_copy_only=False) if extra else None))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(one, pa.int32()), batch.column(0).take(taken), batch.column(1).take(taken), pa.array(gap[row, one])], ["_list", ident, vector, "_gap"])

    known = rows.where(F.col(vector).isNotNull())
    return known.select(F.col(ident).cast("long").alias(ident), F.col(vector).cast("array<double>").alias(vector), *([extra] if extra else [])).mapInArrow(place, kinds)


def _list_blocks(listed: DataFrame, ident: str, vector: str, parts: list[int], packed: str) -> DataFrame:
    """The rows of each list in so many parts, dealt by hash."""
    dealt = listed.select("_list", F.struct(F.col(ident).alias("id"), F.col(vector).alias("vector")).alias("_v"), F.pmod(F.xxhash64(ident), F.get(F.lit(parts), F.col("_list"))).alias("_b"))
    return dealt.groupBy("_list", "_b").agg(F.collect_list("_v").alias(packed))


def nearest_in_lists(queries: DataFrame, corpus: DataFrame, k: int = 1, centres: np.ndarray | None = None, probes: int = 4, exact: bool = True, size: int = 512, held_size: int = 4096) -> DataFrame:
    """(q, id, distance, place): the k corpus vectors (id, vector) of least Euclidean distance of each query (q, query), ties by id, by an inverted file.

    Every vector is in the list of its nearest centre. A query first looks into its `probes` nearest lists. That is all without `exact`; else the distance d of its k-th find
    bounds the rest: a list may hold a nearer vector only if its centre is within d plus the list's radius, and
    those lists are looked into as well, so the result is that of comparing all. Only blocks of the same list meet: about `size` queries and `held_size` vectors,
    however many lists the rows next to each other go to. Rows without a vector take no part."""
    centres = fit_lists(corpus) if centres is None else centres
    n = len(centres)
    if not n:
        return queries.sparkSession.createDataFrame([], "q long, id long, distance double, place int")

    def among(gap: np.ndarray, most: int) -> np.ndarray:
        chosen = np.zeros(gap.shape, bool)
        np.put_along_axis(chosen, np.argsort(gap, axis=1, kind="stable")[:, : min(most, n)], True, axis=1)
        return chosen

    held = _listed(corpus, "id", "vector", centres, lambda gap, _: among(gap, 1))
    radius, parts = np.full(n, -np.inf), [1] * n
    for r in held.groupBy("_list").agg(F.max("_gap").alias("r"), F.count("*").alias("n")).collect():  # a row per list
        radius[r["_list"]], parts[r["_list"]] = r["r"], -(-r["n"] // held_size)
    blocks = _list_blocks(held, "id", "vector", parts, "_vectors")
    asked_parts = [max(1, -(-queries.count() // size))] * n  # a list is asked by each query once at most

    def search(asked: DataFrame) -> DataFrame:
        those = _list_blocks(asked, "q", "query", asked_parts, "_queries").drop("_b").withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.get(F.lit(parts), F.col("_list")).cast("long") - 1)))
        met = those.join(blocks, ["_list", "_b"]).select("_queries", "_vectors").mapInArrow(_solver(("euclidean",), k, False), NEAR)
        return met.select("q", "id", "distance")

    w = Window.partitionBy("q").orderBy("distance", "id")
    first = search(_listed(queries, "q", "query", centres, lambda gap, _: among(gap, probes)))
    best = first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    if not exact:
        return best
    bound = best.groupBy("q").agg(F.max("distance").alias("_d"), F.count("*").alias("_k")).select("q", F.when(F.col("_k") >= k, F.col("_d")).alias("_d"))
    asked = queries.join(bound, "q", "left").withColumn("_d", F.coalesce("_d", F.lit(float("inf"))))

    def open_(gap: np.ndarray, d: np.ndarray) -> np.ndarray:
        slack = 1e-9 * (1 + gap)  # for what is rounded in either distance
        return (gap - radius[None, :] <= d[:, None] + slack) & ~among(gap, probes)

    more = search(_listed(asked, "q", "query", centres, open_, "_d"))
    return best.drop("place").unionByName(more).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def grouped_distances(queries: DataFrame, corpus: DataFrame, size: int = 512) -> DataFrame:
    """(ci, cj, mean): the mean Euclidean distance of the queries (ci, query) of each class to the vectors (cj, vector) of each class.

    Blocks of the corpus meet the blocks of the queries as in `nearest_by_metrics`; a pair of blocks passes on sums only."""
    asked = queries.select("ci", "query", F.monotonically_increasing_id().alias("_n")).groupBy("ci", F.floor(F.col("_n") / size).alias("_qb")).agg(F.collect_list(F.col("query").cast("array<double>")).alias("_queries"))
    asked = asked.withColumn("_qb", F.pmod(F.xxhash64("ci", "_qb"), F.lit(1 << 31)).cast("long"))
    names = asked.agg(F.collect_set("_qb").alias("_all"))  # one number a block
    held = corpus.select("cj", "vector", F.monotonically_increasing_id().alias("_n")).groupBy("cj", F.floor(F.col("_n") / size).alias("_cb")).agg(F.collect_list(F.col("vector").cast("array<double>")).alias("_vectors"))
    met = held.join(F.broadcast(names)).withColumn("_qb", F.explode("_all")).join(asked, "_qb").select("ci", "cj", "_queries", "_vectors")  # one row

    @F.pandas_udf("sum double, n long")
    def sums(q: pd.Series, v: pd.Series) -> pd.DataFrame:
        pairs = [block_distances(np.stack(a), np.stack(b), "euclidean") for a, b in zip(q, v, strict=True)]
        return pd.DataFrame({"sum": [d.sum() for d in pairs], "n": [d.size for d in pairs]})

    each = met.withColumn("_s", sums("_queries", "_vectors"))
    return each.groupBy("ci", "cj").agg((F.sum("_s.sum") / F.sum("_s.n")).alias("mean"))


def class_pairs(classes: DataFrame, label: str, vector: str) -> DataFrame:
    """(a, b, va, vb): all pairs of classes, as each class against a list of all; a class table has one row a class, which is checked to be at most 10,000."""
    every = classes.agg(F.collect_list(F.struct(F.col(label).alias("b"), F.col(vector).alias("vb"))).alias("_all"))
    every = every.select(F.when(F.size("_all") > 10_000, F.raise_error(F.lit("more than 10,000 classes"))).otherwise(F.col("_all")).alias("_all"))
    return classes.select(F.col(label).alias("a"), F.col(vector).alias("va")).join(F.broadcast(every)).withColumn("_p", F.explode("_all")).select("a", "va", "_p.b", "_p.vb")  # one row


def centroids(vectors: DataFrame, vector: str, label: str) -> DataFrame:
    each = vectors.select(label, F.posexplode(vector).alias("_i", "_v")).groupBy(label, "_i").agg(F.avg("_v").alias("_m"))
    return each.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda x: x["_m"]).alias("centroid"))


def class_relation(classes: DataFrame, label: str) -> DataFrame:
    """Absolute cosine between class centroids, each row scaled to sum 1."""
    r = class_pairs(classes, label, "centroid").select("a", "b", F.abs(1 - distance(F.col("va"), F.col("vb"), "cosine")).alias("r"))
    return r.withColumn("r", F.col("r") / F.sum("r").over(Window.partitionBy("a")))


def principal_components(vectors: DataFrame, vector: str, k: int) -> DataFrame:
    """Centred PCA by Spark's own; the result has an array `pca`."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(v).transform(v)
    return PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("pca", vector_to_array("_p")).drop("_v", "_c", "_p")


def kmeans(vectors: DataFrame, vector: str, k: int, seed: int = 1) -> DataFrame:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(v).transform(v).drop("_v")


TAU = 2 * math.pi
