"""op10: exact dedup by deterministic block naming.

Normalised texts are cut into fixed-size byte blocks. Distinct blocks are
sorted and get integer names; then adjacent pairs of names are named the
same way, level by level, until every document has one name. Names are
assigned to sorted contents, not to hashes, so two documents of equal
length have the same final name exactly if their texts are equal.

To join names back without moving the blocks a second time, a block travels
as its 64-bit hash; hashes that several distinct blocks share are looked up
by content instead, so a hash collision never merges two texts.

Defined results: a null text is the empty text, and all empty texts are
equal. Rows with a null doc_id take part; keep_id is the smallest non-null
doc_id of the group (null if it has none). Of rows that repeat both doc_id
and text, one counts as kept. A text of any length is normalised and cut by
one task; its blocks then travel by themselves. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import boxed, discard, documents, narrow, store, unboxed

BLOCK = 2048
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _blocks(data: Column, block: int) -> Column:
    def cut(one: Column) -> Column:
        count = F.greatest(F.lit(1), F.ceil(F.length(one) / block)).cast("int")
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(one, i * block + 1, F.lit(block)))

    return F.get(F.transform(F.array(data), cut), F.lit(0))  # so that `data` is worked out once, not once a block


def _name(keys: DataFrame) -> DataFrame:
    """Distinct rows of `keys` with an integer `name`: the rank in the sorted
    order of its partition, after all names of earlier partitions."""
    return keys.distinct().sortWithinPartitions(*keys.columns).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, block: int = BLOCK, hashed=F.xxhash64) -> DataFrame:
    """One row per row of `docs` (columns id, text): rid long, id, n_bytes,
    sha (binary SHA-256 of the normalised text) and name: rows have equal
    (n_bytes, name) exactly if their normalised texts are equal."""
    cut = docs.select("id", F.encode(normalised(F.col("text")), "UTF-8").alias("data")).withColumn("blocks", _blocks(F.col("data"), block))
    rows = store(
        cut.select(
            F.monotonically_increasing_id().alias("rid"), "id", F.length("data").alias("n_bytes"),
            F.unhex(F.sha2("data", 256)).alias("sha"), F.transform("blocks", lambda b: hashed(b)).alias("hashes"),
        ),
        "op10-rows",
    )
    named = store(_name(cut.select(F.explode("blocks").alias("block"))).withColumn("h", hashed(F.col("block"))), "op10-blocks")
    shared = named.groupBy("h").count().where("count > 1").select("h")
    spread = rows.select("rid", F.size("hashes").alias("n"), F.posexplode("hashes").alias("pos", "h"))
    level = spread.join(named.select("h", "name"), "h").select("rid", "n", "pos", "name")
    if not shared.isEmpty():
        level = _by_content(cut, rows, spread, named, shared, hashed)
    level, parts = store(level, "op10-level"), []
    discard(named)
    widest = level.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        parts.append(level.where("n = 1"))
        pairs = store(
            level.where("n > 1")
            .groupBy("rid", F.expr("cast(pos div 2 as int)").alias("pos"))
            .agg(
                F.max(F.expr("if(pos % 2 = 0, name, null)")).alias("a"),
                F.coalesce(F.max(F.expr("if(pos % 2 = 1, name, null)")), F.lit(-1)).alias("b"),
                F.expr("cast((max(n) + 1) div 2 as int)").alias("n"),
            ),
            "op10-pairs",
        )
        names = store(_name(pairs.select("a", "b")), "op10-names")
        level = store(pairs.join(names, ["a", "b"]).select("rid", "n", "pos", "name"), "op10-level")
        discard(pairs, names)
        widest = (widest + 1) // 2
    for part in parts:
        level = level.unionByName(part)
    done = store(rows.select("rid", "id", "n_bytes", "sha").join(level.select("rid", "name"), "rid"), "op10-named")
    discard(rows, level)
    return done


def _by_content(cut: DataFrame, rows: DataFrame, spread: DataFrame, named: DataFrame, shared: DataFrame, hashed) -> DataFrame:
    """First names where some hashes stand for several blocks: those blocks are compared themselves."""
    plain = spread.join(shared, "h", "left_anti").join(named.select("h", "name"), "h").select("rid", "n", "pos", "name")
    twins = cut.select("id", F.unhex(F.sha2("data", 256)).alias("sha"), F.posexplode("blocks").alias("pos", "block")).withColumn("h", hashed(F.col("block")))
    twins = twins.join(shared, "h", "left_semi").join(named, ["h", "block"]).select("id", "sha", "pos", "name").distinct()
    r = rows.select("rid", F.col("id").alias("rid_id"), F.col("sha").alias("rid_sha"), F.size("hashes").alias("n"))
    found = r.join(twins, r.rid_id.eqNullSafe(twins.id) & (r.rid_sha == twins.sha))
    return plain.unionByName(found.select("rid", "n", "pos", "name"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of `df`: id_col, keep_id, group_size, kept, text_sha256."""
    named = block_names(narrow(df, id=id_col, text=text_col), block)
    groups = store(named.groupBy("n_bytes", "name").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size")), "op10-groups")
    first = store(
        named.join(groups, ["n_bytes", "name"])
        .where(F.col("id").eqNullSafe(F.col("keep_id")))
        .groupBy("n_bytes", "name")
        .agg(F.min("rid").alias("keep_rid")),
        "op10-first",
    )
    one = store(groups.join(first, ["n_bytes", "name"]), "op10-keep")
    discard(groups, first)
    return named.join(one, ["n_bytes", "name"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of `df` that stay, with all their columns."""
    kept = store(exact_groups(df, id_col, text_col, block).where("kept").select(F.col(id_col).alias("kept_id"), F.col("text_sha256").alias("kept_sha")), "op10-kept")
    rows = boxed(df, id=F.col(id_col), sha=F.sha2(F.encode(normalised(F.col(text_col)), "UTF-8"), 256))
    rows = rows.join(kept, (F.col("sha") == F.col("kept_sha")) & F.col("id").eqNullSafe(F.col("kept_id")))
    order = Window.partitionBy("kept_sha", "kept_id").orderBy(F.lit(1))
    return unboxed(rows.withColumn("n", F.row_number().over(order)).where("n = 1"))


def op10_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


SQL = """
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)
"""
