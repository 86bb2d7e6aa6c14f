"""The pipeline and the registered queries of the numbered operators on the smallest tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import public_tokenizers
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from seriesloom.llm import mixing, queries
from seriesloom.llm.shared import store

DATA = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    counts = [len(seen)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, DATA), "t")
        assert docs.columns == columns, name
        rows = docs.collect()
        assert all(seen[r["doc_id"]] == r["text"] for r in rows)
        counts.append(len(rows))
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0
    texts = {re.sub(r"\s+", " ", t or "") for t in seen.values()}
    assert counts[2] <= len(texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0


CLASH = ["score", "lang_pred", "row", "_n", "_key", "n", "copy", "kept_id", "kept", "size", "text_sha256", "h", "s", "Whole", "one"]


def fixture_rows():
    """Two languages, exact and near copies, long, letterless, empty and null texts, repeated rows, null ids and sources."""
    r = random.Random(11)
    parts = {"en": "the ing and tion er that with out".split(), "de": "der ung und keit ein sch nicht aus".split()}
    say = lambda lang, n: " ".join(r.choice(parts[lang]) + r.choice(parts[lang]) for _ in range(n))
    rows = [(i, say(lang, r.choice([8, 40, 120])), lang, f"s{i % 4}") for i in range(60) for lang in [("en", "de")[i % 2]]]
    for i in (1, 2, 3, 8):
        rows.append((100 + i, rows[i][1].replace(" ", "\n ", 2), None, "s1"))  # equal after normalising
        near = rows[i][1].split() + say(rows[i][2], 100).split()
        rows.append((200 + i, " ".join(near), rows[i][2], "s0"))
        near[7] = "changed"
        rows.append((300 + i, " ".join(near), rows[i][2], None))
    rows += [(400, None, "en", "s0"), (401, "", None, "s0"), (402, "12 34", None, "s1"), (403, say("en", 3000), "en", "s2"), (None, say("de", 30), "de", "s3"), rows[5], rows[5]]
    return [(*x, len(x[1] or "")) for x in rows]


def words_of(text):
    return [w.translate(str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def test_stages_against_plain_python(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars int"
    plain = spark.createDataFrame(fixture_rows(), columns).withColumns({c: F.lit(c) for c in CLASH})
    docs, names, kept = plain.repartition(3), plain.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = store(stage(spark, docs, DATA), "t")
        assert docs.columns == names
        rows = [tuple(r) for r in docs.collect()]
        assert all(r[5:] == tuple(CLASH) for r in rows)
        kept[name] = [r[:4] for r in rows]
    count = lambda rows: Counter((r[0], r[1]) for r in rows)
    assert count(kept["language ID"]) == count(r for r in fixture_rows() if re.search("[a-z]", r[1] or ""))
    best: dict = {}
    for r in sorted(kept["language ID"], key=lambda r: (r[0] is None, r[0] or 0)):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert count(kept["exact dedup"]) == count(best.values())
    sets, up = [], list(range(len(kept["exact dedup"])))
    for r in kept["exact dedup"]:
        w = words_of(r[1])
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) * 100 >= 80 * len(a | sets[j]):
                up[root(i)] = root(j)
    groups: dict = {}
    for i, r in enumerate(kept["exact dedup"]):
        groups.setdefault(root(i), []).append(r)
    assert count(kept["n-gram Jaccard join"]) == count(min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values())
    assert 0 < len(kept["n-gram Jaccard join"]) < len(kept["exact dedup"]) < len(kept["language ID"])
    source = spark.createDataFrame(kept["n-gram Jaccard join"], "doc_id long, text string, lang string, source string")
    wanted: Counter = Counter()
    for r in mixing.mix(source).collect():
        wanted[r["doc_id"]] += r["taken"] // r["size"]
    assert Counter(r[0] for r in kept["source mixing"]) == +wanted
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths: Counter = Counter()
    for r in kept["source mixing"]:
        ids = len(t.encode(r[1], add_special_tokens=False).ids) + 1
        bounds = [0, *range(ids % 1024 or 1024, ids + 1, 1024)]
        lengths.update((r[0], k, a, b - a) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in packed) == lengths
    for one in {r["sequence_id"] for r in packed}:
        at = 0
        for r in sorted((r for r in packed if r["sequence_id"] == one), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"]) for r in whole) == lengths


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    found, wanted = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.SQL[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    one = lambda v: None if pd.isna(v) else float(v) if not isinstance(v, str) else v  # noqa: E731  (a null makes whole numbers floats)
    text = lambda d: sorted(str([one(v) for v in r]) for r in d[columns].astype(object).values.tolist())
    assert text(found) == text(wanted)
