"""Phrase collocations, line rules and importance resampling against plain Python: nulls, empty and very long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import collocations, importance, line_rules, queries, segments

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
KIND = "doc_id long, text string, lang string, source string, n_chars long, rank long, id string, row int, score double, shard string, a int, words string"
VOCAB = ["the", "of", "Red", "blue", "cat", "été", "漢字", "x1"]


def prose(n, seed, mark=0.15):
    r = random.Random(seed)
    return "".join(r.choice(VOCAB) + (r.choice(". , \n ;\t".split(" ")) if r.random() < mark else "") + " " for _ in range(n))


def rows():
    texts = [prose(300, 1), prose(300, 2), None, "", " \t\n", "...", "one", prose(4000, 3), "x" * 5000, prose(60, 4), prose(300, 1), "a b c d e f g h i j. | b | c\nall rights reserved!!", "Good line of more than eight words ends here well.\n" * 3, "A title\nThis line of more than eight words ends as it should.\nand this one has no mark where it comes to its end\nSign in | Home\n\nThe last one is short."]
    out = [(i, t, ["en", "de", None][i % 3], f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(3, None, None, None), (0, texts[0], "en", "s0"), (0, texts[0], "en", "s0"), (None, "one two", None, "s1"), (None, None, None, None), (None, prose(50, 5), "und", None)]
    return [(*r, 0, 1, "z", 5, 0.5, "s", 1, "w") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def plain(frame):
    return sorted(map(str, frame.itertuples(index=False, name=None)))


# --- segments ---


@pytest.mark.parametrize("most", [1, 7, 64])
def test_segments_are_the_texts_and_end_at_allowed_bytes(most):
    texts = [prose(200, 9), "", None, "nobreak" * 30, "a b", prose(30, 10)]
    allowed = segments.table_of(b" \n")
    seen = {i: b"" for i in range(len(texts))}
    for lo, hi, data, row in segments.segments(pa.array(texts), allowed, most):
        for i in range(hi - lo):
            part = data[row[i] : row[i + 1]].tobytes()
            seen[lo + i] += part
            assert len(seen[lo + i]) == len((texts[lo + i] or "").encode()) or allowed[part[-1]]
    assert [seen[i] for i in range(len(texts))] == [(t or "").encode() for t in texts]


# --- importance resampling ---


def runs(text, width):
    w = [x for x in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER).encode())]
    return len(w), [b" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, width + 1) if i + k <= len(w)]


def brute_resample(table, target, share, least, width, buckets, seed="2024"):
    count = lambda texts: Counter(zlib.crc32(f) % buckets for t in texts for f in runs(t, width)[1])
    s, t = count(r[1] for r in table), count(target)
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((float(t[b] + 1) * (total + buckets)) / (float(s[b] + 1) * (goal + buckets))))
    out = []
    for r in table:
        n, found = runs(r[1], width)
        weight = sum(gain(zlib.crc32(f) % buckets) for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        out.append([r[0], len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], math.inf if x[0] is None else x[0]))
    ranks = [(x[0], x[3], i + 1) for i, x in enumerate(able[: share[0] * len(able) // share[1]])]
    return sorted(str(tuple(x[:4])) for x in out), sorted(map(str, ranks))


@pytest.mark.parametrize("width, share, least, buckets", [(1, (10, 100), 20, 10_000), (1, (100, 100), 0, 7), (2, (1, 2), 1, 50), (3, (40, 100), 2, 50)])
def test_resampling(spark, docs, width, share, least, buckets):
    target = ["the red cat", None, "", "Été the of", "x1 x1 x1"]
    found = importance.resample(docs, spark.createDataFrame([(t, 1) for t in target], "text string, bucket int"), share, least, width, buckets).collect()
    wanted, ranks = brute_resample(rows(), target, share, least, width, buckets)
    assert sorted(str(tuple(r)[:4]) for r in found) == wanted
    assert sorted(str((r[0], r[3], r[4])) for r in found if r[4] is not None) == ranks


def test_nothing_to_draw(spark, docs, none):
    assert importance.resample(none, docs).count() == 0
    assert importance.resample(docs, none, share=(0, 100)).where("rank is not null").count() == 0
    assert importance.resample(docs, none, least_words=10**6).where("rank is not null").count() == 0


def test_cutoff_bisects_ties(spark):
    r = random.Random(3)
    table = [(r.randint(-3, 3), r.choice([-(1 << 62), 5, 6, (1 << 63) - 1]), i) for i in range(200)]
    frame = spark.createDataFrame(table, "x long, y long, z long")
    for take in (1, 2, 57, 58, 199, 200):
        found = frame.where(importance.upto(importance.cutoff(frame, ["x", "y", "z"], take))).collect()
        assert sorted(map(tuple, found)) == sorted(table)[:take]


def test_checksums_of_long_and_short_words():
    words = [b"", b"a", b"x" * 64, b"y" * 65, b"z" * 1000, "漢".encode(), b"ab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert importance.crc32s(data, ends - [len(w) for w in words], ends).tolist() == [zlib.crc32(w) for w in words]


def test_features_of_a_text_of_ten_megabytes():
    text = prose(2_300_000, 6)
    assert len(text.encode()) > 10_000_000
    total = np.zeros(10_000, np.int64)
    for part in importance.features(pa.array(["a", text, None]), 1, 10_000):
        total += np.bincount(part.buckets, minlength=10_000)
    wanted = Counter(zlib.crc32(f) % 10_000 for f in runs(text, 1)[1]) + Counter([zlib.crc32(b"a") % 10_000])
    assert {i: n for i, n in enumerate(total.tolist()) if n} == dict(wanted)


# --- line rules ---


def brute_lines(text):
    text = text or ""
    word = lambda s: re.findall(r"[^\x20\x09-\x0D]+", s)
    w = word(text)
    lines = [x for x in text.split("\n") if word(x)]
    windows = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    repeated = {i + j for i in range(len(w) - 4) if windows[tuple(w[i : i + 5])] > 1 for j in range(5)}
    failed = []
    for x in lines:
        v, low = word(x), x.translate(LOWER)
        doubled = sum(x[i] in "!?" and x[i - 1] in "!?" for i in range(1, len(x)))
        separators = sum(c in "|»›·•" for c in x)
        failed.append(
            (len(v) >= 8 and v[-1][-1] not in ".!?\"')]…”’»:;") or sum(c in "#*$%&|<>" for c in x) * 10 > len(v) or doubled * 5 > len(v)
            or (separators >= 2 and separators * 4 >= len(v)) or (len(v) <= 30 and any(p in low for p in line_rules.PHRASES))
        )
    chars, left = sum(map(len, w)), sum(len(c) for x, bad in zip(lines, failed) if not bad for c in word(x))
    base = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    counts = (len(w), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines), sum(failed), left)
    return (*counts, base, not base and 2 * left >= chars), "".join(x for x in re.findall(r"[^\n]*\n|[^\n]+", text) if not (word(x) and failed[lines.index(x.rstrip("\n"))]))


def test_line_rules(docs, none):
    found = line_rules.line_rules(docs).toPandas()
    assert plain(found) == plain(pd.DataFrame([(r[0], *brute_lines(r[1])[0]) for r in rows()]))
    assert {True, False} == set(found["kept"])
    assert line_rules.line_rules(none).count() == 0


def test_failing_lines_leave_the_texts(docs, none):
    found = line_rules.cleaned(docs).toPandas()
    kept = [(r, brute_lines(r[1])) for r in rows()]
    assert plain(found) == plain(pd.DataFrame([(r[0], b[1], *r[2:]) for r, b in kept if b[0][-1]]))
    assert line_rules.cleaned(none).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_line_counts_of_odd_lines(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice(["a", "bb", " ", " ", " ", "\n", "\r", "|", "!", "?", "*", ".", "»", "•", "…", "é", "Sign in", "\x0b", "漢"]) for _ in range(r.randint(0, 300))) for _ in range(40)]
    for lo, hi, counts in line_rules.measured(pa.array(texts)):
        for i in range(lo, hi):
            assert tuple(int(counts[c][i - lo]) for c in line_rules.COUNTS) == brute_lines(texts[i])[0][:8], texts[i]


def test_lines_of_a_text_of_ten_megabytes():
    text = (prose(120_000, 7, 0.1) + "\n| a | b |\n") * 20
    assert len(text.encode()) > 10_000_000
    found = {lo: counts for lo, hi, counts in line_rules.measured(pa.array(["a b", text, "c"]))}
    assert tuple(int(found[1][c][0]) for c in line_rules.COUNTS) == brute_lines(text)[0][:8]


# --- collocations ---


def brute_collocations(table, longest, least, top):
    out = []
    langs = {}
    for r in table:
        langs.setdefault(r[2] or "und", []).append((r[1] or "").translate(LOWER))
    for lang, texts in langs.items():
        f, n = Counter(), 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                for k in range(1, longest + 1):
                    f.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = {q[i : i + k] for q, b in candidates.items() for k in range(2, len(q)) for i in range(len(q) - k + 1) if b >= candidates[q[i : i + k]]}
        found = []
        for p, a in candidates.items():
            if p not in held:
                score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


FIELDS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize("longest, least, top, shard", [(5, 3, 2000, 1 << 22), (5, 2, 40, 500), (3, 100, 7, 64), (2, 1, 2000, 300)])
def test_collocations(docs, longest, least, top, shard):
    found = collocations.collocations(docs, longest, least, top, shard=shard).select(*FIELDS).collect()
    assert sorted(map(tuple, found)) == brute_collocations(rows(), longest, least, top)


def test_no_collocations(none, docs):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(docs, least=10**6).count() == 0


def test_fixed_expressions_are_found_whole(spark):
    text = "we saw new york state park . new york state park is far, so he said new york state park\n" * 5
    found = collocations.collocations(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), least=15).collect()
    assert [r["phrase"] for r in found] == ["new york state park"]


def test_words_on_both_sides_of_a_cut_in_a_text_are_neighbours(spark):
    text = prose(500_000, 8, 0.02)
    assert len(text.encode()) > 2 * segments.PIECE
    table = [(1, text, "en"), (2, text[:50_000], "en")]
    found = collocations.collocations(spark.createDataFrame(table, "doc_id long, text string, lang string"), longest=3, least=2000).select(*FIELDS).collect()
    assert sorted(map(tuple, found)) == brute_collocations(table, 3, 2000, 2000)


@pytest.mark.parametrize("seed", range(4))
def test_intervals_are_those_of_the_sorted_contexts(seed):
    r = np.random.default_rng(seed)
    text = np.concatenate([[0], r.integers(0, 4, 60), [0]])
    forward, reverse = collocations.transforms(text, 4, 4)
    contexts = lambda t: sorted((tuple(np.roll(t, -i)[:4]), i) for i in range(len(t)))
    assert forward.tolist() == [text[i - 1] for _, i in contexts(text)]
    level = {(s,): (int((text < s).sum()), int((text < s).sum()), int((text == s).sum())) for s in (1, 2, 3) if (text == s).any()}
    for _ in range(3):
        names = list(level)
        lo, lo_r, size = (np.array([level[p][i] for p in names], np.int64) for i in range(3))
        owner, symbol, a, b, n = collocations.extended(reverse, 4, lo, lo_r, size)
        level = {(*names[o], int(s)): (int(x), int(y), int(z)) for o, s, x, y, z in zip(owner, symbol, a, b, n)}
        for p, (x, y, z) in level.items():
            for t, q, start in ((text, p, x), (text[::-1], p[::-1], y)):
                at = [i for i, (c, _) in enumerate(contexts(t)) if c[: len(q)] == q]
                assert at == list(range(start, start + z))


def test_small_shards_are_put_together_and_rounds_ship_lists(spark):
    table = [(i, prose(300, i, 0.5), "en" if i % 3 else None) for i in range(24)]
    sharded = collocations.shards(spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(6), "text", "lang").cache()
    n = {r["shard"]: (r["lang"], r["n"]) for r in sharded.collect()}
    assert len(n) > 2
    for most in (1 << 21, 1000):
        groups = {}
        for r in collocations.together(sharded, most).collect():
            groups.setdefault(r["shard"], []).append(n.pop(r["piece"]) if most < 2000 else n[r["piece"]])
        assert all(len({lang for lang, _ in g}) == 1 and sum(m for _, m in g) < most + max(m for _, m in g) for g in groups.values())
        assert len(groups) == 2 or most < 2000
    assert not n
    found = {c: np.array([1, 5, 3, 1, 9]) for c in collocations.PARTS}
    packed = collocations.lists(7, found, 2)
    assert packed.num_rows <= 2 and sum(packed.column("n").to_pylist()) == 5


def test_a_common_phrase_is_one_row_however_many_shards_have_it(spark, monkeypatch):
    table = [(i, " ".join(f"w{w}" for w in np.random.default_rng(i).integers(0, 40, 1500)), "en") for i in range(12)]
    tables, made = {}, []
    real = collocations.store

    def store(df, name):
        found = tables[name] = real(df, name)
        if name == "op11-common":
            made.append(found.count())
        elif name == "op11-pieces":
            tables["shards"] = found.select("shard").distinct().count()
        return found

    monkeypatch.setattr(collocations, "store", store)
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(12)
    found = collocations.collocations(df, longest=3, least=3, shard=1000).select(*FIELDS).collect()
    assert sorted(map(tuple, found)) == brute_collocations(table, 3, 3, 2000)
    common = []
    for k in (2, 3):
        f = Counter(tuple(w[i : i + k]) for w in (r[1].split() for r in table) for i in range(len(w) - k + 1))
        common.append(sum(a >= 3 for a in f.values()))
    assert tables["shards"] > 5 and common[0] > 1000
    assert made[0] <= common[0] + 16 * tables["shards"]  # 16 buckets hold a list for each shard at most
    assert made[1] == common[1]  # nothing goes back after the last round


# --- the queries ---


@pytest.mark.parametrize("name", ["op11_phrase_collocations", "op12_line_rules", "op13_importance_resampling"])
def test_query_against_its_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    wanted = con.sql(queries.SQL[name]).df()
    found = queries.QUERIES[name](spark, folder).toPandas()
    columns = sorted(wanted.columns)
    assert sorted(found.columns) == columns and len(found)
    one = lambda v: None if pd.isna(v) else str(v) if isinstance(v, str) else float(v)  # noqa: E731  (a null makes whole numbers floats in one of the two)
    rows_of = lambda frame: sorted(str([one(v) for v in r]) for r in frame[columns].itertuples(index=False, name=None))
    assert rows_of(found) == rows_of(wanted)
