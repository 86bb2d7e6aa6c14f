"""The numbered operators on small tables against brute force: nulls, empty and
long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import exact_dedup, language_id, license_scan, mixing, ngram_join, packing, repeated_spans, sharding, transport_media, tree_weighting, words

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
KIND = "doc_id long, text string, lang string, source string, n_chars long, rid long, key string, id string, node long, size string"
RANDOM = random.Random(7)
VOCAB = ["".join(RANDOM.choice("abcdefgh") for _ in range(RANDOM.randint(1, 6))) for _ in range(60)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) for _ in range(n))


def rows():
    base = prose(120, 1)
    near = base.split()
    near[5] = "Changed"
    texts = [base, base.replace(" ", "\n\t", 3), " ".join(near), None, "", "   ", "...", "one", "one two", "One two", prose(4000, 2), "x" * 3000, "añ o é\x85ß 漢字 " * 30, prose(40, 3) + " " + base, base]
    out = [(i, t, ["en", "de"][i % 2], f"s{i % 3}") for i, t in enumerate(texts)]
    out += [(3, None, None, None), (0, base, "en", "s0"), (None, "one two", None, "s1"), (None, None, None, None)]
    return [(*r, 0, 1, "k", "z", 5, "big") for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), KIND).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], KIND)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingle_set(text, width):
    w = tokens(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def key(v):
    return str(v)


# --- words ---


def test_word_hashes_agree_with_the_words():
    texts = ["", "a b", "A b\tc", None, "é x y", "a b"]
    seen: dict[int, str] = {}
    for w in words.words_of(pa.array(texts)):
        for i in range(w.rows):
            hashes = words.hash_spans(w.data, w.starts, w.ends)[w.first_word[i] : w.first_word[i + 1]]
            assert len(hashes) == len(tokens(texts[w.first + i]))
            for h, t in zip(hashes.tolist(), tokens(texts[w.first + i]), strict=True):
                assert seen.setdefault(h, t) == t
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_small_windows(monkeypatch):
    monkeypatch.setattr(words, "PIECE", 64)
    monkeypatch.setattr(words, "WINDOW", 16)
    texts = [prose(50, 4), "y" * 500, prose(30, 5)]
    count = sum(len(w.starts) for w in words.words_of(pa.array(texts)))
    assert count == sum(len(tokens(t)) for t in texts)
    a = dict(words.shingle_sets(pa.array(texts), 3))
    monkeypatch.undo()
    b = dict(words.shingle_sets(pa.array(texts), 3))
    assert all((a[i] == b[i]).all() for i in a)


# --- op1 ---


@pytest.mark.parametrize(("width", "most", "chunk"), [(3, (90, 100), 100_000), (5, (80, 100), 100)])
def test_ngram_join(spark, monkeypatch, width, most, chunk):
    monkeypatch.setattr(ngram_join, "CHUNK", chunk)  # groups of several chunks, and queries dealt over chunks
    monkeypatch.setattr(ngram_join, "QUERIES", chunk // 50)
    r = rows()
    for k in range(30):  # a cluster of near copies, and texts that share a passage
        w = prose(80, 100).split()
        w[k] = f"edit{k}"
        r.append((100 + k, " ".join(w), "en", "s0", 0, 1, "k", "z", 5, "big"))
        r.append((200 + k, prose(20, 100) + " " + prose(30, 300 + k), "en", "s0", 0, 1, "k", "z", 5, "big"))
    found = ngram_join.near_duplicates(spark.createDataFrame(r, KIND).repartition(3), width=width, most=most).collect()
    sets = [shingle_set(x[1], width) for x in r]
    up = list(range(len(r)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(r)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both * most[1] >= most[0] * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids: dict[int, list] = {}
    for i, x in enumerate(r):
        ids.setdefault(root(i), []).append(x[0])
    low = {g: min((v for v in members if v is not None), default=None) for g, members in ids.items()}
    wanted = Counter((key(x[0]), len(sets[i]), key(low[root(i)] if sets[i] else x[0])) for i, x in enumerate(r))
    assert Counter((key(f["doc_id"]), f["n_shingles"], key(f["component_id"])) for f in found) == wanted


def test_ngram_join_keeps_one_of_each_class(docs, none):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum(t is not None and t.startswith(prose(120, 1)[:40]) for t in texts) == 1
    assert sum(t is None for t in texts) and "..." in texts
    assert ngram_join.near_duplicates(none).count() == 0


# --- op2 ---


def test_transport_stream_round_trip():
    for n in (0, 1, 63, 64, 183, 184, 2048, 2049, 20_000, *range(150, 200)):
        payload = transport_media.padded(os.urandom(n))
        media = transport_media.mux(payload)
        read = transport_media.demux(media)
        assert read["payload"] == payload and read["errors"] == 0 and len(media) % 188 == 0
        assert read["times"] == [3600 * i for i in range(len(read["times"]))]
        assert read["entries"] == list(range(0, len(read["times"]), transport_media.GROUP))
    broken = bytearray(transport_media.mux(transport_media.padded(os.urandom(5000))))
    broken[188 * 4 + 3] ^= 1
    assert transport_media.demux(bytes(broken))["errors"]
    with pytest.raises(ValueError, match="not a transport stream"):
        transport_media.demux(bytes(188))


def test_media_columns(docs, none):
    read = transport_media.decode_media(transport_media.encode_media(docs)).collect()
    wanted = Counter((key(r[0]), transport_media.padded((r[1] or "").encode())) for r in rows())
    assert Counter((key(r["id"]), bytes(r["payload"])) for r in read) == wanted
    assert transport_media.decode_media(transport_media.encode_media(none)).count() == 0


def test_streams_of_other_encoders_are_read():
    P = transport_media.PACKET
    head = lambda pid, counter, control, start=False: bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, control << 4 | counter & 15])
    pat = transport_media._section(0, 1, (1).to_bytes(2, "big") + (0xE000 | 0x20).to_bytes(2, "big"))
    about = b"\x05" + bytes([250]) + bytes(250)  # a descriptor that makes the table span two packets
    pmt = transport_media._section(2, 1, (0xE000 | 0x30).to_bytes(2, "big") + b"\xf0\x00" + bytes([0x1B]) + (0xE000 | 0x30).to_bytes(2, "big") + (0xF000 | len(about)).to_bytes(2, "big") + about)
    out = [(head(0, 3, 1, True) + b"\x00" + pat).ljust(P, b"\xff"), head(0x1FFF, 0, 1).ljust(P, b"\xff")]
    table = b"\x00" + pmt
    out += [(head(0x20, k, 1, k == 0) + table[184 * k : 184 * k + 184]).ljust(P, b"\xff") for k in range(2)]
    one = b"\x00\x00\x01\xe0\x00\x00\x80\x80\x05" + transport_media._stamp(5_000_000_000) + b"A" * 170  # without a length
    two = b"\x00\x00\x01\xe0\x00\x00\x80\x00\x00" + b"B" * 175  # without a time

    def packet(counter, part, flags=0, start=False):
        space = P - 4 - len(part)
        return head(0x30, counter, 3, start) + bytes([space - 1]) + (bytes([flags]) + b"\xff" * (space - 2))[: space - 1] + part

    first = packet(7, one[:100], 0x40, True)
    out += [first, first, head(0x30, 7, 2) + bytes([183, 0]) + b"\xff" * 182, packet(8, one[100:]), head(0x77, 1, 1).ljust(P, b"\0")]
    out += [packet(2, two[:90], 0x80, True), packet(3, two[90:])]  # a marked discontinuity
    found = transport_media.demux(b"".join(out))
    assert found["payload"] == b"A" * 170 + b"B" * 175 and found["errors"] == 0 and found["entries"] == [0]
    assert found["times"] == [5_000_000_000 & (1 << 33) - 1, -1] and found["pid"] == 0x30
    lost = transport_media.demux(b"".join([*out[:-1], packet(5, two[90:])]))
    assert lost["errors"] == 1


def _with_clock(packet, ticks):
    return packet[:6] + transport_media._clock(ticks) + packet[12:]


def test_a_packet_sent_twice_with_another_clock_counts_once():
    payload = transport_media.padded(os.urandom(9000))
    media = transport_media.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    twice = [p for q in packets for p in ([q, _with_clock(q, 77)] if q[3] & 0x20 and q[4] >= 7 and q[5] & 0x10 else [q])]
    assert len(twice) > len(packets)
    read = transport_media.demux(b"".join(twice))
    assert read["payload"] == payload and read["errors"] == 0 and read["cut"] == 0


def test_a_unit_ends_where_the_next_one_begins_after_a_lost_packet():
    payload = transport_media.padded(os.urandom(3 * transport_media.UNIT))
    media = transport_media.mux(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    inside = [i for i, p in enumerate(packets) if p[1:3] == transport_media.MEDIA_PID.to_bytes(2, "big")]
    gone = inside[1]
    read = transport_media.demux(b"".join(packets[:gone] + packets[gone + 1 :]))
    assert read["errors"] == 1 and read["cut"] == 1 and len(read["times"]) == len(transport_media.demux(media)["times"])
    lost = len(payload) - len(read["payload"])
    assert 0 < lost <= 184 and read["payload"].endswith(payload[transport_media.UNIT :])


# --- op3 ---


def test_license_rules(spark, none):
    s = license_scan.SENTENCES
    texts = ["Licensed under the Apache License, Version 2.0.\nother", f"{s[40]}. {s[41]}. {s[42]}.", f"{s[41]}. {s[40]}.", f"{s[40]}. and then. {s[41]}.", None, "", f"{s[40]}. {s[41]}. {s[40]}. {s[41]}. {s[42]}.", "# SPDX-License-Identifier: MIT"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    out = {r["doc_id"]: (r["n_sentences"], r["licenses"]) for r in license_scan.scan(df).collect()}
    assert out == {0: (2, "Apache-2.0"), 1: (3, "BSD-3-Clause"), 2: (2, ""), 3: (3, ""), 4: (0, ""), 5: (0, ""), 6: (5, "BSD-2-Clause,BSD-3-Clause"), 7: (1, "MIT")}
    assert license_scan.scan(none).count() == 0


NOTICES = {
    "Apache-2.0": """
// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0
""",
    "Apache-2.0 ": """
dnl Unless required by applicable law or agreed to in writing, software
dnl distributed under the License is distributed on an "AS IS" BASIS,
dnl WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
dnl See the License for the specific language governing permissions and
dnl limitations under the License.
""",
    "BSD-3-Clause": """
 * 1. Redistributions of source code must retain the above copyright
 *    notice, this list of conditions and the following disclaimer.
 *
 * 2. Redistributions in binary form must reproduce the above copyright
 *    notice, this list of conditions and the following disclaimer in the
 *    documentation and/or other materials provided with the distribution.
 *
 * 3. Neither the name of the copyright holder nor the names of its
 *    contributors may be used to endorse or promote products derived from
 *    this software without specific prior written permission.
""",
    "GPL-3.0": """
    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "MIT": """
The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
""",
    "MPL-2.0": """
/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
    "": """
Redistributions of source code must retain the above copyright

notice, this list of conditions and the following disclaimer.
Not released under the MIT License
""",
}


def test_wrapped_licence_notices_are_known(spark):
    df = spark.createDataFrame([(i, t.replace("\n", e)) for i, t in enumerate(NOTICES.values()) for e in ("\n", "\r\n")], "doc_id long, text string")
    out = license_scan.scan(df).collect()
    names = list(NOTICES)
    assert [r["licenses"] for r in sorted(out, key=lambda r: r["doc_id"])] == [n.strip() for n in names for _ in range(2)]
    assert {r["sentence_ids"] for r in out if r["doc_id"] == 0} == {"2,3,4"}
    import duckdb

    con = duckdb.connect()
    frame = df.toPandas()  # noqa: F841
    con.sql("create table documents as select * from frame")
    columns = ["doc_id", "n_sentences", "sentence_ids", "licenses"]
    assert sorted(map(tuple, con.sql(license_scan.SQL).df()[columns].values.tolist())) == sorted(tuple(r[c] for c in columns) for r in out)


# --- op4 ---


def test_packing_places_every_token_once(docs, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    out = packing.pack_documents(docs, with_ids=True).collect()
    wanted = Counter()
    for r in rows():
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024
        bounds = [0, *range(head or 1024, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            wanted[(key(r[0]), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((key(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == wanted
    by: dict[int, list] = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(none).count() == 0


def test_hierarchical_rounds_stay_near_the_lower_bound(spark):
    items = spark.range(3000).selectExpr("id as key", "cast(id * 7919 % 1024 + 1 as long) as length")
    placed = packing.pack(items, per_part=100, hosts=8).join(items, "key").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("c")).collect()
    assert sum(r["c"] for r in placed) == 3000 and max(r["n"] for r in placed) <= 1024
    assert len(placed) <= 1.05 * sum(r["n"] for r in placed) / 1024 + 1


def test_encoder_units_match_whole_texts():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(path("byte_bpe_50k.json")), random.Random(1)
    texts = ["".join(r.choice("ab1'sé !\n\t   \x0b\x0c\x1c\x85.漢") for _ in range(r.randint(0, 30))) for _ in range(500)]
    encoder = packing.Encoder()
    for text, ids in zip(texts, encoder.texts(pa.array(texts)), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_ids_of_special_tokens_are_the_tokenizers():
    from public_tokenizers import path
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["hello <|endoftext|> world<|endoftext|>", "<|endoftext|>", "a<|endoftext|>b  <|endoftext|>\n\n x", "<|endof text|>"]
    for text, ids in zip(texts, packing.Encoder().texts(pa.array(texts)), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


# --- op5 ---


def test_mixing_targets_and_limits(spark, docs, none):
    out = mixing.mix(docs).collect()
    assert Counter((key(r["doc_id"]), r["size"]) for r in out) == Counter((key(r[0]), len(tokens(r[1]))) for r in rows())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    many = spark.createDataFrame([(i, prose(i % 37 + 1, i), f"s{i % 7}", "x") for i in range(3000)], "doc_id long, text string, source string, u string")
    a, b = (sorted(map(tuple, mixing.mix(many).collect())) for _ in range(2))
    assert a == b
    sums: dict[float, list] = {}
    for _, size, source_size, target, taken in a:
        sums.setdefault(target, [source_size, 0])[1] += taken
    assert math.isclose(sum(t * 1 for t in {(r[2], r[3]) for r in a} for t in [t[1]]), 1.5 * sum(s for s, _ in {(r[2], r[3]) for r in a}), rel_tol=1e-9)
    for source_size, target in {(r[2], r[3]) for r in a}:
        took = sum(r[4] for r in a if (r[2], r[3]) == (source_size, target))
        assert abs(took - target) <= 40 and target <= 2 * source_size + 1e-6
    assert mixing.mix(none).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_documents_behind_one_that_does_not_fit_fill_the_gap(spark, seed):
    big = spark.createDataFrame([(-1, 50_000), (-2, 9000), (-3, 2500)], "doc_id long, n int")
    sizes = big.unionByName(spark.range(400).selectExpr("id as doc_id", "cast(80 + id % 41 as int) as n"))
    out = mixing.mix(sizes.selectExpr("doc_id", "repeat('w ', n) as text", "'s' as source"), seed=seed).collect()
    assert abs(sum(r["taken"] for r in out) - out[0]["target"]) <= 60
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)


def test_the_mix_against_brute_force(spark):
    r = random.Random(9)
    rows_ = [(i, "w " * r.choice([1, 3, 10, 40, 150, 700]), f"s{r.choice([0, 0, 0, 1, 2])}") for i in range(300)] + [(5, "w w w", "s0")] * 4 + [(900, None, "s1"), (901, "", None), (None, "w " * 20, None)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(3)
    each, goals = mixing.drawn_groups(df)
    goals, each, found = {g["source"]: g for g in goals.collect()}, each.collect(), mixing.mix(df).collect()
    taken: dict = Counter()
    for source, g in goals.items():
        own = [x for x in each if x["source"] == source and x["size"]]
        low, high = 0.0, 1e9  # expected words grow with the unit
        for _ in range(200):
            unit = (low + high) / 2
            words_ = sum(x["rows"] * x["size"] * min(2.0, unit * x["size"] ** mixing.POWER) for x in own)
            low, high = (unit, high) if words_ < g["target"] else (low, unit)
        copies = {id(x): min(2.0, low * x["size"] ** mixing.POWER) for x in own}
        assert all(math.isclose(x["whole"] + x["chance"], copies[id(x)], rel_tol=1e-6) for x in own)
        assert len({round(x["chance"], 6) for x in own if x["whole"] == 0}) != 1 or len(own) < 3  # chances are unequal
        left = g["target"] - sum(x["whole"] * x["size"] * x["rows"] for x in own)
        q = lambda x: math.log(x["u"] / (1 - x["u"])) - math.log(x["chance"] / (1 - x["chance"]))
        more: dict = Counter()
        for x in sorted((x for x in own if x["chance"] > 0), key=lambda x: (q(x), x["u"], x["id"] or 0, x["size"])):
            n = max(0, min(x["rows"], math.floor(left / x["size"] + 1e-12)))
            more[id(x)], left = n, left - n * x["size"]
        spare = [x for x in own if more[id(x)] < x["rows"] and x["whole"] < 2]
        if spare and left > 0:
            x = min(spare, key=lambda x: (abs(x["size"] - left), x["id"] is not None, x["id"] or 0, x["size"]))
            more[id(x)] += abs(x["size"] - left) < left
        for x in own:
            for k in range(x["rows"]):
                taken[(key(x["id"]), x["size"], x["size"] * (x["whole"] + (k < more[id(x)])))] += 1
    assert Counter((key(x["doc_id"]), x["size"], x["taken"]) for x in found if x["size"]) == taken


def test_mixed_rows_repeat_documents(docs):
    taken = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            taken[(key(r["doc_id"]), r["size"])] += r["taken"] // r["size"]
    found = mixing.mixed_rows(docs)
    assert found.columns == docs.columns
    assert Counter((key(r["doc_id"]), len(tokens(r["text"]))) for r in found.collect()) == +taken


# --- op6 ---


def test_sharding(spark, docs, none):
    out = sharding.shard(docs, shards=4).collect()
    assert Counter((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == Counter((key(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    for s in range(4):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    many = spark.range(60_000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text").unionByName(spark.range(20_000).selectExpr("7L as doc_id", "'same' as text"))
    sizes = sharding.shard(many).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.count_distinct("slot").alias("u")).collect()
    mean = sum(r["b"] for r in sizes) / 40
    assert len(sizes) == 40 and sum(r["n"] for r in sizes) == 80_000 and all(r["n"] == r["u"] for r in sizes)
    assert max(r["b"] for r in sizes) <= 1.01 * mean and min(r["b"] for r in sizes) >= 0.9 * mean
    assert sharding.shard(none).count() == 0


def test_shards_against_a_plain_ring_and_little_movement(spark):
    df = spark.createDataFrame([(i, "x" * (i * 37 % 400)) for i in range(4000)] + [(-1, "y" * 30_000), (5, "x" * 185)], "doc_id long, text string")
    places = df.withColumn("crc", F.crc32(F.encode("text", "UTF-8"))).withColumn("size", F.length("text").cast("long") + 16).withColumn("point", F.pmod(F.xxhash64("doc_id", "crc", "size"), F.lit(1 << 32)))
    rows_ = sorted((r["point"], r["doc_id"], r["size"], r["crc"]) for r in places.collect())
    total, put = sum(r[2] for r in rows_), {}
    for shards in (8, 9):
        ring = sharding.Ring(shards, sharding.NODES, -(-int(total * (1 + sharding.SLACK)) // shards))
        least = max(1, -(-total // (shards * sharding.HEAVY)))
        wanted: Counter = Counter()
        for p, i, size, crc in sorted((r for r in rows_ if r[2] >= least), key=lambda r: (-r[2], r[0], str(r[1]), r[3])):
            wanted[i, size, ring.put(p, size)] += 1
        cells: dict[int, list] = {}
        for r in rows_:
            if r[2] < least:
                cells.setdefault(r[0] >> 32 - sharding.CELL_BITS, []).append(r)
        for cell in sorted(cells):
            poured, start = ring.pour(cell << 32 - sharding.CELL_BITS, sum(r[2] for r in cells[cell])), 0
            for _, i, size, _ in cells[cell]:
                wanted[i, size, next(s for s, a, b in poured if a <= start < b)] += 1
                start += size
        found = sharding.shard(df, shards).collect()
        assert Counter((r["doc_id"], r["size"], r["shard"]) for r in found) == wanted
        put[shards] = {(r["doc_id"], r["size"]): r["shard"] for r in found}
    moved = [k for k, s in put[8].items() if put[9][k] != s]
    assert sum(k[1] for k in moved) / total < 1 / 9 + 0.06


# --- op7 ---


def segmentations(text, pieces):
    if not text:
        yield ()
    for p in pieces:
        if text.startswith(p):
            for rest in segmentations(text[len(p) :], pieces):
                yield (p, *rest)


def test_fit_and_prediction_against_brute_force(spark):
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b"bab", b" ab"]
    words_ = {b"ab": 3, b"bab": 2, b"abba": 1, b"b": 4}
    met: Counter = Counter()
    for w, n in words_.items():
        for i in range(len(w) + 1):
            for j in range(i + 1, len(w) + 2):
                if (b" " + w)[i:j] in pieces:
                    met[(b" " + w)[i:j]] += n
    for step in range(3):
        whole = sum(met.values()) + language_id.FLOOR * len(pieces)
        chance = {p: (met[p] + language_id.FLOOR) / whole for p in pieces}
        if step == 2:
            break
        met = Counter()
        for w, n in words_.items():
            ways = [(s, math.prod(chance[p] for p in s)) for s in segmentations(b" " + w, pieces)]
            for s, c in ways:
                for p in s:
                    met[p] += n * c / sum(c for _, c in ways)
    found = language_id.fit(pd.DataFrame({"word": list(words_), "n": list(words_.values())}), pieces, steps=2)
    assert np.allclose(found, [chance[p] for p in pieces], rtol=1e-9)
    flat = np.full(len(pieces), 1 / len(pieces))
    model = language_id.Model(["one", "two"], pieces, np.stack([found, flat], 1))
    texts = ["ab bab", "zq", "b  ab\nabba", "7", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    for i, t in enumerate(texts):
        if not re.search("[a-z]", t or ""):
            assert out[i] == ("und", 0.0)
            continue
        logs = [sum(math.log(sum(math.prod(c[p] for p in s) for s in segmentations(b" " + w.encode(), pieces))) for w in t.split()) for c in (chance, dict.fromkeys(pieces, 1 / len(pieces)))]
        odds = [math.exp(x - max(logs)) for x in logs]
        assert out[i][0] == ["one", "two"][odds.index(max(odds))] and math.isclose(out[i][1], max(odds) / sum(odds), rel_tol=1e-9)


def test_language_without_spaces_is_fitted(spark):
    signs = {"zh": "的一是不了人我在有他这为之大来以个中上们", "ja": "のにはをたがでてとしれさあいうえおかきく"}
    r = random.Random(5)
    rows = [(i, "".join(r.choice(signs[lang]) for _ in range(300)), lang) for i in range(40) for lang in [("zh", "ja")[i % 2]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 20"))
    assert all(np.ptp(model.chance[:, k]) > 0 for k in range(2))
    assert all(x["lang_pred"] == rows[x["row"]["doc_id"]][2] for x in language_id.predict(df, model).collect())
    long = ("é" * 100 + "abc").encode()
    assert b"".join(language_id.cut(long)) == long and all(len(p) <= 48 and p.decode() for p in language_id.cut(long))


def test_the_fit_counts_parts_of_words_without_a_space():
    pieces = sorted({bytes([b]) for b in range(256)}) + [b"ab"]
    words = pd.DataFrame({"word": [b"ab" * 30, b"b"], "n": [1, 2]})
    once = language_id.fit(words, pieces, steps=2)
    assert np.allclose(once, language_id.fit(words, pieces, steps=2, chunk=1, held=0))
    rest = sum(len(p) * once[pieces.index(p)] for p in (b"a", b"b", b"ab"))
    assert math.isclose(once[pieces.index(b" ")] / rest, 3 / 62, rel_tol=0.02)


def test_language_id(spark, none):
    en, de = "the ing and tion er that with".split(), "der ung und keit ein sch nicht".split()
    r = random.Random(3)
    texts = [(i, " ".join(r.choice(en if i % 2 else de) + r.choice(en if i % 2 else de) for _ in range(60)), "en" if i % 2 else "de") for i in range(60)]
    df = spark.createDataFrame([*texts, (900, None, None), (901, "12 34 !", None), (None, texts[1][1], None)], "doc_id long, text string, lang string")
    model = language_id.train(df.where("doc_id < 30"))
    out = {r["row"]["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, model).collect()}
    assert all(out[i][0] == lang for i, _, lang in texts if i >= 30)
    assert out[900] == out[901] == ("und", 0.0) and out[None][0] == "en"
    assert {r["lang_pred"] for r in language_id.predict(df, language_id.train(none.select("doc_id", "text", "lang"))).collect()} == {"und"}
    assert language_id.predict(none, model).count() == 0


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b" ab"]
    chance = np.array([[0.2], [0.1], [0.15], [0.25], [0.1], [0.05], [0.15]])
    data = np.frombuffer(b"abbaab", np.uint8)
    lattice = language_id.Lattice(language_id.PieceIndex(pieces), data, np.array([0, 3]), np.array([3, 6]))

    def total(text):
        return 1.0 if not text else sum(c[0] * total(text[len(p) :]) for p, c in zip(pieces, chance, strict=True) if text.startswith(p))

    found = language_id.forward(lattice, np.vstack([chance, [[0.0]]]))
    assert np.allclose(found[:, 0], [math.log(total(b" abb")), math.log(total(b" aab"))])
    long = np.frombuffer(b"a" * 5000, np.uint8)
    assert np.isfinite(language_id.forward(language_id.Lattice(language_id.PieceIndex(pieces), long, np.array([0]), np.array([5000])), np.vstack([chance, [[0.0]]]))).all()


# --- op8 ---


def brute_spans(texts, span):
    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        runs = sum(1 for a, b in zip(b"\0" + bytes(gone), gone, strict=False) if b and not a)
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [1, 20_000])
def test_repeated_spans(spark, none, crowd):
    r = rows()
    passage = prose(60, 50)
    r += [(300 + i, prose(30, 60 + i) + passage[: 150 + 20 * i] + prose(20, 90 + i), None, None, 0, 1, "k", "z", 5, "big") for i in range(8)]
    r.append((400, "ab " * 200, None, None, 0, 1, "k", "z", 5, "big"))
    df = spark.createDataFrame(r, KIND).repartition(3)
    found = Counter((key(x["doc_id"]), x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in repeated_spans.remove_repeated(df, crowd=crowd, batches=4).collect())
    assert found == Counter((key(x[0]), *b) for x, b in zip(r, brute_spans([(x[1] or "").encode() for x in r], 200), strict=True))
    assert repeated_spans.remove_repeated(none).count() == 0


def test_index_family_merges_equal_levels(spark):
    family = repeated_spans.IndexFamily()
    seen = []
    for b in range(5):
        family.add(spark.createDataFrame([(0, 0, b, b), (1, 2, 99, b)], "head long, next long, key long, context long"))
        seen.append([n for n, _ in family.levels])
    assert seen == [[1], [2], [2, 1], [4], [4, 1]]
    assert {r["key"]: r["n"] for r in family.entries().groupBy("key").agg(F.sum("n").alias("n")).collect()}[99] == 5


# --- op9 ---


def test_tree_weighting(docs, none):
    out = tree_weighting.score(docs, language_id.fold(F.col("doc_id"), 5) != 1).collect()
    train = [r for r in rows() if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5 != 1]
    c, ends = Counter(t for r in train for t in tokens(r[1])), len(train)
    n, v = sum(c.values()) + ends, len(c) + 1
    base = lambda k: math.log10((k + 0.5) / (n + 0.5 * (v + 1)))
    wanted = Counter((key(r[0]), len(tokens(r[1])) + 1, sum(c[t] > 0 for t in tokens(r[1])) + 1, round(sum(base(c[t]) for t in tokens(r[1])) + base(ends), 6)) for r in rows())
    assert Counter((key(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in out) == wanted
    assert all(r["train_tokens"] == n and r["score"] < 0 and r["bits_per_byte"] > 0 for r in out)
    assert tree_weighting.score(none, F.lit(True)).count() == 0
    assert all(r["n_known"] == 0 for r in tree_weighting.score(docs, F.lit(False)).collect())


def stream(text):
    return b"\n" * tree_weighting.DEPTH + b"".join(w.encode() + b" " for w in tokens(text)) + b"\n"


def brute_tree_score(train, text):
    """log10 of the probability of a text under a context tree of all training texts, node by node."""
    deep = tree_weighting.DEPTH
    counts = [{} for _ in range(deep + 1)]

    def steps(s):
        for p in range(deep, len(s)):
            for t in range(8):
                yield p, 1 << t | s[p] >> 8 - t, s[p] >> 7 - t & 1

    for s in map(stream, train):
        for p, prefix, bit in steps(s):
            for d in range(deep + 1):
                counts[d].setdefault((s[p - d : p], prefix), [0, 0])[bit] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.lgamma(n[0] + n[1] + 1) - math.log(math.pi)
    weight, stop = [{} for _ in counts], [{} for _ in counts]
    for d in range(deep, -1, -1):
        below = Counter()
        if d < deep:
            for (context, prefix), w in weight[d + 1].items():
                below[context[1:], prefix] += w
        for node, n in counts[d].items():
            weight[d][node] = kt(n) if d == deep else np.logaddexp(kt(n), below[node]) - math.log(2)
            stop[d][node] = 1.0 if d == deep else math.exp(kt(n) - math.log(2) - weight[d][node])
    total, s = 0.0, stream(text)
    for p, prefix, bit in steps(s):
        chance = None
        for d in range(deep, -1, -1):
            node = (s[p - d : p], prefix)
            if node in counts[d]:
                n = counts[d][node]
                own = (n[bit] + 0.5) / (sum(n) + 1)
                chance = own if chance is None else stop[d][node] * own + (1 - stop[d][node]) * chance
        total += math.log10(0.5 if chance is None else chance)
    return total


@pytest.mark.parametrize("heavy", [16, 1 << 20])
def test_tree_scores_against_brute_force(spark, monkeypatch, heavy):
    monkeypatch.setattr(tree_weighting, "HEAVY", heavy)
    texts = [(i, t) for i, t in enumerate([prose(30, 70), "the cat sat", "the cat sat on the mat", None, "", "mat the on sat cat the", "añ ß", "The  Cat\nsat", prose(25, 71), "zz" * 40])]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    train = [t for i, t in texts if i % 3 != 1]
    found = {r["doc_id"]: r["score"] for r in tree_weighting.score(df, F.col("doc_id") % 3 != 1).collect()}
    for i, t in texts:
        assert math.isclose(found[i], brute_tree_score(train, t), rel_tol=1e-9), i
    assert found[2] != found[5]  # the order of words counts


def test_tree_is_a_distribution_over_bytes():
    column = pa.array(["aab ab abcabcabc", "ba b", None, ""])
    codes = np.concatenate([tree_weighting.stream_codes(w)[0] for w in words.words_of(column)])
    unique, counts = np.unique(codes, return_counts=True)
    levels = tree_weighting._levels(unique, counts.astype(float), 0)
    for context in {int(c) >> 8 for c in unique}:
        every = np.array([context << 8 | s for s in range(256)], np.int64)
        assert math.isclose((10.0 ** tree_weighting.code_scores(every, levels)).sum(), 1.0, rel_tol=1e-9)


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 50, 5000))
    table = tree_weighting.Lookup(keys[::2], np.arange(len(keys[::2])) + 1)
    hit, value = table.find(keys)
    assert hit[::2].all() and not hit[1::2].any() and (value[::2] == np.arange(len(keys[::2])) + 1).all() and not value[1::2].any()
    assert not tree_weighting.Lookup(keys[:0], keys[:0]).find(keys)[0].any()


def test_kt_and_lgamma():
    x = np.array([0.5, 1.0, 3.5, 20.0, 1e6])
    assert np.allclose(tree_weighting._lgamma(x), [math.lgamma(v) for v in x])
    assert math.isclose(math.exp(tree_weighting.log_kt(np.array([1.0]), np.array([0.0]))[0]), 0.5)


# --- op10 ---


@pytest.mark.parametrize("clash", [False, True])
def test_block_naming(spark, docs, none, clash):
    if clash:  # a hash with three values: names must come from the contents
        named = exact_dedup.block_names(docs.select(F.col("doc_id").alias("id"), "text"), 16, lambda c: F.pmod(F.xxhash64(c), F.lit(3)).cast("long")).collect()
        by: dict[tuple, set] = {}
        for r in named:
            by.setdefault((r["n_bytes"], r["name"]), set()).add(bytes(r["sha"]))
        assert all(len(s) == 1 for s in by.values()) and len(named) == len(rows())
        assert len(by) == len({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows()})
        return
    out = exact_dedup.exact_groups(docs, block=64).collect()
    groups: dict[str, list] = {}
    for r in rows():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    wanted = Counter((key(i), key(min((v for v in ids if v is not None), default=None)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    assert Counter((key(r["doc_id"]), key(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out) == wanted
    assert sum(r["kept"] for r in out) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(none).count() == 0


def test_shared_tokens_across_batches():
    r = random.Random(5)
    data = sorted((r.randint(0, 30), r.randint(0, 3)) for _ in range(200))
    wanted = {t for t in {t for t, _ in data} if len({n for u, n in data if u == t}) > 1}
    for size in (1, 2, 7, 200):
        batches = [pa.RecordBatch.from_pydict({"token": [t for t, _ in data[i : i + size]], "node": [n for _, n in data[i : i + size]]}) for i in range(0, 200, size)]
        got = [(t, n) for b in ngram_join._shared(iter(batches)) for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        assert set(got) == {(t, n) for t, n in data if t in wanted}
