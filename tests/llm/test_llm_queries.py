"""The registered queries of the numbered operators, whole, against their contracts worked out in plain Python over the smallest tables."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import sys
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from seriesloom.llm import queries, transport_media

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs():
    return {r[0]: r[1:] for r in duckdb.sql(f"select doc_id, text, lang, source from '{FOLDER}/documents.parquet'").fetchall()}


def answer(spark, name, docs, one_row=True):
    found = [r.asDict() for r in queries.QUERIES[name](spark, FOLDER).collect()]
    if one_row:
        assert sorted(r["doc_id"] for r in found) == sorted(docs)
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_op2(spark, docs):
    for r in answer(spark, "op2_transport_media", docs):
        text = (docs[r["doc_id"]][0] or "").encode()
        payload = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        media = transport_media.mux(payload)
        units = -(-len(payload) // transport_media.UNIT)
        entries = -(-units // transport_media.GROUP)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert r["feature"] == f"packets={len(media) // 188};units={units};entries={entries};last={(units - 1) * transport_media.TICKS};errors=0"
        assert len(media) % 188 == 0 and all(media[i] == 0x47 for i in range(0, len(media), 188))


def test_op4(spark, docs):
    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, rows = defaultdict(list), answer(spark, "op4_residual_packing", docs, one_row=False)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    assert set(pieces) == set(docs)
    total = 0
    for doc_id, parts in pieces.items():
        ids = [*tokenizer.encode(docs[doc_id][0] or "", add_special_tokens=False).ids, 2]
        total += len(ids)
        parts.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts))) and len(parts) == -(-len(ids) // 1024)
        at = 0
        for r in parts:
            mine = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(mine)}I", *mine))
            assert r["length"] == 1024 or r["piece"] == 0 or len(parts) == 1 or r["piece"] == len(parts) - 1
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(sequences) <= -(-total // 1024) + 2


def targets(sizes):
    """Shares of 150 % of all sizes by weight, each at most twice its source's size."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, done = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        share = (total - sum(done.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if share * weight[s] > 2 * sizes[s]]
        if not over:
            return done | {s: share * weight[s] for s in free}
        done |= {s: 2.0 * sizes[s] for s in over}


def test_op5(spark, docs):
    sizes = {i: len(words(t)) for i, (t, _, _) in docs.items()}
    by_source = Counter()
    for i, (_, _, source) in docs.items():
        by_source[source] += sizes[i]
    wanted, taken = targets(by_source), Counter()
    for r in answer(spark, "op5_pareto_mix", docs):
        source = docs[r["doc_id"]][2]
        assert r["size"] == sizes[r["doc_id"]] and r["source_size"] == by_source[source] and math.isclose(r["target"], wanted[source], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    largest = defaultdict(int)
    for i, (_, _, source) in docs.items():
        largest[source] = max(largest[source], sizes[i])
    assert all(abs(taken[s] - wanted[s]) <= largest[s] for s in wanted)


def test_op6(spark, docs):
    rows, slots, load = answer(spark, "op6_bounded_ring", docs), defaultdict(list), Counter()
    for r in rows:
        text = (docs[r["doc_id"]][0] or "").encode()
        assert r["size"] == len(text) + 16 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and 0 <= r["shard"] < 40 and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean, most = sum(load.values()) / 40, max(r["size"] for r in rows)
    assert max(load.values()) <= mean + most


def test_op7(spark, docs):
    known = {lang for i, (_, lang, _) in docs.items() if lang is not None and remainder(i, 3) != 1}
    right = asked = 0
    for r in answer(spark, "op7_language_id", docs):
        text, lang, _ = docs[r["doc_id"]]
        assert r["held_out"] == (remainder(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in text or "")
        assert r["lang_pred"] in known if letters else r["lang_pred"] == "und"
        if r["held_out"] and lang is not None and letters:
            asked, right = asked + 1, right + (r["lang_pred"] == lang)
    assert asked > 30 and right >= 0.9 * asked


def test_op8(spark, docs):
    raw = {i: (t or "").encode() for i, (t, _, _) in docs.items()}
    seen = Counter(text[k : k + 200] for text in raw.values() for k in range(len(text) - 199))
    for r in answer(spark, "op8_repeated_spans", docs):
        text = raw[r["doc_id"]]
        covered = bytearray(len(text))
        for k in range(len(text) - 199):
            if seen[text[k : k + 200]] > 1:
                covered[k : k + 200] = b"\x01" * 200
        spans = len(re.findall(rb"\x01+", bytes(covered)))
        left = bytes(b for b, gone in zip(text, covered) if not gone)
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(text), sum(covered), spans, hashlib.sha256(left).hexdigest())


def test_op9(spark, docs):
    tokens = {i: [*words((t or "").translate(LOWER)), None] for i, (t, _, _) in docs.items()}
    counts = Counter(w for i, ws in tokens.items() if remainder(i, 5) != 1 for w in ws)
    total, different = sum(counts.values()), len(counts)
    for r in answer(spark, "op9_tree_weighting", docs):
        ws = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (remainder(r["doc_id"], 5) == 1, len(ws), sum(counts[w] > 0 for w in ws), total)
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in ws)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and r["score"] < 0
