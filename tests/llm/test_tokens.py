"""Wavelet shards and packing against plain encoding."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from roadpulse.llm import packing as P
from roadpulse.llm import tokens as T
from roadpulse.llm import wavelet as W
from roadpulse.llm.common import shared_folder

from .fixtures import edge_docs, edge_texts, no_docs


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(T.tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ODD = ["it's I'LL we'd x--, don't?!", "a b c", "<|endoftext|> <|STARTOFTEXT|>x", "é É K", "\x01 \x01a", "’s 'S", "a" * 500, "½ ² ٣ x1y2", "word.\x85next", "ÉCOLE, Straße; İ"]


def test_chunks_encode_as_the_whole(plain):
    enc = T.Encoder(T.tokenizer_path(), kept=50)
    texts = [*edge_texts(), *ODD]
    for _ in range(2):
        for text, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain(text), text


def test_capitals_before_combining_marks(plain):
    enc = T.Encoder(T.tokenizer_path())
    marks = [chr(m) for m in range(0x300, 0x370)]
    texts = [f"x{c}{m}y. {c}{m}" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for m in marks]
    # A mark of another class between does not block the composition.
    texts += [f"AB{c}\u0323{m} Tür {c.lower()}{m}" for c in "HJTWY" for m in marks]
    for _ in range(2):
        for text, got in zip(texts, enc.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == plain(text), ascii(text)


def test_wavelet_matrix():
    r = random.Random(2)
    for n, top in ((0, 5), (1, 0), (2000, 300), (777, 49407)):
        v = np.array([r.randint(0, top) for _ in range(n)], np.uint32)
        m = W.unpack_shard(W.pack_shard([None, 5], [n, 0], v)).matrix
        assert m.decode().tolist() == v.tolist()
        for i in r.sample(range(n), min(n, 50)):
            assert m.access(i) == v[i]
            x = int(v[i])
            places = np.flatnonzero(v == x).tolist()
            assert m.count(x) == len(places) and m.count(x, 3, n) == sum(p >= 3 for p in places)
            assert [m.find(x, k) for k in range(min(5, len(places)))] == places[:5]
        assert m.count(top + 1) == 0
        with pytest.raises(IndexError):
            m.find(top + 1, 0)


@pytest.mark.parametrize("shard_ids", [100, W.SHARD_IDS])
def test_shards_round_trip(spark, plain, shard_ids):
    docs, rows = edge_docs(spark)
    folder = shared_folder(spark, "w")
    manifest = W.write_shards(docs, folder, T.tokenizer_path(), shard_ids=shard_ids)
    got = [tuple(r) for r in W.read_shards(spark, folder, manifest).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in ordered:
        ids = [*plain(r[1]), 2]
        want.append((r[0], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_empty(spark):
    assert W.encode_and_read(no_docs(spark)).count() == 0
    assert P.pack(no_docs(spark)).count() == 0


def test_packing(spark, plain):
    docs, rows = edge_docs(spark)
    got = P.pack(docs).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    want = []
    for r in rows:
        ids = [*plain(r[1]), 0]
        want += [(r[0], i, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for i, a in enumerate(range(0, len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    filled = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert filled.get(r["sequence_id"], 0) == r["offset"]
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    assert len(filled) == -(-sum(r["length"] for r in got) // 2048)


def fewest(counts, capacity):
    """By trying everything, for a handful of pieces."""
    pieces = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
    best = [len(pieces)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= pieces[i] and bins[k] not in bins[:k]:
                put(i + 1, [*bins[:k], bins[k] - pieces[i], *bins[k + 1 :]])
        put(i + 1, [*bins, capacity - pieces[i]])

    put(0, [])
    return best[0]


def test_plan_is_best_on_small_cases():
    r = random.Random(3)
    worse = 0
    for _ in range(150):
        counts = {}
        for _ in range(r.randint(1, 11)):
            n = r.randint(1, 30)
            counts[n] = counts.get(n, 0) + 1
        plan = P.plan(counts, 30)
        used = {}
        for times, filling in plan:
            assert sum(filling) <= 30
            for n in filling:
                used[n] = used.get(n, 0) + times
        assert used == counts
        bins = sum(t for t, _ in plan)
        assert P.lower_bound(counts, 30) <= fewest(counts, 30) <= bins
        worse += bins > fewest(counts, 30)
    assert worse <= 1


def test_search_beats_best_fit():
    counts = {6: 2, 5: 2, 3: 2, 2: 2, 4: 2}  # exact fillings of ten exist
    assert sum(t for t, _ in P.plan(counts, 10)) == 4
