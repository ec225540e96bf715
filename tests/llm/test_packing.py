import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessella.llm import packing

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(FILE)


def test_ids_are_the_tokenizers(encoder):
    r = random.Random(4)
    bits = [" ", "  ", "\n", "a", "bc", "É", "!", "\x1c", "\t", "1", "'s", "'S", ".", "　", "<|endoftext|>", "x y", "\x85", "\xa0", "\U0001f600", "été", "ſ"]
    for _ in range(3000):
        text = "".join(r.choice(bits) for _ in range(r.randint(0, 14)))
        assert encoder.ids(text) == encoder.plain(text), repr(text)


def test_hilbert_neighbours_touch():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(grid, 3)
    assert sorted(keys) == list(range(512))
    assert np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


@pytest.mark.parametrize("length", [16, 64])
def test_pieces_cover_every_id_once(spark, documents, encoder, words, length):
    texts = [None, "", "one", words(300, 1), words(5000, 2), "x" * 3000] + [words(20, 3)] * 40 + [words(30, s) for s in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "again"), (7, "again"), (None, "no id")]
    pieces = packing.pack(documents(rows, {"row": 1, "at": 2}), FILE, length).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*encoder.plain(t or ""), 0])
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
        own = [x for x in ids[p.doc_id] if len(x) == p.doc_tokens]
        assert any(zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in own)
    assert sum(p.length for p in pieces) == sum(len(x) for each in ids.values() for x in each)
    for p in pieces:
        if p.doc_id is not None and len(ids[p.doc_id]) == 1:
            mine = sorted((q.start, q.length) for q in pieces if q.doc_id == p.doc_id)
            assert [s for s, _ in mine] == list(np.cumsum([0, *(n for _, n in mine)]))[:-1]
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *(p.length for p in own)]))[:-1]
        size = sum(p.length for p in own)
        assert size == length or size & (size - 1) == 0
    assert sum(sum(p.length for p in own) < length for own in sequences.values()) <= length.bit_length()


def test_empty_table(documents):
    assert packing.pack(documents([]), FILE).count() == 0


def test_like_documents_are_neighbours(spark, documents):
    rows = [(i, ("alpha beta gamma " if i % 2 else "1 2 3 4 5 6 7 ") * (20 + i)) for i in range(60)]
    places = packing.pack(documents(rows), FILE, 1 << 20).orderBy("offset").collect()
    order = [p.doc_id % 2 for p in sorted(places, key=lambda p: (p.sequence_id, p.offset))]
    assert sum(a != b for a, b in zip(order, order[1:], strict=False)) <= 6


def test_order_is_the_curves(spark, documents, encoder, words):
    rows = [(i, words(5 + 13 * i % 70, i % 37)) for i in range(120)] + [(i, "equal text") for i in range(500, 530)] + [(-3, None)]
    histograms = np.array([np.bincount(np.array([*encoder.plain(t or ""), 0]) % packing.BUCKETS, minlength=packing.BUCKETS) for _, t in rows])
    order = sorted(zip(packing.curve_keys(histograms), (i for i, _ in rows), histograms.sum(axis=1), strict=True))
    want = dict(zip((i for _, i, _ in order), np.cumsum([0, *(n for *_, n in order)]), strict=False))
    pieces = packing.pack(documents(rows).repartition(5), FILE, 256).collect()
    sizes = {}
    for p in pieces:
        sizes[p.sequence_id] = sizes.get(p.sequence_id, 0) + p.length
    before = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[s] for s in sorted(sizes))]), strict=False))
    assert {p.doc_id: before[p.sequence_id] + p.offset for p in pieces if p.start == 0} == want


def test_other_tokenizer_files_are_left_to_their_library(tmp_path):
    import json

    file = json.loads(open(FILE).read())
    file["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "low.json").write_text(json.dumps(file))
    low = packing.Encoder(str(tmp_path / "low.json"))
    assert low.quick is None and low.ids("HELLO There") == low.plain("hello there")
