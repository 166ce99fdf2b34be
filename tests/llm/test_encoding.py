"""Token files, tree BPE and media columns against the library and exact round trips."""

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortlab.llm import _units, media_png, simple8b, tree_bpe

from .conftest import TEXTS

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@given(st.lists(st.one_of(st.integers(0, 60000), st.integers(0, 1), st.integers(0, 2**64 - 1)), max_size=400))
def test_words_hold_all_ids(ids):
    a = np.array(ids, np.uint64)
    assert (simple8b.unpack(simple8b.pack(a)) == a).all()
    assert (simple8b.read_block(simple8b.block_bytes(a)) == a).all()


def test_words_are_full():
    assert len(simple8b.pack(np.ones(60, np.uint64))) == 1
    assert len(simple8b.pack(np.full(4, 32767, np.uint64))) == 1
    assert len(simple8b.pack(np.array([2**63], np.uint64))) == 2


@pytest.mark.parametrize("path, make", [(WORD, _units.word_encoder), (BYTE, tree_bpe.TreeEncoder)])
def test_units_give_the_library_s_ids(path, make):
    rnd, enc, lib = random.Random(3), make(path), Tokenizer.from_file(path)
    pieces = ["the", "in", "Ing", "é", "é", "ß", "日", "!", "***", " ", "  ", "\n", "\t", "'s", "'S", "12", "<|endoftext|>", "\x1c", " ", "ﬁ", "İ", "ª", "²", "_"]
    texts = [t or "" for t in TEXTS] + ["".join(rnd.choices(pieces, k=rnd.randrange(60))) for _ in range(400)]
    found = enc.encode(texts)
    for a, z, text in zip(found.bounds(), found.bounds()[1:], texts, strict=False):
        assert found.ids[a:z].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_words_are_learned_once_whatever_mark_follows(monkeypatch):
    enc, lib = _units.word_encoder(WORD), Tokenizer.from_file(WORD)
    whole, seen = enc._whole, []
    monkeypatch.setattr(enc, "_whole", lambda units: seen.extend(map(str, units)) or whole(units))
    text = "Thé ÉTÉ, straße. naïve! Ünder; the: été? été, (thé) the*** THE%%% été's don't"
    assert enc.encode([text]).ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert sorted(seen) == sorted(["%%%", "'s", "'t", "***", "!", " (thé", ")", ",", ".", ":", ";", "?"])


@pytest.mark.parametrize("seed", range(4))
def test_cuts_at_marks_are_exact(seed):
    rnd, enc, lib = random.Random(seed), _units.word_encoder(WORD), Tokenizer.from_file(WORD)
    letters, marks = ["a", "S", "re", "É", "ÿ", "×", "÷", "ß", "ª", "İ", "ſ", "Ā", "e\u0301", "日", "1"], ["'", "''", "|", "<", ">", "_", ",", "=\u0338", "\u0301", " ", "\n", "\x85", "\xa0"]
    special = ["<|endoftext|>", "<|startoftext|>", "<|END", "oftext|>", "<|endoftext"]
    texts = ["".join(rnd.choices(rnd.choice([letters + marks, [*letters, *marks, *special], ["a", "t", *special, "|", ">"]]), k=rnd.randrange(1, 40))) for _ in range(1000)]
    found = enc.encode(texts)
    for a, z, text in zip(found.bounds(), found.bounds()[1:], texts, strict=False):
        assert found.ids[a:z].tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_cache_forgets():
    enc, lib = _units.UnitEncoder(WORD, _units.word_cuts, most=20), Tokenizer.from_file(WORD)
    rnd = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rnd.choices("abcdefg", k=4)) for _ in range(30))
        assert enc.encode([text]).ids.tolist() == lib.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("leaf", [1, 2, 3, 5, 17])
def test_joins_are_exact(leaf):
    rnd, enc, lib = random.Random(leaf), tree_bpe.TreeEncoder(BYTE, leaf=leaf), Tokenizer.from_file(BYTE)
    kinds = [["in", "the", "er", "a", "ing", "é", "日", "--", "0", "<|endoftext|>"], ["a", " ", "  ", "\n", "\t", "'s", "'", "r", "e", "l", "12", "!", "\u3000", "é", "<|end", "oftext|>"], [" word", " Other", ",", ".", "\n\n", "don't", "x"]]
    texts = ["".join(rnd.choices(rnd.choice(kinds), k=rnd.randrange(1, 70))) for _ in range(300)] + ["z" * 700, " " * 90 + "x", "'" * 40 + "re", "", "ab" * 200 + "\n" * 50]
    for text, ids in zip(texts, enc.encode_texts(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids, text
        assert enc.decode_all([ids])[0].decode() == lib.decode(ids.tolist(), skip_special_tokens=False)
    assert enc.joins > 1000 and enc.windows > 50


def test_ordinary_texts_go_through_the_tree():
    import pyarrow.parquet as pq

    enc, lib = tree_bpe.TreeEncoder(BYTE), Tokenizer.from_file(BYTE)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    for text, ids in zip(texts, enc.encode_texts(texts), strict=True):
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids
    assert enc.joins >= sum(len(t) // tree_bpe.LEAF for t in texts) > 0 and enc.windows > 0


def test_round_trip(spark, docs, empty):
    lib = Tokenizer.from_file(BYTE)
    for spread in (1000, tree_bpe.SPREAD):  # with and without leaves as rows
        got = sorted(map(tuple, tree_bpe.round_trip(docs, BYTE, spread=spread).collect()), key=repr)
        want = []
        for r in docs.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want.append((r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want, key=repr)
    assert tree_bpe.round_trip(empty, BYTE).count() == 0
    texts = {(r.doc_id, r.text) for r in tree_bpe.decode_ids(tree_bpe.encode_texts(docs, BYTE), BYTE).collect()}
    assert texts == {(r.doc_id, r.text or "") for r in docs.collect()}


def test_token_files(spark, docs, empty):
    lib = Tokenizer.from_file(WORD)
    got = simple8b.token_files(docs, WORD, 1).toPandas().sort_values("start")
    start = 0
    want = {}
    for r in docs.collect():
        ids = [*lib.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    ids = [None if x != x else int(x) for x in got["doc_id"].astype(float)]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i) and len(ids) == docs.count()
    for i, s, n, crc in zip(ids, got["start"], got["n_tokens"], got["ids_crc32"], strict=True):
        assert s == start and (n, crc) in want[i]
        start += n
    assert simple8b.token_files(empty, WORD).count() == 0


def test_long_texts_and_many_files(spark):
    lib, long = Tokenizer.from_file(WORD), "Ab cde, é " * 3000
    df = spark.createDataFrame([(i, t) for i, t in enumerate([long, "x", "q" * 5000, long, None])], "doc_id long, text string").repartition(1)
    from cohortlab.llm._common import fresh_path

    root = fresh_path(spark, "tokens")
    listing = simple8b.write_token_files(df, root, WORD, 1, tasks=2, file_ids=4000, slice_bytes=1000)
    assert listing.count() > 2
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in simple8b.read_token_files(listing, root).collect()}
    start = 0
    for i, t in enumerate([long, "x", "q" * 5000, long, None]):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        assert got[i] == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)


def test_files_find_one_document(tmp_path):
    from cohortlab.llm._files import Reader, write_file

    writer, docs = simple8b.Writer(block_ids=10), [(i, np.arange(i * 3, dtype=np.uint32)) for i in range(9)]
    chunks = [c for i, x in docs for c in writer.add([i], x, np.array([len(x)]))] + list(writer.close())
    size = write_file(str(tmp_path), "x", chunks)
    assert [(i, ids.tolist()) for i, _, ids in simple8b.read_documents(Reader(str(tmp_path)), "x", size)] == [(i, ids.tolist()) for i, ids in docs]
    with pytest.raises(ValueError):
        write_file(str(tmp_path), "y", [b"0" * 100])
        simple8b.read_directories(Reader(str(tmp_path)), "y", 100)


def filtered(rows, kind):
    """PNG filters by definition, pixel by pixel."""
    out = []
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else [0] * len(row)
        line = []
        for x, v in enumerate(row):
            a, b, c = (row[x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((v - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out.append(line)
    return out


def test_all_filters_are_undone():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 256, (40, 7), dtype=np.uint8)
    kinds = rng.integers(0, 5, 40).astype(np.uint8)
    each = [np.array(filtered(rows.tolist(), k), np.uint8) for k in range(5)]
    assert (media_png.unfilter(kinds, np.array([each[k][y] for y, k in enumerate(kinds)])) == rows).all()


def test_png_of_many_stripes(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(0, 7, 64 * 1000, dtype=np.uint8).tobytes()
    whole, want = media_png.encode_png(data), media_png.cosine_hash(np.frombuffer(data, np.uint8).reshape(-1, 64))
    monkeypatch.setattr(media_png, "STRIPE", 7)
    assert media_png.encode_png(data) == whole and media_png.decode_png(whole).tobytes() == data
    assert media_png.cosine_hash(np.frombuffer(data, np.uint8).reshape(-1, 64)) == want


def brute_hash(payload):
    """The feature by definition: box means, then every cosine sum, sample by sample."""
    import math
    from fractions import Fraction

    rows = [payload[i : i + 64] for i in range(0, len(payload), 64)]

    def boxes(n):
        for k in range(32):
            lo = min(math.floor(Fraction(k * n, 32)), n - 1)
            yield range(lo, max(math.ceil(Fraction((k + 1) * n, 32)), lo + 1))

    small = [[sum(rows[y][x] for y in ys for x in xs) / (len(ys) * len(xs)) for xs in boxes(64)] for ys in boxes(len(rows))]
    wave = [[math.cos(math.pi * (i + 0.5) * k / 32) for i in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return int("".join("1" if c > middle else "0" for c in low), 2).to_bytes(8, "big")


def test_feature_and_stored_form_by_definition():
    rng = np.random.default_rng(4)
    for n in (1, 3, 31, 40, 77):
        payload = bytes(rng.integers(32, 127, 64 * n, dtype=np.uint8))
        assert media_png.cosine_hash(np.frombuffer(payload, np.uint8).reshape(-1, 64)) == brute_hash(payload)
        png = media_png.encode_png(payload)
        rows, lines = [list(payload[i : i + 64]) for i in range(0, len(payload), 64)], b""
        for y in range(n):
            tries = [filtered(rows[: y + 1], k)[y] for k in range(3)]
            best = min(range(3), key=lambda k: sum(min(v, 256 - v) for v in tries[k]))
            lines += bytes([best, *tries[best]])
        assert zlib.decompress(b"".join(c for k, c in chunks_of(png) if k == b"IDAT")) == lines


def chunks_of(png):
    at = 8
    while at < len(png):
        n = int.from_bytes(png[at : at + 4], "big")
        yield png[at + 4 : at + 8], png[at + 8 : at + 8 + n]
        at += 12 + n


@settings(deadline=None, max_examples=30)
@given(st.binary(min_size=0, max_size=900))
def test_png_keeps_bytes_and_tells_damage(data):
    data += bytes(-len(data) % 64 or (0 if data else 64))
    png = media_png.encode_png(data)
    assert media_png.decode_png(png).tobytes() == data
    broken = bytearray(png)
    broken[len(png) // 2] ^= 1
    with pytest.raises(media_png.PngError):
        media_png.decode_png(bytes(broken))
    with pytest.raises(media_png.PngError):
        media_png.decode_png(png[:-5])


def test_media(spark, docs, empty):
    got = media_png.media_features(docs).toPandas()
    by_text = {}
    for r in docs.collect():
        t = (r.text or "").encode()
        payload = t + bytes(-len(t) % 64 or (0 if t else 64))
        rows = got[got.doc_id == r.doc_id] if r.doc_id is not None else got[got.doc_id.isna()]
        row = rows.iloc[0]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        key = (row.media_sha256, row.feature, row.media_bytes)
        assert by_text.setdefault(t, key) == key and len(row.feature) == 16
    assert media_png.media_features(empty).count() == 0


def test_hash_is_low_frequency():
    rng = np.random.default_rng(1)
    low = rng.normal(0, 12, (8, 8)) * (1 + np.arange(64).reshape(8, 8) % 2)
    a = 128 + media_png._cosines(200, 8).T @ low @ media_png._cosines(64, 8)
    bits = lambda s: np.unpackbits(np.frombuffer(media_png.cosine_hash(s.clip(0, 255).astype(np.uint8)), np.uint8))
    assert (bits(a) != bits(a + rng.normal(0, 4, a.shape))).sum() <= 6 < (bits(a) != bits(rng.uniform(0, 255, a.shape))).sum()
