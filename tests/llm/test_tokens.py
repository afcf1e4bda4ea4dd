"""Encoders, files and packing against the libraries and brute force."""

import base64
import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import Row
from pyspark.sql import functions as F

from cartolith.llm import byte_bpe, packing, token_files
from cartolith.llm.word_tokens import WordTokens, word_tokens

from .fixture import frame, rows

WORDS, BYTES = P.path("word_bpe_49k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


ALPHABET = st.text(st.sampled_from(list("'''sstmdrevel  \n\t .,!1aÉß²\xa0\x85\x1c　你́👍ΣİŉµªA<|>")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(ALPHABET)
def test_word_ids_are_the_librarys(text):
    w = word_tokens(WORDS)
    assert ids_of(w.ids(text.encode())) == w.library.encode(text, add_special_tokens=False).ids


def test_word_cache_turns_over(monkeypatch):
    monkeypatch.setattr("cartolith.llm.word_tokens.CACHE_ENTRIES", 5)
    w = WordTokens(WORDS)
    text = " ".join(f"word{i % 13}" for i in range(100))
    assert ids_of(w.ids(text.encode())) == w.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(ALPHABET, max_size=4))
def test_byte_ids_are_tiktokens(texts):
    bpe = byte_bpe.byte_bpe(BYTES)
    ranks = bpe.ranks
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}) if not hasattr(test_byte_ids_are_tiktokens, "own") else test_byte_ids_are_tiktokens.own
    test_byte_ids_are_tiktokens.own = own
    for (ids, starts), text in zip(bpe.encode_texts([t.encode() for t in texts]), texts):
        assert ids_of(ids) == own.encode_ordinary(text)
        assert bpe.decode_bytes(ids) == text.encode()
        assert bpe.offsets(ids)[-1] == len(text.encode()) and set(starts.tolist()) <= set(bpe.offsets(ids).tolist())


def test_every_code_point_class(tik):
    bpe = byte_bpe.byte_bpe(BYTES)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    texts = [f"a{chr(c)}1{chr(c)} x" for c in points]
    found = bpe.encode_texts([t.encode() for t in texts])
    assert [t for t, (ids, _) in zip(texts, found) if ids_of(ids) != tik.encode_ordinary(t)] == []


def test_long_pieces_merge_alike(tik):
    bpe = byte_bpe.byte_bpe(BYTES)
    rng = random.Random(2)
    for text in ("a" * 5000, "".join(rng.choice("abct") for _ in range(3000)), " " * 777, "é" * 999, "don't" * 500):
        assert bpe.encode(text) == tik.encode_ordinary(text)


def test_scan_equals_stepping():
    own, _, functions, _ = byte_bpe._automaton()
    rng = np.random.default_rng(0)
    for n in (1, 63, 64, 65, 5000):
        kinds = rng.integers(0, 16, n)
        state, expected = 0, []
        for k in kinds:
            state = int(functions[own[k], state])
            expected.append(state)
        assert functions[byte_bpe._prefixes(own[kinds]), 0].tolist() == expected


def test_byte_digests_and_decoding(spark, tik):
    docs = frame(spark)
    found = sorted(map(tuple, byte_bpe.digests(docs, BYTES).collect()), key=str)
    expected = []
    for r in rows():
        ids = tik.encode_ordinary(r[1] or "")
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        expected.append((r[0], len(ids), sha, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    back = byte_bpe.decode(byte_bpe.encode(docs, BYTES), BYTES)
    assert Counter((r.doc_id, bytes(r.data).decode()) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows())
    assert byte_bpe.digests(frame(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("mode", ["byte", "bit"])
def test_planes_round_trip(mode):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, mode), n, mode) == ids).all()
    out = io.BytesIO()
    writer = token_files.Writer(out, mode, block_ids=16)
    docs = [(None, 0), (3, 5), (4, 16), (9, 0), (10, 100)]
    data = {d: rng.integers(0, 50_000, n).astype("<u4") for d, n in docs}
    for d, _ in docs:
        writer.add(d, data[d].tobytes())
    writer.close()
    reader = token_files.Reader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    found = {d: np.concatenate([*parts, np.empty(0, "<u4")]) for d, parts in reader.documents()}
    assert list(found) == [d for d, _ in docs] and all((found[d] == data[d]).all() for d in found)
    assert (reader.block(1) == np.concatenate([data[d] for d, _ in docs])[16:32]).all()
    with pytest.raises(ValueError):
        token_files.Reader(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)


def test_token_files(spark, library, tmp_path):
    found = [tuple(r) for r in token_files.write_and_read(frame(spark), WORDS, 2, str(tmp_path)).collect()]
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expected = 0, []
    for r in ordered:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        expected.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(found, key=lambda r: r[1]) == expected
    assert not [f for f in tmp_path.iterdir() if f.name.startswith(".")]
    assert token_files.write_and_read(frame(spark, []), WORDS).count() == 0


def test_files_are_read_by_few_tasks_and_no_other_workers(spark, library, tmp_path):
    texts = [f"text {i} of many" for i in range(140)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    written = []
    for i, text in enumerate(texts):  # a file each
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], "<u4")
        with open(tmp_path / f"part-{i:06d}.planes", "wb") as out:
            writer = token_files.Writer(out)
            writer.add(i, ids)
            writer.close()
        written.append(Row(part=i, file=f"part-{i:06d}.planes", n_docs=1, n_ids=len(ids)))
    back = token_files.read_back(spark, str(tmp_path), written)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "LocalTableScan" in plan
    assert back.rdd.getNumPartitions() == 9 == -(-140 // token_files.READ_FILES)
    start, expected = 0, []
    for i, r in enumerate(written):
        ids = np.array([*library.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, start, r.n_ids, zlib.crc32(ids.tobytes())))
        start += r.n_ids
    assert sorted(map(tuple, back.collect())) == expected
    assert sorted(map(tuple, token_files.write_and_read(docs, WORDS, 2).collect())) == expected
    assert token_files.read_back(spark, str(tmp_path), written[:3]).rdd.getNumPartitions() == 3


def check_packing(pieces: list, capacity: int) -> int:
    by: dict = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, library):
    found = packing.pack_documents(frame(spark), WORDS, 2048, 0).collect()
    expected = Counter()
    total = 0
    for r in rows():
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected[(r[0], piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in found) == expected
    assert check_packing(found, 2048) <= -(-total // 2048) + 1
    assert packing.pack_documents(frame(spark, []), WORDS).count() == 0


def test_packing_in_groups(spark):
    df = spark.createDataFrame([(i, 0, 0, 1 + i * 37 % 100, i, i) for i in range(400)], packing.CUT)
    found = packing.pack(df, 100, group_pieces=100).collect()
    assert len(found) == 400 and check_packing(found, 100) <= -(-sum(p.length for p in found) // 100) + 12


def test_equal_rows_are_many_groups(spark):
    df = spark.range(200_000).selectExpr("cast(null as long) as doc_id", "0 as piece", "0L as start", "1L as length", "7L as ids_crc32", "id as row")
    sizes = packing.pack(df, 2048, group_pieces=20_000).groupBy((F.col("sequence_id") / (1 << 32)).cast("int")).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 30_000


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=60))
def test_sum_of_squares_by_its_definition(lengths):
    """Against a plain search for the smallest sum of squared counts, among sequences that fit."""
    lengths = np.sort(np.array(lengths, np.int64))[::-1]
    sequence, offset = packing.sum_of_squares(lengths, 30)
    gaps: list[int] = []
    for s, where, at in zip(lengths.tolist(), sequence.tolist(), offset.tolist()):
        def after(k):
            new = [g - s if j == k else g for j, g in enumerate(gaps)]
            return sum(n * n for g, n in Counter(new).items() if 0 < g < 30)

        fits = [k for k, g in enumerate(gaps) if g >= s]
        if not fits:
            assert where == len(gaps) and at == 0
            gaps.append(30)
        else:
            assert after(where) == min(after(k) for k in fits) and at == 30 - gaps[where]
        gaps[where] -= s
        assert gaps[where] >= 0


def test_sequences_hold_their_documents(spark, library):
    docs = spark.createDataFrame([(i, f"hello world {i} " * (i + 1)) for i in range(30)], "doc_id long, text string")
    for r in packing.sequences(docs, WORDS, 64).collect():
        assert len(r.ids) == 64
        for d, at in zip(r.doc_ids, r.offsets):
            ids = [*library.encode(f"hello world {d} " * (d + 1), add_special_tokens=False).ids, 0]
            assert any(r.ids[at : at + min(64, len(ids[k:]))] == ids[k : k + 64][: 64 - at] for k in range(0, len(ids), 64))


def test_caches_of_a_worker_stay_small():
    """Two caches a worker and two workers an executor: however many keys are seen, each stays below 100 MB."""
    import tracemalloc

    from cartolith.llm.word_tokens import Generations

    tracemalloc.start()
    cache = Generations(lambda key: key[:4])
    for k in range(1_150_000):
        assert cache[b"%08d" % k] == b"%04d" % (k // 10_000)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert size < 100e6 and len(cache) + len(cache.older) > 200_000
