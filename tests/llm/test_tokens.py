"""Token counts, byte-level BPE and packing against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from propgraph.llm import bpe, packing, queries, token_counts
from propgraph.llm.pretokens import Memo, compiled, pretokens

JSON, RANKS, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
PATTERN = public_tokenizers.PATTERN
PIECES = ["a", "B ", " ", "\n", "'S", "'s", "!", "É", "é", "1", "  ", "ing", "<|endoftext|>", "<|startoftext|>", "<|", "ü", "\t", "日", "Σ", "İ", "ß", "\xa0", "Don't", "\x1c", "\x85", "é", "λ", "\U0001f600", "x" * 90, "привет", " мир", "\u3000", "\u2028", "\u200b", "\u180e", "กข", "'", "\u0301", "한", " \n", "…"]
texts = st.lists(st.sampled_from(PIECES), max_size=60).map("".join)


@pytest.fixture(scope="module")
def libraries():
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.vocabulary(RANKS), special_tokens={})
    return Tokenizer.from_file(JSON), own, Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return token_counts._counter(JSON, token_counts.proven_whole(JSON))


@settings(max_examples=300, deadline=None)
@given(text=texts, size=st.integers(8, 80), overlap=st.integers(1, 8))
def test_same_ids_as_the_libraries(libraries, counter, text, size, overlap):
    full, ranks, words = libraries
    assert counter(text) == len(full.encode(text, add_special_tokens=False).ids)
    want = ranks.encode_ordinary(text)
    assert np.frombuffer(bpe.encode_text(text, RANKS, PATTERN), "<i4").tolist() == want
    parts = [(s, t, *bpe.encode_chunk(s, t, RANKS, PATTERN)) for s, t in bpe.cut(text, size, overlap)]
    assert np.frombuffer(bpe.stitch(parts, RANKS, PATTERN), "<i4").tolist() == want
    assert np.frombuffer(packing.word_ids(text, WORDS), "<u4").tolist() == words.encode(text, add_special_tokens=False).ids


def test_long_runs_are_stitched(libraries):
    r = random.Random(1)
    for _ in range(60):
        text = "".join(r.choice(["x", " ", "1", "!", "ab "]) * r.randint(1, 90) for _ in range(12))
        parts = [(s, t, *bpe.encode_chunk(s, t, RANKS, PATTERN)) for s, t in bpe.cut(text, 64, 8)]
        assert np.frombuffer(bpe.stitch(parts, RANKS, PATTERN), "<i4").tolist() == libraries[1].encode_ordinary(text)


def test_safe_characters_agree(libraries, counter):
    """On the characters that are not handed over, this module's cuts are the library's."""
    full, _, words = libraries
    for c in [*range(1, 0x250), *range(0x2010, 0x2028), *range(0x20A0, 0x20C0), *range(0x3041, 0x3097), *range(0x4E00, 0x4E80)]:
        s = f"a{chr(c)}1{chr(c)}{chr(c)} x"
        assert np.frombuffer(packing.word_ids(s, WORDS), "<u4").tolist() == words.encode(s, add_special_tokens=False).ids, hex(c)
        assert counter(s) == len(full.encode(s, add_special_tokens=False).ids), hex(c)


def test_only_stretches_are_handed_over():
    find = compiled(PATTERN).findall
    assert pretokens("one two \U0001f600! three\n\nλ four", find) == ["one", " two", " \U0001f600!", " three", "\n\nλ", " four"]
    assert pretokens("a\u3000 b \u3000", find) == ["a\u3000 b", " \u3000"]  # white space that the libraries may join


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("propgraph.llm.pretokens.MEMO_PIECES", 10)
    memo = Memo(str.upper, {"k": "K"})
    assert [memo[c] for c in "abcdefghijklmnopqrstuvwxyz" * 2] == list("ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 2)
    assert len(memo) + len(memo.old) <= 14 and memo["k"] == "K"


ODD = [(1, "a b <|endoftext|> c", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "word", "y"), (4, "abc " * 30_000, "z"), (5, "λ" * 40_000, "z"), (6, "мир and word, " * 6_000, "z")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, n_tokens string")


def test_counts_of_odd_rows(odd, libraries):
    rows = token_counts.count_tokens(odd, JSON).collect()
    want = sorted((r[0] or 0, len(libraries[0].encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == want
    assert token_counts.count_tokens(odd.limit(0), JSON).count() == 0


def test_round_trip_of_odd_rows(odd, libraries):
    coded = bpe.encode(odd, RANKS, PATTERN)
    rows = bpe.decode(coded, RANKS).collect()
    assert sorted((r["doc_id"] or 0, bytes(r["decoded"]).decode()) for r in rows) == sorted((r[0] or 0, r[1] or "") for r in ODD)
    ids = {r["doc_id"]: r["ids"] for r in rows}
    assert ids[4] == libraries[1].encode_ordinary(ODD[5][1]) and ids[2] == []
    assert all(ids[r[0]] == libraries[1].encode_ordinary(r[1]) for r in ODD[6:])
    assert bpe.encode(odd.limit(0), RANKS, PATTERN).count() == 0


def test_first_fit_decreasing():
    r = random.Random(2)
    for _ in range(100):
        lengths = np.array([r.choice([64, r.randint(1, 64), r.randint(1, 5)]) for _ in range(r.randint(0, 80))], "i8")
        bins, offsets = packing.first_fit_decreasing(lengths, 64)
        room = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, x in enumerate(room) if x >= lengths[i]), len(room))
            room += [64] if k == len(room) else []
            assert (bins[i], offsets[i]) == (k, 64 - room[k])
            room[k] -= lengths[i]


def check_packing(rows, texts, words):
    ids = {d: words.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts.items()}
    covered, sequences = {d: [] for d in ids}, {}
    for r in rows:
        piece = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        covered[r["doc_id"]] += range(r["start"], r["start"] + r["length"])
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sorted(c) == list(range(len(ids[d]))) for d, c in covered.items())
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_packing(spark, sf, libraries):
    rows = queries.op8_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    used = check_packing(rows, texts, libraries[2])
    assert sum(r["length"] for r in rows) / (2048 * len(used)) > 0.9


def test_no_ids_no_piece(spark):
    rows = spark.createDataFrame([(1, bytearray(b"")), (2, bytearray(b"\1\0\0\0" * 5))], "doc_id long, ids binary")
    assert [tuple(r) for r in packing.pieces(rows, 3).select("doc_id", "start", "length").orderBy("start").collect()] == [(2, 0, 3), (2, 3, 2)]


def test_packing_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, "word " * 5000), (3, "")], "doc_id long, text string")
    cut = packing.pieces(packing.tokenise(df, WORDS))
    rows = packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")), ["doc_id", "start"], 2).collect()
    check_packing(rows, {1: "", 2: "word " * 5000, 3: ""}, Tokenizer.from_file(WORDS))
    assert packing.pack(cut.limit(0), ["doc_id", "start"], 1).count() == 0


def test_digest_queries(spark, sf, libraries):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_bpe_round_trip(spark, sf).collect():
        ids = libraries[1].encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    for r in queries.op1_token_counts(spark, sf).collect():
        n = len(libraries[0].encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"], r["n_bytes"]) == (n, n > 1024, len(texts[r["doc_id"]].encode()))
