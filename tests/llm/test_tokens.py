import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyloom.llm import length_histogram as L
from skyloom.llm import packing as P
from skyloom.llm import token_store as T
from skyloom.llm.tokens import WordEncoder, byte_encoder, word_encoder
from skyloom.session import new_path

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
TEXTS = ["Ünder the Sea's  end... 12 don't!", None, "", "word " * 5000, "x", "İstanbul ΟΔΟΣ é <|endoftext|>", " \x1c a\x85b"]


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aAbzZéÉßΣσİı̱́HK .,;'!?1٣\n\t\r\x0b\x1c\xa0 <|>중"), max_size=30), max_size=6))
def test_pieces_encode_like_whole_texts(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in word_encoder(PATH).encode(texts)]
    assert got == [ids_of(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endo\u0301", "<|", "a", " ", "É", "'s", "\n"]), max_size=8).map("".join), max_size=5))
def test_strings_of_special_tokens_are_read_as_the_library_does(texts):
    got = [np.frombuffer(b, "<u4").tolist() for b in word_encoder(PATH).encode(texts)]
    assert got == [ids_of(t) for t in texts]


def test_words_are_encoded_once():
    """200,000 words met twice are encoded once, and looked up once for each time that they're met; no place stays empty after an error."""
    encoder = WordEncoder(PATH)
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(200_000)]
    new, encode = [], encoder._encode_words
    encoder._encode_words = lambda some: (new.append(len(some)), encode(some))
    texts = [" ".join(words[a : a + 1000]) for a in range(0, len(words), 1000)]
    first, again = ([x for a in range(0, 200, 50) for x in encoder.encode(texts[a : a + 50])] for _ in range(2))
    assert first == again and sum(new) == len(words) and not encoder.kept.new
    encoder._encode_words = None
    with pytest.raises(TypeError):
        encoder.encode(["unseenword"])
    encoder._encode_words = encode
    assert encoder.encode(["unseenword"]) == WordEncoder(PATH).encode(["unseenword"]) != [b""]


def test_long_pieces_are_not_kept():
    encoder = word_encoder(PATH)
    long = ["x" * 5000, "y" * 300 + "!", "1" * 90, "é" * 60 + "..."]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(long * 2)] == [ids_of(t) for t in long * 2]
    assert max(map(len, encoder.kept)) <= 40


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=300))
def test_elias_fano_round_trip(steps):
    values = np.cumsum(np.array(steps, np.int64)) if steps else np.zeros(0, np.int64)
    ef = T.EliasFano.encode(values)
    assert ef.select_all().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.full(4096, 900))
    ef = T.EliasFano.encode(values)
    assert 8 * (len(ef.low) + len(ef.high) + len(ef.marks)) < 4096 * 13


def test_store_round_trip(spark, docs_of):
    rows = [(i * 7 % 101, TEXTS[i % len(TEXTS)]) for i in range(40)] + [(None, "null id"), (-(2**63), "least"), (2**63 - 1, "most"), (5000, "same"), (5000, "same")]
    path = new_path(spark, "store")
    T.write_store(docs_of(rows), path, PATH, chunk_docs=3)
    got = sorted(T.read_boundaries(spark, path).collect(), key=lambda r: r["start"])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    assert [r["doc_id"] for r in got] == [r[0] for r in order]
    at = 0
    for r, (_, text) in zip(got, order):
        ids = np.array([*ids_of(text), 1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_shards_follow_the_order_and_split_a_frequent_id():
    ids = pa.array([None, -(2**63), 1, 5, 5, 5, 5, 6, None, -(2**63)], pa.int64())
    hashes = np.array([2**62, 0, 9, -(2**63), -(2**61), 0, 2**63 - 1, 0, -(2**63), -(2**63)], np.int64)
    for bounds in ([], [5], [5, 5, 5], [-(2**63), -(2**63), 1, 5]):
        shard = T.shards_of(ids, hashes, np.array(bounds, np.int64))
        order = sorted(range(len(ids)), key=lambda i: (ids[i].is_valid, ids[i].as_py() or 0, hashes[i]))
        assert (np.diff(shard[order]) >= 0).all() and shard.max() <= len(bounds)
    assert sorted(T.shards_of(ids, hashes, np.array([5, 5, 5]))[3:7].tolist()) == [0, 1, 2, 3]


def test_empty_store(spark, docs_of):
    path = new_path(spark, "store")
    T.write_store(docs_of([]), path, PATH)
    assert T.read_boundaries(spark, path).count() == 0


def check_packing(rows, got, capacity=2048):
    want = Counter()
    for doc, text in rows:
        ids = np.array([*ids_of(text), 0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            want[doc, k, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_is_whole_and_tight(docs_of):
    rng = np.random.default_rng(3)
    rows = [(i, "the " * int(rng.integers(0, 3000))) for i in range(400)] + [(None, None), (3, "again"), (3, "again")]
    got = P.pack_documents(docs_of(rows).repartition(6), PATH).collect()
    used = check_packing(rows, got)
    assert used <= math.ceil(sum(r["length"] for r in got) / 2048 * 1.02)


def test_packing_in_bounded_rounds(docs_of, monkeypatch):
    monkeypatch.setattr(P, "TASK_ITEMS", 20)
    rows = [(i, "the " * 1500) for i in range(150)]
    got = P.pack_documents(docs_of(rows).repartition(5), PATH).collect()
    assert check_packing(rows, got) == 150


def test_packing_nothing(docs_of):
    assert P.pack_documents(docs_of([]), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_fills_bins(sizes):
    bins = P.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    assert len(bins) <= max(1, math.ceil(11 / 9 * sum(sizes) / 50 + 2)) + sum(s > 25 for s in sizes)


def test_histogram_answers_every_limit(docs_of, monkeypatch):
    monkeypatch.setattr(L, "WIDTH", 4)
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, "ab cd " * (i % 13)) for i in range(60)] + [(None, None), (1, "x" * 20000)]
    encode = byte_encoder(ranks, public_tokenizers.PATTERN).encode_ordinary
    lengths = [len(encode(t or "")) for _, t in rows]
    got = L.context_totals(L.length_counts(docs_of(rows), ranks, public_tokenizers.PATTERN)).collect()
    assert sorted(r["context"] for r in got) == sorted(set(lengths))
    for r in got:
        c = r["context"]
        assert r["n_docs"] == lengths.count(c)
        assert r["docs_longer"] == sum(n > c for n in lengths) and r["docs_fitting"] == sum(n <= c for n in lengths)
        assert r["kept_tokens"] == sum(min(n, c) for n in lengths) and r["total_tokens"] == sum(lengths)
        assert r["lost_tokens"] == r["total_tokens"] - r["kept_tokens"]
        assert r["quantile"] == r["docs_fitting"] / len(rows)
    assert L.context_totals(L.length_counts(docs_of([]), ranks, public_tokenizers.PATTERN)).count() == 0
