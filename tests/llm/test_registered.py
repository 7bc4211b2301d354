"""The registered queries without SQL, as they are registered: columns, types, order and digests, against plain versions."""

import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from skyloom.llm.near_copies import shingle_set
from skyloom.session import table
from test_dedup import brute_components, brute_print
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


@pytest.fixture(scope="module")
def encoded(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: library.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op2(spark, docs):
    out = entry.queries()["op2_decontaminate"](spark, SF)
    assert dict(out.dtypes)["doc_id"] == "bigint" and out.columns[:2] == ["doc_id", "item_id"]
    items = {r.item_id: r.text for r in table(spark, SF, "benchmark").collect()}
    got = {(r.doc_id, r.item_id) for r in out.collect()}
    plain = lambda t: f" {' '.join(t.lower().split())} "
    whole = {(d, i) for d, t in docs.items() for i, x in items.items() if t and len(x.split()) >= 5 and plain(x) in plain(t)}
    assert whole <= got
    for d, i in got:  # and nothing that shares no shingle
        assert len(np.intersect1d(shingle_set(docs[d]), shingle_set(items[i])))


def test_op5(spark):
    out = entry.queries()["op5_length_histogram"](spark, SF)
    rows = out.collect()
    assert max(r.docs_longer + r.docs_fitting for r in rows) == 200 == min(r.docs_longer + r.docs_fitting for r in rows)
    assert all(r.kept_tokens + r.lost_tokens == r.total_tokens for r in rows) and max(r["quantile"] for r in rows) == 1


def test_op7(spark, encoded):
    out = entry.queries()["op7_elias_fano"](spark, SF)
    assert out.dtypes[:4] == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    got, start = {r.doc_id: tuple(r)[1:4] for r in out.collect()}, 0
    for d in sorted(encoded):
        ids = [*encoded[d], 1]
        assert got[d] == (start, len(ids), crc(ids))
        start += len(ids)


def test_op9(spark, docs, encoded):
    out = entry.queries()["op9_packing"](spark, SF)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.collect()
    for r in rows:
        assert r.ids_crc32 == crc([*encoded[r.doc_id], 0][r.start : r.start + r.length])
    assert check_packing(list(docs.items()), rows) <= math.ceil(sum(r.length for r in rows) / 2048 * 1.02)


def test_op10(spark, docs):
    out = entry.queries()["op10_simhash"](spark, SF)
    assert out.dtypes[:3] == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    prints = {d: brute_print(t) % (1 << 64) for d, t in docs.items()}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    label = brute_components(set(prints), close)
    assert got == {d: (f"{prints[d]:016x}", label[d]) for d in docs}
