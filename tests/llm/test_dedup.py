import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import exact_dedup as X
from skyloom.llm import simhash as S
from skyloom.llm.components import components

ROWS = [(1, "a  b"), (2, "a\tb"), (3, "a b "), (4, None), (5, ""), (6, " "), (6, " "), (None, "a b"), (7, "long " * 30000), (8, "long\n" * 30000)]


def brute_exact(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        groups[t].append(i)
    return sorted(
        (i is None, i or 0, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm)
    )


def test_exact_groups_edge_rows(docs_of):
    got = X.exact_dedup(docs_of(ROWS)).collect()
    assert sorted((r["id"] is None, r["id"] or 0, r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == brute_exact(ROWS)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got})
    assert all(r["id"] == r["keep_id"] for r in kept)
    assert set(got[0]["row"].asDict()) >= {"doc_id", "text", "row", "kept"}


def test_exact_pairs_and_empty(docs_of):
    rows = [(i, f"text {i // 2}") for i in range(300)]
    out = X.exact_dedup(docs_of(rows), filter_mb=1)
    assert out.filter("kept").count() == 150
    assert X.exact_dedup(docs_of([])).count() == 0


def test_filter_never_misses_a_repeat(spark):
    rows = [(int(h),) for h in np.random.default_rng(1).integers(-(2**62), 2**62, 3000)] + [(5,), (5,), (-9,), (-9,), (-9,)]
    flagged = X.possibly_repeated(spark.createDataFrame(rows, "h long").repartition(3)).filter("maybe").collect()
    assert {5, -9} <= {r["h"] for r in flagged}
    assert len(flagged) < 30


def test_filter_in_rounds(spark):
    rows = [(int(h),) for h in range(2000)] + [(7,), (1999,)]
    out = X.possibly_repeated(spark.createDataFrame(rows, "h long"), filter_mb=1, bits_per_row=16384)  # asks for several rounds
    assert out.count() == len(rows)
    assert {7, 1999} <= {r["h"] for r in out.filter("maybe").collect()}


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbÉé \t\n\x0b\x1c ", max_size=60)), max_size=8))
def test_fingerprints_match_definition(texts):
    assert S.fingerprints(texts).tolist() == [brute_print(t) for t in texts]


def test_fingerprint_of_a_very_long_text():
    text = " ".join(f"w{i % 977}" for i in range(150_000))
    words = text.split()
    hs = np.array([xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(len(words) - 2)], np.uint64)
    want = sum(1 << b for b in range(64) if 2 * int(((hs >> np.uint64(b)) & np.uint64(1)).sum()) > len(hs))
    assert S.fingerprints([text, "a b"]).tolist() == [want, brute_print("a b")]


def brute_components(nodes, links):
    label = {n: n for n in nodes}

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(-5, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute_components({x for p in links for x in p}, links)
    assert {n: got.get(n, n) for n in want} == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("group", "blocks"), [(2, 3), (32, 3), (2, 4), (32, 6), (32, None)])
def test_links_connect_all_close_fingerprints(spark, monkeypatch, group, blocks):
    monkeypatch.setattr(S, "GROUP", group)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:6].tolist():
        for _ in range(60):
            prints.add(b ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    close = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2]
    to = dict(zip(prints, signed))
    want = brute_components(signed, [(to[a], to[b]) for a, b in close])
    got = {r["node"]: r["label"] for r in components(S.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), blocks)).collect()}
    assert {n: got.get(n, n) for n in signed} == want


def test_simhash_components_edge_rows(docs_of):
    rows = [(9, None), (3, " \n"), (4, "a b c d"), (5, "A b\tc d"), (5, "A b\tc d"), (None, "a b c d"), (8, "other words are here " * 50)]
    got = sorted((r["id"] or 0, r["fp"], r["component_id"]) for r in S.simhash_components(docs_of(rows)).collect())
    assert [(i, c) for i, _, c in got] == [(0, 4), (3, 3), (4, 4), (5, 4), (5, 4), (8, 8), (9, 3)]
    assert got[1][1] == 0
    assert S.simhash_components(docs_of([])).count() == 0
