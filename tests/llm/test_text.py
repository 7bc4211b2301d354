import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import decontaminate as D
from skyloom.llm import language_id as G

WORDS = [f"w{i}" for i in range(900)]


def passage(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def jaccard(a, b):
    a, b = (Counter(zip(*(w[i:] for i in range(5)))) for w in (a, b))
    same = sum((a & b).values())
    return same / (sum(a.values()) + sum(b.values()) - same) if same else 0.0


def corpus():
    rng = random.Random(5)
    items = {i: passage(rng, n) for i, n in enumerate([5, 6, 9, 14, 20, 33, 47, 60, 90, 400])}
    docs, want = [], set()
    for d in range(80):
        words = passage(rng, rng.choice([0, 3, 50, 400, 3000]))
        if d % 2:
            i = rng.randrange(len(items))
            own = list(items[i])
            if d % 4 == 1 and len(own) >= 47:
                own[len(own) // 2] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = own
            if jaccard(items[i], own) >= 0.8:
                want.add((d, i))
        docs.append((d, " ".join(words).title()))
    return items, docs, want


def test_leaks_are_found_and_clean_documents_left_alone(spark, docs_of):
    items, docs, want = corpus()
    rows = docs + [(None, " ".join(items[4])), (900, None), (901, " ".join(items[7] * 3)), (901, " ".join(items[7] * 3))]
    bench = spark.createDataFrame([(i, " ".join(w), "extra") for i, w in items.items()] + [(50, None, ""), (51, "four words are few", "")], "item_id long, text string, doc_id string")
    got = D.leaks(docs_of(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want | {(None, 4), (901, 7)}
    assert sum(r["doc_id"] == 901 for r in got) == 2
    text = {d: t.lower().split() for d, t in docs}
    for r in got:
        if r["doc_id"] in text:
            stretch = text[r["doc_id"]][r["first_word"] : r["first_word"] + r["n_words"]]
            assert r["similarity"] == jaccard(items[r["item_id"]], stretch) >= 0.8
    assert D.leaks(docs_of([]), bench).count() == 0
    assert D.leaks(docs_of(rows), bench.limit(0)).count() == 0


def test_items_in_several_passes(spark, docs_of, monkeypatch):
    items, docs, want = corpus()
    monkeypatch.setattr(D, "CHARS_AT_ONCE", 900)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.leaks(docs_of(docs), bench).collect()} == want


def test_search_in_parts_of_a_long_document(monkeypatch):
    rng = random.Random(6)
    item = passage(rng, 40)
    index = D.build_index([(1, " ".join(item))])
    monkeypatch.setattr(D, "BATCH", 256)
    for at in range(200, 300, 7):
        words = passage(rng, 1000)
        words[at:at] = item
        assert [r[:3] for r in D.search(index, [D.WordHashes().of(" ".join(words))])] == [(0, 0, 1.0)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 7))
def test_lookup_finds_all_within_the_radius(seed, flips):
    rng = np.random.default_rng(seed)
    index = D.build_index([(1, " ".join(f"x{seed}y{i}" for i in range(30)))])
    rung = next(iter(index.rungs.values()))
    target = int(rung.prints[0])
    for b in rng.choice(64, flips, replace=False).tolist():
        target ^= 1 << b
    w, e = D.lookup(rung, np.array([target], np.uint64))
    got = {int(x) for x in e}
    assert got == {i for i, p in enumerate(rung.prints.tolist()) if (p ^ target).bit_count() <= 7}
    assert 0 in got


def brute_phrases(text, ref):
    """Greedy cross-parsing by substring search."""
    n = i = 0
    while i < len(text):
        z = i + 1
        while z < len(text) and text[i : z + 1] in ref and text[i:z] in ref:
            z += 1
        n, i = n + 1, z
    return n


@settings(max_examples=80, deadline=None)
@given(st.text("abc ", max_size=80), st.text("abd ", max_size=80), st.lists(st.text("abcdé, ", max_size=60), max_size=5))
def test_phrases_match_substring_search(one, two, texts):
    model = G.build_model({"one": [one + "a"], "two": [two + "a"]})
    symbols = [G.symbols_of(G.code_points(t), model.symbols) for t in texts]
    got = G.phrases(model, symbols)
    refs = {k: G.symbols_of(G.code_points(t + "a"), model.symbols).tobytes() for k, t in (("one", one), ("two", two))}
    least = min(map(len, refs.values()))
    for row, s in zip(got.tolist(), symbols):
        assert row == [brute_phrases(s.tobytes(), refs[k][:least]) for k in model.languages]


def test_phrases_go_on_over_the_ends_of_segments(monkeypatch):
    monkeypatch.setattr(G, "SEGMENT", 16)
    model = G.build_model({"en": ["the cat sat on the mat " * 5], "de": ["der hund lag auf dem bett " * 5]})
    s = G.symbols_of(G.code_points("the cat lag on dem mat " * 7), model.symbols)
    ref = G.symbols_of(G.code_points("the cat sat on the mat " * 5), model.symbols).tobytes()
    least = min(len(ref), len(G.symbols_of(G.code_points("der hund lag auf dem bett " * 5), model.symbols)))
    want = brute_phrases(s.tobytes(), ref[:least])
    assert G.phrases(model, [s])[0][model.languages.index("en")] == want


def test_language_edge_rows(docs_of):
    rng = random.Random(7)
    syllables = {"en": ["the", "ing", "wh", "sh"], "de": ["sch", "ung", "ü", "ei"], "fr": ["eau", "oi", "é", "ch"]}
    text = lambda k: " ".join("".join(rng.choices(syllables[k], k=3)) for _ in range(40))
    rows = [(i, text(k), k) for i, k in enumerate(["en", "de", "fr"] * 40)]
    odd = [(500, None, "en"), (501, "", "en"), (502, "12 34 !?", "de"), (503, "é", None), (None, text("de"), "de"), (504, text("fr") * 400, "fr"), (7, text("en"), "en"), (7, text("en"), "en")]
    docs = docs_of(rows + odd)
    got = {(r["row"]["doc_id"], r["row"]["lang"]): r["found"] for r in G.identify(docs, G.fit(docs)).collect()}
    assert all(f["lang"] == k for (i, k), f in got.items() if i is not None and i < 500 or i in (None, 504))
    assert [got[i, k]["lang"] for i, k in ((500, "en"), (501, "en"), (502, "de"))] == ["und"] * 3
    assert all(0 <= f["score"] <= 1 for f in got.values())
    empty = docs_of([])
    assert G.identify(empty, G.fit(empty)).count() == 0
    unlabelled = docs_of([(1, "abc", None)])
    assert [r["found"]["lang"] for r in G.identify(unlabelled, G.fit(unlabelled)).collect()] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from skyloom.llm.queries import op6_language

    got = op6_language(spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out")
    right, n = got.selectExpr("avg(cast(lang = lang_pred as double))", "count(*)").first()
    assert n > 100 and right > 0.97


def test_a_thin_label_weakens_only_itself(docs_of):
    rng = random.Random(9)
    syllables = {"en": ["the", "ing", "wh", "sh", "ou"], "de": ["sch", "ung", "ü", "ei", "ver"]}
    text = lambda k, n: " ".join("".join(rng.choices(syllables[k] + ["an", "er", "st"], k=3)) for _ in range(n))
    rows = [(i, text(k, 30), k) for i, k in enumerate(["en", "de"] * 150)]
    for thin in ([(1001, "ok", "aa")], [(1001, "a", "aa")], [(i, "stan", "aa") for i in range(1000, 1030)]):
        assert G.training_sample(docs_of(rows + thin)).get("aa")
        found = G.identify(docs_of(rows), G.fit(docs_of(rows + thin))).collect()
        assert sum(r["found"]["lang"] == r["row"]["lang"] for r in found) > 290


def test_sample_goes_on_until_the_reference_is_full(docs_of):
    docs = docs_of([(i, f"word{i % 7}", "en") for i in range(9000)] + [(i, "12 34", "en") for i in range(9000, 9500)])
    sample = G.training_sample(docs)["en"]
    assert len(sample) > 200 and G.REFERENCE <= sum(map(len, sample)) <= 4 * G.REFERENCE


def cuts_of(rng, item):
    """Stretches that an item's copy may be left as: cut, edited at an edge, with an insertion, a deletion or its parts swapped."""
    n = len(item)
    for k in range(n // 5 + 1):
        yield item[k:]
        yield item[: n - k]
    yield ["other", *item[1:]]
    yield [*item[:-1], "other"]
    for k in (2, n // 12, n // 8, n // 6):
        at = rng.randrange(5, n - k)
        yield item[:at] + passage(rng, k) + item[at:]
        yield item[:at] + item[at + k :]
    yield item[n // 2 :] + item[: n // 2]


def test_every_stretch_that_is_similar_enough_is_found():
    rng = random.Random(8)
    words, tried = D.WordHashes(), 0
    for n in (13, 15, 30, 40, 55, 59, 66, 116, 300):
        for _ in range(6):
            item = passage(rng, n)
            index = D.build_index([(1, " ".join(item))])
            for part in cuts_of(rng, item):
                if jaccard(item, part) >= 0.8:
                    doc = passage(rng, rng.randrange(60)) + part + passage(rng, rng.randrange(60))
                    found = list(D.search(index, [words.of(" ".join(doc))]))
                    assert [r[1] for r in found] == [0] and found[0][2] >= jaccard(item, part)
                    assert found[0][2] == jaccard(item, doc[found[0][3] : found[0][3] + found[0][4]])
                    tried += 1
    assert tried > 800
