"""The pipeline against a brute-force version of its stages, and the ways in which it is registered."""

import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from skyloom import session
from skyloom.llm import near_copies as N

from test_dedup import brute_components
from test_tokens import check_packing

LANGS = {"en": ["the", "ing", "wh", "sh", "ou"], "de": ["sch", "ung", "ü", "ei", "ver"]}


def make(tmp_path):
    rng = random.Random(11)
    word = lambda k: "".join(rng.choices(LANGS[k], k=rng.randint(1, 4)))
    text = lambda k, n: " ".join(word(k) for _ in range(n))
    items = [text("en", n) for n in (15, 30, 45, 60)]
    rows = []
    for i in range(120):
        k = "en" if i % 3 else "de"
        rows.append([i, text(k, rng.choice([5, 80, 400, 3000])), k])
    for i in range(120, 150):  # exact copies but for white space
        rows.append([i, rows[i % 7][1].replace(" ", " \n"), "en"])
    long = text("en", 4000)
    for i in range(150, 190):  # near copies of a long text
        words = long.split()
        words[rng.randrange(len(words))] = word("en")
        rows.append([i, " ".join(words), "en"])
    for i in range(190, 210):  # leaks
        rows.append([i, f"{text('en', 50)} {items[i % 4].upper()} {text('en', 20)}", "en"])
    rows += [[300, None, "en"], [301, "", None], [302, "12 34 !", "de"], [303, "12 34 !", "de"]]
    rng.shuffle(rows)
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang"]).assign(source="s", n_chars=1)
    (tmp_path / "documents.parquet").mkdir()
    for p in range(3):
        docs.iloc[p::3].to_parquet(tmp_path / "documents.parquet" / f"{p}.parquet")
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    return docs, items


def brute(docs, items):
    left = {d: t for d, t in zip(docs["doc_id"], docs["text"]) if t and re.search(r"[^\W\d_]", t)}
    first = {}
    for d in sorted(left):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", left[d]), d)
    left = {d: left[d] for d in first.values()}
    grams = {d: set(zip(*(t.lower().split()[i:] for i in range(5)))) or {t.lower()} for d, t in left.items()}
    close = [(a, b) for a in left for b in left if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    label = brute_components(set(left), close)
    left = {d: t for d, t in left.items() if label[d] == d}
    plain = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    return {d: t for d, t in left.items() if not any(plain(i) in plain(t) for i in items)}


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, items = make(tmp_path)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute(docs, items)
    assert {r["doc_id"] for r in got} == set(want)
    assert 100 < len(want) < 140
    sequences = check_packing(list(want.items()), got)
    assert sequences <= math.ceil(sum(r["length"] for r in got) / 2048 * 1.05)


def test_stages_keep_the_columns(spark, tmp_path):
    docs, _ = make(tmp_path)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, str(tmp_path)).columns == df.columns
    nothing = df.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in names if q.startswith("op")}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def near_corpus(spark):
    """Texts of 40 to 400 words and copies with a few words changed, some of them of one text."""
    rng = random.Random(3)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts = []
    for n in [40, 80, 200, 400] * 15:
        own = text(n)
        for changes in (0, 1, n // 80 + 1, n // 40 + 1):
            copy = list(own)
            for _ in range(changes):
                copy[rng.randrange(n)] = "changed"
            texts.append(" ".join(copy))
    own = text(200)
    for _ in range(60):  # more than are compared pair by pair
        copy = list(own)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(200)] = f"v{rng.randrange(99)}"
        texts.append(" ".join(copy))
    return texts


def test_near_copies_match_brute_force(spark):
    texts = near_corpus(spark)
    sets = [N.shingle_set(t) for t in texts]
    jaccard = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    label = brute_components(set(range(len(texts))), want)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["id"]: r["component_id"] for r in N.near_components(docs, "doc_id").collect()}
    assert {i: got.get(i, i) for i in label} == label
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert {r["doc_id"] for r in kept} == {i for i in label if label[i] == i}


def test_language_is_what_decides(spark, monkeypatch):
    """A text in letters of no language that was learned goes, and so do languages that aren't wanted."""
    rng = random.Random(6)
    kinds = {"en": ["the", "of", "thing", "other", "with"], "de": ["der", "und", "schön", "nicht", "wir"]}
    text = lambda k, n: " ".join(rng.choice(kinds[k]) for _ in range(n))
    rows = [(i, text(k, 60), k) for i, k in enumerate(["en", "de"] * 20)] + [(90, "слово за словом " * 9, "en"), (91, text("de", 60), None), (92, text("en", 60), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda: {r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert kept() == {*range(40), 91, 92}
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("de",))
    assert kept() == {*range(1, 40, 2), 91}


def planted_pairs(spark, texts, pairs):
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    label = {r["id"]: r["component_id"] for r in N.near_components(docs, "doc_id").collect()}
    return sum(a in label and label[a] == label.get(b) for a, b in pairs), len(label)


def test_pages_of_one_template_are_paired(spark):
    """Texts that have 88 % in common, just not near copies, and pairs of them that just are: no group is cut short."""
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    common = words(264)
    texts = [common + words(36) for _ in range(120)]
    pairs = []
    for k in range(20):
        copy = list(texts[k])
        for j in range(32):
            copy[-1 - j] = f"c{k}_{j}"
        sets = [set(zip(*(t[i:] for i in range(5)))) for t in (texts[k], copy)]
        assert 0.8 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.81
        pairs.append((k, len(texts)))
        texts.append(copy)
    assert planted_pairs(spark, texts, pairs) == (20, 40)


def test_short_texts_are_paired(spark):
    """Of few shingles none is missed: a word more or less, up to texts that have both kinds of blocks."""
    rng = random.Random(8)
    texts, pairs = [], []
    for n in [8, 9, 12, 25, 83, 84, 85, 104] * 25:
        own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        pairs.append((len(texts), len(texts) + 1))
        texts += [own, own + ["more"]]
    assert planted_pairs(spark, texts, pairs) == (200, 400)


def test_rows_without_or_with_shared_ids_are_told_apart(spark, tmp_path):
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    long, item, clean = text(300), text(30), [text(50) for _ in range(3)]
    pd.DataFrame({"item_id": [1], "text": [item]}).to_parquet(tmp_path / "benchmark.parquet")
    rows = [(1, long), (None, long + " a"), (1, long + " b"), (7, clean[0]), (7, clean[1] + " " + item), (None, clean[2]), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    left = corpus_pipeline.decontaminate(spark, corpus_pipeline.near(spark, docs, ""), str(tmp_path)).collect()
    assert sorted(r["text"] for r in left) == sorted([long, clean[0], clean[2]])


def test_documents_without_labels_are_kept(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12 !", None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs, "").collect()] == [1]


def test_near_copies_come_through_fingerprints(spark, monkeypatch):
    """Operator 10's links find pairs by themselves, and no pair is linked whose fingerprints are too far apart."""
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts, pairs = [], []
    for n in [3000] * 10 + [30] * 10:
        own = words(n)
        pairs.append((len(texts), len(texts) + 1))
        texts += [own, own + ["more"]]
    bits = lambda p: (int(p[0]) ^ int(p[1])).bit_count()
    prints = N.prints_of(N.shingle_set(" ".join(t)) for t in texts).reshape(-1, 2)
    within = sum(bits(p) <= 2 for p in prints)
    assert 10 <= within < 20 and max(map(bits, prints)) <= N.RADIUS
    assert planted_pairs(spark, texts, pairs) == (20, 40)
    with monkeypatch.context() as m:
        m.setattr(N, "RADIUS", 2)
        assert planted_pairs(spark, texts, pairs) == (within, 2 * within)
    monkeypatch.setattr(N, "_star_pairs", lambda shared: shared.select(F.col("id").alias("u"), F.col("id").alias("v"), F.lit(N.SHARED).alias("blocks")).limit(0))
    monkeypatch.setattr(N, "_unlinked", lambda shared, links: shared.select("key", "id", "n", "reps", "label").limit(0))
    assert planted_pairs(spark, texts, pairs) == (within, 2 * within)


def test_radius_holds_near_copies():
    """Of 20,000 pairs of similarity 0.8, from 4 shingles on, all are within RADIUS, most by far."""
    rng = np.random.default_rng(10)
    most = 0
    for few, many in ((4, 5), (8, 10), (9, 10), (40, 50), (400, 500)):
        hashes = [rng.integers(0, 1 << 64, many, np.uint64) for _ in range(4000)]
        one, other = (N.prints_of(h[:k] for h in hashes) for k in (few, many))
        most = max(most, int(np.bitwise_count(one ^ other).max()))
    assert most <= N.RADIUS - 2


def test_stages_copy_no_text(spark, tmp_path):
    """Documents that are read from files are numbered there: no stage writes them again; rows that a plan repeats are still told apart."""
    make(tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    uids = [r["uid"] for r in corpus_pipeline.numbered(docs).collect()]
    assert len(set(uids)) == len(uids) == docs.count() and uids == [r["uid"] for r in corpus_pipeline.numbered(docs).collect()]
    before = len(session._WRITTEN)
    left = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert left.inputFiles() and left.columns == docs.columns
    written = [set(spark.read.parquet(p).columns) for p in session._WRITTEN[before:]]
    assert written and not any(c & {"text", "row"} for c in written)
    twice = docs.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    assert corpus_pipeline.numbered(twice).select("uid").distinct().count() == 2 * docs.count()
