"""Operators 11 to 13 against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import periodic_runs as P
from skyloom.llm import phrases, queries, rule_ledger
from skyloom.session import table

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = ["", None, " \n\t", "a", "a a a a a a a a a a a a a a", "A. B!\n\nc", "ß ẞ Ω# $\x0b%\x0c& |<>", "x y " * 3000]


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), sum(any(c.isalpha() for c in x) for x in w), len(covered)


def test_measures():
    rng = random.Random(3)
    texts = ODD + [" ".join(rng.choice("ab#1c") for _ in range(rng.randrange(90))) for _ in range(300)]
    assert [rule_ledger.measures(t) for t in texts] == [brute_measures(t) for t in texts]


def test_ledger_policies_and_ablations(spark, docs_of):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(1, good), (1, good + " ### ***"), (None, None), (3, good + " # " * 9 + "\nx\nx\nx\nx\nx\nx"), (4, "a b c d e f g h " * 9), (5, " ".join(map(str, range(50))))]
    written = rule_ledger.ledger(docs_of(rows)).cache()
    got = [tuple(r) for r in rule_ledger.judge(written).select("row.doc_id", "fail_bits", "kept_by").collect()]
    b = rule_ledger.mask
    assert got == [
        (1, 0, [1, 2, 3]), (1, b(["symbols"]), [2]), (None, b(["few_words"]), []), (3, b(["symbols", "duplicate_lines"]), []),
        (4, b(["repeated_passages", "word_length"]), []), (5, b(["few_letters", "word_length"]), []),
    ]
    told = {(r.version, r.rule): r for r in rule_ledger.ablations(written).collect()}
    bits = [r[1] for r in got]
    for p in rule_ledger.POLICIES:
        keep = lambda x, rules, base: not x & b(base) and bin(x & b(rules)).count("1") <= p.allowed  # noqa: B023, E731
        for rule in (*rule_ledger.BASE, *p.rules):
            r = told[p.version, rule]
            less = [x for x in p.rules if x != rule], [x for x in rule_ledger.BASE if x != rule]
            assert (r.docs, r.kept, r.failed) == (6, sum(keep(x, p.rules, rule_ledger.BASE) for x in bits), sum(bool(x & b([rule])) for x in bits))
            assert r.alone == sum(x & b([*rule_ledger.BASE, *p.rules]) == b([rule]) for x in bits)
            assert r.kept_without == sum(keep(x, *less) for x in bits)
    assert rule_ledger.ledger(docs_of([])).count() == 0


def test_op11_columns(spark):
    out = queries.op11_rule_ledger(spark, SF)
    assert out.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    for r in out.collect():
        n, chars, symbols, _, dup, _, again = brute_measures(docs[r.doc_id])
        assert tuple(r)[1:7] == (n, chars, symbols, dup, again, n < 20 or 100 * again > 30 * n)
        assert not (r.base_failed and r.kept)


def brute_runs(w):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, q, n) for (s, n), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic_texts(rng, many):
    for _ in range(many):
        n, kinds = rng.choice([0, 11, 12, 40, 130, 300]), rng.choice([1, 2, 3, 40])
        w = [str(rng.randrange(kinds)) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 12:
                a = rng.randrange(n - 4)
                p, end = rng.randrange(1, max(2, (n - a) // 2)), rng.randrange(a, n) + 1
                w[a:end] = [w[a + (i - a) % p] for i in range(a, end)]
        yield "  \n".join(w)


@pytest.mark.parametrize("long", [P.LONG, 50])
def test_runs_are_all_runs(docs_of, long):
    """Solved where they're read, or as tiles."""
    texts = ODD + list(periodic_texts(random.Random(5), 150))
    docs = docs_of([(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)]).withColumn("n_chars", F.monotonically_increasing_id())
    got = P.periodic_runs(docs, long=long, tile=32).select("row.*", "n_words", "runs", "collapsed").collect()
    assert len(got) == len(texts)
    for r in got:
        w = WORD.findall(r.text or "")
        want = brute_runs(w)
        assert (r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (len(w), want, brute_collapsed(w, want))
    assert P.periodic_runs(docs.limit(0)).count() == 0


def test_op12_columns(spark):
    out = queries.op12_periodic_runs(spark, SF)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in out.collect():
        w = WORD.findall(docs[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        s, q, size = max(runs, key=lambda x: (x[2], -x[0], -x[1])) if runs else (None,) * 3
        best = (s, size, q, 1000 * size // q) if runs else (None,) * 4
        assert tuple(r)[1:] == (len(runs), *best, sha("".join(f"{s},{n},{q}\n" for s, q, n in runs)), sha(brute_collapsed(w, runs)))


def brute_phrases(rows, least, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        held = {p: a for p, a in counts.items() if a >= least and len(p) > 1}
        inside = {p[i:j] for p, a in held.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and a >= counts[p[i:j]]}
        rows = []
        for p, a in held.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i + 1, p, a, left, right, n[lang], score) for i, (score, a, p, left, right) in enumerate(rows[:top])]
    return sorted(out)


@pytest.mark.parametrize("fits", [phrases.FITS, 0])
def test_phrases_are_all_phrases(docs_of, fits):
    """Groups sent to the tasks, or joined by a shuffle."""
    rng = random.Random(8)
    text = lambda: "".join(rng.choice(["the ", "The ", "cat ", "sat", " on ", "mat ", "É ", ". ", ", ", "\n", "\t", "-x "]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(200)] + [("en", t) for t in ODD] + [("fr", "never twice")]
    docs = docs_of([(None if i % 7 else 1, t, lang) for i, (lang, t) in enumerate(rows)])
    got = sorted(tuple(r) for r in phrases.collocations(docs, top=40, least=5, fits=fits).collect())
    want = brute_phrases(rows, 5, 40)
    assert len({w[0] for w in want}) == 3 and any(len(w[2].split()) == 5 for w in want)
    assert got == want


def test_phrases_of_nothing(docs_of):
    assert phrases.collocations(docs_of([])).count() == 0
    assert phrases.collocations(docs_of([(1, None), (2, ""), (3, "once only")])).count() == 0


def test_scores_pass_64_bits(spark):
    """1000 a n doesn't fit a long, the score does."""
    got = spark.sql("select (cast(1000 * a as decimal(19)) * cast(n as decimal(19))) div (cast(l as decimal(19)) * cast(r as decimal(19))) as s from values (4000000000L, 900000000000L, 7000000000L, 5000000000L) t(a, n, l, r)").first().s
    assert got == 1000 * 4000000000 * 900000000000 // (7000000000 * 5000000000)


def test_op13_columns(spark):
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    out = queries.op13_phrases(spark, SF)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute_phrases(rows, 100, 2000)
