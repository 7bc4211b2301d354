import base64
import hashlib

import duckdb
import pytest

from skyloom.llm import queries, quotes, url_filter, warc

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = con.execute(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]}) q").fetchall()
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))


CAPTURES = [
    (1, "http://a.b.example.org/x/y?q=1", 100, "k"),
    (2, "HTTP://user@A.B.example.org:80/x", 100, "k"),
    (3, "http://a.b.example.org/x/y", 50, "k"),
    (4, "http://a.b.example.org/x/y", 10_000_000, "k"),
    (5, None, 100, "k"),
    (6, "not a url", 100, "k"),
    (7, "http://example.org", None, "k"),
    (8, "http://badexample.org/x", 100, "k"),
    (8, "http://badexample.org/x", 100, "k"),
    (9, "http://a.b.example.org/xy", 100, "k"),
]
ENTRIES = [("d:example.org", 60, "block"), ("p:a.b.example.org/x", 90, "allow"), ("p:a.b.example.org/x", 100, "remove"), ("p:a.b.example.org/x", 100, "block"), ("d:b.example.org", 5_000_000, "allow"), ("p:a.b.example.org/x", 6_000_000, "remove"), (None, 1, "block"), ("d:example.org", None, "remove"), ("d:org", 0, "remove")]


def test_urls_judged_as_of_fetch(spark):
    seen = spark.createDataFrame(CAPTURES, "page_id long, url string, fetched_at long, key string")
    got = sorted((r["row"]["page_id"], r["matched_key"], r["blocked"]) for r in url_filter.judge(seen, spark.createDataFrame(ENTRIES, "key string, listed_at long, action string")).collect())
    assert got == [
        (1, "d:example.org", True),
        (2, "d:example.org", True),
        (3, None, False),
        (4, "d:b.example.org", False),
        (5, None, False),
        (6, None, False),
        (7, None, False),
        (8, None, False),
        (8, None, False),
        (9, "d:example.org", True),
    ]
    assert url_filter.judge(seen, spark.createDataFrame([], "key string, listed_at long, action string")).filter("blocked").count() == 0
    assert url_filter.judge(seen.limit(0), spark.createDataFrame(ENTRIES, "key string, listed_at long, action string")).count() == 0


def test_paths_of_any_depth(spark):
    deep = {n: "h.org/" + "/".join(f"s{i}" for i in range(n)) for n in (8, 9, 30)}
    urls = [(n, f"http://{p}/more", 100) for n, p in deep.items()] + [(1, "http://h.org/s0", 100), (2, "http://h.org" + "/s" * 4000, 100)]
    entries = [(f"p:{deep[9]}", 1, "allow"), (f"p:{deep[30]}", 1, "block"), ("d:h.org", 1, "block")]
    out = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string, fetched_at long"), spark.createDataFrame(entries, "key string, listed_at long, action string"))
    got = {r["row"]["page_id"]: (r["matched_key"], r["blocked"]) for r in out.collect()}
    assert got == {8: ("d:h.org", True), 9: (f"p:{deep[9]}", False), 30: (f"p:{deep[30]}", True), 1: ("d:h.org", True), 2: ("d:h.org", True)}


def test_intervals_cross_periods(spark):
    times = [0, 5, 40 * 86400, 41 * 86400, 400 * 86400]
    rows = [("d:x.y", t, "block" if i % 2 else "allow") for i, t in enumerate(times)]
    got = sorted((r["valid_from"], r["valid_to"]) for r in url_filter.intervals(spark.createDataFrame(rows, "key string, listed_at long, action string")).collect())
    assert got == list(zip(times, [*times[1:], None]))


def test_warc_records_link_and_digest(spark):
    html = '<html lang="en"><head><title> A &amp; B </title><style>p{}</style><script>var t="</p>";</script></head><body><!-- x --><p>One<br>two &lt;3&gt; <a href="/z">z</a><p>caf&eacute;&#8212;&#x2014;&nbsp;&notin;&hellip;&amp;lt; &apos;&unknown;</body></html>'
    rows = [("<urn:uuid:1>", "http://e.org/", "2020-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\n", html, 1), ("<urn:uuid:2>", None, None, None, None, 2), ("<urn:uuid:3>", "u", "d", "h", "<p>" + "é " * 300_000, 3)]
    source = spark.createDataFrame(rows, "record_id string, uri string, date string, headers string, payload string, block int")
    got = {(r["refers_to"], r["warc_type"]): r for r in warc.derive(source).collect()}
    assert len(got) == 6 and len({r["record_id"] for r in got.values()}) == 6
    one = got["<urn:uuid:1>", "conversion"]
    assert one["block"] == "A & B\nOne\ntwo <3> z\ncafé—— ∉…&lt; '&unknown;"
    head = one["warc_header"].split("\r\n")
    assert head[0] == "WARC/1.1" and head[-2:] == ["", ""] and f"WARC-Record-ID: {one['record_id']}" in head and "WARC-Refers-To: <urn:uuid:1>" in head
    assert f"Content-Length: {one['content_length']}" in head and f"WARC-Block-Digest: {one['block_digest']}" in head
    assert not any("None" in r["warc_header"] or "URI" in r["warc_header"] for (ref, _), r in got.items() if ref == "<urn:uuid:2>")
    label = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for (ref, _), r in got.items():
        payload = next(x[4] for x in rows if x[0] == ref) or ""
        assert r["source_digest"] == label(payload.encode()) and r["block_digest"] == label(r["block"].encode())
        assert r["content_length"] == len(r["block"].encode())
    assert "title: A & B\r\nlanguage: en\r\noutlinks: 1\r\n" in got["<urn:uuid:1>", "metadata"]["block"]
    assert got["<urn:uuid:1>", "metadata"]["source_headers"] == "HTTP/1.1 200 OK\r\n"
    assert got["<urn:uuid:2>", "conversion"]["block"] == ""
    assert warc.derive(source.limit(0)).count() == 0


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "How do I sort?\nBriefly please."),
        (1, 1, "assistant", "> How do I  SORT?\n> Briefly please.\nUse orderBy."),
        (1, 2, "user", ">> How do I sort?\n> Use orderBy.\n\nThanks!\n> never said"),
        (1, 3, "user", "> Briefly please.\n> and something else\nWhy?"),
        (2, 0, "user", "Use orderBy."),
        (2, 1, "user", None),
        (None, 5, "user", "> Use orderBy.\nhm"),
        (2, 1, "user", None),
        (3, 7, "user", "> " * 3 + "deep\n" * 20000),
    ]
    got = quotes.link_quotes(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, uid string")).collect()
    one = {r["turn"]: r for r in got if r["conv_id"] == 1}
    assert [one[t]["place"] for t in range(4)] == [0, 1, 2, 3]
    assert one[1]["text"] == "Use orderBy." and (one[1]["reply_to"], one[1]["quotes"], one[1]["linked"], one[1]["depth"]) == (0, 1, 1, 1)
    assert one[2]["text"] == "Thanks!" and (one[2]["reply_to"], one[2]["quotes"], one[2]["linked"], one[2]["depth"]) == (1, 3, 2, 2)
    assert (one[3]["reply_to"], one[3]["linked"]) == (0, 1)
    assert sorted((r["place"], r["text"]) for r in got if r["conv_id"] == 2) == [(0, "Use orderBy."), (1, ""), (2, "")]
    assert [(r["reply_to"], r["text"], r["place"]) for r in got if r["conv_id"] is None] == [(None, "hm", None)]
    assert [r["depth"] for r in got if r["conv_id"] == 3] == [3]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.link_quotes(empty).count() == 0


def test_rows_that_differ_in_a_null_are_rows_of_their_own(spark):
    rows = [(1, 0, "a", "x"), (1, 1, None, "> x"), (1, 1, "> x", None), (1, None, "b", "late"), (1, None, None, None), *[(2, 3, "r", f"> q{i % 5}") for i in range(700)], (2, 1, "r", "q1\nq3")]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)).collect()
    one = {(r["turn"], r["role"], r["text"]): r for r in got if r["conv_id"] == 1}
    assert (one[1, None, ""]["reply_to"], one[1, None, ""]["linked"]) == (0, 1)
    assert (one[1, "> x", ""]["reply_to"], one[1, "> x", ""]["quotes"], one[1, "> x", ""]["linked"]) == (None, 0, 0)
    assert sorted(one[k]["place"] for k in one if k[0] is None) == [0, 1] and one[0, "a", "x"]["place"] == 2
    two = sorted((r for r in got if r["conv_id"] == 2), key=lambda r: r["place"])
    assert [r["place"] for r in two] == list(range(701)) and two[0]["turn"] == 1
    assert sum(r["linked"] for r in two) == 280


def test_a_capture_in_milliseconds_costs_no_periods(spark):
    """One wild time among the captures: entries are dealt to the periods that captures have, not to all up to it."""
    began = 1_600_000_000
    entries = [(f"d:site{i}.org", began + i, "block") for i in range(300)]
    urls = [(i, f"http://www.site{i}.org/x", began + 400, "content") for i in range(300)] + [(999, "http://site7.org/", began * 1000, None)]
    out = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string, fetched_at long, html string"), spark.createDataFrame(entries, "key string, listed_at long, action string"))
    rows = out.collect()
    assert len(rows) == 301 and all(r.blocked for r in rows) and {r.row.html for r in rows} == {"content", None}


def test_pages_are_read_as_the_patterns_say():
    """Pieces of tags in any order, against plain patterns that may take long."""
    import random
    import re

    rng = random.Random(1)
    parts = ["<!--", "-->", "<script", "</script>", "</script ", "<STYLE>", "</style\n>", "<p", "<p>", ">", "<", "text ", " ", "\n", "<a href=", "<a ", "href=", "<title>", "<title", "</title>", '<html lang="', '"', "<html", "é"]
    for _ in range(3000):
        page = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        text = page
        for pattern in (r"(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"):
            text = re.sub(pattern, " ", text, flags=re.A)
        text = warc.TAG.sub("", warc.BLOCK.sub("\n", text))
        assert warc.visible_text(page) == warc.ENDS.sub("", warc.LINES.sub("\n", warc.BLANKS.sub(" ", text)))
        title = re.search(r"(?is)<title[^>]*>([^<]*)<", page)
        lang = re.search(r'(?i)<html[^>]*\blang="([^"]*)"', page, re.A)
        assert warc.title_of(page) == (title[1] if title else "")
        assert warc.language_of(page) == (lang[1] if lang else "")
        assert warc.outlinks_of(page) == len(re.findall(r"(?i)<a\s[^>]*href=", page, re.A))


def test_hostile_pages_take_linear_time():
    import time

    for piece in ("<script ", "<!-- ", "<style ", "<p ", "<title ", "<html ", "<a ", "<", "<a href=", '<html lang="', "</script "):
        page = piece * (1_000_000 // len(piece))
        began = time.process_time()
        warc.visible_text(page), warc.title_of(page), warc.language_of(page), warc.outlinks_of(page)
        assert time.process_time() - began < 3
    assert warc.visible_text("a <script> b <b>c</b>") == "a b c"
