"""Registered queries of the subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm import quotes, rule_ledger, url_filter, warc
from skyloom.llm.decontaminate import leaks
from skyloom.llm.exact_dedup import exact_dedup
from skyloom.llm.language_id import fit, identify
from skyloom.llm.length_histogram import context_totals, length_counts
from skyloom.llm.packing import pack_documents
from skyloom.llm.periodic_runs import WORD, longest, periodic_runs
from skyloom.llm.phrases import collocations
from skyloom.llm.simhash import simhash_components
from skyloom.llm.token_store import read_boundaries, write_store
from skyloom.session import cut, new_path, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


#: Seconds of 2020-01-01 and of four years: when pages were fetched and hosts were listed.
EPOCH, YEARS = 1577836800, 126230400


def query(f):
    QUERIES[f.__name__] = f
    return f


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with a fetch time derived from the page's number."""
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(EPOCH) + F.col("page_id") * 7919 % YEARS).alias("fetched_at"))


def url_list(pages: DataFrame) -> DataFrame:
    """A dated list derived from the hosts of pages: four entries a host, for the host, its parent and a path."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    drawn = hosts.select("host", F.explode(F.array(*map(F.lit, range(4)))).alias("k")).withColumn(
        "draw", F.conv(F.substring(F.md5(F.concat("host", F.lit("#"), F.col("k").cast("string"))), 1, 8), 16, 10).cast("long")
    )
    parent = F.regexp_replace("host", r"^[^.]+\.(.+\..+)$", "$1")
    key = F.when(F.col("k") == 1, F.concat(F.lit("d:"), parent)).when(F.col("k") == 2, F.concat(F.lit("p:"), "host", F.lit("/en"))).otherwise(F.concat(F.lit("d:"), "host"))
    action = F.element_at(F.array(*map(F.lit, ("block", "allow", "remove", "block"))), (F.col("draw") % 4 + 1).cast("int"))
    return drawn.select(key.alias("key"), (F.lit(EPOCH) + F.col("draw") % YEARS).alias("listed_at"), action.alias("action"))


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by the list entries active when it was fetched."""
    seen = captures(spark, sf_dir)
    out = url_filter.judge(seen, url_list(seen), keep=["page_id"])
    return out.select("row.page_id", "url", "fetched_at", "matched_key", "action", "valid_from", "blocked")


ORACLE_SQL["op1_url_filter"] = rf"""
with c as (select page_id, url, {EPOCH} + (page_id * 7919) % {YEARS} as fetched_at,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) as host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) || '/' as path from pages),
h as (select distinct host from c where host <> ''),
d as (select host, k, cast('0x' || substr(md5(host || '#' || k), 1, 8) as bigint) as draw from h, range(4) as r(k)),
e as (select distinct case k when 1 then regexp_replace(host, '^[^.]+\.(.+\..+)$', '\1') else host end as name, k = 2 as is_path,
    {EPOCH} + draw % {YEARS} as listed_at, ['block', 'allow', 'remove', 'block'][draw % 4 + 1] as action from d),
one as (select name, is_path, listed_at, max(action) as action from e group by all),
i as (select *, lead(listed_at) over (partition by name, is_path order by listed_at) as valid_to from one),
m as (select page_id, case when is_path then 'p:' || name || '/en' else 'd:' || name end as matched_key, action, listed_at as valid_from,
    row_number() over (partition by page_id order by is_path desc, length(name) desc) as rank
    from c join i on action <> 'remove' and listed_at <= fetched_at and (valid_to is null or fetched_at < valid_to)
    and case when is_path then host = name and starts_with(path, '/en/') else host = name or ends_with(host, '.' || name) end)
select c.page_id, url, fetched_at, matched_key, action, valid_from, coalesce(action = 'block', false) as blocked
from c left join (select * from m where rank = 1) m on c.page_id = m.page_id
"""


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that documents hold."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as response records, with the record id, date and headers that a crawler would have kept."""
    seen = F.lit(EPOCH) + F.col("page_id") * 7919 % YEARS
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit("\r\n"))
    return table(spark, sf_dir, "pages").select(
        warc.uuid_of(F.concat_ws(" ", F.lit("response"), F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("uri"),
        F.date_format(F.timestamp_seconds(seen), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
        header.alias("headers"),
        F.col("html").alias("payload"),
    )


@query
def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.derive(responses(spark, sf_dir))


def _sql_uuid(name: str) -> str:
    h = f"md5({name})"
    return "'<urn:uuid:' || " + " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + " || '>'"


def _sql_digest(text: str) -> str:
    word = [f"cast('0x' || substr(sha1({text}), {1 + 10 * i}, 10) as bigint)" for i in range(4)]
    return "'sha1:' || " + " || ".join(f"substr('{warc.BASE32}', cast(({w} >> {s}) & 31 as integer) + 1, 1)" for w in word for s in range(35, -1, -5))


#: Character references that the given pages hold, some cut short, and what they stand for; the ampersand comes last.
_REFERENCES = (("&nbsp", " "), ("&lt", "<"), ("&gt", ">"), ("&quot", '"'), ("&#39", "'"), ("&copy", "©"), ("&middot", "·"), ("&amp", "&"))


def _sql_resolved(text: str) -> str:
    for name, char in _REFERENCES:
        text = f"regexp_replace({text}, '{name};?', chr({ord(char)}), 'g')"
    return text


def _sql_text(html: str) -> str:
    out = html
    for pattern in ("(?s)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{warc.BLOCK_TAGS})\b[^>]*>', chr(10), 'g')"
    out = _sql_resolved(f"regexp_replace({out}, '<[^>]*>', '', 'g')")
    out = rf"regexp_replace({out}, '[ \t\r\f]+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' ?\n[ \n]*', chr(10), 'g')"
    return rf"regexp_replace({out}, '^[ \n]+|[ \n]+$', '', 'g')"


_CRLF = "chr(13) || chr(10)"

ORACLE_SQL["op3_warc_derivatives"] = rf"""
with p as (select {_sql_uuid("concat_ws(' ', 'response', cast(page_id as varchar), url)")} as refers_to, url as refers_to_uri,
    strftime(make_timestamp(({EPOCH} + (page_id * 7919) % {YEARS}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as refers_to_date,
    'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=UTF-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) as source_headers,
    {_sql_digest("html")} as source_digest, {_sql_text("html")} as txt,
    {_sql_resolved("regexp_extract(html, '(?is)<title[^>]*>([^<]*)<', 1)")} as title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) as language,
    len(regexp_extract_all(html, '(?i)<a\s[^>]*href=')) as outlinks from pages),
r as (select refers_to, refers_to_uri, refers_to_date, source_headers, source_digest, 'metadata' as warc_type, {_sql_uuid("'metadata ' || refers_to")} as record_id,
    'application/warc-fields' as content_type, 'title: ' || trim(regexp_replace(title, '\s+', ' ', 'g')) || chr(13) || chr(10) || 'language: ' || language || chr(13) || chr(10)
    || 'outlinks: ' || outlinks || chr(13) || chr(10) || 'text-characters: ' || length(txt) || chr(13) || chr(10) as block from p
    union all select refers_to, refers_to_uri, refers_to_date, source_headers, source_digest, 'conversion', {_sql_uuid("'conversion ' || refers_to")}, 'text/plain; charset=UTF-8', txt from p),
d as (select *, strlen(block) as content_length, {_sql_digest("block")} as block_digest from r)
select *, concat_ws({_CRLF}, 'WARC/1.1', 'WARC-Type: ' || warc_type, 'WARC-Record-ID: ' || record_id, 'WARC-Refers-To: ' || refers_to, 'WARC-Refers-To-Target-URI: ' || refers_to_uri,
    'WARC-Refers-To-Date: ' || refers_to_date, 'WARC-Target-URI: ' || refers_to_uri, 'WARC-Date: ' || refers_to_date, 'WARC-Block-Digest: ' || block_digest,
    'Content-Type: ' || content_type, 'Content-Length: ' || content_length, {_CRLF}) as warc_header from d
"""


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as mails: each message quotes the one before it and, one level deeper, the one before that."""
    said = table(spark, sf_dir, "conversations")
    quoted = lambda by, mark, name: said.groupBy(F.col("conv_id"), (F.col("turn") + by).alias("turn")).agg(
        F.concat(F.lit(mark), F.replace(F.min("text"), F.lit("\n"), F.lit("\n" + mark)), F.lit("\n")).alias(name)
    )
    both = said.join(quoted(1, "> ", "q1"), ["conv_id", "turn"], "left").join(quoted(2, ">> ", "q2"), ["conv_id", "turn"], "left")
    none = F.lit("")
    return both.select("conv_id", "turn", "role", F.concat(F.coalesce("q2", none), F.coalesce("q1", none), F.coalesce("text", none)).alias("text"))


@query
def op4_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, each message quoting those before it, in reply order without the quotes."""
    return quotes.link_quotes(mails(spark, sf_dir))


ORACLE_SQL["op4_quotes"] = r"""
with said as (select conv_id, turn, min(text) as said from conversations group by all),
m as (select c.conv_id, c.turn, c.role, coalesce('>> ' || replace(b.said, chr(10), chr(10) || '>> ') || chr(10), '')
    || coalesce('> ' || replace(a.said, chr(10), chr(10) || '> ') || chr(10), '') || coalesce(c.text, '') as text
    from conversations c left join said a on a.conv_id = c.conv_id and a.turn + 1 = c.turn left join said b on b.conv_id = c.conv_id and b.turn + 2 = c.turn),
n as (select *, row_number() over (partition by conv_id order by turn, role, text) - 1 as place from m),
split as (select conv_id, place, turn, role, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) as line,
    generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) as pos from n),
l as (select *, length(replace(regexp_extract(line, '^((?: ?>)+) ?', 1), ' ', '')) as level, regexp_replace(line, '^((?: ?>)+) ?', '') as words from split),
own as (select conv_id, place, turn, role, regexp_replace(coalesce(string_agg(words, chr(10) order by pos) filter (where level = 0), ''), '^\s+|\s+$', '', 'g') as text, max(level) as depth from l group by all),
s as (select *, case when level = lag(level) over (partition by conv_id, place order by pos) then 0 else 1 end as new from l),
r as (select *, sum(new) over (partition by conv_id, place order by pos) as passage from s),
p as (select conv_id, place, turn, passage, level, string_agg(words, chr(10) order by pos) as words from r where level > 0 group by all),
u as (select conv_id, place, turn, passage, level, 1 as whole, words as u from p union all select conv_id, place, turn, passage, level, 0, unnest(string_split(words, chr(10))) from p),
k as (select conv_id, turn, text as u from own union all select conv_id, turn, unnest(string_split(text, chr(10))) from own),
f as (select conv_id, trim(regexp_replace(lower(u), '\s+', ' ', 'g')) as u, min(turn) as original from k group by all),
x as (select u.conv_id, place, passage, level, max({'whole': whole, 'size': length(f.u), 'original': original}) as b
    from u join f on f.conv_id = u.conv_id and f.u = trim(regexp_replace(lower(u.u), '\s+', ' ', 'g')) and f.u <> '' and original < turn group by all),
g as (select conv_id, place, max({'near': -level, 'original': b.original}).original as reply_to, count(*) as linked from x group by all),
q as (select conv_id, place, count(*) as quotes from p group by all)
select own.conv_id, own.place, turn, role, text, reply_to, coalesce(quotes, 0) as quotes, coalesce(linked, 0) as linked, depth
from own left join g on g.conv_id = own.conv_id and g.place = own.place left join q on q.conv_id = own.conv_id and q.place = own.place
"""


@query
def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals for every context limit over the byte-level BPE lengths of documents."""
    docs = table(spark, sf_dir, "documents")
    return context_totals(length_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


@query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the labels of four fifths."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    held_out = F.coalesce(F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))  # nothing is learned from a row without an id
    return out.select("row.doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), "found.score", F.col("found.bits").alias("bits_per_symbol"))


@query
def op7_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token store of documents with Elias-Fano boundaries, written and read back."""
    path = new_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_boundaries(spark, path)


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts of documents."""
    out = exact_dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op8_exact_dedup"] = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents),
g as (select text_sha256, min(doc_id) as keep_id, count(*) as group_size from t group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, t.text_sha256 from t join g on t.text_sha256 = g.text_sha256
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of documents."""
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules of documents: the written ledger judged by the newest policy."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    written = cut(rule_ledger.ledger(docs).select(F.col("row.doc_id").alias("doc_id"), "measured", "fail_bits"), "ledger")
    m = [F.col(f"measured.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    kept = rule_ledger.verdict(rule_ledger.POLICIES[-1])
    return written.select("doc_id", *m, (rule_ledger.fails(rule_ledger.BASE) > 0).alias("base_failed"), kept.alias("kept"), "fail_bits")


ORACLE_SQL["op11_rule_ledger"] = r"""
with d as (select doc_id, coalesce(text, '') as text, row_number() over () as k from documents),
w as (select k, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i from d),
s as (select k, i, word, array_agg(word) over (partition by k order by i rows between current row and 7 following) as win from w),
c as (select k, i, word, case when len(win) = 8 and count(*) over (partition by k, win) > 1 then 1 else 0 end as hit from s),
r as (select k, word, max(hit) over (partition by k order by i rows between 7 preceding and current row) as covered from c),
m as (select k, count(*) as n_words, sum(length(word)) as word_chars, count(*) filter (where regexp_matches(word, '\p{L}')) as n_lettered, sum(covered) as n_repeat_words from r group by k),
l as (select k, unnest(string_split(text, chr(10))) as line from d),
g as (select k, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by k),
a as (select doc_id, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, coalesce(n_lines, 0) as n_lines, coalesce(n_lettered, 0) as n_lettered
    from d left join m on m.k = d.k left join g on g.k = d.k),
b as (select *, cast(n_words < 20 as bigint) + 2 * cast(100 * n_repeat_words > 30 * n_words as bigint) + 4 * cast(10 * n_symbols > n_words as bigint)
    + 8 * cast(n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines as bigint) + 16 * cast(word_chars < 2 * n_words or word_chars > 14 * n_words as bigint)
    + 32 * cast(10 * n_lettered < 7 * n_words as bigint) as fail_bits from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
"""


def with_periods(docs: DataFrame) -> DataFrame:
    """documents, those whose id's CRC-32 is divisible by 10 made periodic from some word on."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.withColumns({"g": F.floor(crc / 10), "words": F.when(crc % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)))})
    placed = words.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    moved = F.expr("array_join(transform(sequence(0, n - 1), i -> words[cast(if(i >= a, a + (i - a) % p, i) as int)]), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), moved).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of documents, the longest one, and digests of all runs and of the text without their repeats."""
    out = periodic_runs(with_periods(table(spark, sf_dir, "documents")), keep=["doc_id"], as_digest=True)
    best = out.withColumn("best", longest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period"))
    return best.select("row.doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", milli.alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of two to five words of each language of documents."""
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def _sql_phrases() -> str:
    """Phrases of each length by windows over the words of pieces, counted; parts are looked up by their text."""
    windows = " union all ".join(
        f"select lang, {k} as k, array_to_string(list_slice(ws, cast(i as integer), cast(i as integer) + {k - 1}), ' ') as phrase from p, unnest(generate_series(1, len(ws) - {k - 1})) u(i)" for k in range(1, 6)
    )
    return rf"""
with q as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) as piece from documents),
p as (select lang, regexp_extract_all(piece, '[^ 	]+') as ws from q),
t as (select lang, sum(len(ws)) as n from p group by lang),
f as materialized (select lang, k, phrase, count(*) as a from ({windows}) group by all having count(*) >= 100),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as ws from f where k > 1),
x as (select c.lang, c.k, c.phrase, c.a, j, array_to_string(list_slice(ws, 1, cast(j as integer)), ' ') as one, array_to_string(list_slice(ws, cast(j as integer) + 1, c.k), ' ') as two from c, unnest(generate_series(1, c.k - 1)) u(j)),
s as (select x.lang, x.k, x.phrase, x.a, j, fl.a as l, fr.a as r, t.n, (1000 * cast(x.a as hugeint) * cast(t.n as hugeint)) // (cast(fl.a as hugeint) * fr.a) as score
    from x join f fl on fl.lang = x.lang and fl.phrase = one join f fr on fr.lang = x.lang and fr.phrase = two join t on t.lang = x.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, j) as best from s qualify best = 1),
o as (select distinct c.lang, sub.phrase from c, lateral (select array_to_string(list_slice(c.ws, cast(i as integer), cast(i + m as integer)), ' ') as phrase from unnest(generate_series(1, c.k - 1)) u(i), unnest(generate_series(1, c.k - 2)) v(m) where i + m <= c.k) sub
    join f on f.lang = c.lang and f.phrase = sub.phrase where 100 * c.a >= 100 * f.a),
z as (select b.* from b anti join o on o.lang = b.lang and o.phrase = b.phrase)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from z qualify rank <= 2000
"""


ORACLE_SQL["op13_phrases"] = _sql_phrases()
