"""WARC derivatives: linked metadata and plain-text conversion records of response records.

A response has a record id, a target URI, a date, its HTTP headers and its payload. Each gives two records that refer to
it: ``metadata`` (application/warc-fields: title, language, outlinks, sizes) and ``conversion`` (text/plain: the visible
text). Both keep the source's headers and payload digest, have ids and block digests of their own, and come with the header
block of their WARC record. Record ids are name-based, so a run over the same responses gives the same ids. Everything is a
projection: no shuffle. Character references of any kind, numeric or named, are resolved as browsers do, in text and title.

Defined results: a null payload counts as empty, null headers stay null, a null URI is an empty name and a null URI or date has
no header line; elements, comments and tags that are never closed are text; a page of any length is read in time linear in it;
repeated responses give repeated records; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Alphabet of base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Elements that start a line of their own.
BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul|title"
#: Opening and closing of what is left out of the text.
DROPPED = [tuple(re.compile(p, re.A) for p in pair) for pair in ((r"<!--", r"-->"), (r"(?i)<script\b", r"(?i)</script\s*>"), (r"(?i)<style\b", r"(?i)</style\s*>"))]
BLOCK, TAG = re.compile(rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>", re.A), re.compile(r"<[^>]*>")
BLANKS, LINES, ENDS = re.compile(r"[ \t\r\f]+"), re.compile(r" ?\n[ \n]*"), re.compile(r"^[ \n]+|[ \n]+$")
TITLE, HTML, LANG, ANCHOR, HREF = (re.compile(p, re.A | re.I) for p in (r"<title", r"<html", r"\blang=\"", r"<a\s", r"href="))


def resolved(text: str) -> str:
    """Character references as characters, hard spaces as spaces."""
    return html.unescape(text).replace("\xa0", " ")


def without(page: str, opening: re.Pattern, closing: re.Pattern) -> str:
    """A page with a space for each stretch from an opening to the next closing; what is never closed stays. One pass: where no closing
    follows an opening, none follows the later ones."""
    out, at = [], 0
    while (first := opening.search(page, at)) and (last := closing.search(page, first.end())):
        out += [page[at : first.start()], " "]
        at = last.end()
    return "".join([*out, page[at:]])


def visible_text(page: str) -> str:
    """Text of a page: no comments, scripts or styles; block elements as lines; references resolved; white space collapsed."""
    for opening, closing in DROPPED:
        page = without(page, opening, closing)
    end = page.rfind(">") + 1  # no tag ends behind it, so none is looked for there
    text = resolved(TAG.sub("", BLOCK.sub("\n", page[:end])) + page[end:])
    return ENDS.sub("", LINES.sub("\n", BLANKS.sub(" ", text)))


def title_of(page: str) -> str:
    """What stands between the first title tag and the next tag; nothing where either doesn't end."""
    first = TITLE.search(page)
    begin = page.find(">", first.end()) + 1 if first else 0
    end = page.find("<", begin) if begin else -1
    return resolved(page[begin:end]) if end >= 0 else ""


def language_of(page: str) -> str:
    """The last ``lang`` attribute of the first html tag that has one, its value up to the next quote."""
    at = 0
    while first := HTML.search(page, at):
        end = page.find(">", first.end())
        end = len(page) if end < 0 else end
        for found in [m.end() for m in LANG.finditer(page, first.end(), end)][::-1]:
            if (quote := page.find('"', found)) >= 0:
                return page[found:quote]
        at = end
    return ""


def outlinks_of(page: str) -> int:
    """Anchors with a reference."""
    places = [m.start() for m in HREF.finditer(page)]
    count = at = 0
    while places and (first := ANCHOR.search(page, at)):
        end = page.find(">", first.end())
        last = bisect(places, (len(page) if end < 0 else end) - len("href=")) - 1
        if last >= 0 and places[last] >= first.end():
            count, at = count + 1, places[last] + len("href=")
        elif end < 0:
            break
        else:
            at = end
    return count


def _read_pages(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for p in pages:
        yield pd.DataFrame({"text": [visible_text(x) for x in p], "title": [title_of(x) for x in p], "language": [language_of(x) for x in p], "outlinks": [outlinks_of(x) for x in p]})


def uuid_of(name: Column) -> Column:
    """A name-based record id."""
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def digest(block: Column) -> Column:
    """Labelled digest, ``sha1:`` and base 32."""
    h = F.sha1(block)
    parts = [F.translate(F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0"), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32) for i in range(4)]
    return F.concat(F.lit("sha1:"), *parts)


def derive(responses: DataFrame) -> DataFrame:
    """(record_id, uri, date, headers, payload) -> two rows a response: record_id, warc_type, refers_to, refers_to_uri,
    refers_to_date, source_headers, source_digest, content_type, content_length, block_digest, warc_header, block."""
    source = responses.select("record_id", "uri", "date", "headers", F.coalesce("payload", F.lit("")).alias("payload"))
    read = source.withColumn("page", F.pandas_udf("text string, title string, language string, outlinks int")(_read_pages)("payload")).select(
        "record_id", "uri", "date", "headers", "page.*",
        digest(F.col("payload").cast("binary")).alias("source_digest"),
    )
    fields = F.concat(
        F.lit("title: "), F.trim(F.regexp_replace("title", r"\s+", " ")), F.lit("\r\nlanguage: "), F.col("language"),
        F.lit("\r\noutlinks: "), F.col("outlinks").cast("string"), F.lit("\r\ntext-characters: "), F.length("text").cast("string"), F.lit("\r\n"),
    )
    name = lambda kind: uuid_of(F.concat_ws(" ", F.lit(kind), F.coalesce("record_id", F.lit(""))))
    records = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), name("metadata").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), name("conversion").alias("record_id"), F.lit("text/plain; charset=UTF-8").alias("content_type"), F.col("text").alias("block")),
    )
    made = read.select(F.col("record_id").alias("refers_to"), F.col("uri").alias("refers_to_uri"), F.col("date").alias("refers_to_date"), F.col("headers").alias("source_headers"), "source_digest", F.explode(records).alias("r"))
    out = made.select("r.warc_type", "r.record_id", "refers_to", "refers_to_uri", "refers_to_date", "source_headers", "source_digest", "r.content_type", F.octet_length("r.block").alias("content_length"), digest(F.col("r.block").cast("binary")).alias("block_digest"), "r.block")
    line = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    header = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Refers-To-Target-URI", "refers_to_uri"),
        line("WARC-Refers-To-Date", "refers_to_date"), line("WARC-Target-URI", "refers_to_uri"), line("WARC-Date", "refers_to_date"), line("WARC-Block-Digest", "block_digest"),
        line("Content-Type", "content_type"), F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")), F.lit("\r\n"),
    )
    return out.withColumn("warc_header", header)
