"""Quotation linking for mail-like conversations, in DataFrame operations only.

A line's quote level is the number of ``>`` it starts with (a space may precede each). Lines of level 0 are a message's own
words; each run of lines of one higher level is a quoted passage. Own words and passages are normalised (lower case, white
space collapsed) and hashed: a message as a whole and each of its lines, a passage likewise. A passage is linked to the
message in which its conversation has it first, if that is an earlier turn: as a whole where that is found, else by the
longest of its lines that is. A message replies to the latest message that its least deep quotes link to.

Conversations come back in reply order, without quotes: a reply always follows what it quotes, since links only go to
earlier turns. Places are counted in three steps: turns in ranges of RANGE, turns and shares of a turn's messages (by hash)
within a range, then messages within a share; so neither a conversation nor a turn that holds many of all rows is sorted in
one task. Original hashes are reduced to one row per (conversation, hash) before they are joined, so a passage that many
messages share makes no pairs.

Messages are told apart by a number that is written with them, so rows that repeat or differ only in a null stay rows of
their own.

Defined results: a null text is empty; a message without a conversation is in none, so it links to nothing and has a null
place; one without a turn links to nothing and comes first in its conversation; blank passages are not linked; messages that
share (conversation, turn) follow each other in the order of a hash of role and text; an empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.session import cut

RANGE = 256
#: Shares of one turn's messages.
SHARES = 256
QUOTE = r"^((?: ?>)+) ?"


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 1), " ", ""))


def lines_of(text: Column) -> Column:
    """Array of (level, words) of a text's lines."""
    return F.transform(F.split(text, r"\r?\n"), lambda x: F.struct(level_of(x).alias("level"), F.regexp_replace(x, QUOTE, "").alias("words")))


def parse(messages: DataFrame) -> DataFrame:
    """Adds lines and own, the text without quotes."""
    lined = messages.withColumn("lines", lines_of(F.coalesce("text", F.lit(""))))
    own = F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == 0), lambda x: x["words"]), "\n")
    return lined.withColumn("own", F.regexp_replace(own, r"^\s+|\s+$", ""))


def passages(lines: Column) -> Column:
    """Array of (level, words): each run of lines of one level above 0, in order; taken within the row, so nothing moves."""
    level = lambda i: F.element_at(lines, i)["level"]
    n = F.size(lines)
    starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (level(i) != level(F.greatest(i - 1, F.lit(1)))))
    ends = F.concat(F.slice(starts, F.lit(2), n), F.array(n + 1))
    runs = F.zip_with(
        starts, ends, lambda a, z: F.struct(level(a).alias("level"), F.array_join(F.transform(F.slice(lines, a, z - a), lambda x: x["words"]), "\n").alias("words"))
    )
    return F.filter(runs, lambda r: r["level"] > 0)


def units(words: Column) -> Column:
    """Array of (whole, size, hash) of a text as a whole and of its lines, blank ones left out; the hash has 64 bits, and only
    meets those of its own conversation."""
    whole = F.array(F.struct(F.lit(1).alias("whole"), normal(words).alias("u")))
    each = F.transform(F.split(words, "\n"), lambda x: F.struct(F.lit(0).alias("whole"), normal(x).alias("u")))
    return F.transform(F.filter(F.concat(whole, each), lambda x: x["u"] != ""), lambda x: F.struct(x["whole"].alias("whole"), F.length(x["u"]).alias("size"), F.xxhash64(x["u"]).alias("hash")))


def links(parsed: DataFrame) -> DataFrame:
    """(uid, passage, level, original): the turn that each linked passage is first found in."""
    known = parsed.filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode(units(F.col("own"))).alias("x"))
    first = known.groupBy("conv_id", F.col("x.hash").alias("hash")).agg(F.min("turn").alias("original"))
    quoted = parsed.filter(F.size("passages") > 0).select("uid", "conv_id", "turn", F.posexplode("passages").alias("passage", "p"))
    asked = quoted.select("uid", "conv_id", "turn", "passage", "p.level", F.explode(units(F.col("p.words"))).alias("x")).select("uid", "conv_id", "turn", "passage", "level", "x.*")
    hits = asked.join(first, ["conv_id", "hash"]).filter("original < turn")
    best = F.max(F.struct("whole", "size", "original"))
    return hits.groupBy("uid", "passage", "level").agg(best.alias("b")).select("uid", "passage", "level", "b.original")


def places(messages: DataFrame) -> DataFrame:
    """Adds place, from 0, of each message in its conversation by turn and hash (the column h); null without a conversation. The
    messages move once."""
    none = F.lit(-(1 << 63))
    keys = {"ck": F.col("conv_id"), "rk": F.coalesce(F.floor(F.col("turn") / RANGE), none), "tk": F.coalesce("turn", none), "unset": F.isnull("turn"), "share": F.pmod("h", F.lit(SHARES))}
    inside = messages.filter("conv_id is not null")
    shares = inside.select("conv_id", "turn", "h").withColumns(keys).groupBy(*keys).agg(F.count("*").alias("n"))
    ranges = shares.groupBy("ck", "rk").agg(F.sum("n").alias("n"))
    before = lambda key, *order: F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = ranges.select("ck", "rk", before(["ck"], "rk").alias("range_base"))
    within = shares.select(*keys, before(["ck", "rk"], F.desc("unset"), "tk", "share").alias("share_base"))
    first = within.join(base, ["ck", "rk"]).select(*keys, (F.col("range_base") + F.col("share_base")).alias("base"))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("h", "uid")) - 1
    placed = inside.withColumns(keys).withColumn("at", at).join(first, list(keys)).withColumn("place", (F.col("base") + F.col("at")).cast("long"))
    columns = [*messages.columns, "place"]
    return placed.select(columns).unionByName(messages.filter("conv_id is null").withColumn("place", F.lit(None).cast("long")).select(columns))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn, role, text, reply_to, quotes, linked, depth): messages in reply order, without quotes.

    reply_to is the turn that the message answers; quotes and linked count its quoted passages; depth is its deepest quote.
    """
    messages = conversations.select("conv_id", "turn", "role", "text", F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("h"))
    numbered = parse(messages).withColumn("uid", F.monotonically_increasing_id())
    parsed = cut(numbered.select("uid", "h", "conv_id", "turn", "role", "own", passages(F.col("lines")).alias("passages")), "parsed")
    found = links(parsed).groupBy("uid").agg(
        F.max(F.struct((-F.col("level")).alias("near"), "original")).alias("b"), F.countDistinct("passage").alias("linked")
    ).select("uid", F.col("b.original").alias("reply_to"), "linked")
    depth = F.coalesce(F.array_max(F.transform("passages", lambda x: x["level"])), F.lit(0))
    counted = parsed.select("uid", "h", "conv_id", "turn", "role", "own", F.size("passages").cast("long").alias("quotes"), depth.cast("long").alias("depth"))
    linked = places(counted).join(found, "uid", "left")
    return linked.select("conv_id", "place", "turn", "role", F.col("own").alias("text"), "reply_to", "quotes", F.coalesce("linked", F.lit(0)).cast("long").alias("linked"), "depth")
