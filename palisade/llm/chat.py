"""Quotation linking of conversations, in DataFrame functions only.

Lines that start with ``>`` are quotes; the number of markers is the level. Lines in a
row of one level are a passage, whose words are normalised: case, blanks and line breaks
do not matter, so a quote that was wrapped anew is still itself. A passage is hashed in
windows of WINDOW words (a shorter one as a whole) and joined to the latest earlier
messages of the conversation that have these windows (or that line) as their own text;
it comes from the message that most of them, and at least half, are found in. A message
replies to the message that most words of its least nested passages come from. Replies
hang under what they answer, quotes are cut out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import written

MARK = r"^[ \t]*((?:>[ \t]?)+)"
#: A text with a line that MARK is found in.
QUOTES = r"(?:^|\n)[ \t]*>"
#: Words of a passage that are hashed together.
WINDOW = 6
#: Bytes of text whose windows a task makes.
PIECE = 4 << 20


def words_of(line: Column) -> Column:
    """Words between blanks, A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[ \t\r]+", -1), "")


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, place, level, lines) of every passage of every message: the words of each of its lines; level 0 is own text."""
    rows = messages.select("conv_id", "turn", F.xxhash64("text").alias("message"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))

    def read(line: Column) -> Column:
        mark = F.regexp_extract(line, MARK, 1)
        level = F.char_length(mark) - F.char_length(F.replace(mark, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), words_of(F.when(level > 0, F.regexp_replace(line, MARK, "")).otherwise(line)).alias("words"))

    rows = rows.select("conv_id", "turn", "message", F.transform("lines", read).alias("lines"))
    starts = F.filter(F.sequence(F.lit(1), F.size("lines")), lambda k: (k == 1) | (F.get("lines", k - 1)["level"] != F.get("lines", k - 2)["level"]))
    rows = rows.withColumn("starts", starts)
    stop = lambda at: F.coalesce(F.get("starts", at + 1), F.size("lines") + 1)
    cut = F.transform("starts", lambda k, at: F.struct(F.get("lines", k - 1)["level"].alias("level"), F.transform(F.slice("lines", k, stop(at) - k), lambda x: x["words"]).alias("lines")))
    return rows.select("conv_id", "turn", "message", F.posexplode(cut).alias("place", "p")).select("conv_id", "turn", "message", "place", "p.level", "p.lines")


def digest_of(words: Column) -> Column:
    """96 bits of hash and the number of words."""
    text = F.array_join(words, " ")
    return F.struct(F.xxhash64(text).alias("h1"), F.hash(text).alias("h2"), F.size(words).alias("n"))


def quoting_messages(messages: DataFrame) -> tuple[DataFrame, int]:
    """(conv_id, turn, text) of the conversations that have a quote, repeated rows once; dealt so that each of so many tasks has about PIECE bytes of text."""
    placed = messages.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    quoting = placed.where(F.col("text").rlike(QUOTES)).select("conv_id").distinct()
    found = written(placed.join(quoting, "conv_id", "left_semi").distinct(), "chat-messages")
    pieces = -(-(found.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 1) // PIECE)
    return found.repartition(pieces, "conv_id", "turn", F.xxhash64("text")), pieces


def passage_sources(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, message, place, level, n_words, source): the earlier message that each quoted passage comes from.

    Only conversations that have a quote are looked at further. Windows, many more than messages, are dealt anew by what
    they are joined on, to as many tasks as the text needs: a task's memory does not grow with the table or a conversation.
    """
    messages, pieces = quoting_messages(messages)
    found = passages(messages).withColumn("words", F.flatten("lines")).where(F.size("words") > 0)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - WINDOW, F.lit(0)) + 1), lambda k: F.slice("words", k, WINDOW))
    # A short quote has to be a whole line, or a whole passage, of the original.
    short = F.filter("lines", lambda w: (F.col("level") == 0) & (F.size(w) > 0) & (F.size(w) < WINDOW))
    keys = F.transform(F.concat(windows, short), digest_of)
    said = found.select("conv_id", "turn", "message", "place", "level", F.size("words").alias("n_words"), F.explode(keys).alias("digest"))
    # The latest earlier owner: one pass in order of turns, not a join of all pairs.
    before = Window.partitionBy("conv_id", "digest").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    owned = said.repartition(pieces, "conv_id", "digest").withColumn("source", F.max(F.when(F.col("level") == 0, F.col("turn"))).over(before)).where("level > 0")
    passage = ["conv_id", "turn", "message", "place", "level", "n_words"]
    votes = owned.groupBy(*passage, "source").agg(F.count("*").alias("votes"))
    best = F.max(F.when(F.col("source").isNotNull(), F.struct("votes", "source")))
    told = votes.groupBy(*passage).agg(best.alias("best"), F.sum("votes").alias("all"))
    return told.where(2 * F.col("best.votes") >= F.col("all")).select(*passage, F.col("best.source").alias("source"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, n_matched): the message each quoting message answers, and the quoted words from there."""
    votes = passage_sources(messages).groupBy("conv_id", "turn", "level", "source").agg(F.sum("n_words").alias("matched"))
    rank = F.struct((-F.col("level")).alias("shallow"), F.col("matched"), F.col("source"))
    return votes.groupBy("conv_id", "turn").agg(F.max(rank).alias("best")).select("conv_id", "turn", F.col("best.source").alias("reply_to"), F.col("best.matched").alias("n_matched"))


def thread_places(links: DataFrame) -> DataFrame:
    """(conv_id, turn, thread_turn, depth): root and distance of every linked message, by pointer doubling."""
    reach = written(links.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("depth")), "chat-reach")
    while True:
        further = reach.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"))
        moved = reach.join(further, ["conv_id", "up"], "left")
        if moved.where("up2 IS NOT NULL").isEmpty():
            return reach.select("conv_id", "turn", F.col("up").alias("thread_turn"), "depth")
        reach = written(moved.select("conv_id", "turn", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("depth2", F.lit(0))).alias("depth")), "chat-reach")


def without_quotes(text: Column) -> Column:
    """The text's own lines, ends trimmed of blank lines."""
    own = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda line: ~line.rlike(MARK))
    return F.regexp_replace(F.array_join(own, "\n"), r"^(?:[ \t\r]*\n)+|(?:\n[ \t\r]*)+$", "")


def link_quotations(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, reply_to, thread_turn, depth, n_quoted, body, rendered) per message.

    Reply order is (conv_id, thread_turn, depth, reply_to, turn): what a message
    answers always comes before it. A message without a resolved quote begins a thread
    of its own (reply_to null, depth 0). A null text counts as empty; messages with a
    null conv_id or turn take no part in linking; of several messages with one turn
    all answer alike; repeated rows stay repeated; very long texts are read whole; other
    columns are ignored; an empty table gives no rows. Only earlier turns can be
    answered, so there are no cycles.
    """
    links = written(reply_links(messages), "chat-links")
    placed = links.join(thread_places(links), ["conv_id", "turn"]).drop("n_matched")
    body = without_quotes(F.col("text"))
    quoted = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda line: line.rlike(MARK)))
    rows = messages.select("conv_id", "turn", "role", quoted.cast("long").alias("n_quoted"), body.alias("body"))
    out = rows.join(placed, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "reply_to",
        F.coalesce("thread_turn", "turn").alias("thread_turn"),
        F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        "n_quoted",
        "body",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n<|end|>")).alias("rendered"),
    )


def build_conversations(linked: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, n_messages, text): each thread of link_quotations as one text in reply order, without quotes.

    A thread is one row, so it has to fit into one; link_quotations itself gathers nothing.
    """
    turn = F.struct("depth", "reply_to", "turn", "rendered")
    threads = linked.groupBy("conv_id", "thread_turn").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return threads.select("conv_id", "thread_turn", F.size("turns").alias("n_messages"), F.array_join(F.transform("turns", lambda t: t["rendered"]), "\n").alias("text"))


def quoted_view(messages: DataFrame) -> DataFrame:
    """messages in which turns quote: each the text of the turn before it, every third also, one level deeper, the one before that."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    quote = lambda back, mark: F.concat(F.lit(mark), F.replace(F.lag("text", back).over(order), F.lit("\n"), F.lit(f"\n{mark}")), F.lit("\n"))
    deep = F.when(F.col("turn") % 3 == 2, quote(2, "> > "))
    return messages.select("conv_id", "turn", "role", F.concat(F.coalesce(deep, F.lit("")), F.coalesce(quote(1, "> "), F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))
