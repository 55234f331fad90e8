"""Conversations from messages that quote one another.

Lines that begin with ``>`` marks are quotes, as deep as they have marks. Runs of quoted
lines of one depth are passages. A passage's key is the hash of its letters and digits,
lower-cased, with single spaces. Every message offers, as keys, its own whole text
without quotes and each of its own lines; a passage is linked to the earliest earlier
message of its conversation that offers its key. A passage that no earlier message offers
is linked to the earliest one whose own words hold the passage's words in a row, wherever
lines or quotes break them. So a passage that runs words of two messages together, or
leaves out words, stays unlinked. A message answers the message that its first linked
passage of least depth comes from; a message without a linked passage goes on from the
one before it.

The result is in reply order: after a message come the answers to it that others began,
each with what goes on from it, in turn order, and then what goes on from the message
itself. Only DataFrame functions are used; the one row per key on the offering side
keeps joins from multiplying, whatever passage is common. No window or group holds one
whole long conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm import runtime

#: Turns gathered in one window at most, however long a conversation is.
SPAN = 4096
#: Of a passage sought within messages, so many first words (or all) say where to look.
HEAD = 4
#: A line that names the author of what is quoted right below it.
ATTRIBUTION = r"(?iU)^.{0,200}\b(wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe)( [^:]{0,80})?:\s*$"


def _plain(text: F.Column) -> F.Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _key(text: F.Column) -> F.Column:
    plain = _plain(text)
    return F.when(plain != "", F.sha2(plain, 256))


def _once(rows: DataFrame, name: str, value: F.Column) -> DataFrame:
    """Adds a column that is evaluated once a row, however often it is used."""
    return rows.select("*", F.inline(F.array(F.struct(value.alias(name)))))


def parse(messages: DataFrame) -> DataFrame:
    """Per message: its own text without quotes (``body``), and its passages as ``quotes`` (array of struct depth, text).
    Lines that only name whose words are quoted below (ATTRIBUTION) belong to neither. Work grows with the lines."""
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\n")
    marks = lambda s: F.regexp_extract(s, r"^[ \t]*((?:>[ \t]*)*)", 1)
    cut = F.transform(lines, lambda s: F.struct(F.length(F.regexp_replace(marks(s), r"[^>]", "")).alias("depth"), F.regexp_replace(s, r"^[ \t]*(?:>[ \t]*)*", "").alias("text"), s.alias("line")))
    out = _once(messages, "_all", cut)

    def names_author(x: F.Column, i: F.Column) -> F.Column:
        after, second = F.get("_all", i + 1), F.get("_all", i + 2)
        deeper = (after["depth"] > x["depth"]) | ((F.trim(after["text"]) == "") & (after["depth"] == x["depth"]) & (second["depth"] > x["depth"]))
        return F.coalesce(deeper, F.lit(False)) & x["text"].rlike(ATTRIBUTION)

    out = _once(out, "_lines", F.filter("_all", lambda x, i: ~names_author(x, i)))
    body = F.trim(F.array_join(F.transform(F.filter("_lines", lambda x: x["depth"] == 0), lambda x: x["line"]), "\n"))
    # Runs of lines of one depth, from where the depth changes to where it changes next.
    changes = F.filter(F.transform("_lines", lambda x, i: F.when((i == 0) | (F.get("_lines", i - 1)["depth"] != x["depth"]), i)), lambda i: i.isNotNull())
    out = _once(out, "_changes", changes)
    ends = F.concat(F.slice("_changes", 2, F.size("_lines")), F.array(F.size("_lines")))
    runs = F.transform(
        F.arrays_zip(F.col("_changes").alias("first"), ends.alias("end")),
        lambda r: F.struct(F.get("_lines", r["first"])["depth"].alias("depth"), F.array_join(F.transform(F.slice("_lines", r["first"] + 1, r["end"] - r["first"]), lambda x: x["text"]), "\n").alias("text")),
    )
    quoted = F.filter(runs, lambda r: r["depth"] > 0)
    return out.withColumn("body", body).withColumn("quotes", quoted).drop("_all", "_lines", "_changes")


def _within(parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """The earliest message whose own words hold the words of each passage of ``asked`` (conv_id, plain, key) in a row:
    ``conv_id, key, source``. Windows are hashed only where a passage's first words stand, and in the lengths sought there."""
    words = F.split("plain", " ")
    sought = asked.select("conv_id", "plain").distinct().select("conv_id", F.array_join(F.slice(words, 1, HEAD), " ").alias("head"), F.size(words).alias("n"))
    heads = sought.groupBy("conv_id", "head").agg(F.collect_set("n").alias("lengths"))
    own = parsed.join(sought.select("conv_id").distinct(), "conv_id", "left_semi").select("conv_id", "turn", F.split(_plain(F.col("body")), " ").alias("words")).filter("words[0] != ''")
    # A passage shorter than HEAD is its own head, so heads of fewer words are looked up as well.
    starts = F.flatten(F.transform(F.sequence(F.lit(1), F.size("words")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(HEAD), F.size("words") - i + 1)), lambda k: F.struct(i.alias("at"), F.array_join(F.slice("words", i, k), " ").alias("head")))))
    places = own.select("conv_id", "turn", F.explode(starts).alias("p")).select("conv_id", "turn", "p.at", "p.head")
    hits = places.join(heads, ["conv_id", "head"]).select("conv_id", "turn", "at", F.explode("lengths").alias("n"))
    hits = hits.groupBy("conv_id", "turn").agg(F.collect_set(F.struct("at", "n")).alias("hits"))
    windows = own.join(hits, ["conv_id", "turn"]).select("conv_id", "turn", F.explode(F.filter("hits", lambda h: h["at"] + h["n"] - 1 <= F.size("words"))).alias("h"), "words")
    keys = windows.select("conv_id", "turn", F.sha2(F.array_join(F.slice("words", F.col("h.at"), F.col("h.n")), " "), 256).alias("key"))
    return keys.groupBy("conv_id", "key").agg(F.min("turn").alias("source"))


def link(parsed: DataFrame) -> DataFrame:
    """Per conversation and turn with a linked passage: ``conv_id, turn, answers`` (the turn answered) and ``n_linked``."""
    offers = parsed.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(F.transform(F.concat(F.array("body"), F.split("body", "\n")), _key), lambda k: k.isNotNull()))).alias("key"))
    first = offers.groupBy("conv_id", "key").agg(F.min("turn").alias("source"))
    asked = parsed.filter(F.size("quotes") > 0).select("conv_id", "turn", F.posexplode("quotes").alias("place", "quote"))
    asked = asked.select("conv_id", "turn", "place", F.col("quote.depth").alias("depth"), _plain(F.col("quote.text")).alias("plain")).filter("plain != ''").withColumn("key", F.sha2("plain", 256))
    asked = runtime.cut(asked.join(first, ["conv_id", "key"], "left").withColumn("source", F.expr("if(source < turn, source, null)")), "asked")
    met, missed = asked.filter("source is not null"), asked.filter("source is null").drop("source")
    if not missed.isEmpty():
        inside = missed.join(_within(parsed, missed), ["conv_id", "key"]).filter("source < turn")
        met = met.unionByName(inside.select(met.columns))
    return met.groupBy("conv_id", "turn").agg(F.min_by("source", F.struct("depth", "place")).alias("answers"), F.count("*").alias("n_linked"))


def _neighbour(rows: DataFrame, keys: list[str], out: str, later: bool) -> DataFrame:
    """Adds the nearest earlier (or later) turn among rows of the same keys; no window holds more than SPAN turns or one row per span."""
    span = F.floor(F.col("turn") / SPAN)
    rows = rows.withColumn("_span", span)
    own, spans = Window.partitionBy(*keys, "_span").orderBy("turn"), Window.partitionBy(*keys).orderBy("_span")
    ends = runtime.cut(rows.groupBy(*keys, "_span").agg(F.min("turn").alias("_first"), F.max("turn").alias("_last")), "spans")
    ends = ends.select(*keys, "_span", (F.lead("_first") if later else F.lag("_last")).over(spans).alias("_far"))
    near = rows.withColumn("_near", (F.lead("turn") if later else F.lag("turn")).over(own))
    return near.join(ends.hint("merge"), [*keys, "_span"]).withColumn(out, F.coalesce("_near", "_far")).drop("_span", "_near", "_far")


def _in_turn_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, position`` where nothing is answered: the number of earlier turns."""
    rows = rows.select("conv_id", "turn", F.floor(F.col("turn") / SPAN).alias("_span"))
    before = Window.partitionBy("conv_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv_id", "_span").agg(F.count("*").alias("_n")).select("conv_id", "_span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "_span").orderBy("turn"))
    return rows.withColumn("_own", own).join(counts.hint("merge"), ["conv_id", "_span"]).select("conv_id", "turn", (F.col("_before") + F.col("_own") - 1).alias("position"))


def _in_reply_order(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, position`` of messages (``answers``: the turn answered, else null) in reply order.

    The tree is walked as a list: a message is entered, then left behind all that hangs on it. The list's ranks come from
    pointer doubling, so a thread of any depth takes rounds in proportion to its logarithm and rows in proportion to its length."""
    rows = runtime.cut(_neighbour(rows.select("conv_id", "turn", "answers"), ["conv_id"], "before", later=False), "turns")
    goes_on = rows.filter("answers is null and before is not null").select("conv_id", F.col("before").alias("at"), F.col("turn").alias("onward"))
    begun = rows.filter("answers is not null").select("conv_id", "turn", F.col("answers").alias("at"))
    first = begun.groupBy("conv_id", "at").agg(F.min("turn").alias("begun"))
    beside = _neighbour(begun, ["conv_id", "at"], "beside", later=True).join(goes_on.hint("merge"), ["conv_id", "at"], "left")
    beside = beside.select("conv_id", "turn", F.coalesce("beside", "onward").alias("beside"))
    below = first.join(goes_on.hint("merge"), ["conv_id", "at"], "full").select("conv_id", F.col("at").alias("turn"), F.coalesce("begun", "onward").alias("below"))
    tree = rows.join(below.hint("merge"), ["conv_id", "turn"], "left").join(beside.hint("merge"), ["conv_id", "turn"], "left")
    enter, leave = F.col("turn") * 2, F.col("turn") * 2 + 1
    up = F.coalesce("answers", "before")
    after = F.when(F.col("beside").isNotNull(), F.col("beside") * 2).otherwise(up * 2 + 1)
    events = F.array(F.struct(enter.alias("e"), F.coalesce(F.col("below") * 2, leave).alias("next"), F.lit(1).cast("long").alias("n")), F.struct(leave.alias("e"), after.alias("next"), F.lit(0).cast("long").alias("n")))
    walk = runtime.cut(tree.select("conv_id", F.explode(events).alias("x")).select("conv_id", "x.e", "x.next", "x.n"), "walk")
    while not walk.filter("next is not null").isEmpty():
        far = walk.select("conv_id", F.col("e").alias("next"), F.col("next").alias("_next"), F.col("n").alias("_n"))
        doubled = walk.join(far.hint("merge"), ["conv_id", "next"], "left").select("conv_id", "e", F.col("_next").alias("next"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"))
        earlier, walk = walk, runtime.cut(doubled, "walk")
        runtime.drop(earlier)
    entered = walk.filter("e % 2 = 0")
    whole = runtime.cut(entered.groupBy("conv_id").agg(F.max("n").alias("_whole")), "whole")
    return entered.join(whole.hint("merge"), "conv_id").select("conv_id", (F.col("e") / 2).cast("long").alias("turn"), (F.col("_whole") - F.col("n")).alias("position"))


def conversations(messages: DataFrame) -> DataFrame:
    """Messages (``conv_id, turn, role, text``) without quotes and in reply order: per message ``conv_id, turn, role, body, answers,
    n_quotes, n_linked, position`` (from 0, in its conversation) and ``chat``, its text for training.

    Null texts are empty messages, and null roles become ``user``. Rows without a conversation or turn are left out. Of rows
    that repeat a turn the one of least role and text stays. Other columns of the input are ignored. An empty table gives no rows.
    """
    base = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).filter("conv_id is not null and turn is not null")
    base = base.groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m")).select("conv_id", "turn", "m.role", "m.text")
    parsed = runtime.cut(parse(base).drop("text"), "messages")
    linked = runtime.cut(link(parsed), "links")
    if linked.isEmpty():
        placed = _in_turn_order(parsed)
    else:
        some = runtime.cut(linked.select("conv_id").distinct(), "answering")
        rows = parsed.select("conv_id", "turn").join(linked.select("conv_id", "turn", "answers").hint("merge"), ["conv_id", "turn"], "left")
        placed = _in_turn_order(rows.join(some.hint("merge"), "conv_id", "left_anti")).unionByName(_in_reply_order(rows.join(some.hint("merge"), "conv_id", "left_semi")))
    out = parsed.join(linked.hint("merge"), ["conv_id", "turn"], "left").join(placed.hint("merge"), ["conv_id", "turn"])
    return formatted(out.select("conv_id", "turn", "role", "body", "answers", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "position"))


def formatted(conv: DataFrame) -> DataFrame:
    """Per message the chat text ``<|role|>\\nbody\\n``."""
    return conv.withColumn("chat", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "body", F.lit("\n")))
