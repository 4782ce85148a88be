"""Quotation linking: replies are joined to the messages that they quote, by DataFrame functions only.

A line's quote level is the number of > marks before it; after an "Original Message" line every line is one level deeper,
and its From, Sent, To and Subject lines belong to the quote, as does the "On ... wrote:" line before a quote. Runs of lines
at one level are passages; a quoted passage is looked up, by the hash of its words in lower case, among the passages that
other messages wrote themselves. A message replies to the message of its shallowest quote that is found. Conversations come
out as messages without quotes, thread by thread, ordered by their depth in the reply tree and their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import durable

#: Units of fewer words are too common to link messages of different conversations, or to stand for a longer passage.
LEAST_WORDS = 3
_MARKS = r"^((?:[ \t]*>)+)"
_ORIGINAL = r"(?i)^-{2,} *original message *-{2,}$"
_HEADER = r"(?i)^(from|sent|date|to|cc|subject): "
_INTRODUCTION = r"(?i)^on .+ wrote:$"


def level_of(line: Column) -> Column:
    marks = F.regexp_extract(line, _MARKS, 1)
    return F.length(marks) - F.length(F.translate(marks, ">", ""))


def body_of(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, _MARKS, ""))


def passages(text: Column) -> Column:
    """Array of (level, body) of a text: neighbouring lines of one level together; a blank line ends a passage.

    The steps are lambdas over one array each, so that nothing is computed again for each line; the time is in proportion to
    the lines but for the "Original Message" lines before each.
    """
    # passages are put together in a string between marks; the marks that stand in a text are written in another way there
    coded = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\x02"), F.lit("\x02b")), F.lit("\x01"), F.lit("\x02a"))
    plain = lambda t: F.replace(F.replace(t, F.lit("\x02a"), F.lit("\x01")), F.lit("\x02b"), F.lit("\x02"))
    once = lambda value, f: F.transform(F.array(value), f)[0]
    lines = F.transform(F.split(coded, "\r\n|\n|\r"), lambda x: F.struct(level_of(x).cast("int").alias("level"), body_of(x).alias("body")))

    def deeper(z: Column) -> Column:
        cuts = F.filter(F.transform(z, lambda x, k: F.when(x["body"].rlike(_ORIGINAL), k)), lambda k: k.isNotNull())

        def line(cuts: Column) -> Column:
            def one(x: Column, k: Column) -> Column:
                above = F.size(F.filter(cuts, lambda c: c < k))
                gone = x["body"].rlike(_ORIGINAL) | ((above > 0) & x["body"].rlike(_HEADER))
                return F.struct((x["level"] + above).alias("level"), F.when(gone, "").otherwise(x["body"]).alias("body"))

            return F.transform(z, one)

        return once(cuts, line)

    def without_introductions(z: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            next_, second = F.get(z, k + 1), F.get(z, k + 2)
            quote = (next_["level"] > x["level"]) | ((next_["body"] == "") & (second["level"] > x["level"]))
            return F.struct(x["level"].alias("level"), F.when(x["body"].rlike(_INTRODUCTION) & F.coalesce(quote, F.lit(False)), "").otherwise(x["body"]).alias("body"))

        return F.transform(z, one)

    def joined(z: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            last = F.get(z, k - 1)
            goes_on = F.coalesce((last["level"] == x["level"]) & (last["body"] != ""), F.lit(False))
            return F.when(x["body"] == "", "").when(goes_on, F.concat(F.lit("\n"), x["body"])).otherwise(F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit(":"), x["body"]))

        return F.array_join(F.transform(z, one), "")

    marked = F.filter(F.split(once(once(once(lines, deeper), without_introductions), joined), "\x01"), lambda p: p != "")
    number = lambda p: F.substring_index(p, ":", 1)
    return F.transform(marked, lambda p: F.struct(number(p).cast("int").alias("level"), plain(F.substring(p, F.length(number(p)) + 2, F.length(p))).alias("body")))


def units(body: Column) -> Column:
    """A passage, its lines and its sentences, each once."""
    return F.array_distinct(F.concat(F.array(body), F.split(body, "\n"), F.split(F.translate(body, "\n", " "), r"(?<=[.!?])\s+")))


def passage_key(body: Column) -> Column:
    """Hash of the words in lower case: white space and punctuation at their edges do not matter."""
    return F.md5(F.trim(F.regexp_replace(F.lower(body), r"[^\p{L}\p{N}]+", " ")).cast("binary"))


def quote_links(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, n_quotes, n_linked, parent_conv, parent_turn, root_conv, root_turn, depth, text of every message.

    parent is the message replied to: of the shallowest, then first quoted passage that an earlier message of the same
    conversation wrote, else that a message of another conversation wrote first (least conv_id, turn); null for none.
    root and depth follow the parents within the conversation. text has no quotes. A message is a (conv_id, turn); rows
    that share one are one message each with the same links. Null texts are empty; rows with a null conv_id or turn are
    messages without links. A quoted passage is looked up as a whole and by
    its lines and sentences, and so is what was written; the longest that is found tells. Fewer than LEAST_WORDS words
    link whole passages within the conversation only.
    """
    m = messages.select(messages[conv].cast("long").alias("conv_id"), messages[turn].cast("long").alias("turn"), messages[role].cast("string").alias("role"), passages(messages[text]).alias("p"))
    own = F.array_join(F.transform(F.filter("p", lambda p: p["level"] == 0), lambda p: p["body"]), "\n\n")
    m = durable(m.select("conv_id", "turn", "role", own.alias("text"), "p"))
    cut = m.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.posexplode("p").alias("at", "p")).select("conv_id", "turn", "at", "p.level", "p.body")
    unit = cut.select("conv_id", "turn", "at", "level", F.posexplode(units(F.col("body"))).alias("k", "unit"))
    unit = unit.select("conv_id", "turn", "at", "level", "k", passage_key(F.col("unit")).alias("key"), F.size(F.split("unit", r"\s+")).alias("words"), F.length("unit").alias("size"))
    quoted = durable(unit.where(f"level > 0 AND (k = 0 OR words >= {LEAST_WORDS})"))
    # what was written, looked at only where it is quoted; grouped before it is joined, so a common passage is one row
    keys = quoted.select("key").distinct()
    written = unit.where("level = 0").join(keys, "key", "left_semi")
    here = written.groupBy("key", "conv_id").agg(F.min("turn").alias("first_turn"))
    # the two least conversations of a key, so that one other than the message's own is at hand; each task sends on two rows a key
    two = here.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("conv_id"))).where("r <= 2")
    anywhere = two.groupBy("key").agg(F.min(F.struct("conv_id", "first_turn")).alias("first"), F.max(F.struct("conv_id", "first_turn")).alias("second"))
    found = quoted.join(here, ["key", "conv_id"], "left").join(anywhere, "key", "left")
    inside = F.coalesce(F.col("first_turn") < F.col("turn"), F.lit(False))
    place = lambda c: F.struct(F.col(f"{c}.conv_id").alias("c"), F.col(f"{c}.first_turn").alias("t"))
    other = F.when(F.col("first.conv_id") != F.col("conv_id"), place("first")).when(F.col("second.conv_id") != F.col("conv_id"), place("second"))
    target = F.when(inside, F.struct(F.col("conv_id").alias("c"), F.col("first_turn").alias("t"))).when(F.col("words") >= LEAST_WORDS, other)
    linked = found.select("conv_id", "turn", "level", "at", (-F.col("size")).alias("s"), (~inside).cast("int").alias("away"), "k", target.alias("to")).where("to IS NOT NULL")
    longest = linked.groupBy("conv_id", "turn", "level", "at").agg(F.min(F.struct("s", "away", "k", "to")).alias("x"))
    parents = longest.groupBy("conv_id", "turn").agg(F.min(F.struct("x.away", "level", "at", "x.to")).alias("best"), F.count("*").alias("n_linked"))
    parents = durable(parents.select("conv_id", "turn", F.col("best.to.c").alias("parent_conv"), F.col("best.to.t").alias("parent_turn"), "n_linked"))
    trees = reply_trees(parents.where("parent_conv = conv_id").select("conv_id", "turn", F.col("parent_turn").alias("up")))
    out = m.select("conv_id", "turn", "role", F.size(F.filter("p", lambda p: p["level"] > 0)).cast("long").alias("n_quotes"), "text")
    out = out.join(parents, ["conv_id", "turn"], "left").join(trees, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id", "turn", "role", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
        F.col("conv_id").alias("root_conv"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "text",
    )


def reply_trees(links: DataFrame) -> DataFrame:
    """conv_id, turn, root_turn, depth of every message that replies; links: conv_id, turn, up (an earlier turn).

    Every round doubles how far a message looks up, so a chain of n replies takes log2(n) rounds.
    """
    now = durable(links.select("conv_id", "turn", "up", F.lit(1).cast("long").alias("depth")))
    while True:
        over = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        joined = durable(now.join(over, ["conv_id", "up"], "left"))
        now = joined.select("conv_id", "turn", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        if joined.where("next IS NOT NULL").isEmpty():
            return now.select("conv_id", "turn", F.col("up").alias("root_turn"), "depth")


def conversations_without_quotes(messages: DataFrame) -> DataFrame:
    """The columns of quote_links and place: each conversation's messages in reply order, from 1. The messages of a thread
    stand together, threads in the order of their first messages' turns; a message comes after the one it replies to, and
    messages at one depth keep their turns' order.

    Conversations are cut into ranges of the order, so a long one is sorted by many tasks. A row's place is its place in
    its range and the sizes of its conversation's parts in the ranges before.
    """
    linked = quote_links(messages)
    order = [F.col("conv_id"), F.col("root_turn"), F.col("depth"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    n = max(1, int(linked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(linked.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    parts = ranged.groupBy("conv_id", "_range").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # at most one conversation goes on from a range to the next, so this has at most one row a range
    before = parts.withColumn("_before", F.sum("_n").over(w)).where("_before IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), "_before")
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", "conv_id").orderBy(*order[1:])))
    placed = own.join(F.broadcast(before), (F.col("_range") == F.col("_at")) & F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return placed.select(*linked.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).cast("long").alias("place"))
