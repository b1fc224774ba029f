"""Chat formatting with quotation linking, in DataFrame functions only.

Messages quote earlier ones in lines that begin with ">", nested by repetition. Quoted passages are normalised, hashed,
and joined to the bodies, paragraphs and lines of earlier messages of the conversation; what a message quotes at its
lowest level of known source is what it replies to. Conversations come out without quotes, replies after the thread that they reply to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

QUOTE = r"^(?:[ \t]*>)+"
#: Turns that are numbered together; a conversation of any length is never in one task.
SPAN = 128


def normalised(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def level(line: Column) -> Column:
    """Depth of quotation of a line."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), r"[^>]", ""))


def body(text: Column) -> Column:
    """The text without its quoted lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ~x.rlike(QUOTE))
    return F.trim(F.array_join(lines, "\n"))


def links(df: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to): for each turn with quotations, the earlier turn that holds most of what it quotes.

    Consecutive lines of one level are joined, whatever their line breaks, and matched by hash with the bodies and
    paragraphs of earlier turns, else by paragraph, else by line. Quotations of the lowest level that an earlier turn
    holds count, in characters; for each unit the latest holder counts, among turns of equal count the latest.
    """
    known = df.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull() & F.col("text").isNotNull())
    quoting = known.where(F.col("text").rlike("(?m)" + QUOTE)).select("conv_id", "turn", "text").distinct()
    lines = quoting.select("conv_id", "turn", F.xxhash64("text").alias("part"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).where("level > 0").withColumn("key", normalised(F.regexp_replace("line", QUOTE, "")))
    # Consecutive lines of one level are a block; its blank lines part it into paragraphs.
    same = ["conv_id", "turn", "part", "level"]
    lines = lines.withColumn("block", F.col("pos") - F.row_number().over(Window.partitionBy(*same).orderBy("pos")))
    lines = lines.withColumn("para", F.count_if(F.col("key") == "").over(Window.partitionBy(*same, "block").orderBy("pos"))).where("key <> ''")

    def joined(*by):
        w = Window.partitionBy(*same, *by).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.xxhash64(F.array_join(F.collect_list("key").over(w), " "))

    lines = lines.select("conv_id", "turn", "level", "key", F.array(joined("block"), joined("block", "para"), F.xxhash64("key")).alias("hashes"))
    asked = lines.select("conv_id", "turn", F.explode("hashes").alias("hash")).distinct().withColumn("held", F.lit(False))
    talks = asked.select("conv_id").distinct()
    own = known.join(talks, "conv_id", "left_semi").withColumn("own", body(F.col("text")))
    units = F.array_union(F.array_union(F.split("own", "\n", -1), F.split("own", r"\n[ \t\r]*\n", -1)), F.array("own"))
    held = own.select("conv_id", "turn", F.explode(units).alias("unit")).withColumn("unit", normalised(F.col("unit"))).where("unit <> ''")
    held = held.select("conv_id", "turn", F.xxhash64("unit").alias("hash")).distinct()
    held = held.join(asked.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").withColumn("held", F.lit(True))
    # As of its turn, the latest holder of each quoted unit: one ordered pass over a unit's turns, no pairs.
    before = Window.partitionBy("conv_id", "hash").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    both = asked.unionByName(held.select("conv_id", "turn", "hash", "held"))
    met = both.withColumn("holder", F.max(F.when(F.col("held"), F.col("turn"))).over(before)).where("not held and holder is not null")
    each = lines.select("conv_id", "turn", "level", "key", "hashes", F.posexplode("hashes").alias("unit", "hash"))
    each = each.join(met.select("conv_id", "turn", "hash", "holder"), ["conv_id", "turn", "hash"])
    found = each.groupBy("conv_id", "turn", "level", "key", "hashes").agg(F.min_by("holder", "unit").alias("holder"))
    lowest = found.groupBy("conv_id", "turn").agg(F.min("level").alias("level"))
    found = found.join(lowest, ["conv_id", "turn", "level"]).select("conv_id", "turn", "key", "holder").distinct()
    votes = found.groupBy("conv_id", "turn", "holder").agg(F.sum(F.length("key")).alias("chars"))
    best = votes.groupBy("conv_id", "turn").agg(F.max(F.struct("chars", "holder")).alias("best"))
    return best.select("conv_id", "turn", F.col("best.holder").alias("reply_to"))


def roots(reply: DataFrame) -> DataFrame:
    """(conv_id, turn, reply_to, root): the first turn of each reply's thread, by pointer jumping."""
    at = cut(reply.withColumn("root", F.col("reply_to")))
    while True:
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("higher"))
        step = cut(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", "reply_to", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")))
        at = step.drop("moved")
        if step.where("moved").isEmpty():
            return at


def conversations(df: DataFrame) -> DataFrame:
    """Per row of ``df`` (conv_id, turn, role, text): conv_id, turn, position, role, reply_to, root_turn, text, message.

    ``position`` numbers a conversation's rows from 1 in reply order: by the first turn of the thread, then by turn,
    role and text, nulls first. reply_to is null for rows that quote no earlier turn; root_turn is then their own turn.
    ``text`` has no quoted lines (null stays null) and ``message`` is its chat form. Rows with a null conv_id make up
    one conversation of unknown id; repeated rows stay. Empty tables give empty results.
    """
    threads = roots(links(df))
    rows = df.select("conv_id", "turn", "role", "text").join(threads, ["conv_id", "turn"], "left")
    rows = rows.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("root", "turn").alias("root_turn"),
        F.when(F.col("text").isNull(), F.lit(None).cast("string")).otherwise(body(F.col("text"))).alias("text"),
    )
    rows = rows.withColumn("span", F.coalesce(F.floor(F.col("root_turn") / SPAN), F.lit(-(1 << 60))))
    counts = rows.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("conv_id", "span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    order = Window.partitionBy("conv_id", "span").orderBy("root_turn", "turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(order))
    rows = rows.alias("r").join(counts.alias("c"), F.col("r.conv_id").eqNullSafe(F.col("c.conv_id")) & (F.col("r.span") == F.col("c.span")))
    return rows.select(
        "r.conv_id", "turn", (F.col("ahead") + F.col("place")).cast("long").alias("position"), "role", "reply_to", "root_turn", "text",
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("\n<|end|>\n")).alias("message"),
    )
