"""Chat formatting after a collapse of cumulative snapshots (DataFrame functions only).

Logs often hold a conversation several times, each snapshot a prefix of the next. A rolling hash over the turns
gives every prefix of every conversation a name: two 64-bit lanes, each the XOR of hashes of (position, role,
text) over the prefix's turns, beside the prefix's length. A conversation is dropped if its whole is a proper
prefix of another one (an anti-join against the distinct names of all proper prefixes), and of conversations
equal in all turns the smallest id stays. Those that stay are rendered.

Turns are handled in blocks of BLOCK turn numbers, so a conversation with a large share of all rows is spread
over many tasks. Rows are gathered into blocks with repeats dropped before they are moved, which is the one shuffle of
texts; a block is written with two hashes of each turn, and all that follows but the rendering reads the hashes alone.
Positions and running hashes are made inside a block, one row for each block carries them over blocks, every join is on
conversation and block, and the rendered text comes in one part for each block.

Defined cases: rows equal in conversation, turn, role and text are one turn; different rows with one turn number (ties)
follow each other by role and text; null roles and texts are rendered as empty but differ from empty ones in
comparison; a null conversation id is a conversation of its own, named last; a very long text is one turn of its
block, rendered whole; an empty table gives no rows; numbering of turns may start anywhere and have gaps, as only their
order counts, and null turns come first; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import BROADCAST_IDS, shared_folder, written

#: Turn numbers in a block.
BLOCK = 512


def _blocks(conversations: DataFrame, block: int) -> DataFrame:
    """key, conv_id, block, n, turns (structs of role and text, in order), r1 and r2 (hashes of each turn's role and text).

    The key is the id as text, which tells a null id from all others."""
    conv = F.col("conv_id").cast("long")
    rows = conversations.select(F.coalesce(conv.cast("string"), F.lit("none")).alias("key"), conv.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    said = [F.coalesce(F.concat(F.lit("r"), F.col("role")), F.lit("-")), F.coalesce(F.concat(F.lit("t"), F.col("text")), F.lit("-"))]
    rows = rows.withColumns({"block": F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))), **{f"r{i}": F.xxhash64(F.lit(i), *said) for i in (1, 2)}})
    found = rows.groupBy("key", "conv_id", "block").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text", "r1", "r2"))).alias("t"))
    return found.select("key", "conv_id", "block", F.size("t").cast("long").alias("n"), F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"), F.col("t.r1").alias("r1"), F.col("t.r2").alias("r2"))


def prefixes(blocks: DataFrame) -> DataFrame:
    """key, conv_id, pos, total, p1, p2: the name of the prefix that ends with each turn, and the conversation's length."""
    whole = Window.partitionBy("key")
    before = whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("key", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))
    rows = blocks.select("key", "conv_id", "block", "r1", "r2").join(sizes, ["key", "block"])
    rows = rows.select("key", "conv_id", "block", "offset", "total", F.posexplode(F.arrays_zip("r1", "r2")))
    pos = F.col("offset") + F.col("pos") + 1
    rows = rows.select("key", "conv_id", "block", "total", pos.alias("pos"), *(F.xxhash64(F.lit(i), pos, "col.r1", "col.r2").alias(f"h{i}") for i in (1, 2)))
    sums = rows.groupBy("key", "block").agg(F.expr("bit_xor(h1)").alias("b1"), F.expr("bit_xor(h2)").alias("b2"))
    sums = sums.select("key", "block", *(F.coalesce(F.expr(f"bit_xor(b{i})").over(before), F.lit(0).cast("long")).alias(f"o{i}") for i in (1, 2)))
    inside = Window.partitionBy("key", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("key", "conv_id", "block", "pos", "total", *(F.expr(f"bit_xor(h{i})").over(inside).alias(f"i{i}") for i in (1, 2)))
    return run.join(sums, ["key", "block"]).select("key", "conv_id", "pos", "total", F.expr("i1 ^ o1").alias("p1"), F.expr("i2 ^ o2").alias("p2"))


def maximal(blocks: DataFrame, folder: str) -> DataFrame:
    """conv_id, n_turns, copies of the conversations that stay."""
    named = written(prefixes(blocks), folder, "prefixes")
    # a name that many conversations begin with, or are, is folded to one row before the join
    wholes = named.where("pos = total").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    inner = named.where("pos < total").select("pos", "p1", "p2").distinct()
    return wholes.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def chatml(role: Column, text: Column) -> Column:
    """One turn in the ChatML layout."""
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, block: int = BLOCK, template=chatml) -> DataFrame:
    """conv_id, n_turns, copies, part, first_pos, rendered: the maximal conversations, one row for each block of turns."""
    folder = shared_folder(conversations.sparkSession)
    blocks = written(_blocks(conversations, block), folder, "blocks")
    stay = maximal(blocks, folder).select(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("key"), "n_turns", "copies")
    order = Window.partitionBy("key").orderBy("block")
    parts = blocks.select("key", "block", "n").withColumns({"part": F.row_number().over(order).cast("long") - 1, "first_pos": F.sum("n").over(order) - F.col("n") + 1}).drop("n")
    parts = written(parts.join(stay, "key"), folder, "parts")
    few = parts.count() <= BROADCAST_IDS
    lines = blocks.select("key", "conv_id", "block", "turns").join(F.broadcast(parts) if few else parts, ["key", "block"])
    rendered = F.array_join(F.transform("turns", lambda t: template(t["role"], t["text"])), "")
    return lines.select("conv_id", "n_turns", "copies", "part", "first_pos", rendered.alias("rendered"))


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """All of `conversations`, collapsed and rendered."""
    from tessera.sources.tables import table

    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE_SQL = f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n, list({{'r': role, 't': text}} ORDER BY turn, role, text) AS l FROM turns GROUP BY conv_id
), wholes AS (
  SELECT l, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS copies FROM convs GROUP BY l
), stay AS (
  SELECT w.* FROM wholes w
  WHERE NOT EXISTS (SELECT 1 FROM convs c WHERE c.n > w.n AND c.l[1] = w.l[1] AND c.l[1:w.n] = w.l)
), placed AS (
  SELECT t.*, s.n, s.copies, t.turn // {BLOCK} AS block,
         row_number() OVER (PARTITION BY t.conv_id ORDER BY t.turn, t.role, t.text) AS pos
  FROM turns t JOIN stay s USING (conv_id)
)
SELECT conv_id, n AS n_turns, copies, dense_rank() OVER (PARTITION BY conv_id ORDER BY block) - 1 AS part,
       min(pos) AS first_pos,
       string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM placed GROUP BY conv_id, n, copies, block
"""
