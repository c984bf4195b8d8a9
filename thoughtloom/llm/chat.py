"""Chat formatting: snapshots of a conversation collapse into the longest one, which is rendered.

Loggers store a conversation again after every turn, so that many logged conversations are prefixes
of longer ones. A conversation's turns, in order, are hashed by position, role and text; the sums of
these hashes along the conversation identify every prefix of it. A conversation whose last sum is
also an inner sum of another, at the same length, is a prefix and goes by an anti-join. Of equal
conversations the one with the smallest id stays. Only DataFrame functions are used.

Turns are gathered in blocks of ``block`` turn numbers, never in whole conversations: positions and
sums are carried from block to block by a window over one small row per block. So a conversation of
any length is spread over many tasks, and is rendered as one row (part) per block. A number that many
turns share (or lack) is cut into cells by the content's hash, so that a block has a bounded share of
them. Sums have 4 lanes of 32 bits each, which identifies prefixes up to 128-bit collisions. A first
turn that a third of all conversations share is one row after partial aggregation.

Turns are ordered by number, then by a hash of role and text; rows without a number come last, and
rows repeated in all four columns count once. Equal numbers with other content are further turns. A null
role is rendered as "unknown", a null text as nothing, but neither equals an empty string for the
comparison. Rows of null id form one conversation of their own. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, table

BLOCK = 256
#: Cells into which the distinct turns of one number are dealt where they are more than a block.
CELLS = 1 << 20
_LANES = ("l0", "l1", "l2", "l3")
_LOW = 0xFFFFFFFF


def _lanes(rank: Column, role: Column, text: Column) -> list[Column]:
    parts = [role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))]
    one, two = F.xxhash64(rank, *parts), F.xxhash64(F.lit("second"), *reversed(parts), rank)
    return [one.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(one, 32), two.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(two, 32)]


def _order(role: Column, text: Column) -> Column:
    """The place among turns of one number: a hash of the content, nulls apart from empty texts."""
    return F.xxhash64(role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit("")))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _crowds(turns: DataFrame, block: int) -> DataFrame | None:
    """(c, b, cells): blocks of far more turns than numbers, as turns without a number may form; None if there is none."""
    sizes = turns.groupBy("conv_id", _number(block).alias("number")).agg(F.count("*").alias("n")).where(F.col("n") > 4 * block)
    crowd = checkpointed(sizes.select(F.col("conv_id").alias("c"), F.col("number").alias("b"), F.least(F.lit(CELLS), F.ceil(F.col("n") / block)).alias("cells")))
    return crowd if crowd.head(1) else None


def _number(block: int) -> Column:
    return F.coalesce(F.floor(F.col("turn") / block), F.lit(2**62))


def _blocks(turns: DataFrame, block: int, crowd: DataFrame | None) -> DataFrame:
    """(conv_id, block, turns): the distinct turns of each block in order.

    ``block`` is (first number, (turn, cell)), the latter zero where there is no crowd.
    """
    rows = turns.select("conv_id", _number(block).alias("number"), "turn", "role", "text").withColumn("o", _order(F.col("role"), F.col("text")))
    at = F.struct(F.lit(0).cast("long").alias("turn"), F.lit(0).cast("long").alias("cell"))
    if crowd is not None:
        rows = rows.join(crowd, _same("conv_id", "c") & (F.col("number") == F.col("b")), "left")
        # The hash's upper bits, from 0 up in the order of the hash.
        upper = F.shiftright(F.col("o"), 32) + F.lit(2**31)
        cell = F.floor(upper * F.col("cells") / F.lit(2.0**32)).cast("long")
        at = F.when(F.col("cells").isNull(), at).otherwise(F.struct(F.coalesce(F.col("turn"), F.lit(2**62)).alias("turn"), cell.alias("cell")))
    turn = F.struct(F.col("turn").isNull().alias("late"), F.col("turn").alias("turn"), F.col("o").alias("o"), F.col("role").alias("role"), F.col("text").alias("text"))
    return rows.select("conv_id", F.struct("number", at.alias("at")).alias("block"), turn.alias("t")).groupBy("conv_id", "block").agg(F.array_sort(F.collect_set("t")).alias("turns"))


def collapse_snapshots(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maximal conversations: conv_id, n_turns, n_copies; places: conv_id, block, start)."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv_id")
    sizes = blocks.select("conv_id", "block", F.size("turns").cast("long").alias("n"))
    places = checkpointed(sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"), F.sum("n").over(whole).alias("n_turns")))
    at = places.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "start", "n_turns")
    rows = blocks.join(at, _same("conv_id", "c") & (F.col("block") == F.col("b"))).select("conv_id", "block", "n_turns", "start", F.posexplode("turns"))
    rank = F.col("start") + F.col("pos") + 1
    rows = rows.select("conv_id", "block", "n_turns", rank.alias("rank"), *(c.alias(x) for c, x in zip(_lanes(rank, F.col("col.role"), F.col("col.text")), _LANES)))
    within = Window.partitionBy("conv_id", "block").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    local = checkpointed(rows.select("conv_id", "block", "n_turns", "rank", *(F.sum(x).over(within).alias(x) for x in _LANES)))
    totals = local.groupBy("conv_id", "block").agg(*(F.max(x).alias(x) for x in _LANES))  # sums grow within a block
    carried = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias("before_" + x) for x in _LANES))
    sums = local.join(carried, _same("conv_id", "c") & (F.col("block") == F.col("b"))).select("conv_id", "n_turns", "rank", *((F.col(x) + F.col("before_" + x)).alias(x) for x in _LANES))
    whole_ones = sums.where("rank = n_turns").groupBy("n_turns", *_LANES).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = sums.where("rank < n_turns").select(F.col("rank").alias("n_turns"), *_LANES).distinct()
    return whole_ones.join(prefixes, ["n_turns", *_LANES], "left_anti").select("conv_id", "n_turns", "n_copies"), places


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, part, n_turns, n_copies, text): each maximal conversation, a row per block of it.

    ``part`` is the position of the block's first turn, from 0.
    """
    blocks = _blocks(turns, block, _crowds(turns, block))
    maximal, places = collapse_snapshots(blocks)
    kept = places.join(maximal.select(F.col("conv_id").alias("c"), "n_copies"), _same("conv_id", "c"))
    kept = kept.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "start", "n_turns", "n_copies")
    chosen = blocks.join(kept, _same("conv_id", "c") & (F.col("block") == F.col("b")))
    said = F.transform("turns", lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(t["text"], F.lit("")), F.lit("\n<|end|>\n")))
    return chosen.select("conv_id", F.col("start").alias("part"), "n_turns", "n_copies", F.array_join(said, "").alias("text"))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


#: In the tables no number is there twice in a conversation, so the order of such turns is left open.
OP1_SQL = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, role, text FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n_turns,
         list({'r': role, 'x': text} ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM t GROUP BY conv_id
), w AS (
  SELECT turns, min(conv_id) AS conv_id, min(n_turns) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns
), p AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)
), m AS (
  SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.turns = w.turns)
), b AS (
  SELECT conv_id, coalesce(floor(turn / 256), 1e18) AS block, role, text, turn FROM t
), r AS (
  SELECT conv_id, block, count(*) AS n,
         string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), ''
                    ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS text
  FROM b GROUP BY conv_id, block
), s AS (
  SELECT conv_id, text, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part FROM r
)
SELECT s.conv_id, s.part, m.n_turns, m.n_copies, s.text FROM s JOIN m ON s.conv_id IS NOT DISTINCT FROM m.conv_id
"""
