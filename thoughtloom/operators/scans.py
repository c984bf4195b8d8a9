"""Files of any length: running sums, turns and batches without a task that holds all rows of a file.

Rows of a file are ordered by (block, at). What depends on the rows before is summed up for each block of
rows, the summaries are combined over the blocks, and each block is then gone through with what came
before it. A task holds a block, or the summaries of one file; those are as many as blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import stripped
from .graph import stored
from .parsing import after_marker, line_role

#: Rows of a block that is made here.
ROWS = 1 << 13
#: Lengths of a batch within which the next one's beginning is sought at first.
REACH = 64


def running_sums(rows: DataFrame, file: str, block: str, at: str, **sums: Column) -> DataFrame:
    """``rows`` with a column for each of ``sums``: its total over the file's rows before this one, by (block, at)."""
    own = Window.partitionBy(file, block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"{name}_inside": F.coalesce(F.sum(value).over(own), F.lit(0)) for name, value in sums.items()})
    totals = rows.groupBy(file, block).agg(*(F.sum(value).alias(f"{name}_total") for name, value in sums.items()))
    before = Window.partitionBy(file).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.col(file).alias("_file"), F.col(block).alias("_block"), *(F.coalesce(F.sum(f"{name}_total").over(before), F.lit(0)).alias(f"{name}_before") for name in sums))
    joined = inside.join(carried, F.col(file).eqNullSafe(F.col("_file")) & F.col(block).eqNullSafe(F.col("_block"))).drop("_file", "_block")
    out = joined.withColumns({name: F.col(f"{name}_before") + F.col(f"{name}_inside") for name in sums})
    return out.drop(*(f"{name}{end}" for name in sums for end in ("_before", "_inside")))


def line_rows(spark: SparkSession, folder: str, extension: str = "md") -> DataFrame:
    """(source_file, block, at, line) of text files, which may be split: a block is what a task reads of a file."""
    read = spark.read.option("pathGlobFilter", f"*.{extension}").option("lineSep", "\n").text(folder)
    place = F.struct(F.col("_metadata.file_block_start").alias("start"), F.shiftright(F.monotonically_increasing_id(), 13).alias("part"))
    rows = read.select(F.col("_metadata.file_path").alias("source_file"), place.alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return stored(rows)  # numbers of rows hold for one reading


def turns_of_lines(lines: DataFrame) -> DataFrame:
    """(source_file, idx, role, content): the turns that ``parse_turns`` finds, from lines (source_file, block, at, line).

    A line begins a turn if it has a marker, or is "---" after a marker. What a block does to the role is one
    of two things: it sets it (by its last marker, and the number of "---" since), or turns it over an even or odd
    number of times. These combine in any grouping, so the role at a block's start comes from summaries.
    """
    rows = lines.select("source_file", "block", "at", "line", line_role(F.col("line")).alias("marked"), (stripped(F.col("line")) == "---").alias("cut"))
    own = Window.partitionBy("source_file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    since = F.last(F.when(F.col("marked").isNotNull(), F.struct("marked", "cuts")), ignorenulls=True).over(own)
    inside = rows.withColumn("cuts", F.sum(F.when(F.col("marked").isNull() & F.col("cut"), 1).otherwise(0)).over(own)).withColumn("since", since)
    # of each block: its last marker if it has one, and the cuts after it, or all cuts
    blocks = inside.groupBy("source_file", "block").agg(F.max_by("since", "at").alias("since"), F.max("cuts").alias("cuts"))
    over = Window.partitionBy("source_file").orderBy("block")
    blocks = blocks.withColumn("sum", F.sum("cuts").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    told = F.when(F.col("since").isNotNull(), F.struct(F.col("since.marked").alias("role"), (F.col("sum") - F.col("cuts") + F.col("since.cuts")).alias("sum")))
    last = F.last(told, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(F.col("source_file").alias("_file"), F.col("block").alias("_block"), last.alias("came"), (F.col("sum") - F.col("cuts")).alias("before"))
    placed = inside.join(carried, F.col("source_file").eqNullSafe(F.col("_file")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_file", "_block")
    spoke = F.coalesce("since.marked", "came.role")
    turned = F.when(F.col("since").isNotNull(), F.col("cuts") - F.col("since.cuts")).otherwise(F.col("before") + F.col("cuts") - F.col("came.sum"))
    other = F.when(spoke == "human", "assistant").when(spoke == "assistant", "human").otherwise(spoke)
    placed = placed.withColumn("role", F.when(turned % 2 == 1, other).otherwise(spoke))
    begins = F.col("marked").isNotNull() | (F.col("cut") & F.col("role").isNotNull())
    placed = placed.withColumn("begins", begins.cast("int"))
    numbered = running_sums(placed, "source_file", "block", "at", earlier=F.col("begins")).where("role is not null")
    rest = after_marker(F.col("line"))
    text = F.when(F.col("marked").isNotNull(), F.when(rest != "", rest)).when(F.col("begins") == 1, F.lit(None)).otherwise(F.col("line"))
    said = numbered.select("source_file", (F.col("earlier") + F.col("begins")).alias("turn"), "role", F.struct("block", "at", text.alias("text")).alias("said"))
    content = stripped(F.array_join(F.transform(F.array_sort(F.collect_list("said")), lambda x: x["text"]), "\n"))
    turns = said.groupBy("source_file", "turn").agg(F.first("role").alias("role"), content.alias("content")).where("content <> ''")
    turns = running_sums(turns.withColumn("part", F.floor(F.col("turn") / ROWS)), "source_file", "part", "turn", idx=F.lit(1))
    files = lines.select("source_file").distinct().join(turns.select("source_file").distinct(), "source_file", "left_anti")
    whole = lines.join(files, "source_file", "left_semi").groupBy("source_file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    alone = whole.select("source_file", F.lit(0).alias("idx"), F.lit("assistant").alias("role"), stripped(F.col("text")).alias("content"))
    return turns.select("source_file", F.col("idx").cast("int").alias("idx"), "role", "content").unionByName(alone)


def batch_numbers(chunks: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(chunk_id, batch) of chunks (source_file, turn_index, chunk_index, chunk_id, n), as one goes through each file.

    A batch that begins at a chunk ends before the first later one with which it passes ``max_chars``. With running
    lengths that is a search for the next greater number, for all chunks at once; the batches of a file are those
    met on the way from its first chunk, which is walked in doubling steps: after r rounds 2^r
    beginnings are known. Lengths are positive.
    """
    rows = chunks.select("source_file", "turn_index", "chunk_index", "chunk_id", F.col("n").cast("bigint").alias("n"), F.floor(F.col("chunk_index") / ROWS).alias("part"))
    # turns may be many or long: first sums within parts of a turn, then over turns
    turn = Window.partitionBy("source_file", "turn_index", "part").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"pos": F.count("*").over(turn) - 1, "end": F.sum("n").over(turn)})
    totals = rows.groupBy("source_file", "turn_index", "part").agg(F.count("*").alias("many"), F.sum("n").alias("chars"))
    totals = totals.withColumn("place", F.struct("turn_index", "part")).withColumn("turns", F.floor(F.col("turn_index") / ROWS))
    totals = running_sums(totals, "source_file", "turns", "place", many_before=F.col("many"), chars_before=F.col("chars")).select("source_file", "turn_index", "part", "many_before", "chars_before")
    rows = rows.join(totals, ["source_file", "turn_index", "part"])
    rows = stored(rows.select("source_file", "chunk_id", (F.col("pos") + F.col("many_before")).alias("pos"), (F.col("end") + F.col("chars_before")).alias("end"), "n"))

    # the first chunk whose running length is greater than a batch's start and limit: within a stretch of lengths, else in the next one that has any
    stretch = F.floor(F.col("value") / (REACH * max_chars))
    given = rows.select("source_file", F.col("end").alias("value"), F.col("pos").alias("found"), F.lit(None).cast("bigint").alias("asks"))
    asks = rows.select("source_file", (F.col("end") - F.col("n") + max_chars).alias("value"), F.lit(None).cast("bigint").alias("found"), F.col("pos").alias("asks"))
    both = given.unionByName(asks).withColumn("stretch", stretch)
    down = Window.partitionBy("source_file", "stretch").orderBy(F.desc("value"), F.col("asks").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("near", F.last("found", ignorenulls=True).over(down)).where("asks is not null")
    firsts = both.groupBy("source_file", "stretch").agg(F.min("found").alias("first"))
    later = F.last("first", ignorenulls=True).over(Window.partitionBy("source_file").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1))
    firsts = firsts.select("source_file", "stretch", later.alias("later"))
    found = F.coalesce("near", "later")
    after = near.join(firsts, ["source_file", "stretch"]).select("source_file", F.col("asks").alias("pos"), F.greatest(found, F.when(found.isNotNull(), F.col("asks") + 1)).alias("to"))
    ends = stored(rows.groupBy("source_file").agg((F.max("pos") + 1).alias("all")))
    step = stored(after.join(ends, "source_file").where("to < all").drop("all"))  # a last chunk over the limit asks for one that is not there

    # the beginnings that are met, with their numbers
    met, size, once = stored(rows.where("pos = 0").select("source_file", "pos", F.lit(0).alias("batch"))), 1, step
    while True:
        ahead = met.join(step, ["source_file", "pos"]).select("source_file", F.col("to").alias("pos"), (F.col("batch") + size).alias("batch"))
        new = stored(ahead)
        if not new.head(1):
            break
        met = stored(met.unionByName(new))
        far = step.select("source_file", F.col("pos").alias("to"), F.col("to").alias("further"))
        step = stored(step.join(far, ["source_file", "to"]).select("source_file", "pos", F.col("further").alias("to")))
        size *= 2
    spans = met.join(once, ["source_file", "pos"], "left").join(ends, "source_file")
    covered = spans.select("source_file", "batch", F.explode(F.sequence("pos", F.coalesce("to", "all") - 1)).alias("pos"))
    return rows.join(covered, ["source_file", "pos"]).select("chunk_id", "batch")
