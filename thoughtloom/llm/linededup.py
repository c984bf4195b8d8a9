"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

A text is its lines, each with a hash. A hash over the last two line hashes rolls along the text;
where it is 0 modulo ``divisor`` a chunk ends, so boundaries depend on the lines around them alone
and an insertion elsewhere does not shift them. A line of ``min_chars`` or more is a chunk of its
own. Chunks by themselves lose the ends of a copied passage, which share a chunk with foreign lines,
and short passages that hold no whole chunk; so the windows of two lines that the rolling hash sees
are compared, too: they carry a match on from a chunk, line by line, to where the copy ends.

Of equal chunks or windows the first stays, by id, then position (null ids last); the lines of all
later ones are marked. A run of marked lines goes if it has ``min_chars`` characters, line breaks
included; shorter runs (a frequent phrase twice in a row) stay. The first copy of a line's text is
in no later copy of anything, so no wording is lost. Equality is decided on the text itself:

1. Hashes of chunks and windows are counted, partially before the shuffle; those that occur again
   are marked in a sieve of bounded size, which is broadcast.
2. Places that pass the sieve are gathered without text, as arrays of line hashes. A chunk in a third
   of all texts is one row on one side of the join with the first places, and a skewed partition that
   Spark splits on the other.
3. Of the lines in them the distinct texts are compared for each line hash; a hash that stands for
   more than one text (a collision) makes no copies.
4. Runs are gathered by text and taken out of it. Texts of which nothing goes are not moved.

A null text stays null and an empty one empty. Rows repeated with the same id and text count as one
text. Texts without a removed line are unchanged to the byte; else the kept lines are joined by line
feeds, and ``counted`` tells how many lines went. Other columns are kept, whatever their names; one
named like ``counted`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, sieve, sifted, table

#: One chunk end in so many lines; characters that a passage of more than 50 words has at least.
DIVISOR, MIN_CHARS = 2, 100


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for its row.

    A column that a lambda refers to may be replaced by its whole expression when the optimiser
    moves a filter, and would then be computed again for every element; a lambda's own variable
    cannot be.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(line)


def _units(hashes: Column, divisor: int, min_chars: int) -> Column:
    """(start, count) of what is compared: chunks of lines, and all windows of two lines."""
    solo = lambda i: F.get(hashes, i)["n"] >= min_chars

    def begins(i: Column) -> Column:
        before = F.coalesce(F.get(hashes, i - 2)["h"], F.lit(0).cast("long"))
        return (i == 0) | solo(i) | solo(i - 1) | (F.pmod(F.xxhash64(before, F.get(hashes, i - 1)["h"]), F.lit(divisor)) == 0)

    def spans(starts: Column) -> Column:
        count = lambda s, k: F.coalesce(F.get(starts, k + 1), F.size(hashes)) - s
        return F.transform(starts, lambda s, k: F.struct(s.alias("start"), count(s, k).alias("count")))

    chunks = _let(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), begins), spans)
    chunks = F.filter(chunks, lambda x: (x["count"] > 2) | ((x["count"] == 1) & solo(x["start"])))
    windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - 1), lambda i: F.struct((i - 1).alias("start"), F.lit(2).alias("count")))
    return F.concat(chunks, F.when(F.size(hashes) > 1, windows).otherwise(F.array().cast("array<struct<start:int,count:int>>")))


def _compared(texts: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    """A row for each chunk or window: id, key, start, own (hash and length of each line), h, and the lines."""
    rows = texts.select("id", "key", F.split("text", "\n", -1).alias("lines"))
    rows = rows.select("*", F.transform("lines", lambda x: F.struct(_line_hash(x).alias("h"), F.length(x).alias("n"))).alias("hashes"))
    rows = rows.select("*", F.explode(_let(F.col("hashes"), lambda hashes: _units(hashes, divisor, min_chars))).alias("unit"))
    own = F.slice("hashes", F.col("unit.start") + 1, F.col("unit.count"))
    rows = rows.select("id", "key", F.col("unit.start").alias("start"), own.alias("own"), F.slice("lines", F.col("unit.start") + 1, F.col("unit.count")).alias("lines"))
    return rows.withColumn("h", F.xxhash64(F.col("own.h")))


def _repeated_runs(texts: DataFrame, divisor: int, min_chars: int) -> DataFrame:
    """(id, key, runs): the first and last line of each run of lines that goes."""
    compared = _compared(texts, divisor, min_chars)
    marks = checkpointed(sieve(compared.groupBy("h").count().where("count > 1"), "h"))
    again = sifted(compared, "h", marks)
    places = checkpointed(again.select("id", "key", "start", "own", F.col("own.h").alias("line_hashes"), "h"))
    lines = again.where(F.size("own") <= 2).select(F.explode(F.arrays_zip(F.col("own.h").alias("h"), F.col("lines").alias("line"))).alias("x"))
    unsafe = checkpointed(lines.select("x.*").distinct().groupBy("h").count().where("count > 1").select("h"))
    if unsafe.head(1):
        held = places.select("id", "key", "start", "line_hashes", F.explode("line_hashes").alias("line_hash"))
        held = held.join(unsafe, F.col("line_hash") == F.col("h")).select("id", "key", "start", "line_hashes").distinct()
        on = [F.col(f"p.{c}").eqNullSafe(F.col(f"u.{c}")) for c in held.columns]
        places = places.alias("p").join(held.alias("u"), on, "left_anti")
    place = F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "start")
    first = places.groupBy("h", "line_hashes").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    copies = places.join(first, ["h", "line_hashes"]).where(place != F.col("first"))
    gone = copies.select("id", "key", "start", F.posexplode("own").alias("i", "line")).select("id", "key", (F.col("start") + F.col("i")).alias("at"), F.col("line.n").alias("n")).distinct()
    gone = gone.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("id", "key").orderBy("at")))
    runs = gone.groupBy("id", "key", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), (F.sum("n") + F.count("*") - 1).alias("chars"))
    return runs.where(F.col("chars") >= min_chars).groupBy("id", "key").agg(F.collect_list(F.struct("first", "last")).alias("runs"))


def remove_repeated_chunks(docs: DataFrame, text: str = "text", key: str = "doc_id", divisor: int = DIVISOR, min_chars: int = MIN_CHARS, counted: str = "n_removed") -> DataFrame:
    """``docs`` with repeated runs of lines taken out of ``text``, and the number of their lines as ``counted``."""
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("key", F.xxhash64("text"))
    runs = checkpointed(_repeated_runs(texts, divisor, min_chars))
    names = [c for c in docs.columns if c.lower() != counted.lower()]
    mark, other, other_key, gone = fresh([*docs.columns, counted], "mark", "other", "other_key", "gone")
    kept = docs.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(F.col(f"`{text}`")).alias(mark))
    marks = checkpointed(sieve(runs, "key"))
    runs = runs.select(F.col("id").alias(other), F.col("key").alias(other_key), F.col("runs").alias(gone))
    full = sifted(kept, mark, marks).join(runs, F.col(f"`{key}`").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(other_key)), "left")
    without = lambda lines: F.array_join(F.filter(lines, lambda x, i: ~F.exists(gone, lambda r: i.between(r["first"], r["last"]))), "\n")
    new = F.when(F.col(gone).isNull(), F.col(f"`{text}`")).otherwise(without(F.split(F.col(f"`{text}`"), "\n", -1)))
    number = F.aggregate(gone, F.lit(0), lambda n, r: n + (r["last"] - r["first"] + 1))
    full = full.select(*(new.alias(c) if c == text else F.col(f"`{c}`") for c in names), F.coalesce(number, F.lit(0)).alias(counted))
    free = sifted(kept, mark, marks, held=False).select(*(F.col(f"`{c}`") for c in names), F.lit(0).alias(counted))
    return free.unionByName(full)


def op5_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_chunks(docs).select("doc_id", "n_removed", "text")
