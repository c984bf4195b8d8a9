"""Raw concepts that say the same become one: equal slugs first, then similar names or contents.

A raw concept has ``ord`` (its place in the order of extraction, unique), name, raw_content,
source_chunks, source_files, extraction_method and confidence. Nothing is compared all against all:
similar pairs share a word among the rarest of their words (prefix filter), and which of them are
kept is settled in rounds over those pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, slugify, stripped, word_set
from .graph import stored

#: Above these shares of common words names and contents are similar; lengths in characters.
NAME_SIMILARITY, CONTENT_SIMILARITY, COMPARED_CHARS, CONTENT_CHARS = 0.6, 0.75, 500, 5000
_BREAK = "\n\n"


def _unions(rows: DataFrame, column: str) -> DataFrame:
    """(group, column): the distinct items of all members, in the order in which they come."""
    items = rows.select("group", "turn", F.posexplode(column).alias("i", "x")).groupBy("group", "x").agg(F.min(F.struct("turn", "i")).alias("at"))
    return items.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(column))


def merge_raw(members: DataFrame) -> DataFrame:
    """One raw concept per ``group``: that of the member of turn 0, with what the others add.

    ``members`` are raw concepts with ``group`` and ``turn``, the order within the group. A paragraph
    is added by the first member that has it, unless the first member's text has it; contents end at
    CONTENT_CHARS characters, so of each group only as many paragraphs are gathered as fit. Files and
    chunks are ordered unions, the confidence is the highest.
    """
    parts = members.select("group", "turn", F.posexplode(F.split("raw_content", _BREAK)).alias("i", "p")).select("group", "turn", "i", stripped(F.col("p")).alias("p")).where("p <> ''")
    owner = parts.groupBy("group", F.lower("p").alias("low")).agg(F.min("turn").alias("owner"))
    new = parts.join(owner.withColumnRenamed("group", "g"), (F.col("group") == F.col("g")) & (F.lower("p") == F.col("low"))).where("turn = owner and turn > 0").select("group", "turn", "i", "p")
    rank = F.row_number().over(Window.partitionBy("group").orderBy("turn", "i"))
    fits = new.withColumn("rank", rank).where(F.col("rank") <= CONTENT_CHARS // (1 + len(_BREAK)) + 1)
    added = fits.groupBy("group").agg(F.concat_ws(_BREAK, F.transform(F.array_sort(F.collect_list(F.struct("rank", "p"))), lambda s: s["p"])).alias("added"))
    best = members.groupBy("group").agg(F.max("confidence").alias("confidence"), F.count("*").alias("members"))
    first = members.where("turn = 0").select("group", "ord", "name", "raw_content", "extraction_method")
    out = first.join(best, "group").join(added, "group", "left").join(_unions(members, "source_chunks"), "group", "left").join(_unions(members, "source_files"), "group", "left")
    text = F.substring(F.concat_ws(_BREAK, "raw_content", "added"), 1, CONTENT_CHARS)
    alone = F.when(F.col("members") > 1, text).otherwise(F.col("raw_content"))
    none = F.array().cast("array<string>")
    return out.select("group", "ord", "name", alone.alias("raw_content"), F.coalesce("source_chunks", none).alias("source_chunks"), F.coalesce("source_files", none).alias("source_files"), "extraction_method", "confidence", "members")


def merge_by_slug(raw: DataFrame) -> DataFrame:
    """Raw concepts of one slug as one: the surest, then longest, then first is primary, the others follow in order.

    ``ord`` becomes the place of the slug's first member.
    """
    rows = raw.withColumn("group", slugify(F.col("name")))
    own = Window.partitionBy("group").orderBy(F.desc("confidence"), F.desc(F.length("raw_content")), "ord")
    rows = rows.withColumn("primary", F.row_number().over(own) == 1)
    turn = F.row_number().over(Window.partitionBy("group").orderBy(F.desc("primary"), "ord")) - 1
    merged = merge_raw(rows.withColumn("turn", turn).drop("primary"))
    return merged.drop("ord").join(rows.groupBy("group").agg(F.min("ord").alias("ord")), "group").withColumnRenamed("group", "slug")


def _pairs(rows: DataFrame, text: Column, least: float) -> DataFrame:
    """(a, b), a < b: rows whose words overlap by more than ``least``."""
    w = rows.select("ord", word_set(text).alias("words")).where(F.size("words") > 0)
    each = w.select("ord", F.explode("words").alias("word"), F.size("words").alias("n"))
    order = F.array_sort(F.collect_list(F.struct("df", "word")))
    ranked = each.join(each.groupBy("word").agg(F.count("*").alias("df")), "word").groupBy("ord", "n").agg(order.alias("o"))
    heads = ranked.select("ord", F.explode(F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least)) + 1).cast("int"))).alias("h")).select("ord", "h.word")
    near = heads.select(F.col("ord").alias("a"), "word").join(heads.select(F.col("ord").alias("b"), "word"), "word").where("a < b").select("a", "b").distinct()
    left, right = (w.select(F.col("ord").alias(x), F.col("words").alias(f"words_{x}")) for x in "ab")
    return near.join(left, "a").join(right, "b").where(jaccard(F.col("words_a"), F.col("words_b")) > least).select("a", "b")


def similar_pairs(concepts: DataFrame, name: float = NAME_SIMILARITY, content: float = CONTENT_SIMILARITY) -> DataFrame:
    """(a, b), a < b: the places of concepts whose names or first COMPARED_CHARS characters are similar."""
    by_name = _pairs(concepts, F.col("name"), name)
    return by_name.unionByName(_pairs(concepts, F.substring("raw_content", 1, COMPARED_CHARS), content)).distinct()


def absorbed(pairs: DataFrame) -> DataFrame:
    """(b, a): which earlier concept takes in each one that is not kept.

    Going through the concepts in order, one that no kept one has taken in is kept, and takes in all
    later ones similar to it. In each round the concepts without an undecided earlier partner are
    kept, and their partners are taken in; rounds follow the longest chain of undecided pairs.
    """
    pairs = stored(pairs.select("a", "b"))
    open_, taken = pairs, pairs.select("b").limit(0)
    while open_.head(1):
        kept = open_.join(open_.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = stored(kept.select("b").distinct())
        taken = taken.unionByName(gone)
        open_ = stored(open_.join(gone, "b", "left_anti").join(gone.withColumnRenamed("b", "a"), "a", "left_anti"))
    keepers = pairs.join(taken.withColumnRenamed("b", "a"), "a", "left_anti")
    return keepers.groupBy("b").agg(F.min("a").alias("a"))


def deduplicate(raw: DataFrame, name: float = NAME_SIMILARITY, content: float = CONTENT_SIMILARITY) -> DataFrame:
    """Raw concepts without repeats: merged by slug, then those that are similar.

    Similarity is that of the concepts as merged by slug. (Compared with a text that grows while it
    takes in others, only concepts shorter than COMPARED_CHARS could come out differently.)
    """
    merged = stored(merge_by_slug(raw))
    into = stored(absorbed(similar_pairs(merged, name, content)).withColumnRenamed("a", "into").withColumnRenamed("b", "ord"))
    rows = merged.drop("members", "slug").join(into, "ord", "left").withColumn("group", F.coalesce("into", "ord")).drop("into")
    turn = F.row_number().over(Window.partitionBy("group").orderBy("ord")) - 1
    return merge_raw(rows.withColumn("turn", turn)).drop("group").withColumn("slug", slugify(F.col("name")))
