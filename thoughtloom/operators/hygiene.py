"""Confidence decay, conflicts, the review queue and its decisions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: E-folding time and limits of decay; contradicting words; the age of what has no time.
EFOLD_DAYS, STALE_CONFIDENCE, STALE_DAYS, UNKNOWN_AGE = 62.0, 0.3, 90.0, 3650.0
OPPOSITES = (("always", "sometimes"), ("never", "sometimes"), ("all", "some"), ("tokens", "characters"), ("bytes", "bits"), ("seconds", "minutes"))


def age_days(then: Column, now: Column) -> Column:
    """Days from ``then`` (timestamp or text, UTC without a zone) to ``now``; 3650 if unreadable."""
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.try_to_timestamp(then.cast("string")))
    return F.when(seconds.isNull(), F.lit(UNKNOWN_AGE)).otherwise(F.greatest(seconds / 86_400_000_000, F.lit(0.0)))


def adjusted_confidence(base: Column, age: Column, sources: Column, efold: float = EFOLD_DAYS) -> Column:
    kept = F.greatest(F.exp(-age / efold), F.least(F.lit(1.0), F.log2(F.lit(1) + F.greatest(sources, F.lit(0))) / 4))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base * (F.lit(0.5) + kept * 0.5))), 3)


def is_stale(adjusted: Column, age: Column) -> Column:
    return (adjusted < STALE_CONFIDENCE) & (age > STALE_DAYS)


def contradicts(a: Column, b: Column, whole_words: bool = True) -> Column:
    """Whether two texts hold opposite words; ``whole_words=False`` also finds "all" in "small"."""
    has = (lambda t, w: F.lower(t).rlike(rf"\b{w}\b")) if whole_words else (lambda t, w: F.contains(F.lower(t), F.lit(w)))
    out = F.lit(False)
    for x, y in OPPOSITES:
        out = out | (has(a, x) & has(b, y)) | (has(a, y) & has(b, x))
    return out


def conflict_pairs(insights: Column) -> Column:
    """Array of (a, b): the contradicting pairs of a concept's insights, the one that stands first as a."""
    later = lambda a, i: F.transform(F.slice(insights, i + 2, F.greatest(F.size(insights), F.lit(1))), lambda b: F.struct(a.alias("a"), b.alias("b")))
    return F.coalesce(F.filter(F.flatten(F.transform(insights, later)), lambda p: contradicts(p["a"], p["b"])), F.array().cast("array<struct<a:string,b:string>>"))


def with_conflicts(concepts: DataFrame) -> DataFrame:
    """``concepts`` with ``conflicts``, the variants that contradict each other, and the status that goes with them."""
    out = concepts.withColumn("conflicts", conflict_pairs(F.col("insights")))
    return out.withColumn("status", F.when(F.col("status") == "deleted", "deleted").when(F.size("conflicts") > 0, "conflicted").otherwise("active"))


def insight_conflicts(concepts: DataFrame, whole_words: bool = True) -> DataFrame:
    """(slug, i, j, a, b): contradicting pairs of a concept's insights, compared within its row."""
    pairs = F.flatten(F.transform("insights", lambda a, i: F.transform(F.slice("insights", i + 2, F.greatest(F.size("insights"), F.lit(1))), lambda b, k: F.struct(i.alias("i"), (i + 1 + k).alias("j"), a.alias("a"), b.alias("b")))))
    hit = F.filter(pairs, lambda p: contradicts(p["a"], p["b"], whole_words))
    return concepts.select("slug", F.inline(hit))


def sequence_ratio(rows: DataFrame, a: str, b: str, column: str = "ratio") -> DataFrame:
    """The difflib ratio of two text columns, which no built-in function gives."""
    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([None if p is None or q is None else SequenceMatcher(None, p, q).ratio() for p, q in zip(x, y)])

    return rows.withColumn(column, ratio(F.lower(a), F.lower(b)))


def counted_characters(text: Column) -> Column:
    """A text's characters in lower case, each with its how-manyth: a set that holds what the text holds, repeats included."""
    signs = F.filter(F.split(F.lower(text), ""), lambda c: c != "")
    def numbered(sorted_: Column) -> Column:
        return F.transform(sorted_, lambda c, i: F.concat(c, (i - F.array_position(sorted_, c) + 2).cast("string")))

    return F.get(F.transform(F.array(F.array_sort(signs)), numbered), F.lit(0))


#: Letters that are left out of a name at most; names that could leave out more meet by rare characters.
LEFT_OUT = 4


def _shortened(threshold: float):
    """(letters, key, gone): each multiset of letters that some partner can share with ``letters``, and what is left out for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[str]] = [[], [], []]
            for letters in batch.column("letters").to_pylist():
                n = len(letters)
                for k in range(LEFT_OUT + 1):
                    if (n - k) * 2 < (n + n - k) * threshold - 1e-9:  # the least partner has as many as are shared
                        break
                    for places in {tuple(letters[i] for i in c): c for c in combinations(range(n), k)}.values():  # each choice of letters once
                        out[0].append(letters)
                        out[1].append("".join(x for i, x in enumerate(letters) if i not in places))
                        out[2].append("".join(letters[i] for i in places))
                if len(out[0]) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["letters", "key", "gone"])
                    out = [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["letters", "key", "gone"])

    return run


def _letter_pairs(lefts: DataFrame, rights: DataFrame, threshold: float) -> DataFrame:
    """(p, q): all pairs of letters in order that share threshold / 2 of both lengths, neither being long.

    Such letters become equal where each leaves out what the other has not. A pair meets under several
    keys, and stands under that which is all they share: there nothing that both leave out is the same.
    """
    cut = lambda rows: rows.select("letters").distinct().mapInArrow(_shortened(threshold), "letters string, key string, gone string")
    a, b = cut(lefts).alias("a"), cut(rights).alias("b")
    enough = F.length("a.key") * 2 >= (F.length("a.letters") + F.length("b.letters")) * F.lit(threshold) - 1e-9
    apart = F.expr("length(translate(a.gone, b.gone, '')) = length(a.gone)")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & enough & apart).select(F.col("a.letters").alias("p"), F.col("b.letters").alias("q"))


def ratio_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(e, a, x, y): all pairs of names (e, x) and (a, y) whose characters allow a ratio at the threshold, and no others.

    A ratio is twice the matched characters over both lengths, and what is matched is in both texts, so together
    they hold threshold / 2 of both lengths in common. Names are met by their letters in order, of which each needs to leave
    out few. Where one of the names is so long that it could leave out more than ``LEFT_OUT``, sets of counted characters
    share one of their first, the rare ones first (prefix filter), and are held against each other where they meet.
    """
    letters = lambda rows, key, name: rows.select(key, name, F.array_join(F.array_sort(F.filter(F.split(F.lower(name), ""), lambda c: c != "")), "").alias("letters")).where("letters <> ''")
    lefts, rights = letters(left, "e", "x"), letters(right, "a", "y")
    longest = math.floor((LEFT_OUT + 1) / (1 - threshold / (2 - threshold)) - 1e-6) if threshold < 1 else 2**31 - 1
    least = math.ceil((longest + 1) * threshold / (2 - threshold) - 1e-6)  # letters of the shortest partner of a long name
    short, long_ = F.length("letters") <= longest, F.length("letters") > longest
    met = _letter_pairs(lefts.where(short), rights.where(short), threshold)
    found = met.join(lefts.withColumnRenamed("letters", "p"), "p").join(rights.withColumnRenamed("letters", "q"), "q").select("e", "a", "x", "y")
    near = F.length("letters") >= least
    far = _long_pairs(lefts.where(long_), rights.where(near), threshold).unionByName(_long_pairs(lefts.where(short & near), rights.where(long_), threshold))
    return found.unionByName(far)


def _long_pairs(lefts: DataFrame, rights: DataFrame, threshold: float) -> DataFrame:
    """The pairs of ``ratio_candidates`` by a prefix filter over counted characters."""
    signs = lambda rows, key, name: rows.select(key, name, counted_characters(F.col(name)).alias("signs"))
    lefts, rights = signs(lefts, "e", "x"), signs(rights, "a", "y")
    listed = lambda rows, key: rows.select(key, F.size("signs").alias("n"), F.explode("signs").alias("sign"))
    counts = listed(lefts, "e").select("sign").unionByName(listed(rights, "a").select("sign")).groupBy("sign").agg(F.count("*").alias("df"))
    least = threshold / (2 - threshold)  # of a text's characters, shared with the shortest text it can match

    def heads(rows: DataFrame, key: str) -> DataFrame:
        ranked = listed(rows, key).join(counts, "sign")
        ordered = ranked.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("df", "sign"))).alias("o"))
        first = F.slice("o", 1, (F.col("n") - F.ceil(F.col("n") * F.lit(least) - 1e-9) + 1).cast("int"))
        return ordered.select(key, F.explode(first).alias("h")).select(key, "h.sign").join(rows, key)

    p, q = heads(lefts, "e").withColumnRenamed("signs", "p"), heads(rights, "a").withColumnRenamed("signs", "q")
    shared = F.size(F.array_intersect("p", "q"))
    enough = shared * 2 >= (F.size("p") + F.size("q")) * F.lit(threshold) - 1e-9
    return p.join(q, "sign").where(enough).select("e", "a", "x", "y").distinct()


def definition_conflicts(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs (a, b) of non-empty definitions that diverge."""
    return sequence_ratio(pairs.where("a <> '' and b <> ''"), "a", "b").where(F.col("ratio") < threshold)


def review_queue(concepts: DataFrame, now: Column) -> DataFrame:
    """(slug, name, reason, adjusted): conflicted, else orphaned, else stale."""
    has = lambda c: F.coalesce(F.size(c), F.lit(0)) if c in concepts.columns else F.lit(0)
    sources = F.when(has("sources") > 0, has("sources")).otherwise(has("source_files"))
    age = age_days(F.col("last_reinforced_at"), now)
    adjusted = adjusted_confidence(F.col("confidence"), age, sources)
    reason = F.when((F.col("status") == "conflicted") | (has("conflicts") > 0), "conflicted").when(sources == 0, "orphaned").when(is_stale(adjusted, age), "stale")
    rows = concepts.select("slug", "name", reason.alias("reason"), F.when(reason == "stale", adjusted).alias("adjusted"))
    return rows.where("reason is not null")


def apply_decisions(concepts: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Concepts after a review: "delete" marks them, every other decision notes the review only."""
    rows = concepts.join(decisions.select("slug", "action"), "slug", "left")
    gone = F.col("action") == "delete"
    out = rows.withColumn("status", F.when(gone, "deleted").otherwise(F.col("status")))
    if "deleted_at" in concepts.columns:
        out = out.withColumn("deleted_at", F.when(gone, now).otherwise(F.col("deleted_at")))
    if "last_reviewed_at" in concepts.columns:
        out = out.withColumn("last_reviewed_at", F.when(F.col("action").isNotNull(), now).otherwise(F.col("last_reviewed_at")))
    return out.drop("action")
