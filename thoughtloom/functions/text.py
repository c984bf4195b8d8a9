"""Scalar text functions as Spark column expressions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are never keywords.
STOPWORDS = frozenset(
    """
    the a an is are was were be been being have has had do does did will would could should may might shall can need
    dare ought used to of in for on with at by from as into through during before after above below between out off over
    under again further then once here there when where why how all both each few more most other some such no nor not
    only own same so than too very just because but and or if while about up it its this that these those i you he she
    we they me him her us them my your his our their what which who whom also like get got one two make know think see
    come want use find give tell say said go going well back even new way look take people good much right still really
    thing don doesn didn won wouldn couldn shouldn let using example work something actually basically essentially
    simply yeah yes okay
    """.split()
)

#: Ranges of invisible characters.
HIDDEN = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{E0000}-\x{E007F}]"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def slugify(text: Column) -> Column:
    """Lower case; letters, digits and "-" only; blanks and "_" as single "-"; none at the edges."""
    kept = F.regexp_replace(stripped(F.lower(text)), r"[^\p{L}\p{N}_\s-]", "")
    return F.regexp_replace(F.regexp_replace(kept, r"[\s_-]+", "-"), "^-+|-+$", "")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 12)


def normalize_whitespace(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Non-empty pieces that end at ".", "!" or "?" before white space; the mark stays."""
    return F.filter(F.transform(F.split(stripped(text), r"(?U)(?<=[.!?])\s+"), stripped), lambda s: s != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two distinct word arrays; 0 where one is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def strip_hidden(text: Column) -> Column:
    return F.regexp_replace(text, HIDDEN, "")


def wrap_retrieved(text: Column, tag: str = "retrieved-content") -> Column:
    """The envelope that marks retrieved text for an agent, hidden characters removed."""
    return F.concat(F.lit(f"<{tag}>\n"), strip_hidden(text), F.lit(f"\n</{tag}>"))


def keyword_tokens(text: Column) -> Column:
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z][a-zA-Z0-9_]*)"), 1)
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*sorted(STOPWORDS)))  # a hash set, once planned


def short_keywords(text: Column, top_n: int = 5) -> Column:
    """Keywords of a short text within its row, most frequent first, then first seen."""
    tokens = keyword_tokens(text)
    ranked = F.transform(F.array_distinct(tokens), lambda w: F.struct((-F.size(F.filter(tokens, lambda t: t == w))).alias("n"), F.array_position(tokens, w).alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(ranked), 1, top_n), lambda x: x["w"])


#: Repeated keys that are sent to every task.
REPEATED = 100_000


def _ranked_words(key: str, top_n: int):
    """(key, rank, word, n): the words of each text of its own, most frequent first, then first seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ranks, words, counts = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                said = Counter(t for t in re.findall("[a-zA-Z][a-zA-Z0-9_]*", text) if len(t) > 2 and t not in STOPWORDS)
                for rank, (word, n) in enumerate(said.most_common(top_n), 1):
                    rows.append(k)
                    ranks.append(rank)
                    words.append(word)
                    counts.append(n)
            keys = batch.column(key).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(ranks, pa.int32()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=[key, "rank", "word", "n"])

    return run


def keywords(rows: DataFrame, key: str, text: str, top_n: int = 15) -> DataFrame:
    """(key, rank, word, n) for texts of any length; only the texts of keys that have several are brought together.

    A key's words are counted and ranked where its text is read. If up to ``REPEATED`` keys have more than one text, those take part
    by counts of words that are combined before the shuffle; with more of them all texts do.
    """
    repeated = rows.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key")).limit(REPEATED + 1).collect()
    if len(repeated) > REPEATED:
        return _combined_keywords(rows, key, text, top_n)
    several = rows.sparkSession.createDataFrame(repeated, rows.select(F.col(key).alias("_key")).schema)
    again = F.col(key).eqNullSafe(F.col("_key"))
    once = rows.join(F.broadcast(several), again, "left_anti") if repeated else rows
    kind = rows.schema[key].dataType.simpleString()
    ranked = once.select(key, F.lower(text).alias("text")).where("text is not null").mapInArrow(_ranked_words(key, top_n), f"`{key}` {kind}, rank int, word string, n long")
    if not repeated:
        return ranked
    return ranked.unionByName(_combined_keywords(rows.join(F.broadcast(several), again, "left_semi"), key, text, top_n))


def _combined_keywords(rows: DataFrame, key: str, text: str, top_n: int) -> DataFrame:
    words = rows.select(key, F.posexplode(keyword_tokens(F.col(text))).alias("at", "word"))
    counted = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "at"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top_n).select(key, "rank", "word", "n")
