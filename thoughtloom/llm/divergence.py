"""How far the sources of a language are from each other, and by which words each stands out.

Words are counted once, map-side: a task sums (lang, source, word) over its own texts in a table of
bounded size before anything is shuffled, so a source that holds a third of all texts sends a count
for each of its words and task. From there on only counts move.

The counts of a (lang, source) group are a vector over the words that the language keeps. A vector is
cut along the words into blocks of about ``WIDTH`` positions, each compressed; groups are dealt into tiles.
The tiles of a block stay where they are (a stored, partitioned table), and their compressed copies
circulate: in round r of a round-robin tournament of n places, tile i meets tile (2 r - i) mod (n - 1),
and tile r meets the last one. The larger number travels, each pair of tiles meets once, and a meeting gives both
directions. ``rounds`` rounds are one job (a lap), whose results are written before the next starts; a lost
executor costs a part of a lap. What is in a task at once is a tile and its visitors of a lap within
one block; its bound depends on no group's size.

Where a block of a vector is made, a heap of ``top`` entries ranks its words against the language.

Null text, lang and source count as ''. A group without words has a vector of zeros. A language that keeps
no word has distances 0 and no words. Rows repeated are texts of their own. Other columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import string
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import delete, scratch_path, table

#: Words of a block of a vector, on average.
WIDTH = 4096
#: Entries of a task's table of counts before it is handed on.
HELD = 500_000
#: Into how many parts the words of a language are dealt where they meet the language's totals.
SALTS = 64
#: Everything in ASCII but letters parts words; A-Z become a-z. Other characters are letters, as they stand.
_LETTERS = bytes(ord(chr(b).lower()) if chr(b) in string.ascii_letters else b if b > 127 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) sums of a task; a row with an empty term for each group it met."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> pa.RecordBatch:
        cols: list[list[pa.Array]] = [[] for _ in _COUNTS]
        for (lang, source), (words, docs) in held.items():
            k = len(words) + 1
            terms = pa.array([b"", *words], pa.binary()).cast(pa.string(), safe=False)  # cut at ASCII signs: as valid as the text
            n, among = np.fromiter(words.values(), np.int64, k - 1), np.fromiter(map(docs.__getitem__, words), np.int64, k - 1)
            for col, values in zip(cols, (pa.repeat(pa.scalar(lang), k), pa.repeat(pa.scalar(source), k), terms, pa.array(np.append(0, n)), pa.array(np.append(0, among)))):
                col.append(values)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in cols], schema=_COUNTS)

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c) for c in ("text", "lang", "source"))):
            words = text.as_py().translate(_LETTERS).split()
            n, docs = held.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            n.update(words)
            docs.update(set(words))
        if sum(len(n) for n, _ in held.values()) > HELD:
            yield handed()
            held.clear()
    if held:
        yield handed()


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and texts of each word in each group, and a row with term '' for each group."""
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts = read.withColumn("text", F.col("text").cast("binary")).mapInArrow(_count_words, "lang string, source string, term string, n bigint, docs bigint")
    parts = parts.repartition("lang", "term")  # tasks have summed already, and all that counts a word of a language finds it in one place
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: np.ndarray, total: int, kinds: int) -> np.ndarray:
    """1 + floor(10^9 (n + 2) / (total + 2 kinds)), by long division, exact for totals under 9 * 10^15."""
    whole = total + 2 * kinds
    rest, out = n.astype(np.int64) + 2, np.zeros(len(n), np.int64)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """A sparse vector as bytes: steps between positions, then counts."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), 1)


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(packed)
    k = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", k).astype(np.int64)), np.frombuffer(raw, "<i8", k, 4 * k)


_BLOCKS = pa.schema([("lang", pa.string()), ("block", pa.int64()), ("tile", pa.int64()), ("tiles", pa.int64()), ("source", pa.string()), ("total", pa.int64()), ("kinds", pa.int64()), ("vector", pa.binary()), ("term", pa.string()), ("value", pa.int64())])
_BLOCKS_DDL = "lang string, block bigint, tile bigint, tiles bigint, source string, total bigint, kinds bigint, vector binary, term string, value bigint"


def _vector_of(top: int):
    """A group's block: its vector, and the ``top`` words in which it is most above its language."""

    def make(rows: pa.Table) -> pa.Table:
        head = {c: rows.column(c)[0].as_py() for c in ("lang", "block", "tile", "tiles", "source", "total", "kinds", "lang_total")}
        rows = rows.filter(rows.column("term").is_valid())
        at, n, in_lang = (rows.column(c).to_numpy().astype(np.int64) for c in ("at", "n", "in_lang"))
        order = np.argsort(at)
        best: list = []
        if len(n):
            p, q = _share(n, head["total"], head["kinds"]), _share(in_lang, head["lang_total"], head["kinds"])
            above, values = np.flatnonzero(p > q), _apart(p, q)
            terms = rows.column("term").cast(pa.binary())
            best = heapq.nsmallest(top, ((-int(values[i]), terms[int(i)].as_py()) for i in above))
        same = [head[c] for c in ("lang", "block", "tile", "tiles", "source", "total", "kinds")]
        out = [(*same, _pack(at[order], n[order]), None, None), *((*same, None, t, -v) for v, t in best)]
        cols = [pa.array(c, pa.binary() if f.name == "term" else f.type) for c, f in zip(zip(*out), _BLOCKS)]
        return pa.Table.from_arrays([c.cast(f.type, safe=False) for c, f in zip(cols, _BLOCKS)], schema=_BLOCKS)

    return make


_MET = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("rest", pa.int64())])


def _meet(home: pa.Table, visitors: pa.Table) -> pa.Table:
    """Distances within a block of every resident and every visitor, in both directions.

    ``value`` is the sum over the positions up to the last that either uses, less as many times the distance
    at a word that neither has. ``rest`` is that distance times all kept words: what all blocks lack together.
    """
    out: list[tuple] = []

    def read(t: pa.Table) -> list[tuple]:
        return [(r, *_unpack(r["vector"])) for r in t.to_pylist()]

    def dense(r: dict, at: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
        counts = np.zeros(width + 1, np.int64)  # the last stands for a word that it does not have
        counts[at] = n
        return _share(counts, r["total"], r["kinds"])

    residents = read(home) if visitors.num_rows else []
    for b, b_at, b_n in read(visitors) if residents else []:
        for a, a_at, a_n in residents:
            if b["round"] < 0 and not a["source"] < b["source"]:
                continue  # at home each pair meets once
            value = rest = 0
            if a["kinds"]:
                width = int(max([*a_at[-1:], *b_at[-1:], -1])) + 1
                f = _apart(dense(a, a_at, a_n, width), dense(b, b_at, b_n, width))
                value, rest = int(f[:-1].sum()) - width * int(f[-1]), int(f[-1]) * a["kinds"]
            out += [(a["lang"], a["source"], b["source"], value, rest), (a["lang"], b["source"], a["source"], value, rest)]
    cols = zip(*out) if out else [()] * len(_MET)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _MET)], schema=_MET)


def _vectors(docs: DataFrame, min_docs: int, top: int, width: int, folder: str) -> DataFrame:
    """Stored blocks of vectors and their best words, in ``folder``."""
    spark = docs.sparkSession
    word = Window.partitionBy("lang", "term")
    counts = word_counts(docs).withColumns({"among": F.sum("docs").over(word), "in_lang": F.sum("n").over(word), "one": F.row_number().over(word.orderBy("source")) == 1})
    counts.where((F.col("term") == "") | (F.col("among") >= min_docs)).drop("docs", "among").write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    counted = counts.where("one and term <> ''").select("lang", "term", "in_lang")
    langs = counted.groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("in_lang").alias("lang_total"))
    langs = langs.withColumn("blocks", F.ceil(F.col("kinds") / width))
    dealt = langs.select("lang", "blocks", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))  # a language may have most words
    placed = counted.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "term"), F.lit(SALTS))).join(dealt, ["lang", "salt"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    kept = placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1)
    kept.select("lang", "term", "block", "at").write.parquet(f"{folder}/kept")
    kept = spark.read.parquet(f"{folder}/kept")
    held = counts.where("term <> ''").join(kept, ["lang", "term"])
    totals = counts.where("term <> ''").groupBy("lang", "source").agg(F.sum("n").alias("total"))

    groups = counts.where("term = ''").select("lang", "source")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("s"))
    tiles = F.greatest(F.least(F.lit(64), F.ceil(F.col("s") / 2)), F.ceil(F.col("s") / 256))  # few rounds, and small tiles
    groups = groups.join(sizes, "lang").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
    groups = groups.select("lang", "source", tiles.alias("tiles"), F.pmod(F.xxhash64("source"), tiles).alias("tile"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "kinds", "lang_total")), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    every = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    rows = every.unionByName(held.select("lang", "source", "block", "term", "at", "n", "in_lang").join(groups.drop("blocks"), ["lang", "source"]), allowMissingColumns=True)
    rows.groupBy("lang", "block", "source").applyInArrow(_vector_of(top), _BLOCKS_DDL).write.parquet(f"{folder}/blocks")
    return spark.read.parquet(f"{folder}/blocks")


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, width: int = WIDTH, rounds: int = 4) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to all other sources of the language, and the words that mark a source.

    ``min_docs``: a language keeps the words that so many of its texts have. Distances are sums of
    floor((p - q)^2 / (p + q)) over the kept words, p and q being smoothed shares in parts of 10^9.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "divergence")
    blocks = _vectors(docs, min_docs, top, width, folder)
    delete(spark, f"{folder}/counts")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    home = blocks.where("vector is not null").drop("term", "value").repartition(n, "lang", "block", "tile").persist(StorageLevel.MEMORY_AND_DISK)
    most = home.agg(F.max("tiles")).head()[0] or 1
    try:
        for k, begin in enumerate(range(-1, most + most % 2 - 1, rounds)):
            _lap(home, begin, begin + rounds).write.parquet(f"{folder}/met/lap={k}")
    finally:
        home.unpersist()

    met = spark.read.schema("lang string, source string, item string, value bigint, rest bigint").parquet(f"{folder}/met")
    summed = met.groupBy("lang", "source", "item").agg((F.sum("value") + F.first("rest")).alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    words = blocks.where("vector is null").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(words.withColumn("rank", rank).where(F.col("rank") <= top))


def _lap(home: DataFrame, begin: int, end: int) -> DataFrame:
    """The meetings of rounds ``begin`` to ``end`` - 1; round -1 is that of the sources of a tile among themselves."""
    places = F.col("tiles") + F.col("tiles") % 2
    going = home.withColumn("round", F.explode(F.sequence(F.lit(begin), F.lit(end - 1)))).where(F.col("round") < places - 1)
    host = F.when(F.col("round") < 0, F.col("tile")).when(F.col("tile") == places - 1, F.col("round")).when(F.col("tile") == F.col("round"), places - 1)
    host = host.otherwise(F.pmod(2 * F.col("round") - F.col("tile"), places - 1))
    going = going.withColumn("host", host).where((F.col("round") < 0) | (F.col("tile") > F.col("host")))
    visitors = going.select("lang", "block", F.col("host").cast("bigint").alias("tile"), "source", "total", "kinds", "vector", "round")
    keys = ["lang", "block", "tile"]
    return home.groupBy(*keys).cogroup(visitors.groupBy(*keys)).applyInArrow(_meet, "lang string, source string, item string, value bigint, rest bigint")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT d, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS in_lang FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(in_lang) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM docs),
held AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS n FROM held GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n,
  1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 2)) // (coalesce(t.n, 0)::HUGEINT + 2 * l.v) AS p,
  1 + (1000000000::HUGEINT * (k.in_lang + 2)) // (l.n::HUGEINT + 2 * l.v) AS q
  FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value::BIGINT AS value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
