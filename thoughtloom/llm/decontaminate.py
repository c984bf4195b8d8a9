"""Benchmark decontamination by templates, with DataFrame functions only.

Texts and benchmark items become sequences of tokens: words in lower case, with numbers, units after
numbers, and names (capitalised words after a lower-case word, a comma or a semicolon) replaced by
typed placeholders whose values are kept aside. Windows of ``window`` tokens are hashed on both
sides and joined by hash, so a question with other numbers or names has the same windows.

A text and an item meet in the places of the item's windows. They count as the same question where
at least ``least`` windows (or all, if the item has fewer) agree and the slots are consistent: every
value of a slot in the item stands for one value in the text throughout. Both are judged for each
alignment (place in the text less place in the item): for one shift alone, for shifts that differ
by up to DRIFT, and for the text as a whole; the best that passes is reported, so a variant that
does not pass hides no copy elsewhere in the text. Windows with fewer than
``literals`` real words carry no evidence and are left out.

The benchmark decides what is compared. Up to SENT windows of it are sent to every task, and texts
without any of them end in the scan; of a larger benchmark a sieve of bounded size is sent, and only
text windows that pass it are joined by their full hash. Results do not depend on which way is
taken. Equal items are one, under the smallest id. Items without a window that carries evidence (shorter than one, or mostly numbers,
units and names) are found where a text holds all their words, with the same values. A capitalised
word elsewhere (at the start of a sentence, after a digit, quote or bracket) may be a name or not:
windows over it are hashed in both forms. Null or empty texts and items match
nothing; rows repeated with the same id and text are one. Null ids are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, sieve, sifted, table
from .linededup import _let

WINDOW, LEAST, LITERALS = 8, 6, 4
#: A benchmark of at most so many windows is sent to every task.
SENT = 1 << 16
#: Words that a copy of an item may have more or less than the item and still be one alignment.
DRIFT = 8
#: Units that are a placeholder after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t oz lb ml l s ms h min hour hours minute minutes second seconds day days week weeks year years usd eur gbp dollar dollars euro euros cent cents percent degree degrees"

#: What separates words: all but letters, digits and signs that follow them. Signs stay with the word before
#: them (and within numbers), since they tell what begins a sentence; signs that stand alone are no words.
_SIGNS = ".,;:!?"
_BETWEEN = r"[^\p{L}\p{N}.,;:!?]+(?:[.,;:!?]+(?![\p{L}\p{N}])[^\p{L}\p{N}.,;:!?]*)*+"
#: A word that may be a name, and the end of a word after which it is one.
_CAPITAL, _GOES_ON = r"^\p{Lu}\p{Ll}", r"[\p{Ll},;]$"
#: Codes of placeholders.
_IS_NAME, _IS_NUMBER, _IS_UNIT = 2, 4, 6


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, _BETWEEN, -1), "")


def _word(token: Column) -> Column:
    return F.lower(F.trim(token, F.lit(_SIGNS)))


def _is_number(token: Column) -> Column:
    return (F.ascii(token) < 58) & (F.ascii(token) > 47)


def _codes(tokens: Column) -> Column:
    """A number for each token: for placeholders that of their kind, else even, or odd for a word that may be a name."""
    units = F.array(*(F.lit(u) for u in UNITS.split()))
    number, name, unit = (F.lit(x).cast("long") for x in (_IS_NUMBER, _IS_NAME, _IS_UNIT))

    def one(token: Column, i: Column) -> Column:
        before = F.coalesce(F.get(tokens, i - 1), F.lit(""))
        code = F.xxhash64(_word(token)).bitwiseAND(F.lit(-2))
        plain = F.when(_is_number(before) & F.array_contains(units, _word(token)), unit).otherwise(code)
        first = F.ascii(token)
        return (
            F.when((first > 96) & (first < 123), plain)  # most words: all else is then not looked at
            .when(_is_number(token), number)
            .when(token.rlike(_CAPITAL), F.when(before.rlike(_GOES_ON), name).otherwise(code.bitwiseOR(F.lit(1))))
            .otherwise(plain)
        )

    return F.transform(tokens, one)


def _windows(rows: DataFrame, keys: list[str], text: str, window: int, known: list[int] | None = None) -> DataFrame:
    """A row for each window and form: keys, pos, form, h, and its slots, null for words that are none.

    In form 1 each capitalised word is a name; its windows are there where they differ from form 0.
    With ``known`` only windows of these hashes. Tokens are read by lambda functions once for a text;
    windows are plain expressions over its arrays, in generated code.
    """
    read = _let(_tokens(F.col(text)), lambda tokens: F.struct(tokens.alias("tokens"), _codes(tokens).alias("codes")))
    rows = rows.select(*keys, read.alias("_read")).select(*keys, F.col("_read.tokens").alias("_tokens"), F.col("_read.codes").alias("_codes"))
    # The outer form keeps the optimiser from testing the whole expression once more below.
    rows = rows.select(*keys, "_tokens", "_codes", F.posexplode_outer("_codes").alias("pos", "_code")).where(F.col("pos") <= F.size("_codes") - window)
    code = lambda k: F.get("_codes", F.col("pos") + k)
    plain = lambda k: code(k).bitwiseAND(F.lit(-2))
    named = lambda k: F.when(code(k).bitwiseAND(F.lit(1)) == 1, F.lit(_IS_NAME).cast("long")).otherwise(code(k))
    rows = rows.select(*keys, "_tokens", "_codes", "pos", F.xxhash64(*(plain(k) for k in range(window))).alias("_h0"), F.xxhash64(*(named(k) for k in range(window))).alias("_h1"))
    if known is not None:
        rows = rows.where(F.col("_h0").isin(known) | F.col("_h1").isin(known))

    def slots(form) -> Column:
        return F.array(*(F.when(form(k).between(1, 6), _word(F.get("_tokens", F.col("pos") + k))) for k in range(window)))

    both = F.array(F.struct(F.lit(0).alias("form"), F.col("_h0").alias("h"), slots(plain).alias("slots")), F.struct(F.lit(1).alias("form"), F.col("_h1").alias("h"), slots(named).alias("slots")))
    found = rows.select(*keys, "pos", "_h0", F.explode(both).alias("_w")).select(*keys, "pos", "_h0", "_w.*")
    return found.where((F.col("form") == 0) | (F.col("h") != F.col("_h0"))).drop("_h0")


def _verbatim(texts: DataFrame, items: DataFrame, window: int) -> DataFrame | None:
    """(doc, text_hash, item): each item whose whole sequence of words a text holds; None without items.

    The first words of an item, up to ``window``, are looked up by hash, then all are compared.
    """
    plain = lambda text: F.filter(F.transform(_tokens(text), _word), lambda w: w != "")
    short = items.select("item", plain(F.col("item_text")).alias("words")).where(F.size("words") > 0)
    short = checkpointed(short.withColumn("many", F.least(F.size("words"), F.lit(window))))
    lengths = sorted(r[0] for r in short.select("many").distinct().collect())
    if not lengths:
        return None
    longest = short.agg(F.max(F.size("words"))).head()[0]
    hash_of = lambda i, many: F.xxhash64(F.lit(many), *(F.element_at("words", i + k) for k in range(many)))
    starts = lambda many: F.when(F.size("words") >= many, F.sequence(F.lit(1), F.size("words") - (many - 1))).otherwise(F.array().cast("array<int>"))
    placed = lambda many: F.transform(starts(many), lambda i: F.struct(i.alias("start"), hash_of(i, many).alias("h")))
    at = F.concat(*(placed(many) for many in lengths))
    rows = texts.select("doc", "text_hash", plain(F.col("doc_text")).alias("words"))
    rows = rows.select("doc", "text_hash", "words", at.alias("at"))
    rows = rows.select("doc", "text_hash", "words", F.explode_outer("at").alias("at")).select("doc", "text_hash", "words", "at.*")
    first = F.lit(None).cast("long")
    for m in lengths:
        first = F.when(F.col("many") == m, hash_of(F.lit(1), m)).otherwise(first)
    wanted = short.select("item", F.col("words").alias("item_words"), first.alias("h"))
    rows = sifted(rows, "h", checkpointed(sieve(wanted, "h"))).select("doc", "text_hash", "h", F.slice("words", F.col("start"), F.lit(longest)).alias("rest"))
    same = rows.join(wanted, "h").where(F.slice("rest", F.lit(1), F.size("item_words")) == F.col("item_words"))
    return same.select("doc", "text_hash", "item").distinct()


def _ways(shift: Column) -> Column:
    """The alignments a match counts for: the whole text, its own shift, and two overlapping ranges of shifts."""
    near = lambda offset: F.floor((shift + offset) / (2 * DRIFT)).cast("int")
    ways = (0, F.lit(0)), (1, shift), (2, near(0)), (3, near(DRIFT))
    return F.array(*(F.struct(F.lit(k).alias("kind"), at.cast("int").alias("at")) for k, at in ways))


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", window: int = WINDOW, least: int = LEAST, literals: int = LITERALS) -> DataFrame:
    """(key, text_hash, item_key, matched, windows, exact): each item that a text holds.

    ``matched`` of the item's ``windows`` agree; ``exact`` tells whether all slots hold the same values.
    """
    held = items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("item_text")).where("item_text is not null").groupBy("item_text").agg(F.min("item").alias("item"))
    wanted = _windows(held, ["item"], "item_text", window)
    real = F.size(F.filter("slots", lambda x: x.isNull()))
    wanted = wanted.where(real >= literals).select("item", F.col("pos").alias("item_pos"), "form", "h", F.col("slots").alias("item_slots"))
    # A window of form 1 has at most the real words of form 0, which so has all that count.
    wanted = checkpointed(wanted.withColumn("windows", F.sum(1 - F.col("form")).over(Window.partitionBy("item"))).drop("form"))
    texts = docs.select(F.col(f"`{key}`").alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("text_hash"), F.col(f"`{text}`").alias("doc_text"))
    whole = _verbatim(texts, held.join(wanted.select("item").distinct(), "item", "left_anti"), window)
    if wanted.count() <= SENT:
        known = [r["h"] for r in wanted.select("h").distinct().collect()]
        found = _windows(texts, ["doc", "text_hash"], "doc_text", window, known)
        wanted = F.broadcast(wanted)
    else:
        found = sifted(_windows(texts, ["doc", "text_hash"], "doc_text", window), "h", checkpointed(sieve(wanted, "h")))
    # Within an alignment the first place of each window of an item stands for all.
    pairs = found.drop("form").join(wanted, "h").withColumn("way", F.explode(_ways(F.col("pos") - F.col("item_pos"))))
    pairs = pairs.groupBy("doc", "text_hash", "item", "item_pos", "windows", "way").agg(F.min(F.struct("pos", "slots", "item_slots")).alias("at"))
    pairs = pairs.groupBy("doc", "text_hash", "item", "windows", "way").agg(F.count("*").alias("matched"), F.collect_set(F.arrays_zip(F.col("at.item_slots").alias("item_slots"), F.col("at.slots").alias("slots"))).alias("filled"))
    filled = F.array_distinct(F.flatten("filled"))
    pairs = pairs.where(F.col("matched") >= F.least(F.lit(least), "windows")).withColumn("filled", filled)
    values = F.array_distinct(F.transform("filled", lambda x: x["item_slots"]))
    pairs = pairs.where(F.size(values) == F.size("filled"))
    exact = F.forall("filled", lambda x: x["item_slots"].eqNullSafe(x["slots"]))
    best = pairs.groupBy("doc", "text_hash", "item", "windows").agg(F.max(F.struct("matched", exact.alias("exact"))).alias("best"))
    best = best.select("doc", "text_hash", "item", "best.matched", "windows", "best.exact")
    if whole is not None:
        best = best.unionByName(whole.select("*", F.lit(1).cast("long").alias("matched"), F.lit(1).cast("long").alias("windows"), F.lit(True).alias("exact")))
    return best.select(F.col("doc").alias(key), "text_hash", F.col("item").alias(item_key), "matched", "windows", "exact")


def remove_leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows that hold an item; its columns may have any names.

    Only rows whose text hash is in the sieve of the texts found are moved.
    """
    mark, other, other_mark = fresh(docs.columns, "mark", "other", "other_mark")
    leaks = checkpointed(find_leaks(docs, items, text, key, **options).select(F.col(f"`{key}`").alias(other), F.col("text_hash").alias(other_mark)).distinct())
    marks = checkpointed(sieve(leaks, other_mark))
    rows = docs.withColumn(mark, F.xxhash64(F.col(f"`{text}`")))
    same = F.col(f"`{key}`").eqNullSafe(F.col(other)) & (F.col(mark) == F.col(other_mark))
    return sifted(rows, mark, marks, held=False).unionByName(sifted(rows, mark, marks).join(leaks, same, "left_anti")).drop(mark)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return find_leaks(docs.select("doc_id", "text"), items).drop("text_hash")
