"""From turns to concepts: rule-based extraction, grounding, grouping by slug, distillation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import content_hash, jaccard, normalize_whitespace, sentences, short_keywords, slugify, stripped, word_set

#: The pattern of a name, and the limits of the rule-based extractor.
TITLE_CASE = r"\b([A-Z][a-zA-Z0-9]*(?:-[A-Z][a-zA-Z0-9]*)*(?:[ \t]+[A-Z][a-zA-Z0-9]*(?:-[A-Z][a-zA-Z0-9]*)*){0,3})\b"
PER_TEXT, LEAST_NAME, DEFINITION_CHARS, CONTENT_CHARS = 3, 3, 300, 5000
RULE_CONFIDENCE = 0.9

#: Phrases that carry no content, phrases that mark insights, cues of examples.
FLUFF = (
    r"(?i)\b(?:as (?:I|we) (?:mentioned|discussed|said|noted))(?:\s+(?:earlier|before|above))?\b[,.]?\s*",
    r"(?i)\b(?:in (?:our|the|this) (?:conversation|discussion|chat))\b[,.]?\s*",
    r"(?i)\b(?:let me explain|I(?:'ll| will) explain|here's (?:the|an?) explanation)\b[,.]?\s*",
    r"(?i)\b(?:great question|good question|that's a good point)\b[!,.]?\s*",
    r"(?i)\b(?:sure|absolutely|definitely|of course)[!,.]?\s*",
    r"(?i)\b(?:hope (?:this|that) helps)\b[!,.]?\s*",
    r"(?i)\b(?:you're right|exactly|precisely)\b[!,.]?\s*",
)
KEY_PHRASES = ("important", "key", "critical", "essential", "note that", "remember", "crucial", "significant", "advantage", "benefit", "drawback", "limitation", "trade-off", "tradeoff")
EXAMPLE_CUE = r"(?i)(?:(?:for example|e\.g\.|such as|for instance)[,:]?\s*)(.{15,300}?)[.!]"
CODE_BLOCK = r"```\w*\n([\s\S]*?)```"


def rule_concepts(text: Column) -> Column:
    """Array of (name, definition): the first distinct title-case phrases, with their sentences.

    A phrase never spans the end of a sentence, so phrases are sought sentence by sentence.
    """
    found = F.flatten(F.transform(F.split(text, r"[.!?]\s+"), lambda s: F.transform(F.regexp_extract_all(s, F.lit(TITLE_CASE), 1), lambda p: F.struct(p.alias("name"), F.substring(stripped(s), 1, DEFINITION_CHARS).alias("definition")))))
    long = F.filter(found, lambda x: F.length(x["name"]) >= LEAST_NAME)
    names = F.transform(long, lambda x: x["name"])
    return F.slice(F.filter(long, lambda x, i: F.array_position(names, x["name"]) == i + 1), 1, PER_TEXT)


def extract_by_rule(batches: DataFrame, keys: list[str], text: str = "content") -> DataFrame:
    """keys, rank, name, definition: the concepts of each text."""
    rows = batches.select(*keys, F.posexplode(rule_concepts(F.col(text))).alias("rank", "c"))
    return rows.select(*keys, "rank", "c.name", "c.definition")


def is_grounded(name: Column, text: Column) -> Column:
    """Whether a name stands in a text between non-alphanumerics, or does without its final "s"."""
    low, inside = F.lower(name), F.lower(text)
    literal = lambda n: F.replace(n, F.lit(r"\E"), F.lit(r"\E\\E\Q"))  # a name may hold the end of a quotation
    quoted = lambda n: F.concat(F.lit(r"(?<![A-Za-z0-9])\Q"), literal(n), F.lit(r"\E(?![A-Za-z0-9])"))
    singular = F.substring(low, F.lit(1), F.greatest(F.length(low) - 1, F.lit(0)))
    return F.coalesce((low != "") & (F.rlike(inside, quoted(low)) | (low.endswith("s") & (F.length(low) > 3) & F.rlike(inside, quoted(singular)))), F.lit(False))


def json_object(reply: Column) -> Column:
    """The JSON object in a model's reply: without a fence, else between the outermost braces; or null."""
    bare = stripped(F.regexp_replace(F.regexp_replace(stripped(reply), r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", ""))
    inner = F.regexp_extract(bare, r"(\{[\s\S]*\})", 1)
    valid = lambda t: F.when(F.try_parse_json(t).isNotNull(), t)
    return F.coalesce(valid(bare), valid(F.nullif(inner, F.lit(""))))


def parse_reply(replies: DataFrame, keys: list[str], reply: str = "reply") -> DataFrame:
    """keys, name, raw_content, confidence from replies {"concepts": [...]}; names under 3 characters go."""
    schema = "struct<concepts: array<struct<name:string,definition:string,explanation:string,insights:array<string>,examples:array<string>,tags:array<string>,relationships:array<struct<target:string,type:string>>>>>"
    rows = replies.select(*keys, F.explode(F.from_json(json_object(F.col(reply)), schema)["concepts"]).alias("c"))
    rows = rows.where(F.length(stripped(F.col("c.name"))) >= LEAST_NAME)
    lines = lambda items: F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")
    some = lambda items, out: F.when(F.size(items) > 0, out)
    parts = F.concat_ws(
        "\n\n",
        F.nullif(F.col("c.definition"), F.lit("")),
        F.nullif(F.col("c.explanation"), F.lit("")),
        some(F.col("c.insights"), lines(F.col("c.insights"))),
        some(F.col("c.examples"), F.concat(F.lit("Examples:\n"), lines(F.col("c.examples")))),
        some(F.col("c.tags"), F.concat(F.lit("[[tags:"), F.array_join("c.tags", ","), F.lit("]]"))),
        some(F.col("c.relationships"), F.array_join(F.transform("c.relationships", lambda r: F.concat(F.lit("[[rel:"), r["type"], F.lit(":"), r["target"], F.lit("]]"))), "\n")),
    )
    return rows.select(*keys, stripped(F.col("c.name")).alias("name"), F.substring(parts, 1, CONTENT_CHARS).alias("raw_content"), F.lit(RULE_CONFIDENCE).alias("confidence"))


def first_wins(concepts: DataFrame, order: list[str]) -> DataFrame:
    """The first of the concepts whose names agree but for case."""
    return concepts.withColumn("_n", F.row_number().over(Window.partitionBy(F.lower("name")).orderBy(*order))).where("_n = 1").drop("_n")


def group_by_slug(mentions: DataFrame, file: str = "source_file", turn: str = "idx") -> DataFrame:
    """One concept per slug of (name, definition, file, turn): the longest definition is primary.

    Sources keep every file that named the concept, with its distinct turns.
    """
    rows = mentions.withColumn("slug", slugify(F.col("name"))).where("slug <> ''")
    per_file = rows.groupBy("slug", file).agg(F.array_sort(F.collect_set(turn)).alias("turns"), F.max(F.struct(F.length("definition").alias("n"), "definition", "name")).alias("p"), F.count("*").alias("k"))
    out = per_file.groupBy("slug").agg(F.max("p").alias("p"), F.array_sort(F.collect_list(file)).alias("source_files"), F.sum("k").alias("mentions"))
    return out.select(F.col("p.name").alias("name"), "slug", F.col("p.definition").alias("definition"), short_keywords(F.col("p.definition")).alias("tags"), "source_files", F.lit(RULE_CONFIDENCE).alias("confidence"), "mentions", concept_hash(F.col("p.name"), F.col("p.definition")).alias("hash"))


def concept_hash(name: Column, definition: Column) -> Column:
    return content_hash(F.concat(name, F.lit(":"), definition))


def provenance(mentions: DataFrame, file: str = "source_file", turn: str = "idx") -> DataFrame:
    """(slug, transcript_path, turn_indices, snippet): where each concept was named."""
    rows = mentions.withColumn("slug", slugify(F.col("name"))).where("slug <> ''")
    return rows.groupBy("slug", F.col(file).alias("transcript_path")).agg(F.array_sort(F.collect_set(turn)).alias("turn_indices"), F.min_by(F.substring("definition", 1, 500), F.struct(turn, "definition")).alias("snippet"))


#: A place where a concept was named, as a store keeps it.
SOURCE = "struct<transcript_path:string,transcript_hash:string,turn_indices:array<int>,extracted_at:timestamp,chunk_id:string,snippet:string>"


def source_refs(named: DataFrame, chunks: DataFrame, hashes: DataFrame, now: Column) -> DataFrame:
    """(slug, sources) of concepts with ``source_chunks``: for each file its hash, turns, and the first chunk with its text.

    ``chunks`` has chunk_id, source_file, turn_index and content; ``hashes`` path and hash. Chunks that are not there are left out.
    """
    listed = named.select("slug", F.posexplode("source_chunks").alias("at", "chunk_id")).join(chunks.select("chunk_id", "source_file", "turn_index", "content"), "chunk_id")
    first = lambda c: F.min_by(c, "at")
    files = listed.groupBy("slug", "source_file").agg(F.array_sort(F.collect_set(F.col("turn_index").cast("int"))).alias("turns"), first("chunk_id").alias("chunk_id"), F.substring(first("content"), 1, CONTENT_CHARS).alias("snippet"))
    files = files.join(hashes.select(F.col("path").alias("source_file"), "hash"), "source_file", "left")
    ref = F.struct(F.col("source_file").alias("transcript_path"), F.coalesce("hash", F.lit("")).alias("transcript_hash"), F.col("turns").alias("turn_indices"), now.alias("extracted_at"), "chunk_id", "snippet")
    return files.groupBy("slug").agg(F.array_sort(F.collect_list(ref)).cast(f"array<{SOURCE}>").alias("sources"))


def remove_fluff(text: Column) -> Column:
    for pattern in FLUFF:
        text = F.regexp_replace(text, pattern, "")
    return stripped(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def build_definition(name: Column, parts: Column) -> Column:
    """Up to three sentences that name the concept, else the first three.

    A sentence that goes on with "is", "means" and so on counts even when three are found already,
    which the limit of three makes indifferent: the first three that hold the name are taken.
    """
    naming = F.filter(parts, lambda s: F.contains(F.lower(s), F.lower(name)))
    return normalize_whitespace(F.array_join(F.slice(F.when(F.size(naming) > 0, naming).otherwise(parts), 1, 3), " "))


def build_explanation(parts: Column, definition: Column) -> Column:
    """Up to eight further sentences: distinct, not part of the definition nor too close to it.

    What is asked of every sentence is bound as a lambda variable, else it would be computed anew for each.
    """
    flat = lambda s: F.lower(normalize_whitespace(s))

    def told(x: Column) -> Column:
        fresh = lambda s, i: (F.array_position(x["norm"], s["norm"]) == i + 1) & ~F.contains(x["known"], s["norm"]) & ~F.contains(s["norm"], x["known"]) & (jaccard(s["words"], x["words"]) <= 0.7)
        every = F.transform(x["parts"], lambda s, i: F.struct(s.alias("s"), F.get(x["norm"], i).alias("norm"), word_set(F.get(x["norm"], i)).alias("words")))
        return F.transform(F.slice(F.filter(every, fresh), 1, 8), lambda s: s["s"])

    known = F.transform(F.array(flat(definition)), lambda k: F.struct(parts.alias("parts"), F.transform(parts, flat).alias("norm"), k.alias("known"), word_set(k).alias("words")))
    return normalize_whitespace(F.array_join(F.get(F.transform(known, told), F.lit(0)), " "))


def insights(text: Column, definition: Column) -> Column:
    """Bullets, then numbered items, then sentences with a key phrase; distinct, at most ten."""
    known = F.lower(normalize_whitespace(definition))
    items = lambda p: F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), 1), normalize_whitespace), lambda s: (F.length(s) > 10) & ~F.contains(known, F.lower(s)))
    telling = F.lit(False)
    said = F.transform(sentences(text), normalize_whitespace)

    def tells(s: Column) -> Column:
        out = telling
        for phrase in KEY_PHRASES:
            out = out | F.contains(F.lower(s), F.lit(phrase))
        return out & (F.length(s) > 15)

    every = F.concat(items(r"(?m)^\s*[-*]\s+(.{10,200})$"), items(r"(?m)^\s*\d+[.)]\s+(.{10,200})$"), F.filter(said, tells))
    low = F.transform(every, lambda s: F.lower(s))
    return F.slice(F.filter(every, lambda s, i: F.array_position(low, F.get(low, i)) == i + 1), 1, 10)


def examples(text: Column) -> Column:
    """What follows an example cue, then fenced code; distinct, at most five."""
    cued = F.transform(F.regexp_extract_all(text, F.lit(EXAMPLE_CUE), 1), normalize_whitespace)
    code = F.filter(F.transform(F.regexp_extract_all(text, F.lit(CODE_BLOCK), 1), stripped), lambda c: F.length(c) > 10)
    fenced = F.transform(code, lambda c: F.concat(F.lit("```\n"), c, F.lit("\n```")))
    return F.slice(F.array_distinct(F.concat(cued, fenced)), 1, 5)


def distill_marked(raw: DataFrame) -> DataFrame:
    """Concepts from raw contents with [[rel:type:Target]] and [[tags:a,b]] markers.

    The first plain paragraph is the definition, others the explanation; "- " paragraphs are
    insights, an "Examples:" paragraph lists examples.
    """
    content = F.col("raw_content")
    rel, tag = r"\[\[rel:(\w+):(.+?)\]\]", r"\[\[tags:(.+?)\]\]"
    paragraphs = F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(content, rel, ""), tag, ""), "\n\n"), stripped), lambda p: p != "")
    bare = lambda line: stripped(F.regexp_replace(stripped(line), "^[- ]+", ""))
    listed = lambda ps: F.flatten(F.transform(ps, lambda p: F.transform(F.split(p, "\n"), bare)))
    plain = F.filter("_p", lambda p: ~p.startswith("Examples:") & ~p.startswith("- "))
    types, targets = F.regexp_extract_all(content, F.lit(rel), 1), F.regexp_extract_all(content, F.lit(rel), 2)
    known = F.array(*(F.lit(t) for t in RELATION_TYPES))
    relations = F.transform(F.arrays_zip(types.alias("t"), targets.alias("n")), lambda x: F.struct(slugify(F.col("name")).alias("source"), slugify(x["n"]).alias("target"), F.when(F.array_contains(known, x["t"]), x["t"]).otherwise("related_to").alias("type"), F.lit(0.85).alias("confidence")))
    own = F.filter(F.transform(F.split(F.regexp_extract(content, tag, 1), ","), stripped), lambda t: t != "")
    rows = raw.withColumn("_p", paragraphs)
    return rows.select(
        *raw.columns,
        F.coalesce(normalize_whitespace(F.try_element_at(plain, F.lit(1))), F.lit("")).alias("definition"),
        F.array_join(F.transform(F.slice(plain, F.lit(2), F.greatest(F.size(plain), F.lit(1))), normalize_whitespace), " ").alias("explanation"),
        F.filter(listed(F.filter("_p", lambda p: p.startswith("- "))), lambda s: F.length(s) > 10).alias("insights"),
        F.filter(listed(F.transform(F.filter("_p", lambda p: p.startswith("Examples:")), lambda p: stripped(F.replace(p, F.lit("Examples:"), F.lit(""))))), lambda s: s != "").alias("examples"),
        F.when(F.size(own) > 0, own).otherwise(short_keywords(F.array_join("_p", "\n\n"))).alias("tags"),
        relations.alias("relationships"),
        F.array_distinct(F.transform(targets, stripped)).alias("links"),
    )


def links_of(concepts: DataFrame) -> DataFrame:
    """(source, target, type, confidence) as the concepts themselves name them; none where they have no such column."""
    if "relationships" not in concepts.columns:
        return concepts.select(F.col("slug").alias("source"), F.col("slug").alias("target"), F.lit("related_to").alias("type"), F.lit(0.0).alias("confidence")).limit(0)
    named = concepts.select(F.col("slug").alias("source"), F.explode("relationships").alias("r")).select("source", "r.target", "r.type", "r.confidence")
    return named.where("target <> '' and source <> target").groupBy("source", "target", "type").agg(F.max("confidence").alias("confidence"))


#: The relation types.
RELATION_TYPES = ("uses", "improves", "depends_on", "related_to", "part_of", "example_of", "contrasts_with", "enables")


def merge_concepts(versions: DataFrame, order: str) -> DataFrame:
    """One row per slug from versions of concepts, in ``order``: ordered unions, longer texts, best confidence.

    A concept is deleted only if every version is, since the earliest of their times.
    """
    lists = [c for c in ("insights", "examples", "tags", "source_files", "links", "relationships", "sources") if c in versions.columns]
    ordered = F.array_sort(F.collect_list(F.struct(order, *lists)))
    longest = lambda c: F.max_by(c, F.struct(F.length(c), -F.col(order)))
    out = versions.groupBy("slug").agg(
        F.min_by("name", order).alias("name"),
        longest("definition").alias("definition"),
        longest("explanation").alias("explanation"),
        F.max("confidence").alias("confidence"),
        F.when(F.bool_and(F.col("status") == "deleted"), "deleted").otherwise("active").alias("status"),
        F.when(F.bool_and(F.col("status") == "deleted"), F.min("deleted_at")).alias("deleted_at"),
        *(F.max(c).alias(c) for c in ("last_reinforced_at", "last_reviewed_at") if c in versions.columns),
        ordered.alias("_v"),
    )
    return out.select(*(c for c in out.columns if c != "_v"), *map(_union, lists))


def _union(column: str) -> Column:
    """The lists of all versions as one; versions without a list add nothing."""
    return F.array_distinct(F.flatten(F.filter(F.transform("_v", lambda v: v[column]), lambda x: x.isNotNull()))).alias(column)
