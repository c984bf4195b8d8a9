"""Turns from role-marked text, and chunks from turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stripped

#: Role markers at the start of a line, in the order they are tried.
MARKERS = (
    (r"(?i)^(?:Human|User|Me)\s*:", "human"),
    (r"(?i)^(?:Assistant|AI|Claude|Bot|GPT|ChatGPT)\s*:", "assistant"),
    (r"(?i)^System\s*:", "system"),
    (r"(?i)^#{1,4}\s*(?:Human|User|Me)\b", "human"),
    (r"(?i)^#{1,4}\s*(?:Assistant|AI|Claude|Bot)\b", "assistant"),
)


#: Holds wherever a marker does; texts without it need not be read line by line.
_ANY_MARKER = r"(?i)(?:Human|User|Me|Assistant|AI|Claude|Bot|GPT|System)\s*:|#\s*(?:Human|User|Me|Assistant|AI|Claude|Bot)\b"


def line_role(line: Column) -> Column:
    """The role that a line announces, or null."""
    out = F.lit(None).cast("string")
    for pattern, role in reversed(MARKERS):
        out = F.when(stripped(line).rlike(pattern), role).otherwise(out)
    return out


def after_marker(line: Column) -> Column:
    rest = stripped(line)
    for pattern, _ in reversed(MARKERS):
        rest = F.when(stripped(line).rlike(pattern), F.regexp_replace(stripped(line), pattern, "")).otherwise(rest)
    return stripped(F.regexp_replace(stripped(rest), "^:+", ""))


def parse_turns(files: DataFrame, path: str = "source_file", text: str = "text") -> DataFrame:
    """(source_file, idx, role, content) of transcripts, one row of ``files`` each.

    A marker opens a turn; "---" closes it and hands over to the other side; lines before the first
    marker are lost; empty turns are dropped before counting. A text without any turn is one turn
    of the assistant. The lines of a text are folded within its row, so nothing is shuffled.
    """
    empty = F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"))
    start = F.struct(F.array().cast("array<struct<role:string,content:string>>").alias("done"), empty.alias("open"))

    def closed(acc: Column) -> Column:
        content = stripped(F.coalesce(acc["open"]["content"], F.lit("")))
        turn = F.struct(acc["open"]["role"].alias("role"), content.alias("content"))
        return F.when(acc["open"]["role"].isNotNull() & (content != ""), F.concat(acc["done"], F.array(turn))).otherwise(acc["done"])

    def step(acc: Column, line: Column) -> Column:
        role, rest = line["role"], line["rest"]
        opened = acc["open"]["role"]
        other = F.when(opened == "human", "assistant").when(opened == "assistant", "human").otherwise(opened)
        text_ = F.when(opened.isNull(), F.lit(None).cast("string")).otherwise(F.concat_ws("\n", acc["open"]["content"], line["line"]))
        begin = lambda r, c: F.struct(closed(acc).alias("done"), F.struct(r.alias("role"), c.alias("content")).alias("open"))
        go_on = F.struct(acc["done"].alias("done"), F.struct(opened.alias("role"), text_.alias("content")).alias("open"))
        return F.when(role.isNotNull(), begin(role, F.when(rest != "", rest))).when((stripped(line["line"]) == "---") & opened.isNotNull(), begin(other, F.lit(None).cast("string"))).otherwise(go_on)

    lines = F.transform(F.split(F.col(text), "\n", -1), lambda x: F.struct(x.alias("line"), line_role(x).alias("role"), after_marker(x).alias("rest")))
    whole = F.array(F.struct(F.lit("assistant").alias("role"), stripped(F.col(text)).alias("content")))
    folded = F.when(F.col(text).rlike(_ANY_MARKER), F.aggregate(lines, start, step, closed))
    turns = F.when(F.size(folded) > 0, folded).otherwise(whole)
    out = files.select(F.col(path).alias("source_file"), F.posexplode(turns).alias("idx", "turn"))
    return out.select("source_file", "idx", "turn.role", "turn.content")


def chunk_pieces(content: Column, min_length: int = 80) -> Column:
    """The chunks of one turn: fences apart, then headings, then blank lines, small ones merged."""
    fence = "\u0002"
    cut = F.split(F.regexp_replace(content, r"(```[\s\S]*?```)", f"{fence}$1{fence}"), fence)
    prose = lambda b: F.flatten(F.transform(F.split(b, r"\n(?=#{1,4}\s)"), lambda s: F.split(stripped(s), r"\n\s*\n")))
    blocks = F.flatten(F.transform(cut, lambda b: F.when(b.startswith("```"), F.array(b)).otherwise(prose(stripped(b)))))
    pieces = F.filter(F.transform(blocks, stripped), lambda p: p != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))
    glue = lambda a, b: F.concat(a, F.lit("\n\n"), b)

    def to_last(acc: Column) -> Column:
        done, held = acc["done"], acc["held"]
        appended = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(glue(F.try_element_at(done, F.lit(-1)), held)))
        return F.when(held == "", done).when(F.size(done) > 0, appended).otherwise(F.array(held))

    def step(acc: Column, p: Column) -> Column:
        done, held = acc["done"], acc["held"]
        joined = glue(held, p)
        state = lambda d, h: F.struct(d.alias("done"), h.alias("held"))
        return (
            F.when(p.startswith("```"), state(F.concat(to_last(acc), F.array(p)), F.lit("")))
            .when((held != "") & (F.length(joined) >= min_length), state(F.concat(done, F.array(joined)), F.lit("")))
            .when(held != "", state(done, joined))
            .when(F.length(p) < min_length, state(done, p))
            .otherwise(state(F.concat(done, F.array(p)), F.lit("")))
        )

    return F.when(F.size(pieces) == 1, pieces).otherwise(F.aggregate(pieces, start, step, to_last))


#: The beginnings of lists and of definitions.
LIST_ITEM, LIST_NUMBER = r"^\s*[-*]\s", r"^\s*\d+\.\s"
DEFINING = r"^[A-Z][\p{L}\p{N}_\s]{2,30}(?:is|refers to|means|describes|represents)\b"


def chunk_type(chunk: Column) -> Column:
    s = stripped(chunk)
    return (
        F.when(s.startswith("```"), "code")
        .when(s.rlike(LIST_ITEM) | s.rlike(LIST_NUMBER), "list")
        .when(s.rlike(DEFINING), "definition")
        .otherwise("prose")
    )


def chunk_turns(turns: DataFrame, min_length: int = 80) -> DataFrame:
    """(chunk_id, source_file, turn_index, chunk_index, chunk_type, content) of (source_file, idx, content)."""
    rows = turns.select("source_file", F.col("idx").alias("turn_index"), F.posexplode(chunk_pieces(stripped(F.col("content")), min_length)).alias("chunk_index", "content"))
    name = F.format_string("%s:t%d:c%d", F.col("source_file").cast("string"), F.col("turn_index"), F.col("chunk_index"))
    return rows.select(name.alias("chunk_id"), "source_file", "turn_index", "chunk_index", chunk_type(F.col("content")).alias("chunk_type"), "content")


#: Chunks of a file that are folded within a row.
FOLDED = 1000


def batch_chunks(chunks: DataFrame, max_chars: int = 6000) -> DataFrame:
    """(source_file, batch, chunk_ids, content): chunks in order, up to ``max_chars``, never across files.

    A batch begins where the running length would pass the limit; that resets. The chunks of a file of up to
    FOLDED chunks, of which only names and lengths are gathered, are folded in order; longer files are gone
    through by all tasks (``batch_numbers``), with the same result.
    """
    from .scans import batch_numbers

    item = F.struct("turn_index", "chunk_index", "chunk_id", "n")
    start = F.struct(F.array().cast("array<struct<chunk_id:string,batch:int>>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("used"))

    def step(acc: Column, c: Column) -> Column:
        full = (acc["used"] > 0) & (acc["used"] + c["n"] > max_chars)
        batch = acc["batch"] + full.cast("int")
        return F.struct(F.concat(acc["out"], F.array(F.struct(c["chunk_id"].alias("chunk_id"), batch.alias("batch")))).alias("out"), batch.alias("batch"), (F.when(full, 0).otherwise(acc["used"]) + c["n"]).alias("used"))

    lengths = chunks.select("source_file", "turn_index", "chunk_index", "chunk_id", F.length("content").alias("n"))
    sizes = lengths.groupBy("source_file").agg(F.count("*").alias("k"))
    listed = lengths.join(sizes.where(F.col("k") <= FOLDED).select("source_file"), "source_file", "left_semi").groupBy("source_file").agg(F.array_sort(F.collect_list(item)).alias("items"))
    dealt = listed.select(F.inline(F.aggregate("items", start, step, lambda a: a["out"])))
    long = sizes.where(F.col("k") > FOLDED).select("source_file")
    if long.head(1):
        dealt = dealt.unionByName(batch_numbers(lengths.join(long, "source_file", "left_semi"), max_chars))
    rows = chunks.join(dealt, "chunk_id").groupBy("source_file", "batch").agg(F.array_sort(F.collect_list(F.struct("turn_index", "chunk_index", "chunk_id", "content"))).alias("c"))
    return rows.select("source_file", "batch", F.transform("c", lambda x: x["chunk_id"]).alias("chunk_ids"), F.array_join(F.transform("c", lambda x: x["content"]), "\n\n").alias("content"))
