"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    Where that setting is absent (tests, notebooks) a temporary folder of this machine is set
    as the checkpoint folder, which is right for local masters only.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = context._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="thoughtloom-"))
        current = context._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and stored in the shared folder; Spark removes it when unused."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text, the hash that fixes the folds; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0))


def hash_order(column: str) -> Column:
    """A sort key that looks random but is the same in every run."""
    return F.xxhash64(F.lit("sample"), F.col(column))


def fresh(columns: Iterable[str], *stems: str) -> list[str]:
    """A working column name for each stem that no column of the table has, in whatever case."""
    taken, out = {c.lower() for c in columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of a sieve, of 64 marks each.
SIEVE_WORDS = 1 << 20


def sieve(hashes: DataFrame, column: str) -> DataFrame:
    """(word, bits): marks for the hashes in ``column``, at most SIEVE_WORDS rows however many there are."""
    word = F.expr(f"cast(pmod(shiftright(`{column}`, 6), {SIEVE_WORDS}) as int)")
    return hashes.groupBy(word.alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(`{column}` & 63 as int))")).alias("bits"))


def sifted(rows: DataFrame, column: str, marks: DataFrame, held: bool = True) -> DataFrame:
    """The rows whose hash in ``column`` may be among the marked ones; with ``held`` false, the others.

    The marks are broadcast: their number has a bound. A join that must be exact has less to move then.
    """
    word, bits = fresh(rows.columns, "sieve_word", "sieve_bits")
    named = F.broadcast(marks.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    joined = rows.join(named, F.expr(f"cast(pmod(shiftright(`{column}`, 6), {SIEVE_WORDS}) as int)") == F.col(word), "inner" if held else "left")
    hit = F.expr(f"coalesce(`{bits}` & shiftleft(1L, cast(`{column}` & 63 as int)), 0L) <> 0")
    return joined.where(hit if held else ~hit).drop(word, bits)
