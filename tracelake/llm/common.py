"""Helpers shared by the corpus operators: written intermediate tables, table access, hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelake.sources import staging


def staged(df: DataFrame, label: str, free: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.  free: its shuffle files go at once."""
    small_batches(df.sparkSession)
    return staging.staged(df, label, free)


#: Rows of an Arrow batch: texts are long, and a batch is held several times over.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches have at most BATCH_ROWS rows."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a corpus folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a corpus folder, dealt over all cores where the files give fewer partitions than there are cores (one
    small file is one row group, which one task would read)."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs._jdf.rdd().getNumPartitions() < cores else docs


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z only, whatever the locale or script."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(column: Column) -> Column:
    """True where crc32 of the id as text leaves remainder 2 modulo 4."""
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A group is attached by broadcast if it is above HOT_SHARE of all rows or has HOT_ROWS rows (what one task takes well),
#: but never more than MOST_HOT groups are: a group has to hold a MOST_HOT-th of all rows at least.
HOT_SHARE, HOT_ROWS, MOST_HOT = 0.001, 100_000, 100_000


def hot_size(total: int) -> int:
    """Groups of more rows than this are hot."""
    return max(1, total // MOST_HOT, min(int(total * HOT_SHARE), HOT_ROWS))


def attach_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """Inner join of rows with their groups (one row per key, `size` rows each, `total` in all).

    The rows of hot groups stay where they are; only the rest is shuffled by key."""
    hot = F.col(size) > hot_size(total)
    marked = rows.join(F.broadcast(groups.where(hot)), key, "left")  # at most MOST_HOT groups
    done = marked.where(F.col(size).isNotNull())
    rest = marked.where(F.col(size).isNull()).select(rows.columns).join(groups.where(~hot), key)
    return done.unionByName(rest)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def drop_rows(docs: DataFrame, ids: DataFrame, id_column: str, same: Column | None = None, other: str | None = None) -> DataFrame:
    """docs without the rows whose doc_id is in ids[id_column] (and whose `same` equals ids[other]); all columns stay.

    Only rows that may be hit, by a filter of bounded size, are shuffled."""
    gone_id, gone_other = fresh(docs, "_gone_id"), fresh(docs, "_gone_other")
    gone = ids.select(F.col(id_column).alias(gone_id), *([F.col(other).alias(gone_other)] if other else []))
    maybe, sure = split_by(docs, "doc_id", gone, gone_id)
    hit = F.col("doc_id") == F.col(gone_id)
    return sure.unionByName(maybe.join(gone, hit & (same == F.col(gone_other)) if other else hit, "left_anti"))


#: Bits of the row filter for each id, and the bounds of its size in 64-bit words (the largest is 32 MB to broadcast); words of a row of it.
FILTER_BITS, LEAST_WORDS, MOST_WORDS, LINE = 8, 1 << 10, 1 << 22, 64


def filter_words(ids: int) -> int:
    """64-bit words of the row filter for so many ids."""
    return max(LEAST_WORDS, min(MOST_WORDS, 1 << (ids * FILTER_BITS // 64).bit_length()))


def passes(ids: int) -> float:
    """The share of other rows that a filter for so many ids lets through, about."""
    return 1 - math.exp(-ids / (64 * filter_words(ids)))


def split_by(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose id may be among the ids, and those whose id surely is not; a null id surely is not.

    A one-hash Bloom filter, sized by the number of ids within bounds, is broadcast; false hits are left to an exact join."""
    size = filter_words(ids.count())

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(size * 64))

    bits = F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))")
    line, held = fresh(rows, "_line"), fresh(rows, "_words")
    words = ids.where(F.col(id_column).isNotNull()).select(place(F.col(id_column).cast("long")).alias("place"))
    words = words.groupBy((F.col("place") / 64).cast("long").alias("word")).agg(bits.alias("bits"))
    lines = words.groupBy((F.col("word") / LINE).cast("long").alias(line)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("word") % LINE, "bits"))).alias("m"))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(LINE - 1).cast("long")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    lines = staged(lines.select(line, full.alias(held)), "row-filter")  # MOST_WORDS / LINE rows at most
    at = place(F.col(column).cast("long"))
    marked = rows.join(F.broadcast(lines), (at / (64 * LINE)).cast("long") == lines[line], "left")
    word = F.element_at(held, ((at / 64).cast("long") % LINE + 1).cast("int"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    hit = F.coalesce(word.bitwiseAND(bit) != 0, F.lit(False))
    own = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where(hit).select(*own), marked.where(~hit).select(*own)


def maybe_in(rows: DataFrame, column: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows whose id may be among the ids."""
    return split_by(rows, column, ids, id_column)[0]
