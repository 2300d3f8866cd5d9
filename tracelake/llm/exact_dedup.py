"""Exact deduplication by a tree-merge of sorted digest runs.

Every input partition sorts the digests of its texts into one run and folds equal digests into an
entry (best identifier, the row that holds it, number of rows).  Runs then travel in binomial rounds: in
round r a partition keeps the entries whose r-th digest digit is its own and passes the others to the
partners that differ in that digit alone.  The receiver merges the sorted runs of its `radix` partners
and folds equal entries again.  After log_radix(P) rounds each partition holds one P-th of the digest
space, so no task ever sees more than its share of *distinct* digests, however many rows share one.

Defined results: null text counts as empty; texts are compared unchanged, verified by SHA-256, byte length and a
second hash at every level; of equal texts the row with the largest doc_id stays (a null doc_id
loses to any other); of rows that share that doc_id too, exactly one stays.  An empty table gives an
empty result; other columns are ignored by `classes` and carried unchanged by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import attach_groups, documents, drop_rows, fresh, shuffle_partitions, staged

_RUN = "slot int, sha binary, second long, n_bytes long, keep_id long, rows long, keep_row long"
_RUN_COLUMNS = [field.split()[0] for field in _RUN.split(", ")]
_SMALLEST, _LARGEST = -(1 << 63), (1 << 63) - 1


def _fold(sha: pa.Array, second, n_bytes, keep, rows, keep_row):
    """Fold neighbours with equal (sha, second, n_bytes) of one sorted run."""
    raw = np.frombuffer(b"".join(sha.to_pylist()), dtype="V32") if len(sha) else np.empty(0, "V32")
    new = np.ones(len(raw), bool)
    new[1:] = (raw[1:] != raw[:-1]) | (second[1:] != second[:-1]) | (n_bytes[1:] != n_bytes[:-1])
    start = np.flatnonzero(new)
    best = np.maximum.reduceat(keep, start)
    group = np.cumsum(new) - 1
    total = np.add.reduceat(rows, start)
    row = np.minimum.reduceat(np.where(keep == best[group], keep_row, _LARGEST), start)
    return start, best, total, row


def _merge_runs(slot_digit: int, radix: int, last: bool):
    """Merge a partition's sorted stream of entries and address each result for the next round."""

    def addressed(out):
        slots = _next_slot(out["slot"].to_numpy(), out["sha"], slot_digit, radix, last)
        return out.set_column(0, "slot", pa.array(slots, pa.int32())).to_batches()

    def merge(batches):
        carry = None
        for batch in batches:
            current = pa.Table.from_arrays(batch.columns, names=_RUN_COLUMNS)  # without nullability flags
            if carry is not None:
                current = pa.concat_tables([carry, current])
            if not current.num_rows:
                continue
            current = current.combine_chunks()
            cols = {n: current[n].to_numpy() for n in ("slot", "second", "n_bytes", "keep_id", "rows", "keep_row")}
            start, best, total, row = _fold(
                current["sha"].combine_chunks(), cols["second"], cols["n_bytes"], cols["keep_id"], cols["rows"], cols["keep_row"]
            )
            sha = current["sha"].take(pa.array(start))
            columns = [cols["slot"][start], sha, cols["second"][start], cols["n_bytes"][start], best, total, row]
            out = pa.Table.from_arrays([c if c is sha else pa.chunked_array([pa.array(c)]) for c in columns], names=_RUN_COLUMNS)
            carry = out.slice(out.num_rows - 1)  # may go on in the next batch
            yield from addressed(out.slice(0, out.num_rows - 1))
        if carry is not None:
            yield from addressed(carry)

    return merge


def _next_slot(slot: np.ndarray, sha, digit: int, radix: int, last: bool) -> np.ndarray:
    if last:
        return slot
    head = np.array([int.from_bytes(x[:6], "big") for x in sha.to_pylist()], np.int64)
    unit = radix**digit
    return (slot - (slot // unit % radix) * unit + (head // unit % radix) * unit).astype(np.int32)


def digests(docs: DataFrame) -> DataFrame:
    """One row per input row: a row number, doc_id and what identifies its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.xxhash64(text).alias("second"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )


def classes(digest_rows: DataFrame, radix: int = 4) -> DataFrame:
    """Tree-merge digest rows into one row per distinct text: sha, second, n_bytes, keep_id, rows, keep_row."""
    spark = digest_rows.sparkSession
    rounds, width = 1, radix
    while width < shuffle_partitions(spark):
        rounds, width = rounds + 1, width * radix
    order = ["sha", "second", "n_bytes"]
    runs = digest_rows.select(
        (F.spark_partition_id() % width).cast("int").alias("slot"),
        *order,
        F.coalesce("doc_id", F.lit(_SMALLEST)).alias("keep_id"),
        F.lit(1).cast("long").alias("rows"),
        F.col("row").alias("keep_row"),
    )
    runs = runs.sortWithinPartitions(*order).mapInArrow(_merge_runs(0, radix, False), _RUN)
    for r in range(rounds):
        runs = runs.repartitionById(width, F.col("slot")).sortWithinPartitions(*order)
        runs = runs.mapInArrow(_merge_runs(r + 1, radix, r == rounds - 1), _RUN)
    return runs.drop("slot")


def exact_dedup(docs: DataFrame, radix: int = 4) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = staged(digests(docs), "digests")
    merged = staged(classes(rows, radix), "digest-classes")
    total = merged.agg(F.sum("rows")).first()[0] or 0
    key = ["sha", "second", "n_bytes"]
    found = merged.withColumnRenamed("rows", "group_size")
    joined = attach_groups(rows, found, key, "group_size", total)
    return joined.select(
        "doc_id",
        F.when(F.col("keep_id") != _SMALLEST, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, radix: int = 4) -> DataFrame:
    """The documents that stay, with all their columns."""
    lost = staged(exact_dedup(docs, radix).where(~F.col("kept")), "lost-copies")
    same_id = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = lost.where(~same_id & F.col("doc_id").isNotNull()).select("doc_id", F.unhex("text_sha256").alias("sha")).distinct()
    digest = F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))
    left = drop_rows(docs, gone, "doc_id", digest, "sha")
    # left over: rows that repeat the id that stays, and copies without an id
    if lost.where(same_id | F.col("doc_id").isNull()).isEmpty():
        return left
    mark, best = fresh(left, "_digest"), fresh(left, "_named")
    named = lost.where(F.col("keep_id").isNotNull() & F.col("doc_id").isNull()).select(F.unhex("text_sha256").alias(best)).distinct()
    left = left.withColumn(mark, digest).dropDuplicates(["doc_id", mark])
    return left.join(named, F.col("doc_id").isNull() & (F.col(mark) == F.col(best)), "left_anti").drop(mark)


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup(documents(spark, sf_dir))


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """
}
