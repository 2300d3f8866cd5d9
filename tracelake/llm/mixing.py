"""Mixing sources to target weights by Pareto order sampling.

Targets: all words are shared out by source weight (5, 2, 1 repeating over the sources by code point, null
last); a target stops at MAX_REPEAT times its source's words and the excess is shared again by weight
(solved in closed form on the sources sorted by words per weight).

Documents: the expected copies of document i of a source with repeat rate r = target / words are
e_i = r + min(r, 3 - r) / 2 * g_i, where g_i in [-1, 1] rises with its length and is centred so that
the e_i give the target exactly.  floor(e_i) copies are certain.  The rest p_i = e_i - floor(e_i) is an inclusion
probability: documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a hash of doc_id, and taken in
that order until the source's missing words are met as nearly as whole documents allow.  The size that is fixed is
that of the sample in words, as the targets are in words: the number of documents varies with their lengths,
and inclusion probabilities are met as closely as Pareto sampling meets them, up to that last document.

Scale: no window spans a source.  The rank is cut in 4096 buckets of 4096 cells each; the cells' word sums are
pre-aggregated in one pass, and only the documents of the one crossing cell of a source are put in exact order.

Defined results: null text has size 0 and is never sampled (taken 0); a null source is a source of
its own, the last; ties of the random rank go by doc_id, then by a hash of the text; repeated rows are
separate documents with the same fate unless the cut falls between them; a null doc_id is drawn by its text; an empty table gives an
empty result; extra columns do not matter.  Native DataFrame code throughout; reruns agree, as all sums
are of integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import documents, fresh, staged

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BUCKETS = 4096
BROADCAST_SOURCES = 10_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), tie (hash of the text), name (its MD5 where doc_id is null)."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text).alias("tie"),
        F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("name"),
    )


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source, source_size, n_docs, target.  The windows run over sources, already aggregated."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    wide = T.DecimalType(28, 0)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight.cast("long"))
    every = Window.partitionBy()
    # fullest first: smallest words per weight, compared exactly as a rational by cross-multiplied parts
    common = 1
    for w in weights:
        common = common * w
    order = F.col("source_size") * F.element_at(
        F.create_map(*[F.lit(x) for w in sorted(set(weights)) for x in (int(w), common // int(w))]), F.col("weight").cast("int")
    )
    upto = Window.orderBy(order, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    per = (
        per.withColumn("words", F.sum("source_size").over(every))
        .withColumn("weights", F.sum("weight").over(every))
        .withColumn("_size", F.sum("source_size").over(upto))
        .withColumn("_weight", F.sum("weight").over(upto))
    )
    # a source is full if, with all before it full, its own fair share is over its limit
    before_size, before_weight = F.col("_size") - F.col("source_size"), F.col("_weight") - F.col("weight")
    left, open_weight = F.col("words") - max_repeat * before_size, F.col("weights") - before_weight
    full = left.cast(wide) * F.col("weight") >= (max_repeat * F.col("source_size")).cast(wide) * open_weight
    per = per.withColumn("full", full)
    full_size = F.sum(F.when(F.col("full"), F.col("source_size")).otherwise(0)).over(every)
    full_weight = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every)
    share = (F.col("words") - max_repeat * F.col("_fs")).cast("double") * F.col("weight").cast("double") / (
        F.col("weights") - F.col("_fw")
    ).cast("double")
    per = per.withColumn("_fs", full_size).withColumn("_fw", full_weight)
    target = F.when(F.col("full"), (max_repeat * F.col("source_size")).cast("double")).otherwise(share)
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _uniform():
    """A uniform number in (0, 1) from doc_id alone (without one from the text's hash)."""
    own = F.coalesce(F.col("doc_id").cast("string"), F.col("name"))
    bits = F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10)
    return (bits.cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def _cut(sums: DataFrame, level: str) -> DataFrame:
    """Per source the first bucket of `level` with which the missing words are exceeded, and the words taken before it.

    sums: skey, level, n (words of the bucket), missing, base (words taken before the first bucket)."""
    upto = Window.partitionBy("skey").orderBy(level).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = sums.withColumn("after", F.col("base") + F.sum("n").over(upto)).where("after > missing")
    return after.groupBy("skey").agg(F.min_by(F.struct(F.col(level).alias("at"), (F.col("after") - F.col("n")).alias("before")), level).alias("c"))


def _cuts(rows: DataFrame) -> DataFrame:
    """Per source (skey) what is missing after the certain copies, and where the cut lies: c1, before1, c2, before2 (null: nowhere).

    One aggregation of the rows by cells of both levels; all that follows is at most BUCKETS rows a source."""
    drawn = F.col("rank").isNotNull() & (F.col("size") > 0)
    cells = rows.groupBy("skey", F.when(drawn, F.col("b1")).alias("b1"), F.when(drawn, F.col("b2")).alias("b2"))
    cells = staged(cells.agg(F.sum("size").alias("n"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target")), "mix-cells")
    missing = cells.groupBy("skey").agg((F.first("target") - F.sum("sure")).alias("missing"))
    first = cells.where("b1 is not null").groupBy("skey", "b1").agg(F.sum("n").alias("n")).join(missing, "skey").withColumn("base", F.lit(0).cast("long"))
    one = _cut(first, "b1").select("skey", F.col("c.at").alias("c1"), F.col("c.before").alias("before1"))
    second = cells.join(one, "skey").where("b1 = c1").select("skey", "b2", "n", F.col("before1").alias("base")).join(missing, "skey")
    two = _cut(second, "b2").select("skey", F.col("c.at").alias("c2"), F.col("c.before").alias("before2"))
    return staged(missing.join(one, "skey", "left").join(two, "skey", "left"), "mix-cuts")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, carry_tie: bool = False) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes), copies."""
    sized = staged(sizes(docs).withColumn("skey", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))), "mix-sizes")
    sized = sized.withColumn("skey", F.to_json("skey"))
    targets = source_targets(sized, weights, max_repeat)
    targets = staged(targets.withColumn("skey", F.to_json(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))).drop("source"), "mix-sources")
    # per-source tables are broadcast while there are few sources; with many, joins by source may split a hot one (AQE)
    per_source = F.broadcast if targets.count() <= BROADCAST_SOURCES else lambda df: df
    rows = sized.join(per_source(targets), "skey")
    # length score in 1024ths: size / (size + mean size), kept as an integer so that sums agree in any order
    # division is by integers, exact
    wide = "cast(size as decimal(20, 0)) * cast(n_docs as decimal(18, 0))"  # a long text in a large source is beyond a long
    score = F.expr(f"case when size = 0 then 0L else (1024 * ({wide})) div ({wide} + source_size) end")
    rows = rows.withColumn("score", score)
    centre = rows.groupBy("skey").agg(F.sum(F.col("score") * F.col("size")).alias("score_sum"))
    rows = rows.join(per_source(centre), "skey")
    rate = F.col("target") / F.col("source_size").cast("double")
    lean = F.least(rate, F.lit(float(max_repeat)) - rate) * F.lit(0.5)
    gap = F.col("score").cast("double") - F.col("score_sum").cast("double") / F.col("source_size").cast("double")
    expected = F.when(F.col("size") > 0, rate + lean * gap / F.lit(1024.0)).otherwise(F.lit(0.0))
    rows = rows.withColumn("expected", F.greatest(F.lit(0.0), F.least(expected, F.lit(float(max_repeat)))))
    rows = rows.withColumn("certain", F.floor("expected").cast("long"))
    chance = F.col("expected") - F.col("certain").cast("double")
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("u", _uniform()).withColumn("p", chance)
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, odds / (1 + odds)))
    rows = rows.withColumn("b1", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    inner = F.col("rank") * BUCKETS - F.col("b1")
    rows = rows.withColumn("b2", F.least(F.floor(inner * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    rows = staged(rows.select("doc_id", "skey", "size", "source_size", "target", "certain", "rank", "b1", "b2", "tie"), "mix-ranked")

    rows = rows.join(per_source(_cuts(rows)), "skey")
    keep = ["doc_id", "size", "source_size", "target", "certain", "tie"]
    drawn = F.col("rank").isNotNull() & (F.col("size") > 0)
    here = (F.col("b1") == F.col("c1")) & (F.col("before1") < F.col("missing"))
    inside = F.coalesce(drawn & here & (F.col("b2") == F.col("c2")) & (F.col("before2") < F.col("missing")), F.lit(False))
    whole = F.coalesce(drawn & (F.col("c1").isNull() | (F.col("b1") < F.col("c1")) | (here & (F.col("b2") < F.col("c2")))), F.lit(False))
    order = Window.partitionBy("skey").orderBy("rank", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = rows.where(inside).withColumn("upto", F.col("before2") + F.sum("size").over(order))
    last = last.withColumn("whole", 2 * F.col("upto") - F.col("size") < 2 * F.col("missing"))
    out = rows.where(~inside).select(*keep, whole.alias("whole")).unionByName(last.select(*keep, "whole"))
    copies = F.least(F.col("certain") + F.col("whole").cast("long"), F.lit(max_repeat).cast("long"))
    out = out.withColumn("copies", copies)
    out = out.withColumn("taken", F.col("copies") * F.col("size"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", *(["tie"] if carry_tie else []))


def sample(docs: DataFrame) -> DataFrame:
    """The mix itself: the documents that are taken, with their columns and size, source_size, target, taken, copies.

    Each stands for `copies` copies.  Rows that repeat a doc_id and its text share one decision, the larger."""
    made = ["size", "source_size", "target", "taken", "copies"]
    key, mark, own = fresh(docs, "_mix_id"), fresh(docs, "_mix_mark"), fresh(docs, "_mix_own")
    taken = mix(docs, carry_tie=True).where("copies > 0").groupBy(F.col("doc_id").alias(key), F.col("tie").alias(mark))
    taken = taken.agg(*[F.max(c).alias(c) for c in made])
    rows = docs.drop(*made).withColumn(own, F.xxhash64(F.col("text").cast("string")))
    return rows.join(taken, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(own) == F.col(mark))).drop(key, mark, own)


def op2_mix(spark, sf_dir):
    return mix(documents(spark, sf_dir))


QUERIES = {"op2_mix": op2_mix}
ORACLE_SQL = {
    "op2_mix": r"""
        WITH d AS (
          SELECT doc_id, source, coalesce(source, '') AS s, source IS NULL AS sn, text,
                 coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                 ((('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM documents),
        per AS (
          SELECT s, sn, sum(size)::BIGINT AS source_size, count(*) AS n_docs,
                 [5, 2, 1][1 + (row_number() OVER (ORDER BY sn, s) - 1) % 3] AS weight
          FROM d GROUP BY s, sn),
        cum AS (
          SELECT *, sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights,
                 sum(source_size) OVER o::BIGINT AS usize, sum(weight) OVER o::BIGINT AS uweight
          FROM per WINDOW o AS (ORDER BY source_size * (10 // weight), sn, s ROWS UNBOUNDED PRECEDING)),
        fulls AS (
          SELECT *, (words - 3 * (usize - source_size))::HUGEINT * weight
                    >= 3 * source_size::HUGEINT * (weights - (uweight - weight)) AS isfull FROM cum),
        tot AS (
          SELECT *, sum(CASE WHEN isfull THEN source_size ELSE 0 END) OVER ()::BIGINT AS fs,
                 sum(CASE WHEN isfull THEN weight ELSE 0 END) OVER ()::BIGINT AS fw FROM fulls),
        tar AS (
          SELECT s, sn, source_size, n_docs, CASE WHEN isfull THEN (3 * source_size)::DOUBLE
                 ELSE (words - 3 * fs)::DOUBLE * weight::DOUBLE / (weights - fw)::DOUBLE END AS target FROM tot),
        sc AS (
          SELECT d.*, source_size, n_docs, target,
                 CASE WHEN size = 0 THEN 0 ELSE ((1024 * size::HUGEINT * n_docs) // (size::HUGEINT * n_docs + source_size))::BIGINT END AS score
          FROM d JOIN tar USING (s, sn)),
        ex AS (
          SELECT *, target / source_size::DOUBLE AS r,
                 score::DOUBLE - (sum(score * size) OVER (PARTITION BY s, sn))::DOUBLE / source_size::DOUBLE AS gap FROM sc),
        ce AS (
          SELECT *, greatest(0.0::DOUBLE, least(3.0::DOUBLE, CASE WHEN size > 0
                 THEN r + least(r, 3.0::DOUBLE - r) * 0.5::DOUBLE * gap / 1024.0::DOUBLE ELSE 0.0::DOUBLE END)) AS e FROM ex),
        pa AS (SELECT *, floor(e)::BIGINT AS certain, e - floor(e) AS p FROM ce),
        ra AS (
          SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
                 target - sum(certain * size) OVER (PARTITION BY s, sn)::DOUBLE AS missing FROM pa),
        cut AS (
          SELECT *, sum(size) OVER (PARTITION BY s, sn ORDER BY q / (1 + q), doc_id ROWS UNBOUNDED PRECEDING) AS upto
          FROM ra WHERE p > 0 AND size > 0),
        cop AS (
          SELECT doc_id, size, source_size, target,
                 least(3, certain + CASE WHEN 2 * upto - size < 2 * missing THEN 1 ELSE 0 END) AS copies FROM cut
          UNION ALL
          SELECT doc_id, size, source_size, target, certain FROM ra WHERE NOT (p > 0 AND size > 0))
        SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::BIGINT AS copies FROM cop
    """
}
