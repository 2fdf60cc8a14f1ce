"""Mixing sources to target weights: capped water-filling and seeded repetition."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, lean, sent

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, size): words of each whole text; a null text has none."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), n.alias("size"))


def water_fill(sources: DataFrame, share: float, cap: float) -> DataFrame:
    """Adds `target` to rows (source_size, weight): together share x all sizes, none above cap x its size.

    With caps in ascending order of cap / weight, the sources that clamp are a prefix: source k
    clamps if level k = (total - caps before k) / (weights from k on) lifts it to its cap or above,
    and the last level is that of the first source that doesn't. So repeated redistribution ends
    in the same place as one pass of running sums over the sources. If even all caps can't hold the
    total, every source stands at its cap.
    """
    total = float(sources.agg(F.sum("source_size")).first()[0] or 0) * share
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    ranked = sources.select(
        "*",
        (F.col("source_size") * float(cap)).alias("full"),
        F.coalesce(F.sum(F.col("source_size") * float(cap)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        F.row_number().over(order).alias("rank"),
    )
    level = ranked.withColumn("level", (F.lit(total) - F.col("before")) / F.col("left"))
    found = level.where(F.col("level") * F.col("weight") < F.col("full")).agg(F.min_by("level", "rank")).first()[0]
    lifted = F.col("full") if found is None else F.least("full", F.lit(found) * F.col("weight"))
    return level.select(*sources.columns, lifted.alias("target"))


def _first_fit(columns: list[str]):
    """Takes, in hash order, each row that fits what remains, and at last one more if that comes nearer."""

    def run(key, rows):
        rows = rows.sort_values(["h", "id", "size"], na_position="last")
        left = float(rows["remaining"].iloc[0])
        extra, spare = [False] * len(rows), -1
        for i, size in enumerate(rows["size"].tolist()):
            if size <= left:
                extra[i], left = True, left - size
        for i, size in enumerate(rows["size"].tolist()):
            if not extra[i] and size < 2 * left and (spare < 0 or abs(size - left) < abs(rows["size"].iat[spare] - left)):
                spare = i
        if spare >= 0:
            extra[spare] = True
        return rows.assign(extra=extra)[columns]

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 11, per_bucket: int = 1024) -> DataFrame:
    """One row per row of docs: id, size, source_size, target, taken and copies.

    Each source's target is met by whole repetitions of all its rows and one seeded fractional pass.
    The pass orders rows by a seeded hash of id, size and source, and takes them until the rest of
    the target is spent. To place that point without ordering a source in one task, hashes fall into buckets of
    about per_bucket rows: buckets before the point are taken by their sums, and only the bucket
    that holds it is decided row by row (first fit in hash order, then one row more if that comes
    nearer). The plan, a row for each source, is counted and broadcast, so rows stay where they are; only with more
    than FEW sources are they shuffled by source. Reruns agree. Null sources are one source, last in order; null texts have size 0.
    A source without a word has target 0 and takes nothing. Rows equal in id, source and size count apart.
    """
    lean(docs.sparkSession)
    rows = sizes(docs, id_col, text_col, source_col).withColumn("h", F.xxhash64(F.lit(seed), "id", "size", "source").bitwiseAND(F.lit((1 << 62) - 1)))
    rows = cut(rows.withColumn("part", F.shiftright("h", 62 - 20).cast("int")))
    # 2^20 hash parts; a source uses as many leading bits as its rows need.
    source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighted = cut(source.withColumn("weight", F.get(cycle, place % len(weights))))
    bits = F.least(F.lit(20), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / per_bucket)))).cast("int")
    targets = cut(water_fill(weighted, share, cap).select("source", "source_size", "target", bits.alias("bits"),
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("whole")))

    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("size"))
    t = sent(targets).select(F.col("source").alias("s"), "bits", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))
    bucket = F.expr("cast(part div shiftleft(1, 20 - bits) as int)")
    sums = parts.join(t, parts.source.eqNullSafe(t.s)).select("source", bucket.alias("bucket"), "size", "rest").groupBy("source", "bucket", "rest").agg(F.sum("size").alias("size"))
    up_to = F.sum("size").over(Window.partitionBy("source").orderBy("bucket"))
    sums = sums.withColumn("up_to", up_to).where((F.col("up_to") > F.col("rest")) & (F.col("rest") > 0))
    first = sums.groupBy("source").agg(F.min(F.struct("bucket", (F.col("rest") - (F.col("up_to") - F.col("size"))).alias("remaining"))).alias("x"))
    first = first.select(F.col("source").alias("s"), F.col("x.bucket").alias("edge"), F.col("x.remaining").alias("remaining"))
    plan = cut(targets.join(first, targets.source.eqNullSafe(first.s), "left").drop("s").withColumnRenamed("source", "s"))

    dealt = rows.join(sent(plan), rows.source.eqNullSafe(plan.s)).withColumn("bucket", bucket)
    dealt = dealt.select("id", "source", "size", "h", "source_size", "target", "whole", "bucket", "edge", "remaining")
    columns = ["id", "size", "source_size", "target", "whole", "extra"]
    sure = dealt.where("edge is null or bucket <> edge").withColumn("extra", F.col("edge").isNotNull() & (F.col("bucket") < F.col("edge"))).select(*columns)
    fields = "id long, size long, source_size long, target double, whole long, extra boolean"
    fit = dealt.where("bucket = edge").groupBy("source").applyInPandas(_first_fit(columns), fields)
    copies = F.col("whole") + F.col("extra").cast("long")
    return sure.unionByName(fit).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies")
    )


def mixture_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the mixture is fixed without a seed: sizes, and the target of each document's source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target")


TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER o AS rank, coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM s WINDOW o AS (ORDER BY source_size / weight, weight, source NULLS LAST)),
l AS (SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - before) / rest AS level FROM r),
f AS (SELECT min_by(level, rank) AS level FROM l WHERE level * weight < source_size * 2.0::DOUBLE)
SELECT d.doc_id, d.size, s.source_size, CASE WHEN f.level IS NULL THEN s.source_size * 2.0::DOUBLE ELSE least(s.source_size * 2.0::DOUBLE, f.level * s.weight) END AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source CROSS JOIN f
"""


def op7_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mixture takes each document; nulls, ties and repeated rows as mix() has them."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
