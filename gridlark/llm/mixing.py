"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source of S words with target T gives every document ``floor(T/S)`` certain whole copies. The words still missing
are drawn without replacement and with probability proportional to size, as if words were drawn and their documents
taken: a document of the size class g (a power of two) has inclusion probability ``p = min(1, c * 2**g)``, with the c
at which the expected words are the missing ones. Those with p = 1 are certain. With a random number u the others'
rank is ``(u/(1-u)) / (p/(1-p))``, and the documents of least rank are taken until the missing words are reached, to
within half of the last document: the sample's size in words is fixed.

The cut rank of a source is found from sums over rank buckets, refined once; only the rows of the one bucket that
holds the cut are ordered, equal rows as one. Whether a row is taken then follows from its own rank and one row of
its source's figures, so texts are neither sorted nor joined by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 1024
SEED = "mix-1"


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(id_col: F.Column, text: F.Column, seed: str = SEED) -> F.Column:
    """A number in (0, 1) from the first 52 bits of md5; equal ids with equal texts have equal numbers, nulls count as empty strings."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``source, source_size`` (one row a source) to those and ``target``.

    Sources in code point order, null last, weigh as listed, again and again. Targets share the total size by weight;
    none is above ``most`` times its source's size, and the excess goes to the others by weight. The level at which
    the others stand follows from the sources in order of size by weight: the first ones are at their limit.
    """
    name = Window.orderBy(F.col("source").asc_nulls_last())
    order = Window.orderBy("limit_by_weight", F.col("source").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(name) - 1, F.lit(len(weights))).cast("int") + 1))
    levelled = (
        weighted.withColumn("limit_by_weight", most * F.col("source_size") / F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward))
        .withColumn("free", F.col("limit_by_weight") > F.col("level"))
        .withColumn("free_level", F.min(F.when(F.col("free"), F.struct("limit_by_weight", "source", "level"))).over(everything)["level"])
    )
    target = F.when((F.col("free_level").isNull()) | (F.col("limit_by_weight") <= F.col("free_level")), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.col("free_level"))
    return levelled.select("source", "source_size", target.alias("target"))


def class_slopes(classes: DataFrame) -> DataFrame:
    """``source, c, certain`` from ``source, g, words, missing`` (one row for each size class, at most 64 a source).

    From the largest class on, a class is certain as long as the c of it and the smaller ones would give it more than
    1. ``certain``: words of the classes with p = 1.
    """
    order = Window.partitionBy("source").orderBy(F.desc("g"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    power = F.pow(F.lit(2.0), F.col("g"))
    weighted = F.sum((power.cast("decimal(20,0)") * F.col("words").cast("decimal(18,0)")).cast("decimal(38,0)")).over(onward).cast("double")
    slopes = classes.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("c", (F.col("missing") - F.col("before")) / weighted)
    best = slopes.groupBy("source").agg(F.max(F.when(F.col("c") * power <= 1, F.struct("g", "c")))["c"].alias("c"), F.collect_list(F.struct("g", "words")).alias("all"))
    certain = F.aggregate("all", F.lit(0).cast("long"), lambda acc, k: acc + F.when(F.coalesce(F.col("c") * F.pow(F.lit(2.0), k["g"]) >= 1, F.lit(True)), k["words"]).otherwise(0))
    return best.select("source", "c", certain.alias("certain"))


def size_class(size: F.Column) -> F.Column:
    """Exponent of the largest power of two that isn't above a size of 1 or more."""
    return F.length(F.bin(size)) - 1


def _ranked(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (``source, size, u`` and more) beside the figures of their source, with ``p`` and ``rank`` (null unless 0 < p < 1)."""
    joined = rows.join(plan.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    p = F.when((F.col("size") == 0) | (F.col("missing") <= 0), 0.0).otherwise(F.least(F.coalesce(F.col("c") * F.pow(F.lit(2.0), size_class(F.col("size"))), F.lit(1.0)), F.lit(1.0)))
    rank = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return joined.withColumn("p", p).withColumn("rank", F.when((F.col("p") > 0) & (F.col("p") < 1), rank))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """One row for each source of ``sized`` (``source, size, u``): ``source, source_size, target, whole, missing, c`` and where the draw ends.

    A row of rank below ``cut_rank``, or of that rank and size below ``cut_size``, is taken; of the ``tied`` rows with
    both ``tied_taken`` are. Nulls there: nothing is drawn.
    """
    classes = materialise(sized.groupBy("source", F.when(F.col("size") > 0, size_class(F.col("size"))).alias("g")).agg(F.sum("size").alias("words")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))))
    targets = targets.withColumn("whole", F.least(whole, F.lit(most)).cast("int")).withColumn("missing", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    per_class = classes.filter("g is not null").join(targets.select(F.col("source").alias("of"), "missing"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    slopes = class_slopes(per_class).withColumnRenamed("source", "of")
    plan = materialise(targets.join(slopes, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-targets")

    live = _ranked(sized, plan).filter("rank is not null").withColumn("open", F.col("missing") - F.col("certain")).withColumn("place", F.col("rank") / (1 + F.col("rank")))
    live = live.select("source", "size", "rank", "open", F.floor(F.col("place") * BUCKETS).alias("b1"), F.pmod(F.floor(F.col("place") * BUCKETS * BUCKETS), F.lit(BUCKETS)).alias("b2"))
    live = materialise(live, "mix-ranked")

    def cut(rows: DataFrame, bucket: str, base: F.Column) -> DataFrame:
        """The bucket of each source in which the open words are reached, and the words below it."""
        w = Window.partitionBy("source").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("n"), F.first("open").alias("open"), F.first(base).alias("base"))
        sums = sums.withColumn("upto", F.col("base") + F.sum("n").over(w))
        # no bucket reaches them by a rounding error: the last one holds the cut
        found = F.min(F.when(F.col("upto") >= F.col("open"), F.struct(F.col(bucket), (F.col("upto") - F.col("n")).alias("base"))))
        last = F.max(F.struct(F.col(bucket), (F.col("upto") - F.col("n")).alias("base")))
        return sums.groupBy("source").agg(F.coalesce(found, last).alias("c")).select(F.col("source").alias("of"), F.col(f"c.{bucket}").alias(f"cut_{bucket}"), F.col("c.base").alias(f"base_{bucket}"))

    first = materialise(cut(live, "b1", F.lit(0)), "mix-cut")
    at_first = live.join(first, F.col("source").eqNullSafe(F.col("of"))).drop("of").filter("b1 = cut_b1")
    second = materialise(cut(at_first, "b2", F.col("base_b1")), "mix-cut")
    edge = at_first.join(second, F.col("source").eqNullSafe(F.col("of"))).drop("of").filter("b2 = cut_b2")
    edge = edge.groupBy("source", "rank", "size").agg(F.count("*").alias("tied"), F.first("open").alias("open"), F.first("base_b2").alias("base"))
    before = Window.partitionBy("source").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum(F.col("tied") * F.col("size")).over(before), F.lit(0))
    edge = edge.withColumn("tied_taken", F.least(F.col("tied"), F.floor((F.col("open") - start) / F.col("size") + 0.5)))
    # ranks below this one are taken whole even if no row of the cell is
    ends = edge.withColumn("key", F.struct(F.col("rank").alias("cut_rank"), F.col("size").alias("cut_size"), F.col("tied"), F.greatest("tied_taken", F.lit(0)).alias("tied_taken")))
    ends = ends.groupBy("source").agg(F.coalesce(F.max(F.when(F.col("tied_taken") > 0, F.col("key"))), F.min("key")).alias("key")).select(F.col("source").alias("of"), "key.*")
    return materialise(plan.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mix-plan")


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``copies``, and their source's figures. ``rows``: ``source, size, u`` and more."""
    rank, size = F.col("rank"), F.col("size")
    below = (rank < F.col("cut_rank")) | ((rank == F.col("cut_rank")) & (size < F.col("cut_size")))
    tie = (rank == F.col("cut_rank")) & (size == F.col("cut_size"))
    extra = F.when(F.col("p") >= 1, 1).when(rank.isNull(), 0).when(below, 1).when(tie & (F.col("tied_taken") >= F.col("tied")), 1).when(tie & (F.col("tied_taken") > 0), None).otherwise(0)
    placed = _ranked(rows, plan).withColumn("extra", extra)
    if not plan.filter("tied_taken > 0 and tied_taken < tied").isEmpty():
        # equal rows at the cut of a source: the first ones are taken, counted over the partitions they lie in
        tied = materialise(placed.filter("extra is null"), "mix-tied").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33))
        counts = tied.groupBy("source", "part").agg(F.count("*").alias("n"))
        counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        tied = tied.withColumn("number", F.row_number().over(Window.partitionBy("source", "part").orderBy("at")))
        tied = tied.join(counts.select(F.col("source").alias("of"), F.col("part").alias("of_part"), "base"), F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")))
        tied = tied.withColumn("extra", (F.col("base") + F.col("number") <= F.col("tied_taken")).cast("int"))
        placed = placed.filter("extra is not null").unionByName(tied.select(placed.columns))
    return placed.withColumn("copies", F.col("whole") + F.col("extra"))


def _sized(docs: DataFrame, carried: F.Column, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    return docs.select(carried, F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), unit_hash(F.col(id_col), F.col(text_col), seed).alias("u"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """How often each document is taken: ``<id_col>, size, source, source_size, target, copies``, one row for each row of ``docs``.

    Null and empty texts have size 0 (their ``copies`` count for nothing). A null source is a source. Ids may be null
    or repeated and of any type that casts to a string. Rows with equal ids and texts share their random number; if
    the cut falls among them, as many as are needed are taken. Sources without words have target 0. An empty table
    gives an empty result. Other columns are not carried.
    """
    sized = materialise(_sized(docs, F.col(id_col).alias("id"), id_col, text_col, source_col, seed), "mix-sizes")
    return with_copies(sized, mix_plan(sized, weights, most)).select(F.col("id").alias(id_col), "size", "source", "source_size", "target", "copies")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken; columns, whatever their names, stay as they are.

    Nulls, repeated rows and empty tables as in :func:`mix`; rows without words are not taken.
    """
    sized = materialise(_sized(docs, F.lit(0).alias("row"), id_col, text_col, source_col, seed).drop("row"), "mix-sizes")
    rows = _sized(docs, F.struct("*").alias("row"), id_col, text_col, source_col, seed)
    taken = with_copies(rows, mix_plan(sized, weights, most)).filter("copies > 0 and size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: what the mix takes of every document."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def oracle(id_sql: str = "doc_id", docs: str = "documents", seed: str = SEED) -> str:
    """DuckDB SQL for :func:`query`: the cut by one running sum over each source."""
    return f"""
WITH sized AS (
  SELECT {id_sql} AS id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('{seed}:' || coalesce({id_sql}::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM {docs}),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sources),
limited AS (SELECT *, 3 * source_size / weight AS limit_by_weight FROM weighted),
levelled AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY limit_by_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY limit_by_weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM limited),
free AS (SELECT level AS free_level FROM levelled WHERE limit_by_weight > level ORDER BY limit_by_weight, source NULLS LAST LIMIT 1),
targets AS (SELECT source, source_size, CASE WHEN free_level IS NULL OR limit_by_weight <= free_level THEN (3 * source_size)::DOUBLE ELSE weight * free_level END AS target
            FROM levelled LEFT JOIN free ON true),
plan AS (SELECT *, greatest(0.0, target - whole * source_size) AS missing
         FROM (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS whole FROM targets)),
classes AS (SELECT s.source, length(bin(size)) - 1 AS g, sum(size)::HUGEINT AS words, any_value(missing) AS missing
            FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source WHERE size > 0 GROUP BY s.source, g),
slopes AS (
  SELECT *, (missing - coalesce(sum(words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum((2 ** g)::HUGEINT * words) OVER (PARTITION BY source ORDER BY g DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS c FROM classes),
slope AS (SELECT source, max(c) FILTER (WHERE g = top) AS c FROM (SELECT *, max(g) FILTER (WHERE c * 2 ** g <= 1) OVER (PARTITION BY source) AS top FROM slopes) GROUP BY source),
certain AS (SELECT k.source, any_value(s.c) AS c, coalesce(sum(words) FILTER (WHERE coalesce(s.c * 2 ** k.g >= 1, true)), 0) AS certain
            FROM classes k JOIN slope s ON k.source IS NOT DISTINCT FROM s.source GROUP BY k.source),
drawn AS (SELECT s.*, p.source_size, p.target, p.whole, p.missing - coalesce(c.certain, 0) AS open,
                 CASE WHEN size = 0 OR missing <= 0 THEN 0.0 ELSE least(coalesce(c.c * 2 ** (length(bin(size)) - 1), 1.0), 1.0) END AS p
          FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN certain c ON s.source IS NOT DISTINCT FROM c.source),
summed AS (SELECT *, sum(CASE WHEN p > 0 AND p < 1 THEN size ELSE 0 END) OVER (PARTITION BY source
             ORDER BY CASE WHEN p > 0 AND p < 1 THEN (u / (1 - u)) / (p / (1 - p)) END NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM drawn)
SELECT id AS {id_sql}, size, source_size, target,
       (size * (whole + CASE WHEN p >= 1 OR (p > 0 AND upto - size / 2 <= open) THEN 1 ELSE 0 END))::BIGINT AS taken FROM summed"""
