"""Exact percentiles of groups of any size, by refined parts of their values: no group's values come together in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

#: Parts of about equal size that a range is cut into in a pass, and values of a range that are sorted directly.
PARTS, DIRECT = 32, 2_048


def _wanted(sizes: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """Ranks (from 0) that the levels of each group interpolate between, as ``level, side, place``."""
    at = F.col("level") * (F.col("n") - 1)
    rows = sizes.withColumn("level", F.explode(F.array(*[F.lit(float(p)) for p in levels])))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("place")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("place")))
    return rows.withColumn("s", F.explode(sides)).select("*", "s.*").drop("s")


def exact_percentiles(rows: DataFrame, by: list[str], value: str, levels: tuple[float, ...], parts: int = PARTS, direct: int = DIRECT) -> DataFrame:
    """``by, level, percentile``: linearly interpolated percentiles of the non-NULL values of each group.

    A pass cuts each range that a wanted rank lies in at approximate percentiles, counts the parts exactly and keeps of
    a rank only its part, with the least and the largest value that are really there; so ranges hold ever fewer values
    however these are spread. Values equal to a cut are a part of their own. A part of at most ``direct`` values is
    sorted. Groups without values give no row. ``rows`` is read twice a pass: write what is costly to work out.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("v*")).filter(F.col("v*").isNotNull() & ~F.isnan("v*"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v*").alias("lo"), F.max("v*").alias("hi"))
    todo = materialise(_wanted(sizes, levels).select(*by, "level", "side", "place", "n", "lo", "hi", F.lit(0).cast("long").alias("before")), "ranks")
    keys, found = [*by, "lo", "hi"], None
    same = lambda a, b: [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "lo", "hi")]  # noqa: E731, ARG005

    def collect(part: DataFrame) -> None:
        nonlocal found
        found = part if found is None else found.unionByName(part)

    while True:
        collect(todo.filter("lo = hi").select(*by, "level", "side", F.col("lo").alias("value")))
        small = todo.filter(f"lo < hi and n <= {direct}")
        ranges = small.select(*keys).distinct()
        sorted_ = _in_ranges(rows, ranges, by).groupBy(*keys).agg(F.array_sort(F.collect_list("v*")).alias("values"))
        got = small.alias("a").join(sorted_.alias("b"), same("a", "b")).select(*[F.col(f"a.{c}").alias(c) for c in (*by, "level", "side")], F.get("b.values", (F.col("a.place") - F.col("a.before")).cast("int")).alias("value"))
        collect(got)
        large = todo.filter(f"lo < hi and n > {direct}")
        if large.isEmpty():
            break
        inside = _in_ranges(rows, large.select(*keys).distinct(), by)
        cuts = inside.groupBy(*keys).agg(F.percentile_approx("v*", [k / parts for k in range(1, parts)], 20 * parts).alias("cuts"))
        inside = inside.alias("a").join(cuts.alias("b"), same("a", "b")).select("a.*", "b.cuts")
        steps = [(F.col("v*") > F.get("cuts", F.lit(k))).cast("int") + (F.col("v*") >= F.get("cuts", F.lit(k))).cast("int") for k in range(parts - 1)]
        counts = inside.groupBy(*keys, sum(steps[1:], steps[0]).alias("bucket")).agg(F.count("*").alias("c"), F.min("v*").alias("low"), F.max("v*").alias("high"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))  # a row for each bucket
        counted = counts.withColumn("upto", upto)
        rank = F.col("a.place") - F.col("a.before")
        todo = large.alias("a").join(counted.alias("b"), [*same("a", "b"), rank >= F.col("b.upto") - F.col("b.c"), rank < F.col("b.upto")])
        todo = todo.select(*[F.col(f"a.{c}").alias(c) for c in (*by, "level", "side", "place")], F.col("b.c").alias("n"), F.col("b.low").alias("lo"), F.col("b.high").alias("hi"), (F.col("a.before") + F.col("b.upto") - F.col("b.c")).alias("before"))
        todo = materialise(todo, "ranks")
    at = sizes.select(*[F.col(c).alias(f"{c}*") for c in by], F.col("n").alias("n*"))
    pair = found.groupBy(*by, "level").agg(F.min("value").alias("a*"), F.max("value").alias("b*"))
    joined = pair.join(at, [F.col(c).eqNullSafe(F.col(f"{c}*")) for c in by]) if by else pair.crossJoin(F.broadcast(at))  # one row
    place = F.col("level") * (F.col("n*") - 1)
    share = place - F.floor(place)
    return joined.select(*by, "level", (F.col("a*") * (1 - share) + F.col("b*") * share).alias("percentile"))


def _in_ranges(rows: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Values with each range of their group that they lie in; ranges of a group are few and come as one row."""
    lists = ranges.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges*"))
    lists = lists.select(*[F.col(c).alias(f"{c}*") for c in by], "ranges*")
    joined = rows.join(lists, [F.col(c).eqNullSafe(F.col(f"{c}*")) for c in by]) if by else rows.crossJoin(F.broadcast(lists))  # one row
    hit: Column = F.filter("ranges*", lambda r: (F.col("v*") >= r["lo"]) & (F.col("v*") <= r["hi"]))
    return joined.select(*by, "v*", F.inline(hit))


def percentile_columns(rows: DataFrame, by: list[str], value: str, names: dict[str, float]) -> DataFrame:
    """``by`` and one column for each named level."""
    got = exact_percentiles(rows, by, value, tuple(dict.fromkeys(names.values())))
    return got.groupBy(*by).agg(*[F.max(F.when(F.col("level") == p, F.col("percentile"))).alias(n) for n, p in names.items()])


def binned_percentile(rows: DataFrame, by: list[str], value: str, level: float, name: str, width: float = 1e-3) -> DataFrame:
    """``by, name``: a linearly interpolated percentile of each group of a bounded metric, exactly, in two passes.

    The first counts bins of ``width``, whose number the metric's bounds limit; the second counts the distinct values of
    the one or two bins that the wanted ranks lie in. Groups without values give no row. ``rows`` is read twice.
    """
    v = F.col(value).cast("double")
    rows = rows.select(*by, v.alias("v*"), F.lit(0).alias("all*")).filter(F.col("v*").isNotNull() & ~F.isnan("v*")).withColumn("bin*", F.floor(F.col("v*") / width))
    keys = [*by, "all*"]
    over = Window.partitionBy(*keys)
    sofar = lambda order: F.sum("c*").over(over.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    at = F.lit(float(level)) * (F.col("n*") - 1)
    bins = rows.groupBy(*keys, "bin*").agg(F.count("*").alias("c*")).withColumns({"upto*": sofar("bin*"), "n*": F.sum("c*").over(over)}).withColumns({"low*": F.floor(at), "high*": F.ceil(at), "share*": at - F.floor(at)})
    bins = bins.filter((F.col("upto*") > F.col("low*")) & (F.col("upto*") - F.col("c*") <= F.col("high*")))
    before = F.min(F.col("upto*") - F.col("c*")).over(over)
    bins = materialise(bins.select(*keys, "bin*", before.alias("before*"), "low*", "high*", "share*"), "bins")  # at most two rows a group
    values = rows.join(F.broadcast(bins), [*keys, "bin*"]).groupBy(*keys, "v*").agg(F.count("*").alias("c*"), *[F.first(c).alias(c) for c in ("before*", "low*", "high*", "share*")])
    values = values.withColumn("upto*", F.col("before*") + sofar("v*"))
    reach = lambda rank: F.min(F.when(F.col("upto*") > F.col(rank), F.col("v*")))
    got = values.groupBy(*keys).agg(reach("low*").alias("a*"), reach("high*").alias("b*"), F.first("share*").alias("share*"))
    return got.select(*by, (F.col("a*") * (1 - F.col("share*")) + F.col("b*") * F.col("share*")).alias(name))
