"""Building blocks that most plans share: latest rows, top n, keyed upserts, first valid values, month grids."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order that should be total. Spark limits each task's groups before the shuffle."""
    return ranked(df, keys, order, "_rn").where(F.col("_rn") <= n).drop("_rn")


def pick(df: DataFrame, keys: Sequence[str], values: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row a key by a hash aggregation with map-side combining, for when only some columns are needed."""
    best = (F.max_by if last else F.min_by)(F.struct(*values), order)
    return df.groupBy(*keys).agg(best.alias("_v")).select(*keys, "_v.*")


def first_valid(value: Column, order: Column, valid: Column) -> Column:
    """An aggregate: the value of the first row in order among the valid ones. Missing order keys do not matter."""
    return F.min_by(F.when(valid, value), F.when(valid, order))


def tie_broken(order: Column, place: Column) -> Column:
    """A whole number's order, then place (under 10 ** 18), as one number: an aggregate keeps it in its buffer, where a struct
    would have it sort all rows."""
    return order.cast("decimal(19,0)") * F.lit(Decimal(10**18)) + place.cast("decimal(18,0)")


def on_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which NULL equals NULL; the keys of the left side stay."""
    there = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(F.broadcast(there) if how == "few" else there, cond, "inner" if how == "few" else how).drop(*[f"_r_{k}" for k in keys])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Interpolated percentiles of a number over few keys, one row a key, without a buffer of a key's values.

    A sketch tells between which values each percentile must lie; what is below is counted, and only values between (some
    6 / accuracy of all, equal ones as one) are ordered. If a sketch were wrong, all values are ordered.
    """
    slack = 3 / accuracy
    ends = [min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-slack, slack)]
    sketch = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*map(F.lit, ends)), accuracy).alias("_e"), F.count(value).alias("_n"))
    kept = lambda d: d.sparkSession.createDataFrame(d.collect(), d.schema)
    sketch = kept(sketch)  # a row a key

    def found(free: bool) -> DataFrame:
        v, low, high = F.col("_v"), F.col("_q.low"), F.col("_q.high")
        asked = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(q) * (F.col("_n") - 1)).alias("at"), F.col("_e")[2 * i].alias("low"), F.col("_e")[2 * i + 1].alias("high")) for i, q in enumerate(shares.values())])
        near = F.lit(True) if free else v.between(low, high)
        rows = on_same(df.select(*keys, F.col(value).alias("_v")).where(v.isNotNull()), sketch, keys, "few").select(*keys, "_v", F.explode(asked).alias("_q"))
        # the rows below are one group, whose value is NULL and comes first
        counts = rows.where((v <= high) | F.lit(free)).groupBy(*keys, F.col("_q.i").alias("_i"), F.col("_q.at").alias("_at"), F.when(near, v).alias("_v")).agg(F.count("*").alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
        held = lambda at: F.max(F.when((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")), F.col("_v")))
        lower, upper = F.floor("_at"), F.ceil("_at")
        ends = counts.withColumn("_upto", upto).groupBy(*keys, "_i", "_at").agg(held(lower).alias("_a"), held(upper).alias("_b"))
        mixed = F.when(lower == upper, F.col("_a")).otherwise((upper - F.col("_at")) * F.col("_a") + (F.col("_at") - lower) * F.col("_b"))
        return ends.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, mixed)).alias(n) for i, n in enumerate(shares)])

    near = kept(found(False))
    whole = on_same(sketch.select(*keys, "_n"), near, keys, "left")
    if not whole.where(F.col("_n") > 0).where(" OR ".join(f"{n} IS NULL" for n in shares)).isEmpty():
        whole = on_same(sketch.select(*keys, "_n"), found(True), keys, "left")
    return whole.drop("_n")


def mean_ranks(df: DataFrame, key: str, value: str, name: str, parts: int = 32) -> DataFrame:
    """(key, value, name): the mean rank of each value among its key's rows, NULL last. Values are dealt over parts of a key by
    approximate edges, which decide sizes and no result; a part's ranks go on from the parts before."""
    n, edges = F.col("_n"), df.groupBy(key).agg(F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 1000).alias("_e"))
    over = sum(((F.col(value) > F.col("_e")[i]).cast("int") for i in range(parts - 1)), F.lit(0))
    counts = on_same(df.groupBy(key, value).agg(F.count("*").alias("_n")), edges, [key], "few").withColumn("_part", F.coalesce(over, F.lit(parts))).drop("_e")
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = counts.groupBy(key, "_part").agg(F.sum("_n").alias("_s")).select(key, "_part", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    run = F.sum("_n").over(Window.partitionBy(key, "_part").orderBy(F.col(value).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return on_same(counts.withColumn("_run", run), sizes, [key, "_part"], "few").select(key, value, (F.col("_before") + F.col("_run") - n + (n + 1) / 2).alias(name))


def keyed_hash(keys: Sequence[str], seed: int) -> Column:
    """SHA-256 of the seed and the keys, as hexadecimal text: the same in every engine."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)), 256)


def least_hashed(df: DataFrame, keys: Sequence[str], n: int, seed: int) -> DataFrame:
    """The n rows of the least keyed hash (all if there are fewer): a reproducible sample of a given size.

    Counts of the hash's first four digits, 65536 at most, tell the digits up to which rows are taken whole; only the
    rows of the digits where the sample ends are ordered.
    """
    at, digits = keyed_hash(keys, seed), F.substring(keyed_hash(keys, seed), 1, 4)
    taken, edge = 0, None
    for row in sorted(df.groupBy(digits.alias("d")).count().collect()):
        if taken + row["count"] > n:
            edge = row["d"]
            break
        taken += row["count"]
    if edge is None:
        return df
    return df.where(digits < edge).unionByName(df.where(digits == edge).orderBy(at, *keys).limit(n - taken))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """Old and new rows, one a key: a new one wins; among equals the last in order."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)), allowMissingColumns=True)
    return top_n(both, keys, [F.col("_gen").desc(), *(order or [])]).drop("_gen")


def replace_keys(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not among the new ones, and all new rows."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def month_span(df: DataFrame, keys: Sequence[str], month: str = "month") -> DataFrame:
    """Every month from a key's first to its last."""
    span = df.groupBy(*keys).agg(F.min(month).alias("_a"), F.max(month).alias("_b"))
    steps = F.sequence(F.to_date(F.concat("_a", F.lit("-01"))), F.to_date(F.concat("_b", F.lit("-01"))), F.expr("interval 1 month"))
    return span.select(*keys, F.explode(steps).alias("_d")).select(*keys, F.date_format("_d", "yyyy-MM").alias(month))


def missing_months(df: DataFrame, keys: Sequence[str], month: str = "month") -> DataFrame:
    """Months inside a key's span that have no row; NULL keys are groups like others."""
    have = df.select(*keys, month).where(F.col(month).isNotNull()).distinct()
    want = month_span(have, keys, month).alias("w")
    cond = [F.col(f"w.{k}").eqNullSafe(F.col(f"h.{k}")) for k in (*keys, month)]
    return want.join(have.alias("h"), cond, "left_anti")
