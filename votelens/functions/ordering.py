"""Distributed order statistics: prefix sums, dense indexes and exact quantiles.

A window without a partition key (or with one hot key) sorts all its rows in one task. The helpers
here first cut the ordered axis into buckets that Spark can spread over the cluster, add up each
bucket, and only run windows *inside* buckets plus one tiny window over bucket totals. Results are
exact: bucket borders steer balance, never values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 16          # FANOUT**2 buckets per group
HASH_DIGITS = 3      # 16**HASH_DIGITS hash buckets per group
SAMPLE = 4096        # rows of a group whose quantiles cut the axis in ordered_index, taken
LANES = 8            # from so many parts by hash: Spark limits a group within a task up to 1000 rows only
SALTS = 64           # tasks that share the rows of one hot group in attach_groups


def _bucket(key: Column, bounds: Column, coarse: Column, fanout: int) -> Column:
    """Number of sorted bounds <= key, found with two short scans instead of one long one."""
    c = F.size(F.filter(coarse, lambda b: b <= key))
    fine = F.size(F.filter(F.slice(bounds, c * fanout + 1, fanout - 1), lambda b: b <= key))
    return c * fanout + fine


def prefix_sums(df: DataFrame, by: list[str], key: str, sums: list[str], descending: bool = True,
                fanout: int = FANOUT, axis_by: list[str] | None = None) -> DataFrame:
    """Inclusive prefix sums of ``sums`` along ``key`` inside each ``by`` group.

    ``df`` holds one row per (by, key), so a key value shared by a third of the raw rows is already
    one row here. Adds ``cum_<s>`` and the group total ``tot_<s>``. ``axis_by`` names the keys that need
    their own bucket borders (default: all of ``by``); bootstrap replicates share the borders of their pool.
    """
    axis_by = by if axis_by is None else axis_by
    n = fanout * fanout
    probs = [i / n for i in range(1, n)]
    # reading the sums here keeps them in the plan, so border search and main pass share one shuffle of df
    bounds = (df.filter(F.greatest(*[F.col(s) for s in sums], F.lit(0)) >= 0).groupBy(*axis_by)
              .agg(F.percentile_approx(F.col(key).cast("double"), probs, 20 * n).alias("_bounds")))
    bounds = bounds.withColumn(
        "_coarse", F.transform(F.sequence(F.lit(1), F.lit(fanout - 1)),
                               lambda i: F.element_at("_bounds", i * fanout)))
    if axis_by:
        cut = attach(df, bounds, axis_by)
    else:
        cut = df.crossJoin(F.broadcast(bounds))  # one row of n doubles by construction
    k = F.col(key).cast("double")
    cut = cut.withColumn("_bucket", _bucket(k, F.col("_bounds"), F.col("_coarse"), fanout)).drop("_bounds", "_coarse")
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    across = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # <= n rows per group
    whole = Window.partitionBy(*by)
    offsets = totals.select(*by, "_bucket",
                            *[F.coalesce(F.sum(f"_t_{s}").over(across), F.lit(0)).alias(f"_o_{s}") for s in sums],
                            *[F.sum(f"_t_{s}").over(whole).alias(f"tot_{s}") for s in sums])
    joined = attach(cut, offsets, by + ["_bucket"])
    korder = F.col(key).desc() if descending else F.col(key).asc()
    inside = Window.partitionBy(*by, "_bucket").orderBy(korder).rowsBetween(Window.unboundedPreceding, 0)
    out = joined.select(*df.columns, *[f"tot_{s}" for s in sums],
                        *[(F.sum(s).over(inside) + F.col(f"_o_{s}")).alias(f"cum_{s}") for s in sums])
    return out


def bounded_prefix_sums(df: DataFrame, by: list[str], key: str, sums: list[str], descending: bool = True) -> DataFrame:
    """Same columns as :func:`prefix_sums` for keys whose number of distinct values is bounded
    (values stored with four decimals in [0, 1], vote counts, thresholds): one window per group."""
    korder = F.col(key).desc() if descending else F.col(key).asc()
    run = Window.partitionBy(*by).orderBy(korder).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return df.select(*df.columns, *[F.sum(s).over(whole).alias(f"tot_{s}") for s in sums],
                     *[F.sum(s).over(run).alias(f"cum_{s}") for s in sums])


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that renames the right keys first, so a right side derived from ``left`` is unambiguous.

    Keys are non-null by contract (operators coalesce missing group names to ''). No broadcast hint:
    AQE broadcasts the right side at run time only where its measured size allows it.
    """
    r = right
    for k in keys:
        r = r.withColumnRenamed(k, f"_rk_{k}")
    cond = [F.col(k) == F.col(f"_rk_{k}") for k in keys]
    return left.join(r, cond, how).drop(*[f"_rk_{k}" for k in keys])


def attach_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """:func:`attach` for one small row per group (or a bounded number of them), where one group may hold a third of all
    rows of ``left``.

    Each row of ``right`` stands once for every salt, and a row of ``left`` takes the salt of its partition, so a hot
    group meets its row in ``salts`` tasks instead of one. A partition keeps its number when it is computed again, so a
    lost executor changes no row's salt. Where ``right`` with its copies is small enough, AQE broadcasts it and the salts
    cost nothing."""
    salted = left.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return attach(salted, copies, [*keys, "_salt"], how).drop("_salt")


def hash_index(df: DataFrame, by: list[str], key: str, salt: str, name: str = "idx", size: str | None = None,
               digits: int = HASH_DIGITS) -> DataFrame:
    """Dense 0-based index per group in md5(key|salt) order: a seeded shuffle that any engine can repeat.

    md5 prefixes are uniform whatever the data, so buckets are balanced even when one group holds a
    third of all rows. ``size`` optionally names a column with the group's row count.
    """
    h = df.withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(salt))))
    h = h.withColumn("_bucket", F.substring("_h", 1, digits))
    counts = h.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_o"),
                            F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    j = attach(h, offsets, by + ["_bucket"])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_h", key)
    cols = [*df.columns, (F.row_number().over(inside) + F.col("_o") - 1).cast("long").alias(name)]
    if size:
        cols.append(F.col("_size").cast("long").alias(size))
    return j.select(*cols)


def ordered_index(df: DataFrame, by: list[str], order: list[str], name: str = "idx", size: str | None = None) -> DataFrame:
    """Dense 0-based index per group in the ascending order of several columns (nulls first); nothing runs before an action.

    The axis of each group is cut at quantiles of a bottom-k sample: the rows whose order columns hash lowest in each lane. Such a
    sample is the same however the rows are spread or computed again, so the counts and the numbering, which cut the axis
    separately, always agree. Tasks keep only their own lowest hashes before the shuffle. A row is led to its bucket in two steps
    of FANOUT - 1 border columns each: no row ever carries all borders. Counts per bucket are exact, their
    offsets come from a window over at most FANOUT**2 rows per group, rows are numbered inside their bucket."""
    n = FANOUT * FANOUT
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    lowest = Window.partitionBy(*by, "_lane").orderBy("_h", "_key")  # a group limit: SAMPLE rows of each task and group
    sample = df.select(*by, key.alias("_key"), F.xxhash64(*order).alias("_h")).withColumn("_lane", F.pmod("_h", F.lit(LANES)))
    sample = sample.withColumn("_r", F.row_number().over(lowest)).filter(F.col("_r") <= SAMPLE // LANES)
    sample = sample.groupBy(*by).agg(F.sort_array(F.collect_list("_key")).alias("_s"))
    at = lambda i: F.try_element_at("_s", (F.floor(i * F.size("_s") / F.lit(n)) + 1).cast("int"))  # null in an empty table
    steps = range(1, FANOUT)
    # a row meets FANOUT - 1 borders, then the FANOUT - 1 borders within its stretch, each a plain column
    coarse = sample.select(*by, *[at(F.lit(i * FANOUT)).alias(f"_e{i}") for i in steps])
    fine = sample.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(FANOUT - 1))))
    fine = fine.select(*by, "_part", *[at(F.col("_part") * FANOUT + i).alias(f"_e{i}") for i in steps])
    cut = df.withColumn("_key", key)
    for right, keys, number, salts in ((coarse, by, "_c", SALTS), (fine, [*by, "_part"], "_f", SALTS // FANOUT)):
        if by:  # a null group is a group
            right = right.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            cut = cut.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        for c in by:
            right = right.withColumnRenamed(c, f"_b_{c}")
        cond = [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by] + ([F.col("_salt") == F.col("_copy")] if by else [])
        cond += [F.col("_c") == F.col("_part")] if "_part" in keys else []
        right = right if by else F.broadcast(right)  # one row, then FANOUT rows by construction
        cut = cut.join(right, cond) if cond else cut.crossJoin(right)
        passed = sum((F.coalesce((F.col(f"_e{i}") <= F.col("_key")).cast("int"), F.lit(0)) for i in steps), F.lit(0))
        cut = cut.select(*df.columns, "_key", *(["_c"] if "_part" in keys else []), passed.alias(number))
    cut = cut.withColumn("_bucket", F.col("_c") * FANOUT + F.col("_f")).drop("_c", "_f")
    counts = cut.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    across = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # <= n rows per group
    offsets = counts.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_b"),
                            F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*by)).alias("_size"))
    j = cut.join(offsets, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in by] + [F.col("_bucket") == F.col("_b")])
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key")
    cols = [*df.columns, (F.row_number().over(inside) + F.col("_o") - 1).cast("long").alias(name)]
    if size:
        cols.append(F.col("_size").cast("long").alias(size))
    return j.select(*cols)


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float],
                    bounded: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group from value counts; no group is ever held in one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    step = bounded_prefix_sums if bounded else prefix_sums
    c = step(counts, by, value, ["n"], descending=False)
    aggs = []
    for i, q in enumerate(probs.values()):
        h = F.lit(float(q)) * (F.col("tot_n") - 1)
        aggs += [F.min(F.when(F.col("cum_n") > F.floor(h), F.col(value))).alias(f"_lo{i}"),
                 F.min(F.when(F.col("cum_n") > F.ceil(h), F.col(value))).alias(f"_hi{i}")]
    agg = c.groupBy(*by).agg(F.max("tot_n").alias("_n"), *aggs)
    out = [F.col(b) for b in by]
    for i, (label, q) in enumerate(probs.items()):
        h = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (h - F.floor(h))).alias(label))
    return agg.select(*out)


def tie_average_ranks(df: DataFrame, by: list[str], key: str, weight: str | None = None) -> DataFrame:
    """1-based average rank of each distinct ``key`` (ascending) per group: (by, key, avg_rank)."""
    w = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, key).agg(w.alias("n"))
    c = prefix_sums(counts, by, key, ["n"], descending=False)
    return c.select(*by, key, (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("avg_rank"))
