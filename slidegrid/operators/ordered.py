"""Order-dependent operators that survive one very large group.

A plain ``sum() over (partition by slide order by ...)`` sends a whole slide to one task. Here every
group is cut into ordered buckets of bounded size: bucket totals are summed first (a small table),
then each bucket is finished on its own with the offset of the buckets before it. Both steps are
ordinary aggregates, joins and windows, so Catalyst plans and AQE re-plans them.

Buckets come from one of three places, all fixed functions of the row so that a retried task agrees
with its first run:

* the value itself against split points fetched once (at most 4096 doubles) - ``value_bucket``;
* a whole-number index divided by a block size - ``index_bucket``;
* leading hex digits of a seeded hash - ``hashing.hash_bucket``.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from slidegrid.functions.hashing import hash_bucket, hash_digits, seeded_key, spread
from slidegrid.operators.skew import copies_join
from slidegrid.session import cut_lineage, prefix_buckets, salt_count

BUCKET = "__bucket"


def split_points(df: DataFrame, col: str, buckets: int | None = None) -> list[float]:
    """Inner bucket edges for ``col``: one pass, at most 4095 doubles come back.

    The edges only balance the work. Any edges give the same result, so an approximate summary is
    enough, and holding them as literals keeps both branches of a plan in agreement.
    """
    n = buckets or prefix_buckets(df.sparkSession)
    if n < 2:
        return []
    probs = [i / n for i in range(1, n)]
    row = df.agg(F.percentile_approx(F.col(col).cast("double"), probs, 10 * n).alias("q")).first()
    return sorted({float(v) for v in (row["q"] or []) if v == v})


def value_bucket(df: DataFrame, col: str, splits: list[float], out: str = BUCKET) -> DataFrame:
    """Adds the bucket number of ``col`` (monotone in ``col``; equal values share a bucket)."""
    if not splits:
        return df.withColumn(out, F.lit(0))
    stage = Bucketizer(
        splits=[-float("inf"), *splits, float("inf")], inputCol="__v", outputCol="__b", handleInvalid="keep"
    )
    return stage.transform(df.withColumn("__v", F.col(col).cast("double"))).withColumn(
        out, F.col("__b").cast("int")
    ).drop("__v", "__b")


def index_bucket(index: Column, block: int = 1 << 16) -> Column:
    return F.floor(index / F.lit(block)).cast("long")


def running_totals(
    df: DataFrame,
    by: list[str],
    order: list[str | Column],
    measures: dict[str, Column],
    bucket: str = BUCKET,
    descending: bool = False,
    with_total: bool = False,
) -> DataFrame:
    """Inclusive prefix sums of ``measures`` in each ``by`` group.

    ``df`` carries ``bucket``; every (by, bucket) group must be bounded, and ``order`` (which sorts
    inside a bucket) must agree with the order of the buckets. Adds one column per measure, and with
    ``with_total`` a ``total_<name>`` per measure.
    """
    work = df.withColumns({f"__m_{k}": v for k, v in measures.items()})
    parts = work.groupBy(*by, bucket).agg(*[F.sum(f"__m_{k}").alias(f"__s_{k}") for k in measures])
    edge = F.col(bucket).desc() if descending else F.col(bucket).asc()
    before = Window.partitionBy(*by).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0)
    offsets = parts.select(
        *by,
        bucket,
        *[F.coalesce(F.sum(f"__s_{k}").over(before), zero).alias(f"__o_{k}") for k in measures],
        *([F.sum(f"__s_{k}").over(whole).alias(f"total_{k}") for k in measures] if with_total else []),
    )
    local = Window.partitionBy(*by, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = work.join(offsets, [*by, bucket])
    return joined.withColumns(
        {k: F.col(f"__o_{k}") + F.sum(f"__m_{k}").over(local) for k in measures}
    ).drop(*[f"__m_{k}" for k in measures], *[f"__o_{k}" for k in measures])


def dense_positions(
    df: DataFrame, by: list[str], order: list[str | Column], bucket: Column, out: str = "pos", base: int = 0
) -> DataFrame:
    """Consecutive numbers ``base, base + 1, ...`` per group; ``order`` must be total."""
    ranked = running_totals(df.withColumn(BUCKET, bucket), by, order, {out: F.lit(1)})
    return ranked.withColumn(out, (F.col(out) - 1 + base).cast("long")).drop(BUCKET)


def read_positions(df: DataFrame, out: str = "pos") -> DataFrame:
    """Consecutive numbers in read order, for sources whose row order carries meaning (text lists)."""
    part = F.shiftright(F.monotonically_increasing_id(), 33)
    tagged = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", part)
    sizes = tagged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return tagged.join(offsets, "__part").withColumn(
        out, F.col("__o") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    ).drop("__id", "__part", "__o")


def sample_cap(df: DataFrame, by: list[str], key: list[str], n: int, seed: int = 0, digits: int | None = None) -> DataFrame:
    """At most ``n`` rows per group, chosen uniformly without replacement by a seeded hash.

    Groups are cut into buckets by leading hash digits, as many as the largest group needs; the choice does not depend on them.
    """
    digits = digits or hash_digits(df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0)
    place = F.struct(seeded_key(seed, *by, *key).alias("h"), *key)
    narrow = df.select(*by, *key, place.alias("__h")).withColumn(BUCKET, hash_bucket(F.col("__h.h"), digits))
    return _up_to(df.withColumn("__h", place), narrow, by, "__h", n).drop("__h")


def first_by_index(df: DataFrame, by: list[str], index: str, n: int, block: int = 4096) -> DataFrame:
    """The first ``n`` rows of each group by a unique whole-number index."""
    narrow = df.select(*by, index).withColumn(BUCKET, index_bucket(F.col(index), block))
    return _up_to(df, narrow, by, index, n)


def _up_to(df: DataFrame, narrow: DataFrame, by: list[str], place: str, n: int) -> DataFrame:
    """Rows at or before the n-th place of their group.

    Bucket sizes tell in which bucket of a group the n-th place lies, and only that bucket is ranked, on
    the key columns alone. What meets the full rows is one cut-off per group, so wide columns (pixels,
    embeddings) take part in no sort.
    """
    sizes = narrow.groupBy(*by, BUCKET).agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sizes.withColumn("__o", F.coalesce(F.sum("__c").over(before), F.lit(0)))
        .where((F.col("__o") < n) & (F.col("__o") + F.col("__c") >= n))
        .select(*by, BUCKET, "__o")
    )
    inside = narrow.join(edge, [*by, BUCKET]).withColumn(
        "__rank", F.row_number().over(Window.partitionBy(*by).orderBy(place))
    )
    # One row per group; kept, because capped tables are often read many times (every training epoch).
    cut = cut_lineage(inside.where(F.col("__o") + F.col("__rank") == n).select(*by, F.col(place).alias("__cut")))
    return copies_join(df, cut, by, "left", salt_on=[place]).where(
        F.col("__cut").isNull() | (F.col(place) <= F.col("__cut"))
    ).drop("__cut")


def top_n(df: DataFrame, by: list[str], order: list[Column], n: int, salt_on: list[str], rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group in a total ``order``.

    Two rounds: winners of each (group, salt) piece, then of the group. Spark adds a rank limit
    before each shuffle, so a hot group ships ``n`` rows per map task and piece, never the group.
    """
    salts = salt_count(df.sparkSession)
    first = Window.partitionBy(*by, "__salt").orderBy(*order)
    last = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("__salt", spread(salt_on, salts))
        .withColumn("__r", F.row_number().over(first))
        .where(F.col("__r") <= n)
        .drop("__r", "__salt")
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= n)
    )


def first_per(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first whole row of each key by ``order``; an aggregate with map-side combine, not a window."""
    rest = [c for c in df.columns if c not in key]
    picked = F.min_by(F.struct(*rest), F.struct(*order)) if order else F.first(F.struct(*rest))
    return df.groupBy(*key).agg(picked.alias("__row")).select(*key, "__row.*")


def group_quantiles(
    df: DataFrame,
    by: list[str],
    col: str,
    probs: dict[str, float],
    bounded: bool = False,
    splits: list[float] | None = None,
    weight: str | None = None,
    most: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group: (by..., n, one column per entry of ``probs``).

    By default each rank is selected: counts at the points of mergeable summaries shrink an interval around it until at most
    ``most`` rows are left to order, so no task orders more, whatever the group's size. ``bounded`` (few distinct
    values, as 8-bit channels), ``weight`` or ``splits`` choose counting of distinct values instead,
    which orders all of them in buckets. Groups without a value are left out; without groups, no value gives n 0 and null.
    """
    live = df.where(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double")))
    if bounded or weight or splits is not None:
        return _counted_quantiles(live, by, col, probs, bounded, splits, weight)
    return _selected_quantiles(live.select(*by, F.col(col).cast("double").alias("__v")), by, probs, most or ORDERED_ROWS)


def _interpolated(wide: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    low, high, t = ({k: F.col(f"__{part}_{k}") for k in probs} for part in ("lo", "hi", "t"))
    return wide.select(*by, "n", *[F.when(low[k] == high[k], low[k]).otherwise(low[k] + (high[k] - low[k]) * t[k]).alias(k) for k in probs])


def weighed_quantiles(df: DataFrame, by: list[str], cols: list[str], probs: dict[str, float], weight: str) -> DataFrame:
    """``group_quantiles`` of several columns, rows counting by ``weight``: (by, <column>_<name>...), for groups known to be of bounded size.

    A group is ordered whole, once per column, after one shuffle for all columns; equal values need no combining, as each
    row covers as many places as it weighs. ``large_groups`` tells which groups are too large for this.
    """
    live = {c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in cols}
    group = Window.partitionBy(*by)
    ranked = df.withColumns({f"__w_{c}": F.when(live[c], F.col(weight)).otherwise(0) for c in cols}).withColumns(
        {f"__cum_{c}": F.sum(f"__w_{c}").over(group.orderBy(c).rowsBetween(Window.unboundedPreceding, 0)) for c in cols}
        | {f"__total_{c}": F.sum(f"__w_{c}").over(group) for c in cols}
    )
    aggs = [F.max(f"__total_{c}").alias(f"__n_{c}") for c in cols]
    for c in cols:
        value, upto, total = F.col(c).cast("double"), F.col(f"__cum_{c}"), F.col(f"__total_{c}")
        for name, p in probs.items():
            spot = F.lit(float(p)) * (total - 1)
            for end, place in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
                aggs.append(F.max(F.when((upto - F.col(f"__w_{c}") <= place) & (place < upto), value)).alias(f"__{end}_{c}_{name}"))
            aggs.append(F.max(spot - F.floor(spot)).alias(f"__t_{c}_{name}"))
    some = F.greatest(*[F.col(f"__n_{c}") for c in [*cols, *cols]])
    found = ranked.groupBy(*by).agg(*aggs).where(some > 0).withColumn("n", some)
    return _interpolated(found, by, {f"{c}_{name}": p for c in cols for name, p in probs.items()}).drop("n")


def large_groups(df: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """(by): the groups of more than ``most`` rows, too large to be ordered in one task; checkpointed."""
    return cut_lineage(df.groupBy(*by).agg(F.count("*").alias("__n")).where(F.col("__n") > (most or ORDERED_ROWS)).select(*by))


#: Rows of a target that are ordered in one task, and points of the summary that splits the rest.
ORDERED_ROWS, SUMMARY_POINTS = 20_000, 200


def _selected_quantiles(live: DataFrame, by: list[str], probs: dict[str, float], most: int) -> DataFrame:
    """Quantiles by selection: an open interval per group and rank shrinks by exact counts until few rows are left.

    A round takes an approximate summary of the rows inside an interval, chooses two of its points around the
    wanted rank, and counts rows below, at and between them. The counts tell where the rank lies: at a point (then
    its value is known), between them, or outside (a summary that was off costs one more round, nothing else). Intervals of
    at most ``most`` rows are ordered; no other rows are. States are checkpointed, so retried tasks see the same points.
    """
    ranks = {f"{end}{i}": fn(F.lit(float(p)) * (F.col("n") - 1)) for i, p in enumerate(probs.values()) for end, fn in (("lo", F.floor), ("hi", F.ceil))}
    inside = {t: F.col(f"__v_{t}").isNull() & (F.col(f"__a_{t}").isNull() | (F.col("__v") > F.col(f"__a_{t}"))) & (F.col(f"__z_{t}").isNull() | (F.col("__v") < F.col(f"__z_{t}"))) for t in ranks}
    points = [i / SUMMARY_POINTS for i in range(SUMMARY_POINTS + 1)]
    summary = F.percentile_approx("__v", points, 10 * SUMMARY_POINTS)
    unknown = F.lit(None).cast("double")
    state = live.groupBy(*by).agg(F.count("*").alias("n"), summary.alias("__q"))
    for t in ranks:
        state = state.withColumns({f"__a_{t}": unknown, f"__z_{t}": unknown, f"__v_{t}": unknown, f"__b_{t}": F.lit(0).cast("long"), f"__m_{t}": F.col("n")})
    state = cut_lineage(state)
    largest = F.greatest(*[F.when(F.col(f"__v_{t}").isNull(), F.col(f"__m_{t}")).otherwise(0) for t in [*ranks, *ranks]])
    while (state.agg(F.max(largest)).first()[0] or 0) > most:
        open_ = {t: F.col(f"__v_{t}").isNull() & (F.col(f"__m_{t}") > most) for t in ranks}
        if "__q" in state.columns:  # first round: one summary of everything serves all ranks
            state = state.withColumns({f"__q_{t}": F.col("__q") for t in ranks}).drop("__q")
        else:
            again = _with_groups(live, state, by).groupBy(*by).agg(*[
                F.percentile_approx(F.when(inside[t] & open_[t], F.col("__v")), points, 10 * SUMMARY_POINTS).alias(f"__q_{t}") for t in ranks])
            state = cut_lineage(_joined_groups(state, again, by))
        chosen = {}
        for t, rank in ranks.items():
            at = F.floor((rank - F.col(f"__b_{t}")) * SUMMARY_POINTS / F.col(f"__m_{t}")).cast("int")
            for end, k in (("x", at - 1), ("y", at + 2)):
                chosen[f"__{end}_{t}"] = F.when(open_[t], F.get(f"__q_{t}", F.greatest(F.least(k, F.lit(SUMMARY_POINTS)), F.lit(0))))
        asked = state.withColumns(chosen).drop(*[f"__q_{t}" for t in ranks])
        counts = []
        for t in ranks:
            x, y, v = F.col(f"__x_{t}"), F.col(f"__y_{t}"), F.col("__v")
            counts += [F.count_if(inside[t] & test).alias(f"__{name}_{t}") for name, test in (("lx", v < x), ("ex", v <= x), ("ly", v < y), ("ey", v <= y))]
        state = _joined_groups(asked, _with_groups(live, asked, by).groupBy(*by).agg(*counts), by)
        for t, rank in ranks.items():
            r = rank - F.col(f"__b_{t}")
            lx, ex, ly, ey = (F.col(f"__{name}_{t}") for name in ("lx", "ex", "ly", "ey"))
            a, z, b, m, x, y = (F.col(f"__{name}_{t}") for name in "azbmxy")

            def case(*values: Column, t: str = t, r: Column = r, lx: Column = lx, ex: Column = ex, ly: Column = ly, ey: Column = ey) -> Column:
                old, below, at_x, between, at_y, above = values
                return F.when(~open_[t], old).when(r < lx, below).when(r < ex, at_x).when(r < ly, between).when(r < ey, at_y).otherwise(above)

            value = F.col(f"__v_{t}")
            state = state.withColumns({
                f"__a_{t}": case(a, a, a, x, a, y), f"__z_{t}": case(z, x, z, y, z, z), f"__v_{t}": case(value, unknown, x, unknown, y, unknown),
                f"__b_{t}": case(b, b, b, b + ex, b, b + ey), f"__m_{t}": case(m, lx, m, ly - ex, m, m - ey),
            })
        state = cut_lineage(state.drop(*[f"__{name}_{t}" for t in ranks for name in ("x", "y", "lx", "ex", "ly", "ey")]))
    state = state.drop("__q")
    which = F.array_compact(F.array(*[F.when(inside[t], F.lit(t)) for t in ranks]))
    left = _with_groups(live, state, by).select(*by, "__v", which.alias("__t")).where(F.size("__t") > 0).select(*by, "__v", F.explode("__t").alias("__t"))
    counted = left.groupBy(*by, "__t", "__v").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*by, "__t").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with_groups(counted.withColumn("__cum", F.sum("__c").over(upto)), state, by)
    found = ranked.groupBy(*by).agg(*[
        F.max(F.when((F.col("__t") == t) & (F.col(f"__b_{t}") + F.col("__cum") - F.col("__c") <= rank) & (rank < F.col(f"__b_{t}") + F.col("__cum")), F.col("__v"))).alias(f"__f_{t}")
        for t, rank in ranks.items()
    ])
    wide = _joined_groups(state, found, by)
    ends = {}
    for i, (name, p) in enumerate(probs.items()):
        spot = F.lit(float(p)) * (F.col("n") - 1)
        ends |= {f"__lo_{name}": F.coalesce(f"__v_lo{i}", f"__f_lo{i}"), f"__hi_{name}": F.coalesce(f"__v_hi{i}", f"__f_hi{i}"), f"__t_{name}": spot - F.floor(spot)}
    return _interpolated(wide.withColumns(ends), by, probs)


def _with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Every row with the numbers of its group, or of the one group there is."""
    if by:
        return copies_join(rows, groups, by, salt_on=["__v"])
    return rows.withColumn("__g", groups.select(F.struct(*groups.columns)).scalar()).select(*rows.columns, "__g.*")


def _joined_groups(groups: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """Two tables of one row per group; ``more`` may lack groups."""
    if by:
        return groups.join(more, by, "left")
    return groups.withColumn("__g", more.select(F.struct(*more.columns)).scalar()).select(*groups.columns, "__g.*")


def _counted_quantiles(
    live: DataFrame, by: list[str], col: str, probs: dict[str, float], bounded: bool, splits: list[float] | None, weight: str | None
) -> DataFrame:
    counts = live.groupBy(*by, col).agg((F.sum(weight) if weight else F.count("*")).alias("__n"))
    if bounded:
        upto = Window.partitionBy(*by).orderBy(col).rowsBetween(Window.unboundedPreceding, 0)
        ranked = counts.withColumns(
            {"__cum": F.sum("__n").over(upto), "total___cum": F.sum("__n").over(Window.partitionBy(*by))}
        )
    else:
        edges = splits if splits is not None else split_points(live, col)
        ranked = running_totals(
            value_bucket(counts, col, edges), by, [col], {"__cum": F.col("__n")}, with_total=True
        )
    value, below, total = F.col(col).cast("double"), F.col("__cum") - F.col("__n"), F.col("total___cum")

    def at(position: Column) -> Column:
        return F.max(F.when((below <= position) & (position < F.col("__cum")), value))

    aggs = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * (total - 1)
        aggs += [
            at(F.floor(spot)).alias(f"__lo_{name}"),
            at(F.ceil(spot)).alias(f"__hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"__t_{name}"),
        ]
    return _interpolated(ranked.groupBy(*by).agg(*aggs, F.max(total).alias("n")), by, probs)
