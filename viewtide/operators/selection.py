"""Exact order statistics by distributed selection.

A histogram of labels is small only while labels repeat. For labels that may be any double, nearly
all distinct, no task should hold a group's values. The ranks asked for are therefore narrowed in
rounds. A round takes splitters of each group from a mergeable quantile sketch, counts the rows
between the splitters around a rank, and keeps the rows between them. The sketch only proposes;
counts decide, so ranks stay exact whatever its error. Rounds end when at most ``group_rows`` rows
lie strictly between the splitters around a rank, or the rank falls on a splitter's own ties. With 1,024 splitters a round leaves about a 300th of the rows:
three rounds take 10^12 rows of one group to a bounded sort.

Groups of up to ``group_rows`` rows take Spark's own exact percentile at once. Larger ones number at
most rows / ``group_rows``; their bounds are broadcast while there are at most ``BROADCAST_GROUPS``
of them, and joined by group (under the adaptive planner's skew handling) beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewtide.session import remove_staged, stage_table

GROUP_ROWS = 1 << 18
SPLITTERS = 1024
# A group's bounds take some hundred bytes, so that this many stay below 16 MB.
BROADCAST_GROUPS = 1 << 16


def _small(groups: DataFrame, count: int) -> DataFrame:
    return F.broadcast(groups) if count <= BROADCAST_GROUPS else groups


def _renamed(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return groups.select(*[F.col(k).alias(f"g_{k}") for k in keys]).distinct()


def _matched(left: Sequence[str]) -> Column:
    """Equality of a row's group columns and a bound's ``g_`` columns; null is a group of its own."""
    found = F.lit(True)
    for name in left:
        found = found & F.col(name).eqNullSafe(F.col(f"g_{name}"))
    return found


def _brackets(groups: DataFrame, splitters: int) -> DataFrame:
    """Targets with the splitters some steps below and above their rank as ``lo`` and ``hi``."""
    step = (F.col("size") - 1) / splitters
    below = F.floor(F.col("first") / step).cast("int") - 1
    above = F.ceil(F.col("last") / step).cast("int") + 1
    grid = F.col("grid")
    lo = F.when(below > 0, F.try_element_at(grid, F.greatest(below, F.lit(0)) + 1)).otherwise(F.lit(float("-inf")))
    hi = F.when(above < splitters, F.try_element_at(grid, F.least(above, F.lit(splitters)) + 1)).otherwise(F.lit(float("inf")))
    return groups.withColumns({"lo": lo, "hi": hi})


def _counted(rows: DataFrame, targets: DataFrame, keys: list[str], count: int) -> DataFrame:
    """``targets`` with the rows below and up to each bound: ``below_lo``, ``upto_lo``, ``below_hi``, ``upto_hi``, ``lowest`` (rows of -inf)
    and ``highest`` (rows of inf).

    A row enters the map-side combined count once, by its place among all bounds of its group.
    """
    ends = F.array(F.lit(float("-inf")), F.lit(float("inf")))
    bounds = targets.groupBy(*[F.col(k).alias(f"g_{k}") for k in keys]).agg(
        F.array_sort(F.array_union(F.array_union(F.collect_set("lo"), F.collect_set("hi")), ends)).alias("bounds")
    )
    placed = rows.join(_small(bounds, count), _matched(keys)).select(
        *keys,
        F.size(F.filter("bounds", lambda b: b < F.col("v"))).alias("place"),
        F.array_contains("bounds", F.col("v")).alias("tie"),
        "bounds",
    )
    cells = placed.groupBy(*keys, "place", "tie").agg(F.count(F.lit(1)).alias("n"), F.any_value("bounds").alias("bounds"))
    cells = cells.select(*[F.col(k).alias(f"g_{k}") for k in keys], "place", "tie", "n", "bounds")
    place, tie = F.col("place"), F.col("tie")

    def total(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).alias(name)

    sums = [total(tie & (place == 0), "lowest"), total(tie & (place == F.size("bounds") - 1), "highest")]
    for side in ("lo", "hi"):
        at = F.array_position("bounds", F.col(side)) - 1
        sums += [total((place < at) | ((place == at) & ~tie), f"below_{side}"), total(place <= at, f"upto_{side}")]
    return _small(targets, count).join(cells, _matched(keys)).groupBy(*targets.columns).agg(*sums)


def _narrow(rows: DataFrame, targets: DataFrame, keys: list[str], splitters: int) -> DataFrame:
    """One round: targets with verified bounds ``lo`` and ``hi``; ranks and ``size`` count the rows strictly between them.

    A rank that falls on rows equal to a bound is found and becomes ``low`` or ``high``, so that ties never stay.
    """
    count = targets.count()
    grid = F.percentile_approx("v", F.array(*[F.lit(i / splitters) for i in range(splitters + 1)]), F.lit(10 * splitters))
    sketch = rows.join(_small(_renamed(targets, keys), count), _matched(keys)).groupBy(*keys).agg(grid.alias("grid"))
    sketch = sketch.select(*[F.col(k).alias(f"g_{k}") for k in keys], "grid")
    # the sketch is not read twice: another run of it may propose other splitters
    bracketed = stage_table(_brackets(_small(targets, count).join(sketch, _matched(keys)), splitters).select(*targets.columns, "lo", "hi"), "brackets")
    counted = _counted(rows, bracketed, keys, count)
    missed_low, missed_high = F.col("first") < F.col("below_lo"), F.col("last") >= F.col("upto_hi")
    # where a sketch missed a rank, that side stays open and the rank is sought again
    checked = counted.withColumns({
        "lo": F.when(missed_low, F.lit(float("-inf"))).otherwise(F.col("lo")),
        "hi": F.when(missed_high, F.lit(float("inf"))).otherwise(F.col("hi")),
        "from": F.when(missed_low, F.col("lowest")).otherwise(F.col("upto_lo")),
        "to": F.when(missed_high, F.col("size") - F.col("highest")).otherwise(F.col("below_hi")),
    })

    def found(rank: str) -> Column:
        return F.when(F.col(rank) < F.col("from"), F.col("lo")).when(F.col(rank) >= F.col("to"), F.col("hi"))

    checked = checked.withColumns({"low": F.coalesce("low", found("first")), "high": F.coalesce("high", found("last"))})
    sought = {"first": F.when(F.col("low").isNull(), F.col("first")).otherwise(F.col("last")), "last": F.when(F.col("high").isNull(), F.col("last")).otherwise(F.col("first"))}
    narrowed = checked.withColumns({n: rank - F.col("from") for n, rank in sought.items()} | {"size": F.col("to") - F.col("from")})
    staged = stage_table(narrowed.select(*targets.columns, "lo", "hi"), "targets")
    remove_staged(bracketed)
    return staged


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    group_rows: int = GROUP_ROWS,
    splitters: int = SPLITTERS,
) -> DataFrame:
    """Exact quantiles of a numeric column, per group: columns ``by``, ``rows``, ``probability``, ``quantile``.

    Interpolates linearly between the two rows around a rank, like ``percentile``. Values are taken
    as doubles; null and NaN are left out, and a group without any other value gives no row. A null key is a
    group of its own. ``group_rows`` bounds what one task ever orders, ties included;
    ``splitters`` must be 16 at least, as a rank lies up to two steps from its bounds.
    """
    if splitters < 16 or group_rows < 1:
        raise ValueError("at least 16 splitters and 1 row are needed")
    keys = list(by) or ["g"]
    given = [F.col(k) for k in by] or [F.lit(0).alias("g")]
    # adding zero makes -0.0 and 0.0 one value
    taken = df.select(*given, (F.col(value).cast("double") + F.lit(0.0)).alias("v")).where("v is not null and not isnan(v)")
    counts = stage_table(taken.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")), "group-rows")
    many = counts.where(F.col("rows") > group_rows)
    heavy = many.count()
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    light = taken.join(_small(_renamed(many, keys), heavy), _matched(keys), "left_anti") if heavy else taken
    each = light.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.percentile("v", wanted).alias("q"))
    result = each.select(*keys, "rows", F.inline(F.arrays_zip(wanted.alias("probability"), F.col("q").alias("quantile"))).alias("probability", "quantile"))

    place = F.col("probability") * (F.col("rows") - 1)
    targets = many.select(*keys, "rows", F.explode(wanted).alias("probability")).withColumns(
        {"first": F.floor(place), "last": F.ceil(place), "skipped": F.floor(place), "size": F.col("rows")}
    ).withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    rows, at = taken, keys
    while heavy:
        narrowed = _narrow(rows, targets, at, splitters)
        unsettled = F.col("low").isNull() | F.col("high").isNull()
        spread = narrowed.where(unsettled).select(*[F.col(k).alias(f"g_{k}") for k in at], F.col("probability").alias("p"), "lo", "hi")
        around = rows.join(_small(spread, heavy), _matched(at) & (F.col("v") > F.col("lo")) & (F.col("v") < F.col("hi")))
        rows = stage_table(around.select(*keys, F.col("p").alias("probability"), "v"), "around-ranks")
        at = [*keys, "probability"]
        wide = unsettled & (F.col("size") > group_rows)
        result = result.unionByName(_settled(rows, narrowed.where(~wide), keys))
        targets = narrowed.where(wide).drop("lo", "hi")
        heavy = targets.count()
    return result.select(*by, "rows", "probability", "quantile")


def _settled(rows: DataFrame, targets: DataFrame, by: Sequence[str]) -> DataFrame:
    """The quantiles of narrowed targets: both values found, or picked by rank from the few rows between the bounds."""
    keys = [*by, "probability"]
    sought = targets.where("low is null or high is null").select(*[F.col(k).alias(f"g_{k}") for k in keys])
    near = rows.join(sought, _matched(keys), "left_semi")
    ordered = near.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("ordered"))
    ordered = ordered.select(*[F.col(k).alias(f"g_{k}") for k in keys], "ordered")
    joined = targets.join(ordered, _matched(keys), "left")
    low, high = (F.coalesce(F.col(v), F.try_element_at("ordered", (F.col(rank) + 1).cast("int"))) for v, rank in (("low", "first"), ("high", "last")))
    share = F.col("probability") * (F.col("rows") - 1) - F.col("skipped")
    value = F.when(low == high, low).otherwise((1 - share) * low + share * high)
    return joined.select(*by, "rows", "probability", value.alias("quantile"))
