"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size, at most
2. The whole part is taken for certain; the fraction is a copy probability. Two documents with
fractions meet: words are moved between their probabilities, up or down with chances that keep
both expectations, until one of them is 0 or 1 and decided. The other goes on to the next. Moving
*words* keeps the source's expected total fixed at every step, so the total misses its target by
less than the last undecided document.

The steps form a tree: documents are dealt to blocks of about ``FAN_IN`` by a hash, each block is
rounded from its largest document to its smallest, and the one document it leaves undecided goes
to a block of the next level, until one is left of a source. So no task holds more than a block,
however large a source is, and only one row of a block is exchanged again. All of it is DataFrame
expressions; random numbers are hashes of the documents that meet, so reruns agree.

Defined cases: null or wordless texts have size 0 and nothing taken. A null source is a source of
its own, last in order. Null doc_ids and repeated rows are rounded as rows of their own. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from viewtide.llm.words import word_count
from viewtide.session import stage_table

FAN_IN = 128
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, n_docs, target for ``sizes`` (source, size).

    Targets are weight x level, stopped at ``most`` times the source's size. The sources that stop
    are the first ones by size / weight, so one ordered running sum finds the common level of the
    others. One row per source takes part.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = sources.withColumn("weight", weight.cast("double")).withColumn("cap", most * F.col("source_size"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level).withColumn("free", F.col("weight") * F.col("level") < F.col("cap"))
    # levels only rise along the order, so the first source below its cap fixes the level of all after it
    common = F.min_by(F.when(F.col("free"), F.col("level")), F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source"))).over(everything)
    target = F.least(F.col("cap"), F.col("weight") * F.coalesce(common, F.lit(float("inf"))))
    return sources.select("source", "source_size", "n_docs", target.alias("target"))


def _chance(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _meet(seed: int):
    def step(state: Column, new: Column) -> Column:
        old = state["open"]
        p, q, ratio = old["p"], new["p"], new["size"] / old["size"]
        up, down = F.least(1 - p, q * ratio), F.least(p, (1 - q) * ratio)
        rise = _chance(seed, old["doc_id"], old["size"], new["doc_id"], new["size"]) * (up + down) < down
        old_ends = F.when(rise, 1 - p <= q * ratio).otherwise(p <= (1 - q) * ratio)
        moved = F.when(rise, up).otherwise(-down)

        def unit(u: Column, prob: Column) -> Column:
            return F.struct(u["size"].alias("size"), u["doc_id"].alias("doc_id"), u["whole"].alias("whole"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), prob)).alias("p"))

        old_after, new_after = unit(old, p + moved), unit(new, q - moved / ratio)
        decided = F.when(old_ends, unit(old, rise.cast("double"))).otherwise(unit(new, (~rise).cast("double")))
        opened = F.when(old_ends, new_after).otherwise(old_after)
        return F.when(old.isNull(), F.struct(new.alias("open"), state["done"].alias("done"))).otherwise(
            F.struct(opened.alias("open"), F.concat(state["done"], F.array(decided)).alias("done"))
        )

    return step


UNIT = "struct<size:bigint,doc_id:bigint,whole:bigint,p:double>"


def _round_blocks(units: DataFrame, seed: int) -> DataFrame:
    """source, block, the unit left open and those decided, for units (source, block, unit)."""
    start = F.struct(F.lit(None).cast(UNIT).alias("open"), F.array().cast(f"array<{UNIT}>").alias("done"))
    in_order = F.sort_array(F.collect_list("unit"), asc=False)
    blocks = units.groupBy("source", "block").agg(in_order.alias("units"))
    return blocks.select("source", "block", F.aggregate("units", start, _meet(seed)).alias("r")).select("source", "block", "r.open", "r.done")


def sample_counts(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``."""
    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count("text").alias("size"))
    sizes = stage_table(sizes, "mix-sizes")
    targets = stage_table(source_targets(sizes, weights, share, most), "mix-targets")
    t = targets.withColumnRenamed("source", "target_source")
    rows = sizes.join(t, F.col("source").eqNullSafe(F.col("target_source"))).drop("target_source")
    rate = F.col("target") / F.col("source_size")
    rows = rows.withColumn("whole", F.when(F.col("size") > 0, F.floor(rate)).otherwise(0).cast("long"))
    rows = rows.withColumn("p", F.when(F.col("size") > 0, rate - F.col("whole")).otherwise(0.0))
    plain = rows.where("p = 0").select("source", "doc_id", "size", F.col("whole").alias("copies"))
    blocks = F.ceil(F.col("n_docs") / FAN_IN)
    units = rows.where("p > 0").select(
        "source", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), blocks).alias("block"), F.struct("size", "doc_id", "whole", "p").alias("unit")
    )
    left = targets.agg(F.max("n_docs")).first()[0] or 0
    done, level = [], 0
    left = -(-left // FAN_IN)
    while True:
        level += 1
        rounded = stage_table(_round_blocks(units, seed + level), f"mix-level{level}")
        done.append(rounded.select("source", F.explode("done").alias("unit")))
        units = rounded.select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("open").alias("unit"))
        if left <= 1:
            break
        left = -(-left // FAN_IN)
    last = (_chance(seed, F.col("unit.doc_id"), F.col("unit.size")) < F.col("unit.p")).cast("double")
    done.append(units.select("source", F.col("unit").withField("p", last).alias("unit")))
    decided = done[0]
    for d in done[1:]:
        decided = decided.unionAll(d)
    decided = decided.select("source", "unit.doc_id", "unit.size", (F.col("unit.whole") + F.col("unit.p").cast("long")).alias("copies"))
    result = plain.unionAll(decided)
    result = result.join(t.drop("n_docs"), F.col("source").eqNullSafe(F.col("target_source")))
    return result.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """``docs`` with each row as often as the mix takes it. Rows of one doc_id count as one document; without doc_id they go."""
    copies = sample_counts(docs, seed).groupBy("doc_id").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    return docs.join(copies, "doc_id").withColumn("_copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns)
