"""Embedding near-duplicates: randomised-rotation binary codes with stored correction factors.

All vectors of a label are rotated by one seeded random rotation. A vector o keeps the signs of
its rotated form as a code, that is a unit vector c, and the correction factor a = <o, c>. For a
query q with s = <c, q>, s / a estimates <o, q> without bias over rotations, and the part of o
outside c bounds the error: <o, q> lies in a*s +- sqrt(1 - a^2) * sqrt(1 - s^2). The interval
always holds, so a pair whose interval ends below the threshold is rejected for good; all others
are recomputed exactly in double precision. No link is lost.

Work is dealt out by cells. Equal vectors of a label are one class, counted by multiplicity. Up to
``PIVOTS`` vectors, the same for all labels, divide a label into cells by the nearest pivot, each
label using as many of them as it has thousands of classes. Cells too far apart for a link
(triangle inequality with the cells' radii) never meet. A cell above ``BLOCK`` classes is
salted into blocks, and every pair of blocks that may link is one unit of work. A unit returns
link counts and a spanning forest, never the pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows with a
null label link with nothing; neither do vectors of different lengths. Such rows are their own
component. Rows without vec_id are returned with null component and kept false and do not link.
Rows that repeat a vec_id and vector count as copies of each other. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewtide.llm import arrays
from viewtide.llm.components import components
from viewtide.session import stage_table

PIVOTS = 256
BLOCK = 1024
QUERIES = 256
SLACK = 1e-9


def rotation(width: int, seed: int = 0) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng((seed, width)).standard_normal((width, width)))
    return q * np.sign(np.diag(r))


def encode(unit: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated unit vectors, their sign bits, and their correction factors."""
    turned = unit @ rotation(unit.shape[1], seed)
    return turned, turned >= 0, np.abs(turned).sum(1) / math.sqrt(unit.shape[1])


def bounds(turned: np.ndarray, bits: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and certain upper bounds of <o, q> for queries (rows of ``turned``) and coded vectors (columns)."""
    s = turned @ (np.where(bits, 1.0, -1.0) / math.sqrt(bits.shape[1])).T
    upper = factor * s + np.sqrt(np.maximum(0, 1 - factor**2)) * np.sqrt(np.maximum(0, 1 - s * s))
    return s / factor, upper


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return rows.flatten().to_numpy().astype(float).reshape(len(rows), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _place(pivots: dict[int, np.ndarray]):
    """Nearest pivot of each class and the angle to it; vectors of one batch may differ in length."""
    schema = pa.schema([("rep", pa.int64()), ("cell", pa.int64()), ("angle", pa.float64())])

    def task(batches):
        for b in batches:
            rep, wide, few = b.column("rep"), b.column("width").to_numpy(), b.column("pivots").to_numpy()
            cell, angle = np.zeros(len(rep), np.int64), np.zeros(len(rep))
            for w, k in set(zip(wide.tolist(), few.tolist(), strict=True)):
                rows = np.flatnonzero((wide == w) & (few == k))
                own = pivots[w][:k]
                near = _unit(_matrix(b.column("embedding").take(pa.array(rows)))) @ own.T
                cell[rows] = near.argmax(1)
                angle[rows] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([rep, pa.array(cell), pa.array(angle)], schema=schema)

    return task


def _links(threshold: float, seed: int):
    def task(table: pa.Table) -> pa.Table:
        rep, copies, block = (table.column(c).to_numpy() for c in ("rep", "copies", "block"))
        order = np.lexsort((rep, block))
        rep, copies, block = rep[order], copies[order], block[order]
        unit = _unit(_matrix(table.column("embedding").take(pa.array(order))))
        turned, bits, factor = encode(unit, seed)
        split = int(np.searchsorted(block, block[-1])) if block[0] != block[-1] else 0
        links = np.zeros(len(rep), np.int64)
        forest = arrays.Forest(len(rep))
        for first in range(0, split or len(rep), QUERIES):
            q = np.arange(first, min(first + QUERIES, split or len(rep)))
            o = np.arange(split, len(rep)) if split else np.arange(first, len(rep))
            i, j = np.nonzero(bounds(turned[q], bits[o], factor[o])[1] >= threshold - SLACK)
            i, j = q[i], o[j]
            i, j = i[i != j] if split else i[i < j], j[i != j] if split else j[i < j]
            for at in range(0, len(i), 1 << 16):
                x, y = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                good = (unit[x] * unit[y]).sum(1) >= threshold
                x, y = x[good], y[good]
                np.add.at(links, x, copies[y])
                np.add.at(links, y, copies[x])
                for a, z in zip(x.tolist(), y.tolist(), strict=True):
                    forest.join(a, z)
        root = np.array([forest.root(x) for x in range(len(rep))])
        out = np.flatnonzero(links)
        return pa.table({"a": rep[root[out]], "b": rep[out], "links": links[out]})

    return task


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, seed: int = 0) -> DataFrame:
    """vec_id, n_links, component_id, kept for ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    valid = rows.where(able).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    classes = valid.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = stage_table(classes.withColumn("width", F.size("embedding")), "vector-classes")
    members = valid.join(classes.drop("width"), ["label", "embedding"]).select("vec_id", "rep", "copies").distinct()
    groups = classes.groupBy("label", "width").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / BLOCK)).alias("pivots"))
    need = {r.width: r.most for r in groups.groupBy("width").agg(F.max("pivots").alias("most")).collect()}
    pivots, apart = {}, []
    for width, most in need.items():
        chosen = classes.where(F.col("width") == width).orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(int(most)).select("embedding").collect()
        pivots[width] = _unit(np.array([r[0] for r in chosen]))
        angles = np.arccos(np.clip(pivots[width] @ pivots[width].T, -1, 1))
        apart += [(width, p, q, float(angles[p, q])) for p in range(len(chosen)) for q in range(len(chosen))]
    same_label = groups.withColumnRenamed("label", "l").withColumnRenamed("width", "w")
    placed_in = classes.join(same_label, (F.col("label") == F.col("l")) & (F.col("width") == F.col("w"))).drop("l", "w")
    cells = placed_in.select("rep", "embedding", "width", "pivots").mapInArrow(_place(pivots), "rep long, cell long, angle double")
    cells = stage_table(cells.join(classes.select("rep", "label", "width"), "rep"), "vector-cells")
    reach = cells.groupBy("label", "width", "cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / BLOCK).alias("salts"))
    other = reach.select("label", "width", F.col("cell").alias("cell2"), F.col("radius").alias("radius2"), F.col("salts").alias("salts2"))
    between = spark.createDataFrame(apart, "width int, cell long, cell2 long, apart double")
    limit = math.acos(min(1.0, threshold)) + 1e-7
    near = reach.join(other, ["label", "width"]).join(between, ["width", "cell", "cell2"])
    near = near.where(F.col("apart") - F.col("radius") - F.col("radius2") <= limit)
    near = near.groupBy("label", "width", "cell").agg(F.first("salts").alias("salts"), F.collect_list(F.struct("cell2", "salts2")).alias("others"))
    here = F.struct("cell", F.pmod(F.xxhash64("rep", F.lit(seed + 1)), F.col("salts")).alias("salt"))
    blocks = F.flatten(
        F.transform("others", lambda o: F.transform(F.sequence(F.lit(0).cast("long"), o["salts2"] - 1), lambda s: F.struct(o["cell2"].alias("cell"), s.alias("salt"))))
    )
    spread = cells.join(near, ["label", "width", "cell"]).withColumn("here", here).select("rep", "label", "width", "here", F.explode(blocks).alias("there"))
    name = lambda c: F.concat_ws(".", F.col(c)["cell"], F.col(c)["salt"])
    first = F.when(F.col("here") <= F.col("there"), name("here")).otherwise(name("there"))
    last = F.when(F.col("here") <= F.col("there"), name("there")).otherwise(name("here"))
    units = spread.select("rep", name("here").alias("block"), F.concat_ws(":", F.col("label").cast("string"), "width", first, last).alias("unit"))
    held = classes.select("rep", "copies", "embedding")
    found = units.join(held, "rep").groupBy("unit").applyInArrow(_links(threshold, seed), "a long, b long, links long")
    found = stage_table(found, "vector-links")
    counts = found.groupBy(F.col("b").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b"), "vector-components").select(F.col("id").alias("rep"), "component")
    by_id = members.join(counts, "rep", "left").join(joined, "rep", "left")
    by_id = by_id.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    by_id = by_id.groupBy("vec_id").agg(F.max("n").alias("n"), F.min("component").alias("component"))
    out = rows.select("vec_id").join(by_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
