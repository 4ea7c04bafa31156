"""Exact join of vectors by cosine, in which vectors meet only where the bound allows it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors that serve as pivots, members of a block, and room for rounding of angles.
PIVOTS = 64
BLOCK = 4096
ROUNDING = 1e-6
#: Blocks of a band, unless they had more members than the second number; places a vector may have on average; rows compared at once.
BLOCKS, MOST = 8, 65_536
PLACES = 8
STRIP = 512


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def members(rows: DataFrame, row_id: str, vector: str, least: float, group: Sequence[str] = (), pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(group, cell, band, bi, bj, blk, home, id, unit vector): which vectors meet, as members of units of two blocks.

    A vector's home is its nearest pivot. If the angle of two vectors is at
    most t, their angles to a pivot differ by at most t, so a cell is cut into
    bands of width t and only neighbouring bands meet; and a vector within t
    of one whose home is p has an angle to p of at most t plus the largest
    angle in that cell, and of at most 2 t plus the angle to its own home.
    Where both allow it, it visits the cell (of two cells only the later one
    is visited). Pivots are at most ``pivots`` vectors, drawn by a checksum;
    they and a number for each are all that reaches the driver. Members of a
    band are dealt to blocks by a checksum, and each pair of blocks is a unit.
    A band has at most ``BLOCKS`` blocks until these have ``MOST`` members, so
    a vector is sent to a bounded number of units however many there are.
    Where the angle is so wide that vectors would have more than ``PLACES``
    places on average or half of all pairs would meet, a group is one band.
    """
    t = float(np.arccos(np.clip(least, -1.0, 1.0))) + ROUNDING
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v))
    unit = rows.select(*group, F.col(row_id).alias("id"), x.alias("_x")).withColumn("_n", norm)
    unit = unit.where((F.col("_n") > 0) & ~F.isnan("_n") & (F.col("_n") < F.lit(float("inf")))).withColumn("_x", F.transform("_x", lambda v: v / F.col("_n"))).drop("_n")
    chosen = unit.select("_x").distinct().orderBy(F.xxhash64("_x"), "_x").limit(pivots).collect()
    centres = np.array([r["_x"] for r in chosen]) if chosen else np.zeros((0, 1))

    def radii(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.full(len(centres), -1.0)
        for b in batches:
            if b.num_rows:
                angles = _angles(_matrix(b.column(0)), centres)
                home = angles.argmin(axis=1)
                np.maximum.at(most, home, angles[np.arange(len(home)), home])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(centres)), pa.int32()), pa.array(most)], names=["cell", "most"])

    radius = np.full(len(centres), -1.0)
    for r in unit.select("_x").mapInArrow(radii, "cell int, most double").groupBy("cell").agg(F.max("most").alias("most")).collect():
        radius[r["cell"]] = r["most"]

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            angles = _angles(_matrix(b.column("_x")), centres)
            home = angles.argmin(axis=1)
            own = angles[np.arange(len(home)), home]
            later = np.arange(len(centres)) > home[:, None]
            row, cell = np.nonzero(later & (angles <= radius + t) & (angles <= own[:, None] + 2 * t))
            band = np.floor(angles / t).astype(np.int64)
            at = np.arange(len(home))
            own_band = band[at, home]
            # at home; in the next band of the own cell; in the bands around its angle in other cells
            parts = [(at, home, own_band, True), (at, home, own_band + 1, False)]
            parts += [(row, cell, band[row, cell] + d, False) for d in (-1, 0, 1)]
            rows_, cells, bands = (np.concatenate([p[k] for p in parts]) for k in range(3))
            homes = np.concatenate([np.full(len(p[0]), p[3]) for p in parts])
            keep = bands >= 0
            placed = b.take(pa.array(rows_[keep]))
            yield pa.RecordBatch.from_arrays([*placed.columns, pa.array(cells[keep], pa.int32()), pa.array(bands[keep], pa.int32()), pa.array(homes[keep])], names=[*b.schema.names, "cell", "band", "home"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in unit.schema.fields)
    placed = unit.mapInArrow(places, f"{fields}, cell int, band int, home boolean")
    key = [*group, "cell", "band"]
    n, home = F.count(F.lit(1)), F.count_if("home")
    per = placed.groupBy(*key).agg(n.alias("n"), home.alias("h")).where("h > 0").groupBy(*group).agg(F.sum("h").alias("all"), F.sum("n").alias("n"), F.sum(F.col("h") * (F.col("n") - F.col("h") / 2)).alias("pairs"))
    cost = per.agg(F.sum("all").alias("all"), F.sum("n").alias("n"), F.sum("pairs").alias("pairs"), F.sum(F.col("all") * F.col("all") / 2).alias("every")).first()
    if cost["all"] and (cost["n"] > PLACES * cost["all"] or cost["pairs"] > cost["every"] / 2):
        placed = unit.withColumns({"cell": F.lit(0), "band": F.lit(0), "home": F.lit(True)})
    sizes = placed.groupBy(*key).agg(F.least(F.ceil(n / block), F.greatest(F.lit(BLOCKS), F.ceil(n / MOST))).alias("_blocks"), home.alias("_homes")).where("_homes > 0")
    for k in key:
        sizes = sizes.withColumnRenamed(k, f"_{k}")
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    dealt = placed.join(sizes, same).drop(*[f"_{k}" for k in key], "_homes").withColumn("blk", F.pmod(F.xxhash64("id"), F.col("_blocks")))
    dealt = dealt.withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    return dealt.withColumns({"bi": F.least("blk", "_o"), "bj": F.greatest("blk", "_o")}).drop("_o", "_blocks")


def similar_pairs(rows: DataFrame, row_id: str, vector: str, least: float, group: Sequence[str] = (), pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(group, src, dst, cosine) of all pairs, src < dst, of a group (or of all rows) with a cosine of at least ``least``.

    Each pair that ``members`` lets meet is compared once. Null or zero
    vectors and such with null or non-finite components take no part; all
    vectors have the same length.
    """
    met = members(rows, row_id, vector, least, group, pivots, block)
    kind = met.schema["id"].dataType.simpleString()
    kinds = {g: met.schema[g].dataType.simpleString() for g in group}

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = pa.Table.from_batches(list(batches))
        bi, bj = key[-2].as_py(), key[-1].as_py()
        x = _matrix(unit.column("_x").combine_chunks())
        ids, home, blk = unit.column("id").combine_chunks(), unit.column("home").to_numpy(), unit.column("blk").to_numpy()
        every, b = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        right = x[b].T
        for k in range(0, len(every), STRIP):
            a = every[k : k + STRIP]
            after = k + 1 if bi == bj else 0  # within a block a row meets those behind it
            cosine = x[a] @ right[:, after:]
            near = (cosine >= least) & (home[a][:, None] | home[b[after:]][None, :])
            if bi == bj:
                near = np.triu(near)
            i, j = np.nonzero(near)
            for m in range(0, len(i), 1 << 20):
                u, v = i[m : m + (1 << 20)], j[m : m + (1 << 20)]
                columns = [pa.array([key[g].as_py()] * len(u), unit.schema.field(name).type) for g, name in enumerate(group)]
                columns += [ids.take(pa.array(a[u])), ids.take(pa.array(b[after:][v])), pa.array(cosine[u, v])]
                yield pa.RecordBatch.from_arrays(columns, names=[*group, "a", "b", "cosine"])

    schema = "".join(f"`{g}` {k}, " for g, k in kinds.items()) + f"a {kind}, b {kind}, cosine double"
    found = met.groupBy(*group, "cell", "band", "bi", "bj").applyInArrow(run, schema)
    return found.where(F.col("a") != F.col("b")).select(*group, F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "cosine")
