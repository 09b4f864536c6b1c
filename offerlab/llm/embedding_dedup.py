"""Embedding near-duplicates: spherical k-means cells, blocked cosines, one representative per group.

Equal vectors of a label meet first, so blocks hold distinct vectors with
their number of copies; each has a number of its own, so an id may repeat. Centroids come from a bounded sample (``sample_rows`` vectors, the
smallest hashes of their ids; at most ``max_cells`` centroids), cells hold
every vector: each has its home in the cell of its nearest centroid and
visits every cell that could be home to a vector within the angle of the
threshold. By geometry a vector y of home h can only have such a neighbour
in cell c if y . (h - c) / |h - c| <= sin(angle), so no link is lost; the
bound prunes well for vectors that form clusters and not at all for
structureless ones, where the work is that of all pairs of a label.

A cell's homes and its other rows are cut into blocks by hash (``block``
rows each), so a crowded cell becomes many tasks of one block pair. A block
pair is one matrix product in double precision; it returns counts per home
row and links that span what it found, never the pairs.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component, rows with a null label or id, link with nothing
(n_links 0, a component of their own); vectors of different sizes do not
link; repeated rows are other vectors with the same id and link like those;
an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from offerlab.llm.blocks import bounds, grouped
from offerlab.llm.common import need, shuffle_width, written
from offerlab.llm.graph import connected_components


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is scaled out first so that no square over- or underflows."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_kmeans(x: np.ndarray, cells: int, steps: int = 20, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(cells, len(x)), replace=False)]
    for _ in range(steps):
        home = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), centres)
        if np.abs(moved - centres).max() < 1e-9:
            break
        centres = moved
    return centres


def cells_of(x: np.ndarray, centres: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """(home cell, matrix of the cells visited, home included)"""
    dots = x @ centres.T
    home = dots.argmax(axis=1)
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2)
    margin = dots[np.arange(len(x)), home][:, None] - dots
    visits = margin <= apart[home] * math.sin(angle) + 1e-9
    visits[np.arange(len(x)), home] = True
    return home, visits


def block_links(home: np.ndarray, other: np.ndarray, home_id: np.ndarray, other_id: np.ndarray, copies: np.ndarray, threshold: float):
    """Links of each home row to other rows (copies counted) and spanning links."""
    near = (home @ other.T) >= threshold
    near &= home_id[:, None] != other_id[None, :]
    count = near @ copies.astype(np.float64)
    seen = np.full(len(other), -1)
    a, b = [], []
    for i in np.flatnonzero(near.any(axis=1)):
        linked = np.flatnonzero(near[i])
        groups, first = np.unique(seen[linked], return_index=True)
        new = linked if groups[0] == -1 and len(groups) == 1 else np.r_[linked[seen[linked] == -1], linked[first[groups >= 0]]]
        a.append(np.full(len(new), home_id[i]))
        b.append(other_id[new])
        seen[linked] = i
    none = np.zeros(0, dtype=np.int64)
    return count.astype(np.int64), np.concatenate(a) if a else none, np.concatenate(b) if b else none


def _vectors(column: pa.Array) -> np.ndarray:
    return unit_rows(np.array(column.to_pylist(), dtype=np.float64))


def dedup_embeddings(df: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93,
                     cell_rows: int = 2048, max_cells: int = 1024, sample_rows: int = 20_000, block: int = 2048) -> DataFrame:
    """One row per row of ``df``: vec, n_links, component_id, kept."""
    need(df, vec, embedding, label)
    spark, angle = df.sparkSession, math.acos(threshold)
    rows = df.select(F.col(vec).alias("_id"), F.col(embedding).cast("array<double>").alias("_v"), F.col(label).cast("string").alias("_l"))
    finite = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = (F.col("_id").isNotNull() & F.col("_l").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0)
              & finite & F.exists("_v", lambda x: x != 0.0))
    rows = rows.withColumn("_ok", F.coalesce(usable, F.lit(False)))
    distinct = (rows.where("_ok").groupBy("_l", "_v").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
                .select(F.monotonically_increasing_id().alias("id"), "first", "n", F.concat_ws(":", F.size("_v"), "_l").alias("space"), F.col("_v").alias("v")))
    distinct = written(distinct, "distinct-vectors")

    dims = {r["d"]: r["m"] for r in distinct.groupBy("space", F.size("v").alias("d")).count().groupBy("d").agg(F.max("count").alias("m")).collect()}
    centres = {}
    for d, most in dims.items():  # vectors of one table have one size as a rule
        k = min(max_cells, -(-most // cell_rows))
        sample = distinct.where(F.size("v") == d).orderBy(F.xxhash64("first"), "first", "id").limit(sample_rows).select("v").toPandas()["v"]
        centres[d] = spherical_kmeans(unit_rows(np.array(sample.tolist(), dtype=np.float64)), k)
    shared = spark.sparkContext.broadcast(centres)  # at most max_cells centroids

    def place(batches):
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            size = np.array([len(x) for x in v.to_pylist()])
            for d in np.unique(size):
                at = pa.array(np.flatnonzero(size == d))
                part = batch.take(at)
                home, visits = cells_of(_vectors(part.column("v")), shared.value[int(d)], angle)
                cells = [np.flatnonzero(x).tolist() for x in visits]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home, pa.int32()), pa.array(cells, pa.list_(pa.int32()))],
                                                 [*part.schema.names, "home", "cells"])

    placed = written(distinct.select("id", "n", "space", "v").mapInArrow(place, "id long, n long, space string, v array<double>, home int, cells array<int>"), "placed")
    sizes = placed.select("space", "home", F.explode("cells").alias("cell")).groupBy("space", "cell").agg(
        F.ceil(F.sum((F.col("home") == F.col("cell")).cast("long")) / block).cast("int").alias("home_blocks"),
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("other_blocks"))
    spread = placed.select("*", F.explode("cells").alias("cell")).join(sizes, ["space", "cell"]).where("home_blocks > 0")
    one = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id"), F.col(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    homes = spread.where("home = cell").select("*", one("h", "home_blocks").alias("hb"), F.explode(every("other_blocks")).alias("ob"), F.lit(True).alias("is_home"))
    others = spread.select("*", F.explode(every("home_blocks")).alias("hb"), one("o", "other_blocks").alias("ob"), F.lit(False).alias("is_home"))
    pairs = homes.unionByName(others.select(*homes.columns)).select(
        F.xxhash64("space", "cell", "hb", "ob").alias("key"), F.concat_ws("/", "space", "cell", "hb", "ob").alias("name"), "is_home", "id", "n", "v")

    def compare(table: pa.Table):
        names = np.array(table.column("name").to_pylist(), dtype=object)
        is_home = table.column("is_home").to_numpy(zero_copy_only=False)
        ids, copies = table.column("id").to_numpy(), table.column("n").to_numpy()
        vectors = table.column("v").to_pylist()
        for s, size in zip(*bounds(table.column("key").to_numpy())):
            for name in set(names[s:s + size]):  # one name, unless two keys collide
                at = np.flatnonzero(names[s:s + size] == name) + s
                h, o = at[is_home[at]], at[~is_home[at]]
                if not len(h) or not len(o):
                    continue
                count, a, b = block_links(unit_rows(np.array([vectors[i] for i in h], dtype=np.float64)),
                                          unit_rows(np.array([vectors[i] for i in o], dtype=np.float64)), ids[h], ids[o], copies[o], threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[ids[h], a]), pa.array(np.r_[np.full(len(h), None), b], pa.int64()),
                                                  pa.array(np.r_[count, np.zeros(len(a), dtype=np.int64)])], ["a", "b", "links"])

    found = written(grouped(pairs, "key", compare, "a long, b long, links long", shuffle_width(spark)), "links")
    counts = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "id")
    smallest = groups.join(distinct.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("component_id"))
    groups = groups.join(smallest, "component").select("id", "component_id")
    result = (distinct.join(counts, "id", "left").join(groups, "id", "left")
              .select("space", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component_id", "first").alias("component_id")))
    joined = rows.withColumn("space", F.when(F.col("_ok"), F.concat_ws(":", F.size("_v"), "_l"))).withColumnRenamed("_v", "v").join(
        result, ["space", "v"], "left")
    return joined.select(F.col("_id").alias(vec), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         F.coalesce("component_id", "_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(vec) == F.col("component_id"), F.lit(False)))
