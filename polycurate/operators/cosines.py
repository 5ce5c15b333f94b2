"""Pairs of vectors with a large cosine, exactly, over an index of reference points on the sphere.

1. Up to MOST_REFERENCES vectors, about one for each tile, are reference points, drawn so that they lie far from each other. Each
   vector's home is the cell of the nearest point. Cells are cut into rings by the angle to their point where they fill more than a
   tile, and rings that still do are dealt into tiles.
2. The angle between two vectors of a pair is at most that of the threshold. By the triangle inequality a vector can have a partner
   in a ring only if its angle to the ring's point is within that angle of the ring's least and greatest; to others it never goes.
3. In each tile its own vectors meet each other and the visitors, a bounded part of the visitors in each task, by matrix products.
   Of two tiles only the vectors of the first visit the second, so every pair meets once.

Equal vectors are one row with a count where only counts are asked for, so many copies of a vector make no work. Vectors spread evenly
over a sphere of many dimensions have no cell small enough to be passed by; then every vector visits half of the tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settled

MOST_REFERENCES = 1024
#: Vectors from which each reference point is chosen; rings of a cell, over half a turn.
CANDIDATES, RINGS = 4, 24
#: Numbers that the vectors of a tile have together, and how many times as many visitors meet a tile in one task.
TILE_NUMBERS, VISITORS = 1 << 18, 4
#: Rows that a task sends out at once, and places (vectors by tiles) that it looks at together.
SENT, PLACES = 4096, 1 << 23
#: Added to angles, for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _angles(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Of each vector to each point, which have length 1."""
    return np.arccos(np.clip(vectors @ points.T / np.linalg.norm(vectors, axis=1)[:, None], -1.0, 1.0))


def _rows(vectors: DataFrame, key: str, vector: str, classes: bool) -> DataFrame:
    """id, v, n, size: the vectors that can have a partner; with classes, equal ones as one row."""
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).dropna()
    rows = rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")) if classes else rows.withColumn("n", F.lit(1).cast("long"))
    size = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    return rows.select("id", "v", "n", size.alias("size")).filter("size > 0")


def _far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """count of the vectors, of length 1: the first, then always the one farthest from all that are chosen."""
    vectors = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    chosen, nearest = [], np.full(len(vectors), -np.inf)
    for _ in range(count):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, vectors @ vectors[chosen[-1]])
    return vectors[chosen]


def _ring(away: np.ndarray) -> np.ndarray:
    return np.minimum((away * (RINGS / np.pi)).astype(np.int64), RINGS - 1)


class Index:
    """Reference points and the rings of their cells. There are at most MOST_REFERENCES times RINGS of them, so the driver holds them.

    points; group: the ring group of each cell's ring; home, low, high, tiles of each group: its cell, least and greatest angle, number of tiles.
    """

    def __init__(self, rows: DataFrame, threshold: float):
        if threshold <= 0:
            raise ValueError("only positive thresholds bound an angle")
        known = rows.agg(F.count("*").alias("n"), F.max("size").alias("size"), F.max(F.size("v")).alias("numbers")).first()
        self.angle = math.acos(min(1.0, threshold / known["size"])) + SLACK if known["n"] else 0.0  # dot products of at most that length
        self.tile = max(64, TILE_NUMBERS // max(1, known["numbers"] or 1))
        count = min(MOST_REFERENCES, -(-known["n"] // self.tile))
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(CANDIDATES * count).select("v").collect()  # count is bounded
        self.points = _far_apart(np.array([r["v"] for r in drawn], float).reshape(len(drawn), known["numbers"] or 1), count)
        self.homes = settled(self._housed(rows), "homes")
        found = self.homes.groupBy("home", "ring").agg(F.min("away").alias("low"), F.max("away").alias("high"), F.count("*").alias("n")).collect()
        groups: list[list] = []
        self.group = np.zeros((count, RINGS), np.int64)
        for home, ring, low, high, n in sorted(found):
            if groups and groups[-1][0] == home and groups[-1][3] + n <= self.tile:
                groups[-1][2], groups[-1][3] = high, groups[-1][3] + n
            else:
                groups.append([home, low, high, n])
            self.group[home, ring] = len(groups) - 1
        self.home, self.low, self.high, sizes = (np.array([g[i] for g in groups], kind) for i, kind in enumerate((np.int64, float, float, np.int64)))
        self.tiles = -(-sizes // self.tile)

    def _housed(self, rows: DataFrame) -> DataFrame:
        """id, v, n, home, ring, away: each vector's cell and its angle to the cell's point."""
        points = self.points

        def house(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    angles = _angles(_matrix(batch.column("v")), points)
                    home = angles.argmin(axis=1)
                    away = angles[np.arange(len(home)), home]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(home), pa.array(_ring(away)), pa.array(away)], names=["id", "v", "n", "home", "ring", "away"])

        return rows.select("id", "v", "n").mapInArrow(house, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, n long, home long, ring long, away double")

    def meetings(self) -> DataFrame:
        """tile, part, resident, id, v, n: who meets in which task."""
        points, group, home, low, high, tiles = self.points, self.group, self.home, self.low - self.angle, self.high + self.angle, self.tiles
        parts = max(1, -(-self.homes.count() // (VISITORS * self.tile)))
        kind = self.homes.schema["id"].dataType.simpleString()

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            starts = np.concatenate([[0], np.cumsum(tiles)])
            of = np.repeat(np.arange(len(tiles)), tiles)
            step = max(1, PLACES // max(1, len(of)))
            for batch in (whole.slice(begin, step) for whole in batches for begin in range(0, len(whole), step)):
                mark = np.asarray(batch.column("mark")).view(np.uint64)
                angles = _angles(_matrix(batch.column("v")), points)[:, home]
                ring = group[np.asarray(batch.column("home")), np.asarray(batch.column("ring"))]
                own = starts[ring] + (mark % tiles[ring].astype(np.uint64)).astype(np.int64)
                part = (mark // np.uint64(1 << 20) % np.uint64(parts)).astype(np.int64)
                can = ((low <= angles) & (angles <= high))[:, of] & (np.arange(len(of)) > own[:, None])
                row, tile = np.nonzero(can)
                stays = np.repeat(np.arange(len(batch)), parts)
                times = pa.array(np.concatenate([stays, row]))
                where = [np.concatenate(x) for x in ((own[stays], tile), (np.tile(np.arange(parts), len(batch)), part[row]), (np.ones(len(stays), bool), np.zeros(len(row), bool)))]
                for at in range(0, len(times), SENT):
                    out = [pa.array(x[at : at + SENT]) for x in where] + [batch.column(c).take(times[at : at + SENT]) for c in ("id", "v", "n")]
                    yield pa.RecordBatch.from_arrays(out, names=["tile", "part", "resident", "id", "v", "n"])

        marked = self.homes.withColumn("mark", F.xxhash64("id"))
        return marked.mapInArrow(meet, f"tile long, part long, resident boolean, id {kind}, v array<double>, n long")


def _hits(group: pd.DataFrame, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, product) of the pairs of a task. Residents meet each other in the first part only."""
    matrix, at_home = np.vstack(group["v"].to_numpy()), np.flatnonzero(group["resident"].to_numpy())
    if not len(at_home):
        return
    away, first = np.flatnonzero(~group["resident"].to_numpy()), group["part"].iloc[0] == 0
    for rows, among in ((at_home, True), (away, False)):
        if among and not first:
            continue
        for begin in range(0, len(rows), 1024):
            own = rows[begin : begin + 1024]
            product = matrix[own] @ matrix[at_home].T
            x, y = np.nonzero(product > threshold)
            if among:
                x, y = x[keep := y > x + begin], y[keep]
            yield own[x], at_home[y], product[x, y]


def cosine_pairs(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(a, b, cosine), a < b, above the threshold. Null vectors have no pairs. For copies of one vector see `count_cosine_pairs`."""
    kind = vectors.schema[key].dataType.simpleString()

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        ids, found = group["id"].to_numpy(), list(_hits(group, threshold))
        if not found:
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        x, y, product = (np.concatenate([f[i] for f in found]) for i in range(3))
        return pd.DataFrame({"a": np.minimum(ids[x], ids[y]), "b": np.maximum(ids[x], ids[y]), "cosine": product})

    index = Index(settled(_rows(vectors, key, vector, classes=False), "vectors"), threshold)
    return index.meetings().groupBy("tile", "part").applyInPandas(pairs, f"a {kind}, b {kind}, cosine double")


def count_cosine_pairs(vectors: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """pairs: how many pairs of rows `cosine_pairs` would find. Tasks return their counts, and equal vectors count as one row with a weight."""
    rows = settled(_rows(vectors, key, vector, classes=True), "vectors")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].to_numpy()
        return pd.DataFrame({"n": [sum(int((n[x] * n[y]).sum()) for x, y, _ in _hits(group, threshold))]})

    counts = Index(rows, threshold).meetings().groupBy("tile", "part").applyInPandas(count, "n long")
    copies = rows.filter(F.col("size") > threshold).select((F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("n"))
    return counts.union(copies).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
