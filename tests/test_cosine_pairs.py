"""The similarity join over all embeddings, against brute force on vectors of which some are close."""

from __future__ import annotations

import numpy as np

from polycurate.operators import cosines
from polycurate.plans import catalog


def test_pairs_of_the_whole_table(spark, tmp_path):
    draw = np.random.default_rng(6)
    vectors = draw.normal(size=(1500, 16))
    vectors[1::10] = vectors[::10] + draw.normal(scale=0.1, size=(150, 16))  # close pairs
    vectors[5:800:40] = vectors[5]  # copies of one vector
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    matrix = np.asarray([v for _, v in rows])
    close = {(int(a), int(b)) for a, b in np.argwhere(np.triu(matrix @ matrix.T > 0.9, 1))}
    assert len(close) > 300
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert [r.pairs for r in catalog.QUERIES["cosine_pairs_gt_090"](spark, str(tmp_path)).collect()] == [len(close)]
    frame = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(r.a, r.b) for r in cosines.cosine_pairs(frame, "vec_id", "embedding", 0.9).collect()} == close
    unknown = spark.createDataFrame([(9999, None)], "vec_id long, embedding array<float>")
    assert [r.pairs for r in cosines.count_cosine_pairs(frame.union(unknown), "vec_id", "embedding", 0.9).collect()] == [len(close)]
    assert [r.pairs for r in cosines.count_cosine_pairs(frame.limit(0), "vec_id", "embedding", 0.9).collect()] == [0]


def test_clustered_vectors_stay_in_their_cells(spark, monkeypatch):
    draw = np.random.default_rng(9)
    centres = np.linalg.qr(draw.normal(size=(16, 16)))[0]
    vectors = np.repeat(centres, 120, axis=0) + draw.normal(scale=0.05, size=(1920, 16))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[7] = 0.0
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    expected = {(int(a), int(b)) for a, b in np.argwhere(np.triu(vectors @ vectors.T > 0.9, 1))}
    monkeypatch.setattr(cosines, "TILE_NUMBERS", 1024)  # tiles of 64 vectors, so about 30 cells
    monkeypatch.setattr(cosines, "VISITORS", 8)
    assert {(r.a, r.b) for r in cosines.cosine_pairs(frame, "id", "v", 0.9).collect()} == expected
    assert cosines.count_cosine_pairs(frame, "id", "v", 0.9).first().pairs == len(expected)
    index = cosines.Index(cosines._rows(frame, "id", "v", False), 0.9)
    visits = index.meetings().filter("not resident").count()
    assert visits < 1920 * index.tiles.sum() / 2 / 5  # of the visits that all pairs of tiles would need


def test_vectors_that_are_not_of_length_one(spark, monkeypatch):
    draw = np.random.default_rng(10)
    vectors = draw.normal(size=(400, 4)) * draw.uniform(0.2, 1.5, size=(400, 1))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    monkeypatch.setattr(cosines, "TILE_NUMBERS", 256)
    expected = {(int(a), int(b)) for a, b in np.argwhere(np.triu(vectors @ vectors.T > 2.0, 1))}
    assert {(r.a, r.b) for r in cosines.cosine_pairs(frame, "id", "v", 2.0).collect()} == expected
