"""Vectors of one component."""

import numpy as np

from wavelake.llm import embed_tiles


def test_candidates_of_one_component():
    a, b = embed_tiles._candidates(np.array([[1.0], [-1.0]]), np.array([[1.0]]), 0.9)
    assert a.tolist() == [0] and b.tolist() == [0]


def test_vectors_of_one_component(spark):
    rows = [(0, [2.0]), (1, [5.0]), (2, [-1.0]), (3, [1.0, 2.0]), (4, [0.0]), (5, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {r.vec_id: (r.component_id, r.n_links) for r in embed_tiles.near_duplicates(frame).collect()}
    assert got == {0: (0, 1), 1: (0, 1), 2: (2, 0), 3: (3, 1), 4: (4, 0), 5: (3, 1)}
