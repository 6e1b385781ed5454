"""Copies of a vector to the cells around it."""

import numpy as np

from kelpgraph.llm import vectors as V


def test_a_vector_goes_to_every_cell_within_reach(spark):
    index = {("m", 8): V.CellIndex(8, np.eye(8, dtype="f4"), np.ones(8, "i4"))}
    vector = np.full(8, 8**-0.5, "f4")
    packed = spark.createDataFrame([("m", 1, bytearray(vector.tobytes()))], "model string, node_id long, vec binary")
    rows = V.assign_cells(packed, index, min_score=0.9).collect()
    assert sorted(r["cell"] for r in rows) == list(range(8)) and sum(r["home"] for r in rows) == 1
