import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpgraph.llm import vectors as V

SCHEMA = "id long, node_id long, model string, dim int, embedding array<float>, embedded_at int"


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    out = [base, base + 0.25 * rng.standard_normal(base.shape) * np.linalg.norm(base, axis=1, keepdims=True) / np.sqrt(dim)]
    out.append(rng.standard_normal((n - 2 * len(base), dim)))
    return np.concatenate(out).astype("f4") * rng.uniform(0.2, 3, (n, 1)).astype("f4")


def frame_of(spark, matrix, model="m"):
    return spark.createDataFrame([(i, i, model, matrix.shape[1], row.tolist(), 1) for i, row in enumerate(matrix)], SCHEMA)


def brute(matrix, k, least):
    unit = matrix.astype("f8") / np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -9)
    top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(unit)) for j in top[i] if scores[i, j] >= least}


@pytest.mark.parametrize("dim", [24, 48])
def test_pairs_equal_brute_force(spark, dim):
    matrix = clustered(1500, dim, dim)
    got = {(r["node_a"], r["node_b"]) for r in V.similar_pairs(frame_of(spark, matrix), cell_rows=150).collect()}
    want = {(min(p), max(p)) for p in brute(matrix, 5, 0.9)}
    assert not got - want and len(got & want) >= 0.98 * len(want) > 100


def test_search_recall(spark):
    matrix = clustered(1200, 32, 5)
    found = V.search_vectors(frame_of(spark, matrix), F.col("node_id") % 50 == 0, k=10, block_rows=300)
    got = {(r["node_id"], r["other_id"]) for r in found.collect()}
    want = {p for p in brute(matrix, 10, -2) if p[0] % 50 == 0}
    assert len(want) == 240 and len(got & want) >= 0.9 * len(want)


def test_the_bound_holds(spark):
    rng = np.random.default_rng(1)
    data = rng.standard_normal((400, 64)).astype("f4")
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    centre, turn = data.mean(axis=0), V.rotation(64)
    packed, length, fit = V.encode(data, centre, turn)
    guess, width = V.estimate(packed, length, fit, data[:50], centre, turn, 2.6)
    assert packed.nbytes == 400 * 8 and (np.abs(guess - data[:50] @ data.T) <= width).mean() > 0.985
    exact, _ = V.estimate(packed, length, fit, data[:50], centre, turn, 1.0)
    assert np.abs(exact - guess).max() < 1e-5 and np.corrcoef(guess.ravel(), (data[:50] @ data.T).ravel())[0, 1] > 0.75


def test_the_exact_mode(spark):
    matrix = clustered(600, 40, 3)
    got = {(r["node_a"], r["node_b"]) for r in V.similar_pairs(frame_of(spark, matrix), cell_rows=1000, sureness=float("inf")).collect()}
    assert got == {(min(p), max(p)) for p in brute(matrix, 5, 0.9)}
    recall = V.search_recall(frame_of(spark, matrix), F.col("node_id") % 50 == 0).collect()
    assert [r["exact"] for r in recall] == [120] and recall[0]["recall"] >= 0.95


def test_hot_and_cold_ties_follow_one_rule(spark, monkeypatch):
    """Equal vectors have the next larger ids, then round to the smallest, whether their group is hot or not."""
    rows = [(i, i * 3, "m", 2, [1.0, 1.0], 1) for i in range(150)]
    monkeypatch.setattr(V, "HOT_LEAST", 10**6)
    cold = {(r["node_id"], r["other_id"]) for r in V.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    monkeypatch.setattr(V, "HOT_LEAST", 64)
    hot = {(r["node_id"], r["other_id"]) for r in V.similar_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert hot == cold and len(hot) == 750 and (447, 0) in hot


def test_bad_rows_have_no_neighbour(spark):
    nan = float("nan")
    rows = [(1, 1, "m", 2, [1.0, 0.0], 1), (2, 2, "m", 2, [1.0, 0.0], 1), (3, 3, "m", 2, [0.0, 0.0], 1), (4, 4, "m", 2, [nan, 1.0], 1), (5, 5, "m", 3, [1.0, 0.0], 1), (6, 6, "m", None, None, 1), (7, None, "m", 2, [1.0, 0.0], 1), (8, 8, None, 2, [1.0, 0.0], 1), (9, 9, "m", 2, [None, 1.0], 1), (10, 10, "x", 2, [1.0, 0.0], 1), (11, 11, "m", 2, [1.0, 0.0], None), (1, 1, "m", 2, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"place": F.lit(1), "members": F.lit("x"), "h1": F.lit(0), "vec": F.lit("clash")})
    assert {(r["model"], r["node_a"], r["node_b"]) for r in V.similar_pairs(frame).collect()} == {("m", 1, 2), ("m", 1, 11), ("m", 2, 11)}


def test_the_latest_row_counts(spark):
    rows = [(1, 1, "m", 2, [1.0, 0.0], 1), (2, 1, "m", 2, [0.0, 1.0], 2), (3, 2, "m", 2, [2.0, 0.0], 1), (4, 3, "m", 2, [0.0, 3.0], 1)]
    assert [(r["node_a"], r["node_b"]) for r in V.similar_pairs(spark.createDataFrame(rows, SCHEMA)).collect()] == [(1, 3)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert V.similar_pairs(empty).count() == 0 and V.search_vectors(empty, F.lit(True)).count() == 0


def test_ties_of_up_to_eleven_are_all_paired(spark):
    rows = [(i, i, "m", 2, [1.0, 1.0], 1) for i in range(11)]
    assert V.similar_pairs(spark.createDataFrame(rows, SCHEMA)).count() == 55


def test_a_third_of_equal_vectors_stays_bounded(spark):
    matrix = clustered(2000, 16, 9)
    matrix[::3] = matrix[0]
    found = V.similar_vectors(frame_of(spark, matrix), cell_rows=200, block_rows=256)
    per = found.groupBy("node_id").count()
    hot = per.where(F.col("node_id") % 3 == 0)
    assert hot.count() == len(matrix[::3]) and hot.where("count <> 5").count() == 0 and found.count() <= 5 * len(matrix)
