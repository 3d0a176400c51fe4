import itertools

import numpy as np
from pyspark.sql import functions as F

from loomery.llm import neighbours
from loomery.llm.neighbours import nearest, probe_order


def brute(rows, is_query, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if is_query(q):
            best = {}
            for i, b in good:
                if i != q and len(a) == len(b):
                    best[i] = max(best.get(i, -2), float((a * b).sum() / (np.linalg.norm(a) * np.linalg.norm(b))))
            for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]):
                out[q, r + 1] = (i, s)
    return out


def rows_of(n=1500, dim=24):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, dim)).astype(np.float32)
    x[100:400] = x[100] + 0.001 * rng.standard_normal((300, dim))
    return [(i, [float(v) for v in r]) for i, r in enumerate(x)]


ODD = [(2000, None), (2050, []), (2100, [0.0] * 24), (2150, [float("nan")] * 24), (2200, [float("inf")] + [1.0] * 23), (2250, [1.0] * 5), (None, [1.0] * 24), (2300, [1.0] * 24), (2300, [2.0] * 24), (2301, [3.0] * 24)]


def test_recall_and_scores(spark):
    rows = rows_of() + ODD
    frame = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    out = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest(frame, F.col("id") % 50 == 0).collect()}
    want = brute(rows, lambda i: i % 50 == 0)
    asked = {q for q, _ in want}
    assert out.keys() == want.keys()
    found = sum(len({out[q, r][0] for r in range(1, 6) if (q, r) in out} & {want[q, r][0] for r in range(1, 6) if (q, r) in want}) for q in asked)
    assert found >= 0.9 * len(want)
    exact = {i: np.array(v, np.float32).astype(float) for i, v in rows[:1500]}
    for (q, _), (i, s) in out.items():
        if q < 1500 and i < 1500:
            assert abs(s - exact[q] @ exact[i] / np.linalg.norm(exact[q]) / np.linalg.norm(exact[i])) < 1e-12


def test_blocks_change_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(rows_of(500, 8), "vec_id long, embedding array<float>")
    plain = sorted(map(tuple, nearest(frame, F.col("id") % 10 == 0).collect()))
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 3)
    assert sorted(map(tuple, nearest(frame, F.col("id") % 10 == 0).collect())) == plain


def test_few_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [-1.0, 0.1])], "vec_id long, embedding array<double>")
    out = [(r.query_id, r.rank, r.vec_id) for r in nearest(frame, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert out == [(0, 1, 50), (0, 2, 7), (50, 1, 7), (50, 2, 0)]
    assert nearest(frame.limit(0), F.col("id") % 50 == 0).count() == 0


def test_probe_order_is_by_cost():
    fraction = np.array([0.1, 0.5, 0.8])
    cost = lambda moves: sum(fraction[i] ** 2 if d < 0 else (1 - fraction[i]) ** 2 for i, d in moves)
    got = probe_order(fraction, 27)
    every = [tuple((i, d) for i, d in enumerate(x) if d) for x in itertools.product((-1, 0, 1), repeat=3)]
    assert sorted(map(sorted, got)) == sorted(map(sorted, every))
    costs = [cost(m) for m in got]
    assert costs == sorted(costs)


def shown(spark, rows, is_query):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return {(r.query_id, r.rank): (r.vec_id, round(r.score, 9)) for r in nearest(frame, is_query).collect()}


def test_equal_and_parallel_vectors_go_by_id(spark):
    rng = np.random.default_rng(3)
    one = rng.standard_normal(16)
    for scale in (lambda i: 1.0, lambda i: 1.0 + i * 0.37):
        rows = [(int(i), [float(x) for x in one * scale(i)]) for i in rng.permutation(100)]
        out = shown(spark, rows, F.col("id") % 50 == 0)
        assert [out[0, r][0] for r in range(1, 6)] == [1, 2, 3, 4, 5]
        assert [out[50, r][0] for r in range(1, 6)] == [0, 1, 2, 3, 4]
        assert len(out) == 10


def test_rows_of_one_id_leave_room_for_others(spark):
    rng = np.random.default_rng(4)
    one = rng.standard_normal(16)
    near = lambda by: [float(x) for x in one + by * rng.standard_normal(16)]
    rows = [(0, near(0.0))] + [(7, near(0.0001)) for _ in range(30)] + [(i, near(0.02 * i)) for i in range(10, 16)]
    out = shown(spark, rows, F.col("id") == 0)
    assert out == {key: (i, round(s, 9)) for key, (i, s) in brute(rows, lambda i: i == 0).items()}
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    got = [vec for _, vec, _ in neighbours.best_of(ids[:1], matrix[:1], ids, matrix, 5)]
    assert len(set(got)) == len(got) == 5 and got[0] == 7


def test_low_recall_takes_the_exact_way(spark, monkeypatch):
    rows = rows_of(400, 24)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    monkeypatch.setattr(neighbours, "MAX_PROBES", 1)
    monkeypatch.setattr(neighbours, "TABLES", 1)
    probes, recall = neighbours.probes_needed(neighbours.usable(frame, "vec_id", "embedding"), F.col("id") % 50 == 0, 5)
    assert probes == 1 and recall < neighbours.LEAST_RECALL
    got = {(r.query_id, r.rank): r.vec_id for r in nearest(frame, F.col("id") % 50 == 0).collect()}
    assert got == {k: i for k, (i, _) in brute(rows, lambda i: i % 50 == 0).items()}


def test_scores_a_hair_apart_go_by_score(spark):
    """Cosines that differ by some 1e-13 are no ties: the nearer comes first, whatever the ids."""
    rows = [(0, [1.0, 0.0, 0.0])] + [(i, [1.0, (9 - i) * 1e-7, 0.0]) for i in range(1, 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = {r.rank: (r.vec_id, r.score) for r in nearest(frame, F.col("id") == 0).collect()}
    assert [out[r][0] for r in range(1, 6)] == [7, 6, 5, 4, 3]
    assert all(1e-15 < out[r][1] - out[r + 1][1] < 1e-12 for r in range(1, 5))


def test_exact_way_in_parts(spark, monkeypatch):
    rows = rows_of(420, 6) + [(1000 + i, [float(i % 7), 1.0]) for i in range(120)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(neighbours, "LEAST_RECALL", 2.0)
    want = {k: i for k, (i, _) in brute(rows, lambda i: i % 10 == 0).items()}
    for held, block in ((64 << 20, 1024), (2000, 7)):
        monkeypatch.setattr(neighbours, "HELD_BYTES", held)
        monkeypatch.setattr(neighbours, "BLOCK_QUERIES", block)
        told = {}
        assert {(r.query_id, r.rank): r.vec_id for r in nearest(frame, F.col("id") % 10 == 0, told=told).collect()} == want
        assert told["probes"] >= 1 and 0 <= told["recall"] <= 1
