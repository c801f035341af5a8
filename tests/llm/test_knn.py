import math
import random

from precolens.llm import knn

NAN, INF = float("nan"), float("inf")


def brute(rows, k=10):
    good = [
        (i, [math.floor(1024 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = set()
    for i, q in good:
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in good if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(found, 1)}
    return out


def search(spark, rows, k=10):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as id", "2 as v", "3 as no")
    v = knn.vectors(df)
    return [tuple(r) for r in knn.top_k(v.where("id % 100 = 0"), v, k).collect()]


def test_against_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.choice([-4, 4]) for _ in range(8)] for _ in range(6)]
    rows = [(i, [rng.gauss(c, 0.2) for c in rng.choice(centres)]) for i in range(900)]
    rows += [(i, [1.0] * 8) for i in range(900, 1010)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2002, [NAN] * 8), (2003, [INF] * 8), (None, [1.0] * 8), (2100, [9.0, 9.0])]
    rows = [(i, v and [None if x is None else struct_float(x) for x in v]) for i, v in rows]
    got = search(spark, rows)
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def struct_float(x):
    """x as a 32-bit float, as the column holds it."""
    import struct

    return struct.unpack("f", struct.pack("f", x))[0] if math.isfinite(x) else x


def test_pruning_sends_close_groups_only(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS_PER_BLOCK", 100)
    monkeypatch.setattr(knn, "QUERIES_PER_BLOCK", 2)
    rng = random.Random(2)
    rows = [(i, [struct_float(100.0 * (i % 5 == j) + rng.random()) for j in range(5)]) for i in range(1000)]
    assert set(search(spark, rows)) == brute(rows)


def test_large_values_stay_exact(spark):
    rows = [(i, [float(2**20 + i % 7), float(2**21 - i), 1.0]) for i in range(0, 300)]
    assert set(search(spark, rows, 3)) == brute(rows, 3)


def test_repeated_rows_few_rows_and_empty_tables(spark):
    assert search(spark, []) == []
    assert search(spark, [(100, [1.0])]) == []
    assert search(spark, [(1, [1.0])]) == []
    got = search(spark, [(100, [1.0]), (100, [1.0]), (3, [2.0]), (3, [2.0]), (7, []), (5, [-1.0])])
    assert sorted(got) == [(100, 1, 3, 2 * 2**20), (100, 2, 3, 2 * 2**20), (100, 3, 7, 0), (100, 4, 5, -(2**20))]


def test_one_id_in_a_third_of_the_rows(spark, monkeypatch):
    """Whether its vectors are alike or not, what the driver gets stays small and the rows are dealt to several tasks."""
    monkeypatch.setattr(knn, "ROWS_PER_BLOCK", 200)
    rng = random.Random(6)
    far = [(100, [float(rng.randrange(20)), 1.0, struct_float(i / 16)]) for i in range(300)]
    rows = far + [(7, [3.0, 2.0, 1.0])] * 300 + [(i, [float(rng.randrange(9)) for _ in range(3)]) for i in range(200, 500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = knn.vectors(df)
    pivots = knn.Pivots(*[knn._added(knn._sample(v, 4, 3), None)] * 2, 1e9, 3)
    near = knn._nearest(v, pivots, 4).collect()
    assert len(near) <= 16 and len({(r.cell, r.id) for r in near}) == len(near)
    queries = v.where("id % 100 = 0 and id >= 200")
    got = [tuple(r) for r in knn.top_k(queries, v, 10).collect()]
    want = set()
    for i, q in {(i, tuple(x)) for i, x in rows if i >= 200 and i % 100 == 0}:
        scores = sorted((-sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, x, strict=True)), j) for j, x in rows if j != i)
        want |= {(i, n, j, -s) for n, (s, j) in enumerate(scores[:10], 1)}
    assert set(got) == want and len(got) == len(want)
