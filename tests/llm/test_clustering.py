"""Ball k-means against comparing every vector with every centroid."""

import hashlib
import math
import random

import duckdb
import pyarrow.parquet as pq
import pytest

from tidemark.llm import queries
from tidemark.llm.ball_kmeans import Balls, ball_kmeans

from .fixtures import collected, ordered

NAMES = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
MOST = (1 << 63) - 1


def by_hand(known, k, rounds, size, scale):
    kept = []
    for i, x in known:
        if x is not None and len(x) == size and all(y is not None and math.isfinite(y) for y in x):
            v = [math.floor(scale * y) for y in x]
            if all(-(1 << 31) <= y < 1 << 31 for y in v):
                kept.append((i, v))
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    square = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    nearest = lambda v: min((square(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(nearest(v)[1], []).append(v)
        for j, vs in members.items():
            centroids[j] = [sum(xs) // len(vs) for xs in zip(*vs, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    of = [sum(min(d, MOST) for _, c, d in found if c == j) for j in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, min(d, MOST), min(of[j], MOST), min(sum(of), MOST), sha[j]) for i, j, d in found]


def planted(rng, n, size, spread):
    middles = [[rng.gauss(0, 3) for _ in range(size)] for _ in range(9)]
    out = [(rng.randrange(n), [m + rng.gauss(0, spread) for m in rng.choice(middles)]) for _ in range(n)]
    return [*out, out[0], out[0], (out[1][0], out[2][1]), (None, out[3][1]), (None, out[4][1])]


@pytest.mark.parametrize(("k", "rounds", "spread"), [(16, 3, 0.3), (5, 4, 3.0), (1, 2, 1.0), (40, 3, 0.0), (16, 0, 1.0)])
def test_planted_vectors(spark, k, rounds, spread):
    known = planted(random.Random(k), 400, 6, spread)
    docs = spark.createDataFrame(known, "vec_id bigint, embedding array<float>").repartition(3)
    exact = [(r.vec_id, r.embedding) for r in docs.collect()]
    got = ball_kmeans(docs, k, rounds, size=6, scale=64)
    assert collected(got, *NAMES) == ordered(by_hand(exact, k, rounds, 6, 64))


def test_ties_go_to_the_smaller_number(spark):
    known = [(i, [float(i % 5), float(i // 5 % 3)]) for i in range(120)]
    got = ball_kmeans(spark.createDataFrame(known, "vec_id bigint, embedding array<double>"), 12, 3, size=2, scale=1)
    assert collected(got, *NAMES) == ordered(by_hand(known, 12, 3, 2, 1))


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    known = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [-1.5, 0.0]), (10, [1e300, 0.0]), (11, [-1e30, 0.0])]
    known += [(12, [3e7, -3e7]), (13, [3e7 + 1, -3e7]), (14, [-3.3e7, 3.3e7]), (15, [-(2.0**25), 0.0]), (16, [2.0**25, 0.0]), (None, [0.5, 0.5])]
    names = "vec_id bigint, embedding array<double>, v string, cluster string, distance map<string,int>"
    docs = spark.createDataFrame([(*r, "v", None, {}) for r in known], names)
    for k in (2, 16):
        assert collected(ball_kmeans(docs, k, 3, size=2, scale=64), *NAMES) == ordered(by_hand(known, k, 3, 2, 64))
    none = ball_kmeans(docs.where("vec_id = 2"), 4, 3, size=2)
    assert none.count() == 0 and none.columns == list(NAMES)


def test_members_meet_only_neighbours_within_reach():
    balls = Balls.around([[0, 0], [100, 0], [10, 0], [1000, 1000]], [6.0, 1.0, 300.0, 0.0])
    assert [n.tolist() for n in balls.near] == [[2], [], [0, 1], []]


def test_query_as_duckdb(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
    cursor = con.execute(queries.ORACLE_SQL["op13_centroid_clustering"])
    assert sorted(c[0] for c in cursor.description) == sorted(NAMES)
    at = [[c[0] for c in cursor.description].index(n) for n in NAMES]
    want = [tuple(r[i] for i in at) for r in cursor.fetchall()]
    got = collected(queries.QUERIES["op13_centroid_clustering"](spark, small), *NAMES)
    assert got == ordered(want)
    t = pq.read_table(f"{small}/embeddings.parquet")
    assert got == ordered(by_hand(list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True)), 16, 3, 64, 64))
