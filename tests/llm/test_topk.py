import numpy as np
import pytest
from pyspark.sql import functions as F

from matrixloom.llm import topk


def plain(codes, queries, k):
    out = []
    for q, c in queries.items():
        near = sorted(((c ^ x) & (2**64 - 1)).bit_count() * 10**9 + i for i, x in codes.items() if i != q)[:k]
        out += [(q, v % 10**9, v // 10**9, r + 1) for r, v in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("n,k", [(300, 10), (8, 10), (60, 1)])
def test_neighbours_equal_brute_force(spark, n, k):
    rng = np.random.default_rng(n)
    code = rng.integers(-(2**63), 2**63 - 1, n)
    code[: n // 3] = code[0]
    code[n // 3 : n // 2] = code[0] ^ (1 << rng.integers(0, 60, n // 2 - n // 3))
    codes = {i: int(c) for i, c in enumerate(code)}
    rows = [*codes.items(), (3, codes[3]), (None, 1), (900, None)]
    df = spark.createDataFrame(rows, "id long, code long").withColumn("distance", F.lit(0))
    queries = {i: c for i, c in codes.items() if i % 7 == 0}
    got = topk.top_k(df, df.where("id % 7 = 0"), k)
    assert sorted(tuple(r) for r in got.collect()) == plain(codes, queries, k)
    assert topk.top_k(df.limit(0), df, k).isEmpty() and topk.top_k(df, df.limit(0), k).isEmpty()


def test_sign_codes(spark):
    rows = [([1.0, -1.0, 0.0, 2.0],), (None,), ([None, 3.0],), ([1.0] * 64,), ([],)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<float>").select(topk.sign_code(F.col("v"))).collect()]
    assert got == [9, None, 2, -1, 0]
