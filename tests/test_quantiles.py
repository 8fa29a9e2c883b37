"""Exact quantiles by ranges against a sorted list."""

import math
import random

from siltstone.operators import evaluation as E


def test_quantiles_equal_a_sorted_list(spark):
    rng = random.Random(59)
    rows = [("a", round(rng.gauss(0, 1), 2)) for _ in range(3_000)] + [("b", 5.0)] * 700 + [("c", 10.0 ** rng.randint(-9, 9)) for _ in range(400)] + [("d", 1.0), ("d", None), ("e", None), (None, 2.0), (None, 3.0)]
    wanted = {"p05": E.nearest_rank(0.05), "p50": E.nearest_rank(0.5), "p95": E.nearest_rank(0.95), "r95": E.rounded_index(0.95), "last": E.nearest_rank(1.0)}
    got = {r["g"]: r for r in E.quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", wanted).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for g in ("a", "b", "c", "d"):
        values = sorted(v for k, v in rows if k == g and v is not None)
        n = len(values)
        for name, i in (("p05", max(math.ceil(0.05 * n), 1) - 1), ("p50", max(math.ceil(0.5 * n), 1) - 1), ("p95", max(math.ceil(0.95 * n), 1) - 1), ("r95", round((n - 1) * 0.95)), ("last", n - 1)):
            assert got[g][name] == values[i], (g, name)
