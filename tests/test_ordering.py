import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framelake.functions.ordering import order_statistics, positions, top_share


@pytest.fixture(scope="module")
def skewed():
    """One key holds most rows and repeats few values."""
    rng = np.random.default_rng(3)
    key = np.where(rng.random(4000) < 0.7, "hot", np.where(rng.random(4000) < 0.5, "b", "c"))
    return pd.DataFrame({"k": key, "v": np.round(rng.random(4000), 2), "y": rng.permutation(4000) // 63, "x": np.arange(4000), "t": rng.permutation(4000)})


def test_positions(spark, skewed):
    df = spark.createDataFrame(skewed)
    got = positions(df, ["k"], ["t"], F.floor(F.col("t") / 100), "n").toPandas().sort_values(["k", "t"])
    want = got.groupby("k").cumcount()
    assert (got["n"].to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("bins", [4, 65536])
def test_order_statistics(spark, skewed, bins):
    q = {"lo": 0.005, "mid": 0.5, "hi": 0.995}
    got = order_statistics(spark.createDataFrame(skewed), ["k"], "v", q, bins).toPandas().set_index("k")
    for k, g in skewed.groupby("k"):
        s = np.sort(g["v"].to_numpy())
        for name, f in q.items():
            assert got.loc[k, name] == s[int(f * (len(s) - 1))]


@pytest.mark.parametrize("bins", [4, 65536])
@pytest.mark.parametrize("share", [0.001, 0.13, 1.0])
def test_top_share(spark, skewed, bins, share):
    got = top_share(spark.createDataFrame(skewed), ["k"], "v", ["y", "x"], share, bins).toPandas()
    for k, g in skewed.groupby("k"):
        n = max(1, int(np.ceil(round(len(g) * share, 9))))
        want = g.sort_values(["v", "y", "x"], ascending=[False, True, True]).head(n)
        assert set(got[got["k"] == k]["x"]) == set(want["x"])
