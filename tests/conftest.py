import pathlib
import sys

import numpy as np
import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from framelake.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """A function turning a (H, W, 4) array into a pixel table."""
    import pandas as pd

    def make(block, asset="a", no=0):
        h, w, _ = block.shape
        y, x = np.mgrid[0:h, 0:w]
        pdf = pd.DataFrame({"asset_id": asset, "frame_no": np.int32(no), "y": y.ravel().astype("int32"), "x": x.ravel().astype("int32")})
        for k, c in enumerate("rgba"):
            pdf[c] = block[..., k].ravel()
        return spark.createDataFrame(pdf, "asset_id STRING, frame_no INT, y INT, x INT, r DOUBLE, g DOUBLE, b DOUBLE, a DOUBLE")

    return make


@pytest.fixture(scope="session")
def block():
    """A pixel table of one frame back to an array."""

    def read(df, cols="rgba"):
        pdf = df.toPandas()
        out = np.full((pdf["y"].max() + 1, pdf["x"].max() + 1, len(cols)), np.nan)
        assert len(pdf) == out.shape[0] * out.shape[1], "missing or repeated pixels"
        out[pdf["y"], pdf["x"]] = pdf[list(cols)].to_numpy()
        return out

    return read


@pytest.fixture(scope="session")
def noise():
    return np.random.default_rng(7).random((300, 280, 4))
