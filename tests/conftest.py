import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelspark.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(8, "tests", "4g")
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def stability_frame():
    """0-2 follow the target, 3-5 flip sign by regime, 6-9 are noise."""
    rng = np.random.default_rng(0)
    n = 1000
    y = rng.normal(size=n)
    regime = np.array(["high_vol_crisis", "low_vol_grind", "transition"])[np.arange(n) % 3]
    sign = np.where(regime == "high_vol_crisis", 1.0, -1.0)
    data = {"era": np.repeat(np.arange(1, 101), 10), "y": y, "regime": regime}
    for i in range(10):
        noise = rng.normal(size=n)
        data[f"feature_{i}"] = (
            0.6 * y + 0.4 * noise if i < 3 else 0.6 * sign * y + 0.4 * noise if i < 6 else noise
        )
    return pd.DataFrame(data)


@pytest.fixture(scope="session")
def stability_df(spark, stability_frame):
    return spark.createDataFrame(stability_frame).cache()
