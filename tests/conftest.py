import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowsieve.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def frame(spark):
    """Table of id, f0.., truth from a matrix."""

    def make(x, truth=None, parts=4):
        x = np.asarray(x, dtype=float)
        pdf = pd.DataFrame({"id": np.arange(len(x)), **{f"f{j}": x[:, j] for j in range(x.shape[1])}})
        if truth is not None:
            pdf["truth"] = np.asarray(truth, dtype=int)
        return spark.createDataFrame(pdf).repartition(parts)

    return make


def separable(n, d, shift, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (n, d)), rng.normal(shift, 1, (n, d))])
    return x, np.repeat([0, 1], n)


def planted(n, d, m, seed):
    """One blob and, at the end, m far points."""
    rng = np.random.default_rng(seed)
    far = rng.normal(0, 1, (m, d))
    far = far / np.linalg.norm(far, axis=1, keepdims=True) * rng.uniform(9, 12, (m, 1))
    return np.vstack([rng.normal(0, 1, (n, d)), far])
