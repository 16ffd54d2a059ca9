from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ohmwatch.schema import TRAFFIC  # noqa: E402
from ohmwatch.session import local_session, store  # noqa: E402

SF = "/root/testdata/sf0.001"
SERVICES = ["Read", "Write", "GetNameList", "GetVariableAccessAttributes", "Report", "GOOSE", "SampledValues"]
ASSETS = ["RTU-01", "RTU-02", "IED-Breaker-A", "IED-Breaker-B", "NAN-Gateway", "Substation-HMI", "Merging-Unit-01"]


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    return session


def labelled_frame(n: int, attack_ratio: float, seed: int) -> pd.DataFrame:
    """Labelled traffic with four kinds of attack, by the marginals of the fixture notes."""
    rng = np.random.default_rng(seed)
    kinds = rng.choice(["None", "DoS", "MITM", "FDI", "Replay"], n, p=[1 - attack_ratio] + [attack_ratio / 4] * 4)

    def mixed(normal, **changed):
        out = np.array(normal, dtype=float)
        for kind, values in changed.items():
            out = np.where(kinds == kind, values, out)
        return out

    normal = rng.normal
    frame = pd.DataFrame(
        {
            "record_id": np.arange(n),
            "timestamp": pd.Timestamp("2026-01-01") + pd.to_timedelta(np.arange(n), unit="s"),
            "packet_size": mixed(normal(180, 25, n).clip(60, 1500), DoS=normal(70, 15, n).clip(40)),
            "inter_arrival_ms": mixed(normal(200, 40, n).clip(5), DoS=normal(3, 1.5, n).clip(0.1)),
            "request_rate": mixed(normal(5, 1.5, n).clip(0.1), DoS=normal(80, 20, n).clip(20)),
            "latency_ms": mixed(normal(12, 3, n).clip(1), DoS=normal(60, 20, n).clip(5), MITM=normal(45, 12, n).clip(10)),
            "jitter_ms": mixed(normal(1.5, 0.5, n).clip(0), MITM=normal(9, 3, n).clip(1)),
            "duplicate_ratio": mixed(rng.beta(1, 30, n), Replay=rng.beta(20, 3, n)),
            "value_deviation": mixed(normal(0, 1, n), FDI=normal(4, 1.2, n)),
            "mms_service": rng.choice(SERVICES, n),
            "src_asset": rng.choice(ASSETS, n),
            "dst_asset": rng.choice(ASSETS, n),
            "label": np.where(kinds == "None", "Normal", "Attack"),
            "attack_type": kinds,
        }
    )
    return frame


@pytest.fixture(scope="session")
def labelled(spark):
    return store(spark.createDataFrame(labelled_frame(1500, 0.15, 3), TRAFFIC), "labelled")
