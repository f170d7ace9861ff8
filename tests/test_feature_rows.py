"""Feature rows worked out in tasks against the columns of the feature frame."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridlark.operators import feature_rows, learned
from gridlark.operators import features as ft
from gridlark.sources.panel import CPU, MEM

NAMES = ft.feature_names(2)


@pytest.fixture(scope="module")
def odd_panel(spark):
    """Series of several lengths with unknown, infinite and not-a-number values and stretches of one value."""
    rng = np.random.default_rng(11)
    rows = []
    for k, n in enumerate((3, 40, 130, 260, 400)):
        for t in range(n):
            cpu, mem = float(np.round(rng.gamma(2, 20), 1)), float(rng.integers(5) * 25)
            cpu = None if (t + k) % 23 == 0 or t < k else 50.0 if 20 < t % 60 < 40 else cpu
            mem = None if t % 31 == 5 else float("nan") if t % 37 == 3 else float("inf") if t % 41 == 7 else mem
            rows.append((f"s{k}", 1_700_000_000 + 1800 * k + 3600 * t, cpu, mem))
    return spark.createDataFrame(rows, f"container_id string, time_stamp long, {CPU} double, {MEM} double")


@pytest.mark.parametrize("batch", [16_384, 29])
def test_rows_equal_frame(spark, odd_panel, batch, monkeypatch):
    monkeypatch.setattr(feature_rows, "BATCH", batch)
    names = list(NAMES)
    want = ft.drop_null_targets(ft.feature_frame(odd_panel, 2, 24)).select("container_id", "time_stamp", "cpu_target", "naive_cpu", "cpu_residual", *learned.clean(NAMES)).toPandas()
    want = want.sort_values(["container_id", "time_stamp"]).reset_index(drop=True)

    def send(batches):
        for b in batches:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"container_id": b.container_id.to_pylist(), "time_stamp": b.time_stamp, "cpu_target": b.target, "naive_cpu": b.naive, "cpu_residual": b.residual} | {n: b.x[:, i] for i, n in enumerate(names)}), preserve_index=False)

    schema = "container_id string, time_stamp long, " + ", ".join(f"{c} double" for c in ("cpu_target", "naive_cpu", "cpu_residual", *names))
    rows = feature_rows.PanelRows(odd_panel, 2, 24)
    got = rows.map(send, schema, names).toPandas().sort_values(["container_id", "time_stamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12, atol=1e-12)
    lo, hi = int(want.time_stamp.quantile(0.3)), int(want.time_stamp.quantile(0.6))
    some = rows.map(send, schema, names, lo, hi).toPandas().sort_values(["container_id", "time_stamp"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(some, want[(want.time_stamp >= lo) & (want.time_stamp < hi)].reset_index(drop=True), check_dtype=False, rtol=1e-12, atol=1e-12)
    assert rows.times().count() == want.time_stamp.nunique()
