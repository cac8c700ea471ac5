"""Principal components of the signals' matrix against numpy over the same table."""

import numpy as np
import pyarrow.parquet as pq

from quarrylens.plans import catalog, load_all

SF = "/root/testdata/sf0.001"


def test_components_of_signals(spark):
    load_all()
    events = pq.read_table(f"{SF}/events.parquet", columns=["user_id", "event_type"]).to_pandas()
    counts = events.groupby(["user_id", "event_type"]).size().unstack(fill_value=0)
    values = sorted(np.linalg.eigvalsh(np.round(np.corrcoef(counts.to_numpy(float).T), 4)), reverse=True)
    got = catalog.QUERIES["g32_components"](spark, SF).orderBy("component").collect()
    assert len(got) == len(values) == 5
    # Power iteration stops after some rounds, so close values may trade a little.
    assert np.allclose([r.value for r in got], values, atol=0.02) and abs(got[-1].upto - 1) < 1e-3
    assert np.allclose([r.share for r in got], [r.value / len(got) for r in got], atol=1e-4)
