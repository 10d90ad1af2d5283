"""Held-out percentiles against numpy, with ties, nulls, sequences of one frame and cameras of one sequence."""

import numpy as np
import pytest

from vigilframe.operators import calibration


@pytest.mark.parametrize("distinct", [3, 40, 100_000])
def test_held_out_percentiles(spark, distinct, monkeypatch):
    monkeypatch.setattr(calibration, "BLOCK", 4)
    rng = np.random.default_rng(distinct)
    rows = [(int(c), int(s), i, 0, float(rng.integers(0, distinct) / (distinct - 1))) for i, (c, s) in enumerate(zip(rng.integers(0, 4, 600), rng.integers(0, 9, 600) ** 2 // 9, strict=True))]
    rows += [(9, 1, 1000 + i, 0, 0.5) for i in range(30)] + [(8, s, 2000 + s, 0, s / 40) for s in range(40)] + [(8, 3, 3000, 0, None)] * 2
    got = {(r.camera_id, r.sequence): (r.clear_frames, r.p50, r.p95) for r in calibration.held_out(spark.createDataFrame(rows, "camera_id long, sequence long, event_id long, cell long, confidence double")).collect()}
    want = {}
    for c, s in {r[:2] for r in rows}:
        others = [r[4] for r in rows if r[0] == c and r[1] != s]
        if len(others) >= 25:
            values = [x for x in others if x is not None]
            want[c, s] = (len(others), np.percentile(values, 50), np.percentile(values, 95))
    assert set(got) == set(want) and len(want) > 50
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9)
