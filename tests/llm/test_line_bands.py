"""What the bands of lines.py find."""

import numpy as np


def test_band_recall():
    from bytesift.llm.lines import BANDS, PLACES

    assert all(len({*a} & {*b}) <= 1 for i, a in enumerate(BANDS) for b in BANDS[:i])
    equal = np.random.default_rng(1).random((400_000, PLACES), dtype=np.float32) < 0.8
    met = np.zeros(len(equal), dtype=bool)
    for band in BANDS:
        met |= equal[:, list(band)].all(axis=1)
    assert met.mean() >= 1 - (1 - 0.8**3) ** 9  # nine bands of 27 independent places
