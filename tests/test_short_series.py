"""Many short series in one Arrow call give what each gives alone."""

import numpy as np

from panelkit.functions import series


def test_kernels_keep_series_apart():
    rng = np.random.default_rng(3)
    parts = [rng.normal(size=n) for n in (1, 7, 40, 3)]
    parts[2][::5] = np.nan
    x, place = np.concatenate(parts), np.concatenate([np.arange(len(p)) for p in parts])
    for k in (1, 3, 10, 100):
        for stat in ("mean", "std", "sum"):
            want = np.concatenate([series.trailing(p, k, 2)[stat] for p in parts])
            np.testing.assert_array_equal(series.trailing(x, k, 2, place)[stat], want)
        np.testing.assert_array_equal(series.shifted(x, k, place), np.concatenate([series.shifted(p, k) for p in parts]))
        np.testing.assert_array_equal(series.rate(x, k, place), np.concatenate([series.rate(p, k) for p in parts]))
