"""Any series, any block size: the block-wise walk equals the plain walk."""

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from series import cusum

from candela.operators.events import _crossings, _rolling_std
from candela.operators.timeline import Carry

floats = st.lists(st.floats(-1, 1).map(lambda v: round(v, 3)), min_size=1, max_size=60)


def in_parts(step, x, size):
    state, out = None, []
    for lo in range(0, len(x), size):
        carry = Carry(state)
        out.append(step(carry, x[lo : lo + size]))
        state = carry.out
    return np.concatenate(out)


@settings(max_examples=200, deadline=None)
@given(floats, st.integers(1, 20), st.floats(0.05, 1.5), st.sampled_from(["symmetric", "positive", "negative"]))
def test_cusum(values, size, limit, mode):
    x = np.array(values)
    got = in_parts(lambda k, p: _crossings(k, p, np.full(len(p), limit), mode), x, size)
    assert (got.astype(bool) == cusum(x, [limit] * len(x), mode)).all()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100).map(lambda v: round(v, 2))), min_size=1, max_size=60), st.integers(1, 20), st.integers(1, 12))
def test_ewm_mean(values, size, span):
    x = np.array([np.nan if v is None else v for v in values], dtype=float)
    alpha = 2 / (span + 1)
    got = in_parts(lambda k, p: k.ewm(p, alpha, 2), x, size)
    want = pd.Series(x).ewm(span=span, min_periods=2).mean().to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-50, 50)), min_size=1, max_size=60), st.integers(1, 20), st.integers(2, 9))
def test_rolling_std_over_present_values(values, size, n):
    x = np.array([np.nan if v is None else v for v in values], dtype=float)
    got = in_parts(lambda k, p: _rolling_std(k, p, n, 2, -1.0), x, size)
    present = pd.Series(x[~np.isnan(x)]).rolling(n, min_periods=2).std().fillna(-1.0)
    want = np.full(len(x), -1.0)
    want[~np.isnan(x)] = present
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-7)
