import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm.sketch import RelativeSketch, rank_error


def build(values, parts=1, k=32, high=True):
    out = RelativeSketch(k, high)
    for n, part in enumerate(np.array_split(np.asarray(values, dtype=float), parts)):
        out.merge(RelativeSketch.from_bytes(RelativeSketch(k, high, n).update(part).to_bytes()))
    return out


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_nan=False), max_size=120), st.integers(1, 5))
def test_small_inputs_are_exact(values, parts):
    sketch = build(values, parts)
    assert sketch.n == len(values)
    ordered = sorted(values)
    for q in (0.01, 0.5, 0.99):
        (got,) = sketch.quantiles([q])
        assert got == (ordered[max(1, int(np.ceil(q * len(values) - 1e-9))) - 1] if values else None)


@pytest.mark.parametrize("high", [True, False])
@pytest.mark.parametrize("parts", [1, 60])
def test_relative_error_next_to_the_protected_tail(high, parts):
    values = np.exp(np.random.default_rng(3).normal(5, 2, 200_000))
    sketch, ordered = build(values, parts, high=high), np.sort(values)
    for q in (0.0001, 0.001, 0.01, 0.5, 0.9, 0.99, 0.999, 0.9999):
        rank = np.searchsorted(ordered, sketch.quantiles([q])[0], side="right")
        tail = (1 - q) if high else q
        assert abs(rank - q * len(values)) <= rank_error(32) * tail * len(values) + 1


def test_ties_nan_and_infinities():
    sketch = build([5.0] * 1000 + [float("nan")] * 7 + [float("inf")])
    assert sketch.n == 1001
    assert sketch.quantiles([0.5, 1.0]) == [5.0, float("inf")]


def test_shapes_do_not_mix():
    with pytest.raises(ValueError):
        RelativeSketch(16).merge(RelativeSketch(32))
