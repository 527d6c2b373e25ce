import numpy as np
import pytest

from corpusloom.llm.suffix import permuted_common_prefixes, suffix_array


@pytest.mark.parametrize("seed", range(60))
def test_equals_plain_sorting(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, rng.integers(2, 7), rng.integers(0, 90))
    if seed % 3 == 0:
        text = np.tile(text, 4)
    values = [*text.tolist(), 0]
    order = suffix_array(np.array(values))
    assert order.tolist() == sorted(range(len(values)), key=lambda i: values[i:])
    want = [0] * len(values)
    for a, b in zip(order, order[1:]):
        while a + want[b] < len(values) and values[a + want[b]] == values[b + want[b]]:
            want[b] += 1
    assert permuted_common_prefixes(np.array(values), order).tolist() == want


def test_long_runs():
    text = np.array([5] * 3000 + [1] * 3000 + [5] * 3000 + [0])
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all(text[a:].tolist() < text[b:].tolist() for a, b in zip(order[::97], order[97::97]))
