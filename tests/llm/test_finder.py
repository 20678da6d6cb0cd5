"""Places among sorted hashes without a binary search for each token."""

import numpy as np
import pytest

from weftline.llm import lm_scoring, wordhash


@pytest.mark.parametrize("kind", [np.int64, np.uint64])
@pytest.mark.parametrize("n", [0, 1, 2, 7, 1000, 50_000])
def test_finder(kind, n):
    rng = np.random.default_rng(n)
    info = np.iinfo(kind)
    keys = np.unique(np.concatenate([rng.integers(info.min, info.max, n, kind), np.array([info.min, 5, 6, 7, info.max], kind)[: n and 5]]))
    values = np.concatenate([keys, rng.integers(info.min, info.max, 3000, kind), np.arange(20).astype(kind), np.array([info.min, info.max], kind)])
    rng.shuffle(values)
    at, found = wordhash.Finder(keys).find(values)
    assert (found == np.isin(values, keys)).all() and (at[found] == np.searchsorted(keys, values[found])).all()
    at, found = wordhash.Finder(keys).find(values[:0])
    assert len(at) == len(found) == 0


def test_finder_of_crowded_and_repeated_keys():
    keys = np.sort(np.concatenate([np.arange(300), np.arange(0, 300, 3)]))
    values = np.arange(-10, 400)
    at, found = wordhash.Finder(keys).find(values)
    assert (found == np.isin(values, keys)).all() and (at[found] == np.searchsorted(keys, values[found])).all()


def test_losses_search_no_token(monkeypatch):
    before, word = np.array([0, 1, 2, -5, 1]), np.array([1, 2, -5, 1, 2])
    keys = np.sort(lm_scoring.pair_keys(before[1:2], word[1:2]))
    models = lm_scoring.Models(np.array([3, 9], np.uint64), 10.0, np.array([[0.0, 1, 2], [0, 3, 4]]), keys, np.array([[0.5], [0.25]]))
    searched = []
    monkeypatch.setattr(np, "searchsorted", lambda *a, **k: searched.append(a))
    assert models.losses(before, word).tolist() == [[9.0, 7.5, 10.0, 9.0, 7.5], [7.0, 5.75, 10.0, 7.0, 5.75]]
    assert not searched
