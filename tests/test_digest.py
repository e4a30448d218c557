"""The resumable digest against hashlib, with and without the library."""

import hashlib
import random

import pytest
from metrelle.functions import digest


@pytest.mark.parametrize("library", [True, False])
def test_states_go_on_where_they_ended(monkeypatch, library):
    if not library:
        monkeypatch.setattr(digest, "_library", lambda: None)
    r = random.Random(1)
    for size in [0, 1, 55, 56, 63, 64, 65, 119, 128, 1000, 5000, *([200_000] if library else [])]:
        data = r.randbytes(size)
        state, at = None, 0
        while at < size:
            step = r.randint(1, max(1, size // 3))
            sha = digest.Sha256(state)
            sha.update(data[at : at + step])
            state, at = sha.state(), at + step
        assert digest.Sha256(state).hexdigest() == hashlib.sha256(data).hexdigest()


def test_one_state_serves_several():
    sha = digest.Sha256()
    sha.update(b"a" * 100)
    state = sha.state()
    assert len({digest.Sha256(state).hexdigest(), sha.hexdigest(), hashlib.sha256(b"a" * 100).hexdigest()}) == 1
