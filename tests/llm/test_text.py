from __future__ import annotations

import random

import pyarrow as pa
import pytest

from fleetvitals.llm import _text


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
@pytest.mark.parametrize("most", [1, 20, 10_000])
def test_slices_cover_every_row_once(kind, most):
    r = random.Random(most)
    values = [r.choice([None, "", "é日", "word " * r.randrange(9), "x" * 300]) for _ in range(200)]
    whole = pa.record_batch([pa.array(values, kind), pa.array(range(200))], names=["t", "n"])
    batches = [whole.slice(0, 0), whole.slice(0, 70), whole.slice(70, 1), whole.slice(71)]
    seen = []
    for part, t in _text.slices(iter(batches), "t", most):
        own = [t.raw(i).decode() for i in range(len(t))]
        assert len(own) == part.num_rows >= 1
        assert len(own) == 1 or sum(len(x.encode()) for x in own) <= most
        seen += zip(part.column("n").to_pylist(), own)
    assert seen == [(i, v or "") for i, v in enumerate(values)]


def test_slices_copy_no_more_than_their_rows():
    batch = pa.record_batch([pa.array(["a" * 1000] * 100 + [None])], names=["t"])
    sizes = [len(t.data) for _, t in _text.slices(iter([batch]), "t", 5000)]
    assert max(sizes) == 5000 and sum(sizes) == 100_000
