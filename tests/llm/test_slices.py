import hashlib
from collections import Counter

import numpy as np
import pytest

from ionloom.llm import slices
from tests.llm.vector_rows import frame, rows, usable


def _nearest(parts, entries):
    square = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in parts]
    return [s.index(min(s)) for s in square], [min(s) for s in square]


def _brute(kept):
    """Codes, errors and the codebooks' digest, entry by entry."""
    x = [[int(np.floor(1024 * c)) for c in v] for _, v, _ in kept]
    order = sorted(range(len(x)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, x[i]))[:256]
    width = len(x[0]) // 4
    code, error, text = [""] * len(x), [0] * len(x), []
    for p in range(4):
        parts = [r[p * width : (p + 1) * width] for r in x]
        book = [parts[i] for i in order]
        for _ in range(4):
            at, _ = _nearest(parts, book)
            for e in set(at):
                mine = [q for q, a in zip(parts, at) if a == e]
                book[e] = [sum(c) // len(mine) for c in zip(*mine)]
        at, square = _nearest(parts, book)
        code = [c + f"{a:02x}" for c, a in zip(code, at)]
        error = [e + s for e, s in zip(error, square)]
        text += [str(v) for e in book for v in e]
    return code, error, hashlib.sha256(",".join(text).encode()).hexdigest()


@pytest.mark.parametrize("n", [420, 60])
def test_codes_equal_brute_force(spark, n):
    given = rows(8, n)
    kept = usable(given)
    code, error, digest = _brute(kept)
    labels = Counter()
    for k, e in zip(kept, error, strict=True):
        labels[k[2]] += e
    got = slices.compress(frame(spark, given)).collect()
    want = Counter((k[0], c, e, labels[k[2]], digest) for k, c, e in zip(kept, code, error, strict=True))
    assert Counter(tuple(r) for r in got) == want


@pytest.mark.parametrize("spread", [3, 1000, 1 << 40])
def test_nearest_with_ties_at_any_size(spread):
    rng = np.random.default_rng(spread)
    entries = rng.integers(-spread, spread, (200, 4))
    entries[50:60] = entries[10]  # equal entries: the lower index wins
    parts = np.concatenate([rng.integers(-2 * spread, 2 * spread, (300, 4)), entries[:20], np.full((1, 4), 40 * spread)])
    at, square = slices.assign(slices.slices(entries), parts)
    want = _nearest(parts, entries)
    assert (at.tolist(), [int(s) for s in square]) == want


def test_boxes_hold_exactly_the_entries_within_the_radius():
    rng = np.random.default_rng(2)
    entries, parts = rng.integers(-9, 9, (130, 3)), rng.integers(-9, 9, (40, 3))
    radius = rng.integers(0, 9, 40)
    found = slices.boxes(slices.slices(entries), parts, radius)
    bits = np.unpackbits(np.ascontiguousarray(found).view(np.uint8), axis=1, bitorder="little")[:, :130].astype(bool)
    assert (bits == (np.abs(parts[:, None] - entries[None]).max(2) <= radius[:, None])).all()


def test_empty_tables(spark):
    assert slices.compress(frame(spark, [])).count() == 0
    assert slices.compress(frame(spark, [(1, None, 1), (2, [1.0, 2.0, 3.0], 1)])).count() == 0
