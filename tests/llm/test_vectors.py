"""Hard negatives and vector codes against brute force, on odd tables and in small blocks."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sluicework.llm import codes, negatives

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int"
ODD = [
    (1, None, 0),
    (2, [0.1, None, 0.2, 0.3], 0),
    (3, [NAN, 0.1, 0.2, 0.3], 1),
    (100, [INF, 0.1, 0.2, 0.3], 1),
    (None, [0.3, 0.2, 0.1, 0.4], 1),
    (None, [0.3, 0.2, 0.1, 0.4], 0),
    (5, [], 1),
    (6, [0.5], 0),
    (7, [0.5, 0.5, 0.5, 0.5, 0.5], 1),
    (200, [0.25, 0.5, 0.25, 0.5], 0),
    (200, [0.25, 0.5, 0.25, 0.5], 0),
    (200, [0.5, 0.25, -0.5, 0.25], 1),
    (300, [-0.9, -0.9, 0.9, 0.1], 2),
    (400, [0.2, 0.2, 0.2, 0.2], None),
    (9, [3000.5, -2000.25, 100.0, 7.0], 1),
    (10, [9e30, 0.0, 0.0, 0.0], 1),
]


def rows_of(kind, n=240, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "odd":
        return ODD
    x = rng.normal(0, 0.3, (n, 8))
    if kind == "hot":  # one vector holds a third of all rows, one label half
        x[: n // 3] = x[0]
    if kind == "sparse":
        x *= rng.random((n, 8)) < 0.3
    if kind == "skewed":
        x *= [4, 2, 1, 0.5, 0.2, 0.1, 0.05, 0.01]
    label = np.where(rng.random(n) < 0.5, 0, rng.integers(0, 6, n))
    ids = rng.permutation(n) * 20
    return [(int(i), [float(np.float32(v)) for v in row], int(c)) for i, row, c in zip(ids, x, label, strict=True)]


def takes_part(row, scale):
    return row[1] is not None and all(v is not None and math.isfinite(v) and abs(v) * scale < 2**24 for v in row[1])


def integers(rows, scale, width):
    return [[math.floor(scale * v) for v in r[1]] + [0] * (width - len(r[1])) for r in rows]


def brute_negatives(rows):
    rows = [r for r in rows if takes_part(r, 256) and r[2] is not None]
    q = integers(rows, 256, max((len(r[1]) for r in rows), default=0))
    out = Counter()
    for a, r in enumerate(rows):
        if r[0] is None or r[0] % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(q[a], q[b], strict=True)), rows[b][0] is None, rows[b][0] or 0, b) for b in range(len(rows)) if b != a))
        for p in [s for s in scored if rows[s[3]][2] == r[2]][:5]:
            inside = [s for s in scored if rows[s[3]][2] != r[2] and 30 * -p[0] <= 100 * -s[0] <= 90 * -p[0]][:10]
            out.update((r[0], rows[p[3]][0], k + 1, rows[s[3]][0], -p[0], -s[0]) for k, s in enumerate(inside))
    return out


@pytest.mark.parametrize("kind", ["odd", "plain", "hot", "sparse", "skewed"])
@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, kind, small):
    if small:  # several blocks of each side, runs of anchors, thresholds that are too high at first
        for name, value in {"BLOCK_ROWS": 50, "BLOCK_ANCHORS": 5, "LEAST_ROWS": 20, "STEP_ANCHORS": 3, "EXPECTED": 0.1}.items():
            monkeypatch.setattr(negatives, name, value)
    rows = rows_of(kind)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("q", "w", "rank", "anchor", "number", "n", "id", "score")})
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0).collect()
    assert Counter(tuple(r) for r in got) == brute_negatives(rows)


def test_hard_negatives_of_text_ids_empty_tables_and_lonely_anchors(spark):
    rows = [("a", [1.0, 0.0], 1), ("b", [1.0, 0.0], 1), ("c", [0.5, 0.0], 2), ("d", [0.5, 0.0], 3)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    got = negatives.hard_negatives(df, F.col("vec_id") == "a").collect()
    assert [tuple(r) for r in sorted(got)] == [("a", "b", 1, "c", 65536, 32768), ("a", "b", 2, "d", 65536, 32768)]
    assert negatives.hard_negatives(df, F.col("vec_id") == "c").count() == 0
    assert negatives.hard_negatives(df.limit(0), F.lit(True)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 3, 8, 20, 64]), st.sampled_from([np.float64, np.int64]), st.floats(-0.2, 1.1))
def test_matches_are_all_pairs_at_or_above(seed, width, kind, share):
    rng = np.random.default_rng(seed)
    a, x = (np.floor(rng.normal(0, 90, (n, width)) * (rng.random((n, width)) < rng.choice([0.2, 1.0]))).astype(kind) for n in (7, 60))
    x[:5] = a[0]
    score = a.astype(np.int64) @ x.astype(np.int64).T
    least = np.floor(share * np.maximum(1, (a.astype(float) ** 2).sum(1)) * rng.uniform(0.5, 1.5, 7))
    found = [(int(i), int(j), int(s)) for run in negatives.matches(a, least, x) for i, j, s in zip(*run, strict=True)]
    assert sorted(found) == [(i, j, int(score[i, j])) for i in range(7) for j in range(60) if score[i, j] >= least[i]]


def test_the_index_leaves_covered_dimensions_out():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 50, (200, 16)) * (0.6 ** np.arange(16))
    norms = negatives.suffix_norms(x[:4])
    index = negatives.build_index(x, norms, 0.7 * norms[:, 0] ** 2)
    assert 0 < index.depth.mean() < 5 and len(index.row) < 200


def brute_codes(rows):
    rows = sorted((r for r in rows if takes_part(r, 1024)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = max(1, -(-max((len(r[1]) for r in rows), default=0) // 4))
    q = np.array(integers(rows, 1024, 4 * width), np.int64).reshape(-1, 4, width)
    book = q[:256].copy()

    def nearest():
        apart = ((q[:, None] - book[None]) ** 2).sum(3)
        return apart.argmin(1), apart.min(1).sum(1)

    for _ in range(4):
        entry, _ = nearest()
        for p in range(4):
            for e in range(len(book)):
                of = entry[:, p] == e
                if of.any():
                    book[e, p] = q[of, p].sum(0) // of.sum()
    entry, error = nearest()
    by_label = Counter()
    for r, x in zip(rows, error.tolist(), strict=True):
        by_label[r[2]] += x
    digest = hashlib.sha256(",".join(map(str, book.transpose(1, 0, 2).ravel().tolist())).encode()).hexdigest()
    return Counter((r[0], "".join(f"{k:02x}" for k in e), x, by_label[r[2]], digest) for r, e, x in zip(rows, entry.tolist(), error.tolist(), strict=True))


@pytest.mark.parametrize("kind", ["odd", "plain", "hot", "skewed"])
def test_vector_codes_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(codes, "MEMO_CELLS", 40)  # cells are forgotten and met again
    monkeypatch.setattr(codes, "STEP_NUMBERS", 20_000)
    rows = rows_of(kind, 420)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("q", "id", "code", "error", "of", "label_error")})
    assert Counter(tuple(r) for r in codes.vector_codes(df).collect()) == brute_codes(rows)


def test_vector_codes_of_empty_tables_and_text_ids(spark):
    df = spark.createDataFrame([("b", [0.5] * 4, "x"), ("a", [-0.5] * 4, None)], "vec_id string, embedding array<double>, label string")
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.vector_codes(df).collect()}
    assert got == {"a": ("00000000", 0, 0), "b": ("01010101", 0, 0)}
    empty = codes.vector_codes(df.limit(0))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(ValueError, match="two hex"):
        codes.vector_codes(df, entries=300)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 2, 32, 1024]), st.sampled_from([1, 5, 256]))
def test_dominated_entries_are_never_nearest(seed, side, entries):
    rng = np.random.default_rng(seed)
    book = rng.integers(-300, 300, (entries, 3))
    book[entries // 2 :] = book[: entries - entries // 2]  # equal entries
    x = rng.integers(-400, 400, (50, 3))
    entry, error = codes.Cells(book, side).nearest(x)
    apart = ((x[:, None] - book) ** 2).sum(2)
    assert (entry == apart.argmin(1)).all() and (error == apart.min(1)).all()
