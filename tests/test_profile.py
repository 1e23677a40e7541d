"""Profiles on odd rows, against counting in Python."""

from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F
from sluicework.operators import profile

ROWS = [
    ("a", "Who is it? Who is HE"), ("a", "who is it"), ("a", "who is it"), ("a", None), ("a", ""), ("a", " \n?! "), ("b", "it"), (None, "Straße and it, and it"), (None, None),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "role string, text string").withColumns({c: F.lit("x") for c in ("facet", "value", "n", "rank", "mask")})


def test_top_values_equal_counting(spark):
    w = profile.words(F.col("text"))
    facets = {"word": w, "pair": profile.phrases(w, 2), "first": profile.prefix(w, 2), "none": F.lit(None).cast("array<string>")}
    got = profile.top_values(frame(spark), "role", facets, 3).collect()
    counts = {}
    for role, text in ROWS:
        one = "".join(c if c.isalnum() else " " for c in (text or "").lower().replace("ß", "ss")).split()
        for name, values in (("word", one), ("pair", [" ".join(one[k : k + 2]) for k in range(len(one) - 1)]), ("first", [" ".join(one[:2])] if len(one) > 1 else [])):
            counts.setdefault((name, role), Counter()).update(values)
    want = {(f, g, k + 1, v, n) for (f, g), c in counts.items() for k, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:3])}
    assert {tuple(r) for r in got} == want
    assert profile.top_values(frame(spark).limit(0), "role", facets, 3).count() == 0


def test_ranks_are_limited_before_they_move(spark):
    w = profile.words(F.col("text"))
    plan = profile.top_values(frame(spark), "role", {"word": w}, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


def test_bucket_pairs_equal_counting(spark):
    tests = {"who": "who", "it": "it", "and": "and"}
    mask = profile.bucket_mask({k: F.contains(F.lower("text"), F.lit(v)) for k, v in tests.items()})
    got = profile.bucket_pairs(frame(spark).select("role", mask.alias("mask")), "role", "mask", list(tests)).collect()
    want = set()
    for role in ("a", "b", None):
        held = [{k for k, v in tests.items() if v in (t or "").lower()} for r, t in ROWS if r == role]
        want |= {(role, a, b, sum(a in h for h in held), sum(b in h for h in held), sum({a, b} <= h for h in held)) for a, b in combinations(tests, 2)}
    assert {tuple(r) for r in got} == want
    assert profile.bucket_pairs(frame(spark).limit(0).select("role", mask.alias("mask")), "role", "mask", list(tests)).count() == 0
