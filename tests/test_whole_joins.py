"""The joins over all rows against brute force."""

import os
from collections import Counter, defaultdict

import pytest

from sightline.plans import QUERIES
from sightline.plans.base import table

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_window_join_all(spark):
    seen = defaultdict(set)
    for r in table(spark, SF, "detections").select("video", "frame", "brand").collect():
        seen[r["video"], r["frame"]].add(r["brand"])
    want = Counter((v, f, f + o, b) for v, f in seen for o in range(-2, 3) for b in seen.get((v, f + o), ()))
    got = QUERIES["window_join_all"](spark, SF)
    assert Counter(map(tuple, got.collect())) == want and len({b for *_, b in want}) == 5


def test_same_frame_pairs_all(spark):
    frames = defaultdict(list)
    for r in table(spark, SF, "boxes").select("frame", "part").collect():
        frames[r["frame"]].append(r["part"])
    want = Counter((f, a, b) for f, parts in frames.items() for a in parts for b in parts if a < b)
    assert Counter(map(tuple, QUERIES["same_frame_pairs_all"](spark, SF).collect())) == want
