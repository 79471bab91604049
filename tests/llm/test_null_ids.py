"""Rows without an id link SimHash classes like any other."""

import random

from tests.llm import plain
from weftgraph.llm import simhash
from weftgraph.plans.scratch import Scratch


def test_null_ids_bridge_and_are_named(spark):
    rng, base = random.Random(8), [f"w{i}" for i in range(60)]
    while True:  # a and b apart, both near a text without an id
        texts = [" ".join([*base[:30], f"x{rng.randrange(10**6)}", *base[30:]]) for _ in range(3)]
        a, mid, b = (simhash.simhash(t.encode()) for t in texts)
        if 0 < (a ^ mid).bit_count() <= 3 and 0 < (mid ^ b).bit_count() <= 3 < (a ^ b).bit_count():
            break
    rows = [(5, texts[0]), (None, texts[1]), (9, texts[2]), (None, "quite another text without any id")]
    want = plain.classes([(i, plain.fingerprint(t)) for i, t in rows])
    assert want == [5, 5, 5, None]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in found) == sorted((str(i), str(c)) for (i, _), c in zip(rows, want))
