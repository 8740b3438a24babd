"""Key phrases against brute force on small inputs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.operators import mining as K


@pytest.mark.parametrize("flat", [False, True])
def test_frequent_grams_are_whole(spark, monkeypatch, flat):
    """Few slots give loose bounds, and bounds on documents drop the most frequent n-grams: the list stays exact."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(["the same words"] + rng.choices(vocabulary, None if flat else range(60, 0, -1), k=rng.randint(0, 80))) for _ in range(80)] + [None, "", "x"]
    if flat:
        monkeypatch.setattr(K, "_slot_totals", lambda made, low, high: np.full(K.SLOTS, 10**6))
    tf, df = Counter(), Counter()
    for t in texts:
        a = [w for w in (t or "").split() if len(w) > 1]
        grams = Counter(" ".join(a[i:i + n]) for n in (2, 3) for i in range(len(a) - n + 1))
        tf.update(grams)
        df.update(grams.keys())
    valid = [t for t in tf if 2 <= df[t] <= 0.8 * len(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    rows, found = K._frequent(docs, "text", 2, 3, (), None, 2, 0.8, 30, ["id"])
    expected = sorted(valid, key=lambda t: (-tf[t], t))[:30]
    assert {r["term"]: (r["tf"], r["df"]) for r in found.collect()} == {t: (tf[t], df[t]) for t in expected}
    held = Counter(r["g"] for r in rows.select(F.explode("grams").alias("g")).collect())
    assert all(held[t] == tf[t] for t in expected)


def test_texts_are_composed_some_at_a_time(monkeypatch):
    """Arrow in, Arrow out: no batch becomes strings as a whole."""
    import pyarrow as pa

    from newsloom.functions import text as T

    sizes = []
    monkeypatch.setattr(T.pa, "array", lambda values, kind, make=pa.array: sizes.append(len(values)) or make(values, kind))
    texts = [None, "", "é", "가", "é"] * 61
    found = T._nfc.func(pa.StringArray.from_pandas(texts)).to_pylist()
    assert found == [None, "", "é", "가", "é"] * 61
    assert max(sizes) == 100
