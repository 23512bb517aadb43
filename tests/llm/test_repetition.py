import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import repetition as R
from lodestream.session import table


def share(text, run=5):
    w = re.findall(r"\w+", (text or "").lower())
    seen, hit = set(), set()
    for i in range(len(w) - run + 1):
        g = tuple(w[i : i + run])
        if g in seen:
            hit |= set(range(i, i + run))
        seen.add(g)
    return len(w), len(hit)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n.", max_size=80), max_size=6))
def test_share_by_hand(texts):
    count, hit = R.repeated_share(texts)
    assert list(zip(count, hit)) == [share(t) for t in texts]


def test_edges():
    texts = [None, "", "   ", "a b c d", "a b c d e a b c d e", "x " * 100_000, "ä Ä ö Ö ü a b"]
    count, hit = R.repeated_share(texts)
    assert list(zip(count, hit)) == [share(t) for t in texts]


def test_found_and_thresholds(spark, sf):
    docs = table(spark, sf, "documents")
    want = {r.doc_id for r in docs.collect() if share(r.text)[1] >= 0.3 * max(1, share(r.text)[0])}
    assert {r.doc_id for r in R.p10_found(spark, sf).collect()} == want and want
    limits = [r.threshold for r in R.p10_thresholds(spark, sf).collect()]
    assert limits and all(0.15 <= t <= 0.45 for t in limits)


def test_thresholds_follow_the_groups(spark):
    """Two groups whose gaps lie elsewhere get cut-offs of their own; a small group takes that of its language, then that of all."""
    rng = random.Random(1)
    rows = [("en", "s", rng.uniform(0, 0.1)) for _ in range(900)] + [("en", "s", rng.uniform(0.6, 0.8)) for _ in range(100)]
    rows += [("de", "t", rng.uniform(0, 0.02)) for _ in range(900)] + [("de", "t", rng.uniform(0.15, 0.3)) for _ in range(100)]
    rows += [("en", "few", 0.0), ("fr", None, 0.5)]
    got = {(r.lang, r.source): r.threshold for r in R.thresholds(spark.createDataFrame(rows, "lang string, source string, v double"), ["lang", "source"], "v").collect()}
    assert 0.1 < got["en", "s"] < 0.6 and 0.02 < got["de", "t"] < 0.15 and 0.1 < got["en", "few"] < 0.6 and got["fr", None] > 0
    flat = spark.createDataFrame([("en", "s", 0.0)] * 5, "lang string, source string, v double")
    assert [r.threshold for r in R.thresholds(flat, ["lang", "source"], "v").collect()] == [0.3]


def test_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "a b c d e a b c d e", "EN", "s"), (1, "a b c d e a b c d e", "EN", "s")], "k long, t string, l string, s string")
    got = R.repetitive(df, "k", "t", "l", "s").collect()
    assert sorted((r.k is None, r.is_repetitive) for r in got) == [(False, True), (False, True), (True, False)]
    assert R.repetitive(df.limit(0), "k", "t", "l", "s").count() == 0
