import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestream.llm import budget as T
from lodestream.llm import packing as P
from lodestream.llm.bpe import encode_texts
from lodestream.llm.common import language
from lodestream.session import table
from pyspark.sql import functions as F

def merged(text, merges):
    """The encoding by its definition: the leftmost pair of lowest rank first, until no pair is left."""
    tokens = list(text)
    while True:
        ranks = [(merges.index((a, b)), i) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if (a, b) in merges]
        if not ranks:
            return tokens
        i = min(ranks)[1]
        tokens[i : i + 2] = [tokens[i] + tokens[i + 1]]


def toy(seed, n):
    """A vocabulary of the bytes and ``n`` merges of tokens made before, in random order of making."""
    rng = random.Random(seed)
    words, merges = ["a", "b", "c"], []
    for _ in range(n):
        a, b = rng.choice(words), rng.choice(words)
        if a + b not in words:
            merges.append((a, b))
            words.append(a + b)
    every = [*(bytes([x]) for x in range(256)), *(w.encode() for w in words[3:])]
    place = {w: every.index(w.encode()) for w in words}
    return T.Matcher(every, [(place[a], place[b], place[a + b]) for a, b in merges]), merges


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 25), st.text("abc", min_size=1, max_size=30))
def test_counts_are_those_of_the_merges(seed, n, text):
    matcher, merges = toy(seed, n)
    assert matcher.piece(text.encode()) == len(merged(text, merges))


def test_public_vocabulary_and_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counted = {r.doc_id: r.n_tokens for r in T.count_tokens(docs, "text").collect()}
    assert counted == {r.doc_id: r.n for r in encode_texts(docs, "doc_id", "text").select("doc_id", F.size("ids").alias("n")).collect()}
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Hello world"), (3, "Hello world")], "n_tokens_ int, text string")
    assert [r.n_tokens for r in T.count_tokens(df, "text").orderBy("n_tokens_").collect()] == [0, 0, 2, 2]
    assert T.count_tokens(df.limit(0), "text").count() == 0
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(("EN", "en-US", "deu", "fra", "und", None, "", "es_MX"))], "i int, l string")
    assert [r[0] for r in rows.orderBy("i").select(language(F.col("l"))).collect()] == ["en", "en", "de", "fr", "und", "und", "und", "es"]


def test_languages_are_learned(spark, sf):
    docs = table(spark, sf, "documents")
    known = [(r.text, r.l) for r in docs.select("text", language(F.col("lang")).alias("l")).where("length(text) > 60 and l not in ('und', 'un')").collect()]
    model = T.fit_languages(docs, "doc_id", "text", "lang")
    assert sum(model.guess(t) == name for t, name in known) >= 0.9 * len(known) and known
    assert model.guess(None) == model.guess("") == model.guess("12 34 !") == "und"
    assert T.fit_languages(docs.limit(0), "doc_id", "text", "lang").guess("text") == "und"


def test_budget_totals(spark, sf):
    rows = T.p6_budget(spark, sf)
    total = rows.agg(F.sum("n_tokens"), F.sum("n_texts")).head()
    each = T.count_tokens(T.labelled_texts(spark, sf), "text").agg(F.sum("n_tokens"), F.count("*")).head()
    assert tuple(total) == tuple(each) and total[0] > 0
    assert rows.where("source_type <> lower(source_type)").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=25))
def test_plan_places_every_item_once(histogram):
    made, by_squares = P.plan(histogram, 64)
    assert 0 <= by_squares <= sum(histogram.values())
    used = {}
    for items, n in made:
        assert sum(items) <= 64 and n > 0
        for s in items:
            used[s] = used.get(s, 0) + n
    assert used == histogram
    total = sum(s * n for s, n in histogram.items())
    assert sum(n for _, n in made) <= 2 * -(-total // 64) + 1


def test_least_squares_place_most_items():
    rng = random.Random(2)
    histogram = {}
    for _ in range(20000):
        size = min(1 + int(rng.expovariate(1 / 300)), 2048)
        histogram[size] = histogram.get(size, 0) + 1
    made, by_squares = P.plan(histogram, 2048)
    volume = sum(s * n for s, n in histogram.items())
    assert by_squares >= 0.8 * 20000 and sum(n for _, n in made) <= 1.01 * volume / 2048 + 1


def test_nonnegative_least_squares():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, want = rng.integers(0, 4, (6, 12)).astype(float), np.where(rng.random(12) < 0.3, rng.integers(1, 9, 12), 0)
        x = P.nonnegative(a, a @ want)
        assert (x >= 0).all() and np.abs(a @ x - a @ want).max() < 1e-6


def best_fit(sizes, room):
    """Best fit of single items, largest first: free room of every container."""
    free = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= s]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= s
        else:
            free.append(room - s)
    return free


def test_packing(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([3, 3, 3, rng.randrange(1, 90), 100, 257])) for i in range(3000)] + [(9000, 0), (9001, None), (None, 5), (9002, 12), (9002, 12)]
    sizes = spark.createDataFrame(rows, "doc_id long, n_tokens int")
    got = P.pack(sizes, "doc_id", "n_tokens", {"s": 64, "l": 100}, buckets=7).collect()
    for name, room in (("s", 64), ("l", 100)):
        mine = [r for r in got if r.container == name]
        assert sum(r.n_tokens for r in mine) == sum(n for _, n in rows if n)
        spans = {}
        for r in mine:
            spans.setdefault(r.container_no, []).append((r.at_token, r.at_token + r.n_tokens))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and s[-1][1] <= room and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        assert sorted(spans) == list(range(len(spans)))
        assert len(spans) <= 1.01 * len(best_fit([r.n_tokens for r in mine], room)) + 1
        assert all(r.piece_no == 0 for r in mine if r.doc_id == 9002)
    assert P.pack(sizes.limit(0), "doc_id", "n_tokens", {"s": 64}).count() == 0
