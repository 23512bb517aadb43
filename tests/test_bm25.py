import random

import duckdb
import numpy as np
import pytest

from lodestream.operators import retrieval, search
from lodestream.plans import catalog
from lodestream.session import table


def tables(spark, seed, repeated):
    rng = random.Random(seed)
    often = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[: rng.choice([3, 8, 26])]) for _ in range(n))
    docs = [(i // 2 if repeated and i % 3 else i, rng.choice([None, "", "?!", "a b a b", *[often(rng.randint(1, 40)) for _ in range(8)]])) for i in range(160)]
    asked = [(100 * (i // 2 if repeated and i % 3 else i), rng.choice([None, "", "zzz unknown", "a a b", *[often(rng.randint(1, 9)) for _ in range(8)]])) for i in range(50)]
    if repeated:
        docs += [(None, "a b c"), (None, "c d e f a"), (None, "x")]
        asked += [(200, "x y b"), (200, "b c")]
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(asked, "update_id long, title string").repartition(3)


@pytest.mark.parametrize(("seed", "repeated", "small"), [(1, False, False), (2, False, True), (3, True, False), (4, True, True)])
def test_best_as_in_sql(spark, monkeypatch, seed, repeated, small):
    """Ties, blanks, nulls, ids met several times, lists of terms and postings in several blocks."""
    if small:
        monkeypatch.setattr(retrieval, "ASKED", 7)
        monkeypatch.setattr(retrieval, "POSTED", 60)
        monkeypatch.setattr(retrieval, "FEW", 1)
    docs, asked = tables(spark, seed, repeated)
    with duckdb.connect() as c:
        c.register("documents", docs.toArrow())
        c.register("azure_updates", asked.toArrow())
        want = c.sql(catalog.oracle_sql()["bm25_topk"]).fetchall()
    got = [(r.update_id, r.doc_id, r.score, r["rank"]) for r in retrieval.bm25(docs, "doc_id", "text", asked, "update_id", "title").collect()]
    assert want and sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("depth", [2, 24])
def test_bounds_drop_nothing(monkeypatch, depth):
    """The best of a block, with shared sums, against all scores."""
    monkeypatch.setattr(retrieval, "DEPTH", depth)
    rng = np.random.default_rng(depth)
    n, width, k = 3000, 40, 3
    weight = np.where(rng.random((n, width)) < rng.choice([0.004, 0.05, 0.4], width), np.round(rng.random((n, width)) * 9, 1) + 0.1, 0.0)
    weight[:, 7] = 0
    owner, term = np.nonzero(weight)
    lists = sorted([*(sorted(rng.choice(width, rng.integers(1, 9)).tolist()) for _ in range(200)), [7], [0, 1, 2, 3, 4], [0, 1, 2, 3, 5], [0, 1, 2], [1, 1]])
    got = {}
    for who, docs, scores in retrieval.Postings(n, owner, term, weight[owner, term], width, k).best(map(np.array, lists)):
        for i, d, s in zip(who.tolist(), docs.tolist(), scores.tolist()):
            got.setdefault(i, []).append((d, s))
    for i, wanted in enumerate(lists):
        score = np.floor(weight[:, wanted].sum(axis=1) * 1e6 + 0.5) / 1e6
        by = [d for d in np.lexsort((np.arange(n), -score))[:k].tolist() if score[d] > 0]
        assert [d for d, _ in got.get(i, [])] == by and np.allclose([s for _, s in got.get(i, [])], score[by])


def shuffled(spark, run):
    """Records that ``run`` writes to shuffles when no table is small enough to be broadcast."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seq = store.stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
        return {s.stageId(): s.shuffleWriteRecords() for s in map(seq.apply, range(seq.size()))}

    before = set(written())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    return sum(n for s, n in written().items() if s not in before)


def alike(spark):
    """300 documents and 40 questions that share a word."""
    docs = spark.range(300).selectExpr("id", "concat('all w', id % 7, ' v', id) AS t", "'t' AS title", "concat('u', id) AS url")
    return docs, spark.range(40).selectExpr("id AS q", "concat('all w', id % 7, ' u', id) AS s")


def test_pairs_are_not_shuffled(spark):
    """Questions that share a word with every document meet them within tasks (before, all 12,000 pairs were shuffled)."""
    docs, asked = alike(spark)
    assert shuffled(spark, lambda: retrieval.bm25(docs, "id", "t", asked, "q", "s", 3).collect()) < 6000


def test_answers_shuffle_no_pairs(spark):
    docs, asked = alike(spark)
    complete = lambda p: p.selectExpr("cache_key", "prompt AS answer")
    assert shuffled(spark, lambda: search.answers(asked, "q", "s", docs, "id", "title", "url", "t", [], "any", complete).collect()) < 6000


def test_fused_ranks_shuffle_no_pairs(spark):
    docs, asked = alike(spark)
    other = spark.sql("SELECT 1L AS q, 1L AS d, 1 AS rank")
    text = lambda: retrieval.bm25(docs, "id", "t", asked, "q", "s").withColumnRenamed("id", "d")
    assert shuffled(spark, lambda: retrieval.fuse(text(), other).collect()) < 6000


def test_every_update_has_its_prompt(spark, sf):
    """Not only every hundredth title is a question."""
    got = {r.update_id for r in catalog.queries()["grounded_prompts"](spark, sf).collect()}
    titled = {r.update_id for r in table(spark, sf, "azure_updates").where(r"title rlike '[a-z]'").collect()}
    assert len(got) > len(titled) / 2 and any(i % 100 for i in got) and "% 100" not in catalog.oracle_sql()["grounded_prompts"]
