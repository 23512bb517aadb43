import json

import pytest
from pyspark.sql import functions as F

from lodestream.operators import retrieval, search, sink
from lodestream.plans import pipeline
from lodestream.session import fresh_dir, table
from lodestream.sources import records


def test_facets_and_nulls(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "X"), (2, ["c"], "x"), (3, None, None), (4, [], "y")], "id int, tags array<string>, kind string")
    ids = lambda **w: [r.id for r in df.where(search.facets(**w)).orderBy("id").collect()]
    tags, kind = F.col("tags"), F.col("kind")
    assert ids() == [1, 2, 3, 4] and ids(kind=(kind, [])) == [1, 2, 3, 4]
    assert ids(any_tags=(tags, ["b", "c"])) == [1, 2] and ids(any_tags=(tags, ["b"]), kind=(kind, ["x"])) == [1] and ids(kind=(kind, ["X", "y"])) == [1, 2, 4]


def test_terms_of_any_script(spark):
    df = spark.createDataFrame([("Für große Häuser, élan-9!",), (None,)], "t string")
    assert [r[0] for r in df.select(retrieval.terms(F.col("t"))).collect()] == [["für", "große", "häuser", "élan", "9"], []]


def test_versions_on_one_root(spark):
    store = sink.IndexStore(spark, fresh_dir(spark, "store"))
    assert store.current() is None and store.versions() == []
    store.ensure("id int")
    store.ensure("id int")
    assert store.versions() == [1] and store.current().count() == 0
    one = spark.range(3).select(F.col("id").cast("int").alias("id"))
    assert store.write(one) == 2 and store.write(store.current().union(one)) == 3 and store.current().count() == 6
    one.write.parquet(f"{store.root}/data/v-{4:012d}")  # a writer that failed before the pointer
    assert store.current().count() == 6 and store.write(one) == 5 and store.current().count() == 3
    assert store.keep(2) == [1, 2] and store.versions() == [3, 5]
    store.drop()
    store.drop()
    assert store.current() is None


def test_three_runs_on_one_root(spark, sf):
    root = fresh_dir(spark, "runs")
    docs = pipeline.sources(spark, sf).where("source_type = 'azure-update'")
    first = pipeline.ingest(spark, docs, root)
    n = first.index.count()
    for _ in range(2):
        again = pipeline.ingest(spark, docs, root)
        assert again.index.count() == n and again.counters.agg(F.sum("n_indexed")).head()[0] == 0
    assert n > 0 and first.index.count() == n  # an old version can still be read


def test_statuses():
    good = json.dumps({"value": [{"key": "1", "status": 201}, {"key": "2", "statusCode": 409, "errorMessage": "old"}, {"key": "3"}]})
    assert sink.parse_statuses(["1", "2", "3", "4"], good, 207) == [(201, None), (409, "old"), (500, None), (500, "not named in the answer")]
    assert sink.parse_statuses(["1"], "no json", 200) == [(500, "unreadable answer")] and sink.parse_statuses(["1"], None, 200) == [(500, "unreadable answer")]
    assert sink.parse_statuses(["1", "2"], "down", 503) == [(503, "down")] * 2


def test_upload_sends_failed_ones_once_more(spark):
    def post(rows):
        if any(r["id"] == 50 for r in rows):
            raise OSError("gone")
        bad = {7} | ({3} if len(rows) > 2 else set())
        return 207, json.dumps({"value": [{"key": str(r["id"]), "status": 503 if r["id"] in bad else 200} for r in rows]})

    df = spark.createDataFrame([(i, "x") for i in (*range(1, 9), 50)], "id int, text string").coalesce(1)
    got = {r.id: (r.status, r.attempts) for r in sink.upload(df, "id", post, 4).collect()}
    assert got == {1: (200, 1), 2: (200, 1), 3: (200, 2), 4: (200, 1), 5: (200, 1), 6: (200, 1), 7: (503, 2), 8: (200, 1), 50: (599, 2)}
    statuses = spark.createDataFrame([(7, 503, None, 2), (1, 200, None, 1)], "id int, status int, error string, attempts int")
    assert [(r.id, r.text, r.status) for r in sink.dead_letters(df, statuses, "id").collect()] == [(7, "x", 503)]
    assert sink.upload(df.limit(0), "id", post).count() == 0


def test_recall_of_the_vector_index(spark, sf):
    v = table(spark, sf, "embeddings")
    queries = v.where("vec_id % 20 = 0")
    exact = {(r.q, r.d) for r in retrieval.nearest(v, "vec_id", "embedding", queries).collect()}
    index = retrieval.VectorIndex(spark, fresh_dir(spark, "ann"), part=100).build(v, "vec_id", "embedding")
    got = index.search(queries, "vec_id", "embedding").collect()
    assert len(exact & {(r.q, r.d) for r in got}) >= 0.9 * len(exact) and exact
    whole = retrieval.VectorIndex(spark, fresh_dir(spark, "ann"), probes=1.0).build(v, "vec_id", "embedding").search(queries, "vec_id", "embedding")
    assert {(r.q, r.d) for r in whole.collect()} == exact
    none = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert retrieval.VectorIndex(spark, fresh_dir(spark, "ann")).build(none, "vec_id", "embedding").search(none, "vec_id", "embedding").count() == 0


def test_answers_are_reused(spark):
    docs = spark.createDataFrame([(1, "T", "http://x", "alpha beta gamma"), (2, "U", "http://y", "delta")], "id long, title string, url string, text string")
    asked = spark.createDataFrame([(1, "Alpha?"), (2, " alpha? "), (3, "nothing here"), (4, None)], "q long, question string")
    made = []

    def complete(prompts):
        made.append(prompts.count())
        return prompts.select("cache_key", F.lit("An answer").alias("answer"))

    got = search.answers(asked, "q", "question", docs, "id", "title", "url", "text", [("compare", ["versus"])], "guide", complete)
    rows = {r.q: r for r in got.collect()}
    assert made == [3] and rows[1].cache_key == rows[2].cache_key and rows[1].n_citations == 1 and rows[3].confidence == 0.3 and not rows[1].cached and len(rows) == 4
    known = got.where("q = 1").select("cache_key", "answer", "n_citations", "confidence")
    again = {r.q: r for r in search.answers(asked, "q", "question", docs, "id", "title", "url", "text", [], "guide", complete, known=known).collect()}
    assert made == [3, 2] and again[1].cached and again[2].cached and not again[3].cached


def test_freshness_and_names(spark):
    df = spark.createDataFrame([(0.0,), (45.0,), (90.0,), (None,), (-1.0,)], "a double")
    assert [r[0] for r in df.select(search.freshness(F.col("a"))).collect()] == [1.5, 1.25, 1.0, 1.0, 1.0]
    assert [records.string_list(x) for x in (None, "", "a", ["a", None, 1], 5)] == [[], [], ["a"], ["a", "1"], ["5"]]
    labels = spark.createDataFrame([("https://h/docs/x", "table"), ("https://h/other", "a table"), (None, None)], "u string, t string")
    got = [r[0] for r in labels.select(records.prefix_labels(F.col("u"), F.col("t"), {"docs": ["/docs"]}, {"data": ["table"]})).collect()]
    assert got == [["docs"], ["data"], []]


LISTING = """<a href="/blog/data/one">One</a> <a href='/blog/data/two?x=1'>Two</a> <a href="/blog/data/one">again</a>
<a href="/t5/blog/old/post">old</a> <a href="/blog/data/page/2">2</a> <a class="pager__next" href="?page=2">more</a>"""


def test_listing():
    base = "https://h.example/blog/data"
    assert records.post_links(LISTING, base) == ["https://h.example/blog/data/one", "https://h.example/blog/data/two?x=1"]
    assert records.next_page(LISTING, base) == "https://h.example/blog/data?page=2"
    assert records.next_page('<a rel="nofollow next" href="/n">x</a>', base) == "https://h.example/n"
    assert records.next_page('<a href="?page=4">4</a><a href="?page=3">3</a>', f"{base}?page=2") == "https://h.example/blog/data?page=3"
    assert records.next_page(None, base) is None and records.post_links(None, base) == []


def test_listing_crawl():
    pages = {"https://h/s": '<a href="/blog/a/1">x</a><a rel="next" href="/s2">n</a>', "https://h/s2": '<a href="/blog/a/2">x</a><a href="/blog/a/3">x</a><a rel="next" href="/s3">n</a>', "https://h/s3": '<a href="/blog/a/2">x</a><a rel="next" href="/s4">n</a>'}

    def fetch(url):
        if url.endswith("/3"):
            raise OSError("gone")
        return pages.get(url, url)

    posts, errors = records.crawl_listing("https://h/s", fetch, lambda text, url: {"url": url}, set())
    assert records.crawl_listing("https://h/s", fetch, lambda text, url: {"url": url}, {"https://h/blog/a/1"}) == ([], [])  # nothing new on the first page
    assert [p["url"] for p in posts] == ["https://h/blog/a/1", "https://h/blog/a/2"] and [e["url"] for e in errors] == ["https://h/blog/a/3"]


@pytest.mark.parametrize("label, want", [("MS_Learn", "ms-learn"), ("docs", "ms-learn"), (" RSS ", "azure-update"), ("YouTube", "video-transcript"), ("else", None), (None, None)])
def test_source_types(spark, sf, label, want):
    df = spark.createDataFrame([(label,)], "t string")
    got = df.select(records.resolve_type(F.col("t"), table(spark, sf, "chunk_config")).alias("c")).select("c", records.strategy(F.col("c")).alias("s")).head()
    assert got.c == want and got.s == {"azure-update": "whole", "video-transcript": "transcript"}.get(want, "document")
