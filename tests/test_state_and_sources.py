import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodestream.operators import index, retrieval
from lodestream.session import fresh_dir
from lodestream.sources import html, providers
from lodestream.streaming import rates

T0 = datetime(2024, 1, 1)


def events(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = [(i, rng.choice([1, 1, 1, 2, None]), T0 + timedelta(seconds=rng.choice([0, 5, 20, 59, 60, 61, 300]) * i // 7)) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 1, None)], "event_id long, user_id long, ts timestamp"), rows


def test_rate_window_by_hand(spark):
    df, rows = events(spark)
    got = {r.event_id: r.allowed for r in rates.rate_limited(df, ["user_id"], "ts", "event_id", 3).collect()}
    want, kept = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        w = kept.setdefault(u, [])
        w[:] = [x for x in w if x > t - timedelta(seconds=60)]
        want[i] = len(w) < 3
        if want[i]:
            w.append(t)
    assert got == want and set(want.values()) == {True, False}
    assert rates.rate_limited(df.limit(0), ["user_id"], "ts", "event_id", 3).count() == 0


def test_cache_by_hand(spark):
    df, rows = events(spark, seed=5)
    got = {r.event_id: r.hit for r in rates.cached(df, ["user_id"], "ts", "event_id", 60.0).collect()}
    want, since = {}, {}
    for i, u, t in sorted(rows, key=lambda r: (r[2], r[0])):
        want[i] = u in since and t < since[u] + timedelta(seconds=60)
        if not want[i]:
            since[u] = t
    assert got == want


def test_upsert_and_versions(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "n int, k string, v string")
    new = spark.createDataFrame([(4, "b", "w"), (5, "b", "v"), (6, "c", "u"), (7, None, "t")], "n int, k string, v string")
    got = sorted((str(r.k), r.v) for r in index.upsert(old, index.latest(new, "k", ["n"]), "k").collect())
    assert got == [("None", "t"), ("None", "z"), ("a", "x"), ("b", "v"), ("c", "u")]
    again = index.delta(new, new, "k", "v")
    assert [r.n for r in again.collect()] == [7]  # a null key counts as new
    assert spark.read.parquet(index.write_version(old, f"file://{tmp_path}", 1)).count() == 3
    assert [r.n for r in index.orphans(old, new, "k", "n").collect()] == [2]


def test_stream_equals_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(f"k{i % 7}", k * 10 + i) for i in range(10)], "k string, n long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k string, n long").option("maxFilesPerTrigger", 1).parquet(src)
    root = fresh_dir(spark, "stream")
    q = rates.upsert_batches(stream, root, "k", ["n"], f"{tmp_path}/cp")
    q.awaitTermination(120)
    got = {r.k: r.n for r in spark.read.parquet(f"{root}/version-{2:012d}").collect()}
    assert got == {r.k: r.n for r in index.latest(spark.read.parquet(src), "k", ["n"]).collect()}


def test_stream_drops_repeats(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows = [(1, T0), (1, T0), (2, T0 + timedelta(seconds=5))]
    spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.parquet(src)
    stream = rates.new_events(spark.readStream.schema("id long, ts timestamp").parquet(src), "ts", ["id"], "1 hour")
    q = stream.writeStream.format("memory").queryName("fresh").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("fresh").collect()) == [1, 2]
    assert rates.new_events(spark.read.parquet(src), "ts", ["id"], "1 hour").count() == 2


def test_retrieval(spark):
    docs = spark.createDataFrame([(1, "red apple pie"), (2, "apple apple"), (3, None), (4, ""), (5, "green tea")], "id long, t string")
    qs = spark.createDataFrame([(1, "Apple?"), (2, "nothing"), (3, None)], "q long, s string")
    got = retrieval.bm25(docs, "id", "t", qs, "q", "s", 5).collect()
    assert [(r.q, r.id, r["rank"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 2, 1), (1, 1, 2)]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "id long, v array<float>")
    near = {(r.q, r.d): r.score for r in retrieval.nearest(v, "id", "v", v, 2, block=2).collect()}
    assert near[1, 2] == 0.707107 and (1, 3) not in near and (1, 1) not in near
    hits = spark.createDataFrame([("u", 1, 0.5), ("u", 2, 0.5), ("w", 3, 1.7)], "url string, pos int, s double")
    best = {r.url: (r.pos, r.relevance) for r in retrieval.best_per_url(hits, "url", "s", "pos").collect()}
    assert best == {"u": (1, 0.5), "w": (3, 1.0)}


PAGE = """<html><head><title>Page | Site</title><meta name='ms.date' content='2024-05-01'>
<script type='application/ld+json'>{"@type": "BreadcrumbList", "itemListElement": [{"position": 1, "name": "A"}, {"position": 2, "name": "B"}]}</script></head>
<body><nav><a href='/nav'>n</a></nav><main><h1>Heading</h1><p>Some <b>bold <a href='../x/y/?q=1#f'>text</a></b> with enough length to stay here.
<ul><li>one<li>two</ul><pre>a  = 1</pre><table><tr><th>h</th><th>k</th></tr></table></main><footer>foot</footer></body></html>"""


def test_pages(spark):
    r = html.parse_pages(spark.createDataFrame([("https://h.example/a/b/c", PAGE), ("u", "<p>thin"), (None, None)], "url string, html string"), "url", "html").collect()
    assert len(r) == 1 and r[0].title == "Heading" and r[0].published == "2024-05-01" and list(r[0].breadcrumb) == ["A", "B"]
    assert list(r[0].links) == ["https://h.example/nav", "https://h.example/a/x/y"]
    assert "**bold text**" in r[0].body and "- one\n- two" in r[0].body and "```\na  = 1\n```" in r[0].body and "foot" not in r[0].body and "Heading" not in r[0].body


def test_crawl_and_feed(spark, tmp_path):
    pages = spark.createDataFrame([("s/1", ["s/2", "x/9"]), ("s/2", ["s/3", "s/1"]), ("s/3", [])], "url string, links array<string>")
    assert {r.url: r.depth for r in html.crawl(spark, pages, ["s/1"], 100, ["s/"]).collect()} == {"s/1": 0, "s/2": 1, "s/3": 2}
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>t</title><link>l</link><category>a</category><category>b</category></item><item><title>u</title></item></channel></rss>")
    got = html.read_feed(spark, str(tmp_path / "f.xml")).orderBy("title").collect()
    assert [(r.title, r.link) for r in got] == [("t", "l"), ("u", None)] and list(got[0].category) == ["a", "b"]


def test_providers(spark):
    answers = iter([(429, "", "7"), (503, "", None), (200, "ok", None)])
    waits = []
    assert providers.fetch_with_retry(lambda u: next(answers), "u", sleep=waits.append) == "ok" and waits == [7.0, 2.0]
    assert providers.fetch_with_retry(lambda u: (404, "", None), "u") is None
    chunks = spark.createDataFrame([("a b",), ("a b",), (None,), ("",), ("c",)], "content string")
    first = providers.embed_new(chunks, None, "content", lambda: providers.hashing_embedder(8))
    got = {r.content: r.embedding for r in first.collect()}
    assert len(got["a b"]) == 8 and got[None] is None and got[""] is None
    cache = first.where("embedding is not null").select("content_hash", "embedding").distinct()

    def broken():
        def fail(texts):
            raise RuntimeError

        return fail

    again = {r.content: r.embedding for r in providers.embed_new(chunks, cache, "content", broken).collect()}
    assert again["a b"] == got["a b"] and again["c"] == got["c"]
    asked = providers.complete(spark.createDataFrame([("q",)], "p string"), "p", lambda: lambda t: t + "!")
    assert asked.head()["answer"] == "q!" and F is not None


def test_rules_and_halved_limits(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [(1, "u", "/api/query", at(0)), (2, "u", "/api/query/x", at(1)), (3, "u", "/api/quiz", at(2)), (4, "u", "/other", at(3)), (5, "v", "/api/query", at(4)), (6, "u", None, at(5))]
    df = spark.createDataFrame(rows, "id long, client string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r.id: (r.rule, r.status, r.max_requests) for r in rates.rate_rules(df, ["client"], "path", [("/api/query", 1), ("/api", 5)], "ts", "id").collect()}
    assert got == {1: ("/api/query", 200, 1), 2: ("/api/query", 429, 1), 3: ("/api", 200, 5), 4: (None, 200, None), 5: ("/api/query", 200, 1), 6: (None, 200, None)}
    assert rates.halved({"query": 9, "quiz": 1}, {"ingest": 2}) == {"query": 4, "quiz": 1, "ingest": 2}


def test_atom_and_outbound_links(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<feed><entry><title type='text'>T</title><link rel='self' href='s'/><link rel='alternate' href='l'/><summary>S</summary><updated>2024-01-02T00:00:00Z</updated><category term='a'/><category term='b'/><id>1</id></entry>"
        "<entry><title>U</title><content type='html'>C</content><published>2024-01-01T00:00:00Z</published><id>2</id></entry></feed>"
    )
    got = html.read_atom(spark, str(tmp_path / "a.xml")).orderBy("guid").collect()
    assert [(r.title, r.link, r.description, r.pubDate, r.category) for r in got] == [("T", "l", "S", "2024-01-02T00:00:00Z", ["a", "b"]), ("U", None, "C", "2024-01-01T00:00:00Z", None)]
    pages = spark.createDataFrame([("p", ["https://H.example/de-de/docs/a", "https://h.example/docs/a", "https://h.example/blog", "https://other/docs/a"]), ("q", None)], "url string, links array<string>")
    links = {r.url: r.links for r in html.outbound(pages, ["h.example"], ["/en-us/docs"], "/en-us").collect()}
    assert [u.lower() for u in links["p"]][:1] == ["https://h.example/en-us/docs/a"] and all("/en-us/docs" in u for u in links["p"]) and links["q"] == []


def test_pages_of_any_depth(spark):
    deep = "<main>" + "<div>" * 3000 + "<h1>Head</h1><p>" + "Words of it. " * 10 + "</p>" + "</div>" * 3000 + "</main>"
    got = html.parse_pages(spark.createDataFrame([("u", deep)], "url string, html string"), "url", "html").collect()
    assert len(got) == 1 and got[0].title == "Head" and got[0].body.startswith("Words of it.")
