import pytest
from pyspark.sql import functions as F

from lodestream.functions import text as X
from lodestream.operators import chunking as C

SEG = "video_row long, title string, transcript_segments array<struct<text:string,start:double,duration:double,end_time:double>>"


def chunks(spark, text, most=512, overlap=128):
    return C.chunk_documents(spark.createDataFrame([("https://x.example/a", text)], "url string, t string"), "url", "t", most, overlap).orderBy("chunk_index").collect()


def test_basic_and_blank(spark):
    one = chunks(spark, "A short paragraph about things.")
    assert len(one) == 1 and one[0].total_chunks == 1 and len(one[0].chunk_id) == 64 and len(one[0].fingerprint) == 64 and one[0].token_count == 6
    assert chunks(spark, "   ") == [] and chunks(spark, None) == []


def test_headings_fences_and_paths():
    text = "pre\n\n## One\n\ntext\n\n### Two\n\n```\n# not a heading\n~~~\n```\n\n## Three\n## Four\nend"
    assert C.sections(text) == [("", "pre"), ("## One", "text"), ("## One > ### Two", "```\n# not a heading\n~~~\n```"), ("## Three", ""), ("## Four", "end")]
    assert C.sections("# A\nx") == [("# A", "x")]


def test_long_line_splits_and_overlaps(spark):
    got = chunks(spark, "word " * 1500, 50, 10)
    assert len(got) == 30 and [c.chunk_index for c in got] == list(range(30)) and {c.total_chunks for c in got} == {30}
    words = [f"w{i}" for i in range(60)]
    parts = chunks(spark, " ".join(words), 20, 5)
    assert all(set(a.content.split()[-5:]) <= set(b.content.split()) for a, b in zip(parts, parts[1:]))


def test_fence_stays_whole():
    fence = "```python\n" + "x = 1\n" * 60 + "```"
    groups = C.by_block("Intro text.\n\n" + fence + "\n\nAfter.", 30)
    assert sum(fence in g for g in groups) == 1


def test_sentences_keep_abbreviations():
    assert C.sentences('See e.g. This one. Dr. Who came. "Quoted" he said. No. Five') == ["See e.g. This one.", "Dr. Who came.", '"Quoted" he said.', "No. Five"]
    assert C.sentences("  ") == [""]


def test_every_word_is_kept():
    text = "\n\n".join("Sentence number %d is here. " % i * (i % 40 + 1) for i in range(30))
    assert " ".join(C.by_block(text, 40)).split() == text.split()


def test_transcripts(spark):
    rows = [
        (1, "T", [("a b", 0.0, None, 3.0), ("c", 40.0, 3.0, None)]),
        (2, "T", [("a", 0.0, 2.0, None), ("b", 2.5, 2.0, None), (" ", 4.0, None, None), ("c", 34.5, None, None)]),
        (3, "T", []), (4, "T", None), (5, "T", [("w " * 40, float(i), 1.0, None) for i in range(30)]), (6, "T", [("late", 3723.9, None, None)]),
    ]
    got = C.group_transcripts(spark.createDataFrame(rows, SEG), "video_row", "title", "transcript_segments").orderBy("video_row", "chunk_index").collect()
    by = {k: [r for r in got if r.video_row == k] for k in range(1, 7)}
    assert [len(by[k]) for k in (1, 2, 3, 4, 6)] == [2, 1, 0, 0, 1]
    assert by[1][1].end_time == 43.0 and by[1][0].content == "T | 0:00 – 0:03\n\na b"
    assert by[6][0].content == "T | 1:02:03 – 1:02:03\n\nlate" and by[6][0].end_time == 3723.9
    assert len(by[5]) == 4 and [r.chunk_index for r in by[5]] == [0, 1, 2, 3]


def test_plain_transcript():
    assert C.plain_transcript("one two\n\nthree") == [("", "one two\n\nthree")] and C.plain_transcript(None) == []
    assert len(C.plain_transcript("\n\n".join(["w " * 300] * 3))) == 3


def test_updates_are_never_cut(spark):
    df = spark.createDataFrame([("u", "word " * 2000), ("v", " "), (None, "x")], "url string, s string")
    got = {r.source_url: r for r in C.chunk_whole(df, "url", "s").collect()}
    assert set(got) == {"u", None} and got["u"].token_count == 2600


@pytest.mark.parametrize("question,agent", [("Compare a and b", "compare"), ("Preview of it", "news"), ("zzz", "design"), ("", "design"), (None, "design"), ("INSIDE it", "design")])
def test_routing(spark, question, agent):
    rules = [("news", ["preview"]), ("compare", ["compare"]), ("design", ["inside"])]
    df = spark.createDataFrame([(question, None), (question, "guide"), (question, "news")], "q string, p string")
    got = [r[0] for r in df.select(X.route(F.col("q"), rules, "design", F.col("p"))).collect()]
    assert got == [agent, agent, "news"]


def test_confidence_and_links(spark):
    df = spark.createDataFrame([(0, 0.0, "x", "v", None), (5, 1.0, "y" * 200, "https://youtube.com/w?v=1", 61.9), (1, 0.5, "I'm not sure", "v", 3.0)], "n int, s double, a string, v string, t double")
    got = df.select(X.confidence(F.col("n"), F.col("s"), F.col("a")), X.video_link(F.col("v"), F.col("t"))).collect()
    assert [round(r[0], 4) for r in got] == [0.3, 0.95, 0.112]
    assert [r[1] for r in got] == ["https://www.youtube.com/watch?v=v", "https://youtube.com/w?v=1&t=61", "https://www.youtube.com/watch?v=v&t=3"]


def test_names_and_keys(spark):
    df = spark.createDataFrame([("power bi and Power BI, onelake", "What  IS\n new ")], "t string, q string")
    r = df.select(X.mentioned(F.col("t"), ["OneLake", "Power BI"]), X.normal_query(F.col("q")), X.display_name(F.lit("tech-community")), X.normal_url(F.lit("https://h.example/a/b/?q=1#f"))).head()
    assert (list(r[0]), r[1], r[2], r[3]) == (["Power BI", "OneLake"], "what is new", "Tech Community", "https://h.example/en-us/a/b")


def test_synonyms_and_globs(spark):
    df = spark.createDataFrame([(["ml", "x", "ai"], "a.b:c"), ([], "axb:c"), (None, None)], "t array<string>, k string")
    got = df.select(X.expand(F.col("t"), {"ml": ["machine learning", "ai"]}), X.matches_glob(F.col("k"), "a.*:?")).collect()
    assert [r[0] for r in got] == [["ml", "machine learning", "ai", "x"], [], None] and [r[1] for r in got] == [True, False, None]


def test_one_bad_document_stops_no_other(spark):
    def cutter(text, most, overlap):
        if text == "bad":
            raise ValueError("no")
        return C.document_chunks(text, most, overlap)

    df = spark.createDataFrame([("a", "fine text"), ("b", "bad"), ("c", None)], "url string, text string")
    got = {r.source_url: (r.chunk_index, r.error) for r in C.chunk_documents(df, "url", "text", errors=True, cutter=cutter).collect()}
    assert got == {"a": (0, None), "b": (-1, "ValueError: no")}
    assert [r.source_url for r in C.chunk_documents(df, "url", "text", cutter=cutter).collect()] == ["a"]


def test_plain_transcripts_are_led_by_their_title(spark):
    df = spark.createDataFrame([("v", "T", "one two\n\nthree four"), ("w", None, "x"), ("n", "T", None)], "url string, title string, text string")
    got = sorted((r.source_url, r.chunk_index, r.content) for r in C.chunk_plain_transcripts(df, "url", "title", "text", 3).collect())
    assert got == [("v", 0, "T\n\none two"), ("v", 1, "T\n\nthree four"), ("w", 0, "\n\nx")]
