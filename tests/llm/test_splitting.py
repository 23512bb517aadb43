import re

from pyspark.sql import functions as F

from lodestream.llm import splitting as S
from lodestream.session import table


def tokens(t):
    return re.findall(r"[^ \t\r\n]+", t or "")


def pieces(spark, rows, schema="id int, t string, l int, o int"):
    return {r.id: r.pieces for r in S.split(spark.createDataFrame(rows, schema), "t", "l", "o").collect()}


def check(text, limit, overlap, got):
    w = tokens(text)
    at = 0
    for i, p in enumerate(got):
        assert p.piece_no == i and p.n_tokens <= limit and tokens(p.text) == w[p.first_token : p.first_token + p.n_tokens]
        assert p.first_token == (at - min(overlap, at) if i else 0) and p.first_token + p.n_tokens - p.n_new == at
        at += p.n_new
    assert at == len(w)


def test_cover_limit_and_overlap(spark):
    texts = ["one two", "w " * 1000, "A b c. " * 200, "p q r s\n\n" * 90, "x" * 70000, "!" * 20000 + " y" * 50, "", None, " \n ", "word,\n" * 333]
    rows = [(i, t, 50, 10) for i, t in enumerate(texts)]
    got = pieces(spark, rows)
    for i, t in enumerate(texts):
        check(t, 50, 10, got[i])
    assert [len(got[i]) for i in (0, 6, 7, 8)] == [1, 0, 0, 0]


def test_natural_ends(spark):
    text = "a b c d e f g h. " * 20 + "\n\n" + "k l m n o p. " * 20
    got = pieces(spark, [(1, text, 60, 8)])[1]
    assert all(p.text.rstrip().endswith(".") for p in got)


def test_odd_limits_and_clashing_names(spark):
    rows = [(1, "a b c", None, 1), (2, "a b c", 0, 1), (3, "a b c", 2, None), (4, "a b c", 2, 9), (5, "a b c", 1, 0), (6, "a b c", 2, -3)]
    got = pieces(spark, rows)
    assert [len(got[i]) for i in (1, 2, 3, 4, 5, 6)] == [0, 0, 2, 2, 3, 2]
    for i, (limit, overlap) in {3: (2, 0), 4: (2, 1), 5: (1, 0), 6: (2, 0)}.items():
        check("a b c", limit, overlap, got[i])
    df = spark.createDataFrame([(1, "a b", 1, 0, "n", 7)], "piece_no int, t string, l int, o int, text string, n_tokens int")
    assert S.split(df, "t", "l", "o").select("piece_no", "text").collect()[0] == (1, "n")


def test_filter_on_pieces(spark):
    df = spark.createDataFrame([(1, "a b " * 300, 50, 5), (2, "a", 50, 5)], "id int, t string, l int, o int")
    assert [r.id for r in S.split(df, "t", "l", "o").where(F.size("pieces") > 1).collect()] == [1]


def test_transcripts(spark):
    kind = "id int, g double, s array<struct<text:string,start:double,duration:double,end_time:double>>"
    seg = [("b", 50.0, 1.0, None), ("a", 0.0, None, 2.0), (" ", 3.0, None, None), None, (None, 4.0, None, None), ("c", 60.0, None, None), ("late", None, None, None)]
    df = spark.createDataFrame([(1, 30.0, seg), (2, None, seg[:1]), (3, 1.0, None), (4, 1.0, [])], kind)
    got = {r.id: r["_text"] for r in S.with_transcript(df, "s", "g").collect()}
    assert got == {1: f"a{S.TOPIC}b\nc\nlate", 2: "b", 3: None, 4: ""}


def test_found_by_hand(spark, sf):
    conf = {}
    for r in table(spark, sf, "chunk_config").collect():
        conf |= {n.lower(): r.max_chunk_tokens for n in [*(r.aliases or []), r.source_type]}
    want = {("techcommunity_posts", r.post_id) for r in table(spark, sf, "techcommunity_posts").collect() if r.source_type and len(tokens(r.body_text)) > conf.get(r.source_type.lower(), 10**9)}
    for r in table(spark, sf, "videos").collect():
        if sum(len(tokens(s.text)) for s in r.transcript_segments or []) > conf["video-transcript"]:
            want.add(("videos", r.video_row))
    assert {tuple(r) for r in S.p7_found(spark, sf).collect()} == want and want
