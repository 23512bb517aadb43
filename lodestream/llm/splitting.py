"""Cutting oversized texts at natural boundaries, with overlap.

A token is a longest run of characters other than space, tab, CR and LF.  Each
token is written as one letter telling the strongest boundary behind it, and a
regular expression with bounded quantifiers consumes that string: alternatives
ordered by strength take up to the limit, the last one cuts between any two
tokens.  Every piece after the first looks back by the overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import spread, type_names

#: Boundary letters, strongest first: topic, paragraph, line, sentence, clause.
STRENGTH = "tplsc"
#: Marks a topic change between transcript segments.
TOPIC = "\n\n\n\n"


def units(text: Column) -> Column:
    """Tokens, each with the white space before it."""
    return F.regexp_extract_all(F.rtrim(text, F.lit(" \t\r\n")), F.lit(r"[ \t\r\n]*[^ \t\r\n]+"), F.lit(0))


def _letters(unit: str) -> Column:
    """One boundary letter per token of array column ``unit``; the last token ends the text."""

    def letter(u: Column, i: Column) -> Column:
        gap = F.regexp_extract(F.coalesce(F.get(unit, i + 1), F.lit("")), r"^[ \t\r\n]*", 0)
        lines = F.length(F.regexp_replace(gap, r"[^\n]", ""))
        return (
            F.when(lines >= 4, "t").when(lines >= 2, "p").when(lines == 1, "l")
            .when(F.right(u, F.lit(4)).rlike("[.!?…。！？][\"'”’»)\\]]*$"), "s").when(F.right(u, F.lit(1)).rlike("[,;:–—)]"), "c").otherwise("w")
        )

    return F.array_join(F.transform(unit, letter), "")


def _pattern(limit: Column, overlap: Column) -> Column:
    """Regular expression over boundary letters: the first piece holds ``limit`` tokens, later ones leave room for the overlap."""

    def alternatives(room: Column) -> Column:
        least = F.ceil(room / 2).cast("int")
        cuts = [F.concat(F.lit(".{"), F.greatest(least - 1, F.lit(0)), F.lit(","), room - 1, F.lit(f"}}[{STRENGTH[: i + 1]}]")) for i in range(len(STRENGTH))]
        return F.concat_ws("|", F.concat(F.lit(".{1,"), room, F.lit("}$")), *cuts, F.concat(F.lit(".{1,"), room, F.lit("}")))

    return F.concat(F.lit("^(?:"), alternatives(limit), F.lit(")|(?:"), alternatives(limit - overlap), F.lit(")"))


def split(df: DataFrame, text: str, limit: str, overlap: str, out: str = "pieces") -> DataFrame:
    """``df`` with ``out``: array of struct(piece_no, first_token, n_tokens, n_new, text).

    A text within ``limit`` tokens is one piece, its white space trimmed; null
    and blank texts, and rows without a positive limit, have no pieces (empty
    array).  ``overlap`` counts tokens taken over from the piece before; null
    and negative ones count as 0, others are held below the limit.  Pieces are
    in order, cover all tokens and never exceed the limit.
    """
    room = F.greatest(F.col(limit).cast("int"), F.lit(0))
    back = F.least(F.greatest(F.coalesce(F.col(overlap).cast("int"), F.lit(0)), F.lit(0)), room - 1)
    step = df.withColumns({"_room": F.coalesce(room, F.lit(0)), "_back": F.coalesce(back, F.lit(0)), "_units": F.coalesce(units(F.col(text)), F.array().cast("array<string>"))})
    n = F.size("_units")
    step = step.withColumn("_cuts", F.when(F.col("_room") < 1, F.array().cast("array<int>")).when(n == 0, F.array().cast("array<int>")).when(n <= F.col("_room"), F.array(n)))
    taken = F.transform(F.regexp_extract_all(_letters("_units"), _pattern(F.col("_room"), F.col("_back")), F.lit(0)), lambda m: F.length(m))
    step = step.withColumn("_cuts", F.when(F.col("_cuts").isNull(), taken).otherwise(F.col("_cuts")))
    # running ends of the new tokens of each piece
    ends = F.aggregate("_cuts", F.array(F.lit(0)), lambda acc, k: F.concat(acc, F.array(F.element_at(acc, -1) + k)))
    step = step.withColumn("_ends", ends)

    def piece(k: Column, i: Column) -> Column:
        start = F.get("_ends", i)
        over = F.when(i > 0, F.least(F.col("_back"), start)).otherwise(0)
        body = F.regexp_replace(F.array_join(F.slice("_units", start - over + 1, k + over), ""), r"^[ \t\r\n]+", "")
        return F.struct(i.alias("piece_no"), (start - over).alias("first_token"), (k + over).alias("n_tokens"), k.alias("n_new"), body.alias("text"))

    # the row number makes the column indeterminate, so that no filter on it is pushed below and evaluates all steps again inside itself
    settled = F.when(F.monotonically_increasing_id() >= 0, F.transform("_cuts", piece))
    return step.withColumn(out, settled).drop("_room", "_back", "_units", "_cuts", "_ends")


def with_transcript(df: DataFrame, segments: str, gap: str, out: str = "_text") -> DataFrame:
    """``df`` with ``out``: segment texts by start time, a line each, and a stretch of empty lines where the silence exceeds ``gap`` seconds.

    A segment ends at ``end_time``, else at start plus duration, else at its
    start; blank and null texts are left out; segments without start come last.
    """
    kept = F.filter(segments, lambda s: s.isNotNull() & s["text"].rlike(r"[^ \t\r\n]"))
    timed = F.transform(
        kept,
        lambda s, i: F.struct(
            s["start"].isNull().alias("late"), s["start"].alias("start"), i.alias("pos"),
            F.coalesce(s["end_time"], s["start"] + F.coalesce(s["duration"], F.lit(0.0))).alias("end"), s["text"].alias("text"),
        ),
    )
    step = df.withColumn("_ordered", F.array_sort(timed))
    before = lambda i: F.get("_ordered", i - 1)["end"]
    lead = F.transform("_ordered", lambda s, i: F.concat(F.when(i == 0, "").when(s["start"] - before(i) > F.col(gap), TOPIC).otherwise("\n"), s["text"]))
    return step.withColumn(out, F.array_join(lead, "")).drop("_ordered")


def split_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Post bodies and video transcripts with the limits of their type and their pieces: tab, rec_id, pieces."""
    config = table(spark, sf_dir, "chunk_config")
    limits = config.groupBy(F.col("source_type").alias("_type")).agg(F.max("max_chunk_tokens").alias("_limit"), F.max("overlap_tokens").alias("_overlap"), F.max("topic_gap_seconds").alias("_gap"))
    named = type_names(config).join(limits, F.col("source_type") == F.col("_type")).drop("source_type")
    posts = table(spark, sf_dir, "techcommunity_posts").select(F.lit("techcommunity_posts").alias("tab"), F.col("post_id").alias("rec_id"), F.col("body_text").alias("_text"), F.lower(F.trim("source_type")).alias("alias"))
    posts = posts.join(named, "alias").select("tab", "rec_id", "_text", "_limit", "_overlap")
    one = limits.where("_type = 'video-transcript'").withColumn("alias", F.lit("video-transcript"))
    videos = table(spark, sf_dir, "videos").select(F.lit("videos").alias("tab"), F.col("video_row").alias("rec_id"), "transcript_segments", F.lit("video-transcript").alias("alias"))
    videos = with_transcript(videos.join(one, "alias"), "transcript_segments", "_gap").select("tab", "rec_id", "_text", "_limit", "_overlap")
    return split(spread(posts.unionByName(videos)), "_text", "_limit", "_overlap").select("tab", "rec_id", "pieces")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that exceed the limit of their type, as the splitter cuts them."""
    return split_items(spark, sf_dir).where(F.size("pieces") > 1).select("tab", "rec_id")


def p7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all items."""
    return split_items(spark, sf_dir).select("tab", "rec_id", F.inline("pieces"))


P7_FOUND_SQL = r"""
WITH names AS (
  SELECT lower(trim(a)) AS alias, min(max_chunk_tokens) AS lim
  FROM (SELECT unnest(list_append(coalesce(aliases, []), source_type)) AS a, max_chunk_tokens FROM chunk_config) GROUP BY 1
)
SELECT 'techcommunity_posts' AS tab, post_id AS rec_id FROM techcommunity_posts JOIN names ON lower(trim(source_type)) = alias
WHERE len(regexp_extract_all(body_text, '[^ \t\r\n]+')) > lim
UNION ALL
SELECT 'videos', video_row FROM videos
WHERE list_sum(list_transform(transcript_segments, lambda s: len(regexp_extract_all(coalesce(s.text, ''), '[^ \t\r\n]+'))))
  > (SELECT max(max_chunk_tokens) FROM chunk_config WHERE source_type = 'video-transcript')
"""
