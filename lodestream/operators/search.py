"""Search over an index: filters, projections, captions, rerank, details of a name, and answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import retrieval

#: Weights of the fields in the rerank (title, names, body).
WEIGHTS = {"title": 2.5, "names": 1.5, "body": 1.0}


def facets(**wanted: tuple[Column, list[str] | None]) -> Column:
    """Filter over (column, values) pairs: any value within a facet, all facets together; an absent or empty list filters nothing.

    A column is a scalar or an array; rows whose column is null don't meet a
    filter on it.  Values are compared as they are, without regard to case for
    scalars.
    """
    parts = [F.lit(True)]
    for name, (column, values) in wanted.items():
        if values:
            if name.startswith("any_"):
                parts.append(F.coalesce(F.arrays_overlap(column, F.array(*[F.lit(v) for v in values])), F.lit(False)))
            else:
                parts.append(F.coalesce(F.lower(column).isin([v.lower() for v in values]), F.lit(False)))
    return reduce(lambda a, b: a & b, parts)


def recent(df: DataFrame, when: str, as_of: str, days: int) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; rows without time are left out."""
    at = F.lit(as_of).cast("timestamp")
    return df.where((F.col(when) >= at - F.make_dt_interval(F.lit(days))) & (F.col(when) <= at))


def caption(text: Column, terms: Column, length: int = 300) -> Column:
    """The sentence that holds most of the terms (the first of equals), cut to ``length``; the head of the text if none holds any."""
    body = F.coalesce(text, F.lit(""))
    pieces = F.filter(F.split(body, r"(?<=[.!?])\s+"), lambda s: s != "")
    marked = F.transform(pieces, lambda s, i: F.struct(F.size(F.array_intersect(retrieval.terms(s), terms)).alias("n"), (-i).alias("at"), s.alias("s")))
    best = F.array_max(marked)
    return F.substring(F.when(best["n"] > 0, best["s"]).otherwise(body), 1, length)


def rerank(hits: DataFrame, query: str, terms: str, title: str, names: str, body: str, key: str, k: int = 10) -> DataFrame:
    """Hits by the weighted share of the question's terms that their title, names and body hold; ties by the rank they had, then ``key``."""
    size = F.greatest(F.size(terms), F.lit(1))
    share = lambda c: F.size(F.array_intersect(F.col(terms), c)) / size
    score = F.lit(WEIGHTS["title"]) * share(retrieval.terms(F.col(title))) + F.lit(WEIGHTS["names"]) * share(retrieval.terms(F.array_join(names, " "))) + F.lit(WEIGHTS["body"]) * share(retrieval.terms(F.col(body)))
    w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), "rank", key)
    return hits.withColumn("rerank_score", F.round(score, 6)).withColumn("new_rank", F.row_number().over(w)).where(F.col("new_rank") <= k)


def freshness(age_days: Column, boost: float = 1.5, window: float = 90.0) -> Column:
    """Factor of a hit's age: ``boost`` for new ones, falling to 1 at ``window`` days and after, and without an age."""
    return F.coalesce(F.when((age_days >= 0) & (age_days < window), F.lit(boost) - (F.lit(boost) - 1) * age_days / window), F.lit(1.0))


def details(df: DataFrame, names: str, key: str, description: str, labels: str, url: str) -> DataFrame:
    """Per name: rows, the first description that isn't blank, the sorted union of labels and the first three urls, in order of ``key``.

    A name held by many rows is reduced map-side: descriptions by a minimum,
    labels by distinct values, urls by their first place and a ranked limit.
    """
    rows = df.select(key, description, labels, url, F.explode(F.array_distinct(names)).alias("name")).where("name is not null")
    said = F.when(F.col(description).rlike(r"\S"), F.struct(F.col(key).alias("k"), F.col(description).alias("d")))
    base = rows.groupBy("name").agg(F.count("*").alias("n"), F.min(said).getField("d").alias("description"))
    union = rows.select("name", F.explode(labels).alias("l")).where("l is not null").distinct().groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("l")), ",").alias("labels"))
    first = rows.where(F.col(url).isNotNull()).groupBy("name", url).agg(F.min(key).alias("k"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("k", url))).where("r <= 3")
    urls = first.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(url).alias("u")))), lambda x: x["u"]), " ").alias("urls"))
    return base.join(union, "name", "left").join(urls, "name", "left").select("name", "n", "description", F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("urls", F.lit("")).alias("urls"))


def first_wins(*lists: Column) -> Column:
    """Union of arrays in order of priority, each value once, where it came first; null arrays and nulls count for nothing."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.concat(*[F.coalesce(x, none) for x in lists])))


def unknown_names(wanted: Column, known: list[str]) -> Column:
    """Names asked for that nothing is known of (an error for the caller if there are any)."""
    return F.array_except(F.coalesce(wanted, F.array().cast("array<string>")), F.array(*[F.lit(k) for k in known]))


def answers(questions: DataFrame, query: str, question: str, corpus: DataFrame, key: str, title: str, url: str, text: str, rules: list, default: str, complete, k: int = 5, known: DataFrame | None = None) -> DataFrame:  # noqa: ANN001
    """(``query``, target, cache_key, cached, answer, n_citations, confidence): every question routed, looked up, answered from its hits and judged.

    Equal questions (by cache key) are asked once; ``known`` (cache_key,
    answer, n_citations, confidence) holds earlier answers, which go first.
    ``complete`` makes answers of (key, prompt) rows.  Questions without hits
    are answered without context and get the least confidence.
    """
    asked = questions.select(query, question).withColumn("target", X.route(F.col(question), rules, default)).withColumn("cache_key", X.cache_key(F.col(question), F.col("target"), {}))
    if known is None:
        known = questions.sparkSession.createDataFrame([], "cache_key string, answer string, n_citations bigint, confidence double")
    once = asked.groupBy("cache_key").agg(F.min(question).alias("text")).join(known.select("cache_key"), "cache_key", "left_anti")
    hits = retrieval.bm25(corpus, key, text, once, "cache_key", "text", k)
    shown = hits.join(corpus.select(key, title, url, F.substring(text, 1, 300).alias("_snippet")), key)
    context = retrieval.prompt(shown, "cache_key", "rank", title, url, "_snippet")
    cited = shown.groupBy("cache_key").agg(F.countDistinct(url).alias("n_citations"), F.max("score").alias("top"))
    prompts = once.join(context, "cache_key", "left").select("cache_key", F.concat(F.coalesce("context", F.lit("")), F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("prompt"))
    made = complete(prompts).select("cache_key", "answer").join(cited, "cache_key", "left")
    n = F.coalesce("n_citations", F.lit(0))
    fresh = made.select("cache_key", "answer", n.alias("n_citations"), F.round(X.confidence(n, F.least(F.coalesce("top", F.lit(0.0)), F.lit(1.0)), F.col("answer")), 3).alias("confidence"), F.lit(False).alias("cached"))
    every = fresh.unionByName(known.select("cache_key", "answer", "n_citations", "confidence").withColumn("cached", F.lit(True)))
    return asked.drop(question).join(every, "cache_key", "left").select(query, "target", "cache_key", "cached", "answer", "n_citations", "confidence")
