"""Records of feeds, blogs, listings and video catalogues as DataFrames."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def resolve_type(label: Column, names: DataFrame | dict[str, str]) -> Column:
    """Canonical source type of a label, met without regard to case, hyphens, underscores and blanks; null where none is known."""
    bare = F.regexp_replace(F.lower(F.trim(label)), "[-_ ]", "")
    pairs = names if isinstance(names, dict) else type_aliases(names)
    if not pairs:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), bare)


def type_aliases(config: DataFrame) -> dict[str, str]:
    """Bare spelling of every name and alias to its source type (a configuration table of a few rows); of several the smallest."""
    names = config.select(F.explode(F.array_union(F.array("source_type"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("a"), "source_type").where("a is not null and source_type is not null")
    rows = names.groupBy(F.regexp_replace(F.lower(F.trim("a")), "[-_ ]", "").alias("a")).agg(F.min("source_type").alias("t")).collect()
    return {r["a"]: r["t"] for r in rows}


def strategy(source_type: Column) -> Column:
    """How texts of a canonical type are cut; unknown and missing types go as documents."""
    return F.when(source_type == "azure-update", "whole").when(source_type == "video-transcript", "transcript").otherwise("document")


def feed_records(entries: DataFrame, vocabulary: dict[str, list[str]], names: list[str]) -> DataFrame:
    """Entries (link, title, summary, published_at, categories) as records: bare summary, labels, names, fingerprint.

    Null summaries count as empty; categories lose their nulls; the labels
    fall back to ``general``.  ``published_at`` goes on as it is, to be
    resolved by the timestamp dictionary.
    """
    bare = F.coalesce(X.strip_tags(F.col("summary")), F.lit(""))
    hay = F.concat_ws(" ", F.coalesce("title", F.lit("")), bare)
    return entries.select(
        F.col("link").alias("url"), F.coalesce("title", F.lit("")).alias("title"), bare.alias("summary"), "published_at", X.string_list(F.col("categories")).alias("categories"),
        X.sha_of(F.col("link"), F.col("title"), bare).alias("fingerprint"), X.labels(hay, vocabulary, "general").alias("labels"), X.mentioned(hay, names).alias("names"),
    )


def blog_scan(posts: DataFrame, key: str, url: str, published: str, mark: str | None, seen: DataFrame | None) -> DataFrame:
    """New posts of a blog: those whose url isn't in ``seen`` (url) and whose date, as text, lies after ``mark``.

    Of one url the smallest ``key`` counts.  The body is the content, else the
    summary; the summary is cut to 500 characters.  A null date passes only
    without a mark.
    """
    rows = posts.where(F.col(published) > mark) if mark is not None else posts
    if seen is not None:
        rows = rows.join(seen.select(F.col("url").alias(url)).distinct(), url, "left_anti")
    one = rows.where(F.col(url).isNotNull()).groupBy(url).agg(F.min(F.struct(key, "title", "body_text", "summary", published)).alias("r")).select(url, "r.*")
    return one.withColumns({"body": F.coalesce("body_text", "summary", F.lit("")), "summary": F.substring(F.coalesce("summary", F.lit("")), 1, 500)}).drop("body_text")


def prefix_labels(url: Column, text: Column, prefixes: dict[str, list[str]], vocabulary: dict[str, list[str]]) -> Column:
    """Sorted labels whose prefix the url's path begins with; only where there are none, those whose signals the text holds."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/]*)?(/[^?#]*)", 1))
    hits = F.array_compact(F.array(*[F.when(F.greatest(*[path.startswith(p.lower()) for p in ps], F.lit(False)), F.lit(label)) for label, ps in prefixes.items()]))
    return F.array_sort(F.when(F.size(hits) > 0, hits).otherwise(X.labels(text, vocabulary)))


def video_catalog(videos: DataFrame, done: DataFrame) -> DataFrame:
    """Videos no successful run has handled: one row a ``video_id`` (the smallest ``video_row``), with details and transcript or their defaults.

    ``done`` has processed_video_ids and run_status.  Missing transcripts give
    the empty text, language ``unknown`` and no segments; a missing length
    counts as ``PT0S``, a missing or negative view count as 0.
    """
    seen = done.where("run_status = 'succeeded'").select(F.explode("processed_video_ids").alias("video_id")).distinct()
    rows = videos.where("video_id is not null").join(seen, "video_id", "left_anti")
    fields = [c for c in videos.columns if c not in ("video_id", "video_row")]
    one = rows.groupBy("video_id").agg(F.min_by(F.struct("video_row", *fields), "video_row").alias("r")).select("video_id", "r.*")
    told = F.coalesce(F.col("transcript_text"), F.lit("")) != ""
    return one.withColumns(
        {
            "transcript_language": F.when(told, F.coalesce("transcript_language", F.lit("unknown"))).otherwise("unknown"),
            "transcript_text": F.coalesce("transcript_text", F.lit("")),
            "duration_iso": F.coalesce("duration_iso", F.lit("PT0S")),
            "view_count": F.when(F.col("view_count") > 0, F.col("view_count")).otherwise(0),
            "n_segments": F.coalesce(F.size("transcript_segments"), F.lit(0)),
            "url": X.video_link(F.col("video_id"), F.lit(None).cast("double")),
        }
    )


def string_list(value: object) -> list[str]:
    """None and the empty text to nothing, a text to itself, a list to its texts without None, anything else to its text."""
    if value is None or value == "":
        return []
    if isinstance(value, (list, tuple, set)):
        return [str(v) for v in value if v is not None]
    return [str(value)]


_ANCHOR = re.compile(r"""<a\b[^>]*?\bhref\s*=\s*["']([^"'#]+)["'][^>]*>""", re.I)
_ATTRIBUTE = re.compile(r"""([\w-]+)\s*=\s*["']([^"']*)["']""")


def post_links(page: str | None, base: str) -> list[str]:
    """Addresses of the posts a listing names, each once, in order: links below ``/blog/`` with a section and a name that aren't pages of the listing."""
    found = [urljoin(base, m) for m in _ANCHOR.findall(page or "")]
    posts = [u for u in found if re.search(r"/blog/[^/?]+/[^/?]+", u) and "/t5/" not in u and not re.search(r"/page/\d+|[?&]page=", u)]
    return list(dict.fromkeys(posts))


def next_page(page: str | None, base: str) -> str | None:
    """Address of the listing's next page: a link that says so by rel, label or class, else the one numbered one higher than ``base``."""
    links = [(dict((k.lower(), v) for k, v in _ATTRIBUTE.findall(tag)), text) for tag, text in re.findall(r"<(?:a|link)\b([^>]*)>([^<]*)", page or "", re.I)]
    for says in (lambda a: "next" in a.get("rel", "").lower().split(), lambda a: "next" in a.get("aria-label", "").lower(), lambda a: re.search(r"\bnext\b", a.get("class", "").lower().replace("-", " ").replace("_", " "))):
        for attributes, _ in links:
            if attributes.get("href") and says(attributes):
                return urljoin(base, attributes["href"])
    here = re.search(r"(?:[?&]page=|/page/)(\d+)", base)
    wanted = str(int(here[1]) + 1 if here else 2)
    return next((urljoin(base, a["href"]) for a, text in links if text.strip() == wanted and a.get("href")), None)


def crawl_listing(first: str, fetch, parse, seen: set[str], most: int = 20) -> tuple[list[dict], list[dict]]:  # noqa: ANN001
    """(posts, errors) of a section: page by page, the posts not ``seen``, until a page brings nothing new, there is no next one, or ``most`` pages were read.

    ``fetch`` gives a page's text, ``parse`` (text, address) a record or None.
    A post that fails is told in the errors and stops nothing.
    """
    posts, errors, at, known = [], [], first, set(seen)
    for _ in range(most):
        try:
            page = fetch(at)
        except Exception as e:  # noqa: BLE001
            errors.append({"url": at, "error": f"{type(e).__name__}: {e}"})
            break
        fresh = [u for u in post_links(page, at) if u not in known]
        known.update(fresh)
        for url in fresh:
            try:
                record = parse(fetch(url), url)
            except Exception as e:  # noqa: BLE001
                errors.append({"url": url, "error": f"{type(e).__name__}: {e}"})
                continue
            if record:
                posts.append(record)
        at = next_page(page, at)
        if not fresh or not at:
            break
    return posts, errors
