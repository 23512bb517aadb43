"""Text, hashing, URL and scoring expressions; all of them built-in Catalyst functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII white space as both engines read it.
SPACE = r"[ \t\n\r\f]+"


def sha_of(*parts: Column, sep: str = ":") -> Column:
    """SHA-256 hex of the parts joined by ``sep``; a null part counts as the empty text."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def chunk_id(url: Column, index: Column) -> Column:
    return sha_of(url, index)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    found = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACE}|{SPACE}$", ""), SPACE)
    return F.filter(found, lambda w: w != "")


def token_count(text: Column) -> Column:
    """Tokens by the rule words x 1.3, rounded down (the rule without a vocabulary)."""
    return F.floor(F.size(words(text)) * F.lit(13) / 10).cast("int")


def normal_query(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), SPACE, " "), "^ | $", "")


def cache_key(question: Column, agent: Column, filters: dict[str, Column]) -> Column:
    """SHA-256 of normalised question, agent and the filters as JSON with sorted keys."""
    body = F.concat_ws(", ", *[F.concat(F.lit(f'"{k}": "'), v, F.lit('"')) for k, v in sorted(filters.items())])
    return sha_of(normal_query(question), agent, F.concat(F.lit("{"), body, F.lit("}")), sep="|")


def strip_tags(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "<[^>]+>", " "))


def tidy(text: Column) -> Column:
    """Runs of blanks to one, three or more line feeds to two, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), "\n{3,}", "\n\n"), f"^{SPACE}|{SPACE}$", "")


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("-"), F.lit(" ")))


def clock(seconds: Column) -> Column:
    """``M:SS`` or ``H:MM:SS``, fractions cut off."""
    s = F.floor(seconds).cast("int")
    h, m = F.floor(s / 3600).cast("int"), F.floor((s % 3600) / 60).cast("int")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def filter_value(text: Column) -> Column:
    """Letters, digits, blank, underscore and hyphen only, at most 64 characters."""
    return F.substring(F.regexp_replace(text, "[^a-zA-Z0-9_ -]", ""), 1, 64)


def safe_key(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z0-9_-]", "_")


def string_list(values: Column) -> Column:
    """Null to the empty array, null elements dropped."""
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull())


def one_or_none(value: Column) -> Column:
    """A single text as a list: none for null and the empty text."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(value))


def video_link(video: Column, start: Column) -> Column:
    """Watch URL of a bare video id, with the start second where there is one."""
    url = F.when(video.startswith("http"), video).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), video))
    return F.when(start.isNotNull() & url.contains("youtube"), F.concat(url, F.lit("&t="), F.floor(start).cast("int").cast("string"))).otherwise(url)


def normal_url(url: Column, locale: str = "/en-us", host: str = "localhost") -> Column:
    """Scheme, host and path with locale prefix; query, fragment and trailing slashes dropped."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    scheme = F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1)
    netloc = F.regexp_extract(bare, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(bare, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/]*", ""), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    path = F.when(path.startswith(locale), path).otherwise(F.concat(F.lit(locale), path))
    return F.concat(F.coalesce(F.nullif(scheme, F.lit("")), F.lit("https")), F.lit("://"), F.coalesce(F.nullif(netloc, F.lit("")), F.lit(host)), path)


def labels(text: Column, vocabulary: dict[str, list[str]], default: str | None = None) -> Column:
    """Labels of which any signal occurs in the lower-cased text, in the order of the vocabulary; ``default`` if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.array(*[F.when(any_of(low, signals), F.lit(label)) for label, signals in vocabulary.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found) if default else found


def any_of(low: Column, signals: list[str]) -> Column:
    """Whether any of the signals occurs."""
    hit = F.lit(False)
    for s in signals:
        hit = hit | low.contains(s)
    return hit


def mentioned(text: Column, names: list[str]) -> Column:
    """Names found in the text without regard to case, in canonical spelling, in order of first mention."""
    pattern = "(?i)" + "|".join(n.replace("+", "\\+").replace(".", "\\.") for n in names)
    canonical = F.create_map(*[F.lit(x) for n in names for x in (n.lower(), n)])
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda m: F.element_at(canonical, F.lower(m))))


def route(question: Column, rules: list[tuple[str, list[str]]], default: str, preferred: Column | None = None, valid: list[str] | None = None) -> Column:
    """First rule with a keyword in the lower-cased question; a valid preferred name goes first."""
    low = F.lower(F.coalesce(question, F.lit("")))
    out = F.lit(None).cast("string")
    for name, keywords in reversed(rules):
        out = F.when(any_of(low, keywords), F.lit(name)).otherwise(out)
    out = F.coalesce(out, F.lit(default))
    return F.when(preferred.isin(*(valid or [n for n, _ in rules])), preferred).otherwise(out) if preferred is not None else out


# Phrases by which an answer hedges.
HEDGES = [
    "i don't have", "not sure", "no information", "cannot find", "unclear", "i'm not able", "outside my knowledge",
    "no relevant", "i couldn't find", "not enough information",
]


def confidence(n_citations: Column, top_score: Column, answer: Column) -> Column:
    """Confidence in an answer: 0.3 without citations, else weighted score, support, length and base less a hedging penalty, in 0.1..0.95."""
    hedge = F.when(any_of(F.lower(answer), HEDGES), 0.3).otherwise(0.0)
    raw = top_score * 0.40 + F.least(n_citations / 5.0, F.lit(1.0)) * 0.25 + F.least(F.length(answer) / 200.0, F.lit(1.0)) * 0.20 + 0.15 - hedge
    return F.when(n_citations <= 0, 0.3).otherwise(F.least(F.greatest(raw, F.lit(0.1)), F.lit(0.95)))


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two float arrays in double precision; null if either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def expand(terms: Column, synonyms: dict[str, list[str]]) -> Column:
    """Terms with the synonyms of each behind it, each once."""
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v]))])
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(table, t), none)))))


def matches_glob(key: Column, glob: str) -> Column:
    """Whether a key matches a pattern with ``*`` and ``?`` (for dropping cached entries)."""
    import re

    pattern = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return key.rlike(f"(?s)^{pattern}$")
