"""Shared pieces of the text operators."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokenizer_dir() -> str:
    """Folder of the public vocabulary files (``LODESTREAM_TOKENIZERS``, else the installed package, else /opt/tokenizers)."""
    if path := os.environ.get("LODESTREAM_TOKENIZERS"):
        return path
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for CPU-bound work over few files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def language(label: Column) -> Column:
    """Two-letter language of a label such as ``EN``, ``en-US`` or ``deu``; ``und`` if null, blank or unspecific."""
    # fixed values: three-letter codes and names met in labels
    longer = {"eng": "en", "deu": "de", "ger": "de", "fra": "fr", "fre": "fr", "spa": "es", "english": "en", "german": "de", "french": "fr", "spanish": "es"}
    base = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]+)", 1)
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    short = F.when((F.length(base) == 2), base)
    return F.coalesce(F.try_element_at(table, base), short, F.lit("und"))


def type_names(config: DataFrame) -> DataFrame:
    """(alias, source_type): every name and alias of ``chunk_config`` in lower case, each once."""
    names = config.select(F.explode(F.array_union(F.array("source_type"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("alias"), "source_type")
    return names.where("alias is not null").groupBy(F.lower(F.trim("alias")).alias("alias")).agg(F.min("source_type").alias("source_type"))
