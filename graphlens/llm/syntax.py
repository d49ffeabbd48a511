"""Source files that do not parse in the language of their path."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id
from graphlens.llm.grammars import grammar
from graphlens.llm.lexers import LEXERS
from graphlens.session import ship, spread

#: The extensions of each language.
EXTENSIONS = {"py": "python", "ts": "typescript", "json": "json", "yaml": "yaml", "yml": "yaml", "css": "css", "cs": "csharp"}


def dialects(language: str, text: str) -> set[str]:
    """The dialects of a language that accept the text."""
    names, fresh = LEXERS[language](text)
    return grammar(language).accepted(names, fresh)


def is_valid(language: str, text: str) -> bool:
    """Whether a dialect of the language accepts the text."""
    return bool(dialects(language, text))


def language_of(path) -> F.Column:
    """Language by the extension of a path; null for others."""
    ext = F.regexp_extract(norm_id(path), r"\.([A-Za-z]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.try_element_at(known, ext)


def _verdicts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["valid"] = [None if body is None else is_valid(lang, body) for lang, body in zip(pdf["language"], pdf["body"])]
        yield pdf.drop(columns="body")


def check_files(files: DataFrame, keys: list[str], path: str = "file_path", body: str = "body") -> DataFrame:
    """keys, ``language`` and ``valid`` of each file whose path names a supported language.

    Each body is recognised by the grammar of its language, all dialects in one pass; ``valid`` is
    false where every dialect rejects it. Whole bodies are read, in the tasks that scan them (spread out first if these are fewer than the cores).

    Defined results: a null body has ``valid`` null; an empty body is valid except for JSON; null paths
    and other extensions give no row; repeated rows repeat; no rows give no rows. Other columns than
    keys, path and body are not read.
    """
    ship(files.sparkSession)
    picked = files.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], language_of(F.col(path)).alias("language"), F.col(body).alias("body"))
    picked = picked.filter("language is not null")
    schema = ", ".join([*(f"k{i} {files.schema[k].dataType.simpleString()}" for i, k in enumerate(keys)), "language string, valid boolean"])
    out = spread(picked).mapInPandas(_verdicts, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], "language", "valid")


def rates(checked: DataFrame, by: list[str]) -> DataFrame:
    """Files, files with a body that do not parse, and their share, for each value of ``by``."""
    read = checked.filter("valid is not null").groupBy(*by)
    return read.agg(F.count("*").alias("n_files"), F.count_if(~F.col("valid")).alias("n_invalid")).withColumn("invalid_rate", F.round(F.col("n_invalid") / F.col("n_files"), 6))
