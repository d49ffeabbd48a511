"""Functions paired with their documentation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.grammars import grammar
from graphlens.llm.islands import ISLANDS, is_trivial
from graphlens.llm.syntax import is_valid, language_of
from graphlens.session import ship, spread


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for key, language, body in zip(pdf["file_id"], pdf["language"], pdf["body"]):
            # The cheap pass first: only files with something to give are checked for validity.
            names: list[str] = []
            islands = ISLANDS[language](body, names) if language == "python" else ISLANDS[language](body)
            found = [x for x in islands if not is_trivial(x.doc, x.name)]
            if found and (bool(grammar(language).accepted(names)) if names else is_valid(language, body)):
                rows += [(key, x.qualname, x.line, language, x.doc) for x in found]
        yield pd.DataFrame(rows, columns=["file_id", "qualname", "def_line", "language", "documentation"])


def doc_pairs(files: DataFrame, key: str = "file_id", path: str = "file_path", body: str = "body") -> DataFrame:
    """file_id, qualname, def_line, language, documentation of each documented definition.

    Python and TypeScript files that are valid in the language of their path. Definitions without
    documentation, or with trivial documentation (``islands.is_trivial``), are left out.

    Defined results: null bodies, null paths and other languages give no row; repeated rows repeat; no
    rows give no rows; columns other than key, path and body are not read.
    """
    ship(files.sparkSession)
    picked = files.select(F.col(key).alias("file_id"), language_of(F.col(path)).alias("language"), F.col(body).alias("body"))
    picked = picked.filter(F.col("language").isin(*ISLANDS) & F.col("body").isNotNull())
    return spread(picked).mapInPandas(_pairs, f"file_id {files.schema[key].dataType.simpleString()}, qualname string, def_line int, language string, documentation string")
