"""Source trees and stored slices as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.session import ship

#: Folders that are never looked into.
IGNORED = ("node_modules", ".git", "dist", "build", "__pycache__", ".venv", "vendor", "coverage")


def discover(spark: SparkSession, root: str, glob: str = "*", ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """path (below root), size, modified, body of the text files below ``root``; ignored folders are pruned.

    Spark's scan passes over files without any content, so these are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*", "/")
    path = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), F.concat(F.lit("^"), base, F.lit("/")), "")
    found = files.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.expr("try_validate_utf8(content)").alias("body"))
    return found.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, ignored))))


def manifest(files: DataFrame) -> DataFrame:
    """path, size, modified and digest of each file."""
    return files.select("path", "size", "modified", F.sha2("body", 256).alias("digest"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files by status. Digests are compared only where size or time differ."""
    a, b = old.toDF("path", "o_size", "o_modified", "o_digest").withColumn("was", F.lit(1)), new.toDF("path", "n_size", "n_modified", "n_digest").withColumn("stays", F.lit(1))
    same = (F.col("o_size") == F.col("n_size")) & (F.col("o_modified") == F.col("n_modified"))
    status = F.when(F.col("was").isNull(), "added").when(F.col("stays").isNull(), "deleted").when(same | (F.col("o_digest") == F.col("n_digest")), "unchanged").otherwise("modified")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def _documents(kind: str):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if kind == "yaml":
            import yaml

            load = lambda text: list(yaml.safe_load_all(text))
            wrong = yaml.YAMLError
        else:
            load, wrong = (lambda text: [json.loads(text)]), ValueError
        for pdf in batches:
            rows = []
            for path, body in zip(pdf["path"], pdf["body"]):
                try:
                    docs = load(body) if body is not None else []
                except wrong:
                    continue
                rows += [(path, i, json.dumps(d, default=str, sort_keys=True)) for i, d in enumerate(docs) if isinstance(d, dict)]
            yield pd.DataFrame(rows, columns=["path", "n", "document"])

    return read


def documents(files: DataFrame, kind: str = "yaml") -> DataFrame:
    """path, n, document (VARIANT) of each mapping in YAML or JSON files; files that do not parse give none.

    YAML needs the PyYAML library on the workers.
    """
    ship(files.sparkSession)
    rows = files.select("path", "body").mapInPandas(_documents(kind), "path string, n int, document string")
    return rows.select("path", "n", F.parse_json("document").alias("document"))


def slices(files: DataFrame, kind: str = "yaml") -> DataFrame:
    """Slices stored one a document: key, domain, type, id, path, tags, refs. The first path wins on a key."""
    d = documents(files, kind)
    get = lambda p, t="string": F.try_variant_get("document", p, t)
    s = d.select("path", get("$._slice.domain").alias("domain"), get("$._slice.type").alias("type"), get("$._slice.id").alias("id"), get("$._slice.tags", "array<string>").alias("tags"), get("$._slice.source_files", "array<string>").alias("source_files"),
                 get("$._slice.references", "array<struct<domain string, type string, id string>>").alias("refs")).dropna(subset=["domain", "type", "id"])
    s = s.withColumn("key", F.concat_ws("/", "domain", "type", "id"))
    cols = ["path", "domain", "type", "id", "tags", "source_files", "refs"]
    return s.groupBy("key").agg(F.min_by(F.struct(*cols), "path").alias("s")).select("key", "s.*")
