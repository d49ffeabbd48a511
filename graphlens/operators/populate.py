"""Bringing new extracted state into a stored snapshot, and what changed in meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import Scratch


def statuses(prior: DataFrame, new: DataFrame, key: str, digest: str, processed: DataFrame | None = None, file: str = "file") -> DataFrame:
    """key and status of each record: created, updated, unchanged, deleted.

    With ``processed`` files only records of these may be deleted; those of other files are kept.
    """
    a = prior.select(key, F.col(digest).alias("old"), F.col(file).alias("old_file"), F.lit(1).alias("was"))
    b = new.select(key, F.col(digest).alias("now"), F.lit(1).alias("stays"))
    both = a.join(b, key, "full_outer")
    gone = F.lit("deleted")
    if processed is not None:
        both = both.join(processed.select(F.col(file).alias("old_file"), F.lit(True).alias("done")).distinct(), "old_file", "left")
        gone = F.when(F.col("done").isNotNull(), "deleted").otherwise("unchanged")
    status = F.when(F.col("was").isNull(), "created").when(F.col("stays").isNull(), gone).when(F.col("old").eqNullSafe(F.col("now")), "unchanged").otherwise("updated")
    return both.select(key, status.alias("status"))


def merged(prior: DataFrame, new: DataFrame, key: str, status: DataFrame) -> DataFrame:
    """The state after population: all new rows, and prior ones that stay though not extracted again."""
    kept = prior.join(new.select(key), key, "left_anti").join(status.filter("status = 'unchanged'").select(key), key, "left_semi")
    return new.unionByName(kept, allowMissingColumns=True)


def populate(prior: DataFrame, new: DataFrame, key: str, digest: str, processed: DataFrame | None = None, file: str = "file") -> tuple[DataFrame, DataFrame]:
    """(next state, statuses), both written to the shared folder."""
    scratch = Scratch(new.sparkSession, "populate")
    st = scratch.save(statuses(prior, new, key, digest, processed, file), "status")
    return scratch.save(merged(prior, new, key, st), "state"), st


def enrichments(pairs: DataFrame) -> DataFrame:
    """Changes in meaning between two states of a slice.

    pairs: id, type, old_/new_ signature, methods, files (arrays), keys (arrays), extractor.
    """
    differs = lambda c: F.coalesce(F.array_join(F.array_sort(f"old_{c}"), ","), F.lit("")) != F.coalesce(F.array_join(F.array_sort(f"new_{c}"), ","), F.lit(""))
    other = ~F.col("old_extractor").eqNullSafe(F.col("new_extractor"))
    kinds = F.array_compact(F.array(
        F.when((F.col("type") == "function") & (F.coalesce("old_signature", F.lit("")) != F.coalesce("new_signature", F.lit(""))), "signature_change"),
        F.when((F.col("type") == "class") & differs("methods"), "structure_change"),
        F.when(differs("files"), "ownership_change"),
        F.when(other & (F.size(F.array_except("new_keys", "old_keys")) > 0), "new_properties"),
    ))
    return pairs.select("id", F.explode(kinds).alias("enrichment"), F.when(other, "extractor").otherwise("source").alias("cause"))
