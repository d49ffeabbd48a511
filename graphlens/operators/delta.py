"""Freshness, drift and validity of extracted state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.functions.ids import norm_id

#: The domains that slices may have.
DOMAINS = tuple("project entrypoints api data graph config errors testing domain conventions observability infrastructure deployment frontend behavior".split())


def latest_scan(files: DataFrame) -> DataFrame:
    """Newest scan of each file: repo, path, source_hash."""
    newest = F.max(F.struct("scanned_at", "source_hash")).alias("scan")
    return files.groupBy("repo", norm_id("file_path").alias("path")).agg(newest).select("repo", "path", "scan.source_hash")


def locator_freshness(locators: DataFrame, files: DataFrame) -> DataFrame:
    """entity_uri and state of each locator: fresh, unhashed, hash_mismatch or missing_source."""
    located = locators.select("entity_uri", "repo", norm_id("file_path").alias("path"), F.col("source_hash").alias("known_hash")).distinct()
    both = located.join(latest_scan(files).withColumn("found", F.lit(True)), ["repo", "path"], "left")
    state = F.when(F.col("found").isNull(), "missing_source").when(F.col("known_hash").isNull() | F.col("source_hash").isNull(), "unhashed")
    return both.select("entity_uri", state.when(F.col("known_hash") == F.col("source_hash"), "fresh").otherwise("hash_mismatch").alias("state")).distinct()


def stale_slices(metadata: DataFrame, files: DataFrame) -> DataFrame:
    """Slices whose newest checksum is not that of the newest scan of a source; missing ones are passed over."""
    rows = metadata.select(norm_id("slice_id").alias("slice_id"), "repo", F.explode("source_files").alias("f"), F.struct("seq_no", "source_checksum").alias("s")).filter("slice_id is not null")
    last = rows.groupBy("slice_id", "repo", norm_id("f").alias("path")).agg(F.max("s").alias("s"))
    return last.join(latest_scan(files), ["repo", "path"]).filter(F.col("s.source_checksum") != F.col("source_hash")).select("slice_id", "path")


def drift(metadata: DataFrame) -> DataFrame:
    """Slices for which one extractor version gave several checksums."""
    rows = metadata.filter("slice_id is not null and extractor_version is not null").groupBy(norm_id("slice_id").alias("slice_id"), "extractor_version")
    return rows.agg(F.countDistinct("source_checksum").alias("n_checksums")).filter("n_checksums > 1")


def coverage(slices: DataFrame, files: DataFrame) -> DataFrame:
    """For each repository how many source files of its slices were scanned."""
    sources = slices.select("repo", F.explode("source_files").alias("f")).select("repo", norm_id("f").alias("path")).distinct()
    both = sources.join(latest_scan(files).select("repo", "path", F.lit(1).alias("found")), ["repo", "path"], "left")
    return both.groupBy("repo").agg(F.count("*").alias("n_sources"), F.count("found").alias("n_found")).withColumn("coverage", F.round(F.col("n_found") / F.col("n_sources"), 6))


def findings(states: DataFrame) -> DataFrame:
    """Violations of the slice schema: rule, severity, n_rows; one pass over the rows."""
    rules = {
        ("missing_id", "ERROR"): F.col("slice_id").isNull(), ("missing_type", "ERROR"): F.col("slice_type").isNull(), ("missing_file", "ERROR"): F.col("file_path").isNull(),
        ("missing_line", "ERROR"): F.col("line_no").isNull(), ("missing_extractor", "ERROR"): F.col("extractor").isNull(), ("unknown_domain", "WARNING"): ~F.coalesce(F.col("slice_domain").isin(*DOMAINS), F.lit(False)),
        ("empty_sources", "WARNING"): F.coalesce(F.size("source_files"), F.lit(0)) <= 0, ("bad_timestamp", "WARNING"): ~F.coalesce(F.col("extracted_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d"), F.lit(False)),
        ("inverted_lines", "WARNING"): F.coalesce(F.col("end_line") < F.col("line_no"), F.lit(False)), ("missing_checksum", "INFO"): F.col("source_checksum").isNull(),
    }
    counts = states.agg(*[F.count_if(c).alias(name) for (name, _), c in rules.items()])
    parts = [F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.col(name).alias("n_rows")) for name, severity in rules]
    return counts.select(F.explode(F.array(*parts)).alias("f")).select("f.*")


def duplicate_ids(slices: DataFrame) -> DataFrame:
    """Ids that several domains or types use."""
    kinds = slices.select(norm_id("slice_id").alias("id"), F.concat_ws("/", "slice_domain", "slice_type").alias("kind")).filter("id is not null")
    return kinds.groupBy("id").agg(F.countDistinct("kind").alias("n_kinds"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds")).filter("n_kinds > 1")


def id_changes(states: DataFrame) -> DataFrame:
    """Files in which an id appeared that another extractor version did not give, by repository and extractor."""
    seen = states.select("repo", "extractor", norm_id("slice_id").alias("id"), norm_id("file_path").alias("path")).distinct()
    return seen.groupBy("repo", "path").agg(F.countDistinct("extractor").alias("n_extractors"), F.countDistinct("id").alias("n_ids")).filter("n_extractors > 1")


def manifest_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status (added, modified, deleted, unchanged) of two manifests; null digests are values."""
    a, b = old.select(key, F.col(digest).alias("old_digest"), F.lit(1).alias("in_old")), new.select(key, F.col(digest).alias("new_digest"), F.lit(1).alias("in_new"))
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(F.col("old_digest").eqNullSafe(F.col("new_digest")), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def identity_findings(before: DataFrame, now: DataFrame) -> DataFrame:
    """severity, path, old_id, new_id of files whose id changed between two runs: INFO if their extractor did too, else ERROR.

    Both: path, id, extractor; of several rows of a path the greatest id counts.
    """
    last = lambda df, side: df.dropna(subset=["path", "id"]).groupBy("path").agg(F.max(F.struct("id", "extractor")).alias(side))
    both = last(before, "old").join(last(now, "new"), "path").filter(F.col("old.id") != F.col("new.id"))
    return both.select(F.when(F.col("old.extractor").eqNullSafe(F.col("new.extractor")), "ERROR").otherwise("INFO").alias("severity"), "path", F.col("old.id").alias("old_id"), F.col("new.id").alias("new_id"))


def mixed_versions(states: DataFrame) -> DataFrame:
    """Extractors of which several versions gave states: base name, n_versions."""
    base = F.regexp_replace("extractor", r"[-@]?v?\d[\d.]*$", "")
    return states.filter("extractor is not null").groupBy(base.alias("base")).agg(F.countDistinct("extractor").alias("n_versions")).filter("n_versions > 1")


def validated(validators: dict, spark) -> DataFrame:
    """Findings (validator, severity, description) of all validators, each for itself: one that fails gives a finding of its own."""
    kept = []
    for name, run in validators.items():
        try:
            found = run().select(F.lit(name).alias("validator"), "severity", "description")
            found.limit(1).count()
        except Exception as e:  # a validator must not keep the others from running
            found = spark.createDataFrame([(name, "ERROR", f"failed: {type(e).__name__}")], "validator string, severity string, description string")
        kept.append(found)
    return union_all(kept) if kept else spark.createDataFrame([], "validator string, severity string, description string")


def report(findings: DataFrame) -> DataFrame:
    """Findings by validator and severity."""
    return findings.groupBy("validator", "severity").agg(F.count("*").alias("n_findings"))


def kept_history(history: DataFrame, run: str, keep: int = 10) -> DataFrame:
    """The rows of the last ``keep`` runs: the feature of a history with a bound."""
    last = history.select(run).distinct().orderBy(F.desc(run)).limit(keep)
    return history.join(last, run, "left_semi")
