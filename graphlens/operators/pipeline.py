"""From decision records to a published architecture: entities, invariants, relationships, gaps, registries, manifest, evidence."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators import architecture, incremental
from graphlens.session import exists, listing, read_text

#: Kinds of facts that become entities, the prefix of a system that a physical record stands for, kinds of records by their ids.
ENTITY_KINDS = ("adr", "decision", "capability", "component", "system", "rule", "rejection")
SYSTEM_PREFIX = "SYS-"
SUBJECT_KINDS = {"L": "adr_l", "PS": "adr_ps", "PC": "adr_pc"}


def logical_entities(facts: DataFrame) -> DataFrame:
    """id, entity_type, record_id, source_ref of the records and their entries, invariants left out: those are mentions.

    facts: file_id, kind, name, detail, owner of records (``documents.document_facts(.., "decision_record")``).
    """
    rows = facts.filter(F.col("kind").isin(*ENTITY_KINDS))
    record = F.when(F.col("kind") == "adr", F.col("name")).otherwise(F.col("owner"))
    ref = F.when(F.col("kind") == "adr", F.col("name")).otherwise(F.concat_ws("#", "owner", "name"))
    return rows.select(F.col("name").alias("id"), F.col("kind").alias("entity_type"), record.alias("record_id"), ref.alias("source_ref")).distinct()


def physical_entities(facts: DataFrame) -> DataFrame:
    """The system that each physical system record stands for, by the record's own number."""
    rows = facts.filter("kind = 'adr' and owner = 'physical-system'")
    return rows.select(F.concat(F.lit(SYSTEM_PREFIX), F.regexp_replace("name", "^ADR-PS-", "")).alias("id"), F.lit("system").alias("entity_type"), F.col("name").alias("record_id"), F.concat_ws("#", "name", F.lit("system")).alias("source_ref")).distinct()


def invariant_mentions(facts: DataFrame, standalone: DataFrame | None = None) -> DataFrame:
    """Mentions of invariants: id, source, standalone. standalone: id, source of documents of their own."""
    local = facts.filter("kind = 'invariant'").select(F.col("name").alias("id"), F.concat_ws("#", "owner", "name").alias("source"), F.lit(False).alias("standalone"))
    return local.distinct() if standalone is None else local.unionByName(standalone.select("id", "source", F.lit(True).alias("standalone"))).distinct()


def merged(entities: DataFrame, may_repeat: tuple[str, ...] = ("capability", "component", "system")) -> DataFrame:
    """One row for each id, with the sorted references of all its mentions; types that may not repeat raise on the first id that does."""
    grouped = entities.groupBy("id").agg(F.min(F.struct("entity_type", "record_id", "source_ref")).alias("first"), F.countDistinct("entity_type").alias("n_types"), F.array_sort(F.collect_set("source_ref")).alias("refs"))
    twice = grouped.filter((F.col("n_types") > 1) | (~F.col("first.entity_type").isin(*may_repeat) & (F.size("refs") > 1))).orderBy("id").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].id} is declared by {', '.join(twice[0].refs)}")
    return grouped.select("id", "first.entity_type", "first.record_id", "first.source_ref", F.array_except("refs", F.array("first.source_ref")).alias("further_refs"))


def declared_links(facts: DataFrame) -> DataFrame:
    """rel_type, src, dst: links of records and entries, and what each record declares."""
    links = facts.filter("kind = 'link'").select(F.col("detail").alias("rel_type"), F.col("owner").alias("src"), F.col("name").alias("dst"))
    inside = facts.filter(F.col("kind").isin(*ENTITY_KINDS, "invariant") & (F.col("kind") != "adr")).select(F.lit("declares").alias("rel_type"), F.col("owner").alias("src"), F.col("name").alias("dst"))
    return links.unionByName(inside).dropna().distinct()


def build(facts: DataFrame, standalone: DataFrame | None = None, may_repeat: tuple[str, ...] = ("capability", "component", "system")) -> dict[str, DataFrame]:
    """entities, relationships and gaps of a set of records; a double declaration of a type that may not repeat is an error."""
    invariants = architecture.canonical_invariants(invariant_mentions(facts, standalone))
    records = F.regexp_extract("source", "^([^#]*)", 1)
    own = merged(logical_entities(facts).unionByName(physical_entities(facts)), may_repeat)
    none = F.array().cast("array<string>")
    entities = own.unionByName(invariants.select("id", F.lit("invariant").alias("entity_type"), records.alias("record_id"), F.col("source").alias("source_ref"), none.alias("further_refs")))
    declared = declared_links(facts)
    return {"entities": entities, "relationships": architecture.derive(entities, declared), "gaps": architecture.gaps(entities, declared)}


def compile_bundle(spark: SparkSession, root: str, facts: DataFrame, name: str, standalone: DataFrame | None = None, dry: bool = False) -> tuple[str, list[str]]:
    """(status, errors) of a bundle: valid, degraded with gaps, or invalid; published under ``root`` by one rename unless ``dry`` or invalid. Errors are given back, not raised."""
    try:
        parts = build(facts, standalone)
        errors = [f"{r.code} {r.id}" for r in architecture.registry_errors(parts["entities"], parts["relationships"], parts["gaps"]).orderBy("code", "id").limit(100).collect()]
    except ValueError as e:
        return "invalid", [str(e)]
    if errors:
        return "invalid", errors
    n_gaps = parts["gaps"].count()
    status = "degraded" if n_gaps else "valid"
    if not dry:
        counts = {r.entity_type: r["count"] for r in parts["entities"].groupBy("entity_type").count().collect()}  # one row for each type
        manifest = parts["entities"].filter("entity_type = 'adr'").select("id", "source_ref")
        incremental.publish(spark, root, name, {**parts, "manifest": manifest}, {"status": status, "n_gaps": n_gaps, "entities": counts})
    return status, []


def open_bundle(spark: SparkSession, root: str, name: str | None = None) -> tuple[dict, dict[str, DataFrame]]:
    """(note, parts) of a published bundle, the last one by name if none is given; a missing part makes its status invalid."""
    names = [n for n in listing(spark, root) if not n.startswith(".")]
    if not names or (name is not None and name not in names):
        return {"status": "missing"}, {}
    at = f"{root}/{name or names[-1]}"
    note = json.loads(read_text(spark, f"{at}/note.json"))
    parts = {p: spark.read.parquet(f"{at}/{p}") for p in ("entities", "relationships", "gaps", "manifest") if exists(spark, f"{at}/{p}")}
    return (note if len(parts) == 4 else {**note, "status": "invalid"}), parts


def subjects(manifest: DataFrame, status: str) -> DataFrame:
    """kind, id, effect of the records of a manifest: a bundle validates them, an invalid one invalidates them. Ids of other forms are left out."""
    form = F.regexp_extract("id", r"^ADR-(L|PS|PC)-\d+", 1)
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in SUBJECT_KINDS.items() for x in pair]), form)
    return manifest.select(kind.alias("kind"), "id", F.lit("invalidates" if status == "invalid" else "validates").alias("effect")).filter("kind is not null").distinct()


def evidence(note: dict, parts: dict[str, DataFrame], stale: DataFrame) -> dict:
    """Status, freshness and number of subjects of a bundle; stale: the source files that changed since. Small: for a report."""
    n_stale = stale.limit(1).count()
    found = subjects(parts["manifest"], note["status"]).groupBy("kind").count().collect() if "manifest" in parts else []
    return {"version": "2", "bundle": note["status"], "freshness": "stale" if n_stale else "fresh", "subjects": {r.kind: r["count"] for r in found}}


def unchanged(hashes: DataFrame, sentinels: DataFrame) -> DataFrame:
    """Repositories (repo) whose hash is the one that was noted last: their extraction may be skipped. Null hashes are never the same."""
    return hashes.join(sentinels.select("repo", F.col("hash").alias("noted")), "repo").filter("hash = noted").select("repo").distinct()


def record_view(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """For each record its sorted entities and the sorted records that it refers to: adr_id, introduced, related."""
    records = entities.filter("entity_type = 'adr'").select(F.col("id").alias("adr_id"))
    own = entities.filter("entity_type <> 'adr'").groupBy(F.col("record_id").alias("adr_id")).agg(F.array_sort(F.collect_set("id")).alias("introduced"))
    refs = relationships.filter("rel_type = 'references'").groupBy(F.col("src").alias("adr_id")).agg(F.array_sort(F.collect_set("dst")).alias("related"))
    none = F.array().cast("array<string>")
    return records.join(own, "adr_id", "left").join(refs, "adr_id", "left").select("adr_id", F.coalesce("introduced", none).alias("introduced"), F.coalesce("related", none).alias("related"))


#: Families of projections: the query that each shows, and its levels.
FAMILIES = {"architecture-overview": ("integration", (0, 2)), "integration-topology": ("integration", (1, 2, 3)), "dependency-projection": ("dependencies", (0, 1)), "governance-projection": ("governance", (0, 1)), "runtime-projection": ("integration", (1, 2))}


def projections(charts: dict[str, DataFrame]) -> DataFrame:
    """file_name, text of every family and level. charts: for each ``query-level`` one row with ``chart``; those missing or empty give no file."""
    rows = []
    for family, (query, levels) in FAMILIES.items():
        for level in levels:
            if (chart := charts.get(f"{query}-L{level}")) is not None:
                head = f"# {family.replace('-', ' ').title()} (L{level})\n\n```mermaid\n"
                rows.append(chart.filter("chart is not null").select(F.lit(f"{family}-L{level}.md").alias("file_name"), F.concat(F.lit(head), F.col("chart"), F.lit("\n```\n")).alias("text")))
    return reduce(DataFrame.unionByName, rows) if rows else None


def indexes(slices: DataFrame) -> DataFrame:
    """domain, position and key: the sorted index of each domain. Positions come from sorted ranges, so no domain is gathered in one task.

    slices: key, domain.
    """
    from pyspark.sql import Window

    placed = slices.select("domain", "key").distinct().repartitionByRange("domain", "key").sortWithinPartitions("domain", "key").withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part", "domain").orderBy("key")
    counted = placed.groupBy("_part", "domain").count()
    before = counted.withColumn("_before", F.sum("count").over(Window.partitionBy("domain").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("count")
    return placed.withColumn("_n", F.row_number().over(own)).join(F.broadcast(before), ["_part", "domain"]).select("domain", (F.coalesce("_before", F.lit(0)) + F.col("_n")).cast("long").alias("position"), "key")


def throughput(phases: DataFrame) -> DataFrame:
    """phase, n_runs, seconds (mean) and rows_per_second of timed phases (run, phase, seconds, n_rows)."""
    return phases.groupBy("phase").agg(F.countDistinct("run").alias("n_runs"), F.round(F.avg("seconds"), 6).alias("seconds"), F.round(F.sum("n_rows") / F.nullif(F.sum("seconds"), F.lit(0.0)), 6).alias("rows_per_second"))
