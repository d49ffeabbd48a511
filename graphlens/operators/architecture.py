"""The graph of architecture records: entities (id, entity_type), relationships (rel_type, src, dst, origin)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.operators import compact, traverse
from graphlens.session import Scratch

#: Each relationship and the one that holds the other way.
INVERSE = {"declared_in": "declares", "references": "referenced_by", "implemented_by": "implements", "enforces": "enforced_by", "enables": "enabled_by", "governs": "governed_by", "embodied_in": "embodies", "supersedes": "superseded_by", "refines": "refined_by", "rejects": "rejected_by", "related_to": "related_to", "contradicts": "contradicts"}
#: Relationships along which a change has consequences that must or may be followed.
HARD = ("enforces", "enforced_by", "governs", "governed_by", "implements", "implemented_by", "supersedes", "superseded_by", "contradicts")
SOFT = ("related_to", "references", "referenced_by", "refines", "refined_by", "enables", "enabled_by")


def _inverse(c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in INVERSE.items() for x in pair]), c)


def derive(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared links between known entities, and what they imply the other way.

    declared: rel_type, src, dst. A relationship that is both declared and derived counts as explicit.
    """
    known = declared.join(entities.select(F.col("id").alias("src")), "src", "left_semi").join(entities.select(F.col("id").alias("dst")), "dst", "left_semi")
    ahead = known.select("rel_type", "src", "dst", F.lit("explicit").alias("origin"))
    back = known.select(_inverse(F.col("rel_type")).alias("rel_type"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("derived").alias("origin")).filter("rel_type is not null")
    return ahead.unionByName(back).groupBy("rel_type", "src", "dst").agg(F.max("origin").alias("origin"))


def gaps(entities: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared links of known entities to entities that are not there."""
    lost = declared.join(entities.select(F.col("id").alias("dst")), "dst", "left_anti").join(entities.select(F.col("id").alias("src")), "src", "left_semi")
    return lost.select("rel_type", F.col("src").alias("source_id"), F.col("dst").alias("missing_id")).distinct()


def subgraph(entities: DataFrame, relationships: DataFrame, entity_types: list[str], rel_types: list[str]) -> DataFrame:
    """Relationships of the given types between entities of the given types."""
    kept = entities.filter(F.col("entity_type").isin(entity_types))
    rels = relationships.filter(F.col("rel_type").isin(rel_types))
    return rels.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi").select("rel_type", "src", "dst")


def consequences(relationships: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """What a change of each seed entails: seed, node, depth, tier (hard or soft), via.

    The first step may take any relationship, later ones only those with consequences. Of several
    relationships by which a node is reached first, a hard one counts, then the first by name.
    """
    scratch = Scratch(relationships.sparkSession, "consequences")
    rels = scratch.save(relationships.select("src", "dst", "rel_type").distinct(), "rels")
    later = rels.filter(F.col("rel_type").isin(*HARD, *SOFT))
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct()
    if (reached := compact.consequences(rels, start, depth, HARD, SOFT)) is not None:
        return reached
    frontier = start.withColumn("node", F.col("seed"))
    seen, found = frontier, []
    rank = F.min(F.struct((~F.col("rel_type").isin(*HARD)).alias("soft"), F.col("rel_type").alias("via"))).alias("best")
    for k in range(1, depth + 1):
        step = frontier.join(rels if k == 1 else later, frontier["node"] == F.col("src")).select("seed", F.col("dst").alias("node"), "rel_type")
        step = step.join(seen, ["seed", "node"], "left_anti").groupBy("seed", "node").agg(rank)
        step = scratch.save(step.select("seed", "node", F.lit(k).alias("depth"), F.when(F.col("best.soft"), "soft").otherwise("hard").alias("tier"), "best.via"), "step")
        frontier = step.select("seed", "node")
        seen = seen.unionByName(frontier)
        found.append(step)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def reach(relationships: DataFrame, seeds: DataFrame, depth: int = 3, way: str = "forward") -> DataFrame:
    """Entities reached forward, backward or both ways."""
    e = relationships.select("src", "dst")
    r = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traverse.reached({"forward": e, "reverse": r, "both": e.unionByName(r)}[way], seeds, depth)


def governance(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """For each decision what it governs, enables and enforces; decisions without any are left out."""
    own = relationships.join(entities.filter("entity_type = 'decision'").select(F.col("id").alias("src")), "src", "left_semi")
    per = own.groupBy(F.col("src").alias("decision_id")).agg(*[F.count_if(F.col("rel_type") == t).alias(f"n_{t}") for t in ("governs", "enables", "enforces")])
    return per.filter("n_governs + n_enables + n_enforces > 0")


def coverage(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """Whether each invariant is enforced by a decision and by a rule; only both make it covered."""
    by = entities.select(F.col("id").alias("dst"), F.col("entity_type").alias("by_type"))
    enforced = relationships.filter("rel_type = 'enforced_by'").join(by, "dst").groupBy(F.col("src").alias("id")).agg(F.count_if(F.col("by_type") == "decision").alias("n_decisions"), F.count_if(F.col("by_type") == "rule").alias("n_rules"))
    out = entities.filter("entity_type = 'invariant'").select("id").join(enforced, "id", "left").fillna(0)
    return out.withColumn("covered", (F.col("n_decisions") > 0) & (F.col("n_rules") > 0))


def registry_errors(entities: DataFrame, relationships: DataFrame, gap_rows: DataFrame) -> DataFrame:
    """Registry violations: code and id. Repeated gaps E401, relationships to unknown entities E402, gaps from unknown entities E405."""
    ids = entities.select("id")
    repeated = gap_rows.groupBy(F.concat_ws("-", "source_id", "rel_type", "missing_id").alias("id")).count().filter("count > 1").select(F.lit("E401").alias("code"), "id")
    ends = relationships.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    unknown = ends.join(ids, "id", "left_anti").select(F.lit("E402").alias("code"), "id")
    loose = gap_rows.select(F.col("source_id").alias("id")).distinct().join(ids, "id", "left_anti").select(F.lit("E405").alias("code"), "id")
    return repeated.unionByName(unknown).unionByName(loose)


def attribution(evidence: DataFrame, declared_in: DataFrame) -> DataFrame:
    """Implementing slices of each entity: by themselves or through the record that declares it.

    evidence: slice_id, entity_id; declared_in: entity_id, record_id.
    """
    through = declared_in.join(evidence.select(F.col("entity_id").alias("record_id"), "slice_id"), "record_id").select("entity_id", "slice_id", F.lit("record").alias("how"))
    direct = evidence.select("entity_id", "slice_id", F.lit("direct").alias("how"))
    return direct.unionByName(through).groupBy("entity_id").agg(F.countDistinct("slice_id").alias("n_slices"), F.count_if(F.col("how") == "direct").alias("n_direct"))


#: What each kind of consequence of a decision weighs.
GRAVITY = {"dependents": 2, "enforces": 3, "governs": 2, "enables": 1, "consequences": 1}


def decision_gravity(entities: DataFrame, relationships: DataFrame, consequences: DataFrame | None = None) -> DataFrame:
    """decision_id, one count for each kind of consequence, and gravity, their weighted sum, of each decision.

    Dependents are entities that reach the decision within two steps. consequences: decision_id, n; without it they are 0.
    """
    decisions = entities.filter("entity_type = 'decision'").select(F.col("id").alias("decision_id")).distinct()
    e = relationships.select("src", "dst").distinct()
    far = traverse.reached(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), decisions, 2).groupBy(F.col("seed").alias("decision_id")).agg(F.count("*").alias("dependents"))
    own = relationships.groupBy(F.col("src").alias("decision_id")).agg(*[F.countDistinct(F.when(F.col("rel_type") == v, F.col("dst"))).alias(v) for v in ("enforces", "governs", "enables")])
    out = decisions.join(far, "decision_id", "left").join(own, "decision_id", "left")
    out = out.withColumn("consequences", F.lit(0)) if consequences is None else out.join(consequences.withColumnRenamed("n", "consequences"), "decision_id", "left")
    out = out.fillna(0)
    return out.withColumn("gravity", sum((F.col(k) * w for k, w in GRAVITY.items()), F.lit(0)).cast("long"))


def gravity_summary(scored: DataFrame) -> DataFrame:
    """Greatest and mean gravity; 0 without decisions."""
    return scored.agg(F.count("*").alias("n_decisions"), F.coalesce(F.max("gravity"), F.lit(0)).alias("max_gravity"), F.round(F.coalesce(F.avg("gravity"), F.lit(0.0)), 6).alias("mean_gravity"))


def boundaries(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """adr_id and the sorted entities that each record declares; of one record each."""
    records = entities.filter("entity_type = 'adr'").select(F.col("id").alias("adr_id")).distinct()
    declared = relationships.filter("rel_type = 'declares'").groupBy(F.col("src").alias("adr_id")).agg(F.array_sort(F.collect_set("dst")).alias("declared"))
    return records.join(declared, "adr_id", "left").withColumn("declared", F.coalesce("declared", F.array().cast("array<string>")))


def chains(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """decision_id, relationship, target, target_type: what each decision governs, enables or enforces; unknown targets are left out."""
    kind = entities.select("id", "entity_type").distinct()
    at = relationships.filter(F.col("rel_type").isin("governs", "enables", "enforces")).join(kind.filter("entity_type = 'decision'").select(F.col("id").alias("src")), "src", "left_semi")
    return at.join(kind.select(F.col("id").alias("dst"), F.col("entity_type").alias("target_type")), "dst").select(F.col("src").alias("decision_id"), F.col("rel_type").alias("relationship"), F.col("dst").alias("target"), "target_type").distinct()


def invariant_coverage(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """invariant_id and whether decisions and rules enforce it: enforced by both, partially_enforced by one, unenforced."""
    kind = entities.select(F.col("id").alias("src"), F.col("entity_type").alias("by")).distinct()
    at = relationships.filter("rel_type = 'enforces'").join(kind, "src").groupBy(F.col("dst").alias("invariant_id")).agg(F.bool_or(F.col("by") == "decision").alias("d"), F.bool_or(F.col("by") == "rule").alias("r"))
    all_ = entities.filter("entity_type = 'invariant'").select(F.col("id").alias("invariant_id")).distinct().join(at, "invariant_id", "left").fillna(False, ["d", "r"])
    return all_.select("invariant_id", F.when(F.col("d") & F.col("r"), "enforced").when(F.col("d") | F.col("r"), "partially_enforced").otherwise("unenforced").alias("coverage"))


def embodiment_density(entities: DataFrame) -> DataFrame:
    """Coverage of each type of entity by code: entities (id, entity_type, embodiments, attributed, enforcing: counts).

    covered: embodied and attributed; unlinked: nothing at all; else partial. Only types that code can embody count.
    """
    n = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("embodiments", "attributed", "enforcing")}
    state = F.when((n["embodiments"] == 0) & (n["attributed"] == 0) & (n["enforcing"] == 0), "unlinked").when((n["embodiments"] > 0) & (n["attributed"] > 0), "covered").otherwise("partial")
    at = entities.filter(F.col("entity_type").isin("adr", "capability", "system", "component", "invariant")).withColumn("state", state)
    return at.groupBy("entity_type").agg(F.count("*").alias("n_entities"), F.count_if(F.col("state") == "covered").alias("n_covered"), F.count_if(F.col("state") == "unlinked").alias("n_unlinked"), F.round(F.avg((F.col("state") == "covered").cast("double")), 6).alias("coverage"))


def canonical_invariants(mentions: DataFrame) -> DataFrame:
    """One row for each invariant of mentions (id, source, standalone): a document of its own beats mentions in others.

    Two documents for one invariant are an error, raised with one of the ids.
    """
    twice = mentions.filter("standalone").groupBy("id").agg(F.countDistinct("source").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"invariant {twice[0].id} has {twice[0].n} documents of its own")
    best = mentions.groupBy("id").agg(F.min(F.struct((~F.col("standalone")).alias("local"), "source")).alias("best"), F.countDistinct("source").alias("n_mentions"))
    return best.select("id", "best.source", (~F.col("best.local")).alias("standalone"), "n_mentions")
