"""Nested template stacks: their topology, and parameters followed to where their values come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import Scratch


def topology(stacks: DataFrame) -> DataFrame:
    """template and role of each template of stacks (parent_template, logical_id, child_template).

    root: a parent that no stack names as its child; child: named by one; unresolved: a stack without a local template.
    """
    parents, children = stacks.select(F.col("parent_template").alias("template")).distinct(), stacks.select(F.col("child_template").alias("template")).filter("template is not null").distinct()
    roots = parents.join(children, "template", "left_anti").select("template", F.lit("root").alias("role"))
    lost = stacks.filter("child_template is null").select(F.concat_ws("#", "parent_template", "logical_id").alias("template"), F.lit("unresolved").alias("role"))
    return roots.unionByName(children.select("template", F.lit("child").alias("role"))).unionByName(lost)


def resolve(bindings: DataFrame, depth: int = 5) -> DataFrame:
    """Value of each binding, followed from reference to reference: key, value, reason, trace.

    bindings: ``key`` (``stack#parameter`` or ``stack#output``, unique), ``kind`` (literal, reference, unsupported),
    ``value``: the literal, or the key referred to. All bindings advance together, one step a round. Reasons for no
    value: RESOURCE_NOT_FOUND, UNSUPPORTED_INTRINSIC, CYCLE_DETECTED, MAX_DEPTH_EXCEEDED.
    """
    scratch = Scratch(bindings.sparkSession, "stacks")
    known = scratch.save(bindings.select("key", "kind", "value").distinct(), "bindings")
    step = known.select(F.col("key").alias("at"), F.col("kind").alias("at_kind"), F.col("value").alias("at_value"), F.lit(True).alias("found"))
    open_ = known.select("key", F.col("key").alias("at"), F.array().cast("array<string>").alias("trace"))
    done = []
    for k in range(depth + 1):
        here = open_.join(step, "at", "left")
        reason = (
            F.when(F.col("found").isNull(), "RESOURCE_NOT_FOUND").when(F.array_contains("trace", F.col("at")), "CYCLE_DETECTED")
            .when(F.col("at_kind") == "unsupported", "UNSUPPORTED_INTRINSIC").when((F.col("at_kind") == "reference") & F.lit(k == depth), "MAX_DEPTH_EXCEEDED")
        )
        here = here.withColumn("reason", reason).withColumn("trace", F.concat("trace", F.array("at")))
        here = scratch.save(here, "step")
        ended = F.col("reason").isNotNull() | (F.col("at_kind") == "literal")
        done.append(here.filter(ended).select("key", F.when(F.col("reason").isNull(), F.col("at_value")).alias("value"), "reason", "trace"))
        open_ = here.filter(~ended).select("key", F.col("at_value").alias("at"), "trace")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def parameter_table(stacks: DataFrame, parameters: DataFrame) -> DataFrame:
    """Every parameter of every nested stack: stack_id, parameter, default. stacks as of ``topology``; parameters: template, parameter, default."""
    ids = stacks.filter("child_template is not null").select(F.concat_ws("#", "parent_template", "logical_id").alias("stack_id"), F.col("child_template").alias("template")).distinct()
    return ids.join(parameters, "template").select("stack_id", "parameter", "default").distinct()


def outputs(stacks: DataFrame, declared: DataFrame) -> DataFrame:
    """Every output of every nested stack, repeated for each stack of a template: stack_id, output, value, unresolved.

    declared: template, output, value, kind (literal, reference, unsupported).
    """
    ids = stacks.filter("child_template is not null").select(F.concat_ws("#", "parent_template", "logical_id").alias("stack_id"), F.col("child_template").alias("template")).distinct()
    return ids.join(declared, "template").select("stack_id", "output", "value", (F.col("kind") == "unsupported").alias("unresolved")).distinct()
