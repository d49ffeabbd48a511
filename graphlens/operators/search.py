"""Search and ranking of graph nodes (key, domain, type, id, name, path, tags)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that are no search terms.
STOP_WORDS = frozenset(
    "the a an is are was were be been being have has had do does did will would could should what which who whom this that these those to from in on at by for with about it its me my i you your we our they their and or but if then else when where why how tell explain describe show list find get".split()
)
#: Further words that do not name an entry point.
ENTRY_STOP_WORDS = STOP_WORDS | frozenset("does read write reads writes permissions triggers trigger".split())


def terms(question: str, stop: frozenset[str] = STOP_WORDS) -> list[str]:
    """Search terms of a question in order of appearance."""
    found = re.sub(r"[^\w\s-]", " ", question.lower(), flags=re.A).split()
    return list(dict.fromkeys(w for w in found if len(w) > 2 and w not in stop))


def entry_terms(question: str) -> list[str]:
    """Terms of a question, and its words joined by hyphens or underscores."""
    joined = [t for t in re.findall(r"[a-z0-9_-]+", question.lower()) if re.fullmatch(r"[a-z0-9]+(?:[-_][a-z0-9]+)+", t)]
    return list(dict.fromkeys([*terms(question, ENTRY_STOP_WORDS), *joined]))


def term_score(term: str, columns: list[str] | tuple[str, ...] = ()) -> Column:
    """Score of a node for one term: the first of the rules that holds. ``columns`` may name description and docstring, if nodes have them."""
    t, low = term.lower(), F.lower
    score = F.when(low("id") == t, 100).when(low("id").contains(t), 80).when(low("name") == t, 75).when(low("name").contains(t), 72)
    score = score.when(low("description").contains(t), 70) if "description" in columns else score
    score = score.when(low("path").contains(t), 60)
    score = score.when(low("docstring").contains(t), 50) if "docstring" in columns else score
    return score.when(low("key").contains(t), 40).when(F.exists("tags", lambda x: low(x).contains(t)), 35).otherwise(0)


def narrowed(nodes: DataFrame, domain: str | None = None, kind: str | None = None, repo: str | None = None) -> DataFrame:
    """Nodes of a domain, a type and a repository, where these are given."""
    for column, value in (("domain", domain), ("type", kind), ("repo", repo)):
        nodes = nodes.filter(F.col(column) == value) if value is not None else nodes
    return nodes


def search_exact(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Top nodes for a term, or for the terms of a question with a bonus for each further term."""
    found = terms(query) if re.search(r"[\s?]", query) else [query]
    if not found:
        return nodes.select("key", F.lit(0).alias("score")).limit(0)
    scores = [term_score(t, nodes.columns) for t in found]
    matched = sum((F.when(s > 0, 1).otherwise(0) for s in scores), F.lit(0))
    total = sum(scores, F.lit(0)) + F.when(matched > 1, (matched - 1) * 20).otherwise(0)
    return nodes.select("key", total.cast("int").alias("score")).filter("score > 0").orderBy(F.desc("score"), "key").limit(limit)


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def search_fuzzy(nodes: DataFrame, query: str, threshold: float = 0.6, limit: int = 50) -> DataFrame:
    """Top nodes by edit distance of id or file name."""
    q = F.lit(query.lower())
    file = F.element_at(F.split(F.lower("path"), "/"), -1)
    best = F.greatest(similarity(F.lower("id"), q), F.coalesce(similarity(file, q), F.lit(0.0)))
    scored = nodes.select("key", F.round(best, 6).alias("similarity")).filter(F.col("similarity") >= threshold)
    return scored.select("key", F.floor(F.col("similarity") * 39).cast("int").alias("score"), "similarity").orderBy(F.desc("score"), F.desc("similarity"), "key").limit(limit)


def search_page(nodes: DataFrame, query: str, limit: int = 50, domain: str | None = None, kind: str | None = None, repo: str | None = None, fuzzy: bool = True, threshold: float = 0.6) -> tuple[DataFrame, bool]:
    """The best nodes (key, score) and whether there are more: exact search; fuzzy where that finds nothing."""
    nodes = narrowed(nodes, domain, kind, repo)
    exact = search_exact(nodes, query, limit + 1)
    n = exact.count()
    if not n and fuzzy:
        exact = search_fuzzy(nodes, query, threshold, limit + 1).drop("similarity")
        n = exact.count()
    return exact.orderBy(F.desc("score"), "key").limit(limit), n > limit


def search(nodes: DataFrame, query: str, limit: int = 50, **options) -> DataFrame:
    """The best nodes alone, as of ``search_page``."""
    return search_page(nodes, query, limit, **options)[0]


def entry_points(nodes: DataFrame, question: str, limit: int = 10, each: int = 20) -> DataFrame:
    """Nodes that the most terms of a question find among their best ``each``.

    All terms are scored in one pass; the best of each come from a bounded sort by term.
    """
    found = entry_terms(question)
    hits = nodes.select("key", F.explode(F.array(*[F.struct(F.lit(t).alias("term"), term_score(t).alias("score")) for t in found])).alias("h")).select("key", "h.term", "h.score").filter("score > 0")
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "key"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= each).groupBy("key").agg((F.count("*") * 10).cast("int").alias("score")).orderBy(F.desc("score"), "key").limit(limit)


def similar(nodes: DataFrame, target: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes of the target's type that share its domain or a tag, most shared tags first.

    target: one node. It is the only row of the other side, so it is broadcast.
    """
    t = F.broadcast(target.limit(1).select(F.col("key").alias("t_key"), F.col("type").alias("type"), F.col("domain").alias("t_domain"), F.col("tags").alias("t_tags")))
    shared = F.size(F.array_intersect("tags", "t_tags"))
    found = nodes.join(t, "type").filter(F.col("key") != F.col("t_key")).withColumn("shared_tags", shared).filter((F.col("shared_tags") > 0) | (F.col("domain") == F.col("t_domain")))
    return found.select("key", "shared_tags").orderBy(F.desc("shared_tags"), "key").limit(limit)


def task_candidates(nodes: DataFrame, task: str, limit: int = 5) -> DataFrame:
    """Nodes for a task: share of the task's words in their ids and paths, with bonuses for path and domain."""
    words = list(dict.fromkeys(re.findall(r"[a-z0-9]+", task.lower())))
    own = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "id", "path")), "[^a-z0-9]+", " ")), " "))
    hits = F.size(F.array_intersect(own, F.array(*map(F.lit, words))))
    path = F.size(F.array_intersect(F.split(F.lower("path"), "[^a-z0-9]+"), F.array(*map(F.lit, words))))
    score = hits / len(words) + F.least(F.lit(0.4), 0.1 * F.coalesce(path, F.lit(0))) + F.when(F.lower("domain").isin(words), 0.2).otherwise(0.0)
    return nodes.select("key", F.round(score, 4).alias("score")).filter("score >= 0.05").orderBy(F.desc("score"), "key").limit(limit)


def scored_tasks(nodes: DataFrame, task: str, method: str | None = None, domain: str | None = None, limit: int = 5) -> DataFrame:
    """The best nodes for a task with the reasons: share of the task's words, a method, words of its paths, a domain: key, score, rationale."""
    words = list(dict.fromkeys(re.findall(r"[a-z0-9]+", task.lower())))
    hints = list(dict.fromkeys(w for part in re.findall(r"[\w.-]*/[\w./-]*", task.lower()) for w in re.findall(r"[a-z0-9]+", part)))
    own = F.array_distinct(F.split(F.trim(F.regexp_replace(F.lower(F.concat_ws(" ", "id", "path", "name", F.array_join("tags", " "))), "[^a-z0-9]+", " ")), " "))
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    hits, paths = F.size(F.array_intersect("own", lit(words))), F.size(F.array_intersect("own", lit(hints)))
    has_method = F.array_contains("own", method.lower()) if method else F.lit(False)
    has_domain = F.coalesce(F.col("domain") == domain, F.lit(False)) if domain else F.lit(False)
    score = hits / max(len(words), 1) + F.when(has_method, 0.4).otherwise(0.0) + F.least(F.lit(0.4), 0.1 * paths) + F.when(has_domain, 0.2).otherwise(0.0)
    why = F.array_compact(F.array(F.when(hits > 0, F.concat(hits.cast("string"), F.lit(" words"))), F.when(has_method, F.lit(f"method {method}")), F.when(paths > 0, F.lit("path")), F.when(has_domain, F.lit(f"domain {domain}"))))
    out = nodes.withColumn("own", own).select("key", F.round(score, 4).alias("score"), F.coalesce(F.nullif(F.array_join(why, "; "), F.lit("")), F.lit("nothing in particular")).alias("rationale"))
    return out.filter("score >= 0.05").orderBy(F.desc("score"), "key").limit(limit)
