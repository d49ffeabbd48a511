"""Questions in words: an intent by ordered rules, then the operator that answers it."""

from __future__ import annotations

import re
from collections import OrderedDict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import context, search, traverse

#: How questions of each intent begin; the first rule that matches decides.
INTENTS = (
    ("describe", r"tell me about|what is|describe|what does .+ do|show me"),
    ("explain", r"how does .+ work|explain|walk me through|help me understand"),
    ("list", r"list|show|what are the|get all|find all"),
    ("impact", r"what would be affected|impact of|blast radius|what changes if|ripple effect"),
    ("dependencies", r"what does .+ depend on|dependencies of|what .+ needs|requires"),
    ("dependents", r"what depends on|dependents of|what uses|who calls|consumers of"),
    ("relationship", r"how are .+ and .+ related|relationship between|connection between|link between"),
    ("locate", r"where is|find|locate|search for"),
)


def intent(question: str) -> str:
    q = question.lower().strip()
    return next((name for name, rule in INTENTS if re.match(rule, q)), "unknown")


class Graph:
    """Nodes and edges with the questions that can be asked about them.

    nodes: key, domain, type, id, repo, path, name, tags; edges: src, dst. Answers are DataFrames; those
    to the last questions are kept as plans, by normalized text.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, remember: int = 100):
        self.nodes, self.edges, self.remember = nodes, edges, remember
        self._known: OrderedDict[str, tuple[str, DataFrame]] = OrderedDict()

    def seeds(self, question: str, n: int = 1) -> DataFrame:
        return search.entry_points(self.nodes, question, n).select("key")

    def ask(self, question: str) -> tuple[str, DataFrame]:
        """(intent, answer)."""
        text = " ".join(question.lower().split())
        if text in self._known:
            self._known.move_to_end(text)
            return self._known[text]
        kind = intent(question)
        answer = getattr(self, f"_{kind}", self._locate)(question)
        self._known[text] = (kind, answer)
        if len(self._known) > self.remember:
            self._known.popitem(last=False)
        return kind, answer

    def _describe(self, q: str) -> DataFrame:
        return self.nodes.join(F.broadcast(self.seeds(q)), "key", "left_semi")

    _explain = _describe

    def _list(self, q: str) -> DataFrame:
        return search.search(self.nodes, q)

    def _impact(self, q: str) -> DataFrame:
        return context.impact(self.nodes, self.edges, self.seeds(q))

    def _dependencies(self, q: str) -> DataFrame:
        return traverse.reached(self.edges, self.seeds(q), 2)

    def _dependents(self, q: str) -> DataFrame:
        return traverse.reached(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.seeds(q), 2)

    def _relationship(self, q: str) -> DataFrame:
        """Nodes that the surroundings of the two best entry points share."""
        ball = traverse.bfs(traverse.both_ways(self.edges), self.seeds(q, 2), 2).select("seed", "node").distinct()
        return ball.groupBy("node").agg(F.count("*").alias("n_seeds")).filter("n_seeds = 2")

    def _locate(self, q: str) -> DataFrame:
        return search.search(self.nodes, q).join(self.nodes.select("key", "path"), "key")
