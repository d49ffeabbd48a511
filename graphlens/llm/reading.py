"""Reading level of documents: harmonic propagation of difficulty on the document–word graph."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.leaks import words
from graphlens.session import Scratch, shuffle_partitions, spread

_FENCE = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_NO_PROSE = re.compile(r"^(?:#|\||>|[A-Z][\w ]{0,20}:\s*[\w.-]+$|[-=*_]{3,}$)")
_BULLET = re.compile(r"^(?:[-*+]|\d+[.)])\s+")
_REFERENCE = re.compile(r"`[^`\n]*`|https?://\S+|\S+[/_.]\w\S*")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n\s*\n")

#: Largest vocabulary whose vectors are broadcast; 8 bytes each and vector. A larger one is joined.
BROADCAST_ROWS = 200_000
#: Rounds after which the iteration counts as failed: far more than the solver needs.
SAFETY_ROUNDS = 2_000
#: Shares into which a feature of very many documents is split where vectors are joined.
SALTS = 32
#: Width of the bins in which calibration counts labelled documents.
BINS = 512


def main_text(text: str) -> str:
    """The prose of a text: without code, headings, fields, quotes, list marks and references."""
    out = []
    for line in _FENCE.sub("\n\n", unicodedata.normalize("NFKC", text)).splitlines():
        line = line.strip()
        if not line or _NO_PROSE.match(line):
            out.append("\n")
        elif m := _BULLET.match(line):
            out.append("\n" + line[m.end() :])
        else:
            out.append(line)
    return _REFERENCE.sub(" ", "\n".join(out))


def features(text: str) -> Counter:
    """Words of the main text, and the lengths of its sentences in steps of two words."""
    found: Counter = Counter()
    for sentence in _SENTENCE.split(main_text(text)):
        if w := words(sentence):
            found.update(w)
            found[f"#{min(40, len(w) // 2 * 2)}"] += 1
    return found


def _edges(least: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            docs, feats, counts = [], [], []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                if len(words(text)) >= least:
                    found = features(text)
                    docs.append(doc)
                    feats.append([xxhash.xxh64_intdigest(f) - (1 << 63) for f in found])
                    counts.append([float(n) for n in found.values()])
            yield pd.DataFrame({"doc_id": docs, "feats": feats, "counts": counts})

    return rows


def _cuts(counted: list, tops: list[float]) -> list[float]:
    """For each bound between levels the cut of estimates that puts the fewest labels on the wrong side.

    counted: (bin, labels, labels above each bound ...) in order of bins. Of equally good cuts the middle one.
    """
    out = []
    for k, _ in enumerate(tops):
        below_wrong, above_right = 0, sum(r[1] - r[2 + k] for r in counted)
        errors, edges = [above_right], [counted[0][0] - 1]
        for r in counted:
            below_wrong += r[2 + k]
            above_right -= r[1] - r[2 + k]
            errors.append(below_wrong + above_right)
            edges.append(r[0])
        best = [i for i, e in enumerate(errors) if e == min(errors)]
        i = best[len(best) // 2]
        here, after = edges[i] + 1, counted[i][0] if i < len(counted) else edges[i] + 2
        out.append((max(here, 0) + after) / 2 / BINS if 0 < i < len(counted) else (float("-inf") if i == 0 else float("inf")))
    return out


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and for each value the row it belongs to."""
    offsets = lists.offsets.to_numpy()
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), np.diff(offsets))


class _Broadcast:
    """The document–feature graph seen from its features, for vocabularies that fit everywhere.

    A vector over the features is an array in the driver (at most ``BROADCAST_ROWS`` numbers). One pass
    over the arrays of the documents applies the graph; only sums by feature are shuffled, aggregated before.
    """

    def __init__(self, graph: DataFrame, state: DataFrame):
        rows = state.orderBy("feat").toPandas()
        self.graph, self.feats, self.q, self.start = graph, rows["feat"].to_numpy(np.int64), rows["q"].to_numpy(float), rows["g"].to_numpy(float)

    def _sums(self, vector: np.ndarray | None, weighted: bool, graded: bool) -> tuple[np.ndarray, np.ndarray]:
        """For each feature the sums of weight times value and of weight over its documents.

        The value of a document is its grade, if ``graded`` asks for these, else the mean of ``vector`` over its features.
        Weights carry the feature's own weight if ``weighted``.
        """
        sent = self.graph.sparkSession.sparkContext.broadcast((self.feats, self.q, vector))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feats, q, v = sent.value
            total, weight = np.zeros(len(feats)), np.zeros(len(feats))
            for b in batches:
                at, docs, a = _placed(b, feats)
                grade = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
                w = a * q[at]
                if v is None:
                    x = grade
                else:
                    known = np.bincount(docs, w, len(grade))
                    x = np.divide(np.bincount(docs, w * v[at], len(grade)), known, out=np.zeros(len(grade)), where=known > 0)
                    x = np.where(np.isnan(grade), x, grade if graded else np.nan)
                taken = ~np.isnan(x[docs])
                use = (w if weighted else a)[taken]
                total += np.bincount(at[taken], use * x[docs][taken], len(feats))
                weight += np.bincount(at[taken], use, len(feats))
            some = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some]), pa.array(weight[some])], names=["i", "total", "weight"])

        out = self.graph.select("grade", "feats", "counts").mapInArrow(rows, "i int, total double, weight double")
        found = out.groupBy("i").agg(F.sum("total").alias("total"), F.sum("weight").alias("weight")).toPandas()
        sent.unpersist()
        total, weight = np.zeros(len(self.feats)), np.zeros(len(self.feats))
        total[found["i"]], weight[found["i"]] = found["total"], found["weight"]
        return total, weight

    def solve(self, tolerance: float) -> float:
        """Conjugate gradients on the clamped Laplacian of the features; gives the last change of a harmonic round."""
        fixed, of_graded = self._sums(None, True, True)
        _, of_others = self._sums(self.start, True, False)
        d = of_graded + of_others
        d[d == 0] = 1.0
        g = self.start
        r = fixed - d * g + self._sums(g, True, False)[0]
        z = r / d
        p, rz = z, float(r @ z)
        for self.rounds in range(SAFETY_ROUNDS):
            if (far := float(np.abs(z).max(initial=0.0))) < tolerance:
                self.solution = g + z
                return far
            ap = d * p - self._sums(p, True, False)[0]
            step = rz / float(p @ ap)
            g, r = g + step * p, r - step * ap
            z = r / d
            rz, before = float(r @ z), rz
            p = z + rz / before * p
        raise RuntimeError(f"levels still move by {far} after {SAFETY_ROUNDS} rounds")

    def judged(self) -> DataFrame:
        """doc_id, grade and x: the mean of a document's features without its own share in them."""
        total, weight = self._sums(self.solution, False, True)
        sent = self.graph.sparkSession.sparkContext.broadcast((self.feats, self.q, self.solution, total, weight))

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            feats, q, v, total, weight = sent.value
            for b in batches:
                at, docs, a = _placed(b, feats)
                grade = b.column("grade").to_numpy(zero_copy_only=False).astype(float)
                own = np.where(np.isnan(grade[docs]), v[at], grade[docs])
                left = weight[at] - a
                others = left > 0.5
                w, docs = (a * q[at])[others], docs[others]
                value = ((total[at] - a * own)[others]) / left[others]
                known = np.bincount(docs, w, len(grade))
                x = np.divide(np.bincount(docs, w * value, len(grade)), known, out=np.full(len(grade), np.nan), where=known > 0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(x, from_pandas=True)], names=["doc_id", "grade", "x"])

        return self.graph.mapInArrow(rows, "doc_id long, grade double, x double")


def _placed(b: pa.RecordBatch, feats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place in the vocabulary, row and count of each entry of a batch whose feature is in it."""
    f, docs = _flat(b.column("feats"))
    a, _ = _flat(b.column("counts"))
    at = np.searchsorted(feats, f)
    known = (at < len(feats)) & (feats[np.minimum(at, len(feats) - 1)] == f) if len(feats) else np.zeros(len(f), bool)
    return at[known], docs[known], a[known]


class _Joined:
    """The same for vocabularies of any size: vectors are tables.

    The edges are written twice, in buckets of the document and in buckets of the feature. There a feature
    of very many documents is split by document over ``SALTS`` shares, to which its row of the vector is repeated.
    """

    def __init__(self, graph: DataFrame, state: DataFrame, scratch: Scratch):
        self.graph, self.scratch = graph, scratch
        edges = graph.select("doc_id", "grade", F.explode(F.arrays_zip("feats", "counts")).alias("e")).select("doc_id", "grade", F.col("e.feats").alias("feat"), F.col("e.counts").alias("a"))
        limit = max(20_000, (state.agg(F.sum("n_docs")).first()[0] or 0) // (4 * shuffle_partitions(graph.sparkSession)))
        # More than total / (4 · partitions) documents each: at most 4 · partitions such features.
        hot = state.filter(F.col("n_docs") > limit).select(F.col("feat").alias("hot"))
        salt = F.when(F.col("hot").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).cast("int")
        kept = edges.join(state.select("feat", "q"), "feat").join(F.broadcast(hot), F.col("feat") == F.col("hot"), "left").withColumn("salt", salt).drop("hot")
        kept = kept.withColumn("w", F.col("a") * F.col("q")).drop("q")
        self.by_feature = scratch.save_bucketed(kept, "by_feature", ["feat", "salt"])
        self.by_document = scratch.save_bucketed(self.by_feature.drop("salt"), "by_document", ["doc_id"])
        copies = F.when(F.col("n_docs") > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        self.state = scratch.save(state.select("feat", "g", copies.alias("copies")), "start")

    def _documents(self, vector: DataFrame, own: DataFrame | None = None) -> DataFrame:
        """doc_id, x: the mean of ``v`` over the document's features."""
        at = self.by_feature.join(vector.withColumn("salt", F.explode("copies")), ["feat", "salt"])
        value = F.col("v")
        if own is not None:
            at = at.filter(F.col("weight") - F.col("a") > 0.5)
            value = (F.col("total") - F.col("a") * F.coalesce("grade", "v")) / (F.col("weight") - F.col("a"))
        return at.groupBy("doc_id").agg((F.sum(F.col("w") * value) / F.sum("w")).alias("x"))

    def _sums(self, vector: DataFrame | None, weight: str, graded: bool) -> DataFrame:
        """feat, total, weight as in ``_Broadcast``."""
        at = self.by_document.filter("grade is not null" if vector is None else "true" if graded else "grade is null")
        if vector is None:
            at = at.withColumn("x", F.col("grade"))
        else:
            at = at.join(self._documents(vector), "doc_id").withColumn("x", F.coalesce("grade", "x"))
        return at.groupBy("feat").agg(F.sum(F.col(weight) * F.col("x")).alias("total"), F.sum(weight).alias("weight"))

    def solve(self, tolerance: float) -> float:
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        fixed = self._sums(None, "w", True).select("feat", F.col("total").alias("fixed"), F.col("weight").alias("w1"))
        others = self._sums(self.state.withColumn("v", F.col("g")), "w", False).select("feat", F.col("total").alias("pulled"), F.col("weight").alias("w2"))
        s = self.state.join(fixed, "feat", "left").join(others, "feat", "left").withColumn("d", zero("w1") + zero("w2"))
        s = s.select("feat", "copies", "g", "d", (zero("fixed") - F.col("d") * F.col("g") + zero("pulled")).alias("r"))
        s = self.scratch.save(s.withColumn("z", F.col("r") / F.col("d")).withColumn("p", F.col("z")), "cg")
        norms = lambda df: df.agg(F.sum(F.col("r") * F.col("z")), F.max(F.abs("z"))).first()
        rz, far = norms(s)
        for self.rounds in range(SAFETY_ROUNDS):
            if far is None or far < tolerance:
                self.solution = self.scratch.save(s.select("feat", "copies", (F.col("g") + F.col("z")).alias("v")), "solution")
                return far or 0.0
            pulled = self._sums(s.select("feat", "copies", F.col("p").alias("v")), "w", False).select("feat", "total")
            s = self.scratch.save(s.join(pulled, "feat", "left").withColumn("ap", F.col("d") * F.col("p") - zero("total")).drop("total"), "cg")
            step = rz / s.agg(F.sum(F.col("p") * F.col("ap"))).first()[0]
            s = s.withColumns({"g": F.col("g") + step * F.col("p"), "r": F.col("r") - step * F.col("ap")}).withColumn("z", F.col("r") / F.col("d")).drop("ap")
            before = rz
            rz, far = norms(s)
            s = s.withColumn("p", F.col("z") + rz / before * F.col("p"))
        raise RuntimeError(f"levels still move by {far} after {SAFETY_ROUNDS} rounds")

    def judged(self) -> DataFrame:
        known = self.solution.join(self._sums(self.solution, "a", True), "feat")
        return self.graph.select("doc_id", "grade").join(self._documents(known, known), "doc_id", "left")


def reading_levels(docs: DataFrame, labels: DataFrame, least_words: int = 40, levels: int = 4, min_docs: int = 3, tolerance: float = 0.002, smooth: float = 0.1) -> DataFrame:
    """doc_id, reading_level of each document with at least ``least_words`` words.

    docs: ``doc_id`` (long), ``text``; labels: ``doc_id``, ``reading_level`` by raters; other columns are not read.

    Documents and the features of their main text form a bipartite graph, weighted by counts and by how
    little the levels of a feature's graded documents vary. Graded documents are clamped to their mean
    grade; of all others, and of all features, each is the mean of its neighbours. Conjugate gradients find these
    values, until one more round of means would move nothing by ``tolerance``; there is no other end. Each document is then judged by its features
    without its own contribution, so graded documents are judged like all others, and the cuts between
    levels are those that agree best with their grades: a rater's error moves neither a document nor a cut.

    Defined results: null texts have no words; a document of several rows is one document; without main text
    a document counts as average; grades of unknown documents are ignored; without any grade the level
    is null; features in fewer than ``min_docs`` documents say nothing.

    A round is one pass over the documents, which stay where they are; only sums by feature are shuffled,
    aggregated before. Vectors over at most ``BROADCAST_ROWS`` features are broadcast, longer ones joined.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reading")
    final = judged(docs, labels, scratch, least_words, min_docs, tolerance, smooth)[0]
    tops = [k + 0.5 for k in range(1, levels)]
    if "x" not in final.columns:
        return final.select("doc_id", F.lit(None).cast("int").alias("reading_level"))
    final = scratch.save(final, "judged")
    counted = final.filter("grade is not null").groupBy(F.floor(F.col("x") * BINS).alias("bin")).agg(F.count("*").alias("n"), *[F.count_if(F.col("grade") > t).alias(f"above{i}") for i, t in enumerate(tops)])
    cuts = _cuts([tuple(r) for r in counted.orderBy("bin").collect()], tops)
    level = sum((F.when(F.col("x") > c, 1).otherwise(0) for c in cuts), F.lit(1))
    return final.select("doc_id", level.cast("int").alias("reading_level"))


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, least_words: int, min_docs: int, tolerance: float, smooth: float):
    """doc_id, grade, x of each document (without x if there is no grade), and the solver that found them."""
    graded = labels.filter("reading_level is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    picked = spread(docs.select("doc_id", "text").filter("text is not null")).mapInPandas(_edges(least_words), "doc_id long, feats array<long>, counts array<double>")
    graph = scratch.save_bucketed(picked.dropDuplicates(["doc_id"]).join(graded, "doc_id", "left"), "graph", ["doc_id"])
    mu, var = graph.filter("grade is not null").agg(F.avg("grade"), F.coalesce(F.var_pop("grade"), F.lit(0.0))).first()
    if mu is None:
        return graph.select("doc_id"), None
    # Features as their graded documents show them, with three average documents added to each.
    edges = graph.select("grade", F.explode(F.arrays_zip("feats", "counts")).alias("e")).select("grade", F.col("e.feats").alias("feat"), F.col("e.counts").alias("a"))
    seen = edges.groupBy("feat").agg(
        F.count("*").alias("n_docs"), F.sum(F.when(F.col("grade").isNotNull(), F.col("a"))).alias("n"),
        F.sum(F.col("a") * F.col("grade")).alias("s"), F.sum(F.col("a") * F.col("grade") * F.col("grade")).alias("q"),
    ).filter(F.col("n_docs") >= min_docs).fillna(0.0)
    mean = (F.col("s") + 3 * mu) / (F.col("n") + 3)
    variance = (F.col("q") + 3 * (var + mu * mu)) / (F.col("n") + 3) - mean * mean
    state = scratch.save(seen.select("feat", "n_docs", mean.alias("g"), (1 / (F.greatest(variance, F.lit(0.0)) + smooth)).alias("q")), "features")
    solver = _Broadcast(graph, state) if state.count() <= BROADCAST_ROWS else _Joined(graph, state, scratch)
    solver.last_change = solver.solve(tolerance)
    return solver.judged().withColumn("x", F.coalesce("x", F.lit(mu))), solver
