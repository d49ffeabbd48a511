import os
import random

import pytest

from graphlens.llm import reading
from graphlens.session import Scratch, table

WORDS = {1: "box key map plan tree list step".split(), 2: "schema permission notification release folder branch".split(), 3: "propagate incremental heterogeneous reconcile normalize serialize".split(), 4: "epistemological circumscribe ontology necessitate recondite tautological".split()}
COMMON = "the a of and to with it is".split()


def corpus(n, seed):
    rng = random.Random(seed)
    docs = []
    for k in range(n):
        level = k % 4 + 1
        text = [" ".join(rng.choice(WORDS[level if rng.random() < 0.8 else rng.choice([max(1, level - 1), min(4, level + 1)])]) if rng.random() < 0.5 else rng.choice(COMMON) for _ in range(4 + 4 * level)) + "." for _ in range(12)]
        docs.append((k, level, "# Title of it\n\n```\ncode box key\n```\n" + " ".join(text)))
    return docs


def levels(spark, docs, labels, **kw):
    d = spark.createDataFrame([(i, t, 1, "clash") for i, t in docs], "doc_id long, text string, grade int, feat string")
    l = spark.createDataFrame([(i, v, "r") for i, v in labels], "doc_id long, reading_level int, x string")
    return {r.doc_id: r.reading_level for r in reading.reading_levels(d, l, **kw).collect()}


def test_held_out_levels_despite_wrong_raters(spark):
    docs = corpus(240, 1)
    rng = random.Random(3)
    labels = [(k, v if rng.random() < 0.93 else rng.randint(1, 4)) for k, v, _ in docs[:80]]
    got = levels(spark, [(k, t) for k, _, t in docs], labels)
    right = sum(got[k] == v for k, v, _ in docs[80:]) / len(docs[80:])
    assert len(got) == 240 and right >= 0.95


def test_odd_rows_and_no_labels(spark):
    docs = [(k, t) for k, _, t in corpus(40, 2)]
    odd = [(900, None), (901, ""), (902, "short text"), (903, "```\n" + "code " * 50 + "\n```"), (1, docs[1][1])]
    labels = [(k, k % 4 + 1) for k in range(40)] + [(9999, 4), (5, None), (None, 1)]
    got = levels(spark, docs + odd, labels)
    assert set(got) == {*range(40), 903} and got[903] in (1, 2, 3, 4)
    assert set(levels(spark, docs, []).values()) == {None} and levels(spark, [], labels) == {}


def test_main_text_leaves_layout_out():
    text = "# Head\nStatus: superseded\n\n- First point here.\n> quoted\n\n```\ncode\n```\nSee `x.y` or https://a.b/c now.\n"
    assert reading.words(reading.main_text(text)) == ["first", "point", "here", "see", "or", "now"]


def test_cuts_split_by_fewest_errors():
    # bins 0..3 with one label each: levels 1, 1, 2, 2
    assert 1 / reading.BINS < reading._cuts([(0, 1, 0), (1, 1, 0), (2, 1, 1), (3, 1, 1)], [1.5])[0] <= 2.5 / reading.BINS
    assert reading._cuts([(5, 3, 0)], [1.5]) == [float("inf")] and reading._cuts([(5, 3, 3)], [1.5]) == [float("-inf")]


def test_joined_vectors_give_the_same_levels(spark, monkeypatch):
    docs = corpus(120, 5)
    labels = [(k, v) for k, v, _ in docs[:40]]
    one = levels(spark, [(k, t) for k, _, t in docs], labels)
    monkeypatch.setattr(reading, "BROADCAST_ROWS", 0)
    assert levels(spark, [(k, t) for k, _, t in docs], labels) == one


@pytest.mark.parametrize("bound", [reading.BROADCAST_ROWS, 0])
def test_iterates_until_a_harmonic_round_moves_nothing(spark, monkeypatch, bound):
    """A long chain of documents, graded at one end only: a fixed small number of rounds stops far from the solution."""
    monkeypatch.setattr(reading, "BROADCAST_ROWS", bound)
    text = lambda k: f"word{k} word{k + 1} " * 25
    d = spark.createDataFrame([(k, text(k)) for k in range(30)], "doc_id long, text string")
    l = spark.createDataFrame([(0, 1), (29, 4)], "doc_id long, reading_level int")
    out, solver = reading.judged(d, l, Scratch(spark, "chain"), 40, 1, 1e-6, 0.1)
    assert solver.last_change < 1e-6 and solver.rounds > 8 and out.count() == 30


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(reading, "SAFETY_ROUNDS", 1)
    docs = corpus(80, 6)
    with pytest.raises(RuntimeError, match="still move"):
        levels(spark, [(k, t) for k, _, t in docs], [(k, v) for k, v, _ in docs[:10]], tolerance=1e-12)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_test_tables_converge(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents").filter("lang = 'en' and doc_kind in ('guide', 'adr', 'issue', 'runbook', 'faq')")
    _, solver = reading.judged(docs, table(spark, "/root/testdata/sf0.1", "reading_labels"), Scratch(spark, "levels"), 40, 3, 0.002, 0.1)
    assert solver.last_change < 0.002
