import random

import pytest

from graphlens.llm import leaks


def brute(docs, items, run):
    grams = {}
    for i, t in items:
        w = leaks.words(t)
        for k in range(len(w) - run + 1):
            grams.setdefault(tuple(w[k : k + run]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leaks.words(t)
        for k in range(len(w) - run + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + run]), ())}
    return out


def found(spark, docs, items, **kw):
    d = spark.createDataFrame([(*x, 1, "clash") for x in docs], "doc_id long, text string, item_id int, fp string")
    i = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, item_text string, text string")
    return {tuple(r) for r in leaks.leaks(d, i, **kw).collect()}


def test_words_are_normalised():
    assert leaks.words("ﬁne_Tuning Ⅷ x² don't ÀB") == ["fine", "tuning", "viii", "x2", "don", "t", "àb"]
    assert leaks.words(None) == leaks.words("") == leaks.words(" _ -- ") == []


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts_match_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(6 if seed == 1 else 60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 40)))) for k in range(15)]
    docs = []
    for k in range(60):
        text = [rng.choice(vocab) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.7:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w) + 1)
            at = rng.randrange(len(text) + 1)
            text[at:at] = [x.upper() + "," for x in w[a : a + rng.randrange(8, 20)]]
        docs.append((k, " ".join(text)))
    assert found(spark, docs, items) == brute(docs, items, 12)


def test_exactly_twelve_words_and_repeats(spark):
    run = "one two three four five six seven eight nine ten eleven twelve"
    docs = [(1, f"zero {run} thirteen"), (2, run.rsplit(" ", 1)[0] + " other end of it"), (3, None), (4, ""), (5, "a " * 500 + run + " a" * 500), (1, f"zero {run} thirteen"), (6, "same " * 40)]
    items = [(7, run), (8, "ONE–two. " + run), (9, None), (10, "same " * 12), (11, "same " * 11), (7, run)]
    assert found(spark, docs, items) == {(d, i) for d in (1, 5) for i in (7, 8)} | {(6, 10)}


def test_empty_tables(spark):
    assert found(spark, [], [(1, "x " * 20)]) == set() and found(spark, [(1, "x " * 20)], []) == set()


def test_shuffled_plan_gives_the_same(spark, monkeypatch):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choice("abcdefgh") for _ in range(30))) for k in range(12)]
    docs = [(k, " ".join(rng.choice("abcdefgh") for _ in range(20)) + " " + items[k % 12][1][10:40]) for k in range(60)]
    one = found(spark, docs, items)
    monkeypatch.setattr(leaks, "BROADCAST_PRINTS", 0)
    monkeypatch.setattr(leaks, "BROADCAST_TEXT", 0)
    monkeypatch.setattr(leaks, "BROADCAST_IDS", 0)
    monkeypatch.setattr("graphlens.operators.skew.HOT_FLOOR", 5)
    assert one == found(spark, docs, items) == brute(docs, items, 12)


def test_texts_of_one_repeated_word_and_an_item_in_many_documents(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    docs = [(k, f"d{k} {passage} e{k}") for k in range(10_000)] + [(20_000, "same " * 10_000), (20_001, ("same " * 11 + "other ") * 500)]
    items = [(1, passage), (2, "same " * 100), (3, "same " * 5_000), (4, "same " * 11 + "end")]
    got = found(spark, docs, items)
    assert got == {(k, 1) for k in range(10_000)} | {(20_000, 2), (20_000, 3)}


def test_run_between_shorter_ones_on_one_diagonal(spark):
    """The first and the last hit of a diagonal belong to runs that are too short; the one between them is long enough."""
    w = [f"w{k}" for k in range(80)]
    doc = [x if k not in (10, 11, 25, 39, 40) else f"x{k}" for k, x in enumerate(w[:60])]
    docs, items = [(1, " ".join(doc)), (2, " ".join(x if k % 12 else "y" for k, x in enumerate(w)))], [(1, " ".join(w[:60])), (2, " ".join(w))]
    assert found(spark, docs, items) == brute(docs, items, 12) and (1, 1) in brute(docs, items, 12)
