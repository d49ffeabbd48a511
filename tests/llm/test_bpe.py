import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphlens.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})


@pytest.fixture
def encoder():
    return bpe.Encoder(bpe.load())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=300))
def test_any_text_equals_the_library_and_comes_back(text):
    import tiktoken

    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load().ranks, special_tokens={})
    ids = bpe.Encoder(bpe.load()).ids(text)
    assert ids == lib.encode_ordinary(text) and "".join(bpe.decode(ids, bpe.load())) == text


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64])
def test_chunks_do_not_matter(encoder, library, size, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 16)
    rng = random.Random(size)
    for _ in range(20):
        text = "".join(rng.choice(["the ", "'ll", "'", "  ", "\n", " \n x", "aaaa", "É", "中文字", "12 345", "!!!", "<|endoftext|>", "ing", "ab" * 20, " " * 40]) for _ in range(30))
        assert list(encoder.encode(text[i : i + size] for i in range(0, len(text), size))) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 9000, "ab" * 4000, " " * 9000 + "x", "x" + "\n" * 9000, "=" * 9000, "é" * 4000, "1" * 5000 + "a", "q" + "thequickbrownfox" * 500])
def test_pieces_without_end(encoder, library, text, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 1024)
    assert encoder.ids(text) == library.encode_ordinary(text)


def test_tokens_are_final_within_the_lookahead():
    v = bpe.load()
    assert v.longest <= v.lookahead < 1 << 17
    data = ("thequickbrownfox" * 300).encode()
    given_out, fed = [], 0

    def blocks():
        nonlocal fed
        for i in range(0, len(data), 16):
            fed = i + 16
            yield data[i : i + 16]

    done = 0
    for token in v.transduce(blocks()):
        done += len(v.bytes_of[token])
        given_out.append(fed - done)
    assert max(given_out) <= v.lookahead and b"".join(v.bytes_of[t] for t in v.transduce([data])) == data


def test_every_text_goes_through_the_transducer(encoder, library, monkeypatch):
    """Short and long texts alike: without it nothing is encoded, and the definition's merge only ever sees two tokens."""
    v = bpe.Vocabulary(bpe.load().ranks, bpe.load().lookahead)
    seen, fits = [], v.merge
    monkeypatch.setattr(v, "merge", lambda data: seen.append(len(data)) or fits(data))
    for text in ("Hello snapshotting worlds", "x", "antidisestablishmentarianism " * 40):
        assert bpe.Encoder(v).ids(text) == library.encode_ordinary(text)
    assert max(seen) <= 2 * v.longest
    monkeypatch.setattr(bpe.Vocabulary, "transduce", lambda self, blocks: iter(()))
    assert bpe.Encoder(bpe.Vocabulary(v.ranks, v.lookahead)).ids("Hello world") == []


def test_memory_does_not_grow_with_the_text():
    """A hundred megabytes, in ordinary words and as one piece without end: what is held stays within a few chunks."""
    script = """
import collections, resource, sys
from graphlens.llm import bpe
v = bpe.load()
v.lookahead
words = ("the snapshot of a graph holds nodes, edges and 42 verbs.\\n" * 1200)[: 1 << 16]
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
def feed():
    for k in range(1600):
        if k == 100:
            print(peak())
        yield words
collections.deque(bpe.Encoder(v).encode(feed()), maxlen=0)
print(peak())
"""
    root = Path(__file__).resolve().parents[2]
    early, late = map(int, subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, cwd=root).stdout.split())
    assert late - early < 16 << 10  # kilobytes
    v = bpe.load()
    encoder, held = bpe.Encoder(v), 0
    for k, _ in enumerate(encoder.encode("thequickbrownfox" * 4096 for _ in range(8))):
        held = max(held, len(encoder.held))
    assert held <= 2 * bpe.CHUNK


def test_the_lookahead_bounds_what_is_held():
    """With a lookahead of its longest token nothing more than that and a block waits, wherever the ways back meet."""
    v = bpe.Vocabulary(bpe.load().ranks, bpe.load().lookahead)
    data = bytes(range(97, 123)) * 400
    fed = done = worst = 0

    def blocks():
        nonlocal fed
        for i in range(0, len(data), 64):
            fed = i + 64
            yield data[i : i + 64]

    for token in v.transduce(blocks()):
        worst = max(worst, fed - done)
        done += len(v.bytes_of[token])
    assert done == len(data) and worst <= v.lookahead + v.longest + 64


def test_corpus_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, "", "x"), (3, None, "x"), (4, "<|endoftext|>", "x"), (1, "Hello world", "x")], "doc_id long, text string, ids string")
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect())
    assert got[0] == got[1] == (1, [15496, 995]) and got[2:4] == [(2, []), (3, [])] and 50256 not in got[4][1] and len(got[4][1]) > 1
    assert bpe.encode_corpus(df.limit(0)).count() == 0
