"""Evaluation texts that leak into training texts: winnowed fingerprints, joined and extended."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators.skew import salted_join
from graphlens.session import Scratch, spread

#: Words of a shared run, and of a fingerprinted gram. The window of winnowing follows from both.
RUN, GRAM = 12, 8
#: Most fingerprints of items that are broadcast, about 40 bytes each, most bytes of item texts, and most ids of documents, about 30 bytes each.
BROADCAST_PRINTS, BROADCAST_TEXT, BROADCAST_IDS = 500_000, 32 << 20, 1_000_000

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits after NFKC and lower-casing."""
    if not text:
        return []
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).lower())


class _Hashes(dict):
    """Word → 64-bit hash, within a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 20:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def fingerprints(tokens: list[str], hashes: dict, run: int = RUN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed (hash, position) of a text's grams.

    Of each ``run - gram + 1`` neighbouring grams the least hash is kept, the last one among equals. So
    two texts with ``run`` words in common keep one of the grams in it alike.
    """
    if len(tokens) < run:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    h = np.fromiter((hashes[w] for w in tokens), np.uint64, len(tokens))
    n = len(tokens) - gram + 1
    g = np.zeros(n, np.uint64)
    for j in range(gram):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    g ^= g >> np.uint64(31)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(29)
    size = run - gram + 1
    windows = np.lib.stride_tricks.sliding_window_view(g, size)
    at = np.unique(np.arange(len(windows)) + size - 1 - np.argmin(windows[:, ::-1], axis=1))
    return g[at].view(np.int64), at.astype(np.int32)


def _print_rows(run: int, gram: int):
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for pdf in batches:
            keys, prints, places = [], [], []
            for key, text in zip(pdf.iloc[:, 0], pdf.iloc[:, 1]):
                fp, at = fingerprints(words(text), hashes, run, gram)
                keys.append(np.full(len(fp), key, np.int64))
                prints.append(fp)
                places.append(at)
            if keys:
                yield pd.DataFrame({"id": np.concatenate(keys), "fp": np.concatenate(prints), "at": np.concatenate(places)})

    return rows


def _extended(run: int):
    """Keeps pairs whose hits extend to a shared run; rows of a document come together."""

    def shared(a: list[str], b: list[str], spans) -> bool:
        """Walks each diagonal from its first hit, and what comes before it, to beyond its last one."""
        for span in spans:
            d, i, last = span["diagonal"], span["first"], span["last"]
            while i > 0 and i > d and a[i - 1] == b[i - 1 - d] and last - i < run:
                i -= 1
            length = 0
            while i < len(a) and i - d < len(b):
                if a[i] == b[i - d]:
                    length += 1
                    if length >= run:
                        return True
                elif i > last:
                    break
                else:
                    length = 0
                i += 1
        return False

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, own = None, []
        items: dict[int, list[str]] = {}
        for pdf in batches:
            keep = []
            for doc, item, text, item_text, spans in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item_text"], pdf["spans"]):
                if last != (doc, text):
                    last, own = (doc, text), words(text)
                if (item, item_text) not in items:
                    if len(items) > 4096:
                        items.clear()
                    items[item, item_text] = words(item_text)
                keep.append(shared(own, items[item, item_text], spans))
            yield pdf.loc[keep, ["doc_id", "item_id"]]

    return rows


def leaks(docs: DataFrame, items: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """doc_id, item_id of each document and item with ``run`` consecutive words in common.

    docs: ``doc_id``, ``text``; items: ``item_id``, ``item_text`` (ids are integers); other columns are not read.

    Defined results: null, empty and short texts share nothing; repeated rows and passages count once;
    several texts under one id are texts of their own; empty tables give no rows; whole texts are read.

    The corpus gives one fingerprint for about each third word; those join with the items' by hash. The
    items' prints are written and counted first: up to ``BROADCAST_PRINTS`` are broadcast. Beyond that the corpus's
    prints are written too, and a print of very many documents is split by document. Hits shrink to the first
    and the last on each diagonal before they are gathered, so a pair gathers at most two for each word of both
    texts, however often these repeat. Texts are fetched only for pairs that hit: up to ``BROADCAST_IDS`` ids of documents
    go to where the texts are, so that only these are shuffled. An item of very many documents or a document of very many items is split.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    docs = docs.select("doc_id", "text")
    items = scratch.save(items.select("item_id", "item_text").filter("item_text is not null").distinct(), "items")
    schema = "id long, fp long, at int"
    test = scratch.save(items.mapInPandas(_print_rows(run, gram), schema).select(F.col("id").alias("item_id"), "fp", F.col("at").alias("item_at")).distinct(), "prints")
    corpus = spread(docs.filter("text is not null")).mapInPandas(_print_rows(run, gram), schema).withColumnRenamed("id", "doc_id")
    if test.count() <= BROADCAST_PRINTS:
        hits = corpus.join(F.broadcast(test), "fp")
    else:
        hits = salted_join(scratch.save(corpus, "corpus"), test, "fp", "inner", "doc_id")
    diagonals = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    pairs = scratch.save(diagonals.groupBy("doc_id", "item_id").agg(F.collect_list(F.struct("diagonal", "first", "last")).alias("spans")), "pairs")
    if (items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0) <= BROADCAST_TEXT:
        full = pairs.join(F.broadcast(items), "item_id")
    else:
        full = salted_join(pairs, items, "item_id", "inner", "doc_id")
    hit = pairs.select("doc_id").distinct()
    wanted = docs.filter("text is not null").join(F.broadcast(hit) if hit.count() <= BROADCAST_IDS else hit, "doc_id", "left_semi")
    full = salted_join(full, wanted, "doc_id", "inner", "item_id").sortWithinPartitions("doc_id")
    return full.select("doc_id", "item_id", "text", "item_text", "spans").mapInPandas(_extended(run), "doc_id long, item_id long").distinct()
