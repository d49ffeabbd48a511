"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse."""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterable, Iterator
from functools import cache, cached_property
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.session import ship, spread

#: Where the public tokenizers lie; a parameter of everything below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the pattern by which this vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(PATTERN)
#: The pattern looks at most this many characters past the end of a piece.
_CUT_LOOKAHEAD = 2
_RUNS = [regex.compile(p) for p in (r" ?\p{L}+", r" ?\p{N}+", r"\s+", r" ?[^\s\p{L}\p{N}]+")]
_MORE = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"\s*", r"[^\s\p{L}\p{N}]*")]

#: Characters read at a time, bytes of a piece taken at a time, entries of the caches.
CHUNK, BLOCK, CACHED = 1 << 16, 2048, 1 << 18


class Vocabulary(dict):
    """Pieces of text → ids, computed when first asked for; ranks and merges of a vocabulary."""

    def __init__(self, ranks: dict[bytes, int], lookahead: int | None = None):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._fits: dict[tuple[int, int], bool] = {}
        if lookahead is not None:
            self.lookahead = lookahead

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        data = piece.encode()
        self[piece] = ids = tuple(self.transduce((data[i : i + BLOCK] for i in range(0, len(data), BLOCK))))
        return ids

    def merge(self, data: bytes) -> list[int]:
        """What two tokens side by side become, by the definition: of all neighbours that form a token the one of least rank merges first."""
        ranks = self.ranks
        if data in ranks:
            return [ranks[data]]
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min(((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b side by side stay as they are."""
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= CACHED:
                self._fits.clear()
            known = self._fits[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def transduce(self, blocks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece of any length that comes in blocks, given out once no further byte can change them.

        The encoding of every prefix ends in exactly one token that fits the encoding before it, so
        each position points back to the one where its last token begins. A later token begins at
        one of the last ``longest`` positions; up to where the ways back from all of these meet,
        tokens are final. They are so too where they end ``lookahead`` bytes before what is read, on whatever
        way: so at most that many bytes, one token and one block are held.
        """
        ranks, longest = self.ranks, self.longest
        data, last = b"", [-1]  # last[i]: token that ends at i of the bytes kept
        first = True
        before = -1  # the token given out last
        for block in blocks:
            data += block
            n = len(data)
            for i in range(len(last), n + 1):
                found = -1
                for size in range(min(longest, i), 0, -1):
                    token = ranks.get(data[i - size : i])
                    if token is not None:
                        prior = last[i - size] if i > size else before
                        if (i == size and first and prior < 0) or (prior >= 0 and self.fits(prior, token)):
                            found = token
                            break
                last.append(found)
            heads = {i for i in range(max(0, n - longest), n + 1) if i == 0 or last[i] >= 0}
            settled = n - self.lookahead if n > longest else 0
            while len(heads) > 1 and max(heads) > settled:
                top = max(heads)
                heads.remove(top)
                heads.add(top - len(self.bytes_of[last[top]]))
            if done := max(heads, default=0):
                out = self._back(last, done)
                yield from out
                before, first = out[-1], False
                data, last = data[done:], [-1, *last[done + 1 :]]
        yield from self._back(last, len(data))

    def _back(self, last: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return out[::-1]

    def merges(self) -> list[tuple[bytes, bytes, bytes]]:
        """(left, right, both) of each merge by rank, recovered from the ranks."""
        out = []
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = [token[i : i + 1] for i in range(len(token))]
                while len(parts) > 2:
                    best, at = min(((r if (r := self.ranks.get(a + b, 1 << 60)) < rank else 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                    if best == 1 << 60:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    out.append((parts[0], parts[1], token))
        return out

    @cached_property
    def lookahead(self) -> int:
        """Bytes after which no further byte can change a token: sufficient for every text. Computed once, in the driver.

        Text on the right undoes a merge only by an earlier merge that takes the merge's right part
        (or its beginning) away, which in turn a still earlier one may have undone. The longest such
        chain of merges, times the longest token, bounds how far a change can travel to the left.
        """
        split = {t: a for a, _, t in self.merges()}
        reach: dict[bytes, int] = {}
        longest_chain = 1
        for left, right, _ in self.merges():
            length = 1 + reach.get(right, 0)
            longest_chain = max(longest_chain, length)
            spine: bytes | None = left
            while spine is not None:
                reach[spine] = max(reach.get(spine, 0), length)
                spine = split.get(spine)
        return longest_chain * self.longest


class Encoder:
    """Text in chunks → ids, each given out once it is stable."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.held = ""

    def encode(self, chunks: Iterable[str]) -> Iterator[int]:
        source = iter(chunks)
        v, self.held = self.v, ""
        for chunk in source:
            self.held += chunk
            # Pieces whose end nothing that follows can move; the last one always waits.
            pieces, end = _CUT.findall(self.held), len(self.held)
            while pieces and end + _CUT_LOOKAHEAD > len(self.held):
                end -= len(pieces.pop())
            yield from chain.from_iterable(map(v.__getitem__, pieces))
            self.held = self.held[end:]
            if len(self.held) >= CHUNK:  # one piece, and no end of it in sight
                yield from v.transduce(self._piece(source))
        yield from chain.from_iterable(map(v.__getitem__, _CUT.findall(self.held)))
        self.held = ""

    def _piece(self, source: Iterator[str]) -> Iterator[bytes]:
        """The piece at the start of what is held, in blocks; what follows it stays held."""
        kind = next(k for k, r in enumerate(_RUNS) if (m := r.match(self.held)) and m.end() > len(self.held) // 2)
        end = _RUNS[kind].match(self.held).end()
        while end == len(self.held):
            # The last white space before other text belongs to what follows, so one is kept back.
            cut = end - 1
            yield from (self.held[i : min(i + BLOCK, cut)].encode() for i in range(0, cut, BLOCK))
            self.held = self.held[cut:]
            chunk = next(source, None)
            if chunk is None:
                yield self.held.encode()
                self.held = ""
                return
            self.held += chunk
            end = _MORE[kind].match(self.held).end()
        if kind == 2:
            end -= 1
        yield self.held[:end].encode()
        self.held = self.held[end:]

    def ids(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for null and for empty text."""
        text = text or ""
        return list(self.encode(text[i : i + CHUNK] for i in range(0, len(text), CHUNK)))


def decode(ids: Iterable[int], vocabulary: Vocabulary) -> Iterator[str]:
    """Text of ids piece by piece: bytes wait until they form whole characters."""
    machine = codecs.getincrementaldecoder("utf-8")()
    for i in ids:
        if text := machine.decode(vocabulary.bytes_of[i]):
            yield text
    yield machine.decode(b"", final=True)


def parse(data: bytes, lookahead: int | None = None) -> Vocabulary:
    """The vocabulary of a file of ranks."""
    return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}, lookahead)


@cache
def load(path: str = VOCABULARY) -> Vocabulary:
    """The vocabulary in a file of the driver, once for each process."""
    with open(path, "rb") as f:
        return parse(f.read())


#: The vocabularies of a Python worker by the id of the broadcast that brought them.
_SENT: dict[int, Vocabulary] = {}


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """key and ``ids`` (array<int>) of each text, without special tokens.

    Strings that name special tokens are ordinary text. Every text goes through the transducer in chunks, in the tasks
    that scan them (spread out first if these are fewer than the cores). The file at ``path`` is read in the driver;
    its bytes, a megabyte for each 50,000 tokens, and the lookahead computed from it are broadcast. Defined results:
    the empty list for null and for empty texts; repeated rows repeat; no rows give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast((f.read(), load(path).lookahead))
    number = sent._jbroadcast.id()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if number not in _SENT:
            _SENT.clear()
            _SENT[number] = parse(*sent.value)
        encoder = Encoder(_SENT[number])
        for batch in batches:
            lists = [encoder.ids(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(pa.int32()))], names=[key, "ids"])

    return spread(docs.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
