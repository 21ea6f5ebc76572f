"""Operator 1: byte-pair encoding and decoding with forced-boundary splitting.

A pair of bytes that occurs inside no vocabulary token can never end up in one token, so a text may
be cut between them whatever the merges do. All such cuts of a batch of texts are found by one
table look-up for each byte; the fragments (mostly words) are encoded independently, each distinct
one once while a worker remembers it, and their ids are concatenated as packed integers.

The ids are those of the usual encoder, which first splits the text by a pattern and merges by
ascending rank in each piece. Two kinds of forced pair aren't used as cuts because the pattern
looks across them: after white space (it looks ahead to what follows), and beside an apostrophe
(contractions). Everywhere else the pattern, restarted at the cut, finds the same remaining
boundaries, or splits a piece just where no merge can reach.

The vocabulary is read once, on the driver, from a file of ranks (base64 token and rank on a line)
whose path is a parameter, and sent with the function; its size doesn't depend on the data.

Defined results: null gives null in either direction; an empty text is an empty array and the
reverse; ids outside the vocabulary raise ValueError; bytes that aren't UTF-8 decode to U+FFFD. Strings
of special tokens in a text are ordinary text. Very long texts are encoded whole; equal texts, and so repeated rows,
give equal ids; equal ranks don't occur. The column functions leave other columns as they are, `encode_documents` and
`round_trip` return only their own. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, lean, only, pieces

#: Default vocabulary; TOKENIZERS is the folder with the public files.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

_WS = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Fragments that a worker remembers: at most twice as many.
REMEMBERED = 150_000
_BATCH = 2 << 20
_MARK = 255  # in no UTF-8 text


class Vocabulary:
    """Ranks of byte-level tokens, with the table of forced cuts."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        inside = np.zeros((256, 256), bool)
        for token in ranks:
            for a, b in zip(token, token[1:]):
                inside[a, b] = True
        cut = ~inside
        cut[[*range(9, 14), 32, 39, _MARK]] = False
        cut[:, [39, _MARK, *range(0x80, 0xC0)]] = False
        self.cut = cut.ravel()
        self.new: dict[bytes, bytes] = {b"": b""}
        self.old: dict[bytes, bytes] = {}
        self.find = regex.compile(PATTERN).findall

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a})

    def __reduce__(self):
        return Vocabulary, (self.ranks,)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece of the pattern: the pair of least rank is merged, the leftmost of equals, again and again."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        if n < 50:
            parts = [piece[i : i + 1] for i in range(n)]
            near = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(n - 1)]
            while near:
                least = min(near)
                if least == 1 << 60:
                    break
                i = near.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del near[i]
                if i < len(near):
                    near[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
                if i:
                    near[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            return [ranks[p] for p in parts]
        ends, before, after = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if ends[i] else n
            if j >= n or ends[j] != end:  # one of the two has been merged since
                continue
            ends[i], ends[j], after[i] = end, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : ends[after[i]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        return [ranks[piece[i : ends[i]]] for i in range(n) if ends[i]]

    def fragment(self, data: bytes) -> bytes:
        """The ids of a fragment as packed 32-bit integers."""
        text = data.decode()
        if text.removeprefix(" ").isalpha():  # one piece of the pattern
            return np.array(self.merge(data), np.int32).tobytes()
        ids = [i for piece in self.find(text) for i in self.merge(piece.encode())]
        return np.array(ids, np.int32).tobytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        data = [t.encode() for t in texts]
        joined = bytes([_MARK]).join([*data, b""])
        b = np.frombuffer(joined, np.uint8)
        pair = b[:-1].astype(np.uint16)
        pair <<= 8
        pair |= b[1:]
        at = np.flatnonzero(self.cut[pair]) + 1
        if len(at):  # not after white space of several bytes
            first, second, last = b[np.maximum(at - 3, 0)], b[at - 2], b[at - 1]
            at = at[~((at >= 3) & (first >= 0xE1) & (first <= 0xE3) & (second >= 0x80) & (last >= 0x80) | (second == 0xC2) & ((last == 0x85) | (last == 0xA0)))]
        fragments = np.insert(b, at, _MARK).tobytes().split(bytes([_MARK]))[:-1]
        found = list(map(self.new.get, fragments))
        if None in found:
            for f in {f for f, x in zip(fragments, found) if x is None}:
                self.new[f] = self.old.get(f) or self.fragment(f)
            found = list(map(self.new.__getitem__, fragments))
            if len(self.new) > REMEMBERED:
                self.old, self.new = self.new, {b"": b""}
        ids = np.frombuffer(b"".join(found), np.int32)
        upto = np.cumsum([len(d) + 1 for d in data])
        ends = np.searchsorted(at, upto) + np.arange(1, len(data) + 1)  # fragments up to the end of each text
        counts = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) >> 2)
        return ids, np.diff(counts[ends - 1], prepend=0)

    def decode(self, ids: list[int]) -> str:
        try:
            return b"".join(map(self.tokens.__getitem__, ids)).decode(errors="replace")
        except KeyError as e:
            raise ValueError(f"the vocabulary has no token {e.args[0]}") from None


def _remembered(vocabulary: Vocabulary) -> Callable[[], Vocabulary]:
    """The worker's copy, so that it remembers fragments from task to task."""
    key = hashlib.sha256(repr(sorted(vocabulary.ranks.items())).encode()).hexdigest()

    def get() -> Vocabulary:
        return _WORKER.setdefault(key, vocabulary)

    return get


_WORKER: dict = {}


def encoder(vocabulary: Vocabulary):
    """A column function: text to array of token ids."""
    get = _remembered(vocabulary)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = get()
        for column in batches:
            texts = column.to_pylist()
            ids, counts = [], []
            for low, high in pieces([len(t or "") for t in texts], _BATCH):
                i, c = own.encode([t or "" for t in texts[low:high]])
                ids.append(i)
                counts.append(c)
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
            nulls = np.array([t is None for t in texts] + [False])
            yield pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=nulls), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))

    encode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(encode, "array<int>").asNondeterministic()  # else it may be evaluated once for each use of the column


def decoder(vocabulary: Vocabulary):
    """A column function: array of token ids to text."""
    get = _remembered(vocabulary)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = get()
        for column in batches:
            out: list[str | None] = []
            for low, high in pieces([n or 0 for n in column.value_lengths().to_pylist()], _BATCH // 8):
                part = column.slice(low, high - low)
                ids, at = part.flatten().to_numpy(zero_copy_only=False).tolist(), 0
                for n in part.value_lengths().to_pylist():
                    out.append(None if n is None else own.decode(ids[at : at + n]))
                    at += n or 0
            yield pa.array(out, pa.string())

    decode.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(decode, "string").asNondeterministic()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text, token_ids) of each document."""
    vocabulary = Vocabulary.load(path or f"{TOKENIZERS}/{VOCABULARY}")
    return only(docs, ["doc_id", "text"]).withColumn("token_ids", encoder(vocabulary)("text"))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) of each document: its ids, and whether they decode to the text.

    One pass and one worker for each task, in parts of bounded size: texts go to Python once and don't come back.
    """
    lean(docs.sparkSession)
    get = _remembered(Vocabulary.load(path or f"{TOKENIZERS}/{VOCABULARY}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = get()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for low, high in pieces([len(t or "") for t in texts], _BATCH):
                part = texts[low:high]
                ids, counts = own.encode([t or "" for t in part])
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                plain, bounds = ids.tolist(), offsets.tolist()
                back = [t is None or own.decode(plain[a:b]) == t for t, a, b in zip(part, bounds, bounds[1:])]
                nulls = np.array([t is None for t in part] + [False])
                lists = pa.ListArray.from_arrays(pa.array(offsets, mask=nulls), pa.array(ids))
                n = pa.array(counts.astype(np.int32), mask=nulls[:-1])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), lists, n, pa.array(back)], ["doc_id", "token_ids", "n_tokens", "round_trip"])

    return only(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, token_ids array<int>, n_tokens int, round_trip boolean")


def query(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Encodes all documents, decodes the ids, and tells whether the text came back."""
    return round_trip(documents(spark, sf_dir), path)
