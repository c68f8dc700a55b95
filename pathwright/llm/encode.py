"""Encoding of a whole corpus with a public byte-level BPE vocabulary.

Method: corpus-level merge replay. Texts are split into words once and kept as
lists of word hashes; every distinct word of the corpus is replayed once, in the
partition its hash falls in: an inverted index from pair of tokens to positions
applies every merge in rank order and touches only the neighbours of what it
merged. The ids come back to the documents by hash: those of the commonest words
from a broadcast of bounded size, those of the others by a join, in which no key
is hot, as the words are rare.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, functions as F

from pathwright.session import written

#: Words whose ids are broadcast, the commonest first: some 40 bytes each.
COMMON_WORDS = 400_000
#: Words replayed at a time, words whose hashes a task keeps while it splits, and characters it splits at a time; they bound memory and change nothing.
REPLAYED, KEPT_WORDS, CHARS = 100_000, 400_000, 4_000_000

#: The published splitting pattern of the byte-level vocabulary, and its form for ASCII texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ASCII = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The file of a public vocabulary: of the folder in PATHWRIGHT_TOKENIZERS, else of the installed package."""
    folder = os.environ.get("PATHWRIGHT_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank of each token of a vocabulary file of `base64 rank` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Merges:
    """A vocabulary as merges: which pair of ids gives which id."""

    def __init__(self, ranks: dict[bytes, int]):
        self.byte_ids = [ranks[bytes([b])] for b in range(256)]
        self.tokens = {i: t for t, i in ranks.items()}
        self.ranks = ranks
        self.known: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """The id, which is also the rank, of a and b together; -1 if they do not merge."""
        r = self.known.get((a, b))
        if r is None:
            r = self.known[a, b] = self.ranks.get(self.tokens[a] + self.tokens[b], -1)
            if len(self.known) > 2_000_000:
                self.known = {(a, b): r}
        return r

    def replay(self, words: Iterable[str]) -> dict[str, list[int]]:
        """The ids of each distinct word, by one replay of all merges over all of them."""
        words = list(dict.fromkeys(words))
        symbol: list[int] = []
        starts = [0]
        for w in words:
            symbol.extend(map(self.byte_ids.__getitem__, w.encode("utf-8", "surrogatepass")))
            symbol.append(-1)
            starts.append(len(symbol))
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = self.merged
        at: dict[tuple[int, int], list[int]] = {}
        ranks: list[tuple[int, tuple[int, int]]] = []

        def note(i: int, j: int) -> None:
            pair = symbol[i], symbol[j]
            if pair in at:
                at[pair].append(i)
                return
            r = merged(*pair)
            if r >= 0:
                at[pair] = [i]
                heapq.heappush(ranks, (r, pair))

        for i in range(n - 1):
            if symbol[i] >= 0 and symbol[i + 1] >= 0:
                note(i, i + 1)
        while ranks:
            r = ranks[0][0]
            places: list[int] = []
            while ranks and ranks[0][0] == r:  # pairs that give the same token are merged in the order of their places
                places += at.pop(heapq.heappop(ranks)[1])
            places.sort()
            for i in places:
                j = after[i]
                if symbol[i] < 0 or j >= n or symbol[j] < 0 or merged(symbol[i], symbol[j]) != r:
                    continue
                symbol[i], symbol[j] = r, -2
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    if symbol[k] >= 0:
                        note(i, k)
                h = before[i]
                if h >= 0 and symbol[h] >= 0:
                    note(h, i)
        return {w: [s for s in symbol[starts[k] : starts[k + 1]] if s >= 0] for k, w in enumerate(words)}


class Splitter:
    """Splits texts into the words that merges never cross."""

    def __init__(self):
        self.pattern, self.ascii = regex.compile(PATTERN), re.compile(_ASCII)

    def __call__(self, text: str) -> list[str]:
        # \x1c-\x1f are white space to one of the two libraries only
        plain = text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f")
        return (self.ascii if plain else self.pattern).findall(text)


class _Hashes(dict):
    """The hashes of words, made when first asked for."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), self.seed)
        return h


def split_documents(rows: DataFrame, seed: int) -> DataFrame:
    """(row, id, hashes) of every row (_id, _text), its words as hashes, row being unique; and (hash, word, times) of the words a task met: what it
    remembers of them it gives out once."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, known, times = Splitter(), _Hashes(seed), Counter()
        number = TaskContext.get().partitionId() << 40

        def met() -> pa.RecordBatch:
            n = len(known)
            hashes = np.fromiter(known.values(), dtype=np.uint64, count=n).view(np.int64)
            none = [pa.nulls(n, pa.int64()), pa.nulls(n, id_type), pa.nulls(n, pa.list_(pa.int64()))]
            batch = pa.RecordBatch.from_arrays([*none, pa.array(hashes), pa.array(list(known), pa.string()), pa.array([times[w] for w in known], pa.int64())], names=names)
            known.clear()
            times.clear()
            return batch

        names = ["row", "id", "hashes", "hash", "word", "times"]
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            begin = chars = 0
            each: list[list[str]] = []
            for i, t in enumerate(batch.column(1).to_pylist(), 1):
                each.append(split(t) if t else [])
                chars += len(t or "")
                if chars < CHARS and i < batch.num_rows:
                    continue
                n = len(each)
                ends = np.concatenate([[0], np.cumsum([len(ws) for ws in each])])
                flat = np.fromiter(map(known.__getitem__, itertools.chain.from_iterable(each)), dtype=np.uint64, count=int(ends[-1])).view(np.int64)
                times.update(itertools.chain.from_iterable(each))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                none = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), batch.column(0).slice(begin, n), lists, *none], names=names)
                number, begin, chars, each = number + n, i, 0, []
                if len(known) > KEPT_WORDS:
                    yield met()
        if known:
            yield met()

    return rows.mapInArrow(run, f"row bigint, id {kind}, hashes array<bigint>, hash bigint, word string, times bigint")


def vocabulary(words: DataFrame, path: str, replayed: Accumulator | None = None) -> DataFrame:
    """(hash, times, ids) of the distinct words (hash, word, times): each is replayed once, in the partition its hash falls in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(read_ranks(path))
        for batch in batches:
            for k in range(0, batch.num_rows, REPLAYED):
                part = batch.slice(k, REPLAYED)
                each = part.column(1).to_pylist()
                ids = merges.replay(each)
                if replayed is not None:
                    replayed.add(len(each))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([ids[w] for w in each], pa.list_(pa.int32()))], names=["hash", "times", "ids"])

    return words.select("hash", "word", "times").mapInArrow(run, "hash bigint, times bigint, ids array<int>")


def _gathered(hashes: np.ndarray, keys: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each hash, all ids in order); keys are sorted and hold every hash."""
    at = np.searchsorted(keys, hashes)
    sizes = starts[at + 1] - starts[at]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return sizes, ids[np.repeat(starts[at] - (ends - sizes), sizes) + np.arange(total)] if total else np.empty(0, dtype=np.int32)


def encode(documents: DataFrame, path: str | None = None, id_column: str = "doc_id", text_column: str = "text", replayed: Accumulator | None = None) -> DataFrame:
    """(id, ids) of every document by the vocabulary file at `path`, without special tokens; their
    strings in a text are ordinary text. replayed counts the words that merges were replayed for: the distinct words of the corpus, each once.

    An empty and a NULL text both give an empty list, blank text is encoded as it is, repeated rows give
    repeated results, a document of any length is one row, an empty table gives no rows; other columns
    are ignored. The path must be readable on every executor."""
    path = path or vocabulary_path()
    rows = documents.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    for seed in range(8):
        split = written(split_documents(rows, seed))
        words = split.where("word is not null").groupBy("hash").agg(F.min("word").alias("word"), F.max("word").alias("_other"), F.sum("times").alias("times"))
        words = written(words)
        if words.where("word <> _other").isEmpty():  # two words with one hash of 64 bits: take other hashes
            break
    found = written(vocabulary(words, path, replayed))
    docs = split.where("hashes is not null").select("row", F.col("id").alias(id_column), "hashes")
    common = found.orderBy(F.desc("times"), "hash").limit(COMMON_WORDS).select("hash", "ids").toArrow().combine_chunks().sort_by("hash")
    ids = common.column("ids").combine_chunks() if common.num_rows else pa.array([], pa.list_(pa.int32()))
    starts = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    table = rows.sparkSession.sparkContext.broadcast((common.column("hash").to_numpy(), starts, ids.flatten().to_numpy(zero_copy_only=False)))
    few = found.count() <= COMMON_WORDS
    if not few:
        docs = docs.join(_rare(docs, found, table), "row", "left")
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, starts, ids = table.value
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                lists = part.column(1)
                own = keys, starts, ids
                if not few:
                    own = _with_rare(keys, starts, ids, part.column(2))
                sizes, flat = _gathered(lists.flatten().to_numpy(zero_copy_only=False), *own)
                ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], names=[id_column, "ids"])

    return docs.select(id_column, "hashes", *([] if few else ["_rare"])).mapInArrow(run, f"{id_column} {kind}, ids array<int>")


def _rare(docs: DataFrame, found: DataFrame, table) -> DataFrame:
    """(row, _rare array of (hash, ids)) of the documents with words that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = table.value[0]
        for batch in batches:
            lists = batch.column(1)
            of = np.repeat(batch.column(0).to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            other = keys[np.minimum(np.searchsorted(keys, flat), len(keys) - 1)] != flat if len(keys) else np.ones(len(flat), dtype=bool)
            pairs = np.unique(np.stack([of[other], flat[other]]), axis=1) if other.any() else np.empty((2, 0), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["row", "hash"])

    j = docs.select("row", "hashes").mapInArrow(run, "row bigint, hash bigint").join(found.select("hash", "ids"), "hash")
    return j.groupBy("row").agg(F.collect_list(F.struct("hash", "ids")).alias("_rare"))


def _with_rare(keys: np.ndarray, starts: np.ndarray, ids: np.ndarray, rare: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The broadcast table with the rare words of some documents, sorted by hash."""
    flat = rare.flatten()
    if not len(flat):
        return keys, starts, ids
    h, first = np.unique(flat.field("hash").to_numpy(zero_copy_only=False), return_index=True)
    lists = flat.field("ids").take(pa.array(first))
    sizes = np.concatenate([np.diff(starts), lists.value_lengths().to_numpy(zero_copy_only=False)])
    begin = np.concatenate([starts[:-1], len(ids) + np.cumsum(sizes[len(keys) :]) - sizes[len(keys) :]])
    every = np.concatenate([keys, h])
    order = np.argsort(every, kind="stable")
    # lists stay where they are: gather them in the new order
    both = np.concatenate([ids, lists.flatten().to_numpy(zero_copy_only=False)])
    sizes, begin = sizes[order], begin[order]
    ends = np.cumsum(sizes)
    return every[order], np.concatenate([[0], ends]), both[np.repeat(begin - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
