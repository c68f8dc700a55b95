"""Evaluation texts leaking into training text.

Method: winnowing. The least hash of every window of k-grams is kept as a
fingerprint, those of both sides are joined, and hits are extended to the
shared stretch, from every hit. Every span of GRAM + WINDOW - 1 words that a
document shares with an item is found. Where the items are few enough to be
broadcast, fingerprints, join and extension are one pass over the documents,
without a shuffle; else both sides shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from pathwright.functions.hashing import mixed
from pathwright.functions.words import words

GRAM, WINDOW = 4, 4
#: A leak holds this share of an item's words, in STRETCHES stretches at most of LEAST words each.
SHARE, STRETCHES, LEAST = 0.5, 2, 6
#: Extension goes over so many changed words at once, each at this cost in matched words, and ends where it has lost DROP.
SKIP, COST, DROP = 3, 1.5, 6.0

#: Bounds within which items are broadcast, checked before every run.
ITEM_ROWS, ITEM_CHARS = 100_000, 32_000_000

#: Hits held at a time, or those of one document.
HITS = 2_000_000

_LAST = np.uint64(2**64 - 1)


def winnowed(texts: list[list[int]], gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position, hash) of the fingerprints of texts given as lists of word hashes.

    A text of fewer than `gram` words has none; one of at least `gram` has at least one."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    n = int(lengths.sum())
    none = np.empty(0, dtype=np.int64)
    if n < gram:
        return none, none, np.empty(0, dtype=np.uint64)
    flat = np.fromiter((w for t in texts for w in t), dtype=np.uint64, count=n)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    of = np.repeat(np.arange(len(texts)), lengths)
    left = np.repeat(starts + lengths, lengths) - np.arange(n)  # words from here to the text's end
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(gram):
            h = mixed(h ^ np.concatenate([flat[i:], np.zeros(i, dtype=np.uint64)]) + np.uint64(i + 1))
    h[h == _LAST] -= np.uint64(1)
    h[left < gram] = _LAST
    # the least of each window, the rightmost of equals; windows end with their text
    best, at = h.copy(), np.arange(n)
    for i in range(1, window):
        other = np.concatenate([h[i:], np.full(i, _LAST)])
        other[left <= i] = _LAST
        take = (other <= best) & (other != _LAST)
        best, at = np.where(take, other, best), np.where(take, np.arange(n) + i, at)
    kept = np.unique(at[best != _LAST])
    return of[kept], kept - starts[of[kept]], h[kept]


def fingerprints(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, fingerprint) of each text's winnowed word k-grams."""
    rows = rows.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where("_k is not null and _t is not null and _t <> ''")
    kind = rows.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 1_000):
                part = batch.slice(k, 1_000)
                of, position, h = winnowed(_hashed([words(t) for t in part.column(1).to_pylist()], known))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(of)), pa.array(position, pa.int32()), pa.array(h.view(np.int64))], names=[key, "position", "fingerprint"])

    return rows.mapInArrow(run, f"{key} {kind}, position int, fingerprint bigint")


def stretch(item: list[str], doc: list[str], a: int, b: int) -> tuple[int, int, int, int, int]:
    """(first and end in the item, first and end in the document, matched words) of the stretch both share around
    item[a] = doc[b], over substituted, added and lost words."""

    def go(i: int, j: int, step: int) -> tuple[int, int, int]:
        matched = best = 0
        score = top = 0.0
        end = i, j
        n, m = len(item), len(doc)
        while 0 <= i < n and 0 <= j < m:
            if item[i] == doc[j]:
                matched, score = matched + 1, score + 1
                i, j = i + step, j + step
                if score > top:
                    top, best, end = score, matched, (i, j)
                continue
            for total in range(1, 2 * SKIP + 1):  # the nearest place where two words in a row agree again
                found = None
                for di in range(max(0, total - SKIP), min(SKIP, total) + 1):
                    x, y = i + step * di, j + step * (total - di)
                    if 0 <= x < n and 0 <= y < m and item[x] == doc[y]:
                        u, v = x + step, y + step
                        if not (0 <= u < n and 0 <= v < m) or item[u] == doc[v]:
                            found = x, y, max(di, total - di)
                            if di * 2 == total:
                                break
                if found:
                    break
            if not found:
                break
            i, j, score = found[0], found[1], score - COST * found[2]
            if top - score >= DROP:
                break
        return end[0], end[1], best

    i1, j1, right = go(a, b, 1)
    i0, j0, left = go(a - 1, b - 1, -1)
    return i0 + 1, i1, j0 + 1, j1, left + right


def run_end(item: list[str], doc: list[str], a: int, b: int) -> int:
    """Where in the document the run of equal words around item[a] = doc[b] ends."""
    x, y = a + 1, b + 1
    n, m = len(item), len(doc)
    while x < n and y < m and item[x] == doc[y]:
        x, y = x + 1, y + 1
    return y


def held(item: list[str], doc: list[str], hits: list[tuple[int, int]]) -> float:
    """The share of the item's words that the document holds in its STRETCHES best stretches. Stretches grow from every hit, however short the
    run of equal words around it; hits of one run grow the same stretch."""
    found: list[tuple[int, int, int, int, int]] = []
    runs: dict[int, int] = {}  # diagonal -> where its last run ends
    for a, b in sorted(hits, key=lambda x: x[1]):
        if a >= len(item) or b >= len(doc) or item[a] != doc[b] or runs.get(b - a, 0) > b:
            continue
        runs[b - a] = run_end(item, doc, a, b)
        if any(s[2] <= b < s[3] and s[0] <= a < s[1] for s in found):
            continue
        s = stretch(item, doc, a, b)
        if s[4] >= LEAST:
            found.append(s)
    best = 0.0
    found.sort(key=lambda s: -s[4])
    for k, one in enumerate(found):
        best = max(best, one[4])
        for other in found[k + 1 :] if STRETCHES > 1 else ():
            size = other[1] - other[0]
            new = size - max(0, min(one[1], other[1]) - max(one[0], other[0]))
            best = max(best, one[4] + other[4] * new / size)
    return best / max(1, len(item))


def enough(counts: dict[str, int], size: int, doc: set[str]) -> bool:
    """Whether so many of an item's words stand in a document at all that it can hold SHARE of them: a bound that no stretch exceeds."""
    return sum(n for w, n in counts.items() if w in doc) >= SHARE * size


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of each document that holds at least half of an item's words as running text, in one or two
    stretches; share is the held part of the item's words.

    Case, accents, punctuation, line breaks, markup and citation marks do not matter. Items of fewer than GRAM words, and
    NULL, empty and blank texts, give no row; repeated rows of a document give one row; an empty table on either side gives
    none. The items are broadcast if a count shows that they are within ITEM_ROWS and ITEM_CHARS; else fingerprints and texts
    shuffle, to the same result."""
    t = items.select("item_id", F.col("text").alias("_item")).where("item_id is not null and _item is not null and _item <> ''").dropDuplicates(["item_id"])
    rows, chars = t.agg(F.count("*"), F.coalesce(F.sum(F.length("_item")), F.lit(0))).first()
    text = documents.select("doc_id", F.col("text").alias("_doc")).where("doc_id is not null and _doc is not null and _doc <> ''")
    if rows <= ITEM_ROWS and chars <= ITEM_CHARS:
        found = _by_broadcast(text, t)
    else:
        d = fingerprints(documents, "doc_id", "text")
        i = fingerprints(items, "item_id", "text").select("item_id", F.col("position").alias("_a"), "fingerprint")
        hits = d.join(i, "fingerprint").select("doc_id", "item_id", F.struct("_a", F.col("position").alias("_b")).alias("_h"))
        by_pair = hits.groupBy("doc_id", "item_id").agg(F.collect_set("_h").alias("_hits")).join(t, "item_id").join(text, "doc_id")
        found = by_pair.select("doc_id", "item_id", _share("_item", "_doc", "_hits").alias("share")).where(F.col("share") >= SHARE)
    return found.groupBy("doc_id", "item_id").agg(F.round(F.max("share"), 4).alias("share"))


def _hashed(texts: list[list[str]], known: dict[str, int]) -> list[list[int]]:
    if len(known) > 500_000:
        known.clear()
    for ws in texts:
        for w in ws:
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
    return [list(map(known.__getitem__, ws)) for ws in texts]


def _by_broadcast(text: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, share) of the documents (doc_id, _doc) by a broadcast of the items' fingerprints and words; hits of some million at most are
    held at a time, or those of one document."""
    rows = items.orderBy("item_id").collect()
    each = [words(r["_item"]) for r in rows]
    of, position, h = winnowed(_hashed(each, {}))
    order = np.argsort(h, kind="stable")
    counts = [dict(Counter(ws)) for ws in each]
    table = items.sparkSession.sparkContext.broadcast((h[order], of[order], position[order], each, counts, [r["item_id"] for r in rows]))
    doc_kind, item_kind = text.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(items.schema["item_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints, item_of, item_at, each, counts, ids = table.value
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                docs = [words(t) for t in part.column(1).to_pylist()]
                of, position, h = winnowed(_hashed(docs, known))
                low, high = np.searchsorted(prints, h, "left"), np.searchsorted(prints, h, "right")
                n = high - low
                found: tuple[list, list, list] = ([], [], [])
                ends = np.searchsorted(of, np.arange(len(docs)), "right")
                begin = 0
                while begin < len(of):
                    # as many documents as have some million hits together, one at least
                    last = of[min(len(of) - 1, begin + int(np.searchsorted(np.cumsum(n[begin:]), HITS)))]
                    end = int(ends[last])
                    hit = np.repeat(np.arange(begin, end), n[begin:end])
                    at = np.arange(len(hit)) - np.repeat(np.cumsum(n[begin:end]) - n[begin:end], n[begin:end]) + low[hit]
                    pair = of[hit] * len(each) + item_of[at]
                    by = np.argsort(pair, kind="stable")
                    cuts = np.flatnonzero(np.diff(pair[by])) + 1
                    doc, seen = -1, set()
                    for group in np.split(by, cuts) if len(by) else ():
                        d, i = int(of[hit[group[0]]]), int(item_of[at[group[0]]])
                        if d != doc:
                            doc, seen = d, set(docs[d])
                        if not enough(counts[i], len(each[i]), seen):
                            continue
                        share = held(each[i], docs[d], list(zip(item_at[at[group]].tolist(), position[hit[group]].tolist())))
                        if share >= SHARE:
                            for column, value in zip(found, (d, ids[i], share)):
                                column.append(value)
                    begin = end
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(found[0], pa.int64())), pa.array(found[1], item_type), pa.array(found[2], pa.float64())], names=["doc_id", "item_id", "share"])

    return text.mapInArrow(run, f"doc_id {doc_kind}, item_id {item_kind}, share double")


@F.pandas_udf(T.DoubleType())
def _share(items: pd.Series, docs: pd.Series, hits: pd.Series) -> pd.Series:
    def one(i: list[str], d: list[str], hs) -> float:
        return held(i, d, [(h["_a"], h["_b"]) for h in hs]) if enough(dict(Counter(i)), len(i), set(d)) else 0.0

    return pd.Series([one(words(i), words(d), hs) for i, d, hs in zip(items, docs, hits)], dtype="float64")


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, split, task, n_docs, max_share) of each item that leaked."""
    t = items.select("item_id", "split", "task").dropDuplicates(["item_id"])
    n = leaked(documents, items).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("share").alias("max_share"))
    return n.join(t, "item_id").select("item_id", "split", "task", "n_docs", "max_share")
