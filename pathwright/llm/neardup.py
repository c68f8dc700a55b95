"""Near-duplicate records with small edits.

Method: improved consistent weighted sampling over TF-IDF shingles. Samples are
banded, candidates that share a band are verified by weighted Jaccard
similarity, and an exact check of the texts follows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from pathwright.functions.hashing import mixed, seeded
from pathwright.functions.words import words
from pathwright.llm.features import weighted
from pathwright.session import written

#: Words of a shingle; bands and samples in each; weighted Jaccard similarity of all shingles that candidates reach.
SHINGLE, BANDS, ROWS, JACCARD = 5, 32, 3, 0.4
#: Two texts say the same from this share of common words on; two records are near-duplicates if this share of their texts does.
SAME_TEXT, SAME_SHARE = 0.6, 0.75


def package_texts(packages: DataFrame) -> DataFrame:
    """(id, at, texts) of each package row: the texts of its citation contexts and the claims of its cluster evidence; `at` tells repeated rows of an
    id apart."""
    texts = F.concat(
        F.coalesce(F.transform("citation_contexts", lambda x: x["text"]), F.array().cast("array<string>")),
        F.coalesce(F.transform("downstream_cluster_evidence", lambda x: x["representative_claim"]), F.array().cast("array<string>")),
    )
    return packages.select(F.col("package_id").alias("id"), F.col("built_at").cast("string").alias("at"), texts.alias("texts")).where("id is not null")


def normalised(records: DataFrame) -> DataFrame:
    """(id, at, copy, texts) of each record with words: its texts in word form, sorted, and `copy`, the same for records with the same texts in any order."""
    at = F.col("at") if "at" in records.columns else F.lit(None).cast("string")
    rows = records.select("id", at.alias("at"), "texts")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, copies, forms = [], [], []
            for i, ts in enumerate(batch.column(2).to_pylist()):
                joined = sorted(" ".join(w) for w in (words(t) for t in ts or ()) if w)
                if joined:
                    kept.append(i)
                    copies.append(xxhash.xxh3_128_digest("\n".join(joined)))
                    forms.append(joined)
            k = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(k), batch.column(1).take(k), pa.array(copies, pa.binary()), pa.array(forms, pa.list_(pa.string()))], names=["id", "at", "copy", "texts"])

    return rows.mapInArrow(run, f"id {kind}, at string, copy binary, texts array<string>")


def shingles(texts: list[list[str]], known: dict[str, int]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The distinct shingles of each record's texts, hashed, and how often each stands in the record. A shingle is SHINGLE words in a row, or a whole
    text of fewer. known keeps the hashes of words between calls."""
    flat: list[int] = []
    ends = [0]  # of texts
    records = [0]  # texts before each record
    short: list[tuple[int, int]] = []
    for ts in texts:
        for t in ts:
            ws = t.split(" ")
            for w in ws:
                h = known.get(w)
                if h is None:
                    h = known[w] = xxhash.xxh64_intdigest(w)
                flat.append(h)
            if len(ws) < SHINGLE:
                short.append((ends[-1], xxhash.xxh64_intdigest(t)))
            ends.append(len(flat))
        records.append(len(ends) - 1)
    n = len(flat)
    if not n:
        return [np.empty(0, dtype=np.int64) for _ in texts], [np.empty(0, dtype=np.int32) for _ in texts]
    words_, e = np.array(flat, dtype=np.uint64), np.array(ends)
    left = np.repeat(e[1:], np.diff(e)) - np.arange(n)  # words from here to the text's end
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(SHINGLE):
            h = mixed(h ^ np.concatenate([words_[i:], np.zeros(min(i, n), dtype=np.uint64)])[:n] + np.uint64(i + 1))
    whole = left >= SHINGLE
    for at, x in short:
        h[at], whole[at] = x, True
    found, times = [], []
    for a, b in zip(e[records[:-1]], e[records[1:]]):
        f, k = np.unique(h[a:b][whole[a:b]], return_counts=True)
        found.append(f.view(np.int64))
        times.append(k.astype(np.int32))
    return found, times


def shingled(classes: DataFrame) -> DataFrame:
    """(_id, features) of classes (_id, texts): the distinct shingles of their texts and how often each stands there. Lists are built a few hundred
    classes at a time, as flat arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                if len(known) > 500_000:
                    known.clear()
                found, times = shingles(part.column(1).to_pylist(), known)
                sizes = np.concatenate([[0], np.cumsum([len(f) for f in found])])
                pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(times))], names=["feature", "times"])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)], names=["_id", "features"])

    return classes.select("_id", "texts").mapInArrow(run, "_id bigint, features array<struct<feature: bigint, times: int>>")


_DRAWS: list[np.ndarray] = []


def _draws() -> list[np.ndarray]:
    """Seeds of the samples, and the 65,536 quantiles of the gamma distribution of shape 2 with their logarithms: what consistent weighted sampling
    draws, at two bytes a draw."""
    if not _DRAWS:
        x = np.concatenate([[0.0], np.logspace(-5, 2, 200_000)])
        q = np.interp((np.arange(65_536) + 0.5) / 65_536, -np.expm1(-x) - x * np.exp(-x), x)
        s = seeded(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64), 1)
        _DRAWS.extend(((s & np.uint64(0xFFFFFFFF)).astype(np.uint32)[:, None], q.astype(np.float32), np.log(q).astype(np.float32)))
    return _DRAWS


def _mixed32(x: np.ndarray) -> np.ndarray:
    """A 32-bit finaliser, in place."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> np.uint32(shift)
        x *= np.uint32(factor)
    x ^= x >> np.uint32(16)
    return x


def samples(features: np.ndarray, weights: np.ndarray, part: int = 4_096) -> np.ndarray:
    """BANDS * ROWS consistent samples of a record's weighted features: of each the shingle and the step of its weight that comes first in a random
    order in which a shingle's chance is its weight, as 64 bits. Long records are sampled in parts."""
    seeds, r_of, lnc_of = _draws()
    n = len(seeds)
    best, chosen, step = np.full(n, np.inf, np.float32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    rows = np.arange(n)
    for k in range(0, len(features), part):
        f = features[k : k + part].view(np.uint64)
        logs = np.log(weights[k : k + part]).astype(np.float32)
        with np.errstate(over="ignore"):
            h = _mixed32((f & np.uint64(0xFFFFFFFF)).astype(np.uint32)[None, :] ^ seeds)
            b = _mixed32(h + (f >> np.uint64(32)).astype(np.uint32)[None, :])
        r, lnc = r_of[h & np.uint32(0xFFFF)], lnc_of[h >> np.uint32(16)]
        beta = b.astype(np.float32) * np.float32(2.0**-32)
        t = np.floor(logs / r + beta)
        order = lnc - r * (t - beta + 1)
        at = order.argmin(axis=1)
        least = order[rows, at]
        better = least < best
        best[better] = least[better]
        chosen[better] = features[k + at[better]]
        step[better] = t[rows, at][better].astype(np.int64)
    return mixed(chosen.view(np.uint64) ^ mixed(step.view(np.uint64) + np.uint64(1)))


@F.pandas_udf(T.ArrayType(T.LongType()))
def band_keys(features: pd.Series, weights: pd.Series) -> pd.Series:
    """One key per band of a record's weighted features: a hash of ROWS consistent samples."""
    out = []
    with np.errstate(over="ignore"):
        for f, w in zip(features, weights):
            s = samples(np.asarray(f, dtype=np.int64), np.asarray(w, dtype=np.float32)).reshape(BANDS, ROWS)
            key = np.arange(1, BANDS + 1, dtype=np.uint64)
            for i in range(ROWS):
                key = mixed(key + s[:, i])
            out.append(key.view(np.int64))
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.DoubleType())
def weighted_jaccard(fa: pd.Series, wa: pd.Series, fb: pd.Series, wb: pd.Series) -> pd.Series:
    """The weighted Jaccard similarity of two lists of features with weights."""
    out = []
    for a, x, b, y in zip(fa, wa, fb, wb):
        _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        shared = np.minimum(np.asarray(x)[i], np.asarray(y)[j]).sum(dtype=np.float64)
        whole = np.sum(x, dtype=np.float64) + np.sum(y, dtype=np.float64) - shared
        out.append(shared / whole if whole else 0.0)
    return pd.Series(out, dtype="float64")


def _texts_shared(a: list[str], b: list[str]) -> float:
    """The share of two records' texts that both have, letter for letter or with few words changed, a shared one counted once."""
    rest = Counter(b)
    left = []
    for t in a:
        if rest[t]:
            rest[t] -= 1
        else:
            left.append(t)
    shared = len(a) - len(left)
    others = [Counter(t.split(" ")) for t in rest.elements()]
    sizes = [sum(c.values()) for c in others]
    free = set(range(len(others)))
    for t in left:
        c = Counter(t.split(" "))
        n = sum(c.values())
        best, at = 0.0, -1
        for k in free:
            if min(n, sizes[k]) < SAME_TEXT * max(n, sizes[k]):
                continue
            s = sum((c & others[k]).values()) / max(n, sizes[k])
            if s > best:
                best, at = s, k
        if best >= SAME_TEXT:
            free.discard(at)
            shared += 1
    return shared / max(1, len(a) + len(b) - shared)


@F.pandas_udf(T.DoubleType())
def texts_shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """_texts_shared() of two columns of lists of texts."""
    return pd.Series([_texts_shared(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def class_pairs(classes: DataFrame) -> DataFrame:
    """(copy_a, copy_b, jaccard, shared) of near-duplicate classes, copy_a < copy_b. classes: (copy, texts), one row per class."""
    # shuffles carry ids of 64 bits; texts are verified under their own key, so that an id of two classes loses nothing of either
    ids = classes.select(F.xxhash64("copy").alias("_id"), "copy", "texts")
    # shingles are made twice, for the counts and for the join: that is cheaper than to write many times the text
    w = weighted(shingled(ids), "_id", "features", total=ids.count())
    w = written(w.select("_id", "feature", "weight", band_keys("feature", "weight").alias("_keys")))
    keys = w.select("_id", F.explode("_keys").alias("_key"))
    pairs = keys.alias("a").join(keys.alias("b"), F.expr("a._key = b._key and a._id < b._id")).select(F.col("a._id").alias("_a"), F.col("b._id").alias("_b")).distinct()
    side = lambda x: w.select(F.col("_id").alias(f"_{x}"), F.col("feature").alias(f"_f{x}"), F.col("weight").alias(f"_w{x}"))
    near = pairs.join(side("a"), "_a").join(side("b"), "_b").select("_a", "_b", weighted_jaccard("_fa", "_wa", "_fb", "_wb").alias("jaccard")).where(F.col("jaccard") >= JACCARD)
    text = lambda x: ids.select(F.col("_id").alias(f"_{x}"), F.col("copy").alias(f"_c{x}"), F.col("texts").alias(f"_t{x}"))
    j = near.join(text("a"), "_a").join(text("b"), "_b").select(F.least("_ca", "_cb").alias("copy_a"), F.greatest("_ca", "_cb").alias("copy_b"), "jaccard", texts_shared("_ta", "_tb").alias("shared"))
    return j.where(F.col("shared") >= SAME_SHARE)


def _prepared(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, copy) of every record with words, and the class pairs. Texts are shuffled once, by class."""
    n = written(normalised(records))
    classes = written(n.groupBy("copy").agg(F.min("texts").alias("texts")))
    members = n.groupBy("id").agg(F.min_by("copy", F.struct("at", "copy")).alias("copy"))
    return members, class_pairs(classes)


def near_duplicates(records: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """(id_a, id_b, shared) of each pair of records of which a share SAME_SHARE of the texts stands in both, id_a < id_b.

    records: (id, texts array<string>) and, where an id may come again, at: of repeated rows the first by `at` counts. The order of texts, case, marks and markup do not matter; records with the same
    texts share 1. Records whose texts are all NULL, empty or without words pair with none; an empty table gives no rows. The search
    runs over classes of copies; pairs of copies are written out only at the end."""
    members, pairs = _prepared(records)
    one = lambda x, name: members.select(F.col("copy").alias(f"copy_{x}"), F.col("id").alias(name))
    across = pairs.join(one("a", "_x"), "copy_a").join(one("b", "_y"), "copy_b").select(F.least("_x", "_y").alias(a), F.greatest("_x", "_y").alias(b), F.round("shared", 4).alias("shared"))
    within = members.alias("m").join(members.alias("n"), F.expr("m.copy = n.copy and m.id < n.id")).select(F.col("m.id").alias(a), F.col("n.id").alias(b), F.lit(1.0).alias("shared"))
    return across.unionByName(within)


def duplicate_classes(records: DataFrame) -> DataFrame:
    """(id, class_id, n_copies, n_links) of every record with words: class_id is the least id of the records with the same texts, n_copies
    their number, n_links the number of other classes that are near-duplicates. Copies are not expanded into pairs."""
    members, pairs = _prepared(records)
    size = members.groupBy("copy").agg(F.min("id").alias("class_id"), F.count("*").alias("n_copies"))
    ends = pairs.select(F.explode(F.array("copy_a", "copy_b")).alias("copy")).groupBy("copy").agg(F.count("*").alias("n_links"))
    return members.join(size, "copy").join(ends, "copy", "left").select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
