"""Same or near-same records across splits.

Method: similarity-hash bit fingerprints over idf-weighted words. Permuted
blocks of the codes are joined across splits within a Hamming radius, the text
similarity of what is left is verified, and overlaps are reported per split and
source. Every word counts, and weights are flat, so that near copies of one claim have
near codes whether they are two of all claims or a third of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pathwright.functions.hashing import mixed
from pathwright.functions.words import words
from pathwright.llm.features import broadcast_weights, weighted
from pathwright.session import written

#: Code length, the greatest distance of two codes, and the distance up to which the blocks find a share RECALL of the pairs at every size.
BITS, RADIUS, NEAR, RECALL = 128, 38, 22, 0.98
#: Bits of a block at least; beyond 2^(BLOCK + SPARE) classes a block gets a bit for every doubling, so that a code meets a bounded number of strangers in it.
BLOCK, SPARE = 14, 7
#: Words of a claim at least, the share of words two near-same claims have in common, greatest idf.
LEAST_WORDS, SIMILAR, CAP = 5, 0.75, 2.5


def block_plan(classes: int) -> tuple[int, int]:
    """(tables, bits): permuted blocks of so many bits for a number of classes, and how many of them find a share RECALL of the pairs NEAR bits apart."""
    bits = min(BITS // 2, max(BLOCK, math.ceil(math.log2(max(classes, 1))) - SPARE))
    same = math.prod((BITS - NEAR - i) / (BITS - i) for i in range(bits))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - same)), bits


def block_picks(tables: int, bits: int) -> np.ndarray:
    """The places of the code's bits that each block holds."""
    return np.stack([np.random.RandomState(1_000 + t).permutation(BITS)[:bits] for t in range(tables)])


def claims(tasks: DataFrame, reasoning: DataFrame) -> DataFrame:
    """(id, split, source, text) of each distinct ClaimTask and ReasoningClaim; repeated rows (same id) count once."""
    t = tasks.select(F.col("task_id").alias("id"), "split", "source", F.col("claim").alias("text"), F.col("loaded_at").alias("_at"))
    r = reasoning.select(F.col("claim_key").alias("id"), "split", "source", F.col("rewritten_claim").alias("text"), F.col("created_at").alias("_at"))
    both = t.unionByName(r).where("id is not null and text is not null and text <> ''")
    return both.groupBy("id").agg(F.min_by(F.struct("split", "source", "text"), F.struct("_at", "text")).alias("_c")).select("id", "_c.split", "_c.source", "_c.text")


def classes_of(records: DataFrame) -> DataFrame:
    """(id, split, source, copy, bag) of each record of LEAST_WORDS words or more: `copy` is the same for texts with the same words, whatever their
    order, case, marks and markup; bag holds 64 bits of each word and how often it came before, sorted, so that the size of two bags'
    intersection is the number of words both texts have, each as often as both have it."""
    rows = records.select("id", "split", "source", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            keep, copies, bags = [], [], []
            for i, t in enumerate(batch.column(3).to_pylist()):
                ws = words(t)
                if len(ws) < LEAST_WORDS:
                    continue
                keep.append(i)
                ws.sort()
                copies.append(xxhash.xxh3_128_digest(" ".join(ws)))
                bag, last, again = [], None, 0
                for w in ws:
                    h = known.get(w)
                    if h is None:
                        h = known[w] = xxhash.xxh64_intdigest(w)
                    again = again + 1 if w == last else 0
                    last = w
                    bag.append(h ^ again * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                bags.append(np.sort(np.array(bag, dtype=np.uint64).view(np.int64)))
            at = pa.array(keep, pa.int64())
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in bags])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([np.empty(0, np.int64), *bags])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(copies, pa.binary()), flat], names=["id", "split", "source", "copy", "bag"])

    return rows.mapInArrow(run, f"id {kind}, split string, source string, copy binary, bag array<bigint>")


def codes_of(features: np.ndarray, weights: np.ndarray, ends: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, keys) of the similarity hashes of records, given as their features and weights one after the other and the end of each; a feature has
    one weight in all records, and every record has features. keys: one per permuted block."""
    # the signed weights of a feature are made once for all its records
    f, first, at = np.unique(features, return_index=True, return_inverse=True)
    with np.errstate(over="ignore"):
        halves = np.stack([mixed(f.view(np.uint64) + np.uint64(i + 11)) for i in range(BITS // 64)], axis=1)
    table = (np.unpackbits(halves.view(np.uint8), axis=1).astype(np.float32) * 2 - 1) * weights[first, None]
    bits = np.zeros((len(ends), BITS), dtype=bool)
    begin = 0
    for i, end in enumerate(ends):
        bits[i] = table[at[begin:end]].sum(axis=0) > 0
        begin = end
    places = np.zeros((BITS, len(picks)))
    for t, p in enumerate(picks):
        places[p, t] = 2.0 ** np.arange(len(p))
    return bits, (bits @ places).astype(np.int64) + (np.arange(len(picks)) << picks.shape[1])


def coded(rows: DataFrame, features: str, picks: np.ndarray) -> DataFrame:
    """rows (_id, …, features array<bigint>, each distinct) with c0, c1 and keys instead of these: the code by idf-weighted features, and a key per block.
    Features of one record alone are in no code, as no other record can share them; rows of nothing else have none. Weights come from a broadcast of
    the frequencies if these are few enough, else from a join, to the same result but for the order of sums."""
    rest = [c for c in rows.columns if c != features]
    counted = rows.select("_id", F.transform(features, lambda x: F.struct(x.alias("feature"), F.lit(1).alias("times"))).alias("_fs"))
    known = broadcast_weights(counted, "_fs", CAP)
    if known is None:
        rows = rows.select(*rest).join(weighted(counted, "_id", "_fs", CAP, shared_only=True), "_id").select(*rest, "feature", "weight")
    else:
        rows = rows.select(*rest, features)
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4_000):
                part = batch.slice(k, 4_000)
                lists = part.column(n)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                if known is None:
                    weights = part.column(n + 1).flatten().to_numpy(zero_copy_only=False)
                else:
                    every, idf = known.value
                    at = np.minimum(np.searchsorted(every, flat), max(0, len(every) - 1))
                    there = every[at] == flat if len(every) else np.zeros(len(flat), bool)
                    ends = np.concatenate([[0], np.cumsum(there)])[ends]
                    flat, weights = flat[there], idf[at[there]] if len(every) else np.empty(0, np.float32)
                some = np.flatnonzero(np.diff(np.concatenate([[0], ends])))
                bits, keys = codes_of(flat, weights, ends[some], picks)
                halves = np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(-1, BITS // 64)
                sizes = pa.array(np.arange(len(some) + 1, dtype=np.int32) * len(picks))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(pa.array(some)) for c in range(n)), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.ListArray.from_arrays(sizes, pa.array(keys.reshape(-1)))],
                    names=[*rest, "c0", "c1", "keys"],
                )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*rest).schema)
    return rows.mapInArrow(run, f"{kinds}, c0 bigint, c1 bigint, keys array<bigint>")


def similar_classes(copies: DataFrame) -> DataFrame:
    """(eval_copy, train_copy, similarity) of the classes of near-same texts, one with a record of dev or test, the other with
    one of train. copies: (copy, bag, in_eval, in_train), one row per class."""
    # shuffles carry ids of 64 bits; bags are verified under their own key, so that an id of two classes loses nothing of either
    rows = copies.select(F.xxhash64("copy").alias("_id"), "in_eval", "in_train", F.size("bag").alias("_n"), "bag")
    codes = written(coded(rows, "bag", block_picks(*block_plan(copies.count()))))
    e = codes.where("in_eval").select(F.explode("keys").alias("_key"), F.col("_id").alias("_e"), F.col("_n").alias("_en"), F.col("c0").alias("_e0"), F.col("c1").alias("_e1"))
    t = codes.where("in_train").select(F.explode("keys").alias("_key"), F.col("_id").alias("_t"), F.col("_n").alias("_tn"), F.col("c0").alias("_t0"), F.col("c1").alias("_t1"))
    near = F.bit_count(F.col("_e0").bitwiseXOR(F.col("_t0"))) + F.bit_count(F.col("_e1").bitwiseXOR(F.col("_t1"))) <= RADIUS
    # no text has a share SIMILAR of one that is longer by more
    sizes = F.least("_en", "_tn") >= SIMILAR * F.greatest("_en", "_tn")
    pairs = e.join(t, "_key").where((F.col("_e") != F.col("_t")) & sizes & near).select("_e", "_t").distinct()
    bag = copies.select(F.xxhash64("copy").alias("_id"), "copy", "bag")
    pairs = pairs.join(bag.select(F.col("_id").alias("_e"), F.col("copy").alias("eval_copy"), F.col("bag").alias("_eb")), "_e")
    pairs = pairs.join(bag.select(F.col("_id").alias("_t"), F.col("copy").alias("train_copy"), F.col("bag").alias("_tb")), "_t")
    similarity = F.size(F.array_intersect("_eb", "_tb")) / F.greatest(F.size("_eb"), F.size("_tb"))
    return pairs.select("eval_copy", "train_copy", similarity.alias("similarity")).where(F.col("similarity") >= SIMILAR)


def overlaps(records: DataFrame) -> DataFrame:
    """(eval_id, train_id, eval_split, eval_source, train_source, similarity) of each pair of a dev or test record and a train
    record that are the same text or nearly.

    Case, marks, markup and the order of words do not matter for the same text (similarity 1); nearly means that a share SIMILAR of
    the words of the longer one stands in both. records: (id, split, source, text), id unique. Texts that are NULL, empty or of
    fewer than LEAST_WORDS words overlap with none; other splits and NULL are neither side; an empty table gives no rows. The
    search runs over classes of copies, so copies cost nothing until the pairs asked for are written out."""
    r = written(classes_of(records))
    copies = r.groupBy("copy").agg(F.first("bag").alias("bag"), F.max(F.col("split").isin("dev", "test")).alias("in_eval"), F.max(F.col("split") == "train").alias("in_train"))
    copies = written(copies.where("in_eval or in_train").na.fill(False, ["in_eval", "in_train"]))
    same = copies.where("in_eval and in_train").select(F.col("copy").alias("eval_copy"), F.col("copy").alias("train_copy"), F.lit(1.0).alias("similarity"))
    pairs = written(similar_classes(copies).unionByName(same))
    e = r.where(F.col("split").isin("dev", "test")).select(F.col("copy").alias("eval_copy"), F.col("id").alias("eval_id"), F.col("split").alias("eval_split"), F.col("source").alias("eval_source"))
    t = r.where(F.col("split") == "train").select(F.col("copy").alias("train_copy"), F.col("id").alias("train_id"), F.col("source").alias("train_source"))
    return pairs.join(e, "eval_copy").join(t, "train_copy").select("eval_id", "train_id", "eval_split", "eval_source", "train_source", F.round("similarity", 4).alias("similarity"))


def overlap_report(records: DataFrame) -> DataFrame:
    """(eval_split, eval_source, train_source, n_eval, n_train, n_pairs, n_same) of all overlaps."""
    return (
        overlaps(records)
        .groupBy("eval_split", "eval_source", "train_source")
        .agg(F.countDistinct("eval_id").alias("n_eval"), F.countDistinct("train_id").alias("n_train"), F.count("*").alias("n_pairs"), F.count_if(F.col("similarity") == 1).alias("n_same"))
    )
