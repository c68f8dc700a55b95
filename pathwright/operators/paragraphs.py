"""Contexts and paragraphs: confirmed contexts, best paragraph by token overlap, bibliography entries of the target."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pathwright.functions.latex import cited_keys
from pathwright.functions.text import first_given, match_key, normalised_title, plain_words
from pathwright.session import written


#: Words of paragraphs that are searched at once, and of contexts that meet them: what a paper has beyond these goes in blocks.
BLOCK_WORDS, BLOCK_TEXTS = 2_000_000, 500_000


def best_paragraphs(contexts: DataFrame, paragraphs: DataFrame, key: Sequence[str] = ("citing_paper_id",), least: float = 0.5) -> DataFrame:
    """(key, context_id, p_idx, overlap): the paragraph of the same citing paper with the greatest share of the context's distinct words, the first
    of equals, if that is `least` or more; overlap at three digits. Contexts without words match none.

    contexts: (key, context_id, text); paragraphs: (key, p_idx, paragraph). A paper's contexts and paragraphs meet in blocks, as hashes of their words,
    and are counted there by an inverted index: texts and pairs are never shuffled, only the best of a context in each block."""
    words = lambda c: F.transform(F.array_distinct(plain_words(F.col(c))), lambda w: F.xxhash64(w))
    c = contexts.select(*key, F.col("context_id").alias("_id"), words("text").alias("_w")).where(F.size("_w") > 0)
    p = paragraphs.select(*key, F.col("p_idx").alias("_id"), words("paragraph").alias("_w")).where(F.size("_w") > 0)
    c, p = written(c), written(p.join(c.select(*key).distinct(), list(key), "left_semi"))
    blocks = lambda df, most, name: df.groupBy(*key).agg(F.ceil(F.sum(F.size("_w")) / most).cast("int").alias(name))
    n = blocks(c, BLOCK_TEXTS, "_nc").join(blocks(p, BLOCK_WORDS, "_np"), list(key))
    own = lambda name: F.pmod(F.xxhash64("_id"), F.col(name)).cast("int")
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    c, p = c.join(n, list(key)).select(*key, own("_nc").alias("_bc"), every("_np").alias("_bp"), "_id", "_w"), p.join(n, list(key)).select(*key, every("_nc").alias("_bc"), own("_np").alias("_bp"), "_id", "_w")
    kinds = {f.name: f.dataType.simpleString() for f in (*contexts.schema, *paragraphs.schema)}
    by = [*key, "_bc", "_bp"]
    j = c.groupBy(*by).cogroup(p.groupBy(*by)).applyInArrow(partial(_best_of_block, key=tuple(key), least=least), ", ".join([*(f"`{k}` {kinds[k]}" for k in key), f"context_id {kinds['context_id']}, p_idx {kinds['p_idx']}, _s int, _n int"]))
    best = j.groupBy(*key, "context_id").agg(F.max_by(F.struct("p_idx", "_s", "_n"), F.struct("_s", -F.col("p_idx"))).alias("_b"))
    return best.select(*key, "context_id", "_b.p_idx", F.round(F.col("_b._s") / F.col("_b._n"), 3).alias("overlap"))


def _best_of_block(contexts: pa.Table, paragraphs: pa.Table, key: tuple[str, ...], least: float) -> pa.Table:
    """(key, context_id, p_idx, _s, _n): the best paragraph of each context of a block, the first of equals, with the shared words and the context's."""
    flat = lambda t: t.column("_w").combine_chunks().flatten().to_numpy(zero_copy_only=False) if t.num_rows else np.empty(0, np.int64)
    lengths = lambda t: np.asarray(t.column("_w").combine_chunks().value_lengths()) if t.num_rows else np.empty(0, np.int64)
    paragraphs = paragraphs.sort_by("_id")
    np_, of = paragraphs.num_rows, np.repeat(np.arange(paragraphs.num_rows, dtype=np.int32), lengths(paragraphs))
    v = flat(paragraphs)
    order = np.argsort(v, kind="stable")
    v, docs = v[order], of[order]
    w, n = flat(contexts), lengths(contexts)
    low, high = np.searchsorted(v, w, "left"), np.searchsorted(v, w, "right")
    ends = np.concatenate([[0], np.cumsum(n)])
    who, where, shared = [], [], []
    for i in range(contexts.num_rows if np_ else 0):
        hits = [docs[low[x] : high[x]] for x in range(ends[i], ends[i + 1]) if high[x] > low[x]]
        if not hits or len(hits) / n[i] < least:
            continue
        count = np.bincount(np.concatenate(hits), minlength=np_)
        best = int(count.argmax())
        if count[best] / n[i] >= least:
            who.append(i)
            where.append(best)
            shared.append(int(count[best]))
    at = pa.array(who, pa.int64())
    c = contexts.take(at)
    return pa.table([*(c.column(k) for k in key), c.column("_id"), paragraphs.column("_id").take(pa.array(where, pa.int64())), pa.array(shared, pa.int32()), pa.array(n[who].astype(np.int32) if who else [], pa.int32())], names=[*key, "context_id", "p_idx", "_s", "_n"])


def confirmed_contexts(contexts: DataFrame, confirmed: DataFrame, key: Sequence[str] = ("paper_id", "citing_paper_id")) -> DataFrame:
    """(key, text): of each citing paper, its first context per match key whose key is among the confirmed texts'; the confirmed texts themselves
    where none survives. contexts: (key, id, text); confirmed: (key, text). Papers without confirmed texts give no rows."""
    c = contexts.withColumn("_m", match_key(F.col("text"))).where(F.coalesce("text", F.lit("")) != "")
    f = confirmed.select(*key, "text", match_key(F.col("text")).alias("_m"))
    hit = c.join(f.select(*key, "_m").distinct(), [*key, "_m"], "left_semi").groupBy(*key, "_m").agg(F.min_by("text", "id").alias("text"))
    rest = f.groupBy(*key, "_m").agg(F.min("text").alias("text")).join(hit.select(*key).distinct(), list(key), "left_anti")
    return hit.select(*key, "text").unionByName(rest.select(*key, "text"))


def fallback_sources(papers: DataFrame, first: DataFrame, second: DataFrame, key: Sequence[str] = ("paper_id", "citing_paper_id")) -> DataFrame:
    """(key, texts, source): the texts of the first source, else of the second; papers with neither are left out.
    first and second: (key, texts array)."""
    j = papers.join(first.select(*key, F.col("texts").alias("_a")), list(key), "left").join(second.select(*key, F.col("texts").alias("_b")), list(key), "left")
    texts = F.when(F.size("_a") > 0, F.col("_a")).when(F.size("_b") > 0, F.col("_b"))
    return j.select(*key, F.array_distinct(texts).alias("texts"), F.when(F.size("_a") > 0, "paragraphs").otherwise("usage_contexts").alias("source")).where("texts is not null")


def target_keys(entries: DataFrame, targets: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, bib_key) of the bibliography entries that are the target: its author is named, and the titles contain one another either way or the
    year agrees. entries: (key, bib_key, title, author, year); targets: (key, title, surname, year).

    An entry without a title counts as contained in any title."""
    t = targets.select(*key, normalised_title(F.col("title")).alias("_t"), normalised_title(F.col("surname")).alias("_a"), F.col("year").cast("string").alias("_y"))
    e = entries.select(*key, "bib_key", normalised_title(F.coalesce("title", F.lit(""))).alias("_et"), normalised_title(F.coalesce("author", F.lit(""))).alias("_ea"), F.coalesce("year", F.lit("")).alias("_ey"))
    j = e.join(t, list(key))
    title = (F.col("_t") != "") & (F.contains("_t", "_et") | F.contains("_et", "_t"))
    author = (F.col("_a") != "") & F.contains("_ea", "_a")
    year = (F.coalesce("_y", F.lit("")) != "") & F.contains("_ey", "_y")
    return j.where(author & (title | year)).select(*key, "bib_key").distinct()


def cited_windows(texts: DataFrame, keys: DataFrame, key: Sequence[str] = ("paper_id",), around: int = 350) -> DataFrame:
    """(key, bib_key, window): the text around the first citation command with each wanted key. texts: (key, text); keys: (key, bib_key)."""
    c = texts.select(*key, "text", F.explode(F.array_distinct(cited_keys(F.col("text")))).alias("bib_key"))
    j = c.join(keys.select(*key, "bib_key"), [*key, "bib_key"], "left_semi")
    at = F.regexp_instr("text", F.concat(F.lit(r"\\cite[a-zA-Z]*\*?(?:\[[^\]]*\])*\{[^}]*\Q"), F.col("bib_key"), F.lit(r"\E")))
    start = F.greatest(F.lit(1), at - around)
    return j.select(*key, "bib_key", F.substring("text", start, at - start + around).alias("window"))


def reference_contexts(references: DataFrame, key: Sequence[str] = ("paper_id",), most: int = 60) -> DataFrame:
    """(key, position from 1, ref_id, citation_marker, text, section, intents): the contexts of a paper's references in order, blank ones left out,
    at most so many of a paper. references: (key, ord, ref_id, title, contexts array)."""
    from pathwright.operators.candidates import batches

    c = references.select(*key, "ord", "ref_id", "title", F.posexplode("contexts").alias("_p", "_c"))
    c = c.where(first_given(F.col("_c.text")) != "")
    c = batches(c, key, ["ord", "_p"], most).where(F.col("position") <= most)
    return c.select(*key, "position", "ref_id", F.col("title").alias("citation_marker"), "_c.text", "_c.section", "_c.intents")
