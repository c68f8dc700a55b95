"""Pluggable providers of what lies outside: language models, search, labels, paper records.

A provider is data where it can be: recorded answers are a table joined on the
hash of the prompt. Live ones are objects that run inside Arrow functions, one
per task. A failure is a value in the column `error`, never an exception.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from pathwright.functions.text import first_given, split_words
from pathwright.session import spread, written

#: What the message of a failure that may pass says.
TRANSIENT = ("503", "serviceunavailable", "service unavailable", "unavailable", "temporarily", "timeout", "timed out", "rate limit", "ratelimit", "429", "500", "502", "504")
#: What else passes here.
ALSO_TRANSIENT = ("overloaded", "connection")


@dataclass(frozen=True)
class Retry:
    """How often and how long a call is tried again: waits base * 2^n up to most seconds, with some jitter."""

    attempts: int = 5
    base: float = 2.0
    most: float = 60.0
    jitter: float = 0.1
    sleep: Callable[[float], None] = field(default=time.sleep, compare=False)

    def wait(self, n: int) -> float:
        return min(self.most, self.base * 2**n) * (1 + self.jitter * random.random())

    def call(self, f: Callable[[], str]) -> tuple[str | None, str | None]:
        """(answer, error) of f, tried again while its failure may pass."""
        error = "no attempt"
        for n in range(max(1, self.attempts)):
            try:
                return f(), None
            except Exception as e:  # a failure of any kind is data
                error = f"{type(e).__name__}: {e}"
                if not any(t in error.lower() for t in (*TRANSIENT, *ALSO_TRANSIENT)):
                    break
                if n + 1 < self.attempts:
                    self.sleep(self.wait(n))
        return None, error


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def recorded(prompts: DataFrame, responses: DataFrame, stage: str, prompt: str = "prompt") -> DataFrame:
    """prompts with response and error of recorded calls of the stage, the first attempt of each; no recorded call is an error.
    responses: (stage, prompt_sha, attempt, response, error)."""
    r = responses.where(F.col("stage") == stage).groupBy(F.col("prompt_sha").alias("_sha")).agg(F.min_by(F.struct("response", "error"), "attempt").alias("_r"))
    j = prompts.withColumn("_key", prompt_key(F.col(prompt))).join(r, F.col("_key") == F.col("_sha"), "left")
    return j.withColumn("response", F.col("_r.response")).withColumn("error", F.when(F.col("_r").isNull(), F.lit("no recorded response")).otherwise(F.col("_r.error"))).drop("_key", "_sha", "_r")


def completed(prompts: DataFrame, make: Callable[[], Callable[[str], str]], prompt: str = "prompt", retry: Retry = Retry()) -> DataFrame:
    """prompts with response and error of live calls. make() gives a task its client, once; each distinct prompt of a batch is asked once."""
    rest = [c for c in prompts.columns if c != prompt]
    rows = prompts.select(*rest, prompt)
    n = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = make()
        for batch in batches:
            texts = batch.column(n).to_pylist()
            answers = {t: retry.call(lambda t=t: ask(t)) if t is not None else (None, "no prompt") for t in dict.fromkeys(texts)}
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([answers[t][0] for t in texts], pa.string()), pa.array([answers[t][1] for t in texts], pa.string())], names=[*rest, prompt, "response", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", response string, error string"
    return rows.mapInArrow(run, schema)


def repaired(rows: DataFrame, parse: Callable[[Column], Column], first: str, *repairs: str) -> DataFrame:
    """rows with value, repaired and error: the first answer that parses, of the call itself and then of its repairs; an error row if none does."""
    values = [parse(F.col(c)) for c in (first, *repairs)]
    value = F.coalesce(*values)
    return rows.withColumn("value", value).withColumn("repaired", values[0].isNull() & value.isNotNull()).withColumn("error", F.when(value.isNull(), F.lit("no answer parses")))


def search_terms(c: Column) -> Column:
    """The distinct lower-case words of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def lexical_search(queries: DataFrame, corpus: DataFrame, k: int = 20, key: Sequence[str] = ("paper_id", "claim_idx", "mode", "query_idx")) -> DataFrame:
    """(key, query, hit_paper_id, title, year, score, rank): the k titles with the greatest weight of a query's distinct terms, ties by id.

    Every term counts, a common one less: its weight is round(1000 ln(1 + titles / titles with it)), score the matched share of the weights of the
    query's known terms. Queries without a known term have no hits. queries: (key, query); corpus: (hit_paper_id, title, year), ids unique. An index of at most INDEX_POSTINGS postings is broadcast; a larger one is joined, rarest terms first."""
    if (found := lexical_index(corpus)) is not None:
        # hits are shuffled as the places of titles, a row per query, and opened where they are fused
        h = queries.select(*key, "query", _search(found[0], k)(search_terms(F.col("query"))).alias("_h")).select(*key, "query", *(F.col(f"_h.{c}").alias(f"_{c}") for c in ("at", "weights", "all")))
        h = spread(h, *key[:2]).select(*key, "query", "_weights", "_all", F.posexplode("_at").alias("_p", "place")).join(F.broadcast(found[1]), "place")
        return h.select(*key, "query", "hit_paper_id", "title", "year", (F.get("_weights", F.col("_p")) / F.col("_all")).alias("score"), (F.col("_p") + 1).alias("rank"))
    # equal queries, of modes and claims, are searched once
    titles = _searchable(corpus).select("hit_paper_id", "_w")
    q = spread(queries.select("query").distinct(), "query").select("query", search_terms(F.col("query")).alias("_w")).where(F.size("_w") > 0)
    s = _search_joined(q, titles, k).join(corpus.select("hit_paper_id", "title", "year"), "hit_paper_id")
    return queries.select(*key, "query").join(s, "query")


def _searchable(corpus: DataFrame) -> DataFrame:
    return corpus.withColumn("_w", search_terms(F.col("title"))).where("hit_paper_id is not null and size(_w) > 0")


#: Postings of an index that is broadcast: some 12 bytes each, and the words.
INDEX_POSTINGS = 4_000_000
#: A term in more than one of so many titles is also kept as a mark on each title, a byte; of so many bytes at most, the commonest terms.
MARKED, MARKS = 64, 64_000_000


@dataclass(frozen=True)
class Index:
    """An inverted index of titles, its terms from the rarest to the commonest: the places of a term's titles are docs[starts[t]:starts[t + 1]], ascending.
    marks: for the terms from the first common one, a flag for each title. order, named: of each title, its place among the titles in order, the same
    for equal ones, and whether its id says something."""

    terms: pa.Array
    starts: np.ndarray
    docs: np.ndarray
    weights: np.ndarray
    marks: np.ndarray
    order: np.ndarray
    named: np.ndarray

    def search(self, words: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For lists of distinct words: the number of each one's answer; and where the answers start, their places and weights, and the weight of all
        known terms of each. Equal queries are searched once."""
        codes = pc.fill_null(pc.index_in(words.flatten(), value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(words)), pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))
        codes, of = codes[codes >= 0], of[codes >= 0]
        codes, bounds = codes[np.lexsort((codes, of))], np.searchsorted(of, np.arange(len(words) + 1)).tolist()
        # half the width where no weight can exceed it
        score, done, asked = np.zeros(len(self.order), np.int32 if self.weights.sum() < 2**31 else np.int64), {}, []
        each: list[tuple[np.ndarray, np.ndarray, int]] = []
        for a, b in zip(bounds, bounds[1:]):
            known = codes[a:b]
            if (name := known.tobytes()) not in done:
                done[name] = len(each)
                each.append(self.best(known, k, score))
            asked.append(done[name])
        starts = np.concatenate([[0], np.cumsum([len(x[0]) for x in each])]).astype(np.int64)
        places, weights = (np.concatenate([np.empty(0, t), *(x[c] for x in each)]).astype(t) for c, t in ((0, np.int32), (1, np.int64)))
        return np.array(asked, np.int64), starts, places, weights, np.array([x[2] for x in each], np.int64)

    def candidates(self, words: pa.Array, k: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For lists of queries, each a list of distinct words: where each one's candidates start, their places, best ranks and numbers of hits, in the
        order of candidates.fuse, `most` at most."""
        n, m, lengths = len(self.order), len(words), pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
        asked, starts, places, _, _ = self.search(words.flatten(), k)
        # the hits of every list in the order of its queries and of their ranks
        size, begin = np.diff(starts)[asked], starts[:-1][asked]
        rank = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        at, of = places[np.repeat(begin, size) + rank], np.repeat(np.repeat(np.arange(m), lengths), size)
        at, of, rank = (x[self.named[at]] for x in (at, of, rank + 1))
        # a list's hits of one paper come together, the first of them first
        together = np.argsort(of * n + at, kind="stable")
        at, of, rank = at[together], of[together], rank[together]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), (at[1:] != at[:-1]) | (of[1:] != of[:-1])]))
        best = np.minimum.reduceat(rank, first) if len(first) else rank
        hits = np.diff(first, append=len(at))
        at, of, seen = at[first], of[first], together[first]
        by = np.lexsort((seen, self.order[at], best, -(hits * 1_000_000 + (2_000_000 + best) // (2 * best)), of))
        at, of, best, hits = at[by], of[by], best[by], hits[by]
        kept = np.arange(len(of)) - np.searchsorted(of, of) < most
        return np.searchsorted(of[kept], np.arange(m + 1)), at[kept], best[kept], hits[kept]

    def holds(self, t: int, places: np.ndarray) -> np.ndarray:
        """Which of the places have the term."""
        common = t - (len(self.weights) - len(self.marks))
        if common >= 0:
            return self.marks[common][places]
        d = self.docs[self.starts[t] : self.starts[t + 1]]
        return d[np.minimum(d.searchsorted(places), len(d) - 1)] == places

    def best(self, known: np.ndarray, k: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, weights, weight of all terms) of the k best titles for ascending terms, exactly, ties by place. score: zeros, one a title, left so.

        Titles of the rarest terms are weighed, until the k-th of them outweighs all the terms left together: a title with none but those cannot come
        among the best. Of the titles weighed, those that can still reach the k-th are weighed by the terms left, fewer after each."""
        ws, begins, ends = self.weights[known].tolist(), self.starts[known].tolist(), self.starts[known + 1].tolist()
        total = rest = sum(ws)
        # the k-th weighs no more than this
        met, n, i, least, bound, places, found = [], 0, 0, 0, 0, np.empty(0, np.int32), np.empty(0, score.dtype)
        for i, w in enumerate(ws, 1):
            d = self.docs[begins[i - 1] : ends[i - 1]]
            s = score[d]
            score[d] = s + score.dtype.type(w)
            met.append(d[s == 0] if met else d)
            n += len(met[-1])
            rest -= w
            bound += w
            if not rest or n >= k and rest < bound:
                places = np.concatenate(met)
                found = score[places]
                if rest:
                    bound = least = _kth(found, k)
                    if rest < least:
                        break
        score[places] = 0
        for i in range(i, len(ws)):
            keep = found >= least - rest
            places, found = places[keep], found[keep]
            found = found + self.holds(int(known[i]), places) * score.dtype.type(ws[i])
            rest -= ws[i]
            if rest and len(found) > 4 * k:
                least = _kth(found, k)
        if len(found) > k:
            keep = found >= _kth(found, k)
            places, found = places[keep], found[keep]
        order = np.lexsort((places, -found))[:k]
        return places[order], found[order], total


def _kth(x: np.ndarray, k: int) -> int:
    """The k-th greatest of x, which has as many."""
    x = x.copy()
    x.partition(len(x) - k)
    return int(x[len(x) - k])



def lexical_index(corpus: DataFrame) -> tuple[Broadcast[Index], DataFrame] | None:
    """The index of the corpus, broadcast, and its titles with their place in it, by id, to be broadcast too: (place, hit_paper_id, title, year and what
    else the corpus has). None beyond INDEX_POSTINGS. corpus: (hit_paper_id, title, year, ...), ids unique."""
    titles = _searchable(corpus)
    if titles.agg(F.coalesce(F.sum(F.size("_w")), F.lit(0))).first()[0] > INDEX_POSTINGS:
        return None
    rows = titles.orderBy("hit_paper_id").toArrow().combine_chunks()
    n, one = rows.num_rows, lambda c: pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], rows.schema.field(c).type)
    lists = one("_w")
    flat = lists.flatten().dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    counts = np.bincount(codes, minlength=len(flat.dictionary))
    rarest = np.argsort(counts, kind="stable")
    codes, counts = np.argsort(rarest, kind="stable")[codes], counts[rarest]
    starts, docs = np.concatenate([[0], np.cumsum(counts)]), of[np.argsort(codes, kind="stable")]
    common = max(int(np.searchsorted(counts, n / MARKED, side="right")), len(counts) - MARKS // max(1, n))
    marks = np.zeros((len(counts) - common, n), dtype=bool)
    marks[codes[codes >= common] - common, of[codes >= common]] = True
    weights = np.round(1000 * np.log(1 + n / np.maximum(counts, 1))).astype(np.int64)
    order = pc.rank(one("title"), tiebreaker="dense").to_numpy(zero_copy_only=False).astype(np.int32)
    named = pc.not_equal(one("hit_paper_id"), "").to_numpy(zero_copy_only=False)
    index = Index(flat.dictionary.take(pa.array(rarest)), starts, docs, weights, marks, order, named)
    shown = pa.table([pa.array(np.arange(n, dtype=np.int32)), *(one(c) for c in corpus.columns)], names=["place", *corpus.columns])
    return titles.sparkSession.sparkContext.broadcast(index), titles.sparkSession.createDataFrame(shown)


def _search(table: Broadcast[Index], k: int) -> Callable[[Column], Column]:
    """A function of a query's terms: struct(at, weights, all), the places of the best titles, their weights and that of the known terms."""

    @F.arrow_udf("struct<at:array<int>,weights:array<long>,all:long>")
    def search(words: pa.Array) -> pa.Array:
        asked, starts, places, weights, totals = table.value.search(words, k)
        ends = pa.array(starts.astype(np.int32))
        each = pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(weights)), pa.array(totals)], names=["at", "weights", "all"])
        return each.take(pa.array(asked))

    # else Spark would search once more, to leave out queries without hits
    return search.asNondeterministic()


def fused_search(table: Broadcast[Index], k: int, most: int) -> Callable[[Column], Column]:
    """A function of a claim's queries as lists of their terms: struct(at, best, hits), the places of the `most` best candidates as candidates.fuse
    ranks the hits, their best ranks and numbers of hits. Hits are counted and ranked as arrays of numbers, the claims of a batch at once."""

    @F.arrow_udf("struct<at:array<int>,best:array<int>,hits:array<int>>")
    def search(words: pa.Array) -> pa.Array:
        starts, *parts = table.value.candidates(words, k, most)
        ends = pa.array(starts.astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in parts], names=["at", "best", "hits"])

    return search.asNondeterministic()


def _search_joined(q: DataFrame, titles: DataFrame, k: int) -> DataFrame:
    """(query, hit_paper_id, score, rank) by joins: titles that share one of the rarer half of a query's terms are scored; where the k-th of them
    outweighs all the commoner terms together, no other title can come before it. The other queries meet the postings of all their terms."""
    n = titles.count()
    postings = titles.select("hit_paper_id", F.explode("_w").alias("_t"))
    df = postings.groupBy("_t").agg(F.round(1000 * F.log(1 + F.lit(float(n)) / F.count("*"))).cast("long").alias("_x"))
    t = q.select("query", F.explode("_w").alias("_t")).join(df, "_t")
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("_x"), "_t"))).withColumn("_m", F.count("*").over(Window.partitionBy("query")))
    t = written(t)
    told = t.groupBy("query").agg(F.collect_list(F.struct("_t", "_x")).alias("_q"), F.sum("_x").alias("_all"), F.sum(F.when(F.col("_r") > F.ceil(F.col("_m") / 2), F.col("_x")).otherwise(0)).alias("_rest"))
    order = Window.partitionBy("query").orderBy(F.desc("_s"), "hit_paper_id")
    best = lambda s: s.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    pairs = t.where(F.col("_r") <= F.ceil(F.col("_m") / 2)).join(postings, "_t").select("query", "hit_paper_id").distinct()
    weight = F.aggregate(F.filter("_q", lambda x: F.array_contains("_w", x["_t"])), F.lit(0).cast("long"), lambda a, x: a + x["_x"])
    first = written(best(pairs.join(titles, "hit_paper_id").join(told, "query").select("query", "hit_paper_id", "_all", "_rest", weight.alias("_s"))))
    sure = first.where((F.col("rank") == k) & (F.col("_s") > F.col("_rest"))).select("query")
    whole = t.join(sure, "query", "left_anti").join(postings, "_t").groupBy("query", "hit_paper_id").agg(F.sum("_x").alias("_s")).join(told.select("query", "_all"), "query")
    out = first.join(sure, "query", "left_semi").select("query", "hit_paper_id", "_all", "_s", "rank").unionByName(best(whole))
    return out.select("query", "hit_paper_id", (F.col("_s") / F.col("_all")).alias("score"), "rank")


def agent_searches(calls: DataFrame, most: int, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """The searches within an agent's budget: the first `most` calls of each run. calls: (key, call, ...)."""
    w = Window.partitionBy(*key).orderBy("call")
    return calls.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def over_fetch(limit: Column, has_bound: Column) -> Column:
    """How many hits to ask for: five times as many, 100 at most, where a bound of the year will drop some."""
    return F.when(has_bound, F.least(F.lit(100), F.greatest(limit, 5 * limit))).otherwise(limit)


def pages(papers: DataFrame, total: str, limit: int = 1000) -> DataFrame:
    """papers with offset, one row per page of a paged edge list: as many pages as are not empty, one for an unknown total."""
    last = F.greatest(F.lit(0), F.ceil(F.coalesce(F.col(total), F.lit(0)) / limit) - 1)
    return papers.withColumn("offset", F.explode(F.transform(F.sequence(F.lit(0), last), lambda p: p * limit)))


def whole_lists(fetched: DataFrame, key: Sequence[str] = ("paper_id",)) -> DataFrame:
    """(key, edges): the edges of all pages in order; a failed page discards its paper's list. fetched: (key, offset, edges array, error)."""
    g = fetched.groupBy(*key).agg(F.bool_and(F.coalesce("error", F.lit("")) == "").alias("_ok"), F.array_sort(F.collect_list(F.struct("offset", "edges"))).alias("_e"))
    return g.where("_ok").select(*key, F.flatten(F.transform("_e", lambda x: x["edges"])).alias("edges"))


def resolved_papers(ids: DataFrame, notes: DataFrame, by_id: DataFrame, by_title: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """(id, record, resolved_by): the record of each listed paper by the first way that leads to one: a review note's arXiv id, the note's title,
    the id itself, the id as a title; resolved_by is NULL where none does.

    ids: (id, id_type); notes: (id, arxiv_id, title); by_id: (id, record); by_title: (title, record). Finished ids are left out."""
    i = ids if done is None else ids.join(done.select("id").distinct(), "id", "left_anti")
    review = (F.lower("id_type") == "openreview") | (F.lower("id_type").isin("", "unknown") & F.col("id").rlike(r"^[A-Za-z0-9_\-]{8,12}$"))
    i = i.join(notes.select("id", F.col("arxiv_id").alias("_arxiv"), F.col("title").alias("_title")), "id", "left").withColumn("_review", F.coalesce(review, F.lit(False)))
    one = lambda df, c, name: df.groupBy(F.col(c).alias(f"_{name}_k")).agg(F.min("record").alias(f"_{name}"))
    i = i.join(one(by_id, "id", "a"), F.col("_review") & (F.col("_arxiv") == F.col("_a_k")), "left")
    i = i.join(one(by_title, "title", "t"), F.col("_review") & (F.lower("_title") == F.lower("_t_k")), "left")
    i = i.join(one(by_id, "id", "d"), F.col("id") == F.col("_d_k"), "left").join(one(by_title, "title", "s"), F.lower("id") == F.lower("_s_k"), "left")
    way = F.when(F.col("_a").isNotNull(), "note id").when(F.col("_t").isNotNull(), "note title").when(F.col("_d").isNotNull(), "id").when(F.col("_s").isNotNull(), "title")
    return i.select("id", F.coalesce("_a", "_t", "_d", "_s").alias("record"), way.alias("resolved_by"))


def note_fields(content: Column) -> Column:
    """struct(title, arxiv_id) of a review note's content as JSON text: values may be wrapped as {"value": …}; the arXiv id is the first in any of them."""
    value = first_given(F.get_json_object(content, "$.title.value"), F.get_json_object(content, "$.title"))
    near = F.regexp_extract(content, r"(?i)arxiv[^\"]{0,40}?(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    return F.struct(value.alias("title"), F.nullif(first_given(near, F.regexp_extract(content, r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1)), F.lit("")).alias("arxiv_id"))


#: Words that tell the function of a citation, for the offline labeller.
CUES = {
    "Extends": ("extend", "extends", "extended", "extending", "build on", "builds on", "building on", "generalise", "generalize"),
    "Uses": ("use", "uses", "used", "using", "adopt", "adopts", "employ", "employs", "follow", "following", "initialised", "initialized", "baseline"),
    "CompareOrContrast": ("unlike", "contrast", "compare", "compared", "comparison", "whereas", "outperform", "outperforms"),
    "Future": ("future",),
    "Motivation": ("motivated", "motivates", "inspired"),
}


def rule_labels(contexts: DataFrame, text: str = "text") -> DataFrame:
    """contexts with label and confidence by the offline rules: the first function of which a cue stands in the text as a word, 1 / its number
    of cues being no matter; Background at 0.5 without one."""
    low = F.concat(F.lit(" "), F.array_join(split_words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N} ]", " ")), " "), F.lit(" "))
    label = F.lit("Background")
    for name, cues in reversed(list(CUES.items())):
        label = F.when(low.rlike(" (?:" + "|".join(cues) + ") "), F.lit(name)).otherwise(label)
    return contexts.withColumn("label", label).withColumn("confidence", F.when(F.col("label") == "Background", 0.5).otherwise(0.9))


def model_labels(contexts: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], labels: Sequence[str], text: str = "text") -> DataFrame:
    """contexts with label, confidence and confidence_margin of a live classifier, made once a task: make() gives batches of texts their class probabilities."""
    rows = contexts.select(*[c for c in contexts.columns if c != text], text)
    n = len(rows.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = make()
        for batch in batches:
            names, tops, margins = [], [], []
            for p in classify([t or "" for t in batch.column(n).to_pylist()]):
                order = sorted(range(len(p)), key=lambda i: (-p[i], i))
                names.append(labels[order[0]])
                tops.append(float(p[order[0]]))
                margins.append(float(p[order[0]] - (p[order[1]] if len(p) > 1 else 0.0)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(tops, pa.float64()), pa.array(margins, pa.float64())], names=[*rows.columns, "label", "confidence", "confidence_margin"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", label string, confidence double, confidence_margin double"
    return rows.mapInArrow(run, schema)
