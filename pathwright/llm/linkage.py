"""Matching entities across sources without keys.

Method: label-model linkage. Heuristic functions vote on each candidate pair; a
generative model learns their accuracies and correlations from all candidates
and gives each pair a posterior confidence.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from pathwright.functions.bibliographic import surnames, title_key
from pathwright.functions.hashing import mixed, seeded
from pathwright.llm.labelmodel import LabelModel
from pathwright.session import spread, written

#: Bands and rows of the minimum hashes of title words; confidence of a match.
BANDS, ROWS, CONFIDENT = 44, 6, 0.5
#: Candidates are voted on from this share of telling words in common on: of the longer title, or of the shorter one where that is cut;
#: with an author in common, always.
SHARED, SHARED_CUT = 0.6, 0.5
#: Edit distances from here on count alike.
FAR = 40
#: Words and characters beyond which a text in place of a title is compared as a whole, without regard to typing errors.
LONG, LONG_CHARS = 100, 1_000

# Words that carry little of a title, and words that name a version of the same paper.
STOP = "a an and are as at by can do does for from how in into is it its of on or over that the their through to towards toward under us use using via we what when with without".split()
VERSION = "preprint technical report extended version poster draft abstract accepted manuscript arxiv camera ready full paper short journal conference supplementary working".split()


def listed_papers(inputs: DataFrame) -> DataFrame:
    """(input_id, title, cut, names, year) of each distinct listed paper: the first of repeated rows."""
    i = inputs.where("input_id is not null").groupBy("input_id").agg(F.min_by(F.struct("title", "authors", "year"), F.struct("added_at", "title")).alias("_i"))
    return i.select(
        "input_id",
        title_key(F.col("_i.title")).alias("title"),
        F.coalesce(F.col("_i.title").rlike(r"(?:…|\.\.\.)|\p{L}\.\s"), F.lit(False)).alias("cut"),
        F.when(F.col("_i.title").rlike(r"(?:…|\.\.\.)"), title_key(F.regexp_extract(F.col("_i.title"), r"\(([^()]+)\)\s*$", 1))).otherwise(_head(F.col("_i.title"))).alias("head"),
        surnames(F.col("_i.authors")).alias("names"),
        F.col("_i.year").cast("int").alias("year"),
    )


def _head(title: Column) -> Column:
    """The name a title begins with, before a colon or dash, or ends with, in brackets; NULL if there is none."""
    t = F.regexp_replace(title, r"[{}​-‏]", "")
    front = F.regexp_extract(t, r"^\s*([^\s:]+(?:\s[^\s:]+)?)(?::\s| [-–—] )", 1)
    back = F.regexp_extract(t, r"\(([^\s()]+(?:-\d+)?)\)\s*$", 1)
    back = F.when(~F.lower(back).isin(*VERSION), back)
    return F.coalesce(title_key(F.nullif(front, F.lit(""))), title_key(F.nullif(back, F.lit(""))))


def target_papers(tasks: DataFrame) -> DataFrame:
    """(target_paper_id, title, head, names, year) of each key of target_titles with a title somewhere: its commonest title and year,
    and its commonest longest author list among the groundings that name it."""
    titles = tasks.select(F.explode(F.coalesce("target_titles", F.create_map().cast("map<string,string>"))).alias("_k", "_v")).where("_v is not null and _k is not null and _k <> ''")
    titles = titles.groupBy("_k", "_v").agg(F.count("*").alias("_n")).withColumn("_t", title_key("_v"))
    titles = titles.where("_t is not null").groupBy("_k", "_t").agg(F.sum("_n").alias("_n"), F.max_by("_v", F.struct("_n", "_v")).alias("_v"))
    titles = titles.groupBy("_k").agg(F.max_by(F.struct("_t", "_v"), F.struct("_n", "_t")).alias("_x"))
    pick = lambda g: F.struct(g["paper_id"].alias("k"), g["ref_year"].alias("y"), g["ref_authors"].alias("a"))
    gold = tasks.select(F.explode("gold_ingredients").alias("_i"))
    g = gold.select(F.explode(F.concat(F.array(pick(F.col("_i.canonical_grounding"))), F.coalesce(F.transform("_i.additional_groundings", pick), F.array().cast("array<struct<k:string,y:string,a:string>>")))).alias("_g"))
    g = g.select("_g.*").where("k is not null and k <> ''").groupBy("k", "y", "a").agg(F.count("*").alias("_n"))
    years = g.withColumn("_y", F.regexp_extract("y", r"\b(1[89]\d\d|20\d\d)\b", 1).try_cast("int")).where("_y is not null").groupBy("k", "_y").agg(F.sum("_n").alias("_n"))
    years = years.groupBy("k").agg(F.max_by("_y", F.struct("_n", "_y")).alias("year"))
    names = g.where("a is not null").withColumn("_a", surnames(F.col("a"))).where(F.size("_a") > 0).groupBy("k", "_a").agg(F.sum("_n").alias("_n"))
    names = names.groupBy("k").agg(F.max_by("_a", F.struct(F.size("_a"), "_n", "_a")).alias("names"))
    none = F.array().cast("array<string>")
    t = titles.join(years.withColumnRenamed("k", "_k"), "_k", "left").join(names.withColumnRenamed("k", "_k"), "_k", "left")
    return t.select(F.col("_k").alias("target_paper_id"), F.col("_x._t").alias("title"), _head(F.col("_x._v")).alias("head"), F.coalesce("names", none).alias("names"), "year")


@F.pandas_udf(T.ArrayType(T.LongType()))
def minhash_keys(features: pd.Series) -> pd.Series:
    """One key per band of the minimum hashes of a set of features; none for an empty set."""
    fs = [f if f is not None else () for f in features]
    full = [i for i, f in enumerate(fs) if len(f)]
    out: list = [[] for _ in fs]
    if full:
        lengths = np.array([len(fs[i]) for i in full])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        flat = np.concatenate([np.asarray(fs[i]) for i in full]).astype(np.int64).view(np.uint64)
        keys = np.zeros((len(full), BANDS), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for s in range(BANDS * ROWS):
                keys[:, s // ROWS] = mixed(keys[:, s // ROWS] + np.minimum.reduceat(seeded(flat, s + 1), starts))
            keys = mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)
        for row, i in enumerate(full):
            out[i] = keys[row]
    return pd.Series(out)


def _content(title: str) -> Column:
    return F.array_distinct(F.filter(F.split(title, " "), lambda w: ~w.isin(*STOP, *VERSION) & (w != "")))


def band_keys(papers: DataFrame, key: str) -> DataFrame:
    """(key, keys): one row per paper, the bands of its title words."""
    return papers.select(key, minhash_keys(F.transform(_content("title"), lambda w: F.xxhash64(w))).alias("_keys"))


def wide_blocks(papers: DataFrame, key: str) -> DataFrame:
    """(key, block, words, authors, cut): the name in the title, and the first three telling words. Many papers that have nothing else in common share
    these, so the rows hold, as hashes, what a pair is judged by where it forms."""
    p = papers.select(key, "title", "head", "names", F.col("cut") if "cut" in papers.columns else F.lit(False).alias("cut"), _content("title").alias("_c"))
    keys = F.array(F.when(F.col("head").isNotNull(), F.xxhash64(F.lit("head"), "head")), F.when(F.size("_c") >= 3, F.xxhash64(F.lit("start"), F.array_join(F.slice("_c", 1, 3), " "))))
    hashed = lambda c: F.transform(c, lambda w: F.xxhash64(w))
    return p.select(key, hashed(F.col("_c")).alias("_w"), hashed(F.coalesce("names", F.array().cast("array<string>"))).alias("_a"), "cut", F.explode(F.filter(keys, lambda x: x.isNotNull())).alias("_block"))


def worth(words: Column, words_b: Column, names: Column, names_b: Column, cut: Column) -> Column:
    """Whether a pair is voted on: by the share of telling words in common, or an author in common, or because a title has few such words."""
    shared, of_both = F.size(F.array_intersect(words, words_b)), (F.size(words), F.size(words_b))
    return F.arrays_overlap(names, names_b) | (F.least(*of_both) < 3) | (shared >= SHARED * F.greatest(*of_both)) | cut & (shared >= SHARED_CUT * F.least(*of_both))


def author_keys(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """(input_id, target_paper_id) of the pairs with one first author that share one of the rarer words of the listed title.

    A pair gets no vote of its titles unless half of the listed title's words stand in the target's, so that one of any half and one more does: the
    rarest are taken, and a common surname makes no block of its own, whatever share of the papers has it."""
    told = lambda df, key: df.where((F.size("names") > 0) & F.col("title").isNotNull()).select(key, F.get("names", F.lit(0)).alias("_a"), _content("title").alias("_c"))
    t = told(targets, "target_paper_id").select("target_paper_id", "_a", F.explode("_c").alias("_w"))
    df = t.groupBy("_w").agg(F.count("*").alias("_df"))
    i = told(inputs, "input_id").select("input_id", "_a", F.size("_c").alias("_n"), F.explode("_c").alias("_w")).join(df, "_w", "left")
    rarest = Window.partitionBy("input_id").orderBy(F.coalesce("_df", F.lit(0)), "_w")
    i = i.withColumn("_r", F.row_number().over(rarest)).where(F.col("_r") <= F.floor(F.col("_n") / 2) + 1)
    return i.where("_df is not null").join(t, ["_a", "_w"]).select("input_id", "target_paper_id")


def cut_keys(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """(input_id, target_paper_id) of the pairs of a listed title that is cut, abbreviated or has fewer than three telling words, and a target with the
    same first author, the same beginning of the first word, and a year beside its own; a missing year agrees with any. What is left of such titles tells no more: of one author
    with a share of all papers their pairs grow with the square of the rows, by years."""
    first = F.substring(F.split_part("title", F.lit(" "), F.lit(1)), 1, 3)
    keys = lambda years: F.explode(F.transform(years, lambda y: F.xxhash64(F.get("names", F.lit(0)), first, y))).alias("_k")
    told = lambda df: df.where((F.size("names") > 0) & F.col("title").isNotNull())
    none, every = F.lit(-1), F.lit(-2)
    i = told(inputs).where(F.col("cut") | (F.size(_content("title")) < 3))
    i = i.select("input_id", keys(F.when(F.col("year").isNull(), F.array(every)).otherwise(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1, none))))
    t = told(targets).select("target_paper_id", keys(F.array(F.coalesce("year", none), every)))
    return i.join(t, "_k").select("input_id", "target_paper_id")


def candidates(inputs: DataFrame, targets: DataFrame, bands: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(input_id, target_paper_id) of the pairs that share a band, or one of the wide blocks and are worth a vote, or a first author and a rarer word, or,
    for what is left of a cut title, a first author, a beginning and a year. They lie by input_id. bands: the band_keys of both sides if they are at hand."""
    titled = inputs.where("title is not null")
    i, t = bands or (band_keys(titled, "input_id"), band_keys(targets, "target_paper_id"))
    pairs = i.select("input_id", F.explode("_keys").alias("_block")).join(t.select("target_paper_id", F.explode("_keys").alias("_block")), "_block").select("input_id", "target_paper_id")
    a, b = wide_blocks(titled, "input_id"), wide_blocks(targets, "target_paper_id").select("target_paper_id", "_block", F.col("_w").alias("_w_b"), F.col("_a").alias("_a_b"))
    wide = a.join(b, "_block").where(worth(F.col("_w"), F.col("_w_b"), F.col("_a"), F.col("_a_b"), F.col("cut"))).select("input_id", "target_paper_id")
    return spread(pairs.unionByName(wide).unionByName(author_keys(inputs, targets)).unionByName(cut_keys(inputs, targets)), "input_id").distinct()


def slices(i: DataFrame, t: DataFrame) -> int:
    """Into how many slices the listed papers go, so that the pairs that equal bands make in one, each as often as it shares a band, are about as many as
    the rows of the bands: what lies on disk at a time then grows with the papers, however many pairs they make. Counted on an eighth of the bands."""
    rows = sum(k.agg(F.coalesce(F.sum(F.size("_keys")), F.lit(0))).first()[0] for k in (i, t))
    some = lambda k, n: k.select(F.explode(F.filter("_keys", lambda x: x.bitwiseAND(7) == 0)).alias("_k")).groupBy("_k").agg(F.count("*").alias(n))
    pairs = 8 * some(i, "_n").join(some(t, "_m"), "_k").agg(F.coalesce(F.sum(F.col("_n") * F.col("_m")), F.lit(0))).first()[0]
    return max(1, -(-pairs // max(rows, 1)))


_STOP, _VERSION = frozenset(STOP), frozenset(VERSION)


def close(a: str, b: str) -> bool:
    """Whether two words are one but for a typing error: a letter changed, added or lost, or two swapped."""
    n = max(len(a), len(b))
    if n - min(len(a), len(b)) > 2:
        return False
    p = 0
    while p < len(a) and p < len(b) and a[p] == b[p]:
        p += 1
    s = 0
    while s < min(len(a), len(b)) - p and a[-1 - s] == b[-1 - s]:
        s += 1
    return p + s >= n - (2 if n > 4 else 1)


def title_votes(a: str, b: str, cut: bool) -> tuple[int, int]:
    """(agreement 0..4, extra 0..2) of a listed and a target title in word form.

    agreement: 4 all words of both, 3 nearly all, 2 all words of a cut title, 1 half of the words, 0 less. extra: what the listed
    title says beyond the target's: 0 nothing, 1 the name of a version, 2 something else. Titles of more than LONG words are compared
    without regard to typing errors."""
    x, y = a.split(" "), b.split(" ")
    free: dict[str, int] = {}
    for w in y:
        free[w] = free.get(w, 0) + 1
    missed, got, whole = [], 0.0, 0.0
    weight = lambda w: 0.25 if w in _STOP or len(w) < 2 else 1.0
    for w in x:
        if free.get(w):
            free[w] -= 1
            got += weight(w)
        else:
            missed.append(w)
    extra, mine = 0, 0.0
    for k, w in enumerate(missed):
        hit = None if len(x) > LONG or len(y) > LONG else next((v for v, n in free.items() if n and (close(w, v) or cut and len(w) > 1 and v.startswith(w))), None)
        if hit is not None:
            free[hit] -= 1
            got += weight(hit)
        elif w in _VERSION:
            extra = max(extra, 1)
        else:
            mine += weight(w)
            if weight(w) == 1:
                extra = 2
    theirs = sum(weight(v) * n for v, n in free.items())
    whole = got + theirs
    of_a, of_b = got / max(got + mine, 1e-9), got / max(whole, 1e-9)
    if min(of_a, of_b) >= 0.93:
        return 4, extra
    if min(of_a, of_b) >= 0.75:
        return 3, extra
    if cut and of_a >= 0.9:
        return 2, extra
    return (1 if min(of_a, of_b) >= 0.5 else 0), extra


def author_votes(a: list[str], b: list[str]) -> tuple[int, int]:
    """(first, rest): whether the first authors agree, and how many of the shorter list stand in the longer one; each 0 missing,
    1 no, 2 in part or nearly, 3 yes."""
    if not len(a) or not len(b):
        return 0, 0
    first = 3 if a[0] == b[0] else 2 if close(a[0], b[0]) or any(close(a[0], z) for z in b) else 1
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = sum(any(s == z or close(s, z) for z in long) for s in short)
    return first, 3 if n == len(short) else 2 if n else 1


VOTERS = ("title", "extra", "letters", "head", "first", "authors", "year")
_VOTES = T.StructType([T.StructField(v, T.IntegerType()) for v in (*VOTERS, "distance")])


@F.pandas_udf(_VOTES)
def votes(title: pd.Series, cut: pd.Series, head: pd.Series, names: pd.Series, year: pd.Series, title_b: pd.Series, head_b: pd.Series, names_b: pd.Series, year_b: pd.Series, distance: pd.Series) -> pd.DataFrame:
    """The votes of all heuristics on candidate pairs, and the distance as it came."""
    rows = []
    for a, c, h, n, y, b, hb, nb, yb, d in zip(title, cut, head, names, year, title_b, head_b, names_b, year_b, distance):
        t, extra = title_votes(a, b, bool(c))
        d = FAR if d < 0 else d
        near = d / max(len(a), len(b), 1)
        letters = 3 if near <= 0.03 else 2 if near <= 0.12 else 1 if near <= 0.3 else 0
        heads = 0 if not isinstance(h, str) or not isinstance(hb, str) else 2 if h == hb or close(h, hb) else 1
        first, rest = author_votes(list(n), list(nb))
        gap = None if pd.isna(y) or pd.isna(yb) else abs(int(y) - int(yb))
        rows.append((t, extra, letters, heads, first, rest, 0 if gap is None else 3 if gap == 0 else 2 if gap == 1 else 1, d))
    return pd.DataFrame(rows, columns=[*VOTERS, "distance"]).astype("int32")


def first_guess(v: np.ndarray) -> np.ndarray:
    """Where expectation maximisation starts: titles that agree and nothing that speaks against it."""
    t, extra, _, head, first, rest, year = v.T
    good = (t >= 2) & (extra < 2) & (head != 1) & (first != 1) & (rest != 1) & (year != 1)
    return np.where(good, 0.95, np.where((t >= 3) & (first >= 2) & (year >= 2), 0.6, 0.03))


def never_same(v: np.ndarray) -> np.ndarray:
    """Patterns that anchor the other class: other people in another year or under a title of another wording, and a title that says
    something else, agrees in half its words at most and has no author in common to make up for it."""
    title, extra, _, _, first, rest, year = v.T
    others = (first == 1) & (rest == 1)
    return others & ((year == 1) | (title <= 1)) | (title <= 1) & (extra == 2) & (first <= 1)


def voted(inputs: DataFrame, targets: DataFrame, bands: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(input_id, target_paper_id, the votes, distance) of the candidate pairs whose titles agree in half of their words at least."""
    pairs = candidates(inputs, targets, bands).join(inputs, "input_id").join(targets.select("target_paper_id", *(F.col(c).alias(f"{c}_b") for c in ("title", "head", "names", "year"))), "target_paper_id")
    pairs = pairs.where(worth(_content("title"), _content("title_b"), F.col("names"), F.col("names_b"), F.col("cut")))
    long = F.greatest(F.length("title"), F.length("title_b")) > LONG_CHARS
    distance = F.when(F.col("title") == F.col("title_b"), 0).when(long, FAR).otherwise(F.levenshtein("title", "title_b", FAR))
    v = votes("title", "cut", "head", "names", "year", "title_b", "head_b", "names_b", "year_b", distance)
    return pairs.select("input_id", "target_paper_id", v.alias("_v")).select("input_id", "target_paper_id", "_v.*").where("title > 0")


def scored(inputs: DataFrame, targets: DataFrame) -> DataFrame:
    """(input_id, target_paper_id, confidence, distance) of every candidate pair. Only counts of vote patterns, at most the product of the voters'
    levels, reach the driver, where the label model is fitted on all of them; posteriors go back as a table of patterns. The listed papers are taken
    in slices, and what a slice shuffled is dropped when its votes are written."""
    i, t = written(inputs), written(targets)
    bands = written(band_keys(i.where("title is not null"), "input_id")), written(band_keys(t, "target_paper_id"))
    n = slices(*bands)
    part = lambda df, k: df if n == 1 else df.where(F.pmod(F.xxhash64("input_id"), F.lit(n)) == k)
    pairs = reduce(DataFrame.unionByName, [written(voted(part(i, k), t, (part(bands[0], k), bands[1]))) for k in range(n)])
    patterns = pairs.groupBy(*VOTERS).agg(F.count("*").alias("_n")).orderBy(*VOTERS).toPandas()
    spark = inputs.sparkSession
    if not len(patterns):
        return spark.createDataFrame([], pairs.select("input_id", "target_paper_id", F.lit(0.0).alias("confidence"), "distance").schema)
    x = patterns[list(VOTERS)].to_numpy().astype(int)
    model = LabelModel().fit(x, patterns["_n"].to_numpy().astype(float), first_guess(x), never_same(x))
    table = spark.createDataFrame([(*map(int, row), float(p)) for row, p in zip(x, model.posterior(x))], ", ".join(f"{c} int" for c in VOTERS) + ", confidence double")
    return pairs.join(F.broadcast(table), list(VOTERS)).select("input_id", "target_paper_id", "confidence", "distance")


def links(inputs: DataFrame, tasks: DataFrame) -> DataFrame:
    """(input_id, target_paper_id, confidence) of each listed paper and the target paper it is, at CONFIDENT or more.

    A listed paper links to its most confident target; of equals to the one with the nearest title, then the least id. Listed papers and
    targets without a title link to none; missing authors or years leave it to the other votes; repeated rows of an input count once;
    an empty table on either side gives no rows."""
    # pairs name a target by its place in the order of the ids, which is shorter
    t = written(target_papers(tasks).orderBy("target_paper_id").withColumn("_t", F.monotonically_increasing_id()))
    s = scored(listed_papers(inputs), t.drop("target_paper_id").withColumnRenamed("_t", "target_paper_id")).where(F.col("confidence") >= CONFIDENT)
    best = Window.partitionBy("input_id").orderBy(F.desc("confidence"), "distance", "target_paper_id")
    s = s.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("input_id", F.col("target_paper_id").alias("_t"), F.round("confidence", 6).alias("confidence"))
    return s.join(t.select("_t", "target_paper_id"), "_t").select("input_id", "target_paper_id", "confidence")
