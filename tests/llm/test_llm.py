"""The operators for training data against brute force, exact round trips and held cases."""

from __future__ import annotations

import itertools
import os
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from pathwright.functions.words import words
from pathwright.llm import crosssplit, encode, features, labelmodel, leaks, linkage, neardup, residue, splits
from pathwright.session import written

VOCAB = [f"w{i}" for i in range(400)]


def sentence(r: random.Random, n: int = 12) -> str:
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(r: random.Random, text: str, n: int) -> str:
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "edit" + str(r.randrange(10**6))
    return " ".join(w)


# --- splits


def brute_components(links):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for r, e in links:
        by.setdefault(r, []).append(e)
    for es in by.values():
        for e in es:
            parent[find(e)] = find(es[0])
    groups = {}
    for e in {e for _, e in links}:
        groups.setdefault(find(e), set()).add(e)
    return {e: min(g) for g in groups.values() if len(g) > 1 for e in g}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    links = [(f"r{r.randrange(40)}", f"e{r.randrange(70):02d}") for _ in range(60)]
    chain = [(f"c{i}", f"z{j:03d}") for i in range(60) for j in (i, i + 1)]
    df = spark.createDataFrame([*links, *chain, *links[:5], (None, "e01"), ("r1", None)], "rec string, ent string")
    got = {x["entity"]: x["label"] for x in splits.components(df, "rec", "ent").collect()}
    assert got == brute_components([*links, *chain])


def test_components_of_nothing(spark):
    assert splits.components(spark.createDataFrame([], "rec string, ent string"), "rec", "ent").count() == 0


TASKS = "task_id long, paper_id string, source string, claim_idx int, loaded_at long"
META = "paperId string, externalIds map<string,string>"


def test_related_tasks(spark):
    a, b = "a" * 40, "b" * 40
    tasks = [(1, "2101.00001", "silver", 0, 1), (1, "2101.00001", "silver", 0, 2), (2, "arXiv:2101.00001v2", "silver", 1, 1), (3, a.upper(), "gold", 0, 1), (4, "2019.x-long.1", "gold", 0, 1), (5, None, "silver", 0, 1), (6, "N/A", "silver", 0, 1), (7, "6", "blind", 6, 1), (8, "6", "blind", 6, 1), (9, "10.1234/x", "silver", 0, 1), (10, b, "silver", 0, 1), (None, "2101.00001", "silver", 0, 1)]
    meta = [(a, {"ArXiv": "2101.00001"}), ("c" * 40, {"ArXiv": "2101.00001", "ACL": "2019.x-long.1", "DOI": "N/A"}), (b, {"DOI": "none"}), ("d" * 40, None)]
    got = {tuple(x) for x in splits.related_tasks(spark.createDataFrame(tasks, TASKS), spark.createDataFrame(meta, META)).collect()}
    assert got == {(t, "2019.x-long.1") for t in (1, 2, 3, 4)}


def test_groups_stay_whole_and_shares_hold(spark):
    r = random.Random(1)
    rows = [(f"g{int(r.paretovariate(0.7)) % 900}" if i % 3 else "hot", r.choice(["a", "b", "b", None])) for i in range(9000)]
    df = spark.createDataFrame(rows, "g string, s string")
    got = {x["g"]: x["split"] for x in splits.assign_groups(df, "g", "s", {"train": 0.8, "validation": 0.1, "test": 0.1}).collect()}
    assert set(got) == {g for g, _ in rows} and got["hot"] == "train"
    n = {k: sum(got[g] == k for g, _ in rows) / len(rows) for k in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8) < 0.02 and abs(n["test"] - 0.1) < 0.02
    b = [got[g] for g, s in rows if s == "b"]
    assert abs(b.count("test") / len(b) - 0.1) < 0.03
    assert splits.assign_groups(df.limit(0), "g", "s", {"train": 1.0}).count() == 0


# --- encoding


@pytest.fixture(scope="module")
def merges():
    return encode.Merges(encode.read_ranks(encode.vocabulary_path()))


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=encode.read_ranks(encode.vocabulary_path()), special_tokens={})


HARD = ["", " ", "\n\n \t", "it's THEY'LL 12,345.6", "<|endoftext|> is text", "aaaaaaaaaaaaaaaaaaaaa", "naïve ﬁ 語料 👩‍🔬 \x1c\x85 x", "a" * 5000 + "b" * 5000, "﻿x​y"]


def test_encoding_is_exact(spark, reference_encoding):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *HARD, HARD[3]])], "doc_id long, text string, ids string")
    got = {r["doc_id"]: list(r["ids"]) for r in encode.encode(df).collect()}
    assert got == {i: [] if t is None else reference_encoding.encode_ordinary(t) for i, t in enumerate([None, *HARD, HARD[3]])}
    assert encode.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoding_of_any_text(text):
    import tiktoken

    global _ENC, _OWN
    if "_ENC" not in globals():
        ranks = encode.read_ranks(encode.vocabulary_path())
        _ENC = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _OWN = encode.Merges(ranks)
    ws = encode.Splitter()(text)
    found = _OWN.replay(ws)
    ids = [i for w in ws for i in found[w]]
    assert ids == _ENC.encode_ordinary(text) and _ENC.decode(ids) == text


@pytest.mark.parametrize("common", [400_000, 40, 0])
def test_every_distinct_word_is_replayed_once(spark, reference_encoding, common):
    r = random.Random(1)
    texts = [sentence(r, 60) + r.choice(["", " naïve", "\n\n"]) for _ in range(300)] + [None, ""] * 3
    d = spark.createDataFrame([(i % 200, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    n = spark.sparkContext.accumulator(0)
    old, encode.COMMON_WORDS = encode.COMMON_WORDS, common
    try:
        got = sorted((x["doc_id"], list(x["ids"])) for x in encode.encode(d, replayed=n).collect())
    finally:
        encode.COMMON_WORDS = old
    split = encode.Splitter()
    assert got == sorted((i % 200, reference_encoding.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert n.value == len({w for t in texts if t for w in split(t)})


def test_pairs_that_give_one_token_merge_from_the_left():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"ba": 301, b"aba": 302}
    m = encode.Merges(ranks)
    word = "abaaba"
    got = m.replay([word])[word]
    parts = [bytes([c]) for c in word.encode()]
    while True:  # the plain way: the first pair of least rank
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    assert got == [ranks[x] for x in parts]


def test_replay_merges_overlapping_pairs_from_the_left(merges, reference_encoding):
    every = [" " + "ab" * 9, "xx" * 7, "mmmmmm", "ing", " the"]
    got = merges.replay(every)
    for w in every:
        assert got[w] == reference_encoding.encode_ordinary(w)


# --- leaks


def test_winnowing_keeps_its_guarantee():
    r = random.Random(0)
    for _ in range(50):
        shared = [r.randrange(1, 2**60) for _ in range(leaks.GRAM + leaks.WINDOW - 1)]
        a = [r.randrange(2**60) for _ in range(r.randrange(20))] + shared + [r.randrange(2**60) for _ in range(r.randrange(20))]
        b = [r.randrange(2**60) for _ in range(r.randrange(20))] + shared + [r.randrange(2**60) for _ in range(r.randrange(20))]
        of, _, h = leaks.winnowed([a, b])
        assert set(h[of == 0]) & set(h[of == 1])
    assert len(leaks.winnowed([])[0]) == len(leaks.winnowed([[1, 2]])[0]) == 0
    assert set(leaks.winnowed([[1, 2], list(range(leaks.GRAM)), []])[0]) == {1}


def test_leaks(spark):
    r = random.Random(4)
    items = [(i, "dev", "t", sentence(r, 48)) for i in range(6)]
    part = lambda i, a, b: " ".join(items[i][3].split()[a:b])
    docs = {
        1: sentence(r, 80) + " " + items[0][3].upper().replace(" ", ",\n") + " " + sentence(r, 30),
        2: sentence(r, 60) + part(1, 10, 40) + sentence(r, 60),
        3: part(2, 0, 14) + " " + sentence(r, 50) + " " + part(2, 30, 44),
        4: part(3, 0, 18) + " " + sentence(r, 70),  # too little
        5: " ".join(w if i % 12 else "\\textbf{changed} [3]" for i, w in enumerate(items[4][3].split())),
        6: " ".join(part(5, i, i + 4) + " " + sentence(r, 3) for i in range(0, 48, 4)),  # no running text
        7: "", 8: None, 9: " \n", 10: sentence(r, 3),
    }
    docs[2] = " ".join([sentence(r, 60), part(1, 10, 40), sentence(r, 60)])
    d = spark.createDataFrame([(k, v, "clash") for k, v in docs.items()] + [(1, docs[1], "again")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([*items, (90, "dev", "t", None), (91, "dev", "t", ""), (92, "dev", "t", "two words")], "item_id long, split string, task string, text string")
    want = {(1, 0), (2, 1), (3, 2), (5, 4)}
    assert {(x["doc_id"], x["item_id"]) for x in leaks.leaked(d, i).collect()} == want
    assert {x["item_id"]: x["n_docs"] for x in leaks.leak_report(d, i).collect()} == {0: 1, 1: 1, 2: 1, 4: 1}
    old, leaks.ITEM_ROWS = leaks.ITEM_ROWS, 0  # beyond the bound of the broadcast
    try:
        assert {(x["doc_id"], x["item_id"]) for x in leaks.leaked(d, i).collect()} == want
    finally:
        leaks.ITEM_ROWS = old
    assert leaks.leaked(d.limit(0), i).count() == 0 and leaks.leaked(d, i.limit(0)).count() == 0


def test_leaks_with_a_word_changed_in_every_six(spark):
    r = random.Random(12)
    word = iter(r.sample(range(10_000), 10_000))
    item = [f"x{next(word)}" for _ in range(48)]
    whole = " ".join(w if i % 6 else "changed" for i, w in enumerate(item))
    parts = " ".join([*item[:18], *(f"y{next(word)}" for _ in range(60)), *item[30:36]])  # 18 and 6 of 48
    d = spark.createDataFrame([(1, whole), (2, parts), (3, " ".join(item[:20]))], "doc_id long, text string")
    i = spark.createDataFrame([(0, "dev", "t", " ".join(item))], "item_id long, split string, task string, text string")
    assert {x["doc_id"] for x in leaks.leaked(d, i).collect()} == {1, 2}


@pytest.mark.parametrize("every", [6, 7, 8])
@pytest.mark.parametrize("bound", [2_000_000, 1])
def test_leaks_with_changed_words_whatever_is_held_at_a_time(spark, every, bound):
    r = random.Random(every)
    items = [(i, "dev", "t", " ".join(f"x{i}y{j}" for j in range(29)) + " of the same stock phrase as all the others") for i in range(12)]
    docs = [(i, " ".join([sentence(r, 30), *(w if (j + 1) % every else "changed" for j, w in enumerate(t.split())), sentence(r, 30)])) for i, _, _, t in items]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, split string, task string, text string")
    old, leaks.HITS = leaks.HITS, bound
    try:
        assert {(x["doc_id"], x["item_id"]) for x in leaks.leaked(d, i).collect()} == {(k, k) for k in range(12)}
    finally:
        leaks.HITS = old


# --- residue

REAL = "The second stage ranks answers by their scores and passes them on. Two annotators labelled every example by hand. We report the mean of five runs. "
RESIDUE = [
    "500 Internal Server Error\n\nThe record you requested is no longer hosted here. Try again later.", "A Good Title of a Paper\n\nPlease enable JavaScript to view this article.", "\\section{Intro}\nTBD\n\n\\section{End}\n(to be added)",
    "Title = {{title}}\n\nAuthors = {{authors}}", "Lorem ipsum dolor sit amet consectetur adipiscing elit. Duis aute irure dolor in reprehenderit voluptate velit.", "null", "Traceback (most recent call last):\n  File \"x.py\", line 3, in f\nValueError: bad",
    "请启用 JavaScript 以查看本文。", "Der Dienst ist vorübergehend nicht erreichbar.", "La page demandée est introuvable.", "[text goes here]", "Our [method here] beats [baseline here] on [INSERT TASK].",
]
REAL_DOCS = [
    REAL, REAL + "Crawled pages that only said 404 Not Found were dropped.", REAL + "\n% TODO check this\n", "About 3% of the sites asked readers to enable JavaScript and were replaced by parses. " + REAL,
    "Each prompt follows the pattern ``{{question}} Answer: {{answer}}'' here. " + REAL, "Short but real text about parsing.", "我们提出一种面向法院判决的事件抽取方法。", "", "  \n", None,
]


@pytest.mark.parametrize("text", RESIDUE)
def test_evidence_of_residue(text):
    kinds = [residue.analysed(line) for line in text.splitlines()]
    assert any(k for k, _, _ in kinds) and sum(w for _, _, w in kinds) <= residue.REAL_WORDS


def test_residue(spark):
    menu = ["Home | Browse | Search", "Powered by X Repository v3"]
    texts = RESIDUE + REAL_DOCS
    rows = [(i, None if t is None else "\n".join([*menu, t]) if i % 2 and t.strip() else t, "crawl" if i % 3 else None, "x") for i, t in enumerate(texts)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    assert {x["doc_id"] for x in residue.residue_documents(d).collect()} == set(range(len(RESIDUE)))
    assert {x["kind"] for x in residue.residue_report(d).collect()} == {"error", "script", "placeholder", "filler"}
    assert residue.residue_documents(d.limit(0)).count() == 0


def test_recurrent_lines_are_subtracted(spark):
    banner = "Subscribe to the weekly letter of this archive and never miss a new issue of the old journals again, dear friends of long banners all over the known world, near and far. Second part of the banner. Third part of the same banner."
    d = spark.createDataFrame([(i, f"{banner}\n{'Please enable JavaScript to read this.' if i == 0 else REAL + str(i)}", "h") for i in range(8)], "doc_id long, text string, source string")
    assert [x["doc_id"] for x in residue.residue_documents(d).collect()] == [0]


def test_lines_of_copied_documents_are_no_boilerplate(spark):
    menu = "Home and start page | Browse all volumes | Search the full archive"
    rows = [(i, f"{menu}\n{REAL}\n[insert citation here]") for i in range(40)]  # copies
    rows += [(100 + i, f"{REAL} It says more.\n[insert {word} here]") for i, word in enumerate(["table", "figure", "number", "name", "title", "date", "venue"])]  # copies, a note of its own each
    rows += [(200 + i, f"{menu}\n" + " ".join(f"word{chr(97 + i)}{chr(97 + j)}" for j in range(40)) + ".") for i in range(12)]
    rows += [(300 + i, f"{menu}\n404 Not Found") for i in range(3)]
    d = spark.createDataFrame([(*x, "h") for x in rows], "doc_id long, text string, source string")
    assert {x["doc_id"] for x in residue.residue_documents(d).collect()} == {300, 301, 302}
    keys = {x["key"] for x in residue.host_boilerplate(residue.line_features(d).where("kinds = 0")).collect()}
    assert keys == {x["k"] for x in spark.createDataFrame([(residue.line_key(menu),)], "line string").select(F.xxhash64("line").alias("k")).collect()}


@pytest.mark.parametrize(
    "low",
    [
        "at org.x.foo.bar(foo.java:12)", "cet article n'existe pas", "keyerror: the name abc is not a key", "java.lang.fooexception: value of this was odd", "overflowerror: numerical result out of range", "x.loadfailure: one two three four",
        "uh-oh, nothing to see there", "404 xyz-gone for all who ask", "(most recent call last) in all of it", "solve the recaptcha below to go on", "the tool _______ handles all of the _______",
    ],
)
def test_prefilter_lets_through_what_patterns_find(low):
    found = sum(1 << k for k, p in enumerate(residue._PATTERNS) if p.search(residue._QUOTED.sub(" ", low)))
    assert found and residue.evidence(low) == found


def test_prefilter_loses_no_evidence():
    for text in RESIDUE:
        for line in text.splitlines():
            for s in residue._SENTENCE.split(line):
                low = " ".join(s.lower().split())
                full = sum(1 << k for k, p in enumerate(residue._PATTERNS) if p.search(residue._QUOTED.sub(" ", low)))
                assert residue.evidence(low) == full or residue.MENTION.search(low)


@pytest.mark.parametrize(
    "text",
    [
        "JavaScript was adopted by browsers early.", "Sorry, but attention is not explanation.", "The dataset is no longer available.", "The proof is not provided by the authors.", "The estimator is not available in closed form.",
        "Coming soon after BERT, the model changed how parsers were trained.", "A manual audit of 499 outputs found error signals that the parser had ignored.", "The licence allows sharing graphs but not theatre scripts.",
        "Code blocks in JavaScript were parsed first.", "No existe una teoría de la gramática.", "The release holds 500 splits, error signals and scripts for parsing.", "Captchas are hard for vision models.",
        "Unlike A, B does not need error signals when it meets theatre scripts.", "It holds 407 items drawn from building permits and theatre scripts.", "In this paper, duplicates were removed by comparing estimates.",
    ],
)
def test_sentences_that_only_speak_of_such_things(text):
    assert residue.analysed(text)[0] == 0


@pytest.mark.parametrize(
    "text",
    [
        "We are sorry but the page that you have asked for on this very old server of ours could not be found in any of the many folders that we have looked through today.", "Nous sommes désolés, une erreur est survenue", "Страница не найдена",
        "お探しのページは見つかりませんでした。", "Pagina non trovata", "Página não encontrada", "Nie znaleziono strony", "Pagina niet gevonden", "La página solicitada no existe.", "Die Seite existiert nicht.", "找不到页面",
        "Script execution is disabled in this browser.", "Please allow scripts and reload.", "HTTP/1.1 503", "Unable to load the requested article.", "An unexpected error occurred.",
        "One real sentence stands here first. Another real one follows it here. And a third one of five words. Error 404: page not found.",
    ],
)
def test_evidence_of_other_makes(text):
    assert residue.analysed(text)[0] in (1, 2) and residue.has_evidence(text)


def test_cues_let_through_what_expressions_find():
    every = [s for t in [*RESIDUE, *filter(None, REAL_DOCS)] for s in t.splitlines()]
    for low in (x.lower() for x in every):
        for i, (k, search) in enumerate(residue._SEARCHES):
            if search.search(low) and i not in residue._WHOLES:
                assert residue._cued(low) >> i & 1, (low, residue._FAMILIES[i])


def test_a_notice_on_every_page_is_boilerplate_and_an_error_of_empty_pages_is_not(spark):
    foot = "Please enable JavaScript to see the comments."
    rows = [(i, f"{REAL}{REAL}Page {chr(97 + i)}{chr(97 + i)} says so in its own words.\n{foot}") for i in range(20)]
    rows += [(100, f"A Good Title of a Paper\n{foot}"), (101, "A Good Title of a Paper\nYou must enable JavaScript.")]
    rows += [(200 + i, f"Item {chr(97 + i)}\n404 Not Found") for i in range(10)]
    d = spark.createDataFrame([(*x, "h") for x in rows], "doc_id long, text string, source string")
    assert {x["doc_id"] for x in residue.residue_documents(d).collect()} == {101, *range(200, 210)}


# --- cross-split overlaps


def test_overlaps_against_all_pairs(spark):
    r = random.Random(5)
    base = [sentence(r, 40) for _ in range(30)]
    rows = []
    for i, t in enumerate(base):
        rows.append((i, "train", "a", t))
        rows.append((100 + i, ("dev", "test")[i % 2], "b", edited(r, t, r.choice([0, 1, 2, 3])) if i % 3 else ". ".join(reversed([t[:90], t[90:]]))))
    rows += [(200, "train", "a", base[0].upper() + "!"), (201, "dev", "b", None), (202, "dev", "b", ""), (203, "dev", "b", "one two three four"), (204, "train", "a", "one two three four"), (205, None, "a", base[1]), (206, "other", "a", base[1])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "id long, split string, source string, text string, copy string")
    from collections import Counter

    def sim(a, b):
        x, y = Counter(words(a)), Counter(words(b))
        return sum((x & y).values()) / max(sum(x.values()), sum(y.values()))

    want = {(a[0], b[0]) for a in rows for b in rows if a[1] in ("dev", "test") and b[1] == "train" and a[3] and b[3] and len(words(a[3])) > 4 and len(words(b[3])) > 4 and sim(a[3], b[3]) >= crosssplit.SIMILAR}
    got = {(x["eval_id"], x["train_id"]) for x in crosssplit.overlaps(df).collect()}
    assert got == want and len(want) > 25
    rep = crosssplit.overlap_report(df).collect()
    assert sum(x["n_pairs"] for x in rep) == len(want) and {x["eval_split"] for x in rep} == {"dev", "test"}
    assert crosssplit.overlaps(df.limit(0)).count() == 0


def test_overlaps_where_a_third_are_near_copies_of_one(spark):
    r = random.Random(8)
    claim = sentence(r, 25)
    near = [edited(r, claim, 2) for _ in range(300)]
    odd = [" ".join(f"v{r.randrange(5_000)}" for _ in range(25)) for _ in range(600)]
    rows = [(i, "train" if i % 5 else "dev", "a", t) for i, t in enumerate(near + odd)]
    want = {(a, b) for a in range(0, 300, 5) for b in range(300) if b % 5 and sum(x == y for x, y in zip(near[a].split(), near[b].split())) >= crosssplit.SIMILAR * 25}
    got = {(x["eval_id"], x["train_id"]) for x in crosssplit.overlaps(spark.createDataFrame(rows, "id long, split string, source string, text string")).collect()}
    assert len(want) > 14_000 and all(a < 300 and b < 300 for a, b in got) and len(got & want) >= 0.99 * len(want)


def test_codes_are_near_for_near_texts():
    f = np.arange(1, 40)
    x = np.concatenate([f, f[:-3], [901, 902, 903], np.arange(500, 539)])
    picks = crosssplit.block_picks(3, 14)
    bits, keys = crosssplit.codes_of(x, np.ones(len(x), np.float32), np.array([39, 78, 117]), picks)
    gap = lambda a, b: int((bits[a] != bits[b]).sum())
    assert gap(0, 1) < crosssplit.RADIUS < gap(0, 2)
    assert keys[2].tolist() == [sum(int(bits[2][p]) << i for i, p in enumerate(ps)) + (t << 14) for t, ps in enumerate(picks)]


# --- near-duplicates


def brute_pairs(records):
    out = set()
    for (i, a), (j, b) in itertools.combinations(records, 2):
        x, y = ([" ".join(words(t)) for t in ts or [] if words(t)] for ts in (a, b))
        if x and y and neardup._texts_shared(sorted(x), sorted(y)) >= neardup.SAME_SHARE:
            out.add((min(i, j), max(i, j)))
    return out


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(6)
    stock = [sentence(r, 25) for _ in range(4)]
    records = []
    for g in range(12):
        texts = [sentence(r, 25) for _ in range(6)] + [r.choice(stock)]
        records.append((len(records), texts))
        records.append((len(records), [edited(r, t, 1) for t in reversed(texts)]))
        records.append((len(records), texts[:3] + [sentence(r, 25) for _ in range(4)]))  # shares a part only
        records.append((len(records), [t.upper() for t in texts[1:]] + [texts[0] + "."]))  # a copy
    records += [(900, []), (901, None), (902, [None, "", " - "]), (903, ["one"]), (904, ["one"]), (905, [stock[0]] * 40)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in records], "id long, texts array<string>, features string")
    got = {(x["id_a"], x["id_b"]) for x in neardup.near_duplicates(df).collect()}
    assert got == brute_pairs(records)
    c = {x["id"]: x for x in neardup.duplicate_classes(df).collect()}
    assert c[3]["class_id"] == 0 and c[3]["n_copies"] == 2 and c[3]["n_links"] == 1 and 900 not in c
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_consistent_samples_estimate_weighted_jaccard(spark):
    r = np.random.RandomState(1)
    f = np.arange(1, 301)
    wa, wb = r.rand(300) + 0.1, r.rand(300) + 0.1
    d = spark.createDataFrame([(f.tolist(), wa.tolist()), (f.tolist(), wb.tolist()), (f.tolist(), wa.tolist())], "f array<long>, w array<float>")
    k = [x["k"] for x in d.select(neardup.band_keys("f", "w").alias("k")).collect()]
    assert k[0] == k[2] and len(k[0]) == neardup.BANDS
    j = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(np.mean(np.array(k[0]) == np.array(k[1])) - j**neardup.ROWS) < 0.3
    same = [np.mean(neardup.samples(g, wa) == neardup.samples(g, wb)) for g in (f.astype(np.int64) * 0x9E3779B97F4A7C1 + i for i in range(30))]
    assert abs(np.mean(same) - j) < 0.03
    assert (neardup.samples(f.astype(np.int64), wa, part=7) == neardup.samples(f.astype(np.int64), wa)).all()


def test_weighted_features(spark):
    d = spark.createDataFrame([(1, [(10, 2), (11, 1)]), (2, [(10, 1), (12, 1)]), (3, [(12, 1)]), (4, [])], "id long, fs array<struct<feature: long, times: int>>")
    got = {x["id"]: dict(zip(x["feature"], x["weight"])) for x in features.weighted(d, "id", "fs", 1.5).collect()}
    assert {k: sorted(v) for k, v in got.items()} == {1: [10, 11], 2: [10, 12], 3: [12]} and abs(got[1][10] - 2 * np.log(3)) < 1e-5 and got[1][11] == 1.5
    assert {x["id"]: sorted(x["feature"]) for x in features.weighted(d, "id", "fs", 1.5, shared_only=True).collect()} == {1: [10], 2: [10, 12], 3: [12]}
    every, idf = features.broadcast_weights(d, "fs", 1.5).value
    assert every.tolist() == [10, 12] and np.allclose(idf, np.log(3))


ONE = "we show that a parser trained on court rulings of three states keeps most of its accuracy on those of a fourth"


@pytest.mark.parametrize("copies", [2, 3, 5])
def test_tables_of_one_family_find_their_pairs(spark, copies):
    """All features stand in every record but those of the edits; no other record is there to tell them from."""
    near = [ONE.replace("most", f"all{i}") for i in range(copies)]
    rows = [(i, "dev" if i == 0 else "train", "a", t) for i, t in enumerate(near)]
    got = {(x["eval_id"], x["train_id"]) for x in crosssplit.overlaps(spark.createDataFrame(rows, "id long, split string, source string, text string")).collect()}
    assert got == {(0, i) for i in range(1, copies)}
    r = random.Random(2)
    texts = [sentence(r, 20) for _ in range(4)]
    records = [(i, [*texts[:3], texts[3].replace(texts[3].split()[7], f"edit{i}", 1)]) for i in range(copies)]
    got = {(x["id_a"], x["id_b"]) for x in neardup.near_duplicates(spark.createDataFrame(records, "id long, texts array<string>")).collect()}
    assert got == set(itertools.combinations(range(copies), 2))


def test_codes_do_not_depend_on_how_weights_arrive(spark):
    r = random.Random(3)
    rows = [(i, "train" if i % 3 else "dev", "a", edited(r, ONE, 2) if i % 2 else sentence(r, 20)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, split string, source string, text string")
    few = {tuple(x) for x in crosssplit.overlaps(df).collect()}
    old, features.BROADCAST_FEATURES = features.BROADCAST_FEATURES, 0
    try:
        assert {tuple(x) for x in crosssplit.overlaps(df).collect()} == few and few
    finally:
        features.BROADCAST_FEATURES = old


def test_block_plan_keeps_its_recall_at_every_size():
    assert crosssplit.block_plan(0) == crosssplit.block_plan(200_000) == crosssplit.block_plan(2**21)
    for n in (10, 2**22, 2**26, 2**30):
        tables, bits = crosssplit.block_plan(n)
        same = np.prod([(crosssplit.BITS - crosssplit.NEAR - i) / (crosssplit.BITS - i) for i in range(bits)])
        assert 1 - (1 - same) ** tables >= crosssplit.RECALL and n / 2**bits <= 2**crosssplit.SPARE


def brute_shingles(texts):
    from collections import Counter

    n = Counter()
    for t in texts:
        w = t.split()
        n.update(" ".join(w[i : i + neardup.SHINGLE]) for i in range(max(1, len(w) - neardup.SHINGLE + 1)))
    return sorted(n.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text("abc", min_size=1, max_size=2), min_size=1, max_size=12).map(" ".join), max_size=4))
def test_shingles_against_strings(texts):
    found, times = neardup.shingles([texts, [], texts], {})
    assert sorted(times[0].tolist()) == brute_shingles(texts) and len(set(found[0].tolist())) == len(found[0]) and len(found[1]) == 0
    assert found[0].tolist() == found[2].tolist() and times[0].tolist() == times[2].tolist()


# --- linkage

G = "struct<paper_id: string, ref_year: string, ref_authors: string>"
CLAIMS = f"target_titles map<string,string>, gold_ingredients array<struct<canonical_grounding: {G}, additional_groundings: array<{G}>>>"
INPUTS = "input_id long, title string, authors string, year int, added_at long"
NAMES = ["Tuvik", "Fendi", "Lorza", "Kamur", "Zemtel", "Wyrol", "Nilbra", "Osquim", "Pradel", "Vikten"]


def corpus(seed=7, n=60):
    r = random.Random(seed)
    a, b, c = ([f"{p}{x}" for x in ("ous", "ical", "ent", "ive", "ing", "ure", "ory", "al")] for p in ("semant", "hierarch", "retriev"))
    papers = []
    for i in range(n):
        t = f"{r.choice(a)} {r.choice(VOCAB)}x {r.choice(b)} models for {r.choice(c)} {r.choice(VOCAB)}y tasks in {r.choice(VOCAB)}z"
        papers.append((f"{i:040x}", t.title(), [f"{r.choice(NAMES)}{i}", f"{r.choice(NAMES)}{i}q"], r.randrange(2005, 2024)))
    return r, papers


def test_linkage_finds_dirty_copies_and_leaves_follow_ups(spark):
    r, papers = corpus()
    claims = [({k: t, "x": None, "": "no key"}, [((k, str(y), " and ".join(f"A. {n}" for n in names)), [(k, None, None), ("malformed", str(y), "Z. Z")])]) for k, t, names, y in papers]
    inputs, want = [], set()
    for i, (k, t, names, y) in enumerate(papers):
        kind = i % 6
        w = t.split()
        if kind == 0:
            row, hit = (t.upper(), "; ".join(f"{n}, B." for n in names), y), True
        elif kind == 1:
            row, hit = (t.replace(w[1], w[1][:2] + w[1][3:]) + " [preprint]", f"{names[0]} et al.", y + 1), True
        elif kind == 2:
            row, hit = ("{" + t + "}.", None, y), True
        elif kind == 3:
            row, hit = (" ".join(w[:4]) + "…", f"Q. {names[0]}", y), True
        elif kind == 4:
            row, hit = ("Comment on: " + t, "Other, P.; People, Q.", y + 5), False
        else:
            row, hit = (t, "Quite, D.; Different, E.", y - 9), False
        inputs.append((i, *row, 1))
        if hit:
            want.add((i, k))
    inputs += [(500, None, "A. B", 2000, 1), (501, "", None, None, 1), (502, "...", "A. B", 2000, 1), (0, *inputs[0][1:4], 2), (503, papers[0][1], f"A. {papers[0][2][0]}", papers[0][3], 1)]
    want.add((503, papers[0][0]))
    c, i = spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(inputs, INPUTS)
    got = linkage.links(i, c).collect()
    pairs = {(x["input_id"], x["target_paper_id"]) for x in got}
    assert len(pairs & want) >= 0.95 * len(want) and len(pairs & want) >= 0.95 * len(pairs)
    assert all(0.5 <= x["confidence"] <= 1 for x in got)
    assert linkage.links(i.limit(0), c).count() == 0 and linkage.links(i, c.limit(0)).count() == 0


def test_a_common_author_makes_no_block(spark):
    """The first author of a tenth of the papers, whose titles differ as those of others do: four times the rows give no more than some five times the
    candidates, and each copy is one."""
    sizes = []
    for n in (400, 1_600):
        r = random.Random(n)
        papers = [(f"{i:040x}", " ".join(f"w{r.randrange(8 * n)}" for _ in range(8)), None, r.randrange(2005, 2024)) for i in range(n)]
        names = [["common"] if i % 10 == 0 else [f"n{i}"] for i in range(n)]
        none = spark.createDataFrame([], "input_id long, title string, cut boolean, names array<string>, head string, year int")
        from pathwright.functions.bibliographic import title_key

        t = spark.createDataFrame([(k, x, None, names[i], y) for i, (k, x, _, y) in enumerate(papers)], "target_paper_id string, title string, head string, names array<string>, year int").withColumn("title", title_key("title"))
        i = spark.createDataFrame([(i, x, False, names[i], None, y) for i, (_, x, _, y) in enumerate(papers)], none.schema).withColumn("title", title_key("title"))
        got = {(x["input_id"], x["target_paper_id"]) for x in linkage.candidates(i, t).collect()}
        assert {(i, k) for i, (k, _, _, _) in enumerate(papers)} <= got
        sizes.append(len([1 for a, b in got if a % 10 == 0 and int(b, 16) % 10 == 0]))
        assert linkage.candidates(none, t).count() == 0
    assert sizes[1] < 5.5 * sizes[0]


def test_title_votes():
    b = "a survey of fast parsing in legal texts"
    assert linkage.title_votes(b, b, False) == (4, 0)
    assert linkage.title_votes("a survey of fast prasing in legal texts technical report", b, False) == (4, 1)
    assert linkage.title_votes("revisiting a survey of fast parsing in legal texts", b, False)[1] == 2
    assert linkage.title_votes("a survey of fast par", b, True) == (2, 0)
    assert linkage.title_votes("quite another thing", b, False)[0] == 0
    assert linkage.close("parsing", "prasing") and linkage.close("aa", "a") and not linkage.close("fast", "slow")
    assert linkage.author_votes(["a1", "b1"], ["a1"]) == (3, 3) and linkage.author_votes([], ["x"]) == (0, 0) and linkage.author_votes(["abcd"], ["wxyz"]) == (1, 1)


def test_label_model_learns_accuracy_and_dependence():
    r = np.random.RandomState(0)
    n = 20_000
    y = r.rand(n) < 0.3
    vote = lambda acc: np.where(r.rand(n) < acc, y, ~y).astype(int)
    good, weak = vote(0.95), vote(0.7)
    copy = np.where(r.rand(n) < 0.97, weak, 1 - weak)  # tells nothing beyond weak
    x, counts = np.unique(np.stack([good, weak, copy, vote(0.9)], 1), axis=0, return_counts=True)
    m = labelmodel.LabelModel().fit(x, counts.astype(float), (x[:, 0] + x[:, 3]) / 2)
    assert (1, 2) in {tuple(sorted((v, p))) for v, p in enumerate(m.parents) if p >= 0}
    assert abs(m.prior - 0.3) < 0.05 and abs(m.tables[0][1].mean(0)[1] - 0.95) < 0.06
    p = m.posterior(np.array([[1, 0, 0, 1], [0, 1, 1, 0]]))
    assert p[0] > 0.9 and p[1] < 0.1


def test_a_common_name_makes_no_candidates_of_its_own(spark, monkeypatch):
    """Titles that begin with one name, and else say other things, are candidates only where they are worth a vote; in slices the links are the same."""
    r = random.Random(5)
    titles = ["tool " + " ".join(f"w{r.randrange(10_000)}" for _ in range(8)) for _ in range(60)]
    i = spark.createDataFrame([(n, x, False, "tool", [f"a{n}"], 2001) for n, x in enumerate(titles)], "input_id long, title string, cut boolean, head string, names array<string>, year int")
    t = spark.createDataFrame([(f"{n:03d}", x, "tool", [f"a{n}"], 2001) for n, x in enumerate(titles)], "target_paper_id string, title string, head string, names array<string>, year int")
    assert sorted((x["input_id"], int(x["target_paper_id"])) for x in linkage.candidates(i, t).collect()) == [(n, n) for n in range(60)]
    inputs = spark.createDataFrame([(n, x.replace("tool ", "Tool: "), f"A. A{n}", 2001, 1) for n, x in enumerate(titles)], INPUTS)
    claims = spark.createDataFrame([({f"{n:03d}": x.replace("tool ", "Tool: ") for n, x in enumerate(titles)}, [])], "target_titles map<string,string>, " + CLAIMS[CLAIMS.index("gold_ingredients ") :])
    whole = sorted(linkage.links(inputs, claims).collect())
    monkeypatch.setattr(linkage, "slices", lambda i, t: 3)
    assert sorted(linkage.links(inputs, claims).collect()) == whole and {(x[0], int(x[1])) for x in whole} == {(n, n) for n in range(60)}


def test_what_was_shuffled_for_a_written_table_is_dropped(spark):
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    size = lambda: sum(os.path.getsize(f) for f in store.getAllFiles().mkString("\n").split("\n") if f.endswith(".data") and f not in before and os.path.exists(f))
    before = set(store.getAllFiles().mkString("\n").split("\n"))
    t = written(spark.range(50_000).groupBy(F.xxhash64("id").alias("k")).count())
    for _ in range(100):
        if not size():
            break
        time.sleep(0.1)
    assert size() == 0 and t.count() == 50_000


# --- very long texts


def test_very_long_texts(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    r = random.Random(9)
    item = sentence(r, 50)
    long_words, one_word, marks = sentence(r, 60_000), "a" * 400_000, "__a" * 100_000 + " [[" * 1000 + "\\cite{" * 1000
    docs = {1: long_words + " " + item, 2: one_word, 3: marks, 4: "Please enable JavaScript. " + one_word, 5: long_words}
    pq.write_table(pa.table({"doc_id": list(docs), "text": list(docs.values()), "source": ["h"] * 5}), str(tmp_path / "d.parquet"))
    d = spark.read.parquet(str(tmp_path / "d.parquet"))
    i = spark.createDataFrame([(1, "dev", "t", item)], "item_id long, split string, task string, text string")
    assert {(x["doc_id"], x["item_id"]) for x in leaks.leaked(d, i).collect()} == {(1, 1)}
    assert {x["doc_id"] for x in residue.residue_documents(d).collect()} == {4}
    assert {x["doc_id"]: len(x["ids"]) > 0 for x in encode.encode(d).collect()} == {k: True for k in docs}
    c = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") == 1, "dev").otherwise("train").alias("split"), "source", "text")
    assert {(x["eval_id"], x["train_id"]) for x in crosssplit.overlaps(c).collect()} == {(1, 5)}
    p = d.select(F.col("doc_id").alias("id"), F.array("text").alias("texts"))
    assert {(x["id_a"], x["id_b"]) for x in neardup.near_duplicates(p).collect()} == {(1, 5)}
    w = d.where("doc_id in (2, 5)")
    inputs = w.select(F.col("doc_id").alias("input_id"), F.col("text").alias("title"), F.lit("A. B").alias("authors"), F.lit(2000).alias("year"), F.lit(1).alias("added_at"))
    ingredients = CLAIMS.partition("gold_ingredients ")[2]
    claims = w.select(F.create_map(F.col("doc_id").cast("string"), "text").alias("target_titles"), F.array().cast(ingredients).alias("gold_ingredients"))
    assert {(x["input_id"], x["target_paper_id"]) for x in linkage.links(inputs, claims).collect()} == {(2, "2"), (5, "5")}
