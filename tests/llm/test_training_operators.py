"""The training-data operators against brute force and on awkward tables."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.llm import decontaminate, line_dedup, mixing, near_dedup, sharding, suffix_dedup, toxicity, url_reputation, vector_search
from presswork.llm.components import components
from presswork.llm.language_id import held_out, identify, learn_prototypes

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], DOCS).withColumn("id", F.lit("clash")).withColumn("rep", F.lit(0)).withColumn("key", F.lit(1))


@pytest.fixture(scope="module")
def awkward():
    rng = random.Random(5)
    base = prose(rng, 60)
    other = prose(rng, 80)
    return [
        None, "", "x", " \n\t ", base, base, base + " tail", other[:150] + base[:400] + "ünïcödé" * 5, "ab" * 400, "ab" * 350 + "c", other, other.replace("alpha", "omega", 1), "\n".join([base[:90], base[90:180], "one", base[:90], base[90:180]]), base[:199], base[:200], base[:201], prose(rng, 3000), "é" * 300,
    ]


def repeats_by_brute_force(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()))
    return out


def test_suffix_dedup_equals_brute_force(spark, awkward):
    got = {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(documents(spark, awkward)).collect()}
    assert [got[i] for i in range(len(awkward))] == repeats_by_brute_force(awkward, 200)


def test_suffix_dedup_of_repeated_rows_and_null_ids(spark):
    text = prose(random.Random(1), 40)
    got = suffix_dedup.remove_repeats(documents(spark, [text, text, "short"], [None, None, 7])).collect()
    assert sorted(len(r.kept) for r in got) == [0, 0, 5]
    assert suffix_dedup.remove_repeats(documents(spark, ["x"]).where("false")).count() == 0


def test_vector_search_recall(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    v[::7] *= 3
    v[3] = v[4] = v[5]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(1000, None, 0), (1020, [0.0] * 16, 0), (1040, [float("nan")] * 16, 0), (1060, [None] + [1.0] * 15, 0), (1080, [1.0], 0), (None, [1.0] * 16, 0)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 20 == 0, k=10, block=200, query_block=10).collect()
    products = v @ v.T
    np.fill_diagonal(products, -np.inf)
    hits = 0
    for q, own in itertools.groupby(sorted(got, key=lambda r: (r.query_id, r["rank"])), lambda r: r.query_id):
        own = list(own)
        assert [r["rank"] for r in own] == list(range(1, 11)) and [r.score for r in own] == sorted((r.score for r in own), reverse=True)
        assert all(abs(r.score - products[q, r.vec_id]) < 1e-9 for r in own)
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(600), -products[q]))[:10].tolist()))
    assert hits >= 0.95 * 300


def test_vector_search_verifies_few_of_clustered_vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    v = centres[rng.integers(0, 40, 4000)] + 0.15 * rng.normal(size=(4000, 32))
    v[:20] = v[0]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").withColumn("query_id", F.lit(0)).withColumn("score", F.lit("clash"))
    got = vector_search.nearest(rows, F.col("vec_id") % 20 == 0, k=20).collect()
    products = np.round(v @ v.T, 12)
    np.fill_diagonal(products, -np.inf)
    hits = sum(r.vec_id in np.lexsort((np.arange(4000), -products[r.query_id]))[:20] for r in got)
    assert len(got) == 200 * 20 and hits >= 0.95 * len(got)
    assert np.mean([r.verified for r in got]) < 0.25 * 4000


def test_vector_search_of_odd_lengths_and_tiny_or_huge_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 2)))] + [(100, [1.0, 2.0, 3.0]), (120, [1e-170, 2e-170]), (140, [1e160, -2e160]), (160, [5e-324, 0.0]), (3, [9.0, 9.0])]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=5).collect()
    assert Counter(r.query_id for r in got) == {q: 5 for q in (0, 20, 40, 120, 140, 160)}
    assert all(r.vec_id != 100 for r in got) and all(r["rank"] == 1 for r in got if r.query_id == 120 and r.vec_id == 140) is True
    # of the two rows with id 3 the lesser vector counts
    assert all(abs(r.score) < 1e100 for r in got if 140 not in (r.vec_id, r.query_id))
    assert all(r.vec_id != 3 or r.score < 60 for r in got)
    assert vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 100, k=2, dims=3).count() == 0


def test_vector_search_small_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id, r.score) for r in vector_search.nearest(few, F.col("vec_id") == 0, k=5).orderBy("rank").collect()] == [(1, 1, 2.0), (2, 2, 2.0)]
    assert vector_search.nearest(few.where("false"), F.col("vec_id") == 0).count() == 0


def test_url_filter_rules_and_edges(spark):
    urls = ["http://a.org/x", "http://EXAMPLE.org/es/1", "https://www.example.org/en/15", "http://b.com/fr/", "http://b.com/de/?q", "http://b.com", None, "nothing", "http://c.net/x", "http://c.net:80/x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    outcomes = spark.createDataFrame([(i, 1) for i in (8,)] * 3, "id long, bad int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_reputation.judge_urls(pages, outcomes).collect()}
    assert got[1] == ("example.org", "/es/1", "example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[0][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4][2:] == ("com/de/", "block")
    assert got[5] == ("b.com", "", None, "allow") or got[5][:3] == ("b.com", "", None)
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[9][0] == "c.net:80"
    assert url_reputation.judge_urls(pages, outcomes.where("false")).count() == len(urls)
    assert url_reputation.judge_urls(pages.where("false"), outcomes).count() == 0


def test_reputation_shrinks_to_the_domain(spark):
    pages = spark.createDataFrame([(i, "bad.x.com" if i < 40 else "new.x.com" if i < 41 else "good.y.com") for i in range(80)], "id long, host string")
    outcomes = spark.createDataFrame([(i, int(i < 40)) for i in range(80) if i != 40], "id long, bad int")
    got = {r.host: r for r in url_reputation.host_reputation(pages, outcomes).collect()}
    assert got["bad.x.com"].lower > 0.5 > got["good.y.com"].mean and got["new.x.com"].mean > got["good.y.com"].mean


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def components_by_brute_force(texts, size):
    sets = [shingles(t, size) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup_equals_brute_force(spark, awkward, size):
    rng = random.Random(size)
    texts = list(awkward)
    for _ in range(12):
        words = prose(rng, 80).split()
        for edits in range(6):
            copy = list(words)
            for _ in range(edits * 2):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if edits == 3 else "  ".join(copy))
    texts += ["one two three", "ONE  two\tthree", "one two", "one"]
    base = prose(rng, 120).split()  # a large family whose members are alike to a varying degree
    for k in range(70):
        copy = list(base)
        for _ in range(k % 14):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(documents(spark, texts), size=size).collect()}
    want = components_by_brute_force(texts, size)
    assert [(got[i].n_shingles, got[i].component_id) for i in range(len(texts))] == want
    assert all(got[i].kept == (want[i][1] == i) for i in range(len(texts)))


def test_near_dedup_branches_large_nodes(spark, monkeypatch):
    """With room for few, large nodes branch; what is found stays the same."""
    monkeypatch.setattr(near_dedup, "FEW", 4)
    rng = random.Random(3)
    base = prose(rng, 100).split()
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randrange(30)):
            copy[rng.randrange(len(copy))] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts), size=2).collect()}
    want = [c for _, c in components_by_brute_force(texts, 2)]
    assert sum(got[i] == w for i, w in enumerate(want)) >= 58


def test_near_dedup_of_a_family_of_thousands(spark):
    """5,000 different texts around one, near and far: components as by the product of all sets."""
    rng = random.Random(21)
    base, texts = prose(rng, 60).split(), []
    for _ in range(5000):
        copy = list(base)
        for at in rng.sample(range(len(copy)), rng.randrange(9)):
            copy[at] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    sets = [shingles(t, 2) for t in texts]
    column = {x: i for i, x in enumerate(sorted(set().union(*sets)))}
    held = np.zeros((len(sets), len(column)), np.float32)
    for i, x in enumerate(sets):
        held[i, [column[k] for k in x]] = 1
    both, n = held @ held.T, held.sum(1)
    linked = 100 * both >= 80 * (n[:, None] + n[None, :] - both)
    want = np.full(len(sets), -1)
    for first in range(len(sets)):
        front = np.array([first]) if want[first] < 0 else np.empty(0, int)
        while len(front):
            want[front] = first
            front = np.flatnonzero(linked[front].any(0) & (want < 0))
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(documents(spark, texts), size=2).collect()}
    assert len(set(want.tolist())) > 1 and [got[i] for i in range(len(texts))] == want.tolist()


def test_near_dedup_null_ids_repeats_and_empty(spark):
    got = near_dedup.near_duplicates(documents(spark, ["a b c", "a b c", "a b c", "a b c"], [None, 5, 5, 9]), size=2).collect()
    assert sorted((r.doc_id is None, r.component_id or 0, r.kept) for r in got) == [(False, 5, False), (False, 5, True), (False, 5, True), (True, 0, True)]
    assert near_dedup.near_duplicates(documents(spark, ["x"]).where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(30)] + [(300, 300), (None, 3), (7, 6)]
    got = {r.v: r.comp for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[200 + i] for i in range(30)} == {100} and 300 not in got


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    texts, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        words = prose(rng, 40).split()
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["slurone", "slurtwo", "SLURTHREE"]))
        texts.append(" ".join(words))
        labels.append((i, int(toxic), 1))
    texts += [None, "", "!!"]
    docs = documents(spark, texts)
    labelled = spark.createDataFrame(labels, "id long, toxic int, quality int")
    out = lambda c: F.crc32(F.col(c).cast("string")) % 5 == 0
    scored = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs.where(~out("doc_id")), labelled.where(~out("id")))).collect()}
    unseen = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(0 <= s <= 1 for s in scored.values()) and len(scored) == len(texts)
    assert sum((scored[i] >= 0.5) == (i % 4 == 0) for i in unseen) >= 0.97 * len(unseen)
    assert scored[900] == scored[901] == scored[902] < 0.5


def test_toxicity_without_labels(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs, none)).collect()} == {0.5}


def test_kneser_ney_sums_to_one_and_equals_the_formula(spark):
    rng = random.Random(7)
    pairs = {(rng.randrange(30) ** 2 // 30, rng.randrange(25), rng.choice([1, 1, 2])) for _ in range(500)}
    classes = Counter()
    for w, c, k in pairs:
        classes[w, c] |= k
    rows = spark.createDataFrame([(w, c, k) for (w, c), k in classes.items()] + [(99, 0, 1)], "word long, context long, classes int")
    entries, other = toxicity.kneser_ney(rows, 2.5)
    n = [Counter(w for (w, _), k in [*classes.items(), ((99, 0), 1)] if k & bit) for bit in (3, 1, 2)]
    whole = [sum(x.values()) for x in n]
    freed = [sum(min(v, 2.5) for v in x.values()) / t for x, t in zip(n, whole, strict=True)]
    vocabulary = [*n[0], "unknown"]
    shared = {w: max(n[0][w] - 2.5, 0) / whole[0] + freed[0] / len(vocabulary) for w in vocabulary}
    p = [{w: max(n[k][w] - 2.5, 0) / whole[k] + freed[k] * shared[w] for w in vocabulary} for k in (1, 2)]
    assert all(sum(x.values()) == pytest.approx(1) for x in (shared, *p))
    got = {r.word: (r.p0, r.p1) for r in entries.collect()}
    assert 0 < len(got) < len(vocabulary) - 1
    for w in vocabulary:
        assert got[w] == pytest.approx((p[0][w], p[1][w])) if w in got else np.log(p[1][w] / p[0][w]) == pytest.approx(other)


def test_toxicity_of_copies_long_texts_and_empty_tables(spark):
    rng = random.Random(12)
    texts = [prose(rng, 30) + (f" slur{i % 3} {prose(rng, 5)} slur{i % 2}" if i % 4 == 0 else "") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(700 + i, 1) for i in range(300)] + [(None, 1), (5, None), (4, 0)], "id long, toxic int").withColumn("text", F.lit("clash"))
    copies = [prose(rng, 30)] * 300  # one text, labelled toxic 300 times, is one text
    docs = documents(spark, [*texts, *copies, "slur0 slur1 " * 3, prose(rng, 60_000) + " slur0 slur1 slur2 " + prose(rng, 60_000), "ordinary words here", None], [*range(600), *range(700, 1000), None, 2000, 2001, 2001])
    learnt = toxicity.learn(docs, labels)
    got = toxicity.score(docs, learnt).collect()
    by_id = {r.doc_id: r.score for r in got}
    assert len(got) == docs.count() and by_id[None] > 0.9 and by_id[2000] > 0.5
    assert np.mean([by_id[i] >= 0.5 for i in range(0, 600, 4)]) > 0.95 and np.mean([by_id[i] < 0.5 for i in range(600) if i % 4]) > 0.95
    assert toxicity.score(docs.where("false"), learnt).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.learn(docs.where("false"), labels)).collect()} == {0.5}


def sellers(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, d in enumerate(item):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_distance_equals_dynamic_programming():
    rng = random.Random(0)
    for _ in range(200):
        item = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(0, 120)))
        assert decontaminate.edit_distance_within(item, text) == sellers(item, text)


def test_decontamination_finds_edited_items(spark):
    rng = random.Random(4)
    items = [prose(rng, 12) for _ in range(6)] + ["Tiny item", None, "", "?!"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(0, items[0])], "item_id long, text string")
    broken = list(items[1])
    for k in range(0, len(broken), max(1, len(broken) // 5)):
        broken[k] = "q"
    texts = [prose(rng, 20) + "\n" + items[0].upper() + "! " + prose(rng, 5), "x " + "".join(broken) + " y", prose(rng, 50), None, "", "a tiny, item here", items[2][: len(items[2]) // 2]]
    got = decontaminate.find_leaks(documents(spark, texts), bench, block_chars=200).collect()
    errors = decontaminate.error_budget(len(items[1]), 0.05, 40)
    want = []
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            p = decontaminate.plain(item)
            limit = decontaminate.error_budget(len(p), 0.05, 40)
            p, held = (p, decontaminate.plain(t)) if limit or not p else (f" {p} ", f" {decontaminate.plain(t)} ")
            if p and t and sellers(p, held) <= limit:
                want.append((d, i, sellers(p, held)))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want) and (0, 0, 0) in want and (5, 6, 0) in want and errors > 0
    assert decontaminate.find_leaks(documents(spark, texts), bench.where("false")).count() == 0


def test_decontamination_of_odd_items_and_documents(spark, tmp_path):
    bench = spark.createDataFrame([(1, "the first text of a doubled item, long enough for edits"), (1, "another text of it that is long enough for edits"), (None, "an item without an id that is long enough to count"), (3, "cat")], "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    texts = ["x The first text of a doubled item, long enough for edits", "another text of it that is long enuogh for edits y", "an item without an id that is long enough to count", "concatenate", "a Cat!", "the cat sat", None, "", "long " * 60000 + " cat"]
    docs = documents(spark, texts, [0, 1, None, 3, 4, 4, 6, 7, 8])
    for size in (8_000_000, 60):
        got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.find_leaks(docs, bench, block_chars=size).collect()}
        assert got == {(0, 1): 0, (1, 1): 2, (None, None): 0, (4, 3): 0, (8, 3): 0}
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet")), bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = {r.doc_id: r for r in decontaminate.op6_decontaminate(spark, str(tmp_path)).collect()}
    assert rows[None].n_items == 1 and rows[None].item_ids == [None] and rows[3].n_items == 0 and rows[4].item_ids == [3]


def test_language_id(spark):
    rng = random.Random(6)
    tongues = {"aa": "the ing and ed sh th er".split(), "bb": "que eau oi le ment ère é".split(), "cc": "ung sch ein ich ü ß der".split()}
    rows = [(i, " ".join("".join(rng.choices(s, k=3)) for _ in range(30)), k) for i, (k, s) in enumerate(list(tongues.items()) * 40)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 .. !", "bb"), (902, "the ing", None)], "doc_id long, text string, lang string").withColumn("score", F.lit(9))
    got = {r.doc_id: r for r in identify(docs, learn_prototypes(docs.where(~held_out()))).collect()}
    assert sum(got[i].lang_pred == k for i, _, k in rows) == len(rows)
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0 and got[902].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(docs, {}).where("lang_pred <> 'und'").count() == 0


def test_language_id_of_other_scripts_long_texts_and_empty_tables(spark):
    rng = random.Random(11)
    letters = {k: range(first, first + 8) for k, first in {"el": 0x3B1, "ru": 0x430, "ja": 0x3041, "zh": 0x4E00, "ko": 0xAC00}.items()}
    rows = [(i, "".join(chr(rng.choice(letters[k])) if rng.random() < 0.8 else " " for _ in range(60)), k) for i, k in enumerate(list(letters) * 30)]
    docs = spark.createDataFrame([*rows, (500, "".join(chr(rng.choice(letters["ru"])) for _ in range(300_000)), None), (501, rows[0][1], None), (501, rows[0][1], None), (None, rows[1][1], None)], "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    learnt = learn_prototypes(docs.where(~held_out()))
    got = identify(docs, learnt).collect()
    by_id = {r.doc_id: r.lang_pred for r in got}
    assert len(got) == len(rows) + 4 and sum(by_id[i] == k for i, _, k in rows) == len(rows)
    assert by_id[500] == "ru" and by_id[501] == "el" and by_id[None] == "ru"
    assert learn_prototypes(docs.where("false")) == {} and identify(docs.where("false"), learnt).count() == 0
    tie = {"b": learnt["ru"], "a": learnt["ru"]}
    assert {r.lang_pred for r in identify(docs.where("doc_id = 500"), tie).collect()} == {"a"}


def lines_by_pairs(texts):
    """For each text its lines and those that the rule removes: lines of a pair that stood further up or in an earlier text."""
    seen, out = set(), []
    for t in texts:
        lines, gone = [] if t is None else t.split("\n"), set()
        for i, pair in enumerate(itertools.pairwise(lines)):
            if any(x.strip(" ") for x in pair):
                gone.update({i, i + 1} if pair in seen else ())
                seen.add(pair)
        out.append((lines, gone))
    return out


def test_line_dedup_by_brute_force(spark, awkward):
    rng = random.Random(8)
    block = [prose(rng, 6) for _ in range(12)]
    texts = [*awkward, "\n".join(block), "\n".join([prose(rng, 5), *block, prose(rng, 5)]), "\n".join(block), "a\nb\na\nb\na\nb", "\n\n\n\n", "same\n" * 3000]
    texts += ["p\nx\nq\ny\nr\nz", "1\np\nq\n2", "3\np\nq\nr\n4", "q\nr"]  # first in other surroundings; runs of two and three
    want = {d: (len(lines), "\n".join(x for k, x in enumerate(lines) if k not in gone)) for d, (lines, gone) in enumerate(lines_by_pairs(texts))}
    got = {r.doc_id: (r.n_lines, r.kept) for r in line_dedup.remove_repeated_lines(documents(spark, texts)).collect()}
    assert got == want
    coarse = {r.doc_id: r for r in line_dedup.remove_repeated_lines(documents(spark, texts), divisor=3).collect()}
    assert all(set(range(len(lines))) - gone <= {k for k in range(len(lines)) if not any(x["first"] - 1 <= k < x["last"] for x in coarse[d].removed)} for d, (lines, gone) in enumerate(lines_by_pairs(texts)))
    assert line_dedup.remove_repeated_lines(documents(spark, ["x\ny", "x\ny"], [None, None])).where("size(removed) > 0").count() == 0
    assert line_dedup.remove_repeated_lines(documents(spark, ["x"]).where("false")).count() == 0


def test_line_dedup_keeps_lines_whose_hashes_lie(spark):
    """Of an island with a run that differs from its first place, only the runs that agree go."""
    runs = "array<struct<first:int,last:int>>"
    rows = spark.createDataFrame([([(7, 8), (1, 2), (2, 4), (5, 5)],), ([],)], f"r {runs}")
    assert [[tuple(x) for x in r.m] for r in rows.select(line_dedup._merged(F.col("r")).alias("m")).collect()] == [[(1, 5), (7, 8)], []]


def test_line_dedup_finds_planted_passages(spark):
    """Passages of two lines or more in new surroundings: all of their lines go, and no other line does."""
    rng = random.Random(13)
    passages = [[prose(rng, 9) for _ in range(rng.randrange(2, 14))] for _ in range(40)]
    texts, planted = [], 0
    for i in range(200):
        lines = [prose(rng, 7) for _ in range(rng.randrange(2, 9))]
        at = rng.randrange(len(lines) + 1)
        texts.append("\n".join([*lines[:at], *passages[i % 40], *lines[at:]]))
        planted += len(passages[i % 40]) if i >= 40 else 0
    got = line_dedup.remove_repeated_lines(documents(spark, texts)).collect()
    held = {x for p in passages for x in p}
    removed = 0
    for r in got:
        gone = Counter(texts[r.doc_id].split("\n")) - Counter(r.kept.split("\n"))
        assert set(gone) <= held and (r.doc_id >= 40 or not gone)
        removed += sum(gone.values())
    assert removed == planted


def test_line_dedup_of_a_very_long_text(spark):
    long = "\n".join(f"line {i} of the text" for i in range(200_000))
    got = {r.doc_id: r for r in line_dedup.remove_repeated_lines(documents(spark, [long, "x\n" + long + "\ny"])).collect()}
    assert not got[0].removed and got[1].n_lines == 200_002 and got[1].kept == "x\ny"


def table_by_turns(shards, slots):
    orders = [[(sharding._number(f"offset/{s}") + i * (sharding._number(f"skip/{s}") % (slots - 1) + 1)) % slots for i in range(slots)] for s in shards]
    owner, turn = {}, 0
    while len(owner) < slots:
        k = turn % len(shards)
        owner[next(x for x in orders[k] if x not in owner)] = k
        turn += 1
    return [owner[i] for i in range(slots)]


def test_sharding_table_and_moves(spark):
    names = sharding.shard_names(7)
    table = sharding.fill_table(names, 251)
    assert table.tolist() == table_by_turns(names, 251)
    assert max(Counter(table.tolist()).values()) - min(Counter(table.tolist()).values()) <= 1
    fewer = sharding.fill_table(names[:-1], 251)
    moved = sum(names[a] != names[:-1][b] for a, b in zip(table, fewer, strict=True))
    assert moved < 251 * 0.4
    with pytest.raises(ValueError):
        sharding.fill_table(names, 250)
    docs = documents(spark, ["a", "b", "c", "d"], [1, 1, None, 2])
    got = sharding.place(docs, names, slots=251).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.doc_id == 1}) == 1


def test_write_shards_round_trip(spark, tmp_path):
    docs = documents(spark, [f"t{i}" for i in range(50)])
    sharding.write_shards(docs, sharding.shard_names(3), str(tmp_path / "out"), slots=251)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"t{i}" for i in range(50))


def test_mixing_meets_targets(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["s0"] * 6 + ["s1", None]), rng.choice(["en", "de"]), rng.choice([None, 1, 2]), rng.randrange(0, 50)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, tokens long").withColumn("rate", F.lit(3))
    out = mixing.mix(docs, ["source", "lang", "topic"], share=0.6).toPandas()
    kept = (out.tokens * out.rate).sum() / out.tokens.sum()
    assert len(out) == 3000 and abs(kept - 0.6) < 0.01 and out.rate.between(0, 1).all()
    uniform = mixing.mix(docs, ["lang"], {"lang": spark.createDataFrame([("en", 0.9), ("de", 0.1), ("xx", 5.0)], "lang string, target double")}, share=0.3).toPandas()
    share = (uniform.tokens * uniform.rate).groupby(uniform.lang).sum()
    assert share["en"] / share.sum() == pytest.approx(0.9, abs=1e-6)
    assert out[out.tokens == 0].kept.all()
    assert mixing.mix(docs.where("false"), ["lang"]).count() == 0
