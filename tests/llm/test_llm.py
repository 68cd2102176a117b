"""Small fixtures with brute-force answers, and the dirty cases of every operator."""

import datetime as dt
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaris.llm import (
    encoding, leaks, mixture, neighbours, quota_sample, subjects, term_scores, term_stats, top_items,
)

T0 = dt.datetime(2024, 1, 1)
from lexaris.llm.words import plain
T1 = dt.datetime(2024, 1, 2)

TF = "doc_id long, term string, f double, seen_at timestamp, df long, w int, n long"
DIST = "doc_id long, cat_id long, d double, seen_at timestamp, label string, _need int"
DOCS = "doc_id long, label string, file string, bytes long, seen_at timestamp"
CATS = "doc_id long, cat_id long, name string, deg int, seen_at timestamp"
CAT2ID = "name string, cat_id long, subject string, gloss string"
TEXTS = "doc_id long, text string, source string, tokens long, word string, pos int, block int, words string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def tf_rows(spark, triples):
    return spark.createDataFrame([(d, t, f, T0, 9, 9, 9) for d, t, f in triples], TF)


def texts(spark, pairs):
    return spark.createDataFrame([(i, t, "s", 1, "x", 0, 0, "y") for i, t in pairs], TEXTS)


# ------------------------------------------------------------------ top items


def test_top_n_by_brute_force(spark):
    rng = random.Random(3)
    data = [
        (rng.choice([1, 1, 1, 2, None]), rng.choice([0.5, 0.5, 0.25, 1e300, -1e300, float("nan"), float("inf"), None]), rng.choice(["a", "ab", "ä", "", None]), i)
        for i in range(3000)
    ]
    df = spark.createDataFrame(data, "g long, s double, t string, i long")

    def key(r):
        s = (4, 0) if r[1] is None else (3, 0) if r[1] != r[1] else (2, 0) if r[1] == float("inf") else (1, r[1])
        return s, (r[2] is None, (r[2] or "").encode()), r[3]

    for n in (1, 7, 500):
        want = []
        for g in (1, 2):
            want += [r[3] for r in sorted((r for r in data if r[0] == g), key=key)[:n]]
        got = top_items.top_n(df, ["g"], [("s", "double"), ("t", "string"), ("i", "long")], n)
        assert sorted(r["i"] for r in got.collect()) == sorted(want)


def test_nearest_documents_dirt(spark):
    docs = spark.createDataFrame(
        [(1, "b", "f1", 0, T0), (1, "a", "f1", 0, T1), (2, None, "ab", 0, T0), (3, "ab", "f", 0, T0), (3, "ab", "f", 0, T0), (None, "z", "z", 0, T0)], DOCS
    )
    dist = spark.createDataFrame(
        [(1, 7, 0.5, T0, "", 0), (2, 7, 0.5, T0, "", 0), (3, 7, 0.5, T0, "", 0), (3, 7, 0.5, T0, "", 0), (9, 7, 0.1, T0, "", 0),
         (1, 8, 0.1, T0, "", 0), (1, 8, None, T1, "", 0), (2, 8, float("nan"), T0, "", 0), (3, 8, -1.0, T0, "", 0), (None, 8, 0.0, T0, "", 0), (3, 9, 2.0, T0, "", 0)], DIST
    )
    got = top_items.nearest_documents(dist, docs, 2).select("cat_id", "doc_id")
    assert rows(got) == [(7, 1), (7, 2), (9, 3)]
    assert rows(top_items.nearest_documents(dist.limit(0), docs, 2)) == []
    assert rows(top_items.nearest_documents(dist, docs.limit(0), 2)) == []


# ------------------------------------------------------------------ quota sample


def quota_tables(spark, n=900):
    rng = random.Random(5)
    cat2id = spark.createDataFrame([("01_Äpfel", 1, "a", ""), ("birnen", 2, "a", ""), ("kirschen", 3, "b", "")], CAT2ID)
    docs = spark.createDataFrame([(i, None, "f", 0, T0) for i in range(n)], DOCS)
    mem = [(i, rng.choice([1, 1, 1, 1, 2]), None, 1, T0) for i in range(n - 5)] + [(n - 4, None, " BIRNEN ", None, T0), (n + 7, 3, None, 1, T0)]
    mem += [(0, None, "äpfel", 1, T1), (0, 2, None, 1, T1), (None, 2, None, 1, T0), (3, None, "unknown", 1, T0)]
    return docs, spark.createDataFrame(mem, CATS), cat2id


def test_quota_sample(spark):
    docs, mem, cat2id = quota_tables(spark)
    pool = quota_sample.pool(docs, mem, cat2id)
    assert pool.groupBy("doc_id").count().where("count > 1").isEmpty()
    assert rows(pool.where("doc_id = 0")) == [(0, 1)]
    wanted = spark.createDataFrame([("Äpfel", 0.5, 10, 1), ("Äpfel", 0.5, 10, 1), ("02_birnen", 0.3, 5, 1), ("kirschen", 0.0, 4, 1), ("none", 0.2, 1, 1)], "name string, target_share double, min_docs long, cat_id long")
    t = quota_sample.targets(wanted, cat2id)
    assert t.count() == 3
    state = quota_sample.reservoirs(pool)
    plan = quota_sample.quotas(state, t, 0.5)
    by = {r["cat_id"]: r for r in plan.collect()}
    total = pool.count()
    assert sum(r["quota"] for r in by.values()) <= total // 2
    assert by[3]["exhausted"] and by[3]["quota"] == 0 and not by[1]["exhausted"]
    assert rows(quota_sample.report(plan)) == [(3,)]
    got = quota_sample.sample(pool, plan, state)
    counts = Counter(r["cat_id"] for r in got.collect())
    assert counts == {c: r["quota"] for c, r in by.items() if r["quota"]}
    assert got.count() == got.select("doc_id").distinct().count()


def test_reservoirs_merge(spark):
    docs, mem, cat2id = quota_tables(spark)
    pool = quota_sample.pool(docs, mem, cat2id)
    a, b = pool.where("doc_id % 2 = 0"), pool.where("doc_id % 2 = 1")
    merged = quota_sample.reservoirs(a).union(quota_sample.reservoirs(b)).groupBy("cat_id", "slot").agg(F.sum("n").alias("n"))
    assert rows(merged) == rows(quota_sample.reservoirs(pool))


def test_quota_empty(spark):
    docs, mem, cat2id = quota_tables(spark, 20)
    pool = quota_sample.pool(docs.limit(0), mem, cat2id)
    state = quota_sample.reservoirs(pool)
    wanted = spark.createDataFrame([("birnen", 0.3, 5)], "name string, target_share double, min_docs long")
    plan = quota_sample.quotas(state, quota_sample.targets(wanted, cat2id), 0.5)
    assert rows(quota_sample.report(plan)) == [(2,)]
    assert rows(quota_sample.sample(pool, plan, state)) == []


def test_quota_refill_follows_targets(spark):
    names = [("a", 1, "x", ""), ("b", 2, "x", ""), ("c", 3, "x", ""), ("d", 4, "x", "")]
    cat2id = spark.createDataFrame(names, CAT2ID)
    # d is exhausted; a is small in share but has most of the spare documents
    state = spark.createDataFrame([(1, 0, 700), (2, 0, 150), (3, 0, 141), (4, 0, 10)], "cat_id long, slot int, n long")
    wanted = spark.createDataFrame([("a", 0.1, 1), ("b", 0.1, 1), ("c", 0.1, 1), ("d", 0.7, 1)], "name string, target_share double, min_docs long")
    quota = {r["cat_id"]: r["quota"] for r in quota_sample.quotas(state, quota_sample.targets(wanted, cat2id), 0.401).collect()}
    assert quota == {1: 131, 2: 130, 3: 130, 4: 10}  # S = 401
    # b and c run out on the way; the quotas still sum to S = 700
    quota = {r["cat_id"]: r["quota"] for r in quota_sample.quotas(state, quota_sample.targets(wanted, cat2id), 0.7).collect()}
    assert quota == {1: 399, 2: 150, 3: 141, 4: 10}


def test_quotas_sum_to_size():
    rng = random.Random(11)
    for _ in range(300):
        cats = [(c, rng.choice([0, 3, 50, 4000]), rng.choice([0.0, 0.01, 0.2, rng.random()]), rng.choice([0, 2, 30])) for c in range(rng.randint(1, 12))]
        total = sum(n for _, n, _, _ in cats)
        size = rng.randint(0, total + 5)
        quota = quota_sample.shares_out(cats, size)
        assert sum(quota.values()) == max(min(size, total), sum(min(n, least) for _, n, _, least in cats))
        assert all(min(n, least) <= quota[c] <= n for c, n, _, least in cats)
        # between their bounds the quotas are one multiple of the shares, but for rounding
        free = [(t, quota[c]) for c, n, t, least in cats if t > 0 and least + 1 < quota[c] < n - 1]
        for t, q in free:
            assert all((q - 1) * u <= (p + 1) * t + 1e-9 for u, p in free)


# ------------------------------------------------------------------ terms

DIRTY_TF = [
    (1, "Haus ", 4.0), (1, "über", 1.0), (1, None, 3.0), (1, "  ", 3.0), (2, "Haus", 5.0), (2, "weg", None),
    (2, "null", 0.0), (2, "minus", -1.0), (3, "Haus", 1.5), (3, "haus", 1.0), (None, "Haus", 9.0), (3, "x" * 20_000, 1.0),
]


def test_term_frequencies(spark):
    df = tf_rows(spark, DIRTY_TF).union(spark.createDataFrame([(1, "Haus", 6.0, T1, 0, 0, 0), (1, "Haus", 6.0, T1, 0, 0, 0)], TF))
    got = {r["term"]: r for r in term_stats.frequencies(df, 2, 2, 0.9).collect()}
    assert (got["Haus"]["gf"], got["Haus"]["df"], got["Haus"]["mark"]) == (12.5, 3, "common")
    assert got["über"]["mark"] == "rare" and set(got) == {"Haus", "über", "haus", "x" * 20_000}
    assert rows(term_stats.frequencies(df.limit(0), 2, 2, 0.9)) == []


def test_containers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 300, term_stats.DENSE, term_stats.DENSE + 1, 50_000):
        x = rng.choice(1 << 16, size=n, replace=False)
        c = term_stats.pack(np.concatenate([x, x]))
        assert (term_stats.unpack(c) == np.sort(x)).all()
        y = rng.choice(1 << 16, size=100, replace=False)
        assert set(term_stats.unpack(term_stats.union(c, term_stats.pack(y)))) == set(x) | set(y)


def test_bitmaps_dense_and_over_chunks(spark):
    df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("w").alias("term"), F.lit(1.0).alias("f"), F.lit(T0).alias("seen_at"))
    df = df.union(df.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    assert rows(term_stats.frequencies(df, 1, 1, 2.0)) == [("w", 60_000.0, 60_000, None)]
    assert term_stats.documents(term_stats.vertical(df)).agg(F.sum("n")).first()[0] == 60_000


def test_distinctive_terms(spark):
    got = {(r["doc_id"], r["term"]): r for r in term_scores.distinctive_terms(tf_rows(spark, DIRTY_TF)).collect()}
    one = got[1, "Haus"]
    assert one["df"] == 3 and one["share"] == pytest.approx(4 / 5)
    assert one["score"] == pytest.approx(4 / 5 * (np.log(4 / 4) + 1))
    # at equal share the rarer term scores more
    assert got[3, "haus"]["score"] / got[3, "haus"]["share"] > got[3, "Haus"]["score"] / got[3, "Haus"]["share"]
    assert rows(term_scores.distinctive_terms(tf_rows(spark, DIRTY_TF).limit(0))) == []


def test_outstanding_terms(spark):
    df = tf_rows(spark, [(1, "a", 4.0), (1, "b", 3.0), (2, "a", 1.0), (2, "b", 9.0), (3, "c", 9.0)])
    assert rows(term_scores.outstanding_terms(term_scores.distinctive_terms(df))) == [(1, "a"), (2, "b")]


# ------------------------------------------------------------------ subjects


def test_subjects_propagate(spark):
    rng = random.Random(2)
    fields = {s: [f"{s}{i}" for i in range(12)] for s in ("law", "sport", "music")}
    tf, mem = [], []
    for d in range(240):
        s = ("law", "sport", "music")[d % 3]
        both = d % 40 == 5
        for t in rng.sample(fields[s], 5) + (rng.sample(fields["music"], 5) if both else []):
            tf.append((d, t, 2.0))
        tf += [(d, w, 3.0) for w in ("everyday", "word")]
        if d % 2 == 0:
            mem.append((d, ("law", "sport", "music").index(s) + 1, None, 1, T0))
    tf.append((900, "everyday", 5.0))
    cat2id = spark.createDataFrame([("a", 1, "law", ""), ("b", 2, "sport", ""), ("c", 3, "music", "")], CAT2ID)
    got = subjects.subject_areas(tf_rows(spark, tf), spark.createDataFrame(mem, CATS), cat2id)
    found = defaultdict(set)
    for r in got.where("not seed").collect():
        found[r["doc_id"]].add(r["subject"])
    for d in range(1, 240, 2):
        want = {("law", "sport", "music")[d % 3]} | ({"music"} if d % 40 == 5 else set())
        assert found[d] == want
    assert 900 not in found
    assert {r["doc_id"] for r in got.where("seed").collect()} == {m[0] for m in mem}


def test_subjects_propagate_along_a_chain(spark):
    """Words that no seed has get their subject from documents that got theirs in the round before."""
    tf, labelled = [], []
    for s in ("law", "sport", "music"):
        for step in range(5):  # documents of a step share words with the step before and bring new ones
            for j in range(30):
                doc = {"law": 0, "sport": 1000, "music": 2000}[s] + step * 100 + j
                tf += [(doc, f"{s}{k}-{i}", 2.0) for k in (step, step + 1) for i in range(6) if (i + j) % 3]
                if step == 0:
                    labelled.append((doc, s))
    df = spark.createDataFrame(tf, "doc_id long, term string, f double")
    seeds = spark.createDataFrame(labelled, "doc_id long, subject string")
    reached = []
    for rounds in (1, 2, 12):
        found, _ = subjects.propagate(df, seeds, rounds)
        reached.append({(r["doc_id"] // 1000, r["doc_id"] // 100 % 10) for r in found.collect()})
    assert len(reached[0]) < len(reached[1]) < len(reached[2]) == 15
    name = {0: "law", 1: "sport", 2: "music"}
    assert all(r["subject"] == name[r["doc_id"] // 1000] for r in found.collect())


def test_chance_is_tested_at_every_size():
    shares = [0.7, 0.3]
    # of lemmas strewn at random most agree on a subject that holds most documents; they are told from proper ones at any size
    for n in (20, 60, 500):
        m = round(0.72 * n)
        counts = {(n, round(p * n)): c for p, c in ((0.45, 40), (0.55, 300), (0.62, 700), (0.72, 900), (0.8, 300))}
        counts[n, n] = 50
        good = subjects.by_chance(counts, shares)
        assert (n, n) in good
        assert (n, m) not in subjects.by_chance({(n, n // 2): 30, (n, m): 3}, shares) or n > 400


def test_subjects_of_seeds_with_many(spark):
    rng = random.Random(12)
    names = [f"s{i}" for i in range(10)]
    tf, labelled = [], []
    for d in range(300):
        for s in rng.sample(names, 5):  # five subjects each: a pure lemma starts at a fifth
            labelled.append((d, s))
            tf += [(d, f"{s}-{i}", 2.0) for i in rng.sample(range(4), 3)]
    tf += [(1000 + j, f"{s}-{i}", 2.0) for j, s in enumerate(names) for i in range(4)]
    seeds = spark.createDataFrame(labelled, "doc_id long, subject string")
    found, _ = subjects.propagate(spark.createDataFrame(tf, "doc_id long, term string, f double"), seeds)
    assert rows(found.where("doc_id >= 1000").select("doc_id", "subject")) == [(1000 + j, s) for j, s in enumerate(names)]


def test_subjects_empty(spark):
    cat2id = spark.createDataFrame([("a", 1, "law", "")], CAT2ID)
    none = spark.createDataFrame([], CATS)
    assert rows(subjects.subject_areas(tf_rows(spark, [(1, "x", 1.0)]), none, cat2id)) == []
    assert rows(subjects.subject_areas(tf_rows(spark, DIRTY_TF).limit(0), none, cat2id)) == []


# ------------------------------------------------------------------ neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((60, 64))
    x = np.concatenate([centres[i % 60] + 0.15 * rng.standard_normal(64) for i in range(900)]).reshape(-1, 64)
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0) * rng.uniform(0.5, 3, (300, 1))])  # a quarter alike
    raw = [(i, v.tolist(), 1.0, T0) for i, v in enumerate(x)]
    raw += [(5000, None, 1.0, T0), (5001, [1.0], 1.0, T0), (5002, [0.0] * 64, 1.0, T0), (5003, [float("nan")] * 64, 1.0, T0), (None, [1.0] * 64, 1.0, T0), (7, x[7].tolist(), 1.0, T0)]
    df = spark.createDataFrame(raw, "id long, x array<double>, norm double, seen_at timestamp")
    v = neighbours.valid_vectors(df, versions=True)
    assert v.count() == len(x)
    best = neighbours.nearest(v, 5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = np.round(u @ u.T, 9)
    np.fill_diagonal(sims, -2)
    want = {i: set(np.lexsort((np.arange(len(x)), -sims[i]))[:5]) for i in range(len(x))}
    got = defaultdict(set)
    for r in best.collect():
        got[r["id"]].add(r["other"])
    assert all(len(g) == 5 for g in got.values()) and len(got) == len(x)
    assert np.mean([len(got[i] & want[i]) / 5 for i in want]) >= 0.9
    assert got[1100] == want[1100]


def test_neighbours_small_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0] + [0.0] * 63, 1.0), (2, [2.0] + [0.0] * 63, 1.0)], "id long, x array<double>, norm double")
    v = neighbours.valid_vectors(df, versions=False)
    assert rows(neighbours.similar_pairs(neighbours.nearest(v, 5), 0.9)) == [(1, 2)]
    assert rows(neighbours.nearest(v.limit(0), 5)) == []


def test_lists_beyond_the_first_words():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((800, 64))
    s = neighbours.Settings(books=3, words=8)
    index = neighbours.fit(x, 900, s)  # 800 rows allow 200 first words
    assert len(index.books[0]) == 200 and index.parts > 1 and 400 < index.lists <= 1000
    codes = neighbours.encode(x, index.books, s.beam)
    own, probed = index.list_of(codes), index.probed(x, 12)
    assert probed.shape == (800, 12) and all(len(set(p)) == 12 for p in probed) and probed.max() < index.lists
    assert np.mean([o in p for o, p in zip(own, probed)]) > 0.9


def test_beam_search_lowers_error():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((500, 64))
    s = neighbours.Settings(books=4, words=16)
    books = neighbours.fit(x, 16, s).books

    def error(beam):
        codes = neighbours.encode(x, books, beam)
        return ((x - sum(b[codes[:, i]] for i, b in enumerate(books))) ** 2).sum()

    assert error(8) <= error(1)


# ------------------------------------------------------------------ leaks

ITEM = "Der große Müller öffnet früh am Morgen das alte Tor und zählt die weißen Säcke neben der Brücke am Fluss"


def edited(words, edits):
    w = list(words)
    for at in edits:
        w[at] = "anders"
    return w


def test_plain_words(spark):
    got = spark.range(1).select(plain(F.lit("<b>Über-\nsetzer</b> sœur, Strasse Straße naïve's")), plain(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("ubersetzer sour strasse strasse naives", None)


def test_leaks(spark):
    w = ITEM.split()
    items = spark.createDataFrame([(1, "s", "de", ITEM), (1, "s", "de", ITEM), (2, "s", "de", "zu kurz"), (3, "s", "de", None), (None, "s", "de", ITEM)], "item_id long, suite string, lang string, text string")
    plain = ITEM.lower().replace("ü", "ue").replace("ö", "o").replace("ß", "ss")
    cases = {
        1: (ITEM, True),
        2: ("vorher " + " ".join(w[2:16]) + " nachher", True),
        3: (" ".join(w[2:15]), False),  # 13 words
        4: (" ".join(edited(w[:14], [4, 9])), True),
        5: (" ".join(edited(w[:14], [3, 7, 11])), False),
        6: (plain.replace("morgen", "mor-\ngen").replace("tor", "<b>„Tor“</b>,"), True),
        7: (" ".join(sorted(w)), False),
        8: (" ".join(w[:5] + ["neu"] + w[5:10] + w[11:16]), True),  # put in, left out
        9: (None, False),
        10: ("", False),
        11: ("wort " * 30_000 + ITEM + " wort" * 30_000, True),
    }
    docs = texts(spark, [(i, t) for i, (t, _) in cases.items()] + [(1, ITEM), (None, ITEM)])
    assert rows(leaks.leaked(docs, items)) == sorted([(i, 1) for i, (_, hit) in cases.items() if hit], key=str)
    assert rows(leaks.leaked(docs.limit(0), items)) == []
    assert rows(leaks.leaked(docs, items.limit(0))) == []


def test_leaks_of_common_instructions(spark, monkeypatch):
    monkeypatch.setattr(leaks, "SPREAD", 7)  # common shingles are dealt to many keys
    monkeypatch.setattr(leaks, "BROADCAST_ROWS", 0)
    start = "Lies den folgenden Text genau und nenne dann die richtige der Antworten"
    tails = [" ".join(f"wort{i}x{j}" for j in range(12)) for i in range(30)]
    items = [(i, f"{start} {t}") for i, t in enumerate(tails)] + [(5, "ein zweiter Text unter derselben Nummer " + " ".join(f"z{j}" for j in range(14)))]
    docs = [(d, f"vorher {start} " + " ".join(f"fremd{d}x{j}" for j in range(20))) for d in range(60)]
    docs += [(100 + i, f"{start} {tails[i]}") for i in range(0, 30, 3)] + [(200, " ".join(f"z{j}" for j in range(14)))]
    got = leaks.leaked(texts(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(got) == sorted([(100 + i, i) for i in range(0, 30, 3)] + [(200, 5)], key=str)


def test_leaks_against_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(40)]
    items = {i: [rng.choice(vocab) for _ in range(rng.randint(14, 40))] for i in range(20)}
    docs = {}
    for d in range(150):
        it = items[rng.randrange(20)]
        a = rng.randrange(len(it) - 13)
        part = it[a : a + rng.randint(12, 40)]
        out = []
        for word in part:
            r = rng.random()
            out += [] if r < 0.04 else ["new"] if r < 0.08 else ["new", word] if r < 0.12 else [word]
        docs[d] = [rng.choice(vocab) for _ in range(rng.randrange(60))] + out + [rng.choice(vocab) for _ in range(20)]
    want = {(d, i) for d, t in docs.items() for i, it in items.items() if leaks.run_found(it, t)}
    idf = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    assert {tuple(r) for r in leaks.leaked(texts(spark, [(d, " ".join(t)) for d, t in docs.items()]), idf).collect()} == want
    assert len(want) > 30


# ------------------------------------------------------------------ mixture


def test_mixture(spark):
    rng = random.Random(8)
    docs = [(i, "wort " * rng.randint(1, 50), rng.choice([" Big", "big", "small", "other", None])) for i in range(800)] + [(900, None, "big"), (901, "", "small"), (None, "x", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    mix = spark.createDataFrame([("BIG", 1.0, 2, 5), ("BIG", 1.0, 2, 5), ("small", 2.0, 1, 5), ("none", 0.1, 9, 5)], "source string, weight double, max_repeats long, own long")
    sizes = mixture.token_sizes(df)
    sums = mixture.histogram(sizes)
    plan = mixture.budgets(sums, mix)
    by = {r["source"]: r for r in plan.collect()}
    assert by["none"]["exhausted"] and by["small"]["exhausted"] and not by["BIG"]["exhausted"]
    mixed = mixture.mix(sizes, sums, plan)
    got = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.max("n").alias("m")).collect()
    for r in got:
        b = by[{"big": "BIG"}.get(r["source"], r["source"])]
        budget = b["copies"] * b["own"] + b["rest"]
        assert r["m"] <= b["max_repeats"] and budget - 60 <= r["t"] <= budget + 1e-6
    shares = {r["source"]: r["actual_share"] for r in mixture.report(mixed, plan).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["none"] == 0
    empty = mixture.histogram(sizes.limit(0))
    assert {r["source"] for r in mixture.budgets(empty, mix).where("exhausted").collect()} == set()
    assert rows(mixture.mix(sizes.limit(0), empty, mixture.budgets(empty, mix))) == []


def test_pieces_keep_the_text():
    for t in ("", "a", "x y\n" * 90_000, "z" * 350_000):
        assert "".join(mixture._pieces(t)) == t


# ------------------------------------------------------------------ encoding

SENTENCE = "Der Müller hört über Größe und schöne Brücken – café naïve Äpfel früh süß"


def broken(text, stored, read, times=1):
    for _ in range(times):
        text = text.encode(stored).decode(read, "replace")
    return text


def test_garbled_texts_round_trip(spark):
    clean = [(i, SENTENCE + f" Nummer {i}") for i in range(30)]
    odd = {
        100: broken(SENTENCE, "utf-8", "latin-1"), 101: broken(SENTENCE.replace("Ä", "ä"), "utf-8", "mac_roman"),
        102: broken(SENTENCE, "utf-8", "cp437"), 103: broken(SENTENCE, "utf-8", "latin-1", 2),
        104: broken(SENTENCE.replace("–", "-"), "cp1252", "cp437"),
        105: broken("vorher café", "cp1252", "utf-8"),
        106: "ganz gut aber M&#195;&#188;ller",
    }
    proper = {200: "São Paulo ÂGE MANHÃ, Ťažká Γλώσσα °C ±3 £40 ├── © &#252; &amp;", 201: None, 202: "", 203: "plain " * 10_000}
    docs = texts(spark, clean + list(odd.items()) + list(proper.items()) + [(100, odd[100]), (None, odd[100])])
    g = encoding.garbled_tokens(docs)
    assert {r["doc_id"] for r in g.select("doc_id").distinct().collect()} == set(odd)
    back = {r["doc_id"]: r["text"] for r in encoding.restored(docs, g).collect()}
    for i in (100, 102, 103):
        assert back[i] == SENTENCE
    assert back[105] == "vorher café" and back[106] == "ganz gut aber Müller"
    assert rows(encoding.garbled_tokens(docs.limit(0))) == []


def test_garbled_doc_of_learned_signs(spark):
    clean = [(i, SENTENCE) for i in range(30)]
    g = encoding.garbled_tokens(texts(spark, clean + [(50, broken("Müller über früh Brücken süß Kübelfüller", "cp1252", "mac_roman"))]))
    assert ("Kübelfüller",) in [(r["fixed"],) for r in g.collect()]


def test_unlisted_encoding_is_learned_by_alignment(spark):
    words = "Müller hört über Größe schöne Brücken früh süß König Hügel Löffel Rücken böse müde groß Straße heiß"
    clean = [(i, words) for i in range(20)]
    for read in ("cp775", "hp_roman8", "kz1048"):
        assert read not in encoding.READ_AS
        bad = words.encode("cp1252").decode(read)
        odd = [(50, bad), (51, bad), (52, "vorher " + "Bücherböden".encode("cp1252").decode(read) + " nachher")]
        g = encoding.garbled_tokens(texts(spark, clean + odd + [(60, "Møller mit Jørgen und Sørensen"), (61, "niño señor")]))
        back = {r["doc_id"]: r["text"] for r in encoding.restored(texts(spark, clean + odd), g).collect()}
        assert back == {50: words, 51: words, 52: "vorher Bücherböden nachher"}


def test_references_to_the_replacement_character(spark):
    clean = [(i, SENTENCE) for i in range(30)]
    odd = {50: "das M&#65533;ller Haus", 51: "das M&#xFFFD;ller&#65533;x Haus", 52: "das M�ller Haus", 53: "ganz &#xfffd; allein"}
    docs = texts(spark, clean + list(odd.items()) + [(60, "das M&#252;ller &amp; Haus &#8211;")])
    g = encoding.garbled_tokens(docs)
    assert {r["doc_id"] for r in g.select("doc_id").distinct().collect()} == set(odd)
    back = {r["doc_id"]: (r["text"], r["n_lost"]) for r in encoding.restored(docs, g).collect()}
    assert back[50] == back[52] == ("das Müller Haus", 0)
    assert back[51] == ("das M�ller�x Haus", 1) and back[53] == ("ganz � allein", 1)


RUSSIAN = "перевод старого романа перенесли через старую дорогу рано утром товарищи говорили дорогому доктору"


def test_rare_words_wholly_beyond_ascii(spark):
    clean = [(i, RUSSIAN) for i in range(30)]
    bad = broken(RUSSIAN, "cp1251", "cp1252")
    rare = broken("передано", "cp1251", "cp1252")
    # all signs learned: one rare word is enough
    back = {r["doc_id"]: r["text"] for r in restored(texts(spark, clean + [(50, bad), (51, rare)]))}
    assert back == {50: RUSSIAN, 51: "передано"}
    # the sign of one letter is mostly a proper French one: the other words of the document tell
    french = [(100 + i, "là déjà voilà") for i in range(40)]
    back = {r["doc_id"]: r["text"] for r in restored(texts(spark, clean + french + [(50, f"{bad} {rare}"), (51, rare)]))}
    assert back == {50: f"{RUSSIAN} передано"}


def restored(docs):
    return encoding.restored(docs, encoding.garbled_tokens(docs)).collect()
