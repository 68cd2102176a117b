"""Core operators on small fixtures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexaris.functions.math import erf, f1, f_beta, frac, gauss_cdf, harmonic, si
from lexaris.functions.text import clean_name, clean_term
from lexaris.functions import text as T
from lexaris.operators import classify, cluster, corpus, cutoff, evaluate, lsi, matrix, search, trim
from lexaris.operators.lemmatize import CAB, CONTENT, SEM, SEP, by_name, lemmatize
from lexaris.sources import readers, writers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_scalars(spark):
    lit = F.lit
    r = one(spark, frac(lit(0.0), lit(0.0)), frac(lit(1.0), lit(0.0)), frac(lit(1.0), lit(4.0)), harmonic(lit(0.0), lit(1.0)), harmonic(lit(0.5), lit(1.0)))
    assert tuple(r) == pytest.approx((1, 0, 0.25, 0, 2 / 3))
    r = one(spark, erf(lit(0.7)), erf(lit(-2.0)), gauss_cdf(lit(1.0), lit(0.0), lit(2.0)), f1(lit(0.5), lit(0.5)), f_beta(lit(0.5), lit(1.0)))
    assert r[0] == pytest.approx(math.erf(0.7), abs=2e-7) and r[1] == pytest.approx(math.erf(-2), abs=2e-7)
    assert r[2] == pytest.approx(0.5 * (1 + math.erf(0.5 / math.sqrt(2))), abs=2e-7) and r[3] == pytest.approx(0.5, abs=1e-4)
    assert one(spark, si(lit(1500.0)))[0] == "1.50K"


def test_text(spark):
    df = spark.createDataFrame([(" über ",), ("  ",), (None,), ("01_Äpfel",)], "t string")
    got = df.select(clean_term(F.col("t")), clean_name(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("über", "über"), (None, None), (None, None), ("01_Äpfel", "äpfel")]


def test_matrix_identities(spark):
    tdm = spark.createDataFrame([(d, t, float(f)) for d, t, f in [(1, "a", 3), (2, "a", 3), (1, "b", 5), (2, "c", 1)]], "doc_id long, term string, f double")
    w = {r["term"]: r["tw"] for r in matrix.weights(tdm, "doc_id", "entropy").collect()}
    assert w["a"] == pytest.approx(0) and w["b"] == pytest.approx(1)
    cells = matrix.weighted(tdm, matrix.weights(tdm, "doc_id", "Hq", raw=1.0), 1.001)
    back = cells.select("f", matrix.inverted(F.col("v"), F.col("tw"), 1.001).alias("g")).collect()
    assert all(r["f"] == pytest.approx(r["g"]) for r in back)
    assert [matrix.method_name(m) for m in ("u", "none", "Hmax", "Hc", "Hq", "entropy", "entropy-quotient", "max-entropy-quotient")] == [
        "uniform", "uniform", "max-entropy-quotient", "conditional-entropy", "entropy-quotient", "max-entropy-quotient", "entropy-quotient",
        "max-entropy-quotient",
    ]
    assert rows(trim.number(tdm, "term", "tid")) == [(0, "a"), (1, "b"), (2, "c")]


def test_svd_identities(spark):
    a = np.arange(1, 36, dtype=float).reshape(7, 5) ** 0.7
    cells = spark.createDataFrame([(d, f"t{t}", float(a[t, d])) for t in range(7) for d in range(5)], "doc_id long, term string, v double")
    s = lsi.svd(cells, "doc_id", 5, power=6)
    assert s.sigma == pytest.approx(np.linalg.svd(a)[1][: len(s.sigma)], rel=1e-6)
    x = {r["doc_id"]: np.array(r["x"]) for r in lsi.project(cells, "doc_id", s.factors, len(s.sigma)).collect()}
    u = np.stack([x[d] for d in range(5)])
    p = {r["term"]: np.array(r["p"]) for r in s.factors.collect()}
    v = np.stack([p[f"t{t}"] for t in range(7)]) * s.sigma
    assert v.T @ v == pytest.approx(np.eye(len(s.sigma)), abs=1e-6)
    assert u @ np.diag(s.sigma) @ v.T == pytest.approx(a.T, rel=1e-6)
    tw = spark.createDataFrame([(f"t{t}", 1.0) for t in range(7)], "term string, tw double")
    part = cells.where("not (doc_id = 0 and term = 't3')")
    smooth = {r["doc_id"]: np.array(r["x"]) for r in lsi.project_smoothed(part, "doc_id", s.factors, tw, 1.5, len(s.sigma)).collect()}
    dense = a[:, 0].copy()
    dense[3] = math.log(1.5)
    assert smooth[0] == pytest.approx(dense @ v / s.sigma, rel=1e-6)


def test_raw_distances_of_empty_sides(spark):
    tdm = spark.createDataFrame([(1, "a", 1.0)], "doc_id long, term string, f double")
    tcm = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0)], "term string, cat_id long, v double")
    docs, cats = spark.createDataFrame([(1,), (2,)], "doc_id long"), spark.createDataFrame([(1,), (2,)], "cat_id long")
    assert rows(classify.raw_distances(tdm, tcm, docs, cats)) == [(1, 1, 0.0), (1, 2, 1.0), (2, 1, 2.0), (2, 2, 2.0)]


def test_votes_sum_to_one(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.25), (1, 4, 0.1)], "doc_id long, other long, d double")
    dcm = spark.createDataFrame([(2, 1, 1), (3, 2, 1), (4, 1, 1)], "doc_id long, cat_id long, deg int")
    assert classify.neighbour_votes(near, dcm, 3).agg(F.sum("score")).first()[0] == pytest.approx(1)


def test_evaluation_totals(spark):
    both = spark.createDataFrame([("a", "1_x", "1_x"), ("b", "1_x", "2_y"), ("c", "2_y", "2_y"), ("d", "y", "1_x")], "label string, wanted string, got string")
    p = evaluate.pairs(both)
    cats = evaluate.by_category(p)
    assert p.agg(F.sum("ndocs")).first()[0] == 4
    assert {r["cat"]: r["tp"] + r["fn"] for r in cats.collect()} == {"1_x": 2, "2_y": 1, "y": 1}
    assert evaluate.null_category(cats).first()[0] == "1_x"
    modes = {r["mode"]: r for r in evaluate.global_modes(p, evaluate.classes(cats, p)).collect()}
    assert modes["all.total"]["tp"] == 2 and len(modes) >= 8
    assert [r["cat"] for r in cats.orderBy(*evaluate.category_order("cat")).collect()] == ["y", "1_x", "2_y"]


def test_cutoffs(spark):
    rng = np.random.default_rng(1)
    data = [(d, c, float(np.clip(rng.normal(0.4 if d % 3 == c else 1.2, 0.2), 0, 2))) for d in range(90) for c in range(3)]
    m = spark.createDataFrame(data, "doc_id long, cat_id long, d double")
    w = spark.createDataFrame([(d, d % 3) for d in range(90)], "doc_id long, cat_id long")
    cats = spark.createDataFrame([(0,), (1,), (2,), (3,)], "cat_id long")
    fits = cutoff.repaired(cutoff.fit(m, w), cats)
    cuts = cutoff.cutoffs(fits, sink=2)
    assert cuts.where("cutoff is null").isEmpty() and cuts.where("cat_id = 2").first()["cutoff"] == cutoff.NEVER
    cuts = cuts.where("cat_id < 3")
    decided = cutoff.decide(m, cuts)
    applied = cutoff.apply(classify.ranked(m), cuts, sink=2).where("deg = 1").select("doc_id", F.col("cat_id").alias("got"))
    assert rows(decided) == rows(applied)
    out = cutoff.optimize(m, w, cuts, rounds=15).first()
    assert out["fitness"] >= out["fitness0"]
    assert cutoff.fitness(decided, w).first()["F"] > 0.8


def test_split_is_balanced(spark):
    docs = spark.createDataFrame([(i, i % 2, 100 + i % 7) for i in range(400)], "doc_id long, cat_id long, n_bytes long")
    got = corpus.split(docs, 4, seed=3)
    assert got.count() == 400 and got.select("doc_id").distinct().count() == 400
    size = {(r["cat_id"], r["fold"]): r["n"] for r in got.join(docs.drop("cat_id"), "doc_id").groupBy("cat_id", "fold").agg(F.sum("n_bytes").alias("n")).collect()}
    for c in (0, 1):
        of = [size[c, f] for f in range(4)]
        assert max(of) - min(of) <= 106


def test_query_language():
    got = search.parse("Eisen:9 Erz;Erz:2, DOC=heft:3 bk:recht foo:1.5 x:0")
    assert got == [("term", "Eisen", 9.0), ("term", "Erz", 3.0), ("doc", "heft", 1.0), ("cat", "recht", 1.0), ("term", "foo:1.5", 1.0), ("term", "x", 1.0)]
    assert search.space_of(None, 2) == "cats" and search.space_of("terms", 2) == "terms" and search.space_of("pages", 2) == "docs"


def test_lemmatizers(spark):
    key = "norm=Bandfahrung\tpos=NN\tlemma=Band-Fahrung\tsep_lemma=Band/N#er|fahr/V~ung\tsem_lemma=SEM12x"
    t = spark.createDataFrame([(1, key, 2.0), (1, "norm=und\tpos=KON\tlemma=und", 1.0), (1, "norm=geht\tlemma=gehen", 1.0), (1, "norm=Haus\tpos=NN\tlemma=Haus\tsem_lemma=SEM1y", 1.0)], "doc_id long, key string, f double")
    get = lambda lz: {r["term"]: r["f"] for r in lemmatize(t, lz).collect()}
    assert get(CONTENT) == {"band-fahrung": 2.0, "haus": 1.0}
    assert get(CAB) == {"Band-Fahrung": 2.0, "Haus": 1.0}
    assert get(SEP) == {"band-fahrung": 2.0, "band": 4.0, "fahrung": 2.0, "erfahr": 2.0, "haus": 2.0}
    sem = get(SEM)
    assert sem["band-fahrung"] == 6.0 and sem["SEM12x"] == 20.0 and sem["SEM12"] == 20.0 and "SEM1y" not in sem and sem["haus"] == 3.0
    stop = spark.createDataFrame([("Haus",)], "text string")
    assert "haus" not in {r["term"] for r in lemmatize(t, CONTENT, stop).collect()}
    assert by_name("Lemmatizer::VzSem") is SEM


VZ = '<doc><head><title>T</title><classification><cat id="3" name="A&amp;B" degree="2"/><vat id="4" name="C" degree="1"/></classification></head><body><thread><title>TT</title><posts><post><plain>p1</plain></post></posts></thread><cooked><s><w norm="das  Haus" pos="NN" lemma="haus"/><w norm="geht"/></s></cooked></body></doc>'


def as_file(spark, content):
    return spark.createDataFrame([("f", content)], "file string, content string")


def test_xml_sources(spark):
    df = as_file(spark, VZ)
    assert rows(readers.vzxml(df)) == [("f", "norm=das Haus\tpos=NN\tlemma=haus", 1.0), ("f", "norm=geht", 1.0)]
    assert rows(readers.xml_categories(df)) == [("f", 3, "A&B", 2), ("f", 4, "C", 1)]
    assert rows(readers.xml_categories(as_file(spark, "<doc/>"), dummy=True)) == [("f", 1, "dummy", 1)]
    assert rows(readers.xml_text(df, readers.VZ_TEXT)) == [("f", "T\n\nTT\n\np1", None)]
    bad = readers.xml_text(df.unionByName(as_file(spark, "<doc><head>").withColumn("file", F.lit("g"))), readers.VZ_TEXT)
    assert [(r["file"], r["text"] is None, r["error"] is None) for r in bad.orderBy("file").collect()] == [("f", False, True), ("g", True, False)]
    odd = as_file(spark, """<doc><s><w norm="a>b" pos='x>"y'/><w norm="c/d"/></s></doc>""")
    assert rows(readers.vzxml(odd)) == [("f", "norm=a>b\tpos=x>\"y", 1.0), ("f", "norm=c/d", 1.0)]
    nested = as_file(spark, "<doc><p>a <b>b</b> c</p><q>no</q><s>d</s></doc>")
    assert readers.xml_text(nested, readers.CAB_TEXT).first()["text"] == "a b c\n\nd"
    clean = df.select(readers.clean_xml(F.col("content")).alias("c"), readers.head_and_first_post(F.col("content")).alias("h")).first()
    assert "<vat" not in clean["c"] and clean["h"].endswith("<post><plain>p1</plain></post>")
    cab = '<doc><s><w t="Häuser"><xlit latin1Text="Haeuser"/><moot word="Häuser" tag="NN" lemma="Haus"/></w></s></doc>'
    assert rows(readers.cabxml(as_file(spark, cab))) == [("f", "text=Häuser\txlit=Haeuser\tnorm=Häuser\tpos=NN\tlemma=Haus", 1.0)]


def test_line_sources(spark):
    one_gram = "%%$dc.cat.2=07_recht\n%% x\n\n1.5\tHaus\tHaus\tHaus\tNN\tHaus\n2\tHaus\tHaus\tHaus\tNN\tHaus\n"
    assert rows(readers.csv1g(as_file(spark, one_gram))) == [("f", "text=Haus\txlit=Haus\tnorm=Haus\tpos=NN\tlemma=Haus", 3.5)]
    assert rows(readers.comment_categories(as_file(spark, one_gram))) == [("f", 1, "07_recht", 2)]
    tabs = "%%$DDC:index[0]=Token w\n%%$DDC:index[1]=Lemma l\nHaus\thaus\nHaus\thaus\n"
    assert rows(readers.ddctabs(as_file(spark, tabs))) == [("f", "text=Haus\tlemma=haus", 2.0)]
    terms, cats = readers.signature_csv(as_file(spark, "<5> 7 recht\nhaus\t2\nlemma=x\tpos=y\t1.5\n"))
    assert rows(terms) == [("f", "haus", 2.0), ("f", "lemma=x\tpos=y", 1.5)] and rows(cats) == [("f", 7, "recht", 3)]
    sig = readers.signature_1g(as_file(spark, "%%$dc.terms\n1\ta\n%%$dc.lemmata\n2\tb\n"))
    assert rows(sig) == [("f", "lemmata", "b", 2.0), ("f", "terms", "a", 1.0)]
    assert rows(readers.category_list(as_file(spark, "# c\n\nrecht\tx\nsport\n"))) == [("recht",), ("sport",)]
    assert readers.mode_of("a.1g") == "csv1g" and readers.mode_of("a") == "xml"


def test_round_trips(spark, tmp_path):
    terms = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.5)], "doc_id long, term string, f double")
    cats = spark.createDataFrame([(1, 7, "recht", 1)], "doc_id long, cat_id long, name string, deg int")
    lines = [r["line"] for r in writers.signature_csv(terms, cats).orderBy("pos").collect()]
    assert lines == ["<1> 7 recht", "b\t3.5", "a\t2"]
    assert [r["line"] for r in writers.signature_1g(terms, cats).orderBy("pos").collect()] == ["%%$dc.cat.1=7_recht", "%%$dc.lemmata", "3.5\tb", "2\ta"]
    docs = spark.createDataFrame([(1, "l<&", "f", 3, "s", [(7, "recht", 1)])], "id long, label string, file string, bytes long, sigFile string, cat array<struct<id:long,name:string,deg:int>>")
    writers.corpus_xml(docs, str(tmp_path / "c"))
    back = readers.corpus_xml(spark, str(tmp_path / "c")).first()
    assert back["label"] == "l<&" and back["cat"][0]["name"] == "recht" and back["class"] is None
    writers.corpus_xml(docs.drop("sigFile"), str(tmp_path / "c2"), cats=False)
    assert readers.corpus_xml(spark, str(tmp_path / "c2")).first()["cat"] is None
    writers.write_lines(writers.signature_csv(terms, cats), str(tmp_path / "l"), 3)
    assert rows(writers.read_lines(spark, str(tmp_path / "l"))) == [("1", "<1> 7 recht\nb\t3.5\na\t2\n")]
    vectors = spark.createDataFrame([(1, [0.5, -2.0]), (2, [1e-9, 3.0])], "id long, x array<double>")
    writers.save_text_model({"v": vectors, "t": terms}, str(tmp_path / "t"))
    text = writers.load_text_model(spark, str(tmp_path / "t"), ["v", "t"])
    assert rows(text["v"]) == rows(vectors) and rows(text["t"]) == rows(terms)
    p = spark.createDataFrame([("a", "b", 3)], "cat1 string, cat2 string, ndocs long")
    writers.eval_xml(p, str(tmp_path / "e"))
    assert rows(readers.eval_xml(spark, str(tmp_path / "e")).select("cat1", "cat2", "ndocs")) == [("a", "b", 3)]
    writers.save_model({"terms": terms}, str(tmp_path / "m"), {"svdr": 16})
    assert rows(writers.load_model(spark, str(tmp_path / "m"), ["terms"])["terms"]) == rows(terms)
    assert writers.load_options(spark, str(tmp_path / "m")) == {"svdr": "16"}
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "deep" / "x.1g").write_text("1\ta\n2\tb\n")
    found = readers.files(spark, str(tmp_path / "in"), r"\.1g$")
    assert [r["content"] for r in found.collect()] == ["1\ta\n2\tb\n"]  # a file is one row
    assert {(r["key"], r["f"]) for r in readers.tokens(found).collect()} == {("text=a", 1.0), ("text=b", 2.0)}


def test_streaming(spark, tmp_path):
    from lexaris.streaming.classify import start

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "haus haus"), (2, "baum")], "doc_id long, text string").write.mode("overwrite").parquet(str(tmp_path / "in"))
    vocab = spark.createDataFrame([("haus",), ("baum",)], "term string")
    tcm = spark.createDataFrame([("haus", 1, 1.0), ("baum", 2, 1.0)], "term string, cat_id long, v double")
    start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), vocab, tcm).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "cat_id")) == [(1, 1), (2, 2)]


def test_plain_session_and_shared_folder(spark):
    """The reduced space needs no Arrow settings; a cluster without a shared folder is refused."""
    from lexaris import session

    class Cluster:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {"x": None})

    with pytest.raises(ValueError):
        session.shared_dir(Cluster)
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")
    try:
        cells = spark.createDataFrame([(0, "a", 3.0), (1, "b", 2.0)], "doc_id long, term string, v double")
        assert lsi.svd(cells, "doc_id", 2).sigma == pytest.approx([3, 2])
        empty = lsi.svd(cells.limit(0), "doc_id", 2)
        assert len(empty.sigma) == 0 and empty.factors.isEmpty()
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")


def test_sparse_fit_equals_dense_fit(spark):
    rng = np.random.default_rng(5)
    dist = spark.createDataFrame([(d, c, float(rng.uniform(0, 2))) for d in range(40) for c in range(4) if rng.random() < 0.4], "doc_id long, cat_id long, d double")
    wanted = spark.createDataFrame([(d, d % 3) for d in range(40)], "doc_id long, cat_id long")
    cats = spark.createDataFrame([(c,) for c in range(5)], "cat_id long")
    dense = cutoff.fit(cutoff.distance_matrix(dist, wanted, cats), wanted)
    key = lambda r: (r["cat_id"], r["is_member"])
    one, two = ({key(r): (r["n"], r["mu"], r["sd"]) for r in f.collect()} for f in (dense, cutoff.fit_sparse(dist, wanted, cats)))
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-7) for k in one)


@pytest.mark.parametrize("mutate", ["select", "bounds"])
def test_optimiser_draws(spark, mutate):
    m = spark.createDataFrame([(d, c, 0.2 + 0.1 * ((d * 7 + c * 3) % 11)) for d in range(30) for c in range(3)], "doc_id long, cat_id long, d double")
    w = spark.createDataFrame([(d, d % 3) for d in range(30)], "doc_id long, cat_id long")
    cats = spark.createDataFrame([(c,) for c in range(3)], "cat_id long")
    cuts = cutoff.cutoffs(cutoff.repaired(cutoff.fit(m, w), cats))
    out = cutoff.optimize(m, w, cuts, rounds=12, mutate=mutate, fitness_name="acc", brood=6, sink=1)
    first = out.first()
    assert first["fitness"] >= first["fitness0"]
    # what is reported is what the plain aggregation finds
    got = cutoff.fitness(cutoff.decide(m, out.select("cat_id", "cutoff")), w).first()["acc"]
    assert got == pytest.approx(first["fitness"])


def test_hierarchical_links_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9, 5))
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "cat_id long, x array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    dist = np.round(1 - u @ u.T, 9)
    for link, of in (("min", min), ("max", max), ("avg", lambda d: sum(d) / len(d))):
        groups, want = [[i] for i in range(9)], []
        while len(groups) > 1:
            d, a, b = min((of([dist[i, j] for i in p for j in q]), k, m) for k, p in enumerate(groups) for m, q in enumerate(groups) if k < m)
            want.append(d)
            groups = [g for k, g in enumerate(groups) if k not in (a, b)] + [groups[a] + groups[b]]
        steps = cluster.linked(items, "cat_id", link)
        assert [r["d"] for r in steps.orderBy("step").collect()] == pytest.approx(want, abs=1e-8)
        cut = cluster.cut_tree(steps, items, "cat_id", 3)
        assert cut.select("cluster").distinct().count() == 3 and cut.count() == 9


def test_search_end_to_end(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(3)]
    terms = spark.createDataFrame([("Eisen", unit(0), 9.0, 5), ("Erz", unit(1), 1.0, 1)], "term string, x array<double>, tf0 double, tdf0 long")
    docs = spark.createDataFrame([("heft.1", unit(0)), ("heft.2", unit(1)), ("buch", unit(2))], "label string, x array<double>")
    cats = spark.createDataFrame([("recht", unit(0)), ("sport", unit(2))], "label string, x array<double>")
    s = search.Space(terms, docs, cats, 3)
    q = spark.range(1).select(search.gathered(s, "Eisen:3 Erz unbekannt doc=heft cat=sport").alias("q")).first()["q"]
    # terms 3/4 and 1/4; two documents and a category, each by 1 / (3 + 1)
    assert q == pytest.approx([0.75 + 0.25, 0.25 + 0.25, 0.25])
    assert [r["label"] for r in search.answered(s, "Eisen", 1).collect()] == ["recht"]
    assert [r["label"] for r in search.answered(s, "doc=heft\\.2", 2, "docs").collect()] == ["heft.2", "buch"]
    masked = search.answered(s, "Erz", 2, "terms", min_doc_freq=3).collect()
    assert [(r["label"], r["d"]) for r in masked] == [("Eisen", 1.0), ("Erz", math.inf)]
    assert search.answered(s, "niemand", 1, "docs").first()["d"] == 2.0


def test_registry():
    from lexaris import registry

    assert registry.resolve("document", "Document::CabCsv1g") is readers.csv1g and registry.resolve("document", None) is readers.vzxml
    assert registry.resolve("mapper", "LSI-KNN") is classify.neighbour_votes and registry.resolve("lemmatizer", "default") is SEM
    registry.register("document", "Mine", len)
    assert registry.resolve("document", "mine") is len
    with pytest.raises(ValueError):
        registry.resolve("mapper", "none such")
    assert registry.chain(lambda x: x + 1, lambda x: 2 * x)(3) == 8


def test_checks_raise(spark):
    bad = spark.createDataFrame([("a", 1.0), ("b", -0.5)], "term string, tw double")
    assert matrix.checked_weights(bad.where("tw > 0")).count() == 1
    with pytest.raises(Exception, match="bad weight of term b"):
        matrix.checked_weights(bad).collect()
    one = spark.createDataFrame([("x", "a", "a"), ("y", "a", "b")], "label string, wanted string, got string")
    assert rows(evaluate.merge_checked(one.where("label = 'x'"), one.where("label = 'y'"))) == [("a", "a", 1), ("a", "b", 1)]
    with pytest.raises(Exception, match="labels in both"):
        evaluate.merge_checked(one, one).collect()


def test_names(spark):
    r = one(spark, *[T.short_label(F.lit(x)) for x in ("a/b.0017.xml", "b.xml")], T.output_name(F.lit("a/x.y.xml"), suffix=".sig"), T.dirname(F.lit("x")), T.basename(F.lit("a/b/")))
    assert tuple(r) == ("b?p=0017", "b", "a/x.y.sig", ".", "b")
    cats = spark.createDataFrame([("7_a", 3), ("b", 7), ("c", None)], "name string, cat_id long")
    assert rows(trim.ids_from_names(cats)) == [(0, "c"), (7, "7_a"), (8, "b")]
