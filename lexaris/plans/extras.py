"""Queries on weights, evaluation, the reduced space, searching and the scalar functions, beside those of the catalogue.

The reduced space is checked in a model of categories with full rank: there the products
of folded rows with categories, scaled by the squares of the singular values, are those
of the matrix itself, which SQL can say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaris.functions import math as M
from lexaris.functions import vectors as V
from lexaris.operators import averages, classify, cluster, corpus, cutoff, evaluate, lsi, matrix, search, signatures, similarity, trim
from lexaris.plans import catalogue as c
from lexaris.plans.catalogue import r6
from lexaris.session import cut
from lexaris.tables import all_categories, first_per_key, load

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    return c.registered(QUERIES, ORACLE, name, sql)


# ---------------------------------------------------------------- trimming, categories, weights


@query("all_memberships", f"with {c._CATS} select doc_id, cat_id, row_number() over (partition by doc_id order by deg asc nulls last, cat_id) as deg from members")
def all_memberships(spark, d):
    return all_categories(c.members(spark, d))


@query("tcm_of_all_memberships", f"with {c._TF}, {c._CATS} select term, cat_id, round(sum(f), 6) as f from tdm0 join members using (doc_id) group by 1, 2")
def tcm_of_all_memberships(spark, d):
    return matrix.term_category(c.tdm0(spark, d), all_categories(c.members(spark, d))).select("term", "cat_id", r6("f"))


@query("smoothing_by_category", f"with {c._MATRIX} select round(count(distinct cat_id) / sum(f), 9) as s from tcm0")
def smoothing_by_category(spark, d):
    return matrix.smoothing_by_category(c.tcm0(spark, d)).select(F.round("s", 9).alias("s"))


@query("weights_checked", f"with {c._MATRIX} select term, round(tw, 6) as tw from twc")
def weights_checked(spark, d):
    cells = cut(c.tcm0(spark, d), "tcm0")
    return matrix.checked_weights(matrix.weights(cells, "cat_id", "entropy")).select("term", r6("tw"))


@query(
    "recompiled_model",
    f"""with {c._TF}, {c._CATS},
k2 as (select term from tdm0 group by 1 having sum(f) >= 20 and count(*) >= 8), m as (select doc_id, term, f from tdm0 where term in (select term from k2)),
mc as (select term, cat_id, sum(f) as f from m join dcm using (doc_id) group by 1, 2),
h as (select term, log2(sum(f)) - sum(f * log2(f)) / sum(f) as h from mc group by 1), n as (select log2(count(distinct cat_id)) as top from mc)
select term, cat_id, round(ln(f + 1.001) * (1 - h / top), 6) as v from mc join h using (term), n""",
)
def recompiled_model(spark, d):
    cells = cut(c.tdm0(spark, d), "tdm0")
    return matrix.recompiled(cells, c.dcm(spark, d), 20, 8, "entropy", c.SMOOTH)[1].select("term", "cat_id", r6("v"))


@query("null_category_name", f"with {c._CATS} select name as null_name from cats order by cat_id limit 1")
def null_category_name(spark, d):
    return trim.null_category_name(c.cats(spark, d), "(auto)")


@query(
    "category_ids_from_names",
    """with n as (select distinct trim(name) as name, coalesce(try_cast(nullif(regexp_extract(trim(name), '^([0-9]{1,18})_', 1), '') as bigint), cat_id, 0) as asked from cat2id where name is not null),
r as (select *, row_number() over (partition by asked order by encode(name)) as r, max(asked) over () as top from n),
k as (select *, row_number() over (partition by r > 1 order by asked, encode(name)) as k from r)
select case when r = 1 then asked else top + k end as cat_id, name from k""",
)
def category_ids_from_names(spark, d):
    return trim.ids_from_names(load(spark, d, "cat2id").where("name is not null").select("cat_id", F.trim("name").alias("name")))


@query("first_distances", "select doc_id, cat_id, d from (select *, row_number() over (partition by doc_id, cat_id order by seen_at, d) as r from dist where d is not null and not isnan(d) and doc_id is not null and cat_id is not null) where r = 1")
def first_distances(spark, d):
    rows = load(spark, d, "dist").where("d is not null and not isnan(d) and doc_id is not null and cat_id is not null")
    return first_per_key(rows, ["doc_id", "cat_id"], ["seen_at", "d"]).select("doc_id", "cat_id", "d")


@query(
    "profile_filter",
    f"with {c._TF}, g as (select term from tdm0 group by 1 having count(*) filter (f >= 1) >= 12) select doc_id, term, round(f, 6) as f from tdm0 where f >= 2 and term in (select term from g)",
)
def profile_filter(spark, d):
    cells = cut(c.tdm0(spark, d), "tdm0")
    return corpus.profile(cells, matrix.marginals(cells), 2, 12).select("doc_id", "term", r6("f"))


@query(
    "profile_json",
    f"""with {c._TF}, top as (select * from (select *, row_number() over (partition by doc_id order by f desc, encode(term)) as r from tfc where f = floor(f)) where r <= 5)
select doc_id, to_json({{'doc': list({{'text': term, 'weight': f::bigint}} order by r)}})::varchar as json from top group by 1""",
)
def profile_json(spark, d):
    rows = c.tf(spark, d).where("f = floor(f)").withColumn("v", F.col("f").cast("long"))
    return corpus.profile_json(corpus.best_terms(rows, "doc_id", 5))


@query("semantic_by_category", f"with {c._MATRIX} select cat_id, round(sum(case when starts_with(term, 'SEM') then f else 0 end), 6) as n_sem, round(sum(case when starts_with(term, 'SEM') then 0 else f end), 6) as n_other from tdm0 join dcm using (doc_id) group by rollup (cat_id)")
def semantic_by_category(spark, d):
    return corpus.semantic_by_category(c.tdm0(spark, d), c.dcm(spark, d)).select("cat_id", r6("n_sem"), r6("n_other"))


@query(
    "membership_order",
    f"""with {c._CATS}, {c._DIST}, m as (select doc_id, cat_id, deg, d, case when d > 1 then 1 end as cut from members left join d_rows using (doc_id, cat_id))
select doc_id, cat_id, row_number() over (partition by doc_id order by coalesce(deg, 1), coalesce(cut, 0), coalesce(1 / nullif(d, 0), 0) desc, coalesce(d, 0), cat_id) as rank from m""",
)
def membership_order(spark, d):
    rows = c.members(spark, d).join(c.distances(spark, d), ["doc_id", "cat_id"], "left")
    rows = rows.select("doc_id", "cat_id", "deg", F.when(F.col("d") > 1, 1).alias("cut"), F.try_divide(F.lit(1.0), "d").alias("sim"), F.col("d").alias("dist_raw"), F.lit("").alias("name"))
    return classify.sort_memberships(rows).select("doc_id", "cat_id", "rank")


@query("merge_two_signatures", f"with {c._TF}, tk as (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{{L}}+)', 1)) as term from documents), b as (select doc_id, term, count(*)::double as f from tk group by 1, 2) select doc_id, term, round(sum(f), 6) as f from (select * from tfc union all select * from b) group by 1, 2")
def merge_two_signatures(spark, d):
    other = signatures.count_tokens(signatures.tokenize(load(spark, d, "documents")))
    return signatures.merge_terms(c.tf(spark, d), other).select("doc_id", "term", r6("f"))


# ---------------------------------------------------------------- evaluation


@query(
    "merge_two_evals",
    f"with {c._BOTH} select cat1, cat2, ndocs from pairs",
)
def merge_two_evals(spark, d):
    """Evaluations of the documents of even and of odd number, which share no label."""
    rows = cut(c.both(spark, d), "both")
    return evaluate.merge_checked(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"))


@query("shared_labels", f"with {c._BOTH} select distinct label from wg where wanted = got")
def shared_labels(spark, d):
    rows = cut(c.both(spark, d), "both")
    return evaluate.shared_labels(rows.where("wanted = got"), rows)


_MAXIMA = "select *, ndocs = max(ndocs) over (partition by {0}) as best from pairs"


@query("best_of_row", f"with {c._BOTH} {_MAXIMA.format('cat1')}")
def best_of_row(spark, d):
    return evaluate.of_row_maximum(c.pairs(spark, d), "cat1", "ndocs")


@query("best_of_column", f"with {c._BOTH} {_MAXIMA.format('cat2')}")
def best_of_column(spark, d):
    return evaluate.of_row_maximum(c.pairs(spark, d), "cat2", "ndocs")


@query(
    "catcmp_by_rest",
    "select name, row_number() over (order by coalesce(try_cast(nullif(regexp_extract(name, '^([0-9]{1,18})', 1), '') as bigint), 0), encode(regexp_replace(name, '^[0-9]{1,18}', '')), encode(name)) as pos from (select distinct trim(name) as name from cat2id)",
)
def catcmp_by_rest(spark, d):
    names = load(spark, d, "cat2id").select(F.trim("name").alias("name")).distinct()
    return names.select("name", F.row_number().over(W.orderBy(*evaluate.category_order_by_rest("name"), "name")).alias("pos"))


@query(
    "null_proto_fit",
    f"""with {c._CUT}, n0 as (select min(cat_id) as k from cats),
rows as (select f.doc_id, coalesce(d.d, 2.0) as d from wanted f left join d_rows d on d.doc_id = f.doc_id and d.cat_id = (select k from n0) where f.cat_id = (select k from n0))
select count(*) as n, round(avg(d), 6) as mu, round(stddev_pop(d), 6) as sd from rows having count(*) > 0""",
)
def null_proto_fit(spark, d):
    """The stand-in of the first category is fitted on that category's own documents."""
    null_cat = c.cats(spark, d).agg(F.min("cat_id")).first()[0]
    dist, twin = cutoff.with_null_proto(c.distances(spark, d), c.wanted(spark, d), null_cat, -1)
    fits = cutoff.fit_sparse(dist, twin, twin.select("cat_id").distinct())
    return fits.where("is_member").select("n", r6("mu"), r6("sd"))


_TAIL = (
    c._CUT
    + f""",
fg as (select avg(mu0) as g_mu0, avg(sd0) as g_sd0, avg(mu1) as g_mu1, avg(sd1) as g_sd1 from fixed), nc as (select cat_id, count(*) as n from wanted group by 1),
al as (select count(*) as total from wanted),
tails as (select doc_id, own, cat_id, d, mu0, sd0, mu1, sd1, coalesce(n, 0) as n, {similarity.tail_sql('d', 'mu1', 'sd1')} as p1, {similarity.tail_sql('d', 'mu0', 'sd0')} as p0,
  {similarity.tail_sql('d', 'g_mu1', 'g_sd1')} as g1, {similarity.tail_sql('d', 'g_mu0', 'g_sd0')} as g0, coalesce(n, 0) / total as share, 1 - coalesce(n, 0) / total as others
  from full_m join fixed using (cat_id) left join nc using (cat_id), fg, al)"""
)
_FORMULAS = similarity.formulas_sql()
_BEST = ", ".join(
    f"arg_min(cat_id, (round({'-' if top else ''}({sql}), 9), cat_id)) as b{i}" for i, (sql, top) in enumerate(_FORMULAS.values())
)
_RATES = " union all ".join(
    f"select '{name}' as formula, round(avg(case when b{i} = own then 1.0 else 0.0 end), 6)::double as accuracy from got" for i, name in enumerate(_FORMULAS)
)


@query("similarity_formulas", f"with {_TAIL}, got as materialized (select doc_id, own, {_BEST} from tails group by 1, 2) {_RATES}")
def similarity_formulas(spark, d):
    dist, wanted, names = cut(c.distances(spark, d), "dist"), cut(c.wanted(spark, d), "wanted"), c.cats(spark, d)
    fits = cut(cutoff.repaired(cutoff.fit_sparse(dist, wanted, names), names), "fits")
    rows = similarity.tails(cutoff.distance_matrix(dist, wanted, names), fits, wanted)
    return similarity.accuracies(rows, wanted).select("formula", r6("accuracy"))


# ---------------------------------------------------------------- reduced space, full rank over categories

FULL = 64
_CELLS = c._MATRIX


def _full_rank(spark, d):
    """(tdm0, dcm, tcm cells, weights, Svd, category vectors scaled by sigma squared)."""
    cells, dcm = cut(c.tdm0(spark, d), "tdm0"), cut(c.dcm(spark, d), "dcm")
    by_cat = cut(matrix.term_category(cells, dcm), "tcm0")
    tw = cut(matrix.weights(by_cat, "cat_id", "entropy"), "tw")
    tcm = cut(matrix.weighted(by_cat, tw, c.SMOOTH).select("term", "cat_id", "v"), "tcm")
    s = lsi.svd(tcm, "cat_id", FULL, power=1)  # one pass spans all rows
    squares = F.array(*[F.lit(float(v * v)) for v in s.sigma])
    xcm = lsi.project(tcm, "cat_id", s.factors, len(s.sigma))
    scaled = cut(xcm.select("cat_id", F.zip_with("x", squares, lambda a, b: a * b).alias("y")), "scaled")
    return cells, dcm, tcm, tw, s, scaled


def _products(rows: DataFrame, key: str, scaled: DataFrame, digits: int = 4) -> DataFrame:
    from lexaris.session import checked

    out = rows.crossJoin(checked(scaled.withColumnRenamed("cat_id", "other")))
    return out.select(key, "other", F.round(V.dot(F.col("x"), F.col("y")) + 0.0, digits).alias("dot"))


_WITH = "select a.{0}, b.cat_id as other, round(sum(a.v * b.v) + 0.0, 4) as dot from {1} a join tcm b using (term) group by 1, 2"


@query("lsi_energy", f"with {_CELLS} select round(sum(v * v), 4) as energy, count(distinct cat_id) as n from tcm where v <> 0")
def lsi_energy(spark, d):
    s = _full_rank(spark, d)[4]
    return spark.createDataFrame([(round(float((s.sigma**2).sum()), 4), len(s.sigma))], "energy double, n long")


def _present(rows: DataFrame) -> DataFrame:
    """Products of pairs without a common term are 0 and stand in no SQL join."""
    return rows.where("abs(dot) > 0.00005")


@query("lsi_category_products", f"with {_CELLS} select * from ({_WITH.format('cat_id', 'tcm')}) where abs(dot) > 0.00005")
def lsi_category_products(spark, d):
    _, _, tcm, _, s, scaled = _full_rank(spark, d)
    return _present(_products(lsi.project(tcm, "cat_id", s.factors, len(s.sigma)), "cat_id", scaled))


_LOGS = "lt as (select doc_id, term, ln(f + 1.001) * tw as v from tdm0 join twc using (term))"


@query("lsi_folded_products", f"with {_CELLS}, {_LOGS} select * from ({_WITH.format('doc_id', 'lt')}) where abs(dot) > 0.00005")
def lsi_folded_products(spark, d):
    cells, _, _, tw, s, scaled = _full_rank(spark, d)
    rows = matrix.weighted(cells, tw, c.SMOOTH)
    return _present(_products(lsi.project(rows, "doc_id", s.factors, len(s.sigma)), "doc_id", scaled))


@query(
    "lsi_smoothed_products",
    f"""with {_CELLS}, {_LOGS}, ms as (select avg(tw) * ln(1.001) as miss from twc), base as (select cat_id, sum(v) * any_value(miss) as b from tcm, ms group by 1),
own as (select a.doc_id, t.cat_id, sum((a.v - miss) * t.v) as o from lt a join tcm t using (term), ms group by 1, 2)
select doc_id, cat_id as other, round(b + coalesce(o, 0), 3) + 0.0 as dot from (select distinct doc_id from lt) cross join base left join own using (doc_id, cat_id)""",
)
def lsi_smoothed_products(spark, d):
    cells, _, _, tw, s, scaled = _full_rank(spark, d)
    rows = lsi.project_smoothed(matrix.weighted(cells, tw, c.SMOOTH), "doc_id", s.factors, tw, c.SMOOTH, len(s.sigma))
    return _products(rows, "doc_id", scaled, 3).withColumn("dot", F.col("dot") + 0.0)


@query(
    "lsi_profiles",
    f"""with {_CELLS}, {_LOGS}, ad as (select count(distinct doc_id) as all_n from lt), dl as (select doc_id, sum(f) as n from tdm0 group by 1),
nc as (select cat_id, count(*) as n from dcm group by 1),
pr as (select 'fold-in' as profile, cat_id, term, v from tcm
  union all select 'fold-avg', cat_id, term, v / n from tcm join nc using (cat_id)
  union all select 'average', cat_id, term, v / all_n from lt join dcm using (doc_id), ad
  union all select 'weighted-average', cat_id, term, v * n / (select sum(n) from dl) from lt join dcm using (doc_id) join dl using (doc_id)),
dots as (select p.profile, p.cat_id, b.cat_id as other, round(sum(p.v * b.v) + 0.0, 4) as dot from pr p join tcm b using (term) group by all)
select * from dots where abs(dot) > 0.00005""",
)
def lsi_profiles(spark, d):
    cells, dcm, tcm, tw, s, scaled = _full_rank(spark, d)
    rank = len(s.sigma)
    xdm = cut(lsi.project(matrix.weighted(cells, tw, c.SMOOTH), "doc_id", s.factors, rank), "xdm")
    lengths = signatures.lengths(cells)
    out = None
    for profile in ("fold-in", "fold-avg", "average", "weighted-average"):
        x = lsi.category_vectors(profile, xdm, dcm, rank, tcm, s.factors, lengths)
        part = _products(x, "cat_id", scaled).withColumn("profile", F.lit(profile))
        out = part if out is None else out.unionByName(part)
    return _present(out)


@query("lsi_null_products", f"with {_CELLS} select b.cat_id as other, round(sum(ln(1.001) * tw * v), 4) + 0.0 as dot from tcm b group by 1")
def lsi_null_products(spark, d):
    _, _, _, tw, s, scaled = _full_rank(spark, d)
    x = lsi.null_vector(tw, s.factors, c.SMOOTH, len(s.sigma)).withColumn("k", F.lit(0))
    return _products(x, "k", scaled).select("other", (F.col("dot") + 0.0).alias("dot"))


@query("lsi_term_products", f"with {_CELLS} select a.term, round(sum(a.v * b.v * n.q), 3) as dot from tcm a join (select cat_id, v from tcm where term = (select min(term) from tcm)) b using (cat_id), (select 1.0 as q) n group by 1 having abs(round(sum(a.v * b.v), 3)) > 0.0005")
def lsi_term_products(spark, d):
    """Rows of the matrix applied to the categories' side give the terms' own vectors, and these the products of terms."""
    _, _, tcm, _, s, _ = _full_rank(spark, d)
    rank = len(s.sigma)
    sigma = F.array(*[F.lit(float(v)) for v in s.sigma])
    xcm = lsi.project(tcm, "cat_id", s.factors, rank).withColumnRenamed("cat_id", "doc_id")
    x = averages.row_applied(tcm.withColumnRenamed("cat_id", "doc_id"), xcm, sigma, rank)
    x = cut(x.select("term", F.zip_with("x", sigma, lambda a, b: a * b).alias("x")), "terms")
    first = x.orderBy("term").limit(1).select(F.col("x").alias("y"))
    rows = x.crossJoin(F.broadcast(first))  # one row
    return rows.select("term", F.round(V.dot(F.col("x"), F.col("y")), 3).alias("dot")).where("abs(dot) > 0.0005")


@query("vector_deviations", "select vec_id as doc_id, round(sqrt(list_avg(list_transform(embedding::double[], lambda v: v * v))), 6) as sigma from embeddings")
def vector_deviations(spark, d):
    return c.vectors(spark, d).select("doc_id", F.round(lsi.root_mean_square(F.col("x")), 6).alias("sigma"))


@query(
    "null_proto_names",
    f"with {c._CATS}, {c._DIST}, r as (select doc_id, cat_id, d from d_rows), z as (select min(cat_id) as k from cats) select doc_id, case when cat_id = (select max(cat_id) from cats) then (select k from z) else cat_id end as cat_id, (select k2.name from cats k2 where k2.cat_id = case when r.cat_id = (select max(cat_id) from cats) then (select k from z) else r.cat_id end) as name, case when cat_id = (select max(cat_id) from cats) then '(null)' end as proto from r",
)
def null_proto_names(spark, d):
    """The last category stands in for the first."""
    names = c.cats(spark, d)
    ends = names.agg(F.min("cat_id").alias("a"), F.max("cat_id").alias("b")).first()
    return lsi.with_null_proto(c.distances(spark, d), names, ends["b"], ends["a"]).select("doc_id", "cat_id", "name", "proto")


@query(
    "tail_similarity",
    f"with {c._CUT}, s as (select doc_id, cat_id, d, {similarity.tail_sql('d', 'mu1', 'sd1')} as p1, {similarity.tail_sql('d', 'mu0', 'sd0')} as p0 from full_m join cuts using (cat_id)) select doc_id, cat_id, round(greatest(0, least(1e38, {similarity.formulas_sql()['F1 of tails'][0]})), 5) as sim from s",
)
def tail_similarity(spark, d):
    dist, wanted, names = cut(c.distances(spark, d), "dist"), cut(c.wanted(spark, d), "wanted"), c.cats(spark, d)
    fits = cutoff.repaired(cutoff.fit_sparse(dist, wanted, names), names)
    rows = cutoff.distance_matrix(dist, wanted, names).join(fits, "cat_id")
    cols = [F.col(x) for x in ("d", "mu0", "sd0", "mu1", "sd1")]
    return rows.select("doc_id", "cat_id", F.round(similarity.tail_f1(*cols), 5).alias("sim"))


# ---------------------------------------------------------------- searching

_SPACE = """
v as (select vec_id, embedding::double[] as x, label from embeddings),
cx as (select label as cat_id, i, avg(x[i]) as a from v, range(1, 65) t(i) group by 1, 2), cc as (select cat_id, array_agg(a order by i) as x from cx group by 1),
tv as (select 't' || vec_id as label, x from v), dv as (select 'd' || vec_id as label, x from v), cv as (select 'c' || cat_id as label, x from cc),
part(x, w) as (select x, 0.75 from tv where label = 't3' union all select x, 0.25 from tv where label = 't5'
  union all select x, 1.0 / ((select count(*) from hits) + 1) from hits),
qv as (select list(s order by i) as q from (select i, sum(w * x[i]) as s from part, range(1, 65) t(i) group by 1)),
ds as (select label, round(greatest(0, least(2, 1 - list_cosine_similarity(x, q))), 6) as d from {0}, qv)
"""
_HITS = "hits as (select x from (select 'd' || vec_id as label, embedding::double[] as x from embeddings) where regexp_matches(label, '^d1[01]$') union all select x from (select 'c' || label as label, list(a order by i) as x from (select label, i, avg(embedding[i]::double) as a from embeddings, range(1, 65) t(i) group by 1, 2) group by 1) where label = 'c0')"
_QUERY = "t3:3 t5 doc=^d1[01]$, cat=c0 unbekannt-t9:0"


def space(spark, d) -> search.Space:
    v = cut(c.vectors(spark, d), "vectors")
    name = lambda sign, col: F.concat(F.lit(sign), F.col(col).cast("string"))
    terms = v.select(name("t", "doc_id").alias("term"), "x", F.lit(1.0).alias("tf0"), F.when(F.col("doc_id") % 2 == 0, 9).otherwise(1).alias("tdf0"))
    return search.Space(terms, v.select(name("d", "doc_id").alias("label"), "x"), cut(c.centroids(spark, d).select(name("c", "cat_id").alias("label"), "x"), "cats"), 64)


def _answers(to: str, table: str, how: str = "", bound: float = 0.0):
    masked = f"case when {bound} > 0 and substr(label, 2)::bigint % 2 = 1 then 'inf'::double else d end" if to == "terms" else "d"
    half = "/ 2" if how else ""
    sql = f"with {_HITS}, {_SPACE.format(table)}, m as (select label, {masked} as d from ds) select label, round(d {half}, 6) as d from m order by round(d, 6), label limit 10"

    @query(f"search_{to}", sql)
    def run(spark, d):
        rows = search.answered(space(spark, d), _QUERY, 10, to, how=how, min_doc_freq=bound, digits=6)
        return rows.select("label", r6("d"))


_answers("docs", "dv")
_answers("cats", "cv", "linear")
_answers("terms", "tv", bound=5.0)


@query("search_range", f"with {_HITS}, {_SPACE.format('dv')} select round(min(d), 5) as least, round(max(d), 5) as greatest from ds")
def search_range(spark, d):
    s = space(spark, d)
    rows = search.distance_range(s.docs, search.gathered(s, _QUERY))
    return rows.select(F.round("least", 5).alias("least"), F.round("greatest", 5).alias("greatest"))


# ---------------------------------------------------------------- averages of the nearest

_NORM = """v as (select vec_id as doc_id, embedding::double[] as x from embeddings),
n as (select doc_id, {0} as x from v, (select min(list_min(x)) as low from v))
select doc_id, round(x[1], 6) as a, round(x[64], 6) as b, round(list_sum(x), 5) + 0.0 as total from n"""
_SHAPES = {
    "sum": "list_transform(x, lambda a: a / list_sum(x))",
    "shifted": "list_transform(x, lambda a: (a - low) / list_sum(list_transform(x, lambda b: b - low)))",
    "row-shifted": "list_transform(x, lambda a: (a - list_min(x)) / list_sum(list_transform(x, lambda b: b - list_min(x))))",
    "length": "list_transform(x, lambda a: a / sqrt(list_dot_product(x, x)))",
}


def _normalised(how: str, sql: str):
    @query(f"normalised_{how.replace('-', '_')}", "with " + _NORM.format(sql))
    def run(spark, d):
        rows = averages.normalised_rows(c.vectors(spark, d).select("doc_id", "x"), how)
        return rows.select("doc_id", F.round(F.get("x", F.lit(0)), 6).alias("a"), F.round(F.get("x", F.lit(63)), 6).alias("b"), (F.round(V.total(F.col("x")), 5) + 0.0).alias("total"))


for _how, _sql in _SHAPES.items():
    _normalised(_how, _sql)

_NEAREST = """v as (select vec_id as doc_id, {unit} as x from (select vec_id, embedding::double[] as x from embeddings)),
q as (select x as q from v where doc_id = (select min(doc_id) from v)),
dd as (select doc_id, x, round({distance}, 9) as d from v, q), near as (select * from dd order by d, doc_id limit {k}),
m as (select avg(d) as mu, stddev_pop(d) as sd from near), w0 as (select x, {weight} as w from near, m),
w as (select x, w / (select sum(w) from w0) as w from w0), s as (select i, sum(w * x[i]) as s from w, range(1, 65) t(i) group by 1)
select i - 1 as i, round(s {scaled}, 6) as x from s"""
_COS = "greatest(0, least(2, 1 - list_cosine_similarity(x, q)))"
_L2 = "list_distance(x, q)"
_UNIT = "list_transform(x, lambda a: a / sqrt(list_dot_product(x, x)))"
_AVERAGES = {  # unit vectors, compared by, weights, k, arguments, scaled to length 1
    "plain": (False, "u", "plain", 20, {}, False),
    "plain_unit": (True, "u", "plain", 20, {}, True),
    "boltzmann": (False, "u", "boltzmann", 20, {"beta": -3.0}, False),
    "boltzmann_unit": (True, "u", "boltzmann", 0, {"beta": -20.0}, False),
    "power": (False, "l2", "power", 20, {"beta": -2.0}, False),
    "gauss": (False, "u", "gauss", 20, {}, False),
}


def _weight_sql(how: str, beta: float) -> str:
    from lexaris.functions.math import erf_sql

    return {
        "plain": "1.0", "boltzmann": f"pow(2.0, {beta} * d)", "power": f"pow(greatest(d, 1e-12), {beta})",
        "gauss": f"1 - 0.5 * (1 + {erf_sql('((d - mu) / (sd * 1.4142135623730951))')})",
    }[how]


def _average(name: str, unit: bool, by: str, how: str, k: int, args: dict, scaled: bool):
    sql = "with " + _NEAREST.format(
        unit=_UNIT if unit else "x", distance=_COS if by == "u" else _L2, k=k or 1_000_000_000,
        weight=_weight_sql(how, args.get("beta", -1.0)), scaled="/ sqrt((select sum(s * s) from s))" if scaled else "",
    )

    @query(f"average_{name}", sql)
    def run(spark, d):
        items = c.vectors(spark, d).select("doc_id", "x")
        items = cut(averages.normalised_rows(items, "length") if unit else items, "items")
        first = items.orderBy("doc_id").limit(1).first()["x"]
        near = averages.k_nearest(averages.compared(items, F.array(*[F.lit(float(v)) for v in first]), by), "doc_id", k)
        x = averages.average(averages.weights(cut(near, "near"), how, **args), 64, scaled)
        return x.select(F.posexplode("x").alias("i", "x")).select(F.col("i").cast("long").alias("i"), r6("x"))


for _name, _args in _AVERAGES.items():
    _average(_name, *_args)


@query(
    "average_by_frequency",
    f"""with {c._MATRIX}, f as (select doc_id, f from tdm0 where term = (select min(term) from tdm0)), x as (select f.doc_id, f, l.n from f join (select doc_id, sum(f) as n from tdm0 group by 1) l using (doc_id))
select round(sum(n * f) / sum(f), 6) as x from x""",
)
def average_by_frequency(spark, d):
    """A term's documents weighted by how often they have it; their vectors here are their lengths."""
    cells = cut(c.tdm0(spark, d), "tdm0")
    term = cells.agg(F.min("term")).first()[0]
    near = cells.where(F.col("term") == term).select("doc_id", "f").join(signatures.lengths(cells), "doc_id")
    x = averages.average(averages.weights(near.withColumn("x", F.array("n")), "given"), 1)
    return x.select(F.round(F.get("x", F.lit(0)), 6).alias("x"))


_JS = "(list_sum(list_transform(list_zip(x, q), lambda p: case when p[1] > 0 then p[1] * log2(p[1] / ((p[1] + p[2]) / 2)) else 0 end)) + list_sum(list_transform(list_zip(x, q), lambda p: case when p[2] > 0 then p[2] * log2(p[2] / ((p[1] + p[2]) / 2)) else 0 end))) / 2"


@query(
    "kbest_jensen_shannon",
    f"with v as (select vec_id as doc_id, {_SHAPES['row-shifted']} as x from (select vec_id, embedding::double[] as x from embeddings)), q as (select x as q from v where doc_id = (select min(doc_id) from v)), dd as (select doc_id, round({_JS}, 6) + 0.0 as d from v, q) select doc_id, d from dd order by d, doc_id limit 10",
)
def kbest_jensen_shannon(spark, d):
    items = cut(averages.normalised_rows(c.vectors(spark, d).select("doc_id", "x"), "row-shifted"), "items")
    first = items.orderBy("doc_id").limit(1).first()["x"]
    rows = averages.compared(items, F.array(*[F.lit(float(v)) for v in first]), "js").withColumn("d", F.round("d", 6) + 0.0)
    return averages.k_nearest(rows, "doc_id", 10, 6).select("doc_id", "d")


@query(
    "vector_errors",
    "with v as (select vec_id as doc_id, embedding::double[] as x from embeddings), q as (select x as q from v where doc_id = (select min(doc_id) from v)) select doc_id, round(list_distance(x, q), 6) as l2, round(pow(list_distance(x, q), 2) / list_dot_product(x, x), 6) as relative from v, q",
)
def vector_errors(spark, d):
    q = c._first_vector(spark, d)
    return c.vectors(spark, d).select("doc_id", F.round(V.l2(F.col("x"), q), 6).alias("l2"), F.round(V.relative_error(F.col("x"), q), 6).alias("relative"))


@query(
    "regex_restricted",
    f"with v as (select vec_id as doc_id, embedding::double[] as x from embeddings), q as (select x as q from v where doc_id = (select min(doc_id) from v)), dd as (select doc_id, round({_COS}, 6) as d from v, q where regexp_matches('d' || doc_id, '^d[0-9]*7$')) select doc_id, d from dd order by d, doc_id limit 10",
)
def regex_restricted(spark, d):
    v = c.vectors(spark, d).withColumn("label", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = averages.compared(search.lookup(v, "label", "^d[0-9]*7$"), c._first_vector(spark, d))
    return averages.k_nearest(rows, "doc_id", 10, 6).select("doc_id", "d")


# ---------------------------------------------------------------- clustering


@query(
    "cluster_first_link",
    f"with {c._EMB} select a.cat_id as a, b.cat_id as b, round(1 - list_cosine_similarity(a.x, b.x), 6) as d from c a join c b on a.cat_id < b.cat_id order by d, a, b limit 1",
)
def cluster_first_link(spark, d):
    cats = c.centroids(spark, d)
    names = F.array(*[F.lit(r["cat_id"]) for r in cats.select("cat_id").orderBy("cat_id").collect()])  # a short list
    return cluster.linked(cats, "cat_id").where("step = 0").select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), r6("d"))


def _links(link: str):
    @query(f"cluster_{link}")
    def run(spark, d):
        return cluster.linked(c.centroids(spark, d), "cat_id", link).select("step", "a", "b", r6("d"), "size")


for _link in ("avg", "max", "min"):
    _links(_link)


@query("cluster_cut", f"with {c._EMB} select count(*) as n, 3::bigint as clusters from c")
def cluster_cut(spark, d):
    cats = c.centroids(spark, d)
    rows = cluster.cut_tree(cluster.linked(cats, "cat_id", "max"), cats, "cat_id", 3)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster").alias("clusters"))


# ---------------------------------------------------------------- scalars

_P, _R = "(l_discount * 10)", "(l_tax * 10)"


@query(
    "scalar_scores",
    f"""with s as (select l_orderkey, l_linenumber, {_P} as p, {_R} as r, 0.99999 * {_P} + 0.00001 as a, 0.99999 * {_R} + 0.00001 as b from lineitem)
select l_orderkey, l_linenumber, round(a::double, 6) as li1, round(2 / (1 / a::double + 1 / b::double), 6) as f1, round(1.25 * (a::double * b::double) / (0.25 * a::double + b::double), 6) as fb from s""",
)
def scalar_scores(spark, d):
    p, r = F.col("l_discount").cast("double") * 10, F.col("l_tax").cast("double") * 10
    return load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(M.smoothed(p), 6).alias("li1"), F.round(M.f1(p, r), 6).alias("f1"), F.round(M.f_beta(p, r), 6).alias("fb"))


@query(
    "scalar_fits",
    "select round(regr_slope(l_extendedprice::double, l_quantity::double), 4) as slope, round(regr_intercept(l_extendedprice::double, l_quantity::double), 2) as intercept, round(regr_slope(ln(l_extendedprice::double), ln(l_quantity::double)), 6) as exponent, round(exp(regr_intercept(ln(l_extendedprice::double), ln(l_quantity::double))), 2) as factor from lineitem",
)
def scalar_fits(spark, d):
    y, x = F.col("l_extendedprice").cast("double"), F.col("l_quantity").cast("double")
    (slope, intercept), (exponent, factor) = M.linear_fit(y, x), M.log_fit(y, x)
    return load(spark, d, "lineitem").agg(F.round(slope, 4).alias("slope"), F.round(intercept, 2).alias("intercept"), F.round(exponent, 6).alias("exponent"), F.round(factor, 2).alias("factor"))


@query(
    "scalar_si",
    """select o_orderkey, case when x >= 1e6 then printf('%.2fM', x / 1e6) when x >= 1e3 then printf('%.2fK', x / 1e3) else printf('%.2f', x) end as si from (select o_orderkey, 10 * floor(o_totalprice::double / 10) + 3 as x from orders)""",
)
def scalar_si(spark, d):
    return load(spark, d, "orders").select("o_orderkey", M.si((10 * F.floor(F.col("o_totalprice").cast("double") / 10) + 3).cast("double")).alias("si"))


@query("scalar_underscores", "select p_partkey, regexp_replace(p_name, '\\s', '_', 'g') as name from part")
def scalar_underscores(spark, d):
    from lexaris.functions.text import underscored

    return load(spark, d, "part").select("p_partkey", underscored(F.col("p_name")).alias("name"))


@query(
    "scalar_weights",
    f"with {c._DIST}, b as (select doc_id, cat_id, pow(2.0, -1.0 * d) as w from d_rows) select doc_id, cat_id, round(w / sum(w) over (partition by doc_id), 6) as w from b",
)
def scalar_weights(spark, d):
    rows = c.distances(spark, d).withColumn("w", M.boltzmann(F.col("d")))
    return rows.select("doc_id", "cat_id", F.round(F.col("w") / F.sum("w").over(W.partitionBy("doc_id")), 6).alias("w"))


@query(
    "eval_report_lines",
    f"with {c._BOTH}, n as (select count(*) as n from bycat), e as (select count(*) as n from pairs) select 1 as part, 14::bigint as n union all select 2, n from n union all select 3, least(10, n) from e",
)
def eval_report_lines(spark, d):
    p, k = c._classes(spark, d)
    rows = evaluate.report(evaluate.global_modes(p, k), evaluate.by_category(p), evaluate.error_shares(p, k))
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("fold_balance", f"with {c._CATS} select cat_id, count(*) as n from dcm join (select distinct doc_id from docs where doc_id is not null) using (doc_id) group by 1")
def fold_balance(spark, d):
    """Documents of each category over all folds; a category whose folds differ by more than a block's slack gives -1."""
    docs = c.documents(spark, d).join(c.dcm(spark, d), "doc_id")
    docs = cut(docs.withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0))), "documents")
    folds = corpus.split(docs, 5).join(docs.select("doc_id", "n_bytes"), "doc_id")
    sizes = folds.groupBy("cat_id", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("top"))
    out = sizes.groupBy("cat_id").agg(F.sum("n").alias("n"), F.max("b").alias("hi"), F.min("b").alias("lo"), F.count(F.lit(1)).alias("k"), F.max("top").alias("top"))
    uneven = (F.col("k") == 5) & (F.col("hi") - F.col("lo") > F.col("top") * F.ceil(F.col("n") / 4096))
    return out.select("cat_id", F.when(uneven, -1).otherwise(F.col("n")).alias("n"))
