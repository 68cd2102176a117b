"""The core queries over a data folder, each with its DuckDB equivalent where SQL can say it.

Every query reads its whole tables. Derived doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaris.functions import vectors as V
from lexaris.functions.math import erf_sql
from lexaris.operators import classify, corpus, cutoff, evaluate, matrix, search, signatures, trim
from lexaris.operators.lemmatize import CONTENT, SEP, lemmatize
from lexaris.session import cut
from lexaris.tables import best_category, categories, counted, doc_labels, latest, load, memberships, usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

MIN_FREQ, MIN_DOC_FREQ, SMOOTH = 10, 4, 1.001


#: What of the shared views a query needs more than once; it is written once a call and read from there.
KEPT: dict[str, str] = {
    **dict.fromkeys("merge_signatures trim_max_terms_per_doc tdm_raw tdm_log weight_uniform weight_hc tdf0_tf0 tcm_raw".split(), "tf"),
    **dict.fromkeys("model_category_sizes null_proto_fit profile_filter".split(), "tf"),
    **dict.fromkeys("smoothing_constant weight_hmax weight_hq tdm_weighted kbest_masked doc_profile_top_terms".split(), "tf tdm0"),
    **dict.fromkeys("weight_bycat weight_mix weight_unmix tcm_weighted invert_tdm cat_best_terms".split(), "tf tcm0"),
    **dict.fromkeys("classify_raw classify_raw_best confusion_pairs".split(), "tf tdm0 dcm tcm0 tcm"),
    **dict.fromkeys("eval_classes eval_error_total merge_evals confusion_conditional best_of_row best_of_column".split(), "pairs"),
    **dict.fromkeys("eval_global_modes eval_error_share eval_top_errors eval_report eval_report_lines".split(), "pairs classed"),
    **dict.fromkeys("distance_matrix fit_gaussians cutoff_vector".split(), "distances wanted"),
    **dict.fromkeys("closer_than_wanted_lt closer_than_wanted_le mean_similarity cutoff_apply optimize_cutoffs".split(), "distances wanted full_matrix"),
    **dict.fromkeys("fitness_acc fitness_f fitness_avg fitness_min".split(), "distances wanted full_matrix"),
}
_TABLES: ContextVar[dict[str, DataFrame] | None] = ContextVar("tables", default=None)


def view(f):
    """A shared view; within a query that keeps it, it is written at first use."""

    @wraps(f)
    def read(spark, d):
        tables = _TABLES.get()
        if tables is None or f.__name__ not in tables:
            return f(spark, d)
        if tables[f.__name__] is None:
            tables[f.__name__] = cut(f(spark, d), f.__name__)
        return tables[f.__name__]

    return read


def registered(queries: dict, oracle: dict[str, str], name: str, sql: str | None):
    """Puts a query and its SQL under its name."""

    def add(f):
        @wraps(f)
        def run(spark, d):
            token = _TABLES.set(dict.fromkeys(KEPT.get(name, "").split()))
            try:
                return f(spark, d)
            finally:
                _TABLES.reset(token)

        queries[name] = run
        if sql is not None:
            oracle[name] = sql
        return f

    return add


def query(name: str, sql: str | None = None):
    return registered(QUERIES, ORACLE, name, sql)


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# ---------------------------------------------------------------- shared views


@view
def tf(spark, d):
    return counted(load(spark, d, "tf"))


@view
def members(spark, d):
    return memberships(load(spark, d, "doc_cats"), load(spark, d, "cat2id"))


@view
def cats(spark, d):
    return categories(load(spark, d, "cat2id")).withColumnRenamed("cat", "name")


@view
def tdm0(spark, d):
    return trim.trim(tf(spark, d), MIN_FREQ, MIN_DOC_FREQ)


@view
def dcm(spark, d):
    return best_category(members(spark, d))


@view
def tcm0(spark, d):
    return matrix.term_category(tdm0(spark, d), dcm(spark, d))


@view
def distances(spark, d):
    """(doc_id, cat_id, d): valid distances of at most 2."""
    rows = load(spark, d, "dist").where(F.col("doc_id").isNotNull() & F.col("cat_id").isNotNull())
    rows = latest(rows.select("doc_id", "cat_id", F.col("d").cast("double").alias("d"), "seen_at"), ["doc_id", "cat_id"], ["d"])
    return rows.where(usable(F.col("d")) & F.col("d").between(0, 2))


@view
def wanted(spark, d):
    """(doc_id, cat_id): best categories of the documents that have distances."""
    return dcm(spark, d).join(distances(spark, d).select("doc_id"), "doc_id", "left_semi")


@view
def full_matrix(spark, d):
    return cutoff.distance_matrix(distances(spark, d), wanted(spark, d), cats(spark, d))


@view
def both(spark, d):
    """(doc_id, wanted, got): names of the best and of the nearest category."""
    n = cats(spark, d)
    near = distances(spark, d).groupBy("doc_id").agg(F.min(F.struct("d", "cat_id")).alias("b"))
    got = near.select("doc_id", F.col("b.cat_id").alias("cat_id")).join(n, "cat_id")
    want = dcm(spark, d).join(n, "cat_id")
    return evaluate.wanted_got(
        want.select(F.col("doc_id").alias("label"), F.col("name").alias("cat")),
        got.select(F.col("doc_id").alias("label"), F.col("name").alias("cat")),
    )


@view
def pairs(spark, d):
    return evaluate.pairs(both(spark, d))


def documents(spark, d):
    docs = load(spark, d, "docs").where(F.col("doc_id").isNotNull())
    return latest(docs.select("doc_id", F.col("bytes").alias("n_bytes"), "seen_at"), ["doc_id"], ["n_bytes"])


_NAME = "nullif(regexp_replace(lower(trim(nfc_normalize({0}))), '^[0-9]+_', ''), '')"

_TF = """
tf_rows as (select doc_id, nfc_normalize(trim(term)) as term, f, seen_at from tf where doc_id is not null and trim(term) <> ''),
tfc as (select doc_id, term, f from (select *, row_number() over (partition by doc_id, term order by seen_at desc nulls last, f desc nulls last) as r
        from tf_rows) where r = 1 and f > 0 and isfinite(f)),
kept as (select term, sum(f) as gf, count(*) as df from tfc group by 1 having sum(f) >= 10 and count(*) >= 4),
tdm0 as (select doc_id, term, f from tfc where term in (select term from kept))
"""
_CATS = f"""
cats as (select cat_id, min({_NAME.format('name')}) as name, min(subject) as subject from cat2id where cat_id is not null group by 1),
names as (select name, min(cat_id) as cat_id from cats where name is not null group by 1),
m_rows as (select m.doc_id, coalesce(m.cat_id, n.cat_id) as cat_id, m.deg, m.seen_at
  from doc_cats m left join names n on m.cat_id is null and n.name = {_NAME.format('m.name')} where m.doc_id is not null),
members as (select doc_id, cat_id, deg from (select *, row_number() over (partition by doc_id, cat_id order by seen_at desc nulls last, deg desc nulls last) as r
  from m_rows where cat_id is not null) where r = 1),
dcm as (select doc_id, cat_id from (select *, row_number() over (partition by doc_id order by deg asc nulls last, cat_id) as r from members) where r = 1)
"""
_MATRIX = (
    _TF
    + ","
    + _CATS
    + """,
tcm0 as (select term, cat_id, sum(f) as f from tdm0 join dcm using (doc_id) group by 1, 2),
hc as (select term, log2(sum(f)) - sum(f * log2(f)) / sum(f) as h from tcm0 group by 1),
twc as (select term, 1 - h / (select log2(count(distinct cat_id)) from tcm0) as tw from hc),
tcm as (select term, cat_id, f, tw, ln(f + 1.001) * tw as v from tcm0 join twc using (term)),
hd as (select term, sum(f) as ft, log2(sum(f)) - sum(f * log2(f)) / sum(f) as h from tdm0 group by 1),
nd as (select count(distinct doc_id) as n from tdm0)
"""
)
_DIST = """
d_rows as (select doc_id, cat_id, d from (select *, row_number() over (partition by doc_id, cat_id order by seen_at desc nulls last, d desc nulls last) as r
  from dist where doc_id is not null and cat_id is not null) where r = 1 and isfinite(d) and d between 0 and 2)
"""
_BOTH = (
    _CATS
    + ","
    + _DIST
    + """,
near as (select doc_id, cat_id from (select *, row_number() over (partition by doc_id order by d, cat_id) as r from d_rows) where r = 1),
wg as (select w.doc_id as label, a.name as wanted, b.name as got from dcm w join near n using (doc_id)
  join cats a on a.cat_id = w.cat_id join cats b on b.cat_id = n.cat_id),
pairs as (select wanted as cat1, got as cat2, count(*) as ndocs from wg group by 1, 2),
sides as (select cat1 as cat, case when cat1 = cat2 then ndocs else 0 end as tp, 0 as fp, case when cat1 = cat2 then 0 else ndocs end as fn from pairs
  union all select cat2, 0, ndocs, 0 from pairs where cat1 <> cat2),
sums as (select cat, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from sides group by 1),
prf as (select *, case when tp + fp <> 0 then tp / (tp + fp) else 1.0 end as pr, case when tp + fn <> 0 then tp / (tp + fn) else 1.0 end as rc from sums),
bycat as (select *, case when pr = 0 or rc = 0 then 0.0 else 2 / (1 / pr + 1 / rc) end as F, (pr + rc) / 2 as a from prf),
nullcat as (select cat from bycat order by tp + fn desc, coalesce(try_cast(regexp_extract(cat, '^([0-9]+)', 1) as bigint), -1), cat limit 1),
cls as (select cat, case when cat = (select cat from nullcat) then 'null'
  when tp + fn > 0.025 * (select sum(ndocs) from pairs) then 'safe' else 'unsafe' end as class from bycat)
"""
)
_CUT = (
    _CATS
    + ","
    + _DIST
    + """,
wanted as (select doc_id, cat_id from dcm semi join d_rows using (doc_id)),
full_m as (select w.doc_id, w.cat_id as own, c.cat_id, coalesce(d.d, 2.0) as d from wanted w cross join cats c
  left join d_rows d on d.doc_id = w.doc_id and d.cat_id = c.cat_id),
fits as (select cat_id, cat_id = own as is_member, count(*) as n, avg(d) as mu, stddev_pop(d) as sd from full_m group by 1, 2),
s0 as (select * from fits where not is_member), s1 as (select * from fits where is_member),
fixed as (select c.cat_id,
  case when s0.n >= 2 then s0.mu else (select min(mu) from s0 where n >= 2) end as mu0,
  case when s0.n >= 2 then s0.sd else (select max(sd) from s0 where n >= 2) end as sd0,
  case when s1.n >= 2 then s1.mu else (select min(mu) from s1 where n >= 2) end as mu1,
  case when s1.n >= 2 then s1.sd else (select min(sd) from s1 where n >= 2) / 2 end as sd1
  from cats c left join s0 using (cat_id) left join s1 using (cat_id)),
cuts as (select *, 0.35 * (mu0 - 0.6744897501960817 * sd0) + 0.65 * (mu1 + 0.6744897501960817 * sd1) as cutoff from fixed),
decided as (select doc_id, own, arg_min(cat_id, (case when d > cutoff then d + 100 else d end, cat_id)) as got
  from full_m join cuts using (cat_id) group by 1, 2),
fit_w as (select own as cat_id, count(*) as nw, sum(case when own = got then 1 else 0 end) as tp from decided group by 1),
fit_g as (select got as cat_id, count(*) as ng from decided group by 1),
fit_c as (select tp / ng as pr, tp / nw as rc from fit_w join fit_g using (cat_id))
"""
)

# ---------------------------------------------------------------- signatures and trimming


@query(
    "token_signature",
    "select doc_id, term, count(*)::double as f from (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) as term from documents) group by 1, 2",
)
def token_signature(spark, d):
    return signatures.count_tokens(signatures.tokenize(load(spark, d, "documents")))


@query("doc_lengths", f"with {_TF} select doc_id, round(sum(f), 6) as n from tfc group by 1")
def doc_lengths(spark, d):
    return signatures.lengths(tf(spark, d)).select("doc_id", r6("n"))


@query("global_term_freq", f"with {_TF} select term, round(sum(f), 6) as gf, count(*) as df from tfc group by 1")
def global_term_freq(spark, d):
    return signatures.global_frequencies(tf(spark, d)).select("term", r6("gf"), "df")


@query("merge_signatures", f"with {_TF} select doc_id, term, round(2 * f, 6) as f from tfc")
def merge_signatures(spark, d):
    s = tf(spark, d)
    return signatures.merge_terms(s, s).select("doc_id", "term", r6("f"))


@query(
    "merge_categories",
    f"with {_CATS} select doc_id, name, cat_id, min(deg) as deg from members join cats using (cat_id) group by 1, 2, 3",
)
def merge_categories(spark, d):
    m = members(spark, d).join(cats(spark, d), "cat_id").select("doc_id", "name", "cat_id", "deg")
    return signatures.merge_categories(m, m)


@query(
    "token_list",
    f"with {_TF} select doc_id, term, floor(f)::bigint as n from tfc where floor(f) > 0",
)
def token_list(spark, d):
    return signatures.token_list(tf(spark, d)).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_sizes",
    "select doc_id, strlen(coalesce(text, '')) as n_bytes, length(coalesce(text, '')) as n_chars from documents",
)
def document_sizes(spark, d):
    return signatures.sizes(load(spark, d, "documents"))


@query(
    "document_labels",
    "select doc_id, coalesce(label, file) as label from (select *, row_number() over (partition by doc_id order by seen_at desc nulls last, label desc nulls last) as r from docs) where r = 1",
)
def document_labels(spark, d):
    return doc_labels(load(spark, d, "docs"))


@query("trim_terms", f"with {_TF} select term, round(gf, 6) as gf, df from kept")
def trim_terms(spark, d):
    return trim.kept_terms(tf(spark, d), MIN_FREQ, MIN_DOC_FREQ).select("term", r6("gf"), "df")


@query(
    "trim_max_terms_per_doc",
    f"""with {_TF},
top as (select term, f from (select *, row_number() over (partition by doc_id order by f desc, term) as r from tfc) where r <= 20),
g as (select term, sum(f) as gf from top group by 1), n as (select term, count(*) as df from tfc group by 1)
select term, round(gf, 6) as gf, df from g join n using (term) where gf >= 10 and df >= 4""",
)
def trim_max_terms_per_doc(spark, d):
    return trim.trim_by_top_terms(tf(spark, d), 20, MIN_FREQ, MIN_DOC_FREQ).select("term", r6("gf"), "df")


@query("term_enum", f"with {_TF} select row_number() over (order by encode(term)) - 1 as tid, term from kept")
def term_enum(spark, d):
    return trim.number(trim.kept_terms(tf(spark, d), MIN_FREQ, MIN_DOC_FREQ), "term", "tid")


@query("category_enum", f"with {_CATS} select row_number() over (order by cat_id) - 1 as lcid, cat_id from (select distinct cat_id from dcm)")
def category_enum(spark, d):
    return trim.local_categories(dcm(spark, d))


@query("null_category", f"with {_CATS} select cat_id, name from cats union all select 0, '(null)'")
def null_category(spark, d):
    return trim.with_null_category(cats(spark, d))


# ---------------------------------------------------------------- matrices and weights


@query("tdm_raw", f"with {_TF} select doc_id, term, round(f, 6) as f from tdm0")
def tdm_raw(spark, d):
    return tdm0(spark, d).select("doc_id", "term", r6("f"))


@query("tcm_raw", f"with {_MATRIX} select term, cat_id, round(f, 6) as f from tcm0")
def tcm_raw(spark, d):
    return tcm0(spark, d).select("term", "cat_id", r6("f"))


@query("tdm_log", f"with {_TF} select doc_id, term, round(ln(f + 1.001), 6) as v from tdm0")
def tdm_log(spark, d):
    return matrix.log_transform(tdm0(spark, d), SMOOTH).select("doc_id", "term", r6("v"))


@query("smoothing_constant", f"with {_TF} select round((select count(*) from kept) / sum(f), 6) as s from tdm0")
def smoothing_constant(spark, d):
    return matrix.smoothing(tdm0(spark, d)).select(r6("s"))


@query("weight_uniform", f"with {_TF} select term, 1.0::double as tw from kept")
def weight_uniform(spark, d):
    return matrix.weights(tdm0(spark, d), "doc_id", "uniform")


@query("weight_hmax", f"with {_MATRIX} select term, round(1 - h / log2(n), 6) as tw from hd, nd")
def weight_hmax(spark, d):
    return matrix.weights(tdm0(spark, d), "doc_id", "max-entropy-quotient").select("term", r6("tw"))


@query(
    "weight_hq",
    f"""with {_MATRIX},
sz as (select doc_id, sum(f) as n from tdm0 group by 1), t as (select sum(n) as a, 0.5 * min(n) / sum(n) as e from sz),
q as (select (1 - e) * n / a + e as q from sz, t), top as (select sum(-q * log2(q)) as hmax from q)
select term, round(1 - h / hmax, 6) as tw from hd, top""",
)
def weight_hq(spark, d):
    return matrix.weights(tdm0(spark, d), "doc_id", "entropy-quotient").select("term", r6("tw"))


@query("weight_hc", f"with {_MATRIX} select term, round(abs(h), 6) as tw from hd")
def weight_hc(spark, d):
    return matrix.weights(tdm0(spark, d), "doc_id", "conditional-entropy").select("term", F.round(F.abs("tw"), 6).alias("tw"))


@query("weight_bycat", f"with {_MATRIX} select term, round(tw, 6) as tw from twc")
def weight_bycat(spark, d):
    return matrix.weights(tcm0(spark, d), "cat_id", "entropy").select("term", r6("tw"))


@query("weight_mix", f"with {_MATRIX} select term, round(0.5 + 0.5 * tw, 6) as tw from twc")
def weight_mix(spark, d):
    return matrix.weights(tcm0(spark, d), "cat_id", "entropy", raw=0.5, cooked=0.5).select("term", r6("tw"))


@query("weight_unmix", f"with {_MATRIX} select term, round(tw, 6) as tw0 from twc")
def weight_unmix(spark, d):
    w = matrix.weights(tcm0(spark, d), "cat_id", "entropy", raw=0.5, cooked=0.5)
    return w.select("term", F.round(matrix.raw_weight(F.col("tw"), 0.5, 0.5), 6).alias("tw0"))


@query("tdm_weighted", f"with {_MATRIX} select doc_id, term, round(ln(f + 1.001) * (1 - h / log2(n)), 6) as v from tdm0 join hd using (term), nd")
def tdm_weighted(spark, d):
    cells = tdm0(spark, d)
    return matrix.weighted(cells, matrix.weights(cells, "doc_id", "entropy"), SMOOTH).select("doc_id", "term", r6("v"))


@view
def tcm(spark, d):
    cells = tcm0(spark, d)
    return matrix.weighted(cells, matrix.weights(cells, "cat_id", "entropy"), SMOOTH)


@query("tcm_weighted", f"with {_MATRIX} select term, cat_id, round(v, 6) as v from tcm")
def tcm_weighted(spark, d):
    return tcm(spark, d).select("term", "cat_id", r6("v"))


@query("tdf0_tf0", f"with {_TF} select term, round(sum(f), 6) as tf0, count(*) filter (f >= 1) as tdf0 from tdm0 group by 1")
def tdf0_tf0(spark, d):
    return matrix.marginals(tdm0(spark, d)).select("term", r6("tf0"), "tdf0")


@query("invert_tdm", f"with {_MATRIX} select term, cat_id, round(f, 6) as f from tcm where abs(tw) > 1e-9")
def invert_tdm(spark, d):
    rows = tcm(spark, d).where(F.abs("tw") > 1e-9)
    return rows.select("term", "cat_id", F.round(matrix.inverted(F.col("v"), F.col("tw"), SMOOTH), 6).alias("f"))


# ---------------------------------------------------------------- raw classifier

_RAW = (
    _MATRIX
    + """,
dots as (select doc_id, cat_id, sum(t.f * c.v) as dot from tdm0 t join tcm c using (term) group by 1, 2),
ndoc as (select doc_id, sqrt(sum(f * f)) as nd from tdm0 group by 1), ncat as (select cat_id, sqrt(sum(v * v)) as nc from tcm group by 1),
alld as (select distinct doc_id from tfc), usedc as (select distinct cat_id from dcm),
rawd as (select a.doc_id, u.cat_id, round(greatest(0, least(2, coalesce(1 - coalesce(dot, 0) / (nd * nc), 2))), 6) as d
  from alld a cross join usedc u left join ndoc using (doc_id) left join ncat using (cat_id) left join dots using (doc_id, cat_id)),
rawr as (select *, row_number() over (partition by doc_id order by d, cat_id) as deg from rawd)
"""
)


def raw_ranks(spark, d):
    used = dcm(spark, d).select("cat_id").distinct()
    docs = tf(spark, d).select("doc_id").distinct()
    return classify.ranked(classify.raw_distances(tdm0(spark, d), tcm(spark, d), docs, used))


@query("classify_raw", f"with {_RAW} select doc_id, cat_id, d, deg from rawr")
def classify_raw(spark, d):
    return raw_ranks(spark, d).select("doc_id", "cat_id", "d", "deg")


@query("classify_raw_best", f"with {_RAW} select doc_id, cat_id, d from rawr where deg = 1")
def classify_raw_best(spark, d):
    return classify.best(raw_ranks(spark, d))


@query(
    "confusion_pairs",
    f"with {_RAW} select w.cat_id as cat1, g.cat_id as cat2, count(*) as ndocs from dcm w join rawr g using (doc_id) where g.deg = 1 group by 1, 2",
)
def confusion_pairs(spark, d):
    got = classify.best(raw_ranks(spark, d)).select(F.col("doc_id").alias("label"), F.col("cat_id").alias("cat"))
    want = dcm(spark, d).select(F.col("doc_id").alias("label"), F.col("cat_id").alias("cat"))
    return evaluate.pairs(evaluate.wanted_got(want, got))


# ---------------------------------------------------------------- evaluation


@query("eval_pairs", f"with {_BOTH} select * from pairs")
def eval_pairs(spark, d):
    return pairs(spark, d)


@query(
    "eval_one_sided",
    f"with {_BOTH} select doc_id as label, 'wanted' as side from dcm anti join near using (doc_id) union all select doc_id, 'got' from near anti join dcm using (doc_id)",
)
def eval_one_sided(spark, d):
    near = distances(spark, d).select(F.col("doc_id").alias("label")).distinct()
    return evaluate.one_sided(dcm(spark, d).select(F.col("doc_id").alias("label")), near)


@query(
    "eval_by_category",
    f'with {_BOTH} select cat, tp, fp, fn, round(pr, 6) as pr, round(rc, 6) as rc, round(F, 6) as "F", round(a, 6) as a from bycat',
)
def eval_by_category(spark, d):
    return evaluate.by_category(pairs(spark, d)).select("cat", "tp", "fp", "fn", r6("pr"), r6("rc"), r6("F"), r6("a"))


@view
def classed(spark, d):
    p = pairs(spark, d)
    return evaluate.classes(evaluate.by_category(p), p)


def _classes(spark, d):
    return pairs(spark, d), classed(spark, d)


@query("eval_classes", f"with {_BOTH} select cat, class from cls")
def eval_classes(spark, d):
    return _classes(spark, d)[1]


_MODES = ", ".join(f"('{m}', '{a}', '{x}', '{v if v != '^(?!null$)' else '^(safe|unsafe)$'}')" for m, a, x, v in evaluate.MODES)


@query(
    "eval_global_modes",
    f"""with {_BOTH},
modes(mode, allow, deny, av) as (values {_MODES}),
cp as (select p.*, a.class || '-' || b.class as pc from pairs p join cls a on a.cat = cat1 join cls b on b.cat = cat2),
picked as (select * from cp, modes where regexp_matches(pc, allow) and not regexp_matches(pc, deny)),
s2 as (select mode, av, cat1 as cat, case when cat1 = cat2 then ndocs else 0 end as tp, 0 as fp, case when cat1 = cat2 then 0 else ndocs end as fn from picked
  union all select mode, av, cat2, 0, ndocs, 0 from picked where cat1 <> cat2),
c2 as (select mode, cat, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from s2 join cls using (cat) where regexp_matches(class, av) group by 1, 2),
c3 as (select *, case when tp + fp <> 0 then tp / (tp + fp) else 1.0 end as pr, case when tp + fn <> 0 then tp / (tp + fn) else 1.0 end as rc from c2),
t1 as (select mode || '.total' as mode, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c2 group by 1),
t2 as (select *, case when tp + fp <> 0 then tp / (tp + fp) else 1.0 end as pr, case when tp + fn <> 0 then tp / (tp + fn) else 1.0 end as rc from t1),
av as (select mode || '.avg' as mode, avg(tp) as tp, avg(fp) as fp, avg(fn) as fn, avg(pr) as pr, avg(rc) as rc from c3 group by 1)
select mode, round(tp, 6)::double as tp, round(fp, 6)::double as fp, round(fn, 6)::double as fn, round(pr, 6) as pr, round(rc, 6) as rc,
  round(case when pr = 0 or rc = 0 then 0.0 else 2 / (1 / pr + 1 / rc) end, 6) as "F" from (select * from t2 union all select * from av)""",
)
def eval_global_modes(spark, d):
    rows = evaluate.global_modes(*_classes(spark, d))
    return rows.select("mode", *[r6(c) for c in ("tp", "fp", "fn", "pr", "rc", "F")])


_ERR = (
    _BOTH
    + """,
g0 as (select avg(fp) as fp, avg(fn) as fn, avg(pr) as pr, avg(rc) as rc, count(*) as n from bycat join cls using (cat) where class <> 'null'),
g1 as (select *, case when pr = 1 then 0 else 2 / (1 / (1 - pr) + 1) end as a, case when rc = 1 then 0 else 2 / (1 / (1 - rc) + 1) end as b from g0),
g as (select a / (a + b) / (fp * n) as per_fp, b / (a + b) / (fn * n) as per_fn from g1),
err as (select cat1, cat2, ndocs, ndocs / (select sum(ndocs) from pairs) as fdocs, case when cat1 = cat2 then 0.0
  else case when k1.class = 'null' then 0 else ndocs * per_fn end + case when k2.class = 'null' then 0 else ndocs * per_fp end end as ferrs
  from pairs join cls k1 on k1.cat = cat1 join cls k2 on k2.cat = cat2, g)
"""
)


@query("eval_error_share", f"with {_ERR} select cat1, cat2, ndocs, round(fdocs, 6) as fdocs, round(ferrs, 6) as ferrs from err")
def eval_error_share(spark, d):
    return evaluate.error_shares(*_classes(spark, d)).select("cat1", "cat2", "ndocs", r6("fdocs"), r6("ferrs"))


@query(
    "eval_error_total",
    f"with {_BOTH} select cat1, cat2, ndocs, round(case when cat1 = cat2 then 0 else ndocs / (select sum(ndocs) from pairs where cat1 <> cat2) end, 6)::double as ferrs from pairs",
)
def eval_error_total(spark, d):
    return evaluate.error_shares_total(pairs(spark, d)).select("cat1", "cat2", "ndocs", r6("ferrs"))


@query("eval_top_errors", f"with {_ERR} select cat1, cat2, ndocs, ferrs from (select cat1, cat2, ndocs, round(ferrs, 6) as ferrs from err) order by ferrs desc, cat1, cat2 limit 20")
def eval_top_errors(spark, d):
    rows = evaluate.error_shares(*_classes(spark, d)).withColumn("ferrs", F.round("ferrs", 6))
    return evaluate.top_errors(rows, 20).select("cat1", "cat2", "ndocs", "ferrs")


def _report_sql() -> str:
    pct = lambda x: f"printf('%6.2f', floor(10000 * ({x}) + 0.5 + 1e-9) / 100)"
    ctes = ORACLE["eval_global_modes"].rsplit("select mode, round(tp", 1)[0]
    f = "case when pr = 0 or rc = 0 then 0.0 else 2 / (1 / pr + 1 / rc) end"
    order = "coalesce(try_cast(nullif(regexp_extract(cat, '^([0-9]+)', 1), '') as bigint), -1), cat"
    return ctes + f""", md as (select mode, pr, rc, {f} as fm from (select * from t2 union all select * from av)),
g0 as (select avg(fp) as fp, avg(fn) as fn, avg(pr) as pr, avg(rc) as rc, count(*) as n from bycat join cls using (cat) where class <> 'null'),
g1 as (select *, case when pr = 1 then 0 else 2 / (1 / (1 - pr) + 1) end as a, case when rc = 1 then 0 else 2 / (1 / (1 - rc) + 1) end as b from g0),
gg as (select a / (a + b) / (fp * n) as per_fp, b / (a + b) / (fn * n) as per_fn from g1),
er as (select cat1, cat2, ndocs, case when cat1 = cat2 then 0.0 else case when k1.class = 'null' then 0 else ndocs * per_fn end + case when k2.class = 'null' then 0 else ndocs * per_fp end end as ferrs
  from pairs join cls k1 on k1.cat = cat1 join cls k2 on k2.cat = cat2, gg)
select 1 as part, row_number() over (order by mode)::int as pos, printf('%-20s pr=%s rc=%s F=%s', mode, {pct('pr')}, {pct('rc')}, {pct('fm')}) as line from md
union all select 2, row_number() over (order by {order})::int, printf('%-36s tp=%4d fp=%4d fn=%4d F=%s', cat, tp, fp, fn, {pct('F')}) from bycat
union all select 3, pos, line from (select row_number() over (order by round(ferrs, 9) desc, cat1, cat2)::int as pos, printf('%s %s -> %s (%d)', {pct('ferrs')}, cat1, cat2, ndocs) as line from er) where pos <= 10"""


@query("eval_report", _report_sql())
def eval_report(spark, d):
    p, c = _classes(spark, d)
    return evaluate.report(evaluate.global_modes(p, c), evaluate.by_category(p), evaluate.error_shares(p, c).withColumn("ferrs", F.round("ferrs", 9)))


@query("merge_evals", f"with {_BOTH} select cat1, cat2, 2 * ndocs as ndocs from pairs")
def merge_evals(spark, d):
    p = pairs(spark, d)
    return evaluate.merge(p, p)


@query("eval_accuracy", f"with {_BOTH} select round(avg(case when wanted = got then 1.0 else 0.0 end), 6)::double as accuracy from wg")
def eval_accuracy(spark, d):
    return evaluate.accuracy(both(spark, d)).select(r6("accuracy"))


@query(
    "confusion_conditional",
    f"with {_BOTH} select cat1, cat2, round(ndocs / sum(ndocs) over (), 6)::double as p12, round(ndocs / sum(ndocs) over (partition by cat2), 6)::double as p1g2, round(ndocs / sum(ndocs) over (partition by cat1), 6)::double as p2g1 from pairs",
)
def confusion_conditional(spark, d):
    return evaluate.conditional(pairs(spark, d)).select("cat1", "cat2", r6("p12"), r6("p1g2"), r6("p2g1"))


def _closer(strict: bool):
    sign = "<" if strict else "<="
    sql = f"""with {_CUT}, own_d as (select doc_id, own, d as d1 from full_m where cat_id = own)
select own as cat1, cat_id as cat2, count(*) as n from full_m join own_d using (doc_id, own) where d {sign} d1 group by 1, 2"""
    name = "closer_than_wanted_lt" if strict else "closer_than_wanted_le"

    @query(name, sql)
    def run(spark, d):
        return evaluate.closer_than_wanted(full_matrix(spark, d), wanted(spark, d), strict)


_closer(False)
_closer(True)


@query("mean_similarity", f"with {_CUT} select own as cat1, cat_id as cat2, round(avg(1 - d / 2) + 1e-9, 6) as sim from full_m group by 1, 2")
def mean_similarity(spark, d):
    return evaluate.mean_similarity(full_matrix(spark, d), wanted(spark, d)).select(
        "cat1", "cat2", F.round(F.col("sim") + 1e-9, 6).alias("sim")  # distances have 3 places: no ties at the 7th
    )


@query(
    "catcmp_order",
    "select name, row_number() over (order by coalesce(try_cast(regexp_extract(name, '^([0-9]+)', 1) as bigint), -1), encode(name)) as pos from (select distinct trim(name) as name from cat2id)",
)
def catcmp_order(spark, d):
    from pyspark.sql import Window as W

    names = load(spark, d, "cat2id").select(F.trim("name").alias("name")).distinct()
    return names.select("name", F.row_number().over(W.orderBy(*evaluate.category_order("name"))).alias("pos"))


# ---------------------------------------------------------------- distances, kNN, k-best on embeddings


def vectors(spark, d):
    x = F.transform("embedding", lambda v: v.cast("double"))
    return load(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), x.alias("x"), F.col("label").cast("long").alias("cat_id"))


def centroids(spark, d):
    from lexaris.operators.lsi import vector_sum

    v = vectors(spark, d)
    n = v.groupBy("cat_id").agg(F.count(F.lit(1)).alias("n"))
    out = vector_sum(v, "cat_id", F.col("x"), 64).join(n, "cat_id")
    return out.select("cat_id", F.transform("x", lambda a: a / F.col("n")).alias("x"))


_EMB = """
v as (select vec_id as doc_id, embedding::double[] as x, label::bigint as cat_id from embeddings),
cx as (select cat_id, i, avg(x[i]) as a from v, range(1, 65) t(i) group by 1, 2),
c as (select cat_id, array_agg(a order by i) as x from cx group by 1),
q as (select x from v where doc_id = (select min(doc_id) from v))
"""
_FORMULAS = {
    "cosine": ("u", "greatest(0, least(2, 1 - list_cosine_similarity(v.x, c.x)))"),
    "euclid": ("e", "pow(list_distance(v.x, c.x), 2) / 64"),
    "block": ("b", "list_sum(list_transform(list_zip(v.x, c.x), lambda p: abs(p[1] - p[2]))) / 64"),
    "pearson": (
        "c",
        "1 - list_cosine_similarity(list_transform(v.x, lambda a: a - list_avg(v.x)), list_transform(c.x, lambda a: a - list_avg(c.x)))",
    ),
}


def _distance(name: str, letter: str, formula: str):
    @query(f"dist_{name}", f"with {_EMB} select doc_id, c.cat_id, round({formula}, 6) as d from v cross join c")
    def run(spark, d):
        from lexaris.operators.lsi import distances as all_distances

        return all_distances(vectors(spark, d).select("doc_id", "x"), centroids(spark, d), letter).select("doc_id", "cat_id", r6("d"))


for _name, (_letter, _formula) in _FORMULAS.items():
    _distance(_name, _letter, _formula)


#: Blocks of queries and of rows that are met block by block.
QUERY_BLOCKS = 8


def queried(spark, d):
    """(doc_id, other, d): every vector whose id is divisible by 100 to all others."""
    v = vectors(spark, d)
    q = v.where(F.col("doc_id") % 100 == 0).select("doc_id", F.col("x").alias("q"))
    rest = v.select(F.col("doc_id").alias("other"), "x")
    # a stated set of queries against all rows, block by block of queries, so that no task gets all of them
    block = F.pmod(F.xxhash64("doc_id"), F.lit(QUERY_BLOCKS))
    q = q.withColumn("block", block)
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(QUERY_BLOCKS - 1).cast("long"))))
    salt = F.pmod(F.xxhash64("other"), F.lit(QUERY_BLOCKS))
    q = q.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(QUERY_BLOCKS - 1).cast("long"))))
    rows = rest.withColumn("salt", salt).join(q, ["block", "salt"]).where(F.col("other") != F.col("doc_id"))
    return rows.select("doc_id", "other", F.round(V.cosine_distance(F.col("q"), F.col("x")), 6).alias("d"))


_NEAR = _EMB + """,
qd as (select a.doc_id, b.doc_id as other, b.cat_id, round(greatest(0, least(2, 1 - list_cosine_similarity(a.x, b.x))), 6) as d
  from v a join v b on a.doc_id <> b.doc_id where a.doc_id % 100 = 0),
nn as (select *, row_number() over (partition by doc_id order by d, other) as r from qd),
nk as (select *, case when d <= 0 then 1e38 else least(1 / d, 1e38) end as sim from nn where r <= 10)
"""


@query("knn_neighbours", f"with {_NEAR} select doc_id, other, d from nk")
def knn_neighbours(spark, d):
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("d", "other")
    return queried(spark, d).withColumn("r", F.row_number().over(order)).where("r <= 10").drop("r")


@query(
    "knn_vote",
    f"with {_NEAR}, p as (select *, sim / sum(sim) over (partition by doc_id) as p from nk) select doc_id, cat_id, round(sum(p), 6) as score from p group by 1, 2",
)
def knn_vote(spark, d):
    labels = vectors(spark, d).select("doc_id", "cat_id", F.lit(1).alias("deg"))
    return classify.neighbour_votes(queried(spark, d), labels, 10).select("doc_id", "cat_id", r6("score"))


def _first_vector(spark, d):
    row = vectors(spark, d).orderBy("doc_id").limit(1).select("x").first()
    return F.array(*[F.lit(float(a)) for a in row["x"]])


_KBEST = _EMB + ", kd as (select doc_id, round(greatest(0, least(2, 1 - list_cosine_similarity(v.x, q.x))), 6) as d from v, q)"


@query("kbest_docs_vec", f"with {_KBEST} select doc_id, d from kd order by d, doc_id limit 10")
def kbest_docs_vec(spark, d):
    q = _first_vector(spark, d)
    rows = vectors(spark, d).select("doc_id", F.round(V.cosine_distance(F.col("x"), q), 6).alias("d"))
    return rows.orderBy("d", "doc_id").limit(10)


@query(
    "kbest_masked",
    f"with {_MATRIX} select term, round(case when sum(f) < 20 or count(*) filter (f >= 1) < 8 then 'inf'::double else 1 - h / log2(n) end, 6) as d from tdm0 join hd using (term), nd group by term, h, n",
)
def kbest_masked(spark, d):
    cells = tdm0(spark, d)
    rows = matrix.weights(cells, "doc_id", "entropy").join(matrix.marginals(cells), "term")
    masked = search.masked(F.col("tw"), F.col("tf0"), F.col("tdf0"), 20, 8)
    return rows.select("term", F.round(masked, 6).alias("d"))


@query(
    "kbest_norm_gauss",
    f"with {_KBEST}, m as (select avg(d) as mu, stddev_pop(d) as sd from kd), b as (select * from kd order by d, doc_id limit 10) select doc_id, round(0.5 * (1 + {erf_sql('((d - mu) / (sd * 1.4142135623730951))')}), 6) as d from b, m",
)
def kbest_norm_gauss(spark, d):
    q = _first_vector(spark, d)
    rows = vectors(spark, d).select("doc_id", F.round(V.cosine_distance(F.col("x"), q), 6).alias("d"))
    return search.normalised(rows.orderBy("d", "doc_id").limit(10), "gauss", rows).select("doc_id", r6("d"))


# ---------------------------------------------------------------- cut-offs


@query("distance_matrix", f"with {_CUT} select doc_id, cat_id, d from full_m")
def distance_matrix(spark, d):
    return full_matrix(spark, d)


@query("fit_gaussians", f"with {_CUT} select cat_id, is_member, n, round(mu, 6) as mu, round(sd, 6) as sd from fits")
def fit_gaussians(spark, d):
    return cutoff.fit_sparse(distances(spark, d), wanted(spark, d), cats(spark, d)).select("cat_id", "is_member", "n", r6("mu"), r6("sd"))


def cuts(spark, d):
    return cutoff.cutoffs(cutoff.repaired(cutoff.fit_sparse(distances(spark, d), wanted(spark, d), cats(spark, d)), cats(spark, d)))


@query("cutoff_vector", f"with {_CUT} select cat_id, round(mu0, 6) as mu0, round(sd0, 6) as sd0, round(mu1, 6) as mu1, round(sd1, 6) as sd1, round(cutoff, 6) as cutoff from cuts")
def cutoff_vector(spark, d):
    return cuts(spark, d).select("cat_id", r6("mu0"), r6("sd0"), r6("mu1"), r6("sd1"), r6("cutoff"))


@query(
    "cutoff_apply",
    f"""with {_CUT},
app as (select doc_id, cat_id, d, case when d > cutoff then 1 else 0 end as cut, round(1 - 0.5 * (1 + {erf_sql('((d - mu1) / (sd1 * 1.4142135623730951))')}), 6) as confp
  from full_m join cuts using (cat_id))
select doc_id, cat_id, d, cut, round(confp + 1e-8, 5) as confp, floor(10 * confp)::int as confi, row_number() over (partition by doc_id order by cut, round(d, 6), cat_id) as deg from app""",
)
def cutoff_apply(spark, d):
    return cutoff.apply(full_matrix(spark, d), cuts(spark, d)).select("doc_id", "cat_id", "d", "cut", F.round(F.col("confp") + 1e-8, 5).alias("confp"), "confi", "deg")


def _fitness(spark, d):
    return cutoff.fitness(cutoff.decide(full_matrix(spark, d), cuts(spark, d)), wanted(spark, d))


for _fit, _sql in {
    "acc": "select round(avg(case when own = got then 1.0 else 0.0 end), 6)::double as acc from decided",
    "f": "select round(2 / (1 / avg(pr) + 1 / avg(rc)), 6) as \"F\" from fit_c",
    "avg": "select round(avg((pr + rc) / 2), 6) as avg from fit_c",
    "min": "select round(avg(least(pr, rc)), 6) as min from fit_c",
}.items():

    def _run(spark, d, column="F" if _fit == "f" else _fit):
        return _fitness(spark, d).select(r6(column))

    query(f"fitness_{_fit}", f"with {_CUT} {_sql}")(_run)


@query("optimize_cutoffs")
def optimize_cutoffs(spark, d):
    return cutoff.optimize(full_matrix(spark, d), wanted(spark, d), cuts(spark, d), rounds=20)


# ---------------------------------------------------------------- corpora


@query(
    "corpus_info",
    f"""with {_CATS},
b as (select doc_id, bytes from (select *, row_number() over (partition by doc_id order by seen_at desc nulls last, bytes desc nulls last) as r from docs where doc_id is not null) where r = 1),
s as (select cat_id, count(*) as n_docs, sum(coalesce(bytes, 0))::bigint as n_bytes from dcm join b using (doc_id) group by 1)
select cat_id, n_docs, n_bytes, round(100.0 * n_docs / sum(n_docs) over (), 6)::double as doc_share, round(100.0 * n_bytes / sum(n_bytes) over (), 6)::double as byte_share from s""",
)
def corpus_info(spark, d):
    return corpus.info(documents(spark, d), dcm(spark, d)).select("cat_id", "n_docs", "n_bytes", r6("doc_share"), r6("byte_share"))


@query("corpus_sizedat", f"with {_CATS}, s as (select cat_id, count(*) as n from dcm group by 1) select cat_id, name, n, round(n / sum(n) over (), 6)::double as share from s join cats using (cat_id)")
def corpus_sizedat(spark, d):
    return corpus.size_data(dcm(spark, d), cats(spark, d)).select("cat_id", "name", "n", r6("share"))


@query("corpus_union", "select source, count(*) as n from (select source from documents union all select source from documents) group by 1")
def corpus_union(spark, d):
    docs = load(spark, d, "documents").select("source")
    return corpus.union(docs, docs).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select_by_cat", f"with {_CATS} select doc_id from dcm join cats using (cat_id) where subject = 'law'")
def select_by_cat(spark, d):
    return corpus.select_by_category(members(spark, d), cats(spark, d).where("subject = 'law'"))


@query("select_max_cats", f"with {_CATS} select doc_id from members group by 1 having count(*) <= 1")
def select_max_cats(spark, d):
    return corpus.select_by_ambiguity(members(spark, d), 1)


@query("select_max_deg", f"with {_CATS} select doc_id, cat_id, deg from members where deg <= 1")
def select_max_deg(spark, d):
    return corpus.select_by_degree(members(spark, d), 1)


@query(
    "cat_ambiguity",
    f"with {_CATS}, n as (select doc_id, count(*) as n from members group by 1) select count(*) as n_docs, sum(n)::bigint as n_members, count(*) filter (n = 1) as n_plain, round(avg(n), 6) as mean_cats from n",
)
def cat_ambiguity(spark, d):
    return corpus.ambiguity(members(spark, d)).select("n_docs", "n_members", "n_plain", r6("mean_cats"))


@query(
    "cat_unions",
    f"with {_CATS}, u as (select doc_id, array_to_string(list_sort(list_distinct(list(name))), ' | ') as cats from members join cats using (cat_id) group by 1) select cats, count(*) as n_docs from u group by 1",
)
def cat_unions(spark, d):
    return corpus.category_unions(members(spark, d), cats(spark, d).withColumnRenamed("name", "cat"))


@query(
    "doc_profile_top_terms",
    f"with {_MATRIX}, w as (select doc_id, term, round(ln(f + 1.001) * (1 - h / log2(n)), 6) as v from tdm0 join hd using (term), nd), r as (select *, row_number() over (partition by doc_id order by v desc, encode(term)) as rank from w) select * from r where rank <= 10",
)
def doc_profile_top_terms(spark, d):
    cells = tdm0(spark, d)
    rows = matrix.weighted(cells, matrix.weights(cells, "doc_id", "entropy"), SMOOTH).withColumn("v", F.round("v", 6))
    return corpus.best_terms(rows, "doc_id", 10)


@query(
    "cat_best_terms",
    f"with {_MATRIX}, w as (select cat_id, term, round(v, 6) as v from tcm), r as (select *, row_number() over (partition by cat_id order by v desc, encode(term)) as rank from w) select * from r where rank <= 50",
)
def cat_best_terms(spark, d):
    return corpus.best_terms(tcm(spark, d).withColumn("v", F.round("v", 6)), "cat_id", 50)


@query(
    "model_category_sizes",
    f"with {_MATRIX}, b as (select cat_id, doc_id, sum(f) as f, count(*) as c from tdm0 join dcm using (doc_id) group by 1, 2) select cat_id, count(*) as n_docs, round(sum(f), 6) as n_tokens, sum(c)::bigint as n_cells from b group by rollup (cat_id)",
)
def model_category_sizes(spark, d):
    return corpus.category_sizes(tdm0(spark, d), dcm(spark, d)).select("cat_id", "n_docs", r6("n_tokens"), "n_cells")


@query("sem_split", f"with {_TF}, b as (select term, sum(f) as f from tfc group by 1) select starts_with(term, 'SEM') as is_sem, count(*) as n_terms, round(sum(f), 6) as n_tokens from b group by 1")
def sem_split(spark, d):
    return corpus.semantic_split(tf(spark, d)).select("is_sem", "n_terms", r6("n_tokens"))


@query("split_folds")
def split_folds(spark, d):
    return corpus.split(documents(spark, d).join(dcm(spark, d), "doc_id"), 5)


# ---------------------------------------------------------------- query language, labels, lemmata


@query("query_parse", "select * from (values ('term', 'Eisen', 9.0::double), ('term', 'Erz', 4.0::double), ('doc', 'heft', 1.0::double), ('cat', 'recht', 1.0::double), ('term', 'foo:1.5', 1.0::double)) t(kind, body, weight)")
def query_parse(spark, d):
    return spark.createDataFrame(search.parse("Eisen:9 Erz:3;Erz doc=heft:2, cls:recht foo:1.5"), "kind string, body string, weight double")


@query("label_regex_lookup", "select distinct name from cat2id where regexp_matches(name, 'recht$')")
def label_regex_lookup(spark, d):
    return search.lookup(load(spark, d, "cat2id").select("name").distinct(), "name", "recht$")


def _keys(spark, d):
    """Tokens of the texts as keys with made-up attributes, for the lemmatizers."""
    tokens = signatures.count_tokens(signatures.tokenize(load(spark, d, "documents")))
    tag = F.when(F.length("term") % 3 == 0, "ART").otherwise("NN")
    key = F.concat(F.lit("norm="), "term", F.lit("\tpos="), tag, F.lit("\tlemma="), F.initcap("term"))
    return tokens.select("doc_id", key.alias("key"), "f")


_LEM = "t as (select doc_id, term, count(*)::double as f from (select doc_id, unnest(regexp_extract_all(lower(text), '(\\p{L}+)', 1)) as term from documents) group by 1, 2)"


@query("lemma_content", f"with {_LEM} select doc_id, term, f from t where length(term) % 3 <> 0 and regexp_matches(term, '[a-z]')")
def lemma_content(spark, d):
    return lemmatize(_keys(spark, d), CONTENT)


@query("lemma_sep", f"with {_LEM} select doc_id, term, 2 * f as f from t where length(term) % 3 <> 0 and regexp_matches(term, '[a-z]')")
def lemma_sep(spark, d):
    return lemmatize(_keys(spark, d), SEP)
