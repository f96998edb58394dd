"""Vectors, kNN classification, pair distances and their statistics (§2.9, §2.10)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citeweave.functions.columns import cosine_similarity, doi_journal, hash_sql, norm2, uniform_sql
from citeweave.operators import clean, evaluate, relate, stats
from citeweave.operators import vectors as V
from citeweave.operators.sample import sample_with_replacement_pairs, trial_split, with_hash_rank
from citeweave.plans.fixture_sql import with_views
from citeweave.plans.q_core import vector_pacs
from citeweave.plans.registry import register
from citeweave.plans.sqlparts import FOCUS, clean_codes_views, lst, modal_view
from citeweave.session import materialize
from citeweave.sources import fixtures as fx

KS = [2, 4, 8, 16, 32, 64, 128]
TRIALS = [1, 2, 3]
QUALITY_KS = [3, 5, 10, 15, 20, 25, 30]
STRATA = ["same_2", "same_1", "diff", "rand"]


def R6(c):
    return F.round(c, 6)


def doi_id(c="doi"):
    return F.element_at(F.split(F.col(c), r"\."), -1).cast("long")


def vec_table(spark, d):
    """``doi, id, vec, label`` (paper vectors)."""
    return fx.vectors(spark, d).withColumn("id", doi_id())


# ------------------------------------------------------------------ SQL building blocks
VEC_VIEWS = [
    ("vecs", "SELECT doi, CAST(string_split(doi, '.')[-1] AS BIGINT) AS id, vec, label FROM vectors"),
]
NORM = ("CASE WHEN sqrt(list_inner_product(vec, vec)) > 0 THEN list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) "
        "ELSE vec END")


def cos_sql(a: str, b: str) -> str:
    return (f"CASE WHEN sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b})) > 0 THEN "
            f"list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))) END")


def dist_sql(q: str, t: str) -> str:
    return f"list_distance({q}, {t})"


def uni(*parts: str) -> str:
    return uniform_sql(*parts)


def values_sql(vals, name):
    return "(VALUES " + ", ".join(f"({v})" for v in vals) + f") {name}({name})"


def scores_sql(src: str, g: list[str], prefix: str) -> list[tuple[str, str]]:
    gs = ", ".join(g)
    return [
        (f"{prefix}_lc", f"""
            SELECT {gs}, label, sum(t) AS support, sum(p) AS n_pred, sum(tp) AS tp FROM (
              SELECT {gs}, CAST(true_label AS VARCHAR) AS label, 1 AS t, 0 AS p,
                     CASE WHEN true_label = pred_label THEN 1 ELSE 0 END AS tp
              FROM {src} WHERE true_label IS NOT NULL AND pred_label IS NOT NULL
              UNION ALL
              SELECT {gs}, CAST(pred_label AS VARCHAR), 0, 1, 0
              FROM {src} WHERE true_label IS NOT NULL AND pred_label IS NOT NULL)
            GROUP BY {gs}, label"""),
        (f"{prefix}_per", f"""
            SELECT *, CASE WHEN P + R > 0 THEN 2 * P * R / (P + R) ELSE 0.0 END AS F FROM (
              SELECT *, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS P,
                        CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS R FROM {prefix}_lc)"""),
        (f"{prefix}_agg", f"""
            SELECT {gs}, sum(tp) AS stp, sum(support) AS n, sum(n_pred) AS npred, avg(P) AS maP, avg(R) AS maR, avg(F) AS maF,
                   sum(P * support) AS wP, sum(R * support) AS wR, sum(F * support) AS wF
            FROM {prefix}_per GROUP BY {gs}"""),
        (f"{prefix}_scores", f"""
            SELECT {gs}, 'micro' AS average, mp AS precision, mr AS recall,
                   CASE WHEN mp + mr > 0 THEN 2 * mp * mr / (mp + mr) ELSE 0.0 END AS f1_score FROM (
              SELECT *, CASE WHEN npred > 0 THEN stp / npred ELSE 0.0 END AS mp, CASE WHEN n > 0 THEN stp / n ELSE 0.0 END AS mr
              FROM {prefix}_agg)
            UNION ALL SELECT {gs}, 'macro', maP, maR, maF FROM {prefix}_agg
            UNION ALL SELECT {gs}, 'weighted', CASE WHEN n > 0 THEN wP / n ELSE 0.0 END, CASE WHEN n > 0 THEN wR / n ELSE 0.0 END,
                             CASE WHEN n > 0 THEN wF / n ELSE 0.0 END FROM {prefix}_agg"""),
    ]


KNN_VIEWS = clean_codes_views() + [modal_view()] + VEC_VIEWS + [
    ("lab", f"""SELECT v.doi, v.id, {NORM} AS vec, m.pacs_code_1 AS label, split_part(substr(v.doi, 9), '.', 1) AS journal
                FROM vecs v JOIN modal m ON v.doi = m.doi WHERE v.doi IN (SELECT doi FROM abstracts)"""),
    ("runs", f"""SELECT l.*, t.trial, s.is_all_journals, {uni('t.trial', 'l.id')} < 0.2 AS is_test
                 FROM lab l CROSS JOIN (VALUES (1), (2), (3)) t(trial)
                 CROSS JOIN (VALUES (0), (1)) s(is_all_journals)
                 WHERE s.is_all_journals = 1 OR l.journal IN ({FOCUS})"""),
    ("nbr", f"""SELECT q.trial, q.is_all_journals, q.doi AS qdoi, q.label AS true_label, t.doi AS ndoi, t.label AS nlabel,
                       row_number() OVER (PARTITION BY q.trial, q.is_all_journals, q.doi ORDER BY {dist_sql('q.vec', 't.vec')}, t.id) AS rank
                FROM runs q JOIN runs t ON q.trial = t.trial AND q.is_all_journals = t.is_all_journals AND q.is_test AND NOT t.is_test"""),
    ("votes", f"""SELECT trial, is_all_journals, qdoi, true_label, k, nlabel, count(*) AS n FROM nbr
                  JOIN {values_sql(KS, 'k')} ON nbr.rank <= k.k GROUP BY ALL"""),
    ("knn", """SELECT qdoi AS doi, true_label, nlabel AS pred_label, trial, is_all_journals, k FROM (
                 SELECT *, row_number() OVER (PARTITION BY trial, is_all_journals, qdoi, k ORDER BY n DESC, nlabel ASC) AS rn FROM votes)
               WHERE rn = 1"""),
]


# ------------------------------------------------------------------ tails of distributions, by Simpson's rule
def _integral(density, upto: str, steps: int = 2000) -> str:
    """SQL of the integral from 0 to ``upto`` of ``density`` (SQL of a point -> SQL of the value there)."""
    factor = f"(CASE WHEN i = 0 OR i = {steps} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
    return (f"(list_sum(list_transform(range({steps + 1}), lambda i: {factor} * {density(f'(({upto}) * i / {steps}.0)')}))"
            f" * ({upto}) / {3 * steps}.0)")


def norm_cdf_sql(z: str) -> str:
    upto = f"least(abs({z}), 30.0)"
    return f"greatest(0.0, 0.5 + sign({z}) * {_integral(lambda x: f'exp(-pow({x}, 2) / 2)', upto)} / sqrt(2 * pi()))"


def t_cdf_sql(t: str, df: str) -> str:
    scale = f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi())"
    body = _integral(lambda x: f"pow(1 + pow({x}, 2) / {df}, -({df} + 1) / 2.0)", f"least(abs({t}), 60.0)")
    return f"greatest(0.0, 0.5 + sign({t}) * {scale} * {body})"


def chi2_sf3_sql(x: str) -> str:
    """Chi-square tail with three degrees of freedom (four groups)."""
    return f"(2 * (1 - {norm_cdf_sql(f'sqrt({x})')}) + sqrt(2 * {x} / pi()) * exp(-{x} / 2))"


def t_quantile_sql(df: str) -> str:
    """0.975 quantile of Student's t, by the expansion of Cornish and Fisher in 1 / df."""
    z = 1.959963984540054
    c = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
         (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160]
    return f"({z!r} + " + " + ".join(f"{v!r} / pow({df}, {k + 1})" for k, v in enumerate(c)) + ")"


# ------------------------------------------------------------------ row measures
@register("l2_normalize", "V8", with_views(
    f"""SELECT doi, round(list_sum(nv), 6) AS sum_normed, round(sqrt(list_inner_product(nv, nv)), 6) AS norm_normed
        FROM (SELECT doi, {NORM} AS nv FROM vectors)""", "vectors"))
def q_l2_normalize(spark, d):
    v = V.normalize_rows(fx.vectors(spark, d))
    return v.select("doi", R6(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)).alias("sum_normed"),
                    R6(norm2("vec")).alias("norm_normed"))


@register("pair_cosine", "V9 J9", with_views(
    f"""SELECT e.citing, e.cited, e.s, round(1 - {cos_sql('a.vec', 'b.vec')}, 6) AS cos_dist
        FROM link_edges e JOIN raw_vectors a ON e.citing = a.id JOIN raw_vectors b ON e.cited = b.id""",
    "link_edges", "raw_vectors"))
def q_pair_cosine(spark, d):
    r = V.pair_cosine(fx.link_edges(spark, d), fx.raw_vectors(spark, d), "citing", "cited", key="id")
    return r.select("citing", "cited", "s", R6(F.col("cos_dist")).alias("cos_dist"))


@register("semantic_axis", "V14", with_views(
    f"""SELECT v.doi, round({cos_sql('v.vec', 'ax.axis')}, 6) AS axis_cos FROM vectors v CROSS JOIN (
          SELECT list(a ORDER BY pos) AS axis FROM (
            SELECT pos, sum(CASE WHEN side = 'pos' THEN m ELSE 0 END) - sum(CASE WHEN side = 'neg' THEN m ELSE 0 END) AS a FROM (
              SELECT side, pos, avg(val) AS m FROM (
                SELECT CASE WHEN label = 0 THEN 'pos' ELSE 'neg' END AS side, unnest(vec) AS val, unnest(range(len(vec))) AS pos
                FROM vectors WHERE label IN (0, 1)) GROUP BY side, pos) GROUP BY pos)) ax""", "vectors"))
def q_semantic_axis(spark, d):
    v = fx.vectors(spark, d)
    sides = v.where(F.col("label").isin(0, 1)).select("doi", F.when(F.col("label") == 0, "pos").otherwise("neg").alias("side"))
    return V.semantic_axis(v, sides).select("doi", R6(F.col("axis_cos")).alias("axis_cos"))


# ------------------------------------------------------------------ centroids and ROG
ROG_VIEWS = clean_codes_views() + [
    ("stk", """SELECT DISTINCT doi, level, code FROM (
                 SELECT doi, '1' AS level, pacs_code_1 AS code FROM pacs UNION ALL SELECT doi, '2', pacs_code_2 FROM pacs
                 UNION ALL SELECT doi, '3', pacs_code_3 FROM pacs UNION ALL SELECT doi, '5', pacs_code_5 FROM pacs)"""),
    ("mem", "SELECT s.doi, s.level, s.code, v.vec FROM stk s JOIN vectors v ON s.doi = v.doi"),
    ("cent", """SELECT level, code, pos, avg(DISTINCT val) AS c FROM (
                  SELECT level, code, unnest(vec) AS val, unnest(range(len(vec))) AS pos FROM mem) GROUP BY level, code, pos"""),
    ("centa", "SELECT level, code, list(c ORDER BY pos) AS centroid FROM cent GROUP BY level, code"),
    ("rogt", f"""SELECT m.level, m.code, CAST(count(DISTINCT m.doi) AS BIGINT) AS paper_ct,
                        avg(pow(1 - {cos_sql('m.vec', 'c.centroid')}, 2)) AS rog
                 FROM mem m JOIN centa c ON m.level = c.level AND m.code = c.code GROUP BY m.level, m.code"""),
]


def rog_table(spark, d):
    return V.radius_of_gyration(fx.vectors(spark, d), vector_pacs(spark, d), LEVELS)


def rog_values(spark, d):
    """ROG per (level, code) rounded to 1e-9 (so engine round-off cannot split
    ties), stored once because the statistics below read it several times."""
    return materialize(rog_table(spark, d).select("level", F.round("rog", 9).alias("v")), "rog-values")


LEVELS = ["pacs_code_1", "pacs_code_2", "pacs_code_3", "pacs_code_5"]


@register("class_centroid", "A6 J16", with_views(
    "SELECT level, code, CAST(pos AS BIGINT) AS pos, round(c, 6) AS c FROM cent", "vectors", "dirty_codes_wide", extra=ROG_VIEWS))
def q_class_centroid(spark, d):
    mem = V.class_members(fx.vectors(spark, d), vector_pacs(spark, d), LEVELS)
    c = V.class_centroids(mem, ["level", "code"])
    return c.select("level", "code", F.col("pos").cast("bigint").alias("pos"), R6(F.col("c")).alias("c"))


@register("centroid_distance", "A20 J16 V9", with_views(
    f"""SELECT m.doi, m.level, m.code, round(1 - {cos_sql('m.vec', 'c.centroid')}, 6) + 0.0 AS dist
        FROM mem m JOIN centa c ON m.level = c.level AND m.code = c.code""", "vectors", "dirty_codes_wide", extra=ROG_VIEWS))
def q_centroid_distance(spark, d):
    r = V.centroid_distances(fx.vectors(spark, d), vector_pacs(spark, d), LEVELS)
    return r.select("doi", "level", "code", (R6(F.col("dist")) + 0.0).alias("dist"))  # no negative zero


@register("rog", "V15 J7 A6 J16 A7 A8 V9", with_views(
    "SELECT level, code, paper_ct, round(rog, 6) AS rog FROM rogt", "vectors", "dirty_codes_wide", extra=ROG_VIEWS))
def q_rog(spark, d):
    r = rog_table(spark, d)
    return r.select("level", "code", F.col("paper_ct").cast("bigint"), R6(F.col("rog")).alias("rog"))


_FIVE_SQL = """
    SELECT q.level, CAST(q.n AS BIGINT) AS n, round(q.q1, 6) AS q1, round(q.median, 6) AS median, round(q.q3, 6) AS q3,
           round(min(CASE WHEN r.v >= q.q1 - 1.5 * (q.q3 - q.q1) THEN r.v END), 6) AS whisker_lo,
           round(max(CASE WHEN r.v <= q.q3 + 1.5 * (q.q3 - q.q1) THEN r.v END), 6) AS whisker_hi
    FROM (SELECT level, count(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
          FROM rv GROUP BY level) q JOIN rv r ON q.level = r.level
    GROUP BY q.level, q.n, q.q1, q.median, q.q3"""


@register("rog_by_level", "A5 A17", with_views(_FIVE_SQL, "vectors", "dirty_codes_wide",
                                               extra=ROG_VIEWS + [("rv", "SELECT level, round(rog, 9) AS v FROM rogt")]))
def q_rog_by_level(spark, d):
    r = rog_values(spark, d)
    f = stats.five_number(r, "level", "v")
    return f.select("level", F.col("n").cast("bigint"), *[R6(F.col(c)).alias(c) for c in
                                                          ["q1", "median", "q3", "whisker_lo", "whisker_hi"]])


# Fixed display names for code levels (presentation only).
LEVEL_NAMES = [("1", "Level 1 (discipline)"), ("2", "Level 2 (sub-discipline)"), ("3", "Level 3 (topic)"), ("5", "Level 5 (code)")]


@register("label_names", "P22 P23", with_views(
    """SELECT n.name AS level_name, printf('%,.4f', median) AS median_text, CAST(count(*) AS BIGINT) AS n_codes
       FROM (SELECT level, round(rog, 9) AS v, median(round(rog, 9)) OVER (PARTITION BY level) AS median FROM rogt) r
       JOIN (VALUES ('1', 'Level 1 (discipline)'), ('2', 'Level 2 (sub-discipline)'), ('3', 'Level 3 (topic)'), ('5', 'Level 5 (code)')) n(level, name)
         ON r.level = n.level GROUP BY n.name, median""", "vectors", "dirty_codes_wide", extra=ROG_VIEWS))
def q_label_names(spark, d):
    r = rog_values(spark, d)
    med = stats.exact_quantiles(r, "level", "v", [0.5]).select("level", F.col("q_0").alias("median"),
                                                                F.col("n").alias("n_codes"))
    names = spark.createDataFrame(LEVEL_NAMES, "level string, level_name string")
    return med.join(F.broadcast(names), "level").select("level_name", F.format_number("median", 4).alias("median_text"),
                                                          F.col("n_codes").cast("bigint"))


# ------------------------------------------------------------------ kNN
def knn_frame(spark, d):
    v = vec_table(spark, d)
    modal = relate.modal_code(vector_pacs(spark, d))
    ab = fx.abstracts(spark, d).select("doi")
    lab = (v.join(ab, "doi", "left_semi").join(modal, "doi")
           .select("doi", "id", "vec", F.col("pacs_code_1").alias("label"), doi_journal("doi").alias("journal")))
    lab = materialize(V.normalize_rows(lab), "labelled")  # the search and the votes read it many times
    focus = F.col("journal").isin(fx.FOCUS_JOURNALS)
    runs = lab.withColumn("is_all_journals", F.explode(F.when(focus, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    return lab, trial_split(runs, "id", TRIALS)


def knn_predictions(spark, d):
    lab, split = knn_frame(spark, d)
    by = ["trial", "is_all_journals"]
    q = split.where("is_test")
    t = split.where(~F.col("is_test"))
    nb = V.knn_search(q, t, max(KS), qid="id", tid="id", by=by)
    votes = V.knn_vote(nb, lab.select(F.col("id").alias("nid"), "label"), KS, by=by)
    truth = lab.select(F.col("id").alias("qid"), "doi", F.col("label").alias("true_label"))
    return votes.join(truth, "qid").select("doi", "true_label", F.col("pred").alias("pred_label"), "trial",
                                           "is_all_journals", "k")


@register("knn_classify", "V11 V10 A14 V8 M6 M8 J8 S12 P26", with_views(
    "SELECT * FROM knn", "vectors", "abstracts", "dirty_codes_wide", extra=KNN_VIEWS))
def q_knn_classify(spark, d):
    return knn_predictions(spark, d)


@register("knn_topk", "W15 V10", with_views(
    "SELECT qdoi, CAST(rank AS INTEGER) AS rank, ndoi FROM nbr WHERE trial = 1 AND is_all_journals = 1 AND rank <= 10",
    "vectors", "abstracts", "dirty_codes_wide", extra=KNN_VIEWS))
def q_knn_topk(spark, d):
    _, split = knn_frame(spark, d)
    s = split.where((F.col("trial") == 1) & (F.col("is_all_journals") == 1))
    nb = V.knn_search(s.where("is_test"), s.where(~F.col("is_test")), 10, qid="id", tid="id")
    ids = s.select("id", "doi").distinct()
    return (nb.join(ids.select(F.col("id").alias("qid"), F.col("doi").alias("qdoi")), "qid")
            .join(ids.select(F.col("id").alias("nid"), F.col("doi").alias("ndoi")), "nid")
            .select("qdoi", F.col("rank").cast("int"), "ndoi"))


def _round_scores(df, keys):
    return df.select(*keys, "average", *[R6(F.col(c)).alias(c) for c in ["precision", "recall", "f1_score"]])


@register("classification_scores", "E1", with_views(
    "SELECT trial, is_all_journals, k, average, round(precision, 6) AS precision, round(recall, 6) AS recall, "
    "round(f1_score, 6) AS f1_score FROM s_scores",
    "vectors", "abstracts", "dirty_codes_wide", extra=KNN_VIEWS + scores_sql("knn", ["trial", "is_all_journals", "k"], "s")))
def q_classification_scores(spark, d):
    s = evaluate.classification_scores(knn_predictions(spark, d), ["trial", "is_all_journals", "k"])
    return _round_scores(s, ["trial", "is_all_journals", "k"])


@register("knn_trials", "M8 A11", with_views(
    """SELECT trial, is_all_journals, k, CAST(count(*) AS BIGINT) AS n_test,
              round(avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
       FROM knn GROUP BY trial, is_all_journals, k""", "vectors", "abstracts", "dirty_codes_wide", extra=KNN_VIEWS))
def q_knn_trials(spark, d):
    p = knn_predictions(spark, d)
    return p.groupBy("trial", "is_all_journals", "k").agg(
        F.count(F.lit(1)).alias("n_test"), R6(F.avg((F.col("true_label") == F.col("pred_label")).cast("double"))).alias("accuracy"))


def _score_summary_sql():
    from citeweave.plans.q_core import CITATION_CLASS_VIEWS
    from citeweave.plans.sqlparts import network_views

    n_shared = len(clean_codes_views()) + 1
    extra = (network_views() + clean_codes_views() + [modal_view()] + CITATION_CLASS_VIEWS + KNN_VIEWS[n_shared:]
             + scores_sql("knn", ["trial", "is_all_journals", "k"], "s")
             + [("ccl", """SELECT CAST(is_all_journals AS INTEGER) AS is_all_journals, true_pacs_1 AS true_label,
                                  class_pacs_1 AS pred_label FROM cc""")]
             + scores_sql("ccl", ["is_all_journals"], "c"))
    body = """
        SELECT *, CAST(row_number() OVER (ORDER BY f1_score DESC, embedding, is_all_journals, k, average) AS INTEGER) AS place FROM (
        SELECT 'given' AS embedding, is_all_journals, k, average, round(avg(precision), 6) AS precision,
               round(avg(recall), 6) AS recall, round(avg(f1_score), 6) AS f1_score, round(stddev_samp(f1_score), 6) AS f1_std
        FROM s_scores GROUP BY is_all_journals, k, average
        UNION ALL
        SELECT 'citation', is_all_journals, 0, average, round(precision, 6), round(recall, 6), round(f1_score, 6), NULL
        FROM c_scores)"""
    return with_views(body, "papers", "raw_citations", "dirty_codes_wide", "vectors", "abstracts", extra=extra)


@register("score_summary", "E2 A3 A4 W6 D14 D19 E1", _score_summary_sql())
def q_score_summary(spark, d):
    from citeweave.plans.q_core import q_citation_classes

    s = evaluate.classification_scores(knn_predictions(spark, d), ["trial", "is_all_journals", "k"])
    knn = s.groupBy("is_all_journals", "k", "average").agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
        F.stddev_samp("f1_score").alias("f1_std")).withColumn("embedding", F.lit("given"))
    cc = q_citation_classes(spark, d).select(F.col("is_all_journals").cast("int").alias("is_all_journals"),
                                             F.col("true_pacs_1").alias("true_label"), F.col("class_pacs_1").alias("pred_label"))
    cit = evaluate.classification_scores(cc, ["is_all_journals"]).select(
        "is_all_journals", F.lit(0).alias("k"), "average", "precision", "recall", "f1_score",
        F.lit(None).cast("double").alias("f1_std"), F.lit("citation").alias("embedding"))
    # a few rows each, stored, so that the shuffles of the one are gone before the other begins
    out = materialize(knn, "given-scores").unionByName(materialize(cit, "citation-scores"))
    # a total order (W6) that SQL can check: the place of each row, best F1 first; one row per setting
    place = F.row_number().over(Window.orderBy(F.desc(R6(F.col("f1_score"))), "embedding", "is_all_journals", "k", "average"))
    return out.select("embedding", "is_all_journals", "k", "average", *[R6(F.col(c)).alias(c) for c in
                                                                       ["precision", "recall", "f1_score", "f1_std"]], place.alias("place")).orderBy("place")


@register("knn_quality", "V12 E1", with_views(
    "SELECT k, average, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM q_scores",
    "raw_vectors", extra=[
        ("nv", f"SELECT id, label, {NORM} AS vec FROM raw_vectors"),
        ("qn", f"""SELECT q.id AS qid, q.label AS true_label, t.label AS nlabel,
                          row_number() OVER (PARTITION BY q.id ORDER BY {dist_sql('q.vec', 't.vec')}, t.id) AS rank
                   FROM nv q JOIN nv t ON q.id <> t.id"""),
        ("qv", f"""SELECT qid, true_label, k, nlabel, count(*) AS n FROM qn JOIN {values_sql(QUALITY_KS, 'k')} ON qn.rank <= k.k
                   GROUP BY ALL"""),
        ("qk", """SELECT qid, true_label, nlabel AS pred_label, k FROM (
                    SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY n DESC, nlabel ASC) AS rn FROM qv) WHERE rn = 1"""),
    ] + scores_sql("qk", ["k"], "q")))
def q_knn_quality(spark, d):
    v = materialize(V.normalize_rows(fx.raw_vectors(spark, d)), "normalised")  # the search and the votes read it many times
    nb = V.knn_search(v, v, max(QUALITY_KS), qid="id", tid="id", exclude_self=True)
    votes = V.knn_vote(nb, v.select(F.col("id").alias("nid"), "label"), QUALITY_KS)
    p = votes.join(v.select(F.col("id").alias("qid"), F.col("label").alias("true_label")), "qid")
    s = evaluate.classification_scores(p.withColumnRenamed("pred", "pred_label"), ["k"])
    return _round_scores(s, ["k"])


# ------------------------------------------------------------------ pairs and distances
PAIR_VIEWS = clean_codes_views() + VEC_VIEWS + [
    ("pmeta", f"""SELECT doi FROM papers WHERE date <= TIMESTAMP '{fx.MAX_YEAR}-12-31 00:00:00' AND journal IN ({FOCUS})"""),
    ("prow", """SELECT DISTINCT p.doi, p.pacs_code_1, p.pacs_code_2 FROM pacs p
                WHERE p.doi IN (SELECT doi FROM pmeta) AND p.doi IN (SELECT doi FROM vecs)"""),
    ("pix", "SELECT *, row_number() OVER (ORDER BY doi, pacs_code_1, pacs_code_2) - 1 AS ix FROM prow"),
    ("draws", f"""SELECT draw, {hash_sql('11', '1', 'draw')} % n AS ix_x, {hash_sql('11', '2', 'draw')} % n AS ix_y FROM (
                    SELECT unnest(range(3 * n)) AS draw, n FROM (SELECT count(*) AS n FROM prow))"""),
    ("rawpairs", """SELECT DISTINCT x.doi AS doi_x, x.pacs_code_1 AS c1x, x.pacs_code_2 AS c2x, y.doi AS doi_y,
                           y.pacs_code_1 AS c1y, y.pacs_code_2 AS c2y
                    FROM draws d JOIN pix x ON d.ix_x = x.ix JOIN pix y ON d.ix_y = y.ix WHERE x.doi <> y.doi"""),
    ("pairs", """SELECT doi_x, doi_y, CASE pr WHEN 2 THEN 'same_2' WHEN 1 THEN 'same_1' ELSE 'diff' END AS relation,
                        c1x AS pacs_code_1_x, c2x AS pacs_code_2_x, c1y AS pacs_code_1_y, c2y AS pacs_code_2_y FROM (
                   SELECT *, row_number() OVER (PARTITION BY doi_x, doi_y ORDER BY pr DESC, c1x DESC, c2x DESC, c1y DESC, c2y DESC) AS rn
                   FROM (SELECT *, CASE WHEN c2x = c2y THEN 2 WHEN c1x = c1y THEN 1 ELSE 0 END AS pr FROM rawpairs))
                 WHERE rn = 1"""),
    ("pv", """SELECT p.*, CAST(string_split(doi_x, '.')[-1] AS BIGINT) AS id_x, CAST(string_split(doi_y, '.')[-1] AS BIGINT) AS id_y
              FROM pairs p WHERE doi_x IN (SELECT doi FROM vecs) AND doi_y IN (SELECT doi FROM vecs)"""),
    ("strata", """SELECT 'same_2' AS stratum, * FROM pv WHERE pacs_code_2_x = pacs_code_2_y
                  UNION ALL SELECT 'same_1', * FROM pv WHERE pacs_code_1_x = pacs_code_1_y
                  UNION ALL SELECT 'diff', * FROM pv WHERE pacs_code_1_x <> pacs_code_1_y
                  UNION ALL SELECT 'rand', * FROM pv"""),
    ("bal", f"""SELECT stratum, doi_x, doi_y FROM (
                  SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {hash_sql('5', 'id_x', 'id_y')}, id_x, id_y) - 1 AS rk
                  FROM strata) WHERE rk < (SELECT count(*) FROM strata WHERE stratum = 'same_2')"""),
    ("pdist", f"""SELECT b.stratum, b.doi_x, b.doi_y, round(1 - {cos_sql('x.vec', 'y.vec')}, 9) AS dist
                  FROM bal b JOIN vecs x ON b.doi_x = x.doi JOIN vecs y ON b.doi_y = y.doi"""),
]
PAIR_NAMES = ("papers", "vectors", "dirty_codes_wide")


def paper_pairs(spark, d):
    meta = clean.papers_until_year(fx.papers(spark, d), fx.MAX_YEAR).where(F.col("journal").isin(fx.FOCUS_JOURNALS))
    vecs = fx.vectors(spark, d).select("doi")
    rows = (vector_pacs(spark, d).select("doi", "pacs_code_1", "pacs_code_2").distinct()
            .join(meta.select("doi"), "doi", "left_semi").join(vecs, "doi", "left_semi"))
    draws = sample_with_replacement_pairs(rows, ["doi", "pacs_code_1", "pacs_code_2"], 3, seed=11)
    raw = draws.where(F.col("x_doi") != F.col("y_doi")).select(
        F.col("x_doi").alias("doi_x"), F.col("x_pacs_code_1").alias("c1x"), F.col("x_pacs_code_2").alias("c2x"),
        F.col("y_doi").alias("doi_y"), F.col("y_pacs_code_1").alias("c1y"), F.col("y_pacs_code_2").alias("c2y")).distinct()
    pr = F.when(F.col("c2x") == F.col("c2y"), 2).when(F.col("c1x") == F.col("c1y"), 1).otherwise(0)
    best = raw.withColumn("pr", pr).groupBy("doi_x", "doi_y").agg(F.max(F.struct("pr", "c1x", "c2x", "c1y", "c2y")).alias("b"))
    rel = F.when(F.col("b.pr") == 2, "same_2").when(F.col("b.pr") == 1, "same_1").otherwise("diff")
    return best.select("doi_x", "doi_y", rel.alias("relation"), F.col("b.c1x").alias("pacs_code_1_x"),
                       F.col("b.c2x").alias("pacs_code_2_x"), F.col("b.c1y").alias("pacs_code_1_y"),
                       F.col("b.c2y").alias("pacs_code_2_y"))


def balanced(spark, d):
    vecs = fx.vectors(spark, d).select("doi")
    pv = (paper_pairs(spark, d).join(vecs.withColumnRenamed("doi", "doi_x"), "doi_x", "left_semi")
          .join(vecs.withColumnRenamed("doi", "doi_y"), "doi_y", "left_semi")
          .withColumn("id_x", doi_id("doi_x")).withColumn("id_y", doi_id("doi_y")))
    pv = materialize(pv, "pairs")  # counted and ranked
    st = F.explode(F.array(
        F.when(F.col("pacs_code_2_x") == F.col("pacs_code_2_y"), F.lit("same_2")),
        F.when(F.col("pacs_code_1_x") == F.col("pacs_code_1_y"), F.lit("same_1")),
        F.when(F.col("pacs_code_1_x") != F.col("pacs_code_1_y"), F.lit("diff")),
        F.lit("rand")))
    strata = pv.withColumn("stratum", st).where(F.col("stratum").isNotNull())
    n2 = strata.where(F.col("stratum") == "same_2").count()  # scalar
    ranked = with_hash_rank(strata, ["id_x", "id_y"], seed=5, group="stratum")
    return ranked.where(F.col("_rank") < n2).select("stratum", "doi_x", "doi_y")


def pair_distances(spark, d):
    b = balanced(spark, d)
    r = V.pair_cosine(b, fx.vectors(spark, d), "doi_x", "doi_y")
    return materialize(r.select("stratum", "doi_x", "doi_y", F.round("cos_dist", 9).alias("dist")), "pair-distances")


@register("paper_pairs", "M2 J13 P21 P27 W4 W5 J6", with_views("SELECT * FROM pairs", *PAIR_NAMES, extra=PAIR_VIEWS))
def q_paper_pairs(spark, d):
    return paper_pairs(spark, d)


@register("pairs_with_vectors", "J5", with_views("SELECT doi_x, doi_y, relation FROM pv", *PAIR_NAMES, extra=PAIR_VIEWS))
def q_pairs_with_vectors(spark, d):
    vecs = fx.vectors(spark, d).select("doi")
    return (paper_pairs(spark, d).join(vecs.withColumnRenamed("doi", "doi_x"), "doi_x", "left_semi")
            .join(vecs.withColumnRenamed("doi", "doi_y"), "doi_y", "left_semi").select("doi_x", "doi_y", "relation"))


@register("balanced_strata", "M5", with_views("SELECT * FROM bal", *PAIR_NAMES, extra=PAIR_VIEWS))
def q_balanced_strata(spark, d):
    return balanced(spark, d)


@register("pair_distance_by_relation", "V16 V9 J9", with_views(
    "SELECT stratum, CAST(count(*) AS BIGINT) AS n, round(avg(dist), 6) AS mean_dist FROM pdist GROUP BY stratum",
    *PAIR_NAMES, extra=PAIR_VIEWS))
def q_pair_distance_by_relation(spark, d):
    p = pair_distances(spark, d)
    return p.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), R6(F.avg("dist")).alias("mean_dist"))


@register("normality", "E8", with_views(
    """SELECT stratum, CAST(n AS BIGINT) AS n, round(g1, 6) AS skew, round(g2, 6) AS kurt FROM (
         SELECT stratum, count(*) AS n, avg(pow(dist - m, 3)) / pow(var_pop(dist), 1.5) AS g1, kurtosis_pop(dist) AS g2
         FROM (SELECT *, avg(dist) OVER (PARTITION BY stratum) AS m FROM pdist) GROUP BY stratum)""",
    *PAIR_NAMES, extra=PAIR_VIEWS))
def q_normality(spark, d):
    t = stats.normaltest(pair_distances(spark, d), "stratum", "dist")
    return t.select("stratum", "n", R6(F.col("skew")).alias("skew"), R6(F.col("kurt")).alias("kurt"))


_K2_SQL = """
    SELECT stratum, CAST(n AS BIGINT) AS n, round(g1, 6) AS skew, round(g2, 6) AS kurt, round(z1, 6) AS z_skew, round(z2, 6) AS z_kurt,
           round(z1 * z1 + z2 * z2, 6) AS k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p
    FROM (SELECT *, delta * ln(yy + sqrt(yy * yy + 1)) AS z1,
                 (1 - 2 / (9.0 * a) - sign(den) * pow((1 - 2.0 / a) / abs(den), 1 / 3.0)) / sqrt(2 / (9.0 * a)) AS z2
          FROM (SELECT *, y / sqrt(2.0 / (w2 - 1)) AS yy, 1 / sqrt(0.5 * ln(w2)) AS delta, 1 + x * sqrt(2 / (a - 4.0)) AS den
                FROM (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6.0 + 8.0 / sb * (2.0 / sb + sqrt(1 + 4.0 / (sb * sb))) AS a
                      FROM (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) AS y,
                                   3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
                                   (g2 + 3 - 3.0 * (n - 1) / (n + 1)) / sqrt(24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
                                   6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb
                            FROM (SELECT stratum, CAST(count(*) AS DOUBLE) AS n, avg(pow(dist - m, 3)) / pow(var_pop(dist), 1.5) AS g1, kurtosis_pop(dist) AS g2
                                  FROM (SELECT *, avg(dist) OVER (PARTITION BY stratum) AS m FROM pdist) GROUP BY stratum)))))"""


@register("normality_test", "E8", with_views(_K2_SQL, *PAIR_NAMES, extra=PAIR_VIEWS))
def q_normality_test(spark, d):
    """Full K^2 statistic and p-value (closed form in Spark expressions)."""
    t = stats.normaltest(pair_distances(spark, d), "stratum", "dist")
    return t.select("stratum", "n", *[R6(F.col(c)).alias(c) for c in ["skew", "kurt", "z_skew", "z_kurt", "k2", "p"]])


@register("ttest", "E9 D15", with_views(
    f"""SELECT stratum, n, mean, sd, mu, round(t, 6) AS t_stat, round(p, 6) AS p_less, round(2 * least(p, 1 - p), 6) AS p_two_sided
       FROM (SELECT *, {t_cdf_sql('t', '(n - 1)')} AS p FROM (
         SELECT s.stratum, CAST(s.n AS BIGINT) AS n, round(s.m, 6) AS mean, round(s.sd, 6) AS sd, round(dm.mu, 6) AS mu,
                (s.m - dm.mu) / (s.sd / sqrt(s.n)) AS t
         FROM (SELECT stratum, count(*) AS n, avg(dist) AS m, stddev_samp(dist) AS sd FROM pdist GROUP BY stratum) s
         CROSS JOIN (SELECT avg(dist) AS mu FROM pdist WHERE stratum = 'diff') dm WHERE s.stratum <> 'diff'))""",
    *PAIR_NAMES, extra=PAIR_VIEWS))
def q_ttest(spark, d):
    p = materialize(pair_distances(spark, d), "distances")
    mu = p.where(F.col("stratum") == "diff").agg(F.avg("dist").alias("mu")).first()["mu"]  # a scalar
    t = stats.ttest_1samp(p.where(F.col("stratum") != "diff"), "stratum", "dist", mu)
    return t.select("stratum", F.col("n").cast("bigint"), R6(F.col("mean")).alias("mean"), R6(F.col("sd")).alias("sd"),
                    R6(F.lit(mu)).alias("mu"), R6(F.col("T")).alias("t_stat"), R6(F.col("p_less")).alias("p_less"),
                    R6(F.col("p_two_sided")).alias("p_two_sided"))


@register("mean_ci", "E10 D16", with_views(
    f"""SELECT stratum, CAST(n AS BIGINT) AS n, round(m, 6) AS mean, round(sd, 6) AS sd, round(m - {t_quantile_sql('(n - 1)')} * sd / sqrt(n), 5) AS lo,
              round(m + {t_quantile_sql('(n - 1)')} * sd / sqrt(n), 5) AS hi
       FROM (SELECT stratum, count(*) AS n, avg(dist) AS m, stddev_samp(dist) AS sd FROM pdist GROUP BY stratum)""", *PAIR_NAMES, extra=PAIR_VIEWS))
def q_mean_ci(spark, d):
    m = stats.mean_ci(pair_distances(spark, d), "stratum", "dist")
    return m.select("stratum", F.col("n").cast("bigint"), R6(F.col("mean")).alias("mean"), R6(F.col("sd")).alias("sd"),
                    F.round("lo", 5).alias("lo"), F.round("hi", 5).alias("hi"))


@register("kl_js_matrix", "E11 E12 E13", with_views(
    """SELECT a.stratum AS a, b.stratum AS b, round(sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / b.p) ELSE 0 END), 6) AS kl,
              round(sqrt(greatest(0.0, (sum(CASE WHEN a.p > 0 THEN a.p * ln(a.p / ((a.p + b.p) / 2)) ELSE 0 END)
                                        + sum(CASE WHEN b.p > 0 THEN b.p * ln(b.p / ((a.p + b.p) / 2)) ELSE 0 END)) / 2)), 6) AS js
       FROM pos a JOIN pos b ON a.pos = b.pos AND a.stratum <> b.stratum GROUP BY a.stratum, b.stratum""",
    *PAIR_NAMES, extra=PAIR_VIEWS + [
        ("pos", """SELECT stratum, row_number() OVER (PARTITION BY stratum ORDER BY dist) - 1 AS pos,
                          dist / sum(dist) OVER (PARTITION BY stratum) AS p FROM pdist""")]))
def q_kl_js_matrix(spark, d):
    r = stats.positional_divergence(pair_distances(spark, d), "stratum", "dist")
    return r.select("a", "b", R6(F.col("kl")).alias("kl"), R6(F.col("js")).alias("js"))


@register("kde_density", "A18", with_views(
    """SELECT p.stratum, round(g.i * 0.01, 2) AS x,
              round(sum(exp(-pow(g.i * 0.01 - p.dist, 2) / (2 * m.h * m.h))) / (m.n * m.h * sqrt(2 * pi())), 6) AS density
       FROM pdist p JOIN (SELECT stratum, count(*) AS n, pow(count(*), -0.2) * stddev_samp(dist) AS h FROM pdist GROUP BY stratum) m
         ON p.stratum = m.stratum CROSS JOIN (SELECT unnest(range(200)) AS i) g
       GROUP BY p.stratum, g.i, m.n, m.h""", *PAIR_NAMES, extra=PAIR_VIEWS))
def q_kde_density(spark, d):
    k = stats.kde_grid(pair_distances(spark, d), "stratum", "dist")
    return k.select("stratum", F.round("x", 2).alias("x"), R6(F.col("density")).alias("density"))


# ------------------------------------------------------------------ rank tests on ROG
@register("kruskal", "E6 W12", with_views(
    f"""SELECT round(h, 6) AS h, n, df, round({chi2_sf3_sql('h')}, 6) AS p FROM (
         SELECT (12.0 / (N * (N + 1)) * sr - 3 * (N + 1)) / (1 - tt / (pow(N, 3) - N)) AS h, CAST(N AS BIGINT) AS n,
                CAST(g - 1 AS BIGINT) AS df FROM (
           SELECT (SELECT count(*) FROM rk) AS N, (SELECT count(DISTINCT level) FROM rk) AS g,
                  (SELECT sum(R * R / n) FROM (SELECT level, sum(rank) AS R, count(*) AS n FROM rk GROUP BY level)) AS sr,
                  (SELECT sum(pow(c, 3) - c) FROM (SELECT v, count(*) AS c FROM rk GROUP BY v)) AS tt))""",
    "vectors", "dirty_codes_wide", extra=ROG_VIEWS + [
        ("rv", "SELECT level, round(rog, 9) AS v FROM rogt"),
        ("rk", """SELECT level, v, (rank() OVER (ORDER BY v)) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rank FROM rv""")]))
def q_kruskal(spark, d):
    return stats.kruskal(rog_values(spark, d), "level", "v").select(R6(F.col("h")).alias("h"), "n", F.col("df").cast("bigint"), R6(F.col("p")).alias("p"))


# each level is compared with the median of the one above it
LEVEL_ABOVE = {"2": "1", "3": "2", "5": "3"}


@register("wilcoxon", "E7 W12 A5", with_views(
    f"""SELECT level, n, n_used, t_stat, round(z, 6) AS z, round({norm_cdf_sql('z')}, 6) AS p, median_cur, median_prev FROM (
         SELECT level, CAST(max(n_all) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS n_used, round(sum(CASE WHEN d > 0 THEN rank ELSE 0 END), 6) AS t_stat,
                (sum(CASE WHEN d > 0 THEN rank ELSE 0 END) - count(*) * (count(*) + 1) / 4.0)
                  / sqrt((count(*) * (count(*) + 1) * (2 * count(*) + 1) - 0.5 * sum(pow(c, 2) - 1)) / 24.0) AS z,
                round(max(med_cur), 6) AS median_cur, round(max(mu), 6) AS median_prev
         FROM (SELECT w.*, count(*) OVER (PARTITION BY level, abs(d)) AS c,
                      (rank() OVER (PARTITION BY level ORDER BY abs(d))) + (count(*) OVER (PARTITION BY level, abs(d)) - 1) / 2.0 AS rank
               FROM (SELECT c.level, c.v - p.mu AS d, p.mu, c.med_cur, c.n_all FROM
                      (SELECT level, v, median(v) OVER (PARTITION BY level) AS med_cur, count(*) OVER (PARTITION BY level) AS n_all FROM rv) c
                      JOIN (SELECT CASE level WHEN '1' THEN '2' WHEN '2' THEN '3' WHEN '3' THEN '5' END AS level, median(v) AS mu
                            FROM rv GROUP BY level) p ON c.level = p.level) w WHERE d <> 0)
         GROUP BY level)""",
    "vectors", "dirty_codes_wide", extra=ROG_VIEWS + [("rv", "SELECT level, round(rog, 9) AS v FROM rogt")]))
def q_wilcoxon(spark, d):
    r = rog_values(spark, d)
    meds = materialize(stats.exact_quantiles(r, "level", "v", [0.5]).select("level", F.col("q_0").alias("median")), "medians")
    above = F.create_map(*[F.lit(x) for pair in LEVEL_ABOVE.items() for x in pair])
    prev = meds.select(F.col("level").alias("_above"), F.col("median").alias("median_prev"))
    pairs = meds.withColumn("_above", above[F.col("level")]).join(prev, "_above").select("level", F.col("median").alias("median_cur"), "median_prev")
    t = stats.wilcoxon_less(r.join(F.broadcast(pairs), "level"), "level", "v", "median_prev")  # one row per level
    return t.join(F.broadcast(pairs), "level").select(
        "level", "n", "n_used", R6(F.col("T")).alias("t_stat"), R6(F.col("z")).alias("z"), R6(F.col("p")).alias("p"),
        R6(F.col("median_cur")).alias("median_cur"), R6(F.col("median_prev")).alias("median_prev"))
