"""Relational core: cleaning, networks, codes, votes (survey §2.1-2.6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeweave.functions.columns import doi_journal
from citeweave.operators import clean, relate
from citeweave.plans.fixture_sql import with_views
from citeweave.plans.registry import register
from citeweave.plans.sqlparts import FOCUS, clean_codes_views, journal, lst, modal_view, network_views
from citeweave.sources import fixtures as fx


def network(spark, d, journal_set=None):
    return clean.citation_network(fx.raw_citations(spark, d), fx.papers(spark, d), journal_set=journal_set,
                                  max_year=fx.MAX_YEAR, remove_types=fx.REMOVED_TYPES)


def pacs(spark, d):
    return clean.pacs_table(fx.dirty_codes_wide(spark, d))


def vector_pacs(spark, d):
    """The rows of ``pacs`` that belong to papers with a vector."""
    return clean.pacs_table(fx.dirty_codes_wide(spark, d, fx.vector_ids(spark, d)))


def _day(c):
    return F.date_format(c, "yyyy-MM-dd")


# ---------------------------------------------------------------- citation_classes
CITATION_CLASS_VIEWS = [
        ("edges", """
            SELECT n.citing_doi, n.cited_doi, n.citing_journal, n.cited_journal,
                   a.pacs_code_1 AS citing_pacs_1, b.pacs_code_1 AS cited_pacs_1
            FROM net n LEFT JOIN modal a ON n.citing_doi = a.doi LEFT JOIN modal b ON n.cited_doi = b.doi"""),
        ("tagged", f"""
            SELECT '1' AS is_all_journals, * FROM edges
            UNION ALL
            SELECT '0' AS is_all_journals, * FROM edges WHERE citing_journal IN ({FOCUS}) AND cited_journal IN ({FOCUS})"""),
        ("jc", """
            SELECT is_all_journals, citing_doi, citing_journal, cited_journal AS class_journal FROM (
              SELECT is_all_journals, citing_doi, citing_journal, cited_journal,
                     row_number() OVER (PARTITION BY is_all_journals, citing_doi, citing_journal
                                        ORDER BY count(cited_doi) DESC, cited_journal DESC) AS rn
              FROM tagged GROUP BY is_all_journals, citing_doi, citing_journal, cited_journal)
            WHERE rn = 1"""),
        ("pc", """
            SELECT is_all_journals, citing_doi, citing_pacs_1, cited_pacs_1 AS class_pacs_1 FROM (
              SELECT is_all_journals, citing_doi, citing_pacs_1, cited_pacs_1,
                     row_number() OVER (PARTITION BY is_all_journals, citing_doi
                                        ORDER BY count(cited_doi) DESC, cited_pacs_1 DESC) AS rn
              FROM tagged WHERE citing_pacs_1 IS NOT NULL AND cited_pacs_1 IS NOT NULL
              GROUP BY is_all_journals, citing_doi, citing_pacs_1, cited_pacs_1)
            WHERE rn = 1"""),
        ("cc", """
            SELECT j.is_all_journals, j.citing_doi AS doi, j.citing_journal AS true_journal, j.class_journal,
                   p.citing_pacs_1 AS true_pacs_1, p.class_pacs_1
            FROM jc j LEFT JOIN pc p ON j.is_all_journals = p.is_all_journals AND j.citing_doi = p.citing_doi"""),
]

_SQL_CITATION_CLASSES = with_views("SELECT * FROM cc", "papers", "raw_citations", "dirty_codes_wide",
                                   extra=network_views() + clean_codes_views() + [modal_view()] + CITATION_CLASS_VIEWS)


@register("citation_classes", "G19 J3 A1 W1 W2 U2 P3 P4 P6 J1", _SQL_CITATION_CLASSES)
def q_citation_classes(spark, d):
    modal = relate.modal_code(pacs(spark, d))
    return relate.citation_classes(network(spark, d), modal, fx.FOCUS_JOURNALS)


# ---------------------------------------------------------------- citation_network
@register("citation_network", "P1 P3 P4 P6 J1 S4 P7", with_views(
    """SELECT citing_doi, cited_doi, citing_journal, cited_journal, strftime(citing_date, '%Y-%m-%d') AS citing_day,
              citing_year, strftime(cited_date, '%Y-%m-%d') AS cited_day, cited_year FROM net""",
    "papers", "raw_citations", extra=network_views()))
def q_citation_network(spark, d):
    n = network(spark, d)
    return n.select("citing_doi", "cited_doi", "citing_journal", "cited_journal", _day("citing_date").alias("citing_day"),
                    "citing_year", _day("cited_date").alias("cited_day"), "cited_year")


@register("edges_focus", "P4 J1", with_views(
    "SELECT citing_doi, cited_doi, citing_journal, cited_journal, citing_year, cited_year FROM net",
    "papers", "raw_citations", extra=network_views(journal_set=fx.FOCUS_JOURNALS)))
def q_edges_focus(spark, d):
    return network(spark, d, fx.FOCUS_JOURNALS).select(
        "citing_doi", "cited_doi", "citing_journal", "cited_journal", "citing_year", "cited_year")


# ---------------------------------------------------------------- codes
@register("code_clean", "P11 P12 P13 P14 P15 P16 P17", with_views(
    "SELECT doi, pacs_code FROM pacs", "dirty_codes_wide", extra=clean_codes_views()))
def q_code_clean(spark, d):
    return clean.clean_codes(fx.dirty_codes_wide(spark, d))


@register("code_levels", "P18 A11", with_views(
    """SELECT pacs_code_1, CAST(count(*) AS BIGINT) AS n_rows, CAST(count(DISTINCT doi) AS BIGINT) AS n_papers,
              CAST(count(DISTINCT pacs_code_2) AS BIGINT) AS n_level2, CAST(count(DISTINCT pacs_code_3) AS BIGINT) AS n_level3,
              CAST(count(DISTINCT pacs_code_5) AS BIGINT) AS n_level5
       FROM pacs GROUP BY pacs_code_1""",
    "dirty_codes_wide", extra=clean_codes_views()))
def q_code_levels(spark, d):
    p = pacs(spark, d)
    return p.groupBy("pacs_code_1").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("doi").alias("n_papers"),
        F.countDistinct("pacs_code_2").alias("n_level2"), F.countDistinct("pacs_code_3").alias("n_level3"),
        F.countDistinct("pacs_code_5").alias("n_level5"))


@register("modal_code", "W1 A1", with_views(
    "SELECT doi, pacs_code_1 FROM modal", "dirty_codes_wide", extra=clean_codes_views() + [modal_view()]))
def q_modal_code(spark, d):
    return relate.modal_code(pacs(spark, d))


# ---------------------------------------------------------------- papers and dates
@register("doi_journal", "P1 P2 A1", with_views(
    f"""SELECT {journal('doi')} AS journal_token, CAST(count(*) AS BIGINT) AS n_papers
        FROM papers GROUP BY 1""", "papers"))
def q_doi_journal(spark, d):
    return fx.papers(spark, d).groupBy(doi_journal("doi").alias("journal_token")).agg(F.count(F.lit(1)).alias("n_papers"))


@register("paper_dates", "S4 P7 P20", with_views(
    """SELECT doi, strftime(try_strptime(strftime(date, '%Y-%m-%d'), '%Y-%m-%d'), '%Y-%m-%d') AS day,
              CAST(year(try_strptime(strftime(date, '%Y-%m-%d'), '%Y-%m-%d')) AS BIGINT) AS year
       FROM papers""", "papers"))
def q_paper_dates(spark, d):
    # Dates arrive as text in the reference's metadata; parse leniently (bad text -> null).
    p = fx.papers(spark, d).select("doi", _day("date").alias("date_text"))
    parsed = clean.with_year(p.withColumn("date", F.try_to_timestamp("date_text", F.lit("yyyy-MM-dd"))), "date")
    return parsed.select("doi", _day("date").alias("day"), "year")


@register("papers_until_year", "P5", with_views(
    f"SELECT doi, year FROM papers WHERE date <= TIMESTAMP '{fx.MAX_YEAR}-12-31 00:00:00'", "papers"))
def q_papers_until_year(spark, d):
    return clean.papers_until_year(fx.papers(spark, d), fx.MAX_YEAR).select("doi", "year")


@register("yearly_paper_count", "A19", with_views(
    f"""SELECT year, CAST(count(*) AS BIGINT) AS n_papers FROM papers
        WHERE article_type IS NULL OR article_type NOT IN ({lst(fx.REMOVED_TYPES)}) GROUP BY year""", "papers"))
def q_yearly_paper_count(spark, d):
    p = clean.reviewed_papers(fx.papers(spark, d), fx.REMOVED_TYPES)
    return p.groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"))
