"""DuckDB twins of :mod:`citeweave.sources.fixtures` for the SQL oracle.

``with_views(body, "papers", ...)`` prepends the named views (and the views they
depend on) as CTEs, so each oracle string is self-contained SQL over the
driver's base tables.
"""

from __future__ import annotations

_JOURNAL = "regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')"
_CODE = (
    "lpad(replace(p_brand, 'Brand#', ''), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0')"
    " || substr(p_type, 1, 1) || l_returnflag"
)

VIEWS: dict[str, tuple[list[str], str]] = {
    "papers": ([], f"""
        SELECT o_orderkey AS id,
               '10.1103/' || {_JOURNAL} || '.' || CAST(year(o_orderdate) AS VARCHAR) || '.' || CAST(o_orderkey AS VARCHAR) AS doi,
               o_orderdate AS date, CAST(year(o_orderdate) AS BIGINT) AS year,
               {_JOURNAL} AS journal, o_orderstatus AS article_type
        FROM orders"""),
    "citations": ([], """
        SELECT a.l_orderkey AS citing, b.l_orderkey AS cited
        FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey
        JOIN orders oa ON oa.o_orderkey = a.l_orderkey
        JOIN orders ob ON ob.o_orderkey = b.l_orderkey
        WHERE oa.o_orderdate > ob.o_orderdate"""),
    "raw_citations": (["papers", "citations"], """
        SELECT pc.doi AS citing_doi, pd.doi AS cited_doi
        FROM citations c JOIN papers pc ON c.citing = pc.id JOIN papers pd ON c.cited = pd.id"""),
    "bipartite_edges": ([], """
        SELECT 'c' || CAST(o_custkey AS VARCHAR) AS src, 'p' || CAST(l_partkey AS VARCHAR) AS dst
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""),
    "code_lines": ([], f"""
        SELECT l_orderkey AS id, l_linenumber AS line, {_CODE} AS code
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "codes": (["code_lines"], "SELECT id, code FROM code_lines"),
    "dirty_codes": (["code_lines"], """
        SELECT id, line,
          CASE line % 7
            WHEN 0 THEN substr(code,1,2) || '.' || substr(code,3,2) || '.' || substr(code,5,2)
            WHEN 1 THEN '  ' || code || ' '
            WHEN 2 THEN code || ';' || code
            WHEN 3 THEN substr(code,1,2) || '.' || substr(code,3,2) || '.' || substr(code,5,2)
                     || substr(code,1,2) || '.' || substr(code,3,2) || '.' || substr(code,5,2)
            WHEN 4 THEN 'n' || code
            WHEN 5 THEN '1977PACS:' || code || ' and ' || code
            ELSE 'bad' END AS pacs
        FROM code_lines"""),
    "dirty_codes_wide": (["dirty_codes", "papers"], """
        SELECT p.doi,
               min(CASE WHEN line = 1 THEN pacs END) AS pacs1,
               min(CASE WHEN line = 2 THEN pacs END) AS pacs2,
               min(CASE WHEN line = 3 THEN pacs END) AS pacs3,
               min(CASE WHEN line = 4 THEN pacs END) AS pacs4,
               min(CASE WHEN line = 5 THEN pacs END) AS pacs5
        FROM dirty_codes d JOIN papers p ON d.id = p.id
        GROUP BY p.doi"""),
    "vectors": (["papers"], """
        SELECT p.doi, CAST(e.embedding AS DOUBLE[]) AS vec, e.label
        FROM embeddings e JOIN papers p ON e.vec_id = p.id"""),
    "raw_vectors": ([], "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings"),
    "link_edges": ([], """
        SELECT id AS citing, cited, s FROM (
          SELECT id, s, lag(id, s) OVER (PARTITION BY label, s ORDER BY id) AS cited
          FROM (SELECT vec_id AS id, label, s FROM embeddings CROSS JOIN (VALUES (1),(2),(3)) t(s)))
        WHERE cited IS NOT NULL"""),
    "abstracts": (["papers"], """
        SELECT p.doi, d.text AS abstract FROM documents d JOIN papers p ON d.doc_id = p.id"""),
    "raw_titles": (["papers"], """
        SELECT p.doi, regexp_extract(g.html, '<title>(.*?)</title>', 1) AS title
        FROM pages g JOIN papers p ON g.page_id = p.id"""),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the fixture views ``names`` and any ``extra``
    (name, sql) pairs, which may refer to the fixture views."""
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in _closure(names)]
    parts += [f"{n} AS ({sql}\n)" for n, sql in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
