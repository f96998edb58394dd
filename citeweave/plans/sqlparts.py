"""Reusable DuckDB SQL fragments for the oracle strings (mirrors of operators)."""

from __future__ import annotations

from citeweave.sources.fixtures import FOCUS_JOURNALS, MAX_YEAR, REMOVED_TYPES


def lst(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def journal(doi: str) -> str:
    return f"split_part(substr({doi}, 9), '.', 1)"


def clean_field(f: str) -> str:
    s0 = strip_ws(f)
    s1 = f"(CASE WHEN length({s0}) = 16 THEN substr({s0}, 1, 8) || ',' || substr({s0}, 9, 8) ELSE {s0} END)"
    s2 = strip_ws(f"coalesce({s1}, '')")
    s3 = f"replace(replace(replace(replace({s2}, '1977', ''), ';', ','), ' ', ','), 'and', ',')"
    s4 = f"string_split({s3}, ':')[-1]"
    return f"replace({s4}, '.', '')"


def clean_codes_views(src: str = "dirty_codes_wide") -> list[tuple[str, str]]:
    joined = "concat_ws(',', " + ", ".join(clean_field(f"pacs{i}") for i in range(1, 6)) + ")"
    lst_ = f"string_split(regexp_replace({joined}, '^,+|,+$', '', 'g'), ',')"
    code0 = f"replace({strip_ws('c')}, '.', '')"
    return [
        ("codes_exploded", f"SELECT doi, unnest({lst_}) AS c FROM {src}"),
        ("codes_stage", f"SELECT doi, {code0} AS c0 FROM codes_exploded"),
        ("clean_codes", """
            SELECT doi, CASE WHEN substr(c0, 1, 1) = 'n' THEN substr(c0, 2) ELSE c0 END AS pacs_code
            FROM codes_stage"""),
        ("pacs", """
            SELECT doi, pacs_code, substr(pacs_code, 1, 1) AS pacs_code_1, substr(pacs_code, 1, 2) AS pacs_code_2,
                   substr(pacs_code, 1, 4) AS pacs_code_3, substr(pacs_code, 1, 6) AS pacs_code_5
            FROM clean_codes WHERE length(pacs_code) = 6 AND regexp_matches(pacs_code, '^[0-9]')"""),
    ]


def modal_view(name: str = "modal", src: str = "pacs", code: str = "pacs_code_1") -> tuple[str, str]:
    return (name, f"""
        SELECT doi, {code} FROM (
          SELECT doi, {code}, row_number() OVER (PARTITION BY doi ORDER BY count(*) DESC, {code} DESC) AS rn
          FROM {src} WHERE doi IS NOT NULL AND {code} IS NOT NULL GROUP BY doi, {code})
        WHERE rn = 1""")


def network_views(journal_set=None, max_year: int = MAX_YEAR, remove=REMOVED_TYPES, name: str = "net") -> list[tuple[str, str]]:
    jf = ""
    if journal_set:
        jf = f" AND {journal('e.citing_doi')} IN ({lst(journal_set)}) AND {journal('e.cited_doi')} IN ({lst(journal_set)})"
    return [
        (f"{name}_meta", f"SELECT doi, date, year FROM papers WHERE article_type IS NULL OR article_type NOT IN ({lst(remove)})"),
        (name, f"""
            SELECT e.citing_doi, e.cited_doi, {journal('e.citing_doi')} AS citing_journal, {journal('e.cited_doi')} AS cited_journal,
                   mc.date AS citing_date, mc.year AS citing_year, md.date AS cited_date, md.year AS cited_year
            FROM raw_citations e JOIN {name}_meta mc ON e.citing_doi = mc.doi JOIN {name}_meta md ON e.cited_doi = md.doi
            WHERE mc.year >= md.year AND mc.year <= {max_year}{jf}"""),
    ]


FOCUS = lst(FOCUS_JOURNALS)
