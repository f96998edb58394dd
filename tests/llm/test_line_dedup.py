from collections import Counter

import numpy as np
import pytest

from citeweave.llm import line_dedup, queries

SF = "/root/testdata/sf0.001"


def brute(docs, m):
    """Texts after removal; docs: [(id, text)] with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        full = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for p in range(len(full) - m + 1):
            run = tuple(lines[k] for k in full[p : p + m])
            if run in seen:
                gone.update(full[p : p + m])
            seen.add(run)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_matches_sql_and_brute_force(spark, sf):
    from citeweave.plans.oracle_check import digest, duck

    got = queries.QUERIES["op7_line_dedup"](spark, sf).toPandas()
    assert digest(got) == digest(duck(queries.SQL["op7_line_dedup"], sf))
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs, line_dedup.MIN_RUN)
    assert {r.doc_id: r.chars_left for r in got.itertuples()} == {i: len(t) for i, t in want.items()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_no_later_copy_of_a_line_stays(spark, sf):
    """Also a line that repeats between differing neighbours, which no run of two lines holds."""
    from citeweave.plans.oracle_check import digest, duck

    got = queries.QUERIES["op7_line_dedup_all"](spark, sf).toPandas()
    assert digest(got) == digest(duck(queries.SQL["op7_line_dedup_all"], sf))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = Counter(x for r in line_dedup.line_dedup(docs, min_run=1).collect() for x in r.text.split("\n") if x.strip(" \t\r\x0b\x0c"))
    assert left and max(left.values()) == 1
    before = Counter(x for r in docs.collect() for x in r.text.split("\n") if x.strip(" \t\r\x0b\x0c"))
    assert got.lines_removed.sum() == before.total() - len(before) and set(left) == set(before)


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5, 7])
def test_runs_of_any_length(spark, m):
    rng = np.random.default_rng(m)
    docs = []
    for i in range(60):
        lines = [["", "a", "b", "c", " ", "long line here"][k] for k in rng.integers(0, 6, rng.integers(0, 25))]
        docs.append((i, "\n".join(lines)))
    docs += [(100, "\n".join(["same"] * 30)), (101, docs[5][1]), (102, docs[5][1] + "\nend")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(df, min_run=m).collect()} == brute(docs, m)


def test_no_line_vanishes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, after = ({x for r in d.select("text").collect() for x in r.text.split("\n")} for d in (docs, line_dedup.line_dedup(docs)))
    assert before - after <= {""}


def test_odd_rows(odd_docs, no_docs):
    rows = line_dedup.line_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count() and line_dedup.line_dedup(odd_docs).columns == [*odd_docs.columns, "_gone"]
    texts = Counter((r.doc_id, r.text) for r in rows)
    assert texts[1, None] == 1 and texts[2, ""] == 1 and texts[9, "a b c\na b c\n\nd e f\na b c"] == 1
    assert {r._gone for r in rows} == {0}
    assert line_dedup.line_dedup(no_docs).collect() == []


def test_any_column_names_and_its_own_result(spark):
    names = "doc_id long, text string, _id int, _key int, _k string, _lines array<int>, _split int, lines int, row string, i int"
    docs = spark.createDataFrame([(i, "a b\nc d\n%s" % i, 1, 2, "k", [3], 4, 5, "r", 6) for i in range(3)], names)
    once = line_dedup.line_dedup(docs)
    twice = line_dedup.line_dedup(once)
    assert twice.columns == [*docs.columns, "_gone", "_gone_1"]
    rows = sorted(twice.collect())
    assert [(r.text, r._gone, r._gone_1, r._k, r._lines, r.row) for r in rows] == [
        ("a b\nc d\n0", 0, 0, "k", [3], "r"), ("1", 2, 0, "k", [3], "r"), ("2", 2, 0, "k", [3], "r")]


def test_the_suffix_array_is_sorted_to_the_longest_repeated_run(spark):
    """Maximal runs, longer than any two lines, come from the common prefixes; rounds go beyond ``min_run``."""
    from citeweave.session import Workspace

    lines = [f"l{k}" for k in range(21)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["x"] + lines[3:16] + ["", "y"] + lines[18:20])), (3, "\n".join(lines[:2] + ["z"] * 9))]
    ws = Workspace(spark, "test-lines")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    start = ws.keep(line_dedup.line_sequences(df, "doc_id", "text"), "lines")
    got = sorted((r.id, r.first, r.last) for r in line_dedup.repeated_runs(start, ws, 2).select("id", "first", "last").collect())
    assert [tuple(r) for r in got] == [(2, 1, 13), (2, 15, 16), (3, 0, 1), (3, 3, 10)]
    depths = spark.read.parquet(f"{ws.base}/later8").count(), spark.read.parquet(f"{ws.base}/later4").count()
    assert depths == (6 + 1, 10 + 5)  # nine equal lines repeat themselves
