"""The pipeline's stages against brute force over the same documents."""

import corpus_pipeline
from citeweave.llm import language_id, line_dedup, substring_dedup
from .test_exact_and_simhash import brute_components, brute_print
from .test_line_dedup import brute as brute_lines
from .test_packing import check_places
from .test_substring import brute as brute_paragraphs
from .test_substring import brute_passages

SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, texts(docs)
    pred = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "best_fit_packing":
            rows = out.collect()
            check_places(rows)
            assert {r.doc_id for r in rows} == set(before)
            break
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        after = texts(docs)
        assert docs.count() == len(after)
        if name == "language_id":
            assert after == {i: t for i, t in before.items() if pred[i].lang_pred != "und" and pred[i].score >= language_id.MIN_SCORE}
        elif name == "line_dedup":
            assert after == brute_lines(list(before.items()), line_dedup.MIN_RUN)
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "simhash_dedup":
            group = brute_components(list(before), [brute_print(t) for t in before.values()], 4)
            assert after == {i: t for i, t in before.items() if group[i] == i}
        else:
            found, repeated = brute_paragraphs(before), brute_passages(before)
            for i, t in before.items():
                if not repeated.get(i):  # lines alone go
                    assert after[i] == "\n".join(x for k, x in enumerate(t.split("\n")) if found.get((i, k), ((i, k),))[0] == (i, k))
                else:
                    assert len(after[i].split()) <= len(t.split()) - 0.9 * len(repeated[i])
            assert any(repeated.values()) and not any(brute_passages(after).values())
        before = after


def test_run_equals_its_stages_and_takes_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for name, docs in (("odd", odd_docs), ("none", no_docs)):
        docs.write.parquet(str(tmp_path / name / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        check_places(rows)
        assert bool(rows) == (name == "odd")
    assert substring_dedup.MIN_WORDS > substring_dedup.SHINGLE


def test_registered(spark):
    import __spark_entry__ as entry

    assert entry._training_data()[0]["pipeline"] is corpus_pipeline.run
