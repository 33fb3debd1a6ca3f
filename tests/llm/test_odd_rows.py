"""Every operator on odd rows, on an empty table, with null languages and with clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontamination, language_id, line_dedup, near_duplicates, pii, quality_divergence, sentencepiece_codec, substring_dedup, toxicity, warc


def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, 1, 0), (2, 1, 1), (None, 0, 1), (4, 0, None)], "doc_id bigint, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, None), (2, "short"), (3, "word0 item0 word1 item1 word2 item2 word3 item3 word4 item4"), (3, "word0 item0 word1 item1 word2 item2 word3 item3 word4 item4")], "item_id bigint, text string")


RUNS = {
    "language": lambda s, d: language_id.identify_held_out(d),
    "substrings": lambda s, d: substring_dedup.digest(d),
    "quality": lambda s, d: quality_divergence.assess(d),
    "sentencepiece": lambda s, d: sentencepiece_codec.digest_documents(d),
    "pii": lambda s, d: pii.digest(d),
    "toxicity": lambda s, d: toxicity.detect(d, labels(s)),
    "near": lambda s, d: near_duplicates.digest(d),
    "lines": lambda s, d: line_dedup.digest(d),
}


@pytest.mark.parametrize("name", sorted(RUNS))
def test_a_row_for_each_row(spark, make_docs, odd_rows, name):
    got = RUNS[name](spark, make_docs(odd_rows)).collect()
    ids = lambda xs: sorted(xs, key=lambda x: (x is None, x))
    assert ids(r.doc_id for r in got) == ids(r[0] for r in odd_rows)


@pytest.mark.parametrize("name", sorted(RUNS))
def test_empty_table(spark, make_docs, name):
    assert RUNS[name](spark, make_docs([])).count() == 0


def test_null_languages(spark, make_docs, odd_rows):
    d = make_docs(odd_rows).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.identify_held_out(d).collect()} == {"und"}
    assert quality_divergence.assess(d).count() == len(odd_rows)


def test_decontamination_of_odd_rows(spark, make_docs, odd_rows):
    got = decontamination.find(make_docs(odd_rows), benchmark(spark)).collect()
    assert [(r.doc_id, r.item_id, r.edits) for r in got] == [(6, 3, 0)]
    left = decontamination.clean(make_docs(odd_rows), benchmark(spark))
    assert left.count() == len(odd_rows) - 1 and left.columns == make_docs([]).columns
    assert decontamination.find(make_docs([]), benchmark(spark)).count() == 0
    assert decontamination.find(make_docs(odd_rows), benchmark(spark).limit(0)).count() == 0


def test_warc_of_odd_rows(spark):
    rows = [(1, "http://x", None), (2, None, ""), (None, "u", "x" * 200), (3, "u", "x" * 200), (3, "u", "x" * 200), (4, "a b\r\nc", "é" * 60)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (None, 200, "revisit", 3), (3, 200, "response", None), (3, 200, "revisit", 3), (4, 120, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_extra_columns(spark, make_docs, odd_rows, tmp_path):
    import corpus_pipeline

    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    benchmark(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make_docs(odd_rows).withColumns({n: F.lit(7) for n in ("n_lines", "n_removed", "n_removed_")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == before.columns, name
        assert docs.where("score <> 7 or n_removed <> 7 or k1 <> 7 or k2 <> 7 or _k1 <> 7").count() == 0
    # the long text holds a benchmark item, one of the twin rows goes; all else stays
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(key((r.doc_id, r.text)) for r in docs.collect()) == sorted({key(r) for r in odd_rows if r[0] != 6})
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(odd_rows) - 2
    empty = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0
