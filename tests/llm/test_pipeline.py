import corpus_pipeline
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_their_contracts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.toArrow())
    assert kept.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    assert packed.filter(F.octet_length("input_ids") != 4096).count() == 0


def test_near_duplicates_keep_one(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(5, body, "en", "s", 1), (3, body + " more", "en", "s", 1), (9, "other words stand here alone", "en", "s", 1), (9, "other words stand here alone", "en", "s", 1), (4, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, d, SF).collect()) == [3, 4, 9]


def test_near_duplicates_go_by_row_not_by_id(spark):
    body, other, third = (" ".join(f"{x}{i}" for i in range(60)) for x in "wuv")
    rows = [(3, body), (5, body + " more"), (None, body), (None, body + " again"), (9, body), (9, "a text of its own"), (7, "one clean text"), (7, "another clean text"), (None, other), (None, other), (None, other + " x"), (None, third), (None, None), (None, None), (8, "twice the same row"), (8, "twice the same row")]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (d, d.filter("doc_id IS NULL OR doc_id NOT IN (7, 8)")):
        got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, some, SF).collect()), key=repr)
        of_other = [t for i, t in got if i is None and t and t.startswith(other)]
        assert len(of_other) == 1
        want = [(3, body), (9, "a text of its own"), (None, of_other[0]), (None, third), (None, None), (None, None)]
        if some is d:
            want += [(7, "one clean text"), (7, "another clean text"), (8, "twice the same row")]
        assert got == sorted(want, key=repr)


def test_documents_of_several_languages_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    most = {}
    for r in docs.filter("text IS NOT NULL AND lang IS NOT NULL").orderBy("doc_id").collect():
        if len(r["text"].split()) >= 30:
            most.setdefault(r["lang"], []).append(" ".join(r["text"].split()[:30]))
    assert len(most) >= 3
    rows = [(10**9 + i, " ".join(parts[:3]), None, "s", 1) for i, parts in enumerate(zip(*most.values())) if i < 6]
    more = spark.createDataFrame(rows + [(10**9 + 100, None, None, "s", 0), (10**9 + 101, "123 456", None, "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.language_id(spark, docs.select(*more.columns).unionByName(more), SF)
    assert {r["doc_id"] for r in kept.filter("doc_id >= 1000000000").select("doc_id").collect()} == {r[0] for r in rows}


def test_stages_take_odd_rows_and_none(spark):
    odd = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, " \n", None, None, 2), (None, "one short text", "en", None, 14), (3, "x" * 70_000, "en", "s", 70_000), (3, "another text of the same id", "en", "s", 27)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            docs = spark.createDataFrame(out.toArrow())
            assert rows or docs.count() == 0, name
