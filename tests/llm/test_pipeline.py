"""The pipeline against a plain version of each stage, stage by stage on its own input."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import brute_counts, check_packing, jaccard_classes, removed

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_columns_stay(stages):
    for name, (before, after) in stages.items():
        if name != "packing":
            assert before.dtypes == after.dtypes


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    kept = {r.doc_id for r in after.collect()}
    assert kept < {r.doc_id for r in before.collect()} and len(kept & toxic) <= len(toxic) / 2


def test_base_rules_hold(stages):
    before, after = stages["quality_rules"]
    kept = dict(rows(after))
    for key, text in rows(before):
        n = brute_counts(text)
        if n[0] < 10 or 100 * n[4] > 20 * n[0]:
            assert key not in kept


def test_one_of_each_class_stays(stages):
    before, after = stages["ngram_join"]
    assert [k for k, _ in rows(after)] == sorted({c for _, c, _ in jaccard_classes(rows(before))})


def test_repeats_are_cut(stages):
    before, after = stages["suffix_array_dedup"]
    b = rows(before)
    want = removed([t for _, t in b], 200, lambda x: x)
    for (key, text), (_, _, kept, _), (got_key, got) in zip(b, want, rows(after), strict=True):
        assert key == got_key
        if text.isascii():
            assert got.encode() == kept
        else:  # a character that is cut in two goes as a whole
            assert len(kept) - 8 * 20 <= len(got.encode()) <= len(kept)
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_pieces_cover_the_texts(stages):
    before, after = stages["packing"]
    check_packing([r.asDict() for r in after.withColumn("ids_crc32", F.crc32("ids")).collect()], dict(rows(before)))


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages["packing"][1].count()


EDGES = [(1, None, "en"), (2, "", "en"), (3, "  \n ", None), (None, "plain words without an id " * 3, "de"), (4, "x", "zz"), (4, "x", "zz")]


def test_edges_of_the_stages(spark, stages):
    """Null, empty and blank texts, ids that repeat or lack, unknown languages."""
    first = spark.read.parquet(f"{SF}/documents.parquet")
    text = first.orderBy(F.length("text").desc()).where("length(text) < 4000").first().text
    rows = [(k, t, lang, "s", len(t or "")) for k, t, lang in [*EDGES, (7, text, "en"), (7, text, "en"), (7, text + " more", "en"), (None, text, "en")]]
    docs = spark.createDataFrame(rows, first.schema).repartition(2)
    names = dict(corpus_pipeline.STAGES)
    kept = names["toxicity"](spark, docs, SF)
    assert kept.where("text is null").count() == 1 and kept.count() >= len(EDGES)
    assert names["quality_rules"](spark, docs, SF).where("length(text) < 20 or text is null").count() == 0
    one = names["ngram_join"](spark, docs, SF).collect()
    assert sum((r.text or "").startswith(text[:200]) for r in one) == 1 and sum(r.text == "x" for r in one) == 1
    assert sum(not (r.text or "").strip() for r in one) == 3
    cut = names["suffix_array_dedup"](spark, docs, SF)
    assert cut.count() == len(rows) and cut.where("text is null").count() == 0 and cut.where("length(text) <> n_chars").count() == 0
    packed = names["packing"](spark, docs, SF)
    assert packed.where("offset = 0").count() == packed.select("sequence_id").distinct().count() and packed.agg(F.sum("length")).first()[0] >= len(rows)


def test_stages_of_nothing(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_clashing_columns(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"kept": F.lit("mine"), "severity": F.lit(1), "carry": F.lit(2), "th": F.lit(3)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {r.kept for r in out.select("kept").distinct().collect()} == {"mine"}, name


def test_queries_with_sql(spark):
    from quillspark.llm import queries
    from test_oracle import TABLES, rows as normal

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.oracle_sql().items():
        assert normal(queries.queries()[name](spark, SF).toPandas()) == normal(con.sql(sql).df()), name
