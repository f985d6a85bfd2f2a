"""The pipeline's stages on planted documents, and the queries on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from twinline.llm import whitening
from twinline.llm.queries import ORACLES, QUERIES

from .conftest import prose
from .test_near_duplicates import firsts

SF = "/root/testdata/sf0.001"
INSULTS = "zzbad zzworse yyfoul yyvile".split()


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Tables with toxic documents, copies, near copies and benchmark passages among clean documents."""
    docs, labels = [], []
    for i in range(240):
        words = prose(7000 + i, 80).split()
        if i % 6 == 0:
            words[10:10] = INSULTS[: 1 + i % 4]
        labels.append((i, int(i % 6 == 0), 1))
        docs.append((i, " ".join(words), "en", "s"))
    for i in range(1, 41, 6):
        docs.append((1000 + i, docs[i][1], "en", "s"))
        near = docs[i][1].split()
        near[40] = "other"
        docs.append((2000 + i, " ".join(near), "en", "s"))
    bench = [(k, prose(9000 + k, 30)) for k in range(6)]
    for k, (_, text) in enumerate(bench):
        words = prose(9500 + k, 60).split()
        words[20:20] = text.split()
        docs.append((3000 + k, " ".join(words), "en", "s"))
    docs += [(4000, None, "en", "s"), (4001, "", None, None), (4002, "123 !!", "en", "s"), (None, prose(1, 50), "en", "s"), (238, docs[238][1], "en", "s")]
    folder = tmp_path_factory.mktemp("planted")
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages(spark, planted, tmp_path):
    docs, kept = spark.read.parquet(f"{planted}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, planted)
        made.write.parquet(f"{tmp_path}/{number}")
        columns = docs.columns
        docs = spark.read.parquet(f"{tmp_path}/{number}")
        assert number == 4 or docs.columns == columns
        kept[name] = sorted(r.doc_id or -1 for r in docs.select("doc_id").distinct().collect())
    every = {-1, *range(240), *(k + i for k in (1000, 2000) for i in range(1, 41, 6)), *range(3000, 3006), 4000, 4001, 4002}
    clean = every - set(range(0, 240, 6))
    assert set(kept["toxicity"]) == clean
    known = clean - {4000, 4001, 4002}
    assert set(kept["language ID"]) == known
    single = known - near_or_exact(spark, planted, known)
    assert set(kept["SimHash near-dedup"]) == single and not single & set(range(1000, 2000)) and single >= known - set(range(1000, 3000))
    assert set(kept["benchmark decontamination"]) == set(kept["packing"]) == single - set(range(3000, 3006))
    pieces = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).collect()
    assert all(r.n == r.m for r in pieces)


def near_or_exact(spark, planted, among):
    """Documents whose component by all pairs of fingerprints holds a smaller id."""
    rows = spark.read.parquet(f"{planted}/documents.parquet").select("doc_id", "text").distinct().collect()
    rows = [(r.doc_id, r.text) for r in rows if r.doc_id in among]
    return {k for k, _ in rows} - set(firsts(rows))


def test_run_gives_the_last_stage(spark, planted):
    clean = {*range(240), *(k + i for k in (1000, 2000) for i in range(1, 41, 6))} - set(range(0, 240, 6))
    clean -= near_or_exact(spark, planted, clean)
    assert corpus_pipeline.run(spark, planted).select("doc_id").distinct().count() == len(clean) + 1


def test_stages_of_nothing(spark, planted):
    docs = spark.read.parquet(f"{planted}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, planted).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    number = name.split("_")[0]
    table = {"op1": "embeddings", "op2": "pages", "op9": "conversations", "op11": "embeddings"}.get(number, "documents")
    rows = QUERIES[name](spark, SF)
    if number == "op12":  # its rows are phrases, each with all words of its language
        words = F.size(F.expr(r"filter(split(coalesce(text, ''), '[.,;:!?\\x0A-\\x0D \\t]+'), x -> x <> '')")).alias("n")
        docs = spark.read.parquet(f"{SF}/documents.parquet").groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sum(words))
        assert dict(map(tuple, rows.select("lang", "n").distinct().collect())).items() <= dict(map(tuple, docs.collect())).items()
        return
    key = {"op1": "query_id", "op2": "page_id", "op9": "conv_id", "op11": "vec_id"}.get(number, "doc_id")
    found = {r[0] for r in rows.select(key).collect()}
    source = spark.read.parquet(f"{SF}/{table}.parquet")
    wanted = {r[0] for r in source.select({"query_id": "vec_id"}.get(key, key)).collect()}
    if key == "query_id":
        wanted = {i for i in wanted if i % 100 == 0}
    if number == "op9":
        wanted |= {-1}
    if number == "op11":
        wanted = {r.vec_id for r in whitening.whole(source).select(F.col("key").alias("vec_id")).collect()}
    assert found <= wanted if number == "op5" else found == wanted


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("pages", "documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    sql = con.execute(f"SELECT * FROM ({ORACLES[name]})")
    names = [c[0] for c in sql.description]
    assert sorted(map(str, sql.fetchall())) == sorted(str(tuple(r)) for r in QUERIES[name](spark, SF).select(*names).collect())


def test_chat_queries_are_native(spark):
    plan = QUERIES["op9_chat_round_trip"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Scan ExistingRDD"))
