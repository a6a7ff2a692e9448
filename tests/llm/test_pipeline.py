"""The pipeline against plain versions of what each stage promises, on a small table."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, crc
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The given documents with nulls, empty and wordless texts, copies and near copies among them."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    given = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    texts = [r.text for r in given.where("length(text) > 400").orderBy("doc_id").limit(8).collect()]
    last = given.selectExpr("max(doc_id)").first()[0]
    more = [None, "", " \n", "12 34 !!", *texts, *(f"{t} one more" for t in texts)]
    rows = [(last + 1 + i, t, "extra") for i, t in enumerate(more)]
    extra = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = given.unionByName(extra, allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF_DIR}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    (_, toxicity), (_, language), (_, copies), (_, packing) = corpus_pipeline.STAGES
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}

    clean = toxicity(spark, docs, tables).cache()
    toxic = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").where("toxic = 1").collect()}
    innocent = {r.doc_id for r in spark.read.parquet(f"{tables}/labels.parquet").where("toxic = 0").collect()}
    assert clean.columns == docs.columns
    # A dozen toxic labels teach too little for a bound on those missed; the next test has one.
    assert innocent & ids(docs) <= ids(clean) and ids(clean) < ids(docs) and toxic - ids(clean)

    known = language(spark, clean, tables).cache()
    wordless = {r.doc_id for r in clean.collect() if not any(c.isalpha() for c in r.text or "")}
    assert known.columns == docs.columns and ids(known) == ids(clean) - wordless

    rows = [(r.doc_id, r.text) for r in known.collect()]
    want = {k for k, (_, root) in brute_components(rows).items() if k == root}
    single = copies(spark, known, tables).cache()
    assert single.columns == docs.columns and ids(single) == want and single.count() == len(want)

    tokenizer = Tokenizer.from_file(corpus_pipeline.TOKENIZER)
    whole = {k: tokenizer.encode(t, add_special_tokens=False).ids + [0] for k, t in rows if k in want}
    packed = corpus_pipeline.run(spark, tables).collect()
    assert sorted((r.doc_id, r.start) for r in packed) == sorted(
        (r.doc_id, r.start) for r in packing(spark, single, tables).collect()
    )
    sequences = {}
    for r in packed:
        assert r.ids_crc32 == crc(whole[r.doc_id][r.start : r.start + r.length])
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, whole.values()))
    assert sum(r.length for r in packed) == total and len(sequences) <= -(-total // 2048) + 1


@pytest.mark.parametrize("languages", [["en"], ["en", "de"], ["en", "de", "fr", "es"]])
def test_foreign_texts_go(spark, languages):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.col("lang").isin(languages))
    first = docs.selectExpr("max(doc_id)").first()[0] + 1
    foreign = [
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto "
        "ja heidän on toimittava toisiaan kohtaan veljeyden hengessä the thing",
        "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem",
        "xqzvk wjpqx zzkvj qpwxv kjzqh vvxqz pqkzj wxzvq kqjxz zvpqw xkjqv qzxwk vjpzq xxqvk zkwqj pvxzq the",
    ]
    clean = ["The", "the thing", "and the"]
    rows = [(first + i, t, None) for i, t in enumerate(foreign + clean)]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in corpus_pipeline.keep_known_languages(spark, table, SF_DIR).collect()}
    assert kept == {r.doc_id for r in table.collect()} - set(range(first, first + len(foreign)))


def test_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.1"  # with fewer labels more are missed, see README
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    toxic = [r.doc_id for r in labels if r.toxic == 1]
    assert sum(k in kept for k in toxic) <= len(toxic) // 10
    assert all(r.doc_id in kept for r in labels if r.toxic == 0)


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
