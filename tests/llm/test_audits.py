"""Merkle manifest, host reputation and source divergence against SQL and against plain versions."""

import random
from hashlib import sha256

import numpy as np
import pytest
from compare import differences, duckdb_tables
from pyspark.sql import functions as F

from salesmart.llm import host_reputation, merkle_manifest, queries, source_divergence
from salesmart.llm.oracle import oracle_sql
from salesmart.llm.shared import shared_folder

GIVEN = "/root/testdata/sf0.001"
NAMES = sorted(oracle_sql())


def saved(folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_given_tables(spark, name):
    assert differences(queries.queries()[name](spark, GIVEN), duckdb_tables(GIVEN), oracle_sql()[name]) == []


@pytest.fixture(scope="module")
def hostile(spark, docs, tmp_path_factory):
    """The small hostile documents, many copies, words in 30 documents and more, a long text, hostile urls and labels."""
    rng = random.Random(5)
    vocabulary = ["the", "ÉTÉ", "Été", "naïve", "x1y", "q_r", "Zoë's", "日本語", "end"]
    rows = [
        (100 + i % 150, " ".join(rng.choices(vocabulary, k=rng.randrange(12))), rng.choice(["en", "de", "", None]),
         rng.choice(["a", "b", "", None, "é", "z"]), rng.choice([None, 3, 9 * 10**18]))
        for i in range(400)
    ]
    rows += [(7, "same row", "en", "a", 8)] * 40 + [(None, "the the", None, None, None)] * 40 + [(8, "word " * 400_000, "en", "b", 1)]
    more = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    documents = more.unionByName(docs, allowMissingColumns=True).withColumns({c: F.lit("x") for c in ("node", "grp", "pos", "n")})
    urls = [
        None, "", "no host", "HTTP://WWW.Example.COM/en/1", "http://a.www.example.com/en/", "http://example.com/EN/x", "ftp://x.net/es/?a#b",
        "http://net/fr/", "x://", "://a.org", "a://b.net?c=/es/", "a://b.net#x://c.com/", "http://co.uk:80/x\ny/z", "a://example.com", "a://notexample.com/en/",
    ]
    urls += [f"http://h{i % 7}.s{i % 3}.{t}/p{i}" for i in range(60) for t in ("org", "example.org", "net")]
    pages = [(i if i % 11 else None, u, "h", 1) for i, u in enumerate(urls)] + [(3, "http://h1.s1.org/en/", "", 2)] * 30
    labels = [(i, 0 if i % 3 else 1, 0) for i in range(1, 150)] + [(3, 1, 1), (None, 0, 1), (4, None, None), (9999, 0, 1)]
    return saved(
        tmp_path_factory.mktemp("hostile"),
        documents=documents,
        pages=spark.createDataFrame(pages, "page_id bigint, url string, html string, host int"),
        labels=spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )


@pytest.mark.parametrize("name", NAMES)
def test_hostile_tables(spark, hostile, name):
    assert differences(queries.queries()[name](spark, hostile), duckdb_tables(hostile), oracle_sql()[name]) == []


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, tmp_path, name):
    tables = {t: spark.read.parquet(f"{GIVEN}/{t}.parquet").limit(0) for t in ("documents", "pages", "labels")}
    assert queries.queries()[name](spark, saved(tmp_path, **tables)).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 5])
def test_manifest_of_many_tiers(spark, hostile, levels):
    """Small superblocks, so that several tiers and their outer nodes are needed; groups of one row as well."""
    rows = spark.read.parquet(f"{hostile}/documents.parquet").where("doc_id is not null")
    rows = rows.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.col("doc_id").cast("string")).otherwise(F.col("lang")))
    want = sorted(map(tuple, merkle_manifest.manifest_digests(rows, shared_folder(spark, "t11")).collect()))
    assert sorted(map(tuple, merkle_manifest.manifest_digests(rows, shared_folder(spark, "t11"), levels).collect())) == want


def test_proof_by_hand(spark):
    """Three leaves of one group and one of another: the digests as written out."""
    h = lambda *parts: sha256("".join(parts).encode()).hexdigest()
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, None)], "k bigint, g string")
    a, b, c, d = h("1:1", "1:a"), h("1:2", "1:a"), h("1:3", "1:a"), h("1:4", "-")
    sub = h(h(a, b), h(c))
    root = h(d, sub)
    changed = {"k": F.when(F.col("k") == 2, F.lit(9)).otherwise(F.col("k"))}
    found = {r.k: r for r in merkle_manifest.manifest(rows, ["k", "g"], "k", "g", presented=changed).collect()}
    assert (found[1].leaf, found[1].subroot, found[1].root) == (a, sub, root)
    assert (found[1].proof, found[1].sides) == (b + h(c) + d, "RRL")
    assert (found[3].proof, found[3].sides) == (h(a, b) + d, "-LL")
    assert (found[4].proof, found[4].sides, found[4].subroot) == (sub, "R", d)
    assert found[2].folded_root == h(d, h(h(a, h("1:9", "1:a")), h(c)))
    assert [k for k, r in found.items() if not r.verified] == [2]


@pytest.mark.parametrize("seed", range(12))
def test_pair_sums(seed, monkeypatch):
    """The joint walk against the dense matrix, also where it is cut into small parts."""
    rng = np.random.default_rng(seed)
    if seed % 2:
        monkeypatch.setattr(source_divergence, "NODES_AT_ONCE", 40)
    rows, columns = int(rng.integers(2, 14)), int(rng.integers(0, 40))
    held = rng.random((rows, columns)) < rng.choice([0.02, 0.3, 1.0])
    dense = np.where(held, rng.integers(1, 10**9, (rows, columns)), 0)
    unseen = rng.integers(1, 10**9, rows)
    row, column = np.nonzero(held)
    full = np.where(held, dense, unseen[:, None])
    want = np.abs(full[:, None, :] - full[None, :, :]).sum(axis=2)
    split = int(rng.integers(0, rows))
    got = source_divergence.pair_sums(row, column, dense[held], unseen, columns, split)
    for a in range(rows):
        for b in range(a + 1, rows):
            if not split or a < split <= b:
                assert got[a, b] == want[a, b]


def test_divergence_in_small_blocks_and_tiles(spark, hostile, monkeypatch):
    docs = spark.read.parquet(f"{hostile}/documents.parquet")
    want = sorted(map(tuple, source_divergence.divergence(docs).collect()))
    for name, value in (("TILE_WORDS", 3), ("BLOCK_SOURCES", 2)):
        monkeypatch.setattr(source_divergence, name, value)
    # Workers import the module anew: only what the driver plans follows the smaller blocks, and so does the split.
    monkeypatch.setattr(source_divergence, "_tile", local_tile(source_divergence._tile))
    assert sorted(map(tuple, source_divergence.divergence(docs).collect())) == want


def local_tile(tile):
    def run(cells, groups):
        from salesmart.llm import source_divergence as module

        module.BLOCK_SOURCES = 2
        return tile(cells, groups)

    return run


def test_probabilities_of_large_counts():
    n = np.array([0, 1, 10**12, 9 * 10**14])
    below = np.array([7, 10**15, 5 * 10**12, 9 * 10**14 + 5])
    want = [1 + 10**9 * (int(a) + 5) // int(b) for a, b in zip(n, below)]
    assert source_divergence.probabilities(n, below).tolist() == want


def test_strong_reputation_blocks(spark):
    """A host with many bad pages goes, its clean sibling with as many good ones stays, as do the unlabelled ones."""
    pages = [(i, f"http://{'bad' if i % 2 else 'good'}.site.org/{i}") for i in range(200)]
    pages += [(1000 + i, f"http://new{i}.other.net/") for i in range(10)]
    pages = spark.createDataFrame(pages, "page_id bigint, url string")
    outcomes = spark.createDataFrame([(i, bool(i % 2)) for i in range(100)], "page_id bigint, bad boolean")
    found = host_reputation.judge(pages, outcomes).collect()
    assert {(r.host.split(".")[0][:3], r.verdict) for r in found} == {("bad", "block"), ("goo", "allow"), ("new", "allow")}
    assert {r.verdict for r in host_reputation.judge(pages, outcomes.limit(0)).collect()} == {"allow"}
