"""Texts chosen to clash, memory of the pair steps, other merge lists, unsupported files, hostile columns."""

import hashlib
import json
import subprocess
import sys
from itertools import product

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import crc
from tokenizers import Tokenizer, models

from salesmart.llm import (
    language_filters,
    lsh_forest,
    merge_automaton,
    phrase_fingerprint,
    residual_packing,
    segments,
    token_index,
    tokens,
    toxicity_chain,
)
from salesmart.llm.queries import TOKENIZER
from salesmart.llm.shared import shared_folder, written


def thue_morse(doublings: int) -> tuple[str, str]:
    """A word of two letters and its complement: any polynomial modulo 2**64 gives both the same value."""
    word = "a"
    for _ in range(doublings):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def clashing(spark):
    one, other = thue_morse(10)
    texts = [one, other, one + " x", other + " x", f"{one} {other}", f"{other} {one}", one]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1), texts


def test_chosen_texts_keep_their_ids(spark, clashing):
    docs, texts = clashing
    reference = Tokenizer.from_file(TOKENIZER)
    want = [reference.encode(t, add_special_tokens=False).ids for t in texts]
    manifest = token_index.write_shards(docs, shared_folder(spark, "t1"), TOKENIZER)
    got = {r.doc_id: r.ids_crc32 for r in token_index.read_documents(manifest).collect()}
    assert got == {i: crc([*ids, 0]) for i, ids in enumerate(want)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in merge_automaton.round_trip_digests(docs, TOKENIZER).collect():
        assert (r.ids_sha256, r.decoded_sha256) == (sha(",".join(map(str, want[r.doc_id]))), sha(texts[r.doc_id]))
    for r in residual_packing.pieces(docs, TOKENIZER).collect():
        own = [*want[r.doc_id], 0]
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length])


def test_chosen_texts_stay_unlinked(clashing):
    docs, _ = clashing
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 0}
    names, owner = toxicity_chain.words_and_beginnings(list(thue_morse(10)))
    assert len(set(names[: len(owner) // 2].tolist())) >= 2 and names[0] != names[1]


def test_range_hashes_tell_ranges_apart():
    short = ["".join(p) for n in range(1, 5) for p in product("ab\0é", repeat=n)]
    long = ["x" * n for n in range(8, 200)] + ["y" * 70 + "x" * n for n in range(8)] + list(thue_morse(6)) + list(thue_morse(21))
    data, bounds = segments.text_bytes(pa.array(short + long))
    names = segments.range_hashes(data, bounds[:-1], bounds[1:])
    assert len(set(names.tolist())) == len(short + long)
    again, places = segments.text_bytes(pa.array(["pad"] + long[::-1]))  # elsewhere, and cut by other windows
    assert segments.range_hashes(again, places[1:-1], places[2:]).tolist() == names[len(short) :][::-1].tolist()


def test_memo_compares_bytes(monkeypatch):
    """Most longer segments made to share a name: the ids are still those of each."""
    plain = segments.range_hashes

    def clashing(data, starts, ends):
        names = plain(data, starts, ends)
        long = ends - starts > segments.SHORT
        names[long] = (ends - starts)[long] % 3
        return names

    monkeypatch.setattr(segments, "range_hashes", clashing)
    encoder = tokens.TextEncoder(TOKENIZER)
    texts = [f"international organization{i} responsibilities {'éè' * i} considerable{i % 3}" for i in range(60)] + [None, ""]
    flat, bounds = encoder(pa.array(texts))
    for i, text in enumerate(texts):
        assert flat[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


PEAK = """
import resource, numpy as np, pyarrow as pa
from salesmart.llm import lsh_forest as L
n, rng = 2000, np.random.default_rng(1)
rows = [(t, r) for t in range(16) for r in range(n)]
sketch = rng.integers(0, 256, 64).astype(np.uint8)
held = [np.where(rng.random(64) < 0.1, 1, sketch).astype(np.uint8).tobytes() for _ in rows]
maps = [bytes([255]) * 512] * n
batch = pa.record_batch({
    "tree": pa.array([t for t, _ in rows], pa.int32()), "key": [b"1" * 24] * len(rows), "rep": [r for _, r in rows],
    "n_shingles": [500] * len(rows), "sketch": held, "component": [r for _, r in rows], "map": [maps[r] for _, r in rows],
})
table = pa.table({c: [0] * 4096 if c in ("shingle", "one", "other") else [500] * 4096 if c == "n_shingles" else
                  [True] * 4096 if c == "indexed" else held[:4096] if c == "sketch" else [maps[0]] * 4096 if c == "map"
                  else list(range(4096)) for c in [*L.BLOCK_KEY, "component", "rep", "n_shingles", "indexed", "sketch", "map"]})
peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
before = peak()
links = sum(b.num_rows for b in L._forest_pairs(iter([batch])))
pairs = 0
for step in (L._pairs_across(iter([batch])), L._pairs_of_blocks(table)):
    for b in step:
        pairs += b.num_rows
        if pairs > 500_000: break
print(links, peak() - before)
"""


def test_pair_steps_are_bounded_in_memory():
    """2,000 near copies with equal keys in all trees: the forest joins them all, within 150 MB."""
    run = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, cwd=corpus_pipeline.__file__.rpartition("/")[0])
    assert run.returncode == 0, run.stderr
    links, grown = map(int, run.stdout.split())
    assert links == 1999 and grown < 150


def test_forest_spans_all_pairs(monkeypatch):
    monkeypatch.setattr(lsh_forest, "WAITING", 40)
    rng = np.random.default_rng(2)
    for _ in range(30):
        nodes, count = int(rng.integers(2, 60)), int(rng.integers(1, 300))
        pairs = np.stack([rng.integers(0, nodes, count), rng.integers(0, nodes, count), rng.integers(36, 65, count)])
        grown = lsh_forest.Forest(nodes)
        links = np.concatenate([grown.add(pairs[:, at : at + 17]) for at in range(0, count, 17)] + [grown.rest()], axis=1)

        def parts(edges):
            root = list(range(nodes))
            for x, y in edges.T[:, :2].tolist():
                root = [root[x] if r == root[y] else r for r in root]
            return {frozenset(i for i in range(nodes) if root[i] == r) for r in root}

        assert parts(links) == parts(pairs) and links.shape[1] == nodes - len(parts(pairs))


def test_automaton_of_any_merge_list():
    """Merges in any order, also such as can never apply, against the library."""
    rng = np.random.default_rng(9)
    for _ in range(300):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(int(rng.integers(1, 9))):
            x, y = rng.choice(list(vocab), 2)
            if (x, y) not in merges:
                merges.append((str(x), str(y)))
                vocab.setdefault(x + y, len(vocab))
        library = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        own = merge_automaton.MergeAutomaton(
            {i: t.encode() for t, i in vocab.items()}, [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges]
        )
        for _ in range(20):
            word = "".join(rng.choice(list("abc"), int(rng.integers(1, 12))))
            assert own.encode(word.encode()) == library.encode(word).ids, (merges, word)


@pytest.mark.parametrize(
    "part, change",
    [
        (None, {"normalizer": {"type": "NFC"}}), ("pre_tokenizer", {"use_regex": False}), ("pre_tokenizer", {"add_prefix_space": True}),
        ("model", {"dropout": 0.1}), ("model", {"ignore_merges": True}), ("model", {"byte_fallback": True}), ("added", {"lstrip": True}),
        ("added", {"single_word": True}),
    ],
)
def test_unsupported_files_raise(tmp_path, part, change):
    file = json.load(open(TOKENIZER, encoding="utf-8"))
    (file if part is None else file["added_tokens"][0] if part == "added" else file[part]).update(change)
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps(file))
    for tool in (tokens.TextEncoder, merge_automaton.AutomatonTokenizer):
        with pytest.raises(ValueError, match="unsupported"):
            tool(str(path))


def test_pipeline_keeps_rows_that_share_a_doc_id(spark):
    prose = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "one text of its own"), (1, "another clean text"), (1, "one text of its own"), (2, prose), (1, prose + " end"), (None, prose), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"kept": F.lit(1), "_kept": F.lit(2), "row": F.lit("r"), "TIE": F.lit(0)})
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.select("doc_id", "text").collect())) == sorted(
        map(str, docs.select("doc_id", "text").where("doc_id is null or doc_id = 1 or doc_id = 3").distinct().collect())
    )


def test_pipeline_leaves_columns_as_they_are(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(c) for c in ("p_toxic", "P_quality", "lang_pred", "score")})
    kept = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert kept.schema == docs.schema and kept.where("p_toxic = 'p_toxic' and P_quality = 'P_quality'").count() == kept.count()


def test_packing_hands_on_what_is_of_use(spark):
    """As many sequences as when every underfull bin is handed on to the root."""
    rng = np.random.default_rng(4)
    lengths = np.concatenate([rng.integers(1, 101, 4000), rng.integers(55, 60, 4000)])
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)]
    folder = shared_folder(spark, "t9")
    cut = written(spark.createDataFrame(rows, residual_packing.PIECES).repartition(20, "doc_id"), f"{folder}/pieces")
    packed = residual_packing.pack(cut, f"{folder}/own", capacity=100, fan_in=2).collect()
    of_use = residual_packing._of_use
    residual_packing._of_use = lambda totals, equals: np.full(len(totals), equals > 0)
    try:
        all_handed_on = residual_packing.pack(cut, f"{folder}/all", capacity=100, fan_in=2).collect()
    finally:
        residual_packing._of_use = of_use
    assert len({r.sequence_id for r in packed}) == len({r.sequence_id for r in all_handed_on})
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(n for own in bins.values() for _, n in own) == lengths.sum()
    for own in bins.values():
        ends = np.cumsum([n for _, n in sorted(own)])
        assert [o for o, _ in sorted(own)] == [0, *ends[:-1].tolist()] and ends[-1] <= 100


def test_very_long_texts(spark):
    """Texts of some megabytes beside empty ones: one word, many words, one shingle again and again."""
    rng = np.random.default_rng(3)
    texts = ["x" * 2_000_000, " ".join(f"w{i}" for i in rng.integers(0, 90_000, 400_000)), "again and " * 200_000, "", None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    reference = Tokenizer.from_file(TOKENIZER)
    want = {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts) if i}
    manifest = token_index.write_shards(docs, shared_folder(spark, "t1"), TOKENIZER)
    got = {r.doc_id: r for r in token_index.read_documents(manifest).collect()}
    assert all(got[i].ids_crc32 == crc([*ids, 0]) for i, ids in want.items()) and len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in merge_automaton.round_trip_digests(docs, TOKENIZER).collect():
        assert r.decoded_sha256 == sha(texts[r.doc_id] or "") and r.n_tokens == got[r.doc_id].n_tokens - 1
        assert r.doc_id not in want or r.ids_sha256 == sha(",".join(map(str, want[r.doc_id])))
    cut = written(residual_packing.pieces(docs, TOKENIZER), shared_folder(spark, "t9"))
    packed = residual_packing.pack(cut, shared_folder(spark, "t9")).collect()
    assert sum(r.length for r in packed) == sum(r.n_tokens for r in got.values())
    found = {r.doc_id: r for r in lsh_forest.near_duplicates(docs).collect()}
    assert [found[i].n_shingles for i in (0, 2, 3, 4, 5)] == [1, 2, 0, 0, 1] and all(r.kept for r in found.values())
    prints = {r.doc_id: r for r in phrase_fingerprint.compare_with_edited(docs, ranges=2).collect()}
    assert [prints[i].n_chars for i in range(6)] == [len(t or "") for t in texts]
    told = language_filters.identify(docs, language_filters.fit(docs)).collect()
    assert {r.doc_id: r.lang_pred for r in told} == {0: "en", 1: "en", 2: "en", 3: "und", 4: "und", 5: "en"}
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(6)], "doc_id bigint, quality int, toxic int")
    chain = toxicity_chain.fit(docs, labels, ["quality", "toxic"], shared_folder(spark, "t3"))
    assert chain.predict(docs).where("p_toxic between 0 and 1").count() == 6


class _Counted:
    """A file in memory that counts what is read of it."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.bytes, self.reads = raw, 0, 0, 0

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, size: int) -> bytes:
        self.bytes, self.reads = self.bytes + size, self.reads + 1
        return self.raw[self.at : self.at + size]


def test_a_key_costs_a_few_bytes_of_the_index():
    """Whatever the shard's size; the whole index in memory says the same."""
    rng = np.random.default_rng(5)
    for rows in (10, 1_000, 200_000):
        keys = np.sort(rng.integers(-(10**12), 10**12, rows))
        keys[rows // 2 : rows // 2 + 3] = keys[rows // 2]  # a key on several rows
        keys = np.concatenate([[0, 0], np.sort(keys)])
        offsets = np.concatenate([[0], np.cumsum(rng.integers(1, 50, len(keys)))])
        raw = b"".join(token_index.index_bytes(keys, 2, offsets))
        whole = token_index.ShardIndex(raw)
        source = _Counted(raw)
        index = token_index.IndexFile(source)
        asked = [int(k) for k in rng.choice(keys[2:], 40)] + [int(keys[rows // 2 + 3]), 10**13, -7]
        for key in asked:
            source.bytes = source.reads = 0
            found = index.places_of(key)
            at = np.flatnonzero(keys[2:] == key) + 2
            want = offsets[at[0] : at[-1] + 2] if len(at) else np.empty(0, np.int64)
            assert found.tolist() == want.tolist() == whole.places_of(key).tolist()
            assert source.bytes < 600 and source.reads <= 34
        assert whole.keys.tolist() == keys.tolist() and whole.null_keys == 2


def test_lookup_of_few_and_of_many_keys(spark):
    docs = spark.createDataFrame([(i % 400, f"text {i} of many") for i in range(500)], "doc_id bigint, text string")
    manifest = token_index.write_shards(docs, shared_folder(spark, "t1"), TOKENIZER)
    reference = Tokenizer.from_file(TOKENIZER)
    want = sorted((r.doc_id, [*reference.encode(r.text, add_special_tokens=False).ids, 0]) for r in docs.collect())
    keys = docs.select("doc_id").distinct()
    for some in (keys, keys.where("doc_id in (3, 77, 399)"), keys.where("doc_id < 0")):
        held = {r.doc_id for r in some.collect()}
        assert sorted((r.key, r.ids) for r in token_index.lookup(some, manifest).collect()) == [w for w in want if w[0] in held]


def test_a_key_on_many_rows_fills_several_shards(spark):
    """Half of all rows share a key, some also the text; another part has no key."""
    rows = [(7, f"text {i % 90}") for i in range(600)] + [(None, "none")] * 200 + [(i, f"own {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_index.write_shards(docs, shared_folder(spark, "t1"), TOKENIZER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r.n_docs for r in manifest.collect()) < 600
    read = sorted(token_index.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in read] == sorted((k for k, _ in rows), key=lambda k: (k is not None, k or 0))
    reference = Tokenizer.from_file(TOKENIZER)
    want = sorted((k, [*reference.encode(t, add_special_tokens=False).ids, 0]) for k, t in rows if k in (7, 8))
    keys = spark.createDataFrame([(7,), (8,), (10**9,)], "doc_id bigint")
    assert sorted((r.key, r.ids) for r in token_index.lookup(keys, manifest).collect()) == want
