"""Operators against plain versions of their methods, written here without their code."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from salesmart.llm import (
    chat_windows,
    interleave,
    language_filters,
    phrase_fingerprint,
    residual_packing,
    toxicity_chain,
)
from salesmart.llm.shared import shared_folder

GIVEN = "/root/testdata/sf0.001"


def first(value):
    """Sorts nulls first."""
    return (value is not None, value if value is not None else 0)


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_interleave_sorts_and_cuts(spark, docs, shards):
    many = docs.crossJoin(spark.range(25)).withColumn("doc_id", F.col("doc_id") * 25 + F.col("id"))
    got = interleave.interleave(many, shared_folder(spark, "t7"), shards=shards).collect()
    rows = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r.source) for r in many.collect()]
    frame = spark.createDataFrame(rows, "doc_id bigint, size bigint, text_crc32 bigint, source string")
    hashed = [tuple(r) for r in frame.withColumn("h", interleave.seeded_order(17, "doc_id", "text_crc32", "size")).collect()]
    order = lambda r: (r[4], first(r[0]), r[2], r[1])
    spread = []
    for source in {r[3] for r in hashed}:
        own = sorted((r for r in hashed if r[3] == source), key=order)
        spread += [((i + 0.5) / len(own), first(source) if source is None else (True, source), *order(r), r) for i, r in enumerate(own)]
    spread.sort(key=lambda s: s[:-1])
    total, want = len(spread), []
    for i, s in enumerate(spread):
        shard = i * shards // total
        want.append((*s[-1][:4], shard, i - -(-shard * total // shards)))
    mine = [(r.doc_id, r.size, r.text_crc32, r.source, r.shard, r.slot) for r in got]
    assert sorted(map(repr, mine)) == sorted(map(repr, want))


def test_interleaved_files(spark, docs, tmp_path):
    named = docs.where("doc_id is not null and doc_id < 12")
    dealt = interleave.interleave(named, shared_folder(spark, "t7"), shards=3)
    interleave.write_interleaved(named, dealt, str(tmp_path / "out"))
    place = {r.doc_id: (r.shard, r.slot) for r in dealt.collect()}
    for shard in range(3):
        own = [r.doc_id for r in spark.read.parquet(str(tmp_path / "out" / f"shard={shard}")).collect()]
        assert own == sorted((k for k in place if place[k][0] == shard), key=lambda k: place[k][1])


def plain_phrases(text: str) -> list[str]:
    """LZ78: the longest phrase seen before and one character more."""
    seen, phrases, now = set(), [], ""
    for character in text:
        now += character
        if now not in seen:
            seen.add(now)
            phrases.append(now)
            now = ""
    return phrases + ([now] if now else [])


def test_phrases_and_minima():
    rng = np.random.default_rng(3)
    texts = ["", "a", "aaaaaaa", "abababab" * 20, "".join(rng.choice(list("ab é中\U0001f600"), 900)), "x" * 30_000]
    for text in texts:
        phrases = plain_phrases(text)
        parse = phrase_fingerprint.Parse()
        parse.read(text, 0)
        ends = phrase_fingerprint._closed(parse, len(text))
        assert ends == np.cumsum([len(p) for p in phrases]).tolist()
        names = []
        for p in set(phrases):
            points = np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.uint64)
            names.append(phrase_fingerprint.phrase_hashes(points, np.array([0]), np.array([len(p)]))[0])
        assert len(set(names)) == len(set(phrases))
        want = phrase_fingerprint.NOTHING
        if names:
            want = ((np.array(names)[:, None] * phrase_fingerprint.MULTIPLIERS).min(axis=0) >> np.uint64(32)).astype(np.uint32)
        assert phrase_fingerprint.fingerprint(text).tolist() == want.tolist()


def test_likeness_estimates_common_phrases():
    rng = np.random.default_rng(4)
    words = [f"word{i}" for i in range(300)]
    errors = []
    for _ in range(12):
        one = " ".join(rng.choice(words, 400))
        other = one[: int(len(one) * rng.random())] + " ".join(rng.choice(words, 200))
        x, y = set(plain_phrases(one)), set(plain_phrases(other))
        fp = phrase_fingerprint.fingerprint
        errors.append(phrase_fingerprint.likeness(fp(one), fp(other)) - len(x & y) / len(x | y))
    assert max(map(abs, errors)) < 0.25 and abs(np.mean(errors)) < 0.06


def plain_grams(text: str | None) -> list[str]:
    """4-grams of the lower-case text, whose runs of other characters than letters are one space."""
    kept = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    kept = " " + " ".join(kept.split()) + " "
    return [kept[i : i + 4] for i in range(len(kept) - 3)] if kept.strip() else []


def test_languages_by_exact_sets(spark):
    """Plain sets of n-grams in place of the filter: the same decisions but for a few false positives."""
    table = spark.read.parquet(f"{GIVEN}/documents.parquet")
    rows = table.select("doc_id", "text", "lang").collect()
    model = language_filters.fit(table)
    got = {r.doc_id: r for r in language_filters.identify(table.select("doc_id", "text"), model).collect()}
    teach = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    sizes = Counter(r.lang for r in teach)
    holding = {x: Counter(g for r in teach if r.lang == x for g in set(plain_grams(r.text))) for x in sizes}
    share = lambda g, x: holding[x][g] / sizes[x]
    sets = {x: set() for x in sizes}
    for g in set().union(*holding.values()):
        most = max(share(g, x) for x in sizes)
        for x in sizes:
            if share(g, x) >= 0.01 and share(g, x) >= 0.5 * most:
                sets[x].add(g)
    same, off = 0, []
    for r in rows:
        has_letter = any(c.isalpha() for c in r.text or "")
        hits = Counter({x: sum(g in sets[x] for g in plain_grams(r.text)) for x in sizes})
        best = max(hits.values(), default=0)
        if not has_letter:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        same += hits[got[r.doc_id].lang_pred] == best
        if sum(hits.values()) > 50:
            off.append(abs(got[r.doc_id].score - best / sum(hits.values())))
    lettered = sum(any(c.isalpha() for c in r.text or "") for r in rows)
    assert same >= 0.99 * lettered and max(off) < 0.03
    # No n-gram of a set is missed by the filter: a Bloom filter errs on one side only.
    for x, grams in sets.items():
        names, _, _ = language_filters.grams([" ".join(sorted(g.strip() for g in grams if " " not in g))])
        bit = model.languages.index(x)
        known = (model.languages_of(names)[:, bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)
        whole = sum(" " not in g for g in grams)
        assert known.sum() >= whole


def test_chain_is_taught_out_of_fold(spark, monkeypatch):
    """Later models see, for each document, what a model fitted without its fold says of it."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(rng.choice(["good", "bad", "ugly", "fine", "dull", "kind"], 6)) + f" filler{i % 5}") for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int("bad" in t), int("ugly" in t and "bad" in t)) for i, t in rows], "doc_id bigint, first int, second int")
    calls = []
    fit = toxicity_chain.Linear.fit.__func__

    def watched(cls, rows, columns, before, truth, size):
        model = fit(cls, rows, columns, before, truth, size)
        calls.append((before, truth, model))
        return model

    monkeypatch.setattr(toxicity_chain.Linear, "fit", classmethod(watched))
    chain = toxicity_chain.fit(table, labels, ["first", "second"], shared_folder(spark, "t3"))
    folds = toxicity_chain.FOLDS
    assert len(calls) == 2 * (folds + 1) and chain.models == [calls[0][2], calls[folds + 1][2]]
    assert all(len(before.T) == 0 for before, _, _ in calls[: folds + 1])

    # The training rows as the chain saw them: known words by hash, folds by key.
    keyed = table.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)))
    seen = [r for r in keyed.collect()]
    words = {int(n): i for i, n in enumerate(chain.words.names)}

    def probability(model, text):
        names, _ = toxicity_chain.words_and_beginnings([text])
        margin = sum(model.words[words[int(n)]] for n in set(names.tolist()) if int(n) in words) + model.bias
        return 1 / (1 + math.exp(-margin))

    unseen = sorted(round(probability(calls[1 + r.fold][2], r.text), 9) for r in seen)
    assert sorted(round(float(p), 9) for p in calls[folds + 1][0][:, 0]) == unseen
    inside = sorted(round(probability(calls[0][2], r.text), 9) for r in seen)
    assert inside != unseen
    for f in range(folds):
        assert len(calls[1 + f][1]) == sum(r.fold != f for r in seen)

    # Prediction is the plain chain: the second model gets the first one's probability.
    for r in chain.predict(table).limit(40).collect():
        p = probability(chain.models[0], r.text)
        assert r.p_first == pytest.approx(p)
        names, _ = toxicity_chain.words_and_beginnings([r.text])
        second = chain.models[1]
        margin = sum(second.words[words[int(n)]] for n in set(names.tolist()) if int(n) in words)
        assert r.p_second == pytest.approx(1 / (1 + math.exp(-(margin + second.before[0] * p + second.bias))))


def plain_best_fit(lengths, capacity):
    """Rooms of the bins: longest first, each where least room is left."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            at = min(fitting, key=lambda i: rooms[i])
            rooms[at] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def test_best_fit_and_the_tree(spark):
    rng = np.random.default_rng(10)
    for _ in range(60):
        capacity = int(rng.integers(2, 90))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 80)))
        bins, places = residual_packing.best_fit(lengths, capacity)
        used = np.bincount(bins, weights=lengths, minlength=0).astype(int) if len(bins) else np.empty(0, int)
        assert sorted((capacity - used).tolist()) == plain_best_fit(lengths.tolist(), capacity)
        # What the tree relies on: one bin at most is half full or less.
        assert (2 * used <= capacity).sum() <= 1
    assert residual_packing.cut_lengths(4100, 2048) == [4, 2048, 2048] and residual_packing.cut_lengths(2048, 2048) == [2048]


def plain_windows(turns, budget, history):
    """Windows of one conversation, as (place of the first new turn, of the last, of the first shown)."""
    system = turns[0][2] + chat_windows.MARKS if turns and turns[0][0].lower() == "system" else 0
    body = [(at, tokens + chat_windows.MARKS) for at, (_, _, tokens) in enumerate(turns) if not (system and at == 0)]
    before, upto = {}, 0
    for at, tokens in body:
        before[at] = upto
        upto += tokens
    windows = []
    for at, tokens in body:
        shown = min(a for a in before if before[at] - history <= before[a] <= before[at])
        if windows and before[at] + tokens - windows[-1]["begin"] <= windows[-1]["room"]:
            windows[-1]["hi"] = at
        else:
            room = budget - system - (before[at] - before[shown])
            windows.append({"lo": at, "hi": at, "from": shown, "begin": before[at], "room": room})
    return windows, system


def test_windows_of_a_conversation(spark):
    rng = np.random.default_rng(12)
    rows = []
    for conv in range(25):
        size = int(rng.integers(1, 30))
        roles = [rng.choice(["user", "assistant"]) for _ in range(size)]
        if conv % 3 == 0:
            roles[0] = "system"
        rows += [(conv, t, str(role), f"text {conv} {t} </s>", int(rng.integers(0, 60))) for t, role in enumerate(roles)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, n bigint")
    for budget, history in ((100, 30), (60, 0), (200, 150)):
        made = chat_windows.chat_windows(table, budget=budget, history=history, tokens="n")
        shown = made.withColumn("turns", chat_windows.read_turns(F.col("formatted"))).withColumn(
            "targets", chat_windows.read_targets(F.col("formatted"), F.col("loss"))
        )
        got = {}
        for r in shown.collect():
            got.setdefault(r.conv_id, []).append(r)
        for conv in range(25):
            turns = [(r[2], r[3], r[4]) for r in rows if r[0] == conv]
            want, system = plain_windows(turns, budget, history)
            mine = sorted(got[conv], key=lambda r: r.window)
            if not want:
                assert [(t.role, t.text) for t in mine[0].turns] == [turns[0][:2]] and len(mine) == 1
                continue
            assert len(mine) == len(want)
            for number, (r, w) in enumerate(zip(mine, want)):
                places = ([0] if system else []) + list(range(w["from"], w["hi"] + 1))
                assert [(t.role, t.text) for t in r.turns] == [turns[p][:2] for p in places]
                assert r.n_repeated == (w["lo"] - w["from"]) + (1 if system and number else 0)
                assert r.n_tokens == sum(turns[p][2] + chat_windows.MARKS for p in places)
                assert r.targets == [turns[p][1] for p in range(w["lo"], w["hi"] + 1) if turns[p][0] == "assistant"]
                assert r.n_tokens <= budget or w["lo"] == w["hi"]


def test_letters_are_those_of_unicode():
    assert all(language_filters._letters()[ord(c)] == (unicodedata.category(c)[0] == "L") for c in "aé中1 _́ßΩ\U00010400")
