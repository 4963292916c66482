"""The pipeline's stages against brute force on each stage's own input."""

import random
import re
from collections import Counter

import sentencepiece

import corpus_pipeline
from tessera.llm import language_id, near, quality, sentencepiece_codec, textbytes
from tessera.llm.components import components
from tessera.llm.shared import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    given, kept = {}, {}
    for name, stage in corpus_pipeline.STAGES:
        given[name] = docs
        docs = stored(stage(spark, docs, sf), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        kept[name] = docs.collect()
    key = lambda r: (r.doc_id, r.text, r.lang, r.source)
    # each stage against its operator's judgement, or brute force, on its own input
    own = given["language_id"]
    told = language_id.identify(own, language_id.train(own.where(textbytes.fold("doc_id", 3) != 1)), lang_out="told", score_out="how").collect()
    assert Counter(map(key, kept["language_id"])) == Counter(key(r) for r in told if r.told != "und" and r.how >= 0.3)
    assert len(kept["language_id"]) < len(told)
    own = given["quality"]
    marked = quality.score(own, quality.train(own, spark.read.parquet(f"{sf}/labels.parquet")), out="good").collect()
    assert Counter(map(key, kept["quality"])) == Counter(key(r) for r in marked if r.good >= 0.3)
    assert 0 < len(kept["quality"]) < len(marked)
    rows = given["near_dedup"].collect()
    sets = [_five(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "")) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                group = [group[j] if g == group[i] else g for g in group]
    ids = {}
    for r, g in zip(rows, group):
        ids.setdefault(g, []).append((r.doc_id is None, r.doc_id or 0))
    assert Counter(r.doc_id for r in kept["near_dedup"]) == Counter(None if least[0] else least[1] for least in map(min, ids.values()))
    ids = [r.doc_id for r in kept["near_dedup"]]
    gone = set(ids) - {r.doc_id for r in kept["decontamination"]}
    assert gone == {i for i in ids if i is not None and i < 1000 and i % 20 == 3} and gone
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.model_path())
    want = Counter((r.doc_id, tuple(sp.encode(r.text or "")), len(sp.encode(r.text or ""))) for r in kept["decontamination"])
    assert Counter((r.doc_id, tuple(r.ids), r.n_tokens) for r in kept["sentencepiece"]) == want


def test_run_and_empty(spark, sf, empty_sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "ids", "n_tokens"] and got.count() > 50
    assert corpus_pipeline.run(spark, empty_sf).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    got = {r.a: r.b for r in components(spark.createDataFrame([*chain, *star, (7, 7)], "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def _five(text):
    w = [x for x in re.split(r"[ \t\n\r\f\x0b]+", text.lower() if text.isascii() else text) if x]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def _copies(rng, n=40, words=200):
    """Originals, each with a copy whose five-word similarity is the least one of 0.8, 0.82 ... 0.94 or more that replaced words allow."""
    rows = []
    for i in range(n):
        old = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        new, least = list(old), 0.8 + 0.02 * (i % 8)
        for at in rng.sample(range(words), words):
            trial = new[:at] + [f"x{rng.randrange(10**6)}"] + new[at + 1 :]
            a, b = _five(" ".join(old)), _five(" ".join(trial))
            if len(a & b) >= least * len(a | b):
                new = trial
        rows += [(2 * i, " ".join(old), least), (2 * i + 1, " ".join(new), least)]
    return rows


def test_near_dedup_drops_planted_copies(spark):
    rows = _copies(random.Random(3))
    kept = near.keep_one(spark, spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(0, len(rows), 2))


def test_near_dedup_against_brute_force(spark, monkeypatch):
    """Chains of copies of one text, some similar enough and some not, in buckets cut into chunks."""
    monkeypatch.setattr(near, "HOT", 8)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(f"y{rng.random()}" if rng.random() < 0.015 else w for w in base) for _ in range(60)] + [None, "", " ", "a b", "A b", "a b c"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    own, want = [_five(t or "") for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if own[i] == own[j] or 5 * len(own[i] & own[j]) >= 4 * len(own[i] | own[j]):
                want = [min(want[i], want[j]) if x in (want[i], want[j]) else x for x in want]
    got = {r.doc_id: r.component_id for r in near.group(docs).collect()}
    assert got == dict(enumerate(want)) and 4 < len(set(want)) < 60
