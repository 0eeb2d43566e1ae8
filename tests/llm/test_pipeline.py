"""The corpus pipeline: every stage's decision takes effect on all that the stage before kept."""

import numpy as np

import corpus_pipeline
from privaudit.llm import decontamination, quality, similar, simhash
from tests.llm.test_corpus_ops import check_packing
from tokenizers import Tokenizer

from privaudit.llm.tokens import default_tokenizer


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, None
    labels, benchmark = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == columns
        rows = out.collect()
        before, ids = {r["doc_id"] for r in docs.collect()}, {r["doc_id"] for r in rows}
        assert len(ids) == len(rows) < len(before) and ids < before
        if name == "quality_classifier":
            assert ids == {r["doc_id"] for r in quality.resample(docs, labels).collect()}
        if name == "simhash_near_dedup":
            fps = [simhash.fingerprint(r["text"], 4) for r in rows]
            assert all(bin(a ^ b).count("1") > 4 for i, a in enumerate(fps) for b in fps[:i])
        if name == "benchmark_decontamination":
            found = decontamination.find_contamination(docs, benchmark).where("not contaminated")
            assert ids == {r["doc_id"] for r in found.collect()}
        docs = spark.createDataFrame(rows, out.schema)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    kept = [tuple(r[c] for c in ("doc_id", "text")) for r in docs.collect()]
    check_packing(pieces, kept, Tokenizer.from_file(default_tokenizer()))
    whole = corpus_pipeline.run(spark, small)
    assert {r["doc_id"] for r in whole.collect()} == ids


def test_order_and_edges(spark, small):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "mixture_packing"]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).collect() == []
    odd = spark.createDataFrame([(None, "same words here", "en", "s", 1), (3, None, None, None, None), (3, None, None, None, None), (4, "", "en", "s", 0)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, small).collect()
    rows = [(None, "same words here", "en", "s", 1), (9, "Same  words here", "en", "s", 1), (9, "Same  words here", "en", "s", 1), (None, "other", "en", "s", 1), (None, "other", "en", "s", 1), (9, "third text", None, None, None)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), small).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == [(9, "Same  words here"), (9, "third text"), (None, "other")]


def test_near_copies_at_similarity(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {}
    for k in range(40):  # 10 consecutive words replaced: 14 of 2n shingles differ
        words = [f"w{k}x{i}" for i in range(134 + k % 3)]
        texts[10 * k] = " ".join(words)
        texts[10 * k + 1] = " ".join([*words[:60], *(f"new{k}x{i}" for i in range(10)), *words[70:]])
        texts[10 * k + 2] = " ".join([*words[:60], *(f"far{k}x{i}" for i in range(40)), *words[100:]])  # below 0.8

    def near(a, b):
        x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) >= 0.8 * len(x | y)

    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, docs.schema), small).collect()}
    assert all(near(texts[10 * k], texts[10 * k + 1]) and not near(texts[10 * k], texts[10 * k + 2]) for k in range(40))
    assert kept == {10 * k + d for k in range(40) for d in (0, 2)}


def components_of(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return [top(i) for i in range(n)]


def test_remaining_links(spark, monkeypatch):
    """Links join exactly what all links between different roots that share a band join, in whole and in cut cells."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    sets, texts = [], []
    for _ in range(90):  # one crowd around the same words
        at = int(rng.integers(0, 12))
        words = [*base[:at], *(f"n{rng.integers(1 << 40)}" for _ in range(rng.integers(0, 3))), *base[at:]]
        texts.append(" ".join(words))
        sets.append(similar.shingles(texts[-1], 5))
    roots = [0 if i < 60 else i for i in range(90)]
    bands = [similar.bands(s) for s in sets]
    members = spark.createDataFrame([(i, roots[i], bands[i]) for i in range(90)], "number long, root long, bands array<long>")
    given = spark.createDataFrame(list(enumerate(texts)), "number long, text string")
    jaccard = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    pairs = {(i, j) for i in range(90) for j in range(i + 1, 90) if roots[i] != roots[j] and set(bands[i]) & set(bands[j])}
    want = {(i, j) for i, j in pairs if jaccard(i, j) >= 0.8}
    assert 100 < len(want) < len(pairs)
    same = [(i, roots[i]) for i in range(90)]
    for cell, hashes in ((8 << 20, 1 << 20), (2000, 1 << 20), (8 << 20, 200), (9000, 900)):
        monkeypatch.setattr(similar, "_CELL_BYTES", cell)
        monkeypatch.setattr(similar, "_HASHES", hashes)
        found = [tuple(sorted(r)) for r in similar.remaining_links(similar.shared(members), given, 5, 0.8).collect()]
        assert set(found) <= want and components_of(90, [*same, *found]) == components_of(90, [*same, *found, *want])
        if cell == 8 << 20:
            assert len(found) == len(set(found)) < 90  # a forest, not the pairs
    assert similar.remaining_links(similar.shared(members.limit(0)), given, 5, 0.8).collect() == []


def template(n, changed):
    rng = np.random.default_rng(n)
    texts = []
    for _ in range(n):
        words = [f"t{i}" for i in range(200)]
        for at in rng.choice(200, changed, replace=False):
            words[at] = f"o{rng.integers(1 << 50)}"
        texts.append(" ".join(words))
    return texts


def test_template_just_below(spark):
    """Texts around one template that are not similar enough stay, and few links leave the tasks."""
    for n in (100, 200):
        texts = template(n, 4)
        sets = [similar.shingles(t, 5) for t in texts]
        pairs = [(i, j) for i in range(n) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
        shared = sum(bool(set(similar.bands(a)) & set(similar.bands(b))) for i, a in enumerate(sets) for b in sets[:i])
        assert shared > n * n / 5  # what would be written as pairs
        members = spark.createDataFrame([(i, i, similar.bands(s)) for i, s in enumerate(sets)], "number long, root long, bands array<long>")
        found = [tuple(r) for r in similar.remaining_links(similar.shared(members), spark.createDataFrame(list(enumerate(texts)), "number long, text string"), 5, 0.8).collect()]
        assert len(found) < n and components_of(n, found) == components_of(n, [(i, j) for i, j in pairs if set(similar.bands(sets[i])) & set(similar.bands(sets[j]))])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    near = [simhash.fingerprint(t, 4) for t in texts]
    close = [(i, j) for i in range(n) for j in range(i) if bin(near[i] ^ near[j]).count("1") <= 4]
    kept = {r["doc_id"] for r in simhash.representatives(docs, similar=(5, 0.8)).collect()}
    tops = components_of(n, [*pairs, *close])
    assert kept == {min(i for i in range(n) if tops[i] == t) for t in set(tops)}


def test_a_worker_keeps_one_operators_caches():
    from privaudit.llm import tokens, worker

    quality._KNOWN["word"] = (1,)
    encode = tokens.encoder(default_tokenizer())
    assert list(worker.task(lambda batches: batches, "encoders")(iter([1]))) == [1]
    assert not quality._KNOWN and tokens.encoder(default_tokenizer()) is encode
    list(worker.task(lambda batches: batches)(iter([])))
    assert not tokens._ENCODERS


def test_bit_sets_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 20_000)
    texts = [np.sort(rng.choice(pool, 200, replace=False)) for _ in range(400)]
    texts += [np.sort(np.append(t[:190], rng.integers(0, 1 << 62, 10))) for t in texts[:100]]  # Jaccard about 0.9

    def run(words):
        made, zeros = [], np.zeros
        monkeypatch.setattr(similar, "_WORDS", words)
        monkeypatch.setattr(np, "zeros", lambda shape, *a: (made.append(int(np.prod(shape))), zeros(shape, *a))[1])
        found = list(similar._compare(np.arange(500), None, texts, similar._Forest(np.arange(500)), 0.8))
        monkeypatch.setattr(np, "zeros", zeros)
        return max(made), sorted(found)

    most, found = run(1 << 14)
    assert most <= 1 << 14 and found == [(i, 400 + i) for i in range(100)]
    assert run(1 << 22)[1] == found
