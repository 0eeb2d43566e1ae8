"""Operators on documents against brute force, with nulls, empties, repeats, ties and long texts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from privaudit.llm import content_store, decontamination, packing, quality, simhash, storage, tokens

SCHEMA = "doc_id long, text string, source string, extra int"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_tokenizer())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma.", "élan", "Straße", "x1y", "don't", "foo  bar", "tab\tend", "<|endoftext|>", "日本", "end.\nNew", "###"]
    some = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    long = " ".join(rng.choice(words[:6]) for _ in range(30000))
    return [*some, long, long + " tail", None, "", " ", "\n", some[0], some[0], some[1] + " more"]


@pytest.fixture(scope="module")
def docs(texts):
    rows = [(i, t, ["hot", "hot", "b", None][i % 4], i) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", "c", 0), (None, None, None, 1)]


def ids_of(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_encoder_equals_the_library(tokenizer):
    rng = random.Random(3)
    parts = ["a", "B", "é", "Œ", " ", "\n", "  ", "\t", ",", ".", "'s", "!!", "1", "<|endoftext|>", "\x01", "\x02", "\xa0", "word ", "x,y", "日本", "🙂", "\r\n", " "]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, "", " ", "\n", " a", "a ", "\na", "a\n", "a." * 500]
    got = tokens.encoder(tokens.default_tokenizer()).column(pa.array(some)).to_pylist()
    for text, found in zip(some, got):
        assert found == ids_of(tokenizer, text, 0)[:-1].astype("<u2").tobytes(), repr(text)


def test_encoder_keeps_words_that_came_again(tokenizer):
    encode = tokens.Encoder(tokens.default_tokenizer())
    encode.most, asked = 4, []
    learn = encode._learn
    encode._learn = lambda pieces: (asked.append(sorted(pieces)), learn(pieces))
    for text in ("x one two three four", "x two three six"):
        assert encode.column(pa.array([text])).to_pylist() == [encode.whole(text)]
    assert asked == [["\x02x", "four", "one", "three", "two"], ["six"]]


def test_encoder_cuts_signs_off(tokenizer):
    encode = tokens.Encoder(tokens.default_tokenizer())
    texts = ["word$$$ other,%%% end.", "a!!\nStraße??\n-b- don't it's' x'", "the<|endoftext|> A1$$ _a_ ΑΒΓ. é$ 日本語!!", "a" + "$" * 20, "$$$ $$$\n"]
    assert encode.column(pa.array(texts)).to_pylist() == [encode.whole(t) for t in texts]
    assert set(encode.marks) >= {"$$$", ",%%%", "!!", "??"}  # by themselves, with no word before them


def test_content_store(spark, docs, tokenizer):
    df = make(spark, docs)
    store = content_store.write_store(df, tokens.default_tokenizer())
    got = sorted(content_store.read_checksums(spark, store).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((d[0] for d in docs), key=lambda i: (i is not None, i))
    start, expected = 0, {}
    for i, t, *_ in docs:
        ids = ids_of(tokenizer, t, 2)
        expected.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got:
        assert r["start"] == start
        expected[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        start += r["n_tokens"]
    chunks = store.chunks(spark)
    assert chunks.count() == chunks.select("digest").distinct().count()
    total = sum(len(ids_of(tokenizer, t, 2)) for _, t, *_ in docs)
    assert start == total > chunks.agg(F.sum("n")).first()[0]  # copies are stored once
    assert store.manifest(spark).agg(F.sum("ids")).first()[0] == total
    back = {r["doc_id"]: r["ids"] for r in content_store.read_documents(spark, store).where("doc_id is not null").collect()}
    for i, t, *_ in docs:
        if i is not None:
            assert bytes(back[i]) == ids_of(tokenizer, t, 2).astype("<u2").tobytes()


def test_content_store_notices_damage(spark, docs):
    store = content_store.write_store(make(spark, docs), tokens.default_tokenizer())
    damaged = spark.read.parquet(f"{store.path}/loose").withColumn("ids", F.when(F.col("ids").isNotNull(), F.concat(F.col("ids").substr(F.lit(1), F.length("ids") - 2), F.unhex(F.lit("0100")))))
    damaged.write.parquet(f"{store.path}-damaged/loose")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{store.path}/{t}").write.parquet(f"{store.path}-damaged/{t}")
    with pytest.raises(PySparkException, match="does not hold what its digest says"):
        content_store.read_checksums(spark, content_store.Store(f"{store.path}-damaged")).collect()


def test_content_store_notices_lost_recipes(spark, docs):
    store = content_store.write_store(make(spark, docs), tokens.default_tokenizer())
    spark.read.parquet(f"{store.path}/loose").write.parquet(f"{store.path}-lost/loose")
    spark.read.parquet(f"{store.path}/manifest").write.parquet(f"{store.path}-lost/manifest")
    spark.read.parquet(f"{store.path}/recipes").where("doc_id <> 7 or doc_id is null").write.parquet(f"{store.path}-lost/recipes")
    with pytest.raises(ValueError, match="do not match the manifest"):
        content_store.read_checksums(spark, content_store.Store(f"{store.path}-lost"))


def test_spread_join(spark, monkeypatch):
    monkeypatch.setattr(storage, "_HOT_ROWS", 5)
    left = storage.materialize(spark.createDataFrame([(1, i) for i in range(100)] + [(i, i) for i in range(2, 9)] + [(None, 0), (77, 1)], "k int, v int"), "left")
    right = spark.createDataFrame([(i, f"r{i}") for i in range(9)], "k int, w string")
    for how in ("inner", "left"):
        assert sorted(map(tuple, storage.spread_join(left, right, ["k"], how).collect()), key=str) == sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)


def test_empty_store(spark):
    store = content_store.write_store(make(spark, []), tokens.default_tokenizer())
    assert content_store.read_checksums(spark, store).collect() == []


def test_crc_of_parts():
    data = np.arange(5000, dtype="<u4")
    for cuts in ([], [1], [7, 7, 4999], [1024, 2048, 3000]):
        parts = np.split(data, cuts)
        after = np.array([sum(map(len, parts[i + 1 :])) for i in range(len(parts))])
        moved = content_store.shift_crc(np.array([zlib.crc32(p.tobytes()) for p in parts], np.uint32), after)
        assert int(np.bitwise_xor.reduce(moved)) == zlib.crc32(data.tobytes())


def check_packing(pieces, docs, tokenizer, sequence=1024):
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    counts = {}
    for i, t, *_ in docs:
        counts.setdefault(i, []).append(ids_of(tokenizer, t, 0))
    for i, all_ids in counts.items():
        own = sorted(by_doc.pop(i), key=lambda r: r["start"])
        if len(all_ids) == 1:
            at = 0
            for r in own:
                assert r["start"] == at and r["doc_tokens"] == len(all_ids[0])
                assert r["ids_crc32"] == zlib.crc32(all_ids[0][at : at + r["length"]].tobytes())
                at += r["length"]
            assert at == len(all_ids[0])
        else:
            assert sum(r["length"] for r in own) == sum(map(len, all_ids))
    assert not by_doc
    padding = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= sequence
        padding += 0 if at & (at - 1) == 0 else sequence - at
    assert padding == 0


def test_packing(spark, docs, tokenizer):
    pieces = packing.pack(make(spark, docs), tokens.default_tokenizer(), window=2).collect()
    check_packing(pieces, docs, tokenizer)
    share, total = {}, {}
    for r in pieces:
        total[r["queue"]] = total.get(r["queue"], 0) + r["length"]
        share.setdefault(r["window_id"], {}).setdefault(r["queue"], 0)
        share[r["window_id"]][r["queue"]] += r["length"]
    n = sum(total.values())
    for w in list(share)[:-1]:
        if sum(share[w].values()) == 2048:
            for q, t in total.items():
                assert abs(share[w].get(q, 0) - 2048 * t / n) <= 2


def test_packing_with_given_shares_and_many_sources(spark, docs, tokenizer):
    given = packing.pack(make(spark, docs), tokens.default_tokenizer(), window=1, shares={"hot": 0.5, "b": 0.5}).collect()
    check_packing(given, docs, tokenizer)
    ids = packing.pack(make(spark, docs[:5]), tokens.default_tokenizer(), with_ids=True).collect()
    assert all(len(r["ids"]) == 2 * r["length"] for r in ids)
    assert packing.pack(make(spark, []), tokens.default_tokenizer()).collect() == []


def test_packing_of_many_sources_keeps_the_shares(spark, tokenizer, monkeypatch):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(1, 30))), f"s{i % 2000}", 0) for i in range(4000)]
    rows += [(4000 + i, " ".join(["delta"] * 900), "wanted", 0) for i in range(40)]
    shares = {f"s{k}": 0.1 / 2000 for k in range(2000)} | {"wanted": 0.9}
    for queues in (16_384, 1_500 if monkeypatch.setattr(packing, "_SHARED", 20) is None else 0):
        given = shares if queues > 2000 else {"wanted": 0.9} | {f"s{k}": 0.1 / 400 for k in range(400)}
        pieces = packing.pack(make(spark, rows), tokens.default_tokenizer(), window=4, shares=given, max_queues=queues).collect()
        check_packing(pieces, rows, tokenizer)
        served = {}
        for r in pieces:
            if r["queue"] == "wanted":
                served[r["window_id"]] = served.get(r["window_id"], 0) + r["length"]
        total = sum(given.values())
        whole = [w for w in sorted(served) if sum(served.values()) - sum(served[v] for v in served if v <= w) > 4096]
        assert len(whole) >= 3 and all(abs(served[w] - 4096 * 0.9 / total) <= 2 for w in whole[: None if queues > 2000 else 3])  # then short sources run dry
    with pytest.raises(ValueError, match="more shares"):
        packing.pack(make(spark, rows), tokens.default_tokenizer(), shares=shares, max_queues=100)


def test_windows_of_a_deep_tree(monkeypatch):
    """Small fans and blocks: the tree has many levels; every id has one place and windows keep the mixture."""
    monkeypatch.setattr(packing, "_FAN", 3)
    monkeypatch.setattr(packing, "_BLOCKS", (2, 2))
    monkeypatch.setattr(packing, "_CACHE_BYTES", 500)
    totals = [901, 333, 0, 57, 5]
    plan = packing.Plan(totals, totals, 4, 8)
    seen, windows = {}, {}
    for q, n in enumerate(totals):
        at = 0
        while at < n:
            step = min(7, n - at)
            for position, length in plan.runs(q, at, step) if n else ():
                for k in range(length):
                    assert position + k not in seen
                    seen[position + k] = q
                    windows.setdefault((position + k) // 32, []).append(q)
            at += step
    assert sorted(seen) == list(range(sum(totals)))
    for w in range(sum(totals) // 32):
        for q, n in enumerate(totals):
            assert abs(windows[w].count(q) - 32 * n / sum(totals)) <= 2


def test_deficit_round_robin():
    rng = np.random.default_rng(0)
    for _ in range(50):
        left = rng.integers(0, 3000, 7)
        total, size = int(left.sum()), int(rng.integers(50, 400))
        sizes = [min(size, total - at) for at in range(0, total, size)]
        served = packing.deal(left, rng.random(7), sizes)
        assert (served >= 0).all() and (served.sum(axis=1) == sizes).all() and (served.sum(axis=0) == left).all()


def brute_contamination(docs, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = low(t)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[at : at + window]), set()).add(i)
    out = []
    for i, t, *_ in docs:
        w = low(t)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for at in range(len(w) - n + 1):
                ids = windows.get(tuple(w[at : at + n]))
                if ids:
                    hit.update(range(at, at + n))
                    found |= ids
        found = sorted(str(x) for x in found if x is not None)
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination(spark):
    base = "The quick brown fox jumps over the lazy dog and then it sleeps under an old tree"
    items = [(1, base), (2, "Quick Brown"), (10, None), (11, "..."), (1, base), (12, "élan vital"), (None, "null item words")]
    docs = [
        (1, "Before: THE QUICK, brown--fox jumps over the lazy dog AND then it; after", "a", 0),
        (2, "quick brownish", "a", 0), (3, "a quick brown b quick\nbrown", "a", 0), (4, None, "a", 0), (5, "", "a", 0), (6, "Élan vital élan Vital", "a", 0),
        (7, base + " " + base, "a", 0), (7, base, "a", 0), (None, "null item words", "a", 0), (8, "x " * 50000 + base, "a", 0), (9, "aquick brown quickbrown", "a", 0),
    ]
    got = decontamination.find_contamination(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    expected = brute_contamination(docs, items, 10)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == expected
    # blocks of patterns make the same result
    few = decontamination.find_contamination(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10, pattern_bytes=40)
    assert sorted((tuple(r[c] for c in columns) for r in few.collect()), key=str) == expected
    named = spark.createDataFrame([(f"q-{i}", t) for i, t in items], "item_id string, text string")
    whole, cut = (decontamination.find_contamination(make(spark, docs), named, 10, pattern_bytes=b).collect() for b in (1 << 20, 40))
    assert sorted(map(str, whole)) == sorted(map(str, cut)) and sum(r["n_items"] for r in whole) > 0
    spans = {r["doc_id"]: r["spans"] for r in got.collect()}
    raw = docs[0][1].encode()
    assert [raw[s["start"] : s["end"]] for s in spans[1]] == [b"THE QUICK, brown--fox jumps over the lazy dog AND then it"]
    kept = decontamination.clean(make(spark, docs), spark.createDataFrame(items, "item_id long, text string"), 10)
    assert kept.columns == ["doc_id", "text", "source", "extra"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 9]
    none = decontamination.find_contamination(make(spark, docs), spark.createDataFrame([], "item_id long, text string"), 10)
    assert not any(r["contaminated"] for r in none.collect())
    assert decontamination.find_contamination(make(spark, []), spark.createDataFrame(items, "item_id long, text string")).collect() == []


def test_a_window_of_many_items(spark):
    """A window that many items share is one short pattern for the driver and the tasks."""
    shared = "one window that stands in very many of the items here"
    items = [(f"item-{i:05d}", f"{shared} and then number {i}") for i in range(20_000)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    found = decontamination.windows(benchmark, 11).where(F.size("items") > 1).collect()
    assert len(found) == 4 and {len(r["items"]) for r in found} == {20_000} and len({r["list"] for r in found}) == 1
    docs = [(i, f"before {shared} after {i}" if i % 3 else "clean", "a", 0) for i in range(300)]
    got = decontamination.find_contamination(make(spark, docs), benchmark, 11, pattern_bytes=1 << 30).collect()
    digest = hashlib.sha256(",".join(i for i, _ in items).encode()).hexdigest()
    assert all((r["n_items"], r["n_hit"], r["items_sha256"]) == ((20_000, 11, digest) if r["doc_id"] % 3 else (0, 0, hashlib.sha256(b"").hexdigest())) for r in got)


def test_automaton_memory():
    """What a block of the bounded size takes in a task."""
    import resource
    import subprocess
    import sys

    code = (
        "import resource, random, ahocorasick\nfrom privaudit.llm import decontamination as d\nrng = random.Random(1)\n"
        "words = [''.join(rng.choices('abcdefghijklmnopqrstuvwxyz', k=rng.randint(2, 9))) for _ in range(5000)]\nsize, block = 0, object.__new__(d.Block)\n"
        "text, block.patterns, block.key = rng.choices(words, k=200_000), [], 'k'\n"
        "for i in range(len(text) - 9):\n    p = (' ' + ' '.join(text[i:i + 10]) + ' ').encode()\n    size += len(p) + 50\n    block.patterns.append((p, i))\n    if size > d._PATTERN_BYTES:\n        break\n"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss\nblock.automaton()\nprint((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)"
    )
    assert resource and float(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) < 400


def brute_fingerprint(text, size):
    from xxhash import xxh64_intdigest

    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: list of (doc_id, fingerprint); components by pairs within four bits."""
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a][1] ^ fps[b][1]).count("1") <= 4:
                parent[root(a)] = root(b)
    low = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(fps))]


@pytest.mark.parametrize("extra", [None, 2])
def test_simhash(spark, extra, monkeypatch):
    if extra:
        monkeypatch.setattr(storage, "_HOT_ROWS", 3)  # large components go the other way
    rng = random.Random(2)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(12)]
    rows = [(100 + i, t, "a", 0) for i, t in enumerate(base)]
    for i in range(60):
        w = base[i % 6].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w), "a", 0))
    rows += [(500, None, "a", 0), (501, "", "a", 0), (502, " \t\n", "a", 0), (503, "One two", "a", 0), (504, "one  TWO", "a", 0), (None, base[0], "a", 0), (None, "only null", "a", 0), rows[0], (505, "ÉLAN élan\x1fx", "a", 0)]
    got = simhash.near_duplicates(make(spark, rows), 4, 4, extra).select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("f"), "component_id").collect()
    fps = [(i, brute_fingerprint(t, 4)) for i, t, *_ in rows]
    expected = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, brute_components(fps))]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert simhash.near_duplicates(make(spark, [])).collect() == []


def test_simhash_links_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_BLOCK", 64)  # what exceeds a block is dealt as pairs of blocks
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 1 << 62))
    fps = {centre}
    while len(fps) < 300:
        x = centre
        for p in rng.integers(0, 64, 4):
            x ^= 1 << int(p)
        fps.add(x)
    fps |= set(rng.integers(0, 1 << 62, 100).tolist())
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(r["a"], r["b"]) for r in simhash.link(df).collect()]
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 4 for a, b in links)
    assert len(links) < 20 * len(fps)  # forests, not all pairs
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.link(df)).collect()}
    named = [(f, f & (1 << 64) - 1) for f in signed]
    mine = [roots.get(f, f) for f in signed]
    theirs = brute_components([(i, u) for i, (_, u) in enumerate(named)])
    assert len(set(zip(mine, theirs))) == len(set(mine)) == len(set(theirs))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    assert all(got[i] == 0 for i in range(1, 201)) and got[501] == 500


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(9)
    clean = lambda: " ".join(rng.choice(["the", "house", "river", "stone", "walks", "green", "light", "under"]) + ("." if rng.random() < 0.1 else "") for _ in range(80))
    rows, labels = [], []
    for i in range(300):
        kind = i % 10
        text = clean()
        if kind == 0:
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind == 1:
            text = text.replace("stone", "scumword", 3).replace("green", "vileword", 2).replace("river", "badword", 2)
        rows.append((i, text, "s", 0))
        if i < 200:
            labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_quality(spark, labelled):
    rows, labels = labelled
    rows = [*rows, (900, None, "s", 1), (901, "", "s", 2), (None, rows[5][1], "s", 3), rows[7]]
    tags = spark.createDataFrame([*labels, (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = quality.resample(make(spark, rows), tags)
    kept = [r["doc_id"] for r in got.collect()]
    clean = [r[0] for r in rows if r[0] is not None and r[0] < 300 and r[0] % 10 > 1]
    assert set(clean) <= set(kept) and {900, 901, None} <= set(kept)
    assert kept.count(7) == 2
    assert sum(i in kept for i in range(0, 300, 10)) <= 1 and sum(i in kept for i in range(1, 300, 10)) <= 6
    assert sorted(kept, key=str) == sorted((r["doc_id"] for r in quality.resample(make(spark, rows), tags, rows=True).collect()), key=str)
    assert quality.resample(make(spark, rows), tags, rows=True).columns == ["doc_id", "text", "source", "extra"]


def test_quality_weights_equal_brute_force(spark, labelled):
    rows, labels = labelled
    rows = [*rows, (900, None, "s", 1), (901, "stonewalker stonewall stonewalks Stonewalled, stoneware", "s", 2)]
    good = {i: q == 1 and t == 0 for i, q, t in labels}
    core = lambda w: w.strip(quality._SIGNS.decode()).lower()

    def grams(text):
        words, begins = {core(w) for w in (text or "").split()}, {}
        for w in map(core, (text or "").split()):
            for k in (5, 6, 7):
                if len(w) > k:
                    begins[w[:k]] = begins.get(w[:k], 0) + 1
        return words | {(b, n) for b, times in begins.items() for n in (1, 2, 4) if times >= n}

    raw, tagged, target = {}, {}, {}
    for i, t, *_ in rows:
        for g in grams(t):
            raw[g] = raw.get(g, 0) + 1
            tagged[g] = tagged.get(g, 0) + (i in good)
            target[g] = target.get(g, 0) + good.get(i, False)
    n, share = sum(good.values()), sum(good.values()) / len(good)

    def ratio(g):
        e = min(raw[g] * n / len(rows), tagged[g] * share) + 1
        r, error = math.log((target[g] + 1) / e), math.sqrt(1 / (target[g] + 1) + 1 / e)
        return math.copysign(max(abs(r) - error, 0), r)

    shapes, all_shapes = {}, {}
    for i, t, *_ in rows:
        for b in quality.features(pa.array([t], pa.string()))[2].tolist():
            all_shapes[b] = all_shapes.get(b, 0) + 1
            shapes[b] = shapes.get(b, 0) + good.get(i, False)
    scale = sum(shapes.values()) / sum(all_shapes.values())
    model = quality.fit(make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    _, got = model.weights(pa.array([r[1] for r in rows], pa.string()))
    for (_, t, *_), w in zip(rows, got.tolist()):
        found = [ratio(g) for g in grams(t)]
        shape = sum(math.log((shapes[b] + 4) / (all_shapes[b] * scale + 4)) for b in quality.features(pa.array([t], pa.string()))[2].tolist())
        assert w == pytest.approx(min(shape, -math.log(share)) + min(sum(x for x in found if x > 0), -math.log(share)) + sum(x for x in found if x < 0), abs=1e-4)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels, documents = spark.read.parquet(f"{folder}/labels.parquet"), spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in quality.resample(documents, labels.where("doc_id % 2 = 0")).select("doc_id").collect()}
    rates = {}
    for r in labels.where("doc_id % 2 = 1").collect():
        kind = "toxic" if r["toxic"] else "good" if r["quality"] else "low"
        rates.setdefault(kind, []).append(r["doc_id"] in kept)
    rates = {k: sum(v) / len(v) for k, v in rates.items()}
    print(rates)
    assert rates["good"] >= 0.99 and rates["toxic"] <= 0.05 and rates["low"] <= 0.05


def test_quality_k_and_edges(spark, labelled):
    rows, labels = labelled
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert quality.resample(make(spark, rows), tags, k=17).count() == 17
    assert quality.resample(make(spark, rows), tags, k=0).count() == 0
    assert quality.resample(make(spark, rows), tags, k=10_000).count() == 300
    assert quality.resample(make(spark, []), tags).count() == 0
    free = quality.resample(make(spark, rows), tags.limit(0))
    assert free.count() >= 299 and all(r["log_weight"] == 0 for r in free.collect())
    clash = make(spark, rows).withColumnRenamed("extra", "key").withColumn("bits", F.lit(1)).withColumn("row", F.lit(2))
    assert quality.resample(clash, tags, rows=True).columns == ["doc_id", "text", "source", "key", "bits", "row"]


def test_gumbel_top_k_follows_the_weights():
    """Sampling k of n by weight plus Gumbel noise: the first place falls to i in proportion to its weight."""
    rng, w = np.random.default_rng(1), np.array([0.1, 0.2, 0.7])
    first = [int(np.argmax(np.log(w) - np.log(-np.log(rng.random(3))))) for _ in range(4000)]
    assert np.bincount(first, minlength=3) / 4000 == pytest.approx(w, abs=0.03)


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.uniform(-5, 5) for _ in range(500)] + [0.0, -0.0, 2.5, 2.5]
    bits = quality.ordered_bits(np.array(values)).tolist()
    df = spark.createDataFrame([(b,) for b in bits], "b long")
    for k in (1, 2, 250, 504):
        assert quality.kth_largest(df, "b", k) == sorted(bits, reverse=True)[k - 1]
    assert quality.kth_largest(df, "b", 505) is None
    assert math.isclose(sorted(values)[0], values[int(np.argmin(bits))])
