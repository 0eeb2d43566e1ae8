"""Repeated passages, tokenizer alignment and source divergence against brute force, with nulls, empties, repeats and ties."""

import bisect
import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from privaudit.llm import alignment, divergence, queries, repeats
from privaudit.llm.tokens import default_tokenizer

ORACLES = ("op11_repeated_passages", "op13_source_divergence")


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, small, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{small}/documents.parquet'")
    cursor = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    found = queries.queries()[name](spark, small)
    assert sorted(columns) == sorted(found.columns)
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(map(tuple, cursor.fetchall()), key=repr)


# ---- repeated passages


@pytest.mark.parametrize("length", [8, 9, 20, 33, 70])
def test_longest_factors(length):
    rng = random.Random(length)
    segments = [bytes(rng.choice(b"ab") for _ in range(rng.randint(length, 90))) for _ in range(14)]
    data, base = np.frombuffer(b"".join(segments), np.uint8), np.cumsum([0, *map(len, segments)])[:-1]
    starts = np.concatenate([np.arange(b, b + len(s) - length + 1) for b, s in zip(base, segments)])
    position = np.random.default_rng(length).permutation(len(starts))
    earlier, later = repeats.longest_factors(data, starts, position, length)
    words = [data[s : s + length] for s in starts]
    shared = lambda a, b: int(np.argmin(np.append(a == b, False)))
    for i, w in enumerate(words):
        lengths = [shared(w, x) for x in words]
        assert earlier[i] == max((n for n, p in zip(lengths, position) if p < position[i]), default=0)
        assert later[i] == max((n for n, p in zip(lengths, position) if p > position[i]), default=0)


def brute_repeats(docs, length, keep):
    places = defaultdict(list)
    order = lambda k, i, p: (i is not None, i or 0, k, p)
    for k, (i, t) in enumerate(docs):
        for p in range(len(t) - length + 1):
            places[t[p : p + length]].append(order(k, i, p))
    first, out = {w: min(v) for w, v in places.items()}, []
    for k, (i, t) in enumerate(docs):
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if len(places[w]) > 1 and (keep == "none" or first[w] != order(k, i, p)):
                gone[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[:-1]])
        out.append((i, len(t), kept, int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    docs = []
    for i in range(40):
        a, b = rng.randint(0, 1200), rng.randint(20, 300)
        own = "".join(rng.choice("abcdefgh é") for _ in range(rng.randint(0, 80)))
        docs.append((i, own + base[a : a + b] + own[::-1]))
    docs += [(100, "a" * 500), (101, "ab" * 200), (102, None), (103, ""), (104, docs[0][1]), (105, docs[0][1]), (None, docs[1][1]), (106, "日本" * 60)]
    return docs + [(200 + i, f"{i:03d}{base[100:160]}{i * 7:04d}") for i in range(40)]  # a passage with edges of its own


@pytest.mark.parametrize("keep,block", [("none", 4096), ("none", 5), ("first", 4096), ("first", 5)])
def test_repeats(spark, passages, monkeypatch, keep, block):
    monkeypatch.setattr(repeats, "_BLOCK", block)
    df = spark.createDataFrame([(i, t, 7) for i, t in passages], "doc_id long, text string, row int").repartition(5)
    for length in (24, 40):
        got = repeats.Repeats(df, length, keep).documents().collect()
        want = brute_repeats([(i, (t or "").encode()) for i, t in passages], length, keep)
        assert sorted(((r["doc_id"], r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in got), key=repr) == sorted(want, key=repr)
        assert all(b["end"] - b["start"] >= length for r in got for b in r["spans"])


def test_long_texts_are_cut_in_parts():
    """Texts longer than what is hashed at a time have the same segments' passages."""
    rng = np.random.default_rng(2)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    edges = np.array([0, 0, 3000, 3000, 3005, 5000])
    whole, parts = repeats.Segments(20), repeats.Segments(20)
    parts.most = 300
    passages = lambda c: {(int(t), int(p) + k): int(n) for t, p, count, n, _ in zip(*c.texts(edges, data)) for k in range(count)}
    assert passages(whole) == passages(parts) and len(passages(whole)) == 3000 - 19 + 1995 - 19


def test_hot_names_are_spread(spark, tmp_path):
    """The classes of one name do not meet in one task, and every class of a name with several is found."""
    rows = spark.range(0, 6000, 1, 6).selectExpr("if(id < 4000, -1, id div 2) name", "id kind").where("kind <> 5999")
    rows.write.parquet(str(tmp_path / "kinds"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        for k, v in zip(before, ("false", "-1", "1", "8k")):
            spark.conf.set(k, v)
        found = repeats.several_classes(spark.read.parquet(str(tmp_path / "kinds")))
        got = found.selectExpr("name", "kind", "k", "spark_partition_id() part").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r["name"], r["kind"], r["k"]) for r in got) == sorted((-1 if i < 4000 else i // 2, i, 4000 if i < 4000 else 2) for i in range(5998))
    assert max(Counter(r["part"] for r in got if r["name"] == -1).values()) <= 2000


def test_repeats_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.Repeats(empty).documents().collect() == []
    with pytest.raises(ValueError):
        repeats.Repeats(empty, keep="last")


# ---- alignment


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(default_tokenizer())
    a.encode_special_tokens = True
    aligner = alignment.Aligner(default_tokenizer(), alignment.default_pieces())
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), aligner


def brute_alignment(texts, both):
    a, b, tables = both
    rows, links, pairs = [], [], Counter()
    for t in texts:
        ids = [a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)] if t else [[], []]
        raw = [[x[i] for i in some] for x, some in zip((tables.bytes_a, tables.bytes_b), ids)]
        if not t or any(b"".join(r) != b" " + t.encode() for r in raw):
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        groups, own, start = [], [], 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ([str(i) for i in some[bisect.bisect_right(e, start) : bisect.bisect_right(e, end)]] for some, e in zip(ids, ends))
            groups.append(f"{','.join(x)}|{','.join(y)}")
            own.append((x[-1], y[-1]))
            start = end
        rows.append((len(ids[0]), len(ids[1]), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
        pairs.update(own)
    best = defaultdict(int)
    for (_, y), n in pairs.items():
        best[y] = max(best[y], n)
    return [(*r[:3], len(x), sum(pairs[p] == best[p[1]] for p in x), sum(pairs[p] for p in x), r[3]) for r, x in zip(rows, links)]


def test_alignment(spark, both, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "B", "é", "Œ", " ", "\n", "  ", "\t", ",", ".", "'s", "!!", "1", "<|endoftext|>", "<s>", "</s>", "<unk>", "\x01", "\x02", "\x00", "\xa0", "word ", "x,y", "日本", "🙂", "\r\n", " ", "ﬁ", "é", "▁", "don't", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    texts += [" ".join(rng.choice(["alpha", "Beta,", "gamma.", "élan", "end.\nNew", "internationalisation", "日本語"]) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts += [" ".join(rng.choice(["one", "two"]) for _ in range(20000)), None, "", " ", "\n", " a", "a ", "\na", "a\n", "a." * 500, "x", *["hot text"] * 300]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, key string").repartition(3)
    want = dict(enumerate(brute_alignment(texts, both)))
    found = alignment.Alignment(docs, default_tokenizer(), alignment.default_pieces(), keep_groups=True)
    for most in (alignment._BROADCAST_PAIRS, 10):  # broadcast and shuffled counts
        rows = found.measures(most).collect()
        assert {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in rows} == want
        assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in rows if r["groups_sha256"])
    assert found.texts.count() == len({t for t in texts if t})  # each distinct text once
    assert found.pairs().agg({"count": "sum"}).first()[0] == sum(r[3] for r in want.values())
    empty = alignment.Alignment(docs.limit(0), default_tokenizer(), alignment.default_pieces())
    assert empty.measures().collect() == []


# ---- divergence


def brute_divergence(rows, least, top):
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = lambda t: "".join(c if ord(c) > 127 else c.lower() if c.isalpha() else " " for c in t).split(" ")
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = [t for t in terms(text) if t]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang in {r[1] for r in rows}:
        sources = sorted({s for _, lng, s in rows if lng == lang})
        kept = {t for t, n in docs[lang].items() if n >= least}
        whole = Counter()
        for s in sources:
            whole.update({t: n for t, n in counts[lang, s].items() if t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]}
            parts["term"] = [(-f(p[s][t], q[t]), t.encode()) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.add((lang, s, part, item.decode(), -value, rank))
    return out


def test_divergence(spark):
    rng = random.Random(7)
    words = ["the", "The", "cat", "x-ray", "élan", "ÉLAN", "日本", "a1b", "~tilde", "\xa0gap", "zz", "{brace}", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["hot", "hot", "s1", "s2", "", None])) for _ in range(120)]
    rows += [(None, "fr", "only"), ("", "fr", None), ("one two", "xx", "a"), ("three", "xx", "b"), (None, "yy", "lone"), rows[0], rows[0]]
    df = spark.createDataFrame([(t, lang, s, 1, 2) for t, lang, s in rows], "text string, lang string, source string, n int, term int").repartition(3)
    for least, top in ((3, 200), (1, 5), (2, 1)):
        got = [tuple(r) for r in divergence.audit(df, least, top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_divergence(rows, least, top)
    assert divergence.audit(df.limit(0)).collect() == []
    assert all(r["value"] == 0 for r in divergence.audit(df).where("lang in ('fr', 'xx') and part = 'pair'").collect())
