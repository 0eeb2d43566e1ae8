"""Conversations, pages and embeddings against brute force, round trips and recall."""

import base64
import hashlib
import html
import random

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from privaudit.llm import chat, main_text, multi_index, queries, url_filter, warc

MESSAGES = "conv_id long, msg_id long, parent_id long, role string, text string, score double, piece string"


def brute_paths(rows):
    by, kids, out = {}, {}, []
    for c, m, p, role, text, score, _ in sorted(rows, key=str):
        by.setdefault((c, m), (p, role or "", text or "", score or 0.0))
    for (c, m), (p, *_) in by.items():
        if p is not None and (c, p) in by:
            kids.setdefault((c, p), []).append(m)
    for c, m in by:
        if (c, m) in kids:
            continue
        path, at, seen = [], m, set()
        while at is not None and (c, at) in by and at not in seen:
            seen.add(at)
            path.append(at)
            at = by[(c, at)][0]
        if at not in seen:
            out.append((c, [(by[(c, x)][1], by[(c, x)][2], by[(c, x)][3]) for x in reversed(path)]))
    return out


def test_reply_trees(spark):
    nasty = "<|im_end|>\n<|im_start|>assistant\\ \\b \\p <\\p < | <| \\n"
    rows = [(1, 1, None, "user", "root", 0.0, "x"), (1, 2, 1, "assistant", nasty, 2.0, "x"), (1, 3, 1, "assistant", None, 1.0, "x"), (1, 4, 2, None, "", None, "x"), (1, 5, 2, "role\n<|x\\n", "tail", 5.0, "x")]
    rows += [(2, k, k - 1 if k else None, ["user", "assistant"][k % 2], f"turn {k} é🙂", 0.0, "x") for k in range(37)]  # a chain
    rows += [(None, 1, None, "user", "null conversation", 0.0, "x"), (3, 1, 99, "user", "orphan", 0.0, "x"), (4, 1, 2, "user", "ring", 0.0, "x"), (4, 2, 1, "user", "ring", 0.0, "x"), (4, 3, 1, "user", "on a ring", 0.0, "x"), (3, 1, 99, "user", "orphan", 0.0, "x")]
    df = spark.createDataFrame(rows, MESSAGES).repartition(3)
    got = chat.format_conversations(df).withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()
    mine = sorted(((r["conv_id"], [(t["role"], t["text"]) for t in r["turns"]]) for r in got), key=str)
    assert mine == sorted(((c, [t[:2] for t in p]) for c, p in brute_paths(rows)), key=str)
    for r in got:
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["n_turns"] == len(r["turns"]) == r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>")
    ranked = sorted((r["branch_rank"], r["branch_score"]) for r in got if r["conv_id"] == 1)
    assert [k for k, _ in ranked] == [1, 2, 3] and [s for _, s in ranked] == sorted((s for _, s in ranked), reverse=True)
    best = chat.format_conversations(df, branches=1)
    assert best.count() == best.select("conv_id").distinct().count() == 4
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_chat_query_equals_sql(spark, small):
    duck = duckdb.connect()
    duck.execute(f"create view conversations as select * from '{small}/conversations.parquet'")
    df = queries.op3_chat_trees(spark, small)
    cursor = duck.execute(queries.oracle_sql()["op3_chat_trees"])
    columns = [d[0] for d in cursor.description]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(cursor.fetchall())


def b32(payload):
    return base64.b32encode(hashlib.sha1((payload or "").encode()).digest()).decode()


def brute_warc(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    return [(i, len((h or "").encode()), b32(h), "response" if i is None or first[h or ""] == i else "revisit", None if i is None or first[h or ""] == i else first[h or ""]) for i, _, h in rows]


FAKE = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\nWARC/1.1\r\nbroken"


def warc_rows():
    rng = random.Random(1)
    rows = [(i, f"http://a/{i}", "".join(rng.choice("abc é\r\n") for _ in range(rng.randint(0, 400)))) for i in range(10, 60)]
    rows += [(1, "u", None), (2, None, ""), (3, "u\r\nEvil: 1", FAKE), (4, "u", FAKE), (5, "u", "WARC/1.1\r\n" * 50), (6, "u", "b" * 200_000), (7, "u", "b" * 200_000), (8, "u", FAKE * 3000), (9, "u", FAKE * 3000 + "."), (None, "u", FAKE), (None, "u", "unlike")]
    return rows


@pytest.mark.parametrize("split", ["4k", "128m"])
def test_warc(spark, split):
    rows = warc_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("first", F.lit("clash")).repartition(3)
    path = warc.write_archives(pages)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records = warc.read_archives(spark, path)
        got = [tuple(r) for r in warc.resolve(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got, key=str) == sorted(brute_warc(rows), key=str)


def test_warc_files_are_plain_warc(spark, tmp_path):
    path = warc.write_archives(spark.createDataFrame([(1, "http://x", "<p>é</p>"), (2, "http://y", "<p>é</p>")], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at, kinds = 0, []
    while at < len(data):
        assert data[at : at + 10] == b"WARC/1.1\r\n"
        fields, begin = warc.parse_header(data[at + 10 :])
        kinds.append(fields["warc-type"])
        at += 10 + begin + int(fields["content-length"])
        assert data[at : at + 4] == b"\r\n\r\n"
        at += 4
    assert sorted(kinds) == ["response", "revisit"]
    (next((tmp_path / "w").glob("part-*"))).write_bytes(data[:-30])
    for crc in (tmp_path / "w").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="does not lead"):
        warc.read_archives(spark, path)


def test_warc_long_headers_and_many_false_candidates(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999999\r\n\r\n"
    rows = [(1, "data:" + "u" * 1_000_000, "one"), (2, "u", fake * 30_000), (3, "u", "WARC/1.1\r\nWARC-Type: x\r\nContent-Length: " + "9" * 6000 + "\r\n\r\n"), (4, "u", "end"), (5, "u", fake), (5, "u", "twice"), (7, "u", fake), (8, "u", "twice")]
    rows += [(100 + k, "u", "hot") for k in range(1500)]  # more than a hot key's rows
    path = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.resolve(warc.read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_warc(rows), key=str)


def test_warc_thresholds_and_empty(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]
    got = warc.resolve(warc.read_archives(spark, warc.write_archives(spark.createDataFrame(rows, schema), least_bytes=3)))
    assert {r["page_id"]: r["refers_to"] for r in got.collect()} == {1: None, 2: None, 3: None, 4: 3}
    assert warc.resolve(warc.read_archives(spark, warc.write_archives(spark.createDataFrame([], schema)))).collect() == []


RULES = queries.URL_RULES


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "": ("", "", None), "no scheme.net/": ("", "", None), "://a.net/": ("a.net", "/", "net/"), "http://NET/x?y": ("net", "/x", "net/"), "http://planet/": ("planet", "/", None),
        "http://A.b.Example.NET/en/q#z": ("a.b.example.net", "/en/q", "example.net/en/"), "http://example.net/enx": ("example.net", "/enx", "net/"), "http://x.org/fr/": ("x.org", "/fr/", "org/fr/"), "http://x.org/FR/": ("x.org", "/FR/", None),
        "http://example.com/de/1": ("example.com", "/de/1", "example.com/de/"), "http://net": ("net", "", None), "http://net?x": ("net", "", None), "http://a\nb.net/\nc": ("a\nb.net", "/\nc", "net/"), "http://ÄB.net/": ("Äb.net", "/", "net/"), "http://a://b/": ("a:", "//b/", None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("ratio", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in url_filter.judge(df, RULES).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_url_model(spark):
    rng = random.Random(3)
    good = lambda: f"https://{rng.choice('abcdef')}ews.example.net/en/{rng.randint(1, 9999)}"
    bad = lambda: f"http://{rng.choice('pqrs')}pam-pills.net/buy/{rng.randint(1, 9999)}?ref=x"
    rows = [(i, good() if i % 2 else bad()) for i in range(400)] + [(1000 + i, good().replace("example.net", "site.io") if i % 2 else bad().replace(".net", ".io")) for i in range(100)] + [(5, good()), (2000, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    got = url_filter.judge(df, RULES).collect()
    assert len(got) == len(rows)
    free = [r for r in got if 1000 <= r["page_id"] < 1100]
    assert all(r["rule"] is None for r in free) and sum(r["verdict"] == ("allow" if r["page_id"] % 2 else "block") for r in free) >= 97
    assert url_filter.judge(df.limit(0), RULES).collect() == []
    assert {r["verdict"] for r in url_filter.judge(df.where("page_id >= 1000"), RULES).where("rule is null").collect()} == {"allow"}  # no training rows


def test_url_probabilities_equal_brute_force(spark):
    """Contexts of two to five symbols: all short ones, long ones by their counts; each one's probabilities sum to one."""
    training = [(f"http://{w}.net/{i % 7}", w < "m") for i, w in enumerate(["alpha", "beta", "gamma", "omega", "sigma"] * 12)] + [("", True), (None, False), ("zz", False)]
    code = lambda c: ord(c.upper()) - 32 if not c.isdigit() else 16
    texts = [([0] * 5 + [code(c) for c in url or ""], side) for url, side in training]
    seen = {True: {}, False: {}}  # side -> context -> symbol -> count
    for coded, side in texts:
        for i in range(5, len(coded)):
            for k in range(6):
                followers = seen[side].setdefault(tuple(coded[i - k : i]), {})
                followers[coded[i]] = followers.get(coded[i], 0) + 1
    total = {c: sum(sum(seen[side].get(c, {}).values()) for side in seen) for side in seen for c in seen[side]}

    def p(side, context, symbol):
        shorter = p(side, context[1:], symbol) if context else 1 / 64
        own = seen[side].get(context)
        return (own.get(symbol, 0) + len(own) * shorter) / (sum(own.values()) + len(own)) if own else shorter

    got = url_filter.fit(spark, spark.createDataFrame(training, "url string, accepted boolean")).collect()
    found, sums = {}, {}
    for r in got:
        digits = tuple(r["cell"] // 64**k % 64 for k in range(r["length"], -1, -1))
        found[digits] = (r["accepted"], r["rejected"])
        for side in ("accepted", "rejected"):
            sums[digits[:-1], side] = sums.get((digits[:-1], side), 0.0) + r[side]
    assert all(x == pytest.approx(1) for x in sums.values())
    contexts = {d[:-1] for d in found}
    assert sum(len(c) == 2 for c in contexts) == 64**2
    assert {c for c in contexts if len(c) > 2} == {c for c, n in total.items() if len(c) > 2 and n >= 16}
    assert {len(c) for c in contexts} == {2, 3, 4, 5}
    for d in [d for d in found if len(d) > 3 or total.get(d[:-1])]:
        assert found[d] == pytest.approx((p(True, d[:-1], d[-1]), p(False, d[:-1], d[-1])), rel=1e-9)


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var a = "<p>no</p>";</script><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">More</a></li></ul></nav>
<div class="cookie-notice">We use cookies here</div><div class="ad">Buy this now</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>text,&nbsp;with   <a href="y">a link</a>.
New line</p><div class="advert">inner advert</div><p>Second<br>break &lt;tag&gt; &#233;<p>Unclosed third</p>
<section id="comments"><p>reader says hello</p></section></article>
<aside>Side words go here</aside><form><label>Name</label><button>Send</button></form><footer>&copy; foot words</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "<p></p>"), (5, "u", "plain &eacute; words"), (1, "u", PAGE), (None, None, "<article>x <b>y</b></article>"), (6, "u", "<article>" + "<p>w &amp;</p>" * 20000 + "</article><footer>no</footer>"), (7, "u", "<div><p>broken <b>tags <div class='ad'>advert"), (8, "u", "<!-- open comment <p>text</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(2)
    got = {r["page_id"]: r["text"] for r in main_text.extract(df).collect()}
    assert got[1] == "Title & more First boldtext, with a link. New line Second break <tag> é Unclosed third"
    assert got[2] == got[3] == got[4] == got[8] == "" and got[5] == "plain é words" and got[None] == "x y"
    assert got[6] == " ".join(["w &"] * 20000) and got[7] == "broken tags"
    assert main_text.extract(df).count() == len(rows) and main_text.extract(df.limit(0)).collect() == []


def test_main_text_of_the_given_pages(spark, small):
    import re

    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in main_text.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        assert got[r["page_id"]] == " ".join(html.unescape(re.sub("</?(?:p|h1|br)>", " ", inside).replace("<b>", "").replace("</b>", "")).split())


def test_scan_finds_the_best_part():
    rng = random.Random(8)
    for _ in range(60):
        source = "".join(rng.choice(["one two ", "<p>", "</p>", "<div>", "</div>", "w ", "<a>", "<nav>x y z</nav>"]) for _ in range(25))
        page, costs = main_text.Page(source), {"p": 0.5, "/p": 0.5, "div": 3.0, "/div": 3.0, "a": 1.5}
        out = page.marked({"nav"})
        score = [-costs.get(t, 1.0) if t is not None else float(w) for t, w in zip(page.tags, page.words)]
        for e in out:
            score[e[2] : e[3]] = [-4.0] + [0.0] * (e[3] - e[2] - 1)
        sums = [sum(score[a:b]) for a in range(len(score)) for b in range(a, len(score) + 1)] or [0]
        a, b = page.region(costs, 1.0, out, 4.0)
        assert sum(score[a:b]) == pytest.approx(max(0, max(sums)))


def whole_page(source):
    """The text if the scan is switched off: the whole page as region."""
    weights = main_text.Weights([])
    page = main_text.Page(source)
    return page.text((0, len(page.tags)), page.marked(weights.marks))


def test_the_scan_decides():
    body = "<p>" + "word " * 30 + "</p><p>and <a href='x'>one link</a> more</p>"
    links = "".join(f"<div><a href='/{k}'>Part</a></div>" for k in range(9))
    source = f"<body>{links}<div>{body}</div><aside>x</aside><div>All rights reserved</div>{links}</body>"
    labelled = [f"<body>{links}<article>{body}</article><div><a>Up</a></div></body>"] * 5
    text = " ".join(["word"] * 30) + " and one link more"
    assert main_text.Weights(labelled).text(source) == main_text.Weights([]).text(source) == text
    assert "Part" in whole_page(source) and "rights" in whole_page(source)


def test_marks_are_learnt():
    labelled = [f"<body><div class='teaser box'>go there {k} now</div><article><div class='box'><p>the text {k}</p></div></article></body>" for k in range(10)]
    weights = main_text.Weights(labelled)
    assert ".teaser" in weights.marks and ".box" not in weights.marks and "div" not in weights.marks
    inner = "<article><p>one two three</p><div class='teaser'>read on</div><p>four</p></article>"
    assert weights.text(inner) == "one two three four" and main_text.Weights([]).text(inner) == "one two three read on four"


def test_hostile_markup():
    for name in ("svg", "select", "object", "textarea", "iframe", "title", "button", "template", "noscript", "canvas"):
        assert main_text.Weights([]).text(f"<article><p>Hello <{name} x=1> world</p><p>this is the article text</p></article>") == "Hello world this is the article text", name
    for tag in ("<script src=/js/>", "<script/>", "<SCRIPT x='/'>", "<style/>"):
        end = "</" + tag[1:].split()[0].strip("/>").rstrip("/") + " >"
        assert main_text.Weights([]).text(f"<p>here {tag}var leak = '<p>1</p>'; more leak{end} After all</p>") == "here After all"
    assert main_text.Weights([]).text("<p>one two <a title=5\" tall\">three</a> four</p>") == "one two three four"
    assert main_text.Weights([]).text("<p>one two <a title='x>three</a> four</p>") == "one two three four"
    assert main_text.Weights([]).text("<article><h2 id='related'>Related work</h2><p class='x'>a < b & c</p></article>") == "Related work a < b & c"
    import time

    for part in ("<a ", "<b></i>", "<title>", "<a x='", "<svg>", "<p>", "</", "<article>x"):
        started = time.time()
        main_text.Weights([]).text(part * 60_000)
        assert time.time() - started < 10, part
    for source in ("<article>" * 40_000 + "</body>" * 40_000, "<body>" * 40_000 + "<main>" * 40_000 + "</html>" * 40_000, "<article><body>x" * 30_000 + "</body>" * 30_000):
        started = time.time()
        main_text.Weights([]).text(source)
        assert time.time() - started < 10


def test_depth_follows_the_rows():
    """Radii that hold the depth carried on from the sample hold 90 % of true neighbours, however many rows there are."""
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(32, 32)) / 6 + np.eye(32)
    depths = []
    for n in (5_000, 120_000):
        X = rng.normal(size=(n, 32)) @ mix
        codes, most = multi_index.learn(X[:4096], 10, 0.98)
        depths.append(max(800, multi_index.depth_of(codes, X[:4096], n, 10, 0.95)))
        coded, held = codes(X), 0
        for q in rng.choice(n, 40, replace=False):
            d = ((X - X[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            apart = multi_index.distances(coded, coded[q])
            radius = multi_index.radii(coded[q : q + 1], coded[:4096], depths[-1] / n, most)[0]
            held += (apart[np.argpartition(d, 10)[:10]] <= radius).sum()
        assert held >= 0.9 * 400
    assert depths[0] < depths[1] < 0.2 * 120_000


def vectors(n=1500, d=24, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(X)]
    return rows


def brute_nearest(rows, k):
    ok = [(i, np.array(v, float)) for i, v, _ in rows if i is not None and v and len(v) == 24 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, v in {i: v for i, v in ok if i % 100 == 0}.items():
        d = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for j, w in ok if j != i)
        out[i] = d[:k]
    return out


def test_multi_index_search(spark):
    rows = vectors()
    same = rows[0][1]
    rows += [(5000 + i, same, 0) for i in range(30)] + [(2000, None, 0), (2100, [0.0] * 24, 0), (2200, [1.0] * 23 + [None], 0), (2300, [1.0] * 23 + [float("nan")], 0), (2400, [1.0] * 23 + [float("inf")], 0), (2500, [1.0] * 7, 0), (None, rows[1][1], 0), (2600, [], 0), rows[3]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(3)
    got = multi_index.search(df, F.col("vec_id") % 100 == 0, k=10, block_rows=100).collect()
    exact = brute_nearest(rows, 10)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    assert set(found) == set(exact)
    hits = sum(len(set(v for _, v in found[q]) & {v for _, v in exact[q]}) for q in exact)
    assert hits / sum(map(len, exact.values())) >= 0.9
    assert [v for _, v in found[0]] == list(range(5000, 5010))  # ties to the smaller id
    for q in found:
        assert len(found[q]) == 10 and found[q] == sorted(found[q])
    assert multi_index.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    few = multi_index.search(df.where("vec_id in (100, 101, 102)"), F.col("vec_id") % 100 == 0, k=10).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2]


def test_probing_is_complete(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 24))
    X[150:] = X[:150] + 0.05 * rng.normal(size=(150, 24))
    codes, _ = multi_index.learn(X, 10, 0.95)
    coded = codes(X)
    index = spark.createDataFrame([(i, i, c.tobytes()) for i, c in enumerate(coded)], "number long, vec_id long, code binary")
    for radius, rows in ((0, 8192), (7, 20), (40, 20)):
        own = {q: max(0, radius - q // 60) for q in range(0, 300, 60)}  # each query has its radius
        asked = spark.createDataFrame([(q, coded[q].tobytes(), r) for q, r in own.items()], "vec_id long, code binary, radius long")
        brute = sorted((q, i) for q, r in own.items() for i in np.flatnonzero(multi_index.distances(coded, coded[q]) <= r).tolist() if i != q)
        got = multi_index.probe(index, asked, codes.bits, radius, block_rows=rows).collect()
        assert sorted((r["query_id"], r["number"]) for r in got) == brute  # each once


def test_clustered_vectors_are_pruned(spark):
    """Where vectors have structure, few rows are probed and recall holds."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 32))
    X = centres[rng.integers(0, 60, 3000)] + 0.1 * rng.normal(size=(3000, 32))
    codes, radius = multi_index.learn(X[:1000], 10, 0.98)
    coded = codes(X)
    width = multi_index.substring_bits(codes.bits, radius)
    values = multi_index.substrings(coded, width).astype(np.int64)
    near = multi_index.near_values(width, radius // values.shape[1])
    hits = total = 0
    for q in range(0, 3000, 100):
        probed = np.isin(values ^ values[q], near).any(axis=1)
        d = ((X - X[q]) ** 2).sum(axis=1)
        best = [i for i in np.argsort(d).tolist() if i != q][:10]
        hits += (multi_index.distances(coded[best], coded[q]) <= radius).sum()
        total += probed.sum()
    assert hits / 300 >= 0.9 and total / (30 * 3000) <= 0.1, (radius, codes.bits, hits / 300, total / 90000)


def test_recall_on_the_given_table(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in df.collect()]
    found = {}
    for r in queries.op8_multi_index_search(spark, small).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = total = 0
    for q, v in rows:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in rows if i != q)[:10]
            hits, total = hits + len(found[q] & {i for _, i in best}), total + 10
    assert hits / total >= 0.9


def test_revisit_without_response_is_an_error(spark):
    schema = "file string, start long, kind string, page_id long, refers_to long, digest string, length long, payload_bytes long, sha1 string"
    df = spark.createDataFrame([("f", 0, "revisit", 2, 1, "X", 1, None, None)], schema)
    with pytest.raises(PySparkException, match="does not lead to its payload"):
        warc.resolve(df).collect()


def test_main_text_keeps_wrapped_articles():
    weights = main_text.Weights([])
    for token in ("no-sidebar", "content-sidebar-wrap", "elementor-widget-container", "social-studies", "related-work", "sidebar"):
        assert weights.text(f'<body><div class="{token}"><p>one two three four</p></div><div class="x sidebar"><p>five</p></div></body>') == "one two three four"
    assert weights.text("<body class='menu'><div class='sidebar'><article>one</article></div></body>") == "one"
    assert weights.text("<body><p>one</p><script>x<p>two</p></body>") == "one"
