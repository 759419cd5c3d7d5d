"""The training-data operators against brute force, with nulls, empty texts, ties, repeated rows and empty tables."""

import collections
import hashlib

import json
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratagraph.llm import html_text, lm_scoring, media, mixing, near_join, packing, quality, suffix_dedup, tool_calls, warc
from stratagraph.llm.common import tokenize
from stratagraph.llm.components import components

WORDS = [a + b for a in "ab cd ef gh ij kl mn op qr st".split() for b in "xu yo zi wa ve".split()]
SCHEMA = "doc_id long, text string, source string, n_bytes long, key string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    out = {i: prose(rng, rng.randint(5, 120)) for i in range(60)}
    passage = prose(rng, 60)
    for i in range(0, 20, 3):
        out[i] = out[i] + "\n" + passage + "\n" + prose(rng, 8)
    for i in range(20, 26):  # near copies
        words = out[19].split()
        words[rng.randrange(len(words))] = f"new{i}"
        out[i] = " ".join(words)
    out[30] = out[31] = out[32] = passage  # exact copies
    out[40], out[41], out[42], out[43] = "", None, "  \n\t ", "one Two"
    out[44] = "one two"
    out[45] = "na " * 400
    out[46] = "Grüße — 漢字 \U0001f600 " * 30
    out[47] = " ".join(WORDS[:9]) + "|" * 50
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, f"s{i % 4}" if i % 7 else None, -1, "x") for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").encode().lower().split()


def test_tokenize(texts):
    blobs = [(t or "").encode() for t in texts.values()]
    h, counts = tokenize(blobs)
    whole = [w for b in blobs for w in b.lower().split()]
    assert counts.tolist() == [len(b.split()) for b in blobs] and len(h) == len(whole)
    assert len(set(zip(whole, h.tolist()))) == len(set(whole)) == len(set(h.tolist()))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(x) for x in parent if x in got} and {x for a, b in links if a != b for x in (a, b)} == set(got)


# 1


@pytest.mark.parametrize("hot", [20_000, 2])
def test_suffix_dedup(docs, texts, hot):
    want = suffix_dedup.brute_force({k: (t or "").encode() for k, t in texts.items()})
    rows = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    got = {r.doc_id: (r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows}
    assert got == want and sum(w[0] for w in want.values()) > 2000


def test_suffix_dedup_edges(spark, docs, nothing):
    assert suffix_dedup.removal_report(nothing).count() == 0
    long = prose(random.Random(2), 60)
    rows = spark.createDataFrame([(2, long), (2, long), (5, long), (None, long), (7, "x" * 99)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in suffix_dedup.removal_report(rows).collect())
    assert got == [(False, 2, 0), (False, 2, 0), (False, 5, len(long)), (False, 7, 0), (True, 0, 0)]


@pytest.mark.parametrize("hot", [20_000, 0])
def test_suffix_dedup_repeated_rows_that_share_a_part(spark, hot):
    rng = random.Random(5)
    passage, other = prose(rng, 60), prose(rng, 60)
    texts = {2: f"{prose(rng, 30)} {passage} {prose(rng, 30)}", 5: f"{prose(rng, 20)} {passage} {prose(rng, 40)}", 8: f"{other} {prose(rng, 9)} {other}"}
    want = suffix_dedup.brute_force({i: t.encode() for i, t in texts.items()})
    rows = spark.createDataFrame([(i, texts[i]) for i in (2, 8, 5, 2, 8, 5, 2)], "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(rows, hot=hot).collect()
    assert len(got) == 7 and want[2][0] == 0 and want[5][0] >= len(passage) and want[8][0] >= len(other)
    assert all((r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id] for r in got)


def test_longest_previous_factor():
    rng = random.Random(3)
    for _ in range(30):
        s = "".join(rng.choice("ab") for _ in range(rng.randint(1, 25)))
        order = sorted(range(len(s)), key=lambda i: s[i:])
        common = lambda a, b: next((k for k in range(len(s)) if s[a + k : a + k + 1] != s[b + k : b + k + 1] or a + k >= len(s) or b + k >= len(s)), 0)
        lcp = [0] + [common(a, b) for a, b in zip(order, order[1:])]
        lpf = suffix_dedup.longest_previous(np.array(order), np.array(lcp))
        want = [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert lpf.tolist() == want, s
        arr, left = np.frombuffer(s.encode(), np.uint8), np.arange(len(s), 0, -1)
        ranks = suffix_dedup.suffix_ranks(arr, left, len(s))
        assert [i for _, i in sorted((r, i) for i, r in enumerate(ranks[max(ranks)]))] == order
        assert suffix_dedup.shared_prefix(np.array(order[:-1], int), np.array(order[1:], int), arr, left, ranks).tolist() == lcp[1:]


# 2


@pytest.fixture(scope="module")
def pages(spark):
    body = "<p>" + "word " * 60 + "</p>"
    rows = [(1, "http://a/x", body), (2, "http://a/y", body), (0, "http://b", body), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u\r\nv", "é" * 200), (7, "u", "\x1f\x8b\x08" * 200)]
    rows += [(100 + i, "http://c", "".join(chr(random.Random(i).randrange(32, 0x500)) for _ in range(3000))) for i in range(40)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3).cache()


def test_warc(spark, pages):
    payload = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert set(got) == set(payload)
    for i, r in got.items():
        assert (r.payload_bytes, r.payload_digest) == (len(payload[i]), hashlib.sha256(payload[i]).hexdigest())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 0, 2: 0}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_splits_find_each_record_once(spark, pages):
    folder = warc.archive_folder(spark)
    files = warc.write_archives(pages, folder)
    for size in (7, 1000, 1 << 20):
        small = files if size > 7 else files.orderBy("size").limit(1)
        ids = [r.page_id for r in warc.read_archives(small, folder, size).collect()]
        assert len(ids) == len(set(ids)) and (size == 7 or len(ids) == 48)


def test_warc_is_plain_gzip(spark, pages):
    import gzip

    from pyarrow.fs import FileSystem

    folder = warc.archive_folder(spark)
    files = warc.write_archives(pages, folder).collect()
    fs = FileSystem.from_uri(folder.replace("file:", "file://", 1))[0]
    text = b"".join(gzip.decompress(fs.open_input_file(f.path).read()) for f in files)
    assert text.count(b"WARC/1.1\r\n") == 48 and text.count(b"WARC-Type: revisit") == 2


# 3


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    rows = packing.pack(docs, tokenizer_path(), capacity=256).collect()
    want = {}
    for i, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for k, s in enumerate(range(0, len(ids), 256)):
            want[i, k] = (s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(seqs) <= math.ceil(sum(r.length for r in rows) / 256) * 1.05 + 1


def best(sizes, capacity):
    """The least number of bins, by search."""
    sizes = sorted(sizes, reverse=True)
    found = [len(sizes)]

    def place(i, bins):
        if len(bins) >= found[0]:
            return
        if i == len(sizes):
            found[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] >= sizes[i]:
                place(i + 1, bins[:k] + [bins[k] - sizes[i]] + bins[k + 1 :])
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return found[0]


def test_packing_plan_is_near_the_best():
    rng, more = random.Random(5), 0
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 11))]
        plan = packing.plan(collections.Counter(sizes), 20)
        used = collections.Counter()
        for times, content in plan:
            assert sum(s * n for s, n in content.items()) <= 20
            for s, n in content.items():
                used[s] += times * n
        assert used == collections.Counter(sizes)
        more += sum(t for t, _ in plan) - best(sizes, 20)
    assert more <= 3


def test_packing_edges(spark, docs, nothing):
    assert packing.pack(nothing, tokenizer_path()).count() == 0
    rows = spark.createDataFrame([(None, None), (1, "a"), (1, "a"), (2, "~ a~b ~ <|endoftext|>x")], "doc_id long, text string")
    got = packing.pack(rows, tokenizer_path()).collect()
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(tokenizer_path()).encode("~ a~b ~ <|endoftext|>x", add_special_tokens=False).ids, 0], dtype="<u4")
    assert len(got) == 4 and [r.ids_crc32 for r in got if r.doc_id == 2] == [zlib.crc32(ids.tobytes())]


# 4


def test_media(docs, texts):
    got = {r.doc_id: r for r in media.media_features(docs).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        b = (text or "").encode()
        p = b + bytes(-len(b) % 64 if b else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_sha256 == hashlib.sha256(media.to_wav(p)).hexdigest() and r.media_bytes == len(p) + 44 and r.feature == media.features(p)
    assert got[30].feature == got[31].feature


def test_chunks_follow_content(spark, nothing):
    rng = random.Random(9)
    data = bytes(rng.randrange(256) for _ in range(200_000))
    a, b = media.chunks_of(data), media.chunks_of(b"shift" + data)
    assert b"".join(a) == data and len(set(a) & set(b)) > 0.9 * len(a)
    assert all(len(c) <= media.LONGEST for c in a) and 1000 < len(data) / len(a) < 5000
    assert media.media_features(nothing).count() == 0
    long = " ".join(rng.choice(WORDS) for _ in range(4000))
    rows = spark.createDataFrame([(1, long), (2, long + " more"), (3, "pre " + long), (None, long), (1, long)], "doc_id long, text string")
    assert media.media_features(rows).count() == 5


# 5


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
    <article class="post-12"><h1>Head &amp; line</h1><p>First   para
    graph.<br>Still first<p>Second &#233; <b>bold</b><div class="ad">Buy</div><form><input value="x">Send</form><!-- gone --><aside>side</aside>
    <ul><li>one<li>two</ul><section id="comments"><p>Nice!</p></section></article><footer>&copy; us</footer></body></html>"""
    rows = [(1, "https://h.example/a", page), (2, "https://h.example/b", page.replace("post-12", "post-7")), (3, "https://h.example/c", "<article>lost <p>tags"), (4, None, None), (5, "x", ""), (6, "http://t", "plain &lt;text&gt;"), (7, "http://t", "<p" + "<b>" * 3000 + "deep")]
    got = {r.page_id: r for r in html_text.main_texts(spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, path int")).collect()}
    want = "Head & line\nFirst para graph. Still first\nSecond é bold\none\ntwo"
    assert got[1].text == want and got[2].text == want and got[1].n_chars == len(want)
    assert got[3].text == "lost\ntags" and got[4].text == "" and got[5].text == "" and got[6].url == "http://t" and len(got) == 7


def test_html_consensus(spark):
    """A page whose sidebar outweighs its article still gives the article, as its host agrees on the path."""
    usual = '<body><div class="main"><p>{}</p></div><div class="extra"><p>{}</p></div></body>'
    rows = [(i, "http://h/", usual.format("long text " * 30, "few words")) for i in range(5)] + [(9, "http://h/", usual.format("short text", "other things " * 50))]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short text"


def test_html_takes_the_whole_article(spark):
    """Title and lede beside the longest div, and the smaller of two sections, belong to the text."""
    long = "long text " * 30
    rows = [(1, "http://a/", f"<body><article><h1>T</h1><p>lede</p><div class='body'>{long}</div></article></body>")]
    rows += [(2, "http://b/", f"<body><div class='page'><div class='one'>{'x' * 60}</div><div class='two'>{'y' * 40}</div></div></body>")]
    rows += [(3, "http://c/", f"<body><main><h1>T</h1><div class='body'><p>{long}</p></div></main><div class='extra'>other</div></body>")]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"T\nlede\n{long.strip()}", 2: f"{'x' * 60}\n{'y' * 40}", 3: f"T\n{long.strip()}"}


def test_html_keeps_the_article_in_a_layout_class(spark):
    """A class that says how a page is laid out, or that marks a wrapper of the whole article, drops nothing of it."""
    text = "long text " * 30
    classes = ["layout with-sidebar", "content no-sidebar", "ad-free", "post has-comments", "entry share", "sidebar-right", "page layout-with-sidebar"]
    shapes = ["<div class='{}'><article><p>{}</p></article></div>", "<div class='{}'><p>{}</p></div>", "<main><h1>T</h1><div class='{}'><p>{}</p></div></main>"]
    side = "<div class='ad'>Buy</div><div class='site-promo'>Offer</div><ul class='share-buttons'><li>Post it</ul>"
    rows = [(10 * i + j, f"http://h{i}{j}/", "<body>" + side + shape.format(c, text) + "</body>") for i, c in enumerate(classes) for j, shape in enumerate(shapes)]
    thread = f"<article><p>short</p></article><div id='comments'><article class='comment'><p>{text}</p></article></div>"
    rows += [(100, "http://t/", f"<body><main>{thread}</main></body>"), (101, "http://u/", f"<body><div class='page sidebar'>{thread}</div></body>")]
    got = {r.page_id: r.text for r in html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {i: t for i, t in got.items() if i < 100} == {r[0]: ("T\n" if r[0] % 10 == 2 else "") + text.strip() for r in rows if r[0] < 100}
    assert got[100] == "short" and got[101] == "short"


# 6


def test_targets():
    assert mixing.targets({"a": 10, "b": 10, None: 10}, 30, {"a": 1, "b": 2, None: 3}, 3) == {"a": 5.0, "b": 10.0, None: 15.0}
    got = mixing.targets({"a": 1, "b": 100, "c": 0}, 101, {"a": 2, "b": 1, "c": 3}, 3)
    assert got == {"a": 3.0, "b": 98.0, "c": 0.0}


def test_mixing(docs, texts, spark, nothing):
    rows = mixing.mix_sources(docs).collect()
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, len(words_of(t))) for i, t in texts.items())
    source = {r.doc_id: r.source for r in docs.collect()}
    total, longest = collections.Counter(), collections.defaultdict(int)
    target = {}
    for r in rows:
        s = source[r.doc_id]
        total[s] += r.taken
        target[s] = r.target
        longest[s] = max(longest[s], r.size)
        assert r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
    names = sorted(target, key=lambda s: (s is None, s or ""))
    sizes = {s: sum(r.size for r in rows if source[r.doc_id] == s) for s in names}
    assert target == pytest.approx(mixing.targets(sizes, sum(sizes.values()), {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}, 3))
    assert all(abs(total[s] - target[s]) <= longest[s] / 2 + 1 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_sources(docs.repartition(5)).collect()))
    assert mixing.mix_sources(nothing).count() == 0
    assert [r.taken for r in mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", None)], "doc_id long, text string, source string")).collect()] == [0, 0]


def plain_flow(sizes, members, quota, repeats):
    """Total and cost of a cheapest maximum flow, a unit and one shortest path at a time."""
    arcs = {}  # (from, to) -> [capacity, cost]
    for p, n in enumerate(sizes):
        for k in range(1, repeats + 1):
            arcs["start", (p, k)] = [n, 0]
            arcs |= {((p, k), s): [n, k] for s in members[p]}
    arcs |= {(s, "end"): [q, 0] for s, q in enumerate(quota)}
    arcs |= {(b, a): [0, -w] for (a, b), (_, w) in list(arcs.items())}
    total = cost = 0
    while True:
        best, via = {"start": 0}, {}
        for _ in range(len(arcs)):
            shorter = [(a, b) for (a, b), (c, w) in arcs.items() if c and a in best and best[a] + w < best.get(b, 1e9)]
            if not shorter:
                break
            for a, b in shorter:
                if best[a] + arcs[a, b][1] < best.get(b, 1e9):
                    best[b], via[b] = best[a] + arcs[a, b][1], a
        if "end" not in best:
            return total, cost
        total, cost, at = total + 1, cost + best["end"], "end"
        while at != "start":
            arcs[via[at], at][0] -= 1
            arcs[at, via[at]][0] += 1
            at = via[at]


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_largest_and_cheapest(seed):
    rng = random.Random(seed)
    n_sources = rng.randint(1, 5)
    members = [sorted(rng.sample(range(n_sources), rng.randint(0 if i == 0 else 1, n_sources))) for i in range(rng.randint(1, 6))]
    sizes, quota = [rng.randint(0, 6) for _ in members], [rng.randint(0, 15) for _ in range(n_sources)]
    given = mixing.min_cost_flow(sizes, members, quota, 3)
    cost = sum(sum(k * min(max(g - (k - 1) * n, 0), n) for k in (1, 2, 3)) for g, n in zip(given, sizes))
    assert all(0 <= g <= 3 * n for g, n in zip(given, sizes)) and (sum(given), cost) == plain_flow(sizes, members, quota, 3)
    for chosen in range(1 << n_sources):  # the sources can share what the patterns give
        assert sum(g for g, m in zip(given, members) if set(m) <= {s for s in range(n_sources) if chosen >> s & 1}) <= sum(q for s, q in enumerate(quota) if chosen >> s & 1)


def test_overlapping_sources(spark):
    """Documents of two sources serve the one that lacks words."""
    rows = [(i, "w " * 10, ["a"]) for i in range(10)] + [(100 + i, "w " * 10, ["a", "b"]) for i in range(10)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, of array<string>"), F.col("of"), weights=(1, 1)).collect()
    assert sum(r.taken for r in got) == 200
    flow = mixing.allot({("a",): 100, ("a", "b"): 100}, {"a": 100, "b": 100}, 3)
    assert flow == {("a",): 100, ("a", "b"): 100}
    assert mixing.allot({("a",): 10}, {"a": 25}, 3) == {("a",): 25}


# 7


def test_tool_calls(spark):
    schemas = {"sum": {"a": ("BIGINT", True), "b": ("BIGINT", False)}}
    calls = [("k1", 1, "c1", "sum", '{"b": 2, "a":1}', []), ("k1", 2, "c2", "sum", '{"a": "x"}', ["c1"]), ("k1", 3, "c3", "sum", '{"a": 1, "z": 0}', ["c2", "c1"]), ("k1", 4, "c4", "none", "{}", ["c4"]), ("k1", 5, "c5", "sum", "not json", ["zzz"]), ("k1", 6, None, "sum", None, None)]
    results = [(2, "c1", "three"), (9, "c1", "later"), (3, "c2", 'quo"te'), (1, "zz", "orphan"), (1, None, "none")]
    got = {r.turn: r for r in tool_calls.link(spark.createDataFrame(calls, "conv_id string, turn int, call_id string, name string, arguments string, needs array<string>"), spark.createDataFrame(results, "turn int, call_id string, content string"), schemas).collect()}
    assert {t: r.level for t, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: None, 5: None, 6: None}
    assert {t: r.linked for t, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False}
    assert [t for t, r in got.items() if r.valid] == [1]
    assert got[1].record == '{"arguments":{"a":1,"b":2},"call_id":"c1","name":"sum","result":"three"}'
    assert json.loads(got[2].record)["result"] == 'quo"te' and "arguments" not in json.loads(got[5].record)


def test_conversations(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "user", None), (2, 0, "user", "x"), (None, 0, "user", "y"), (2, 7, "assistant", "z")]
    got = {(r.conv_id, r.turn): r for r in tool_calls.linked_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1, 1].level, got[1, 3].level, got[1, 1].linked, got[1, 3].valid) == (1, 2, True, False) and len(got) == 4
    assert tool_calls.linked_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 8


def test_lm(docs, texts, nothing, spark):
    train = [t for i, t in texts.items() if not lm_scoring.held_out(i)]
    model = lm_scoring.BackoffAutomaton(train)
    v = len(model.words)
    got = {r.doc_id: r for r in lm_scoring.score_documents(docs, block_bytes=3000).collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        tokens, r = [*lower(text), None], got[i]
        base = sum(math.log10((model.words[w] + 1) / (model.total + v + 1)) for w in tokens)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(model.words[w] > 0 for w in tokens), model.total)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(model.score(text), abs=1e-6)
    for state in list(model.arcs)[:40]:
        assert sum(model.step(state, w) for w in model.words) + model.step(state, b"never seen") == pytest.approx(1)
    assert {len(state) for state in model.arcs} == {0, 1, 2}
    assert lm_scoring.score_documents(nothing).count() == 0
    one = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, block_bytes=1 << 30).collect()}
    assert all(one[i] == pytest.approx(got[i].score, abs=1e-6) for i in one)
    assert lm_scoring.score_documents(spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")).count() == 3


def test_lm_beats_single_words_on_held_out_text(spark):
    rng = random.Random(4)
    follow = {w: [rng.choice(WORDS) for _ in range(2)] for w in WORDS}

    def chain(n):
        out = [rng.choice(WORDS)]
        while len(out) < n:
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    rows = [(i, chain(60)) for i in range(200)]
    got = [r for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) > 10 and sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


# 9


def test_quality_measures(docs, texts):
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, text in texts.items():
        t, w = text or "", words_of(text)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = {j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and (not r.base_failed or not r.kept)


def test_quality_keeps_good_rows_with_their_columns(docs, nothing):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, k in verdict.items() if k)
    assert not verdict[47] and not verdict[45] and verdict[1]
    assert quality.keep_good(nothing).count() == 0 and quality.judge(nothing).count() == 0


def test_expectation_maximisation_finds_the_classes():
    rng = random.Random(6)
    counts = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.85
        counts[tuple(0 if rng.random() < 0.2 else 1 if rng.random() < (0.95 if good else 0.4) else -1 for _ in range(6))] += 1
    model = quality.expectation_maximisation(sorted(counts.items()))
    assert 0.8 < model[0] < 0.9 and all(0.02 < g[0] < 0.06 and 0.4 < b[0] < 0.56 for g, b in zip(model[1], model[2]))
    assert quality.posterior((1,) * 6, model) > 0.95 and quality.posterior((-1, 1, 1, 1, 1, 1), model) > 0.5 > quality.posterior((-1, -1, -1, 1, 0, 0), model)
    assert quality.expectation_maximisation([])[0] == pytest.approx(0.5)


def brute_verdicts(texts):
    """Document by document: measures by regular expressions, votes, expectation-maximisation over documents."""
    cast, failed = {}, {}
    for i, text in texts.items():
        t, w = text or "", words_of(text)
        lines, chars = [x for x in t.split("\n") if words_of(x)], "".join(w)
        c = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        marked = len({j for k in range(len(w) - 4) if c[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)})
        failed[i] = len(w) < 10 or 100 * marked > 20 * len(w)
        share = lambda x, y: x / y if y else None
        x = [
            (len(w), 10, 20, None, None), (share(len(chars), len(w)), 3.0, 3.6, 7.0, 9.0), (share(len(re.findall(r"[#*$%&|<>]", t)), len(w)), None, 0, 0.05, 0.3),
            (share(len(lines) - len(set(lines)), len(lines)), None, 0, 0.1, 0.3), (share(marked, len(w)), None, 0, 0.1, 0.2), (share(len(set(w)), len(w) ** 0.5), 1.5, 3.0, None, None),
            (share(len(re.findall("[0-9]", t)), len(chars)), None, 0, 0.1, 0.3), (share(sum(ch.isalpha() for ch in t), len(chars)), 0.7, 0.9, None, None),
        ]
        cast[i] = [0 if v is None else -1 if (low is not None and v < low) or (high is not None and v > high) else int((a is None or v >= a) and (b is None or v <= b)) for v, low, a, b, high in x]
    used = [v for i, v in cast.items() if not failed[i]]
    weight = [0.7 ** sum(v) / (0.7 ** sum(v) + 0.3 ** sum(v)) for v in used]

    def judge(v, p, rate):
        a, b = p, 1 - p
        for j, x in enumerate(v):
            a, b = a * rate[0][j][x], b * rate[1][j][x]
        return a / (a + b)

    for _ in range(500):
        rate = []
        for ws, start in ((weight, {-1: 0.5, 0: 0.5, 1: 2.0}), ([1 - w for w in weight], {-1: 2.0, 0: 0.5, 1: 0.5})):
            rate.append([{x: (start[x] + sum(w for w, v in zip(ws, used) if v[j] == x)) / (3 + sum(ws)) for x in (-1, 0, 1)} for j in range(8)])
        p = (sum(weight) + 3) / (len(used) + 6)
        new = [judge(v, p, rate) for v in used]
        if max(map(lambda a, b: abs(a - b), new, weight)) < 1e-9:
            break
        weight = new
    return {i: not failed[i] and judge(v, p, rate) >= 0.5 for i, v in cast.items()}, {i: min(v) < 0 for i, v in cast.items()}, failed


@pytest.mark.parametrize("table", [None, "/root/testdata/sf0.001/documents.parquet", "/root/testdata/sf0.01/documents.parquet"])
def test_quality_verdicts(spark, docs, texts, table):
    if table and not os.path.exists(table):
        pytest.skip("no test tables here")
    rows = spark.read.parquet(table) if table else docs
    want, _, _ = brute_verdicts({r.doc_id: r.text for r in rows.select("doc_id", "text").collect()})
    got = {r.doc_id: r.kept for r in quality.judge(rows).select("doc_id", "kept").collect()}
    assert got == want


def test_the_posterior_decides(spark):
    """Documents with a bad vote are kept, and others without one are not."""
    table = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(table):
        pytest.skip("no test tables here")
    bad = F.least(*quality.votes().values()) < 0
    got = {(r.bad, r.kept) for r in quality.judge(spark.read.parquet(table)).where("not base_failed").select(bad.alias("bad"), "kept").distinct().collect()}
    assert got == {(True, True), (True, False), (False, True), (False, False)}


# 10


def brute_classes(texts, width=5):
    sets = {}
    for i, t in texts.items():
        w = lower(t)
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in texts}


def test_near_join(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_classes(docs).collect()}
    assert got == brute_classes(texts) and got[44][1] == 43 and got[32][1] == 30 and got[25][1] == 19


def test_near_join_finds_chains_and_borders(spark):
    """Sets that drift link by link, and pairs right at 0.8."""
    rng = random.Random(8)
    texts, words = {}, prose(rng, 80).split()
    for i in range(40):
        texts[i] = " ".join(words)
        words[rng.randrange(80)] = f"d{i}"
        if i % 4 == 0:
            words.append(f"e{i}")
    base = [f"w{i}" for i in range(13)]  # nine shingles; with one more word ten
    texts |= {50: " ".join(base), 51: " ".join([*base, "z1"]), 52: " ".join([*base, "z1", "z2"]), 53: " ".join([*base, "z3", "z4", "z5"])}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_join.near_classes(rows).collect()}
    assert got == brute_classes(texts)


def test_near_join_edges(spark, nothing):
    assert near_join.near_classes(nothing).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None), (2, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in near_join.near_classes(rows).collect())
    assert got == [(-1, 2, None), (1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3)]


def test_components_by_rounds(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 99), (7, 7)], "a long, b long")
    assert sorted(map(tuple, components(links, one_task=0).collect())) == sorted(map(tuple, components(links).collect()))


# all


BIG = [(1 << 60) + 1, (1 << 60) + 3, (1 << 53) + 1]


def test_ids_beyond_doubles_beside_a_null(spark):
    """Ids above 2 ** 53 in one batch with a null id come back exactly, and stay apart."""
    rng = random.Random(12)
    texts = [prose(rng, 60) for _ in range(4)]
    rows = [(BIG[0], texts[0], texts[0], "s"), (None, texts[1], texts[1], "s"), (BIG[1], texts[2], texts[2], "s"), (BIG[2], texts[3], texts[3], "s"), (BIG[1] + 1, texts[2], texts[2], "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, html string, source string").coalesce(1)
    want = sorted([*BIG, BIG[1] + 1, -1])
    pages = df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"), "html")
    found = {
        1: suffix_dedup.remove_repeats(df), 2: warc.round_trip(pages), 3: packing.pack(df, tokenizer_path()), 4: media.media_features(df), 5: html_text.main_texts(pages),
        6: mixing.mix_sources(df), 8: lm_scoring.score_documents(df), 9: quality.judge(df), 10: near_join.near_classes(df),
    }
    for op, out in found.items():
        name = "page_id" if op in (2, 5) else "doc_id"
        assert sorted(-1 if r[name] is None else r[name] for r in out.select(name).collect()) == want, op
    removed = {r.doc_id: r.n_removed for r in found[1].collect()}
    assert removed[BIG[1] + 1] == len(texts[2]) and not any(n for i, n in removed.items() if i != BIG[1] + 1)
    assert {r.page_id: r.refers_to for r in found[2].collect() if r.record_type == "revisit"} == {BIG[1] + 1: BIG[1]}
    assert {r.doc_id: r.component_id for r in found[10].collect()} == {None: None, BIG[0]: BIG[0], BIG[1]: BIG[1], BIG[2]: BIG[2], BIG[1] + 1: BIG[1]}


def test_very_long_texts(spark):
    """Texts of a megabyte beside short ones, against brute force where there is one."""
    rng = random.Random(13)
    passage = prose(rng, 50)
    long = " ".join(f"{rng.choice(WORDS)}{rng.randrange(1000)}" for _ in range(120_000)) + " " + passage
    texts = {1: long, 2: f"start {passage} end", 3: long.replace(" ", " x ", 50), 4: "short text"}
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string").repartition(2)
    want = suffix_dedup.brute_force({i: t.encode() for i, t in texts.items()})
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removal_report(df).collect()}
    assert got == want
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://h").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()} == {i: len(t) + 26 for i, t in texts.items()}
    assert {r.page_id: r.text for r in html_text.main_texts(pages).collect()} == texts
    assert {r.doc_id: r.payload_sha256 for r in media.media_features(df).collect()} == {i: hashlib.sha256(media.payload_of(t)[0]).hexdigest() for i, t in texts.items()}
    assert {r.doc_id: r.size for r in mixing.mix_sources(df).collect()} == {i: len(t.split()) for i, t in texts.items()}
    assert {r.doc_id: r.n_words for r in quality.judge(df).collect()} == {i: len(t.split()) for i, t in texts.items()}
    assert {r.doc_id: r.component_id for r in near_join.near_classes(df).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    model = lm_scoring.BackoffAutomaton([t for i, t in texts.items() if not lm_scoring.held_out(i)])
    assert {r.doc_id: r.score for r in lm_scoring.score_documents(df, 300_000).collect()} == pytest.approx({i: model.score(t) for i, t in texts.items()}, abs=1e-6)
    pieces = packing.pack(df, tokenizer_path()).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("length").alias("ids")).collect()
    assert all(r.n == -(-r.ids // 2048) for r in pieces) and {r.doc_id for r in pieces} == set(texts)


def test_mixing_fills_with_one_of_repeated_rows(spark):
    rows = [(i, "w " * 7, "a") for i in range(9)] + [(50, "w " * 2, "a")] * 4 + [(100 + i, "w " * 11, "b") for i in range(9)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 1)).collect()
    for s in (range(100), range(100, 200)):
        part = [r for r in got if r.doc_id in s]
        assert abs(sum(r.taken for r in part) - part[0].target) <= 11


def test_words_in_classes_keep_article_text(spark):
    """Words of the list in an element's class drop it only where they say what the element is."""
    text = "long text " * 30
    kept = "<section class='related-work'><p>work</p></section><p class='share-price'>price</p><div id='search-algorithms'>search</div>"
    gone = "<div class='share-buttons'>Share</div><div class='related-posts'>More</div><ul id='comment-list'><li>Hm</ul><div class='notice'>Note</div>"
    rows = [(1, "http://h/", f"<body><article><p>{text}</p>{kept}{gone}</article></body>")]
    got = html_text.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).first().text
    assert got == f"{text.strip()}\nwork\nprice\nsearch"


def test_html_paths_of_many_hosts(spark, monkeypatch):
    """Beyond the broadcast, a host's path meets its pages in parts, with the same texts."""
    rows = [(i, f"http://h{i % 3}/{i}", f"<body><div class='m{i % 3}'><p>{'text ' * (5 + i)}</p></div><div class='x'><p>few</p></div></body>") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in html_text.main_texts(pages).collect()}
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", 0)
    assert {r.page_id: r.text for r in html_text.main_texts(pages).collect()} == want and len(want) == 40


def test_packing_ranks_by_salts(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    rows = packing.pack(docs, tokenizer_path(), capacity=64).collect()
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for parts in seqs.values():
        ends = [0, *(o + n for o, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 64


def test_tool_calls_of_many_levels(spark):
    calls = spark.createDataFrame([(f"c{i}", [f"c{i - 1}"] if i else []) for i in range(18)], "call_id string, needs array<string>")
    assert {r.call_id: r.level for r in tool_calls.levels(calls).collect()} == {f"c{i}": i + 1 for i in range(18)}
