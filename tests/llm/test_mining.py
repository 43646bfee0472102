"""Hard negatives, collocations and the URL filter against brute force, and on awkward tables."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tidegauge.llm import collocations, hard_negatives, queries, urls

VECTORS = "vec_id long, label int, embedding array<float>"


def negatives_by_hand(rows, is_anchor, positives=5, negatives=3):
    rows = [(i, label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, label, v in rows if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = set()
    anchors = {}
    for i, label, v in rows:
        if is_anchor(i):
            anchors[i] = min(anchors.get(i, (label, v)), (label, v))
    for i, (label, v) in anchors.items():
        others = {(-dot(v, w), j, m) for j, m, w in rows if j != i}
        best = sorted({(s, j) for s, j, m in others if m == label})[:positives]
        for s, j in best:
            window = sorted({(t, k) for t, k, m in others if m != label and 50 * -s <= 100 * -t <= 95 * -s})[:negatives]
            out |= {(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(window, 1)}
    return out


def vectors(seed, n, d=12, labels=4):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, 0.4) for _ in range(d)] for _ in range(labels)]
    return [(i, i % labels, [c + draw.gauss(0, 0.25) for c in centres[i % labels]]) for i in range(n)]


@pytest.mark.parametrize("slot_rows,group", [(4096, 4096), (60, 7)])
def test_hard_negatives_equal_brute_force(spark, slot_rows, group):
    rows = vectors(3, 400)
    rows += [(1000 + i, 1, rows[8][2]) for i in range(40)]  # ties: copies of one vector
    rows += [(None, 1, rows[0][2]), (2000, None, rows[0][2]), (2001, 1, None), (2002, 1, [1.0, None]), (2003, 1, [float("nan")] * 12), (2004, 1, [float("inf")] + [0.0] * 11), (2005, 2, []), rows[20], rows[33]]
    frame = spark.createDataFrame(rows, VECTORS + "").repartition(5)
    got = hard_negatives.mine(frame, F.col("id") % 10 == 0, "vec_id", "label", "embedding", slot_rows=slot_rows, group_anchors=group).collect()
    assert len(got) > 300
    assert {tuple(r) for r in got} == negatives_by_hand(rows, lambda i: i % 10 == 0) and len(got) == len(set(got))


def test_inverted_index_finds_every_pair():
    draw = np.random.default_rng(2)
    rows, anchors = np.floor(draw.normal(0, 60, (700, 20))), np.floor(draw.normal(0, 60, (30, 20)))
    full = anchors @ rows.T
    for least in (-np.inf, 0.0, 20_000.0, 60_000.0, 1e9):
        a, r, s = hard_negatives.reaching(rows, anchors, np.full(30, least))
        assert set(zip(a.tolist(), r.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full >= least))))
        assert (s == full[a, r]).all()
    index = hard_negatives.Index(rows, anchors, 20_000.0)
    assert index.indexed.mean() < 20  # the bounds leave dimensions out


def test_scores_beyond_doubles_are_exact():
    rows, anchors = np.array([[2.0**30 + 1, 3.0], [2.0**30, 5.0]]), np.array([[2.0**30 + 1, 1.0]])
    _, _, s = hard_negatives.reaching(rows, anchors, np.array([-np.inf]))
    assert s.tolist() == [(2**30 + 1) ** 2 + 3, 2**30 * (2**30 + 1) + 5]


def test_hard_negatives_of_awkward_tables(spark):
    mine = lambda rows, schema=VECTORS: hard_negatives.mine(spark.createDataFrame(rows, schema), F.col("id") % 2 == 0, "vec_id", "label", "embedding").collect()
    assert mine([]) == []
    assert mine([(0, 1, [1.0]), (2, 1, [1.0])]) == []  # no other label
    assert mine([(0, 1, []), (2, 1, []), (3, 2, [])]) != []  # empty vectors score 0, and 0 lies in the window of 0
    clash = mine([(0, 1, [1.0], 5, 6, "x"), (2, 1, [1.0], 5, 6, "x"), (3, 2, [0.75], 5, 6, "x")], VECTORS + ", id long, slot int, positives string")
    assert {tuple(r) for r in clash} == {(0, 2, 1, 3, 65536, 49152), (2, 0, 1, 3, 65536, 49152)}


STOP = re.compile(r"[.,;:!?\x0A-\x0D]")
WORDS = re.compile(r"[^\x20\x09]+")


def phrases_by_hand(rows, least, most):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in STOP.split(low):
            words = WORDS.findall(piece)
            n[lang] += len(words)
            for m in range(1, 6):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    wanted = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, g), a in wanted.items():
        for m in range(2, len(g)):
            for i in range(len(g) - m + 1):
                if 100 * a >= 100 * f[lang, g[i : i + m]]:
                    gone.add((lang, g[i : i + m]))
    out = defaultdict(list)
    for (lang, g), a in wanted.items():
        if (lang, g) in gone:
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, held in out.items() for r, x in enumerate(sorted(held)[:most], 1)}


def prose(seed, n):
    draw = random.Random(seed)
    vocabulary = [draw.choice("abcdéñ") * draw.randint(1, 2) + str(i) for i in range(40)]
    weights = [1 / (i + 1) for i in range(40)]
    out = []
    for i in range(n):
        words = draw.choices(vocabulary, weights, k=draw.randint(0, 60))
        for _ in range(draw.randint(0, 4)):
            at = draw.randint(0, len(words))
            words[at:at] = draw.choice(["Zq zw", "zq zw zx", "one Two three four five six", "zq"]).split(" ")
        out.append(("".join(w + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for w in words), draw.choice(["en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_collocations_equal_brute_force(spark, small):
    rows = prose(6, 300) + [(None, "en"), ("", None), (" \t\n", "en"), ("!!!", "de"), ("alone", "fr")]
    sizes = {"range_runs": 500, "shard_words": 700, "page_runs": 40, "unite_runs": 300, "bits": 64, "ranked": 10} if small else {}
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    got = {tuple(r) for r in collocations.mine(frame, least=6, most=40, **sizes).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    want = phrases_by_hand(rows, 6, 40)
    assert len(want) > 60 and got == want


def test_collocations_of_awkward_tables(spark):
    assert collocations.mine(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
    long = " ".join(f"w{i % 7} x{i % 3}" for i in range(300_000)) + "y" * 100_000
    frame = spark.createDataFrame([(long, "en", 1, "a", 2), (long, "en", 1, "a", 2)], "text string, lang string, n long, word string, h long")
    got = {tuple(r) for r in collocations.mine(frame, most=5).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()}
    assert got == phrases_by_hand([(long, "en")] * 2, 100, 5)


def test_automata_keep_their_runs():
    draw = np.random.default_rng(4)
    ids = draw.integers(1, 9, (5000, 5)).astype(np.uint64)
    ids = np.where(ids > 5, ids * np.uint64(0x9E3779B97F4A7C15) | collocations.HASHED, ids)
    cut = draw.integers(2, 6, 5000)
    ids[np.arange(5)[None, :] >= cut[:, None]] = 0
    weights = draw.integers(1, 400, 5000)
    runs = collocations.Runs.united(ids, weights)
    want = Counter()
    for row, w in zip(map(tuple, ids.tolist()), weights.tolist()):
        want[row] += w
    hashes, back = collocations.unpack(collocations.pack(runs))
    assert {tuple(r): w for r, w in zip(hashes.tolist(), back.tolist())} == dict(want)
    rows = sorted(want)
    for bound in [rows[0], rows[1234], rows[-1], (5, 5, 5, 5, 5), (2**64 - 1,) * 5, (rows[700][0], 1, 0, 0, 0)]:
        assert runs.before(np.array(bound, np.uint64)) == sum(r < tuple(bound) for r in rows)


def test_joined_runs_equal_those_united_at_once_and_hold_little():
    draw = np.random.default_rng(8)
    n = 1 << 18
    codes = draw.integers(1, 50_000, (n, 5)).astype(np.uint64)
    codes[codes > 40_000] |= collocations.HASHED
    codes[draw.random(n) < 0.3, 3:] = 0
    codes[n // 2 :: 3] = codes[: len(codes[n // 2 :: 3])]
    weights = draw.integers(1, 400, n)
    tracemalloc.start()
    whole = collocations.Runs.united(codes, weights)
    united = tracemalloc.get_traced_memory()[1] / n
    parts = [collocations.Runs.united(codes[at : at + 20_000], weights[at : at + 20_000]) for at in range(0, n, 20_000)]
    del whole
    tracemalloc.reset_peak()
    joined = collocations.Runs.joined(parts)
    most = tracemalloc.get_traced_memory()[1] / n
    tracemalloc.stop()
    assert united < 140 and most < 140  # bytes a run
    whole = collocations.Runs.united(codes, weights)
    assert not parts and (joined.words[joined.ids] == whole.words[whole.ids]).all() and (joined.weights == whole.weights).all()
    rest = joined.slice(1000, 3000).own()
    assert (rest.words[rest.ids] == joined.words[joined.ids[1000:3000]]).all() and len(rest.words) <= 2000 * 5 + 1


def test_words_of_a_shard_are_counted_in_parts():
    draw = random.Random(6)
    texts = [" ".join(f"w{draw.randrange(20_000)}" for _ in range(1000)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 1000), pa.array(texts)], ["lang", "text"])
    list(collocations._words_of(batch.slice(0, 10)))
    tracemalloc.start()
    found = list(collocations._words_of(batch))
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
    assert len(found) == 1  # a shard's words once each
    got = {(r["lang"], r["word"]): r["n"] for r in found[0].to_pylist()}
    assert got == Counter((("en", "de")[i % 2], w) for i, t in enumerate(texts) for w in t.split())


RULES = queries.URL_RULES


def judged_by_hand(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best and best[3]


def test_url_rules_equal_brute_force(spark):
    hosts = ["net", "a.net", "Example.NET", "www.example.net", "badexample.net", "example.com", "x.EXAMPLE.com", "org", "a.b.org", "norg", "com", "", "é.org", "." * 300 + "net", "a.net:80"]
    paths = ["", "/", "/en", "/en/", "/en/a/b?x=/de/", "/de/1#y", "/fr/é", "?q=://a.net/", "#z", "/EN/", "//en/"]
    given = [f"{s}://{h}{p}" for s, h, p in itertools.product(["http", "", "a://b"], hosts, paths)] + [None, "", "example.net/en/", "://", "http:/x", "x" * 20_000, "http://" + "a." * 5000 + "net/" + "b/" * 5000]
    rows = [(i, u, "kept") for i, u in enumerate(given * 2)]
    rules = [*RULES, ("allow", "b.org", "/"), ("block", "org", "/en/a/"), ("block", "é.org", "/")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3), rules).collect()
    assert len(got) == len(rows)
    for r in got:
        host, path, rule, verdict = judged_by_hand(r.page.url, rules)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.page.host == "kept"
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")


def test_url_trees_learn_from_labelled_urls(spark):
    draw = random.Random(1)
    word = lambda n: "".join(draw.choice("abcdefghijklmnop") for _ in range(n))
    good = [f"https://{word(6)}.site{draw.randint(0, 5)}.org/{word(5)}/{word(7)}" for _ in range(500)]
    bad = [f"http://{word(4)}-{draw.randint(10**6, 10**9)}.{word(3)}.biz/{draw.randint(10**6, 10**9)}?a={word(9)}&b={draw.randint(0, 10**9)}&c=1" for _ in range(500)]
    labelled = spark.createDataFrame([(u, 0) for u in good[:350]] + [(u, 1) for u in bad[:350]], "url string, blocked int")
    pages = spark.createDataFrame([(u, False) for u in good[350:]] + [(u, True) for u in bad[350:]], "url string, bad boolean")
    got = urls.judge(pages, [], labelled=labelled).collect()
    assert sum((r.verdict == "block") == r.page.bad for r in got) >= 0.97 * len(got)


def test_url_verdicts_without_anything_to_learn(spark):
    one = spark.createDataFrame([("http://a.example.com/",), (None,)], "url string")
    assert {(r.host, r.verdict) for r in urls.judge(one, RULES).collect()} == {("a.example.com", "allow"), ("", "allow")}
    assert urls.judge(one.limit(0), RULES).collect() == []
    same = spark.createDataFrame([("http://a.net/",), ("http://b.org/x",)], "url string")
    assert {r.verdict for r in urls.judge(same, RULES).collect()} == {"block"}  # labels of one kind


def test_url_entropy(spark):
    text = "http://aab.org/x?q=é%20"
    counts = Counter("http://aab.org/x?q=\0%20")
    want = -sum(c / len(text) * math.log2(c / len(text)) for c in counts.values())
    assert spark.range(1).select(urls._entropy(F.lit(text))).first()[0] == pytest.approx(want)
