"""Personal data beyond the exact shapes, columns with clashing names, and the pipeline stage by stage."""

import random
import re
import time
from collections import Counter

import pytest

import corpus_pipeline
from tidegauge.llm import decontaminate, jaccard_join, licenses, mixing, pii, toxicity
from tests.llm.test_operators import DOC, corpus, frame

CLASHING = DOC + ", row long, spans string, doc string, text_ string, score double, mix_key string, mix_size long, mix_hash long, mix_row string, jaccard_row string, jaccard_doc string, jaccard_text string, pii_row long, pii_spans string, id long, key string, size long, copies long, target double"


def clashing(spark, texts):
    names = CLASHING.split(", ")[5:]
    extra = [f"x{i}" if n.endswith("string") else float(i) if n.endswith("double") else i for i, n in enumerate(names)]
    return spark.createDataFrame([(i, t, "en", "s", len(t), *extra) for i, t in enumerate(texts)], CLASHING).repartition(3), tuple(extra)


@pytest.mark.parametrize("stage", ["mix", "keep_one", "redact", "decontaminate", "toxicity"])
def test_clashing_columns_come_back_as_they_were(spark, stage):
    texts = ["the quick brown fox jumps over it again and again today", "mail me at jo.81@mail7.example.com now", "another text of some words", "the quick brown fox jumps over it again and again today"]
    docs, extra = clashing(spark, texts)
    benchmark = spark.createDataFrame([(1, "nothing of the kind stands in any of these ten word texts")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "doc_id long, toxic int")
    done = {
        "mix": lambda: mixing.mix(docs), "keep_one": lambda: jaccard_join.keep_one(docs), "redact": lambda: pii.redact(docs, length_col="n_chars"),
        "decontaminate": lambda: decontaminate.remove(docs, benchmark), "toxicity": lambda: toxicity.remove(docs, labels, limit=1.1),
    }[stage]()
    assert done.columns == docs.columns
    rows = done.collect()
    assert rows and all(tuple(r)[5:] == extra and tuple(r)[2:4] == ("en", "s") for r in rows)
    if stage == "redact":
        assert {r.doc_id: (r.text, r.n_chars) for r in rows}[1] == ("mail me at [EMAIL] now", 22)
    elif stage != "keep_one":
        assert {(r.doc_id, r.text) for r in rows} <= set(enumerate(texts))
    else:
        assert sorted(r.doc_id for r in rows) == [0, 1, 2]


def test_long_numbers_are_read_once():
    began = time.perf_counter()
    text = "7" * 400_000 + " " + "1." * 100_000 + " 10.0.0.300 10.20.30.40 " + "+1" + " " * 100_000
    found = pii.base_spans(text)
    assert time.perf_counter() - began < 5
    assert [text[s:e] for s, k, e in found if k == 1][-1] == "10.20.30.40"


@pytest.mark.parametrize("seed", range(40))
def test_addresses_of_hosts_equal_the_plain_pattern(seed):
    draw = random.Random(seed)
    text = "".join(draw.choice("0123456789.. a") for _ in range(300))
    plain = [m for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    assert [(s, e) for s, k, e in pii.base_spans(text) if k == 1] == [m.span() for m in plain]


def test_counts_are_by_kind(spark):
    texts = ["a@b.c", "a@b.c 1.2.3.4 5.6.7.8", "4111 1111 1111 1111", "+49 30 1234567 and +1 (555) 123-4567 and x@y.z", "", None]
    got = {r.doc_id: r for r in pii.report(frame(spark, texts)).collect()}
    counts = [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in range(6)]
    assert counts == [(1, 0, 0, 0), (1, 2, 0, 0), (0, 0, 1, 0), (1, 0, 0, 2), (0, 0, 0, 0), (0, 0, 0, 0)]


def test_loose_spans_are_found(spark):
    """Planted: written-out addresses, announced numbers and assigned secrets, beside prose that only looks like them."""
    draw = random.Random(2)
    word = lambda n: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    number = lambda: f"{draw.randint(200, 999)} {draw.randint(200, 999)} {draw.randint(1000, 9999)}"
    texts, planted = [], []
    for i in range(600):
        kind = i % 6
        item = [f"{word(5)} (at) {word(7)} (dot) com", number(), f"{word(4)}{draw.randint(10**7, 10**9)}{word(5)}", None, None, None][kind]
        before = ["write to ", "call ", draw.choice(["password = ", "api_key: ", 'token = "']), f"we met @ home. Then {word(4)} left ", f"in {draw.randint(1900, 2020)} {draw.randint(100, 900)} {draw.randint(1000, 9000)} ", f"key: {word(9)} "][kind]
        texts.append(f"{word(6)} {word(4)} {before}{item or ''} {word(5)} {word(7)}")
        planted.append(item)
    got = {r.doc_id: r.spans for r in pii.report(frame(spark, texts)).collect()}
    caught = Counter()
    for i, (text, item) in enumerate(zip(texts, planted)):
        spans = [s.split(":") for s in got[i].split(",") if s]
        found = [text[int(a) : int(b)] for _, a, b in spans]
        caught[i % 6] += item in found if item else bool(found)
    assert all(caught[k] >= 90 for k in (0, 1, 2)) and all(caught[k] <= 3 for k in (3, 4, 5))


def test_pipeline_stage_by_stage(spark, tmp_path):
    """What every stage keeps, against plain computations on a small corpus."""
    draw = random.Random(3)
    texts = corpus(n=60)
    toxic = [i for i in range(60, 160) if i % 4 == 0]
    plain = ["".join(draw.choice(["th", "er", "on", "an", "re", "st"]) for _ in range(3)) for _ in range(300)]
    for i in range(60, 160):
        words = [draw.choice(plain) for _ in range(80)]
        for _ in range(8 if i in toxic else 0):
            words[draw.randrange(80)] = draw.choice(["worthless", "disgusting", "scum"])
        texts.append(" ".join(words))
    item = " ".join(draw.choice(plain) for _ in range(14))
    texts += [f"{' '.join(draw.choice(plain) for _ in range(20))} {item}", "write to jo.81@mail7.example.com " + " ".join(draw.choice(plain) for _ in range(20)), "", None]
    folder = str(tmp_path)
    frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic)) for i in range(60, 160)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: {i for i, _ in rows} for name, rows in seen.items()}
    assert len(ids["toxicity"] & set(toxic)) <= 3 and len(ids["toxicity"]) >= len(texts) - len(toxic) - 3
    # near copies by hand
    kept = sorted(ids["toxicity"])
    words = {i: (texts[i] or "").split() for i in kept}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1))} if w else set() for i, w in words.items()}
    root = {i: i for i in kept}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in kept:
        for b in kept:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    assert ids["near_duplicates"] == {top(i) for i in kept}
    assert ids["benchmark_decontamination"] == ids["near_duplicates"] - {160}
    masked = dict(seen["personal_data"])
    assert set(masked) == ids["benchmark_decontamination"] and masked[161].startswith("write to [EMAIL] ")
    assert all(masked[i] == texts[i] for i in masked if i != 161)
    taken = Counter(i for i, _ in seen["source_mix"])
    assert set(taken) <= set(masked) and max(taken.values()) <= 3
    sizes, took = Counter(), Counter()
    for i, t in masked.items():
        sizes[i % 3] += len((t or "").split())
        took[i % 3] += taken[i] * len((t or "").split())
    total = sum(sizes.values())
    assert all(abs(took[s] - min(3 * sizes[s], total * (s + 1) / 6)) < 0.1 * total for s in sizes)


def covered_by_hand(words, template, slack=3, cover=0.8):
    """Most of a template's three-word runs within a stretch of the text of about its length."""
    runs = {" ".join(template[i : i + 3]): i for i in range(len(template) - 2)}
    best, size = 0, len(template) + 2 * slack
    for at in range(max(len(words) - 2, 0)):
        seen = {runs[g] for g in (" ".join(words[j : j + 3]) for j in range(at, min(at + size, len(words)) - 2)) if g in runs}
        best = max(best, len(seen))
    return best / len(runs)


def test_license_labels_of_planted_notices(spark):
    """Whole notices and notices with a changed, missing or added word, in prose; a notice that differs in a word gets its own label only."""
    draw = random.Random(9)
    prose = lambda n: [draw.choice(["alpha", "beta", "gamma", "delta", "of", "the", "a"]) for _ in range(n)]
    texts, want = [], []
    for label, text in licenses.TEMPLATES:
        for edit in (None, "change", "drop", "add"):
            words = text.split()
            if edit and len(words) < 15:
                continue
            at = len(words) // 2
            words[at : at + (edit in ("change", "drop"))] = [] if edit in (None, "drop") and edit else ["word"] if edit else words[at:at]
            texts.append(" ".join([*prose(30), *words, *prose(30)]))
            want.append(label)
    texts += [" ".join(prose(200)), "cc by nc " * 500, "under the mit license and apache license version 2", ""]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, label in enumerate(want):
        # what a shorter notice within says may stand beside it only under its own words
        assert label in got[i].labels.split(","), (texts[i], got[i].labels)
        others = set(got[i].labels.split(",")) - {label}
        assert all(any(covered_by_hand(texts[i].split(), t.split()) >= 0.8 for name, t in (*licenses.TEMPLATES, *licenses.PHRASES) if name == o) for o in others)
    n = len(want)
    assert got[n].labels == "" and got[n].score < 0.8
    assert (got[n + 1].n_base, got[n + 1].base_labels, got[n + 1].first_word, got[n + 1].last_word) == (500, "cc-by-nc", 0, 1497)
    assert got[n + 2].base_labels == "apache-2,mit" and (got[n + 3].labels, got[n + 3].n_words) == ("", 0)


def test_a_lesser_license_is_not_the_general_one(spark):
    text = "this library is free software you can redistribute it and or modify it under the terms of the GNU Lesser General Public License as published"
    plain = text.replace("Lesser ", "").replace("library", "program")
    got = {r.doc_id: r.labels for r in licenses.scan(frame(spark, [text, plain, text + " . " + plain])).collect()}
    assert got == {0: "lgpl", 1: "gpl", 2: "gpl,lgpl"}
