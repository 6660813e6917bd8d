"""Operators over whole tables: near-duplicates, leaks, search, url rules, classifiers, the pipeline."""

import itertools
import math
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bagminhash, decontam, quality, queries, topk, toxicity, urlrules
from lorekeep.llm.components import components
from tests.conftest import SMALL
from tests.oracle import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SMALL), connect(SMALL), queries.oracle_sql()[name])


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(20):
        keys = rng.integers(0, 2**63, 200).astype(np.uint64)
        a = rng.integers(0, 9, 200)
        b = np.maximum(0, a + rng.integers(-1, 2, 200))
        text = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        sig = bagminhash.signatures(text, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        errors.append((sig[0] == sig[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


def test_overlaps_and_forest_equal_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**60, 60)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.8], rng.integers(0, 2**60, 9)])) for _ in range(40)]
    shared = bagminhash.overlaps(sets)
    for i, j in itertools.product(range(40), repeat=2):
        assert shared[i, j] == len(np.intersect1d(sets[i], sets[j]))
    assert (bagminhash.overlaps(sets, 13) == shared[:13, 13:]).all()
    linked = shared >= 40
    links = bagminhash.forest(linked, np.arange(40))
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        assert linked[i, j]
        root[max(find(i), find(j))] = min(find(i), find(j))
    for i, j in zip(*np.nonzero(linked)):
        assert find(i) == find(j)


def brute_classes(texts: dict) -> dict:
    """Class and number of linked other multisets of each document."""
    bags = {}
    for d, t in texts.items():
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        bags[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    root, links = {d: d for d in texts}, {d: set() for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(texts, 2):
        small, large = sorted((bags[a], bags[b]), key=len)
        shared = sum(min(n, large[k]) for k, n in small.items())
        if shared and shared >= 0.8 * (sum(small.values()) + sum(large.values()) - shared) - 1e-9:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
            if bags[a] != bags[b]:
                links[a].add(frozenset(bags[b].items()))
                links[b].add(frozenset(bags[a].items()))
    return {d: (find(d), len(links[d])) for d in texts}


@pytest.mark.parametrize("block", [384, 7])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(bagminhash, "BLOCK", block)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(500)]
    base = list(rng.choice(words, 120))
    copies = []
    for i in range(60):  # a group whose members differ in 0 to 6 words, larger than a small bucket
        own = list(base)
        for p in rng.integers(0, 120, i % 7):
            own[p] = f"x{i}_{p}"
        copies.append((100_000 + i, " ".join(own)))
    extra = [(200_000, "same short"), (200_001, "Same, SHORT"), (200_002, ""), (200_003, None), (200_004, "a " * 300), (200_005, "a " * 310)]
    extra += [(200_006, " ".join(f"l{i}" for i in range(60_000))), (200_007, " ".join(f"l{i}" for i in range(58_000)))]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(copies + extra, "doc_id long, text string"))
    both = both.withColumn("class_id", F.lit("clash")).withColumn("n_links", F.lit("clash"))
    got = {r.doc_id: (r.class_id, r.n_links) for r in bagminhash.near_duplicates(both).collect()}
    want = brute_classes({r.doc_id: r.text for r in both.collect()})
    assert got == want
    assert sum(n for _, n in got.values()) > 100
    plain = bagminhash.near_duplicates(both, count_links=False).collect()
    assert {r.doc_id: r.class_id for r in plain} == {d: c for d, (c, _) in want.items()} and {r.n_links for r in plain} == {None}


def test_near_duplicates_of_repeated_and_null_rows(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (None, "one two three four five six"), (None, "other words"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.class_id or -1) for r in bagminhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 1), (1, 1), (1, 1), (2, 2)]
    assert bagminhash.near_duplicates(df.where("false")).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(bytes([i]), bytes([i + 1])) for i in range(1, 40)] + [(b"\x90", bytes([0x91 + i])) for i in range(20)]
    df = spark.createDataFrame(links, "a binary, b binary")
    root = {bytes(r.node): bytes(r.root) for r in components(df).collect()}
    assert all(root[bytes([i])] == b"\x01" for i in range(2, 41)) and all(root[bytes([0x91 + i])] == b"\x90" for i in range(20))


@pytest.mark.parametrize("width", range(1, 16))
def test_masks_hit_every_window_with_its_substitutions(width):
    _, need = decontam.needed(width)
    assert need == -(-4 * width // 5)
    for bad in itertools.combinations(range(width), width - need):
        assert any(
            all(at + i not in bad for i, c in enumerate(m) if c == "1")
            for m in decontam.masks_of(width)
            for at in range(width - len(m) + 1)
        )


def brute_leak(item: list, text: list) -> bool:
    """A window of 15 words of the item, or all of it, of which four fifths stand in the text at one offset."""
    width = min(15, len(item))
    if not width or len(text) < width:
        return False
    same = np.array(item)[:, None] == np.array(text)[None, :]
    rows, columns = len(item) - width + 1, len(text) - width + 1
    return bool((5 * sum(same[i : i + rows, i : i + columns].astype(int) for i in range(width)) >= 4 * width).any())


def test_leaks_of_items_of_all_lengths_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [[f"w{rng.integers(40)}" for _ in range(n)] for n in range(0, 41)]
    texts = []
    for item in items:
        for bad in range(0, 9):
            own = list(item)
            for p in rng.permutation(len(own))[:bad]:
                own[p] = f"s{rng.integers(5)}"
            texts.append([f"w{rng.integers(40)}" for _ in range(rng.integers(9))] + own + ["w1"] * int(rng.integers(4)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    for r in decontam.decontaminate(docs, bench).collect():
        assert {x.item_id for x in r.leaks} == {i for i, item in enumerate(items) if brute_leak(item, texts[r.doc_id])}


def test_repeated_words_cost_linear_work():
    started = time.perf_counter()
    for period, n_item, n_text in ((1, 5000, 20_000), (2, 5000, 20_000), (7, 5000, 20_000)):
        words = lambda n: bagminhash._mix(np.arange(n, dtype=np.uint64) % np.uint64(period) + np.uint64(5))  # noqa: B023, E731
        index, text = decontam.SeedIndex([words(n_item)]), words(n_text)
        hits = index.hits(text, np.array([0]))
        assert len(hits) <= 3 * (n_item + n_text)
        assert [x[1:] for x in index.leaks(0, hits[:, 2].tolist(), text)][0] == (n_item, n_item)
    assert time.perf_counter() - started < 20


def test_leaks_of_repeated_rows_and_texts(spark):
    line = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(1, line), (1, line), (2, line), (3, "la la la la la la")], "item_id long, text string")
    docs = spark.createDataFrame([(7, f"{line} and {line}"), (7, f"{line} and {line}"), (8, "la " * 30_000)], "doc_id long, text string")
    out = sorted((r.doc_id, [(x.item_id, x.first_word, x.n_words) for x in r.leaks]) for r in decontam.decontaminate(docs, bench).collect())
    twice = [(1, 0, 20), (1, 21, 20), (2, 0, 20), (2, 21, 20)]
    assert out[:2] == [(7, twice), (7, twice)] and out[2][0] == 8
    assert [x for x in out[2][1]] == [(3, 6 * i, 6) for i in range(5000)]


def test_leaks_survive_substitutions_and_clean_texts_pass(spark):
    rng = np.random.default_rng(2)
    item = [f"b{i}" for i in range(30)]
    filler = lambda n: [f"f{rng.integers(1e9)}" for _ in range(n)]
    docs, want = [], {}
    for d in range(40):
        own = list(item)
        bad = d % 8
        for p in rng.choice(30, bad, replace=False):
            own[p] = f"s{p}"
        same = [own[i] == item[i] for i in range(30)]
        want[d] = any(sum(same[i : i + 15]) >= 12 for i in range(16))
        docs.append((d, " ".join(filler(d) + own + filler(7)), "c"))
    docs += [(100, None, None), (101, "", "c"), (102, "b0 b1 b2 b3", "c"), (103, "x short item y", "c"), (104, "one two three FOUR other six", "c"), (None, " ".join(item), "c")]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "Short item!"), (3, ""), (None, None), (5, "one two three four five six")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string, leaks string")
    out = {r.doc_id: r for r in decontam.decontaminate(df, bench).collect()}
    assert {d: out[d].contaminated for d in want} == want
    assert [out[d].contaminated for d in (100, 101, 102, 103, 104, None)] == [False, False, False, True, True, True]
    assert [tuple(x) for x in out[0].leaks] == [(1, 0, 30, 30)]
    assert decontam.decontaminate(df, bench.where("false")).where("contaminated").count() == 0
    assert decontam.decontaminate(df.where("false"), bench).count() == 0


def test_leaks_do_not_depend_on_benchmark_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(str, decontam.decontaminate(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 400)
    assert sorted(map(str, decontam.decontaminate(docs, bench).collect())) == once


def test_top_k_edge_cases(spark):
    rows = [(i, [i % 3, -i % 5, 7]) for i in range(60)] + [(100, None), (101, []), (None, [1, 1, 1]), (3, [0, 2, 7]), (102, [1, None, 2]), (103, [1])]
    rows += [(20, [2, 0, 7])] * 2 + [(20, [5, 5, 5]), (40, [9, 9, 9])] + [(104, [8, 8, 8])] * 9  # repeated rows, one of them a query's
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, vector array<long>, score string")
    out = topk.top_k(df, df.where("id % 20 = 0 or id = 103"), k=7).collect()
    clean = [(i, tuple(v)) for i, v in rows if i is not None and v and None not in v]
    want = []
    for at, (q, v) in enumerate(clean):
        if q % 20 and q != 103:
            continue
        score = lambda a: sum(x * y for x, y in zip(v, a))  # noqa: B023, E731
        best = sorted((-score(a), i) for other, (i, a) in enumerate(clean) if other != at)[:7]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0
    assert topk.top_k(df, df.where("false")).count() == 0 and topk.top_k(df.where("false"), df).count() == 0


@pytest.mark.parametrize("large", [1e9, 3e15, 1e300])
def test_top_k_of_large_null_and_non_finite_components(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "RESCORE", 8)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(0, 1, 6).tolist()) for i in range(120)]
    rows[7] = (7, [large, 1.0, 0.0, 0.0, 0.0, 0.5])
    rows[20] = (20, [large, -large, 1.0, 2.0, 3.0, 4.0])
    rows[33] = (33, [large, 1.0, 0.0, 0.0, 0.0, 0.25])
    rows += [(200, [float("nan")] + [0.0] * 5), (201, [float("inf")] + [1.0] * 5), (202, [None] + [1.0] * 5), (203, None), (204, []), (205, [-float("inf")] * 6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").select("id", topk.quantised("embedding").alias("vector"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("id % 20 = 0"), k=5).collect()}
    ints = {i: [max(min(math.floor(64 * x) if math.isfinite(64 * x) else 2**63 if x > 0 else -(2**63), 2**63 - 1), -(2**63)) for x in v] for i, v in rows[:120]}
    want = {}
    for q in range(0, 120, 20):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:5]
        want |= {(q, n): (i, max(min(-s, 2**63 - 1), -(2**63))) for n, (s, i) in enumerate(scores, 1)}
    assert got == want


def index_of(vectors: np.ndarray) -> topk.ImpactIndex:
    n, width = vectors.shape
    return topk.ImpactIndex(np.arange(n), np.ones(n, np.int64), vectors.ravel(), np.arange(n + 1) * width)


def test_top_k_stops_only_on_proof():
    rng = np.random.default_rng(4)
    vectors = rng.integers(-64, 64, (900, 16))
    vectors[:40] *= 3
    index = index_of(vectors)
    asked = rng.integers(-64, 64, (25, 16))
    for q, (members, _) in zip(asked, index.candidates(asked, 10, [-1] * 25)):
        exact = vectors @ q
        assert set(np.flatnonzero(exact >= np.sort(exact)[-10])) <= set(members)


def test_top_k_leaves_segments_unread():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-3, 4, (4000, 32))
    vectors[:50] += rng.integers(100, 200, (50, 32))  # a few vectors of high impact decide
    index, q = index_of(vectors), np.abs(rng.integers(1, 60, 32))
    members, n_read = index.candidates(q[None, :], 10, [-1])[0]
    assert n_read < 0.1 * np.count_nonzero(vectors)
    exact = vectors @ q
    assert set(np.flatnonzero(exact >= np.sort(exact)[-10])) <= set(members)


def test_url_rules_equal_brute_force(spark):
    hosts = ["a.example.com", "example.com", "WWW.Example.com", "com", "net", "x.net", "notcom", "a..com", ""]
    paths = ["", "/", "/en/", "/en", "/es/x?q", "/fr/#h", "?q", "/enx/"]
    urls = [(i, f"http://{h}{p}") for i, (h, p) in enumerate(itertools.product(hosts, paths))]
    urls += [(900, None), (901, "no scheme"), (None, "http://com/"), (902, "x://com/"), (902, "x://com/")]
    long = "/" + "p" * 5000 + "/"
    urls += [(903, f"http://x.net{long}end"), (904, f"http://net{long[:-1]}"), (905, "http://" + "s." * 3000 + "com/en/")]
    rules = [*urlrules.RULES, ("net", long, "block"), ("x.net", long[:40], "allow"), ("example.com", "/", "block"), ("a.example.com", "/en/", "block"), (None, "/", "block"), ("com", None, "block"), ("com", "/", "block")]
    df = spark.createDataFrame(urls, "page_id long, url string").withColumn("host", F.lit("clash"))
    out = urlrules.judge_urls(df, spark.createDataFrame(rules, "host string, path string, action string"))
    got = sorted(map(str, [tuple(r) for r in out.collect()]))
    want = []
    for i, url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [
            (-len(h + p), h + p, a)
            for h, p, a in rules
            if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = min(fits, default=None)
        want.append(str((i, host, path, best and best[1], best[2] if best else "allow")))
    assert got == sorted(want)
    none = spark.createDataFrame([], "host string, path string, action string")
    assert {r.verdict for r in urlrules.judge_urls(df, none).collect()} == {"allow"}
    assert urlrules.judge_urls(df.where("false"), none).count() == 0


def test_url_rules_carry_the_stack_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(urlrules, "shuffles", lambda spark: 23)  # few rows a range, so most stacks began in another
    rng = np.random.default_rng(12)
    host = lambda n: ".".join(rng.choice(list("abc"), n))
    rules = [(host(rng.integers(1, 6)), "/" * int(rng.integers(1, 3)), str(rng.choice(["allow", "block"]))) for _ in range(60)]
    urls = [(i, f"http://{host(rng.integers(1, 8))}{'/' * int(rng.integers(0, 4))}") for i in range(400)]
    out = urlrules.judge_urls(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, action string"))
    got = {r.page_id: (r.rule, r.verdict) for r in out.collect()}
    for i, url in urls:
        own, slash, path = url[7:].partition("/")
        fits = [(-len(h + p), h + p, a) for h, p, a in rules if (own == h or own.endswith("." + h)) and (slash + path).startswith(p)]
        best = min(fits, default=(0, None, "allow"))
        assert got[i] == best[1:], url


def test_quality_separates_held_out_labels(spark):
    rows = queries.op5_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    held = rows.where("held_out").select("quality", "predicted", "score").toPandas()
    assert (held.quality == held.predicted).mean() >= 0.93
    empty = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(empty, quality.train(empty, labels)).collect()] == [0.5, 0.5]


def test_risk_of_positives_and_unlabelled_equals_brute_force():
    rng = np.random.default_rng(2)
    p, u, w, b = rng.normal(1, 1, (30, 4)), rng.normal(0, 1, (50, 4)), np.abs(rng.normal(size=4)), 0.3

    def brute(prior, w, b):
        loss = lambda f, sign: np.log(1 + np.exp(-sign * f))
        margins = lambda rows: [sum(x * y for x, y in zip(r, w)) + b for r in rows]
        plus = prior * sum(loss(f, 1) for f in margins(p)) / len(p)
        return plus, sum(loss(f, -1) for f in margins(u)) / len(u) - prior * sum(loss(f, -1) for f in margins(p)) / len(p)

    signs = set()
    for prior in (0.2, 0.99):
        for scale in (1.0, 6.0):
            plus, rest = brute(prior, scale * w, b)
            assert np.allclose((plus, rest), quality.risk(p, u, prior, scale * w, b))
            signs.add(rest >= 0)
            part = (lambda x: sum(brute(prior, x[:4], x[4]))) if rest >= 0 else (lambda x: -brute(prior, x[:4], x[4])[1])  # noqa: B023
            x = np.append(scale * w, b)
            rise = [(part(x + h) - part(x - h)) / 2e-6 for h in 1e-6 * np.eye(5)]
            assert np.allclose(quality.descent(p, u, prior, scale * w, b), rise, atol=1e-5)
    assert signs == {True, False}


def test_quality_of_repeated_rows_clashing_columns_and_empty_tables(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    once = quality.train(docs, labels)
    odd = docs.unionByName(docs).withColumn("label", F.lit("clash")).withColumn("score", F.lit("clash"))
    twice = quality.train(odd, labels.unionByName(labels))
    assert np.allclose(once.weights, twice.weights)
    long = spark.createDataFrame([(1, "Long. " * 300_000), (1, "Long. " * 300_000)], "doc_id long, text string")
    assert len({r.score for r in quality.score(long, once).collect()}) == 1
    assert quality.score(odd.where("false"), quality.train(odd.where("false"), labels)).count() == 0


def test_quality_decides_by_the_prior_over_all_documents(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    priors, fit = [], quality.fit
    monkeypatch.setattr(quality, "MAX_ROWS", 80)
    monkeypatch.setattr(quality, "SAMPLE", 80)
    monkeypatch.setattr(quality, "fit", lambda p, u, prior, sums: priors.append(prior) or fit(p, u, prior, sums))
    share = quality.score(docs, quality.train(docs, labels)).agg(F.avg("predicted")).first()[0]
    assert abs(share - priors[0]) <= 0.005


def test_quality_weighs_all_unlabelled_texts_whatever_the_sample(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    fits, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda p, u, prior, sums: fits.append((p, u, prior)) or fit(p, u, prior, sums))
    whole = quality.train(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE", 150)
    part = quality.train(docs, labels)
    (p, u, prior), (_, few, _) = fits
    assert len(u) == docs.count() and len(few) == 150
    blind = fit(p, few, prior)  # what the sample alone would have given
    x = [quality._expand(u, m.mean, m.scale) for m in (whole, part, blind)]
    same = [np.corrcoef(x[0] @ whole.weights, own @ m.weights)[0, 1] for m, own in ((part, x[1]), (blind, x[2]))]
    assert same[0] > 0.99 and same[0] > same[1], same


def test_ordinal_loss_and_gradient_equal_brute_force():
    rng = np.random.default_rng(9)
    n, width, top = 40, 7, 3
    has = rng.random((n, width)) < 0.4
    row, column = np.nonzero(has)
    grades, weight = rng.integers(0, top + 1, n), rng.random(n)
    w, theta = rng.normal(size=width), np.sort(rng.normal(size=top))

    def brute(w, theta):
        total = 0.0
        for i in range(n):
            s = sum(w[j] for j in range(width) if has[i, j])
            below = [0.0, *(1 / (1 + np.exp(s - t)) for t in theta), 1.0]
            total -= weight[i] * np.log(below[grades[i] + 1] - below[grades[i]])
        return total

    assert abs(toxicity.loss(row, column, grades, weight, w, theta) - brute(w, theta)) < 1e-9
    by_w, by_t = toxicity.slopes(row, column, grades, weight, w, theta)
    for at in range(width + top):
        move = np.zeros(width + top)
        move[at] = 1e-6
        rise = (brute(w + move[:width], theta + move[width:]) - brute(w - move[:width], theta - move[width:])) / 2e-6
        assert abs(np.append(by_w, by_t)[at] - rise) < 1e-5


def test_toxicity_learns_from_a_bounded_sample_without_a_window(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_ROWS", 30)
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.unionByName(docs)  # repeated ids are learned from once
    rows = toxicity.training_rows(twice, labels, "toxic")
    per = Counter(rows["label"].to_pylist())
    sizes = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    assert per == {k: min(30, n) for k, n in sizes.items()}
    assert len(set(rows["id"].to_pylist())) == rows.num_rows
    full = {r.doc_id: set(r.f) for r in docs.select("doc_id", toxicity.features(F.col("text")).alias("f")).collect()}
    seen = Counter(f for i in rows["id"].to_pylist() for f in full[i])
    assert all(set(own) == {f for f in full[i] if seen[f] >= toxicity.MIN_TEXTS} for i, own in zip(rows["id"].to_pylist(), rows["features"].to_pylist()))
    bound = sum(map(len, rows["features"].to_pylist())) // 2
    monkeypatch.setattr(toxicity, "MAX_ENTRIES", bound)  # fewer rows, each with all its features
    fewer = toxicity.training_rows(twice, labels, "toxic")
    own = dict(zip(rows["id"].to_pylist(), rows["features"].to_pylist()))
    assert 0 < fewer.num_rows < rows.num_rows and sum(map(len, fewer["features"].to_pylist())) <= bound
    assert all(sorted(f) == sorted(own[i]) for i, f in zip(fewer["id"].to_pylist(), fewer["features"].to_pylist()))
    long = spark.createDataFrame([(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(17_000))) for i in range(5)], "doc_id long, text string")
    out = toxicity.training_rows(long, spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int"), "toxic")
    assert out.num_rows == 1 and len(out["features"][0]) > 17_000  # the first row of a value is learned from at any length
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.train(empty, labels)).count() == 0


def test_training_holds_little_beside_its_entries(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(toxicity, "PART", 1 << 16, raising=False)
    rng = np.random.default_rng(0)
    ids = rng.integers(-(2**63), 2**63 - 1, 20_000)
    lists = pa.array([np.sort(ids[rng.integers(0, 20_000, 1000)]) for _ in range(2000)], pa.list_(pa.int64()))
    tracemalloc.start()
    try:
        toxicity.fit(lists, toxicity.severity_grades(lists, rng.integers(0, 2, 2000)), rounds=1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 32 * 2_000_000, peak  # an entry is 8 bytes


def test_toxicity_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thresholds) > 0).all()
    out = toxicity.score(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert out[out.toxic == 0].is_toxic.mean() < 0.01 and out[out.toxic == 1].is_toxic.mean() > 0.8
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "y")], "doc_id long, text string, severity string")
    assert len({r.severity for r in toxicity.score(odd, model).collect()}) == 1
    none = toxicity.train(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.severity for r in toxicity.score(odd, none).collect()] == [0.0, 0.0]


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    line = " ".join(f"b{i}" for i in range(20))
    rows = [(1, "some text of mine", "en", "a", 17), (1, "some text of mine", "en", "a", 17), (1, "another text of mine", None, None, None)]
    rows += [(2, None, "en", "b", None), (3, "", "en", "b", 0), (None, "no id here", "en", "c", 10), (4, f"x {line} y", "en", "c", 1)]
    rows += [(5, "write to eve@example.com " + "now " * 30_000, "en", "d", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).withColumn("severity", F.lit("clash")).withColumn("leaks", F.lit("clash")).withColumn("ids", F.lit(1))
    for name, some in (("odd", docs), ("none", docs.where("false"))):
        folder = f"{tmp_path}/{name}"
        some.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(7, line)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        spark.createDataFrame([(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 5), (True, 0)]
    assert [r.n_tokens for r in out if r.doc_id in (2, 3)] == [0, 0]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_keeps_what_its_stages_say(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "pii", "bpe"]
    out = corpus_pipeline.run(spark, SMALL).select("doc_id", "n_tokens").collect()
    ids = [r.doc_id for r in out]
    assert len(ids) == len(set(ids))
    toxic = toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet")))
    left = docs.join(toxic.where("is_toxic"), "doc_id", "left_anti")
    classes = bagminhash.near_duplicates(left).where("is_kept").select("doc_id")
    clean = decontam.decontaminate(left.join(classes, "doc_id"), spark.read.parquet(f"{SMALL}/benchmark.parquet")).where("not contaminated")
    assert sorted(ids) == sorted(r.doc_id for r in clean.collect())
