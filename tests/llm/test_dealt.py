"""SimHash components, importance resampling and the Merkle manifest against plain versions of their definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lorekeep.llm import manifest, queries, resample, simhash
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- SimHash


def brute_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(prints):
    """The smallest id reachable for each (id, fingerprint), over links of two bits or fewer."""
    nodes = sorted({p for _, p in prints})
    x = np.array(nodes, dtype=np.uint64)
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= 2):
            a, b = find(p), find(nodes[i + 1 + j])
            root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for d, p in prints:
        least[find(p)].append(d)
    return [(d, f"{p:016x}", min((e for e in least[find(p)] if e is not None), default=None)) for d, p in prints]


def test_simhash_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = brute_components([(r.doc_id, brute_print(r.text)) for r in docs])
    got = queries.queries()["op11_simhash"](spark, SMALL)
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


@pytest.mark.parametrize("large", [1024, 3])
@pytest.mark.parametrize("parts", [(2, 3, 4), (2,), (3,), (4,)])
def test_simhash_links_equal_brute_force(spark, parts, large):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base[:12].tolist():  # crowds: many fingerprints in few bits
        for _ in range(60):
            flips = rng.choice(64 if b % 2 else 12, rng.integers(1, 6), replace=False)
            prints.add(b ^ sum(1 << int(f) for f in flips))
    prints |= {0, 1, 3, 7, 15, 2**64 - 1, 2**63, 2**63 + 2**62, (1 << 40) + 63}
    rows = [(i, p) for i, p in enumerate(sorted(prints))]
    nodes = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for _, p in rows], "node long").repartition(5)
    found = simhash.links(nodes, simhash.make_plan(nodes, parts), large).collect()
    id_of = {p: i for i, p in rows}
    own = list(range(len(rows)))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for r in found:
        p, q = r.a % 2**64, r.b % 2**64
        a, b = find(id_of[p]), find(id_of[q])
        own[max(a, b)] = min(a, b)
    want = {d: c for d, _, c in brute_components(rows)}
    assert {i: find(i) for i, _ in rows} == want
    assert len(found) < 40 * len(rows)


def test_simhash_thresholds_leave_no_link_out(spark):
    rng = np.random.default_rng(7)
    nodes = rng.integers(0, 2**63, 500, dtype=np.uint64) & np.uint64(0x0FF00FF0FFFF0FFF)
    df = spark.createDataFrame([(int(x),) for x in nodes], "node long")
    for parts in ((2,), (3,), (4,)):
        plan = simhash.make_plan(df, parts)
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        thresholds, _ = plan.allocate(nodes)
        assert (thresholds.sum(axis=1) == simhash.DISTANCE - len(plan.parts) + 1).all() and (thresholds >= -1).all()
        cost = plan.costs(nodes)
        chosen = sum(np.take_along_axis(cost[:, i], thresholds[:, i : i + 1] + 1, 1)[:, 0] for i in range(len(plan.parts)))
        for other in np.ndindex(*[4] * len(plan.parts)):  # no other allocation is cheaper
            if sum(other) == 3:
                assert (chosen <= sum(cost[:, i, u] for i, u in enumerate(other)) + 1e-6).all()


def test_simhash_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(50_000))
    rows = [(5, ""), (4, None), (9, " \n\t"), (None, "A b"), (7, "a B"), (8, "a b c"), (8, "a b c"), (3, "A\x0bb\x0cC"), (2, long), (1, long.upper()), (6, "é É"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("component_id", F.lit(1)).withColumn("fingerprint", F.lit(None))
    got = simhash.near_duplicates(df)
    want = brute_components([(d, brute_print(t)) for d, t in rows])
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)
    assert simhash.near_duplicates(df.where("false")).count() == 0


# --- importance resampling


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), Counter(zlib.crc32(r.encode()) % 10000 for r in runs)


def brute_resample(docs, target, share=5):
    found = [(d, *brute_features(t)) for d, t in docs]
    s, t = Counter(), Counter()
    for _, _, c in found:
        s.update(c)
    for x in target:
        t.update(brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)}
    out = []
    for d, n, c in found:
        weight = sum(gain[b] * k for b, k in c.items())
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, sum(c.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    enough = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(enough[: share * len(enough) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in out]


COLUMNS12 = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("chars", [500_000, 300])
def test_resample_query_equals_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(resample, "SLICE_CHARS", chars)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = queries.queries()["op12_resample"](spark, SMALL)
    assert rows_of(got, *COLUMNS12) == sorted(brute_resample(docs, target), key=repr)


def test_pieces_hold_every_run_once():
    rng = np.random.default_rng(2)
    for _ in range(40):
        text = "".join(rng.choice(list("ab9é- .\n{")) for _ in range(rng.integers(0, 200)))
        want = brute_features(text)[1]
        got = Counter()
        for own, follows in resample.pieces(text, int(rng.integers(1, 40))):
            n = len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", own))
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", own) + re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", follows)
            got.update(zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for i in range(n) for k in (1, 2, 3) if i + k <= len(words))
        assert got == want


def test_resample_edges(spark):
    text = " ".join(f"Wort{i}" for i in range(25))
    rows = [(i, text) for i in range(60)] + [(3, text), (100, None), (101, ""), (102, "-- . {}"), (None, text), (103, "é " * 19), (104, "É é " * 10), (105, "x" * 3000)]
    rows += [(106, " ".join(f"l{i % 999}" for i in range(40_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit("x")).withColumn("id", F.lit(1)).withColumn("buckets", F.lit(1))
    target = spark.createDataFrame([(text[:80],), (None,)], "text string")
    got = rows_of(resample.resample(df, target, share=20), *COLUMNS12)
    want = brute_resample(rows, [text[:80], None], 20)
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want, key=repr)]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 13))
    unlike = [r for r in got if r not in want]
    assert all(r[0] == 3 for r in unlike)  # equal rows may take each other's place
    empty = target.where("false")
    assert rows_of(resample.resample(df, empty), *COLUMNS12[:4]) == sorted((r[:4] for r in brute_resample(rows, [])), key=repr)
    assert resample.resample(df.where("false"), target).count() == 0


# --- Merkle manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(r, text):
    values = [r.doc_id, r.source, r.lang, r.n_chars, text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(leaves):
    """The root, and the path of each leaf as (before, after) by level."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for path, i in zip(paths, at):
            run = i // 3 * 3
            path.append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
        at = [i // 3 for i in at]
        level = [H(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def brute_manifest(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, brute_leaf(r, r.text)))
        trees[s] = brute_tree([brute_leaf(r, r.text) for r in by[s]])
    root, tops = brute_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for r, path in zip(by[s], trees[s][1]):
            found = r.text
            if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0:
                found = r.text.replace("\n", "")
            node = brute_leaf(r, found)
            for a, b in path + top:
                node = H(a, node, b)
            out.append((r.doc_id, brute_leaf(r, r.text), trees[s][0], root, H(*(a + b for a, b in path + top)), node, node == root))
    return sorted(out, key=repr)


COLUMNS13 = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def found_manifest(df):
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = manifest.manifest(df, F.when(altered, manifest.leaf_of(text=F.translate("text", "\n", ""))).otherwise(manifest.leaf_of()))
    return rows_of(found.withColumn("proof_sha256", manifest.proof_digest(F.col("path"))), *COLUMNS13)


def test_manifest_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert rows_of(queries.queries()["op13_manifest"](spark, SMALL), *COLUMNS13) == brute_manifest(rows)


@pytest.mark.parametrize("levels", [6, 1, 2])
def test_manifest_of_all_sizes(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    rows = [(d, f"t\n{d}" if d % 4 else None, "xx", f"s{n:02d}", d) for n in (1, 2, 3, 4, 8, 9, 10, 27, 28, 82) for d in range(n)]
    rows += [(d, "tëxt\n", None, None, None) for d in (5, 3, 3, -8)] + [(None, "", "", "", 0), (7, "\n" * 5, "é", "Z", None), (8, "word\n" * 9000, "é", "z", 1), (9, "x", "", "é", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("position", F.lit("x")).withColumn("leaf", F.lit(1)).withColumn("group", F.lit(1))
    assert found_manifest(df) == brute_manifest(df.collect())


def test_manifest_edges(spark):
    one = spark.createDataFrame([(1, "a\nb", "x", "s", 3)], DOCS)
    assert found_manifest(one) == brute_manifest(one.collect())
    assert manifest.manifest(one.where("false")).count() == 0
    plain = manifest.manifest(spark.createDataFrame([(i, "a", None, "s", 1) for i in range(5)], DOCS)).collect()
    assert all(r.verified for r in plain) and {len(r.path) for r in plain} == {2}


def test_crc_of_joined_words_comes_from_their_own():
    import zlib

    import pyarrow as pa

    from lorekeep.llm.resample import _crc_joined

    pairs = [("a", "b"), ("été", "x" * 70_000), ("z" * 300, "日本"), ("q", "7")]
    crc = lambda s: zlib.crc32(s.encode())
    first, second = pa.array([crc(a) for a, _ in pairs] + [None, 5]), pa.array([crc(b) for _, b in pairs] + [1, None])
    got = _crc_joined(first, second, pa.array([len(b.encode()) for _, b in pairs] + [1, None]))
    assert got.to_pylist() == [crc(f"{a} {b}") for a, b in pairs] + [None, None]


def test_counts_leave_slice_by_slice():
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["Ab", "c9", "été", "-", "dd"], rng.integers(0, 30))) for _ in range(60)] + [None, "", "x y " * 500, "z" * 900, "end"]
    taken, seen, found = [], 0, []
    for first, stop, d, b, n in resample._Counter().slices((taken.append(t) or t for t in texts), 200):
        assert first == seen and len(taken) <= stop + 1  # the texts behind a slice are not read, so nor are their counts held
        assert stop == first + 1 or sum(len(t or "") for t in texts[first:stop]) <= 200
        found += [Counter({int(y): int(z) for x, y, z in zip(d, b, n) if x == k}) for k in range(stop - first)]
        seen = stop
    assert found == [brute_features(t)[1] for t in texts]
