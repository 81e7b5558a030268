"""Centroid clustering, ranked search and embedding near-dedup against SQL and brute force."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymill.llm import ann, bisectors, dual_tree, flat_graph


def clustered(rows, k, rounds, scale=256):
    """The contract in whole numbers, row by row."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [x for _, x in first[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, x in kept:
            own[near(x)[1]].append(x)
        cs = [[sum(col) // len(own[j]) for col in zip(*own[j])] if j in own else c for j, c in enumerate(cs)]
    return [(i, *near(x)[::-1]) for i, x in kept], cs


@pytest.mark.parametrize("reach", [1.0, 5e9])
def test_clusters_like_brute_force(spark, reach):
    """Small numbers, and some that doubles cannot square; ties by many equal components."""
    r = random.Random(4)
    rows = [(k % 90, [r.choice([-0.5, 0.0, 0.25, r.uniform(-1, 1)]) * (reach if k % 7 == 0 else 1) for _ in range(6)]) for k in range(150)] + [(None, [0.1] * 6)]
    odd = [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (204, [math.nan] * 6), (205, [math.inf] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int").repartition(5)
    want, cs = clustered(rows, 7, 3)
    got = bisectors.cluster(df, k=7, rounds=3, size=6).collect()
    key = lambda t: (t[0] is None, *[x or 0 for x in t])
    assert sorted(((g["vec_id"], g["cluster"], g["distance"]) for g in got), key=key) == sorted(((i, c, d if d < 1 << 63 else None) for i, c, d in want), key=key)
    digests = {g["cluster"]: g["centroid_sha256"] for g in got}
    assert digests == {c: hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest() for _, c, _ in want}
    if reach == 1:
        sums = Counter()
        for _, c, d in want:
            sums[c] += d
        assert all(g["cluster_inertia"] == sums[g["cluster"]] and g["inertia"] == sum(sums.values()) for g in got)
    assert bisectors.cluster(df.limit(0), size=6).count() == 0
    few = bisectors.cluster(spark.createDataFrame([(1, [1.0] * 6), (1, [2.0] * 6)], "vec_id long, embedding array<float>"), k=7, rounds=2, size=6).collect()
    assert sorted((g["cluster"], g["distance"]) for g in few) == [(0, 0), (1, 0)]


def scored(items, docs, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own = [(d, Counter(find(t))) for d, t in docs]
    own = [(d, c, sum(c.values())) for d, c in own if c]
    n_docs, length, out = len(own), sum(n for *_, n in own), []
    df = Counter(t for _, c, _ in own for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(find(t))
    for i, ts in terms.items():
        rows = []
        for d, c, n in own:
            m = 10 + 90 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            rows += [(-s, d is None, d or 0, d)] if s > 0 else []
        out += [(i, rank, r[3], -r[0]) for rank, r in enumerate(sorted(rows)[:k], 1)]
    return out


def test_ranks_like_brute_force(spark, monkeypatch):
    r = random.Random(5)
    words = [f"w{k}" for k in range(60)] + ["Ünï", "straße", "Ω", "x1"]
    text = lambda n: r.choice([" ", "-", "\n", "."]).join(r.choice(words[: r.choice([5, 64])]) for _ in range(n)).title()
    docs = [(k if k % 50 else None, text(r.randint(1, 30))) for k in range(400)] + [(7, "W1 w2"), (7, "W1 w2"), (900, None), (901, ""), (902, " .-")] + [(1000 + k, "w1 w2 w3") for k in range(30)] + [(2000, "w1 " * 200_000)]
    items = [(k, text(8)) for k in range(40)] + [(3, "w1 zebra"), (None, "w2"), (50, None), (51, "unheard of")]
    frames = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, score int"), spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, rank int").repartition(3)
    key = lambda t: tuple((x is None, x or 0) for x in t)
    want = sorted(scored(items, docs, 4), key=key)
    for block, sample in ((512, 8000), (25, 40)):  # one block; several, started from a sample
        monkeypatch.setattr(dual_tree, "BLOCK_ITEMS", block)
        monkeypatch.setattr(dual_tree, "SAMPLE", sample)
        assert sorted((tuple(x) for x in dual_tree.search(*frames, k=4).collect()), key=key) == want
    assert dual_tree.search(frames[0].limit(0), frames[1]).count() == 0
    assert dual_tree.search(frames[0], frames[1].limit(0)).count() == 0


def test_dual_search_leaves_most_pairs_out():
    """Items and documents of 16 topics: pairs of different topics need no score."""
    rng, rows = np.random.default_rng(2), []
    for k in range(1024):
        terms = np.sort(rng.choice(40, 12, replace=False)) + 40 * (k % 16)
        rows.append((terms, rng.integers(1, 1000, 12)))
    made = lambda rs: dual_tree.Rows(np.arange(0, 12 * len(rs) + 1, 12), np.concatenate([t for t, _ in rs]), np.concatenate([v for _, v in rs]), 640)
    items, docs = made(rows[:64]), made(rows[64:])
    best = dual_tree.Best(64, 5, [1] * 64)
    n = dual_tree.dual_search(items, dual_tree.Tree(items, 4), docs, [(False, k) for k in range(960)], best)
    dense = lambda rs: np.stack([np.bincount(t, weights=v, minlength=640) for t, v in rs])
    scores = dense(rows[:64]) @ dense(rows[64:]).T
    for i, found in enumerate(best.found):
        assert found == sorted((-int(s), (False, k)) for k, s in enumerate(scores[i]) if s > 0)[:5]
    assert n < 64 * 960 / 4


def linked(rows):
    """(n_links, component_id, kept) of each row, all pairs compared."""
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = [(0, i, True) for i, _, _ in rows]
    near = defaultdict(list)
    for label, dim in {(rows[k][2], len(rows[k][1])) for k in good}:
        own = np.array([k for k in good if rows[k][2] == label and len(rows[k][1]) == dim])
        x = np.array([rows[k][1] for k in own])
        x = x / np.abs(x).max(axis=1)[:, None]
        x = x / np.sqrt((x**2).sum(axis=1))[:, None]
        s = x @ x.T >= 0.93
        np.fill_diagonal(s, False)
        for a, row in zip(own.tolist(), s):
            near[a] = own[row].tolist()
    seen = set()
    for k in good:
        if k not in seen:
            group, todo = [], [k]
            seen.add(k)
            while todo:
                a = todo.pop()
                group.append(a)
                for b in near[a]:
                    if b not in seen:
                        seen.add(b)
                        todo.append(b)
            least = min((rows[a][0] for a in group if rows[a][0] is not None), default=None)
            for a in group:
                out[a] = (len(near[a]), least, rows[a][0] == least)
    return out


def test_links_like_brute_force(spark, monkeypatch):
    """A hot group of near copies, groups at all distances around the threshold, chains, exact copies, and rows that cannot link."""
    monkeypatch.setattr(flat_graph, "SHARD_ROWS", 300)
    rng = np.random.default_rng(6)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.normal(size=24))
    vectors, hot = [], unit()
    vectors += [(hot + rng.normal(size=24) * 0.02 * (1 + k % 3), 1) for k in range(500)]
    for k in range(40):
        base = unit()
        vectors += [(base + rng.normal(size=24) * 0.05 * (1 + k % 3), k % 3) for _ in range(1 + k % 8)]
    step, at = unit(), unit()
    for k in range(40):  # each is linked to a few before and after it
        vectors.append((at + 0.15 * k * step, 2))
    vectors += [(hot * 3, 1)] * 20 + [(hot, 0), (hot, None)] + [(unit(), k % 3) for k in range(200)]
    rows = [(k, v.astype(np.float32).astype(float).tolist(), label) for k, (v, label) in enumerate(vectors)]
    odd = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 24, 1), (9004, [math.nan] * 24, 1), (9005, [None] * 24, 1), (9006, [1.0] * 3, 1), (9007, [1.0] * 3, 1), (None, rows[0][1], 1), (5, rows[0][1], 1), (9008, [1e300] * 24, 0), (9009, [1e-300] * 24, 0)]
    order = rng.permutation(len(rows) + len(odd))
    rows = [(rows + odd)[k] for k in order]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, key string")
    key = lambda t: tuple((x is None, x or 0) for x in t)
    got = sorted((tuple(r) for r in flat_graph.join(df).select("vec_id", "n_links", "component_id", "kept").collect()), key=key)
    want = sorted(((r[0], *t) for r, t in zip(rows, linked(rows))), key=key)
    assert len(got) == len(want)
    links = sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.99 * links
    assert sum(g[2:] == w[2:] for g, w in zip(got, want)) >= 0.99 * len(want)
    assert flat_graph.join(df.limit(0)).count() == 0


def test_flat_graph_finds_what_is_within_reach():
    """One full shard of vectors without clusters and a few near pairs; recall of the range search against all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2048, 64))
    x[1024:1324] = x[:300] + rng.normal(size=(300, 64)) * rng.uniform(0.1, 0.42, (300, 1))
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = flat_graph.Flat.build(x, 32)
    starts = np.concatenate((np.broadcast_to(g.medoids, (len(x), len(g.medoids))), g.near), axis=1)
    starts = np.sort(starts, axis=1)
    starts[:, 1:][starts[:, 1:] == starts[:, :-1]] = -1
    q, node = g.within(g.x, starts, np.full(len(x), math.acos(0.93)), np.zeros(len(x)), 32)
    found = {(a, b) for a, b in zip(q.tolist(), node.tolist()) if a != b}
    true = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(x @ x.T >= 0.93))) if a != b}
    assert len(true) > 300 and len(found & true) >= 0.99 * len(true)


def test_an_id_with_many_vectors_finds_its_neighbours(spark):
    """All of an id's own vectors are nearer than anything else."""
    rng = np.random.default_rng(9)
    rows = [(0, (np.ones(8) * 5 + rng.normal(size=8) * 0.1).tolist()) for _ in range(90)] + [(i, (np.ones(8) + rng.normal(size=8)).tolist()) for i in range(1, 200)]
    got = [(r["rank"], r["vec_id"]) for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") == 0).orderBy("rank").collect()]
    least = np.array(min(v for i, v in rows if i == 0))
    want = sorted((-float(np.array(v) @ least), i) for i, v in rows if i)[:20]
    assert [r for r, _ in got] == list(range(1, 21)) and len({i for _, i in got} & {i for _, i in want}) >= 19


@pytest.mark.parametrize("n", [3000, *([20_000] if os.environ.get("TALLYMILL_SLOW") else [])])
def test_calibrated_width_holds_recall(n):
    """A shard of vectors without clusters, searched by vectors from outside; at 20,000, the full size, if TALLYMILL_SLOW is set."""
    rng = np.random.default_rng(10)
    x, q = rng.normal(size=(n, 64)), rng.normal(size=(100, 64))
    g = ann.Graph.build(ann.equal_length(x))
    width = ann.calibrated(g, x, np.concatenate((x[: ann.PROBES], rng.normal(size=(ann.PROBES, 64)))), 20)
    found = [sorted(g.nearest(u, width), key=lambda j: -float(x[j] @ v))[:20] for u, v in zip(ann.directions(q), q)]
    true = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert np.mean([len(set(f) & set(t.tolist())) / 20 for f, t in zip(found, true)]) >= 0.93
