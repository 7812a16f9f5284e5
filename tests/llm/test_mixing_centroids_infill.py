"""Mixing, centroid clustering and fill-in-middle against brute force and the laws of their contracts."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import centroids, infill, mixing, queries

SF = "/root/testdata/sf0.001"


def rows(df):
    return [r.asDict() for r in df.collect()]


def text(n):
    return " ".join("w" * (1 + i % 7) for i in range(n))


# -- mixing


def level_targets(sizes, weights, repeats):
    """By the rule: shares, those above their cap stop there, the excess is shared again."""
    total, capped = Fraction(sum(sizes)), {}
    while True:
        rest, free = total - sum(capped.values()), [i for i in range(len(sizes)) if i not in capped]
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i: Fraction(repeats * sizes[i]) for i in free if share[i] > repeats * sizes[i]}
        if not over:
            return [capped[i] if i in capped else share[i] for i in range(len(sizes))]
        capped |= over


def mixed(spark, data, **options):
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int, pattern string")
    return rows(mixing.mix_with_targets(df, F.col("source"), mixing.n_words(F.col("text")), **options))


def check_mix(data, got, repeats=3, weights=(5, 2, 1)):
    assert Counter(r["id"] for r in got) == Counter(r[0] for r in data)
    sizes = defaultdict(int)
    for _, t, s, *_ in data:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, level_targets([sizes[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], repeats), strict=True))
    source = {i: s for i, _, s, *_ in data}
    taken = defaultdict(int)
    for r in got:
        s = source[r["id"]]
        taken[s] += r["taken"]
        assert 0 <= r["taken"] <= repeats * r["size"]
        assert r["source_size"] == sizes[s]
        assert math.isclose(r["target"], want[s], rel_tol=1e-12)
    for s in order:
        assert abs(taken[s] - want[s]) <= 0.5, (s, taken[s], float(want[s]))


def test_mix_takes_every_target(spark):
    random.seed(5)
    names = ["b", "B", "é", "￿", "\U0001f600", "a", None, "", "zz"]
    data = [(i, text(random.choice([0, 1, 5, 80, 4000])), random.choice(names), 7, "clash") for i in range(300)]
    data += [(1000 + i, text(900), "a", 7, "hot") for i in range(150)]
    got = mixed(spark, data)
    check_mix(data, got)
    again = mixed(spark, data[::-1])
    assert Counter(map(repr, got)) == Counter(map(repr, again))  # distinct rows: the order of the table is no matter


def test_mix_order_of_sources_is_by_code_point(spark):
    data = [(i, text(100), s, 0, "") for i, s in enumerate(["￿", "\U0001f600", "z", None])]
    got = {r["id"]: r["target"] for r in mixed(spark, data)}
    assert [got[i] for i in (2, 0, 1, 3)] == [pytest.approx(400 * w / 13) if w < 5 else pytest.approx(400 * 5 / 13) for w in (5, 2, 1, 5)]


def test_mix_of_edges(spark):
    assert mixed(spark, []) == []
    data = [(1, None, "a", 0, ""), (2, "", None, 0, ""), (None, "   ", "b", 0, "")]
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed(spark, data))
    one = [(1, text(50_000), "a", 0, "")]
    assert [(r["taken"], r["target"]) for r in mixed(spark, one)] == [(50_000, 50_000.0)]
    tiny = [(1, "x", "a", 0, ""), (2, text(1000), "b", 0, ""), (3, text(1000), "c", 0, "")]  # a and then b stop at three times their size
    check_mix(tiny, mixed(spark, tiny))


def test_mix_of_repeated_rows(spark):
    """Equal rows part by their place, digit by digit, even where no sort at the edge is allowed."""
    data = [(7, text(9), "a", 0, "")] * 500 + [(8, text(9), "b", 0, "")] * 40 + [(None, None, "b", 0, "")] * 40
    df = spark.createDataFrame(data, "doc_id long, text string, source string, size int, pattern string")
    old, mixing.EDGE_ROWS = mixing.EDGE_ROWS, 1
    try:
        got = rows(mixing.mix_with_targets(df, F.col("source"), mixing.n_words(F.col("text"))))
    finally:
        mixing.EDGE_ROWS = old
    total = 540 * 9
    by = defaultdict(list)
    for r in got:
        by[r["source_size"]].append(r)
    assert sorted(by) == [360, 4500]
    assert sum(r["taken"] for r in by[360]) == 3 * 360 and sum(r["taken"] for r in by[4500]) == total - 3 * 360
    assert len({r["taken"] for r in by[4500]}) <= 3  # taken once, not at all, or the one at the edge


def test_flow_is_least_cost_and_whole():
    """Every way to give, tried: the flow gives as much as can be given, as cheaply."""
    random.seed(2)
    for _ in range(60):
        n_p, n_s, repeats = random.randint(1, 3), random.randint(1, 3), random.randint(1, 3)
        capacity = [random.randint(0, 2) for _ in range(n_p)]
        members = [sorted(random.sample(range(n_s), random.randint(1, n_s))) for _ in range(n_p)]
        quota = [random.randint(0, 4) for _ in range(n_s)]

        def cost(given, capacity=capacity):
            return sum(sum(e * min(max(g - (e - 1) * c, 0), c) for e in range(1, 4)) for g, c in zip(given, capacity, strict=True))

        best = (0, 0)
        arcs = [(p, s) for p in range(n_p) for s in members[p]]
        for amounts in itertools.product(*[range(min(capacity[p] * repeats, quota[s]) + 1) for p, s in arcs]):
            given, got = [0] * n_p, [0] * n_s
            for (p, s), x in zip(arcs, amounts, strict=True):
                given[p] += x
                got[s] += x
            if all(g <= repeats * c for g, c in zip(given, capacity, strict=True)) and all(g <= q for g, q in zip(got, quota, strict=True)):
                best = max(best, (sum(got), -cost(given)))
        flow = mixing.min_cost_flow(capacity, members, quota, repeats)
        got = [sum(g.get(s, 0) for g in flow) for s in range(n_s)]
        given = [sum(g.values()) for g in flow]
        assert all(x <= q for x, q in zip(got, quota, strict=True)) and all(x <= repeats * c for x, c in zip(given, capacity, strict=True))
        assert all(set(g) <= set(m) for g, m in zip(flow, members, strict=True))
        assert (sum(got), -cost(given)) == best


def test_mix_of_overlapping_sources(spark):
    """Documents in two sources fill the scarce one, and no document without sources is taken."""
    data = [(i, text(10), ["a"]) for i in range(30)] + [(100 + i, text(10), ["b", "a"]) for i in range(10)] + [(200 + i, text(10), ["c"]) for i in range(20)] + [(300, text(10), []), (301, text(10), None)]
    df = spark.createDataFrame(data, "doc_id long, text string, names array<string>")
    got = rows(mixing.mix(df, F.transform("names", lambda s: F.concat(F.lit("1"), s)), mixing.n_words(F.col("text")), weights=(1, 1, 1), carry=("names",)))
    assert len(got) == 62 and all(r["taken"] <= 30 for r in got)
    by = defaultdict(int)
    for r in got:
        by[tuple(r["pattern"])] += r["taken"]
    # 200 words each: b only from the shared ones, in two rounds; a from its own
    assert by[()] == 0 and by[("1c",)] == 200 and by[("1a", "1b")] + by[("1a",)] == 400 and by[("1a", "1b")] == 200
    assert {tuple(r["carry"]["names"]) for r in got if r["id"] == 105} == {("b", "a")}


# -- centroids


def brute_clusters(vectors, k, rounds, seed=3):
    """vectors: (id, integers)."""
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [list(v) for _, v in order[:k]]

    def label():
        out = []
        for _, v in vectors:
            d = [sum((x - y) ** 2 for x, y in zip(v, c, strict=True)) for c in centers]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        mine = defaultdict(list)
        for (j, _), (_, v) in zip(label(), vectors, strict=True):
            mine[j].append(v)
        for j, vs in mine.items():
            centers[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return label(), centers


def clustered(df, **options):
    found = centroids.cluster(df, **options)
    return rows(found.assigned), {r["cluster"]: r for r in rows(found.centers)}


def exact(x, scale=1024):
    return math.floor(Fraction(x) * scale)


@pytest.mark.parametrize("size", [1.0, 1e5, 1e9, 1e300])
def test_clusters_against_brute_force(spark, size):
    """Small components take doubles, larger ones 64-bit integers, the largest Python's; all exact."""
    rng = np.random.default_rng(int(math.log10(size)) + 1)
    data = [(i, (rng.normal(size=4) * size).tolist()) for i in range(60)] + [(None, [size, -size, 0.0, 0.25])] * 2 + [(5, [0.0, 0.0, 1.0, 2.0])] * 30
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(7)
    got, centers = clustered(df, k=5, rounds=4, dims=4)
    vectors = [(i, [exact(x) for x in v]) for i, v in data]
    want, want_centers = brute_clusters(vectors, 5, 4)
    assert {j: c["center"] for j, c in centers.items()} == {j: ",".join(map(str, c)) for j, c in enumerate(want_centers)}
    as_long = lambda d: d if d < 1 << 63 else None
    assert Counter((r["id"], r["cluster"], r["distance"]) for r in got) == Counter((i, j, as_long(d)) for (i, _), (j, d) in zip(vectors, want, strict=True))
    for j, c in centers.items():
        mine = [d for k, d in want if k == j]
        assert (c["n"], c["cluster_inertia"], c["inertia"]) == (len(mine), as_long(sum(mine)), as_long(sum(d for _, d in want)))


def test_distance_kinds_agree():
    rng = np.random.default_rng(1)
    for size in (10, 1 << 20, 1 << 22, 1 << 27, 1 << 28, 1 << 40):
        block, centers = rng.integers(-size, size, (9, 64)).astype(object), rng.integers(-size, size, (3, 64)).astype(object)
        want = [[sum((int(x) - int(y)) ** 2 for x, y in zip(r, c, strict=True)) for c in centers] for r in block]
        assert [[int(v) for v in r] for r in centroids.distances(block, centers).tolist()] == want
    limit = math.isqrt((1 << 53) // 64) // 2  # the largest that the bound lets into doubles, and the next
    for size in (limit, limit + 1):
        block = np.full((1, 64), size, object)
        assert int(centroids.distances(block, -block)[0, 0]) == 64 * (2 * size) ** 2


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, id string, v int"
    none = clustered(spark.createDataFrame([], schema), dims=2)
    assert none == ([], {})
    data = [(1, [1.0, 2.0], "a", 1), (2, [1.0, None], "b", 1), (3, None, "c", 1), (4, [1.0], "d", 1), (5, [float("nan"), 1.0], "e", 1), (6, [float("inf"), 1.0], "f", 1), (7, [-0.0001, 0.5], "g", None), (8, [], "h", 2)]
    got, centers = clustered(spark.createDataFrame(data, schema), dims=2)
    assert sorted((r["id"], r["distance"]) for r in got) == [(1, 0), (7, 0)] and len(centers) == 2
    assert {c["center"] for c in centers.values()} == {"1024,2048", "-1,512"}
    same = [(i, [0.5, 0.5], "", 0) for i in range(20)]  # all centers are equal: the first takes all, the others stay empty
    got, centers = clustered(spark.createDataFrame(same, schema), dims=2)
    assert {r["cluster"] for r in got} == {0} and [centers[j]["n"] for j in range(8)] == [20] + [0] * 7
    words = spark.createDataFrame([("x", [1.0, 1.0]), ("y", [3.0, 3.0])], "vec_id string, embedding array<double>")
    assert {r["id"] for r in clustered(words, dims=2, k=1)[0]} == {"x", "y"}


# -- fill-in-middle


def units(t):
    return re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.S)


PIECES = ["abc", "Z", " ", "\n", "é", "☃", "\U0001f600", "1", "<", ">", "P", "İ", "ſ", "K", "\x00", " ", "ab cd, ef."]


def test_runs_against_units():
    random.seed(4)
    old, infill._SLICE = infill._SLICE, 7
    try:
        for _ in range(300):
            t = "".join(random.choice(PIECES) for _ in range(random.randint(0, 30)))
            u, runs = units(t), infill.Runs(t)
            assert runs.n_units == len(u)
            assert [runs.offset(k) for k in range(len(u) + 1)] == [len("".join(u[:k])) for k in range(len(u) + 1)]
    finally:
        infill._SLICE = old


def test_fill_in_middle_rows(spark):
    random.seed(6)
    texts = ["".join(random.choice(PIECES) for _ in range(random.randint(0, 60))) for _ in range(200)] + ["", None, "a<P>b", "x<S>", "<M>", "é" * 300_000 + "word " * 200_000, "a", "<", "P>", "<S", "<<S>"]
    data = [(i, t, "n", 3) for i, t in enumerate(texts)] + [(None, "no id here", "n", 3), (0, texts[0], "n", 3)]
    df = spark.createDataFrame(data, "doc_id long, text string, form string, output int")
    out = infill.fill_in_middle(df)
    got = rows(out.select("*", infill.restored(F.col("output"), F.col("form")).alias("back")))
    assert len(got) == len(data)
    forms = Counter()
    want = Counter()
    for i, t, *_ in data:
        t = t or ""
        u = units(t)
        x = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(x[k : k + 8], 16) for k in range(0, 32, 8)]
        a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        if not t or any(k in t for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            row = (i, len(u), "plain", None, None, t, t)
        elif h[3] % 100 < 20:
            row = (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t)
        else:
            row = (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t)
        want[row] += 1
        forms[row[2]] += 1
    assert Counter((r["id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in got) == want
    assert min(forms.values()) > 10
    assert rows(infill.fill_in_middle(df.limit(0))) == []


# -- the queries against their SQL


@pytest.mark.parametrize("name", ["op11_mixing", "op12_centroids", "op13_fill_in_middle"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF), con.sql(queries.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(want.select(*columns).fetchall())
