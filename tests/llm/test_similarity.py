import itertools
import random

import numpy as np
from papercairn.llm import knn, neardup, spans

WORDS = [f"w{i}" for i in range(400)]


def text(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(r, t, k):
    w = t.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(WORDS)
    return " ".join(w)


def truth(rows, size, threshold, least=20):
    sets = {}
    for tbl, key, t in rows:
        w = neardup.words(t) if t else []
        if len(w) >= least:
            sets[(tbl, key)] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    out = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        if a[0] == b[0] and a[1] != b[1] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
            out.add((a[0], a[1], b[1]))
    return out


def test_near_duplicates_against_all_pairs(spark):
    r = random.Random(1)
    rows = []
    for i in range(120):
        t = text(r, r.randint(20, 90))
        rows.append(("p", f"{i:03}", t))
        for j in range(r.choice([0, 0, 1, 3])):
            rows.append(("p" if j != 1 else "c", f"{i:03}{j}", edited(r, t, r.randint(0, 8)).upper()))
    rows += [("p", "dup1", rows[0][2]), ("p", "dup1", rows[0][2]), ("p", "n", None), ("p", "e", ""), ("p", "s", "too short " * 3), ("p", "long", text(r, 30_000)), (None, None, text(r, 40))]
    df = spark.createDataFrame([(*x, 1, [1]) for x in rows], "tbl string, id string, text string, cls int, keys array<int>")
    links, members = neardup.near_duplicates(df, 0.6, 3)
    got = {tuple(x) for x in neardup.pairs_of_rows(links, members).collect()}
    want = truth([x for x in rows if x[0]], 3, 0.6)
    assert got <= want and len(got) >= 0.98 * len(want) > 50
    g = neardup.groups(links, members).toPandas()
    assert len(g) == len({(a, b) for a, b, t in rows if t and len(t.split()) >= 20})


def test_large_nodes_are_divided(spark):
    r = random.Random(2)
    base = text(r, 60)
    rows = [("p", f"{i:04}", edited(r, base, r.randint(0, 2))) for i in range(150)]
    df = spark.createDataFrame(rows, "tbl string, id string, text string")
    links, members = neardup.near_duplicates(df, 0.8, 5, node=8, block=16)
    got = {tuple(x) for x in neardup.pairs_of_rows(links, members).collect()}
    want = truth(rows, 5, 0.8)
    assert got <= want and len(got) >= 0.97 * len(want) > 1000


def test_near_duplicates_of_nothing(spark):
    links, members = neardup.near_duplicates(spark.createDataFrame([], "tbl string, id string, text string"), 0.6, 3)
    assert links.count() == members.count() == 0


def brute(docs, least):
    out = set()
    for (a, x), (b, y) in itertools.combinations(sorted(docs.items()), 2):
        grams = {x[i : i + least] for i in range(len(x) - least + 1)}
        if x.strip() and any(y[i : i + least] in grams for i in range(len(y) - least + 1)):
            out.add((a, b))
    return out


def test_shared_spans_against_all_pairs(spark):
    r = random.Random(3)
    long = [text(r, 60) for _ in range(20)]
    docs = {}
    for i in range(70):
        t = text(r, r.randint(5, 90))
        if r.random() < 0.6:
            s = r.choice(long)
            a = r.randrange(len(s) - 100)
            t = t[:60] + s[a : a + r.randint(35, 120)] + t[60:]
        docs[i] = t
    docs |= {100: "ab" * 300, 101: "x" + "ab" * 60, 102: "b" * 500, 103: "a" + "b" * 90 + "z", 104: docs[3], 105: " " * 300, 106: " " * 300, 107: "語" * 55, 108: "x" + "語" * 50 + "😀"}
    rows = [(k, v, 7, 1) for k, v in docs.items()] + [(3, docs[3], 8, 1), (200, None, 1, 1), (201, "", 1, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, cls int, pos int")
    found, members = spans.shared(df, 50, 30)
    got = {tuple(x) for x in spans.pairs_of_documents(found, members).collect()}
    want = {(a, b) for a, b in brute(docs, 50)}
    assert got == want and len(want) >= 20
    docs |= {110: "x" + "-" * 1000, 111: "y" + "-" * 300 + "z", 112: "ab " * 400, 113: "?" + "ab " * 90}
    df = df.union(spark.createDataFrame([(k, docs[k], 7, 1) for k in range(110, 114)], df.schema))
    cover = {x["doc_id"]: x for x in spans.coverage(df, 50, 30).collect()}
    assert len(cover) == len(docs) + 2
    assert cover[104]["share"] == 1.0 and cover[200]["share"] == 0.0
    for a in docs:
        n = set()
        for b in docs:
            if a != b and docs[b].strip() and docs[a].strip():
                for i in range(len(docs[a]) - 49):
                    if docs[a][i : i + 50] in docs[b]:
                        n |= set(range(i, i + 50))
        assert cover[a]["shared_chars"] == len(n), a
        assert cover[a]["n_spans"] == sum(i - 1 not in n for i in n), a
    assert all(x.count() == 0 for x in spans.shared(df.filter("false"), 50, 30))


def test_coverage_of_a_common_stretch_is_linear(spark):
    r = random.Random(4)
    common = text(r, 40)
    rows = [(i, f"{text(r, 3)} {i} {common} {i} {text(r, 3)}") for i in range(3000)]
    cover = spans.coverage(spark.createDataFrame(rows, "doc_id bigint, text string"), 100, 60).toPandas()
    assert len(cover) == 3000 and (cover.n_spans == 1).all() and (cover.shared_chars >= len(common) + 2).all()


def test_windows_cover_every_run():
    rng = np.random.default_rng(5)
    codes = rng.integers(97, 100, 3000).astype(np.uint32)
    owner = np.repeat([0, 1, 2], [1000, 1500, 500]).astype(np.int32)
    c, key, left, right = spans.windows(codes, owner, 12, 20, spans._powers(4000), True)
    assert (left + right + 1 >= 20).all() and len(left) == len(right) == len(c) == len(key)
    for s in range(0, 3000 - 31):
        if owner[s] == owner[s + 30]:
            assert any(k - a <= s and s + 19 <= k + b for k, a, b in zip(c, left, right) if s <= k <= s + 19)


def test_nearest_vectors(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 6000)] + 0.6 * rng.normal(size=(6000, 16))
    rows = [(f"v{i:05}", [float(a) for a in v], 1) for i, v in enumerate(x)]
    rows += [rows[0], ("z", [0.0] * 16, 1), ("n", None, 1), ("short", [1.0], 1), ("hole", [None] + [1.0] * 15, 1), ("nan", [float("nan")] * 16, 1)]
    df = knn.valid(spark.createDataFrame(rows, "key string, v array<float>, part int"), "key", "v", 16)
    q = df.filter("id < 'v00100'")
    got = knn.nearest(df, q, k=10, dim=16, block=500).toPandas()
    assert len(got) == 1000 and (got.id != got.neighbour_id).all()
    n = x.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    sim = n[:100] @ n.T
    sim[np.arange(100), np.arange(100)] = -2
    want = {(f"v{i:05}", f"v{j:05}") for i in range(100) for j in np.argsort(-sim[i], kind="stable")[:10]}
    assert len(want & set(zip(got.id, got.neighbour_id))) >= 900
    few = knn.nearest(df, q, k=10, dim=16, visits=2, homes=1)
    measured = knn.recall(few, df, q, dim=16).toPandas()
    assert len(measured) == 100 and 0.3 < measured.recall.mean() < 1
    mine = set(zip(*few.select("id", "neighbour_id").toPandas().to_numpy().T))
    assert abs(measured.recall.mean() - len(want & mine) / 1000) < 1e-9
    assert knn.nearest(df.filter("false"), q, dim=16).count() == 0
    assert knn.nearest(df.limit(3), df.limit(1), dim=16).count() == 2


def test_partition_is_balanced():
    x = np.random.default_rng(1).normal(size=(512, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = knn.neighbours(x, 10)
    label = knn.partition(x, graph, 8)
    assert set(np.bincount(label)) == {64}
    assert (label[graph] == label[:, None]).mean() > 2 / 8
