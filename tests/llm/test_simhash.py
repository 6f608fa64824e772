import random

import numpy as np
import xxhash

from leadweave.llm import simhash as S


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, bits=3):
    """{fingerprint: least fingerprint reachable} by all pairs."""
    prints = np.array(sorted(set(prints)), np.uint64)
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return {int(p): int(prints[find(i)]) for i, p in enumerate(prints)}


def test_fingerprints(prose):
    texts = ["", "one", "One two", "a b c", prose(1, 500), "Ünï  çödé\x0bx y z", " \n", "A b C d"]
    assert S.fingerprint_arrays([t.encode() for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def crowd(seed, n):
    """Fingerprints at random, in chains of few flipped bits, and in dense crowds."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(6):
        x = rng.getrandbits(64)
        for _ in range(n // 8):
            out.append(x)
            for _ in range(rng.choice([1, 2, 3, 4, 5])):
                x ^= 1 << rng.randrange(64)
    center = rng.getrandbits(64)
    for _ in range(n):
        x = center
        for b in rng.sample(range(64), rng.choice([1, 2, 3])):
            x ^= 1 << b
        out.append(x)
    return out


def test_components_against_all_pairs(spark):
    prints = crowd(3, 400)
    signed = [int(np.uint64(p).view(np.int64)) for p in set(prints)]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    want = plain_components(prints)
    groups = {}
    for p, r in want.items():
        groups.setdefault(r, set()).add(int(np.uint64(p).view(np.int64)))
    for cell in (1024, 40):  # meetings whole, or split into cells
        links = S.near_links(nodes, 3, cell)
        found = {r.u: r.root for r in S.roots(S.written(links, "test-links")).collect()}
        got = {}
        for p in signed:
            got.setdefault(found.get(p, p), set()).add(p)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_query_and_stage_against_brute_force(spark, prose):
    base = [prose(k, 120) for k in range(12)]
    rows = [(k, t) for k, t in enumerate(base)] + [(100 + k, t) for k, t in enumerate(base[:5])] + [(200 + k, t + " end") for k, t in enumerate(base[:6])]
    rows += [(300, None), (301, ""), (3, base[3]), (None, base[7]), (None, prose(99, 40)), (None, prose(99, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    comp = plain_components([plain_fingerprint(t) for _, t in rows])
    least = {}
    for d, t in rows:
        r = comp[plain_fingerprint(t)]
        least.setdefault(r, []).append(d)
    def first(ids):
        return min((i for i in ids if i is not None), default=None)
    want = sorted(((d, f"{plain_fingerprint(t):016x}", first(least[comp[plain_fingerprint(t)]])) for d, t in rows), key=str)
    got = S.components(df)
    got = got.select("doc_id", S.hex_of(got["fingerprint"]).alias("f"), "component_id").collect()
    assert sorted(map(tuple, got), key=str) == want
    kept = [r.doc_id for r in S.one_of_each(df).collect()]
    assert sorted(kept, key=str) == sorted((first(ids) for ids in least.values()), key=str)


def test_odd_rows(spark, odd_docs):
    kept = S.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    # NULL, empty and blank texts are one component (doc_id 2 stays), the repeated row stays once
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 2, 5, 6, 7, None], key=str)
    assert S.one_of_each(odd_docs.limit(0)).count() == 0
    assert S.components(odd_docs.limit(0)).count() == 0


def test_few_links_make_few_files(spark, monkeypatch):
    links = spark.createDataFrame([(n, n + 1) for n in range(40)], "u long, v long")
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    made = []
    monkeypatch.setattr(S, "written", lambda df, name, write=S.written: made.append(write(df, name)) or made[-1])
    try:
        found = {r.u: r.root for r in S.roots(links).collect()}
        assert all(len(t.inputFiles()) <= 1 for t in made[1:])
        made.clear()
        monkeypatch.setattr(S, "EDGES", 10)
        assert {r.u: r.root for r in S.roots(links).collect()} == found
        assert max(len(t.inputFiles()) for t in made[1:]) > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == dict.fromkeys(range(1, 41), 0)
