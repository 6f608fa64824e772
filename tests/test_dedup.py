import random
import re
from collections import Counter

import numpy as np
import pytest

from leadweave.functions import name_keys
from leadweave.functions.similarity import common_lengths
from leadweave.operators import exact_dedup, fuzzy_dedup
from leadweave.plans.pipeline import exact_passes

SCHEMA = ("ord bigint, pipeline_id string, company_name string, company_name_normalized string, "
          "phone_normalized string, email string, website string, address string")


def leads(spark, rows):
    return spark.createDataFrame(
        [(i, f"p{i}", r.get("name", f"n{i}"), r.get("norm", r.get("name", f"n{i}").lower()), r.get("phone"),
          r.get("email"), r.get("website"), r.get("address")) for i, r in enumerate(rows)], SCHEMA)


def merge_model(rows, key):
    """Direct form of one exact pass over dict rows."""
    groups, gone = {}, set()
    for r in rows:
        if r[key]:
            groups.setdefault(r[key], []).append(r)
    for group in groups.values():
        best = max(group, key=lambda r: sum(v is not None for v in r.values()))
        for other in group:
            if other is best:
                continue
            for k, v in other.items():
                if k not in ("ord", "pipeline_id") and best[k] is None:
                    best[k] = v
            if len(other["company_name"]) > len(best["company_name"]):
                best["company_name"] = other["company_name"]
            gone.add(other["pipeline_id"])
    return [r for r in rows if r["pipeline_id"] not in gone]


def test_phone_merge_fills_and_keeps_longest_name(spark):
    df = leads(spark, [{"name": "Acme", "phone": "+1", "website": "w"},
                       {"name": "Acme Plumbing", "phone": "+1", "email": "e"}, {"name": "Other"}])
    got = {r.pipeline_id: r for r in exact_dedup.dedup_exact(df, "phone_normalized").collect()}
    assert set(got) == {"p0", "p2"}
    assert (got["p0"].company_name, got["p0"].website, got["p0"].email, got["p0"]["_absorbed"]) == ("Acme Plumbing", "w", "e", 1)


def test_most_complete_row_survives(spark):
    df = leads(spark, [{"name": "A", "phone": "+1"}, {"name": "A Corp", "phone": "+1", "website": "w", "email": "e"}])
    assert [r.pipeline_id for r in exact_dedup.dedup_exact(df, "phone_normalized").collect()] == ["p1"]
    assert [tuple(r) for r in exact_dedup.duplicate_map(df, "phone_normalized").collect()] == [("p0", "p1")]


def test_passes_are_sequential(spark):
    # the e-mail merged in by the phone pass links on; an e-mail that lost does not
    df = leads(spark, [{"phone": "+1", "website": "w"}, {"phone": "+1", "email": "a"}, {"email": "a"},
                       {"phone": "+2", "email": "b", "website": "w"}, {"phone": "+2", "email": "c"}, {"email": "c"}])
    assert {r.pipeline_id for r in exact_passes(df).collect()} == {"p0", "p3", "p5"}
    generic = exact_passes(df, ["A"])
    assert {r.pipeline_id for r in generic.collect()} == {"p0", "p2", "p3", "p5"}


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_passes_equal_model(spark, seed):
    rnd = random.Random(seed)
    pick = lambda *v: rnd.choice(v)
    rows = [{"name": "x" * rnd.randint(1, 6) + str(i), "phone": pick(None, "", "+1", "+2", "+3", f"+{i}"),
             "email": pick(None, "", "a", "b", f"e{i}"), "website": pick(None, "w"), "address": pick(None, f"s{i}")}
            for i in range(60)]
    df = leads(spark, rows)
    state = [r.asDict() for r in df.orderBy("ord").collect()]
    want = merge_model(merge_model(state, "phone_normalized"), "email")
    got = [r.asDict() for r in exact_passes(df).drop("_phone_absorbed", "_email_absorbed").orderBy("ord").collect()]
    assert got == want


def indel(a, b):
    return len(a) + len(b) - 2 * int(common_lengths([a], [b])[0])


def score(a, b, cutoff, scorer="token_set_ratio"):
    if scorer != "token_set_ratio":
        a, b = (" ".join(sorted(x.split())) if scorer == "token_sort_ratio" else x for x in (a, b))
        best = 100 - 100 * indel(a, b) / (len(a) + len(b))
        return int(best + 0.5) if best >= cutoff else 0
    left, right = sorted(set(a.split())), sorted(set(b.split()))
    both = [w for w in left if w in right]
    l, r = (" ".join(w for w in x if w not in both) for x in (left, right))
    if both and not (l and r):
        return 100
    s, gap = len(" ".join(both)), 1 if both else 0
    best = 100 - 100 * indel(l, r) / (2 * (s + gap) + len(l) + len(r))
    if both:
        best = max([best] + [100 - 100 * (1 + len(x)) / (2 * s + 1 + len(x)) for x in (l, r)])
    return int(best + 0.5) if best >= cutoff else 0


def greedy(named, auto, review, scorer):
    blocks, owner, flag, flags = {}, {}, {}, 0
    for o, n in named:
        bare = re.sub(r"^(the|a|an)\s+", "", n, flags=re.I).strip()
        blocks.setdefault(bare[0] if bare else "_", []).append((o, n))
    for group in blocks.values():
        gone = set()
        for x, (i, a) in enumerate(group):
            if i in gone:
                continue
            for j, b in group[x + 1:]:
                if j in gone:
                    continue
                s = score(a, b, review, scorer)
                if s >= auto:
                    owner[j] = i
                    gone.add(j)
                elif s >= review:
                    flag[j] = i
                    flags += 1
    return owner, {k: v for k, v in flag.items() if k not in owner}, flags


VOCAB = ("acme plumbing services service international north northern hvac heating and of co roofing "
         "electric electrical a ab best bests").split()


def noisy_names(rnd, n):
    def typo(s):
        s = list(s)
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            p = rnd.randrange(len(s))
            edit = rnd.random()
            s[p:p + (edit < 0.7)] = [] if edit < 0.4 else [rnd.choice("abcdeinrs ")]
            s = s or ["a"]
        return " ".join("".join(s).split())

    out = []
    for _ in range(n):
        words = rnd.choice([[], [], ["the"], ["an"]]) + rnd.choices(VOCAB, k=rnd.choice([1, 2, 2, 3, 3, 4, 5]))
        out.append(typo(" ".join(words)) or "a")
    return out


@pytest.mark.parametrize("seed,scorer,auto,review,first", [
    (1, "token_set_ratio", 90, 85, 10_000), (2, "token_set_ratio", 90, 85, 40),
    (3, "token_sort_ratio", 90, 80, 10_000), (4, "ratio", 88, 70, 60),
])
def test_fuzzy_equals_greedy_model(spark, seed, scorer, auto, review, first):
    named = list(enumerate(noisy_names(random.Random(seed), 250)))
    df = leads(spark, [{"name": n, "norm": n} for _, n in named])
    want_owner, want_flag, want_flags = greedy(named, auto, review, scorer)
    out, found = fuzzy_dedup.dedup_fuzzy(df, auto, review, scorer, first_batch=first, growth=4)
    got = {r.ord: r.owner_ord for r in fuzzy_dedup.record_owners(df, found, auto, scorer).collect()}
    assert got == want_owner
    assert {r.ord: r.flagged_by for r in fuzzy_dedup.flag_reviews(df, found, auto).collect()} == want_flag
    assert tuple(fuzzy_dedup.fuzzy_counters(found, auto).first()) == (len(want_owner), want_flags)
    rows = {r.ord: r for r in out.collect()}
    assert set(rows) == {o for o, _ in named} - set(want_owner)
    assert {o: int(r.is_duplicate_of[1:]) for o, r in rows.items() if r.needs_review} == want_flag


@pytest.mark.parametrize("whole", [None, True, False])
def test_candidate_pairs_lose_nothing(spark, whole):
    names = sorted(set(noisy_names(random.Random(9), 300)))
    df = leads(spark, [{"norm": n} for n in names])
    first = {}
    for i, n in enumerate(names):
        bare = re.sub(r"^(the|a|an)\s+", "", n).strip()
        first.setdefault((bare[:1] or "_", tuple(sorted(set(n.split())))), (i, n, bare[:1] or "_"))
    kept = sorted(first.values())
    want = {(i, j): s for x, (i, a, p) in enumerate(kept) for j, b, q in kept[x + 1:] if p == q and (s := score(a, b, 85))}
    assert {(r.i, r.j): r.score for r in fuzzy_dedup.candidate_pairs(df, whole=whole).collect()} == want


@pytest.mark.parametrize("scorer,cutoff,hot", [("token_set_ratio", 85, 0.02), ("token_sort_ratio", 88, 0.02), ("ratio", 90, 4.0), ("token_set_ratio", 70, 4.0)])
def test_keys_lose_nothing_however_hot(spark, monkeypatch, scorer, cutoff, hot):
    """Pairs of pieces that count as hot give way to triples, on both sides alike."""
    rnd = random.Random(int(cutoff))
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    names = {" ".join(word() for _ in range(rnd.randint(1, 4))) for _ in range(120)}
    for n in sorted(names):
        for _ in range(2):
            letters = list(n)
            for _ in range(rnd.randint(1, 3)):
                letters[rnd.randrange(len(letters))] = rnd.choice(["", "a", "b", "xy", " "])
            names.add(" ".join("".join(letters).split()) or "a")
    blocks = {}
    rows = sorted(names)
    for i, n in enumerate(rows):
        key = tuple(sorted(set(n.split()))) if scorer == "token_set_ratio" else tuple(sorted(n.split())) if scorer == "token_sort_ratio" else n
        blocks.setdefault(re.sub(r"^(the|a|an)\s+", "", n)[:1], {}).setdefault(key, (i, n))
    want = {}
    for group in blocks.values():
        kept = sorted(group.values())
        for x, (i, a) in enumerate(kept):
            want.update({(i, j): s for j, b in kept[x + 1:] if (s := score(a, b, cutoff, scorer))})
    monkeypatch.setattr(name_keys, "HOT", hot)
    keys = name_keys.NameKeys(float(cutoff), scorer)
    df = leads(spark, [{"norm": n} for n in rows])
    classes = fuzzy_dedup.name_classes(df, scorer)
    sized = classes.select("rep", "block", "tokens", "members", fuzzy_dedup._length_band(keys).alias("band"))
    by_block = {}
    for r in sized.collect():
        by_block.setdefault(r.block, []).append(r)
    met = set()
    for block, rs in by_block.items():
        held = Counter(g for r in rs for size in (2, 3) for g in set(keys.grams(list(r.tokens), size)))
        tokens = Counter(t for r in rs for t in set(r.tokens))
        n = len(rs)
        bands = Counter(r.band for r in rs)
        groups = {"band": np.array([r.band for r in rs]), "whole": np.zeros(n, bool), "whole_above": np.zeros(n, bool), "cell": np.zeros(n, int),
                  "cells": np.ones(n, int), "cells_below": np.array([int(bands[r.band - 1] > 0) for r in rs]), "names": np.full(n, n)}
        probe, index = keys.batch_keys([block] * n, [list(r.tokens) for r in rs], groups, [tokens] * n, [held] * n)
        probe, index = [set(x.tolist()) for x in probe], [set(x.tolist()) for x in index]
        met |= {(min(a.rep, b.rep), max(a.rep, b.rep)) for x, a in enumerate(rs) for y, b in enumerate(rs) if x != y and probe[x] & index[y]}
    assert want and set(want) <= met


def test_one_token_in_every_name(spark):
    # a third and more of all names share a word and match by it: one leader takes them all
    names = ["services"] + [f"services {'x' * (i % 7 + 1)}{i}" for i in range(200)]
    df = leads(spark, [{"name": n, "norm": n} for n in names])
    out, found = fuzzy_dedup.dedup_fuzzy(df, first_batch=20)
    assert out.count() == 1
    assert found.leader_pairs.count() < 600


def test_no_cross_join_in_candidates(spark):
    classes = fuzzy_dedup.with_keys(fuzzy_dedup.name_classes(leads(spark, [{"norm": "acme"}])))
    plan = fuzzy_dedup.scored_pairs(classes, classes)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_empty_and_nameless(spark):
    df = leads(spark, [{"name": "", "norm": ""}, {"name": " ", "norm": None}])
    out, found = fuzzy_dedup.dedup_fuzzy(df)
    assert out.count() == 2 and found.leaders.count() == 0


def test_common_lengths_against_tables():
    rnd = random.Random(6)

    def text():
        return "".join(rnd.choice("abcd éü😀") for _ in range(rnd.choice([0, 1, 7, 30, 62, 63, 64, 130])))

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for k, y in enumerate(b):
                row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
        return row[-1]

    left, right = [text() for _ in range(120)], [text() for _ in range(120)]
    assert common_lengths(left, right).tolist() == [table(a, b) for a, b in zip(left, right, strict=True)]
    assert common_lengths([], []).tolist() == []


@pytest.mark.parametrize("one_walk", [0, 40, fuzzy_dedup.ONE_WALK])
def test_leaders_by_rounds_and_by_one_walk(spark, monkeypatch, one_walk):
    cut, written = fuzzy_dedup.cut_lineage, []
    monkeypatch.setattr(fuzzy_dedup, "ONE_WALK", one_walk)
    monkeypatch.setattr(fuzzy_dedup, "cut_lineage", lambda df: written.append(df) or cut(df))
    draw = random.Random(7)
    chain = [(n, n + 1) for n in range(100, 112)]
    pairs = sorted({*chain, *(tuple(sorted(draw.sample(range(60), 2))) for _ in range(90))})
    taken = set()
    for i, j in pairs:
        if i not in taken:
            taken.add(j)
    nodes = [*range(60), *range(100, 115)]
    graph = spark.createDataFrame(pairs, "i bigint, j bigint")
    got = fuzzy_dedup.first_independent(graph, spark.createDataFrame([(n,) for n in nodes], "rep bigint"))
    assert sorted(r.rep for r in got.collect()) == [n for n in nodes if n not in taken]
    assert bool(written) == (one_walk < len(pairs))
    none = fuzzy_dedup.first_independent(graph.limit(0), spark.createDataFrame([(3,)], "rep bigint"))
    assert [r.rep for r in none.collect()] == [3]


@pytest.mark.parametrize("judged", [False, True])
def test_groups_know_their_neighbours(spark, judged):
    held = {("a", 3): 300, ("a", 4): 10, ("a", 5): 2000, ("a", 7): 200, ("b", 4): 5, ("b", 9): 100, ("c", 2): 1}
    if judged:
        whole = {g: n % 4 == 0 for g, n in held.items()}
        given = spark.createDataFrame([(*g, n, whole[g]) for g, n in held.items()], "block string, band int, n bigint, whole boolean")
        found = fuzzy_dedup.name_groups(None, given)
    else:
        whole = {(b, k): n + held.get((b, k - 1), 0) <= fuzzy_dedup.FEW for (b, k), n in held.items()}
        found = fuzzy_dedup.name_groups(spark.createDataFrame([g for g, n in held.items() for _ in range(n)], "block string, band int"))
    got = {(r.block, r.band): (r.n, r.n_below, r.whole, r.whole_above, r.cells, r.cells_below, r.names) for r in found.collect()}
    cells = lambda n: -(-n // fuzzy_dedup.CELL)
    assert got == {
        (b, k): (n, below := held.get((b, k - 1), 0), whole[b, k], whole.get((b, k + 1), True), cells(n), cells(below),
                 sum(m for (c, _), m in held.items() if c == b)) for (b, k), n in held.items()}
