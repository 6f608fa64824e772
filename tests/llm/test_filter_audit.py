import random
from fractions import Fraction
from itertools import combinations, permutations
from math import factorial

from leadweave.llm import filter_audit as A
from leadweave.llm import queries as Q


def plain_fails(rows):
    """[(part, failed letters, id)] by the definitions."""
    out = []
    for i, text, lang in rows:
        t = text or ""
        w, seen = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x], set()
        if len(w) < 200:
            seen.add("A")
        if 100 * len(set(w)) < 50 * len(w):
            seen.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t):
            seen.add("C")
        if any(c in "#$%&*|" for c in t):
            seen.add("D")
        if i is not None and any((u or "") == t and j is not None and j < i for j, u, _ in rows):
            seen.add("E")
        out.append((lang or "", seen, i))
    return out


def plain_audit(rows, good, toxic):
    out, fails = {}, plain_fails(rows)
    for part in {p for p, _, _ in fails}:
        mine = [(s, i) for p, s, i in fails if p == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                gone = [x for x in mine if x[0] & set(order[:step])]
                here = [x for x in mine if f in x[0] and not x[0] & set(order[:step])]
                removed_of[f] += len(here)
                out[part, "".join(order), step + 1] = [
                    len(mine) - len(gone) - len(here), len(here), sum(f in s for s, _ in gone), sum(s == {f} for s, _ in mine),
                    sum(i in good for _, i in here), sum(i in toxic for _, i in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return out


def documents(prose):
    rng = random.Random(4)
    rows = [(k, prose(k, rng.choice([20, 250])).upper() if k % 7 == 0 else prose(k, rng.choice([20, 250])) + ("#" if k % 5 == 0 else ""), rng.choice(["en", "de", None])) for k in range(40)]
    rows += [(100 + k, rows[3][1], "en") for k in range(25)]  # a third of all rows is one text
    rows += [(200, "one two " * 150, "fr"), (201, None, "fr"), (202, "", "fr"), (202, "", "fr"), (None, None, None), (None, rows[3][1], "en"), (203, " \n\t", "de")]
    rng.shuffle(rows)
    return rows


def test_audit_against_definitions(spark, prose):
    rows = documents(prose)
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 120, 2)] + [(4, None, None), (None, 1, 1), (6, 1, 0), (6, 0, 1)]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, lang string, failed string, n string").repartition(4)
    table = A.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in table}
    assert len(table) == len(got) and got == plain_audit(rows, good, toxic)


def test_weights_are_the_shapley_weights():
    for n in (2, 3, 5):
        rows = A.shapley_weights(n)
        rng = random.Random(n)
        worth = [0] + [rng.randrange(1000) for _ in range((1 << n) - 1)]
        for f in range(n):
            others = [k for k in range(n) if k != f]
            want = sum(
                Fraction(factorial(size) * factorial(n - size - 1)) * (worth[sum(1 << k for k in c) | 1 << f] - worth[sum(1 << k for k in c)])
                for size in range(n) for c in combinations(others, size))
            assert sum(w * v for w, v in zip(rows[f], worth, strict=True)) == want


def test_odd_documents(spark, odd_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    out = A.audit(odd_docs, labels)
    parts = odd_docs.selectExpr("coalesce(lang, '') lang").distinct().count()
    assert out.count() == 600 * parts and out.filter("kept < 0 or redundant < 0").count() == 0
    assert A.audit(odd_docs.limit(0), labels).count() == 0
    assert A.audit(odd_docs, labels.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_text_ids(spark):
    docs = spark.createDataFrame([("b", "same", "en"), ("a", "same", "en"), ("c", "other", "en")], "doc_id string, text string, lang string")
    labels = spark.createDataFrame([("b", 1, 0)], "doc_id string, quality int, toxic int")
    last = A.audit(docs, labels).filter("filter_order = 'EABCD' and step = 1").first()
    assert (last.removed, last.good_lost, last.kept) == (1, 1, 2)
    assert set(Q.ORACLES) >= {"op11_vector_codes", "op13_filter_audit"}
