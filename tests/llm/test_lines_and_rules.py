from collections import Counter, defaultdict

from leadweave.llm import line_dedup as L
from leadweave.llm import quality_rules as R


def test_line_dedup_by_site(spark, odd_docs):
    rows = [(k, "shop", f"Menu\nunique {k}\n  Menu\t\n\nall rights") for k in range(9)]
    rows += [(k, "shop", f"plain {k}") for k in range(9, 12)] + [(20, "blog", "Menu\nunique"), (21, None, "Menu"), (22, "shop", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in L.judged_lines(df, ratio=0.5).collect()}
    assert got[3] == ("unique 3\n", 5, 3)
    assert got[10] == ("plain 10", 1, 0) and got[20] == ("Menu\nunique", 2, 0) and got[21] == ("Menu", 1, 0)
    assert got[22] == (None, 0, 0) and len(got) == len(rows)
    assert L.judged_lines(df, ratio=0.8).agg({"n_dropped": "sum"}).first()[0] == 0
    only = spark.createDataFrame([(k, "s", "same") for k in range(6)] + [(7, None, "x")] * 6, "doc_id long, source string, text string")
    assert {r.text for r in L.judged_lines(only).collect()} == {""}
    kept = L.drop_boilerplate(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert L.drop_boilerplate(odd_docs.limit(0)).count() == 0


def plain_rules(rows, max_docs, share):
    def lines(text):
        return [x for x in (text or "").split("\n") if x.split()]

    def norm(line):
        return " ".join(line.split()).lower()

    docs, seen = Counter(h for _, h, _ in rows), defaultdict(Counter)
    for _, h, t in rows:
        seen[h].update({norm(x) for x in lines(t)})
    out = []
    for d, h, t in rows:
        w = (t or "").split()
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lost = sum(len(x.split()) for x in lines(t) if (n := seen[h][norm(x)]) > max_docs and n > share * docs[h])
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        out.append((d, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines(t)) - len(set(lines(t))),
                    len(repeated), failed, lost, not failed and len(w) - lost >= max(0.5 * len(w), 10)))
    return sorted(out, key=str)


def test_rules_against_brute_force(spark, prose):
    footer = "Subscribe to the letter and follow us on every channel that there is today"
    rows = [(k, "a", prose(k, 30) + ("\n" + footer.upper() if k % 2 else f"\n  {footer} ")) for k in range(30)]
    rows += [(40 + k, "a", footer + "\n" + footer + "\nshort") for k in range(3)] + [(50, "b", footer + "\n" + prose(50, 20)), (51, None, footer)]
    rows += [(60, "a", None), (61, "a", ""), (62, "b", "x " * 40), (63, "b", "é# ü|$ " * 3 + prose(63, 30)), (63, "b", "same\nsame\n\n\nSame\n" + prose(64, 20)), (None, None, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert sorted(map(tuple, R.judge(df).collect()), key=str) == plain_rules(rows, 20, 0.1)


def test_rules_on_odd_rows(spark, odd_docs):
    assert R.judge(odd_docs).count() == odd_docs.count()
    assert R.judge(odd_docs.limit(0)).count() == 0
