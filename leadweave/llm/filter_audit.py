"""How filters interact: what each removes in every order, and its Shapley share of all removals.

Every document is read once and becomes five bits, one per filter it fails; texts are not
shuffled. Counts by part and set of failed filters (and by label) hold all there is to know:
a coalition of filters removes the documents whose set meets it, so the removals of all 32
coalitions of a part are sums over its 32 counts. A step of an order is the difference of two
coalitions, with and without its filter.

Shapley values are the additive model nearest to the coalition removals: least squares over all
proper coalitions S of n filters, weighted by the kernel (n - 1) / (C(n, |S|) |S| (n - |S|)),
with values bound to sum to what all filters remove together. The normal equations with that
constraint are solved in rationals; as they are the same for every part, they are solved once
for each coalition's unit vector, which gives whole-number weights (times n!) that are applied
to the table of removals.

Defined results: NULL texts are empty, NULL parts the empty string. A copy is a row whose text
equals that of a row with a smaller id; rows without an id, and repeated rows of the smallest,
are no copies. A label counts where any label row of the id has it; labels without id don't.
Other columns are ignored; an empty table gives no rows."""

from __future__ import annotations

from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.common import written

SALTS = 16


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions that look at a text alone."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failed_sets(docs: DataFrame, labels: DataFrame, copies: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, failed (bits in order of the filters' letters, copies last), good, toxic, n: one
    row per combination that occurs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    filters = text_filters(F.col("text"))
    if copies in filters or sorted([*filters, copies]) != [*filters, copies]:
        raise ValueError("the filter of copies comes last")
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters.values())), F.lit(0))
    rows = written(given.select("id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "failed-sets")
    seen = written(rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "least"), "repeated")
    # a text may be that of a third of all rows: its rows are dealt out by their id
    spread = seen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    mine = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    judged = rows.withColumn("salt", mine).join(spread, ["digest", "salt"], "left")
    copy = F.when(F.col("id") > F.col("least"), 1 << len(filters)).otherwise(0)
    judged = judged.select("id", "part", (F.col("bits") + copy).alias("failed"))
    marked = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id")).agg(
        (F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return judged.join(marked, "id", "left").groupBy(
        "part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic")).agg(F.count(F.lit(1)).alias("n"))


def coalition_table(sets: DataFrame, n: int) -> DataFrame:
    """part, total, and for each coalition (by its bits, from 0) how many documents, good and
    toxic ones it removes: the arrays removed, good, toxic."""
    def meeting(of: Column | None = None) -> Column:
        count = F.col("n") if of is None else F.when(of, F.col("n")).otherwise(0)
        return F.array(*[F.sum(F.when(F.col("failed").bitwiseAND(F.lit(s)) != 0, count).otherwise(0)) for s in range(1 << n)])

    return sets.groupBy("part").agg(
        F.sum("n").alias("total"), meeting().alias("removed"), meeting(F.col("good")).alias("good"), meeting(F.col("toxic")).alias("toxic"))


def _solve(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """Solutions of matrix * x = b for every column b of ``right``, by elimination."""
    rows = [list(a) + list(b) for a, b in zip(matrix, right, strict=True)]
    size = len(rows)
    for k in range(size):
        pivot = next(r for r in range(k, size) if rows[r][k] != 0)
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(size):
            if r != k and rows[r][k] != 0:
                times = rows[r][k]
                rows[r] = [x - times * y for x, y in zip(rows[r], rows[k], strict=True)]
    return [row[size:] for row in rows]


def shapley_weights(n: int) -> list[list[int]]:
    """weights[f][S]: filter f's value times n! is the sum over coalitions S of weight times
    removals, by constrained least squares in rationals."""
    whole = (1 << n) - 1
    kernel = {s: Fraction(n - 1, comb(n, s.bit_count()) * s.bit_count() * (n - s.bit_count())) for s in range(1, whole)}
    inside = lambda f, s: s >> f & 1
    normal = [[sum(w * inside(f, s) * inside(g, s) for s, w in kernel.items()) for g in range(n)] + [Fraction(1)] for f in range(n)]
    normal.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel[s] * inside(f, s) if s in kernel else Fraction(0) for s in range(whole + 1)] for f in range(n)]
    right.append([Fraction(int(s == whole)) for s in range(whole + 1)])
    weights = [[x * factorial(n) for x in row] for row in _solve(normal, right)[:n]]
    if any(x.denominator != 1 for row in weights for x in row):
        raise ArithmeticError("the weights are not whole numbers")
    return [[int(x) for x in row] for row in weights]


def steps_of_orders(table: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, of a ``coalition_table``."""
    n = len(letters)
    whole, weights = (1 << n) - 1, shapley_weights(n)
    shares = F.array(*[sum((F.lit(w) * F.col("removed")[s] for s, w in enumerate(row) if w), F.lit(0).cast("long")) for row in weights])
    plan = []
    for order in permutations(range(n)):
        before = 0
        for step, f in enumerate(order):
            plan.append(F.struct(
                F.lit("".join(letters[k] for k in order)).alias("filter_order"), F.lit(step + 1).alias("step"),
                F.lit(f).alias("f"), F.lit(before).alias("before"), F.lit(before | 1 << f).alias("after")))
            before |= 1 << f
    rows = table.withColumn("shares", shares).select("*", F.inline(F.array(*plan)))

    def here(name: str) -> Column:
        return F.col(name)[F.col("after")] - F.col(name)[F.col("before")]

    alone = F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), F.col("f") + 1)
    return rows.select(
        "part", "filter_order", "step", (F.col("total") - F.col("removed")[F.col("after")]).alias("kept"), here("removed").alias("removed"),
        (F.col("removed")[alone] - here("removed")).alias("redundant"),
        (F.col("removed")[whole] - F.col("removed")[F.lit(whole) - alone]).alias("unique_fails"),
        here("good").alias("good_lost"), here("toxic").alias("toxic_lost"), F.col("shares")[F.col("f")].alias("shapley"))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """part, filter_order, step and the counts of that step, zeros included."""
    sets = failed_sets(docs, labels, **columns)
    return steps_of_orders(coalition_table(written(sets, "failed-counts"), 5), "ABCDE")
