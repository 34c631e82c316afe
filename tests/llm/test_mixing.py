import hashlib
from collections import defaultdict

import pytest
from comparing import DATA
from pyspark.sql import functions as F

from tallyweave.llm import mixing
from tallyweave.llm.queries import OP2_SQL, op2_mixing


def test_query_same_as_sql(same_as_sql):
    same_as_sql(op2_mixing, OP2_SQL, DATA / "sf0.01")


def fill(budget, capacity, weight):
    """Hand out by weight again and again, until nothing is left or all are full."""
    given = dict.fromkeys(capacity, 0.0)
    while budget > 1e-9 and (open_ := [c for c in capacity if weight[c] > 0 and given[c] < capacity[c] - 1e-9]):
        total, left = sum(weight[c] for c in open_), 0.0
        for c in open_:
            part = budget * weight[c] / total
            taken = min(part, capacity[c] - given[c])
            given[c] += taken
            left += part - taken
        budget = left
    return given


@pytest.mark.parametrize("total", [10.0, 60.0, 120.0, 1000.0])
def test_budgets_and_prefixes(spark, total):
    docs = [(i, "abc"[i % 3] if i % 7 else None, "xy"[i % 2], i % 5) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, domain string, language string, n int")
    weights = {"domain": spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.0)], "domain string, weight double"), "language": None}
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(df, {"domain": F.col("domain"), "language": F.col("language")}, weights, total=total, most_epochs=2, seed=3, tokens=F.col("n")).collect()}
    leaf = defaultdict(list)
    for i, d, l, n in docs:
        leaf[d, l].append((i, n))
    size = {k: sum(n for _, n in v) for k, v in leaf.items()}
    top = {d: 2.0 * sum(s for (x, _), s in size.items() if x == d) for d in {k[0] for k in leaf}}
    given = fill(total, top, {"a": 0.5, "b": 0.3, "c": 0.0, None: 1.0})
    expected = {}
    for d in top:
        own = {k: 2.0 * s for k, s in size.items() if k[0] == d}
        for k, budget in fill(given[d], own, dict.fromkeys(own, 1.0)).items():
            epochs = int(budget / size[k] + 1e-9) if size[k] else 0
            rest = budget - epochs * size[k]
            more, used = set(), 0
            for i, n in sorted(leaf[k], key=lambda x: hashlib.md5(f"3:{epochs}:{x[0]}".encode()).hexdigest()):
                used += n
                if rest <= 1e-9 or used > rest + 1e-9:
                    break
                more.add(i)
            expected |= {i: epochs + (i in more) for i, _ in leaf[k]}
    assert got == expected


def test_odd_rows(odd, nothing):
    levels = {"language": F.col("lang"), "origin": F.col("source")}
    rows = mixing.mix(odd, levels, most_epochs=2).collect()
    assert len(rows) == odd.count()
    assert mixing.mix(nothing, levels).count() == 0
    taken = mixing.mixed(odd, levels, total=float(sum(r["n_tokens"] for r in rows)) * 2, most_epochs=2)
    assert taken.columns == odd.columns
    assert taken.count() == 2 * odd.count()
    assert mixing.mixed(nothing, levels).count() == 0


def test_plan_of_budgets_grows_with_the_levels(spark):
    levels = ["a", "b", "c", "d"]
    rows = [("xy"[i % 2], "pq"[i % 3 % 2] if i % 5 else None, str(i % 2), str(i), i % 4, 10 * (i % 6)) for i in range(40)]
    leaves = spark.createDataFrame(rows, "a string, b string, c string, d string, n_docs long, n_tokens long")
    weights = {"b": spark.createDataFrame([("x", "p", 0.7), ("x", None, 0.0), ("y", None, 2.0)], "a string, b string, weight double")}
    out = mixing.budgets(leaves, levels, weights, 700.0, 2)
    weight, given = {("x", "p"): 0.7, ("x", None): 0.0, ("y", None): 2.0}, {(): 700.0}
    for n in range(1, 5):
        capacity = defaultdict(float)
        for r in rows:
            capacity[r[:n]] += 2.0 * r[5]
        parts = [(budget, {k: c for k, c in capacity.items() if k[:-1] == top}) for top, budget in given.items()]
        given = {k: v for budget, own in parts for k, v in fill(budget, own, {k: weight.get(k, 1.0) for k in own}).items()}
    got = {tuple(r)[:4]: r["budget"] for r in out.collect()}
    assert got == pytest.approx(given) and len(got) == out.count() == 40
    # a scan, a join and a few windows a level; a level joined with a table made from itself doubled them each time
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") <= 4 * len(levels) and plan.count("Join ") <= 2 * len(levels)


def test_children_with_the_same_capacity_for_weight(spark):
    rows = [("a", 1.0, 30.0), ("b", 2.0, 60.0), ("c", 1.0, 30.0), ("d", 0.0, 5.0), ("e", 1.0, 90.0)]
    children = spark.createDataFrame([(0, 100.0, *r) for r in rows], "top int, budget double, name string, weight double, capacity double")
    got = {r["name"]: r["part"] for r in mixing.share(children, ["top"], "budget", "weight", "capacity", "part").collect()}
    assert got == pytest.approx({"a": 20.0, "b": 40.0, "c": 20.0, "d": 0.0, "e": 20.0})
