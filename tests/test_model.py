import math

import pytest

from ruleloom.model import Condition, Node, Rule, RuleSet, interval


@pytest.fixture(scope="module")
def simple(spark):
    rows = [(0, 1.0, 2.0), (1, 3.0, 1.0), (2, 5.0, 3.0), (3, 7.0, 4.0), (4, float("nan"), 1.0), (5, None, 1.0)]
    return spark.createDataFrame(rows, "id long, x0 double, x1 double").cache()


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


def test_axis_conditions_and_nan(simple):
    assert ids(simple.filter(Condition.axis("x0", 3).column())) == [0, 1]
    # NaN and null satisfy neither direction
    assert ids(simple.filter(Condition.axis("x0", 3, 1).column())) == [2, 3]


def test_evaluate_is_never_null(simple):
    for direction in (-1, 1):
        got = [r[0] for r in simple.orderBy("id").select(Condition.axis("x0", 3, direction).evaluate()).collect()]
        assert got == [direction < 0] * 2 + [direction > 0] * 2 + [False] * 2


def test_axis_rules_reach_the_scan(spark, tmp_path, simple):
    simple.write.parquet(str(tmp_path / "t"))
    rule = Rule((Condition.axis("x0", 2, 1), Condition.axis("x0", 6)), 0)
    df = spark.read.parquet(str(tmp_path / "t")).filter(rule.column()).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x0,2.0)" in plan and "LessThanOrEqual(x0,6.0)" in plan and "x1" not in plan
    assert ids(df) == [1, 2]


def test_oblique(simple):
    c = Condition(("x0", "x1"), (-1.0, 1.0), 0.0, 1)  # x1 > x0
    assert ids(simple.filter(c.column())) == [0]


def test_direction_and_interval_are_checked():
    with pytest.raises(ValueError):
        Condition.axis("x0", 1, 0)
    with pytest.raises(ValueError):
        interval("x0", "[1, 2)")
    assert [(c.threshold, c.direction) for c in interval("x0", "(1.5, inf]")] == [(1.5, 1), (math.inf, -1)]


def test_trim_and_merge():
    rules = RuleSet((Rule(tuple(interval("x0", "(-inf, 3]")), 0), Rule(tuple(interval("x1", "(-inf, inf]")), 1))).trimmed()
    assert len(rules) == 1 and len(rules.rules[0].conditions) == 1
    merged = Rule((Condition.axis("x0", 1, 1), Condition.axis("x0", 2, 1), Condition.axis("x0", 9), Condition.axis("x0", 7)), 0).merged()
    assert merged.box() == {"x0": (2.0, 7.0)}


def test_display_unscales():
    assert Condition.axis("x0", 1.0).display({"x0": "depth"}, {"x0": (10.0, 2.0)}) == "depth ≤ 12.0"
    # dividing by a negative weight turns the relation
    assert Condition(("x0",), (-2.0,), 4.0, -1).display() == "x0 > -2.0"
    assert Condition(("x0", "x1"), (1.0, 0.5), 3.0, 1).display() == "x0 + 0.5 x1 > 3.0"


def tree():
    leaf = lambda i, d, y: Node(i, y, d)
    low = Node(1, depth=1, condition=Condition.axis("f0", 0), left=leaf(2, 2, 1), right=leaf(3, 2, 0))
    return Node(0, condition=Condition.axis("f0", 1), left=low, right=Node(4, depth=1, condition=Condition.axis("f1", 2), left=leaf(5, 2, 0), right=leaf(6, 2, 1)))


def test_paths_depth_and_leaves(spark):
    root = tree()
    assert [n.label for n in root.leaves()] == [1, 0, 0, 1]
    assert root.depth_below() == 2
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate([(0, 1), (0, 1), (1, 2), (1, 2), (2, 1), (2, 1), (2, 3), (2, 3)])]
    df = spark.createDataFrame(rows, "id long, f0 double, f1 double")
    assert [ids(df.filter(r.column())) for r in root.rules()] == [[0, 1], [2, 3], [4, 5], [6, 7]]
    assert root.to_dot().count("->") == 6
