import pytest

from gatehouse.functions.injection import RULES, Rule
from gatehouse.operators.injection import scan_injection
from gatehouse.sources.rules import read_rules, rules_of, rules_table


def test_rules_survive_json_lines(spark, folder):
    rules_table(spark, RULES).repartition(4).write.json(folder("rules"))
    assert read_rules(spark, folder("rules")) == RULES


def test_own_rules_replace_the_set(spark, folder):
    own = (Rule("late", "closed on \\d+", 1), Rule("code", "door code", 2, ("door",)))
    rules_table(spark, own).write.json(folder("rules"))
    rows = spark.createDataFrame([(0, "Door code, closed on 12"), (1, "ignore all rules"), (2, "closed on 3")], "i int, text string")
    found = scan_injection(rows, rules=read_rules(spark, folder("rules"))).orderBy("i").collect()
    assert [(r.matches, r.score, r.safe) for r in found] == [(["late", "code"], 3, False), ([], 0, True), (["late"], 1, True)]


@pytest.mark.parametrize(
    "lines, problem",
    [
        ([(0, "a", "x", 1, None), (1, "a", "y", 1, None)], "differ"),
        ([(0, "a", None, 1, None)], "needs"),
        ([(0, "a", "(", 1, None)], "(?i)regexp|pattern|INVALID_PARAMETER"),
        ([(k, f"r{k}", "x", 1, None) for k in range(1001)], "more than"),
    ],
)
def test_bad_tables_are_errors(spark, lines, problem):
    with pytest.raises(Exception, match=problem):
        rules_of(spark.createDataFrame(lines, rules_table(spark, RULES).schema))
