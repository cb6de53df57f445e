"""Expansions of more rounds than their SQL holds, against the same SQL with as many rounds as the graph takes."""

import pytest

from evencut.plans import oracle, queries
from tests.compare import same, sql_rows

THETA, ENOUGH = 20, 40


@pytest.fixture
def few_a_round(monkeypatch):
    """Both sides expand few vertices a round, so that sf0.001 takes over 14."""
    for module in (oracle, queries):
        monkeypatch.setattr(module, "THETA", THETA)
    short = oracle.sqls()
    monkeypatch.setattr(oracle, "ROUNDS", ENOUGH)
    return short, oracle.sqls()


def test_full_expansion_beyond_the_rounds_of_its_sql(spark, few_a_round):
    short, whole = few_a_round
    n = sql_rows(oracle.query(oracle.base(), "SELECT n FROM nv"), "sf0.001")[1][0][0]
    assert len(sql_rows(short["expansion_full"], "sf0.001")[1]) < n == len(sql_rows(whole["expansion_full"], "sf0.001")[1])
    same(spark, "expansion_full", queries.expansion_full, whole["expansion_full"])


def test_report_beyond_the_rounds_of_its_sql(spark, few_a_round):
    short, whole = few_a_round
    assert sql_rows(short["expansion_report"], "sf0.001") != sql_rows(whole["expansion_report"], "sf0.001")
    same(spark, "expansion_report", queries.expansion_report, whole["expansion_report"])


def test_leftovers_beyond_the_rounds_of_their_sql(spark, few_a_round):
    short, whole = few_a_round
    assert not sql_rows(short["leftover_assign"], "sf0.001")[1] and sql_rows(whole["leftover_assign"], "sf0.001")[1]
    same(spark, "leftover_assign", queries.leftover_assign, whole["leftover_assign"])
