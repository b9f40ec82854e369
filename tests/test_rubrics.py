"""Rubric files, the store of rule vectors, and corrections that are split into valid and rejected."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import review_log
from docloom.sources import rubrics

RULE = {"id": "R1", "category": "Skills", "rule": "Name tools.", "weight": 2.0, "rationale": "They are searched for."}


@pytest.fixture
def folder(tmp_path):
    for role in rubrics.ROLES:
        (tmp_path / f"{role}.json").write_text(json.dumps([RULE, RULE | {"id": f"{role}2", "weight": 1}], indent=1))
    return tmp_path


def test_rules_of_all_roles(spark, folder):
    rules = rubrics.read_all(spark, str(folder))
    assert rules.count() == 2 * len(rubrics.ROLES) and {r["role"] for r in rules.collect()} == set(rubrics.ROLES)
    with pytest.raises(ValueError, match="unknown role"):
        rubrics.read_role(spark, str(folder), "chef")
    (folder / "pm.json").write_text(json.dumps([RULE, {"id": "R9", "category": "Skills"}]))
    with pytest.raises(ValueError, match="R9.*rule,weight,rationale"):
        rubrics.read_role(spark, str(folder), "pm")
    with pytest.raises(FileNotFoundError):
        rubrics.read_file(spark, str(folder / "none.json"))


def test_store_is_built_once(spark, folder, tmp_path):
    rules, path = rubrics.read_role(spark, str(folder), "swe"), str(tmp_path / "store")
    sized = lambda n: lambda text: F.array(F.length(text).cast("double"), F.lit(float(n)))
    store = rubrics.build_store(rules, sized(1), path)
    first = {r["rule_id"]: r for r in store.collect()}
    assert first["R1"]["text"] == "Rule R1 [Skills | role=swe]: Name tools.\nRationale: They are searched for."
    assert first["R1"]["embedding"] == [float(len(first["R1"]["text"])), 1.0]
    assert {r["embedding"][1] for r in rubrics.build_store(rules, sized(2), path).collect()} == {1.0}
    assert {r["embedding"][1] for r in rubrics.build_store(rules, sized(3), path, rebuild=True).collect()} == {3.0}


def test_corrections_are_split(spark, tmp_path):
    rows = spark.createDataFrame([("a", "Skills", 1.0, 2.0), ("", "Skills", 1.0, 2.0), ("b", "Skills", 11.0, 2.0), ("c", None, 3.0, 2.0)], "cv_filename string, section string, auto_score double, human_score double")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    review_log.persist(rows, good, bad)
    assert [r["cv_filename"] for r in review_log.read(spark, good).collect()] == ["a"]
    assert {r["error"] for r in spark.read.json(bad).collect()} == {"cv_filename is required", "auto_score must be a number between 0 and 10", "section is required"}
    assert {(r["section"], r["n"]) for r in review_log.report(rows).collect()} == {("Skills", 3), ("Unknown", 1), ("All", 4)}
