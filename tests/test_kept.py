"""Kept answers: only new questions are solved, and a new version forgets."""

from pyspark.sql import functions as F

from pathweave.operators.kept import answered


def test_only_new_questions_are_solved(spark, tmp_path):
    path, solved = str(tmp_path / "kept"), []

    def solve(q):
        solved.append(sorted((tuple(r) for r in q.collect()), key=repr))
        return q.withColumns({"length": F.length(F.concat_ws("", "a", "b")), "none": F.lit(None).cast("string")})

    def ask(version, *rows):
        asked = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, a string, b string")
        return [tuple(r) for r in answered(path, version, asked, ("a", "b"), solve).orderBy("n").collect()]

    assert ask("v1", ("x", "yy"), ("x", None), ("x", "yy")) == [(0, "x", "yy", 3, None, False), (1, "x", None, 1, None, False), (2, "x", "yy", 3, None, False)]
    assert set(solved.pop()) == {("x", "yy"), ("x", None)}
    assert ask("v1", ("x", None), ("x", "yy")) == [(0, "x", None, 1, None, True), (1, "x", "yy", 3, None, True)] and not solved
    assert ask("v1", ("x", "yy"), ("new", "")) == [(0, "x", "yy", 3, None, True), (1, "new", "", 3, None, False)]
    assert solved.pop() == [("new", "")]
    assert ask("v1", ("new", ""))[0][-1] and not solved
    assert not ask("v2/other", ("new", ""))[0][-1] and solved.pop()
    assert not ask("v1", ("new", ""))[0][-1]  # the first version was forgotten
    assert ask("v1") == []
