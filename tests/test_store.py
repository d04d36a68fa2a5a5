"""Intermediate tables go when nothing reads them any more."""

import os

from pyspark.sql import functions as F

from huescape.store import Stored, roots, scope, shared_dir, stored, tidy, work_path


def left(spark):
    """Tables in the application's folder."""
    folder = work_path(spark, "x").rsplit("/", 1)[0].removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_scopes(spark):
    before = left(spark)

    @tidy
    def inner():
        a, b = stored(spark.range(5), "a"), stored(spark.range(3), "b")
        c = stored(a.join(b, "id"), "c")
        return c.join(b, "id").withColumn("x", F.lit(1))

    with scope() as s:
        out = inner()
        assert {t.split("-")[0] for t in left(spark) - before} == {"b", "c"}
        assert roots(out) == left(spark) - before
        last = Stored(out.where("id > 0"), "last")
        s.keep(last.df)
    assert left(spark) - before == {last.path.rsplit("/", 1)[1]} and last.df.count() == 2
    last.drop()
    last.drop()
    assert left(spark) == before


def test_scope_after_an_error(spark):
    before = left(spark)

    @tidy
    def broken():
        stored(spark.range(5), "a")
        raise ValueError

    try:
        broken()
    except ValueError:
        pass
    assert left(spark) == before and shared_dir(spark)
