import pytest
from pyspark.sql import functions as F

from twinline.operators.user_map import failed, made, tokenize_with

SCHEMA = "k long, ids array<int>, note struct<a:string,b:double>"


def users_function():
    # Made here, so that it goes to the tasks as it is: they cannot import this file.
    def whole(batch):
        """Drops multiples of 5, doubles multiples of 3, fails on multiples of 7 and on nulls."""
        out = {"k": [], "ids": [], "note": []}
        for k, text in zip(batch["k"], batch["text"]):
            if k % 7 == 0:
                raise KeyError(k)
            for _ in range(0 if k % 5 == 0 else 2 if k % 3 == 0 else 1):
                out["k"].append(k)
                out["ids"].append([len(w) for w in text.split()])
                out["note"].append({"a": text[:1], "b": None})
        return out

    return whole


def table(spark, n=100):
    rows = [(k, None if k == 50 + 1 else "ab c" * (k % 4), k * 1.0) for k in range(n)]
    return spark.createDataFrame(rows, "k long, text string, other double")


@pytest.mark.parametrize("parts", [1, 4, 17])
@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_rows_do_not_depend_on_batches(spark, parts, batch):
    df = table(spark).repartition(parts)
    mapped = tokenize_with(df, users_function(), SCHEMA, columns=["k", "text"], batch=batch)
    rows = sorted((r.k, r.ids, r.note.a) for r in made(mapped).collect())
    fine = [k for k in range(100) if k % 7 and k % 5 and k != 51]
    expected = [(k, [len(w) for w in ("ab c" * (k % 4)).split()], ("ab c" * (k % 4))[:1]) for k in fine for _ in range(2 if k % 3 == 0 else 1)]
    assert rows == sorted(expected)
    bad = {r.k: r.error for r in failed(mapped).collect()}
    assert set(bad) == {k for k in range(100) if k % 7 == 0} | {51}
    assert bad[7] == "KeyError: 7" and bad[51].startswith("AttributeError")
    assert failed(mapped).columns == ["k", "text", "error"]


def test_results_that_are_not_as_declared(spark):
    df = table(spark, 6)

    def odd(batch):
        out = {"k": list(batch["k"]), "ids": [[1]] * len(batch["k"]), "note": [None] * len(batch["k"])}
        if 1 in batch["k"]:
            out["ids"][batch["k"].index(1)] = ["no number"]
        if 2 in batch["k"]:
            out["k"].append(9)
        if 3 in batch["k"]:
            out["more"] = out["k"]
        return out

    mapped = tokenize_with(df, odd, SCHEMA)
    assert sorted(r.k for r in made(mapped).collect()) == [0, 4, 5]
    assert {r.k for r in failed(mapped).collect()} == {1, 2, 3}


def test_the_job_stops_when_code_cannot_be_loaded(spark):
    def broken(batch):
        import no_such_package  # noqa: F401

    with pytest.raises(Exception, match="no_such_package"):
        tokenize_with(table(spark, 3), broken, SCHEMA).collect()


def test_empty_table_and_clashing_names(spark):
    assert tokenize_with(table(spark).limit(0), users_function(), SCHEMA).collect() == []
    with pytest.raises(ValueError):
        tokenize_with(table(spark), users_function(), "_error string")
    assert tokenize_with(table(spark, 2).withColumn("_error", F.lit(1)), lambda b: {"k": b["_error"]}, "k long").count() == 2
