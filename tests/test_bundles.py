"""Bundles: exported and imported, skipped, replaced, in conflict and damaged."""

import pytest

from turnloom.sources import bundles, store

KINDS = {"turns": "source_id string, id int, text string", "sessions": "source_id string, name string"}


def tables(spark, turns, sessions=()):
    return {"turns": spark.createDataFrame(list(turns), KINDS["turns"]).repartition(3), "sessions": spark.createDataFrame(list(sessions), KINDS["sessions"])}


def held(spark, path):
    now = bundles.current(spark, path, KINDS)
    return {k: sorted(map(str, map(tuple, v.collect()))) for k, v in now.items()}


def take(spark, bundle, path, how="error"):
    return {r.source_id: (r.action, r.reason) for r in bundles.import_bundle(spark, bundle, path, KINDS, how).collect()}


A = [("a", 1, "x"), ("a", 1, "x"), ("a", 2, None)]
B = [("b", 1, ""), ("b", None, "ü")]


def test_round_trip(spark, tmp_path):
    mine, path = tables(spark, A + B + [(None, 9, "nobody's")], [("a", "s")]), str(tmp_path / "store")
    name = bundles.export(mine, str(tmp_path / "one"))
    assert name == bundles.export(tables(spark, (A + B)[::-1], [("a", "s")]), str(tmp_path / "same")) != bundles.export(tables(spark, A[1:] + B, [("a", "s")]), str(tmp_path / "less"))
    assert take(spark, str(tmp_path / "one"), path) == {"a": ("import", "new_source"), "b": ("import", "new_source")}
    want = {"turns": sorted(map(str, A + B)), "sessions": [str(("a", "s"))]}
    assert held(spark, path) == want
    assert take(spark, str(tmp_path / "one"), path) == {"a": ("skip", "identical_payload"), "b": ("skip", "identical_payload")} and held(spark, path) == want
    # One source with other contents, one that the bundle hasn't, one new.
    bundles.export(tables(spark, A[1:] + [("c", 5, "new")], [("a", "s")]), str(tmp_path / "two"))
    with pytest.raises(ValueError, match="other contents of a"):
        take(spark, str(tmp_path / "two"), path)
    assert held(spark, path) == want
    assert take(spark, str(tmp_path / "two"), path, "skip") == {"a": ("skip", "conflict_skip"), "b": ("keep", "not_in_bundle"), "c": ("import", "new_source")}
    assert held(spark, path)["turns"] == sorted(map(str, A + B + [("c", 5, "new")]))
    assert take(spark, str(tmp_path / "two"), path, "replace")["a"] == ("replace", "conflict_replace")
    assert held(spark, path)["turns"] == sorted(map(str, A[1:] + B + [("c", 5, "new")]))
    assert bundles.export(mine, str(tmp_path / "b"), sources=["b"]) and take(spark, str(tmp_path / "b"), str(tmp_path / "other")) == {"b": ("import", "new_source")}


def test_damaged_bundles_leave_the_store_alone(spark, tmp_path):
    path = str(tmp_path / "store")
    for k, harm in enumerate(("payload", "missing", "manifest")):
        folder = str(tmp_path / f"bundle{k}")
        bundles.export(tables(spark, A + B), folder)
        if harm == "payload":
            spark.createDataFrame([("b", 7, "more")], KINDS["turns"]).write.mode("append").parquet(f"{folder}/payloads/turns/_of=b")
        elif harm == "missing":
            import shutil

            shutil.rmtree(f"{folder}/payloads/turns/_of=a")
        else:
            spark.createDataFrame([("z", "0", {"turns": 1})], bundles.MANIFEST).write.mode("append").parquet(f"{folder}/manifest")
        with pytest.raises(ValueError, match="isn't what its seal says" if harm == "manifest" else "differ from the manifest for " + ("b" if harm == "payload" else "a")):
            take(spark, folder, path)
        assert held(spark, path) == {"turns": [], "sessions": []}


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    bundles.commit(tables(spark, A), path)
    tables(spark, B)["turns"].write.parquet(f"{path}/version=2/turns")
    assert held(spark, path)["turns"] == sorted(map(str, A))
    assert bundles.commit(tables(spark, B), path) == 2 and held(spark, path)["turns"] == sorted(map(str, B))


def test_empty_bundle(spark, tmp_path):
    assert bundles.export(tables(spark, []), str(tmp_path / "none")) is None and take(spark, str(tmp_path / "none"), str(tmp_path / "store")) == {}


def test_a_source_whose_new_payload_is_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    store.replace(tables(spark, [*A, *B, ("c/d", 1, "y")])["turns"], path)
    store.replace(tables(spark, [("a", 3, "z")])["turns"], path, sources=["a", "b", "c/d", "never"])
    assert sorted((r.source_id, r.id) for r in spark.read.schema(KINDS["turns"]).parquet(path).collect()) == [("a", 3)]
