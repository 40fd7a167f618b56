"""Differences of stored tables against a comparison of all rows."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyrand.sources import hashtree as H

SCHEMA = "k long, a string, b double, tags array<string>"


def rows_of(n):
    return [(i, f"v{i % 7}", i / 3, ["x", None] if i % 5 else None) for i in range(n)]


def stored(spark, rows, folder, bits=4, schema=SCHEMA):
    H.write_hashed(spark.createDataFrame(rows, schema), str(folder), ["k"], bits=bits)
    (folder / "whole").touch()
    return str(folder)


def diff(spark, left, right):
    """By the trees; a comparison of the rows without them must tell the same."""
    got = {r.k: (r.change, r.columns) for r in H.tree_diff(spark, left, right, ["k"]).collect()}
    if all(os.path.exists(f"{f}/whole") for f in (left, right)):
        assert got == {r.k: (r.change, r.columns) for r in H.frames_diff(H.read_hashed(spark, left), H.read_hashed(spark, right), ["k"], bits=3).collect()}
    return got


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    return stored(spark, rows_of(400), tmp_path_factory.mktemp("trees") / "base")


def test_equal_rows_in_other_files_have_equal_trees(spark, base, tmp_path):
    other = stored(spark, rows_of(400)[::-1], tmp_path / "o")
    assert H.differing_leaves(spark, base, other) == [] and diff(spark, base, other) == {}
    assert sorted(r.k for r in H.read_hashed(spark, other).collect()) == list(range(400))


def test_a_node_is_the_sum_of_its_children(spark, base):
    tree = {(r.level, r.node): r for r in H._tree(spark, base).collect()}
    assert tree[0, 0].n == 400 and H.depth(spark, base) == 4
    for (level, node), r in tree.items():
        children = [tree[level + 1, c] for c in (2 * node, 2 * node + 1) if (level + 1, c) in tree]
        assert level == 4 or (r.n, r.a, r.b) == tuple(sum(getattr(c, x) for c in children) for x in "nab")


def test_changed_added_and_removed_keys(spark, base, tmp_path):
    rows = {r[0]: r for r in rows_of(400)}
    rows[3] = (3, "other", 1.0, rows[3][3])
    rows[10] = (10, rows[10][1], rows[10][2], ["x"])
    rows[11] = (11, None, rows[11][2], rows[11][3])
    del rows[20]
    rows[1000] = (1000, "new", 0.0, None)
    rows[None] = (None, "", None, [])
    other = stored(spark, list(rows.values()), tmp_path / "o")
    want = {3: ("changed", ["a"]), 10: ("changed", ["tags"]), 11: ("changed", ["a"]), 20: ("removed", []), 1000: ("added", []), None: ("added", [])}
    assert diff(spark, base, other) == want
    back = {k: ({"added": "removed", "removed": "added"}.get(c, c), names) for k, (c, names) in want.items()}
    assert diff(spark, other, base) == back


def test_only_differing_leaves_are_read(spark, base, tmp_path):
    rows = rows_of(400)
    rows[5] = (5, "changed", rows[5][2], rows[5][3])
    other = stored(spark, rows, tmp_path / "o")
    leaves = H.differing_leaves(spark, base, other)
    assert len(leaves) == 1
    # The other leaves' files may even be gone.
    os.remove(f"{other}/whole")
    for name in os.listdir(f"{other}/rows"):
        if name.startswith(f"{H.LEAF}=") and name != f"{H.LEAF}={leaves[0]}":
            shutil.rmtree(f"{other}/rows/{name}")
    assert diff(spark, base, other) == {5: ("changed", ["a"])}
    plan = H.tree_diff(spark, base, other, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [") >= 2 and f"{H.LEAF}#" in plan.split("PartitionFilters")[1]


def test_repeated_keys_are_multisets(spark, tmp_path):
    schema = "k long, a string, b string"
    one = [(1, "x", "p"), (1, "y", "q"), (2, "x", "p"), (2, "x", "p"), (3, "s", "s"), (3, "s", "s")]
    two = [(1, "x", "q"), (1, "y", "p"), (2, "x", "p"), (3, "s", "s"), (3, "s", "s")]
    a, b = stored(spark, one, tmp_path / "a", 2, schema), stored(spark, two, tmp_path / "b", 2, schema)
    assert diff(spark, a, b) == {1: ("changed", []), 2: ("changed", ["a", "b"])}


def test_new_columns_and_null_against_empty(spark, tmp_path):
    a = stored(spark, [(1, "", 1.0), (2, None, 2.0)], tmp_path / "a", 1, "k long, a string, b double")
    b = stored(spark, [(1, None, 1.0), (2, None, 2.0)], tmp_path / "b", 1, "k long, a string, c double")
    assert diff(spark, a, b) == {1: ("changed", ["a", "b", "c"]), 2: ("changed", ["b", "c"])}


def test_empty_tables_and_errors(spark, base, tmp_path):
    none = stored(spark, [], tmp_path / "e")
    assert H.read_hashed(spark, none).count() == 0
    assert diff(spark, none, none) == {}
    assert {c for c, _ in diff(spark, base, none).values()} == {"removed"} and len(diff(spark, none, base)) == 400
    shallow = stored(spark, rows_of(3), tmp_path / "s", bits=0)
    assert diff(spark, shallow, stored(spark, rows_of(2), tmp_path / "t", bits=0)) == {2: ("removed", [])}
    with pytest.raises(ValueError):
        H.differing_leaves(spark, base, shallow)
    with pytest.raises(ValueError):
        H.write_hashed(spark.range(2), str(tmp_path / "x"), ["k"])
    with pytest.raises(ValueError):
        H.write_hashed(spark.range(2).withColumn(H.LEAF, F.lit(1)), str(tmp_path / "y"), ["id"])


def test_bits():
    assert [H.bits_for(n, 100) for n in (0, 100, 101, 200, 201, 10**12)] == [0, 0, 1, 1, 2, H.MOST_BITS]
