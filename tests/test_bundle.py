"""Bundles: one pass a table to write and one to check, file digests, and what may be shown."""

import json

import pytest
from pyspark.sql import functions as F

from tallyrand import api
from tallyrand.operators import fused
from tallyrand.sources import bundle


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("bundles")
    world = api.generate(spark, "leads_intro", n_leads=400, n_contacts=200, n_accounts=60)
    for mode in ("public", "instructor"):
        world.save(f"{top}/{mode}", mode=mode, files=1)
    return f"{top}/public", f"{top}/instructor"


def copied(folder, to):
    import shutil

    shutil.copytree(folder, to)
    return str(to)


def test_observed_digest_is_that_of_the_files(spark, tmp_path):
    df = spark.range(500).select("id", (F.col("id") / 3).alias("x"), F.when(F.col("id") % 2 == 0, "even").alias("s"), F.current_timestamp().alias("t")).repartition(5)
    got = bundle.written(df, f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert got["rows"] == 500 and bundle.content_digest(back.where("id >= 0")) == got["sha256"]
    assert bundle.content_digest(back.where("id > 0")) != got["sha256"]
    assert bundle.written(df.limit(0), f"{tmp_path}/e")["rows"] == 0


def test_one_job_writes_and_digests(spark, tmp_path):
    context = spark.sparkContext
    df = spark.range(50)
    context.setJobGroup("write", "write")
    bundle.written(df, f"{tmp_path}/t")
    assert len(context.statusTracker().getJobIdsForGroup("write")) == 1
    context.setLocalProperty("spark.jobGroup.id", None)


def test_checks_share_one_scan(spark):
    df = spark.createDataFrame([(1, 0.5, "a"), (0, -1.0, "z"), (0, None, None)], "y int, x double, c string")
    checks = [fused.null_share("x", 0.3), fused.within("x", 0, 1), fused.known_values("c", ["a", "b"]), fused.rate("y", 0.2, 0.4), fused.Check("none", F.max(F.lit(None).cast("double")), 0.0)]
    out = fused.checked(df, checks)
    assert {r.check: r.ok for r in out.collect()} == {"null_share:x": False, "violations:x_range": False, "violations:c_values": False, "rate:y": True, "none": False}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert len(fused.broken(df.agg(*fused.columns_of(checks)).first().asDict(), checks)) == 4
    assert {r.ok for r in fused.checked(df.limit(0), checks[:1]).collect()} == {False}


def test_valid_bundles_have_no_errors(spark, both):
    for folder in both:
        assert api.validate(spark, folder) == []


def test_what_is_broken_is_found(spark, both, tmp_path):
    folder = copied(both[0], tmp_path / "b")
    path = f"{folder}/tasks/conversion/train.parquet"
    train = spark.createDataFrame(spark.read.parquet(path).collect(), spark.read.parquet(path).schema)
    names = [f.name for f in train.schema.fields]
    dictionary = bundle.read_text(spark, f"{folder}/feature_dictionary.csv").splitlines()
    rows = [dict(zip(dictionary[0].split(","), line.split(","), strict=True)) for line in dictionary[1:]]
    gone = next(r["name"] for r in rows if r["role"] == "feature" and r["name"] in names)
    below = next(r["name"] for r in rows if r["non_negative"] == "True" and r["dtype"] == "long" and r["name"] in names and r["name"] != gone)
    target = next(r["name"] for r in rows if r["role"] == "target" and r["dtype"] == "boolean")
    kind = {f.name: f.dataType for f in train.schema.fields}
    bad = train.withColumn(gone, F.lit(None).cast(kind[gone])).withColumn(below, F.lit(-1).cast(kind[below])).withColumn(target, F.lit(True)).withColumn("secret", F.lit(1))
    bad.write.mode("overwrite").parquet(path)
    found = " ".join(api.validate(spark, folder))
    for part in (f"null_share:{gone}", f"violations:{below}_range", f"rate:{target}", "content differs", "'secret'"):
        assert part in found, (part, found)
    assert "null_share" not in " ".join(bundle.validate_bundle(spark, folder, realism=False))
    import shutil

    shutil.rmtree(f"{folder}/tables/touches.parquet")
    shutil.rmtree(f"{folder}/card.md")
    found = api.validate(spark, folder)
    assert "tables/touches is missing" in found and "card.md is missing" in found


def test_trees(spark, both, tmp_path):
    digests = {r.path: r for r in bundle.file_digests(spark, both[0]).collect()}
    import hashlib

    for path, r in digests.items():
        data = open(f"{both[0]}/{path}", "rb").read()
        assert (r.bytes, r.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert any(p.startswith("tables/leads.parquet/part-") for p in digests)
    same = copied(both[0], tmp_path / "same")
    assert bundle.compare_trees(spark, both[0], same).collect() == []
    spark.range(3).write.mode("overwrite").parquet(f"{same}/tables/leads.parquet")
    spark.range(3).write.parquet(f"{same}/tables/more.parquet")
    assert sorted(map(tuple, bundle.compare_trees(spark, both[0], same).collect())) == [("tables/leads.parquet", "differs"), ("tables/more.parquet", "only right")]


def test_exposure_of_whole_bundles(spark, both, tmp_path):
    public, instructor = both
    assert bundle.exposure_tree_errors(spark, public, instructor) == []
    assert {"the public bundle has metadata", "the instructor's bundle has no metadata"} <= set(bundle.exposure_tree_errors(spark, instructor, public))
    changed = copied(public, tmp_path / "c")
    text = bundle.read_text(spark, f"{changed}/feature_dictionary.csv").splitlines()
    first = text[1].split(",")
    bundle.write_text(spark, "\n".join([text[0], ",".join([first[0], "other", *first[2:]]), *text[2:], "made_up,long,feature,False,"]), f"{changed}/feature_dictionary.csv")
    assert bundle.exposure_tree_errors(spark, changed, instructor) == ["feature made_up is public only", f"feature {first[0]} is described differently"]


def test_rows_in_which_bundles_differ(spark, both, tmp_path):
    import json

    left = both[0]
    assert bundle.bundle_diff(spark, left, copied(left, tmp_path / "same"), {}).collect() == []
    right = copied(left, tmp_path / "right")
    leads = spark.read.parquet(f"{left}/tables/leads.parquet")
    ids = [r.lead_id for r in leads.select("lead_id").orderBy("lead_id").limit(3).collect()]
    source = F.when(F.col("lead_id") == ids[0], "elsewhere").otherwise(F.col("lead_source")).alias("lead_source")
    changed = leads.where(F.col("lead_id") != ids[1]).select(*(source if c == "lead_source" else c for c in leads.columns))
    changed = changed.unionByName(leads.where(F.col("lead_id") == ids[2]).withColumn("lead_id", F.lit("lead_new")))
    manifest = bundle.read_json(spark, f"{right}/manifest.json")
    manifest["tables"]["leads"] = bundle.written(changed, f"{right}/tables/leads.parquet")
    gone = sorted(set(manifest["tables"]) - {"leads"})[0]
    del manifest["tables"][gone]
    bundle.write_text(spark, json.dumps(manifest), f"{right}/manifest.json")
    got = {(r.part, r.key and json.loads(r.key)["lead_id"], r.change, *r.columns) for r in bundle.bundle_diff(spark, left, right, {"leads": ["lead_id"]}).collect()}
    assert got == {(f"tables/{gone}", None, "removed"), ("tables/leads", ids[0], "changed", "lead_source"), ("tables/leads", ids[1], "removed"), ("tables/leads", "lead_new", "added")}
    with pytest.raises(ValueError):
        bundle.bundle_diff(spark, left, right, {})


def test_released_from_the_command_line(both, tmp_path, capsys):
    gates = tmp_path / "gates.json"
    gates.write_text('{"per_tier": {"intro": {"rate_test": {"min": 0.99}}}, "cross_tier_required": ["intro", "advanced"]}')
    assert api.main(["release", str(gates), f"intro:1={both[0]}"]) == 1
    told = json.loads(capsys.readouterr().out)
    assert {(f["gate"], f["reason"]) for f in told["failures"]} >= {("tier", "below")} and {r["section"] for r in told["report"]} == {"seed", "median", "spread", "place"}
