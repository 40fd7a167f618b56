"""Bundles: a folder with a world's tables, its task splits, a feature dictionary, a card and a manifest of content digests.

Tables are written by the executors to the folder given, which may be any path that Spark can write; the few small JSON, CSV and Markdown files are written
the same way, as one-row text tables, so that no local disk is needed.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit
from ..operators.sampling import exact_splits
from ..operators.snapshots import Feature, redacted_for
from ..operators.fused import Check, broken, columns_of, null_share, observed_write, rate, within
from .hashtree import frames_diff
from .tables import materialised


@dataclass(frozen=True)
class Exposure:
    """What a mode keeps: the relational tables as of the snapshot or whole, and the world's hidden parts or not."""

    mode: str
    snapshot_safe: bool
    with_hidden: bool


MODES = {"public": Exposure("public", True, False), "instructor": Exposure("instructor", False, True)}
# Columns that tell an outcome, tables that exist for converted leads only, and each event table's time.
BANNED = {"leads": ("converted_within_90_days", "conversion_timestamp", "current_stage", "is_sql"), "opportunities": ("close_outcome", "closed_at", "stage")}
OMITTED = ("customers", "subscriptions")
TIMES = {"touches": "touch_timestamp", "sessions": "session_timestamp", "sales_activities": "activity_timestamp", "opportunities": "created_at"}


def digest_columns(columns: Sequence[str]) -> list[Column]:
    """n, a and b: the number of rows and the sums of two hashes of each row, whatever their order and files."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in sorted(columns)))
    return [F.count("*").alias("n"), *(F.sum(F.xxhash64(F.lit(k), row).cast("decimal(38,0)")).alias(name) for k, name in ((1, "a"), (2, "b")))]


def digest_of(columns: Sequence[str], seen: Mapping) -> str:
    """A digest of a table's rows from its digest_columns()."""
    return hashlib.sha256(f"{sorted(columns)}:{seen['n']}:{seen['a']}:{seen['b']}".encode()).hexdigest()


def content_digest(df: DataFrame) -> str:
    return digest_of(df.columns, df.agg(*digest_columns(df.columns)).first().asDict())


def file_digests(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder, by its path there; each task reads one file at a time. Files that Spark ignores, such as _SUCCESS, aren't listed."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(root).toUri().getPath()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inner = F.expr(f"substring(path, locate({json.dumps(root)}, path) + {len(root) + 1})")
    return files.select(inner.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compare_trees(spark: SparkSession, left: str, right: str) -> DataFrame:
    """(path, problem) of files that are under one of two folders only, or differ byte for byte. Names of Parquet files hold a random part, so those of a table are compared as a set of digests under the table's path."""
    part = F.regexp_replace("path", r"/part-[^/]*$", "")
    sets = lambda folder, name: file_digests(spark, folder).groupBy(part.alias("path")).agg(F.sort_array(F.collect_list("sha256")).alias(name))
    both = sets(left, "l").join(sets(right, "r"), "path", "full")
    problem = F.when(F.col("r").isNull(), "only left").when(F.col("l").isNull(), "only right").when(F.col("l") != F.col("r"), "differs")
    return both.select("path", problem.alias("problem")).where(F.col("problem").isNotNull())


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\n")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0].removesuffix("\n")


def read_json(spark: SparkSession, path: str):
    return json.loads(read_text(spark, path))


def feature_dictionary(features: Sequence[Feature]) -> str:
    out = io.StringIO()
    rows = csv.writer(out, lineterminator="\n")
    rows.writerow(("name", "dtype", "role", "non_negative", "redacted_in"))
    rows.writerows((f.name, f.dtype, f.role, f.non_negative, " ".join(f.redacted_in)) for f in features)
    return out.getvalue()


def written(df: DataFrame, path: str, files: int | None = None) -> dict:
    """Writes a table and gives its rows and content digest, in one pass."""
    seen = observed_write(df, path, digest_columns(df.columns), files)
    return {"rows": seen["n"], "sha256": digest_of(df.columns, seen)}


def write_tables(tables: Mapping[str, DataFrame], folder: str, redacted: Mapping[str, Sequence[str]] | None = None, files: int | None = None) -> dict[str, dict]:
    """Writes each table without its redacted columns; (rows, sha256) of each, taken while it is written."""
    out = {}
    for name, df in tables.items():
        path = f"{folder}/tables/{name}.parquet"
        out[name] = written(df.drop(*(redacted or {}).get(name, ())), path, files)
    return out


def write_splits(snapshot: DataFrame, folder: str, task: str, key: str, seed: int, files: int | None = None) -> dict[str, dict]:
    """Train, valid and test as tables of their own, rows in hashed order being cut at 70 and 85 %."""
    rows = materialised(exact_splits(snapshot, key, seed=seed))  # ranked once for the three tables
    out = {}
    for split in ("train", "valid", "test"):
        path = f"{folder}/tasks/{task}/{split}.parquet"
        out[split] = written(rows.where(F.col("split") == split).drop("split"), path, files)
    return out


def flat(spark: SparkSession, folder: str, task: str) -> DataFrame:
    """All splits of a task as one table with a column ``split``."""
    parts = [spark.read.parquet(f"{folder}/tasks/{task}/{s}.parquet").withColumn("split", F.lit(s)) for s in ("train", "valid", "test")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def load_yaml(text: str):
    """What YAML says, or JSON where no YAML reader is installed."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def bounds_of(name: str, bounds: Mapping) -> tuple[float | None, float | None]:
    """(low, high) of {min, max}, either of which may be missing; unknown bounds raise."""
    if not isinstance(bounds, Mapping) or (unknown := set(bounds) - {"min", "max"}):
        raise ValueError(f"{name}: no bounds {sorted(unknown) if isinstance(bounds, Mapping) else bounds!r}")
    low, high = (None if bounds.get(b) is None else float(bounds[b]) for b in ("min", "max"))
    return low, high


def load_bands(text: str) -> list[tuple[str, str, float | None, float | None]]:
    """(tier, metric, low, high) from YAML or JSON of tiers: {tier: {metric: {min, max}}}; unknown bounds raise."""
    return bands_of(load_yaml(text))


def bands_of(held: Mapping | None) -> list[tuple[str, str, float | None, float | None]]:
    return [(tier, metric, *bounds_of(f"{tier}.{metric}", bounds)) for tier, metrics in (held or {}).items() for metric, bounds in metrics.items()]


def with_dictionary_row(dictionary: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """A feature dictionary, as read from CSV, with one more row before its others: column -> text, empty where not given. The row is a one-row frame, the dictionary is small by nature."""
    row = dictionary.sparkSession.createDataFrame([tuple(values.get(c, "") for c in dictionary.columns)], dictionary.schema)
    return row.unionByName(dictionary)


def exposure_errors(public: Mapping, instructor: Mapping) -> list[str]:
    """What a public manifest shows and the instructor's doesn't: tables, tasks or splits; none if exposure only grows."""
    parts = lambda m: {f"table {t}" for t in m["tables"]} | {f"task {t}/{s}" for t, splits in m["tasks"].items() for s in splits}
    return [f"{p} is public only" for p in sorted(parts(public) - parts(instructor))]


def exposure_tree_errors(spark: SparkSession, public: str, instructor: str) -> list[str]:
    """Where a public bundle isn't a part of the instructor's: what its manifest shows more, hidden parts in it or none in the other's, tables of the same columns and rows whose content differs, rows of the feature dictionary that the other lacks or has with other values."""
    a, b = (read_json(spark, f"{f}/manifest.json") for f in (public, instructor))
    errors = exposure_errors(a, b)
    hidden = lambda f: exists(spark, f"{f}/metadata")
    errors += ["the public bundle has metadata"] * hidden(public) + ["the instructor's bundle has no metadata"] * (not hidden(instructor))
    for t in sorted(a["tables"].keys() & b["tables"].keys()):
        x, y = (spark.read.parquet(f"{f}/tables/{t}.parquet").columns for f in (public, instructor))
        if extra := sorted(set(x) - set(y)):
            errors.append(f"table {t}: columns {extra} are public only")
        elif sorted(x) == sorted(y) and a["tables"][t]["rows"] == b["tables"][t]["rows"] and a["tables"][t]["sha256"] != b["tables"][t]["sha256"]:
            errors.append(f"table {t}: its content differs")
    rows = [{r["name"]: r for r in csv.DictReader(io.StringIO(read_text(spark, f"{f}/feature_dictionary.csv")))} for f in (public, instructor)]
    errors += [f"feature {name} is public only" for name in sorted(rows[0].keys() - rows[1].keys())]
    return errors + [f"feature {name} is described differently" for name in sorted(rows[0].keys() & rows[1].keys()) if rows[0][name] != rows[1][name]]


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def card(name: str, manifest: Mapping) -> str:
    lines = [f"# {name}", "", f"Mode: {manifest['mode']}. Seed: {manifest['seed']}.", "", "| table | rows |", "|-|-|"]
    lines += [f"| {t} | {x['rows']} |" for t, x in manifest["tables"].items()]
    return "\n".join([*lines, "", "| task | split | rows |", "|-|-|-|", *(f"| {t} | {s} | {x['rows']} |" for t, splits in manifest["tasks"].items() for s, x in splits.items())]) + "\n"


def write_bundle(spark: SparkSession, folder: str, *, name: str, tables: Mapping[str, DataFrame], snapshots: Mapping[str, DataFrame], key: str, features: Sequence[Feature], mode: str, config: Mapping, hidden: Mapping[str, str] | None = None, extra: Mapping | None = None, files: int | None = None) -> dict:
    """Writes a bundle in a fixed order and returns its manifest. ``tables`` must already be what ``mode`` may show; snapshots: by task."""
    exposure = MODES[mode]
    gone = redacted_for(mode, features)
    manifest = {"name": name, "mode": mode, "seed": config["seed"], "config_sha256": config_hash(config), "tables": write_tables(tables, folder, files=files)}
    manifest["tasks"] = {task: write_splits(df.drop(*gone), folder, task, key, config["seed"], files) for task, df in snapshots.items()}
    if extra and (both := set(extra) & set(manifest)):
        raise ValueError(f"extra keys collide with the manifest's: {sorted(both)}")
    manifest |= dict(extra or {})
    write_text(spark, card(name, manifest), f"{folder}/card.md")
    write_text(spark, feature_dictionary([f for f in features if f.name not in gone]), f"{folder}/feature_dictionary.csv")
    if exposure.with_hidden:
        for part, text in (hidden or {}).items():
            write_text(spark, text, f"{folder}/metadata/{part}")
    write_text(spark, json.dumps(manifest, indent=1, sort_keys=True, default=str), f"{folder}/manifest.json")
    return manifest


#: Shares of missing values above which a feature tells nothing, and rates of the label that no tier has.
MOST_MISSING, LABEL_RATES = 0.999, (0.005, 0.995)


def _checks(dictionary: Mapping[str, Mapping], columns: Sequence[str], difficulty: tuple[float, float] | None) -> list[Check]:
    """What a split's one scan also tells: features that are all missing, counts below 0 where none may be (other numbers may have outliers on purpose), and the rate of a 0/1 target."""
    out = []
    for c in columns:
        row = dictionary.get(c)
        if row is None:
            continue
        if row["role"] == "feature":
            out.append(null_share(c, MOST_MISSING))
        if row["non_negative"] == "True" and row["dtype"] == "long":
            out.append(within(c, 0.0, None))
        if row["role"] == "target" and row["dtype"] == "boolean":
            out.append(rate(c, *(difficulty or LABEL_RATES)))
    return out


def validate_bundle(
    spark: SparkSession, folder: str, *, keys: Sequence[tuple[str, str, str, str]] = (), banned: Mapping[str, Sequence[str]] = BANNED, omitted: Sequence[str] = OMITTED, realism: bool = True, rates: Mapping[str, tuple[float, float]] | None = None, least_rows: int = 200
) -> list[str]:
    """What is wrong with a bundle: files that are missing, rows or digests that differ from the manifest, orphaned keys (child, key, parent, key), and in public mode columns and tables that must not be there.

    realism: also features without values, negative counts, and targets whose rate is outside the range of the manifest's difficulty in ``rates``, or of any; splits of fewer than ``least_rows`` rows are too small to tell these.
    Each table and split is scanned once for all of this; keys are joined beside.
    """
    manifest = read_json(spark, f"{folder}/manifest.json")
    errors, tables = [f"{name} is missing" for name in ("card.md", "feature_dictionary.csv") if not exists(spark, f"{folder}/{name}")], {}
    listed = {r["name"]: r for r in csv.DictReader(io.StringIO(read_text(spark, f"{folder}/feature_dictionary.csv")))} if exists(spark, f"{folder}/feature_dictionary.csv") else {}
    parts = {f"tables/{t}": x for t, x in manifest["tables"].items()} | {f"tasks/{t}/{s}": x for t, splits in manifest["tasks"].items() for s, x in splits.items()}
    for name, wanted in parts.items():
        if not exists(spark, f"{folder}/{name}.parquet"):
            errors.append(f"{name} is missing")
            continue
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        checks = [] if name.startswith("tables/") or not realism else _checks(listed, df.columns, (rates or {}).get(manifest.get("difficulty")))
        seen = df.agg(*digest_columns(df.columns), *columns_of(checks)).first().asDict()
        if seen["n"] != wanted["rows"]:
            errors.append(f"{name}: {seen['n']} rows, the manifest has {wanted['rows']}")
        elif digest_of(df.columns, seen) != wanted["sha256"]:
            errors.append(f"{name}: its content differs from the manifest's digest")
        if seen["n"] >= least_rows:
            errors += [f"{name}: {e}" for e in broken(seen, checks)]
        if name.startswith("tables/"):
            tables[name[7:]] = df
        elif listed and (unexpected := sorted(set(df.columns) - set(listed))):
            errors.append(f"{name}: columns {unexpected} that the dictionary lacks")
    for child, key, parent, parent_key in keys:
        if child in tables and parent in tables and (n := audit.orphans(tables[child], key, tables[parent], parent_key).count()):
            errors.append(f"{child}.{key}: {n} keys that {parent} lacks")
    if manifest["mode"] == "public":
        errors += [f"{t}: columns {found} must not be published" for t, columns in banned.items() if t in tables and (found := audit.banned(tables[t].columns, columns))]
        errors += [f"{t} must not be published" for t in audit.banned(list(tables), omitted)]
    return errors


def compare_bundles(spark: SparkSession, left: str, right: str) -> list[str]:
    """Names of the tables and splits whose content differs between two bundles."""
    a, b = (read_json(spark, f"{f}/manifest.json") for f in (left, right))
    digests = lambda m: {f"tables/{t}": x["sha256"] for t, x in m["tables"].items()} | {f"tasks/{t}/{s}": x["sha256"] for t, splits in m["tasks"].items() for s, x in splits.items()}
    x, y = digests(a), digests(b)
    return sorted(k for k in x.keys() | y.keys() if x.get(k) != y.get(k))


def bundle_diff(spark: SparkSession, left: str, right: str, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """(part, key, change, columns) of the rows in which two bundles differ; keys: by the last part of a table's name or by task, the columns that tell its rows apart.

    Parts whose digests in the manifests agree are not read; parts of one bundle only count as removed or added as a whole, with a null key. Raises where a part that differs has no keys. ``key`` is JSON.
    """
    schema = "part string, key string, change string, columns array<string>"
    a, b = ({f"tables/{t}" for t in m["tables"]} | {f"tasks/{t}/{s}" for t, splits in m["tasks"].items() for s in splits} for m in (read_json(spark, f"{f}/manifest.json") for f in (left, right)))
    whole = [(p, None, "added" if p in b else "removed", []) for p in sorted(a ^ b)]
    out = spark.createDataFrame(whole, schema)
    for part in compare_bundles(spark, left, right):
        if part in a ^ b:
            continue
        name = part.split("/")[1]
        if name not in keys:
            raise ValueError(f"{part} differs and has no keys")
        one, two = (spark.read.parquet(f"{f}/{part}.parquet") for f in (left, right))
        found = frames_diff(one, two, keys[name])
        out = out.unionByName(found.select(F.lit(part).alias("part"), F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys[name]))).alias("key"), "change", "columns"))
    return out
