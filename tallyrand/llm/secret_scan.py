"""Secret scanning with corpus-wide ownership frequency. Column expressions only.

Three kinds of secrets are found by pattern. Beyond them, long mixed tokens are candidates: a candidate whose hash occurs with few distinct owners and
repositories looks live and is reported too, one that many owners share is an example that was copied about. Found secrets of the
base kinds stay in any case; how widely each is shared is told beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import checkpointed, met

#: (kind, pattern, group whose length counts, least length). A run of the classes of access and hex that is too short holds no longer
#: match, so their patterns ask for the length themselves; a failing assign match takes its text with it and is dropped afterwards.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Spares the work where there is nothing to find: a match of the least length, anywhere.
LIKELY = {"assign": r"(?i:password|passwd|secret|token|api_?key)", "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
OWNED = "owned"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])"
KINDS = ("assign", "access", "hex", OWNED)


def steps(text: Column, pattern: str, group: int, least: int, likely: str) -> Column:
    """array<struct<g, m, hash, fits, mixed>> of the matches: characters before a match since the last one, characters of it, a hash of its group, whether that is long enough, and
    whether it has letters of both cases and digits. The texts between the matches are those that splitting by the pattern leaves."""
    whole, part, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[a-z]") & x.rlike("[A-Z]")
    gaps = F.zip_with(F.transform(F.slice(between, 1, F.size(whole)), F.length), F.transform(whole, F.length), lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    found = F.zip_with(gaps, part, lambda x, s: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.xxhash64(s).alias("hash"), (F.length(s) >= least).alias("fits"), mixed(s).alias("mixed")))
    return F.when(text.rlike(likely), found).otherwise(F.expr("CAST(array() AS array<struct<g: int, m: int, hash: bigint, fits: boolean, mixed: boolean>>)"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner: Column, repository: Column, most_owners: int = 2, most_repositories: int = 2) -> DataFrame:
    """(doc_id, base, added, spans, n_shared) of every row of docs; base and added: array<struct<start, kind, end>>; spans: kind:start:end, joined.

    Added are candidates outside the base spans, of letters in both cases and digits, whose value occurs with at most ``most_owners`` distinct owners and
    ``most_repositories`` repositories over all docs (null ones are none). n_shared: base secrets that occur more widely than that.
    Null texts are empty and have no spans; repeated rows are scanned each by itself and count as one repository's; ids may be null or repeat;
    further columns are ignored; an empty table gives an empty result. Values are compared by 64-bit hashes. The work on a text grows with its matches, sorted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [*((pattern, group, least, LIKELY[kind]) for kind, pattern, group, least in BASE), (CANDIDATE, 0, 20, CANDIDATE)]
    found = F.array(*(F.struct(F.lit(k).alias("kind"), steps(text, *kind).alias("steps")) for k, kind in enumerate(kinds)))
    found = F.filter(found, lambda x: F.size(x["steps"]) > 0)
    # Small beside the texts, and read twice; the rows' numbers hold once they are written.
    rows = checkpointed(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), found.alias("found")))
    some = rows.where(F.size("found") > 0)
    each = some.select("row", F.explode("found").alias("x")).select("row", "x.kind", F.posexplode("x.steps").alias("at", "s")).select("row", "kind", "at", "s.*")
    # A match ends where all that lies before it and the match itself add up to.
    until = F.sum(F.col("g") + F.col("m")).over(Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    spans = each.withColumn("end", until).where("fits").select("row", "kind", (F.col("end") - F.col("m")).alias("start"), "end", "hash", "mixed")
    is_base = F.col("kind") < len(BASE)
    # A candidate meets a base span if one that starts no later ends behind its start, or one that starts no earlier starts before its end.
    # Both are running values, one of them from the text's end.
    upto = lambda order: Window.partitionBy("row").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    ended = F.max(F.when(is_base, F.col("end"))).over(upto(F.asc("start")))
    begun = F.min(F.when(is_base, F.col("start"))).over(upto(F.desc("start")))
    free = ~F.coalesce(ended > F.col("start"), F.lit(False)) & ~F.coalesce(begun < F.col("end"), F.lit(False))
    spans = spans.withColumn("free", free).where(is_base | (F.col("free") & F.col("mixed"))).drop("free", "mixed")
    spans = checkpointed(spans)
    # One row per value and owner before anything is counted, so copies are merged before the shuffle.
    owned = some.select("row", "owner", "repository").join(spans.select("row", "hash"), "row")
    seen = owned.groupBy("owner", "repository", "hash").agg(F.count("*").alias("n"))
    shared = seen.groupBy("hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repository").alias("repositories"), F.sum("n").alias("n"))
    shared = checkpointed(shared.where((F.col("owners") > most_owners) | (F.col("repositories") > most_repositories)).select("hash", "n"))
    wide = met(spans.select("row", "hash").distinct(), shared, "hash").select("row", "hash", F.lit(True).alias("wide"))
    told = spans.join(wide, ["row", "hash"], "left").withColumn("wide", F.coalesce("wide", F.lit(False))).where(is_base | ~F.col("wide"))
    span = F.struct("start", "kind", "end")
    told = told.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("found"), F.count_if(is_base & F.col("wide")).alias("n_shared"))
    out = some.select("row", "doc_id").join(told, "row", "left")
    none = F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int>>)")
    out = out.select("doc_id", F.coalesce("found", none).alias("found"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"))
    out = out.unionByName(rows.where(F.size("found") == 0).select("doc_id", none.alias("found"), F.lit(0).cast("long").alias("n_shared")))
    return out.select("doc_id", F.filter("found", lambda x: x["kind"] < len(BASE)).alias("base"), F.filter("found", lambda x: x["kind"] == len(BASE)).alias("added"), as_text(F.col("found")).alias("spans"), "n_shared")


def as_text(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")
