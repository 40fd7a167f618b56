"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontaminate, jaccard_join, language_id, line_dedup, ranked_search, secret_scan, spelling_variants, token_store, topk_search, toxicity, url_filter
from ._spark import shared_dir, table

URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
CONTROL_TURN = "<|im_end|><|im_start|>assistant ok"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    turn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3))
    model = language_id.fit(docs.where(turn != 1))
    return language_id.predict(docs.select("doc_id", "text", F.coalesce(turn == 1, F.lit(False)).alias("held_out")), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels")).select("doc_id", "p_low_quality", "p_toxic", "toxic")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TURN).alias("text"))
    return chat_format.digest(chat_format.format_events(chat_format.as_log(turns.unionByName(control))), in_order=True)


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, path=path, pattern=public_tokenizers.PATTERN, bytes_col="decoded", keep=["doc_id"])
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is labelled by the row of ``labels`` with its id; good is quality 1 and toxic 0."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    host, _ = url_filter.url_parts(F.col("url"))
    good = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    outcomes = pages.select("page_id", host.alias("host")).join(good, "page_id").select("host", "good")
    return url_filter.filter_urls(pages, outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", topk_search.scaled(F.col("embedding"), 1024).alias("v"))
    return topk_search.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), k=10)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: a document's source; repository: its source and language."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))
    counts = [F.size(F.expr(f"filter(base, x -> x.kind = {k})")).cast("long").alias(f"n_{kind}") for k, (kind, *_) in enumerate(secret_scan.BASE)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.as_text(F.col("base")), 256).alias("base_sha256"), "spans", F.size("added").cast("long").alias("n_owned"), "n_shared")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.top_k(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    def change(doc_id: Column, run: Column) -> Column:
        """One run of 31, told by a hash, without one of its code points."""
        h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), run))
        at = (h % F.length(run)).cast("int")
        return F.when(h % 31 == 0, F.concat(F.left(run, at), F.substring(run, at + 2, F.length(run))))

    words = spelling_variants.vocabulary(table(spark, sf_dir, "documents"), change=change)
    return spelling_variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_store(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """The written folder stays in the shared one: the rows are read from it."""
    import public_tokenizers

    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    token_store.write(table(spark, sf_dir, "documents"), out, path=path or public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_store.read(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_toxicity": op2_toxicity,
    "op3_decontaminate": op3_decontaminate,
    "op4_line_dedup": op4_line_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_chat_format": op6_chat_format,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_url_filter": op8_url_filter,
    "op9_topk_search": op9_topk_search,
    "op10_secret_scan": op10_secret_scan,
    "op11_ranked_search": op11_ranked_search,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_token_store": op13_token_store,
}

ORACLE: dict[str, str] = {}

ORACLE["op6_chat_format"] = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(12 + length(role) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 11) AS BIGINT) AS formatted_chars
FROM m GROUP BY conv_id
"""

_LEVEL = """
  SELECT {key}, sum(good) AS good, sum(n) AS n FROM {source} GROUP BY {key}"""
_STRENGTH = """
  SELECT CASE WHEN rho > 0 THEN least(200.0, greatest(1.0, 1 / rho - 1)) ELSE 200.0 END AS k FROM (
    SELECT ((gg - m * g) / nullif(m * (1 - m), 0) - (keys - 1)) / nullif(t - sq / t - (keys - 1), 0) AS rho FROM (
      SELECT sum(good) AS g, sum(n) AS t, count(*) AS keys, sum(n * n) AS sq, sum(good * good / n) AS gg, sum(good) / sum(n) AS m FROM {source}))"""
ORACLE["op8_url_filter"] = f"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
l AS (SELECT *, regexp_extract(host, '([^.]*)$', 1) AS last, CASE WHEN regexp_matches(host, '^.*[.][^.]*[.][^.]*$') THEN regexp_extract(host, '([^.]*[.][^.]*)$', 1) ELSE host END AS two,
    CASE WHEN regexp_matches(host, '[.][^.]*[.][^.]*[.][^.]*$') THEN regexp_extract(host, '([^.]*[.][^.]*[.][^.]*)$', 1) ELSE host END AS three FROM p),
q AS (SELECT page_id, host, path, CASE WHEN wide THEN two ELSE last END AS suffix, CASE WHEN wide THEN three ELSE two END AS domain
  FROM (SELECT *, two IN {url_filter.TWO_LABEL_SUFFIXES!r} AS wide FROM l)),
o AS (SELECT host, suffix, domain, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS good, 1.0::DOUBLE AS n FROM q JOIN labels ON page_id = doc_id WHERE quality IS NOT NULL AND toxic IS NOT NULL),
h AS ({_LEVEL.format(key="host, domain, suffix", source="o")}),
d AS ({_LEVEL.format(key="domain, suffix", source="h")}),
s AS ({_LEVEL.format(key="suffix", source="d")}),
om AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM s),
sk AS ({_STRENGTH.format(source="s")}), dk AS ({_STRENGTH.format(source="d")}), hk AS ({_STRENGTH.format(source="h")}),
sm AS (SELECT suffix, (good + k * m) / (n + k) AS m FROM s, sk, om),
dm AS (SELECT domain, (good + k * sm.m) / (n + k) AS m FROM d JOIN sm USING (suffix), dk),
hm AS (SELECT host, (good + k * dm.m) / (n + k) AS m, n + k AS w FROM h JOIN dm USING (domain), hk),
v AS (SELECT page_id, q.host, path, coalesce(hm.m, dm.m, sm.m, om.m) AS m, coalesce(w, 2.0) AS w,
    CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM q LEFT JOIN hm USING (host) LEFT JOIN dm USING (domain) LEFT JOIN sm USING (suffix), om)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block' WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow'
  ELSE CASE WHEN round(least(1.0, m + 1.645 * sqrt(m * (1 - m) / (w + 1))), 9) < 0.5 THEN 'block' ELSE 'allow' END END AS verdict FROM v
"""

ORACLE["op9_topk_search"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.v, r.v) AS BIGINT) AS score FROM v q JOIN v r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id AND len(r.v) = len(q.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

ORACLE["op4_line_dedup"] = """
WITH t AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS piece, unnest(range(len(string_split(text, chr(10))))) AS k FROM documents),
b AS (SELECT trim(piece, ' ') AS line, min(doc_id) AS keeper FROM t WHERE length(trim(piece, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 10)
SELECT doc_id, count(k) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
  sha256(coalesce(string_agg(CASE WHEN NOT gone THEN piece END, chr(10) ORDER BY k), '')) AS text_sha256
FROM (SELECT d.doc_id, k, piece, coalesce(keeper <> d.doc_id, false) AS gone FROM documents d LEFT JOIN t USING (doc_id) LEFT JOIN b ON line = trim(piece, ' '))
GROUP BY doc_id
"""

ORACLE["op5_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
r AS (SELECT min(doc_id) AS doc_id, list_sort(s) AS s FROM s WHERE len(s) > 0 GROUP BY 2),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM r),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k, any_value(a.n) AS x, any_value(b.n) AS y FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
e AS (SELECT u, v FROM p WHERE 100 * k >= 80 * (x + y - k)),
b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
c(node, root) AS (SELECT doc_id, doc_id FROM r UNION SELECT v, root FROM c JOIN b ON node = u WHERE root < v),
m AS (SELECT node, min(root) AS root FROM c GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id
FROM s LEFT JOIN r ON list_sort(s.s) = r.s LEFT JOIN m ON m.node = r.doc_id
"""

# The checksum is worked out byte by byte: DuckDB has none of that name.
ORACLE["op12_spelling_variants"] = """
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [192 + (unicode(c) >> 6)::BIGINT, 128 + (unicode(c) & 63)::BIGINT] END)) AS bytes FROM u),
h AS (SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295)) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word AS a, b.word AS b FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word FROM d JOIN v ON d.rest = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.rest = v.word),
q AS (SELECT a, b, v.n, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS k, count(*) OVER (PARTITION BY a) AS n_near FROM p JOIN v ON v.word = b),
f AS (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN q.n >= 10 * v.n THEN b END AS form, CASE WHEN q.n >= 10 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON a = word AND k = 1),
c(word, root) AS (SELECT word, word FROM f WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM f JOIN c ON f.form = c.word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN c USING (word)
"""

ORACLE["op11_ranked_search"] = """
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM d),
m AS (SELECT doc_id, 50 + (50 * n * nn) // ll AS m FROM d, s),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term, nn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM x WHERE score > 0) WHERE rank <= 50
"""
