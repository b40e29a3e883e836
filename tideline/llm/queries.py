"""The operators as queries on the given tables, whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontamination, extraction, line_dedup, packing, prefix_trie, quality, secrets, sharding, simhash, token_files, toxicity, urlfilter, whitening
from tideline.llm.registry import QUERIES, SQL, query, read  # noqa: F401
from tideline.session import materialise, shared_folder


@query("op1_sharding")
def op1_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in eight shards of near equal bytes; the digest of the texts is what moves."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = read(spark, sf, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    digest = materialise(digest, "digest")
    store = sharding.MapStore(spark, shared_folder(spark, "slot_map"))
    placed = sharding.shard(digest, ["doc_id"], F.col("size"), 8, store, order=["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base kinds, and all spans."""
    found = secrets.find_secrets(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "spans")
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(secrets.kind_count(spans, kind).alias(f"n_{kind}") for kind in secrets.BASE),
        F.sha2(secrets.span_list(spans, secrets.BASE), 256).alias("base_sha256"),
        secrets.span_list(spans).alias("spans"),
    )


@query("op10_packing")
def op10_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf, "documents").select("doc_id", "text"))


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """A toxicity score of every document, learned from labels outside the held-out fifth."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(docs, read(spark, sf, "labels").select("doc_id", "toxic").where(fold != 0))
    scored = toxicity.score(docs, model).drop("text")
    return scored.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@query("op6_token_files")
def op6_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Token files of all documents in training order; where each piece of each document lies."""
    return token_files.write(read(spark, sf, "documents").select("doc_id", "text"), shared_folder(spark, "token_files"))


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


QUALITY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (SELECT r, i, array_to_string(words[i:i+4], ' ') AS x FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x) AS c FROM win) , range(5) AS t(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, trim(lower(line), concat(' ', chr(9), chr(11), chr(12), chr(13))) AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
h AS (SELECT *, CAST('0x' || substr(md5(norm), 1, 15) AS BIGINT) AS h FROM lw),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY r),
per AS (SELECT r, any_value(source) AS source, list_sort(list(DISTINCT h)) AS hs FROM h GROUP BY r),
one AS (SELECT source, hs[1] AS a, coalesce(hs[2], -1) AS b, unnest(hs) AS h FROM per),
cnt AS (SELECT source, h, count(DISTINCT CASE WHEN h = a THEN b ELSE a END) AS n FROM one GROUP BY source, h),
size AS (SELECT source, count(DISTINCT hs[1]) AS n FROM per GROUP BY source),
gone AS (SELECT cnt.source, cnt.h FROM cnt JOIN size ON cnt.source IS NOT DISTINCT FROM size.source WHERE cnt.n > 20 AND cnt.n > 0.1 * size.n),
lost AS (SELECT h.r, sum(h.n) AS n FROM h JOIN gone ON h.source IS NOT DISTINCT FROM gone.source AND h.h = gone.h GROUP BY h.r),
m AS (SELECT d.doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_left >= 10 AS kept, n_left
FROM (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CAST(n_words - lost AS BIGINT) AS n_left FROM m)
"""


@query("op8_quality", QUALITY_SQL)
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Measures and verdict of every document, by the rules of the pipeline; the SQL knows documents by single lines."""
    found = quality.verdicts(read(spark, sf, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", *quality.MEASURES, "base_failed", "kept", "n_left")


CONTAMINATION_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x),
places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
ids AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS x FROM hit GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(places.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(ids.x, '')) AS items_sha256, coalesce(places.n, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""


@query("op2_decontamination", CONTAMINATION_SQL)
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontamination.contamination(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "benchmark").select("item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


@query("op4_extraction")
def op4_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    found = extraction.extract(read(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


URL_RULES = (
    urlfilter.Rule("allow", "org/"),
    urlfilter.Rule("block", "example.org/es/"),
    urlfilter.Rule("block", "example.org/en/1"),
    urlfilter.Rule("allow", "com/fr/"),
    urlfilter.Rule("block", "com/de/"),
)


def _url_sql() -> str:
    """The levels of the template tree as a chain of common table expressions."""
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN {{'rule': '{r.rule}', 'verdict': '{r.verdict}'}}"
        for r in sorted(URL_RULES, key=lambda r: -len(r.rule))
    )
    parts = ["""
p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages)""", f"""
r AS (SELECT *, CASE WHEN r.verdict = 'block' THEN 1 WHEN r.verdict = 'allow' THEN 0 END AS bad FROM (SELECT *, CASE {fits} END AS r FROM p))""", """
t0 AS (SELECT host, path, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS template, '' AS shape FROM r GROUP BY host, path)"""]  # fmt: skip
    for k in range(1, 5):
        parts.append(f"""
c{k} AS (SELECT host, template, segs[{k}] AS seg, sum(n) AS n FROM t{k - 1} WHERE segs[{k}] IS NOT NULL GROUP BY ALL),
n{k} AS (SELECT host, template, sum(n) AS total, count(*) AS kinds FROM c{k} GROUP BY ALL),
l{k} AS (SELECT host, template, seg FROM c{k} JOIN n{k} USING (host, template) WHERE kinds < 8 OR kinds < 0.2 * total OR (n >= 20 AND n >= 0.05 * total)),
t{k} AS (SELECT t.host, path, n, labelled, bad, segs,
  t.template || CASE WHEN segs[{k}] IS NULL THEN '' WHEN l.seg IS NOT NULL THEN '/' || segs[{k}] ELSE '/*' || regexp_extract(segs[{k}], '\\.[A-Za-z]{{1,5}}$') END AS template,
  shape || CASE WHEN segs[{k}] IS NULL THEN '' WHEN l.seg IS NOT NULL THEN '/?' ELSE '/*' || regexp_extract(segs[{k}], '\\.[A-Za-z]{{1,5}}$') END AS shape
  FROM t{k - 1} t LEFT JOIN l{k} l ON t.host = l.host AND t.template = l.template AND segs[{k}] = l.seg)""")  # fmt: skip
    parts.append("""
t AS (SELECT host, path, labelled, bad, template || CASE WHEN len(segs) > 4 THEN '/**' ELSE '' END AS template, shape || CASE WHEN len(segs) > 4 THEN '/**' ELSE '' END AS shape FROM t4),
e AS (SELECT host, template, shape, sum(labelled) AS labelled, sum(bad) AS bad FROM t GROUP BY ALL),
g AS (SELECT host, shape, sum(labelled) AS a, sum(bad) AS b, sum(bad) / nullif(sum(labelled), 0) AS q FROM e GROUP BY ALL),
m AS (SELECT host, template, labelled, bad, CASE WHEN labelled > 0 AND abs(bad / labelled - q) > 1.96 * sqrt(q * (1 - q) / labelled) THEN template ELSE shape END AS branch FROM e JOIN g USING (host, shape)),
o AS (SELECT host, branch, sum(labelled) AS labelled, sum(bad) AS bad FROM m GROUP BY ALL),
w AS (SELECT branch, sum(labelled) AS a, sum(bad) AS b FROM m GROUP BY ALL),
z AS (SELECT sum(labelled) AS n, (sum(bad) + 1) / (sum(labelled) + 2) AS base FROM m),
s AS (SELECT o.host, branch, (bad + 10.0::DOUBLE * ((b + 10.0::DOUBLE * base) / (a + 10.0::DOUBLE))) / (labelled + 10.0::DOUBLE) AS purity, n FROM o JOIN w USING (branch), z)
SELECT page_id, r.host, r.path, r.r.rule AS rule, coalesce(r.r.verdict, CASE WHEN purity >= 0.9 AND s.n > 0 THEN 'block' ELSE 'allow' END) AS verdict, t.template, branch
FROM r JOIN t ON r.host = t.host AND r.path = t.path JOIN m ON t.host = m.host AND t.template = m.template JOIN s ON m.host = s.host AND m.branch = s.branch""")  # fmt: skip
    return "WITH " + ",".join(parts).replace("branch\nFROM r JOIN", "m.branch\nFROM r JOIN").replace("o.host, branch,", "o.host, o.branch,").replace("bad + 10", "o.bad + 10").replace("/ (labelled + 10", "/ (o.labelled + 10")


@query("op7_url_filters", _url_sql())
def op7_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on every page's url: by rule, else by the purity of its template, learned from the ruled urls."""
    parts = urlfilter.with_parts(read(spark, sf, "pages").select("page_id", "url")).drop("url")
    ruled = parts.withColumn("_rule", urlfilter.matched_rule(URL_RULES))
    labelled = ruled.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("_verdict"))
    labelled = labelled.withColumn("bad", F.when(F.col("_verdict") == "block", 1).when(F.col("_verdict") == "allow", 0))
    found = urlfilter.filter_urls(labelled)
    verdict = F.coalesce("_verdict", F.when(F.col("reject"), "block").otherwise("allow"))
    return found.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "branch")


@query("op11_whitening")
def op11_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """First four whitened components of every embedding; a deviation beyond a long is null."""
    found = whitening.whiten(read(spark, sf, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", F.expr("try_cast(deviation AS long)").alias("deviation"), "whitened", "explained", "identity_error")


TRIE_SQL = r"""
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS x FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h FROM own),
x AS (SELECT a.conv_id, list_concat(coalesce(b.x, [])[1:a.h], a.x[a.h + 1:]) AS x FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT conv_id, len(x) AS n, unnest(range(len(x) + 1)) AS depth, x FROM x),
m AS (SELECT x[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM p GROUP BY ALL),
k AS (SELECT path[1:depth - 1] AS up, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY ALL),
v AS (SELECT m.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN depth > 0 THEN length(path[depth].text) ELSE 0 END AS own FROM m LEFT JOIN k ON m.path = k.up),
a AS (SELECT path[1:d] AS top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM v) GROUP BY ALL)
SELECT v.conv_id, v.depth, u.conv_id AS parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, sha256(v.ends) AS ends_sha256
FROM v JOIN a ON v.path = a.top LEFT JOIN m u ON v.depth > 0 AND u.path = v.path[1:v.depth - 1]
"""


@query("op12_prefix_trie", TRIE_SQL)
def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations, each with the first turns of the first conversation of its hundred."""
    own = prefix_trie.turn_lists(read(spark, sf, "conversations").select("conv_id", "turn", "role", "text"))
    first = F.col("conv_id") - F.col("conv_id") % 100
    heads = own.where(F.col("conv_id") == first).select(F.col("conv_id").alias("_first"), *(F.slice(c, 1, 5).alias(f"_{c}") for c in ("keys", "chars")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    joined = own.join(heads, first == F.col("_first"), "left")
    # A list without its first h turns; none where there are fewer.
    parts = {c: (F.col(f"_{c}"), F.slice(c, h + 1, F.greatest(F.size(c) - h, F.lit(0)))) for c in ("keys", "chars")}
    rebuilt = joined.select("conv_id", *(F.when(head.isNull(), rest).otherwise(F.concat(F.slice(head, 1, h), rest)).alias(c) for c, (head, rest) in parts.items()))
    return prefix_trie.listed(prefix_trie.prefix_trie(rebuilt))


LINE_SQL = r"""
WITH l AS (SELECT r, doc_id, unnest(x) AS line, unnest(range(len(x))) AS place
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""


@query("op13_line_dedup", LINE_SQL)
def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of every document before, and the digest of those that stay."""
    found = line_dedup.deduplicated(read(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
