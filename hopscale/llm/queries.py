"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopscale.llm import chat, decontaminate, licenses, mixing, quality_model, quality_rules, sharding, simhash, suffixes, warc
from hopscale.llm.text import n_space_words, whole


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", "source", n_space_words("text").alias("size"), F.xxhash64(whole("text")).alias("text_key"))
    tmp = mixing.Scratch(spark)
    mixed = mixing.mix_sources(tmp.put(sized, "sized"), doc_id="doc_id", size="size", source="source", weights=(3.0, 1.0, 2.0), budget=1.5, max_copies=2, key=F.col("text_key"))
    return mixed.select("doc_id", "size", "_mix.source_size", "_mix.target", "_mix.taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = licenses.scan(docs)
    r = r.withColumn("_at", F.transform(F.filter("_license.places", lambda p: p["base"]), lambda p: p["word"]))
    return r.select(
        "doc_id",
        "_license.n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join("_license.base_labels", ",").alias("base_labels"),
        F.array_join("_license.labels", ",").alias("labels"),
        "_license.score",
    )


def license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2_license_scan finds by its base phrases alone."""
    return op2_license_scan(spark, sf_dir).drop("labels", "score")


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffixes.remove_repeats(docs).drop("runs")


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = quality_rules.clean_lines(docs)
    return r.select("doc_id", *[f"_rules.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    r = simhash.near_duplicates(docs, shingle=3)
    return r.select("doc_id", F.lower(F.lpad(F.hex(F.get("fps", F.lit(0))), 16, "0")).alias("fingerprint"), "component_id")


def op6_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find_leaks(docs, items, threshold=0.8)
    # repeated ids with other texts: the fullest copy counts
    same = F.array_join(F.first("same_items").cast("array<string>"), ",")
    return found.groupBy("doc_id", "item_id").agg(same.alias("same_items"), F.first("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found"), F.max("containment").alias("containment"))


def op7_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    s = sharding.shard_rows(docs, n_shards=8)
    return s.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = rows.unionByName(spark.createDataFrame(probe, "conv_id long, turn long, role string, text string"))
    made = chat.join_turns(chat.format_turns(rows))
    made = made.withColumn("_text", chat.formatted("segments")).withColumn("_loss", chat.loss_text("segments"))
    made = made.withColumn("_turns", chat.read_back(F.col("_text")))
    joined = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("_text").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    tmp = warc.Scratch(spark)
    warc.write_pages(pages, f"{tmp.path}/archives", min_revisit_bytes=0, tmp=tmp)
    r = warc.read_pages(spark, f"{tmp.path}/archives")
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


def op10_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_model.score(docs, labels, host="source", path="lang").drop("text_key")


QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_license_scan": op2_license_scan,
    "op3_repeats": op3_repeats,
    "op4_line_rules": op4_line_rules,
    "op5_simhash": op5_simhash,
    "op6_leaks": op6_leaks,
    "op7_interleave": op7_interleave,
    "op8_chat": op8_chat,
    "op9_warc": op9_warc,
    "op10_site_quality": op10_site_quality,
    "license_phrases": license_phrases,
}

_WS = r"[\x20\x09-\x0D]+"

ORACLES = {
    "op4_line_rules": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, row_number() OVER () AS rid, list_filter(regexp_split_to_array(t, '{_WS}'), lambda x: x <> '') AS words,
         string_split(t, chr(10)) AS lines FROM d
), x AS (
  SELECT *, len(words) AS n, list_filter(lines, lambda l: regexp_replace(l, '{_WS}', '', 'g') <> '') AS full_lines,
         list_filter(lines, lambda l: regexp_replace(l, '{_WS}', '', 'g') <> '' AND (
           (NOT regexp_matches(l, '{quality_rules.ENDS.replace("'", "''")}') AND len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda y: y <> '')) < 4)
           OR len(regexp_extract_all(l, '{quality_rules.SYMBOLS}')) + len(regexp_extract_all(l, '{quality_rules.SHOUTS}'))
              > len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda y: y <> '')) * 0.3
           OR (len(regexp_extract_all(l, '{quality_rules.SEPARATORS}')) >= 3 AND len(regexp_extract_all(l, '{quality_rules.SEPARATORS}'))
              > len(list_filter(regexp_split_to_array(l, '{_WS}'), lambda y: y <> '')) * 0.3)
           OR regexp_matches(l, '{quality_rules.BOILERPLATE}'))) AS bad
  FROM w
), g AS (
  SELECT rid, i, array_to_string(words[i:i + 7], ' ') AS gram FROM x, unnest(range(1, n - 6)) AS r(i)
), dup AS (
  SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS c FROM dup, range(8) AS o(k) GROUP BY rid
), f AS (
  SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(t, '{quality_rules.SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(len(full_lines) - len(list_distinct(full_lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
         length(regexp_replace(array_to_string(bad, ''), '{_WS}', '', 'g')) AS lost
  FROM x LEFT JOIN cov USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost <= 0.5 * word_chars) AS kept
FROM f
""",
}


def _escaped(c: str) -> str:
    c = f"replace({c}, '{chat.ESCAPE}', '{chat.ESCAPE * 2}')"
    for x in chat.DEFAULT.controls:
        c = f"replace({c}, '{x}', '{x[0]}{chat.ESCAPE}{x[1:]}')"
    return c


ORACLES["op8_chat"] = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, coalesce(lag(role) OVER w, '') AS before, lead(role) OVER w AS after FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), v AS (
  SELECT *, (before || '>' || role) IN ({", ".join(f"'{a}>{b}'" for a, to in chat.DEFAULT.moves.items() for b in to)})
         AND (after IS NOT NULL OR role = 'assistant') AS ok FROM s
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(chat.DEFAULT.start + chat.DEFAULT.sep + chat.DEFAULT.end)}) AS BIGINT) AS formatted_chars,
       bool_and(ok) AS valid
FROM v GROUP BY conv_id
"""

_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES["op6_leaks"] = rf"""
WITH i AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_OTHER}'), lambda x: x <> '') AS w FROM benchmark
), ik AS (
  SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0
), ig AS (
  SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS g FROM ik, unnest(range(1, len(w) - k + 2)) AS r(j)
), sets AS (
  SELECT item_id, k, list(g ORDER BY g) AS gs FROM ig GROUP BY ALL
), classes AS (
  SELECT min(item_id) AS item_id, list(item_id ORDER BY item_id) AS same_items, k, gs FROM sets GROUP BY k, gs
), cg AS (
  SELECT item_id, k, unnest(gs) AS g FROM classes
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_OTHER}'), lambda x: x <> '') AS w FROM documents
), dg AS (
  SELECT DISTINCT rid, doc_id, k, array_to_string(w[j:j + k - 1], ' ') AS g
  FROM d, (SELECT DISTINCT k FROM cg) AS ks, unnest(range(1, len(w) - k + 2)) AS r(j)
), hits AS (
  SELECT rid, doc_id, item_id, count(*) AS n FROM dg JOIN cg USING (k, g) GROUP BY ALL
)
SELECT doc_id, item_id, any_value(array_to_string(same_items, ',')) AS same_items, any_value(CAST(len(gs) AS BIGINT)) AS n_shingles, max(n) AS n_found, max(n / len(gs)) AS containment
FROM hits JOIN classes USING (item_id) WHERE n >= 0.8 * len(gs) GROUP BY doc_id, item_id
"""

_PHRASES = {t.label: t.text.split() for t in licenses.BASE}
_AT = " OR ".join("(label = '{}' AND {})".format(label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))) for label, words in _PHRASES.items())

ORACLES["license_phrases"] = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_OTHER}'), lambda x: x <> '') AS w
  FROM documents
), hits AS (
  SELECT rid, i, label FROM d, unnest(range(1, len(w) + 1)) AS r(i), (VALUES {", ".join(f"('{x}')" for x in _PHRASES)}) AS p(label) WHERE {_AT}
), h AS (
  SELECT rid, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM hits GROUP BY rid
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(first AS BIGINT) AS first_word, CAST(last AS BIGINT) AS last_word, coalesce(labels, '') AS base_labels
FROM d LEFT JOIN h USING (rid)
"""

ORACLES["op3_repeats"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(encode(coalesce(text, '')) AS BLOB) AS t FROM documents
), w AS (
  SELECT rid, doc_id, i, t[i:i + {suffixes.LENGTH - 1}] AS g FROM d, unnest(range(1, octet_length(t) - {suffixes.LENGTH - 2})) AS r(i) WHERE doc_id IS NOT NULL
), first AS (
  SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT rid, i FROM w JOIN first USING (g) WHERE doc_id > low
), marked AS (
  SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + {suffixes.LENGTH}, 0) AS new FROM gone
), runs AS (
  SELECT rid, min(i) AS a, max(i) + {suffixes.LENGTH} AS z FROM (SELECT rid, i, sum(CAST(new AS INT)) OVER (PARTITION BY rid ORDER BY i) AS k FROM marked) GROUP BY rid, k
), pieces AS (
  SELECT rid, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 1) AS p, a AS q FROM runs
  UNION ALL SELECT rid, max(z), 4000000000 FROM runs GROUP BY rid
), kept AS (
  SELECT rid, sha256(unhex(string_agg(hex(t[p:q - 1]), '' ORDER BY p))) AS h FROM pieces JOIN d USING (rid) GROUP BY rid
), sums AS (
  SELECT rid, sum(z - a) AS n, count(*) AS k FROM runs GROUP BY rid
)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, coalesce(h, sha256(t)) AS kept_sha256
FROM d LEFT JOIN sums USING (rid) LEFT JOIN kept USING (rid)
"""

_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
# five hex digits are four digits of base 32
_DIGEST = " || ".join(f"substr('{_B32}', CAST((CAST('0x' || substr(h, {k}, 5) AS INT) >> {bit}) & 31 AS INT) + 1, 1)" for k in range(1, 41, 5) for bit in (15, 10, 5, 0))

ORACLES["op9_warc"] = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY t) AS low FROM p
)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, {_DIGEST} AS payload_digest,
       CASE WHEN page_id > low THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > low THEN low END AS refers_to, url, true AS digest_ok
FROM f
"""
