"""The registered queries of this subpackage and the SQL that some are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcella.llm import (
    alignment,
    decontamination,
    html_blocks,
    licenses,
    minmax,
    multiset_hash,
    periodic_runs,
    pieces,
    pii,
    quality,
    suffix_dedup,
    topk,
    toxicity,
)
from parcella.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find_leaks(documents, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.size("leaks").cast("long").alias("n_items"),
        F.col("leaks.item_id").alias("item_ids"),
        F.array_max("leaks.share").alias("largest_share"),
        (F.size("leaks") > 0).alias("contaminated"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(documents, table(spark, sf_dir, "labels"))
    names = [*toxicity.CATEGORIES, toxicity.LAST]
    chances = [F.col("p_toxicity")[i].alias(f"p_{name}") for i, name in enumerate(names)]
    return scored.select("doc_id", *chances, (F.col("p_toxicity")[len(names) - 1] >= toxicity.THRESHOLD).alias("toxic"))


def op3_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM worded),
parts AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM parts x JOIN parts y ON x.g = y.g AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS root FROM sets
  UNION SELECT l.b, r.root FROM reach r JOIN links l ON r.doc_id = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM sets s JOIN (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id) c ON s.doc_id = c.doc_id
"""


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_blocks.extract_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = pieces.decode(pieces.encode(documents))
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    extra = F.size(F.filter("spans", lambda s: ~s.base)).cast("long").alias("n_added")
    return found.select("doc_id", *pii.digest(), extra)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.expr("cast(size(ranges) / 2 AS bigint)").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.find_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = found.select("doc_id", "n_words", "places", F.expr("filter(places, p -> p.base)").alias("base"))
    joined = lambda name: F.expr(f"array_join(array_sort(array_distinct({name}.label)), ',')")
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"),
        F.array_max("base.start").cast("long").alias("last_word"),
        joined("base").alias("base_labels"),
        joined("places").alias("labels"),
        F.coalesce(F.array_max("places.coverage"), F.lit(0.0)).alias("score"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def _made_periodic(documents: DataFrame) -> DataFrame:
    """doc_id and text; of every tenth id (by its hash) the words behind a start repeat with one period."""
    hashed = documents.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    words = "filter(split(text, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    worded = hashed.withColumn("words", F.expr(f"if(h % 10 = 0, {words}, NULL)"))
    counted = worded.withColumn("n", F.expr("size(words)")).withColumn("g", F.expr("h div 10"))
    placed = counted.withColumn("a", F.expr("if(n > 0, g % n, NULL)"))
    placed = placed.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    tail = "slice(flatten(array_repeat(slice(words, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))"
    return placed.selectExpr(
        "doc_id", f"if(n > 0, array_join(concat(slice(words, 1, int(a)), {tail}), ' '), text) AS text"
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _made_periodic(table(spark, sf_dir, "documents"))
    found = periodic_runs.with_runs(documents)
    # Runs stand by start, then period: a later one must be better to win.
    best = "aggregate(slice(runs, 2, greatest(size(runs), 1)), runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))"
    found = found.withColumn("best", F.expr(f"if(size(runs) > 0, {best}, NULL)"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = multiset_hash.with_edit(multiset_hash.with_next(documents))
    hashed = multiset_hash.with_fingerprints(edited, {"text": "own", "edited": "changed"})
    return hashed.select(
        "doc_id",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        multiset_hash.as_text(F.col("own")).alias("fingerprint"),
        multiset_hash.as_text(F.col("changed")).alias("edited_fingerprint"),
        multiset_hash.likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        multiset_hash.likeness(F.col("own"), F.col("next_fingerprint")).alias("near_next"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(table(spark, sf_dir, "documents"))


def _op12_lanes() -> str:
    m = multiset_hash
    half = m.DIGITS * 2
    bit = lambda shift: (
        f"flatten(list_transform(range({m.NUMBERS}), lambda c: list_transform(range({half}), lambda k: "
        f"CAST(coalesce(list_sum(list_transform(digests, lambda d: "
        f"(CAST('0x' || substr(d, CAST({m.DIGITS} * c + 1 AS BIGINT), {m.DIGITS}) AS BIGINT) >> (k + {shift})) & 1)), 0) AS BIGINT))))"
    )
    return f"list_concat([len(digests)], {bit(0)}, {bit(half)})"


OP12_SQL = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
followed AS (
  SELECT doc_id, text, length(text) // 2 AS half,
    coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following
  FROM whole),
edits AS (SELECT doc_id, text, left(text, length(text) - half) || left(following, half) AS edited, following FROM followed),
versions AS (
  SELECT doc_id, 'own' AS version, text AS t FROM edits
  UNION ALL SELECT doc_id, 'edited', edited FROM edits
  UNION ALL SELECT doc_id, 'next', following FROM edits),
hashed AS (
  SELECT doc_id, version, list_transform(list_filter(string_split(regexp_replace(t, '{multiset_hash.SENTENCE_END}', '\\1' || chr(10), 'g'), chr(10)),
    lambda p: p <> ''), lambda p: sha256(p)) AS digests FROM versions),
laned AS (SELECT doc_id, version, {_op12_lanes()} AS f FROM hashed),
signed AS (
  SELECT doc_id, version, f, list_transform(f[2:], lambda x: CAST(2 * x - f[1] AS DOUBLE)) AS s FROM laned),
likened AS (
  SELECT doc_id, o.f AS fo, e.f AS fe,
    CASE WHEN o.f = e.f THEN 1.0 WHEN list_dot_product(o.s, o.s) * list_dot_product(e.s, e.s) = 0 THEN 0.0
      ELSE least(1.0, greatest(0.0, list_dot_product(o.s, e.s) / (sqrt(list_dot_product(o.s, o.s)) * sqrt(list_dot_product(e.s, e.s))))) END AS near_edited,
    CASE WHEN o.f = n.f THEN 1.0 WHEN list_dot_product(o.s, o.s) * list_dot_product(n.s, n.s) = 0 THEN 0.0
      ELSE least(1.0, greatest(0.0, list_dot_product(o.s, n.s) / (sqrt(list_dot_product(o.s, o.s)) * sqrt(list_dot_product(n.s, n.s))))) END AS near_next
  FROM (SELECT * FROM signed WHERE version = 'own') o
    JOIN (SELECT * FROM signed WHERE version = 'edited') e USING (doc_id)
    JOIN (SELECT * FROM signed WHERE version = 'next') n USING (doc_id))
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256,
  array_to_string(list_transform(fo, lambda x: format('{{:08x}}', x)), '') AS fingerprint,
  array_to_string(list_transform(fe, lambda x: format('{{:08x}}', x)), '') AS edited_fingerprint,
  CAST(near_edited AS DOUBLE) AS near_edited, CAST(near_next AS DOUBLE) AS near_next
FROM edits JOIN likened USING (doc_id)
"""


def _template_rows() -> str:
    rows = []
    for t in licenses.templates():
        keys = {at for _, at in t.key_words()}
        rows += [
            f"({t.number}, '{t.label}', {str(t.base).lower()}, {len(t.words)}, {len(keys)}, {j}, '{w}', {str(j in keys).lower()})"
            for j, w in enumerate(t.words)
        ]
    return ", ".join(rows)


OP9_SQL = f"""
WITH t(template, label, base, size, n_keys, place, word, is_key) AS (VALUES {_template_rows()}),
worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM worded),
places AS (
  SELECT doc_id, template, label, base, pos - place AS start, count(*) / CAST(size AS DOUBLE) AS coverage
  FROM words JOIN t USING (word) GROUP BY doc_id, template, label, base, size, n_keys, pos - place
  HAVING count(*) FILTER (is_key) = n_keys),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score
  FROM places GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM worded LEFT JOIN found USING (doc_id)
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_minmax_dedup": op3_minmax_dedup,
    "op4_html_text": op4_html_text,
    "op5_pieces": op5_pieces,
    "op6_personal_data": op6_personal_data,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_topk": op8_topk,
    "op9_license_scan": op9_license_scan,
    "op10_quality": op10_quality,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_multiset_hash": op12_multiset_hash,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op3_minmax_dedup": OP3_SQL,
    "op8_topk": OP8_SQL,
    "op9_license_scan": OP9_SQL,
    "op12_multiset_hash": OP12_SQL,
}
