"""The registered queries of this subpackage: thin callers that derive the contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathe.llm import decontaminate as d8
from lathe.llm import html_extract as d5
from lathe.llm import langid as d9
from lathe.llm import line_frequency as d10
from lathe.llm import ngram_join as d2
from lathe.llm import packing as d4
from lathe.llm import quality_fm as d7
from lathe.llm import resharding as d6
from lathe.llm import toxicity as d1
from lathe.llm import url_filter as d3
from lathe.llm.textops import remainder, table

WORD_BPE = "word_bpe_49k.json"


def tokenizer_file(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return _scored(docs, d1.score(d1.fit(docs, labels), F.col("text")), 0.5)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    return _scored(docs, d7.score(d7.fit(docs, labels), F.col("text")), 0.3)


def _scored(docs: DataFrame, score, limit: float) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= limit).cast("int"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d2.linked_classes(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return d3.filter_urls(pages, d3.fit(pages)).select("page_id", "host", "path", "rule", "verdict", "ratio")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = d9.fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), d9.predict(model, F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score", "r.rejected")


#: Of a sequence of operator 4; the first third of a document's ids is its prompt and bears no loss.
PACKED = d4.Limits(tokens=2048, segments=5, loss_tokens=1536)
PROMPT_SHARE = 1 / 3


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d4.pack(table(spark, sf_dir, "documents"), tokenizer_file(), prompt_share=PROMPT_SHARE, limits=PACKED)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return d5.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout is one shard for each of 32 hash classes of the source, so one is far too large."""
    docs = table(spark, sf_dir, "documents")
    placed, _ = d6.reshard(docs, F.pmod(F.xxhash64("source"), F.lit(32)), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = d8.find_hits(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        d8.items_digest(F.col("hits.items")).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"),
    )


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d10.line_frequency_rules(table(spark, sf_dir, "documents"))


OPS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_url_filter": op3_url_filter,
    "op4_packing": op4_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_resharding": op6_resharding,
    "op7_quality": op7_quality,
    "op8_decontamination": op8_decontamination,
    "op9_language": op9_language,
    "op10_line_frequency": op10_line_frequency,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP8_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS g
       FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS g
       FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM bw) WHERE len(w) >= size)),
h AS (SELECT doc_id, i, size, item_id FROM dw JOIN bw USING (size, g)),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""

_SP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_DROP = "'0123456789.,;:!?\"''()[]-_' || chr(9) || chr(11) || chr(12) || chr(13)"
OP10_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, {_SP}, '')) > 0) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1) GROUP BY doc_id),
l AS (SELECT doc_id, source, unnest(lines) AS line FROM d),
n AS (SELECT doc_id, source, CASE WHEN trim(translate(lower(line), {_DROP}, '')) <> '' THEN trim(translate(lower(line), {_DROP}, '')) ELSE trim(lower(line)) END AS norm,
             length(translate(line, {_SP}, '')) AS chars FROM l),
held AS (SELECT doc_id, source, norm, sum(chars) AS chars FROM n GROUP BY ALL),
f AS (SELECT source, norm FROM held GROUP BY source, norm HAVING count(*) > 10),
r AS (SELECT doc_id, sum(chars) AS total, sum(CASE WHEN f.norm IS NOT NULL THEN chars ELSE 0 END) AS removed
      FROM held LEFT JOIN f ON held.source = f.source AND held.norm = f.norm GROUP BY doc_id),
base AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {_SP}, '')) AS BIGINT) AS word_chars,
                CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id))
SELECT base.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT coalesce(removed > 0.7 * total, false) AS kept
FROM base LEFT JOIN r USING (doc_id)
"""

OP2_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g
      FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) >= 3 THEN range(1, len(w) - 1) WHEN len(w) > 0 THEN [1] ELSE [] END) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(seen) AS component_id FROM r GROUP BY doc_id) m USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_ngram_jaccard": OP2_SQL, "op8_decontamination": OP8_SQL, "op10_line_frequency": OP10_SQL}
