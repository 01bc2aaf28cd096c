"""The operators' queries over whole tables, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.llm import decontam, langid, pieces, pii, quality, resample, simhash, tokenfiles, warc
from loomgraph.llm.shared import scratch, ship

QUERIES, ORACLES = {}, {}


def query(f):
    def run(spark, sf_dir):
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_pii(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
        pii.written(F.concat("base", "more")).alias("spans"),
    )


@query
def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return langid.predict(docs.select("doc_id", "text"), langid.training(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op3_decontaminate(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query
def op4_quality(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def quality_measures(spark, sf_dir):
    """What the rules of op4 measure, which SQL can say."""
    return quality.measures(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


ORACLES["quality_measures"] = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
held AS (SELECT DISTINCT doc_id, i + k AS place FROM (SELECT g.doc_id, g.i, unnest(range(5)) AS k FROM g SEMI JOIN twice ON g.doc_id = twice.doc_id AND g.gram = twice.gram)),
r AS (SELECT doc_id, count(*) AS n FROM held GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)"""


@query
def op5_token_counts(spark, sf_dir):
    return tokenfiles.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op6_pieces(spark, sf_dir):
    return pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces.model_path())


@query
def op7_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLES["op7_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS n, sha1(html) AS sha FROM p),
b AS (SELECT page_id, n, sha, min(page_id) OVER (PARTITION BY sha) AS first,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
     (CASE WHEN i % 4 = 0 THEN 16 ELSE 0 END) * 0 + list_sum(list_transform(range(5), lambda k:
       (((strpos('0123456789abcdef', substr(sha, 1 + (5 * i + k) // 4, 1)) - 1) >> (3 - (5 * i + k) % 4)) & 1) << (4 - k))))::INT, 1), '' ORDER BY i)
   FROM range(32) AS r(i)) AS digest FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM b"""


@query
def op8_resample(spark, sf_dir):
    return resample.select(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op10_training_order(spark, sf_dir):
    return tokenfiles.materialise(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "order"))
