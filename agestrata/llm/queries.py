"""The operators over the given tables, with production parameters, and SQL for those that
SQL can express."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agestrata.llm import (
    filter_audit,
    fingerprints,
    graph_index,
    langid,
    long_repeats,
    mixing,
    packing,
    repeats,
    rollups,
    secrets,
    simhash,
    vector_codes,
    warc,
)
from agestrata.llm.store import new_folder, written

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents held out of the fit, and the least score of a language that is accepted.
FOLDS, HELD_OUT, LEAST_SCORE = 4, 2, 0.35


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(table(spark, sf_dir, "documents"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after three batches: all documents arrive; texts with white space at their
    ends are counted again without it; later copies of a text are deleted. Every batch is
    sent twice, as after a lost reply, and counts once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    blank = F.lit(" \t\n\x0b\x0c\r")
    trimmed = docs.withColumn("text", F.btrim("text", blank)).withColumn("_h", F.sha2("text", 256))
    changed = F.octet_length("text") != F.octet_length(F.btrim("text", blank))
    first = trimmed.groupBy("_h").agg(F.min("doc_id").alias("_kept"), F.count("*").alias("_n")).where("_n > 1")
    # Stored, so that its size is known; the other side has counts in place of texts.
    first = written(first.drop("_n"), "rollup-copies")
    copies = rollups.counted(trimmed, also=["_h"]).join(first, "_h").where("doc_id != _kept")
    before = rollups.counted(docs.where(changed))
    after = rollups.counted(docs.where(changed).withColumn("text", F.btrim("text", blank)))
    rollup = rollups.Rollup(spark, new_folder(spark, "rollup"))
    for _ in range(2):
        rollup.commit("arrived", rollups.inserts(rollups.counted(docs)))
        rollup.commit("recounted", rollups.revisions(before, after))
        rollup.commit("copies-gone", rollups.deletes(copies))
    return rollup.totals()


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return graph_index.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def language_model(docs: DataFrame) -> langid.Model:
    """Fitted on documents outside the held-out fold."""
    return langid.train(docs.where(F.coalesce(_fold("doc_id") != HELD_OUT, F.lit(True))))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select(
        "doc_id", F.coalesce(_fold("doc_id") == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER, most=2048, end_id=0)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.encode(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = long_repeats.remove_long_repeats(table(spark, sf_dir, "documents"), length=200)
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_syncmer_fingerprints, op2_warc_round_trip, op3_token_rollup, op4_simhash_groups, op5_secret_spans,
        op6_graph_neighbours, op7_language, op8_repeated_passages, op9_source_mix, op10_packed_sequences, op11_filter_audit,
        op12_vector_codes, op13_long_repeats,
    )
}

# A digest of 40 hex digits is 32 characters of five bits, four for every five digits.
_BASE32 = """array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      ((('0x' || substr(h, (i // 4 * 5 + 1)::INTEGER, 5))::BIGINT >> (15 - i % 4 * 5)::BIGINT) & 31)::INTEGER + 1, 1)), '')"""

_SPACES = r"[\x20\x09-\x0D]+"
_WORDS = rf"list_filter(string_split_regex(coalesce(text, ''), '{_SPACES}'), lambda w: w != '')"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"



def _codes_sql(rounds: int) -> str:
    """Codebooks round by round, every distance measured."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
          SELECT p.row, p.part, any_value(p.x) AS x,
                 min((list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 16 + b.entry)) AS best
          FROM p JOIN b{r} b ON p.part = b.part GROUP BY p.row, p.part)""")
        if r < rounds:
            steps.append(f"""
        s{r} AS (
          SELECT part, best % 16 AS entry, j, sum(x[j]) AS total, count(*)::HUGEINT AS n
          FROM a{r}, unnest(range(1, len(x) + 1)) AS t(j) GROUP BY ALL),
        m{r} AS (
          SELECT part, entry, list(((total - ((total % n) + n) % n) // n)::BIGINT ORDER BY j) AS x FROM s{r} GROUP BY ALL),
        b{r + 1} AS MATERIALIZED (
          SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
          FROM b{r} b LEFT JOIN m{r} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
        WITH k AS (
          SELECT row_number() OVER (ORDER BY vec_id, embedding) AS row, vec_id, label,
                 list_transform(embedding, lambda e: floor(4096 * e::DOUBLE)::BIGINT) AS x
          FROM embeddings
          WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
        p AS MATERIALIZED (
          SELECT row, part, x[part * (len(x) // 8) + 1 : (part + 1) * (len(x) // 8)] AS x FROM k, unnest(range(8)) AS t(part)),
        b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM p WHERE row <= 16),{",".join(steps)},
        e AS (
          SELECT row, string_agg('0' || substr('0123456789abcdef', (best % 16 + 1)::BIGINT, 1), '' ORDER BY part) AS code,
                 sum(best // 16)::BIGINT AS error
          FROM a{rounds} GROUP BY row),
        h AS (
          SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
        FROM k JOIN e ON k.row = e.row, h"""


ORACLES = {
    "op12_vector_codes": _codes_sql(6),
    "op2_warc_round_trip": f"""
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
                 max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
          FROM pages)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM p""",
    "op3_token_rollup": f"""
        WITH t AS (SELECT doc_id, source, lang, trim(text, {_BLANK}) AS text FROM documents),
        kept AS (
          SELECT * FROM t
          WHERE text IS NULL OR doc_id IS NULL
          UNION ALL
          SELECT * FROM t WHERE text IS NOT NULL AND doc_id IS NOT NULL
          QUALIFY doc_id = min(doc_id) OVER (PARTITION BY text)),
        counted AS (
          SELECT source, lang, 'words-1' AS tokenizer, len({_WORDS}) AS n FROM kept
          UNION ALL SELECT source, lang, 'utf8-bytes-1', strlen(coalesce(text, '')) FROM kept)
        SELECT source, lang, tokenizer, count(*) AS docs, sum(n)::BIGINT AS tokens
        FROM counted GROUP BY ALL""",
    "op8_repeated_passages": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        windows AS (
          SELECT doc_id, s.i AS start, array_to_string(w[s.i : s.i + 19], ' ') AS run
          FROM d, unnest(range(1, len(w) - 18)) AS s(i)),
        repeated AS (
          SELECT doc_id, start FROM windows
          QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, start) > 1),
        gone AS (SELECT DISTINCT doc_id, start + k.j AS place FROM repeated, unnest(range(20)) AS k(j)),
        lists AS (SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(places), 0)::BIGINT AS n_removed,
               sha256(CASE WHEN places IS NULL THEN array_to_string(w, ' ')
                 ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(places, i)), ' ') END) AS kept_sha256
        FROM d LEFT JOIN lists ON d.doc_id = lists.doc_id""",
    "op9_source_mix": f"""
        WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, length(coalesce(text, '')) AS chars FROM documents),
        k AS (
          SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496)
            / CASE WHEN chars::DOUBLE / greatest(size, 1) BETWEEN 3 AND 10 THEN 1.0::DOUBLE ELSE 0.5 END AS key
          FROM d),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size,
                 ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
          FROM k GROUP BY source),
        o AS (
          SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / weight, source) AS place,
                 ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0))
                   / sum(weight) OVER after AS level
          FROM s
          WINDOW before AS (ORDER BY source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 after AS (ORDER BY source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        l AS (SELECT arg_min(level, place) FILTER (level * weight <= cap) AS level FROM o),
        t AS (
          SELECT source, source_size, least(cap, weight * l.level) AS target,
                 CASE WHEN source_size > 0 THEN floor(least(cap, weight * l.level) / source_size) ELSE 0 END AS epochs
          FROM o, l),
        r AS (
          SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
                 sum(size) OVER (PARTITION BY k.source ORDER BY key) AS upto,
                 sum(size) OVER (PARTITION BY k.source, key) AS tied
          FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (size * (epochs + CASE WHEN rest > 0 AND (upto <= rest OR upto - rest < rest - (upto - tied))
                 THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r""",
    "op11_filter_audit": f"""
        WITH d AS (
          SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        l AS (
          SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
          FROM labels GROUP BY doc_id),
        f AS (
          SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                 (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
                 + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
                 + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
                 + (CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS fails
          FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
        c AS (SELECT part, fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(letter, bit)),
        orders AS (
          SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
          FROM letters a, letters b, letters c, letters d, letters e
          WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
        steps AS (
          SELECT filter_order, s.step::INTEGER AS step, own.letter, own.bit,
                 (SELECT coalesce(sum(x.bit), 0) FROM letters x WHERE position(x.letter IN filter_order) < s.step) AS done
          FROM orders, range(1, 6) AS s(step), letters own WHERE own.letter = substr(filter_order, s.step, 1)),
        r AS (
          SELECT part, filter_order, step, letter,
                 coalesce(sum(n) FILTER ((fails & (done | bit)) = 0), 0)::BIGINT AS kept,
                 coalesce(sum(n) FILTER ((fails & done) = 0 AND (fails & bit) != 0), 0)::BIGINT AS removed,
                 coalesce(sum(n) FILTER ((fails & done) != 0 AND (fails & bit) != 0), 0)::BIGINT AS redundant,
                 coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
                 coalesce(sum(n) FILTER (good AND (fails & done) = 0 AND (fails & bit) != 0), 0)::BIGINT AS good_lost,
                 coalesce(sum(n) FILTER (toxic AND (fails & done) = 0 AND (fails & bit) != 0), 0)::BIGINT AS toxic_lost
          FROM c, (SELECT filter_order, step, letter, bit, done::INTEGER AS done FROM steps) GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM r""",
    # Texts as hex digits, cut into overlapping blocks so that no window is sought from afar.
    "op13_long_repeats": """
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        blocks AS (SELECT r, b.i AS block, substr(h, 2000 * b.i + 1, 2398) AS h FROM d, unnest(range(0, len(h) // 2000 + 1)) AS b(i)),
        w AS (
          SELECT r, 1000 * block + s.i AS start, md5_number(substr(h, 2 * s.i + 1, 400)) AS k
          FROM blocks, unnest(range(0, least(1000, len(h) // 2 - 199))) AS s(i)),
        twice AS (SELECT r, start FROM w QUALIFY count(*) OVER (PARTITION BY k) > 1),
        edges AS (
          SELECT r, start, start - lag(start) OVER o AS gap, lead(start) OVER o - start AS ahead
          FROM twice WINDOW o AS (PARTITION BY r ORDER BY start)),
        first AS (
          SELECT r, start, row_number() OVER (PARTITION BY r ORDER BY start) AS k FROM edges WHERE gap IS NULL OR gap > 200),
        last AS (
          SELECT r, start + 200 AS stop, row_number() OVER (PARTITION BY r ORDER BY start) AS k
          FROM edges WHERE ahead IS NULL OR ahead > 200),
        spans AS (
          SELECT r, k, start, stop, coalesce(lag(stop) OVER (PARTITION BY r ORDER BY k), 0) AS before
          FROM first JOIN last USING (r, k)),
        s AS (
          SELECT r, count(*) AS n_spans, sum(stop - start) AS n_removed, max(stop) AS stop,
                 string_agg(substr(h, 2 * before + 1, 2 * (start - before)), '' ORDER BY k) AS kept
          FROM spans JOIN d USING (r) GROUP BY r)
        SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
               coalesce(n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(stop, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN s ON d.r = s.r""",
}
