"""Token totals by source, language and tokenizer version, kept up to date by signed
batches."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
TOTALS = ("docs", "tokens")
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Words split at ASCII white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_count(text: str) -> Column:
    """UTF-8 bytes; 0 for NULL."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


TOKENIZERS: Mapping[str, Column] = {"words-1": word_count, "utf8-bytes-1": byte_count}


def counted(docs: DataFrame, tokenizers: Mapping = TOKENIZERS, also: Sequence[str] = ()) -> DataFrame:
    """``doc_id, source, lang, *also, tokenizer, tokens``: a row per document and tokenizer
    version, in one pass over the texts. A tokenizer is a function from a column name to
    a count column. NULL texts have 0 tokens; NULL sources and languages stay."""
    counts = [F.struct(F.lit(k).alias("tokenizer"), f("text").alias("tokens")) for k, f in tokenizers.items()]
    kept = ["doc_id", "source", "lang", *also]
    return docs.select(*kept, F.explode(F.array(*counts)).alias("_c")).select(*kept, "_c.tokenizer", "_c.tokens")


def inserts(counts: DataFrame) -> DataFrame:
    """Signed rows for documents that arrive."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Signed rows for documents that go, with the counts they came with."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(before: DataFrame, after: DataFrame) -> DataFrame:
    """Signed rows that replace earlier counts: what was counted goes, what is counted now
    comes. No join is needed, since totals only add, and a document may change its source,
    language or tokenizer version."""
    return deletes(before).unionByName(inserts(after))


class Rollup:
    """Additive totals in a folder that all executors share.

    ``commit`` adds a batch once: a batch id seen before changes nothing, so a job may be
    run again after any failure. The batch's totals are written first, over whatever a
    broken attempt left under the same id, and its id is appended to the commit log last;
    totals count batches in the log only. One writer commits at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.log = f"{self.folder}/log"

    def _read_log(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch string").parquet(self.log)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], "batch string")

    def committed(self) -> DataFrame:
        return self._read_log().distinct()

    def commit(self, batch: str, signed: DataFrame) -> bool:
        """Add signed rows ``source, lang, tokenizer, docs, tokens`` under a batch id; False
        if that id is in already. Rows are summed before they are shuffled and written, so
        a batch is stored as one row per key."""
        if not batch or any(not (c.isalnum() or c in "-_.") for c in batch):
            raise ValueError("a batch id has letters, digits, '-', '_' and '.' only")
        if self._read_log().where(F.col("batch") == batch).head(1):
            return False
        summed(signed).write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        self.spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("append").parquet(self.log)
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over the committed batches. Keys whose
        documents have all gone are left out."""
        folders = [f"{self.folder}/deltas/batch={r['batch']}" for r in self.committed().collect()]
        shape = "source string, lang string, tokenizer string, docs long, tokens long"
        if not folders:
            return self.spark.createDataFrame([], shape)
        return summed(self.spark.read.schema(shape).parquet(*folders)).where("docs != 0 or tokens != 0")


def summed(signed: DataFrame) -> DataFrame:
    return signed.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in TOTALS])
