"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch is a table of signed changes. It is summed before anything moves, and the sums
are committed as one folder of the rollup. A batch id is committed once: its folder is written
beside the table and renamed into place, and a batch that is there already is left alone, so
a driver may send a batch again after any failure. Totals are sums over the committed folders.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
_SCHEMA = "source string, lang string, version string, docs long, tokens long"

# Counters by tokenizer version: white-space words, and words and marks apart.
COUNTERS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"}


def token_count(text: Column, version: str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(COUNTERS[version])).cast("long")


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents (source, lang, version, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents away that were inserted with the same counts."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).cast("long").alias("tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Changes that replace counts: the old ones go, the new ones, of another version or not, come."""
    return deletes(old).union(inserts(new))


@dataclass(frozen=True)
class Rollup:
    """A table of committed batches below `path`."""

    spark: SparkSession
    path: str

    def _file(self, name: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def committed(self, batch: str) -> bool:
        place, files = self._file(f"batch={batch}")
        return files.exists(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing done, if its id is there already.

        Renaming a finished folder is the commit. Whoever renames second finds the
        name taken, and what was left by a failed try is never read.
        """
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"batch id {batch!r} has other characters than letters, digits, - and _")
        if self.committed(batch):
            return False
        sums = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")
        draft = f"_draft-{batch}-{uuid.uuid4().hex}"
        sums.write.parquet(f"{self.path.rstrip('/')}/{draft}")
        source, files = self._file(draft)
        target, _ = self._file(f"batch={batch}")
        if not files.exists(target) and files.rename(source, target):
            # A folder renamed into one that came first would lie inside it.
            inner, _ = self._file(f"batch={batch}/{draft}")
            if not files.exists(inner):
                return True
            files.delete(inner, True)
            return False
        files.delete(source, True)
        return False

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over all batches; keys that have come to nothing are left out."""
        place, files = self._file("batch=*")
        if not files.globStatus(place):
            return self.spark.createDataFrame([], _SCHEMA)
        rows = self.spark.read.schema(_SCHEMA).parquet(f"{self.path.rstrip('/')}/batch=*")
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).filter("docs <> 0 or tokens <> 0")


def document_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang) of each row with one count per tokenizer version; null texts count 0, null keys are keys."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
                       *[token_count(F.col("text"), v).alias(v) for v in COUNTERS])


def of_version(counts: DataFrame, version: str) -> DataFrame:
    return counts.select("source", "lang", F.lit(version).alias("version"), F.col(version).alias("tokens"))


def rolled_up(docs: DataFrame, labels: DataFrame, path: str) -> DataFrame:
    """The totals of `docs` after four batches, one of which is sent twice.

    All documents come in under the first version; those labelled as of low quality are
    taken out; what is left in languages other than English is counted anew under
    the second version. Documents without a language count as English here.
    """
    from barloom.llm.common import written

    rollup = Rollup(docs.sparkSession, path)
    low = labels.filter("quality = 0").select(F.col("doc_id").alias("_low")).distinct()
    counts = written(document_counts(docs).join(low, F.col("doc_id") == F.col("_low"), "left"), "token-counts")
    bad, good = counts.filter("_low is not null"), counts.filter("_low is null")
    other = good.filter("lang <> 'en'")
    rollup.commit("insert", inserts(of_version(counts, "words-1")))
    rollup.commit("delete", deletes(of_version(bad, "words-1")))
    rollup.commit("insert", inserts(of_version(counts, "words-1")))
    rollup.commit("revise", revisions(of_version(other, "words-1"), of_version(other, "words-2")))
    return rollup.totals()
