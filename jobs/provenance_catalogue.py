"""Which records may be used: a catalogue of distinct texts with all collections that hold them, kept up to date by stream.

A library's record (a row of documents) names the collections it comes from, its source and language. Copies of a record
come from several, and the policy decides by all of them, so a later file can change what an earlier record may be used
for. The job has two steps:

1. Stream what is new. A file stream over the documents, with a checkpoint, takes the files that no run before took and
   appends (doc_id, record_key, n_words, collections) to records/, partitioned by the key's first digit. Texts stay behind.
2. Build catalogue/ from all records: a row a distinct text with its collections, partitioned by disposition. It is
   overwritten whole, from records alone.

A run that is repeated takes no file twice and writes the same catalogue; one that was stopped in step 1 goes on at the
checkpoint, one that was stopped in step 2 is mended by the next. Copies are grouped with partial aggregates, so a text
that a third of all rows repeat is one row a task before the shuffle. A null text counts as an empty one.

    python -m jobs.provenance_catalogue --documents /data/documents --output /data/provenance --checkpoint /data/provenance-checkpoint
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massloom.functions import chem

from .common import command_line, log

SCHEMA = "doc_id long, text string, lang string, source string"
RECORDS = "doc_id long, record_key string, n_words long, collections array<string>, bucket string"
BLANK = "[\\x20\\x09-\\x0D]+"


def records_of(documents: DataFrame) -> DataFrame:
    """(doc_id, record_key, n_words, collections, bucket): texts that differ in blanks alone have one key."""
    text = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANK, " "))
    key = F.sha2(text, 256)
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " "))).cast("long")
    names = chem.parse_collections(F.concat_ws("|", "source", "lang"))
    return documents.select("doc_id", key.alias("record_key"), words.alias("n_words"), names.alias("collections"), F.substring(key, 1, 1).alias("bucket"))


def catalogue_of(records: DataFrame, config: dict) -> DataFrame:
    """A row a record_key: its first document, counts, all collections, and what the policy says of them."""
    each = records.select("record_key", "doc_id", "n_words", F.explode_outer("collections").alias("collection"))
    # by collection first: a text that many rows repeat is few rows when its collections are gathered
    by_name = each.groupBy("record_key", "collection").agg(F.min("doc_id").alias("first_doc"), F.countDistinct("doc_id").alias("n"), F.max("n_words").alias("n_words"))
    sets = by_name.groupBy("record_key").agg(F.min("first_doc").alias("first_doc"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set("collection")).alias("names"))
    sizes = records.groupBy("record_key").agg(F.count("*").alias("n_records"))
    names = F.col("names")
    return sets.join(sizes, "record_key").select(
        "record_key", "first_doc", "n_records", "n_words", F.array_join("names", "|").alias("collections"),
        F.size(chem.approved_collections(names, tuple(config["approved"]))).cast("long").alias("n_approved"),
        chem.classify_collections(names, tuple(config["approved"]), tuple(config["review"]), tuple(config["excluded"])).alias("disposition"),
    )


def read_records(spark: SparkSession, output: str) -> DataFrame:
    """All records so far; none before the first file came."""
    try:
        return spark.read.schema(RECORDS).parquet(f"{output}/records")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORDS)


def _pattern(path: str) -> str:
    """A pattern that the path alone matches: a stream takes a folder as it is, a single file by pattern only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: dict) -> dict:
    """Take the new files of documents and rebuild the catalogue; returns what was read and written."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(_pattern(documents))
    query = records_of(stream).writeStream.format("parquet").option("path", f"{output}/records").option("checkpointLocation", checkpoint).partitionBy("bucket").trigger(availableNow=True).start()
    query.awaitTermination()
    new = sum(p["numInputRows"] for p in query.recentProgress)
    records = read_records(spark, output)
    catalogue_of(records, config).write.mode("overwrite").partitionBy("disposition").option("compression", "zstd").parquet(f"{output}/catalogue")
    counts = {"new": new, "records": records.count(), "catalogue": read_catalogue(spark, output).count()}
    log.info("read %(new)d new rows; %(records)d records in all; wrote %(catalogue)d distinct texts", counts)
    return counts


def read_catalogue(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema("record_key string, first_doc long, n_records long, n_words long, collections string, n_approved long, disposition string").parquet(f"{output}/catalogue")


if __name__ == "__main__":
    command_line("provenance_catalogue", {"documents": "folder or file of documents, Parquet", "output": "folder of records/ and catalogue/", "checkpoint": "folder of the stream's checkpoint"}, run)
