"""The corpus pipeline: stages over `documents`, each written as Parquet and reread as the next one's input.

All stages but the last return the columns of documents. Clean documents stay: language identification lets go
what it rejects (texts without a letter or a likely language), the Jaccard join keeps the document of least id of
each group, decontamination lets go what has a benchmark window, mixing repeats or leaves out whole
documents so that sources come near their targets, and sharding places what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshgrain.llm import decontamination, language, mixing, sharding, shingle_join
from meshgrain.llm.shared import written
from meshgrain.llm.textio import hidden


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language, and keeps the documents whose prediction isn't rejected.

    A text that is null or has no letter goes. Repeated rows stay or go together; other columns, of any names, are kept;
    an empty table, or one without a language, keeps nothing.
    """
    model = language.fit(docs)
    plain, name = hidden(docs)
    found = language.predict(plain, model, text_col=name["text"], keep=plain.columns)
    return found.filter(~F.col("rejected")).select(*plain.columns).toDF(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (5-word shingles, similarity of 0.75 or more) the document of least id.

    Documents are told apart by id and text: rows that agree in both are one document. A null id comes after all
    others. A text without words, or null, is linked with nothing and stays. Other columns, of any names, are kept, those of
    any one row among rows that are one document; an empty table stays empty.
    """
    plain, name = hidden(docs)
    place = F.lpad((F.col(name["doc_id"]).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    keyed = plain.withColumn("row_key", F.concat_ws(":", F.coalesce(place, F.lit("~")), F.md5(F.coalesce(name["text"], F.lit("")))))
    groups = shingle_join.groups(keyed, id_col="row_key", text_col=name["text"])
    stay = groups.filter("row_key = component_id").select("row_key").distinct()
    return keyed.join(stay, "row_key", "left_semi").dropDuplicates(["row_key"]).select(*plain.columns).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lets go the documents with a verbatim benchmark window of 10 words.

    A null or empty text stays; repeated rows stay or go together; other columns, of any names, are kept; an empty table
    stays empty.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix says; a fractional repetition is a whole one from one half on.

    A text without words, or null, costs nothing and stays once at least. A null source is a source; repeated rows
    are documents each; other columns, of any names, are kept; an empty table stays empty.
    """
    plain, name = hidden(docs)
    mixed = mixing.mix(plain.withColumn("doc_id", F.col(name["doc_id"])), text_col=name["text"], source_col=name["source"], carry=plain.columns)
    times = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    times = F.when(F.col("size") == 0, F.greatest(times, F.lit(1))).otherwise(times)  # a text without words costs nothing
    rows = mixed.withColumn("times", times.cast("int")).filter("times > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return rows.select(*plain.columns).toDF(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its region, rack and shard as last columns; repetitions of a document share a shard.

    A null id is a key like others; a column of docs with one of the three names keeps its values, the added one
    gets an underscore before its name; an empty table stays empty.
    """
    return sharding.assign(docs, "doc_id", sharding.planned())


STAGES = [("language_id", identify), ("jaccard_join", distinct), ("decontamination", decontaminate), ("source_mix", mix), ("sharding", shard)]

#: Hashes and models that DuckDB doesn't have; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
