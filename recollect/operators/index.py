"""The lexical index: the tokens of each memory, its terms by place, and the statistics of all.

It can be stored beside the memories and follows their changes, so that no search tokenizes texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..lineage import spread


@dataclass(frozen=True)
class Index:
    """tokens: (id, agent_id, tokens), a row a memory; postings: (id, agent_id, dl, pos, term)."""

    tokens: DataFrame
    postings: DataFrame

    @property
    def corpus(self) -> DataFrame:
        """One row: memories and terms in all."""
        return self.tokens.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(text.terms(F.col("tokens")))).alias("total"))


def tokens_of(memories: DataFrame) -> DataFrame:
    agent = F.col("agent_id") if "agent_id" in memories.columns else F.lit(None).cast("string").alias("agent_id")
    return memories.select("id", agent, text.tokenize(F.col("content")).alias("tokens"))


def postings_of(tokens: DataFrame) -> DataFrame:
    own = text.let(text.terms(F.col("tokens")), lambda t: F.transform(t, lambda x, i: F.struct(i.alias("pos"), x.alias("term"), F.size(t).alias("dl"))))
    return tokens.select("id", "agent_id", F.explode(own).alias("e")).select("id", "agent_id", "e.dl", "e.pos", "e.term")


def of(memories: DataFrame) -> Index:
    """The index of memories (id, content and, if there, agent_id), made anew."""
    tokens = tokens_of(memories)
    return Index(tokens, postings_of(tokens))


def changed(index: Index, gone: DataFrame, written: DataFrame) -> Index:
    """The index after the memories `gone` (id) went and `written` came or got other contents."""
    stale = gone.select("id").unionByName(written.select("id")).distinct()
    new = of(written)
    return Index(*(old.join(stale, "id", "left_anti").select(old.columns).unionByName(fresh.select(old.columns)) for old, fresh in ((index.tokens, new.tokens), (index.postings, new.postings))))


def save(index: Index, folder: str) -> None:
    """Tokens as they come; postings together by term, so that a scan for some terms skips the rest."""
    index.tokens.write.mode("overwrite").parquet(f"{folder}/tokens")
    tokens = index.tokens.sparkSession.read.parquet(f"{folder}/tokens")
    postings_of(tokens).repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")


def load(spark: SparkSession, folder: str) -> Index:
    return Index(spark.read.parquet(f"{folder}/tokens"), spark.read.parquet(f"{folder}/postings"))


def kept(memories: DataFrame, folder: str) -> Index:
    """The index in a folder; made and saved there first where there is none. The folder is to be named after the memories' version."""
    spark = memories.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/postings/_SUCCESS")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        save(of(spread(memories)), folder)
    return load(spark, folder)
