"""What can be put in from outside: connectors, stores, extractors, canonicalisers, proposers, profilers, gateways.

An extension is a function or an object with these methods; all take and give DataFrames or Columns, so that what is put in
stays part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as T
from quillon.operators import aliases, fragments, mentions
from quillon.sources import feeds, files

#: Columns to columns: extracted text of stored bytes, canonical form of a mention.
TextExtractor = Callable[[Column], Column]
Canonicalizer = Callable[[Column], Column]
#: DataFrames to DataFrames: forms to alias signals, texts to observations, observations to profiles.
AliasProposer = Callable[[DataFrame], DataFrame]
ObservationExtractor = Callable[[DataFrame], DataFrame]
FragmentProfiler = Callable[[DataFrame], DataFrame]


@runtime_checkable
class Connector(Protocol):
    """discover: endpoints (endpoint_id, xml) to candidates. retrieve: candidates to candidate, outcome and content."""

    def discover(self, endpoints: DataFrame) -> DataFrame: ...

    def retrieve(self, candidates: DataFrame) -> DataFrame: ...


@runtime_checkable
class Gateway(Protocol):
    """send: messages (chat_id, text) of one batch; a batch may come again, so it is told by its number."""

    def send(self, messages: DataFrame, batch: int) -> None: ...


class StoredFeeds:
    """The default connector: feeds whose XML is stored, and pages (url, code, html) that were fetched before."""

    def __init__(self, pages: DataFrame):
        self.pages = pages

    def discover(self, endpoints: DataFrame) -> DataFrame:
        return feeds.entries(endpoints)

    def retrieve(self, candidates: DataFrame) -> DataFrame:
        page = self.pages.select(F.col("url").alias("link"), "code", "html")
        found = candidates.join(page, "link", "left").withColumn("outcome", feeds.outcome(F.col("code")))
        return found.select("link", "outcome", F.when(F.col("outcome") == "succeeded", F.col("html")).alias("content"))


class ArtifactStore:
    """Content-addressed bytes as Parquet files below a path; written once, read back with their hash checked."""

    SCHEMA = "sha256 string, storage_key string, byte_size long, content binary"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def _exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def store(self, contents: DataFrame) -> DataFrame:
        """contents: content. Appends what is new and gives a receipt (sha256, storage_key, byte_size) for each distinct content."""
        blobs = contents.select(F.col("content").cast("binary").alias("content")).where("content is not null")
        blobs = blobs.select(F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("byte_size"), "content")
        held = self.table() if self._exists() else self.spark.createDataFrame([], self.SCHEMA)
        files.new_blobs(blobs, held).select("sha256", "storage_key", "byte_size", "content").write.mode("append").parquet(self.path)
        return blobs.select("sha256", files.storage_key(F.col("sha256")).alias("storage_key"), "byte_size").distinct()

    def read(self, digests: DataFrame) -> DataFrame:
        """digests: sha256. sha256, content and issue: missing, or corrupt where the bytes don't have that hash."""
        found = digests.select("sha256").distinct().join(self.table().select("sha256", "content", F.lit(True).alias("_held")), "sha256", "left")
        issue = F.when(F.col("_held").isNull(), "missing").when(F.sha2("content", 256) != F.col("sha256"), "corrupt")
        return found.select("sha256", F.when(issue.isNull(), F.col("content")).alias("content"), issue.alias("issue"))


def extracted(artifacts: DataFrame, extractor: TextExtractor = T.html_main_text) -> DataFrame:
    """artifact_id, text and limitations of stored texts; an empty text is a limitation, not an error."""
    text = extractor(F.col("content").cast("string"))
    told = F.array_compact(F.array(F.when(~F.coalesce(text.rlike("\\S"), F.lit(False)), "empty_text"), F.when(F.length(text) < 200, "short_text")))
    return artifacts.select("artifact_id", text.alias("text"), told.alias("limitations"))


def canonical(found: DataFrame, canonicalizer: Canonicalizer = lambda c: T.casefold(T.squeeze(c))) -> DataFrame:
    """Mentions with the canonical form of their surface text."""
    return found.withColumn("canonical", canonicalizer(F.col("surface")))


def proposed(forms: DataFrame, proposer: AliasProposer = aliases.signals) -> DataFrame:
    """Alias proposals of a proposer, with their confidence band; one that names a form as its own alias is refused."""
    found = proposer(forms)
    return found.where("left_id < right_id").withColumn("band", aliases.band(F.col("confidence")))


def observed(docs: DataFrame, extractor: ObservationExtractor = mentions.recognize_shapes) -> DataFrame:
    """Observations of texts: recognised spans by the observation type their label stands for; other labels are left out."""
    rows = extractor(docs)
    return rows.withColumn("observation_type", mentions.mapped("label", mentions.OBSERVATION_TYPES)).where("observation_type is not null")


def profiled(observations: DataFrame, profiler: FragmentProfiler = fragments.profiles) -> DataFrame:
    return profiler(observations)


def delivering(gateway: Gateway):
    """A function for foreachBatch that gives each batch to the gateway."""
    if not isinstance(gateway, Gateway):
        raise TypeError("a gateway has a method send(messages, batch)")
    return lambda batch, number: gateway.send(batch, number)
