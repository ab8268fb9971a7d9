"""Feeds: RSS 2.0 and Atom entries out of stored XML, discovery filters, outcomes of retrieval, feed lists from a file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.shipping import packaged

ENTRY = "endpoint_id long, external_id string, title string, link string, published string, summary string"


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """The configured feeds: JSON lines of endpoint_id, name, url, language, is_active."""
    return spark.read.schema("endpoint_id long, name string, url string, language string, is_active boolean").json(path)


def entries(feeds: DataFrame) -> DataFrame:
    """feeds: endpoint_id, xml. Entries with a link; a feed that doesn't parse gives none."""
    from xml.etree import ElementTree

    def local(tag: str) -> str:
        return tag.rpartition("}")[2].lower()

    def of(endpoint: int, xml: str):
        try:
            root = ElementTree.fromstring(xml or "")
        except ElementTree.ParseError:
            return
        for node in root.iter():
            if local(node.tag) not in ("item", "entry"):
                continue
            held: dict[str, str] = {}
            for child in node:
                name, value = local(child.tag), (child.text or "").strip()
                if name == "link" and child.get("href") and child.get("rel", "alternate") == "alternate":
                    value = child.get("href").strip()
                if value:
                    held.setdefault(name, value)
            if link := held.get("link"):
                told = held.get("pubdate") or held.get("published") or held.get("updated")
                yield endpoint, held.get("guid") or held.get("id") or link, held.get("title"), link, told, held.get("description") or held.get("summary")

    names = [c.split()[0] for c in ENTRY.split(", ")]

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([e for k, x in zip(pdf["endpoint_id"], pdf["xml"], strict=True) for e in of(k, x)], columns=names)

    packaged()
    return feeds.select("endpoint_id", "xml").mapInPandas(run, ENTRY)


def published_at(text) -> Column:
    """RFC 2822 (weekday dropped) or ISO time with an offset; times without one are null."""
    bare = F.regexp_replace(text, "^\\s*[A-Za-z]{3},\\s*", "")
    bare = F.regexp_replace(bare, "\\b(GMT|UT|UTC|Z)\\s*$", "+0000")
    mail = F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))
    iso = F.when(text.rlike("(Z|[+-]\\d{2}:?\\d{2})\\s*$"), F.try_to_timestamp(text))
    return F.coalesce(mail, iso)


def discovered(found: DataFrame, contains: str | None = None, since=None, until=None, languages=None, limit: int | None = None) -> DataFrame:
    """Entries that a request asks for; a missing time fails a bounded request. Blank or contradictory requests are refused."""
    if contains is not None and not contains.strip():
        raise ValueError("the title filter must not be blank")
    if limit is not None and limit < 1:
        raise ValueError("the limit must be 1 or more")
    if since is not None and until is not None and since > until:
        raise ValueError("since must not be after until")
    out = found
    if contains is not None:
        out = out.where(F.contains(F.lower("title"), F.lit(contains.lower())))
    if since is not None:
        out = out.where(F.col("published_at") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("published_at") <= F.lit(until))
    if languages is not None:
        out = out.where(F.col("language").isin(*languages))
    return out if limit is None else out.limit(limit)


def outcome(status) -> Column:
    """Of an HTTP status: succeeded, access_restricted, unavailable, failed."""
    return F.when(status.between(200, 299), "succeeded").when(status.isin(401, 403), "access_restricted").when(status.isin(404, 410), "unavailable").otherwise("failed")
