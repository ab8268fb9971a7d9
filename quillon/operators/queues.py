"""Work queues: orders, limits, batches, cooldowns and the counts that are taken before a limit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import packaged

# The order in which alias signals are told.
SIGNALS = ("acronym", "short_name", "inflectional")


def ordinal(column, names: tuple[str, ...]) -> Column:
    """The place of a value in names; values that aren't in it come last."""
    out = F.lit(len(names))
    for k, name in enumerate(names):
        out = F.when(F.col(column) == name, k).otherwise(out)
    return out


def parse_queue(items: DataFrame, mode: str, limit: int, after: int | None = None) -> DataFrame:
    """items: item_id, fetched_at. after: ids beyond `after`, ascending; newest: latest fetched first; oldest: first fetched first."""
    orders = {"after": ["item_id"], "newest": [F.desc("fetched_at"), F.desc("item_id")], "oldest": ["fetched_at", "item_id"]}
    if mode not in orders or (mode == "after") != (after is not None):
        raise ValueError("mode is after (with an id), newest or oldest")
    rows = items.where(F.col("item_id") > after) if mode == "after" else items
    return rows.orderBy(*orders[mode]).limit(limit)


def acquire_queue(candidates: DataFrame, done: DataFrame, limit: int) -> DataFrame:
    """The candidates (candidate_id, first_discovered_at) that aren't done, first discovered first."""
    return candidates.join(done.select("candidate_id").distinct(), "candidate_id", "left_anti").orderBy("first_discovered_at", "candidate_id").limit(limit)


def ranked_signals(signals: DataFrame, limit: int) -> DataFrame:
    """Alias signals by kind, shared documents and mentions (most first), type and both names."""
    return signals.orderBy(ordinal("signal", SIGNALS), F.desc("shared"), F.desc(F.col("left_n") + F.col("right_n")), "entity_type", "left_canonical", "right_canonical").limit(limit)


def proposal_examples(proposals: DataFrame, limit: int) -> DataFrame:
    """Proposals by confidence (highest first), kind, type, both names, both ids."""
    return proposals.orderBy(F.desc("confidence"), ordinal("signal", SIGNALS), "entity_type", "left_canonical", "right_canonical", "left_id", "right_id").limit(limit)


def in_text_order(rows: DataFrame, limit: int) -> DataFrame:
    """Rows by start and end, those without a place last, then by id."""
    return rows.orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"), "candidate_id").limit(limit)


def newest_with_content(articles: DataFrame, key: str, at: str, id_: str, content: str) -> DataFrame:
    """key, newest and newest_with_content: ids of the last row of each key, and of the last one that holds text."""
    holds = F.coalesce(F.col(content).rlike("\\S"), F.lit(False))
    when = F.struct(at, id_)
    return articles.groupBy(key).agg(F.max(when)[id_].alias("newest"), F.max(F.when(holds, when))[id_].alias("newest_with_content"))


def page_with_totals(rows: DataFrame, limit: int, group: str, *order) -> DataFrame:
    """The first `limit` rows of the order, each with its group's count over all rows: nothing is counted after the limit."""
    totals = rows.groupBy(group).agg(F.count("*").alias("group_total"))
    return rows.orderBy(*order).limit(limit).join(totals, group)


def batch_counts(outcomes: DataFrame, names: tuple[str, ...], key: str = "status") -> DataFrame:
    """One row: how many items had each outcome, and all."""
    return outcomes.agg(F.count("*").alias("items"), *[F.count_if(F.col(key) == n).alias(n) for n in names])


def isolated(batch: DataFrame, result: Column, problem: Column) -> DataFrame:
    """batch with status, result and error: an item that fails keeps its error and leaves the others alone."""
    return batch.withColumn("error", problem).withColumn("result", F.when(problem.isNull(), result)).withColumn("status", F.when(problem.isNull(), "processed").otherwise("failed"))


def cooldown(requests: DataFrame, seconds: int) -> DataFrame:
    """requests (chat_id, request_id, at in seconds) with accepted and wait.

    A request is accepted if `seconds` have passed since the last accepted one of its chat, so each hangs on those before it:
    a chat is folded in one pass, with one number of state.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "request_id"])
        last, wait = None, []
        for at in pdf["at"].tolist():
            left = 0 if last is None else seconds - (at - last)
            if left <= 0:
                last = at
            wait.append(max(0, int(-(-left // 1))))
        return pdf[["chat_id", "request_id", "at"]].assign(accepted=[w == 0 for w in wait], wait=wait)

    packaged()
    return requests.select("chat_id", "request_id", "at").groupBy("chat_id").applyInPandas(fold, "chat_id long, request_id long, at long, accepted boolean, wait long")


def shared_documents(mentions: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (left_form, right_form) with the number of documents that hold both. mentions: form, document_id.

    Documents meet forms by join, so no form's documents are gathered in one row.
    """
    held = mentions.select("form", "document_id").distinct()
    left, right = held.withColumnRenamed("form", "left_form"), held.withColumnRenamed("form", "right_form")
    met = pairs.join(left, "left_form").join(right, ["right_form", "document_id"]).groupBy("left_form", "right_form").agg(F.count("*").alias("shared"))
    return pairs.join(met, ["left_form", "right_form"], "left").na.fill(0, ["shared"])


def limitations(rows: DataFrame, key: str, *lists: str) -> DataFrame:
    """Sorted distinct limitations of each key, over several lists of each row."""
    told = rows.select(key, F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in lists])).alias("l")).distinct()
    return told.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("l")), ",").alias("limitations"))


def unknown_ids(rows: DataFrame, named: Column, known: Column) -> DataFrame:
    """rows whose named ids aren't all known, with those that aren't."""
    missing = F.array_sort(F.array_except(named, known))
    return rows.withColumn("unknown", missing).where(F.size("unknown") > 0)


def overlapping(proposals: DataFrame, least: int = 1) -> DataFrame:
    """left_id < right_id of proposals of one group that share `least` members or more. proposals: group_id, proposal_id, members.

    For two members or more, sets meet by pairs of members, so those that share one alone never do. Equal sets of a group meet
    as one class. Two classes count where their first two shared members meet, so no pair of proposals is shuffled.
    """
    each = proposals.select("group_id", "proposal_id", F.explode("members").alias("member")).distinct()
    if least < 2:
        a, b = each.withColumnRenamed("proposal_id", "left_id"), each.withColumnRenamed("proposal_id", "right_id")
        return a.join(b, ["group_id", "member"]).where("left_id < right_id").groupBy("group_id", "left_id", "right_id").agg(F.count("*").alias("shared"))
    sets = each.groupBy("group_id", "proposal_id").agg(F.sort_array(F.collect_list("member")).alias("members")).where(F.size("members") >= least)
    classes = sets.groupBy("group_id", "members").agg(F.collect_list("proposal_id").alias("ids"), F.min("proposal_id").alias("class"))
    firsts = classes.select("*", F.posexplode("members").alias("at", "m1"))
    paired = firsts.select("group_id", "class", "ids", "members", "m1", F.explode(F.slice("members", F.col("at") + 2, F.size("members"))).alias("m2"))
    keys = ["group_id", "m1", "m2"]
    a, b = paired.hint("shuffle_merge").alias("a"), paired.alias("b")
    both = F.array_intersect("a.members", "b.members")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.class") <= F.col("b.class")])
    met = met.select(F.col("a.group_id").alias("group_id"), F.col("a.m1").alias("m1"), F.col("a.m2").alias("m2"), F.col("a.class").alias("one"), F.col("b.class").alias("two"), F.col("a.ids").alias("ones"), F.col("b.ids").alias("twos"), both.alias("both"))
    met = met.where((F.get("both", F.lit(0)) == F.col("m1")) & (F.get("both", F.lit(1)) == F.col("m2")) & (F.size("both") >= least))
    met = met.select("group_id", "one", "two", "twos", F.size("both").cast("long").alias("shared"), F.explode("ones").alias("x"))
    met = met.select("group_id", "one", "two", "shared", "x", F.explode("twos").alias("y")).where("one <> two or x < y")
    return met.select("group_id", F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"), "shared")


def cluster_evidence(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """points and dimensions of each proposal's internal pairs. members: proposal_id, group_id, fragment_id. pairs: group_id,
    left_id, right_id, points, dimensions (comma-joined)."""
    left, right = members.withColumnRenamed("fragment_id", "left_id"), members.select("proposal_id", F.col("fragment_id").alias("right_id"))
    inside = left.join(right, "proposal_id").where("left_id < right_id").join(pairs, ["group_id", "left_id", "right_id"])
    kinds = inside.select("proposal_id", F.explode(F.split("dimensions", ",")).alias("d")).where("d <> ''").distinct().groupBy("proposal_id").agg(F.array_join(F.sort_array(F.collect_list("d")), ",").alias("dimensions"))
    return inside.groupBy("proposal_id").agg(F.count("*").alias("pairs"), F.sum("points").alias("points")).join(kinds, "proposal_id", "left")


def exact_scope(seeds: DataFrame, candidates: DataFrame) -> DataFrame:
    """seed_id, candidate_id: all candidates of a seed's type and canonical text, itself included."""
    kind = seeds.select(F.col("candidate_id").alias("seed_id"), "entity_type", "canonical")
    return kind.join(candidates.select("candidate_id", "entity_type", "canonical"), ["entity_type", "canonical"]).select("seed_id", "candidate_id")


def groups_of(documents: DataFrame, candidates: DataFrame) -> DataFrame:
    """Corpus-wide counts of the groups (type, canonical text) that the given documents hold."""
    keys = candidates.join(documents.select("document_id").distinct(), "document_id", "left_semi").select("entity_type", "canonical").distinct()
    held = candidates.join(keys, ["entity_type", "canonical"], "left_semi")
    return held.groupBy("entity_type", "canonical").agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("documents"))
