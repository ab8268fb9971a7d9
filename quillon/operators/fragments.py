"""Event fragments: gap sessions, observation profiles, pairs, components, maximal cliques, proposals and their review."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.shipping import packaged

# Actions too general to compare by, words that make an object vague, and evidence points by observation type.
GENERIC_ACTIONS = {
    "en": (
        "accord", "be", "become", "bring", "come", "continue", "do", "get", "give", "go", "got", "happen", "have", "include",
        "know", "let", "make", "mean", "need", "put", "remain", "say", "seem", "take", "tell", "think", "use", "want",
    ),
    "ru": (
        "брать", "быть", "взять", "говорить", "давать", "дать", "делать", "думать", "знать", "идти", "иметь", "использовать",
        "казаться", "означать", "оставаться", "получать", "получить", "положить", "продолжать", "происходить", "приносить",
        "принести", "приходить", "сказать", "случаться", "становиться", "стать", "хотеть",
    ),
}
VAGUE_HEADS = {"en": ("act", "one", "ones", "thing", "things", "way"), "ru": ("вещь", "вещи", "путь", "пути", "способ", "способы")}
VAGUE_PREFIXES = {
    "en": ("a", "an", "another", "her", "his", "its", "my", "one", "our", "that", "the", "their", "these", "this", "those", "your"),
    "ru": (
        "ваш", "ваша", "ваше", "ваши", "его", "ее", "её", "их", "мой", "моя", "мое", "моё", "мои", "наш", "наша", "наше", "наши",
        "та", "те", "тот", "это", "эта", "эти", "этот",
    ),
}
POINTS = {"participant_mention": 4, "place_mention": 3, "time_mention": 2, "event_mention": 3, "action_candidate": 2, "object_candidate": 1}
CORE = ("participant_mention", "place_mention", "time_mention", "event_mention")
GAP_MS = 2200
CELLS, BATCH = 1 << 20, 1 << 16


def gap_sessions(rows: DataFrame, key: str, start: str, end: str, gap: float = GAP_MS, contributes=None) -> DataFrame:
    """gap since the last contributing row's end, and a session number that rises where the gap is `gap` or more."""
    w = Window.partitionBy(key).orderBy(start, end)
    counts = F.lit(True) if contributes is None else contributes
    before = F.last(F.when(counts, F.col(end)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("gap", F.when(counts, F.col(start) - before))
    return rows.withColumn("session", F.count_if(F.col("gap") >= gap).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def exclusions(observations: DataFrame, language: str = "en") -> DataFrame:
    """Each observation with the first reason that excludes it from profiles, or null.

    observations: fragment_id, observation_id, observation_type, source_label, surface, normalized, start, end.
    """
    if language not in GENERIC_ACTIONS:
        raise ValueError(f"no word lists for {language!r}; there are {', '.join(sorted(GENERIC_ACTIONS))}")
    value, head = F.col("normalized"), F.substring_index("source_label", ":", 1)
    tokens = F.regexp_extract_all(F.lower(value), F.lit("(?U)[^\\W\\d_]+"), F.lit(0))
    vague = (F.size(tokens) >= 2) & F.get(tokens, F.lit(0)).isin(*VAGUE_PREFIXES[language]) & F.element_at(tokens, -1).isin(*VAGUE_HEADS[language])
    long = (F.length("surface") > 50) | (F.size(F.split(F.trim("surface"), "(?U)\\s+")) > 10)
    action, object_ = F.col("observation_type") == "action_candidate", F.col("observation_type") == "object_candidate"
    reason = (
        F.when(action & value.isin(*GENERIC_ACTIONS[language]), "generic_action")
        .when(action & ~value.rlike("(?U)\\A[^\\W\\d_]+(?:[-'][^\\W\\d_]+)*\\z"), "non_lexical_action")
        .when(object_ & (head == "PRON"), "pronominal_object")
        .when(object_ & ~head.isin("NOUN", "PROPN"), "unsupported_object_head")
        .when(object_ & (F.size(tokens) > 0) & vague, "vague_object")
        .when(object_ & long, "oversized_object")
    )
    return observations.withColumn("exclusion", reason)


def profiles(observations: DataFrame, language: str = "en") -> DataFrame:
    """Signals of each fragment: retained observations of equal type and value, with ids and spellings in text order."""
    kept = exclusions(observations, language).where("exclusion is null")
    item = F.struct("start", "end", "observation_id", "surface")
    by = kept.groupBy("group_id", "fragment_id", "observation_type", "normalized").agg(
        F.sort_array(F.collect_list(item)).alias("items"), F.min("start").alias("first_start"), F.max("end").alias("last_end"), F.count("*").alias("n")
    )
    return by.select(
        "group_id", "fragment_id", "observation_type", "normalized", "n", "first_start", "last_end",
        F.transform("items", lambda x: x["observation_id"]).alias("observation_ids"),
        F.array_distinct(F.transform("items", lambda x: x["surface"])).alias("surface_forms"),
    )


def pairs(fragments: DataFrame, signals: DataFrame) -> DataFrame:
    """All unordered fragment pairs of a group with points, dimensions and status.

    candidate: two dimensions or more, one of them core; weak: any; insufficient: none.
    """
    return _compared(fragments, signals, every=True)


def evidence(signals: DataFrame) -> DataFrame:
    """The pairs of `pairs` that share a signal; those without are never made."""
    return _compared(signals, signals, every=False)


def _compared(fragments: DataFrame, signals: DataFrame, every: bool) -> DataFrame:
    """One pass a group: its fragments and signals are shuffled, its pairs are not.

    Blocks of fragments meet all later ones through the lists of fragments that hold a signal, so memory stays at CELLS
    pairs and shared signals at a time, or one fragment's pairs.
    """
    rows = signals.select("group_id", "fragment_id", F.col("observation_type").alias("kind"), "normalized").distinct()
    if every:
        none = F.lit(None).cast("string")
        rows = rows.union(fragments.select("group_id", "fragment_id", none, none))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group = table["group_id"][0].as_py()
        ids, at = np.unique(table["fragment_id"].to_numpy(), return_inverse=True)
        table = table.append_column("at", pa.array(at.ravel(), pa.int64())).filter(pc.is_valid(table["kind"]))
        kinds = sorted(table["kind"].unique().to_pylist())
        n, kind = len(ids), pc.index_in(table["kind"], pa.array(kinds, pa.string())).to_numpy()
        at, value = table["at"].to_numpy(), table["normalized"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, signal = np.unique(value * max(len(kinds), 1) + kind, return_inverse=True)
        order = np.lexsort((at, signal.ravel()))
        holder = at[order]  # by signal, then fragment
        ends = np.cumsum(np.bincount(signal.ravel()))
        # Of each signal in a fragment: where the list of later fragments that hold it begins, and its length.
        first = np.arange(1, len(order) + 1)
        later = ends[signal.ravel()[order]] - first
        by = np.argsort(holder, kind="stable")
        first, later, kind, owner = first[by], later[by], kind[order][by], holder[by]
        begin = np.searchsorted(owner, np.arange(n + 1))
        work = np.concatenate([[0], np.cumsum(later)])
        low = 0
        while low < n:
            high = low + 1
            while high < n and (high + 1 - low) * n <= CELLS and work[begin[high + 1]] - work[begin[low]] <= CELLS:
                high += 1
            points, seen = np.zeros((high - low) * n, np.int64), np.zeros((high - low) * n, np.int64)
            for k, name in enumerate(kinds):
                own = np.arange(begin[low], begin[high])
                own = own[(kind[own] == k) & (later[own] > 0)]
                for part in np.array_split(own, 1 + int(later[own].sum() // CELLS)):
                    total = later[part].sum()
                    step = np.arange(total) - np.repeat(np.cumsum(later[part]) - later[part], later[part])
                    cell = np.repeat((owner[part] - low) * n, later[part]) + holder[np.repeat(first[part], later[part]) + step]
                    shared = np.bincount(cell, minlength=len(points))
                    points += shared * POINTS.get(name, 0)
                    seen |= (shared > 0).astype(np.int64) << k
            cell = np.arange(len(points)) if every else np.flatnonzero(seen)
            left, right = cell // n + low, cell % n
            keep = left < right
            left, right, cell = left[keep], right[keep], cell[keep]
            masks, which = np.unique(seen[cell], return_inverse=True)
            names = [[x for k, x in enumerate(kinds) if m >> k & 1] for m in masks.tolist()]
            status = ["candidate" if len(x) >= 2 and set(x) & set(CORE) else "weak" if x else "insufficient" for x in names]
            which = pa.array(which.ravel(), pa.int32())
            for i in range(0, len(cell), BATCH):
                j = slice(i, i + BATCH)
                yield pa.RecordBatch.from_pydict(
                    {
                        "group_id": pa.array([group] * len(cell[j]), pa.int64()), "left_id": pa.array(ids[left[j]], pa.int64()), "right_id": pa.array(ids[right[j]], pa.int64()),
                        "points": pa.array(points[cell[j]], pa.int64()), "dimensions": pa.array([",".join(x) for x in names], pa.string()).take(which[j]), "status": pa.array(status, pa.string()).take(which[j]),
                    }
                )
            low = high

    packaged()
    return rows.groupBy("group_id").applyInArrow(score, "group_id long, left_id long, right_id long, points long, dimensions string, status string")


def incomplete_groups(fragments: DataFrame, compared: DataFrame) -> DataFrame:
    """Groups whose pairs aren't all there: n * (n - 1) / 2 of them are expected."""
    n = fragments.groupBy("group_id").agg(F.count("*").alias("n"))
    have = compared.groupBy("group_id").agg(F.count("*").alias("pairs"))
    return n.join(have, "group_id", "left").where(F.coalesce("pairs", F.lit(0)) * 2 != F.col("n") * (F.col("n") - 1))


def components(fragments: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id, fragment_id, component (smallest fragment reachable). Edges stay inside a group, one document's fragments."""

    def join(table: pa.Table) -> pa.Table:
        parent: dict[int, int] = {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(table["left_id"].to_pylist(), table["right_id"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
        nodes = sorted(parent)
        group = [table["group_id"][0].as_py()] * len(nodes)
        return pa.table({"group_id": pa.array(group, pa.int64()), "fragment_id": pa.array(nodes, pa.int64()), "component": pa.array([find(x) for x in nodes], pa.int64())})

    packaged()
    joined = edges.select("group_id", "left_id", "right_id").groupBy("group_id").applyInArrow(join, "group_id long, fragment_id long, component long")
    out = fragments.select("group_id", "fragment_id").join(joined, ["group_id", "fragment_id"], "left")
    return out.withColumn("component", F.coalesce("component", "fragment_id"))


def cliques(edges: DataFrame) -> DataFrame:
    """group_id and members (sorted) of every maximal clique of two or more, by branch and bound with pivots, a group at a time.

    A group is one document's fragments; its clique search has no set-based form. Cliques leave in batches, as a group can have
    exponentially many.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        group = table["group_id"][0].as_py()

        def rows(found):
            return pa.RecordBatch.from_pydict({"group_id": pa.array([group] * len(found), pa.int64()), "members": pa.array(found, pa.list_(pa.int64()))})

        near: dict[int, set[int]] = {}
        for a, b in zip(table["left_id"].to_pylist(), table["right_id"].to_pylist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found, stack = [], [((), set(near), set())]
        while stack:
            chosen, open_, shut = stack.pop()
            if not open_:
                if not shut and len(chosen) > 1:
                    found.append(sorted(chosen))
                    if len(found) == BATCH:
                        yield rows(found)
                        found = []
                continue
            pivot = max(open_ | shut, key=lambda v: (len(near[v] & open_), -v))
            for v in sorted(open_ - near[pivot]):
                stack.append(((*chosen, v), open_ & near[v], shut & near[v]))
                open_ = open_ - {v}
                shut = shut | {v}
        yield rows(found)

    packaged()
    return edges.select("group_id", "left_id", "right_id").groupBy("group_id").applyInArrow(search, "group_id long, members array<long>")


def component_status(labels: DataFrame, proposals: DataFrame) -> DataFrame:
    """isolated: one fragment; coherent: one clique holds all of it; ambiguous: several overlapping ones."""
    size = labels.groupBy("group_id", "component").agg(F.count("*").alias("n"))
    counted = proposals.select("group_id", F.array_min("members").alias("component"), "members")
    first = labels.select("group_id", F.col("fragment_id").alias("m"), F.col("component").alias("of"))
    placed = counted.join(first, (counted["group_id"] == first["group_id"]) & (counted["component"] == first["m"])).select(counted["group_id"], F.col("of").alias("component"), "members")
    by = placed.groupBy("group_id", "component").agg(F.count("*").alias("proposals"), F.max(F.size("members")).alias("largest"))
    out = size.join(by, ["group_id", "component"], "left").na.fill(0, ["proposals", "largest"])
    return out.withColumn("status", F.when(F.col("n") == 1, "isolated").when(F.col("largest") == F.col("n"), "coherent").otherwise("ambiguous"))


def review(statuses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Components with their reviews. decisions: group_id, component, accepted, rejected, pending (numbers of proposals).

    Isolated ones need none; one accepted proposal resolves; all rejected reject; an ambiguous one whose proposals are all
    pending may be preserved; anything else is pending.
    """
    out = statuses.join(decisions, ["group_id", "component"], "left").na.fill(0, ["accepted", "rejected", "pending"])
    verdict = (
        F.when(F.col("status") == "isolated", "isolated")
        .when(F.col("accepted") > 0, "resolved")
        .when((F.col("rejected") > 0) & (F.col("rejected") == F.col("proposals")), "rejected")
        .when((F.col("status") == "ambiguous") & (F.col("pending") == F.col("proposals")), "preserved")
        .otherwise("pending")
    )
    return out.withColumn("review", verdict)
