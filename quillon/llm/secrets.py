"""Secret scans with DataFrame functions only: patterns, then the ownership frequency of what they find, corpus-wide.

Four kinds of spans are found in each text (code points, end exclusive). Three are base kinds: an assignment to a
credential-like name, an access key id, a hexadecimal run. The fourth, `owned`, is a candidate of the method: a long mixed
token that no base span touches. The hash of every found value is aggregated over the corpus by distinct repositories
and distinct owners: a value that many owners hold is a copied example, one that a single owner holds looks live, in however
many of its repositories; where the owner is null, only in few. Base spans are always reported, with their class; an `owned` candidate is reported only
where it looks live.

A repository is a document, its owner is the value of `source`; both are parameters. Values are compared by sha2.

Edge cases: a null text is empty; a null owner counts as one owner of its own; repeated rows count as one repository and
get equal results; very long texts are scanned whole; other columns are ignored or, in `redact`, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

# The base patterns, the group that holds the value, the least length of what must be long enough.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: At least 20 characters with a capital, a small letter and a digit; found as whole runs.
OWNED = r"(?<![A-Za-z0-9+/_=-])(?=[a-z0-9+/_=-]*+[A-Z])(?=[A-Z0-9+/_=-]*+[a-z])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}"
HEX_RUN = r"[0-9a-f]{32,}"  # runs are whole, so the least length can stand in the pattern
ACCESS_RUN = r"AKIA[A-Z0-9]{12,}"  # likewise: a later start in the same run is shorter still
KINDS = ("assign", "access", "hex", "owned")
SALTS = 64


def _found(text: Column, pattern: str, kind: int, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's matches, left to right.

    What lies between matches (split) and the matches themselves alternate, so running lengths give positions.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m: F.struct(m["gap"].alias("gap"), F.length(m["whole"]).alias("n"), m["value"].alias("value")),
    )
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("out"))

    def step(held, m):
        start = held["at"] + m["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + m["n"]).alias("end"), m["value"].alias("value"))
        long_enough = F.length(m["value"]) >= least
        return F.struct(
            (start + m["n"]).alias("at"), F.when(long_enough, F.array_append(held["out"], span)).otherwise(held["out"]).alias("out")
        )

    spans = F.aggregate(pieces, nothing, step, lambda held: held["out"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>"))


def find_candidates(docs: DataFrame, owner: str = "source") -> DataFrame:
    """doc_id, owner, key (of id and text), base and owned spans of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_found(text, ASSIGN, 0, 1, 8), _found(text, ACCESS_RUN, 1, 0, 16), _found(text, HEX_RUN, 2, 0, 32))
    scanned = docs.select(
        F.col("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256).alias("key"),
        F.array_sort(base).alias("base"),
        _found(text, OWNED, 3, 0, 20).alias("owned"),
    )
    clear = F.filter(
        "owned", lambda o: ~F.exists("base", lambda b: (b["start"] < o["end"]) & (o["start"] < b["end"]))
    )
    return scanned.withColumn("owned", clear)


def classify(found: DataFrame, many_owners: int = 2, many_repos: int = 3) -> DataFrame:
    """Of each value's hash: in how many repositories and with how many owners it is, and whether it looks live.

    One known owner's value is live in however many of its documents; documents without an owner may be several owners', so
    there the number of repositories decides. Counts go value-repository, value-owner, value, each combined before its shuffle, so no value's rows meet in one task.
    """
    seen = found.select("doc_id", "owner", F.explode(F.concat("base", "owned")).alias("s")).select(
        "doc_id", "owner", F.unhex(F.sha2(F.col("s.value"), 256)).alias("h")
    )
    repos = seen.distinct()
    owners = repos.groupBy("h", "owner").agg(F.count("*").alias("n"))
    counted = owners.groupBy("h").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), (F.max("owner") != "").alias("known"))
    return counted.withColumn("live", (F.col("n_owners") < many_owners) & (F.col("known") | (F.col("n_repos") < many_repos))).drop("known")


def scan_secrets(docs: DataFrame, owner: str = "source", many_owners: int = 2, many_repos: int = 3) -> DataFrame:
    """doc_id, key, base spans, all reported spans (start, kind, end, live), in text order; a row for each row of docs."""
    found = materialize(find_candidates(docs, owner), "secrets")
    verdicts = classify(found, many_owners, many_repos)
    spans = (
        found.where(F.size("base") + F.size("owned") > 0)
        .groupBy("key")
        .agg(F.first("base").alias("base"), F.first("owned").alias("owned"))
        .select("key", F.explode(F.concat("base", "owned")).alias("s"))
        .select("key", "s", F.unhex(F.sha2(F.col("s.value"), 256)).alias("h"), F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt"))
    )
    # A value may be in a third of all rows: its verdict goes out to SALTS shares of them, each of which is a key of its own.
    shares = spans.select("h", "salt").distinct().join(verdicts.select("h", "live"), "h")
    judged = spans.join(shares, ["h", "salt"]).where((F.col("s.kind") < 3) | F.col("live"))
    reported = judged.groupBy("key").agg(
        F.sort_array(
            F.collect_list(
                F.struct(F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("live").alias("live"))
            )
        ).alias("spans")
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    return found.select("doc_id", "key", "base").join(reported, "key", "left").withColumn("spans", F.coalesce("spans", none))


def redact(docs: DataFrame, owner: str = "source") -> DataFrame:
    """docs whose reported spans are overwritten: live-looking values and copied examples by different masks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    may = text.rlike("|".join((ASSIGN, ACCESS_RUN, HEX_RUN, OWNED)))
    rest, docs = docs.where(~may), docs.where(may)  # most texts hold no candidate and stay out of the join
    reported = scan_secrets(docs, owner).where(F.size("spans") > 0).groupBy("key").agg(F.first("spans").alias("_spans")).withColumnRenamed("key", "_reported")
    keyed = docs.withColumn("_key", F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text), 256))
    joined = keyed.join(reported, F.col("_key") == F.col("_reported"), "left")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(held, s):
        fresh = s["start"] >= held["at"]
        gap = F.substr(F.col("text"), held["at"] + 1, s["start"] - held["at"])
        mask = F.when(s["live"], F.lit("[live secret]")).otherwise(F.lit("[sample secret]"))
        return F.struct(
            F.greatest(held["at"], s["end"]).alias("at"),
            F.when(fresh, F.concat(held["out"], F.array(gap, mask))).otherwise(held["out"]).alias("out"),
        )

    masked = F.aggregate(
        "_spans", start, step, lambda h: F.concat(F.array_join(h["out"], ""), F.substr(F.col("text"), h["at"] + 1, F.length("text")))
    )
    out = joined.withColumn("text", F.when(F.col("_spans").isNotNull(), masked).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rest.unionByName(out.select(*[f"`{c}`" for c in docs.columns]))


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
