"""References to records that do not exist (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.session import written
from orrery.sources.tables import current_rows

#: A key is heavy from this share of all references on, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1 / 1024
#: Orphan keys that are sent to all tasks (some 50 bytes each); more are joined by shuffling.
FEW_KEYS = 200_000


def bare_code(code: Column) -> Column:
    """The code alone: lower case, without blanks, archive prefix and version mark; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(code, r"\s+", "")), r"^arxiv:|v[0-9]+$", "")


def paper_facts(meta: DataFrame) -> DataFrame:
    """(id, code, gone, firstat) of each paper: its current row's code and whether that row reads deleted; its first arrival."""
    now = current_rows(meta.where(F.col("id").isNotNull()), "status", "arxiv", first="firstat")
    gone = F.coalesce(F.lower(F.trim("status")) == "deleted", F.lit(False))
    return now.select("id", bare_code(F.col("arxiv")).alias("code"), gone.alias("gone"), "firstat")


def orphan_references(refs: DataFrame, targets: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Orphans among references, by reference.

    refs(source, field, space, key, at): reference ``field`` of record ``source``, made at ``at``, to ``key`` of the key
    space ``space``. targets(space, key, gone, firstat): what exists; of several targets with one key the reference is
    deleted if all are, and late if the first came after it. Returns distinct (source, field, kind, period): kind is
    ``missing``, else ``deleted``, else ``late``; period is the month of ``at`` (null if it is null, and such a
    reference is never late). Null keys refer to nothing and give no row; any other text, blank or not, is a key.

    References are first aggregated per key and period; the few heavy keys are held against the targets in a broadcast
    join (there are at most 1 / share of them), the others in a join that is shuffled unless their orphan keys are at most FEW_KEYS, and both
    halves are united.
    """
    facts = targets.where(F.col("key").isNotNull()).groupBy("space", "key").agg(F.min("gone").alias("gone"), F.min("firstat").alias("firstat"))
    known = refs.where(F.col("key").isNotNull())
    period = F.date_format(F.date_trunc("month", "at"), "yyyy-MM")
    per_month = known.groupBy("space", "key", F.date_trunc("month", "at").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("firstref"))
    per_key = per_month.groupBy("space", "key").agg(F.sum("n").alias("n"), F.min("firstref").alias("firstref"))
    judged = (
        per_key.join(facts.withColumn("there", F.lit(True)), ["space", "key"], "left")
        .withColumn("kind", F.when(F.col("there").isNull(), "missing").when(F.col("gone"), "deleted"))
        .withColumn("orphan", F.col("kind").isNotNull() | F.coalesce(F.col("firstat") > F.col("firstref"), F.lit(False)))
    )
    total = known.count()
    heavy = F.col("n") >= max(1.0, total * share)
    verdicts = written(judged.where(F.col("orphan") | heavy).select("space", "key", "kind", "firstat", "orphan", heavy.alias("heavy")), "verdicts")
    few = F.broadcast(verdicts.where("heavy").drop("heavy"))
    rest = verdicts.where("orphan and not heavy").drop("heavy", "orphan")
    # Few orphan keys meet the references where these are; many are met by shuffling both sides.
    rest = F.broadcast(rest) if rest.count() <= FEW_KEYS else rest
    tagged = known.join(few, ["space", "key"], "left")
    hot = tagged.where(F.col("orphan"))
    cold = tagged.where(F.col("orphan").isNull()).select(*known.columns).join(rest, ["space", "key"])
    kind = F.coalesce(F.col("kind"), F.when(F.col("firstat") > F.col("at"), "late"))
    both = [x.select("source", "field", kind.alias("kind"), period.alias("period")) for x in (hot, cold)]
    return both[0].unionByName(both[1]).where(F.col("kind").isNotNull()).distinct()


def link_orphans(links: DataFrame, meta: DataFrame, share: float = HEAVY_SHARE) -> DataFrame:
    """Orphan references of the links' three fields: (linkid, reffield, kind, period)."""

    def ref(field: str, space: str, key: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(space).alias("space"), key.cast("string").alias("key"))

    each = F.array(ref("pastid", "id", F.col("pastid")), ref("futureid", "id", F.col("futureid")), ref("pastpaper", "code", bare_code(F.col("pastpaper"))))
    refs = links.select(F.col("linkid").alias("source"), F.col("seenat").alias("at"), F.inline(each))
    facts = paper_facts(meta)
    ids = facts.select(F.lit("id").alias("space"), F.col("id").cast("string").alias("key"), "gone", "firstat")
    codes = facts.select(F.lit("code").alias("space"), F.col("code").alias("key"), "gone", "firstat")
    found = orphan_references(refs, ids.unionByName(codes), share)
    return found.select(F.col("source").alias("linkid"), F.col("field").alias("reffield"), "kind", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references by field, kind and month."""
    return found.groupBy("reffield", "kind", "period").agg(F.count(F.lit(1)).alias("orphans"))
