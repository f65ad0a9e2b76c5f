"""Merging of saved user state: notes, graphs, tags and settings. In a difference, null means "not changed" and ``rm`` removes.

Tables hold one row per user and item, so states of any number of users merge in one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _last(diff: DataFrame, key: list[str], fields: list[str], order: str) -> DataFrame:
    """Several differences to one item, folded: its last removal, and each field's last value after it.

    An item removed and then sent again begins anew, without its old values (fresh).
    """
    removed = F.max(F.when(F.col("rm"), F.col(order)))
    cut = diff.groupBy(*key).agg(removed.alias("__cut"), F.max(order).alias("__end"))
    rows = diff.join(cut, key)
    live = F.col("__cut").isNull() | (F.col(order) > F.col("__cut"))
    values = [F.max_by(F.col(f), F.when(live & F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields]
    ends = [F.coalesce(F.max("__cut") == F.max("__end"), F.lit(False)).alias("__rm"), F.max("__cut").isNotNull().alias("__fresh")]
    return rows.groupBy(*key).agg(*values, *ends)


def merge_items(old: DataFrame, diff: DataFrame, key: list[str], fields: list[str], order: str = "seq") -> DataFrame:
    """(key..., fields...): the old items with the differences applied in the order of ``order``.

    diff(key..., fields..., rm, order). Items only in the difference are added; a null field keeps the old value.
    """
    news = _last(diff.withColumn("rm", F.coalesce("rm", F.lit(False))), key, fields, order)
    both = old.select(*key, *fields, F.lit(True).alias("__old")).alias("o").join(news.alias("d"), key, "full")
    keep = lambda f: F.when(F.coalesce(F.col("d.__fresh"), F.lit(False)), F.col(f"d.{f}")).otherwise(F.coalesce(F.col(f"d.{f}"), F.col(f"o.{f}")))
    return both.where(~F.coalesce(F.col("d.__rm"), F.lit(False))).select(*key, *[keep(f).alias(f) for f in fields])


def merge_notes(old: DataFrame, diff: DataFrame) -> DataFrame:
    """Notes (user, id, notes)."""
    return merge_items(old, diff, ["user", "id"], ["notes"])


def merge_graphs(old: DataFrame, diff: DataFrame, old_drawn: DataFrame, diff_drawn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Graphs (user, name, ind) and what they draw (user, name, id, x, r); what a removed graph drew goes with it."""
    graphs = merge_items(old, diff, ["user", "name"], ["ind"])
    gone = diff.where(F.col("rm")).select("user", "name").distinct()
    drawn = merge_items(old_drawn.join(gone, ["user", "name"], "left_anti"), diff_drawn, ["user", "name", "id"], ["x", "r"])
    return graphs, drawn.join(graphs.select("user", "name"), ["user", "name"], "left_semi")


def toggled(old: DataFrame, diff: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key..., value): values that occur an odd number of times in both together: sending a value once more takes it away."""
    both = old.select(*key, value).unionByName(diff.select(*key, value))
    return both.groupBy(*key, value).agg(F.count(F.lit(1)).alias("__n")).where("__n % 2 = 1").drop("__n")


def toggled_array(old: Column, diff: Column) -> Column:
    """The same on two arrays in one row, sorted."""
    both = F.array_sort(F.concat(F.coalesce(old, F.array()), F.coalesce(diff, F.array())))
    return F.filter(F.array_distinct(both), lambda v: F.size(F.filter(both, lambda w: w == v)) % 2 == 1)


def merge_tags(old: DataFrame, diff: DataFrame, old_ids: DataFrame, diff_ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags (user, name, ind, blob, halo) and their papers (user, name, id), which are toggled."""
    tags = merge_items(old, diff, ["user", "name"], ["ind", "blob", "halo"])
    gone = diff.where(F.col("rm")).select("user", "name").distinct()
    ids = toggled(old_ids.join(gone, ["user", "name"], "left_anti"), diff_ids, ["user", "name"], "id")
    return tags, ids.join(tags.select("user", "name"), ["user", "name"], "left_semi")


def merge_settings(old: DataFrame, diff: DataFrame) -> DataFrame:
    """Settings (user, pvo, nda): what the difference has, else the old."""
    both = old.alias("o").join(diff.alias("d"), "user", "full")
    return both.select("user", *[F.coalesce(F.col(f"d.{f}"), F.col(f"o.{f}")).alias(f) for f in ("pvo", "nda")])


def state_hash(state: Column) -> Column:
    """What client and server compare after a merge."""
    return F.sha1(state)


def loaded(stored: DataFrame, client: DataFrame) -> DataFrame:
    """(user, state, loads): what a client that asks for its profile gets: the stored state, or null where its hash says that it has it; and the
    number of its loads with this one. stored(user, state, loads), client(user, hash); users without a profile have no row."""
    rows = client.join(stored, "user")
    return rows.select("user", F.when(F.coalesce(state_hash(F.col("state")) == F.col("hash"), F.lit(False)), F.lit(None)).otherwise(F.col("state")).alias("state"), (F.col("loads") + 1).alias("loads"))


def accepted(old: DataFrame, merged: DataFrame, client: DataFrame) -> DataFrame:
    """(user, state): the merged state where its hash is the client's, else the old one. client(user, hash)."""
    rows = merged.select("user", F.col("state").alias("new")).join(client, "user", "left").join(old.select("user", F.col("state").alias("was")), "user", "left")
    return rows.select("user", F.when(state_hash(F.col("new")) == F.col("hash"), F.col("new")).otherwise(F.col("was")).alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The old rows with those of equal key replaced, and the new ones added."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
