"""Connected components, transitive reduction, and the bridging of components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.citations import best_by, least_before
from orrery.session import freed, written


#: Links whose components one task finds, some hundred bytes each.
FEW_LINKS = 500_000


def _components_here(links: DataFrame) -> DataFrame:
    """(u, v): each node v of few links (u, v) with the smallest node u of its component, if another; in one task."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        nodes, ends = np.unique(rows[["u", "v"]].to_numpy(), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        least = np.arange(len(nodes))
        while True:
            low = least.copy()
            np.minimum.at(low, least[a], least[b])
            np.minimum.at(low, least[b], least[a])
            low = low[low]
            while (low[low] != low).any():
                low = low[low]
            if (low == least).all():
                break
            least = low[least]
        other = least != np.arange(len(nodes))
        return pd.DataFrame({"u": nodes[least[other]], "v": nodes[other]})

    return links.groupBy().applyInPandas(run, "u bigint, v bigint")


def connected_components(nodes: DataFrame, links: DataFrame, few: int | None = None) -> DataFrame:
    """(id, component) of every node (id), where component is the smallest identifier in it; links (src, dst) count in both directions.

    Links to unknown nodes and to itself don't count; a node without links is a component. Alternating large and small stars:
    every round points each node's greater, then its smaller neighbours at the smallest neighbour, so that paths shrink geometrically
    and a round carries no more links than there are nodes and links. A hub is only ever a group key of a minimum, which is combined
    before the shuffle, and one side of an equi-join that the adaptive planner splits. Lineage is cut each round by a written table. Up to ``few``
    links need no rounds: one task has the answer.
    """
    few = FEW_LINKS if few is None else few
    known = nodes.select("id")
    pairs = links.where("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    pairs = pairs.join(known.withColumnRenamed("id", "u"), "u", "left_semi").join(known.withColumnRenamed("id", "v"), "v", "left_semi")
    now = written(pairs.select("u", "v"), "links")

    def star(rows: DataFrame, large: bool) -> DataFrame:
        if large:  # v: greater neighbours of u
            both = rows.unionByName(rows.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:  # v: neighbours of u that aren't greater
            both = rows.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("m").alias("u"), "v").distinct()
        own = least.where("m < u").select(F.col("m"), F.col("u").alias("v"))
        out = joined.where("v <> m").select("m", "v").unionByName(own)
        return out.select(F.least("m", "v").alias("u"), F.greatest("m", "v").alias("v")).where("u <> v").distinct()

    last = None
    while True:
        if last is None and now.count() <= few:
            now = _components_here(now)
            break
        before = now
        now = written(star(star(now, True), False), "stars")
        freed(before)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    roots = now.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("component"))
    return known.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    """(component, papers)."""
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("papers"))


def component_histogram(components: DataFrame) -> DataFrame:
    """(papers, components): how many components there are of each size."""
    return component_sizes(components).groupBy("papers").agg(F.count(F.lit(1)).alias("components"))


def largest_component(components: DataFrame, least: int = 3) -> DataFrame:
    """(component, papers) of the largest component of at least ``least`` papers, ties to the one that begins first; else no row."""
    return component_sizes(components).where(F.col("papers") >= least).orderBy(F.desc("papers"), "component").limit(1)


def colours(components: DataFrame) -> DataFrame:
    """(component, colour): components numbered from 1 in the order of their first paper."""
    from orrery.operators.citations import indexed

    return indexed(components.select("component").distinct(), "component", "k").select("component", (F.col("k") + 1).alias("colour"))


def transitive_reduction(links: DataFrame) -> DataFrame:
    """(src, dst) of the links that no longer path replaces; links lead to smaller identifiers, others are left out.

    From every source that has several targets a frontier walks on, hop by hop, each node once, no further than above the smallest target that is
    still undecided; a target met after two or more hops is dropped, and a source all of whose targets but the greatest are decided stops. What is held grows
    with the pairs of source and node so reached, not with the number of paths. A walk ends as identifiers fall along it.
    """
    pairs = written(links.where("src > dst").select("src", "dst").distinct(), "links")
    onward = pairs.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    # A source's greatest target can't be met on the way: it isn't below any other.
    open_ = pairs.join(pairs.groupBy("src").agg(F.max("dst").alias("top")), "src").where("dst < top").select("src", "dst")
    target = open_.select("src", F.col("dst").alias("at"), F.lit(True).alias("met"))
    low = open_.groupBy("src").agg(F.min("dst").alias("low"))
    front = pairs.join(low, "src").where("dst > low").select("src", F.col("dst").alias("at"), "low")
    reached = None
    while True:
        step = front.join(onward, "at").where("next >= low").select("src", F.col("next").alias("at")).distinct()
        if reached is not None:
            step = step.join(reached.select("src", "at"), ["src", "at"], "left_anti")
        step = written(step.join(target, ["src", "at"], "left"), "reached")
        if step.isEmpty():
            break
        reached = step if reached is None else reached.unionByName(step)
        met = reached.where("met").select("src", F.col("at").alias("dst"))
        low = open_.join(met, ["src", "dst"], "left_anti").groupBy("src").agg(F.min("dst").alias("low"))
        # Targets of the source itself have been walked on from in the first round.
        front = step.join(low, "src").where("at > low").join(pairs.withColumnRenamed("dst", "at"), ["src", "at"], "left_anti").select("src", "at", "low")
    return pairs if reached is None else pairs.join(met, ["src", "dst"], "left_anti")


def fake_links(rows: DataFrame, components: DataFrame, keywords: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links that bridge components to the largest one: (src, dst, slot), and the papers (id) that are then connected.

    rows(id, cat, mass): papers with the number of their first category; keywords(id, slot, keyword). As a walk over categories in
    order, then papers in order: a paper that isn't connected yet links to the heaviest connected paper of its category with each of its
    keywords (as connected when the category began), or, with none, to the heaviest connected paper of the category by then;
    and its whole component becomes connected. Ties go to the smaller identifier.

    The walk needs no single task: in a category, a component is connected by its first paper there if, and only if, any
    paper of the category was connected when it began. So which component is connected in which category follows from the sets of
    categories that components span, at most 256 x 256 pairs of which come to the driver; the links follow from aggregates.
    """
    top = largest_component(components)
    papers_ = rows.join(components, "id").join(F.broadcast(top.select("component", F.lit(True).alias("big"))), "component", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    papers_ = written(papers_, "bridging")
    spans = papers_.where("not big").select("component", "cat").distinct()
    together = spans.join(spans.withColumnRenamed("cat", "other"), "component").select("cat", "other").distinct().collect()
    reach: dict[int, set[int]] = {}
    for r in together:
        reach.setdefault(r["cat"], set()).add(r["other"])
    live = {r[0] for r in papers_.where("big").select("cat").distinct().collect()}
    opened = []
    for cat in sorted(reach):
        if cat in live:
            opened.append(cat)
            live |= reach[cat]
    step = spans.where(F.col("cat").isin(opened)).groupBy("component").agg(F.min("cat").alias("step"))
    papers_ = papers_.join(step, "component", "left").withColumn("step", F.when(F.col("big"), F.lit(-1)).otherwise(F.col("step")))
    papers_ = written(papers_, "steps")
    linking = papers_.where("step = cat and not big").groupBy("component", "cat").agg(F.min("id").alias("id"))

    before = papers_.where("step < cat")
    by_keyword = best_by(before.join(keywords.select("id", "keyword"), "id"), ["cat", "keyword"], "mass", "id", "id", "dst")
    of_words = linking.join(keywords, "id").join(by_keyword, ["cat", "keyword"]).select(F.col("id").alias("src"), "dst", "slot")

    # The heaviest connected paper by then: of those before the category, and of the components that it connected earlier.
    start = before.groupBy("cat").agg(F.min(F.struct((-F.col("mass")).alias("m"), "id")).alias("best"))
    own = papers_.where("step = cat and not big").groupBy("component", "cat").agg(F.min(F.struct((-F.col("mass")).alias("m"), "id")).alias("heaviest"), F.min("id").alias("id"))
    late = least_before(own.select("cat", "id", "heaviest"), "cat", "id", "heaviest", "h")
    without = linking.join(of_words.select(F.col("src").alias("id")).distinct(), "id", "left_anti")
    fallback = without.join(late.select("id", "h"), "id", "left").join(start, "cat").select(F.col("id").alias("src"), F.least("h", "best")["id"].alias("dst"), F.lit(0).alias("slot"))
    connected = papers_.where(F.col("step").isNotNull()).select("id")
    return of_words.unionByName(fallback), connected


def select_graph(rows: DataFrame, links: DataFrame, keywords: DataFrame, start: int, end: int, other_veto: bool = False) -> dict[str, DataFrame]:
    """The graph to be laid out: papers (id, cat, age, cites), links (src, dst, freq) and fake links, over an identifier range.

    ``other_veto`` keeps only papers with a link that is no reference (frequency 0, weight above 0). Papers that can't be connected to
    the largest component are left out, and citations are counted anew among those that stay.
    """
    from orrery.operators.citations import citation_counts

    chosen = rows.where(F.col("id").between(start, end))
    if other_veto:
        chosen = chosen.join(links.where("freq = 0 and weight > 0").select(F.col("src").alias("id")), "id", "left_semi")
    components = written(connected_components(chosen, links), "components")
    fakes, connected = fake_links(chosen, components, keywords.join(chosen.select("id"), "id", "left_semi"))
    connected = written(connected, "connected")
    inside = links.join(connected.withColumnRenamed("id", "src"), "src", "left_semi").join(connected.withColumnRenamed("id", "dst"), "dst", "left_semi")
    cites = citation_counts(inside, connected, only_frequent=True)
    kept = chosen.select("id", "cat", ((F.col("id") - start) / F.lit(float(max(1, end - start)))).alias("age")).join(cites, "id")
    return {"papers": kept, "links": inside, "fake_links": fakes}
