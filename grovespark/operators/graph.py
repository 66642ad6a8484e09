"""Walks over commit and object graphs: closures, history, ancestry, what to keep and what to send.

Edges are a table (child, parent, ord): from an object to those it needs. closure() is the one walk that
all others use. It is a loop over frontiers, one equi-join and one anti-join a level; every level is
a written table. A graph of up to SMALL edges (and roots) is walked on the driver instead, or, for pairs, by every
task that has some, where a level costs microseconds and not a job; one row more than the limit is asked for to check
it, and the results are the same.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovespark.errors import HistoryTooLargeError, ObjectNotFoundError
from grovespark.operators.packs import positions
from grovespark.storage import Scratch, numbered

#: Edges (two ids each) that are taken to the driver at most.
SMALL = 500_000
#: Commits of short phases that a task puts in order together, about.
TOGETHER = 100_000


def _few(rows: DataFrame, small: int):
    """rows as an Arrow table, or null if there are more than `small`; one job, which brings small + 1 rows at most."""
    if small <= 0:
        return None
    table = rows.limit(small + 1).toArrow()
    return table if table.num_rows <= small else None


def _adjacency(table) -> dict:
    out = defaultdict(list)
    for c, p in zip(table.column("child").to_pylist(), table.column("parent").to_pylist(), strict=True):
        out[c].append(p)
    return out


def _ids(spark: SparkSession, ids, like: DataFrame, column: str = "child") -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], f"oid {like.schema[column].dataType.simpleString()}")


def closure(edges: DataFrame, roots: DataFrame, stop: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """(oid): the roots and all that edges reach from them. stop: ids that are reached but not passed
    (a shallow boundary, or what is known already). Null ids are passed over."""
    spark = edges.sparkSession
    roots = roots.select("oid").where("oid is not null").distinct()
    table = _few(edges.select("child", "parent"), small)
    start = _few(roots, small) if table is not None else None
    held = _few(stop.select("oid"), small) if start is not None and stop is not None else None
    if start is not None and (stop is None or held is not None):
        near = _adjacency(table)
        halt = set(held.column("oid").to_pylist()) if held is not None else set()
        seen = set(start.column("oid").to_pylist())
        todo = list(seen)
        while todo:
            if (now := todo.pop()) in halt:
                continue
            for p in near.get(now, ()):
                if p is not None and p not in seen:
                    seen.add(p)
                    todo.append(p)
        return _ids(spark, sorted(seen), edges)
    scratch = Scratch(spark)
    edges = scratch.keep(edges.select("child", "parent"))  # every level reads them
    frontier = scratch.keep(roots)
    seen = frontier
    while not frontier.isEmpty():
        ahead = frontier if stop is None else frontier.join(stop.select("oid"), "oid", "left_anti")
        next_ = edges.join(ahead, F.col("child") == F.col("oid"), "left_semi").select(F.col("parent").alias("oid")).where("oid is not null").distinct()
        frontier = scratch.keep(next_.join(seen, "oid", "left_anti"))
        seen = seen.union(frontier)
    return seen


def missing(edges: DataFrame, objects: DataFrame, reached: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(oid): what is reached but not there. With a boundary, parents of the commits in it are forgiven."""
    gone = reached.join(objects.select("oid"), "oid", "left_anti")
    if boundary is None:
        return gone
    only = edges.join(gone, F.col("parent") == F.col("oid"), "left_semi").join(boundary.select(F.col("oid").alias("child")), "child", "left_anti").select(F.col("parent").alias("oid")).distinct()
    return gone.join(only, "oid", "left_semi")


def reachable(edges: DataFrame, objects: DataFrame, roots: DataFrame, boundary: DataFrame | None = None, absent: str = "raise") -> DataFrame:
    """closure() over objects that are there. absent: 'raise' names a missing one, 'skip' leaves them out,
    'skip_parents' leaves out missing parents of commits (edges of kind 'parent') alone."""
    reached = closure(edges, roots, boundary)
    bad = missing(edges, objects, reached, boundary)
    if absent == "skip_parents" and "kind" in edges.columns:
        bad = bad.join(edges.where("kind <> 'parent'").select(F.col("parent").alias("oid")).distinct(), "oid", "left_semi")
    if absent != "skip":
        first = bad.orderBy("oid").first()
        if first:
            raise ObjectNotFoundError(str(first["oid"]))
    return reached.join(objects.select("oid"), "oid", "left_semi")


def object_edges(commits: DataFrame, tree_entries: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """(child, parent, kind): commit to tree and parents, tree to entries (submodules aren't objects here), tag to
    its object."""
    out = commits.select(F.col("oid").alias("child"), F.col("tree").alias("parent"), F.lit("tree").alias("kind"))
    out = out.union(commits.select(F.col("oid").alias("child"), F.explode("parents").alias("parent"), F.lit("parent").alias("kind")))
    out = out.union(tree_entries.where("mode <> '160000'").select(F.col("tree_oid").alias("child"), F.col("oid").alias("parent"), F.lit("entry").alias("kind")))
    if tags is not None:
        out = out.union(tags.select(F.col("oid").alias("child"), F.col("object").alias("parent"), F.lit("tag").alias("kind")))
    return out


def commit_edges(commits: DataFrame) -> DataFrame:
    """(child, parent, ord) of commits' parents."""
    return commits.select(F.col("oid").alias("child"), F.posexplode("parents").alias("ord", "parent")).select("child", "parent", "ord")


def child_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("oid")).agg(F.count("*").alias("children"))


def gc_roots(refs: DataFrame, head: str | None = None, spaces: tuple[str, ...] = ("refs/heads/", "refs/tags/")) -> DataFrame:
    """(oid): what HEAD, branches and tags point to; refs (name, oid) resolved."""
    wanted = F.col("name") == "HEAD"
    for space in spaces:
        wanted = wanted | F.col("name").startswith(space)
    out = refs.where(wanted & F.col("oid").isNotNull()).select("oid")
    return out if head is None else out.union(refs.sparkSession.createDataFrame([(head,)], "oid string"))


def gc(edges: DataFrame, objects: DataFrame, roots: DataFrame, absent: str = "raise") -> DataFrame:
    """(oid): objects that nothing reaches."""
    return objects.select("oid").join(reachable(edges, objects, roots, absent=absent), "oid", "left_anti")


def to_send(edges: DataFrame, wants: DataFrame, haves: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """(oid): what wants reach and haves don't."""
    return closure(edges, wants, boundary).join(closure(edges, haves), "oid", "left_anti")


def common(haves: DataFrame, objects: DataFrame) -> DataFrame:
    """(oid): haves that are there; negotiation is ready when there is any."""
    return haves.select("oid").distinct().join(objects.select("oid"), "oid", "left_semi")


def is_ancestor(edges: DataFrame, pairs: DataFrame, objects: DataFrame | None = None, boundary: DataFrame | None = None, small: int = SMALL) -> DataFrame:
    """pairs (old, new) with `ancestor`: whether new reaches old through objects that are there. Equal ids are
    ancestors; so is anything if a walk comes upon a missing id of the boundary. Pairs are walked together."""
    spark = edges.sparkSession
    there = edges if objects is None else edges.join(objects.select(F.col("oid").alias("child")), "child", "left_semi")
    table = _few(there.select("child", "parent"), small)
    if table is not None:
        # the graph is small: every task has it and walks its share of the pairs
        ends = there.select(F.col("parent").alias("oid")).distinct()  # no more than there are edges
        have = {r["oid"] for r in ends.join(objects.select("oid"), "oid", "left_semi").collect()} if objects is not None else None
        edge = {r["oid"] for r in ends.join(boundary.select("oid"), "oid", "left_semi").collect()} if boundary is not None else set()
        shared = spark.sparkContext.broadcast((dict(_adjacency(table)), have, edge))

        def walk(batches):
            near, there_, pardoned = shared.value
            for batch in batches:
                flags = []
                for old, new in zip(batch.column("old").to_pylist(), batch.column("new").to_pylist(), strict=True):
                    seen, todo, found = {new}, [new], old == new
                    while todo and not found:
                        for p in near.get(todo.pop(), ()):
                            if p == old or (there_ is not None and p not in there_ and p in pardoned):
                                found = True
                                break
                            if p is not None and p not in seen:
                                seen.add(p)
                                todo.append(p)
                    flags.append(found)
                yield pa.RecordBatch.from_arrays([batch.column("old"), batch.column("new"), pa.array(flags, pa.bool_())], ["old", "new", "ancestor"])

        kind = edges.schema["child"].dataType.simpleString()
        return pairs.join(pairs.select("old", "new").distinct().mapInArrow(walk, f"old {kind}, new {kind}, ancestor boolean"), ["old", "new"])
    scratch = Scratch(spark)
    wanted, ahead = pairs.select("old", "new").distinct(), there.select("child", "parent")
    if boundary is None:
        # whoever lies no higher above the roots than the old one can't reach it, and isn't walked
        ends = ahead.select(F.col("child").alias("oid")).union(ahead.select("parent")).union(wanted.select("old"))
        high = scratch.keep(generations(ahead, ends, small).withColumnRenamed("oid", "at"))
        wanted = wanted.join(high.select(F.col("at").alias("old"), F.col("generation").alias("floor")), "old")
        ahead = scratch.keep(ahead.join(high.withColumnRenamed("at", "parent"), "parent"))
    else:
        wanted, ahead = wanted.withColumn("floor", F.lit(-1)), ahead.withColumn("generation", F.lit(0))
    frontier = scratch.keep(wanted.select("old", "new", "floor", F.col("new").alias("at")))
    seen = frontier
    while not frontier.where("at <> old").isEmpty():
        step = frontier.where("at <> old").join(ahead.where("parent IS NOT NULL"), F.col("at") == F.col("child")).where("parent = old OR generation > floor").select("old", "new", "floor", F.col("parent").alias("at")).distinct()
        frontier = scratch.keep(step.join(seen, ["old", "new", "at"], "left_anti"))
        seen = seen.unionByName(frontier)
    hit = F.col("at") == F.col("old")
    if boundary is not None and objects is not None:
        pardon = boundary.select(F.col("oid").alias("at")).join(objects.select(F.col("oid").alias("at")), "at", "left_anti").withColumn("pardon", F.lit(True))
        seen = seen.join(pardon, "at", "left")
        hit = hit | F.col("pardon").isNotNull()
    flags = seen.groupBy("old", "new").agg(F.max(hit).alias("ancestor"))
    return pairs.join(flags, ["old", "new"])


def generations(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(oid, generation): edges on the longest way down to a node without parents (0)."""
    return _longest(edges.select("child", "parent"), nodes, small, "generation")


def topo_levels(edges: DataFrame, nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(oid, level): edges on the longest way down from a node without children; children come before parents
    in the order of levels, whatever their dates."""
    return _longest(edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), nodes, small, "level")


def _longest(edges: DataFrame, nodes: DataFrame, small: int, name: str) -> DataFrame:
    spark = edges.sparkSession
    nodes = nodes.select("oid").distinct()
    inside = edges.join(nodes.select(F.col("oid").alias("child")), "child", "left_semi").join(nodes.select(F.col("oid").alias("parent")), "parent", "left_semi").select("child", "parent")
    table, all_nodes = _few(inside, small), None
    if table is not None:
        all_nodes = _few(nodes, small)
    if all_nodes is not None:
        up, waits = defaultdict(list), defaultdict(int)
        for c, p in zip(table.column("child").to_pylist(), table.column("parent").to_pylist(), strict=True):
            up[p].append(c)
            waits[c] += 1
        level = {i: 0 for i in all_nodes.column("oid").to_pylist()}
        ready = [i for i in level if not waits[i]]
        while ready:
            now = ready.pop()
            for c in up[now]:
                level[c] = max(level[c], level[now] + 1)
                waits[c] -= 1
                if not waits[c]:
                    ready.append(c)
        kind = edges.schema["child"].dataType.simpleString()
        return spark.createDataFrame(list(level.items()), f"oid {kind}, {name} int")
    # peel off, level by level, what has all its parents peeled off
    scratch = Scratch(spark)
    left, out, k = scratch.keep(inside), None, 0
    rest = scratch.keep(nodes)
    while True:
        now = scratch.keep(rest.join(left.select(F.col("child").alias("oid")).distinct(), "oid", "left_anti").withColumn(name, F.lit(k)))
        out = now if out is None else out.union(now)
        rest = scratch.keep(rest.join(now, "oid", "left_anti"))
        if rest.isEmpty() or now.isEmpty():
            return out
        left = scratch.keep(left.join(now.select(F.col("oid").alias("parent")), "parent", "left_anti"))
        k += 1


def history(commits: DataFrame, edges: DataFrame, start: DataFrame, exclude: DataFrame | None = None, first_parent: bool = False, since: int | None = None, small: int = SMALL) -> DataFrame:
    """commits (oid, ts, ...) that start reaches and exclude doesn't. A commit before `since` is neither given nor passed."""
    used = edges.where("ord = 0") if first_parent else edges
    there = commits.select("oid")
    used = used.join(there.select(F.col("oid").alias("parent")), "parent", "left_semi")
    if since is not None:
        late = commits.where(F.col("ts") >= since).select(F.col("oid").alias("child"))
        used = used.join(late, "child", "left_semi")
    reach = closure(used, start, small=small).join(there, "oid", "left_semi")
    if exclude is not None:
        reach = reach.join(closure(edges, exclude, small=small), "oid", "left_anti")
    out = commits.join(reach, "oid", "left_semi")
    return out if since is None else out.where(F.col("ts") >= since)


def log(commits: DataFrame, edges: DataFrame, start: DataFrame, exclude: DataFrame | None = None, order: str = "date", first_parent: bool = False, since: int | None = None, until: int | None = None, skip: int = 0, max_count: int | None = None, small: int | None = None) -> DataFrame:
    """The history of start, newest first, with `position` from 0 after skip. commits: oid, ts (the committer's time) and others.

    date: by time, then generation (a child before its parent of the same time), then id. since prunes the walk.
    topo: a child always before its parents, the newest first among those ready; since and until only hide rows.
    small: what is walked on the driver at most, SMALL unless given. A caller that gives it also bounds the topological order, which
    is then made on the driver alone (HistoryTooLargeError beyond `small` and SMALL); else tasks order larger histories.
    Parents that aren't there are passed over; a start that isn't there gives nothing."""
    bounded, small = small is not None, SMALL if small is None else small
    edges = Scratch(commits.sparkSession).keep(edges)  # several walks read them
    found = history(commits, edges, start, exclude, first_parent, since if order == "date" else None, small)
    if order == "topo":
        rank = _topo_order(found, edges.where("ord = 0") if first_parent else edges, max(small, SMALL), bounded)
        kept = found.join(rank, "oid")
        if since is not None:
            kept = kept.where(F.col("ts") >= since)
        keys = [F.col("__rank")]
    else:
        kept = found.join(generations(edges, found, small), "oid")
        keys = [F.desc("ts"), F.desc("generation"), F.col("oid")]
    if until is not None:
        kept = kept.where(F.col("ts") <= until)
    if max_count is not None:
        rows = kept.orderBy(*keys).limit(skip + max_count)  # so many rows at most are in one place
        out = rows.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long") - 1)
    else:
        out = numbered(kept, keys)
    return out.where(F.col("position") >= skip).withColumn("position", F.col("position") - skip).drop("__rank", "generation")


def _topo_order(found: DataFrame, edges: DataFrame, most: int, bounded: bool) -> DataFrame:
    """(oid, __rank): the order in which commits become ready, newest first. Ids and times of up to `most` commits (not their
    contents) and as many edges are put in order on the driver; more of them by tasks or, if bounded, not at all."""
    spark = found.sparkSession
    ids = found.select("oid")
    inside = edges.join(ids.withColumnRenamed("oid", "child"), "child", "left_semi").join(ids.withColumnRenamed("oid", "parent"), "parent", "left_semi")
    rows = _few(found.select("oid", "ts"), most)
    pairs = _few(inside.select("child", "parent").distinct(), most) if rows is not None else None
    if pairs is None:
        if bounded:
            raise HistoryTooLargeError(f"more than {most} commits or edges in topological order")
        return _topo_phases(found, edges)
    times = dict(zip(rows.column("oid").to_pylist(), rows.column("ts").to_pylist(), strict=True))
    near, waits = defaultdict(list), defaultdict(int)
    for child, parent in zip(pairs.column("child").to_pylist(), pairs.column("parent").to_pylist(), strict=True):
        near[child].append(parent)
        waits[parent] += 1
    ready = [(-t, i) for i, t in times.items() if not waits[i]]
    heapq.heapify(ready)
    out = []
    while ready:
        _, now = heapq.heappop(ready)
        out.append((now, len(out)))
        for p in near[now]:
            waits[p] -= 1
            if not waits[p]:
                heapq.heappush(ready, (-times[p], p))
    return spark.createDataFrame(out, f"oid {found.schema['oid'].dataType.simpleString()}, __rank long")


def _topo_phases(found: DataFrame, edges: DataFrame) -> DataFrame:
    """_topo_order() of any number of commits, by phases. A commit comes when it's the first in (newest, id) of those ready. Its phase is the
    last in that order of itself and all that reach it: nothing of a later phase comes before all of an earlier one has come,
    as of those that wait one is ready that is no later than its phase. So phases follow each other by their key, a phase's
    own commit is its first, and the rest of it depends on nothing outside. Where no parent is newer than its child, and none
    of the same time has the smaller id, each commit is a phase; the others are raised to the phase of a child, a job for each
    step on the way. What was raised to one phase is put in order by one task, which holds about a hundred bytes for each of them."""
    scratch = Scratch(found.sparkSession)
    nodes = scratch.keep(found.groupBy("oid").agg(F.max("ts").alias("ts")).select("oid", F.struct((-F.col("ts")).alias("late"), F.col("oid").alias("first")).alias("key")))
    ends = [nodes.select(F.col("oid").alias(side), F.col("key").alias(key)) for side, key in (("child", "start"), ("parent", "own"))]
    links = scratch.keep(edges.select("child", "parent").distinct().join(ends[0], "child").join(ends[1], "parent"))
    step, raised = links.where("start > own").groupBy(F.col("parent").alias("oid")).agg(F.max("start").alias("phase")), None
    while True:
        if raised is not None:
            step = step.join(raised.withColumnRenamed("phase", "was"), "oid", "left").where("was IS NULL OR phase > was").drop("was")
        frontier = scratch.keep(step)
        if frontier.isEmpty():
            break
        raised = frontier if raised is None else scratch.keep(raised.union(frontier).groupBy("oid").agg(F.max("phase").alias("phase")))
        step = frontier.join(links, F.col("oid") == F.col("child")).where("phase > own").groupBy(F.col("parent").alias("oid")).agg(F.max("phase").alias("phase"))
    if raised is None:
        return nodes.select("oid", F.struct("key.late", "key.first", F.lit(0).cast("long").alias("n")).alias("__rank"))
    above, below = raised.select(F.col("oid").alias("child"), F.col("phase").alias("above")), raised.select(F.col("oid").alias("parent"), "phase")
    inner = links.join(below, "parent").join(above, "child").where("above = phase").groupBy(F.col("child").alias("oid")).agg(F.collect_list("parent").alias("parents"))
    rows = nodes.join(raised, "oid").join(inner, "oid", "left").select(F.col("phase.late").alias("late"), F.col("phase.first").alias("first"), F.col("key.late").alias("own"), "oid", "parents")

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0

        def done(table: pa.Table) -> pa.RecordBatch:
            nonlocal count
            out = _ready_order(table.column("oid").combine_chunks(), table.column("parents").combine_chunks())
            count += len(out)
            return pa.RecordBatch.from_arrays([table.column("oid").combine_chunks().take(pa.array(out)), pa.array(np.arange(count - len(out), count) + 1)], ["oid", "n"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                # all but the last phase are whole
                table = pa.Table.from_batches(held)
                whole = pc.index(table.column("first"), table.column("first")[-1]).as_py()
                if whole:
                    yield done(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    kind = found.schema["oid"].dataType.simpleString()
    ranks = rows.repartition("late", "first").sortWithinPartitions("late", "first", "own", "oid").mapInArrow(order, f"oid {kind}, n long")
    at = nodes.join(raised, "oid", "left").join(scratch.keep(ranks), "oid", "left").select("oid", F.coalesce("phase", "key").alias("phase"), F.coalesce("n", F.lit(0)).alias("n"))
    return at.select("oid", F.struct("phase.late", "phase.first", "n").alias("__rank"))


def _ready_order(oids: pa.Array, parents: pa.Array) -> np.ndarray:
    """Places of oids in the order in which they become ready, the first place first among those; parents (a list or null for each)
    wait for their children."""
    n = len(oids)
    near = pc.index_in(pc.list_flatten(parents), value_set=oids).to_numpy(zero_copy_only=False).astype(np.int64)
    stops = np.searchsorted(pc.list_parent_indices(parents).to_numpy(zero_copy_only=False), np.arange(n + 1))
    waits = np.bincount(near, minlength=n)
    ready, out, count = np.flatnonzero(waits == 0).tolist(), np.zeros(n, np.int64), 0
    while ready:
        now = heapq.heappop(ready)
        out[count] = now
        count += 1
        for p in near[stops[now] : stops[now + 1]].tolist():
            waits[p] -= 1
            if not waits[p]:
                heapq.heappush(ready, p)
    return out[:count]


def all_closures(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, oid): a closure for each root: the materialised form of reachability bitmaps. One loop walks all roots."""
    scratch = Scratch(edges.sparkSession)
    frontier = scratch.keep(roots.select(F.col("oid").alias("root"), "oid").distinct())
    seen = frontier
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("oid") == F.col("child")).select("root", F.col("parent").alias("oid")).where("oid is not null").distinct()
        frontier = scratch.keep(step.join(seen, ["root", "oid"], "left_anti"))
        seen = seen.union(frontier)
    return seen


def closure_with(edges: DataFrame, roots: DataFrame, known: DataFrame, small: int = SMALL) -> DataFrame:
    """closure() with the help of materialised closures (root, oid): the walk stops at a root that is known, whose closure is
    taken as it is."""
    walked = Scratch(edges.sparkSession).keep(closure(edges, roots, known.select(F.col("root").alias("oid")).distinct(), small))
    return walked.union(known.join(walked.select(F.col("oid").alias("root")), "root", "left_semi").select("oid")).distinct()


def type_bitmaps(objects: DataFrame) -> DataFrame:
    """(type, bucket, bits): which positions (in the order of ids) hold each type, as Spark's bitmaps."""
    at = positions(objects.select("oid", "type")).withColumn("position", F.col("position") + 1)
    return at.groupBy("type", F.bitmap_bucket_number("position").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("position")).alias("bits"))
