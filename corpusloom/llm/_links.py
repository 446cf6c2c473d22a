"""Shared parts of the near-duplicate operators: sorted-order candidates, exact links, components.

Nothing here emits all pairs of a group: rows of one sorted order meet only their next ``window``
neighbours. Where a run of equal prefixes is longer than that, its rows are contracted by component after
each verification and meet again, until a pass finds no new link; what that leaves apart in a run is then held
against all of the run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import discard, spread_join, written

#: Edges up to which components are found in one task (24 MB); beyond, by distributed star contraction.
ONE_TASK_EDGES = 1_500_000
#: Identifiers up to which a join side is broadcast (16 bytes each).
BROADCAST_IDS = 1_000_000
#: Rows of a crowded run that ask, and rows they are held against, in one block.
QUERIES, ROWS = 500, 2_000
#: Candidate pairs up to which all are verified at once: so few cost less than the rounds that would save some.
AT_ONCE = 200_000
#: Rows at the edges of partitions that one task sorts.
EDGE_ROWS = 1_000_000


def _labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their component's least node, by hooking and pointer jumping."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        if (rx == ry).all():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while not np.array_equal(jumped := root[root], root):
            root = jumped


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every node of ``edges`` (a long, b long): comp is the component's least id."""
    edges = edges.select("a", "b")
    if edges.count() <= ONE_TASK_EDGES:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches]
            if got:
                nodes, comp = _labels(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]))
                for i in range(0, len(nodes), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + 100_000]), pa.array(comp[i : i + 100_000])], ["id", "comp"])

        return written(edges.repartition(1).mapInArrow(run, "id long, comp long"), "components")
    return star_components(edges)


def star_components(edges: DataFrame) -> DataFrame:
    """Components by alternating large-star and small-star steps, each a written table."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if not large:
            both = both.where("b <= a")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        rows = spread_join(both, least, ["a"], "n", ["b"], both.count())
        own = least.where("a <> m").select("a", F.col("m").alias("b"))
        moved = rows.where("b > a AND b <> m" if large else "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(own).distinct()

    loops = edges.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("comp"))
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    digest = None
    while True:
        step = written(star(written(star(now, True), "stars"), False), "stars")
        mark = tuple(step.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        discard(now)
        now = step
        if mark == digest:
            break
        digest = mark
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    whole = now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
    return whole.unionByName(loops.join(whole, "id", "left_anti").distinct())


ORDER_ROW = "tree int, s binary, rid long, n int, sketch binary"


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    if not width or not len(column):
        return np.zeros((len(column), width), np.uint8)
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
    return raw[first : first + width * len(column)].reshape(-1, width)


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Batches of at least ``rows`` rows, but for the last."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def neighbours(prefix: int, s_bytes: int, sketch_bytes: int, least_same: int, window: int, ratio: float) -> Callable:
    """A function over sorted batches of ``ORDER_ROW``, for ``mapInArrow``.

    Gives rows of three kinds: 0, a candidate pair (a < b, same sketch bytes); 1, a row near the partition's
    edge; 2, a row of a run of equal prefixes longer than the window, with the run's prefix.
    """
    names = ["kind", "a", "b", "same", "tree", "s", "n", "sketch"]

    def block(tree, s, rid, n, sketch, new_from, last):
        head = np.zeros((len(rid), 8), np.uint8)
        head[:, : min(8, prefix)] = s[:, : min(8, prefix)]
        head = head.view(np.uint64).ravel() ^ (tree.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out_a, out_b, out_same, dense = [], [], [], np.zeros(len(rid), bool)
        m = len(rid)
        for k in range(1, min(window, m - 1) + 1):
            lo = max(0, new_from - k)
            x, y = np.arange(lo, m - k), np.arange(lo + k, m)
            ok = (head[x] == head[y]) & (rid[x] != rid[y])
            x, y = x[ok], y[ok]
            if k == window and len(x):
                for q in range(window + 1):
                    dense[x + q] = True
            small, big = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = small >= ratio * big
            x, y = x[ok], y[ok]
            if sketch_bytes:
                same = (sketch[x] == sketch[y]).sum(1)
                ok = same >= least_same
                x, y, same = x[ok], y[ok], same[ok]
            else:
                same = np.zeros(len(x), np.int64)
            out_a.append(np.minimum(rid[x], rid[y]))
            out_b.append(np.maximum(rid[x], rid[y]))
            out_same.append(same)
        empty = np.zeros(0, np.int64)
        return np.concatenate(out_a or [empty]), np.concatenate(out_b or [empty]), np.concatenate(out_same or [empty]), dense

    def rows(kind, tree, s, rid, n, sketch, at, cut=None):
        w = len(at)
        body = [pa.array(np.full(w, kind, np.int32)), pa.array(rid[at]), pa.nulls(w, pa.int64()), pa.nulls(w, pa.int32()), pa.array(tree[at].astype(np.int32))]
        body.append(pa.array([bytes(x)[: cut or s_bytes] for x in s[at]], pa.binary()))
        body.append(pa.array(n[at].astype(np.int32)))
        body.append(pa.array([bytes(x) for x in sketch[at]], pa.binary()))
        return pa.RecordBatch.from_arrays(body, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail, started = None, False
        for batch in _gathered(batches):
            cur = (batch.column(0).to_numpy().astype(np.int64), _fixed(batch.column(1), s_bytes), batch.column(2).to_numpy(), batch.column(3).to_numpy().astype(np.int64), _fixed(batch.column(4), sketch_bytes))
            new_from = 0
            if tail is not None:
                new_from = len(tail[2])
                cur = tuple(np.concatenate([t, c]) for t, c in zip(tail, cur))
            a, b, same, dense = block(*cur, new_from, False)
            if len(a):
                w = len(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(w, np.int32)), pa.array(a), pa.array(b), pa.array(same.astype(np.int32)), pa.nulls(w, pa.int32()), pa.nulls(w, pa.binary()), pa.nulls(w, pa.int32()), pa.nulls(w, pa.binary())], names)
            if dense.any():
                yield rows(2, *cur, np.flatnonzero(dense))
            if not started:
                yield rows(1, *cur, np.arange(min(window, len(cur[2]))))
                started = True
            tail = tuple(c[-window:] for c in cur)
        if tail is not None:
            yield rows(1, *tail, np.arange(len(tail[2])))

    return run


FOUND_ROW = "kind int, a long, b long, same int, tree int, s binary, n int, sketch binary"


def met(rows: DataFrame, keys: list[str], run: Callable, schema: str, edge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All that ``run`` finds over ``rows`` sorted by ``keys``, which are split by range, so a hot region spreads over tasks.

    The rows at the edges of partitions (kind 1, which ``edge`` turns into rows again) meet in further sorts of
    their own, until one partition holds them all.
    """
    found = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema), "neighbours")
    out = found
    while True:
        ends = edge(found.where("kind = 1")).distinct()
        parts = -(-ends.count() // EDGE_ROWS)
        if not parts:
            return out
        ends = ends.repartition(1) if parts == 1 else ends.repartitionByRange(parts, *keys)
        found = written(ends.sortWithinPartitions(*keys).mapInArrow(run, schema), "edges")
        out = out.unionByName(found)
        if parts == 1:
            return out


def candidates(orders: DataFrame, **shape) -> tuple[DataFrame, DataFrame]:
    """Distinct candidate pairs (a, b, same) of all sorted orders, and the rows of runs beyond the window."""
    row = ["tree", "s", F.col("a").alias("rid"), "n", "sketch"]
    found = met(orders, ["tree", "s", "rid"], neighbours(**shape), FOUND_ROW, lambda x: x.select(row))
    pairs = written(found.where("kind = 0").groupBy("a", "b").agg(F.max("same").alias("same")), "pairs")
    return pairs, written(found.where("kind = 2").select(row).distinct(), "crowded")


def _verifier(reach: Callable[[pa.Array, pa.Array], list[bool]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = reach(batch.column(2), batch.column(3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return run


def _needed(bodies: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """``bodies`` without those that no id asks for, so far as ``few`` ids can be told to all tasks: only the rest is then shuffled."""
    return bodies.join(F.broadcast(ids.distinct()), "rid", "left_semi") if few else bodies


def linked(pairs: DataFrame, bodies: DataFrame, reach: Callable) -> DataFrame:
    """Links (a, b) among candidate pairs whose ends are in different components, verified on ``bodies``.

    Of the pairs left, each round verifies the most similar ones of each row, four times as many as the round
    before, and drops those that links found so far join; so every pair is either verified or joined.
    """
    left, most = pairs, 1
    found = before = None
    while True:
        rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("same"), "a"))
        left = written(left.withColumn("rank", rank), "left")
        if before is not None:
            discard(before)
        before = left
        n = left.count()
        if not n:
            return found if found is not None else pairs.select("a", "b").limit(0)
        now = left.where(F.col("rank") <= most) if n > AT_ONCE else left
        few = (now.count() if n > AT_ONCE else n) <= BROADCAST_IDS
        x, y = (_needed(bodies, now.select(F.col(c).alias("rid")), few).select(F.col("rid").alias(c), F.col("body").alias(v)) for c, v in (("a", "x"), ("b", "y")))
        checked = written(now.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verifier(reach), "a long, b long, ok boolean"), "checked")
        new = checked.where("ok").select("a", "b")
        found = new if found is None else found.unionByName(new)
        rest = left.where(F.col("rank") > most).select("a", "b", "same")
        if n <= AT_ONCE or rest.isEmpty():
            return found
        comp = components(found)
        left = _apart(rest, comp)
        most *= 4


def contracted(dense: DataFrame, comp: DataFrame, prefix: int) -> DataFrame:
    """Rows of crowded runs, one per run and component."""
    rows = dense.join(comp.select(F.col("id").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    run = F.substring("s", 1, prefix).alias("run")
    return rows.groupBy("tree", run, "comp").agg(F.min_by(F.struct("s", "rid", "n", "sketch"), F.struct("s", "rid")).alias("x")).select("tree", "x.s", "x.rid", "x.n", "x.sketch")


def settled(met: tuple[DataFrame, DataFrame], bodies: Callable[[DataFrame], DataFrame], reach: Callable, shape: dict, late: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(links, components) of the candidate pairs and crowded rows that sorted orders gave.

    ``bodies`` gives the (rid, body) of wanted identities. Crowded runs are contracted by component and sorted
    again as long as a pass finds links; rows outside the largest component of a crowded run are at last held
    against all of the run. Orders without sketches say in ``late`` how those rows get theirs: ``sketch`` (a
    function of flat sets and offsets), ``sketch_bytes`` and ``least_same``. The table of bodies is deleted at the end.
    """
    pairs, dense = met
    crowded = dense
    own = bodies(pairs.select(F.col("a").alias("rid")).unionByName(pairs.select(F.col("b").alias("rid"))).unionByName(dense.select("rid")).distinct())
    links = written(linked(pairs, own, reach), "links")
    comp, tried = components(links), pairs.select("a", "b")
    while not dense.isEmpty():
        again, dense = candidates(contracted(dense, comp, shape["prefix"]), **shape)
        again = written(_apart(again.join(tried, ["a", "b"], "left_anti"), comp), "pairs")
        more = written(linked(again, own, reach), "links")
        if more.isEmpty():
            break
        tried = tried.unionByName(again.select("a", "b"))
        links = written(links.unionByName(more), "links")
        comp = components(links)
    if late and not crowded.isEmpty():
        crowded, shape = sketched(crowded, own, late["sketch"]), {**shape, **late}
    if shape["sketch_bytes"]:
        more = written(stragglers(crowded, comp, own, shape), "links")
        if not more.isEmpty():
            links = written(links.unionByName(more), "links")
            comp = components(links)
    discard(own)
    return links, comp


def sketched(dense: DataFrame, bodies: DataFrame, sketch: Callable) -> DataFrame:
    """``dense`` with sizes and sketches made from the rows' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            if sets:
                size = [len(x) for x in sets]
                rows = sketch(np.concatenate(sets), np.r_[0, np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), pa.array([bytes(x) for x in rows], pa.binary())], ["rid", "n", "sketch"])

    made = bodies.select("rid", "body").join(dense.select("rid").distinct(), "rid", "left_semi").mapInArrow(run, "rid long, n int, sketch binary")
    return dense.drop("n", "sketch").join(written(made, "sketches"), "rid")


def stragglers(dense: DataFrame, comp: DataFrame, bodies: DataFrame, shape: dict) -> DataFrame:
    """Links (a, b) between the components of each crowded run.

    The rows outside a run's largest component are a query set: each is held against all rows of that
    component's crowded runs, in blocks of ``QUERIES`` by ``ROWS``, by sketch and then in full. So any two rows
    of a run that are in different components meet, however many there are. Of the links of a row to one
    component one is given.
    """
    rows = dense.join(comp.select(F.col("id").alias("rid"), "comp"), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))
    rows = written(rows.withColumn("run", F.substring("s", 1, shape["prefix"])).drop("s"), "crowded")
    parts = rows.groupBy("tree", "run", "comp").agg(F.count(F.lit(1)).alias("m"))
    runs = parts.groupBy("tree", "run").agg(F.sum("m").alias("rows"), F.max(F.struct("m", "comp")).alias("top"))
    runs = runs.where("top.m < rows").select("tree", "run", F.col("top.comp").alias("main"), "rows")
    both = spread_join(rows, runs, ["tree", "run"], "rows", ["rid"], rows.count())
    once = written(both.groupBy("main", "rid").agg(*[F.first(c).alias(c) for c in ("comp", "n", "sketch")]), "crowded")
    sizes = once.groupBy("main").agg(F.ceil(F.sum((F.col("comp") != F.col("main")).cast("int")) / QUERIES).alias("qs"), F.ceil(F.count(F.lit(1)) / ROWS).alias("ms"), F.count(F.lit(1)).alias("rows"))
    once = spread_join(once, sizes, ["main"], "rows", ["rid"], once.count())
    block = lambda n: F.pmod(F.xxhash64("rid"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asked = once.where("comp <> main").withColumn("q", block("qs")).withColumn("x", every("ms")).withColumn("asks", F.lit(True))
    held = once.withColumn("q", every("qs")).withColumn("x", block("ms")).withColumn("asks", F.lit(False))
    cols = ["main", "q", "x", "asks", "rid", "comp", "n", "sketch"]
    grid = asked.select(cols).unionByName(held.select(cols)).join(bodies, "rid").select(*cols, "body")
    grid = grid.repartition("main", "q", "x").sortWithinPartitions("main", "q", "x")
    return grid.mapInArrow(_asking(shape), "a long, b long").distinct()


def _asking(shape: dict) -> Callable:
    width, least, ratio = shape["sketch_bytes"], shape["least_same"], shape["ratio"]

    def links(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy(zero_copy_only=False)
        rid, comp, n = (t[c].to_numpy() for c in ("rid", "comp", "n"))
        sketch, body = _fixed(t["sketch"].chunk(0), width), t["body"].chunk(0)
        main = t["main"].to_numpy()
        ask = np.flatnonzero(asks)
        own, size, mine, name = sketch[ask], n[ask], comp[ask], rid[ask]
        #: Hashes of all sets that ask, sorted, and whose they are.
        sets = [np.frombuffer(body[int(k)].as_py(), np.uint64) for k in ask]
        keys, owner = np.concatenate(sets or [np.zeros(0, np.uint64)]), np.repeat(np.arange(len(ask)), [len(x) for x in sets])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], owner[order]
        done: set[tuple[int, int]] = set()
        out = []
        for h in np.flatnonzero(~asks) if len(ask) else ():
            fit = (mine != comp[h]) & (np.minimum(size, n[h]) >= ratio * np.maximum(size, n[h])) & ((own == sketch[h]).sum(1) >= least)
            if comp[h] != main[h]:
                #: Both ask: one way is enough.
                fit &= name < rid[h]
            if not fit.any():
                continue
            x = np.frombuffer(body[int(h)].as_py(), np.uint64)
            first = np.searchsorted(keys, x)
            many = np.searchsorted(keys, x, "right") - first
            hits = owner[np.repeat(first - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(int(many.sum()))]
            same = np.bincount(hits, minlength=len(ask))
            for k in np.flatnonzero(fit & (same >= ratio * (size + n[h] - same))):
                pair = (int(name[k]), int(comp[h]))
                if pair not in done:
                    done.add(pair)
                    out.append((min(pair[0], int(rid[h])), max(pair[0], int(rid[h]))))
        return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            start = 0
            for i, k in enumerate(keys):
                if k != last:
                    if held or i > start:
                        yield links(pa.Table.from_batches([*held, batch.slice(start, i - start)]))
                    held, start, last = [], i, k
            held.append(batch.slice(start))
        if held:
            yield links(pa.Table.from_batches(held))

    return run


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends aren't in one component."""
    return (
        pairs.join(comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a", "left")
        .join(comp.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b", "left")
        .where("coalesce(ca, a) <> coalesce(cb, b)")
        .select("a", "b", "same")
    )
