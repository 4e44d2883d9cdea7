"""Tree ensembles of a grid on all rows of a table too large for one task.

Rows are binned once per held-out fold, at exact quantiles of its training rows, and lie
in blocks. A level of many trees is one job: tasks add up histograms of the open nodes of
their blocks, which are summed per tree, and only the chosen cuts reach the driver.

Boosting keeps each row's running predictions beside its block, so the held-out rows are
scored as the rounds go on. A forest's nodes are cut in this way until they weigh at most
``LOCAL_ROWS``; then a node's training rows meet in a task that grows the rest of its
tree, and held-out rows come along and bring their predictions home. Forests that differ
only in depth share their trees, as a shallow one is the top of a deep one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.operators import quantiles, trees
from diurna.session import scratch_path, ship_by_value, written_table

ship_by_value(__name__)

# Training rows of a node, or of a table, that one task takes.
LOCAL_ROWS = 20_000
BLOCK_ROWS = 50_000
# Rows times trees of a forest that grow side by side, and such trees at most.
CHUNK_ROWS, CHUNK_TREES = 8_000_000, 30
# Boosting rounds between two stored states.
STORED_ROUNDS = 25
SUMS = ("rows", "absolute", "squared", "target", "target2")
SCORES = "point int, fold int, " + ", ".join(f"{n} double" for n in SUMS)
BLOCK = "block int, fold binary, y binary, codes binary"


@dataclass
class Growing:
    """One tree of a model that holds out ``fold``; ``at`` numbers the model, or the tree."""

    at: int
    fold: int
    opened: list[int]
    waiting: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def grow(self, node: int, feature: int, cut: int, values: Sequence[float]) -> list[int]:
        """Cut ``node``; the numbers of its children."""
        child = len(self.feature)
        self.feature[node], self.cut[node], self.left[node] = feature, cut, child
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
            self.depth.append(self.depth[node] + 1)
        return [child, child + 1]

    def nodes(self) -> trees.Nodes:
        feature, cut, left = (np.array(c) for c in (self.feature, self.cut, self.left))
        value = np.array(self.value)
        return trees.Nodes(np.zeros(1, np.int64), feature, cut, left, left + 1, value)


def reached(nodes: trees.Nodes, codes: np.ndarray, depths: Sequence[int | None]) -> tuple:
    """Each row's last node, and its value where each depth (None: the end) ends the walk."""
    feature, cut, left, leaf = nodes.paths
    node, found, level = np.zeros(len(codes), np.intp), {}, 0
    by_column = codes.flags.f_contiguous
    flat = codes.ravel(order="F" if by_column else "C")
    row = np.arange(len(codes)) * (1 if by_column else codes.shape[1])
    while True:
        if level in depths:
            found[level] = nodes.value[node]
        if leaf.take(node).all():
            last = nodes.value[node] if len(depths) else None
            return node, np.array([found.get(d, last) for d in depths]).reshape(-1, len(codes))
        code = flat.take(row + feature.take(node) * (len(codes) if by_column else 1))
        node = left.take(node) + (code > cut.take(node))
        level += 1


# --- bins and blocks -----------------------------------------------------------


def fold_edges(
    rows: DataFrame, folds: Sequence[int], columns: Sequence[str]
) -> list[list[np.ndarray]]:
    """Cut values per held-out fold and column, as ``trees.binned`` has them.

    Columns of few values are cut between all of them, others at their quantiles.
    """
    columns, bits = list(columns), trees.BINS
    number = F.lit(0)
    for i, fold in enumerate(folds):
        number = F.when(F.col("fold") == fold, i).otherwise(number)
    values = written_table(
        quantiles.melted(rows.withColumn("held", number), columns, ["held"])
        .groupBy("metric", "value")
        .agg(F.bit_or(F.expr("shiftleft(1L, held)")).alias("mask")),
        "values",
    )
    trains = [
        F.col("mask").bitwiseAND(F.lit(~(1 << h))) != 0 for h in range(len(folds))
    ]
    counts = {
        r.metric: list(r)[1:]
        for r in values.groupBy("metric").agg(*[F.count_if(t) for t in trains]).collect()
    }
    edges = [[np.zeros(0) for _ in columns] for _ in folds]
    for h, trained in enumerate(trains):
        few = [c for c in columns if counts.get(c, [0] * len(folds))[h] <= bits]
        held: dict[str, list[float]] = {c: [] for c in few}
        for r in values.where(F.col("metric").isin(few) & trained).collect():
            held[r.metric].append(r.value)
        for c in few:
            x = np.sort(held[c])
            edges[h][columns.index(c)] = (x[1:] + x[:-1]) / 2
    many = [c for c in columns if max(counts.get(c, [0])) > bits]
    if many:
        others = F.filter(F.array(*[F.lit(f) for f in folds]), lambda f: f != F.col("fold"))
        marks = quantiles.exact_quantiles(
            rows.withColumn("held", F.explode(others)), many, np.arange(1, bits) / bits, ["held"]
        )
        found: dict[tuple, list[float]] = {}
        for r in marks.collect():
            found.setdefault((folds.index(r.held), r.metric), []).append(r.quantile)
        for (h, c), x in found.items():
            if counts[c][h] > bits:
                edges[h][columns.index(c)] = np.unique(x)
    return edges


def blocked(
    rows: DataFrame, edges: list, columns: Sequence[str], target: str, parts: int
) -> DataFrame:
    """``rows`` in blocks of arrays, codes once per held-out fold; stored."""
    width = len(columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if batches else None
        if table is None or not table.num_rows:
            return
        x = np.stack([table.column(2 + i).to_numpy() for i in range(width)], axis=1).astype(float)
        codes = np.stack([trees.coded(x, e) for e in edges]).astype(np.uint8)
        fold = table.column(0).to_numpy().astype(np.int32)
        y = table.column(1).to_numpy().astype(float)
        row = {"block": TaskContext.get().partitionId(), "fold": fold, "y": y, "codes": codes}
        yield batch_of([{k: v if k == "block" else v.tobytes() for k, v in row.items()}], BLOCK)

    dealt = rows.select("fold", target, *columns).repartition(parts)
    return written_table(dealt.mapInArrow(keep_empty(pack), BLOCK), "blocks")


def keep_empty(work):
    """``work`` on the batches of a task, if it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is not None:
            yield from work(b for some in ([first], batches) for b in some)

    return run


def batch_of(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "double": pa.float64(), "binary": pa.binary()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([r.get(n) for r in rows], kinds[t]) for n, t in fields], [n for n, _ in fields]
    )


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[SimpleNamespace]:
    """Blocks as arrays; ``state`` has a line per model, where there is one."""
    for batch in batches:
        for row in batch.to_pylist():
            y = np.frombuffer(row["y"])
            fold = np.frombuffer(row["fold"], np.int32)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, len(y), width)
            state = np.frombuffer(row.get("state") or b"").reshape(-1, len(y))
            yield SimpleNamespace(
                row=row, block=row["block"], y=y, fold=fold, codes=codes, state=state, outside={}
            )


# --- a level of many trees -------------------------------------------------------


def sent(df: DataFrame, growing: list[Growing]):
    """The trees as plain tuples: executors need no class of ours to read them."""
    return df.sparkSession.sparkContext.broadcast([astuple(tree) for tree in growing])


def training_codes(block: SimpleNamespace, h: int, fold: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and codes, column by column, of a block's rows outside a fold."""
    if h not in block.outside:
        rows = np.flatnonzero(block.fold != fold)
        block.outside[h] = rows, np.asfortranarray(block.codes[h][rows])
    return block.outside[h]


def open_nodes(tree: Growing, codes: np.ndarray) -> np.ndarray:
    """Position of each row's node among the open ones, -1 for another."""
    place = np.full(len(tree.feature), -1)
    place[tree.opened] = np.arange(len(tree.opened))
    return place[reached(tree.nodes(), codes, ())[0]]


def best_of_level(
    blocks: DataFrame, growing: list[Growing], folds: list[int], width: int, training, rules: list
) -> dict[int, tuple]:
    """Tree -> (gain, best, weight and total of all, and of the left side) per open node.

    ``training(block, tree, rows)`` gives weights (None: 1 a row) and targets; ``rules``
    hold a tree's least weight of a side, L2 term and greatest depth.
    """
    spark = blocks.sparkSession
    shared = sent(blocks, growing)
    schema = "slot int, payload binary"

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        now = [Growing(*t) for t in shared.value]
        for block in blocks_of(batches, width):
            for slot, tree in enumerate(now):
                if not tree.opened:
                    continue
                rows, codes = training_codes(block, folds.index(tree.fold), tree.fold)
                weight, target = training(block, tree, rows)
                local = open_nodes(tree, codes)
                total = target if weight is None else weight * target
                top = np.abs(target if weight is None else target[weight > 0]).max(initial=0.0)
                inside = local >= 0 if weight is None else (local >= 0) & (weight > 0)
                if not inside.all():
                    codes, total, local = codes[inside], total[inside], local[inside]
                    weight = None if weight is None else weight[inside]
                cells = trees.histogram(codes, weight, total, local, len(tree.opened))
                merge(sums, slot, top, cells)
        for slot, (top, cells) in sums.items():
            yield batch_of([{"slot": slot, "payload": pickle.dumps((top, cells))}], schema)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                merge(sums, row["slot"], *pickle.loads(row["payload"]))
        for slot, (top, cells) in sums.items():
            least, l2, _ = rules[slot]
            gain, best = trees.best_cuts(cells, least, l2, 1e-9 * max(1.0, top) ** 2)
            every = np.arange(len(best))
            whole = cells[:, :, 0].sum(axis=2)
            upto = cells.cumsum(axis=3)[:, every, best // trees.BINS, best % trees.BINS]
            found = pickle.dumps((gain, best, whole, upto))
            yield batch_of([{"slot": slot, "payload": found}], schema)

    parts = max(1, min(len(growing), spark.sparkContext.defaultParallelism))
    chosen = (
        blocks.mapInArrow(add_up, schema).repartition(parts, "slot").mapInArrow(choose, schema)
    )
    found = {r.slot: pickle.loads(r.payload) for r in chosen.collect()}
    shared.destroy()
    return found


def merge(sums: dict, slot: int, top: float, cells: np.ndarray) -> None:
    if slot in sums:
        sums[slot] = [max(top, sums[slot][0]), sums[slot][1] + cells]
    else:
        sums[slot] = [top, cells]


def grow_level(
    growing: list[Growing], found: dict[int, tuple], rules: list, place
) -> None:
    """Cut the open nodes; ``place(slot, depth, weight)`` says what becomes of a child."""
    for slot, tree in enumerate(growing):
        nodes, tree.opened = tree.opened, []
        if slot not in found:
            continue
        gain, best, whole, upto = found[slot]
        _, l2, deepest = rules[slot]
        for j, node in enumerate(nodes):
            weight, total = whole[:, j]
            tree.value[node] = total / max(weight + l2, 1e-300)
            if not gain[j] > 0 or deepest is not None and tree.depth[node] >= deepest:
                continue
            sides = [(upto[0, j], upto[1, j]), (weight - upto[0, j], total - upto[1, j])]
            cut = divmod(int(best[j]), trees.BINS)
            values = [s / max(w + l2, 1e-300) for w, s in sides]
            for child, (w, _) in zip(tree.grow(node, *cut, values), sides):
                kind = place(slot, tree.depth[child], w)
                if kind:
                    getattr(tree, kind).append(child)


def errors(point: int, fold: int, y: np.ndarray, predicted: np.ndarray, centre: float) -> dict:
    e, t = y - predicted, y - centre
    sums = (len(y), np.abs(e).sum(), e @ e, t.sum(), t @ t)
    return {"point": point, "fold": fold, **dict(zip(SUMS, map(float, sums)))}


def added_scores(scores: DataFrame) -> DataFrame:
    return scores.groupBy("point", "fold").agg(*[F.sum(n).alias(n) for n in SUMS])


# --- boosting ----------------------------------------------------------------------


def boosted_scores(
    blocks: DataFrame,
    points: Sequence[trees.BoostedPoint],
    folds: list[int],
    starts: dict[int, float],
    width: int,
    centre: float,
) -> DataFrame:
    """``SCORES`` of every point and fold; all of them take a round together."""
    models = [(i, fold) for i in range(len(points)) for fold in folds]
    rules = [(points[i].min_child, points[i].l2, points[i].max_depth) for i, _ in models]
    schema = BLOCK + ", state binary"

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, width):
            state = np.repeat([[starts[fold]] for _, fold in models], len(b.y), axis=1)
            yield batch_of([{**b.row, "state": state.tobytes()}], schema)

    def training(block, tree: Growing, rows: np.ndarray):
        return None, block.y[rows] - block.state[tree.at][rows]

    def place(slot: int, depth: int, weight: float) -> str | None:
        return "opened" if depth < points[models[slot][0]].max_depth else None

    state = blocks.mapInArrow(begin, schema)
    kept: list[DataFrame] = []
    for done in range(max(p.rounds for p in points)):
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(state)
        growing = [
            Growing(at, fold, [0] if done < points[i].rounds else [])
            for at, (i, fold) in enumerate(models)
        ]
        while any(tree.opened for tree in growing):
            found = best_of_level(state, growing, folds, width, training, rules)
            grow_level(growing, found, rules, place)
        while len(kept) > 1:
            kept.pop(0).unpersist()
        state = with_round(state, growing, [points[i] for i, _ in models], done, folds, width)
        if (done + 1) % STORED_ROUNDS == 0:
            state = written_table(state, "rounds")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, width):
            for at, (i, fold) in enumerate(models):
                own = b.fold == fold
                if own.any():
                    yield batch_of([errors(i, fold, b.y[own], b.state[at][own], centre)], SCORES)

    scores = written_table(added_scores(state.mapInArrow(score, SCORES)), "scores")
    for old in kept:
        old.unpersist()
    return scores


def with_round(
    state: DataFrame,
    growing: list[Growing],
    points: list[trees.BoostedPoint],
    done: int,
    folds: list[int],
    width: int,
) -> DataFrame:
    """Every row's predictions with this round's trees."""
    shared = sent(state, growing)
    schema = BLOCK + ", state binary"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [Growing(*t) for t in shared.value]
        for b in blocks_of(batches, width):
            after = b.state.copy()
            for slot, (tree, point) in enumerate(zip(now, points)):
                if done < point.rounds:
                    codes = b.codes[folds.index(tree.fold)]
                    after[slot] += point.learning_rate * reached(tree.nodes(), codes, (None,))[1][0]
            yield batch_of([{**b.row, "state": after.tobytes()}], schema)

    return state.mapInArrow(add, schema)


# --- forests -----------------------------------------------------------------------


def drawn(seed: int, fold: int, tree: int, block: int, sizes: dict[int, int]) -> np.ndarray:
    """How often each training row of a block is drawn, of as many draws as all have rows."""
    numbers = sorted(sizes)
    n = np.array([sizes[b] for b in numbers])
    shares = np.random.default_rng([seed, fold, tree]).multinomial(n.sum(), n / n.sum())
    own = shares[numbers.index(block)]
    picks = np.random.default_rng([seed, fold, tree, block]).integers(0, sizes[block], own)
    return np.bincount(picks, minlength=sizes[block]).astype(float)


def forest_scores(
    blocks: DataFrame,
    points: Sequence[trees.ForestPoint],
    folds: list[int],
    sizes: dict[int, dict[int, int]],
    width: int,
    centre: float,
    seed: int,
) -> DataFrame:
    """``SCORES`` of points that differ in depth only; ``sizes``: fold -> block -> its rows
    outside the fold."""
    spark = blocks.sparkSession
    depths = [p.max_depth for p in points]
    deepest = None if None in depths else max(depths)
    least, count = points[0].min_leaf, points[0].trees
    total = max(sum(s.values()) for s in sizes.values())
    step = int(min(CHUNK_TREES, count, max(1, CHUNK_ROWS // total)))
    cores = spark.sparkContext.defaultParallelism
    parts = max(2 * cores, len(folds) * step * total // (10 * LOCAL_ROWS))
    partial, sums = scratch_path(spark, "forest"), "block int, payload binary"

    def training(block, tree: Growing, rows: np.ndarray):
        if not len(rows):
            return np.zeros(0), np.zeros(0)
        return drawn(seed, tree.fold, tree.at, block.block, sizes[tree.fold]), block.y[rows]

    def place(slot: int, depth: int, weight: float) -> str | None:
        if deepest is not None and depth >= deepest:
            return None
        return "opened" if weight > LOCAL_ROWS else "waiting"

    for at in range(0, count, step):
        growing = [
            Growing(tree, fold, [0])
            for tree in range(at, min(at + step, count))
            for fold in folds
        ]
        rules = [(least, 0.0, deepest)] * len(growing)
        while any(tree.opened for tree in growing):
            found = best_of_level(blocks, growing, folds, width, training, rules)
            grow_level(growing, found, rules, place)
        routed = routed_rows(blocks, growing, depths, folds, width, training)
        ended = (
            routed.repartition(parts, "slot", "node")
            .groupBy("slot", "node")
            .applyInPandas(finisher(growing, depths, deepest, least), sums)
        )
        added = ended.repartition(cores, "block").mapInArrow(adder(len(points)), sums)
        added.write.mode("append").parquet(partial)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, SimpleNamespace] = {}
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["payload"] is None:
                    held[row["block"]] = SimpleNamespace(
                        fold=np.frombuffer(row["fold"], np.int32), y=np.frombuffer(row["y"])
                    )
                else:
                    values = np.frombuffer(row["payload"]).reshape(len(points), -1)
                    found[row["block"]] = found.get(row["block"], 0.0) + values
        for block, b in held.items():
            for fold in folds:
                own = b.fold == fold
                if own.any():
                    yield batch_of(
                        [
                            errors(i, fold, b.y[own], found[block][i][own] / count, centre)
                            for i in range(len(points))
                        ],
                        SCORES,
                    )

    known = blocks.select("block", "fold", "y", F.lit(None).cast("binary").alias("payload"))
    empty = F.lit(None).cast("binary")
    parted = spark.read.schema(sums).parquet(partial)
    both = known.unionByName(parted.select("block", empty.alias("fold"), empty.alias("y"), "payload"))
    return added_scores(both.repartition(cores, "block").mapInArrow(score, SCORES))


ROUTED = "slot int, node int, block int, payload binary"


def routed_rows(
    blocks: DataFrame, growing: list[Growing], depths: list, folds: list[int], width: int, training
) -> DataFrame:
    """Rows on their way to the nodes that wait; slot -1: predictions that are known here."""
    shared = sent(blocks, growing)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = [Growing(*t) for t in shared.value]
        for b in blocks_of(batches, width):
            known = np.zeros((len(depths), len(b.y)))
            for slot, tree in enumerate(now):
                nodes, codes = tree.nodes(), b.codes[folds.index(tree.fold)]
                rows, own = training_codes(b, folds.index(tree.fold), tree.fold)
                weight, target = training(b, tree, rows)
                held = np.flatnonzero(b.fold == tree.fold)
                at = np.where(weight > 0, reached(nodes, own, ())[0], -1)
                ends, values = reached(nodes, codes[held], depths)
                # A walk that goes on below a waiting node is not yet at its value.
                waits = np.isin(ends, tree.waiting)
                depth = np.array(tree.depth)[ends]
                for i, d in enumerate(depths):
                    open_ = waits if d is None else waits & (depth < d)
                    known[i, held] += np.where(open_, 0.0, values[i])
                for node in tree.waiting:
                    t, h = np.flatnonzero(at == node), np.flatnonzero(ends == node)
                    if len(t) or len(h):
                        load = (
                            codes[rows[t]], target[t], weight[t], held[h], codes[held[h]], len(b.y)
                        )
                        row = {"slot": slot, "node": node, "block": b.block}
                        yield batch_of([{**row, "payload": pickle.dumps(load)}], ROUTED)
            load = pickle.dumps((np.arange(len(b.y)), known, len(b.y)))
            row = {"slot": -1, "node": b.block, "block": b.block, "payload": load}
            yield batch_of([row], ROUTED)

    return blocks.mapInArrow(route, ROUTED)


def finisher(growing: list[Growing], depths: list, deepest: int | None, least: float):
    """Grows a waiting node's tree from all its training rows and scores its held-out rows."""
    depth_of = {(s, n): tree.depth[n] for s, tree in enumerate(growing) for n in tree.waiting}

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        slot, node = (int(k) for k in key)
        if slot < 0:
            return rows[["block", "payload"]]
        loads = [pickle.loads(p) for p in rows["payload"]]
        codes, target, weight = (np.concatenate([p[i] for p in loads]) for i in range(3))
        depth, single = depth_of[slot, node], np.zeros(len(target), np.int64)
        below = None if deepest is None else deepest - depth
        nodes = trees.grown(codes, target, weight, single, 1, below, least, 0.0)
        ends = [d if d is None else d - depth for d in depths]
        found = []
        for block, (*_, held, own, size) in zip(rows["block"], loads):
            if len(held):
                values = np.zeros((len(depths), size))
                some = reached(nodes, own, ends)[1]
                for i, d in enumerate(ends):
                    if d is None or d > 0:
                        values[i, held] = some[i]
                found.append((block, pickle.dumps((held, values[:, held], size))))
        return pd.DataFrame(found, columns=["block", "payload"])

    return finish


def adder(points: int):
    """Sums of predictions per block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                block, load = row["block"], row["payload"]
                held, values, size = pickle.loads(load)
                if block not in sums:
                    sums[block] = np.zeros((points, size))
                sums[block][:, held] += values
        for block, values in sums.items():
            yield batch_of([{"block": block, "payload": values.tobytes()}], "block int, payload binary")

    return add


# --- a grid --------------------------------------------------------------------------


def grid_scores(
    rows: DataFrame,
    points: Sequence[trees.ForestPoint | trees.BoostedPoint],
    folds: list[int],
    columns: Sequence[str],
    target: str,
    seed: int,
) -> Iterator[tuple[list, DataFrame]]:
    """(points, their ``SCORES``) of one set of points after the other: forests that share
    their trees, then all of boosting."""
    cores, width = rows.sparkSession.sparkContext.defaultParallelism, len(columns)
    means = {
        r.fold: (r.n, r.total)
        for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("total")).collect()
    }
    n, total = (sum(m[i] for m in means.values()) for i in range(2))
    parts = max(cores, -(-n // BLOCK_ROWS))
    blocks = blocked(rows, fold_edges(rows, folds, columns), columns, target, parts)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches, width):
            outside = [(fold, int((b.fold != fold).sum())) for fold in folds]
            yield batch_of(
                [{"block": b.block, "fold": f, "n": k} for f, k in outside if k], "block int, fold int, n int"
            )

    sizes: dict[int, dict[int, int]] = {fold: {} for fold in folds}
    for r in blocks.mapInArrow(count, "block int, fold int, n int").collect():
        sizes[r.fold][r.block] = r.n
    shared: dict[tuple, list] = {}
    for p in points:
        if isinstance(p, trees.ForestPoint):
            shared.setdefault((p.min_leaf, p.trees), []).append(p)
    fitted = [fold for fold in folds if sizes[fold]]
    if not fitted:
        return
    for some in shared.values():
        yield some, forest_scores(blocks, some, fitted, sizes, width, total / n, seed)
    boosted = [p for p in points if isinstance(p, trees.BoostedPoint)]
    if boosted:
        starts = {f: (total - means[f][1]) / (n - means[f][0]) for f in fitted}
        yield boosted, boosted_scores(blocks, boosted, fitted, starts, width, total / n)
