"""Ways over maps whose abstract graph is too large to broadcast: block by block, over the cells between entrances.

An edge inside a tile stands for a shortest way inside it, an edge between tiles for a step through an entrance. So the
cheapest way over the abstract graph is the shortest over cells whose steps stay in their tile or go through an entrance.
A block of tiles travels as the steps that its cells allow, a byte a cell, and no edge is ever made. Labels spread from
block to block in rounds: inside tasks while all blocks are few bytes, as tables beyond.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.geometry import STEPS
from gridloom.plans.checkpoints import bounded_batches, released, rewritten, written

#: Cells a side of a block, and how many queries a task gets with a block at most.
BLOCK, BLOCK_QUERIES = 512, 64
#: Cells that are flooded in one go.
CELLS = 1 << 22
#: Tables of up to so many queries are broadcast.
SMALL_ROWS = 100_000
#: Blocks of so many bytes in all are broadcast, and each query's rounds are made inside one task.
SMALL_BYTES = 8 << 20
#: Levels between two looks at which cells a flood can leave out.
PRUNED = 16
#: No bound yet.
FAR = 1 << 60
POINTS = "array<struct<x:bigint,y:bigint>>"
_KEY = ["map_id", "bx", "by"]
_BIT = {(dx, dy): 1 << k for k, (dx, dy, _) in enumerate(STEPS)}


def _block_of(column: str, side: int):
    return F.floor(F.col(column) / side).cast("long")


def step_blocks(masks: DataFrame, gates: DataFrame, size: int, side: int) -> DataFrame:
    """map_id, bx, by, steps: of each block (side a multiple of size) with an open cell the steps its cells allow, a byte a
    cell, in row order with a rim of one cell around the block. masks: of tiles; gates: entrances."""
    per = side // size
    bounded_batches(masks.sparkSession)
    tiles = masks.groupBy("map_id", _block_of("cx", per).alias("bx"), _block_of("cy", per).alias("by")).agg(F.collect_list(F.struct("cx", "cy", "mask")).alias("tiles"))
    right = F.col("side") == "H"
    bit = lambda here, there: F.when(right, _BIT[here]).otherwise(_BIT[there])
    ends = gates.select("map_id", F.inline(F.array(
        F.struct(F.col("a_x").alias("x"), F.col("a_y").alias("y"), bit((1, 0), (0, 1)).alias("bit")),
        F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y"), bit((-1, 0), (0, -1)).alias("bit")),
    )))
    ends = ends.groupBy("map_id", _block_of("x", side).alias("bx"), _block_of("y", side).alias("by")).agg(F.collect_list(F.struct("x", "y", "bit")).alias("ends"))

    def run(batches):
        for batch in batches:
            made = []
            for k in range(batch.num_rows):
                left, top = batch["bx"][k].as_py() * side, batch["by"][k].as_py() * side
                own = batch["tiles"].slice(k, 1).flatten()
                column = lambda table, c: table.field(c).to_numpy(zero_copy_only=False)
                cx, cy = column(own, "cx") - left // size, column(own, "cy") - top // size
                bits = np.frombuffer(b"".join(own.field("mask").to_pylist()), np.uint8).reshape(len(own), 2, -1)[:, 0]
                free = np.zeros((per, per, size, size), bool)
                free[cy, cx] = np.unpackbits(bits, axis=1)[:, : size * size].reshape(-1, size, size)
                free = free.transpose(0, 2, 1, 3).reshape(side, side)
                steps = np.zeros((side + 2, side + 2), np.uint8)
                at, same = steps[1:-1, 1:-1], np.arange(side - 1) % size != size - 1
                across, down = free[:, :-1] & free[:, 1:] & same, free[:-1] & free[1:] & same[:, None]
                at[:, :-1] |= across * np.uint8(_BIT[1, 0])
                at[:, 1:] |= across * np.uint8(_BIT[-1, 0])
                at[:-1] |= down * np.uint8(_BIT[0, 1])
                at[1:] |= down * np.uint8(_BIT[0, -1])
                own = batch["ends"].slice(k, 1).flatten()
                np.bitwise_or.at(at, (column(own, "y") - top, column(own, "x") - left), column(own, "bit").astype(np.uint8))
                made.append(steps.tobytes())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in _KEY], pa.array(made, pa.binary())], [*_KEY, "steps"])

    none = F.array().cast("array<struct<x:bigint,y:bigint,bit:int>>")
    both = tiles.join(ends, _KEY, "left").withColumn("ends", F.coalesce("ends", none))
    return both.select(*_KEY, "tiles", "ends").mapInArrow(run, "map_id string, bx bigint, by bigint, steps binary")


def spread(steps: np.ndarray, row: np.ndarray, cell: np.ndarray, d: np.ndarray, goal: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances and origins (row, cell; below 0 where there is no way) over steps (row, y, x) from entries (row, cell, d,
    any d of 0 or more), each row's own. Origins are numbers of entries. goal: (y, x) of each row. Cells that can't lie on
    a way to the goal of less than `most` may be left out."""
    n, _, wide = steps.shape
    area = wide * wide
    allowed = steps.reshape(-1)
    found, origin = np.full(n * area, -1, np.int32), np.full(n * area, -1, np.int32)
    ways = [(bit, dy * wide + dx) for (dx, dy), bit in _BIT.items()]
    order = np.lexsort((np.arange(len(d)), d))
    places, starts = (row * area + cell)[order], d[order]
    edge, level, at = places[:0], 0, 0
    bounded = bool((most < FAR).any())
    while len(edge) or at < len(starts):
        if not len(edge):
            level = int(starts[at])
        if at < len(starts) and starts[at] == level:
            to = int(np.searchsorted(starts, level, "right"))
            fresh = at + np.flatnonzero(found[places[at:to]] < 0)
            found[places[fresh]] = level
            origin[places[fresh]] = order[fresh]
            edge, at = np.concatenate([edge, places[fresh]]), to
        if bounded and level % PRUNED == 0:
            own = edge // area
            y, x = np.divmod(edge - own * area, wide)
            edge = edge[level + np.abs(y - goal[own, 0]) + np.abs(x - goal[own, 1]) < most[own]]
        level += 1
        can, reached = allowed[edge], []
        for bit, by in ways:
            before = edge[(can & bit) != 0]
            to = before + by
            new = found[to] < 0
            to = to[new]
            found[to] = level
            origin[to] = origin[before[new]]
            reached.append(to)
        edge = np.concatenate(reached)
    return found.reshape(n, area), origin.reshape(n, area)


def _jobs(batches, side: int):
    """Searches to be made in one go: of each its block's corner, its steps, and the rows of its query; with the columns of
    all rows and each row's search."""
    area = (side + 2) ** 2
    most = max(1, CELLS // area)
    for batch in batches:
        rows = batch["rows"].flatten()
        column = {f.name: rows.field(f.name).to_numpy(zero_copy_only=False) for f in rows.type}
        parent = np.repeat(np.arange(batch.num_rows), batch["rows"].value_lengths().to_numpy())
        # A search for each block and job.
        jobs, of = np.unique(np.stack([parent, column["job"]], axis=1), axis=0, return_inverse=True)
        of = of.reshape(-1)
        order = np.argsort(of, kind="stable")
        bounds = np.searchsorted(of[order], np.arange(0, len(jobs) + most, most))
        for k, at in enumerate(range(0, len(jobs), most)):
            part = order[bounds[k] : bounds[k + 1]]
            block = jobs[at : at + most, 0]
            there, which = np.unique(block, return_inverse=True)
            steps = np.frombuffer(b"".join(batch["steps"][i].as_py() for i in there.tolist()), np.uint8).reshape(len(there), side + 2, side + 2)[which.reshape(-1)]
            corner = np.stack([batch[c].to_numpy()[block] * side - 1 for c in ("bx", "by")], axis=1)
            maps = batch["map_id"].take(pa.array(block))
            yield maps, corner, steps, of[part] - at, {c: v[part] for c, v in column.items()}


_LABEL = ["query_id", "map_id", "gx", "gy", "x", "y", "d", "from_x", "from_y"]


def _onward(corner: np.ndarray, steps: np.ndarray, of: np.ndarray, c: dict, side: int) -> tuple[np.ndarray, ...]:
    """Labels (entries of blocks, of: each one's search) spread to the first cells behind their block's entrances, and to
    the goal: of each the search, x, y, d and the entry it comes from."""
    wide = side + 2
    rim = np.concatenate([np.arange(wide), np.arange(wide) + wide * (wide - 1), np.arange(1, wide - 1) * wide, np.arange(1, wide - 1) * wide + wide - 1])
    first = np.unique(of, return_index=True)[1]
    base = np.full(len(corner), FAR, np.int64)
    np.minimum.at(base, of, c["d"])
    gx, gy = c["gx"][first], c["gy"][first]
    goal = np.stack([gy - corner[:, 1], gx - corner[:, 0]], axis=1)
    most = np.where(c["most"][first] < FAR, c["most"][first] - base, FAR)
    cell = (c["y"] - corner[of, 1]) * wide + c["x"] - corner[of, 0]
    found, origin = spread(steps, of, cell, c["d"] - base[of], goal, most)
    inside = np.flatnonzero(((goal >= 1) & (goal <= side)).all(axis=1))
    row, k = np.nonzero(found[:, rim] >= 0)
    row, at = np.concatenate([row, inside]), np.concatenate([rim[k], goal[inside, 0] * wide + goal[inside, 1]])
    d = found[row, at]
    y, x = np.divmod(at, wide)
    d, x, y, entry = d + base[row], x + corner[row, 0], y + corner[row, 1], origin[row, at]
    # A goal that is an entry itself has its label already.
    kept = (found[row, at] >= 0) & ((c["x"][entry] != x) | (c["y"][entry] != y)) & (d + np.abs(x - gx[row]) + np.abs(y - gy[row]) < most[row] + base[row])
    return row[kept], x[kept], y[kept], d[kept], entry[kept]


def _labels(side: int):
    """A round of labels, block by block."""

    def run(batches):
        for maps, corner, steps, of, c in _jobs(batches, side):
            row, x, y, d, entry = _onward(corner, steps, of, c, side)
            columns = [c["job"][entry], c["gx"][entry], c["gy"][entry], x, y, d, c["x"][entry], c["y"][entry]]
            query_id, *rest = (pa.array(v, pa.int64()) for v in columns)
            yield pa.RecordBatch.from_arrays([query_id, maps.take(pa.array(row)), *rest], _LABEL)

    return run


def _ways(corner: np.ndarray, steps: np.ndarray, c: dict, side: int, size: int) -> list[list[dict]]:
    """Of each hop the cells at entrances on a shortest way from the entry (x, y) to (gx, gy), inside the block or a step
    behind it."""
    wide = side + 2
    goal = np.stack([c["gy"] - corner[:, 1], c["gx"] - corner[:, 0]], axis=1)
    cell = (c["y"] - corner[:, 1]) * wide + c["x"] - corner[:, 0]
    found, _ = spread(steps, np.arange(len(cell)), cell, np.zeros(len(cell), np.int64), goal, c["most"])
    ways = []
    for k in range(len(cell)):
        own, allowed = found[k], steps[k].reshape(-1)
        at, way = int(goal[k, 0] * wide + goal[k, 1]), []
        while True:
            way.append(at)
            if own[at] == 0:
                break
            at = next(p for (dx, dy), bit in _BIT.items() if 0 <= (p := at - dy * wide - dx) < len(own) and own[p] == own[at] - 1 and allowed[p] & bit)
        y, x = np.divmod(np.array(way[::-1]), wide)
        x, y = x + corner[k, 0], y + corner[k, 1]
        over = (np.diff(x // size) != 0) | (np.diff(y // size) != 0)
        kept = np.append(over, False) | np.append(False, over)
        ways.append([{"x": int(u), "y": int(v)} for u, v in zip(x[kept], y[kept], strict=True)])
    return ways


_POINT = pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))


def _retraced(side: int, size: int):
    """The ways of hops, block by block."""

    def run(batches):
        for maps, corner, steps, of, c in _jobs(batches, side):
            # A search has one hop.
            back = np.argsort(of)
            c = {name: v[back] for name, v in c.items()}
            yield pa.RecordBatch.from_arrays([pa.array(c["query_id"]), maps, pa.array(c["seq"]), pa.array(_ways(corner, steps, c, side, size), _POINT)], ["query_id", "map_id", "seq", "nodes"])

    return run


class _Blocks:
    """All blocks of a map: their steps, with corners that count the rim, and which block a cell is in."""

    def __init__(self, bx: np.ndarray, by: np.ndarray, steps: list[bytes], side: int):
        self.side, self.wide = side, side + 2
        self.area = self.wide**2
        self.across = int(bx.max()) + 1
        order = np.argsort(by * self.across + bx)
        bx, by = bx[order], by[order]
        self.keys = by * self.across + bx
        self.corner = np.stack([bx, by], axis=1) * side - 1
        self.steps = np.frombuffer(b"".join(steps[k] for k in order.tolist()), np.uint8).reshape(-1, self.wide, self.wide)

    def numbers(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of each cell its place among the cells of all blocks, below 0 if it is in none."""
        bx, by = x // self.side, y // self.side
        key = by * self.across + bx
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        cell = (y - self.corner[k, 1]) * self.wide + x - self.corner[k, 0]
        return np.where((self.keys[k] == key) & (bx >= 0) & (bx < self.across), k * self.area + cell, -1)

    def places(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k, cell = np.divmod(number, self.area)
        y, x = np.divmod(cell, self.wide)
        return x + self.corner[k, 0], y + self.corner[k, 1]

    def parts(self, block: np.ndarray):
        """Slices of searches (of each its block) that are flooded in one go, with corners and steps."""
        most = max(1, CELLS // self.area)
        for at in range(0, len(block), most):
            own = block[at : at + most]
            yield at, at + len(own), self.corner[own], self.steps[own]

    def solve(self, sx: np.ndarray, sy: np.ndarray, gx: np.ndarray, gy: np.ndarray, size: int):
        """The cost and the cells at entrances of each query's way, or None. As in the rounds over tables, but only labels
        whose least cost is within a block's side of their query's least spread in a round; the others wait."""
        n, cells = len(sx), len(self.steps) * self.area
        start, goal = self.numbers(sx, sy), self.numbers(gx, gy)
        lowest, before = np.full(n * cells, _NONE, np.int32), np.full(n * cells, -1, np.int32)
        todo = np.flatnonzero((start >= 0) & (goal >= 0))
        own = todo * cells
        lowest[own + start[todo]] = 0
        # Labels are numbered by query, block and cell.
        todo = own + start[todo]
        while len(todo):
            query, at = np.divmod(todo, cells)
            x, y = self.places(at)
            best = lowest[query * cells + goal[query]].astype(np.int64)
            least = lowest[todo] + np.abs(x - gx[query]) + np.abs(y - gy[query])
            kept = (at != goal[query]) & (least < best)
            first = np.full(n, FAR, np.int64)
            np.minimum.at(first, query[kept], least[kept])
            now = kept & (least <= first[query] + self.side)
            later = todo[kept & ~now]
            # Labels of a block lie together.
            todo, query, at, x, y, best = todo[now], query[now], at[now], x[now], y[now], best[now]
            jobs, of = np.unique(todo // self.area, return_inverse=True)
            c = {"x": x, "y": y, "d": lowest[todo].astype(np.int64), "gx": gx[query], "gy": gy[query], "most": np.where(best < _NONE, best, FAR)}
            found = []
            for a, b, corner, steps in self.parts(jobs % len(self.steps)):
                part = slice(*np.searchsorted(of, [a, b]))
                row, u, v, d, entry = _onward(corner, steps, of[part] - a, {name: w[part] for name, w in c.items()}, self.side)
                came = entry + part.start
                found.append((query[came] * cells + self.numbers(u, v), d, at[came]))
            to, d, came = (np.concatenate(v) if found else np.zeros(0, np.int64) for v in (list(zip(*found, strict=True)) or [()] * 3))
            order = np.lexsort((came, d, to))
            to, d, came = to[order], d[order], came[order]
            fell = (np.diff(to, prepend=-1) != 0) & (d < lowest[to])
            to, d, came = to[fell], d[fell], came[fell]
            lowest[to], before[to] = d, came
            todo = np.union1d(later, to)
        return [self._way(lowest[k * cells : (k + 1) * cells], before[k * cells : (k + 1) * cells], int(goal[k]), size) if start[k] >= 0 and goal[k] >= 0 else None for k in range(n)]

    def _way(self, lowest: np.ndarray, before: np.ndarray, goal: int, size: int):
        if lowest[goal] == _NONE:
            return None
        chain = [goal]
        while before[chain[-1]] >= 0:
            chain.append(int(before[chain[-1]]))
        at = np.array(chain[::-1])
        (x, y), nodes = self.places(at), []
        c = {"x": x[:-1], "y": y[:-1], "gx": x[1:], "gy": y[1:], "most": np.diff(lowest[at]).astype(np.int64) + 1}
        for a, b, corner, steps in self.parts(at[:-1] // self.area):
            for way in _ways(corner, steps, {name: v[a:b] for name, v in c.items()}, self.side, size):
                nodes += way
        return int(lowest[goal]), nodes


#: No label yet; costs are below the number of cells.
_NONE = np.iinfo(np.int32).max


def _solve_in_tasks(blocks: DataFrame, start: DataFrame, side: int, size: int, tasks: int) -> DataFrame:
    """solve() for blocks of few bytes: they are broadcast, and a query's rounds are made inside one task."""
    table = blocks.select("map_id", "bx", "by", "steps").toArrow()
    of = np.array(table["map_id"].to_pylist(), object)
    steps = table["steps"].to_pylist()
    own = {m: np.flatnonzero(of == m) for m in set(of.tolist())}
    raw = {m: _Blocks(table["bx"].to_numpy()[k], table["by"].to_numpy()[k], [steps[i] for i in k.tolist()], side) for m, k in own.items()}
    shared = blocks.sparkSession.sparkContext.broadcast(raw)
    del table, steps, raw
    released(blocks.sparkSession)
    names = ["query_id", "map_id", "cost", "nodes"]

    def run(batches):
        for batch in batches:
            todo = np.array(batch["map_id"].to_pylist(), object)
            column = {c: batch[c].to_numpy() for c in ("query_id", "sx", "sy", "gx", "gy")}
            out = []
            for map_id in sorted(set(todo.tolist()) & set(shared.value)):
                there, mine = shared.value[map_id], np.flatnonzero(todo == map_id)
                most = max(1, CELLS // there.steps.size)
                for at in range(0, len(mine), most):
                    k = mine[at : at + most]
                    found = there.solve(*(column[c][k] for c in ("sx", "sy", "gx", "gy")), size)
                    out += [(int(q), map_id, *way) for q, way in zip(column["query_id"][k], found, strict=True) if way]
            columns = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.string(), pa.int64(), _POINT), strict=True)], names)

    # Few rows, but long searches: dealt out evenly.
    return start.repartitionByRange(tasks, "query_id", "map_id").mapInArrow(run, f"query_id bigint, map_id string, cost bigint, nodes {POINTS}")


def _chains(batches):
    """Of each query's labels the hops from entry to entry that lead to its goal."""
    names = ["query_id", "map_id", "seq", "x", "y", "gx", "gy", "n"]
    for batch in batches:
        out = []
        for query_id, map_id, goal, labels in zip(*(batch[c].to_pylist() for c in ("query_id", "map_id", "goal", "labels")), strict=True):
            known = {(r["x"], r["y"]): r for r in labels}
            at = known[goal["x"], goal["y"]]
            hops = []
            while at["from_x"] is not None:
                before = known[at["from_x"], at["from_y"]]
                hops.append((before["x"], before["y"], at["x"], at["y"], at["d"] - before["d"]))
                at = before
            out += [(query_id, map_id, k, *hop) for k, hop in enumerate(reversed(hops))]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.string() if c == "map_id" else pa.int64()) for c, v in zip(names, columns, strict=True)], names)


def solve(masks: DataFrame, gates: DataFrame, queries: DataFrame, size: int, block: int = BLOCK) -> DataFrame:
    """query_id, map_id, cost, nodes (cells at entrances on the way) of queries (query_id, map_id, sx, sy, gx, gy); no row
    if there is no way or it begins where it ends.

    Blocks have about `block` cells a side, whole tiles. In every round the labels that came into a block spread through it
    in one search, so rounds follow the blocks that ways cross. A label says from which entry it comes; those that can't
    lead to less than a query's best cost go no further. While the blocks have up to SMALL_BYTES, rounds are made inside
    tasks; beyond, each round writes all labels, which replace those before.
    """
    side = max(1, block // size) * size
    spark = masks.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    blocks = rewritten(step_blocks(masks, gates, size, side))
    moved = queries.where("sx <> gx OR sy <> gy")
    if blocks.count() * (side + 2) ** 2 <= SMALL_BYTES:
        return _solve_in_tasks(blocks, moved.select("query_id", "map_id", "sx", "sy", "gx", "gy"), side, size, 2 * tasks)
    place = ["query_id", "map_id", "gx", "gy", "x", "y"]
    none = F.lit(None).cast("long")
    start = moved.select("query_id", "map_id", "gx", "gy", F.col("sx").alias("x"), F.col("sy").alias("y"))
    known = rewritten(start.withColumns({"d": F.lit(0).cast("long"), "from_x": none, "from_y": none, "step": F.lit(0)}))
    n = known.count()
    few = F.broadcast if n <= SMALL_ROWS else lambda df: df
    # Enough lists for all tasks, but not a block for each query.
    per = min(BLOCK_QUERIES, max(1, n // (2 * tasks), (1 << 20) // side**2))
    at_goal = "x = gx AND y = gy"
    least = F.col("d") + F.abs(F.col("x") - F.col("gx")) + F.abs(F.col("y") - F.col("gy"))

    def beside_blocks(rows, lists):
        dealt = rows.select("map_id", _block_of("x", side).alias("bx"), _block_of("y", side).alias("by"), F.pmod(F.xxhash64("job"), F.lit(lists)).alias("list"), F.struct(*[c for c in rows.columns if c != "map_id"]).alias("row"))
        own = dealt.groupBy(*_KEY, "list").agg(F.collect_list("row").alias("rows")).join(blocks, _KEY).repartition(tasks, *_KEY, "list")
        return own.select(*_KEY, "rows", "steps")

    def best_of(labels):
        return labels.where(at_goal).select("query_id", "map_id", F.col("d").alias("most"))

    of_label = ", ".join(f"{c} {'string' if c == 'map_id' else 'bigint'}" for c in _LABEL)
    step = 0
    while not known.where(f"step = {step}").isEmpty():
        fresh = known.where(f"step = {step} AND NOT ({at_goal})")
        fresh = fresh.join(few(best_of(known)), ["query_id", "map_id"], "left").where(F.col("most").isNull() | (least < F.col("most")))
        entries = fresh.select("map_id", F.col("query_id").alias("job"), "gx", "gy", "x", "y", "d", F.coalesce("most", F.lit(FAR)).alias("most"))
        step += 1
        reached = beside_blocks(entries, -(-n // per)).mapInArrow(_labels(side), of_label).withColumn("step", F.lit(step))
        lowest = known.unionByName(reached).groupBy(*place).agg(F.min(F.struct("d", "step", "from_x", "from_y")).alias("best"))
        known = rewritten(lowest.select(*place, "best.*"))
    best = rewritten(best_of(known))
    # Labels on a best way, few others.
    near = known.join(few(best), ["query_id", "map_id"]).where(least <= F.col("most"))
    chains = near.groupBy("query_id", "map_id").agg(F.first(F.struct(F.col("gx").alias("x"), F.col("gy").alias("y"))).alias("goal"), F.collect_list(F.struct("x", "y", "d", "from_x", "from_y")).alias("labels"))
    hops = chains.select("query_id", "map_id", "goal", "labels").mapInArrow(_chains, "query_id bigint, map_id string, seq bigint, x bigint, y bigint, gx bigint, gy bigint, n bigint")
    hops = written(hops.select("query_id", "map_id", "seq", "x", "y", "gx", "gy", (F.col("n") + 1).alias("most"), F.xxhash64("query_id", "seq").alias("job")))
    nodes = beside_blocks(hops, -(-n // per)).mapInArrow(_retraced(side, size), f"query_id bigint, map_id string, seq bigint, nodes {POINTS}")
    whole = nodes.groupBy("query_id", "map_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "nodes"))), lambda s: s["nodes"])).alias("nodes"))
    return best.join(whole, ["query_id", "map_id"]).select("query_id", "map_id", F.col("most").alias("cost"), "nodes")
