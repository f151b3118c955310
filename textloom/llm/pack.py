"""Problem 7: fill containers of fixed capacity with items, dividing only items above the capacity.

Lengths are whole numbers up to the capacity C, so the histogram of lengths has at most C rows however
many items there are. Everything that is decided globally is decided on that histogram, on the
driver, in space that depends on C alone:

1. *Linear grouping.* Lengths above ``small * C`` are cut into groups of equal cardinality and rounded
   up to their group's largest length, which leaves few sizes.
2. *Configurations.* The linear programme over the ways to fill one container with those sizes is
   solved by column generation (revised simplex; each new column is a knapsack); its floor gives how
   often each configuration is used, and what the floor leaves open is placed with the small items.
3. *Substitution.* The slots of a group are filled with its actual items in order of length. All
   containers of one configuration in which each slot has the same actual length form one class,
   so containers are kept as (first id, how many, free room), of which there are few.
4. *Best fit.* All other items, longest first, go where they leave the least room free, class by class; a
   step splits one class at most.

The plan is a list of rules (length, ranks from-to, first container, items a container). Items are
ranked within their length without a global sort, and a join with the rules - their number depends
on C only, and is checked before the broadcast - gives each its container.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.session import cut_lineage

GROUPS = 40  # sizes after rounding
SMALL = 0.08  # lengths up to this share of the capacity are left to best fit
MAX_RULES = 2_000_000  # beyond it the join is not broadcast
RANK_BLOCK = 500_000  # rows that one task ranks


@dataclass(frozen=True)
class Rule:
    """Items of ``length`` ranked first..first+count-1 go to containers from ``container`` on, ``per`` to each."""

    length: int
    first: int
    count: int
    container: int
    per: int


def linear_groups(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths, longest first, in ``groups`` groups of equal cardinality: lists of (length, count). A length
    whose items cross a border is shared between the groups."""
    total = sum(counts.values())
    if not total:
        return []
    edges = [total * (g + 1) // groups for g in range(groups)]
    out, cur, seen, g = [], [], 0, 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = edges[g] - seen
            if room == 0:
                if cur:
                    out.append(cur)
                cur, g = [], g + 1
                continue
            take = min(left, room)
            cur.append((length, take))
            left, seen = left - take, seen + take
    return [*out, cur] if cur else out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """How often to use each way of filling a container: the floor of the linear programme's solution
    by column generation. sizes: descending; demand: items of each size."""
    n = len(sizes)
    if not n:
        return []
    columns = [tuple((capacity // s) * (i == j) for j in range(n)) for i, s in enumerate(sizes)]
    basis = np.diag([float(capacity // s) for s in sizes])
    b = np.array(demand, float)
    inverse = np.linalg.inv(basis)
    for step in range(rounds):
        duals = inverse.sum(axis=0)  # every container costs 1
        column = _knapsack(sizes, duals, capacity)
        if duals @ column <= 1 + 1e-9:
            break
        x, d = inverse @ b, inverse @ column
        ratio = np.where(d > 1e-12, x / np.where(d > 1e-12, d, 1), np.inf)
        leave = int(np.argmin(ratio))
        columns[leave] = tuple(int(v) for v in column)
        basis[:, leave] = column
        if step % 20 == 19:
            inverse = np.linalg.inv(basis)
        else:  # one Gauss-Jordan step
            pivot = inverse[leave] / d[leave]
            inverse = inverse - np.outer(d, pivot)
            inverse[leave] = pivot
    x = np.linalg.solve(basis, b)
    return [(c, int(times)) for c, v in zip(columns, x, strict=True) if (times := int(np.floor(v + 1e-6))) > 0]


def _knapsack(sizes: list[int], value: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable filling of one container, item by item over every room at once."""
    most = capacity // min(sizes)
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):
            if value[i] > 1e-12:
                with_it = best[:-s] + value[i]
                won = with_it > new[s:] + 1e-12
                new[s:][won], pick[s:][won] = with_it[won], i
        if not (pick >= 0).any():
            break
        picks.append(pick)
        best = new
    column, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if (i := pick[room]) >= 0:
            column[i] += 1
            room -= sizes[i]
    return column


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> tuple[list[Rule], int]:
    """Rules that place every item of the histogram, and the number of containers used."""
    rules: list[Rule] = []
    rank: dict[int, int] = {}  # next free rank of each length
    rooms: dict[int, list[tuple[int, int]]] = {}  # free room -> (first container, how many)
    order: list[int] = []  # the free rooms, ascending
    used = 0

    def offer(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in rooms:
                bisect.insort(order, room)
                rooms[room] = []
            rooms[room].append((first, many))

    def place(length: int, many: int, container: int, per: int) -> None:
        rules.append(Rule(length, rank.get(length, 0), many, container, per))
        rank[length] = rank.get(length, 0) + many

    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    if 0 in counts and counts[0]:
        rules.append(Rule(0, 0, counts[0], 0, counts[0]))
    full = left.pop(capacity, 0)
    if full:
        place(capacity, full, used, 1)
        used += full

    runs = linear_groups({n: c for n, c in left.items() if n > small * capacity}, groups)
    sizes: dict[int, list[list[int]]] = {}  # rounded size -> runs [length, count] of the groups with that size
    for g in runs:
        sizes.setdefault(g[0][0], []).extend([list(x) for x in g])
    order_of = sorted(sizes, reverse=True)
    for column, times in configurations(order_of, [sum(c for _, c in sizes[s]) for s in order_of], capacity):
        slots = [s for s, k in zip(order_of, column, strict=True) for _ in range(k)]
        taken = []  # for each slot, runs of actual lengths along the containers
        for s in slots:
            need, own = times, []
            while need:
                run = sizes[s][0]
                n = min(need, run[1])
                own.append((run[0], n))
                run[1] -= n
                need -= n
                if not run[1]:
                    sizes[s].pop(0)
            taken.append(own)
            at = used
            for length, n in own:
                place(length, n, at, 1)
                left[length] -= n
                at += n
        edges = sorted({0, times, *(e for own in taken for e in np.cumsum([n for _, n in own]).tolist())})
        ends = [(np.cumsum([n for _, n in own]), [x for x, _ in own]) for own in taken]
        for lo, hi in zip(edges, edges[1:], strict=False):
            filled = sum(lengths[int(np.searchsorted(cum, lo, "right"))] for cum, lengths in ends)
            offer(capacity - filled, used + lo, hi - lo)
        used += times

    for length in sorted(left, reverse=True):
        many = left[length]
        while many:
            at = bisect.bisect_left(order, length)
            if at == len(order):  # no room anywhere: open new containers
                per = capacity // length
                n = -(-many // per)
                offer(capacity, used, n)
                used += n
                continue
            room = order[at]
            first, have = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(at)
            per = room // length
            whole = min(have, many // per)
            if whole:
                place(length, whole * per, first, per)
                offer(room - per * length, first, whole)
                many -= whole * per
            rest = have - whole
            if rest and many and many < per:
                place(length, many, first + whole, many)
                offer(room - many * length, first + whole, 1)
                many, whole, rest = 0, whole + 1, rest - 1
            offer(room, first + whole, rest)
    return rules, used


def parts(items: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """(id, part_no, first_token, n_tokens): one part an item; an item above the capacity is divided
    into full parts and a rest. Null sizes count as 0; an item of size 0 has one part of size 0."""
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    last = F.greatest(F.ceil(size / F.lit(capacity)).cast("int") - 1, F.lit(0))
    return (
        items.select(F.col(id_col), size.alias("__size"), F.explode(F.sequence(F.lit(0), last)).alias("part_no"))
        .withColumn("first_token", F.col("part_no").cast("long") * capacity)
        .select(id_col, "part_no", "first_token", F.least(F.lit(capacity), F.col("__size") - F.col("first_token")).cast("int").alias("n_tokens"))
    )


def fill_containers(items: DataFrame, id_col: str, size_col: str, capacity: int, *, groups: int = GROUPS, small: float = SMALL) -> DataFrame:
    """(id, part_no, first_token, n_tokens, container): every part of every item with its container.

    No container holds more than ``capacity``. Items of size 0 or null take no room and go to container 0.
    Rows with the same id are items of their own; equal lengths are interchangeable, so ties in the
    ids only decide which of the equal items stands first. An empty table gives an empty result.
    """
    spark = items.sparkSession
    rows = cut_lineage(parts(items, id_col, size_col, capacity))
    histogram = {r["n_tokens"]: r["count"] for r in rows.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    rules, _ = plan(histogram, capacity, groups, small)
    table = spark.createDataFrame(
        [(r.length, r.first, r.count, r.container, r.per) for r in rules],
        "n_tokens int, __first long, __count long, __container long, __per long",
    )
    if len(rules) <= MAX_RULES:
        table = F.broadcast(table)

    blocks = max(1, -(-sum(histogram.values()) // RANK_BLOCK))
    rows = rows.withColumn("__block", F.pmod(F.xxhash64(id_col, "part_no"), F.lit(blocks)))
    sizes = rows.groupBy("n_tokens", "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("n_tokens").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("n_tokens", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("n_tokens", "__block").orderBy(id_col, "part_no")
    ranked = rows.withColumn("__rn", F.row_number().over(within) - 1).join(starts, ["n_tokens", "__block"]).withColumn("__rank", F.col("__start") + F.col("__rn"))
    hit = (F.col("__rank") >= F.col("__first")) & (F.col("__rank") < F.col("__first") + F.col("__count"))
    return (
        ranked.join(table.withColumnRenamed("n_tokens", "__length"), (F.col("n_tokens") == F.col("__length")) & hit)
        .withColumn("container", F.col("__container") + F.floor((F.col("__rank") - F.col("__first")) / F.col("__per")))
        .select(id_col, "part_no", "first_token", "n_tokens", "container")
    )
