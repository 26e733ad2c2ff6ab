"""Problem 5: a sample that matches target category proportions.

Cube method.  Inclusion probabilities are fitted to the targets (iterative proportional fitting on the
table of category cells, minimums first).  A flight phase then moves them to 0 or 1 along
directions that keep all category sums:

* inside a part (units with equal hashes, so that neither partitions nor batches decide on the sample), units of the same
  cell are exchanged with each other (their indicators are equal, so all sums stay), which leaves one open unit per cell; open
  units of one dimension fly on together;
* what is still open merges upward in groups of bounded size, per dimension over ever more partitions, then over
  all dimensions;
* the landing gives up constraints one by one, the last of them first, and resolves the rest.

A target that the landed sample misses is checked against the rows that there are: those it can't be met with are reported as
unreachable, the others as residuals.

Only open units move upward, at most one per constraint and dimension after a flight.  The table of cells is bounded by the targets (values without a target count as one rest value).

Defined results: case, width and surrounding blanks of values, order and repetition of letters don't matter.  A
``sample_id`` counts once, with the values of its first row; a null or blank ``sample_id`` is left out.  Missing values
are a rest value of their field.  With no rows or no targets nothing is drawn.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.values import category, letter_set, strip
from sievework.session import cut

FIELDS = ("question_type", "dimension", "gold_letters")
FRACTION = 0.1
#: Open units that a group should have when they merge upward; a flight leaves a few dozen of them.
GROUP = 2000
#: Units of a part of the first flight.
PART = 20_000


def plain_rows(rows: DataFrame) -> DataFrame:
    """``(split_row_id, sample_id, question_type, dimension, gold_letters)`` in one spelling."""
    sid = strip(F.col("sample_id"))
    return rows.select(
        "split_row_id",
        F.when(sid != "", sid).alias("sample_id"),
        category(F.col("question_type")).alias("question_type"),
        category(F.col("dimension")).alias("dimension"),
        letter_set(F.col("gold_letters")).alias("gold_letters"),
    ).where("sample_id IS NOT NULL")


def plain_targets(targets: DataFrame) -> DataFrame:
    letters = letter_set(F.split(F.col("field_value"), ","))
    value = F.when(F.col("field_name") == "gold_letters", letters).otherwise(category(F.col("field_value")))
    return targets.select("target_id", "field_name", value.alias("value"), "target_permille", "min_rows")


def _flight(x: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves probabilities to 0 or 1 keeping ``x.T @ p`` until no direction is left; x has few columns."""
    p, eps = p.copy(), 1e-9
    open_ = np.flatnonzero((p > eps) & (p < 1 - eps))
    used = np.flatnonzero(np.any(x[open_] != 0, axis=0))
    width = len(used) + 1
    block, rest = list(open_[:width]), list(open_[width:])
    while block:
        a = x[np.ix_(block, used)].T
        u = np.linalg.svd(a, full_matrices=True)[2][-1]
        if np.abs(a @ u).max(initial=0.0) > 1e-8:
            break  # as many independent constraints as units
        q = p[block]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 1e-12, (1 - q) / u, np.where(u < -1e-12, -q / u, np.inf)).min()
            down = np.where(u > 1e-12, q / u, np.where(u < -1e-12, (q - 1) / u, np.inf)).min()
        q = q + up * u if rng.random() * (up + down) < down else q - down * u
        q[q < eps], q[q > 1 - eps] = 0.0, 1.0
        p[block] = q
        block = [b for b in block if 0 < p[b] < 1]
        while rest and len(block) < width:
            block.append(rest.pop(0))
    return p


def _exchange(cell: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Within each cell (sorted), all but one unit to 0 or 1, keeping the cell's sum: a random systematic order."""
    p = p.copy()
    for lo, hi in zip(*(lambda c: (np.r_[0, c], np.r_[c, len(cell)]))(np.flatnonzero(np.diff(cell)) + 1)):
        ends = np.cumsum(p[lo:hi])
        whole = int(np.floor(ends[-1] + 1e-9))
        left = ends[-1] - whole
        taken = np.zeros(hi - lo)
        start = rng.random() * min(1.0, ends[-1] / max(whole, 1)) if whole else 0.0
        picks = start + np.arange(whole) * (ends[-1] / max(whole, 1))
        taken[np.minimum(np.searchsorted(ends, picks, side="right"), hi - lo - 1)] = 1
        short = whole - int(taken.sum())
        for i in np.flatnonzero(taken == 0)[:short]:
            taken[i] = 1
        free = np.flatnonzero(taken == 0)
        if left > 1e-9 and len(free):
            taken[free[rng.integers(len(free))]] = left
        p[lo:hi] = taken
    return p


def _indicators(units: pd.DataFrame, columns: dict[tuple[str, str], int]) -> np.ndarray:
    x = np.zeros((len(units), len(columns) + 1))
    x[:, 0] = 1  # the sample size
    for f in FIELDS:
        for i, v in enumerate(units[f]):
            if (f, v) in columns:
                x[i, columns[f, v] + 1] = 1
    return x


def _fit(cells: pd.DataFrame, targets: list[tuple], size: int) -> np.ndarray:
    """Expected draws per cell: as near to the targets as the cells' counts allow, summing to ``size``."""
    n = cells["n"].to_numpy(float)
    draw = n * size / n.sum()
    by_field = {}
    for field in FIELDS:
        by_field[field] = [((cells[field] == v).to_numpy(), share, least) for f, v, share, least in targets if f == field]
    for _ in range(300):
        for field, goals in by_field.items():
            rest = np.ones(len(n), bool)
            got = 0.0
            for mask, share, least in goals:
                have = n[mask].sum()
                want = min(have, max(share * size, min(least, have)))
                got += want
                rest &= ~mask
                s = draw[mask].sum()
                if s > 0:
                    draw[mask] *= want / s
            s = draw[rest].sum()
            if s > 0 and goals:
                draw[rest] *= max(size - got, 0.0) / s if got < size else 0.0
            draw = np.minimum(draw, n)
        s = draw.sum()
        if s > 0:
            draw = np.minimum(draw * size / s, n)
    for _ in range(50):  # what the caps cut off goes to cells with room
        s = draw.sum()
        room = n - draw
        if size - s < 1e-9 or room.sum() <= 0:
            break
        weight = np.where(room > 0, draw + 1e-9, 0)
        draw = np.minimum(draw + weight / weight.sum() * (size - s), n)
    return draw


def draw_sample(rows: DataFrame, targets: DataFrame, fraction: float = FRACTION, seed: int = 17) -> DataFrame:
    """The drawn units ``(sample_id, split_row_id, question_type, dimension, gold_letters)``."""
    plain = plain_rows(rows)
    first = plain.groupBy("sample_id").agg(F.min(F.struct("split_row_id", *FIELDS)).alias("r")).select("sample_id", "r.*")
    goal = [tuple(r) for r in plain_targets(targets).where("value IS NOT NULL").select("field_name", "value", "target_permille", "min_rows").collect()]
    known = {f: sorted({v for g, v, _, _ in goal if g == f}) for f in FIELDS}
    cell_cols = [
        (F.when(F.col(f).isin(known[f]), F.col(f)).otherwise("(rest)") if known[f] else F.lit("(rest)")).alias(f"c_{f}") for f in FIELDS
    ]
    units = cut(first.select("*", *cell_cols))
    names = [f"c_{f}" for f in FIELDS]
    cells = units.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).toPandas()  # bounded by the targets
    total = int(cells["n"].sum()) if len(cells) else 0
    size = int(total * fraction + 1e-9)
    if not size or not goal:
        return first.select("sample_id", "split_row_id", *FIELDS).where("false")
    cells = cells.rename(columns=dict(zip(names, FIELDS)))
    draws = _fit(cells, [(f, v, share / 1000, least) for f, v, share, least in goal], size)
    cells["p"] = draws / cells["n"]
    columns = {fv: i for i, fv in enumerate(sorted({(f, v) for f, v, _, _ in goal}))}
    chance = rows.sparkSession.createDataFrame(cells[[*FIELDS, "p"]].rename(columns=dict(zip(FIELDS, names))))
    open_units = units.select("sample_id", *names).join(F.broadcast(chance), names)
    schema = "sample_id string, c_question_type string, c_dimension string, c_gold_letters string, p double"

    def fly(units: pd.DataFrame, salt: int, by_dimension: bool) -> pd.DataFrame:
        units = units.assign(h=pd.util.hash_pandas_object(units["sample_id"], index=False)).sort_values([*names, "h", "sample_id"], ignore_index=True)
        rng = np.random.default_rng([seed, salt, int(units["h"].min())])  # by the units themselves, not by where they lie
        cell = units.groupby(names, sort=False).ngroup().to_numpy()
        p = _exchange(cell, units["p"].to_numpy(float), rng)
        live = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if len(live):
            part = units.iloc[live].rename(columns=dict(zip(names, FIELDS)))
            x = _indicators(part, columns)
            if by_dimension:
                for _, at in part.reset_index(drop=True).groupby("dimension").groups.items():
                    at = np.asarray(at)
                    p[live[at]] = _flight(x[at], p[live[at]], rng)
            else:
                p[live] = _flight(x, p[live], rng)
        return units.assign(p=p)[["sample_id", *names, "p"]]

    def inside(b: pd.DataFrame) -> pd.DataFrame:
        return fly(b, 0, True)

    def merged(b: pd.DataFrame) -> pd.DataFrame:
        return fly(b, 1, True)

    def landed(b: pd.DataFrame) -> pd.DataFrame:
        b = fly(b, 2, False)
        p = b["p"].to_numpy().copy()
        part = b.rename(columns=dict(zip(names, FIELDS)))
        x = _indicators(part, columns)
        rng = np.random.default_rng([seed, 3])
        for keep in range(x.shape[1] - 1, 0, -1):  # letters are given up first, then others, the size last
            if not ((p > 1e-9) & (p < 1 - 1e-9)).any():
                break
            p = _flight(x[:, :keep], p, rng)
        live = (p > 1e-9) & (p < 1 - 1e-9)
        p[live] = rng.random(live.sum()) < p[live]
        return b.assign(p=np.round(p))

    done, closed = [], (F.col("p") <= 1e-9) | (F.col("p") >= 1 - 1e-9)
    part = F.pmod(F.xxhash64(F.lit(seed), "sample_id"), F.lit(-(-total // PART)))
    level = cut(open_units.withColumn("part", part).groupBy("part").applyInPandas(inside, schema))
    done.append(level.where(closed))
    blocks = 2
    while blocks > 1:  # upward: groups of a bounded number of open units, until one per dimension is left
        level = level.where(~closed)
        blocks = -(-level.count() // (GROUP * max(1, len(known["dimension"]))))
        block = F.pmod(F.xxhash64("sample_id"), F.lit(max(blocks, 1)))
        level = cut(level.withColumn("block", block).groupBy("c_dimension", "block").applyInPandas(merged, schema))
        done.append(level.where(closed))
    last = level.where(~closed).withColumn("all", F.lit(0)).groupBy("all").applyInPandas(landed, schema)
    drawn = reduce(DataFrame.union, [*done, cut(last)]).where("p > 0.5").select("sample_id")
    return units.join(drawn, "sample_id").select("sample_id", "split_row_id", *FIELDS)


def _per_value(rows: DataFrame) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in FIELDS))
    return rows.select("sample_id", F.explode(pairs).alias("x")).select("sample_id", "x.*").where("value IS NOT NULL")


def report(rows: DataFrame, targets: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """Per target: available samples, drawn ones, residual, whether the sample misses it and whether it can be met."""
    plain = plain_rows(rows)
    size = F.floor(F.col("samples") * F.lit(fraction) + 1e-9)
    drawn = draw_sample(rows, targets, fraction)
    available = _per_value(plain).groupBy("field_name", "value").agg(F.count_distinct("sample_id").alias("available"))
    reached = _per_value(drawn).groupBy("field_name", "value").agg(F.count("*").alias("drawn"))
    whole = plain.agg(F.count_distinct("sample_id").alias("samples")).select(size.alias("sample_size"))
    return (
        plain_targets(targets)
        .join(available, ["field_name", "value"], "left")
        .join(reached, ["field_name", "value"], "left")
        .join(F.broadcast(whole))
        .select(
            "target_id",
            "field_name",
            "value",
            "target_permille",
            "min_rows",
            F.coalesce("available", F.lit(0)).alias("available"),
            "sample_size",
            F.coalesce("drawn", F.lit(0)).alias("drawn"),
            F.round(F.coalesce("drawn", F.lit(0)) - F.col("target_permille") * F.col("sample_size") / 1000, 3).alias("residual"),
        )
        .withColumn("missed", F.col("drawn") < F.greatest(F.col("min_rows"), F.col("target_permille") * F.col("sample_size") / 1000))
        .withColumn(
            "can_be_met",
            (F.col("available") >= F.col("min_rows")) & (F.col("available") * 1000 >= F.col("target_permille") * F.col("sample_size")),
        )
    )


def found(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """p5_found: the targets that the landed sample misses and that no sample could meet."""
    return report(rows, targets).where("missed AND NOT can_be_met").select("target_id")


def reachability(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``(target_id, available, sample_size, can_be_met)`` of every target."""
    return report(rows, targets).select("target_id", "available", "sample_size", "can_be_met")
