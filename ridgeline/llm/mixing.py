"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed up to cells, one for each combination of source, language and topic that occurs. Raking scales the
token weights of the cells so that one margin after another meets its target, round after round. The calibrated weight
of a cell over its own weight says how often its documents are wanted, which becomes the probability of each. Only
DataFrame functions are used. Cells, not documents, take part in the rounds: one scan sums up the documents before the
shuffle, so a source with a third of all rows is no heavier than another, and one more scan marks them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ridgeline.llm.common import fresh, materialize

WORD = r"[^\x09-\x0D\x20]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def layout_topic(text: Column, marks: list[tuple[str, str]], sizes: list[tuple[str, int]], longest: str) -> Column:
    """The first name whose mark the text contains, else the first whose size in characters it is below."""
    out: Column | None = None
    for name, mark in marks:
        out = F.when(F.contains(text, F.lit(mark)), name) if out is None else out.when(F.contains(text, F.lit(mark)), name)
    for name, size in sizes:
        known = F.coalesce(F.length(text), F.lit(0)) < size
        out = F.when(known, name) if out is None else out.when(known, name)
    return F.lit(longest) if out is None else out.otherwise(longest)


def tempered_targets(cells: DataFrame, dim: str, temper: float) -> DataFrame:
    """A margin's shares to the power ``temper``, before they are scaled to one."""
    return cells.groupBy(F.col(dim).alias(f"{dim}_")).agg(F.pow(F.sum("own"), F.lit(temper)).alias("wanted"))


def _with_targets(cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], total: float) -> DataFrame:
    """Cells with ``of_<dim>``, what all cells of their value are wanted to weigh; stored, so that rounds need no join."""
    out = cells
    for dim in dims:
        # only values that occur can be met
        here = cells.where("own > 0").select(F.col(dim).alias("here")).distinct()
        known = targets[dim].join(here, F.col(f"{dim}_").eqNullSafe(F.col("here")), "left_semi")
        all_wanted = known.agg(F.sum("wanted")).first()[0] or 0.0
        own = known.select(f"{dim}_", (F.col("wanted") / F.lit(all_wanted) * F.lit(total)).alias(f"of_{dim}"))
        out = out.join(own, out[dim].eqNullSafe(own[f"{dim}_"]), "left").drop(f"{dim}_")
    return materialize(out, "wanted-cells")


def rake(
    cells: DataFrame, dims: list[str], targets: dict[str, DataFrame], rounds: int, share: float | None = None, tolerance: float = 0.0
) -> tuple[DataFrame, float]:
    """Cells with ``own`` get ``weight``, scaled so that each margin in turn is as wanted; also the last movement.

    ``targets`` holds for each dimension ``<dim>_, wanted``, a row for each value, in any unit. Values without a target
    get nothing. With ``share`` the weights add up to that share of all, and none exceeds the cell's own: what such
    cells cannot give, the next rounds ask from the other cells of the same value. Rounds end when no weight moves by
    more than ``tolerance`` of the cell's own weight, at the latest after ``rounds``.

    The sum of a margin is a window over the cells of its value, so a round is one job without any join; the job
    itself reports how far weights moved.
    """
    total = (cells.agg(F.sum("own")).first()[0] or 0.0) * (1.0 if share is None else share)
    now = _with_targets(cells, dims, targets, total)
    kept = now.columns
    now = now.withColumn("weight", F.col("own") * F.lit(1.0 if share is None else share))
    moved = 0.0
    for _ in range(rounds):
        turn = now.withColumn("was", F.col("weight"))
        for dim in dims:
            factor = F.coalesce(F.try_divide(F.col(f"of_{dim}"), F.sum("weight").over(Window.partitionBy(dim))), F.lit(0.0))
            weight = F.col("weight") * factor
            turn = turn.withColumn("weight", weight if share is None else F.least(weight, F.col("own")))
        seen = Observation()
        movement = F.max(F.try_divide(F.abs(F.col("weight") - F.col("was")), F.col("own")))
        now = materialize(turn.observe(seen, movement.alias("moved")).select(*kept, "weight"), "raked")
        moved = seen.get["moved"] or 0.0
        if moved <= tolerance:
            break
    return now.drop(*[f"of_{dim}" for dim in dims]), moved


def _wanted(cells: DataFrame, names: list[str], inner: list[str], targets: dict[str, DataFrame] | None, temper: float) -> dict[str, DataFrame]:
    wanted = {}
    for name, dim in zip(names, inner):
        if targets is not None:
            value, weight = (F.col(f"`{c}`") for c in targets[name].columns[:2])
            weight = weight.cast("double")
            refused = F.raise_error(F.lit(f"a target of {name} is null or negative")).cast("double")
            rows = targets[name].select(value.alias(f"{dim}_"), F.when(weight >= 0, weight).otherwise(refused).alias("wanted"))
            wanted[dim] = rows.groupBy(f"{dim}_").agg(F.sum("wanted").alias("wanted"))  # a value named twice wants both
        else:
            wanted[dim] = tempered_targets(cells, dim, temper)
    return wanted


def _cells(docs: DataFrame, dims: dict[str, Column], inner: list[str], tokens: Column) -> DataFrame:
    rows = docs.select(*[c.alias(i) for c, i in zip(dims.values(), inner)], tokens.cast("double").alias("tokens"))
    return materialize(rows.groupBy(*inner).agg(F.coalesce(F.sum("tokens"), F.lit(0.0)).alias("own")), "cells")


def shortfalls(
    docs: DataFrame,
    dims: dict[str, Column],
    tokens: Column,
    share: float,
    targets: dict[str, DataFrame] | None = None,
    temper: float = 0.9,
    rounds: int = 8,
    tolerance: float = 0.0,
) -> DataFrame:
    """``margin, value, own, wanted, expected, shortfall, moved``, for each value of each margin that ``mix`` rakes.

    All but ``moved`` are tokens; ``moved`` is the largest movement of a probability in the last round.
    ``wanted`` is 0 for values without a target; values with a target that do not occur have no row. A shortfall is
    what a value lacks since its documents are all wanted already, or since the rounds ended; negative if it has more.
    """
    names = list(dims)
    inner = [f"dim{i}" for i in range(len(names))]
    cells = _cells(docs, dims, inner, tokens)
    wanted = _wanted(cells, names, inner, targets, temper)
    raked, moved = rake(cells, inner, wanted, rounds, share, tolerance)
    total = (cells.agg(F.sum("own")).first()[0] or 0.0) * share
    out = None
    for name, dim in zip(names, inner):
        margin = raked.groupBy(F.col(dim).alias("value")).agg(F.sum("own").alias("own"), F.sum("weight").alias("expected"))
        aim = margin.where("own > 0").join(wanted[dim], F.col("value").eqNullSafe(F.col(f"{dim}_"))).select(f"{dim}_", "wanted")
        scale = F.lit(total) / F.lit(aim.agg(F.sum("wanted")).first()[0] or 1.0)
        margin = margin.join(aim, F.col("value").eqNullSafe(F.col(f"{dim}_")), "left")
        aimed = F.coalesce(F.col("wanted") * scale, F.lit(0.0))
        value = F.col("value").cast("string").alias("value")
        margin = margin.select(F.lit(name).alias("margin"), value, "own", aimed.alias("wanted"), "expected", (aimed - F.col("expected")).alias("shortfall"))
        out = margin if out is None else out.unionByName(margin)
    return out.withColumn("moved", F.lit(moved))


def mix(
    docs: DataFrame,
    dims: dict[str, Column],
    tokens: Column,
    targets: dict[str, DataFrame] | None = None,
    temper: float = 0.9,
    rounds: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: str = "",
    probability: str = "probability",
    sampled: str = "sampled",
    share: float | None = None,
    tolerance: float = 0.0,
) -> DataFrame:
    """``docs`` with the probability of each row, and whether it is sampled.

    ``dims`` are the margins by name; null is a value of its own. Without ``targets`` the wanted share of a value is
    its share of all tokens to the power ``temper``, which lifts small sources. A value named twice in ``targets`` wants
    the sum; a null or negative target fails. Raking ends when no probability moves by more than ``tolerance``, at the
    latest after ``rounds``. Probabilities are proportional to
    calibrated over own weight. With ``share``, that share of all tokens is expected to be sampled, less what the
    margins lack because a cell cannot be sampled more than whole (see ``shortfalls``); no rare cell changes the others
    much. Without it the probability is one for the cell that is wanted most, however small that cell is, so the
    expected margins are exactly the targets but the total may be small.
    Documents of cells without any token have probability one. A row is sampled if a number made from its id (from its
    text where the id is null) is below its probability: the same on every run, and the same for rows with one id.
    An empty table gives an empty result; columns named like the two results are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {probability.lower(), sampled.lower()}])
    names = list(dims)
    inner = [f"dim{i}" for i in range(len(names))]
    cells = _cells(docs, dims, inner, tokens)
    wanted = _wanted(cells, names, inner, targets, temper)
    raked = rake(cells, inner, wanted, rounds, share, tolerance)[0].withColumn("ratio", F.try_divide("weight", "own"))
    most = raked.agg(F.max("ratio")).first()[0] if share is None else 1.0
    chance = fresh(docs.columns, "chance")
    rate = F.coalesce(F.try_divide("ratio", F.lit(most).cast("double")), F.lit(1.0))
    at = [fresh(docs.columns, f"at_{i}") for i in inner]
    raked = raked.select(*[F.col(i).alias(a) for i, a in zip(inner, at)], rate.alias(chance))
    match = None
    for name, a in zip(names, at):
        same = dims[name].eqNullSafe(F.col(a))
        match = same if match is None else match & same
    out = docs.join(raked, match, "left").drop(*at)
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))
    return out.withColumn(probability, F.col(chance)).withColumn(sampled, draw < F.col(chance)).drop(chance)
