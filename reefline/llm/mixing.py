"""Mixing sources to target weights by iterative proportional fitting.

Token counts are summed by cell (source, language, topic), the cells' weights are raked until every
margin has its target share, and documents are sampled by the calibrated probability of their cell.
Probabilities are raked too, with 1 as their bound: what a full cell can't give, the others of its
category give. Where a category has fewer tokens than its target asks for, all of them stay and the
margin's other categories share the rest in proportion to their targets.

Raking needs the cells only. Up to ``max_cells`` of them the driver rakes (their number is counted
first); beyond that each step is a DataFrame aggregation and the cells stay distributed. Both take the same
steps, so probabilities differ by no more than the order of sums does. Where the margins aren't met when the
rounds end, a warning says by how much.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import kept, small_batches, small_table, workspace, written

MAX_CELLS = 200_000
ROUNDS = 60
TOLERANCE = 1e-10
#: For probabilities: margins that exclude each other (each possible alone) end with the rounds.
BOUND_ROUNDS = 200
BOUND_TOLERANCE = 1e-8


@dataclass(frozen=True)
class Weights:
    """A target given as weights by token: a category's share is its own share times its weight, to sum 1."""

    by: Mapping[str, float] = field(default_factory=dict)
    other: float = 1.0


Target = dict[str, float] | float | Weights
#: Sources and languages a little more even than they are; of what isn't prose less, of noise little.
TARGETS: dict[str, Target] = {"source": 0.9, "lang": 0.9, "topic": Weights({"noise": 0.25, "tables": 0.75, "contact": 0.75, "code": 0.75})}


def vocabulary_tokens(name: str = "byte_bpe_50k") -> Callable[[Column], Column]:
    """Counts the ids of a public vocabulary."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        from reefline.llm.tokenizing import byte_bpe

        encode = byte_bpe(name)
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "\\s+"))).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from tell-tale strings, the first that fits."""
    text = F.coalesce(text, F.lit(""))
    out = F.when(F.contains(text, F.lit("License")) | F.contains(text, F.lit("Licensed")), "legal")
    out = out.when(F.contains(text, F.lit("password=")) | F.contains(text, F.lit("token =")), "code")
    out = out.when(F.contains(text, F.lit("@")), "contact").when(F.contains(text, F.lit(" | ")), "tables")
    return out.when(F.contains(text, F.lit("%%% ")) | F.contains(text, F.lit("!! ")), "noise").otherwise("prose")


def unmet(what: str, worst: float, tolerance: float) -> None:
    if worst >= max(tolerance, 1e-6):
        warnings.warn(f"raking of {what} ended with a margin off by a share of {worst:.2g}: the targets exclude each other", stacklevel=3)


def rake(tokens: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """Token weights of the cells whose sums by each margin match its target shares.

    members: for each margin the category of every cell; targets: each category's share. Cells without
    tokens keep none.
    """
    w = tokens.astype(np.float64)
    total = w.sum()
    if not total:
        return w
    for _ in range(ROUNDS):
        worst = 0.0
        for member, share in zip(members, targets, strict=True):
            now = np.bincount(member, weights=w, minlength=len(share))
            factor = np.divide(share * total, now, out=np.ones_like(now), where=now > 0)
            worst = max(worst, float(np.abs(factor - 1).max()))
            w *= factor[member]
        if worst < TOLERANCE:
            break
    unmet("weights", worst, TOLERANCE)
    return w


def tempered(tokens: np.ndarray, temperature: float) -> np.ndarray:
    p = np.where(tokens > 0, tokens.astype(np.float64), 0) ** temperature * (tokens > 0)
    return p / p.sum() if p.sum() else p


def bisected(reached: Callable[[float], float], reach: float, top: float) -> float:
    """s with reached(s) = reach, or all there is (``top``) where that is less."""
    low, high = 0.0, 1.0
    while reached(high) < min(reach, top * (1 - 1e-12)) and high < 1e12:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if reached(mid) < reach else (low, mid)
    return high


def scale_for(tokens: np.ndarray, ratio: np.ndarray, share: float) -> float:
    """s with sum(tokens min(1, s ratio)) = share sum(tokens)."""
    return bisected(lambda s: float((tokens * np.minimum(1.0, s * ratio)).sum()), share * float(tokens.sum()), float(tokens[ratio > 0].sum()))


def bounded(tokens: np.ndarray, ratio: np.ndarray, members: list[np.ndarray], targets: list[np.ndarray], share: float) -> np.ndarray:
    """Probabilities with a kept share of ``share`` and every margin at its targets as far as its tokens go.

    ratio: the raked weight by token. A step fixes full cells at 1 and scales the category's others to what
    its target leaves for them.
    """
    p = ratio * scale_for(tokens, ratio, share)
    wants = []
    for member, target in zip(members, targets, strict=True):
        have = np.bincount(member, weights=tokens * (ratio > 0), minlength=len(target))
        rate = np.divide(target, have, out=np.zeros_like(have), where=have > 0)
        wants.append(have * np.minimum(1.0, rate * scale_for(have, rate, share * tokens.sum() / have.sum())))
    for _ in range(BOUND_ROUNDS):
        worst = 0.0
        for member, want in zip(members, wants, strict=True):
            full = p >= 1
            fixed = np.bincount(member, weights=tokens * full, minlength=len(want))
            rest = np.bincount(member, weights=np.where(full, 0.0, tokens * p), minlength=len(want))
            worst = max(worst, float((np.abs(fixed + rest - want) / np.where(want > 0, want, 1.0)).max()))
            up = np.divide(want - fixed, rest, out=np.ones_like(want), where=rest > 0)
            down = np.divide(want, fixed + rest, out=np.ones_like(want), where=fixed + rest > 0)
            p = p * np.where(want > fixed, up, down)[member]
        if worst < BOUND_TOLERANCE:
            break
    unmet("probabilities", worst, BOUND_TOLERANCE)
    return np.minimum(1.0, p * scale_for(tokens, p, share))


def scale_of(df: DataFrame, reach: float) -> float:
    """s with sum(tokens min(1, s weight)) = reach, or all tokens with a weight where there are fewer."""
    total = lambda c: float(df.agg(F.sum(c)).first()[0] or 0.0)
    return bisected(lambda s: total(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * s)), reach, total(F.when(F.col("weight") > 0, F.col("tokens"))))


def bounded_table(work: DataFrame, goals: dict[str, DataFrame], reach: float) -> DataFrame:
    """``bounded`` for a written table of cells (tokens, weight): with ``probability``."""
    work = written(work.withColumn("p", F.col("weight") * scale_of(work, reach)), "mix-cells")
    wants = {}
    for m, goal in goals.items():
        have = work.groupBy(m).agg(F.sum(F.when(F.col("weight") > 0, F.col("tokens")).otherwise(0)).cast("double").alias("tokens"))
        have = written(have.join(goal, m).withColumn("weight", F.when(F.col("tokens") > 0, F.col("want") / F.col("tokens")).otherwise(0.0)), "mix-targets")
        rate = F.least(F.lit(1.0), F.col("weight") * scale_of(have, reach))
        wants[m] = written(have.select(m, (F.col("tokens") * rate).alias("want")), "mix-targets")
    full = F.col("p") >= 1
    for _ in range(BOUND_ROUNDS):
        worst = 0.0
        for m, want in wants.items():
            sums = work.groupBy(m).agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).cast("double").alias("fixed"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("p"))).alias("rest"))
            up = F.when(F.col("rest") > 0, (F.col("want") - F.col("fixed")) / F.col("rest")).otherwise(1.0)
            down = F.when(F.col("fixed") + F.col("rest") > 0, F.col("want") / (F.col("fixed") + F.col("rest"))).otherwise(1.0)
            off = F.abs(F.col("fixed") + F.col("rest") - F.col("want")) / F.when(F.col("want") > 0, F.col("want")).otherwise(1.0)
            factor = written(sums.join(want, m).select(m, F.when(F.col("want") > F.col("fixed"), up).otherwise(down).alias("factor"), off.alias("off")), "mix-factors")
            worst = max(worst, factor.agg(F.max("off")).first()[0] or 0.0)
            work = written(work.join(factor.select(m, "factor"), m).withColumn("p", F.col("p") * F.col("factor")).drop("factor"), "mix-cells")
        if worst < BOUND_TOLERANCE:
            break
    unmet("probabilities", worst, BOUND_TOLERANCE)
    scale = scale_of(work.select("tokens", F.col("p").alias("weight")), reach)
    return work.withColumn("probability", F.least(F.lit(1.0), F.col("p") * scale))


def cell_probabilities(cells: DataFrame, margins: dict[str, Target], share: float, max_cells: int) -> DataFrame:
    """``cells`` (a written table with a column for each margin and ``tokens``) with weight and probability."""
    names = list(margins)
    spark = cells.sparkSession
    if cells.count() <= max_cells:
        rows = cells.orderBy(*names).collect()
        tokens = np.array([r.tokens for r in rows], dtype=np.float64)
        members, targets = [], []
        for m in names:
            values = sorted({r[m] for r in rows})
            at = {v: i for i, v in enumerate(values)}
            member = np.array([at[r[m]] for r in rows], dtype=np.int64)
            have = np.bincount(member, weights=tokens, minlength=len(values)) if rows else np.zeros(0)
            goal = margins[m]
            if isinstance(goal, Weights):
                wanted = have * np.array([goal.by.get(v, goal.other) for v in values])
            else:
                wanted = np.array([goal.get(v, 0.0) for v in values]) * (have > 0) if isinstance(goal, dict) else tempered(have, goal)
            members.append(member)
            targets.append(wanted / wanted.sum() if wanted.sum() else wanted)
        raked = rake(tokens, members, targets)
        ratio = np.divide(raked, tokens, out=np.zeros_like(raked), where=tokens > 0)
        chance = bounded(tokens, ratio, members, targets, share) if raked.sum() else ratio
        data = [(*(r[m] for m in names), float(w), float(p)) for r, w, p in zip(rows, ratio, chance, strict=True)]
        return small_table(spark, data, ", ".join(f"`{m}` string" for m in names) + ", weight double, probability double")
    work = cells.withColumn("w", F.col("tokens").cast("double"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for m in names:
        sums = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("have"))
        goal = margins[m]
        if isinstance(goal, Weights):
            given = small_table(spark, list(goal.by.items()) or [("", goal.other)], f"`{m}` string, want double")
            sums = sums.join(given, m, "left").select(m, (F.col("have") * F.coalesce("want", F.lit(goal.other))).alias("want"))
        elif isinstance(goal, dict):
            given = small_table(spark, list(goal.items()) or [("", 0.0)], f"`{m}` string, want double")
            sums = sums.join(given, m, "left").select(m, F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0))).otherwise(0.0).alias("want"))
        else:
            sums = sums.select(m, F.when(F.col("have") > 0, F.pow("have", F.lit(goal))).otherwise(0.0).alias("want"))
        norm = sums.agg(F.sum("want")).first()[0] or 1.0
        goals[m] = written(sums.select(m, (F.col("want") / norm * total).alias("want")), "mix-targets")
    for _ in range(ROUNDS):
        worst = 0.0
        for m in names:
            factor = work.groupBy(m).agg(F.sum("w").alias("now")).join(goals[m], m).select(m, F.when(F.col("now") > 0, F.col("want") / F.col("now")).otherwise(1.0).alias("factor"))
            factor = written(factor, "mix-factors")
            worst = max(worst, factor.agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0.0)
            work = written(work.join(factor, m).withColumn("w", F.col("w") * F.col("factor")).drop("factor"), "mix-cells")
        if worst < TOLERANCE:
            break
    unmet("weights", worst, TOLERANCE)
    work = written(work.withColumn("weight", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)), "mix-cells")
    return bounded_table(work, goals, share * total).select(*names, "weight", "probability")


def uniform(id_text: Column, text: Column, seed: int) -> Column:
    """0 to 1 by a hash of the id; of the text where the id is null."""
    own = F.coalesce(id_text, F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own)), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    margins: dict[str, Column] | None = None,
    targets: dict[str, Target] | None = None,
    tokens: Callable[[Column], Column] = word_count,
    share: float = 0.7,
    seed: int = 42,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """(id, one column for each margin, n_tokens, weight, probability, kept) for each row.

    ``margins``: the categories (by default source, lang, and a topic from the text); ``targets``: for
    each margin its shares by category, weights for its own shares, or a temperature that these are raised to.
    ``tokens``: counts those of a text (by default words). ``share``: the share of all tokens to keep. weight: raked over actual tokens of the row's cell. probability: the
    weights raked again under the bound 1, so that what is kept meets the targets as far as the tokens go;
    kept: whether the id's hash falls below it.

    A null category is the category "". Categories without tokens, or without a target where targets are
    given, get weight 0. A text without words has no tokens; its row goes with its cell. Rows that repeat an
    id are kept or dropped alike where their cells are; rows without one go by their text. Other columns are
    ignored. An empty table gives no rows.
    """
    margins, targets = _settings(margins, targets, text_col)
    with workspace(docs.sparkSession, "mixing"):
        rows, chances = _chances(docs, id_col, text_col, margins, targets, tokens, share, seed, max_cells)
        out = rows.join(chances, list(margins)).select(F.col("_id").alias(id_col), *margins, "n_tokens", "weight", "probability", (F.col("_u") < F.col("probability")).alias("kept"))
        return kept(out, "mixed")


def sample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    margins: dict[str, Column] | None = None,
    targets: dict[str, Target] | None = None,
    tokens: Callable[[Column], Column] = word_count,
    share: float = 0.7,
    seed: int = 42,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """The rows of ``docs`` that ``mix`` keeps, with all their columns. Up to ``max_cells`` cells the cells'
    probabilities go to the rows, so no row is shuffled."""
    margins, targets = _settings(margins, targets, text_col)
    with workspace(docs.sparkSession, "mixing"):
        _, chances = _chances(docs, id_col, text_col, margins, targets, tokens, share, seed, max_cells)
        chances = kept(chances.select(*[F.col(f"`{m}`").alias(f"_m{i}") for i, m in enumerate(margins)], F.col("probability").alias("_p")), "mix-chances")
    few = chances.count() <= max_cells
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(row, *[_category(c).alias(f"_m{i}") for i, c in enumerate(margins.values())], uniform(F.col(id_col).cast("string"), F.col(text_col), seed).alias("_u"))
    return rows.join(F.broadcast(chances) if few else chances, [f"_m{i}" for i in range(len(margins))]).where("_u < _p").select("_doc.*")


def _settings(margins: dict | None, targets: dict | None, text_col: str) -> tuple[dict[str, Column], dict]:
    margins = margins or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(F.col(text_col))}
    targets = targets or TARGETS
    if set(targets) != set(margins):
        raise ValueError("each margin has a target")
    return margins, {m: targets[m] for m in margins}


def _category(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _chances(docs: DataFrame, id_col: str, text_col: str, margins: dict[str, Column], targets: dict, tokens: Callable[[Column], Column], share: float, seed: int, max_cells: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their margins, tokens and hash; the cells' weights and probabilities)."""
    rows = docs.select(F.col(id_col).alias("_id"), *(_category(c).alias(m) for m, c in margins.items()), tokens(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_tokens"), uniform(F.col(id_col).cast("string"), F.col(text_col), seed).alias("_u"))
    with small_batches(docs.sparkSession):
        rows = written(rows, "mix-rows")
    cells = written(rows.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens")), "mix-cells")
    return rows, cell_probabilities(cells, targets, share, max_cells)
