"""Mixing sources to target weights by hierarchical budgets.

The corpus is a tree domain - language - source.  Weights are given for children of
a node relative to their siblings (1 where none is given).  The total token budget is
handed down: a node's budget is shared among its children by weight, and a child never
gets more than its subtree can supply (its leaves' tokens times ``max_epochs``).  What
a child can't use goes to its siblings by their weights; only what all of them can't
use stays with the ancestor, whose own siblings have then already taken it, because a
node is never given more than its subtree can supply.

A leaf's rows are put in a seeded order, a new one for each epoch.  Whole epochs are
taken while the budget lasts; of the next one, the prefix of rows whose tokens before
them are under what is left (so a leaf passes its budget by less than one row).

*Scale.*  Leaf totals are one row per leaf of the tree; budgets are worked out from
them on the driver, guarded by ``max_leaves``.  A prefix is found without putting a
leaf into one task: token sums of 2**``BUCKET_BITS`` ranges of the seeded order say in which
range the budget ends, those of as many ranges of that range narrow it down again, and
only the rows of the last one are added up one by one.  Selecting is then a comparison
with one cut per leaf; texts are never moved.

Defined results: null lang or source count as a leaf named by the empty text; null or
empty texts have 0 tokens and belong to a prefix as its order has them; the order is by
a hash of doc_id and text, so doc_id may repeat or be null, and rows equal in both are
taken together, as one row; leaves of weight 0 are never taken; a budget beyond what all
leaves can supply takes everything ``max_epochs`` times; an empty table gives an empty
result; other columns pass by untouched, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._rows import row_key
from ._store import Scratch
from .quality_rules import words

LEVELS = ("domain", "language", "source")
#: Ranges of the order in a round, as bits, and rounds.
BUCKET_BITS, ROUNDS = 10, 2


@dataclass(frozen=True)
class Plan:
    """weights: (path of names) -> weight relative to its siblings, e.g. ("web",), ("web", "en"), ("web", "en", "src3")."""

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    share: float = 0.5
    max_epochs: int = 4
    seed: int = 42
    max_leaves: int = 100_000


#: Four groups of sources stand for domains where the table names none.
def default_domain() -> Column:
    number = F.coalesce(F.try_to_number(F.regexp_extract(F.coalesce("source", F.lit("")), r"(\d{1,9})$", 1), F.lit("999999999")), F.lit(0))
    return F.concat(F.lit("domain"), (F.pmod(number.cast("long"), F.lit(4))).cast("string"))


def fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Shares ``budget`` among (weight, supply) children: by weight, what one can't use going to its siblings."""
    given = [0.0] * len(children)
    open_ = [k for k, (w, s) in enumerate(children) if w > 0 and s > 0]
    left = budget
    while open_ and left > 0:
        weight = sum(children[k][0] for k in open_)
        short = [k for k in open_ if children[k][1] <= left * children[k][0] / weight]
        if not short:
            for k in open_:
                given[k] = left * children[k][0] / weight
            break
        for k in short:
            given[k] = children[k][1]
        left -= sum(children[k][1] for k in short)
        open_ = [k for k in open_ if k not in set(short)]
    return given


def budgets(leaves: dict[tuple[str, ...], float], plan: Plan, total: float) -> dict[tuple[str, ...], float]:
    """Token budget of each leaf, handed down the tree; ``leaves``: path -> tokens."""
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    supply: dict[tuple[str, ...], float] = {}
    for path, tokens in leaves.items():
        zero = any(plan.weights.get(path[:k], 1.0) <= 0 for k in range(1, len(path) + 1))
        for k in range(len(path) + 1):
            supply[path[:k]] = supply.get(path[:k], 0.0) + (0.0 if zero else tokens * plan.max_epochs)
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
    out: dict[tuple[str, ...], float] = {}
    todo = [((), min(total, supply.get((), 0.0)))]
    while todo:
        node, budget = todo.pop()
        if node not in children:
            out[node] = budget
            continue
        names = sorted(children[node])
        todo += list(zip(names, fill(budget, [(plan.weights.get(c, 1.0), supply[c]) for c in names])))
    return {path: out.get(path, 0.0) for path in leaves}


def _order(epoch: Column | int, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(epoch) if isinstance(epoch, int) else epoch, "doc_id", "row")


def added_names(docs: DataFrame) -> tuple[str, str, str]:
    """Names of the columns that ``select_mixture`` adds: __path, __tokens and __epoch, with more underscores where ``docs`` has them."""
    mark = "__"
    while {f"{mark}path", f"{mark}tokens", f"{mark}epoch"} & set(docs.columns):
        mark += "_"
    return f"{mark}path", f"{mark}tokens", f"{mark}epoch"


def select_mixture(docs: DataFrame, plan: Plan = Plan(), domain: Column | None = None) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` once per epoch they are taken in, with their leaf, tokens and epoch added (see ``added_names``)."""
    store = Scratch(docs.sparkSession, "mixing")
    path = F.array(domain if domain is not None else default_domain(), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))
    tokens = F.size(words(F.col("text"))).cast("long")
    rows = store.put(docs.select("doc_id", row_key().alias("row"), path.alias("path"), tokens.alias("tokens")), "tokens")
    sums = rows.groupBy("path").agg(F.sum("tokens").alias("tokens")).limit(plan.max_leaves + 1).collect()
    if len(sums) > plan.max_leaves:
        raise ValueError(f"the tree has more than {plan.max_leaves} leaves")
    leaves = {tuple(r["path"]): float(r["tokens"]) for r in sums}
    given = budgets(leaves, plan, plan.share * sum(leaves.values()))
    table = []
    for leaf, total in leaves.items():
        whole = min(int(given[leaf] // total), plan.max_epochs) if total else 0
        left = given[leaf] - whole * total if total else 0.0
        if left < 1e-6 * max(total, 1.0) or whole == plan.max_epochs:
            left = 0.0
        table.append((list(leaf), whole, left))
    schema = T.StructType([T.StructField("path", T.ArrayType(T.StringType())), T.StructField("whole", T.IntegerType()), T.StructField("left_over", T.DoubleType())])
    leaf = store.put(docs.sparkSession.createDataFrame(table, schema), "leaves")
    limit = leaf.join(store.put(_cuts(rows, leaf, plan.seed), "cuts"), "path", "left").select("path", "whole", "cut")
    store.drop(rows)
    marked = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("all"), path.alias("path"), tokens.alias("tokens"), docs["doc_id"], row_key().alias("row"))
    # One row per leaf of the tree; its size was checked above.
    marked = marked.join(F.broadcast(limit), "path")
    in_prefix = F.coalesce(_order(F.col("whole"), plan.seed) <= F.col("cut"), F.lit(False))
    taken = marked.withColumn("times", F.col("whole") + F.when(in_prefix, 1).otherwise(0)).where("times > 0")
    names = added_names(docs)
    return taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).select(*(F.col("all")[c].alias(c) for c in docs.columns), *(F.col(c).alias(n) for c, n in zip(("path", "tokens", "epoch"), names)))


def _cuts(rows: DataFrame, leaf: DataFrame, seed: int) -> DataFrame:
    """path, cut: the last place of each leaf's prefix in the seeded order of its last epoch; rows of one place count as one."""
    some = rows.join(F.broadcast(leaf.where("left_over > 0")), "path").select("path", "left_over", "tokens", _order(F.col("whole"), seed).alias("o"))
    some = some.withColumn("before", F.lit(0).cast("long"))
    for k in range(1, ROUNDS + 1):
        # Ranges of equal width of the signed 64-bit order, then of the range in which the budget ends.
        some = some.withColumn("bucket", F.shiftright("o", 64 - k * BUCKET_BITS))
        sums = some.groupBy("path", "left_over", "before", "bucket").agg(F.sum("tokens").alias("t"))
        ahead = Window.partitionBy("path").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("t").over(ahead), F.lit(0)))
        last = placed.where(F.col("start") < F.col("left_over")).groupBy("path").agg(F.max_by(F.struct("bucket", "start"), "bucket").alias("at"))
        # One row per leaf of the tree.
        last = F.broadcast(last.select("path", F.col("at.bucket").alias("bucket"), F.col("at.start").alias("start")))
        some = some.join(last, ["path", "bucket"]).select("path", "left_over", "tokens", "o", F.col("start").alias("before"))
    units = some.groupBy("path", "left_over", "before", "o").agg(F.sum("tokens").alias("t"))
    ahead = Window.partitionBy("path").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    inside = units.withColumn("start", F.col("before") + F.coalesce(F.sum("t").over(ahead), F.lit(0))).where(F.col("start") < F.col("left_over"))
    return inside.groupBy("path").agg(F.max("o").alias("cut"))
