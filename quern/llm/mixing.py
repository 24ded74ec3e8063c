"""Mixing sources to target weights by hierarchical budgeting.

The corpus is a tree (domain, language, source). A token budget enters at the root and is handed
down: at each node the children share it in proportion to their weights, and a child never gets
more than its subtree can supply in ``max_epochs`` passes. What a child cannot use goes to its
siblings first (water-filling inside the node); only a node whose whole subtree is exhausted asks
for less, which frees budget for the node's own siblings. All shares are whole tokens, exact.

A leaf that is to give A tokens and holds T gives A div T whole passes and, of the next pass, a
token-prefix: epochs have their own seeded order (MD5 of seed, epoch and id, then of the text and
the row). Where the prefix ends is found without sorting the leaf: token sums by the first two
digits of the order key tell in which of 256 buckets it ends, the next two digits are looked at for
that bucket's rows alone, and so on until at most ``FEW`` rows are left to sort. Every step is
DataFrame code, and only one row a leaf and the few rows around its end are ever broadcast.

Edge cases: a null label is a node of its own; null and empty texts hold no tokens and are
never selected; rows are told apart by where they are stored, so repeated rows, repeated ids and rows
with a null id are drawn one by one; an empty table gives an empty result; weights must be positive
whole numbers; other columns are ignored (by ``draw``: kept) whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.shared import BLANKS, free, land, located, small_enough, whole, word_count

#: Digits of the order key that one step of the search for a prefix's end looks at, and the rows it leaves to sort.
DIGITS, FEW = 2, 256
_KEY_LENGTH = 64
_NULL = "(null)"

Weights = Mapping[tuple[str, ...], int]


def _weight(levels: Sequence[str], weights: Weights, default: int) -> Column:
    """The weight of the node that the level columns name, as CASE branches of a plain setting."""
    out = None
    for path, value in weights.items():
        if len(path) == len(levels):
            test = F.lit(True)
            for level, label in zip(levels, path, strict=True):
                test = test & (F.col(level) == label)
            out = F.when(test, value) if out is None else out.when(test, value)
    return (F.lit(default) if out is None else out.otherwise(default)).cast("long")


def _share_out(children: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Water-filling: ``budget`` of each parent over its children (``weight``, ``cap``) gives ``budget`` of the child."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    node = Window.partitionBy(*[F.col(p) for p in parents])
    tight = node.orderBy(F.col("cap") / F.col("weight"), name)
    out = (
        children.withColumn("before", F.coalesce(F.sum("cap").over(tight.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(tight.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("full", exact("cap") * exact("rest") <= (exact("budget") - exact("before")) * exact("weight"))
        .withColumn("left", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(node), F.lit(0)))
        .withColumn("open", F.sum(F.when(~F.col("full"), F.col("weight"))).over(node))
        .withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(cast(left as decimal(38,0)) * weight) div open")))
        .withColumn("odd", F.col("left") - F.sum(F.when(~F.col("full"), F.col("share")).otherwise(0)).over(node))
        .withColumn("turn", F.row_number().over(node.orderBy("full", F.desc("weight"), name)))
    )
    extra = F.when(~F.col("full") & (F.col("turn") <= F.col("odd")), 1).otherwise(0)
    return out.select(*parents, name, "cap", (F.col("share") + extra).cast("long").alias("budget"))


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Weights, total: int, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """(levels..., tokens, budget) for leaves given as (levels..., tokens)."""
    if min([default_weight, *weights.values()]) < 1:
        raise ValueError("weights are positive whole numbers")
    caps = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    given = None
    for depth in range(1, len(levels) + 1):
        path, parents = list(levels[:depth]), list(levels[: depth - 1])
        children = caps.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(path, weights, default_weight))
        if given is None:
            whole = Window.partitionBy()
            children = children.withColumn("budget", F.least(F.lit(total), F.sum("cap").over(whole)))
        else:
            children = children.join(given.drop("cap"), parents)
        given = _share_out(children, parents, path[-1])
    return leaves.join(given.drop("cap"), list(levels))


def _label(expression: str) -> Column:
    return F.coalesce(F.expr(expression).cast("string"), F.lit(_NULL))


def _order_key(seed: int, epoch: Column, row_id: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(row_id.cast("string"), F.lit(""))))


def _hex(column: Column) -> Column:
    return F.lpad(F.hex(column), 16, "0")


class _Draw:
    """What a mixture takes from each row of ``docs``: whole passes by leaf, and where each leaf's prefix ends."""

    def __init__(self, docs, levels, weights, share, total, max_epochs, seed, id_col, text_col, default_weight):
        self.names, self.seed = list(levels), seed
        self.docs, self.row_col = located(docs)
        rows = self.docs.select(
            F.col(id_col).cast("long").alias("id"),
            *[_label(c).alias(n) for n, c in levels.items()],
            word_count(text_col).alias("n_tokens"),
            F.xxhash64(whole(text_col)).alias("same"),
            F.col(self.row_col).alias("row"),
        )
        self.rows = land(rows, "tokens")
        leaves = land(self.rows.groupBy(*self.names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
        if total is None:
            total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
        plan = budgets(leaves, self.names, weights, total, max_epochs, default_weight).where("budget > 0")
        plan = land(plan.select(*self.names, F.expr("budget div tokens").alias("passes"), (F.col("budget") % F.col("tokens")).alias("prefix")), "plan")
        ends, self.edges = self._ends(plan)
        #: (levels..., passes, cut): rows of the next pass whose key is before ``cut`` are taken whole
        self.plan = land(plan.join(ends, self.names, "left").select(*self.names, "passes", F.coalesce("cut", F.lit("")).alias("cut")), "plan")

    def key(self, epoch: Column, row_id: Column, same: Column, row: Column) -> Column:
        return F.concat(_order_key(self.seed, epoch, row_id), _hex(same), _hex(F.xxhash64(row["file"], row["row"])))

    def _ends(self, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(levels..., cut), the bucket in which each leaf's prefix ends, and (row, taken, n_tokens) of what it takes there."""
        leaf = Window.partitionBy(*self.names)
        ends = plan.where("prefix > 0").withColumns({"start": F.lit(0).cast("long"), "depth": F.lit(DIGITS)})
        key = self.key(F.col("passes"), F.col("id"), F.col("same"), F.col("row"))
        last = self.rows.where("n_tokens > 0").join(small_enough(plan.where("prefix > 0").select(*self.names, "passes"), 128), self.names)
        last = last.select(*self.names, "id", "row", "n_tokens", key.alias("key"))
        while True:
            bucket = F.substring("key", F.lit(1), F.col("depth")).alias("cut")
            sums = last.join(small_enough(ends.drop("cut"), 160), self.names)
            ids = F.min("id").eqNullSafe(F.max("id")).alias("same_id")
            sums = sums.groupBy(*self.names, "prefix", "start", "depth", bucket).agg(F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n"), ids)
            sums = sums.withColumn("start", F.col("start") + F.sum("held").over(leaf.orderBy("cut")) - F.col("held"))
            ends = sums.where("start < prefix AND prefix <= start + held")
            # a bucket of a single id goes on behind the id's digits
            deeper = F.when(F.col("same_id") & (F.col("depth") < 32), 32 + DIGITS).otherwise(F.col("depth") + DIGITS)
            ends = land(ends.select(*self.names, "prefix", "start", "cut", "n", F.least(deeper, F.lit(_KEY_LENGTH)).alias("depth")), "ends")
            inside = F.substring("key", F.lit(1), F.length("cut")) == F.col("cut")
            last = land(last.join(small_enough(ends.select(*self.names, "cut"), 160), self.names).where(inside).drop("cut"), "edge")
            if ends.where((F.col("n") > FEW) & (F.length("cut") < _KEY_LENGTH)).isEmpty():
                break
        before = F.sum("n_tokens").over(leaf.orderBy("key", "n_tokens").rowsBetween(Window.unboundedPreceding, -1))
        edge = last.join(small_enough(ends, 160), self.names).withColumn("at", F.col("start") + F.coalesce(before, F.lit(0)))
        edge = edge.where("at < prefix").select("row", F.least("n_tokens", F.col("prefix") - F.col("at")).alias("taken"), "n_tokens")
        return ends.select(*self.names, "cut"), land(edge, "edge")


def mix(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Weights,
    share: tuple[int, int] = (3, 5),
    total: int | None = None,
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    default_weight: int = 1,
) -> DataFrame:
    """(id, levels..., n_tokens, epoch, taken, order_key): a row for each pass that takes from a row of ``docs``.

    ``levels`` names the tree's levels, root first, with the SQL expression of each label.
    ``total`` tokens are drawn, by default ``share`` (a fraction) of the corpus. ``taken`` is below
    ``n_tokens`` only for the document in which a leaf's prefix ends. Sorting a leaf by (epoch,
    order_key, id) gives its token stream.
    """
    draws = _Draw(docs, levels, weights, share, total, max_epochs, seed, id_col, text_col, default_weight)
    edges = draws.edges.select(F.col("row").alias("edge"), "taken")
    rows = draws.rows.where("n_tokens > 0").join(small_enough(draws.plan, 160), draws.names)
    key = draws.key(F.col("passes"), F.col("id"), F.col("same"), F.col("row"))
    rows = rows.withColumn("more", (F.substring(key, F.lit(1), F.length("cut")) < F.col("cut")).cast("long"))
    rows = rows.join(small_enough(edges, 56), F.col("row") == F.col("edge"), "left")
    times = F.col("passes") + F.col("more") + F.col("taken").isNotNull().cast("long")
    rows = rows.where(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    part = F.when(F.col("epoch") == F.col("passes"), F.coalesce("taken", "n_tokens")).otherwise(F.col("n_tokens"))
    return rows.select("id", *draws.names, "n_tokens", "epoch", part.alias("taken"), _order_key(seed, F.col("epoch"), F.col("id")).alias("order_key"))


def prefix_text(text: Column, taken: Column) -> Column:
    """The text up to its ``taken``-th word, with all that stands between the words."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[{BLANKS}]*[^{BLANKS}]+"), F.lit(0)), F.lit(1), taken.cast("int")), "")


def draw(
    docs: DataFrame,
    levels: Mapping[str, str],
    weights: Weights,
    share: tuple[int, int] = (3, 5),
    total: int | None = None,
    max_epochs: int = 4,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    default_weight: int = 1,
) -> DataFrame:
    """``docs`` as mixed: a row once for each pass that draws on it; where a leaf's prefix ends, the text ends too.

    Texts are not shuffled: each row decides by its leaf's plan and its own key.
    """
    draws = _Draw(docs, levels, weights, share, total, max_epochs, seed, id_col, text_col, default_weight)
    names = free(draws.docs.columns, *(f"level{k}" for k in range(len(levels))), "passes", "cut", "edge", "taken", "size", "times", "turn")
    nodes, (passes, cut, edge, taken, size, times, turn) = names[: len(levels)], names[len(levels) :]
    rows = draws.docs.where(whole(text_col).rlike(f"[^{BLANKS}]")).withColumns({n: _label(c) for n, c in zip(nodes, levels.values(), strict=True)})
    rows = rows.join(small_enough(draws.plan.toDF(*nodes, passes, cut), 160), nodes)
    rows = rows.join(small_enough(draws.edges.toDF(edge, taken, size), 64), F.col(draws.row_col) == F.col(edge), "left")
    key = draws.key(F.col(passes), F.col(id_col).cast("long"), F.xxhash64(whole(text_col)), F.col(draws.row_col))
    more = (F.substring(key, F.lit(1), F.length(cut)) < F.col(cut)).cast("long")
    rows = rows.withColumn(times, F.col(passes) + more + F.col(taken).isNotNull().cast("long")).where(F.col(times) > 0)
    rows = rows.withColumn(turn, F.explode(F.sequence(F.lit(0).cast("long"), F.col(times) - 1)))
    ends = (F.col(turn) == F.col(passes)) & (F.col(taken) < F.col(size))
    text = F.when(ends, prefix_text(F.col(text_col), F.col(taken))).otherwise(F.col(text_col)).alias(text_col)
    return rows.select(*(text if c == text_col else F.col(c) for c in docs.columns))
