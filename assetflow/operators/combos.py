"""Generate-and-filter arithmetic problems from operand tuples.

Each input row supplies four operands.  Every sign choice of each operand,
every +/- operator triple with at least one subtraction, and every
parenthesisation is generated by exploding a fixed array of combinations
per row (a generator, not a join), evaluated with column arithmetic, and
rendered with ``format_string``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The five parenthesisations of ``a o1 b o2 c o3 d``.
TEMPLATES = (
    "%s %s %s %s %s %s %s",
    "%s %s (%s %s %s) %s %s",
    "(%s %s %s) %s (%s %s %s)",
    "%s %s (%s %s %s %s %s)",
    "%s %s (%s %s (%s %s %s))",
)
OPERATORS = ("+", "-")
SELECTED_VALUES = (0, 200, -200)  # fixed value: answers kept by the selection


N_SIGNS = 2 ** 4                    # every sign choice of four operands
N_OPS = 2 ** 3 - 1                   # operator triples with at least one '-'
N_COMBOS = N_SIGNS * N_OPS * len(TEMPLATES)


def _apply(op: Column, x: Column, y: Column) -> Column:
    return F.when(op == "+", x + y).otherwise(x - y)


def _value(t: Column, n, o) -> Column:
    a, b, c, d = n
    o1, o2, o3 = o
    v0 = _apply(o3, _apply(o2, _apply(o1, a, b), c), d)
    v1 = _apply(o3, _apply(o1, a, _apply(o2, b, c)), d)
    v2 = _apply(o2, _apply(o1, a, b), _apply(o3, c, d))
    v3 = _apply(o1, a, _apply(o3, _apply(o2, b, c), d))
    v4 = _apply(o1, a, _apply(o2, b, _apply(o3, c, d)))
    return (F.when(t == 0, v0).when(t == 1, v1).when(t == 2, v2).when(t == 3, v3).otherwise(v4))


def problems(operands: DataFrame, cols=("a", "b", "c", "d"), key: str = "set_id") -> DataFrame:
    """All problems per operand row: ``key, template_id, problem, value``.

    Combination ``i`` in ``0 .. N_COMBOS-1`` decodes as template ``i % 5``,
    operator code ``(i / 5) % 7 + 1`` (bit k set = operator k is ``-``; code
    0, all ``+``, is excluded) and sign code ``i / 35`` (bit k = operand k
    negated).
    """
    i = F.col("_i")
    ex = operands.select(key, *[F.col(c).cast("long").alias(c) for c in cols],
                         F.explode_outer(F.sequence(F.lit(0), F.lit(N_COMBOS - 1))).alias("_i"))
    t = (i % len(TEMPLATES)).cast("int")
    opc = F.floor(i / len(TEMPLATES)) % N_OPS + 1
    sgc = F.floor(i / (len(TEMPLATES) * N_OPS))
    n = [F.col(c) * F.when(F.shiftright(sgc, k) % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
         for k, c in enumerate(cols)]
    o = [F.when(F.shiftright(opc, k) % 2 == 1, F.lit("-")).otherwise(F.lit("+")) for k in range(3)]
    staged = ex.select(key, t.alias("t"), *[x.alias(f"n{k}") for k, x in enumerate(n)],
                       *[x.alias(f"o{k}") for k, x in enumerate(o)])
    n = [F.col(f"n{k}") for k in range(4)]
    o = [F.col(f"o{k}") for k in range(3)]
    tc = F.col("t")
    rendered = F.when(tc == 0, F.format_string(TEMPLATES[0], n[0], o[0], n[1], o[1], n[2], o[2], n[3]))
    for j in range(1, len(TEMPLATES)):
        rendered = rendered.when(tc == j, F.format_string(TEMPLATES[j], n[0], o[0], n[1], o[1], n[2], o[2], n[3]))
    return staged.select(key, tc.alias("template_id"), rendered.alias("problem"), _value(tc, n, o).alias("value"))


def value_counts(probs: DataFrame) -> DataFrame:
    return probs.groupBy("value").agg(F.count(F.lit(1)).alias("n_problems"))


def select_values(probs: DataFrame, values=SELECTED_VALUES, seed: int = 0) -> DataFrame:
    """Problems whose answer is in ``values``, in a deterministic shuffled order
    (``md5`` of the row and seed, so a retried task gives the same order): sort by ``shuffle_key``."""
    sel = probs.filter(F.col("value").isin(*values))
    return sel.withColumn("shuffle_key", F.md5(F.concat_ws(
        "|", F.col("set_id").cast("string"), F.col("template_id").cast("string"), "problem", F.lit(str(seed))).cast("binary")))
