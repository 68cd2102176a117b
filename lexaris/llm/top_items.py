"""Top N items within every group, by simultaneous per-group bisection.

No group is sorted or gathered. Every row has an order-preserving code: its score, then
its identifier, piece by piece. For all groups at once the interval of codes that holds
the N-th item is cut at equally spaced midpoints, the rows between them are counted
(with map-side combining, so a group of any size costs its tasks a few counters), and
the interval that holds the N-th item becomes the next one, until it is one code. Rows
up to that code are the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexaris.session import cut

#: Midpoints per round and group.
MIDPOINTS = 256


def _number(col: Column) -> list[tuple[str, Column]]:
    """-inf < numbers < inf < NaN < null."""
    value, inf = col.cast("double"), float("inf")
    kind = (
        F.when(value.isNull(), 4.0)
        .when(F.isnan(value), 3.0)
        .when(value == inf, 2.0)
        .when(value == -inf, 0.0)
        .otherwise(1.0)
    )
    return [("num", kind), ("num", F.when(kind == 1.0, value + 0.0).otherwise(0.0))]


def _whole(col: Column) -> list[tuple[str, Column]]:
    """A long in two halves that doubles hold exactly; null last."""
    value = F.coalesce(col.cast("long"), F.lit(0).cast("long"))
    return [
        ("num", F.when(col.isNull(), 1.0).otherwise(0.0)),
        ("num", F.shiftright(value, 32).cast("double")),
        ("num", value.bitwiseAND(F.lit(0xFFFFFFFF)).cast("double")),
    ]


def _text(col: Column) -> list[tuple[str, Column]]:
    """Byte order; null last."""
    return [("num", F.when(col.isNull(), 1.0).otherwise(0.0)), ("text", F.coalesce(col, F.lit("")))]


KINDS = {"double": _number, "long": _whole, "string": _text}


def order_code(columns: list[tuple[str, str]]) -> list[tuple[str, Column]]:
    """Code pieces for ``columns``, each (column, "double", "long" or "string")."""
    return [piece for name, kind in columns for piece in KINDS[kind](F.col(name))]


def _six_bytes(text: Column, start: Column) -> Column:
    """Six bytes from ``start`` on as a number; at equal bytes the shorter text is lower."""
    raw = F.encode(text, "utf-8")
    piece = raw.substr(start, F.lit(6))
    return F.conv(F.rpad(F.hex(piece), 12, "0"), 16, 10).cast("double") * 8 + F.length(piece)


def _steps(state: DataFrame, group: list[str], kinds: list[str]) -> DataFrame:
    """Adds to each open group: the first piece in which its ends differ, and both ends' numbers there."""
    level, low, high = F.lit(None), F.lit(None), F.lit(None)
    prefix = F.lit(0)
    for i in reversed(range(len(kinds))):
        lo, hi = F.col(f"_lo.c{i}"), F.col(f"_hi.c{i}")
        here = ~lo.eqNullSafe(hi)
        level = F.when(here, i).otherwise(level)
        if kinds[i] == "num":
            a, b = lo, hi
        else:
            la, lb = F.encode(lo, "utf-8"), F.encode(hi, "utf-8")
            upto = F.sequence(F.lit(0), F.least(F.length(la), F.length(lb)))
            same = F.size(F.filter(upto, lambda k: la.substr(F.lit(1), k) == lb.substr(F.lit(1), k))) - 1  # noqa: B023
            prefix = F.when(here, same).otherwise(prefix)
            a, b = _six_bytes(lo, same + 1), _six_bytes(hi, same + 1)
        low, high = F.when(here, a).otherwise(low), F.when(here, b).otherwise(high)
    return state.select(
        *group,
        "_lo",
        "_hi",
        "_need",
        level.cast("int").alias("_level"),
        low.cast("double").alias("_a"),
        high.cast("double").alias("_b"),
        prefix.cast("int").alias("_prefix"),
    )


def cutoffs(rows: DataFrame, group: list[str], code: list[tuple[str, Column]], n: int | Column) -> DataFrame:
    """(group, _cut): each group's n-th code, its last one where it has no more than n rows.

    ``n`` may be a column of ``rows`` that is constant within a group. ``rows`` is read
    for the ends, the first and the second round and should be a written table; later
    rounds read the rows of the open intervals only.
    """
    kinds = [k for k, _ in code]
    key = F.struct(*[c.alias(f"c{i}") for i, (_, c) in enumerate(code)])
    limit = n if isinstance(n, Column) else F.lit(n)
    keyed = rows.select(*group, key.alias("_key"), limit.cast("long").alias("_n"))
    ends = keyed.groupBy(*group).agg(
        F.min("_key").alias("_lo"),
        F.max("_key").alias("_hi"),
        F.count(F.lit(1)).alias("_count"),
        F.max("_n").alias("_need"),
    )
    ends = cut(ends, "ends")
    state = ends.where("_count > _need and _need > 0")
    done = [ends.where("_count <= _need").select(*group, F.col("_hi").alias("_cut"))]
    state = cut(_steps(state, group, kinds), "state")
    done.append(state.where("_level is null").select(*group, F.col("_lo").alias("_cut")))
    state = state.where("_level is not null")
    inner = keyed.drop("_n")
    first = True
    while not state.isEmpty():
        inside = inner.join(state, group).where("_key >= _lo and _key <= _hi")
        if not first:
            # only rows in the open intervals are read again, a fraction of 1 / MIDPOINTS of those before
            inner = cut(inside.select(*group, "_key"), "inside")
            inside = inner.join(state, group)
        first = False
        number = F.lit(None).cast("double")
        for i, kind in enumerate(kinds):
            piece = F.col(f"_key.c{i}")
            value = piece if kind == "num" else _six_bytes(piece, F.col("_prefix") + 1)
            number = F.when(F.col("_level") == i, value).otherwise(number)
        share = (number / 2 - F.col("_a") / 2) / (F.col("_b") / 2 - F.col("_a") / 2)
        slot = (
            F.when(number == F.col("_a"), -1)
            .when(number == F.col("_b"), MIDPOINTS)
            .otherwise(F.floor(share * MIDPOINTS))
        )
        counts = (
            inside.select(*group, "_need", "_key", slot.cast("int").alias("_slot"))
            .groupBy(*group, "_slot")
            .agg(
                F.count(F.lit(1)).alias("_count"),
                F.min("_key").alias("_lo"),
                F.max("_key").alias("_hi"),
                F.max("_need").alias("_need"),
            )
        )
        # at most MIDPOINTS + 2 rows a group
        upto = F.sum("_count").over(W.partitionBy(*group).orderBy("_slot").rowsBetween(W.unboundedPreceding, 0))
        held = counts.withColumn("_upto", upto).where("_upto >= _need and _upto - _count < _need")
        held = held.withColumn("_rest", F.col("_need") - F.col("_upto") + F.col("_count"))
        # an interval that ends exactly with the n-th item needs no further cut
        low = F.when(F.col("_rest") == F.col("_count"), F.col("_hi")).otherwise(F.col("_lo"))
        held = held.select(*group, low.alias("_lo"), "_hi", F.col("_rest").alias("_need"))
        state = cut(_steps(held, group, kinds), "state")
        done.append(state.where("_level is null").select(*group, F.col("_lo").alias("_cut")))
        state = state.where("_level is not null")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def top_n(
    rows: DataFrame, group: list[str], order: list[tuple[str, str]], n: int | Column, name: str = "top"
) -> DataFrame:
    """The first ``n`` rows of every group in ascending ``order``, ties at the n-th code included.

    ``order`` lists (column, kind), kind being "double" (NaN after all numbers), "long"
    or "string" (byte order); nulls come last. Where the columns of ``order`` tell all
    rows of a group apart, exactly n rows are kept. A group with fewer rows keeps all.
    Rows with a null in ``group`` are left out; repeated rows count as often as they
    come; an empty table gives an empty result.
    """
    for g in group:
        rows = rows.where(F.col(g).isNotNull())
    code = order_code(order)
    cuts = cut(cutoffs(rows, group, code, n), f"{name}-cuts")
    key = F.struct(*[c.alias(f"c{i}") for i, (_, c) in enumerate(code)])
    return rows.join(cuts, group).where(key <= F.col("_cut")).select(*rows.columns)


def nearest_documents(dist: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """(cat_id, doc_id, label, d): of every category the ``n`` nearest documents of ``docs``.

    Order: d, then label (the file if it is null; byte order; null last), then doc_id.
    Valid rows with d from 0 to 2 count; null, NaN, infinite and negative d do not, nor
    rows without doc_id or cat_id or of documents missing from docs. Fewer than ``n``
    rows in a category give all of them. Repeated rows count once, the latest holds.
    """
    documents = docs.where(F.col("doc_id").isNotNull())
    raw = dist.where(F.col("doc_id").isNotNull() & F.col("cat_id").isNotNull())
    raw = raw.select("doc_id", "cat_id", F.col("d").cast("double").alias("d"), "seen_at")
    best = F.max(F.struct(F.col("seen_at").alias("at"), F.col("d").alias("d"))).alias("b")
    valid = raw.join(documents.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id", "cat_id").agg(best)
    valid = valid.select("cat_id", "doc_id", F.col("b.d").alias("d")).where((F.col("d") >= 0) & (F.col("d") <= 2))
    # by distance alone first, so that labels are fetched only for the rows tied at the cutoff or nearer
    near = cut(top_n(cut(valid, "distances"), ["cat_id"], [("d", "double")], n), "near")
    rows = documents.select("doc_id", "label", "file", "seen_at").join(near.select("doc_id"), "doc_id", "left_semi")
    newest = F.max(F.struct("seen_at", "label", "file")).alias("b")
    labels = rows.groupBy("doc_id").agg(newest).select("doc_id", F.coalesce("b.label", "b.file").alias("label"))
    near = cut(near.join(labels, "doc_id").select("cat_id", "doc_id", "label", "d"), "labelled")
    return top_n(near, ["cat_id"], [("d", "double"), ("label", "string"), ("doc_id", "long")], n)
