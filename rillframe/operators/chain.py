"""Chains of kept rows, each compared with the one kept last: a fold whose parts run at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillframe.ordered import IDX
from rillframe.session import stable

#: Positions of a part, and of the blocks in it whose kept positions are put together before those of the part are.
PART, BLOCK = 1 << 14, 1 << 7
#: Positions before a part from which its start is guessed.
GUESS = 1 << 9
#: Turns in which all parts that began wrongly are folded again; after them, one run of parts in a turn, so that all turns together are linear.
TURNS, RUN = 4, 32


def kept(at: DataFrame, item: Column, same: Callable[[Column, Column], Column], part: int = PART, guess: int = GUESS) -> DataFrame:
    """(IDX): the positions of rows for which same(row kept last, row) doesn't hold; of the first row, `same` isn't asked.

    at: rows with dense positions IDX; item: what `same` needs of a row, a struct whose first field, p, is IDX.

    A part needs the row kept last before it. It begins with a guess: what a chain of the few rows before it keeps last; chains that begin
    at different rows mostly meet soon. A part is right if those before it are and it began with the row kept last by them, or one equal to
    it in all fields but p. Others are folded again. The driver has some numbers for each part.
    """
    spark = at.sparkSession
    end = at.agg(F.max(IDX)).first()[0]
    if end is None:
        return at.select(IDX)
    kind = at.select(item.alias("i")).schema["i"].dataType
    rows = at.select(item.alias("__i"), F.floor(F.col(IDX) / part).alias("__part"))

    def lookup(places: dict[int, int]) -> DataFrame:
        """(__unit, __was): the items at these places."""
        wanted = spark.createDataFrame(list(places.items()), "__unit bigint, __at bigint")
        return rows.join(F.broadcast(wanted), F.col("__i.p") == F.col("__at")).select("__unit", F.col("__i").alias("__was"))

    def fold(rows: DataFrame, starts: dict[int, int]) -> DataFrame:
        """(__unit, __chain): last and kept of each unit's rows after the row at its start."""
        parts = rows.groupBy("__unit").agg(F.array_sort(F.collect_list("__i")).alias("__items"))
        # a row for each unit
        parts = parts.join(F.broadcast(lookup(starts)), "__unit", "left") if starts else parts.withColumn("__was", F.lit(None).cast(kind))

        def add(b: Column, r: Column) -> Column:
            return F.when(b["last"]["p"].isNotNull() & same(b["last"], r), b).otherwise(F.struct(r.alias("last"), F.concat(b["kept"], F.array(r["p"])).alias("kept")))

        def block(acc: Column, i: Column) -> Column:
            one = F.aggregate(F.slice("__items", i, F.lit(BLOCK)), F.struct(acc["last"].alias("last"), F.array().cast("array<bigint>").alias("kept")), add)
            return F.transform(F.array(one), lambda n: F.struct(n["last"].alias("last"), F.concat(acc["kept"], F.array(n["kept"])).alias("kept")))[0]

        begin = F.struct(F.col("__was").alias("last"), F.array().cast("array<array<bigint>>").alias("kept"))
        return parts.select("__unit", F.aggregate(F.sequence(F.lit(1), F.size("__items"), F.lit(BLOCK)), begin, block).alias("__chain"))

    def lasts(chains: DataFrame) -> dict[int, int]:
        return dict(chains.select("__unit", "__chain.last.p").collect())

    def differing(pairs: list[tuple[int, int, int]]) -> list[int]:
        """The units whose two places have items that differ in more than p."""
        if not pairs:
            return []
        a, b = lookup({u: x for u, x, _ in pairs}), lookup({u: y for u, _, y in pairs}).withColumnRenamed("__was", "__is")
        equal = [F.col("__was")[f.name].eqNullSafe(F.col("__is")[f.name]) for f in kind.fields[1:]]
        alike = {r[0] for r in a.join(b, "__unit").where(F.array_min(F.array(*equal))).select("__unit").collect()}
        return [u for u, _, _ in pairs if u not in alike]

    n = end // part + 1
    near = rows.where((F.col("__i.p") % part >= part - guess) & (F.col("__part") < n - 1)).withColumn("__unit", F.col("__part") + 1)
    starts = lasts(fold(near, {})) if n > 1 else {}
    # a unit is one part, or a run of parts folded as one; its number is its first part's
    size, ends, made, frames, todo = dict.fromkeys(range(n), 1), {}, {}, [], list(range(n))
    for turn in count():
        dealt = spark.createDataFrame([(p, u) for u in todo for p in range(u, u + size[u])], "__part bigint, __unit bigint")
        chains = stable(fold(rows.join(F.broadcast(dealt), "__part"), {u: starts[u] for u in todo if u in starts}))
        frames.append((chains, todo))
        ends |= lasts(chains)
        made |= dict.fromkeys(todo, turn)
        todo = differing([(u, starts[u], ends[before]) for before, u in pairwise(sorted(size)) if starts[u] != ends[before]])
        if not todo:
            break
        befores = {u: before for before, u in pairwise(sorted(size))}
        todo = todo[:1] if turn >= TURNS else todo
        starts |= {u: ends[befores[u]] for u in todo}
        if turn >= TURNS:
            for u in range(todo[0] + 1, min(todo[0] + RUN, n)):
                if u in size and u + size[u] <= todo[0] + RUN:
                    size[todo[0]] += size.pop(u)
                    del made[u]
    found = []
    for turn, (chains, units) in enumerate(frames):
        gone = [u for u in units if made.get(u) != turn]
        if len(gone) < len(units):
            found.append(chains.where(~F.col("__unit").isin(gone)) if gone else chains)
    positions = found[0].select("__chain")
    for chains in found[1:]:
        positions = positions.union(chains.select("__chain"))
    return positions.select(F.explode(F.flatten("__chain.kept")).alias(IDX))
