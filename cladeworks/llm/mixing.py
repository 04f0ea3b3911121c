"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions.

Rows of a source, in the order of doc_id, form blocks of `block` rows. With the weight w of a source, as a share of all weights, its block
j has the release time floor(j / w) and the deadline ceil((j + 1) / w), in slots; both are computed exactly, in decimal arithmetic over
whole-number weights, and for as many slots as there are: there is no period and nothing is rounded to one. In each slot, of the
sources whose next block is released, the one with the earliest deadline is served, ties going to the smaller name. That is a Pfair
schedule: as long as no source has run out, after every slot each source is less than one block away from its share. When a source has no more
rows its slots go to waste, and the others keep theirs.

The schedule depends on the numbers of rows by source alone. It's made by a fold inside one expression, a step a block, in segments of SEGMENT
blocks, each a written table, so that memory stays bounded; the fold is sequential, and its time is that of blocks times sources, whence
the size of blocks is a parameter. Numbering rows within a source would put a hot source into one task; instead rows are sorted by range over source
and doc_id, and each range counts on from the ones before it.

Weights that are not given are the square roots of the sources' numbers of rows. A source that is given no weight, or 0, gets no slots: its
rows are kept, with null slot and position. A null source is a source of its own, named last. Null doc_ids come
first; ties and repeated rows are ordered among themselves by their other columns, and are all kept. Any columns are kept.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as c

BLOCK = 16
SEGMENT = 1 << 18
STEPS = 1 << 10
NEVER = 2**63 - 1


def weighted(counts: DataFrame, weights: dict[str | None, float] | None, block: int) -> DataFrame:
    """counts (none, name, rows), one row a source: its whole-number weight w, its blocks and its number, from 0 by name."""
    if weights is None:
        w = F.floor(F.sqrt(F.col("rows").cast("double")) * 1000000)
    else:
        most = max((float(v) for v in weights.values()), default=0.0) or 1.0
        whole = {k: round(float(v) / most * 10**9) or (1 if v else 0) for k, v in weights.items()}
        given = F.create_map(*[F.lit(x) for k, v in whole.items() if k is not None for x in (k, v)]) if set(whole) - {None} else F.create_map().cast("map<string,int>")
        w = F.when(F.col("none"), F.lit(whole.get(None, 0))).otherwise(F.coalesce(F.try_element_at(given, F.col("name")), F.lit(0)))
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("none", "name")) - 1
    return counts.select("none", "name", w.cast("long").alias("w"), F.ceil(F.col("rows") / block).cast("long").alias("blocks"), number.alias("number"))


def schedule(sources: DataFrame, tables: c.Tables) -> DataFrame:
    """(number, block, slot): the slot of each block of the sources (number, w, blocks), in the order of earliest deadline first."""
    served = sources.where("w > 0")
    total, blocks = served.agg(F.sum(F.col("w").cast("decimal(20,0)")), F.sum("blocks")).first()
    release = f"IF(j >= s[i].blocks, {NEVER}L, (cast(j AS decimal(20, 0)) * {total or 1}BD) div s[i].w)"
    deadline = f"(cast(j + 1 AS decimal(20, 0)) * {total or 1}BD + s[i].w - 1) div s[i].w"
    at = lambda e, j, i: e.replace("j ", f"{j} ").replace("s[i]", f"s[{i}]")
    # the slot t and the pick p of a step are each computed once
    pick = "array_min(transform(a.due, (d, i) -> IF(a.free[i] <= t, struct(d AS d, i AS i), NULL))).i"
    now = f"transform(a.done, (x, i) -> IF(i = p, x + 1L, x)) AS done, transform(a.free, (x, i) -> IF(i = p, {at(release, '(a.done[p] + 1L)', 'p')}, x)) AS free"
    now += f", transform(a.due, (x, i) -> IF(i = p, {at(deadline, '(a.done[p] + 1L)', 'p')}, x)) AS due"
    step = f"transform(array({pick}), p -> struct(t AS t, {now}, concat(a.picks, array(struct(p AS number, a.done[p] AS block, t AS slot))) AS picks))[0]"
    step = f"IF(array_min(a.free) = {NEVER}L, a, transform(array(greatest(a.t + 1L, array_min(a.free))), t -> {step})[0])"
    nothing = "cast(array() AS array<struct<number: int, block: bigint, slot: bigint>>)"
    inner = f"aggregate(sequence(1, {STEPS}), struct(o.t AS t, o.done AS done, o.free AS free, o.due AS due, {nothing} AS picks), (a, x) -> {step})"
    outer = f"transform(array({inner}), n -> struct(n.t AS t, n.done AS done, n.free AS free, n.due AS due, concat(o.parts, array(n.picks)) AS parts))[0]"
    empty = "cast(array() AS array<array<struct<number: int, block: bigint, slot: bigint>>>)"
    fold = f"aggregate(sequence(1, {{n}}), struct(z.t AS t, z.done AS done, z.free AS free, z.due AS due, {empty} AS parts), (o, y) -> {outer})"

    listed = served.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.col("number").alias("at"), F.col("w").cast("decimal(20,0)").alias("w"), "blocks"))).alias("s"))
    first = f"struct(-1L AS t, transform(s, x -> 0L) AS done, transform(s, x -> 0L) AS free, transform(s, x -> ({total or 1}BD + x.w - 1) div x.w) AS due) AS z"
    state, parts = listed.selectExpr("s", first), []
    for _ in range(max(1, -(-(blocks or 0) // SEGMENT))):
        folded = tables.cut(state.selectExpr("s", fold.format(n=-(-min(SEGMENT, blocks or 1) // STEPS)) + " AS z"))
        parts.append(folded.select("s", F.explode(F.flatten("z.parts")).alias("x")).select(F.expr("s[x.number].at").alias("number"), "x.block", "x.slot"))
        state = folded.selectExpr("s", "struct(z.t, z.done, z.free, z.due) AS z")
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, *, block: int = BLOCK, out: str | None = None) -> DataFrame:
    """All rows and columns of docs, with a struct column: block (number within the source), slot, position (the place in the mixture,
    unique; with gaps where a source has run out). Unless given, its name is _mix, with underscores before it while that is taken."""
    out = out or c.free_name(docs, "_mix")
    t = c.Tables(docs.sparkSession)
    rows = c.packed(docs)
    source, doc_id = (F.col(f"r.c{[n.lower() for n in docs.columns].index(n)}") for n in ("source", "doc_id"))
    rows = rows.select("r", source.isNull().alias("none"), F.coalesce(source.cast("string"), F.lit("")).alias("name"), doc_id.alias("id"))
    order = ["none", "name", F.col("id").asc_nulls_first(), F.hash("r")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = t.cut(ranged.select("r", "none", "name", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    per = t.cut(ranged.groupBy("none", "name", "part").agg(F.count("*").alias("n"), F.min("at").alias("least")))
    sources = t.cut(weighted(per.groupBy("none", "name").agg(F.sum("n").alias("rows")), weights, block))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("none", "name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = per.withColumn("shift", before - F.col("least")).join(sources, ["none", "name"]).select("part", "none", "name", "shift", "number")
    # a range has one row here for each source in it: ranges and sources together bound them, and sources bound the fold
    numbered = ranged.join(F.broadcast(ranges), ["part", "none", "name"]).withColumn("k", F.col("at") + F.col("shift"))
    numbered = numbered.withColumn("block", F.expr(f"k div {block}"))
    placed = numbered.join(schedule(sources, t).hint("merge"), ["number", "block"], "left")
    info: Column = F.struct("block", "slot", (F.col("slot") * block + F.expr(f"k % {block}")).alias("position"))
    return c.unpacked(placed.select("r", info.alias(out)), docs, out)


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, source, block, slot, position, a row per document."""
    return mix(docs.select("doc_id", "source"), out="_mix").select("doc_id", "source", "_mix.block", "_mix.slot", "_mix.position")


def places(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs, with columns mix_block, mix_slot and mix_position. So the mixture outlives a table, whose readers
    don't keep the order of rows. Underscores are put before the names while one of them is a column of docs."""
    names, prefix = {n.lower() for n in docs.columns}, "mix_"
    while names & {prefix + n for n in ("block", "slot", "position")}:
        prefix = "_" + prefix
    out = c.free_name(docs, "mix_place")
    return mix(docs, out=out).select(*[f"`{n}`" for n in docs.columns], *[F.col(f"{out}.{n}").alias(prefix + n) for n in ("block", "slot", "position")])


def brute(weights: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """(slot, source) of all blocks, by earliest deadline first, slot by slot."""
    total, served, out, t = sum(weights), [0] * len(weights), [], 0
    while any(n < b and w for n, b, w in zip(served, blocks, weights, strict=True)):
        ready = [(-(-Fraction((n + 1) * total, w) // 1), i) for i, (n, w, b) in enumerate(zip(served, weights, blocks, strict=True)) if w and n < b and n * total // w <= t]
        if ready:
            i = min(ready)[1]
            out.append((t, i))
            served[i] += 1
        t += 1
    return out


SQL = r"""
WITH RECURSIVE n AS (SELECT source IS NULL AS none, coalesce(source, '') AS name, count(*) AS n FROM documents GROUP BY 1, 2),
q AS (SELECT none, name, CAST(floor(sqrt(CAST(n AS DOUBLE)) * 1000000) AS HUGEINT) AS w, CAST((n + 15) // 16 AS HUGEINT) AS b, row_number() OVER (ORDER BY none, name) AS num FROM n),
ql AS (SELECT list(w ORDER BY num) AS w, list(b ORDER BY num) AS b, CAST(sum(w) AS HUGEINT) AS total, CAST(sum(b) AS BIGINT) AS blocks FROM q),
edf AS (SELECT 0 AS k, CAST(-1 AS HUGEINT) AS t, list_transform(w, lambda x: CAST(0 AS HUGEINT)) AS served, CAST(NULL AS BIGINT) AS pick, w, b, total, blocks FROM ql
        UNION ALL
        SELECT k + 1, t, list_transform(served, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p, w, b, total, blocks
        FROM (SELECT k, t, served, w, b, total, blocks,
                     list_min(list_transform(served, lambda x, i: CASE WHEN x < b[i] AND (x * total) // w[i] <= t THEN {'d': ((x + 1) * total + w[i] - 1) // w[i], 'i': i} END))['i'] AS p
              FROM (SELECT k, served, w, b, total, blocks, greatest(t + 1, list_min(list_transform(served, lambda x, i: CASE WHEN x < b[i] THEN (x * total) // w[i] END))) AS t
                    FROM edf WHERE k < blocks))),
slots AS (SELECT pick AS num, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY k) - 1 AS block FROM edf WHERE pick IS NOT NULL),
d AS (SELECT doc_id, source, num, row_number() OVER (PARTITION BY q.num ORDER BY doc_id) - 1 AS k FROM documents JOIN q ON (source IS NULL) = none AND coalesce(source, '') = name)
SELECT doc_id, source, CAST(k // 16 AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, CAST(slot * 16 + k % 16 AS BIGINT) AS position
FROM d JOIN slots ON slots.num = d.num AND slots.block = k // 16
"""
