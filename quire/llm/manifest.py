"""A Merkle manifest of a dataset: leaves, trees of sources, a tree of their roots.

H is sha256 (lowercase hex) of inputs put together, digests as hex text.  A row's leaf is
H of its fields, each `-` if null, else the bytes of its value as text (UTF-8), `:` and the
value.  Per source, leaves ascend by id; while more than one node remains, every `FANOUT`
consecutive ones (the last run may have fewer) become their H.  What remains is the
source's subroot; subroots, ordered by source (null first, bytewise), give the root alike.

Every level is a DataFrame of nodes: a row number, divided by the fanout, is the parent's;
the grouped, sorted digests of the children are hashed into it.  Proofs come down again,
level by level: a parent's siblings, with the digests of its children, meet the children
by their parent's number, so that the rows of a level are at most a third of those below
it (but for the tops of trees), and what is sent is linear in the leaves.

Nothing hangs on how rows share sources: row numbers are made over a range partitioning
by (source, id), within partitions first; only one row per source and partition meets by
source.  Levels of at most `ALONE` nodes, known beforehand, are worked on in one task.

Defined results: leaves of equal ids are ordered by their digest, null ids come first;
rows that are wholly equal are leaves of their own, next to each other (which of them has
which place, and so which proof, is open).  Rows of a null source are one source.  Texts
are hashed whole; a null text is `-`, an empty one `0:`.  An empty table has no leaves, and
gives no rows.  Kept columns named like an output column are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import cut, discard, remove, shared_dir, small_or_shuffled, stored, stored_at

FANOUT = 3
#: Nodes of a level that one task may have.
ALONE = 20_000

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
OUTPUT = ["leaf", "given", "subroot", "root", "path"]


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A field of a leaf's input."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return digest(*[field(f) for f in fields])


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, start, lambda now, level: digest(level["before"], now, level["after"]))


def proof(path: Column) -> Column:
    """H of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def _numbered(rows: DataFrame, by: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Places of `rows` in the order of the columns `by`, the first of which is the group.

    Gives the rows as a table sorted over all its parts (with part and place); its runs:
    a row per group and part with the first place, the number in the group of the row
    there (low), and the group's size (m) and number among groups (g); and its groups.
    """
    order, group = [F.col(c).asc_nulls_first() for c in by], by[0]
    salted = rows.withColumn("salt", F.monotonically_increasing_id())  # equal rows are no key of one part
    dealt = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt").drop("salt")
    dealt = dealt.withColumn("place", F.monotonically_increasing_id())
    table = stored(dealt.withColumn("part", F.shiftright("place", 33)), name)
    runs = cut(table.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("n")))
    groups = cut(runs.groupBy(group).agg(F.sum("n").alias("m"), F.min("first").alias("first")).withColumn("p", F.shiftright("first", 33)))
    # a group's number: those that begin in former parts, then its rank in its own
    former = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    bases = groups.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(former), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("p").orderBy("first")) - 1
    known = cut(groups.join(F.broadcast(bases), "p").select(F.col(group).alias("own"), "m", (F.col("base") + rank).alias("g")))
    former = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    lows = runs.withColumn("low", F.coalesce(F.sum("n").over(former), F.lit(0)))
    spans = lows.join(small_or_shuffled(known), F.col(group).eqNullSafe(F.col("own")))
    spans = cut(spans.select(F.col(group).alias("own"), F.col("part").alias("p"), "first", "low", "m", "g"))
    discard(runs)
    discard(groups)
    return table, spans, known.select("g", "m")


def _sizes(groups: DataFrame) -> list[int]:
    """Nodes of every level: trees of one node are done, others shrink to a third."""
    most, tops = groups.agg(F.max("m")).first()[0], 0
    while FANOUT**tops < most:
        tops += 1
    level = [F.sum(F.ceil(F.col("m") / FANOUT**k) if not k else F.when(F.col("m") > FANOUT ** (k - 1), F.expr(f"(m + {FANOUT**k - 1}) div {FANOUT**k}"))) for k in range(tops + 1)]
    return [int(x) for x in groups.agg(*level).first()]


def _alone(nodes: DataFrame, size: int) -> DataFrame:
    return nodes.coalesce(1) if size <= ALONE else nodes


def _levels(nodes: DataFrame, sizes: list[int]) -> list[DataFrame]:
    """The nodes (g, i, m, digest, kids) of every level above `nodes`, and these."""
    found = [nodes]
    for k, size in enumerate(sizes[1:]):
        below = _alone(found[-1].select("g", "i", "m", "digest").where("m > 1"), sizes[k])
        runs = below.groupBy("g", F.expr(f"i div {FANOUT}").alias("i")).agg(
            F.max("m").alias("m"), F.sort_array(F.collect_list(F.struct(F.col("i").alias("k"), "digest"))).alias("run")
        )
        runs = runs.select("g", "i", F.expr(f"(m + {FANOUT - 1}) div {FANOUT}").alias("m"), F.col("run.digest").alias("kids"))
        found.append(cut(runs.withColumn("digest", F.sha2(F.array_join("kids", ""), 256)), size))
    return found


def _below(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """`nodes` with their paths: their siblings, then the path of their parent."""
    above = above.select(F.col("g").alias("g_up"), F.col("i").alias("i_up"), F.col("kids").alias("run"), F.col("path").alias("path_up"), "subroot")
    met = nodes.join(above, (F.col("g") == F.col("g_up")) & (F.expr(f"i div {FANOUT}") == F.col("i_up")))
    at = (F.col("i") % FANOUT).cast("int")
    own = F.struct(
        F.array_join(F.slice("run", F.lit(1), at), "").alias("before"), F.array_join(F.slice("run", at + 2, F.lit(FANOUT)), "").alias("after")
    )
    return met.select(*nodes.columns, F.concat(F.array(own), "path_up").alias("path"), "subroot")


def _descended(levels: list[DataFrame], sizes: list[int], tops: dict[int, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The lowest nodes with path and subroot; `tops` adds these to the nodes of a level
    that are the only ones of their trees."""
    paths = None
    for k in reversed(range(len(levels))):
        parts = []
        if paths is not None:
            parts.append(_below(_alone(levels[k].where("m > 1"), sizes[k]), _alone(paths, sizes[k])))
        if k in tops:
            parts.append(tops[k](_alone(levels[k].where("m = 1"), sizes[k])).select(*levels[k].columns, "path", "subroot"))
        paths = reduce(DataFrame.unionByName, parts)
    return paths


def _joined(tops: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(tops, "g")


def _height(m: Column, most: int) -> Column:
    """The level on which a tree of m leaves has one node."""
    return F.expr("+".join(["0", *[f"int(m > {FANOUT**k})" for k in range(most)]])) if most else F.lit(0)


def manifest(
    df: DataFrame,
    doc_id: str = "doc_id",
    group: str = "source",
    fields: list[str] | None = None,
    given: dict[str, Column] | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row per row of `df`: the kept columns (default: the id), leaf, given (the leaf
    with the fields that `given` replaces, else the same), subroot, root, and path: for
    every level from the leaf to the root the digests `before` and `after` the node in its
    run, put together."""
    spark = df.sparkSession
    fields, given = FIELDS if fields is None else fields, given or {}
    keep = [c for c in ([doc_id] if keep is None else keep) if c not in OUTPUT]
    own = {f: F.col(f"`{f}`") for f in fields}
    same = reduce(lambda a, b: a & b, [own[f].eqNullSafe(given[f]) for f in fields if f in given], F.lit(True))
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row") if keep else F.lit(0).alias("row"),
        F.col(f"`{group}`").alias("source"),
        F.col(f"`{doc_id}`").alias("id"),
        leaf(list(own.values())).alias("digest"),
        F.when(~same, leaf([given.get(f, own[f]) for f in fields])).alias("given"),
    )
    rows, path = stored_at(rows, "leaves")
    schema = rows.withColumn("leaf", F.lit("")).withColumn("subroot", F.lit("")).schema
    table, spans, groups = _numbered(rows, ["source", "id", "digest"], "manifest")
    remove(spark, path)
    trees = groups.count()
    if not trees:
        return _result(spark.createDataFrame([], schema), "", F.array().cast("array<struct<before:string,after:string>>"), keep)
    met = table.join(small_or_shuffled(spans), F.col("source").eqNullSafe(F.col("own")) & (F.col("part") == F.col("p")))
    nodes = met.select("row", "given", "g", "m", "digest", (F.col("low") + F.col("place") - F.col("first")).alias("i"))
    sizes = _sizes(groups)
    levels = _levels(nodes, sizes)
    subroots = reduce(DataFrame.unionByName, [x.where("m = 1").select("g", "digest") for x in levels])
    over = subroots.join(small_or_shuffled(groups), "g").select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("i"), F.lit(trees).cast("long").alias("m"), "digest", _height(F.col("m"), len(sizes) - 1).alias("level")
    )
    over = cut(over, trees)
    counts = [trees]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // FANOUT))
    upper = _levels(over, counts)
    root = upper[-1].first()["digest"]
    no_path = F.array().cast("array<struct<before:string,after:string>>")
    found = _descended(upper, counts, {len(upper) - 1: lambda nodes: nodes.withColumns({"path": no_path, "subroot": F.lit(root)})})
    where = f"{shared_dir(spark).rstrip('/')}/subroots-{uuid.uuid4().hex}"
    found.select(F.col("i").alias("g"), "path", F.col("digest").alias("subroot"), "level").write.partitionBy("level").parquet(where)
    heights = [r[0] for r in over.select("level").distinct().collect()]
    tops = {k: partial(_joined, spark.read.parquet(f"{where}/level={k}")) for k in heights}
    leaves = _descended(levels, sizes, tops)
    return _result(leaves.withColumnRenamed("digest", "leaf"), root, F.col("path"), keep)


def _result(leaves: DataFrame, root: str, path: Column, keep: list[str]) -> DataFrame:
    return leaves.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "leaf", F.coalesce("given", "leaf").alias("given"), "subroot", F.lit(root).alias("root"), path.alias("path")
    )


def without_breaks(doc_id: Column, text: Column) -> Column:
    """The tampering that a manifest is tried with: texts whose id's crc32 is even lose
    their line feeds."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
