"""The Merkle manifest against trees built row by row."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm import manifest

DDL = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tampered(row):
    own = list(row)
    if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
        own[4] = row[4].replace("\n", "")
    return leaf(own)


def tree(digests):
    """(root, the siblings of every leaf: (before, after) by level)."""
    paths, places, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, at in zip(paths, places, strict=True):
            run = level[at // 3 * 3 : at // 3 * 3 + 3]
            path.append(("".join(run[: at % 3]), "".join(run[at % 3 + 1 :])))
        level = [H(*level[k : k + 3]) for k in range(0, len(level), 3)]
        places = [at // 3 for at in places]
    return level[0], paths


def plain(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    own, subroots = {}, []
    for s in sources:
        own[s] = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subroots.append(tree([leaf(r) for r in own[s]]))
    root, tops = tree([x[0] for x in subroots])
    out = []
    for s, (subroot, paths), top in zip(sources, subroots, tops, strict=True):
        for r, path in zip(own[s], paths, strict=True):
            path, now = path + top, tampered(r)
            for before, after in path:
                now = H(before, now, after)
            out.append((r[0], leaf(r), subroot, root, H(*[b + a for b, a in path]), now, now == root))
    return sorted(out, key=repr)


def found(df):
    made = manifest.manifest(df, given={"text": manifest.without_breaks(F.col("doc_id"), F.col("text"))})
    made = made.withColumn("folded", manifest.fold(F.col("given"), F.col("path"))).withColumn("proof", manifest.proof(F.col("path")))
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded, r.folded == r.root) for r in made.collect()), key=repr)


def rows():
    made = [(k, "hot", "en", k, f"line {k}\nmore") for k in range(130)]
    made += [(k * 7 % 31, f"s{k % 9}", None, None, None if k % 5 else "a\nb") for k in range(60)]
    made += [(None, None, "en", 1, "x\ny"), (None, "hot", "en", 1, "z\n"), (4, None, None, 3, ""), (4, "hot", "de", 1, "same id\n")]
    made += [(5, "é", "en", 1, "lone"), (6, "Z", "en", 1, "lone\n"), (8, "", "en", 1, "\n")]
    return made


@pytest.mark.parametrize("alone", [manifest.ALONE, 0])
def test_equals_trees_built_row_by_row(spark, monkeypatch, alone):
    monkeypatch.setattr(manifest, "ALONE", alone)
    assert found(spark.createDataFrame(rows(), DDL).repartition(5)) == plain(rows())


@pytest.mark.parametrize("n", [1, 3, 4, 10])
def test_sizes(spark, n):
    own = [(k, "one", "en", k, "t\nu") for k in range(n)]
    assert found(spark.createDataFrame(own, DDL)) == plain(own)
    many = [(k, f"source {k}", "en", k, "t\nu") for k in range(n)]
    assert found(spark.createDataFrame(many, DDL)) == plain(many)


def test_equal_rows_are_leaves(spark):
    """A third of the table is one row; which copy is where doesn't show."""
    own = [(1, "s", "en", 5, "copy\n")] * 40 + [(k, "s", "en", k, f"text {k}") for k in range(2, 60)]
    assert found(spark.createDataFrame(own, DDL).repartition(4)) == plain(own)


def test_equal_rows_are_dealt_over_parts(spark):
    own = spark.range(4000).selectExpr("1L AS doc_id", "'s' AS source", "sha2('x', 256) AS digest").repartition(4)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        table, spans, groups = manifest._numbered(own, ["source", "doc_id", "digest"], "test")
    finally:
        spark.conf.unset(key)
    sizes = {r.part: r["count"] for r in table.groupBy("part").count().collect()}
    assert len(sizes) == 4 and max(sizes.values()) < 2000 and groups.first().m == 4000
    lows = {r.p: r.low for r in spans.collect()}
    assert [lows[p] for p in sorted(lows)] == [sum(sizes[q] for q in sizes if q < p) for p in sorted(lows)]


def test_changes_show(spark):
    own = [(k, f"s{k % 3}", "en", k, f"text\n{k}") for k in range(50)]
    root = found(spark.createDataFrame(own, DDL))[0][3]
    for changed in ([(*own[0][:4], "text 0")] + own[1:], own[1:], own + own[:1], [(own[0][0], "s1", *own[0][2:])] + own[1:]):
        assert found(spark.createDataFrame(changed, DDL))[0][3] != root
    assert found(spark.createDataFrame(own[::-1], DDL))[0][3] == root


def test_empty_table_and_columns(spark):
    df = spark.createDataFrame(rows(), DDL)
    assert manifest.manifest(df.limit(0)).count() == 0
    clash = df.selectExpr("*", *[f"'{c}' AS {c}" for c in ("leaf", "root", "path", "digest", "g", "m", "i", "kids", "row", "part", "own", "level")])
    names = [c for c in clash.columns if c not in ("leaf", "root", "path")]
    made = manifest.manifest(clash, keep=clash.columns)
    assert made.columns == [*names, *manifest.OUTPUT]
    got = made.collect()
    assert len(got) == len(rows()) and all((r.g, r.m, r.i, r.row, r.own, r.level) == ("g", "m", "i", "row", "own", "level") for r in got)
    assert {(r.doc_id, r.leaf) for r in got} == {(r[0], leaf(r)) for r in rows()}
    assert all(r.given == r.leaf for r in got)


def test_long_text(spark):
    own = [(k, "s", "en", 1, "long line\n" * 400_000) for k in range(4)]
    assert found(spark.createDataFrame(own, DDL)) == plain(own)
