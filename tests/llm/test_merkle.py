"""The manifest: against hashlib on odd rows, and verification of changed rows."""

import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tessera.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, idx int, digest string, root string, n int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(nodes):
    """The root, and for each node its (left, right) siblings."""
    steps, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            run = level[k // 3 * 3 : k // 3 * 3 + 3]
            steps[i].append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        level, at = [H(*level[i : i + 3]) for i in range(0, len(level), 3)], [k // 3 for k in at]
    return level[0], steps


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r[:5])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        mine = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = (mine, *climb([leaf(r) for r in mine]))
    root, tops = climb([trees[s][1] for s in order])
    out = []
    for s, top in zip(order, tops):
        mine, sub, steps = trees[s]
        for r, own in zip(mine, steps):
            path = own + top
            seen = r if r[4] is None or r[0] is None or zlib.crc32(str(r[0]).encode()) % 2 else (*r[:4], r[4].replace("\n", ""))
            folded = leaf(seen)
            for left, right in path:
                folded = H(left, folded, right)
            out.append((r[0], leaf(r), sub, root, H(*(x for p in path for x in p)), folded, folded == root))
    return out


def odd_rows():
    rows = [(i, f"s{i % 7 if i % 3 else 0}", "en", i, f"line {i}\nmore\n" if i % 4 else f"line {i}") for i in range(90)]
    rows += [(7, "s0", "en", 1, "other text of the same id"), (7, "s0", "en", 1, "other text of the same id"), (None, "s1", None, None, None), (None, "s1", None, None, "a\nb")]
    rows += [(200, None, "de", 3, "ä\nß"), (201, None, None, None, ""), (202, "only", "fr", 2, "\n" * 3), (203, "Ä", "fr", 2, None), (204, "z", "fr", 2, "x\n" * 200_000), (-5, "s1", "", 0, "\n")]
    return [(*r, 5, "clash", None, 1) for r in rows]


def got(df):
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect()]


def query(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    return got(merkle.op12_merkle(spark, f"file://{tmp_path}"))


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    found = query(spark, spark.createDataFrame(rows, SCHEMA).repartition(7), tmp_path)
    assert sorted(map(repr, found)) == sorted(map(repr, expected(rows)))
    assert 0 < sum(not r[-1] for r in found) < len(found)


def test_one_row_and_no_rows(spark, tmp_path):
    one = [(3, "s", "en", 4, "a\nb", 0, "", "", 0)]
    assert query(spark, spark.createDataFrame(one, SCHEMA), tmp_path / "one") == expected(one)
    assert query(spark, spark.createDataFrame([], SCHEMA), tmp_path / "none") == []


def test_partitioning_changes_nothing(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    first = {r.root for r in merkle.manifest(docs.repartition(1)).collect()}
    assert len(first) == 1 and first == {r.root for r in merkle.manifest(docs.repartition(9, "lang")).collect()}


def test_changed_rows_are_found(spark):
    docs = spark.createDataFrame([r for r in odd_rows() if r[0] is not None], SCHEMA)
    known = merkle.manifest(docs)
    known.write.mode("overwrite").format("noop").save()
    assert merkle.verify(docs, known).where("NOT verified").count() == 0
    changed = docs.withColumn("text", F.when(F.col("doc_id").isin(3, 204), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    changed = changed.withColumn("lang", F.when(F.col("doc_id") == 201, F.lit("-")).otherwise(F.col("lang")))
    assert {r.doc_id for r in merkle.verify(changed, known).where("NOT verified").collect()} == {3, 201, 204}
    forged = known.withColumn("leaf", F.sha2("leaf", 256))
    assert merkle.verify(docs, forged).where("verified").count() == 0


def test_plan_has_no_python(spark):
    plan = merkle.op12_merkle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
