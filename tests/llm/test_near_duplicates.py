import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from conftest import prose  # noqa: F401

from voxelframe.llm import catalog, hamming, lattice
from voxelframe.llm.components import components


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(500, 620)] + [(700, k) for k in range(701, 900)] + [(1000, 1000)]
    want = closure(1100, pairs)
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    assert got == {x: want[x] for p in pairs for x in p if x != 1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text: str) -> int:
    words = text.encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_anchors_meet():
    """Any two fingerprints at 4 bits or fewer share an anchor."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    b = a.copy()
    for k in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    (ra, ka), (rb, kb) = hamming.anchors(a), hamming.anchors(b)
    assert {r for r, _ in set(zip(ra.tolist(), ka.tolist(), strict=True)) & set(zip(rb.tolist(), kb.tolist(), strict=True))} == set(range(3000))
    assert 32 < len(ra) / 3000 < 34


@pytest.mark.parametrize("block", [8, 4096])
def test_links_span_the_graph(spark, block):
    """Dense groups, chains and noise, with anchors cut into blocks and whole, against all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    fp = [rng.integers(0, 2**64, 300, dtype=np.uint64)]
    for n in (40, 25, 3):
        x = np.repeat(base[:1], n)
        for _ in range(3):
            x = x ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
        fp.append(x)
        base = base[1:]
    fp = np.unique(np.concatenate(fp))
    want = closure(len(fp), np.argwhere(np.triu(np.bitwise_count(fp[:, None] ^ fp[None]) <= 4, 1)).tolist())
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    at = {int(x): k for k, x in enumerate(fp.view(np.int64))}
    got = closure(len(fp), [(at[r.a], at[r.b]) for r in hamming.fingerprint_links(df, block=block).collect()])
    assert got == want


def test_near_duplicates(spark, odd, none):
    base = prose(1, 300)
    docs = [(1, base), (2, base.upper()), (3, base + " tail"), (4, prose(2, 300)), (5, prose(3, 4)), (6, prose(3, 3)), (7, ""), (8, None), (9, " \n")]
    got = {r.doc_id: r for r in hamming.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = [slow_fingerprint(t or "") for _, t in docs]
    assert [got[i].fp & (2**64 - 1) for i, _ in docs] == fps
    a = np.array(fps, dtype=np.uint64)
    want = closure(len(a), np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a[None]) <= 4, 1)).tolist())
    assert [got[i].component_id for i, _ in docs] == [docs[k][0] for k in want] and got[9].component_id == got[8].component_id == 7 and got[2].component_id == 1
    rows = hamming.near_duplicates(odd).collect()
    assert len(rows) == 10 and {r.component_id for r in rows if r.doc_id in (900, 901, 902)} == {900} and hamming.near_duplicates(none).count() == 0
    kept = hamming.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [900, 903, 904, 905, 906, 907] and kept.where("doc_id is null").count() == 1


def test_rows_that_share_an_id(spark):
    """Rows are kept or dropped by themselves: one id with two texts is two documents, copies of one row are one."""
    a, b, c = prose(1, 200), prose(2, 200), prose(3, 200)
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "x"), (2, c, "x"), (3, b, "y"), (1, a, "y"), (None, a, "z"), (None, a, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "map('k', source) as extra")
    for parts in (1, 7):
        kept = [(r.doc_id, r.text, r.source) for r in hamming.keep_one(df.repartition(parts)).collect()]
        assert sorted(x for x in kept if x[0] and x[1] != a) == [(1, b, "x"), (2, c, "x")] and kept.count((None, a, "z")) == 2
        first = [x for x in kept if x[0] and x[1] == a]
        assert len(first) == 1 and first[0][0] == 1
        again = first if parts == 1 else again
        assert first == again


def test_e8():
    assert lattice.ROOTS.shape == (240, 8) and np.allclose((lattice.ROOTS**2).sum(axis=1), 2)
    y = np.random.default_rng(0).normal(size=(500, 8)) * 2
    p = lattice.decode_e8(y)
    around = np.concatenate([p[:, None] + lattice.ROOTS[None], p[:, None]], axis=1)
    assert (((around - y[:, None]) ** 2).sum(axis=2).min(axis=1) >= ((p - y) ** 2).sum(axis=1) - 1e-9).all()


@pytest.mark.parametrize("block", [16, 2048])
def test_near_vectors(spark, block, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(300, 32))
    v[50:110] = v[50] + 0.05 * rng.normal(size=(60, 32))  # near copies
    v[120:125] = v[120]  # copies
    v[126] = -v[120]
    v[127] = 1e-3 * v[120]
    unit = v / np.abs(v).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    rows = [(k, x.tolist()) for k, x in enumerate(v)]
    bad = [(300, None), (301, [0.0] * 32), (302, [float("nan")] + [1.0] * 31), (303, [float("inf")] + [1.0] * 31), (304, [None] + [1.0] * 31), (305, [1.0] * 5), (306, [])]
    df = spark.createDataFrame(rows + bad + [(0, v[0].tolist())], "vec_id long, embedding array<double>").selectExpr("*", "'x' as node", "1 as kept")
    got = lattice.near_vectors(df, block=block).collect()
    want = closure(300, np.argwhere(np.triu(near)).tolist())
    assert len(got) == 308 and len([r for r in got if r.vec_id == 0]) == 2
    for r in got:
        if r.vec_id >= 300:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (near[r.vec_id].sum() + (r.vec_id == 0), want[r.vec_id], want[r.vec_id] == r.vec_id)
    assert lattice.near_vectors(df.limit(0)).count() == 0
    con = duckdb.connect()
    df.dropDuplicates(["vec_id"]).select("vec_id", "embedding").where("vec_id <> 305").write.parquet(f"{tmp_path}/v")  # the SQL knows no other lengths
    con.sql(f"create view embeddings as select * from '{tmp_path}/v/*.parquet'")
    sql = {r[0]: r[1:] for r in con.sql(catalog.ORACLE["op8_embedding_near_dedup"]).fetchall()}
    assert all(sql[r.vec_id] == (r.n_links - (r.vec_id == 0), r.component_id, r.kept) for r in got if r.vec_id != 305)


def test_each_length_links_on_its_own(spark):
    rng = np.random.default_rng(6)
    long, short = rng.normal(size=(30, 32)), rng.normal(size=(6, 16))
    short[1], short[2] = short[0], short[0] + 0.001 * rng.normal(size=16)
    long[4] = long[3]
    rows = [(k, x.tolist()) for k, x in enumerate(long)] + [(100 + k, x.tolist()) for k, x in enumerate(short)] + [(200, [2.0]), (201, [3.0]), (202, [1.0] * 5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in (100, 101, 102)] == [(2, 100, True), (2, 100, False), (2, 100, False)] and got[4] == (1, 3, False)
    assert got[200] == (1, 200, True) and got[201] == (1, 200, False) and got[202] == (0, 202, True)


@pytest.mark.parametrize("plan", [p for _, p in lattice.PLANS])
def test_recall_at_the_threshold(plan):
    rng = np.random.default_rng(2)
    a, w = rng.normal(size=(600, 64)), rng.normal(size=(600, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    w -= (w * a).sum(axis=1)[:, None] * a
    w /= np.linalg.norm(w, axis=1)[:, None]
    b = 0.9 * a + np.sqrt(1 - 0.81) * w
    h = lattice.lattice_hash(64, plan, lattice.SEED)
    x, y = h.cells(a), h.cells(b)
    assert (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean() >= 0.9


def test_every_plan_counts_links_once(spark):
    """Tight and loose clusters, in whole and cut units, under the plans for more vectors: degrees are exact."""
    assert lattice.plan_for(1000) == lattice.PLANS[0][1] and lattice.plan_for(1 << 30) == lattice.PLANS[2][1]
    rng = np.random.default_rng(9)
    v = rng.normal(size=(260, 48)).astype(np.float32)
    v[:80] = v[0] + 0.01 * rng.normal(size=(80, 48))
    v[80:160] = v[80] + 0.15 * rng.normal(size=(80, 48))
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<float>")
    for (_, plan), block in zip(lattice.PLANS, (7, 30, 2048), strict=True):
        got = {r.vec_id: r.n_links for r in lattice.near_vectors(df, plan=plan, block=block).collect()}
        assert [got[k] for k in range(260)] == near.sum(axis=1).tolist()


@pytest.mark.parametrize("attached", [False, True])
def test_keys_of_unknown_number_are_not_broadcast(spark, attached):
    """Spark takes what Python or an explode makes to be as small as its input, and would broadcast a million keys of near copies."""
    from voxelframe.llm.common import in_blocks

    rows = spark.range(100).select((F.col("id") % 7).alias("cell"), F.col("id").alias("node"))
    units = in_blocks(rows, ["cell"], "node", 4096, attach=rows.select("node", F.lit("v").alias("v")) if attached else None)
    assert "Broadcast" not in units._jdf.queryExecution().executedPlan().toString()
    assert units.count() == 100


def test_lookup_beyond_its_limit_is_not_broadcast(spark):
    from voxelframe.llm.common import lookup

    rows = spark.range(1000).select((F.col("id") % 50).alias("k"))
    small = spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    plans = [lookup(rows, small, ["k"], limit=n)._jdf.queryExecution().executedPlan().toString() for n in (49, 50)]
    assert ["BroadcastHashJoin" in p for p in plans] == [False, True]
    assert lookup(rows, small, ["k"], limit=49).where("v = 1").count() == 1000
