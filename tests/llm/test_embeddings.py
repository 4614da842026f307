import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cuelake.llm import embedding_dedup as dedup
from cuelake.llm import whitening
from cuelake.llm.components import _star, components
from compare import assert_same, views

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=dedup.COSINE):
    """(vec_id, n_links, component_id, kept) per row, over all pairs."""
    ok = [e is not None and lab is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for _, e, lab in rows]
    unit = [np.asarray(e, float) / np.linalg.norm(np.asarray(e, float)) if k else None for (_, e, _), k in zip(rows, ok)]
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine:
                n[i], n[j] = n[i] + 1, n[j] + 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], n[i], least.get(find(i)), r[0] == least.get(find(i))) for i, r in enumerate(rows)), key=repr)


def got(spark, rows, schema=SCHEMA, **more):
    df = dedup.near_embeddings(spark.createDataFrame(rows, schema), **more)
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


def floats(rows):
    """As the table stores them."""
    return [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]


def near(r, centre, spread, n):
    return [centre + r.standard_normal(len(centre)) * spread for _ in range(n)]


def planted(seed=7):
    """A tight group, a loose one that no ball holds, a chain, exact copies, and vectors alone."""
    r = np.random.default_rng(seed)
    d, out = 16, []
    out += [(x, 1) for x in near(r, r.standard_normal(d), 0.05, 120)]
    out += [(x, 1) for x in near(r, r.standard_normal(d), 0.28, 150)]
    a, b = r.standard_normal((2, d))
    out += [(np.cos(t) * a / np.linalg.norm(a) + np.sin(t) * b / np.linalg.norm(b), 2) for t in np.arange(0, 2, 0.2)]
    copy = r.standard_normal(d)
    out += [(copy, 2)] * 50 + [(copy * 3, 2), (copy, 1), (-copy, 2)]
    out += [(x, int(r.integers(3))) for x in r.standard_normal((150, d))]
    order = r.permutation(len(out))
    return floats([(int(k) * 3 + 1, out[i][0].tolist(), out[i][1]) for k, i in enumerate(order)])


def test_links_and_components_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LARGE", 16)
    monkeypatch.setattr(dedup, "BLOCK", 24)
    rows = planted()
    assert got(spark, rows, miss=1e-9) == brute(rows)


def test_all_buckets_small_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(dedup, "LARGE", 10_000)
    rows = planted(8)
    assert got(spark, rows, miss=1e-9) == brute(rows)


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (None, [2.0, 0.0], 1), (3, None, 1), (4, [], 1), (5, [0.0, 0.0], 1), (5, [0.0, -0.0], 1),
        (6, [1.0, None], 1), (7, [1.0, nan], 1), (8, [1.0, inf], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (None, [0.0, 1.0], 3), (12, [1.0, None, 0.0], 1),
        (13, [1e-30, 0.0], 1), (14, [3e38, 0.0], 1),
    ]
    assert got(spark, rows) == brute(floats(rows))


def test_empty_and_extra_columns(spark):
    assert got(spark, []) == []
    extra = spark.createDataFrame([(1, [1.0, 2.0], 1, 5, 6), (2, [1.0, 2.1], 1, 5, 6)], SCHEMA + ", node bigint, h1 bigint")
    assert sorted(tuple(r) for r in dedup.near_embeddings(extra).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_rows_of_a_dense_group_grow_with_its_size(spark, monkeypatch):
    """No pairs of a dense group: what is compared stays far below the square."""
    sizes = []
    kept = dedup.written
    monkeypatch.setattr(dedup, "written", lambda df, name: (sizes.append((name, (out := kept(df, name)).count())), out)[1])
    r = np.random.default_rng(3)
    rows = floats([(i, x.tolist(), 1) for i, x in enumerate(near(r, r.standard_normal(32), 0.03, 400))])
    assert {x[1] for x in got(spark, rows)} == {399}
    assert max(n for name, n in sizes if name in ("pairs", "links", "by_blocks", "between")) < 2 * 400


def test_both_sides_of_the_hub_join_are_shuffled(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 60)] + [(70, 71), (71, 72)], "a bigint, b bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = _star(edges, True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = plan.index("SortMergeJoin")
    assert plan[at:].count("Exchange hashpartitioning") >= 3
    assert {(r.node, r.root) for r in components(edges).collect() if r.node > 59} == {(70, 70), (71, 70), (72, 70)}


def test_layout_holds_the_risk():
    for n in (1, 50, 5000, 10**6, 10**9):
        bits, tables, most = dedup.layout(n, 0.93, 1e-5)
        agree = 1 - np.arccos(0.93) / np.pi
        assert (1 - agree**bits) ** tables <= 1e-5
        assert bits * tables * (1 - agree) < most < bits * tables / 2 or n < 100


# --- whitening ---


def plain_whitening(vectors, k=32):
    x = np.floor(64 * np.asarray(vectors, float)) + 1_000_000
    n = len(x)
    c = x - x.mean(0)
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return c @ v / np.sqrt(e), e / (c**2).sum() * n, [sum((n * int(a) - int(s)) ** 2 for a, s in zip(r, x.sum(0))) for r in x]


def test_whitening_against_a_dense_eigensolver(spark):
    r = np.random.default_rng(1)
    x = (r.standard_normal((300, 40)) * np.linspace(1, 3, 40)).astype(np.float32)
    rows = [(i, x[i].tolist(), 0) for i in range(len(x))] + [(900, None, 0), (901, [float("nan")] * 40, 0), (902, [None] * 40, 0), (903, [], 0), (904, [1.0] * 7, 0)]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).toPandas()
    want, share, deviation = plain_whitening(x)
    assert len(out) == 300 * 32 and set(out["n"]) == {300}
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    sign = np.sign((w * want).sum(0))
    assert np.abs(w * sign - want).max() < 1e-7
    assert np.abs(out.groupby("component")["explained"].first().to_numpy() / share - 1).max() < 1e-9
    assert out.groupby("vec_id")["deviation"].first().tolist() == deviation
    cov = np.cov(w.T, bias=True) - np.eye(32)
    assert abs(out["identity_error"].iloc[0] - np.abs(cov).max()) < 1e-9 and out["identity_error"].nunique() == 1


def test_whitening_without_variance(spark):
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert whitening.whiten(frame([])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0], 0)])).collect() == []
    assert whitening.whiten(frame([(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    # of two equal dimensions one component has variance; rows that repeat an id, or have none, stay
    rows = [(1, [1.0, 1.0], 0), (1, [2.0, 2.0], 0), (None, [4.0, 4.0], None)]
    out = whitening.whiten(frame(rows)).toPandas()
    assert len(out) == 3 and set(out["component"]) == {1} and abs(out["explained"].iloc[0] - 1) < 1e-12
    with pytest.raises(Exception, match="would not be exact"):
        whitening.whiten(frame([(1, [1e30, 0.0], 0), (2, [1.0, 0.0], 0)])).collect()


def test_whitening_query_over_its_table(spark, sf_dir):
    out = __spark_entry__.queries()["op13_embedding_whitening"](spark, sf_dir).toPandas()
    src = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas().sort_values("vec_id")
    want, share, deviation = plain_whitening(np.stack(src["embedding"].to_numpy()))
    w = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-6
    assert out.sort_values("vec_id").groupby("vec_id")["deviation"].first().tolist() == deviation
    assert out["identity_error"].iloc[0] < 1e-9


@pytest.mark.parametrize("name", ["op11_embedding_dedup", "op12_merkle_manifest"])
def test_queries_against_sql(spark, sf_dir, name):
    assert_same(__spark_entry__.queries()[name](spark, sf_dir), __spark_entry__.oracle_sql()[name], views(sf_dir))


def test_embedding_sql_on_planted_groups(spark, tmp_path):
    rows = planted(9)[:200]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = __import__("duckdb").connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    assert_same(__spark_entry__.queries()["op11_embedding_dedup"](spark, str(tmp_path)), __spark_entry__.oracle_sql()["op11_embedding_dedup"], con)
