import numpy as np
import pytest

from marketlens.llm import vectorgraph


def brute(rows, least=0.9):
    ok = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float)
    ids = sorted(ok)
    near = {i: {j for j in ids if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least} for i in ids}
    comp = {}
    for i in ids:
        if i not in comp:
            todo, seen = [i], {i}
            while todo:
                for j in near[todo.pop()] - seen:
                    seen.add(j)
                    todo.append(j)
            comp |= dict.fromkeys(seen, i)
    every = {i for i, _ in rows if i is not None}
    return sorted((i, len(near.get(i, ())), comp.get(i, i), comp.get(i, i) == i) for i in every)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    out = [(i, rng.normal(size=16).tolist()) for i in range(300)]
    for g in range(6):
        centre = rng.normal(size=16)
        out += [(1000 + 100 * g + k, (centre + rng.normal(size=16) * 0.25).tolist()) for k in range((90, 30, 5, 4, 3, 2)[g])]
    copy = rng.normal(size=16).tolist()
    out += [(3000 + k, copy) for k in range(40)] + [(3100, [2 * x for x in copy])]
    out += [(4000, None), (4001, []), (4002, [0.0] * 16), (4003, [None] + [1.0] * 15), (4004, [float("nan")] + [1.0] * 15), (4005, [float("inf")] + [1.0] * 15),
            (4006, [1.0, 2.0]), (4007, [1.0, 2.0]), (4008, [*copy[:15], 0.0, 0.0]), (3000, copy), (4009, [-0.0, 1.0]), (4010, [0.0, 1.0])]
    return out


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 20, "QUERIES": 64, "PER_CLUSTER": 100}])
def test_equals_brute_force(spark, rows, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(vectorgraph, name, value)
    v = spark.createDataFrame([(i, x, 7, "c") for i, x in rows], "vec_id long, embedding array<float>, id int, cells string").repartition(4)
    exact = [(i, None if x is None else [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    got = sorted(map(tuple, vectorgraph.links(v).collect()))
    want = brute(exact)
    if not sizes:
        assert got == want
    else:  # many small shards: the index is approximate, and finds no wrong link
        true, found = sum(r[1] for r in want), sum(r[1] for r in got)
        assert 0.97 * true <= found <= true


def test_audit_measures_recall(spark, rows):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").cache()
    r = vectorgraph.audit(v, vectorgraph.links(v), every=10).first()
    assert r.links > 0 and r.found >= 0.9 * r.links


def test_recall_holds_with_hundreds_of_cells(spark, monkeypatch):
    # unstructured pairs just in range, hardly any in the centroids' sample: only the probes bring them together
    for name, value in {"PER_CLUSTER": 10, "SAMPLE": 300, "HELD": 1000}.items():
        monkeypatch.setattr(vectorgraph, name, value)
    rng = np.random.default_rng(8)
    x = vectorgraph._unit(rng.normal(size=(1500, 64)))
    aside = rng.normal(size=x.shape)
    aside = vectorgraph._unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    y = 0.905 * x + np.sqrt(1 - 0.905**2) * aside
    v = spark.createDataFrame(list(enumerate(np.concatenate([x, y]).tolist())), "vec_id long, embedding array<double>").repartition(4).cache()
    r = vectorgraph.audit(v, vectorgraph.links(v), every=1).first()
    print(f"300 cells: {r.found} of {r.links} links")
    assert r.links >= 3000 and r.found >= 0.97 * r.links


def just_in_range(rng, x, cosine=0.903):
    aside = rng.normal(size=x.shape)
    aside = vectorgraph._unit(aside - (aside * x).sum(axis=1, keepdims=True) * x)
    return cosine * x + np.sqrt(1 - cosine**2) * aside


def test_search_cost_does_not_follow_the_shard(monkeypatch):
    # cosines that the walk takes, on unstructured vectors: a lone member takes those of its list, an outsider hardly more in a larger shard
    counted, plain = [0], vectorgraph._cosines

    def cosines(points, what, queries, who):
        counted[0] += len(what)
        return plain(points, what, queries, who)

    rng = np.random.default_rng(12)
    each = {}
    for n in (2000, 8000):
        x = vectorgraph._unit(rng.normal(size=(n, 64)))
        first, adjacent = vectorgraph.robust_prune(x)
        asked = rng.choice(n, 500, replace=False)
        outside = just_in_range(rng, x[asked]).astype(np.float32)
        x = x.astype(np.float32)
        with monkeypatch.context() as m:
            m.setattr(vectorgraph, "_cosines", cosines)
            counted[0] = 0
            assert not vectorgraph.has_near(x, first, adjacent, np.arange(n), 0.9).any()
            assert counted[0] == len(adjacent) <= 2 * vectorgraph.DEGREE * n
            counted[0] = 0
            who, what = vectorgraph.range_search(x, first, adjacent, outside, vectorgraph.entries(x), np.full(500, -1), 0.9)
            each[n] = counted[0] / 500
        assert (what == asked[who]).sum() >= 0.98 * 500  # four in five when the medoid is the only entry
    print(each)
    assert each[8000] < 1.4 * each[2000] and each[8000] < 8000 / 8


def test_all_links_of_a_group_are_found_in_its_shard():
    # members at a group's rim: no list that has them may be shortened
    rng = np.random.default_rng(13)
    group = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.3
    x = vectorgraph._unit(np.concatenate([group, rng.normal(size=(1600, 64))]))
    first, adjacent = vectorgraph.robust_prune(x)
    assert {*zip(np.repeat(np.arange(2000), np.diff(first)).tolist(), adjacent.tolist(), strict=True)} == {*zip(adjacent.tolist(), np.repeat(np.arange(2000), np.diff(first)).tolist(), strict=True)}
    x = x.astype(np.float32)
    true = (x @ x.T >= 0.9) & ~np.eye(2000, dtype=bool)
    assert (vectorgraph.has_near(x, first, adjacent, np.arange(2000), 0.9) == true.any(axis=1)).all()
    got = 0
    for lo in range(0, 400, 100):
        own = np.arange(lo, lo + 100)
        who, what = vectorgraph.range_search(x, first, adjacent, x[own], vectorgraph.entries(x), own, 0.9)
        got += true[own[who], what].sum()
    print(got, true.sum())
    assert true.sum() > 20_000 and got == true[:400].sum()


def test_longer_vectors_make_smaller_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(vectorgraph, "LENGTH", 1)
    monkeypatch.setattr(vectorgraph, "SHARD", 2000)
    v = spark.createDataFrame([(i, x) for i, x in rows], "vec_id long, embedding array<double>").repartition(4)
    true, found = (sum(r[1] for r in x) for x in (brute(rows), vectorgraph.links(v).collect()))
    assert 0.97 * true <= found <= true


def test_no_vectors_and_no_ids(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vectorgraph.links(none).count() == 0
    odd = spark.createDataFrame([(None, [1.0]), (None, None), (1, None)], "vec_id long, embedding array<float>")
    assert sorted(map(str, vectorgraph.links(odd).collect())) == sorted(["Row(vec_id=None, n_links=0, component_id=None, kept=False)"] * 2 + ["Row(vec_id=1, n_links=0, component_id=1, kept=True)"])
