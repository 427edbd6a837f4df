import numpy as np
import pyarrow as pa

from pairloom.llm import descent

SCHEMA = "vec_id long, embedding array<float>, node string, id string, label int"


def brute(rows):
    usable = {i: np.array(v, float) for i, (k, v) in enumerate(rows)
              if k is not None and v is not None and len(v) == 8 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)}
    links = {i: [j for j in usable if j != i and usable[i] @ usable[j] / np.linalg.norm(usable[i]) / np.linalg.norm(usable[j]) >= 0.9] for i in usable}
    out = []
    for i, (k, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen), default=None) if k is not None else None
        out.append((k, len(links.get(i, ())), low, low == k))
    return sorted(out, key=repr)


def test_links_are_those_of_all_pairs(table, monkeypatch):
    monkeypatch.setattr(descent, "LIST", 16)
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((40, 8))
    values = [c + rng.standard_normal(8) * s for i, c in enumerate(centre) for s in [0.25] * (2 + 60 * (i == 3)) + [0.9]]
    values = [v.astype(np.float32).tolist() for v in values]
    values += [values[0]] * 5 + [[2 * x for x in values[0]], [1e-30 * x for x in values[4]]]
    odd = [None, [], [0.0] * 8, [float("nan")] + values[0][1:], [float("inf")] * 8, [None] + values[0][1:], values[0][:5]]
    rows = [(i, v) for i, v in enumerate(rng.permutation(np.arange(len(values)))) for v in [values[v]]] + [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(None, values[0]), (None, None), (7, rows[7][1]), (7, values[9])]
    got = descent.near_vectors(table([(k, v, "n", "i", 1) for k, v in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_and_unusable_tables(table):
    assert descent.near_vectors(table([], SCHEMA)).collect() == []
    got = descent.near_vectors(table([(1, None, "", "", 1), (2, [0.0], "", "", 1)], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_rows_of_one_key_stay_together():
    batches = [pa.record_batch({"k": k, "v": k}) for k in ([1, 1, 2], [], [2, 2], [3], [4, 4, 5])]
    batches = [b.cast(pa.schema([("k", pa.int64()), ("v", pa.int64())])) for b in batches]
    assert [g.column(0).to_pylist() for g in descent.groups(iter(batches))] == [[1, 1], [2, 2, 2], [3], [4, 4], [5]]
    assert [len(g) for g in descent.groups(iter(batches), 4)] == [4, 4, 1]


def unit_rows(values):
    return [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(values)]


def test_audit_sees_lost_pairs_beside_a_large_group(table):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((21, 32))
    values = [centre[0] + rng.standard_normal(32) * 0.05 for _ in range(300)] + [c + rng.standard_normal(32) * 0.05 for c in centre[1:] for _ in range(2)]
    nodes = table(unit_rows(values), "node long, unit array<double>")
    pairs = [(300 + i, 300 + i // 2 * 2) for i in range(40)]
    group = [(i, 0) for i in range(300)]
    assert descent.audit(nodes, table(group, "node long, component long"), 32, 0.9) < descent.ENOUGH
    assert descent.audit(nodes, table(group + pairs, "node long, component long"), 32, 0.9) == 1


def test_nothing_is_lost_when_rounds_run_out(table, monkeypatch):
    for name, value in {"ROUNDS": 1, "MORE": 1, "MOST": 1, "DESCENTS": 0, "BLOCK": 2, "STRIP": 50}.items():
        monkeypatch.setattr(descent, name, value)
    rng = np.random.default_rng(2)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(c + rng.standard_normal(8) * 0.1 for c in rng.standard_normal((60, 8)) for _ in range(3))]
    got = descent.near_vectors(table([(k, v, "n", "i", 1) for k, v in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_groups_that_fill_their_lists_are_joined(table):
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(8):
        a, b = rng.standard_normal((2, 8))
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b = 0.95 * a + np.sqrt(1 - 0.95 ** 2) * b / np.linalg.norm(b)
        rows += [(c + rng.standard_normal(8) * 0.01).astype(np.float32).tolist() for c in (a, b) for _ in range(20)]
    rows = list(enumerate(rows))
    got = descent.near_vectors(table([(k, v, "n", "i", 1) for k, v in rows], SCHEMA)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)
