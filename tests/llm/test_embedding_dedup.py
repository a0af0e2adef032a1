import numpy as np

from threatloom.llm import embedding_dedup as E


def plain(rows, similarity=0.95):
    """n_links and component of every row by all products."""
    unit = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v], float) if v else np.zeros(0)
        n = np.linalg.norm(x)
        unit.append(x / n if len(x) and np.isfinite(n) and n > 0 else None)
    n = len(rows)
    near = [[j for j in range(n) if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j])
             and unit[i] @ unit[j] >= similarity] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        top = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), top, rows[i][0] == top))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in rows],
                               "vec_id int, embedding array<double>, n_links int")
    return sorted(map(tuple, E.deduplicate(df).collect()), key=repr)


def test_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(E, "TILE", 60)
    monkeypatch.setattr(E, "BLOCK", 16)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 24))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[i % 20] * rng.uniform(0.1, 9) + rng.normal(size=24) * rng.choice([0.05, 0.2, 0.3])) for i in range(150)]
    step = [np.cos(0.25 * k) * base[0] / np.linalg.norm(base[0]) + np.sin(0.25 * k) * np.eye(24)[3] for k in range(12)]  # a chain
    rows += [(400 + k, v) for k, v in enumerate(step)] + [(500 + k, base[5]) for k in range(130)]
    rows = [(i, list(map(float, v))) for i, v in rows]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [None] + [1.0] * 23), (904, [float("nan")] * 24), (905, [float("inf")] * 24),
             (906, [1.0, 2.0]), (907, [2.0, 4.0]), (None, [1.0, 2.0]), (None, [0.0, 0.0]), (906, [1.0, 2.0])]
    assert run(spark, rows) == plain(rows)


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1, True)]
