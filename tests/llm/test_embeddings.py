"""Near embeddings against all pairs: many bits, groups of many chunks, repeated ids, floats."""

import numpy as np

from vocalis.llm import embeddings

SCHEMA = "vec_id long, embedding array<{}>, label string"


def links_of(m, labels, threshold=0.93):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = np.zeros(len(m), int)
    for a in range(0, len(m), 2000):
        out[a : a + 2000] = ((m[a : a + 2000] @ m.T >= threshold) & (labels[a : a + 2000, None] == labels)).sum(axis=1) - 1
    return out


def test_recall_at_nine_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((14000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal((3000, 32))
    other -= (other * base[:3000]).sum(axis=1, keepdims=True) * base[:3000]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cos = rng.uniform(0.9302, 0.935, (3000, 1))
    m = np.concatenate([base, cos * base[:3000] + np.sqrt(1 - cos**2) * other]).astype(np.float32)
    assert embeddings.table_plan(len(m), 0.93, 0.9995)[0] >= 9
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(m)], SCHEMA.format("float"))
    got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
    want = links_of(m.astype(float), np.zeros(len(m)))
    found = np.array([got[i].n_links for i in range(len(m))])
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    assert sum(got[14000 + i].component_id == got[i].component_id for i in range(3000)) >= 2997


def test_groups_of_many_chunks_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CHUNK", 7)
    rng = np.random.default_rng(6)
    centre = rng.standard_normal((3, 16))
    m = np.concatenate([centre[k] + rng.standard_normal((60, 16)) * 0.3 for k in range(3)])
    labels = np.array(["a", "b"])[rng.integers(0, 2, len(m))]
    for kind in ("double", "float"):
        x = m.astype(np.float32).astype(float) if kind == "float" else m
        df = spark.createDataFrame([(i, v.tolist(), lab) for i, (v, lab) in enumerate(zip(x, labels.tolist(), strict=True))], SCHEMA.format(kind))
        got = {r.vec_id: r for r in embeddings.near_embeddings(df).collect()}
        assert [got[i].n_links for i in range(len(m))] == links_of(x, labels).tolist()
    # one id for three vectors: two alike, one of another label
    rows = [(1, [1.0, 0.0], "a"), (1, [0.99, 0.1], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.01], "b"), (3, [0.0, 1.0], "a")]
    got = sorted((r.vec_id, r.n_links) for r in embeddings.near_embeddings(spark.createDataFrame(rows, SCHEMA.format("double"))).collect())
    assert len(got) == 5 and got[-2:] == [(2, 1), (3, 0)] and [n for i, n in got if i == 1] == [1, 1, 1]


def test_empty_table(spark):
    assert embeddings.near_embeddings(spark.createDataFrame([], SCHEMA.format("float"))).collect() == []
