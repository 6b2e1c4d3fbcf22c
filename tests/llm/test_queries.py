"""The registered queries of the newer operators over the given tables, against plain Python."""

import numpy as np
import pytest

from cindergrid.llm import queries
from test_conversation_trie import brute, graft, result
from test_simhash_variants import groups, plain


def test_conversation_trie(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op11_conversation_trie(spark, folder)) == brute(graft(rows))


def test_simhash_variants(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    fps = [(i, plain(t)) for i, t in rows]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(fps, groups(fps)))
    assert sorted(tuple(r) for r in queries.op12_simhash_variants(spark, folder).collect()) == want


def test_whitening(spark, folder):
    rows = queries.table(spark, folder, "embeddings").orderBy("vec_id").collect()
    x = np.floor(1024 * np.array([r.embedding for r in rows])).astype(np.int64) + 100000
    d = len(x) * x - x.sum(0)
    e, v = np.linalg.eigh((d / len(x)).T @ (d / len(x)) / len(x))
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    got = queries.op13_whitening(spark, folder).orderBy("vec_id", "component").toPandas()
    z = got.whitened.to_numpy().reshape(len(x), 8)
    want = d / len(x) @ v / np.sqrt(e)
    assert np.abs(z - want * np.sign((z * want).sum(0))).max() < 1e-9
    assert got.deviation.tolist() == np.repeat((d * d).sum(1), 8).tolist() and set(got.n) == {len(x)}
    assert got.vec_id.tolist() == np.repeat([r.vec_id for r in rows], 8).tolist() and got.component.tolist() == [*range(1, 9)] * len(x)
    total = np.trace((d / len(x)).T @ (d / len(x)) / len(x))
    assert got.explained.tolist()[:8] == pytest.approx(list(e / total)) and got.identity_error.max() < 1e-9
