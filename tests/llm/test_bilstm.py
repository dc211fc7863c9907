import numpy as np

from spanforge.llm import bilstm
from spanforge.llm.bilstm import BiLstmCrf


def columns():
    lengths = np.array([9, 9, 6, 4, 1])
    ids = np.random.default_rng(2).integers(1, 20, (9, 5)).astype(np.int32)
    for j, n in enumerate(lengths):
        ids[n:, j] = 0
    return ids, lengths


def test_no_work_is_done_on_padding(monkeypatch):
    ids, lengths = columns()
    rows, take = [], np.take
    monkeypatch.setattr(bilstm.np, "take", lambda a, i, *x, **k: (rows.append(len(i)), take(a, i, *x, **k))[1])
    BiLstmCrf.new(20, 4, 5, 6).emissions(ids)
    assert sum(rows) == 2 * lengths.sum()


def test_columns_in_any_order_have_the_same_tags():
    model, (ids, lengths) = BiLstmCrf.new(20, 4, 5, 6, seed=8), columns()
    model.p["trans"][:] = np.random.default_rng(3).normal(0, 1, (4, 4))
    tags, _ = model.decode(ids, lengths)
    for order in ([4, 3, 2, 1, 0], [2, 0, 4, 1, 3]):
        assert (model.decode(ids[:, order], lengths[order])[0] == tags[:, order]).all()
        assert np.allclose(model._run(ids[:, order], "b"), model._run(ids, "b")[:, order], atol=1e-6)
