"""The network's gradients against differences, and what it has learned against held-out labels of the given tables."""

import numpy as np
import pyarrow as pa

from quiverlake.llm import toxicity as X


def test_gradients_equal_differences():
    texts = pa.array(["you vile thing go away now", "a calm and kind word for all", "vile " * 30, "", "kind calm"], pa.large_string())
    words = X.Words(texts)
    net = X.Network(np.unique(words.hashes)[::2], seed=3)  # half of the words are unknown to it
    rng = np.random.default_rng(1)
    net.p = {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in net.p.items()}
    doc, start = words.windows()
    numbers = words.numbers(doc, start)
    weight = rng.normal(size=len(doc)).astype(np.float32)

    def loss():
        return float(net.forward(net.projected(net.inputs(words)[1]), numbers)[0].astype(np.float64) @ weight)

    row, x = net.inputs(words)
    made = net.gradients(words, row, x, net.projected(x), numbers, lambda logit: weight)
    assert set(made) == set(net.p)
    for name, g in made.items():
        assert np.abs(g).max() > 0, name
        for at in np.argsort(-np.abs(g).ravel())[:4]:
            where, eps = np.unravel_index(at, g.shape), 4e-3
            kept = net.p[name][where]
            net.p[name][where] = kept + eps
            up = loss()
            net.p[name][where] = kept - eps
            down = loss()
            net.p[name][where] = kept
            assert abs((up - down) / (2 * eps) - g[where]) <= 0.03 * abs(g[where]) + 3e-3, (name, where)


def test_held_out_labels_of_the_given_table(spark):
    from quiverlake.llm.common import table
    from quiverlake.llm.queries import QUERIES

    at = "/root/testdata/sf0.1"  # of README; the smaller tables hold out six toxic documents or fewer
    rows = QUERIES["op3_toxicity"](spark, at).where("held_out").join(table(spark, at, "labels").select("doc_id", "toxic"), "doc_id").where("toxic is not null").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows]) == 1
    assert toxic.sum() >= 30 and (~toxic).sum() >= 200
    auc = (score[toxic][:, None] > score[~toxic][None]).mean() + 0.5 * (score[toxic][:, None] == score[~toxic][None]).mean()
    assert auc >= 0.94 and ((score >= 0.5) == toxic).mean() >= 0.95
