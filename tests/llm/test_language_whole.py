"""Language mixture: every label is learned and sets of any size can win."""

import numpy as np
import pyarrow as pa

from tracelake.llm import language_mixture as op


def word(i):
    return "".join(chr(97 + int(x)) for x in np.random.default_rng(i).integers(0, 26, 8))


def test_every_label_is_learned(spark, documents):
    rows = [(4 * i + k, " ".join([word(i)] * 8), f"l{i:03d}") for i in range(80) for k in range(4)]
    model = op.train(documents(rows))
    names = op.infer(model, pa.array([" ".join([word(i)] * 8) for i in range(80)]))[0]
    known = [i for i in range(80) if f"l{i:03d}" in model.languages]
    assert len(known) > 75 and [names[i] for i in known] == [f"l{i:03d}" for i in known]


def test_a_set_of_six_languages():
    languages = [f"l{i}" for i in range(8)]
    counts = np.zeros((op.BUCKETS, 8), np.int64)
    for i in range(8):
        np.add.at(counts[:, i], op._words(pa.array([" ".join([word(i)] * 500)]))[0], 1)
    _, _, k, shares, _ = op.infer(op.Model(languages, counts), pa.array([" ".join(word(i) for i in range(6) for _ in range(40)), word(1)]))
    assert k.tolist() == [6, 1] and np.allclose(shares[0][:6], 1 / 6, atol=0.02) and max(shares[0][6:]) < 0.01
