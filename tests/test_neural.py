import numpy as np
import pytest

from lociweave.neural import networks, training
from lociweave.neural.autograd import Value, erf, logistic_loss

SETTINGS = {
    "local_cnn": {"channels": 6, "kernel_size": 5}, "dilated_cnn": {"channels": 5, "kernel_size": 3, "dilations": (1, 2), "dropout": 0.0},
    "transformer": {"embedding_dim": 8, "attention_heads": 2, "layers": 2, "feedforward_dim": 12, "dropout": 0.0}, "rnn": {"hidden": 5}, "lstm": {"hidden": 5},
}


def _data(n, length=20, seed=0):
    """Sequences with ACGTA somewhere are positive."""
    rng = np.random.default_rng(seed)
    x, y = rng.integers(0, 4, (n, length)), np.arange(n) % 2
    for row, label in zip(x, y):
        if label:
            at = rng.integers(0, length - 5)
            row[at : at + 5] = [0, 1, 2, 3, 0]
    return np.eye(4, dtype=np.float32)[x], y.astype(np.float32)


@pytest.mark.parametrize("name", SETTINGS)
def test_gradients_against_differences(name):
    network = networks.build(name, 12, SETTINGS[name] | {"dtype": np.float64})
    x, y = _data(6, 12)
    x = x.astype(float) + 0.01 * np.random.default_rng(1).standard_normal(x.shape)
    for mode in (True, False):
        network.training = mode
        for v in network.parameters.values():
            v.grad = None
        given = Value(x, keep=True)
        logistic_loss(network(given), y).backward()
        moments = dict(network.moments)
        rng = np.random.default_rng(2)
        for v in [given, *network.parameters.values()]:
            if v.grad is None:
                continue
            for _ in range(3):
                at = tuple(rng.integers(0, n) for n in v.data.shape)
                kept, found = v.data[at], []
                for step in (1e-5, -1e-5):
                    v.data[at] = kept + step
                    network.moments = dict(moments)
                    found.append(float(logistic_loss(network(Value(given.data)), y).data))
                v.data[at] = kept
                assert v.grad[at] == pytest.approx((found[0] - found[1]) / 2e-5, abs=2e-5, rel=2e-3)


def test_networks_learn_and_stop():
    train, valid, test = (_data(n, seed=s) for n, s in ((800, 1), (200, 2), (200, 3)))
    network = networks.build("local_cnn", 20, {"channels": 16, "kernel_size": 7})
    out = training.fit(network, train, valid, epochs=25, patience=4, learning_rate=1e-2)
    p = training.probabilities(out.network, test[0], 64)
    assert ((p > 0.5) == (test[1] == 1)).mean() > 0.9 and out.best_validation_loss < 0.4
    assert training.mean_loss(out.network, *valid, 64) == pytest.approx(out.best_validation_loss, rel=1e-5)
    again = training.loads(training.dumps(out.network), "local_cnn", 20, {"channels": 16, "kernel_size": 7})
    assert np.allclose(training.probabilities(again, test[0]), p, atol=1e-6)
    quick = training.fit(networks.build("rnn", 20, SETTINGS["rnn"]), (train[0][:8], train[1][:8]), (valid[0][:8], valid[1][:8]), epochs=50, patience=2, learning_rate=0.0)
    assert quick.epochs_completed == 3
    mask = np.zeros((200, 20))
    hit = [int("".join("ACGT"[i] for i in r.argmax(1)).find("ACGTA")) for r in test[0]]
    for row, at in zip(mask, hit):
        row[at : at + 5] = at >= 0
    where = test[1] == 1
    found = training.localisation(out.network, test[0][where], mask[where])
    assert found["mass_mean"] > 1.5 * found["coverage"] and found["mass_std"] > 0
    assert training.saliency(out.network, test[0][:3]).max(1) == pytest.approx(1)


def test_rules_and_counts():
    assert networks.parameter_count(networks.build("local_cnn", 9, {"channels": 3, "kernel_size": 5})) == 3 * 4 * 5 + 3 + 6 + 3 + 1
    for bad in (lambda: networks.build("local_cnn", 9, {"kernel_size": 4}), lambda: networks.build("transformer", 9, {"embedding_dim": 9, "attention_heads": 2}), lambda: networks.build("transformer", 9, SETTINGS["transformer"])(np.zeros((1, 8, 4)))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        networks.build("nothing", 9)
    with pytest.raises(ValueError):
        training.resolve_device("cuda")
    assert training.resolve_device("auto") == "cpu"
    assert training.seed_everything(3).random() == training.seed_everything(3).random()
    import math

    x = np.linspace(-4, 4, 99)
    assert np.abs(erf(x) - [math.erf(v) for v in x]).max() < 2e-7
    assert [len(a) for a, _ in training.batches(np.zeros((5, 1)), np.zeros(5), 2, True, np.random.default_rng(0))] == [2, 2, 1]


def test_prediction_and_grid_in_spark(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    x, y = _data(60)
    text = ["".join("ACGT"[i] for i in r.argmax(1)) for r in x]
    frame = pd.DataFrame({"sequence": text, "label": y})
    cells = spark.createDataFrame([("c", m, s) for m in ("local_cnn", "rnn") for s in (0, 1)], "condition string, model string, seed long")
    data = {("c", s): {"train": frame, "validation": frame} for s in (0, 1)}
    rows = training.train_grid(cells, data, {k: SETTINGS[k] for k in ("local_cnn", "rnn")}, epochs=2, patience=2).collect()
    assert {(r.model, r.seed) for r in rows} == {("local_cnn", 0), ("local_cnn", 1), ("rnn", 0), ("rnn", 1)} and all(r.epochs_completed == 2 for r in rows)
    r = next(r for r in rows if r.model == "local_cnn")
    network = training.loads(r.weights, "local_cnn", 20, SETTINGS["local_cnn"])
    got = spark.createDataFrame(frame).select("sequence", training.predicted(F.col("sequence"), network).alias("p")).collect()
    assert {g.sequence: round(g.p, 5) for g in got} == {t: round(float(p), 5) for t, p in zip(text, training.probabilities(network, x))}
