"""Learnt operators against plain loops: the network's forward pass and gradient, and the decoding of codewords."""

import math

import numpy as np
import pytest

from gridstride.llm import langid, toxicity


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_logit(net, x):
    """One window, word by word: both directions, attention, the output."""
    p, h = net.p, toxicity.HIDDEN
    states = {}
    for side, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
        state, seen = np.zeros(h), {}
        for t in order:
            gate, turn = x[t] @ p[f"in_{side}"] + p[f"in_{side}_b"], state @ p[f"state_{side}"]
            r, z = sigmoid(gate[:h] + turn[:h]), sigmoid(gate[h : 2 * h] + turn[h : 2 * h])
            new = np.tanh(gate[2 * h :] + r * turn[2 * h :])
            state = (1 - z) * new + z * state
            seen[t] = state
        states[side] = [seen[t] for t in range(len(x))]
    both = [np.concatenate((a, b)) for a, b in zip(states["f"], states["b"], strict=True)]
    scores = [np.tanh(s @ p["attend"] + p["attend_b"]) @ p["query"] for s in both]
    share = [math.exp(s - max(scores)) for s in scores]
    pooled = sum(w * s for w, s in zip(share, both, strict=True)) / sum(share)
    return pooled @ p["out"] + p["out_b"][0]


def test_forward_pass_equals_a_plain_loop():
    net, r = toxicity.Network(7), np.random.default_rng(1)
    words = [bytes(r.integers(97, 123, r.integers(1, 12)).tolist()) for _ in range(40)]
    x = net.vectors(*toxicity.word_inputs(words))
    idx = np.zeros((12, 9), np.int64)
    for row in idx:
        n = r.integers(1, 10)
        row[:n] = r.integers(1, 41, n)
    got = net.logits(net.gates(x), idx)
    for row, z in zip(idx, got, strict=True):
        assert z == pytest.approx(plain_logit(net, [x[i - 1] for i in row if i]), abs=1e-4)


def test_gradient_of_every_parameter_above_the_gates():
    net, r = toxicity.Network(8), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    gates = net.gates(r.normal(0, 0.5, (20, toxicity.WORD_DIM + toxicity.CHAR_DIM)))
    idx = r.integers(1, 21, (4, 6))
    idx[1, 3:] = 0
    weight = r.normal(0, 1, 4)
    tape = {}
    net.logits(gates, idx, tape)
    g, dgates = net.gradient(tape, weight, len(gates))
    for name in ("attend", "attend_b", "query", "out", "out_b", "state_f", "state_b"):
        flat, want = net.p[name].reshape(-1), np.asarray(g[name]).reshape(-1)
        for k in r.integers(0, len(flat), 6):
            before, step = flat[k], 1e-2
            values = []
            for d in (step, -step):
                flat[k] = before + d
                values.append(weight @ net.logits(gates, idx))
            flat[k] = before
            assert want[k] == pytest.approx((values[0] - values[1]) / (2 * step), abs=2e-2, rel=2e-2), name
    for _ in range(10):
        i, k = r.integers(1, len(gates)), r.integers(0, gates.shape[1])
        before, values = gates[i, k], []
        for d in (1e-2, -1e-2):
            gates[i, k] = before + d
            values.append(weight @ net.logits(gates, idx))
        gates[i, k] = before
        assert dgates[i - 1, k] == pytest.approx((values[0] - values[1]) / 2e-2, abs=2e-2, rel=2e-2)


def test_decoding_equals_a_plain_sum_of_losses():
    r = np.random.default_rng(3)
    for languages in (2, 3, 7):
        code = langid.codewords(languages)
        bits = code.shape[1]
        model = langid.Model([f"l{k}" for k in range(languages)], code, r.normal(0, 1, (langid.FEATURES, bits)), r.normal(0, 1, bits), r.uniform(0.05, 1, bits))
        x = r.normal(0, 0.01, (5, langid.FEATURES))
        got = model.decode(x)
        for row, p in zip(x, got, strict=True):
            losses = [sum(model.trust[b] * math.log(1 + math.exp(-code[k, b] * (row @ model.weights[:, b] + model.bias[b]))) for b in range(bits)) for k in range(languages)]
            shares = [math.exp(min(losses) - v) for v in losses]
            assert p == pytest.approx([s / sum(shares) for s in shares])
            assert int(p.argmax()) == int(np.argmin(losses))
