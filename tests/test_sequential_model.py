"""The batched network against one that walks through the tokens of one text."""

import numpy as np
import pytest

from codegrain.functions.featurize import features
from codegrain.functions.shingles import text_buffers
from codegrain.operators.model import Config, logits, seeded_weights
from codegrain.schemas import LAYOUTS, N_FLAGS, WORD_HASHES


def sig(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def tanh(x):
    return np.tanh(np.clip(x, -15, 15))


def rms(x):
    return x / np.sqrt(np.mean(x * x) + 1e-6)


def walk(f, c, w):
    """Scores of one text's tokens, token by token."""
    w = {k: v.astype(np.float64) for k, v in w.items()}
    n, lay = len(f["kind"]), LAYOUTS[c.layout]
    xs = []
    for t in range(n):
        e = np.zeros(c.embed)
        for name, at in lay.offsets.items():
            if name == "flags":
                for bit in range(N_FLAGS):
                    e = e + w["embed"][at + bit] * (int(f["flags"][t]) >> bit & 1)
            elif name not in WORD_HASHES or f["kind"][t] == 0:
                e = e + w["embed"][at + f[name][t]]
        xs.append(w["up"] @ e)
    first = list(xs)
    view = np.concatenate((sum(xs) / n, np.max(xs, axis=0)))
    film = tanh((w["film_up"] @ tanh(w["film_down"] @ rms(view))).reshape(c.layers, 2, c.dim))
    for i in range(c.layers):
        h = [rms(x) * (1 + w["strength"][i] * film[i, 0]) + w["strength"][i] * film[i, 1] for x in xs]
        step, half = c.dilations[i], c.kernel // 2
        conv = [sum(w[f"conv{i}"][:, j] * h[t + (j - half) * step] for j in range(c.kernel) if 0 <= t + (j - half) * step < n) for t in range(n)]
        add, keep = [], []
        for h_t in conv:
            both = w[f"in{i}"] @ h_t
            add.append(tanh(both[: c.dim]) * sig(both[c.dim :]))
            keep.append(1 - sig(w[f"erase_up{i}"] @ tanh(w[f"erase_down{i}"] @ h_t)))
        state, ahead, back = np.zeros(c.dim), [], [None] * n
        for t in range(n):
            state = sig(w[f"ahead{i}"]) * keep[t][: c.dim] * state + add[t]
            ahead.append(state)
        state = np.zeros(c.dim)
        for t in reversed(range(n)):
            state = sig(w[f"back{i}"]) * keep[t][c.dim :] * state + add[t]
            back[t] = state
        xs = [x + w[f"out{i}"] @ np.concatenate((a, b)) / 2 for x, a, b in zip(xs, ahead, back, strict=True)]
    out = []
    for t in range(n):
        gates = [sig(x) for x in xs[: t + 1]]
        prefix = sum(x * g for x, g in zip(xs[: t + 1], gates, strict=True)) / np.maximum(sum(gates), 1)
        suffix = sum(xs[t:]) / (n - t)
        context = tanh(w["summary"] @ np.concatenate((prefix, suffix))) * sig(w["gate"] @ xs[t])
        z = w["head_hidden"] @ np.concatenate((rms(xs[t] + 0.5 * first[t]), context))
        z = z * (1 + np.tanh(0.7978845608 * z * (1 + 0.044715 * z * z))) / 2
        out.append(w["head_out"] @ z)
    return np.array(out)


@pytest.mark.parametrize("seed", [7, 11])
def test_batch_equals_walk(seed):
    import pyarrow as pa

    c = Config()
    w = seeded_weights(c, seed)
    texts = ["def f(x):\n    return {x: 'a'} // 2\n", "x", "if (a <= 3.5e2) { b[i] += MAX_N; }\n\n\t# é\n"]
    f = features(*text_buffers(pa.array(texts)), c.layout)
    batch = logits(f, len(texts), c, w)
    for i in range(len(texts)):
        mine = f["row"] == i
        one = {k: v[mine] for k, v in f.items()}
        assert np.allclose(batch[mine], walk(one, c, w), atol=2e-4)
