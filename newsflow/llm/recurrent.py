"""A bidirectional gated recurrent network with attention pooling over windows of words, in numpy.

A word's input is the vector of its hashed form plus the vectors of its character triples. Both directions
read a window; attention weighs their states, a logistic output judges the pooled state. A text is as toxic as its
most toxic window, so training passes a text's loss to its windows by their share of a smooth maximum, and
texts labelled 0 also bring back the windows that the network finds worst so far.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from newsflow.llm.words import _sums, mix, raw_bytes, slices

#: Words of a window and step between windows (every word is in two or more of a long text), sizes of the layers and of the hashed tables.
WIDTH, STEP, INPUT, STATE, TABLE = 16, 8, 16, 8, 1 << 13

_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[[i for i in range(128) if not chr(i).isalnum()]] = 0
_VALUES = np.random.Generator(np.random.PCG64(1131)).integers(1, 1 << 63, 256, dtype=np.uint64)
_VALUES[0] = 0


@dataclass
class Forms:
    """Words (letters and digits, A-Z lowered) of some rows: distinct forms by hashed word and triples, and the form of each word."""

    prints: np.ndarray
    triples: np.ndarray
    owner: np.ndarray
    scale: np.ndarray
    form: np.ndarray
    first: np.ndarray

    @property
    def hashed(self) -> np.ndarray:
        return (self.prints % np.uint64(TABLE)).astype(np.int64)

    @property
    def size(self) -> int:
        return len(self.prints)


def forms_of(column) -> Forms:
    data, rows = raw_bytes(column)
    data = _LETTER[data]
    word = data > 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = rows[rows < len(data)]
    begins[inner] = word[inner]
    start = np.flatnonzero(begins)
    # A row's end stops a word too.
    limit = np.append(np.flatnonzero(np.append(~word, True)), len(data))
    stop = limit[np.searchsorted(limit, start)]
    stop = np.minimum(stop, rows[np.minimum(np.searchsorted(rows, start, "right"), len(rows) - 1)])
    prints = _sums(_VALUES[data], start, len(data))
    prints, at, form = np.unique(prints, return_index=True, return_inverse=True)
    begin, size = start[at], stop[at] - start[at]
    # Bytes around each place of a form, zeros outside of it.
    owner = np.repeat(np.arange(len(at)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    mid = begin[owner] + place
    left = np.where(place > 0, data[np.maximum(mid - 1, 0)], 0).astype(np.uint64)
    right = np.where(place + 1 < size[owner], data[np.minimum(mid + 1, max(len(data) - 1, 0))], 0).astype(np.uint64)
    code = (left << np.uint64(16)) | (data[mid].astype(np.uint64) << np.uint64(8)) | right
    triples = (mix(code + np.uint64(1)) % np.uint64(TABLE)).astype(np.uint16)
    return Forms(prints, triples, owner.astype(np.int32), (1 / np.sqrt(np.maximum(size, 1))).astype(np.float32), form.astype(np.int32), np.searchsorted(start, rows))


def united(parts: list[Forms]) -> Forms:
    """Forms of consecutive rows, made in slices, as one."""
    if len(parts) == 1:
        return parts[0]
    prints, at = np.unique(np.concatenate([f.prints for f in parts]), return_index=True)
    base = np.cumsum([0, *(f.size for f in parts)])
    shift = np.cumsum([0, *(len(f.form) for f in parts)])
    chosen = [chosen_forms(f, at[(at >= a) & (at < a + f.size)] - a) for f, a in zip(parts, base)]
    owner = np.concatenate([f.owner + a for f, a in zip(chosen, np.cumsum([0, *(f.size for f in chosen)]))])
    # Chosen forms come slice by slice; their order by fingerprint is that of ``prints``.
    found = np.concatenate([f.prints for f in chosen])
    place = np.argsort(np.argsort(found))
    whole = Forms(found, np.concatenate([f.triples for f in chosen]), owner.astype(np.int32), np.concatenate([f.scale for f in chosen]), np.zeros(0, np.int32), np.zeros(0))
    back = np.argsort(place)
    whole.form = np.concatenate([back[np.searchsorted(prints, f.prints)][f.form] for f in parts]).astype(np.int32)
    whole.first = np.concatenate([[0], *(f.first[1:] + a for f, a in zip(parts, shift))]).astype(np.int64)
    return whole


def chosen_forms(forms: Forms, used: np.ndarray) -> Forms:
    size = np.bincount(forms.owner, minlength=forms.size)
    begin = np.cumsum(size) - size
    count = size[used]
    at = np.arange(int(count.sum())) + np.repeat(begin[used] - (np.cumsum(count) - count), count)
    return Forms(forms.prints[used], forms.triples[at], np.repeat(np.arange(len(used)), count).astype(np.int32), forms.scale[used], used, forms.first)


def window_starts(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and row of each window; a row without words has one, too."""
    n = np.diff(first)
    count = np.maximum(-(-(n - WIDTH) // STEP), 0) + 1
    row = np.repeat(np.arange(len(n)), count)
    return first[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (1 + np.tanh(x * np.float32(0.5)))


class Network:
    """Parameters by name; all float32."""

    def __init__(self, seed: int = 5) -> None:
        draw = np.random.Generator(np.random.PCG64(seed))
        shape = {
            "word": (TABLE, INPUT), "triple": (TABLE, INPUT), "inward": (2, INPUT, 3 * STATE), "bias": (2, 1, 3 * STATE), "recur": (2, STATE, 3 * STATE),
            "attend": (2 * STATE,), "out": (2 * STATE,), "base": (1,),
        }
        self.p = {k: (draw.standard_normal(s) * {"word": 0.1, "triple": 0.1, "bias": 0, "base": 0}.get(k, 1 / np.sqrt(max(s[-2] if len(s) > 1 else s[0], 1)))).astype(np.float32) for k, s in shape.items()}
        self.p["base"] -= 2
        self.shift, self.scale = 0.0, 1.0

    def inputs(self, forms: Forms) -> np.ndarray:
        """Input vector of each form."""
        x = self.p["word"][forms.hashed]
        if len(forms.owner):
            begins = np.flatnonzero(np.append(True, forms.owner[1:] != forms.owner[:-1]))
            x = x + np.add.reduceat(self.p["triple"][forms.triples], begins) * forms.scale[:, None].astype(np.float32)
        return x

    def run(self, inward: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows. ``inward``: (2, n, WIDTH, 3 * STATE) input parts, words that are not there are NaN in the first place."""
        p, n = self.p, inward.shape[1]
        there = ~np.isnan(inward[0, :, :, 0])
        inward = np.nan_to_num(inward) if not there.all() else inward
        h = np.zeros((2, n, STATE), np.float32)
        states = np.zeros((n, WIDTH, 2 * STATE), np.float32)
        trace = []
        for t in range(WIDTH):
            at = (t, WIDTH - 1 - t)
            x = np.stack([inward[d][:, at[d]] for d in (0, 1)])
            u = np.matmul(h, p["recur"])
            gates = _sigmoid(x[..., :2 * STATE] + u[..., :2 * STATE])
            z, r = gates[..., :STATE], gates[..., STATE:]
            c = np.tanh(x[..., 2 * STATE:] + r * u[..., 2 * STATE:])
            live = np.stack([there[:, at[d]] for d in (0, 1)])[..., None]
            new = np.where(live, c + z * (h - c), h)
            if keep:
                trace.append((h, z, r, c, u[..., 2 * STATE:], live))
            h = new
            for d in (0, 1):
                states[:, at[d], d * STATE:(d + 1) * STATE] = h[d]
        score = states @ p["attend"]
        score = np.where(there, score, np.float32(-1e4))
        score -= score.max(axis=1, keepdims=True)
        weight = np.exp(score)
        weight /= weight.sum(axis=1, keepdims=True)
        pooled = np.einsum("nt,nts->ns", weight, states)
        return pooled @ p["out"] + p["base"], {"states": states, "weight": weight, "pooled": pooled, "trace": trace}

    def inward(self, x: np.ndarray, form: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input parts of windows from input vectors of all forms."""
        place = starts[:, None] + np.arange(WIDTH)
        which = np.where(place < ends[:, None], form[np.minimum(place, len(form) - 1)] if len(form) else 0, len(x))
        return self.parts(x)[:, which]

    def gradients(self, inward: np.ndarray, which: np.ndarray, forms: Forms, x: np.ndarray, lost: np.ndarray, kept: dict) -> dict[str, np.ndarray]:
        """Derivatives for derivatives ``lost`` of the loss by the logits; ``which`` holds the form of each place (forms.size: none)."""
        p, states, weight, pooled = self.p, kept["states"], kept["weight"], kept["pooled"]
        g = {"base": lost.sum(keepdims=True), "out": pooled.T @ lost}
        d_pooled = lost[:, None] * p["out"]
        d_weight = np.einsum("ns,nts->nt", d_pooled, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        g["attend"] = np.einsum("nt,nts->s", d_score, states)
        d_states = weight[:, :, None] * d_pooled[:, None] + d_score[:, :, None] * p["attend"]
        d_h = np.zeros((2, len(lost), STATE), np.float32)
        g["recur"] = np.zeros_like(p["recur"])
        d_in = np.zeros((2, len(lost), WIDTH, 3 * STATE), np.float32)
        for t in reversed(range(WIDTH)):
            at = (t, WIDTH - 1 - t)
            h, z, r, c, u, live = kept["trace"][t]
            d_h = d_h + np.stack([d_states[:, at[d], d * STATE:(d + 1) * STATE] for d in (0, 1)])
            d_new = np.where(live, d_h, 0)
            d_c = d_new * (1 - z) * (1 - c * c)
            d_z = d_new * (h - c) * z * (1 - z)
            d_r = d_c * u * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], axis=-1)
            d_u = np.concatenate([d_z, d_r, d_c * r], axis=-1)
            g["recur"] += np.matmul(h.transpose(0, 2, 1), d_u)
            d_h = np.where(live, d_h * z, d_h) + np.matmul(d_u, p["recur"].transpose(0, 2, 1))
            for d in (0, 1):
                d_in[d, :, at[d]] = d_x[d]
        flat = which.reshape(-1)
        order = np.argsort(flat, kind="stable")
        used, begin = np.unique(flat[order], return_index=True)
        d_parts = np.zeros((2, forms.size + 1, 3 * STATE), np.float32)
        d_parts[:, used] = np.add.reduceat(d_in.reshape(2, -1, 3 * STATE)[:, order], begin, axis=1)
        d_parts = d_parts[:, :forms.size]
        g["bias"] = d_parts.sum(axis=1, keepdims=True)
        g["inward"] = np.matmul(x.T[None], d_parts)
        d_x = np.matmul(d_parts, p["inward"].transpose(0, 2, 1)).sum(axis=0)
        g["word"], g["triple"] = np.zeros_like(p["word"]), np.zeros_like(p["triple"])
        np.add.at(g["word"], forms.hashed, d_x)
        np.add.at(g["triple"], forms.triples, (d_x * forms.scale[:, None].astype(np.float32))[forms.owner])
        return g

    def logits(self, forms: Forms, starts: np.ndarray, ends: np.ndarray, block: int = 4096) -> np.ndarray:
        """Logits of windows; input vectors are made for all forms at once, or block by block where they are very many."""
        x = self.inputs(forms) if forms.size <= 100_000 else None
        out = []
        for i in range(0, len(starts), block):
            a, b = starts[i:i + block], ends[i:i + block]
            if x is not None:
                inward = self.inward(x, forms.form, a, b)
            else:
                local, some = self.local(forms, a, b)
                inward = self.parts(self.inputs(some))[:, local]
            out.append(self.run(inward)[0])
        return np.concatenate(out) if out else np.zeros(0, np.float32)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """What each form adds to the gates of both directions, and NaN for a word that is not there."""
        parts = np.matmul(x[None], self.p["inward"]) + self.p["bias"]
        return np.concatenate([parts, np.full((2, 1, 3 * STATE), np.nan, np.float32)], axis=1)

    def local(self, forms: Forms, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, Forms]:
        """The forms of some windows, and their numbers among those at each place of the windows (their count: no word)."""
        place = starts[:, None] + np.arange(WIDTH)
        which = np.where(place < ends[:, None], forms.form[np.minimum(place, len(forms.form) - 1)] if len(forms.form) else 0, forms.size)
        used, local = np.unique(which, return_inverse=True)
        used = used[used < forms.size]
        return local.reshape(which.shape), chosen_forms(forms, used)

    def texts(self, column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: chance of label 1, windows, first word of the worst window (of equal ones the first)."""
        forms = forms_of(column)
        starts, row = window_starts(forms.first)
        logit = self.logits(forms, starts, forms.first[row + 1])
        begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))[:len(column)]
        top = np.maximum.reduceat(logit, begin) if len(begin) else np.zeros(0)
        is_top = np.flatnonzero(logit == top[row])
        at = is_top[np.searchsorted(row[is_top], np.arange(len(column)))]
        score = 1 / (1 + np.exp(-np.clip((top.astype(float) - self.shift) * self.scale, -30, 30)))
        return score, np.bincount(row, minlength=len(column)), starts[at] - forms.first[row[at]]


def shares(logit: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smooth maximum of each row's logits, and each window's share of it."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, logit)
    e = np.exp(logit - top[row])
    total = np.bincount(row, e, n)
    return top + np.log(total), e / total[row]


def fit_network(column, label: np.ndarray, epochs: int = 6, batch: int = 24, most: int = 48, seed: int = 3) -> Network:
    """A network for texts and their 0/1 labels, by Adam on the logistic loss of the texts' smooth maxima.

    Per epoch a text brings at most ``most`` windows: all or a random choice where its label is 1, and a few random ones and its
    worst ones so far where it is 0. The threshold is where training texts are told apart best. Without both labels every
    score is that of the label there is (0 without texts).
    """
    net = Network()
    if len(set(label.tolist())) < 2:
        net.p["out"][:], net.p["base"][:] = 0, 4 if len(label) and label[0] else -4
        return net
    draw = np.random.Generator(np.random.PCG64(seed))
    forms = united([forms_of(column.slice(a, b - a)) for a, b in slices(column)])
    starts, row = window_starts(forms.first)
    begin = np.searchsorted(row, np.arange(len(label) + 1))
    ends = forms.first[row + 1]
    worst = np.zeros(len(starts), np.float32)
    good, bad = np.flatnonzero(label == 0), np.flatnonzero(label == 1)
    mean, square, step = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(3))
    step, steps = 0, epochs * max(1, len(bad) // (batch // 3))
    for epoch in range(epochs):
        if epoch >= 2:
            worst = net.logits(forms, starts, ends)
        pools = [draw.permutation(bad), draw.permutation(good)]
        for i in range(max(1, len(bad) // (batch // 3))):
            docs = np.concatenate([np.take(pools[0], range(i * (batch // 3), (i + 1) * (batch // 3)), mode="wrap"), np.take(pools[1], range(i * (batch * 2 // 3), (i + 1) * (batch * 2 // 3)), mode="wrap")])
            chosen, owner = [], []
            for k, d in enumerate(docs):
                own = np.arange(begin[d], begin[d + 1])
                if label[d] == 1 and len(own) > most:
                    own = own[np.argsort(-(worst[own] + draw.gumbel(size=len(own))))[:most]]
                elif label[d] == 0 and len(own) > most // 3:
                    rank = own[np.argsort(-worst[own])]
                    own = np.concatenate([rank[:most // 6], draw.choice(rank[most // 6:], most // 6, replace=False)])
                chosen.append(own)
                owner.append(np.full(len(own), k))
            chosen, owner = np.concatenate(chosen), np.concatenate(owner)
            local, some = net.local(forms, starts[chosen], ends[chosen])
            x = net.inputs(some)
            inward = net.parts(x)[:, local]
            logit, kept = net.run(inward, keep=True)
            value, share = shares(logit.astype(float), owner, len(docs))
            lost = ((1 / (1 + np.exp(-np.clip(value, -30, 30))) - label[docs]) / len(docs))[owner] * share
            g = net.gradients(inward, local, some, x, lost.astype(np.float32), kept)
            step += 1
            rate = 0.02 * (1 - step / (steps + 1))
            for k, v in net.p.items():
                mean[k] += 0.1 * (g[k] - mean[k])
                square[k] += 0.01 * (g[k] * g[k] - square[k])
                v -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    top = np.maximum.reduceat(net.logits(forms, starts, ends), begin[:-1]).astype(float)
    net.shift = best_cut(top, label)
    return net


def best_cut(value: np.ndarray, label: np.ndarray) -> float:
    """The middle of the widest of the cuts with the fewest wrong texts, both labels weighed alike."""
    order = np.argsort(value, kind="stable")
    v, y = value[order], label[order]
    wrong = np.concatenate([[0], np.cumsum(y == 1)]) / max((y == 1).sum(), 1) + np.concatenate([[0], np.cumsum(y == 0)])[-1] / max((y == 0).sum(), 1) - np.concatenate([[0], np.cumsum(y == 0)]) / max((y == 0).sum(), 1)
    wrong = wrong[1:-1]
    gap = np.diff(v)
    fine = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    at = fine[np.argmax(gap[fine])]
    return float(v[at] + v[at + 1]) / 2
