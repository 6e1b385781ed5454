"""A linear-chain conditional random field over numbered features, in numpy, for whole columns of tokens."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    """``emit[feature, label]``, ``move[from, to]`` and ``begin[label]`` of the first token of a sequence; three labels, 0 is outside."""

    emit: np.ndarray
    move: np.ndarray
    begin: np.ndarray
    pairs: np.ndarray | None = None

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """By how much labels 1 and 2 outweigh label 0 by the features of each token: (features, tokens) to (tokens, 2)."""
        if self.pairs is None:  # two float32 in one number are one look-up
            self.pairs = np.ascontiguousarray(self.emit[:, 1:] - self.emit[:, :1], dtype="f4").view("c8").ravel()
        out = np.zeros(ids.shape[1], dtype="c8")
        for row in ids:
            out += self.pairs[row]
        return out.view("f4").reshape(-1, 2)

    def reach(self) -> float:
        """What a token that is not outside can gain by its two transitions, at most."""
        return 1e-3 + 2 * max(0.0, float((self.move - self.move[0, 0]).max()), float((self.begin - self.begin[0]).max()))

    def viterbi(self, gains: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The most probable labels of the sequences first..stop of ``gains`` (tokens, 2), all other tokens 0."""
        labels = np.zeros(len(gains), dtype="i1")
        lengths = stop - first
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.nonzero(np.diff(np.log2(np.maximum(lengths[order], 1)).astype(int)))[0] + 1):
            width = int(lengths[group].max()) if len(group) else 0
            for part in np.array_split(group, max(1, len(group) * width // 400_000)):
                self._decode(gains, first[part], lengths[part], width, labels)
        return labels

    def _decode(self, gains: np.ndarray, first: np.ndarray, lengths: np.ndarray, width: int, labels: np.ndarray) -> None:
        n = len(first)
        if not n:
            return
        at = np.minimum(first[:, None] + np.arange(width)[None, :], len(gains) - 1)
        scores = np.zeros((n, width, 3), dtype="f4")
        scores[:, :, 1:] = gains[at]
        best = scores[:, 0] + self.begin
        back = np.zeros((n, width, 3), dtype="i1")
        for t in range(1, width):
            paths = best[:, :, None] + self.move[None]
            back[:, t] = paths.argmax(axis=1)
            best = np.where((t < lengths)[:, None], paths.max(axis=1) + scores[:, t], best)
        label = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(width - 1, -1, -1):
            live = t < lengths
            labels[at[live, t]] = label[live]
            label = np.where(live, back[rows, t, label], label)

def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(ids: np.ndarray, first: np.ndarray, gold: np.ndarray, features: int, labels: int, *, rounds: int = 9, rate: float = 0.3, decay: float = 3e-5, batch: int = 256, seed: int = 5) -> Crf:
    """Maximises the conditional log-likelihood by AdaGrad; a step touches only the features of its batch.

    ``ids`` is (templates, tokens), ``first`` the first token of each sequence
    (none is empty), ``gold`` the labels.
    """
    rng = np.random.default_rng(seed)
    emit, move, begin = np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels)
    past = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6), np.full_like(begin, 1e-6)]
    lengths = np.diff(np.append(first, ids.shape[1]))
    order = np.argsort(lengths, kind="stable")
    packs = []
    for group in np.array_split(order, max(1, len(order) // batch)):
        width = int(lengths[group].max())
        live = np.arange(width)[None, :] < lengths[group][:, None]
        at = (first[group][:, None] + np.arange(width)[None, :])[live]
        known, where = np.unique(ids[:, at], return_inverse=True)
        packs.append((live, known, where.reshape(len(ids), -1), gold[at]))
    for _ in range(rounds):
        for pick in rng.permutation(len(packs)):
            live, known, where, truth_of = packs[pick]
            n, width = live.shape
            own = emit[known]
            scores = np.zeros((n, width, labels))
            scores[live] = own[where].sum(axis=0)
            fore = np.zeros_like(scores)
            fore[:, 0] = scores[:, 0] + begin
            for t in range(1, width):
                step = _log_sum(fore[:, t - 1, :, None] + move[None], 1) + scores[:, t]
                fore[:, t] = np.where(live[:, t, None], step, fore[:, t - 1])
            back = np.zeros_like(scores)
            for t in range(width - 2, -1, -1):
                step = _log_sum(move[None] + (scores[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(live[:, t + 1, None], step, 0.0)
            total = _log_sum(fore[:, -1], 1)
            shares = np.exp(fore + back - total[:, None, None]) * live[:, :, None]
            truth = np.zeros_like(scores)
            truth[live] = np.eye(labels)[truth_of]
            wrong = (truth - shares)[live]
            flat = where.ravel()
            d_emit = np.stack([np.bincount(flat, np.tile(wrong[:, y], len(where)), len(known)) for y in range(labels)], axis=1)
            pairs = np.exp(fore[:, :-1, :, None] + move[None, None] + (scores[:, 1:] + back[:, 1:])[:, :, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
            d_move = np.einsum("nti,ntj->ij", truth[:, :-1], truth[:, 1:]) - pairs.sum(axis=(0, 1))
            d_begin = truth[:, 0].sum(axis=0) - shares[:, 0].sum(axis=0)
            slope = d_emit / n - decay * own
            past[0][known] += slope * slope
            emit[known] = own + rate * slope / np.sqrt(past[0][known])
            for value, slope, sum_of in ((move, d_move / n, past[1]), (begin, d_begin / n, past[2])):
                sum_of += slope * slope
                value += rate * slope / np.sqrt(sum_of)
    return Crf(emit.astype("f4"), move.astype("f4"), begin.astype("f4"))
