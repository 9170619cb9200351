"""A character convolutional network in numpy that reads a span and its context, whatever their lengths.

Characters fall into CLASSES; a filter of WIDTH places is a table of weights by place and class, so a convolution is a sum of
WIDTH lookups.  Filters pass a ReLU and are pooled three ways (largest and mean inside the span, largest in the context); a
hidden layer and a logit follow.  All spans of a batch lie in one array, and pooling is by segments of it: nothing is padded and
nothing cut, and long spans are read in parts.  Training is Adam on the logistic loss; the logit is then calibrated by Platt's
method on findings of their own, and the threshold is the one with fewest false findings among those that keep RECALL.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Printable ASCII, one class for other ASCII, four for the rest by height, and 0 for nothing.
CLASSES = 101
WIDTH = 5
FILTERS = 16
HIDDEN = 16
EPOCHS = 6
BATCH = 256
RATE = 0.01
RECALL = 0.97
#: Characters of one part of a span.
PART = 4096

#: (context before, span, context after)
Window = tuple[str, str, str]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    high = 96 + np.searchsorted([0x80, 0x250, 0x2000, 0x10000], points, "right")
    return np.where(points >= 0x80, high, np.where((points >= 32) & (points < 127), points - 31, 96)).astype(np.int64)


def _layout(windows: list[Window]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows in one array of classes with WIDTH - 1 gaps between, the starts of segments, the window and kind (inside or not) of each."""
    parts, starts, owner, inside, at = [], [], [], [], 0
    gap = np.zeros(WIDTH - 1, np.int64)
    for i, (before, span, after) in enumerate(windows):
        for text, kind in ((before, False), (span, True), (after, False)):
            for low in range(0, len(text), PART):
                starts.append(at + low)
                owner.append(i)
                inside.append(kind)
            at += len(text)
        parts += [codes(before + span + after), gap]
        starts.append(at)
        owner.append(len(windows))  # the gap belongs to no window
        inside.append(False)
        at += WIDTH - 1
    return np.concatenate(parts), np.array(starts), np.array(owner), np.array(inside)


@dataclass
class CharCnn:
    filters: np.ndarray  # WIDTH x CLASSES x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 3 FILTERS + 1 x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    slope: float = 1.0  # of the calibration
    offset: float = 0.0
    threshold: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 0) -> CharCnn:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape)
        return cls(draw(0.3, WIDTH, CLASSES, FILTERS), np.zeros(FILTERS), draw(0.2, 3 * FILTERS + 1, HIDDEN), np.zeros(HIDDEN), draw(0.3, HIDDEN), np.zeros(1))

    def weights(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def _pooled(self, windows: list[Window]):
        chars, starts, owner, inside = _layout(windows)
        long = np.concatenate([chars, np.zeros(WIDTH, np.int64)])
        seen = self.bias + sum(self.filters[k][long[k : k + len(chars)]] for k in range(WIDTH))
        active = np.maximum(seen, 0)
        tops, sums = np.maximum.reduceat(active, starts), np.add.reduceat(active, starts)
        n = len(windows)
        best, other, mean = (np.zeros((n + 1, FILTERS)) for _ in range(3))
        np.maximum.at(best, owner[inside], tops[inside])
        np.maximum.at(other, owner[~inside], tops[~inside])
        np.add.at(mean, owner[inside], sums[inside])
        sizes = np.array([max(1, len(span)) for _, span, _ in windows], float)
        features = np.hstack([best[:n], mean[:n] / sizes[:, None], other[:n], np.log(sizes)[:, None] / 5])
        return features, (chars, long, active, starts, owner, inside, best, other, sizes)

    def logits(self, windows: list[Window]) -> np.ndarray:
        if not windows:
            return np.zeros(0)
        features, _ = self._pooled(windows)
        return np.maximum(features @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def scores(self, windows: list[Window], at_once: int = BATCH) -> np.ndarray:
        """Calibrated probabilities, a bounded number of windows at a time."""
        parts = [self.logits(windows[i : i + at_once]) for i in range(0, len(windows), at_once)]
        return _sigmoid(self.slope * np.concatenate([np.zeros(0), *parts]) + self.offset)

    def gradients(self, windows: list[Window], labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean logistic loss and its gradient for each array of weights."""
        features, (chars, long, active, starts, owner, inside, best, other, sizes) = self._pooled(windows)
        before = features @ self.hidden + self.hidden_bias
        held = np.maximum(before, 0)
        logit = held @ self.out + self.out_bias[0]
        loss = float(np.mean(np.logaddexp(0, logit) - labels * logit))
        d_logit = (_sigmoid(logit) - labels) / len(windows)
        d_before = np.outer(d_logit, self.out) * (before > 0)
        d_features = d_before @ self.hidden.T
        # back to places: the mean goes to every place inside, a largest value to the first place that has it
        where = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(chars))))
        place_owner, place_inside = owner[where], inside[where]
        d_mean = np.vstack([d_features[:, FILTERS : 2 * FILTERS] / sizes[:, None], np.zeros(FILTERS)])
        d_place = np.where(place_inside[:, None], d_mean[place_owner], 0.0)
        for pooled, kind, d_top in ((best, True, d_features[:, :FILTERS]), (other, False, d_features[:, 2 * FILTERS : 3 * FILTERS])):
            hits = (active == pooled[place_owner]) & (place_inside == kind)[:, None] & (active > 0) & (place_owner < len(windows))[:, None]
            for f in range(FILTERS):
                at = np.flatnonzero(hits[:, f])
                _, first = np.unique(place_owner[at], return_index=True)
                d_place[at[first], f] += d_top[place_owner[at[first]], f]
        d_place *= active > 0
        d_filters = np.empty_like(self.filters)
        for k in range(WIDTH):
            shifted = long[k : k + len(chars)]
            for f in range(FILTERS):
                d_filters[k, :, f] = np.bincount(shifted, d_place[:, f], CLASSES)
        return loss, [d_filters, d_place.sum(0), features.T @ d_before, d_before.sum(0), held.T @ d_logit, d_logit.sum(keepdims=True)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))


def fit(windows: list[Window], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> CharCnn:
    """A network trained by Adam; the order of findings depends on the seed alone."""
    net, rng, truth = CharCnn.fresh(seed), np.random.default_rng(seed), np.array(labels, float)
    first, second, step = [np.zeros_like(w) for w in net.weights()], [np.zeros_like(w) for w in net.weights()], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            _, found = net.gradients([windows[i] for i in chosen], truth[chosen])
            step += 1
            for w, g, m, v in zip(net.weights(), found, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def calibrate(net: CharCnn, windows: list[Window], labels: list[int], recall: float = RECALL) -> CharCnn:
    """Fit slope and offset of the probability (Platt's targets, Newton steps), then choose the threshold."""
    truth = np.array(labels, float)
    logits = np.concatenate([np.zeros(0), *[net.logits(windows[i : i + BATCH]) for i in range(0, len(windows), BATCH)]])
    up, down = truth.sum(), len(truth) - truth.sum()
    wanted = np.where(truth > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, beta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        curve = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        beta = beta - np.linalg.solve(curve, x.T @ (p - wanted) + 1e-6 * beta)
    net.slope, net.offset = float(beta[0]), float(beta[1])
    net.threshold = constrained_threshold(_sigmoid(x @ beta), truth, recall)
    return net


def constrained_threshold(scores: np.ndarray, truth: np.ndarray, recall: float) -> float:
    """Of the thresholds that keep ``recall`` of the true findings, the one with fewest false ones; of equal ones the lowest."""
    real, false = np.sort(scores[truth > 0])[::-1], np.sort(scores[truth <= 0])
    if not len(real):
        return 1.0
    needed = real[max(0, int(np.ceil(recall * len(real))) - 1) :]
    passed = len(false) - np.searchsorted(false, needed, "left")
    best = passed.min()
    lowest = needed[passed == best].min()
    # halfway to the next false finding below, so that the threshold does not sit on a true one
    below = false[false < lowest]
    return float((lowest + below[-1]) / 2) if len(below) else float(lowest / 2)
