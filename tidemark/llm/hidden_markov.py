"""A hidden Markov model over word classes: expected counts, re-estimation and exact scaled likelihoods in numpy.

Texts are followed over their whole length. So that many are handled at once, arrays are laid out by time: the first tokens of
all texts, then the second ones, and so on, each state in a row of its own. A long text is cut where the states on both sides of
each cut are known: the product of its parts' transfer matrices tells them exactly, so nothing of the text's probability or
expectations is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

import numpy as np

#: A text is cut into parts of PART tokens if it has more than LONG and more than one in SHARE of the tokens at hand, or more
#: than LONGEST: a part costs several times what a token in an uncut text does, but a few texts by themselves cost more.
LONG, LONGEST, SHARE, PART = 1024, 4096, 1024, 1024
#: Tokens whose forward probabilities are held at once, and whose expectations are.
CHUNK, BLOCK = 1 << 20, 1 << 14
#: Probabilities are scaled once in so many tokens.
SCALED = 8
#: Expected counts of states and their tokens are summed in units of 1 / FIXED, so that sums don't depend on their order.
FIXED = float(1 << 20)


@dataclass
class Model:
    start: np.ndarray  # states, of a text's first token
    step: np.ndarray  # states x states
    emit: np.ndarray  # states x classes


@dataclass
class Counts:
    """Expected counts, which add up over parts of the corpus; start, emit and log_likelihood in units of 1 / FIXED."""

    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    log_likelihood: float = 0.0

    @classmethod
    def zero(cls, states: int, classes: int) -> Counts:
        return cls(np.zeros(states), np.zeros((states, states)), np.zeros((states, classes)))


def random_model(states: int, shares: np.ndarray, seed: int = 7) -> Model:
    """A start for training: the classes' shares, disturbed differently for each state."""
    rng = np.random.default_rng(seed)
    emit = (shares + 1e-6) * rng.gamma(2.0, 0.5, (states, len(shares)))
    step = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


@dataclass
class _Parts:
    """Stretches of tokens to follow: where they begin, their sizes, the text that each is of, whether it begins the text, the
    states at the token before it (states x parts; nothing for a first part) and the weights of the states at its end."""

    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    first: np.ndarray
    enter: np.ndarray
    leave: np.ndarray

    def take(self, k: np.ndarray) -> _Parts:
        return _Parts(self.begin[k], self.size[k], self.text[k], self.first[k], self.enter[:, k], self.leave[:, k])

    def __len__(self) -> int:
        return len(self.begin)


def _cut(off: np.ndarray, states: int, long: int, part: int) -> _Parts:
    size = np.diff(off)
    n = np.where(size > long, -(-size // part), np.minimum(size, 1))
    text = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    step = np.where(n > 1, part, size)[text]
    begin = off[:-1][text] + k * step
    return _Parts(begin, np.minimum(step, off[1:][text] - begin), text, k == 0, np.zeros((states, len(text))), np.ones((states, len(text))))


def _by_time(x: np.ndarray, parts: _Parts) -> tuple[list[int], list[int], np.ndarray]:
    """For parts of falling size: how many are there at each time, offsets of times, and the tokens laid out by time."""
    live = np.searchsorted(-parts.size, -np.arange(1, int(parts.size[0]) + 1), "right")
    at = np.concatenate(([0], np.cumsum(live))).tolist()
    token, place = np.empty(at[-1], x.dtype), np.empty(len(parts), np.intp)
    for t, k in enumerate(live):
        x.take(np.add(parts.begin[:k], t, out=place[:k]), out=token[at[t] : at[t + 1]], mode="clip")
    return live.tolist(), at, token.astype(np.intp)


def _prior(model: Model, parts: _Parts) -> np.ndarray:
    return np.where(parts.first, model.start[:, None], model.step.T @ parts.enter)


def _bridge(model: Model, x: np.ndarray, parts: _Parts) -> np.ndarray:
    """Set enter and leave of the parts of cut texts, which stand in order; returns the log probabilities of their texts by part."""
    states, n = parts.enter.shape
    order = np.argsort(-parts.size, kind="stable")
    p = parts.take(order)
    live, at, token = _by_time(x, p)
    # one column for each state that a part may begin from
    now = np.where(p.first, np.eye(states)[:, :, None], model.step.T[:, :, None])
    logs = np.zeros(n)
    through, log = np.empty((n, states, states)), np.empty(n)
    step, width = np.ascontiguousarray(model.step.T), n
    seen, spare = np.empty(states * n), np.empty(states * states * n)
    for t, k in enumerate(live):
        if k < width:  # parts that have ended
            through[order[k:width]] = now[:, :, k:].transpose(2, 1, 0)
            now, width = np.ascontiguousarray(now[:, :, :k]), k
        if t:
            ahead = np.matmul(step, now.reshape(states, -1), out=spare[: now.size].reshape(states, -1))
            now, spare = ahead.reshape(states, states, k), now.reshape(-1)
        now *= model.emit.take(token[at[t] : at[t + 1]], 1, out=seen[: states * k].reshape(states, k), mode="clip")[:, None, :]
        if _scaled(t, len(live) - 1):
            scale = now.reshape(states * states, k).sum(0)
            logs[:k] += np.log(scale)
            now /= scale
    through[order[:width]] = now.transpose(2, 1, 0)
    log[order] = logs
    state = model.start
    out = np.empty((n, states))
    for k in range(n):
        state = model.start if parts.first[k] else state
        parts.enter[:, k] = state
        state = state @ through[k]
        total = state.sum()
        log[k] += np.log(total)
        out[k] = state = state / total
    ahead = np.ones(states)
    for k in reversed(range(n)):
        if k + 1 == n or parts.first[k + 1]:
            ahead = np.ones(states)
        parts.leave[:, k] = ahead = ahead / (out[k] @ ahead)
        ahead = through[k] @ ahead
    return log


def _scaled(t: int, last: int) -> bool:
    """Whether probabilities are scaled at time t: they fall by less than a hundred digits in between."""
    return t % SCALED == SCALED - 1 or t == last


def _forward(model: Model, live: list[int], at: list[int], token: np.ndarray, prior: np.ndarray, room: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The forward recursion over parts: the logs that were scaled away, what is left at each part's end, and by time the scales.
    room, states x tokens, takes the probabilities of all times; without it they are given up."""
    states, width = prior.shape
    step = np.ascontiguousarray(model.step.T)
    seen, two = np.empty(states * width), np.empty((0 if room is not None else 2, states * width))
    scale: dict[int, np.ndarray] = {}
    logs, last = np.zeros(width), np.empty(width)
    before = prior
    for t, k in enumerate(live):
        here = two[t % 2, : states * k].reshape(states, k) if room is None else room[:, at[t] : at[t + 1]]
        if t:
            np.matmul(step, before[:, :k], out=here)
        else:
            here[:] = prior
        here *= model.emit.take(token[at[t] : at[t + 1]], 1, out=seen[: states * k].reshape(states, k), mode="clip")
        if _scaled(t, len(live) - 1):
            s = scale[t] = here.sum(0)
            here /= s
            logs[:k] += np.log(s)
        ending = live[t + 1] if t + 1 < len(live) else 0
        if ending < k:
            last[ending:k] = here[:, ending:].sum(0)
        before = here
    return logs, last, scale


def _expect(model: Model, x: np.ndarray, parts: _Parts, out: Counts, room: np.ndarray) -> None:
    """Add the expected counts of parts of falling size; room has space for all states of their tokens."""
    live, at, token = _by_time(x, parts)
    states, width = len(model.start), len(parts)
    alpha = room[: states * at[-1]].reshape(states, at[-1])
    logs, last, scale = _forward(model, live, at, token, _prior(model, parts), alpha)
    logs += np.log(last)
    leave = parts.leave * (FIXED / last)  # all that follows is in units of 1 / FIXED
    pairs = np.zeros((states, states))
    seen, beta = np.empty(states * width), np.empty((states, width))
    beta[:, : live[-1]] = leave[:, : live[-1]]
    held, low = np.empty(states * max(BLOCK, width)), len(live)
    for t in reversed(range(len(live))):
        k = live[t]
        if t < low:
            low = min(t, bisect_left(at, at[t + 1] - BLOCK))
            tokens = token[at[low] : at[t + 1]]
            here = held[: states * len(tokens)].reshape(states, -1)
        ahead = model.emit.take(token[at[t] : at[t + 1]], 1, out=seen[: states * k].reshape(states, k), mode="clip")
        ahead *= beta[:, :k]
        if t in scale:
            ahead /= scale[t]
        np.multiply(alpha[:, at[t] : at[t + 1]], beta[:, :k], out=here[:, at[t] - at[low] : at[t + 1] - at[low]])
        if t == low:
            np.rint(here, out=here)
            for i in range(states):
                out.emit[i] += np.bincount(tokens, here[i], out.emit.shape[1])
        if t:
            pairs += alpha[:, at[t - 1] : at[t - 1] + k] @ ahead.T
            np.matmul(model.step, ahead, out=beta[:, :k])
            beta[:, k : live[t - 1]] = leave[:, k : live[t - 1]]
        else:
            pairs += (parts.enter * ~parts.first) @ ahead.T
    out.step += model.step * (pairs / FIXED)
    out.start += here[:, : live[0]][:, parts.first].sum(1)
    out.log_likelihood += float(np.rint(logs * FIXED).sum())


def _chunks(parts: _Parts):
    """Parts of falling size, about CHUNK tokens at a time."""
    parts = parts.take(np.argsort(-parts.size, kind="stable"))
    ends = np.cumsum(parts.size)
    a = 0
    while a < len(parts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        yield parts.take(np.arange(a, b))
        a = b


def _long(tokens: int) -> int:
    """Texts of more tokens than this are cut, where so many tokens are at hand."""
    return min(max(LONG, tokens // SHARE), LONGEST)


def expect(model: Model, classes: np.ndarray, off: np.ndarray, long: int | None = None, part: int = PART) -> Counts:
    """Expected counts of whole texts: classes[off[d] : off[d + 1]]."""
    out = Counts.zero(*model.emit.shape)
    long = long or _long(len(classes))
    parts = _cut(off, len(model.start), long, part)
    cut = np.flatnonzero(np.diff(off)[parts.text] > long)
    if len(cut):
        some = parts.take(cut)
        _bridge(model, classes, some)
        parts.enter[:, cut], parts.leave[:, cut] = some.enter, some.leave
    chunks = list(_chunks(parts))
    room = np.empty(len(model.start) * max((int(c.size.sum()) for c in chunks), default=0))
    for chunk in chunks:
        _expect(model, classes, chunk, out, room)
    return out


def reestimate(counts: Counts, prior: float = 0.02) -> Model:
    """The model of the expected counts, each with a small prior, so that nothing is impossible."""
    emit = counts.emit / FIXED
    share = emit.sum(0) + 1e-3
    emit = emit + prior * len(share) * share / share.sum()
    # the sums of steps are rounded, as their last digits depend on the order in which they were added
    step, start = np.rint(counts.step * 1024) / 1024 + prior, counts.start / FIXED + prior
    return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def log_likelihoods(model: Model, classes: np.ndarray, off: np.ndarray, long: int | None = None, part: int = PART) -> np.ndarray:
    """The natural log of each text's probability, by the forward recursion over its whole length. No text is empty."""
    out = np.zeros(len(off) - 1)
    long = long or _long(len(classes))
    parts = _cut(off, len(model.start), long, part)
    cut = np.diff(off)[parts.text] > long
    if cut.any():
        some = parts.take(np.flatnonzero(cut))
        np.add.at(out, some.text, _bridge(model, classes, some))
    for chunk in _chunks(parts.take(np.flatnonzero(~cut))):
        logs, last, _ = _forward(model, *_by_time(classes, chunk), _prior(model, chunk))
        out[chunk.text] = logs + np.log(last)
    return out
