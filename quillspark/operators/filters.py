"""Recursive filters, resampling and adaptive downmix of samples as they come, with the state carried from call to call.

Runs of STEP samples are matrix products. Whole streams, with their blocks in parallel, are in ``recurrence`` and ``conversion``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np

STEP = 64
#: Names and edges in hertz of the bands whose balance is measured.
BANDS = {"low-mid": (300.0, 1000.0), "mid": (1000.0, 2000.0), "consonant": (2000.0, 4000.0), "sibilance": (4000.0, 7000.0)}
ACTIVE_DB, FRAME_MS = -50.0, 20
IMPULSE = 8192


@dataclass(frozen=True)
class Biquad:
    """A second-order section by its coefficients, a0 being 1."""

    b: tuple[float, float, float]
    a: tuple[float, float]

    @staticmethod
    def of(b: tuple[float, float, float], a: tuple[float, float, float]) -> Biquad:
        return Biquad((b[0] / a[0], b[1] / a[0], b[2] / a[0]), (a[1] / a[0], a[2] / a[0]))

    @staticmethod
    def low_pass(rate: float, cutoff: float, q: float = math.sqrt(0.5)) -> Biquad:
        w = 2 * math.pi * min(max(cutoff, 1.0), rate * 0.49) / rate
        alpha, c = math.sin(w) / (2 * q), math.cos(w)
        return Biquad.of(((1 - c) / 2, 1 - c, (1 - c) / 2), (1 + alpha, -2 * c, 1 - alpha))

    @staticmethod
    def band_pass(rate: float, centre: float, q: float) -> Biquad:
        w = 2 * math.pi * min(max(centre, 1.0), rate * 0.49) / rate
        alpha, c = math.sin(w) / (2 * max(0.05, q)), math.cos(w)
        return Biquad.of((alpha, 0.0, -alpha), (1 + alpha, -2 * c, 1 - alpha))

    @staticmethod
    def high_shelf(rate: float, corner: float, gain_db: float, slope: float = 1.0) -> Biquad:
        w = 2 * math.pi * min(max(corner, 20.0), rate * 0.49) / rate
        g, c = 10 ** (gain_db / 40), math.cos(w)
        root = 2 * math.sqrt(g) * math.sin(w) / 2 * math.sqrt((g + 1 / g) * (1 / min(max(slope, 0.1), 2.0) - 1) + 2)
        up, down = g + 1, g - 1
        return Biquad.of((g * (up + down * c + root), -2 * g * (down + up * c), g * (up + down * c - root)), (up - down * c + root, 2 * (down - up * c), up - down * c - root))

    @staticmethod
    def dc_block(rate: float, cutoff: float = 20.0) -> Biquad:
        return Biquad((1.0, -1.0, 0.0), (-max(0.0, 1.0 - 2.0 * math.pi * cutoff / rate), 0.0))

    @cached_property
    def _run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a run of STEP samples: output from input and from state, state from state and from input."""
        move = np.array([[-self.a[0], 1.0], [-self.a[1], 0.0]])
        feed = np.array([self.b[1] - self.a[0] * self.b[0], self.b[2] - self.a[1] * self.b[0]])
        powers = [np.eye(2)]
        for _ in range(STEP):
            powers.append(move @ powers[-1])
        reply = np.array([self.b[0], *[(p @ feed)[0] for p in powers[: STEP - 1]]])
        lag = np.arange(STEP)[:, None] - np.arange(STEP)
        return np.where(lag >= 0, reply[np.maximum(lag, 0)], 0.0), np.array([p[0] for p in powers[:STEP]]), powers[STEP], np.array([powers[STEP - 1 - i] @ feed for i in range(STEP)]).T

    def process(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The filtered samples and the state after them; rows of several axes are filtered side by side, each from its own state."""
        from_input, from_state, move, feed = self._run
        n = x.shape[-1]
        whole, out = n // STEP * STEP, np.empty(x.shape)
        for at in range(0, whole, STEP):
            run = x[..., at : at + STEP]
            out[..., at : at + STEP] = run @ from_input.T + state @ from_state.T
            state = state @ move.T + run @ feed.T
        first, second = state[..., 0], state[..., 1]
        for i in range(whole, n):
            y = self.b[0] * x[..., i] + first
            first, second = self.b[1] * x[..., i] - self.a[0] * y + second, self.b[2] * x[..., i] - self.a[1] * y
            out[..., i] = y
        return out, np.stack([first, second], axis=-1)


class Chain:
    """Sections one after another, with their states."""

    def __init__(self, sections: list[Biquad], scale: float = 1.0) -> None:
        self.sections, self.scale, self.states = sections, scale, [np.zeros(2) for _ in sections]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        for i, section in enumerate(self.sections):
            x, self.states[i] = section.process(x, self.states[i])
        return x * self.scale


def listening_eq(rate: int, corner: float = 3000.0, gain_db: float = 6.0) -> Chain:
    """A high shelf, scaled by the sum of its impulse response's magnitudes so that it can't exceed full scale."""
    shelf = Biquad.high_shelf(rate, corner, gain_db)
    reply = shelf.process(np.r_[1.0, np.zeros(IMPULSE - 1)], np.zeros(2))[0]
    return Chain([shelf], 1.0 / np.abs(reply).sum())


def interpolated(line: np.ndarray, k: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The Catmull-Rom curve through ``line`` at a part ``t`` of the way from its sample k + 1 to the next."""
    p0, p1, p2, p3 = (line[k + i] for i in range(4))
    slope_1, slope_2 = 0.5 * (p2 - p0), 0.5 * (p3 - p1)
    rise = p2 - p1
    return p1 + t * (slope_1 + t * (3 * rise - 2 * slope_1 - slope_2 + t * (slope_1 + slope_2 - 2 * rise)))


class Resampler:
    """Catmull-Rom interpolation, after two low-passes at 0.45 of the new rate where it is lower; state carried over blocks."""

    def __init__(self, source_rate: int, target_rate: int) -> None:
        if min(source_rate, target_rate) <= 0:
            raise ValueError("sample rates must be positive")
        self.same, self.ratio = source_rate == target_rate, source_rate / target_rate
        self.filter = Chain([Biquad.low_pass(source_rate, 0.45 * target_rate)] * 2 if target_rate < source_rate else [])
        self.history, self.position = None, 0.0

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.same or not len(x):
            return x
        x = self.filter(x)
        if self.history is None:
            self.history = np.full(3, x[0])
        line = np.r_[self.history, x]
        # output i lies at position + i * ratio, counted from the interval of the block's first sample
        n = max(0, math.ceil((len(x) - self.position) / self.ratio))
        at = self.position + self.ratio * np.arange(n)
        at = at[at < len(x)]
        k = np.floor(at).astype(int)
        t = at - k
        self.position += self.ratio * len(at) - len(x)
        self.history = line[-3:]
        return interpolated(line, k, t)


def bands_at(rate: int) -> dict[str, list[Biquad]]:
    """The two band-passes of each band that lies below the rate's limit."""
    nyquist, out = rate / 2, {}
    for name, (low, high) in BANDS.items():
        if low < nyquist * 0.95:
            high = min(high, nyquist * 0.95)
            centre = math.sqrt(low * high)
            out[name] = [Biquad.band_pass(rate, centre, centre / max(1.0, high - low))] * 2
    return out


class Downmixer:
    """Mean of the channels, until half a second of sound shows that they cancel each other: then the first channel alone."""

    LEAST_SECONDS, MARGIN_DB, FLOOR_DB = 0.5, 6.0, -55.0

    def __init__(self, channels: int, rate: int) -> None:
        self.channels, self.rate, self.first_only, self.decided = channels, rate, False, channels <= 1
        self.mean_energy = self.channel_energy = self.seen = 0.0

    def __call__(self, interleaved: np.ndarray) -> np.ndarray:
        frames = interleaved[: len(interleaved) // self.channels * self.channels].reshape(-1, self.channels)
        mean = frames.mean(axis=1)
        out = frames[:, 0] if self.first_only else mean
        if not self.decided and len(frames):
            energy = (frames**2).sum() / self.channels
            if math.sqrt(energy / len(frames)) >= 10 ** (self.FLOOR_DB / 20):
                self.mean_energy, self.channel_energy, self.seen = self.mean_energy + (mean**2).sum(), self.channel_energy + energy, self.seen + len(frames)
                if self.seen >= self.LEAST_SECONDS * self.rate:
                    self.decided = True
                    ratio = 10 * math.log10(max(self.mean_energy / self.channel_energy, 1e-12))
                    self.first_only = ratio < -10 * math.log10(self.channels) - self.MARGIN_DB
        return out
