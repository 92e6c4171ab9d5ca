"""Sequential numeric kernels on one channel, in numpy.

These are recurrences, which no window function can express; the operators run
them on whole channels, one group of a grouped map for each.  A channel in hand
takes 8 bytes a sample and a few copies: about 3.5 GB an hour at 30 kHz, which
bounds the length of a recording that one task can take.
"""

from __future__ import annotations

import numpy as np

# Designs for 30 kHz recordings (high-pass of order 4 at 750 Hz,
# band-pass of 300 to 1000 Hz) and the reconstruction filter of four moments.
HIGH_PASS = (
    np.array([0.814254556886246, -3.25701822754499, 4.88552734131748, -3.25701822754499, 0.814254556886246]),
    np.array([1, -3.58973388711218, 4.85127588251942, -2.92405265616246, 0.663010484385891]),
)
BAND_PASS = (
    np.array([0.0684115773863778, 0, -0.0684115773863778]),
    np.array([1, -1.85090909435363, 0.863176845227244]),
)
DB4 = np.array([0.230377813309, 0.714846570553, 0.630880767930, -0.027983769417, -0.187034811719, 0.030841381836, 0.032883011667, -0.010597401785])
DB1 = np.array([1, 1]) / np.sqrt(2)
WAVELETS = {"db1": DB1, "db4": DB4}

REFRACTORY = 52
LEAD = 15


def _padded(b: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = max(len(a), len(b))
    b, a = np.r_[b, np.zeros(n - len(b))] / a[0], np.r_[a, np.zeros(n - len(a))] / a[0]
    return b.astype(float), a.astype(float)


def iir(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray | None = None, reverse: bool = False, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """Direct form II transposed: (output, final state).  With ``reverse`` the
    signal is read from its end and the output stays in place.

    The signal is cut into blocks.  What a block answers to its own samples is
    one matrix product for all blocks; only the state, as long as the order,
    goes from block to block.  Two blocks or less go sample by sample, which
    takes less time than the matrices do."""
    b, a = _padded(np.asarray(b, float), np.asarray(a, float))
    order = len(b) - 1
    z = np.zeros(order) if state is None else np.asarray(state, float).copy()
    values = np.asarray(x, float)
    values = values[::-1] if reverse else values
    if order == 0:
        y = b[0] * values
    elif len(values) <= 2 * block:
        y, z = _by_sample(b.tolist(), a.tolist(), values.tolist(), z.tolist())
    else:
        step = np.zeros((order, order))
        step[:, 0] = -a[1:]
        step[np.arange(order - 1), np.arange(1, order)] = 1
        drive = b[1:] - a[1:] * b[0]
        seen = np.zeros((block, order))  # output of a state after k steps
        pushed = np.zeros((order, block))  # state after a unit k steps ago
        row, column = np.eye(order)[0], drive
        for k in range(block):
            seen[k], pushed[:, k] = row, column
            row, column = row @ step, step @ column
        whole = np.linalg.matrix_power(step, block)
        impulse = np.r_[b[0], seen[: block - 1] @ drive]
        lag = np.arange(block)[:, None] - np.arange(block)
        own = np.where(lag >= 0, impulse[np.maximum(lag, 0)], 0.0)
        n = len(values) // block
        parts = values[: n * block].reshape(n, block)
        pushes = parts @ pushed[:, ::-1].T
        states = np.empty((n, order))
        for i in range(n):
            states[i] = z
            z = whole @ z + pushes[i]
        y = (parts @ own.T + states @ seen.T).ravel()
        rest = values[n * block :]
        if len(rest):
            m = len(rest)
            y = np.r_[y, own[:m, :m] @ rest + seen[:m] @ z]
            z = np.linalg.matrix_power(step, m) @ z + pushed[:, :m][:, ::-1] @ rest
    y = y[::-1] if reverse else y
    return (y.astype(np.float32) if np.asarray(x).dtype == np.float32 else y), z


def _by_sample(b: list[float], a: list[float], values: list[float], z: list[float]) -> tuple[np.ndarray, np.ndarray]:
    out, last = [], len(z) - 1
    for v in values:
        y = b[0] * v + z[0]
        for j in range(last):
            z[j] = b[j + 1] * v + z[j + 1] - a[j + 1] * y
        z[last] = b[last + 1] * v - a[last + 1] * y
        out.append(y)
    return np.array(out, float), np.array(z, float)


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filter: the ends are continued by reflection at the end point
    and both passes start in the steady state of their first value."""
    b, a = _padded(np.asarray(b, float), np.asarray(a, float))
    order = len(b) - 1
    edge = 3 * order
    x = np.asarray(x)
    if len(x) <= edge:
        raise ValueError(f"signal of {len(x)} samples; more than {edge} are needed")
    k = np.eye(order)
    k[:, 0] += a[1:]
    k[np.arange(order - 1), np.arange(1, order)] -= 1
    start = np.linalg.solve(k, b[1:] - a[1:] * b[0])
    v = x.astype(float)
    head = 2 * v[0] - v[edge:0:-1]
    rear = 2 * v[-1] - v[-2 : -edge - 2 : -1]
    whole = np.r_[head, v, rear]
    forth, _ = iir(b, a, whole, start * whole[0])
    back, _ = iir(b, a, forth, start * forth[-1], reverse=True)
    out = back[edge:-edge]
    return out.astype(x.dtype) if x.dtype == np.float32 else out


def spikes(x: np.ndarray, threshold: float, wait: int = 0, refractory: int = REFRACTORY) -> tuple[np.ndarray, int]:
    """(positions of hits, samples to skip in the next stretch).

    A hit is a sample at or beyond the threshold on its side of zero; after one
    the next ``refractory`` samples are skipped.  Without a hit nothing is left
    to skip.  A threshold of zero finds nothing."""
    x = np.asarray(x)
    if threshold == 0 or np.isnan(threshold):
        return np.zeros(0, np.int64), 0
    over = np.flatnonzero(x <= threshold if threshold < 0 else x >= threshold)
    out, free = [], wait
    for i in over.tolist():
        if i >= free:
            out.append(i)
            free = i + refractory
    return np.array(out, np.int64), max(0, free - len(x)) if out else 0


def first_waveform(x: np.ndarray, hits: np.ndarray, threshold: float, length: int = REFRACTORY, lead: int = LEAD) -> np.ndarray:
    """The first hit's samples, from ``lead`` before it.  A hit too near the
    start gives way to the next; beyond the end stand not-a-numbers for a
    negative threshold and zeros for a positive one."""
    out = np.full(length, np.nan if threshold < 0 else 0.0)
    if not len(hits):
        return out
    whole = hits[hits >= lead]
    begin = int(whole[0] if len(whole) else hits[-1]) - lead
    skip = max(0, -begin)
    part = np.asarray(x, float)[max(0, begin) : begin + length]
    out[skip : skip + len(part)] = part
    return out


def dwt(x: np.ndarray, wavelet: str) -> tuple[np.ndarray, np.ndarray]:
    """One level (approximation, detail) with half-point symmetric ends, along
    the last axis; many frames are taken at once."""
    low = WAVELETS[wavelet][::-1]
    taps = len(low)
    high = low[::-1] * np.where(np.arange(taps) % 2 == 0, -1, 1)
    x = np.asarray(x, float)
    n = (x.shape[-1] + taps - 1) // 2
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(taps - 1, taps - 1)], mode="symmetric")
    parts = [wide[..., taps - k : taps - k + 2 * n : 2] for k in range(taps)]
    return sum(c * p for c, p in zip(low, parts)), sum(c * p for c, p in zip(high, parts))


def wavedec(x: np.ndarray, wavelet: str, levels: int) -> list[np.ndarray]:
    """Details of levels 1 to ``levels``, then the last approximation."""
    out = []
    for _ in range(levels):
        x, detail = dwt(x, wavelet)
        out.append(detail)
    return [*out, x]


def dwt_thresholds(x: np.ndarray, wavelet: str = "db4", levels: int = 10) -> np.ndarray:
    """Noise thresholds by level, from the whole of a baseline."""
    out = []
    for level, detail in enumerate(wavedec(x, wavelet, levels)[:-1], 1):
        base = np.median(np.abs(detail)) / 0.6745 * np.sqrt(np.log(len(x)))
        out.append(base if level == 1 else base / np.sqrt(levels) if level == levels else base / np.log(level + 1))
    return np.array(out)


def dwt_energy(frames: np.ndarray, thresholds: np.ndarray, wavelet: str = "db4") -> np.ndarray:
    """Sum of squares by level of the details over their threshold, along the
    last axis: one frame or a stack of frames."""
    details = wavedec(frames, wavelet, len(thresholds))[:-1]
    return np.stack([(np.where(np.abs(d) > t, d, 0.0) ** 2).sum(axis=-1) for d, t in zip(details, thresholds)], axis=-1)


def dwt_energies(x: np.ndarray, ends: np.ndarray, length: int, thresholds: np.ndarray, wavelet: str = "db4", stack: int = 64) -> np.ndarray:
    """``dwt_energy`` of the trailing frame at each of ``ends``, ``stack`` frames
    at a time, zeros standing before the first sample."""
    wide = np.r_[np.zeros(length), np.asarray(x, float)]
    every = np.lib.stride_tricks.sliding_window_view(wide, length)
    ends = np.asarray(ends, np.int64)
    parts = [dwt_energy(every[ends[i : i + stack]], thresholds, wavelet) for i in range(0, len(ends), stack)]
    return np.concatenate(parts) if parts else np.zeros((0, len(thresholds)))


def chunks(ticks: np.ndarray, n: int, cap: int = 1110) -> list[tuple[int, int]]:
    """Samples (from, to; zero-based, ``to`` not included) that lie before each
    tick but the first, from the tick before it, ``cap`` at most."""
    ticks = np.asarray(ticks, np.int64)
    spans = zip(ticks[1:] - np.minimum(np.diff(ticks), cap), ticks[1:])
    return [(max(0, min(int(a) - 1, n)), max(0, min(int(b) - 1, n))) for a, b in spans]


def rates(x: np.ndarray, ticks: np.ndarray, threshold: float, width: float = 0.033, frames: int = 9, refractory: int = REFRACTORY, cap: int = 1110) -> np.ndarray:
    """Hits a second before each tick but the first, the mean of the last
    ``frames`` of them; a hit's refractory time goes on in the next chunk."""
    wait, counts = 0, []
    for a, b in chunks(ticks, len(x), cap):
        hits, wait = spikes(x[a:b], threshold, wait, refractory)
        counts.append(len(hits) / width)
    total = np.cumsum(np.r_[0.0, counts])
    at = np.arange(1, len(counts) + 1)
    return (total[at] - total[np.maximum(at - frames, 0)]) / frames


def ring_magnitudes(x: np.ndarray, ticks: np.ndarray, cells: int = 9, cap: int = 1110) -> np.ndarray:
    """Mean magnitude of a ring at each tick but the first: the newest chunk comes
    first, then the oldest left-over cells; the ring grows to the longest chunk."""
    ring, out = np.zeros(cells), []
    for a, b in chunks(ticks, len(x), cap):
        part = x[a:b]
        ring = np.r_[part, ring[: max(len(ring) - len(part), 0)]]
        out.append(float(np.abs(ring).mean()))
    return np.array(out)


def trailing(x: np.ndarray, end: int, length: int) -> np.ndarray:
    """The ``length`` samples before ``end``, zeros standing before the first."""
    part = np.asarray(x, float)[max(0, end - length) : max(0, end)]
    return np.r_[np.zeros(length - len(part)), part]


def savitzky_golay(x: np.ndarray, window: int = 9, order: int = 2) -> np.ndarray:
    """Least-squares smoothing; the ends take the fit of their first and last window."""
    x = np.asarray(x, float)
    half = window // 2
    design = np.vander(np.arange(-half, half + 1), order + 1, increasing=True)
    hat = design @ np.linalg.pinv(design)
    out = np.convolve(x, hat[half][::-1], "same")
    out[:half] = (hat @ x[:window])[:half]
    out[-half:] = (hat @ x[-window:])[-half:]
    return out


def pinv(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse that drops singular values up to max(size) x eps x the greatest."""
    return np.linalg.pinv(m, rcond=max(m.shape) * np.finfo(float).eps)
