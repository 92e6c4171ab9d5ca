import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.functions import kernels as k


def gain(b, a, hz, rate=30000):
    z = np.exp(-2j * np.pi * hz / rate * np.arange(len(b)))
    return abs((b * z).sum() / (a * z).sum())


def test_designs_have_half_power_at_their_edges():
    assert gain(*k.HIGH_PASS, 750) == pytest.approx(2**-0.5, abs=1e-4)
    assert gain(*k.HIGH_PASS, 15000) == pytest.approx(1, abs=1e-6)
    for hz in (300, 1000):
        assert gain(*k.BAND_PASS, hz) == pytest.approx(2**-0.5, abs=1e-3)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 59), st.integers(0, 2**31))
def test_iir_does_not_depend_on_chunks(cut, seed):
    x = np.random.default_rng(seed).normal(size=60)
    whole, end = k.iir(*k.HIGH_PASS, x)
    first, state = k.iir(*k.HIGH_PASS, x[:cut])
    second, last = k.iir(*k.HIGH_PASS, x[cut:], state)
    assert np.allclose(np.r_[first, second], whole) and np.allclose(last, end)


def test_iir_impulse_and_reverse():
    y, _ = k.iir([1.0], [1.0, -0.5], np.eye(1, 6)[0])
    assert np.allclose(y, 0.5 ** np.arange(6))
    y, _ = k.iir([1.0], [1.0, -0.5], np.eye(1, 6, 5)[0], reverse=True)
    assert np.allclose(y[::-1], 0.5 ** np.arange(6))
    assert k.iir([2.0], [1.0], np.ones(3, np.float32))[0].dtype == np.float32


def test_filtfilt_edges_and_constant():
    with pytest.raises(ValueError):
        k.filtfilt(*k.HIGH_PASS, np.ones(12))
    assert np.allclose(k.filtfilt(*k.HIGH_PASS, np.ones(13)), 0, atol=1e-9)
    assert np.allclose(k.filtfilt([0.5, 0.5], [1.0], np.full(20, 3.0)), 3)


def test_filtfilt_has_no_phase():
    t = np.arange(3000) / 30000
    x = np.sin(2 * np.pi * 5000 * t)
    y = k.filtfilt(*k.HIGH_PASS, x)
    assert np.abs(y[500:-500] - x[500:-500]).max() < 0.01


def test_spikes_refractory_and_carry():
    x = np.zeros(20)
    x[[3, 5, 12, 18]] = -9
    hits, left = k.spikes(x, -5, refractory=6)
    assert hits.tolist() == [3, 12, 18] and left == 4
    hits, left = k.spikes(x, -5, wait=4, refractory=6)
    assert hits.tolist() == [5, 12, 18]
    assert k.spikes(x, 5)[0].size == 0 and k.spikes(x, 0)[0].size == 0
    assert k.spikes(np.zeros(5), -5, wait=50) [1] == 0


def test_first_waveform():
    x = np.arange(100.0)
    assert k.first_waveform(x, np.array([2, 40]), 5)[:3].tolist() == [25, 26, 27]
    late = k.first_waveform(x, np.array([90]), -5)
    assert late[0] == 75 and np.isnan(late[-1])
    assert k.first_waveform(x, np.array([90]), 5)[-1] == 0
    assert np.isnan(k.first_waveform(x, np.array([], int), -1)).all()


def test_dwt_lengths_energy_and_thresholds():
    x = np.random.default_rng(1).normal(size=8192)
    assert [len(d) for d in k.wavedec(x, "db4", 10)[:-1]] == [4099, 2053, 1030, 518, 262, 134, 70, 38, 22, 14]
    approx, detail = k.dwt(np.array([1.0, 3, 2, 2]), "db1")
    assert np.allclose(approx, [4 / 2**0.5, 4 / 2**0.5]) and np.allclose(np.abs(detail), [2**0.5, 0])
    assert np.allclose(k.dwt(np.ones(50), "db4")[1], 0, atol=1e-9)
    t = k.dwt_thresholds(x)
    base = np.median(np.abs(k.wavedec(x, "db4", 1)[0])) / 0.6745 * np.sqrt(np.log(8192))
    assert t[0] == pytest.approx(base)
    assert (k.dwt_energy(x, np.full(10, np.inf)) == 0).all()


def test_trailing_and_smoothing():
    assert k.trailing(np.array([1.0, 2, 3]), 2, 4).tolist() == [0, 0, 1, 2]
    x = np.arange(30.0) ** 2
    assert np.allclose(k.savitzky_golay(x), x)


def test_blocks_of_the_filter_equal_a_plain_loop():
    rng = np.random.default_rng(5)
    for n in (1, 7, 128, 129, 1000):
        x = rng.normal(size=n)
        for b, a in (k.HIGH_PASS, k.BAND_PASS, (np.array([1.0, 2.0]), np.array([2.0, 0.5])), (np.array([3.0]), np.array([1.5]))):
            pb, pa = k._padded(b, a)
            z, out = np.zeros(len(pb)), []
            for v in x:
                y = pb[0] * v + z[0]
                for j in range(1, len(pb)):
                    z[j - 1] = pb[j] * v + z[j] - pa[j] * y
                out.append(y)
            got, state = k.iir(b, a, x)
            assert np.allclose(got, out, atol=1e-9) and np.allclose(state, z[: len(pb) - 1], atol=1e-9)
            half, kept = k.iir(b, a, x[: n // 2])
            rest, _ = k.iir(b, a, x[n // 2 :], kept)
            assert np.allclose(np.r_[half, rest], out, atol=1e-9)
            assert np.allclose(k.iir(b, a, x[::-1], reverse=True)[0][::-1], out, atol=1e-9)


def test_chunks_and_ring():
    assert k.chunks(np.array([1, 5, 20]), 12, cap=6) == [(0, 4), (12, 12)]
    assert k.chunks(np.array([1, 5, 14]), 100, cap=6) == [(0, 4), (7, 13)]
    got = k.ring_magnitudes(np.array([1.0, -2, 3, -4, 5]), np.array([1, 3, 6]), cells=4, cap=10)
    assert np.allclose(got, [3 / 4, (3 + 4 + 5 + 1) / 4])
    many = k.dwt_energies(np.arange(40.0), np.array([1, 17, 40]), 16, np.zeros(2), "db4", stack=2)
    one = [k.dwt_energy(k.trailing(np.arange(40.0), e, 16), np.zeros(2), "db4") for e in (1, 17, 40)]
    assert np.allclose(many, one)
