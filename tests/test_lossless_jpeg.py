import numpy as np
import pytest

from lumenframe.functions import lossless_jpeg as J


@pytest.mark.parametrize("predictor", range(1, 8))
@pytest.mark.parametrize("shape", [(1, 1, 1), (5, 7, 1), (12, 9, 2)])
def test_round_trip(predictor, shape):
    rng = np.random.default_rng(predictor)
    for high in (4096, 65536):
        x = rng.integers(0, high, shape)
        assert (J.decode(J.encode(x, 16, predictor)) == x).all()
    smooth = np.cumsum(rng.integers(-3, 4, shape), axis=1) + 2000
    coded = J.encode(smooth, 14, predictor)
    assert (J.decode(coded) == smooth).all()


def test_extremes_and_errors():
    x = np.array([[0, 32768, 0, 65535, 0, 65535]] * 3)
    assert (J.decode(J.encode(x))[:, :, 0] == x).all()
    with pytest.raises(ValueError):
        J.decode(b"no image")
    with pytest.raises(ValueError):
        J.decode(b"\xff\xd8\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x00\x11\x00\xff\xda\x00\x08\x01\x00\x00\x00\x00\x00")


def test_code_lengths_fit():
    counts = {s: 3**s for s in range(17)}
    lengths = J.code_lengths(counts)
    assert max(lengths.values()) <= 16 and sum(2.0**-n for n in lengths.values()) < 1
