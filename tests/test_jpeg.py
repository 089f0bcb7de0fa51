import numpy as np
import pytest

from lumenframe.functions import jpeg


def picture(h, w, seed=0):
    y, x = np.mgrid[:h, :w]
    rng = np.random.default_rng(seed)
    return np.clip(np.stack([128 + 90 * np.sin(x / 7), 120 + 80 * np.cos(y / 9), 100 + 60 * np.sin((x + y) / 11)], axis=-1) + rng.normal(0, 4, (h, w, 3)), 0, 255).astype(np.uint8)


def test_zigzag_and_cosines():
    order = jpeg.zigzag()
    assert order[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and order[-3:].tolist() == [55, 62, 63] and sorted(order) == list(range(64))
    b = jpeg.cosines()
    assert np.allclose(b @ b.T, np.eye(8))


@pytest.mark.parametrize("shape", [(8, 8), (1, 1), (37, 50), (64, 81)])
def test_round_trips(shape):
    x = picture(*shape)
    for quality, error in ((100, 1.0), (90, 4.0), (20, 14.0)):
        made = jpeg.encode(x, quality)
        assert made[:4] == b"\xff\xd8\xff\xe0" and made[-2:] == b"\xff\xd9"
        back = jpeg.decode(made)
        assert back.shape == x.shape and np.abs(back.astype(int) - x).mean() < error
    grey = x[..., 0]
    assert np.abs(jpeg.decode(jpeg.encode(grey, 95)).astype(int) - grey).mean() < 3


def test_flat_noisy_and_broken_streams():
    assert (jpeg.decode(jpeg.encode(np.full((20, 20, 3), 77, np.uint8), 100)) == 77).all()
    noise = np.random.default_rng(1).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).mean() < 1.5
    assert len(jpeg.encode(noise, 10)) < len(jpeg.encode(noise, 90))
    for bad in (b"", b"\xff\xd8\xff\xc2\0\x0b" + b"\0" * 20):
        with pytest.raises((ValueError, IndexError)):
            jpeg.decode(bad)
