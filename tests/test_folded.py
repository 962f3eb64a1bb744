import numpy as np
import pytest

from quire.sources import pixels


def _drawn(rng):
    height, width = rng.integers(1, 160, 2)
    image = np.full((height, width), 255, np.uint8)
    for _ in range(rng.integers(0, 14)):
        y, x = rng.integers(0, height), rng.integers(0, width)
        image[y : y + 2, : rng.integers(1, width + 1)] = rng.integers(0, 255)
        image[rng.integers(0, height) :, x : x + 2] = 0
        if rng.random() < 0.3:
            image[y : y + rng.integers(1, 30), x : x + rng.integers(1, 30)] = 255
    return image


def test_folded_drawings_are_measured_as_whole_ones(monkeypatch):
    rng = np.random.default_rng(3)
    images = [_drawn(rng) for _ in range(400)]
    places = [(sorted((rng.random(rng.integers(1, 5)) * i.shape[1]).tolist()), sorted((rng.random(rng.integers(1, 5)) * i.shape[0]).tolist())) for i in images]
    run = lambda: [(pixels.grid(i), pixels.whole_grid(i), pixels.unbroken(i, *p)) for i, p in zip(images, places)]
    folded = run()
    assert all(g == w[:2] and w[2] == bool(g[0] and g[1] and pixels.unbroken(i, *g)) for i, (g, w, _) in zip(images, folded))
    assert len({u for _, _, u in folded}) == 2 and any(w[2] for _, w, _ in folded)
    monkeypatch.setattr(pixels, "FEW", 0)
    assert run() == folded


def test_a_drawing_is_not_gone_through_pixel_by_pixel(monkeypatch):
    monkeypatch.setattr(pixels, "run_sums", lambda *a: pytest.fail("all pixels"))
    image = np.full((100, 200), 255, np.uint8)
    image[10:12, 10:192] = image[80:82, 10:192] = image[10:82, 10:12] = image[10:82, 190:192] = 0
    assert pixels.grid(image) == ([10.5, 190.5], [10.5, 80.5])
