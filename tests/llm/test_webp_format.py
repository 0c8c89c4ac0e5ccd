"""The decoder on streams written bit by bit: prefix codes, back-references, colour cache and every transform."""

import numpy as np
import pytest

from flowspark.llm import webp


class Writer:
    def __init__(self, width, height):
        self.bits = []
        self.put(0x2F, 8).put(width - 1, 14).put(height - 1, 14).put(1, 1).put(0, 3)

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n)]
        return self

    def one(self, symbol):
        """A code of a single symbol, which takes no bits."""
        return self.put(1, 1).put(0, 1).put(1, 1).put(symbol, 8)

    def two(self, a, b):
        """A code of two symbols of one bit each; the lesser is 0."""
        return self.put(1, 1).put(1, 1).put(1, 1).put(a, 8).put(b, 8)

    def literal(self, green, red, blue, alpha=255):
        """Single-colour data: no cache, one symbol per channel."""
        self.put(0, 1)
        for x in (green, red, blue, alpha, 0):
            self.one(x)
        return self

    def data(self):
        return np.packbits(np.array([*self.bits, *[0] * 32], np.uint8), bitorder="little").tobytes()


def code_with_lengths(w, lengths, alphabet):
    """A coded-length code in which only lengths 0, 1, 2 and the zero runs 18 occur."""
    w.put(0, 1).put(2, 4)  # six code-length codes: 17, 18, 0, 1, 2, 3
    for size in (0, 2, 2, 2, 2, 0):
        w.put(size, 3)
    w.put(0, 1)
    codes = {0: 0b00, 1: 0b10, 2: 0b01, 18: 0b11}  # of (0, 1, 2, 18) in order, written highest bit first
    at = 0
    while at < alphabet:
        run = 0
        while at + run < alphabet and not lengths.get(at + run) and run < 138:
            run += 1
        if run >= 11:
            w.put(codes[18], 2).put(run - 11, 7)
            at += run
        else:
            w.put(codes[lengths.get(at, 0)], 2)
            at += 1


def test_copies_repeat_the_pixels_before():
    w = Writer(6, 1).put(0, 1).put(0, 1).put(0, 1)
    code_with_lengths(w, {10: 1, 20: 2, 256 + 3: 2}, 280)  # prefix 3: four pixels
    w.one(1).one(2).one(255).one(5)  # distance prefix 5: 6 + 1 extra bit + 1
    w.put(0, 1).put(1, 1).put(0, 1)
    w.put(1, 1).put(1, 1).put(1, 1)  # copy four; distance code 8 is (-1, 2): 2 x 6 - 1 pixels back
    with pytest.raises(ValueError):
        webp.decode_vp8l(w.data())
    w = Writer(6, 1).put(0, 1).put(0, 1).put(0, 1)
    code_with_lengths(w, {10: 1, 20: 2, 256 + 3: 2}, 280)
    w.one(1).one(2).one(255).one(1)  # distance code 2 is (1, 0): one pixel back
    w.put(0, 1).put(1, 1).put(0, 1).put(1, 1).put(1, 1)
    assert webp.decode_vp8l(w.data())[0, :, 1].tolist() == [10, 20, 20, 20, 20, 20]


def test_colour_cache():
    w = Writer(3, 1).put(0, 1).put(1, 1).put(1, 4).put(0, 1)
    colour = 255 << 24 | 7 << 16 | 9 << 8 | 3
    at = (colour * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    code_with_lengths(w, {9: 1, 280 + at: 1}, 282)
    w.one(7).one(3).one(255).one(0)
    w.put(0, 1).put(1, 1).put(1, 1)
    assert webp.decode_vp8l(w.data())[0].tolist() == [[7, 9, 3, 255]] * 3


def test_palette_packs_indices():
    w = Writer(5, 1).put(1, 1).put(webp.PALETTE, 2).put(1, 8)
    w.put(0, 1).two(10, 20).one(1).one(2).one(128).one(0).put(0, 1).put(1, 1)  # colours (1, 10, 2, 128), then added to it (1, 20, 2, 128)
    w.put(0, 1).put(0, 1).put(0, 1).one(0b10110).one(0).one(0).one(0).one(0)
    first, second = [1, 10, 2, 128], [2, 30, 4, 0]
    assert webp.decode_vp8l(w.data())[0].tolist() == [first, second, second, first, second]


def test_subtract_green_and_cross_colour():
    w = Writer(2, 1).put(1, 1).put(webp.SUBTRACT_GREEN, 2).put(0, 1).put(0, 1).put(0, 1)
    for x in (100, 200, 3, 255, 0):
        w.one(x)
    assert webp.decode_vp8l(w.data())[0].tolist() == [[44, 100, 103, 255]] * 2
    w = Writer(2, 1).put(1, 1).put(webp.CROSS_COLOUR, 2).put(0, 3).literal(green=64, red=32, blue=224)  # to red -32, green to blue 64, red to blue 32
    w.put(0, 1).put(0, 1).put(0, 1)
    for x in (16, 5, 0, 255, 0):
        w.one(x)
    red = 5 + (-32 * 16 >> 5)
    assert webp.decode_vp8l(w.data())[0, 0].tolist() == [red & 255, 16, ((64 * 16 >> 5) + (32 * red >> 5)) & 255, 255]


def slow_predict(image, mode):
    height, width, _ = image.shape
    out = np.zeros_like(image, int)
    mean = lambda a, b: (a + b) // 2
    for y in range(height):
        for x in range(width):
            if not y:
                guess = out[0, x - 1] if x else np.array([0, 0, 0, 255])
            elif not x:
                guess = out[y - 1, 0]
            else:
                left, up, corner = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
                right = out[y - 1, x + 1] if x + 1 < width else out[y, 0]
                half = mean(left, up)
                guess = [np.array([0, 0, 0, 255]), left, up, right, corner, mean(mean(left, right), up), mean(left, corner), mean(left, up), mean(corner, up), mean(up, right), mean(mean(left, corner), mean(up, right)),
                         left if abs(up - corner).sum() < abs(left - corner).sum() else up, np.clip(left + up - corner, 0, 255), np.clip(half + np.array([int((h - c) / 2) for h, c in zip(half, corner, strict=True)]), 0, 255)][mode]
            out[y, x] = (image[y, x] + guess) & 255
    return out


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    image = np.random.default_rng(mode).integers(0, 256, (5, 6, 4), dtype=np.uint8)
    got = webp.undo_predictor(image, np.full((2, 2), mode), 2)
    assert (got == slow_predict(image, mode)).all()


def test_random_images_come_back():
    random = np.random.default_rng(3)
    for height, colours in ((1, 1), (2, 2), (7, 5), (30, 256), (64, 90)):
        image = random.integers(0, colours, (height, 16, 4)).astype(np.uint8)
        assert (webp.read_webp(webp.write_webp(image))[0] == image).all()
    ramp = np.arange(16 * 4 * 40, dtype=np.uint64).reshape(40, 16, 4).astype(np.uint8)
    assert (webp.read_webp(webp.write_webp(ramp))[0] == ramp).all()
