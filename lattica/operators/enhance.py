"""Enhancement of colour images before and after stitching (E, O and F12), image by image."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from lattica.functions import kernels as k
from lattica.operators.filters import LEVELS, inpaint, nl_means, wiener


def channels(m: np.ndarray, f: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    return np.stack([f(m[:, :, c].astype(np.float64)) for c in range(m.shape[2])], axis=2)


def equalised(m: np.ndarray, limit: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of the lightness."""
    return k.with_lightness(m, lambda v: k.equalised(np.rint(v), limit, tiles))


def unsharp(m: np.ndarray, strength: float = 0.2, sigma: float = 3.0) -> np.ndarray:
    return k.with_lightness(m, lambda v: (1 + strength) * v - strength * k.gaussian(v, sigma))


def stretched(m: np.ndarray) -> np.ndarray:
    """Each channel spread over 0..255."""
    return channels(m, lambda c: (c - c.min()) * 255 / (c.max() - c.min()) if c.max() > c.min() else c)


def enhanced(m: np.ndarray, level: str = "balanced") -> np.ndarray:
    """Equalised, denoised, sharpened and normalised as far as the level says; an unknown level is balanced."""
    limit, tiles, h, strength, normal = LEVELS.get(level, LEVELS["balanced"])
    out = k.as_bytes(equalised(m, limit, tiles))
    out = k.as_bytes(channels(out, lambda c: nl_means(c, float(h))))
    out = k.as_bytes(unsharp(out, strength))
    return stretched(out) if normal else out


def for_detection(gray: np.ndarray) -> np.ndarray:
    """Equalised, and 1.3 times that less 0.3 of its surroundings."""
    m = k.equalised(gray, 3.0, 8)
    return np.clip(1.3 * m - 0.3 * k.gaussian(m, 2.0), 0, 255)


def gray_world(m: np.ndarray) -> np.ndarray:
    """Colour cast halved in L*a*b*, then equalised."""
    v = k.lab(m)
    v[..., 1:] -= (v[..., 1:].mean(axis=(0, 1)) - 128) * 0.5
    return equalised(k.as_bytes(np.clip(k.from_lab(v), 0, 255)))


def shadows_lifted(m: np.ndarray, strength: float = 0.5, sigma: float = 20.0) -> np.ndarray:
    """Lightness over its surroundings times 128, mixed in by strength."""
    return k.with_lightness(m, lambda v: (1 - strength) * v + strength * np.minimum(255, v / np.maximum(k.gaussian(v, sigma), 1) * 128))


def upscaled(m: np.ndarray, factor: float = 2.0) -> np.ndarray:
    return k.resized(m, max(1, int(m.shape[0] * factor)), max(1, int(m.shape[1] * factor)))


def repaired(m: np.ndarray) -> np.ndarray:
    """Almost black or white gaps filled in, found on the gray image."""
    gray = k.luma(m)
    gap = (gray < 5) | (gray > 250)
    return channels(m, lambda c: inpaint(np.where(gap, 0.0, np.maximum(c, 5)), 5, 255)) if gap.any() and not gap.all() else m


#: Steps by name; a table of images goes through them in the order given.
STEPS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "shadow": shadows_lifted,
    "denoise": lambda m: channels(m, nl_means),
    "deblur": lambda m: channels(m, wiener),
    "equalise": equalised,
    "sharpen": unsharp,
    "colour": gray_world,
    "repair": repaired,
    "upscale": upscaled,
}
#: The order of a final enhancement.
FINAL = ("colour", "denoise", "upscale")


def enhance(images: DataFrame, level: str = "balanced") -> DataFrame:
    """Colour images enhanced by a level; an image that fails stays as it was."""
    return k.colour_images(images, lambda m: enhanced(m, level))


def processed(images: DataFrame, steps: Iterable[str] = FINAL) -> DataFrame:
    """Colour images after the named steps, one scan for all of them."""
    chosen = [STEPS[s] for s in steps]

    def run(m: np.ndarray) -> np.ndarray:
        for f in chosen:
            m = k.as_bytes(f(m))
        return m

    return k.colour_images(images, run)


def preview(images: DataFrame, steps: Iterable[str] = (), most: int = 1600) -> DataFrame:
    """What processing does, on images of at most `most` cells a side; they are not made larger."""
    small = k.colour_images(images, lambda m: k.bounded(m, most))
    return processed(small, [s for s in steps if s != "upscale"])
