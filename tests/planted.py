"""Made images with maps in known places, for fitting and testing their detection."""

import random

import numpy as np


def axis(rng, n, width):
    """A rising axis of n points."""
    steps = [rng.randint(1, 6) if width == 1 else rng.choice([25, 50, 100, 125, 250]) * rng.randint(1, 4) for _ in range(n)]
    start = rng.randint(0, 20) if width == 1 else rng.randint(0, 2000)
    return np.minimum(start + np.cumsum(steps), 255 if width == 1 else 65535)


def cells(rng, n, m, width):
    """A plane or line as engine maps have them: a slope, some curvature, some noise, often saturated."""
    x, y = np.meshgrid(np.linspace(0, 1, n), np.linspace(0, 1, m))
    a, b, c = rng.uniform(-1, 1), rng.uniform(-1, 1) * (m > 1), rng.uniform(-1, 1)
    plane = a * x + b * y + c * x * (y if m > 1 else x)
    plane = (plane - plane.min()) / max(1e-9, np.ptp(plane))
    plane += np.array([rng.gauss(0, 0.02) for _ in range(n * m)]).reshape(m, n)
    if rng.random() < 0.3:
        plane = np.clip(plane, 0.1, 0.8)
    top = rng.choice([80, 200]) if width == 1 else rng.choice([800, 4000, 20000, 60000])
    return np.clip(np.round(plane * top), 0, 255 if width == 1 else 65535)


def image(rng, count=6):
    """Bytes, and ``offset, columns, rows, width`` of the maps in them."""
    out, maps = bytearray(), []

    def rubbish(low, high):
        n = rng.randint(low, high)
        kind = rng.random()
        if kind < 0.4:
            out.extend(rng.randrange(256) for _ in range(n))
        elif kind < 0.6:
            out.extend(b"\xff" * n)
        elif kind < 0.8:
            out.extend(" ".join(rng.choice(["table", "engine", "speed", "load", "of", "is"]) for _ in range(n // 4)).encode())
        else:
            out.extend(b"".join((rng.randrange(65536)).to_bytes(2, "little") for _ in range(n // 2)))

    for _ in range(count):
        rubbish(60, 400)
        width = rng.choice([1, 2, 2, 2])
        kind = f"<u{width}"
        n = rng.randint(6, 20)
        m = rng.randint(5, 18) if rng.random() < 0.75 else 1
        out.extend(b"\xff\xff" if rng.random() < 0.5 else b"\x00\xff")
        axes = [axis(rng, n, width).astype(kind).tobytes()] + ([axis(rng, m, width).astype(kind).tobytes()] if m > 1 else [])
        made = cells(rng, n, m, width)
        made.ravel()[0] = 0  # a run that goes on into the cells has no known end
        plane = made.astype(kind).tobytes()
        if rng.random() < 0.75:
            out.extend(b"".join(axes))
            maps.append((len(out), n, m, width))
            out.extend(plane)
        else:
            maps.append((len(out), n, m, width))
            out.extend(plane)
            out.extend(b"".join(axes))
        out.extend(b"\x00\xff")
    rubbish(60, 400)
    return bytes(out), maps


def images(seed, count):
    rng = random.Random(seed)
    return [image(rng) for _ in range(count)]
