"""Images and components against plain versions."""

import random
import struct
import zlib

import numpy as np

from weftline.operators import rasters
from weftline.sources import files


def _png(grid):
    """A PNG file of 8-bit grey, RGB or RGBA rows."""
    height, width, channels = grid.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in grid)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_keep_damaged_ones_as_errors(spark, tmp_path):
    rng = np.random.default_rng(3)
    rgb, rgba = rng.integers(0, 256, (3, 5, 3), dtype=np.uint8), rng.integers(0, 256, (4, 2, 4), dtype=np.uint8)
    for name, data in (("a.png", _png(rgb)), ("b.png", _png(rgba)), ("c.png", b"\x89PNG\r\n\x1a\nrubbish"), ("d.png", _png(np.zeros((40, 40, 3), np.uint8)))):
        (tmp_path / name).write_bytes(data)
    got = {r.path[-5:]: r for r in files.images(spark, str(tmp_path), most_pixels=1000).collect()}
    assert set(got) == {"a.png", "b.png", "c.png", "d.png"}
    assert (got["a.png"].height, got["a.png"].width, bytes(got["a.png"].pixels)) == (3, 5, rgb.tobytes())
    alpha = rgba[:, :, 3:].astype(int)
    flat = (rgba[:, :, :3].astype(int) * alpha + 255 * (255 - alpha) + 127) // 255
    assert bytes(got["b.png"].pixels) == flat.astype(np.uint8).tobytes()
    assert got["c.png"].error == "damaged" and got["c.png"].pixels is None
    assert got["d.png"].error == "over 1000 pixels" and got["d.png"].pixels is None


def test_orientation():
    for order, mark in (("<", b"II*\0"), (">", b"MM\0*")):
        tiff = mark + struct.pack(f"{order}I", 8) + struct.pack(f"{order}H", 2) + struct.pack(f"{order}HHIHH", 0x010F, 3, 1, 7, 0) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, 6, 0)
        assert files.orientation(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff) == 6
        assert files.orientation(b"\xff\xd8\xff\xe1\0\0Exif\0\0" + tiff[:14]) == 1
    assert files.orientation(b"\x89PNG") == 1 and files.orientation(b"\xff\xd8Exif\0\0??") == 1
    grid = np.arange(6).reshape(2, 3)
    seen = {1: [[0, 1, 2], [3, 4, 5]], 2: [[2, 1, 0], [5, 4, 3]], 3: [[5, 4, 3], [2, 1, 0]], 4: [[3, 4, 5], [0, 1, 2]], 5: [[0, 3], [1, 4], [2, 5]], 6: [[3, 0], [4, 1], [5, 2]], 7: [[5, 2], [4, 1], [3, 0]], 8: [[2, 5], [1, 4], [0, 3]]}
    assert all(files.upright(grid, turn).tolist() == wanted for turn, wanted in seen.items())


def test_labels_are_those_of_a_flood():
    rng = random.Random(7)
    for _ in range(60):
        mask = np.array([[rng.random() < 0.45 for _ in range(rng.randint(1, 14))]] * 1) if rng.random() < 0.1 else np.array([[rng.random() < 0.45 for _ in range(12)] for _ in range(9)])
        wanted = np.zeros(mask.shape, int)
        for start in np.argwhere(mask):
            if wanted[tuple(start)]:
                continue
            name, todo = start[0] * mask.shape[1] + start[1] + 1, [tuple(start)]
            while todo:
                y, x = todo.pop()
                if 0 <= y < mask.shape[0] and 0 <= x < mask.shape[1] and mask[y, x] and not wanted[y, x]:
                    wanted[y, x] = name
                    todo += [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        assert (rasters.label(mask) == wanted).all()
