"""Raster and layout operators that need a page as a whole: components, bands and cuts, as grouped maps in NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Fixed value: the budget of components that the layout rules look at, largest first.
MOST_COMPONENTS = 20_000


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a mask, each pixel with its component's least place + 1; 0 is background.

    Dark runs of each row are joined with those they touch in the row above, so work follows the number of runs.
    """
    labels, parent = np.zeros(mask.shape, np.int64), {}

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    above: list[tuple[int, int, int]] = []
    runs: list[tuple[int, int, int, int]] = []
    for y, row in enumerate(mask):
        edges = np.flatnonzero(np.diff(np.pad(row.astype(np.int8), 1))).tolist()
        here = []
        for first, end in zip(edges[::2], edges[1::2], strict=True):
            name = y * mask.shape[1] + first
            parent[name] = name
            here.append((first, end, name))
            runs.append((y, first, end, name))
        j = 0
        for first, end, name in here:
            while j < len(above) and above[j][1] < first:
                j += 1
            k = j
            while k < len(above) and above[k][0] <= end:
                one, other = root(above[k][2]), root(name)
                parent[max(one, other)] = min(one, other)
                k += 1
        above = here
    for y, first, end, name in runs:
        labels[y, first:end] = root(name) + 1
    return labels


def components(pixels: DataFrame, key: str, dark: int) -> DataFrame:
    """Connected dark areas of each raster (key, x, y, value): box, area and rank, largest first. A raster fits a task."""

    def find(page: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((int(page["y"].max()) + 1, int(page["x"].max()) + 1), 255)
        grid[page["y"], page["x"]] = page["value"]
        found = label(grid < dark)
        y, x = np.nonzero(found)
        boxes = pd.DataFrame({"part": found[y, x], "y": y, "x": x}).groupby("part").agg(x1=("x", "min"), y1=("y", "min"), x2=("x", "max"), y2=("y", "max"), area=("x", "size"))
        boxes = boxes.sort_values(["area", "y1", "x1"], ascending=[False, True, True]).head(MOST_COMPONENTS).reset_index(drop=True)
        return boxes.assign(**{key: page[key].iloc[0], "rank": range(1, len(boxes) + 1)})[[key, "rank", "x1", "y1", "x2", "y2", "area"]]

    return pixels.groupBy(key).applyInPandas(find, f"{key} {dict(pixels.dtypes)[key]}, rank long, x1 long, y1 long, x2 long, y2 long, area long")


def bands(height: int, cuts: list[int], structural: list[int], least: int, most: int) -> list[tuple[int, int]]:
    """Horizontal bands of at most `most` rows: the first structural cut in reach, else the last other one, else the full band."""
    out: list[tuple[int, int]] = []
    top = 0
    while height - top > most:
        strong = [c for c in structural if top + max(80, least // 3) <= c <= top + most]
        weak = [c for c in (*cuts, *structural) if top + least <= c <= top + most]
        bottom = min(strong) if strong else max(weak) if weak else top + most
        out.append((top, bottom))
        top = bottom
    if out and 0 < height - top < least:
        return [*out[:-1], (out[-1][0], height)]
    return [*out, (top, height)] if height > top else out
