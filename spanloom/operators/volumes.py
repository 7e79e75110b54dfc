"""Volumes of cells in rows, worked on in blocks: curve skeletons.

A block is a cube of cells with a halo around it, one bounded group; a round shuffles cells once, to the blocks that see
them, and a block gives back the cells of its own cube. The halo is as wide as a round's steps can reach, so the result is
that of the whole volume, whatever the blocks.
"""

from __future__ import annotations

import itertools
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut_lineage

#: Side of a block.
BLOCK = 32
#: How far a round of eight steps reaches, with the border that is looked at before them.
HALO = 9
_ZYX = ("z", "y", "x")


@cache
def _neighbourhood() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets of the 26 neighbours, which of them touch by a face or an edge (18), by a face (6), and who of them touch each other, by
    anything and (among the 18) by a face."""
    at = np.array([o for o in itertools.product((-1, 0, 1), repeat=3) if o != (0, 0, 0)])
    near = np.abs(at[:, None] - at[None])
    edge, face = np.abs(at).sum(axis=1) <= 2, np.abs(at).sum(axis=1) == 1
    touch = near.max(axis=2) == 1
    by_face = (near.sum(axis=2) == 1) & edge[:, None] & edge[None]
    return at, edge, face, touch.astype(np.float32), by_face.astype(np.float32)


def _one_part(members: np.ndarray, touch: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Whether the ``counted`` members of each row are there and all in one part; parts grow over touching members."""
    wanted = members & counted
    reached = np.zeros_like(members)
    rows = np.flatnonzero(wanted.any(axis=1))
    reached[rows, wanted[rows].argmax(axis=1)] = True
    while True:
        more = reached | (members & (reached.astype(np.float32) @ touch > 0))
        if (more == reached).all():
            return wanted.any(axis=1) & (reached | ~wanted).all(axis=1)
        reached = more


def simple(around: np.ndarray) -> np.ndarray:
    """Rows of 26 neighbours (true: cell) whose middle can go without changing how cells, holes and hollows hang together."""
    _, edge, face, touch, by_face = _neighbourhood()
    return _one_part(around, touch, np.ones(26, bool)) & _one_part(~around & edge, by_face, face)


def thinned_once(cells: np.ndarray) -> np.ndarray:
    """A volume after a round: border cells go where they are simple and no line's end, those of one of eight parities after another.

    Cells of one parity do not touch each other: those of a step go all at once as they would one by one.
    """
    at, _, face, _, _ = _neighbourhood()
    now = np.pad(cells, 1)
    inner = now[1:-1, 1:-1, 1:-1]
    look = lambda a, p: a[tuple(p.T)]
    place = np.argwhere(inner) + 1
    border = place[~np.all([look(now, place + o) for o in at[face]], axis=0)]
    for parity in itertools.product((0, 1), repeat=3):
        # Parities are of the places in the volume, which the caller aligns.
        turn = border[((border - 1) % 2 == parity).all(axis=1)]
        around = np.array([look(now, turn + o) for o in at]).T.reshape(len(turn), 26)
        gone = turn[(around.sum(axis=1) != 1) & simple(around)]
        now[tuple(gone.T)] = False
    return inner


def skeleton(cells: DataFrame, keys: list[str] | None = None, block: int = BLOCK, rounds: int | None = None) -> DataFrame:
    """keys, z, y, x: the cells' curve skeleton, one cell wide, with as many parts, tunnels and hollows as before.

    Cells (integer z, y, x) touch by faces, edges or corners; the space between them by faces. Border cells go in rounds,
    where that changes nothing of the kind and they are no end of a line, until none goes: as many rounds as half of the thickest part, each a
    shuffle of cells to the blocks that see them. Repeated cells count once, cells with a null coordinate are none, null
    keys are a key.
    """
    keys = keys or []
    now = cut_lineage(cells.select(*keys, *[F.col(c).cast("bigint").alias(c) for c in _ZYX]).dropna(subset=list(_ZYX)).distinct())
    kinds = dict(now.dtypes)
    names = [*keys, *_ZYX]
    schema = ", ".join(f"{c} {kinds[c]}" for c in names)
    side = block + block % 2  # even, so that a cell has one parity in all blocks

    def run(table: pa.Table) -> pa.Table:
        low = np.array([table.column(f"__b{c}")[0].as_py() for c in _ZYX]) * side - HALO
        low -= low % 2
        place = np.stack([table.column(c).to_numpy() for c in _ZYX], axis=1) - low
        volume = np.zeros([side + 2 * HALO + 2] * 3, bool)
        volume[tuple(place.T)] = True
        left = np.argwhere(thinned_once(volume)) + low
        first = np.array([table.column(f"__b{c}")[0].as_py() for c in _ZYX]) * side
        left = left[((left >= first) & (left < first + side)).all(axis=1)]
        own = [table.column(k).take(pa.array(np.zeros(len(left), np.int64))) for k in keys]
        return pa.table([*own, *[pa.array(left[:, i]) for i in range(3)]], names=names)

    turns = itertools.count() if rounds is None else range(rounds)
    before = now.count()
    for _ in turns:
        seen = now
        for c in _ZYX:
            # The block of a cell, and those whose halo it lies in.
            seen = seen.withColumn(f"__b{c}", F.explode(F.sequence(F.floor((F.col(c) - HALO) / side), F.floor((F.col(c) + HALO) / side))))
        now = cut_lineage(seen.groupBy(*keys, *[f"__b{c}" for c in _ZYX]).applyInArrow(run, schema))
        after = now.count()
        if after == before:
            break
        before = after
    return now
