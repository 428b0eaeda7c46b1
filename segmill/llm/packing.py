"""Filling fixed-capacity containers: next fit, then a swap-based local search on squared fill until no step is left."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import tokens
from segmill.session import checkpointed, small_table

#: Items of one packing cell, on average. A cell is one task's work; what is lost at its border is one bin.
CELL_ITEMS = 20_000


class Spec(NamedTuple):
    spec_id: int
    capacity: int
    tokenizer: str


def next_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of every item, a new bin where the last one has no room: where the search starts.

    Items are taken alternately from the large and from the small ones, so that bins hold some of both.
    """
    down = np.argsort(-sizes, kind="stable")
    order = np.empty_like(down)
    order[0::2], order[1::2] = down[: (len(down) + 1) // 2], down[::-1][: len(down) // 2]
    bins, count, fill = np.empty(len(sizes), np.int64), 0, 0
    for i in order.tolist():
        size = int(sizes[i])
        if fill + size > capacity:
            count, fill = count + 1, 0
        bins[i] = count
        fill += size
    return bins


class _Pool:
    """Items of the bins that may give some, by size."""

    def __init__(self, capacity: int):
        self.by_size: dict[int, dict[int, int]] = {}  # size -> item -> bin
        self.present = np.zeros(capacity + 1, bool)
        self._greatest: np.ndarray | None = None
        self._sizes = np.arange(capacity + 1)

    def add(self, item: int, size: int, bin_: int) -> None:
        held = self.by_size.setdefault(size, {})
        if not held:
            self.present[size] = True
            self._greatest = None
        held[item] = bin_

    def remove(self, item: int, size: int) -> None:
        held = self.by_size[size]
        del held[item]
        if not held:
            self.present[size] = False
            self._greatest = None

    def greatest(self) -> np.ndarray:
        """Of every bound the greatest size up to it, 0 for none."""
        if self._greatest is None:
            self._greatest = np.maximum.accumulate(np.where(self.present, self._sizes, 0))
        return self._greatest

    def any_of(self, size: int) -> tuple[int, int]:
        held = self.by_size[size]
        item = next(reversed(held))
        return item, held[item]


def improve(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """Local search on the sum of squared fills.

    From the fullest bin down, each takes from the less filled ones what fills it most: an item moved into it,
    exchanged for one smaller item of its own, or for two of them. Such a step makes the fuller bin fuller, so the
    sum of squares, a bounded whole number, grows with each; bins that give all their items away are empty. Where fills
    stay as they are, two items are still exchanged for one of their common size, which leaves small items to the less
    filled bins, where they fill what room is left. All items and all pairs of a bin's items are tried; the
    search ends when no step is left.
    """
    size = sizes.tolist()
    members: dict[int, list[int]] = {}
    for item, b in enumerate(bins.tolist()):
        if size[item]:
            members.setdefault(b, []).append(item)
    fill = {b: sum(size[i] for i in own) for b, own in members.items()}
    place = bins.copy()
    stepped = True
    while stepped:
        stepped = False
        order = sorted((b for b in fill if fill[b]), key=lambda b: (-fill[b], b))
        pool = _Pool(capacity)
        # of equal sizes the item of the least filled bin goes first
        for b in order:
            for item in members[b]:
                pool.add(item, size[item], b)
        for b in order:
            own = members[b]
            if not own:  # emptied meanwhile
                continue
            for item in own:
                pool.remove(item, size[item])
            while (step := _step(own, size, capacity - fill[b], pool, fill, fill[b])) is not None:
                item, giver, out = step
                stepped = True
                pool.remove(item, size[item])
                members[giver].remove(item)
                own.append(item)
                place[item] = b
                for x in out:
                    own.remove(x)
                    members[giver].append(x)
                    place[x] = giver
                    pool.add(x, size[x], giver)
                moved = size[item] - sum(size[x] for x in out)
                fill[b] += moved
                fill[giver] -= moved
    # items of no size go along with any others
    filled = next((b for b in fill if fill[b]), int(place.min(initial=0)))
    alone = np.array([size[i] == 0 and not fill.get(b) for i, b in enumerate(place.tolist())], bool)
    place[alone] = filled
    return place


@functools.cache
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n)


def _step(own: list[int], size: list[int], room: int, pool: _Pool, fill: dict[int, int], own_fill: int) -> tuple[int, int, tuple[int, ...]] | None:
    """``(item to take, its bin, own items given for it)``: an exchange of equal sizes, else what fills the room most.

    Of equal ones that which gives most items: small items left to the other bins make them easier to fill.
    Pairs are pairs of different sizes (or of a repeated one): those of one bin are few, as their sum is at
    most the capacity.
    """
    by_size: dict[int, list[int]] = {}
    for item in own:
        by_size.setdefault(size[item], []).append(item)
    kinds = np.array(sorted(by_size))
    sums = np.empty(0, np.int64)
    if len(own) > 1:
        left, right = _places(len(kinds))
        if len(kinds) < len(own):
            real = (left != right) | np.array([len(by_size[k]) > 1 for k in kinds.tolist()])[left]
        else:
            real = left != right
        left, right = kinds[left[real]], kinds[right[real]]
        sums = left + right
        equal = np.where(pool.present[sums], sums, 0)
        k = int(equal.argmax())
        if equal[k]:
            item, giver = pool.any_of(int(sums[k]))
            if fill[giver] < own_fill:
                return item, giver, (by_size[int(left[k])][0], by_size[int(right[k])][-1])
    if room <= 0:
        return None
    greatest = pool.greatest()
    best, chosen = 0, None
    if len(sums):
        gains = greatest[sums + room] - sums
        most = int(gains.max())
        if most > 0:
            k = int(np.where(gains == most, sums, -1).argmax())
            best, chosen = most, (int(sums[k]) + most, (by_size[int(left[k])][0], by_size[int(right[k])][-1]))
    if best < room:
        gains = greatest[kinds + room] - kinds
        most = int(gains.max(initial=0))
        if most > best:
            one = int(kinds[np.flatnonzero(gains == most)[-1]])
            best, chosen = most, (one + most, (by_size[one][0],))
    if best < room and (wanted := int(greatest[room])) > best:
        chosen = (wanted, ())
    if chosen is None:
        return None
    item, giver = pool.any_of(chosen[0])
    return item, giver, chosen[1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of items that each fit the capacity, numbered from 0 without gaps."""
    if not len(sizes):
        return np.empty(0, np.int64)
    bins = improve(sizes, next_fit(sizes, capacity), capacity)
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def assign(documents: DataFrame, specs: Sequence[Spec], id_col: str = "doc_id", text_col: str = "text", cell_items: int = CELL_ITEMS, directory: str | None = None) -> DataFrame:
    """``(spec_id, doc_id, piece, piece_tokens, container)``: the container of every document under every spec.

    A document is one piece; only one that alone exceeds the capacity is cut, into full containers of its
    own and a rest that is packed like the others. Texts of no tokens (NULL, empty) take no room and
    still get a container. Repeated ids are packed as often as they occur; ties are settled by id.

    Documents are counted once for all specs. Cells are even shares by a hash of the id, so no source or
    repository can overfill one; each is packed on its own, by :func:`next_fit` and :func:`improve`.
    ``container`` is unique inside a spec.
    """
    files = {f"n{i}": tokens.FILES.get(s.tokenizer, s.tokenizer) for i, s in enumerate(specs)}
    # written once: the number of cells comes from it, and a lost executor doesn't count its texts again
    counts = checkpointed(tokens.counted(documents, [id_col], text_col, files, directory))
    cells = max(1, -(-counts.count() // cell_items))
    each = F.array(*(F.struct(F.lit(s.spec_id).cast("long").alias("spec_id"), F.lit(s.capacity).cast("long").alias("capacity"), F.col(f"n{i}").alias("size")) for i, s in enumerate(specs)))
    items = counts.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.xxhash64(id_col), F.lit(cells)).alias("cell"), F.explode(each).alias("s")).select("doc_id", "cell", "s.*")

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, cell = int(pdf["capacity"].iat[0]), int(key[1])
        pdf = pdf.sort_values("doc_id", kind="stable")
        ids, sizes = pdf["doc_id"].to_numpy(), pdf["size"].to_numpy()
        whole, rest = sizes // capacity, sizes % capacity
        packed = (rest > 0) | (sizes == 0)
        bins = np.full(len(ids), -1, np.int64)
        bins[packed] = pack(rest[packed], capacity)
        first_full = int(bins.max(initial=-1)) + 1
        full_ids = np.repeat(ids, whole)
        piece = np.arange(len(full_ids)) - np.repeat(np.cumsum(whole) - whole, whole)
        out = pd.DataFrame(
            {
                "doc_id": np.concatenate((full_ids, ids[packed])),
                "piece": np.concatenate((piece, whole[packed])),
                "piece_tokens": np.concatenate((np.full(len(full_ids), capacity), rest[packed])),
                "container": np.concatenate((first_full + np.arange(len(full_ids)), bins[packed])) * cells + cell,
            }
        )
        out.insert(0, "spec_id", int(key[0]))
        return out

    return items.groupBy("spec_id", "cell").applyInPandas(fill, "spec_id long, doc_id long, piece long, piece_tokens long, container long")


def fills(assignment: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """``(spec_id, capacity, containers, tokens, fill, least_containers)``: the fill of each spec.

    ``least_containers`` is the bound that no packing can beat, tokens over capacity rounded up.
    """
    capacity = F.create_map(*(F.lit(x).cast("long") for s in specs for x in (s.spec_id, s.capacity)))
    per = assignment.groupBy("spec_id", "container").agg(F.sum("piece_tokens").alias("used"))
    out = per.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"))
    cap = capacity[F.col("spec_id")]
    return out.select("spec_id", cap.alias("capacity"), "containers", "tokens", (F.col("tokens") / (F.col("containers") * cap)).alias("fill"), F.ceil(F.col("tokens") / cap).alias("least_containers"))


def read_specs(rows: DataFrame) -> list[Spec]:
    """The specifications, a fixed small table."""
    return [Spec(r.spec_id, r.capacity_tokens, r.tokenizer) for r in small_table(rows.orderBy("spec_id"), 1000)]
