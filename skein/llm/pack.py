"""Filling containers of a fixed capacity with texts, neighbours in content together.

1. Every text is encoded once; from its ids come its size and a hashed vector of ``DIMS`` components (the mean of fixed random
   signs of its ids), and from the vector its place along a Hilbert curve. Texts and ids never leave this step: what is
   written is (document, size, place).
2. A text longer than the capacity is split into full containers of its own and a rest, which is packed as an item; no other text is split.
3. Items are sorted by range along the curve. Each range is packed by itself, ``RUN`` neighbouring items at a time: the items of a
   run go, largest first, into the open container with the least room that still holds them (best fit decreasing), or a new one.
   Containers with little room left are closed; the others stay open for the next run. Runs are short, so that a container holds
   neighbours; what that costs in room is little (see the README). An item's place in the order is given as its position.

The only containers that stay badly filled are the last of each range, a few of thousands.

Cases: null and empty texts have no tokens; they are one piece of size 0 in a container of their range, where they need no room.
Texts of exactly the capacity fill a container. Repeated documents are packed one by one. An empty table has an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.curves import hilbert_keys, to_cells
from skein.llm.encode import default_ranks, encode_batch
from skein.plans.cut import cut

DIMS, BITS = 6, 8
#: Items that are packed together, and items of one range at most on average.
RUN, RANGE_ITEMS = 512, 200_000


def sizes(df: DataFrame, key: str, text: str, ranks: str | None = None) -> DataFrame:
    """Columns: doc_id, n_tokens, place along the curve (long)."""
    path = ranks or default_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = np.random.default_rng(7).choice(np.array([-1, 1], dtype=np.float32), (1 << 16, DIMS))
        for b in batches:
            offsets, ids = encode_batch(b.column(1), path)
            n = np.diff(offsets)
            sums = np.zeros((len(n), DIMS))
            full = n > 0
            if full.any():
                sums[full] = np.add.reduceat(signs[ids & 0xFFFF], offsets[:-1][full], axis=0)
            mean = sums / np.sqrt(np.maximum(n, 1))[:, None]
            place = hilbert_keys(to_cells(mean, -4.0, 4.0, BITS), BITS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(place)], ["doc_id", "n_tokens", "place"])

    narrow = df.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return narrow.mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, n_tokens bigint, place bigint")


class _Open:
    """Open containers by the room left in each."""

    def __init__(self, capacity: int) -> None:
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.rooms = 0  # a bit for each room that some container has

    def put(self, container: int, room: int) -> None:
        self.by_room[room].append(container)
        self.rooms |= 1 << room

    def tightest(self, size: int) -> int | None:
        """The least room of at least ``size`` that a container has."""
        fitting = self.rooms >> size
        return None if not fitting else size + (fitting & -fitting).bit_length() - 1

    def take(self, room: int) -> int:
        container = self.by_room[room].pop()
        if not self.by_room[room]:
            self.rooms &= ~(1 << room)
        return container

    def close_below(self, room: int) -> None:
        for r in range(room):
            self.by_room[r].clear()
        self.rooms = self.rooms >> room << room


def pack(items: DataFrame, capacity: int) -> DataFrame:
    """items: doc_id, n_tokens, place. Columns: doc_id, piece, from_token, n_tokens, container, position (long).

    A container's number is its range's number times 2**40 plus its number within the range, and so is a position.
    """
    rows, total = items.agg(F.count("*"), F.sum("n_tokens")).first()
    ranges = max(1, -(-(rows or 0) // RANGE_ITEMS))
    full = F.floor(F.col("n_tokens") / capacity).cast("long")
    rest = F.col("n_tokens") - full * capacity
    pieces = items.withColumns({"full": F.when(rest == 0, F.greatest(full - 1, F.lit(0))).otherwise(full)})
    pieces = pieces.withColumn("size", F.col("n_tokens") - F.col("full") * capacity)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        opened, made = _Open(capacity), TaskContext.get().partitionId() << 40
        at = made

        def pack_run(part: pd.DataFrame) -> pd.DataFrame:
            nonlocal made, at
            position = at + np.arange(len(part))
            at += len(part)
            docs, whole, size = part.doc_id.to_numpy(), part.full.to_numpy(), part["size"].to_numpy()
            place = np.empty(len(part), dtype=np.int64)
            order = np.argsort(-size, kind="stable")
            for i, s in zip(order.tolist(), size[order].tolist()):
                room = opened.tightest(s)
                if room is None:
                    container, room = made, capacity
                    made += 1
                else:
                    container = opened.take(room)
                opened.put(container, room - s)
                place[i] = container
            opened.close_below(max(1, capacity // 256))
            out = [pd.DataFrame({"doc_id": docs, "piece": whole, "from_token": whole * capacity, "n_tokens": size, "container": place, "position": position})]
            if whole.any():
                n = int(whole.sum())
                piece = np.concatenate([np.arange(w) for w in whole if w])
                out.append(pd.DataFrame({"doc_id": np.repeat(docs, whole), "piece": piece, "from_token": piece * capacity, "n_tokens": capacity, "container": made + np.arange(n), "position": np.repeat(position, whole)}))
                made += n
            return pd.concat(out)

        held = None
        for part in parts:
            held = part if held is None else pd.concat([held, part], ignore_index=True)
            whole = len(held) - len(held) % RUN
            if whole:
                yield pd.concat([pack_run(held[s : s + RUN]) for s in range(0, whole, RUN)])
                held = held[whole:]
        if held is not None and len(held):
            yield pack_run(held)

    sorted_items = pieces.select("doc_id", "full", "size", "place").repartitionByRange(ranges, "place", "doc_id").sortWithinPartitions("place", "doc_id")
    kind = items.schema["doc_id"].dataType.simpleString()
    return sorted_items.mapInPandas(run, f"doc_id {kind}, piece bigint, from_token bigint, n_tokens bigint, container bigint, position bigint")


def pack_texts(df: DataFrame, key: str, text: str, capacity: int = 2048, ranks: str | None = None) -> DataFrame:
    return pack(cut(sizes(df, key, text, ranks)), capacity)
