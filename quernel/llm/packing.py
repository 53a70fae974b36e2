"""Fills containers of fixed capacity with documents, cutting none that fits in one.

Harmonic packing: the sizes over C/(k+1) up to C/k form class k, of which k fit in a container, whichever they are. Items
are dealt to workers at random, and each worker fills its containers by itself. A worker takes the classes from the
largest items to the smallest, and a container of class k gets k items of its class. That alone leaves room in each
container, so before a class opens containers of its own, its items go into the room that larger classes left, each to the
container where least room remains.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quernel.llm.tokens import TOKENIZER, cut_tokens
from quernel.session import checkpointed

ITEMS_A_WORKER = 20_000


def fill(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, numbered from 0. Sizes must be from 1 to capacity."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    held = [0] * len(sizes)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by the room left in them
    there = 0  # bit r: some container has r left
    n, start = 0, 0
    while start < len(order):
        k = capacity // sizes[order[start]]
        stop = start
        while stop < len(order) and capacity // sizes[order[stop]] == k:
            stop += 1
        rest = []
        for i in order[start:stop]:
            s = sizes[i]
            above = there >> s
            if not above:
                rest.append(i)
                continue
            r = s + (above & -above).bit_length() - 1
            c = room[r].pop()
            if not room[r]:
                there &= ~(1 << r)
            held[i] = c
            if r > s:
                room[r - s].append(c)
                there |= 1 << (r - s)
        for j in range(0, len(rest), k):
            group = rest[j : j + k]
            left = capacity - sum(sizes[i] for i in group)
            for i in group:
                held[i] = n
            if left:
                room[left].append(n)
                there |= 1 << left
            n += 1
        start = stop
    return held


def token_items(documents: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The items to pack: id, piece_no from 1, start_char, end_char, tokens. A text longer than capacity comes as pieces."""
    kind = documents.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, n, *p) for k, t in zip(b["k"], b["t"], strict=True) for n, p in enumerate(cut_tokens(t, capacity, tokenizer), 1)]
            yield pd.DataFrame(rows, columns=["k", "piece_no", "start_char", "end_char", "tokens"])

    return documents.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t")).mapInPandas(cut, f"k {kind}, piece_no int, start_char int, end_char int, tokens int").withColumnRenamed("k", id_col)


def pack(items: DataFrame, capacity: int, size_col: str = "tokens") -> DataFrame:
    """Adds container_id to items; those of size 0 or less or null are left out, as is nothing else.

    Every row is an item of its own, repeated or not. Rows are dealt to workers by a hash that no value of theirs can make
    uneven, about 20,000 to each, and only sizes go there. Raises if an item is larger than the capacity.
    """
    cols = items.columns
    rows = checkpointed(items.filter(F.col(size_col) > 0))
    found = rows.agg(F.count("*").alias("n"), F.max(size_col).alias("m")).first()
    if found.n and found.m > capacity:
        raise ValueError(f"an item of {found.m} is larger than the capacity of {capacity}")
    workers = max(1, -(-found.n // ITEMS_A_WORKER))
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_worker", F.pmod(F.xxhash64("_row"), F.lit(workers)).cast("int"))

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        base = int(rows["_worker"].iloc[0]) << 32
        rows["container_id"] = [base + c for c in fill([int(s) for s in rows[size_col]], capacity)]
        return rows[[*cols, "container_id"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", container_id bigint"
    return dealt.groupBy("_worker").applyInPandas(work, schema)


def pack_documents(documents: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Documents packed into containers of capacity tokens: container_id, id, piece_no, start_char, end_char, tokens.

    Defined results: null and empty texts have no tokens and no container; repeated rows are packed again; other columns
    are ignored; an empty table gives no rows.
    """
    return pack(token_items(documents, capacity, id_col, text_col, tokenizer), capacity)


def container_report(packed: DataFrame, capacity: int = 2048, size_col: str = "tokens") -> DataFrame:
    """One row: containers, items, tokens, the room left in all and the least number of containers that could do."""
    total = F.coalesce(F.sum(size_col), F.lit(0))
    n = F.count_distinct("container_id")
    return packed.agg(n.alias("containers"), F.count("*").alias("items"), total.alias("tokens"), (n * capacity - total).alias("room_left"), F.ceil(total / capacity).alias("least_containers"))
