"""Fixed-capacity containers filled with whole texts, sized in tokens of a public tokenizer.

Bounded-space online best-fit: a packer holds at most ``open_bins`` open containers.
Their free space is a bitset, bit ``f`` set while some open container has ``f`` tokens
free, so the tightest container that takes an item is the lowest set bit at or above
the item's size. When a new one is needed and none may be opened, the fullest closes.

Packers run side by side on shards of bounded size; what they leave open is packed
again, container by container, until one packer has seen all of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN_BINS = 256
#: Items a packer takes; two shards of a capacity are packed by different tasks.
SHARD_ITEMS = 50_000
#: Limits a call may state; more are an error.
MOST_LIMITS = 10_000


class Packer:
    """Online best-fit over sizes from 0 to ``capacity``."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.free_bits = 0
        self.bins: dict[int, list[int]] = {}
        self.n_open = 0
        self.opened = 0

    def _add(self, free: int, bin_: int) -> None:
        if stack := self.bins.get(free):
            stack.append(bin_)
        else:
            self.bins[free] = [bin_]
            self.free_bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_ = stack.pop()
        if not stack:
            del self.bins[free]
            self.free_bits ^= 1 << free
        self.n_open -= 1
        return bin_

    def place(self, size: int) -> int:
        """The container that takes an item of ``size``."""
        fits = self.free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.n_open >= self.limit:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
            free, bin_ = self.capacity, self.opened
            self.opened += 1
        if free > size:
            self._add(free - size, bin_)
        return bin_

    def still_open(self) -> set[int]:
        return {b for stack in self.bins.values() for b in stack}


def token_counts(texts: Iterator[pd.Series], path: str = TOKENIZER) -> Iterator[pd.Series]:
    """Tokens of each text; null and empty texts have none."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    for batch in texts:
        out = []
        values = ["" if x is None else x for x in batch]
        for i in range(0, len(values), 64):
            out += [len(e.ids) for e in t.encode_batch_fast(values[i : i + 64], add_special_tokens=False)]
        yield pd.Series(out, dtype="int64")


def token_sizes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row."""

    @F.pandas_udf("long")
    def sized(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from token_counts(texts, tokenizer)

    return documents.select(F.col(id_col).alias("doc_id"), sized(F.col(text_col)).alias("n_tokens"))


def _pack_udf(open_bins: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        p = Packer(int(pdf["capacity"].iloc[0]), open_bins)
        # the order of arrival is that of the key, so a repeated run packs alike
        pdf = pdf.sort_values("unit", kind="stable")
        at = [p.place(s) for s in pdf["size"].tolist()]
        left = p.still_open()
        return pd.DataFrame(
            {
                "limit_id": pdf["limit_id"],
                "unit": pdf["unit"],
                "container": [f"{lim}:{lev}:{sh}:{b}" for lim, lev, sh, b in zip(pdf["limit_id"], pdf["level"], pdf["shard"], at)],
                "size": pdf["size"],
                "capacity": pdf["capacity"],
                "is_open": [b in left for b in at],
            }
        )

    return pack


def _packed(units: DataFrame, level: int, shards: int, open_bins: int) -> DataFrame:
    keyed = units.withColumn("level", F.lit(level)).withColumn("shard", F.pmod(F.xxhash64("unit"), F.lit(shards)).cast("int"))
    return keyed.groupBy("limit_id", "shard").applyInPandas(
        _pack_udf(open_bins), "limit_id long, unit string, container string, size long, capacity long, is_open boolean"
    )


def containers(
    documents: DataFrame,
    limits: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit_col: str = "limit_id",
    capacity_col: str = "capacity_tokens",
    tokenizer: str = TOKENIZER,
    open_bins: int = OPEN_BINS,
    shard_items: int = SHARD_ITEMS,
) -> DataFrame:
    """``(limit_id, container, doc_id, piece, start_token, tokens)``: where each text goes, for each capacity.

    A text of at most the capacity is one piece (0). A longer one fills containers of
    its own with whole capacities, and only its rest is packed with others. Null and
    empty texts take no room and go where the tightest open container is. Rows are
    packed one by one, so a repeated row is packed twice; a null capacity or one below
    1 has no containers. Empty tables give an empty result.
    """
    sizes = cut(token_sizes(documents, id_col, text_col, tokenizer).withColumn("row", F.monotonically_increasing_id()))
    lims = limits.select(F.col(limit_col).cast("long").alias("limit_id"), F.col(capacity_col).cast("long").alias("capacity")).where("capacity >= 1").distinct()
    stated = lims.limit(MOST_LIMITS + 1).collect()
    if len(stated) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    n_rows = sizes.count()
    each = F.array(*(F.struct(F.lit(r.limit_id).cast("long").alias("limit_id"), F.lit(r.capacity).cast("long").alias("capacity")) for r in stated))
    if not stated:
        each = each.cast("array<struct<limit_id: bigint, capacity: bigint>>")
    cap, n = F.col("capacity"), F.col("n_tokens")
    # one row a text and limit: every text is packed for each of the stated limits
    pieces = (
        sizes.select("*", F.inline(each))
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(n / cap) - 1, F.lit(0)).cast("long"))))
        .withColumn("start_token", F.col("piece") * cap)
        .withColumn("size", F.least(cap, n - F.col("start_token")))
        .withColumn("unit", F.concat_ws(":", F.col("row"), F.col("piece")))
    )
    shard_items = max(shard_items, 4 * open_bins)  # what shards leave open has to shrink from level to level
    rows = ("limit_id", "container", "doc_id", "piece", "start_token", "tokens")
    whole = pieces.where(F.col("size") == cap).withColumn("container", F.concat_ws(":", "limit_id", F.lit("t"), "unit")).withColumn("tokens", F.col("size")).select(*rows)
    parts = pieces.where(F.col("size") < cap)
    shards = max(1, -(-n_rows // shard_items))
    level = 0
    at = _packed(parts.select("limit_id", "capacity", "unit", "size"), level, shards, open_bins)
    if shards > 1:
        at = cut(at)
    place = at
    while shards > 1:
        level += 1
        bins = place.where("is_open").groupBy("limit_id", "capacity", F.col("container").alias("unit")).agg(F.sum("size").alias("size"))
        # only the bins of the last level may still be open, open_bins a shard
        shards = max(1, -(-open_bins * shards // shard_items))
        place = cut(_packed(bins, level, shards, open_bins))
        moved = place.select(F.col("limit_id").alias("l2"), F.col("unit").alias("u2"), F.col("container").alias("c2"))
        at = at.join(moved, (at["limit_id"] == moved["l2"]) & (at["container"] == moved["u2"]), "left").select(
            "limit_id", "unit", F.coalesce("c2", "container").alias("container"), "size", "capacity"
        )
    at = at.select(F.col("limit_id").alias("l1"), F.col("unit").alias("u1"), "container")
    joined = parts.join(at, (parts["limit_id"] == at["l1"]) & (parts["unit"] == at["u1"])).withColumn("tokens", F.col("size"))
    return whole.unionByName(joined.select(*rows))


def fill(packed: DataFrame, limits: DataFrame, limit_col: str = "limit_id", capacity_col: str = "capacity_tokens") -> DataFrame:
    """Per limit: ``n_containers, n_pieces, n_tokens, waste`` (share of the room left unused, 0 without containers)."""
    used = packed.groupBy("limit_id", "container").agg(F.count(F.lit(1)).alias("k"), F.sum("tokens").alias("t"))
    per = used.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("k").alias("n_pieces"), F.sum("t").alias("n_tokens"))
    lims = limits.select(F.col(limit_col).cast("long").alias("limit_id"), F.col(capacity_col).cast("long").alias("capacity"))
    return lims.join(per, "limit_id").withColumn("waste", F.lit(1.0) - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
