"""Texts packed into containers of fixed capacity (problem 8).

Minimum bin slack: the longest text that is left opens a container; a bitset holds which sums the remaining lengths can reach,
length by length (with their counts split into powers of two), until the container's room is met exactly or all lengths are in;
backtracking takes the multiset with the largest sum. Only a text longer than the capacity is cut, into full containers and one
rest, which is packed like a text. Texts are dealt in turn to shards of bounded size which are packed on their own; what lies in the
containers that a shard could not fill is packed once more, together with that of many other shards.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hodonym.session import materialize, parallelism, ship_code

#: Where the vocabulary of the public tokenizer lies.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which byte-level BPE splits a text first.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts in a shard, about; and shards whose unfilled containers are packed together.
SHARD, TOGETHER = 20_000, 100
#: The part of a container that may stay empty without its being packed again.
LEFT = 0.005
_OUT = "container_kind string, container_id string, doc_id long, part int, first_token long, n_tokens long"
#: Longer runs of white space are taken apart here, as the tokenizer's own pattern matching fails on them.
_LONG_RUN = re.compile(r"\s{4000}")


def token_counter(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    split = regex.compile(PATTERN)

    def count(text: str) -> int:
        if not _LONG_RUN.search(text):
            return len(coder.encode_ordinary(text))
        return sum(len(coder._encode_single_piece(m.group().encode())) for m in split.finditer(text))

    return count


def token_counts(docs: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, turn) of the texts that are not null; ``turn`` counts on within a task, so texts can be dealt evenly whatever their ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, n = token_counter(vocabulary), TaskContext.get().partitionId()
        for b in batches:
            sizes = [tokens(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sizes, pa.int64()), pa.array(range(n, n + len(sizes)), pa.int64())], names=["doc_id", "n_tokens", "turn"])
            n += len(sizes)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    return rows.mapInArrow(count, "doc_id long, n_tokens long, turn long")


def fill(room: int, counts: dict[int, int]) -> list[tuple[int, int]]:
    """The multiset [(length, times)] of ``counts`` whose sum comes closest to ``room`` without passing it."""
    if room <= 0:
        return []
    mask, full = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, times = min(counts[length], room // length), 1
        while left:
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= (reach << (length * times)) & mask
            left -= times
            times *= 2
        if reach & full:
            break
    target = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for length, times, before in reversed(steps):
        if not before >> target & 1:
            target -= length * times
            taken[length] = taken.get(length, 0) + times
    return list(taken.items())


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of indices into ``sizes``, all of which are between 1 and ``capacity``."""
    of: dict[int, list[int]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        of.setdefault(sizes[i], []).append(i)
    counts = {length: len(v) for length, v in of.items()}
    order = sorted(counts)
    out = []
    while order:
        longest = order[-1]
        chosen = [(longest, 1)]
        counts[longest] -= 1
        if not counts[longest]:
            del counts[longest]
        for length, times in fill(capacity - longest, counts):
            chosen.append((length, times))
            counts[length] -= times
            if not counts[length]:
                del counts[length]
        while order and order[-1] not in counts:
            order.pop()
        out.append([of[length].pop() for length, times in chosen for _ in range(times)])
    return out


def _in_containers(kind: str, capacity: int, label: str, ids: np.ndarray, parts: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> pd.DataFrame:
    """A container for each piece, none of which is longer than ``capacity``; pieces without tokens go to the first one."""
    some = np.flatnonzero(sizes > 0)
    number, used = np.zeros(len(sizes), np.int64), np.zeros(1, np.int64)
    bins = pack(sizes[some].tolist(), capacity)
    if bins:
        used = np.zeros(len(bins), np.int64)
        for k, members in enumerate(bins):
            number[some[members]] = k
            used[k] = sizes[some[members]].sum()
    frame = {"container_kind": kind, "container_id": [f"{kind}-{label}-{n}" for n in number], "doc_id": ids, "part": parts.astype("int32"), "first_token": first, "n_tokens": sizes, "open": (capacity - used > LEFT * capacity)[number]}
    return pd.DataFrame(frame)


def _pack_shard(pdf: pd.DataFrame, kind: str, capacity: int, shard: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable")
    ids, tokens = pdf.doc_id.to_numpy(), pdf.n_tokens.to_numpy()
    whole = np.where(tokens > capacity, tokens // capacity, 0)
    rest = tokens - whole * capacity
    cut = np.repeat(np.arange(len(ids)), whole)
    part = np.arange(len(cut)) - np.repeat(np.cumsum(whole) - whole, whole)
    full = {"container_kind": kind, "container_id": [f"{kind}-{shard}-cut-{n}" for n in range(len(cut))], "doc_id": ids[cut], "part": part.astype("int32"), "first_token": part * capacity, "n_tokens": np.full(len(cut), capacity, np.int64), "open": False}
    kept = np.flatnonzero((rest > 0) | (whole == 0))
    return pd.concat([pd.DataFrame(full), _in_containers(kind, capacity, str(shard), ids[kept], whole[kept], whole[kept] * capacity, rest[kept])], ignore_index=True)


def pack_containers(docs: DataFrame, doc_id: str, text: str, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, part, first_token, n_tokens): for every kind of container, where each text lies.

    ``part`` counts the pieces of a text that is longer than the capacity; all other texts have part 0. Null texts
    are left out, texts without tokens take no room. Kinds without a positive capacity hold nothing. A repeated kind counts once, with
    its largest capacity.
    """
    spark = docs.sparkSession
    ship_code(spark)
    kinds = [tuple(r) for r in containers.where("container_kind is not null and capacity_tokens > 0").groupBy("container_kind").agg(F.max("capacity_tokens").cast("long")).collect()]  # a short list
    sized = materialize(token_counts(docs, doc_id, text, vocabulary), "sizes")
    shards = sized.agg(F.greatest(F.ceil(F.count(F.lit(1)) / SHARD), F.lit(1))).scalar()
    listed = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).cast("long").alias("capacity")) for k, c in kinds)) if kinds else F.array().cast("array<struct<kind:string,capacity:bigint>>")

    def shard(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack_shard(pdf, key[1], int(key[2]), int(key[0])).assign(shard=int(key[0]), capacity=int(key[2]))

    def again(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part", "n_tokens"], kind="stable")
        return _in_containers(key[1], int(key[2]), f"again-{key[0]}", *(pdf[c].to_numpy() for c in ("doc_id", "part", "first_token", "n_tokens"))).drop(columns="open")

    wide = sized.withColumn("shard", F.pmod("turn", shards)).select("*", F.explode(listed).alias("k")).select("shard", "k.kind", "k.capacity", "doc_id", "n_tokens")
    first = wide.repartition(parallelism(spark), "shard", "kind").groupBy("shard", "kind", "capacity").applyInPandas(shard, _OUT + ", open boolean, shard long, capacity long")
    first = materialize(first, "packed")
    rest = first.where("open").withColumn("set", F.floor(F.col("shard") / TOGETHER)).groupBy("set", "container_kind", "capacity").applyInPandas(again, _OUT)
    return first.where("not open").drop("open", "shard", "capacity").unionByName(rest)


def container_use(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers, tokens, and the share of the capacity that is used."""
    caps = containers.groupBy("container_kind").agg(F.max("capacity_tokens").cast("long").alias("capacity"))
    used = packed.groupBy("container_kind").agg(F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"))
    return used.join(F.broadcast(caps), "container_kind").withColumn("filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
