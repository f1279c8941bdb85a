"""Byte-level BPE encoding of a corpus with a public tokenizer's vocabulary.

Each pre-token is a linked list of symbols. Positions wait in buckets per merge rank; a two-level bitmap tells the
lowest rank that has any; entries whose pair changed meanwhile are skipped. So a pre-token of n bytes takes O(n) list
steps and one small search per merge, however long it is.
"""

import json
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.session import col, spread

#: Folder of the public tokenizers' files; a parameter, never part of this repository.
TOKENIZERS = os.environ.get("VELDT_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of blanks with the run of other signs behind it. No pre-token begins with another sign and goes on over a blank,
#: and none looks further ahead, so a text's pre-tokens are those of its chunks.
CHUNK = r"\s*+\S++|\s++"
#: Chunks whose ids a worker keeps, and the longest kept; others are encoded again.
KEPT, KEPT_CHARS = 300_000, 64


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary's file, as sign to byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {chr(b if b in plain else next(spare)): b for b in range(256)}


def load_vocabulary(path: str) -> tuple[list[int], dict[int, int]]:
    """The id of each byte, and (left id << 20 | right id) to (rank << 20 | new id), from a tokenizer's JSON file."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, signs = model["vocab"], byte_signs()
    base = [0] * 256
    for sign, byte in signs.items():
        base[byte] = vocab[sign]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        merges.setdefault(vocab[a] << 20 | vocab[b], rank << 20 | vocab[a + b])
    return base, merges


#: Bits of one word of the bitmap, and its single bits.
WORD = 8
BIT = [1 << k for k in range(1 << WORD)]


class RankQueue:
    """Positions by merge rank; two levels of 256-bit words find the lowest rank."""

    def __init__(self, ranks: int):
        if ranks >> 2 * WORD:
            raise ValueError(f"more than {1 << 2 * WORD} ranks")
        self.low = [0] * ((ranks >> WORD) + 1)
        self.top = 0
        self.at: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if rank in self.at:
            self.at[rank].append(position)
            return
        self.at[rank] = [position]
        self.low[rank >> WORD] |= BIT[rank & 255]
        self.top |= BIT[rank >> WORD]

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank with its positions, which leave the queue; rank -1 if there is none."""
        if not self.top:
            return -1, []
        a = (self.top & -self.top).bit_length() - 1
        word = self.low[a]
        bit = word & -word
        self.low[a] = word = word ^ bit
        if not word:
            self.top ^= BIT[a]
        rank = a << WORD | bit.bit_length() - 1
        return rank, self.at.pop(rank)


def encode_bytes(data: bytes, base: list[int], merges: dict[int, int], queue: RankQueue) -> list[int]:
    """The ids of one pre-token: always the pair of lowest rank, the leftmost first.

    The queue is empty before and after; its pushes and pops stand here in line, as they are most of the work.
    """
    ids = [base[x] for x in data]
    n = len(ids)
    if n < 2:
        return ids
    get, low, at, top = merges.get, queue.low, queue.at, 0
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waits = [None] * n  # the merge for which each position waits: rank << 20 | new id
    left = ids[0]
    for i in range(n - 1):
        right = ids[i + 1]
        m = waits[i] = get(left << 20 | right)
        left = right
        if m is not None:
            r = m >> 20
            if r in at:
                at[r].append(i)
            else:
                at[r] = [i]
                low[r >> 8] |= BIT[r & 255]
                top |= BIT[r >> 8]
    while top:
        a = (top & -top).bit_length() - 1
        word = low[a]
        bit = word & -word
        low[a] = word = word ^ bit
        if not word:
            top ^= BIT[a]
        rank = a << 8 | bit.bit_length() - 1
        bucket = at.pop(rank)
        if len(bucket) > 1:
            bucket.sort()
        for k, i in enumerate(bucket):
            m = waits[i]
            if m is None or m >> 20 != rank:
                continue  # stale: the pair at i is gone
            j = after[i]
            ids[i] = new = m & 0xFFFFF
            ids[j] = -1
            waits[j] = waits[i] = None
            nxt = after[i] = after[j]
            lower = False
            if nxt < n:
                before[nxt] = i
                m = get(new << 20 | ids[nxt])
                if m is not None:
                    waits[i] = m
                    r = m >> 20
                    if r in at:
                        at[r].append(i)
                    else:
                        at[r] = [i]
                        low[r >> 8] |= BIT[r & 255]
                        top |= BIT[r >> 8]
                    lower = r <= rank
            p = before[i]
            if p >= 0:
                m = get(ids[p] << 20 | new)
                if m != waits[p]:
                    waits[p] = m
                    if m is not None:
                        r = m >> 20
                        if r in at:
                            at[r].append(p)
                        else:
                            at[r] = [p]
                            low[r >> 8] |= BIT[r & 255]
                            top |= BIT[r >> 8]
                        lower = lower or r <= rank
            if lower and k + 1 < len(bucket):  # a better pair has come up: the rest of the bucket waits again
                rest = [q for q in bucket[k + 1 :] if waits[q] is not None and waits[q] >> 20 == rank]
                if rest:
                    if rank in at:
                        at[rank] += rest
                    else:
                        at[rank] = rest
                        low[rank >> 8] |= BIT[rank & 255]
                        top |= BIT[rank >> 8]
                break
    return [x for x in ids if x >= 0]


class Known(dict):
    """The ids of chunks; those of a chunk met for the first time are found by its pre-tokens."""

    def __init__(self, base: list[int], merges: dict[int, int]):
        self.base, self.merges = base, merges
        self.split = regex.compile(PATTERN).findall
        self.queue = RankQueue(max((m >> 20 for m in merges.values()), default=0))

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(x for w in self.split(chunk) for x in encode_bytes(w.encode("utf-8"), self.base, self.merges, self.queue))
        if len(chunk) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[chunk] = ids
        return ids


def _encoder(shared):
    def run(batches):
        base, merges, held = shared.value  # one object a worker, so what it has met stays for its next tasks
        if "known" not in held:
            held["known"] = Known(base, merges)
        known = held["known"]
        chunks = regex.compile(CHUNK).findall
        for b in batches:
            found, size = [], np.zeros(b.num_rows + 1, np.int32)
            for k, text in enumerate(b["text"].to_pylist()):
                if text:
                    mine = [*map(known.__getitem__, chunks(text))]
                    found += mine
                    size[k + 1] = sum(map(len, mine))
            ids = pa.ListArray.from_arrays(pa.array(np.cumsum(size, dtype=np.int32)), pa.array(np.fromiter(chain.from_iterable(found), np.int32)))
            yield pa.RecordBatch.from_arrays([b["id"], ids], ["id", "ids"])

    return run


def encode_corpus(df: DataFrame, id_: str, text: str, vocabulary: str = "byte_bpe_50k.json", folder: str = TOKENIZERS) -> DataFrame:
    """id, ids: the token ids of each text, without special tokens; their strings in a text are ordinary text.

    Null and empty texts get an empty list, every row comes out once, whole texts are encoded whatever their length, and
    other columns are ignored; an empty table gives no row. Null ids stay null. The vocabulary (a file of some MB) is
    read on the driver and sent to the workers.
    """
    spark: SparkSession = df.sparkSession
    shared = spark.sparkContext.broadcast((*load_vocabulary(os.path.join(folder, vocabulary)), {}))
    rows = spread(df.select(col(id_).alias("id"), col(text).cast("string").alias("text")))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(_encoder(shared), f"id {kind}, ids array<int>").withColumnRenamed("id", id_)
