"""Passages of held-out test items in a corpus.

An item is cut into passages, and a passage into one piece more than the errors it may hold, so that some piece of a
passage with so few errors stands in the document exactly. Piece hits come from window hashes of whole batches; the
passages around them are verified with Myers' bit-parallel edit distance, for all candidates at once; then the exact
run around a passage is measured. Any run of `run` characters of an item holds a whole passage.
"""

import math
import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.session import col, cut, release, spread

#: Characters of test items that are searched for at once. Larger sets are taken in blocks, but only in the documents that
#: one pass over the corpus, with a filter over the pieces of all blocks, has left.
BLOCK_CHARS = 16_000_000
#: Bits of that filter for each piece, and the most bits of its slot numbers (2 ** 31 bits are 256 MB).
PIECE_BITS, MOST_BITS = 16, 31
#: Characters of documents handled at once.
BATCH_CHARS = 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
FILTER_BITS = 22


def fold(text: str) -> str:
    """NFKC, lower case, letters and numbers only."""
    return regex.sub(r"[^\p{L}\p{N}]+", "", unicodedata.normalize("NFKC", text).lower())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class Windows:
    """Hashes of all windows of a code array, of any length."""

    def __init__(self, c: np.ndarray):
        with np.errstate(over="ignore"):
            x = (c.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
            self.sums = np.r_[np.uint64(0), np.cumsum(x * _powers(BASE, len(c)), dtype=np.uint64)]
            self.back = _powers(INVERSE, len(c) + 1)

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.back[at]


def passage_shape(run: int, budget: int) -> int:
    """Piece length, so that any window of `run` characters holds budget + 1 whole pieces in a row, in 64 bits at most."""
    return max(1, min((run + 1) // (budget + 2), 64 // (budget + 1)))


class Items:
    """The passages and pieces of a block of test items."""

    def __init__(self, ids: list, texts: list[str], run: int, budget: int):
        self.ids, self.budget, self.piece = ids, budget, passage_shape(run, budget)
        self.size = m = self.piece * (budget + 1)
        folded = [codes(fold(t or "")) for t in texts]
        self.codes = np.concatenate([*folded, np.zeros(1, np.uint32)])
        self.start = np.r_[0, np.cumsum([len(f) for f in folded])]
        at, item = [], []
        for k, f in enumerate(folded):
            if len(f) >= m:
                starts = np.unique(np.r_[np.arange(0, len(f) - m + 1, self.piece), len(f) - m])
                at.append(self.start[k] + starts)
                item.append(np.full(len(starts), k))
        self.at = np.concatenate(at) if at else np.zeros(0, int)
        self.item = np.concatenate(item) if item else np.zeros(0, int)
        self.windows = Windows(self.codes)
        self.whole = self.windows.of(self.at, m)
        piece = np.concatenate([self.windows.of(self.at + j * self.piece, self.piece) for j in range(budget + 1)]) if len(at) else np.zeros(0, np.uint64)
        order = np.argsort(piece, kind="stable")
        self.hashes, first = np.unique(piece[order], return_index=True)
        self.bounds = np.r_[first, len(piece)]
        self.passage = np.tile(np.arange(len(self.at)), budget + 1)[order]
        self.offset = np.repeat(np.arange(budget + 1) * self.piece, len(self.at))[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


def myers(patterns: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row the least edit distance of the pattern (at most 64 codes) to any part of the text."""
    n, m = patterns.shape
    one, last = np.uint64(1), np.uint64(m - 1)
    plus, minus = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = np.full(n, m, np.int64)
    best = score.copy()
    bits = np.zeros((n, 64), bool)
    with np.errstate(over="ignore"):
        for j in range(texts.shape[1]):
            bits[:, :m] = patterns == texts[:, j : j + 1]
            eq = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            score += ((ph >> last) & one).astype(np.int64) - ((mh >> last) & one).astype(np.int64)
            np.minimum(best, score, out=best)
            ph, mh = ph << one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
    return best


def find(items: Items, folded: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc, item, errors, run for every document and item with a passage within the budget, the best of each."""
    none = (np.zeros(0, int),) * 4
    m, e, size = items.size, items.budget, items.piece
    d = np.concatenate([*folded, np.zeros(1, np.uint32)])
    start = np.r_[0, np.cumsum([len(f) for f in folded])]
    if len(d) <= size or not len(items.at):
        return none
    win = Windows(d)
    h = win.of(np.arange(len(d) - size), size)
    hit = np.flatnonzero(items.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(items.hashes, h[hit]), len(items.hashes) - 1)
    ok = items.hashes[k] == h[hit]
    hit, k = hit[ok], k[ok]
    doc = np.searchsorted(start, hit, "right") - 1
    ok = hit + size <= start[doc + 1]
    hit, k, doc = hit[ok], k[ok], doc[ok]
    outs = [np.zeros((0, 4), int)]
    many = items.bounds[k + 1] - items.bounds[k]
    # Hits are expanded to passages in slices of a fixed size, however often a piece stands in the items.
    upto = np.cumsum(many)
    a = 0
    while a < len(hit):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 500_000, "right")))
        outs.append(_verify(items, d, win, start, hit[a:b], k[a:b], doc[a:b], many[a:b]))
        a = b
    found = np.concatenate(outs)
    if not len(found):
        return none
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    first = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(1)])
    return found[first, 0], found[first, 1], found[first, 2], np.maximum.reduceat(found[:, 3], first)


def _verify(items, d, win, start, hit, k, doc, many):
    m, e, size = items.size, items.budget, items.piece
    entry = np.repeat(items.bounds[k] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
    passage, offset = items.passage[entry], items.offset[entry]
    at, doc = np.repeat(hit, many) - offset, np.repeat(doc, many)
    # One candidate per passage and place.
    code = at.astype(np.int64) * len(items.at) + passage
    _, one = np.unique(code, return_index=True)
    at, doc, passage, offset = at[one], doc[one], passage[one], offset[one]
    lo, hi = start[doc], start[doc + 1]
    inside = (at >= lo) & (at + m <= hi)
    exact = np.zeros(len(at), bool)
    exact[inside] = win.of(at[inside], m) == items.whole[passage[inside]]
    errors = np.where(exact, 0, m)
    rest = np.flatnonzero(~exact) if e else np.zeros(0, int)
    if e == 1 and len(rest):
        # The other piece holds the one error in one of its halves; the other half stands exactly, at most one off.
        half = size // 2
        keep = np.zeros(len(rest), bool)
        src = items.at[passage[rest]] + np.where(offset[rest] == 0, size, 0)
        for a, n in ((0, half), (half, size - half)):
            want = items.windows.of(src + a, n)
            for shift in (-1, 0, 1):
                p = at[rest] + np.where(offset[rest] == 0, size, 0) + a + shift
                fits = (p >= lo[rest]) & (p + n <= hi[rest])
                keep[fits] |= win.of(p[fits], n) == want[fits]
        rest = rest[keep]
    for a in range(0, len(rest), 20_000):
        r = rest[a : a + 20_000]
        pat = items.codes[items.at[passage[r]][:, None] + np.arange(m)]
        p = at[r][:, None] - e + np.arange(m + 2 * e)
        ok = (p >= lo[r][:, None]) & (p < hi[r][:, None])
        errors[r] = myers(pat, np.where(ok, d[np.clip(p, 0, len(d) - 1)], np.uint32(0xFFFFFFFF)))
    good = errors <= e
    at, doc, passage, errors, lo, hi = at[good], doc[good], passage[good], errors[good], lo[good], hi[good]
    item = items.item[passage]
    run = np.zeros(len(at), int)
    sure = np.flatnonzero(errors == 0)
    # Hashes only propose; the letters decide.
    x, y = at[sure], items.at[passage[sure]]
    ok = (x >= lo[sure]) & (x + m <= hi[sure])
    sure, x, y = sure[ok], x[ok], y[ok]
    same = (d[x[:, None] + np.arange(m)] == items.codes[y[:, None] + np.arange(m)]).all(1) if len(sure) else np.zeros(0, bool)
    sure, x, y = sure[same], x[same], y[same]
    # Exact runs: one per diagonal of a document and item suffices for its consecutive passages.
    run[sure] = m
    for side in (-1, 1):
        live, step = np.arange(len(sure)), 0
        while len(live):
            step += 1
            p = x[live] + (m - 1 + step if side > 0 else -step)
            q = y[live] + (m - 1 + step if side > 0 else -step)
            i, s = item[sure[live]], sure[live]
            ok = (p >= lo[s]) & (p < hi[s]) & (q >= items.start[i]) & (q < items.start[i + 1])
            ok[ok] = d[p[ok]] == items.codes[q[ok]]
            live = live[ok]
            run[sure[live]] += 1
    keep = (errors > 0) | (run > 0)
    return np.stack([doc, item, errors, run], 1)[keep]


def _batches_of(pdf: pd.DataFrame):
    """(ids, texts, folded codes) of some BATCH_CHARS characters of documents at a time."""
    docs, texts, folded, held = [], [], [], 0
    for doc, text in zip(pdf["id"], pdf["text"]):
        if text:
            c = codes(fold(text))
            docs.append(doc)
            texts.append(text)
            folded.append(c)
            held += len(c)
        if held >= BATCH_CHARS:
            yield docs, texts, folded
            docs, texts, folded, held = [], [], [], 0
    if docs:
        yield docs, texts, folded


def _search(shared, run: int, budget: int):
    def scan(batches):
        ids, texts, held = shared.value  # one object a worker: its later tasks find the pieces prepared
        if "items" not in held:
            held["items"] = Items(ids, texts, run, budget)
        items = held["items"]
        for pdf in batches:
            for docs, _, folded in _batches_of(pdf):
                doc, item, errors, length = find(items, folded)
                yield pd.DataFrame({"doc": pd.Series([docs[i] for i in doc], dtype=object), "item": pd.Series([items.ids[i] for i in item], dtype=object), "errors": errors.astype("int32"), "run": length.astype("int32")})

    return scan


def _piece_slots(run: int, budget: int, bits: int):
    def scan(batches):
        for pdf in batches:
            h = Items([*range(len(pdf))], pdf["text"].tolist(), run, budget).hashes
            yield pd.DataFrame({"slot": np.unique(h >> np.uint64(64 - bits)).astype(np.int64)})

    return scan


def _maybe(shared, size: int, bits: int):
    """Documents in which some window falls into a slot of the filter."""

    def scan(batches):
        bitmap = shared.value
        for pdf in batches:
            for docs, texts, folded in _batches_of(pdf):
                d = np.concatenate([*folded, np.zeros(1, np.uint32)])
                ends = np.cumsum([len(f) for f in folded])
                if len(d) <= size:
                    continue
                slot = (Windows(d).of(np.arange(len(d) - size), size) >> np.uint64(64 - bits)).astype(np.int64)
                hit = np.flatnonzero(bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                keep = np.unique(np.searchsorted(ends, hit, "right"))
                yield pd.DataFrame({"id": pd.Series([docs[i] for i in keep], dtype=object), "text": pd.Series([texts[i] for i in keep], dtype=object)})

    return scan


def _left_by_filter(corpus: DataFrame, test: DataFrame, chars: int, run: int, budget: int) -> DataFrame:
    """The documents that may hold a piece of any item, by one pass over the corpus. The filter is built in the workers
    and the engine; its bits are in proportion to the pieces, up to a fixed number."""
    spark, size = corpus.sparkSession, passage_shape(run, budget)
    bits = min(MOST_BITS, max(FILTER_BITS, math.ceil(math.log2(max(chars / size, 1) * (budget + 1) * PIECE_BITS))))
    slots = test.select("text").mapInPandas(_piece_slots(run, budget, bits), "slot bigint")
    slots = slots.select((F.col("slot") + 1).alias("slot"))  # the engine's buckets count from 1
    parts = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))
    bitmap = np.zeros((1 << bits) // 8, np.uint8)
    for r in parts.toLocalIterator():  # 4 kB for each 32,768 slots
        part = np.frombuffer(bytes(r["bitmap"]), np.uint8)
        first = (r["bucket"] - 1) << 12
        bitmap[first : first + len(part)] |= part[: len(bitmap) - first]
    shared = spark.sparkContext.broadcast(bitmap)
    return cut(corpus.mapInPandas(_maybe(shared, size, bits), corpus.schema))


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, run: int = 80, budget: int = 1) -> DataFrame:
    """doc_id, item_id, errors, run: each document and test item that share a passage with at most `budget` edits.

    errors is the least edit distance of a passage, run the longest exact common run that holds a whole passage (0 if
    none does); every exact common run of at least `run` folded characters is reported with its full length. Texts are
    folded by fold(). Null, empty and letterless texts give no row; items shorter than a passage cannot be found;
    repeated rows repeat nothing if ids are unique. The corpus is read once, whole texts; item sets of more than BLOCK_CHARS
    characters are searched for in blocks, in the documents that a filter over all of them leaves. Empty tables give no row. Other columns are ignored.
    """
    spark = docs.sparkSession
    test = items.select(col(item_id).alias("id"), col(item_text).cast("string").alias("text")).filter("text is not null and id is not null")
    corpus = spread(docs.select(col(doc_id).alias("id"), col(text).cast("string").alias("text")).filter("text is not null"))
    chars = test.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / BLOCK_CHARS))
    kinds = dict(corpus.dtypes)["id"], dict(test.dtypes)["id"]
    if blocks > 1:
        test = cut(test)
        corpus = _left_by_filter(corpus, test, chars, run, budget)
    out = None
    for b in range(blocks):
        # One block at a time: about BLOCK_CHARS characters on the driver and in a worker.
        mine = test.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        shared = spark.sparkContext.broadcast(([r["id"] for r in mine], [r["text"] for r in mine], {}))
        found = corpus.mapInPandas(_search(shared, run, budget), f"doc {kinds[0]}, item {kinds[1]}, errors int, run int")
        if blocks > 1:
            found = cut(found)
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    if blocks > 1:
        release(corpus, test)
    return out.withColumnsRenamed({"doc": doc_id, "item": item_id})
