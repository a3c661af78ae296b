"""Problem 7: passages of held-out items inside documents.

Every window of 12 words, the size of the smallest passage that counts, of items
and documents gets a 64-bit SimHash. Cut into radius + 1 blocks, two
fingerprints within the radius agree in a block, so equal blocks find all of
them. A matched window is laid over the item: the document's words beside it make
a window of the item's size, and the exact weighted-shingle similarity of the two
windows, and of the two item-sized ones, verifies the candidate. A near copy of a
whole item (five-word shingles, similarity of 0.8 or more) always holds 12 equal
words in a row, as each change within it costs five of its shingles; so the
12-word windows find near copies too. The words themselves decide last.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulate.session import spread

WINDOW = 12
RADIUS = 1
SIMILARITY = 0.8
SHINGLE = 5
FILTER_BITS = 25  # the item blocks go to the tasks as a bit map of this many address bits (4 MB), however many they are
FACTORS = [np.uint64(pow(0x9E3779B97F4A7C15, j + 1, 1 << 64)) for j in range(256)]  # tell word orders apart
CHUNK = 100_000  # words fingerprinted at once

TAG = re.compile(r"<[/!]?[A-Za-z-][^<>]*>")
WORD = re.compile(r"[^\W_]+")
HIDDEN = dict.fromkeys(map(ord, "­​‌‍⁠﻿"))


def words(text: str | None) -> list[str]:
    """Runs of letters or digits, without case, markup, escapes and compatibility forms."""
    if not text:
        return []
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = TAG.sub(" ", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t.translate(HIDDEN))
    return WORD.findall(t.casefold())


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of word hashes: a bit is set if more than half of the words have it."""
    out = []
    kind = np.uint8 if window < 256 else np.int32
    for a in range(0, max(len(hashes) - window + 1, 0), CHUNK):
        part = np.ascontiguousarray(hashes[a : a + CHUNK + window - 1])
        power = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).astype(kind, copy=False)
        # Sums over windows of 1, 2, 4, ... words make up the window.
        sums, at, size, n = None, 0, 1, len(part) - window + 1
        while True:
            if window & size:
                sums = power[at : at + n].copy() if sums is None else sums + power[at : at + n]
                at += size
            size *= 2
            if size > window:
                break
            power = power[: -size // 2] + power[size // 2 :]
        out.append(np.packbits(sums > window // 2, axis=1).view(np.uint64).ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def blocks(prints: np.ndarray, radius: int) -> list[np.ndarray]:
    """radius + 1 keys of a fingerprint: block number and block content."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for i in range(n):
        width = np.uint64(edges[i + 1] - edges[i])
        part = (prints >> np.uint64(64 - edges[i + 1])) & np.uint64((1 << int(width)) - 1) if width < 64 else prints
        keys.append((part * np.uint64(n) + np.uint64(i)) if width < 62 else part)
    return keys


def address(keys: np.ndarray) -> np.ndarray:
    """Place of a block in the bit map."""
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - FILTER_BITS)


def bit_map(blocks_: DataFrame) -> np.ndarray:
    """One bit set for every block; at most 2**FILTER_BITS / 64 words reach the driver, however many blocks there are."""

    def words_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = address(pdf["block"].to_numpy(np.int64).view(np.uint64))
            bits = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
            yield pd.DataFrame({"w": (at >> np.uint64(6)).astype(np.int64), "bits": bits})

    rows = blocks_.select("block").mapInPandas(words_of, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def windows(df: DataFrame, key: str, window: int, radius: int, wanted: Broadcast | None = None) -> DataFrame:
    """key, at (place of its first word), fp, block: a row per window and block; only blocks that the bit map `wanted` may hold if given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[str, int] = {}
        for pdf in batches:
            owner, hashes = [], []
            for k, text in zip(pdf["id"], pdf["text"], strict=True):
                got = words(text)
                if len(got) < window:
                    continue
                if len(cache) > 500_000:
                    cache.clear()
                for w in set(got).difference(cache):
                    cache[w] = xxhash.xxh64_intdigest(w)
                hashes += map(cache.__getitem__, got)
                owner.append((k, len(got)))
            if not owner:
                continue
            sizes = np.array([n for _, n in owner])
            ids = np.repeat(np.array([k for k, _ in owner], np.int64), sizes)
            at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            prints = fingerprints(np.array(hashes, np.uint64), window)
            seen = np.array(hashes, np.uint64)
            inside = at[: len(prints)] + window <= np.repeat(sizes, sizes)[: len(prints)]
            first = np.flatnonzero(inside)
            ids, at, prints = ids[first], at[first], prints[first]
            for keys in blocks(prints, radius):
                keep = slice(None)
                if wanted is not None:
                    a = address(keys)
                    keep = (wanted.value[a >> np.uint64(6)] >> (a & np.uint64(63))) & np.uint64(1) != 0
                # Repeats of a window (the same words in the same order) are passed on once a document.
                same = np.zeros(len(first[keep]), np.uint64)
                for j in range(window):
                    same += seen[first[keep] + j] * FACTORS[j % len(FACTORS)]
                out = pd.DataFrame({"id": ids[keep], "at": at[keep], "fp": prints[keep].view(np.int64), "block": keys[keep].view(np.int64), "same": same})
                yield out.drop_duplicates(["id", "fp", "block", "same"]).drop(columns="same")

    return spread(df.select(F.col(key).alias("id"), "text").where("id is not null and text is not null")).mapInPandas(run, "id long, at long, fp long, block long")


def candidates(docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, matches (array of doc_at, item_at): documents with a window whose fingerprint differs from one of the item in at most `radius` bits.

    Of the windows that lie alike (the same distance between document and item place) the first is kept.
    """
    mine = windows(items, "item_id", window, radius)
    wanted = docs.sparkSession.sparkContext.broadcast(bit_map(mine))
    theirs = windows(docs, "doc_id", window, radius, wanted)
    return (
        theirs.select(F.col("id").alias("doc_id"), F.col("at").alias("doc_at"), F.col("fp").alias("a"), "block")
        .join(mine.select(F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("fp").alias("b"), "block"), "block")
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
        .groupBy("doc_id", "item_id", (F.col("doc_at") - F.col("item_at")).alias("shift")).agg(F.min(F.struct("item_at", "doc_at")).alias("m"))
        .groupBy("doc_id", "item_id").agg(F.collect_list("m").alias("matches"))
    )


def similarity(a: list[str], b: list[str], n: int = SHINGLE) -> float:
    """Weighted Jaccard similarity of the n-word shingles, a shingle's weight being its count."""
    x = Counter(tuple(a[i : i + n]) for i in range(max(1, len(a) - n + 1)))
    y = Counter(tuple(b[i : i + n]) for i in range(max(1, len(b) - n + 1)))
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def passages(doc: list[str], item: list[str], window: int = WINDOW) -> int:
    """Words of `item` in runs of at least `window` words that occur in `doc` in the same order."""
    there = {tuple(doc[i : i + window]) for i in range(len(doc) - window + 1)}
    covered = np.zeros(len(item), bool)
    for i in range(len(item) - window + 1):
        if tuple(item[i : i + window]) in there:
            covered[i : i + window] = True
    return int(covered.sum())


def verified(doc: list[str], item: list[str], matches: list[tuple[int, int]], window: int = WINDOW) -> float | None:
    """Largest similarity of an item-sized window of the document, laid by a matched window, to the item; None if no matched window is similar.

    `matches` are (item_at, doc_at). A matched window counts if its own weighted shingles are SIMILARITY alike.
    """
    best = None
    for item_at, doc_at in matches:
        if similarity(doc[doc_at : doc_at + window], item[item_at : item_at + window]) < SIMILARITY:
            continue
        start = max(0, doc_at - item_at)
        s = similarity(doc[start : doc_at - item_at + len(item)], item)
        best = s if best is None else max(best, s)
    return best


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, leaked (words of the item in the document), share of the item, similarity (of the item and the window of its size).

    A candidate must have a matched window of similar shingles, then equal words in a run of `window`. NULL, empty
    and shorter texts leak nothing, rows without an id are left out. Repeated rows of a doc_id count
    once. Texts are read whole, whatever their length.
    """
    pairs = candidates(docs, items, window, radius)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for d, i, t, u, matches in zip(pdf["doc_id"], pdf["item_id"], pdf["text"], pdf["item"], pdf["matches"], strict=True):
                doc, item = words(t), words(u)
                alike = verified(doc, item, [(m["item_at"], m["doc_at"]) for m in matches], window)
                if alike is not None and (n := passages(doc, item, window)):
                    rows.append((d, i, n, n / len(item), alike))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "leaked", "share", "similarity"])

    texts = docs.select("doc_id", "text").join(pairs, "doc_id")
    return (
        texts.join(items.select("item_id", F.col("text").alias("item")), "item_id")
        .select("doc_id", "item_id", "text", "item", "matches")
        .mapInPandas(verify, "doc_id long, item_id long, leaked int, share double, similarity double")
        .groupBy("doc_id", "item_id").agg(F.max("leaked").alias("leaked"), F.round(F.max("share"), 6).alias("share"), F.round(F.max("similarity"), 6).alias("similarity"))
    )


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: the document holds at least 12 consecutive words of the item."""
    return leaks(docs, items).select("doc_id", "item_id")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per leaked item: split, kind, documents it is in, those that hold a near copy of the whole item, largest share found in one."""
    return leaks(docs, items).groupBy("item_id").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("similarity") >= SIMILARITY).alias("near_copies"), F.max("share").alias("largest_share")
    ).join(items.select("item_id", "split", "kind"), "item_id")
