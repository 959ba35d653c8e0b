"""Duplicate passages by hashes of word windows.

A word goes if a window of WINDOW words over it starts earlier elsewhere. This replaces a relative Lempel-Ziv parsing: no
longest match is extended and no factor boundary is checked, as the answer is a union of windows of one length, which hashes
decide one by one. Only windows whose anchor (minimiser) is shared are hashed for the search. Each block of documents gives
the earliest of each of its windows, and its later ones at once; the earliest of all blocks meet by hash. A factor here is a
run of neighbouring starts of such later windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import EXACT, combined, slices, windows, word_hashes

WINDOW, GRAM = 20, 6


def anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of words its anchor, the least hash of a gram in it: equal windows have equal anchors."""
    least, width, most = windows(hashes, gram), 1, window - gram + 1
    while width < most:
        step = min(width, most - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


def _index(window: int, gram: int):
    """anchor, lead, members, repeats: each block of documents' anchors, once each, with the documents that have it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            at, hashes = word_hashes(rows["text"], EXACT)
            ids, found = rows["doc_id"].to_numpy(np.int64), []
            for k in range(len(rows)):
                own = hashes[at[k] : at[k + 1]]
                if len(own) < window:
                    continue
                anchor, whole = anchors(own, window, gram), windows(own, window)
                changes = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                value = np.unique(anchor[changes])
                order = np.argsort(whole, kind="stable")
                again = order[1:][whole[order][1:] == whole[order][:-1]]
                found.append((value, np.full(len(value), ids[k]), np.isin(value, anchor[again])))
            if not found:
                continue
            value, doc, again = map(np.concatenate, zip(*found))
            order = np.lexsort((doc, value))
            value, doc, again = value[order], doc[order], again[order]
            first = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
            ends = np.append(first[1:], len(value))
            members = np.full(len(first), None, object)
            for i in np.flatnonzero(ends - first > 1):
                members[i] = np.unique(doc[first[i] + 1 : ends[i]])
            yield pd.DataFrame({"anchor": value[first].view(np.int64), "lead": doc[first], "members": members, "repeats": np.logical_or.reduceat(again, first)})

    return run


def _candidates(window: int, gram: int):
    """key, doc_id, start, run: windows with a shared anchor, the earliest of each block (run 0); factors of later ones."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            at, hashes = word_hashes(rows["text"], EXACT)
            ids, found = rows["doc_id"].fillna(0).to_numpy(np.int64), []
            for k, shared in enumerate(rows["anchors"]):
                own = hashes[at[k] : at[k + 1]]
                if len(own) >= window and shared is not None:
                    start = np.flatnonzero(np.isin(anchors(own, window, gram).view(np.int64), shared))
                    found.append((windows(own, window)[start], np.full(len(start), ids[k]), start))
            if not found:
                continue
            key, doc, start = map(np.concatenate, zip(*found))
            order = np.lexsort((start, doc, key))
            key, doc, start = key[order], doc[order], start[order]
            first = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
            # a repeated row is no earlier occurrence
            same = np.zeros(len(key), bool)
            same[1:] = ~first[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
            lead = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            later = ~first & ~((doc == doc[lead]) & (start == start[lead])) & ~same
            led = np.flatnonzero(first)[np.argsort(order[first])]  # in the order of the texts, in which places compress well
            yield pd.DataFrame({"key": key[led].view(np.int64), "doc_id": doc[led], "start": start[led], "run": 0})
            doc, start = doc[later], start[later]
            order = np.lexsort((start, doc))
            doc, start = doc[order], start[order]
            if len(doc):
                begin = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1))))
                length = np.diff(np.append(begin, len(doc)))
                key = combined(doc[begin].view(np.uint64), start[begin].view(np.uint64))
                yield pd.DataFrame({"key": key.view(np.int64), "doc_id": doc[begin], "start": start[begin], "run": length})

    return run


def factors(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, start, run): runs of window starts, in words, whose windows occur earlier; for docs (doc_id, text)."""
    ids = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    rows = ids.filter("doc_id is not null").mapInPandas(_index(window, gram), "anchor bigint, lead bigint, members array<bigint>, repeats boolean")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("anchor"))).filter("n > 1 or repeats or members is not null")
    own = rows.select("anchor", F.explode(F.concat(F.array("lead"), F.coalesce("members", F.array().cast("array<bigint>")))).alias("doc_id"))
    own = own.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    # a left join over the same columns as the last one, so that one shuffle of the texts serves both
    found = ids.join(own, "doc_id", "left").mapInPandas(_candidates(window, gram), "key bigint, doc_id bigint, start bigint, run bigint")
    place = F.struct("doc_id", "start")
    earliest = F.min(F.when(F.col("run") == 0, place)).over(Window.partitionBy("key"))
    found = found.withColumn("earliest", earliest).filter((F.col("run") > 0) | (place > F.col("earliest")))
    return found.select("doc_id", "start", F.greatest("run", F.lit(1)).alias("run"))


def covered(n_words: int, starts: np.ndarray, runs: np.ndarray, window: int) -> np.ndarray:
    """Which words the windows of all runs cover."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + runs + window - 1, n_words), -1)
    return np.cumsum(change[:-1]) > 0


def _kept(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            out = []
            for doc, text, own in zip(rows["doc_id"], rows["text"], rows["factors"]):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone, spans = 0, []
                if own is not None and len(own):
                    start, length = (np.array([x[k] for x in own], np.int64) for k in ("start", "run"))
                    hit = covered(len(words), start, length, window)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                    spans = [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]
                    gone = int(hit.sum())
                    words = [w for w, h in zip(words, hit.tolist()) if not h]
                out.append((doc, len(words) + gone, gone, spans, b" ".join(words).decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "spans", "kept_text"])

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans, kept_text: one row for each document of docs (doc_id, text).

    Each word that a window of ``window`` words covers whose words also start earlier (smaller doc_id, or earlier in the
    same document) is removed; kept words are joined by one space, spans are the removed word ranges. Windows are judged
    on the input. Null texts have no words. Rows of one doc_id at one position are the same place, so a repeated row is
    no earlier occurrence of itself; a null doc_id is neither searched nor removed from. No rows for an empty table.
    """
    if not 0 < gram <= window:
        raise ValueError("gram must be from 1 to window")
    found = factors(docs, window, gram).groupBy("doc_id").agg(F.collect_list(F.struct("start", "run")).alias("factors"))
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_text string"
    return base.join(found, "doc_id", "left").mapInPandas(_kept(window), schema)
