"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut
from .textkit import DIGIT, LETTER, LOWER, U, chunks, combined, cores, counted, mixed, slices, windows, word_hashes

WINDOW, SHARE, LITERALS = 5, 0.8, 3
#: Items without a window are looked up word for word from so many words on; one or two words are no copy of anything.
SHORTEST = 3
#: Units that become a placeholder behind a number. Fixed values.
UNITS = (
    "mm cm dm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t lb lbs oz ounce ounces gram grams pound pounds ton tons "
    "ml cl l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees kmh mph w kw kwh v a hz khz mhz ghz kb mb gb tb byte bytes meter meters metre metres"
).split()
#: Placeholders by type: number, quantity with a unit, unit, name.
NUMBER, QUANTITY, UNIT, NAME = (U(k) for k in (11, 12, 13, 14))
#: Window hashes of a benchmark up to which documents are filtered by them before the join.
MOST_FILTER = 4_000_000
ROWS = "h bigint, id bigint, pos int, slots array<bigint>"


def canonical(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, template, slots): per word its lower-cased hash or placeholder, and the slot's value (0 for a literal).

    Punctuation around words is dropped, as are words without letters or digits. A number has digits and no letters; a
    quantity starts with a digit and has letters; a unit follows a number; any capitalised word counts as a name, so that
    names match at the beginning of a sentence too: whether such a word is one is left to the slots. A word's form depends
    on itself and the word before it only, wherever a long text is cut.
    """
    units = np.sort(word_hashes([" ".join(UNITS)], LOWER)[1])
    counts, found, before = np.zeros(len(texts) + 1, np.int64), [], (-1, False)
    for words in chunks(texts, LOWER):
        which, start, end = cores(words)
        row, data = words.row[which], words.data
        counts[1:] += np.bincount(row, minlength=len(texts))
        if not len(which):
            continue
        value = words.hashes(start, end)
        digits, letters = counted(DIGIT[data]), counted(LETTER[data])
        digit, letter = digits[end] > digits[start], letters[end] > letters[start]
        first, second = data[start], data[np.minimum(start + 1, end - 1)]
        number = digit & ~letter
        follows = np.concatenate(([row[0] == before[0] and before[1]], (row[1:] == row[:-1]) & number[:-1]))
        unit = follows & np.isin(value, units)
        name = (first >= 65) & (first <= 90) & ~((second >= 65) & (second <= 90))
        before = (row[-1], number[-1])
        template = value.copy()
        for mask, mark in ((name, NAME), (unit, UNIT), (digit & letter & DIGIT[first], QUANTITY), (number, NUMBER)):
            template[mask] = mark
        found.append((template, np.where(template == value, U(0), value)))
    both = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.uint64)] * 2
    return np.cumsum(counts), *both


def _whole(values: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n values in a row, for any n: by halves that may overlap."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    width = 1
    while 2 * width <= n:
        values, width = combined(values[:-width], values[width:]), 2 * width
    if width < n:
        values = combined(values[: width - n], values[n - width :])
    return mixed(values + U(n))


def _windows(id_column: str, window: int, literals: int, wanted: np.ndarray | None, lengths: list[int] | None = None):
    """h, id, pos, slots of each template window with enough literal words (and, given ``wanted``, a hash among them).

    Items (no ``lengths``) without such a window are one row of all their words as they are: pos -1, slots their number.
    Documents have such rows for their words at each place and of each of ``lengths``.
    """
    table = None
    if wanted is not None:
        table = np.zeros(1 << 22, bool)
        table[wanted & ((1 << 22) - 1)] = True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in slices(batches):
            at, template, slots = canonical(rows["text"])
            ids, every = rows[id_column].to_numpy(np.int64), windows(template, window)
            start = np.arange(len(every))
            row = np.searchsorted(at, start, "right") - 1
            literal = counted(slots == 0)
            good = (start + window <= at[row + 1]) & (literal[start + window] - literal[start] >= literals)
            own = np.where(slots == 0, template, slots)
            if lengths is None:
                short = np.flatnonzero(np.isin(np.arange(len(rows)), row[good], invert=True) & (np.diff(at) >= SHORTEST))
                for k in short:
                    n = int(at[k + 1] - at[k])
                    yield pd.DataFrame({"h": _whole(own[at[k] : at[k + 1]], n).view(np.int64), "id": ids[[k]], "pos": np.full(1, -1, np.int32), "slots": [[n]]})
            for n in lengths or []:
                whole = _whole(own, n)
                first = np.arange(len(whole))
                of = np.searchsorted(at, first, "right") - 1
                fits = first + n <= at[of + 1]
                if table is not None:
                    fits &= table[whole.view(np.int64) & ((1 << 22) - 1)]
                first = first[fits]
                if table is not None:
                    first = first[np.isin(whole[first].view(np.int64), wanted)]
                if len(first):
                    yield pd.DataFrame({"h": whole[first].view(np.int64), "id": ids[of[first]], "pos": np.full(len(first), -1, np.int32), "slots": [[n]] * len(first)})
            if table is not None:
                good &= table[every.view(np.int64) & ((1 << 22) - 1)]
            start = start[good]
            if table is not None:
                start = start[np.isin(every[start].view(np.int64), wanted)]
            if len(start):
                values = slots[start[:, None] + np.arange(window)].view(np.int64)
                yield pd.DataFrame({"h": every[start].view(np.int64), "id": ids[row[start]], "pos": (start - at[row[start]]).astype(np.int32), "slots": list(values)})

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, literals: int = LITERALS) -> DataFrame:
    """(doc_id, item_id, coverage): documents that hold an item, word for word or with other numbers, names and units.

    docs: doc_id, text. benchmark: item_id, text. Both become template words; an item is held if at least ``share`` of its
    distinct windows of ``window`` template words, ``literals`` of them literal at least, are in the document on consistent
    diagonals (place in document minus place in item): those on which each slot value of the item stands for one value of the
    document only. A row of an item without such windows is held as a whole, its words in a row as they are but for case and
    punctuation, if it has SHORTEST words at least. Shorter ones, null texts and null ids match nothing; rows of one id are
    matched together, of which one held as a whole suffices; repeated benchmark rows and other columns change nothing; empty
    tables give no rows.
    """
    items = benchmark.filter("item_id is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    known = cut(items.mapInPandas(_windows("item_id", window, literals, None), ROWS))
    hashes = known.select("h").distinct()
    wanted = None
    if hashes.limit(MOST_FILTER + 1).count() <= MOST_FILTER:
        wanted = np.sort(hashes.toPandas()["h"].to_numpy(np.int64))
    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    lengths = sorted(r["n"] for r in known.filter("pos < 0").select(F.get("slots", F.lit(0)).alias("n")).distinct().collect())
    seen = rows.mapInPandas(_windows("doc_id", window, literals, wanted, lengths), ROWS)
    need = known.filter("pos >= 0").groupBy("id").agg(F.countDistinct("h").alias("need"))
    mine = known.select("h", F.col("id").alias("item_id"), F.col("pos").alias("at"), F.col("slots").alias("own"))
    hits = seen.withColumnRenamed("id", "doc_id").join(bounded(mine, 100_000), "h")
    if lengths:
        hits = cut(hits)
        whole = hits.filter("at < 0").select("doc_id", "item_id", F.lit(1.0).alias("coverage")).distinct()
        hits = hits.filter("at >= 0")
    pairs = F.filter(F.arrays_zip("own", "slots"), lambda s: s["own"] != 0)
    diagonal = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("h").alias("hs"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("slots")
    )
    consistent = F.size(F.array_distinct(F.transform("slots", lambda s: s["own"]))) == F.size("slots")
    have = diagonal.filter(consistent).groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_set("hs")))).alias("have"))
    out = have.join(bounded(cut(need), 100_000).withColumnRenamed("id", "item_id"), "item_id")
    out = out.withColumn("coverage", F.col("have") / F.col("need")).filter(F.col("have") >= F.col("need") * F.lit(share) - 1e-9).select("doc_id", "item_id", "coverage")
    return out.unionByName(whole).groupBy("doc_id", "item_id").agg(F.max("coverage").alias("coverage")) if lengths else out


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_id, coverage: for each document the items it holds and the best covered one.

    One row for each row of docs; ties go to the least item_id; without items n_items and coverage are 0, item_id null.
    """
    found = leaks(docs, benchmark, **options).groupBy("doc_id").agg(F.count("*").alias("n_items"), F.max(F.struct("coverage", -F.col("item_id"))).alias("best"))
    found = cut(found.select(F.col("doc_id").alias("of"), "n_items", F.col("best.coverage").alias("coverage"), (-F.col("best.col2")).alias("item_id")))
    out = docs.select("doc_id").join(bounded(found), F.col("doc_id") == F.col("of"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their own columns, that hold no item."""
    gone = cut(leaks(docs, benchmark, **options).select(F.col("doc_id").alias("gone_id")).distinct())
    return docs.join(bounded(gone), docs["doc_id"] == gone["gone_id"], "left_anti")
