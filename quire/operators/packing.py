"""Packing of ordered entries into fixed pages: an entry that doesn't fit begins the next page. One longer than a page covers
several, and the next one may begin in the last of them; or, in tables of blocks, it makes a block of its own.

Where an entry lands depends on all before it, but only through one number, the place reached in the page. So each range of
the order computes, in parallel, where it ends for every place it could begin at; places soon run together, so a range is
described by a few runs of beginnings that end alike. Ranges are then chained over these runs, a few numbers each, and packed
in a second parallel pass.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.staging import Staging, globally_ordered

PAGE = 4096


def _page_starts(size: np.ndarray, first: np.ndarray, need: np.ndarray, page: int, header: int, spans: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(bytes before each entry and after all, bytes up to which each needs room, by entry that begins a page the one that begins the next).

    None where that is not all there is to tell: an entry is longer than its page, or needs room beyond what the next one needs.
    """
    upto = np.concatenate(([0], np.cumsum(size)))
    room = upto[:-1] + need
    if (np.diff(room) < 0).any() or (need < 1).any() or (spans and ((size > need).any() or (header + first > page).any())):
        return None
    after = np.searchsorted(room, page - header - first + upto[1:], side="right")
    return upto, room, np.maximum(after, np.arange(1, len(size) + 1))


def _ends(size: np.ndarray, first: np.ndarray, need: np.ndarray, page: int, header: int, spans: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(pages turned, place reached) after the entries, for each place 0..page at which they could begin."""
    if known := _page_starts(size, first, need, page, header, spans):
        upto, room, after = known
        n, at = len(size), np.maximum(np.arange(page + 1), header)  # no entry begins within the header
        begins = np.where(at == header, 0, np.searchsorted(room, page - at, side="right"))
        turned, place = (at > header).astype(np.int64), at + upto[-1]
        some, back = np.unique(begins, return_inverse=True)
        last, more = np.minimum(some, n - 1), np.zeros(len(some), np.int64)
        while (go := after[last] < n).any():
            more += go
            last = np.where(go, after[last], last)
        turned = np.where(begins < n, turned + more[back], 0)
        place = np.where(begins < n, (header + first[last] + upto[-1] - upto[last + 1])[back], place)
        return turned, place if spans else np.minimum(place, page)
    group = np.arange(page + 1)  # the state that each beginning has run into
    place = np.arange(page + 1)
    turned = np.zeros(page + 1, np.int64)
    lead = np.zeros(page + 1, np.int64)  # pages that a beginning is ahead of its state
    for s, f, n in zip(size, first, need, strict=True):
        over = (place > header) & (place + n > page)
        place = np.where(over | (place == header), header + f, place + s)
        # A block that is full or longer turns before the next entry, however long it is.
        place = place if spans else np.minimum(place, page)
        more = np.maximum(place - 1, 0) // page
        turned += over + more
        place -= more * page
        if over.any():
            place, at, inverse = np.unique(place, return_index=True, return_inverse=True)
            lead += turned[group] - turned[at][inverse[group]]
            group, turned = inverse[group], turned[at]
    return turned[group] + lead, place[group]


def pack(df: DataFrame, keys: list, size: str, page: int = PAGE, first_place: int = 0, first_page: int = 0, header: int = 0, first: Column | None = None, need: Column | None = None, spans: bool = True) -> DataFrame:
    """``df`` with page and pos of each row.

    Later pages begin at ``header``. ``first``: the size of a row that begins a page (default: its size); ``need``: the room that has to
    be left for a row to stay in a page (default: its size).
    """
    stage = Staging(df.sparkSession, "pack")
    sized = df.withColumns({"q_size": F.col(size).cast("bigint"), "q_first": (F.col(size) if first is None else first).cast("bigint"), "q_need": (F.col(size) if need is None else need).cast("bigint")})
    rows = globally_ordered(sized, keys, stage)
    sizes = ["q_size", "q_first", "q_need"]

    def ends(key, pdf: pd.DataFrame) -> pd.DataFrame:
        turned, place = _ends(*(pdf.sort_values("place")[c].to_numpy(np.int64) for c in sizes), page, header, spans)
        at = np.flatnonzero(np.concatenate(([True], (np.diff(turned) != 0) | (np.diff(place) != 0))))
        return pd.DataFrame({"part": [key[0]], "since": [at.tolist()], "turned": [turned[at].tolist()], "reached": [place[at].tolist()]})

    slim = rows.select("part", "place", *sizes)
    tables = slim.groupBy("part").applyInPandas(ends, "part bigint, since array<bigint>, turned array<bigint>, reached array<bigint>")
    # One row per range, of a few runs (at most page + 1): their chain is short.
    at_page, at_place, starts = first_page, first_place, []
    for r in sorted(tables.collect(), key=lambda r: r["part"]):
        starts.append((r["part"], at_page, at_place))
        run = int(np.searchsorted(r["since"], at_place, side="right")) - 1
        at_page, at_place = at_page + r["turned"][run], r["reached"][run]
    begin = {p: (a, b) for p, a, b in starts}

    def place_all(key, pdf: pd.DataFrame) -> pd.DataFrame:
        at_page, at_place = begin[key[0]]
        pdf = pdf.sort_values("place")
        size, first, need = (pdf[c].to_numpy(np.int64) for c in sizes)
        if known := _page_starts(size, first, need, page, header, spans):
            upto, room, after = known
            begins = [0 if at_place <= header else int(np.searchsorted(room, page - at_place, side="right"))]
            while begins[-1] < len(size):
                begins.append(int(after[begins[-1]]))
            begins, row = np.array(begins[:-1], np.int64), np.arange(len(size))
            turn = np.searchsorted(begins, row, side="right")  # pages begun up to a row
            since = np.append(begins, 0)[turn - 1] if len(begins) else row
            inside = np.where(turn == 0, at_place + upto[:-1], np.where(row == since, header, header + first[since] + upto[:-1] - upto[np.minimum(since + 1, len(size))]))
            return pd.DataFrame({"part": pdf["part"], "place": pdf["place"], "q_page": at_page + turn - (at_place <= header), "q_pos": inside})
        pages, places = [], []
        for s, f, n in zip(*(pdf[c] for c in sizes), strict=True):
            if at_place > header and at_place + n > page:
                at_page, at_place = at_page + 1, header
            pages.append(at_page)
            places.append(at_place)
            at_place += f if at_place == header else s
            more = max(at_place - 1, 0) // page if spans else 0
            at_page, at_place = at_page + more, at_place - more * page
        return pd.DataFrame({"part": pdf["part"], "place": pdf["place"], "q_page": pages, "q_pos": places})

    placed = slim.groupBy("part").applyInPandas(place_all, "part bigint, place bigint, q_page bigint, q_pos bigint")
    out = rows.join(placed, ["part", "place"]).drop("part", "place", *sizes)
    return out.withColumnsRenamed({"q_page": "page", "q_pos": "pos"})
