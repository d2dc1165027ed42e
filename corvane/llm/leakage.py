"""Held-out passages in a corpus, by a distributed positional inverted index.

1. Index: the corpus is cut into shards of ``SHARD`` documents; each shard stores, for every term (a 64-bit hash of a word),
   the documents and positions where it stands, whatever will be searched for. One map over the texts, no shuffle: the index
   is kept in the shared folder and serves any number of held-out sets (``build``, then ``leaks`` or ``phrases``).
2. Rarity: document frequency of every held-out term, over all shards (one map-side combined count).
3. Lookup: of every window of ``least`` item words, its rarest positions are looked up in every shard; all but the allowed
   edits of them survive in a leaked passage. Their posting lists are intersected after subtracting the offset in the item.
   A passage of twice ``least`` words or more can be halved, and one half has no more edits for its length than the whole.
   So some passage is shorter, and its windows have at most ``most_edits`` edits: 4 for 24 words and one in ten.
4. Match: around each agreeing offset the item and the document's positions are aligned; a pair is reported if at least
   ``least`` consecutive item words are there with at most one in ``one_in`` changed, added or dropped (a proximity match), and
   marked ``exact`` if ``least`` of them stand there as they are (a phrase match).

A sentence that ``STOCK_ITEMS`` or more items share word for word is a stock instruction and matches nothing.

Cases: null and empty texts have no words; an item of fewer than ``least`` own words never matches; repeated documents are
reported each; repeated item ids with one text count once; case, punctuation, spacing, line breaks and prefixes, markup,
entities and escapes are no words. Words dropped at the ends of a passage count as edits like those within it. Very long texts
are handled whole, in a shard of their own. Columns beside id and text are ignored. Two words with one hash would be taken for
one: expected once in 10^19 pairs of words.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import Stored

LEAST, ONE_IN = 24, 10
SEEDS_PER_WINDOW = 10
STOCK_ITEMS = 3
WIDTH = 8  # of a cell of offsets; inside one passage the allowed edits move an offset by no more than half of it
MOST_ITEM_BYTES = 64 << 20  # the held-out set is gathered on the driver and sent to every task; larger ones are to be given in parts
SHARD, SHARD_WORDS = 512, 400_000  # documents and words of a shard at most; a longer document is a shard of its own
GROUP = 4  # shards of a row group of the stored index: what a task holds of it at once, however many shards it reads
MOST_POSTINGS = 1 << 19  # looked up at once in a shard; items with more are gone through in turns
STOCK = -1  # in place of words of stock instructions

TAG = re.compile(r"</?[A-Za-z][^<>]{0,300}>|<!--.*?-->", re.DOTALL)
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
BREAKS = re.compile(r"\\[nrtvfb]")
HIDDEN = re.compile(r"[­​-‏⁠﻿᠎]")
HYPHENS = re.compile(r"[‐-―−﹘﹣-]")
WRAPPED = re.compile(r"(?<=[a-z])-\r?\n[ \t]*(?=[a-z])")
PERCENT = re.compile(r"%20|\+(?=[A-Za-z])")
NUMBERED = re.compile(r"^[ \t]*(?:\d{1,5}[ \t]*[.:|)\]][ \t]|(?:[>|#*+;%/\-]+[ \t]*)+)", re.MULTILINE)
SENTENCE = re.compile(r"(?<=[.!?])\s+")
WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")


def most_edits(least: int = LEAST, one_in: int = ONE_IN) -> int:
    """The most edits of a passage that cannot be halved."""
    return (2 * least - 1) // one_in


def words(text: str | None) -> list[str]:
    """The words of a text as they count for a match."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text:
        text = TAG.sub(lambda m: " " if m[0][1:2] in "pPdDbBlLtThH/" and len(m[0]) > 4 else "", text)
    if "\\" in text:
        text = BREAKS.sub(" ", ESCAPED.sub(lambda m: chr(int(m[1], 16)), text))
    text = HYPHENS.sub("-", HIDDEN.sub("", unicodedata.normalize("NFKC", text)))
    text = NUMBERED.sub("", text)
    return WORD.findall(text.casefold())


def item_words(items: dict[int, str]) -> dict[int, list[str | None]]:
    """The words of the items; those of stock instructions are None."""
    sentences = {i: [tuple(words(part)) for part in SENTENCE.split(t)] for i, t in items.items()}
    holders: dict[tuple, set] = defaultdict(set)
    for parts in sentences.values():
        whole = tuple(w for p in parts for w in p)
        for part in parts:
            holders[part].add(whole)
    return {i: [w if len(holders[p]) < STOCK_ITEMS else None for p in parts for w in p] for i, parts in sentences.items()}


@lru_cache(maxsize=500_000)
def term(word: str) -> int:
    """A word as a number; never ``STOCK``."""
    value = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    return value if value != STOCK else 0


INDEX = "docs array<bigint>, terms array<bigint>, starts array<int>, holders array<int>, positions array<int>"


def build(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: a row per shard with docs (ids), terms (ascending), starts (of their postings), holders (places in docs), positions."""
    schema = pa.schema([("docs", pa.list_(pa.int64())), ("terms", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("holders", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32()))])

    def shard(ids: list[int], found: list[np.ndarray]) -> pa.RecordBatch:
        lengths = [len(f) for f in found]
        every = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
        holders = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)
        positions = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        order = np.argsort(every, kind="stable")
        terms, starts = np.unique(every[order], return_index=True)
        columns = (ids, terms, starts, holders[order], positions[order])
        return pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, found, held = [], [], 0
        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.array([term(w) for w in words(body.as_py())], dtype=np.int64)
                if not len(own):
                    continue
                if ids and (held + len(own) > SHARD_WORDS or len(ids) >= SHARD):
                    yield shard(ids, found)
                    ids, found, held = [], [], 0
                ids.append(key)
                found.append(own)
                held += len(own)
        if ids:
            yield shard(ids, found)

    known = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull())
    return known.select(F.col(doc_id).cast("bigint"), text).mapInArrow(run, INDEX)


def stored(documents: DataFrame) -> DataFrame:
    """The index of documents with doc_id and text, written to the shared folder and read back."""
    return Stored(documents.sparkSession).table(build(documents), group_rows=GROUP)[0]


class Shard:
    """A row of the index: posting lists by term, and documents read back in order where a match is to be decided."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        take = lambda name: batch.column(batch.schema.get_field_index(name))[row].values.to_numpy(zero_copy_only=False)
        self.docs, self.terms, starts, self.holders, self.positions = (take(n) for n in ("docs", "terms", "starts", "holders", "positions"))
        self.starts = np.append(starts, len(self.positions)).astype(np.int64)
        self.sequence: np.ndarray | None = None

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first posting, number of postings) of each term."""
        if not len(self.terms):
            return np.zeros(len(terms), dtype=np.int64), np.zeros(len(terms), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        there = self.terms[at] == terms
        return self.starts[at], np.where(there, self.starts[at + 1] - self.starts[at], 0)

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of the terms, the place of the posting) of all postings of the terms."""
        first, size = self.places(terms)
        which = np.repeat(np.arange(len(terms)), size)
        return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)

    def document(self, holder: int) -> np.ndarray:
        """The terms of a document in order."""
        if self.sequence is None:
            term_of = np.repeat(self.terms, np.diff(self.starts))
            order = np.lexsort((self.positions, self.holders))
            self.sequence = term_of[order]
            self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.holders, minlength=len(self.docs)))])
        return self.sequence[self.bounds[holder] : self.bounds[holder + 1]]


def frequencies(index: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """In how many documents each term stands."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                own = Shard(batch, row)
                which, at = own.postings(terms)
                held = np.unique(which * len(own.docs) + own.holders[at])
                total += np.bincount(held // max(1, len(own.docs)), minlength=len(terms))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms[seen]), pa.array(total[seen])], schema=schema)

    return dict(index.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())  # at most a row per held-out term


def lookup_rows(own: dict[int, list[int]], frequency: dict[int, int], least: int, one_in: int = ONE_IN) -> list[tuple[int, int, int]]:
    """(term, item, offset) to look up: the rarest positions of every window; words of stock instructions count as edits."""
    rows = set()
    most = most_edits(least, one_in)
    for item, terms in own.items():
        for start in range(len(terms) - least + 1):
            window = terms[start : start + least]
            there = [k for k in range(least) if window[k] != STOCK]
            if len(there) < least - most:
                continue
            rare = sorted(there, key=lambda k: (frequency.get(window[k], 0), window[k], k))[:SEEDS_PER_WINDOW]
            rows.update((window[k], item, start + k) for k in rare)
    return sorted(rows)


def passage(item: np.ndarray, doc: np.ndarray, least: int = LEAST, one_in: int = ONE_IN) -> bool:
    """Whether ``least`` or more consecutive item words stand in doc with at most one in ``one_in`` edited. ``STOCK`` matches nothing.

    Exact: row by row and for each number of edits up to ``most_edits``, the most item words of an alignment that ends here.
    """
    n, m = len(item), len(doc)
    most = most_edits(least, one_in)
    need = np.maximum(least, one_in * np.arange(most + 1))
    if n < least or m < least - most:
        return False
    longest = np.zeros((most + 1, m + 1), dtype=np.int32)
    for word in item:
        same = doc == word if word != STOCK else np.zeros(m, dtype=bool)
        row = np.zeros_like(longest)
        row[:, 1:] = np.where(same, longest[:, :-1] + 1, 0)
        # an item word changed or dropped
        np.maximum(row[1:, 1:], longest[:-1, :-1] + 1, out=row[1:, 1:])
        np.maximum(row[1:], longest[:-1] + 1, out=row[1:])
        # a word added: one edit fewer before it, in the same row
        for edits in range(1, most + 1):
            np.maximum(row[edits, 1:], row[edits - 1, :-1], out=row[edits, 1:])
        if (row.max(axis=1) >= need).any():
            return True
        longest = row
    return False


class Wanted(NamedTuple):
    """A held-out set: the terms of every item, and the lookups (term, item's place, offset), ascending by term."""

    ids: list[int]
    items: list[np.ndarray]
    terms: np.ndarray
    owners: np.ndarray
    offsets: np.ndarray


def wanted(index: DataFrame, items: DataFrame, least: int, one_in: int) -> Wanted | None:
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > MOST_ITEM_BYTES:
        raise ValueError(f"the held-out set has {size} bytes; give it in parts of at most {MOST_ITEM_BYTES}")
    own = {i: [STOCK if w is None else term(w) for w in ws] for i, ws in item_words({r["item_id"]: r["text"] for r in items.select("item_id", "text").where("item_id is not null and text is not null").collect()}).items()}
    own = {i: ts for i, ts in own.items() if len(ts) >= least}
    if not own:
        return None
    vocabulary = np.array(sorted({t for ts in own.values() for t in ts} - {STOCK}), dtype=np.int64)
    rows = lookup_rows(own, frequencies(index, vocabulary), least, one_in)
    ids = sorted(own)
    place = {i: k for k, i in enumerate(ids)}
    columns = [np.array(c, dtype=np.int64) for c in zip(*[(t, place[i], o) for t, i, o in rows])] or [np.zeros(0, dtype=np.int64)] * 3
    return Wanted(ids, [np.array(own[i], dtype=np.int64) for i in ids], *columns)


def leaks(index: DataFrame, items: DataFrame, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, item_id, exact): the document holds a passage of the item."""
    spark = index.sparkSession
    most = most_edits(least, one_in)
    if most > WIDTH // 2 or SEEDS_PER_WINDOW <= most:
        raise ValueError(f"{most} edits in a passage are more than cells of {WIDTH} offsets and {SEEDS_PER_WINDOW} lookups a window allow")
    held_out = wanted(index, items, least, one_in)
    form = "doc_id bigint, item_id bigint, exact boolean"
    if held_out is None:
        return spark.createDataFrame([], form)
    shared = spark.sparkContext.broadcast(held_out)  # bounded by MOST_ITEM_BYTES
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("exact", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                own = Shard(batch, row)
                rows = []
                for holder, item, ranges in (c for part in turns(own, asked) for c in candidates(own, part, SEEDS_PER_WINDOW - most, least)):
                    doc, words_ = own.document(holder), asked.items[item]
                    starts = [s for s in ranges if promising(words_, doc, s, least, one_in)]
                    slack = len(words_) // one_in + WIDTH
                    parts = list(regions(sorted((s - slack, s + len(words_) + slack) for s in starts), doc))
                    if any(passage(words_, part, least, one_in) for part in parts):
                        rows.append((own.docs[holder], asked.ids[item], any(phrase(words_, part, least) for part in parts)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return index.mapInArrow(run, form)


def turns(own: Shard, asked: Wanted) -> Iterator[Wanted]:
    """The lookups in parts of whole items that have about ``MOST_POSTINGS`` postings in a shard at most, or one item each."""
    held = np.bincount(asked.owners, own.places(asked.terms)[1], len(asked.ids)).cumsum()
    if not len(held) or held[-1] <= MOST_POSTINGS:
        yield asked
        return
    turn = ((held - 1) // MOST_POSTINGS)[asked.owners]
    order = np.argsort(turn, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(turn[order])) + 1):
        yield asked._replace(terms=asked.terms[rows], owners=asked.owners[rows], offsets=asked.offsets[rows])


def candidates(own: Shard, asked: Wanted, enough: int, least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(document, item, first offsets of cells) where that many looked-up positions of one window of the item agree on an offset."""
    which, at = own.postings(asked.terms)
    if not len(which):
        return
    diagonal = own.positions[at].astype(np.int64) - asked.offsets[which]
    # two overlapping rasters: offsets within half a width of one another share a cell of one of them
    cells = np.concatenate([diagonal // WIDTH * 2, (diagonal + WIDTH // 2) // WIDTH * 2 + 1])
    pair = own.holders[at].astype(np.int64) * len(asked.ids) + asked.owners[which]
    low = int(cells.min())
    span = int(cells.max()) - low + 1
    longest = int(asked.offsets.max())
    names = None
    if len(own.docs) * len(asked.ids) * span * (longest + 1) >= 1 << 62:  # numbers in place of pairs keep the keys within 63 bits
        names, pair = np.unique(pair, return_inverse=True)
    key = np.concatenate([pair, pair]) * span + (cells - low)
    # as many different offsets as are needed, all within one window: places in the item that far apart in the sorted list
    key, offset = np.divmod(np.unique(key * (longest + 1) + np.concatenate([asked.offsets[which]] * 2)), longest + 1)
    first, last = np.arange(len(key) - enough + 1), np.arange(enough - 1, len(key))
    good = (key[first] == key[last]) & (offset[last] - offset[first] < least) if len(first) else np.zeros(0, dtype=bool)
    chosen = np.unique(key[first[good]])
    starts: dict[int, list[int]] = defaultdict(list)
    for k in chosen.tolist():
        cell = k % span + low
        starts[k // span if names is None else int(names[k // span])].append(cell // 2 * WIDTH - (WIDTH // 2 if cell % 2 else 0))
    for k, offsets in starts.items():
        yield k // len(asked.ids), k % len(asked.ids), offsets


def promising(item: np.ndarray, doc: np.ndarray, start: int, least: int, one_in: int) -> bool:
    """Whether enough words of some window stand where the cell of offsets has them: a bound that no passage falls below."""
    low, width, n = start - WIDTH // 2, 2 * WIDTH, len(item)
    near = np.full(n + width - 1, STOCK, dtype=np.int64)
    a, b = max(0, low), min(len(doc), low + len(near))
    if b <= a:
        return False
    near[a - low : b - low] = doc[a:b]
    rows = np.lib.stride_tricks.as_strided(near, (n, width), near.strides * 2, writeable=False)
    there = (rows == item[:, None]).any(axis=1) & (item != STOCK)
    sums = np.concatenate([[0], np.cumsum(there)])
    return bool((sums[least:] - sums[:-least]).max(initial=0) >= least - most_edits(least, one_in))


def phrase(item: np.ndarray, doc: np.ndarray, least: int) -> bool:
    """Whether ``least`` consecutive item words stand in doc as they are."""
    run = np.zeros(len(doc) + 1, dtype=np.int32)
    for word in item:
        run[1:] = np.where((doc == word) & (word != STOCK), run[:-1] + 1, 0)
        if run.max() >= least:
            return True
    return False


def regions(ranges: list[tuple[int, int]], doc: np.ndarray) -> Iterator[np.ndarray]:
    """The document's terms in the merged ranges of positions."""
    merged: list[list[int]] = []
    for low, high in ranges:
        if merged and low <= merged[-1][1]:
            merged[-1][1] = max(high, merged[-1][1])
        else:
            merged.append([low, high])
    for low, high in merged:
        if high > 0 and low < len(doc):
            yield doc[max(0, low) : high]


def phrases(index: DataFrame, texts: list[str], within: int = 0) -> DataFrame:
    """(phrase, doc_id, position): where all words of a text stand in order, with up to ``within`` other words between two of them.

    Exact phrases with ``within = 0``, proximity matches else; ``position`` is that of the first word. Posting lists are
    intersected from word to word, in every shard.
    """
    asked = [(k, np.array([term(w) for w in words(t)], dtype=np.int64)) for k, t in enumerate(texts)]
    schema = pa.schema([("phrase", pa.int32()), ("doc_id", pa.int64()), ("position", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                own = Shard(batch, row)
                for k, terms in asked:
                    if not len(terms):
                        continue
                    span = int(own.positions.max(initial=0)) + within + 3
                    lists = []
                    for t in terms:
                        _, at = own.postings(np.array([t]))
                        lists.append(own.holders[at].astype(np.int64) * span + own.positions[at])
                    # (start, place of the last word so far): every follower within reach goes on
                    starts = here = lists[0]
                    for follower in lists[1:]:
                        order = np.sort(follower)
                        kept = [(starts[ok], here[ok] + d) for d in range(1, within + 2) for ok in [np.isin(here + d, order)]]
                        both = np.unique(np.stack([np.concatenate([x for x, _ in kept]), np.concatenate([x for _, x in kept])]), axis=1)
                        starts, here = both[0], both[1]
                    starts = np.unique(starts)
                    if len(starts):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), k, dtype=np.int32)), pa.array(own.docs[starts // span]), pa.array((starts % span).astype(np.int32))], schema=schema)

    return index.mapInArrow(run, "phrase int, doc_id bigint, position int")


def found(documents: DataFrame, items: DataFrame, least: int = LEAST, one_in: int = ONE_IN) -> DataFrame:
    """(doc_id, item_id): the document holds a passage of the item."""
    return leaks(stored(documents), items, least, one_in).select("doc_id", "item_id")
