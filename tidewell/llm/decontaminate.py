"""Benchmark decontamination with a positional inverted index partitioned by documents.

`build_index` turns documents into index rows, one for each block of documents: its terms and, for
each, the delta-coded word positions in the block. `search` intersects, for the windows of words of
all items, the offset-adjusted position lists from the rarest term on, block by block: exact phrases
come out, and (items with) proximity matches, where the item's rarest words lie close together. All
windows whose words are all in a block take a step together, so a block costs a few array operations.
The index is written to shared storage, and items beyond one broadcast are searched in several passes
over it, so neither side has a size limit. Items travel as word numbers, not as windows.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MARK, cuts, discard, give_back, materialize, text_blocks

#: Word bytes are digits, letters after lower-casing A-Z, and every byte of a non-ASCII character.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

WINDOW = 10
NEAR_TERMS = 4
NEAR_SPAN = 40
BLOCK_BYTES = 4 << 20
#: Bytes of item text that one broadcast may hold; more items are searched in more passes.
ITEM_BYTES = 4 << 20
#: Windows, and their postings, that take a step together.
STEP_WINDOWS = 1 << 16
STEP_POSTINGS = 1 << 20
#: Bytes of distinct item words that may be broadcast to keep other words out of the index; beyond, it holds every word.
VOCABULARY_BYTES = 32 << 20

INDEX_SCHEMA = "block long, rows array<long>, doc_ids array<long>, starts array<int>, terms array<binary>, postings array<binary>"
HITS_SCHEMA = "block long, rows array<long>, doc_ids array<long>, starts array<int>, terms array<binary>, postings array<binary>, found array<struct<row:int,item:string,start:int,length:int,exact:boolean>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: frozenset[bytes] | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Index rows of all documents; of all their words, or of those in vocabulary.

    `rows` numbers a block's documents, so repeated ids keep rows of their own; `starts` has the position
    of each document's first word and, at its end, the block's length. Documents are set apart by one
    position. Null texts have no words; null ids stay null.
    """
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))})
    names = None if vocabulary is None else sc.broadcast(sorted(vocabulary))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = (TaskContext.get().partitionId() << 32) - 1
        for table, texts in text_blocks(batches, "text", block_bytes):
            block += 1
            words = (b" " + MARK + b" ").join(t.translate(WORD_TABLE) for t in texts).split()
            if known.value is None:
                ids: dict[bytes, int] = {}
                code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
                mark = ids.pop(MARK, -2)
                marks = np.flatnonzero(code == mark)
                code[marks] = -1
                terms = list(ids)
                back = np.zeros(len(ids) + 2, np.int32)
                back[list(ids.values())] = np.arange(len(ids))
                code = np.where(code >= 0, back[code], -1)
            else:
                vocab = known.value
                get = vocab.get
                code = np.fromiter((get(w, -1) for w in words), np.int32, len(words))
                marks = np.fromiter((i for i in np.flatnonzero(code < 0).tolist() if words[i] == MARK), np.int64)
                terms = names.value
            starts = np.concatenate([[0], marks + 1, [len(words) + 1]]).astype(np.int32)
            where = np.flatnonzero(code >= 0).astype(np.int32)
            where = where[np.argsort(code[where], kind="stable")]
            sorted_code = code[where]
            cuts = np.flatnonzero(np.diff(sorted_code)) + 1
            lists = np.split(where, cuts) if len(where) else []
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "block": block,
                        "rows": list(range(len(texts))),
                        "doc_ids": table.column("doc_id").to_pylist(),
                        "starts": starts.tolist(),
                        "terms": [terms[x] for x in sorted_code[np.concatenate([[0], cuts])].tolist()] if lists else [],
                        "postings": [np.diff(x, prepend=np.int32(0)).tobytes() for x in lists],
                    }
                ],
                schema=pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("postings", pa.list_(pa.binary()))]),
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(index, INDEX_SCHEMA)


def _load_items(items: DataFrame, item_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items in parts whose text has about item_bytes at most; one partition's rows at a time visit the driver."""
    part: list[tuple[str, list[bytes]]] = []
    size = 0
    for item, text in items.toLocalIterator():
        if part and size + len(text or "") > item_bytes:
            yield part
            part, size = [], 0
        part.append((item, words_of(text)))
        size += len(text or "")
    if part:
        yield part


@dataclass
class Part:
    """Items as numbers of the words in `terms` (ascending), one after another in `flat`.

    Windows of `width` words begin at windows[width] in flat and belong to the items owners[width]. near: for each item that
    takes part the anchor and the other terms that must lie close to it.
    """

    items: list[str | None]
    terms: list[bytes]
    flat: np.ndarray
    windows: dict[int, np.ndarray]
    owners: dict[int, np.ndarray]
    near: list[tuple[int, list[int]]]
    span: int


def make_part(part: list[tuple[str, list[bytes]]], window: int, near_terms: int, near_span: int, often: Mapping[bytes, int] | None = None) -> Part:
    """often: how many times the items hold a word, for the choice of rare ones; counted in this part if it isn't given."""
    if often is None:
        often = Counter(w for _, words in part for w in words)
    terms = sorted({w for _, words in part for w in words})
    code = {w: i for i, w in enumerate(terms)}
    begins: dict[int, list[int]] = {}
    owners: dict[int, list[int]] = {}
    near, flat = [], []
    for item, (_, words) in enumerate(part):
        width = min(window, len(words))
        if width:
            n = len(words) - width + 1
            begins.setdefault(width, []).extend(range(len(flat), len(flat) + n))
            owners.setdefault(width, []).extend([item] * n)
        rare = sorted(set(words), key=lambda w: (often[w], -len(w), w))[:near_terms]
        if near_terms and len(rare) == near_terms and len(words) >= window:
            near.append((item, [code[w] for w in rare]))
        flat += [code[w] for w in words]
    arrays = lambda x: {k: np.asarray(v, np.int64) for k, v in x.items()}
    return Part([i for i, _ in part], terms, np.asarray(flat, np.int32), arrays(begins), arrays(owners), near, near_span)


def _exact(part: Part, count: np.ndarray, first: np.ndarray, where: np.ndarray, span: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, items, positions) of windows in a block whose word i is at where[first[i] : first[i] + count[i]]; span is beyond any position asked for."""
    key = np.repeat(np.arange(len(count)), count) * span + where  # ascending
    for width, starts in part.windows.items():
        for at in range(0, len(starts), STEP_WINDOWS):
            words = part.flat[starts[at : at + STEP_WINDOWS, None] + np.arange(width)]
            n = count[words]
            live = np.flatnonzero(n.all(axis=1))
            order = np.argsort(n[live], axis=1, kind="stable")
            words, owner = np.take_along_axis(words[live], order, axis=1), part.owners[width][at + live]
            total = np.cumsum(count[words[:, 0]])
            for low, high in cuts(total, STEP_POSTINGS):
                rarest = words[low:high, 0]
                n = count[rarest]
                of = np.repeat(np.arange(low, high), n)
                begin = where[np.repeat(first[rarest] - (np.cumsum(n) - n), n) + np.arange(n.sum())] - order[of, 0]
                for step in range(1, width):
                    wanted = words[of, step] * np.int64(span) + begin + order[of, step]
                    slot = np.searchsorted(key, wanted)
                    slot[slot == len(key)] = 0
                    hit = (key[slot] == wanted) & (begin >= 0)
                    of, begin = of[hit], begin[hit]
                    if not len(of):
                        break
                yield width, owner[of], begin[begin >= 0]


def _search_block(part: Part, lists: dict[bytes, np.ndarray], starts: np.ndarray) -> list[dict]:
    empty = np.empty(0, np.int64)
    postings = [lists.get(w, empty) for w in part.terms]
    count = np.asarray([len(p) for p in postings], np.int64)
    where = np.concatenate([empty, *postings])
    first = np.cumsum(count) - count
    found: list[dict] = []
    for width, items, begin in _exact(part, count, first, where, int(starts[-1]) + 1 + max(part.windows, default=0)):
        once = np.unique(np.stack([items, begin]), axis=1) if len(items) else np.empty((2, 0), np.int64)
        rows = np.searchsorted(starts, once[1], side="right") - 1
        found += ({"row": r, "item": part.items[i], "start": b, "length": width, "exact": True} for i, b, r in zip(once[0].tolist(), (once[1] - starts[rows]).tolist(), rows.tolist(), strict=True))
    for item, terms in part.near:
        if not count[terms].all():
            continue
        anchor, *others = (postings[t] for t in terms)
        row = np.searchsorted(starts, anchor, side="right") - 1
        low, high = np.maximum(anchor - part.span, starts[row]), np.minimum(anchor + part.span, starts[row + 1] - 1)
        good = np.ones(len(row), bool)
        for at in others:
            good &= np.searchsorted(at, low) < np.searchsorted(at, high, side="right")
        for r, b in dict(zip(row[good].tolist(), anchor[good].tolist(), strict=True)).items():
            found.append({"row": r, "item": part.items[item], "start": b - int(starts[r]), "length": 1, "exact": False})
    return found


def search(index: DataFrame, part: list[tuple[str, list[bytes]]], window: int = WINDOW, near_terms: int = NEAR_TERMS, near_span: int = NEAR_SPAN, often: Mapping[bytes, int] | None = None) -> DataFrame:
    """Adds to each index row, in column found, where the items of one part occur: exact windows and proximity.

    Proximity: of the item's near_terms rarest words (by how often the items hold them, longest first, then by bytes) all
    others lie within near_span words of an occurrence of the first, in one document; items of fewer words take no part.
    """
    sent = index.sparkSession.sparkContext.broadcast(make_part(part, window, near_terms, near_span, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = pa.struct([("row", pa.int32()), ("item", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("exact", pa.bool_())])
        schema = pa.schema([("block", pa.int64()), ("rows", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int32())), ("terms", pa.list_(pa.binary())), ("postings", pa.list_(pa.binary())), ("found", pa.list_(hit))])
        for r in _found(batches, sent.value):
            yield pa.RecordBatch.from_pylist([r], schema=schema)

    return index.mapInArrow(run, HITS_SCHEMA)


def _found(batches: Iterator[pa.RecordBatch], asked: Part) -> Iterator[dict]:
    """Index rows, one at a time, with what was found before and of this part."""
    wanted = set(asked.terms)
    try:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                lists = {w: np.cumsum(np.frombuffer(p, np.int32), dtype=np.int64) for w, p in zip(r["terms"], r["postings"], strict=True) if w in wanted}
                yield r | {"found": [*(r.get("found") or ()), *_search_block(asked, lists, np.asarray(r["starts"], np.int64))]}
    finally:
        give_back()


def _summary(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """A row for each document of the index rows, which hold all that was found."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))), ("block", pa.int64()), ("row", pa.int32())])
    empty = hashlib.sha256(b"").hexdigest()
    for r in rows:
        out = []
        by: dict[int, list[dict]] = {}
        for f in r["found"]:
            by.setdefault(f["row"], []).append(f)
        words = np.diff(np.asarray(r["starts"])) - 1
        for i, doc in enumerate(r["doc_ids"]):
            found = by.get(i, ())
            spans = sorted({(f["start"], f["length"]) for f in found if f["exact"]})
            hit, reach = 0, 0
            for start, n in spans:
                hit += max(0, start + n - max(start, reach))
                reach = max(reach, start + n)
            items = sorted({f["item"] for f in found if f["exact"] and f["item"] is not None})
            out.append(
                {
                    "doc_id": doc, "n_words": int(words[i]), "n_hit": hit, "n_items": len(items), "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest() if items else empty, "contaminated": hit > 0,
                    "items": items, "near_items": sorted({f["item"] for f in found if not f["exact"] and f["item"] is not None} - set(items)), "spans": [{"start": a, "length": n} for a, n in spans], "block": r["block"], "row": i,
                }
            )
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, near_terms: int = NEAR_TERMS, near_span: int = NEAR_SPAN, item_bytes: int = ITEM_BYTES, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """One row for each document row: counts, the items found exactly and nearby, and the hit spans in words.

    Words are runs of digits, letters (A-Z lower-cased) and non-ASCII characters. Null or empty texts have no
    words and no hits; an item without words matches nothing; items with equal texts are all reported; repeated
    document rows each get their row; columns besides those named play no part. Empty tables give empty or
    all-clean results. Items whose id is null count as hits but are not listed.
    """
    items = benchmark.select(F.col(item_col).cast("string"), F.col(item_text_col))
    often: Counter[bytes] | None = Counter()
    for part in _load_items(items, item_bytes):
        if often is not None:
            for _, w in part:
                often.update(w)
            often = None if sum(map(len, often)) > vocabulary_bytes else often
    hits = materialize(build_index(docs, id_col, text_col, None if often is None else frozenset(often)), "positional-index")
    last: list[tuple[str, list[bytes]]] = []
    for part in _load_items(items, item_bytes):
        if last:
            before, hits = hits, materialize(search(hits, last, window, near_terms, near_span, often), "positional-index")
            discard(before)
        last = part
    # searched and summed up in one Python worker a task: an executor keeps as many workers as it ever needed at once, and each of them holds what later stages broadcast
    sent = docs.sparkSession.sparkContext.broadcast(make_part(last, window, near_terms, near_span, often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _summary(_found(batches, sent.value))

    return hits.mapInArrow(run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, near_items array<string>, spans array<struct<start:int,length:int>>, block long, row int")
