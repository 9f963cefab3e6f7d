"""Removal of passages that already stand in an earlier document, by a depth-limited radix sort.

Every suffix of every text is ordered, but only by its first `depth` bytes: suffixes that agree
so far are the repeated windows. The sort goes by digits, most significant first, and after each
pass groups of a single document are dropped:

1. Digit one is a run of `GRAM` bytes. Of the suffixes, only those pass that stand where the
   least hash within reach of `depth` bytes lies; equal windows choose equal places, so each
   window is represented. Neighbouring windows with one such place form a segment.
2. Digit two is the whole segment. Equal segments settle all of their windows at once.
3. Where segments differ but share digit one, the windows themselves are sorted, by all
   `depth` bytes.

A pass sends compact arrays to buckets of hash ranges. Equal keys of one batch of documents
are reduced to one before they are sent, so a passage in a third of all documents costs one
entry per batch and no task gathers its documents. Texts are shuffled once, by identifier.
Keys are 64-bit hashes of the bytes.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import text_arrays as ta
from gatehouse.llm.tables import finished

#: Bytes of the first digit; at most the depth.
GRAM = 18
#: Segments with one gram that a batch sends on; the windows of others go to pass three.
FEW = 8
#: Bytes of text for each bucket of the sort.
BUCKET_BYTES = 32_000_000
#: Bytes of text whose segments a task holds at a time.
HELD_BYTES = 4_000_000
#: The same for pass three, where every byte may start a window of its own.
WINDOWED_BYTES = 1_000_000

_FOUND = "doc_id long, rid int, code long"
_SENT = "bucket int, doc_id long, rid int, code long, body binary"
_ARROW = pa.schema(
    [("bucket", pa.int32()), ("doc_id", pa.int64()), ("rid", pa.int32()), ("code", pa.int64()), ("body", pa.binary())]
)


def _codes(start: np.ndarray, length, is_open: bool) -> np.ndarray:
    """A run of windows: where it starts, how many, and whether they are still open."""
    return (start.astype(np.int64) << 16) | (np.asarray(length, np.int64) << 1) | int(is_open)


def _length(code: np.ndarray) -> np.ndarray:
    return (code >> 1) & 0x7FFF


def _segments(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int):
    """(text, first window, windows, hash of gram, hash of segment) of texts in a row."""
    n = len(data) - depth + 1
    if n <= 0:
        return None
    sums = ta.prefix_hash(data)
    grams = ta.sliding_hash(sums, gram)
    bits = max(len(grams).bit_length(), 20)
    mask = np.uint64((1 << bits) - 1)
    # The least hash wins; among equals the last place.
    least = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    width, done = depth - gram + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: done - width], least[width - done :])
    place = (mask - (least & mask)).astype(np.int64)
    text = ta.owner(offsets)
    fits = text[:n] == text[depth - 1 :]
    edge = np.ones(n + 1, bool)
    edge[1:n] = (place[1:] != place[:-1]) | ~fits[1:] | ~fits[:-1]
    starts, ends = np.flatnonzero(fits & edge[:-1]), np.flatnonzero(fits & edge[1:])
    place = place[starts]
    # Where in the segment the gram stands belongs to the key.
    segment = ta.mix(ta.span_hash(sums, starts, ends + depth) + (place - starts).astype(np.uint64))
    # Hashes that won are small; mixed once more they spread over all buckets.
    return text[starts], starts, ends - starts + 1, ta.mix(grams[place] + np.uint64(1)), segment


def _blocks(offsets: np.ndarray, depth: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, text after the last, from byte, to byte).

    Very long texts come in blocks that share depth - 1 bytes, so each window is in one block.
    """
    for a, b in ta.pieces(offsets):
        low, high = int(offsets[a]), int(offsets[b])
        step = ta.PIECE if b == a + 1 else high - low + 1
        for at in range(low, max(high - depth + 1, low + 1), step):
            yield a, b, at, min(at + step + depth - 1, high)


def _batch_segments(data, offsets, depth: int, gram: int):
    """The segments of a batch; windows are counted from the start of their text."""
    found = []
    for a, b, low, high in _blocks(offsets, depth):
        got = _segments(data[low:high], np.clip(offsets[a : b + 1], low, high) - low, depth, gram)
        if got is not None:
            text, start, *rest = got
            found.append((text + a, start + low - offsets[text + a], *rest))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Marks where, in sorted rows, one of the keys changes."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _send(keys: np.ndarray, bits: int, doc_id, rid, text, start, **columns) -> Iterator[pa.RecordBatch]:
    """One row per bucket of hash ranges, with its arrays packed: texts named once, in order."""
    if not len(keys):
        return
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int32)
    order = np.lexsort((start, text, bucket))
    bucket, text, start = bucket[order], text[order], start[order]
    cuts = np.flatnonzero(_firsts(bucket)).tolist() + [len(bucket)]
    heads = _firsts(bucket, text)
    steps = np.diff(start, prepend=0)
    steps[heads] = start[heads]
    bodies = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = np.flatnonzero(heads[a:b])
        used = text[a:b][at]
        counts = np.diff(np.append(at, b - a))
        packed = [_narrow(counts), _narrow(steps[a:b]), {k: v[order[a:b]] for k, v in columns.items()}]
        bodies.append(pickle.dumps((doc_id[used], rid[used], *packed), protocol=5))
    none = pa.nulls(len(bodies), pa.int64())
    yield pa.record_batch(
        [pa.array(bucket[cuts[:-1]]), none, none.cast(pa.int32()), none, pa.array(bodies, pa.binary())], schema=_ARROW
    )


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in as few bytes as they need."""
    return x.astype(np.min_scalar_type(int(x.max()))) if len(x) else x


def _settled(doc_id, rid, code, bits: int) -> Iterator[pa.RecordBatch]:
    """What a batch knows by itself goes through the same exchange, dealt out evenly."""
    bucket = (ta.mix(doc_id.astype(np.uint64) + code.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int32)
    for at in range(0, len(code), 1 << 18):
        part = slice(at, at + (1 << 18))
        n = len(code[part])
        yield pa.record_batch(
            [pa.array(bucket[part]), pa.array(doc_id[part]), pa.array(rid[part]), pa.array(code[part]), pa.nulls(n, pa.binary())],
            schema=_ARROW,
        )


def _received(table: pa.Table):
    """Entries of a bucket: doc_id, rid, start and the other packed columns."""
    parts, columns = ([], [], []), {}
    for packed in table.column("body").drop_null().to_pylist():
        doc_id, rid, counts, steps, more = pickle.loads(packed)
        total = np.cumsum(steps.astype(np.int64))
        before = np.cumsum(counts.astype(np.int64)) - counts
        base = total[before] - steps[before]
        for part, values in zip(parts, (np.repeat(doc_id, counts), np.repeat(rid, counts), total - np.repeat(base, counts)), strict=True):
            part.append(values)
        for k, v in more.items():
            columns.setdefault(k, []).append(v)
    if not parts[0]:
        return None
    return *(np.concatenate(x) for x in parts), {k: np.concatenate(v) for k, v in columns.items()}


def _answer(table: pa.Table, *parts) -> pa.Table:
    known = table.filter(table.column("body").is_null()).select(["doc_id", "rid", "code"])
    own = [pa.table({"doc_id": pa.array(d, pa.int64()), "rid": pa.array(r, pa.int32()), "code": pa.array(c, pa.int64())}) for d, r, c in parts]
    return pa.concat_tables([known, *own])


def _held(batches: Iterator[pa.RecordBatch], limit: int = HELD_BYTES) -> Iterator[tuple]:
    """(rows, bytes, offsets, doc_id, rid) of batches cut down to `limit` bytes of text."""
    for batch in batches:
        _, offsets, _ = ta.flat(batch.column("text"))
        for a, b in ta.pieces(offsets, limit):
            rows = batch.slice(a, b - a)
            data, own, _ = ta.flat(rows.column("text"))
            yield rows, data, own, rows.column("doc_id").fill_null(0).to_numpy(), rows.column("rid").to_numpy()


def _first_pass(depth: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets, doc_id, rid in _held(batches):
            if (got := _batch_segments(data, offsets, depth, gram)) is None:
                continue
            doc = doc_id[got[0]]
            order = np.lexsort((doc, got[4], got[3]))
            text, start, length, grams, segment = (x[order] for x in got)
            doc = doc[order]
            new_gram = _firsts(grams)
            new = new_gram | _firsts(segment)
            later = doc > doc[new][np.cumsum(new) - 1]
            yield from _settled(doc[later], rid[text[later]], _codes(start[later], length[later], False), bits)
            # Places of segments within their gram, and how many there are.
            rank = np.cumsum(new)
            gram_no = np.cumsum(new_gram) - 1
            rank -= rank[new_gram][gram_no]
            many = (np.maximum.reduceat(rank, np.flatnonzero(new_gram)) >= FEW)[gram_no]
            known = many & ~later
            yield from _settled(doc[known], rid[text[known]], _codes(start[known], length[known], True), bits)
            sent = ~later & (rank < FEW)
            # A length of 0 asks for no answer: those windows are open already.
            asked = _narrow(np.where(many, 0, length)[sent])
            # The bucket tells the first bits of the gram, this its last 32; a rare mix-up only
            # opens windows that need not be.
            low = grams[sent].astype(np.uint32)
            yield from _send(grams[sent], bits, doc_id, rid, text[sent], start[sent], gram=low, segment=segment[sent], length=asked)

    return run


def _first_sort(table: pa.Table) -> pa.Table:
    if (got := _received(table)) is None:
        return _answer(table)
    doc, rid, start, more = got
    order = np.lexsort((doc, more["segment"], more["gram"]))
    doc, rid, start = doc[order], rid[order], start[order]
    grams, segment, length = (more[k][order] for k in ("gram", "segment", "length"))
    new_gram = _firsts(grams)
    new = new_gram | _firsts(segment)
    heads, gram_no = np.flatnonzero(new_gram), np.cumsum(new_gram) - 1
    later = doc > doc[new][np.cumsum(new) - 1]
    several = np.add.reduceat(new.astype(np.int64), heads) > 1
    shared = (np.minimum.reduceat(doc, heads) < np.maximum.reduceat(doc, heads)) | (np.minimum.reduceat(length, heads) == 0)
    asked = length > 0
    is_open = (several & shared)[gram_no] & ~later & asked
    later &= asked
    return _answer(
        table,
        (doc[later], rid[later], _codes(start[later], length[later], False)),
        (doc[is_open], rid[is_open], _codes(start[is_open], length[is_open], True)),
    )


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of a column of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.value_parent_indices().to_numpy(), column.flatten().to_numpy()


def _second_pass(depth: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets, doc_id, rid in _held(batches, WINDOWED_BYTES):
            text, code = _runs(rows.column("codes"))
            text, code = text[code & 1 == 1], code[code & 1 == 1]
            length = _length(code)
            first = np.repeat(np.cumsum(length) - length, length)
            at = np.repeat(code >> 16, length) + np.arange(length.sum()) - first
            text = np.repeat(text, length)
            where = offsets[text] + at
            order = np.argsort(where, kind="stable")
            text, at, where = text[order], at[order], where[order]
            keys = np.zeros(len(at), np.uint64)
            for _, _, low, high in _blocks(offsets, depth):
                a, b = np.searchsorted(where, [low, high - depth + 1])
                if a < b:
                    sums = ta.prefix_hash(data[low:high])
                    keys[a:b] = ta.span_hash(sums, where[a:b] - low, where[a:b] - low + depth)
            doc = doc_id[text]
            order = np.lexsort((doc, keys))
            text, at, keys, doc = text[order], at[order], keys[order], doc[order]
            new = _firsts(keys)
            later = doc > doc[new][np.cumsum(new) - 1]
            yield from _settled(doc[later], rid[text[later]], _codes(at[later], 1, False), bits)
            sent = ~later
            yield from _send(keys[sent], bits, doc_id, rid, text[sent], at[sent], key=keys[sent])

    return run


def _second_sort(table: pa.Table) -> pa.Table:
    if (got := _received(table)) is None:
        return _answer(table)
    doc, rid, start, more = got
    order = np.lexsort((doc, more["key"]))
    doc, rid, start, keys = doc[order], rid[order], start[order], more["key"][order]
    new = _firsts(keys)
    later = doc > doc[new][np.cumsum(new) - 1]
    return _answer(table, (doc[later], rid[later], _codes(start[later], 1, False)))


def _cut(depth: int, names: list[str], whole: bool):
    """Takes the covered bytes out of each text, or only characters that are covered whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets, *_ in _held(batches):
            marks = [_runs(batch.column(c)) for c in ("codes", "more_codes")]
            text, code = (np.concatenate(x) for x in zip(*marks, strict=True))
            text, code = text[code & 1 == 0], code[code & 1 == 0]
            start = offsets[text] + (code >> 16)
            gone = np.zeros(len(data) + 1, bool)
            if len(start):
                # Steps up where covered windows begin and down where their last byte ends.
                steps = np.zeros(len(data) + 1, np.int32)
                np.add.at(steps, start, 1)
                np.add.at(steps, start + _length(code) - 1 + depth, -1)
                gone = np.cumsum(steps) > 0
            gone = gone[:-1]
            if whole and len(data):
                first = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_and.reduceat(gone, first), np.diff(np.append(first, len(data))))
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            begins[heads] = gone[heads]
            removed, spans = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
            kept = data[~gone]
            ends = offsets - removed
            rest = pa.Array.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(kept)])
            yield pa.record_batch(
                [*(batch.column(n) for n in names), rest.cast(pa.binary()), pa.array(np.diff(offsets)), pa.array(np.diff(removed)), pa.array(np.diff(spans))],
                names=[*names, "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 50, whole_characters: bool = False) -> DataFrame:
    """Each document without the bytes of any `depth`-byte string that starts in an earlier one.

    Returns one row per input row: doc_id, kept (binary, the remaining bytes), n_bytes,
    n_removed, n_spans (maximal removed runs), and `others`, a struct of all other columns of
    the input under their own names, whatever these are (null if there are none).

    With `whole_characters`, characters that are covered in part stay, so kept is valid text.

    Earlier means a smaller identifier. Matches never cross documents, overlaps count, and
    strings are judged on the input. A null text counts as empty. A row without identifier
    neither removes nor loses anything. Rows that repeat an identifier are documents of their
    own, and neither is earlier than the other. Texts shorter than `depth` stay whole. An empty
    table gives an empty result.
    """
    # Rows that repeat an identifier are told apart by a hash of their text, rid. Rows that are equal in
    # both send the same codes, so these are kept once, however many such rows there are.
    gram = min(GRAM, depth)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.hash(text_col).alias("rid"),
        F.col(text_col).alias("text"),
        (F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.lit(None).cast("string")).alias("others"),
    )
    numbered = texts.select("doc_id", "rid", "text").filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= depth))
    n_bytes = numbered.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = max(6, math.ceil(math.log2(n_bytes / BUCKET_BYTES + 1)))

    first = numbered.mapInArrow(ta.trimmed(_first_pass(depth, gram, bits)), _SENT).groupBy("bucket").applyInArrow(ta.trimmed_group(_first_sort), _FOUND)
    found = finished(first.groupBy("doc_id", "rid").agg(F.collect_set("code").alias("codes")), "segments")

    # The same shuffle of the texts serves the second pass and the result, so both take the
    # same columns and rows from it.
    nothing = F.array().cast("array<long>")
    marked = texts.join(found, ["doc_id", "rid"], "left")
    second = marked.select("doc_id", "rid", "others", "text", "codes").mapInArrow(ta.trimmed(_second_pass(depth, bits)), _SENT).groupBy("bucket").applyInArrow(ta.trimmed_group(_second_sort), _FOUND)
    more = second.groupBy("doc_id", "rid").agg(F.collect_set("code").alias("more_codes"))
    names = ["doc_id", "others"]
    ready = marked.join(more, ["doc_id", "rid"], "left").select(
        "doc_id", "rid", "others", "text", F.coalesce("codes", nothing).alias("codes"), F.coalesce("more_codes", nothing).alias("more_codes")
    )
    counts = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    kinds = T.StructType([texts.schema["doc_id"], texts.schema["others"], T.StructField("kept", T.BinaryType()), *counts])
    return ready.mapInArrow(ta.trimmed(_cut(depth, names, whole_characters)), kinds)
