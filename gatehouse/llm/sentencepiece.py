"""Encoding into the pieces of a vocabulary, and decoding, with Viterbi over a trie of words.

A text is a row of marked words: each space is the mark in front of the word that follows it,
and one more mark stands in front of the text. Pieces do not cross marks, so each distinct word
of a batch is segmented once. The distinct words are sorted, which is the depth-first order of
their trie: a word shares with the one before it all nodes of their common beginning, and with
them the forward scores, the best score of any segmentation up to there. Only the nodes behind
the common beginning are computed, for all words of a batch level by level, so that the work is
done on arrays.

Each word gets the pieces with the highest sum of scores. Bytes that no piece covers are spelled
with the byte pieces of the vocabulary, so decoding gives back every text exactly.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import text_arrays as ta

#: The mark as vocabularies write it, and the byte that stands for it here.
MARK, SPACE = "▁", 32
#: Score of a byte piece below the lowest score of a piece.
FALLBACK = 10.0
#: Words by length up to twice this each; bytes of a table of words; bytes that sort a word.
SHORT, CELLS, SORTED = 24, 1 << 20, 24
#: Bytes of text whose words are segmented together.
HELD_BYTES = 500_000
#: Bytes from which on a word is segmented by itself: hardly any other shares its levels.
LONG = 2048


class Pieces:
    """A vocabulary: the bytes of each id, its byte pieces, and a trie with ids and scores.

    `base[node] + byte` is the next node if its `parent` is that node, else there is none; node 0 is the root.
    A row of 256 entries for each node would hold sixty megabytes in every Python worker, this is one.
    """

    def __init__(self, spelled: list[bytes | None], scores: list[float], byte_ids: np.ndarray):
        self.spelled, self.scores, self.byte_ids = spelled, scores, byte_ids
        nodes: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        for piece, word in enumerate(spelled):
            # Byte pieces and pieces with a mark behind their first byte match no part of a word.
            if not word or scores[piece] == -np.inf or SPACE in word[1:]:
                continue
            at = 0
            for byte in word:
                if byte not in nodes[at]:
                    nodes[at][byte] = len(nodes)
                    nodes.append({})
                at = nodes[at][byte]
            if at not in ends or scores[piece] > scores[ends[at]]:
                ends[at] = piece
        place, self.base, self.parent = _placed(nodes)
        self.piece = np.full(len(self.parent), -1, np.int32)
        self.score = np.full(len(self.parent), -np.inf)
        for node, piece in ends.items():
            self.piece[place[node]], self.score[place[node]] = piece, scores[piece]
        self.fallback = min((scores[p] for p in ends.values()), default=0.0) - FALLBACK
        self.longest = max((len(spelled[p]) for p in ends.values()), default=1)
        lengths = np.array([len(w or b"") for w in spelled], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        self.bytes = np.frombuffer(b"".join(w or b"" for w in spelled), np.uint8)


def _placed(nodes: list[dict[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of each node, base of each place, parent of each place or -1) of a trie of bytes.

    The children of a node stand as their bytes are apart, in places that nothing else has. Nodes with
    several go first, each behind the one before it; only children fill the gaps.
    """
    place = np.zeros(len(nodes), np.int32)
    free, at, parents = np.ones(1 << 16, bool), 1, {}
    free[0] = False
    several = sorted((n for n, moves in enumerate(nodes) if len(moves) > 1), key=lambda n: -len(nodes[n]))
    for node in several:
        bytes_, children = (np.array(list(x)) for x in (nodes[node].keys(), nodes[node].values()))
        while True:
            if at + 1024 > len(free):
                free = np.concatenate([free, np.ones(len(free), bool)])
            fits = np.flatnonzero(free[np.arange(at, at + 512)[:, None] + bytes_].all(axis=1))
            if len(fits):
                break
            at += 512
        at += int(fits[0])
        place[children] = at + bytes_
        free[at + bytes_] = False
        parents[node] = at
    only = [n for n, moves in enumerate(nodes) if len(moves) == 1]
    free = np.concatenate([free, np.ones(len(only) + 512, bool)])
    # A byte is taken off the place to get the base, which is not to fall below 0.
    gaps = 256 + np.flatnonzero(free[256:])[: len(only)]
    for node, gap in zip(only, gaps.tolist()):
        (byte, child), = nodes[node].items()
        place[child] = gap
        parents[node] = gap - byte
    # Behind the last place that is used there are 256 more, so that every byte may be looked up.
    base = np.zeros(int(place.max(initial=0)) + 257, np.int32)
    parent = np.full(len(base), -1, np.int32)
    for node, moves in enumerate(nodes):
        if moves:
            base[place[node]] = parents[node]
            parent[place[list(moves.values())]] = place[node]
    return place, base, parent


def load(path: str, scores: str = "rank") -> Pieces:
    """The vocabulary of a model file.

    scores "model" takes the scores of the file, which are logarithms of probabilities in a
    unigram model. The scores of a merge model are mere ranks; "rank" turns these into
    logarithms of probabilities that fall with the rank, as frequencies of words do.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelled: list[bytes | None] = []
    given: list[float] = []
    byte_ids = np.full(256, -1, np.int32)
    for piece in range(model.get_piece_size()):
        name = model.id_to_piece(piece)
        if model.is_byte(piece):
            byte_ids[int(name[3:-1], 16)] = piece
            spelled.append(bytes([int(name[3:-1], 16)]))
            given.append(-np.inf)
        elif model.is_control(piece) or model.is_unknown(piece) or model.is_unused(piece):
            spelled.append(None)
            given.append(-np.inf)
        else:
            spelled.append(name.replace(MARK, " ").encode())
            given.append(model.get_score(piece))
    if (byte_ids < 0).any():
        raise ValueError("the vocabulary has no byte pieces, so it cannot spell every text")
    if scores == "rank":
        order = np.argsort([-x for x in given], kind="stable")
        rank = np.empty(len(order))
        rank[order] = np.arange(len(order))
        given = [x if x == -np.inf else float(-np.log(r + 2.7)) for x, r in zip(given, rank.tolist(), strict=True)]
    return Pieces(spelled, given, byte_ids)


def _sorted_words(words: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of words (rows of bytes) by their first bytes, and how many each shares with the one before."""
    width = -(-min(words.shape[1], SORTED) // 8) * 8
    head = np.zeros((len(words), width), np.uint8)
    part = words[:, : min(words.shape[1], SORTED)]
    head[:, : part.shape[1]] = part
    columns = head.view(">u8").astype(np.uint64)
    order = np.lexsort([length, *columns.T[::-1]])
    # Only bytes that both words have are shared; rows are filled up with zeros.
    same = np.minimum.accumulate(part[order][1:] == part[order][:-1], axis=1).sum(axis=1)
    shared = np.zeros(len(words), np.int64)
    shared[1:] = np.minimum(same, np.minimum(length[order][1:], length[order][:-1]))
    return order, shared


def _segmented(words: np.ndarray, length: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(number of pieces of each word, pieces of all words in a row)."""
    order, shared = _sorted_words(words, length)
    words, length = words[order], length[order]
    deepest = int(length.max())
    node_of = [np.zeros(len(words), np.int32)]
    best, back, chosen = [np.zeros(1)], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
    # Trie nodes of the pieces that could go on, by how many bytes ago they began.
    going = np.zeros((1, model.longest), np.int32)
    for depth in range(1, deepest + 1):
        has = length >= depth
        new = has & (shared < depth)
        # A node is shared with the last word before that has this depth and made it.
        node_of.append((np.cumsum(new) - 1).astype(np.int32))
        at = np.flatnonzero(new)
        byte = words[at, depth - 1]
        before = going[node_of[depth - 1][at]]
        score = best[depth - 1][node_of[depth - 1][at]] + model.fallback
        length_back, piece = np.ones(len(at), np.int32), model.byte_ids[byte]
        going = np.zeros((len(at), model.longest), np.int32)
        open_ends = np.flatnonzero(before.any(axis=0)) + 2
        for back_by in [1, *open_ends[open_ends <= model.longest].tolist()]:
            live = np.arange(len(at)) if back_by == 1 else np.flatnonzero(before[:, back_by - 2])
            state = np.zeros(len(live), np.int32) if back_by == 1 else before[live, back_by - 2]
            there = model.base[state] + byte[live]
            on = np.flatnonzero(model.parent[there] == state)
            rows, node = live[on], there[on]
            going[rows, back_by - 1] = node
            ends = np.flatnonzero(model.piece[node] >= 0)
            rows, node = rows[ends], node[ends]
            whole = best[depth - back_by][node_of[depth - back_by][at[rows]]] + model.score[node]
            better = np.flatnonzero(whole > score[rows])
            rows = rows[better]
            score[rows], length_back[rows], piece[rows] = whole[better], back_by, model.piece[node[better]]
        best.append(score)
        back.append(length_back)
        chosen.append(piece)

    # Back from the last node of each word, all words in step.
    heads = np.concatenate([[0], np.cumsum([len(x) for x in best])])
    back, chosen = np.concatenate(back), np.concatenate(chosen)
    nodes = np.stack(node_of)
    place, live, found = length.copy(), np.arange(len(words)), []
    while len(live):
        node = heads[place[live]] + nodes[place[live], live]
        found.append((live, chosen[node]))
        place[live] -= back[node]
        live = live[place[live] > 0]
    word = order[np.concatenate([x for x, _ in found])]
    step = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
    arranged = np.lexsort((-step, word))
    return np.bincount(word, minlength=len(words)), np.concatenate([x for _, x in found])[arranged]


def _segmented_alone(word: bytes, model: Pieces) -> np.ndarray:
    """The pieces of one long word: those of `_segmented`, found byte by byte.

    The word is a path in the trie of words. Of equal scores the byte piece goes first, then the shortest.
    """
    base, parent, spell = memoryview(model.base), memoryview(model.parent), memoryview(model.byte_ids)
    piece, score = memoryview(model.piece), memoryview(model.score)
    n = len(word)
    best = array("d", [-np.inf]) * (n + 1)
    back, chosen = array("i", bytes(4 * (n + 1))), array("i", bytes(4 * (n + 1)))
    best[0] = 0.0
    for at in range(n):
        here = best[at]
        whole = here + model.fallback
        if whole >= best[at + 1]:
            best[at + 1], back[at + 1], chosen[at + 1] = whole, 1, spell[word[at]]
        state = end = 0
        for end in range(at, n):
            there = base[state] + word[end]
            if parent[there] != state:
                break
            state = there
            if piece[state] >= 0:
                whole = here + score[state]
                # Candidates for an end come from the longest to the shortest.
                if whole > best[end + 1] or (whole == best[end + 1] and back[end + 1] > end + 1 - at):
                    best[end + 1], back[end + 1], chosen[end + 1] = whole, end + 1 - at, piece[state]
    found, at = array("i"), n
    while at:
        found.append(chosen[at])
        at -= back[at]
    return np.frombuffer(found, np.int32)[::-1]


def _classes(length: np.ndarray) -> Iterator[np.ndarray]:
    """Words of similar length, so many at a time that their table stays small."""
    order = np.argsort(length, kind="stable")
    at, limit = 0, SHORT
    while at < len(order):
        if length[order[at]] > limit:
            limit *= 2
            continue
        end = int(np.searchsorted(length[order], limit, "right"))
        end = min(end, at + max(CELLS // limit, 1))
        yield order[at:end]
        at = end


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs (start, count), one run after the other."""
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(counts) else np.zeros(0, np.int64)


def encode_texts(data: np.ndarray, offsets: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(number of pieces of each text, pieces of all texts in a row)."""
    n = len(offsets) - 1
    # One mark in front of each text that is not empty.
    filled = (np.diff(offsets) > 0).astype(np.int64)
    own = offsets + np.concatenate([[0], np.cumsum(filled)])
    marked = np.full(int(own[-1]), SPACE, np.uint8)
    marked[np.arange(len(data)) + np.cumsum(filled)[ta.owner(offsets)] if len(data) else np.zeros(0, int)] = data
    starts = np.flatnonzero(marked == SPACE)
    ends = np.append(starts[1:], len(marked))
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(0, np.int32)
    keys = ta.span_hash(ta.prefix_hash(marked), starts, ends)
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    at, length = starts[first], (ends - starts)[first]
    counts, ids, where = np.zeros(len(first), np.int64), [], np.zeros(len(first), np.int64)
    done = 0
    long = np.flatnonzero(length > LONG)
    for word in long.tolist():
        pieces = _segmented_alone(marked[at[word] : at[word] + length[word]].tobytes(), model)
        counts[word], where[word] = len(pieces), done
        done += len(pieces)
        ids.append(pieces)
    usual = np.flatnonzero(length <= LONG)
    for mine in (usual[x] for x in _classes(length[usual])):
        widest = int(length[mine].max())
        words = np.zeros((len(mine), widest), np.uint8)
        inside = np.arange(widest)[None, :] < length[mine][:, None]
        words[inside] = marked[_ragged(at[mine], length[mine])]
        counts[mine], pieces = _segmented(words, length[mine], model)
        where[mine] = done + np.cumsum(counts[mine]) - counts[mine]
        done += len(pieces)
        ids.append(pieces)
    per_word = counts[which]
    text = np.searchsorted(own, starts, "right") - 1
    return np.bincount(text, weights=per_word, minlength=n).astype(np.int64), np.concatenate(ids)[_ragged(where[which], per_word)]


def encoded(spark, text: Column, model: Pieces) -> Column:
    """The pieces of each whole text as an array of ids.

    Null for a null text, empty for an empty one. Nothing but the text is looked at.
    """
    shared = spark.sparkContext.broadcast(model)

    def pieces_of(texts: pa.Array) -> pa.Array:
        data, offsets, valid = ta.flat(texts)
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for a, b in ta.pieces(offsets, HELD_BYTES):
            n, pieces = encode_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shared.value)
            counts.append(n)
            ids.append(pieces)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).astype(np.int32)), mask=pa.array(~valid))

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(texts: pa.Array) -> pa.Array:
        return ta.trimmed_group(pieces_of)(texts)

    return run(text)


def decoded(spark, ids: Column, model: Pieces) -> Column:
    """The texts that arrays of ids spell.

    Null for a null array. Ids that are null, unknown to the vocabulary, or of control pieces
    spell nothing. Bytes that are no valid UTF-8 become U+FFFD.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(T.StringType())
    def run(lists: pa.Array) -> pa.Array:
        own = shared.value
        spelled = []
        for k in range(len(lists)):
            if not lists[k].is_valid:
                spelled.append(None)
                continue
            pieces = lists[k].values.fill_null(-1).to_numpy(zero_copy_only=False)
            pieces = pieces[(pieces >= 0) & (pieces < len(own.spelled))]
            text = own.bytes[_ragged(own.starts[pieces], own.starts[pieces + 1] - own.starts[pieces])].tobytes()
            # The first mark stands in front of the text.
            spelled.append((text[1:] if text[:1] == b" " else text).decode("utf-8", "replace"))
        return pa.array(spelled, pa.string())

    return run(ids)
