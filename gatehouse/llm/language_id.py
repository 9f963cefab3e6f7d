"""Language identification by cross-parsing entropy.

From labelled text of each language a suffix automaton is built. A new text is cut, from left
to right, into the longest phrases that occur in that labelled text; in the right language the
phrases are long, so few are needed. The language with the fewest phrases, normalised by the
length of the text, wins.

The automata are the only thing learned and have a fixed size: `LEARN_CHARS` characters a
language, documented parameters of `learn`. Every text is parsed whole. It is parsed in blocks
of `BLOCK` characters, with a new phrase at the start of each, in all languages alike; so a
task walks thousands of blocks in step, whatever the lengths of the texts.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatehouse.llm import text_arrays as ta

#: Characters learned a language, different texts from which they are taken, and characters from each.
LEARN_CHARS, LEARN_DOCS, PIECE_CHARS = 32_768, 256, 4096
#: Letters that have a symbol of their own; the others share SHARED symbols.
LETTERS, SHARED = 100, 16
BLOCK = 1024
UNDETERMINED = "und"
#: Symbols: 0 for anything but letters, PAD after the end of a block.
PAD, FIRST = 1, 2

_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Languages:
    """Learned languages: their names, the symbol of each code point, and all automata as one table.

    `table[state + symbol]` is 2 * (next state) + (1 if a phrase begins). `fresh[k]` is the state of
    language k in which no phrase has begun.
    """

    def __init__(self, names: list[str], symbols: np.ndarray, table: np.ndarray, fresh: np.ndarray):
        self.names, self.symbols, self.table, self.fresh = names, symbols, table, fresh


def _symbol_table(texts: list[str]) -> tuple[np.ndarray, int]:
    """Symbol of each code point, and how many symbols there are."""
    counts: dict[str, int] = {}
    for text in texts:
        for c in text.lower():
            if c.isalpha():
                counts[c] = counts.get(c, 0) + 1
    own = {c: FIRST + k for k, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c))[:LETTERS])}
    shared = FIRST + len(own)
    symbols = np.zeros(sys.maxunicode + 1, np.uint8)
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        if c.isalpha():
            low = c.lower()[0]
            symbols[point] = own.get(low, shared + ord(low) % SHARED)
    return symbols, shared + SHARED


def _encode(texts: bytes, symbols: np.ndarray) -> np.ndarray:
    return symbols[np.frombuffer(texts.decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)]


def _automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence; state 0 is the start."""
    goto, link, length, last = [{}], [-1], [0], 0
    for symbol in text:
        state = len(goto)
        goto.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in goto[at]:
            goto[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = goto[at][symbol]
            if length[target] == length[at] + 1:
                link[state] = target
            else:
                copy = len(goto)
                goto.append(dict(goto[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and goto[at].get(symbol) == target:
                    goto[at][symbol] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return goto


def _compiled(goto: list[dict[int, int]], width: int, base: int) -> np.ndarray:
    """The automaton as rows of a table, with one more state, `fresh`, at the end.

    Where no transition leads on, the phrase ends and the symbol begins the next one.
    """
    fresh = len(goto)
    begin = np.full(width, fresh, np.int64)
    for symbol, state in goto[0].items():
        begin[symbol] = state
    begin = 2 * (base + begin * width) + 1
    table = np.tile(begin, (fresh + 1, 1))
    for state, moves in enumerate(goto):
        for symbol, target in moves.items():
            table[state, symbol] = 2 * (base + target * width)
    table[:, PAD] = 2 * (base + np.arange(fresh + 1) * width)
    return table.astype(np.int32 if table.max() < 1 << 31 else np.int64).ravel()


def _collapsed(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of anything but letters become one symbol; offsets of the texts afterwards."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[offsets[:-1][offsets[:-1] < len(symbols)]] = True
    return symbols[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Learns each language from at most LEARN_CHARS characters of at most LEARN_DOCS different texts.

    Texts are taken in the order of a hash of their identifier, so a rerun learns the same, and each
    with its first PIECE_CHARS characters, so long texts teach a language too. A text that stands in several rows is taken once. Rows
    with a null in one of the columns, or an empty text, are not used. The sample is all that reaches the driver.
    """
    from pyspark.sql import Window

    named = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same"))
    rows = named.filter(F.col("id").isNotNull() & F.col("lang").isNotNull() & (F.octet_length("text") > 0))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "same"))
    texts = rows.groupBy("lang", "same").agg(F.min("id").alias("id"))
    picked = texts.withColumn("rank", rank).filter(F.col("rank") <= LEARN_DOCS).drop("rank")
    # At most LEARN_DOCS narrow rows per language.
    pieces = rows.join(F.broadcast(picked), ["lang", "same", "id"]).select("lang", "same", F.xxhash64("id").alias("h"), F.substring("text", 1, PIECE_CHARS).alias("text"))
    sample = pieces.groupBy("lang", "same", "h").agg(F.min("text").alias("text")).collect()
    by_lang: dict[str, list[str]] = {}
    for row in sorted(sample, key=lambda r: (r["lang"], r["h"], r["text"])):
        by_lang.setdefault(row["lang"], []).append(row["text"])
    names = sorted(by_lang)
    symbols, width = _symbol_table([t for n in names for t in by_lang[n]])
    tables, fresh, base = [], [], 0
    for name in names:
        text = " ".join(by_lang[name])[:LEARN_CHARS].encode()
        coded = _encode(text, symbols)
        goto = _automaton(_collapsed(coded, np.array([0, len(coded)]))[0].tolist())
        tables.append(_compiled(goto, width, base))
        fresh.append(base + len(goto) * width)
        base += len(tables[-1])
    # Entries go up to twice the size of the table.
    kind = np.int32 if 2 * base + 1 < 1 << 31 else np.int64
    return Languages(names, symbols, np.concatenate(tables).astype(kind) if tables else np.zeros(0, kind), np.array(fresh, kind))


def _blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of blocks of at most BLOCK symbols."""
    n = -(-np.diff(offsets) // BLOCK)
    text = np.repeat(np.arange(len(n)), n)
    start = offsets[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return text, start, np.minimum(offsets[text + 1] - start, BLOCK)


def phrase_counts(symbols: np.ndarray, offsets: np.ndarray, model: Languages) -> np.ndarray:
    """Phrases of each text in each language (texts x languages)."""
    text, start, length = _blocks(offsets)
    found = np.zeros((len(offsets) - 1, len(model.names)), np.int64)
    padded = np.append(symbols, np.uint8(PAD))
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 2048):
        mine = order[at : at + 2048]
        steps = int(length[mine[-1]])
        where = start[mine][None, :] + np.arange(steps)[:, None]
        where[np.arange(steps)[:, None] >= length[mine][None, :]] = len(symbols)
        rows = padded[where].astype(model.table.dtype)
        state = np.repeat(model.fresh[:, None], len(mine), axis=1)
        phrases = np.zeros(state.shape, np.int32)
        for row in rows:
            move = model.table[state + row]
            phrases += (move & 1).astype(np.int32)
            state = move >> 1
        np.add.at(found, text[mine], phrases.T)
    return found


def _judge(column: pa.Array, model: Languages) -> pa.Array:
    data, offsets, _ = ta.flat(column)
    best, score = np.full(len(column), -1), np.zeros(len(column))
    for a, b in ta.pieces(offsets, 4 * ta.PIECE):
        part = data[offsets[a] : offsets[b]]
        coded = _encode(part.tobytes(), model.symbols)
        chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])[offsets[a : b + 1] - offsets[a]]
        letters = np.diff(np.concatenate([[0], np.cumsum(coded != 0)])[chars])
        counts = phrase_counts(*_collapsed(coded, chars), model)
        if not len(model.names):
            continue
        least = np.sort(counts, axis=1)
        best[a:b] = np.where(letters > 0, np.argmin(counts, axis=1), -1)
        second = least[:, 1] if len(model.names) > 1 else 2 * np.maximum(least[:, 0], 1)
        score[a:b] = np.where(letters > 0, 1 - least[:, 0] / np.maximum(second, 1), 0.0)
    names = np.array([*model.names, UNDETERMINED], object)
    return pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(score)], names=["lang_pred", "score"])


def language_of(spark, text: Column, model: Languages) -> Column:
    """Struct of lang_pred and score for each text.

    lang_pred is a learned language, among equals the first by name; `und` with score 0 if the
    text is null, empty or has no letter, or if nothing was learned. score is the share by which
    the winner needs fewer phrases than the runner-up: 0 for a tie; with a single language
    learned it is 0.5. Nothing but the text is looked at.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(_RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        return ta.trimmed_group(lambda own: _judge(own, shared.value))(texts)

    return judge(text)
