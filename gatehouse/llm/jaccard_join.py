"""Similarity join of word-shingle sets with the Jaccard coefficient, by set relations.

Equal sets form one class at once; only classes are joined. Each class orders its shingles from
rare to frequent and lists its leading ones in an index: two sets that are similar enough share
one of these. Two relations between sets then save most comparisons.

*Index level.* A list of the index is read in blocks by position. The shorter set of a pair must
hold the shared shingle among its first places, so blocks further back are skipped before the
lists are joined, and a pair whose remaining places cannot hold the overlap is not made.

*Answer level.* Each list has a leader. First all sets are compared with the leaders of their
lists only, which is linear in the index and finds almost all links of large groups of near
copies. The answers of other pairs follow from these where they can: two sets that are already
connected need no comparison, and as 1 - Jaccard is a metric, neither do two sets whose
distances to a common leader differ by more than a link allows. Only the rest is compared.

Frequencies only order the shingles; they come from a count of all shingles of all documents in
a table of fixed size, so frequent shingles stand last. Hashes have 64 bits,
48 of which are compared.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatehouse.llm import text_arrays as ta
from gatehouse.llm.components import components
from gatehouse.llm.tables import emptied, finished
from gatehouse.session import stored

#: Counters of the frequency table, and slices in which they are summed. Fixed size: 8 MB.
COUNTERS, SLICES = 1 << 20, 32
#: Sets of one shingle that a batch sends to the sort; the others are known to share it.
FEW = 8
#: Identifiers of documents whose sets are compared: up to here they are broadcast (16 MB),
#: beyond that joined by shuffle. Only the plan differs.
BROADCAST_ROWS = 1_000_000
#: Sets, and shingles, of a block when links are counted, and shingles that a product takes at once.
BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 256, 500_000, 4096

_SETS = pa.schema([("doc_id", pa.int64()), ("rid", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()), ("leading", pa.list_(pa.int64()))])
_INDEX = "token long, sig long, n int, place int"
_SENT = f"bucket int, {_INDEX}, body binary"
_SENT_ARROW = pa.schema(
    [("bucket", pa.int32()), ("token", pa.int64()), ("sig", pa.int64()), ("n", pa.int32()), ("place", pa.int32()), ("body", pa.binary())]
)


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of some texts, ordered by text and hash."""
    low = ta.lower_ascii(data)
    starts, ends, first = ta.words(low, offsets)
    hashes = ta.span_hash(ta.prefix_hash(low), starts, ends)
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    tokens = ta.windows(hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        # The whole sequence is the only shingle; its length goes into the hash.
        own = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = counts[short] > k
            own[has] = ta.mix(own[has] + hashes[first[short[has]] + k] * np.uint64(2 * k + 3))
        own = ta.mix(own + counts[short].astype(np.uint64))
        text, tokens = np.concatenate([text, short]), np.concatenate([tokens, own])
    order = np.lexsort((tokens, text))
    text, tokens = text[order], tokens[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (tokens[1:] != tokens[:-1])
    return text[new], tokens[new]


def _batch_shingles(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, text after the last, text, shingle) piece by piece."""
    data, offsets, _ = ta.flat(column)
    for a, b in ta.pieces(offsets):
        text, tokens = _shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)
        yield a, b, text, tokens


def _counted(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for _, _, _, tokens in _batch_shingles(batch.column("text"), size):
                table += np.bincount((tokens & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
        if table.any():
            slices = [x.tobytes() for x in table.reshape(SLICES, -1)]
            yield pa.record_batch({"slice": pa.array(range(SLICES), pa.int32()), "counts": pa.array(slices, pa.binary())})

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice of the table: a running sum, so a task holds one slice whatever the input."""
    total = np.zeros(COUNTERS // SLICES, np.int64)
    for batch in batches:
        number = batch.column("slice")[:1]
        for counts in batch.column("counts"):
            total += np.frombuffer(counts.as_buffer(), np.int64)
    yield pa.record_batch({"slice": number, "counts": pa.array([total.tobytes()], pa.binary())})


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How many sets hold a shingle of each hash class, over all documents."""
    kind = "slice int, counts binary"
    rows = texts.mapInArrow(ta.trimmed(_counted(size)), kind).groupBy("slice").applyInArrow(_summed, kind).collect()
    table = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for row in rows:
        table[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return table.ravel()


def _leading(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of n shingles, rare ones first, must hold one of any similar set."""
    return n - -(-n * percent // 100) + 1


def _sets(size: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            doc_id, rid = batch.column("doc_id"), batch.column("rid")
            for a, b, text, tokens in _batch_shingles(batch.column("text"), size):
                n = np.bincount(text, minlength=b - a)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(ta.mix(tokens + np.uint64(1)))])
                ends = np.cumsum(n)
                sig = ta.mix((sums[ends] - sums[ends - n]) + n.astype(np.uint64))
                order = np.lexsort((tokens, table[(tokens & np.uint64(COUNTERS - 1)).astype(np.int64)], text))
                tokens, text = tokens[order], text[order]
                take = np.arange(len(text)) - (ends - n)[text] < _leading(n, percent)[text]
                leads = np.bincount(text[take], minlength=b - a)
                leading = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(leads)]), pa.int32()), pa.array(tokens[take].view(np.int64)))
                yield pa.record_batch([doc_id.slice(a, b - a), rid.slice(a, b - a), pa.array(n), pa.array(sig.view(np.int64)), leading], schema=_SETS)

    return run


def _index(bits: int, percent: int):
    """Sends the index lists to buckets; of a shingle in many sets of the batch, a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("leading")
            row = lists.value_parent_indices().to_numpy()
            token = lists.flatten().to_numpy().view(np.uint64)
            n, sig = batch.column("n").to_numpy(), batch.column("sig").to_numpy()
            first = np.searchsorted(row, np.arange(len(n)))
            place = np.arange(len(row)) - first[row]
            order = np.lexsort((sig[row], token))
            row, token, place = row[order], token[order], place[order]
            own = sig[row]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
            row, token, place, own = row[new], token[new], place[new], own[new]
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            rank = np.arange(len(token)) - heads[group]
            many = np.diff(np.append(heads, len(token)))[group] > FEW
            size = n[row].astype(np.int32)
            bucket = (token >> np.uint64(64 - bits)).astype(np.int32)
            at = np.flatnonzero(many)
            spread = (ta.mix(token + own.view(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int32)
            for k in range(0, len(at), 1 << 18):
                mine = at[k : k + (1 << 18)]
                yield pa.record_batch(
                    [
                        pa.array(spread[mine]),
                        *(pa.array(x[mine]) for x in (token.view(np.int64), own, size, place.astype(np.int32))),
                        pa.nulls(len(mine), pa.binary()),
                    ],
                    schema=_SENT_ARROW,
                )
            # Entries of `many` have been given out; those sent again only tell other batches.
            sent = rank < FEW
            cuts = [*np.searchsorted(bucket[sent], np.arange(1 << bits)).tolist(), int(sent.sum())]
            columns = [x[sent] for x in (token, own, size, place.astype(np.int32), many)]
            used = [k for k in range(1 << bits) if cuts[k] < cuts[k + 1]]
            bodies = [pickle.dumps([x[cuts[k] : cuts[k + 1]] for x in columns], protocol=5) for k in used]
            blank = [pa.nulls(len(used), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.record_batch([pa.array(used, pa.int32()), *blank, pa.array(bodies, pa.binary())], schema=_SENT_ARROW)

    return run


def _shared(table: pa.Table) -> pa.Table:
    """The entries of a bucket whose shingle stands in the lists of several sets."""
    body = table.column("body")
    known = table.filter(body.is_null()).select(["token", "sig", "n", "place"])
    packed = [pickle.loads(x) for x in body.drop_null().to_pylist()]
    if not packed:
        return known
    token, sig, n, place, told = (np.concatenate(x) for x in zip(*packed, strict=True))
    order = np.lexsort((told, sig, token))
    token, sig, n, place, told = (x[order] for x in (token, sig, n, place, told))
    new_token = np.ones(len(token), bool)
    new_token[1:] = token[1:] != token[:-1]
    new = new_token.copy()
    new[1:] |= sig[1:] != sig[:-1]
    heads = np.flatnonzero(new_token)
    several = (np.add.reduceat(new.astype(np.int64), heads) > 1)[np.cumsum(new_token) - 1]
    keep = new & several & ~told
    own = pa.table({"token": token.view(np.int64)[keep], "sig": sig[keep], "n": n[keep], "place": place[keep]})
    return pa.concat_tables([known, own.cast(known.schema)])


def _body(tokens: np.ndarray) -> bytes:
    """A set as bytes, six of each hash: two sets of a thousand get one wrong match in 10**8 pairs."""
    return tokens.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def _tokens(body) -> np.ndarray:
    packed = np.frombuffer(body.as_buffer(), np.uint8).reshape(-1, 6)
    whole = np.zeros((len(packed), 8), np.uint8)
    whole[:, 2:] = packed
    return whole.view(np.uint64).ravel()


def _set_rows(size: int):
    """(sig, body): the whole set of each document, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig")
            for a, b, text, tokens in _batch_shingles(batch.column("text"), size):
                cuts = np.searchsorted(text, np.arange(b - a + 1))
                bodies = [_body(tokens[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.record_batch([sig.slice(a, b - a), pa.array(bodies, pa.binary())], names=["sig", "body"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of the common parts of pairs of sets."""
    for batch in batches:
        common = [
            len(np.intersect1d(_tokens(x), _tokens(y)))
            for x, y in zip(batch.column("body_a"), batch.column("body_b"), strict=True)
        ]
        yield pa.record_batch([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(common, pa.int64())], names=["a", "b", "na", "nb", "common"])


def _compare(pairs: DataFrame, texts: DataFrame, classes: DataFrame, size: int) -> DataFrame:
    """(a, b, na, nb, common) for pairs of classes, as a table; each set is made once from its text."""
    wanted = pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = stored(classes.join(wanted, "sig", "left_semi").select("sig", "rep.doc_id", "rep.rid"), "compared")
    rows = texts.join(few(wanted), ["doc_id", "rid"]).select("sig", "text").dropDuplicates(["sig"])
    sets = stored(rows.mapInArrow(ta.trimmed(_set_rows(size)), "sig long, body binary"), "sets-compared")
    left = sets.select(F.col("sig").alias("a"), F.col("body").alias("body_a"))
    right = sets.select(F.col("sig").alias("b"), F.col("body").alias("body_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "body_a", "body_b")
    answers = finished(both.mapInArrow(ta.trimmed(_compared), "a long, b long, na int, nb int, common long"), "answers")
    emptied(sets, wanted)
    return answers


def _can_link(percent: int):
    """Whether enough places remain, from a common shingle on, to hold the overlap."""
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return rest * (100 + percent) >= (F.col("na") + F.col("nb")) * percent


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.filter(F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")) * percent)


def _entries(index: DataFrame, side: str, *more: str) -> DataFrame:
    return index.select(
        "token", F.col("sig").alias(side), F.col("n").alias(f"n{side}"), F.col("place").alias(f"p{side}"), *(F.col(c).alias(f"{c}_{side}") for c in more)
    )


def _links_of_classes(index: DataFrame, texts: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b) links that connect all classes which are similar, not every pair of them."""
    # The entry at the first place leads: few shingles of its set are rarer than the common one, so
    # it has few that are its own, and it is close to the middle of a group of near copies.
    leaders = index.groupBy("token").agg(F.min(F.struct("place", "n", "sig")).alias("x"))
    leaders = leaders.select("token", F.col("x.sig").alias("a"), F.col("x.n").alias("na"), F.col("x.place").alias("pa"))
    led = stored(
        _entries(index, "b")
        .join(leaders, "token")
        .filter(F.col("a") != F.col("b"))
        .filter(_can_link(percent))
        .groupBy("a", "b")
        .agg(F.first("na").alias("na"), F.first("nb").alias("nb")),
        "led",
    )
    compared = _compare(led, texts, classes, size)
    first = _links(compared, percent).select("a", "b")
    groups = components(first)

    # Index entries with the group of their set and its distance to the leader of the list.
    distance = compared.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("away"))
    open_lists = (
        index.join(groups.withColumnRenamed("node", "sig"), "sig", "left")
        .withColumn("component", F.coalesce("component", "sig"))
        .join(leaders.select("token", "a"), "token")
        .join(distance.withColumnRenamed("b", "sig"), ["a", "sig"], "left")
        .withColumn("away", F.when(F.col("a") == F.col("sig"), F.lit(0.0)).otherwise(F.col("away")))
    )
    lists = stored(open_lists.select("token", "sig", "n", "place", "component", "away"), "lists")
    all_lists = lists
    several = lists.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("token")
    lists = lists.join(several, "token", "left_semi")
    # The shorter set holds the common shingle in its first block of places.
    front = lists.filter((F.col("n") - F.col("place")) * (100 + percent) >= F.col("n") * 2 * percent)
    shorter, longer = _entries(front, "a", "component", "away"), _entries(lists, "b", "component", "away")
    most = 1 - percent / 100 + 1e-9
    rest = stored(
        shorter.join(longer, "token")
        .filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        .filter((F.col("component_a") != F.col("component_b")) & _can_link(percent))
        .filter(F.coalesce(F.abs(F.col("away_a") - F.col("away_b")) <= most, F.lit(True)))
        .groupBy("a", "b")
        .agg(F.first("na").alias("na"), F.first("nb").alias("nb")),
        "rest",
    )
    all_rest = rest
    # A pair with a leader has been compared.
    rest = rest.join(compared, ["a", "b"], "left_anti").join(compared.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    second = _links(_compare(rest, texts, classes, size), percent).select("a", "b")
    emptied(led, all_lists, all_rest)
    return first.union(second)


def _similar(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts, the rows (doc_id, rid, n, sig; no sig if linked with nothing), and the classes: sig, n,
    rep (smallest doc_id and rid), copies, component (a sig) and first (smallest rep of the component).
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("rid"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(shingle_counts(texts.select("text"), size))
    sets = stored(
        texts.mapInArrow(ta.trimmed(_sets(size, percent, counts)), "doc_id long, rid long, n long, sig long, leading array<long>"), "sets"
    )
    full = sets.filter(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = full.groupBy("sig").agg(F.min(F.struct("doc_id", "rid")).alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))

    entries = full.agg(F.sum(F.size("leading"))).first()[0] or 0
    bits = max(6, int(entries // 1_000_000).bit_length())
    sent = full.select("n", "sig", "leading").mapInArrow(ta.trimmed(_index(bits, percent)), _SENT)
    index = finished(sent.groupBy("bucket").applyInArrow(ta.trimmed_group(_shared), _INDEX), "index")

    # Classes are connected by their sets: two sets of one identifier stay two nodes.
    groups = components(_links_of_classes(index, texts, classes, size, percent)).withColumnRenamed("node", "sig")
    emptied(index)
    grouped = classes.join(groups, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    first = classes.join(groups, "sig").groupBy("component").agg(F.min("rep").alias("first"))
    grouped = grouped.join(first, "component", "left").withColumn("first", F.coalesce("first", "rep"))
    rows = sets.select("doc_id", "rid", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("sig")).alias("sig"))
    return texts, rows, grouped.select("sig", "n", "rep", "copies", "component", "first")


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """Classes of documents whose shingle sets are linked by Jaccard >= percent / 100.

    Returns doc_id, n_shingles (size of the set) and component_id, the smallest doc_id that
    links reach, for every row. Words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, a
    shingle is `size` words in a row; a text with fewer words has its whole sequence as one.

    A text that is null, empty or without words has an empty set, which is linked with nothing:
    its component is its own doc_id. Equal sets are linked. A row without identifier is linked
    with nothing and has a null component. Rows that repeat an identifier each get the component
    of their own set. Other columns of the input are not looked at. An empty table gives an
    empty result.
    """
    _, rows, classes = _similar(docs, id_col, text_col, size, percent)
    return rows.join(classes.select("sig", "first"), "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("component_id")
    )


def repeated_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, rid) of the rows that are not the first of their component, as a table; rid is xxhash64 of the text.

    The first row is the one with the smallest (doc_id, rid). Rows that are linked with nothing
    are first of their own.
    """
    _, rows, classes = _similar(docs, id_col, text_col, size, percent)
    later = rows.join(classes.select("sig", "first"), "sig").filter(F.struct("doc_id", "rid") != F.col("first"))
    found = finished(later.select("doc_id", "rid").distinct(), "repeated-rows")
    # Nothing else needs the sets.
    emptied(rows)
    return found


def few(rows: DataFrame) -> DataFrame:
    """(doc_id, rid) marked for broadcast if there are at most BROADCAST_ROWS of them, 16 MB."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _common(one: np.ndarray, other: np.ndarray, rows: np.ndarray, others: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sizes of the common parts of all sets of one side with all of the other."""
    shared = np.intersect1d(one, other)
    sides = []
    for tokens, row in ((one, rows), (other, others)):
        at = np.searchsorted(shared, tokens)
        has = at < len(shared)
        has[has] = shared[at[has]] == tokens[has]
        order = np.argsort(at[has], kind="stable")
        sides.append((at[has][order], row[has][order]))
    common = np.zeros(shape, np.float32)
    for k in range(0, len(shared), COLUMNS):
        both = []
        for n, (at, row) in zip(shape, sides, strict=True):
            a, b = np.searchsorted(at, [k, k + COLUMNS])
            both.append(np.zeros((n, min(COLUMNS, len(shared) - k)), np.float32))
            both[-1][row[a:b], at[a:b] - k] = 1
        common += both[0] @ both[1].T
    return common


def _count_links(percent: int):
    """(sig, links) of the sets of two blocks of a component, or within one; pairs stay in the task."""

    def run(table: pa.Table) -> pa.Table:
        sig, n, copies = (table.column(c).to_numpy() for c in ("sig", "n", "copies"))
        second = table.column("second").to_numpy(zero_copy_only=False)
        bodies = table.column("body").combine_chunks()
        alone = not second.any()
        parts = []
        for side in [~second] if alone else [~second, second]:
            sets = [_tokens(bodies[int(k)]) for k in np.flatnonzero(side)]
            tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            parts.append((np.flatnonzero(side), tokens, np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
        (a, one, rows), (b, other, others) = parts[0], parts[-1]
        common = _common(one, other, rows, others, (len(a), len(b))).astype(np.int64)
        linked = common * (100 + percent) >= (n[a][:, None] + n[b][None, :]) * percent
        links = np.zeros(len(sig), np.int64)
        if alone:
            np.fill_diagonal(linked, False)
            links[a] = linked @ copies[b]
        else:
            links[a], links[b] = linked @ copies[b], copies[a] @ linked
        found = links > 0
        return pa.table({"sig": sig[found], "links": links[found]})

    return run


def similar_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """similar_classes with n_links: how many other rows link with a row directly.

    All links lie within a component. Its sets are dealt into blocks, and any two blocks of a
    component meet in one task, which compares all their pairs and returns sums only. Copies of
    a set are compared once and counted as many. A row with an empty set or without identifier
    has no link.
    """
    texts, rows, classes = _similar(docs, id_col, text_col, size, percent)
    classes = stored(classes, "classes")
    groups = classes.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total")).filter("m > 1")
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    members = stored(classes.join(groups.select("component", blocks.alias("blocks")), "component"), "members")
    ids = members.select("sig", "rep.doc_id", "rep.rid")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    named = texts.join(ids, ["doc_id", "rid"]).select("sig", "text").dropDuplicates(["sig"])
    bodies = finished(named.mapInArrow(_set_rows(size), "sig long, body binary"), "bodies")
    block = F.pmod(F.xxhash64("sig"), F.col("blocks").cast("long")).cast("int")
    # A block meets itself and those from it on as the first side, those before it as the second.
    partners = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda p: F.struct(F.least(p, "block").alias("i"), F.greatest(p, "block").alias("j"), (p < F.col("block")).alias("second")),
    )
    dealt = (
        members.withColumn("block", block)
        .select("component", "sig", "n", "copies", F.explode(partners).alias("p"))
        .join(bodies, "sig")
        .select("component", "p.*", "sig", "n", "copies", "body")
    )
    found = dealt.groupBy("component", "i", "j").applyInArrow(_count_links(percent), "sig long, links long")
    sums = finished(found.groupBy("sig").agg(F.sum("links").alias("links")), "links-of-classes")
    known = classes.join(sums, "sig", "left").select("sig", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return rows.join(known, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("first.doc_id", "doc_id").alias("component_id"),
    )
