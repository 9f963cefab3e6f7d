"""Operators that look at one text at a time or cut texts, against plain Python."""

import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatehouse.llm import language_id, quality_rules, sentencepiece, sharding
from gatehouse.llm.suffix_dedup import remove_repeats

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ODD = [
    None, "", " ", "\n\n", "a", "ab  cd", " lead", "trail ", "é", "ßÄ ö", "漢字 漢字", "\U0001f600 x", "tab\tin\x0b\x0cside\r\n",
    "▁mark ▁", "a b", "nul\x00byte", "x" * 3000, "x y " * 700, " nbsp ", "#*$%&|<>" * 9, "é combining",
]


def brute_cut(rows, depth):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - depth + 1):
            first[b[i : i + depth]] = min(first.get(b[i : i + depth], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - depth + 1):
            if first[b[i : i + depth]] < d:
                gone[i : i + depth] = [True] * depth
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def repeats_fixture():
    rng = random.Random(11)
    words = ["der", "la", "été", "house", "ñandú", "x", "of", "zwölf", "漢"]

    def text(n):
        return " ".join(rng.choices(words, k=n))

    passages = [text(30) for _ in range(6)] + ["Common line of the house, with rights reserved for all of us."]
    rows = []
    for d in rng.sample(range(1000), 60):
        parts = [text(rng.randint(0, 25)) for _ in range(3)]
        for at in rng.sample(range(4), rng.randint(0, 2)):
            parts.insert(at, rng.choice(passages)[rng.randint(0, 9) :])
        rows.append((d, "\n".join(parts)))
    rows += [(2000 + k, t) for k, t in enumerate(ODD)]
    rows += [(3000, rows[5][1]), (3001, rows[5][1] + "!"), (3002, "ab" * 400), (3003, "ba" * 300), (3004, "a" * 49), (3005, "a" * 50), (3006, "a" * 51)]
    return rows


@pytest.mark.parametrize("depth", [50, 20, 160])
def test_cut_against_brute_force(spark, depth):
    rows = repeats_fixture()
    frame = spark.createDataFrame([(d, t, "k", 1) for d, t in rows], "doc_id long, text string, kept string, rid int")
    found = remove_repeats(frame.repartition(4), depth=depth).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == brute_cut(rows, depth)
    assert all(r.others.kept == "k" and r.others.rid == 1 for r in found)


def test_cut_of_long_texts(spark):
    """Texts that are handled in blocks, with a passage across the border of two."""
    rng = random.Random(2)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    rows = [(1, long), (2, "q" * 40 + long[262_100:262_200] + "r" * 40), (9, "z" + long)]
    found = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1].n_removed == 0
    assert bytes(found[2].kept) == b"q" * 40 + b"r" * 40
    assert bytes(found[9].kept) == b"z"


def test_cut_with_repeated_and_missing_identifiers(spark):
    passage = "this passage is long enough to be found in several rows of the table"
    rows = [(None, passage), (5, passage), (5, passage), (5, "x" + passage), (7, passage + "y")]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, bytes(r.kept).decode()) for r in found) == [
        (-1, passage), (5, passage), (5, passage), (5, "x" + passage), (7, "y"),
    ]
    assert found[0].others is None


def test_cut_keeps_characters_whole(spark):
    a, b = "ä" * 30 + "é", "ä" * 30 + "è"  # the last characters differ in their second byte
    rows = [(1, "1" + a), (2, "2" + b)]
    found = {r.doc_id: bytes(r.kept) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole_characters=True).collect()}
    assert found[2].decode() == "2è"


def test_nothing_to_cut(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def measured(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measures_and_rules(spark):
    texts = ODD + [t for _, t in repeats_fixture()] + ["one\ntwo\none\n one\ntwo\n\n", "a b c a b c", "a b a b a", "w " * 60, " ".join(f"v{k}" for k in range(80))]
    rows = [(k, t, 3) for k, t in enumerate(texts)] + [(None, "x", 1), (0, "twice", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    found = quality_rules.ledger(frame).withColumn("ok", quality_rules.passes(quality_rules.BASE)).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id}
    for k, t in enumerate(texts[1:], 1):
        r = by_id[k]
        m = measured(t)
        assert tuple(r[c] for c in quality_rules.MEASURES) == m, (k, t)
        assert r.ok == (m[0] >= 50 and 100 * m[5] <= 50 * m[0])


def test_ablation_counts_bits(spark):
    rows = spark.createDataFrame([(0,), (1,), (1,), (3,), (2,), (8,)], "failed long")
    policy = quality_rules.Policy("p", ("few_words", "repeated_words"))
    found = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(rows, policy).collect()}
    assert found == {"few_words": (3, 2), "repeated_words": (2, 1)}


def test_no_documents_in_the_ledger(spark):
    assert quality_rules.ledger(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 24, 25, 1000, 65_537])
def test_permutation(n):
    places = sharding.permuted(np.arange(n), n, 7)
    assert sorted(places.tolist()) == list(range(n))
    assert (sharding.permuted(np.arange(n)[::-1], n, 7)[::-1] == places).all()
    if n >= 1000:
        assert (places != np.arange(n)).mean() > 0.9
        assert abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.1


def test_shards(spark):
    rows = [(k * 7 % 501, t) for k, t in enumerate(ODD * 12)] + [(None, None), (3, "same"), (3, "same"), (3, "same")]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, shard int")
    found = sharding.shuffled_shards(frame.repartition(3)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows
    )
    sizes = Counter(r.shard for r in found)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == set(range(24))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in found if r.shard == shard) == list(range(n))
    assert sorted(r.row for r in found) == list(range(len(rows)))
    order = sorted(found, key=lambda r: r.row)
    key = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in order]
    assert key == sorted(key)
    again = sharding.shuffled_shards(frame.repartition(7)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, found), key=str)


def test_no_shards(spark):
    assert sharding.shuffled_shards(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def naive_phrases(text, learned):
    """Greedy longest phrases that occur in the learned text."""
    n = at = 0
    while at < len(text):
        length = 1
        while at + length < len(text) and text[at : at + length + 1] in learned:
            length += 1
        n += 1
        at += length
    return n


def test_phrases_against_a_plain_parse(spark):
    rng = random.Random(4)
    rows = []
    for lang, letters in (("aa", "abcde"), ("bb", "abcxyz")):
        for k in range(6):
            rows.append((k + 10 * (lang == "bb"), " ".join("".join(rng.choices(letters, k=rng.randint(1, 7))) for _ in range(60)), lang))
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb"]
    taken = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.xxhash64("doc_id").alias("h")).collect()
    for k, lang in enumerate(model.names):
        learned = " ".join(r.text for r in sorted(taken, key=lambda r: r.h) if r.lang == lang)
        texts = ["", "abc", "xyz abq, cde", "Abc  CDE!!", "".join(rng.choices("abcdexyz ", k=3000))]
        for text in texts:
            plain = re.sub("[^a-z]+", " ", text.lower())
            coded = language_id._encode(text.encode(), model.symbols)
            counts = language_id.phrase_counts(*language_id._collapsed(coded, np.array([0, len(coded)])), model)
            blocks = [plain[i : i + language_id.BLOCK] for i in range(0, len(plain), language_id.BLOCK)]
            assert counts[0, k] == sum(naive_phrases(b, learned) for b in blocks), text


def test_languages_of_odd_texts(spark):
    rows = [(k, "the house and the garden of the town " * 3, "en") for k in range(3)] + [(k, "das haus und der garten der stadt " * 3, "de") for k in range(3, 6)]
    labelled = spark.createDataFrame([*rows, (None, "x", "fr"), (8, None, "fr"), (9, "y", None), (10, "", "fr")], "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    assert model.names == ["de", "en"]
    texts = [*ODD, "The Garden and the house", "der Garten und das Haus " * 900]
    frame = spark.createDataFrame([(k, t, "none") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    found = {r.doc_id: r.p for r in frame.select("doc_id", language_id.language_of(spark, F.col("text"), model).alias("p")).collect()}
    for k, t in enumerate(texts):
        assert (found[k].lang_pred == "und") == (not any(c.isalpha() for c in t or "")), t
        assert 0 <= found[k].score <= 1
    assert found[len(ODD)].lang_pred == "en" and found[len(ODD) + 1].lang_pred == "de"


def test_nothing_learned(spark):
    model = language_id.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    found = spark.createDataFrame([("abc",)], "text string").select(language_id.language_of(spark, F.col("text"), model).alias("p")).first().p
    assert (found.lang_pred, found.score) == ("und", 0.0)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.load(VOCABULARY)


def best_score(word, model):
    scores = {model.spelled[p]: s for p, s in zip(model.piece, model.score, strict=True) if p >= 0}
    best = [0.0] + [-1e18] * len(word)
    for end in range(1, len(word) + 1):
        best[end] = best[end - 1] + model.fallback
        for start in range(max(0, end - model.longest), end):
            best[end] = max(best[end], best[start] + scores.get(word[start:end], -1e18))
    return best[-1]


def test_pieces_have_the_best_score(pieces):
    rng = random.Random(8)
    texts = [t for t in ODD if t] + ["the quick brown fox " + "".join(rng.choices("abcdeé ", k=200)), "hello hello hell helloo"]
    scores = {p: s for p, s in zip(pieces.piece.tolist(), pieces.score.tolist(), strict=True) if p >= 0}
    data = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    counts, ids = sentencepiece.encode_texts(np.frombuffer(b"".join(data), np.uint8), offsets, pieces)
    ends = np.cumsum(counts)
    for text, a, b in zip(data, ends - counts, ends, strict=True):
        words = [b" " + w for w in (b" " + text).split(b" ")[1:]]
        got = sum(scores.get(i, pieces.fallback) for i in ids[a:b].tolist())
        assert got == pytest.approx(sum(best_score(w, pieces) for w in words)), text


def test_texts_come_back(spark, pieces):
    frame = spark.createDataFrame([(k, t, 5) for k, t in enumerate(ODD)], "doc_id long, text string, ids int")
    coded = frame.select("doc_id", "text", sentencepiece.encoded(spark, F.col("text"), pieces).alias("pieces"))
    for r in coded.withColumn("back", sentencepiece.decoded(spark, F.col("pieces"), pieces)).collect():
        assert r.back == r.text
        assert (r.pieces is None) == (r.text is None) and (r.text != "" or r.pieces == [])


def test_decoding_odd_ids(spark, pieces):
    rows = [(0, None), (1, []), (2, [1, 2, None, 99_999, -3]), (3, [int(pieces.byte_ids[0xC3])])]
    found = dict(
        tuple(r) for r in spark.createDataFrame(rows, "k int, ids array<int>").select("k", sentencepiece.decoded(spark, F.col("ids"), pieces)).collect()
    )
    assert found == {0: None, 1: "", 2: "", 3: "�"}


def test_no_texts_to_encode(spark, pieces):
    frame = spark.createDataFrame([], "text string")
    assert frame.select(sentencepiece.encoded(spark, F.col("text"), pieces)).collect() == []


def test_whole_texts_are_hashed_alike_wherever_they_stand():
    from gatehouse.llm import text_arrays as ta

    data = np.frombuffer(b"xxabcyyabc", np.uint8)
    sums = ta.prefix_hash(data)
    a, b = ta.span_hash(sums, np.array([2, 7]), np.array([5, 10]))
    assert a == b


def test_long_words_alone_or_together():
    """A word of any length gets the same pieces, whichever way it is segmented."""
    model = sentencepiece.load(VOCABULARY)
    pick = random.Random(9)
    words = ["".join(pick.choices("etaoinshrdß中é", k=n)) for n in (1, 2, 5, 30, 300, 900)]
    words += ["ab" * 400, "a" * 700, "internationalisation" * 40, "\x00\x7f" * 50]
    for word in words:
        data = np.frombuffer((" " + word).encode(), np.uint8)
        _, together = sentencepiece._segmented(data[None, :], np.array([len(data)]), model)
        assert sentencepiece._segmented_alone(data.tobytes(), model).tolist() == together.tolist()


def test_a_text_without_spaces_takes_time_in_proportion():
    model = sentencepiece.load(VOCABULARY)
    line = "".join(random.Random(1).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000)).encode()
    data = np.frombuffer(line + b" and a few words", np.uint8)
    begin = time.perf_counter()
    counts, ids = sentencepiece.encode_texts(data, np.array([0, len(data)]), model)
    assert time.perf_counter() - begin < 30
    assert counts.tolist() == [len(ids)] and b"".join(model.spelled[i] for i in ids.tolist()) == b" " + data.tobytes()


def test_long_texts_and_copies_teach_a_language(spark):
    """A language whose texts are all long is learned; copies of a text count once."""
    pick = random.Random(3)

    def prose(words, n):
        return " ".join(pick.choices(words, k=n))

    german, english = "der die und nicht schön über straße wird".split(), "the and not nice over street will this".split()
    rows = [(k, prose(german, 12_000), "de") for k in range(3)]
    rows += [(100 + k, "copy of one short text", "en") for k in range(400)] + [(600 + k, prose(english, 12), "en") for k in range(40)]
    labelled = spark.createDataFrame([*rows, (1, None, "fr"), (2, "", "fr"), (None, "bonjour", "fr"), (3, "x", None)], "doc_id long, text string, lang string")
    model = language_id.learn(labelled)
    assert model.names == ["de", "en"]
    asked = spark.createDataFrame([(0, prose(german, 9)), (1, prose(english, 9))], "doc_id long, text string")
    found = asked.select("doc_id", language_id.language_of(spark, F.col("text"), model).alias("p")).orderBy("doc_id").collect()
    assert [r.p.lang_pred for r in found] == ["de", "en"]
