import random
import re

from gatehouse.functions.pii import PII_PATTERNS, marker
from gatehouse.operators.egress import sanitize_egress
from gatehouse.operators.pii import pii_report, redact_pii
from gatehouse.settings import ENGLISH, Settings


def redact(spark, texts, **kw):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return redact_pii(rows, **kw).orderBy("i").collect()


def sanitize(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return sanitize_egress(rows).orderBy("i").collect()


# What each kind looks like, and numbers, names and dates that only resemble it.
HITS = {
    "iban": ["NL91 ABNA 0417 1643 00", "GB33BUKB20201555555555", "AT611904300234573201"],
    "card": ["5500 0000 0000 0004", "3400-0000-0000-0009"],
    "email": ["x@y.example", "élan.è@d-e.org", "a+b_c@host.sub.example"],
    "phone": ["+44 20 7946 0958", "020-7946-0958", "02079460958"],
}
MISSES = ["03/11/2019", "v4.0.12", "881204", "x@y", "@home", "1234 567", "NL9", "2024/07946095/8"]
# Whole texts around a value: `{}` stands at the start, in the middle, at the end, in brackets and on its own.
CARRIERS = ["{}", "Start {} end", "({})", "one\n{}\ntwo", "ends with {}", "{}, then more", "«{}»", "中 {} 中"]
# What takes an edge away when it touches a value, by kind.
GLUED = {"iban": ["x{}", "é{}"], "card": ["1{}", "{}é"], "phone": ["/{}", "{}/", "a{}", "{}_"]}


def test_every_kind_in_every_carrier(spark):
    cases = [(kind, hit, carrier) for kind, hits in HITS.items() for hit in hits for carrier in CARRIERS]
    for (kind, hit, carrier), row in zip(cases, redact(spark, [c.format(h) for _, h, c in cases]), strict=True):
        assert row.text == carrier.format(marker(kind)), (kind, hit, carrier)
        assert row.counts == {kind: 1} and row.total == 1


def test_resembling_values_stay(spark):
    texts = [c.format(m) for m in MISSES for c in CARRIERS] + ["", *CARRIERS]
    for text, row in zip(texts, redact(spark, texts), strict=True):
        assert (row.text, row.total, row.summary, row.counts) == (text, 0, "aucune PII", {}), text


def test_a_value_glued_to_a_word_is_no_such_value(spark):
    # A phone number with separators holds others that begin or end behind one of them.
    cases = [(k, hit, glue) for k, glues in GLUED.items() for hit in HITS[k] for glue in glues if k != "phone" or hit.isdigit()]
    for (kind, hit, glue), row in zip(cases, redact(spark, [g.format(h) for _, h, g in cases]), strict=True):
        assert marker(kind) not in row.text, (kind, hit, glue)


def test_several_values_are_counted_by_kind(spark):
    pick = random.Random(2)
    for _ in range(3):
        chosen = [(kind, pick.choice(hits)) for kind, hits in HITS.items() for _ in range(pick.randrange(3))]
        pick.shuffle(chosen)
        row = redact(spark, [" / ".join(["begin", *(f"<{hit}>" for _, hit in chosen)])])[0]
        kinds = [kind for kind, _ in chosen]
        assert row.counts == {k: kinds.count(k) for k in HITS if k in kinds}
        assert row.text == " / ".join(["begin", *(f"<{marker(k)}>" for k in kinds)])


def test_summary_texts(spark):
    text = "x@y.example or z@y.example or 020-7946-0958"
    assert redact(spark, [text])[0].summary == "3 PII masquee(s): 2 email, 1 phone"
    english = Settings(messages=ENGLISH)
    assert redact(spark, [text], settings=english)[0].summary == "3 PII masked: 2 email, 1 phone"


def test_report(spark):
    rows = spark.createDataFrame(
        [("fr", "x@y.example"), ("fr", "néant"), ("en", "020-7946-0958")], "lang string, text string"
    )
    report = {r.lang: r for r in pii_report(redact_pii(rows), "lang").collect()}
    assert (report["fr"].texts, report["fr"].texts_with_pii, report["fr"].n_email) == (2, 1, 1)
    assert report["en"].n_phone == 1 and report["en"].total == 1


# What the patterns mean in Python's dialect, for the comparison below.
DIALECT = {
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,4})?\b",
    "card": r"\b(?:\d{4}[ -]){3}\d{4}\b",
    "email": r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b",
    "phone": r"(?<![\w/])\+?\d[\d .-]{7,14}\d(?![\w/])",
}
PIECES = [
    "a@b.com", "é.x@d-e.org", ".+d@e.f", "+44 20 7946 0958", "020-7946-0958", "5500 0000 0000 0004",
    "NL91 ABNA 0417 1643 00", "GB33BUKB20201555555555", "٣٣٣٣ 0000 0000 0004", "/", "_", "𝐀",
    "𠀀", "é", "é", "²", "\u200d", " ", ".", "-", "+", "\n", "\x85", "[IBAN_REDACTED]", "1", "中", "😀",
]


def test_parts_between_spaces_are_put_together_again(spark):
    """Addresses are looked for in the parts with an @ alone; spaces of any number and kind stay as they are."""
    texts = {
        "": "",
        "  @  a@b.cd ": "  @  [EMAIL_REDACTED] ",
        "a@b.cd+e@f.gh  x@y": "[EMAIL_REDACTED][EMAIL_REDACTED]  x@y",
        ".a@b.c-d@e.f\tg@h.i\u00a0j@k.l\n m@n.o.": ".[EMAIL_REDACTED]@e.f\t[EMAIL_REDACTED]\u00a0[EMAIL_REDACTED]\n [EMAIL_REDACTED].",
        "a@b .c a @b.c a@ b.c": "a@b .c a @b.c a@ b.c",
    }
    found = redact(spark, list(texts))
    assert [r.text for r in found] == list(texts.values())
    email = re.compile(DIALECT["email"])
    assert [r.n_email for r in found] == [len(email.findall(t)) for t in texts]


def test_same_as_python_on_hostile_texts(spark):
    pick = random.Random(7)
    texts = ["".join(pick.choices(PIECES, k=pick.randint(1, 7))) for _ in range(4000)]
    rows = redact(spark, texts)
    for text, row in zip(texts, rows, strict=True):
        counts = {}
        expected = text
        for kind, _ in PII_PATTERNS:
            expected, n = re.subn(DIALECT[kind], marker(kind), expected)
            if n:
                counts[kind] = n
        assert (row.text, row.counts) == (expected, counts), text


# Ways out of an answer, by counter, and links that carry nothing.
CHANNELS = {
    "images_removed": ["![{}](https://pixel.example/d.gif)", "![{}](  http://pixel.example/d.gif?k=1)", "![](https://a.example/{})"],
    "links_removed": ["[{}](https://pixel.example/r?from=list)", "[{}]( http://a.example/?q)", "https://store.example/put?key={}"],
}
PLAIN_LINKS = ["https://guide.example/{}/start.html", "[{}](https://guide.example/start)", "[{}](docs/start?x=1)", "![{}](local.png)", "ftp://a.example/{}?x"]


def test_every_channel_in_every_carrier(spark):
    marks = {"images_removed": "[image removed]", "links_removed": "[link removed]"}
    # A bare URL runs on to the next space or bracket.
    carriers = [c for c in CARRIERS if not c.startswith(("{},", "«"))]
    cases = [(counter, way.format("key"), carrier) for counter, ways in CHANNELS.items() for way in ways for carrier in carriers]
    for (counter, way, carrier), row in zip(cases, sanitize(spark, [c.format(w) for _, w, c in cases]), strict=True):
        assert row.text == carrier.format(marks[counter]), (way, carrier)
        assert {c: row[c] for c in marks} == {c: int(c == counter) for c in marks} and not row.clean


def test_plain_links_stay(spark):
    texts = [c.format(way.format("lifts")) for way in PLAIN_LINKS for c in CARRIERS]
    for text, row in zip(texts, sanitize(spark, texts), strict=True):
        assert row.clean and row.text == text and row.egress_summary == "ok", text


def test_personal_data_in_answers_is_counted_apart(spark):
    for kind, hits in HITS.items():
        row = sanitize(spark, [f"{hits[0]} and {CHANNELS['links_removed'][0].format('x')}"])[0]
        assert (row.images_removed, row.links_removed, row.pii_redacted) == (0, 1, 1)
        assert row.pii_counts == {kind: 1} and row.text == f"{marker(kind)} and [link removed]"


def test_egress_summary_lists_parts_in_order(spark):
    text = "![x](http://a/b) [y](http://a/b?c) http://a/b?c a@b.com"
    row = sanitize(spark, [text])[0]
    assert row.egress_summary == (
        "sortie assainie: 1 image(s) distante(s) supprimee(s), "
        "2 URL(s) a query string supprimee(s), 1 PII masquee(s)"
    )
    assert row.pii_counts == {"email": 1}


# The channels in Python's dialect.
LINK_DIALECT = (
    (r"!\[[^\]]*\]\(\s*https?://[^)]*\)", "[image removed]"),
    (r"\[[^\]]*\]\(\s*https?://[^)?]*\?[^)]*\)", "[link removed]"),
    (r"https?://[^\s)\]]+\?[^\s)\]]+", "[link removed]"),
)
LINK_PIECES = [
    "![", "[", "]", "](", "(", ")", "!", " ", "\n", "\x1c", "\u3000", "http://a.b", "https://c/d", "?", "q=1", "x", "é",
    "a@b.com", "://", "[doc](https://a.b/?q)", "![i](http://a.b/i.png)", "https://a.b/c?d", "#", "+44 20 7946 0958",
]


def test_channels_same_as_python_on_hostile_texts(spark):
    pick = random.Random(5)
    texts = ["".join(pick.choices(LINK_PIECES, k=pick.randint(1, 10))) for _ in range(4000)]
    for text, row in zip(texts, sanitize(spark, texts), strict=True):
        expected, found = text, []
        for pattern, mark in LINK_DIALECT:
            expected, n = re.subn(pattern, mark, expected)
            found.append(n)
        masked = 0
        for kind, _ in PII_PATTERNS:
            expected, n = re.subn(DIALECT[kind], marker(kind), expected)
            masked += n
        got = (row.text, row.images_removed, row.links_removed, row.pii_redacted)
        assert got == (expected, found[0], found[1] + found[2], masked), text
