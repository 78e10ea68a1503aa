import hashlib
import re

import pytest
from pyspark.sql import functions as F

from scoreloop.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [
        (m.start(), list(PATTERNS).index(kind), m.end())
        for kind, p in PATTERNS.items() for m in re.finditer(p, text or "", re.ASCII) if valid(kind, m[0])
    ]
    return sorted(found)


def as_text(spans):
    return ",".join(f"{list(PATTERNS)[k]}:{s}:{e}" for s, k, e in spans)


ODD = [
    None, "", " ", "a@b.c", "a@b@c.d", "x.y%z+1-@h-1.co.uk.,", "a@b.c_x@d.e", "@a.b", "a@.b", "é@b.c ü@ö.c", "a@b..c", "1.2.3.4.5.6.7.8", "1.2.3.4",
    "256.1.1.1 255.255.255.255 000255.1.1.01", "1.2.3x4.5.6.7", "4058 8265 8863 4783", "4111111111111111", "4111-1111 11111111", "4111  1111",
    "0000000000000000000", "00000000000000000000", "5 4111111111111111", "+1 (383) 555-6083", "+1 (383) 555-6083 4111111111111111", "+12345678",
    "+123456789 +1", "++1 2 3 4 5 6 7 8 9 0", "+1 ( ) . - 5", "\U0001f600 a@b.c \U0001f600 1.2.3.4", "a@b.c\na@b.c", "+1.2.3.4", "9" * 400, "1.1" * 300,
    "\x01a@b.c\x02", "$1 \\1 a@b.c",
]


def collect(frame):
    return pii.digest(pii.spans(frame)).collect()


def test_base_spans_equal_the_plain_patterns(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(9000 + i, t) for i, t in enumerate(ODD)] + [(None, "a@b.c"), (9003, "a@b.c")], "doc_id long, text string")
    frame = docs.union(extra).withColumns({c: F.lit(1) for c in ("kind", "start", "h1", "spans", "rid", "g")})
    want = sorted(
        (str(r.doc_id), hashlib.sha256(as_text(brute(r.text)).encode()).hexdigest(), *(sum(k == j for _, j, _ in brute(r.text)) for k in range(4)))
        for r in frame.select("doc_id", "text").collect()
    )
    rows = collect(frame)
    assert sorted((str(r.doc_id), r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in rows) == want
    texts = {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()}
    for r in rows:
        own = set(filter(None, r.spans.split(",")))
        assert {x for x in as_text(brute(texts[r.doc_id])).split(",") if x} <= own
        starts = [(int(s.split(":")[1]), list(PATTERNS).index(s.split(":")[0])) for s in r.spans.split(",") if s]
        assert starts == sorted(starts) and len(own) == len(starts)


def test_trees_add_what_a_greedy_base_match_hides(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    card, phone = "4111111111111111", "+1 (383) 555-6083"
    hidden = spark.createDataFrame([(-1, f"lorem {phone} {card} ipsum"), (-2, "call 1234567890123456 or 3.4.5 now 7"), (-3, f"x {card} y")], "doc_id long, text string")
    rows = {r.doc_id: r for r in collect(docs.union(hidden))}
    assert rows[-1].n_card == rows[-1].n_phone == 0
    assert f"phone:6:{6 + len(phone)}" in rows[-1].spans and f"card:{7 + len(phone)}:{7 + len(phone) + 16}" in rows[-1].spans
    assert rows[-2].spans == "" and rows[-3].spans == "card:2:18"
    texts = {r.doc_id: r.text for r in docs.union(hidden).collect()}
    clean = [r for r in rows.values() if not re.search("[0-9]{3}|@", texts[r.doc_id])]
    assert clean and all(r.spans == "" for r in clean)


@pytest.mark.parametrize("text,ips", [
    ("9" * 200_000, 0), ("a" * 200_000, 0), ("a." * 100_000, 0), ("1.2.3.4 " * 20_000, 20_000), ("+1" + " " * 100_000, 0), ("a@b" * 60_000, 0), ("1 " * 100_000, 0),
])
def test_very_long_texts(spark, text, ips):
    (row,) = collect(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (0, ips, 0, 0)


def test_redaction(spark):
    rows = [(1, "mail a@b.c, ip 1.2.3.4!", "x"), (2, None, "y"), (3, "nothing", None), (1, "mail a@b.c, ip 1.2.3.4!", "x"), (1, "other +1 (383) 555-6083", "z"), (None, "\U0001f600a@b.c", "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, h1 string")
    got = pii.redact(frame)
    assert got.columns == frame.columns
    want = [(1, "mail [EMAIL], ip [IP]!", "x"), (2, None, "y"), (3, "nothing", None), (1, "mail [EMAIL], ip [IP]!", "x"), (1, "other [PHONE]", "z"), (None, "\U0001f600[EMAIL]", "n")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert collect(frame) == [] and pii.redact(frame).collect() == []
