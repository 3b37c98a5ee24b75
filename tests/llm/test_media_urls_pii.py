"""Media columns, URL filters and PII."""

import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.llm import media, pii, url_filter


def test_png_round_trip_and_all_filters():
    r = np.random.default_rng(1)
    for n in (1, 2, 7):
        payload = r.integers(0, 256, 576 * n).astype(np.uint8).tobytes()
        assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    rows = r.integers(0, 256, (10, 24)).astype(np.uint8)  # eight RGB pixels a row
    lines = []
    for y, kind in enumerate([0, 1, 2, 3, 4, 4, 3, 2, 1, 0]):
        line = bytearray([kind])
        for x in range(24):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(rows[y, x]) - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        lines.append(bytes(line))
    head = struct.pack(">IIBBBBB", 8, 10, 8, 2, 0, 0, 0)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    body = zlib.compress(b"".join(lines))
    png = media.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", body[:50]) + chunk(b"IDAT", body[50:]) + chunk(b"IEND", b"")
    assert (media.decode_png(png) == rows).all()


def test_png_damage_is_named():
    png = media.encode_png(b"a" * 576)
    for at in (3, 20, 45, len(png) - 3):
        bad = bytearray(png)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(bad))
    with pytest.raises(ValueError):
        media.decode_png(png[:-5])


def test_media_columns(odd, empty, spark):
    df = media.to_media(odd)
    got = {r.doc_id: r for r in df.collect()}
    for i in (1, 3, 4, 8, 9):
        raw = (got[i].text or "").encode()
        assert got[i].n_bytes == len(raw)
        assert got[i].payload == raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    rep = {r.doc_id: r for r in media.report(df).collect()}
    assert rep[1].tail_crc32 == zlib.crc32(got[1].payload[-32:]) and rep[3].payload_bytes == 576 and rep[3].feature == rep[4].feature
    back = {r.doc_id: r for r in media.read_media(df.drop("payload")).collect()}
    assert back[8].payload == got[8].payload and back[8].phash == got[8].phash and back[8].media_error is None
    bad = spark.createDataFrame([(1, b"no png"), (2, None)], "doc_id long, media binary")
    assert {r.doc_id: r.media_error for r in media.read_media(bad).collect()} == {1: "signature", 2: "null"}
    assert media.report(media.to_media(empty)).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = ["http://a.com/x", "https://WWW.Example.COM/en/1?q#f", "http://example.com/en/", "http://x.example.com/en/9", "http://m.net/es/1", "http://m.net/fr", "http://m.net/fr/", "http://com/", "com/", None, "", "://", "a://b", "a://b?x/y", "a://b#://c/d", "x://é.net/es/ü", "http://notexample.com/en/", "http://com", "h://a.org/l\nm/n"]


def test_urls_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    for i, u in enumerate(URLS):
        host, path = brute_url(u)
        rule, verdict = brute_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_reputation_shrinks_and_blocks(spark):
    rows, labels = [], []
    for i in range(300):
        host = ["bad.spam.org", "good.fine.org", "one.fine.org"][0 if i < 120 else 1 if i < 299 else 2]
        rows.append((i, f"http://{host}/p{i}"))
        labels.append((i, i < 120))
    rows += [(400, "http://new.spam.org/"), (401, "http://new.fine.org/"), (402, "http://other.org/")]
    labels += [(5, True), (None, True), (6, None)]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")).collect()}
    assert got[0].verdict == "block" and got[130].verdict == "allow" and got[400].verdict == "block" and got[401].verdict == "allow"
    assert 0 < got[299].bad_rate < 0.5 and got[401].bad_rate < got[402].bad_rate < got[400].bad_rate
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "page_id long, bad boolean")).count() == 0


def luhn(d):
    digits = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0


def brute_pii(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]


def test_pii_base_equals_regular_expressions(spark):
    r = random.Random(5)
    pools = ["ab.@-_ 1", "0123456789 -", "0129. 5", "+0123456789 ().-", "a@b.c..d_e%+-1é😀\n", "a.@b1 \ue000\ue001"]
    rows = [(i, "".join(r.choice(pools[i % 6]) for _ in range(r.randrange(60)))) for i in range(3000)]
    rows += [(9000, "4111 1111 1111 1111 and 000255.1.2.3"), (9001, "1" * 30_000), (9002, "1 " * 20_000), (9003, "a@" + "b." * 20_000 + "c x"), (9004, "a.b@" * 10_000), (9005, "1.2.3." * 10_000), (9006, "+1" + "2 " * 20_000), (9007, None)]
    got = {r.doc_id: r for r in pii.report(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows:
        spans = brute_pii(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (i, (t or "")[:60])
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.KINDS)


def test_pii_context_discovers_and_redaction_takes_effect(spark):
    rows = [(i, f"please contact user{i}@mail{i}.example.com today") for i in range(9)] + [(100 + i, f"please contact user{i}-at-host{i} today") for i in range(3)] + [(200, "ordinal 3rd-place2 here"), (201, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_spans", F.lit("clash")).withColumn("row", F.lit(1))
    df = spark.createDataFrame([(r[0], f"we said: {r[1]}" if r[1] else None, r[2], r[3]) for r in df.collect()], df.schema)
    found = pii.find(df)
    by = {r.doc_id: r for r in found.collect()}
    assert all(len(by[100 + i].context) == 1 for i in range(3)) and by[200].context == [] and by[201].email == []
    clean = {r.doc_id: r for r in pii.redact(df, found).collect()}
    assert clean[0].text == "we said: please contact [EMAIL] today" and clean[100].text == "we said: please contact [CONTEXT] today"
    assert clean[200].text == "we said: ordinal 3rd-place2 here" and clean[201].text is None and clean[0]._spans == "clash"


def test_pii_patterns_come_from_whole_spans_and_masked_context(spark):
    rows = [(i, f"please call me at +1 (826) 555-{4081 + i} now") for i in range(5)] + [(10, "so call me at 8265554081 now")]
    rows += [(20 + i, f"he paid by card 4111 1111 1111 1111 or 10.0.0.{i} here") for i in range(5)] + [(30, "he paid by card 9876543210 or key-77-{} here")]
    rows += [(40 + i, f"write a{i}@x.example.com or b{i}@x.example.com") for i in range(5)] + [(50, "write a9@x.example.com or user-at-77")]
    rows += [(60 + i, f"10.1.1.{i} was seen") for i in range(4)] + [(70, "host-4711-a was seen")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text, by = dict(rows), {r.doc_id: r for r in pii.find(df).collect()}
    said = {i: [text[i][s.start : s.stop] for s in r.context] for i, r in by.items()}
    assert said[10] == ["8265554081"] and said[50] == ["user-at-77"] and said[70] == ["host-4711-a"]
    assert all(said[i] == [] for i, _ in rows if i not in (10, 30, 50, 70))
    assert [r.text for r in pii.redact(df.filter("doc_id = 10"), pii.find(df)).collect()] == ["so call me at [CONTEXT] now"]


def test_pii_of_odd_rows(odd, empty):
    found = pii.find(odd)
    assert found.count() == 12 and pii.redact(odd, found).count() == 12
    assert pii.report(pii.find(empty)).count() == 0


def test_hash_equals_the_definition():
    r = np.random.default_rng(8)
    image = r.integers(0, 256, (96, 64)).astype(np.uint8)
    grid = [[float(np.mean(image[3 * i : 3 * i + 3, 2 * j : 2 * j + 2].astype(float))) for j in range(32)] for i in range(32)]
    cos = lambda k, x: math.cos((2 * x + 1) * k * math.pi / 64)
    low = [round(sum(grid[y][x] * cos(u, y) * cos(v, x) for y in range(32) for x in range(32)), 6) for u in range(8) for v in range(8)]
    median = sorted(low[1:])[31]
    bits = [x > median for x in low]
    want = bytes(sum(1 << (7 - j) for j in range(8) if bits[8 * i + j]) for i in range(8))
    assert media.dct_hash(image) == want


def test_media_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "ab", 5, "m", "x", 1.5)], "doc_id long, text string, N_BYTES int, media string, payload string, other double")
    got = media.to_media(docs)
    assert got.columns == ["doc_id", "text", "other", "n_bytes", "payload", "media", "phash"]
    row = got.first()
    assert (row.n_bytes, row.other, bytes(row.payload)) == (2, 1.5, b"ab" + b"\xff" * 574)


def test_hosts_under_a_public_suffix_are_not_one_domain(spark):
    rows = [(i, f"http://bad.co.uk/{i}") for i in range(80)] + [(100 + i, f"http://site{i}.co.uk/") for i in range(40)] + [(300, "http://new.co.uk/"), (301, "http://www.bad.co.uk/")]
    labels = [(i, True) for i in range(80)] + [(100 + i, False) for i in range(40)]
    pages, said = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(pages, said).collect()}
    assert got[301].verdict == "block" and got[0].verdict == "block" and got[100].verdict == "allow"
    pooled = {r.page_id: r for r in url_filter.judge(pages, said, suffixes=["none.at"]).collect()}
    assert got[301].bad_rate > 0.9 > pooled[300].bad_rate == pooled[301].bad_rate and got[300].bad_rate < got[301].bad_rate


def test_long_and_repeated_urls(spark):
    long = "http://Long.example.net/es/" + "x" * 200_000 + "?q"
    pages = spark.createDataFrame([(1, long), (1, long), (None, "http://a.org/"), (2, "no mark")], "page_id long, url string")
    got = url_filter.judge(pages, spark.createDataFrame([(1, False), (1, True)], "page_id long, bad boolean")).collect()
    assert len(got) == 4 and sum(r.rule == "net/es/" and len(r.path) == 200_004 for r in got) == 2 and {r.host for r in got if r.page_id != 1} == {"a.org", ""}


def test_pii_secrets_lead_to_others_in_their_place(spark):
    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'my token = "{digest(i)}" is set') for i in range(9)] + [(20 + i, f'my token = "Qx-81zz{i}kP" is set') for i in range(3)]
    rows += [(30, f"commit {digest(99)} fixes it"), (31, 'the year = "1984" was cold'), (32, "see issue-4711 there")]
    by = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    said = {i: [text[i][s.start : s.stop] for s in r.context] for i, r in by.items()}
    assert all(said[i] == [digest(i)] for i in range(9)) and all(said[20 + i] == [f"Qx-81zz{i}kP"] for i in range(3))
    assert said[30] == said[31] == said[32] == []


def test_pii_finds_planted_identifiers_and_leaves_clean_texts(spark):
    r = random.Random(12)
    words = ["tree", "river", "stone", "cloud", "window", "paper"]
    filler = lambda: " ".join(r.choice(words) for _ in range(12))
    lead = ["write to", "reach us", "ring up"]
    rows, planted = [], {}
    for i in range(300):
        if i % 3 == 0:  # of the seeds' own forms
            rows.append((i, f"{filler()} {r.choice(lead)} u{i}@mail.example.com {filler()}"))
        elif i % 3 == 1:  # a form that no base pattern has
            planted[i] = f"u{i}-at-mail-{i}"
            rows.append((i, f"{filler()} {r.choice(lead)} {planted[i]} {filler()}"))
        else:
            rows.append((i, f"{filler()} section-{i} {filler()}"))
    text = dict(rows)
    by = {x.doc_id: [text[x.doc_id][s.start : s.stop] for s in x.context] for x in pii.find(spark.createDataFrame(rows, "doc_id long, text string"), rounds=3).collect()}
    caught = sum(by[i] == [planted[i]] for i in planted)
    assert caught == len(planted), caught
    assert all(not by[i] for i in by if i % 3 == 2)


def test_pii_of_many_spans_in_one_text(spark):
    text = " ".join(f"u{i}@mail.example.com 10.0.{i % 256}.{i % 9} id-{i:06d}x" for i in range(700))
    row = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = brute_pii(text)
    for kind in pii.KINDS:
        assert [(s.start, s.stop) for s in row[kind]] == [(a, b) for k, a, b in want if k == kind]
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string"), pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first().text
    assert clean.count("[EMAIL]") == 700 and clean.count("[IP]") == 700 and "@" not in clean
