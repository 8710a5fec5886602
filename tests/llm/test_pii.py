import datetime as dt
import hashlib
import re

import pytest

from terradrift.llm import pii as P

KEY = "a key for tests"


def permute(kind, x, radix, key=KEY):
    """The permutation again, in plain Python."""
    digits = "0123456789abcdefghijklmnopqrstuvwxyz"
    out = ""
    for i in range(0, len(x), P.MOST_CHARS):
        t = x[i : i + P.MOST_CHARS]
        if len(t) == 1:
            ranked = sorted(range(radix), key=lambda n: int(hashlib.sha256(f"{key}|{kind}|one|{n}".encode()).hexdigest()[:15], 16))
            out += digits[ranked[digits.index(t)]]
            continue
        u = len(t) // 2
        v = len(t) - u
        a, b = int(t[:u] or "0", radix), int(t[u:] or "0", radix)
        for r in range(P.ROUNDS):
            size = radix ** (u if r % 2 == 0 else v)
            h = int(hashlib.sha256(f"{key}|{kind}:{len(t)}|{r}|{b}".encode()).hexdigest()[:15], 16)
            a, b = b, (a + h % size) % size

        def show(n, w):
            s = ""
            for _ in range(w):
                s, n = digits[n % radix] + s, n // radix
            return s

        out += show(a, u) + show(b, v)
    return out


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def run(make, rows):
    return {r["doc_id"]: r for r in P.pseudonymise(make(rows), KEY).collect()}


def test_cards_stay_valid_and_linked(make):
    got = run(make, [(1, "pay 4111 1111 1111 1111 or 4111-1111-1111-1111."), (2, "4111111111111111"), (3, "4111111111111112"), (4, "x4111111111111111"), (5, "0000000000000000")])
    a, b = [v["value"] for v in got[1]["found"]]
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", a) and luhn(a.replace(" ", "")) and a.replace(" ", "-") == b
    assert got[2]["text"] == a.replace(" ", "") != "4111111111111111"
    assert got[2]["text"][:-1] == permute("card", "411111111111111", 10)
    assert [got[i]["text"] for i in (3, 4, 5)] == ["4111111111111112", "x4111111111111111", "0000000000000000"]


def test_dates_numbers_and_mail(make):
    got = run(make, [(1, "born 2024-02-29, 29.02.2024; 2/29/2024 or 2023-02-29"), (2, "from 10.0.0.255 not 300.1.1.1"), (3, "call +1 (017) 555-7713!"), (4, "ssn 123-45-6789, 000-12-3456"), (5, "mail A.b9@x.org"), (6, "v1.2.3 at 12:30")])
    iso, dotted, us = [v["value"] for v in got[1]["found"]]
    day = dt.date.fromisoformat(iso)
    assert dotted == day.strftime("%d.%m.%Y") and us == f"{day.month}/{day.day:02d}/{day.year}" and day != dt.date(2024, 2, 29)
    assert got[1]["text"].endswith("or 2023-02-29")
    (ip,) = [v["value"] for v in got[2]["found"]]
    assert all(0 <= int(p) <= 255 for p in ip.split(".")) and "300.1.1.1" in got[2]["text"]
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4}!", got[3]["text"]) and "555-7713" not in got[3]["text"]
    (ssn,) = [v["value"] for v in got[4]["found"]]
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and not re.match("000|666|9", ssn)
    assert re.fullmatch(r"mail [A-Z0-9]\.[a-z0-9]{2}@x\.org", got[5]["text"])
    assert got[6]["text"] == "v1.2.3 at 12:30" and got[6]["found"] == []


def test_address_in_a_text_without_digits(make):
    got = run(make, [(1, "write to john.smith@example.com"), (2, "7 to john.smith@example.com"), (3, "no data")])
    (a,), (b,) = [[(v["kind"], v["value"]) for v in got[i]["found"]] for i in (1, 2)]
    assert a == b and a[0] == "email" and a[1] != "john.smith@example.com" and got[1]["text"] == "write to " + a[1]
    assert got[3]["text"] == "no data" and got[3]["found"] == []


def test_permutation_has_no_collisions(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("x"))
    got = rows.select("x", P.permute_string(KEY, "t", F.col("x"), 10).alias("y")).collect()
    assert len({r["y"] for r in got}) == 1000 and all(r["y"] == permute("t", r["x"], 10) for r in got)
    odd = spark.createDataFrame([("7",), ("z9",), ("abc" * 11,), ("",)], "x string")
    for r in odd.select("x", P.permute_string(KEY, "t", F.col("x"), 36).alias("y")).collect():
        assert r["y"] == permute("t", r["x"], 36)


def test_edges(make):
    long = "word " * 50_000 + "4111111111111111 " + "tail"
    got = run(make, [(1, None), (2, ""), (3, long), (None, "4111111111111111")])
    assert (got[1]["text"], got[2]["text"]) == (None, "") and got[1]["found"] == got[2]["found"] == []
    assert got[3]["text"].split()[-2] == got[None]["text"] and len(got[3]["text"]) == len(long)
    assert P.report(make([]), KEY).collect() == []


def valid_date(m):
    p = re.split("[-/.]", m)
    try:
        if len(p[0]) == 4:
            day = dt.date(int(p[0]), int(p[1]), int(p[2]))
        elif int(p[1]) > 12:
            day = dt.date(int(p[2]), int(p[0]), int(p[1]))
        else:
            day = dt.date(int(p[2]), int(p[1]), int(p[0]))
    except ValueError:
        return False
    return 1900 <= day.year <= 2099


def plain_kind(m):
    """Kind of a match by the first pattern that fits it and holds, and what becomes of it where that is simple to say."""
    def merged(chars, span=m):
        new = iter(chars)
        return "".join((n.upper() if c.isupper() else n) if c.isalnum() and (n := next(new)) else c for c in span)

    for kind, pattern in P.PATTERNS.items():
        if not re.fullmatch(pattern, m):
            continue
        d = re.sub("[^0-9]", "", m)
        if kind == "email":
            local, domain = m.split("@")
            return kind, merged(permute("email", re.sub("[^a-z0-9]", "", local.lower()), 36), local) + "@" + domain
        if kind == "ipv4" and all(int(x) <= 255 for x in m.split(".")):
            return kind, None
        if kind == "ssn" and not re.match("000|666|9|...00|.*0000$", d):
            return kind, None
        if kind == "date" and valid_date(m):
            return kind, None
        if kind == "phone" and 8 <= len(d) <= 15:
            code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", m)
            rest = m[code.end() :] if code else m
            return kind, m[: len(m) - len(rest)] + merged(permute("phone", re.sub("[^0-9]", "", rest), 10), rest)
        if kind == "card":
            first = re.match(P._CARD_FIRST, m)
            for span in (m, first[1] if first else ""):
                d = re.sub("[^0-9]", "", span)
                if d and luhn(d) and set(d) != {"0"}:
                    body = permute("card", d[:-1], 10)
                    check = next(c for c in "0123456789" if luhn(body + c))
                    return kind, merged(body + check, span) + m[len(span) :]
    return None


def test_report_against_brute_force(spark, make):
    """Detection, precedence, counts and the text, with notations that overlap or only look alike."""
    parts = ["4111 1111 1111 1111 123", "4111 1111 1111 1111 12/27", "3782 822463 10005 77", "4111111111111111", "4111-1111-1111-1112", "555-123-4567", "555.123.4567", "555-123-45678", "a@b.cd", "X.Y@Z-q.org", "10.0.0.1", "10.0.0.1.5", "256.1.1.1", "123-45-6789", "000-45-6789", "2024-02-30", "1999-12-31", "31/12/1999", "12/31/1999", "31.12.1899", "+49 30 1234567", "(030) 1234 567", "+1-555-123-4567", "v1.2", "x555-123-4567", "0000 0000 0000 0000", "end.", "and", "12345678901234567890", "j@k"]
    import random

    rng = random.Random(17)
    rows = [(k, " ".join(rng.choice(parts) for _ in range(rng.randrange(1, 12)))) for k in range(120)] + [(900 + k, p) for k, p in enumerate(parts)]
    got = {r["doc_id"]: r for r in P.report(make(rows), KEY).collect()}
    text = {r["doc_id"]: r["text"] for r in P.pseudonymise(make(rows), KEY).collect()}
    seen = set()
    for i, t in rows:
        matches = [(m, plain_kind(m)) for m in re.findall(f"({P._any()})", t)]
        kinds = [k for _, k in matches if k]
        assert got[i]["n_found"] == len(kinds) == len(got[i]["pseudonyms"]), (i, t)
        for kind in P._KINDS:
            assert got[i][f"n_{kind}"] == sum(k == kind for k, _ in kinds), (i, t, kind)
        for made, (kind, value) in zip(got[i]["pseudonyms"], kinds, strict=True):
            assert made.startswith(kind + ":") and (value is None or made == f"{kind}:{value}"), (i, t, made, value)
            seen.add(kind)
        outside = re.split(P._any(), t)
        assert text[i].startswith(outside[0]) and text[i].endswith(outside[-1]) and len(text[i]) == len(t) or any(k in ("ipv4", "date") for k, _ in kinds)
        assert got[i]["text_sha256"] == hashlib.sha256(text[i].encode()).hexdigest()
    assert seen == set(P._KINDS)


def test_key_is_needed_and_not_shown(make):
    docs = make([(1, "a@b.org")])
    with pytest.raises(ValueError):
        P.pseudonymise(docs, "")
    secret = "do-not-print-me"
    plan = P.report(docs, secret)._jdf.queryExecution().toString()
    assert secret not in plan
    assert P.report(docs, secret).first()["pseudonyms"] != P.report(docs, KEY).first()["pseudonyms"]
