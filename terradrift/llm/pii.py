"""Format-preserving pseudonyms of personal numbers and dates, by keyed Feistel permutations.

Values are found by pattern and validated (Luhn sum of card numbers, octets of IPv4 addresses, reserved
ranges of social security numbers, digit counts of phones, the calendar for dates); what does not validate stays as it
is. A value is then permuted within its own format: the same separators, length and validity, so a card
number becomes a card number and a date a date. The permutation depends on the key, the kind and the
value alone, never on the document or the notation, so equal values stay linked across documents and
notations. Local parts of mail addresses are permuted the same way over letters and digits; capitals stay capitals.
Of a run of digits that is no card number as a whole, the card number before its last group is taken (a card with its code).
Phones are those in brackets, with a plus sign, or as 3-3-4 digits with dots or hyphens.

The key is needed: whoever has it can invert the pseudonyms. It reaches the expressions as a column from a one-row table,
so no plan or event log shows it.

A round adds a keyed SHA-256 of one half to the other, modulo the half's size; eight rounds. Domains that are
no power of the radix (dates, reserved ranges) walk the cycle until the value is valid again.

Everything is built of SQL functions over each row: no shuffle, no Python, and a cost linear in the text.
Nulls: a null text stays null with nothing found. Empty texts, repeated rows, empty tables and other columns
need no care: each row is mapped alone and only doc_id and text are read. An empty key is refused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Characters that are permuted together; longer strings in blocks of this length.
MOST_CHARS = 20
#: Steps of a cycle at most; each is valid with a probability of 0.89 or more.
WALK = 40

# Fixed patterns, in order of precedence. Nothing that a word or number continues on either side matches.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}",
    "ipv4": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "date": r"(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![-/.]?[0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])|[0-9]{3}\.[0-9]{3}\.[0-9]{4}(?!\.?[0-9])",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
#: Sixteen digits by four, or fifteen as 4-6-5, with more behind them.
_CARD_FIRST = r"^([0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\3[0-9]{5})[ -]"
_BEFORE = r"(?<![A-Za-z0-9_.@+-])"
#: Days since 1900-01-01 up to 2099-12-31, and two factors whose product is little more.
DAYS, DAY_HIGH, DAY_LOW = 73049, 271, 270


def _any() -> str:
    """All patterns in one, back references renumbered away: both separators of a date are listed."""
    date = "|".join(rf"[0-9]{{4}}{s}[0-9]{{1,2}}{s}[0-9]{{1,2}}|[0-9]{{1,2}}{s}[0-9]{{1,2}}{s}[0-9]{{4}}" for s in ("-", "/", r"\."))
    kinds = PATTERNS | {"date": rf"(?:{date})(?![-/.]?[0-9])"}
    return _BEFORE + "(?:" + "|".join(kinds.values()) + ")"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _hash(key: Column | str, *parts) -> Column:
    """60 keyed bits."""
    text = F.concat_ws("|", F.lit(key) if isinstance(key, str) else key, *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _rounds(key: Column, tweak: Column, a: Column, b: Column, size_a: Column, size_b: Column) -> Column:
    """struct(a, b) of numbers below size_a and size_b after an even number of rounds."""

    def step(s, i):
        size = F.when(i % 2 == 0, size_a).otherwise(size_b)
        return F.struct(s["b"].alias("a"), F.pmod(s["a"] + F.pmod(_hash(key, tweak, i, s["b"]), size), size).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def permute_string(key: Column, kind: str, x: Column, radix: int) -> Column:
    """A string over the radix's digits (lower case) to another of its length."""
    powers = F.array(*[F.lit(radix**i) for i in range(MOST_CHARS // 2 + 1)])
    number = lambda t: F.when(F.length(t) == 0, F.lit(0)).otherwise(F.conv(t, radix, 10).cast("long"))
    text = lambda v, width: F.when(width == 0, "").otherwise(F.lpad(F.lower(F.conv(v.cast("string"), 10, radix)), width, "0"))

    def block(t: Column) -> Column:
        def halves(n: Column) -> Column:
            u = F.floor(n / 2).cast("int")
            v = n - u
            tweak = F.concat_ws(":", F.lit(kind), n.cast("string"))
            done = _rounds(key, tweak, number(F.substr(t, F.lit(1), u)), number(F.substr(t, u + 1, v)), F.get(powers, u), F.get(powers, v))
            return let(done, lambda d: F.concat(text(d["a"], u), text(d["b"], v)))

        # one symbol has no halves: the symbols in the order of their keyed hashes
        ranked = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(radix - 1)), lambda i: F.struct(_hash(key, kind, "one", i).alias("h"), i.alias("i"))))
        return F.when(F.length(t) == 1, text(F.get(ranked, number(t).cast("int"))["i"], F.lit(1))).otherwise(let(F.length(t), halves))

    many = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / MOST_CHARS).cast("int")), lambda i: let(F.substr(x, i * MOST_CHARS + 1, F.lit(MOST_CHARS)), block))
    return F.when(F.length(x) == 0, x).otherwise(F.array_join(many, ""))


def _merge(m: Column, chars: Column, pattern: str) -> Column:
    """m with those of its characters that match pattern replaced by chars, one after another, capitals by capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def step(s, c):
        new = F.substr(chars, s["k"], F.lit(1))
        new = F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)
        return F.when(c.rlike(pattern), F.struct(F.concat(s["out"], new).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k")))

    return F.aggregate(F.split(m, ""), start, step, lambda s: s["out"])


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_sum(d: Column) -> Column:
    def add(s, i):
        return s + let(F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int"), lambda v: F.when(i % 2 == 1, v).when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)


def _card(key: Column, m: Column) -> Column:
    def new(span: Column) -> Column:
        def permuted(d: Column) -> Column:
            body = permute_string(key, "card", F.substr(d, F.lit(1), F.length(d) - 1), 10)
            whole = let(body, lambda p: F.concat(p, F.pmod(-luhn_sum(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")))
            valid = (F.length(d) > 0) & (luhn_sum(d) % 10 == 0) & ~d.rlike("^0+$")
            return F.when(valid, _merge(span, whole, "^[0-9]$"))

        return let(_digits(span), permuted)

    first = F.regexp_extract(m, _CARD_FIRST, 1)
    return F.coalesce(new(m), let(first, lambda f: F.concat(new(f), F.substr(m, F.length(f) + 1, F.length(m)))))


def _ipv4(key: Column, m: Column) -> Column:
    def new(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i)).cast("int")
        valid = (part(0) <= 255) & (part(1) <= 255) & (part(2) <= 255) & (part(3) <= 255)
        done = _rounds(key, F.lit("ipv4"), part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536))
        show = lambda v: F.concat_ws(".", F.floor(v / 256).cast("string"), (v % 256).cast("string"))
        return F.when(valid, let(done, lambda d: F.concat_ws(".", show(d["a"]), show(d["b"]))))

    return let(F.split(m, r"\."), new)


def _ssn_valid(d: Column) -> Column:
    return ~d.rlike("^(000|666|9)") & ~d.rlike("^...00") & ~d.rlike("0000$")


def _ssn(key: Column, m: Column) -> Column:
    def walk(d: Column) -> Column:
        once = permute_string(key, "ssn", d, 10)
        return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once, lambda x, _: F.when(_ssn_valid(x), x).otherwise(permute_string(key, "ssn", x, 10)))

    return let(_digits(m), lambda d: F.when(_ssn_valid(d), _merge(m, walk(d), "^[0-9]$")))


def _phone(key: Column, m: Column) -> Column:
    """The country code after a plus sign stays."""
    code = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)

    def new(code: Column) -> Column:
        rest = F.substr(m, F.length(code) + 1, F.length(m))
        n = F.length(_digits(m))
        return F.when(n.between(8, 15), F.concat(code, let(permute_string(key, "phone", _digits(rest), 10), lambda p: _merge(rest, p, "^[0-9]$"))))

    return let(code, new)


def _date(key: Column, m: Column) -> Column:
    """Year first, or last; with the year last, day before month unless only month before day is a date."""
    def new(p: Column) -> Column:
        part = lambda i: F.get(p, F.lit(i))
        year_first = F.length(part(0)) == 4
        swap = ~year_first & (part(1).cast("int") > 12)
        y = F.when(year_first, part(0)).otherwise(part(2))
        mo = F.when(year_first | ~swap, part(1)).otherwise(part(0))
        d = F.when(year_first, part(2)).when(swap, part(1)).otherwise(part(0))
        day = F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        ordinal = F.datediff(day, F.lit("1900-01-01").cast("date"))

        def once(v: Column) -> Column:
            done = _rounds(key, F.lit("date"), F.floor(v / DAY_LOW), v % DAY_LOW, F.lit(DAY_HIGH), F.lit(DAY_LOW))
            return let(done, lambda r: r["a"] * DAY_LOW + r["b"])

        def show(v: Column) -> Column:
            new_day = F.date_add(F.lit("1900-01-01").cast("date"), v.cast("int"))
            sep = F.regexp_extract(m, "[-/.]", 0)
            wide = lambda x, like: F.lpad(x.cast("string"), F.when(F.length(like) == 2, 2).otherwise(F.length(x.cast("string"))), "0")
            yy, mm, dd = F.lpad(F.year(new_day).cast("string"), 4, "0"), wide(F.month(new_day), mo), wide(F.day(new_day), d)
            return F.when(year_first, F.concat(yy, sep, mm, sep, dd)).when(swap, F.concat(mm, sep, dd, sep, yy)).otherwise(F.concat(dd, sep, mm, sep, yy))

        def permuted(v: Column) -> Column:
            walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(v), lambda x, _: F.when(x < DAYS, x).otherwise(once(x)))
            return let(walked, show)

        return let(ordinal, lambda v: F.when((v >= 0) & (v < DAYS), permuted(v)))

    return let(F.split(m, "[-/.]"), new)


def _email(key: Column, m: Column) -> Column:
    at = F.instr(m, "@")
    local, domain = F.substr(m, F.lit(1), at - 1), F.substr(m, at, F.length(m))
    chars = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return F.concat(let(permute_string(key, "email", chars, 36), lambda p: _merge(local, p, "^[A-Za-z0-9]$")), domain)


_KINDS = {"email": _email, "ipv4": _ipv4, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def _pseudonym(key: Column, m: Column) -> Column:
    """struct(kind, value): the pseudonym of a match by the first kind that it is of and valid for; else nulls."""
    none = F.lit(None).cast("struct<kind:string,value:string>")
    out = none

    def named(kind: str) -> Column:
        return let(_KINDS[kind](key, m), lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))).otherwise(none))

    for kind in reversed(list(_KINDS)):
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), named(kind)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and found: array of struct(kind, value) in order of occurrence."""
    if not key:
        raise ValueError("pseudonyms need a key")
    pattern = _any()
    secret = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    docs = docs.select("doc_id", "text", secret.alias("secret"))
    some = F.col("text").rlike("[0-9@]")  # every pattern has a digit or, of addresses, an at sign
    barrier = lambda c: F.explode(F.array(c))  # noqa: E731  keeps the optimizer from computing c twice
    rows = docs.select("doc_id", "text", "secret", barrier(F.when(some, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias("matches"))
    made = F.transform("matches", lambda m: _pseudonym(F.col("secret"), m))
    rows = rows.select("doc_id", "text", "matches", barrier(F.when(F.size("matches") > 0, made)).alias("made"))
    new = F.zip_with("matches", "made", lambda m, p: F.coalesce(p["value"], m))
    pieces = F.zip_with(F.split("text", pattern), new, lambda t, p: F.concat(t, F.coalesce(p, F.lit(""))))
    text = F.when(F.size("matches") > 0, F.array_join(pieces, "")).otherwise(F.col("text"))
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    return rows.select("doc_id", text.alias("text"), F.coalesce(F.filter("made", lambda p: p.isNotNull()), empty).alias("found"))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, a count per kind, the found pseudonyms, and the SHA-256 of the new text."""
    done = pseudonymise(docs, key)
    of = lambda kind: F.size(F.filter("found", lambda p: p["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in _KINDS]
    values = F.transform("found", lambda p: F.concat_ws(":", p["kind"], p["value"]))
    return done.select("doc_id", F.size("found").cast("long").alias("n_found"), *counts, values.alias("pseudonyms"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
