"""Personal data replaced by pseudonyms of the same format, in DataFrame expressions only.

Numbers and dates that pass their check (Luhn digit, octet range, numbering plan, calendar) are
permuted by a keyed Feistel network inside the set of valid values of their format: two halves over
Z_a x Z_b take turns adding a keyed hash of the other half modulo their own size, which is a bijection
whatever the hash. A valid value stays valid, different values stay different, and the same value gets
the same pseudonym in every document, so links between documents survive. Marks between digits stay
where they are. Mail addresses and secrets have no such set of values; they become a keyed hash.

Each line of a text is split at its findings and joined again around their pseudonyms, in one pass over
each row without a shuffle. Lines that cannot hold a finding are passed on untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EPOCH = "1900-01-01"
SPAN_DAYS = (200, 365)  # the halves of a day number; further days are permuted within blocks of this size

# What may be private, in the order in which alternatives are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9.-]{0,250}\.[A-Za-z]{2,24}",
    "secret": r"\bAKIA[0-9A-Z]{16}\b"
    r"|\b(?:password|passwd|secret|token|api_key|apikey)\b[ \t]{0,3}[:=][ \t]{0,3}(?:\"[^\"\n]{6,200}\"|'[^'\n]{6,200}'|[^\s\"',;]{6,200})",
    "ip": r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![\w-])"
    r"|(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w])",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-])",
}
MAY = "[0-9@:=]|AKIA"  # every finding has one of these
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
NUMBER = f"^(?:{PATTERNS['phone']}|{PATTERNS['card']})$"
PIECES = "array<struct<gap:string,old:string>>"


def _hash(key: str, *parts: Column) -> Column:
    """A keyed 60-bit number."""
    hexed = F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts]), 256)
    return F.conv(F.substring(hexed, 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, a: int | Column, b: int | Column, key: str, tweak: Column) -> Column:
    """(l, r): a keyed permutation of Z_a x Z_b; null halves give null."""
    a, b = (x if isinstance(x, Column) else F.lit(x) for x in (a, b))
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(state: Column, n: Column) -> Column:
        even = n % 2 == 0
        other = F.when(even, state["r"]).otherwise(state["l"])
        step = _hash(key, tweak, n, other)
        return F.struct(
            F.when(even, F.pmod(state["l"] + F.pmod(step, a), a)).otherwise(state["l"]).alias("l"),
            F.when(even, state["r"]).otherwise(F.pmod(state["r"] + F.pmod(step, b), b)).alias("r"),
        )

    return F.reduce(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _refill(value: Column, digits: Column) -> Column:
    """`value` with its digits, from left to right, taken from `digits`."""

    def put(state: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, F.substr(digits, state["at"], F.lit(1))).otherwise(c)).alias("out"),
            F.when(is_digit, state["at"] + 1).otherwise(state["at"]).alias("at"),
        )

    return F.reduce(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put)["out"]


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a digit string, its last digit counted once."""
    places = F.sequence(F.lit(1), F.length(digits))

    def weigh(total: Column, k: Column) -> Column:
        d = F.substr(digits, k, F.lit(1)).cast("int")
        twice = (F.length(digits) - k) % 2 == 1
        return total + F.when(~twice, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.reduce(places, F.lit(0), weigh)


def _let(value: Column, use) -> Column:
    """`use(value)` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _padded(value: Column, width: Column | int) -> Column:
    return F.lpad(value.cast("string"), width, F.lit("0")) if isinstance(width, Column) else F.lpad(value.cast("string"), width, "0")


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def card(value: Column, key: str) -> Column:
    """A Luhn-valid number of 13 to 19 digits; the first digit stays, the check digit is made anew."""

    def permute(d: Column) -> Column:
        n = F.length(d)
        left = F.floor((n - 2) / 2).cast("int")
        right = n - 2 - left
        state = feistel(
            F.substr(d, F.lit(2), left), F.substr(d, left + 2, right), _power(left), _power(right), key,
            F.concat(F.lit("card"), F.substr(d, F.lit(1), F.lit(1)), n.cast("string")),
        )

        def close(s: Column) -> Column:
            body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _padded(s["l"], left), _padded(s["r"], right))
            return _let(body, lambda x: F.concat(x, F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

        return F.when(F.length(d).between(13, 19) & (_luhn(d) % 10 == 0), _refill(value, _let(state, close)))

    return _let(_digits(value), permute)


def phone(value: Column, key: str) -> Column:
    """Numbers of the North American plan stay in it; others keep their first two digits."""

    def permute(d: Column) -> Column:
        n = F.length(d)
        lead = F.substr(d, F.lit(1), n - 10)
        area = F.substr(d, n - 9, F.lit(3)).cast("long") - 200
        exchange = F.substr(d, n - 6, F.lit(3)).cast("long") - 200
        line = F.substr(d, n - 3, F.lit(4))
        plan = _let(
            feistel(area * 800 + exchange, line, 640_000, 10_000, key, F.lit("phone")),
            lambda s: F.concat(
                lead, (F.floor(s["l"] / 800) + 200).cast("string"), (s["l"] % 800 + 200).cast("string"), _padded(s["r"], 4)
            ),
        )
        left = F.floor((n - 2) / 2).cast("int")
        right = n - 2 - left
        other = _let(
            feistel(
                F.substr(d, F.lit(3), left), F.substr(d, left + 3, right), _power(left), _power(right), key,
                F.concat(F.lit("phone"), F.substr(d, F.lit(1), F.lit(2)), n.cast("string")),
            ),
            lambda s: F.concat(F.substr(d, F.lit(1), F.lit(2)), _padded(s["l"], left), _padded(s["r"], right)),
        )
        home = ~F.startswith(value, F.lit("+")) | F.startswith(value, F.lit("+1"))
        planned = home & n.isin(10, 11) & (area >= 0) & (exchange >= 0)
        return F.when(planned, _refill(value, plan)).when(n.between(8, 15), _refill(value, other))

    return _let(_digits(value), permute)


def ip(value: Column, key: str) -> Column:
    """Four octets up to 255, permuted as 32 bits."""

    def permute(p: Column) -> Column:
        octet = [p[k].cast("long") for k in range(4)]
        state = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], 65_536, 65_536, key, F.lit("ip"))
        valid = (octet[0] < 256) & (octet[1] < 256) & (octet[2] < 256) & (octet[3] < 256)
        return F.when(valid, _let(state, lambda s: F.concat_ws(
            ".", *[x.cast("string") for x in (F.floor(s["l"] / 256), s["l"] % 256, F.floor(s["r"] / 256), s["r"] % 256)]
        )))

    return _let(F.split(value, r"\."), permute)


def ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""

    def permute(d: Column) -> Column:
        area, group, serial = (F.substr(d, F.lit(a), F.lit(n)).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
        place = area - 1 - (area > 666).cast("long")
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        state = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, F.lit("ssn"))

        def close(s: Column) -> Column:
            at = F.floor(s["l"] / 99).cast("long")
            return F.concat_ws(
                "-", _padded(at + 1 + (at >= 665).cast("long"), 3), _padded(s["l"] % 99 + 1, 2), _padded(s["r"] + 1, 4)
            )

        return F.when(valid, _let(state, close))

    return _let(_digits(value), permute)


def date(value: Column, key: str) -> Column:
    """A calendar date in its own layout; day first where both readings are valid."""
    layouts = ["yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "M/d/yyyy", "d.M.yyyy"]
    a, b = SPAN_DAYS

    def read(day: Column, layout: str) -> Column:
        number = F.datediff(day, F.lit(EPOCH).cast("date"))
        block = F.floor(number / (a * b))
        at = F.pmod(number, F.lit(a * b))
        state = feistel(F.floor(at / b), at % b, a, b, key, F.concat(F.lit("date"), block.cast("string")))
        moved = _let(state, lambda s: F.date_add(
            F.lit(EPOCH).cast("date"), (block * (a * b) + s["l"] * b + s["r"]).cast("int")
        ))
        wide = layout.replace("d/M", "dd/MM").replace("M/d", "MM/dd").replace("d.M", "dd.MM") if layout[0] != "y" else layout
        return _let(moved, lambda m: F.date_format(m, wide))

    def attempt(layout: str) -> Column:
        return F.when(
            F.try_to_timestamp(value, F.lit(layout)).isNotNull(),
            _let(F.try_to_timestamp(value, F.lit(layout)).cast("date"), lambda day: read(day, layout)),
        )

    return F.coalesce(*[attempt(x) for x in layouts])


def email(value: Column, key: str) -> Column:
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat(F.lit(f"{key}|email|"), F.lower(value)), 256), 1, 16), F.lit("@example.invalid"))


def secret(value: Column, key: str) -> Column:
    """The name before a value stays; the value becomes a keyed hash."""
    name = F.regexp_extract(value, r"^([A-Za-z_]+\s*[:=]\s*)?", 1)
    return F.concat(name, F.lit("removed-"), F.substring(F.sha2(F.concat(F.lit(f"{key}|secret|"), value), 256), 1, 16))


def pseudonym(value: Column, key: str) -> Column:
    """(kind, new) of a finding; both null if it fails its check and stays."""
    makers = {"email": email, "secret": secret, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}

    def named(kind: str, new: Column) -> Column:
        return _let(new, lambda n: F.when(n.isNotNull(), F.struct(F.lit(kind).alias("kind"), n.alias("new"))))

    # a number that fails one check may pass the next
    made = F.coalesce(*[
        F.when(value.rlike(f"^(?:{PATTERNS[k]})$"), named(k, make(value, key))) for k, make in makers.items()
    ])
    return made


def _failing(value: Column) -> Column:
    """Whether a phone or card number fails its check."""
    phone_, card_ = (value.rlike(f"^(?:{PATTERNS[k]})$") for k in ("phone", "card"))
    d = _digits(value)
    passes = phone_ & F.length(d).between(8, 15) | card_ & F.length(d).between(13, 19) & (_luhn(d) % 10 == 0)
    return value.rlike(NUMBER) & ~passes


def _taken(value: Column) -> Column:
    """The part of a finding that is taken: all, or as far as the end of a digit group.

    That is the longest such part that passes as a phone or card number, else the first digit group.
    """
    ends = F.filter(
        F.sequence(F.length(value) - 1, F.lit(1), F.lit(-1)),
        lambda k: F.substr(value, k, F.lit(2)).rlike("^[0-9][^0-9]$"),
    )
    parts = F.filter(
        F.transform(ends, lambda k: F.substr(value, F.lit(1), k)), lambda v: v.rlike(NUMBER) & ~_failing(v)
    )
    shorter = F.coalesce(F.get(parts, F.lit(0)), F.regexp_extract(value, "^[^0-9]*[0-9]+", 0))
    return F.when(_failing(value), shorter).otherwise(value)


def stepwise(line: Column) -> Column:
    """The pieces (gap, old) of a line, searched from finding to finding.

    What a shortened finding leaves is searched again with the text after it.
    """
    start = F.struct(F.array().cast(PIECES).alias("pieces"), F.concat(F.lit("\n"), line).alias("rest"))

    def turn(state: Column, _: Column) -> Column:
        rest = state["rest"]  # its first character is only looked back at

        def step(gap: Column) -> Column:
            old = _taken(F.regexp_extract(F.substr(rest, F.length(gap)), f"(?s)^.({ANY})", 1))
            return _let(old, lambda o: F.struct(
                F.concat(state["pieces"], F.array(F.struct(F.substr(gap, F.lit(2)).alias("gap"), o.alias("old")))).alias("pieces"),
                F.substr(rest, F.length(gap) + F.length(o)).alias("rest"),
            ))

        tail = F.struct(F.substr(rest, F.lit(2)).alias("gap"), F.lit(None).cast("string").alias("old"))
        end = F.struct(F.concat(state["pieces"], F.array(tail)).alias("pieces"), F.lit(None).cast("string").alias("rest"))
        gap = F.regexp_extract(rest, f"(?s)^(.+?)(?:{ANY})", 1)
        return F.when(rest.isNull(), state).otherwise(_let(gap, lambda g: F.when(g == "", end).otherwise(step(g))))

    # every step but the last takes one of these away
    most = F.size(F.regexp_extract_all(line, F.lit("([0-9]+|[@:=]|AKIA)"), F.lit(1))) + 1
    return F.reduce(F.sequence(F.lit(1), most), start, turn)["pieces"]


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """`docs` with pseudonyms in `text`; `found`, if named, gets an array of (kind, old, new).

    Null texts stay null, empty texts empty; other columns, whatever their names, are passed on. Values
    that fail their check, also in part, stay as they are.
    """
    source = F.col(f"`{text}`")

    def findings(line: Column) -> Column:
        def pieces(found: Column) -> Column:
            plain = F.zip_with(
                F.split(line, ANY, -1), found, lambda gap, old: F.struct(gap.alias("gap"), old.alias("old"))
            )
            return F.when(F.exists(found, _failing), stepwise(line)).otherwise(plain)

        return F.when(line.rlike(MAY), _let(F.regexp_extract_all(line, F.lit(f"({ANY})"), F.lit(1)), pieces))

    def named(pieces: Column) -> Column:
        return F.transform(pieces, lambda p: F.struct(
            p["gap"].alias("gap"), p["old"].alias("old"), pseudonym(p["old"], key).alias("made")
        ))

    def restore(line: Column, pieces: Column) -> Column:
        parts = F.transform(pieces, lambda p: F.concat(p["gap"], F.coalesce(p["made"]["new"], p["old"], F.lit(""))))
        return F.when(F.size(pieces) > 1, F.array_join(parts, "")).otherwise(line)

    taken = {c.lower() for c in docs.columns}
    held = next(n for k in range(len(taken) + 1) if (n := f"__found{k}") not in taken)
    lines = F.split(source, "\n", -1)
    with_pairs = docs.withColumn(held, F.when(source.rlike(MAY), F.transform(lines, findings)))
    with_pairs = with_pairs.withColumn(held, F.transform(held, named))
    pairs = F.col(held)
    any_found = F.exists(pairs, lambda ps: F.size(ps) > 1)
    replaced = F.when(any_found, F.array_join(F.zip_with(lines, pairs, restore), "\n")).otherwise(source)
    columns = [replaced.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if found:
        present = F.coalesce(F.filter(pairs, lambda ps: ps.isNotNull()), F.array().cast(with_pairs.schema[held].dataType))
        kept = F.filter(F.flatten(present), lambda p: p["made"].isNotNull())
        columns.append(
            F.transform(
                kept, lambda p: F.struct(p["made"]["kind"].alias("kind"), p["old"].alias("old"), p["made"]["new"].alias("new"))
            ).alias(found)
        )
    return with_pairs.select(*columns)
