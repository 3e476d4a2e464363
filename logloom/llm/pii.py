"""Format-preserving pseudonyms of personal data by Feistel networks, in DataFrame functions only.

Each kind finds its candidates with one pattern and validates them: card numbers by layout and Luhn sum, IPv4 addresses and
dates by range, telephone numbers and mail addresses by form. A valid value's characters are read as a number in the domain
of its format (card digits before the check digit, telephone digits but the first ones of area and exchange code, days,
address bytes, letters and digits of a mail name), split into two halves of sizes a and b and put through keyed rounds,
left := left + F(right) mod a, then right := right + F(left) mod b. Each round can be undone, so the map is a permutation of
the domain and needs no retries; then separators, length, case and check digit are put back. The rounds depend on key, kind
and length alone, so equal values get equal pseudonyms in all documents, and nothing is shuffled. F is HMAC-SHA256.

A run of digits, with single blanks or hyphens between its groups, may hold other numbers beside cards. Cards are looked for at
every group of a run: the groups from there on that make a card layout (CARD_LAYOUTS) of a length of CARD_LENGTHS with a right Luhn
sum, the first such length in that order; the search goes on behind them.

The key is a literal of the plan, as its two HMAC pads: where plans are kept (event logs, the history server), set
spark.sql.redaction.string.regex.

Defined results: a null or empty text stays as it is with zero counts; text outside valid values is not touched; what
one kind has replaced is looked at by the next kinds only where their patterns fit; rows repeat as they come;
null ids are kept; other columns stay as they are, whatever their names: a count whose name is taken has underscores behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import free_name

ROUNDS = 8
#: Bytes of a block of SHA-256.
HASH_BLOCK = 64
# Lengths of card numbers, the likeliest first, and the sizes of their groups of digits.
CARD_LENGTHS, CARD_LAYOUTS = (16, 15, 14, 19, 13, 18, 17), r"^(?:[0-9]+|(?:4 ){3,4}[1-4]|4 6 [45])$"
#: First and number of days of the date domain: 1900-01-01 to 2099-12-31; 73049 = 17 x 4297.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 17, 4297


@dataclass(frozen=True)
class Kind:
    """A pattern (Java syntax) and what stands for a match: struct (text, valid), with the number of valid values in it."""

    name: str
    pattern: str
    mapped: Callable[[Column, str], Column]


def _whole(valid: Callable[[Column], Column], mapped: Callable[[Column, str], Column]) -> Callable[[Column, str], Column]:
    """A match that is one value or none."""
    return lambda value, secret: _let(F.coalesce(valid(value), F.lit(False)), lambda ok: F.struct(F.when(ok, mapped(value, secret)).otherwise(value).alias("text"), ok.cast("int").alias("valid")))


def keyed_hash(secret: str, message: Column) -> Column:
    """HMAC-SHA256 of a text, in hexadecimal digits."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > HASH_BLOCK else key).ljust(HASH_BLOCK, b"\0")
    inner, outer = (F.lit(bytes(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def feistel(left: Column, right: Column, a: Column, b: Column, secret: str, tweak: Column, back: bool = False) -> Column:
    """Struct (left, right) after the rounds; left is in 0..a-1, right in 0..b-1. back: the inverse."""

    def draw(value: Column, number: Column) -> Column:
        # 60 bits of a keyed hash.
        text = F.concat_ws("|", tweak, number.cast("string"), value.cast("string"))
        return F.conv(F.substring(keyed_hash(secret, text), 1, 15), 16, 10).cast("long")

    def step(at: Column, number: Column) -> Column:
        if back:
            right_ = F.pmod(at["right"] - F.pmod(draw(at["left"], number * 2 + 1), b), b)
            return _let(right_, lambda x: F.struct(F.pmod(at["left"] - F.pmod(draw(x, number * 2), a), a).alias("left"), x.alias("right")))
        left_ = F.pmod(at["left"] + F.pmod(draw(at["right"], number * 2), a), a)
        return _let(left_, lambda x: F.struct(x.alias("left"), F.pmod(at["right"] + F.pmod(draw(x, number * 2 + 1), b), b).alias("right")))

    order = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(order, F.struct(left.cast("long").alias("left"), right.cast("long").alias("right")), step)


def permute_digits(digits: Column, secret: str, tweak: str, radix: int = 10, back: bool = False) -> Column:
    """A string of digits (of radix 10 or 36) to one of the same length. A single digit has two factors of the radix as halves."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    small = {10: 2, 36: 6}[radix]

    def number(text: Column) -> Column:
        return F.coalesce(F.conv(text, radix, 10).cast("long"), F.lit(0).cast("long"))

    def spelled(value: Column, size: Column) -> Column:
        return F.when(size > 0, F.lpad(F.lower(F.conv(value.cast("string"), 10, radix)), size, "0")).otherwise("")

    one, whole = n == 1, number(digits)
    size = [F.pow(F.lit(float(radix)), k.cast("double")).cast("long") for k in (half, n - half)]
    left = F.when(one, F.floor(whole / (radix // small))).otherwise(number(F.substring(digits, F.lit(1), half)))
    right = F.when(one, whole % (radix // small)).otherwise(number(F.substring(digits, half + 1, n)))
    sizes = F.when(one, F.lit(small).cast("long")).otherwise(size[0]), F.when(one, F.lit(radix // small).cast("long")).otherwise(size[1])
    done = feistel(left, right, *sizes, secret, F.concat(F.lit(f"{tweak}:"), n.cast("string")), back)
    joined = lambda x: F.concat(spelled(x["left"], half), spelled(x["right"], n - half))
    return _let(done, lambda x: F.when(one, spelled(x["left"] * (radix // small) + x["right"], n)).otherwise(joined(x)))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum, counted from the right, modulo 10."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(places, F.lit(0), add) % 10


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, signs: Column, pattern: str = "^[0-9]$") -> Column:
    """The signs in the places of the value's signs that fit the pattern, letters in the case of the place."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(at: Column, sign: Column) -> Column:
        own = sign.rlike(pattern)
        new = F.substring(signs, at["i"] + 1, F.lit(1))
        return F.struct((at["i"] + own.cast("int")).alias("i"), F.concat(at["out"], F.when(own, F.when(sign.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)).otherwise(sign)).alias("out"))

    return F.aggregate(F.split(value, ""), start, put, lambda at: at["out"])


def _cards(g: Column) -> Column:
    """The cards among groups of digits: struct (next, out), out with (gap, first, last), the groups since the card before and those of the card."""

    def last(a: Column) -> Column:
        # The last group of a card that begins with group a; NULL if there is none.
        sizes = F.transform(F.slice(g, a, 5), F.length)
        sums = F.transform(F.sequence(F.lit(1), F.size(sizes)), lambda k: F.aggregate(F.slice(sizes, 1, k), F.lit(0), lambda n, x: n + x))

        def end(ends: Column) -> Column:
            def is_card(k: Column) -> Column:
                own = F.slice(g, a, k)
                layout = F.array_join(F.transform(own, lambda x: F.length(x).cast("string")), " ")
                return F.when((k > 0) & layout.rlike(CARD_LAYOUTS), luhn_sum(F.array_join(own, "")) == 0).otherwise(False)

            counts = F.transform(F.array(*[F.lit(n) for n in CARD_LENGTHS]), lambda n: F.array_position(ends, n).cast("int"))
            return F.try_element_at(F.filter(counts, is_card), F.lit(1)) + a - 1

        return _let(sums, end)

    def add(done: Column, a: Column) -> Column:
        here = F.when((a >= done["next"]) & (F.length(F.element_at(g, a)) <= max(CARD_LENGTHS)), last(a))
        card = lambda b: F.struct(done["next"].alias("gap"), a.alias("first"), b.alias("last"))
        return _let(here, lambda b: F.when(b.isNull(), done).otherwise(F.struct((b + 1).alias("next"), F.concat(done["out"], F.array(card(b))).alias("out"))))

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<gap:int,first:int,last:int>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.size(g)), start, add)


def _card(run: Column, secret: str) -> Column:
    """The run with its cards replaced, and their number."""

    def build(body: Column) -> Column:
        return F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0")))) % 10).cast("string"))

    def replaced(g: Column, card: Column) -> Column:
        own = F.slice(g, card["first"], card["last"] - card["first"] + 1)
        body = _let(F.array_join(own, ""), lambda d: permute_digits(F.substring(d, F.lit(1), F.length(d) - 1), secret, "card"))

        def dealt(new: Column) -> Column:
            before = lambda k: F.length(F.array_join(F.slice(own, 1, k), ""))
            return F.transform(own, lambda x, k: F.substring(new, before(k) + 1, F.length(x)))

        return F.concat(F.slice(g, card["gap"], card["first"] - card["gap"]), _let(_let(body, build), dealt))

    def woven(g: Column, found: Column) -> Column:
        new = F.concat(F.flatten(F.transform(found["out"], lambda c: replaced(g, c))), F.slice(g, found["next"], F.size(g) - found["next"] + 1))
        text = _woven(new, F.regexp_extract_all(run, F.lit("[^0-9]"), F.lit(0)))
        return F.struct(F.when(F.size(found["out"]) > 0, text).otherwise(run).alias("text"), F.size(found["out"]).alias("valid"))

    return _let(F.regexp_extract_all(run, F.lit("[0-9]+"), F.lit(0)), lambda g: _let(_cards(g), lambda found: woven(g, found)))


def _phone(value: Column, secret: str) -> Column:
    # The country code and the first digits of area and exchange code stay; the other eight digits are permuted.
    digits = _digits(value)
    kept = F.length(digits) - 10
    own = F.concat(F.substring(digits, kept + 2, F.lit(2)), F.substring(digits, kept + 5, F.lit(6)))
    new = permute_digits(own, secret, "phone")
    whole = _let(new, lambda x: F.concat(F.substring(digits, F.lit(1), kept + 1), F.substring(x, 1, 2), F.substring(digits, kept + 4, F.lit(1)), F.substring(x, 3, 6)))
    return _laid_out(value, whole)


def _ipv4(value: Column, secret: str) -> Column:
    b = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    done = feistel(b[0] * 256 + b[1], b[2] * 256 + b[3], F.lit(65536), F.lit(65536), secret, F.lit("ipv4"))
    return _let(done, lambda x: F.concat_ws(".", F.floor(x["left"] / 256), x["left"] % 256, F.floor(x["right"] / 256), x["right"] % 256))


def _date_format(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-"), "yyyy-MM-dd").when(value.rlike(r"^\d{4}/"), "yyyy/MM/dd").when(value.rlike(r"^\d{2}\."), "dd.MM.yyyy").otherwise("MM/dd/yyyy")


def _day(value: Column) -> Column:
    return F.datediff(F.try_to_timestamp(value, _date_format(value)).cast("date"), F.lit(FIRST_DAY).cast("date"))


def _date(value: Column, secret: str) -> Column:
    day = _day(value)
    done = feistel(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), secret, F.lit("date"))
    new = _let(done, lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (x["left"] * DAYS_B + x["right"]).cast("int")))
    return _let(new, lambda d: F.when(value.rlike(r"^\d{4}-"), F.date_format(d, "yyyy-MM-dd")).when(value.rlike(r"^\d{4}/"), F.date_format(d, "yyyy/MM/dd")).when(value.rlike(r"^\d{2}\."), F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))


def _mail(value: Column, secret: str) -> Column:
    # Letters and digits of the name are permuted, up to 16 of them at once, whatever stands between them; that and the domain stay.
    name, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    parts = F.regexp_extract_all(F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit("[a-z0-9]{1,16}"), F.lit(0))
    new = F.array_join(F.transform(parts, lambda r: permute_digits(r, secret, "mail", 36)), "")
    return F.concat(_let(new, lambda x: _laid_out(name, x, "^[A-Za-z0-9]$")), F.lit("@"), domain)


def _woven(pieces: Column, between: Column) -> Column:
    return F.array_join(F.zip_with(pieces, between, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")


# Patterns of the kinds, in the order in which they are replaced.
KINDS = (
    Kind("mail", r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,126}\.[A-Za-z]{2,}", _whole(lambda v: F.length(v) <= 254, _mail)),
    Kind("card", r"(?<![0-9A-Za-z])(?=[0-9](?:[ -]?[0-9]){12})[0-9]++(?![A-Za-z])(?:[ -][0-9]++(?![A-Za-z]))*+", _card),
    Kind("ipv4", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])", _whole(lambda v: F.lit(True), _ipv4)),
    Kind("phone", r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])", _whole(lambda v: F.lit(True), _phone)),
    Kind("date", r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z/-])", _whole(lambda v: _day(v).between(0, DAYS_A * DAYS_B - 1), _date)),
)


def pseudonymise(docs: DataFrame, secret: str, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text") -> DataFrame:
    """The rows with valid values of the text replaced, and a count n_<kind> of each kind."""
    columns, out = list(docs.columns), docs
    for kind in kinds:
        text, held, count = F.col(text_col), free_name("pii", out.columns), free_name(f"n_{kind.name}", columns)
        matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        # What stands for each match, and the pieces between them.
        mapped = F.transform(matches, _replacement(kind, secret))
        changed = F.when(F.regexp_like(text, F.lit(kind.pattern)), F.struct(mapped.alias("new"), F.split(text, kind.pattern, -1).alias("pieces")))
        out = out.withColumn(held, changed)
        new = F.col(held)["new"]
        number = F.aggregate(new, F.lit(0).cast("long"), lambda n, x: n + x["valid"])
        woven = _woven(F.col(held)["pieces"], F.transform(new, lambda x: x["text"]))
        out = out.withColumn(count, F.coalesce(number, F.lit(0).cast("long"))).withColumn(text_col, F.when(F.col(held).isNull(), text).otherwise(woven)).drop(held)
        columns.append(count)
    return out


def _replacement(kind: Kind, secret: str) -> Callable[[Column], Column]:
    return lambda match: kind.mapped(match, secret)
