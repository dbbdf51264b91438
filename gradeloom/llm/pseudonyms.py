"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

Found and validated values are replaced by keyed permutations of their own format, so equal values
stay equal in all documents and different ones stay different:

* card numbers (12 to 19 digits, Luhn): the first digit stays, the check digit is computed anew;
* phone numbers (3-3-4 digits, country code allowed): code and punctuation stay, digits that could
  start an area or exchange code (2-9) stay such digits;
* social security numbers (3-2-4 digits, area not 000, 666 or 9xx, no zero group): stay valid;
* IPv4 addresses (each part at most 255);
* IBANs (mod 97): the country stays, letters stay letters, the check digits are computed anew;
* dates (ISO, dd.mm.yyyy, mm/dd/yyyy; 1900 to 2099; checked against the calendar): another such day;
* e-mail addresses: the domain stays, letters and digits before it stay letters and digits.

The permutation is an additive Feistel network over the value's symbols: in each of ``ROUNDS``
rounds the symbols at even or odd places move within their own alphabet by a keyed SHA-256 of the
other half. Where a format has invalid values, the network is applied again until the value is
valid (cycle walking), which keeps it a permutation.

Card numbers and IBANs are looked for inside whole runs of groups, as neighbours join them to one
run ("4111 1111 1111 1111 12/26", "BE68 5390 0754 7034 I am"): every place of the run where a card
of a usual grouping may stand, and every border of an IBAN's groups, is tried against the check
digits. A first pass marks what is valid, a second one replaces the marked values and all others, so
what stands next to a card is found as if it stood alone.

Defined results: null texts stay null, texts without such values stay as they are, invalid values
(a failing check digit, an impossible date) are left alone, and all other columns pass through; a
column ``n_replaced`` of the input gives way to the count. Texts that hold one of the two marks
(U+FDD0 and U+FDD1, which no text should) are searched in one pass, whole runs only. The key comes
from the setting ``spark.gradeloom.pseudonym.key``; without it a demonstration key is used, which
protects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, WALK = 8, 24
KEY, KEY_SETTING = "gradeloom demonstration key", "spark.gradeloom.pseudonym.key"
ON, OFF = "\ufdd0", "\ufdd1"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?<![0-9.-])(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9](?![0-9-])"
DOT_DATE = r"(?<![0-9.])[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2}(?![0-9])(?!\.[0-9])"
SLASH_DATE = r"(?<![0-9/])[01]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2}(?![0-9/])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])"
SECURITY = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"
PLAIN = (ISO_DATE, DOT_DATE, SLASH_DATE, ADDRESS, SECURITY, PHONE)
PERSONAL = "|".join((EMAIL, IBAN, *PLAIN, CARD))
#: Runs that may hold card numbers, and the places in them where one may stand.
RUN = r"(?<![0-9])[0-9][0-9 -]{10,}[0-9](?![0-9])"
STANDING = r"(?<![0-9])(?=((?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4}|3[0-9]{3}([ -])[0-9]{6}\3[0-9]{4,5})(?![0-9])))"
MARKABLE = "|".join((EMAIL, IBAN, *PLAIN, RUN))
REPLACED = "|".join((f"{ON}[^{OFF}]*{OFF}", EMAIL, *PLAIN))


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def _chars(text: Column) -> Column:
    """The characters of a string; none for an empty one."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def _keyed(*parts) -> Column:
    """A keyed number of 60 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def feistel(values: Column, bases: Column, key: str, kind: str) -> Column:
    """Permute an array of symbols, each below the base at its place, by a keyed additive Feistel network."""

    def turn(state: Column, i: Column) -> Column:
        other = F.array_join(F.filter(state, lambda _, j: (j + i) % 2 == 1), ",")
        return F.transform(state, lambda x, j: F.when((j + i) % 2 == 0, (x + _keyed(F.lit(key), F.lit(kind), i, j, F.size(state), other)) % F.get(bases, j)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), values.cast("array<long>"), turn)


def walk(values: Column, bases: Column, key: str, kind: str, valid) -> Column:
    """Apply the network once, then again while the result is not valid."""

    def again(state: Column, i: Column) -> Column:
        return F.when((i > 1) & valid(state), state).otherwise(feistel(state, bases, key, kind))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), values.cast("array<long>"), again)


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), lambda c: c.cast("long"))


def _poured(text: Column, symbols: Column, places: str) -> Column:
    """The text with the characters of the class ``places`` replaced in turn by the symbols."""
    rest = F.split(text, places, -1)
    return F.array_join(F.zip_with(rest, F.concat(symbols.cast("array<string>"), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_sum(digits: Column) -> Column:
    """Sum of digits with every second from the right, the last one excluded, doubled."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, j: F.when((n - j) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, b: a + b)


def _card(text: Column, key: str) -> Column:
    def replaced(d: Column) -> Column:
        n = F.size(d)
        inner = F.slice(d, F.lit(2), n - 2)
        moved = F.concat(F.slice(d, 1, 1), feistel(inner, F.transform(inner, lambda x: F.lit(10).cast("long")), key, "card"))
        full = _let(moved, lambda m: F.concat(m, F.array((10 - luhn_sum(F.concat(m, F.array(F.lit(0).cast("long")))) % 10) % 10)))
        return F.when(luhn_sum(d) % 10 == 0, _poured(text, full, "[0-9]")).otherwise(text)

    return _let(_digits(text), replaced)


def _phone(text: Column, key: str) -> Column:
    # A country code is what stands before the last ten digits.
    head = F.regexp_extract(text, r"^(.*?)(?=\(?[0-9]{3}\)?[ .-]*[0-9]{3}[ .-][0-9]{4}$)", 1)
    body = F.substr(text, F.length(head) + 1)

    def replaced(d: Column) -> Column:
        start = lambda j: j.isin(0, 3)
        low = F.transform(d, lambda x, j: F.when(start(j) & (x > 1), 2).otherwise(0).cast("long"))
        base = F.transform(d, lambda x, j: F.when(~start(j), 10).when(x > 1, 8).otherwise(2).cast("long"))
        return _let(F.struct(low.alias("low"), base.alias("base")), lambda s: F.zip_with(feistel(F.zip_with(d, s["low"], lambda a, b: a - b), s["base"], key, "phone"), s["low"], lambda a, b: a + b))

    return F.concat(head, _poured(body, _let(_digits(body), replaced), "[0-9]"))


def _security(text: Column, key: str) -> Column:
    def valid(d: Column) -> Column:
        area = F.get(d, 0) * 100 + F.get(d, 1) * 10 + F.get(d, 2)
        last = F.aggregate(F.slice(d, 6, 4), F.lit(0).cast("long"), lambda a, b: a + b)
        return (area > 0) & (area != 666) & (area < 900) & (F.get(d, 3) + F.get(d, 4) > 0) & (last > 0)

    tens = F.array_repeat(F.lit(10).cast("long"), 9)
    return _let(_digits(text), lambda d: F.when(valid(d), _poured(text, walk(d, tens, key, "security", valid), "[0-9]")).otherwise(text))


def _address(text: Column, key: str) -> Column:
    parts = F.transform(F.split(text, r"\."), lambda p: p.cast("long"))
    bases = F.array_repeat(F.lit(256).cast("long"), 4)
    return _let(parts, lambda p: F.when(F.array_max(p) < 256, F.array_join(feistel(p, bases, key, "address").cast("array<string>"), ".")).otherwise(text))


DAYS, SIDE = 73049, 271  # days from 1900-01-01 up to 2099-12-31; 271 * 271 is the next square


def _date(text: Column, key: str, form: str) -> Column:
    """``form``: the date's own pattern for reading; one- and two-digit parts are written with two digits."""
    day = F.try_to_timestamp(text, F.lit(form)).cast("date")
    number = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
    valid = lambda s: F.get(s, 0) * SIDE + F.get(s, 1) < DAYS
    sides = F.array_repeat(F.lit(SIDE).cast("long"), 2)
    moved = walk(F.array(F.floor(number / SIDE).cast("long"), number % SIDE), sides, key, "date", valid)
    there = F.date_add(F.lit("1900-01-01").cast("date"), _let(moved, lambda s: (F.get(s, 0) * SIDE + F.get(s, 1)).cast("int")))
    written = form.replace("d", "dd").replace("M", "MM") if "-" not in form else form
    return F.when(day.isNull(), text).otherwise(F.date_format(there, written))


def _letters(text: Column, key: str, kind: str) -> Column:
    """Letters and digits of a string move within their alphabets; case and all other characters stay."""

    def replaced(chars: Column) -> Column:
        low = F.transform(chars, F.lower)
        base = F.transform(low, lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[a-z]"), 26).otherwise(1).cast("long"))
        value = F.transform(low, lambda c: F.when(c.rlike("[0-9]"), c.try_cast("long")).when(c.rlike("[a-z]"), (F.ascii(c) - 97).cast("long")).otherwise(F.lit(0).cast("long")))
        moved = _let(base, lambda b: feistel(value, b, key, kind))

        def back(c: Column, x: Column) -> Column:
            letter = F.char((x + 97).cast("long"))
            return F.when(c.rlike("[0-9]"), x.cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

        return F.array_join(F.zip_with(chars, moved, back), "")

    return _let(_chars(text), replaced)


def _email(text: Column, key: str) -> Column:
    return F.concat(_letters(F.substring_index(text, "@", 1), key, "email"), F.lit("@"), F.substring_index(text, "@", -1))


def mod97(text: Column) -> Column:
    """Remainder of an IBAN-like string whose first four characters count last."""
    turned = F.concat(F.substr(text, F.lit(5)), F.substr(text, F.lit(1), F.lit(4)))
    number = lambda c: F.when(c.rlike("[0-9]"), c.try_cast("long")).otherwise((F.ascii(c) - 55).cast("long"))
    return F.aggregate(_chars(turned), F.lit(0).cast("long"), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + number(c)).otherwise(a * 100 + number(c)) % 97)


def _iban(text: Column, key: str) -> Column:
    def replaced(plain: Column) -> Column:
        rest = _letters(F.substr(plain, F.lit(5)), key, "iban")
        country = F.substr(plain, F.lit(1), F.lit(2))
        new = _let(rest, lambda r: F.concat(country, F.lpad((98 - mod97(F.concat(country, F.lit("00"), r))).cast("string"), 2, "0"), r))
        return F.when(mod97(plain) == 1, _poured(text, _chars(new), "[A-Z0-9]")).otherwise(text)

    return _let(F.replace(text, F.lit(" "), F.lit("")), replaced)


def _mark(value: Column) -> Column:
    return F.concat(F.lit(ON), value, F.lit(OFF))


def _mark_cards(run: Column) -> Column:
    """A run of digit groups with the valid card numbers in it marked, or the whole run if that is one."""
    valid = lambda c: luhn_sum(_digits(c)) % 10 == 0
    found = F.filter(F.array_distinct(F.regexp_extract_all(run, F.lit(STANDING), F.lit(1))), valid)
    # A card that overlaps a marked one no longer stands there in one piece.
    marked = lambda cards: F.aggregate(cards, run, lambda r, c: F.regexp_replace(r, F.concat(F.lit("(?<![0-9])"), c, F.lit("(?![0-9])")), F.lit(f"{ON}$0{OFF}")))
    return _let(found, lambda cards: F.when(F.size(cards) > 0, marked(cards)).when(run.rlike(_whole(CARD)) & valid(run), _mark(run)).otherwise(run))


def _mark_iban(run: Column) -> Column:
    """The longest valid IBAN that starts a run and ends with one of its groups, marked."""
    def marked(groups: Column) -> Column:
        start = lambda k: F.array_join(F.slice(groups, F.lit(1), k), " ")
        plain = lambda k: F.array_join(F.slice(groups, F.lit(1), k), "")
        sizes = F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda k: F.length(plain(k)).between(12, 34) & (mod97(plain(k)) == 1))
        return F.when(F.size(sizes) > 0, F.concat(_mark(start(F.get(sizes, F.lit(0)))), F.substr(run, F.length(start(F.get(sizes, F.lit(0)))) + 1))).otherwise(run)

    return _let(F.split(run, " "), marked)


def _poured_values(text: Column, pattern: str, values: Column) -> Column:
    """The text with its matches of a pattern replaced in turn by the values."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(values, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _marked(text: Column) -> Column:
    """The text with its valid card numbers and IBANs marked."""
    def one(v: Column) -> Column:
        other = v.contains("@") | v.rlike("|".join(map(_whole, PLAIN)))
        return F.when(other, v).when(v.rlike("^[A-Z]"), _mark_iban(v)).otherwise(_mark_cards(v))

    return _poured_values(text, MARKABLE, F.transform(F.regexp_extract_all(text, F.lit(MARKABLE), F.lit(0)), one))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """The pseudonym of one found value, or the value itself where it is not valid; marks go."""
    bare = F.translate(value, ON + OFF, "")
    return _let(bare, lambda v: (
        F.when(v.contains("@"), _email(v, key))
        .when(v.rlike("^[A-Z]"), _iban(v, key))
        .when(v.rlike(_whole(ISO_DATE)), _date(v, key, "yyyy-MM-dd"))
        .when(v.rlike(_whole(DOT_DATE)), _date(v, key, "d.M.yyyy"))
        .when(v.rlike(_whole(SLASH_DATE)), _date(v, key, "M/d/yyyy"))
        .when(v.rlike(_whole(ADDRESS)), _address(v, key))
        .when(v.rlike(_whole(SECURITY)), _security(v, key))
        .when(v.rlike(_whole(PHONE)), _phone(v, key))
        .otherwise(_card(v, key))
    ))


def _fresh(docs: DataFrame, name: str) -> str:
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """``docs`` with the personal values of a text column replaced and ``n_replaced`` added."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    text = F.col(column).cast("string")
    work, found = _fresh(docs, "marked_text"), _fresh(docs, "found_values")
    odd = text.rlike(f"[{ON}{OFF}]")
    with_group = text.rlike("[0-9]")
    w = F.col(work)
    kept = docs.withColumn(work, F.when(with_group & ~odd, _marked(text)).otherwise(text))
    values = F.when(odd, F.regexp_extract_all(text, F.lit(PERSONAL), F.lit(0))).when(w.rlike("[0-9@]"), F.regexp_extract_all(w, F.lit(REPLACED), F.lit(0)))
    pairs = F.transform(values, lambda v: F.struct(F.translate(v, ON + OFF, "").alias("old"), pseudonym(v, key).alias("new")))
    kept = kept.withColumn(found, F.when(F.size(values) > 0, pairs))
    f = F.col(found)
    poured = F.when(odd, _poured_values(text, PERSONAL, f["new"])).otherwise(_poured_values(w, REPLACED, f["new"]))
    changed = F.size(F.filter(found, lambda x: x["old"] != x["new"]))
    return kept.withColumns({column: F.when(f.isNotNull(), poured).otherwise(text), "n_replaced": F.when(f.isNotNull(), changed).otherwise(0).cast("long")}).drop(work, found)
