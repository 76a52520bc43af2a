"""PII pseudonyms by format-preserving Feistel networks; DataFrame functions only.

One pattern finds the candidates, left to right, each is validated, and a valid one is replaced by its image under a
keyed permutation of the values of its own format: a card stays a card with a right check digit, a date stays a date.
Cards, IBANs and phone numbers may have blanks inside, so a candidate can take in words and numbers beside it: of such a
one, all stretches of groups are tried, and from each group on the longest valid one is replaced, those of the usual
length of their country or issuer first.
The permutation works on the value without its punctuation, so equal values have equal pseudonyms in all documents and
notations, and nobody without the key can go back. Rows are changed in place: no shuffle, nothing shared between rows.

| Kind | Valid if | Permuted |
| --- | --- | --- |
| email | pattern | letters and digits before the @, each within its class |
| iban | remainder 1 by 97 | all behind the check digits, which are made anew |
| ipv4 | four numbers to 255 | 32 bits |
| date | in the calendar, 1700 to 2099 | the day within these 400 years (27 x 5411 days) |
| ssn | no forbidden area, group or serial | area x (group, serial) |
| phone | 7 to 15 digits | the digits behind the country code |
| card | 13 to 19 digits, check digit right | all but the check digit, which is made anew |
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citespark.llm.common import query, table

ROUNDS = 8
KINDS = ("email", "iban", "ipv4", "date", "ssn", "phone", "card")
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ipv4": r"(?<![\p{L}\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\d]|\.\d)",
    "date": r"(?<![\p{L}\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!(?!T\d\d)[\p{L}\d]|[./-]\d)",
    "ssn": r"(?<![\p{L}\d.-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|-\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:(?! (?:\d{4}-\d\d-\d\d|\d\d?\.\d\d?\.\d{4})(?!\d))[ .-]?\d{2,4}){2,4}(?!\d)"
             r"|(?<![\p{L}\d.-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\p{L}\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\p{L}\d-])",
    "card": r"(?<![\p{L}\d.-])\d(?:[ -]?\d){12,18}(?![\p{L}\d]|-\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
BLANKS = ("iban", "phone", "card")  # kinds whose values may have blanks inside
# Numbers behind a candidate of these kinds, which may begin inside what the candidate took in.
BEHIND = r"(?: [(+]?\d++\)?(?:[./-]?\d++)*+(?![\p{L}\d@_%+:/-]|\.[\p{L}\d])){0,24}+"
MOST_GROUPS = 19  # no kind has more groups, as no card has more digits
# Length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL", 29: "BR EG PS QA UA", 30: "JO KW MU",
    31: "MT SC", 32: "LC"}
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
           "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")


def bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def joined(text: Column, use) -> Column:
    """``use(character, place from 1)`` over a text, put together."""
    return F.when(F.length(text) > 0, F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda i: use(F.substring(text, i, F.lit(1)), i)), "")).otherwise("")


def shifted(char: Column, by: Column) -> Column:
    """The character that lies ``by`` places further in its class; one of no class stays."""
    out = char
    for letters in CLASSES:
        out = F.when(F.position(char, F.lit(letters)) > 0, F.substring(
            F.lit(letters), (F.position(char, F.lit(letters)) - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def feistel_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the texts with the same classes of characters, place by place."""

    def mixed(target: Column, source: Column, n: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), n.cast("string"), F.lit("|"), source), 512)
        return bound(digest, lambda h: joined(target, lambda c, i: shifted(
            c, F.conv(F.substring(h, (i - 1) % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int"))))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("l"),
                     F.substring(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda a, n: F.struct(
        F.when(n % 2 == 1, mixed(a["l"], a["r"], n)).otherwise(a["l"]).alias("l"),
        F.when(n % 2 == 0, mixed(a["r"], a["l"], n)).otherwise(a["r"]).alias("r")),
        lambda a: F.concat(a["l"], a["r"]))


def feistel_number(number: Column, left: int, right: int, key: str, kind: str) -> Column:
    """A keyed permutation of the numbers from 0 below ``left * right``."""

    def drawn(source: Column, n: Column) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{key}|{kind}|"), n.cast("string"), F.lit("|"), source.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    start = F.struct(F.floor(number / right).cast("long").alias("l"), (number.cast("long") % right).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda a, n: F.struct(
        F.when(n % 2 == 1, (a["l"] + drawn(a["r"], n)) % left).otherwise(a["l"]).alias("l"),
        F.when(n % 2 == 0, (a["r"] + drawn(a["l"], n)) % right).otherwise(a["r"]).alias("r")),
        lambda a: a["l"] * right + a["r"])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def laid(text: Column, value: Column) -> Column:
    """``text`` with its letters and digits replaced, in order, by the characters of ``value``."""
    return joined(text, lambda c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.substring(value, F.length(F.regexp_replace(
        F.substring(text, F.lit(1), i), r"[^\p{L}\p{N}]", "")), F.lit(1))).otherwise(c))


def luhn_sum(text: Column, first: int) -> Column:
    """The sum of the digits from the right, every other one doubled, beginning with the one at ``first`` (0 or 1)."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(text, F.length(text) - i, F.lit(1)).cast("int")
        twice = 2 * digit - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == first, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(text) - 1), F.lit(0), step)


def by_97(text: Column) -> Column:
    """The remainder by 97 of digits and capital letters, A read as 10."""

    def step(total: Column, i: Column) -> Column:
        char = F.substring(text, i, F.lit(1))
        return F.when(char.rlike("[0-9]"), (total * 10 + char.cast("int")) % 97).otherwise(
            (total * 100 + F.ascii(char) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def email(m: Column, key: str) -> Column:
    name, rest = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    signs = F.regexp_replace(name, r"[^\p{L}\p{N}]", "")
    return bound(feistel_text(signs, key, "email"), lambda p: F.concat(laid(name, p), F.lit("@"), rest))


def iban(m: Column, key: str) -> Column:
    def of(v: Column) -> Column:
        body = feistel_text(F.substring(v, F.lit(5), F.length(v)), key, "iban")
        country = F.substring(v, 1, 2)
        made = bound(body, lambda b: F.concat(country, F.lpad((98 - by_97(F.concat(b, country, F.lit("00")))).cast(
            "string"), 2, "0"), b))
        sure = by_97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1
        return F.when(sure & F.length(v).between(15, 34), bound(made, lambda p: laid(m, p)))

    return bound(F.replace(m, F.lit(" "), F.lit("")), of)


def ipv4(m: Column, key: str) -> Column:
    parts = F.split(m, r"\.")
    octets = [parts[k].cast("int") for k in range(4)]
    number = sum((octets[k].cast("long") * 256 ** (3 - k) for k in range(1, 4)), octets[0].cast("long") * 256**3)
    return F.when(F.greatest(*octets) <= 255, bound(feistel_number(number, 65536, 65536, key, "ipv4"), lambda n: F.concat_ws(
        ".", *[(F.shiftright(n, 24 - 8 * k) % 256).cast("string") for k in range(4)])))


def date(m: Column, key: str) -> Column:
    """A day before a month where both readings are in the calendar."""
    first = F.to_date(F.lit("1700-01-01"))
    parts = F.split(m, "[-./]")
    iso = m.rlike("^[0-9]{4}-")

    def day(y, mo, d):
        return F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    usual = F.when(iso, day(parts[0], parts[1], parts[2])).otherwise(day(parts[2], parts[1], parts[0]))
    turned = F.when(~iso, day(parts[2], parts[0], parts[1]))
    sign = F.substring(F.regexp_replace(m, "[0-9]", ""), 1, 1)

    def made(d: Column) -> Column:
        new = F.date_add(first, feistel_number(F.datediff(d, first), 27, 5411, key, "date").cast("int"))
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(
            usual.isNotNull(), F.concat_ws("", F.date_format(new, "dd"), sign, F.date_format(new, "MM"), sign,
                                           F.date_format(new, "yyyy"))).otherwise(
            F.concat_ws("", F.date_format(new, "MM"), sign, F.date_format(new, "dd"), sign, F.date_format(new, "yyyy")))

    return bound(F.coalesce(usual, turned), lambda d: F.when(F.year(d).between(1700, 2099), made(d)))


def ssn(m: Column, key: str) -> Column:
    parts = F.split(m, "-")
    area, group, serial = (parts[k].cast("int") for k in range(3))
    sure = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    place = area - F.when(area > 666, 2).otherwise(1)
    number = place.cast("long") * (99 * 9999) + (group - 1) * 9999 + serial - 1

    def made(n: Column) -> Column:
        place = F.floor(n / (99 * 9999))
        area = place + F.when(place >= 665, 2).otherwise(1)
        rest = n % (99 * 9999)
        return F.concat_ws("-", F.lpad(area.cast("string"), 3, "0"), F.lpad((F.floor(rest / 9999) + 1).cast("string"), 2, "0"),
                           F.lpad((rest % 9999 + 1).cast("string"), 4, "0"))

    return F.when(sure, bound(feistel_number(number, 898, 99 * 9999, key, "ssn"), made))


def phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+([0-9]{1,3})(?=[ .(-])", 1)

    def of(d: Column) -> Column:
        own = F.substring(d, F.length(country) + 1, F.length(d))
        return F.when(F.length(d).between(7, 15), bound(F.concat(country, feistel_text(own, key, "phone")),
                                                        lambda p: laid(m, p)))

    return bound(digits(m), of)


def card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        made = bound(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0), bound(made, lambda p: laid(m, p)))

    return bound(digits(m), of)


MAKERS = {"email": email, "iban": iban, "ipv4": ipv4, "date": date, "ssn": ssn, "phone": phone, "card": card}


def usual(m: Column, kind: str) -> Column:
    """Whether a value has the length that its country or issuer gives it."""
    value = F.regexp_replace(m, r"[^\p{L}\p{N}]", "")
    size = F.length(value)
    if kind == "iban":
        country = F.substring(value, 1, 2)
        return F.coalesce(*[F.when(country.isin(names.split()), size == n) for n, names in IBAN_LENGTHS.items()], F.lit(True))
    if kind not in BLANKS:
        return F.lit(True)
    if kind == "phone":
        return F.when(m.rlike(r"^\+1[^0-9]|^[^+]"), size == F.when(m.startswith("+"), 11).otherwise(10)).otherwise(
            ~m.rlike("[ .-](19|20)[0-9]{2}$"))
    return size == F.when(value.rlike("^3[47]"), 15).when(value.rlike("^3[068]"), 14).otherwise(16)


def stretches(m: Column, kinds: list[str], key: str) -> Column:
    """array of (text, kind) that make up ``m``: from left to right the best valid stretch of groups, or one group as it is.

    A card of unusual length, or an IBAN too short or long for its country, has to fill the candidate, as one in ten
    stretches (one in 97) has right check digits by chance.
    """

    def tried(groups: Column, i: Column, n: Column) -> Column:
        own = F.array_join(F.slice(groups, i, n), " ")

        def valid(c: Column, kind: str) -> Column:
            return bound(MAKERS[kind](c, key), lambda v: F.when(v.isNotNull(), F.struct(
                usual(c, kind).alias("usual"), n.alias("n"), v.alias("text"), F.lit(kind).alias("kind"))))

        def made(c: Column) -> Column:
            out = F.lit(None).cast("struct<usual:boolean,n:int,text:string,kind:string>")
            for kind in reversed(kinds):
                mine = c.rlike(f"^(?:{PATTERNS[kind]})$")
                if kind not in BLANKS:
                    mine &= n == 1
                elif kind != "phone":
                    mine &= usual(c, kind) | (n == F.size(groups))
                out = F.when(mine, valid(c, kind)).otherwise(out)
            return out

        return bound(own, made)

    def step(groups: Column, state: Column, i: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(F.lit(1), F.least(
            F.size(groups) - i + 1, F.lit(MOST_GROUPS))), lambda n: tried(groups, i, n)))
        plain = F.lit(None).cast("string")
        taken = bound(best, lambda b: F.when(b.isNotNull(), F.struct(
            (i + b["n"]).alias("next"),
            F.concat(state["out"], F.array(F.struct(b["text"].alias("text"), b["kind"].alias("kind")))).alias("out"))).otherwise(
            F.struct((i + 1).alias("next"),
                     F.concat(state["out"], F.array(F.struct(groups[i - 1].alias("text"), plain.alias("kind")))).alias("out"))))
        return F.when(i < state["next"], state).otherwise(taken)

    start = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<text:string,kind:string>>").alias("out"))
    return bound(F.split(m, " "), lambda groups: F.aggregate(
        F.sequence(F.lit(1), F.size(groups)), start, lambda state, i: step(groups, state, i), lambda state: state["out"]))


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same rows with ``text_col`` pseudonymised and a column ``pii_kinds``: the kinds replaced, in order of place.

    A candidate without a valid part stays as it is. All other columns pass through, whatever their names; a column of
    the name ``pii_kinds``, in capitals too, is replaced. A null text stays null with a null list; one without findings has an empty list.
    Texts are searched whole. Repeated rows are changed alike; an empty table stays empty. The key is part of the query
    plan: keep plans and event logs as safe as the key.
    """
    if not key or not set(kinds) <= set(KINDS):
        raise ValueError(f"a key and kinds among {KINDS}")
    text = F.col(f"`{text_col}`").cast("string")

    ordered = [k for k in KINDS if k in kinds]

    def whole_value(m: Column, kind: str) -> Column:
        return bound(MAKERS[kind](m, key), lambda v: F.array(F.struct(
            F.coalesce(v, m).alias("text"), F.when(v.isNotNull(), kind).alias("kind"))))

    def replaced(m: Column) -> Column:
        parts = stretches(m, [k for k in ordered if k != "email"], key)
        for kind in reversed([k for k in ordered if k not in BLANKS]):
            parts = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), whole_value(m, kind)).otherwise(parts)
        return bound(parts, lambda p: F.struct(
            F.array_join(F.transform(p, lambda x: x["text"]), " ").alias("text"),
            F.array_compact(F.transform(p, lambda x: x["kind"])).alias("kinds")))

    pattern = "|".join(f"(?:{PATTERNS[k]})" + (BEHIND if k in BLANKS else "") for k in ordered)
    # Most texts have neither a number of two digits nor an @, and are not searched further.
    maybe = text.rlike(r"@|[0-9][0-9./ -]*[0-9]")
    found = F.when(maybe, F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), replaced))
    # Between the findings, the text as it was: one more part than findings.
    both = F.struct(F.split(text, pattern, -1).alias("parts"), found.alias("found"))
    whole = bound(both, lambda b: F.when(F.size(b["found"]) > 0, F.struct(
        F.array_join(F.zip_with(b["parts"], b["found"], lambda p, f: F.concat(p, F.coalesce(f["text"], F.lit("")))), "")
        .alias("text"), F.flatten(F.transform(b["found"], lambda f: f["kinds"])).alias("kinds"))))
    none = F.struct(text.alias("text"), F.when(text.isNotNull(), F.array().cast("array<string>")).alias("kinds"))
    result = F.when(maybe, F.coalesce(whole, none)).otherwise(none)
    names = [c for c in docs.columns if c.lower() != "pii_kinds"]
    made = "_pii_result"
    while made in map(str.lower, names):
        made += "_"
    rows = docs.select(*[F.col(f"`{c}`") for c in names], result.alias(made))
    return rows.select(*[F.col(f"{made}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names],
                       F.col(f"{made}.kinds").alias("pii_kinds"))


@query("op6_pii_pseudonyms")
def op6(spark, sf_dir):
    """Checked against a Python form and by its inverse properties in ``tests/llm/test_pii.py``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms(docs, key="a key of the owner").withColumn("pii_kinds", F.array_join("pii_kinds", ","))
