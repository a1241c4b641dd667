"""PII: keyed, format-preserving Feistel pseudonyms in native column expressions.

One regular expression finds candidates; validators (Luhn, mod 97, octet and
calendar ranges) decide which are personal data; each of these is permuted
within its own format by a Feistel network under a secret key.  What is
permuted is the bare value, digits or letters without the separators that it is
written with, and separators go back to their places; so equal values stay
linked across documents in any layout, and different values stay different.

The key is a literal of the query's plan: whoever reads plans or event logs
reads the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Session setting of the key that the registered queries use, and the key of trials where it is unset.
KEY_SETTING, TRIAL_KEY = "spark.anonframe.pii.key", "anonframe"

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Patterns in the order in which they are tried at a position.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"""(?i:(?<![A-Za-z0-9])(?:token|secret|password|passwd|api[_-]?key)["']? ?[=:] ?["'])[A-Za-z0-9+/_=.-]{8,}+(?=["'])""",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9-])(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])(?![0-9-])",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z+(])(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
}
#: Card numbers of the lengths that their first digits fix.
BRANDS = r"4(?:[ -]?[0-9]){15}", r"(?:5[ -]?[1-5]|2[ -]?[2-7]|3[ -]?5|6[ -]?[0-9])(?:[ -]?[0-9]){14}", r"3[ -]?[47](?:[ -]?[0-9]){13}", r"3[ -]?[068](?:[ -]?[0-9]){12}"
#: IBAN lengths (ISO 13616 registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country calling codes of one, two and (all others) three digits (ITU-T E.164).
CALLING_CODE = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: A border put beside a shorter candidate, and what stands for its first character in a text that has it already.
BORDER, ESCAPE, OWN = "\uffff\ufffe", "\uffff", "\uffff\ufffd"
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Days from 1900-01-01 to 2099-12-31: a product of two numbers that a Feistel network takes as halves.
DAYS = (17, 4297)
#: SSN: 898 areas (without 000, 666 and 9xx), 99 groups times 9999 serials.
SSN = (898, 99 * 9999)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _mac(key: str, *parts: Column) -> Column:
    """512 keyed bits as 128 hexadecimal digits."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]).cast("binary"), 512)


def _number(hex_digits: Column) -> Column:
    return F.conv(hex_digits, 16, 10).cast("long")


def feistel_number(x: Column, a: int, b: int, key: str, tweak: str) -> Column:
    """A permutation of 0 .. a*b-1: the quotient and the rest by b take turns in shifting each other."""

    def step(s, i):
        left = lambda r: F.pmod(s["l"] + _number(F.substring(_mac(key, F.lit(tweak), i, r), 1, 14)), F.lit(a))
        right = lambda r: F.pmod(s["r"] + _number(F.substring(_mac(key, F.lit(tweak), i, r), 1, 14)), F.lit(b))
        return F.when(i % 2 == 0, F.struct(left(s["r"]).cast("long").alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right(s["l"]).cast("long").alias("r")))

    begin = F.struct(F.floor(x / F.lit(b)).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step), lambda s: s["l"] * b + s["r"])


def _shift(text: Column, mac: Column, letters: int) -> Column:
    """Each digit, small and capital letter moved within its class by its own three digits of the MAC; other characters stay."""

    def move(i):
        c = F.substring(text, i, F.lit(1))
        by = _number(F.substring(mac, F.pmod(i - 1, F.lit(42)) * 3 + 1, F.lit(3)))

        def within(first: str, size: int):
            return F.char(F.pmod(F.ascii(c) - F.lit(ord(first)) + by, F.lit(size)) + F.lit(ord(first)))

        out = F.when(c.between("0", "9"), within("0", 10))
        for first in "aA":
            out = out.when(c.between(first, chr(ord(first) + letters - 1)), within(first, letters))
        return out.otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), move), "")).otherwise(text)


def feistel_text(value: Column, key: str, tweak: str, letters: int = 26) -> Column:
    """A permutation of all strings of the value's format (length and class of each character)."""
    n = F.length(value)

    def step(s, i):
        left = _shift(s["l"], _mac(key, F.lit(tweak), i, s["r"]), letters)
        right = _shift(s["r"], _mac(key, F.lit(tweak), i, s["l"]), letters)
        return F.when(i % 2 == 0, F.struct(left.alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), right.alias("r")))

    half = F.floor(n / 2).cast("int")
    begin = F.struct(F.substring(value, F.lit(1), half).alias("l"), F.substring(value, half + 1, n).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, step), lambda s: F.concat(s["l"], s["r"]))


def _laid_out(value: Column, like: Column) -> Column:
    """The letters and digits of ``value``, in order, at the places that letters and digits have in ``like``; other characters are those of ``like``."""
    place = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i), "[^0-9A-Za-z]", ""))
    put = lambda i: _let(F.substring(like, i, F.lit(1)), lambda c: F.when(F.regexp_like(c, F.lit("[0-9A-Za-z]")), F.substring(value, place(i), F.lit(1))).otherwise(c))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), put), "")


def _bare(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9A-Za-z]", "")


def _last_digit(body: Column) -> Column:
    """The digit that makes body pass the Luhn check."""
    return F.element_at(F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda c: F.call_function("luhn_check", F.concat(body, c))), 1)


def _mod97(account: Column) -> Column:
    """ISO 7064 remainder of an account number in its checked order, without spaces."""
    digits = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(account, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise(_let(digits(c), lambda d: F.pmod(F.when(d > 9, r * 100 + d).otherwise(r * 10 + d), F.lit(97)).cast("int"))))


def _valid_iban(m: Column) -> Column:
    bare = F.regexp_replace(m, " ", "")
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)


def _iban(m: Column, key: str) -> Column:
    body = feistel_text(F.substring(_bare(m), F.lit(5), F.length(m)), key, "iban")
    check = lambda b: F.lpad((98 - _mod97(F.concat(b, F.substring(m, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    return _let(_let(body, lambda b: F.concat(F.substring(m, 1, 2), check(b), b)), lambda v: _laid_out(v, m))


def _card(m: Column, key: str) -> Column:
    digits = _bare(m)
    body = feistel_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    return _let(_let(body, lambda b: F.concat(b, _last_digit(b))), lambda v: _laid_out(v, m))


def _phone(m: Column, key: str) -> Column:
    """The calling code stays; a number without one is permuted as what would follow it, so both forms stay linked."""
    digits = _bare(m)
    code = F.when(m.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 1)).otherwise("")
    return _let(F.concat(code, feistel_text(F.substring(digits, F.length(code) + 1, F.length(digits)), key, "phone")), lambda v: _laid_out(v, m))


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda t, o: t * 256 + o.cast("long"))
    octet = lambda x, k: F.pmod(F.floor(x / F.lit(256**k)), F.lit(256)).cast("string")
    return _let(feistel_number(value, 1 << 16, 1 << 16, key, "ip"), lambda x: F.concat_ws(".", *[octet(x, k) for k in (3, 2, 1, 0)]))


def _date(m: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(m, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date")).cast("long")
    return F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), feistel_number(day, *DAYS, key, "date").cast("int")), "yyyy-MM-dd")


def _ssn(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, "-"), lambda p: p.cast("long"))

    def number(p):
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        return area * SSN[1] + (p[1] - 1) * 9999 + p[2] - 1

    def write(x):
        area = F.floor(x / F.lit(SSN[1])) + 1
        area = F.when(area >= 666, area + 1).otherwise(area)
        rest = F.pmod(x, F.lit(SSN[1]))
        group, serial = F.floor(rest / F.lit(9999)) + 1, F.pmod(rest, F.lit(9999)) + 1
        return F.concat_ws("-", *[F.lpad(v.cast("string"), w, "0") for v, w in ((area, 3), (group, 2), (serial, 4))])

    return _let(feistel_number(_let(part, number), *SSN, key, "ssn"), write)


def kind_of(m: Column) -> Column:
    """The kind of a match, or null where a validator turns it down."""
    full = {k: F.regexp_like(m, F.lit(f"^(?:{p})$")) for k, p in KINDS.items()}
    full["secret"] = F.regexp_like(m, F.lit(r"^(?i:(?:token|secret|password|passwd|api[_-]?key))[\"']? ?[=:]"))
    checks = {"iban": _valid_iban(m), "date": F.try_to_date(m, "yyyy-MM-dd").isNotNull(), "card": _valid_card(m)}
    out = None
    for k in KINDS:
        value = F.when(checks[k], F.lit(k)) if k in checks else F.lit(k)
        # An account number or date that fails its check may still be of a later kind.
        test = full[k] & checks[k] if k in checks else full[k]
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def _valid_card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def shorter(m: Column) -> Column:
    """(begin, size) of the card or IBAN inside a candidate that fails its check as a whole, or null.

    Both start and end at a border of the candidate's groups; a card may also
    end where its first digits say, and an IBAN ends where its country says.
    """
    n = F.length(m)

    def starts(group: str):
        return F.filter(F.sequence(F.lit(1), n), lambda i: F.regexp_like(F.substring(m, i, n), F.lit(f"^{group}")) & ((i == 1) | F.substring(m, i - 1, F.lit(1)).isin(" ", "-")))

    def spans(i, least: int):
        """Spans from i on that end before or at every later place."""
        return F.when(n - i + 1 >= least, F.transform(F.sequence(n - i + 1, F.lit(least), F.lit(-1)), lambda k: F.struct(i.cast("int").alias("begin"), k.cast("int").alias("size")))).otherwise(F.array().cast("array<struct<begin:int,size:int>>"))

    text = lambda x: F.substring(m, x["begin"], x["size"])
    at_border = lambda x: F.substring(m, x["begin"] + x["size"], F.lit(1)).isin("", " ", "-") & ~text(x).rlike("[ -]$")
    branded = lambda x: F.regexp_like(text(x), F.lit("^(?:" + "|".join(BRANDS) + ")$"))
    cards = F.flatten(F.transform(starts("[0-9]"), lambda i: spans(i, 13)))
    cards = F.filter(cards, lambda x: (at_border(x) | branded(x)) & _valid_card(text(x)))
    # A known length is the likelier card, then the border, then the longer one.
    ranked = _let(cards, lambda c: F.concat(F.filter(c, lambda x: branded(x) & at_border(x)), F.filter(c, at_border), c))
    country = F.create_map(*[F.lit(v) for size, names in IBAN_LENGTHS.items() for c in names.split() for v in (c, size)])
    size = lambda x: F.length(F.regexp_replace(text(x), " ", ""))
    fixed = lambda x: F.try_element_at(country, F.substring(m, x["begin"], F.lit(2)))
    ibans = F.flatten(F.transform(starts("[A-Z]{2}[0-9]{2}"), lambda i: spans(i, 15)))
    ibans = F.filter(ibans, lambda x: F.when(fixed(x).isNotNull(), size(x) == fixed(x)).otherwise(at_border(x)) & ~text(x).endswith(" ") & _valid_iban(text(x)))
    failed_card = F.regexp_like(m, F.lit(r"^[0-9][0-9 -]+$")) & (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 13) & ~_valid_card(m)
    failed_iban = F.regexp_like(m, F.lit(r"^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$")) & ~_valid_iban(m)
    return F.when(failed_card, F.try_element_at(ranked, F.lit(1))).when(failed_iban, F.try_element_at(ibans, F.lit(1)))


def _bordered(text: Column) -> Column:
    """The text with borders beside every shorter candidate, until none is left; each round borders one more span at least."""
    found = lambda t: F.regexp_extract_all(t, F.lit(ANY), F.lit(0))

    def mark(m):
        return _let(shorter(m), lambda x: F.when(x.isNull(), m).otherwise(F.concat(F.substring(m, F.lit(1), x["begin"] - 1), F.lit(BORDER), F.substring(m, x["begin"], x["size"]), F.lit(BORDER), F.substring(m, x["begin"] + x["size"], F.length(m)))))

    def step(s, _):
        new = lambda t: F.array_join(F.zip_with(F.split(t, ANY, -1), F.transform(found(t), mark), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
        return F.when(s["done"], s).otherwise(_let(new(s["t"]), lambda t: F.struct(t.alias("t"), (t == s["t"]).alias("done"))))

    rounds = F.sequence(F.lit(0), F.ceil(F.length(text) / F.lit(13)).cast("int"))
    return F.aggregate(rounds, F.struct(F.replace(text, F.lit(ESCAPE), F.lit(OWN)).alias("t"), F.lit(False).alias("done")), step, lambda s: s["t"])


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    at = F.instr(m, "@")
    lead = F.regexp_extract(m, r"^(.*?[=:] ?[\"'])", 1)
    value = F.substring(m, F.length(lead) + 1, F.length(m))
    letters = lambda x: F.when(F.regexp_like(x, F.lit("^[0-9a-f]+$|^[0-9A-F]+$")), feistel_text(x, key, "hex", 6)).otherwise(feistel_text(x, key, "secret"))
    return (
        F.when(kind == "email", F.concat(feistel_text(F.substring(m, F.lit(1), at - 1), key, "email"), F.substring(m, at, F.length(m))))
        .when(kind == "secret", F.concat(lead, _let(value, letters)))
        .when(kind == "iban", _iban(m, key))
        .when(kind == "date", _date(m, key))
        .when(kind == "ip", _ip(m, key))
        .when(kind == "ssn", _ssn(m, key))
        .when(kind == "phone", _phone(m, key))
        .when(kind == "card", _card(m, key))
    )


def session_key(spark) -> str:
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Replace personal data in every whole text, with a secret of your own as ``key``; add pii_kinds (array, a kind for each value replaced, in order).

    Kinds: email (its local part), secret (a quoted credential), iban, date
    (ISO), ip, ssn, phone and card.  A card or account number that fails its
    check is searched for a shorter one inside it; numbers that fail stay as
    they are.  Null and empty texts stay as they are and have no kinds; very long
    texts are read whole; where two kinds match at one place, the first in that
    order wins; all other columns and rows, repeated ones too, pass through; a
    column named pii_kinds is replaced; an empty key raises ValueError.
    """
    if not key:
        raise ValueError("a key is needed")
    text = F.col(text_col)
    rows = docs.drop("pii_kinds").withColumn("__some", F.regexp_like(text, F.lit("[0-9@=:]")) & F.regexp_like(text, F.lit("@|[0-9](?:[ .()-]{0,3}[0-9]){3}|(?i:token|secret|passw|api.?key)")))
    found = F.when(F.col("__some"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("__found", found).withColumn("__inner", F.exists("__found", lambda m: shorter(m).isNotNull()))
    rows = rows.withColumn("__text", F.when(F.col("__inner"), _bordered(text)).otherwise(text))
    found = F.when(F.col("__inner"), F.regexp_extract_all("__text", F.lit(ANY), F.lit(0))).otherwise(F.col("__found"))
    values = F.transform(found, lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), F.coalesce(pseudonym(m, k, key), m).alias("new"))))
    pieces = F.split("__text", ANY, -1)
    new = F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v["new"], F.lit("")))), "")
    new = F.when(F.col("__inner"), F.replace(F.replace(new, F.lit(BORDER), F.lit("")), F.lit(OWN), F.lit(ESCAPE))).otherwise(new)
    rows = rows.withColumn(text_col, F.when(F.col("__some"), F.struct(new.alias("t"), F.filter(F.transform(values, lambda v: v["kind"]), lambda k: k.isNotNull()).alias("k"))).otherwise(F.struct(text.alias("t"), F.array().cast("array<string>").alias("k"))))
    return rows.withColumn("pii_kinds", F.col(f"{text_col}.k")).withColumn(text_col, F.col(f"{text_col}.t")).select(*[c for c in docs.columns if c != "pii_kinds"], "pii_kinds")
