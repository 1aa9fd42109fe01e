"""Format-preserving pseudonyms by a keyed Feistel permutation, with DataFrame functions only.

Numbers and dates that validate are replaced by others of the same format: card numbers (13 to 19 digits, Luhn), phone
numbers, social security numbers, IBANs (mod 97, ended by their country's length), IPv4 addresses, and dates of the
years 1900 to 2099 (year first, day.month.year, and month or day first with / or -; a time may follow); with them go
e-mail addresses, whose letters and digits are permuted by the same network. Equal values get equal pseudonyms under a
key, in every document, and different ones different pseudonyms, since each format's network is a permutation of it.

* Strings (digits, letters): the characters that count are halved; in each round, one half's characters are shifted
  within their class (0-9, a-z, A-Z) by a keyed hash of the other half and the place. Separators stay where they are.
* Card numbers keep their length and first digit; the last is the Luhn digit anew. IBANs keep their country, and get
  their check digits anew.
* IPv4 addresses are pairs of 16-bit halves, dates pairs (day number mod 17, day number div 17) of their 73,049 days;
  their rounds add modulo the half's own range. A date that isn't written like its day (1.2.2024 as 12.10.1950) goes on
  through the network until it is, which keeps each way of writing a permutation of its own.
* What the network makes of a social security or phone number may not be one. It goes on through the network until it is,
  as dates do, so pseudonyms are valid and different. Phone numbers keep their country code, and begin with 2 to 9 after
  it if they did before.
* First with / or - is the month, or the day where it is above 12; such a date's pseudonym has a day above 12 too.

The hash is SHA-256 over key, round, format and half, so pseudonyms don't depend on the engine's own hash. The key is the
one cell of a table that goes to all tasks, so that plans, and logs of them, don't show it.

A value that the permutation leaves as it is counts as replaced, since nobody can tell that it was left.

Defined results: a null text stays null; what doesn't validate stays as it is; repeated rows get equal results. Texts
without a digit or @ aren't searched further. Other columns pass through, but for ``n_pseudonyms``, which takes the place
of one that is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import let

ROUNDS = 8
YEAR, PART, BACKSLASH = "(?:19|20)[0-9]{2}", "[0-9]{1,2}", "\\"
#: Fixed value: how often a value goes through the network at most; one in five is as it should be at the least.
WALK = 200
#: Steps between two looks at whether a value is as it should be already.
BLOCK_STEPS = 8
#: Country codes of one and two digits; all others have three.
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: The countries' lengths of an IBAN, by the registry of ISO 13616.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
#: The formats, in the order in which they are tried at a place of the text.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?!\w)",
    "date": rf"(?<![\w.-])(?:{'|'.join([f'{YEAR}{s}{PART}{s}{PART}' for s in '-/'] + [f'{PART}{s}{PART}{s}{YEAR}' for s in (BACKSLASH + '.', '/', '-')])})(?:(?![\w-])|(?=[Tt][0-9]{{2}}))",
    "ssn": r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])",
    "ipv4": r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])",
    "card": r"(?<![\w+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w])",
    "phone": r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4})(?!\w)",
}
#: A place where an IBAN may begin, with all that may belong to it.
IBAN_RUN = rf"(?<!\w)(?=({PATTERNS['iban'].removeprefix('(?<!' + BACKSLASH + 'w)')}))[A-Z]{{2}}[0-9]{{2}}"
OTHERS = "|".join(f"(?:{p})" for k, p in PATTERNS.items() if k not in ("email", "iban"))


def keyed(key: Column, what: Column, digits: int = 8) -> Column:
    """A number from the first hexadecimal digits of SHA-256 over key and ``what``."""
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit("/"), what), 256), 1, digits), 16, 10).cast("long")


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def characters(value: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, i, 1))


def shifted(c: Column, by: Column) -> Column:
    """A character moved within its class."""
    code = F.ascii(c)
    move = lambda first, size: F.chr(F.pmod(code - first + by, F.lit(size)) + first)
    return F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26)).when(c.between("A", "Z"), move(65, 26)).otherwise(c)


def string_feistel(key: Column, kind: str, value: Column) -> Column:
    """The permutation of a string's letters and digits; equal lengths and classes, so a permutation of its format."""

    def rounds(state: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            stream = lambda half, i: keyed(key, F.concat_ws("/", F.lit(kind), r.cast("string"), F.length(s["a"]).cast("string"), F.length(s["b"]).cast("string"), half, i.cast("string")))
            turned = lambda moved, half: F.array_join(F.transform(characters(moved), lambda c, i: shifted(c, stream(half, i))), "")
            return F.struct(
                F.when((r % 2 == 0) & (F.length(s["a"]) > 0), turned(s["a"], s["b"])).otherwise(s["a"]).alias("a"),
                F.when((r % 2 == 1) & (F.length(s["b"]) > 0), turned(s["b"], s["a"])).otherwise(s["b"]).alias("b"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step, lambda s: F.concat(s["a"], s["b"]))

    half = F.floor(F.length(value) / 2).cast("int")
    return rounds(F.struct(F.substring(value, F.lit(1), half).alias("a"), F.substring(value, half + 1, F.length(value)).alias("b")))


def walked(start: Column, step, good) -> Column:
    """The first of ``step(start)``, ``step(step(start))``, ... that is good: a permutation of the good values if ``step`` is
    one of all. A good start has such a value, itself at the latest."""
    return let(step(start), lambda first: until(good, step, first))


def until(good, step, value: Column) -> Column:
    """``value`` stepped on until it is good, ``WALK`` times at most; in blocks, so that what is good early costs the steps of
    a block and a look at each of the other blocks."""
    times = lambda n: F.sequence(F.lit(1), F.lit(n))
    block = lambda s: F.aggregate(times(BLOCK_STEPS), s, lambda t, _: F.when(good(t), t).otherwise(step(t)))
    return F.aggregate(times(WALK // BLOCK_STEPS), value, lambda s, _: F.when(good(s), s).otherwise(block(s)))


def number_feistel(key: Column, kind: str, a: Column, b: Column, size_a: int, size_b: int) -> Column:
    """The permutation of pairs of numbers below two sizes, as a struct of a and b."""

    def step(s: Column, r: Column) -> Column:
        stream = lambda half: keyed(key, F.concat_ws("/", F.lit(kind), r.cast("string"), half.cast("string")), 12)
        return F.struct(
            F.when(r % 2 == 0, F.pmod(s["a"] + stream(s["b"]), F.lit(size_a))).otherwise(s["a"]).alias("a"),
            F.when(r % 2 == 1, F.pmod(s["b"] + stream(s["a"]), F.lit(size_b))).otherwise(s["b"]).alias("b"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(2 * ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def put_back(value: Column, pattern: str, new: Column) -> Column:
    """``value`` with the characters that match ``pattern`` replaced by those of ``new``, in order."""

    def step(s: Column, c: Column) -> Column:
        hit = c.rlike(pattern)
        return F.struct(F.concat(s["text"], F.when(hit, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("text"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(characters(value), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")), step, lambda s: s["text"])


def luhn_sum(digits: Column) -> Column:
    """Sum of the digits, every second one from the last but one on doubled."""

    def part(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = d * 2
        return F.when((F.length(digits) - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(characters(digits), part), F.lit(0), lambda s, x: s + x)


def mod97(text: Column) -> Column:
    """ISO 7064: letters count as 10 to 35, and the number is taken modulo 97, digit group by digit group."""
    value = lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(characters(text), F.lit(0), lambda s, c: let(value(c), lambda v: F.when(v > 9, (s * 100 + v) % 97).otherwise((s * 10 + v) % 97)))


def card(key: Column, value: Column) -> Column:
    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), string_feistel(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
        checked = let(body, lambda b: F.concat(b, F.pmod(10 - luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")))
        return F.when((F.length(d) > 12) & (luhn_sum(d) % 10 == 0), let(checked, lambda n: put_back(value, "[0-9]", n)))

    return let(digits_of(value), of)


def iban_valid(value: Column) -> Column:
    return let(F.replace(value, F.lit(" "), F.lit("")), lambda v: F.length(v).between(15, 34) & (mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1))


def ibans(t: Column) -> Column:
    """The different IBANs of a text, the longest first.

    What follows one may look like a part of it. So of all that may belong to it, that of the country's length counts if
    it is valid; else the whole, and for countries without a known length, the longest valid part from the begin to the
    end of a word.
    """
    lengths = F.create_map(*(F.lit(x) for item in IBAN_LENGTHS.items() for x in item))

    def of(run: Column) -> Column:
        words = F.split(run, " ")
        ends = F.transform(F.reverse(F.sequence(F.lit(1), F.size(words))), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))
        fits = lambda n: F.filter(ends, lambda v: (F.length(F.replace(v, F.lit(" "), F.lit(""))) == n) & iban_valid(v))
        rest = lambda n: F.filter(F.when(n.isNull(), ends).otherwise(F.array(run)), iban_valid)
        return let(F.try_element_at(lengths, F.substring(run, 1, 2)), lambda n: F.coalesce(F.get(fits(n), F.lit(0)), F.get(rest(n), F.lit(0))))

    found = F.filter(F.transform(F.regexp_extract_all(t, F.lit(IBAN_RUN), F.lit(1)), of), lambda v: v.isNotNull())
    longest = F.transform(F.reverse(F.array_sort(F.transform(F.array_distinct(found), lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))))), lambda s: s["v"])
    return longest


def any_of(t: Column) -> Column:
    """The pattern of all values of a text: IBANs by their letters, as a pattern can't tell where they end."""
    email = f"(?:{PATTERNS['email']})|"
    return let(ibans(t), lambda v: F.when(F.size(v) > 0, F.concat(F.lit(f"{email}(?:(?<!\\w)(?:"), F.array_join(v, "|"), F.lit(f")(?!\\w))|{OTHERS}"))).otherwise(F.lit(f"{email}{OTHERS}")))


def iban(key: Column, value: Column) -> Column:
    def of(v: Column) -> Column:
        body = string_feistel(key, "iban", F.substring(v, F.lit(5), F.length(v)))
        checked = let(body, lambda b: F.concat(F.substring(v, 1, 2), F.lpad((98 - mod97(F.concat(b, F.substring(v, 1, 2), F.lit("00")))).cast("string"), 2, "0"), b))
        return F.when(mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1, let(checked, lambda n: put_back(value, "[A-Z0-9]", n)))

    return let(F.replace(value, F.lit(" "), F.lit("")), of)


def ipv4(key: Column, value: Column) -> Column:
    def of(o: Column) -> Column:
        new = number_feistel(key, "ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        text = let(new, lambda n: F.concat_ws(".", *(x.cast("string") for h in ("a", "b") for x in (F.floor(n[h] / 256), n[h] % 256))))
        return F.when(F.forall(o, lambda x: x <= 255), text)

    return let(F.transform(F.split(value, r"\."), lambda x: x.cast("int")), of)


def date(key: Column, value: Column) -> Column:
    parts, sep = F.split(value, "[./-]"), F.regexp_extract(value, "[./-]", 0)
    year_first = F.length(parts[0]) == 4
    dotted = ~year_first & (sep == ".")
    high = ~year_first & (sep != ".") & (parts[0].cast("int") > 12)  # a day before the month, by its number alone
    day_first = dotted | high
    # the two parts besides the year as they are written
    one, two = F.when(year_first, parts[1]).otherwise(parts[0]), F.when(year_first, parts[2]).otherwise(parts[1])
    month, dom = F.when(day_first, two).otherwise(one), F.when(day_first, one).otherwise(two)
    iso = F.concat_ws("-", F.when(year_first, parts[0]).otherwise(parts[2]), F.lpad(month, 2, "0"), F.lpad(dom, 2, "0"))
    first = F.lit("1900-01-01").cast("date")

    def written(day: Column) -> Column:
        d = F.date_add(first, day.cast("int"))
        part = lambda of, like: F.when(F.length(like) == 2, F.lpad(of.cast("string"), 2, "0")).otherwise(of.cast("string"))
        a = part(F.when(day_first, F.dayofmonth(d)).otherwise(F.month(d)), one)
        b = part(F.when(day_first, F.month(d)).otherwise(F.dayofmonth(d)), two)
        return F.when(year_first, F.concat_ws("/", F.year(d).cast("string"), a, b)).otherwise(F.concat_ws("/", a, b, F.year(d).cast("string")))

    def moved(day: Column) -> Column:
        new = lambda n: let(n["b"] * 17 + n["a"], lambda d: let(written(d), lambda t: F.struct(d.alias("day"), t.alias("text"), ((F.length(t) == F.length(value)) & (~high | (F.dayofmonth(F.date_add(first, d.cast("int"))) > 12))).alias("done"))))
        return let(number_feistel(key, "date", day % 17, F.floor(day / 17), 17, 4297), new)

    def of(day: Column) -> Column:
        last = let(moved(day), lambda start: until(lambda s: s["done"], lambda s: moved(s["day"]), start))
        return F.when(day.isNotNull() & (day >= 0), F.replace(last["text"], F.lit("/"), sep))

    return let(F.datediff(F.try_to_date(iso, "yyyy-MM-dd"), first), of)


def email(key: Column, value: Column) -> Column:
    plain = F.regexp_replace(value, r"[^A-Za-z0-9]", "")
    return let(string_feistel(key, "email", plain), lambda n: put_back(value, "[A-Za-z0-9]", n))


def ssn(key: Column, value: Column) -> Column:
    invalid = r"^(000|666|9)|^...00|0000$"

    def of(d: Column) -> Column:
        return let(walked(d, lambda v: string_feistel(key, "ssn", v), lambda v: ~v.rlike(invalid)), lambda n: put_back(value, "[0-9]", n))

    return let(digits_of(value), lambda d: F.when(~d.rlike(invalid), of(d)))


def phone(key: Column, value: Column) -> Column:
    """The digits after the country code are permuted, among those that begin with 2 to 9 or among the others."""
    code = F.when(value.startswith("+"), F.regexp_extract(digits_of(value), rf"^(?:{COUNTRY_CODES}|[0-9]{{3}})", 0)).otherwise("")

    def of(p: Column) -> Column:
        step = lambda v: string_feistel(key, "phone", v)
        alike = lambda v: v.rlike("^[2-9]") == p["rest"].rlike("^[2-9]")
        return let(walked(p["rest"], step, alike), lambda n: put_back(value, "[0-9]", F.concat(p["code"], n)))

    parts = let(code, lambda c: F.struct(c.alias("code"), F.substring(digits_of(value), F.length(c) + 1, F.length(value)).alias("rest")))
    return F.when(F.length(digits_of(value)).between(7, 15), let(parts, of))


def pseudonym(key: Column, value: Column) -> Column:
    """The pseudonym of a value, in the first format that it has and validates for; null where it has none."""
    whole = {k: value.rlike(rf"\A(?:{p})\z") for k, p in PATTERNS.items()}
    makers = {"email": email, "iban": iban, "date": date, "ssn": ssn, "ipv4": ipv4, "card": card, "phone": phone}
    return F.coalesce(*(F.when(whole[k], make(key, value)) for k, make in makers.items()))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts; n_pseudonyms is added: how many values were replaced."""

    def of(t: Column) -> Column:
        new = lambda f: F.transform(f, lambda v: pseudonym(F.col("__key"), v))
        shown = lambda p: F.zip_with(p["found"], p["new"], lambda a, b: F.coalesce(b, a))
        woven = lambda p: F.concat(F.array_join(F.zip_with(F.slice(p["between"], 1, F.size(p["new"])), shown(p), lambda a, b: F.concat(a, b)), ""), F.element_at(p["between"], -1))
        changed = lambda p: F.struct(woven(p).alias("text"), F.size(F.filter(p["new"], lambda x: x.isNotNull())).cast("long").alias("n"))
        # what stands between the values, one part more than there are values
        parts = lambda p, f: F.struct(F.split(t, p, -1).alias("between"), new(f).alias("new"), f.alias("found"))
        found = lambda p: F.regexp_extract_all(t, F.concat(F.lit("("), p, F.lit(")")), F.lit(1))
        return let(any_of(t), lambda p: let(found(p), lambda f: F.when(F.size(f) > 0, let(parts(p, f), changed))))

    secret = docs.sparkSession.createDataFrame([(key,)], "__key string")
    result = F.when(F.col(text).rlike(r"[0-9@]"), let(F.col(text), of))
    out = docs.join(F.broadcast(secret)).withColumn("__new", result)  # one row
    return out.withColumns({text: F.coalesce("__new.text", text), "n_pseudonyms": F.coalesce("__new.n", F.lit(0).cast("long"))}).drop("__new", "__key")
