"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

A value that passes its kind's validation is replaced by another valid value of the
same format, by a keyed Feistel permutation of what the format leaves free. Equal
values get equal pseudonyms in every document, whatever their separators, and different
values different ones. Without the key the permutation cannot be reversed.

kind    validated by                     permuted
card    13 to 19 digits, Luhn            all digits but the first and the check digit, which is computed anew
iban    check digits (mod 97)            all letters and digits behind the check digits, which are computed anew
phone   international, 8 to 15 digits    all digits behind the country code
ssn     no reserved area, group, serial  each digit that stays valid: area and group keep their first digit
ip      four octets                      all 32 bits
date    exists in the calendar           the day within its century
email   local part and two labels        letters and digits before the last two labels
secret  named assignment or access key   letters and digits of the value

Card numbers and IBANs are sought last, in what the other kinds leave: a run of groups is tried
from every group on, up to the end of every group (the longest that is valid first; an IBAN in its
country's length first), so numbers before or behind a value don't hide it. Phone numbers without
a '+' have no validation and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import let, text_of

ROUNDS = 10
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NAMED = r"(?:password|passwd|pwd|token|secret|api[_-]?key)"
_KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![\p{L}\p{N}_])(?:(?i:" + _NAMED + r")\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}|AKIA[0-9A-Z]{16}(?![0-9A-Za-z]))",
    "ip": r"(?<![\d.])(?:" + _OCTET + r"\.){3}" + _OCTET + r"(?!\d|\.\d)",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\d/-]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}(?!\d)",
}
# Stands for a found value while the rest is searched; one that is in the text itself is held for a value that stays.
_TAKEN = "\x00"
PATTERN = "|".join([*_KINDS.values(), r"\x00"])
# Where a card number or an IBAN may begin, and its forms by the number of symbols, the longest first.
_BEGINS = {"iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2})", "card": r"(?<![\d.+-])(?=\d(?:[ -]?\d){12})"}
_FORMS = {
    "iban": [r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){%d}%s(?![A-Za-z0-9])" % ((n - 4) // 4, r"(?: ?[A-Z0-9]{%d})" % (n % 4) if n % 4 else "")
             for n in range(34, 14, -1)],
    "card": [r"^\d(?:[ -]?\d){%d}(?!\d)" % (n - 1) for n in range(19, 12, -1)],
}
_WIDEST = 48         # more characters than any form has
_MOST_GROUPS = 20    # more groups than any form has
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
# Addresses and cards may have no two digits side by side, only digits around one separator.
HINT = r"@|\d[ .-]?\d|AKIA|(?i:" + _NAMED + ")"


def _letters(text: Column) -> Column:
    return F.split(text, "")


def _prf(key: str, kind: str, i: Column, other: Column) -> Column:
    """128 hex digits from the key, the kind, the round and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(f"{key}|{kind}"), i.cast("string"), other), 512)


def _shift(text: Column, stream: Column) -> Column:
    """Move each digit and ASCII letter on inside its class, by the stream's numbers."""
    def one(ch, i):
        step = F.conv(F.substring(stream, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        code = F.ascii(ch)
        return (F.when(ch.between("0", "9"), F.char(48 + (code - 48 + step) % 10))
                .when(ch.between("a", "z"), F.char(97 + (code - 97 + step) % 26))
                .when(ch.between("A", "Z"), F.char(65 + (code - 65 + step) % 26)).otherwise(ch))

    return F.when(text == "", text).otherwise(F.array_join(F.transform(_letters(text), one), ""))


def permute(text: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the strings that have a digit where `text` has one, and so for small and large letters."""
    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    swap = lambda s, i: F.struct(s["b"].alias("a"), _shift(s["a"], _prf(key, kind, i, s["b"])).alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, swap, lambda s: F.concat(s["a"], s["b"]))


def permute_number(value: Column, low: Column, high: Column, key: str, kind: str) -> Column:
    """Keyed permutation of the numbers 0 to low * high - 1, by turns on the two digits of mixed base."""
    def step(s, i):
        other = F.when(i % 2 == 0, s["b"]).otherwise(s["a"])
        add = F.conv(F.substring(_prf(key, kind, i, other.cast("string")), 1, 12), 16, 10).cast("long")
        return F.struct(F.when(i % 2 == 0, (s["a"] + add) % low).otherwise(s["a"]).alias("a"),
                        F.when(i % 2 == 1, (s["b"] + add) % high).otherwise(s["b"]).alias("b"))

    start = F.struct(F.floor(value / high).cast("long").alias("a"), (value % high).cast("long").alias("b"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda s: s["a"] * high + s["b"])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _refill(shape: Column, symbols: Column, pattern: str) -> Column:
    """`shape` with its symbols replaced in order and its separators as they are."""
    put = lambda s, run: F.when(run.rlike(f"^{pattern}"), F.struct(
        F.concat(s["out"], F.substring(symbols, s["at"], F.length(run))).alias("out"), (s["at"] + F.length(run)).alias("at"))).otherwise(
        F.struct(F.concat(s["out"], run).alias("out"), s["at"].alias("at")))
    runs = F.regexp_extract_all(shape, F.lit(f"{pattern}+|(?!{pattern})."), F.lit(0))
    return F.aggregate(runs, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), put, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn sum from the right; `doubled_from` 0 doubles the last digit, 1 the last but one."""
    def add(total, ch, i):
        d = ch.cast("int") * F.when(i % 2 == doubled_from, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    numbered = F.transform(_letters(F.reverse(digits)), lambda ch, i: F.struct(ch.alias("c"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda t, x: add(t, x["c"], x["i"]))


def _card(m: Column, key: str) -> Column:
    def of(d):
        body = let(F.concat(F.substring(d, 1, 1), permute(F.substring(d, F.lit(2), F.length(d) - 2), key, "card")),
                   lambda b: F.concat(b, ((10 - _luhn_sum(b, 0) % 10) % 10).cast("string")))
        valid = F.length(d).between(13, 19) & (_luhn_sum(d, 1) % 10 == 0)
        return F.when(valid, let(body, lambda s: _refill(m, s, "[0-9]")))

    return let(_digits(m), of)


def _mod97(symbols: Column) -> Column:
    def add(r, ch):
        return F.when(ch.between("0", "9"), (r * 10 + ch.cast("int")) % 97).otherwise((r * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(_letters(F.concat(F.substring(symbols, F.lit(5), F.length(symbols)), F.substring(symbols, 1, 4))), F.lit(0), add)


def _iban(m: Column, key: str) -> Column:
    def of(s):
        country, free = F.substring(s, 1, 2), permute(F.substring(s, F.lit(5), F.length(s)), key, "iban")
        new = let(free, lambda f: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), f))).cast("string"), 2, "0"), f))
        return F.when(F.length(s).between(15, 34) & (_mod97(s) == 1), let(new, lambda x: _refill(m, x, "[0-9A-Z]")))

    return let(F.regexp_replace(m, " ", ""), of)


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^\+(?:1(?=\D)|[1-9]\d{0,2}(?=\D)|)", 0)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    fresh = let(permute(_digits(rest), key, "phone"), lambda d: F.concat(code, _refill(rest, d, "[0-9]")))
    return F.when(F.length(_digits(m)).between(8, 15), fresh)


def _ssn(m: Column, key: str) -> Column:
    d = _digits(m)
    valid = ~m.rlike(r"^(?:000|666|9)|^...-00|0000$")
    # Areas 001-665 and 667-899 leave 898 numbers, groups 99, serials 9999.
    area = F.substring(d, 1, 3).cast("long")
    value = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1

    def text(n):
        a = F.floor(n / (99 * 9999)) + 1
        a = F.when(a >= 666, a + 1).otherwise(a)
        return F.format_string("%03d-%02d-%04d", a.cast("int"), (F.floor(n / 9999) % 99 + 1).cast("int"), (n % 9999 + 1).cast("int"))

    return F.when(valid, let(permute_number(value, F.lit(898 * 99), F.lit(9999), key, "ssn"), text))


def _ip(m: Column, key: str) -> Column:
    def of(o):
        value = ((o[0].cast("long") * 256 + o[1].cast("long")) * 256 + o[2].cast("long")) * 256 + o[3].cast("long")
        return let(permute_number(value, F.lit(65536), F.lit(65536), key, "ip"), lambda v: F.concat_ws(
            ".", *[F.floor(v / (1 << s) % 256).cast("int").cast("string") for s in (24, 16, 8, 0)]))

    return let(F.split(m, r"\."), of)


def _date(m: Column, key: str) -> Column:
    """Day first with dots; with slashes day first if that exists, else month first."""
    def of(p):
        year_first = F.length(p[0]) == 4
        dates = lambda y, a, b: F.try_to_date(F.concat_ws("-", y, F.lpad(a, 2, "0"), F.lpad(b, 2, "0")), "yyyy-MM-dd")
        day_first = dates(p[2], p[1], p[0])
        found = F.when(year_first, dates(p[0], p[1], p[2])).otherwise(F.coalesce(
            day_first, F.when(m.contains("/"), dates(p[2], p[0], p[1]))))
        return let(F.struct(found.alias("d"), day_first.isNotNull().alias("day_first"), year_first.alias("iso"), p.alias("p")), moved)

    def moved(x):
        century = (F.year(x["d"]) / 100).cast("int")
        begin = F.make_date(century * 100, F.lit(1), F.lit(1))
        leap = century % 4 == 0    # 36,525 = 75 * 487 days, or 36,524 = 92 * 397
        new = F.date_add(begin, permute_number(
            F.datediff(x["d"], begin), F.when(leap, 75).otherwise(92), F.when(leap, 487).otherwise(397), key, "date").cast("int"))
        return F.when(x["d"].isNotNull() & (F.year(x["d"]) > 0), let(new, lambda n: shown(x, n)))

    def shown(x, n):
        two = lambda part, width: F.when(width == 2, F.lpad(part.cast("string"), 2, "0")).otherwise(part.cast("string"))
        p, sep = x["p"], F.when(m.contains("/"), "/").otherwise(".")
        first, second = F.when(x["day_first"], F.day(n)).otherwise(F.month(n)), F.when(x["day_first"], F.month(n)).otherwise(F.day(n))
        year = F.lpad(F.year(n).cast("string"), 4, "0")
        return F.when(x["iso"], F.concat_ws("-", year, F.lpad(F.month(n).cast("string"), 2, "0"), F.lpad(F.day(n).cast("string"), 2, "0"))).otherwise(
            F.concat(two(first, F.length(p[0])), sep, two(second, F.length(p[1])), sep, year))

    return let(F.split(m, "[-./]"), of)


def _email(m: Column, key: str) -> Column:
    keep = F.regexp_extract(m, r"(?:@|\.)[A-Za-z0-9-]+\.[A-Za-z]{2,}$", 0)
    return F.concat(permute(F.substring(m, F.lit(1), F.length(m) - F.length(keep)), key, "email"), keep)


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(?:AKIA|[^=:]*[=:]\s*[\"']?)", 0)
    return F.concat(name, permute(F.substring(m, F.length(name) + 1, F.length(m)), key, "secret"))


def pseudonym(m: Column, key: str) -> Column:
    """(value, kind) of one match of `PATTERN`; both null if it does not pass validation."""
    makers = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone}
    whole = {kind: m.rlike(f"^(?:{_KINDS[kind]})$") for kind in makers}
    value, kind = F.when(m == _TAKEN, m), F.when(m == _TAKEN, F.lit(None).cast("string"))
    for name, make in makers.items():
        value, kind = value.when(whole[name], make(m, key)), kind.when(whole[name], F.lit(name))
    return let(F.struct(value.alias("v"), kind.alias("k")), lambda x: F.struct(x["v"].alias("value"), F.when(x["v"].isNotNull(), x["k"]).alias("kind")))


def _part(text: Column, kind: Column | None = None, open_: bool = True) -> Column:
    """A part of a text: open if it is still to be searched, else a value of a kind."""
    return F.struct(text.alias("text"), (F.lit(None).cast("string") if kind is None else kind).alias("kind"), F.lit(open_).alias("open"))


def _first_parts(text: Column, key: str) -> Column:
    """Parts of a text by the matches of `PATTERN`; those that fail are open like the text around them."""
    def masked(x):
        pairs = F.zip_with(x["found"], x["new"], lambda old, new: F.when(new["value"].isNotNull(), F.lit(_TAKEN)).otherwise(old))
        line = F.array_join(F.zip_with(x["rest"], F.concat(pairs, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
        none = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("kind"))
        taken = F.concat(F.filter(x["new"], lambda n: n["value"].isNotNull()), F.array(none))
        return F.flatten(F.zip_with(F.split(line, r"\x00", -1), taken, lambda t, n: F.array(_part(t), _part(n["value"], n["kind"], False))))

    def of(found):
        new = F.transform(found, lambda m: pseudonym(m, key))
        return F.when(F.size(found) == 0, F.array(_part(text))).otherwise(
            let(F.struct(found.alias("found"), new.alias("new"), F.split(text, PATTERN, -1).alias("rest")), masked))

    return let(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), of)


def _best_card(forms: Column) -> Column:
    return F.get(F.filter(forms, lambda c: let(_digits(c), lambda d: _luhn_sum(d, 1) % 10 == 0)), F.lit(0))


def _best_iban(forms: Column) -> Column:
    symbols = lambda c: F.regexp_replace(c, " ", "")
    country, usual = F.substring(forms[0], 1, 2), None
    for n, names in _IBAN_LENGTHS.items():
        usual = (F if usual is None else usual).when(country.isin(*names.split(" ")), n)

    def choose(x):
        valid = F.filter(x["forms"], lambda c: let(symbols(c), lambda s: _mod97(s) == 1))
        return let(valid, lambda v: F.coalesce(
            F.get(F.filter(v, lambda c: F.length(symbols(c)) == x["usual"]), F.lit(0)),
            F.get(F.filter(v, lambda c: x["usual"].isNull() | (c == x["forms"][0])), F.lit(0))))

    return F.when(F.size(forms) > 0, let(F.struct(forms.alias("forms"), usual.alias("usual")), choose))


def _searched(text: Column, kind: str) -> Column:
    """Parts of an open text by its valid card numbers or IBANs, from left to right; the values are still the old ones."""
    best_of = _best_card if kind == "card" else _best_iban

    def best(head):
        forms = F.filter(F.array(*[F.regexp_extract(head, form, 0) for form in _FORMS[kind]]), lambda c: c != "")
        return let(forms, best_of)

    def of(x):
        joined = lambda name, at, n: F.array_join(F.slice(x[name], at + 1, n), "")
        found = F.transform(x["heads"], lambda _, i: F.struct(i.alias("i"), best(F.substring(joined("heads", i, F.lit(_MOST_GROUPS)), 1, _WIDEST)).alias("m")))
        return let(F.filter(found, lambda h: h["m"].isNotNull()), lambda hits: F.when(F.size(hits) == 0, F.array(_part(text))).otherwise(parts(x, joined, hits)))

    def parts(x, joined, hits):
        def span(h):
            inside = F.filter(F.sequence(F.lit(1), F.lit(_MOST_GROUPS - 1)), lambda d: F.length(joined("heads", h["i"], d)) < F.length(h["m"]))
            return F.struct(h["i"].alias("i"), h["m"].alias("m"), (h["i"] + F.size(inside) + 1).alias("end"))

        spans = F.transform(hits, span)
        # A hit inside the one before it is passed over.
        start = F.struct(F.lit(0).alias("end"), F.filter(spans, lambda _: F.lit(False)).alias("held"))
        held = F.aggregate(spans, start, lambda s, h: F.when(h["i"] >= s["end"], F.struct(
            h["end"].alias("end"), F.concat(s["held"], F.array(h)).alias("held"))).otherwise(s), lambda s: s["held"])
        return let(held, lambda h: between(x, joined, h))

    def between(x, joined, held):
        behind = F.transform(held, lambda h: F.struct(h["end"].alias("end"), F.substring(
            joined("pieces", h["i"], h["end"] - h["i"]), F.length(h["m"]) + 1, F.length(text)).alias("tail")))
        before = F.transform(held, lambda h: F.struct(h["i"].alias("i"), h["m"].alias("value")))
        last = F.struct(F.size(x["pieces"]).alias("i"), F.lit(None).cast("string").alias("value"))
        first = F.struct(F.lit(0).alias("end"), F.lit("").alias("tail"))
        return F.flatten(F.zip_with(F.concat(F.array(first), behind), F.concat(before, F.array(last)), lambda a, b: F.array(
            _part(F.concat(a["tail"], joined("pieces", a["end"], F.greatest(b["i"] - a["end"], F.lit(0))))),
            _part(b["value"], F.when(b["value"].isNotNull(), F.lit(kind)), False))))

    pieces = F.split(text, _BEGINS[kind], -1)
    return let(pieces, lambda p: let(F.struct(p.alias("pieces"), F.transform(p, lambda t: F.substring(t, 1, _WIDEST)).alias("heads")), of))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """`docs` with the personal data in its text replaced, `n_replaced` and `kinds` (sorted, comma-joined).

    A text in which nothing is found comes back as it is, a null text as null with
    nothing replaced. Candidates that fail validation stay. Rows are not moved or
    merged; columns called n_replaced or kinds are replaced, all others carried along.
    """
    text = F.col(text_col)

    def searched(parts, kind):
        return F.flatten(F.transform(parts, lambda p: F.when(
            p["open"] & p["text"].rlike(_BEGINS[kind]), _searched(p["text"], kind)).otherwise(F.array(p))))

    def changed(p):
        return F.when(p["kind"] == "iban", _iban(p["text"], key)).when(p["kind"] == "card", _card(p["text"], key)).otherwise(p["text"])

    # One column after the other: as a single expression this is nested too deeply for the analyser.
    out = docs.withColumn("_p", F.when(text_of(text_col).rlike(HINT), _first_parts(text, key)))
    for kind in _BEGINS:
        out = out.withColumn("_p", searched(F.col("_p"), kind))
    kinds = F.filter(F.transform("_p", lambda p: p["kind"]), lambda k: k.isNotNull())
    out = out.withColumn("_p", F.struct(
        F.array_join(F.transform("_p", changed), "").alias("text"),
        F.when(F.col("_p").isNotNull(), F.size(kinds)).cast("long").alias("n"), F.array_join(F.array_sort(F.array_distinct(kinds)), ",").alias("kinds")))
    return out.withColumns({text_col: F.coalesce(F.col("_p.text"), text), "n_replaced": F.coalesce(F.col("_p.n"), F.lit(0).cast("long")),
                            "kinds": F.coalesce(F.col("_p.kinds"), F.lit(""))}).drop("_p")
