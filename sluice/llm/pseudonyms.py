"""Format-preserving pseudonyms of personal numbers, dates and addresses, by keyed Feistel networks in SQL functions.

Found and permuted within their format, so that equal values have equal pseudonyms in all documents.  Of numbers the
digits alone are permuted and put back into the places where digits stood, so a number stays linked however it is parted:

* payment cards (13 to 19 digits, also in groups of 4-4-4-4 or 4-6-5); one that passes the Luhn check passes it again,
* IBANs of the registry's lengths: the country stays; one that passes the mod-97 check passes it again,
* other numbers of 9 to 19 digits, telephone numbers (the country code stays; national ones as nnn nnn nnnn or with a
  leading 0) and nnn-nn-nnnn numbers: digits for digits.  Nine digits that can be a social security number give one that
  can be, ten that can be a North American telephone number give one that can be,
* IPv4 addresses whose parts are at most 255: on 2 x 16 bits,
* calendar dates (yyyy-mm-dd, d/m/yyyy, d.m.yyyy, and m/d/yyyy where only that can be) that exist, of the years 1 to
  9999: on the 146,097 = 189 x 773 days of their 400 years (1800 to 2199 and so on; what is left at either end is a
  range of its own), so that every date gives a date,
* e-mail addresses: the part before the @, letters for letters and digits for digits,
* hexadecimal secrets of 32 to 64 signs.

A network has an even number of rounds over two halves; a round adds a keyed SHA-256 stream of one half to the signs of
the other within each sign's alphabet, which is invertible for whoever has the key.  DataFrame functions only; only
texts that pass HOT, which holds for every text with a value, are searched further.  The key comes into the plan as the
result of a subquery, so neither plans nor event logs show it.

Nulls: a null text stays null.  Texts without such values, empty ones included, and empty tables stay as they are.
Repeated rows are treated alike.  Very long texts are searched whole.  Extra columns are kept, whatever their names;
n_replaced, the number of values that changed, is added (a column of that name is replaced).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import scratch

#: A production job gives its own key.
KEY = "no secret"
ROUNDS = 6
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

EMAIL = r"[\p{L}\p{N}._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+"
HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
_octet = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_octet}\.){{3}}{_octet}(?![0-9]|\.[0-9])"
_day, _month = "(?:0[1-9]|(?<![0-9][/.])[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
DATE = rf"(?<![0-9])(?:[0-9]{{4}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|{_day}([/.]){_month}\1[0-9]{{4}}|(?<![0-9]/){_month}/(?:1[3-9]|2[0-9]|3[01])/[0-9]{{4}})(?![0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)[ .\-]?|(?<![0-9])[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])(?:[0-9]{9,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])"
#: Country calling codes; none begins another.
CALLING = "(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
ABROAD = rf"\+{CALLING}(?:[ .\-/]?(?:\([0-9]{{1,4}}\)|[0-9])){{6,13}}(?![0-9])"
NATIONAL = r"(?<![0-9.])(?:0[1-9](?:[ .\-][0-9]{2}){4}|0[0-9]{2,4}[ /\-][0-9]{3,4}[ \-]?[0-9]{3,5})(?![0-9])"
#: Countries by the length of their IBANs.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_bans = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBANS.items())
IBAN = rf"(?<![0-9A-Za-z])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_bans})(?![0-9A-Za-z])"
ANY = "|".join([EMAIL, HEX, DATE.replace(r"\1", "[/.]"), IPV4, IBAN, CARD, SSN, PHONE, ABROAD, NATIONAL])
#: What every text with a value of ANY holds.
HOT = r"[0-9]{2}|@|\+[0-9]|[0-9]\.[0-9]\.[0-9]\.[0-9]|[0-9a-f]{32}|[0-9A-F]{32}"
#: Days from 1800-01-01 on fall into ranges of 400 years, LONG x SHORT days each; the first and last years of the
#: calendar are ranges of their own: (first day, days = long x short).
FIRST_DAY, LONG, SHORT = "1800-01-01", 773, 189
ENDS = {"low": ("0001-01-01", 5591, 13), "high": ("9800-01-01", 397, 184)}
#: Areas, groups and serials of social security numbers: 898 x 99 x 9999 = SSN_LEFT x SSN_RIGHT.
SSN_LEFT, SSN_RIGHT = 898 * 33, 3 * 9999
#: North American numbers: 800 areas x 800 exchanges x 10,000 lines = NANP_HALF squared.
NANP_HALF = 80_000


def _key(key: str | Column) -> Column:
    return F.lit(key) if isinstance(key, str) else key


def _stream(key: str | Column, tweak: str, half: Column, turn: Column) -> Column:
    """64 hexadecimal digits that depend on the key, the kind of value, the round and a half."""
    return F.sha2(F.concat_ws("|", _key(key), F.lit(tweak), turn.cast("string"), half), 256)


def _shifted(text: Column, stream: Column, alphabets: list[str]) -> Column:
    """Each sign moved on within its alphabet."""

    def sign(c: Column, i: Column) -> Column:
        step = F.conv(F.substr(stream, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for a in reversed(alphabets):
            place = F.instr(F.lit(a), c)
            out = F.when((place > 0) & (c != ""), F.substr(F.lit(a), (place - 1 + step) % len(a) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(text, ""), sign), "")


def permuted(text: Column, alphabets: list[str], key: str | Column, tweak: str) -> Column:
    """The Feistel network over a text's signs; signs of no alphabet stay in place."""
    middle = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), middle).alias("l"), F.substr(text, middle + 1).alias("r"))
    turns = F.array(*(F.lit(k) for k in range(ROUNDS)))
    step = lambda s, k: F.struct(s["r"].alias("l"), _shifted(s["l"], _stream(key, tweak, s["r"], k), alphabets).alias("r"))
    return F.aggregate(turns, start, step, lambda s: F.concat(s["l"], s["r"]))


def _pair(left: Column, right: Column, n_left: int, n_right: int, key: str | Column, tweak: str) -> Column:
    """The Feistel network over a pair of numbers; gives the struct (l, r)."""

    def step(s: Column, k: Column) -> Column:
        number = lambda half, n: F.conv(F.substr(_stream(key, tweak, half.cast("string"), k), F.lit(1), F.lit(8)), 16, 10).cast("long") % n
        odd = k % 2 == 1
        return F.struct(
            F.when(odd, s["l"]).otherwise((s["l"] + number(s["r"], n_left)) % n_left).alias("l"),
            F.when(odd, (s["r"] + number(s["l"], n_right)) % n_right).otherwise(s["r"]).alias("r"),
        )

    turns = F.array(*(F.lit(k) for k in range(ROUNDS)))
    return F.aggregate(turns, F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _luhn(digits: Column) -> Column:
    """The Luhn sum of digits, the last of which is not doubled."""
    n = F.length(digits)

    def part(c: Column, i: Column) -> Column:
        d = F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))
        twice = d * 2
        return F.when((n - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), part), F.lit(0), lambda a, b: a + b)


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.transform(F.array(value), use)[0]


def _bare(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _filled(x: Column, digits: Column) -> Column:
    """x with the given digits in the places of its own."""
    put = lambda c, i: F.when(c.rlike("^[0-9]$"), F.substr(digits, F.length(_bare(F.substr(x, F.lit(1), i))) + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(x, ""), put), "")


def _part(digits: Column, at: int, n: int) -> Column:
    return F.substr(digits, F.lit(at), F.lit(n)).cast("int")


def _social(d: Column, key: str | Column) -> Column:
    """Nine digits: area 001 to 899 but for 666, group 01 to 99, serial 0001 to 9999."""
    area = _part(d, 1, 3)
    index = ((F.when(area > 666, area - 2).otherwise(area - 1)).cast("long") * 99 + _part(d, 4, 2) - 1) * 9999 + _part(d, 6, 4) - 1

    def text(i: Column) -> Column:
        area = F.floor(i / (99 * 9999)) + 1
        return F.concat(F.lpad(F.when(area > 665, area + 1).otherwise(area).cast("string"), 3, "0"), F.lpad((F.floor(i / 9999) % 99 + 1).cast("string"), 2, "0"), F.lpad((i % 9999 + 1).cast("string"), 4, "0"))

    pair = _pair(F.floor(index / SSN_RIGHT), index % SSN_RIGHT, SSN_LEFT, SSN_RIGHT, key, "social")
    return _bound(_bound(pair, lambda p: p["l"] * SSN_RIGHT + p["r"]), text)


def _american(d: Column, key: str | Column) -> Column:
    """Ten digits: area and exchange from 200 to 999."""
    line = _part(d, 7, 4)
    pair = _pair((_part(d, 1, 3) - 200) * 100 + F.floor(line / 100), (_part(d, 4, 3) - 200) * 100 + line % 100, NANP_HALF, NANP_HALF, key, "american")
    text = lambda p: F.concat((F.floor(p["l"] / 100) + 200).cast("string"), (F.floor(p["r"] / 100) + 200).cast("string"), F.lpad((p["l"] % 100).cast("string"), 2, "0"), F.lpad((p["r"] % 100).cast("string"), 2, "0"))
    return _bound(pair, text)


def numbered(d: Column, key: str | Column) -> Column:
    """The pseudonym of a number's digits, of the same length and of the same kind of number."""
    n = F.length(d)
    checked = lambda body: F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    social = d.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    american = d.rlike("^[2-9][0-9]{2}[2-9][0-9]{6}$")
    card = (n >= 13) & (_luhn(d) % 10 == 0)
    return (
        F.when(social, _social(d, key))
        .when(american, _american(d, key))
        .when(card, _bound(permuted(F.substr(d, F.lit(1), n - 1), [DIGITS], key, "card"), checked))
        .otherwise(permuted(d, [DIGITS], key, "number"))
    )


def _number(x: Column, key: str | Column) -> Column:
    return _bound(numbered(_bare(x), key), lambda d: _filled(x, d))


def _iban_rest(x: Column) -> Column:
    """An IBAN modulo 97, its first four signs taken last."""
    bare = F.replace(x, F.lit(" "))
    signs = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))

    def add(rest: Column, c: Column) -> Column:
        v = F.instr(F.lit(DIGITS + UPPER), c) - 1
        return F.when(c == "", rest).otherwise((rest * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.aggregate(F.split(signs, ""), F.lit(0), add)


def _iban(x: Column, key: str | Column) -> Column:
    bare = F.replace(x, F.lit(" "))
    body = permuted(F.substr(bare, F.lit(5)), [DIGITS, UPPER], key, "iban")
    country = F.substr(x, F.lit(1), F.lit(2))
    checked = lambda b: F.concat(country, F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b)
    new = F.when(_iban_rest(x) == 1, _bound(body, checked)).otherwise(F.concat(country, permuted(F.substr(bare, F.lit(3)), [DIGITS, UPPER], key, "number")))
    put = lambda d: F.array_join(F.transform(F.split(x, ""), lambda c, i: F.when(c.isin(" ", ""), c).otherwise(F.substr(d, F.length(F.replace(F.substr(x, F.lit(1), i), F.lit(" "))) + 1, F.lit(1)))), "")
    return _bound(new, put)


def _date(x: Column, key: str | Column) -> Column:
    shapes = {r"^\d{4}-": "yyyy-MM-dd", r"^\d\d/\d\d/": "dd/MM/yyyy", r"^\d\d\.\d\d\.": "dd.MM.yyyy", r"^\d+/": "d/M/yyyy", r"^\d+\.": "d.M.yyyy"}
    shapes = {r"^\d\d/(1[3-9]|[23]\d)/": "MM/dd/yyyy", r"^\d/(1[3-9]|[23]\d)/": "M/d/yyyy"} | shapes

    def one(shape: str) -> Column:
        day = F.to_date(F.try_to_timestamp(x, F.lit(shape)))

        def moved(first: str, long: int, short: int) -> Column:
            since = F.datediff(day, F.lit(first).cast("date"))
            at = F.pmod(since, F.lit(short * long))
            return _bound(_pair(at % short, F.floor(at / short), short, long, key, "date"), lambda p: F.date_format(F.date_add(F.lit(first).cast("date"), (since - at + p["l"] + p["r"] * short).cast("int")), shape))

        low, high = F.year(day) < 200, F.year(day) >= 9800
        return F.when(day.isNull(), x).when(low, moved(*ENDS["low"])).when(high, moved(*ENDS["high"])).otherwise(moved(FIRST_DAY, LONG, SHORT))

    return reduce(lambda out, k: F.when(x.rlike(k), one(shapes[k])).otherwise(out), reversed(shapes), x)


def _ipv4(x: Column, key: str | Column) -> Column:
    part = lambda i: F.split(x, r"\.")[i].cast("int")
    pair = _pair(part(0) * 256 + part(1), part(2) * 256 + part(3), 65536, 65536, key, "ipv4")
    text = lambda p: F.concat_ws(".", *(F.floor(p[h] / 256).cast("string") if hi else (p[h] % 256).cast("string") for h in "lr" for hi in (True, False)))
    return _bound(pair, text)


def pseudonym(x: Column, key: str | Column = KEY) -> Column:
    """The pseudonym of one found value."""
    local = F.substring_index(x, "@", 1)
    code = F.regexp_extract(x, rf"^(?:\+{CALLING}[ .\-]?|\+[0-9]{{1,3}}[ .\-]?)?", 0)
    whole = lambda p: rf"^(?:{p})$"
    return (
        F.when(F.contains(x, F.lit("@")), F.concat(permuted(local, [DIGITS, LOWER, UPPER], key, "mail"), F.substr(x, F.length(local) + 1)))
        .when(x.rlike("^[0-9a-f]{32,64}$") & x.rlike("[a-f]"), permuted(x, [DIGITS + "abcdef"], key, "hex"))
        .when(x.rlike("^[0-9A-F]{32,64}$"), permuted(x, [DIGITS + "ABCDEF"], key, "hex"))
        .when(x.rlike(whole(r"\d{4}-\d\d-\d\d|\d\d?[/.]\d\d?[/.]\d{4}")), _date(x, key))
        .when(x.rlike(whole(IPV4)), _ipv4(x, key))
        .when(x.rlike("^[A-Z]{2}"), _iban(x, key))
        .otherwise(F.concat(code, _number(F.substr(x, F.length(code) + 1), key)))
    )


def secret(spark: SparkSession, key: str) -> Column:
    """The key as a subquery over a relation of the driver's, whose rows no plan shows."""
    jvm = spark.sparkContext._jvm
    rows, args = jvm.java.util.ArrayList(), spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 1)
    args[0] = key
    rows.add(jvm.org.apache.spark.sql.RowFactory.create(args))
    table = spark._jsparkSession.createDataFrame(rows, jvm.org.apache.spark.sql.types.StructType.fromDDL("k string"))
    return DataFrame(table, spark).scalar()


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """docs with the values in text replaced and n_replaced added."""
    docs = docs.drop("n_replaced")
    found, by, new = scratch.fresh(docs.columns, "found", "by", "new")
    hot = docs.withColumn(by, secret(docs.sparkSession, key)).withColumn(found, F.when(F.col(text).rlike(HOT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))))
    hot = hot.withColumn(new, F.transform(found, lambda x: F.coalesce(pseudonym(x, F.col(by)), x)))
    some = F.size(found) > 0
    put = F.when(some, F.array_join(F.zip_with(F.split(text, ANY, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x, F.lit("")))), "")).otherwise(F.col(text)).alias(text)
    changed = F.size(F.filter(F.zip_with(found, new, lambda x, y: x != y), lambda x: x))
    return hot.select(*(put if c == text else F.col(c) for c in docs.columns), F.when(some, changed).otherwise(0).cast("long").alias("n_replaced"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms in place of personal values."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs)
