"""Personal data replaced by format-preserving keyed pseudonyms.

Only DataFrame functions run on the executors; each document is one row of one map stage.

Found values are checked (card and account check digits, calendar, octets, number ranges)
and permuted inside their own format by a Feistel network whose round function is SHA-256
with the key: a card stays a valid card, a date a date. The permutation is E⁻¹(E(x) + 1),
so no value ever stays as it is, equal values get equal pseudonyms in all documents, and
different values of a kind different ones. Values that fail their check are left alone.

Card and account numbers stand among other digits and capitals (an expiry date, a quantity,
the next word), so a whole run of them is cut at its group borders into all candidates;
those that validate are taken, of two that overlap an account of its country's length, then
the longer one. A run ends where a value of another kind begins.

Edge cases: a null text stays null and an empty one empty; the length of a value never
limits it; repeated rows get equal results; an empty table gives an empty result; other
columns are carried unchanged whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import LOWER, UPPER

ROUNDS = 8
HEX = "0123456789abcdef"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"""(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|api[_-]?key|token)\s{0,3}[=:]\s{0,3}["']?[a-z0-9_+/.-]{8,})"""
ACCESS_KEY = r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
PHONE = r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./])\d{1,2}([./])\d{1,2}\1\d{4}(?![\d])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"\d(?:[ -]?\d){12,18}"
DATES = DATE.replace("([./])", "[./]").replace(r"\1", "[./]")
#: What ends a run of card or account groups.
OTHER = f"(?!{EMAIL}|{SECRET}|{ACCESS_KEY}|{PHONE}|{SSN}|{DATES}|{IP})"
CARDS = rf"(?<!\d)\d(?:[ -]?{OTHER}\d){{12,}}+"
#: The lower-case letter behind a run tells that its last group is no whole word.
IBANS = rf"(?<![A-Za-z0-9])[A-Z]{{2}}\d{{2}}(?=(?: ?[A-Z0-9]){{8}})(?:[ -]?{OTHER}[A-Z0-9])*+[a-z]?"
GROUPS = "(?<=[ -])|(?=[ -])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])"
#: A candidate has at most so many groups and joints.
SPAN = 43
#: In the order in which a place in the text is tried.
#: Each group first looks at one or two characters, so most places of a text fail at once.
NUMBERS = "|".join([PHONE, SSN, DATES, IP, CARDS])
ANY = f"{EMAIL}|(?=[pPsSaAtT]){SECRET}|(?=[Ags]){ACCESS_KEY}|(?=[A-Z]{{2}}[0-9]{{2}}){IBANS}|(?=[0-9+(])(?:{NUMBERS})"
#: Length of account numbers by country.
LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28"
        " HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29"
        " RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
KINDS = ("email", "secret", "access_key", "iban", "phone", "ssn", "date", "ip", "card")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated and planned once however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _long(c: Column) -> Column:
    return c.cast("long")


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts]), 256)


def _steps(reverse: bool) -> Column:
    order = range(ROUNDS)
    return F.array(*[F.lit(i) for i in (reversed(order) if reverse else order)])


def permute_number(x: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Keyed permutation of 0 … a·b-1 without fixed points."""

    def rounds(start: Column, sign: int) -> Column:
        def one(s: Column, i: Column) -> Column:
            f = lambda half, n: F.pmod(_long(F.conv(F.substring(_digest(key, F.lit(kind), i, half), 1, 14), 16, 10)), F.lit(n))
            return F.when(
                i % 2 == 0, F.struct(F.pmod(s["l"] + sign * f(s["r"], a), F.lit(a)).alias("l"), s["r"].alias("r"))
            ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + sign * f(s["l"], b), F.lit(b)).alias("r")))

        return F.aggregate(_steps(sign < 0), start, one, lambda s: _long(s["l"] * b + s["r"]))

    def halves(v: Column) -> Column:
        return F.struct(_long(F.floor(v / F.lit(b))).alias("l"), _long(F.pmod(v, F.lit(b))).alias("r"))

    there = _let(_long(x), lambda v: rounds(halves(v), 1))
    return _let(F.pmod(there + 1, F.lit(a * b)), lambda v: rounds(halves(v), -1))


def _shift(ch: Column, by: Column, alphabet: str | None) -> Column:
    """A character moved inside its class: the given alphabet, or a-z, A-Z and 0-9; others stay."""
    out = ch
    for letters in (alphabet,) if alphabet else (LOWER, UPPER, "0123456789"):
        at = F.instr(F.lit(letters), ch)
        moved = F.substring(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def _move(part: Column, other: Column, i: Column, key: str, kind: str, sign: int, alphabet: str | None) -> Column:
    chars = F.filter(F.split(part, ""), lambda c: c != "")
    step = lambda h, k: sign * F.pmod(F.xxhash64(h, k), F.lit(1_000_003))
    moved = _let(_digest(key, F.lit(kind), i, other), lambda h: F.transform(chars, lambda c, k: _shift(c, step(h, k), alphabet)))
    return F.array_join(moved, "")


def permute_text(text: Column, key: str, kind: str, alphabet: str | None = None) -> Column:
    """Keyed permutation of strings that keeps every character's class; no string with a letter or digit stays itself."""

    def rounds(start: Column, sign: int) -> Column:
        def one(s: Column, i: Column) -> Column:
            left = F.struct(_move(s["l"], s["r"], i, key, kind, sign, alphabet).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), _move(s["r"], s["l"], i, key, kind, sign, alphabet).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        return F.aggregate(_steps(sign < 0), start, one, lambda s: F.concat(s["l"], s["r"]))

    def halves(v: Column) -> Column:
        n = F.floor(F.length(v) / 2).cast("int")
        return F.struct(F.substring(v, F.lit(1), n).alias("l"), F.substring(v, n + 1, F.length(v)).alias("r"))

    def bump(s: Column) -> Column:
        """The first character that has a class moved by one."""
        at = F.regexp_instr(s, F.lit(f"[{alphabet}]" if alphabet else "[A-Za-z0-9]"))
        one = _shift(F.substring(s, at, F.lit(1)), F.lit(1), alphabet)
        return F.when(at == 0, s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), one, F.substring(s, at + 1, F.length(s))))

    there = _let(text, lambda v: rounds(halves(v), 1))
    return _let(_let(there, bump), lambda v: rounds(halves(v), -1))


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("at"))
    put = lambda s, c: F.when(
        c.rlike("^[0-9]$"), F.struct(F.concat(s["o"], F.substring(digits, s["at"], F.lit(1))).alias("o"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["o"], c).alias("o"), s["at"].alias("at")))
    return F.aggregate(chars, start, put, lambda s: s["o"])


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted once."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int"))
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda a, b: a + b)


def _mod97(account: Column) -> Column:
    """Remainder by 97 of an account number turned by four characters, letters read as 10 … 35."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(chars, F.lit(0), step)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, F.lit(1), F.lit(1)), permute_text(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_digits(m), lambda d: F.when(_luhn(d) % 10 == 0, _let(new(d), lambda n: _refill(m, n))))


def _iban(m: Column, key: str) -> Column:
    def new(plain: Column) -> Column:
        country, bban = F.substring(plain, F.lit(1), F.lit(2)), F.substring(plain, F.lit(5), F.length(plain))
        check = lambda b: F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0")
        return _let(permute_text(bban, key, "iban"), lambda b: F.concat(country, check(b), b))

    def spaced(whole: Column) -> Column:
        start = F.struct(F.lit("").alias("o"), F.lit(1).alias("at"))
        put = lambda s, c: F.when(c == " ", F.struct(F.concat(s["o"], c).alias("o"), s["at"].alias("at"))).otherwise(
            F.struct(F.concat(s["o"], F.substring(whole, s["at"], F.lit(1))).alias("o"), (s["at"] + 1).alias("at"))
        )
        return F.aggregate(F.filter(F.split(m, ""), lambda c: c != ""), start, put, lambda s: s["o"])

    return _let(F.replace(m, F.lit(" "), F.lit("")), lambda p: F.when(_mod97(p) == 1, _let(new(p), spaced)))


def _numbers(run: Column, key: str) -> Column:
    """(kinds, new): the card and account numbers of a run, in order, and the run with their pseudonyms; new is null if there are none."""
    lengths = F.create_map(*[F.lit(x) for c in LENGTHS.items() for x in c])
    whole = lambda t, k: F.coalesce(~F.get(t, k).rlike("^[A-Za-z0-9]"), F.lit(True))

    def candidates(t: Column) -> Column:
        def start(at: Column) -> Column:
            account = F.get(t, at).rlike("^[A-Z]{2}$") & F.coalesce(F.get(t, at + 1).rlike("^[0-9]{2}"), F.lit(False)) & whole(t, at - 1)
            return F.get(t, at).rlike("^[0-9]") | account

        def judged(c: Column) -> Column:
            card = c["m"].rlike(f"^{CARD}$") & (_luhn(_digits(c["m"])) % 10 == 0)
            plain = F.replace(c["m"], F.lit(" "), F.lit(""))
            account = c["m"].rlike(f"^{IBAN}$") & whole(t, c["b"] + 1) & (_mod97(plain) == 1)
            known = F.coalesce(lengths[F.substring(plain, F.lit(1), F.lit(2))] == F.length(plain), F.lit(False))
            return F.struct(
                F.when(known, 0).otherwise(1).alias("order"), (-F.length(plain)).alias("size"), c["a"].alias("a"), c["b"].alias("b"),
                F.when(card, "card").when(account, "iban").alias("kind"), c["m"].alias("m"),
            )

        def ends(a: Column) -> Column:
            to = F.sequence(a, F.least(a + SPAN, F.size(t) - 1))
            cut = F.transform(to, lambda b: F.struct(a.alias("a"), b.alias("b"), F.array_join(F.slice(t, a + 1, b - a + 1), "").alias("m")))
            formed = F.filter(cut, lambda c: c["m"].rlike(f"^(?:{CARD}|{IBAN})$"))
            return F.filter(F.transform(formed, judged), lambda c: c["kind"].isNotNull())

        return F.array_sort(F.flatten(F.transform(F.filter(F.sequence(F.lit(0), F.size(t) - 1), start), ends)))

    def taken(found: Column) -> Column:
        none = F.array().cast("array<struct<order:int,size:int,a:int,b:int,kind:string,m:string>>")
        return F.aggregate(found, none, lambda s, c: F.when(F.exists(s, lambda o: (o["a"] <= c["b"]) & (c["a"] <= o["b"])), s).otherwise(F.concat(s, F.array(c))))

    def new(c: Column) -> Column:
        return F.struct(c["a"].alias("a"), c["b"].alias("b"), c["kind"].alias("kind"), F.when(c["kind"] == "card", _card(c["m"], key)).otherwise(_iban(c["m"], key)).alias("new"))

    def put(t: Column, found: Column) -> Column:
        def one(g: Column, k: Column) -> Column:
            hit = F.filter(found, lambda c: (c["a"] <= k) & (k <= c["b"]))
            return _let(F.get(hit, F.lit(0)), lambda c: F.when(c.isNull(), g).when(c["a"] == k, c["new"]).otherwise(""))

        kinds = F.transform(F.array_sort(found), lambda c: c["kind"])
        return F.struct(kinds.alias("kinds"), F.when(F.size(found) > 0, F.array_join(F.transform(t, one), "")).alias("new"))

    return _let(F.split(run, GROUPS), lambda t: _let(F.transform(taken(candidates(t)), new), lambda found: put(t, found)))


def _ip(m: Column, key: str) -> Column:
    def new(o: Column) -> Column:
        ok = F.forall(o, lambda v: v < 256)
        x = F.aggregate(o, F.lit(0).cast("long"), lambda a, v: a * 256 + v)
        shifts = F.array(*[F.lit(2**s) for s in (24, 16, 8, 0)])
        octets = lambda y: F.transform(shifts, lambda s: F.pmod(F.floor(y / s), F.lit(256)).cast("long").cast("string"))
        return F.when(ok, F.array_join(_let(permute_number(x, 65536, 65536, key, "ip"), octets), "."))

    return _let(F.transform(F.split(m, "[.]"), lambda v: v.cast("long")), new)


def _ssn(m: Column, key: str) -> Column:
    def new(p: Column) -> Column:
        a, g, s = (F.element_at(p, i) for i in (1, 2, 3))
        x = (a - F.when(a > 666, 2).otherwise(1)) * 989_901 + (g - 1) * 9_999 + s - 1
        out = lambda y: F.format_string(
            "%03d-%02d-%04d",
            F.floor(y / 989_901) + F.when(y >= 665 * 989_901, 2).otherwise(1),
            F.floor(F.pmod(y, F.lit(989_901)) / 9_999) + 1,
            F.pmod(F.pmod(y, F.lit(989_901)), F.lit(9_999)) + 1,
        )
        return F.when((a > 0) & (a != 666) & (a < 900) & (g > 0) & (s > 0), _let(permute_number(x, 898, 989_901, key, "ssn"), out))

    return _let(F.transform(F.split(m, "-"), lambda v: v.cast("long")), new)


def _date(m: Column, key: str) -> Column:
    """Dates of 1900 to 2099. Day-month order is taken where it is valid, else month-day; single digits may widen to two."""
    base = F.to_date(F.lit("1900-01-01"))

    def read(p: Column) -> Column:
        a, b, c = (F.element_at(p, i) for i in (1, 2, 3))
        date = lambda y, m, d: F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, m, d), F.lit("yyyy-MM-dd")).cast("date")
        iso = a > 31
        day_first = ~iso & (b <= 12)
        form = F.when(iso, "yyyy-MM-dd").when(day_first, "dd.MM.yyyy").otherwise("MM.dd.yyyy")
        day = F.when(iso, date(a, b, c)).when(day_first, date(c, b, a)).otherwise(date(c, a, b))
        return F.struct(F.datediff(day, base).cast("long").alias("n"), form.alias("form"))

    def new(s: Column) -> Column:
        # 211 · 346 = 73,006 days reach to 2099-11-18; the 43 days left of 2099 are turned among themselves.
        moved = F.when(s["n"] < 73_006, permute_number(s["n"], 211, 346, key, "date")).otherwise(
            permute_number(s["n"] - 73_006, 43, 1, key, "date-tail") + 73_006
        )
        day = F.date_add(base, moved.cast("int"))
        written = _let(day, lambda d: F.when(s["form"] == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(
            s["form"] == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).otherwise(F.date_format(d, "MM.dd.yyyy")))
        return F.when((s["n"] >= 0) & (s["n"] < 73_049), written)

    parts = F.transform(F.split(m, "[./-]"), lambda v: v.cast("int"))
    found = _let(_let(parts, read), new)
    return F.when(F.contains(m, F.lit("/")), F.translate(found, ".", "/")).otherwise(found)


def _email(m: Column, key: str) -> Column:
    return F.concat(permute_text(F.substring_index(m, "@", 1), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"""^([A-Za-z_-]+\s{0,3}[=:]\s{0,3}["']?)""", 1)
    fill = lambda v: F.when(v.rlike("^[0-9a-f]+$"), permute_text(v, key, "secret", HEX)).otherwise(permute_text(v, key, "secret"))
    return _let(name, lambda n: F.concat(n, _let(F.substring(m, F.length(n) + 1, F.length(m)), fill)))


def _access_key(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, r"^(AKIA|gh[pousr]_|sk-)", 1)
    return _let(name, lambda n: F.concat(n, permute_text(F.substring(m, F.length(n) + 1, F.length(m)), key, "access_key")))


def _phone(m: Column, key: str) -> Column:
    code = F.regexp_extract(m, r"^(\+\d{1,3}(?=[ .(-])|\+\d)?", 1)
    return _let(code, lambda n: F.concat(n, permute_text(F.substring(m, F.length(n) + 1, F.length(m)), key, "phone")))


#: Form and pseudonym of the kinds; a run of card or account groups has several values.
RULES: dict[str, tuple[str, Callable[[Column, str], Column] | None]] = {
    "email": (EMAIL, _email),
    "secret": (SECRET, _secret),
    "access_key": (ACCESS_KEY, _access_key),
    "iban": (r"[A-Z]{2}\d{2}[A-Z0-9 -]*+[a-z]?", None),
    "phone": (PHONE, _phone),
    "ssn": (SSN, _ssn),
    "date": (DATE, _date),
    "ip": (IP, _ip),
    "card": (r"\d[\d -]*+", None),
}


def _replace(match: Column, key: str) -> Column:
    """(kinds, new): those of the first rule whose form the value has; new is null if its check fails."""
    kind = F.lit(None).cast("string")
    for name in reversed(KINDS):
        kind = F.when(match.rlike(f"^(?:{RULES[name][0]})$"), name).otherwise(kind)

    def fill(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for name in reversed(KINDS):
            if RULES[name][1]:
                out = F.when(s["kind"] == name, RULES[name][1](s["m"], key)).otherwise(out)
        one = _let(out, lambda n: F.struct(F.when(n.isNotNull(), F.array(s["kind"])).otherwise(F.array().cast("array<string>")).alias("kinds"), n.alias("new")))
        both = F.when(s["kind"].isin("iban", "card"), _numbers(s["m"], key)).otherwise(one)
        return _let(both, lambda r: F.struct(r["kinds"].alias("kinds"), r["new"].alias("new"), s["m"].alias("m")))

    return _let(F.struct(kind.alias("kind"), match.alias("m")), fill)


def with_pseudonyms(df: DataFrame, text: Column, key: str) -> DataFrame:
    """``df`` with ``__text``, the text with pseudonyms, and ``__kinds``, the kinds of the replaced values in order."""
    any_value = text.rlike(ANY)
    found = F.when(any_value, F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: _replace(m, key)))
    out = df.withColumn("__found", found)
    around = F.split(text, ANY, -1)
    put = F.zip_with(around, F.col("__found"), lambda p, f: F.concat(p, F.coalesce(f["new"], f["m"], F.lit(""))))
    kinds = F.flatten(F.transform("__found", lambda f: f["kinds"]))
    return out.withColumns(
        {
            "__text": F.when(F.col("__found").isNull(), text).otherwise(F.array_join(put, "")),
            "__kinds": F.coalesce(kinds, F.array().cast("array<string>")),
        }
    ).drop("__found")


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, n_replaced and one count per kind for every document."""
    out = with_pseudonyms(docs.select("doc_id", F.col("text").alias("__t")), F.col("__t"), key)
    count = lambda name: F.size(F.filter("__kinds", lambda k: k == name)).cast("long")
    counts = [count(n).alias(f"n_{n}") for n in KINDS]
    return out.select("doc_id", F.col("__text").alias("text"), F.size("__kinds").cast("long").alias("n_replaced"), *counts)


def replace_in(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with its own columns, ``text`` with pseudonyms and, where present, ``n_chars`` of the new text."""
    out = with_pseudonyms(docs.select(F.struct(*docs.columns).alias("row")), F.col("row.text"), key)
    own = {"text": F.col("__text"), "n_chars": F.coalesce(F.length("__text").cast("long"), F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
