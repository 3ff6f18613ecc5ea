"""Format-preserving pseudonyms of personal numbers and dates, in DataFrame and SQL functions only.

Candidates are found by one regular expression and validated by their own rules; what fails stays as it is:

* ``card``  13 to 19 digits, plain or in groups, with a right Luhn digit; the first digit stays, the Luhn digit is made anew;
* ``iban``  right by modulo 97, with 2 digits or more behind the check digits, plain or in groups of four: as long as the
  country's are, else (other countries) the longest run of whole groups that is right; what follows, or all
  behind the country if none is right, is searched again (but for a value that goes on behind the candidate, which has
  eight groups and a shorter one at most); country and letters stay, digits change, the check digits are made anew;
* ``ssn``   ddd-dd-dddd with a possible area, group and serial;
* ``phone`` national (ddd) ddd-dddd and the like, with a trunk 0 (9 to 12 digits in all, the first two stay), or international with +
  and 8 to 15 digits in groups of any size; the country code stays;
* ``ip``    four octets up to 255;
* ``date``  a real day of 1800 to 2199 as y-m-d, m/d/y (d/m/y if it can't be that) or d.m.y; days and months of one digit stay
  of one digit (so a day written with and without zeros has two pseudonyms);
* ``email`` an address, which has no number format: it becomes letters made from a keyed hash of it.

A value goes through an alternating Feistel network of ten rounds whose round function is SHA-256 of the key, the kind,
the round and one half; halves are added modulo the sizes of their own domains (powers of ten for digits, 189 x 773 for
the 146,097 days of 400 years), so it is a permutation of just the valid values and separators stay in place.  Equal
values become equal ones in all documents, different ones of one kind and length different ones.  Nothing is shuffled.

The key comes to the plan as a scalar subquery over a table of one row, so that it stands in no plan, event log or explanation.

Null texts stay null, empty ones empty, texts of any length are searched whole, an empty table gives an empty one, ids are not read, repeated rows are treated each, other columns pass (one named like the list of kinds gives way);
candidates that overlap: the leftmost counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barsmith.llm.common import unused

KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Lengths of the countries' IBANs.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _national(length: int) -> str:
    """What stands behind the check digits of an IBAN of so many signs, plain or in groups of four."""
    rest = f" [A-Z0-9]{{{length % 4}}}" if length % 4 else ""
    return f"(?:[A-Z0-9]{{{length - 4}}}|(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}{rest})"


#: An IBAN of a known country ends where it must, so the text behind it is searched again.
_KNOWN_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{_national(n)}" for n, c in _IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"
_KNOWN_COUNTRY = "^(?:" + "|".join(c.replace(" ", "|") for c in _IBAN_LENGTHS.values()) + ")"
#: Every alternative starts behind a boundary and eats its runs possessively, so long runs cost linear time.
_FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + _KNOWN_IBAN + r"|[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9/-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|(?<![0-9+.-]))(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[0-9]{1,3}(?:[ .-][0-9]{1,8}){2,6}(?![0-9])|\+[0-9]{8,15}(?![0-9])|(?<![0-9+./-])0[1-9][0-9]{0,3}(?:[ -][0-9]{2,8}){1,4}(?![0-9/-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}
PATTERN = "|".join(f"(?:{p})" for p in _FORMS.values())
#: What may stand in the rest of a candidate for an IBAN.
_AGAIN = "|".join(f"(?:{p})" for p in {**_FORMS, "iban": r"(?<![A-Za-z0-9])" + _KNOWN_IBAN}.values())


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "''") + "'" if "'" not in text else repr(text)


def _half(key: str, kind: str, i: str, other: str, size: str) -> str:
    digest = f"sha2(concat_ws('|', {key}, '{kind}', {i}, {other}), 256)"
    return f"pmod(cast(conv(substr({digest}, 1, 15), 16, 10) AS bigint), {size})"


def _feistel(key: str, kind: str, left: str, right: str, a: str, b: str, finish: str) -> str:
    """``finish`` of ``s.l``, ``s.r`` after ten rounds over Z_a x Z_b."""
    return f"""aggregate(sequence(1, 10), named_struct('l', {left}, 'r', {right}), (s, i) -> CASE WHEN i % 2 = 1
        THEN named_struct('l', pmod(s.l + {_half(key, kind, "i", "s.r", a)}, {a}), 'r', s.r)
        ELSE named_struct('l', s.l, 'r', pmod(s.r + {_half(key, kind, "i", "s.l", b)}, {b})) END, s -> {finish})"""


def _big(x: str) -> str:
    return f"cast({x} AS bigint)"


def _permuted_digits(key: str, kind: str, d: str) -> str:
    """The digits of ``d`` (two at least) permuted among all strings of their number."""
    u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    ten = lambda n: _big(f"rpad('1', cast({n} + 1 AS int), '0')")
    # The number of digits is part of the kind: strings of different lengths are permuted apart.
    finish = f"concat(lpad(cast(s.l AS string), cast({u} AS int), '0'), lpad(cast(s.r AS string), cast({v} AS int), '0'))"
    return _feistel(f"concat_ws('/', {key}, length({d}))", kind, _big(f"substr({d}, 1, cast({u} AS int))"), _big(f"substr({d}, cast({u} AS int) + 1)"), ten(u), ten(v), finish)


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _put(m: str, digits: str) -> str:
    """``m`` with its digits replaced by ``digits``, in order."""
    return f"""aggregate(split({m}, ''), named_struct('o', '', 'k', 1, 'd', {digits}), (p, c) -> CASE WHEN c >= '0' AND c <= '9'
        THEN named_struct('o', concat(p.o, substr(p.d, p.k, 1)), 'k', p.k + 1, 'd', p.d) ELSE named_struct('o', concat(p.o, c), 'k', p.k, 'd', p.d) END, p -> p.o)"""


def _luhn(d: str) -> str:
    """Sum of a digit string by Luhn, modulo ten."""
    at = f"cast(substr({d}, j, 1) AS int) * (CASE WHEN (length({d}) - j) % 2 = 1 THEN 2 ELSE 1 END)"
    return f"aggregate(sequence(1, length({d})), cast(0 AS bigint), (t, j) -> t + ({at}) div 10 + ({at}) % 10, t -> cast(t % 10 AS int))"


def _mod97(s: str) -> str:
    """An IBAN rearranged and read as a number, modulo 97."""
    moved = f"concat(substr({s}, 5), substr({s}, 1, 4))"
    return f"""aggregate(split({moved}, ''), cast(0 AS bigint), (t, c) -> CASE WHEN c = '' THEN t WHEN c >= 'A' THEN (t * 100 + ascii(c) - 55) % 97 ELSE (t * 10 + cast(c AS int)) % 97 END)"""


def _bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _date(key: str, m: str) -> tuple[str, str]:
    """Whether ``m`` is a day of the 400 years, and its pseudonym."""
    p = f"split({m}, '[-/.]')"
    part = lambda k: f"cast(element_at({p}, {k}) AS int)"
    size = lambda k: f"length(element_at({p}, {k}))"
    iso, slash = f"{m} LIKE '%-%'", f"{m} LIKE '%/%'"
    month_first = f"({slash} AND {part(1)} BETWEEN 1 AND 12 AND {part(2)} <= 31)"
    fields = f"CASE WHEN {iso} THEN named_struct('y', {part(1)}, 'm', {part(2)}, 'd', {part(3)}, 'f', 'ymd', 'v', 2, 'w', 2) WHEN {month_first} THEN named_struct('y', {part(3)}, 'm', {part(1)}, 'd', {part(2)}, 'f', 'mdy', 'v', {size(1)}, 'w', {size(2)}) ELSE named_struct('y', {part(3)}, 'm', {part(2)}, 'd', {part(1)}, 'f', CASE WHEN {slash} THEN 'only' ELSE 'dmy' END, 'v', {size(2)}, 'w', {size(1)}) END"
    leap = "(f.y % 4 = 0 AND (f.y % 100 != 0 OR f.y % 400 = 0))"
    days = f"CASE WHEN f.m IN (4, 6, 9, 11) THEN 30 WHEN f.m = 2 THEN (CASE WHEN {leap} THEN 29 ELSE 28 END) ELSE 31 END"
    valid = _bind("f", fields, f"f.y BETWEEN 1800 AND 2199 AND f.m BETWEEN 1 AND 12 AND f.d BETWEEN 1 AND {days}")
    number = _big("datediff(make_date(f.y, f.m, f.d), DATE'1800-01-01')")
    step = _feistel(key, "date", "w.x div 773", "w.x % 773", "189L", "773L", "s.l * 773 + s.r")
    # A day that is written day first only because it can't be otherwise stays one, and what has one digit keeps one: the walk goes on until it is so.
    new = "date_add(DATE'1800-01-01', cast(w.x AS int))"
    good = f"((NOT w.o OR day({new}) > 12) AND (f.v = 2 OR month({new}) < 10) AND (f.w = 2 OR day({new}) < 10))"
    walked = f"aggregate(sequence(1, 200), named_struct('x', {number}, 'n', 0, 'o', f.f = 'only'), (w, q) -> CASE WHEN w.n > 0 AND {good} THEN w ELSE named_struct('x', {step}, 'n', w.n + 1, 'o', w.o) END, w -> date_add(DATE'1800-01-01', cast(w.x AS int)))"
    month, day, year = "lpad(cast(month(z) AS string), f.v, '0')", "lpad(cast(day(z) AS string), f.w, '0')", "cast(year(z) AS string)"
    text = f"CASE f.f WHEN 'ymd' THEN concat_ws('-', {year}, {month}, {day}) WHEN 'mdy' THEN concat_ws('/', {month}, {day}, {year}) WHEN 'only' THEN concat_ws('/', {day}, {month}, {year}) ELSE concat_ws('.', {day}, {month}, {year}) END"
    return valid, _bind("f", fields, _bind("z", walked, text))


def _joined(text: str, pattern: str, values: str) -> str:
    """``text`` with the matches of ``pattern`` replaced by the texts of ``values``."""
    return f"array_join(zip_with(split({text}, {_quoted(pattern)}, -1), {values}, (t, w) -> concat(t, coalesce(w.text, ''))), '')"


def _value(key: str, m: str, again: bool = True) -> str:
    """struct(kinds, text): what stands for the candidate ``m``; ``again``: the rest of one for an IBAN is searched."""
    d = _digits(m)
    is_ = lambda kind: f"{m} RLIKE {_quoted('^(?:' + _FORMS[kind] + ')$')}"
    made = lambda kind, text: f"named_struct('kinds', array('{kind}'), 'text', {text})"

    nothing = f"named_struct('kinds', cast(array() AS array<string>), 'text', {m})"
    letters = lambda salt, n: f"translate(substr(sha2(concat_ws('|', {key}, 'email', '{salt}', lower({m})), 256), 1, {n}), '0123456789abcdef', 'ghijklmnopabcdef')"
    email = f"concat({letters('local', 12)}, '@', {letters('domain', 8)}, '.invalid')"

    bare = "replace(v, ' ', '')"
    own = f"regexp_replace(substr(b, 5), '[^0-9]', '')"
    body = _put("substr(b, 5)", _permuted_digits(key, "iban", own))
    head = lambda c: f"concat(substr(b, 1, 2), {c}, n)"
    check = f"lpad(cast(98 - {_mod97(head(repr('00')))} AS string), 2, '0')"
    # Spaces go back where they were: the k-th sign that is no space is the k-th of the new number.
    spaced = f"aggregate(split(v, ''), named_struct('o', '', 'k', 1, 'd', x), (p, c) -> CASE WHEN c = ' ' THEN named_struct('o', concat(p.o, ' '), 'k', p.k, 'd', p.d) ELSE named_struct('o', concat(p.o, substr(p.d, p.k, 1)), 'k', p.k + 1, 'd', p.d) END, p -> p.o)"
    iban = _bind("b", bare, _bind("n", body, _bind("x", head(check), spaced)))
    iban_ok = f"length({bare}) BETWEEN 15 AND 34 AND length(regexp_replace(substr({bare}, 5), '[^0-9]', '')) BETWEEN 2 AND 30 AND {_mod97(bare)} = 1"
    # A token behind a grouped number looks like one more group: of unknown countries, shorter runs of groups are tried too.
    runs = f"CASE WHEN {m} RLIKE '{_KNOWN_COUNTRY}' THEN array({m}) ELSE transform(sequence(size(split({m}, ' ')), least(size(split({m}, ' ')), 3), -1), z -> array_join(slice(split({m}, ' '), 1, z), ' ')) END"
    if again:
        rest, head = f"substr({m}, coalesce(length(v), 2) + 1)", f"CASE WHEN v IS NULL THEN substr({m}, 1, 2) ELSE {iban} END"
        inner = f"transform(regexp_extract_all({rest}, {_quoted(_AGAIN)}, 0), sub -> {_value(key, 'sub', False)})"
        found = _bind("subs", inner, f"named_struct('kinds', concat(CASE WHEN v IS NULL THEN cast(array() AS array<string>) ELSE array('iban') END, flatten(transform(subs, w -> w.kinds))), 'text', concat({head}, {_joined(rest, _AGAIN, 'subs')}))")
    else:
        found = f"CASE WHEN v IS NULL THEN {nothing} ELSE {made('iban', iban)} END"
    iban = _bind("v", f"get(filter({runs if again else f'array({m})'}, v -> {iban_ok}), 0)", found)

    octet = lambda k: _big(f"element_at(split({m}, '[.]'), {k})")
    ip = _feistel(key, "ip", f"{octet(1)} * 256 + {octet(2)}", f"{octet(3)} * 256 + {octet(4)}", "65536L", "65536L", "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)")

    area, group, serial = (_big(f"substr({d}, {a}, {n})") for a, n in ((1, 3), (4, 2), (6, 4)))
    ssn_ok = f"{area} BETWEEN 1 AND 899 AND {area} != 666 AND {group} > 0 AND {serial} > 0"
    new_area = "CASE WHEN s.l < 665 THEN s.l + 1 ELSE s.l + 2 END"
    ssn = _feistel(key, "ssn", f"CASE WHEN {area} < 666 THEN {area} - 1 ELSE {area} - 2 END", f"({group} - 1) * 9999 + {serial} - 1", "898L", "989901L", f"concat_ws('-', lpad(cast({new_area} AS string), 3, '0'), lpad(cast(s.r div 9999 + 1 AS string), 2, '0'), lpad(cast(s.r % 9999 + 1 AS string), 4, '0'))")

    # A number with a trunk 0 keeps its first two digits, so it stays one.
    trunk = f"{m} RLIKE '^0[1-9][0-9]{{0,3}}(?:[ -][0-9]{{2,8}}){{1,4}}$' AND NOT {m} RLIKE '^[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}$'"
    code = f"CASE WHEN {m} RLIKE '^[+][0-9]{{8,}}$' OR ({trunk}) THEN substr({m}, 1, 2) ELSE regexp_extract({m}, '^[+][0-9]+', 0) END"
    phone_ok = f"(CASE WHEN {trunk} THEN length({d}) BETWEEN 9 AND 12 ELSE length({d}) BETWEEN 8 AND 15 END)"
    rest = "substr(%s, length(h) + 1)" % m
    phone = _bind("h", code, f"concat(h, {_put(rest, _permuted_digits(key, 'phone', _digits(rest)))})")

    middle = f"substr({d}, 2, length({d}) - 2)"
    front = f"concat(substr({d}, 1, 1), {_permuted_digits(key, 'card', middle)})"
    open_end = "concat(g, '0')"
    card = _put(m, _bind("g", front, f"concat(g, cast((10 - {_luhn(open_end)}) % 10 AS string))"))
    date_ok, date = _date(key, m)
    return f"""CASE WHEN {is_('email')} THEN {made('email', email)}
        WHEN {is_('iban')} THEN {iban}
        WHEN {is_('ip')} THEN {made('ip', ip)}
        WHEN {is_('date')} THEN CASE WHEN {date_ok} THEN {made('date', date)} ELSE {nothing} END
        WHEN {is_('ssn')} THEN CASE WHEN {ssn_ok} THEN {made('ssn', ssn)} ELSE {nothing} END
        WHEN {is_('phone')} THEN CASE WHEN {phone_ok} THEN {made('phone', phone)} ELSE {nothing} END
        WHEN {is_('card')} THEN CASE WHEN {_luhn(d)} = 0 THEN {made('card', card)} ELSE {nothing} END
        ELSE {nothing} END"""


def pseudonyms(docs: DataFrame, key: str, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``docs`` with pseudonyms in the text, and in ``found_col`` the kinds of the values replaced, in order."""
    if not key:
        raise ValueError("the key must not be empty")
    text = f"`{text_col}`"
    found_, values = unused(docs, "__candidates"), unused(docs, "__values")
    some = f"{text} RLIKE '[0-9@]'"
    candidates = f"CASE WHEN {some} THEN regexp_extract_all({text}, {_quoted(PATTERN)}, 0) END"
    secret = unused(docs, "__secret")
    value = _value(secret, "m")
    keyed = docs.withColumn(secret, docs.sparkSession.createDataFrame([(key,)], "key string").scalar())
    step = keyed.withColumn(found_, F.expr(candidates)).withColumn(values, F.expr(f"CASE WHEN size({found_}) > 0 THEN transform({found_}, m -> {value}) END"))
    joined = f"CASE WHEN {values} IS NULL THEN {text} ELSE {_joined(text, PATTERN, values)} END"
    found = f"flatten(transform(coalesce({values}, array()), v -> v.kinds))"
    kept = [F.expr(joined).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c.lower() != found_col.lower()]
    return step.select(*kept, F.expr(found).alias(found_col))


def counted(done: DataFrame, found_col: str = "found") -> DataFrame:
    """One count for each kind instead of the list; columns named like a count give way."""
    counts = [F.expr(f"cast(size(filter({found_col}, k -> k = '{kind}')) AS bigint)").alias(f"n_{kind}") for kind in KINDS]
    own = {found_col.lower(), *(f"n_{kind}" for kind in KINDS)}
    return done.select(*[F.col(f"`{c}`") for c in done.columns if c.lower() not in own], *counts)
