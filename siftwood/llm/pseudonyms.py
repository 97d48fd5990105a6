"""Format-preserving pseudonyms for personal numbers and dates, in DataFrame functions alone.

Payment card numbers (13 to 19 digits, Luhn), telephone numbers, IPv4 addresses, US social security numbers, IBANs (length of the country, mod 97) and dates
are found, validated, and permuted inside their own format by a keyed Feistel network whose round function is
SHA-256. The permutation is one-to-one on each format, so equal values stay linked across documents and different ones
stay apart; separators stay where they are, and a pseudonym passes the same validation (check digits are
recomputed; dates and social security numbers walk the cycle until they are valid). The local part of e-mail
addresses and secrets (hexadecimal, or after a known prefix, which stays) are no numbers of a bounded format; a keyed digest of the same length and kind of letters replaces them.

Ten digits without separators are a telephone number after a word such as tel or call, and nine a social security number after ssn or social security; elsewhere
such numbers are mostly something else and stay. Dates by day first are tried before dates by month first, whose pseudonyms have a day above 12, so the two stay apart.

The text is split at the matches and joined again with their pseudonyms, so nothing else changes. A match that fails its validation is searched once more inside. No shuffle.

Defined cases: invalid numbers (a card number that fails its check digit, an octet above 255, 30 February) and dates outside 1900 to 2099
are left as they are. A null text stays null, with zero counts; an empty one stays empty. Texts of any length are read whole. Rows are independent: ids may be null or repeated. Ties:
at one place the kinds are tried in the order of `KINDS`. Other columns are ignored by the query form and kept by `pseudonymise`. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: Country codes of telephones with one and with two digits; all others have three.
_CC1, _CC2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: What the formats look like, in the order in which they are tried at a place.
_EMAIL = r"[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(f"(?:{'|'.join(c.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
_DATE = r"(?<![0-9.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./](?:19|20)[0-9]{2})(?![0-9-]|\.[0-9])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])|(?<=(?i:ssn|social security)[^0-9]{1,12})[0-9]{9}(?![0-9])"
_PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<![0-9])[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{1,4}){2,6}(?![0-9])|(?<=(?i:tel|phone|call|mobile|cell|fax)[^0-9A-Za-z]{1,4})[0-9]{10}(?![0-9])"
_KEYED = r"sk-[A-Za-z0-9_-]{20,200}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,200}"
_SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32,64}|" + _KEYED + r")(?![A-Za-z0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
_ANY = "|".join((_EMAIL, _IBAN, _DATE, _IP, _SSN, _PHONE, _SECRET, _CARD))
#: What may stand inside a match that fails its validation.
_INNER = "|".join((_DATE, _IP, _SSN, _PHONE, _CARD))
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "secret", "card")
#: The days from 1900-01-01 to 2099-12-31 and a product of two radices just above them.
_DAYS, _RADIX = 73049, (271, 270)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(a: str, b: str, radix_a: str, radix_b: str, tag: str, key: str) -> str:
    """SQL of the struct (a, b) after the rounds: halves of any radix take turns."""
    f = lambda half, radix: f"pmod(CAST(conv(substr(sha2(concat_ws('|', {_sql(key)}, {tag}, i, acc.{half}), 256), 1, 15), 16, 10) AS BIGINT), {radix})"
    step = f"IF(i % 2 = 0, struct(pmod(acc.a + {f('b', radix_a)}, {radix_a}) AS a, acc.b AS b), struct(acc.a AS a, pmod(acc.b + {f('a', radix_b)}, {radix_b}) AS b))"
    return f"aggregate(sequence(1, {ROUNDS}), struct(CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b), (acc, i) -> {step})"


def _digits(d: str, tag: str, key: str) -> str:
    """SQL: a string of 2 to 36 digits, permuted among those of its length."""
    u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    ten = lambda n: f"CAST(pow(10, {n}) AS BIGINT)"
    done = _feistel(f"substr({d}, 1, {u})", f"substr({d}, {u} + 1)", ten(u), ten(v), f"concat({tag}, length({d}))", key)
    return f"transform(array({done}), s -> concat(lpad(CAST(s.a AS STRING), {u}, '0'), lpad(CAST(s.b AS STRING), {v}, '0')))[0]"


def _luhn_sum(d: str, shift: int) -> str:
    """SQL: the Luhn sum of a digit string; shift 0 where its last digit is the check digit, 1 before it is appended."""
    digit = f"CAST(substr({d}, length({d}) - k, 1) AS INT)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + IF((k + {shift}) % 2 = 1, 2 * {digit} - IF({digit} > 4, 9, 0), {digit}))"


def _mod97(s: str) -> str:
    """SQL: an IBAN's letters and digits, rearranged, modulo 97."""
    c = f"substr(concat(substr({s}, 5), substr({s}, 1, 4)), k, 1)"
    return f"aggregate(sequence(1, length({s})), 0, (t, k) -> IF({c} rlike '[0-9]', (t * 10 + CAST({c} AS INT)) % 97, (t * 100 + ascii({c}) - 55) % 97))"


def _refill(match: str, new: str, among: str) -> str:
    """SQL: the match with the characters of a class replaced, in turn, by those of another string."""
    return f"aggregate(split({match}, ''), struct('' AS out, 0 AS k), (acc, c) -> IF(c rlike '{among}', struct(concat(acc.out, substr({new}, acc.k + 1, 1)) AS out, acc.k + 1 AS k), struct(concat(acc.out, c) AS out, acc.k AS k)), acc -> acc.out)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with a name for a value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _day_first(m: str) -> str:
    return f"coalesce(try_to_date({m}, 'yyyy-MM-dd'), try_to_date({m}, 'dd.MM.yyyy'), try_to_date({m}, 'dd/MM/yyyy'))"


def _is_date(m: str) -> str:
    return f"coalesce({_day_first(m)}, try_to_date({m}, 'MM/dd/yyyy'))"


def kind_of(m: str) -> str:
    """SQL: the kind of a match, or null where it isn't valid."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    return f"""CASE
      WHEN {m} LIKE '%@%' THEN 'email'
      WHEN {m} rlike {_sql(f"^(?:{_KEYED})$")} THEN 'secret'
      WHEN {m} rlike '^[A-Z]{{2}}[0-9]{{2}}' AND NOT {m} rlike '^[0-9a-fA-F]{{32,64}}$' THEN IF({_let(f"replace({m}, ' ', '')", 'ib', f"{_mod97('ib')} = 1")}, 'iban', NULL)
      WHEN {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$|^[0-9]{{2}}[./][0-9]{{2}}[./][0-9]{{4}}$' THEN IF({_is_date(m)} IS NOT NULL, 'date', NULL)
      WHEN {m} rlike '^[0-9]+([.][0-9]+){{3}}$' THEN IF(forall(split({m}, '[.]'), o -> CAST(o AS INT) <= 255), 'ip', NULL)
      WHEN {m} rlike '^[0-9]{{3}}-?[0-9]{{2}}-?[0-9]{{4}}$' THEN IF({_valid_ssn(d)}, 'ssn', NULL)
      WHEN {m} rlike '^[0-9a-fA-F]{{32,64}}$' THEN 'secret'
      WHEN {m} rlike '^([0-9]{{13,19}}|[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9 -]+|[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}})$' THEN IF(length({d}) BETWEEN 13 AND 19 AND {_luhn_sum(d, 0)} % 10 = 0, 'card', NULL)
      ELSE IF(length({d}) BETWEEN 8 AND 15, 'phone', NULL) END"""


def _valid_ssn(d: str) -> str:
    return f"(substr({d}, 1, 3) NOT IN ('000', '666') AND substr({d}, 1, 1) <> '9' AND substr({d}, 4, 2) <> '00' AND substr({d}, 6) <> '0000')"


def pseudonym(m: str, key: str, rejected: str = "") -> str:
    """SQL: the pseudonym of a valid match; of another, `rejected`, or the match itself."""
    d = f"regexp_replace({m}, '[^0-9]', '')"
    card = _let(d, "dg", _let(_digits("substr(dg, 1, length(dg) - 1)", "'card'", key), "py", _refill(m, f"concat(py, CAST(pmod(-({_luhn_sum('py', 1)}), 10) AS STRING))", "[0-9]")))
    # the country code stays, the rest is permuted
    one, two = (", ".join(f"'{c}'" for c in cc) for cc in (_CC1, _CC2))
    code = f"CASE WHEN NOT {m} LIKE '+%' THEN greatest(0, length(dg) - 10) WHEN substr(dg, 1, 1) IN ({one}) THEN 1 WHEN substr(dg, 1, 2) IN ({two}) THEN 2 ELSE 3 END"
    local = _let("substr(dg, cc + 1)", "lc", _digits("lc", "'phone'", key))
    phone = _let(d, "dg", _let(code, "cc", _refill(m, f"concat(substr(dg, 1, cc), {local})", "[0-9]")))
    ip = _let(f"transform(split({m}, '[.]'), o -> CAST(o AS BIGINT))", "oc", _let(_feistel("oc[0] * 256 + oc[1]", "oc[2] * 256 + oc[3]", "65536", "65536", "'ip'", key), "fs", "concat_ws('.', fs.a div 256, fs.a % 256, fs.b div 256, fs.b % 256)"))
    walk_ssn = f"aggregate(sequence(1, 24), {_digits('dg', chr(39) + 'ssn' + chr(39), key)}, (cur, wk) -> IF({_valid_ssn('cur')}, cur, {_digits('cur', chr(39) + 'ssn' + chr(39), key)}))"
    ssn = _let(d, "dg", _refill(m, walk_ssn, "[0-9]"))
    a, b = _RADIX
    one_day = lambda x: _let(_feistel(f"{x} div {b}", f"{x} % {b}", str(a), str(b), "'date'", key), "fs", f"fs.a * {b} + fs.b")
    # a month-first date walks on to a day above 12, as no day-first date reads
    held = f"cur < {_DAYS} AND ({_day_first(m)} IS NOT NULL OR day(date_add(DATE'1900-01-01', CAST(cur AS INT))) > 12)"
    walk_day = f"aggregate(sequence(1, 40), {one_day('dy')}, (cur, wk) -> IF({held}, cur, {one_day('cur')}))"
    day = _let(f"CAST(datediff({_is_date(m)}, DATE'1900-01-01') AS BIGINT)", "dy", _let(f"date_add(DATE'1900-01-01', CAST({walk_day} AS INT))", "nd", f"CASE WHEN {m} LIKE '%-%' THEN date_format(nd, 'yyyy-MM-dd') WHEN {m} LIKE '%/%' THEN date_format(nd, IF({_day_first(m)} IS NOT NULL, 'dd/MM/yyyy', 'MM/dd/yyyy')) ELSE date_format(nd, 'dd.MM.yyyy') END"))
    # the country and the letters stay; the digits after the check digits are permuted in runs of up to 18 and the check digits follow
    bban = "substr(ib, 5)"
    inner = f"regexp_replace({bban}, '[^0-9]', '')"
    fresh = _let(inner, "dg", f"IF(length(dg) < 2, dg, IF(length(dg) <= 18, {_digits('dg', chr(39) + 'iban' + chr(39), key)}, concat({_digits('substr(dg, 1, 12)', chr(39) + 'iban1' + chr(39), key)}, {_digits('substr(dg, 13)', chr(39) + 'iban2' + chr(39), key)})))")
    checked = _let(f"concat(substr(ib, 1, 2), '00', {_refill(bban, fresh, '[0-9]')})", "nb", f"concat(substr(nb, 1, 2), lpad(CAST(98 - {_mod97('nb')} AS STRING), 2, '0'), substr(nb, 5))")
    iban = _let(f"replace({m}, ' ', '')", "ib", _let(checked, "ni", _refill(m, "ni", "[A-Z0-9]")))
    email = f"concat('u', substr(sha2(concat_ws('|', {_sql(key)}, 'email', lower({m})), 256), 1, 12), substr({m}, instr({m}, '@')))"
    digest = "concat(" + ", ".join(f"sha2(concat_ws('|', {_sql(key)}, 'secret', {n}, {m}), 256)" for n in range(4)) + ")"
    known = _let(f"regexp_extract({m}, '^(sk-|AKIA|gh[pousr]_|xox[abprs]-)', 1)", "pre", f"concat(pre, {_refill(f'substr({m}, length(pre) + 1)', f'IF(pre = {chr(39)}AKIA{chr(39)}, upper({digest}), {digest})', '[A-Za-z0-9]')})")
    secret = f"IF({m} rlike '^[0-9a-fA-F]+$', substr({digest}, 1, length({m})), {known})"
    return f"CASE {kind_of(m)} WHEN 'card' THEN {card} WHEN 'phone' THEN {phone} WHEN 'ip' THEN {ip} WHEN 'ssn' THEN {ssn} WHEN 'date' THEN {day} WHEN 'iban' THEN {iban} WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} ELSE {rejected or m} END"


def _with_matches(df: DataFrame, text: Column) -> DataFrame:
    some = text.rlike(r"[0-9]{3}|@|[0-9][./-][0-9]|sk-|AKIA|gh[pousr]_|xox[abprs]-")
    found = F.when(some, F.regexp_extract_all(text, F.lit(f"({_ANY})"), F.lit(1)))
    return df.withColumn("__pii_found", F.coalesce(found, F.array().cast("array<string>")))


def _joined(text: str, pattern: str, fresh: str) -> str:
    """SQL: the text with its matches replaced, in turn. The pieces between matches are one more than the matches."""
    return f"array_join(zip_with(split({text}, {_sql(pattern)}, -1), {fresh}, (p, q) -> concat(coalesce(p, ''), coalesce(q, ''))), '')"


def _replaced(text: str, key: str) -> str:
    """SQL: the text with its matches replaced; inside a rejected match, what is valid there."""
    inside = f"regexp_extract_all(m, {_sql(f'({_INNER})')}, 1)"
    again = f"IF(size({inside}) = 0, m, {_joined('m', _INNER, f'transform({inside}, n -> {pseudonym(chr(110), key)})')})"
    fresh = f"transform(__pii_found, m -> {pseudonym('m', key, again)})"
    return f"CASE WHEN size(__pii_found) = 0 THEN {text} ELSE {_joined(text, _ANY, fresh)} END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts and all of their columns."""
    df = _with_matches(docs, F.col(text_col).cast("string"))
    return df.withColumn(text_col, F.expr(_replaced(f"CAST(`{text_col}` AS STRING)", key))).drop("__pii_found")


def pseudonym_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text with pseudonyms, and the number of values of each kind."""
    df = _with_matches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), F.col("text"))
    inside = f"transform(regexp_extract_all(m, {_sql(f'({_INNER})')}, 1), n -> {kind_of('n')})"
    df = df.withColumn("kinds", F.expr(f"flatten(transform(__pii_found, m -> {_let(kind_of('m'), 'kd', f'IF(kd IS NULL, {inside}, array(kd))')}))"))
    counts = [F.expr(f"CAST(size(filter(kinds, k -> k = '{k}')) AS BIGINT)").alias(f"n_{k}") for k in KINDS]
    return df.select("doc_id", F.expr(_replaced("text", key)).alias("text"), *counts)
