"""Personal data: detection, and keyed surrogates of the same type and format.

All of it is SQL expressions. Detection is one regular expression with typed, validated matches. A
surrogate is a keyed permutation of the entity's characters within their classes (digits, and the small
and capital letters of each script), by an alternating Feistel network over SHA-2: the same entity gives
the same surrogate in every document, two entities of one format never meet, and format, case and script
stay. Cards and account numbers keep valid check digits, addresses stay in the range of their parts, country codes and top
domains stay, and given names move within the names of their gender and script.

A name is two entities: its family name, and its given name with that family. So a family keeps one
surrogate with and without given names and titles, and where it stands alone in a text that names it; and a person has one gender: what any of the titles of
that name says, else what the given name says.

What a permutation cannot promise is checked over the whole corpus: a surrogate that equals its own or
another real entity, or two entities with one surrogate (given names are drawn from short lists). Such
entities, and only they, get the next tweak of the key until none is left; names grow by some letters after
many, so that they never run out, and a format without a free value left raises an error. Entities are what is
shuffled for that, not texts: up to ``REKEYED`` re-keyed entities go to the documents as a literal map. Only
beyond that a map for each text is joined to the documents.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import cut, parser_caches_dropped, stored

KEY, REKEYED, ROUNDS = "lodestrata-surrogates-1", 50_000, 6
#: Parts of the literal map; an entity looks into one of them.
PARTS = 512
#: Tweaks after which an entity without a free surrogate is an error.
MOST = 400
#: Tweaks from which on a given name is a double one, is permuted letter by letter, and any name grows.
DOUBLE, SPELT, LONGER = 3, 16, 32

# Titles by gender, given names by gender and script, letters by class.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "госпожа"),
    "n": ("Dr", "Prof"),
}
GIVEN = {
    ("m", "latin"): "Adam Albert Antonio Arthur Bruno Carlos Daniel David Edward Felix George Hans Henry Hugo James Jean John Jorge Karl Louis Luis Mark Martin Michael Oscar Paul Peter Pierre Robert Thomas William".split(),
    ("f", "latin"): "Alice Amelie Ana Anna Beatriz Carmen Claire Clara Elena Elizabeth Emma Eva Frieda Greta Helen Ingrid Jane Julia Laura Lucia Marie Marta Mary Monique Nina Olivia Paula Rosa Sarah Sofia Susan".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Игорь Михаил Николай Олег Павел Сергей".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Ксения Мария Наталья Ольга Светлана Татьяна Юлия".split(),
}
LETTERS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX = ("0123456789", "abcdef", "ABCDEF")
SPOKEN = ("aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", *LETTERS[3:5], "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "АЕИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩЪЬ", *LETTERS[7:])

# Words between given and family name, and what keys of known services begin with.
PARTICLES = "von van der den de del della di da dos du la le ter zu bin al".split()
#: Country codes of telephone numbers: of one digit, of two, else of three.
COUNTRY = "(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
PREFIXES = "AKIA|ASIA|AIza|gh[a-z]_|github_pat_|glpat-|xox[a-z]-|(?:sk|pk|rk)_(?:live|test)_|sk-|eyJ"

_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GIVEN = "|".join(sorted({n for names in GIVEN.values() for n in names}, key=len, reverse=True))
_FIRST = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))
_FIRST_GIVEN = "".join(sorted({n[0] for names in GIVEN.values() for n in names}))
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:['’-]\p{Lu}?\p{Ll}++){0,3}"
_BETWEEN = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}"
_H = "[0-9A-Fa-f]{1,4}"
_TOKEN = r"[A-Za-z0-9_+/=.~-]"
#: Typed alternatives, in order. Every repeated group is bounded, so no text can exhaust the stack.
PATTERN = "|".join(
    (
        r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|(?:gh[a-z]_|github_pat_|glpat-)[A-Za-z0-9_-]{20,}+|xox[a-z]-[A-Za-z0-9-]{10,}+|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{16,}+|sk-[A-Za-z0-9_-]{20,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)(?![A-Za-z0-9_-])",
        r"(?<![0-9A-Za-z])(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])",
        r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,30}PRIVATE KEY-----",
        r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[\p{L}0-9-]{1,63}(?:\.[\p{L}0-9-]{1,63}){0,125}\.\p{L}{2,63}",
        rf"(?<![0-9.])(?:{_PART}\.){{3}}{_PART}(?![0-9]|\.[0-9])",
        rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*+[0-9])(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}}|(?:{_H}:){{2,7}}:|::(?:{_H}:){{0,6}}{_H})(?![0-9A-Za-z:])",
        r"(?<![0-9A-Za-z:-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![0-9A-Za-z:-])",
        r"(?<![0-9])[0-9]{13,19}(?![0-9])",
        r"(?<![0-9])3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
        r"(?<![0-9])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])",
        r"(?<![0-9A-Za-z+])\+1 ?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
        r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
        r"(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
        r"(?<![0-9-])[0-9]{3}(?:-[0-9]{2}-|(?<![0-9] [0-9]{3}) [0-9]{2} )[0-9]{4}(?![0-9-]| [0-9])",
        r"(?<![0-9])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![0-9]| [0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z]{0,4}[0-9]{10,26}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![A-Za-z0-9])",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9]{1,4})?(?![A-Za-z0-9])",
        rf"(?=[{_FIRST}])(?<!\p{{L}})(?:{_TITLE})\.? (?:{_WORD} {_BETWEEN}{_WORD}|{_BETWEEN}{_WORD})",
        rf"(?=[{_FIRST_GIVEN}])(?<![\p{{L}}'’-])(?:{_GIVEN}) {_BETWEEN}{_WORD}",
        rf"(?<=[=:\"' ])(?<=(?i:token|secret|password|passwd|api[_-]?key) {{0,2}}[=:] {{0,2}}[\"']?)(?=[A-Za-z_+/=.~-]*+[0-9]){_TOKEN}{{8,}}+",
    )
)
#: What every match holds: a digit, an at sign, a title or a given name. Texts without one are not searched further.
NEEDED = rf"[0-9@]|(?=[{_FIRST}])(?<!\p{{L}})(?:{_TITLE})\.? [\p{{Lu}}\p{{Ll}}]|(?=[{_FIRST_GIVEN}])(?<![\p{{L}}'’-])(?:{_GIVEN}) [\p{{Lu}}\p{{Ll}}]"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """body, in which ``name`` stands for value and value is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _core(x: str) -> str:
    return rf"regexp_replace({x}, '[^\\p{{L}}0-9]', '')"


def _moved(core: str, tweak: str, kind: str, letters: tuple[str, ...]) -> str:
    """The keyed permutation of a string of letters and digits, class by class, blind to case."""
    turn = "o"
    shift = "CASE " + " ".join(f"WHEN instr('{a}', c) > 0 THEN substr('{a}', cast(pmod(instr('{a}', c) - 1 + {turn}, {len(a)}) AS int) + 1, 1)" for a in letters) + " ELSE c END"
    other = "array_join(transform(cs, (c, i) -> if(i % 2 = r % 2, '', lower(c))), '')"
    digest = f"sha2(concat_ws('|', {_text(KEY)}, '{kind}', cast({tweak} AS string), cast(r AS string), cast(size(cs) AS string), {other}), 512)"
    offset = "cast(conv(substr(d, 1 + 2 * (i % 62), 5), 16, 10) AS bigint)"
    step = _let("d", digest, f"transform(cs, (c, i) -> if(i % 2 = r % 2, {_let('o', offset, shift)}, c))")
    return f"array_join(aggregate(sequence(0, {ROUNDS - 1}), transform(split({core}, ''), c -> c), (cs, r) -> {step}), '')"


def _refill(x: str, core: str) -> str:
    """x with its letters and digits replaced, in order, by those of core."""
    take = "struct(concat(s.out, substr(k, s.n + 1, 1)) AS out, s.n + 1 AS n)"
    keep = "struct(concat(s.out, c) AS out, s.n AS n)"
    walk = f"aggregate(split({x}, ''), struct('' AS out, 0 AS n), (s, c) -> if(c rlike '[\\\\p{{L}}0-9]', {take}, {keep}), s -> s.out)"
    return _let("k", core, walk)


def _check_digit(body: str) -> str:
    """The digit that makes the number valid."""
    doubled = "if(i % 2 = 0, 2 * cast(c AS int) - if(cast(c AS int) > 4, 9, 0), cast(c AS int))"
    return f"cast(pmod(-aggregate(transform(reverse(split({body}, '')), (c, i) -> {doubled}), 0, (a, b) -> a + b), 10) AS string)"


def _iban_rest(x: str) -> str:
    """What an account number without spaces leaves modulo 97: 1 where its check digits are right."""
    value = "if(c BETWEEN '0' AND '9', a * 10 + cast(c AS int), a * 100 + ascii(c) - 55)"
    return f"aggregate(split(concat(substr({x}, 5), substr({x}, 1, 4)), ''), 0, (a, c) -> if(c = '', a, ({value}) % 97))"


def kind_sql(x: str) -> str:
    """The type of a match; null for numbers that look like a card, or an account, but fail its check."""
    digits = f"regexp_replace({x}, '[ -]', '')"
    valid = f"{_check_digit(f'substr({digits}, 1, length({digits}) - 1)')} = right({digits}, 1)"
    return rf"""CASE WHEN instr({x}, '@') > 0 THEN 'email'
      WHEN {x} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'ip'
      WHEN {x} rlike '^[0-9]{{13,19}}$' OR {x} rlike '^[0-9]{{4}}([ -][0-9]{{4}}){{3}}$' OR {x} rlike '^3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}}$' THEN if({valid}, 'card', NULL)
      WHEN {x} rlike '^[0-9A-Fa-f]{{32,}}$' THEN 'secret'
      WHEN {x} rlike '^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$' OR {x} rlike '^[0-9A-Fa-f]{{2}}(-[0-9A-Fa-f]{{2}}){{5}}$' THEN 'ip6'
      WHEN {x} rlike '^[0-9]{{3}}[ -][0-9]{{2}}[ -][0-9]{{4}}$' THEN 'ssn'
      WHEN {x} rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z]{{0,4}}[0-9]{{10,26}}$' THEN 'iban'
      WHEN {x} rlike '^[A-Z]{{2}}[0-9]{{2}}( [0-9A-Z]{{4}} |[0-9A-Z]{{11,30}}$)' THEN if({_iban_rest(f"replace({x}, ' ', '')")} = 1, 'iban', NULL)
      WHEN {x} rlike '^(0[0-9]{{2,4}} |[+(])' OR {x} rlike '^[0-9]{{3}}-[0-9]{{3}}-[0-9]{{4}}$' THEN 'phone'
      WHEN {x} rlike {_text(f"^(?:(?:{_TITLE})[.]? |(?:{_GIVEN}) )")} THEN 'name'
      ELSE 'token' END"""


def norm_sql(x: str, kind: str) -> str:
    """What makes two spellings one entity. Case and separators don't count, but for a plus before a number."""
    plain = f"lower({_core(x)})"
    return f"CASE WHEN {kind} IN ('ip', 'ip6', 'email', 'token') THEN lower({x}) WHEN {kind} = 'phone' THEN concat(if({x} LIKE '+%', '+', ''), {plain}) ELSE {plain} END"


def name_parts(x: str) -> dict[str, str]:
    """The title (or nothing), the given name (or nothing), the words between, and the family name of a name."""
    title = f"regexp_extract({x}, {_text(f'^((?:{_TITLE})[.]?) ')}, 1)"
    words = f"split(if({title} = '', {x}, substr({x}, length({title}) + 2)), ' ')"
    given = f"if(size({words}) > 1 AND element_at({words}, 1) rlike '^[\\\\p{{Lu}}]', element_at({words}, 1), '')"
    between = f"filter({words}, (w, i) -> i < size({words}) - 1 AND NOT (i = 0 AND w rlike '^[\\\\p{{Lu}}]'))"
    return {"title": title, "given": given, "between": between, "family": f"element_at({words}, -1)"}


def gender_sql(title: str, given: str) -> str:
    """m or f by the title, else by the given name; else n."""
    among = lambda x, values: f"array_contains(array({', '.join(map(_text, values))}), {x})"
    known = {g: [n for (of, _), names in GIVEN.items() if of == g for n in names] for g in "mf"}
    plain = f"regexp_replace({title}, '[.]$', '')"
    return f"CASE WHEN {among(plain, TITLES['m'])} THEN 'm' WHEN {among(plain, TITLES['f'])} THEN 'f' WHEN {among(given, known['f'])} THEN 'f' WHEN {among(given, known['m'])} THEN 'm' ELSE 'n' END"


def _number(text: str, digits: int = 8) -> str:
    return f"cast(conv(substr(sha2({text}, 256), 1, {digits}), 16, 10) AS bigint)"


def _grown(x: str, name: str, tweak: str) -> str:
    """x, and from a tweak on the tweak spelt in letters of the script of ``name``."""
    letters = f"CASE WHEN {name} rlike '[\\\\p{{IsCyrillic}}]' THEN 'абвгдежзик' WHEN {name} rlike '[\\\\p{{IsGreek}}]' THEN 'αβγδεζηθικ' ELSE 'aeioumnrst' END"
    return f"if({tweak} < {LONGER}, {x}, concat({x}, translate(cast({tweak} AS string), '0123456789', {letters})))"


def _family_sql(family: str, tweak: str) -> str:
    return _grown(_refill(family, _moved(_core(family), tweak, "family", SPOKEN)), family, tweak)


def _given_sql(given: str, gender: str, tweak: str) -> str:
    """A given name of the gender and script: another of the list, then two of them, then permuted letters."""
    choices = []
    for (of, script), names in GIVEN.items():
        held = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
        right_script = f"{given} rlike '^[\\\\p{{IsCyrillic}}]'" if script == "cyrillic" else f"{given} rlike '^[\\\\p{{IsLatin}}]'"
        parity = _number(f"lower({given})", 2) + f" % 2 = {int(of == 'f')}"
        fits = f"{right_script} AND ({gender} = '{of}' OR ({gender} = 'n' AND {parity}))"
        own = _number(f"concat({_text(KEY)}, '|given|', lower({given}))")
        spot = f"if(array_contains({held}, {given}), array_position({held}, {given}), {own})"
        turn = _number(f"concat({_text(KEY)}, '|{of}{script}|', cast({tweak} AS string))") + f" % {len(names) - 1} + 1"
        one = f"element_at({held}, cast(pmod({spot} - 1 + {turn}, {len(names)}) AS int) + 1)"
        second = _number(f"concat({_text(KEY)}, '|second|', lower({given}), cast({tweak} AS string))")
        more = f"element_at({held}, cast(pmod({second}, {len(names)}) AS int) + 1)"
        choices += [(f"{tweak} < {DOUBLE} AND {fits}", one), (f"{tweak} < {SPELT} AND {fits}", f"concat({one}, '-', {more})")]
    spelt = _grown(_refill(given, _moved(_core(given), tweak, "given", SPOKEN)), given, tweak)
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in choices) + f" ELSE {spelt} END"


def _address_sql(x: str, tweak: str) -> str:
    part = lambda i: f"cast(element_at(split({x}, '[.]'), {i}) AS int)"
    mix = f"cast(conv(substr(sha2(concat_ws('|', {_text(KEY)}, 'ip', cast({tweak} AS string), cast(r AS string), cast(s.b AS string)), 256), 1, 4), 16, 10) AS int)"
    run = f"aggregate(sequence(0, {ROUNDS - 1}), struct({part(1)} * 256 + {part(2)} AS a, {part(3)} * 256 + {part(4)} AS b), (s, r) -> struct(s.b AS a, s.a ^ {mix} AS b))"
    return _let("v", run, "concat_ws('.', cast(v.a div 256 AS string), cast(v.a % 256 AS string), cast(v.b div 256 AS string), cast(v.b % 256 AS string))")


def surrogate_sql(x: str, kind: str, tweak: str) -> str:
    """The surrogate of a match of this kind under a tweak; the match itself where the kind is null."""
    whole = lambda y, k, letters: _refill(y, _moved(_core(y), tweak, k, letters))
    at = f"(length({x}) - length(regexp_extract({x}, '([.]example)?[.]\\\\p{{L}}+$', 0)))"  # reserved domains stay reserved
    email = f"concat({whole(f'substr({x}, 1, {at})', 'email', LETTERS)}, substr({x}, {at} + 1))"
    digits = f"regexp_replace({x}, '[ -]', '')"
    body = _moved(f"substr({digits}, 1, length({digits}) - 1)", tweak, "card", LETTERS[:1])
    card = _refill(x, _let("b", body, f"concat(b, {_check_digit('b')})"))
    led = f"regexp_extract({x}, '^(?:[+]{COUNTRY}|0)', 0)"  # the country code, or the zero before an area
    phone = f"concat({led}, {whole(f'substr({x}, length({led}) + 1)', 'phone', LETTERS[:1])})"
    account = f"replace({x}, ' ', '')"
    check = f"lpad(cast(98 - {_iban_rest('concat(left(i, 2), \'00\', b)')} AS string), 2, '0')"  # right check digits stay right
    valid = _let("i", account, _let("b", _moved("substr(i, 5)", tweak, "iban", LETTERS[:3]), _refill(x, f"concat(left(i, 2), {check}, b)")))
    iban = f"if({_iban_rest(account)} = 1, {valid}, concat(substr({x}, 1, 2), {whole(f'substr({x}, 3)', 'iban', LETTERS[:3])}))"
    prefix = f"regexp_extract({x}, '^(?:{PREFIXES}|-----BEGIN [A-Z ]*-----)', 0)"
    suffix = f"regexp_extract({x}, '-----END [A-Z ]*-----$', 0)"
    token = f"concat({prefix}, {whole(f'substr({x}, length({prefix}) + 1, length({x}) - length({prefix}) - length({suffix}))', 'token', LETTERS[:3])}, {suffix})"
    return f"""CASE {kind} WHEN 'email' THEN {email} WHEN 'ip' THEN {_address_sql(x, tweak)} WHEN 'card' THEN {card}
      WHEN 'secret' THEN {_moved(x, tweak, 'secret', HEX)} WHEN 'ssn' THEN {whole(x, 'ssn', LETTERS[:1])}
      WHEN 'iban' THEN {iban} WHEN 'phone' THEN {phone} WHEN 'ip6' THEN {whole(x, 'ip6', HEX)} WHEN 'token' THEN {token} ELSE {x} END"""


def matches(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(NEEDED), found).when(text.isNotNull(), F.array().cast("array<string>"))


def mentions(found: DataFrame) -> DataFrame:
    """``found`` (entity, ..) with kind, norm, spelling, gender and scope: a row for each entity that a match names.

    A name gives its family, and with a given name the two together, whose scope is the family.
    """
    rest = [c for c in found.columns if c != "entity"]
    with parser_caches_dropped(found.sparkSession):
        typed = found.withColumn("kind", F.expr(kind_sql("entity"))).where("kind is not null")
    plain = f"named_struct('kind', kind, 'norm', {norm_sql('entity', 'kind')}, 'spelling', entity, 'gender', 'n', 'scope', '')"
    low, both = "lower(p.family)", "lower(concat(p.given, ' ', p.family))"
    families = f"named_struct('kind', 'family', 'norm', {low}, 'spelling', p.family, 'gender', 'n', 'scope', '')"
    people = f"named_struct('kind', 'name', 'norm', {both}, 'spelling', p.given, 'gender', {gender_sql('p.title', 'p.given')}, 'scope', {low})"
    split = _let("p", _struct(name_parts("entity")), f"if(p.given = '', array({families}), array({families}, {people}))")
    with parser_caches_dropped(found.sparkSession):
        return typed.select(*rest, F.explode(F.expr(f"if(kind = 'name', {split}, array({plain}))")).alias("m")).select(*rest, "m.*")


def _struct(fields: dict[str, str]) -> str:
    return "named_struct(" + ", ".join(f"'{c}', {x}" for c, x in fields.items()) + ")"


def entities(docs: DataFrame) -> DataFrame:
    """(kind, norm, scope, spelling, gender, mixed): the entities of the corpus, once; mixed where spellings differ in gender."""
    found = docs.select(F.explode(matches(F.col("text").cast("string"))).alias("entity")).distinct()
    gender = F.when(F.count_if(F.col("gender") == "f") > 0, "f").when(F.count_if(F.col("gender") == "m") > 0, "m").otherwise("n")
    return mentions(found).groupBy("kind", "norm", "scope").agg(F.min("spelling").alias("spelling"), gender.alias("gender"), (F.min("gender") != F.max("gender")).alias("mixed"))


def _made(known: DataFrame) -> DataFrame:
    """``known`` with made, the surrogate under its tweak as it is compared."""
    family, given = f"lower({_family_sql('spelling', 'tweak')})", f"lower({_given_sql('spelling', 'gender', 'tweak')})"
    other = _let("y", surrogate_sql("spelling", "kind", "tweak"), norm_sql("y", "kind"))
    with parser_caches_dropped(known.sparkSession):
        return known.withColumn("made", F.expr(f"CASE kind WHEN 'family' THEN {family} WHEN 'name' THEN {given} ELSE {other} END"))


def rekeyed(docs: DataFrame) -> DataFrame:
    """(kind, norm, tweak, gender) of the entities that need more than tweak 0 and their own spelling's gender.

    An entity whose surrogate is real, or which shares one, gets the next tweak: of those that share one, all
    but the first by norm; those that are settled stay as they are.
    """
    known = cut(_made(entities(docs).withColumn("tweak", F.lit(0))))
    real = known.where("kind <> 'name'").select("kind", F.col("norm").alias("made"))
    key, place = ["kind", "norm", "scope"], ["kind", "scope", "made"]
    settled, open_, rounds = [], known, 0
    while True:
        own = open_.where("kind = 'name' AND made = lower(spelling)").select(*key)
        taken = open_.join(real, ["kind", "made"], "left_semi").select(*key)
        first = open_.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("norm").alias("first")).where("n > 1")
        clash = own.unionByName(taken).unionByName(open_.join(first, place).where("norm <> first").select(*key))
        for done in settled:
            clash = clash.unionByName(open_.join(done.select(*place), place, "left_semi").select(*key))
        clash = cut(clash.distinct())
        if not clash.count():
            break
        rounds += 1
        if rounds > MOST:
            raise ValueError(f"no free surrogate is left for some entities, of kind {clash.first()['kind']}")
        settled.append(cut(open_.join(clash, key, "left_anti")))
        open_ = cut(_made(open_.join(clash, key, "left_semi").drop("made").withColumn("tweak", F.col("tweak") + 1)))
        if len(settled) > 6:
            whole = settled[0]
            for more in settled[1:]:
                whole = whole.unionByName(more)
            settled = [stored(whole)]
    for more in settled:
        open_ = open_.unionByName(more)
    return open_.where("tweak > 0 OR mixed").select("kind", "norm", "tweak", F.when(F.col("mixed"), F.col("gender")).otherwise("").alias("gender"))


def replace(docs: DataFrame) -> DataFrame:
    """``docs`` with every column kept, ``text`` rewritten, and ``n_entities``, the number of replacements.

    An input column called n_entities is replaced; others may have any name. Null texts stay null, empty texts
    empty; texts without an entity come back byte for byte. Repeated rows are rewritten alike. Entities of a
    text of any length are found; a number of a card's length that fails its check digit is none.
    """
    few = cut(rekeyed(docs).select(F.concat_ws("|", "kind", "norm").alias("key"), F.concat_ws("|", F.col("tweak").cast("string"), "gender").alias("value")))
    count = few.count()
    text = docs.withColumn("text", F.col("text").cast("string"))
    tweaks, found, gaps, at, named = (f"{c}_{len(docs.columns)}_{'_'.join(docs.columns)}" for c in ("tweaks", "found", "gaps", "at", "named"))  # no column's name
    if count <= REKEYED:  # a literal of at most REKEYED entries, in parts
        parts: list[dict[str, str]] = [{} for _ in range(PARTS if count > PARTS else 1)]
        for r in few.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(len(parts)))).collect() if count else []:
            parts[r["part"]][r["key"]] = r["value"]
        given = text.withColumn(tweaks, F.from_json(F.lit(json.dumps(parts)), "array<map<string, string>>"))
    else:
        held = mentions(text.select(F.xxhash64("text").alias("at"), F.explode(matches(F.col("text"))).alias("entity")).distinct())
        maps = held.select("at", F.concat_ws("|", "kind", "norm").alias("key")).distinct().join(few, "key").groupBy("at").agg(
            F.array(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias(tweaks)  # the entities of one text
        )
        given = text.withColumn(at, F.xxhash64("text")).join(maps.withColumnRenamed("at", at), at, "left").drop(at)

    def look(key: str) -> str:
        part = f"element_at(`{tweaks}`, cast(pmod(xxhash64(y), size(`{tweaks}`)) AS int) + 1)"
        return _let("y", key, f"if(`{tweaks}` IS NULL, '0|', coalesce(try_element_at({part}, y), '0|'))")

    tweak_of = lambda v: f"cast(substring_index({v}, '|', 1) AS int)"
    gender = f"if(substring_index(v, '|', -1) = '', {gender_sql('p.title', 'p.given')}, substring_index(v, '|', -1))"
    person = _let("v", look("concat('name|', lower(concat(p.given, ' ', p.family)))"), _let("h", gender, _let("w", tweak_of("v"), _given_sql("p.given", "h", "w"))))
    family = _let("w", tweak_of(look("concat('family|', lower(p.family))")), _family_sql("p.family", "w"))
    name = _let("p", _struct(name_parts("e")), f"concat_ws(' ', nullif(p.title, ''), if(p.given = '', NULL, {person}), p.between, {family})")
    other = _let("w", tweak_of(look(f"concat_ws('|', k, {norm_sql('e', 'k')})")), surrogate_sql("e", "k", "w"))
    each = _let("k", kind_sql("e"), f"CASE WHEN k IS NULL THEN e WHEN k = 'name' THEN {name} ELSE {other} END")
    # A family that the text names stays one where it stands alone.
    families = f"array_distinct(transform(filter(`{found}`, e -> ({kind_sql('e')}) = 'name'), e -> {_let('p', _struct(name_parts('e')), f"struct(p.family AS real, {family} AS made)")}))"
    alone = "regexp_replace(t, concat('(?<![\\\\p{L}@.])', n.real, '(?!\\\\p{L})'), n.made)"
    new = f"array_join(flatten(zip_with(`{gaps}`, `{found}`, (g, e) -> array(aggregate(`{named}`, coalesce(g, ''), (t, n) -> {alone}), if(e IS NULL, '', {each})))), '')"
    split_up = given.withColumn(found, matches(F.col("text")))
    split_up = split_up.withColumn(gaps, F.when(F.size(found) > 0, F.split("text", PATTERN, -1)))
    with parser_caches_dropped(docs.sparkSession):
        split_up = split_up.withColumn(named, F.when(F.size(found) > 0, F.expr(families)))
        return split_up.withColumns(
            {
                "text": F.when(F.size(found) > 0, F.expr(new)).otherwise(F.col("text")),
                "n_entities": F.expr(f"coalesce(size(filter(`{found}`, e -> ({kind_sql('e')}) IS NOT NULL)), 0)"),
            }
        ).drop(tweaks, found, gaps, named)
