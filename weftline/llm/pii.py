"""Operator 6 [native]: personal data is found and replaced by surrogates.

Each kind of entity has a pattern, and a form in which its spellings agree: the same address or number,
however written, gets the same surrogate. Numbers with check digits count only if these are right.
The form of a name is each of its words by itself, so a person's full name, surname and titles agree;
words of a titled name are also replaced where they stand alone in the same document.
Surrogates come from a keyed hash (HMAC): a letter becomes a letter of its case and script, a digit a digit, and
what the kind asks for holds (octets, check digits, prefixes, the gender that titles tell, the script of
a name). The distinct forms of the whole corpus are checked: no two share a surrogate, and no
surrogate is a form that occurs; those that do are drawn anew, longer ones where short ones are scarce.
Then the spellings are laid out as they were.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import cut

_NAME = r"\p{Lu}(?=['’-]?[\p{L}\p{M}])[\p{L}\p{M}]*+(?:['’-][\p{L}\p{M}]++){0,3}(?!\p{N})"
#: What of a name gets a surrogate; single letters (O'Brien, a possessive s) stay.
_PART = r"[\p{L}\p{M}]{2,}"
_MALE = r"Mr|Herr|Monsieur|Señor|Sr|Don|г-н|господин|κ"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|г-жа|госпожа|κα"
_EITHER = r"Dr|Prof|д-р"
_TITLE = rf"^(?:{_MALE}|{_FEMALE}|{_EITHER})\.? "
_SECRET = r"(?i:password|passwd|pwd|secret|api[_-]?key|token)\s{0,3}[=:]"
#: Kinds and their patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,126}\.(?:xn--[a-z0-9-]+|\p{L}{2,})",
    "secret": rf"{_SECRET}\s{{0,3}}[\"']?[A-Za-z0-9_+/.-]*[A-Za-z0-9_+/-]{{8,}}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,2}|(?:[ .-]\d{2,4}){3,4}|\d{8,12})(?!\d)"
    r"|(?<![\w+)-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w.+-])\d{3}(?:-\d{3}-\d{4}(?![\w-])|\.\d{3}\.\d{4}(?!\.?\w))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])[2-6](?:[ -]?\d){12,18}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\w)",
    "ip6": r"(?<![\w:.])(?=[A-Fa-f:]{0,20}\d)[0-9A-Fa-f]{1,4}(?:(?::[0-9A-Fa-f]{1,4}){7}|(?::[0-9A-Fa-f]{1,4}){1,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_MALE}|{_FEMALE}|{_EITHER})\.? {_NAME}(?: (?!(?:{_MALE}|{_FEMALE}|{_EITHER})(?!\p{{L}})){_NAME}){{0,2}}",
}
_INITIALS = "MHFSDPгдκ"
assert all(x[0] in _INITIALS for x in f"{_MALE}|{_FEMALE}|{_EITHER}".split("|"))


def _tried(*kinds: str) -> str:
    return "|".join(f"(?:{PATTERNS[k]})" for k in kinds)


#: All kinds but addresses with @, each tried only at characters that it can begin with.
ANY = rf"(?=[pPsSaAtT]){_tried('secret')}|(?=[0-9+(A-Z{_INITIALS}])(?:{_tried('key', 'phone', 'ssn', 'card', 'iban', 'ip', 'ip6', 'person')})|(?=[a-f][0-9a-f]{{0,3}}:){_tried('ip6')}"
#: Also addresses with @.
ANY_AT = rf"{_tried('email')}|{ANY}"
#: In documents with a titled name, also what may be a word of it.
_WORD = r"(?:(?<![\p{L}\p{M}\p{N}])\p{Lu}[\p{L}\p{M}]++)"
WITH_NAMES = rf"{ANY_AT}|{_WORD}"


def hinted(text: Column) -> Column:
    """Whether the text has something that every entity has: a digit or @, or else the beginning of a secret, key or name."""
    others = [rf"(?=[pPsSaAtT]){_SECRET}", "A[KS]IA[A-Z]{16}", rf"(?=[{_INITIALS}])(?:{_MALE}|{_FEMALE}|{_EITHER})\.? \p{{Lu}}"]
    found = text.rlike("[0-9@]")
    for x in others:
        found = found | text.rlike(x)
    return F.coalesce(found, F.lit(False))


DIGITS = ["phone", "ssn", "card"]
NAMES = ["person", "name"]
#: After so many attempts, and again each time, surrogates become longer, so that small spaces do not run out.
WIDER = 2
#: How many there are of the kinds that can't be made longer.
SPACES = {"ssn": 10**9, "ip": 1 << 32}
#: Syllables of names and their ends by gender.
SYLLABLES = {
    "Cyrillic": (["ба", "ве", "го", "да", "до", "за", "ка", "ла", "ли", "ма", "ми", "на", "не", "но", "па", "ре", "ро", "са", "си", "та", "те", "ва", "ви", "ра"], {"m": "н", "f": "а", "n": "р"}),
    "Greek": (["βα", "γε", "γο", "δα", "δο", "ζα", "κα", "λα", "λι", "μα", "μι", "να", "νε", "νο", "πα", "ρε", "ρο", "σα", "σι", "τα", "τε", "φα", "φι", "ρα"], {"m": "ς", "f": "α", "n": "ν"}),
    "Latin": (["ba", "be", "co", "da", "do", "fe", "ga", "ka", "la", "li", "ma", "mi", "na", "ne", "no", "pa", "re", "ro", "sa", "si", "ta", "te", "va", "vi"], {"m": "n", "f": "a", "n": "r"}),
}
#: Letters that stand in for others of their kind; the rest of the world's become a to z.
ALPHABETS = {"[а-яё]": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "[А-ЯЁ]": "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "[α-ω]": "αβγδεζηθικλμνξοπρστυφχψω", "[ß-öø-ÿ]": "àáâãäåèéêëìíîïòóôõöùúûü", r"\p{L}": "abcdefghijklmnopqrstuvwxyz"}


def kind_of(entity: Column) -> Column:
    """The first kind whose pattern the whole entity has; ``name`` for a word alone."""
    out = F.lit("name")
    for kind in reversed(PATTERNS):
        out = F.when(entity.rlike(rf"^(?:{PATTERNS[kind]})\z"), kind).otherwise(out)
    return out


def form_of(entity: Column, kind: Column) -> Column:
    """What spellings of one entity have in common (of names, see ``parts_of``)."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        # a number without a country's code has that of ``+1``, as its layout does
        F.when((kind == "phone") & ~entity.startswith("+"), F.concat(F.lit("1"), digits))
        .when(kind.isin(DIGITS), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("email", "ip6"), F.lower(entity))
        .when(kind == "secret", F.regexp_extract(entity, r"[A-Za-z0-9_+/.-]+\z", 0))
        .otherwise(entity)
    )


def parts_of(entity: Column) -> Column:
    """The words of a name, in lower case."""
    return F.regexp_extract_all(F.lower(F.regexp_replace(entity, _TITLE, "")), F.lit(f"({_PART})"), F.lit(1))


def _gender(entity: Column) -> Column:
    return F.when(entity.rlike(rf"^(?:{_FEMALE})\.? "), "f").when(entity.rlike(rf"^(?:{_MALE})\.? "), "m").otherwise("n")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substr(text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _noise(key: str, *what: Column) -> Column:
    """128 hex digits: the HMAC-SHA-512 of ``what`` under ``key``."""
    secret = key.encode()
    secret = (secret if len(secret) <= 128 else hashlib.sha512(secret).digest()).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.concat_ws("|", *what).cast("binary")), 512))), 512)


def _number(noise: Column, i: Column) -> Column:
    """The i-th number below 2**16 of a noise, again from the start after the 32nd."""
    return F.conv(F.substr(noise, F.pmod(i, F.lit(32)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _one_of(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _other(c: Column, n: Column) -> Column:
    """A character of the same class."""
    out = F.when(c.between("0", "9"), F.char(F.lit(48) + n % 10)).when(c.between("a", "z"), F.char(F.lit(97) + n % 26)).when(c.between("A", "Z"), F.char(F.lit(65) + n % 26))
    for letters, used in ALPHABETS.items():
        out = out.when((c > "\x7f") & c.rlike(letters), _one_of(used, n))
    return out.otherwise(c)


def _mapped(text: Column, noise: Column) -> Column:
    return F.array_join(F.transform(_chars(text), lambda c, i: _other(c, _number(noise, i))), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    return F.aggregate(
        F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((2 * c.cast("int")) % 10 + F.floor(2 * c.cast("int") / 10).cast("int"))), F.lit(0), lambda a, x: a + x
    ) % 10


def mod_97(iban: Column) -> Column:
    """The remainder of an account number with its first four characters last and letters as 10 to 35: 1 if it is valid."""
    moved = _chars(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))))
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def valid(kind: Column, form: Column) -> Column:
    """Whether the check digits of cards and accounts are right."""
    return F.when(kind == "card", luhn(form) == 0).when(kind == "iban", mod_97(form) == 1).otherwise(F.lit(True))


def _wider(attempt: Column) -> Column:
    return F.floor(attempt / WIDER).cast("int")


def _name(word: Column, gender: Column, noise: Column, attempt: Column, syllables: int) -> Column:
    """A word of a name: syllables of its script, or else letters of its own."""

    def spell(parts: list[str], ends: dict[str, str]) -> Column:
        pick = F.transform(F.sequence(F.lit(0), F.lit(syllables - 1) + _wider(attempt)), lambda i: F.get(F.array(*map(F.lit, parts)), _number(noise, i) % len(parts)))
        return F.concat(F.array_join(pick, ""), F.when(gender == "m", ends["m"]).when(gender == "f", ends["f"]).otherwise(ends["n"]))

    letters = F.array_distinct(_chars(word))
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.length(word) + attempt), lambda i: F.get(letters, _number(noise, i) % F.size(letters))), "")
    for script, how in SYLLABLES.items():
        own = F.when(word.rlike(rf"\p{{Is{script}}}"), spell(*how)).otherwise(own)
    return own


def surrogate(kind: Column, form: Column, gender: Column, attempt: Column, noise: Column, syllables: int) -> Column:
    """The form's surrogate on an attempt."""
    mapped = _mapped(form, noise)
    more = F.substr(F.sha2(noise, 512), F.lit(1), F.least(F.lit(64), 4 * _wider(attempt)))
    letters, digits = F.translate(more, "0123456789", "ghijklmnop"), F.translate(more, "abcdef", "012345")
    octets = F.array_join(
        F.transform(F.split(form, "\\."), lambda o, i: F.when(F.length(o) == 3, 100 + _number(noise, i) % 156).when(F.length(o) == 2, 10 + _number(noise, i) % 90).otherwise(1 + _number(noise, i) % 9).cast("string")), "."
    )
    octets = F.when(attempt < WIDER, octets).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(noise, i) % 256).cast("string")), "."))
    body = F.concat(F.substr(form, F.lit(1), F.lit(1)), F.substr(mapped, F.lit(2), F.length(form) - 2))
    # the last digit that makes the sum 0 modulo 10
    card = F.concat(body, F.pmod(-luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    country, account = F.substr(form, F.lit(1), F.lit(2)), F.substr(mapped, F.lit(5))
    iban = F.concat(country, F.lpad((98 - mod_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0"), account)
    # a short address has few of its shape
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.lpad(F.hex(_number(noise, i)), 4, "0"))), ":")
    hexes = F.array_join(F.transform(_chars(form), lambda c, i: F.when(c.between("a", "f"), F.char(F.lit(97) + _number(noise, i) % 6)).otherwise(_other(c, _number(noise, i)))), "")
    # country codes from 1 and 7 have one digit, most others two
    code = F.when(form.rlike("^[17]"), 1).otherwise(2)
    top = F.regexp_extract(form, r"\.[^.]+\z", 0)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "ip6", F.when(attempt < WIDER, hexes).otherwise(whole))
        .when(kind == "card", card)
        .when(kind == "phone", F.concat(F.substr(form, F.lit(1), code), F.char(F.lit(50) + _number(noise, F.lit(1)) % 8), F.substr(mapped, code + 2), digits))
        .when(kind == "iban", iban)
        .when(kind == "key", F.concat(F.substr(form, F.lit(1), F.lit(4)), F.substr(mapped, F.lit(5))))
        .when(kind == "email", F.concat(letters, F.substr(mapped, F.lit(1), F.length(form) - F.length(top)), top))
        .when(kind == "name", _name(form, gender, noise, attempt, syllables))
        .when((kind == "secret") & form.rlike(r"^[0-9a-f]+\z"), F.concat(hexes, more))
        .when(kind == "secret", F.concat(mapped, letters))
        .otherwise(mapped)
    )


def surrogates(forms: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct (kind, form), with gender or without: no two of a kind share a surrogate and none is a form
    that occurs.

    In each turn the first form of those that share a surrogate keeps it; the others, and those whose surrogate
    occurs, make another attempt. It ends when nothing changes, as each kind has room: names have syllables for over 60 times their number; addresses with @,
    secrets, phone numbers and names become longer after ``WIDER`` attempts, and short network addresses become whole ones; keys, accounts and cards have
    10 ** 11 surrogates or more. Where a kind of fixed length has more forms than half of its ``SPACES``, there can be no such surrogates, which is an error.
    """
    forms = cut(forms.select("kind", "form", F.col("gender") if "gender" in forms.columns else F.lit("n").alias("gender")))
    counts = {r["kind"]: r["count"] for r in forms.groupBy("kind").count().collect()}
    for kind, space in SPACES.items():
        if 2 * counts.get(kind, 0) > space:
            raise ValueError(f"{counts[kind]} of the kind {kind} leave too few surrogates")
    names, syllables = counts.get("name", 0), 2
    while 24**syllables < 64 * names:
        syllables += 1

    def draw(rows: DataFrame) -> DataFrame:
        """With surrogates where there are none."""
        noisy = rows.withColumn("_noise", _noise(key, F.col("kind"), F.col("form"), F.col("attempt").cast("string")))
        new = surrogate(F.col("kind"), F.col("form"), F.col("gender"), F.col("attempt"), F.col("_noise"), syllables)
        return cut(noisy.select("kind", "form", "gender", "attempt", F.coalesce("surrogate", new).alias("surrogate")))

    drawn = draw(forms.withColumns({"attempt": F.lit(0), "surrogate": F.lit(None).cast("string")}))
    taken = forms.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("occurs"))
    while True:
        # the least attempt, then the least form, keeps what several have drawn
        shared = drawn.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "form")).alias("first")).join(taken, ["kind", "surrogate"], "left")
        bad = cut(shared.where("n > 1 or occurs").select("kind", "surrogate", F.col("first.form").alias("keeper"), "occurs"))
        if bad.isEmpty():
            return drawn.select("kind", "form", "surrogate")
        again = F.col("keeper").isNotNull() & (F.coalesce("occurs", F.lit(False)) | (F.col("form") != F.col("keeper")))
        drawn = draw(drawn.join(bad, ["kind", "surrogate"], "left").select("kind", "form", "gender", (F.col("attempt") + again.cast("int")).alias("attempt"), F.when(~again, F.col("surrogate")).alias("surrogate")))


def laid_out(entity: Column, kind: Column, form: Column, new: Column) -> Column:
    """The surrogate of a form, written as the entity was."""
    fill = lambda pattern, new: F.array_join(
        F.transform(
            _chars(entity),
            lambda c, i: F.when(c.rlike(pattern), F.substr(new, F.length(F.regexp_replace(F.substr(entity, F.lit(1), i + 1), f"[^{pattern[1:-1]}]", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )
    local = (kind == "phone") & ~entity.startswith("+")
    digits = F.when(local, F.substr(new, F.lit(2))).otherwise(new)
    cased = F.array_join(F.transform(_chars(entity), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substr(new, i + 1, F.lit(1)))).otherwise(F.substr(new, i + 1, F.lit(1)))), "")
    word = F.when((F.length(entity) > 2) & (F.upper(entity) == entity), F.upper(new)).when(F.substr(entity, F.lit(1), F.lit(1)).rlike(r"\p{Lu}"), F.concat(F.upper(F.substr(new, F.lit(1), F.lit(1))), F.substr(new, F.lit(2)))).otherwise(new)
    return (
        F.when(kind.isin(DIGITS), F.concat(fill("[0-9]", digits), F.substr(new, F.length(form) + 1)))
        .when(kind == "iban", fill("[A-Z0-9]", new))
        .when((kind == "email") & (F.length(entity) == F.length(form)), F.concat(cased, F.substr(new, F.length(form) + 1)))
        .when(kind == "secret", F.concat(F.substr(entity, F.lit(1), F.length(entity) - F.length(form)), new))
        .when(kind == "name", word)
        .otherwise(new)
    )


def replace_pii(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced, and their number in ``count_col`` (which replaces a column of that name in any case).

    Whole texts are searched, however long, and once: a text with a hint of an entity is kept with what was found. Words of
    a titled name that stand alone count one by one, in the document of the title only. Rows without an entity, with a null or an empty
    text are as they were and have 0. Repeated rows are replaced alike; an empty table gives an empty result. Surrogates
    depend on ``key``, a secret, and on which forms occur in ``docs``.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names = [c for c in docs.columns if c.lower() != count_col.lower()]
    text = F.col("d").getField(text_col).cast("string")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"))
    every = lambda pattern: F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    at = text.contains("@")
    read = cut(rows.where(hinted(text)).select("d", F.when(at, every(ANY_AT)).otherwise(every(ANY)).alias("found")).withColumn("row", F.monotonically_increasing_id()))
    unhinted = rows.where(~hinted(text)).select("d", text.alias("new"), F.lit(0).alias("n"))
    clean = read.where(F.size("found") == 0).select("d", text.alias("new"), F.lit(0).alias("n"))

    titled = F.filter("found", lambda e: e.rlike(rf"^(?:{PATTERNS['person']})\z"))
    dirty = read.where(F.size("found") > 0).withColumn("known", F.array_distinct(F.flatten(F.transform(titled, parts_of))))
    dirty = cut(dirty.withColumn("found", F.when(F.size("known") > 0, every(WITH_NAMES)).otherwise(F.col("found"))))
    spots = dirty.select("row", "known", F.posexplode("found").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    spots = spots.withColumn("form", form_of(F.col("entity"), F.col("kind"))).where(valid(F.col("kind"), F.col("form")) & ((F.col("kind") != "name") | F.array_contains("known", F.lower("entity"))))
    # each word of a name by itself, with the gender that a title tells of given names
    bare = F.regexp_replace("entity", _TITLE, "")
    words = F.zip_with(F.regexp_extract_all(bare, F.lit(f"({_PART})"), F.lit(1)), parts_of(F.col("entity")), lambda e, f: F.struct(e.alias("entity"), f.alias("form")))
    given = F.size(F.regexp_extract_all(F.regexp_replace(bare, r"[^ ]+\z", ""), F.lit(f"({_PART})"), F.lit(1)))
    parts = F.when(F.col("kind").isin(NAMES), words).otherwise(F.array(F.struct("entity", "form")))
    spots = spots.withColumns({"gender": F.when(F.col("kind") == "person", _gender(F.col("entity"))).otherwise("n"), "given": F.when(F.col("kind") == "person", given).otherwise(0), "before": F.when(F.col("kind").isin(NAMES), F.col("entity"))})
    spots = spots.select("row", "at", "before", "gender", "given", F.when(F.col("kind") == "person", "name").otherwise(F.col("kind")).alias("kind"), F.posexplode(parts).alias("part", "x"))
    spots = cut(spots.select("row", "at", "before", "kind", "part", "x.entity", "x.form", F.when(F.col("part") < F.col("given"), F.col("gender")).otherwise("n").alias("gender")))

    told = lambda g: F.max(F.col("gender") == g)
    forms = spots.groupBy("kind", "form").agg(told("m").alias("m"), told("f").alias("f"))
    drawn = surrogates(forms.select("kind", "form", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n").alias("gender")), key)
    new = spots.join(drawn, ["kind", "form"]).select("row", "at", "before", "part", laid_out(F.col("entity"), F.col("kind"), F.col("form"), F.col("surrogate")).alias("new"))
    by_spot = new.groupBy("row", "at").agg(F.first("before").alias("before"), F.transform(F.array_sort(F.collect_list(F.struct("part", "new"))), lambda x: x["new"]).alias("new"))
    title = F.regexp_extract("before", _TITLE, 0)
    between = F.split(F.regexp_replace("before", _TITLE, ""), _PART, -1)
    joined = lambda gaps, values: F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda a, b: F.concat(a, b)), ""), F.element_at(gaps, -1))
    entity = F.when(F.col("before").isNull(), F.get("new", F.lit(0))).otherwise(F.concat(title, joined(between, F.col("new"))))
    by_row = by_spot.select("row", "at", entity.alias("new")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    pieces = F.when(F.size("known") > 0, F.split(text, WITH_NAMES, -1)).when(at, F.split(text, ANY_AT, -1)).otherwise(F.split(text, ANY, -1))
    whole = joined(pieces, F.transform("found", lambda e, i: F.coalesce(F.try_element_at("new", i), e)))
    changed = dirty.join(by_row, "row", "left").select("d", F.when(F.col("new").isNull(), text).otherwise(whole).alias("new"), F.coalesce(F.size("new"), F.lit(0)).alias("n"))
    out = unhinted.union(clean).union(changed)
    return out.select(*((F.col("new") if c == text_col else F.col("d").getField(c)).alias(c) for c in names), F.col("n").alias(count_col))


def job_key(spark: SparkSession) -> str:
    """The secret of a job, from ``spark.weftline.surrogates.key``; a known one where it isn't set, as in tests."""
    return spark.conf.get("spark.weftline.surrogates.key", "surrogates-1")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), key=job_key(spark)).select("doc_id", "text", "n_entities")
