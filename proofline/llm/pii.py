"""PII surrogates: every entity found gets a keyed replacement of its own type, gender, script and format.

An entity is reduced to a canonical form (digits of a number, lower-cased address, single name), and a keyed digest of that
form alone decides the surrogate, so the same entity reads the same in every text and format. Surrogates that two entities
would share, or that are some real entity, are drawn again until none is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

# Forms of address, credential names, sounds of made-up names by script
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Κα")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Κος")
NEUTRAL = ("Dr", "Prof")
SECRETS = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)"
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou", "n", "a"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "н", "а"),
          "greek": ("βγδζκλμνπρστ", "αεηιου", "ς", "α")}

TITLE = "(?:" + "|".join(FEMALE + MALE + NEUTRAL) + r")\.?"
NAME = r"(?:\p{Lu}\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:[-'’]\p{Lu}\p{Ll}+)?|\p{Lu}{2,}+(?:[-'’]\p{Lu}{2,}+)?)"
BEARER = "(?i:bearer) {1,3}"
PREFIX = rf"^(?:{SECRETS}\s*[=:]\s*[\"']?|{BEARER})"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
WORD_FORMS = "|".join([
    r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+)++",
    SECRETS + r"\s{0,3}[=:]\s{0,3}(?:\"(?=[^\"\n]*[\p{L}\p{N}])[^\"\n]{6,}+\"|'(?=[^'\n]*[\p{L}\p{N}])[^'\n]{6,}+'"
    r"|[\"']?(?=[^\s\"',;\p{L}\p{N}]*+[\p{L}\p{N}])[^\s\"',;]{6,}+)",
    BEARER + r"(?=[A-Za-z._~+/-]*+[0-9])[A-Za-z0-9._~+/-]{16,}+=*+",
    r"gh[opsu]_[A-Za-z0-9]{20,}+",
    r"(?:AKIA|ASIA)[A-Z0-9]{12,20}(?![\p{L}\p{N}])",
    r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    rf"(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])(?![\p{{L}}])",
    r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}]|-[0-9])",
    r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\p{L}\p{N}])",
    r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    rf"{TITLE} {NAME}(?: {NAME})?(?![\p{{L}}\p{{N}}])"])
ENTITY = (rf"(?<![\p{{L}}\p{{N}}_@.+-])(?:{WORD_FORMS})"
          r"|(?<![\p{L}\p{N}_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![\p{L}\p{N}])"
          r"|(?<![\p{L}\p{N}_+])\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])")
GATE = rf"[0-9@]|AKIA|ASIA|gh[opsu]_|{SECRETS}\s{{0,3}}[=:]|(?<![\p{{L}}\p{{N}}]){TITLE} \p{{Lu}}"
UNIT = "array<struct<kind:string,canon:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    n = F.length(digits)
    def one(i):
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), one), F.lit(0), lambda a, b: a + b)


def kind_of(m: Column, digits: Column) -> Column:
    """The type of a mention with the given digits; NULL for a long number that is no card number."""
    return (F.when(m.rlike(PREFIX), "secret").when(m.contains("@"), "email").when(m.rlike("^((AKIA|ASIA)[A-Z0-9]|gh[opsu]_)"), "key")
            .when(m.rlike(rf"^{TITLE} \p{{Lu}}"), "name").when(m.rlike("^[A-Z]{2}[0-9]"), "iban").when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
            .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").when(m.rlike("^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$") | m.rlike(r"^[+(]"), "phone")
            .when(F.length(digits).between(13, 19) & (F.pmod(_luhn(digits), F.lit(10)) == 0), "card"))


def _names(m: Column) -> Column:
    """The names of a mention with an address, without it."""
    return F.split(F.regexp_replace(m, rf"^{TITLE} ", ""), " ")


def _gender(m: Column, first: Column) -> Column:
    """By the address; by the name's last letter where that leaves it open."""
    return (F.when(m.rlike("^(" + "|".join(FEMALE) + r")\b"), "f").when(m.rlike("^(" + "|".join(MALE) + r")[. ]"), "m")
            .when(first.rlike("[aаα]$"), "f").otherwise("m"))


def mentions(text: Column) -> Column:
    """Everything in a text that looks like an entity, in order: ``m``, ``kind`` and its ``units`` (kind, canonical form), one
    for each name, one for anything else. Each step is a function over an array, so that no expression is written out twice."""
    found = F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    found = F.transform(found, lambda m: F.struct(m.alias("m"), _digits(m).alias("d"), _names(m).alias("names")))
    found = F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["d"].alias("d"), x["names"].alias("names"), kind_of(x["m"], x["d"]).alias("kind"),
                                                  _gender(x["m"], F.element_at(x["names"], 1)).alias("sex")))

    def units(x):
        m, kind = x["m"], x["kind"]
        parts = F.transform(x["names"], lambda n, i: F.struct(
            F.when((i == 0) & (F.size(x["names"]) > 1), F.concat(F.lit("given_"), x["sex"])).otherwise(F.lit("family")).alias("kind"), F.lower(n).alias("canon")))
        canon = (F.when(kind.isin("card", "ssn"), x["d"]).when(kind == "phone", F.right(x["d"], F.lit(10))).when(kind == "email", F.lower(m))
                 .when(kind == "secret", F.regexp_replace(m, PREFIX, "")).when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
                 .otherwise(m))
        return F.when(kind == "name", parts).when(kind.isNotNull(), F.array(F.struct(kind.alias("kind"), canon.alias("canon")))).otherwise(F.array().cast(UNIT))
    return F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), units(x).alias("units")))


def stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """128 hexadecimal digits that only the key, the unit and the attempt decide."""
    seed = F.concat_ws("\u001f", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(F.concat(F.lit("0"), seed), 256), F.sha2(F.concat(F.lit("1"), seed), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _like(text: Column, stream: Column, offset: int = 0) -> Column:
    """Digits for digits, small letters for small ones, capitals for capitals, small Latin ones for other letters and digits; anything else stays."""
    def one(c, i):
        n = _byte(stream, i + offset)
        return (F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
                .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).when(c.rlike(r"[\p{L}\p{N}]"), _pick("abcdefghijklmnopqrstuvwxyz", n)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def _made_up(stream: Column, canon: Column, kind: Column) -> Column:
    """A name of four syllables in the script of the original; a given name ends as its gender does."""
    def name(script):
        hard, soft, male, female = SOUNDS[script]
        body = F.concat(*[F.concat(_pick(hard, _byte(stream, F.lit(2 * i))), _pick(soft, _byte(stream, F.lit(2 * i + 1)))) for i in range(4)])
        return F.concat(body, F.when(kind == "given_f", _pick(hard, _byte(stream, F.lit(9)))).otherwise(""),
                        F.when(kind == "given_f", female).when(kind == "given_m", male).otherwise(""))
    return F.when(canon.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(canon.rlike(r"\p{IsGreek}"), name("greek")).otherwise(name("latin"))


def surrogate(kind: Column, canon: Column, s: Column) -> Column:
    """The canonical form of what stands for a unit with the given stream."""
    local, host = F.substring_index(canon, "@", 1), F.substring_index(F.substring_index(canon, "@", -1), ".", 1)
    email = F.concat(_like(local, s), F.lit("@"), _like(host, s, 32), F.lit(".example.org"))
    octet = [(F.pmod(_byte(s, F.lit(2 * i)) * 256 + _byte(s, F.lit(2 * i + 1)), F.lit(254)) + 1).cast("string") for i in range(4)]
    card = F.concat(F.left(canon, F.lit(1)), _like(F.substr(canon, F.lit(2), F.length(canon) - 2), s))
    check = F.pmod(10 - F.pmod(_luhn(F.concat(card, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    phone = F.when(F.length(canon) == 10, F.concat(_pick("23456789", _byte(s, F.lit(40))), _like(F.substr(canon, F.lit(2), F.length(canon)), s))).otherwise(_like(canon, s))
    hexed = F.array_join(F.transform(F.split(canon, ""), lambda c, i: F.when(c == "", c).otherwise(F.substr(s, F.pmod(i, F.lit(128)) + 1, F.lit(1)))), "")
    secret = F.when(canon.rlike("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$"), hexed).otherwise(_like(canon, s))
    return (F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *octet)).when(kind == "card", F.concat(card, check)).when(kind == "phone", phone)
            .when(kind == "ssn", _like(canon, s)).when(kind == "secret", secret).when(kind == "key", F.concat(F.left(canon, F.lit(4)), _like(F.substr(canon, F.lit(5), F.length(canon)), s)))
            .when(kind == "iban", F.concat(F.left(canon, F.lit(2)), _like(F.substr(canon, F.lit(3), F.length(canon)), s))).otherwise(_made_up(s, canon, kind)))


def _poured(m: Column, chars: Column, kept: str) -> Column:
    """The mention with its characters of the class ``kept`` replaced from the right by those of ``chars``."""
    free = F.length(F.regexp_replace(m, f"[^{kept}]", "")) - F.length(chars)
    def one(c, i):
        before = F.length(F.regexp_replace(F.substr(m, F.lit(1), i + 1), f"[^{kept}]", "")) - free
        return F.when(c.rlike(f"[{kept}]") & (before > 0), F.substr(chars, before, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(m, ""), one), "")


def replacements(found: Column, attempts: Column | None, key: str) -> Column:
    """What stands for each mention: surrogates for its units, in the mention's own format."""
    def attempt(u):
        return F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, F.concat_ws("\u001f", u["kind"], u["canon"])), F.lit(0))

    def drawn(x):
        known = F.transform(x["units"], lambda u: F.struct(u["kind"].alias("kind"), u["canon"].alias("canon"), stream(u["kind"], u["canon"], attempt(u), key).alias("s")))
        return F.transform(known, lambda u: surrogate(u["kind"], u["canon"], u["s"]))

    def shown(x):
        m, kind, one = x["m"], x["kind"], F.try_element_at(x["made"], F.lit(1))
        names = F.array_join(F.transform(x["made"], lambda n: F.concat(F.upper(F.left(n, F.lit(1))), F.substr(n, F.lit(2), F.length(n)))), " ")
        loud = F.regexp_replace(m, rf"^{TITLE} ", "").rlike(r"^[^\p{Ll}]+$")  # written in capitals
        return (F.when(kind.isNull(), m).when(kind == "name", F.concat(F.regexp_extract(m, rf"^{TITLE} ", 0), F.when(loud, F.upper(names)).otherwise(names)))
                .when(kind.isin("card", "ssn", "phone"), _poured(m, one, "0-9")).when(kind == "iban", _poured(m, one, "A-Z0-9"))
                .when(kind == "secret", F.concat(F.regexp_extract(m, PREFIX, 0), one)).otherwise(one))
    return F.transform(F.transform(found, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), drawn(x).alias("made"))), shown)


def _redrawn(units: DataFrame, key: str) -> DataFrame:
    """``kind``, ``canon``, ``attempt`` of the units whose first surrogate is shared with another unit or is a real one."""
    state = cut(units.select("kind", "canon", F.lit(0).alias("attempt")), "units")
    while True:
        drawn = state.withColumn("_s", stream(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = cut(drawn.withColumn("s", surrogate(F.col("kind"), F.col("canon"), F.col("_s"))).drop("_s"), "drawn")
        # of those that share a surrogate the one drawn the fewest times keeps it, unless it is a real form
        owner = drawn.groupBy("kind", "s").agg(F.min(F.struct("attempt", "canon"))["canon"].alias("owner"))
        real = state.select("kind", F.col("canon").alias("s"), F.lit(True).alias("real"))
        judged = drawn.join(cut(owner, "owners"), ["kind", "s"]).join(real, ["kind", "s"], "left")
        bad = F.col("real").isNotNull() | (F.col("owner") != F.col("canon"))
        judged = cut(judged.select("kind", "canon", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad")), "judged")
        state = judged.drop("bad")
        if judged.filter("bad").isEmpty():
            return state.filter("attempt > 0")


def pii_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: the id, the columns in ``keep``, the text with surrogates, and ``n_entities``.

    Found are e-mail and IPv4 addresses, phone numbers, card numbers that pass the Luhn check, US social security numbers,
    IBANs, access keys and credentials after ``password=``, ``token:`` and the like, and names after a form of address. A credential is
    all of the value up to a blank, quote, comma or semicolon, however long and with or without a digit, if it has six characters
    and one of them is a letter or digit. What is not an entity stays byte for byte; a NULL text stays NULL with no entity, an empty one empty. Ids may be NULL and rows may repeat. A
    phone number's country code, a card's first digit, an IBAN's country and a form of address stay; IBAN check digits are not
    computed. A given name ends as its gender does; a family name is the same with every given name.

    Whole texts stay where they are read unless some surrogate had to be drawn again; then the few attempts above zero are joined on
    by id and digest of the text.
    """
    rows = docs.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text_col).alias("_text"))
    rows = rows.withColumn("_found", mentions(F.coalesce("_text", F.lit(""))))
    found = rows.select("_id", "_text", F.explode("_found").alias("x"))
    held = found.select("_id", F.sha2("_text", 256).alias("_sha"), F.explode("x.units").alias("u"))
    held = cut(held.select("_id", "_sha", "u.kind", "u.canon"), "entities")
    moved = cut(_redrawn(held.select("kind", "canon").distinct(), key), "redrawn")
    attempts = None
    if not moved.isEmpty():
        named = F.struct(F.concat_ws("\u001f", "kind", "canon"), "attempt")
        some = held.join(moved, ["kind", "canon"]).groupBy(F.col("_id").alias("_mid"), F.col("_sha").alias("_msha")).agg(
            F.map_from_entries(F.collect_set(named)).alias("_attempts"))
        rows = rows.join(cut(some, "attempts"), F.col("_id").eqNullSafe(F.col("_mid")) & (F.sha2("_text", 256) == F.col("_msha")), "left")
        attempts = F.col("_attempts")
    rows = rows.withColumn("_new", replacements(F.col("_found"), attempts, key)).withColumn("_between", F.when(F.size("_found") > 0, F.split("_text", ENTITY, -1)))
    rebuilt = F.concat(F.element_at("_between", 1), F.array_join(F.zip_with(F.col("_new"), F.slice("_between", F.lit(2), F.size("_new")), lambda a, b: F.concat(a, b)), ""))
    n = F.aggregate(F.col("_found"), F.lit(0), lambda a, x: a + x["kind"].isNotNull().cast("int"))
    return rows.select(F.col("_id").alias(id_col), *[F.col(f"_keep_{c}").alias(c) for c in keep],
                       F.when(F.size("_found") > 0, rebuilt).otherwise(F.col("_text")).alias(text_col), n.cast("long").alias("n_entities"))
