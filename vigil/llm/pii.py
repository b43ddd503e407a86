"""Surrogates for personal data, with DataFrame and SQL functions only.

One pattern finds the entities of a text; what stands between them is kept.
An entity has a type and a canonical form (digits of a phone number, lower
case of an e-mail address or name), so different spellings corefer.  Every
distinct (type, canonical form) gets one surrogate in the whole corpus:
characters are drawn from a keyed SHA-256 and keep their class (digit, letter,
case, script); an e-mail domain is replaced alike wherever it stands, under the
reserved name ``example`` so that no real mailbox is hit; private addresses stay private; card numbers keep the issuer digit and the state of
the check digit; IBANs get right check digits; names keep script, case and
the gender that the title or ending shows.

Surrogates are checked on the whole table of entities: of those that share a
surrogate one keeps it, and none may equal an entity of the corpus; the others
are drawn again until no collision is left.  So different entities stay
different and equal ones equal.

Entities are made distinct before they are joined, so a value that stands in
a third of all rows is one row of the table; the join of the occurrences on
the value is left to skew-join splitting.  An occurrence list holds the
entities of one text.

Defined cases: a null text stays null; texts without entities stay as they
are.  Equal rows (id and text) get equal results.  Names are found after a
title only.  Without a key of the caller's own the surrogates can be guessed
by anyone who has this module, so production runs must pass ``key``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import written

ROUNDS = 100

# Titles that show a gender.
MALE = ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа", "Κυρία"]
OTHER = ["Dr", "Prof"]

# Syllables that surrogate names are built of, by script; endings by gender.
SYLLABLES = {
    "latin": ["bel", "cor", "dan", "fen", "gar", "hol", "jor", "kel", "lin", "mar", "nor", "per", "ros", "sal", "tor", "vin"],
    "cyrillic": ["бел", "вар", "гор", "дан", "зар", "кал", "лин", "мар", "нор", "пав", "рос", "сав", "тим", "фед", "чер", "юр"],
    "greek": ["αλ", "βασ", "γερ", "δημ", "ευθ", "θεο", "ιων", "καλ", "λεω", "μιχ", "νικ", "παρ", "ροδ", "σταμ", "τριφ", "φιλ"],
}
ENDINGS = {  # given name: male, female, open; family name: male, female
    "latin": ["o", "a", "in", "er", "er"], "cyrillic": ["ан", "а", "и", "ов", "ова"], "greek": ["ος", "α", "ις", "ης", "η"],
}

TITLE = "(?:" + "|".join(MALE + FEMALE + OTHER) + r")\.?"
NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
PATTERNS = {  # the first that fits decides
    "email": r"(?<![\p{L}\p{M}\p{N}_.%+-])[\p{L}\p{M}\p{N}_.%+-]++@(?=[\p{L}\p{N}-]++\.)[\p{L}\p{N}.-]*\p{L}{2}",
    "secret": r"(?<!\w)(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)[ ]?[=:][ ]?[\"']?[^\s\"',;]{6,}+",
    "key": r"(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)(?:ghp|gho|sk|pk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
             r"|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d|[.-]\d)"
             r"|(?<![\w(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)",
    "name": rf"(?<= )(?=\p{{Lu}})(?:(?<=(?<!\p{{L}}){TITLE} )|(?<=(?<!\p{{L}}){TITLE} {NAME} )){NAME}",
}
# One look-behind for all: places inside a word fail at once.
ALL = r"(?<!\w)(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
PERSON_BEFORE = rf"(?:^|[^\p{{L}}])({TITLE}) $"


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _listed(values: list[str]) -> str:
    return "array(" + ", ".join(map(_sql, values)) + ")"


def found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(did, dkey, pos, value, type, canon) of every entity of every text."""
    matches = F.regexp_extract_all(text_col, F.lit(ALL), F.lit(0))
    with_some = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("did"),
                            F.xxhash64(F.lit(5), id_col, text_col).alias("dkey"), matches.alias("m"),
                            F.col(text_col).alias("t")).filter("size(m) > 0")
    split = with_some.select("did", "dkey", "m", F.split("t", ALL, -1).alias("gaps"))
    one = split.select("did", "dkey", F.posexplode("m").alias("pos", "value"), "gaps", "m") \
        .select("did", "dkey", "pos", "value", F.col("gaps")[F.col("pos")].alias("gap"),
                F.get("gaps", F.col("pos") + 1).alias("next_gap"), F.get("m", F.col("pos") + 1).alias("next_value"))
    kind = F.lit("name")
    for name, pattern in reversed(list(PATTERNS.items())):
        if name != "name":  # look-arounds see the value alone: its ends count as text ends
            kind = F.when(F.col("value").rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)
    title = F.regexp_replace(F.regexp_extract("gap", PERSON_BEFORE, 1), r"\.$", "")
    given = (title != "") & (F.col("next_gap") == " ") & F.col("next_value").rlike(f"^{NAME}$")
    gender = F.when(title.isin(MALE), "m").when(title.isin(FEMALE), "f").otherwise("x")
    typed = one.withColumn("type", kind).withColumn(
        "type", F.when(F.col("type") != "name", F.col("type"))
        .when(given, F.concat(F.lit("given:"), gender)).otherwise(F.lit("family")))
    digits = F.regexp_replace("value", r"[^0-9]", "")
    canon = (F.when(F.col("type").isin("phone", "ssn", "card"), digits)
             .when(F.col("type") == "iban", F.regexp_replace("value", " ", ""))
             .when(F.col("type") == "secret", F.regexp_extract("value", r"[=:][ ]?[\"']?(.*)$", 1))
             .when(F.col("type").isin("ip", "key"), F.col("value")).otherwise(F.lower("value")))
    return typed.select("did", "dkey", "pos", "value", "type", canon.alias("canon"))


def _drawn(canon: str, seed: str, hex_only: str = "false") -> str:
    """SQL: every character replaced by one of its class, from ``seed``."""
    draw = f"pmod(xxhash64({seed}, i), %s)"
    return f"""array_join(transform(split({canon}, ''), (c, i) -> CASE
        WHEN c RLIKE '[0-9]' THEN CAST({draw % 10} AS string)
        WHEN c RLIKE '[a-z]' THEN char(97 + {draw % f"IF({hex_only}, 6, 26)"})
        WHEN c RLIKE '[A-Z]' THEN char(65 + {draw % f"IF({hex_only}, 6, 26)"})
        WHEN c RLIKE '[а-я]' THEN substr('абвгдежзийклмнопрстуфхцчшщъыьэюя', CAST(1 + {draw % 32} AS int), 1)
        WHEN c RLIKE '[α-ω]' THEN substr('αβγδεζηθικλμνξοπρσςτυφχψω', CAST(1 + {draw % 25} AS int), 1)
        WHEN c RLIKE '\\\\p{{L}}' THEN char(97 + {draw % 26})
        ELSE c END), '')"""


def _luhn(digits: str) -> str:
    """SQL: Luhn sum modulo 10 of a digit string, its last digit left out."""
    return f"""aggregate(transform(split(substr({digits}, 1, length({digits}) - 1), ''), (c, i) ->
        CASE WHEN c = '' THEN 0 WHEN pmod(length({digits}) - i, 2) = 0
             THEN CAST(c AS int) * 2 - IF(CAST(c AS int) > 4, 9, 0) ELSE CAST(c AS int) END), 0, (a, x) -> a + x) % 10"""


def surrogate(attempt: int, key: str) -> Column:
    """Surrogate of the canonical form ``canon`` of a ``type``."""
    def seed(value: str, kind: str = "type", more: str = str(attempt)) -> str:
        return f"sha2(concat_ws('|', {_sql(key)}, {kind}, {value}, {more}), 256)"

    s = seed("canon")
    body = _drawn("substr(canon, 2)", s)
    hexed = "lower(canon) RLIKE '^[0-9a-f]+$'"
    area = f"CAST(2 + pmod(xxhash64({s}, 'a'), 8) AS string)"
    exchange = f"CAST(2 + pmod(xxhash64({s}, 'b'), 8) AS string)"
    code = "greatest(length(canon) - 10, 0)"  # digits of the country
    tail = _drawn(f"substr(canon, {code} + 1)", s)
    octet = f"CAST(1 + pmod(xxhash64({s}, %d), 254) AS string)"
    card = f"concat(substr(canon, 1, 1), {_drawn('substr(canon, 2, length(canon) - 2)', s)}, '0')"
    iban = f"concat(substr(canon, 1, 2), '00', {_drawn('substr(canon, 5)', s)})"
    script = "CASE WHEN canon RLIKE '\\\\p{IsCyrillic}' THEN 'cyrillic' WHEN canon RLIKE '\\\\p{IsGreek}' THEN 'greek' ELSE 'latin' END"
    syllables = "CASE {} END".format(" ".join(
        f"WHEN script = '{k}' THEN {_listed(v)}" for k, v in SYLLABLES.items()))
    endings = "CASE {} END".format(" ".join(f"WHEN script = '{k}' THEN {_listed(v)}" for k, v in ENDINGS.items()))
    # a longer name every four rounds: there is always room for another name
    name = f"""transform(array(named_struct('script', {script})), p -> concat(
        array_join(transform(sequence(1, {2 + attempt // 4}), k ->
          element_at({syllables.replace('script', 'p.script')}, CAST(1 + pmod(xxhash64({s}, k), 16) AS int))), ''),
        element_at({endings.replace('script', 'p.script')}, CASE type WHEN 'given:m' THEN 1 WHEN 'given:f' THEN 2
          WHEN 'given:x' THEN 3 ELSE IF(canon RLIKE '(ова|ева|ина|ая|ου)$', 5, 4) END)))[0]"""
    return F.expr(f"""CASE
      WHEN type = 'email' THEN concat({_drawn("substring_index(canon, '@', 1)", s)}, '@',
        {_drawn("regexp_replace(substring_index(canon, '@', -1), '[.][^.]+$', '')",
                seed("substring_index(canon, '@', -1)", "'domain'", "0"))}, '.example')
      WHEN type = 'phone' THEN concat(substr(canon, 1, {code}), {area}, substr({tail}, 2, 2), {exchange}, substr({tail}, 5))
      WHEN type = 'ssn' THEN concat(CAST(1 + pmod(xxhash64({s}, 'a'), 5) AS string), {body})
      WHEN type = 'ip' THEN concat_ws('.',
        CASE WHEN canon RLIKE '^10[.]' THEN '10' WHEN canon LIKE '192.168.%' THEN '192' WHEN canon LIKE '127.%' THEN '127'
             WHEN canon RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN '172' ELSE CAST(11 + pmod(xxhash64({s}, 1), 89) AS string) END,
        CASE WHEN canon LIKE '192.168.%' THEN '168'
             WHEN canon RLIKE '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN CAST(16 + pmod(xxhash64({s}, 2), 16) AS string)
             ELSE {octet % 2} END, {octet % 3}, {octet % 4})
      WHEN type = 'card' THEN transform(array({card}), x -> concat(substr(x, 1, length(x) - 1), CAST(pmod(
        {_luhn("canon")} + CAST(right(canon, 1) AS int) - {_luhn("x")}, 10) AS string)))[0]
      WHEN type = 'iban' THEN transform(array({iban}), x -> concat(substr(x, 1, 2), lpad(CAST(98 - aggregate(
        split(concat(substr(x, 5), substr(x, 1, 4)), ''), 0, (a, c) -> CASE WHEN c = '' THEN a
          WHEN c RLIKE '[0-9]' THEN (a * 10 + CAST(c AS int)) % 97 ELSE (a * 100 + ascii(c) - 55) % 97 END) AS string), 2, '0'),
        substr(x, 5)))[0]
      WHEN type = 'key' THEN concat(regexp_extract(canon, '^(AKIA|ASIA|[a-z]+[_-])', 1),
        {_drawn("regexp_replace(canon, '^(AKIA|ASIA|[a-z]+[_-])', '')", s)})
      WHEN type = 'secret' THEN {_drawn("canon", s, hexed)}
      ELSE {name} END""")


def mapping(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, fake): one surrogate for each distinct entity."""
    todo = written(entities.select("type", "canon").distinct(), "entities")
    # surrogates are told apart within families of types that can be confused
    family = F.when(F.col("type").startswith("given"), "name").when(F.col("type") == "family", "name").otherwise(F.col("type"))
    taken = todo.select(family.alias("kind"), F.col("canon").alias("fake")).distinct()
    done = None
    for attempt in range(ROUNDS):
        drawn = written(todo.withColumn("fake", surrogate(attempt, key)).withColumn("kind", family), "drawn")
        owner = drawn.groupBy("kind", "fake").agg(F.min(F.struct("type", "canon")).alias("o")) \
            .join(taken, ["kind", "fake"], "left_anti") \
            .select(F.col("o.type").alias("type"), F.col("o.canon").alias("canon"), "fake", "kind")
        kept = written(owner, "kept")
        done = kept if done is None else done.unionByName(kept)
        todo = drawn.join(kept, ["type", "canon"], "left_anti").select("type", "canon")
        if todo.isEmpty():
            return done.select("type", "canon", "fake")
        taken = taken.unionByName(kept.select("kind", "fake"))
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds")


def shaped() -> Column:
    """The surrogate ``fake`` in the spelling of ``value``."""
    fill = F.expr("""transform(array(sequence(1, length(value))), s -> array_join(transform(s, i -> CASE
        WHEN substr(value, i, 1) RLIKE '[0-9A-Z]'
        THEN substr(fake, length(regexp_replace(substr(value, 1, i), '[^0-9A-Z]', '')), 1)
        ELSE substr(value, i, 1) END), ''))[0]""")
    cased = F.when(F.col("value") == F.upper("value"), F.upper("fake")) \
        .when(F.col("value").rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring("fake", 1, 1)), F.expr("substr(fake, 2)"))) \
        .otherwise(F.col("fake"))
    mail = F.expr("""array_join(transform(sequence(1, length(fake)), i -> IF(substr(value, i, 1) RLIKE '[A-Z]',
        upper(substr(fake, i, 1)), substr(fake, i, 1))), '')""")
    return (F.when(F.col("type").isin("phone", "ssn", "card", "iban"), fill)
            .when(F.col("type") == "email", mail)
            .when(F.col("type") == "secret", F.concat(F.regexp_extract("value", r"^(.*?[=:][ ]?[\"']?)", 1), F.col("fake")))
            .when(F.col("type").isin("ip", "key"), F.col("fake")).otherwise(cased))


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text, and n_entities and entity_types
    (sorted, repeats included) added; columns of these names are replaced."""
    base = docs.drop("n_entities", "entity_types")
    ents = written(found(base, id_col, text_col).distinct(), "found")
    fakes = mapping(ents, key)
    lists = ents.join(fakes, ["type", "canon"]).select("did", "dkey", F.struct("pos", shaped().alias("s"), "type").alias("e")) \
        .groupBy("did", "dkey").agg(F.array_sort(F.collect_list("e")).alias("_ents")) \
        .withColumnsRenamed({"did": "_ent_did", "dkey": "_ent_dkey"})
    keyed = base.withColumns({"_row_did": F.coalesce(F.col(id_col).cast("string"), F.lit("")),
                              "_row_dkey": F.xxhash64(F.lit(5), id_col, text_col)})
    joined = keyed.join(lists, (F.col("_row_did") == F.col("_ent_did")) & (F.col("_row_dkey") == F.col("_ent_dkey")), "left")
    gaps = F.split(F.col(text_col), ALL, -1)
    clean = F.array_join(F.zip_with(gaps, F.col("_ents"), lambda g, e: F.concat(
        F.coalesce(g, F.lit("")), F.coalesce(e["s"], F.lit("")))), "")
    return joined.select(
        *[c for c in base.columns if c != text_col],
        F.when(F.col("_ents").isNull(), F.col(text_col)).otherwise(clean).alias(text_col),
        F.when(F.col("_ents").isNull(), 0).otherwise(F.size("_ents")).alias("n_entities"),
        F.coalesce(F.array_sort(F.transform("_ents", lambda e: e["type"])), F.array().cast("array<string>")).alias("entity_types")) \
        .select(*base.columns, "n_entities", "entity_types")
