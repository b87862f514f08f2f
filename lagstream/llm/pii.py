"""Operator 1, surrogates for personal data, in DataFrame functions only.

Entities are found by linear-time patterns. Each distinct entity of the corpus gets one surrogate from a keyed
digest of itself, so mentions of one entity stay one (coreference), of the same type and shape: digits for
digits, letters of the same script and case, names by the gender of their title, addresses, cards and account
numbers with the validity of their checks. Surrogates are checked against each other and against every entity
found; those that collide are drawn again, until all are distinct.

The patterns pass over each text once: a scan writes the rows with their matches, and what follows reads those. Only
documents with entities are shuffled, and their entities, which are distinct by document first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagstream.llm.common import Stages, read_table

# fixed values: forms of address by the gender they tell
MALE_TITLES = "Mr|Monsieur|Herr|Señor|Sr|Signor|Господин"
FEMALE_TITLES = "Mrs|Ms|Miss|Mme|Mlle|Madame|Frau|Señora|Sra|Signora|Госпожа"
_TOKEN = r"\p{Lu}[\p{L}'’\-]*+"
_NAME = rf"(?<!\p{{L}})(?:{MALE_TITLES}|{FEMALE_TITLES})\.? {_TOKEN}(?: {_TOKEN}){{0,2}}"
_LABEL = r"[\p{L}\p{N}._%+\-]"
_EMAIL = rf"(?<!{_LABEL}){_LABEL}++@(?:[\p{{L}}\p{{N}}\-]++\.)+\p{{L}}{{2,}}+"
_SECRET = (r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9_\-]{20,}+|xox[abprs]-[A-Za-z0-9\-]{10,}+"
           r"|eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]++\.[A-Za-z0-9_\-]++|(?=[a-f]*+[0-9])[0-9a-f]{32,}+|(?=[A-F]*+[0-9])[0-9A-F]{32,}+)(?![A-Za-z0-9])")
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){3,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
_PHONE = (r"(?<![\w+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}(?![0-9])"
          r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[\-. ][0-9]{4}(?![0-9])|(?<![0-9\-.])[0-9]{3}[\-. ][0-9]{3}[\-. ][0-9]{4}(?![0-9\-])")
_SSN = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_CARD = r"(?<![0-9])(?:(?:[0-9]{4} ){3}[0-9]{4}|(?:[0-9]{4}-){3}[0-9]{4}|[0-9]{13,19})(?![0-9])"
#: In the order in which they are tried at a place.
PATTERNS = {"NAME": _NAME, "EMAIL": _EMAIL, "SECRET": _SECRET, "IBAN": _IBAN, "PHONE": _PHONE, "SSN": _SSN, "IP": _IP, "CARD": _CARD}
ANY = "|".join(PATTERNS.values())
#: Every entity holds one of these.
_HINT = rf"[0-9@]|(?:{MALE_TITLES}|{FEMALE_TITLES})\.? \p{{Lu}}|sk-|eyJ|xox"

# fixed values: alphabets by script, case and kind
ALPHABETS = (
    ("abcdefghijklmnopqrstuvwxyz", r"[a-z]"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"[A-Z]"), ("0123456789", r"[0-9]"),
    ("àâäáãçèéêëìíîïñòóôöõùúûüß", r"[ß-öø-ÿ]"), ("ÀÂÄÁÃÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ", r"[À-ÖØ-Þ]"),
    ("αβγδεζηθικλμνξοπρστυφχψω", r"[ά-ώ]"), ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", r"[Ά-Ϋ]"),
    ("абвгдежзийклмнопрстуфхцчшщыэюя", r"[а-џ]"), ("АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЭЮЯ", r"[Ѐ-Я]"),
    ("安白丹方高光海华建江金李林明平青山天文小新雪阳云", r"\p{IsHan}"),
)
LATIN = ("Al", "Bar", "Cor", "Dal", "El", "Fen", "Gar", "Hol", "Is", "Jor", "Kel", "Lan", "Mar", "Nor", "Or", "Pel", "Ran", "Sel", "Tor", "Wen")
LATIN_MORE = ("ba", "ca", "de", "fi", "ga", "li", "ma", "ne", "no", "pa", "ra", "ri", "sa", "so", "ta", "ti", "va", "ve", "vi", "zo")
CYRILLIC = ("Ал", "Бор", "Вал", "Гор", "Дан", "Ев", "Зин", "Ив", "Кар", "Лев", "Мир", "Ник", "Ол", "Пав", "Рад", "Сав", "Тим", "Фед", "Эм", "Яр")
CYRILLIC_MORE = ("ба", "ва", "ги", "де", "за", "ко", "ла", "ли", "ма", "ми", "на", "ни", "по", "ра", "ро", "са", "си", "та", "ти", "фи")
ENDINGS = {("L", "M"): ("n", "do", "rt", "ko", "l"), ("L", "F"): ("a", "na", "lle", "ta", "ine"), ("L", "S"): ("mann", "ford", "sen", "ley", "court"),
           ("C", "M"): ("н", "слав", "мир", "р", "й"), ("C", "F"): ("на", "ла", "я", "са", "та"), ("C", "S"): ("ко", "ых", "енко", "ук", "ич")}


def _pick(values: Sequence[str] | str, n: Column) -> Column:
    if isinstance(values, str):
        return F.substring(F.lit(values), F.pmod(n, F.lit(len(values))) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, values)), F.pmod(n, F.lit(len(values))) + 1)


def _byte(stream: Column, i: Column | int) -> Column:
    """Byte i of a digest in hex (64 bytes, then again, shifted)."""
    i = F.lit(i) if isinstance(i, int) else i
    at = F.pmod(i, F.lit(64))
    return (F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 64).cast("int") * 7).cast("int")


def _letters(value: Column, stream: Column, hexadecimal: Column) -> Column:
    """value with every letter and digit drawn anew from its own alphabet; hexadecimal keeps letters to a-f."""

    def draw(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        out = F.when(hexadecimal & c.rlike("[a-f]"), _pick("abcdef", n)).when(hexadecimal & c.rlike("[A-F]"), _pick("ABCDEF", n))
        for alphabet, kind in ALPHABETS:
            out = out.when(c.rlike(kind), _pick(alphabet, n))
        # letters and digits of no alphabet here
        return out.when(c.rlike(r"\p{Lu}"), _pick(ALPHABETS[1][0], n)).when(c.rlike(r"\p{L}"), _pick(ALPHABETS[0][0], n)).when(c.rlike(r"\p{N}"), _pick(ALPHABETS[2][0], n)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), draw), "")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string to which one check digit is still to come."""
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))), F.lit(0), lambda a, x: a + x)


def _check_digit(head: Column) -> Column:
    return F.pmod(10 - F.pmod(_luhn(head), F.lit(10)), F.lit(10))


def _card(value: Column, stream: Column) -> Column:
    digits = F.regexp_replace(value, "[ -]", "")
    n = F.length(digits)
    head = F.substring(digits, F.lit(1), n - 1)
    valid = _check_digit(head) == F.substring(digits, n, F.lit(1)).cast("int")
    new = F.concat(F.substring(digits, 1, 1), _letters(F.substring(head, F.lit(2), n - 2), stream, F.lit(False)))
    new = F.concat(new, F.pmod(_check_digit(new) + F.when(valid, 0).otherwise(1 + F.pmod(_byte(stream, 63), F.lit(9))), F.lit(10)).cast("string"))
    separator = F.regexp_extract(value, "[ -]", 0)
    return F.when(separator == " ", F.regexp_replace(new, r"([0-9]{4})(?=[0-9])", "$1 ")).when(separator == "-", F.regexp_replace(new, r"([0-9]{4})(?=[0-9])", "$1-")).otherwise(new)


def _iban(value: Column, stream: Column) -> Column:
    country, body = F.substring(value, 1, 2), _letters(F.expr("substring(value, 5)"), stream, F.lit(False))
    plain = F.concat(F.regexp_replace(body, " ", ""), country, F.lit("00"))
    rest = F.aggregate(F.split(plain, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def _digest(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts, F.lit(key)), 512)


def surrogate(key: str) -> Column:
    """Surrogate of the columns kind, value, attempt."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt").cast("string")
    stream = _digest(key, kind, value, attempt)
    plain = _letters(value, stream, F.lit(False))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    # the address of one domain stays one domain; its last label stays
    host = F.concat(_letters(F.regexp_replace(domain, r"\.[^.]*$", ""), _digest(key, F.lit("DOMAIN"), F.lower(domain)), F.lit(False)), F.regexp_extract(domain, r"\.[^.]*$", 0))
    octets = F.transform(F.split(value, r"\."), lambda o, i: F.when(i == 0, F.pmod(_byte(stream, i), F.lit(223)) + 1).otherwise(F.pmod(_byte(stream, i), F.lit(254)) + 1).cast("string"))
    prefix = F.regexp_extract(value, r"^(AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)", 1)
    rest = F.expr("substring(value, 1 + length(regexp_extract(value, '^(AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ)', 1)))")
    country = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(\-])|^\+[0-9]", 0)
    number = F.expr(r"substring(value, 1 + length(regexp_extract(value, '^\\+[0-9]{1,3}(?=[ .(\\-])|^\\+[0-9]', 0)))")
    name = None
    for script, first, more in (("C", CYRILLIC, CYRILLIC_MORE), ("L", LATIN, LATIN_MORE)):
        for gender in "MFS":
            # a syllable more for each attempt, so that the space grows with the collisions
            longer = F.when(F.col("attempt") > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest("attempt", F.lit(1))), lambda i: _pick(more, _byte(stream, i + 4))), "")).otherwise(F.lit(""))
            made = F.concat(_pick(first, _byte(stream, 0)), _pick(more, _byte(stream, 1)), F.when(_byte(stream, 2) % 2 == 0, _pick(more, _byte(stream, 3))).otherwise(F.lit("")), longer, _pick(ENDINGS[script, gender], _byte(stream, 4)))
            test = (kind == f"NAME_{gender}") & value.rlike(r"^\p{IsCyrillic}" if script == "C" else r"^[^\p{IsCyrillic}\p{IsGreek}]")
            name = F.when(test, made) if name is None else name.when(test, made)
    return (name.when(kind == "EMAIL", F.concat(_letters(local, stream, F.lit(False)), F.lit("@"), host))
            .when(kind == "SECRET", F.concat(prefix, _letters(rest, stream, value.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"))))
            .when(kind == "IBAN", _iban(value, stream)).when(kind == "IP", F.array_join(octets, "."))
            .when(kind == "PHONE", F.concat(country, _letters(number, stream, F.lit(False)))).when(kind == "CARD", _card(value, stream)).otherwise(plain))


def _kind(value: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = value.rlike(rf"^(?:{pattern})$")
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out.otherwise(F.lit("OTHER"))


def _name_parts(match: Column) -> Column:
    """Array of (kind, value) of a name match: given names by the title's gender, the last a surname."""
    tokens = F.slice(F.split(match, " "), F.lit(2), F.size(F.split(match, " ")) - 1)
    gender = F.when(match.rlike(rf"^(?:{FEMALE_TITLES})\b"), F.lit("NAME_F")).otherwise(F.lit("NAME_M"))
    return F.transform(tokens, lambda t, i: F.struct(F.when(i == F.size(tokens) - 1, F.lit("NAME_S")).otherwise(gender).alias("kind"), t.alias("value")))


def assign(entities: DataFrame, key: str, stages: Stages, most: int = 40) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): all surrogates differ from each other and from all values."""
    todo = entities.withColumn("attempt", F.lit(0))
    values = entities.select(F.col("value").alias("v")).distinct()
    done = None
    for attempt in range(most):
        drawn = stages.put(todo.withColumn("surrogate", surrogate(key)), f"drawn{attempt}")
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("f")).select(F.col("surrogate").alias("s"), "f.kind", "f.value")
        good = drawn.join(first.select("s", F.col("kind").alias("k"), F.col("value").alias("w")), (F.col("surrogate") == F.col("s")) & (F.col("kind") == F.col("k")) & (F.col("value") == F.col("w"))).select(*drawn.columns)
        good = good.join(values, F.col("surrogate") == F.col("v"), "left_anti")
        if done is not None:
            good = good.join(done.select(F.col("surrogate").alias("d")), F.col("surrogate") == F.col("d"), "left_anti")
        good = stages.put(good.select("kind", "value", "surrogate"), f"good{attempt}")
        done = good if done is None else done.unionByName(good)
        todo = drawn.join(good.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", F.lit(attempt + 1).alias("attempt"))
        todo = stages.put(todo, f"todo{attempt}")
        if todo.isEmpty():
            return done
    raise RuntimeError("surrogates still collide")


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col and pii, the count of replaced mentions. key is the caller's secret.

    All other columns stay as they are (a column named pii is replaced; names that start with _pii are
    reserved). Null texts stay null, with 0. A mention of a name's part alone takes the surrogate of the titled
    mention in the same document. Equal texts get equal results, and one entity one surrogate in all
    documents under one key. Repeated rows each return; an empty table gives no rows.
    """
    stages = Stages(docs.sparkSession, "pii")
    columns = [c for c in docs.columns if c != "pii"]
    # one digest of the id and the text names a row's content; equal rows share their entities
    text = F.col(text_col)
    matched = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    rows = stages.put(docs.select(*columns, F.xxhash64(F.col(id_col).cast("string"), text_col).alias("_pii_row"), matched.alias("_pii_matches")), "rows")
    matches = F.col("_pii_matches")
    has = F.coalesce(F.size(matches) > 0, F.lit(False))
    found = rows.where(has).select("_pii_row", F.explode(F.array_distinct(matches)).alias("match")).withColumn("kind", _kind(F.col("match")))
    parts = F.when(F.col("kind") == "NAME", _name_parts(F.col("match"))).otherwise(F.array(F.struct("kind", F.col("match").alias("value"))))
    found = stages.put(found.select("_pii_row", F.explode(parts).alias("e")).select("_pii_row", "e.kind", "e.value").distinct(), "found")
    chosen = assign(found.select("kind", "value").distinct(), key, stages)
    c = chosen.select(F.col("kind").alias("k"), F.col("value").alias("v"), "surrogate")
    named = found.join(c, (F.xxhash64(found["kind"], found["value"]) == F.xxhash64("k", "v")) & (F.col("kind") == F.col("k")) & (F.col("value") == F.col("v")))
    maps = named.groupBy(F.col("_pii_row").alias("_pii_key")).agg(  # a row's own distinct entities
        F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "value"), "surrogate"))).alias("_pii_map"),
        F.sort_array(F.collect_list(F.when(F.col("kind").startswith("NAME_") & (F.length("value") > 2), F.struct("value", "surrogate")))).alias("_pii_names"))
    maps = stages.put(maps, "maps")
    given = F.col("_pii_map")

    def instead(m: Column) -> Column:
        kind = _kind(m)
        name = F.concat_ws(" ", F.substring_index(m, " ", 1), F.array_join(F.transform(_name_parts(m), lambda p: F.element_at(given, F.concat(p["kind"], F.lit(":"), p["value"]))), " "))
        return F.when(kind == "NAME", name).otherwise(F.element_at(given, F.concat(kind, F.lit(":"), m)))

    def coreferent(piece: Column) -> Column:
        alone = lambda n: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), n["value"], F.lit(r"\E(?![\p{L}\p{N}])"))
        return F.aggregate("_pii_names", piece, lambda t, n: F.when(t.contains(n["value"]), F.regexp_replace(t, alone(n), n["surrogate"])).otherwise(t))

    pieces = F.split(text, ANY, -1)
    swapped = F.concat(F.array_join(F.zip_with(F.transform(pieces, coreferent), F.transform(matches, instead), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""))
    done = (rows.where(has).join(maps, F.col("_pii_row") == F.col("_pii_key"))
            .select(*(swapped.alias(c) if c == text_col else F.col(c) for c in columns), F.size(matches).alias("pii")))
    return stages.finish(rows.where(~has).select(*columns, F.lit(0).alias("pii")).unionByName(done))


#: The key of the registered queries, which anyone can read: who keeps data apart passes a secret of their own.
QUERY_KEY = "query"


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`: doc_id, text with surrogates, pii (mentions replaced)."""
    return pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY).withColumn("pii", F.col("pii").cast("long"))
