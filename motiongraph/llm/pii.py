"""Surrogates for personal data.

Detected entities (e-mail, phone, payment card, social security number, IPv4
address, titled name) are replaced by keyed surrogates of the same type and
format: punctuation, number of digits, letter case, title, gender, script, a
phone's country code, the fictional exchange 555 and valid card check digits carry
over. One entity has one
surrogate in the whole corpus, however it is written (coreference); given names
and surnames have theirs apart, so "Mrs. Anna Smith" and "Mrs. Smith" still share
a surname. A check over all distinct entities keeps surrogates distinct from each
other and from real entities: where two meet, all but one try again with the
next key. Names are found after a title only; there is no list of names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, read

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}"  # no repeated group: Java matches those by recursion
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})(?!\d)"
SSN = r"(?<!\d)\d{3}-\d{2}-\d{4}(?!\d)"
PHONE = r"(?<![\d+])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}[ .-]\d{1,4}(?:[ .-]\d{2,4}){2,4})(?!\d)"
#: Titles of men and women; a name follows.
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа")
NAME = rf"(?<!\p{{L}})(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
ANY = "|".join((EMAIL, IP, SSN, PHONE, CARD, NAME))
TYPES = ("email", "ip", "ssn", "phone", "card", "name")

#: Syllables that names are made of, by script.
LATIN = ("ba", "ce", "da", "el", "fi", "ga", "ha", "is", "jo", "ka", "le", "mi", "no", "or", "pe", "ri", "sa", "te", "ul", "ve")
CYRILLIC = ("ба", "ве", "га", "до", "ел", "жа", "зи", "ка", "ле", "ми", "но", "ор", "пе", "ри", "са", "те", "ул", "фи", "ха", "ши")


def _type(hit: Column) -> Column:
    return (
        F.when(F.contains(hit, F.lit("@")), "email")
        .when(F.regexp_like(hit, F.lit(r"^\d+\.\d+\.\d+\.\d+$")), "ip")
        .when(F.regexp_like(hit, F.lit(r"^\d{3}-\d{2}-\d{4}$")), "ssn")
        .when(F.regexp_like(hit, F.lit(r"^\p{L}")), "name")
        .when(F.length(F.regexp_replace(hit, r"\D", "")) >= 13, "card")
        .otherwise("phone")
    )


def _title(hit: Column) -> Column:
    return F.regexp_extract(hit, r"^([^ ]+) ", 1)


def _keys(kind: Column, hit: Column) -> Column:
    """Array of (kind, canon): what two spellings of one entity share; a name has its parts, given names with gender."""
    digits = F.regexp_replace(hit, r"\D", "")
    gender = F.when(F.regexp_replace(_title(hit), r"\.", "").isin(*FEMALE), "f ").otherwise("m ")
    name = F.lower(F.regexp_replace(hit, r"^[^ ]+ ", ""))
    pair = lambda k, c: F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), c.alias("canon"))
    surname = pair("surname", F.substring_index(name, " ", -1))
    plain = F.when(kind == "email", F.lower(hit)).when(kind == "ip", hit).when(kind == "phone", F.right(digits, F.lit(10))).otherwise(digits)
    return (
        F.when(kind != "name", F.array(pair(kind, plain)))
        .when(F.contains(name, F.lit(" ")), F.array(surname, pair("given", F.concat(gender, F.substring_index(name, " ", 1)))))
        .otherwise(F.array(surname))
    )


def _byte(h: Column, i: Column | int) -> Column:
    """Byte i (modulo 32) of a hex SHA-256."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(32)) * 2 + 1
    return F.conv(F.substring(h, at, 2), 16, 10).cast("int")


def _digits(h: Column, n: Column, first: int = 0) -> Column:
    """n digits from the hash."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (_byte(h, i + (first - 1)) % 10).cast("string")), "")


def _word(h: Column, first: int, more: Column, female: Column, cyrillic: Column, given: bool) -> Column:
    """A name of two syllables and ``more``; given names of women end in a vowel."""
    table = F.when(cyrillic, F.array(*map(F.lit, CYRILLIC))).otherwise(F.array(*map(F.lit, LATIN)))
    stem = F.array_join(F.transform(F.sequence(F.lit(0), 1 + more), lambda i: F.element_at(table, _byte(h, i + first) % 20 + 1)), "")
    if not given:
        return F.concat(stem, F.when(cyrillic, F.when(female, "ова").otherwise("ов")).otherwise("n"))
    return F.concat(stem, F.when(cyrillic, F.when(female, "на").otherwise("н")).otherwise(F.when(female, "na").otherwise("n")))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of a canonical entity; every attempt is another draw."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    spelled = F.array_join(
        F.transform(
            F.split(local, ""),
            lambda c, i: F.when(F.regexp_like(c, F.lit("[a-z]")), F.substring(F.lit(letters), _byte(h, i) % 26 + 1, 1)).when(F.regexp_like(c, F.lit("[0-9]")), (_byte(h, i) % 10).cast("string")).otherwise(c),
        ),
        "",
    )
    # what the local part cannot tell apart, the domain does
    host = F.concat(F.translate(F.substring(h, 41, 12), "0123456789", "ghijklmnop"), F.lit(".example."), F.substring_index(domain, ".", -1))
    n = F.length(canon)
    body = F.concat(F.substring(canon, 1, 1), _digits(h, n - 2))
    checked = F.filter(F.array(*[F.lit(str(d)) for d in range(10)]), lambda d: F.call_function("luhn_check", F.concat(body, d)))
    card = F.concat(body, F.when(F.call_function("luhn_check", canon), F.element_at(checked, 1)).otherwise((_byte(h, 31) % 10).cast("string")))
    cyrillic = F.regexp_like(canon, F.lit(r"\p{IsCyrillic}"))
    surname = _word(h, 0, attempt + 1, F.regexp_like(canon, F.lit("[ая]$")), cyrillic, False)
    area = F.concat((_byte(h, 20) % 8 + 2).cast("string"), _digits(h, F.lit(2)))
    given = F.concat(F.substring(canon, 1, 2), _word(h, 10, attempt, F.startswith(canon, F.lit("f ")), cyrillic, True))
    return (
        F.when(kind == "email", F.concat(spelled, F.lit("@"), host))
        .when(kind == "ip", F.concat_ws(".", _byte(h, 0) % 223 + 1, _byte(h, 1), _byte(h, 2), _byte(h, 3)))
        .when(kind == "ssn", F.concat(F.lit("9"), _digits(h, F.lit(8))))
        .when(kind == "phone", F.when(F.regexp_like(canon, F.lit(r"^\d{3}555\d{4}$")), F.concat(area, F.lit("555"), _digits(h, F.lit(4), 2))).otherwise(F.concat(area, _digits(h, n - 3, 2))))
        .when(kind == "surname", surname)
        .when(kind == "given", given)
        .otherwise(card)
    )


def _styled(kind: Column, hit: Column, canon: Column, sur: Column, given: Column) -> Column:
    """The surrogate in the spelling of the entity; ``given`` is that of a given name, else null."""
    extra = F.length(F.regexp_replace(hit, r"\D", "")) - F.length(canon)
    filled = F.aggregate(
        F.split(hit, ""),
        F.struct(F.lit(0).alias("k"), F.lit("").alias("out")),
        lambda acc, c: F.when(F.regexp_like(c, F.lit("[0-9]")), F.struct((acc["k"] + 1).alias("k"), F.concat(acc["out"], F.when(acc["k"] < extra, c).otherwise(F.substring(sur, acc["k"] - extra + 1, F.lit(1)))).alias("out"))).otherwise(
            F.struct(acc["k"].alias("k"), F.concat(acc["out"], c).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    upper = hit == F.upper(hit)
    return (
        F.when(kind.isin("email", "ip"), F.when(upper, F.upper(sur)).otherwise(sur))
        .when(kind == "name", F.concat_ws(" ", _title(hit), F.initcap(F.substring(given, 3, 1 << 20)), F.initcap(sur)))
        .otherwise(filled)
    )


def entities(text: Column) -> Column:
    """Array of (kind, hit, keys) in text order; empty for null."""
    hits = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0)), lambda hit: F.struct(_type(hit).alias("kind"), hit.alias("hit")))
    return F.transform(hits, lambda e: F.struct(e["kind"].alias("kind"), e["hit"].alias("hit"), _keys(e["kind"], e["hit"]).alias("keys")))


def assign(found: DataFrame, key: str, most_rounds: int = 20) -> DataFrame:
    """(kind, canon, attempt) for distinct (kind, canon): surrogates are distinct and no real entity."""
    left = cut(found.select("kind", "canon", F.lit(0).alias("attempt")), "pii-entities")
    real = left.select("kind", F.col("canon").alias("sur"))
    done = None
    for _ in range(most_rounds):
        tried = cut(left.withColumn("sur", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "pii-tried")
        free = tried.join(real, ["kind", "sur"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "sur"), ["kind", "sur"], "left_anti")
        won = cut(free.groupBy("kind", "sur").agg(F.min(F.struct("canon", "attempt")).alias("w")).select("kind", "sur", "w.canon", "w.attempt"), "pii-assigned")
        done = won if done is None else done.union(won)
        left = cut(tried.join(won, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")), "pii-left")
        if left.isEmpty():
            return done.select("kind", "canon", "attempt")
    raise RuntimeError("surrogates did not settle")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, entities (kind, hit), text with surrogates.

    The same key gives the same surrogates on every run over the same corpus. A
    null text stays null and an empty one empty; ids may be null or repeat, and
    repeated rows get equal texts; an empty table gives an empty result. Other
    columns are not read. Texts are scanned once, by patterns that neither
    recurse nor look back over more than one run of characters, so very long
    ones take time in proportion; those with entities are split once more.
    """
    found = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    found = cut(found.withColumn("e", entities(F.col("text"))), "pii-found")
    some = found.filter(F.size("e") > 0)
    each = some.select("rid", F.explode(F.flatten(F.transform("e", lambda e: e["keys"]))).alias("k")).select("rid", "k.kind", "k.canon").distinct()
    again = cut(assign(each.select("kind", "canon").distinct(), key).filter("attempt > 0"), "pii-again")
    # texts with entities whose first surrogate was taken bring the attempt along
    other = each.join(again, ["kind", "canon"]).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("attempts"))

    def drawn(k: Column) -> Column:
        return surrogate(k["kind"], k["canon"], F.coalesce(F.element_at(F.col("attempts"), F.concat_ws("|", k["kind"], k["canon"])), F.lit(0)), key)

    new = F.transform("e", lambda e: _styled(e["kind"], e["hit"], e["keys"][0]["canon"], drawn(e["keys"][0]), F.when(F.size(e["keys"]) > 1, drawn(F.element_at(e["keys"], -1)))))
    parts = F.arrays_zip(F.split("text", ANY, -1).alias("gap"), new.alias("new"))
    text = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], F.coalesce(p["new"], F.lit("")))), "")
    hits = F.transform("e", lambda e: F.struct(e["kind"].alias("kind"), e["hit"].alias("hit"))).alias("entities")
    changed = some.join(other, "rid", "left").select("doc_id", hits, text.alias("text"))
    return changed.unionByName(found.filter(F.size("e") == 0).select("doc_id", hits, "text"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replace_pii(read(spark, sf_dir, "documents"), key="corpus key 1")
    return out.select("doc_id", *map(_count, TYPES), "text")


def _count(kind: str) -> Column:
    return F.size(F.filter("entities", lambda e: e["kind"] == kind)).cast("long").alias(f"n_{kind}")
