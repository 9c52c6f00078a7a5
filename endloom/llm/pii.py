"""Personal data and secrets: detection and keyed surrogates (DataFrame operations only).

Entities are found by one alternation of patterns. Each distinct entity (type and
canonical form: lower-case mail address, digits of a number, ...) gets a surrogate that
depends on a secret key alone, so every mention of it in any document gets the same one,
written in the mention's own format: its separators, case, length and prefix stay, a card
number that passes the Luhn check gets one that passes, a name keeps its title, gender
and script. Distinct entities get distinct surrogates, and no surrogate is a real entity
of the corpus: both are checked over all entities, and where the check fails the entity
moves on to its next attempt until all pass.

Texts are not shuffled. Only the distinct entities are, and the few that needed a later
attempt are joined back.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

# The patterns of each type of entity, in order of precedence.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "password": r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_\-]?key)[\"']? ?[=:] ?[\"']?[A-Za-z0-9+/_\-]{6,}",
    "cloud_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "api_key": r"(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xoxb|xoxp)[_\-][A-Za-z0-9_\-]{16,}",
    "hex_secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "name": r"(?<!\p{L})(?:Mrs|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|г-н|г-жа)\.? \p{Lu}\p{L}+(?: \p{Lu}\p{L}+)?",
}
_FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа)"
_TITLE = r"^(?:Mrs|Mr|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|г-н|г-жа)\.? "
#: Texts without any of these hold no entity.
_HINT = r"[0-9@=]|[DdTtNnYy][\"']? ?:|(?:sk|pk|gh[po]|xox[bp])[_\-]|(?:M(?:rs?|s|iss|onsieur|adame|me)|Herr|Frau|S(?:eñora?|ra?)|г-(?:н|жа))\.? \p{Lu}"
# Given and family names of the surrogates, by script and gender.
NAMES = {
    "latin_f": "Ada Alma Anna Clara Diana Elena Emma Eva Flora Greta Helen Ida Irene Julia Laura Lena Lucia Maria Marta Nina Nora Olivia Paula Rosa Sara Sofia Stella Tessa Vera Viola".split(),
    "latin_m": "Adam Albert Alan Bruno Carl Daniel David Emil Erik Felix Frank George Hugo Ivan Jonas Karl Leo Lucas Marco Martin Max Nils Oscar Otto Paul Peter Robert Simon Thomas Victor".split(),
    "latin": "Bar Bel Ber Cal Cor Dal Dor Fer Gar Hal Har Kel Lan Lin Mar Mel Mon Nor Ober Pel Ran Ros Sal San Ster Tal Tor Val Ver Wal".split(),
    "cyrillic_f": "Алина Анна Вера Дарья Елена Ирина Мария Нина Ольга София".split(),
    "cyrillic_m": "Антон Борис Виктор Денис Игорь Максим Олег Павел Роман Сергей".split(),
    "cyrillic": "Бал Бар Вер Гал Гор Дан Дуб Зар Кал Кар Кор Лав Мал Мар Мор Пал Пет Рад Сав Тар".split(),
}
# What family names are made of after their first syllable.
MIDDLES = {"latin": "a ad an ar e ed el en er i il in ir o ol on or u ul um".split(), "cyrillic": "а ал ан ар е ел ен ер и ил ин ир о ол он ор у ул ум".split()}
ENDS = {"latin": "ber den dorf feld gan lan lo man mer nez ni rano rell ron sen ski son ten ton ville".split(), "cyrillic": "бай вец вич дик ко ленко мак мяк ник нюк рец рчук сюк тар чак чук шук як".split()}
#: Digits and letters of these types move into the mention's own places.
_DIRECT = ("ip", "name")
#: Exceptions up to this number are looked up in a broadcast array of so many small maps (a
#: mention reads one of them through), beyond it by a join.
MAP_ENTRIES, MAPS = 50_000, 4096
SALTS = 16
#: Attempts after which a surrogate gets one more character, of the types whose formats can
#: grow (all but these, whose formats hold over 10**8 values each).
GROW = 10
_SIZED = ("ip", "ssn", "phone", "card", "iban", "name")

PATTERN = "|".join(f"(?:{p})" for p in TYPES.values())


def _array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, also where body uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _kind(m: Column) -> Column:
    out = None
    for name, pattern in TYPES.items():
        test = m.rlike("^(?:" + pattern + ")$")
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out.otherwise(F.lit("card"))


def _value(m: Column, kind: Column) -> Column:
    """The part of a mention that is replaced."""
    return F.when(kind == "password", F.regexp_extract(m, r"([A-Za-z0-9+/_\-]{6,})$", 1)).when(kind == "name", F.regexp_replace(m, _TITLE, "")).otherwise(m)


def _canonical(m: Column, kind: Column, value: Column) -> Column:
    gender = F.when(m.rlike(_FEMALE), F.lit("f")).otherwise(F.lit("m"))
    script = F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).otherwise(F.lit("latin"))
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("ssn", "card"), F.regexp_replace(value, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(value, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "name", F.concat_ws("|", script, gender, F.lower(value)))
        .otherwise(value)
    )


def mentions(text: Column) -> Column:
    """array<struct<m, kind, value, canon>> of a text, in order."""
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    valued = F.transform(kinds, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), _value(s["m"], s["kind"]).alias("value")))
    return F.transform(valued, lambda s: F.struct(s["m"].alias("m"), s["kind"].alias("kind"), s["value"].alias("value"), _canonical(s["m"], s["kind"], s["value"]).alias("canon")))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last being the check digit."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + F.when((n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(F.element_at(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.substring(digits, i, F.lit(1)).cast("int") + 1)),
    )


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate's canonical form."""

    def r(i: Column) -> Column:
        block = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"), F.floor(i / 16).cast("string")), 256)
        return F.conv(F.substring(block, (i % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int")

    def pick(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), r(i) % len(alphabet) + 1, F.lit(1))

    at = F.instr(canon, "@")
    tld = F.length(canon) - F.length(F.substring_index(canon, ".", -1))
    country = F.when(canon.rlike(r"^\+[17]"), 2).when(canon.startswith("+"), 3).otherwise(0)
    fixed = F.when(kind == "phone", country).when(kind == "card", 1).when(kind == "cloud_key", 4).when(kind == "iban", 2).when(kind == "api_key", F.length(F.regexp_extract(canon, r"^[a-z]+[_\-]", 0))).otherwise(0)

    def char(i: Column) -> Column:  # i from 1
        c = F.substring(canon, i, F.lit(1))
        stays = (i <= fixed) | ((kind == "email") & (i > tld) & (i > at))
        return (
            F.when(stays, c)
            .when((kind == "ssn") & (i == 1), F.lit("9"))
            .when((kind == "phone") & (i == fixed + 1), pick("23456789", i))
            .when((kind == "hex_secret") | (kind == "password") & canon.rlike("^[0-9a-f]+$"), pick("0123456789abcdef", i))
            .when(c.rlike("[0-9]"), pick("0123456789", i))
            .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", i))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))
            .otherwise(c)
        )

    chars = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(canon), F.lit(1))), char), "")
    checked = _let(F.concat(F.substring(chars, F.lit(1), F.length(canon) - 1), F.lit("0")), lambda b: F.concat(F.substring(b, F.lit(1), F.length(b) - 1), ((10 - _luhn_sum(b) % 10) % 10).cast("string")))
    card = F.when(_luhn_sum(canon) % 10 == 0, checked).otherwise(chars)
    ip = F.concat_ws(".", *[(240 + r(F.lit(0)) % 16 if k == 0 else r(F.lit(k)) % 256).cast("string") for k in range(4)])

    def name_part(pool: str, i: Column) -> Column:
        cyrillic = canon.startswith("cyrillic")
        female = F.split_part(canon, F.lit("|"), F.lit(2)) == "f"

        def of(values: list[str]) -> Column:
            return F.element_at(_array(values), r(i) % len(values) + 1)

        if pool == "given":
            return F.when(cyrillic & female, of(NAMES["cyrillic_f"])).when(cyrillic, of(NAMES["cyrillic_m"])).when(female, of(NAMES["latin_f"])).otherwise(of(NAMES["latin_m"]))
        table = {"family": NAMES, "middle": MIDDLES, "end": ENDS}[pool]
        return F.when(cyrillic, of(table["cyrillic"])).otherwise(of(table["latin"]))

    two = F.instr(F.split_part(canon, F.lit("|"), F.lit(3)), " ") > 0
    # A family name has a first syllable, one middle more with each attempt, and an end, so
    # names do not run out.
    middles = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: name_part("middle", i + 3)), "")
    family = F.concat(name_part("family", F.lit(1)), middles, name_part("end", F.lit(2)))
    name = F.concat(F.when(two, F.concat(name_part("given", F.lit(0)), F.lit(" "))).otherwise(F.lit("")), family)
    more = F.when(~kind.isin(*_SIZED) & (attempt >= GROW), F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.floor(attempt / GROW).cast("int"), F.lit(1))), lambda i: pick("abcdefghijklmnopqrstuvwxyz0123456789", i + 4096)), "")).otherwise(F.lit(""))
    chars = F.concat(chars, more)
    return F.when(kind == "ip", ip).when(kind == "name", name).when(kind == "card", card).otherwise(chars)


def _rendered(s: Column, fake: Column) -> Column:
    """The mention with its value replaced, in the mention's own format."""
    value, kind = s["value"], s["kind"]

    def pour(inner: Column) -> Column:
        def place(i: Column) -> Column:
            c = F.substring(value, i, F.lit(1))
            d = F.substring(inner, F.length(F.regexp_replace(F.substring(value, F.lit(1), i), "[^A-Za-z0-9]", "")), F.lit(1))
            return F.when(c.rlike("[A-Za-z0-9]"), F.when((kind == "email") & c.rlike("[A-Z]"), F.upper(d)).otherwise(d)).otherwise(c)

        own = F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), place), "")
        return F.concat(own, F.substring(inner, F.length(F.regexp_replace(value, "[^A-Za-z0-9]", "")) + 1, F.length(inner)))

    poured = _let(F.regexp_replace(fake, "[^A-Za-z0-9]", ""), pour)
    direct = F.when((kind == "name") & (F.upper(value) == value), F.upper(fake)).otherwise(fake)
    shown = F.when(kind.isin(*_DIRECT), direct).otherwise(poured)
    return F.concat(F.substring(s["m"], F.lit(1), F.length(s["m"]) - F.length(value)), shown)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct kind, canon over all texts, with the number of mentions."""
    one = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).select(F.explode(mentions(F.col("text"))).alias("e"))
    return one.groupBy(F.col("e.kind").alias("kind"), F.col("e.canon").alias("canon")).agg(F.count(F.lit(1)).alias("n"))


def assign(found: DataFrame, key: str, rounds: int = 40) -> tuple[DataFrame, int]:
    """kind, canon, attempt with surrogates that are distinct and no real entity, and how
    many are past their first attempt. Runs a job for each round of checks. Names get longer
    with each attempt and most other types after GROW of them, so they take as many rounds
    as they need; the types of fixed size that still clash after so many rounds have run
    out of their format, which raises an error."""
    state = cut(found.select("kind", "canon", F.lit(0).alias("attempt")))
    real = state.select("kind", F.when(F.col("kind") == "name", F.concat(F.lit("name|"), F.split_part("canon", F.lit("|"), F.lit(3)))).otherwise(F.col("canon")).alias("fake_key")).distinct()
    moved = 0
    for step in count(1):
        fakes = state.withColumn("fake", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        fakes = cut(fakes.withColumn("fake_key", F.when(F.col("kind") == "name", F.concat(F.lit("name|"), F.lower("fake"))).otherwise(F.col("fake"))))
        owners = fakes.groupBy("kind", "fake_key").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n"))
        clash = owners.where("n > 1").select("kind", "fake_key", "owner").unionByName(owners.join(real, ["kind", "fake_key"], "left_semi").select("kind", "fake_key", F.lit(None).cast("string").alias("owner")))
        clash = clash.groupBy("kind", "fake_key").agg(F.max(F.col("owner").isNull()).alias("taken"), F.max("owner").alias("owner"))
        bad = cut(fakes.join(clash, ["kind", "fake_key"]).where(F.col("taken") | (F.col("canon") != F.col("owner"))).select("kind", "canon", F.lit(1).alias("step")))
        clashes, formats = bad.agg(F.count(F.lit(1)), F.count_if(F.col("kind").isin(*[k for k in _SIZED if k != "name"]))).first()
        if not clashes:
            return state, moved
        if formats and step >= rounds:
            raise ValueError("the surrogates of some type ran out")
        state = cut(state.join(bad, ["kind", "canon"], "left").select("kind", "canon", (F.col("attempt") + F.coalesce("step", F.lit(0))).alias("attempt")))
        moved = state.where("attempt > 0").count()


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", map_entries: int = MAP_ENTRIES) -> DataFrame:
    """docs with surrogates in text_col, and entities array<struct<kind, surrogate>> added
    (named ``pii_entities``; a column of that name in docs is replaced).

    One row for every input row (repeated rows get equal results), all other columns as they
    were; an empty table gives an empty frame. A null text stays null
    and has no entities, as do empty texts. Runs jobs over the distinct entities; with
    more than map_entries exceptions these are joined to the distinct texts that hold
    them, salted, else looked up in a broadcast map.
    """
    attempts, moved = assign(entities(docs, text_col), key)
    text = F.col(f"`{text_col}`").cast("string")
    free = lambda name: next(c for c in (f"{name}{'_' * k}" for k in count()) if c not in docs.columns)
    found, tried, text_key = free("__mentions"), free("__attempts"), free("__text_key")
    out = docs.withColumn(found, mentions(text))
    exceptions = attempts.where("attempt > 0")
    if not moved:
        attempt_of = lambda s, i: F.lit(0)
    elif moved <= map_entries:
        entry = F.concat_ws("|", "kind", "canon")
        maps = exceptions.groupBy(F.pmod(F.xxhash64(entry), F.lit(MAPS)).alias("id")).agg(F.map_from_entries(F.collect_list(F.struct(entry, "attempt"))).alias("m"))
        every = docs.sparkSession.range(MAPS).join(maps, "id", "left").agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("m", F.expr("map('', 0)")).alias("m")))).alias("a"))
        out = out.crossJoin(F.broadcast(every.select(F.col("a.m").alias(tried))))  # one row

        def attempt_of(s: Column, i: Column) -> Column:
            own = F.concat_ws("|", s["kind"], s["canon"])
            return F.coalesce(F.element_at(F.get(tried, F.pmod(F.xxhash64(own), F.lit(MAPS)).cast("int")), own), F.lit(0))

    else:
        out = out.withColumn(text_key, F.when(F.size(found) > 0, F.sha2(text, 256)))
        some = out.where(F.col(text_key).isNotNull())
        texts = some.groupBy(text_key).agg(F.first(found).alias("s"), F.count(F.lit(1)).alias("n_left"))
        held = texts.select(text_key, F.posexplode("s").alias("i", "e"))
        held = held.select(text_key, "i", F.col("e.kind").alias("kind"), F.col("e.canon").alias("canon"), F.pmod(F.xxhash64(text_key), F.lit(SALTS)).alias("salt"))
        salted = exceptions.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        per_text = held.join(salted, ["kind", "canon", "salt"]).groupBy(text_key).agg(F.map_from_entries(F.collect_list(F.struct("i", "attempt"))).alias(tried))
        per_text = cut(per_text.join(texts.select(text_key, "n_left"), text_key))
        # Texts without mentions are not joined, and a text that many rows share not shuffled.
        none = out.where(F.col(text_key).isNull()).withColumn(tried, F.lit(None).cast(per_text.schema[tried].dataType))
        out = spread_join(some, per_text, text_key, docs.count(), "left").unionByName(none).drop(text_key)
        attempt_of = lambda s, i: F.coalesce(F.element_at(tried, i), F.lit(0))
    shown = F.transform(F.col(found), lambda s, i: F.struct(s["kind"].alias("kind"), _let(surrogate(s["kind"], s["canon"], attempt_of(s, i), key), lambda fake: _rendered(s, fake)).alias("surrogate")))
    out = out.withColumn("pii_entities", F.coalesce(shown, F.expr("CAST(array() AS array<struct<kind:string,surrogate:string>>)")))
    gaps = F.split(text, PATTERN, -1)
    woven = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("pii_entities", i)["surrogate"], F.lit("")))), "")
    return out.withColumn(text_col, F.when(F.size("pii_entities") > 0, woven).otherwise(text)).drop(found, tried)
