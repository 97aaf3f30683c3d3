"""Personal data: keyed, type-consistent surrogates in place of detected entities.

Native: DataFrame and SQL functions only.

Detection is by one pattern per type. A surrogate keeps the entity's type,
format and character classes, and for names the gender and script:

* digits of phones, cards and similar numbers go through a keyed Feistel
  permutation of the digit string, so different numbers stay different by
  construction; separators, a country code after a plus (by the numbering plan)
  and a card's check-digit offset are kept;
* IPv4 addresses go through such a permutation of 32 bits;
* e-mail addresses, keys and tokens are rewritten letter for letter and digit for digit
  by a keyed stream; the top-level domain stays;
* a name after a form of address is rewritten word by word with syllables of
  its script: given names with an ending of their gender, the family name
  without, so "Mr. Smith", "Mr. John Smith" and "Mrs. Smith" keep sharing one;
* an IBAN keeps its country, and its check digits stay right or wrong as they were.

Names are found after a form of address only; nothing in a text tells a bare
name from other capitalised words.

The same entity always gets the same surrogate (coreference). Collisions, that
is two entities with one surrogate or a surrogate that equals a real entity, are
searched over the whole corpus and resolved by counting up an attempt number
that enters the key, until none is left (distinctness); an error if that takes
too long. The entities of names are their given and family names, so names are
distinct because their parts are, and a part has one surrogate in all names.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, let, unused

#: The setting of the session that holds the secret key, and the key where it is not set.
KEY_SETTING, KEY = "spark.tessella.pii.key", "no secret: set spark.tessella.pii.key"
#: Entities whose attempt number is carried as a literal; more are joined.
MAX_LITERAL = 5_000
#: Distinct entities whose surrogates one task computes.
PER_TASK = 100_000

# Forms of address by gender, and syllables by script.
MALE = ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος", "κ")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "г-жа", "κυρία", "κα")
NEUTRAL = ("Dr", "Prof", "Mx")
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве во га го да де до за ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то фа фе хо".split(),
    "greek": "βα βε βο γα γε δα δε δο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε σο τα τε το φα φε φο χα χε χο".split(),
}
ENDINGS = {
    "latin": {"m": ("n", "r", "s", "l"), "f": ("na", "la", "ra", "sa"), "x": ("m", "t", "k", "d")},
    "cyrillic": {"m": ("в", "н", "р", "л"), "f": ("ва", "на", "ра", "ла"), "x": ("к", "м", "т", "д")},
    "greek": {"m": ("ς", "νος", "ρος", "λος"), "f": ("να", "ρα", "λα", "σα"), "x": ("κ", "ν", "ρ", "ξ")},
}

TITLE = "(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\b\.?"
PART = r"\p{Lu}\p{L}*\p{Ll}"
NAME = r"(?<![\p{L}])" + TITLE + rf"(?: {PART}(?:[-'’]{PART})?){{1,3}}"
PATTERNS = (
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"),
    ("secret", r"(?i:(?:password|passwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_\-]{8,}|\bAKIA[A-Z0-9]{16}\b"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w.]*\d)"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}[-.]\d{3}[-.]\d{4})(?![\w-]*\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\w-]*\d)"),
    ("name", NAME),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: A text without these has no entity; cheap to test.
HINT = r"[0-9@]|(?<![\p{L}])" + TITLE + r" \p{Lu}|(?i:password|passwd|secret|token|api_?key)"
#: Country codes of the international numbering plan; none begins another.
CODES = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Types whose entities are the parts of names.
NAMED = ("given", "family")
PREFIX = r"^(?i:(?:password|passwd|secret|token|api_?key)\s{0,2}[=:]\s{0,2}[\"']?)"


def kind(e: Column) -> Column:
    """The type of an entity, by the first pattern that it matches as a whole."""
    out = F.lit("name")
    for name, p in reversed(PATTERNS[:-1]):
        out = F.when(e.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def normal(e: Column, k: Column) -> Column:
    """What mentions of one entity share: digits for numbers, lower case for addresses.

    A phone with a country code keeps its plus. Names have parts() instead."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.when(k == "phone", F.concat(F.when(e.startswith("+"), "+").otherwise(""), digits)).when(k.isin("card", "ssn"), digits).when(k == "email", F.lower(e)).when(k == "secret", F.regexp_replace(e, PREFIX, "")).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(e)


def gender(title: Column) -> Column:
    stem = F.regexp_replace(title, r"\.? $", "")
    return F.when(stem.isin(*MALE), "m").when(stem.isin(*FEMALE), "f").otherwise("x")


def title_of(e: Column) -> Column:
    return F.regexp_extract(e, "^" + TITLE + " ", 0)


def halves(name: Column) -> tuple[Column, Column]:
    """The given names, with the white space after them, and the family name of a name without its form of address."""
    family = F.substring_index(name, " ", -1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(family)), family


def parts(e: Column) -> Column:
    """(kind, norm) of a titled name's given names, marked by gender, and family name, marked x."""

    def of(title: Column) -> Column:
        given, family = halves(F.substring(e, F.length(title) + 1, F.length(e)))
        own = F.transform(F.regexp_extract_all(given, F.lit(PART), F.lit(0)), lambda p: F.struct(F.lit("given").alias("kind"), F.concat(gender(title), F.lit(":"), p).alias("norm")))
        return F.concat(own, F.transform(F.regexp_extract_all(family, F.lit(PART), F.lit(0)), lambda p: F.struct(F.lit("family").alias("kind"), F.concat(F.lit("x:"), p).alias("norm"))))

    return let(title_of(e), of)


def number(salt: Column, *parts: Column) -> Column:
    """A keyed number from 0 to 2**56."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x01", salt, *[p.cast("string") for p in parts]), 256), 1, 14), 16, 10).cast("long")


def permuted(digits: Column, salt: Column) -> Column:
    """A keyed permutation of the digit strings of one length: four Feistel rounds on two halves."""

    def power(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("long")

    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = (n - half).cast("int")
    a, b = F.coalesce(F.substring(digits, F.lit(1), half).cast("long"), F.lit(0).cast("long")), F.substring(digits, half + 1, rest).cast("long")

    def once(x: Column, i: int) -> Column:
        left = F.pmod(x["a"] + F.pmod(number(salt, F.lit(2 * i), x["b"]), power(half)), power(half))
        return let(left, lambda y: F.struct(y.alias("a"), F.pmod(x["b"] + F.pmod(number(salt, F.lit(2 * i + 1), y), power(rest)), power(rest)).alias("b")))

    pair = let(F.struct(a.alias("a"), b.alias("b")), lambda x: let(once(x, 0), lambda y: once(y, 1)))
    return let(pair, lambda x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), rest, "0")))


def poured(form: Column, digits: Column, of: str = r"\d") -> Column:
    """form with its digits (characters of class of) replaced, in order, by those of digits."""
    step = lambda s, c: F.when(c.rlike(f"^{of}$"), F.struct(F.concat(s["out"], F.substring(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])


def luhn(body: Column) -> Column:
    """The check digit of a card number's other digits."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda x, y: x + y)
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def card(digits: Column, salt: Column) -> Column:
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    off = F.pmod(F.substring(digits, -1, 1).cast("int") - luhn(body), F.lit(10))
    return let(permuted(body, salt), lambda p: F.concat(p, F.pmod(luhn(p) + off, F.lit(10)).cast("string")))


def address(e: Column, salt: Column) -> Column:
    """A keyed permutation of IPv4 addresses."""
    o = F.split(e, r"\.")

    def once(x: Column, k: int) -> Column:
        return let(x, lambda y: F.struct(y["b"].alias("a"), F.pmod(y["a"] + number(salt, F.lit(k), y["b"]), F.lit(65536)).alias("b")))

    def rounds(x: Column) -> Column:
        for k in range(4):
            x = once(x, k)
        return let(x, lambda y: F.concat_ws(".", F.floor(y["a"] / 256), y["a"] % 256, F.floor(y["b"] / 256), y["b"] % 256))

    n = lambda i: F.get(o, F.lit(i)).cast("long")
    return rounds(F.struct((n(0) * 256 + n(1)).alias("a"), (n(2) * 256 + n(3)).alias("b")))


def streamed(e: Column, salt: Column, seed: Column) -> Column:
    """e with letters and digits replaced by keyed ones of their class."""
    hexa = e.rlike("^[0-9a-f]{16,}$") & e.rlike("[0-9]") & e.rlike("[a-f]")

    def one(c: Column, i: Column) -> Column:
        r = F.pmod(F.xxhash64(salt, seed, i), F.lit(1_000_003))
        pick = lambda s: F.substring(F.lit(s), (r % len(s) + 1).cast("int"), F.lit(1))
        return F.when(hexa, pick("0123456789abcdef")).when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), one), "")


def word(norm: Column, salt: Column, attempt: Column) -> Column:
    """The surrogate of a part of a name, from its marked form: syllables of its script, and an ending of its gender if any."""

    def built(t: Column, script: str) -> Column:
        s = F.array(*[F.lit(x) for x in SYLLABLES[script]])
        pick = lambda k: F.get(s, F.pmod(F.xxhash64(salt, F.lit(k), norm), F.lit(len(SYLLABLES[script]))).cast("int"))
        end = F.lit("")
        for g, ends in ENDINGS[script].items():
            a = F.array(*[F.lit(x) for x in ends])
            end = F.when(norm.startswith(g), F.get(a, F.pmod(F.xxhash64(salt, F.lit("end"), norm), F.lit(len(ends))).cast("int"))).otherwise(end)
        # later attempts draw from longer words
        more = F.when(attempt > 3, F.concat(pick(4), pick(5))).otherwise("")
        return F.initcap(F.concat(*[pick(k) for k in range(4)], more, end))

    return let(F.substring(norm, F.lit(3), F.length(norm)), lambda t: F.when(t.rlike(r"^\p{IsCyrillic}"), built(t, "cyrillic")).when(t.rlike(r"^\p{IsGreek}"), built(t, "greek")).otherwise(built(t, "latin")))


def salted(k: Column, attempt: Column, key: str) -> Column:
    return F.concat_ws("\x01", F.lit(key), k, attempt.cast("string"))


def remainder(account: Column) -> Column:
    """An IBAN's country and account number, with 00 for the check digits, modulo 97 by its standard."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 2), F.lit("00"))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda r, c: let(value(c), lambda v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97))


def iban(account: Column, salt: Column) -> Column:
    """The surrogate of an account number without spaces; check digits as far from the right ones as before."""
    given = F.substring(account, 3, 2).cast("int")
    body = streamed(F.substring(account, F.lit(5), F.length(account)), salt, account)
    fresh = lambda b: F.concat(F.substring(account, 1, 2), F.lit("00"), b)
    check = lambda b: F.pmod(F.lit(96) - remainder(fresh(b)) + given - (98 - remainder(account)), F.lit(97)) + 2
    return let(body, lambda b: F.concat(F.substring(account, 1, 2), F.lpad(check(b).cast("string"), 2, "0"), b))


def mail(e: Column, salt: Column, attempt: Column, key: str) -> Column:
    def of(low: Column) -> Column:
        return let(F.substring_index(low, "@", -1), lambda domain: let(F.regexp_extract(domain, r"(?:\.example)?\.[a-z]+$", 0), lambda top: F.concat(
            streamed(F.substring_index(low, "@", 1), salt, low), F.lit("@"), streamed(F.substring(domain, F.lit(1), F.length(domain) - F.length(top)), F.concat(F.lit(key), F.lit("domain")), domain),
            F.when(attempt > 3, F.concat(F.lit(".m"), attempt.cast("string"))).otherwise(F.lit("")), top)))

    return let(F.lower(e), of)


def surrogate(e: Column, k: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of entity e of type k, no name; attempt is 0 unless that collided.

    It is computed from the normal form and poured into the format of e, so all
    spellings of an entity get spellings of one surrogate. What is used more
    than once is bound, so that the expression stays small."""

    def number_of(digits: Column, salt: Column) -> Column:
        code = F.when(e.startswith("+"), F.length(F.regexp_extract(digits, CODES, 0))).otherwise(0)
        rest = lambda c: let(F.substring(digits, c + 1, F.length(digits)), lambda d: permuted(d, salt))
        return F.when(k == "phone", let(code, lambda c: F.concat(F.substring(digits, F.lit(1), c), rest(c)))).when(k == "card", card(digits, salt)).otherwise(permuted(digits, salt))

    def secret(bare: Column, salt: Column) -> Column:
        aws = bare.startswith("AKIA")
        return F.concat(F.substring(e, F.lit(1), F.length(e) - F.length(bare)), F.when(aws, F.lit("AKIA")).otherwise(""), streamed(F.when(aws, F.substring(bare, F.lit(5), F.length(bare))).otherwise(bare), salt, bare))

    def of(salt: Column) -> Column:
        out = F.when(k == "email", mail(e, salt, attempt, key)).when(k == "ip", address(e, salt))
        out = out.when(k == "secret", let(F.regexp_replace(e, PREFIX, ""), lambda b: secret(b, salt)))
        out = out.when(k == "iban", let(F.replace(e, F.lit(" "), F.lit("")), lambda a: poured(e, iban(a, salt), "[A-Z0-9]")))
        return out.otherwise(let(F.regexp_replace(e, r"\D", ""), lambda d: poured(e, number_of(d, salt))))

    return let(salted(k, attempt, key), of)


def entities(text: Column) -> Column:
    """The entities of a text, in order; an empty array for null."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def units(mentions: DataFrame) -> DataFrame:
    """(kind, norm, e) of every entity in mentions (e): of names the parts, marked; of others the mention."""
    k = mentions.select("e", kind(F.col("e")).alias("kind"))
    plain = F.array(F.struct("kind", normal(F.col("e"), F.col("kind")).alias("norm")))
    k = k.select("e", F.explode(F.when(F.col("kind") == "name", parts(F.col("e"))).otherwise(plain)).alias("u"))
    return k.select("u.kind", "u.norm", F.when(F.col("u.kind").isin(*NAMED), F.col("u.norm")).otherwise(F.col("e")).alias("e"))


def attempts(found: DataFrame, key: str = KEY, max_rounds: int = 20) -> DataFrame:
    """(kind, norm, attempt) of the entities whose attempt is not 0.

    found has one row per distinct (kind, norm), e being one mention of it; all
    others get the same surrogate but for format. In each round, of the entities that share a surrogate the first keeps it and the
    others, as well as those whose surrogate is a real entity, count up.
    """
    tasks = max(found.sparkSession.sparkContext.defaultParallelism, found.count() // PER_TASK + 1)
    real = found.select(F.col("kind").alias("r_kind"), F.col("norm").alias("r_norm"))
    now = found.withColumn("attempt", F.lit(0))
    e, k, attempt = F.col("e"), F.col("kind"), F.col("attempt")
    part = let(salted(k, attempt, key), lambda s: F.concat(F.substring(e, 1, 2), word(e, s, attempt)))
    own = F.when(k.isin(*NAMED), part).otherwise(let(surrogate(e, k, attempt, key), lambda s: normal(s, k)))
    for _ in range(max_rounds):
        # few bytes, much work: dealt by hand, since small shuffles are otherwise merged into one task
        now = cut(now.repartition(tasks, "kind", "norm").withColumn("s", own))
        first = now.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = now.join(first, ["kind", "s"]).where((F.col("first.attempt") != F.col("attempt")) | (F.col("first.norm") != F.col("norm"))).select("kind", "norm")
        taken = now.join(real, (F.col("kind") == F.col("r_kind")) & (F.col("s") == F.col("r_norm"))).select("kind", "norm")
        again = cut(twice.unionByName(taken).distinct().withColumn("more", F.lit(1)))
        if again.isEmpty():
            break
        now = now.drop("s").join(again, ["kind", "norm"], "left").select("kind", "norm", "e", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
    else:
        raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")
    return now.where("attempt > 0").select("kind", "norm", "attempt")


def interleaved(gaps: Column, found: Column) -> Column:
    """The pieces between matches with new matches between them; there is one piece more than matches."""
    return F.array_join(F.flatten(F.transform(F.arrays_zip(gaps.alias("g"), found.alias("s")), lambda z: F.array(z["g"], F.coalesce(z["s"], F.lit(""))))), "")


def redact(docs: DataFrame, key: str | None = None, max_literal: int = MAX_LITERAL, count: str | None = "pii_count") -> DataFrame:
    """docs with entities of text replaced, and the number replaced in a column named count, if given.

    key is the secret of the surrogates; by default that of the session's
    setting. One row per row of docs and all its columns (one named like count
    is replaced); null and empty texts stay as they are with count 0; equal rows
    are treated alike; null ids and extra columns make no difference; an empty
    table gives an empty result.

    Nearly all entities get their surrogate inside the row. Those that collided
    are few; up to max_literal of them travel as a literal map, a checked bound;
    beyond it they are joined to the texts that mention them.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    ents, odd_at, of = (unused(docs, c) for c in ("p_ents", "p_odd", "p_of"))
    found = units(docs.where(F.col("text").rlike(HINT)).select(F.explode(entities(F.col("text"))).alias("e")))
    odd = cut(attempts(cut(found.groupBy("kind", "norm").agg(F.min("e").alias("e"))), key))
    name = F.concat_ws("\x01", "kind", "norm")
    some = odd.select(name.alias("k"), "attempt").limit(max_literal + 1).collect()
    out = docs.withColumn(ents, entities(F.col("text")))
    table = None
    if 0 < len(some) <= max_literal:
        out = out.withColumn(odd_at, F.from_json(F.lit(json.dumps({r["k"]: r["attempt"] for r in some})), "map<string,int>"))
        table = F.col(odd_at)
    elif some:
        # by content, so null ids are no hot key and equal texts share one map
        digest = F.md5(F.col("text"))
        wanted = docs.where(F.col("text").rlike(HINT)).select(digest.alias("d"), "text").dropDuplicates(["d"]).select("d", F.explode(entities(F.col("text"))).alias("e"))
        wanted = wanted.select("d", "e", kind(F.col("e")).alias("kind"))
        norms = F.when(F.col("kind") == "name", parts(F.col("e"))).otherwise(F.array(F.struct("kind", normal(F.col("e"), F.col("kind")).alias("norm"))))
        wanted = cut(wanted.select("d", F.explode(norms).alias("u")).select("d", "u.*").distinct())
        maps = cut(wanted.join(odd, ["kind", "norm"]).groupBy(F.col("d").alias(of)).agg(F.map_from_entries(F.collect_set(F.struct(name, "attempt"))).alias(odd_at)))
        out = out.join(maps, F.when(F.size(ents) > 0, digest) == F.col(of), "left")
        table = F.col(odd_at)

    def attempt(k: Column, norm: Column) -> Column:
        return F.lit(0) if table is None else F.coalesce(F.element_at(table, F.concat_ws("\x01", k, norm)), F.lit(0))

    def renamed(half: Column, k: str, mark: Column) -> Column:
        def new(p: Column) -> Column:
            return let(F.concat(mark, F.lit(":"), p), lambda n: let(attempt(F.lit(k), n), lambda a: let(salted(F.lit(k), a, key), lambda s: word(n, s, a))))

        return let(half, lambda h: interleaved(F.split(h, PART, -1), F.transform(F.regexp_extract_all(h, F.lit(PART), F.lit(0)), new)))

    def named(e: Column) -> Column:
        def of_title(title: Column) -> Column:
            return let(F.substring(e, F.length(title) + 1, F.length(e)), lambda n: F.concat(title, renamed(halves(n)[0], "given", gender(title)), renamed(halves(n)[1], "family", F.lit("x"))))

        return let(title_of(e), of_title)

    def replaced(e: Column) -> Column:
        other = lambda k: let(attempt(k, normal(e, k)), lambda a: surrogate(e, k, a, key))
        return let(kind(e), lambda k: F.when(k == "name", named(e)).otherwise(other(k)))

    new = interleaved(F.split(F.col("text"), ANY, -1), F.transform(ents, replaced))
    out = out.withColumn("text", F.when(F.size(ents) > 0, new).otherwise(F.col("text")))
    kept = [F.col(c) for c in docs.columns if c != count]
    return out.select(*kept, *([F.size(ents).cast("long").alias(count)] if count else []))


def op3_query(spark, sf_dir: str) -> DataFrame:
    return redact(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
