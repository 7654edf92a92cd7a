"""Personal data replaced by keyed surrogates of the same kind and form.

Addresses, numbers and names are found in every text. Each entity is brought to a normal form (digits of a
number, lower case), and a keyed hash of that form makes its surrogate, so an entity has the same surrogate in every
text and spelling. Digits stay digits and keep their grouping, a card number that passes the check digit
still does, and so does an account number that passes its own; names keep script, gender, particles and capitals, mail
domains end in a reserved name, and mails of one domain share one.

Persons are found by a title or a given name of the lists below; a Chinese name by its surname and the title after it.
Every name found in a text is then replaced wherever it stands in that text as a word with a capital, so a later
mention keeps to the person. A name that no title, given name or other mention shows is not found.

Surrogates are checked across the corpus: two entities never share one and none is an entity itself. Whoever
loses such a meeting tries again with the next hash until all differ; names grow by a syllable each time.

Everything is DataFrame functions. Only entities move in the check, combined before each exchange; texts are
exchanged once, by a hash of id and text, to meet their surrogates.

Cases: a null text stays null, an empty one empty; texts without entities come back as they are; repeated rows
are replaced alike; equal surrogates after `rounds` tries get a suffix, which keeps them distinct at the cost
of form; columns of any other name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import settle
from .common import sheltered, text_of

# What is looked for, in this order at one place.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"
CARD = r"\b[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}\b"
SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|\b[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}\b|\b0[0-9]{2,4}[ /-][0-9]{6,8}\b"
MALE = "Mr Herr Monsieur Señor Sr Sir Господин".split()
FEMALE = "Mrs Ms Miss Frau Madame Mme Señora Sra Госпожа".split()
MALE_NAMES = (
    "James John Robert Michael David William Thomas Peter Hans Klaus Jürgen Pierre Jean Luis Carlos José Иван Сергей "
    "Paul George Daniel Matthew Andrew Stephen Steven Kevin Brian Richard Charles Joseph Martin Wolfgang Stefan Andreas Michel François "
    "Philippe Alain Antonio Manuel Javier Miguel Pedro Marco Giovanni Giuseppe Ahmed Mohammed Omar Александр Дмитрий Алексей Николай Владимир").split()
FEMALE_NAMES = (
    "Mary Anna Linda Susan Sarah Emma Julia Ursula Monika Marie Sophie Carmen María Lucía Анна Мария "
    "Olga Patricia Jennifer Elizabeth Barbara Jessica Karen Nancy Lisa Laura Helen Ruth Maria Elena Isabel Claire Camille Nathalie Petra "
    "Sabine Claudia Giulia Francesca Chiara Fatima Aisha Ольга Елена Наталья Татьяна Екатерина").split()
PARTICLES = "van der|van den|van|von der|von|zu|de la|del|della|de|di|da|dos|du|ter|ten|bin|ibn|al|el".split("|")
HAN_SURNAMES = "王 李 张 刘 陈 杨 赵 黄 周 吴 徐 孙 胡 朱 高 林 何 郭 马 罗 梁 宋 郑 谢 韩 唐".split()
HAN_TITLES = "先生 女士 小姐 太太".split()
# A name may hold hyphens and apostrophes, but for the one of a possessive.
_CAPITAL = r"\p{Lu}(?:[\p{L}\p{M}]|[-'’](?!s(?!\p{L}))(?=\p{L}))+"
_FAMILY = rf"(?:(?:{'|'.join(PARTICLES)}) )?{_CAPITAL}"
_TITLES = "|".join(w for t in MALE + FEMALE for w in (t, t.upper()))
_GIVEN = "|".join(w for n in MALE_NAMES + FEMALE_NAMES for w in (n, n.upper()))
NAME = rf"(?<![\p{{L}}])(?=\p{{Lu}})(?:(?:{_TITLES})\.? (?:{_CAPITAL} )?{_FAMILY}|(?:{_GIVEN})(?: {_FAMILY})?(?!\p{{L}}))"
HAN_NAME = rf"[{''.join(HAN_SURNAMES)}]\p{{IsHan}}{{0,2}}?(?={'|'.join(HAN_TITLES)})"
ENTITY = "|".join([EMAIL, IBAN, IP, CARD, SSN, PHONE, NAME, HAN_NAME])
LATIN = "ba be bi bo bu da de di do du fa fe fi fo ga ge go ha he ho ka ke ki ko la le li lo lu ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va vi".split()
HAN = "伟 芳 娜 敏 静 丽 强 磊 军 洋 勇 艳 杰 娟 涛 明 超 霞 平 刚 玲 桂 英 华 文 建 红 春 玉 兰".split()
CYRILLIC = "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ви".split()
ENDINGS = {"latin": {"m": "rik", "f": "lina", "n": "len", "surname": "mer"}, "cyrillic": {"m": "мир", "f": "лина", "n": "лен", "surname": "дов"}}


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^(?:{_TITLES})\.? ", 0)


def _names(value: Column) -> Column:
    """The words of a match without its title: given and family name, or one alone, particles with them."""
    return F.split(F.substring(value, F.length(_title(value)) + F.lit(1), F.length(value)), " ")


def _capitals(value: Column) -> Column:
    """The words of `_names` without particles."""
    return F.filter(_names(value), lambda w: ~w.rlike(r"^\p{Ll}"))


def kind_of(value: Column) -> Column:
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(value.contains("@"), "email").when(value.rlike(rf"^{IBAN}$"), "iban").when(value.rlike(rf"^{IP}$"), "ip")
        .when(value.rlike(rf"^{SSN}$"), "ssn").when(value.rlike(rf"^{CARD}$"), "card").when(digits > 0, "phone").otherwise("name"))


def _gender(value: Column) -> Column:
    words = lambda options: "^(?:" + "|".join(options) + r")\b"
    return F.when(value.rlike("(?iU)" + words(FEMALE + FEMALE_NAMES)), "f").when(value.rlike("(?iU)" + words(MALE + MALE_NAMES)), "m").otherwise("n")


def parts(value: Column) -> Column:
    """kind|normal form of everything in a match that gets a surrogate."""
    kind, names = kind_of(value), _capitals(value)
    given = F.concat(F.lit("given-"), _gender(value), F.lit("|"), F.lower(names[0]))
    surname = F.concat(F.lit("surname|"), F.lower(F.element_at(names, -1)))
    alone = (_title(value) == "") & value.rlike(rf"^(?:{_GIVEN})$")
    name = F.when(F.size(names) > 1, F.array(given, surname)).when(alone, F.array(given)).otherwise(F.array(surname))
    plain = (
        F.when(kind.isin("email", "ip"), F.lower(value)).when(kind == "iban", F.replace(value, F.lit(" "), F.lit("")))
        .otherwise(F.regexp_replace(value, "[^0-9]", "")))
    return F.when(kind == "name", name).otherwise(F.array(F.concat(kind, F.lit("|"), plain)))


def _byte(digest: Column, i) -> Column:
    return F.conv(F.substring(digest, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")


def _mapped(text: Column, digest: Column, kept) -> Column:
    """Digits for digits and letters for letters, but for the first `kept` characters."""
    pick = lambda letters, b: F.substring(F.lit(letters), F.pmod(b, F.lit(len(letters))) + 1, F.lit(1))

    def one(c, i):
        b = _byte(digest, i)
        return (F.when(i < kept, c).when(c.rlike("[0-9]"), pick("0123456789", b)).when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz", b))
                .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", b)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """Sum of the check-digit rule; a number is valid if 10 divides it."""
    def add(total, digit):
        n = digit["d"].cast("int") * F.when(digit["even"], 2).otherwise(1)
        return total + n - F.when(n > 9, 9).otherwise(0)

    turned = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.struct(d.alias("d"), (i % 2 == 1).alias("even")))
    return F.aggregate(turned, F.lit(0), add)


def _checked(old: Column, new: Column) -> Column:
    """The new number with the last digit that makes it valid, if the old one was valid."""
    body = F.expr("left(_core, length(_core) - 1)")
    last = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    return F.when(_luhn(old) % 10 == 0, F.concat(body, last)).otherwise(new)


def _mod97(text: Column) -> Column:
    """Remainder of an account number's rule, letters read as 10 to 35."""
    def add(total, c):
        return F.when(c.rlike("[0-9]"), (total * 10 + F.ascii(c) - 48) % 97).otherwise((total * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), add)


def _account(old: Column) -> Column:
    """The new account number (column _core) with the check digits that make it valid, if the old one was valid."""
    body, country = F.expr("substring(_core, 5)"), F.expr("left(_core, 2)")
    digits = F.lpad((F.lit(98) - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(F.substring(old, F.lit(5), F.length(old)), F.substring(old, 1, 4))) == 1
    return F.when(valid, F.concat(country, digits, body)).otherwise(F.col("_core"))


def _syllable(digest: Column, syllables: list[str]):
    options = F.array(*map(F.lit, syllables))
    return lambda i: F.get(options, F.pmod(_byte(digest, i), F.lit(len(syllables))))


def _name(digest: Column, kind: Column, form: Column, tries: Column) -> Column:
    out = None
    for script, syllables in (("cyrillic", CYRILLIC), ("latin", LATIN)):
        body = F.array_join(F.transform(F.sequence(F.lit(1), tries + 3), _syllable(digest, syllables)), "")
        end = F.lit(ENDINGS[script]["surname"])
        for g in "mfn":
            end = F.when(kind == f"given-{g}", ENDINGS[script][g]).otherwise(end)
        made = F.concat(body, end)
        out = made if out is None else F.when(form.rlike(r"\p{IsCyrillic}"), out).otherwise(made)
    han = F.concat(_syllable(digest, HAN_SURNAMES)(F.lit(0)), F.array_join(F.transform(F.sequence(F.lit(1), tries + 2), _syllable(digest, HAN)), ""))
    return F.when(form.rlike(r"\p{IsHan}"), han).otherwise(out)


def with_surrogates(entities: DataFrame, key: str, rounds: int) -> DataFrame:
    """`entities` (entity: kind|form, tries) with the surrogate of that try in column surrogate."""
    rows = entities.withColumn("_kind", F.substring_index("entity", "|", 1)).withColumn("_form", F.expr("substring(entity, length(_kind) + 2)"))
    rows = rows.withColumn("_digest", F.sha2(F.concat_ws("|", F.lit(key), "entity", F.col("tries").cast("string")), 256))
    kind, form, digest = F.col("_kind"), F.col("_form"), F.col("_digest")
    domain = F.substring_index(form, "@", -1)
    mail = F.concat(_mapped(F.substring_index(form, "@", 1), digest, 0), F.lit("@"),
                    _mapped(F.lit("aaaaaaaaaa"), F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 0), F.lit(".example"))
    address = F.concat_ws(".", F.lit("10"), *(_byte(digest, F.lit(i)).cast("string") for i in (1, 2, 3)))
    kept = F.when(kind == "iban", 2).when(kind.isin("card", "phone"), 1).otherwise(0)
    core = F.when(kind == "email", mail).when(kind == "ip", address).when(kind.isin("iban", "card", "ssn", "phone"), _mapped(form, digest, kept))
    rows = rows.withColumn("_core", core.otherwise(_name(digest, kind, form, F.col("tries"))))
    done = F.when(kind == "card", _checked(form, F.col("_core"))).when(kind == "iban", _account(form)).otherwise(F.col("_core"))
    done = F.when(F.col("tries") >= rounds, F.concat(done, F.lit("-"), F.substring(digest, 1, 16))).otherwise(done)
    return rows.withColumn("surrogate", done).drop("_kind", "_form", "_digest", "_core")


def surrogates(entities: DataFrame, key: str, rounds: int = 16) -> DataFrame:
    """entity, surrogate: distinct surrogates of distinct entities (kind|form), none an entity of that kind itself."""
    table = settle(entities.select("entity").distinct().withColumn("tries", F.lit(0)))
    while True:
        named = settle(with_surrogates(table, key, rounds).withColumn("class", F.regexp_replace(F.substring_index("entity", "|", 1), "-.$", "")))
        first = named.groupBy("class", "surrogate").agg(F.min(F.struct("tries", "entity")).alias("first"), F.count("*").alias("n"))
        met = named.join(first.filter("n > 1"), ["class", "surrogate"]).filter(F.col("entity") != F.col("first.entity")).select("entity")
        own = named.select(F.concat_ws("|", F.substring_index("entity", "|", 1), "surrogate").alias("as_entity"), "entity", "tries").filter(F.col("tries") < rounds)
        real = own.join(named.select(F.col("entity").alias("as_entity")), "as_entity").select("entity")
        again = settle(met.unionByName(real).distinct())
        if again.isEmpty():
            return named.select("entity", "surrogate")
        table = settle(named.select("entity", "tries").join(again.withColumn("again", F.lit(1)), "entity", "left")
                       .select("entity", (F.col("tries") + F.coalesce("again", F.lit(0))).alias("tries")))


def _filled(value: Column, core: Column, chars: str) -> Column:
    """`value` with its characters of the class `chars` replaced in turn by those of `core`."""
    def put(state, c):
        hit = c.rlike(chars)
        return F.struct((state["i"] + F.when(hit, 1).otherwise(0)).alias("i"),
                        F.concat(state["out"], F.when(hit, F.substring(core, state["i"], F.lit(1))).otherwise(c)).alias("out"))

    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    return F.aggregate(F.split(value, ""), start, put, lambda s: F.concat(s["out"], F.substring(core, s["i"], F.length(core))))


def rebuilt(value: Column, found: Column) -> Column:
    """A match in the words of its surrogates; `found` maps kind|form to surrogate."""
    kind, own, words, n = kind_of(value), parts(value), _names(value), F.size(_capitals(value))
    core = F.try_element_at(found, own[0])

    def word(w, i):
        """A family name goes before a given one of the same letters where a word stands alone."""
        known = [F.try_element_at(found, F.concat(F.lit(f"{k}|"), F.lower(w))) for k in ("surname", "given-m", "given-f", "given-n")]
        new = F.when(n == 1, F.coalesce(*known)).when(i == 0, core).otherwise(F.try_element_at(found, F.element_at(own, -1)))
        return F.when(w.rlike(r"^\p{Ll}"), w).when(w == F.upper(w), F.upper(new)).otherwise(F.initcap(new))

    name = F.concat(_title(value), F.array_join(F.transform(words, word), " "))
    mail = F.when(value == F.upper(value), F.upper(core)).otherwise(core)
    return (F.when(kind == "email", mail).when(kind == "ip", core).when(kind == "iban", _filled(value, core, "[A-Z0-9]"))
            .when(kind == "name", name).otherwise(_filled(value, core, "[0-9]")))


def _pattern(found: Column) -> Column:
    """ENTITY, and every name of a text wherever it stands in it."""
    names = F.transform(F.filter(F.map_keys(found), lambda k: k.rlike("^(?:surname|given-.)[|]")), lambda k: F.substring_index(k, "|", -1))
    # Falling order, so that a name comes before its own beginning.
    some = lambda han: F.array_join(F.sort_array(F.filter(names, lambda w: w.rlike(r"\p{IsHan}") == F.lit(han)), asc=False), "|")
    words, signs = some(False), some(True)
    return F.concat(
        F.lit(ENTITY), F.when(words != "", F.concat(F.lit(r"|(?<![\p{L}])(?=\p{Lu})(?iu:"), words, F.lit(r")(?!\p{L})"))).otherwise(""),
        F.when(signs != "", F.concat(F.lit("|"), signs)).otherwise(""))


def replaced(docs: DataFrame, key: str = "surrogate-key", name: str = "n_entities") -> DataFrame:
    """doc_id, text with surrogates, how many matches were replaced (column `name`, in place of one of docs), and the other columns of docs.

    Whoever knows `key` can work out the surrogate of a guessed entity, so it is to be kept like a password.
    """
    matches = F.regexp_extract_all(text_of(), F.lit(f"({ENTITY})"), F.lit(1))
    seen = settle(docs.select(F.xxhash64("doc_id", "text").alias("mark"), matches.alias("m")).filter(F.size("m") > 0)
                  .select("mark", F.array_distinct(F.flatten(F.transform("m", parts))).alias("entities")))
    each = seen.select("mark", F.explode("entities").alias("entity")).distinct()
    found = each.join(surrogates(each, key), "entity").groupBy("mark").agg(F.map_from_entries(F.collect_set(F.struct("entity", "surrogate"))).alias("found"))
    own = sheltered(docs, ["doc_id", "text"]).withColumn("_mark", F.xxhash64("doc_id", "text"))
    both = own.join(found.select(F.col("mark").alias("_own"), F.col("found").alias("_found")), F.col("_mark") == F.col("_own"), "left")
    both = both.withColumn("_pattern", F.when(F.col("_found").isNotNull(), _pattern(F.col("_found"))))
    both = both.withColumn("_all", F.regexp_extract_all("text", F.concat(F.lit("("), "_pattern", F.lit(")")), F.lit(1)))
    gaps, all_ = F.split("text", F.col("_pattern"), -1), F.col("_all")
    pieces = F.zip_with(gaps, all_, lambda gap, match: F.concat(gap, F.when(match.isNull(), "").otherwise(rebuilt(match, F.col("_found")))))
    has = F.col("_found").isNotNull()
    rest = [c for c in docs.columns if c not in ("doc_id", "text", name)]
    return both.select(
        "doc_id", F.when(has, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"),
        F.when(has, F.size(all_)).otherwise(0).cast("long").alias(name), *(F.col("_rest").getField(c).alias(c) for c in rest))
