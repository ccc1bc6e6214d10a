"""Surrogates for personal data and credentials, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.ordered import rank_rows
from tidewright.session import checkpoint

_LABEL = r"(?:password|passwd|pwd|passphrase|secret|token|api[_\-]?key|access[_\-]?key)"
_MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "г-н")
_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Señorita", "Madame", "Mme", "Mademoiselle", "Mlle", "госпожа", "г-жа")
_NEUTRAL = ("Dr", "Prof")
_TITLE = "(?:" + "|".join(sorted((*_MALE, *_FEMALE, *_NEUTRAL), key=len, reverse=True)) + r")\.?"
_LINK = r"(?:van|von|vom|zu|zum|zur|de|der|den|del|della|di|da|do|dos|das|du|des|la|le|las|los|ten|ter|bin|ibn|al|el|af|av) "
# A part of a name: inner capitals and apostrophes belong to it, the possessive 's does not; a hyphen stands between parts.
_PART = r"\p{Lu}[\p{L}\p{M}]*+(?:['’](?!s(?![\p{L}\p{M}]))\p{L}[\p{L}\p{M}]*+)*+"
_PARTS = rf"(?<![\p{{L}}\p{{M}}\p{{N}}_'’]){_PART}|(?<=\p{{L}}-)\p{{L}}[\p{{L}}\p{{M}}]*+"
_WORD = rf"(?=\p{{Lu}}['’]?[\p{{L}}\p{{M}}]){_PART}(?:-(?:{_PART}|\p{{L}}[\p{{L}}\p{{M}}]*+))*+"
_NAME = rf"(?:{_LINK}|\p{{Lu}}\. ?){{0,6}}{_WORD}"
# A secret that is one sign again and again, such as ********, is masked already: nothing is there to hide.
_UNMASKED = r"(?!(?<mask>[^\p{L}\p{N}\s\"'])\k<mask>{3,}+[.,;:)\]}>]{0,2}+(?:[\s\"']|\z))"
# Alternatives are tried in this order at each place. Each begins with a look at one character, which fails at once inside ordinary
# words; only e-mail addresses can begin with any letter.
PATTERNS = {
    "secret": rf"(?=[pPsStTaA])(?<![\p{{L}}\p{{N}}_])(?i:{_LABEL})\s{{0,3}}[=:]\s{{0,3}}[\"']?{_UNMASKED}[^\s\"']{{6,}}+",
    "email": r"(?=[^\s])(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,8}\.\p{L}{2,24}",
    "key": r"(?=A)(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z])(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?=[0-9])(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{L}\p{N}]|\.[0-9])",
    "ssn": r"(?=[0-9])(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?=[0-9+(])(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}"
             r"|\([0-9]{3}\) ?[0-9]{3}[ .\-]?[0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?![\p{L}\p{N}])",
    "card": r"(?=[0-9])(?<![\p{L}\p{N}.\-])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}]|[.\-][0-9])",
    "name": rf"(?=[MHFSDPг])(?<!\p{{L}}){_TITLE} {_NAME}(?: {_NAME}){{0,8}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Letters are replaced by letters of their own alphabet.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "àâäçèéêëîïñôöùûüáíóúß", "ÀÂÄÇÈÉÊËÎÏÑÔÖÙÛÜÁÍÓÚ")
_LATIN = ("ba", "be", "do", "fa", "ga", "he", "jo", "ka", "le", "lo", "ma", "mi", "na", "ne", "pa", "re", "ro", "sa", "si", "ta", "to", "va", "vi", "wa")
_CYRILLIC = ("ба", "ве", "го", "да", "же", "за", "ки", "ла", "ле", "ма", "ми", "на", "но", "па", "ре", "ро", "са", "си", "та", "то", "ва", "ви", "ха", "че")
_HAN, _KANA = "的一是不了人我在有他这中大来上国个到说们为子和你地出道也时年得就那要下以生会自着去之过家学对可她里后", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"
_HANGUL, _ARABIC = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노도로모보소오조초코토포호", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
# What is in none of them, by script; letters of further scripts become Latin ones, further digits ASCII ones.
FURTHER = (
    (r"\p{N}", ALPHABETS[0]), (r"(?=\p{IsLatin})\p{Lu}", ALPHABETS[8]), (r"\p{IsLatin}", ALPHABETS[7]), (r"(?=\p{IsCyrillic})\p{Lu}", ALPHABETS[4]), (r"\p{IsCyrillic}", ALPHABETS[3]),
    (r"(?=\p{IsGreek})\p{Lu}", ALPHABETS[6]), (r"\p{IsGreek}", ALPHABETS[5]), (r"\p{IsHan}", _HAN), (r"\p{IsHiragana}", _KANA), (r"\p{IsKatakana}", "".join(chr(ord(c) + 96) for c in _KANA)),
    (r"\p{IsHangul}", _HANGUL), (r"\p{IsArabic}", _ARABIC), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{IsDevanagari}", "अआइउएकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
    (r"\p{IsThai}", "กขคงจฉชซญดตถทธนบปผพฟภมยรลวสหอ"), (r"\p{IsGeorgian}", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"), (r"\p{IsArmenian}", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆ"), (r"\p{L}", ALPHABETS[1]),
)
SIGNS = "!#$%&*+-/=?@^_~|"
DRAWS = 16  # rounds before what is still open is enumerated
COUNTED = ("secret", "email", "phone", "ssn")  # the kinds whose formats can be small; others draw from more than 10^9 surrogates, names from ever longer ones


def found_entities(text: Column) -> Column:
    """All entities of a text in order. What every entity needs one of (a digit, an at sign, a label's sign, a key's prefix, a title) is looked for first."""
    may = text.rlike("[0-9]") | text.contains("@") | text.contains("=") | text.contains(":") | text.contains("AKIA") | text.contains("ASIA") | text.rlike(rf"(?=[MHFSDPг]){_TITLE} (?:{_LINK})*+\p{{Lu}}")
    return F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(F.get(stream, (i / 16).cast("int")), (i % 16 * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Keyed pseudo-random hexadecimal texts, one for 16 characters of the value; each hashes a digest of it, so long values cost linear time."""
    blocks = F.sequence(F.lit(0), F.greatest(F.length(value) / 16, F.lit(1)).cast("int"))
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), value).cast("binary"), 256)
    return F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", seed, b.cast("string")).cast("binary"), 256))


def _pick(alphabet: str, r: Column) -> Column:
    return F.substring(F.lit(alphabet), (r % len(alphabet) + 1).cast("int"), F.lit(1))


def _same_class(c: Column, r: Column) -> Column:
    return F.coalesce(_by_class(c, lambda alphabet: _pick(alphabet, r)), c)


def _by_class(c: Column, result) -> Column:
    """``result`` of the alphabet of a letter or digit, null for other signs."""
    own = [F.when(F.instr(F.lit(alphabet), c) > 0, result(alphabet)) for alphabet in ALPHABETS]
    return F.coalesce(*own, F.when(c.rlike(r"[\p{L}\p{N}]"), F.coalesce(*(F.when(c.rlike(script), result(alphabet)) for script, alphabet in FURTHER))))


def _each(value: Column, change) -> Column:
    return F.array_join(F.transform(F.split(value, ""), change), "")


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's check over a text of digits, modulo 10."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def _surrogate(kind: Column, value: Column, stream: Column, attempt: Column) -> Column:
    """A value of the same type, format and script; see :func:`replace_entities`."""
    plain = _each(value, lambda c, i: _same_class(c, _byte(stream, i)))
    signs = _each(value, lambda c, i: _pick(SIGNS, _byte(stream, i)))
    tail = F.length(value) - F.length(F.substring_index(value, ".", -1))
    mail = _each(value, lambda c, i: F.when(i >= tail, c).otherwise(_same_class(c, _byte(stream, i))))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i) % F.when(i == 0, 115).otherwise(254) + F.when(i == 0, 11).otherwise(1)).cast("string")), ".")
    digits = _each(value, lambda c, i: F.when(i == 0, c).otherwise(_pick("0123456789", _byte(stream, i))))
    payload = F.substring(digits, F.lit(1), F.length(value) - 1)
    check = (10 - _luhn(F.concat(payload, F.lit("0")))) % 10
    last = F.when(_luhn(value) == 0, check).otherwise((check + 1 + _byte(stream, F.length(value)) % 9) % 10)
    card = F.concat(payload, last.cast("string"))
    key = _each(value, lambda c, i: F.when(i < 4, c).otherwise(_pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", _byte(stream, i))))
    iban = _each(value, lambda c, i: F.when(i < 2, c).otherwise(_same_class(c, _byte(stream, i))))
    hexa = _each(value, lambda c, i: _pick("0123456789abcdef", _byte(stream, i)))
    syllables = F.sequence(F.lit(0), F.lit(1) + (attempt / 8).cast("int"))

    def spoken(parts: tuple[str, ...], female: str, male: tuple[str, ...]) -> Column:
        stem = F.array_join(F.transform(syllables, lambda i: F.element_at(F.lit(list(parts)), (_byte(stream, i) % len(parts) + 1).cast("int"))), "")
        end = F.element_at(F.lit(list(male)), (_byte(stream, F.lit(30)) % len(male) + 1).cast("int"))
        return F.initcap(F.concat(stem, F.when(kind == "given_f", F.lit(female)).otherwise(end)))

    name = F.when(value.rlike(r"^\p{IsCyrillic}"), spoken(_CYRILLIC, "на", ("нов", "рин", "лев", "ков"))).otherwise(spoken(_LATIN, "na", ("ler", "son", "rick", "man")))
    return (
        F.when(kind == "email", mail).when(kind == "ip", octets).when(kind == "card", card).when(kind == "phone", digits).when(kind == "key", key)
        .when(kind == "iban", iban).when(kind.startswith("given") | (kind == "surname"), name)
        .when((kind == "secret") & value.rlike("^[0-9a-f]+$"), hexa)
        .when((kind == "secret") & ~value.rlike(r"[\p{L}\p{N}]"), signs).otherwise(plain)
    )


def _layout(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the occurrence: its separators, its case. What a surrogate is longer stands at its end, in e-mail addresses in front."""
    def rest(dropped: str) -> Column:
        return F.substring(surrogate, F.length(F.regexp_replace(raw, dropped, "")) + 1, F.length(surrogate))

    digits = _each(raw, lambda c, i: F.when(c.between("0", "9"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), (i + 1).cast("int")), r"[^0-9]", "")), F.lit(1))).otherwise(c))
    packed = _each(raw, lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.regexp_replace(F.substring(raw, F.lit(1), (i + 1).cast("int")), " ", "")), F.lit(1))))
    cased = _cased(raw, surrogate, F.length(surrogate) - F.length(raw))
    return F.when(kind.isin("phone", "card", "ssn"), F.concat(digits, rest("[^0-9]"))).when(kind == "iban", packed).when(kind == "email", cased).otherwise(surrogate)


def _cased(raw: Column, surrogate: Column, ahead: Column) -> Column:
    """Capitals where ``raw`` has them; the first ``ahead`` letters go with its first."""
    def model(i: Column) -> Column:
        return F.substring(raw, (F.greatest(i - ahead, F.lit(0)) + 1).cast("int"), F.lit(1))

    return _each(surrogate, lambda c, i: F.when((model(i) != F.lower(model(i))) & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c))


def _tokens(match: Column, at: Column) -> Column:
    """The parts of one match that need a surrogate: (pos, sub, before, kind, raw, value)."""
    def token(sub: int, before: Column, kind: Column, raw: Column, value: Column) -> Column:
        return F.struct(at.cast("int").alias("pos"), F.lit(sub).alias("sub"), before.alias("before"), kind.alias("kind"), raw.alias("raw"), value.alias("value"))

    label = rf"^(?i:{_LABEL})\s{{0,3}}[=:]\s{{0,3}}[\"']?"
    secret, none = match.rlike(label), F.lit("")
    kind = (
        F.when(match.contains("@"), "email").when(match.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "key").when(match.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(match.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip").when(match.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(match.rlike(r"^[+(]|^[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}$"), "phone").otherwise("card")
    )
    bare = F.regexp_extract(match, rf"(?s){label}(.*)$", 1)
    norm = F.when(kind == "email", F.lower(match)).when(kind.isin("phone", "ssn", "card"), F.regexp_replace(match, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(match)
    title = F.regexp_extract(match, rf"^({_TITLE}) ", 1)
    rest = F.substring(match, F.length(title) + 2, F.length(match))
    parts, between = F.regexp_extract_all(rest, F.lit(_PARTS), F.lit(0)), F.split(rest, _PARTS, -1)
    sex = F.when(F.rtrim(title, F.lit(".")).isin(*_FEMALE), "given_f").when(F.rtrim(title, F.lit(".")).isin(*_MALE), "given_m").when(F.lower(F.get(parts, F.lit(0))).rlike("[aая]$"), "given_f").otherwise("given_m")
    named = F.transform(parts, lambda part, i: F.struct(
        at.cast("int").alias("pos"), i.alias("sub"), F.concat(F.when(i == 0, F.concat(title, F.lit(" "))).otherwise(""), F.get(between, i)).alias("before"),
        F.when(i == F.size(parts) - 1, "surname").otherwise(sex).alias("kind"), part.alias("raw"), F.lower(part).alias("value")))
    hidden = F.array(token(0, F.left(match, F.length(match) - F.length(bare)), F.lit("secret"), bare, bare))
    return F.when(secret, hidden).when(title != "", named).otherwise(F.array(token(0, none, kind, match, norm)))


def _pool(kind: Column) -> Column:
    return F.regexp_replace(kind, "_.$", "")  # given names of both genders share one


def _settle(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt, given) of the entities whose first surrogate was taken: already an original, or another entity's surrogate.

    In each round the open entities draw; of equal draws the smallest value keeps it, the rest draw again. What is still open after
    ``DRAWS`` rounds and of a kind whose formats can be small gets a surrogate by :func:`_count_out`, in ``given``. Rounds go on until
    none is open, so surrogates of one kind are distinct from each other and from all originals of that kind.
    """
    waiting, settled, attempt = entities, None, 0
    while True:
        value = F.col("value")
        drawn = waiting.withColumn("attempt", F.lit(attempt)).withColumn("pool", _pool(F.col("kind")))
        drawn = drawn.withColumn("_stream", _stream(key, F.col("kind"), value, F.col("attempt"))).withColumn("surrogate", F.lower(_surrogate(F.col("kind"), value, F.col("_stream"), F.col("attempt")))).drop("_stream")
        rivals = _taken(entities, settled).withColumn("_rival", F.lit("")).union(drawn.select("pool", "surrogate", F.concat(F.lit("\x01"), F.col("kind"), F.lit("\x1f"), F.col("value"))))
        owner = rivals.groupBy("pool", "surrogate").agg(F.min("_rival").alias("_owner"))
        own = F.concat(F.lit("\x01"), F.col("kind"), F.lit("\x1f"), F.col("value"))
        judged = checkpoint(drawn.join(owner, ["pool", "surrogate"]).withColumn("_mine", F.col("_owner") == own).drop("_owner"))
        won, waiting = judged.filter("_mine").drop("_mine").withColumn("given", F.lit(None).cast("string")), judged.filter("NOT _mine").select("kind", "value")
        settled = won if settled is None else settled.unionByName(won)
        attempt += 1
        if attempt == DRAWS:
            settled = _count_out(waiting.filter(F.col("kind").isin(*COUNTED)), entities, settled)
            waiting = waiting.filter(~F.col("kind").isin(*COUNTED))
        if waiting.isEmpty():
            return settled.filter("attempt > 0").select("kind", "value", "attempt", "given")


def _taken(entities: DataFrame, settled: DataFrame | None) -> DataFrame:
    originals = entities.select(_pool(F.col("kind")).alias("pool"), F.lower("value").alias("surrogate"))
    return originals if settled is None else originals.union(settled.select("pool", "surrogate"))


def _format(kind: Column, value: Column, longer: int) -> Column:
    """For each place of a surrogate the signs it may have, ``longer`` places more than the value has; see :func:`_surrogate`."""
    tail = F.length(value) - F.length(F.substring_index(value, ".", -1))
    hexa, signs = (kind == "secret") & value.rlike("^[0-9a-f]+$"), (kind == "secret") & ~value.rlike(r"[\p{L}\p{N}]")
    fixed = lambda i: ((kind == "email") & (i >= tail)) | ((kind == "phone") & (i == 0))
    own = F.transform(F.split(F.lower(value), ""), lambda c, i: F.when(fixed(i), c).when(hexa, "0123456789abcdef").when(signs, SIGNS).otherwise(F.coalesce(_by_class(c, F.lit), c)))
    more = F.array_repeat(F.when(hexa, "0123456789abcdef").when(signs, SIGNS).when(kind.isin("phone", "ssn"), ALPHABETS[0]).otherwise(ALPHABETS[1]), longer)
    return F.when(kind == "email", F.concat(more, own)).otherwise(F.concat(own, more))


def _count_out(waiting: DataFrame, entities: DataFrame, settled: DataFrame) -> DataFrame:
    """``settled`` with a surrogate for each waiting value: the free ones of its format in order, of a longer format where it has none left.

    Of each format as many surrogates are made as can be taken or needed. Those taken go, one that several formats share goes to the first; a
    format's values take the rest in order. Formats without a free one grow by a place, the others go on until none waits.
    What is made is of the order of the pool: only formats that are nearly full have values left by then.
    """
    waiting, longer = checkpoint(waiting.withColumn("pool", F.col("kind")).withColumn("longer", F.lit(0))), 0
    while not waiting.isEmpty():
        most = waiting.agg(F.max("longer")).first()[0]
        form = F.coalesce(*(F.when(F.col("longer") == n, F.array_join(_format(F.col("kind"), F.col("value"), n), "\x1f")) for n in range(most + 1)))
        asked = checkpoint(waiting.withColumn("form", form))
        taken = _taken(entities.filter(F.col("kind").isin(*COUNTED)), settled)
        sizes = taken.groupBy("pool", F.length("surrogate").alias("_length")).agg(F.count("*").alias("_taken"))
        forms = asked.groupBy("pool", "form").agg(F.count("*").alias("_need")).withColumn("_places", F.split("form", "\x1f")).withColumn("_length", F.size("_places"))
        room = F.aggregate("_places", F.lit(1.0), lambda a, p: F.least(a * F.length(p), F.lit(1e15))).cast("bigint")
        made = forms.join(sizes, ["pool", "_length"], "left").withColumn("_n", F.least(room, F.col("_need") + F.coalesce("_taken", F.lit(0))))
        made = made.withColumn("_chunk", F.explode(F.expr("sequence(0L, (_n - 1) div 10000)"))).repartition("pool", "form", "_chunk")
        made = made.withColumn("_k", F.explode(F.expr("sequence(_chunk * 10000, least(_n, (_chunk + 1) * 10000) - 1)")))
        start = F.struct(F.col("_k").alias("k"), F.lit("").alias("out"))
        text = F.aggregate("_places", start, lambda a, p: F.struct(F.floor(a["k"] / F.length(p)).alias("k"), F.concat(a["out"], F.substring(p, (a["k"] % F.length(p) + 1).cast("int"), F.lit(1))).alias("out")))["out"]
        free = checkpoint(made.select("pool", "form", text.alias("surrogate")).join(taken, ["pool", "surrogate"], "left_anti"))
        first = free.groupBy("pool", "surrogate").agg(F.min("form").alias("form"))
        ranked = rank_rows(first, ["pool", "form"], ["surrogate"], "_rank")
        given = checkpoint(rank_rows(asked, ["pool", "form"], ["kind", "value"], "_rank").join(ranked, ["pool", "form", "_rank"], "left"))
        own = F.when(F.col("kind") == "secret", _cased(F.col("value"), F.col("surrogate"), F.lit(0))).otherwise(F.col("surrogate"))
        settled = checkpoint(settled.unionByName(given.filter("surrogate IS NOT NULL").select("kind", "value", F.lit(DRAWS).alias("attempt"), "pool", "surrogate", own.alias("given"))))
        open_forms = free.select("pool", "form", F.lit(0).alias("_grow")).distinct()
        left = given.filter("surrogate IS NULL").select("kind", "value", "pool", "longer", "form").join(open_forms, ["pool", "form"], "left")
        waiting = checkpoint(left.select("kind", "value", "pool", (F.col("longer") + F.coalesce("_grow", F.lit(1))).alias("longer")))
    return settled


def _mentions(gap: Column, at: Column, names: Column) -> Column:
    """(text, n) of the text between two entities: words among the ``names`` introduced before it are replaced, n of them."""
    words, between = F.regexp_extract_all(gap, F.lit(_PARTS), F.lit(0)), F.split(gap, _PARTS, -1)

    def known(word: Column) -> Column:
        name = F.element_at(names, F.lower(word))
        return F.when(name["pos"] < at, name["new"])

    new = F.transform(words, lambda w, i: F.concat(F.coalesce(known(w), w), F.get(between, i + 1)))
    told = F.struct(F.concat(F.get(between, F.lit(0)), F.array_join(new, "")).alias("text"), F.size(F.filter(words, lambda w: known(w).isNotNull())).alias("n"))
    return F.when((at == 0) | (F.size(names) == 0), F.struct(gap.alias("text"), F.lit(0).alias("n"))).otherwise(told)


def replace_entities(docs: DataFrame, key: str = "surrogates", text_col: str = "text") -> DataFrame:
    """``docs`` with every detected entity of ``text_col`` replaced by a keyed surrogate, and ``n_entities``.

    Detected are e-mail and IPv4 addresses, telephone, card, account and social security numbers, access keys, labelled secrets and
    names after a title. A surrogate keeps the type and format: separators, letter case, script of letters, brand digit and Luhn
    validity of cards, country digit of numbers, top-level domain, key prefix, label and title; given names keep the title's
    gender. Names may have any parts (hyphens, apostrophes, particles, inner capitals); their later mentions in the same text are replaced without a title too. Equal entities (in whatever format or case) have equal surrogates in the whole table, different ones of a
    kind different surrogates, which are no original of that kind either: clashes draw again, see :func:`_settle`.
    A format with too few surrogates gets longer ones. A secret of one repeated sign (********) is a mask already and stays.

    Only texts that hold an entity are shuffled, by a digest of the text: repeated texts share one replacement. Null and empty
    texts and texts without entities stay as they are, with 0 entities. Rows and all other columns are kept; a column
    ``n_entities`` is replaced. An empty table gives an empty result.
    """
    text, base = F.col(f"`{text_col}`"), docs.drop("n_entities")
    found = found_entities(text)
    digest = F.sha2(text.cast("binary"), 256)
    holders = base.select(text.alias("_text")).withColumn("_found", found_entities(F.col("_text"))).filter(F.size("_found") > 0)
    holders = holders.select(F.sha2(F.col("_text").cast("binary"), 256).alias("_digest"), "_found").groupBy("_digest").agg(F.first("_found").alias("_found"))
    tokens = checkpoint(holders.select("_digest", F.explode(F.flatten(F.transform("_found", _tokens))).alias("t")).select("_digest", "t.*"))
    again = _settle(checkpoint(tokens.select("kind", "value").distinct()), key)
    clash = again.select(F.col("kind").alias("_kind"), F.col("value").alias("_value"), F.col("attempt").alias("_attempt"), F.col("given").alias("_given"))
    tried = tokens.join(clash, (F.col("kind") == F.col("_kind")) & (F.col("value") == F.col("_value")), "left").withColumn("_attempt", F.coalesce("_attempt", F.lit(0)))
    kind, value = F.col("kind"), F.col("value")
    made = tried.withColumn("_stream", _stream(key, kind, value, F.col("_attempt"))).withColumn("_new", F.coalesce("_given", _surrogate(kind, value, F.col("_stream"), F.col("_attempt"))))
    made = made.withColumn("_out", F.concat("before", _layout(kind, F.col("raw"), F.col("_new"))))
    name = F.when((kind.startswith("given") | (kind == "surname")) & (F.length(value) > 1), F.struct("pos", "sub", "value", "_new"))
    ready = made.groupBy("_digest").agg(F.sort_array(F.collect_list(F.struct("pos", "sub", "_out"))).alias("_new"), F.count("*").cast("int").alias("_n"), F.sort_array(F.collect_list(name)).alias("_named"))
    introduced = F.filter("_named", lambda n, i: F.array_position(F.col("_named")["value"], n["value"]) == i + 1)
    ready = ready.withColumn("_names", F.map_from_entries(F.transform(introduced, lambda n: F.struct(n["value"], F.struct(n["pos"].alias("pos"), n["_new"].alias("new"))))))
    ready = ready.withColumnRenamed("_digest", "_key").drop("_named")
    holds = F.coalesce(F.size(found) > 0, F.lit(False))
    changed = base.filter(holds).withColumn("_digest", digest).join(ready, F.col("_digest") == F.col("_key"))
    gaps = changed.withColumn("_gaps", F.transform(F.split(text, ANY, -1), lambda gap, i: _mentions(gap, i, F.col("_names"))))
    filled = F.array_join(F.transform("_new", lambda t: F.concat(F.when(t["sub"] == 0, F.get("_gaps", t["pos"])["text"]).otherwise(""), t["_out"])), "")
    new_text = F.concat(filled, F.element_at("_gaps", -1)["text"])
    columns = [F.col(f"`{c}`") if c != text_col else new_text.alias(text_col) for c in base.columns]
    n = F.col("_n") + F.aggregate(F.col("_gaps")["n"], F.lit(0), lambda a, x: a + x)
    return gaps.select(*columns, n.alias("n_entities")).unionByName(base.filter(~holds).withColumn("n_entities", F.lit(0)))
