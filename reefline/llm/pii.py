"""Surrogates for personal data, in DataFrame operations only.

Detected entities get keyed replacements of their own kind and format. The same entity gets the same
replacement everywhere, in whatever way it is written (coreference); no two entities share one and none
equals an entity of the corpus (distinctness): candidates that collide are drawn again, round by round,
over a table of the distinct entities, and get longer where a format runs out.

Persons are found after a title or several. A name goes on while capitals or particles follow, but for words
that begin sentences. Given and family names are entities of their own, so John Smith, Mr. Smith and Smith's
share the family's surrogate, and John keeps his given name's; the names are then looked up in the rest of
their text, given names that are common words (Will, May) only beside the family. Card and bank account numbers count only with right check digits, and so do their
surrogates.

One expression finds all kinds; it runs only where a cheap sign of one is in a text. Texts without an entity
aren't touched or shuffled. An entity that very many texts hold is combined before each shuffle, and joined
from written tables that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefline.llm.common import written

_LETTER = "\\p{L}\\p{M}"
#: A word of a name, without a possessive's end.
_NAME = f"\\p{{Lu}}(?:[{_LETTER}]|['-](?![sS]\\b)(?=[{_LETTER}]))+"
#: Titles, some of which tell a person's gender.
MALE = "Mr|Herrn?|Monsieur|Señor|Sr|Signor|г-н|господин|Κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Srta|Signora|г-жа|госпожа|Κυρία"
NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Docteur|Dottore|д-р"
#: Lower case too, but for words that are common otherwise; upper case always.
_COMMON = ("Ms", "Miss", "Sr", "Doctor", "Professor", "Docteur", "Doktor", "Dottore")
MALE, FEMALE, NEUTRAL = ("|".join(dict.fromkeys(f for t in titles.split("|") for f in (t, t.upper(), *([] if t in _COMMON else [t.lower()])))) for titles in (MALE, FEMALE, NEUTRAL))
_TITLES = f"{MALE}|{FEMALE}|{NEUTRAL}"
_FIRSTS = "".join(sorted({t[0] for t in _TITLES.split("|")}))
_BEFORE = f"(?<![{_LETTER}\\p{{N}}_])"
_STACK = f"(?:(?:{_TITLES})\\.? ){{1,3}}"
_TITLED = f"(?=[{_FIRSTS}]){_BEFORE}{_STACK}(?!(?:{_TITLES})(?:[. ]|$))"
#: Words within a name that aren't names.
PARTICLES = "von van der den de del della di da dos du la le el al bin ibn zu zur af ter".split()
#: Words that stand with a capital where a sentence begins and end a name; as given names they are too common
#: to be looked for alone.
COMMON = (
    "the a an and but or he she it they we you i this that these those there here then when where who what why how if in on at for from with by after before while as "
    "is was are were will would can could may might must shall should has have had do does did not no yes so also now later today yesterday tomorrow mark rose hope grace faith june april august bill art "
    "der die das und aber oder er sie es wir ihr ich dann als wenn wo wer was wie im am auf für von mit nach vor bei ist war sind waren wird hat haben nicht nein ja auch jetzt heute gestern morgen "
    "le la les et mais ou il elle nous vous je ce cette puis quand qui que dans sur pour avec après avant est sont ont ne non oui aussi hier demain "
    "el los las pero ella yo este esta entonces cuando donde quien en para con después antes era son han también hoy ayer mañana"
).split()
_COMMON_WORD = f"(?i:{'|'.join(dict.fromkeys(COMMON))})(?![{_LETTER}])"
_PERSON = f"{_TITLED}{_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,2}}(?!{_COMMON_WORD}){_NAME}){{0,3}}"
_SET = "[\"']?\\s{0,2}(?:=\\s{0,2}[\"']?|:[\"']?(?=[^\\s\"'])|:\\s{1,2}(?:[\"']|(?=[^\\s\"',;]*[0-9])))"
_PASSWORD = f"(?=[Pp])\\b(?i:password|passwd|pwd){_SET}"
_TOKEN = f"(?=[TtSsAa])\\b(?i:token|secret|api_?key){_SET}"
#: Keys of services, by their prefix; what is kept of one is that prefix.
SERVICE_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxb-", "xoxp-", "eyJ")
_SERVICE = "(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[bp]-[A-Za-z0-9-]{20,}|eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,})"
_OCTET = "(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Kinds of entities and what they look like, in order of precedence. A keyword or title before a secret or
#: name belongs to the match.
KINDS = (
    ("email", f"(?<![{_LETTER}\\p{{N}}._%+-])[{_LETTER}\\p{{N}}_%+-][{_LETTER}\\p{{N}}._%+-]*@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{{2,}}"),
    ("password", f"{_PASSWORD}[^\\s\"',;]{{6,}}"),
    ("token", f"{_TOKEN}[A-Za-z0-9_+/=-](?:[A-Za-z0-9_+/=-]|\\.(?=[A-Za-z0-9_+/=-])){{15,}}"),
    ("service_key", _SERVICE),
    ("access_key", "(?=A)\\b(?:AKIA|ASIA)[A-Z0-9]{16}\\b"),
    ("iban", "(?=[A-Z]{2}\\d)\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b"),
    ("ip", f"(?<![\\d.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![\\d]|\\.\\d)"),
    ("ip6", f"(?=[0-9A-Fa-f:]+:)(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[A-Fa-f:]*\\d)(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,5}})(?![0-9A-Za-z:])"),
    ("card", "(?=\\d)(?<![\\d.-])(?:\\d{13,19}|\\d{4}([ -])\\d{4}\\1\\d{4}\\1\\d{4})(?![\\d-])"),
    ("ssn", "(?=\\d)(?<![\\d-])\\d{3}-\\d{2}-\\d{4}(?![\\d-])"),
    ("phone", "(?<![\\d+])\\+\\d{1,3}[ .-]?(?:\\(\\d{1,4}\\)|\\d{1,4})(?:[ .-]?\\d{2,4}){2,4}(?!\\d)|(?<!\\d)\\(\\d{3,5}\\) ?\\d{3,4}[ -]\\d{3,4}(?!\\d)"
              "|(?=\\d)(?<![\\d.-])(?:\\d{3}-\\d{3}-\\d{4}|\\d{3}\\.\\d{3}\\.\\d{4}|0\\d{1,4}[ -]\\d{3,4}[ -]\\d{3,4})(?![\\d-])"),
    ("person", _PERSON),
)
#: Signs that are cheap to look for, one of which every entity has: digits, two kinds of colons, and a title
#: before a space and a capital. Titles are looked up by length, backwards from such a space.
_LENGTHS: dict[int, list[str]] = {}
for _form in dict.fromkeys(f for t in _TITLES.split("|") for f in ((t[:-2], t[:-1]) if t.endswith("?") else (t,))):
    _LENGTHS.setdefault(len(_form), []).append(_form)
DIGITS_SIGN = "[0-9A-Z](?:(?<=[0-9])[0-9.() -]{5,}[0-9]|(?<=[A-Z])[A-Z][0-9]{2})"
TITLE_SIGN = " (?=\\p{Lu})(?:" + "|".join(f"(?<=(?:{'|'.join(v)}){dot} )" for v in _LENGTHS.values() for dot in ("", "\\.")) + ")"
KEYWORD = "(?i)(?:password|passwd|pwd|token|secret|api_?key)[\"']?\\s{0,2}[=:]"
#: Given names by gender and script, drawn from first; then names are made of syllables.
GIVEN = {
    "m": {"latin": "Adam Boris Carl Daniel Emil Felix Hugo Ivan Jonas Leon Martin Oscar Paul Simon Tomas Victor", "cyrillic": "Антон Борис Виктор Глеб Денис Иван Олег Павел", "greek": "Άγγελος Γιώργος Δημήτρης Νίκος Παύλος Στέφανος Φώτης Χρήστος"},
    "f": {"latin": "Alma Bella Clara Diana Elena Flora Helga Irene Julia Laura Marta Nora Paula Rosa Sofia Vera", "cyrillic": "Анна Вера Дарья Елена Ирина Мария Нина Ольга", "greek": "Άννα Βέρα Δάφνη Ελένη Ιωάννα Κατερίνα Μαρία Σοφία"},
}
SYLLABLES = {"latin": "ba be bo da del do fa fer ga gor ha hel jo ka kel la len lo ma mer mi na nel no ra rin ro sa sel ta tor va vel vi wen zo", "cyrillic": "ба бе во га го да ди ка ко ла ле ма ме на ни ра ри са со та ти ша", "greek": "βα γα δη θε κα κο λα λε μα με να νι πα ρα ρο σα στε τα τι φω"}
ENDS = {"family": {"latin": "man ner sen ton well berg lin ford mann sky", "cyrillic": "ов ин ский енко ук", "greek": "ίδης άκης όπουλος άτος"}, "m": {"latin": "n s ric do", "cyrillic": "н р м", "greek": "ς"}, "f": {"latin": "a na lia ra", "cyrillic": "на ра ла", "greek": "α"}}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
DIGITS = ("card", "ssn", "phone")


def pattern() -> str:
    """All kinds in one expression; the one group inside keeps its number."""
    return "|".join(f"(?:{p})" for _, p in KINDS)


def kind_of(mention: Column) -> Column:
    """The kind of a mention, by its own form; null for a name without a title."""
    out = F.when(mention.rlike(f"^{_PASSWORD}"), "password").when(mention.rlike(f"^{_TOKEN}"), "token").when(mention.rlike(f"^{_SERVICE}$"), "service_key").when(mention.rlike("@"), "email")
    out = out.when(mention.rlike("^(?:AKIA|ASIA)[A-Z0-9]{16}$"), "access_key").when(mention.rlike(f"^{_STACK}\\p{{Lu}}"), "person")
    out = out.when(mention.rlike("^\\d{1,3}(?:\\.\\d{1,3}){3}$"), "ip").when(mention.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip6").when(mention.rlike("^[A-Z]{2}\\d{2}[A-Z0-9 ]+$"), "iban")
    out = out.when(mention.rlike("^\\d{3}-\\d{2}-\\d{4}$"), "ssn").when(mention.rlike("^(?:\\d{13,19}|\\d{4}[ -]\\d{4}[ -]\\d{4}[ -]\\d{4})$"), "card")
    return out.when(mention.rlike("^[+(\\d][\\d() .-]+$"), "phone")


def prefix_of(kind: Column, mention: Column) -> Column:
    """What stands before the entity in a mention: the keyword or title."""
    head = F.when(kind == "password", F.regexp_extract(mention, f"^{_PASSWORD}", 0)).when(kind == "token", F.regexp_extract(mention, f"^{_TOKEN}", 0))
    return F.coalesce(head.when(kind == "person", F.regexp_extract(mention, f"^{_STACK}", 0)), F.lit(""))


def gender_of(prefix: Column) -> Column:
    return F.when(prefix.rlike(f"(?:^| )(?:{MALE})\\.? "), 1).when(prefix.rlike(f"(?:^| )(?:{FEMALE})\\.? "), -1).otherwise(0)


def digit_sum(digits: Column) -> Column:
    """Luhn's sum of a number: doubled from the second last digit on, every other one."""
    n = F.length(digits)

    def add(total: Column, c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    numbered = F.transform(F.split(digits, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    return F.aggregate(numbered, F.lit(0), lambda a, x: add(a, x["c"], x["i"]))


def rest_97(account: Column) -> Column:
    """The remainder by 97 of a bank account number, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def is_one(kind: Column, mention: Column) -> Column:
    """Whether a mention's check digits are right, where its kind has some."""
    bare = F.regexp_replace(mention, "[ -]", "")
    return F.when(kind == "card", digit_sum(bare) % 10 == 0).when(kind == "iban", rest_97(bare) == 1).otherwise(True)


def same_entity(kind: Column, mention: Column) -> Column:
    """The form that all ways to write an entity share."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(mention))
        .when(kind.isin(*DIGITS), F.regexp_replace(mention, "\\D", ""))
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .when(kind.isin("given", "family"), F.initcap(F.lower(mention)))
        .otherwise(mention)
    )


def with_names(expression: str, names: Column) -> Column:
    """``expression``, or one of the names or their parts, as written or in upper case; long ones first. A
    given name that is a common word is no part."""
    alone = lambda w, last: w.rlike("^\\p{Lu}") & (last | ~F.lower(w).isin(*COMMON))
    parts = F.transform(names, lambda x: F.filter(F.split(x, " "), lambda w, i: alone(w, i == F.size(F.split(x, " ")) - 1)))
    names = F.array_union(names, F.flatten(parts))
    names = F.array_union(names, F.transform(names, F.upper))
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    return F.concat(F.lit(f"{expression}|{_BEFORE}(?:"), F.array_join(longest, "|"), F.lit(f")(?![{_LETTER}\\p{{N}}_])"))


def byte(seed: Column, i: Column) -> Column:
    """The i-th pseudorandom number, 0 to 65535, of a seed (the hex digits of a SHA-512)."""
    return F.conv(F.substring(seed, i % 32 * 4 + 1 + F.floor(i / 32).cast("int") % 3, F.lit(4)), 16, 10).cast("int")


def shaped(form: Column, seed: Column, keep: Column | None = None) -> Column:
    """``form`` with each letter and digit replaced by one of its case and script (hexadecimal text by
    hexadecimal digits); ``keep`` leading characters stay."""
    is_hex, is_upper_hex = (form.rlike(f"^[0-9{x}]*[{x}][0-9{x}]*$") & (F.length(form) >= 16) for x in ("a-f", "A-F"))

    def one(c: Column, i: Column) -> Column:
        r = byte(seed, i)
        pick = lambda alphabet: F.substring(F.lit(alphabet), r % len(alphabet) + 1, F.lit(1))
        out = F.when(is_hex, pick("0123456789abcdef")).when(is_upper_hex, pick("0123456789ABCDEF")).when(i < (keep if keep is not None else F.lit(0)), c).when(c.rlike("[0-9]"), (r % 10).cast("string"))
        for script, alphabet in (("\\p{IsCyrillic}", "cyrillic"), ("\\p{IsGreek}", "greek"), ("\\p{L}", "latin")):
            small = pick(ALPHABETS[alphabet])
            out = out.when(c.rlike(f"^(?=\\p{{Lu}}){script}"), F.upper(small)).when(c.rlike(script), small)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def chosen(words: str, at: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words.split()]), F.pmod(at, F.lit(len(words.split()))))


def named(kind: Column, entity: Column, gender: Column, seed: Column, turn: int) -> Column:
    """A name of an entity's kind, gender and script: a usual given name in the first turns, then syllables,
    one more for each eight turns."""
    script = F.when(entity.rlike("\\p{IsCyrillic}"), "cyrillic").when(entity.rlike("\\p{IsGreek}"), "greek").otherwise("latin")
    sex = F.when(gender > 0, "m").when(gender < 0, "f").otherwise(F.when(byte(seed, F.lit(30)) % 2 == 0, "m").otherwise("f"))
    out = F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        stem = F.concat(*[chosen(parts, byte(seed, F.lit(k))) for k in range(2 + turn // 8)])
        for end in ("m", "f"):
            given = F.concat(stem, chosen(ENDS[end][s], byte(seed, F.lit(29)))) if turn >= 4 else chosen(GIVEN[end][s], byte(seed, F.lit(31)))
            out = F.when((kind == "given") & (script == s) & (sex == end), given).otherwise(out)
        out = F.when((kind == "family") & (script == s), F.concat(stem, chosen(ENDS["family"][s], byte(seed, F.lit(29))))).otherwise(out)
    return F.initcap(out)


def surrogate(kind: Column, entity: Column, gender: Column, key: str, turn: int) -> Column:
    """A keyed candidate for an entity, of its kind, in the shared form. From the 12th turn on digits,
    letters or, for addresses, the next version's form are added, so no format runs out."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(turn))), 512)
    longer = F.concat(entity, F.repeat(F.lit("0"), F.lit(turn // 4 - 2))) if turn >= 12 else entity
    octets = [F.when((F.lit(i) == 0) & F.split(entity, "\\.")[0].isin("10", "127", "172", "192"), F.split(entity, "\\.")[0].cast("int")).otherwise(byte(seed, F.lit(i)) % 254 + 1) for i in range(4)]
    ip6 = F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.lower(F.hex(byte(seed, F.lit(i)) % 65535 + 1))) for i in range(6)])
    ip = F.concat_ws(".", *octets) if turn < 12 else ip6
    domain = F.concat(shaped(F.lit("aaaaaa"), F.sha2(F.concat(seed, F.lit("domain")), 512)), F.lit(".example.com"))
    local = F.regexp_extract(entity, "^(.*)@", 1)
    email = F.concat(shaped(F.concat(local, F.repeat(F.lit("0"), F.lit(max(0, turn // 4 - 2)))), seed), F.lit("@"), domain)
    head = shaped(F.substring(longer, F.lit(1), F.length(longer) - 1), seed, F.lit(1))
    card = F.concat(head, F.pmod(-digit_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))
    body = shaped(F.substring(longer, F.lit(5), F.length(longer)), seed)
    country = F.substring(entity, F.lit(1), F.lit(2))
    iban = F.concat(country, F.lpad((98 - rest_97(F.concat(country, F.lit("00"), body))).cast("string"), 2, "0"), body)
    fictional = F.concat(shaped(F.substring(entity, F.lit(1), F.length(entity) - 7), seed, F.greatest(F.length(entity) - 10, F.lit(0))), F.lit("555"), shaped(F.substring(entity, F.lit(-4), F.lit(4)), F.sha2(seed, 512)))
    return (
        F.when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "email", email).when(kind.isin("given", "family"), named(kind, entity, gender, seed, turn))
        .when(kind == "access_key", shaped(longer, seed, F.lit(4))).when(kind == "service_key", shaped(longer, seed, F.length(F.regexp_extract(entity, f"^(?:{'|'.join(SERVICE_PREFIXES)})", 0)))).when(kind == "card", card).when(kind == "iban", iban)
        .when((kind == "phone") & F.lit(turn < 8) & entity.rlike("555\\d{4}$"), fictional)
        .when(kind == "phone", shaped(longer, seed, F.greatest(F.length(entity) - 10, F.lit(0))))
        .otherwise(shaped(longer, seed))
    )


def written_like(kind: Column, mention: Column, new: Column) -> Column:
    """A surrogate in the way its mention is written: characters at the places of the mention's digits (or, of
    an account, of its digits and letters), upper case kept; what is left of a longer one follows."""
    place = F.when(kind == "iban", "[A-Z0-9]").otherwise("[0-9]")
    spread = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(F.rlike(c, place), F.struct(F.concat(a["out"], F.substring(new, a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(new, a["at"], F.length(new))),
    )
    shouted = kind.isin("email", "given", "family", "ip6") & mention.rlike("^[^\\p{Ll}]*\\p{Lu}[^\\p{Ll}]*$") & (F.length(mention) > 1)
    return F.when(kind.isin(*DIGITS, "iban"), spread).when(shouted, F.upper(new)).otherwise(new)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, new) for a written table of distinct (kind, entity), with gender where there are given
    names. Names share one set of surrogates, given or family."""
    if "gender" not in entities.columns:
        entities = entities.withColumn("gender", F.lit(0))
    space = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind"))
    taken = entities.select(space.alias("space"), F.lower("entity").alias("form"))
    pending, done, turn = entities, None, 0
    tasks = entities.sparkSession.sparkContext.defaultParallelism  # few bytes, much work: not one task
    while done is None or not pending.isEmpty():
        drawn = pending.repartition(tasks).withColumn("new", surrogate(F.col("kind"), F.col("entity"), F.col("gender"), key, turn)).withColumns({"space": space, "form": F.lower("new")})
        drawn = written(drawn, "pii-drawn")
        free = drawn.join(taken, ["space", "form"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "form"), ["space", "form"], "left_anti")
        won = free.groupBy("space", "form").agg(F.min(F.struct("entity", "kind", "new")).alias("w")).select("space", "form", "w.*")
        won = written(won, "pii-won")
        done = won if done is None else written(done.unionByName(won), "pii-done")
        pending = written(drawn.select(*entities.columns).join(won, ["kind", "entity"], "left_anti"), "pii-pending")
        turn += 1
    return done.select("kind", "entity", "new")


def pseudonymise(docs: DataFrame, text_col: str = "text", *, key: str) -> DataFrame:
    """``docs`` with surrogates in the text, and n_entities int: how many places were replaced (named
    n_entities_ where there is such a column already). A name of two words is two places.

    All columns stay, whatever their names; the text of a row without an entity stays as it is, null and
    empty ones too (n_entities 0). Rows may repeat: each is replaced alike. An empty table stays empty.
    """
    expression = pattern()
    counted = "n_entities"
    while counted in docs.columns:
        counted += "_"
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    text = F.col(f"_doc.`{text_col}`")
    has = lambda x: F.contains(text, F.lit(x))
    service = has(SERVICE_PREFIXES[0])
    for x in SERVICE_PREFIXES[1:]:
        service = service | has(x)
    sign = service | has("@") | ((has("=") | has(":")) & text.rlike(KEYWORD)) | (has(":") & text.rlike("[0-9A-Fa-f]:[0-9A-Fa-f:]")) | has("AKIA") | has("ASIA")
    sign = F.coalesce(sign | text.rlike(DIGITS_SIGN) | text.rlike(TITLE_SIGN), F.lit(False))
    # Texts with a sign are written with what was found in them, so that the expression runs once on each.
    signed = packed.where(sign).select(F.monotonically_increasing_id().alias("_row"), "_doc", F.regexp_extract_all(text, F.lit(expression), F.lit(0)).alias("_first"))
    signed = written(signed, "pii-signed")
    titled = F.filter("_first", lambda m: m.rlike(f"^{_STACK}\\p{{Lu}}"))
    names = F.transform(titled, lambda m: F.regexp_replace(m, f"^{_STACK}", ""))
    found = signed.where("size(_first) > 0").withColumn("_names", F.array_distinct(names))
    plain = found.where("size(_names) = 0").select("_row", "_names", F.col("_first").alias("_mentions"), F.split(text, expression, -1).alias("_gaps"))
    follow = with_names(expression, F.col("_names"))
    followed = found.where("size(_names) > 0").select("_row", "_names", F.regexp_extract_all(text, follow, F.lit(0)).alias("_mentions"), F.split(text, follow, -1).alias("_gaps"))
    pieces = written(plain.unionByName(followed), "pii-pieces")

    places = pieces.select("_row", F.posexplode("_mentions").alias("_at", "mention"), "_names").withColumn("_kind", F.coalesce(kind_of(F.col("mention")), F.lit("name")))
    places = places.withColumn("_kind", F.when(is_one(F.col("_kind"), F.col("mention")), F.col("_kind")).otherwise(F.lit("none"))).withColumn("_prefix", prefix_of(F.col("_kind"), F.col("mention")))
    bare = F.substring(F.col("mention"), F.length("_prefix") + 1, F.length("mention"))
    # Names are taken apart: the last word after a title is the family, and so is a word that ends a name of the text.
    families = F.transform("_names", lambda x: F.lower(F.element_at(F.split(x, " "), -1)))
    part = lambda w, i, n: F.struct(F.when(w.isin(*PARTICLES), "none").when((i < n - 1) | ((F.col("_kind") == "name") & ~F.array_contains(families, F.lower(w))), "given").otherwise("family").alias("kind"), w.alias("mention"), i.alias("i"))
    words = F.split(bare, " ")
    parts = F.when(F.col("_kind").isin("person", "name"), F.transform(words, lambda w, i: part(w, i, F.size(words)))).otherwise(F.array(F.struct(F.col("_kind").alias("kind"), bare.alias("mention"), F.lit(0).alias("i"))))
    places = places.select("_row", "_at", "_prefix", gender_of(F.col("_prefix")).alias("gender"), F.explode(parts).alias("p")).select("_row", "_at", "_prefix", "gender", "p.*")
    places = written(places, "pii-places")
    mentions = written(places.where("kind <> 'none'").groupBy("kind", "mention").agg(F.sum("gender").alias("gender")).withColumn("entity", same_entity(F.col("kind"), F.col("mention"))), "pii-mentions")
    entities = written(mentions.groupBy("kind", "entity").agg(F.sum("gender").alias("gender")), "pii-entities")
    new = surrogates(entities, key)
    spelled = written(mentions.join(new, ["kind", "entity"]).select("kind", "mention", written_like(F.col("kind"), F.col("mention"), F.col("new")).alias("new")), "pii-spelled")
    place = lambda new: F.struct("_at", "i", "_prefix", new.alias("new")).alias("n")
    by_place = places.where("kind <> 'none'").join(spelled, ["kind", "mention"]).select("_row", place(F.col("new")), F.lit(1).alias("one"))
    by_place = by_place.unionByName(places.where("kind = 'none'").select("_row", place(F.col("mention")), F.lit(0).alias("one")))
    in_row = written(by_place.groupBy("_row").agg(F.array_sort(F.collect_list("n")).alias("_new"), F.sum("one").cast("int").alias("_n")).where("_n > 0"), "pii-rows")

    # A text again: before each mention its gap and its prefix, between the words of a name a space.
    before = lambda x: F.when(x["i"] == 0, F.concat(F.get("_gaps", x["_at"]), x["_prefix"])).otherwise(F.lit(" "))
    replaced = F.concat(F.array_join(F.transform("_new", lambda x: F.concat(before(x), x["new"])), ""), F.element_at("_gaps", -1))
    columns = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    changed = signed.join(pieces.select("_row", "_gaps").join(in_row, "_row"), "_row").select(*[replaced.alias(c) if c == text_col else k for c, k in zip(docs.columns, columns, strict=True)], F.col("_n").alias(counted))
    none = F.lit(0).alias(counted)
    same = packed.where(~sign).select(*columns, none).union(signed.join(in_row.select("_row"), "_row", "left_anti").select(*columns, none))
    return same.union(changed)
