"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Detected are mail addresses, phone numbers, payment cards (with a right check digit), social security numbers, IPv4 addresses,
IBANs (with right check digits), access keys, secrets after a keyword, and names: all capitalised words that follow a title or a
phrase of INTRODUCTION, the last of them the surname. A full name so known, a given name and the surname after it, is a name in all
documents, by an equality join of the pairs of capitalised words. In a document with a name its parts are replaced where they
stand alone, too, by the same surrogates; left alone are a part that an article stands before and another capitalised word after (the White
House), and a month's name after a word of time (in May). An entity has parts (a mail address: mailbox and domain; a name: given
names and surname), each of a type and a normal form, so spellings of one entity share their parts.

A part's surrogate follows from a keyed hash of type, normal form and attempt, and has the type's format: as many digits and
letters in the same places, the country code of a phone number and the first digit of a card, the right check digits of cards and IBANs,
a given name of the title's gender, names in the part's own script, domains under the reserved `example`. A mailbox that spells a known
full name spells that name's surrogate. Addresses of a block with a meaning of its own (private, loopback, link-local, multicast)
stay in it: a keyed permutation of the block, without a fixed point, maps them, so they are distinct even where a corpus uses up the
block; all other addresses become public ones. Any other surrogate that another part of its type has too, or that is a real part, is made
anew with the next attempt until all are distinct and none is real; only such parts go through the next round. Later attempts
lengthen mailboxes, domains, names and secrets by ever more characters, so their number has no bound. So equal entities get equal
surrogates in all documents, and different ones different surrogates.

Every text is searched once, and the table is written once with what was found. Only documents with an entity are shuffled; a
document gathers its own distinct entities and nothing larger. No pattern recurses by the length of a text, so texts of any
length take linear time and a bounded stack.

Defined results: a run of bare names counts as one entity; names that follow a title or introduction nowhere stay;
a mail address has at most 127 labels of 63 characters after its @; a null text stays null with 0 entities; a text without entities
is unchanged; repeated rows stay; all columns of the input are returned, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: The key of the registered query and of the pipeline where the session names none.
QUERY_KEY = "tessera-surrogates"
KEY_SETTING = "spark.tessera.surrogateKey"
ATTEMPTS = 60
# Titles by the gender they tell, phrases before a name, and patterns of entities. No pattern can start inside a run it
# could have started before, so long runs take linear time; repeated groups are possessive or bounded, so the stack is bounded too.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа"], "n": ["Dr", "Prof"]}
INTRODUCTION = "(?:[Mm]y name is|[Mm]ein Name ist|[Ii]ch heiße|[Jj]e m['’]appelle|[Mm]e llamo|[Мм]еня зовут)"
TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in sorted(ts, key=len, reverse=True)) + r")\.?"
# A capitalised word of a name, of two characters or more, without a genitive's 's, and not itself a title.
WORD = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
NAME = rf"(?!{TITLE}(?![\p{{L}}'’-])){WORD}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
KEYWORD = r"(?i:token|secret|password|passwd|pwd|api_?key)\s{0,2}[=:]\s{0,2}[\"']?"
PATTERNS = {
    "secret": rf"(?<![A-Za-z]){KEYWORD}[A-Za-z0-9_+/.-]{{8,}}",
    "access": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,63}",
    "name": rf"(?<!\p{{L}})(?:(?:{TITLE} ){{1,8}}+{NAME}(?: {NAME})*+|{TITLE} {WORD}|{INTRODUCTION} {NAME}(?: {NAME})*+)",
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+1[ .-]?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
    r"|(?<![0-9+])\+[2-9][0-9]{0,2}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4}(?![0-9])"
    r"|(?<![0-9])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{4}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4})(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
MAYBE = rf"[0-9@=:]|AKIA|{TITLE} \p{{Lu}}|{INTRODUCTION} \p{{Lu}}"  # every entity has one of these
BARE = rf"(?<!\p{{L}}){WORD}"
RUN = rf"(?<!\p{{L}}){WORD}(?: {WORD})++"
# What stands before a word that names a thing or a time, months that are names too, calling codes of one and two digits, and
# blocks of addresses with a meaning of their own, with the number of bits that are free in them.
ARTICLE = r"(?i)(?:^|[^\p{L}])(?:the|an?|this|that|der|die|das|den|dem|des|im|am|zum|zur|le|la|les|du|des|au|aux|el|los|las|del|al)[ ]$"
TIME = r"(?i)(?:^|[^\p{L}])(?:in|since|until|till|by|from|last|next|this|every|early|late|mid|of|im|seit|bis|ab|en|depuis|jusqu'en|desde|hasta|de)[ ]$"
MONTHS = ["january", "march", "april", "may", "june", "august", "april", "mai", "juni", "august", "avril", "juin", "abril", "mayo", "agosto", "julio"]
CALLING = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
BLOCKS = {r"0\.": 24, r"10\.": 24, r"127\.": 24, r"172\.(?:1[6-9]|2[0-9]|3[01])\.": 20, r"192\.168\.": 16, r"169\.254\.": 16, r"100\.(?:6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.": 22, r"(?:22[4-9]|23[0-9])\.": 28, r"(?:24[0-9]|25[0-5])\.": 28}
SPECIAL = (10, 100, 127, 169, 172, 192, 198, 203)  # first octets below 224 of blocks that are not all public
SYLLABLES = {
    "latin": ["ba", "re", "mi", "to", "lu", "ka", "ne", "si", "do", "ru", "va", "le", "ni", "po", "gu", "ha"],
    "cyrillic": ["ба", "ре", "ми", "то", "лу", "ка", "не", "си", "до", "ру", "ва", "ле", "ни", "по", "гу", "ха"],
    "greek": ["βα", "ρε", "μι", "το", "λυ", "κα", "νε", "σι", "δο", "ρυ", "φα", "λε", "νι", "πο", "γυ", "χα"],
}
ENDINGS = {"latin": {"m": "n", "f": "ia", "n": "en"}, "cyrillic": {"m": "н", "f": "ия", "n": "ен"}, "greek": {"m": "ς", "f": "ια", "n": "εν"}}


def _luhn_sum(digits: Column) -> Column:
    def add(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), add), F.lit(0), lambda a, x: a + x)


def iban_check(country: Column, account: Column) -> Column:
    """The two check digits of an IBAN: 98 less the remainder modulo 97 of account, country and two noughts, letters as 10 to 35."""

    def add(rest: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + letter) % 97).cast("int")

    signs = F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != "")
    return F.lpad((98 - F.aggregate(signs, F.lit(0), add)).cast("string"), 2, "0")


def surrogate_key(spark: SparkSession, default: str | None = None) -> str:
    """The session's key. Without one it is an error, as surrogates of a known key can be made anew by anyone; the registered query and the pipeline's stage name QUERY_KEY on purpose, so that their results can be repeated."""
    key = spark.conf.get(KEY_SETTING, default or "")
    if not key:
        raise ValueError(f"set {KEY_SETTING} to a secret key")
    return key


def _only(c: Column, kept: str) -> Column:
    return F.regexp_replace(c, f"[^{kept}]", "")


def kind_of(raw: Column) -> Column:
    """The first pattern that an entity is of; null for what lacks the check digits of a card or an IBAN."""
    out = None
    for kind, p in PATTERNS.items():
        ok = raw.rlike(f"^(?:{p})$")
        if kind == "card":
            ok = ok & (_luhn_sum(_only(raw, "0-9")) % 10 == 0)
        if kind == "iban":
            norm = _only(raw, "A-Z0-9")
            ok = ok & (F.substring(norm, 3, 2) == iban_check(F.substring(norm, 1, 2), F.substring(norm, F.lit(5), F.length(norm))))
        out = F.when(ok, kind) if out is None else out.when(ok, kind)
    return out


def _part(kind: Column | str, norm: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("type"), norm.alias("norm"))


def parts_of(kind: Column, raw: Column) -> Column:
    """array<struct<type,norm>>."""
    low = F.lower(raw)
    title = F.regexp_extract(raw, f"^((?:{TITLE} )+|{INTRODUCTION} )", 1)
    names = F.split(F.substring(raw, F.length(title) + 1, F.length(raw)), " ")
    gender = F.lit("n")
    for g in ("m", "f"):
        gender = F.when(F.arrays_overlap(F.split(F.replace(title, F.lit("."), F.lit("")), " "), F.lit(TITLES[g])), g).otherwise(gender)
    given = F.transform(F.slice(names, F.lit(1), F.size(names) - 1), lambda n: _part(F.concat(F.lit("given-"), gender), F.lower(n)))
    surname = F.array(_part("surname", F.lower(F.element_at(names, -1))))
    return (
        F.when(kind == "email", F.array(_part("mailbox", low), _part("domain", F.regexp_extract(low, "@(.*)$", 1))))
        .when(kind == "name", F.concat(given, surname))
        .when(kind.isin("card", "ssn"), F.array(_part(kind, _only(raw, "0-9"))))
        .when(kind == "phone", F.array(_part(kind, F.concat(F.when(raw.startswith("+"), "+").otherwise(""), _only(raw, "0-9")))))
        .when(kind == "ipv4", F.array(_part(F.when(_block(raw).isNull(), kind).otherwise("ipv4-block"), raw)))
        .when(kind == "iban", F.array(_part(kind, _only(raw, "A-Z0-9"))))
        .when(kind == "secret", F.array(_part(kind, F.regexp_replace(raw, f"^{KEYWORD}", ""))))
        .otherwise(F.array(_part(kind, raw)))
    )


def _block(address: Column) -> Column:
    """Free bits of the special block that an address is in; null for a public one."""
    out = None
    for p, bits in BLOCKS.items():
        hit = address.rlike(f"^{p}")
        out = F.when(hit, bits) if out is None else out.when(hit, bits)
    return out


def _moved(address: Column, key: str) -> Column:
    """The address that follows this one in a keyed order of its block: a Feistel network gives a place, and the next place's address is the surrogate."""
    number = F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    shift = lambda f, c, n: F.call_function(f, c, n)

    def of(x: Column) -> Column:
        half, one = (x["bits"] / 2).cast("int"), F.lit(1).cast("long")
        mask, top = shift("shiftleft", one, half) - 1, shift("shiftright", x["n"], x["bits"])
        low = x["n"] - shift("shiftleft", top, x["bits"])

        def mix(value: Column, r: Column) -> Column:
            seed = F.concat_ws("\u0001", F.lit(key), F.lit("block"), top.cast("string"), r.cast("string"), value.cast("string"))
            return F.conv(F.substring(F.sha2(seed, 256), 1, 8), 16, 10).cast("long").bitwiseAND(mask)

        def pair(a: Column, b: Column) -> Column:
            return F.struct(a.alias("a"), b.alias("b"))

        start = pair(shift("shiftright", low, half), low.bitwiseAND(mask))
        place = F.aggregate(F.sequence(F.lit(3), F.lit(0), F.lit(-1)), start, lambda s, r: pair(s["b"].bitwiseXOR(mix(s["a"], r)), s["a"]), lambda s: (shift("shiftleft", s["a"], half) + s["b"] + 1) % shift("shiftleft", one, x["bits"]))
        again = _let(place, lambda q: pair(shift("shiftright", q, half), q.bitwiseAND(mask)))
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(3)), again, lambda s, r: pair(s["b"], s["a"].bitwiseXOR(mix(s["b"], r))), lambda s: shift("shiftleft", s["a"], half) + s["b"])
        return _let(shift("shiftleft", top, x["bits"]) + moved, lambda n: F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255).cast("long")).cast("string") for k in (24, 16, 8, 0)]))

    return _let(F.struct(number.alias("n"), _block(address).alias("bits")), of)


def surrogate_of(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a part, from the hash of key, type, normal form and attempt, which is computed once."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string"))
    noise = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\u0001{k}")), 256) for k in range(4)])
    return F.when(kind == "ipv4-block", _moved(norm, key)).otherwise(_let(noise, lambda n: _from_noise(n, kind, norm, attempt)))


def _from_noise(noise: Column, kind: Column, norm: Column, attempt: Column) -> Column:
    def number(i: Column) -> Column:
        return F.conv(F.substring(noise, 3 * (i % 85) + 1, F.lit(3)), 16, 10).cast("int")

    def pick(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), number(i) % len(alphabet) + 1, F.lit(1))

    def like(s: Column, fixed: Column | int = 0, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
        """Digits for digits and letters for letters, but for the first ones."""

        def one(c: Column, i: Column) -> Column:
            new = F.when(i < fixed, c).when(c.between("0", "9"), pick("0123456789", i)).when(c.between("a", "z"), pick(letters, i))
            return new.when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), "")

    more = F.when(attempt > 2, F.substring(noise, F.lit(-20), F.least(attempt - 1, F.lit(20)))).otherwise("")
    card = F.concat(like(F.substring(norm, F.lit(1), F.length(norm) - 1), 1), F.lit("0"))
    check = ((10 - _luhn_sum(card) % 10) % 10).cast("string")
    public = F.array(*[F.lit(n) for n in range(1, 224) if n not in SPECIAL])
    sixteen = lambda k: number(F.lit(2 * k)) + 16 * number(F.lit(2 * k + 1))
    octets = F.concat_ws(".", F.element_at(public, sixteen(0) % (223 - len(SPECIAL)) + 1).cast("string"), *[(1 + sixteen(k) % 254).cast("string") for k in range(1, 4)])
    country, account = F.substring(norm, 1, 2), like(F.substring(norm, F.lit(5), F.length(norm)))
    domain = F.regexp_replace(like(norm), r"[^.]+$", "example")
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    def name(alphabet: str) -> Column:
        sounds = F.array(*map(F.lit, SYLLABLES[alphabet]))
        many = F.lit(3) + F.greatest(attempt - 2, F.lit(0))
        body = F.array_join(F.transform(F.sequence(F.lit(0), many - 1), lambda k: F.element_at(sounds, number(k) % 16 + 1)), "")
        ending = F.lit("")
        for g, e in ENDINGS[alphabet].items():
            ending = F.when(kind == f"given-{g}", e).otherwise(ending)
        return F.lower(F.concat(body, ending))

    return (
        F.when(kind == "mailbox", F.concat(like(F.substring_index(norm, "@", 1)), more))
        .when(kind == "domain", F.when(more != "", F.concat(more, F.lit("."), domain)).otherwise(domain))
        .when(kind == "phone", like(norm, F.length(F.regexp_extract(norm, CALLING, 0))))
        .when(kind == "card", F.concat(F.substring(card, F.lit(1), F.length(card) - 1), check))
        .when(kind == "ipv4", octets)
        .when(kind == "iban", _let(F.struct(country.alias("c"), account.alias("a")), lambda x: F.concat(x["c"], iban_check(x["c"], x["a"]), x["a"])))
        .when(kind == "access", like(norm, 4))
        .when(kind == "secret", F.concat(F.when(norm.rlike("^[0-9a-f]+$"), like(norm, letters="abcdef")).otherwise(like(norm)), more))
        .when(kind.isin("surname", *(f"given-{g}" for g in TITLES)), F.when(script == "cyrillic", name("cyrillic")).when(script == "greek", name("greek")).otherwise(name("latin")))
        .otherwise(like(norm))
    )


def laid_out(kind: Column, raw: Column, s: Column) -> Column:
    """The surrogates of the parts in the format of the raw entity."""
    first = F.element_at(s, 1)
    first = F.when(kind == "phone", F.regexp_replace(first, r"^\+", "")).otherwise(first)

    def flow(kept: str) -> Column:
        one = lambda c, i: F.when(c.rlike(f"[{kept}]"), F.substring(first, F.length(_only(F.substring(raw, F.lit(1), i), kept)) + 1, F.lit(1))).otherwise(c)
        return F.array_join(F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), one), "")

    return (
        F.when(kind == "email", F.concat(first, F.lit("@"), F.element_at(s, -1)))
        .when(kind == "name", F.concat(F.regexp_extract(raw, f"^(?:(?:{TITLE} )+|{INTRODUCTION} )", 0), F.array_join(F.transform(s, F.initcap), " ")))
        .when(kind.isin("phone", "card", "ssn"), flow("0-9"))
        .when(kind == "iban", flow("A-Z0-9"))
        .when(kind == "secret", F.concat(F.regexp_extract(raw, f"^{KEYWORD}", 0), first))
        .otherwise(first)
    )


def distinct_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """parts(type, norm), distinct -> type, norm, s: no two of a type alike, none a real part of its type.

    A surrogate settled in an earlier round keeps its owner; of equal ones of a round the least normal form keeps it. The others
    alone go on to the next round. What was written for the rounds is deleted once all is settled, but for the surrogates themselves."""
    real = parts.select("type", F.col("norm").alias("s"), F.lit(True).alias("real"))
    settled: DataFrame | None = None
    tried = parts
    for attempt in range(ATTEMPTS):
        made = tried.select("type", "norm", surrogate_of(F.col("type"), F.col("norm"), F.lit(attempt), key).alias("s"))
        made = materialize(made, "surrogates")
        taken = made.groupBy("type", "s").agg(F.min("norm").alias("owner"))
        judged = made.join(taken, ["type", "s"]).join(real, ["type", "s"], "left")
        bad = (F.col("owner") != F.col("norm")) | F.col("real").isNotNull() & (F.col("type") != "ipv4-block")  # its permutation keeps to the block, where real ones may be all there are
        if settled is not None:
            judged = judged.join(settled.select("type", "s", F.lit(True).alias("used")), ["type", "s"], "left")
            bad = bad | F.col("used").isNotNull()
        judged = materialize(judged.select("type", "norm", "s", bad.alias("bad")), "judged")
        good = judged.filter("NOT bad").select("type", "norm", "s")
        settled = good if settled is None else settled.unionByName(good)
        tried = judged.filter("bad").select("type", "norm")
        if tried.isEmpty():
            return settled
    raise ValueError(f"surrogates still collide after {ATTEMPTS} attempts")


def _bare(gap: Column, names: Column) -> Column:
    """struct<text, n>: the gap with the words that are names (map of normal forms) replaced, and how many runs of such words."""

    def of(w: Column) -> Column:
        new = F.initcap(names[F.lower(w)])
        return F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(new)).otherwise(new)

    def word(w: Column) -> Column:
        parts = F.split(w, "(?<=['’-])|(?=['’-])")  # a compound that is no name may hold one
        return F.coalesce(of(w), F.array_join(F.transform(parts, lambda p: F.coalesce(of(p), p)), ""))

    def whole(z: Column) -> Column:
        new = lambda x: x["w"] != x["e"]
        starts = F.filter(z, lambda x, i: new(x) & ((i == 0) | (x["g"] != " ") | ~F.coalesce(new(F.get(z, i - 1)), F.lit(False))))
        put = F.array_join(F.transform(z, lambda x: F.concat(x["g"], x["e"])), "")
        return F.struct(F.concat(put, F.element_at(F.split(gap, BARE, -1), -1)).alias("text"), F.size(starts).alias("n"))

    def sense(z: Column) -> Column:
        """Words that name a thing or a time stay."""

        def one(x: Column, i: Column) -> Column:
            before = F.when((x["g"] == " ") & (i > 0), F.concat(F.get(z, i - 1)["w"], F.lit(" "))).otherwise(x["g"])
            after = F.get(z, i + 1)
            thing = before.rlike(ARTICLE) & F.coalesce((after["g"] == " ") & (after["w"] == after["e"]), F.lit(False))
            time = F.lower(x["w"]).isin(*MONTHS) & before.rlike(TIME)
            return F.struct(x["g"].alias("g"), x["w"].alias("w"), F.when(thing | time, x["w"]).otherwise(x["e"]).alias("e"))

        return F.transform(z, one)

    def tokens(words: Column) -> Column:
        return F.arrays_zip(F.slice(F.split(gap, BARE, -1), F.lit(1), F.size(words)).alias("g"), words.alias("w"), F.transform(words, word).alias("e"))

    return _let(_let(_let(F.regexp_extract_all(gap, F.lit(BARE), F.lit(0)), tokens), sense), whole)


def pairs_of(text: Column) -> Column:
    """The distinct pairs of neighbouring capitalised words, in lower case."""
    couple = lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 2), lambda i: F.lower(F.concat(F.get(ws, i), F.lit(" "), F.get(ws, i + 1))))
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    return F.array_distinct(F.flatten(F.transform(runs, lambda r: _let(F.split(r, " "), couple))))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def replace_entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with its text column rewritten, as struct column `row`, and n_entities and kinds (sorted, comma-joined)."""
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    body = F.col("row").getField(text)
    found = F.when(F.coalesce(body.rlike(MAYBE), F.lit(False)), F.regexp_extract_all(body, F.lit(ANY), F.lit(0)))
    searched = materialize(whole.select("row", F.monotonically_increasing_id().alias("at"), F.coalesce(found, F.array().cast("array<string>")).alias("found")), "searched")
    dirty = searched.filter(F.size("found") > 0)
    met = dirty.select("at", F.posexplode("found").alias("place", "raw"))
    known = met.select("raw").distinct().withColumn("kind", kind_of(F.col("raw"))).filter("kind IS NOT NULL")
    known = materialize(known.select("raw", "kind", parts_of(F.col("kind"), F.col("raw")).alias("parts"), F.monotonically_increasing_id().alias("ent")), "entities")
    # an entity goes by its number, as a long one may have very many parts
    each = known.select("ent", F.posexplode("parts").alias("pos", "part")).select("ent", "pos", "part.type", "part.norm")
    chosen = distinct_surrogates(materialize(each.select("type", "norm").distinct(), "parts"), key)
    spelled = each.join(chosen, ["type", "norm"]).groupBy("ent").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "norm", "s"))).alias("p"))
    spelled = materialize(spelled.join(known.select("ent", "raw", "kind"), "ent"), "spelled")
    name_part = lambda x: F.struct(x["norm"].alias("norm"), (x["type"] != "surname").alias("given"), x["type"].alias("type"), x["s"].alias("s"))
    named = F.when(F.col("kind") == "name", F.transform("p", name_part))
    full = spelled.filter("kind = 'name' AND size(p) > 1").select(F.concat_ws(" ", F.element_at("p", -2)["norm"], F.element_at("p", -1)["norm"]).alias("pair"), named.alias("named"))
    mail = full.select("pair", F.struct(F.element_at("named", -2)["s"].alias("given"), F.element_at("named", -1)["s"].alias("surname")).alias("as")).groupBy("pair").agg(F.min("as").alias("as"))
    full = materialize(full.groupBy("pair").agg(F.array_distinct(F.flatten(F.collect_set("named"))).alias("named")), "full-names")
    box = F.when(F.col("kind") == "email", F.substring_index(F.element_at("p", 1)["norm"], "@", 1))
    bit = lambda k: F.regexp_extract(box, r"^([a-z]+)([._-])([a-z]+)([0-9]*)$", k)
    # only mailboxes that may spell a name are dealt by it
    spelled = spelled.withColumn("pair", F.when(bit(1) != "", F.concat_ws(" ", bit(1), bit(3))))
    spelled = spelled.filter("pair IS NOT NULL").join(mail, "pair", "left").unionByName(spelled.filter("pair IS NULL").withColumn("as", F.lit(None).cast(mail.schema["as"].dataType)))
    spelling = F.when(F.col("as").isNotNull(), F.concat(F.array(F.concat("as.given", bit(2), "as.surname", bit(4))), F.slice("p.s", 2, 1))).otherwise(F.col("p.s"))
    spelled = spelled.select("raw", "kind", laid_out(F.col("kind"), F.col("raw"), spelling).alias("new"), named.alias("named"))
    # a document gathers what stands at each place of its own, in order: digits that are no card stay themselves
    own = met.join(spelled, "raw", "left").withColumn("new", F.coalesce("new", "raw")).groupBy("at")
    own = own.agg(
        F.array_sort(F.collect_list(F.struct("place", "new"))).alias("put"),
        F.collect_set("kind").alias("kinds"),
        F.array_distinct(F.flatten(F.collect_list("named"))).alias("named"),
        F.count("kind").alias("n_found"),
    )
    # and the names that are known from any document
    told = searched.select("at", F.explode(pairs_of(body)).alias("pair")).join(full, "pair").groupBy("at").agg(F.array_distinct(F.flatten(F.collect_set("named"))).alias("told"))
    told = materialize(told, "told")
    clean = searched.filter(F.size("found") == 0).join(told.select("at"), "at", "left_anti").select("row", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    own = own.join(told, "at", "full")
    none = F.array()
    own = own.select(
        "at",
        F.coalesce("put", none).alias("put"),
        F.array_join(F.array_sort(F.array_union(F.coalesce("kinds", none), F.when(F.col("told").isNotNull(), F.array(F.lit("name"))).otherwise(none))), ",").alias("kinds"),
        F.array_sort(F.array_union(F.coalesce("named", none), F.coalesce("told", none))).alias("named"),
        F.coalesce("n_found", F.lit(0)).alias("n_found"),
    )
    # a word that is both a surname and a given name in a document is taken for the surname
    first = F.filter("named", lambda x, i: (i == 0) | (x["norm"] != F.get("named", i - 1)["norm"]))
    names = F.map_from_entries(F.transform(first, lambda x: F.struct(x["norm"], x["s"])))
    hit = dirty.unionByName(searched.filter(F.size("found") == 0).join(told.select("at"), "at", "left_semi"))
    both = hit.join(own.withColumn("names", names), "at")
    both = both.withColumn("gaps", F.split(body, ANY, -1))
    plain = F.transform("gaps", lambda g: F.struct(g.alias("text"), F.lit(0).alias("n")))
    both = both.withColumn("gaps", F.when(F.size("names") > 0, F.transform("gaps", lambda g: _bare(g, F.col("names")))).otherwise(plain))
    couples = F.arrays_zip(F.slice("gaps.text", 1, F.size("found")).alias("g"), F.transform("put", lambda x: x["new"]).alias("e"))
    rebuilt = F.concat(F.array_join(F.transform(couples, lambda z: F.concat(z["g"], z["e"])), ""), F.element_at("gaps.text", -1))
    changed = both.withColumn("rebuilt", F.when(F.col("kinds") == "", body).otherwise(rebuilt))
    n = (F.col("n_found") + F.aggregate("gaps.n", F.lit(0), lambda a, x: a + x)).cast("long")
    fields = [(F.col("rebuilt") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    changed = changed.select(F.struct(*fields).alias("row"), n.alias("n_entities"), "kinds")
    return clean.unionByName(changed)


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, surrogate_key(spark, QUERY_KEY)).select("row.doc_id", "row.text", "n_entities", "kinds")
