"""Surrogates for personal data, in DataFrame functions only.

Every detected entity is replaced by an invented one of its type, drawn with a
key: the same entity always gets the same surrogate (coreference), different
entities get different ones (distinctness), and format, script and gender stay.

Numbers go through a keyed permutation of their digits (four Feistel rounds on
the two halves), so distinctness holds by construction: punctuation, length and
leading marks stay, card numbers stay valid. Host addresses go as two halves of
32 bits through the same. Mail addresses are drawn from a hash. Names go word by
word: each word has one drawn stem, whichever title or place it stands with; a
surname has one ending, a given name the ending of its gender, which the titles
of the document tell. In a document, words of its titled names are replaced
where they stand without a title, too.

A check over all distinct units of the corpus (entities, and words of names)
finds surrogates that two units share, or that are themselves a unit of the
corpus; the units concerned, and only they, are drawn again with the next
attempt number. Where a shape of numbers is dense, that is, more than one of ten
possible numbers is in the corpus, any surrogate is likely somebody's number:
there the permutation alone holds, and nothing is drawn again. Elsewhere a draw
fails with a chance well below one half (names grow longer with each attempt),
so few rounds end it.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldscope.session import checkpoint_dir

from .secrets import _let

# A word that may be a name; a possessive 's is not part of it.
WORD = r"\p{Lu}(?=[\p{L}'-])\p{L}*(?:['-]\p{L}{2,})*"
# Fixed patterns, tried in this order at each place.
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?\b"),
    ("ip", r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9.]*[0-9])"),
    ("card", r"(?<![0-9A-Za-z])[0-9](?:[\x20-]?[0-9]){12,17}(?![0-9A-Za-z])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    # with a country code, an area code in brackets, a leading 0, or in the two usual forms without any; seven digits at least
    ("phone", r"(?<![0-9A-Za-z])(?=(?:[+\x20.()-]{0,3}[0-9]){7})(?:\+[0-9]{1,3}(?:[\x20.-]?\([0-9]{1,5}\))?(?:[\x20.-]?[0-9]{2,5}){1,4}|\([0-9]{1,5}\)[\x20.-]?[0-9]{2,5}(?:[\x20.-][0-9]{2,5}){0,3}|0[0-9]{1,4}(?:[\x20./-][0-9]{2,5}){1,4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}|[2-9][0-9]{2}-[0-9]{4})(?![0-9A-Za-z])"),
    ("name", r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señor|Señora|Господин|Госпожа|Κύριος|Κυρία)\.?\x20" + rf"{WORD}(?:\x20{WORD})?"),
)
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
GATE = r"@|[0-9][0-9.\x20()+-]*[0-9]|(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Mme|Mlle|Monsieur|Madame|Sr|Sra|Señora?|Господин|Госпожа|Κύριος|Κυρία)\.?\x20"
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Mme|Mlle|Madame|Sra|Señora|Госпожа|Κυρία)\b"
MALE = r"^(?:Mr|Herr|Monsieur|Sr|Señor|Господин|Κύριος)\b"
SYLLABLES = {
    "latin": "ba be bi bo da de do fa fe fi ga ge go ha he ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi wa we za".split(),
    "cyrillic": "ба бе би да де до ва ве ви га ге ка ке ко ла ле ли ма ме ми на не ни па пе ра ре ри са се та те ти".split(),
    "greek": "βα βε γα γε δα δε ζα κα κε κο λα λε λι μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε".split(),
}
ENDINGS = {"latin": ("a", "n", "l"), "cyrillic": ("а", "н", "л"), "greek": ("α", "ς", "λ")}  # female, male, surname
WORD_PLACES = rf"(?<![\p{{L}}'-]){WORD}"
DENSE = 0.1  # share of a shape's numbers in the corpus from which on the permutation alone holds


def _number(key: str, *parts) -> Column:
    """A keyed number of 52 bits."""
    return F.conv(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256), F.lit(1), F.lit(13)), 16, 10).cast("long")


def permuted_digits(digits: Column, key: str, tag: Column) -> Column:
    """A keyed permutation of the digit strings of each length up to 18."""
    cut = (F.length(digits) / 2).cast("int")
    state = F.struct(F.substr(digits, F.lit(1), cut).alias("l"), F.substr(digits, cut + 1).alias("r"))

    def turn(half: Column, other: Column, i: int) -> Column:
        size = F.length(half)
        modulus = F.pow(F.lit(10), size).cast("long")
        moved = F.pmod(F.coalesce(half.try_cast("long"), F.lit(0)) + F.pmod(_number(key, "digits", i, tag, size.cast("string"), other), modulus), modulus)
        return F.when(size > 0, F.lpad(moved.cast("string"), size, "0")).otherwise(half)

    def round_(i: int):
        if i % 2 == 0:
            return lambda s: F.struct(turn(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), turn(s["r"], s["l"], i).alias("r"))

    for i in range(4):
        state = _let(state, round_(i))
    return _let(state, lambda s: F.concat(s["l"], s["r"]))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced one after the other by ``digits``."""
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    step = lambda acc, c: F.when(c.rlike("[0-9]"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["t"], F.substr(digits, acc["i"], F.lit(1))).alias("t"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["t"], c).alias("t")))
    return F.aggregate(chars, F.struct(F.lit(1).alias("i"), F.lit("").alias("t")), step)["t"]


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a payload, whose check digit would follow."""
    values = F.transform(F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")), lambda c, i: F.when(i % 2 == 0, F.floor(c.cast("int") * 2 / 10) + c.cast("int") * 2 % 10).otherwise(c.cast("int")).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _word(key: str, script: str, size: Column | int, *parts) -> Column:
    pool = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    last = size - 1 if isinstance(size, Column) else F.lit(size - 1)
    one = lambda i: F.element_at(pool, (F.pmod(_number(key, "syllable", i.cast("string"), *parts), F.lit(len(SYLLABLES[script]))) + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), last), one), "")


def _by_script(word: Column, of) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of("cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("greek")).otherwise(of("latin"))


def stem(word: Column, attempt: Column, key: str) -> Column:
    """The drawn stem of a name's word, in lower case and in its script."""
    return _by_script(word, lambda script: _word(key, script, attempt + 4, attempt.cast("string"), word))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of one unit: an entity, or the stem for a word of a name."""
    tag = F.concat(kind, F.lit(":"), attempt.cast("string"))
    digits = F.regexp_replace(entity, "[^0-9]", "")

    def numeric(d: Column) -> Column:
        return _refilled(entity, permuted_digits(d, key, tag))

    def card(d: Column) -> Column:
        payload = F.substr(d, F.lit(1), F.length(d) - 1)
        check = lambda p: F.pmod(10 - F.pmod(_luhn_sum(p), F.lit(10)), F.lit(10)).cast("string")
        valid = check(payload) == F.substr(d, F.length(d), F.lit(1))
        drawn = _let(permuted_digits(payload, key, tag), lambda p: F.concat(p, check(p)))
        return F.when(valid, _refilled(entity, drawn)).otherwise(numeric(d))

    def address(e: Column) -> Column:
        # the four bytes as one number of 32 bits, through Feistel rounds on its halves
        part = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))
        state = _let(part, lambda p: F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r")))
        for i in range(4):
            state = _let(state, (lambda i: lambda s: F.struct(s["r"].alias("l"), F.pmod(s["l"] + _number(key, "ip", i, tag, s["r"].cast("string")), F.lit(65536)).alias("r")))(i))
        return _let(state, lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))

    folded = F.lower(entity)
    mail = F.concat(_word(key, "latin", 4, tag, folded), F.lit("."), F.lpad(F.pmod(_number(key, "mail", tag, folded), F.lit(100_000_000)).cast("string"), 8, "0"), F.lit("@"), F.lit("example."),
                    F.element_at(F.split(folded, r"\."), -1))
    letters = F.translate(F.substr(F.sha2(F.concat_ws("\x1f", F.lit(key), tag, F.translate(entity, " ", "")), 256), F.lit(1), F.lit(40)), "0123456789abcdef", "ABCDEFGHJKLMNPQR")
    bank = F.concat(F.substr(entity, F.lit(1), F.lit(2)), _refilled_letters(F.substr(entity, F.lit(3)), digits, letters, key, tag))

    return (F.when(kind == "email", mail).when(kind == "ip", address(entity)).when(kind == "card", card(digits)).when(kind.isin("ssn", "phone"), numeric(digits))
            .when(kind == "iban", bank).otherwise(stem(entity, attempt, key)))


def _refilled_letters(shape: Column, digits: Column, letters: Column, key: str, tag: Column) -> Column:
    drawn = F.lpad(_number(key, "iban", tag, F.translate(shape, " ", "")).cast("string"), 34, "7")
    chars = F.filter(F.split(shape, ""), lambda c: c != "")
    pick = lambda c, i: F.when(c.rlike("[0-9]"), F.substr(F.reverse(drawn), i + 1, F.lit(1))).when(c.rlike("[A-Z]"), F.substr(letters, i + 1, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(chars, pick), "")


def _kind(entity: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, p in PATTERNS[:-1]:
        # lookarounds see the entity alone, as its neighbours were tested when it was found
        out = out.when(entity.rlike(f"^(?:{p})$"), F.lit(k))
    return out.otherwise(F.lit("name"))


def _entities(text: Column) -> Column:
    none = F.expr("cast(array() AS array<string>)")
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


def _names(entities: Column) -> Column:
    """Array of (word in lower case, role) of the names among a text's entities:
    role 0 and 1 for a given name of a woman and a man, 2 for a surname, 3 for a
    given name whose title tells no gender."""
    none = F.expr("cast(array() AS array<struct<word: string, role: int>>)")

    def words(e: Column) -> Column:
        role = F.when(e.rlike(FEMALE), 0).when(e.rlike(MALE), 1).otherwise(3)
        parts = F.filter(F.split(F.substr(e, F.length(F.regexp_extract(e, r"^(\S+\x20)", 1)) + 1), r"\x20"), lambda w: w != "")
        return F.transform(parts, lambda w, i: F.struct(F.lower(w).alias("word"), F.when(i == F.size(parts) - 1, 2).otherwise(role).alias("role")))

    titled = F.filter(entities, lambda e: _kind(e) == "name")
    return F.when(F.size(titled) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(titled, words))))).otherwise(none)


def units(entities: Column) -> Column:
    """The units of a text's entities: entities other than names, words of names."""
    return F.array_union(F.filter(entities, lambda e: _kind(e) != "name"), F.transform(_names(entities), lambda x: x["word"]))


def redrawn(docs: DataFrame, key: str) -> DataFrame | None:
    """(unit, attempt) of the units that the collision check draws again; None
    if there are none. The smallest unit of a collision keeps its own."""
    checkpoint_dir(docs.sparkSession)  # sets one of its own where a local session has none
    each = docs.select(F.explode(units(_entities(F.coalesce(F.col("text"), F.lit(""))))).alias("unit"))
    known = each.groupBy("unit").agg(F.count("*").alias("n")).select("unit", _kind(F.col("unit")).alias("kind"))
    # the corpus is read for it once; kept in the folder that the cluster names
    known = known.withColumn("shape", F.when(F.col("kind") == "ip", F.lit("ip")).otherwise(F.regexp_replace("unit", "[0-9]", "9"))).checkpoint()
    space = F.when(F.col("shape") == "ip", F.lit(2.0**32)).otherwise(F.pow(F.lit(10.0), F.length(F.regexp_replace("shape", "[^9]", ""))))
    dense = known.filter(F.col("kind").isin("ip", "card", "ssn", "phone")).groupBy("shape").agg(F.count("*").alias("n")).filter(F.col("n") > space * DENSE).select("shape")
    is_name = F.col("kind") == "name"
    # a stem is taken where some word is that stem and one more letter
    taken = known.select(F.when(is_name, F.expr("left(unit, length(unit) - 1)")).otherwise(F.col("unit")).alias("s")).distinct()
    moved = None
    for attempt in count(1):
        now = known.withColumn("attempt", F.lit(0)) if moved is None else known.join(moved.withColumnRenamed("attempt", "again"), "unit", "left").select("unit", "kind", "shape", F.coalesce("again", F.lit(0)).alias("attempt"))
        drawn = now.withColumn("s", surrogate(F.col("kind"), F.col("unit"), F.col("attempt"), key))
        drawn = drawn.withColumn("same", F.lower("unit"))  # ways of writing one entity share its surrogate
        shared = drawn.groupBy("s").agg(F.min("same").alias("first"), F.max("same").alias("last")).filter("first <> last").select("s", "first")
        losers = drawn.join(shared, "s").filter("same <> first").select("unit", "shape")
        real = drawn.join(taken, "s", "left_semi").select("unit", "shape")
        again = losers.unionByName(real).join(dense, "shape", "left_anti").select("unit").distinct().withColumn("attempt", F.lit(attempt))
        again = again.checkpoint()
        if again.isEmpty():
            return moved
        moved = again if moved is None else moved.join(again.select("unit"), "unit", "left_anti").unionByName(again)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; all columns kept, and
    ``n_entities`` added (a column of that name is replaced): the entities that
    the patterns find, untitled mentions of names not counted.

    Null and empty texts and texts without entities stay as they are, and an
    empty table gives an empty one. Very long texts are read whole, in one row.
    Rows do not depend on their id, so repeated rows and null ids are safe, and
    no helper column can clash with a given one.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    again = redrawn(docs.select("text"), key)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")).select("row", _entities(text).alias("found"))
    given = given.withColumn("names", _names(F.col("found")))
    if again is None:
        attempt_of = lambda unit: F.lit(0)
    else:
        # units drawn again meet their documents by a join on the unit, then on the row
        marked = given.withColumn("h", F.sha2(F.col("row").cast("string"), 256))
        hits = marked.select("h", F.explode(units(F.col("found"))).alias("unit")).distinct().join(again, "unit").groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("unit", "attempt"))).alias("m"))
        given = marked.join(hits, "h", "left")
        attempt_of = lambda unit: F.coalesce(F.try_element_at(F.col("m"), unit), F.lit(0))

    def name_word(word: Column) -> Column:
        """The surrogate of a word that is known as a name in its document."""
        low = F.lower(word)
        roles = F.transform(F.filter("names", lambda x: x["word"] == low), lambda x: x["role"])

        def ending(script: str) -> Column:
            female, male, surname = (F.lit(e) for e in ENDINGS[script])
            # a surname first; then as a title tells; else as the name ends itself
            return F.when(F.array_contains(roles, 2), surname).when(F.array_contains(roles, 0) | (~F.array_contains(roles, 1) & low.rlike("[aаяαη]$")), female).otherwise(male)

        drawn = F.initcap(F.concat(stem(low, attempt_of(low), key), _by_script(low, ending)))
        return F.when(F.size(roles) > 0, drawn).otherwise(word)

    def words_replaced(part: Column) -> Column:
        return F.array_join(F.flatten(F.zip_with(F.split(part, WORD_PLACES, -1), F.regexp_extract_all(part, F.lit(WORD_PLACES), F.lit(0)),
                                                 lambda gap, w: F.array(F.coalesce(gap, F.lit("")), F.when(w.isNull(), "").otherwise(name_word(w))))), "")

    def one(e: Column) -> Column:
        title = F.regexp_extract(e, r"^(\S+\x20)", 1)
        name = lambda e: F.concat(title, F.array_join(F.transform(F.split(F.substr(e, F.length(title) + 1), r"\x20"), name_word), " "))
        return _let(F.struct(e.alias("e"), _kind(e).alias("k")), lambda x: F.when(x["k"] == "name", name(x["e"])).otherwise(surrogate(x["k"], x["e"], attempt_of(x["e"]), key)))

    between = F.split(text, ANY, -1)
    between = F.when(F.size("names") > 0, F.transform(between, words_replaced)).otherwise(between)
    put = F.array_join(F.flatten(F.zip_with(between, F.transform("found", one), lambda gap, s: F.array(F.coalesce(gap, F.lit("")), F.coalesce(s, F.lit(""))))), "")
    done = F.when(F.size("found") > 0, put).otherwise(F.col("row.text"))
    return given.select(*[done.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], F.size("found").alias("n_entities"))
