"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

1. One pattern finds all mentions: mail addresses, phone numbers, payment cards (only with a
   valid check digit), IPv4 addresses, social security numbers, access keys, hexadecimal
   secrets, passwords after ``password=`` and names after a form of address.
2. A mention's canonical form (digits of a number, lower case of the rest) names the entity,
   so every mention of an entity, in any document and spelling, gets the same surrogate.
3. A surrogate is drawn character by character from a keyed hash of type and canonical form:
   digits stay digits, letters stay letters of the same script, punctuation stays; cards keep
   a valid check digit, octets stay octets, names keep the gender of their form of address.
4. Collision check over all entities of the corpus: a surrogate that two entities share, or
   that is itself an entity of the corpus, is drawn again until none is left; where a form
   has no free surrogate left, a longer one in keyed letters takes its place.
5. Surrogates return to the texts in each mention's own format and case.

Only DataFrame functions are used; texts are shuffled only where they hold an entity, and
mentions are gathered per distinct text, so copies cost one row.

Null texts stay null, ids are not looked at, repeated rows stay repeated, all other columns
are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelweir.llm.common import cut

# Forms of address with the gender that they tell.
FEMALE = ("Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "Госпожа")
MALE = ("Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "Господин")

# Syllables of surrogate names, by script; the last ones by gender.
SYLLABLES = {"latin": ("ba", "den", "fi", "gar", "hol", "ka", "lum", "mi", "nor", "pel", "ra", "sto", "ti", "vel", "wes", "zan"), "cyrillic": ("ба", "ден", "фи", "гар", "хол", "ка", "лум", "ми", "нор", "пел", "ра", "сто", "ти", "вел", "вес", "зан")}
ENDINGS = {("latin", "f"): ("a", "ia", "ine", "elle"), ("latin", "m"): ("o", "us", "ert", "ald"), ("cyrillic", "f"): ("а", "ия", "ина", "ова"), ("cyrillic", "m"): ("он", "ий", "ин", "ов")}

PARTS = {
    "mail": r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[a-f]*\d)[0-9a-f]{40}(?![0-9A-Za-z])",
    "access": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "password": r"(?<=password=)[^\s\"']+",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w-])",
    "social": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])",
    "name": r"(?<!\p{L})(?:" + "|".join(t.replace(".", r"\.") for t in FEMALE + MALE) + r") \p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+)?",
}
#: One alternative per type; ``card`` refers to its own separator, so its group is renumbered.
PATTERN = "|".join(PARTS[k].replace(r"\1", r"\k<gap>").replace("([ -]?)", "(?<gap>[ -]?)") for k in PARTS)
#: Every mention has a digit or one of these; texts without them are not searched.
HINTS = ("@", "password=", "AKIA", *sorted({t[:2] if t[:2] in ("Mr", "Ms") else t.rstrip("a") for t in FEMALE + MALE}))

#: After so many draws surrogates get longer than their form.
MAX_DRAWS = 40


def hinted(text: Column) -> Column:
    found = text.rlike("[0-9]")
    for word in HINTS:
        found = found | text.contains(word)
    return found


def mentions(text: Column) -> Column:
    return F.when(hinted(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def kind_of(mention: Column) -> Column:
    """The type of a mention, by what only that type's form has; a card with a wrong check digit has none."""
    digits = F.regexp_replace(mention, r"\D", "")
    kind = F.when(mention.rlike("^[^ ]+@"), "mail").when(mention.rlike(r"^AKIA[0-9A-Z]{16}$"), "access").when(mention.rlike(r"^[0-9a-f]{40}$"), "secret")
    kind = kind.when(mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "address").when(mention.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
    kind = kind.when(mention.rlike(r"^\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}$"), F.when(F.call_function("luhn_check", digits), "card").otherwise("none"))
    kind = kind.when(mention.rlike(r"^(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), "phone")
    title = F.split_part(mention, F.lit(" "), F.lit(1))
    kind = kind.when(title.isin(*FEMALE), "name_f").when(title.isin(*MALE), "name_m")
    return kind.otherwise("password")


def canonical(mention: Column, kind: Column) -> Column:
    """What all mentions of an entity have in common; phone numbers by their last ten digits."""
    digits = F.regexp_replace(mention, r"\D", "")
    name = F.lower(F.regexp_replace(mention, r"^\S+ ", ""))
    plain = F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "social"), digits)
    return plain.when(kind == "mail", F.lower(mention)).when(kind.isin("name_f", "name_m"), name).otherwise(mention)


def drawn(seed: Column, place: Column, choices: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(choices)).cast("int")


def mapped(text: Column, seed: Column, lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """``text`` with each digit, small and capital Latin letter replaced by a drawn one of its sort."""
    upper = lower.upper()
    pick = lambda letters, i: F.substring(F.lit(letters), drawn(seed, i, len(letters)) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        return F.when(c.rlike("[0-9]"), pick("0123456789", i)).when(c.rlike("[a-z]"), pick(lower, i)).when(c.rlike("[A-Z]"), pick(upper, i)).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def letters_of(seed: Column, length: Column, choices: list[str]) -> Column:
    """``length`` drawn letters or syllables."""
    every = F.array(*[F.lit(c) for c in choices])
    return F.array_join(F.transform(F.sequence(F.lit(1), length), lambda i: F.element_at(every, drawn(seed, i + 1000, len(choices)) + 1)), "")


def check_digit(first: Column) -> Column:
    """The last digit that makes ``first`` with it pass the check of payment cards."""
    numbers = F.reverse(F.split(first, ""))
    worth = lambda c, i: F.when(i % 2 == 0, F.element_at(F.array(*[F.lit(2 * d - 9 * (d > 4)) for d in range(10)]), c.cast("int") + 1)).otherwise(c.cast("int"))
    return F.pmod(10 - F.aggregate(F.transform(numbers, worth), F.lit(0), lambda a, b: a + b), F.lit(10)).cast("string")


def new_name(form: Column, seed: Column, gender: str, draw: Column) -> Column:
    """As many words as the name has, in its script, each with an ending of the gender; more syllables from ``MAX_DRAWS`` draws on."""

    def word(script: str, place: Column) -> Column:
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        endings = F.array(*[F.lit(s) for s in ENDINGS[script, gender]])
        own = F.concat(seed, place.cast("string"))
        stem = F.concat(*[F.element_at(syllables, drawn(own, F.lit(k), len(SYLLABLES[script])) + 1) for k in range(3)])
        more = letters_of(own, F.greatest(draw - MAX_DRAWS, F.lit(0)) + 2, list(SYLLABLES[script]))
        stem = F.concat(stem, F.when(draw >= MAX_DRAWS, more).otherwise(""))
        return F.concat(stem, F.element_at(endings, drawn(own, F.lit(9), len(ENDINGS[script, gender])) + 1))

    one = lambda w, i: F.when(w.rlike(r"^[ -]$"), w).when(w.rlike(r"\p{IsCyrillic}"), word("cyrillic", i)).otherwise(word("latin", i))
    return F.array_join(F.transform(F.regexp_extract_all(form, F.lit(r"[ -]|[^ -]+"), F.lit(0)), one), "")


def surrogate(kind: Column, form: Column, draw: Column, key: str) -> Column:
    """The surrogate of an entity at a given draw."""
    seed = F.sha2(F.concat_ws("\x00", F.lit(key), kind, form, draw.cast("string")), 256)
    body = mapped(form, seed)
    octets = F.transform(F.split(form, r"\."), lambda _, i: (drawn(seed, i, 254) + 1).cast("string"))
    at = F.split(form, "@")
    ending = F.regexp_extract(form, r"\.[^.]*$", 0)
    host = F.substr(at[1], F.lit(1), F.char_length(at[1]) - F.char_length(ending))
    first = F.concat(F.left(form, F.lit(1)), F.substr(body, F.lit(2), F.char_length(form) - 2))
    lead = F.concat((drawn(seed, F.lit(-1), 8) + 2).cast("string"), F.substring(body, 2, 100))
    made = F.when(kind == "mail", F.concat(mapped(at[0], seed), F.lit("@"), mapped(host, F.concat(F.lit("host"), seed)), ending))
    made = made.when(kind == "address", F.array_join(octets, ".")).when(kind == "card", F.concat(first, check_digit(first)))
    made = made.when(kind == "phone", lead).when(kind == "secret", mapped(form, seed, "abcdef"))
    made = made.when(kind == "access", F.concat(F.lit("AKIA"), F.substring(body, 5, 100)))
    made = made.when(kind == "name_f", new_name(form, seed, "f", draw)).when(kind == "name_m", new_name(form, seed, "m", draw))
    letters = lambda tag: letters_of(F.concat(F.lit(tag), seed), F.greatest(draw - MAX_DRAWS, F.lit(0)) + 12, list("abcdefghijklmnopqrstuvwxyz"))
    longer = F.when(kind == "mail", F.concat(letters("at"), F.lit("@"), letters("host"), ending)).otherwise(letters(""))
    return F.when((draw >= MAX_DRAWS) & ~kind.isin("name_f", "name_m"), longer).otherwise(made.otherwise(body))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, form, surrogate) for distinct entities (kind, form): no two alike, none an entity itself.

    Every round draws anew for the entities that clash; of those that share a surrogate the
    smallest form keeps it. What has no free surrogate of its own form after ``MAX_DRAWS``
    rounds gets a longer one in small keyed letters (names: with more syllables, addresses of
    mails: before and after the @), one more with every round, so each entity gets one.
    Passwords without a Latin letter or digit, which no draw would change, begin there.
    """
    made = lambda rows: rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), F.col("draw"), key))
    fixed = (F.col("kind") == "password") & ~F.col("form").rlike("[0-9A-Za-z]")
    at = cut(made(entities.select("kind", "form", F.when(fixed, MAX_DRAWS).otherwise(0).alias("draw"))))
    real = entities.select("kind", F.col("form").alias("surrogate"), F.lit(True).alias("real")).distinct()
    while True:
        holders = at.groupBy("kind", "surrogate").agg(F.min("form").alias("holder"), F.count("*").alias("n"))
        bad = holders.join(real, ["kind", "surrogate"], "left").filter("n > 1 or real").select("kind", "surrogate", "holder", "real")
        bad = cut(bad)
        if bad.isEmpty():
            return at.select("kind", "form", "surrogate")
        marked = at.join(bad, ["kind", "surrogate"], "left")
        again = F.col("holder").isNotNull() & (F.coalesce("real", F.lit(False)) | (F.col("form") != F.col("holder")))
        at = cut(made(marked.select("kind", "form", F.when(again, F.col("draw") + 1).otherwise(F.col("draw")).alias("draw"))))


def in_format(mention: Column, kind: Column, new: Column) -> Column:
    """The surrogate in a mention's own format: separators, prefix, case and form of address stay."""
    figures = F.split(new, "")
    spare = F.char_length(F.regexp_replace(mention, r"\D", "")) - F.char_length(new)

    def fill(state: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        put = F.when(digit & (state["seen"] >= spare), F.get(figures, state["seen"] - spare)).otherwise(c)
        return F.struct(F.concat(state["text"], put).alias("text"), (state["seen"] + digit.cast("int")).alias("seen"))

    filled = F.aggregate(F.split(mention, ""), F.struct(F.lit("").alias("text"), F.lit(0).alias("seen")), fill)["text"]
    letters = F.split(mention, "")
    cased = F.array_join(F.transform(figures, lambda c, i: F.when(F.get(letters, i).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    title = F.regexp_extract(mention, r"^\S+ ", 0)
    bare = F.regexp_replace(mention, r"^\S+ ", "")
    name = F.concat(title, F.when(bare == F.upper(bare), F.upper(new)).otherwise(F.initcap(F.regexp_replace(new, "-", "- "))))
    name = F.regexp_replace(name, "- ", "-")
    shown = F.when(kind.isin("phone", "card", "social") & new.rlike("^[0-9]+$"), filled).when(kind == "mail", cased).when(kind.isin("name_f", "name_m"), name)
    return shown.otherwise(new)


def text_key(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def pseudonymized(docs: DataFrame, key: str = "corpus-key", text_column: str = "text") -> DataFrame:
    """The input's rows and columns with surrogates in the text, and as last column ``pii_entities``.

    ``pii_entities``: array of (kind, found, surrogate) of the text's mentions in order. If
    the input has a column of that name, it is replaced. ``key`` is the secret of the hash.
    """
    kept = [c for c in docs.columns if c != "pii_entities"]
    own = docs.select(*kept)
    text = F.col(text_column)
    found = own.select(text.alias("t")).withColumn("found", mentions(F.col("t"))).filter(F.size("found") > 0)
    k1, k2 = text_key(F.col("t"))
    texts = found.select(k1.alias("k1"), k2.alias("k2"), "found").groupBy("k1", "k2").agg(F.first("found").alias("found"))
    each = texts.select("k1", "k2", F.posexplode("found").alias("place", "mention")).withColumn("kind", kind_of(F.col("mention")))
    each = cut(each.withColumn("form", canonical(F.col("mention"), F.col("kind"))))
    entities = cut(each.filter("kind <> 'none'").select("kind", "form").distinct())
    named = surrogates(entities, key)
    one = F.struct("place", "kind", F.col("mention").alias("found"), F.when(F.col("surrogate").isNull(), F.col("mention")).otherwise(in_format(F.col("mention"), F.col("kind"), F.col("surrogate"))).alias("surrogate"))
    ready = cut(each.join(named, ["kind", "form"], "left").select("k1", "k2", one.alias("one")).groupBy("k1", "k2").agg(F.array_sort(F.collect_list("one")).alias("all")))
    empty = F.array().cast("array<struct<kind:string,found:string,surrogate:string>>")
    has = F.coalesce(hinted(text) & text.rlike(PATTERN), F.lit(False))
    clean = own.filter(~has).withColumn("pii_entities", empty)
    a, b = text_key(text)
    dirty = own.filter(has)
    names = {c: f"__c{i}" for i, c in enumerate(kept)}  # no name of the input can clash with those of the join
    plain = dirty.select(*[F.col(c).alias(n) for c, n in names.items()], a.alias("k1"), b.alias("k2")).join(ready, ["k1", "k2"])
    between = F.split(F.col(names[text_column]), PATTERN, -1)
    new = F.concat(between[0], F.array_join(F.transform("all", lambda m, i: F.concat(m["surrogate"], F.get(between, i + 1))), ""))
    listed = F.transform(F.filter("all", lambda m: m["kind"] != "none"), lambda m: F.struct(m["kind"].alias("kind"), m["found"].alias("found"), m["surrogate"].alias("surrogate")))
    done = plain.select(*[(new if c == text_column else F.col(n)).alias(c) for c, n in names.items()], listed.alias("pii_entities"))
    return clean.union(done)
