"""Personal data replaced by keyed surrogates, in DataFrame functions throughout.

Mentions are found by one pattern. Each is made of parts that identify somebody or something (an e-mail
address: the address and its domain; a name: its words; a number: its digits), and every distinct part of
the corpus gets a surrogate from a keyed digest: same type, same script and gender for name words, same
character classes, same issuer digit and valid check digit for cards. Surrogates that meet each other, or a
value that really occurs, are drawn again until none do, so distinct parts stay distinct; equal parts share
their surrogate wherever they stand, however the mention is punctuated. Names that a document gives a title
are found in it without one, too; there, and after a title without gender, they are of the gender that the
document's other titles give the same name (neutral where those differ).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import computed
from .common import discard, salted_join, stored, unused

#: Titles that introduce a name, by gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа"], "n": ["Dr", "Prof"]}
_TITLE = "(?:" + "|".join(sorted((t for ts in TITLES.values() for t in ts), key=lambda t: (-len(t), t))) + r")\.?"
_WORD = r"\p{Lu}[\p{L}’'-]+"
#: Words that name a secret, in any case; a prefix may end in _ or -.
_SECRET = r"(?i:token|password|passwd|secret|api[_-]{0,1}key)[\"']{0,1} {0,1}[=:]"
_NATIONAL = r"(?:(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\(0\d{1,4}\) ?\d{3,8}|0\d{2,4}[ /-]\d{5,8}|0\d(?:[ .-]\d{2}){4})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DATE = r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}(?!\d)"
_BORN = r"(?i:born|dob|date of birth|birth date|birthday|geboren|née{0,1})(?:[: ]| on | am |: )"
_ACCOUNT = r"(?i:account|acct|konto)(?: (?i:no|number|nr)){0,1}[.]{0,1}[:#]{0,1} {0,1}"
_LABEL = r"[A-Za-z0-9-]++"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Each begins with what is cheap to refuse: most places of a text hold none of them. Whatever may repeat without end
#: is a class of characters or possessive, since a group that may be given back costs a stack frame for each
#: repetition; the part of an address before its @ has 256 characters at most, so that no start reads on for ever.
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{{0,255}}+@{_LABEL}(?:(?:\.{_LABEL})*+(?<=\.[A-Za-z]{{2,63}})|(?:\.{_LABEL}){{0,126}}\.[A-Za-z]{{2,}})",
    "birth": rf"(?=\d)(?<=[ :])(?<=(?<!\p{{L}}){_BORN}){_DATE}",
    "account": rf"(?=\d)(?<=[ .:#])(?<=(?<!\p{{L}}){_ACCOUNT})\d{{6,17}}(?!\d)",
    "ip": rf"(?=\d)(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "ip6": rf"(?=[0-9A-Fa-f])(?<![\p{{L}}\d:.])(?=[0-9A-Fa-f:]{{0,39}}\d)(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\d:])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)" rf"|(?=[(\d])(?<![\p{{L}}\d])(?<!\d[.-]){_NATIONAL}(?![\p{{L}}\d_]|-[\p{{L}}\d]|\.\d)",
    "key": r"(?=A)\bAKIA[A-Z0-9]{16}\b",
    "iban": r"(?=[A-Z]{2}\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?=\d)(?<!\d)\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "address": r"(?=\d)(?<![\d.])\d{1,5}[a-z]? (?:\p{Lu}[\p{L}’'-]+ ){1,3}(?:Street|St\b|Avenue|Ave\b|Road|Rd\b|Lane|Drive|Boulevard|Blvd\b)",
    "name": rf"(?=[MHSFDPГ])(?<!\p{{L}}){_TITLE} {_WORD}(?: {_WORD})?",
    "secret": rf"(?<=[=: \"'])(?<=[=:] {{0,1}}[\"']{{0,1}})(?<=(?<![\p{{L}}\d]){_SECRET} {{0,1}}[\"']{{0,1}})[A-Za-z0-9+/_-]{{8,}}",
}
#: What a mention by itself is told by, where its pattern looks at what stands before.
_ALONE = PATTERNS | {"birth": _DATE, "account": r"\d{6,17}"}
_ORDER = ["email", "ip", "ip6", "ssn", "phone", "key", "iban", "card", "birth", "account", "address", "name"]
#: What may end a name word without being part of it.
_TAIL = r"(?:['’]s|['’-]+)$"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text must show to hold a mention at all; cheaper than the pattern.
HINT = rf"(?=[0-9@=:MHSFDPГ])(?:[0-9@]|[=:](?<={_SECRET})|(?<!\p{{L}}){_TITLE} \p{{Lu}})"
_SYLLABLES = {"latin": ["ba", "de", "fi", "go", "lu", "ma", "ne", "ri", "so", "tu", "va", "ke", "li", "mo", "ra", "si"], "cyrillic": ["ба", "де", "фи", "го", "лу", "ма", "не", "ри", "со", "ту", "ва", "ке", "ли", "мо", "ра", "си"]}
_ENDS = {("latin", "m"): "rn", ("latin", "f"): "na", ("latin", "n"): "s", ("cyrillic", "m"): "нов", ("cyrillic", "f"): "нова", ("cyrillic", "n"): "ко"}


def _kind(mention: Column) -> Column:
    kind = F.lit("secret")
    for name in reversed(_ORDER):
        kind = F.when(mention.rlike(f"^(?:{_ALONE[name]})$"), name).otherwise(kind)
    return kind


def _gender(mention: Column) -> Column:
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(F.regexp_extract(mention, r"^(\S+?)\.? ", 1).isin(*TITLES[g]), g).otherwise(out)
    return out


def _words(mention: Column) -> Column:
    """The words of a name as written, without title."""
    return F.split(F.regexp_replace(mention, rf"^{_TITLE} ", ""), " ")


def _bare(word: Column) -> Column:
    return F.regexp_replace(word, _TAIL, "")


def _value(word: Column) -> Column:
    return F.initcap(F.lower(_bare(word)))


def _known(mentions: Column) -> Column:
    """array<struct<value, word, gender>>: the name words that have a title among the mentions."""
    titled = F.filter(mentions, lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    return F.flatten(F.transform(titled, lambda m: F.transform(_words(m), lambda w: F.struct(_value(w).alias("value"), _bare(w).alias("word"), _gender(m).alias("gender")))))


def _untitled(known: Column) -> Column:
    """Pattern of runs of these words, as written or in the usual cases; the longer words first."""
    forms = F.array_distinct(F.flatten(F.transform(known, lambda k: F.array(k["word"], k["value"], F.upper(k["value"])))))
    longest = F.transform(F.array_sort(F.transform(forms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    word = F.concat(F.lit("(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\d_])"))
    return F.concat(F.lit(r"(?<![\p{L}\d_])"), word, F.lit("(?: "), word, F.lit(")*+"))


def _settled(mention: Column, known: Column) -> Column:
    """Gender of a mention that is a name, else ''. Without a title of its own that tells, it is that of the
    first of its words that the known names give one gender only."""
    sure = lambda w: F.array_distinct(F.transform(F.filter(known, lambda k: (k["value"] == _value(w)) & (k["gender"] != "n")), lambda k: k["gender"]))
    only = F.filter(F.transform(_words(mention), sure), lambda g: F.size(g) == 1)
    name = F.forall(_words(mention), lambda w: F.exists(known, lambda k: k["value"] == _value(w)))
    own = _gender(mention)
    return F.when(~name, "").when(own != "n", own).otherwise(F.coalesce(F.get(F.get(only, F.lit(0)), F.lit(0)), F.lit("n")))


def _parts(mention: Column, kind: Column, gender: Column) -> Column:
    """array<struct<kind, value>>: what of the mention gets a surrogate; value in its canonical form."""
    part = lambda k, v: F.array(F.struct(k.alias("kind"), v.alias("value")))
    low = F.lower(mention)
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    named = F.transform(_words(mention), lambda w: F.struct(F.concat_ws(":", F.lit("name"), script(w), gender).alias("kind"), _value(w).alias("value")))
    return (
        F.when(kind == "email", F.concat(part(F.lit("email"), low), part(F.lit("domain"), F.substring_index(low, "@", -1))))
        .when(kind == "name", named)
        .when(kind.isin("phone", "card", "ssn", "account"), part(kind, F.regexp_replace(mention, r"\D", "")))
        .when(kind == "iban", part(kind, F.regexp_replace(mention, " ", "")))
        .when(kind == "ip6", part(kind, low))
        .otherwise(part(kind, mention))
    )


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled."""
    n = F.transform(F.reverse(F.split(digits, "")), lambda c, i: c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(n, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def _family() -> Column:
    """The kind, a name's without gender."""
    return F.regexp_replace("kind", "^(name:[a-z]+):[mfn]$", "$1")


def _drawn(rows: DataFrame, key: str, where: Column | None = None) -> DataFrame:
    """(kind, value, draw, ...) with their surrogates (where ``where`` says so, else those that they have). The digest
    is computed once for a value, not once for each of its characters."""
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), _family(), "value", "draw", F.lit(str(k))), 256) for k in range(3)])
    new = _surrogate() if where is None else F.when(where, _surrogate()).otherwise(F.col("surrogate"))
    return computed(rows, digest=digest).withColumn("surrogate", new).drop("digest")


def _surrogate() -> Column:
    """Surrogate of (kind, value, digest) at draw number ``draw``; genders of one name share all but its ending. From the fifth draw on more characters are drawn and from
    more classes, at the same length; only from the tenth on does it grow, since short values can run out."""
    digest = F.col("digest")
    byte = lambda i: F.conv(F.substr(digest, (i % 96) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    pick = lambda letters, i: F.substr(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    wide = F.col("draw") > 4

    def like(text: Column, hexa: bool = False) -> Column:
        some = lambda few, more, i: F.when(wide, pick(more, i)).otherwise(pick(few, i))
        of = lambda c, i: F.when(c.rlike("[0-9]"), pick(digit, i)).when(c.rlike("[a-z]"), pick("abcdef", i) if hexa else some(lower, lower + digit, i)).when(c.rlike("[A-Z]"), some(upper, upper + digit, i)).otherwise(c)
        return F.array_join(F.transform(F.split(text, ""), of), "")

    v = F.col("value")
    grow = F.greatest(F.col("draw") - 9, F.lit(0))
    more = F.when(grow > 0, F.substr(F.regexp_replace(digest, "[^0-9]", ""), F.lit(1), grow)).otherwise("")
    head = F.when(wide, pick("123456789", F.lit(95))).otherwise(F.substring(v, 1, 1))
    drawn = F.concat(head, like(F.expr("substring(value, 2)")), more)
    body = F.expr("substring(value, 2, length(value) - 2)")
    stem = F.concat(head, like(body), more, F.lit("0"))
    valid = F.concat(F.regexp_replace(stem, "0$", ""), ((10 - _luhn(stem) % 10) % 10).cast("string"))
    # each part of a date is valid as a day and as a month, or a year
    part = lambda p, i: F.when(F.length(p) > 2, (byte(i) % 80 + 1930).cast("string")).when(F.length(p) == 2, F.lpad((byte(i) % 12 + 1).cast("string"), 2, "0")).otherwise((byte(i) % 9 + 1).cast("string"))
    date = F.array_join(F.transform(F.split(v, "(?<=[./-])"), lambda p, i: F.concat(part(F.regexp_replace(p, "[./-]", ""), i), F.regexp_extract(p, "[./-]", 0))), "")
    street = F.concat(like(F.regexp_replace(v, r" \S+$", "")), more, F.regexp_extract(v, r" \S+$", 0))
    local = F.concat(like(F.substring_index(v, "@", 1)), more)
    domain = F.regexp_extract(v, r"^(.*)(\.[^.]+)$", 1)
    name = F.lit(None).cast("string")
    for (script, gender), end in _ENDS.items():
        s = F.array(*[F.lit(x) for x in _SYLLABLES[script]])
        syllables = F.array_join(F.transform(F.sequence(F.lit(0), F.col("draw") + 2), lambda i: F.element_at(s, byte(i) % len(_SYLLABLES[script]) + 1)), "")
        name = F.when(F.col("kind") == f"name:{script}:{gender}", F.initcap(F.concat(syllables, F.lit(end)))).otherwise(name)
    octets = F.concat_ws(".", (byte(F.lit(0)) % 223 + 1).cast("string"), *[byte(F.lit(k)).cast("string") for k in (1, 2)], (byte(F.lit(3)) % 254 + 1).cast("string"))
    return (
        F.when(F.col("kind") == "email", F.concat(local, F.lit("@"), F.substring_index(v, "@", -1)))
        .when(F.col("kind") == "domain", F.concat(like(domain), more, F.regexp_extract(v, r"(\.[^.]+)$", 1)))
        .when(F.col("kind") == "ip", octets)
        .when((F.col("kind") == "card") & (_luhn(v) % 10 == 0), valid)
        .when(F.col("kind").isin("card", "phone"), drawn)
        .when(F.col("kind") == "birth", F.concat(date, more))
        .when(F.col("kind") == "address", street)
        .when(F.col("kind") == "key", F.concat(F.lit("AKIA"), like(F.expr("substring(value, 5)")), more))
        .when(F.col("kind") == "iban", F.concat(F.substring(v, 1, 2), like(F.expr("substring(value, 3)")), more))
        .when(F.col("kind").startswith("name"), name)
        .when((F.col("kind") == "ip6") | ((F.col("kind") == "secret") & v.rlike("^[0-9a-f]+$")), F.concat(like(v, True), more))
        .otherwise(F.concat(like(v), more))
    )


def surrogates(parts: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate, draw) of distinct parts (kind, value): no two values of a kind share a surrogate, names
    of whatever gender, and no surrogate is a value that occurs. Drawn again where that fails, each round a written table."""
    now = stored(_drawn(parts.withColumn("draw", F.lit(0)), key), "surrogates")
    while True:
        drawn = now.withColumn("family", _family())
        first = drawn.groupBy("family", "surrogate").agg(F.min("value").alias("holder"), F.count("*").alias("n"))
        real = parts.select(_family().alias("family"), F.col("value").alias("surrogate"), F.lit(True).alias("real")).distinct()
        met = drawn.join(first.where("n > 1").drop("n"), ["family", "surrogate"], "left").join(real, ["family", "surrogate"], "left")
        met = met.select("kind", "value", "draw", "surrogate", (F.coalesce(F.col("holder") != F.col("value"), F.lit(False)) | F.coalesce("real", F.lit(False))).alias("again"))
        before, met = now, stored(met, "met")
        discard(before)
        if met.where("again").isEmpty():
            return met
        now = stored(_drawn(met.withColumn("draw", F.col("draw") + F.col("again").cast("int")), key, F.col("again")).drop("again"), "surrogates")


def _written(mention: Column, kind: Column, s: Column) -> Column:
    """The mention with the surrogates ``s`` of its parts, in the mention's own format."""
    digits = F.split(F.element_at(s, 1), "")
    zero = F.struct(F.lit(0).alias("k"), F.lit("").alias("out"))
    fill = lambda cls: F.aggregate(
        F.split(mention, ""), zero,
        lambda a, c: F.when(c.rlike(cls), F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], F.coalesce(F.try_element_at(digits, a["k"] + 1), F.lit(""))).alias("out"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["out"], c).alias("out"))),
    )
    ended = lambda f: F.concat(f["out"], F.array_join(F.slice(digits, f["k"] + 1, F.size(digits)), ""))
    email = F.concat(F.substring_index(F.element_at(s, 1), "@", 1), F.lit("@"), F.try_element_at(s, F.lit(2)))
    shout = (F.upper(mention) == mention) & (F.lower(mention) != mention)
    return (
        F.when((kind == "email") & shout, F.upper(email))
        .when(kind == "email", email)
        .when(kind == "name", F.concat(F.regexp_extract(mention, rf"^{_TITLE} ", 0), F.array_join(F.zip_with(s, _words(mention), lambda x, w: F.concat(x, F.regexp_extract(w, _TAIL, 0))), " ")))
        .when(kind.isin("phone", "card", "ssn", "account"), ended(fill("[0-9]")))
        .when(kind == "iban", ended(fill("[A-Z0-9]")))
        .otherwise(F.element_at(s, 1))
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every mention of personal data in ``text`` replaced, and n_replaced (mentions).

    Mentions are extracted once, with the rows stored beside them; texts without any pass by as they are. Null
    and empty texts stay; texts are read whole; repeated rows are treated alike, and rows that share a text in
    any number are dealt over several tasks; a column named n_replaced is replaced, other columns stay; an empty
    table stays empty. Surrogates depend on the key and the set of values that occur.
    """
    names = [c for c in docs.columns if c.lower() != "n_replaced"]
    hit, mark, said, known, every = unused(docs, "hit", "mark", "said", "known", "every")
    text, col = F.col("text"), F.col
    mentions = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = computed(docs.select(*names), **{said: mentions})
    some = F.size(col(said)) > 0
    marked = computed(marked, **{known: F.when(some, _known(col(said)))})
    marked = marked.withColumn(every, F.when(F.size(known) > 0, F.concat(F.lit(f"{ANY}|"), _untitled(col(known)))))
    marked = marked.withColumn(said, F.when(col(every).isNotNull(), F.regexp_extract_all(text, col(every), F.lit(0))).otherwise(col(said)))
    marked = marked.withColumns({hit: some, mark: F.when(some, F.concat(F.md5("text"), F.length("text").cast("string")))})
    marked = stored(marked, "marked", by=hit)
    miss, hits = marked.where(~col(hit)), marked.where(col(hit))
    exploded = F.explode(F.transform(F.array_distinct(said), lambda m: F.struct(F.md5(m).alias("m"), m.alias("mention"), _settled(m, col(known)).alias("gender")))).alias("x")
    found = stored(hits.select(mark, exploded).select(col(mark).alias("mark"), "x.*").distinct(), "mentions")
    kinds = found.select("m", "mention", "gender").distinct().withColumn("kind", F.when(F.col("gender") != "", "name").otherwise(_kind(F.col("mention"))))
    # a mention may have as many parts as a text has words: its parts go by its digest
    parts = stored(kinds.select("m", "gender", F.col("kind").alias("form"), F.posexplode(_parts(F.col("mention"), F.col("kind"), F.col("gender"))).alias("k", "part")).select("m", "gender", "form", "k", "part.*"), "parts")
    chosen = surrogates(parts.select("kind", "value").distinct(), key)
    written = salted_join(parts, chosen, ["kind", "value"]).groupBy("m", "gender", "form").agg(F.array_sort(F.collect_list(F.struct("k", "surrogate"))).alias("s"))
    maps = salted_join(found, written, ["m", "gender"]).select("mark", "mention", _written(F.col("mention"), F.col("form"), F.transform("s", lambda x: x["surrogate"])).alias("to"))
    maps = maps.groupBy("mark").agg(F.map_from_entries(F.collect_list(F.struct("mention", "to"))).alias("map"))
    table, = unused(marked, "map")
    maps = stored(maps.select(F.col("mark").alias(mark), F.col("map").alias(table)), "maps")
    discard(found, parts, chosen)
    gaps = F.when(col(every).isNull(), F.split("text", ANY, -1)).otherwise(F.split(text, col(every), -1))
    new = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(col(table), F.get(said, i)), F.lit("")))), "")
    done = salted_join(hits, maps, [mark]).withColumn("text", new).withColumn("n_replaced", F.size(said).cast("long"))
    return miss.withColumn("n_replaced", F.lit(0).cast("long")).select(*names, "n_replaced").unionByName(done.select(*names, "n_replaced"))
