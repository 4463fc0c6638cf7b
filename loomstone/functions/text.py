"""Text functions in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_text(c: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"https?://([^/?#]+)", 1)), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, no trailing slash or fragment, query pairs sorted."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.array_join(F.array_sort(F.split(query, "&")), "&")
    return F.concat(scheme, F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), pairs)).otherwise(""))


def redact(c: Column) -> Column:
    """E-mail addresses, handles and phone numbers masked, in this order, then white space collapsed."""
    c = F.regexp_replace(c, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]")
    c = F.regexp_replace(c, r"@[A-Za-z0-9_]{2,}", "[handle]")
    c = F.regexp_replace(c, r"\+?[0-9][0-9 ().-]{7,}[0-9]", "[phone]")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


#: Parts of what sanitize masks: a host, and what may stand between a phone number's digits.
_HOST, _BETWEEN = r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*", r"[\s().-]"
_CAPITAL = "ÁÂÃÇÉÊÍÓÔÕÚ"


def sanitize(c: Column) -> Column:
    """A leading name before a handle taken out; then mail addresses, handles and phone numbers masked; white space collapsed.

    A name is a capital letter and two more letters, hyphens or apostrophes at least; a phone number begins and ends with a digit
    and has seven more digits, spaces, brackets, dots or hyphens between; neither a handle nor a number begins within a word.
    """
    c = F.coalesce(c, F.lit(""))
    named = F.regexp_extract(c, rf"^\s*([A-Z{_CAPITAL}](?:\p{{IsLatin}}|['-]){{2,}})\s+@", 1)
    c = F.when(named != "", F.substr(c, F.locate("@", c))).otherwise(c)
    masks = (
        ("email", rf"(?i)\b[a-z0-9._%+-]+@{_HOST}\.[a-z]{{2,}}\b"),
        ("handle", r"(?<![\p{L}\p{N}\p{M}_])@[A-Za-z0-9_][A-Za-z0-9_.-]*|(?<![\p{L}\p{N}\p{M}_])@[.-][A-Za-z0-9_.-]*"),
        ("phone", rf"(?<![\p{{L}}\p{{N}}\p{{M}}_])\+?\p{{Nd}}(?:\p{{Nd}}|{_BETWEEN}){{7,}}\p{{Nd}}"),
    )
    for what, pattern in masks:
        c = F.regexp_replace(c, pattern, f"[redacted-{what}]")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


#: Cyrillic letters in Latin ones, first those of more than one letter.
LATIN = (("ж", "zh"), ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ю", "yu"), ("я", "ya"), ("ё", "yo"), ("ъ", ""), ("ь", ""))
LATIN_FROM, LATIN_TO = "абвгдезийклмнопрстуфыэ", "abvgdeziyklmnoprstufye"


def latin(c: Column) -> Column:
    """Cyrillic text in Latin letters, in lower case."""
    out = F.lower(c)
    for a, b in LATIN:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.translate(out, LATIN_FROM, LATIN_TO)


#: Words that are spelled in another way elsewhere.
SPELLINGS = {"tsentralnyy": "central", "tsentralny": "central", "dinamo": "dynamo", "lva": "lev", "yashina": "yashin"}
#: Letters of a romanized word and what others write for them.
SPELLED = (("ye", "e"), ("yo", "e"), ("ts", "c"))


def spellings(word: Column) -> Column:
    """The ways in which a romanized word (in lower case) may be written, itself first, each once: as SPELLINGS has it, without a final a
    (of six letters or more), with iy or i for a final y, and with SPELLED replaced throughout. Null and empty words have none.
    """
    known = F.element_at(F.create_map(*[F.lit(x) for pair in SPELLINGS.items() for x in pair]), word)
    stem = F.substr(word, F.lit(1), F.length(word) - 1)
    nominative = F.when(F.endswith(word, F.lit("a")) & (F.length(word) >= 6), stem)
    endings = [F.when(F.endswith(word, F.lit("y")), F.concat(stem, F.lit(e))) for e in ("iy", "i")]
    plain = [F.replace(word, F.lit(a), F.lit(b)) for a, b in SPELLED]
    every = F.array_compact(F.array(word, known, nominative, *endings, *plain))
    return F.array_distinct(F.filter(every, lambda w: w != ""))


def mentions(c: Column, word: str, around: int = 60) -> Column:
    """What stands up to around characters on either side of each mention of a word, in lower case."""
    import re

    p = F.lit(rf"(?s).{{0,{around}}}\b{re.escape(word.lower())}\b.{{0,{around}}}")
    return F.regexp_extract_all(F.lower(c), p, F.lit(0))


def first_class(c: Column, markers: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """The first class one of whose markers the text contains."""
    out = F.lit(other)
    for name, words in reversed(markers):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(c, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def chunks(c: Column, size: int) -> Column:
    """White space collapsed, then slices of size characters, trimmed, without overlap or empty ones."""
    flat = F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))
    n = F.ceil(F.length(flat) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.trim(F.substr(flat, i * size + 1, F.lit(size))))
    return F.when(n > 0, F.filter(parts, lambda p: p != "")).otherwise(F.array().cast("array<string>"))


def number(c: Column) -> Column:
    """A number written 1.234.567, 1.234, 1,234,567.8 or plain; null otherwise. One dot before three digits groups thousands, too."""
    dotted, comma, plain = r"^[0-9]{1,3}(\.[0-9]{3})+$", r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$", r"^[0-9]+(\.[0-9]+)?$"
    return F.when(c.rlike(dotted), F.replace(c, F.lit("."), F.lit(""))).when(c.rlike(comma), F.replace(c, F.lit(","), F.lit(""))).when(c.rlike(plain), c).try_cast("double")


def source_url(url: Column) -> Column:
    """normal_url where there are scheme and host, else the text without spaces around it, in lower case; empty for null."""
    trimmed = F.trim(url)
    return F.coalesce(F.when(trimmed.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), normal_url(trimmed)).otherwise(F.lower(trimmed)), F.lit(""))


def wiki_slug(url: Column) -> Column:
    """What follows /wiki/ in the address of an encyclopedia's page, decoded, underscores as spaces; null elsewhere."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1))
    slug = F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*[^?#]*/wiki/([^?#]*)", 1)
    there = (host.contains("wikipedia.org") | host.contains("wikidata.org")) & url.rlike(r"^[A-Za-z]+://[^/?#]*[^?#]*/wiki/")
    # a plus sign is no space in a path
    decoded = F.coalesce(F.try_url_decode(F.replace(slug, F.lit("+"), F.lit("%2B"))), slug)
    return F.when(there, F.trim(F.replace(decoded, F.lit("_"), F.lit(" "))))


def has_token(text: Column, token: str) -> Column:
    """Whether text has token as a word of its own; a token of several words only has to stand in it."""
    return F.contains(text, F.lit(token)) if " " in token else F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.lit(f" {token} "))


def maps_link(name: Column, city: Column, country: Column) -> Column:
    """A search link for a map, of the parts that are there."""
    parts = F.filter(F.array(name, city, country), lambda p: F.coalesce(F.trim(p), F.lit("")) != "")
    asked = F.url_encode(F.array_join(F.transform(parts, lambda p: F.trim(p)), ", "))
    return F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), F.replace(asked, F.lit("+"), F.lit("%20")))


#: What a vague next action says, and what a concrete one does.
VAGUE = ("待研究", "待定", "tbd", "todo", "进一步研究")
VERBS = ("补查", "查询", "核验", "核查", "确认", "比对", "检查")


def concrete(action: Column) -> Column:
    """Whether a next action says what to do: eight characters or more, one of VERBS, none of VAGUE."""
    flat = F.lower(F.trim(F.coalesce(action, F.lit(""))))
    vague, verb = F.lit(False), F.lit(False)
    for w in VAGUE:
        vague = vague | F.contains(flat, F.lit(w))
    for w in VERBS:
        verb = verb | F.contains(flat, F.lit(w))
    return (F.length(flat) >= 8) & ~vague & verb


#: Words of Chinese prose about places.
PROSE = "补查|补采|补充|核验|复核|推荐|优先|确认|进入|主指标|下一步|来源|年度|客流|方案|依据|该物业|该场馆|该机场|该校区"


def _counts(c: Column) -> tuple[Column, Column, Column]:
    """Chinese characters, Latin words of two letters or more, and the letters of those."""
    n = lambda p: F.coalesce(F.regexp_count(c, F.lit(p)), F.lit(0))
    words = F.coalesce(F.regexp_extract_all(c, F.lit("[A-Za-z]{2,}"), 0), F.array().cast("array<string>"))
    return n("[\u4E00-\u9FFF]"), F.size(words), F.length(F.array_join(words, ""))


def locale(c: Column) -> Column:
    """zh, en or mixed, by the letters of a text; text without letters is en."""
    cjk, words, letters = _counts(c)
    after_de = F.element_at(F.split(c, "的"), -1)
    prose = (cjk >= 4) & c.rlike(PROSE)
    foreign = c.rlike("(^|[^A-Za-z0-9_])[a-z]{3,}($|[^A-Za-z0-9_])")
    both = (
        F.when(prose & F.contains(c, F.lit("的")) & ~after_de.rlike("[A-Za-z]{2,}"), "zh")
        .when(prose, F.when(foreign, "mixed").otherwise("zh"))
        .when(cjk >= F.greatest(F.lit(12), words * 4), "zh")
        .when(letters >= F.greatest(F.lit(24), cjk * 4), "en")
        .otherwise("mixed")
    )
    return F.when((cjk > 0) & (letters > 0), both).when(cjk > 0, "zh").otherwise("en")


#: Words within names, words that need no translation, words that names don't have.
CONNECTORS = ("and", "da", "de", "del", "des", "do", "dos", "du", "et", "la", "le", "of", "the")
NEUTRAL = ("gfa", "gla", "nla", "sqm")
SENTENCE = (
    "are", "for", "from", "had", "has", "have", "is", "lists", "located", "provides", "reports", "served", "serves", "states", "supports", "was",
    "were", "with",
)
#: A word in Latin letters, with up to 50 hyphens within, that no other letter touches.
_LATIN_WORD = r"(?<!\p{L}-?)\p{IsLatin}++(?:-\p{IsLatin}++){0,50}+(?!-?\p{L})"
_BLANK = r"\s\u00A0\u3000"
#: What ends a row of words, and what marks a word of a name.
_END, _OF_NAME = "\u0001", "\u0002"
_CHINESE = "[\u4E00-\u9FFF]"
#: A word as names are written: a capital inside, or in front of a word without hyphens. Words lie between single blanks.
_NAMED = r"(?:[^ ]+\p{Lu}[^ ]*+|\p{Lu}[^ -]*+)(?![^ ])"


def _with_names(text: Column) -> Column:
    """The Latin words of a text, between blanks, those of a name with a mark behind."""
    # a word with what stands before the next one of its row, or with blanks and the Chinese character behind the row
    found = rf"{_LATIN_WORD}(?:[{_BLANK}'’.-]++(?={_LATIN_WORD})|[{_BLANK}]++{_CHINESE})?"
    rows = F.regexp_replace(F.array_join(F.regexp_extract_all(text, F.lit(found), 0), _END), rf"[{_BLANK}'’.-]++{_END}", " ")

    def marked(r: Column) -> Column:
        words = F.regexp_replace(r, rf"[{_BLANK}]*+{_CHINESE}$", "")
        name = r.rlike(rf"{_CHINESE}$") & words.rlike(rf"(?<![^ ]){_NAMED}") & ~F.lower(words).rlike(rf"(?<![^ ])(?:{'|'.join(SENTENCE)})(?![^ ])")
        return F.when(name, F.regexp_replace(words, "(?<=[^ ])(?![^ ])", _OF_NAME)).otherwise(words)

    return F.array_join(F.transform(F.split(rows, _END), marked), " ")


def translatable(c: Column) -> Column:
    """The Latin words of a text that a translation would change, in lower case, each once, in order.

    Words of three letters or more count that are not written as names are, but not keys such as seat_count, NEUTRAL words, CONNECTORS
    between two names, and words of a name: of a row of words with nothing but blanks, dots, hyphens and apostrophes
    between them that a Chinese character follows, if one of them is written as a name and none is a SENTENCE word.
    Null and empty texts have none. The work grows with the length of a text, however long a row or the text is.
    Words are sifted by patterns over all of them at once; rows are only looked at in texts with Chinese characters.
    """
    text = F.coalesce(c, F.lit(""))
    key = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9]*+(?:_[A-Za-z0-9]++){1,50}+(?![A-Za-z0-9_])"
    text = F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, key, " ")).otherwise(text)
    plain = F.array_join(F.regexp_extract_all(text, F.lit(_LATIN_WORD), 0), " ")
    words = F.when(text.rlike(_CHINESE), _with_names(text)).otherwise(plain)
    words = F.regexp_replace(words, rf"(?<![^ ])({_NAMED}) (?:{'|'.join(CONNECTORS)})(?= {_NAMED})", "$1")
    each = F.array_join(F.array_distinct(F.split(words, " ")), " ")
    wanted = F.regexp_replace(each, rf"(?<![^ ])(?:[^ ]{{1,2}}(?![^ ])|{_NAMED}|[^ ]++(?<={_OF_NAME}))", "")
    return F.array_except(F.split(F.lower(wanted), " "), F.array(*map(F.lit, ("", *NEUTRAL))))


def usable_translation(source: Column, translated: Column, source_locale: Column, target_locale: Column, status: Column, good: tuple[str, ...] = ("ok", "translated")) -> Column:
    """Whether a translation may be shown: a good status, a text, and more of the target's letters, or fewer of the source's, than before.

    A translation that repeats its source is usable only if the source has no words that need one.
    """
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    cjk = lambda c: F.coalesce(F.regexp_count(c, F.lit("[\u4E00-\u9FFF]")), F.lit(0))
    latin = lambda c: F.coalesce(F.regexp_count(c, F.lit("[A-Za-z]{3,}")), F.lit(0))
    to_zh = (latin(source) == 0) | (latin(translated) < latin(source)) | (cjk(translated) > cjk(source))
    to_en = (cjk(source) == 0) | (cjk(translated) < cjk(source)) | (latin(translated) > latin(source))
    aligned = F.when((target_locale == "zh") & source_locale.isin("en", "mixed"), to_zh).when((target_locale == "en") & source_locale.isin("zh", "mixed"), to_en).otherwise(True)
    bearing = F.when(target_locale == "en", cjk(source) > 0).when(target_locale == "zh", source.rlike("(^|[^A-Za-z0-9_])[a-z]{3,}($|[^A-Za-z0-9_])")).otherwise(True)
    same = flat(source) == flat(translated)
    ok = F.when(source_locale == target_locale, True).when(same, ~bearing).otherwise(aligned)
    return F.coalesce(F.lower(status).isin(*good) & (flat(translated) != "") & ok, F.lit(False))


def place_aliases(name: Column) -> Column:
    """The name, what it has outside and inside parentheses, and its parts between slashes; each once, in this order."""
    outside, inside = F.regexp_replace(name, r"\s*\([^)]*\)\s*", " "), F.regexp_extract_all(name, F.lit(r"\(([^)]*)\)"), 1)
    parts = F.flatten(F.transform(F.concat(F.array(name, outside), inside), lambda p: F.concat(F.array(p), F.split(p, "/"))))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""))


def degrees(c: Column) -> Column:
    """Struct (lat, lon) of DDMM[NS] DDDMM[EW]; null if it is not written so."""
    at = lambda i: F.regexp_extract(c, r"^\s*(\d{2})(\d{2})([NS])\s+(\d{3})(\d{2})([EW])\s*$", i)
    one = lambda d, m, side, minus: (at(d).try_cast("double") + at(m).try_cast("double") / 60) * F.when(at(side) == minus, -1.0).otherwise(1.0)
    return F.when(at(1) != "", F.struct(one(1, 2, 3, "S").alias("lat"), one(4, 5, 6, "W").alias("lon")))
