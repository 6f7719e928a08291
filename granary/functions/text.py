"""Text functions as Spark columns: tokens, terms, titles, URLs and ages.

White space is Unicode's, lengths are in bytes where it says so.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}\p{Co}]+"
NOT_ALNUM = r"[^\p{L}\p{N}\p{M}]+"
SPACES = r"(?U)\s+"
CODE_EXTENSIONS = "rs py js mjs ts tsx jsx go c h cpp cc hpp cs java kt rb php swift lua sh bash ps1 bat sql json toml yaml yml xml html css vim".split()

#: The marks around hits in a snippet, what stands for left-out text, and a snippet's tokens.
HIT_OPEN, HIT_CLOSE, LEFT_OUT, SNIPPET_TOKENS = "\x01", "\x02", " … ", 14
#: Numbers of kinds in lists.
KIND_NUMBERS = {1: "pdf", 2: "image", 3: "note", 5: "file", 6: "docx", 7: "xlsx", 8: "pptx", 9: "web"}

#: Words that carry no content.
STOPWORDS = (
    "about actually after again also another anything around back because been before being below best between both "
    "came cant come could days didnt does doesnt doing done dont down during each else even ever every from gets "
    "getting give given going good have having here hers however into isnt just keep kept know known last like little "
    "long made make many might mine more most much must myself need never next often once only other others over "
    "please really right said same seen shall should show since some something soon still such take taken tell than "
    "that their them then there these they thing things this those though through thus time took under until upon "
    "used using very want well went were what whats when where whether which while whom whose will with within "
    "without would youre your"
).split()

#: Words that ask about files, and words about order or time.
FILE_WORDS = "file files doc docs document documents paper papers note notes pdf pdfs snippet receipt".split()
TIME_WORDS = "before after previous prior next recent latest first last earliest newest oldest when order current".split()
ASK_STARTS = ("which", "what file", "is there", "do i have", "are there")
ASK_PARTS = ("which file", "which doc")

#: Synonyms of query words, in order.
SYNONYMS = {
    "bill": "total paid amount invoice",
    "boat": "vessel voyage carrier ship",
    "broker": "brokers customs filer",
    "car": "vehicle unit vin",
    "career": "engineer manager experience senior principal",
    "checkout": "git github clone",
    "clone": "git github",
    "cost": "total amount fee paid",
    "cv": "engineer experience senior principal",
    "employed": "engineer manager administrator architect experience senior principal",
    "employer": "engineer manager administrator architect analyst director technologies inc",
    "employers": "engineer manager administrator architect analyst director technologies inc",
    "employment": "engineer manager administrator architect experience senior principal",
    "fees": "fee charge total",
    "import": "entry customs shipment lading",
    "invoice": "total paid amount payment",
    "job": "engineer manager administrator architect analyst senior principal",
    "jobs": "engineer manager administrator architect analyst senior principal",
    "pay": "paid payment amount total",
    "port": "arrival discharge terminal lading",
    "receipt": "total paid amount payment",
    "repo": "git github",
    "repository": "git github",
    "resume": "engineer experience senior principal",
    "salary": "pay compensation wage income",
    "ship": "vessel voyage carrier",
    "ssh": "git github",
    "vessel": "voyage carrier",
    "work": "engineer manager administrator architect senior principal",
    "worked": "engineer manager administrator architect senior principal",
    "working": "engineer manager administrator architect senior principal",
}


def _folding() -> tuple[str, str]:
    """Accented Latin letters in lower case and their base letters."""
    pairs = []
    for code in range(0x00C0, 0x0250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and chr(code) == chr(code).lower():
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    """Runs of letters and numbers, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def words(text: Column) -> Column:
    """Words between white space; none for null and blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def content_terms(text: Column) -> Column:
    """Distinct terms in order: of 4 bytes or more before lower-casing, and no stopwords."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), NOT_ALNUM), lambda t: F.octet_length(t) >= 4)
    lowered = F.filter(F.transform(parts, lambda t: F.lower(t)), lambda t: ~t.isin(STOPWORDS))
    return F.array_sort(F.array_distinct(lowered))


def stems(term: Column) -> Column:
    """Plausible singulars of a word."""
    n = F.octet_length(term)
    cut = lambda k: F.substring(term, 1, F.length(term) - F.lit(k))
    options = F.array(
        F.when(term.endswith("ies") & (n >= 5), F.concat(cut(3), F.lit("y"))),
        F.when(term.endswith("s") & (n >= 4), cut(1)),
        F.when(term.endswith("es") & (n >= 5), cut(2)),
    )
    return F.array_distinct(F.filter(options, lambda s: s.isNotNull()))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def truncate_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most this many bytes, for texts of any script."""

    def cut(t: Column) -> Column:
        fits = F.filter(F.transform(F.sequence(F.lit(0), F.length(t)), lambda k: F.substring(t, F.lit(1), k)), lambda p: F.octet_length(p) <= most)
        return F.when(F.octet_length(t) <= most, t).otherwise(F.try_element_at(fits, F.lit(-1)))

    return let(F.substring(text, 1, most), cut)


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null if there is none."""
    line = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?U)^\s*(\S[^\r\n]*)", 1)
    return let(F.regexp_replace(line, r"(?U)\s+$", ""), lambda x: F.when(x != "", x))


def text_title(text: Column) -> Column:
    """Title of a pasted text: its first line, at most 80 bytes of it."""
    return F.coalesce(truncate_bytes(first_line(text), 80), F.lit("Text"))


def note_title(text: Column, now: Column) -> Column:
    """Title of a note: its first line without heading marks, or its date where it is blank."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), r"(?U)^#+\s*", ""))
    line = F.try_element_at(F.filter(lines, lambda x: x != ""), F.lit(1))
    return F.coalesce(F.substring(line, 1, 80), F.concat(F.lit("Note "), F.date_format(F.timestamp_seconds(now), "yyyy-MM-dd HH:mm")))


def preview(text: Column, most: int) -> Column:
    return F.translate(F.substring(text, 1, most), "\r\n", "  ")


def skip_words(text: Column, n: int) -> Column:
    """The text from after its n-th word on, with the space that follows it; empty for n = 0."""
    if n <= 0:
        return F.lit("")
    rest = F.regexp_replace(text, rf"(?U)^\s*(?:\S+\s+){{{n - 1}}}\S+", "")
    return F.when(F.size(words(text)) <= n, F.lit("")).otherwise(rest)


def is_code_name(name: Column) -> Column:
    """Whether a file name has a stem and an extension of source code."""
    low = F.lower(name)
    return F.coalesce(F.regexp_extract(low, r"(?s)^.+\.([^.]*)$", 1).isin(CODE_EXTENSIONS), F.lit(False))


def file_type(name: Column, kind: Column) -> Column:
    """What a name is highlighted as: notes, texts and pages as markdown, else by extension."""
    return F.when(kind.isin("text", "note", "web"), F.lit("markdown")).otherwise(F.regexp_extract(F.lower(name), r"(?s)^.+\.([^.]*)$", 1))


def url_host(url: Column) -> Column:
    host = F.regexp_extract(url, r"//([^/]*)", 1)
    return F.when(F.instr(url, "//") > 0, host).otherwise(url)


def url_last(url: Column) -> Column:
    """The last part of the path without query, or the host."""
    path = F.when(F.instr(url, "//") > 0, F.regexp_extract(url, r"(?s)//(.*)$", 1)).otherwise(url)
    part = F.regexp_extract(F.regexp_replace(F.regexp_extract(path, r"(?s)^([^?#]*)", 1), r"/+$", ""), r"([^/]*)$", 1)
    return F.when((part == "") | (part == url_host(url)), url_host(url)).otherwise(part)


def url_parts(url: Column) -> Column:
    """struct<scheme, host, port, path>: credentials dropped, default ports filled in; null if it is no web address."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z]+)://", 1))
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z]+://(.*)$", 1)
    authority = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^.*@", "")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)$", 1)
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    host = F.regexp_replace(authority, r":[0-9]+$", "")
    parts = F.struct(
        scheme.alias("scheme"),
        host.alias("host"),
        F.when(port != "", port.cast("int")).when(scheme == "https", 443).otherwise(80).alias("port"),
        F.when(path == "", F.lit("/")).otherwise(path).alias("path"),
    )
    return F.when(scheme.isin("http", "https") & (host != ""), parts)


def is_bare_url(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")
    return (F.octet_length(t) <= 2048) & t.rlike(r"(?i)^https?://[^/?#\s]+\S*$") & ~t.rlike(r"(?U)\s")


def shortcut_url(text: Column) -> Column:
    """The address in a URL shortcut: URL= of an INI file or <string> of a property list."""
    ini = F.regexp_extract(text, r"(?im)^\s*URL=(https?://[^\s/?#]\S*)\s*$", 1)
    plist = F.regexp_extract(text, r"(?i)<string>\s*(https?://[^\s/?#<][^\s<]*)\s*</string>", 1)
    return F.when(ini != "", ini).when(plist != "", plist)


def age(at: Column, now: Column) -> Column:
    d = F.greatest(now - at, F.lit(0))
    whole = lambda n: F.floor(d / F.lit(n)).cast("string")
    return (
        F.when(d < 60, F.lit("just now"))
        .when(d < 3600, F.concat(whole(60), F.lit(" min ago")))
        .when(d < 86400, F.concat(whole(3600), F.lit(" h ago")))
        .otherwise(F.concat(whole(86400), F.lit(" d ago")))
    )


def size_text(size: Column) -> Column:
    """Decimal size: GB with one decimal, MB and KB whole."""
    return (
        F.when(size >= 1_000_000_000, F.concat(F.format_number(size / 1e9, "0.0"), F.lit(" GB")))
        .when(size >= 1_000_000, F.concat(F.floor(size / 1e6).cast("string"), F.lit(" MB")))
        .otherwise(F.concat(F.floor(size / 1e3).cast("string"), F.lit(" KB")))
    )


def asks_for_document(text: Column) -> Column:
    q = F.lower(F.coalesce(text, F.lit("")))
    noun = F.exists(F.split(q, NOT_ALNUM), lambda w: w.isin(FILE_WORDS))
    ask = F.lit(False)
    for s in ASK_STARTS:
        ask = ask | q.startswith(s)
    for s in ASK_PARTS:
        ask = ask | q.contains(s)
    return noun & ask


def asks_for_time(text: Column) -> Column:
    return F.exists(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), lambda w: w.isin(TIME_WORDS))


def tag_set(text: Column) -> Column:
    """Tags of a line: split on commas and space, # removed, lower case; a tag equal to the one before it goes."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)[,\s]+"), lambda t: F.lower(F.regexp_replace(t, "^#+", ""))), lambda t: t != "")
    return F.filter(F.transform(parts, lambda t, i: F.when((i == 0) | (t != F.get(parts, i - 1)), t)), lambda t: t.isNotNull())


def item_hash(kind: Column, source: Column, content: Column, bytes_hash: Column | None = None) -> Column:
    """Identity of an item: of its kind and bytes, else of kind, source and content."""
    zero = F.lit("\0")
    plain = F.concat(kind, zero, F.coalesce(source, F.lit("")), zero, F.coalesce(content, F.lit("")))
    if bytes_hash is None:
        return F.sha2(plain, 256)
    return F.sha2(F.when(bytes_hash.isNotNull(), F.concat(kind, zero, bytes_hash)).otherwise(plain), 256)


def failure_title(path: Column, message: Column) -> Column:
    """Name of a failed ingest: the file's, or what its message says before the colon."""
    name = F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/\\]+)[/\\]*$", 1)
    return F.when(name != "", name).otherwise(F.trim(F.element_at(F.split(message, ":"), 1)))


def strip_title(message: Column, title: Column) -> Column:
    """A message without the name that it begins with."""
    rest = F.substring(message, F.length(title) + 1, F.length(message))
    return F.when(message.startswith(title), F.trim(F.regexp_replace(rest, "^:+", ""))).otherwise(message)


def tag_line(text: Column) -> Column:
    """Tags as typed, as a line: #a #b."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)[,\s]+"), lambda t: F.regexp_replace(t, "^#+", ""))
    return F.array_join(F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.concat(F.lit("#"), F.lower(t))), " ")


def windows_path(path: Column) -> Column:
    """A path below /mnt/<drive> as Windows names it; others as they are."""
    drive, rest = (F.regexp_extract(path, r"(?s)^/mnt/([^/])/(.*)$", k) for k in (1, 2))
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":\\"), F.translate(rest, "/", "\\"))).otherwise(path)


def short_path(path: Column, most: int) -> Column:
    """As many last folders of a long path as fit, after an ellipsis."""

    def cut(parts: Column) -> Column:
        ends = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "\\"))
        return F.concat(F.lit("…\\"), F.element_at(F.filter(ends, lambda e: (e == "") | (F.length(e) + 2 <= most)), -1))

    return F.when(F.length(path) <= most, path).otherwise(let(F.split(path, r"\\"), cut))


def plain_snippet(snippet: Column) -> Column:
    """A snippet without the marks around its hits."""
    return F.translate(snippet, HIT_OPEN + HIT_CLOSE, "")


def kind_index(kind: Column, source: Column, title: Column) -> Column:
    """The number of a hit's kind as lists show it; code files count as code, unknown kinds as 0."""
    out = F.when((kind != "web") & is_code_name(F.coalesce(source, title)), 4)
    for number, name in KIND_NUMBERS.items():
        out = out.when(kind == name, number)
    return out.otherwise(0)
