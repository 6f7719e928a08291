"""Files as items: dispatch by extension over binary content."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import is_bare_url, text_title
from granary.sources import html, office, pdf

MAX_TEXT, MAX_PAGE, MAX_COPY = 4 << 20, 5_000_000, 25 << 20
#: Extensions of files whose bytes are their text.
TEXT_EXTENSIONS = set(
    "txt md markdown rst csv tsv json yaml yml toml ini cfg conf log xml css js ts jsx tsx rs py c h cpp hpp cs java "
    "kt go rb php sh ps1 bat cmd sql lua swift m tex bib org srt vtt".split()
)
PAGE_EXTENSIONS = {"html", "htm", "xhtml"}
SHORTCUTS = {"url", "website", "webloc"}
NAME_ONLY = {"gif", "webp", "bmp"}
IMAGES = {"png", "jpg", "jpeg"}
ITEM = "title string, kind string, content string, error string"
Reader = Callable[[bytes], str]


def cp1252(data: bytes) -> str:
    """Windows text; bytes without a character there stand for themselves."""
    return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in data) if re.search(rb"[\x81\x8d\x8f\x90\x9d]", data) else data.decode("cp1252")


def decode_body(data: bytes, content_type: str = "") -> str:
    """A page's text: Windows or Latin-1 where its header or first 4 KiB says so, else UTF-8 with replacements."""
    said = content_type.lower() + data[:4096].decode("latin-1").lower()
    return cp1252(data) if re.search("windows-1252|iso-8859-1|latin1", said) else data.decode("utf-8", "replace")


def capped(text: str, most: int = MAX_TEXT) -> str:
    """The longest beginning of at most ``most`` bytes."""
    return text.encode("utf-8", "replace")[:most].decode("utf-8", "ignore")


def shortcut_address(text: str) -> str | None:
    from granary.sources.markup import decode

    for line in text.splitlines():
        found = re.match(r"\s*URL=(.*)$", line, re.I) or re.search(r"<string>(.*?)</string>", line)
        url = decode(found[1]).strip() if found else ""
        if re.fullmatch(r"https?://[^/?#\s]+\S*", url, re.I) and len(url.encode()) <= 2048:
            return url
    return None


def pdf_text(data: bytes, read: Reader) -> str:
    """Text of a PDF, none where it cannot be read: its images may still say something."""
    try:
        return read(data)
    except (ValueError, TypeError, IndexError, AttributeError, RecursionError):
        return ""


def read_file(name: str, data: bytes, readers: dict[str, Reader] | None = None) -> tuple[str, str | None, str | None, str | None]:
    """(title, kind, content, error) of a file.

    ``readers`` take the bytes of files: "image" of images, "ocr" of PDFs with under twenty
    words (``pdf.read_scans`` makes one), "pdf" of PDFs, in place of ``pdf.text_of``. What has
    no text is findable by its name.
    """
    readers = readers or {}
    stem, _, ext = name.rpartition(".")
    ext = ext.lower() if stem else ""
    try:
        if ext == "pdf":
            kind, content = "pdf", pdf_text(data, readers.get("pdf", pdf.text_of))
            if len(content.split()) < 20 and "ocr" in readers:
                content = "\n\n".join(t for t in (content, readers["ocr"](data)) if t.strip())
            if not content.strip():
                raise ValueError("no text in this PDF")
        elif ext in office.KIND_OF:
            kind, content = office.KIND_OF[ext], office.extract(ext, data)
        elif ext in SHORTCUTS:
            kind, content = "web", shortcut_address(data.decode("utf-8", "replace"))
            if content is None:
                raise ValueError("no web address in this shortcut")
        elif ext in PAGE_EXTENSIONS:
            page = decode_body(data[:MAX_PAGE])
            title, text = html.read_page(page)
            return title or name, "web", capped(text or page), None
        elif ext in TEXT_EXTENSIONS:
            kind, content = "file", data.decode("utf-8", "replace")
        elif ext in IMAGES or ext in NAME_ONLY:
            kind, content = "image", readers["image"](data) if ext in IMAGES and "image" in readers else name
        else:
            kind, content = "file", f"{name} ({len(data)} bytes)"
    except ValueError as e:
        return name, None, None, f"{name}: {e}"
    content = capped(content)
    return name, kind, content if content.strip() else name, None


def extract(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """Rows (path, title, kind, content, error, bytes_hash, hash, added_at) of binary files (path, content, modificationTime)."""

    def run(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        rows = [read_file(re.split(r"[/\\]", p)[-1], bytes(c), readers) for p, c in zip(path, content, strict=True)]
        return pd.DataFrame(rows, columns=["title", "kind", "content", "error"])

    found = files.withColumn("item", F.pandas_udf(run, f"struct<{ITEM.replace(' string', ': string')}>")("path", "content"))
    digest = F.sha2(F.col("content"), 256)
    return found.select(
        "path", "item.title", "item.kind", F.col("item.content").alias("text"), "item.error", digest.alias("bytes_hash"),
        F.sha2(F.concat(F.col("item.kind"), F.lit("\0"), digest), 256).alias("hash"),
        F.unix_seconds(F.col("modificationTime")).alias("added_at"),
    ).withColumnRenamed("text", "content")


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """Binary files (path, modificationTime, length, content) below a folder; names that begin with a dot or an underscore are left out."""
    from granary.sources import folder

    return folder.contents(spark, path)


def route_page(url: Column, content_type: Column, readable_text: Column, body: Column) -> Column:
    """Content of a fetched page by its type: readable text of pages, other text as it is; null for the rest."""
    low = F.lower(F.coalesce(content_type, F.lit("")))
    text = F.when(low.contains("html") | low.contains("xml"), readable_text).when(low.startswith("text/") | low.contains("json"), body)
    return F.concat(url, F.lit("\n\n"), text)


Fetch = Callable[[str], tuple[str, str, bytes]]


def fetched(addresses: DataFrame, fetch: Fetch) -> DataFrame:
    """Rows (url, address, title, content, error) of the pages behind addresses (url).

    ``fetch`` is the caller's: from an address to where it led, its content type and its
    bytes, or a ValueError. Pages become readable text below their address, other text stays
    as it is, anything else is refused. Each address is fetched once.
    """

    def page(url: str) -> tuple:
        try:
            at, kind, body = fetch(url)
            low, text = kind.lower(), decode_body(body[:MAX_PAGE], kind)
            if "html" in low or "xml" in low:
                title, text = html.read_page(text)
            elif low.startswith("text/") or "json" in low:
                title = None
            else:
                raise ValueError(f"{kind or 'unknown type'} is no text")
            return at, capped((title or at).strip(), 120), capped(f"{at}\n\n{text}"), None
        except ValueError as e:
            return None, None, None, f"{url}: {e}"

    def run(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page(u) for u in urls], columns=["address", "title", "content", "error"])

    read = F.pandas_udf(run, "struct<address: string, title: string, content: string, error: string>")
    return addresses.select("url").distinct().withColumn("page", read("url")).select("url", "page.*")


def text_items(texts: DataFrame, fetch: Fetch | None = None) -> DataFrame:
    """Items (id, title, kind, source, content) of pasted texts (id, text).

    A text that is nothing but an address is fetched instead, where ``fetch`` is given; if
    that fails it stays a text.
    """
    plain = texts.select("id", text_title(F.col("text")).alias("title"), F.lit("text").alias("kind"), F.lit(None).cast("string").alias("source"), F.substring("text", 1, MAX_TEXT).alias("content"), F.trim("text").alias("url"), is_bare_url(F.col("text")).alias("bare"))
    if fetch is None:
        return plain.drop("url", "bare")
    pages = fetched(plain.where("bare").select("url"), fetch).where("error is null").select("url", F.col("title").alias("page_title"), "address", F.col("content").alias("page"))
    both = plain.join(pages, (plain["url"] == pages["url"]) & F.col("bare"), "left")
    hit = F.col("address").isNotNull()
    pick = lambda there, name: F.when(hit, there).otherwise(F.col(name)).alias(name)
    return both.select("id", pick(F.col("page_title"), "title"), pick(F.lit("web"), "kind"), pick(F.col("address"), "source"), pick(F.col("page"), "content"))


def taken_first(files: Column, url: Column, text: Column, bitmap: Column | None = None) -> Column:
    """What of a drop or a clipboard is taken, struct<what, value>: its files, else an address, else text, else a picture."""
    blank = lambda c: F.when(F.trim(c) != "", c)
    options = [("files", F.when(F.size(files) > 0, F.array_join(files, "\n"))), ("url", blank(url)), ("text", blank(text))]
    options += [] if bitmap is None else [("bitmap", bitmap)]
    out = F.lit(None)
    for what, value in reversed(options):
        out = F.when(value.isNotNull(), F.struct(F.lit(what).alias("what"), value.cast("string").alias("value"))).otherwise(out)
    return out


def kept_copies(files: DataFrame, policy: str) -> DataFrame:
    """Rows (path, stored, content) of binary files (path, content) whose copy a policy keeps, named by the hash of their bytes."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    return files.where(keeps_copy(policy, F.octet_length("content"))).select("path", copy_name(F.sha2("content", 256), extension).alias("stored"), "content")


def free_names(names: DataFrame, taken: DataFrame) -> DataFrame:
    """Rows (id, name) of file names (id, stem, extension) that none in ``taken`` (name) has: "stem (n)" where it must be."""
    from pyspark.sql import Window

    used = F.regexp_extract("name", r"(?s)^(.*?)(?: \((\d+)\))?\.([^.]*)$", 2)
    stems = taken.select(F.regexp_extract("name", r"(?s)^(.*?)(?: \(\d+\))?\.([^.]*)$", 1).alias("stem"), F.regexp_extract("name", r"\.([^.]*)$", 1).alias("extension"), F.when(used == "", F.lit(1)).otherwise(used.cast("int")).alias("number"))
    last = stems.groupBy("stem", "extension").agg(F.max("number").alias("last"))
    turn = F.row_number().over(Window.partitionBy("stem", "extension").orderBy("id")) + F.coalesce("last", F.lit(0))
    made = names.join(last, ["stem", "extension"], "left").withColumn("turn", turn)
    return made.select("id", F.concat("stem", F.when(F.col("turn") > 1, F.concat(F.lit(" ("), F.col("turn").cast("string"), F.lit(")"))).otherwise(""), F.lit("."), "extension").alias("name"))


def first_text(layout: Column, plain: Column, ocr: Column) -> Column:
    """Of three readings of a PDF the first of 20 words or more, else the first with any text."""
    enough = lambda c: F.when(F.size(F.split(F.trim(c), r"\s+")) >= 20, c)
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(enough(layout), enough(plain), enough(ocr), some(layout), some(plain), some(ocr))


def keeps_copy(policy: str, size: Column) -> Column:
    """Whether a file is copied under a policy: always, never, or small files."""
    return F.lit(True) if policy == "always" else F.lit(False) if policy == "never" else size <= MAX_COPY


def copy_name(file_hash: Column, extension: Column) -> Column:
    return F.concat(F.lit("files/"), F.substring(file_hash, 1, 24), F.lit("."), extension)


def open_path(source: Column, source_there: Column, stored: Column, stored_there: Column) -> Column:
    """Where to open an item: the original while it is there, else our copy, else the original's name."""
    return F.when(source_there, source).when((stored != "") & stored_there, stored).otherwise(source)


def capture_title(stem: Column, png: Column) -> Column:
    """Title of a screenshot with the size in its PNG header."""
    number = lambda at: F.conv(F.hex(F.substring(png, at, 4)), 16, 10)
    return F.concat(F.lit("Screenshot "), stem, F.lit(" "), number(17), F.lit("×"), number(21))
