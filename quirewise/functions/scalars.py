"""Scalar functions, Column -> Column, all inside whole-stage codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space that trimming takes off.
TRIMMED = " \t\n\r\0\x0b"
DOCX = "docx"


def trim(c: Column) -> Column:
    """Both ends, with tabs, line ends, NUL and vertical tabs."""
    return F.btrim(c, F.lit(TRIMMED))


def filled(c: Column) -> Column:
    """Null where empty."""
    return F.nullif(c, F.lit(""))


def is_docx(extension: Column) -> Column:
    return F.lower(extension) == DOCX


def basename(path: Column) -> Column:
    """The last segment; backslashes separate too, and trailing separators don't count."""
    unified = F.rtrim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.regexp_replace(unified, "(?s)^.*/", "")


def docx_name(name: Column) -> Column:
    """A safe file name that ends in .docx; null (status 400) for names without a usable segment."""
    base = basename(trim(name))
    usable = (trim(name) != "") & ~base.isin("", ".", "..")
    return F.when(usable, F.when(F.lower(base).endswith(".docx"), base).otherwise(F.concat(base, F.lit(".docx"))))


def save_as_name(given: Column, current: Column) -> Column:
    """The given name, else the current one, else a default."""
    return F.coalesce(filled(given), filled(current), F.lit("document.docx"))


def locale(lang: Column) -> Column:
    """de for a language that starts so, en for all others, for default and for none."""
    low = F.lower(lang)
    return F.when(~F.coalesce(low, F.lit("")).isin("", "default") & low.startswith("de"), "de").otherwise("en")


def display_name(real_name: Column, username: Column) -> Column:
    """The real name if there is one, else the user name, which may be empty; without either: Editor."""
    return F.coalesce(filled(trim(real_name)), trim(F.coalesce(username, F.lit("Editor"))))


def path_label(storage: Column, identifier: Column) -> Column:
    path = F.ltrim(identifier, F.lit("/"))
    return F.when(F.coalesce(storage, F.lit("")) != "", F.concat(storage, F.lit(" / "), path)).otherwise(path)


def download_url(url: Column) -> Column:
    """Absolute URLs (lower-case scheme) stay, others become root-relative; null where there is none."""
    return F.when(url.rlike("^https?://"), url).when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("/"), F.ltrim(url, F.lit("/"))))


def with_parameter(url: Column, key: str, value: Column) -> Column:
    mark = F.when(F.instr(url, "?") > 0, "&").otherwise("?")
    return F.concat(url, mark, F.lit(f"{key}="), F.url_encode(value))


def dataset_key(key: Column) -> Column:
    """labelSaved for saved."""
    return F.concat(F.lit("label"), F.upper(F.substring(key, 1, 1)), key.substr(F.lit(2), F.length(key)))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def base64(c: Column) -> Column:
    """Without line breaks, under the session settings."""
    return F.base64(c)


def strict_base64(c: Column) -> Column:
    """Null for anything that isn't base64 (status 400), unlike the lenient decoder."""
    return F.try_to_binary(c, F.lit("base64"))


def php_int(c: Column, missing: int = 0) -> Column:
    """The leading number of a string as 64 bits, fractions cut off; 0 without one; `missing` for null.

    Whole numbers beyond 64 bits stop at the ends of the range; with a fraction or an exponent they are 0.
    """
    number = F.regexp_extract(c, r"^[ \t\n\r\x0B\f]*([+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    whole = number.rlike(r"^[+-]?\d+$")
    end = F.when(number.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
    real = number.try_cast("double")
    cut = F.when(F.abs(real) < 2.0**63, real).try_cast("bigint")
    value = F.when(whole, F.coalesce(number.try_cast("bigint"), end)).otherwise(cut)
    return F.when(c.isNull(), F.lit(missing).cast("bigint")).otherwise(F.coalesce(value, F.lit(0)))


def variant_int(v: Column, missing: int = 0) -> Column:
    """A JSON value as a whole number: true is 1, a list or object is 1 unless empty, texts as `php_int` reads them; `missing` for null."""
    kind, text = F.schema_of_variant(v), v.cast("string")
    nested = F.when(text.isin("[]", "{}"), 0).otherwise(1).cast("bigint")
    return F.when(v.isNull() | (kind == "VOID"), F.lit(missing).cast("bigint")).when(kind == "BOOLEAN", F.when(text == "true", 1).otherwise(0)).when(kind.rlike("^(ARRAY|OBJECT)"), nested).otherwise(php_int(text, missing))


def variant_text(v: Column) -> Column:
    """A JSON value as text: true is 1, false is empty, a whole number has no decimals, a list or object is the word Array; null for null."""
    kind, text = F.schema_of_variant(v), v.cast("string")
    return F.when(v.isNull() | (kind == "VOID"), F.lit(None)).when(kind == "BOOLEAN", F.when(text == "true", "1").otherwise("")).when(kind.rlike("^(ARRAY|OBJECT)"), "Array").when(kind != "STRING", F.regexp_replace(text, r"\.0+$", "")).otherwise(text)


def json_depth(text: Column) -> Column:
    """How deeply a JSON text nests lists and objects; braces inside its strings don't count."""
    marks = F.regexp_extract_all(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), F.lit(r"[\[\]{}]"), 0)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(state: Column, mark: Column) -> Column:
        now = state["now"] + F.when(mark.isin("[", "{"), 1).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda state: state["most"])


def error_status(code: Column) -> Column:
    """Statuses outside 400 to 599 become 500."""
    return F.when(code.between(400, 599), code).otherwise(F.lit(500))


def clamped_left(x: Column, width: Column, window: Column, margin: int = 8) -> Column:
    """A popover's left edge, kept inside the window."""
    return F.least(F.greatest(x, F.lit(margin)), F.greatest(F.lit(margin), window - width - margin))


def moved_left(x: Column, width: Column, height: Column, window: Column, margin: int = 8) -> Column:
    """The edge to set, rounded, or null: boxes without size stay, and so do moves of one pixel or less."""
    left = clamped_left(x, width, window, margin)
    return F.when((width > 0) & (height > 0) & (F.abs(left - x) > 1), F.floor(left + 0.5).cast("long"))


def is_popover(position: Column, z_index: Column, least: int = 1000) -> Column:
    return (position == "fixed") & (php_int(z_index) >= least)


def flag(c: Column) -> Column:
    """'1' or '0'."""
    return F.when(c, "1").otherwise("0")


def is_set(c: Column) -> Column:
    return F.coalesce(c == "1", F.lit(False))


def host_blocked(url: Column, hosts: list[str]) -> Column:
    """Whether the URL's host, in any case, is listed; invalid URLs aren't."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(hosts), F.lit(False))


def link_blocked(tag: Column, rel: Column, url: Column, hosts: list[str]) -> Column:
    """Whether a link element loads a style sheet from a listed host; other elements never do."""
    return F.coalesce((tag == "LINK") & F.lower(rel).contains("stylesheet"), F.lit(False)) & host_blocked(url, hosts)


def saves_by_key(key: Column, ctrl: Column, meta: Column, shift: Column, writable: Column) -> Column:
    """The shortcut: s in any case with control or command, without shift, where the user may write."""
    return (ctrl | meta) & (F.lower(key) == "s") & ~shift & is_set(writable)


def accepts_message(origin: Column, own: Column, action: Column, chosen: str, field: Column, value: Column) -> Column:
    """A message of the own origin whose action is `chosen`: a folder was picked."""
    picked = (action == chosen) & (field == "folder") & (F.coalesce(value, F.lit("")) != "")
    return F.coalesce((origin == own) & picked, F.lit(False))


def html_safe_json(c: Column) -> Column:
    """JSON text with the five characters that HTML minds escaped inside strings."""
    escapes = (("<", "\\u003C"), (">", "\\u003E"), ("&", "\\u0026"), ("'", "\\u0027"))
    quoted = F.replace(F.to_json(c), F.lit('\\"'), F.lit("\\u0022"))
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), escapes, quoted)


def toast(status: Column, detail: Column, path: Column, name: Column, labels: dict[str, Column]) -> Column:
    """(level, title, message) of a notification; null for states that show none, such as saving.

    labels: saved, savedDetail and saveFailed, where there are some.  What was saved is told by the path, else
    the name; the detail is that of an error.
    """
    label = lambda key, other: F.coalesce(filled(labels[key]), other) if key in labels else other
    box = lambda level, title, text: F.struct(F.lit(level).alias("level"), title.alias("title"), text.alias("message"))
    failed = label("saveFailed", F.lit("Save failed"))
    saved = box("success", label("saved", F.lit("Saved")), label("savedDetail", F.coalesce(filled(path), filled(name), F.lit(""))))
    return F.when(status == "saved", saved).when(status == "error", box("error", failed, F.coalesce(filled(detail), failed)))
