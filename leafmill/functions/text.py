"""Text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FULL_WIDTH_SHIFT = 0xFEE0


def _shifted(first: int, last: int) -> tuple[str, str]:
    wide = "".join(chr(c) for c in range(first, last + 1))
    return wide, "".join(chr(ord(c) - _FULL_WIDTH_SHIFT) for c in wide)


def full_to_half(text: Column) -> Column:
    """Full-width forms U+FF01–U+FF5E to ASCII."""
    return F.translate(text, *_shifted(0xFF01, 0xFF5E))


def full_to_half_alphanumeric(text: Column) -> Column:
    """Only full-width digits and letters to ASCII; marks stay."""
    ranges = [_shifted(0xFF10, 0xFF19), _shifted(0xFF21, 0xFF3A), _shifted(0xFF41, 0xFF5A)]
    return F.translate(text, "".join(r[0] for r in ranges), "".join(r[1] for r in ranges))


def ends_with_word_hyphen(line: Column) -> Column:
    """An ASCII word broken by a hyphen at the line end."""
    return line.rlike("[A-Za-z]+[-­‐‑⁃]\\s*$")


# Ligature characters and their letters.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}


def expand_ligatures(text: Column) -> Column:
    """Ligatures to letters, CRLF dropped, U+0002 to a hyphen."""
    for char, letters in LIGATURES.items():
        text = F.replace(text, F.lit(char), F.lit(letters))
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("")), F.lit("\u0002"), F.lit("-"))


def strip_control(text: Column) -> Column:
    """Drop newlines, control, surrogate and unassigned characters."""
    return F.regexp_replace(text, "\\p{C}", "")


def bytes_md5(data: Column) -> Column:
    return F.upper(F.md5(data))


def text_md5(text: Column) -> Column:
    return F.md5(text)


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A flat object as JSON with sorted keys and ``", "``/``": "`` separators (strings and integers)."""
    def value(c: Column) -> Column:
        return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)

    pairs = [F.concat(F.lit(f'"{k}": '), value(fields[k])) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))


def object_md5(fields: dict[str, Column]) -> Column:
    return F.md5(canonical_json(fields))


def _json_string(text: Column) -> Column:
    """A JSON string with other than ASCII characters as they are and lower-case ``\\u`` escapes."""
    quoted = F.regexp_extract(F.to_json(F.struct(text.alias("v"))), "(?s)^\\{\"v\":(.*)\\}$", 1)
    for code in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):  # escapes written with capital digits
        quoted = F.regexp_replace(quoted, rf"(?<!\\)((?:\\\\)*)\\u00{code}", rf"$1\\u00{code.lower()}")
    return quoted


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, whatever the number of mentions."""
    return F.transform(F.array(value), use)[0]


def _json_double(value: Column) -> Column:
    """The shortest digits that give the number back, without exponent from 1e-4 up to 1e16."""
    zeros = lambda k: F.repeat(F.lit("0"), k)

    def shortest(number: Column) -> Column:
        # the string form may have a digit too many: fewer do where they read back as the same number
        cut = F.regexp_replace(number.cast("string"), r"^(-?\d+\.\d+)\d(E.*)?$", "$1$2")
        fewer = [*[F.format_string(f"%.{n}e", number) for n in (14, 15)], cut]
        plain = (F.abs(number) < float("inf")) & (number != 0)
        return F.coalesce(*[F.when(plain & (text.try_cast("double") == number), text) for text in fewer], number.cast("string"))

    def parsed(text: Column) -> Column:
        part = lambda n: F.regexp_extract(text, r"^-?(\d+)\.(\d+)(?:[eE]\+?(-?\d+))?$", n)
        exponent = F.coalesce(F.nullif(part(3), F.lit("")).cast("int"), F.lit(0))
        lead = F.length(part(2)) - F.length(F.ltrim(part(2), F.lit("0")))
        point = exponent + F.when(part(1) == "0", -lead - 1).otherwise(F.length(part(1)) - 1)
        digits = F.rtrim(F.ltrim(F.concat(part(1), part(2)), F.lit("0")), F.lit("0"))
        return F.struct(text.alias("text"), digits.alias("d"), point.alias("x"), F.when(text.startswith("-"), "-").otherwise("").alias("sign"))

    def shown(p: Column) -> Column:
        d, x, n = p["d"], p["x"], F.length(p["d"])
        plain = (
            F.when(x >= n - 1, F.concat(d, zeros(x - n + 1), F.lit(".0")))
            .when(x >= 0, F.concat(F.substring(d, F.lit(1), x + 1), F.lit("."), F.substring(d, x + 2, n)))
            .otherwise(F.concat(F.lit("0."), zeros(-x - 1), d))
        )
        tail = F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise("")
        size = F.abs(x).cast("string")
        power = F.concat(F.when(x < 0, "e-").otherwise("e+"), F.lpad(size, F.greatest(F.lit(2), F.length(size)), F.lit("0")))
        number = F.when(n == 0, "0.0").when((x >= -4) & (x < 16), plain).otherwise(F.concat(F.substring(d, F.lit(1), F.lit(1)), tail, power))
        return F.when(p["text"].isin("NaN", "Infinity", "-Infinity"), p["text"]).otherwise(F.concat(p["sign"], number))

    return _with(value.cast("double"), lambda number: _with(_with(shortest(number), parsed), shown))


def canonical_value(value: Column, kind: T.DataType) -> Column:
    """A value of any type as JSON, keys of structs and maps sorted at every depth, ``", "`` and ``": "`` between parts; null is ``null``.

    The serializer follows the type: structs and maps become objects, arrays arrays; binary is base64, dates, times and decimals are strings.
    """
    if isinstance(kind, T.StructType):
        parts = [F.concat(_json_string(F.lit(f.name)), F.lit(": "), canonical_value(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical_value(e["value"], kind.valueType).alias("value"))))
        out = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_json_string(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda e: canonical_value(e, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        out = _json_double(value)
    elif isinstance(kind, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        out = value.cast("string")
    elif isinstance(kind, T.BinaryType):
        out = _json_string(F.base64(value))
    else:
        out = _json_string(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(out)


def typed_object_md5(rows: DataFrame, column: str) -> Column:
    """MD5 of the canonical JSON of a column of ``rows``, nested as deep as its type."""
    return F.md5(canonical_value(F.col(column), rows.schema[column].dataType))


def escape_markdown(text: Column) -> Column:
    """Backslash before ``* _ ` ~ $`` that an even number of backslashes precedes."""
    return F.regexp_replace(text, r"(?<!\\)((?:\\\\)*)([*_`~$])", r"$1\\$2")


def escape_block_prefix(text: Column) -> Column:
    """Backslash before a leading heading or list marker."""
    return F.regexp_replace(text, r"^([ \t]{0,3})(#{1,6}|[+-])(?=[ \t])", r"$1\\$2")


def escape_lone_rule(text: Column) -> Column:
    """Backslash before a line of only ``_`` or only ``-``."""
    return F.when(text.rlike(r"^(_+|-+)\z"), F.concat(F.lit("\\"), text)).otherwise(text)


def escape_html(text: Column, quote: bool = False) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for char, entity in pairs:
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


# Markdown wrapper of a style set (sorted, comma-joined).
MARKDOWN_WRAPPERS = {"bold": "**", "italic": "*", "strikethrough": "~~", "bold,italic": "***"}
# HTML tag of a style, innermost first; superscript wins over subscript.
EMPHASIS_CSS = "text-emphasis: dot; text-emphasis-position: under;"
HTML_WRAPPERS = [
    ("underline", "<u>", "</u>"),
    ("bold", "<strong>", "</strong>"),
    ("italic", "<em>", "</em>"),
    ("strikethrough", "<s>", "</s>"),
    ("emphasis", f'<span style="{EMPHASIS_CSS}">', "</span>"),
]
COMPLEX_STYLES = ("underline", "emphasis", "superscript", "subscript")


def style_key(styles: Column) -> Column:
    """Style array as a canonical key."""
    return F.array_join(F.array_sort(F.array_distinct(styles)), ",")


def markdown_style(text: Column, styles: Column) -> Column:
    """Markdown wrapper for the four simple style sets; other sets leave the text alone."""
    key, mark = style_key(styles), F.lit("")
    for name, wrapper in MARKDOWN_WRAPPERS.items():
        mark = F.when(key == name, F.lit(wrapper)).otherwise(mark)
    mark = F.when(text == "", "").otherwise(mark)
    return F.concat(mark, text, mark)


def html_style(text: Column, styles: Column) -> Column:
    """HTML tags around the text."""
    sup, sub = F.array_contains(styles, "superscript"), F.array_contains(styles, "subscript")
    left = [F.when(sup, "<sup>").when(sub, "<sub>").otherwise("")]
    right = [F.when(sup, "</sup>").when(sub, "</sub>").otherwise("")]
    for name, opening, closing in HTML_WRAPPERS:
        present = F.array_contains(styles, name)
        left.insert(0, F.when(present, opening).otherwise(""))
        right.append(F.when(present, closing).otherwise(""))
    return F.when((text == "") | (F.size(styles) == 0), text).otherwise(F.concat(*left, text, *right))


def needs_boundary_space(
    previous: Column, previous_wrapped: Column, following: Column, following_type: Column
) -> Column:
    """A Markdown wrapper that ends in punctuation needs a space before a letter."""
    return (
        previous_wrapped
        & ~following_type.isin("hyperlink", "inline_equation", "interline_equation")
        & previous.rlike(r"[\p{P}\p{S}]\z")
        & following.rlike(r"^[^\s\p{P}\p{S}]")
    )


def section_parts(text: Column) -> Column:
    """Leading section number ``1.2.3`` as an array of integers (empty when there is none)."""
    number = F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)*)", 1)
    parts = F.transform(F.split(number, r"\."), lambda p: p.cast("long"))
    return F.when(number != "", parts).otherwise(F.array().cast("array<bigint>"))


def section_parts_at(text: Column, level: Column) -> Column:
    """The parts when there are exactly ``level`` of them, else null."""
    parts = section_parts(text)
    return F.when(F.size(parts) == level, parts)


def corrected_toc_level(level: Column, text: Column) -> Column:
    """Table-of-contents level made shallower when the text's own number is."""
    number = F.regexp_extract(F.trim(text), r"^(\d+(?:\.\d+)+)(?![\d.])", 1)
    depth = F.size(F.split(number, r"\.")) - 1
    return F.when((level != 0) & (number != "") & (depth < level), depth).otherwise(level)


def is_page_token(token: Column) -> Column:
    t = F.trim(token)
    return (F.length(t) <= 12) & t.rlike(r"^(\d+|[ivxlcdmIVXLCDM]+|[a-zA-Z])\z")


def strip_toc_page(text: Column) -> Column:
    """Drop a page number after the last tab; other tabs become spaces."""
    tail = F.element_at(F.split(text, "\t"), -1)
    has_tail = text.contains("\t") & is_page_token(tail)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(tail) - 1)
    return F.replace(F.when(has_tail, head).otherwise(text), F.lit("\t"), F.lit(" "))


def inline_math(html: Column, left: str = "$", right: str = "$") -> Column:
    """``<eq>…</eq>`` to delimited math with blanks around."""
    esc = [d.replace("\\", "\\\\").replace("$", "\\$") for d in (left, right)]
    return F.regexp_replace(html, r"(?s)<eq>(.*?)</eq>", f" {esc[0]}$1{esc[1]} ")


def prefix_local_src(html: Column, folder: str) -> Column:
    """Put a folder before every ``src`` that is not a data URI."""
    if not folder:
        return html
    safe = folder.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(html, r'src="(?!data:)([^"]+)"', f'src="{safe}/$1"')


def embedded_html(html: Column, folder: str = "") -> Column:
    return inline_math(prefix_local_src(html, folder))


def strip_display_math(text: Column) -> Column:
    r"""Formula without its ``\[`` and ``\]``."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"^\\\[", ""), r"\\\]\z", ""), F.lit(" \t\r\n"))


def strip_code_fence(text: Column) -> Column:
    """Code without its opening and closing fence lines."""
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*(\n|\z)", ""), r"(^|\n)[ \t]*```[ \t]*\n?\z", "")
    return F.trim(inner, F.lit(" \t\r\n"))


def unescape_brackets(text: Column) -> Column:
    r"""``\[x\]`` to ``[x]`` where every bracket has its partner."""
    opened, closed = F.regexp_count(text, F.lit(r"\\\[")), F.regexp_count(text, F.lit(r"\\\]"))
    plain = F.regexp_replace(text, r"\\\[(.*?)\\\]", "[$1]")
    return F.when((opened == closed) & (opened > 0), plain).otherwise(text)


def serial_to_iso(serial: Column, epoch_1904: bool = False) -> Column:
    """Spreadsheet serial date as ISO text: date at midnight, time of day below 1, else date and time.

    In the 1900 system serials between 0 and 60 count one day less, so they move up by one.
    """
    day = F.floor(serial)
    millis = F.round((serial - day) * 86400000).cast("long")
    if not epoch_1904:
        day = F.when((serial > 0) & (serial < 60), day + 1).otherwise(day)
    epoch = "1904-01-01" if epoch_1904 else "1899-12-30"
    stamp = F.timestamp_millis(F.unix_millis(F.lit(epoch).cast("timestamp")) + day * 86400000 + millis)

    def with_fraction(fmt: str) -> Column:
        return F.when(millis % 1000 == 0, F.date_format(stamp, fmt)).otherwise(F.date_format(stamp, fmt + ".SSSSSS"))

    is_time = (serial >= 0) & (serial < 1) & (millis < 86400000)
    midnight = F.date_format(stamp, "HH:mm:ss.SSS") == "00:00:00.000"
    return (
        F.when(is_time, with_fraction("HH:mm:ss"))
        .when(midnight, F.date_format(stamp, "yyyy-MM-dd"))
        .otherwise(with_fraction("yyyy-MM-dd HH:mm:ss"))
    )


def number_text(value: Column) -> Column:
    """A double as text: whole numbers without ``.0``, null as empty."""
    whole = value == F.floor(value)
    return F.when(value.isNull(), "").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def split_text_and_number(text: Column) -> Column:
    """``Heading12`` → [Heading, 12]; ``12abc…`` → [12, abc…]; else the text alone."""
    tail = F.array(F.regexp_extract(text, r"^(\D+)(\d+)$", 1), F.regexp_extract(text, r"^(\D+)(\d+)$", 2))
    head = F.array(F.regexp_extract(text, r"^(\d+)(\D+)", 1), F.regexp_extract(text, r"^(\d+)(\D+)", 2))
    return F.when(tail[0] != "", tail).when(head[0] != "", head).otherwise(F.array(text))


def bucket_and_key(path: Column) -> Column:
    """``s3://bucket/key`` as a struct."""
    body = F.regexp_replace(F.regexp_replace(F.trim(path), "^s3://", ""), "^/", "")
    return F.struct(
        F.regexp_extract(body, "(?s)^([^/]*)/(.*)$", 1).alias("bucket"),
        F.regexp_extract(body, "(?s)^([^/]*)/(.*)$", 2).alias("key"),
    )


def block_quote(text: Column) -> Column:
    """``> `` before every line, a bare ``>`` before blank ones."""
    lines = F.split(text, "\n")
    return F.array_join(
        F.transform(lines, lambda x: F.when(F.trim(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n"
    )


def object_category(name: Column, known: list[str]) -> Column:
    """Struct (category, label, index) of an object name.

    The first known category found in the name wins; else a trailing number is split off.
    """
    text = F.trim(name)
    base, num = F.trim(F.regexp_extract(text, r"(?s)^(.+?)(\d+)$", 1)), F.regexp_extract(text, r"(?s)^(.+?)(\d+)$", 2)
    nothing = F.lit(None).cast("long")
    out = F.when(
        num != "", F.struct(base.alias("category"), F.concat(base, num.cast("long").cast("string")).alias("label"),
                            (num.cast("long") - 1).alias("index"))
    ).otherwise(F.struct(text.alias("category"), text.alias("label"), nothing.alias("index")))
    for category in reversed(known):
        hit = F.struct(F.lit(category).alias("category"), text.alias("label"), nothing.alias("index"))
        out = F.when(F.contains(F.lower(text), F.lit(category.lower())), hit).otherwise(out)
    return out


def base_name(name: Column) -> Column:
    """Name without its trailing number."""
    return F.when(F.trim(name).rlike(r"(?s)^(.+?)(\d+)$"), F.trim(F.regexp_extract(F.trim(name), r"(?s)^(.+?)(\d+)$", 1))).otherwise(F.trim(name))


# Endings and inner texts that mark a continued table.
CONTINUATION_ENDINGS = [
    "(续)", "(续表)", "(续上表)", "(continued)", "(cont.)", "(cont’d)", "(…continued)", "continued", "续表",
]
CONTINUATION_ANYWHERE = ["(continued)"]


def is_table_continuation(text: Column) -> Column:
    """A continued table's caption; a bare ``continued`` counts only as a whole word."""
    folded = F.lower(full_to_half(F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n　"))))
    marked = folded.rlike(r"(^|[^\p{L}])continued\z")
    for ending in CONTINUATION_ENDINGS:
        if ending != "continued":
            marked = marked | folded.endswith(ending)
    for inner in CONTINUATION_ANYWHERE:
        marked = marked | folded.contains(inner)
    return marked


_OPENING_TAG = r"^<\w+(?:\s+[^>]*)?\s*/?>\z"
# An attribute by the grammar of HTML start tags: a name, and if there is an equals sign a quoted or an unquoted value.
_NAME = r"[^\s\"'<>/=]+"
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+))"""
_ATTRIBUTE = f"({_NAME})(?:{_VALUE})?"

# The named character references that are decoded in links.
NAMED_REFERENCES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}


def decode_references(text: Column) -> Column:
    """Numeric and the common named character references as the characters they stand for, each once, from the left."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#\d{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&\w+;|[^&]+|&)"), F.lit(1))

    def one(piece: Column) -> Column:
        decimal = F.regexp_extract(piece, r"^&#(\d+);?$", 1)
        hexadecimal = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);?$", 1)
        digits = F.when(decimal != "", F.conv(decimal, 10, 16)).otherwise(hexadecimal)
        inside = (F.conv(digits, 16, 10).cast("long") < 0x110000) & ~F.conv(digits, 16, 10).cast("long").between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")
        out = F.when((digits != "") & inside, char)
        for name, meaning in NAMED_REFERENCES.items():
            out = out.when(piece == f"&{name};", meaning)
        return out.otherwise(piece)

    return F.array_join(F.transform(pieces, one), "")


def _safe_href(url: Column) -> Column:
    """Decoded link when it is relative or http(s), mailto or ftp; else empty."""
    url = F.regexp_replace(F.trim(decode_references(url)), "[\\x00-\\x1f]", "")
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    allowed = (scheme == "") | scheme.isin("http", "https", "mailto", "ftp")
    return F.when(allowed, escape_html(url, quote=True)).otherwise(F.lit(""))


def clean_table_html(html: Column) -> Column:
    """Keep only structural attributes: row and column spans, links (sanitised), picture attributes."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?s)(<\w+(?:\s+[^>]*)?\s*/?>|[^<]+|<)"), F.lit(1))

    def attribute(raw: Column, tag: Column) -> Column:
        name = F.lower(F.regexp_extract(raw, _ATTRIBUTE, 1))
        value = F.concat(*[F.regexp_extract(raw, _ATTRIBUTE, i) for i in (2, 3, 4)])
        link = (tag == "a") & (name == "href")
        value = F.when(link, _safe_href(value)).otherwise(value)
        kept = raw.contains("=") & (
            name.isin("colspan", "rowspan")
            | ((tag == "img") & name.isin("src", "alt", "width", "height"))
            | (link & (value != ""))
        )
        return F.when(kept, F.concat(F.lit(" "), name, F.lit('="'), value, F.lit('"'))).otherwise(F.lit(""))

    def clean(token: Column) -> Column:
        tag = F.lower(F.regexp_extract(token, r"^<(\w+)", 1))
        found = F.regexp_extract_all(token, F.lit("(?s)" + _ATTRIBUTE), F.lit(0))
        attrs = F.array_join(F.transform(found, lambda a: attribute(a, tag)), "")
        close = F.when(F.rtrim(token).endswith("/>"), "/>").otherwise(">")
        return F.when(token.rlike("(?s)" + _OPENING_TAG), F.concat(F.lit("<"), tag, attrs, close)).otherwise(token)

    return F.array_join(F.transform(tokens, clean), "")


def table_nesting(html: Column) -> Column:
    """Struct (kind, nest_level): complex when cells span or tables nest."""
    level = F.when(F.regexp_count(html, F.lit("<table")) > 1, 2).otherwise(1)
    complex_ = html.contains("colspan") | html.contains("rowspan") | (level > 1)
    return F.struct(
        F.when(complex_, "complex_table").otherwise("simple_table").alias("kind"), level.alias("nest_level")
    )


PRIVATE_USE = "\\x{E000}-\\x{F8FF}"


def private_use_signal(text: Column) -> Column:
    """Struct (count, ratio, longest_run, flagged) of private-use characters; blanks break a run."""
    count = F.regexp_count(text, F.lit(f"[{PRIVATE_USE}]"))
    visible = F.regexp_count(text, F.lit(r"\S"))
    ratio = F.when(visible > 0, count / visible).otherwise(0.0)
    runs = F.regexp_extract_all(text, F.lit(f"([{PRIVATE_USE}]+)"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))
    flagged = (count >= 2) & ((longest >= 2) | (ratio >= 0.05))
    return F.struct(count.alias("count"), ratio.alias("ratio"), longest.alias("longest_run"), flagged.alias("flagged"))


def algorithm_html(spans: Column, left: str = "$", right: str = "$") -> Column:
    """Ordered (type, content) spans as preformatted HTML; adjacent formulas keep a blank between them."""
    kept = F.filter(
        spans,
        lambda s: ((s["type"] == "text") & (s["content"] != ""))
        | ((s["type"] == "inline_equation") & (F.trim(s["content"]) != "")),
    )

    def piece(s: Column, i: Column) -> Column:
        body = escape_html(s["content"])
        formula = s["type"] == "inline_equation"
        follows = (i > 0) & (F.get(kept, i - 1)["type"] == "inline_equation")
        return (
            F.when(formula & follows, F.concat(F.lit(" " + left), body, F.lit(right)))
            .when(formula, F.concat(F.lit(left), body, F.lit(right)))
            .otherwise(body)
        )

    html = F.array_join(F.transform(kept, piece), "")
    opening = '<div class="algorithm" style="white-space: pre-wrap; font-family:monospace;">\n'
    return F.when(F.trim(html) == "", "").otherwise(F.concat(F.lit(opening), html, F.lit("\n</div>")))
