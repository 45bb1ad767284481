"""Scalar functions on texts, times and codes. Built-in expressions unless noted."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of JavaScript's \s and trim(), as a class of Java's regular expressions.
BLANKS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
_STRIP = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_MARKS = {c: None for c in range(0x300, 0x370)}
#: Elements that count as paragraphs, and those that a shared text may keep.
_PARAGRAPHS = frozenset(("p", "blockquote", "h1", "h2", "h3", "li"))
_ALLOWED = frozenset("p br blockquote h1 h2 h3 h4 ul ol li strong b em i u s hr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# fixed values: bytes of an image, files of one upload
IMAGE_BYTES, UPLOAD_FILES = 8 * 1024 * 1024, 12
#: Texts of a batch that are parsed at once.
SLICE = 64
# fixed values: patterns that decide what counts as what
_DIALOGUE = r'^[—–\-]|[“”"]|\b(disse|perguntou|respondeu|sussurrou|gritou|falou)\b'
_BLOCK_TAGS = r"(?i)<(?:p|h[1-6]|ul|ol|li|blockquote|img|hr|div|br)\b"
_IMAGE_URL = r"^data:image/(?:png|jpe?g|webp|gif);base64,[A-Za-z0-9+/=]+$"
#: Month names of the date display.
_MONTHS = ["jan.", "fev.", "mar.", "abr.", "mai.", "jun.", "jul.", "ago.", "set.", "out.", "nov.", "dez."]


def norm(text: str | None) -> str | None:
    """Search form of one text: decomposed, without combining marks, lower case, trimmed."""
    if text is None:
        return None
    if text.isascii():
        return text.lower().strip(_STRIP)
    return unicodedata.normalize("NFD", text).translate(_MARKS).lower().strip(_STRIP)


def normalise(text: Column | str) -> Column:
    """``norm`` of a column, in the JVM: ASCII texts are only lower-cased, others decomposed by ICU, which Spark has on board.

    Spark takes a call by reflection for one whose result may change, so it is not
    moved below joins; use it where its column is made.
    """
    value = F.col(text) if isinstance(text, str) else text
    decomposed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), value, F.lit(False))
    bare = F.regexp_replace(decomposed, r"[\u0300-\u036F]+", "")
    plain = F.octet_length(value) == F.char_length(value)
    return F.btrim(F.lower(F.when(plain, value).when(value.isNotNull(), bare)), F.lit(_STRIP))


def trim(text: Column) -> Column:
    """JavaScript's trim."""
    return F.regexp_replace(text, f"^[{BLANKS}]+|[{BLANKS}]+$", "")


def word_count(html: Column) -> Column:
    """Words of a text whose tags count as spaces; character references are not decoded."""
    plain = trim(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))
    return F.when(plain == "", 0).otherwise(F.size(F.split(plain, f"[{BLANKS}]+"))).cast("int")


def escape_pattern(text: Column) -> Column:
    """The text as a pattern that matches itself."""
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def mentions(norm_text: Column, norm_name: Column) -> Column:
    """Whether a normalised name stands in a normalised text as a whole word; names of one character never do."""
    edge = "[^a-z0-9]"
    pattern = F.concat(F.lit(f"(?:^|{edge})"), escape_pattern(norm_name), F.lit(f"(?:$|{edge})"))
    return (F.length(norm_name) >= 2) & F.rlike(norm_text, pattern)


def is_dialogue(norm_paragraph: Column, norm_name: Column) -> Column:
    """A leading dash, a quotation mark anywhere, a verb of speech, or a leading "name:"."""
    return has_dialogue_signs(norm_paragraph) | is_called(norm_paragraph, norm_name)


def has_dialogue_signs(norm_paragraph: Column) -> Column:
    """Dialogue, whatever the name."""
    return norm_paragraph.rlike(_DIALOGUE)


def is_called(norm_paragraph: Column, norm_name: Column) -> Column:
    """A leading "name:"."""
    return norm_paragraph.startswith(F.concat(norm_name, F.lit(":")))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?i)https?://[^{BLANKS}]+", 0), F.lit(""))


def to_html(text: Column) -> Column:
    """Plain text as paragraphs; a text with block tags stays as it is, an empty one is an empty paragraph."""
    value = trim(F.coalesce(text, F.lit("")))
    escaped = F.replace(F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    blocks = F.transform(F.split(escaped, "\n{2,}"), lambda p: F.concat(F.lit("<p>"), F.replace(p, F.lit("\n"), F.lit("<br>")), F.lit("</p>")))
    has_blocks = value.rlike(_BLOCK_TAGS)
    return F.when(value == "", "<p></p>").when(has_blocks, text).otherwise(F.array_join(blocks, ""))


def millis(text: Column) -> Column:
    """Milliseconds of a UTC text time; 0 if blank or not a time."""
    iso = F.when(text.contains("T"), text).otherwise(F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("Z")))
    return F.coalesce(F.unix_millis(F.try_to_timestamp(iso)), F.lit(0).cast("long"))


def _day(stamp: Column) -> Column:
    month = F.element_at(F.array(*map(F.lit, _MONTHS)), F.month(stamp))
    return F.concat(F.date_format(stamp, "dd"), F.lit(" de "), month, F.lit(" de "), F.date_format(stamp, "yyyy"))


def date_text(text: Column) -> Column:
    """A date for display; what is no date stays as it is, nothing becomes "Sem data". A bare date is its noon."""
    iso = F.when(F.length(text) == 10, F.concat(text, F.lit("T12:00:00"))).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", "Sem data").otherwise(F.coalesce(_day(F.try_to_timestamp(iso)), text))


def relative_age(text: Column, now_millis: Column) -> Column:
    """How long ago, in the words of the library's cards; older than 30 days: the date."""
    at = millis(text)
    minutes = F.greatest(F.lit(0).cast("long"), F.floor((now_millis - at) / 60000))
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    stamp = F.timestamp_millis(at)
    return (
        F.when(at == 0, "Sem edição")
        .when(minutes < 2, "Editado agora")
        .when(minutes < 60, F.concat(F.lit("Editado há "), minutes.cast("string"), F.lit(" min")))
        .when(hours < 24, F.concat(F.lit("Editado há "), hours.cast("string"), F.lit(" h")))
        .when(days < 30, F.concat(F.lit("Editado há "), days.cast("string"), F.when(days == 1, " dia").otherwise(" dias")))
        .otherwise(_day(stamp))
    )


def number_text(value: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(value, 0), ",", ".")


def now_text() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")


def default_text(text: Column, default: str, longest: int | None = None) -> Column:
    """Trimmed, or the default if nothing is left; cut to ``longest`` characters."""
    value = F.coalesce(F.nullif(trim(text), F.lit("")), F.lit(default))
    return F.substring(value, 1, longest) if longest else value


def base64url(data: Column) -> Column:
    """base64url without padding of a binary column."""
    return F.regexp_replace(F.translate(F.base64(data), "+/", "-_"), r"[=\r\n]", "")


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def is_pairing_code(code: Column) -> Column:
    """Whether what was typed is a code of six digits."""
    return F.coalesce(trim(code).rlike("^[0-9]{6}$"), F.lit(False))


def pairs_with(code: Column, expected: Column) -> Column:
    """Whether the code that was typed is the one that a device shows."""
    return is_pairing_code(code) & F.coalesce(trim(code) == expected, F.lit(False))


def is_image_url(text: Column) -> Column:
    """A data URL of an image that a viewer may show."""
    return F.coalesce(text.rlike(_IMAGE_URL), F.lit(False))


def image_url(mime: Column, content: Column) -> Column:
    """Data URL of a file's bytes; null if it is no image or larger than IMAGE_BYTES."""
    encoded = F.regexp_replace(F.base64(content), r"[\r\n]", "")
    return F.when(mime.startswith("image/") & (F.length(content) <= IMAGE_BYTES), F.concat(F.lit("data:"), mime, F.lit(";base64,"), encoded))


class _Tree(HTMLParser):
    """Just enough of a document tree: elements as [tag, children], texts as str."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root: list = ["body", []]
        self.stack: list[list] = [self.root]
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "body", "head"):
            return
        if tag in _PARAGRAPHS and tag != "li" or tag in ("ul", "ol", "div", "table", "hr", "h4", "h5", "h6"):
            self._close("p", ())
        if tag == "li":
            self._close("li", ("ul", "ol"))
        node = [tag, []]
        self.stack[-1][1].append(node)
        if tag not in _VOID:
            self.stack.append(node)

    def _close(self, tag: str, stops: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return
            if self.stack[k][0] in stops:
                return

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        self.stack[-1][1].append(data)


def _walk(node: list):
    """Elements and texts below a node, in document order; no recursion, so depth does not matter."""
    todo = [iter(node[1])]
    while todo:
        for child in todo[-1]:
            yield child
            if not isinstance(child, str):
                todo.append(iter(child[1]))
                break
        else:
            todo.pop()


def _text(node: list) -> str:
    return "".join(x for x in _walk(node) if isinstance(x, str))


def paragraphs(html: str | None) -> list[str]:
    """Texts of the paragraph elements, nested ones once for each level; without any, the lines of the text."""
    if not html or not html.strip(_STRIP):
        return []
    tree = _Tree(html)
    found = [_text(x).strip(_STRIP) for x in _walk(tree.root) if not isinstance(x, str) and x[0] in _PARAGRAPHS]
    found = [x for x in found if x]
    if found:
        return found
    return [x for x in (line.strip(_STRIP) for line in _text(tree.root).strip(_STRIP).split("\n")) if x]


@F.arrow_udf(T.ArrayType(T.StringType()))
def html_paragraphs(html: pa.Array) -> pa.Array:
    """``paragraphs`` of a column; there is no HTML parser among the built-in functions.

    A batch is parsed in slices, so that Python has few texts at a time beside Arrow's.
    """
    kind, texts, sizes = pa.list_(pa.string()), [], []
    for start in range(0, len(html), SLICE):
        found = [paragraphs(x) for x in html.slice(start, SLICE).to_pylist()]
        texts.append(pa.array([p for ps in found for p in ps], pa.string()))
        sizes += map(len, found)
    places = pa.array(accumulate(sizes, initial=0), pa.int32())
    whole = pa.concat_arrays(texts) if texts else pa.array([], pa.string())
    return pa.ListArray.from_arrays(places, whole, kind)


def sanitise(html: str | None) -> str:
    """Only allowed elements without attributes; others are unwrapped and their texts stay. The whole text is read."""
    from html import escape

    if not html:
        return ""
    tree, out = _Tree(html), []
    todo: list[tuple[str | None, object]] = [(None, iter(tree.root[1]))]
    while todo:
        tag, rest = todo[-1]
        for child in rest:
            if isinstance(child, str):
                out.append(escape(child, quote=False))
                continue
            if child[0] in _ALLOWED:
                out.append(f"<{child[0]}>")
            if child[0] not in _VOID:
                todo.append((child[0], iter(child[1])))
                break
        else:
            todo.pop()
            if tag in _ALLOWED:
                out.append(f"</{tag}>")
    if not _text(tree.root).strip(_STRIP) and html.strip(_STRIP):
        return escape(html, quote=False)
    return "".join(out)


@F.arrow_udf(T.StringType())
def sanitise_html(html: pa.Array) -> pa.Array:
    return pa.concat_arrays([pa.array(map(sanitise, html.slice(k, SLICE).to_pylist()), pa.string()) for k in range(0, max(1, len(html)), SLICE)])
